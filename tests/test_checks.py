"""Syntax check and log classification, by hand-written cases."""

import pytest
from pyspark.sql import functions as F

from partforge.operators import checks as c

EMPTY = [c.NOTHING_LEFT, c.NO_KEYWORD]

SYNTAX = [
    ("cube([1, 2, 3]);", []),
    ("module a() { cube(1);", ["Unbalanced braces: 1 open, 0 close"]),
    ("cube(1));", ["Unbalanced parentheses: 1 open, 2 close"]),
    ("cube([1);", ["Unbalanced brackets: 1 open, 0 close"]),
    ("x = 1;", [c.NO_KEYWORD]),
    ("cube(1); é", [c.NON_ASCII]),
    ("// only {\n// comments", EMPTY),
    ("", EMPTY),
    (None, EMPTY),
    ("\n\n", EMPTY),
    ("  // { indented\ncube(1);", ["Unbalanced braces: 1 open, 0 close"]),
    ("   ", [c.NO_KEYWORD]),
    ("// 20 mm × 20 mm\n\ncube([20, 20, 20], center = true);", []),
    ("sphere(r=10);", []),
    (
        "{ ([ é",
        [
            "Unbalanced braces: 1 open, 0 close",
            "Unbalanced parentheses: 1 open, 0 close",
            "Unbalanced brackets: 1 open, 0 close",
            c.NO_KEYWORD,
            c.NON_ASCII,
        ],
    ),
    (
        "// House\ndifference() {\n    union(){\n      base();\n    }\n"
        "    cylinder(h = a, r = b + (c / tan(d))), center=true);\n    cube([x, 5, h]);",
        [
            "Unbalanced braces: 2 open, 1 close",
            "Unbalanced parentheses: 7 open, 8 close",
        ],
    ),
]


def test_check_syntax(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SYNTAX)], "i INT, code STRING")
    got = c.check_syntax(df).orderBy("i").collect()
    assert [r.errors for r in got] == [e for _, e in SYNTAX]
    assert [r.valid for r in got] == [not e for _, e in SYNTAX]
    assert got[0].asDict().keys() == {"i", "code", "errors", "valid"}


def test_check_response(spark):
    cases = [
        (" cube(1); ", "cube(1);", True, c.VALID),
        ("  ", None, False, c.EMPTY_CODE),
        (None, None, False, c.EMPTY_CODE),
        ("```\n\n```", "", False, c.EMPTY_CODE),
        ("plain", "plain", False, c.NO_KEYWORD),
    ]
    df = spark.createDataFrame([(r[0],) for r in cases], "response STRING").coalesce(1)
    got = [tuple(r) for r in c.check_response(df).collect()]
    assert got == cases


@pytest.mark.parametrize(
    "log, valid, message",
    [
        (("x", 0, "", "", False), True, c.VALID),
        (("x", 0, "a WARNING b", "", False), True, c.VALID_WITH_WARNINGS),
        (("x", 0, "", "WARNING", False), True, c.VALID_WITH_WARNINGS),
        (("x", 0, "warning", "", False), True, c.VALID),
        (("x", 1, "", "a\nfirst error\nERROR", False), False, "first error"),
        (("x", 1, "ERROR", "", False), False, c.COMPILE_FAILED),
        (("x", None, None, None, True), False, c.COMPILE_TIMEOUT),
        (("", 0, "", "", False), False, c.EMPTY_CODE),
        ((None, 0, "", "", False), False, c.EMPTY_CODE),
    ],
)
def test_compile_status(spark, log, valid, message):
    schema = "code STRING, exit_code INT, stdout STRING, stderr STRING, timed_out BOOLEAN"
    row = c.compile_status(spark.createDataFrame([log], schema)).first()
    assert (row.valid, row.message) == (valid, message)


def test_compile_exception(spark):
    schema = (
        "code STRING, exit_code INT, stdout STRING, stderr STRING, timed_out BOOLEAN, "
        "exception STRING"
    )
    df = spark.createDataFrame([("x", None, None, None, False, "no tool")], schema)
    row = c.compile_status(df).first()
    assert (row.valid, row.message) == (False, "no tool")


def test_validator_status(spark):
    many = "\n".join(["x", "ERROR 1", "error 2", "PARSE 3", "ERROR 4", "ERROR 5", "ERROR 6"])
    logs = [(0, "fine"), (0, "a\nsome Warning\nWARNING"), (124, "ERROR"), (1, many), (2, None)]
    df = spark.createDataFrame(logs, "exit_code INT, output STRING").coalesce(1)
    got = [
        (r.passed, r.warned, r.timed_out, r.details) for r in c.validator_status(df).collect()
    ]
    assert got == [
        (True, False, False, []),
        (True, True, False, ["some Warning", "WARNING"]),
        (False, False, True, []),
        (False, False, False, ["ERROR 1", "error 2", "PARSE 3", "ERROR 4", "ERROR 5"]),
        (False, False, False, []),
    ]


def test_render_status(spark):
    logs = [
        (0, True, "", "a.png", False, False),
        (0, False, "", "a.png", False, False),
        (1, True, "no DISPLAY here", "a.png", False, False),
        (1, False, "Can't open X server", "a.png", False, False),
        (1, False, "bad", "a.png", False, False),
        (None, None, None, "a.png", True, False),
        (None, None, None, "a.png", False, True),
        (None, None, None, None, None, None),
    ]
    schema = (
        "exit_code INT, image_exists BOOLEAN, stderr STRING, image STRING, "
        "timed_out BOOLEAN, binary_missing BOOLEAN"
    )
    df = spark.createDataFrame(logs, schema).coalesce(1)
    got = [(r.rendered, r.error, r.image) for r in c.render_status(df, "scad").collect()]
    assert got == [
        (True, None, "a.png"),
        (False, c.UNKNOWN_ERROR, None),
        (False, c.NO_DISPLAY, None),
        (False, c.NO_DISPLAY, None),
        (False, "bad", None),
        (False, c.RENDER_TIMEOUT, None),
        (False, "OpenSCAD not found at 'scad'", None),
        (False, c.UNKNOWN_ERROR, None),
    ]
    off = c.render_status(df, enabled=False)
    assert off.filter(F.col("rendered") | (F.col("error") != c.RENDER_OFF)).isEmpty()
