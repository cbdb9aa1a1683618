"""Text functions against a plain restatement of their rules, and hand-written cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from partforge.functions import text as t


def extract_rule(response):
    if not response:
        return None
    body = response
    if "```openscad" in body:
        body = body.partition("```openscad")[2].partition("```")[0]
    elif "```" in body:
        body = body.split("```")[1]
    lines = body.split("\n")
    for i, line in enumerate(lines):
        s = line.strip()
        prose = s.startswith(("Here", "Sure", "I'll", "This"))
        code = s.startswith(("//", "module", "union", "difference")) or any(
            w in s for w in t.CODE_WORDS
        )
        if s and code and not prose:
            return "\n".join(lines[i:]).strip()
    return body.strip()


def clean_rule(response):
    body = response.rpartition(t.ASSISTANT_HEADER)[2]
    lines = body.split("\n")
    for i, line in enumerate(lines):
        s = line.strip()
        junk = (
            s in ("", "system", "user", "assistant")
            or s.endswith("assistant")
            or any(p in line for p in t.JUNK_PARTS)
        )
        if not junk:
            body = "\n".join(lines[i:])
            break
    for mark in t.STOP_MARKS:
        body = body.partition(mark)[0]
    kept = []
    for line in body.split("\n"):
        if line.strip():
            plain = sum(32 <= ord(c) < 127 for c in line)
            if plain / len(line) < 0.8 or re.search(t.GARBAGE_RUN, line):
                break
        kept.append(line)
    return "\n".join(kept).strip()


PIECES = [
    "```", "```openscad", "```python", "\n", "\n", "\n", " ", "\t", "\r", "\x1c", "\x85", "\xa0",
    " ", "　", "Here is", "Sure", "I'll", "This cube", "// c", "module a()", "union()",
    "difference", "sphere(1);", "cube", "translate", "$fn = 50;", "{", "}", "x", "plain words",
    "system", "user", "assistant", "Cutting Knowledge Date: x", "Today Date:", "my assistant",
    t.ASSISTANT_HEADER, "<|eot_id|>", "<|end_of_text|>", "<|eom_id|>", "<|reserved_special_token_7",
    "привет", "kkkkk", "krvN", "é", "ééééé", "日本", "😀", "aaaaaaaa", "",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize(
    "function, rule", [(t.extract_code, extract_rule), (t.clean_response, clean_rule)]
)
def test_random_texts_follow_the_rule(spark, function, rule):
    texts = [(s,) for s in random_texts(20_000, 11)]
    df = spark.createDataFrame(texts, "s STRING").select("s", function(F.col("s")).alias("got"))
    wrong = [(r.s, r.got, rule(r.s)) for r in df.collect() if r.got != rule(r.s)]
    assert wrong == []


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, s STRING")
    return [r.got for r in df.select("i", function(F.col("s")).alias("got")).orderBy("i").collect()]


def test_extract_code_cases(spark):
    cases = {
        None: None,
        "": None,
        "cube(1);": "cube(1);",
        "a\n```openscad\ncube(1);\n```\nb": "cube(1);",
        "```python\ncube(1);\n```": "cube(1);",
        "```openscad\ncube(1);": "cube(1);",
        "```\nx\n``` ```\ncube(2);\n```": "x",
        "Here is a cube\nsphere(2);": "sphere(2);",
        "$fn = 50;\ncube(1);": "cube(1);",
        "no start here": "no start here",
        "```\n  \n```": "",
    }
    assert apply(spark, t.extract_code, cases) == list(cases.values())


def test_clean_response_cases(spark):
    h = t.ASSISTANT_HEADER
    cases = {
        "cube(1);": "cube(1);",
        f"a{h}b{h}cube(2);": "cube(2);",
        "system\n\nuser": "system\n\nuser",
        "system\nToday Date: 1\nmy assistant\ncube(3);": "cube(3);",
        "cube(4);<|eot_id|>x": "cube(4);",
        "cube(5);<|reserved_special_token_1|>": "cube(5);",
        "abcdé": "abcdé",
        "abcé": "",
        "a\n\n\nb": "a\n\n\nb",
        "ok\n\t\tab": "ok",
        "ok\nkrvld": "ok",
        "": "",
    }
    assert apply(spark, t.clean_response, cases) == list(cases.values())


def test_short_garbage_class_is_the_same_set():
    signs = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    listed = {c for c in signs if re.fullmatch(t.GARBAGE_RUN, c * 5)}
    short = {c for c in signs if re.fullmatch(t._GARBAGE, c * 5)}
    assert listed == short
    assert {c for c in listed if " " <= c <= "~"} == set("krvldfN")


def test_preview_and_trim(spark):
    assert apply(spark, lambda c: t.preview(c, 3), ["abc", "abcd", None]) == ["abc", "abc...", None]
    assert apply(spark, lambda c: t.preview(c, 2, ""), ["abc"]) == ["ab"]
    assert apply(spark, t.trim_response, [" \x1cx\xa0", " ", "", None]) == ["x", None, None, None]


def test_long_text_stays_whole(spark):
    long = "word " * 400_000 + "\ncube(1);\n" + "é" + "x" * 10
    assert apply(spark, t.extract_code, [long]) == [extract_rule(long)]
    assert apply(spark, t.clean_response, [long]) == [clean_rule(long)]
    many = "assistant\n" * 50_000 + "cube(1);\n" * 50_000 + "éé\n"
    assert apply(spark, t.clean_response, [many]) == [clean_rule(many)]
    assert apply(spark, t.extract_code, [many]) == [extract_rule(many)]
