"""Evaluation reports: the markdown template for reviewers, and reading it back filled in.

A report is kept as sections, one row each: the head, one per output, the
guide. A run may hold any number of outputs, so a report is never gathered into
one value; its files list the sections in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partforge.functions.numbers import one_decimal
from partforge.functions.prompts import display_title
from partforge.operators.stats import render_rate
from partforge.sources.artifacts import STAMP, file_path

# The text of a report.
HEAD = """# {title} Evaluation Report

**Generated at:** {stamp}
**Total prompts:** {total}

---

## Rendering Statistics

- **Rendering Rate:** {rate}% ({rendered}/{total} models rendered successfully)
- **Resemblance Rate:** __% (fill in after manual review)

---

## Model Outputs

"""
SECTION = """### {ordinal}. {name}

- **File:** `{file}`
{outcome}
- **Quality:** __ / 5 (fill in after review)
- **Resemblance:** __ / 5 (fill in after review)
- **Notes:** _[Add your observations here]_

---

"""
RENDERED = """- **Preview:** ![{object}]({image})
- **Rendered:** ✅ Success"""
NOT_RENDERED = """- **Rendered:** ❌ Failed
- **Error:** `{error}`"""
GUIDE = """
## Review Guide

### Quality Rating (1-5)
- **5:** Perfect, production-ready code
- **4:** Good, minor improvements needed
- **3:** Acceptable, some issues present
- **2:** Poor, major issues
- **1:** Broken or unusable

### Resemblance Rating (1-5)
- **5:** Perfectly matches the prompt
- **4:** Good representation
- **3:** Recognizable but simplified
- **2:** Loosely related
- **1:** Doesn't match prompt

### Overall Scoring
- Calculate average quality and resemblance scores
- Update the "Resemblance Rate" at the top with the average resemblance score as a percentage (avg/5 * 100)
"""

_SECTION_MARK = "### "


def _fill(template: str, **values):
    """A template with columns put in; the fields are those of str.format."""
    parts, rest = [], template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        field, rest = rest.split("}", 1)
        parts += [F.lit(text), values[field].cast("string")]
    return F.concat(*parts, F.lit(rest))


def report(results: DataFrame, generated_at, title: str = "Model") -> DataFrame:
    """Report sections `(run, section, text)` of `(run, ordinal, object, file_name, rendered, image, error)`.

    `section` is 0 for the head, the ordinal for an output, and the last number
    of all for the guide.
    """
    stamp = F.date_format(generated_at, STAMP)
    rates = render_rate(results, ["run"])
    head = rates.select(
        "run",
        F.lit(0).cast("bigint").alias("section"),
        _fill(
            HEAD,
            title=F.lit(title),
            stamp=stamp,
            total=F.col("total"),
            rate=one_decimal(F.col("rate")),
            rendered=F.col("rendered"),
        ).alias("text"),
    )
    outcome = F.when(
        F.col("rendered"), _fill(RENDERED, object=F.col("object"), image=F.col("image"))
    ).otherwise(_fill(NOT_RENDERED, error=F.coalesce("error", F.lit("None"))))
    outputs = results.select(
        "run",
        F.col("ordinal").cast("bigint").alias("section"),
        _fill(
            SECTION,
            ordinal=F.col("ordinal"),
            name=display_title(F.col("object")),
            file=F.col("file_name"),
            outcome=outcome,
        ).alias("text"),
    )
    guide = rates.select(
        "run", F.lit((1 << 63) - 1).alias("section"), F.lit(GUIDE).alias("text")
    )
    return head.unionByName(outputs).unionByName(guide)


def write_report(sections: DataFrame, path: str) -> None:
    """Sections as text files, one folder per run; its files in name order make the report."""
    (
        sections.repartitionByRange("run", "section")
        .sortWithinPartitions("run", "section")
        # The writer ends each section with the line feed taken off here.
        .select("run", F.regexp_replace("text", r"\n\z", "").alias("text"))
        .write.mode("overwrite")
        .partitionBy("run")
        .text(path)
    )


def read_reviews(spark: SparkSession, *paths: str) -> DataFrame:
    """`(run, ordinal, quality, resemblance, notes)` of report files; blanks left by the reviewer are NULL.

    The section mark serves as the record separator, so a long report is split
    among tasks as any text file is.
    """
    records = (
        spark.read.option("lineSep", "\n" + _SECTION_MARK)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{*.md,*.txt}")  # not the outputs that lie beside a report
        .text(list(paths))
    )
    text = F.regexp_replace("value", f"^{_SECTION_MARK}", "")
    folder = F.regexp_extract(file_path(), r"([^/]*)/[^/]*$", 1)
    written = F.replace(F.regexp_replace(folder, "^run=", ""), F.lit("+"), F.lit("%2B"))
    # a partition's folder has its value escaped once more
    run = F.when(folder.startswith("run="), F.coalesce(F.try_url_decode(written), folder)).otherwise(folder)
    parsed = records.select(
        run.alias("run"),
        F.regexp_extract(text, r"\A(\d+)\. ", 1).alias("ordinal"),
        F.regexp_extract(text, r"(?m)^- \*\*Quality:\*\* *([1-5]) */ *5", 1).alias("quality"),
        F.regexp_extract(text, r"(?m)^- \*\*Resemblance:\*\* *([1-5]) */ *5", 1).alias("resemblance"),
        F.regexp_extract(text, r"(?ms)^- \*\*Notes:\*\* (.*?)\s*(?:^---\s*$.*)?\z", 1).alias("notes"),
    )
    blank_note = "_[Add your observations here]_"
    return parsed.filter(F.col("ordinal") != "").select(
        "run",
        F.col("ordinal").cast("int").alias("ordinal"),
        F.expr("try_cast(nullif(quality, '') AS INT)").alias("quality"),
        F.expr("try_cast(nullif(resemblance, '') AS INT)").alias("resemblance"),
        F.nullif(F.nullif("notes", F.lit("")), F.lit(blank_note)).alias("notes"),
    )
