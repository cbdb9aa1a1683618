"""Column functions for prompts, object names, file names and run ids.

The assistant's and the generator's names are parameters of the deployment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text sent to the generating model, and the evaluation set.
GENERATION_TEMPLATE = """You are an expert OpenSCAD programmer. Generate valid OpenSCAD code to create a 3D model of: {name}

Requirements:
- Use only standard OpenSCAD primitives and operations
- Code must be syntactically correct and compilable
- Include appropriate transformations and positioning
- Add comments explaining the design
- Make it visually recognizable as a {name}

Generate ONLY the OpenSCAD code, no explanations:"""
INSTRUCTION = "hey {assistant}, {verb} me a "
ARTIFACT_SUFFIX = ".scad"

ASSISTANT = "assistant"

# A run of cased letters, or of anything else: the units that title case works on.
_CASE_RUNS = r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"


def generation_prompt(c_name: Column) -> Column:
    """The generation template with the name filled in."""
    return F.replace(F.lit(GENERATION_TEMPLATE), F.lit("{name}"), c_name)


def _prefix(verb: str, assistant: str) -> Column:
    return F.lit(INSTRUCTION.format(assistant=assistant, verb=verb))


def instruction(c_name: Column, verb: str = "create", assistant: str = ASSISTANT) -> Column:
    """What the user says to ask for an object."""
    return F.concat(_prefix(verb, assistant), c_name)


def object_name(c_prompt: Column, verb: str = "create", assistant: str = ASSISTANT) -> Column:
    """The object of an instruction, with underscores for spaces."""
    bare = F.replace(c_prompt, _prefix(verb, assistant), F.lit(""))
    return F.replace(bare, F.lit(" "), F.lit("_"))


def display_title(c: Column) -> Column:
    """Title case with spaces for underscores; letters after digits and marks are raised too."""
    runs = F.regexp_extract_all(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(_CASE_RUNS), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def artifact_name(c_ordinal: Column, c_object: Column, suffix: str = ARTIFACT_SUFFIX) -> Column:
    """File name of an evaluation output: two-digit number and object."""
    return F.format_string(f"%02d_%s{suffix}", c_ordinal, c_object)


def is_artifact(c_path: Column) -> Column:
    return F.endswith(c_path, F.lit(ARTIFACT_SUFFIX))


def run_id(c_ts: Column, c_job: Column) -> Column:
    """Folder name of an evaluation run; the six digits come from the job id, so replays agree."""
    digits = F.conv(F.substring(F.md5(c_job), 1, 8), 16, 10).cast("bigint") % 900000 + 100000
    return F.concat_ws("_", F.lit("eval"), F.date_format(c_ts, "yyyyMMdd_HHmmss"), digits)
