"""The three conversions a user can ask for, and the rules on file names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors
from ..functions.text import base_name, file_extension


@dataclass(frozen=True)
class Action:
    name: str
    label: str
    allowed: tuple[str, ...]
    out_ext: str
    suffix: str


# Fixed values.
CSV_TO_JSON = Action("csvToJSON", "CSV -> JSON", ("csv", "txt"), "json", "_converted.json")
JSON_TO_CSV = Action("jsonToCSV", "JSON -> CSV", ("json", "txt"), "csv", "_converted.csv")
FORMAT_JSON = Action(
    "formatJSONByLine", "Format JSON", ("json", "txt"), "json", "_line_formatted.json"
)
ACTIONS = {a.name: a for a in (CSV_TO_JSON, JSON_TO_CSV, FORMAT_JSON)}


def action_of(name: str | Action) -> Action:
    if isinstance(name, Action):
        return name
    if name not in ACTIONS:
        raise errors.InvalidInput(f"Unknown action '{name}'; choose from {', '.join(ACTIONS)}.")
    return ACTIONS[name]


def catalogue(spark: SparkSession) -> DataFrame:
    """action, label, allowed, out_ext, suffix: three rows, a constant in every plan."""
    rows = [(a.name, a.label, list(a.allowed), a.out_ext, a.suffix) for a in ACTIONS.values()]
    return spark.createDataFrame(
        rows, "action string, label string, allowed array<string>, out_ext string, suffix string"
    )


def action_structs() -> Column:
    """The catalogue as a constant array, to pair rows with actions without a join."""
    return F.array(
        *[
            F.struct(
                F.lit(a.name).alias("action"),
                F.lit(a.label).alias("label"),
                F.array(*map(F.lit, a.allowed)).alias("allowed"),
                F.lit(a.out_ext).alias("out_ext"),
                F.lit(a.suffix).alias("suffix"),
            )
            for a in ACTIONS.values()
        ]
    )


def extension_error(path: Column, label: Column, allowed: Column) -> Column:
    """Error text when the file's extension does not suit the action, else null."""
    extension = file_extension(path)
    return F.when(
        ~F.array_contains(allowed, extension),
        errors.message(errors.wrong_extension(extension, label)),
    )


def output_name(path: Column, suffix: Column) -> Column:
    return F.concat(base_name(path), suffix)
