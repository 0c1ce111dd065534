"""Run ledger: one row per file and run; usage counts are computed from it.

Runs have ids, their own or given ones. A run done again under its id adds rows again, which count once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUCCESS, FAILED, CANCELLED = "success", "failed", "cancelled"


def _record(path: str, action: str, rows: DataFrame, mode: str, run: str | None) -> None:
    rows.select(
        F.lit(action).alias("action"),
        "src_file",
        "status",
        F.current_timestamp().alias("at"),
        F.lit(run or uuid.uuid4().hex).alias("run"),
    ).write.mode(mode).parquet(path)


def _with_status(files: DataFrame, status: str) -> DataFrame:
    return files.select("src_file", F.lit(status).alias("status"))


def record_runs(
    path: str, action: str, files: DataFrame, rejects: DataFrame, mode: str = "append", run: str | None = None
) -> None:
    """Write the outcome of one run: success for each file written whole.

    A file with any reject has failed: a conversion that stops at the first fault would not
    have counted it.
    """
    lost = rejects.select("src_file").distinct()
    whole = files.join(lost, "src_file", "left_anti")
    _record(path, action, _with_status(whole, SUCCESS).unionByName(_with_status(lost, FAILED)), mode, run)


def record_failure(
    path: str, action: str, files: DataFrame, rejects: DataFrame, mode: str = "append", run: str | None = None
) -> None:
    """A run that wrote nothing: every file has failed."""
    every = files.select("src_file").unionByName(rejects.select("src_file")).distinct()
    _record(path, action, _with_status(every, FAILED), mode, run)


def record_cancelled(path: str, action: str, files: DataFrame, mode: str = "append", run: str | None = None) -> None:
    """A run the user gave up: a status of its own, no failure and no success."""
    _record(path, action, _with_status(files.select("src_file").distinct(), CANCELLED), mode, run)


def usage_counts(ledger: DataFrame, actions: DataFrame) -> DataFrame:
    """Successful runs per action: ``action, n``; 0 for an action never used.

    A file counts once a run, however often the run was done. Counts are summed map-side, so the
    join sees at most one row per action.
    """
    done = ledger.filter(F.col("status") == SUCCESS)
    if "run" in ledger.columns:
        own = done.filter("run is null").select("action")
        done = done.filter("run is not null").select("action", "run", "src_file").distinct()
        done = done.select("action").unionByName(own)
    counts = done.groupBy("action").agg(F.count("*").alias("n"))
    return actions.select("action").join(counts, "action", "left").select(
        "action", F.coalesce("n", F.lit(0)).alias("n")
    )
