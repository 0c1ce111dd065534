"""Convert new and replaced files of a folder incrementally, each version of a file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.errors import InvalidInput
from ..plans.actions import Action
from ..plans.pipelines import convert
from ..session import materialise
from ..sinks.commits import Files
from ..sources.files import paths_of

_BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: What is known of converted files: the version converted, and by which repetition (-1: the stream).
_STATE = "src_file string, modified timestamp, size bigint, again int"


def _versions(files: DataFrame) -> DataFrame:
    """Names and versions of files; their content is not read."""
    return files.select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_size").alias("size"),
    )


def replaced_files(spark: SparkSession, inbox: str, state: str) -> tuple[DataFrame, int]:
    """Files whose time or size is not that of the version converted last, and the number of the
    repetition that is to convert them."""
    if not Files(spark, state).exists(state):
        return spark.createDataFrame([], "src_file string, modified timestamp, size bigint"), 0
    known = spark.read.schema(_STATE).option("recursiveFileLookup", "true").parquet(state)
    version = F.struct("modified", "size")
    last = known.groupBy("src_file").agg(F.max_by(version, "again").alias("last"))
    now = _versions(spark.read.format("binaryFile").load(inbox))
    found = now.join(last, "src_file").filter(version != F.col("last")).drop("last")
    return found, known.agg(F.max("again")).first()[0] + 1


def drop_folder(
    spark: SparkSession,
    action: str | Action,
    inbox: str,
    dst: str,
    checkpoint: str,
    *,
    ledger: str | None = None,
    max_files: int = 1000,
    **options,
) -> StreamingQuery:
    """Convert the files that arrived or were replaced in ``inbox`` since the last run, then stop.

    The stream carries file names only; the content is read by the same plans as
    in a batch conversion. A batch that is run again after a failure overwrites
    its own output folder ``dst/batch=<id>`` and ledger part, so no file is
    converted or counted twice. Rejects go to ``dst/batch=<id>_rejects``. With
    ``mode='strict'`` a batch with any reject is not converted; its files are in the
    ledger as failed, and the stream goes on.

    The stream knows a file by its name. What was converted is kept with time and size in
    ``checkpoint/converted``; files that differ from it are converted again first, as
    ``dst/batch=again-<n>``. The output of the older version stays.
    """
    state = f"{checkpoint}/converted"

    def convert_files(files: DataFrame, run: str, again: int) -> None:
        files = materialise(files, "dropped-files")
        paths = paths_of(files)
        if not paths:
            return
        part = None if ledger is None else f"{ledger}/batch={run}"
        try:
            convert(
                files.sparkSession,
                action,
                paths,
                f"{dst}/batch={run}",
                ledger=part,
                ledger_mode="overwrite",
                **options,
            )
        except InvalidInput:
            if options.get("mode") != "strict":
                raise
        # Last, so that a run that broke off is done again, under the same name.
        files.withColumn("again", F.lit(again)).write.mode("overwrite").parquet(f"{state}/run={run}")

    while True:
        replaced, n = replaced_files(spark, inbox, state)
        some = materialise(replaced.limit(max_files), "replaced-files")
        if some.isEmpty():
            break
        convert_files(some, f"again-{n}", n)

    arrived = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_FILE)
        .option("maxFilesPerTrigger", max_files)
        .load(inbox)
    )
    return (
        _versions(arrived)
        .writeStream.foreachBatch(lambda batch, i: convert_files(batch, str(i), -1))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
