"""Throughput of the scans and conversions, beyond the headline queries.

Warm runs, median of three, on inputs staged from the tables at BENCH_SF_DIR.
Prints one JSON line per measurement.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import flatloom as fl
from flatloom.queries.stage import as_text, stage_arrays
from flatloom.session import scratch_path
from flatloom.sinks.documents import write_csv


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def median_seconds(job) -> float:
    times = []
    for _ in range(4):
        start = time.perf_counter()
        job()
        times.append(time.perf_counter() - start)
    return statistics.median(times[1:])


def size_mb(spark: SparkSession, path: str) -> float:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.sum("length")).first()[0] / 1e6


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("measure")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED") or tempfile.mkdtemp(prefix="measure-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def report(name: str, path: str, rows: int, job) -> None:
        if only and not any(name.startswith(o) for o in only):
            return
        seconds, mb = median_seconds(job), size_mb(spark, path)
        print(
            json.dumps(
                {
                    "name": name,
                    "cpus": cpus,
                    "seconds": round(seconds, 2),
                    "mb": round(mb, 1),
                    "mb_per_s": round(mb / seconds, 1),
                    "rows_per_s": round(rows / seconds),
                }
            ),
            flush=True,
        )

    for name in ("lineitem", "documents"):
        table = as_text(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        rows = table.count()
        schema = ", ".join(f"_c{i} string" for i in range(len(table.columns)))
        for n in (1, 16):
            path = scratch_path(spark, f"{name}-csv-{n}")
            write_csv(table.repartition(n), path)
            for multi in (False, True):
                reader = spark.read.options(quote='"', escape='"', maxCharsPerColumn="-1")
                reader = reader.option("multiLine", multi)
                report(
                    f"plain_csv_read_{name}_{n}_files_multiline_{multi}", path, rows,
                    lambda r=reader, p=path: run(r.csv(p, schema=schema, header=True)),
                )
            report(
                f"csv_check_{name}_{n}_files", path, rows,
                lambda p=path: run(fl.scan_csv(spark, p).files),
            )
            report(
                f"csv_to_json_{name}_{n}_files", path, rows,
                lambda p=path: run(fl.csv_to_json(spark, p).output),
            )
            report(
                f"csv_to_json_stitched_{name}_{n}_files", path, rows,
                lambda p=path: run(fl.scan_csv(spark, p).records),
            )

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    both = orders.unionByName(customer, allowMissingColumns=True)
    rows = both.count()
    lines = scratch_path(spark, "orders-customer-lines")
    both.repartition(16).write.json(lines)
    item = F.to_json(F.struct(*orders.columns))
    sixteenth = (F.col("o_orderkey") % 16).cast("string")
    arrays = stage_arrays(orders, "o_orderkey", item, group=sixteenth)
    n_orders = orders.count()
    report("plain_json_read_lines", lines, rows, lambda: run(spark.read.schema(both.schema).json(lines)))
    report("json_to_csv_lines_input", lines, rows, lambda: run(fl.json_to_csv(spark, lines, lines=True).output))
    report("json_check_arrays", arrays, n_orders, lambda: run(fl.scan_json(spark, arrays).files))
    report("json_scan_arrays", arrays, n_orders, lambda: run(fl.scan_json(spark, arrays).records))
    report("json_to_csv_arrays", arrays, n_orders, lambda: run(fl.json_to_csv(spark, arrays).output))
    report("format_json_arrays", arrays, n_orders, lambda: run(fl.format_json(spark, arrays).output))
    spark.stop()


if __name__ == "__main__":
    main()
