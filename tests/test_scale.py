"""Work and figures that must not grow faster than the input."""

import json

import pytest
from pyspark.sql import functions as F

from flatloom.plans.pipelines import json_to_csv
from flatloom.queries.stage import small_splits
from flatloom.session import PAGE_CHECK, small_pages
from flatloom.sources import csv_files
from flatloom.sources.json_files import scan_json


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_splits_share_tasks(spark, folder):
    path = folder({"a.txt": "line of a file\n" * 4000})
    with small_splits(spark, "1k", tasks=8):
        lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("at"), "value")
        assert lines.select("at").distinct().count() > 50
        assert lines.rdd.getNumPartitions() <= 16
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None


def test_wide_lines(spark, folder):
    """Lines of a wide table: no list of all keys meets a record; order, repeats and empty records are kept."""
    records = [{"b": "x,y"}, {}, {"é": None, "a": 'q"'}, {"z": 1.50, "a": ""}]
    texts = [json.dumps(r) for r in records] + ['{"a":"old","b":2,"a":"new"}']
    path = folder({"t.json": "[" + ",".join(texts) + "]"})
    output = json_to_csv(spark, path, max_columns=2).output
    assert [r.line for r in output.collect()] == [',"x,y",,', ",,,", '"q""",,,', ",,1.5,", "new,2,,"]
    assert "Join Cross" not in plan_of(output)


def test_wide_lines_are_written_in_small_pages(spark, folder, tmp_path):
    """Pages of lines end at their size of 1 MiB, not after 100 lines: a writer holds few of them."""
    n, rows = 30_000, 250
    wide = "{" + ",".join(f'"k{i:05d}":"a, {i}"' for i in range(0, n, 100)) + "}"
    items = [f'{{"k{i:05d}":{i}}}' for i in range(n)]
    records = [wide, *items[:rows]]
    path = folder({"t.json": f"[{','.join(records)}]", "u.json": "[{" + ",".join(i[1:-1] for i in items) + "}]"})
    output = json_to_csv(spark, path, max_columns=2).output
    out = str(tmp_path / "out")
    output.coalesce(1).write.parquet(out)

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.parquet.hadoop
    (part,) = (tmp_path / "out").glob("part-*")
    reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(part)), conf))
    try:
        (block,) = reader.getFooter().getBlocks()
        pages = reader.readOffsetIndex(block.getColumns()[0])
        firsts = [pages.getFirstRowIndex(i) for i in range(pages.getPageCount())] + [block.getRowCount()]
    finally:
        reader.close()
    lines = [r.line for r in spark.read.parquet(out).collect()]
    assert len(lines) == firsts[-1] == rows + 2
    sizes = [sum(map(len, lines[a:b])) for a, b in zip(firsts, firsts[1:], strict=False)]
    assert max(sizes) <= (1 << 20) + max(map(len, lines))
    assert [line.count(",") - line.count(", ") for line in lines] == [n - 1] * len(lines)
    assert [line.strip(",") for line in lines[1:-1]] == [str(i) for i in range(rows)]
    assert lines[0].startswith('"a, 0"' + "," * 100 + '"a, 100"') and lines[0].endswith(f'"a, {n - 100}"' + "," * 99)
    assert lines[-1] == ",".join(map(str, range(n)))


def test_page_check_of_the_session_is_kept(spark):
    before = spark.conf.get(PAGE_CHECK, None)
    try:
        spark.conf.set(PAGE_CHECK, "7")
        small_pages(spark)
        assert spark.conf.get(PAGE_CHECK) == "7"
    finally:
        spark.conf.unset(PAGE_CHECK) if before is None else spark.conf.set(PAGE_CHECK, before)


def test_items_are_parsed_once(spark, folder):
    """Records between other items come from what was found out with their element."""
    path = folder({"t.json": '[7,"{",[1.50],{"a":1.50},null,{"b":{"c":1}},{}]'})
    scan = scan_json(spark, path, numbered=True)
    assert [(r.rec_no, r.text) for r in scan.records.orderBy("rec_no").collect()] == [(4, '{"a":1.50}'), (7, "{}")]
    assert sorted(r.rec_no for r in scan.rejects.collect()) == [1, 2, 3, 5, 6]
    assert "from_json" not in plan_of(scan.records)


@pytest.mark.parametrize("plain", [False, True])
def test_stitching_takes_the_runs_of_the_check(spark, folder, tiny_splits, monkeypatch, plain):
    given = []
    stitch = csv_files.stitch_lines
    monkeypatch.setattr(csv_files, "stitch_lines", lambda lines, largest, runs=None: given.append(runs) or stitch(lines, largest, runs))
    files = {"a.csv": "a,b\n" + '"x\n""y",z"\n' * 50}
    if plain:
        files["b.csv"] = "a,b\n1,2\n"
    found = csv_files.scan_csv(spark, folder(files)).records.select("rec").collect()
    assert sum(r.rec == {"a": 'x\n"y', "b": 'z"'} for r in found) == 50
    assert len(found) == 50 + plain
    assert [runs is None for runs in given] == [plain]
