"""Whole conversions: layouts, modes, names, ledger and the drop folder."""

import csv
import glob
import io
import json
import os

import pytest
from pyspark.sql import functions as F

import flatloom as fl


def document(path):
    """Content of one saved document: a file, or the parts of a folder in order."""
    parts = sorted(glob.glob(f"{path}/part-*")) if os.path.isdir(path) else [path]
    return "".join(open(p, encoding="utf-8", newline="").read() for p in parts)


def documents(out):
    return {n: document(f"{out}/{n}") for n in os.listdir(out) if n[0] not in "._"}


def lines(out):
    return sorted(
        line for p in glob.glob(f"{out}/part-*") for line in open(p, encoding="utf-8").read().splitlines()
    )


CSV = {"one.csv": 'b,a\n"x, y",1\n,2\n', "two.TXT": "h\n", "bad.csv": 'a\n"\n', "no.xml": "<x/>"}


def test_csv_to_json_lines(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    fl.convert(spark, "csvToJSON", folder(CSV), out)
    assert lines(out) == ['{"a":"1","b":"x, y"}', '{"a":"2","b":""}']
    rejects = {r.src_file.rsplit("/", 1)[1]: r.error_msg for r in spark.read.parquet(out + "_rejects").collect()}
    assert rejects == {
        "bad.csv": "Invalid input: CSV contains an unclosed quote.",
        "no.xml": "Invalid input: Selected file type '.xml' is not valid for CSV -> JSON.",
    }


def test_csv_to_json_unusual_names(spark, folder):
    path = folder({"x.csv": ',A,a,"q""\n",A\n1,2,3,4,5\n'})
    assert [r.json for r in fl.csv_to_json(spark, path).output.collect()] == [
        '{"":"1","A":"5","a":"3","q\\"":"4"}'
    ]


def test_csv_to_json_arrays(spark, folder, tmp_path):
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    fl.convert(spark, "csvToJSON", folder(CSV), out, layout="array", ledger=ledger)
    got = documents(out)
    assert {n: json.loads(t) for n, t in got.items()} == {
        "one_converted.json": [{"a": "1", "b": "x, y"}, {"a": "2", "b": ""}],
        "two_converted.json": [],
    }
    assert got["one_converted.json"].startswith('[\n  {\n    "a" : "1",\n    "b" : "x, y"\n  }\n,')
    runs = {(r.src_file.rsplit("/", 1)[1], r.status) for r in spark.read.parquet(ledger).collect()}
    assert runs == {("one.csv", "success"), ("two.TXT", "success"), ("bad.csv", "failed"), ("no.xml", "failed")}
    counts = fl.usage_counts(spark.read.parquet(ledger), fl.catalogue(spark)).collect()
    assert {r.action: r.n for r in counts} == {"csvToJSON": 2, "jsonToCSV": 0, "formatJSONByLine": 0}


def test_strict_mode_writes_nothing(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(fl.InvalidInput, match="unclosed quote|not valid for"):
        fl.convert(spark, "csvToJSON", folder(CSV), out, mode="strict")
    assert not os.path.exists(out)
    good = folder({"one.csv": CSV["one.csv"]}, "good")
    fl.convert(spark, "csvToJSON", good, out, mode="strict")
    assert len(lines(out)) == 2
    assert not os.path.exists(out + "_rejects")


def test_strict_raises_exactly_when_there_are_rejects(spark, folder):
    cases = {'[{"a":1}]': False, '[{"a":{}}]': True, "{": True, "[]": False}
    for i, (text, rejected) in enumerate(cases.items()):
        planned = fl.convert(spark, "formatJSONByLine", folder({"x.json": text}, f"in{i}"))
        assert (planned.rejects.count() > 0) == rejected
        if rejected:
            with pytest.raises(fl.InvalidInput):
                planned.check()
        else:
            planned.check()


JSON = {
    "one.json": '[{"b":1.50,"a":"x,\\ny"},{"b":null},{"A":true}]',
    "two.json": '{"q":"say \\"hi\\" {"}',
    "none.json": "[]",
    "mixed.json": '[7,{"z":[]},{"k":"v"}]',
}


def test_json_to_csv_per_file(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    planned = fl.convert(spark, "jsonToCSV", folder(JSON), out, layout="per_file")
    assert documents(out) == {
        "one_converted.csv": 'A,a,b\n,"x,\ny",1.50\n,,\ntrue,,\n',
        "two_converted.csv": 'q\n"say ""hi"" {"\n',
        "mixed_converted.csv": "k\nv\n",
    }
    rejects = {(r.src_file.rsplit("/", 1)[1], r.rec_no, r.error_msg) for r in planned.rejects.collect()}
    assert rejects == {
        ("none.json", None, "Invalid input: JSON has no records to convert."),
        ("mixed.json", 1, "Invalid input: Array item 1 is not a JSON object."),
        ("mixed.json", 2, "Invalid input: Only flat JSON is supported. Field 'z' contains a nested value."),
    }


def test_json_to_csv_dataset(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    fl.convert(spark, "jsonToCSV", folder(JSON), out)
    rows = []
    for part in glob.glob(f"{out}/part-*.csv"):
        rows += list(csv.DictReader(io.StringIO(open(part, encoding="utf-8", newline="").read())))
    assert list(rows[0]) == ["A", "a", "b", "k", "q"]
    kept = sorted(tuple(v for v in r.values() if v) for r in rows)
    assert kept == [(), ('say "hi" {',), ("true",), ("v",), ("x,\ny", "1.50")]


def test_format_json_documents(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    fl.convert(spark, "formatJSONByLine", folder(JSON), out, layout="array")
    got = {n: json.loads(t) for n, t in documents(out).items()}
    assert got == {
        "one_line_formatted.json": [{"b": 1.5, "a": "x,\ny"}, {"b": None}, {"A": True}],
        "two_line_formatted.json": {"q": 'say "hi" {'},
        "none_line_formatted.json": [],
        "mixed_line_formatted.json": [{"k": "v"}],
    }


def test_format_json_lines_input(spark, folder):
    path = folder({"l.json": '{"b":1,"a":2}\n{"x":"y"}\n'})
    plain = fl.format_json(spark, path, lines=True)
    assert sorted(r.json for r in plain.output.collect()) == ['{"a":2,"b":1}', '{"x":"y"}']
    assert fl.format_json(spark, path).rejects.count() == 1


def test_same_name_in_two_folders(spark, folder, tmp_path):
    paths = [folder({"x.csv": f"a\n{i}\n"}, f"in{i}") for i in range(2)]
    out = str(tmp_path / "out")
    fl.convert(spark, "csvToJSON", paths, out, layout="array")
    got = documents(out)
    assert len(got) == 2 and all(n.startswith("x-") and n.endswith("_converted.json") for n in got)
    assert sorted(json.loads(t)[0]["a"] for t in got.values()) == ["0", "1"]


def test_only_unsuitable_files(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    planned = fl.convert(spark, "jsonToCSV", folder({"x.csv": "a\n"}), out)
    assert planned.output.count() == 0 and planned.rejects.count() == 1
    assert documents(out) == {}


def test_unknown_action_and_mode(spark, folder):
    with pytest.raises(fl.InvalidInput):
        fl.convert(spark, "csvToXML", folder({"x.csv": "a\n"}))
    with pytest.raises(fl.InvalidInput):
        fl.convert(spark, "csvToJSON", folder({"x.csv": "a\n"}), mode="lenient")


def test_chunks_of_a_large_document(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr("flatloom.sinks.documents.CHUNK_ROWS", 10)
    out = str(tmp_path / "out")
    path = folder({"x.csv": "n\n" + "".join(f"{i}\n" for i in range(35))})
    fl.convert(spark, "csvToJSON", path, out, layout="array")
    assert len(glob.glob(f"{out}/x_converted.json/part-*")) == 4
    assert [int(r["n"]) for r in json.loads(documents(out)["x_converted.json"])] == list(range(35))


def test_drop_folder_converts_each_file_once(spark, folder, tmp_path):
    out, checkpoint, ledger = (str(tmp_path / n) for n in ("out", "checkpoint", "ledger"))
    run = dict(dst=out, checkpoint=checkpoint, ledger=ledger)
    inbox = folder({"a.csv": "k\n1\n2\n"})
    fl.drop_folder(spark, "csvToJSON", inbox, **run).awaitTermination()
    assert spark.read.text(f"{out}/batch=*[0-9]").count() == 2
    folder({"b.csv": "k\n3\n", "c.csv": '"'})
    fl.drop_folder(spark, "csvToJSON", inbox, **run).awaitTermination()
    fl.drop_folder(spark, "csvToJSON", inbox, **run).awaitTermination()
    values = sorted(r.value for r in spark.read.text(f"{out}/batch=*[0-9]").collect())
    assert values == ['{"k":"1"}', '{"k":"2"}', '{"k":"3"}']
    counts = fl.usage_counts(spark.read.parquet(ledger), fl.catalogue(spark)).collect()
    assert {r.action: r.n for r in counts}["csvToJSON"] == 2
    assert spark.read.parquet(f"{out}/batch=1_rejects").count() == 1


def test_drop_folder_converts_replaced_files_once_more(spark, folder, tmp_path, monkeypatch):
    out, checkpoint, ledger = (str(tmp_path / n) for n in ("out", "checkpoint", "ledger"))
    inbox = folder({"a.csv": "k\n1\n", "b.csv": "k\n2\n", "c.csv": "k\n3\n"})

    def run():
        fl.drop_folder(spark, "csvToJSON", inbox, out, checkpoint, ledger=ledger).awaitTermination()
        return sorted(r.value for r in spark.read.text(f"{out}/batch=*[0-9]").collect())

    first = ['{"k":"1"}', '{"k":"2"}', '{"k":"3"}']
    assert run() == first
    folder({"a.csv": "k\n10\n"})
    stamp = os.stat(f"{inbox}/b.csv")
    os.utime(f"{inbox}/c.csv", (stamp.st_atime + 60, stamp.st_mtime + 60))

    # A repetition that breaks off before its files are noted is done again in its place.
    def broken(*args, **more):
        fl.convert(*args, **more)
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr("flatloom.streaming.drop_folder.convert", broken)
        with pytest.raises(KeyboardInterrupt):
            run()
    for _ in range(2):
        assert run() == sorted([*first, '{"k":"10"}', '{"k":"3"}'])
    folder({"a.csv": "k\n1\n", "d.csv": "k\n4\n"})
    assert run() == run() == sorted([*first, '{"k":"10"}', '{"k":"3"}', '{"k":"1"}', '{"k":"4"}'])
    counts = fl.usage_counts(spark.read.parquet(ledger), fl.catalogue(spark)).collect()
    assert {r.action: r.n for r in counts}["csvToJSON"] == 7


def test_a_run_done_again_counts_once(spark, folder, tmp_path):
    path, ledger = folder({"a.csv": "k\n1\n", "b.csv": "k\n2\n"}), str(tmp_path / "ledger")

    def usage():
        return {r.action: r.n for r in fl.usage_counts(spark.read.parquet(ledger), fl.catalogue(spark)).collect()}["csvToJSON"]

    for run_id, n in (("x", 2), ("x", 2), ("y", 4), (None, 6), (None, 8)):
        fl.convert(spark, "csvToJSON", path, str(tmp_path / "out"), ledger=ledger, run_id=run_id)
        assert usage() == n
    old = spark.read.parquet(ledger).withColumn("run", F.lit(None).cast("string"))
    assert {r.n for r in fl.usage_counts(old, fl.catalogue(spark)).collect()} == {10, 0}


@pytest.mark.parametrize("content", ["[]", "{", "[{}]", "{}"])
@pytest.mark.parametrize("layout", ["dataset", "per_file"])
def test_nothing_to_convert(spark, folder, tmp_path, content, layout):
    out = str(tmp_path / "out")
    fl.convert(spark, "jsonToCSV", folder({"x.json": content}), out, layout=layout)
    message = "JSON is malformed." if content == "{" else "JSON has no records to convert."
    assert [r.error_msg for r in spark.read.parquet(out + "_rejects").collect()] == [f"Invalid input: {message}"]
    if layout == "dataset":
        assert spark.read.text(out).collect() == []


def test_empty_objects_as_json_lines(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    fl.convert(spark, "jsonToCSV", folder({"x.json": "{}\n{}\n"}), out, lines=True)
    assert [r.error_msg for r in spark.read.parquet(out + "_rejects").collect()] == ["Invalid input: JSON has no records to convert."]


def test_wide_tables_are_text(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    items = ",".join(f'{{"k{i:03d}":"v, {i}","all":{i}.50}}' for i in range(30))
    path = folder({"x.json": f"[{items}]"})
    fl.convert(spark, "jsonToCSV", path, out, max_columns=8)
    wide = list(csv.reader(io.StringIO(document(out))))
    fl.convert(spark, "jsonToCSV", path, out, max_columns=1000)
    narrow = list(csv.reader(io.StringIO("".join(lines_of(out)))))
    assert wide[0] == narrow[0] == ["all", *(f"k{i:03d}" for i in range(30))]
    assert sorted(wide[1:]) == sorted(r for r in narrow[1:] if r != narrow[0])


def lines_of(out):
    return [open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(f"{out}/part-*"))]


def test_literals_and_long_values(spark, folder, tmp_path):
    long, digits = "x" * 21_000_000, "7" * 1100
    path = folder(
        {
            "mixed.json": '[7,{"k":1.50,"e":1e3},{"n":{}},"{",[1],{"k":2.50}]',
            "long.json": f'[{{"k":"{long}"}},{{"k":"y"}}]',
            "digits.json": f'[{{"k":{digits}}},{{"k":1}}]',
            "deep.json": '[{"k":' + "[" * 400 + "]" * 400 + '},{"k":2}]',
        }
    )
    planned = fl.json_to_csv(spark, path)
    found = sorted(((r["e"], r["k"]) for r in planned.output.collect()), key=lambda t: (len(t[1]), t))
    assert found == [("", "1"), ("", "2"), ("", "y"), ("", "2.50"), ("1e3", "1.50"), ("", digits), ("", long)]
    messages = sorted((r.src_file.rsplit("/", 1)[1], r.rec_no) for r in planned.rejects.collect())
    assert messages == [("deep.json", 1), ("mixed.json", 1), ("mixed.json", 3), ("mixed.json", 4), ("mixed.json", 5)]
    formatted = {r.json for r in fl.format_json(spark, folder({"d.json": f'{{"b":{digits},"a":1}}'}, "one")).output.collect()}
    assert formatted == {f'{{"a":1,"b":{digits}}}'}


def test_drop_folder_goes_on_after_bad_files(spark, folder, tmp_path):
    out, checkpoint, ledger = (str(tmp_path / n) for n in ("out", "checkpoint", "ledger"))
    run = dict(dst=out, checkpoint=checkpoint, ledger=ledger)
    inbox = folder({"bad.json": "{"})
    fl.drop_folder(spark, "jsonToCSV", inbox, **run).awaitTermination()
    folder({"good.json": '{"k":1}', "part.json": '[{"k":1},{"k":[]}]'})
    fl.drop_folder(spark, "jsonToCSV", inbox, **run).awaitTermination()
    assert [r.value for r in spark.read.text(f"{out}/batch=1").collect()].count("1") == 2
    status = {r.src_file.rsplit("/", 1)[1]: r.status for r in spark.read.parquet(ledger).collect()}
    assert status == {"bad.json": "failed", "good.json": "success", "part.json": "failed"}


def test_strict_failures_are_in_the_ledger(spark, folder, tmp_path):
    ledger = str(tmp_path / "ledger")
    with pytest.raises(fl.InvalidInput):
        fl.convert(spark, "csvToJSON", folder({"a.csv": "k\n1\n", "b.csv": '"'}), str(tmp_path / "out"), mode="strict", ledger=ledger)
    assert {r.status for r in spark.read.parquet(ledger).collect()} == {"failed"}
    assert not os.path.exists(tmp_path / "out")


def test_release(spark, folder, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    monkeypatch.setattr("flatloom.session.shared_folder", lambda _: str(shared))
    fl.convert(spark, "csvToJSON", folder({"x.csv": "a\n1\n"}), str(tmp_path / "out"))
    assert list(shared.glob("flatloom/*/csv-files-*"))
    fl.release(spark)
    assert not list(shared.glob("flatloom/*"))


def hash_keys_of_text_exchanges(plan):
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(src_file" in line and "split" not in line and "rec_no" not in line]


def test_no_text_is_shuffled_by_file(spark, folder, small_splits):
    """Small tables are broadcast by their measured size, whatever Spark would choose."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = "".join(f'{i},"a\nb{i}"\n' for i in range(600))
        path = folder({"x.csv": "k,t\n" + rows, "y.csv": "t,k\n" + rows})
        scan = fl.scan_csv(spark, path)
        scan.records.collect()
        plan = scan.records._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in hash_keys_of_text_exchanges(plan) if "text" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
