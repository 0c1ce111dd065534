"""Byte fixtures of the CSV rules, for every way a file can be scanned."""

import random

import pytest
from conftest import by_file

from flatloom.functions import errors
from flatloom.sources import csv_files, stitch
from flatloom.sources.csv_files import LINES, STITCH, inspect_csv, scan_csv

FILES = {
    "c01": b"a,b\n1,2\n",
    "c02": b"a,b\n1,2",
    "c03": b'a,b\n"x, y","he said ""hi"""\n',
    "c04": b'a,b\n"l1\nl2",3\n',
    "c05": b'a,b\n"",\nx,\n',
    "c06": b"a,b\n1\n1,2,3\n",
    "c07": b" a ,\tb\n x , y \n",
    "c08": b"id,name,id\n1,x,9\n2\n",
    "c09": b"a,b\n , \n,\n\n1,2\n",
    "c10": b"a,A\n1,2\n",
    "c11": b"a,b\n",
    "c12": b"",
    "c13": b'a,b\n"x,2\n3,4\n',
    "c14": b"a,b\r\n1,2\r\n",
    "c15": b'a,b\nab"cd"e,2\n',
    "c16": b"a\n\xff\n",
    "c17": b"\xef\xbb\xbfa,b\n1,2\n",
    "c18x": b"a,b\n1,2\n",
    "c18y": b"b,a\n3,4\n",
    "c19": b",b\n1,2\n",
    "c20": b'"h\n1",b\n1,"q\nr"\nx,y\n',
    "c21": b'a,b\n,,x\n,," "\n',
    "c22": b"\n\na\n1\n",
    "c23": b'a,b\n"1\n2","3\n4"\n5,"6\n\n7"\n"8",9\n',
    "c24 odd+name%41[x]": b"a\n1\n",
}
RECORDS = {
    "c01": [{"a": "1", "b": "2"}],
    "c02": [{"a": "1", "b": "2"}],
    "c03": [{"a": "x, y", "b": 'he said "hi"'}],
    "c04": [{"a": "l1\nl2", "b": "3"}],
    "c05": [{"a": "x", "b": ""}],
    "c06": [{"a": "1", "b": ""}, {"a": "1", "b": "2"}],
    "c07": [{"a": " x ", "b": " y "}],
    "c08": [{"id": "9", "name": "x"}, {"id": "", "name": ""}],
    "c09": [{"a": "1", "b": "2"}],
    "c10": [{"a": "1", "A": "2"}],
    "c14": [{"a": "1", "b": "2"}],
    "c15": [{"a": 'ab"cd"e', "b": "2"}],
    "c17": [{"a": "1", "b": "2"}],
    "c18x": [{"a": "1", "b": "2"}],
    "c18y": [{"a": "4", "b": "3"}],
    "c19": [{"": "1", "b": "2"}],
    "c20": [{"h\n1": "1", "b": "q\nr"}, {"h\n1": "x", "b": "y"}],
    "c21": [{"a": "", "b": ""}],
    "c22": [{"a": "1"}],
    "c23": [{"a": "1\n2", "b": "3\n4"}, {"a": "5", "b": "6\n\n7"}, {"a": "8", "b": "9"}],
    "c24%20odd+name%2541%5Bx%5D": [{"a": "1"}],
}
REJECTS = {
    "c12": "Invalid input: CSV is empty or missing a header row.",
    "c13": "Invalid input: CSV contains an unclosed quote.",
    "c16": "Invalid input: Input is not valid UTF-8 text.",
}


def check(scan, names=tuple(FILES)):
    got = {}
    for r in scan.records.collect():
        got.setdefault(r.src_file.rsplit("/", 1)[1][:-4], []).append((r.rec_no, r.rec))
    got = {k: [rec for _, rec in sorted(v, key=lambda t: t[0])] for k, v in got.items()}
    assert got == {k: v for k, v in RECORDS.items() if k[:3] in {n[:3] for n in names}}
    rejects = by_file(scan.rejects.collect(), "rec_no", "error_msg")
    assert rejects == {k: [(None, m)] for k, m in REJECTS.items() if k in names}


@pytest.fixture
def fixture_folder(folder):
    return folder({f"{k}.csv": v for k, v in FILES.items()})


def test_routes(spark, fixture_folder):
    verdicts = {r.src_file.rsplit("/", 1)[1][:3]: r for r in inspect_csv(spark, fixture_folder).collect()}
    assert verdicts["c01"].route == LINES
    assert verdicts["c15"].route == LINES
    assert verdicts["c04"].route == STITCH
    assert verdicts["c07"].names == ["a", "b"]
    assert verdicts["c20"].names == ["h\n1", "b"]


def test_fixtures(spark, fixture_folder):
    check(scan_csv(spark, fixture_folder, numbered=True))


def test_fixtures_with_tiny_splits(spark, fixture_folder, tiny_splits):
    check(scan_csv(spark, fixture_folder, numbered=True))


def test_fixtures_as_arrays(spark, fixture_folder, monkeypatch):
    """The form for headers of any width gives the same records."""
    monkeypatch.setattr(csv_files, "NARROW", 0)
    monkeypatch.setattr(csv_files, "COLUMNS", 0)
    check(scan_csv(spark, fixture_folder, numbered=True))


def reader_records(text: str) -> list[list[str]]:
    """Records by the rules for quotes, character by character."""
    rows, row, field, i, begin, n = [], [], "", 0, True, len(text)
    while i < n:
        c = text[i]
        if begin and c == '"':
            begin, j, field = False, i + 1, ""
            while j < n and (text[j] != '"' or text[j + 1 : j + 2] == '"'):
                field, j = field + text[j], j + (2 if text[j] == '"' else 1)
            i = j + 1
            if i < n and text[i] not in ",\n":  # text after the closing quote: all is data
                field = f'"{field}"'
            continue
        begin = False
        if c in ",\n":
            row.append(field)
            field, begin = "", True
            if c == "\n":
                rows.append(row)
                row = []
        else:
            field += c
        i += 1
    return rows


@pytest.mark.parametrize("columns", [2_000, 0])
def test_random_quotes_at_any_split_size(spark, folder, tiny_splits, monkeypatch, columns):
    monkeypatch.setattr(csv_files, "COLUMNS", columns)
    monkeypatch.setattr(csv_files, "NARROW", min(csv_files.NARROW, columns))
    rng, texts = random.Random(11), {}
    for n in range(120):
        body = "".join(rng.choice(['"', '"', ",", "\n", "x", "y", '""', ' "']) for _ in range(rng.randrange(5, 90)))
        texts[f"r{n:03d}"] = "a,b,c\n" + body + "\n"
    scan = scan_csv(spark, folder({f"{k}.csv": v for k, v in texts.items()}), numbered=True)
    got = {}
    for r in scan.records.collect():
        got.setdefault(r.src_file.rsplit("/", 1)[1][:-4], []).append((r.rec_no, [r.rec[c] for c in "abc"]))
    lost = {r.src_file.rsplit("/", 1)[1][:-4] for r in scan.rejects.collect()}
    assert 20 < len(texts) - len(lost)
    for k, v in texts.items():
        if k not in lost:
            rows = [(r + ["", "", ""])[:3] for r in reader_records(v)[1:] if any(f.strip() for f in r)]
            assert [x for _, x in sorted(got.get(k, []))] == rows, v


def test_stitched_across_splits(spark, folder, small_splits):
    wide = "\n".join(f"line {i}, \"\"quoted\"\"" for i in range(150))
    rows = [(str(i), f"a{i}\nb, {i}\n") for i in range(400)] + [("wide", wide.replace('""', '"'))]
    text = "id,note\n" + "".join(f'{i},"{n}"\n' for i, n in rows[:-1]) + f'wide,"{wide}"\nend,x\n'
    scan = scan_csv(spark, folder({"x.csv": text}), numbered=True)
    got = sorted((r.rec_no, r.rec["id"], r.rec["note"]) for r in scan.records.collect())
    assert got == [(n + 1, i, t) for n, (i, t) in enumerate([*rows, ("end", "x")])]
    assert scan.rejects.count() == 0


def test_more_splits_than_ten_bits_count(spark, folder, tiny_splits):
    """The number of a task is part of a line's place, in the check that every route begins with."""
    path = folder({"a.csv": "\nk,v\n" + "".join(f"{i:012},{'x' * 26}\n" for i in range(1150))})
    assert spark.read.text(path).rdd.getNumPartitions() > 1100
    (found,) = csv_files._inspect(spark, path).collect()
    assert (found.error, found.route) == (None, "stitch")


def test_record_numbers_count_kept_rows(spark, folder, small_splits):
    path = folder({"n.csv": "a,b\n" + "".join(f"{i},x\n,\n" for i in range(900))})
    scan = scan_csv(spark, path, numbered=True)
    got = sorted((r.rec_no, r.rec["a"]) for r in scan.records.collect())
    assert got == [(i + 1, str(i)) for i in range(900)]
    assert [r.n_records for r in scan.counts.collect()] == [900]


def test_many_headers_are_joined(spark, folder):
    files = {f"f{i}.csv": f"k{i},common\n{i},x\n" for i in range(30)}
    records = scan_csv(spark, folder(files)).records.collect()
    assert sorted(sorted(r.rec.items()) for r in records) == sorted(
        sorted({f"k{i}": str(i), "common": "x"}.items()) for i in range(30)
    )


def test_keep_crlf(spark, folder):
    path = folder({"x.csv": b'a,b\r\n"l1\r\nl2",3\r\n4,"5"\r\n'})
    plain = {r.rec["b"]: r.rec["a"] for r in scan_csv(spark, path).records.collect()}
    kept = {r.rec["b"]: r.rec["a"] for r in scan_csv(spark, path, keep_crlf=True).records.collect()}
    assert plain == {"3": "l1\nl2", "5": "4"}
    assert kept == {"3": "l1\r\nl2", "5": "4"}


def test_stray_quotes_over_lines(spark, folder):
    path = folder({"s.csv": b'a,b\n1,"2\n3"\nx"y,1\nz"w,2\n'})
    scan = scan_csv(spark, path, numbered=True)
    found = sorted((r.rec_no, r.rec["a"], r.rec["b"]) for r in scan.records.collect())
    assert found == [(1, "1", "2\n3"), (2, 'x"y', "1"), (3, 'z"w', "2")]
    assert scan.rejects.count() == 0


BLANK_LINES = {
    "space": ("  \na,b\n1,2\n3,4\n", [("1", "2"), ("3", "4")]),
    "space quoted": ('  \na,b\n1,"x\ny"\n3,4\n', [("1", "x\ny"), ("3", "4")]),
    "tab": ("\t\na,b\n1,2\n3,4\n", [("1", "2"), ("3", "4")]),
    "nbsp": ("\u00a0\n\u2003\na,b\n\u00a0\n1,2\n", [("1", "2")]),
    "crlf": ("\r\n\r\na,b\r\n1,2\r\n", [("1", "2")]),
    "cr": ("\ra,b\r1,2\r\r3,4\r", [("1", "2"), ("3", "4")]),
    "cr quoted": ('a,b\r1,"x\ry"\r3,4', [("1", "x\ry"), ("3", "4")]),
    "control": ("a,b\n\x1f\nx,y\n", [("\x1f", ""), ("x", "y")]),
    "control first": ("\x01\nx\n", None),
}


@pytest.mark.parametrize("name", BLANK_LINES)
def test_blank_lines(spark, folder, name):
    text, rows = BLANK_LINES[name]
    scan = scan_csv(spark, folder({"x.csv": text}), numbered=True)
    found = [r.rec for _, r in sorted((r.rec_no, r) for r in scan.records.collect())]
    assert found == ([{"\x01": "x"}] if rows is None else [{"a": a, "b": b} for a, b in rows])


def test_record_too_long_for_one_row(spark, folder, small_splits, monkeypatch):
    monkeypatch.setattr(stitch, "MAX_RECORD_BYTES", 2000)
    path = folder({"long.csv": 'a\nfirst\n"' + "x\n" * 3000 + '"\nlast\n', "ok.csv": 'a\n"1\n2"\n'})
    scan = scan_csv(spark, path)
    assert sorted(r.rec["a"] for r in scan.records.collect()) == ["1\n2", "first", "last"]
    assert by_file(scan.rejects.collect(), "rec_no", "error_msg") == {
        "long": [(2, f"Invalid input: {errors.LONG_RECORD}")]
    }


def test_wide_rows_use_the_array_form(spark, folder):
    names = [f"c{i:03d}" for i in range(80)]
    path = folder({"w.csv": ",".join(names) + "\n" + "," * 79 + "\n" + ",".join(names) + "\n"})
    records = scan_csv(spark, path).records.collect()
    assert [r.rec for r in records] == [{n: n for n in names}]


def test_one_wide_file_leaves_the_others_narrow(spark, folder):
    """Headers of 2, 300 and 20,000 names in one folder: no plan has 20,000 columns."""
    wide, middle = [f"w{i}" for i in range(20_000)], [f"m{i}" for i in range(300)]
    files = {f"n{i}.csv": f"a,b\n{i},x\n" for i in range(3)}
    files["middle.csv"] = ",".join(middle) + "\n" + ",".join(middle) + "\n" + "," * 400 + "\n1\n"
    files["wide.csv"] = ",".join(wide) + ",w7\n" + ",".join(wide) + ",last\n" + "," * 20_000 + '\n"x,""y""",2\n'
    scan = scan_csv(spark, folder(files), numbered=True)
    routes = {r.src_file.rsplit("/", 1)[1]: r.route for r in scan.files.collect()}
    assert routes == {"n0.csv": LINES, "n1.csv": LINES, "n2.csv": LINES, "middle.csv": csv_files.WIDE_LINES, "wide.csv": STITCH}
    leaves = scan.records._jdf.queryExecution().analyzed().collectLeaves()
    assert max(leaves.apply(i).output().size() for i in range(leaves.size())) == 300 + 2
    got = by_file(scan.records.collect(), "rec_no", "rec")
    assert [x for i in range(3) for x in got[f"n{i}"]] == [(1, {"a": str(i), "b": "x"}) for i in range(3)]
    assert got["middle"] == [(1, {n: n for n in middle}), (2, {**dict.fromkeys(middle, ""), "m0": "1"})]
    assert got["wide"] == [(1, {**{n: n for n in wide}, "w7": "last"}), (2, {**dict.fromkeys(wide, ""), "w0": 'x,"y"', "w1": "2"})]
    assert {r.src_file.rsplit("/", 1)[1]: r.n_records for r in scan.counts.collect()}["wide.csv"] == 2


def test_more_fields_than_the_reader_takes(spark, folder, monkeypatch):
    """Such a line neither fails the job nor loses its file."""
    monkeypatch.setattr(csv_files, "READER_FIELDS", 100)
    monkeypatch.setitem(csv_files.CSV_READ, "maxColumns", "100")
    scan = scan_csv(spark, folder({"x.csv": "a,b\n1,2" + ",z" * 500 + "\n3\n", "y.csv": "a,b\n5,6\n"}), numbered=True)
    found = sorted((r.src_file.rsplit("/", 1)[1], r.rec_no, r.rec["a"], r.rec["b"]) for r in scan.records.collect())
    assert found == [("x.csv", 1, "1", "2"), ("x.csv", 2, "3", ""), ("y.csv", 1, "5", "6")]
    assert scan.rejects.count() == 0


def test_lines_scan_does_not_shuffle(spark, folder):
    scan = scan_csv(spark, folder({"x.csv": b"a,b\n1,2\n"}))
    plan = scan.records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert csv_files.CSV_READ["maxCharsPerColumn"] == "-1"
