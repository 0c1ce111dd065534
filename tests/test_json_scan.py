"""Byte fixtures of the JSON rules, for every way a file can be scanned."""

import pytest
from conftest import by_file
from pyspark.sql import functions as F

from flatloom.functions import errors
from flatloom.sources import stitch
from flatloom.sources.json_files import _outline, scan_json, scan_json_lines

NESTED = "Invalid input: Only flat JSON is supported. Field '{}' contains a nested value."
ITEM = "Invalid input: Array item {} is not a JSON object."
MALFORMED = [(None, "Invalid input: JSON is malformed.")]
TOP_LEVEL = [(None, "Invalid input: JSON must be an object or array of objects.")]

# file -> (content, texts of the records kept by number, rejects)
CASES = {
    "j01": (r'{"b":"x","a":"y"}', {1: r'{"b":"x","a":"y"}'}, []),
    "j02": ('[{"b":1},{"a":2}]', {1: '{"b":1}', 2: '{"a":2}'}, []),
    "j03": (r'[{"t":true,"n":null,"s":"q\"r","i":7}]', {1: r'{"t":true,"n":null,"s":"q\"r","i":7}'}, []),
    "j06": ('[{"a":1},{"a":{"x":1}}]', {1: '{"a":1}'}, [(2, NESTED.format("a"))]),
    "j07": ('[{"a":[]},{"b":{}}]', {}, [(1, NESTED.format("a")), (2, NESTED.format("b"))]),
    "j08": ('[{"a":1},5]', {1: '{"a":1}'}, [(2, ITEM.format(2))]),
    "j09": ("[]", {}, []),
    "j10": ("5", {}, TOP_LEVEL),
    "j11": ('{"a":1', {}, MALFORMED),
    "j12x": ('{"a":1} junk', {}, MALFORMED),
    "j12y": ('{"a":1}\n{"a":2}', {}, MALFORMED),
    "j13": ('{"a":1,"A":2}', {1: '{"a":1,"A":2}'}, []),
    "j14": ('{"a":1,"a":2}', {1: '{"a":1,"a":2}'}, []),
    "j15": (r'[{"a":"{\"x\":1}"}]', {1: r'{"a":"{\"x\":1}"}'}, []),
    "j17": ("{}", {1: "{}"}, []),
    "j18": ("[{}]", {1: "{}"}, []),
    "j19": ("", {}, MALFORMED),
    "j20": (" \n", {}, MALFORMED),
    "j21": ('[{"a":1},]', {}, MALFORMED),
    "j22": ('[{"a":1}{"b":2}]', {}, MALFORMED),
    "j23": ('[,{"a":1}]', {}, MALFORMED),
    "j24": ('[{"a":1}]]', {}, MALFORMED),
    "j25": ('[{"a":1}]}', {}, MALFORMED),
    "j26": ('[{"a":1},5], [{"b":2}]', {}, MALFORMED),
    "j27": (
        '[5,"x",{"a":"}"},[1,{"q":1}],{"b":2},null]',
        {3: '{"a":"}"}', 5: '{"b":2}'},
        [(n, ITEM.format(n)) for n in (1, 2, 4, 6)],
    ),
    "j28": ('"a } b"', {}, TOP_LEVEL),
    "j29": ('{"a":"x","b":"}"}\n', {1: '{"a":"x","b":"}"}'}, []),
    "j30": ('[{"a":1}', {}, MALFORMED),
    "j31": ("nope", {}, MALFORMED),
    "j32": ("[1,2]", {}, [(1, ITEM.format(1)), (2, ITEM.format(2))]),
    "j33": ('[{"a":01}]', {}, MALFORMED),
    "j34": (r'{"a":"\}"}', {}, MALFORMED),
    "j35": ('[{"a":"x}\\"}y"},\n{"b":"z"}\n]\n', {1: '{"a":"x}\\"}y"}', 2: '{"b":"z"}'}, []),
    "j36": ('{"a":1}5', {}, MALFORMED),
    "j37": ('5{"a":1}', {}, MALFORMED),
    "j38": ('[{"a":1]}', {}, MALFORMED),
    "j39": ("{'a':1}", {}, MALFORMED),
    "j40": ('{"a":1}}', {}, MALFORMED),
    "j41": ('﻿[{"a":1}]', {1: '{"a":1}'}, []),
    "j42": ('"abc', {}, MALFORMED),
    "j43": ('{"b":{"c":1},"a":[2]}', {}, [(1, NESTED.format("a"))]),
    "j44": ("[1}", {}, MALFORMED),
    "j45": ('[{"a":1},{"b":2}}]', {}, MALFORMED),
    "j46": ('[{"a":"}"},{"b":tru}]', {}, MALFORMED),
    "j47": ('[ ]', {}, []),
    "j48": ('[{"a":"\\\\"},{"b":"}\\\\"}]', {1: '{"a":"\\\\"}', 2: '{"b":"}\\\\"}'}, []),
}


@pytest.fixture
def fixture_folder(folder):
    files = {f"{k}.json": content for k, (content, _, _) in CASES.items()}
    return folder({**files, "j16.json": b'{"a":"\xff"}'})


def check(scan):
    records = by_file(scan.records.collect(), "rec_no", "text")
    assert {k: dict(v) for k, v in records.items()} == {k: r for k, (_, r, _) in CASES.items() if r}
    rejects = by_file(scan.rejects.collect(), "rec_no", "error_msg")
    expected = {k: r for k, (_, _, r) in CASES.items() if r}
    expected["j16"] = [(None, "Invalid input: Input is not valid UTF-8 text.")]
    assert rejects == expected


def test_pieces_and_whole_files(spark, fixture_folder):
    check(scan_json(spark, fixture_folder, numbered=True))


def test_stitched(spark, fixture_folder):
    check(scan_json(spark, fixture_folder, numbered=True, whole_file_limit=0))


def test_stitched_across_splits(spark, folder, small_splits):
    """Records, nested values and strings that lie over several splits."""
    long = "".join(f'{{"k{i}":"{{}} \\" }}, {i}","v":{i}.50}},\n' for i in range(200))
    scan = scan_json(
        spark,
        folder(
            {
                "flat.json": f'[{long}{{"end":null}}]',
                "deep.json": f'[{long}{{"end":{{"x":[{"{}," * 900}{{"}}":1}}]}}}}, {{"last":1}}]',
                "plain.json": "[" + ",".join(f'{{"n":{i}}}' for i in range(800)) + "]",
            }
        ),
        numbered=True,
        whole_file_limit=0,
    )
    records = by_file(scan.records.collect(), "rec_no", "text")
    assert [n for n, _ in records["flat"]] == list(range(1, 202))
    assert records["flat"][0][1] == '{"k0":"{} \\" }, 0","v":0.50}'
    assert [n for n, _ in records["deep"]] == [*range(1, 201), 202]
    assert records["plain"] == [(i + 1, f'{{"n":{i}}}') for i in range(800)]
    assert by_file(scan.rejects.collect(), "rec_no", "error_msg") == {
        "deep": [(201, NESTED.format("end"))]
    }


def test_element_too_long_for_one_row(spark, folder, monkeypatch):
    monkeypatch.setattr(stitch, "MAX_RECORD_BYTES", 100)
    many = ",".join(f'{{"n":{i}}}' for i in range(40))
    scan = scan_json(spark, folder({"x.json": f"[[{many}]]", "ok.json": '[[{"n":1}]]'}), whole_file_limit=0)
    assert by_file(scan.rejects.collect(), "error_msg") == {
        "x": [(f"Invalid input: {errors.LONG_RECORD}",)],
        "ok": [(ITEM.format(1),)],
    }


LONG = f"Invalid input: {errors.LONG_RECORD}"


def test_long_elements_go_alone(spark, folder, small_splits):
    """Only the element too long is rejected; all others keep their numbers, over any splits."""
    small = [f'{{"k":"}} {i}"}}' for i in range(300)]
    braces = '}{ \\" ],' * 900
    flat = [*small[:100], f'{{"long":"{braces}"}}', *small[100:]]
    deep = [*small[:50], f'{{"x":[{{"y":"{braces}"}},[7]]}}', *small[50:90], '{"x":[1]}', "5", *small[90:]]
    files = {
        "flat": f"[{','.join(flat)}]",
        "first": f"[{','.join([flat[100], *small])}]",
        "deep": f"[{','.join(deep)}]",
        "parts": "[" + ",".join([*small[:9], '{"z":[' + ",".join(small) + "]}", *small[9:12]]) + "]",
        "rest": "[" + ",".join([*small[:9], "[" + ",".join(small) + "]"]) + "]",
        "alone": flat[100],
        "broken": f"[{','.join(flat)}",
        "tail": f'[{",".join(small[:3])},"{braces}"]',
    }
    scan = scan_json(
        spark, folder({f"{k}.json": v for k, v in files.items()}), numbered=True, whole_file_limit=0, max_record_bytes=2500
    )
    records = by_file(scan.records.collect(), "rec_no", "text")
    assert records == {
        "flat": [(i + 1, t) for i, t in enumerate(flat) if i != 100],
        "first": [(i + 2, t) for i, t in enumerate(small)],
        "deep": [(i + 1, t) for i, t in enumerate(deep) if i not in (50, 91, 92)],
        "parts": [(i + 1 if i < 9 else i + 2, t) for i, t in enumerate(small[:12])],
        "rest": [(i + 1, t) for i, t in enumerate(small[:9])],
        "tail": [(i + 1, t) for i, t in enumerate(small[:3])],
    }
    assert by_file(scan.rejects.collect(), "rec_no", "error_msg") == {
        "flat": [(101, LONG)],
        "first": [(1, LONG)],
        "deep": [(51, LONG), (92, NESTED.format("x")), (93, ITEM.format(93))],
        "parts": [(10, LONG)],
        "rest": [(10, LONG)],
        "alone": [(1, LONG)],
        "broken": MALFORMED,
        "tail": [(4, LONG)],
    }


def test_long_element_behind_other_items(spark, folder):
    """Items before a long object, in the same run, cannot be counted: the file is rejected."""
    content = '[{"a":"}"},5,[{"b":1},{"b":2}],{"c":"' + "}" * 300 + '"},{"d":1}]'
    scan = scan_json(spark, folder({"x.json": content}), whole_file_limit=0, max_record_bytes=200)
    assert scan.records.count() == 0
    assert by_file(scan.rejects.collect(), "rec_no", "error_msg") == {"x": [(None, LONG)]}


def test_lines(spark, folder):
    content = b'{"a":1}\n\n {"b":"}"} \n[1]\n5\n{"c":{}}\n{"a":1} x\n{"a":"\xff"}\n{"z":2}'
    scan = scan_json_lines(spark, folder({"l.json": content}), numbered=True)
    assert by_file(scan.records.collect(), "rec_no", "text") == {
        "l": [(1, '{"a":1}'), (2, '{"b":"}"}'), (8, '{"z":2}')]
    }
    top = TOP_LEVEL[0][1]
    assert by_file(scan.rejects.collect(), "rec_no", "error_msg") == {
        "l": [
            (3, top),
            (4, top),
            (5, NESTED.format("c")),
            (6, MALFORMED[0][1]),
            (7, "Invalid input: Input is not valid UTF-8 text."),
        ]
    }


def test_flat_pieces_do_not_shuffle(spark, folder):
    scan = scan_json(spark, folder({"x.json": '[{"a":1},{"a":2}]'}))
    plan = scan.records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_outline_of_ends(spark):
    """Only white space and one bracket end a document; no character of a record is looked up for that."""
    pieces = ["", " \t\n\r", " ]\n", "]", "]]", "] x", "x]", "\u00a0", "]\u2028", ',{"a":"]"', '[{"a":"é]"']
    sums = _outline(F.col("piece"), F.col("ord"))
    found = spark.createDataFrame([(p, i) for i, p in enumerate(pieces)], "piece string, ord long").agg(*sums).first()
    assert (found.tails, found.array_ends, found.odd_shape, found.n_records, found.tail_ord) == (4, 2, 5, 2, 3)
    assert "translate" not in str(sums)
