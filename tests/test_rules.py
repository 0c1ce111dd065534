"""Column expressions: trimming, quoting, names, scalars, rendering."""

import json
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flatloom.functions.json import (
    kind,
    let,
    numbers_as_text,
    object_json,
    parse_strict,
    pretty,
    scalar_texts,
    sorted_json,
)
from flatloom.functions.text import (
    base_name,
    csv_escape,
    csv_line,
    file_extension,
    trim_whitespace,
)
from flatloom.operators.header import blank_text, header_names, last_positions, record_keys
from flatloom.operators.keys import cells
from flatloom.operators.validate import csv_error, json_error, no_records_error
from flatloom.plans.actions import ACTIONS, catalogue, extension_error, output_name
from flatloom.session import case_sensitive, configure


def column(spark, values, build):
    """Apply a column expression to a list of texts, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in df.select("i", build(F.col("t")).alias("x")).orderBy("i").collect()]


def test_trim_whitespace(spark):
    got = column(spark, ["\t  a b  \r\n", " x\u0085", " ", "z"], trim_whitespace)
    assert got == ["a b", "x", "", "z"]


def test_csv_escape(spark):
    got = column(spark, ["a", "a,b", 'q"r', "l1\nl2", "r\r", "#c", "", " p "], csv_escape)
    assert got == ["a", '"a,b"', '"q""r"', '"l1\nl2"', "r\r", "#c", "", " p "]


def test_csv_line_folds_null_and_empty(spark):
    df = spark.createDataFrame([("a,", None, "")], "x string, y string, z string")
    assert df.select(csv_line([F.col(c) for c in "xyz"]).alias("l")).first().l == '"a,",,'


NAMES = {
    "d/x.CSV": ("csv", "x"),
    "d/x.txt": ("txt", "x"),
    "d/x": ("", "x"),
    "d/a.b.json": ("json", "a.b"),
    "d.e/x": ("", "x"),
    "d/.hidden": ("", ".hidden"),
    "x.": ("", "x"),
}


def test_file_names(spark):
    assert column(spark, NAMES, file_extension) == [e for e, _ in NAMES.values()]
    assert column(spark, NAMES, base_name) == [b for _, b in NAMES.values()]


@pytest.mark.parametrize("action", ACTIONS.values(), ids=lambda a: a.name)
def test_actions(spark, action):
    label, allowed = F.lit(action.label), F.array(*map(F.lit, action.allowed))
    paths = ["d/x.CSV", "d/x.txt", "d/x.xml", "d/x", "d/a.b.json"]
    main = action.allowed[0]
    expected = [
        None
        if ext in (main, "txt")
        else f"Invalid input: Selected file type '.{ext}' is not valid for {action.label}."
        for ext in ("csv", "txt", "xml", "", "json")
    ]
    assert column(spark, paths, lambda p: extension_error(p, label, allowed)) == expected
    names = column(spark, paths, lambda p: output_name(p, F.lit(action.suffix)))
    assert names == [b + action.suffix for b in ("x", "x", "x", "x", "a.b")]


def test_catalogue(spark):
    assert [tuple(r) for r in catalogue(spark).collect()] == [
        ("csvToJSON", "CSV -> JSON", ["csv", "txt"], "json", "_converted.json"),
        ("jsonToCSV", "JSON -> CSV", ["json", "txt"], "csv", "_converted.csv"),
        ("formatJSONByLine", "Format JSON", ["json", "txt"], "json", "_line_formatted.json"),
    ]


def test_header_names(spark):
    texts = ["a,b", " a ,\tb", '"x, ""y""",z,', ",", "", '"l1\nl2",b', 'ab"c,d', '"ab"c,d']
    assert column(spark, texts, header_names) == [
        ["a", "b"],
        ["a", "b"],
        ['x, "y"', "z", ""],
        ["", ""],
        [""],
        ["l1\nl2", "b"],
        ['ab"c', "d"],
        ['"ab"c', "d"],
    ]


def test_last_column_of_a_name_wins(spark):
    names = spark.createDataFrame([(["id", "name", "id", "Z"],)], "n array<string>")
    row = names.select(
        record_keys(F.col("n")).alias("k"), last_positions(F.col("n")).alias("p")
    ).first()
    assert (row.k, row.p) == (["Z", "id", "name"], [3, 2, 1])


def test_blank_rows(spark):
    texts = [" , ,\t", '"",""," "', ",,x", '""', "", ',"""",', ',",",']
    assert column(spark, texts, blank_text) == [True, True, False, True, True, False, False]


STRICT_CASES = {
    '{"a":1}': "OBJECT<a: BIGINT>",
    " [1] ": "ARRAY<BIGINT>",
    "null": "VOID",
    '{"a":1} junk': None,
    '{"a":1}{"a":2}': None,
    "1,2": None,
    "1],[2": None,
    '1},{"d":2': None,
    "": None,
    "]": None,
    '{"a":1}]': None,
    '{"a":1}}': None,
    "[1]]": None,
    "{'a':1}": None,
    '{"a":NaN}': None,
    '{"a":01}': None,
    '{"a":1,}': None,
    '"x"': "STRING",
    "1, null": None,
}


def test_parse_strict(spark):
    got = column(spark, STRICT_CASES, lambda t: let(parse_strict(t), lambda v: F.when(v.isNotNull(), kind(v))))
    assert dict(zip(STRICT_CASES, got, strict=True)) == STRICT_CASES


def test_json_error(spark):
    configure(spark)
    prefix = "Invalid input: "
    cases = {
        '{"a":1}': None,
        '[{"a":1},{}]': None,
        "[]": None,
        "7": prefix + "JSON must be an object or array of objects.",
        "{": prefix + "JSON is malformed.",
        '[{"a":1},2]': prefix + "Array item 2 is not a JSON object.",
        '[{"z":{},"b":[]},2]': prefix + "Only flat JSON is supported. Field 'b' contains a nested value.",
        '{"a":1,"a":{}}': prefix + "Only flat JSON is supported. Field 'a' contains a nested value.",
        '{"a":{},"a":1}': None,
    }
    assert dict(zip(cases, column(spark, cases, json_error), strict=True)) == cases


def test_empty_and_unclosed(spark):
    got = column(spark, ["a,b\n", "", "\r\n\n", 'a\n"x', 'a\n""""'], csv_error)
    empty = "Invalid input: CSV is empty or missing a header row."
    assert got == [None, empty, empty, "Invalid input: CSV contains an unclosed quote.", None]
    none = "Invalid input: JSON has no records to convert."
    assert column(spark, ["[]", "{}", "[{}]", '[{},{"a":1}]'], no_records_error) == [none] * 3 + [None]


def test_number_literals_keep_their_text(spark):
    text = '{"n":1.0,"e":1e3,"d":0.10,"i":7,"z":-0,"l":123456789012345678901234567890,"s":"1.5e3, :2.0,"}'
    row = column(spark, [text], lambda t: scalar_texts(t, "map<string,string>"))[0]
    assert row == {
        "n": "1.0", "e": "1e3", "d": "0.10", "i": "7", "z": "-0",
        "l": "123456789012345678901234567890", "s": "1.5e3, :2.0,",
    }


@pytest.mark.parametrize("bad", ['{"a":01.5}', '{"a":1.2.3}', '{"a":+1.0}', '{1.5:2}', '{"a":1.5 2.5}', '{"a":1.}'])
def test_malformed_numbers_stay_malformed(spark, bad):
    assert column(spark, [bad], lambda t: F.try_parse_json(numbers_as_text(t)).isNull()) == [True]


def test_cells_last_value_and_case(spark):
    df = spark.createDataFrame([('{"a":1,"A":2,"a":3,"n":null}',)], "t string")
    with case_sensitive(spark):
        keys = ["A", "a", "n", "x"]
        row = df.select(*[c.alias(k) for k, c in zip(keys, cells(keys, F.col("t")), strict=True)]).first()
    assert tuple(row) == ("2", "3", "", "")


def test_object_json_sorts_keys(spark):
    df = spark.createDataFrame([({"b": "x", "a": 'y"', "Z": "", "é": "1"},)], "m map<string,string>")
    assert df.select(object_json(F.col("m")).alias("j")).first().j == '{"Z":"","a":"y\\"","b":"x","é":"1"}'


def test_sorted_json(spark):
    configure(spark)
    texts = ['{"b":1.50,"a":null,"c":[]}', '{"\U0001d4b3":1,"￮":"x","a\\"":true}', '{"a":1,"a":2}', "{}"]
    got = column(spark, texts, lambda t: sorted_json(F.try_parse_json(t), t))
    assert got[0] == '{"a":null,"b":1.5,"c":[]}'
    assert got[1] == '{"a\\"":true,"￮":"x","\U0001d4b3":1}'
    assert got[2:] == ['{"a":2}', "{}"]


def test_pretty(spark):
    texts = ['{"a":1,"b":"x, \\"y\\": {"}', "{}"]
    got = column(spark, texts, pretty)
    assert got[0] == '  {\n    "a" : 1,\n    "b" : "x, \\"y\\": {"\n  }'
    assert json.loads(got[1]) == {}


ALPHABET = st.text(alphabet=',"\n é\\{}[]:1.', max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(ALPHABET, ALPHABET, min_size=1, max_size=4), min_size=5, max_size=20))
def test_json_texts_survive(spark, records):
    texts = [json.dumps(r, ensure_ascii=False) for r in records]
    assert column(spark, texts, lambda t: scalar_texts(t, "map<string,string>")) == records
    assert [json.loads(j) for j in column(spark, texts, lambda t: sorted_json(F.try_parse_json(t), t))] == records
    assert [json.loads(j) for j in column(spark, texts, lambda t: pretty(sorted_json(F.try_parse_json(t), t)))] == records


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(ALPHABET, min_size=3, max_size=3), min_size=1, max_size=20))
def test_header_line_round_trip(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, y string, z string")
    line = csv_line([F.col(c) for c in "xyz"])
    got = df.select("i", header_names(line).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [[v.strip(" \n") for v in r] for r in rows]


def test_sorted_json_long_numbers(spark):
    """Long numbers keep their text at any place, and work grows with the record, not with its square."""
    long, mark = "1234567890123456789012345678901234567890123", "\\u0001"
    texts = [
        f'{{"b": "x", "a":-{long}.50 , "c" :1e400}}',
        f'{{"a":{long},"a":"x","b":{long}}}',
        f'{{"z":"{mark}{long}{mark}","y":"{mark}","a":{long},"k{mark}":"{mark}{mark}7{mark}"}}',
        f'{{"z":"n: {long}, ","a":1.0}}',
        f'{{"\U0001F600":{long},"\uffff":0}}',
        "{" + ",".join(f'"k{i:05d}":{long}{i}' for i in range(3000)) + "}",
    ]
    wanted = [
        f'{{"a":-{long}.50,"b":"x","c":1e400}}',
        f'{{"a":"x","b":{long}}}',
        f'{{"a":{long},"k{mark}":"{mark}{mark}7{mark}","y":"{mark}","z":"{mark}{long}{mark}"}}',
        f'{{"a":1.0,"z":"n: {long}, "}}',
        f'{{"\uffff":0,"\U0001F600":{long}}}',
        texts[-1],
    ]
    configure(spark)
    start = time.monotonic()
    got = column(spark, texts, lambda t: sorted_json(F.try_parse_json(t), t))
    assert time.monotonic() - start < 30
    assert got[:3] + got[4:] == wanted[:3] + wanted[4:]
    assert json.loads(got[3]) == json.loads(wanted[3])
