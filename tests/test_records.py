"""Canonical JSON and literals of log lines."""

import hashlib
import json

from pyspark.sql import functions as F

from episodeframe.functions import records


def ask(spark, make, *texts):
    rows = spark.createDataFrame([(i, *(t if isinstance(t, tuple) else (t,))) for i, t in enumerate(texts)], "i int, a string, b string" if isinstance(texts[0], tuple) else "i int, a string")
    return [r[0] for r in rows.orderBy("i").select(make(*(F.col(c) for c in rows.columns[1:]))).collect()]


def test_canonical_text(spark):
    got = ask(spark, records.canonical_text, '{"b": 1.50, "a": [1, true, null, "ñ\\u0041"]}', "1e2", "-0.0", "[0.1,1E-7]", "NaN", "{", None, '{"a":1,"a":2}')
    assert got == ['{"a":[1,true,null,"\\u00f1A"],"b":1.5}', "100.0", "0.0", "[0.1,1e-07]", None, None, None, '{"a":2}']
    row = spark.range(1).select(records.canonical_json(z=F.lit(1e10), y=F.lit("é"), x=F.lit(None).cast("int"), w=F.lit(3))).first()[0]
    assert row == json.dumps({"w": 3, "x": None, "y": "é", "z": 1e10}, separators=(",", ":"))
    assert ask(spark, records.fingerprint, '{"b":1, "a":2}', "x") == [hashlib.sha256(b'{"a":2,"b":1}').hexdigest(), None]


def test_typed_equality(spark):
    pairs = [('{"a":1,"b":2}', '{"b":2,"a":1}', True), ("1", "1.0", False), ("1", "true", False), ("1.50", "1.5", True), ("[1,2]", "[2,1]", False), ("0.0", "-0.0", True), ("x", "x", False), ("null", None, False), ("null", "null", True)]
    assert ask(spark, records.same_typed, *((a, b) for a, b, _ in pairs)) == [w for *_, w in pairs]


def test_literals_of_log_lines(spark):
    cases = {
        "{}": {}, " { 'a/b' : -1.5e3 , } ": {"a/b": -1500.0}, '{"a/b": .5, \'c/d\': 7, 3: 4}': {"a/b": 0.5, "c/d": 7.0}, "{'a/b': 1, 'a/b': 2}": {"a/b": 2.0}, "{'x/l': [1, 2], 'a/b': 1}": {"a/b": 1.0},
        "{'a/b': nan, 'c/d': -inf, 'e/f': True, 'g/h': 'it\\'s, {1}', 'i/j': None, 'k/l': 3}": {"k/l": 3.0}, "{'a/b': 1": None, "{'a/b' 1}": None, "[1]": None, "{'a/b': 1} x": None,
    }
    assert ask(spark, records.literal_metrics, *cases) == list(cases.values())
    assert ask(spark, records.literal_metrics, None) == [None]
