"""JSON texts as Python reads them."""
import json

import pytest
from pyspark.sql import functions as F

from labelaudit.functions import jsontext as js

TEXTS = ['{"a":1}', ' {"b": 2, "a": "x y"} ', '{"a":1} junk', '{"a":1}] x', '{"a":1}} x', '{"a":1}, {"b":2}', '{"a":1},"k":2',
         '{"a":1}{"b":2}', '{"b":1,"a":2,"b":3}', "not json", "", "[1,2]", '"s"', '{"n": {"c": 1, "b": [2, {"z": 0, "y": 1}]}, "a": null}']


def loads(text):
    try:
        return json.loads(text)
    except ValueError:
        return None


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    pairs = js.entries("t")
    return {r.t: r for r in df.select(
        "t", js.canonical("t").alias("canonical"), F.transform(pairs, lambda e: e["key"]).alias("keys"),
        F.transform(pairs, js.value_text).alias("values"), F.map_keys(js.parse_object("t")).alias("tolerant")).collect()}


@pytest.mark.parametrize("text", TEXTS)
def test_against_python(rows, text):
    value, row = loads(text), rows[text]
    whole = value is not None
    assert row["canonical"] == (json.dumps(value, sort_keys=True, separators=(",", ":")) if whole else text)
    if isinstance(value, dict):
        assert row["keys"] == list(value)
        assert row["values"] == [json.dumps(v, separators=(",", ":")) for v in value.values()]
        assert set(row["tolerant"]) == set(value)
    else:
        assert row["keys"] is None and row["tolerant"] == []


def test_user_agent_that_is_null(spark):
    texts = {'{"User-Agent": null}': "None", '{"USER-agent": null}': "None", '{"a": null}': "", '{"User-Agent": "x"} tail': "",
             "{'User-Agent': 'y'}": "y", '{"user-agent": "low", "User-Agent": "High"}': "High"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.ua for r in df.select("t", js.user_agent("t").alias("ua")).collect()} == texts
