from collections import defaultdict

import pytest

from checks.compare import check
from labelaudit.llm import perspectives, queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, con, sf, name):
    note, _, ok = check(spark, con, sf, name, queries.QUERIES[name], queries.SQL[name])
    assert ok, note


def rendered(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.conv_id, r.perspective].append(r)
    return {k: sorted(v, key=lambda r: r.position) for k, v in out.items()}


def test_three_speakers_long_dialogue_and_nulls(spark):
    rows = [(1, t, ("ann", "bob", "cy")[t % 3], f"line {t} <|turn|>" * (1 + t % 4)) for t in range(700)]
    rows += [(1, -5, "system", "be kind"), (2, None, None, None), (2, None, None, None), (3, 0, "system", "alone"),
             (None, 1, "ann", ""), (None, 0, "bob", "x" * 50_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, start int, name string")
    views = rendered(perspectives.rotate(df))
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (None, "ann"), (None, "bob")}
    for (conv, speaker), rows in views.items():
        assert [r.position for r in rows] == list(range(len(rows)))
        text = "".join(r.segment for r in rows)
        at = 0
        for r in rows:
            assert r.start == at
            at += len(r.segment)
            if r.role == "assistant":
                assert text[r.train_from:r.train_to].endswith("<|end|>") and r.name is None
            else:
                assert r.train_from is None and r.train_to is None
            assert (r.name is None) == (r.role != "user")
            assert r.segment.count("<|turn|>") == 1
    assert len(views[1, "ann"]) == 701 and views[1, "ann"][0].role == "system"
    assert views[1, "bob"][2].train_from is not None and views[1, "bob"][1].name == "ann"
    assert len(views[2, "unknown"]) == 2


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert perspectives.rotate(df).count() == 0
