import random

import pytest

from labelaudit.operators.running import running


def brute(rows, group):
    seen, out = {}, []
    ordered = sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in (*r[:group], r[1])))
    for i, r in enumerate(ordered):
        key = r[:group]
        at, total = seen.get(key, (0, 0))
        seen[key] = (at + 1, total + r[2])
        after = ordered[i + 1] if i + 1 < len(ordered) else None
        out.append((*r, at, total + r[2], after[1] if after and after[:group] == key else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("group,batch", [(1, 10_000), (1, 7), (0, 7), (0, 10_000)])
def test_against_a_plain_walk(spark, group, batch):
    """A hot group over many ranges, groups of one row, a null group, and batches of a few rows."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 1, *range(2, 60)]), k, rng.randrange(-5, 9)) for k in range(900)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "g long, o long, v long")
        got = running(df, ["g"][:group], ["o"], ["v"], "o", partitions=13).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(((r.g, r.o, r.v, r._at, r.v_upto, r._next) for r in got), key=str) == brute(rows, group)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "g string, o double")
    assert running(df, ["g"], ["o"], lead="o").collect() == []
    df = spark.createDataFrame([("a", 1.5)], "g string, o double")
    assert [tuple(r) for r in running(df, ["g"], ["o"], lead="o").collect()] == [("a", 1.5, 0, None)]
