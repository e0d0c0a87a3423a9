"""A pass over rows in the order of a key in which every row sees the ones before and after it.

The key's range is cut at values of a sample of keys (balance, not results, hangs on it). A first
look at the keys alone gives the least and greatest key of each part; those few rows go to the part
before and the part after as guests. Then one shuffle brings every part together, sorted, and each
task walks through its part; no group is ever held whole."""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import stored
from ..sizes import small_table

SAMPLED = 30                 # keys sampled per part
BEFORE, OWN, AFTER = 0, 1, 2
PIN_BEFORE, PIN_AFTER = -2, -1


def _plain(row: tuple) -> tuple:
    """Without the marks that pandas puts for nulls."""
    return tuple(None if x is pd.NA or isinstance(x, float) and x != x else x for x in row)


def key_parts(keys: DataFrame, parts: int) -> list:
    """Up to `parts` - 1 cut points of the column `key`, from a sample bounded by parts x SAMPLED."""
    total = keys.count()
    if total == 0:
        return []
    share = min(1.0, 2.0 * parts * SAMPLED / total)
    sample = sorted(r[0] for r in keys.sample(share, seed=1).limit(4 * parts * SAMPLED).collect())
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def neighbour_pass(source: DataFrame, key: Column, columns: list[str], visit: Callable, result: T.StructType,
                   parts: int, wrap: bool = False, prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
                   pins: DataFrame | None = None) -> DataFrame:
    """`visit(before, row, after)` for every row of `source`, rows as tuples of `columns`; `before` and
    `after` are None at the ends, or with `wrap` the row at the other end. It returns a tuple for
    `result`. `key` (a long or a string, never null) gives the order; rows of equal key are ordered by
    their content, so equal rows are interchangeable. `prepare` makes `columns` out of the source
    and leaves the columns _key, _part and _side as they are.

    `pins` (prefix, low, high, earlier, later) names runs of rows, those whose key begins with
    `prefix`, from the key `low` to `high`: all of them see the last row of the key `earlier` and the
    first of `later` (null for none) instead of their own neighbours. Of two runs the shorter prefix
    counts. Those rows go ahead of the run into every part it reaches."""
    spark = source.sparkSession
    keyed = source.withColumn("_key", key)
    cuts = key_parts(keyed.select(F.col("_key").alias("key")), parts)

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, k) for k in keys], dtype="int32")

    part = part_of("_key") if cuts else F.lit(0)
    ends = (keyed.select("_key").withColumn("part", part).groupBy("part")
            .agg(F.min("_key").alias("low"), F.max("_key").alias("high")).collect())
    ends.sort(key=lambda r: r["part"])
    # (key, part it visits, side): the row after a part's last is the first of the next part
    calls = [(b["low"], a["part"], AFTER) for a, b in zip(ends, ends[1:])]
    calls += [(a["high"], b["part"], BEFORE) for a, b in zip(ends, ends[1:])]
    if wrap and ends:
        calls += [(ends[0]["low"], ends[-1]["part"], AFTER), (ends[-1]["high"], ends[0]["part"], BEFORE)]
    kind = keyed.schema["_key"].dataType.simpleString()
    called = spark.createDataFrame(calls, f"_key {kind}, _part int, _side int")
    # two or so rows per part: small whatever the data
    guests = stored(prepare(keyed.join(F.broadcast(called), "_key")).select("_key", "_part", "_side", *columns), "guests")
    own = prepare(keyed.withColumns({"_part": part, "_side": F.lit(OWN)})).select("_key", "_part", "_side", *columns)
    rows = own.unionByName(guests)
    if pins is not None:
        reached = pins.withColumn("_part", F.explode(F.sequence(part_of("low"), part_of("high"))) if cuts else F.lit(0))
        asked = reached.select("_part", "prefix", F.explode(F.array(
            F.struct(F.col("earlier").alias("_key"), F.lit(PIN_BEFORE).alias("_side")),
            F.struct(F.col("later").alias("_key"), F.lit(PIN_AFTER).alias("_side")))).alias("p"))
        asked = stored(asked.select("_part", "prefix", "p._key", "p._side").where("_key IS NOT NULL"), "asked")
        pinned = keyed.join(small_table(asked), "_key").withColumn("_key", F.col("prefix"))
        rows = rows.unionByName(stored(prepare(pinned).select("_key", "_part", "_side", *columns), "pins"))
    place = F.when(F.col("_side") < BEFORE, OWN).otherwise(F.col("_side"))
    order = ["_part", place, "_key", "_side", F.xxhash64(*columns)]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = here = now = None
        ahead: dict[str, list] = {}                # prefix: the rows its run sees
        done = []

        def out():
            return pd.DataFrame({n: pd.Series([r[k] for r in done], dtype=object) for k, n in enumerate(result.names)})

        def see(after):
            if here is not None and here[0] == OWN:
                done.append(visit(before, here[1], after) if here[2] is None else visit(here[2][0], here[1], here[2][1]))

        for pdf in batches:
            for part, side, key, *row in pdf.itertuples(index=False, name=None):
                row = _plain(tuple(row))
                if part != now:
                    see(None)
                    before, here, now, ahead = None, None, part, {}
                if side < BEFORE:
                    pin = ahead.setdefault(key, [None, None])
                    if side == PIN_BEFORE:
                        pin[0] = row
                    elif pin[1] is None:
                        pin[1] = row
                    continue
                see(row)
                if here is not None and here[0] == AFTER:
                    continue                       # only the first guest behind counts
                before = here[1] if here is not None else None
                pin = None
                if ahead:
                    ahead = {p: pin for p, pin in ahead.items() if key.startswith(p)}
                    pin = ahead[min(ahead, key=len)] if ahead else None
                here = side, row, pin
            yield out()
            done.clear()
        see(None)
        yield out()

    # guests of equal key come in content order too: the last of those before, the first of those after
    walked = (rows.repartitionById(max(1, len(cuts) + 1), "_part").sortWithinPartitions(*order)
              .select("_part", "_side", "_key", *columns))
    return walked.mapInPandas(walk, result)
