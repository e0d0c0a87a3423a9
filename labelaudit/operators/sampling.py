"""Splits, subsamples, folds and triplets, all by hash draws.

Every result is the same on any partitioning. Counts are exact."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.draws import draw
from ..sizes import SMALL_ROWS, class_counts
from .ranking import inside_cut, quota_cuts, rank_within


def largest_remainder(counts: dict, total: int) -> dict:
    """Share `total` among classes in proportion to their counts."""
    n = sum(counts.values())
    exact = {c: total * k / n for c, k in counts.items()}
    quota = {c: math.floor(e) for c, e in exact.items()}
    by_rest = sorted(counts, key=lambda c: (quota[c] - exact[c], c))
    for c in by_rest[:total - sum(quota.values())]:
        quota[c] += 1
    return quota


def _quota_table(df: DataFrame, label: str, quota: dict) -> DataFrame:
    schema = f"{label} {df.schema[label].dataType.simpleString()}, quota long"
    return df.sparkSession.createDataFrame([(c, q) for c, q in quota.items()], schema)


def _mark(df: DataFrame, label: str, quota: dict, seed, tag: str, id_col: str,
          flag: str) -> DataFrame:
    """Adds a boolean: the row is among the first `quota` draws of its class."""
    drawn = df.withColumn("u", draw(seed, tag, F.col(id_col)))
    cuts = quota_cuts(drawn, [label], _quota_table(df, label, quota), id_col)
    return (drawn.join(F.broadcast(cuts), label, "left")
            .withColumn(flag, inside_cut(id_col)).drop("u", "cut_u", "cut_id"))


def stratified_split(df: DataFrame, test_size: float = 0.3, seed: int = 42, label: str = "y",
                     id_col: str = "id") -> DataFrame:
    """Adds `split` ('train' / 'test') with the same class shares on both sides.
    The test side has ceil(test_size * n) rows."""
    counts = class_counts(df, label)
    n = sum(counts.values())
    if counts and min(counts.values()) < 2:
        raise ValueError("a class with one row cannot be split")
    train = largest_remainder(counts, n - math.ceil(test_size * n))
    marked = _mark(df, label, {c: counts[c] - train[c] for c in counts},
                   seed, "split", id_col, "in_test")
    return marked.withColumn(
        "split", F.when(F.col("in_test"), "test").otherwise("train")).drop("in_test")


def balanced_subsample(df: DataFrame, n: int, seed: int = 42, label: str = "y",
                       id_col: str = "id") -> DataFrame:
    """The same number of rows from each class, capped by the smallest class;
    with one class a plain sample."""
    counts = class_counts(df, label)
    if len(counts) < 2:
        quota = {c: min(n, k) for c, k in counts.items()}
    else:
        per_class = min(n // len(counts), min(counts.values()))
        if per_class < 1:
            raise ValueError(f"subsample={n} is too small for {len(counts)} classes")
        quota = {c: per_class for c in counts}
    return _mark(df, label, quota, seed, "subsample", id_col, "kept").where("kept").drop("kept")


def label_subset(df: DataFrame, fraction: float, seed: int = 42, label: str = "y",
                 id_col: str = "id") -> DataFrame:
    """A stratified share of the rows; 1 or more keeps all."""
    if fraction >= 1.0:
        return df
    counts = class_counts(df, label)
    quota = largest_remainder(counts, math.floor(fraction * sum(counts.values())))
    return _mark(df, label, quota, seed, "subset", id_col, "kept").where("kept").drop("kept")


def stratified_folds(df: DataFrame, k: int = 4, seed: int = 42, label: str = "y",
                     id_col: str = "id") -> DataFrame:
    """Adds `fold`: shuffled within each class and dealt out in turn, each class
    going on where the one before it stopped."""
    counts = class_counts(df, label)
    starts, before = {}, 0
    for c, n in counts.items():
        starts[c], before = before, before + n
    drawn = df.withColumn("u", draw(seed, "fold", F.col(id_col)))
    table = _quota_table(df, label, starts).withColumnRenamed("quota", "start")
    return (rank_within(drawn, [label], "pos", id_col).join(F.broadcast(table), label)
            .withColumn("fold", ((F.col("start") + F.col("pos")) % k).cast("int"))
            .drop("u", "pos", "start"))


# Noise modes and the classes they may flip, with their share of the rate.
MODES = {
    "symmetric": None,
    "bot_to_human": {1: 1.0},
    "human_to_bot": {0: 1.0},
    "class_conditional": {1: 1.0, 0: 0.5},
}


def flip_quotas(counts: dict, rate: float, mode: str, class_rates: dict | None = None) -> dict:
    """{group: rows to flip}; the symmetric mode has one group, None."""
    if mode not in MODES:
        raise ValueError(f"unknown noise mode: {mode}")
    if mode == "symmetric":
        return {None: round(rate * sum(counts.values())) if rate > 0 else 0}
    rates = {c: rate * share for c, share in MODES[mode].items()}
    if mode == "class_conditional" and class_rates:
        rates = class_rates
    return {c: round(r * counts.get(c, 0)) if r > 0 else 0 for c, r in rates.items()}


def noise_grid(df: DataFrame, rates, seeds, mode: str = "symmetric", label: str = "y",
               id_col: str = "id", class_rates: dict | None = None) -> DataFrame:
    """Every row once per (rate, seed), with `y_noisy` and the flip `mask`.

    Exactly round-half-even(rate * candidates) binary labels are flipped in each
    (rate, seed) and class. All grid cells share one ranking per seed."""
    spark = df.sparkSession
    counts = class_counts(df, label)
    group = F.lit(-1) if mode == "symmetric" else F.col(label)
    rows = [(float(r), int(s), -1 if c is None else int(c), q)
            for r in rates for s in seeds
            for c, q in flip_quotas(counts, r, mode, class_rates).items()]
    quotas = spark.createDataFrame(rows, "rate double, seed int, grp int, quota long")
    seeded = (df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
              .withColumn("grp", group.cast("int"))
              .withColumn("u", draw(F.col("seed"), "flip", F.col(id_col))))
    cuts = quota_cuts(seeded.select("seed", "grp", "u", id_col), ["seed", "grp"], quotas, id_col)
    full = seeded.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return (full.join(F.broadcast(cuts), ["seed", "grp", "rate"], "left")
            .withColumn("mask", inside_cut(id_col))
            .withColumn("y_noisy", F.when(F.col("mask"), 1 - F.col(label)).otherwise(F.col(label)))
            .drop("grp", "u", "cut_u", "cut_id"))


def inject_label_noise(df: DataFrame, rate: float, mode: str = "symmetric", seed: int = 42,
                       label: str = "y", id_col: str = "id",
                       class_rates: dict | None = None) -> DataFrame:
    """One (rate, seed) of `noise_grid`: adds `y_noisy` and `mask`."""
    return noise_grid(df, [rate], [seed], mode, label, id_col, class_rates).drop("rate", "seed")


def triplets(df: DataFrame, seed: int = 42, label: str = "y", id_col: str = "id") -> DataFrame:
    """(anchor, positive, negative): another row of the same class and a row of
    another class, each drawn by position within its class. Positions are drawn
    evenly, so the two joins have no hot key."""
    spark = df.sparkSession
    counts = class_counts(df, label)
    if len(counts) < 2:
        raise ValueError("triplets need two classes or more")
    kind = df.schema[label].dataType.simpleString()
    sizes = F.broadcast(spark.createDataFrame(list(counts.items()), f"{label} {kind}, n long"))
    # per class: the other classes in order, with their sizes
    others = F.broadcast(spark.createDataFrame(
        [(c, [(o, counts[o]) for o in counts if o != c]) for c in counts],
        f"{label} {kind}, others array<struct<y:{kind},n:bigint>>"))
    drawn = df.select(id_col, label).withColumn("u", draw(seed, "order", F.col(id_col)))
    ranked = rank_within(drawn, [label], "pos", id_col).drop("u")
    pick = lambda tag, n: F.floor(draw(seed, tag, F.col(id_col)) * n).cast("long")
    anchors = (ranked.join(sizes, label).where(F.col("n") > 1).join(others, label)
               .withColumn("p", pick("positive", F.col("n") - 1))
               .withColumn("p", F.col("p") + F.when(F.col("p") >= F.col("pos"), 1).otherwise(0))
               .withColumn("other", F.get("others", pick("class", F.size("others")).cast("int")))
               .withColumn("q", pick("negative", F.col("other.n")))
               .select(F.col(id_col).alias("anchor"), F.col(label).alias("pos_y"), "p",
                       F.col("other.y").alias("neg_y"), "q"))
    positives = ranked.select(F.col(label).alias("pos_y"), F.col("pos").alias("p"),
                              F.col(id_col).alias("positive"))
    negatives = ranked.select(F.col(label).alias("neg_y"), F.col("pos").alias("q"),
                              F.col(id_col).alias("negative"))
    return (anchors.join(positives, ["pos_y", "p"]).join(negatives, ["neg_y", "q"])
            .select("anchor", "positive", "negative", F.col("pos_y").alias("y"), "neg_y"))


def _group_counts(df: DataFrame, by, label: str) -> dict[tuple, dict]:
    """{group: {class: rows}}, classes in order."""
    rows = df.groupBy(*by, label).count().limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} classes of groups")
    out: dict[tuple, dict] = {}
    for *group, c, n in sorted(map(tuple, rows), key=lambda r: (str(r[:-2]), r[-2])):
        out.setdefault(tuple(group), {})[c] = n
    return out


def _group_table(df: DataFrame, by, label: str, values: dict[tuple, dict], name: str) -> DataFrame:
    """(by, label, name), to be broadcast: a row per class of a group."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*by, label))
    return df.sparkSession.createDataFrame([(*g, c, v) for g, each in values.items() for c, v in each.items()], f"{kinds}, {name} long")


def _mark_groups(df: DataFrame, by, label: str, quotas: dict[tuple, dict], tag: str, id_col: str, flag: str) -> DataFrame:
    """`_mark` for many groups in one pass; the seed is a column."""
    drawn = df.withColumn("u", draw(F.col("seed"), tag, F.col(id_col)))
    cuts = quota_cuts(drawn, [*by, label], _group_table(df, by, label, quotas, "quota"), id_col)
    return (drawn.join(F.broadcast(cuts), [*by, label], "left")
            .withColumn(flag, inside_cut(id_col)).drop("u", "cut_u", "cut_id"))


def split_groups(df: DataFrame, by, test_size: float = 0.3, label: str = "y", id_col: str = "id") -> DataFrame:
    """`stratified_split` of every group at once; `by` has the column `seed`."""
    quotas = {}
    for group, counts in _group_counts(df, by, label).items():
        if min(counts.values()) < 2:
            raise ValueError(f"group {group} has a class with one row, which cannot be split")
        n = sum(counts.values())
        train = largest_remainder(counts, n - math.ceil(test_size * n))
        quotas[group] = {c: counts[c] - train[c] for c in counts}
    marked = _mark_groups(df, by, label, quotas, "split", id_col, "in_test")
    return marked.withColumn("split", F.when(F.col("in_test"), "test").otherwise("train")).drop("in_test")


def subsample_groups(df: DataFrame, by, n: int, label: str = "y", id_col: str = "id") -> DataFrame:
    """`balanced_subsample` of every group at once; `by` has the column `seed`."""
    quotas = {}
    for group, counts in _group_counts(df, by, label).items():
        share = n if len(counts) < 2 else min(n // len(counts), min(counts.values()))
        if share < 1:
            raise ValueError(f"subsample={n} is too small for the classes of group {group}")
        quotas[group] = {c: min(share, k) for c, k in counts.items()}
    return _mark_groups(df, by, label, quotas, "subsample", id_col, "kept").where("kept").drop("kept")


def noise_groups(df: DataFrame, by, rates, label: str = "y", id_col: str = "id") -> DataFrame:
    """`noise_grid`, symmetric, of every group at once: each row once per rate. All
    rates share one ranking; `by` has the column `seed`."""
    quotas = [(*g, float(r), round(r * sum(counts.values())) if r > 0 else 0)
              for g, counts in _group_counts(df, by, label).items() for r in rates]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    table = df.sparkSession.createDataFrame(quotas, f"{kinds}, rate double, quota long")
    drawn = df.withColumn("u", draw(F.col("seed"), "flip", F.col(id_col)))
    cuts = quota_cuts(drawn.select(*by, "u", id_col), list(by), table, id_col)
    full = drawn.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return (full.join(F.broadcast(cuts), [*by, "rate"], "left").withColumn("mask", inside_cut(id_col))
            .withColumn("y_noisy", F.when(F.col("mask"), 1 - F.col(label)).otherwise(F.col(label)))
            .drop("u", "cut_u", "cut_id"))


def fold_groups(df: DataFrame, by, k: int = 4, label: str = "y", id_col: str = "id") -> DataFrame:
    """`stratified_folds` of every group at once; `by` has the column `seed`."""
    starts = {}
    for group, counts in _group_counts(df, by, label).items():
        before, starts[group] = 0, {}
        for c, n in counts.items():
            starts[group][c], before = before, before + n
    table = F.broadcast(_group_table(df, by, label, starts, "start"))
    drawn = df.withColumn("u", draw(F.col("seed"), "fold", F.col(id_col)))
    return (rank_within(drawn, [*by, label], "pos", id_col).join(table, [*by, label])
            .withColumn("fold", ((F.col("start") + F.col("pos")) % k).cast("int")).drop("u", "pos", "start"))
