"""Exact k nearest neighbours without an all-pairs join.

1. Copies: equal vectors become one point that carries its k+1 lowest ids, so a
   block of copies of any size costs one point.
2. Cells: each point goes to its nearest pivot; a cell knows its radius, and big
   cells are cut in blocks of bounded size by hash. Blocks of near cells form a tile.
3. Home pass: a point meets its own block. The (k+1)-th distance found there is
   an upper bound of the true one.
4. Other blocks are met only if the triangle inequality leaves room for a closer
   point. A task holds two tiles: a vector is sent once per tile it has to meet, not
   once per block, and meets the blocks of the tile nearest first, each under the
   bound that those before it left. Nothing is capped, so the result is exact; on
   data without any structure every block may have to be met.

Group columns (`by`) part the rows: one job serves all groups of a grid. A task
emits k+1 rows per point and tile."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import as_double, l2_normalize
from ..session import stored
from ..sizes import SMALL_ROWS, join_hot, join_split
from .ranking import exact_median, medians

CELL_ROWS = 2048
BLOCK_ROWS = 4096
TILE_BLOCKS = 8
QUERY_ROWS = 512
PIVOT_BYTES = 64 << 20
MAX_PIVOTS = 1 << 17
STEP_CELLS = 4_000_000
ROUTE_CELLS = 1 << 18        # (row, cell) pairs looked at together while visits are listed: some fifteen arrays of them, and their visits
SLACK = 1e-6


def _stack(vectors) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 1))


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances as reported: cosine in [0, 2], or Euclidean."""
    if metric == "cosine":
        return np.clip(1.0 - a @ b.T, 0.0, 2.0)
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _spread(a: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """A distance that obeys the triangle inequality: the angle for cosine."""
    if metric == "cosine":
        return np.arccos(np.clip(a @ pivots.T, -1.0, 1.0))
    return _distances(a, pivots, metric)


def _reach(dist: np.ndarray, metric: str) -> np.ndarray:
    """The same bound in the units of `_spread`."""
    return np.arccos(np.clip(1.0 - dist, -1.0, 1.0)) if metric == "cosine" else dist


def _ids(members: pd.Series) -> np.ndarray:
    """All ids of the points, in a type that sorts."""
    if not len(members):
        return np.zeros(0, "int64")
    ids = np.concatenate(list(members))
    return ids.astype(str) if ids.dtype == object else ids


def _closer(part: np.ndarray, vectors: np.ndarray, keep: int, metric: str, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance) of all points up to the `keep`-th distance, or up to `bound` where every
    query has one: then a product is compared once, and only what passes becomes a distance."""
    if bound is not None and metric == "cosine" and np.isfinite(bound).all():
        product = part @ vectors.T
        at = np.flatnonzero(product >= (1.0 - bound - 1e-11)[:, None])
        q, p = at // len(vectors), at % len(vectors)
        dist = np.round(np.clip(1.0 - product.ravel()[at], 0.0, 2.0), 12)
        near = dist <= bound[q]
        return q[near], p[near], dist[near]
    dist = np.round(_distances(part, vectors, metric), 12)
    limit = np.partition(dist, keep - 1, axis=1)[:, keep - 1]
    q, p = np.nonzero(dist <= limit[:, None])
    return q, p, dist[q, p]


def _nearest(queries: np.ndarray, points: pd.DataFrame, k: int, metric: str, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance): for each query vector the k+1 best (distance, id) among
    the members of the points; fewer if those beyond its `bound` are not wanted. Every
    point at the k+1-th distance is looked at, so ties are settled by id."""
    vectors, members = _stack(points["v"]), points["members"]
    sizes = members.map(len).to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = _ids(members)
    keep = min(k + 1, len(points))
    out = []
    for at in range(0, len(queries) if keep else 0, QUERY_ROWS):
        q, p, dist = _closer(queries[at:at + QUERY_ROWS], vectors, keep, metric, None if bound is None else bound[at:at + QUERY_ROWS])
        copies = sizes[p]
        offset = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        q, p, d = np.repeat(q, copies), np.repeat(p, copies), np.repeat(dist, copies)
        nbr = ids[starts[p] + offset]
        order = np.lexsort((nbr, d, q))
        q, nbr, d = q[order], nbr[order], d[order]
        first = np.searchsorted(q, q)          # where the rows of each query begin
        best = np.arange(len(q)) - first <= k
        out.append((q[best] + at, nbr[best], d[best]))
    if not out:
        return np.zeros(0, "int64"), ids[:0], np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _result(pid, nbr, dist) -> pd.DataFrame:
    return pd.DataFrame({"pid": pid, "nbr_id": nbr.astype(object) if nbr.dtype.kind == "U" else nbr, "dist": dist})


def _home(points: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    q, nbr, dist = _nearest(_stack(points["v"]), points, k, metric)
    return _result(points["pid"].to_numpy()[q], nbr, dist)


def _meet(queries: pd.DataFrame, points: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """The queries of a tile against the points of another: block by block, nearest
    first, each query only while a block may hold something closer than it has."""
    parts = {b: p for b, p in points.groupby("block")}
    vectors, pid = _stack(queries["v"]), queries["pid"].to_numpy()
    many = queries["blocks"].map(len).to_numpy()
    row = np.repeat(np.arange(len(queries)), many)
    block, room = np.concatenate(list(queries["blocks"])), np.concatenate(list(queries["rooms"]))
    # the k+1 best (distance, id) so far of each query: no more is held, however many blocks it meets
    bound = queries["bound"].to_numpy()
    ids = _ids(points["members"])
    best = np.full((len(queries), k + 1), np.nan)          # NaN: none yet
    who = np.zeros((len(queries), k + 1), ids.dtype)
    nearest = pd.Series(room).groupby(block).mean().sort_values().index
    for b in nearest:
        here = np.flatnonzero(block == b)
        known = np.fmin(bound, best[:, -1])
        reach = _within(known[row[here]], metric, vectors[row[here]])
        here = here[room[here] <= reach + SLACK * (1 + np.abs(room[here]))]
        if not len(here) or b not in parts:
            continue
        at = row[here]
        q, nbr, dist = _nearest(vectors[at], parts[b], k, metric, known[at])
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        fresh, new = np.full((len(at), k + 1), np.nan), np.zeros((len(at), k + 1), ids.dtype)
        fresh[q, rank], new[q, rank] = dist, nbr
        fresh, new = np.concatenate([best[at], fresh], axis=1), np.concatenate([who[at], new], axis=1)
        order = np.lexsort((new, fresh))[:, :k + 1]
        best[at], who[at] = np.take_along_axis(fresh, order, 1), np.take_along_axis(new, order, 1)
    q, at = np.nonzero(~np.isnan(best))
    return _result(pid[q], who[q, at], best[q, at])


def _within(bound: np.ndarray, metric: str, vectors: np.ndarray) -> np.ndarray:
    """The room up to which a block must be met; a zero vector has no angle: never prune for it."""
    reach = np.where(np.isfinite(bound), _reach(np.where(np.isfinite(bound), bound, 0.0), metric), np.inf)
    if metric == "cosine":
        reach = np.where((vectors ** 2).sum(1) < 0.5, np.inf, reach)
    return reach


def _steps(batches: Iterator[pd.DataFrame], width: int, cells: int = STEP_CELLS) -> Iterator[pd.DataFrame]:
    """Batches cut so that rows x width stays within a fixed size."""
    rows = max(1, cells // max(width, 1))
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at:at + rows]


def _points(rows: DataFrame, k: int) -> DataFrame:
    """(grp, v, members, copies, pid): distinct vectors with their k+1 lowest ids."""
    key = ["grp", "v"]
    first = Window.partitionBy(*key).orderBy("id")
    lowest = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    lowest = lowest.groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("members"))
    points = rows.groupBy(*key).agg(F.count("*").alias("copies")).join(lowest, key)
    return stored(points.withColumn("pid", F.monotonically_increasing_id()), "points")


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(`df` with the number `grp` of its group, the numbers as a broadcast table)."""
    if not by:
        return df.withColumn("grp", F.lit(0)), None
    rows = df.select(*by).distinct().limit(SMALL_ROWS + 1).collect()
    if len(rows) > SMALL_ROWS:
        raise ValueError(f"more than {SMALL_ROWS} groups")
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    table = F.broadcast(df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{fields}, grp int"))
    return df.join(table, list(by)), table


class _Cells:
    """Pivots of all groups one after another, group g from start[g]; blocks and tiles of their cells."""

    def __init__(self, points: DataFrame, sizes: dict[int, int], width: int, cell_rows: int):
        room = min(MAX_PIVOTS, max(1, PIVOT_BYTES // (8 * width)))
        wanted = {g: math.ceil(n / cell_rows) for g, n in sizes.items()}
        share = min(1.0, room / sum(wanted.values()))
        chance = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, max(1, int(wanted[g] * share)) / n)])
        # a hash sample, bounded in bytes whatever the data, and a point of every group
        drawn = points.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < chance[F.col("grp")] * (1 << 30)).select("grp", "v")
        one = points.groupBy("grp").agg(F.min_by("v", "pid").alias("v"))
        by_group: dict[int, list] = {}
        for r in one.unionByName(drawn).collect():
            by_group.setdefault(r["grp"], []).append(r["v"])
        found = []
        self.start, at = {}, 0
        for g, pivots in sorted(by_group.items()):
            pivots = np.unique(np.array(pivots, float), axis=0)
            main = np.linalg.svd(pivots - pivots.mean(0), full_matrices=False)[2][0] if len(pivots) > 2 else pivots[0]
            found.append(pivots[np.argsort(pivots @ main, kind="stable")])     # near cells, near numbers
            self.start[g], at = (at, at + len(pivots)), at + len(pivots)
        self.pivots = np.concatenate(found)

    def deal(self, stats, block_rows: int, tile: int) -> None:
        """Blocks and tiles from (grp, cell, points, radius)."""
        n = len(self.pivots)
        self.radius, self.parts = np.full(n, -np.inf), np.zeros(n, "int64")
        for g, cell, many, radius in stats:
            self.radius[cell], self.parts[cell] = radius, math.ceil(many / block_rows)
        self.first = np.concatenate([[0], np.cumsum(self.parts)])
        self.tile_of = np.empty(self.first[-1], "int64")
        tiles = 0
        for begin, end in self.start.values():
            blocks = np.arange(self.first[begin], self.first[end])
            self.tile_of[blocks] = tiles + np.arange(len(blocks)) // tile
            tiles += -(-len(blocks) // tile)


def neighbour_lists(df: DataFrame, k: int = 20, id_col: str = "id", vec: str = "v",
                    metric: str = "cosine", cell_rows: int = CELL_ROWS,
                    block_rows: int = BLOCK_ROWS, tile: int = TILE_BLOCKS, by: Sequence[str] = ()) -> DataFrame:
    """(by, id, nbrs array<struct<dist, nbr_id>>): the k nearest other rows of the same
    group, nearest first, ties by id. `metric` is 'cosine' or 'euclidean'; ids are
    whole numbers or strings."""
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric: {metric}")
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    kind = kind if kind == "string" else "bigint"
    v = l2_normalize(vec) if metric == "cosine" else as_double(vec)
    numbered, groups = _grouped(df.select(*by, id_col, vec), by)
    everyone = numbered.select("grp", F.col(id_col).cast(kind).alias("id"), v.alias("v"))
    points = _points(everyone, k)
    sizes = {r["grp"]: r for r in points.groupBy("grp").agg(
        F.count("*").alias("n"), F.sum("copies").alias("rows"), F.max("copies").alias("most"), F.max(F.size("v")).alias("width")).collect()}
    nbrs = f"array<struct<dist:double,nbr_id:{kind}>>"
    if not sizes:
        fields = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
        return spark.createDataFrame([], f"{fields}id {kind}, nbrs {nbrs}")
    found = f"pid long, nbr_id {kind}, dist double"

    if max(r["n"] for r in sizes.values()) <= block_rows:      # a block holds any group
        home = points.groupBy("grp").applyInPandas(lambda pdf: _home(pdf, k, metric), found)
    else:
        cells = _Cells(points, {g: r["n"] for g, r in sizes.items()}, max(r["width"] for r in sizes.values()), cell_rows)
        pivots, start = cells.pivots, cells.start

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in _steps(batches, len(pivots)):
                cell, radius = np.zeros(len(batch), "int32"), np.zeros(len(batch))
                vectors, grp = _stack(batch["v"]), batch["grp"].to_numpy()
                for g in np.unique(grp).tolist():
                    own = np.flatnonzero(grp == g)
                    spread = _spread(vectors[own], pivots[start[g][0]:start[g][1]], metric)
                    near = spread.argmin(1)
                    cell[own], radius[own] = start[g][0] + near, spread[np.arange(len(own)), near]
                yield batch.assign(cell=cell, radius=radius)

        placed = stored(points.select("grp", "pid", "v", "members").mapInPandas(
            assign, f"grp int, pid long, v array<double>, members array<{kind}>, cell int, radius double"), "placed")
        cells.deal(placed.groupBy("grp", "cell").agg(F.count("*"), F.max("radius")).collect(), block_rows, tile)
        held = spark.sparkContext.broadcast(cells)

        def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = held.value
            for batch in batches:
                cell = batch["cell"].to_numpy()
                block = c.first[cell] + (batch["pid"].to_numpy() * 2654435761 >> 16) % np.maximum(c.parts[cell], 1)
                yield batch[["grp", "pid", "v", "members"]].assign(block=block, tile=c.tile_of[block])

        placed = stored(placed.mapInPandas(
            number, f"grp int, pid long, v array<double>, members array<{kind}>, block long, tile long"), "blocks")
        home = stored(placed.groupBy("block").applyInPandas(lambda pdf: _home(pdf, k, metric), found), "home")
        bound = home.groupBy("pid").agg(F.count("*").alias("have"), F.max("dist").alias("bound"))
        queries = placed.drop("members").join(bound, "pid")

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = held.value
            for batch in _steps(batches, max(len(c.pivots), len(c.tile_of)), ROUTE_CELLS):
                vectors, grp = _stack(batch["v"]), batch["grp"].to_numpy()
                enough = np.where(batch["have"] > k, batch["bound"].to_numpy(), np.inf)
                reach = _within(enough, metric, vectors)
                for g in np.unique(grp).tolist():
                    own = np.flatnonzero(grp == g)
                    begin, end = c.start[g]
                    room = _spread(vectors[own], c.pivots[begin:end], metric) - c.radius[None, begin:end]
                    if metric == "cosine":     # a zero vector has no angle: its cell is met by all
                        room = np.where(c.radius[None, begin:end] >= math.pi / 2 - 1e-3, -np.inf, room)
                    slack = SLACK * (1 + np.abs(np.where(np.isfinite(room), room, 0.0)))
                    q, cell = np.nonzero((room <= reach[own, None] + slack) & (c.parts[begin:end] > 0))
                    left, many = room[q, cell], c.parts[begin:end][cell]
                    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    block = np.repeat(c.first[begin:end][cell], many) + offset
                    q, left = own[np.repeat(q, many)], np.repeat(left, many)
                    away = block != batch["block"].to_numpy()[q]
                    q, left, block = q[away], left[away], block[away]
                    if not len(q):
                        continue
                    target = c.tile_of[block]
                    order = np.lexsort((target, q))
                    q, left, block, target = q[order], left[order], block[order], target[order]
                    cut = np.flatnonzero((np.diff(q) != 0) | (np.diff(target) != 0)) + 1
                    one = q[np.r_[0, cut]]
                    yield pd.DataFrame({"home": batch["tile"].to_numpy()[one], "target": target[np.r_[0, cut]],
                                        "pid": batch["pid"].to_numpy()[one], "v": batch["v"].to_numpy()[one], "bound": enough[one],
                                        "blocks": np.split(block, cut), "rooms": np.split(left, cut)})

        visits = stored(queries.mapInPandas(
            route, "home long, target long, pid long, v array<double>, bound double, blocks array<long>, rooms array<double>"), "visits")
        pairs = visits.select(F.col("home").alias("of"), F.col("target").alias("tile")).distinct()
        guests = pairs.join(placed.select("tile", "block", "v", "members"), "tile")
        away = visits.groupBy("home", "target").cogroup(guests.groupBy("of", "tile")).applyInPandas(
            lambda q, p: _meet(q, p, k, metric), found)
        home = home.unionByName(away)

    order = Window.partitionBy("pid").orderBy("dist", "nbr_id")
    best = (home.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)
            .groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("dist", "nbr_id"))).alias("near")))
    lists = points.join(best, "pid")
    out = lists.where(F.col("copies") <= k + 1).select("grp", F.explode("members").alias("id"), "near")
    if max(r["most"] for r in sizes.values()) > k + 1:
        crowds = lists.where(F.col("copies") > k + 1).select(F.struct("grp", "v").alias("gv"), "copies", "near")
        total = sum(r["rows"] for r in sizes.values())
        rows = everyone.select("id", F.struct("grp", "v").alias("gv"))
        out = out.unionByName(join_hot(rows, crowds, "gv", "copies", total).select(F.col("gv.grp").alias("grp"), "id", "near"))
    others = F.slice(F.filter("near", lambda e: e["nbr_id"] != F.col("id")), 1, k)
    out = out.select("grp", "id", others.alias("nbrs"))
    return out.drop("grp") if groups is None else out.join(groups, "grp").select(*by, "id", "nbrs")


def knn_graph(df: DataFrame, k: int = 20, id_col: str = "id", vec: str = "v",
              metric: str = "cosine", by: Sequence[str] = (), **sizes) -> DataFrame:
    """Long form: (by, id, nbr_id, dist, rank), rank from 1. Written once: a graph is
    read several times (labels, median distance, every noise rate)."""
    lists = neighbour_lists(df, k, id_col, vec, metric, by=by, **sizes)
    return stored(lists.select(*by, "id", F.posexplode("nbrs").alias("pos", "n")).select(
        *by, "id", F.col("n.nbr_id").alias("nbr_id"), F.col("n.dist").alias("dist"),
        (F.col("pos") + 1).cast("int").alias("rank")), "graph")


def with_labels(graph: DataFrame, labels: DataFrame, label: str = "y", by=(),
                id_col: str = "id") -> DataFrame:
    """The graph with `y` of the row and `nbr_y` of the neighbour; `by` names
    grid columns of the labels. Those that the graph has too are joined on, for the
    others the graph is the same. Written once, as scores read it several times."""
    same = [c for c in by if c in graph.columns]
    own = labels.select(*by, F.col(id_col).alias("id"), F.col(label).alias("y"))
    other = labels.select(*by, F.col(id_col).alias("nbr_id"), F.col(label).alias("nbr_y"))
    # a row among many copies is the neighbour of all of them: a hot key
    first = graph.join(own, [*same, "id"])
    if by:
        return join_split(stored(first, "labelled"), other, [*by, "nbr_id"], "nbr_id")
    return join_split(first, other, ["nbr_id"], "nbr_id")


def knn_disagreement(graph: DataFrame, labels: DataFrame, label: str = "y", by=(),
                     id_col: str = "id") -> DataFrame:
    """Share of the neighbours with another label."""
    differs = (F.col("nbr_y") != F.col("y")).cast("double")
    return (with_labels(graph, labels, label, by, id_col).groupBy(*by, "id")
            .agg(F.avg(differs).alias("score")))


def knn_weighted(graph: DataFrame, labels: DataFrame, label: str = "y", by=(),
                 id_col: str = "id", temperature: float | None = None) -> DataFrame:
    """The same share weighted by exp(-dist / T); T is the median neighbour
    distance (of each group that the graph has) unless given."""
    keys = [c for c in by if c in graph.columns]
    if temperature is None and keys:
        warmth = F.broadcast(medians(graph, "dist", keys).select(*keys, (F.col("median") + 1e-9).alias("warmth")))
        graph = graph.join(warmth, keys)      # as many rows as the graph has groups
    else:
        graph = graph.withColumn("warmth", F.lit(exact_median(graph, "dist") + 1e-9 if temperature is None else float(temperature)))
    weight = F.exp(-F.col("dist") / F.col("warmth"))
    differs = (F.col("nbr_y") != F.col("y")).cast("double")
    return (with_labels(graph, labels, label, by, id_col).groupBy(*by, "id")
            .agg((F.sum(weight * differs) / (F.sum(weight) + 1e-12)).alias("score")))
