"""Near-duplicate vectors: products of int8 tiles with proven error bounds, full precision where they leave a pair open.

A unit vector x is held as step * q, q of int8 codes, and ||x - step * q|| = rest is known. For two such
vectors |x.y - (step q).(step' q')| <= rest + rest' + rest * rest', so the integer product decides most pairs;
the others are worked out in double precision, in the same task.

Equal vectors of one label are one class. The classes of a label are dealt to blocks of about `BLOCK`,
and a task holds two blocks. It gives the number of links of each class and a spanning forest of the
links, not the links: a row or two per vector, however dense a group is."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from ..sizes import small_table
from .components import components

COSINE = 0.98
BLOCK = 8192                 # classes in a block, about
ROWS, COLUMNS = 512, 4096    # of a product
PAIRS = 1 << 14              # worked out together in double precision
SLACK = 1e-6                 # above the rounding of the products' scaling in single precision
EXACT_SINGLE = (1 << 24) // 127**2    # components up to which integer products are exact in single precision


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that squares neither vanish nor overflow."""
    vectors = vectors.astype("float64")
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, step, length of the rest) of unit vectors."""
    step = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / step[:, None]).astype("int8")
    rest = np.sqrt(((vectors - step[:, None] * codes) ** 2).sum(axis=1)) + 1e-12
    return codes, step, rest


class Side:
    def __init__(self, vectors: np.ndarray):
        self.unit = unit(vectors)
        self.codes, self.step, self.rest = quantise(self.unit)


def _exact(a: Side, b: Side, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the pairs reach `least` in double precision."""
    if not len(i):
        return np.zeros(0, bool)
    span = (i.max() - i.min() + 1) * (j.max() - j.min() + 1)
    if 8 * len(i) > span:
        whole = a.unit[i.min():i.max() + 1] @ b.unit[j.min():j.max() + 1].T
        return whole[i - i.min(), j - j.min()] >= least
    return np.concatenate([np.einsum("ij,ij->i", a.unit[i[k:k + PAIRS]], b.unit[j[k:k + PAIRS]]) >= least
                           for k in range(0, len(i), PAIRS)])


def tile_links(a: Side, b: Side, least: float, same: bool):
    """Yields (rows, columns, pairs worked out in full) of the linked pairs of two blocks, piece by piece;
    `same` blocks give each pair once."""
    kind = "float32" if a.unit.shape[1] <= EXACT_SINGLE else "float64"
    for r in range(0, len(a.unit), ROWS):
        rows = slice(r, r + ROWS)
        codes, rest = a.codes[rows].astype(kind), a.rest[rows]
        for c in range(r if same else 0, len(b.unit), COLUMNS):
            columns = slice(c, c + COLUMNS)
            product = codes @ b.codes[columns].astype(kind).T
            product *= a.step[rows, None].astype(kind)
            product *= b.step[columns].astype(kind)
            bound = rest[:, None].astype(kind) + (1 + rest[:, None]).astype(kind) * b.rest[columns].astype(kind) + kind_slack(kind)
            i, j = np.nonzero(product + bound >= least)
            if same:
                once = i + r < j + c
                i, j = i[once], j[once]
            sure = product[i, j] - bound[i, j] >= least
            open_ = np.flatnonzero(~sure)
            sure[open_] = _exact(a, b, i[open_] + r, j[open_] + c, least)
            yield i[sure] + r, j[sure] + c, len(open_)


def kind_slack(kind: str):
    return np.dtype(kind).type(SLACK)


def _forest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the trees of linked items; `root` names the tree of every item and is kept up."""
    edges = []
    first, begin = np.unique(i, return_index=True)
    for item, partners in zip(first.tolist(), np.split(j, begin[1:])):
        trees = np.unique(np.append(root[partners], root[item]))
        if len(trees) > 1:
            edges += [(int(trees[0]), int(t)) for t in trees[1:]]
            root[np.isin(root, trees[1:])] = trees[0]
    return edges


def _tile(least: float):
    def work(key, table):
        block = table.column("block").to_numpy()
        one, other = key[-2].as_py(), key[-1].as_py()
        size = key[1].as_py()
        ids, weight = table.column("cls").to_numpy(), table.column("weight").to_numpy()
        vectors = table.column("embedding").combine_chunks()
        vectors = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        at_a, at_b = np.flatnonzero(block == one), np.flatnonzero(block == other)
        same = one == other
        a = Side(vectors[at_a]) if len(at_a) else None
        b = a if same else Side(vectors[at_b]) if len(at_b) else None
        links, root, edges = np.zeros(len(ids)), np.arange(len(ids)), []
        if a is not None and b is not None:
            for i, j, _ in tile_links(a, b, least, same):
                if len(i):
                    i, j = at_a[i], at_b[j]
                    links += np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
                    edges += _forest(root, i, j)
        linked = np.flatnonzero(links)
        left, right = ids[[x for x, _ in edges]], ids[[y for _, y in edges]]
        return pa.table({"a": np.concatenate([ids[linked], left]),
                         "b": pa.array(np.concatenate([ids[linked], right]), mask=np.arange(len(linked) + len(right)) < len(linked)),
                         "links": np.concatenate([links[linked].astype("int64"), np.zeros(len(left), "int64")])})
    return work


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each of `vectors` (vec_id, embedding, label); other
    columns are not read.

    Vectors are compared when label and length are equal. Those that are null, of zeros only, empty, or
    hold a null or a component that is not finite, and those without a label, link with nothing.
    Repeated rows and ids are vectors of their own. component_id is the least vec_id that links reach
    (nulls aside); kept says that it is the vector's own id, for a null id that it is null too."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.col("label").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding", "label", F.when(F.coalesce(valid, F.lit(False)), F.xxhash64("embedding")).alias("k1"),
                          F.xxhash64(F.lit(5), "embedding").alias("k2"))
    keys = ["label", "k1", "k2"]
    classes = stored(rows.where("k1 IS NOT NULL").groupBy(*keys)
                     .agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
                     .withColumns({"cls": F.monotonically_increasing_id(), "length": F.size("embedding")}), "classes")
    n = small_table(classes.groupBy("label", "length").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    dealt = classes.join(n, ["label", "length"]).select(
        "label", "length", "cls", "weight", "embedding", F.pmod("k1", "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = dealt.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other")
    found = stored(tiles.groupBy("label", "length", "one", "two").applyInArrow(_tile(cosine), "a long, b long, links long"), "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    groups = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cls")
    member = stored(classes.drop("embedding").join(counts, "cls", "left").join(groups, "cls", "left")
                    .withColumn("component", F.coalesce("component", "cls")), "members")
    least = member.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = member.join(least, "component").select(*keys, "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.lit(True).alias("found"))
    return rows.drop("embedding").join(named, keys, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


# The same for DuckDB: all pairs of a label, components by reachability.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id"""
