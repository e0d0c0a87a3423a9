"""Random forests grown where the rows are.

The numbers of a row become one byte each: its place among at most 255 cuts per column, which are taken
from all training rows. A task gets the bytes of all rows of its forest, grows its share of the trees,
asks them for the rows they have not seen, and gives one sum per row. So a forest is one job, whatever its
depth, no tree leaves its task, and nothing of it lies in the driver. All forests of a table (folds, groups)
are the same job.

Trees are those of `RandomForestClassifier`: Poisson(1) bootstrap, ceil(sqrt(columns)) columns tried per node,
Gini, no split without a gain. Draws are hashes of (seed, tree, row), so they don't depend on partitions."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CUTS = 255                   # places a byte can tell apart, less one
MARKS = 1024                 # values a task gives per column; ranks are off by less than 1/1024 of its rows
HELD = 1 << 14               # distinct values per column that a task holds before they are thinned
STEP_ROWS = 1 << 19          # rows whose splits are sought together
TASK_BYTES = 96 << 20        # bytes of one forest's rows that a task may hold
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def _thin(value: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with counts, as `most` marks of about equal weight if there are more."""
    if len(value) <= most:
        return value, count
    upto = np.cumsum(count)
    at = np.unique(np.searchsorted(upto, np.linspace(upto[-1] / most, upto[-1], most)).clip(0, len(value) - 1))
    return value[at], np.diff(upto[at], prepend=0)


def _merge(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    value, where = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return value, np.bincount(where.ravel(), np.concatenate([c for _, c in parts]), len(value)).astype("int64")


def _cuts(value: np.ndarray, count: np.ndarray, most: int = CUTS) -> np.ndarray:
    """At most `most` cuts between sorted distinct values: between all if they are few, else of equal weight."""
    if len(value) < 2:
        return np.zeros(0)
    upto = np.cumsum(count)
    at = np.arange(len(value) - 1)
    if len(at) > most:
        at = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], most + 2)[1:-1]).clip(0, len(value) - 2))
    below, above = value[at], value[at + 1]
    with np.errstate(invalid="ignore", over="ignore"):
        middle = (below + above) / 2
    return np.where((middle > below) & (middle < above), middle, below)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equally long lists."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return flat.reshape(len(vectors), -1)


def column_cuts(rows: DataFrame, vec: str) -> dict[int, list[np.ndarray]]:
    """{grp: cuts of each column} from all rows (grp, vec)."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            x, grp = _matrix(batch.column(vec)), batch.column("grp").to_numpy()
            for g in np.unique(grp).tolist():
                own = x[grp == g]
                for j in range(x.shape[1]):
                    value, count = np.unique(own[:, j], return_counts=True)
                    value, count = (a[:np.searchsorted(value, np.nan)] for a in (value, count))     # NaN comes last
                    parts = found.setdefault((g, j), [])
                    parts.append((value, count))
                    if sum(len(v) for v, _ in parts) > HELD:
                        found[g, j] = [_thin(*_merge(parts), HELD // 4)]
        for (g, j), parts in found.items():
            value, count = _thin(*_merge(parts), MARKS)
            yield pa.record_batch({"grp": pa.array([g] * len(value), pa.int32()), "col": pa.array([j] * len(value), pa.int32()),
                                   "value": pa.array(value), "n": pa.array(count)})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        value, count = _merge([(pdf["value"].to_numpy(), pdf["n"].to_numpy())])
        return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "col": pdf["col"].iloc[:1], "cuts": [_cuts(value, count).tolist()]})

    marks = rows.select("grp", vec).mapInArrow(sketch, "grp int, col int, value double, n long")
    out: dict[int, list[np.ndarray]] = {}
    for r in sorted(marks.groupBy("grp", "col").applyInPandas(join, "grp int, col int, cuts array<double>").collect()):
        columns = out.setdefault(r["grp"], [])
        columns += [np.zeros(0)] * (r["col"] - len(columns)) + [np.array(r["cuts"])]
    return out


def as_bytes(rows: DataFrame, vec: str, cuts: dict[int, list[np.ndarray]]) -> DataFrame:
    """`rows` with `vec` as `x` binary: of each column the number of cuts below the value."""
    kept = [c for c in rows.columns if c != vec]
    held = rows.sparkSession.sparkContext.broadcast(cuts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, grp = _matrix(batch.column(vec)), batch.column("grp").to_numpy()
            code = np.zeros(x.shape, "uint8")
            for g in np.unique(grp).tolist():
                own = np.flatnonzero(grp == g)
                for j, cut in enumerate(held.value.get(g, [])):
                    code[own, j] = np.searchsorted(cut, x[own, j])
            at = pa.py_buffer((np.arange(len(x) + 1) * x.shape[1]).astype("int32"))
            data = pa.Array.from_buffers(pa.binary(), len(x), [None, at, pa.py_buffer(np.ascontiguousarray(code))])
            yield pa.record_batch({**{c: batch.column(c) for c in kept}, "x": data})

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.select(*kept, vec).mapInArrow(work, f"{kinds}x binary")


def _weights(mark: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in the tree's bootstrap: Poisson(1) by a hash (splitmix64) of (seed, tree, mark)."""
    with np.errstate(over="ignore"):
        z = mark.view("uint64") + np.uint64(((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(11)) / float(1 << 53), "right").astype("uint8")


def _purity(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sum over both sides of (sum of squared class counts) / count: the larger, the lower the Gini
    impurity. -inf where a side is empty. The last axis are the classes."""
    a = b = above = below = 0.0
    for c in range(total.shape[-1]):         # few, so faster than sums over an axis
        one, other = left[..., c], total[..., c] - left[..., c]
        a, b, above, below = a + one, b + other, above + one * one, below + other * other
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((a > 0) & (b > 0), above / a + below / b, -np.inf)


def _best(code: np.ndarray, node: np.ndarray, y: np.ndarray, weight: np.ndarray, nodes: int, classes: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(purity, cut) of the best split of each node by one column each; of equal ones the lowest cut."""
    key = ((node << 8 | code) * classes + y)
    if len(code) >= nodes << 8:
        left = np.bincount(key, weight, (nodes << 8) * classes).reshape(nodes, 256, classes).cumsum(1)
        purity = _purity(left, total[:, None])
        cut = purity.argmax(1)
        return purity[np.arange(nodes), cut], cut
    # nodes of few rows: sorted, as most of their counts would be 0
    key = np.sort(key << 8 | weight)
    amount, key = key & 255, key >> 8
    place, of = key // classes, key % classes
    end = np.flatnonzero(np.r_[place[1:] != place[:-1], True])
    place = place[end]
    owner = place >> 8
    first = np.searchsorted(owner, np.arange(nodes))
    left = np.stack([np.cumsum(np.where(of == c, amount, 0))[end] for c in range(classes)], axis=1).astype(float)
    before = np.concatenate([np.zeros((1, classes)), left])[first]
    purity = _purity(left - before[owner], total[owner])
    best = np.maximum.reduceat(purity, first)
    hit = np.flatnonzero(purity == best[owner])
    return best, place[hit[np.searchsorted(owner[hit], np.arange(nodes))]] & 255


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """A tree over the rows of positive weight: (column or -1, cut, left child, class shares) by node, the
    right child after the left. Grown level by level; rows of a node lie one after another."""
    width = x.shape[1]
    tries, flat = math.ceil(math.sqrt(width)), x.reshape(-1)
    rows = np.flatnonzero(weight).astype("int64")
    y, weight = y[rows].astype("int64"), weight[rows].astype("int64")
    size = np.array([len(rows)])
    column, cut, left, share, after = [], [], [], [], 1
    for level in range(depth + 1):
        node = np.repeat(np.arange(len(size)), size)
        total = np.bincount(node * classes + y, weight, len(size) * classes).reshape(-1, classes)
        share.append(total / np.maximum(total.sum(1, keepdims=True), 1))
        column.append(np.full(len(size), -1, "int32"))
        cut.append(np.zeros(len(size), "uint8"))
        left.append(np.zeros(len(size), "int32"))
        impure = np.flatnonzero((total > 0).sum(1) > 1) if level < depth else np.zeros(0, "int64")
        if not len(impure):
            break
        begin, at = np.cumsum(size) - size, 0
        ends = np.cumsum(size[impure])
        while at < len(impure):
            done = ends[at - 1] if at else 0
            last = min(max(at + 1, int(np.searchsorted(ends, done + STEP_ROWS, "right"))), at + STEP_ROWS // width + 1)
            own = impure[at:last]
            many = size[own]
            here = np.repeat(np.arange(len(own)), many)
            pos = np.arange(len(here)) + np.repeat(begin[own] - (np.cumsum(many) - many), many)
            tried = rng.random((len(own), width)).argpartition(tries - 1, axis=1)[:, :tries] if tries < width else np.tile(np.arange(width), (len(own), 1))
            base, ys, ws, sums = rows[pos] * width, y[pos], weight[pos], total[own]
            best = (sums * sums).sum(1) / sums.sum(1) * (1 + 1e-12)      # as it is without a split
            for j in range(tries):
                purity, place = _best(flat[base + tried[here, j]].astype("int64"), here, ys, ws, len(own), classes, sums)
                better = np.flatnonzero(purity > best)
                best[better] = purity[better]
                column[-1][own[better]], cut[-1][own[better]] = tried[better, j], place[better]
            at = last
        split = column[-1] >= 0
        children = 2 * int(split.sum())
        if not children:
            break
        left[-1][split] = after + 2 * np.arange(children // 2)
        after += children
        moved = split[node]
        rows, y, weight, node = rows[moved], y[moved], weight[moved], node[moved]
        child = 2 * (np.cumsum(split) - 1)[node] + (flat[rows * width + column[-1][node]] > cut[-1][node])
        order = np.sort(child << 32 | np.arange(len(child))) & 0xFFFFFFFF
        rows, y, weight = rows[order], y[order], weight[order]
        size = np.bincount(child, minlength=children)
    return np.concatenate(column), np.concatenate(cut), np.concatenate(left), np.concatenate(share)


def ask(tree: tuple[np.ndarray, ...], x: np.ndarray, asked: np.ndarray, out: np.ndarray) -> None:
    """Adds the class shares of the leaves of the rows `asked` to `out`."""
    column, cut, left, share = tree
    for first in range(0, len(asked), 1 << 16):
        own = asked[first:first + (1 << 16)]
        part = x[own]
        node, live = np.zeros(len(part), "int64"), np.arange(len(part))
        while len(live := live[column[node[live]] >= 0]):
            at = node[live]
            node[live] = left[at] + (part[live, column[at]] > cut[at])
        out[own] += share[node]


def _votes(table: pa.Table, part: int, parts: int, trees: int, seed: int, depth: int, classes: int) -> pa.Table:
    """(row, p0, p1, ...): the sums of every `parts`-th tree for the rows to be scored; equal rows once."""
    mark, fold, y = (table.column(c).to_numpy() for c in ("row", "fold", "y"))
    x, at = np.empty((len(mark), len(table.column("x")[0].as_py())), "uint8"), 0
    for chunk in table.column("x").chunks:
        begin = np.frombuffer(chunk.buffers()[1], "int32", 1, 4 * chunk.offset)[0]
        x[at:at + len(chunk)] = np.frombuffer(chunk.buffers()[2], "uint8", len(chunk) * x.shape[1], begin).reshape(len(chunk), -1)
        at += len(chunk)
    out = np.zeros((len(mark), classes))
    folds = [(f, np.flatnonzero(fold == f)) for f in np.unique(fold[fold >= 0]).tolist()]
    for tree in range(part, trees, parts):
        weight = _weights(mark, seed, tree)
        for f, asked in folds:
            grown = grow(x, y, np.where(fold == f, 0, weight), classes, depth, np.random.default_rng([seed & 0xFFFFFFFF, tree, f]))
            ask(grown, x, asked, out)
    scored = np.flatnonzero(fold >= 0)
    _, first = np.unique(mark[scored], return_index=True)
    scored = scored[first]
    return pa.table({"row": mark[scored], **{f"p{c}": out[scored, c] for c in range(classes)}})


def votes(table: DataFrame, sizes: dict[int, int], classes: int, trees: int, seed: int, depth: int) -> DataFrame:
    """(row, p): the mean over all trees for the rows of `table` (grp, row, fold, y, x) whose fold is not
    negative, each from the trees grown on the other folds of its group."""
    slots = table.sparkSession.sparkContext.defaultParallelism
    parts = min(trees, max(1, -(-slots // len(sizes))))
    keys = len(sizes) * parts
    sent = table.withColumn("task", F.explode(F.sequence(F.col("grp") * parts, F.col("grp") * parts + (parts - 1))))
    fields = "".join(f", p{c} double" for c in range(classes))
    sums = sent.select("task", "row", "fold", "y", "x").repartitionById(keys, "task").groupBy("task").applyInArrow(
        lambda key, rows: _votes(rows, key[0].as_py() % parts, parts, trees, seed, depth, classes), f"row long{fields}")
    sums = sums.groupBy("row").agg(*[F.sum(f"p{c}").alias(f"p{c}") for c in range(classes)])
    return sums.select("row", F.array(*[F.col(f"p{c}") / trees for c in range(classes)]).alias("p"))
