"""Document fingerprints from closed syncmers.

A run of `K` characters is an anchor if the least hash of its inner runs of `S` characters lies at
its first or last place. Whether it is one depends on its own characters alone, so equal passages
have equal anchors wherever they stand. A fingerprint keeps all distinct anchors with their first
places; two fingerprints are matched by equal anchors in equal order."""
from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .neighbours import neighbour_pass
from .texts import mix

K, S = 20, 6


def _runs(codes: np.ndarray, at: np.ndarray | None, size: int) -> np.ndarray:
    """Hashes of the runs of `size` codes, of all or those that begin `at`."""
    n = len(codes) - size + 1
    total = np.zeros(n if at is None else len(at), "uint64")
    for j in range(size):
        total = total * np.uint64(0x100000001B3) + (codes[j:j + n] if at is None else codes[at + j])
    return mix(total + np.uint64(size))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def closed_syncmers(codes: np.ndarray) -> np.ndarray:
    """Places of the closed syncmers in an array of code points."""
    if len(codes) < K:
        return np.zeros(0, "int64")
    inner = _runs(codes, None, S)
    least = _sliding_min(inner, K - S + 1)
    return np.flatnonzero((inner[:len(least)] == least) | (inner[K - S:] == least))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, places) of the distinct anchors. A text shorter than K is one anchor, an empty
    one none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    if not len(codes):
        return np.zeros(0, "uint32"), np.zeros(0, "uint32")
    at = closed_syncmers(codes)
    size = K if len(at) else len(codes)
    if not len(at):
        at = np.zeros(1, "int64")
    found, first = np.unique((_runs(codes, at, size) >> np.uint64(32)).astype("uint32"), return_index=True)
    return found, at[first].astype("uint32")


def pack_anchors(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of: the number of anchors, their hashes by place, the steps from place to place. Numbers
    and hashes have four bytes, steps as many groups of seven bits as they need, lowest first."""
    if not len(found[0]):
        return ""
    order = np.argsort(found[1], kind="stable")
    steps = np.diff(found[1][order].astype("int64"), prepend=0)
    groups = steps[:, None] >> np.arange(0, 35, 7)
    more = np.zeros(groups.shape, bool)
    more[:, :-1] = groups[:, 1:] > 0
    used = np.ones(groups.shape, bool)
    used[:, 1:] = groups[:, 1:] > 0
    coded = (groups & 127 | more * 128)[used].astype("uint8")
    head = np.concatenate([[len(order)], found[0][order]]).astype("<u4")
    return base64.b64encode(head.tobytes() + coded.tobytes()).decode()


def unpack_anchors(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    if not fingerprint:
        return np.zeros(0, "uint32"), np.zeros(0, "uint32")
    data = base64.b64decode(fingerprint)
    n = int.from_bytes(data[:4], "little")
    hashes, coded = np.frombuffer(data[4:4 + 4 * n], "<u4"), np.frombuffer(data[4 + 4 * n:], "uint8").astype("int64")
    starts = np.concatenate([[0], np.flatnonzero(coded < 128)[:-1] + 1])
    nth = np.arange(len(coded)) - np.repeat(starts, np.diff(starts, append=len(coded)))
    places = np.cumsum(np.add.reduceat((coded & 127) << 7 * nth, starts)).astype("uint32")
    order = np.argsort(hashes, kind="stable")
    return hashes[order], places[order]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the texts' anchors that match in order, 0 to 1 (Dice's measure, so half a text in
    common is about 0.5). Two empty texts are alike."""
    if len(a[0]) == len(b[0]) and (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    if not len(a[0]) or not len(b[0]):
        return 0.0
    shared, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    places = a[1][in_a], b[1][in_b]
    tails: list[int] = []             # longest run of anchors in the same order
    for x in places[1][np.argsort(places[0], kind="stable")].tolist():
        k = bisect_left(tails, x)
        tails[k:k + 1] = [x]
    return 2 * len(tails) / (len(a[0]) + len(b[0]) - len(shared) + len(tails))


def fingerprint(text: str | None) -> str:
    return pack_anchors(anchors(text or ""))


RESULT = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()),
    ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()),
    ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])


def fingerprint_documents(documents: DataFrame, partitions: int) -> DataFrame:
    """`RESULT`: the fingerprint of every document and of its edited text, whose last half is the
    beginning of the next document by descending doc_id (after the last the first).

    Null text is empty. Rows of equal doc_id follow one another by a hash of their content; null ids
    come last. A single document is its own next. One shuffle moves the texts."""
    kind = documents.schema["doc_id"].dataType
    result = T.StructType([T.StructField("doc_id", T.StringType()), *RESULT.fields[1:]])

    def visit(_, row, after):
        text, following = row[1] or "", after[1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, other = anchors(text), anchors(edited)
        return (row[0], len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                pack_anchors(own), pack_anchors(other), likeness(own, other), likeness(own, anchors(following)))

    # as text of equal width, so that the least id has a key too; null ids come last
    back = F.lit((1 << 63) - 1).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)")
    key = F.coalesce(F.lpad(back.cast("string"), 20, "0"), F.lit("~"))
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")       # pandas would make ids beside a null floats
    found = neighbour_pass(rows, key, ["doc_id", "text"], visit, result, partitions, wrap=True)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
