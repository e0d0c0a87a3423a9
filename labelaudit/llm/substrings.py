"""Removal of byte strings that an earlier document has, by sorting suffixes where they can be equal.

Every string of `LENGTH` bytes has an anchor: of its inner strings of `KEY` bytes the one of least
hash. Equal strings have equal anchors at equal places, so only strings around equal anchors need to
meet. A task walks its documents once and leaves a row per anchor, not per byte: hash of the key,
hash of the context (all bytes of the strings that have this anchor), document and place.

  1. Rows of a key meet in one partition. A context that a lesser document has too is removed whole.
  2. What is left are keys in several documents with different contexts (a few in a hundred). Their
     bytes are fetched, one per context, and the strings of a key are sorted by the deep-shallow
     method: multikey quicksort on words of eight bytes to a shallow depth, then blind tries for the
     groups that share a longer prefix. Equal neighbours show which strings a lesser document has.
     Keys with more than `MANY` contexts (the edges of a passage that very many documents share) are
     not held by one task: hashes of their strings are counted by Spark, with partial sums.
  3. The removed stretches of a document are merged and cut out of its text."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import stored
from .syncmers import _sliding_min
from .texts import BASE, Powers, chunks, mix, raw

LENGTH = 50
KEY = 20
SPAN = LENGTH - KEY + 1      # strings that may have one anchor
MANY = 2000
SHALLOW = 40                 # bytes sorted by quicksort; longer common prefixes go to tries
TOGETHER = 100_000           # strings sorted together, whole keys
LAST_DOC = (1 << 63) - 1     # order of a null id


# --- anchors ---

def anchors(data: np.ndarray, offsets: np.ndarray, table: Powers) -> tuple[np.ndarray, ...]:
    """(text number, key, context, first, back, more) of every anchor of the texts: the strings that
    have it begin at first to first + more, and the anchor lies `back` bytes after the first begin."""
    part, bounds = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    n = len(part)
    empty = tuple(np.zeros(0, t) for t in ("int64", "uint64", "uint64", "int64", "int64", "int64"))
    if n < LENGTH:
        return empty
    up, down = table.upto(n + 1)
    total = np.zeros(n + 1, "uint64")
    np.cumsum((part.astype("uint64") + np.uint64(1)) * up[:n], out=total[1:])
    keys = mix((total[KEY:] - total[:-KEY]) * down[:n - KEY + 1])
    bits = np.uint64(max(24, int(n).bit_length()))        # one precision for all texts up to 16 MB
    least = _sliding_min((keys >> bits << bits) | np.arange(len(keys), dtype="uint64"), SPAN)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype("int64")
    begin = np.arange(len(at))
    doc = np.searchsorted(bounds, begin, "right") - 1
    inside = begin + LENGTH <= bounds[doc + 1]
    begin, at, doc = begin[inside], at[inside], doc[inside]
    if not len(begin):
        return empty
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(fresh)
    first, last = begin[starts], begin[np.append(starts[1:], len(begin)) - 1]
    doc, at = doc[starts], at[starts]
    context = (total[last + LENGTH] - total[first]) * down[first]
    context = mix(context + mix((at - first).astype("uint64") * np.uint64(SPAN) + (last - first).astype("uint64")))
    return doc, keys[at], context, first - bounds[doc], at - first, last - first


def merge(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [first, end) of one text, merged where they touch."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(first), bool)
    fresh[1:] = first[1:] > end[:-1]
    starts = np.flatnonzero(fresh)
    return first[starts], end[np.append(starts[1:], len(first)) - 1]


def anchor_rows(documents: DataFrame) -> DataFrame:
    """(key, context, doc, tag, first, back, more) for documents (doc, tag, text), dealt by key. Contexts that a lesser
    document of the same batch has are settled at once: their merged stretches are rows with back -1
    and the end in `more`."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "context", "doc", "tag", "place")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Powers(BASE)
        for batch in batches:
            docs, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = raw(batch.column(2))
            found = [(a + x[0], *x[1:]) for a, b in chunks(offsets) for x in [anchors(data, offsets[a:b + 1], table)]]
            row, key, context, first, back, more = (np.concatenate(x) for x in zip(*found)) if found else anchors(data[:0], np.zeros(1, "int64"), table)
            order = np.lexsort((docs[row], context, key))
            row, key, context, first, back, more = (x[order] for x in (row, key, context, first, back, more))
            fresh = np.ones(len(row), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
            least = docs[row][np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(row) else docs[:0]
            later = least < docs[row]
            # place: first, back and more in one number; a settled stretch is -1 - first, its end the context
            here = ~later
            out = [[key[here].view("int64"), context[here].view("int64"), docs[row[here]], tags[row[here]],
                    (first[here] * SPAN + back[here]) * SPAN + more[here]]]
            gone = np.flatnonzero(later)
            gone = gone[np.argsort(row[gone], kind="stable")]
            edges = np.flatnonzero(np.diff(row[gone])) + 1
            for some in np.split(gone, edges) if len(gone) else ():
                begin, end = merge(first[some], first[some] + more[some] + LENGTH)
                k = row[some[0]]
                spread = mix(begin.astype("uint64") + mix(np.full(len(begin), docs[k]).astype("uint64")))
                out.append([spread.view("int64"), end, np.full(len(begin), docs[k]), np.full(len(begin), tags[k]), -1 - begin])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype("int64")) for x in zip(*out)], names=schema.names)

    # the five numbers are moved, once: both groupings below lie inside that of the keys
    rows = documents.mapInArrow(run, schema).repartition("key")
    place, settled = F.col("place"), F.col("place") < 0
    return rows.select(
        "key", "context", "doc", "tag", F.when(settled, -1 - place).otherwise(F.expr(f"place div {SPAN * SPAN}")).alias("first"),
        F.when(settled, -1).otherwise(F.pmod(F.expr(f"place div {SPAN}"), F.lit(SPAN))).cast("int").alias("back"),
        F.when(settled, F.col("context")).otherwise(F.pmod(place, F.lit(SPAN))).alias("more"))


# --- deep-shallow sorting of strings of LENGTH bytes ---

def blind_trie_order(texts: list[bytes], numbers: list[int], depth: int) -> list[list[int]]:
    """`numbers` of strings that agree up to `depth`, in sorted order, equal ones in one list. A node
    keeps the place where its strings first differ and a branch per byte there, and no strings: an
    insertion walks down blindly, compares once with a leaf, and puts the new branch where they part."""
    root: list | None = None             # leaf: [None, numbers]; node: [place, {byte: child}]
    for i in numbers:
        text = texts[i]
        if root is None:
            root = [None, [i]]
            continue
        node = root
        while node[0] is not None:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = texts[node[1][0]]
        at = depth
        while at < LENGTH and text[at] == other[at]:
            at += 1
        if at == LENGTH:
            node[1].append(i)
            continue
        node, above = root, None
        while node[0] is not None and node[0] < at:
            above, node = node, node[1][text[node[0]]] if text[node[0]] in node[1] else None
            if node is None:
                break
        if node is None or node[0] == at:
            (above if node is None else node)[1][text[at]] = [None, [i]]
            continue
        fresh = [at, {other[at]: node, text[at]: [None, [i]]}]
        if above is None:
            root = fresh
        else:
            above[1][text[above[0]]] = fresh
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out.append(node[1])
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def equal_strings(strings: np.ndarray, lead: np.ndarray | None = None) -> list[np.ndarray]:
    """Groups of equal rows of an (n, LENGTH) byte array, in sorted order of `lead` and the strings.
    All groups of a depth are sorted in one go; `lead` keeps strings apart that need not meet."""
    padded = np.zeros((len(strings), -(-LENGTH // 8) * 8), "uint8")
    padded[:, :LENGTH] = strings
    words = padded.view(">u8").astype("uint64")
    group = np.zeros(len(strings), "int64") if lead is None else lead
    rows, depth = np.arange(len(strings)), 0
    while depth < SHALLOW and len(rows):    # multikey quicksort, one word at a time
        word = words[rows, depth // 8]
        order = np.lexsort((word, group))
        rows, group, word = rows[order], group[order], word[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        group = np.cumsum(fresh) - 1
        kept = np.bincount(group)[group] > 1
        rows, group, depth = rows[kept], group[kept], depth + 8
    out = []
    for g in np.split(rows, np.flatnonzero(np.diff(group)) + 1) if len(rows) else ():
        g = g.tolist()
        texts = {i: strings[i].tobytes() for i in g}
        out += [np.array(x) for x in blind_trie_order(texts, g, depth) if len(x) > 1]
    return out


def _windows(body: bytes, more: int) -> np.ndarray:
    flat = np.frombuffer(body, "uint8")
    return np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[:more + 1]


def resolve(contexts: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """For each (key number, doc, more, bytes), which of its strings a lesser doc of its key has."""
    sizes = np.array([c[2] + 1 for c in contexts])
    docs = np.repeat(np.array([c[1] for c in contexts]), sizes)
    strings = np.concatenate([_windows(c[3], c[2]) for c in contexts])
    gone = np.zeros(len(strings), bool)
    for group in equal_strings(strings, np.repeat(np.array([c[0] for c in contexts]), sizes)):
        gone[group] = docs[group] > docs[group].min()
    return np.split(gone, np.cumsum(sizes)[:-1])


def contested(kept: DataFrame, documents: DataFrame) -> DataFrame:
    """(key, context, gone): which strings of a context a lesser document has, as a text of 0 and 1, for
    contexts of keys that several documents have."""
    each = (kept.where("back >= 0 AND doc = least").groupBy("key", "context")
            .agg(F.min(F.struct("doc", "tag", "first", "more")).alias("x")).select("key", "context", "x.*"))
    asked = each.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "context", "first", "more")).alias("asked"))
    joined = documents.join(asked, ["doc", "tag"]).select("doc", "asked", "text")
    schema = "key long, context long, doc long, more int, body binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(2))
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            key, context, first, more = (flat.field(k) for k in range(4))
            begin = np.repeat(offsets[:-1], sizes) + first.to_numpy(zero_copy_only=False)
            bodies = [data[b:b + m + LENGTH].tobytes() for b, m in zip(begin.tolist(), more.to_numpy(zero_copy_only=False).tolist())]
            docs = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([key, context, pa.array(docs), more.cast(pa.int32()), pa.array(bodies, pa.binary())],
                                             names=["key", "context", "doc", "more", "body"])

    bodies = joined.mapInArrow(cut, schema).dropDuplicates(["key", "context"])
    bodies = stored(bodies.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "contexts")
    few, many = bodies.where(F.col("n") <= MANY), bodies.where(F.col("n") > MANY)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, held, names, strings = None, 0, [], [], 0

        def settle():
            found = [(*name, "".join("01"[int(x)] for x in gone)) for name, gone in zip(names, resolve(held)) if gone.any()] if held else []
            return pd.DataFrame(found, columns=["key", "context", "gone"])

        for pdf in batches:
            for k, context, doc, more, body in pdf.itertuples(index=False, name=None):
                if k != key:
                    key, number = k, number + 1
                    if strings > TOGETHER:
                        yield settle()
                        held, names, strings = [], [], 0
                held.append((number, doc, more, body))
                names.append((k, context))
                strings += more + 1
        yield settle()

    sorted_few = (few.select("key", "context", "doc", "more", "body").repartition("key").sortWithinPartitions("key")
                  .mapInPandas(sort, "key long, context long, gone string"))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, context, doc, more, body in pdf.itertuples(index=False, name=None):
                for i in range(more + 1):
                    digest = hashlib.blake2b(body[i:i + LENGTH], digest_size=16).digest()
                    out.append((k, context, doc, i, more, digest))
            yield pd.DataFrame(out, columns=["key", "context", "doc", "at", "more", "string"])

    strings = many.select("key", "context", "doc", "more", "body").mapInPandas(
        hashes, "key long, context long, doc long, at int, more int, string binary")
    least = strings.groupBy("string").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    gone = strings.join(least, "string").where("doc > least").groupBy("key", "context", "more").agg(F.collect_set("at").alias("at"))
    sorted_many = gone.select("key", "context", F.expr(
        "array_join(transform(sequence(0, more), i -> if(array_contains(at, i), '1', '0')), '')").alias("gone"))
    return sorted_few.unionByName(sorted_many)


def removed_stretches(documents: DataFrame) -> DataFrame:
    """(doc, tag, spans array of (first, end)) for documents (doc, tag, text)."""
    by_key, by_context = Window.partitionBy("key"), Window.partitionBy("key", "context")
    rows = anchor_rows(documents).withColumn("least", F.min(F.when(F.col("back") >= 0, F.col("doc"))).over(by_context))
    own = F.when((F.col("back") >= 0) & (F.col("doc") == F.col("least")), F.col("doc"))
    rows = rows.withColumns({"low": F.min(own).over(by_key), "high": F.max(own).over(by_key)})
    kept = stored(rows.where("back < 0 OR least < doc OR low < high").drop("low", "high"), "anchors")
    whole = kept.where("back < 0 OR least < doc").select(
        "doc", "tag", "first", F.when(F.col("back") < 0, F.col("more")).otherwise(F.col("first") + F.col("more") + LENGTH).alias("end"))
    masks = contested(kept, documents)
    parts = (kept.where("back >= 0 AND doc = least").join(masks, ["key", "context"])
             .select("doc", "tag", "first", F.posexplode(F.split("gone", "")).alias("at", "one")).where("one = '1'")
             .select("doc", "tag", (F.col("first") + F.col("at")).alias("first"), (F.col("first") + F.col("at") + LENGTH).alias("end")))
    found = stored(whole.unionByName(parts).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("first", "end")).alias("spans")), "stretches")
    return found


def remove_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every document row: each byte
    covered by a string of `LENGTH` bytes that also begins in a document of lesser doc_id is removed.

    Null text is empty. Rows of one id are not earlier than each other and lose nothing to one
    another; null ids come after all others, none before another."""
    tagged = documents.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC)).alias("doc"),
        F.xxhash64("text").alias("tag"), "text")        # equal rows lose the same bytes
    spans = removed_stretches(tagged.select("doc", "tag", "text"))
    kind = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                           T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(2))
            lists = batch.column(1)
            size, removed, count, digest, kept = [], [], [], [], []
            for k in range(batch.num_rows):
                text = data[offsets[k]:offsets[k + 1]]
                rest, spans = text.tobytes(), 0
                if lists[k].is_valid:
                    both = lists[k].values
                    first, end = merge(*(both.field(x).to_numpy(zero_copy_only=False) for x in (0, 1)))
                    edges = np.concatenate([[0], np.stack([first, end], 1).ravel(), [len(text)]])
                    rest = b"".join(text[a:b].tobytes() for a, b in edges.reshape(-1, 2).tolist())
                    spans = len(first)
                size.append(len(text))
                removed.append(len(text) - len(rest))
                count.append(spans)
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(digest, pa.string()),
                 pa.array(kept, pa.binary())], names=schema.names)

    return tagged.join(spans, ["doc", "tag"], "left").select("doc_id", "spans", "text").mapInArrow(cut, schema)
