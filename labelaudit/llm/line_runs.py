"""Line deduplication: later copies of repeated runs of lines, from a suffix array over line ids.

Documents are sequences of lines. Prefix doubling ranks the suffixes: the rank of a line's suffix to
depth 1 is the line's id, and ranks to depth 2h come from pairs of ranks to depth h, h lines apart.
Suffixes of equal rank to depth h are an interval of the suffix array with a common prefix of h lines
or more, named by its first suffix; a suffix alone in its interval is settled and takes no part in
further rounds. A run of l lines, l between 2**j and 2**(j+1), is named by the ranks to depth 2**j at
its first and at its last 2**j lines.

A run counts if it has `WORDS` words or more. What the later copies of all maximal repeated runs
cover is what the shortest counting runs of each line, forward and backward, cover: so only those
are looked up, and depths up to `WORDS` lines are enough, as every line has a word."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import step, stored

WORDS = 50
CELLS = 1 << 24              # bits of the filter for documents that lose lines


def split_lines(text: Column) -> Column:
    """The lines of a text; blank lines belong to the line before (or, at the beginning, after)."""
    return F.split(text, r"\n(?=[^\S\n]*\S)")


def _reach(words: Column, backward: bool, least: int) -> Column:
    """For each line, how many lines from it (or back from it) have `least` words; null if they never do."""
    def at(_, i):
        if backward:
            first = F.greatest(i + 2 - least, F.lit(1))
            piece = F.reverse(F.slice(words, first, i + 2 - first))
        else:
            piece = F.slice(words, i + 1, F.lit(least))
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
        step = lambda s, w: F.when(s["sum"] >= least, s).otherwise(
            F.struct((s["sum"] + w).alias("sum"), (s["n"] + 1).alias("n")))
        return F.aggregate(piece, start, step, lambda s: F.when(s["sum"] >= least, s["n"]))
    return F.transform(words, at)


def line_table(documents: DataFrame, least: int) -> DataFrame:
    """(lot, doc_id, line, line_id, forward, backward, gid), stored; one row per line with a word."""
    lines = split_lines(F.col("text"))
    words = F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"\S+")))
    parts = (documents.where(F.col("text").rlike(r"\S")).select("lot", "doc_id", lines.alias("lines"))
             .withColumn("words", words)
             .select("lot", "doc_id", F.posexplode(F.arrays_zip(
                 F.col("lines").alias("text"), "words",
                 _reach(F.col("words"), False, least).alias("forward"),
                 _reach(F.col("words"), True, least).alias("backward"))).alias("line", "x")))
    body = F.regexp_replace("x.text", r"\s+$", "")
    return stored(parts.select(
        "lot", "doc_id", "line", F.xxhash64(body).alias("one"), F.xxhash64(F.lit(7), body, F.length(body)).alias("two"),
        "x.forward", "x.backward", F.monotonically_increasing_id().alias("gid")), "lines")


def ranks(lines: DataFrame, least: int) -> list[DataFrame]:
    """For depths 1, 2, 4, ... up to `least`: (lot, line, rank) of the suffixes that are not alone in
    their interval; the rank is the least `gid` in it."""
    def name(rows: DataFrame, keys: list[str]) -> DataFrame:
        shared = rows.groupBy(*keys).agg(F.min("gid").alias("rank"), F.count("*").alias("n")).where("n > 1").drop("n")
        return stored(rows.join(shared, keys).select("lot", "line", "gid", "rank"), "ranks")

    levels, depth = [name(lines.select("lot", "line", "gid", "one", "two"), ["one", "two"])], 1
    while 2 * depth <= least:
        here = levels[-1]
        ahead = here.select("lot", (F.col("line") - depth).alias("line"), F.col("rank").alias("two"))
        levels.append(name(here.withColumnRenamed("rank", "one").join(ahead, ["lot", "line"]), ["one", "two"]))
        depth *= 2
    return levels


def repeated_lines(documents: DataFrame, least: int = WORDS) -> DataFrame:
    """(lot, lines array): the lines that later copies of repeated runs cover, of documents (lot, doc_id,
    text). Earlier is a lesser doc_id (nulls last), then an earlier row, then an earlier line; copies
    may overlap, so of one line repeated over and over the first stays."""
    lines = line_table(documents, least)
    levels = ranks(lines, least)
    table = reduce(DataFrame.unionByName, [r.select("lot", "line", "rank", F.lit(j).alias("level")) for j, r in enumerate(levels)])
    active = lines.join(levels[0].select("lot", "line"), ["lot", "line"], "left_semi")
    runs = (active.where("forward IS NOT NULL").select("lot", "doc_id", F.col("line").alias("first"), F.col("forward").alias("size"))
            .unionByName(active.where("backward IS NOT NULL").select(
                "lot", "doc_id", (F.col("line") - F.col("backward") + 1).alias("first"), F.col("backward").alias("size")))
            .distinct())
    level = F.floor(F.log2("size") + 1e-9).cast("int")
    runs = runs.withColumn("level", level).withColumn(
        "second", F.col("first") + F.col("size") - F.pow(F.lit(2), F.col("level")).cast("int"))
    a = table.withColumnsRenamed({"line": "first", "rank": "rank_a"})
    b = table.withColumnsRenamed({"line": "second", "rank": "rank_b"})
    named = runs.join(a, ["lot", "level", "first"]).join(b, ["lot", "level", "second"])
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "lot", "first")
    keys = ["size", "rank_a", "rank_b"]
    named = stored(named.select("lot", "first", *keys, place.alias("place")), "runs")
    earliest = named.groupBy(*keys).agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = named.join(earliest, keys).where("place <> earliest")
    covered = later.select("lot", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("line"))
    return covered.distinct().groupBy("lot").agg(F.collect_list("line").alias("gone"))


def _cell() -> Column:
    return F.pmod(F.xxhash64("_lot"), F.lit(CELLS)) + 1          # Spark's buckets hold bits 1 to 32768 and so on


def with_gone(numbered: DataFrame, gone: DataFrame) -> DataFrame:
    """`numbered` left joined to `gone` (_lot, _gone), a stored table, on _lot. Most texts without a row there are
    told by a filter of fixed size and are not moved; the few others that pass it meet nothing in the join."""
    bits = (gone.select(F.bitmap_bucket_number(_cell()).alias("_bucket"), F.bitmap_bit_position(_cell()).alias("_bit"))
            .groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_bit div 8) + 1, 1)")), 16, 10).cast("int")
    told = (numbered.withColumns({"_bucket": F.bitmap_bucket_number(_cell()), "_bit": F.bitmap_bit_position(_cell())})
            .join(F.broadcast(bits), "_bucket", "left"))
    passes = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, int(_bit % 8))")) > 0, F.lit(False))
    # merged at every size: a broadcast here would go through the driver, and only while tables are small
    met = told.where(passes).select(*numbered.columns).join(gone.hint("merge"), "_lot", "left")
    rest = told.where(~passes).select(*numbered.columns).withColumn("_gone", F.lit(None).cast(gone.schema["_gone"].dataType))
    return met.unionByName(rest)


def drop_repeated_lines(documents: DataFrame, least: int = WORDS, lot: str | None = None) -> DataFrame:
    """`documents` with the later copies of repeated runs cut out of their text, and n_lines and
    n_removed; columns of these names are replaced. Lines left are joined as they were. Null, empty
    and blank texts have no lines and stay as they are; a text all of whose lines go becomes empty.

    `lot` names a column of row numbers, if `documents` is a stored table that has one."""
    if lot is None:
        # stored with the texts, as a later scan may number otherwise
        numbered = stored(documents.withColumn("_lot", F.monotonically_increasing_id()), "numbered")
    else:
        numbered = documents.withColumn("_lot", F.col(lot))
    texts = numbered.select(F.col("_lot").alias("lot"), "doc_id", "text")
    gone = (step(documents.sparkSession, lambda: repeated_lines(texts, least), "gone")
            .withColumnsRenamed({"lot": "_lot", "gone": "_gone"}))
    lines = split_lines(F.col("text"))
    cut = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return with_gone(numbered, gone).withColumns({
        "n_lines": F.when(F.col("text").rlike(r"\S"), F.size(lines)).otherwise(0).cast("long"),
        "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(cut)}).drop("_gone", "_lot")


# The same for DuckDB by the texts of the runs themselves, for texts without blank lines.
SQL = """
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, l, list_transform(l, lambda x: len(regexp_extract_all(x, '\\S+'))) AS n FROM l),
p AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l, n FROM w),
q AS (
  SELECT doc_id, i, l,
         list_filter(range(1, least(50, len(l) - i + 1) + 1), lambda k: list_sum(n[i:i + k - 1]) >= 50)[1] AS f,
         list_filter(range(1, least(50, i) + 1), lambda k: list_sum(n[i - k + 1:i]) >= 50)[1] AS b
  FROM p),
r AS (
  SELECT doc_id, i AS first, f AS size, list_aggregate(l[i:i + f - 1], 'string_agg', chr(10)) AS run FROM q WHERE f IS NOT NULL
  UNION
  SELECT doc_id, i - b + 1, b, list_aggregate(l[i - b + 1:i], 'string_agg', chr(10)) FROM q WHERE b IS NOT NULL),
s AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM r),
g AS (
  SELECT DISTINCT doc_id, unnest(range(first, first + size)) AS i FROM s WHERE nth > 1),
k AS (
  SELECT p.doc_id, string_agg(p.l[p.i], chr(10) ORDER BY p.i) FILTER (g.i IS NULL) AS text, count(*) AS n_lines,
         count(g.i) AS n_removed
  FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM k"""
