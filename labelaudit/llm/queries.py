"""The registered queries of this folder, (spark, sf_dir) -> DataFrame, and their SQL twins."""
from __future__ import annotations

import public_tokenizers

from ..session import configure
from . import decontaminate, jaccard_join, language, line_runs, near_vectors, packing, pages, perspectives, phrases, prefix_trie, sharding, substrings, syncmers

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark, sf_dir: str, name: str):
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register("op2_language_id")
def language_id(spark, sf_dir):
    return language.identify_documents(table(spark, sf_dir, "documents"))


@register("op3_sharding")
def virtual_slot_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@register("op4_document_fingerprints")
def document_fingerprints(spark, sf_dir):
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return syncmers.fingerprint_documents(table(spark, sf_dir, "documents"), partitions)


@register("op5_line_dedup", line_runs.SQL)
def line_dedup(spark, sf_dir):
    return (line_runs.drop_repeated_lines(table(spark, sf_dir, "documents"))
            .select("doc_id", "text", "n_lines", "n_removed"))


@register("op6_benchmark_decontamination")
def benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op7_ngram_jaccard_join")
def ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@register("op8_suffix_array_dedup")
def suffix_array_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@register("op9_html_extraction")
def html_extraction(spark, sf_dir):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pages.extract(table(spark, sf_dir, "pages"), parts)


@register("op10_chat_formatting", perspectives.SQL)
def chat_formatting(spark, sf_dir):
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


@register("op11_conversation_prefix_trie", prefix_trie.SQL)
def conversation_prefix_trie(spark, sf_dir):
    trie = prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
    return trie.drop("enter_at", "leave_at")


@register("op12_embedding_near_dedup", near_vectors.SQL)
def embedding_near_dedup(spark, sf_dir):
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@register("op13_phrase_collocations", phrases.SQL)
def phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
