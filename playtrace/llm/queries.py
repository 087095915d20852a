"""The registered queries of this subpackage: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from playtrace.llm import (
    adaptive_scan,
    decontaminate,
    ecoc_lang,
    lockstep_align,
    mixing,
    multiset_hash,
    pairwise_quality,
    render_html,
    reply_trees,
    reversed_search,
    substrings,
    tensor_minhash,
    warc_zstd,
)
from playtrace.llm.tables import table
from playtrace.scratch import saved, scratch_path


def op1_benchmark_decontamination(spark, sf_dir):
    """Every benchmark item that a document holds, with the stretch that is equal."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.find_passages(docs, bench).withColumnRenamed("k", "doc_id")


def op2_reply_trees(spark, sf_dir):
    """All conversations and one that consists of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], told.schema)
    messages = saved(reply_trees.linear_messages(told.union(odd)))
    done = reply_trees.formatted(reply_trees.conversations(messages))
    back = reply_trees.read_back(done.select("tree", "formatted", "loss_spans"))
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_warc_zstd(spark, sf_dir):
    """All pages written as compressed archives and read back."""
    path = scratch_path(spark)
    warc_zstd.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = warc_zstd.read_archives(spark, path, with_payload=False)
    return back.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"
    )


def op4_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.dedup_substrings(docs, size=20).select(
        F.col("k").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op5_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return render_html.render_pages(pages).select(F.col("k").alias("page_id"), "n_lines", "text")


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("k").cast("string")) % 4 == 2, F.lit(False))
    return ecoc_lang.identify(docs, _remainder(4) != 2).select(
        F.col("k").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op7_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_counts(docs).select(
        F.col("k").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def op8_nearest_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return adaptive_scan.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, k=20)


def op9_minhash_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tensor_minhash.near_duplicates(docs, shingle=4, percent=80).select(
        F.col("k").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("k") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def op10_pairwise_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(_remainder(5) != 0)
    labels = labels.select("doc_id", F.col("quality").alias("label"))
    held_out = F.coalesce(F.crc32(F.col("k").cast("string")) % 5 == 0, F.lit(False))
    return pairwise_quality.rank_quality(docs, labels).select(
        F.col("k").alias("doc_id"), held_out.alias("held_out"), "score", "predicted"
    )


def op11_ranked_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return reversed_search.ranked_documents(docs, items, k=10).withColumnRenamed("k", "doc_id")


def op12_document_fingerprints(spark, sf_dir):
    """Every document, its edited text and its neighbour, by fingerprint."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return multiset_hash.edited_fingerprints(docs).withColumnRenamed("k", "doc_id")


def op13_token_alignment(spark, sf_dir):
    """Tokens, groups and links of every document under two tokenizers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lockstep_align.token_links(docs).withColumnRenamed("k", "doc_id")


QUERIES = {
    name: query for name, query in globals().items() if name.startswith("op") and callable(query)
}
