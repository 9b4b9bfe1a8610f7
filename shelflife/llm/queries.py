"""One query per operator over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflife.llm import backoff_lm, bucket_refine, hamming, langid, mixing, packing, prefix_trie, quality, seed_extend, site_templates, superminhash, token_alignment, toxicity
from shelflife.llm.sampling import text_crc
from shelflife.llm.scratch import written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(documents(spark, sf_dir), packing.json_encoder)
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def op2_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    coded = hamming.sign_codes(vectors, "embedding")
    return hamming.nearest_codes(coded, "vec_id", F.col("vec_id") % hamming.QUERY_EVERY == 0)


def op3_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    result = quality.clean_lines(docs).select("doc_id", "quality.*")
    return result.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op4_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = seed_extend.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    kept_words = F.regexp_replace(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+", " ")
    return found.select(
        "doc_id", "repeats.n_words", "repeats.n_removed", F.sha2(kept_words, 256).alias("kept_sha256")
    )


def op5_bucket_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bucket_refine.remove_repeated_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(text_crc(F.col("doc_id"), 4) == 2, F.lit(True))
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(documents(spark, sf_dir)).drop("_h")


def op8_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(text_crc(F.col("doc_id"), 7) == 2, F.lit(True))
    return backoff_lm.score(docs, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "lm.n_tokens", "lm.n_known", "lm.train_tokens", "lm.base_score", "lm.score"
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    p = F.col("toxicity")
    return toxicity.detect(docs, labels).select(
        "doc_id", p[0].alias("p_low_quality"), p[1].alias("p_toxic"), toxicity.is_toxic().alias("toxic")
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    nodes = prefix_trie.prefix_trie(*prefix_trie.rebuilt_prefixes(written(turns, "turns")))
    return nodes.drop("n_ends")


def op12_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = site_templates.extract_text(pages)
    return found.select("page_id", "url", "extracted.*")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(documents(spark, sf_dir).select("doc_id", "text"))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
    return found.select("doc_id", *[f"alignment.{c}" for c in names])


QUERIES = {
    "op1_pack_windows": op1_pack_windows,
    "op2_hamming_search": op2_hamming_search,
    "op3_quality_lines": op3_quality_lines,
    "op4_seed_extend": op4_seed_extend,
    "op5_bucket_refine": op5_bucket_refine,
    "op6_language": op6_language,
    "op7_superminhash": op7_superminhash,
    "op8_backoff_lm": op8_backoff_lm,
    "op9_toxicity": op9_toxicity,
    "op10_mix_sources": op10_mix_sources,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_site_templates": op12_site_templates,
    "op13_token_alignment": op13_token_alignment,
}
