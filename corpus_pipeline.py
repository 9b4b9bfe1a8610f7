"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes every stage as Parquet in the shared folder and gives the next stage what it reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflife.llm import mixing, packing, seed_extend, superminhash, toxicity
from shelflife.llm.scratch import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.detect(docs, labels)
    return found.where(~toxicity.is_toxic()).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, the one with the smallest id (null last). Rows are told apart by numbers
    of their own, so equal and null ids hide no copies."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = written(docs.select(whole, F.monotonically_increasing_id().alias("_row")), "numbered")
    found = superminhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "_doc.text"))
    ids = rows.select("_row", F.col("_doc.doc_id").alias("_id"))
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))["_row"]
    grouped = found.select(F.col("doc_id").alias("_row"), "component_id").join(ids, "_row").groupBy("component_id")
    return rows.join(grouped.agg(first.alias("_row")), "_row", "left_semi").select("_doc.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; so does a document that has nothing else."""
    found = seed_extend.remove_repeats(docs)
    rest = found.where("repeats.n_removed = 0 OR repeats.n_removed < repeats.n_words")
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        rest = rest.withColumn("n_chars", F.when(F.col("repeats.n_removed") > 0, length).otherwise(F.col("n_chars")))
    return rest.select(*[f"`{c}`" for c in docs.columns])


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    pieces = packing.pack(docs, packing.json_encoder)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
