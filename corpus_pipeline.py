"""From documents to token files: the stages of the corpus pipeline, in order.

Each stage works on all rows its predecessor kept and returns the columns of documents, the last one the
index of the token files. The text of a row and its id together tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samplewright.llm import language, mixing, order_minhash, token_files, winnowing
from samplewright.llm.queries import END_ID, held_out, tokenizer_file
from samplewright.plans.registry import table
from samplewright.session import store
from samplewright.shipping import ship

#: SQL can neither cluster centroids nor align texts; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def _decided(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """docs joined with decisions by (doc_id, text_key); the columns of docs, and for inner joins the others too."""
    mine = docs.withColumn("_key", F.xxhash64("text"))
    theirs = decisions.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_text_key")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text_key"))
    return mine.join(theirs, same, how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or too far from every language that was learned, go."""
    ship(spark)
    model = language.fit(docs.where(~held_out(4)), "text", "lang")
    found = language.identify(docs, "text", model)
    return found.where(~F.col("rejected")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest id; of repeated rows, one."""
    ship(spark)
    text = docs.withColumn("text", F.coalesce("text", F.lit("")))
    found = order_minhash.near_duplicates(text.select("doc_id", "text"), "doc_id", "text")
    kept = found.where("kept").select("doc_id", "text_key").distinct()
    rows = _decided(docs.withColumn("_text", F.col("text")).withColumn("text", F.coalesce("text", F.lit(""))), kept, "left_semi")
    return rows.dropDuplicates(["doc_id", "_key"]).withColumn("text", F.col("_text")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go."""
    ship(spark)
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = winnowing.decontaminate(docs.select("doc_id", "text"), "doc_id", "text", items, "item_id", "text", span=10)
    hit = found.where("n_hit > 0").select("doc_id", "text_key").distinct()
    return _decided(docs, hit, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated rows for complete epochs, none for those left out."""
    ship(spark)
    mixed = mixing.mix_sources(docs, "doc_id", "text", "source", weights=(3, 1, 2), share=1.5, most_epochs=2.0)
    # Rows that are alike in id and text share their copies out among them.
    copies = mixed.groupBy("doc_id", "text_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    rows = _decided(docs, copies.where("_copies > 0"), "inner")
    turn = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy(F.lit(1)))
    more = F.when(turn <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    times = F.floor(F.col("_copies") / F.col("_rows")) + more
    repeated = rows.withColumn("_times", times.cast("int")).where("_times > 0")
    return repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; returns their index (doc_id, start, n_tokens, ids_crc32), read back from them."""
    ship(spark)
    return token_files.encode_and_read(docs, "doc_id", "text", tokenizer_file(), END_ID)


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, "stage")
    return docs
