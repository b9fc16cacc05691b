"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, mixing of sources, token files.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame with the
columns of documents; the last returns what it wrote. The mixture is the order of the rows: stage 4 writes them in that
order, and stage 5 reads the order from its input's files, so the token files hold the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, minhash_dedup, mixing, shared, token_files, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(shared.crc_mod("doc_id", 3) != 1)
    return toxicity.accepted(docs.select(*COLUMNS), toxicity.learn(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; of a repeated id one row. Rows without an id stay."""
    docs = docs.select(*COLUMNS)
    gone = minhash_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.limit(1).count():
        again = shared.save(again, "repeated-ids")
        out = out.join(again, "doc_id", "left_anti").union(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*COLUMNS)
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs.select(*COLUMNS), ordered=True).select(*COLUMNS)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the documents' files; documents that come from no files are taken by doc_id."""
    order = [F.col("doc_id")]
    if docs.inputFiles():
        docs = docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias("_file"), F.col("_metadata.row_index").alias("_row"))
        order = [F.coalesce(F.expr("try_cast(_file as int)"), F.lit(0)), F.col("_row")]
    path = shared.fresh_path(spark, "corpus-tokens")
    token_files.write_tokens(token_files.token_rows(docs, order, token_files.tokenizer_path()), path)
    return token_files.ids_checksum(token_files.read_tokens(spark, path))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_files", write_token_files),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
