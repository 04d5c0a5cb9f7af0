"""A corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir) on all that the stage before it kept; run()
writes each stage's rows as Parquet in the shared folder and reads them again for the next.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattispark.llm import bpe, mix, ngram_join, quality, secrets
from lattispark.llm.common import documents, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject. Nulls are features like others, rows
    that repeat a key are judged one by one, and an empty table stays empty."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep=COLUMNS).where(F.col("score") >= quality.KEEP).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least key of each group that 4-word shingles link at 0.85 or more.
    Of rows that repeat a key one stays; rows without a key all stay."""
    found = ngram_join.join(docs)
    heads = found.where("component = doc_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(heads, "doc_id", "left_semi")
    ids = docs.where("doc_id is not null").agg(F.count("doc_id").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if ids["n"] > ids["d"]:
        kept = kept.dropDuplicates(["doc_id"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by a mark and n_chars counted anew where any was. A null
    text becomes empty; every row stays, and an empty table stays empty."""
    found = secrets.scan(docs, keep=("doc_id", "lang", "source", "n_chars"), redacted=True)
    count = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", count).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them: once per turn through their source. Rows are
    in the shuffled order of their shards. A null source is a source of its own; documents without
    words aren't taken, rows that repeat a key are documents of their own, and an empty table stays empty."""
    sizes = mix.sized(docs, carry=("text", "lang", "n_chars"))
    return mix.shards(mix.mixed(sizes, whole=True), "text", "lang", "source", "n_chars").select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, packed as little-endian unsigned 32-bit integers, and a hash of the
    text that they decode to. A null text has none and decodes to nothing; every row gives one."""
    path, pattern = bpe.vocabulary()
    back = bpe.decode(bpe.encode(docs, path, pattern), path)
    return back.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("tokens", to_tokens),
]

#: Classifiers and hashed orders have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
