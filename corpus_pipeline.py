"""From raw documents to packed training windows: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faktorium.llm import exact_dedup, language, mixing, packing, simhash, tokens
from faktorium.session import configure, work_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that can have a language: texts that are null or without letters go, whatever the model knows."""
    configure(spark)
    model = language.fit(docs, language.learnable())
    free = max(map(len, docs.columns)) * "_"
    predicted = language.predict(
        spark, model, docs, predicted_name=f"_{free}pred", score_name=f"_{free}score", letters_name=f"_{free}letters"
    )
    kept = predicted.where(F.col(f"_{free}letters"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(configure(spark), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays."""
    return simhash.keep_one(configure(spark), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    configure(spark)
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens."""
    configure(spark)
    return packing.pack(docs, tokens.default_path())


STAGES = [
    ("language", identify_language),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_windows),
]

#: Language identification, fingerprints and token ids can't be written in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
