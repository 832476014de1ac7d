"""A training corpus from raw documents: quality, near duplicates, repeated passages, source mixture, token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrolith.llm import bpe, mixing, quality, repeats, simhash, simhash_wide
from dendrolith.llm.common import modest_batches, table

#: SQL can express neither the classifier nor the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def apart(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage uses, and all others in one struct, so that no name of theirs meets one of the stage's own."""
    modest_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*[c for c in used if c in docs.columns], (F.struct(*rest) if rest else F.lit(0)).alias("__rest"))


def whole(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return found.select(*[F.col(c) if c in found.columns else F.col(f"__rest.`{c}`").alias(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    good = quality.classify(apart(docs, "doc_id", "text"), field).where("predicted = 1")
    return whole(good.select("doc_id", "text", "__rest"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word Jaccard similarities of 0.8 or more: the smallest doc_id."""
    own = apart(docs, "doc_id", "text")
    return whole(simhash.one_of_each(own, simhash_wide.similar_groups(own.select("doc_id", "text"))), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occurred earlier; every row stays, if need be with an empty text."""
    return whole(repeats.cut_documents(apart(docs, "doc_id", "text", "n_chars")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mixture takes them: left out, once, or repeated up to three times."""
    return whole(mixing.mix_documents(apart(docs, "doc_id", "text", "source")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the digests of the round trip."""
    modest_batches(spark)
    encoded = bpe.encode_documents(docs, bpe.default_vocabulary(), keep_ids=True)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mixture", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str, resume: str | None = None) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder before the next one reads it, and
    deleted when that one is written in its turn. With a name in ``resume`` results stay there under that name, and a run
    with the same name over the same input goes on after the last whole stage that it finds."""
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (name, stage) in enumerate(STAGES[:-1]):
        path = repeats.shelf(spark, resume and f"{resume}-{n}-{name}")
        if resume and repeats.on_shelf(spark, path):
            docs = spark.read.parquet(path)
        else:
            docs = repeats.shelve(stage(spark, docs, sf_dir), path)
        if before and not resume:
            repeats.on_shelf(spark, before, gone=True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
