"""A corpus pipeline of five operators, each on what its predecessor kept.

Edge cases, of every stage: an empty table gives an empty result; null texts count as empty; null ids are
ids of their own; extra columns stay as they are, also where an operator has a result column of that
name; texts of any length are taken whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthospark.llm import cotrain, exact_dedup, jaccard_join, packing, pii
from orthospark.llm.common import ensure_checkpoint_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; without labels of both kinds, see ``cotrain``.

    Repeated rows get equal verdicts. A column of ``docs`` named like a result column is kept aside.
    """
    model = cotrain.train(docs, table(spark, sf_dir, "labels"))
    aside = [f"__docs_{k}" for k in range(len(docs.columns))]
    twins = docs.withColumns({a: F.col(f"`{c}`") for a, c in zip(aside, docs.columns)})
    return cotrain.score(twins, model).where("kept").select(*[F.col(a).alias(c) for a, c in zip(aside, docs.columns)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of the greatest id, one of those if repeated."""
    aside = {c: f"__docs_{k}" for k, c in enumerate(docs.columns) if c.lower() in exact_dedup.RESULT and c.lower() != "doc_id"}
    out = exact_dedup.exact_dedup(docs.withColumnsRenamed(aside) if aside else docs)
    return out.withColumnsRenamed({a: c for c, a in aside.items()}) if aside else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id; of rows equal in id and words, one."""
    return jaccard_join.near_dedup(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal numbers replaced by pseudonyms; n_chars (null for a null text) follows the text."""
    out = pii.pseudonymize(docs, pii.TEST_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in token sequences; of other columns only the id stays."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("pii", private),
    ("packing", pack),
]

#: SQL can't express the trained classifier, the keyed permutations or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written as parquet and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    df = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, df, sf_dir).write.parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
    return df
