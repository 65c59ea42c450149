"""A corpus in five stages, each over all that the stage before it kept.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again for the next.

Every stage keeps the columns of its documents as they are, in their order:
further columns may have any name, also one that an operator uses, that differs
in case only or that occurs twice. Rows with a null id are documents of their
own. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actfold.llm import language, minhash, mixing, packing, secrets
from actfold.llm.common import Scratch, numbered

#: A stage or two has state that SQL cannot express (trained models, hashing), so tests compare with plain Python instead.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that is surer than the rest together, go.

    Null and empty texts go, since they have no letters; where no language can
    be learned, everything goes. Repeated rows share their fate.
    """
    own, at = numbered(docs)
    found = language.identify(own, text_col=at["text"], model=language.fit(docs))
    return found.where("lang_pred != 'und' and score >= 0.5").select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at similarity 0.8 stays, the one with the smallest id.

    Of rows that share that id, one stays. Documents without words, and rows
    with a null id, resemble nothing and stay.
    """
    own, at = numbered(docs)
    key = F.col(at["doc_id"])
    found = minhash.near_duplicates(docs, percent=80, bands=25)  # a pair at 0.80 is missed with chance 5e-5
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias(at["doc_id"])).distinct()
    once = own.where(key.isNotNull()).join(kept.hint("merge"), at["doc_id"], "left_semi").dropDuplicates([at["doc_id"]])
    return once.select(*own.columns).union(own.where(key.isNull())).toDF(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows the text. Rows without secrets, null and empty texts among them, stay as they are."""
    own, at = numbered(docs)
    found = secrets.redact_documents(own, text_col=at["text"], model=secrets.fit_markov(docs))
    hit, new = F.col("n_secrets") > 0, {at["text"]: F.col("clean_text")}
    if "n_chars" in at:
        new[at["n_chars"]] = F.length("clean_text").cast(own.schema[at["n_chars"]].dataType)
    return found.select(*[F.when(hit, new[c]).otherwise(F.col(c)) if c in new else F.col(c) for c in own.columns]).toDF(*docs.columns)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens lean to the target shares of source, language and topic; rows without words go, repeated rows share their fate."""
    return mixing.sample_documents(docs)


def packing_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token windows; a null or empty text is the end id alone."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scans", secret_scans), ("mixing", mixing_weights), ("packing", packing_windows)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    last = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, name)
            if last is not None:  # the stage that read it has been written
                work.drop(last)
            last = docs
    return docs
