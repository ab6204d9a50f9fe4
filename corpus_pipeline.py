"""A corpus pipeline of five stages over the documents table.

Toxic documents go, one document of each near-duplicate group stays, benchmark
passages are removed, sources are mixed to target weights, and each row gets
its shard.  Every stage is written as Parquet to the cluster's shared folder
and read again as the next one's input, after which it is deleted; all but the last keep the columns of
documents.

Defined cases are those of the operators.  A document of the mix that is taken
twice stands twice; one of which more than half is benchmark text goes; an empty
table passes through all stages; documents without labels are only scored;
columns beside those of documents pass through all stages, whatever their names,
but slot and shard, which the last one sets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import decontamination, mixing, near_dup, sharding, toxicity
from noticeflow.llm.common import delete, forget_later, scratch, shared_dir, table


#: Similarity in percent from which the stage links documents; op4 has its own.
NEAR_PERCENT = 80


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under the threshold; labels are learnt as in op9."""
    name = "toxicity" + "_" * max(map(len, docs.columns))  # no column of docs
    scored = toxicity.score(docs, toxicity.fitted(spark, sf_dir), score_col=name)
    return scored.filter(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component, and documents linked with nothing."""
    return near_dup.kept_documents(docs, percent=NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with benchmark items."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; a row that it doesn't take goes."""
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, the lookup slot and the shard of each row."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Training and sketches are not expressible in SQL; the tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark, everything=True):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.schema(out.schema).parquet(f"{base}/{k}-{name}")
        if k:
            delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    forget_later(base)  # the result reads the last stage
    return docs
