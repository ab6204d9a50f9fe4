"""Steps that enrich a day's rows one after the other, where a faulty row costs itself only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StringType, StructField, StructType

ERROR_CHARS = 160


@dataclass(frozen=True)
class Step:
    """A value, and why a row gets none of it.

    value: an expression that doesn't raise, or one of ``guarded``.  fault: a
    text, null where all is well; such a row failed.  withheld: likewise, but the
    row is merely left out.  Both may use the values of earlier steps.
    """

    name: str
    value: Column
    fault: Column | None = None
    withheld: Column | None = None


def guarded(f: Callable, kind: DataType, *columns: str) -> Column:
    """``f`` of a row's columns as struct<value, error>: what it raises is the row's error, its type and message."""
    arrow_type = pa.struct([("value", to_arrow_type(kind)), ("error", pa.string())])

    @F.arrow_udf(StructType([StructField("value", kind), StructField("error", StringType())]))
    def run(*arrays: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(a.to_pylist() for a in arrays), strict=True):
            try:
                out.append({"value": f(*row), "error": None})
            except Exception as x:  # the row's fault, whatever it is
                out.append({"value": None, "error": f"{type(x).__name__}: {str(x)[:ERROR_CHARS]}"})
        return pa.array(out, arrow_type)

    return run(*columns)


def enriched(rows: DataFrame, steps: list[Step]) -> DataFrame:
    """``rows`` with each step's value and the outcome: state (done, withheld, failed), step and reason.

    Once a row has failed or been withheld, later steps give null and aren't
    worked out for it.  No row goes and none is added, and nothing is shuffled;
    columns of ``rows`` called like a step or an outcome are replaced.
    """
    own = [c for c in rows.columns if c not in {"state", "step", "reason", *(s.name for s in steps)}]
    out = rows.select(*own).withColumn("__over", F.lit(None).cast("struct<state:string,step:string,reason:string>"))
    open_ = F.col("__over").isNull()
    for s in steps:
        over = lambda state, reason, s=s: F.struct(F.lit(state).alias("state"), F.lit(s.name).alias("step"), reason.cast("string").alias("reason"))
        for state, reason in (("withheld", s.withheld), ("failed", s.fault)):
            if reason is not None:
                out = out.withColumn("__over", F.when(open_, F.when(reason.isNotNull(), over(state, reason))).otherwise(F.col("__over")))
        out = out.withColumn(s.name, F.when(open_, s.value))
        kind = out.schema[s.name].dataType
        if isinstance(kind, StructType) and kind.names == ["value", "error"]:
            error = F.col(s.name)["error"]
            out = out.withColumn("__over", F.when(open_ & error.isNotNull(), over("failed", error)).otherwise(F.col("__over"))).withColumn(s.name, F.col(s.name)["value"])
    return out.select(*own, *(s.name for s in steps), F.coalesce("__over.state", F.lit("done")).alias("state"), F.col("__over.step").alias("step"), F.col("__over.reason").alias("reason"))


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """``rows`` with the counts of their outcomes, which are there once the rows have been written: no pass of their own."""
    counts = Observation("outcomes")
    is_ = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.observe(counts, F.count(F.lit(1)).alias("rows"), is_("done"), is_("withheld"), is_("failed")), counts


def counters(rows: DataFrame) -> DataFrame:
    """state, step, reason, n: their sum is the number of rows."""
    return rows.groupBy("state", "step", "reason").agg(F.count("*").alias("n"))


def audit(rows: DataFrame, key: str) -> DataFrame:
    """One line for each row: what became of it."""
    return rows.select(key, "state", "step", "reason")
