"""Mutation logs (seq, key, vtype, value) made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordered import numbered
from .session import load


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events: errors delete, other events put their properties."""
    vtype = F.when(F.col("event_type") == "error", 2).otherwise(1)
    return load(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"), F.concat(F.lit("user_"), F.col("user_id")).alias("key"), vtype.alias("vtype"), F.when(vtype == 1, F.col("props")).alias("value")
    )


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by shipping date: returned ones delete. Numbered without a global sort in one task."""
    rows = load(spark, sf_dir, "lineitem")
    order = ["l_shipdate", *(c for c in rows.columns if c != "l_shipdate")]
    vtype = F.when(F.col("l_returnflag") == "R", 2).otherwise(1)
    value = F.when(vtype == 1, F.concat_ws("|", "l_linestatus", F.col("l_linenumber").cast("string")))
    keep = [F.concat(F.lit("order_"), F.col("l_orderkey")).alias("key"), vtype.alias("vtype"), value.alias("value")]
    return numbered(rows, order, "seq", keep=keep).select("seq", "key", "vtype", "value")


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as large values under few keys; null texts are empty values."""
    key = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")))
    return load(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("seq"), key.alias("key"), F.lit(1).alias("vtype"), F.coalesce("text", F.lit("")).alias("value"))
