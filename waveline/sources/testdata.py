"""A visit panel derived from the order tables.

A customer is a patient and an order is an assessment. Items come from
arithmetic on the keys, so any SQL engine can rebuild the same panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline.functions.scores import row_sum
from waveline.sources.panel_csv import ITEMS, PANEL_SCHEMA, SCORE, with_week


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"
    )
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_mktsegment", "c_nationkey"
    )
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")

    # One row per patient first, so the visits are shuffled only once. A hot
    # patient is combined before this shuffle and split by AQE in the join.
    first_day = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"))
    patients = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        first_day, F.col("c_custkey") == F.col("o_custkey")
    ).drop("o_custkey")

    segment = F.col("c_mktsegment")
    study = (
        F.when(segment == "AUTOMOBILE", "A")
        .when(segment == "BUILDING", "B")
        .when(segment == "FURNITURE", "C")
        .when(segment == "HOUSEHOLD", "D")
        .otherwise("E")
    )
    visits = orders.join(patients, F.col("o_custkey") == F.col("c_custkey")).select(
        study.alias("Study"),
        F.col("n_name").alias("Country"),
        F.col("o_custkey").alias("PatientID"),
        F.col("c_nationkey").alias("SiteID"),
        (F.col("o_orderkey") % 97).alias("RaterID"),
        F.col("o_orderkey").alias("AssessmentID"),
        F.when(F.col("o_custkey") % 2 == 0, "Control").otherwise("Treatment").alias("TxGroup"),
        F.floor(F.datediff("o_orderdate", "first_date") / 12).cast("int").alias("VisitDay"),
        "o_orderstatus",
    )
    fall = F.when(
        F.col("TxGroup") == "Treatment", F.floor(F.col("VisitDay") / 60).cast("int")
    ).otherwise(0)
    visits = visits.withColumns(
        {"_base": 3 + F.col("PatientID") % 5 - 4 - fall, "_seed": F.col("AssessmentID") % 9973}
    )
    items = {}
    for j, item in enumerate(ITEMS, start=1):
        noise = (F.col("_seed") * (j * j + 31 * j + 17)) % 10007 % 5
        items[item] = F.greatest(F.lit(1), F.least(F.lit(7), F.col("_base") + noise)).cast("int")
    panel = visits.withColumns(items).withColumns(
        {
            SCORE: row_sum(ITEMS),
            "LeadStatus": F.when(F.col("Study") == "E", None)
            .when(F.col("o_orderstatus") == "P", "Flagged")
            .otherwise("Passed"),
        }
    )
    return with_week(panel).select(PANEL_SCHEMA.names)
