"""The panel schema and its CSV source and sinks."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveline.operators.ordered import OrderedBlocks

# The rating items, in file order.
P_ITEMS = [f"P{i}" for i in range(1, 8)]
N_ITEMS = [f"N{i}" for i in range(1, 8)]
G_ITEMS = [f"G{i}" for i in range(1, 17)]
ITEMS = P_ITEMS + N_ITEMS + G_ITEMS
SCORE = "PANSS_Total"

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("Study", T.StringType()),
        T.StructField("Country", T.StringType()),
        T.StructField("PatientID", T.LongType()),
        T.StructField("SiteID", T.IntegerType()),
        T.StructField("RaterID", T.LongType()),
        T.StructField("AssessmentID", T.LongType()),
        T.StructField("TxGroup", T.StringType()),
        T.StructField("VisitDay", T.IntegerType()),
        *[T.StructField(item, T.IntegerType()) for item in ITEMS],
        T.StructField(SCORE, T.IntegerType()),
        T.StructField("LeadStatus", T.StringType()),
        T.StructField("Week", T.IntegerType()),
    ]
)

# Rows of one patient and day keep the order of these columns.
TIES = ["Study", "Country", "SiteID", "RaterID", "AssessmentID"]
VISIT_ORDER = ["PatientID", "VisitDay", *TIES]


def read_panel(spark: SparkSession, path: str, schema: T.StructType = PANEL_SCHEMA) -> DataFrame:
    """Scan CSV files with a header, by name; ``NA`` is null and no inference pass is run.

    The header line of the path gives the columns and their order. Columns of
    ``schema`` that the file lacks are null, others of the file are left out.
    All files of one path must have the same header; read others on their own.
    """
    first = spark.read.text(path).filter("length(trim(value)) > 0").first()
    if first is None:
        return spark.createDataFrame([], schema)
    header = next(csv.reader([first.value.lstrip("\ufeff")]))
    types = {f.name: f.dataType for f in schema}
    found = T.StructType([T.StructField(name, types.get(name, T.StringType())) for name in header])
    rows = spark.read.csv(path, schema=found, header=True, nullValue="NA", enforceSchema=False)
    return rows.select(*[F.col(f"`{n}`") if n in header else F.lit(None).cast(t).alias(n) for n, t in types.items()])


def write_panel(
    df: DataFrame, path: str, row_names: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    """Write CSV with a header and ``NA`` for null.

    ``row_names`` is the sort order of a leading column ``X`` that counts rows
    from 1. Leave it out when no reader needs that column: it costs a sort.
    """
    if row_names:
        ordered = OrderedBlocks.of(df, row_names).ordinal("X", start=1).frame()
        df = ordered.select("X", *df.columns)
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def with_week(df: DataFrame, day: str = "VisitDay", name: str = "Week") -> DataFrame:
    """Running week of a visit; day 0 falls in week 1."""
    return df.withColumn(name, F.ceil((F.col(day) + 1) / 7).cast("int"))
