"""Laboratory results in CSV files with a header.

Defined results: headers are matched without regard to case and outer spaces, the first alias with a value wins;
rows without an analyte are dropped; analytes are canonical; blank values are null; columns of other names are not read; a file without rows
gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.functions.clinical import canonical_analyte, canonical_flag, coerce_date

#: The names that each field goes by.
ALIASES = {
    "subject": ("test", "analyte", "name"),
    "reading": ("value", "result"),
    "unit": ("unit", "units"),
    "reference_range": ("reference_range", "ref_range"),
    "flag": ("flag", "interpretation"),
    "date": ("date",),
    "patient_ref": ("patient_id", "patient"),
    "source": ("source",),
}


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path)


def assertions(rows: DataFrame, today: Column | None = None) -> DataFrame:
    """One laboratory assertion per row of a table of strings; a row without a date is of ``today``."""
    by_name = {c.strip().lower(): c for c in rows.columns}

    def field(name: str) -> Column:
        found = [F.nullif(F.trim(rows[f"`{by_name[a]}`"].cast("string")), F.lit("")) for a in ALIASES[name] if a in by_name]
        return F.coalesce(*found, F.lit(None).cast("string"))

    return rows.select(
        F.lit("LabResult").alias("resource_type"),
        F.lit("measured").alias("predicate"),
        canonical_analyte(field("subject")).alias("subject"),
        field("subject").alias("analyte_name"),
        field("reading").alias("reading"),
        field("unit").alias("unit"),
        field("reference_range").alias("reference_range"),
        F.nullif(canonical_flag(field("flag")), F.lit("")).alias("flag"),
        coerce_date(field("date"), today=today).alias("valid_from"),
        field("patient_ref").alias("patient_ref"),
        field("source").alias("source"),
    ).filter("analyte_name IS NOT NULL").drop("analyte_name")
