"""ABC and XYZ class expressions, as Columns and as SQL functions.

The thresholds apply to values that were already rounded to 3 places.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Class boundaries (inclusive upper bounds).
ABC_CUTS = (0.6, 0.8)    # share <= 0.6 -> A, <= 0.8 -> B, else C
XYZ_CUTS = (0.10, 0.25)  # variation <= 0.10 -> X, <= 0.25 -> Y, else Z


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def abc_class(share, cuts=ABC_CUTS) -> Column:
    s = _c(share)
    return (F.when(s <= cuts[0], "A").when(s <= cuts[1], "B")
            .when(s.isNotNull(), "C"))


def xyz_class(variation, cuts=XYZ_CUTS) -> Column:
    v = _c(variation)
    return (F.when(v <= cuts[0], "X").when(v <= cuts[1], "Y")
            .when(v.isNotNull(), "Z"))


def register_sql_functions(spark: SparkSession, abc_cuts=ABC_CUTS,
                           xyz_cuts=XYZ_CUTS) -> None:
    """Register ``abc_class(x)`` / ``xyz_class(x)`` as SQL functions.

    These are SQL-bodied functions: Catalyst inlines them into the plan, so
    they run in generated code without a Python worker.
    """
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION abc_class(p DOUBLE) RETURNS STRING "
        f"RETURN CASE WHEN p <= {abc_cuts[0]} THEN 'A' WHEN p <= {abc_cuts[1]} THEN 'B' "
        "WHEN p IS NOT NULL THEN 'C' END")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION xyz_class(v DOUBLE) RETURNS STRING "
        f"RETURN CASE WHEN v <= {xyz_cuts[0]} THEN 'X' WHEN v <= {xyz_cuts[1]} THEN 'Y' "
        "WHEN v IS NOT NULL THEN 'Z' END")
