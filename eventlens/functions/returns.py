"""Return categorisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
# Percent thresholds (bounds inclusive) and category names.
UP_BIG, UP_SMALL, DOWN_SMALL, DOWN_BIG = 2.0, 0.5, -0.5, -2.0
SIGNIFICANT_UP = "Significant Up"
SMALL_UP = "Small Up"
FLAT = "Flat"
SMALL_DOWN = "Small Down"
SIGNIFICANT_DOWN = "Significant Down"
NO_RETURN = "N/A"
# ---------------------------------------------------------------------------


def categorize_return(c: Column | str) -> Column:
    """percent return -> move category. Null and NaN give ``N/A``; the
    NaN test comes first because Spark orders NaN above every number."""
    x = F.col(c) if isinstance(c, str) else c
    return (F.when(x.isNull() | F.isnan(x), F.lit(NO_RETURN))
            .when(x >= UP_BIG, F.lit(SIGNIFICANT_UP))
            .when(x >= UP_SMALL, F.lit(SMALL_UP))
            .when(x <= DOWN_BIG, F.lit(SIGNIFICANT_DOWN))
            .when(x <= DOWN_SMALL, F.lit(SMALL_DOWN))
            .otherwise(F.lit(FLAT)))


CATEGORIZE_SQL = f"""
CASE WHEN x IS NULL OR isnan(x) THEN '{NO_RETURN}'
     WHEN x >= {UP_BIG} THEN '{SIGNIFICANT_UP}'
     WHEN x >= {UP_SMALL} THEN '{SMALL_UP}'
     WHEN x <= {DOWN_BIG} THEN '{SIGNIFICANT_DOWN}'
     WHEN x <= {DOWN_SMALL} THEN '{SMALL_DOWN}'
     ELSE '{FLAT}' END"""
