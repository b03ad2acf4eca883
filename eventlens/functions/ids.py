"""Identifier and URL building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for identical results.
ARCHIVE_BASE = "https://www.sec.gov/Archives/edgar/data"
INDEX_BASE = "https://data.sec.gov/submissions/"
CIK_WIDTH = 10
# ---------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_padded(c: Column | str, width: int) -> Column:
    """Text padded with zeros on the left to at least ``width`` characters.
    A longer one stays whole (``lpad`` alone would cut it)."""
    text = _col(c).cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def padded_cik(cik: Column | str) -> Column:
    """CIK zero-padded to 10 digits (index file name)."""
    return zero_padded(cik, CIK_WIDTH)


def index_url(cik: Column | str) -> Column:
    return F.concat(F.lit(INDEX_BASE + "CIK"), padded_cik(cik), F.lit(".json"))


def document_url(cik: Column | str, accession: Column | str, primary_document: Column | str) -> Column:
    """Archive URL: unpadded CIK, accession without dashes, document name."""
    return F.concat_ws("/", F.lit(ARCHIVE_BASE), _col(cik).cast("string"),
                       F.replace(_col(accession), F.lit("-"), F.lit("")),
                       _col(primary_document))
