"""Sinks (K1-K5)."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventlens.functions.answers import json_quote
from eventlens.operators.align import reference_name
from eventlens.operators.guards import missing_columns, nan_to_null

JSON_OPTIONS = {
    "ignoreNullFields": "false",  # explicit nulls, like the reference's records
    "dateFormat": "yyyy-MM-dd",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssxxx",  # +00:00, like Python's isoformat
}
CSV_OPTIONS = {"header": "true", "escape": '"', "emptyValue": "", "nullValue": ""}


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """A3: ``df``, and an observation whose ``get["rows"]`` is the number of its
    rows once a query over it has run. The count rides on that query."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _rename(df: DataFrame, source: str, target: str) -> None:
    jvm = df.sparkSession._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    fs = old.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    fs.delete(new, True)
    if not fs.rename(old, new):
        raise OSError(f"cannot rename {source} to {target}")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", skip_empty: bool = True) -> bool:
    """K1 (see :func:`save_jsonl`). Returns whether anything was written."""
    return save_jsonl(df, path, mode, skip_empty) > 0 or not skip_empty


def save_jsonl(df: DataFrame, path: str, mode: str = "overwrite", skip_empty: bool = True) -> int:
    """K1: JSON Lines; NaN -> null, nulls written, ISO dates, non-ASCII kept.
    Returns the rows written, counted by the write itself (A3): the plan runs
    once. An empty table writes nothing (``skip_empty``) and leaves what stands
    at ``path``: an overwrite goes to a folder beside it, which takes its place
    when it holds rows."""
    df, seen = counted(nan_to_null(df))
    if mode != "overwrite" or not skip_empty:
        df.write.mode(mode).options(**JSON_OPTIONS).json(path)
        return seen.get["rows"]
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.options(**JSON_OPTIONS).json(beside)
    rows = seen.get["rows"]
    if rows:
        _rename(df, beside, path)
    else:
        other = df.sparkSession._jvm.org.apache.hadoop.fs.Path(beside)
        other.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(other, True)
    return rows


def write_csv(df: DataFrame, path: str, mode: str = "overwrite",
              partition_by: str | None = None) -> None:
    """K2: CSV with a header. With ``partition_by`` a folder per value;
    overwriting then replaces the folders of the values that ``df`` has, and no others."""
    w = df.write.mode(mode).options(**CSV_OPTIONS)
    if partition_by:
        w = w.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    w.csv(path)


def write_landing(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: landed records as JSON Lines (pretty-printing is not kept)."""
    df.write.mode(mode).options(**JSON_OPTIONS).json(path)


def convert_columns(df: DataFrame, field_map: Mapping[str, str]) -> DataFrame:
    """K4: keep and rename the mapped columns (``{column: key}``); unmapped
    columns are dropped and a missing mapped column is an error."""
    missing = missing_columns(df, list(field_map))
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.select(*[F.col(f"`{c}`").alias(k) for c, k in field_map.items()])


def write_results(df: DataFrame, directory: str, mode: str = "overwrite") -> None:
    """K5: the result table partitioned by model (``model=<name>/``). A model's
    new run replaces its own results; those of other models stay."""
    write_csv(df, directory, mode, partition_by="model")


def write_price_table(prices: DataFrame, name: str, path: str, buckets: int) -> None:
    """Daily prices as the table ``name``, in ``buckets`` buckets by ticker,
    each one file sorted by ticker and day. Returns computed from it
    (:func:`eventlens.operators.returns.daily_returns`) need no exchange and no sort:
    the shuffle is paid once, when prices land. A ticker lies in one bucket; its
    daily series is bounded by the calendar."""
    (prices.repartition(buckets, "ticker").write.mode("overwrite").bucketBy(buckets, "ticker")
     .sortBy("ticker", "trade_date").option("path", path).saveAsTable(name))


def write_ticker_files(df: DataFrame, path: str, columns: Sequence[str], ticker_col: str = "ticker") -> None:
    """Labelled events as JSON Lines in a folder per ticker, with the ticker in the
    names of ``columns`` (``AAPL_ret_pct_D+1``), as one file per ticker has them:
    one write for any number of tickers."""
    def member(c: str) -> Column:
        name = F.concat(F.col(f"`{ticker_col}`"), F.lit(f"_{reference_name(c)}")) if c in columns else F.lit(c)
        value = F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {**JSON_OPTIONS})  # {"v":...}
        return F.concat(json_quote(name), F.lit(":"), F.substr(value, F.lit(6), F.length(value) - 6))

    df = nan_to_null(df)
    line = F.concat(F.lit("{"), F.concat_ws(",", *[member(c) for c in df.columns if c != ticker_col]), F.lit("}"))
    df.select(F.col(f"`{ticker_col}`").alias("ticker"), line.alias("value")).write.partitionBy("ticker").text(path)
