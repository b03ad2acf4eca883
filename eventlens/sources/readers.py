"""Scans (S1-S4, S6-S8). Every reader declares its schema or coerces every column
(prices); nothing is inferred. Missing inputs give an empty DataFrame with that schema (the
reference logs and returns an empty frame)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.dates import to_date_or_null, to_double_or_null
from eventlens.schemas import MACRO, NEWS_PAGE, PRICE_RENAMES, RESULTS

RESULTS_SUFFIX = "_benchmark.csv"  # fixed value: result file name suffix


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _or_empty(spark: SparkSession, schema: T.StructType, read: Callable[[], DataFrame]) -> DataFrame:
    """``read()``, or an empty DataFrame with ``schema`` when the path does
    not exist (the reference logs a missing file and goes on empty)."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return _empty(spark, schema)
        raise


def read_json_array(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Landing files holding one JSON array of objects each (with
    ``multi_line=False`` one array per line, so files are split). A record with
    a field of another type keeps its other fields; only a file that is no
    JSON at all is dropped (:func:`broken_files` names these)."""
    df = _permissive(spark, path, schema, multi_line)
    return df.where(~_nothing_read(schema)).drop(CORRUPT)


CORRUPT = "_corrupt_record"


def _permissive(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    wide = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return _or_empty(spark, wide, lambda: spark.read.schema(wide).option("multiLine", multi_line).option("mode", "PERMISSIVE")
                   .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def _nothing_read(schema: T.StructType) -> F.Column:
    none = reduce(lambda a, b: a & b, [F.col(f"`{f.name}`").isNull() for f in schema.fields])
    return F.col(CORRUPT).isNotNull() & none


def broken_files(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """``file``: the landing files that :func:`read_json_array` drops."""
    df = _permissive(spark, path, schema, multi_line)
    return df.where(_nothing_read(schema)).select(F.input_file_name().alias("file"))


class Landed(NamedTuple):
    """The records of landing files, and the rest of them."""

    good: DataFrame
    broken: DataFrame  # file, n_broken, sample
    n_good: int
    n_broken: int


def load_json_array(spark: SparkSession, path: str, schema: T.StructType, quarantine: str, multi_line: bool = True) -> Landed:
    """S1 with a quarantine: the files are parsed once, into a table under
    ``quarantine`` whose two partitions are the good records and what was no
    JSON. The counts (A3) ride on that write, and ``broken`` is a table per
    file: how many records broke, and the first 200 characters of one."""
    df = _permissive(spark, path, schema, multi_line)
    flagged = df.withColumns({"_file": F.input_file_name(), "_broken": _nothing_read(schema)})
    seen = Observation()
    flagged = flagged.observe(seen, F.count_if(~F.col("_broken")).alias("good"), F.count_if("_broken").alias("broken"))
    flagged.write.mode("overwrite").partitionBy("_broken").parquet(quarantine)
    n = seen.get
    back = spark.read.schema(flagged.schema).parquet(quarantine)
    broken = (back.where("_broken").groupBy(F.col("_file").alias("file"))
              .agg(F.count(F.lit(1)).alias("n_broken"), F.min(F.substring(CORRUPT, 1, 200)).alias("sample")))
    return Landed(back.where(~F.col("_broken")).select(*[f"`{f.name}`" for f in schema.fields]), broken, n["good"], n["broken"])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).json(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """S3: CSV with a header and quoted text. With line ends inside quotes
    (``multi_line``) a file is one task; without them large files are split."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("header", True)
                     .option("multiLine", multi_line).option("escape", '"').csv(path))


def read_results(spark: SparkSession, directory: str, schema: T.StructType = RESULTS,
                 multi_line: bool = True) -> DataFrame:
    """Every ``*_benchmark.csv`` in a folder (the model name is the file
    name without the suffix), and every ``model=<name>/`` folder as
    :func:`eventlens.sources.writers.write_results` lays them out. Empty files
    contribute no rows. Raw answers may hold line ends, which makes a file one
    task; ``multi_line=False`` splits files without them."""
    file_schema = T.StructType([f for f in schema.fields if f.name != "model"])
    df = _or_empty(spark, file_schema, lambda: (
        spark.read.schema(file_schema).option("header", True).option("multiLine", multi_line)
        .option("escape", '"').option("pathGlobFilter", f"*{RESULTS_SUFFIX}").csv(directory)))
    model = F.regexp_replace(F.col("_metadata.file_name"), r"_benchmark\.csv$", "")
    files = df.select(model.alias("model"), *[f.name for f in file_schema.fields])
    by_folder = T.StructType(file_schema.fields + [T.StructField("model", T.StringType())])
    folders = _or_empty(spark, by_folder, lambda: (
        spark.read.schema(by_folder).option("header", True).option("multiLine", multi_line).option("escape", '"')
        .option("basePath", directory).csv(f"{directory.rstrip('/')}/model=*")))
    return files.unionByName(folders)


def read_news_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A folder of landed news pages ``{articles: [...], allPages}``,
    all pages in one scan, one row per article. ``multi_line=True`` for one
    (possibly indented) page per file, as the API lands them; ``False`` for
    JSON Lines with one page per line."""
    pages = _or_empty(spark, NEWS_PAGE,
                      lambda: spark.read.schema(NEWS_PAGE).option("multiLine", multi_line).json(path))
    return pages.select(F.explode("articles").alias("a")).select("a.*")


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet",
                ticker: str | None = None) -> DataFrame:
    """Daily bars. Download headers are renamed to snake case (P3),
    dates and prices coerced (bad -> null), rows without a date dropped.
    ``ticker`` labels a single-ticker file."""
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(path)
    df = df.withColumnsRenamed({k: v for k, v in PRICE_RENAMES.items() if k in df.columns})
    if ticker is not None:
        df = df.withColumn("ticker", F.lit(ticker))
    return normalise_prices(df)


def normalise_prices(df: DataFrame) -> DataFrame:
    """Typed price table ``ticker, trade_date, open, high,
    low, close, adj_close, volume``; bad values -> null, undated rows dropped."""
    cols = [F.col("ticker").cast("string").alias("ticker"),
            to_date_or_null("trade_date").alias("trade_date")]
    for c in ("open", "high", "low", "close", "adj_close"):
        cols.append(to_double_or_null(c).alias(c))
    cols.append(F.col("volume").cast("string").try_cast("bigint").alias("volume"))
    return df.select(*cols).where(F.col("trade_date").isNotNull())


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    """The macro series ``(date, CPIAUCSL)``."""
    return read_csv(spark, path, MACRO)


def read_ticker_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ticker, value``: the lines of all ``ticker=<name>/`` folders
    (:func:`eventlens.sources.writers.write_ticker_files`), in one scan."""
    schema = T.StructType().add("value", T.StringType()).add("ticker", T.StringType())
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).text(path))
