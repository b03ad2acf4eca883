"""Structured Streaming forms of the stateless jobs.

News preprocessing (T1), filing preprocessing (T2) and answer parsing (F18)
are row-wise, so the batch functions apply unchanged to a streaming
DataFrame. Alignment (J1) is a stream-static left join against a
materialised returns table; returns themselves need a batch window
(row offsets), so they are recomputed in batch when new prices land.
A sink's checkpoint folder is bound to its output path, so a query that is
started again resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventlens.operators.align import align_events
from eventlens.operators.filings import preprocess_filings
from eventlens.operators.news import preprocess_news
from eventlens.schemas import NEWS_PAGE, RAW_FILINGS, RAW_NEWS

MAX_FILES_PER_TRIGGER = 1000


def page_schema(with_ticker: bool) -> T.StructType:
    """Landed page schema; ``with_ticker`` when articles carry their ticker."""
    if not with_ticker:
        return NEWS_PAGE
    article = T.StructType(RAW_NEWS.fields + [T.StructField("ticker", T.StringType())])
    return T.StructType([T.StructField("articles", T.ArrayType(article)),
                         T.StructField("allPages", T.IntegerType())])


def news_stream(spark: SparkSession, landing_dir: str, multi_line: bool = False,
                max_files_per_trigger: int = MAX_FILES_PER_TRIGGER,
                with_ticker: bool = False) -> DataFrame:
    """Landed news pages as they arrive -> one row per article (raw shape)."""
    pages = (spark.readStream.schema(page_schema(with_ticker)).option("multiLine", multi_line)
             .option("maxFilesPerTrigger", max_files_per_trigger).json(landing_dir))
    return pages.select(F.explode("articles").alias("a")).select("a.*")


def aligned_news_stream(spark: SparkSession, landing_dir: str, returns: DataFrame | None = None,
                        ticker: str | None = None, multi_line: bool = False,
                        strategy: str = "auto") -> DataFrame:
    """T1 on the stream, then (optionally) J1 against a static returns table.
    ``ticker`` labels a single-ticker landing folder (the reference's shape);
    without it, articles must carry a ``ticker`` field."""
    raw = news_stream(spark, landing_dir, multi_line, with_ticker=ticker is None)
    if ticker is not None:
        raw = raw.withColumn("ticker", F.lit(ticker))
    events = preprocess_news(raw)
    if returns is None:
        return events
    events = events.withColumnRenamed("published_date_utc", "event_date")
    return align_events(events, returns, "event_date", strategy=strategy)


def filings_stream(spark: SparkSession, landing_dir: str, form="8-K", text_mode: str = "html",
                   multi_line: bool = True, with_ticker: bool = True,
                   max_files_per_trigger: int = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """Landed filing files (JSON arrays of filings) as they arrive -> T2.
    The HTML step (``mapInPandas``) runs per micro-batch like any other."""
    fields = list(RAW_FILINGS.fields)
    if with_ticker:
        fields.append(T.StructField("ticker", T.StringType()))
    raw = (spark.readStream.schema(T.StructType(fields)).option("multiLine", multi_line)
           .option("maxFilesPerTrigger", max_files_per_trigger).json(landing_dir))
    return preprocess_filings(raw, form, text_mode)


def checkpoint_of(out_path: str) -> str:
    """Checkpoint folder inside the output folder (readers skip names with an
    underscore): the sink's log and the query's progress stay together."""
    return f"{out_path.rstrip('/')}/_checkpoint"


def start(df: DataFrame, out_path: str, checkpoint: str | None = None, fmt: str = "parquet",
          available_now: bool = True) -> StreamingQuery:
    """Append the stream to ``out_path``; ``available_now`` processes what
    has landed and stops (otherwise a 1-minute processing-time trigger)."""
    w = (df.writeStream.format(fmt).outputMode("append").option("path", out_path)
         .option("checkpointLocation", checkpoint or checkpoint_of(out_path)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
