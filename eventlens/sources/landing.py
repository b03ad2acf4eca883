"""Landing news articles as pages (K3 + U2 in reverse): the shape the news
API delivers, ``{articles: [...], allPages}`` with the page's number, one page
per line; and finding pages that are missing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.session import scratch_path
from eventlens.sources.writers import write_landing

PAGE_ARTICLES = 20  # fixed value: articles on a page


def to_pages(articles: DataFrame, per_page: int = PAGE_ARTICLES) -> DataFrame:
    """``page, allPages, articles``: the articles in pages of ``per_page``,
    numbered from 1. Pages are packed within a task, by list offsets over its Arrow
    batches, so articles are not shuffled and have no key; each task's last page may be
    shorter. The packed pages are stored once; the tasks' page counts (one row
    each) then give the numbers."""
    spark = articles.sparkSession
    item = T.StructType(articles.schema.fields)
    packed = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("k", T.LongType()),
                           T.StructField("articles", T.ArrayType(item))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, None

        def pages(rows: pa.StructArray, whole: bool) -> tuple[pa.RecordBatch | None, pa.StructArray]:
            nonlocal k
            n = len(rows) // per_page if whole else -(-len(rows) // per_page)
            end = min(n * per_page, len(rows))
            if not n:
                return None, rows
            ends = pa.array([*range(0, end, per_page), end], pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(k, k + n), pa.int64()),
                                              pa.ListArray.from_arrays(ends, rows.slice(0, end))], names=packed.names)
            k += n
            return out, rows.slice(end)

        for b in batches:
            rows = pa.StructArray.from_arrays(b.columns, fields=list(b.schema))
            out, held = pages(pa.concat_arrays([held, rows]) if held is not None else rows, True)
            if out is not None:
                yield out
        if held is not None and len(held):
            yield pages(held, False)[0]

    path = scratch_path(spark, "pages")
    articles.mapInArrow(pack, packed).write.parquet(path)
    stored = spark.read.schema(packed).parquet(path)
    base, total = [], 0
    for part, n in sorted(tuple(r) for r in stored.groupBy("part").count().collect()):  # a row per task
        base.append((part, total))
        total += n
    numbers = spark.createDataFrame(base, "part int, _base long")
    return (stored.join(F.broadcast(numbers), "part")
            .select((F.col("_base") + F.col("k") + 1).cast("int").alias("page"), F.lit(total).cast("int").alias("allPages"), "articles"))


def land_news(articles: DataFrame, path: str, per_page: int = PAGE_ARTICLES) -> None:
    write_landing(to_pages(articles, per_page), path)


def missing_pages(pages: DataFrame) -> DataFrame:
    """``page``: the numbers up to ``allPages`` that were not landed. Of each
    page only its number is read; all numbers are made by the tasks."""
    seen = pages.select("page").where("page is not null").distinct()
    last = pages.agg(F.max("allPages").alias("n")).where("n > 0")
    return last.select(F.explode(F.sequence(F.lit(1), "n")).alias("page")).join(seen, "page", "left_anti")
