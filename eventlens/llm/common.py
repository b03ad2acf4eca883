"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.session import apply_conf, scratch_path

#: Code points that separate words in every contract: space and \t..\r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One of the given tables, only the named columns (so the scan is pruned)."""
    apply_conf(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is a
    value, while a repeated expression inside a lambda is evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: computed
    once, lineage cut, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_state(name: str, build: Callable[[], object]) -> object:
    """An object kept for the life of a Python worker process.

    Functions of this package travel to the executors by value, so their
    module globals are new in every task. Tokenizers and word caches are dear
    to build; they are kept in a module object of their own instead."""
    home = sys.modules.setdefault("eventlens_worker_state", types.ModuleType("eventlens_worker_state"))
    if name not in home.__dict__:
        home.__dict__[name] = build()
    return home.__dict__[name]
