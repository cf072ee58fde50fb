"""Shared by the training-data operators: column projection, word rules, Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.session import cut, remove, shared_dir  # noqa: F401  (used by the operators)

#: One run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
#: ``bytes.split()`` splits at the same six bytes, so Python code uses that.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller can never clash with an operator's own."""
    return docs.select(*[docs[c] for c in columns])


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def salt(of: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")


def arrow_of(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
