"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.sources.storage import materialise, remove

__all__ = ["WHITE", "aside", "discard", "materialise", "restored", "table", "words"]

#: ASCII white space, the only separators of words here.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote and that no later plan reads; what stays goes with ``storage.clear``."""
    for t in tables:
        remove(t.sparkSession, t._lt_path)


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE, -1), "")


def aside(docs: DataFrame, **needed: Column) -> DataFrame:
    """``needed`` columns under names of the operator's own, and each row whole in the struct ``row``, where no name clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in needed.items()])


def restored(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The rows that ``aside`` put away, those of ``new`` replaced."""
    return df.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns])
