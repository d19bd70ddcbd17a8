"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrid.checkpoint import checkpointed, ensure_checkpoint_dir  # noqa: F401

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
#: The same as a Java regular expression for a run of them.
GAP = r"[\x20\x09-\x0D]+"


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it is open, what is computed hands whole texts to Python workers in smaller Arrow batches than Spark's
    default, unless the session has its own setting; the setting is put back at the end."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if before == "10000":
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, *names: str, also: tuple[str, ...] = ()) -> list[str]:
    """Column names that start like the given ones and clash with none of df's and none of `also`."""
    taken, out = {c.lower() for c in (*df.columns, *also)}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names (an operator's own output columns win over input columns)."""
    lost = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in lost])


def col(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def mark_of(df: DataFrame, *names: str) -> Column:
    """A 64-bit hash of the values of these columns.  Spark's hashes pass over nulls and refuse maps, so each column adds
    whether it is null, and nested values are hashed as JSON, which keeps their nulls."""
    parts: list[Column] = []
    for name in names:
        nested = isinstance(df.schema[name].dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))
        parts += [col(name).isNull(), F.to_json(F.struct(col(name).alias("v"))) if nested else col(name)]
    return F.xxhash64(*parts)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a non-null text: maximal runs of characters other than SPACES."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def word_count(text: Column) -> Column:
    """Number of words of a non-null text, without keeping the words."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, buckets: int = 1024, seed: int = 42) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same group that come earlier in a fixed pseudo-random order.

    The order is by a hash bucket of the `order` columns, then by their hash, then by the columns themselves.  A group
    is never gathered in one task: sums per (group, bucket) give each bucket its start, and the running sum is taken
    inside one bucket.  Group columns must not hold nulls.  Rows that agree in all order columns get the places of
    their run in any order among themselves.
    """
    b, h, v, base = fresh(df, "_bucket", "_hash", "_value", "_base")
    keyed = df.withColumn(h, F.xxhash64(F.lit(seed), *[col(c) for c in order])).withColumn(b, F.pmod(F.shiftright(col(h), 17), F.lit(buckets)).cast("int")).withColumn(v, value.cast("long"))
    before = Window.partitionBy(*[col(g) for g in group]).orderBy(col(b)).rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*[col(g) for g in group], col(b)).agg(F.sum(col(v)).alias(v)).select(*[col(g) for g in group], col(b), F.coalesce(F.sum(col(v)).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(*[col(g) for g in group], col(b)).orderBy(col(h), *[col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    joined = keyed.join(starts, [*group, b], "left")
    return joined.withColumn(out, col(base) + F.coalesce(F.sum(col(v)).over(inside), F.lit(0))).select(*[col(c) for c in df.columns], col(out))
