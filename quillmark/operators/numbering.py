"""Numbers and orders over whole tables without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset, as in local tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def kept(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder, partition by partition, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", LOCAL_CHECKPOINTS))
    return df.checkpoint()


def numbered(df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "number", start: int = 1) -> DataFrame:
    """df with gapless numbers from `start` on in the given order, within each combination of keys, or over all rows.

    Rows are range-partitioned by keys and order, so a key of very many rows takes many partitions; each partition counts
    its rows of each key, the counts of the partitions before are added up for each key, and a row's number is that sum
    and its place among the partition's rows of its key. Null keys are a key, nulls come first, an empty table stays
    empty. Give an order that no two rows share, or rows of equal order are numbered as they come."""
    keys = list(keys)
    last = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*keys, *last).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys], *last)
    rows = kept(ranged.withColumn("__num_at", F.monotonically_increasing_id()))
    part = F.shiftright("__num_at", 33)
    counts = rows.groupBy(*keys, part.alias("__num_part")).agg(F.min("__num_at").alias("__num_first"), F.count("*").alias("__num_n"))
    # a key's partitions, as many as it has rows for at most
    lists = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__num_part", "__num_first", "__num_n"))).alias("__num_p"))
    running = F.aggregate(
        "__num_p", F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("before")),
        lambda a, x: F.struct((a["sum"] + x["__num_n"]).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")),
    )
    offsets = lists.select(*[F.col(k).alias(f"__num_k{i}") for i, k in enumerate(keys)], F.explode(F.arrays_zip("__num_p", running["before"].alias("before"))).alias("__num_z"))
    offsets = offsets.select(*[f"__num_k{i}" for i in range(len(keys))], F.col("__num_z.__num_p.__num_part").alias("__num_part"), F.col("__num_z.__num_p.__num_first").alias("__num_first"), F.col("__num_z.before").alias("__num_before"))
    on = part == offsets["__num_part"]
    for i, k in enumerate(keys):
        on = on & rows[k].eqNullSafe(offsets[f"__num_k{i}"])
    return rows.join(offsets, on).select(*df.columns, (F.col("__num_at") - F.col("__num_first") + F.col("__num_before") + start).alias(name))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by orders that say where nulls go; equal rows count once."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The first k rows with their place: each partition keeps k rows, so nothing is sorted as a whole. k is small."""
    return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
