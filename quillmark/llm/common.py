"""Shared plumbing of the training-data operators: staging, shipping, hashing, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset, as in local tests.
LOCAL_STAGE = "file:///tmp/checkpoints"


_kept: dict[str, Callable[[], None]] = {}


def only(name: str, clear: Callable[[], None] | None = None) -> None:
    """Called where a task begins: a Python worker that goes from one operator's tasks to another's lets go of what the
    others keep between tasks, so that it holds the caches of one operator, not of all that it has served."""
    for other in [k for k in _kept if k != name]:
        _kept.pop(other)()
    if clear is not None:
        _kept[name] = clear


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_quillmark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / "quillmark_src.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(out))
    sc._quillmark_shipped = True


def stage_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a local master, whose executors are the driver, may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (root or LOCAL_STAGE).rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/quillmark-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmark_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_quillmark_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def make_dirs(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(spark: SparkSession, n_bytes: int, per_part: int, least: int = 1) -> int:
    """Partitions so that each holds about per_part bytes; grows with the data, never under the session's own number."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes or 0) // per_part))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of the undirected edges (a, b): returns (node, component), component = smallest node.

    Contraction: every node hooks on its smallest neighbour (never a larger one), hooks are followed twice, the
    edges are renamed and loops dropped, until no edge is left. Renaming keeps connectivity and the smallest node
    of a component always keeps its own name, so the name left at the end is the component's smallest node. Each
    round is a partial aggregate and equi-joins, and is staged in the shared folder. Null ends are dropped.
    """
    e = stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").distinct(), f"{name}-edges")
    nodes, maps, open_ = e.select(F.col("a").alias("node")).union(e.select("b")).distinct(), [], e
    while not open_.isEmpty():
        both = open_.union(open_.select("b", "a"))
        # staged, so that the join with itself is dealt by p on both sides and what hooks on one hub can be split
        hook = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), f"{name}-hook")
        up = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jump = stage(hook.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p")), f"{name}-jump")
        unstage(hook)
        maps.append(jump)
        ra, rb = jump.select("a", F.col("p").alias("pa")), jump.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        named = open_.join(ra, "a").join(rb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        done, open_ = open_, stage(named, f"{name}-edges")
        if done is not e:
            unstage(done)
    labels = nodes.withColumn("component", F.col("node"))
    for jump in maps:
        labels = labels.join(jump.select(F.col("a").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    labels = stage(labels, f"{name}-labels")
    for old in (e, open_, *maps):
        unstage(old)
    return labels
