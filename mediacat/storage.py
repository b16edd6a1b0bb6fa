"""Intermediate tables in the folder that all executors share, and what is built on them."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="mediacat-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may lack it; it gets a temporary one (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _local_dir()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of stored() tables that nothing reads any more."""
    for df in tables:
        jvm, path = df.sparkSession.sparkContext._jvm, df._stored_at
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name: each row's number from 1 in the order (of distinct values), without a window over all rows: parts of the range are numbered side by side."""
    ranged = stored(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.expr("sum(n) over (order by __part) - n").alias("__before"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, own + F.col("__before")).drop("__part", "__before")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node reached.

    edges: (a, b) of an orderable type; nulls and loops are dropped; no edges give no rows. Each round hooks every group to its
    least neighbour, flattens the trees by doubling their jumps, and goes on with the graph of the groups: that has at most half as many
    nodes, so the rounds grow with the logarithm of the nodes, whatever the shape. The smallest node of a group is always its root.
    """
    links = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    links = stored(links.union(links.select("b", "a")).distinct(), "links")
    hooks: list[DataFrame] = []
    while not links.isEmpty():
        least = links.groupBy("a").agg(F.min("b").alias("b"))
        back = least.select(F.col("a").alias("b"), F.col("b").alias("c"))
        tree = stored(least.join(back, "b").select(F.col("a").alias("node"), F.when((F.col("a") == F.col("c")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("root")), "tree")
        deep = True
        while deep:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
            flat = stored(tree.join(up, "root").select("node", F.col("top").alias("root"), (F.col("root") != F.col("top")).alias("moved")), "tree")
            discard(tree)
            deep, tree = not flat.where("moved").isEmpty(), flat
        hooks.append(tree)
        ends = links.join(tree.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(tree.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        rest = stored(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        discard(links)
        links = rest
    if not hooks:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = hooks[-1].select("node", "root")
    for tree in reversed(hooks[:-1]):
        found = tree.select("node", "root").join(found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return found
