"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: A side is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it; a temporary one only on a single machine where none is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        at = tempfile.mkdtemp(prefix="vertexloom-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again.

    Unlike checkpoint() this runs the plan once, and unlike localCheckpoint()
    it outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vertexloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by stored(), once all that reads them is stored itself."""
    for t in tables:
        spark, path = t.sparkSession, getattr(t, "stored_at", None)
        if path:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: A bitmap for a broadcast has at most 2^MOST_BITS bits, which is 32 MB, whatever the keys.
MOST_BITS = 28
#: Bits in one row of a bitmap, as bitmap_construct_agg() makes them.
BITMAP_BITS = 1 << 15


def bitmap(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """A bitmap of the hashes in the one column of keys, n rows, about 16 bits a key up to MOST_BITS: (bucket, bits), and its size as a power of 2."""
    power = min(MOST_BITS, max(15, math.ceil(math.log2(16 * max(n, 1)))))
    low = F.col(keys.columns[0]).bitwiseAND(F.lit((1 << power) - 1))
    rows = keys.select((low / BITMAP_BITS).cast("int").alias("bucket"), (low % BITMAP_BITS).alias("at")).repartition("bucket")
    return stored(rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))), power


def maybe_in(df: DataFrame, key: str, of: tuple[DataFrame, int], name: str) -> DataFrame:
    """df with the boolean column ``name``: whether the hash in key may be in the bitmap; false means that it isn't.

    The broadcast has a proven bound, 2^MOST_BITS bits; a fuller bitmap lets more rows through and loses none.
    """
    bits, power = of
    low = F.col(key).bitwiseAND(F.lit((1 << power) - 1))
    both = df.withColumn("bitmap_at", low).join(F.broadcast(bits.select(F.col("bucket").alias("bitmap_bucket"), F.col("bits").alias("bitmap_bits"))), F.expr(f"cast(bitmap_at div {BITMAP_BITS} AS int) = bitmap_bucket"), "left")
    byte = f"cast(conv(hex(substring(bitmap_bits, cast(bitmap_at % {BITMAP_BITS} div 8 AS int) + 1, 1)), 16, 10) AS int)"
    is_set = F.coalesce(F.expr(f"(shiftright({byte}, cast(bitmap_at % 8 AS int)) & 1) = 1"), F.lit(False))
    return both.withColumn(name, is_set).drop("bitmap_at", "bitmap_bucket", "bitmap_bits")


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. Texts of one byte a character take the fast built-in, which then does the same."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links between a and b, ascending, and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        apart = low < high
        if not apart.any():
            return nodes, nodes[up]
        np.minimum.at(up, high[apart], low[apart])
        while (up[up] != up).any():
            up = up[up]


def components(spark: SparkSession, links: DataFrame, local: int = BROADCAST_ROWS) -> DataFrame:
    """Connected components of links(a, b): one row (node, component) for every node that has a link.

    Alternating large-star and small-star steps: each node's larger neighbours,
    then its smaller ones, are hung on its least neighbour. Both keep
    connectivity and need O(log n) rounds; no step expands a component into
    pairs. A hub's edges are re-aimed through a partially aggregated minimum and
    a join, so no task holds a hub's neighbourhood. Every round is written to
    the shared folder, and deleted when the next is there; rounds go on until
    nothing changes. Ids may be of any orderable type; null ends are dropped.

    Up to ``local`` counted links of longs, no more than a broadcast has, are
    united on the driver: the rounds on a few links are dozens of jobs, whose
    plans and code fill its memory.
    """
    edges = links.select("a", "b").where("a <> b")
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if all(f.dataType == LongType() for f in edges.schema) and edges.count() <= local:
        pairs = edges.toArrow()
        dropped(edges)
        return spark.createDataFrame(pa.table(united(*(pairs[c].to_numpy() for c in ("a", "b"))), ["node", "component"]), "node long, component long")
    last = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m0")).select("n", F.least("n", "m0").alias("m"))
        large = both.join(low, both.a == low.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, large.a == least.n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("n", "m"))
        before, edges = edges, stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        dropped(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(star.select("component", "component")).distinct()
