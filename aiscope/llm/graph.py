"""Connected components of an edge table, and checkpoints that survive lost executors."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where none is set, and not on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs that begin within delete their shuffle files when they end, which else stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def cut(frame: DataFrame) -> DataFrame:
    """Compute a frame once and cut its lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(frame.sparkSession)
    with tidy_shuffles(frame.sparkSession):
        return frame.checkpoint(eager=True)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def keys(id_column: str, text_column: str) -> list[Column]:
    """128 bits of a row's id and text; rows that share them share a verdict, whatever their number."""
    ident, text = F.col(id_column).cast("string"), F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return [F.xxhash64(ident, text), F.xxhash64(F.lit(1), text, ident)]


#: A key with at least so many rows, and one in so many of all rows, is met by broadcast: there are at most HOT_KEYS such keys.
HOT_ROWS, HOT_KEYS = 10_000, 10_000


def join_by_key(rows: DataFrame, labels: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the one row of ``labels`` for their key, where ``count`` is the number of ``rows`` of each key.

    Rows of a key that very many share stay where they are and meet a broadcast;
    all others are shuffled, so no task gets a hot key whole.
    """
    total = labels.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(HOT_ROWS, total // HOT_KEYS)
    few, many = labels.where(hot).drop(count), labels.where(~hot).drop(count)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(many, key)
    return rest.unionByName(rows.join(F.broadcast(few), key))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round: each keeps components and lowers the links' ends."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    # every remaining edge points from the larger end a to the smaller end b
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of undirected ``edges(a, b)`` as ``(node, root)``; root is the smallest node.

    Alternates large-star and small-star until nothing changes, with a reliable
    checkpoint after each round.  Only a count and a checksum reach the driver.
    Nodes without an edge to another node do not appear; null ends are dropped.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    seen = edges.agg(*digest).first()
    for _ in range(max_rounds):
        if not seen[0]:
            break
        edges = cut(_stars(edges))
        now = edges.agg(*digest).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b"), F.col("b")).distinct())
