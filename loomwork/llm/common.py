"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only on one machine (master ``local``), as in tests, a temporary folder is set where it is unset; elsewhere
    executors would write where nobody reads, so that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base and context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    if not base and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return (base or context.getCheckpointDir()).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Column pruning and pushdown then work on it, which they don't on a checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``most_bytes`` of text each, at least one row a slice."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        total += n or 0
        if total >= most_bytes:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def utf8_bytes(column: str) -> F.Column:
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


HOT = 256  # rows of one key that may meet in a task, at least
MOST_HOT = 50_000  # keys that can be hot at once


def hot_keys(rows: DataFrame, key: str, n: int | None = None) -> DataFrame | None:
    """(key, pieces) of the keys that hold too many of the ``n`` ``rows`` for one task; None where there are none.

    A key is hot beyond HOT rows and beyond a MOST_HOT-th of all rows, so there are at most MOST_HOT of them at any size
    of input: few enough to be broadcast.
    """
    n = rows.count() if n is None else n
    if n <= HOT:
        return None
    limit = max(HOT, n // MOST_HOT)
    hot = stored(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / limit).cast("int").alias("_pieces")))
    return hot if hot.limit(1).count() else None


def dealt(rows: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``_piece``: 0, or for a hot key one of its pieces by the hash of ``by``."""
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    return met.withColumn("_piece", F.pmod(F.xxhash64(by), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_hot", "_pieces")


def copied(facts: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``facts``, a row or few a key, once for each piece of a hot key."""
    met = facts.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    return met.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_hot", "_pieces")


def salted_join(rows: DataFrame, facts: DataFrame, key: str, by: str, how: str = "inner", hot: DataFrame | None | str = "count") -> DataFrame:
    """Join ``rows`` to ``facts`` (a row or few a key) on ``key``; hot keys of ``rows`` are split by the hash of ``by``.

    ``hot``: what ``hot_keys`` gave, if that is known already. Null keys meet nothing and are kept apart.
    """
    hot = hot_keys(rows, key) if isinstance(hot, str) else hot
    some = rows.where(F.col(key).isNotNull())
    met = some.join(facts, key, how) if hot is None else dealt(some, key, hot, by).join(copied(facts, key, hot), [key, "_piece"], how).drop("_piece")
    if how != "left":
        return met
    return met.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges(a, b)``: one row or more per link, any order, same type. Returns ``(node, component)`` for
    every node that has a link; the component is its smallest node. Each round takes the smallest label
    among neighbours, gives it to the node that the old label names too, and then jumps to the label's own
    label, so the rounds grow with the logarithm of the longest chain. All state stays in Spark; each round is checkpointed. The links of a node that has
    very many, and the nodes of a very large component, are dealt over several tasks.
    """
    both = stored(
        edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct().select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct()
    )
    stars = hot_keys(both, "b")
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    n = labels.count()
    for _ in range(most_rounds):
        near = salted_join(both, labels.withColumnRenamed("node", "b"), "b", "a", hot=stars).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = stored(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new")))
        if not lower.where("new < old").limit(1).count():
            return labels
        hooks = lower.where("new < old").groupBy(F.col("old").alias("node")).agg(F.min("new").alias("hook"))
        hooked = checkpoint(lower.join(hooks, "node", "left").select("node", F.least("new", "hook").alias("new")))
        parent = hooked.select(F.col("node").alias("new"), F.col("new").alias("up"))
        labels = checkpoint(salted_join(hooked, parent, "new", "node", "left", hot=hot_keys(hooked, "new", n)).select("node", F.least("new", "up").alias("component")))
    raise RuntimeError("components did not settle")
