"""Shared pieces of the operators: Arrow passes over rows, checked broadcasts, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import BATCH_BYTES, SLICE_BYTES, arrow_map, discard, give_back, materialize, ship, shared_dir, table  # noqa: F401

#: Bytes of files, and rows, that may be broadcast; beyond either every join is a shuffle join.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 1_000_000
#: Files that are small at any ratio of compression: their rows need no count.
TINY_BYTES = 2 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds about `most` bytes of the column, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        length = pc.list_value_length if pa.types.is_list(col.type) else pc.binary_length
        sizes = pc.fill_null(length(col), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)


def give_back_heaps(spark: SparkSession) -> None:
    """Have the executors' JVMs return the heap that they do not need: a heap grows while there is
    garbage and keeps its pages, which workers need later. One task for each core; a JVM that is
    told to disregard such requests keeps its heap."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def out_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of df: of a written table, its files'."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> DataFrame:
    """Mark a written table for broadcast if its files' bytes (as the planner knows them) and its
    rows stay under the bounds; beyond them the join shuffles and adaptive execution splits skewed
    partitions."""
    size = planned_bytes(df)
    fits = size <= TINY_BYTES or size <= BROADCAST_BYTES and df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if fits else df


def doc_key(df: DataFrame) -> DataFrame:
    """text_key: with doc_id it tells rows apart; rows equal in both are the same document."""
    return df.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


#: Bytes of written edges (about 16 each) that one task takes; more are joined round by round.
EDGE_BYTES = 8 << 20


def _joined(batches):
    """(node, root) of edges (u, v) that fit in memory: hooks to the lesser root, then shortcuts."""
    got = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = (got.column(c).to_numpy() for c in ("u", "v"))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        x, y = up[a], up[b]
        if (open_ := x != y).any():
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while (further := up[up]).tobytes() != up.tobytes():
                up = further
        else:
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], names=["node", "root"])


def connected_components(edges: DataFrame, rounds: int = 60, edge_bytes: int = EDGE_BYTES) -> DataFrame:
    """Components of undirected edges (src, dst: long) as rows (node, root), root the least node.

    Edges of up to edge_bytes (as written) are joined in one task. More of them alternate
    large-star and small-star steps until they stay the same; each round is written to the shared
    folder, and every step is an aggregate and an equi-join, so nothing without a bound is gathered
    in one task or on the driver. No edges: no rows. Self-loops and repeats are ignored.
    """
    e = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if planned_bytes(e) <= edge_bytes:
        out = materialize(arrow_map(e.coalesce(1), _joined, "node long, root long"))
        discard(e)
        return out
    before = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        old, e = e, materialize(star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        discard(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
