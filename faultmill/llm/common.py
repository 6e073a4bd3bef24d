"""Helpers shared by the operators: tables, Arrow batches, global order, components."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import discard, materialize, ship
from .words import forget_shared

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python in batches of bounded bytes; one row may exceed the bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def in_batches(df: DataFrame, make: Callable[[Batches], Batches], schema: str | StructType,
               keep: bool = False) -> DataFrame:
    """``make`` over the Arrow batches of each partition.

    What earlier operators keep in a Python worker (``words.shared``) goes, unless ``keep``.  Models
    that ``make`` refers to travel with the task and go with it.
    """
    def run(batches: Batches) -> Batches:
        if not keep:
            forget_shared()
        yield from make(batches)

    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def sliced(batches: Batches, text: str, limit: int = 1 << 20) -> Batches:
    """The same rows in batches of at most ``limit`` bytes of text, or one row: bounds array work."""
    for batch in batches:
        sizes = np.array(pc.fill_null(pc.binary_length(column(batch, text)), 0), np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def add_columns(batch: pa.RecordBatch, made: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with the named columns set; Spark takes columns by position in schema order."""
    names = [name for name in batch.schema.names if name not in made]
    arrays = [column(batch, name) for name in names]
    return pa.RecordBatch.from_arrays(arrays + list(made.values()), names + list(made))


def widened(df: DataFrame, made: str, drop: tuple[str, ...] = ()) -> StructType:
    """Schema of ``df`` without ``drop`` and without columns that ``made`` (DDL) sets anew."""
    new = StructType.fromDDL(made)
    taken = {*new.names, *drop}
    return StructType([f for f in df.schema.fields if f.name not in taken] + new.fields)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a batch, null as empty."""
    return [text or "" for text in column(batch, name).to_pylist()]


def lists_of(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """An Arrow list column from all values and how many each row has."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def numbered(df: DataFrame, order: list[Column], name: str, stage: str) -> DataFrame:
    """Add ``name``: the row's place, from 0, in the total order ``order``.

    A range shuffle and a sort inside partitions; only one row count per partition meets in one
    task, so no key, however hot, does.  The sorted rows are stored once: places are then fixed.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__place"))
    placed = materialize(placed, stage)
    before = placed.groupBy("__part").count().select(
        "__part", F.expr("coalesce(sum(count) OVER (ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING"
                         " AND 1 PRECEDING), 0)").alias("__before"))
    # one row per shuffle partition: bounded by spark.sql.shuffle.partitions
    return placed.join(F.broadcast(before), "__part").select(
        *[F.col(c) for c in df.columns], (F.col("__before") + F.col("__place")).alias(name))


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of ``a[i]`` and ``b[i]`` in ``parent``; roots are the smallest members.

    Returns the positions of the pairs that joined two trees: a spanning forest of the pairs.
    """
    left, used = np.arange(a.size), []
    while left.size:
        x, y = roots(parent, a[left]), roots(parent, b[left])
        apart = x != y
        left, low, high = left[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        high, first = np.unique(high, return_index=True)  # a tree is hung once a turn
        parent[high] = low[first]
        used.append(left[first])
    return np.concatenate(used) if used else left


def roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = parent[at]
    while True:
        above = parent[found]
        if np.array_equal(above, found):
            parent[at] = found
            return found
        found = above


_FOREST = "a long, b long"


def _forest(batches: Batches) -> Batches:
    """Spanning stars of the links seen so far; forgets nothing, keeps one row per node."""
    heads = np.empty(0, np.int64)
    nodes = np.empty(0, np.int64)
    for batch in batches:
        a, b = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        names, at = np.unique(np.concatenate([nodes, heads, a, b]), return_inverse=True)
        parent = np.arange(names.size)
        cut = np.cumsum([nodes.size, heads.size, a.size])
        old, head, left, right = np.split(at, cut)
        unite(parent, old, head)
        unite(parent, left, right)
        top = names[roots(parent, np.arange(names.size))]
        nodes, heads = names[top != names], top[top != names]
    for lo in range(0, nodes.size, 1 << 20):
        part = slice(lo, lo + (1 << 20))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(heads[part])], ["a", "b"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``: the smallest node reachable.

    Alternating large and small stars: each round every node's neighbours are hung to the smallest
    of them, until nothing changes.  Smallest neighbours are partial aggregates stored between the
    steps, so the joins with them have two shuffled sides and a hub's links can be split.  Before
    the rounds each partition replaces its links by a spanning forest.  Loops and repeats are
    harmless; null ends are left out; no links give an empty result.
    """
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    pairs = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = materialize(in_batches(pairs, _forest, _FOREST), "forest")
    seen = None
    while True:
        large = _stars(pairs, True)
        discard(pairs)
        pairs = _stars(large, False)
        discard(large)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(pairs.select(F.col("b").alias("node"), "b").distinct())


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over pairs (a, b), a > b afterwards."""
    ends = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if large:
        ends = ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = materialize(ends.groupBy("a").agg(F.min("b").alias("low"))
                      .select("a", F.least("a", "low").alias("low")), "low")
    hung = ends.join(low, "a")
    if large:
        made = hung.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        made = hung.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            low.select("a", F.col("low").alias("b")))
    made = materialize(made.distinct(), "stars")
    discard(low)
    return made
