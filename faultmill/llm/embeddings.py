"""Embedding near-duplicates by int8 tile products with error bounds."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import Batches, column, components, in_batches, roots, unite

#: Different vectors per tile.
TILE = 2048
#: Pairs recomputed at once.
EXACT_PAIRS = 100_000
#: Covers the rounding of unit vectors, scales and errors themselves in double precision.
SLACK = 1e-9

_VECTORS = "id long, label string, dim int, vector binary"


def usable(table: DataFrame, vec_id: str, label: str, embedding: str) -> DataFrame:
    """(id, label, dim, vector) of all rows; ``vector`` (doubles) is null where nothing may link.

    That is without a label, or where the embedding is null, empty, all zero, or holds a null, a NaN
    or an infinity.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                        F.col(embedding).cast("array<double>").alias("vector"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            labels = column(batch, "label")
            lists = column(batch, "vector")
            sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
            flat = lists.flatten()
            values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype("<f8")
            values = values + 0.0  # one zero only
            ends = np.cumsum(sizes)
            made = []
            for end, size, named in zip(ends.tolist(), sizes.tolist(), labels.is_valid().to_pylist(), strict=True):
                own = values[end - size:end]
                good = named and size and np.isfinite(own).all() and own.any()
                made.append(own.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), labels, pa.array(sizes.astype(np.int32)), pa.array(made, pa.binary())],
                ["id", "label", "dim", "vector"])

    return in_batches(rows, run, _VECTORS)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, the scale of each row, and the length of what the codes miss."""
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(units - codes * scale[:, None], axis=1)


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) whose cosine reaches the threshold; with ``b`` None inside ``a``, i < j.

    The product of the codes times the scales is off by at most e + f + e * f, e and f being what
    the codes of the two vectors miss.  Only pairs that could reach the threshold are recomputed in
    double precision.
    """
    ua = unit(a)
    qa, sa, ea = quantised(ua)
    ub, qb, sb, eb = (ua, qa, sa, ea) if b is None else (u := unit(b), *quantised(u))
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of codes stay exact
    right = qb.astype(kind).T
    found = []
    for lo in range(0, len(ua), 256):
        part = slice(lo, lo + 256)
        near = (qa[part].astype(kind) @ right) * sa[part, None] * sb + (
            (ea[part, None] + eb) + ea[part, None] * eb)
        i, j = np.nonzero(near >= threshold - SLACK)
        i += lo
        if b is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, i.size, EXACT_PAIRS):
            x, y = i[k:k + EXACT_PAIRS], j[k:k + EXACT_PAIRS]
            hold = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
            found.append((x[hold], y[hold]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tiles(kinds: DataFrame) -> DataFrame:
    """(tile, label, dim, n, copies, vectors): different vectors of one label and length, packed.

    Tiles are cut from range partitions: a large label spreads over many.
    """
    laid = kinds.repartitionByRange("label", "dim", "mark").sortWithinPartitions("label", "dim", "mark").select(
        "label", "dim", "kind", "copies", "vector")

    def run(batches: Batches) -> Batches:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            rows, held[:] = held[:TILE], held[TILE:]
            label, dim = rows[0][:2]
            return pa.RecordBatch.from_arrays([
                pa.array([label]), pa.array([dim], pa.int32()), pa.array([rows[0][2]], pa.int64()),
                pa.array([np.array([r[2] for r in rows], "<i8").tobytes()], pa.binary()),
                pa.array([np.array([r[3] for r in rows], "<i8").tobytes()], pa.binary()),
                pa.array([b"".join(r[4] for r in rows)], pa.binary()),
            ], ["label", "dim", "tile", "kinds", "copies", "vectors"])

        for batch in batches:
            for row in zip(*[column(batch, c).to_pylist() for c in batch.schema.names], strict=True):
                if held and (row[:2] != held[0][:2] or len(held) == TILE):
                    yield out()
                held.append(row)
        if held:
            yield out()

    return in_batches(laid, run, "label string, dim int, tile long, kinds binary, copies binary, vectors binary")


def _joined(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links) per vector of a tile pair that has links there: its root in the pair, how many."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                one = row["a"] == row["b"]
                sides = ("a",) if one else ("a", "b")
                names = np.concatenate([np.frombuffer(row[f"{s}_kinds"], "<i8") for s in sides])
                copies = np.concatenate([np.frombuffer(row[f"{s}_copies"], "<i8") for s in sides])
                parts = [np.frombuffer(row[f"{s}_vectors"], "<f8").reshape(-1, row["dim"]) for s in sides]
                i, j = tile_links(parts[0], None if one else parts[1], threshold)
                j = j if one else j + len(parts[0])
                parent = np.arange(names.size)
                unite(parent, i.astype(np.int64), j.astype(np.int64))
                links = (np.bincount(i, copies[j], names.size) + np.bincount(j, copies[i], names.size)).astype(np.int64)
                some = np.flatnonzero(links)
                top = roots(parent, np.arange(names.size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[some]), pa.array(names[top[some]]), pa.array(links[some])], ["a", "b", "links"])

    ship(pairs.sparkSession)
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a pair is some MB
    return pairs.mapInArrow(run, "a long, b long, links long")


def near_duplicates(table: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", label: str = "label",
                    embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are cosines of ``threshold`` or more inside a label.

    Equal vectors of a label are one kind, compared once with its number of copies; kinds lie in
    tiles, and each pair of tiles of a label and length is one task's product.  A task returns a row
    per vector with links, not the pairs.  Vectors that may not link (see ``usable``) have no links
    and are their own component; null ids are counted as links but name no component, and are not
    kept.  The threshold must be above 0.  An empty table gives an empty result.
    """
    vectors = materialize(usable(table, vec_id, label, embedding), "vectors")
    kinds = vectors.where("vector IS NOT NULL").groupBy("label", "dim", "vector").agg(
        F.min("id").alias("low"), F.count("*").alias("copies"))
    kinds = materialize(kinds.withColumn("mark", F.xxhash64("vector")).withColumn(
        "kind", F.monotonically_increasing_id()), "kinds")
    tiles = materialize(_tiles(kinds), "tiles")
    listed = tiles.select("label", "dim", "tile")
    pairs = listed.withColumnRenamed("tile", "a").join(
        listed.withColumnRenamed("tile", "b"), ["label", "dim"]).where("a <= b")
    pairs = materialize(pairs, "tile_pairs")

    def side(name: str) -> DataFrame:
        return tiles.select(F.col("tile").alias(name), *[F.col(c).alias(f"{name}_{c}")
                                                         for c in ("kinds", "copies", "vectors")])

    dealt = pairs.join(side("a"), "a").join(side("b"), "b").select(
        "dim", "a", "b", *[f"{s}_{c}" for s in ("a", "b") for c in ("kinds", "copies", "vectors")])
    found = materialize(_joined(dealt, threshold), "tile_links")
    links = materialize(found.groupBy("a").agg(F.sum("links").alias("links")), "links")
    parts = components(found)
    named = kinds.select("kind", "low", "copies").join(links, F.col("kind") == F.col("a"), "left").join(
        parts, F.col("kind") == F.col("node"), "left").select(
        "kind", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "kind").alias("root"))
    named = materialize(named, "named")
    least = materialize(named.groupBy("root").agg(F.min("low").alias("component")), "least")
    result = materialize(named.join(least, "root").select("kind", "n_links", "component"), "results")
    by_vector = materialize(kinds.select("kind", "label", "dim", "vector").join(result, "kind")
                            .drop("kind"), "by_vector")
    linked = vectors.where("vector IS NOT NULL").join(by_vector, ["label", "dim", "vector"]).select(
        "id", "n_links", "component")
    alone = vectors.where("vector IS NULL").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id,
       v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.vec_id
LEFT JOIN n ON n.a = v.vec_id
"""
