"""Hard negatives by Hilbert-ordered blocks with zone maps."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import Batches, column, in_batches, numbered

#: Rows per block.
BLOCK = 512
#: Anchors searched in one pass over the blocks, at most, and the bytes of their vectors, at most.
ANCHORS_AT_ONCE = 8192
ANCHOR_BYTES = 16 << 20
#: Largest component after scaling: inner products of up to 2,048 components then fit 64 bits.
LARGEST = 1 << 26
#: Stands for a row without an id; sorts behind all ids.
NO_ID = np.iinfo(np.int64).max
#: Stands for an anchor's score with itself; below all scores.
SELF = np.iinfo(np.int64).min
#: Windows compared with a block's scores at once.
SEARCHES_AT_ONCE = 2048
#: Standard normal quantiles that cut a component into the four cells of two bits.
CELLS = (-0.6745, 0.0, 0.6745)
BITS = 2

_ROWS = "id long, label string, anchor boolean, dim int, curve binary, codes binary"
_BLOCKS = ("label string, dim int, size int, low binary, high binary, ids binary, codes binary, "
           "anchors array<int>, floors array<long>")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``cells`` (points of a grid of 2**bits a side), as bytes.

    The usual transform between axes and transposed index, all points at once; the bytes sort as the
    index does.
    """
    x = cells.T.astype(np.int64).copy()
    n = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)])
    return np.packbits(planes.T.astype(np.uint8), axis=1)


def usable(table: DataFrame, vec_id: str, label: str, embedding: str, anchor: Column, scale: int) -> DataFrame:
    """(id, label, anchor, dim, curve, codes) of the rows that take part.

    Rows without a label or vector, with a null, NaN or infinite component, or with a scaled
    component beyond ``LARGEST`` take no part.  ``codes`` are the floors of the scaled components.
    A point's cell on the curve is cut by the components over the vector's own spread, so no
    statistics of the table are needed.
    """
    rows = table.select(
        F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label).cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(embedding).cast("array<double>").alias("vector")
    ).where("label IS NOT NULL AND vector IS NOT NULL")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists = column(batch, "vector")
            sizes = np.array(lists.value_lengths(), np.int64)
            values = np.floor(scale * lists.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False))
            good = np.abs(values) <= LARGEST  # false for what is no number
            starts = np.cumsum(sizes) - sizes
            codes, curves = [None] * sizes.size, [None] * sizes.size
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                place = starts[at, None] + np.arange(dim)
                at, own = at[good[place].all(axis=1)], values[place[good[place].all(axis=1)]].astype("<i4")
                if not dim:
                    curve = np.zeros((at.size, 1), np.uint8)
                else:
                    spread = np.sqrt(np.square(own.astype(np.float64)).mean(axis=1, keepdims=True))
                    curve = hilbert(np.searchsorted(CELLS, own / np.maximum(spread, 1e-9), side="right"), BITS)
                for i, row, key in zip(at.tolist(), own, curve, strict=True):
                    codes[i], curves[i] = row.tobytes(), key.tobytes()
            made = pa.RecordBatch.from_arrays(
                [*[column(batch, c) for c in ("id", "label", "anchor")], pa.array(sizes.astype(np.int32)),
                 pa.array(curves, pa.binary()), pa.array(codes, pa.binary())],
                ["id", "label", "anchor", "dim", "curve", "codes"])
            yield made.filter(made.column("codes").is_valid())

    return in_batches(rows, run, _ROWS)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices."""
    most = [int(np.abs(x).max(initial=0)) for x in (left, right)]
    if most[0] * most[1] * max(1, left.shape[1]) < 1 << 53:  # every sum of products is exact in double
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with any point between ``low`` and ``high``."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return (products(up, low[None])[:, 0] + products(down, high[None])[:, 0],
            products(up, high[None])[:, 0] + products(down, low[None])[:, 0])


def blocks_of(rows: DataFrame, positives: int) -> DataFrame:
    """Rows of one label and length along the curve, ``BLOCK`` at a time, as rows of a table.

    ``low`` and ``high`` are the zone map: least and largest component in each dimension.  ``anchors``
    are places inside the block, and ``floors`` the score that each of them reaches with at least
    ``positives`` other rows of the block (the smallest long where the block has fewer).  A large
    label spreads over many range partitions.
    """
    laid = rows.repartitionByRange("label", "dim", "curve", "id").sortWithinPartitions(
        "label", "dim", "curve", "id")

    def block(held: list[dict]) -> pa.RecordBatch:
        dim = held[0]["dim"]
        codes = np.frombuffer(b"".join(r["codes"] for r in held), "<i4").reshape(len(held), dim)
        at = np.flatnonzero([r["anchor"] for r in held])
        floors = np.full(at.size, SELF)
        if at.size and len(held) > positives:
            scores = products(codes[at], codes)
            scores[np.arange(at.size), at] = SELF
            floors = np.partition(scores, len(held) - positives, axis=1)[:, len(held) - positives]
        ids = np.array([r["id"] for r in held], "<i8")
        return pa.RecordBatch.from_arrays([
            pa.array([held[0]["label"]]), pa.array([dim], pa.int32()), pa.array([len(held)], pa.int32()),
            *[pa.array([x.tobytes()], pa.binary()) for x in (codes.min(axis=0), codes.max(axis=0), ids, codes)],
            pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([floors.tolist()], pa.list_(pa.int64())),
        ], ["label", "dim", "size", "low", "high", "ids", "codes", "anchors", "floors"])

    def run(batches: Batches) -> Batches:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) == BLOCK or (row["label"], row["dim"]) != (held[0]["label"], held[0]["dim"])):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    return in_batches(laid, run, _BLOCKS)


def anchors_of(blocks: DataFrame) -> DataFrame:
    """(block, place, id, label, dim, floor, codes) of every anchor of stored blocks."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.array(r["anchors"], np.int64)
                codes = np.frombuffer(r["codes"], "<i4").reshape(r["size"], r["dim"])[at]
                n = at.size
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["block"]] * n, pa.int64()), pa.array(at.astype(np.int32)),
                    pa.array(np.frombuffer(r["ids"], "<i8")[at]), pa.array([r["label"]] * n, pa.string()),
                    pa.array([r["dim"]] * n, pa.int32()), pa.array(r["floors"], pa.int64()),
                    pa.array([row.tobytes() for row in codes], pa.binary()),
                ], ["block", "place", "id", "label", "dim", "floor", "codes"])

    some = blocks.where(F.size("anchors") > 0).select(
        "block", "label", "dim", "size", "ids", "codes", "anchors", "floors")
    return in_batches(some, run, "block long, place int, id long, label string, dim int, floor long, codes binary")


class Anchors:
    """One pass's anchors: vectors by length, and what each has found so far."""

    def __init__(self, rows: list):
        self.block = np.array([r.block for r in rows], np.int64)
        self.place = np.array([r.place for r in rows], np.int64)
        self.label = np.array([r.label for r in rows], object)
        self.floor = np.array([r.floor for r in rows], np.int64)
        dims = np.array([r.dim for r in rows], np.int64)
        self.by_dim = {}
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            codes = np.frombuffer(b"".join(bytes(rows[i].codes) for i in at), "<i4").reshape(at.size, dim)
            self.by_dim[dim] = at, codes

    def same(self, label: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of the label and length, and their vectors."""
        at, codes = self.by_dim.get(dim, (np.empty(0, np.int64), np.empty((0, dim), np.int32)))
        held = self.label[at] == label
        return at[held], codes[held]

    def other(self, label: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of the length and of other labels, and their vectors."""
        at, codes = self.by_dim.get(dim, (np.empty(0, np.int64), np.empty((0, dim), np.int32)))
        held = self.label[at] != label
        return at[held], codes[held]


class Windows:
    """Score windows of (anchor, positive) pairs, equal ones of an anchor once.

    A window holds the scores that ``share``'s two hundredths of the positive's score bound.
    """

    def __init__(self, positives: list, share: tuple[int, int]):
        spans = {}
        for anchor, score in positives:
            low, high = -(-share[0] * score // 100), share[1] * score // 100  # exact for any whole numbers
            if low <= high:
                spans[anchor, score] = low, high
        self.names = sorted(spans)
        self.anchor = np.array([a for a, _ in self.names], np.int64)
        self.score = np.array([s for _, s in self.names], np.int64)
        self.low = np.array([spans[k][0] for k in self.names], np.int64)
        self.high = np.array([spans[k][1] for k in self.names], np.int64)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the anchors ``at`` (ascending), and the place in ``at`` of each one's anchor."""
        place = np.searchsorted(at, self.anchor)
        held = np.flatnonzero((place < at.size) & (at[np.minimum(place, at.size - 1)] == self.anchor)) if at.size else (
            np.empty(0, np.int64))
        return held, place[held]


class Best:
    """The best ``limit`` (score, id) of each of many searches, higher scores and smaller ids first."""

    def __init__(self, searches: int, limit: int):
        self.limit = limit
        self.found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * searches
        #: what a row must reach to be of use; grows as a task goes on
        self.least = np.full(searches, SELF)

    def add_all(self, searches: np.ndarray, scores: np.ndarray, ids: np.ndarray, low: np.ndarray,
                high: np.ndarray | None = None) -> None:
        """Enter rows of scores, one row per search; only those from ``low`` to ``high`` are of use."""
        use = scores >= np.maximum(np.maximum(low, self.least[searches]), SELF + 1)[:, None]
        if high is not None:
            use &= scores <= high[:, None]
        for i in np.flatnonzero(use.any(axis=1)).tolist():
            self._add(int(searches[i]), scores[i][use[i]], ids[use[i]])

    def _add(self, search: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old = self.found[search]
        if old is not None:
            scores, ids = np.concatenate([old[0], scores]), np.concatenate([old[1], ids])
        best = np.lexsort((ids, -scores))[:self.limit]
        self.found[search] = scores[best], ids[best]
        if best.size == self.limit:
            self.least[search] = scores[best[-1]]

    def batches(self, names: tuple[str, str, str]) -> Batches:
        some = [i for i, f in enumerate(self.found) if f is not None]
        for lo in range(0, len(some), 4096):
            part = some[lo:lo + 4096]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(part, [self.found[i][0].size for i in part])),
                pa.array(np.concatenate([self.found[i][0] for i in part])),
                pa.array(np.concatenate([self.found[i][1] for i in part]))], list(names))


def _first(found: DataFrame, search: str, limit: int) -> DataFrame:
    """The first ``limit`` of each search over all tasks, ranked; a task sends at most ``limit``."""
    order = Window.partitionBy(search).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _positives(blocks: DataFrame, anchors: Anchors, limit: int) -> DataFrame:
    """(anchor, score, id): each anchor's best other rows of its label, from blocks whose bound
    reaches what its own block offers already."""
    def run(batches: Batches) -> Batches:
        best = Best(anchors.label.size, limit)
        for batch in batches:
            for r in batch.to_pylist():
                at, codes = anchors.same(r["label"], r["dim"])
                if not at.size:
                    continue
                low, high = (np.frombuffer(r[c], "<i4") for c in ("low", "high"))
                need = bounds(codes, low, high)[1] >= np.maximum(anchors.floor[at], best.least[at])
                at, codes = at[need], codes[need]
                scores = products(codes, np.frombuffer(r["codes"], "<i4").reshape(r["size"], r["dim"]))
                own = np.flatnonzero(anchors.block[at] == r["block"])
                scores[own, anchors.place[at[own]]] = SELF
                best.add_all(at, scores, np.frombuffer(r["ids"], "<i8"), anchors.floor[at])
        yield from best.batches(("anchor", "score", "id"))

    wanted = blocks.where(F.col("label").isin(sorted(set(anchors.label.tolist()))))
    return in_batches(wanted.select("block", "label", "dim", "size", "low", "high", "ids", "codes"), run,
                      "anchor long, score long, id long")


def _chosen(blocks: DataFrame, anchors: Anchors, windows: Windows) -> DataFrame:
    """(block, wanted): for each block that some window may need, a bit per window; reads zone maps only."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                at, codes = anchors.other(r["label"], r["dim"])
                held, place = windows.of(at)
                if not held.size:
                    continue
                least, most = bounds(codes, *(np.frombuffer(r[c], "<i4") for c in ("low", "high")))
                meets = (windows.low[held] <= most[place]) & (windows.high[held] >= least[place])
                if meets.any():
                    bits = np.zeros(windows.anchor.size, bool)
                    bits[held[meets]] = True
                    made.append((r["block"], np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int64()),
                                              pa.array([w for _, w in made], pa.binary())], ["block", "wanted"])

    return in_batches(blocks.select("block", "label", "dim", "low", "high"), run, "block long, wanted binary")


def _negatives(chosen: DataFrame, anchors: Anchors, windows: Windows, limit: int) -> DataFrame:
    """(search, score, id): each window's best rows in the blocks chosen for it."""
    def run(batches: Batches) -> Batches:
        best = Best(windows.anchor.size, limit)
        for batch in batches:
            for r in batch.to_pylist():
                at, codes = anchors.other(r["label"], r["dim"])
                bits = np.unpackbits(np.frombuffer(r["wanted"], np.uint8), count=windows.anchor.size).astype(bool)
                held, place = windows.of(at)
                held, place = held[bits[held]], place[bits[held]]
                most = bounds(codes, *(np.frombuffer(r[c], "<i4") for c in ("low", "high")))[1]
                need = most[place] >= np.maximum(windows.low[held], best.least[held])
                held, place = held[need], place[need]
                rows, place = np.unique(place, return_inverse=True)
                scores = products(codes[rows], np.frombuffer(r["codes"], "<i4").reshape(r["size"], r["dim"]))
                ids = np.frombuffer(r["ids"], "<i8")
                for lo in range(0, held.size, SEARCHES_AT_ONCE):
                    part, own = held[lo:lo + SEARCHES_AT_ONCE], scores[place[lo:lo + SEARCHES_AT_ONCE]]
                    best.add_all(part, own, ids, windows.low[part], windows.high[part])
        yield from best.batches(("search", "score", "id"))

    return in_batches(chosen, run, "search long, score long, id long")


_RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
           "negative_score long")


def mine(table: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label",
         embedding: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10,
         share: tuple[int, int] = (30, 90)) -> DataFrame:
    """Hard negatives of the rows for which ``anchor`` holds.

    Components become floor(scale * x); a row's score is its integer inner product with the anchor,
    higher scores first, ties by smaller id.  An anchor's positives are its first ``positives`` other
    rows of the same label.  For each, the first ``negatives`` rows of other labels whose score lies
    between ``share`` hundredths of the positive's score: (anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score).

    Rows lie in blocks along a Hilbert curve, stored with a zone map.  Anchors are taken in groups of
    bounded bytes, each with its positives in the driver.  Interval arithmetic on the zone maps alone
    says which blocks a group's windows may need; only these are joined back to their vectors, and
    a product is skipped where the bound is below what a task found already.  No vector is shuffled
    but to lay the blocks and to look up the chosen ones.

    Only vectors of equal length are compared; an empty one scores 0.  Repeated rows are rows of their
    own, also as anchors.  A row without an id is no anchor unless ``anchor`` says so, comes last among
    equal scores, and is returned with a null id.  See ``usable`` for rows that take no part.  Columns
    other than the three named are ignored; an empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = usable(table, vec_id, label, embedding, anchor, scale)
    blocks = materialize(blocks_of(rows, positives).withColumn("block", F.monotonically_increasing_id()), "blocks")
    asked = materialize(numbered(anchors_of(blocks), ["label", "dim", "block", "place"], "number", "anchors_laid"),
                        "anchors")
    size, longest = asked.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    step = max(1, min(ANCHORS_AT_ONCE, ANCHOR_BYTES // max(1, 4 * longest)))
    if not size:
        return spark.createDataFrame([], _RESULT)
    path = scratch_path(spark, "negatives")
    for low in range(0, size, step):
        group = asked.where((F.col("number") >= low) & (F.col("number") < low + step)).orderBy("number").collect()
        _group(blocks, group, positives, negatives, share).write.mode("append").parquet(path)
    found = spark.read.schema(_RESULT).parquet(path)
    return found.select(*[F.nullif(c, F.lit(NO_ID)).alias(c) if c.endswith("_id") else c for c in found.columns])


def _group(blocks: DataFrame, group: list, positives: int, negatives: int, share: tuple[int, int]) -> DataFrame:
    """The result of one group of anchors; positives and windows are bounded by the group."""
    spark = blocks.sparkSession
    anchors = Anchors(group)
    near = _first(_positives(blocks, anchors, positives), "anchor", positives).select(
        "anchor", "rank", "id", "score").collect()
    windows = Windows([(r.anchor, r.score) for r in near], share)
    chosen = materialize(_chosen(blocks, anchors, windows), "chosen")
    wanted = blocks.select("block", "label", "dim", "size", "low", "high", "ids", "codes").join(chosen, "block")
    found = _first(_negatives(wanted, anchors, windows, negatives), "search", negatives)
    search = {name: i for i, name in enumerate(windows.names)}
    named = [(search[r.anchor, r.score], int(group[r.anchor].id), int(r.id), int(r.score))
             for r in near if (r.anchor, r.score) in search]
    pairs = spark.createDataFrame(named, "search long, anchor_id long, positive_id long, positive_score long")
    return found.join(pairs, "search").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), good AS (
  SELECT row_number() OVER () AS n, vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS c
  FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.n AS an, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score
  FROM good a JOIN good b ON a.n <> b.n AND len(a.c) = len(b.c) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id) AS r
                 FROM scored WHERE same) WHERE r <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.an, p.r ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON p.an = s.an AND NOT s.same
   AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""
