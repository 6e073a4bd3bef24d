"""Toxicity by class-conditional Kneser-Ney models of byte sequences."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .common import Batches, add_columns, column, in_batches, sliced, texts_of, widened

ORDER = 6  #: bytes of an expression: five of context and the one they predict
DISCOUNT = 0.75
#: Documents the decision is fitted on, about; drawn by hash from rows the counts leave out.
CALIBRATION_DOCS = 20_000
#: A word's log ratio above this counts as excess.
STRONG = 6.0

_MIX = np.uint64(0x9E3779B97F4A7C15)


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts, a space on either side, in one byte array with gaps; starts and sizes."""
    coded = [f" {text.lower()} ".encode() for text in texts]
    gap = b"\0" * (ORDER - 1)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    return np.frombuffer(gap + gap.join(coded) + gap, np.uint8), starts, sizes


def grams(raw: np.ndarray) -> np.ndarray:
    """The ``ORDER`` bytes that begin at each place, as one number."""
    n = raw.size - ORDER + 1
    keys = np.zeros(n, np.uint64)
    for k in range(ORDER):
        keys <<= np.uint64(8)
        keys |= raw[k:k + n]
    return keys


def gram_counts(rows: DataFrame, text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(gram, toxic_docs, other_docs): in how many documents of each class an expression occurs.

    Counted per document, so that a text that repeats itself weighs once; combined in the task
    before the shuffle.
    """

    def run(batches: Batches) -> Batches:
        keys, counts = np.empty(0, np.uint64), np.empty((0, 2), np.int64)
        for batch in sliced(batches, text):
            labels = np.array(column(batch, toxic), np.int64)
            raw, starts, sizes = lay_out(texts_of(batch, text))
            all_keys = grams(raw)
            found = [[], []]
            for start, size, label in zip(starts.tolist(), sizes.tolist(), labels.tolist(), strict=True):
                own = np.unique(all_keys[start - ORDER + 1:start - ORDER + 1 + size])
                found[0 if label == 1 else 1].append(own)
            for side in (0, 1):
                new, n = np.unique(np.concatenate([*found[side], np.empty(0, np.uint64)]), return_counts=True)
                more = np.zeros((new.size, 2), np.int64)
                more[:, side] = n
                keys, counts = np.concatenate([keys, new]), np.concatenate([counts, more])
            if keys.size > 1 << 20:
                keys, counts = _summed(keys, counts)
                if keys.size > 1 << 19:
                    yield _rows(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield _rows(*_summed(keys, counts))

    made = in_batches(rows.select(text, toxic), run, "gram long, toxic_docs long, other_docs long")
    return made.groupBy("gram").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("other_docs").alias("other_docs"))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(keys, return_inverse=True)
    made = np.zeros((names.size, 2), np.int64)
    np.add.at(made, at, counts)
    return names, made


def _rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64)), pa.array(counts[:, 0]), pa.array(counts[:, 1])],
        ["gram", "toxic_docs", "other_docs"])


def _tail(name: str, order: int) -> Column:
    return F.col(name).bitwiseAND(F.lit((1 << (8 * order)) - 1))


def _backoff(counts: DataFrame) -> DataFrame:
    """(gram, p) of order ``ORDER - 1``: Kneser-Ney probabilities shared by both classes.

    Every lower order counts the different bytes seen before an expression, over all classes.
    """
    kinds = [counts.select("gram")]
    for order in range(ORDER - 1, 0, -1):
        kinds.append(kinds[-1].groupBy(_tail("gram", order).alias("gram")).agg(F.count("*").alias("n")))
        kinds[-1] = materialize(kinds[-1], f"continuations{order}")
    lowest = kinds[-1].crossJoin(kinds[-1].agg(F.sum("n").alias("total")))  # at most 256 rows, and one
    shared = lowest.select("gram", (F.col("n") / F.col("total")).alias("p"))
    for order in range(2, ORDER):
        kind = kinds[ORDER - order].withColumn("context", F.shiftright("gram", 8))
        context = kind.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        kind = kind.join(context, "context").withColumn("tail", _tail("gram", order - 1))
        below = shared.select(F.col("gram").alias("tail"), F.col("p").alias("below"))
        shared = kind.join(below, "tail").select("gram", (
            (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types") * F.col("below"))
            / F.col("total")).alias("p"))
    return shared


def ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log ratios toxic to ordinary: (gram, ratio) seen, (context, ratio) for the rest.

    A gram that neither class has seen takes both classes' backoff weight times the same shared
    probability, so its ratio depends on the context alone.
    """
    counts = counts.withColumn("context", F.shiftright("gram", 8)).withColumn("tail", _tail("gram", ORDER - 1))
    sides = ("toxic", "other")
    context = materialize(counts.groupBy("context").agg(
        *[F.sum(f"{s}_docs").alias(f"{s}_total") for s in sides],
        *[F.sum((F.col(f"{s}_docs") > 0).cast("long")).alias(f"{s}_types") for s in sides]), "contexts")

    def spare(side: str) -> Column:
        return F.when(F.col(f"{side}_total") > 0, DISCOUNT * F.col(f"{side}_types") / F.col(f"{side}_total")).otherwise(1.0)

    def chance(side: str) -> Column:
        seen = F.greatest(F.col(f"{side}_docs") - DISCOUNT, F.lit(0.0)) / F.col(f"{side}_total")
        return F.when(F.col(f"{side}_total") > 0, seen).otherwise(0.0) + spare(side) * F.col("p")

    below = _backoff(counts).select(F.col("gram").alias("tail"), "p")
    known = counts.join(context, "context").join(below, "tail")
    return (known.select("gram", F.log(chance("toxic") / chance("other")).alias("ratio")),
            context.select("context", F.log(spare("toxic") / spare("other")).alias("ratio")))


_TOP = np.uint64(1 << 63)


class Table:
    """The ratio of every key of ``_collected``; others have none.

    Keys are kept whole, in the order of their product with an odd number, which no two share.  The
    leading bits of the product tell where a key's few neighbours begin; bits grow with the keys.  The
    table itself stays in files that Spark hands to the executors: only their names travel with a task,
    and who looks a key up first reads them, in the order of the products.
    """

    def __init__(self, files: list[str]):
        self.files, self.mixed = files, None

    def __getstate__(self):
        return self.files

    def __setstate__(self, files):
        self.__init__(files)

    def _read(self) -> None:
        parts = [pq.ParquetFile(SparkFiles.get(name)).read(use_threads=False) for name in self.files]
        rows = pa.concat_tables([*parts, pa.table({"mixed": pa.array([], pa.int64()), "ratio": pa.array([], pa.float32())})])
        self.mixed = rows["mixed"].to_numpy().view(np.uint64) ^ _TOP
        self.ratios = rows["ratio"].to_numpy()
        self.shift = np.uint64(64 - max(8, int(self.mixed.size).bit_length()))
        counts = np.bincount((self.mixed >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32 if self.mixed.size < 1 << 31 else np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The ratio of each key, nan if it has none."""
        if self.mixed is None:
            self._read()
        made = np.full(keys.size, np.nan, np.float32)
        mixed = keys * _MIX
        slot = (mixed >> self.shift).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        left = np.flatnonzero(at < end)
        at, end, mixed = at[left], end[left], mixed[left]
        while left.size:
            hit = self.mixed[at] == mixed
            made[left[hit]] = self.ratios[at[hit]]
            at = at + 1
            more = ~hit & (at < end)
            left, at, end, mixed = left[more], at[more], end[more], mixed[more]
        return made


def _collected(table: DataFrame, key: str) -> Table:
    """All rows of ``table`` as a ``Table``: twelve bytes a row, it grows with what the corpus holds.

    Tasks write it, sorted, and executors fetch its files; no row passes through the driver.
    """
    def mix(batches: Batches) -> Batches:
        for batch in batches:
            mixed = column(batch, "key").to_numpy().view(np.uint64) * _MIX ^ _TOP  # signed order is that of the products
            yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), column(batch, "ratio")], ["mixed", "ratio"])

    rows = table.select(F.col(key).alias("key"), F.col("ratio").cast("float").alias("ratio"))
    rows = materialize(in_batches(rows, mix, "mixed long, ratio float"), f"{key}-mixed")
    stored = materialize(rows.repartitionByRange("mixed").sortWithinPartitions("mixed"), f"{key}-ratios")
    files = sorted(stored.inputFiles(), key=_file_name)  # numbered in the order of the ranges
    discard(rows)
    for file in files:
        table.sparkSession.sparkContext.addFile(file)
    return Table([_file_name(file) for file in files])


def _file_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


@dataclass
class Model:
    """Scoring tables and the decision fitted on them."""

    grams: Table
    contexts: Table
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """Log ratio of each gram: its own if the training rows hold it, else that of its context, or 0."""
        ratio = self.grams.find(keys)
        rest = np.flatnonzero(np.isnan(ratio))
        ratio[rest] = np.nan_to_num(self.contexts.find(keys[rest] >> np.uint64(8)))
        return ratio

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: mean log ratio per byte, the three highest of a word, mean excess per word."""
        raw, starts, sizes = lay_out(texts)
        ratio = self.ratios(grams(raw))
        upto = np.concatenate([[0.0], np.cumsum(ratio, dtype=np.float64)])
        blank = np.flatnonzero((raw <= 32) & (raw > 0))
        made = np.zeros((len(texts), 5))
        for i, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            first = start - ORDER + 1  # the gram that predicts the first byte
            made[i, 0] = (upto[first + size] - upto[first]) / size
            cuts = blank[np.searchsorted(blank, start):np.searchsorted(blank, start + size)] - ORDER + 2
            words = upto[cuts[1:]] - upto[cuts[:-1]]
            if words.size:
                top = np.sort(words[np.argpartition(words, -3)[-3:]] if words.size > 3 else words)[::-1]
                made[i, 1:1 + top.size] = top
                made[i, 4] = np.maximum(words - STRONG, 0).sum() / words.size
        return made

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        x = np.c_[(self.features(texts) - self.centre) / self.spread, np.ones(len(texts))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def _decision(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: centre, spread, weights (the last is the intercept)."""
    if not len(y) or y.min() == y.max():  # one class or none: the class itself decides
        sure = 0.0 if not len(y) else (4.0 if y.max() == 1 else -4.0)
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.append(np.zeros(x.shape[1]), sure)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - centre) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        slope = z.T @ (p - y) / len(y) + ridge * w
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return centre, spread, w


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Learn from all rows of ``labelled`` (key, text, toxic 0/1; rows without a label are ignored).

    Seven in eight rows, by hash of the key, give the counts; of the others a sample of about
    ``CALIBRATION_DOCS`` fits the decision.  Without rows every score is 0.5.
    """
    rows = labelled.where(F.col(toxic).isNotNull()).select(
        F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(7)).alias("draw"), text, toxic)
    rows = materialize(rows, "labelled")
    held = F.pmod("draw", F.lit(8)) == 0
    counts = materialize(gram_counts(rows.where(~held), text, toxic), "grams")
    seen, rest = ratios(counts)
    model = Model(_collected(seen, "gram"), _collected(rest, "context"), np.zeros(5), np.ones(5), np.zeros(6))
    many = rows.where(held).count()
    share = min(1.0, CALIBRATION_DOCS / max(many, 1))

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, text):
            x = model.features(texts_of(batch, text)) if batch.num_rows else np.zeros((0, 5))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x[:, k]) for k in range(5)], column(batch, toxic).cast(pa.int32())],
                [*[f"x{k}" for k in range(5)], "y"])

    picked = rows.where(held & (F.pmod(F.shiftright("draw", 3), F.lit(1 << 20)) < int(share * (1 << 20))))
    sample = in_batches(picked.select(text, toxic), run, "x0 double, x1 double, x2 double, x3 double, x4 double, y int")
    sample = sample.toPandas().to_numpy(np.float64).reshape(-1, 6)  # about CALIBRATION_DOCS rows of six numbers
    model.centre, model.spread, model.weights = _decision(sample[:, :5], (sample[:, 5] == 1).astype(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", made: str = "score") -> DataFrame:
    """Add ``made`` (0 to 1) from the whole text; null counts as empty, a column of that name goes."""
    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, text):
            yield add_columns(batch, {made: pa.array(model.scores(texts_of(batch, text)))})

    return in_batches(docs, run, widened(docs, f"`{made}` double"))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents with their label, except those whose crc32(doc_id as text) mod 3 is 1.

    Several labels of a document: toxic if one says so.  Labels without a document or a value, and
    documents without an id, are no training rows.
    """
    marks = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), "text")
    # the hash side is a few bytes a row; texts are shuffled once and never sorted
    return rows.join(marks.hint("shuffle_hash"), "doc_id")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
