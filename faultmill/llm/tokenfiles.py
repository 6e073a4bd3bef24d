"""Token ids as binary files of Simple-8b blocks, written and read back."""

import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, ship
from .bpe import read_vocabulary
from .common import Batches, column, in_batches, texts_of
from .words import WordStore, gather, shared, summed

# Fixed values of the file format.
MAGIC = 0x53384B3031424C4B  #: first word of a block
MARK = "S8BLKEND"  #: eight bytes after each block: the line separator Spark writes
SHAPES = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
          (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]  #: (values, bits) of selectors 1, 2, ...
ESCAPE = 0  #: selector of a word followed by one value of 64 bits
NO_ID = np.iinfo(np.int64).min  #: stands for a null document id

#: Values per block, at least; a block holds whole documents.
BLOCK_IDS = 65_536
#: Blocks per file, at most.
FILE_BLOCKS = 256
#: Values of a lane: a block's directory holds the offset of each lane's first word.
LANE = 2048

COUNTS = np.array([1, *[n for n, _ in SHAPES]], np.int64)
BITS = np.array([0, *[b for _, b in SHAPES]], np.int64)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of unsigned values, and the offset of the first word of each lane.

    A lane is ``LANE`` values; no word reaches over its end.  Each word takes as many of the next values
    as fit; all lanes are walked together, a step being one word of each.
    """
    values = values.astype(np.uint64)
    n = values.size
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.arange(n, dtype=np.int32)
    end = np.minimum((at // LANE + 1) * LANE, n).astype(np.int32)
    take, selector = np.zeros(n, np.int64), np.full(n, ESCAPE, np.int64)
    for code in range(len(SHAPES), 0, -1):  # few wide values first, more narrow ones win
        count, bits = SHAPES[code - 1]
        wide = np.where(values >> np.uint64(bits) > 0, at, np.int32(n))
        wide = np.minimum.accumulate(wide[::-1])[::-1]  # first value from here that is too wide
        fits = np.minimum(wide, end) - at >= count
        if not fits.any():
            if count < min(n, LANE):
                break
            continue
        take[fits], selector[fits] = count, code
    take = np.maximum(take, 1)
    begins, where = np.zeros(n, bool), np.arange(0, n, LANE)
    while where.size:  # where the next word of each lane begins
        begins[where] = True
        after = where + take[where]
        where = after[after < end[where]]
    starts = np.flatnonzero(begins)
    codes = selector[starts]
    words = codes.astype(np.uint64) << np.uint64(60)
    for code in np.unique(codes).tolist():
        if code == ESCAPE:
            continue
        count, bits = SHAPES[code - 1]
        mine = np.flatnonzero(codes == code)
        for k in range(count):
            words[mine] |= values[starts[mine] + k] << np.uint64(k * bits)
    escaped = codes == ESCAPE
    place = np.arange(starts.size) + np.cumsum(escaped) - escaped  # an escape is followed by its value
    lanes = place[np.searchsorted(starts, np.arange(0, n, LANE))]
    return np.insert(words, np.flatnonzero(escaped) + 1, values[starts[escaped]]), lanes


def unpack(words: np.ndarray, count: int) -> np.ndarray:
    """The values of Simple-8b words."""
    words = words.astype(np.uint64)
    codes = (words >> np.uint64(60)).astype(np.int64)
    zero = np.flatnonzero(codes == ESCAPE)
    raw = np.zeros(words.size, bool)
    for i in zero.tolist():  # the word after an escape is a value, whatever it looks like
        if not raw[i] and i + 1 < words.size:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    codes = codes[heads]
    ends = np.cumsum(COUNTS[codes])
    out = np.zeros(count, np.uint64)
    for code in np.unique(codes).tolist():
        mine = np.flatnonzero(codes == code)
        begin = ends[mine] - COUNTS[code]
        if code == ESCAPE:
            out[begin] = words[heads[mine] + 1]
            continue
        bits, mask = int(BITS[code]), np.uint64((1 << int(BITS[code])) - 1)
        for k in range(int(COUNTS[code])):
            out[begin + k] = (words[heads[mine]] >> np.uint64(k * bits)) & mask
    return out


def unpack_range(words: np.ndarray, lanes: np.ndarray, count: int, lo: int, hi: int) -> np.ndarray:
    """Values ``lo`` to ``hi`` of ``count``: only the lanes that hold them are decoded."""
    if hi <= lo:
        return np.empty(0, np.uint64)
    first, last = lo // LANE, (hi - 1) // LANE
    stop = int(lanes[last + 1]) if last + 1 < lanes.size else words.size
    begin = first * LANE
    part = unpack(words[int(lanes[first]):stop], min(count, (last + 1) * LANE) - begin)
    return part[lo - begin:hi - begin]


def write_block(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, part: int, block: int) -> bytes:
    """A block: header, documents and their sizes, offsets of the lanes, words; all 64 bits, little-endian."""
    words, lanes = pack(ids)
    head = np.array([MAGIC, part, block, doc_ids.size, ids.size, words.size], np.int64)
    packed_sizes = pack(sizes)[0]
    return b"".join(x.astype("<u8").tobytes() for x in (
        head, np.array([packed_sizes.size, lanes.size]), doc_ids, packed_sizes, lanes, words))


def read_blocks(content: bytes, wanted: np.ndarray | None = None):
    """(part, block, place, document ids, sizes, values) of each block of a file.

    With ``wanted`` only documents of these ids (sorted): their lanes alone are decoded, and blocks
    without any are jumped over.
    """
    data, at, mark = np.frombuffer(content, "<u8"), 0, int.from_bytes(MARK.encode(), "little")
    while at < data.size:
        magic, part, block, docs, count, size, packed, entries = data[at:at + 8].astype(np.int64).tolist()
        if magic != MAGIC:
            raise ValueError("no block begins here")
        at += 8
        doc_ids, at = data[at:at + docs].astype(np.int64), at + docs
        packed_sizes, at = data[at:at + packed], at + packed
        lanes, at = data[at:at + entries].astype(np.int64), at + entries
        words, at = data[at:at + size], at + size
        if int(data[at]) != mark:
            raise ValueError("a block has no end mark")
        at += 1
        if wanted is None:
            yield part, block, np.arange(docs), doc_ids, unpack(packed_sizes, docs).astype(np.int64), unpack(words, count)
            continue
        place = np.flatnonzero(np.isin(doc_ids, wanted))
        if place.size:
            sizes = unpack(packed_sizes, docs).astype(np.int64)
            ends = np.cumsum(sizes)
            ids = [unpack_range(words, lanes, count, int(ends[p] - sizes[p]), int(ends[p])) for p in place.tolist()]
            yield part, block, place, doc_ids[place], sizes[place], np.concatenate(ids)


class LibraryEncoder(WordStore):
    """Ids of whole texts by the tokenizers library, word by word.

    The vocabulary drops white space and its pieces never cross it, so a text's ids are those of its
    words.  A word is normalised and cut by the file's own pattern; the library merges the pieces.
    """

    kept = 700_000

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        super().__init__()
        model = json.loads(content)
        self.whole = Tokenizer.from_str(content)
        self.special = tuple(t["content"] for t in model["added_tokens"])
        cut, spell = model["pre_tokenizer"]["pretokenizers"]
        # words laid out with a NUL between them
        self.pieces = regex.compile("\0|" + cut["pattern"]["Regex"].replace("[^", "[^\0"))
        model["normalizer"], model["added_tokens"] = None, []
        model["pre_tokenizer"]["pretokenizers"] = [{"type": "WhitespaceSplit"}, spell]
        self.merging = Tokenizer.from_str(json.dumps(model))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has; Arrow cuts the words and
        finds the different ones of the batch, so that each is looked up once."""
        if len(self.known) > self.kept:
            self._forget()
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn([word for word in words if word not in self.known])
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ids, sizes = gather(self.ids, self.bounds, place[np.array(coded.indices, np.int64)])
        return ids, summed(sizes, np.array(cut.value_lengths(), np.int64))

    def _odd(self, word: str) -> bool:
        """Whether the word holds a special token or a letter whose case depends on its place."""
        return "\0" in word or "Σ" in word or "<|" in word and any(map(word.__contains__, self.special))

    def learn(self, words: list[str]) -> None:
        odd = list(filter(self._odd, words))
        taken = set(odd)
        plain = [word for word in words if word not in taken] if odd else words
        if plain:
            laid = unicodedata.normalize("NFC", "\0".join(plain)).lower()
            found = self.pieces.findall(laid)
            ends = np.array([i for i, piece in enumerate(found) if piece == "\0"], np.int64)
            counts = np.diff(np.concatenate([[-1], ends, [len(found)]])) - 1
            found = [piece for piece in found if piece != "\0"]
            places = {piece: i for i, piece in enumerate(dict.fromkeys(found))}
            ids, bounds = self._merged(list(places))
            ids, sizes = gather(ids, bounds, np.fromiter(map(places.__getitem__, found), np.int64, len(found)))
            self.keep(plain, ids, summed(sizes, counts))
        if odd:
            ids, bounds = _joined(self.whole, odd)
            self.keep(odd, ids, np.diff(bounds))

    def _merged(self, pieces: list[str], at_once: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space, many to a call."""
        laid = [" ".join(pieces[i:i + at_once]) for i in range(0, len(pieces), at_once)]
        sizes, ids = [np.zeros(1, np.int64)], [np.empty(0, np.int32)]
        for i, made in enumerate(self.merging.encode_batch(laid, add_special_tokens=False)):
            here = min(at_once, len(pieces) - i * at_once)
            ids.append(np.array(made.ids, np.int32))
            sizes.append(np.bincount(np.array(made.word_ids, np.int64), minlength=here))
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))


def _joined(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lists = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(sizes.sum()))
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int, doc_id: str = "doc_id",
          text: str = "text") -> None:
    """Encode all texts and write their ids, each with ``end_id`` after it, as block files.

    Files lie in ascending order of documents: a range shuffle on the id (ties by text) and a sort
    inside partitions.  Blocks hold whole documents, about ``BLOCK_IDS`` ids; Spark's own writer
    commits them, so a task that is run again leaves nothing behind.  Null texts are empty, null
    ids come first; an empty table gives a folder without blocks.
    """
    content = read_vocabulary(vocabulary)
    order = ["__id", "__tie"]
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"),
                       F.xxhash64(text).alias("__tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("__part", F.spark_partition_id())

    def run(batches: Batches) -> Batches:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, block = shared(LibraryEncoder, content), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        part = 0

        def out() -> pa.RecordBatch:
            nonlocal block
            made = write_block(*(np.concatenate(x) for x in zip(*held, strict=True)), part, block)
            held.clear()
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["block"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = column(batch, "__part")[0].as_py()
            doc_ids = np.array(column(batch, "__id").fill_null(NO_ID))
            ids, sizes = encoder.encode(texts_of(batch, "__text"))
            ends = np.cumsum(sizes)
            ids, sizes = np.insert(ids, ends, end_id), sizes + 1
            ends = np.cumsum(sizes)
            lo = 0
            while lo < doc_ids.size:
                before = int(ends[lo] - sizes[lo])
                have = sum(x[2].size for x in held)
                hi = min(doc_ids.size, 1 + int(np.searchsorted(ends, before + BLOCK_IDS - have)))
                hi = max(hi, lo + 1)
                held.append((doc_ids[lo:hi], sizes[lo:hi], ids[before:int(ends[hi - 1])]))
                if have + held[-1][2].size >= BLOCK_IDS:
                    yield out()
                lo = hi
        if held:
            yield out()

    blocks = in_batches(rows, run, "block binary", keep=True)
    (blocks.select(F.col("block").cast("string").alias("value")).write.mode("overwrite")
     .option("lineSep", MARK).option("maxRecordsPerFile", FILE_BLOCKS).text(path))


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(part, block, place, doc_id, ids): the documents of block files, or of them those with the given
    ids, for which only the lanes that hold them are decoded."""
    wanted = None if doc_ids is None else np.array(sorted(doc_ids), np.int64)
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                for part, block, place, doc_ids, sizes, ids in read_blocks(batch.column(0)[i].as_py(), wanted):
                    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(sizes.size, part, np.int32)), pa.array(np.full(sizes.size, block, np.int32)),
                        pa.array(place.astype(np.int32)),
                        pa.array(doc_ids, mask=doc_ids == NO_ID),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int64))),
                    ], ["part", "block", "place", "doc_id", "ids"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # one file at a time
    return files.mapInArrow(run, "part int, block int, place int, doc_id long, ids array<long>")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read from block files: its place, number of ids and their checksum.

    As ``read``, but the ids stay in the task: (part, block, place, local long, doc_id, n_tokens,
    ids_crc32), ``local`` being the ids before it in its block.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                for part, block, _, doc_ids, sizes, ids in read_blocks(batch.column(0)[i].as_py()):
                    ends, raw = np.cumsum(sizes), memoryview(ids.astype("<u4").tobytes())
                    sums = [zlib.crc32(raw[4 * (e - n):4 * e])
                            for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(sizes.size, part, np.int32)), pa.array(np.full(sizes.size, block, np.int32)),
                        pa.array(np.arange(sizes.size, dtype=np.int32)), pa.array(ends - sizes),
                        pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(sizes), pa.array(sums, pa.int64()),
                    ], ["part", "block", "place", "local", "doc_id", "n_tokens", "ids_crc32"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # files of bounded size
    return files.mapInArrow(run, "part int, block int, place int, local long, doc_id long, n_tokens long,"
                                 " ids_crc32 long")


def digests(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write all texts, read the files back: (doc_id, start, n_tokens, ids_crc32) per document.

    ``start`` counts the ids of all documents before it: sums per block, added up over blocks (a
    row per 65,536 ids; first inside the parts, then over the parts), plus the place in the block.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write(docs, vocabulary, path, end_id)
    read_back = materialize(summaries(spark, path), "token_rows")
    blocks = read_back.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    before = ("coalesce(sum(n) OVER ({} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    inside = blocks.withColumn("in_part", F.expr(before.format("PARTITION BY part ORDER BY block")))
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.expr(before.format("ORDER BY part")).alias("in_all"))
    base = inside.join(parts, "part").select("part", "block", (F.col("in_part") + F.col("in_all")).alias("base"))
    return read_back.join(base, ["part", "block"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
