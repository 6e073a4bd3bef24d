"""SimHash near-duplicates: fingerprints, linked by a binary trie self-join."""

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .common import Batches, add_columns, column, components, in_batches, roots, unite, widened

#: Distinct fingerprints that share a key and are joined by one task, at most.
GROUP_LIMIT = 4_000
#: Node pairs that are expanded together.
WAVE = 400_000


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if set in over half of the shingles' hashes."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*[tokens[k:] for k in range(words)], strict=False))
    total = max(1, len(tokens) - words + 1)
    return _majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, total))


def _majority(hashes: np.ndarray) -> int:
    """Each bit that is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, hashes.size, 1 << 14):
        rows = hashes[lo:lo + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", made: str = "fingerprint", words: int = 3,
                 seed: int = 42) -> DataFrame:
    """Add ``made`` (long, the 64 bits): the SimHash over word shingles of the whole text.

    A-Z are lower-cased; words are runs without ASCII white space; repeated shingles count as often
    as they occur; a text of fewer words is one shingle; one without words, or null, gives 0.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = column(batch, text).cast(pa.binary()).to_pylist()
            bits = np.array([fingerprint(t or b"", words, seed) for t in texts], np.uint64)
            yield add_columns(batch, {made: pa.array(bits.view(np.int64))})

    return in_batches(df, run, widened(df, f"`{made}` long"))


def trie_links(values: np.ndarray, groups: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions i, j) that join all values of a group which are linked somehow.

    ``values`` are sorted by (group, value); ``depth`` leading bits are equal inside a group.  The
    values of a group form a binary trie, a node being a stretch of the array.  Pairs of nodes go
    down together; a step to different bits costs one, and pairs beyond the budget end.  Pairs whose
    values already hang together are left out, so dense groups cost no square of work.
    """
    n = values.size
    parent, left, right = np.arange(n), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ones: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones:
            set_bits = (values >> np.uint64(63 - bit)) & np.uint64(1)
            ones[bit] = np.concatenate([[0], np.cumsum(set_bits.astype(np.int32))]).astype(np.int32)
        return hi - (ones[bit][hi] - ones[bit][lo])

    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.empty(0, np.int64)
    ends = np.append(starts[1:], n) if n else starts
    wide = ends - starts > 1
    lo, hi = starts[wide].astype(np.int32), ends[wide].astype(np.int32)
    stack = [(depth, lo, hi, lo, hi, np.zeros(lo.size, np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, cost = stack.pop()
        if bit == 64:
            used = unite(parent, alo.astype(np.int64), blo.astype(np.int64))
            left.append(alo[used].astype(np.int64))
            right.append(blo[used].astype(np.int64))
            continue
        if bit > 40 and alo.size:
            top = roots(parent, np.arange(n))
            change = np.concatenate([[0], np.cumsum(np.r_[0, top[1:] != top[:-1]])])
            one = (change[ahi] == change[alo + 1]) & (change[bhi] == change[blo + 1])
            open_ = ~(one & (top[alo] == top[blo]))
            alo, ahi, blo, bhi, cost = alo[open_], ahi[open_], blo[open_], bhi[open_], cost[open_]
        if not alo.size:
            continue
        amid, bmid = split(alo, ahi, bit), split(blo, bhi, bit)
        same = alo == blo
        parts = []
        for x, y, price in ((0, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)):
            x0, x1 = (alo, amid) if x == 0 else (amid, ahi)
            y0, y1 = (blo, bmid) if y == 0 else (bmid, bhi)
            keep = (x1 > x0) & (y1 > y0) & (cost + price <= budget)
            if x == y:
                keep &= ~(same & (x1 - x0 == 1))
            elif x == 1:
                keep &= ~same
            parts.append((x0[keep], x1[keep], y0[keep], y1[keep], (cost + price)[keep].astype(np.int8)))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        for k in range(0, joined[0].size, WAVE):
            stack.append((bit + 1, *(x[k:k + WAVE] for x in joined)))
    return np.concatenate(left), np.concatenate(right)


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of ``parts`` nearly equal blocks of ``bits`` bits."""
    cuts = [round(bits * k / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _turned(word: Column, fixed: int, offset: int) -> Column:
    """``word`` with its bits behind the first ``fixed`` ones rotated left by ``offset``."""
    free = 64 - fixed
    tail = F.lit((1 << free) - 1 if free < 64 else -1)
    low = word.bitwiseAND(tail)
    up = F.shiftleft(low, offset).bitwiseAND(tail) if offset else low
    down = F.shiftrightunsigned(low, free - offset) if offset else F.lit(0).cast("long")
    kept = word.bitwiseAND(F.lit(~((1 << free) - 1))) if free < 64 else F.lit(0).cast("long")
    return kept.bitwiseOR(up).bitwiseOR(down)


def linked(distinct: DataFrame, budget: int = 3, limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (space, a, b) that join all fingerprints of a space at ``budget`` or fewer bits.

    ``distinct`` holds different (space int, fp long); spaces are separate kinds of fingerprints.

    Of ``budget + 1`` blocks of bits two such fingerprints have one equal.  So each fingerprint is
    keyed once per block, the block turned to the front: there the trie pairs equal nodes only, and
    the join of the remaining levels runs per key.  Keys that hold more than ``limit`` fingerprints
    are keyed again by blocks of their remaining bits, until they are small or no bits are left to
    divide: all components stay.  A task returns a spanning forest of its links, not all pairs.
    """
    rows = distinct.select("space", "fp", F.col("space").cast("long").alias("path"), F.col("fp").alias("word"))
    turns = budget + 1
    ready, level, depth = [], 0, 0
    while True:
        spread = F.array(*[F.struct((F.col("path") * turns + k).alias("path"),
                                    _turned(F.col("word"), depth, offset).alias("word"))
                           for k, (offset, _) in enumerate(_blocks(64 - depth, turns))])
        rows = rows.select("space", "fp", F.explode(spread).alias("t")).select("space", "fp", "t.path", "t.word")
        depth += (64 - depth) // turns  # a block has as many equal bits, or one more
        rows = rows.withColumn("head", F.shiftrightunsigned("word", 64 - depth))
        level += 1
        if 64 - depth <= 4 * budget:
            ready.append((depth, rows))
            break
        rows = materialize(rows, f"keys{level}")
        sizes = rows.groupBy("path", "head").count().where(F.col("count") > limit).select("path", "head")
        hot = materialize(sizes, f"hot{level}")
        if hot.isEmpty():
            ready.append((depth, rows))
            break
        ready.append((depth, rows.join(hot, ["path", "head"], "left_anti")))
        rows = rows.join(hot, ["path", "head"], "left_semi").select("space", "fp", "path", "word")
    made = None
    for depth, keyed in ready:
        links = in_batches(keyed.select("space", "fp", "path", "head", "word").repartition("path", "head"),
                           _joiner(depth, budget), "space int, a long, b long")
        made = links if made is None else made.union(links)
    return made


def _joiner(depth: int, budget: int):
    def run(batches: Batches) -> Batches:
        got = [[column(batch, c).to_numpy(zero_copy_only=False) for c in ("space", "fp", "path", "head", "word")]
               for batch in batches]
        if not got:
            return
        space, fp, path, head, word = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        word = word.view(np.uint64)
        order = np.lexsort((word, head, path))
        space, fp, path, head, word = (x[order] for x in (space, fp, path, head, word))
        fresh = np.r_[True, (path[1:] != path[:-1]) | (head[1:] != head[:-1])]
        group = np.cumsum(fresh)
        starts = np.flatnonzero(fresh)
        lo = 0
        while lo < fp.size:  # some groups at a time
            k = np.searchsorted(starts, lo + 50 * GROUP_LIMIT)
            hi = int(starts[k]) if k < starts.size else fp.size
            i, j = trie_links(word[lo:hi], group[lo:hi], depth, budget)
            yield pa.RecordBatch.from_arrays([
                pa.array(space[lo:hi][i]), pa.array(fp[lo:hi][i]), pa.array(fp[lo:hi][j])], ["space", "a", "b"])
            lo = hi

    return run


def classes(prints: DataFrame, budget: int = 3) -> DataFrame:
    """(fp, component_id) of every fingerprint in ``prints`` (doc_id, fp).

    ``component_id`` is the smallest doc_id whose fingerprint is reachable by links; null where all
    those documents have null ids.
    """
    lows = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "lows")
    parts = components(linked(lows.select(F.lit(0).alias("space"), "fp"), budget))
    named = lows.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root"))
    named = materialize(named, "named")
    least = materialize(named.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    return materialize(named.join(least, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3,
                    seed: int = 42, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per document: components of fingerprints at ``budget`` bits or fewer.

    Equal fingerprints are one class, joined once; documents get their class back by a join that
    can split a class with many copies.  Rows with null ids take part and never name a component.
    An empty table gives an empty result; repeated rows are each returned.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    prints = fingerprints(rows, "__text", "fp", words, seed).select("doc_id", "fp")
    prints = materialize(prints, "fingerprints")
    return prints.join(classes(prints, budget), "fp").select("doc_id", "fp", "component_id")


#: Seeds of the fingerprints over single words, shingle length and sketch size of ``near_copies``.
WORD_SEEDS = (42, 43, 44, 45)
SHINGLE, SKETCH = 5, 256
#: Sketches this far from the wanted share (five deviations) settle a pair; others go by all shingles.
MARGIN = 0.125
#: The first part of a sketch, and how far (six deviations) it must be off to end a pair.
COARSE, COARSE_MARGIN = 64, 0.3
#: Texts that share a shingle of their prefixes and are paired one by one, at most.
SHARED = 40
#: Texts that are looked up among all documents without a shuffle of these, at most (4 MB).
FEW = 250_000
#: Texts, and bytes of their shingles, that are compared as one tile of a family.
TILE_TEXTS, TILE_BYTES = 512, 2 << 20


def _word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of ``SHINGLE`` words, in order; a text of fewer words is one."""
    n = max(1, hashes.size - SHINGLE + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, hashes.size)):
        mixed = (mixed + hashes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _sketch(shingles: np.ndarray) -> bytes:
    """The smallest ``SKETCH`` different hashes of shingles."""
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    if small.size > 4 * SKETCH:
        # repeats only shrink the set: enlarge the cut until it holds enough different ones
        cut = 2 * SKETCH
        while True:
            least = np.unique(np.partition(small, min(cut, small.size - 1))[:cut])
            if least.size >= SKETCH or cut >= small.size:
                return least[:SKETCH].astype("<u4").tobytes()
            cut *= 4
    return np.unique(small)[:SKETCH].astype("<u4").tobytes()


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Share of common shingles, from two sketches; exact for texts of fewer than ``size`` shingles."""
    both, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    counts = counts[:size] if max(a.size, b.size) >= size else counts
    return float((counts == 2).mean()) if both.size else 1.0


def _texts(docs: DataFrame, doc_id: str, text: str, similarity: float = 0.8) -> DataFrame:
    """(doc_id, key, f0, f1, ..., sketch, n, prefix) per row; ``key`` hashes the text.

    ``n`` counts the different shingles, ``prefix`` holds the smallest ones (see ``prefix_of``).
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn(
        "key", F.xxhash64("t"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            spaces: list[list[int]] = [[] for _ in range(1 + len(WORD_SEEDS))]
            sketches, sizes, prefixes = [], [], []
            for raw in column(batch, "t").cast(pa.binary()).to_pylist():
                hashes = _word_hashes(raw)
                spaces[0].append(fingerprint(raw, 3, 42))
                for k, seed in enumerate(WORD_SEEDS):
                    mixed = (hashes ^ np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93 + 2 * seed)
                    mixed ^= mixed >> np.uint64(32)
                    spaces[1 + k].append(_majority(mixed * np.uint64(0xD6E8FEB86659FD93)))
                shingles = _shingles(hashes) if hashes.size else hashes
                sketches.append(_sketch(shingles) if hashes.size else b"")
                shingles = np.unique(shingles)
                sizes.append(shingles.size)
                prefixes.append(prefix_of(shingles, similarity).tobytes())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "key"),
                 *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in spaces], pa.array(sketches, pa.binary()),
                 pa.array(sizes, pa.int32()), pa.array(prefixes, pa.binary())],
                ["doc_id", "key", *[f"f{k}" for k in range(len(spaces))], "sketch", "n", "prefix"])

    made = ", ".join(f"f{k} long" for k in range(1 + len(WORD_SEEDS)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows, run, f"doc_id {kind}, key long, {made}, sketch binary, n int, prefix binary")


def _first_rows(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that stand for the texts ``wanted`` (key, low), a stored table, with ``__key``.

    Up to ``FEW`` of them, by count, go to every task, and no text moves; beyond that texts are shuffled once.
    """
    rows = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    named = wanted.select(F.col("key").alias("__k"), F.col("low").alias("__low"))
    # two numbers a row
    named = F.broadcast(named) if wanted.limit(FEW + 1).count() <= FEW else named.hint("shuffle_hash")
    return rows.join(named, (rows["__key"] == named["__k"]) & rows[doc_id].eqNullSafe(
        named["__low"]), "left_semi")


def _held(pairs: DataFrame, texts: DataFrame, docs: DataFrame, similarity: float, doc_id: str,
          text: str) -> DataFrame:
    """The ``pairs`` (x, y) whose texts share ``similarity`` of their shingles.

    Sketches settle what is clear; the other pairs are decided by all shingles of both texts.
    """
    def with_sketches(pairs: DataFrame, size: int) -> DataFrame:
        sketches = texts.select("key", F.substring("sketch", 1, 4 * size))
        return pairs.join(sketches.toDF("x", "p"), "x").join(sketches.toDF("y", "q"), "y").select("x", "y", "p", "q")

    def drop_far(batches: Batches) -> Batches:
        for batch in batches:
            close = [resemblance(np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4"), COARSE) >= similarity - COARSE_MARGIN
                     for p, q in zip(column(batch, "p").to_pylist(), column(batch, "q").to_pylist(), strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(close, pa.bool_()))

    # most pairs are far apart, which the first part of the sketches shows already
    close = materialize(in_batches(with_sketches(pairs, COARSE), drop_far, "x long, y long"), "close")
    both = with_sketches(close, SKETCH)

    def sort_out(batches: Batches) -> Batches:
        for batch in batches:
            sure, open_ = [], []
            for p, q in zip(column(batch, "p").to_pylist(), column(batch, "q").to_pylist(), strict=True):
                a, b = np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")
                share, exact = resemblance(a, b), max(a.size, b.size) < SKETCH
                open_.append(not exact and abs(share - similarity) < MARGIN)
                sure.append(share >= similarity)
            open_, sure = np.array(open_, bool), np.array(sure, bool)
            kept = pa.array(open_ | sure)
            yield add_columns(batch.select(["x", "y"]), {"open": pa.array(open_)}).filter(kept)

    sorted_out = materialize(in_batches(both, sort_out, "x long, y long, open boolean"), "sorted_out")
    discard(close)
    unclear = sorted_out.where("open").select("x", "y")
    clear = sorted_out.where("NOT open").select("x", "y")
    if unclear.isEmpty():
        return clear
    ends = unclear.select(F.col("x").alias("key")).union(unclear.select("y")).distinct()
    wanted = materialize(texts.join(ends, "key", "left_semi").select("key", "low"), "wanted")
    rows = _first_rows(docs, wanted, doc_id, text).select(F.col("__key").alias("key"), F.col(text).alias("t"))

    def all_shingles(batches: Batches) -> Batches:
        for batch in batches:
            sets = [np.unique(_shingles(_word_hashes(t or b""))).tobytes()
                    for t in column(batch, "t").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(sets, pa.binary())], ["key", "shingles"])

    sets = materialize(in_batches(rows, all_shingles, "key long, shingles binary").dropDuplicates(["key"]), "sets")
    both = unclear.join(sets.toDF("x", "p"), "x").join(sets.toDF("y", "q"), "y").select("x", "y", "p", "q")

    def decide(batches: Batches) -> Batches:
        for batch in batches:
            good = [share_of(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= similarity
                    for a, b in zip(column(batch, "p").to_pylist(), column(batch, "q").to_pylist(), strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    made = materialize(in_batches(both, decide, "x long, y long").union(clear), "near")
    discard(sets)
    discard(sorted_out)
    return made


def prefix_of(shingles: np.ndarray, similarity: float, hot: np.ndarray | None = None) -> np.ndarray:
    """The first of a text's different, sorted shingles: two texts at ``similarity`` share one of them.

    The order is that of the hashes, with ``hot`` ones (sorted) behind all others.  What two such
    texts share is at least ``similarity`` of the larger; so much cannot lie behind both prefixes.
    """
    if hot is not None and hot.size and shingles.size:
        at = np.minimum(np.searchsorted(hot, shingles), hot.size - 1)
        late = hot[at] == shingles
        shingles = np.concatenate([shingles[~late], shingles[late]])
    return shingles[:shingles.size - int(np.ceil(similarity * shingles.size - 1e-9)) + 1]


def _entries(rows: DataFrame) -> DataFrame:
    """(h, key, n, place, part) per shingle of the prefixes in ``rows`` (key, n, prefix, part)."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                few = batch.slice(lo, 200)
                found = [np.frombuffer(p, np.int64) for p in column(few, "prefix").to_pylist()]
                counts = [x.size for x in found]

                def spread(name: str) -> pa.Array:
                    return pa.array(np.repeat(column(few, name).to_numpy(zero_copy_only=False), counts))

                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), spread("key"), spread("n"),
                     pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in counts])), spread("part")],
                    ["h", "key", "n", "place", "part"])

    return in_batches(rows, run, "h long, key long, n int, place int, part long")


def _sharing(entries: DataFrame, similarity: float, limit: int | None = SHARED) -> DataFrame:
    """(x, y) that share an ``h`` and can reach ``similarity``, of different parts; (h, null) if hot.

    A pair ends if the sizes rule it out, or what is left of both behind the common shingle.  A
    shingle is hot if more than ``limit`` texts of several parts have it; the texts of one part
    hang together already, so a shingle they share alone makes no pairs.
    """
    def run(batches: Batches) -> Batches:
        names = ("h", "key", "n", "place", "part")
        held = [np.empty(0, np.int64)] * 5
        for batch in batches:
            new = [column(batch, c).to_numpy(zero_copy_only=False) for c in names]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held[0].size < 1 << 16:
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if last:
                yield from pairs(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held[0].size:
            yield from pairs(*held)

    def pairs(h, key, n, place, part) -> Batches:
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.append(starts, h.size))
        mixed = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts)
        hot = mixed & (sizes > limit) if limit else np.zeros(sizes.size, bool)
        if hot.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[starts[hot]]), pa.nulls(int(hot.sum()), pa.int64())], ["x", "y"])
        ends = np.repeat(starts + sizes, sizes)
        left = np.flatnonzero(np.repeat(mixed & ~hot, sizes))
        room = np.maximum(n - place, 0)
        step, found, many = 0, [], 0
        while left.size:
            step += 1
            left = left[left + step < ends[left]]
            other = left + step
            whole = n[left].astype(np.int64) + n[other]
            good = (part[left] != part[other]) & (
                np.minimum(room[left], room[other]) * (1 + similarity) >= similarity * whole - 1e-6)
            good &= np.minimum(n[left], n[other]) >= similarity * np.maximum(n[left], n[other]) - 1e-6
            if good.any():
                a, b = key[left[good]], key[other[good]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                many += a.size
            if many > 1 << 20 or not left.size:
                if found:
                    two = np.unique(np.concatenate(found, axis=1), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(two[0]), pa.array(two[1])], ["x", "y"])
                found, many = [], 0

    dealt = entries.repartition("h").sortWithinPartitions("h")
    return in_batches(dealt, run, "x long, y long")


def _parted(texts: DataFrame, near: DataFrame) -> DataFrame:
    """``texts`` (key, low, n, prefix) with ``part``: the component of the links so far."""
    parts = components(near, "x", "y")
    return texts.select("key", "low", "n", "prefix").join(parts, F.col("key") == F.col("node"), "left").select(
        "key", "low", "n", "prefix", F.coalesce("component", "key").alias("part"))


def _all_at(texts: DataFrame, near: DataFrame, docs: DataFrame, similarity: float, doc_id: str,
            text: str) -> DataFrame:
    """``near`` and what it lacks: links (x, y) so that all texts at ``similarity`` hang together.

    An exact join over prefixes of shingles in the order of their hashes.  Pairs are compared unless
    they hang together by ``near``.  Texts that share a hot shingle are joined again among themselves
    with the hot shingles last in order; texts that share hot ones even so make families, which are
    compared in tiles.
    """
    rows = materialize(_parted(texts, near), "parted")
    found = materialize(_sharing(_entries(rows), similarity), "sharing")
    pairs = materialize(found.where("y IS NOT NULL").distinct(), "prefix_pairs")
    hot = found.where("y IS NULL").select("x").distinct()
    # one number per shingle that over SHARED texts of several components have in their prefixes
    hot = np.sort(hot.toArrow()["x"].to_numpy().view(np.uint64))
    discard(found)
    if not pairs.isEmpty():
        near = near.union(_held(pairs, texts, docs, similarity, doc_id, text))
    if not hot.size:
        return near

    def has_hot(batches: Batches) -> Batches:
        for batch in batches:
            keep = [bool(np.isin(np.frombuffer(p, np.uint64), hot).any()) for p in column(batch, "prefix").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    some = in_batches(rows.select("key", "low", "n", "prefix"), has_hot, "key long, low {}, n int, prefix binary".format(
        rows.schema["low"].dataType.simpleString()))
    some = materialize(some, "hot_texts")
    raw = _first_rows(docs, some, doc_id, text).select(F.col("__key").alias("key"), F.col(text).alias("t"))

    def again(batches: Batches) -> Batches:
        for batch in batches:
            made = []
            for t in column(batch, "t").cast(pa.binary()).to_pylist():
                hashes = _word_hashes(t or b"")
                shingles = np.unique(_shingles(hashes)) if hashes.size else hashes
                made.append(prefix_of(shingles, similarity, hot).tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(made, pa.binary())], ["key", "prefix"])

    anew = in_batches(raw, again, "key long, prefix binary").dropDuplicates(["key"])
    rows = materialize(_parted(some.drop("prefix").join(anew, "key"), near), "parted")
    entries = _entries(rows)
    found = materialize(_sharing(entries, similarity), "sharing")
    pairs = materialize(found.where("y IS NOT NULL").distinct(), "prefix_pairs")
    still = materialize(found.where("y IS NULL").select(F.col("x").alias("h")).distinct(), "hot")
    discard(found)
    if not still.isEmpty():
        near = near.union(_families(entries.join(still, "h", "left_semi"), rows, docs, similarity, doc_id, text))
    return near if pairs.isEmpty() else near.union(_held(pairs, texts, docs, similarity, doc_id, text))


def _families(hot: DataFrame, rows: DataFrame, docs: DataFrame, similarity: float, doc_id: str,
              text: str) -> DataFrame:
    """Links (x, y) so that texts at ``similarity`` among those with ``hot`` entries hang together.

    Texts that share hot shingles, directly or through others, are a family.  Its texts lie in tiles by
    their number of shingles; each pair of tiles whose numbers allow for ``similarity`` is one task's
    count of common shingles, by all of them, and gives a spanning forest of its links, not the links.
    """
    edges = materialize(hot.select("key", "h").distinct(), "hot_entries")
    groups = components(edges, "key", "h")
    members = edges.select("key").distinct().join(groups, F.col("key") == F.col("node")).select(
        "key", F.col("component").alias("family"))
    members = materialize(members.join(rows.select("key", "low"), "key"), "members")
    raw = _first_rows(docs, members, doc_id, text).select(F.col("__key").alias("key"), F.col(text).alias("t"))

    def all_shingles(batches: Batches) -> Batches:
        for batch in batches:
            sets = []
            for t in column(batch, "t").cast(pa.binary()).to_pylist():
                hashes = _word_hashes(t or b"")
                sets.append(np.unique(_shingles(hashes)) if hashes.size else hashes)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), pa.array([s.size for s in sets], pa.int32()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "n", "shingles"])

    sets = in_batches(raw, all_shingles, "key long, n int, shingles binary").dropDuplicates(["key"])
    laid = sets.join(members.select("key", "family"), "key").repartitionByRange("family", "n", "key").sortWithinPartitions(
        "family", "n", "key").select("family", "n", "key", "shingles")

    def packed(batches: Batches) -> Batches:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([held[0][0]], pa.int64()), pa.array([held[0][1]], pa.int32()), pa.array([held[-1][1]], pa.int32()),
                pa.array([np.array([r[1] for r in held], "<i4").tobytes()], pa.binary()),
                pa.array([np.array([r[2] for r in held], "<i8").tobytes()], pa.binary()),
                pa.array([b"".join(r[3] for r in held)], pa.binary())], ["family", "low", "high", "sizes", "keys", "shingles"])

        for batch in batches:
            for row in zip(*[column(batch, c).to_pylist() for c in ("family", "n", "key", "shingles")], strict=True):
                if held and (row[0] != held[0][0] or len(held) == TILE_TEXTS or size + len(row[3]) > TILE_BYTES):
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield out()

    tiles = in_batches(laid, packed, "family long, low int, high int, sizes binary, keys binary, shingles binary")
    tiles = materialize(tiles.withColumn("tile", F.monotonically_increasing_id()), "family_tiles")
    listed = tiles.select("family", "tile", "low", "high")
    pairs = listed.toDF("family", "a", "a_low", "a_high").join(listed.toDF("family", "b", "b_low", "b_high"), "family").where(
        (F.col("a") <= F.col("b")) & (F.col("b_high") >= similarity * F.col("a_low"))
        & (F.col("a_high") >= similarity * F.col("b_low"))).select("a", "b")
    pairs = materialize(pairs, "family_pairs")

    def side(name: str) -> DataFrame:
        return tiles.select(F.col("tile").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("sizes", "keys", "shingles")])

    def linked_tiles(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                sides = ("a",) if r["a"] == r["b"] else ("a", "b")
                sizes = [np.frombuffer(r[f"{s}_sizes"], "<i4").astype(np.int64) for s in sides]
                keys = np.concatenate([np.frombuffer(r[f"{s}_keys"], "<i8") for s in sides])
                common = common_counts([np.frombuffer(r[f"{s}_shingles"], np.uint64) for s in sides], sizes)
                whole = sizes[0][:, None] + sizes[-1]
                i, j = np.nonzero(common * (1 + similarity) >= similarity * whole - 1e-9)
                j = j if len(sides) == 1 else j + sizes[0].size
                i, j = i[i < j], j[i < j]
                used = unite(np.arange(keys.size), i, j)
                x, y = keys[i[used]], keys[j[used]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])

    dealt = pairs.join(side("a"), "a").join(side("b"), "b")
    return materialize(in_batches(dealt, linked_tiles, "x long, y long"), "family_links")


def common_counts(shingles: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """How many shingles each text of the first tile has in common with each of the last.

    Sets lie one after another; only shingles of at least two texts count, some columns at a time.
    """
    values, at, times = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    owner = np.concatenate([np.repeat(np.arange(s.size), s) for s in sizes])
    first = np.arange(at.size) < shingles[0].size
    keep = times[at] > 1
    column_of = shared[at]
    total = np.zeros((sizes[0].size, sizes[-1].size), np.int64)
    one = len(shingles) == 1
    for lo in range(0, int(shared[-1]) + 1 if values.size else 0, 2048):
        here = keep & (column_of >= lo) & (column_of < lo + 2048)
        parts = []
        for mine, s in ((here if one else here & first, sizes[0]), *(() if one else ((here & ~first, sizes[-1]),))):
            dense = np.zeros((s.size, 2048), np.float32)
            dense[owner[mine], column_of[mine] - lo] = 1
            parts.append(dense)
        total += (parts[0] @ parts[-1].T).astype(np.int64)
    return total


def share_of(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common shingles of two sets, each without repeats."""
    common = np.intersect1d(a, b, assume_unique=True).size
    return common / (a.size + b.size - common)


def near_copies(docs: DataFrame, similarity: float = 0.8, budget: int = 3, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of the smallest id.

    Texts are near copies if they share ``similarity`` of their shingles of five words.  First candidates
    are texts whose fingerprints link at ``budget`` bits: over three words, and over single words
    with several seeds, which few edits leave close.  Beside the links themselves each text is compared
    with the text of the smallest id that its links lead to.  A candidate counts if the shingles
    of both texts say so.  Then an exact join over prefixes of shingles compares all pairs that may
    count and do not hang together yet; groups are the components of what counts.

    Equal texts are one node, whatever their number.  Null texts equal empty ones.  Null ids come
    last; rows equal in id and text are one.  The result has the columns of ``docs``.
    """
    prints = materialize(_texts(docs, doc_id, text, similarity), "prints")
    spaces = [f"f{k}" for k in range(1 + len(WORD_SEEDS))]
    texts = materialize(prints.groupBy("key").agg(
        F.min("doc_id").alias("low"), *[F.any_value(f).alias(f) for f in (*spaces, "sketch", "n", "prefix")]), "texts")
    discard(prints)
    order = F.struct(F.col("low").isNull(), "low", "key")
    laid = texts.select("key", "low", F.posexplode(F.array(*spaces)).alias("space", "fp"))
    fps = materialize(laid.groupBy("space", "fp").agg(F.min_by("key", order).alias("rep")), "reps")
    links = materialize(linked(fps.select("space", "fp"), budget), "print_links")

    def rep(fp: str, name: str) -> DataFrame:
        return fps.select("space", F.col("fp").alias(fp), F.col("rep").alias(name))

    apart = links.join(rep("a", "x"), ["space", "a"]).join(rep("b", "y"), ["space", "b"]).select("x", "y")
    equal = laid.join(fps, ["space", "fp"]).select(F.col("key").alias("x"), F.col("rep").alias("y"))
    pairs = apart.union(equal).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = materialize(pairs.distinct(), "candidates")
    discard(fps)
    discard(links)
    led = materialize(components(pairs, "x", "y"), "candidate_groups")
    led = materialize(led.join(texts.select("key", "low"), F.col("node") == F.col("key"))
                      .select("key", "low", "component"), "candidate_nodes")
    leaders = materialize(led.groupBy("component").agg(F.min_by("key", order).alias("leader")), "leaders")
    stars = led.join(leaders, "component").where("key <> leader").select(
        F.least("key", "leader").alias("x"), F.greatest("key", "leader").alias("y"))
    compared = materialize(pairs.union(stars).distinct(), "compared")
    for used in (pairs, led, leaders):
        discard(used)
    pairs = compared
    near = _held(pairs, texts, docs, similarity, doc_id, text)
    near = materialize(_all_at(texts, near, docs, similarity, doc_id, text), "near")
    groups = components(near, "x", "y")
    named = materialize(texts.select("key", "low").join(groups, F.col("key") == F.col("node"), "left").select(
        "key", "low", F.coalesce("component", "key").alias("group")), "grouped")
    kept = materialize(named.groupBy("group").agg(F.min_by(F.struct("key", "low"), order).alias("k")).select(
        "k.key", "k.low"), "kept")
    return _first_rows(docs, kept, doc_id, text).dropDuplicates([doc_id, "__key"]).drop("__key")
