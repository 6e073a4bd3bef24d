"""Benchmark decontamination: latent semantic retrieval, then common-subsequence and answer checks."""

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .common import Batches, add_columns, column, in_batches, numbered, sliced, texts_of, widened

#: A passage is two neighbouring blocks of words; every block but a text's last begins one.
BLOCK = 16
#: Latent dimensions, and further columns of the random sketch.
RANK, EXTRA = 128, 16
#: Pairs of words that stand together: so many a task counts at once, and so many distinct ones it keeps.
PAIRS_AT_ONCE = 1 << 22
#: Entries of A'A whose counts are added up together.
ENTRIES = 1 << 20
#: Benchmark items searched in one pass over the documents.
ITEMS_AT_ONCE = 1_000
#: Shorter items are also looked for word by word, with their answer anywhere near.
LEAST_WORDS = 8
#: Terms in more than this share of all passages carry no weight in the index.
COMMON = 0.2
#: Passages without any term that are counted in, so that few texts make no term common.
PRIOR = 1_000
#: Cosine of candidates; share of an item's words in common order; share of its answer's words.
CANDIDATE, SEQUENCE, ANSWER = 0.5, 0.7, 0.5
#: An item without an answer is asked for this share of its words, the rarest.
RAREST = 1 / 3

_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits, lower-cased), and how many each text has.

    Every byte weighs a power of an odd base; a word's hash is the difference of two running sums,
    moved to a common power.
    """
    coded = [text.lower().encode() for text in texts]
    raw = np.frombuffer(b" ".join([*coded, b""]) or b" ", np.uint8)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    inside = _IS_WORD[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[::2], edges[1::2]
    powers = np.cumprod(np.full(raw.size, _BASE, np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(raw.astype(np.uint64) * powers)])
    # powers[::-1] moves what begins at s by n - s steps, so that all words end up at one power
    hashes = (sums[ends] - sums[starts]) * powers[::-1][starts]
    text_ends = np.cumsum(sizes + 1)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, text_ends)]))
    # the base weighs the place within the batch out, but not its length: that power is divided out
    return hashes * _unit(raw.size), counts


def _unit(size: int) -> np.uint64:
    """The inverse of the base's power ``size`` (odd numbers have one modulo 2**64)."""
    return np.uint64(pow(pow(int(_BASE), size, 1 << 64), -1, 1 << 64))


def common_subsequence(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of the item."""
    where: dict[int, int] = defaultdict(int)
    for k, word in enumerate(item):
        where[word] |= 1 << k
    full = (1 << len(item)) - 1
    row = full
    for word in region:
        hit = row & where.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


@dataclass
class Index:
    """Terms of the items with weights and latent rows, and the items."""

    terms: np.ndarray
    weights: np.ndarray
    latent: np.ndarray
    item_ids: list
    words: list[list[int]]
    answers: list[set[int] | None]
    own_answer: list[bool] = field(default_factory=list)
    slots: np.ndarray = field(init=False)
    items: np.ndarray = field(init=False)

    def __post_init__(self):
        # a multiplier that gives every term a slot of its own; without one terms are searched
        for turn in range(64):
            self.factor = np.uint64((2 * turn + 1) * int(_BASE) % (1 << 64))
            own = (self.terms * self.factor) >> np.uint64(42)
            self.crowded = np.unique(own).size < self.terms.size
            if not self.crowded:
                break
        self._lay_slots()
        rows = np.zeros((len(self.words), self.latent.shape[1]), np.float32)
        ends, owners, times = [], [], []
        for i, words in enumerate(self.words):
            at = self.find(np.array(words, np.uint64))
            held = at[at >= 0]
            rows[i] = (self.weights[held, None] * self.latent[held]).sum(axis=0)
            own, often = np.unique(at, return_counts=True)
            ends.append(own)
            owners.append(np.full(own.size, i, np.int32))
            times.append(often.astype(np.int32))
        self.items = _units(rows)
        # per term the items that hold it, and how often
        ends, owners, times = (np.concatenate([*x, np.empty(0, np.int32)]) for x in (ends, owners, times))
        order = np.argsort(ends, kind="stable")
        self.owners, self.times = owners[order], times[order]
        self.firsts = np.searchsorted(ends[order], np.arange(self.terms.size + 1))

    def lay_rarest(self, shares: np.ndarray) -> None:
        """Mark the terms of which a text that can hold an item has one at least: the item's rarest
        words, as many as it may lack and one more."""
        self.telling = np.zeros(self.terms.size, bool)
        for words, need in zip(self.words, self.needed().tolist(), strict=True):
            at = self.find(np.array(words, np.uint64))
            self.telling[at[np.argsort(shares[at], kind="stable")][:len(words) - int(need) + 1]] = True

    def needed(self) -> np.ndarray:
        """Per item how many of its words a text must have to hold it."""
        sizes = np.array([len(words) for words in self.words])
        return np.ceil(SEQUENCE * sizes - 1e-9)

    def words_held(self, terms: np.ndarray) -> np.ndarray:
        """Per item how many of its words are among ``terms``, which do not repeat."""
        lo, hi = self.firsts[terms], self.firsts[terms + 1]
        at = np.repeat(hi - np.cumsum(hi - lo), hi - lo) + np.arange(int((hi - lo).sum()))
        return np.bincount(self.owners[at], weights=self.times[at], minlength=len(self.words))

    def _lay_slots(self) -> None:
        self.slots = np.full(1 << 22, -1, np.int32)
        self.slots[(self.terms * self.factor) >> np.uint64(42)] = np.arange(self.terms.size)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "slots"}  # 16 MB that terms give back

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._lay_slots()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash among the terms, -1 if it is none."""
        if not self.terms.size:
            return np.full(hashes.size, -1, np.int64)
        if self.crowded:
            at = np.minimum(np.searchsorted(self.terms, hashes), self.terms.size - 1)
        else:
            at = self.slots[(hashes * self.factor) >> np.uint64(42)]
        return np.where((at >= 0) & (self.terms[at] == hashes), at, -1)


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each word, text of each block, and whether the next block is of the same text."""
    per_text = -(-counts // BLOCK)
    first = np.cumsum(per_text) - per_text
    begin = np.cumsum(counts) - counts
    place = np.arange(int(counts.sum())) - np.repeat(begin, counts)
    of_word = np.repeat(first, counts) + place // BLOCK
    text = np.repeat(np.arange(counts.size), per_text)
    joined = np.append(text[1:] == text[:-1], False) if text.size else np.empty(0, bool)
    return of_word, text, joined


def _weighted(at: np.ndarray, of_word: np.ndarray, blocks: int, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows[at]`` per block of words; words that are no terms (-1) weigh nothing."""
    made = np.zeros((blocks, rows.shape[1]), np.float32)
    held = np.flatnonzero((at >= 0) & rows.any(axis=1)[at])
    block, term = of_word[held], at[held]
    place = np.arange(held.size) - np.searchsorted(block, block)  # 0 for the first term of a block
    for k in range(int(place.max(initial=-1)) + 1):
        mine = np.flatnonzero(place == k)
        made[block[mine]] += rows[term[mine]]
    return made


def _passages(blocks: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Each block with the next of its text."""
    made = blocks.copy()
    made[:-1] += blocks[1:] * joined[:-1, None]
    return made


def _document_shares(docs: DataFrame, text: str, terms: np.ndarray) -> np.ndarray:
    """Share of all passages that hold each term."""
    def run(batches: Batches) -> Batches:
        finder = Index(terms, np.ones(terms.size), np.zeros((terms.size, 1), np.float32), [], [], [])
        total, passages = np.zeros(terms.size, np.int64), 0
        for batch in sliced(batches, text):
            hashes, counts = word_hashes(texts_of(batch, text))
            of_word, owner, joined = _blocks(counts)
            at = finder.find(hashes)
            held = at >= 0
            block, term = of_word[held], at[held]
            both = np.concatenate([block, block[m := (block > 0) & joined[block - 1]] - 1])
            pairs, _ = _counted([both * np.int64(terms.size) + np.concatenate([term, term[m]])])
            total += np.bincount(pairs % terms.size, minlength=terms.size)
            passages += owner.size
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, terms.size)), pa.array(np.append([passages], total))], ["term", "n"])

    rows = in_batches(docs.select(text), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rows = rows.toArrow().sort_by("term")  # a row per term of the items
    n = rows["n"].to_numpy()
    return n[1:] / (int(n[0]) + PRIOR) if n.size else np.zeros(terms.size)


def _counted(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and how often each came."""
    every = np.sort(np.concatenate([*codes, np.empty(0, np.int64)]))
    cuts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][:every.size])
    return every[cuts], np.diff(np.append(cuts, every.size))


def _pairs(at: np.ndarray, of_word: np.ndarray, joined: np.ndarray, terms: int) -> list[np.ndarray]:
    """Codes of all pairs of words (terms ``at``) that stand in one passage: 4 * (lower * terms + higher) + e,
    the pair adding 2**e to the entry of A'A, A being the counts of the terms in the passages."""
    made = []
    shared = np.append(False, joined[:-1])[of_word]  # the block also ends the passage ahead of it
    for gap in range(2 * BLOCK):
        left, right = slice(0, at.size - gap), slice(gap, at.size)
        apart = of_word[right] - of_word[left]
        near = np.flatnonzero((apart == 0) | (apart == 1) & joined[of_word[left]])
        if not near.size:
            break
        one, other = at[near], at[near + gap]
        same = (one == other) & (gap > 0)  # two words of one term meet in either order
        twice = (apart[near] == 0) & shared[near]
        made.append(4 * (np.minimum(one, other) * np.int64(terms) + np.maximum(one, other)) + same + twice)
    return made


def _added(entries: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries in order and the sum of the counts of each."""
    order = np.argsort(entries, kind="stable")
    entries = entries[order]
    cuts = np.flatnonzero(np.r_[True, entries[1:] != entries[:-1]][:entries.size])
    return entries[cuts], np.add.reduceat(counts[order], cuts) if cuts.size else counts


_ENTRIES = "block long, entries binary, counts binary"


def _together(docs: DataFrame, text: str, index: Index) -> DataFrame:
    """A'A of the term counts of all passages: entries lower * terms + higher and their counts, in blocks of
    ``ENTRIES`` entries.  A task adds up its own, then a block's are added up as they come."""
    size, weighty = index.terms.size, index.weights > 0
    none = np.empty(0, np.int64), np.empty(0, np.int64)

    def count(batches: Batches) -> Batches:
        held, waiting, kept = [], 0, none
        for batch in sliced(batches, text):
            hashes, counts = word_hashes(texts_of(batch, text))
            of_word, _, joined = _blocks(counts)
            at = index.find(hashes)
            some = np.flatnonzero((at >= 0) & weighty[at])
            for codes in _pairs(at[some], of_word[some], joined, size):
                held.append(codes)
                waiting += codes.size
            if waiting >= PAIRS_AT_ONCE:
                kept, held, waiting = gathered(kept, held), [], 0
                if kept[0].size >= PAIRS_AT_ONCE:
                    yield from blocks(*kept)
                    kept = none
        yield from blocks(*gathered(kept, held))

    def gathered(kept, held):
        codes, counts = _counted(held)
        return _added(np.concatenate([kept[0], codes >> 2]), np.concatenate([kept[1], counts << (codes & 3)]))

    def blocks(entries: np.ndarray, counts: np.ndarray) -> Batches:
        cuts = np.flatnonzero(np.diff(entries // ENTRIES)) + 1
        for some, n in zip(np.split(entries, cuts), np.split(counts, cuts), strict=True):
            if some.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(some[0]) // ENTRIES]), *(pa.array([x.tobytes()], pa.binary()) for x in (some, n))],
                    ["block", "entries", "counts"])

    def add(batches: Batches) -> Batches:
        last, kept = None, none
        for batch in batches:
            for block, *made in zip(*(column(batch, c).to_pylist() for c in ("block", "entries", "counts")), strict=True):
                if block != last:
                    yield from blocks(*kept)
                    last, kept = block, none
                kept = _added(*(np.concatenate([k, np.frombuffer(m, np.int64)]) for k, m in zip(kept, made, strict=True)))
        yield from blocks(*kept)

    parts = in_batches(docs.select(text), count, _ENTRIES).repartition("block").sortWithinPartitions("block")
    return in_batches(parts, add, _ENTRIES)


def _product(together: DataFrame, index: Index, right: np.ndarray) -> np.ndarray:
    """A'A times ``right``, A being the weighted passages: summed over all blocks of ``_together``."""
    rows = (index.weights[:, None] * right).astype(np.float32)
    size, width = right.shape

    def run(batches: Batches) -> Batches:
        total = np.zeros(rows.shape)
        for batch in batches:
            for made in zip(*(column(batch, c).to_pylist() for c in ("entries", "counts")), strict=True):
                entries, n = (np.frombuffer(m, np.int64) for m in made)
                low, high = np.divmod(entries, size)
                n = n.astype(np.float32)
                _scattered(total, low, high, n, rows)
                other = np.flatnonzero(low != high)
                other = other[np.argsort(high[other], kind="stable")]
                _scattered(total, high[other], low[other], n[other], rows)
        total *= index.weights[:, None]
        for lo in range(0, size, 512):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lo]), pa.array([total[lo:lo + 512].tobytes()], pa.binary())], ["lo", "part"])

    def add(group):
        whole = np.sum([np.frombuffer(p, np.float64) for p in group["part"]], axis=0)
        return type(group)({"lo": [group["lo"].iloc[0]], "part": [whole.tobytes()]})

    parts = in_batches(together, run, "lo long, part binary").groupBy("lo").applyInPandas(
        add, "lo long, part binary").collect()
    made = np.zeros(right.shape)
    for row in parts:
        block = np.frombuffer(row["part"], np.float64).reshape(-1, width)
        made[row["lo"]:row["lo"] + len(block)] = block
    return made


def _scattered(total: np.ndarray, into: np.ndarray, of: np.ndarray, n: np.ndarray, rows: np.ndarray) -> None:
    """Add ``n * rows[of]`` to the rows ``into`` of ``total``, which ascend."""
    for lo in range(0, into.size, 1 << 13):
        part = slice(lo, lo + (1 << 13))
        mine = into[part]
        cuts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        total[mine[cuts]] += np.add.reduceat(rows[of[part]] * n[part, None], cuts, axis=0)


def fit(docs: DataFrame, items: list[tuple], text: str = "text") -> Index:
    """The index of one set of items (id, text, answer or None).

    Terms are the words of the items; how many passages hold them is counted over all documents.
    The latent space comes from a randomised SVD of the TF-IDF rows of all passages of all documents and
    of the items: one pass counts which terms stand together, which is A'A, a random sketch goes twice
    through it, each time one distributed sum, and the small matrix left is solved on the driver.
    """
    hashes, counts = word_hashes([t or "" for _, t, _ in items])
    words = [w.tolist() for w in np.split(hashes, np.cumsum(counts)[:-1])]
    asked = [{*word_hashes([a])[0].tolist()} if a else None for _, _, a in items]
    fits = [i for i, w in enumerate(words) if w]
    given = [asked[i] is not None for i in fits]
    words, asked = [words[i] for i in fits], [asked[i] for i in fits]
    ids = [items[i][0] for i in fits]
    terms = np.unique(np.array([w for ws in words for w in ws], np.uint64))
    if not terms.size:
        return Index(terms, np.zeros(0), np.zeros((0, 1), np.float32), [], [], [])
    shares = _document_shares(docs, text, terms)
    weights = np.where(shares > COMMON, 0.0, np.log(1 / np.maximum(shares, 1e-7)))
    place = {t: i for i, t in enumerate(terms.tolist())}
    for i, own in enumerate(words):
        if asked[i] is None:  # the rarest words stand for the answer
            rare = sorted({*own}, key=lambda w: (shares[place[w]], w))
            asked[i] = {*rare[:max(1, round(len(rare) * RAREST))]}
    rank = min(RANK, terms.size)
    bare = Index(terms, weights, np.zeros((terms.size, 1), np.float32), [], [], [])
    together = materialize(_together(docs, text, bare), "together")
    own = np.zeros((len(words), terms.size))
    for i, ws in enumerate(words):
        for w in ws:
            own[i, place[w]] += weights[place[w]]
    sketch = np.random.default_rng(0).standard_normal((terms.size, min(rank + EXTRA, terms.size)))
    for last in (False, True):
        sketch = np.linalg.qr(sketch)[0]
        moved = _product(together, bare, sketch) + own.T @ (own @ sketch)
        if last:
            values, vectors = np.linalg.eigh((sketch.T @ moved + moved.T @ sketch) / 2)
            values, vectors = values[::-1][:rank], vectors[:, ::-1][:, :rank]
            # folding in divides by the singular values: directions that all passages of a language
            # share weigh no more than the rare ones; directions below the mean are not blown up
            sketch = sketch @ vectors / np.sqrt(np.maximum(values, 0) + values.mean() + 1e-300)
        else:
            sketch = moved
    discard(together)
    made = Index(terms, weights, sketch.astype(np.float32), ids, words, asked, given)
    made.lay_rarest(shares)
    return made


def _able(index: Index, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which texts have enough words of some item to hold it; all others end here.

    Texts without one of the items' rarest words are out by one look at the whole batch.
    """
    text = np.repeat(np.arange(counts.size), counts)
    held = at >= 0
    some = np.unique(text[held][index.telling[at[held]]])
    able, needed = np.zeros(counts.size, bool), index.needed()
    ends = np.cumsum(counts)
    for t in some.tolist():
        terms = np.unique(at[ends[t] - counts[t]:ends[t]])
        able[t] = (index.words_held(terms[terms >= 0]) >= needed).any()
    return able


def _matches(index: Index, texts: list[str]) -> list[dict]:
    """Per text the items found in it: their share of words in common order, and whether the cosines
    led there."""
    found: list[dict] = [{} for _ in texts]
    if not index.words:
        return found
    hashes, counts = word_hashes(texts)
    able = _able(index, index.find(hashes), counts)
    if able.any():
        hashes, counts = hashes[np.repeat(able, counts)], counts[able]
        for t, made in zip(np.flatnonzero(able).tolist(), _searched_words(index, hashes, counts), strict=True):
            found[t] = made
    return found


def _searched_words(index: Index, hashes: np.ndarray, counts: np.ndarray) -> list[dict]:
    """``_matches`` of texts that can hold items, from the hashes of their words."""
    found: list[dict] = [{} for _ in counts]
    of_word, owner, joined = _blocks(counts)
    begin = np.cumsum(counts) - counts
    per_text = -(-counts // BLOCK)
    first = np.cumsum(per_text) - per_text
    rows = (index.weights[:, None] * index.latent).astype(np.float32)
    at = index.find(hashes)
    terms = at
    passages = _passages(_weighted(at, of_word, owner.size, rows), joined)
    norms = np.linalg.norm(passages, axis=1)
    some = np.flatnonzero(norms > 1e-9)
    longest = max(map(len, index.words))
    needed = [-(-len(a) * ANSWER // 1) for a in index.answers]
    last, around = -1, frozenset()
    for lo in range(0, some.size, 8192):
        at = some[lo:lo + 8192]
        near = (passages[at] / norms[at, None]) @ index.items.T
        passage, item = np.nonzero(near >= CANDIDATE)
        for p, i in zip(at[passage].tolist(), item.tolist(), strict=True):
            text, words = int(owner[p]), index.words[i]
            if found[text].get(i, 0) == 1:
                continue
            start = (p - int(first[text])) * BLOCK
            a = int(begin[text])
            if p != last:  # one look at the words around serves all items of a passage
                last, around = p, frozenset(hashes[a + max(0, start - longest):a + min(
                    int(counts[text]), start + 2 * BLOCK + longest)].tolist())
            if len(around & index.answers[i]) < needed[i]:
                continue
            # as much around the passage as the item may stick out of it
            region = hashes[a + max(0, start - len(words)):a + min(int(counts[text]), start + 2 * BLOCK + len(words))]
            share = _verified(words, index.answers[i], region.tolist())
            if share:
                found[text][i] = max(share, found[text].get(i, 0))
    by_cosine = [set(own) for own in found]
    _looked_up(index, hashes, terms, begin, counts, found)
    return [{i: (share, i in led) for i, share in own.items()} for own, led in zip(found, by_cosine, strict=True)]


def _looked_up(index: Index, hashes: np.ndarray, at: np.ndarray, begin: np.ndarray, counts: np.ndarray,
               found: list[dict]) -> None:
    """Add to ``found`` what the cosines miss: an item is checked in every passage that can hold it.

    A text can hold an item if it has ``SEQUENCE`` of its words, a passage if so many stand around it.
    Items of few words also count where they stand word by word, with ``ANSWER`` of their answer, if
    they have one, near.
    """
    sizes, needed = np.array([len(words) for words in index.words]), index.needed()
    for text, (a, n) in enumerate(zip(begin.tolist(), counts.tolist(), strict=True)):
        terms = np.unique(at[a:a + n])
        enough = index.words_held(terms[terms >= 0]) >= needed
        own = hashes[a:a + n]
        for i in np.flatnonzero(enough).tolist():
            best = found[text].get(i, 0)
            if best == 1:
                continue
            words, answer, size = index.words[i], index.answers[i], int(sizes[i])
            if size < LEAST_WORDS:
                starts = np.flatnonzero(own[:max(0, n - size + 1)] == np.uint64(words[0]))
                for p in range(1, size):
                    starts = starts[own[starts + p] == np.uint64(words[p])]
                near = 2 * BLOCK
                if any(not index.own_answer[i] or len(answer.intersection(own[max(0, p - near):p + size + near].tolist()))
                       >= ANSWER * len(answer) for p in starts.tolist()):
                    found[text][i] = 1.0
                    continue
            inside = np.concatenate([[0], np.cumsum(np.isin(own, np.array(words, np.uint64)))])
            starts = np.arange(0, n, BLOCK)
            lows, highs = np.maximum(starts - size, 0), np.minimum(starts + 2 * BLOCK + size, n)
            for p in np.flatnonzero(inside[highs] - inside[lows] >= needed[i]).tolist():
                best = max(best, _verified(words, answer, own[lows[p]:highs[p]].tolist()))
                if best == 1:
                    break
            if best:
                found[text][i] = best


def _verified(item: list[int], answer: set[int], region: list[int]) -> float:
    """Share of the item's words that the region holds in order; 0 if too few or the answer lacks.

    The region is searched in stretches half as long again as the item, so that common words strewn
    over a long text do not add up.
    """
    here = {*region}
    if len(answer & here) < ANSWER * len(answer):
        return 0
    if sum(w in here for w in item) < SEQUENCE * len(item):
        return 0
    length, best = len(item) * 3 // 2, 0
    for lo in range(0, max(1, len(region) - length + len(item) // 4 + 1), max(1, len(item) // 4)):
        best = max(best, common_subsequence(item, region[lo:lo + length]))
    return best / len(item) if best >= SEQUENCE * len(item) else 0


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """``docs`` with ``leaks`` array<struct<item long, share double, cosine boolean>>: the items each text
    holds; ``cosine`` tells whether the latent cosines led to it.

    The benchmark is the stated query set; it is taken in blocks of ``ITEMS_AT_ONCE`` items against
    all documents.  Texts that have too few words of every item go no further.  In the others a passage
    whose latent cosine with an item reaches ``CANDIDATE`` is a candidate;
    it counts if ``SEQUENCE`` of the item's words stand in order near it and ``ANSWER`` of the
    answer's words do (without an answer column: of the item's rarest words).  What the
    cosines miss, as they know little of words that many texts hold, is found by counts of common
    words: the same check then runs on every passage that can pass it.  Items of any length are searched
    this way; what stands word by word of an item of under ``LEAST_WORDS`` words counts wherever its answer is
    near.  Items without words are never found; null texts hold nothing; rows with a null item id are left out.
    """
    columns = [F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("t"),
               (F.col(answer) if answer else F.lit(None)).cast("string").alias("a")]
    items = benchmark.select(*columns).where("id IS NOT NULL AND t IS NOT NULL").distinct()
    # number the items, so that a block can be read by itself
    items = materialize(numbered(items, [F.col(c) for c in ("id", "t", "a")], "at", "placed"), "items")
    last = items.agg(F.max("at")).first()[0]
    made = docs.withColumn("leaks", F.array().cast("array<struct<item:long,share:double,cosine:boolean>>"))
    for lo in range(0, 0 if last is None else last + 1, ITEMS_AT_ONCE):
        block = items.where(F.col("at").between(lo, lo + ITEMS_AT_ONCE - 1)).orderBy("at").collect()
        index = fit(docs, [(r["id"], r["t"], r["a"]) for r in block], text)
        if index.words:
            made = _searched(made, index, text)
    return made


def _searched(docs: DataFrame, index: Index, text: str) -> DataFrame:
    kind = pa.list_(pa.struct([("item", pa.int64()), ("share", pa.float64()), ("cosine", pa.bool_())]))

    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, text):
            before = batch.column(batch.schema.get_field_index("leaks")).to_pylist()
            rows = []
            for old, new in zip(before, _matches(index, texts_of(batch, text)), strict=True):
                best: dict = {entry["item"]: (entry["share"], entry["cosine"]) for entry in old}
                for i, found in new.items():
                    best[index.item_ids[i]] = max(found, best.get(index.item_ids[i], (0, False)))
                rows.append([{"item": i, "share": best[i][0], "cosine": best[i][1]} for i in sorted(best)])
            yield add_columns(batch, {"leaks": pa.array(rows, kind)})

    return in_batches(docs, run, widened(docs, "leaks array<struct<item:long,share:double,cosine:boolean>>"))
