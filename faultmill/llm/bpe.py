"""Byte-level BPE by a pair occurrence index, and its inverse."""

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Batches, add_columns, column, in_batches, lists_of, texts_of, widened
from .words import WordStore, gather, shared, summed

# The pre-tokenizer pattern of the byte-level vocabulary files.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabulary files.

    Printable Latin-1 bytes stand for themselves, the others take the code points from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def token_bytes(content: str) -> list[bytes]:
    """What each id of a vocabulary file stands for."""
    model = json.loads(content)
    to_byte = {letter: b for b, letter in enumerate(byte_letters())}
    ids = model["model"]["vocab"]
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    found = [b""] * (1 + max([*ids.values(), *special.values()]))
    for token, i in ids.items():
        found[i] = bytes(map(to_byte.__getitem__, token))
    for token, i in special.items():
        found[i] = token.encode()
    return found


class Vocabulary:
    """A byte-level BPE vocabulary file: merges by rank, special tokens."""

    def __init__(self, content: str):
        model = json.loads(content)
        ids = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.byte_ids = np.array([ids[letter] for letter in byte_letters()], np.int64)
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self._index(self.left * self.size + self.right)
        self.cut = (regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
                    if self.special else None)
        self.pieces = regex.compile(PIECES)

    def _index(self, keys: np.ndarray) -> None:
        """A chained hash table from pair to rank: first rank per slot, next rank per rank."""
        self.bits = 64 - int(np.ceil(np.log2(4 * keys.size + 2)))
        slots = self._slot(keys)
        self.pair_keys = np.append(keys, -1)
        self.first = np.full(1 << (64 - self.bits), keys.size, np.int32)
        self.next = np.full(keys.size + 1, keys.size, np.int32)
        self.longest = 1
        left = np.arange(keys.size, dtype=np.int32)
        while left.size:  # enter one rank per slot and turn
            self.next[left] = self.first[slots[left]]
            self.first[slots[left]] = left
            entered = self.first[slots[left]] == left
            self.longest += 1
            left = left[~entered]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.bits)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, -1 where none."""
        wanted = left * np.int64(self.size) + right
        found = self.first[self._slot(wanted)]
        none = self.pair_keys.size - 1
        for _ in range(self.longest):
            off = np.flatnonzero((self.pair_keys[found] != wanted) & (found != none))
            if not off.size:
                break
            found[off] = self.next[found[off]]
        return np.where(found == none, -1, found)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces at once: all ids, and where each piece's begin (one more at the end).

        All pieces lie in one array with gaps between them.  The index maps each mergeable pair to
        all its positions; a heap holds the ranks that occur.  The lowest rank is merged at all its
        positions, and only the lists of the pairs beside them change.
        """
        coded = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(sizes + 1)  # a gap after each piece
        starts = ends - sizes - 1
        ids = np.full(int(ends[-1]) + 1 if len(coded) else 1, -1, np.int32)
        raw = np.frombuffer(b"\0".join(coded) + b"\0", np.uint8)
        ids[:raw.size] = self.byte_ids[raw]
        ids[ends - 1] = -1
        after = np.arange(1, ids.size + 1, dtype=np.int32)
        before = np.arange(-1, ids.size - 1, dtype=np.int32)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(positions: np.ndarray) -> None:
            """Enter the pairs that start at the positions."""
            follow = after[positions]
            left, right = ids[positions], ids[follow]
            held = (left >= 0) & (right >= 0)
            positions = positions[held]
            ranks = self.ranks(left[held], right[held])
            held = ranks >= 0
            positions, ranks = positions[held], ranks[held]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, group in zip(ranks[np.r_[0, cuts]].tolist() if ranks.size else [],
                                   np.split(positions, cuts), strict=False):
                if rank in lists:
                    lists[rank].append(group)
                else:
                    lists[rank] = [group]
                    heapq.heappush(heap, rank)

        note(np.arange(ids.size - 1, dtype=np.int32))
        while heap:
            rank = heapq.heappop(heap)
            groups = lists.pop(rank)
            at = np.sort(np.concatenate(groups) if len(groups) > 1 else groups[0])
            at = at[np.r_[True, at[1:] != at[:-1]]]
            left, right = self.left[rank], self.right[rank]
            follow = after[at]
            held = (ids[at] == left) & (ids[np.minimum(follow, ids.size - 1)] == right)
            at, follow = at[held], follow[held]
            if left == right and at.size > 1:  # of overlapping pairs the leftmost goes first
                taken, used = [], -1
                for i, (p, q) in enumerate(zip(at.tolist(), follow.tolist(), strict=True)):
                    if p != used:
                        taken.append(i)
                        used = q
                at, follow = at[taken], follow[taken]
            if not at.size:
                continue
            ids[at] = self.made[rank]
            ids[follow] = -2
            beyond = after[follow]
            after[at] = beyond
            before[beyond] = at
            ahead = before[at]
            note(np.concatenate([ahead[ahead >= 0], at]))
        alive = ids >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])
        return ids[alive], upto[np.append(starts, ends[-1] if len(coded) else 0)]


class Encoder(WordStore):
    """Encodes whole texts, remembering the words met before.

    A word is what stands between two spaces, with the space before it; it may hold several pieces.
    """

    def __init__(self, content: str):
        super().__init__()
        self.vocabulary = v = Vocabulary(content)
        # pieces of words laid out with a NUL between them: the NUL stands alone and ends a run of spaces
        self.joined = regex.compile("\0|" + PIECES.replace("\\p{N}]+", "\\p{N}\0]+").replace(
            r"(?!\S)", "(?![^\\s\0])"))
        self.awkward = [*v.special, "  ", "\0"]

    def _pieces(self, text: str) -> list[str]:
        v = self.vocabulary
        if v.cut is None or not v.cut.search(text):
            return v.pieces.findall(text)
        found, at = [], 0
        for token in v.cut.finditer(text):
            found += v.pieces.findall(text[at:token.start()])
            found.append(token.group())
            at = token.end()
        return found + v.pieces.findall(text[at:])

    def words(self, text: str) -> list[str]:
        """Cut before every space, if each of them starts a piece; else into single pieces."""
        if text[-1:] == " " or any(map(text.__contains__, self.awkward)):
            return self._pieces(text)
        return text.replace(" ", "\0 ").split("\0")

    def learn(self, words: list[str]) -> None:
        special = self.vocabulary.special
        plain = [w for w in words if w not in special and "\0" not in w]
        single = [w for w in words if w not in special and "\0" in w]
        signs = [w for w in words if w in special]
        pieces = self.joined.findall("\0".join(plain)) if plain else []
        at = np.array([i for i, piece in enumerate(pieces) if piece == "\0"], np.int64)
        counts = np.diff(np.concatenate([[-1], at, [len(pieces)]])) - 1 if plain else np.empty(0, np.int64)
        pieces = [piece for piece in pieces if piece != "\0"] + single
        places = {piece: i for i, piece in enumerate(dict.fromkeys(pieces))}
        ids, bounds = self.vocabulary.encode_pieces(list(places))
        ids, sizes = gather(ids, bounds, np.fromiter(map(places.__getitem__, pieces), np.int64, len(pieces)))
        sizes = summed(sizes, np.append(counts, np.ones(len(single), np.int64)))
        self.keep([*plain, *single, *signs], np.append(ids, np.array([special[w] for w in signs], np.int32)),
                  np.append(sizes, np.ones(len(signs), np.int64)))


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array<int>): the token ids of the whole text; special tokens in it are kept.

    Within a task each distinct piece is encoded once, together with all other new pieces of its
    batch.  A null or empty text gives an empty array.  A column named ``ids`` is replaced, all
    others stay.  Rows are independent: repeats give equal ids.  ``path`` is a vocabulary file of
    a few MB that the driver reads; it travels with the task.
    """
    content = read_vocabulary(path)

    def run(batches: Batches) -> Batches:
        encoder = shared(Encoder, content)
        for batch in batches:
            yield add_columns(batch, {ids: lists_of(*encoder.encode(texts_of(batch, text)))})

    return in_batches(df, run, widened(df, f"`{ids}` array<int>"), keep=True)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the text of the token ids, special tokens included; ``ids`` is dropped.

    Bytes that are no UTF-8 become U+FFFD.  A null list gives an empty text; ids outside the
    vocabulary give nothing.
    """
    content = read_vocabulary(path)

    def run(batches: Batches) -> Batches:
        parts = [*shared(token_bytes, content), b""]
        for batch in batches:
            lists = column(batch, ids)
            flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), _cuts(lists)
            flat = np.where((flat >= 0) & (flat < len(parts) - 1), flat, len(parts) - 1).tolist()
            texts = [b"".join(map(parts.__getitem__, flat[i:j])).decode("utf-8", "replace")
                     for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            rest = batch.drop_columns([ids])
            yield add_columns(rest, {text: pa.array(texts, pa.string())})

    return in_batches(df, run, widened(df, f"`{text}` string", (ids,)), keep=True)


def _cuts(lists: pa.Array) -> list[int]:
    """Bounds of each list in the flattened values, nulls empty."""
    sizes = np.array(lists.value_lengths().fill_null(0))
    return [0, *np.cumsum(sizes).tolist()]
