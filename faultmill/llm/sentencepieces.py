"""SentencePiece ids by a table of distinct marked words, and their inverse."""

import codecs
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import _cuts
from .common import Batches, add_columns, column, in_batches, lists_of, sliced, texts_of, widened
from .words import WordStore, shared

# Fixed values of the model format.
MARK = "▁"  #: stands for a space
PIECES, TRAINER, NORMALIZER = 1, 2, 3  #: fields of a model file
BPE_MODEL, MODEL_TYPE, UNKNOWN_SURFACE = 2, 3, 44  #: of its trainer part
CHARSMAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5  #: of its normalizer part
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  #: types of pieces

#: Bytes of marked words that a Python worker's table holds; beyond that it starts anew.
TABLE_BYTES = 48 << 20


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, raw[at:at + size]
            at += size


class Model:
    """What a model file says of its pieces and of the text it expects."""

    def __init__(self, content: bytes):
        parts = list(fields(content))
        pieces = [dict(fields(raw)) for number, raw in parts if number == PIECES]
        self.pieces = [p[1].decode() for p in pieces]
        self.types = [p.get(3, NORMAL) for p in pieces]
        trainer = dict(next((fields(raw) for number, raw in parts if number == TRAINER), ()))
        normal = dict(next((fields(raw) for number, raw in parts if number == NORMALIZER), ()))
        self.unknown = trainer.get(UNKNOWN_SURFACE, " ⁇ ".encode())
        self.prefixed = bool(normal.get(DUMMY_PREFIX, 1))
        self.trims = bool(normal.get(REMOVE_SPACES, 1))
        crossing = any(MARK in p.lstrip(MARK) for p, kind in zip(self.pieces, self.types, strict=True)
                       if kind in (NORMAL, USER_DEFINED))
        #: whether no piece reaches over the border before a run of marks, and texts come as they are
        self.cuttable = (
            trainer.get(MODEL_TYPE, 1) == BPE_MODEL and self.prefixed and not self.trims
            and bool(normal.get(ESCAPE_SPACES, 1)) and not normal.get(CHARSMAP)
            and USER_DEFINED not in self.types and not crossing and MARK in self.pieces)

    def surfaces(self) -> list[bytes]:
        """The bytes each id stands for."""
        return [bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL
                else self.unknown if kind == UNKNOWN else p.replace(MARK, " ").encode()
                for p, kind in zip(self.pieces, self.types, strict=True)]


class ChunkTable(WordStore):
    """Ids of whole texts from those of their distinct marked words.

    A marked word is a run of marks and what follows it up to the next mark.  No piece crosses the
    border before a run, and merges happen inside pieces, so the ids of a text are those of its
    words one after another.  The table holds each word once, without its first mark (the one that
    the library puts before a text by itself); the library segments all words of a batch that the
    table lacks, and ids are joined back by position.  A model whose pieces may cross gets whole
    texts as its words.
    """

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        model = Model(content)
        self.library = SentencePieceProcessor(model_proto=content)
        self.cuttable = model.cuttable
        self.lone = [model.pieces.index(MARK)] if model.cuttable else []
        self.runs = regex.compile(f"{MARK}+[^{MARK}]*")

    def _forget(self) -> None:
        super()._forget()
        self.held = 0

    def words(self, text: str) -> list[str]:
        if not text or not self.cuttable:
            return [text] if text else []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return [run[1:] for run in self.runs.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def learn(self, words: list[str]) -> None:
        found = [ids if word else self.lone for word, ids in
                 zip(words, self.library.encode(words, num_threads=1), strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.keep(words, np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum())), sizes)
        self.held += sum(map(len, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.held > TABLE_BYTES:
            self._forget()
        return super().encode(texts)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array<int>): the ids of the whole text as the library gives them, without
    begin and end ids and without sampling.

    Every task keeps a table of the distinct marked words it met (bounded by ``TABLE_BYTES``), so no
    word leaves the task and a frequent one is no hot key.  A null or empty text gives an empty
    array.  A column named ``ids`` is replaced, all others stay.  Rows are independent: repeats give
    equal ids, an empty table an empty result.  ``path`` is a model file of a few MB that the driver
    reads; it travels with the task.
    """
    content = read_model(path)

    def run(batches: Batches) -> Batches:
        table = shared(ChunkTable, content)
        for batch in sliced(batches, text):
            yield add_columns(batch, {ids: lists_of(*table.encode(texts_of(batch, text)))})

    return in_batches(df, run, widened(df, f"`{ids}` array<int>"), keep=True)


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    """Each byte that is no UTF-8 becomes one U+FFFD."""
    return "�", error.start + 1


class Decoder:
    """Texts of id lists as the library's ``decode`` gives them."""

    def __init__(self, content: bytes):
        model = Model(content)
        self.parts = [*model.surfaces(), b""]
        drop = model.prefixed or model.trims
        silent = {i for i, kind in enumerate(model.types) if kind == CONTROL}
        self.silent = silent | {len(model.pieces)}
        self.marked = {i for i, (p, kind) in enumerate(zip(model.pieces, model.types, strict=True))
                       if drop and kind in (NORMAL, USER_DEFINED) and p.startswith(MARK)}
        self.all_marks = model.trims
        codecs.register_error("one-by-one", _one_by_one)

    def _joined(self, ids: list[int]) -> str:
        return b"".join(map(self.parts.__getitem__, ids)).decode("utf-8", "one-by-one")

    def text(self, ids: list[int]) -> str:
        if self.silent.isdisjoint(ids):
            text, first = self._joined(ids), ids[0] if ids else None
        else:  # bytes on both sides of a silent id make no character together
            runs = [list(run) for quiet, run in groupby(ids, self.silent.__contains__) if not quiet]
            text, first = "".join(map(self._joined, runs)), runs[0][0] if runs else None
        if first not in self.marked:
            return text
        return text.lstrip(" ") if self.all_marks else text[1:]


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the text of the ids as the library decodes them; ``ids`` is dropped.

    The mark that the library put before the text goes, other marks become spaces, begin and end ids
    give nothing, the unknown id gives its surface, and bytes that are no UTF-8 become U+FFFD each.  A
    null list gives an empty text; null ids and ids outside the vocabulary give nothing.
    """
    content = read_model(path)

    def run(batches: Batches) -> Batches:
        decoder = shared(Decoder, content)
        none = len(decoder.parts) - 1
        for batch in batches:
            lists = column(batch, ids)
            flat, cuts = lists.flatten().fill_null(none).to_numpy(zero_copy_only=False), _cuts(lists)
            flat = np.where((flat >= 0) & (flat < none), flat, none).tolist()
            texts = [decoder.text(flat[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield add_columns(batch.drop_columns([ids]), {text: pa.array(texts, pa.string())})

    return in_batches(df, run, widened(df, f"`{text}` string", (ids,)), keep=True)
