"""Token counts per section of a text, by the character spans of the tokens."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Encoder, read_vocabulary, token_bytes
from .common import Batches, add_columns, column, in_batches, widened
from .words import shared

SECTIONS = "array<struct<start:int,stop:int,n_tokens:long,n_shared:long>>"


def line_bounds(text: str) -> np.ndarray:
    """Character bounds of the lines, each with the newline that ends it; an empty text has one."""
    sizes = [len(line) + 1 for line in text.split("\n")]
    sizes[-1] -= 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return np.stack([bounds[:-1], bounds[1:]], axis=1)


def allocate(token_sizes: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of these reach into another section or a gap.

    ``token_sizes`` are byte lengths in text order; sections are byte spans in ascending order that
    do not overlap.  A token inside one section counts there.  A token across a boundary counts
    once: by ``first`` in the section that holds its first byte, by ``most`` in the one that holds
    most of its bytes, the earlier of equals.  Tokens that touch no section count nowhere.
    """
    if rule not in ("first", "most"):
        raise ValueError(f"no rule {rule!r}")
    ends = np.cumsum(token_sizes)
    begins = ends - token_sizes
    home = np.searchsorted(starts, begins, side="right") - 1
    inside = (home >= 0) & (begins < stops[np.maximum(home, 0)]) if starts.size else np.zeros(begins.size, bool)
    cross = np.flatnonzero(~inside | (ends > stops[np.maximum(home, 0)])) if starts.size else np.empty(0, np.int64)
    home = np.where(inside, home, -1)
    for t in cross.tolist() if rule == "most" else ():
        lo = max(int(np.searchsorted(stops, begins[t], side="right")), 0)
        hi = int(np.searchsorted(starts, ends[t]))
        share = np.minimum(stops[lo:hi], ends[t]) - np.maximum(starts[lo:hi], begins[t])
        home[t] = lo + int(np.argmax(share)) if share.size and share.max() > 0 else -1
    counts = np.bincount(home[home >= 0], minlength=starts.size)
    at = home[cross]
    return counts, np.bincount(at[at >= 0], minlength=starts.size)


def attribute(df: DataFrame, path: str, text: str = "text", spans: str | None = None,
              rule: str = "first", made: str = "sections") -> DataFrame:
    """Add ``made``: the sections of each text with their token counts.

    The whole text is encoded once.  ``spans`` names a column array<struct<start int, stop int>> of
    character spans (ascending, disjoint; nulls and empty spans count nothing; ends beyond the text
    are cut); without it the lines are the sections.  ``n_tokens`` follows ``rule`` of ``allocate``;
    ``n_shared`` of them cross a boundary.  A null text is empty: every section has 0 tokens.
    """
    content = read_vocabulary(path)

    def run(batches: Batches) -> Batches:
        encoder = shared(Encoder, content)
        lengths = np.fromiter(map(len, shared(token_bytes, content)), np.int64)
        for batch in batches:
            texts = [t or "" for t in column(batch, text).to_pylist()]
            given = column(batch, spans).to_pylist() if spans else None
            ids, sizes = encoder.encode(texts)
            of_tokens, at = lengths[ids], 0
            bounds, counts, crossing = [], [], []
            for i, (whole, n) in enumerate(zip(texts, sizes.tolist(), strict=True)):
                span = line_bounds(whole) if given is None else np.array(
                    [(s["start"], s["stop"]) for s in given[i] or () if s and None not in s.values()],
                    np.int64).reshape(-1, 2)
                span = np.clip(span, 0, len(whole))
                places = span
                if not whole.isascii():
                    raw = np.frombuffer(whole.encode(), np.uint8)
                    first = np.append(np.flatnonzero((raw & 0xC0) != 0x80), raw.size)
                    places = first[span]
                got, part = allocate(of_tokens[at:at + n], places[:, 0], places[:, 1], rule)
                at += n
                bounds.append(span)
                counts.append(got)
                crossing.append(part)
            span = np.concatenate(bounds) if bounds else np.empty((0, 2), np.int64)
            flat = pa.StructArray.from_arrays([
                pa.array(span[:, 0].astype(np.int32)), pa.array(span[:, 1].astype(np.int32)),
                pa.array(np.concatenate(counts or [np.empty(0, np.int64)])),
                pa.array(np.concatenate(crossing or [np.empty(0, np.int64)])),
            ], ["start", "stop", "n_tokens", "n_shared"])
            cuts = np.concatenate([[0], np.cumsum([len(b) for b in bounds])]).astype(np.int32)
            yield add_columns(batch, {made: pa.ListArray.from_arrays(pa.array(cuts), flat)})

    return in_batches(df, run, widened(df, f"`{made}` {SECTIONS}"), keep=True)
