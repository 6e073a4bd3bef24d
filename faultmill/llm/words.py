"""Ids of whole texts put together from those of their distinct words."""

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np

#: Words kept per Python worker; beyond that a store starts anew.
KEPT_WORDS = 200_000

_SHARED: dict[Callable, tuple[int, object]] = {}


def shared(make: Callable, content: str):
    """``make(content)``, kept by the Python worker: tasks that it runs later find it warm."""
    mark = hash(content)
    if _SHARED.get(make, (None,))[0] != mark:
        _SHARED[make] = (mark, make(content))
    return _SHARED[make][1]


def forget_shared() -> None:
    _SHARED.clear()


def gather(values: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated stretches ``wanted`` of ``values``, and how long each is."""
    begin, sizes = bounds[wanted], bounds[wanted + 1] - bounds[wanted]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if ends.size else 0
    return values[np.repeat(begin - ends + sizes, sizes) + np.arange(total)], sizes


def summed(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``counts`` members, empty groups 0."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


class WordStore:
    """Looks up the ids of texts word by word; unknown words of a batch are learned together."""

    kept = KEPT_WORDS

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.bounds = np.empty(0, np.int32), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        """Cut a text where the ids of the parts, one after another, are those of the text."""
        raise NotImplementedError

    def learn(self, words: list[str]) -> None:
        """Find the ids of new words and ``keep`` them."""
        raise NotImplementedError

    def keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(sizes))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        if len(self.known) > self.kept:
            self._forget()
        cut = [self.words(text) for text in texts]
        words = list(chain.from_iterable(cut))
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            unknown = [words[i] for i in missing]
            self.learn(list(set(unknown)))
            found[missing] = [self.known[word] for word in unknown]
        ids, sizes = gather(self.ids, self.bounds, found)
        return ids, summed(sizes, np.fromiter(map(len, cut), np.int64, len(cut)))
