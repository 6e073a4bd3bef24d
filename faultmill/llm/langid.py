"""Language by cross-parsing: how few phrases of a language's sample a text needs."""

import pickle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, add_columns, column, in_batches, sliced, texts_of, widened
from .words import KEPT_WORDS

#: Sample a language's automaton is built of: drawn from about so many documents of at most so many
#: characters, whole ones until there are so many characters in all.  Scoring always reads whole texts.
SAMPLE_DOCS = 400
SAMPLE_LENGTH = 10_000
SAMPLE_CHARS = 120_000
#: Longer words are parsed in parts.
PART = 64

UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")


class Automaton:
    """Suffix automaton of a text, its transitions as sorted keys (state, letter)."""

    def __init__(self, text: str):
        moves: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for letter in text:
            new = len(moves)
            moves.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and letter not in moves[at]:
                moves[at][letter] = new
                at = link[at]
            if at >= 0:
                target = moves[at][letter]
                if length[at] + 1 == length[target]:
                    link[new] = target
                else:
                    copy = len(moves)
                    moves.append(dict(moves[target]))
                    link.append(link[target])
                    length.append(length[at] + 1)
                    while at >= 0 and moves[at].get(letter) == target:
                        moves[at][letter] = copy
                        at = link[at]
                    link[target] = link[new] = copy
            last = new
        keys = np.array([(s << 21) | ord(c) for s, move in enumerate(moves) for c in move], np.int64)
        goals = np.array([t for move in moves for t in move.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.goals = np.append(keys[order], np.iinfo(np.int64).max), np.append(goals[order], -1)
        self.chars = max(2, len(text))

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        wanted = (states.astype(np.int64) << 21) | letters
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.goals[at], -1)

    def phrases(self, laid: np.ndarray) -> np.ndarray:
        """For each row of code points (0 behind the end): phrases of a greedy longest-match parse.

        All rows go forward together, a column at a time.  A letter the sample lacks is a phrase.
        """
        state, count = np.zeros(len(laid), np.int32), np.zeros(len(laid), np.int32)
        live = np.arange(len(laid))
        for k in range(laid.shape[1]):
            letters = laid[live, k]
            live, letters = live[letters > 0], letters[letters > 0]
            if not live.size:
                break
            goal = self.step(state[live], letters)
            stuck = np.flatnonzero((goal < 0) & (state[live] > 0))
            count[live[stuck]] += 1
            goal[stuck] = self.step(np.zeros(stuck.size, np.int32), letters[stuck])
            alone = goal < 0
            count[live[alone]] += 1
            state[live] = np.where(alone, 0, goal)
        return count + (state > 0)


class Models:
    """Automata by language, and the costs of the words met before."""

    def __init__(self, fitted: dict[str, Automaton]):
        self.names = sorted(fitted)
        self.automata = [fitted[name] for name in self.names]
        self.units = np.array([np.log2(a.chars) for a in self.automata])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.costs = np.empty((0, len(self.names) + 1), np.int32)  # phrases by language, letters

    def _learn(self, words: list[str]) -> None:
        parts, owner = [], []
        letters = np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            for run in LETTERS.findall(word.lower()):
                letters[i] += len(run)
                padded = f" {run} "
                for lo in range(0, len(padded), PART):
                    parts.append(padded[lo:lo + PART])
                    owner.append(i)
        made = np.zeros((len(words), len(self.names) + 1), np.int64)
        made[:, -1] = letters
        owner = np.array(owner, np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        for lo, hi in ((0, 12), (12, 24), (24, PART + 2)):  # of like length: little padding
            mine = np.flatnonzero((sizes > lo) & (sizes <= hi))
            if not mine.size:
                continue
            flat = np.frombuffer("".join(parts[i] for i in mine).encode("utf-32-le", "surrogatepass"), np.uint32)
            laid = np.zeros((mine.size, int(sizes[mine].max())), np.int64)
            laid[np.arange(laid.shape[1]) < sizes[mine][:, None]] = flat
            for k, automaton in enumerate(self.automata):
                np.add.at(made[:, k], owner[mine], automaton.phrases(laid))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.costs = np.concatenate([self.costs, made.astype(np.int32)])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        cut = [text.split() for text in texts]
        words = [word for text in cut for word in text]
        new = list(set(words).difference(self.known))
        if new:
            self._learn(new)
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        ends = np.cumsum(sizes)
        sums = np.empty((len(texts), len(self.names) + 1), np.int64)
        for k in range(sums.shape[1]):
            upto = np.concatenate([[0], np.cumsum(self.costs[found, k], dtype=np.int64)])
            sums[:, k] = upto[ends] - upto[ends - sizes]
        letters = sums[:, -1]
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = sums[:, :-1] * self.units / np.maximum(letters, 1)[:, None]
        best = np.argmin(bits, axis=1)
        if len(self.names) > 1:
            two = np.partition(bits, 1, axis=1)
            scores = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12)
        else:
            scores = np.ones(len(texts))
        blank = letters == 0
        scores[blank] = 0
        return [UNKNOWN if b else self.names[k] for k, b in zip(best.tolist(), blank.tolist(), strict=True)], \
            np.clip(scores, 0, 1)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Models:
    """Build an automaton per language from a bounded sample, drawn by hash of the key.

    First the rows per language are counted; then about ``2 * SAMPLE_DOCS`` rows of each, of at most
    ``SAMPLE_LENGTH`` characters, are drawn where they lie, and only these move.  A language that has
    longer texts only is learned from a few of them.  Texts are taken whole.  Rows without a text or a
    language, or whose language is ``und``, are left out; without rows no language is known.
    """
    rows = labelled.where(F.col(lang).isNotNull() & (F.col(lang) != UNKNOWN) & F.col(text).isNotNull())
    short = F.length(text) <= SAMPLE_LENGTH
    counts = rows.groupBy(lang).agg(F.count("*").alias("all"), F.count_if(short).alias("short")).collect()  # a row per language
    if not counts:
        return Models({})
    chance = F.create_map(*[x for row in counts for x in (
        F.lit(row[lang]), F.lit(min(1.0, 2 * SAMPLE_DOCS / row["short"] if row["short"] else 4 / row["all"])))])
    only_long = F.col(lang).isin([row[lang] for row in counts if not row["short"]])
    draw = F.xxhash64(F.col(key).cast("string"), F.lit(11))
    drawn = rows.where((short | only_long) & (F.pmod(draw, F.lit(1 << 30)) < chance[F.col(lang)] * (1 << 30))).select(
        F.col(lang).alias("lang"), draw.alias("draw"), F.col(text).alias("text"))

    def build(group):
        group = group.sort_values(["draw", "text"], kind="stable")
        laid, total = [], 0
        for whole in group["text"]:
            words = " ".join(LETTERS.findall(whole.lower()))
            laid.append(words)
            total += len(words) + 1
            if total >= SAMPLE_CHARS:
                break
        made = Automaton(" " + " ".join(laid) + " ")
        made.chars = min(made.chars, SAMPLE_CHARS)  # a phrase costs the same in all full samples
        return type(group)({"lang": [group["lang"].iloc[0]], "model": [pickle.dumps(made)]})

    built = drawn.groupBy("lang").applyInPandas(build, "lang string, model binary").collect()
    return Models({row["lang"]: pickle.loads(row["model"]) for row in built})  # a few MB per language


def predict(docs: DataFrame, models: Models, text: str = "text", lang: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """Add ``lang`` and ``score`` (0 to 1: how much fewer bits than the next language) per whole text.

    Words are parsed one by one, a space on either side, so that a word met again costs a look-up;
    phrases do not reach over white space.  Bits are phrases times the logarithm of the sample's
    length, per letter.  Null texts and texts without a letter are ``und`` with score 0; equal
    costs go to the language first in the alphabet.
    """
    def run(batches: Batches) -> Batches:
        for batch in sliced(batches, text, 2 << 20):
            names, scores = models.predict(texts_of(batch, text))
            yield add_columns(batch, {lang: pa.array(names, pa.string()), score: pa.array(scores, pa.float64())})

    return in_batches(docs, run, widened(docs, f"`{lang}` string, `{score}` double"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents a language may be learned from: those with an id whose crc32 mod 4 is not 2."""
    return docs.where(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
