"""Toxicity by a noisy channel: obfuscated words are restored by Viterbi decoding, then the text is scored.

The channel writes letters as digits or marks, puts marks or blanks between letters, and repeats
letters. Its source is a character trigram model; of single letters in a row, any blank may end a word,
and all words count that are on a way within BEAM of the likeliest. Scores come from a sparse logistic model over the
presence of words and word beginnings in the text and its restored words. The character model counts
the words of all texts, by a grouped aggregation; the logistic one is fitted on a bounded sample of
labelled rows (FIT_TOXIC and FIT_CLEAN rows, the first by a hash of their ids, and FIT_CHARS characters).
Null texts count as empty; ids, languages and sources are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, tune

FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 3000, 5000, 64_000_000
PREFIXES = (4, 5, 6, 7, 8, 9)  # bytes of word beginnings
FEATURES = 6000
HOLD_OUT = 5
BEAM = 12.0  # of a reading of single letters in a row: how much its cost may be above the least
HEAD = 65  # letters of a restored word that are kept; features are words of fewer letters, and beginnings
HELD_BYTES = 24 << 20  # of tokens and their words that a worker remembers

# Letters that digits and marks are written for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "#": "h", "&": "a", "%": "", "*": "", ".": "", "-": "", "_": "", "'": "", "~": "", "^": ""}

#: Lower-cased UTF-8 to words: ASCII that is neither letter nor digit parts them.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Runs of at least two letters, digits or marks that each stand alone.
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$|€](?=\s))(?:[\s.\-_*]+(?:[^\W_](?!\w)|[@$!|€](?!\S)))+(?!\w)")
_CORE = re.compile(r"^[^\w@$|!€]+|[^\w@$€]+$")
_TWICE = re.compile(r"([^\W\d_])\1")

_LETTERS = re.compile(r"[^\W\d_]+")

HELD_WORDS, PARTS = 100_000, 1024  # words a task counts at a time; parts of one in sums of roots
SIDE = 64  # letters of the trigram model: 0 is a word's edge, 1..26 a..z, the rest others by their code


def _letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (SIDE - 27)


@dataclass
class Model:
    bias: float
    words: dict[bytes, float] = field(default_factory=dict)
    begins: dict[int, dict[bytes, float]] = field(default_factory=dict)
    trigram: np.ndarray | None = None  # log probability of the third letter after two

    def words_behind(self, token: str, may_begin: Callable[[str], bool] | None = None) -> Iterator[str]:
        """The words behind a token; white space in it is noise or parts words."""
        if " " in token:
            yield from readings(token.split(), self.trigram, may_begin)
        else:
            yield decode(token, self.trigram)

    def restored(self, token: str) -> str:
        return " ".join(sorted(set(self.words_behind(token))))


Cells = dict[tuple[int, int], tuple[float, str, str]]  # cost, the word's first letters, its last one


def _step(cells: Cells, c: str, trigram: np.ndarray, leet_cost: float = 1.5, noise_cost: float = 0.5, drop_cost: float = 7.0, repeat_cost: float = 0.5) -> Cells:
    then: Cells = {}
    plain, log = c.isalpha(), trigram.item
    letters = [(c, _letter(c), 0.0)] if plain else [(x, _letter(x), leet_cost) for x in LEET.get(c, "")]
    for state, (cost, head, last) in cells.items():
        a, b = state
        for x, k, extra in letters:
            way = (cost + extra - log(a, b, k), head + x if len(head) < HEAD else head, x)
            if (b, k) not in then or way < then[b, k]:
                then[b, k] = way
        if c == last:
            way = (cost + repeat_cost, head, last)
            if state not in then or way < then[state]:
                then[state] = way
        if not plain:
            way = (cost + (drop_cost if LEET.get(c, c) else noise_cost), head, last)
            if state not in then or way < then[state]:
                then[state] = way
    return then or cells


def _end(cells: Cells, trigram: np.ndarray) -> tuple[float, str]:
    return min((cost - float(trigram[a, b, 0]), head) for (a, b), (cost, head, _) in cells.items())


def decode(token: str, trigram: np.ndarray) -> str:
    """Viterbi over a lattice whose states are the last two letters; arcs of a character read it as a
    letter, as a letter it is written for, as a repetition of the last letter, or as noise.

    States hold a word's first HEAD letters, so time grows with the token's length and memory doesn't.
    """
    cells: Cells = {(0, 0): (0.0, "", "")}
    for c in token:
        cells = _step(cells, c, trigram)
    return _end(cells, trigram)[1]


def readings(row: Iterable[str], trigram: np.ndarray, may_begin: Callable[[str], bool] | None = None) -> Iterator[str]:
    """Words behind single letters in a row; each blank is noise or the end of a word.

    Letters are read once. Words that are still open go on while their cost is within BEAM of the cheapest
    way to read all letters so far; each that can end within BEAM counts, and so does the same stretch as
    written, if it is of letters alone. Words of one letter don't count. An open word of HEAD letters has
    shown all its beginnings, and with may_begin one is known early that begins like no word that is looked
    for; of these only the cheapest goes on, as it may be on the cheapest way.
    """
    opened: list[tuple[int, Cells, str]] = [(0, {(0, 0): (0.0, "", "")}, "")]
    for j, letters in enumerate(row):
        ended, costs = [], []
        for n, (i, cells, plain) in enumerate(opened):
            for c in letters:
                cells = _step(cells, c, trigram)
            opened[n] = (i, cells, plain + letters if len(plain) < HEAD else plain)
            ended.append(_end(cells, trigram))
            costs.append(min(v[0] for v in cells.values()))
        best = min(cost for cost, _ in ended)
        going, rest = [], []
        for w, (cost, word), least in zip(opened, ended, costs):
            i, cells, plain = w
            if i < j and cost <= best + BEAM and len(plain) < HEAD:
                yield word
                if plain.isalpha() and plain != word:
                    yield plain
            wanted = may_begin is None or may_begin(plain) or any(may_begin(v[1]) for v in cells.values())
            if least <= best + BEAM:
                (going if len(plain) < HEAD and wanted else rest).append((least, n, w))
        if rest:
            going.append(min(rest, key=lambda r: r[:2]))
        opened = [w for _, _, w in going]
        opened.append((j + 1, {(0, 0): (best, "", "")}, ""))


def _words(low: str) -> set[bytes]:
    """Words of a lower-cased text."""
    return set(low.encode("utf-8", "surrogatepass").translate(_WORDS).split())


def suspicious(text: str) -> set[str]:
    """Tokens that may be obfuscated: marks or digits among letters, doubled letters, or single letters in a row with what parts them."""
    return _suspicious(text.lower())


def _suspicious(low: str) -> set[str]:
    found: set[str] = set()
    twice, cut = _TWICE.search, _CORE.sub
    for t in set(low.split()):
        if t.isalpha() or (t := cut("", t)).isalpha():
            if twice(t):
                found.add(t)
        elif any(map(str.isalpha, t)):
            found.add(t)
    found.update(" ".join(m[0].split()) for m in _SPACED.finditer(low) if any(map(str.isalpha, m[0])))
    return found


def _features(word: bytes) -> list[tuple[int, bytes]]:
    """The word itself (0) and its beginnings by their lengths."""
    return [(0, word), *((k, word[:k]) for k in PREFIXES if len(word) > k)]


class Marks:
    """Features of sets of words, of those that are known. Few words begin like a known one, so most are put aside by their first bytes."""

    def __init__(self, known: Iterable[tuple[int, bytes]]):
        self.words, self.heads = set(), {k: set() for k in PREFIXES}
        for k, w in known:
            (self.heads[k] if k else self.words).add(w)
        self.heads = {k: v for k, v in self.heads.items() if v}
        self.starts = {w[: PREFIXES[0]] for v in self.heads.values() for w in v}
        self.opens = self.starts | {w[: PREFIXES[0]] for w in self.words}

    def may_begin(self, begun: str) -> bool:
        """Whether a word with a feature may begin so."""
        return (b := begun.encode("utf-8", "surrogatepass")[: PREFIXES[0]]) in self.opens or len(b) < PREFIXES[0]

    def may(self, word: bytes) -> bool:
        return word in self.words or word[: PREFIXES[0]] in self.starts

    def of(self, words: set[bytes]) -> set[tuple[int, bytes]]:
        found, first, starts = {(0, w) for w in words & self.words}, PREFIXES[0], self.starts
        for w in [w for w in words if w[:first] in starts]:
            found.update((k, w[:k]) for k, known in self.heads.items() if len(w) > k and w[:k] in known)
        return found


class Scorer:
    """Scores texts. Words behind tokens are remembered in two generations of about HELD_BYTES / 2 each."""

    ENTRY = 300  # bytes of a remembered token besides its own and its words'

    def __init__(self, model: Model):
        self.model = model
        self.young: dict[str, tuple[bytes, ...]] = {}
        self.elder: dict[str, tuple[bytes, ...]] = {}
        self.size = 0
        self.weights = {(0, w): v for w, v in model.words.items()} | {(k, w): v for k, known in model.begins.items() for w, v in known.items()}
        self.marks = Marks(self.weights)

    def _restored(self, token: str, marked: bool) -> Iterable[bytes]:
        if " " in token:  # rows of letters seldom come twice
            return (w for r in self.model.words_behind(token, self.marks.may_begin if marked else None) for w in _words(r.lower()))
        if (more := self.young.get(token)) is not None:
            return more
        if (more := self.elder.get(token)) is None:
            more = tuple({w for r in self.model.words_behind(token) for w in _words(r.lower())})
        self.young[token] = more
        self.size += self.ENTRY + len(token) + sum(map(len, more)) + 40 * len(more)
        if self.size > HELD_BYTES // 2:
            self.elder, self.young, self.size = self.young, {}, 0
        return more

    def words_of(self, text: str, marked: bool = False) -> set[bytes]:
        """Words of a text and those behind its suspicious tokens; with marked only such of these as may have a feature."""
        low = text.lower()
        words = _words(low)
        for token in _suspicious(low):
            more = self._restored(token, marked)
            words.update((w for w in more if self.marks.may(w)) if marked else more)
        return words

    def score(self, text: str) -> float:
        z = self.model.bias
        for f in sorted(self.marks.of(self.words_of(text, True))):
            z += self.weights[f]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's texts; counts are handed on before there are too many words."""
    seen: Counter = Counter()
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
    for b in bounded(batches, 0):
        for t in b.column(0):
            seen.update(_LETTERS.findall((t.as_py() or "").lower()))
            if len(seen) >= HELD_WORDS:
                yield out()
                seen.clear()
    yield out()


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n) of words and their counts: a word counts by its root, in whole parts, so that sums don't depend on their order."""
    cells: Counter = Counter()
    for b in batches:
        for w, n in zip(b.column(0), b.column(1)):
            s, part = [0, 0, *map(_letter, w.as_py()), 0], round(PARTS * math.sqrt(n.as_py()))
            for x, y, z in zip(s, s[1:], s[2:]):
                cells[(x * SIDE + y) * SIDE + z] += part
    yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int32()), pa.array(list(cells.values()), pa.int64())], names=["cell", "n"])


def character_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a letter after two, over the words of all texts. SIDE^3 sums at most come to the driver.

    Null texts have no words; repeated rows count again; without words all letters are alike.
    """
    tune(df.sparkSession)
    words = df.select(df[text_col]).mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = words.mapInArrow(_cell_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full(SIDE**3, 0.05)
    counts[sums["cell"].to_numpy()] += sums["n"].to_numpy() / PARTS
    counts = counts.reshape(SIDE, SIDE, SIDE)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def train(rows: list[tuple[str, int]], trigram: np.ndarray, rounds: int = 300, weight: float = 4e-4) -> Model:
    """A model from (text, toxic) rows and a character model; without rows of both kinds, every score is the smoothed share of toxic ones."""
    toxic = sum(y for _, y in rows)
    clean = len(rows) - toxic
    model = Model(math.log((toxic + 0.5) / (clean + 9.5)), {}, {}, trigram)
    if not toxic or not clean:
        return model
    draft = Scorer(model)
    # words are cut anew in each pass, so that the driver holds no more than the texts and counts
    seen, with_toxic = Counter(), Counter()
    for t, y in rows:
        if y:
            with_toxic.update({f for w in draft.words_of(t) for f in _features(w)})
    with_toxic = {f: n for f, n in with_toxic.items() if n >= 3}
    marks = Marks(with_toxic)
    for t, y in rows:
        if not y:
            seen.update(marks.of(draft.words_of(t)))
    gain = {f: n * math.log((n + 0.3) / (toxic + 1) * (clean + 1) / (seen[f] + 0.3)) for f, n in with_toxic.items() if n * clean > 1.5 * seen[f] * toxic}
    chosen = {f: i for i, f in enumerate(sorted(gain, key=lambda f: (-gain[f], f))[:FEATURES])}
    row, col = [], []
    marks = Marks(chosen)
    for i, (t, _) in enumerate(rows):
        own = sorted(chosen[f] for f in marks.of(draft.words_of(t)))
        row.append(np.full(len(own), i, np.int64))
        col.append(np.array(own, np.int64))
    row, col = np.concatenate(row), np.concatenate(col)
    y = np.array([v for _, v in rows], np.float64)
    m = len(chosen)
    w, b = _sparse_logistic(row, col, y, m, np.zeros(m), model.bias, weight, rounds)
    kept = np.flatnonzero(w)  # those chosen are fitted again with a tenth of the penalty, which shrinks them less
    place = np.full(m, -1)
    place[kept] = np.arange(len(kept))
    own = place[col] >= 0
    w2, b = _sparse_logistic(row[own], place[col[own]], y, len(kept), w[kept], b, weight / 10, rounds)
    w[kept] = w2
    model.bias = float(b)
    for (k, x), i in chosen.items():
        if abs(w[i]) > 1e-3:
            (model.words if k == 0 else model.begins.setdefault(k, {}))[x] = float(w[i])
    return model


def _sparse_logistic(row, col, y, m: int, w, b: float, weight: float, rounds: int):
    """Weights and bias by accelerated proximal gradient: mean logistic loss, absolute weights, no penalty on the bias."""
    n = len(y)
    per_row = np.bincount(row, minlength=n)
    step = 80 / (1 + per_row.mean() + 3 * per_row.std())
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(c + np.bincount(row, weights=v[col], minlength=n), -40, 40)))
        g = (p - y) / n
        new = v - step * np.bincount(col, weights=g[row], minlength=m)
        new = np.sign(new) * np.maximum(np.abs(new) - step * weight, 0)
        nb = c - step * g.sum()
        s = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    return w, b


def is_held_out(id_col: str):
    """crc32 of the id's decimal text modulo 5 is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HOLD_OUT == 0, F.lit(True))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits scores on labelled rows that aren't held out: the first by a hash of their ids, up to about FIT_CHARS characters.

    The character model reads all texts, without labels.

    Rows that share an id have one label (toxic, if any says so) and count once, with the least text.
    Without documents or labels every score is the smoothed share of toxic rows.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.where(~is_held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.where("y = 1").orderBy(*order).limit(FIT_TOXIC).union(known.where("y = 0").orderBy(*order).limit(FIT_CLEAN))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    before = F.coalesce(F.sum(F.length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of so few rows
    rows = rows.withColumn("before", before).where(F.col("before") < FIT_CHARS).select("id", "text", "y").collect()
    return train([(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["id"])], character_model(df, text_col))


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row's whole text."""
    spark = tune(df.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t.as_py() or "") for t in b.column(1)], pa.float64())], names=["id", "score"])

    got = df.select(df[id_col].cast("long").alias("id"), df[text_col]).mapInArrow(run, "id long, score double")
    return got.withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Whole rows whose text scores below the threshold; all columns pass as they are, by position."""
    spark = tune(df.sparkSession)
    held, at = spark.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for b in bounded(batches, at):
            yield b.filter(pa.array([scorer.score(t.as_py() or "") < threshold for t in b.column(at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
