"""Phrase collocations: phrases of 2 to 4 words that stand together more often than their parts let expect.

A sketch of counters, added up over all texts, bounds the count of every phrase from above. Texts are
then taken in shards: phrases of a shard whose bound, and that of all phrases within them, reaches the
least count compile into an automaton whose patterns carry a blank at either end; it counts all their
places, overlapping ones too. Counts are summed over shards, and thresholds are applied to the sums.
A phrase that is frequent passes the sketch in every shard, so its sum is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, materialize, tune

LEAST, WORDS, TOP = 30, 4, 2000
NO_LANGUAGE = "und"
SCALE = 2_000_000
CONTAINED = (100, 80)  # a candidate goes if 100 times a longer one's count is at least 80 times its own
CELLS = (1 << 16, 1 << 30)  # counters of a sketch, at least and at most; workers and the driver hold a bit of each
BYTES = 16  # of text for which there is a counter, in between
SHARD = 1 << 23  # bytes of text that one automaton scans, or a single piece of one
TASK = 1 << 26  # bytes of text that a task takes at least, if all cores have one: the more, the fewer rows of a phrase are shuffled
BLOCK = 1 << 20  # counters that are added up together
PARTS = 32  # a language's phrases are ranked in so many parts first

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Bytes to words parted by blanks and pieces parted by line feeds, ASCII letters in lower case.
_FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ENDS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")


def cells_for(n_bytes: int) -> int:
    """Counters for so many bytes of text: a power of two."""
    return min(max(CELLS[0], 1 << (n_bytes // BYTES).bit_length()), CELLS[1])


class Shard:
    """Words of texts of one language in a row; pieces are parted by a line feed."""

    def __init__(self, lang: str, texts: list[bytes]):
        flat = b"\n".join(texts).translate(_FOLD).replace(b"\n", b" \n ")
        words = pc.split_pattern(pa.array([flat], pa.large_binary()).cast(pa.large_string()), " ").flatten()
        words = words.filter(pc.not_equal(words, ""))
        coded = words.dictionary_encode()
        self.lang, self.words = lang, coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seed = xxhash.xxh64_intdigest(lang.encode())
        hashes = np.array([xxhash.xxh64_intdigest(w.encode(), seed) for w in self.words], np.uint64)
        ends = np.array([w == "\n" for w in self.words], bool)
        self.word = ~ends[self.codes]
        self.hashes = hashes[self.codes]

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For phrases of 1, 2, ... words: where they begin and lie in a piece, and their hashes at all places."""
        within, h = self.word, self.hashes
        yield within, h
        for n in range(1, WORDS):
            within = within[:-1] & self.word[n:]
            h = (h[:-1] * _A) ^ self.hashes[n:]
            h = (h ^ (h >> np.uint64(31))) * _B
            yield within, h

    def cells(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Counters, rising, that phrases of 1 to WORDS words here add to, and how much (255 at most)."""
        at = np.concatenate([(h[within] >> np.uint64(64 - bits)).astype(np.uint32) for within, h in self.grams()])
        at.sort()
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        return at[first], np.minimum(np.diff(first, append=len(at)), 255).astype(np.uint8)

    def candidates(self, sketch: np.ndarray, bits: int) -> tuple[list[str], list[int]]:
        """Distinct phrases here, with the numbers of their words, whose counters and whose parts' counters have their bit set."""
        found, sizes, before, ids = [], [], None, None
        for n, (within, h) in enumerate(self.grams(), 1):
            at = np.flatnonzero(within if n == 1 else within & before[:-1] & before[1:])
            cell = h[at] >> np.uint64(64 - bits)
            at = at[(sketch[(cell >> np.uint64(3)).astype(np.int64)] << (cell & np.uint64(7)).astype(np.uint8)) & 128 > 0]
            passed = np.zeros(len(within), bool)
            passed[at] = True
            # ids tell phrases apart exactly: the id of all words but the last, then the last one's
            key = self.codes[at] if n == 1 else ids[at] * len(self.words) + self.codes[at + n - 1]
            _, first, own = np.unique(key, return_index=True, return_inverse=True)
            ids = np.zeros(len(passed), np.int64)
            ids[at] = own
            for i in at[first].tolist():
                found.append(" ".join([self.words[c] for c in self.codes[i : i + n]]))
            sizes += [n] * len(first)
            before = passed
        return found, sizes

    def text(self) -> str:
        return " " + " ".join([self.words[c] for c in self.codes]) + " "


def counted(text: str, phrases: list[str]) -> np.ndarray:
    """How often each of distinct phrases stands in a text whose words have one blank on either side."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(phrases):
        machine.add_word(f" {p} ", i)
    if not phrases:
        return np.zeros(0, np.int64)
    machine.make_automaton()
    places = np.fromiter((i for _, i in machine.iter(text)), np.int64)
    return np.bincount(places, minlength=len(phrases))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about SHARD bytes, cut where pieces end; a piece stays whole."""
    a = 0
    while len(text) - a > SHARD and (m := _ENDS.search(text, a + SHARD)):
        yield text[a : m.end()]
        a = m.end()
    yield text[a:] if a else text


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of rows (lang, text): texts of a language together up to about SHARD bytes."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for b in bounded(batches, 1, SHARD):
        texts = b.column(1).cast(pa.binary())
        for lang, text in zip(b.column(0).to_pylist(), texts.to_pylist()):
            for part in _pieces(text):
                held.setdefault(lang, []).append(part)
                size += len(part) + 1
                if size >= SHARD:
                    yield from (Shard(k, v) for k, v in held.items())
                    held, size = {}, 0
    yield from (Shard(k, v) for k, v in held.items())


def _packed(cells: np.ndarray, n: np.ndarray) -> bytes:
    """Rising numbers of counters within a block by their gaps, plane by plane of bytes, then what they get."""
    gaps = np.diff(cells, prepend=np.uint32(0)).astype("<u4")
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + n.tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), dtype=np.int64), planes[4]


def sketch_of(texts: DataFrame, bits: int, least: int = LEAST) -> np.ndarray:
    """A bit for each of 1 << bits counters of phrases of 1 to WORDS words: whether it reaches the least count, or 255.

    Counters are added up block by block in tasks, where their bytes stay; the driver gets the bits, 1 << bits - 3 bytes.
    """
    limit, block = min(least, 255), min(BLOCK, 1 << bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            cells, n = shard.cells(bits)
            own = cells // np.uint32(block)
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            packed = [_packed(cells[a:b] % np.uint32(block), n[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)])]
            yield pa.RecordBatch.from_arrays([pa.array(own[starts], pa.int32()), pa.array(packed, pa.binary())], names=["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda k, sums: pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(sums >= limit).tobytes()], pa.binary())], names=["block", "cells"])
        at, sums = None, np.zeros(block, np.uint8)
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1)):
                if k != at:
                    if at is not None:
                        yield row(at, sums)
                    at, sums = k, np.zeros(block, np.uint8)
                cells, n = _unpacked(data.as_py())
                sums[cells] += np.minimum(n, 255 - sums[cells])
        if at is not None:
            yield row(at, sums)

    form = "block int, cells binary"
    out = np.zeros((max(1, (1 << bits) // block), -(-block // 8)), np.uint8)
    merged = materialize(texts.mapInArrow(add, form).repartition("block").sortWithinPartitions("block").mapInArrow(merge, form))
    for r in merged.toLocalIterator():
        out[r["block"]] = np.frombuffer(r["cells"], np.uint8)
    discard(merged)
    return out.reshape(-1)


def phrase_counts(texts: DataFrame, sketch: np.ndarray, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f) of phrases of 1 to WORDS words with f >= least, f exact; phrase '' has all words' number. sketch: that of the least count or a lower one."""
    spark = texts.sparkSession
    held, bits = spark.sparkContext.broadcast(sketch), len(sketch).bit_length() + 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            found, sizes = shard.candidates(held.value, bits)
            counts = counted(shard.text(), found)
            found, sizes, counts = [*found, ""], [*sizes, 0], [*counts.tolist(), int(shard.word.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "words", "f"])

    rows = texts.mapInArrow(scan, "lang string, phrase string, words int, f long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least))


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(24,0)")


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of candidates: the cut of the lowest score, the first of like ones."""
    candidates = counts.where((F.col("words") >= 2) & (F.col("f") >= least)).select("lang", "phrase", "words", F.col("f").alias("a"))
    split = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(split, a, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("*", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, n in (("left", "l"), ("right", "r")):
        own = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(n))
        cuts = cuts.join(own, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))).drop("_lang", "_phrase")
    score = F.expr(f"CAST(a AS DECIMAL(24,0)) * {SCALE} div (CAST(l AS DECIMAL(24,0)) + CAST(r AS DECIMAL(24,0)))").cast("long")
    best = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def uncontained(candidates: DataFrame) -> DataFrame:
    """Candidates less those within a longer one that is nearly as frequent."""
    split = F.split("phrase", " ")
    longer = candidates.where("words > 2").select("lang", "words", F.col("a").alias("f"), split.alias("w"))
    sizes = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    parts = sizes.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("part"))
    most = parts.groupBy("lang", "part").agg(F.max("f").alias("f")).withColumnRenamed("lang", "_lang")
    met = candidates.join(most, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("part")), "left")
    whole, share = CONTAINED
    return met.where(F.col("f").isNull() | (_exact("f") * whole < _exact("a") * share)).drop("_lang", "part", "f")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, then a, then the phrase's bytes.

    ASCII letters are lower-cased; pieces end at [.,;:!?] and line ends, words at blanks and tabs. a is the
    phrase's count, l and r those of its two parts at its weakest cut, n that of all words of the language.
    Null texts are empty, a null language is 'und'; repeated rows count again. Other columns are left out.
    A language without a candidate, and an empty table, give no rows.
    """
    tune(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[lang_col], F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = cells_for(size).bit_length() - 1
    texts = texts.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK)))
    counts = materialize(phrase_counts(texts, sketch_of(texts, bits, least), least))
    found = materialize(scored(counts, least))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = uncontained(found).withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
