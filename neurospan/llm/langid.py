"""Language ID by fusion of evidence: text likelihood, declared markup language, address suffix and host prior.

The text model is a naive Bayes over byte trigrams of every language that occurs, fitted on a bounded
sample of each: its first FIT_ROWS rows by a hash of their ids, up to the row with which they hold
FIT_CHARS characters. Trigrams are counted on the executors, one task a language. Host priors come from grouped
aggregation of all rows' text posteriors, smoothed down a hierarchy: all rows, suffix, domain, host; a
row's own part is taken out of its host's counts. What a declared language or a suffix says about the
language is counted over all rows in the same way.

Null texts and addresses are no evidence. A row without any has the language of the overall prior. Rows
are judged one by one, also those that share an id; of languages equally likely the first by name is told.
An empty table gives no rows.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, tune

FIT_ROWS = 1500
FIT_CHARS = 20_000_000  # the fit reads whole texts up to about so many characters of each language
BUCKETS = 64  # that each language's rows are dealt to while its first ones are looked for
BITS = 15  # of a trigram's hash
TEMPER = 0.05  # weight of a trigram's evidence: neighbours aren't independent
STRENGTH = {"suffix": 20.0, "domain": 10.0, "host": 5.0}
SMOOTH = 1.0

_DROPPED = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*)", re.I)


def visible(page: str) -> str:
    """The text of a page without scripts, styles, comments, tags; entities are resolved."""
    return htmllib.unescape(_TAG.sub(" ", _DROPPED.sub(" ", page)))


def declared_language(page: str) -> str | None:
    m = _DECLARED.search(page)
    return language_tag(m[1]) if m else None


def language_tag(tag: str) -> str:
    """A declared tag in one form: lower case, subtags parted by hyphens (zh-hans and zh-hant stay apart)."""
    return tag.strip().lower().replace("_", "-")


_LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Hashes of byte trigrams of words (blanks included as word edges)."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()) + b" "
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    log: np.ndarray  # languages by trigram hashes

    def evidence(self, text: str) -> tuple[int, np.ndarray]:
        """Number of trigrams and tempered log likelihoods, the largest 0."""
        h = trigram_counts(text)
        if not len(h):
            return 0, np.zeros(len(self.languages))
        got = self.log[h].sum(axis=0) * TEMPER if len(h) < 4096 else np.bincount(h, minlength=1 << BITS) @ self.log * TEMPER
        return len(h), got - got.max()


def train(rows: list[tuple[str, str]]) -> Model:
    """From (language, text) rows; at least one language."""
    return _model(_counted(rows))


def _counted(rows) -> dict[str, np.ndarray]:
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        own = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
        own += np.bincount(trigram_counts(text), minlength=1 << BITS)
    return counts


def _model(seen: dict[str, np.ndarray]) -> Model:
    languages = sorted(seen)
    counts = np.full((1 << BITS, max(1, len(languages))), 0.5)
    for i, lang in enumerate(languages):
        counts[:, i] += seen[lang]
    return Model(languages or ["und"], np.log(counts / counts.sum(axis=0)))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on the bounded sample; a table without languages gives the one language und.

    Rows that share an id and a language count once, with their greatest text; those with a null in id, text or language don't.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.lower(F.col(lang_col)).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL AND id IS NOT NULL")
    # the first of each language: first of each of its buckets, so that a common language isn't one task's
    once = rows.groupBy("lang", "id").agg(F.max(F.length("text")).cast("long").alias("n")).withColumn("h", F.xxhash64("id"))
    first = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("h", "id"))
    some = once.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(BUCKETS))).withColumn("rank", first).where(F.col("rank") <= FIT_ROWS)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("rank") <= FIT_ROWS)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ids = first.withColumn("before", before).where(F.col("before") < FIT_CHARS).select("id", "lang")
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _counted((lang.as_py(), text.as_py()) for b in batches for lang, text in zip(b.column(0), b.column(1)))
        for lang, own in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([own.tobytes()], pa.binary())], names=["lang", "counts"])

    chosen = rows.join(F.broadcast(ids), ["id", "lang"]).groupBy("lang", "id").agg(F.max("text").alias("text"))  # rows that share an id count once
    counted = chosen.select("lang", "text").repartition("lang").mapInArrow(run, "lang string, counts binary")
    return _model({r["lang"]: np.frombuffer(r["counts"], np.int64) for r in counted.collect()})


def address(url: Column) -> dict[str, Column]:
    """Host, domain (its last two labels) and suffix (the last one), lower-cased; null without a host."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def text_evidence(df: DataFrame, model: Model, markup: bool) -> DataFrame:
    """df is (id, body, declared, host, domain, suffix); adds n (trigrams) and logs array<double>. With markup, body is a page that may declare a language."""
    tune(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in bounded(batches):
            ns, logs, said = [], [], []
            for body, d in zip(b.column(1), b.column(2).to_pylist()):
                body = body.as_py() or ""
                if markup:
                    d = d or declared_language(body)
                    body = visible(body)
                n, e = m.evidence(body)
                ns.append(n)
                logs.append(e)
                said.append(language_tag(d) if d and d.strip() else None)
            flat = pa.array(np.concatenate(logs) if logs else np.zeros(0))
            ends = pa.array(np.arange(len(logs) + 1, dtype=np.int32) * len(m.languages))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), *(b.column(k) for k in (3, 4, 5)), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(ends, flat)], names=["id", "declared", "host", "domain", "suffix", "n", "logs"])

    return df.mapInArrow(run, "id long, declared string, host string, domain string, suffix string, n long, logs array<double>")


def _softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """Adds posterior array<double> to written evidence rows (they are read again and again)."""
    k = len(languages)
    zero = F.array(*(F.lit(0.0) for _ in languages))
    rows = evidence.withColumn("p", F.when(F.col("n") > 0, _softmax(F.col("logs"))).otherwise(zero))
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    vector = F.array(*(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(k)))

    def counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy(*keys).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k))).select(*keys, vector.alias(name))

    hosts = materialize(rows.where("host IS NOT NULL").groupBy("suffix", "domain", "host").agg(*sums))
    said = rows.where("declared IS NOT NULL").groupBy("declared").agg(*sums)
    total = rows.agg(*sums).select(vector.alias("all"))
    everything = total.select(F.transform("all", lambda x: x + SMOOTH).alias("all")).select(F.transform("all", lambda x: x / F.aggregate("all", F.lit(0.0), lambda s, y: s + y)).alias("all"))

    def below(counts: Column, prior: Column, strength: float) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda s, y: s + y)
        return F.zip_with(counts, prior, lambda c, q: (c + strength * q) / (n + strength))

    suffixes = counted(hosts, ["suffix"], "c").crossJoin(F.broadcast(everything)).select("suffix", below(F.col("c"), F.col("all"), STRENGTH["suffix"]).alias("q_suffix"))
    domains = counted(hosts, ["suffix", "domain"], "c").join(suffixes, "suffix").select("domain", below(F.col("c"), F.col("q_suffix"), STRENGTH["domain"]).alias("q_domain"))
    own = hosts.select("domain", "host", vector.alias("c_host")).join(domains, "domain").select("host", "c_host", "q_domain")
    saying = said.select("declared", vector.alias("c_declared"))

    got = rows.join(own, "host", "left").join(saying, "declared", "left").crossJoin(F.broadcast(everything))
    less = F.zip_with("c_host", "p", lambda c, p: F.greatest(c - p, F.lit(0.0)))
    prior = F.when(F.col("c_host").isNotNull(), below(less, F.col("q_domain"), STRENGTH["host"])).otherwise(F.col("all"))
    # what a declaration says: P(language | declared) / P(language), its own row taken out
    spoken = F.zip_with("c_declared", "p", lambda c, p: F.greatest(c - p, F.lit(0.0)))
    ratio = F.when(F.col("c_declared").isNotNull(), F.zip_with(below(spoken, F.col("all"), SMOOTH * k), F.col("all"), lambda a, b: F.log(a / b))).otherwise(zero)
    logs = F.zip_with(F.zip_with(F.col("logs"), ratio, lambda a, b: a + b), F.transform(prior, lambda q: F.log(q)), lambda a, b: a + b)
    return got.withColumn("posterior", _softmax(logs)).drop("p", "c_host", "q_domain", "c_declared", "all", "logs")


def identify(df: DataFrame, model: Model, id_col: str, body_col: str, url: Column | None = None, declared: Column | None = None, host: Column | None = None, markup: bool = False) -> DataFrame:
    """(id, lang, confidence, n, declared, host) for each row. host stands in for a url where a table has only a source."""
    none = F.lit(None).cast("string")
    where = address(url) if url is not None else {"host": host if host is not None else none, "domain": host if host is not None else none, "suffix": F.when(host.isNotNull(), F.lit("")) if host is not None else none}
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(body_col).alias("body"), (declared if declared is not None else none).alias("declared"), *(c.alias(n) for n, c in where.items()))
    fused = fuse(materialize(text_evidence(rows, model, markup), even=True), model.languages)
    best = F.array_max("posterior")
    names = F.array(*(F.lit(x) for x in model.languages))
    return fused.select(F.col("id").alias(id_col), F.element_at(names, F.array_position("posterior", best).cast("int")).alias("lang"), best.alias("confidence"), "n", "declared", "host")
