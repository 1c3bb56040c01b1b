"""Dedup of lines over all documents, by DataFrame functions alone.

Lines are exploded with their places, normalised and hashed (128 bits); distinct documents are counted
for each hash, lines of hashes that enough documents hold are dropped outside the least document, and
what stays is put together by places again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LEAST_CHARS = 10  # code points of the shortest key that is looked at
LEAST_DOCUMENTS = 2  # that hold a line which counts as repeated
SHARE = 4096  # a key of at least this part of all repeated lines is frequent, so there are no more than this many

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space around it, its ASCII letters in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _two(c: Column) -> list[Column]:
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, t1, t2, text): a row's id and its text with its hash; rows alike in both are alike in all that follows."""
    rows = docs.select(docs[id_col].alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.select("doc", *(h.alias(n) for n, h in zip(("t1", "t2"), _two(F.col("text")))), "text")


def keyed_lines(texts: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, t1, t2, pos, h1, h2) of every line whose key is long enough."""
    lines = texts.select("doc", "t1", "t2", F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keys.select("doc", "t1", "t2", "pos", *(h.alias(n) for n, h in zip(("h1", "h2"), _two(F.col("key")))))


def repeated_keys(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(h1, h2, least, n_documents, n_lines) of keys that enough documents hold; least is the smallest id, nulls aside."""
    by_document = lines.groupBy("h1", "h2", "doc").agg(F.count("*").alias("n"))
    counted = by_document.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.count("*").alias("n_documents"), F.sum("n").alias("n_lines"))
    return counted.where(F.col("n_documents") >= least_documents)


def dropped_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc, t1, t2, pos) of the lines that go. repeated is read twice, so it should be a written table.

    Frequent keys (SHARE at most) are sent to the lines; the rest meets in a join where no key has more
    than 1/SHARE of the repeated lines. Lines settled by the first are dealt evenly in the second.
    """
    total = repeated.agg(F.sum("n_lines").alias("n")).first()["n"] or 0
    often = F.col("n_lines") * SHARE >= F.lit(total)
    frequent = repeated.where(often).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("least").alias("f_least"))
    rest = repeated.where(~often).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("least").alias("r_least"))
    told = lines.join(F.broadcast(frequent), (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    told = told.withColumn("open", F.col("f1").isNull()).withColumn("at", F.when(F.col("open"), F.col("h1")).otherwise(F.xxhash64("doc", "t1", "pos")))
    met = told.join(rest.hint("merge"), (F.col("at") == F.col("r1")) & (F.col("h2") == F.col("r2")) & F.col("open"), "left")
    least = F.coalesce("f_least", "r_least")  # never null: of two documents at most one has a null id
    return met.where(least.isNotNull() & ~F.col("doc").eqNullSafe(least)).select("doc", "t1", "t2", "pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(id, n_lines, n_dropped, text) of every row, text being what is left.

    Texts are split at line feeds (a null or empty text is one empty line). A key of least_chars code
    points or more, found in least_documents documents or more, loses all its lines but those in the
    document of the smallest id. Rows that share an id are one document; so are rows without an id,
    which comes after all others. Repeated rows and their columns beside these are left as they are:
    each row gives one. Of a text whose lines all go, the empty text is left. An empty table gives no
    rows.
    """
    texts = _texts(docs, id_col, text_col)
    lines = materialize(keyed_lines(texts, least_chars))
    gone = dropped_lines(lines, materialize(repeated_keys(lines, least_documents)))
    places = gone.groupBy("doc", "t1", "t2").agg(F.collect_set("pos").alias("gone"))
    places = places.select(F.col("doc").alias("g"), F.col("t1").alias("g1"), F.col("t2").alias("g2"), "gone")
    both = texts.join(places.hint("merge"), F.col("doc").eqNullSafe(F.col("g")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")), "left")
    cut = both.select("doc", "text", "gone", _split(F.col("text")).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))  # keeps the order
    left = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return cut.select(
        F.col("doc").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias(text_col),
    )
