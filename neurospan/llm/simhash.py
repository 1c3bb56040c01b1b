"""SimHash fingerprints and their neighbours, by DataFrame functions alone.

Terms are pairs of adjoining words (the last word stands with nothing after it), weighted by their
occurrences and their lengths. Each term's 64-bit hash votes on 64 signed bits; two votes are counted
in the halves of one sum, so 32 sums count all of them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_WEIGHT = 15
_HALVES = 0x100000001


def terms(text: Column) -> Column:
    """Pairs (w1, w2) of adjoining words of a lower-cased text; w2 is null after the last word. Null for a text without words."""
    words = F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.arrays_zip(words.alias("w1"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("w2")))


def fingerprints(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and fingerprint long of each distinct key; a text without words has fingerprint 0.

    Needs no exchange if df is dealt by keys already; sums are built up before one otherwise.
    """
    split = df.select(*keys, terms(F.col(text_col)).alias("_terms"))
    rows = split.select(*keys, F.inline_outer("_terms").alias("w1", "w2"))
    hashed = rows.select(*keys, F.xxhash64("w1", "w2").alias("h"), F.when(F.col("w1").isNull(), 0).otherwise(F.least(F.length("w1") + F.coalesce(F.length("w2"), F.lit(0)), F.lit(MOST_WEIGHT))).cast("long").alias("w"))
    votes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_HALVES)) * F.col("w")).alias(f"v{j}") for j in range(32)]
    counted = hashed.groupBy(*keys).agg(F.sum("w").alias("total"), *votes)

    def bit(j: int) -> Column:
        count = F.col(f"v{j % 32}").bitwiseAND(F.lit(0xFFFFFFFF)) if j < 32 else F.shiftrightunsigned(F.col(f"v{j % 32}"), 32)
        return F.when(2 * count > F.col("total"), F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))

    bits = bit(0)
    for j in range(1, 64):
        bits = bits.bitwiseOR(bit(j))
    return counted.select(*keys, bits.alias("fingerprint"))


def hexed(c: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def likeness(a: str, b: str) -> Column:
    """1 less the share of bits in which two fingerprints differ."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64


def tables(radius: int, blocks: int) -> list[tuple[int, int]]:
    """Masks and numbers of the permuted tables: fingerprints within the radius agree in blocks - radius of the blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << j for j in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [(n, sum(masks[k] for k in own)) for n, own in enumerate(combinations(range(blocks), blocks - radius))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def neighbours(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (query, other) of fingerprints within the radius, itself included: each pair once.

    Both sides hold distinct longs in column fingerprint. Each permuted table keys them by a choice of
    blocks; a pair counts in the first table where its keys agree.
    """
    made = [(n, _signed(m)) for n, m in tables(radius, blocks)]
    keyed = lambda df, name: df.select(F.col("fingerprint").alias(name), F.inline(F.array(*(F.struct(F.lit(n).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for n, m in made))))
    both = keyed(queries, "query").join(keyed(corpus, "other"), ["t", "key"])
    differ = F.col("query").bitwiseXOR(F.col("other"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(n)) for n, m in made))
    return both.where((F.bit_count(differ) <= radius) & (F.col("t") == first)).select("query", "other")


KEYS = ["o", "z", "p", "n"]  # of a class of like rows: id (the least long for null), whether it isn't null, text's hash, code points
CHUNK = 1 << 16


def successors(classes: DataFrame) -> DataFrame:
    """(KEYS, next struct of KEYS) of distinct classes in ascending order, the first after the last.

    Classes are sorted by ranges, which a written table keeps apart; only the first ones of ranges, as
    many as there are shuffle partitions, meet in one task.
    """
    from .common import materialize

    own = F.struct(*KEYS)
    ranges = materialize(classes.select(*KEYS).repartitionByRange(*KEYS).withColumn("range", F.spark_partition_id()))
    low = ranges.select(*KEYS, "range", F.lead(own).over(Window.partitionBy("range").orderBy(*KEYS)).alias("next"))
    heads = ranges.groupBy("range").agg(F.min(own).alias("head"))
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("range", F.coalesce(F.lead("head").over(Window.orderBy("range")), F.first("head").over(whole)).alias("after"))
    return low.join(F.broadcast(after), "range").select(*KEYS, F.coalesce("next", "after").alias("next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) of each row.

    In the edited text the last quarter of the code points (rounded down) is replaced by as many of the
    next document's first, in ascending id order, the first following the last. Rows without an id come
    first, rows that share one follow each other by their texts' hashes; of rows like in both, each but
    the last is followed by its like. Null texts are empty. An empty table gives no rows.
    """
    from .common import materialize

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("id", F.lit(-(1 << 63))).alias("o"), F.col("id").isNotNull().alias("z"), F.xxhash64("text").alias("p"), F.length("text").alias("n"), "text")
    classes = materialize(rows.groupBy(*KEYS).agg(F.count("*").alias("copies")))
    ring = materialize(successors(classes))
    size = F.col("n")
    quarter = F.floor(size / 4).cast("int")
    dealt = rows.groupBy(*KEYS).agg(F.first("text").alias("text"))
    wanted = ring.select("next.*", F.struct(*KEYS).alias("prev"), quarter.alias("want"))
    heads = dealt.join(wanted, KEYS).select("prev.*", F.substring("text", F.lit(1), F.col("want")).alias("head"))
    kept = F.substring("text", F.lit(1), size - quarter)
    both = dealt.join(heads, KEYS).join(classes.hint("merge"), KEYS)
    kinds = [F.col("text"), F.concat(kept, F.col("head")), F.when(F.col("copies") > 1, F.concat(kept, F.substring("text", F.lit(1), quarter)))]
    kinds = F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in enumerate(kinds))), lambda x: x["text"].isNotNull())
    each = both.select(*KEYS, "copies", F.inline(kinds)).withColumn("sha", F.when(F.col("kind") > 0, F.sha2("text", 256)))
    prints = fingerprints(each, [*KEYS, "copies", "kind", "sha"])
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    one = prints.groupBy(*KEYS, "copies").agg(of(0, "fingerprint").alias("fingerprint"), *(of(k, c).alias(f"{c}{k}") for k in (1, 2) for c in ("fingerprint", "sha")))
    one = materialize(one)
    after = one.select(F.struct(*KEYS).alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    ended = one.join(ring.hint("merge"), KEYS).join(after.hint("merge"), "next")
    last = ended.select(*KEYS, F.col("sha1").alias("edited_sha256"), "fingerprint", F.col("fingerprint1").alias("edited_fingerprint"), "next_fingerprint")
    like = one.where("copies > 1").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 2) / CHUNK))).alias("chunk"))
    like = like.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(CHUNK).cast("long"), F.col("copies") - 1 - F.col("chunk") * CHUNK))).alias("copy"))
    like = like.select(*KEYS, F.col("sha2").alias("edited_sha256"), "fingerprint", F.col("fingerprint2").alias("edited_fingerprint"), F.col("fingerprint").alias("next_fingerprint"))
    rows = last.unionByName(like)
    return rows.select(F.when(F.col("z"), F.col("o")).alias(id_col), F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")


def counts_within(prints: DataFrame, wanted: Column, radius: int = 3) -> DataFrame:
    """(fingerprint, n_within) for the distinct fingerprints of wanted rows: how many rows lie within the radius."""
    classes = prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = prints.where(wanted).select("fingerprint").distinct()
    near = neighbours(asked, classes.select("fingerprint"), radius)
    return near.join(classes.withColumnRenamed("fingerprint", "other").hint("merge"), "other").groupBy(F.col("query").alias("fingerprint")).agg(F.sum("n").alias("n_within"))
