"""Near-duplicates by MinHash: fast similarity sketching, banding, and links confirmed on full shingle sets.

A sketch has T coordinates. In round i < T every shingle is thrown into a random bin with value i + u;
in round T + j every shingle goes into bin j, so after 2T rounds no bin is empty; rounds end as soon as
all bins are full. A coordinate is the least value in its bin, and two sets agree in one with the
probability of their Jaccard similarity (concentrated as with independent values).

Equal sets form a class that its smallest id stands for; only representatives are banded. They are
linked in rounds, so that the pairs to confirm are a few times the representatives, however large a
bucket is. First each is asked against one other, its hub: the member of its buckets that meets most
rows; a text that many were copied from is the hub of theirs. Then, in buckets that hold several
components still, each is asked against one member of the bucket's largest. What is apart even then goes
an exact way: buckets of at most SMALL_BUCKET by all pairs between components, the representatives of
larger ones by a prefix join (rarest shingles first), which no bucket size limits. Pairs whose sets can't
be similar are dropped beforehand by exact bounds, of sizes and of parity marks: sets toggle PARITY bits
by their shingles, and no more bits differ than the sets have shingles apart. With 32 bands of 4
coordinates a link at similarity 0.75 fails to meet in any bucket with probability 5e-6.

Rows without an id are linked with nothing and kept; rows that share an id share its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, materialize

SHINGLE = 5
BANDS, ROWS = 32, 4
PERCENT = 75
SMALL_BUCKET = 32
PARITY = 1024
SALTS = 16
FREQUENT = 64  # a shingle of more prefixes is dealt by classes of sizes
SALT_ROWS, MOST_SALTS = 4096, 64  # and one of more than that by salts too, of which there are so many at most
_U = np.uint64


# Shifts and factors of a public 64-bit finalizer.
def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after the other, and where each text's begin and end.

    Words are what ASCII white space parts, A-Z lower-cased. A text of fewer words is one shingle, one without words has none.
    """
    digest = xxhash.xxh3_64_digest
    hashed, counts = [], []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        counts.append(len(words))
        hashed.append(b"".join(map(digest, words)))
    w = np.frombuffer(b"".join(hashed), ">u8").astype(np.uint64)
    ends = np.cumsum([0, *counts])
    h = np.zeros(max(0, len(w) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size if len(h) else 0):
            h = _mix(h * _U(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k])
        out, bounds = [], [0]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a >= size:
                own = np.unique(h[a : b - size + 1])
            elif b > a:
                one = np.array([b - a], np.uint64)
                for x in w[a:b]:
                    one = _mix(one * _U(0xD6E8FEB86659FD93) + x)
                own = one
            else:
                own = w[:0]
            out.append(own)
            bounds.append(bounds[-1] + len(own))
    return np.concatenate(out) if out else w, np.array(bounds, np.int64)


def sketch(flat: np.ndarray, bounds: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """Sketches of non-empty sets, one row each; rows of empty sets stay at the largest value."""
    n = len(bounds) - 1
    full = np.iinfo(np.uint64).max
    got = np.full(n * t, full, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    low = _U((1 << 48) - 1)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(flat):
                break
            h = _mix(flat + _mix(np.array([i + 1], np.uint64) * _U(0x9E3779B97F4A7C15)))
            bins = ((h >> _U(48)) * _U(t) >> _U(16)).astype(np.int64) if i < t else i - t
            np.minimum.at(got, owner * t + bins, (_U(i) << _U(48)) | (h & low))
            lacking = (got.reshape(n, t) == full).any(axis=1)[owner]
            if not lacking.all():
                flat, owner = flat[lacking], owner[lacking]
    return got.reshape(n, t)


def band_keys(sketches: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One signed 64-bit key a band."""
    n, t = sketches.shape
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
        for k in range(t // bands):
            h = _mix(h * _U(0x9E3779B97F4A7C15) + sketches[:, k :: t // bands])
    return h.view(np.int64)


def parity_marks(flat: np.ndarray, bounds: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """Signed 64-bit words of each set's parity bits."""
    n = len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(bounds)) * bits + (flat & _U(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


def _signatures(df: DataFrame) -> DataFrame:
    """(id, n, k1, k2, bands, marks): set size, 128-bit key of the whole set, band keys, parity marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            flat, bounds = shingle_sets(b.column(1).to_pylist())
            sizes = np.diff(bounds)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([[_U(0)], np.cumsum(_mix(flat ^ _U(s)), dtype=np.uint64)]) for s in (0x1234567, 0xFEDCBA987)]
                k1, k2 = ((c[bounds[1:]] - c[bounds[:-1]]).view(np.int64) for c in sums)
            keys = band_keys(sketch(flat, bounds))
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[sizes > 0].ravel()))
            words = parity_marks(flat, bounds)
            marks = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(k1), pa.array(k2), bands, marks], names=["id", "n", "k1", "k2", "bands", "marks"])

    return df.mapInArrow(run, "id long, n long, k1 long, k2 long, bands array<long>, marks array<long>")


def _sets(df: DataFrame) -> DataFrame:
    """(id, set array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            flat, bounds = shingle_sets(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))], names=["id", "set"])

    return df.mapInArrow(run, "id long, set array<long>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    sized = both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("s"))
    return sized.where(100 * F.col("i") >= PERCENT * (F.col("s") - F.col("i"))).select("a", "b")


def _may(n: str, m: str, p: str, q: str):
    """Without this no intersection can suffice: sizes are near enough, and parity marks don't differ in too many bits."""
    small, large = F.least(n, m), F.greatest(n, m)
    apart = F.col(n) + F.col(m) - 2 * _needed(n, m)
    bits = sum((F.bit_count(F.col(p)[k].bitwiseXOR(F.col(q)[k])) for k in range(PARITY // 64)), F.lit(0))
    return (100 * small >= PERCENT * large) & (bits <= apart)


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id reachable, for ids of edges (a, b). Each round takes neighbours' least label and then the label's own."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        now = materialize(step.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = now.where("label != was").limit(1).count()
        discard(labels)
        labels = now.drop("was")
        labels._neurospan_path = now._neurospan_path
        if not changed:
            discard(both)
            return labels


def _needed(n: str, m: str):
    """How many shingles sets of n and m share at least if they are similar."""
    return F.floor((PERCENT * (F.col(n) + F.col(m)) + 99 + PERCENT) / (100 + PERCENT))


def _rest_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs between components among rest (id, n, marks, label) that share a shingle of their prefixes, rarest shingles first.

    Sets of n and m with the similarity share one among the n - ceil(0.75 n) + 1 first of either in any
    common order; after the first that they share, enough must be left in both. Frequent shingles are
    dealt by classes of sizes, which differ by one at most, and by salts.
    """
    tokens = rest.join(sets, "id").select("id", "n", "label", F.explode("set").alias("token"))
    freq = tokens.groupBy("token").agg(F.count("*").alias("f"), (F.min("label") != F.max("label")).alias("mixed")).where("f > 1")
    order = Window.partitionBy("id").orderBy("f", "token")
    placed = tokens.join(freq, "token", "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("r", F.row_number().over(order))
    prefix = placed.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1) & F.col("mixed"))
    width = F.when(F.col("f") > FREQUENT, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)) + 1e-9)).otherwise(-1)
    salts = F.least(F.ceil(F.col("f") / SALT_ROWS), F.lit(MOST_SALTS)).cast("int")
    prefix = prefix.select("id", "n", "label", "token", "r", width.alias("width"), salts.alias("salts")).join(rest.select("id", "marks"), "id")
    both = F.when(F.col("width") < 0, F.array("width")).otherwise(F.array("width", F.col("width") + 1))
    small = prefix.select(F.col("id").alias("a"), "n", "label", "marks", "token", "r", F.explode(both).alias("width"), "salts")
    small = small.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts")
    large = prefix.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("marks").alias("q"), F.col("r").alias("r2"), "token", "width", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    ahead = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    enough = 1 + F.least(F.col("n") - F.col("r"), F.col("m") - F.col("r2")) >= _needed("n", "m")
    keys = [small[c] == large[c] for c in ("token", "width", "salt")]
    met = small.join(large, [*keys, ahead, F.col("label") != F.col("other"), enough, _may("n", "m", "marks", "q")])
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of df: the least id of its component, and whether it is that id."""
    texts = df.select(df[id_col].cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(_signatures(texts), even=True)
    some = signed.where("n > 0 AND id IS NOT NULL")
    classes = some.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    rows = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = materialize(rows.join(sizes, ["band", "key"]).select("rep", "band", "key", "size"))
    ids = materialize(met.groupBy("rep").agg(F.sum("size").alias("reach")))
    info = materialize(signed.select(F.col("id").alias("rep"), "n", "marks").join(ids, "rep", "left_semi").dropDuplicates(["rep"]))
    sets = materialize(_sets(texts.join(ids.select(F.col("rep").alias("id")).hint("shuffle_hash"), "id", "left_semi")))
    left, right = info.select(F.col("rep").alias("a"), "n", F.col("marks").alias("p")), info.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("marks").alias("q"))

    def confirmed(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs that links (rep, to) come down to, and those of them that are similar."""
        pairs = links.where("rep != to").select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).distinct()
        pairs = materialize(pairs.join(left, "a").join(right, "b").where(_may("n", "m", "p", "q")).select("a", "b"))
        return pairs, materialize(_similar(pairs, sets))

    # round 1: each representative and the hub of all its buckets
    hubs = met.join(ids, "rep").groupBy("band", "key").agg(F.max(F.struct("reach", "rep")).alias("hub"))
    own = met.join(hubs, ["band", "key"]).groupBy("rep").agg(F.max("hub").alias("hub"))
    asked, edges = confirmed(own.select("rep", F.col("hub.rep").alias("to")))
    labels = components(edges)

    # round 2: in buckets of several components, each representative and one of the largest of them
    def labelled(df: DataFrame) -> DataFrame:
        return df.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    def mixed(df: DataFrame) -> DataFrame:
        apart = df.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
        return materialize(df.join(apart, ["band", "key"]).drop("lo", "hi"))

    known = mixed(labelled(met))
    parts = known.groupBy("band", "key", "label").agg(F.struct(F.count("*").alias("rows"), F.min("rep").alias("to")).alias("part"))
    main = parts.groupBy("band", "key").agg(F.max(F.struct("part", "label")).alias("main"))
    links = known.join(main, ["band", "key"]).where("label != main.label").select("rep", "main.part.to").distinct()
    pairs, found = confirmed(links)
    if found.limit(1).count():
        labels = components(edges := materialize(edges.union(found)))
        known = mixed(labelled(known.drop("label")))
    asked = asked.union(pairs)

    # the exact way, for buckets that hold several components still
    open_ = materialize(known.join(info, "rep"))
    few = open_.where(F.col("size") <= SMALL_BUCKET).select("band", "key", F.col("rep").alias("a"), "n", F.col("marks").alias("p"), "label")
    other = few.select("band", "key", F.col("a").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("label").alias("other"))
    more = few.join(other, (few.band == other.band) & (few.key == other.key) & (F.col("a") < F.col("b")) & (few.label != F.col("other")) & _may("n", "m", "p", "q")).select("a", "b").distinct()
    rest = open_.where(F.col("size") > SMALL_BUCKET).select(F.col("rep").alias("id"), "n", "marks", "label").dropDuplicates(["id"])
    todo = materialize(more.union(_rest_pairs(rest, sets)).distinct().join(asked, ["a", "b"], "left_anti"))
    found = materialize(_similar(todo, sets))
    if found.limit(1).count():
        labels = components(edges.union(found))

    # classes of several rows give them their component; copies of a class, however many, are dealt by a salt
    own = labels.select(F.col("id").alias("rep"), "label")
    several = classes.where("rows > 1").select("k1", "k2", "rep").join(own, "rep", "left")
    several = several.select("k1", "k2", F.coalesce("label", "rep").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = signed.select("id", "n", "k1", "k2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(several, ["k1", "k2", "salt"], "left")
    out = out.join(labels, "id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "label", "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
