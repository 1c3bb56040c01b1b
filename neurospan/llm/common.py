"""What the operators of this subpackage share: sessions, written tables, texts word by word."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512  # rows of an Arrow batch: what a Python worker holds is some hundred documents


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder (not yet made) in the store that driver and executors share.

    The cluster names it in spark.checkpoint.dir; a folder of our own is used only where that is
    unset, as in tests on one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if not held and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = held or f"file://{tempfile.mkdtemp(prefix='neurospan-')}"
    return f"{base.rstrip('/')}/neurospan-{uuid.uuid4().hex}"


def materialize(df: DataFrame, even: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there.

    even: rows that come straight from a scan and are slim are dealt anew to files of an even, advised
    size, instead of one small file for each part of the scan.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    (df.hint("rebalance") if even else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._neurospan_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Removes the files of a materialize() that nothing reads any more."""
    path = getattr(df, "_neurospan_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bounded(batches, column: int = 1, most: int = 1 << 23):
    """Record batches cut so that a column of texts, bytes or lists of ids holds about so many bytes in each, or a single row."""
    for b in batches:
        held = b.column(column)
        size = pc.multiply(pc.list_value_length(held), 4) if pa.types.is_list(held.type) else pc.binary_length(held)
        ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most)))
            yield b.slice(a, z - a)
            a = z


#: White space other than single blanks and line feeds between words (RE2).
_ODD = r"[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^[ \n]|[ \n]$"

#: Marks that always begin a pre-token of their own after a letter, and a word that ends with some. Of
#: capitals only Latin-1's: lower-cased, U+0130 ends in a mark, which would join those that follow.
_TAIL = ",.!|&$#*%"
_TAILED = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}A-ZÀ-ÖØ-Þ][" + _TAIL + "]+$"


class Memo:
    """Values (bytes) of keys that a worker has met, in two generations of about `most` bytes each.

    What is asked for moves to the younger generation; when that is full, the elder is forgotten. So a
    worker holds no more than about twice as much, however many different words its texts have.
    make(keys) gives the values of new ones.
    """

    ENTRY = 170  # bytes of an entry besides its key's and its value's own

    def __init__(self, make, most: int = 28 << 20):
        self.make, self.most = make, most
        self.young: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.size = 0

    def values_of(self, keys: list[str]) -> list[bytes]:
        """Values of distinct keys."""
        got = list(map(self.young.get, keys))
        if None in got:
            lacking = [i for i, v in enumerate(got) if v is None]
            wanted = [keys[i] for i in lacking]
            values = list(map(self.elder.get, wanted))
            new = [k for k, v in zip(wanted, values) if v is None]
            if new:
                made = iter(self.make(new))
                values = [next(made) if v is None else v for v in values]
            for i, v in zip(lacking, values):
                got[i] = v
            self.young.update(zip(wanted, values))
            self.size += self.ENTRY * len(wanted) + sum(map(len, wanted)) + sum(map(len, values))
            if self.size > self.most:
                self.elder, self.young, self.size = self.young, {}, 0
        return got


class WordCoder:
    """Token ids of whole texts, word by word, as little-endian 32-bit bytes.

    Where single blanks and line feeds are the only white space, no pre-token crosses from one word to
    the next, so words are encoded apart and remembered; marks that end a word are remembered apart from
    it. Keys are words with the blank before them left out, with their line feed, or, as a text's first,
    with a tab. Other texts are encoded whole, and so are those that match `whole`. With blanks=False
    white space leaves no ids, and keys are the words.

    encode(texts) gives the ids of each text; encode_words(words) those of words after a blank.
    """

    GROUP_BYTES = 1 << 22  # texts are cut into words together up to about so many bytes

    def __init__(self, encode, blanks: bool, encode_words=None, whole: str | None = None):
        self.encode, self.blanks = encode, blanks
        self.words = encode_words or (lambda words: encode([" " + w for w in words]))
        self.odd = f"{_ODD}|{whole}" if whole else _ODD
        self.memo = Memo(self._make)

    def _make(self, keys: list[str]) -> list[bytes]:
        bare = [k for k in keys if k[0] not in "\t\n"] if self.blanks else keys
        got = dict(zip(bare, self.words(bare))) if bare else {}
        rest = [k for k in keys if k not in got]
        if rest:
            got.update(zip(rest, self.encode([k.removeprefix("\t") for k in rest])))
        return [got[k] for k in keys]

    def batch(self, texts: pa.Array | list) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()), "")
        out: list[bytes] = []
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + self.GROUP_BYTES)))
            out += self._group(texts.slice(a, b - a))
            a = b
        return out

    def _group(self, texts: pa.Array) -> list[bytes]:
        odd = pc.or_(pc.match_substring_regex(texts, self.odd), pc.equal(texts, ""))
        plain = texts.filter(pc.invert(odd))
        parts = iter(self._plain(plain)) if len(plain) else iter(())
        return [(self.encode([t.as_py()])[0] if len(t.as_py()) else b"") if o else next(parts) for t, o in zip(texts, odd.to_pylist())]

    def _plain(self, texts: pa.Array) -> list[bytes]:
        if self.blanks:
            texts = pc.binary_join_element_wise("\t", pc.replace_substring(texts, "\n", " \n"), "")
        else:
            texts = pc.replace_substring(texts, "\n", " ")
        words = pc.split_pattern(texts, " ")
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        ids = self._values(coded.dictionary).take(coded.indices)
        places = np.frombuffer(ids.buffers()[1], np.int64)
        raw, cuts = memoryview(ids.buffers()[2]), places[bounds - bounds[0]].tolist()
        return [raw[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _values(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words; those with marks at their end have the ids of both parts."""
        bare = pc.utf8_rtrim(words, characters=_TAIL)
        parted = pc.not_equal(bare, words)
        parted = pc.replace_with_mask(parted, parted, pc.match_substring_regex(words.filter(parted), _TAILED))
        ends = pc.extract_regex(words.filter(parted), rf"(?P<tail>[{_TAIL}]+)$")
        heads = pc.if_else(parted, bare, words).dictionary_encode()
        tails = pc.replace_with_mask(pa.repeat("", len(words)), parted, pc.struct_field(ends, "tail")).dictionary_encode()
        marks = _strings(tails.dictionary)
        some = [t for t in marks if t]
        after = dict(zip(some, self.memo.values_of([("\t" if self.blanks else "") + t for t in some])))
        own = pa.array(self.memo.values_of(_strings(heads.dictionary)), pa.large_binary()).take(heads.indices)
        more = pa.array([after.get(t, b"") for t in marks], pa.large_binary()).take(tails.indices)
        return pc.binary_join_element_wise(own, more, pa.scalar(b"", pa.large_binary()))


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
