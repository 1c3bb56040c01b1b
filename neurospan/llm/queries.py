"""Queries of the driver's contract: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and notices of licenses in every document.

    score: 1 where a notice is accepted, 0.5 with base phrases alone, else 0.
    """
    from .licenses import scan_licenses

    got = scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return got.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "spans.label")).alias("labels"),
        F.when(F.size("spans") > 0, 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image, read back, with its cosine hash as feature."""
    from .media import read_media, write_media

    got = read_media(write_media(table(spark, sf_dir, "documents")))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("hash")).alias("feature"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the two-tier byte-level BPE and decoded again."""
    import public_tokenizers

    from .bytebpe import decode_ids, encode_texts

    path, pattern = tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return decode_ids(encode_texts(table(spark, sf_dir, "documents"), path, pattern), path, pattern, digest=True)


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to plane shards in ascending doc_id order and read back."""
    from .planes import read_ids, write_ids

    manifest = write_ids(table(spark, sf_dir, "documents"), shared_dir(spark), tokenizer("word_bpe_49k.json"), end_id=2)
    return read_ids(spark, manifest, digest=True)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of 2048 tokens."""
    from .packing import pack_documents

    got = pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations: prompt turns once, completions with masks and places."""
    from .chat import format_preferences, pairs_from

    got = format_preferences(pairs_from(table(spark, sf_dir, "conversations")))
    return got.select(F.col("pair").alias("conv_id"), "part", "turn", "role", "segment", "learned", "start", "length")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and for ids divisible by 50 the fingerprints nearby.

    n_within: documents whose fingerprint is within 3 bits of the row's, itself included; null for other ids.
    """
    from .common import materialize
    from .simhash import counts_within, edited_fingerprints, hexed, likeness

    got = materialize(edited_fingerprints(table(spark, sf_dir, "documents")))
    asked = F.col("doc_id") % 50 == 0
    near = counts_within(got, asked).withColumn("asked", F.lit(True))
    got = got.withColumn("asked", asked).join(near.hint("merge"), ["fingerprint", "asked"], "left")
    return got.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed("fingerprint").alias("fingerprint"),
        hexed("edited_fingerprint").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
        "n_within",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model of the rows that aren't held out."""
    from .toxicity import fit, is_held_out, score_texts

    docs = table(spark, sf_dir, "documents")
    got = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's language, from its text, its declaration and its address."""
    from .langid import fit, identify

    pages = table(spark, sf_dir, "pages")
    return identify(pages, fit(table(spark, sf_dir, "documents")), "page_id", "html", url=F.col("url"), markup=True)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged, with its faults and its cheapest repair."""
    from .convrepair import FAULTS, apply_plans, damage, gaps, repair

    given = table(spark, sf_dir, "conversations")
    rows = damage(given)
    found, planned = repair(rows)
    out = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for more in (planned, gaps(rows), apply_plans(found, planned, digest=True)):
        more = more.withColumnRenamed("conv_id", "_own").hint("merge")
        out = out.join(more, out["conv_id"].eqNullSafe(more["_own"]), "left").drop("_own")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", *map(count, ("gaps", *FAULTS, "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines without those that documents of smaller ids hold."""
    from .linededup import dedup_lines

    got = dedup_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of every language of the documents."""
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


#: DuckDB SQL. Words as op2 cuts them; a notice is a pattern over the words, each between blanks.
_WORDS = r"""
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
 FROM documents"""


def _op2_sql() -> str:
    import re

    from .licenses import PHRASES, TEMPLATES, words_of

    def pattern(t: str) -> str:
        out = ""
        for piece in re.split(r"(<<[^>]*>>)", t):
            if piece == "<<optional>>":
                out += "(?:"
            elif piece == "<<end>>":
                out += ")?"
            elif piece.startswith("<<var:"):
                out += "(?:[^ ]+ ){0," + piece[6:-2] + "}"
            else:
                out += "".join(w.decode() + " " for w in words_of(piece))
        return " " + out

    places = " || ".join("list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in PHRASES)
    base = ", ".join(f"CASE WHEN contains(s, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    own = ", ".join(f"CASE WHEN regexp_matches(s, '{pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    pick = lambda c: f"array_to_string(list_sort(list_distinct(list_filter({c}, lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH words AS ({_WORDS}), cut AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM words),
found AS (SELECT doc_id, len(w) AS n, {places} AS places, [{base}] AS base, [{own}] AS own FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word,
 CAST(list_max(places) AS BIGINT) AS last_word, {pick('base')} AS base_labels, {pick('base || own')} AS labels,
 CASE WHEN len(list_filter(own, lambda x: x IS NOT NULL)) > 0 THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM found"""


def _op1_sql() -> str:
    from .chat import CLOSE, OPEN

    return f"""
WITH c AS (SELECT conv_id, turn, role, text, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last
 FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT conv_id, turn, role, text, 'chosen' AS side FROM c UNION ALL
 SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn = last THEN substring(text, length(text) // 2 + 1) ELSE text END, 'rejected' FROM c),
t AS (SELECT conv_id, turn, count(DISTINCT coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')) AS n FROM s GROUP BY ALL),
cut AS (SELECT conv_id, coalesce(min(turn) FILTER (n > 1), max(turn) + 1) AS cut FROM t GROUP BY ALL),
r AS (SELECT conv_id, CASE WHEN turn < cut THEN 'prompt' ELSE side END AS part, turn, role,
  '{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE.rstrip()}' || chr(10) AS segment
 FROM s JOIN cut USING (conv_id) WHERE turn >= cut OR side = 'chosen')
SELECT conv_id, part, turn, role, segment, part <> 'prompt' AND coalesce(role = 'assistant', FALSE) AS learned,
 CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
 CAST(length(segment) AS BIGINT) AS length
FROM r"""


#: Damaged rows in order, then the cheapest ways to each state of the grammar, row by row; ins has up to two insertions before a row.
_OP11 = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ord(c)::BIGINT),
  lambda a, b: xor(a // 256, t[(xor(a, b) % 256 + 1)::INT])))  % 20 AS kind FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
 FROM h, range(2) c(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (SELECT *, left(role, 1) AS r, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
 count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ins(p, k, q, added) AS (VALUES (0, 0, 0, []::VARCHAR[]), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []), (0, 1, 2, ['user:']), (1, 1, 2, ['user:']), (2, 1, 3, ['assistant:']), (3, 1, 2, ['user:']),
 (0, 2, 3, ['user:', 'assistant:']), (1, 2, 3, ['user:', 'assistant:'])),
best AS (SELECT conv_id, n, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS turns FROM n
 UNION ALL SELECT conv_id, n, i, q, min(cost), first(audit ORDER BY cost, audit), first(turns ORDER BY cost, audit) FROM (
  SELECT b.conv_id, b.n, f.i, CASE e WHEN 'D' THEN ins.q WHEN 'K' THEN CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE ins.q WHEN 2 THEN 3 ELSE 2 END END AS q,
   b.cost + 3 * k + CASE e WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN e <> 'D' AND fault = 3 THEN 3 ELSE 0 END AS cost, b.audit || repeat('I', k) || e AS audit,
   b.turns || added || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE ins.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END AS turns
  FROM best b JOIN f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = b.i + 1 JOIN ins ON ins.p = b.q CROSS JOIN (VALUES ('K'), ('R'), ('D')) e(e)
  WHERE e = 'D' OR fault IN (0, 3) AND (CASE e WHEN 'K' THEN r = CASE ins.q WHEN 2 THEN 'a' ELSE 'u' END OR r = 's' AND ins.q = 0 ELSE r <> CASE ins.q WHEN 2 THEN 'a' ELSE 'u' END END)) GROUP BY conv_id, n, i, q),
ends AS (SELECT conv_id, min(cost + 3 * k) AS cost, first(audit || repeat('I', k) ORDER BY cost + 3 * k, audit || repeat('I', k)) AS audit, first(turns || added ORDER BY cost + 3 * k, audit || repeat('I', k)) AS turns
 FROM best JOIN ins ON ins.p = best.q WHERE i = n AND (ins.q = 3 OR ins.q = 0) GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN ends ON a.conv_id IS NOT DISTINCT FROM ends.conv_id"""

_OP12 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT doc_id, line, pos, least IS NOT NULL AND doc_id <> least AS gone FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

_OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(len(w) - m + 1), lambda i: array_to_string(list_slice(w, i + 1, i + m), ' '))) AS g FROM w, range(1, 5) m(m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, g, m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, g, string_split(g, ' ') AS w, m, f AS a FROM f WHERE m > 1),
k AS MATERIALIZED (SELECT lang, g, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, range(1, 4) k(k) WHERE k < m),
e AS (SELECT k.lang, k.g, a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score FROM k JOIN f x ON x.lang = k.lang AND x.g = k.x JOIN f y ON y.lang = k.lang AND y.g = k.y),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
s AS (SELECT lang, a AS f, unnest(list_transform(range(c.m - n + 1), lambda i: array_to_string(list_slice(w, i + 1, i + n), ' '))) AS g FROM c, range(2, 4) n(n) WHERE n < c.m),
gone AS (SELECT lang, g, max(f) AS f FROM s GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank
 FROM b LEFT JOIN gone ON gone.lang = b.lang AND gone.g = b.g WHERE gone.f IS NULL OR 100::HUGEINT * gone.f < 80::HUGEINT * a),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang)
SELECT o.lang, rank, g AS phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""


QUERIES = {f.__name__: f for f in (op1_preferences, op2_license_scan, op3_media, op4_byte_bpe, op5_near_duplicates, op6_token_planes, op7_simhash, op8_packing, op9_toxicity, op10_language, op11_conversation_repair, op12_line_dedup, op13_phrases)}
ORACLES = {"op1_preferences": _op1_sql, "op2_license_scan": _op2_sql, "op11_conversation_repair": lambda: _OP11, "op12_line_dedup": lambda: _OP12, "op13_phrases": lambda: _OP13}


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in ORACLES.items()}
