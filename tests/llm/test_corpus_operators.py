"""Near-duplicates, SimHash, chat formatting, language ID and the pipeline, against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from neurospan.llm import chat, langid, neardup, simhash


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(n, seed):
    """Texts with exact copies, copies of copies, chains of small edits and shared passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    passage = [word() for _ in range(25)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(r.randrange(1, 120))]
        if r.random() < 0.3:
            base = base[:20] + passage + base[20:]
        for _ in range(r.choice([1, 1, 1, 2, 8])):
            out.append(" ".join(base))
            if r.random() < 0.7:
                base = list(base)
                base[r.randrange(len(base))] = word()
    return out[:n]


@pytest.mark.parametrize("small", [32, 2])
def test_near_duplicates_match_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    texts = copies(220, small) + ["", None, "one", "One", "  ", "A B c d", "a b C d"]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, label int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in neardup.near_duplicates(df.limit(20)).collect())


def test_hub_of_many_edited_copies(spark):
    """Copies that resemble their source but not each other, the source not having the least id."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        w[r.randrange(6, 54)] = f"new{i}"
        w[r.randrange(6, 54)] = f"more{i}"
        rows.append((i, " ".join(w)))
    rows.append((500, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()} == components(rows)


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, True), (1, 1, True), (1, 1, True), (None, None, True)], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    r = np.random.default_rng(0)
    for j in (0.2, 0.5, 0.8):
        hits = []
        for _ in range(60):
            n = 300
            k = int(2 * n * j / (1 + j))
            u = r.integers(0, 2**63, 2 * n - k).astype(np.uint64)
            s = neardup.sketch(np.concatenate([u[:n], u[n - k :]]), np.array([0, n, 2 * n]), 128)
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - j) < 0.03
    one = neardup.sketch(np.array([7], np.uint64), np.array([0, 1]), 128)
    assert (one != np.iinfo(np.uint64).max).all()


def simhash_of(spark, text):
    return simhash.fingerprints(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).first().fingerprint


def edited_brute(spark, rows):
    """(id, n_chars, sha, fingerprint, edited_fingerprint, next_fingerprint) of (id, text) rows, sorted."""
    keyed = spark.createDataFrame([(k, i, t or "") for k, (i, t) in enumerate(rows)], "k int, i long, t string").selectExpr("k", "i", "t", "xxhash64(t) AS p").collect()
    order = sorted(keyed, key=lambda r: (r.i is not None, r.i or 0, r.p))
    texts = [(r.i, r.t) for r in order]
    edited = [t[: len(t) - len(t) // 4] + texts[(k + 1) % len(texts)][1][: len(t) // 4] for k, (_, t) in enumerate(texts)]
    both = [t for _, t in texts] + edited
    prints = dict(tuple(r) for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(both)), "k int, text string"), ["k"]).collect())
    n = len(texts)
    return sorted(((i, len(t), hashlib.sha256(edited[k].encode()).hexdigest(), prints[k], prints[n + k], prints[(k + 1) % n]) for k, (i, t) in enumerate(texts)), key=str)


def test_edited_texts(spark):
    """Null and repeated ids, repeated rows, null, empty and long texts: every row has its result."""
    rows = [(5, "the quick brown fox jumps over the lazy dog"), (70000, "é" * 10), (70001, None), (9_000_000_000, "the last one of all these texts"), (12, "ab"), (None, "x y z w"), (None, "other words here")]
    rows += [(12, "another text of twelve")] + 3 * [(13, "one and the same row, three times over")] + 2 * [(None, "null ids, like rows")] + [(-4, "word " * 20000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, kind int")
    got = sorted((tuple(r) for r in simhash.edited_fingerprints(df).collect()), key=str)
    assert got == edited_brute(spark, rows)
    assert simhash.edited_fingerprints(df.limit(0)).count() == 0
    alone = simhash.edited_fingerprints(df.where("doc_id = 5")).first()
    assert alone.next_fingerprint == alone.fingerprint


def test_successors_match_sorting(spark):
    r = random.Random(2)
    ids = sorted({r.randrange(-(1 << 40), 1 << 40) for _ in range(200)} | set(range(300, 500)))
    classes = spark.createDataFrame([(i, True, p, 3) for i in ids for p in (1, 2)], "o long, z boolean, p long, n int")
    got = {(r.o, r.p): (r.next.o, r.next.p) for r in simhash.successors(classes).collect()}
    want = [(i, p) for i in ids for p in (1, 2)]
    assert got == dict(zip(want, want[1:] + want[:1]))


@pytest.mark.parametrize("radius,blocks", [(1, 3), (3, 6)])
def test_neighbours_match_brute_force(spark, radius, blocks):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (2**64 - 1) for b in base for _ in range(6)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = sorted(tuple(x) for x in simhash.neighbours(df, df, radius, blocks).collect())
    assert got == sorted((a, b) for a in signed for b in signed if bin((a ^ b) & (2**64 - 1)).count("1") <= radius)


def test_simhash_weights(spark):
    assert simhash_of(spark, "") == 0 and simhash_of(spark, "...") == 0 and simhash_of(spark, "one") != 0
    assert simhash_of(spark, "a b c " * 3) == simhash_of(spark, "A, b. c\n" * 3)


def _preferences(chosen, rejected):
    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1
    text = lambda rows: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in rows)
    spans = []
    for side in (chosen, rejected):
        at, own = 0, []
        for r, t in side[k:]:
            n = len(text([(r, t)]))
            if r == "assistant":
                own.append((at, at + n))
            at += n
        spans.append(own)
    return text(chosen[:k]), text(chosen[k:]), text(rejected[k:]), *spans


def test_preference_pairs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    r = random.Random(9)
    rows, want = [], {}
    for pair in range(60):
        turn = lambda: (r.choice(["user", "assistant", "system"]), r.choice(["", "a", "bé", "c d"]))
        chosen = [turn() for _ in range(r.randrange(1, 8))]
        rejected = chosen[: r.randrange(len(chosen) + 1)] + [turn() for _ in range(r.randrange(3))]
        rows += [(pair, s, k, *t) for s, side in (("chosen", chosen), ("rejected", rejected)) for k, t in enumerate(side)]
        want[pair] = _preferences(chosen, rejected)
    df = spark.createDataFrame(rows, "pair long, side string, turn long, role string, text string")
    got = {x.pair: (x.prompt, x.chosen, x.rejected, [tuple(s) for s in x.chosen_spans], [tuple(s) for s in x.rejected_spans]) for x in chat.render(chat.format_preferences(df)).collect()}
    assert got == {k: tuple(v) for k, v in want.items()}


def test_preferences_with_nulls(spark):
    df = spark.createDataFrame([(1, "chosen", 0, None, None), (1, "rejected", 0, None, None), (1, "chosen", 1, "assistant", None), (1, "rejected", 1, "assistant", "")], "pair long, side string, turn long, role string, text string")
    got = {(r.part, r.turn) for r in chat.format_preferences(df).collect()}
    assert got == {("prompt", 0), ("chosen", 1), ("rejected", 1)}
    conv = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "abcd"), (None, 0, "user", "x"), (2, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    got = sorted((r.pair, r.part, r.turn) for r in chat.format_preferences(chat.pairs_from(conv)).collect())
    assert got == [(1, "chosen", 1), (1, "prompt", 0), (1, "rejected", 1), (2, "prompt", 0)]
    assert chat.format_preferences(chat.pairs_from(conv.limit(0))).count() == 0


WORDS = {"en": ["the", "house", "with", "water", "thing"], "fr": ["le", "maison", "avec", "eau", "très"], "de": ["das", "haus", "mit", "wasser", "ding"]}


def _docs(spark, n=60):
    r, rows = random.Random(3), []
    for i in range(n):
        lang = "en fr de".split()[i % 3]
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(30)), lang, f"src{i % 4}", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_language_of_pages(spark):
    model = langid.fit(_docs(spark))
    assert model.languages == ["de", "en", "fr"]
    page = lambda lang, text: f"<html lang='{lang}'><head><script>the the</script></head><body><p>{text}</p></body></html>"
    rows = [(k, f"http://h{k % 5}.example.{'de' if k % 3 == 0 else 'com'}/x", page("de" if k % 3 == 0 else "en", " ".join(WORDS["de" if k % 3 == 0 else "en"] * 3))) for k in range(60)]
    rows += [(100, "http://h0.example.de/", "<p></p>"), (101, None, None), (102, "no address", page("fr", "le maison avec eau"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(df, model, "page_id", "html", url=F.col("url"), markup=True).collect()}
    assert len(got) == 63 and all(got[k].lang == ("de" if k % 3 == 0 else "en") for k in range(60))
    assert got[100].lang == "de" and got[100].n == 0 and got[101].lang in model.languages and got[102].lang == "fr"
    assert all(0 < r.confidence <= 1 for r in got.values())
    assert langid.identify(df.limit(0), model, "page_id", "html", url=F.col("url"), markup=True).count() == 0
    assert langid.fit(_docs(spark).limit(0)).languages == ["und"]


def test_host_priors_match_brute_force(spark):
    """The prior of a row without text is its host's, smoothed by domain, suffix and all rows."""
    rows = [(0, None, "a.x.de", "x.de", "de", 5, [0.0, -9.0]), (1, None, "a.x.de", "x.de", "de", 5, [-1.0, 0.0]), (2, None, "b.x.de", "x.de", "de", 5, [-2.0, 0.0]), (3, None, "c.y.fr", "y.fr", "fr", 5, [0.0, -3.0]), (4, None, "a.x.de", "x.de", "de", 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, declared string, host string, domain string, suffix string, n long, logs array<double>")
    got = {r.id: list(r.posterior) for r in langid.fuse(df, ["p", "q"]).collect()}
    soft = lambda v: np.exp(np.array(v) - max(v)) / np.exp(np.array(v) - max(v)).sum()
    p = {r[0]: soft(r[6]) if r[5] else np.zeros(2) for r in rows}
    total = sum(p.values()) + langid.SMOOTH
    top = total / total.sum()
    add = lambda keep: sum((p[r[0]] for r in rows if keep(r)), np.zeros(2))
    down = lambda c, q, k: (c + k * q) / (c.sum() + k)
    suffix = down(add(lambda r: r[4] == "de"), top, langid.STRENGTH["suffix"])
    domain = down(add(lambda r: r[3] == "x.de"), suffix, langid.STRENGTH["domain"])
    host = down(add(lambda r: r[2] == "a.x.de"), domain, langid.STRENGTH["host"])
    assert np.allclose(got[4], host / host.sum())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = [tuple(r) for r in _docs(spark, 90).collect()]
    rows += [(200 + k, rows[k][1], rows[k][2], "src0", 0) for k in range(5)] + [(300, None, None, None, None), (301, "", "en", "src1", 0)]
    rows += [(400 + k, f"the house wretch with {k} stinkhead water thing " * 3, "en", "src1", 0) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 400)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, rows


def test_pipeline_stages(spark, corpus):
    sf, rows = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit(1))
    names, seen = [], {}
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        docs = stage(spark, docs, sf)
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert names == ["toxicity", "language", "near_duplicates", "packing"]
    every = {r[0] for r in rows}
    assert seen["toxicity"] == {i for i in every if i < 400}
    assert seen["language"] == seen["toxicity"] - {300, 301}
    left = [(i, t) for i, t, *_ in rows if i in seen["language"]]
    assert seen["near_duplicates"] == {i for i, (_, c) in components(left).items() if i == c} == seen["packing"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == seen["packing"]


def test_pipeline_of_an_empty_corpus(spark, corpus):
    sf, _ = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found if n.startswith("op")) == list(range(1, 14)) and "pipeline" in found
    by = defaultdict(list)
    for n in found:
        by[n].append(n)
    assert set(entry.oracle_sql()) <= set(by)


def test_language_fit_keeps_every_language(spark, monkeypatch):
    """More than 64 languages, and one long text that would end a fit over all of them."""
    rows = [(100 * k + i, f"q{chr(97 + k % 26)}{chr(97 + k // 26)}x word " * (400 if k == 3 else 5), f"l{k:02d}") for k in range(70) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.train([(lang, t) for _, t, lang in rows])
    got = langid.fit(docs)
    assert got.languages == whole.languages and len(got.languages) == 70 and np.array_equal(got.log, whole.log)
    monkeypatch.setattr(langid, "FIT_CHARS", 30)
    bounded = langid.fit(docs)
    once = langid.train(sorted({(lang, t) for _, t, lang in rows}))  # the first row of each is longer than 30
    assert bounded.languages == whole.languages and np.array_equal(bounded.log, once.log)
