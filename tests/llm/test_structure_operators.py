"""Conversation repair, line dedup, phrases: brute force, odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from neurospan.llm import convrepair, linededup, phrases

CONV = "conv_id long, turn long, role string, text string, cost int, audit string, copies long, fault int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2, 3) for r in rows], CONV)


def best_edits(rows):
    """Least (cost, audit) by trying all edits, and the repaired turns; rows: (role, text, fault)."""
    after = {"s": 1, "u": 2, "a": 3}
    want = {0: "u", 1: "u", 2: "a", 3: "u"}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def go(i, q, inserted):
        found = []
        if i == len(rows) and q in (0, 3):
            found.append((0, "", ()))
        if inserted < 2:
            c, s, t = go(i, after[want[q]], inserted + 1)
            found.append((c + 3, "I" + s, ((names[want[q]], ""), *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, s, t = go(i + 1, q, 0)
            found.append((c + 4, "D" + s, t))
            if fault in (0, 3):
                more = 3 if fault else 0
                first = role[:1]
                if first == want[q] or first == "s" and q == 0:
                    c, s, t = go(i + 1, after[first], 0)
                    found.append((c + more, "K" + s, ((role, text), *t)))
                c, s, t = go(i + 1, after[want[q]], 0)
                found.append((c + more + 3, "R" + s, ((names[want[q]], text), *t)))
        return min(found, default=(1 << 60, "", ()))

    return go(0, 0, 0)


def expected(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, told, n = set(), [], Counter()
        for _, r, x in own:
            bare = x.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not bare else 2 if (r, x) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((r, x))
            n[fault] += 1
            told.append((r, x, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, turns = best_edits(tuple(told))
        numbers = {t for t, _, _ in own if t is not None}
        gap = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[c] = (gap, n[1], n[2], n[3], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest())
    return out


def results(df):
    found, planned = convrepair.repair(df)
    digests = {r.conv_id: r.repaired_sha256 for r in convrepair.apply_plans(found, planned, digest=True).collect()}
    lacking = {r.conv_id: r.gaps for r in convrepair.gaps(df).collect()}
    turns = defaultdict(list)
    for r in convrepair.apply_plans(found, planned).orderBy("conv_id", "place").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    out = {r.conv_id: (lacking[r.conv_id], r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[r.conv_id]) for r in planned.collect()}
    assert {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in out} == digests
    return out


def test_repair_matches_brute_force(spark, monkeypatch):
    r = random.Random(2)
    rows = []
    for c in range(120):
        for _ in range(r.randrange(1, 9)):
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "u", None])
            rows.append((c if c else None, r.choice([None, *range(6)]), role, r.choice(["yes.", "no", "", " \t\n", "why?\n", None, "go on!", "é"])))
    rows += rows[:20]
    for stretch in (convrepair.STRETCH, 2):
        monkeypatch.setattr(convrepair, "STRETCH", stretch)
        assert results(conversations(spark, rows)) == expected(rows)
    assert results(conversations(spark, [])) == {}


def test_stretches_join_to_the_whole():
    r = random.Random(3)
    for n in (1, 5, 40, 300):
        codes = [(r.choice("suat"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        whole = list(convrepair.search(codes, convrepair.START, True).values())[0]
        tables = convrepair.Tables()
        for a in range(0, n, 7):
            tables.add(convrepair.table_of(codes[a : a + 7]))
        assert tables.best() == whole


def test_repair_of_a_long_conversation(spark):
    n = 3000
    rows = [(1, i, "user" if i % 2 == 0 or i % 100 == 1 else "assistant", f"turn {i}.") for i in range(n)] + [(2, 0, "user", "x" * 300_000)]
    got = results(conversations(spark, rows))
    cost, audit = list(convrepair.search([(r[2][0], 0) for r in rows[:-1]], convrepair.START, True).values())[0]
    assert got[1][5:7] == (cost, audit) and got[2][5:7] == (4, "D")


def test_damage_follows_the_hash(spark):
    rows = [(c, t, r.choice(["user", "assistant"]), f"What? {t}. No!") for r in [random.Random(5)] for c in [*range(40), None] for t in [None, *range(5)]]
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want[c, t, "user" if kind == 4 else role, text] += {0: 0, 3: 2}.get(kind, 1)
    assert Counter(tuple(r) for r in convrepair.damage(conversations(spark, rows)).collect()) == +want


DOCS = "doc_id long, text string, lang string, pos int, t1 long, key string, lines int, n long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, "clash", 3, 4) for i, t, lang in rows], DOCS)


def dedup(rows, chars=10, least=2):
    fold = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            holders[fold(x)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(fold(x)) < chars or len(holders[fold(x)]) < least or i == min(holders[fold(x)], key=lambda h: (h is None, h or 0))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


@pytest.mark.parametrize("share", [linededup.SHARE, 3])
def test_line_dedup_matches_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(linededup, "SHARE", share)
    r = random.Random(6)
    pool = ["Common header line", "  COMMON HEADER line\r", "short", "", "\t", "é" * 9, "é" * 10, "É" * 10, "exactly10c", "a line of its own \x85", "\x0b\x0cexactly10C", "x" * 50_000, "same same same"]
    rows = [(r.choice([None, *range(60)]), r.choice([None, "", "\n\n", "\n".join(r.choice(pool) for _ in range(r.randrange(12)))]), None) for _ in range(150)]
    rows += rows[:30] + [(None, "Common header line\nsame same same", None), (-5, "same same same\nsame same same", None)]
    got = Counter((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in linededup.dedup_lines(documents(spark, rows)).collect())
    assert got == dedup(rows)
    got = Counter((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in linededup.dedup_lines(documents(spark, rows), least_chars=3, least_documents=4).collect())
    assert got == dedup(rows, 3, 4)
    assert linededup.dedup_lines(documents(spark, [])).count() == 0
    assert linededup.dedup_lines(documents(spark, [(1, None, None), (2, None, None)])).select("text").distinct().collect()[0].text == ""


def mined(rows, least, top):
    words, counts = Counter(), defaultdict(Counter)
    for _, t, lang in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        c = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        rows_ = []
        for p, a in c.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in c.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, x, y, words[lang], -s) for n, (s, a, p, x, y) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [phrases.CELLS, (1 << 4, 1 << 5)])  # few counters bound nothing, and nothing is lost
def test_phrases_match_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(phrases, "CELLS", cells)
    monkeypatch.setattr(phrases, "SHARD", 3000)
    r = random.Random(7)
    pool = ["the", "The", "mit", "license", "a\x00b", "é", "日本", " ", "of", "x" * 40]
    text = lambda: "".join(r.choice(pool) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\r", ", ", " ; "]) for _ in range(r.randrange(60)))
    rows = [(i, r.choice([None, "", text(), "the mit license of the mit license " * r.randrange(9), "a a a a a a"]), r.choice(["en", "en", None, "und", "日"])) for i in range(400)]
    rows += rows[:40] + [(1, "long words " * 20_000, "en"), (2, "The mit license, and the mit license. " * 2_000, "en"), (3, "!" * 9_000, "en")]
    df = documents(spark, rows)
    got = sorted(tuple(x) for x in phrases.collocations(df, top=50).collect())
    assert got == mined(rows, 30, 50)
    if cells == phrases.CELLS:
        assert sorted(tuple(x) for x in phrases.collocations(df, least=300, top=50).collect()) == mined(rows, 300, 50)
        assert phrases.collocations(documents(spark, [])).count() == 0
        assert phrases.collocations(documents(spark, [(1, None, None), (2, " ", "x"), (3, "one two", "x")])).count() == 0


def test_scores_are_exact(spark):
    big = 1 << 61
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 3), ("en", "", 0, big)], "lang string, phrase string, words int, f long")
    row = phrases.scored(counts).collect()[0]
    assert row.score == 2_000_000 * big // (2 * big + 4) and phrases.uncontained(phrases.scored(counts).withColumn("x", F.lit(1)).drop("x")).count() == 1


def test_long_tokens_and_rows_of_letters_stay_linear():
    import time
    import tracemalloc

    import numpy as np

    from neurospan.llm import toxicity as t

    r = random.Random(1)
    tri = np.log(np.random.default_rng(0).dirichlet(np.ones(t.SIDE), (t.SIDE, t.SIDE)))
    s = t.Scorer(t.Model(-3.0, {b"wretch": 3.0}, {4: {b"wret": 1.0}}, tri))
    took = []
    for n in (20_000, 80_000):
        texts = ["".join(r.choice("abcdefghij0123456789") for _ in range(n)), " ".join(r.choice("abcdefghijklmnop") for _ in range(n // 4))]
        a = time.time()
        for x in texts:
            s.score(x)
        took.append(time.time() - a)
    assert took[1] < 10 * took[0] + 1  # by the square it would be 16 times
    tracemalloc.start()
    s.score(" ".join(r.choice("abcdefgh") for _ in range(20_000)))
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()
    assert b"wretch" in s.words_of("x " + "w" + " " * 40 + "r e t c h")  # any number of blanks between letters


def test_readings_match_enumeration():
    """Every way to cut a row of letters into words, priced word by word."""
    import numpy as np

    from neurospan.llm import toxicity as t

    r = random.Random(9)
    tri = np.log(np.random.default_rng(3).dirichlet(np.full(t.SIDE, 0.1), (t.SIDE, t.SIDE)) + 1e-6)

    def price(token):
        cells = {(0, 0): (0.0, "", "")}
        for c in token:
            cells = t._step(cells, c, tri)
        return t._end(cells, tri)

    for _ in range(40):
        row = [r.choice("abcd3") for _ in range(r.randrange(2, 9))]
        best = [0.0]
        for j in range(1, len(row) + 1):
            best.append(min(best[i] + price(row[i:j])[0] for i in range(j)))
        want = set()
        for i in range(len(row)):
            for j in range(i + 2, len(row) + 1):
                if best[i] + price(row[i:j])[0] <= best[j] + t.BEAM:
                    want |= {price(row[i:j])[1]} | ({"".join(row[i:j])} if "".join(row[i:j]).isalpha() else set())
        got = set(t.readings(row, tri))
        assert got <= want  # an open word can only be given up when it is beyond the beam
        assert price(row)[1] in got or best[-1] + t.BEAM < price(row)[0]
        assert set(t.readings(row, tri, lambda b: True)) == got


def test_preferences_beside_clashing_columns_and_repeats(spark):
    from neurospan.llm import chat

    rows = [(1, s, t, "user" if t % 2 == 0 else "assistant", f"{t}" if t < 3 else f"{s}{t}" * 3) for s in ("chosen", "rejected") for t in range(5)]
    rows += [(2, s, 0, None, None) for s in ("chosen", "chosen", "rejected", "rejected")] + [(3, "chosen", 0, "user", "x" * 400_000), (None, "chosen", 0, "user", "n")]
    df = spark.createDataFrame([(*r, 9, 9, 9, "z", 9) for r in rows], "pair long, side string, turn long, role string, text string, cut long, block long, base long, part string, own long")
    got = sorted((r.pair, r.part, r.turn, r.start, r.length, r.learned) for r in chat.format_preferences(df).collect())
    want = sorted(tuple(r) for r in chat.format_preferences(df.select("pair", "side", "turn", "role", "text")).select("pair", "part", "turn", "start", "length", "learned").collect())
    assert got == want and [g[1] for g in got if g[0] == 1] == ["chosen"] * 2 + ["prompt"] * 3 + ["rejected"] * 2
    assert sum(g[0] == 2 for g in got) == 2 and all(g[1] == "prompt" for g in got if g[0] == 2) and [g[1] for g in got if g[0] == 3] == ["chosen"]
    assert chat.format_preferences(df.limit(0)).count() == 0


def test_language_fit_counts_rows_of_an_id_once(spark):
    import numpy as np

    from neurospan.llm import langid

    rows = [(i, f"{'der die das und' if i % 2 else 'the of and to'} {i} " * 5, "de" if i % 2 else "en", "z", 1, 2) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:9] * 3 + [(None, "x", "de", "z", 1, 2), (77, None, "de", "z", 1, 2), (78, "q" * 200_000, "en", "z", 1, 2)], "doc_id long, text string, lang string, id string, n long, h long")
    m = langid.fit(df)
    own = [(r[2], r[1]) for r in rows] + [("en", "q" * 200_000)]
    want = langid.train(own)
    assert m.languages == want.languages and np.allclose(m.log, want.log)
    assert langid.fit(df.limit(0)).languages == ["und"]


def test_language_fusion_recomputed(spark):
    """Every row's posterior from text, declaration and host, beside clashing columns, repeated rows, nulls and a long page."""
    import numpy as np

    from neurospan.llm import langid

    r = random.Random(12)
    words = {"de": "der die das und ist nicht", "en": "the of and to in is", "fr": "le la les et est pas"}
    text = lambda lang: " ".join(r.choice(words[lang].split()) for _ in range(r.randrange(1, 9)))
    model = langid.train([(k, v) for k, v in words.items()])
    pages = []
    for i in range(60):
        lang = r.choice(list(words))
        said = r.choice([None, lang, lang.upper(), "en", "xx-YY"])
        body = r.choice([None, "", "<p></p>", f"<p>{text(lang)}</p>", f"<script>{text('en')}</script>{text(lang)}"])
        html = body if said is None or body is None else f'<html lang="{said}">{body}</html>'
        pages.append((i if i % 9 else None, r.choice([None, "", f"http://{r.choice('ab')}.{r.choice(['site', 'shop'])}.{lang}/x", f"https://u@h.{lang}:80?q"]), html))
    pages += pages[:7] + [(99, "http://a.site.de/", "<b>" + "und die " * 60_000)]
    df = spark.createDataFrame([(*p, "c", 1.0, 2, "d", "e") for p in pages], "page_id long, url string, html string, host string, p double, n int, declared string, domain string")
    got = sorted(((q.page_id is not None, q.page_id or 0, q.host or "", q.declared or "", q.n, q.lang, round(q.confidence, 6)) for q in langid.identify(df, model, "page_id", "html", url=F.col("url"), markup=True).collect()))
    rows_ = []
    for i, url, html in pages:
        n, logs = model.evidence(langid.visible(html or ""))
        m = re.match(r"(?:[a-z]+:)?//(?:[^/@]*@)?([^/:?#]+)", url or "")
        host = m and m[1]
        p = np.exp(logs) / np.exp(logs).sum() if n else np.zeros(3)
        rows_.append((i, host, host and ".".join(host.split(".")[-2:]), host and host.split(".")[-1], langid.declared_language(html or ""), n, logs, p))
    top = sum(q[7] for q in rows_) + langid.SMOOTH
    top /= top.sum()
    down = lambda c, q, k: (c + k * q) / (c.sum() + k)
    add = lambda keep: sum((q[7] for q in rows_ if keep(q)), np.zeros(3))
    want = []
    for i, host, domain, suffix, said, n, logs, p in rows_:
        prior = top
        if host:
            s = down(add(lambda q: q[3] == suffix and q[1]), top, langid.STRENGTH["suffix"])
            d = down(add(lambda q: q[2] == domain), s, langid.STRENGTH["domain"])
            prior = down(np.maximum(add(lambda q: q[1] == host) - p, 0), d, langid.STRENGTH["host"])
        z = logs + np.log(prior)
        if said:
            z = z + np.log(down(np.maximum(add(lambda q: q[4] == said) - p, 0), top, langid.SMOOTH * 3) / top)
        post = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        want.append((i is not None, i or 0, host or "", said or "", n, model.languages[int(post.argmax())], round(float(post.max()), 6)))
    assert got == sorted(want)


def test_cosine_hash_recomputed(spark):
    """The hash of a stored image by plain sums over its payload, row by row."""
    from math import cos, pi

    from neurospan.llm import media

    def plain(payload):
        w, h = media.WIDTH, len(payload) // media.WIDTH
        span = lambda i, n: (min(i * n // 32, n - 1), max(min(i * n // 32, n - 1) + 1, (i + 1) * n // 32))
        cell = [[0] * 32 for _ in range(32)]
        for i in range(32):
            for j in range(32):
                (a, b), (c, d) = span(i, h), span(j, w)
                cell[i][j] = sum(payload[y * w + x] for y in range(a, b) for x in range(c, d)) * 16 // ((b - a) * (d - c))
        wave = [[round(cos(pi * u * (2 * x + 1) / 64) * 4096) for x in range(32)] for u in range(8)]
        coef = [sum(wave[u][i] * cell[i][j] * wave[v][j] for i in range(32) for j in range(32)) for u in range(8) for v in range(8)]
        middle = sorted(coef[1:])[31]
        bits = "".join("1" if c > middle else "0" for c in coef)
        return int(bits, 2).to_bytes(8, "big")

    texts = ["", "a", "abc " * 500, "é" * 3000, "".join(chr(33 + k % 90) for k in range(20_000)), "\x00\uffff" * 70]
    df = spark.createDataFrame([*enumerate(texts), (None, None), (2, texts[2])], "doc_id long, text string")
    got = media.read_media(media.write_media(df)).collect()
    want = {hashlib.sha256(p).hexdigest(): plain(p) for t in texts for p in [media.payload_of(t)[1]]}
    assert len(got) == 8 and all(bytes(q.hash) == want[q.payload_sha256] for q in got)
    assert media.write_media(df.limit(0)).count() == 0
