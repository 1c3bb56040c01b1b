"""Licenses, media, byte BPE, token planes, packing, toxicity: units and small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from neurospan.llm import bytebpe, licenses, media, packing, planes, toxicity
from neurospan.llm.common import shared_dir

SCHEMA = "doc_id long, text string, id string, label int, n long"
ODD = ["", None, "x", " ", "\n\n", "a\tb  c", "é" * 7, "word " * 3000, "日本 語　z", "a\x00b", "İ. 'S It's", "don't\n\nstop", "<|endoftext|> x", "😀 ‍", "tail ", " head", "á b", "Σ ΑΣ."]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 7, None) for i, t in enumerate(texts)], SCHEMA)


def noise(n, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice("ab é\n\t ' 　\x1c\x85日本語12.!'ts\U0001f600́\x00ΣA<|>,&İ") for _ in range(r.randrange(40))) for _ in range(n)]


def test_byte_bpe_matches_the_library(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    texts = ODD + noise(300)
    df = table(spark, texts)
    ids = {r.doc_id: list(r.ids) for r in bytebpe.encode_texts(df, path, P.PATTERN).collect()}
    assert ids == {i: ref.encode_ordinary(t or "") for i, t in enumerate(texts)}
    enc = bytebpe.encode_texts(df, path, P.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bytebpe.decode_ids(enc, path, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}
    d = {r.doc_id: r for r in bytebpe.decode_ids(enc, path, P.PATTERN, digest=True).collect()}
    assert d[0].n_tokens == 0 and d[0].ids_sha256 == hashlib.sha256(b"").hexdigest() == d[0].decoded_sha256
    assert bytebpe.encode_texts(df.limit(0), path, P.PATTERN).count() == 0


def test_perfect_hash_finds_keys_alone():
    keys = [b"%d" % i for i in range(2000)]
    t = bytebpe.PerfectHash(keys)
    assert sorted(t.find(k) for k in keys) == list(range(2000)) and t.find(b"none") == -1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_coder_matches_the_library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))  # as the file sets it: added tokens in a text get their ids
    r = random.Random(8)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "\n", "a", "haus,", "İ!!", "Kelvin", "Σ,", "é.", "12", "x.", "|>", "<|", "\u212a", "\u037e", "ǅ."]
    texts = [x or "" for x in ODD] + noise(300, 6) + ["".join(r.choice(bits) for _ in range(r.randrange(10))) for _ in range(2000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in planes.hf_ids(texts + texts, P.path(name))]
    assert got == 2 * [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_words_is_bounded():
    from neurospan.llm.common import Memo

    asked = []
    memo = Memo(lambda keys: asked.extend(keys) or [k.encode() for k in keys], most=20_000)
    for i in range(300):
        keys = ["often", *(f"w{i}-{j}" for j in range(20))]
        assert memo.values_of(keys) == [k.encode() for k in keys]
        assert len(memo.young) + len(memo.elder) < 300
    assert asked.count("often") == 1  # what is asked for again and again stays


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_planes_roundtrip(unit):
    r = np.random.default_rng(1)
    for ids in (np.zeros(0), np.array([0]), r.integers(0, 2**32, 1000), r.integers(0, 50000, 77)):
        ids = ids.astype("<u4")
        assert planes.join_planes(planes.split_planes(ids, unit), len(ids), unit).tolist() == ids.tolist()


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_shards(spark, unit, tmp_path):
    texts = ODD + ["the same"] * 40 + ["long " * 5000]
    df = table(spark, texts).repartition(3)
    path = P.path("word_bpe_49k.json")
    manifest = planes.write_ids(df, shared_dir(spark), path, end_id=2, unit=unit, block=128, shards=3)
    got = {r.doc_id: r for r in planes.read_ids(spark, manifest).collect()}
    at = 0
    for i, t in enumerate(texts):
        want = np.frombuffer(planes.hf_ids([t or ""], path)[0], "<u4").tolist() + [2]
        assert (got[i].start, got[i].n_tokens, list(got[i].ids)) == (at, len(want), want)
        at += len(want)
    crc = {r.doc_id: r.ids_crc32 for r in planes.read_ids(spark, manifest, digest=True).collect()}
    assert all(crc[i] == zlib.crc32(np.array(got[i].ids, "<u4").tobytes()) for i in got)
    import pyarrow.fs as pafs

    with pafs.FileSystem.from_uri(manifest[0]["path"])[0].open_input_file(pafs.FileSystem.from_uri(manifest[0]["path"])[1]) as f:
        reader = planes.ShardReader(f)
        whole = np.concatenate([ids for _, _, ids in reader.documents()])
        assert reader.ids(100, 300).tolist() == whole[100:300].tolist() and reader.ids(5, 5).tolist() == []
    assert planes.read_ids(spark, planes.write_ids(df.limit(0), shared_dir(spark), path, 2)).count() == 0


def test_null_ids_in_shards(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c"), (3, None)], "doc_id long, text string")
    got = planes.read_ids(spark, planes.write_ids(df, shared_dir(spark), P.path("word_bpe_49k.json"), 2)).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 1), (False, 2), (False, 2), (True, 3)]


def test_packing_is_whole_and_tight(spark):
    texts = ["w" * k for k in (1, 1, 5)] + ["lorem ipsum dolor " * k for k in range(1, 200, 3)] + ["big text " * 4000, None]
    df = table(spark, texts)
    got = packing.pack_documents(df, P.path("byte_bpe_50k.json"), 0, 256).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    for i, t in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        want = np.concatenate([np.frombuffer(planes.hf_ids([t or ""], P.path("byte_bpe_50k.json"))[0], "<u4"), [0]]).astype("<u4")
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(want)
        assert all(r.length == 256 for r in own[1:]) and [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert all(r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in own)
    assert len(by) <= 1.1 * sum(r.length for r in got) / 256 + 1
    assert packing.pack_documents(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("groups", [4, 64, 128])
def test_plan_places_each_length_once(groups):
    r = np.random.default_rng(2)
    lengths = np.minimum(2048, r.lognormal(6, 1.2, 5000).astype(int) + 1)
    hist = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
    p = packing.plan(hist, 2048, groups)
    room = np.zeros(p.sequences, int)
    for n, count in hist.items():
        for a, (rank, first, copies, _) in enumerate(p.slots[n]):
            end = p.slots[n][a + 1][0] if a + 1 < len(p.slots[n]) else count
            for k in range(end - rank):
                room[first + k // copies] += n
    assert room.min() > 0 and room.max() <= 2048 and room.sum() == lengths.sum()
    assert len(hist) > 128 and (groups < 128 or p.sequences <= 1.01 * lengths.sum() / 2048 + 1)


def fewest(lengths, capacity):
    """Sequences needed at least, by trying all ways."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[k]}.values():
            place(k + 1, [*rooms[:j], rooms[j] - lengths[k], *rooms[j + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_plans_against_the_optimum():
    r = random.Random(11)
    over = 0
    for _ in range(40):
        lengths = sorted((r.randrange(1, 21) for _ in range(9)), reverse=True)
        p = packing.plan({n: lengths.count(n) for n in lengths}, 20)
        over += p.sequences - fewest(lengths, 20)
    assert 0 <= over <= 4


def test_lengths_of_three_sizes_reach_the_linear_bound():
    # 7, 6 and 5 fit 18 together; greedily, 7 + 7 comes first
    p = packing.plan({7: 300, 6: 300, 5: 300}, 18)
    assert p.sequences == 300


def test_png_is_checked():
    r = random.Random(3)
    for n in (64, 640, 6400):
        payload = bytes(r.randrange(256) for _ in range(n))
        for kinds in ((0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)):
            assert media.decode_png(media.encode_png(payload, filters=kinds)).tobytes() == payload
    good = media.encode_png(b"text " * 128)
    for k in range(8, len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(good[:-5])


def test_media_columns(spark):
    texts = ODD + ["same text"] * 2
    got = {r.doc_id: r for r in media.read_media(media.write_media(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert got[len(ODD)].hash == got[len(ODD) + 1].hash and len(got[0].hash) == 8
    assert media.read_media(media.write_media(table(spark, ["x"])).withColumn("media", F.lit(None).cast("binary"))).first().payload_bytes is None


def test_template_automata():
    a = licenses.compile_template("a <<optional>>b <<optional>>c<<end>><<end>> <<var:2>> d <<optional>>e<<end>>")
    want = {"a d": 2, "a b d": 3, "a b c d e": 5, "a c d": 3, "a x y d": 4, "a x y z d": -1, "a b": -1, "a d d": 3, "b d": -1}
    for text, end in want.items():
        assert a.longest(licenses.words_of(text), 0) == end, text
    for bad in ("<<optional>>a", "a<<end>>", "<<what>> a"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad)
    with pytest.raises(ValueError):
        licenses.compile_template("<<var:2>> a").first()


def test_license_scan(spark):
    texts = ["Released under the MIT License. x mit LICENSE", "Licensed under the Apache License, Version 2.0.", "general public-license", "the mitlicense", None, "", "é mit\x00license É"]
    got = [r for r in licenses.scan_licenses(table(spark, texts)).orderBy("doc_id").collect()]
    assert [list(r.places) for r in got] == [[3, 6], [3], [0], [], [], [], [1]]
    assert [[s.label for s in r.spans] for r in got] == [["mit", "mit"], ["apache-2.0"], [], [], [], [], []] or got[0].spans[0].label == "mit"
    assert got[6].n_words == 4


def _toxic_rows(n):
    r, out = random.Random(1), []
    words = [a + b for a in ("ka", "lo", "mi", "ter", "ra") for b in ("no", "sa", "vel", "do", "pin")]
    for i in range(n):
        y = int(i % 5 == 0)
        own = [r.choice(words) for _ in range(r.randrange(5, 60))]
        for _ in range(2 * y):
            own.insert(r.randrange(len(own)), r.choice(["grumblefool", "stinkhead", "wretch"]))
        out.append((i, " ".join(own), y))
    return out


def test_toxicity_learns_and_restores(spark):
    rows = _toxic_rows(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) / len(held) > 0.97
    assert got[9000] == got[9001] < 0.5
    s = toxicity.Scorer(model)
    for clear, hidden in (("wretch", "wr3tch"), ("wretch", "w.r.e.t.c.h"), ("stinkhead", "st1nkh3ad"), ("wretch", "wreeeetch")):
        assert clear.encode() in s.words_of(f"kano {hidden}, losa"), hidden
    assert b"wretch" in s.words_of("kano w r e t c h losa")
    keep = toxicity.keep_clean(docs.withColumn("score", F.lit(1)), model)
    assert keep.columns == ["doc_id", "text", "score"] and {r.doc_id for r in keep.collect()} == {i for i, v in got.items() if v < 0.5}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_texts(docs, toxicity.fit(docs, none)).first().score < 0.5


def test_held_out_rule(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), toxicity.is_held_out("id").alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.collect())


def test_toxicity_restores_spaced_and_doubled_words(spark):
    rows = _toxic_rows(600)
    texts = spark.createDataFrame([(t,) for _, t, _ in rows], "text string")
    model = toxicity.train([(t, y) for _, t, y in rows], toxicity.character_model(texts))
    words = toxicity.Scorer(model).words_of
    for text in ("kano you are a w r e t c h", "I w r e t c h", "y o u w r e t c h", "w r e t c h y o u", "a w r 3 t c h losa", "w\nr\ne\nt\nc\nh", "kano wreetch losa", "wr€tch", "w r € t c h"):
        assert b"wretch" in words(text), text
    assert b"ass" in words("a s s") and b"no" in words("kano n o")
    assert not toxicity.suspicious("kano a losa 1 2 3")


def test_character_model_counts_all_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_WORDS", 3)
    texts = ["Kano losa kano", None, "", "kano x1y wr\u20actch", "kano losa", "kano losa"]
    df = spark.createDataFrame([(t, "clash") for t in texts], "text string, word string").repartition(4)
    got = toxicity.character_model(df)
    counts = np.full((toxicity.SIDE,) * 3, 0.05)
    words = {}
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split():
            words[w] = words.get(w, 0) + 1
    for w, n in words.items():
        code = [0, 0] + [ord(c) - 96 for c in w] + [0]
        for i in range(2, len(code)):
            counts[code[i - 2], code[i - 1], code[i]] += round(1024 * n**0.5) / 1024
    assert np.allclose(got, np.log(counts / counts.sum(axis=2, keepdims=True)))
    assert np.allclose(toxicity.character_model(df.limit(0)), -np.log(toxicity.SIDE))


def test_viterbi_matches_enumeration(spark):
    texts = spark.createDataFrame([(t,) for _, t, _ in _toxic_rows(200)], "text string")
    tri = toxicity.character_model(texts)

    def all_readings(token):
        paths = [("", 0.0)]
        for c in token:
            after = []
            for word, cost in paths:
                code = [0, 0] + [ord(x) - 96 for x in word]
                price = lambda x: -tri[code[-2], code[-1], ord(x) - 96]  # noqa: B023, E731
                if c.isalpha():
                    after.append((word + c, cost + price(c)))
                    if word.endswith(c):
                        after.append((word, cost + 0.5))
                else:
                    after += [(word + x, cost + 1.5 + price(x)) for x in toxicity.LEET.get(c, "")]
                    after.append((word, cost + (0.5 if toxicity.LEET.get(c, c) == "" else 7.0)))
                    if word.endswith(c):
                        after.append((word, cost + 0.5))
            paths = after
        ends = []
        for word, cost in paths:
            code = [0, 0] + [ord(x) - 96 for x in word]
            ends.append((cost - tri[code[-2], code[-1], 0], word))
        return ends

    r = random.Random(4)
    for _ in range(300):
        token = "".join(r.choice("wretch31.-$|") for _ in range(r.randrange(1, 8)))
        ends = all_readings(token)
        word = toxicity.decode(token, tri)
        assert min(c for c, w in ends if w == word) <= min(ends)[0] + 1e-6, token


def test_score_matches_a_recomputation(spark):
    rows = _toxic_rows(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7, "repeated id"), (None, "kano"), (9100, "x" * 300000)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert model.words or model.begins
    got = toxicity.score_texts(docs, model).collect()
    want = []
    for d in docs.collect():
        words = {w.encode() for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in d.text.lower()).split()}
        for token in toxicity.suspicious(d.text):
            words |= {w.encode() for w in model.restored(token).split()}
        z = model.bias + sum(v for w, v in model.words.items() if w in words)
        z += sum(v for k, known in model.begins.items() for w, v in known.items() if any(x[:k] == w and len(x) > k for x in words))
        want.append((d.doc_id, 1 / (1 + np.exp(-z))))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for (a, x), (b, y) in zip(sorted(((g.doc_id, g.score) for g in got), key=key), sorted(want, key=key), strict=True):
        assert a == b and abs(x - y) < 1e-9


def test_whole_license_texts(spark):
    bsd = licenses.TEMPLATES["bsd-full"]
    plain = lambda t, fill, keep: re.sub(r"<<var:\d+>>", fill, re.sub(r"<<optional>>(.*?)<<end>>", r"\1" if keep else "", t))
    cases = [(label, plain(t, fill, keep)) for label, t in licenses.TEMPLATES.items() if label.endswith("-full") for fill in ("", "Holder") for keep in (True, False)]
    texts = ["kano " + t.replace("copyright", "Copyright").replace(" in ", " in, ") + " losa" for _, t in cases] + [plain(bsd, "x", True).replace("disclaimed", "claimed"), "z" * 200000, "", None]
    got = {r.doc_id: {s.label for s in r.spans} for r in licenses.scan_licenses(table(spark, texts)).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(cases))
    assert "bsd-full" not in got[len(cases)] and "bsd-text" in got[len(cases)]
    assert all(not got[len(cases) + k] for k in (1, 2, 3))
    assert licenses.scan_licenses(table(spark, texts).limit(0)).count() == 0
