"""Ways up by doubling, versions and ranges, audits of logs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from neurospan.operators import audit, graph, versions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def counted_tables(monkeypatch):
    n = [0]
    real = graph.settle

    def settle(df):
        n[0] += 1
        return real(df)

    monkeypatch.setattr(graph, "settle", settle)
    return n


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = counted_tables(monkeypatch)
    e = spark.range(1, 1000).selectExpr("id AS node", "id - 1 AS parent")
    got = graph.ancestors(e, spark.createDataFrame([(999,), (3,)], "node long"))
    assert n[0] <= 2 + 2 * 10 and rows(got) == sorted([(999, k, 999 - k) for k in range(1000)] + [(3, k, 3 - k) for k in range(4)])
    n[0] = 0
    c = graph.merge_chains(e.selectExpr("parent AS target", "node AS absorbed")).collect()
    assert n[0] <= 12 and all(list(r.chain) == list(range(r.body, -1, -1)) and (r.owner, r.merge_count) == (0, r.body) for r in c) and len(c) == 999
    t = graph.subtree_sums(spark.range(1000).selectExpr("id AS node", "1L AS value"), e).collect()
    assert {r.node: r.total for r in t} == {k: 1000 - k for k in range(1000)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ways_up_match_brute_force(spark, seed):
    r = random.Random(seed)
    edges = sorted({(a, b) for _ in range(45) for a, b in [(r.randrange(30), r.randrange(30))]})  # cycles and several parents
    up = defaultdict(set)
    for a, b in edges:
        up[a].add(b)
    want = []
    for s in range(0, 30, 3):
        depth, rim = {s: 0}, {s}
        while rim:
            rim = {q for p in rim for q in up[p]} - set(depth)
            depth |= dict.fromkeys(rim, 1 + max(depth.values()))
        want += [(s, k, d) for k, d in depth.items()]
    df = spark.createDataFrame(edges, "node long, parent long")
    assert rows(graph.ancestors(df, spark.createDataFrame([(s,) for s in range(0, 30, 3)] * 2, "node long"))) == sorted(want)
    one = {a: min(b for b in bs if b != a) for a, bs in up.items() if bs - {a}}
    got = {q.body: (q.owner, list(q.chain)) for q in graph.merge_chains(df.selectExpr("parent AS target", "node AS absorbed")).collect()}
    for a in one:
        way = [a]
        while way[-1] in one and one[way[-1]] not in way:
            way.append(one[way[-1]])
        assert got[a] == (way[-1], way)
    assert set(got) == set(one)
    tree = {k: r.randrange(k) for k in range(1, 40) if r.random() < 0.9}
    value = {k: r.randrange(-5, 9) for k in range(50) if k % 4}
    total = {k: value.get(k, 0) for k in {*value, *tree, *tree.values()}}
    for k in sorted(tree, reverse=True):
        total[tree[k]] += total[k]
    t = graph.subtree_sums(spark.createDataFrame(list(value.items()), "node long, value long"), spark.createDataFrame(list(tree.items()), "node long, parent long"))
    assert {q.node: q.total for q in t.collect()} == total


def test_ranges_of_versions(spark):
    """A main branch of 40 nodes and a side branch from its 10th on."""
    nodes = [(f"{k:04x}aa", k, "", True) for k in range(40)] + [(f"{k:04x}bb", k, "side", False) for k in range(40, 50)]
    edges = [(f"{k:04x}aa", f"{k - 1:04x}aa") for k in range(1, 40)] + [("0028bb", "000aaa")] + [(f"{k:04x}bb", f"{k - 1:04x}bb") for k in range(41, 50)]
    n, e = spark.createDataFrame(nodes, "uuid string, version int, branch string, locked boolean"), spark.createDataFrame(edges, "uuid string, parent string")
    main, side = [u for u, *_ in nodes[:40]], [u for u, *_ in nodes[:11]] + [u for u, *_ in nodes[40:]]
    want = {
        "[0003, 0006]": main[3:7], " ( 0003aa , 0006aa ] ": main[4:7], "[root, :side)": side[:-1], "(root,0001)": [], ":side~2": [side[-3]], "0007": [main[7]], "[:side~3, :side]": side[-4:],
        "[0003, 0006": [None], "0003, 0006": [None], "[0003, 0006, 0007]": [None], "[, 0006]": [None], "[(0003, 0006]": [None], "[00 03, 0006]": [None], "": [None], "[zzz, 0006]": [None], "nothing": [None], "[0006, 0003]": [], "[0028, 0027]": [None], "[0003, 0003]": [main[3]],
    }
    got = defaultdict(list)
    for q in versions.resolve_ranges(spark.createDataFrame([(k,) for k in want], "range string"), n, e).orderBy("range", "place").collect():
        got[q.range].append(q.uuid)
    want["[0006, 0003]"] = [None]  # the first isn't above the last
    assert {k: got[k] for k in want} == want
    of = lambda **k: [q.uuid for q in versions.node_branches(spark.createDataFrame([("0005aa",)], "ref string"), n, e, **k).orderBy("place").collect()]
    assert of() == main[:6] and of(with_descendants=True) == main
    sides = versions.node_branches(spark.createDataFrame([("002a",), ("none",)], "ref string"), n, e, with_ancestors=False)
    assert [q.uuid for q in sides.orderBy("place").collect()] == ["0028bb", "0029bb", "002abb"]


def brute_audit(events, statuses, sizes):
    """Event by event, as the log goes."""
    size, merges, cleaves = dict(sizes), [], []
    for seq, version, action, target, merged, cleaved, n in sorted(events):
        of = lambda b: max(((v, s) for v, x, s in statuses if x == b and v < version), default=(0, None), key=lambda t: t[0])[1]  # noqa: B023, E731
        if action == "merge":
            bad = sorted((b, of(b)) for b in set(merged) if of(b) in audit.TRACED)
            if bad:
                merges.append((seq, "merge-traced-to-" + ("" if of(target) in audit.TRACED else "non") + "traced", target, of(target), [b for b, _ in bad], [s for _, s in bad]))
            if target in size:
                size[target] += sum(size.get(b, 0) for b in merged)
        elif action == "cleave":
            if of(target) in audit.TRACED:
                if not size.get(target):
                    cleaves.append((seq, "failed-to-assess", target, 0, 0))
                elif 2 * n > size[target]:
                    cleaves.append((seq, "large-cleave", target, size[target], n))
            if target in size:
                size[target] -= n
            size[cleaved] = n
    return merges, cleaves


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_audit_matches_the_log(spark, seed):
    r = random.Random(seed)
    alive, events, new = list(range(30)), [], 100
    sizes = {b: r.randrange(1, 50) for b in range(28)}  # two aren't known
    of = dict(sizes)
    for seq in range(70):
        target = r.choice(alive)
        if r.random() < 0.4 and len(alive) > 4:
            gone = r.sample([b for b in alive if b != target and b < 28], min(2, len([b for b in alive if b != target and b < 28])))
            if not gone or target >= 28:
                continue
            events.append((seq, seq // 8, "merge", target, gone, None, None))
            of[target] = of.get(target, 0) + sum(of[b] for b in gone)
            alive = [b for b in alive if b not in gone]
        else:
            n = r.randrange(0, max(1, of.get(target, 9)))
            events.append((seq, seq // 8, "cleave", target, None, new, n))
            of[target], of[new] = of.get(target, 0) - n, n
            new += 1
    statuses = sorted({(v, b): (v, b, r.choice([*audit.TRACED, "Anchor", None])) for v in range(-1, 9) for b in r.sample(range(30), 9)}.values(), key=lambda s: s[:2])
    df = spark.createDataFrame(events, "seq long, version int, action string, target long, merged array<long>, cleaved long, cleaved_size long")
    got = audit.audit_traced(df, spark.createDataFrame(statuses, "version int, body long, status string"), spark.createDataFrame(list(sizes.items()), "body long, size long"))
    merges, cleaves = brute_audit(events, statuses, sizes)
    assert [tuple(q) for q in got[0].orderBy("seq").collect()] == merges and [tuple(q) for q in got[1].orderBy("seq").collect()] == cleaves
    assert merges and cleaves
    assert not any(d.count() for d in audit.audit_traced(df.limit(0), spark.createDataFrame([], "version int, body long, status string"), spark.createDataFrame([], "body long, size long")))
    assert audit.statuses_before(df.select("seq", "version", F.col("target").alias("body")), spark.createDataFrame([], "version int, body long, status string")).where("status IS NOT NULL").count() == 0
