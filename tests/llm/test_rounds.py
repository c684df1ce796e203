"""Whitening, collocations and sharding against brute force, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdlake.llm import collocations, sharding, whitening
from crowdlake.operators import materialize
from tests.llm.test_operators import DOCS, empty_docs, odd_docs

# ---------------------------------------------------------------- 11


def brute_white(rows, k=8):
    """{id: (deviation, whitened...)} up to sign, and the shares."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    far = n * x - s
    c = far.astype(float) / n
    e, vec = np.linalg.eigh(c.T @ c / n)
    e, vec = e[::-1][:k], vec[:, ::-1][:, :k]
    keep = e > 1e-9 * max(e[0], 1e-300)
    return [int((r * r).sum()) for r in far], (c @ vec / np.sqrt(np.where(keep, e, 1)))[:, keep], (e / np.trace(c.T @ c / n))[keep]


def white(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return whitening.whitened(df, **kw).collect()


@pytest.mark.parametrize("d,n", [(5, 40), (64, 300), (12, 6), (3, 100)])
def test_whitening_equals_an_eigendecomposition(spark, d, n):
    rng = np.random.default_rng(d)
    rows = [(i, [float(x) for x in rng.standard_normal(d) * np.linspace(1, 3, d) + 5]) for i in range(n)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    got = white(spark, rows)
    deviation, want, share = brute_white(rows)
    k = min(8, d, n - 1)
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1))
    table = np.zeros((n, k))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert abs(r.explained - share[r.component - 1]) < 1e-10 and r.identity_error < 1e-8
    signs = np.sign((table * want[:, :k]).sum(axis=0))
    assert np.abs(table * signs - want[:, :k]).max() < 1e-7
    assert np.abs(np.cov(table.T, bias=True).reshape(k, k) - np.eye(k)).max() < 1e-8


def test_whitening_finds_repeated_variances(spark):
    """Corners of a box with three equal sides: one Krylov space alone holds two directions at most."""
    rows = [(i, [s * (2.0 if j == 3 else 1.0) if j == i // 2 else 0.0 for j in range(4)]) for i, s in enumerate([1.0, -1.0] * 4)]
    got = white(spark, rows)
    assert {r.component for r in got} == {1, 2, 3, 4} and max(r.identity_error for r in got) < 1e-8
    shares = {r.component: r.explained for r in got}
    assert np.allclose([shares[c] for c in (1, 2, 3, 4)], [4 / 7, 1 / 7, 1 / 7, 1 / 7], atol=1e-9)


def test_whitening_edge_cases(spark):
    good = [(i, [float(i % 7), float(i % 3)]) for i in range(21)]
    bad = [(50, None), (51, [1.0, None]), (52, [float("nan"), 1.0]), (53, [float("inf"), 1.0]), (54, []), (55, [1.0])]
    got = white(spark, [*good, *bad, (None, [9.0, 9.0]), good[0]])
    assert sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 0 for r in got) == 4
    assert not {50, 51, 52, 53, 54, 55} & {r.vec_id for r in got} and got[0].n == 23
    assert white(spark, []) == [] and white(spark, bad[:1]) == [] and white(spark, [(1, [])]) == []
    assert white(spark, [(i, [1.0, 2.0]) for i in range(5)]) == []  # no variance
    assert {r.component for r in white(spark, [(i, [1.0, float(i)]) for i in range(5)])} == {1}
    huge = white(spark, [(i, [float(i) * 1e9, 0.0]) for i in range(4)])
    assert {r.deviation for r in huge} == {None}  # past 64 bits
    clash = spark.createDataFrame([(i, [float(i), 1.0], 1, 2.0) for i in range(4)], "id long, x array<float>, n int, whitened double")
    assert whitening.whitened(clash, "id", "x").columns == ["id", *whitening.ADDED]


# ---------------------------------------------------------------- 12


def brute_collocations(rows, least, longest=5, first=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {g: c for g, c in counts.items() if c >= least}
        found = []
        for g, a in often.items():
            if len(g) < 2:
                continue
            longer = (h for h in often if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))))
            if any(100 * often[h] >= 100 * a for h in longer):
                continue
            score, k = min((1000 * a * n[lang] // (often[g[:k]] * often[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), often[g[:k]], often[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(spark, rows, **kw):
    return sorted(tuple(r) for r in collocations.mined(spark.createDataFrame(rows, "lang string, text string"), **kw).collect())


def test_collocations_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "b", "c", "Die", "Eé", "x\ty", "日本", "z\x00"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; ", "!?", "\x0b"]
    rows = [
        (rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(0, 60))))
        for _ in range(120)
    ]
    rows += [("en", "of the people by the people"), ("en", "of the people by the people")] * 6
    rows += [("en", None), (None, ""), ("en", ". , ;"), ("en", "x x x x x x x x")]
    for least in (3, 8, 60):
        assert mined(spark, rows, least=least) == brute_collocations(rows, least)
    assert mined(spark, rows, least=3, first=4) == brute_collocations(rows, 3, first=4)
    assert mined(spark, rows, least=3, longest=3) == brute_collocations(rows, 3, longest=3)


def test_collocations_edge_cases(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == [] and mined(spark, [("en", "one two")]) == []
    long = [("en", "go on " * 50000)]
    assert mined(spark, long) == brute_collocations(long, 100)
    odd = odd_docs(spark).withColumnsRenamed({"source": "words", "n_chars": "phrase"})
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in collocations.mined(odd, least=30).collect()) == brute_collocations(rows, 30)


def test_collocations_shuffle_words_once_however_many_there_are(spark, monkeypatch):
    """With more frequent words and phrases than a broadcast may hold, occurrences still go to their document only, and old files go."""
    rng = random.Random(6)
    rows = [(rng.choice(["en", "de"]), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 80)))) for _ in range(60)]
    plans, folder, write = [], materialize._folder(spark).removeprefix("file:"), collocations.materialize_by

    def spied(df, *a):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *a)

    monkeypatch.setattr(collocations, "materialize_by", spied)
    monkeypatch.setattr(collocations, "SMALL", 3)
    tables = lambda: {f for f in os.listdir(folder) if f.startswith("crowdlake_")} if os.path.exists(folder) else set()
    before = tables()
    assert mined(spark, rows, least=3) == brute_collocations(rows, 3)
    assert len(plans) > 2 and tables() <= before
    exchanges = [re.findall(r"hashpartitioning\(([^)]*)", plan) for plan in plans]
    assert {key.split("#")[0] for key in exchanges[0]} == {"doc"} and not any(exchanges[1:])


def test_collocations_are_exact_whatever_numbers_meet_or_pass(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(rng.choice(["en", None]), " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 80)))) for _ in range(60)]
    hashed = collocations._hashed
    monkeypatch.setattr(collocations, "SMALL", 3)
    monkeypatch.setattr(collocations, "_hashed", lambda seed: hashed(seed) if seed > 1 else (F.length("word") % 2 - 7).cast("long"))
    assert mined(spark, rows, least=3) == brute_collocations(rows, 3)
    monkeypatch.setattr(collocations, "_sieve", lambda *a: lambda df: df)
    assert mined(spark, rows, least=3) == brute_collocations(rows, 3)


def test_sieve_keeps_all_and_drops_most(spark):
    phrases = spark.range(20000).selectExpr("id as w1", "id % 7 as w2")
    sieved = collocations._sieve(phrases, ["w1", "w2"])
    rows = spark.range(100000).selectExpr("id as w1", "id % 7 as w2", "id as kept")
    kept = [r.kept for r in sieved(rows).collect()]
    assert set(range(20000)) <= set(kept) and len(kept) == len(set(kept)) < 28000


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    """Counts as of a very large corpus; products have about 31 digits."""
    f = 987_654_321_123
    rows = [("en", ["a"], 3 * f), ("en", ["b"], 5 * f + 1), ("en", ["a", "b"], f)]
    known = spark.createDataFrame(rows, "lang string, words array<string>, f long")
    totals = spark.createDataFrame([("en", 7_777_777_777_777_777)], "lang string, n long")
    (r,) = collocations._ranked(known, totals, 10).collect()
    assert r.score == 1000 * f * 7_777_777_777_777_777 // (3 * f * (5 * f + 1))


def test_pairs_are_joined_without_another_exchange(spark, capsys):
    """One exchange of words by document serves both sides of the first merge join; later joins read buckets."""
    relation = spark.range(1000).selectExpr("id % 7 as doc", "cast(id as int) as pos", "id % 3 as phrase").repartition(8, "doc")
    with collocations._joined_by_document(spark):
        pairs = collocations._longer(relation)
        pairs.explain()
        written = collocations.materialize_by(pairs, "doc", 8)
        collocations._longer(written.select("doc", "pos", "head").withColumnRenamed("head", "phrase")).explain()
    first, later = capsys.readouterr().out.split("== Physical Plan ==")[1:]
    assert "SortMergeJoin" in first and "pos" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", first))
    assert "SortMergeJoin" in later and "Exchange" not in later
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, pairs.collect()))


# ---------------------------------------------------------------- 13


def dealt(spark, df, **kw):
    return sharding.sharded(df, **kw).collect()


def check_shards(rows, texts, shards=16):
    """``rows`` against ``texts``, pairs of id and text."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    for mine in by.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    return {s: sum(r["size"] for r in by[s]) for s in range(shards)}


def test_sharding_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, "wé" * rng.randrange(0, 400)) for i in range(3000)]
    rows = dealt(spark, spark.createDataFrame(texts, "doc_id long, text string"))
    loads = check_shards(rows, texts)
    assert max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values()) / 16
    slots = {r.doc_id: r.virtual_slot for r in rows}
    assert all(slots[i] == int(hashlib.md5(str(i).encode()).hexdigest()[:3], 16) for i in slots)
    # The deal itself: slots by falling bytes, each to the emptiest shard.
    size = Counter()
    for i, t in texts:
        size[slots[i]] += len(t.encode()) + 1
    load, shard = [0] * 16, {}
    for v in sorted(range(sharding.SLOTS), key=lambda v: (-size[v], v)):
        shard[v] = load.index(min(load))
        load[shard[v]] += size[v]
    assert all(r.shard == shard[r.virtual_slot] for r in rows)


def test_sharding_edge_cases(spark):
    odd = odd_docs(spark)
    clash = odd.withColumnsRenamed({"lang": "shard", "source": "key"}).selectExpr("*", "1 as doc", "2 as place", "3 as nth", "4 as start", "5 as LAW")
    rows = sharding.sharded(clash)
    assert rows.columns == ["doc_id", "text", "key", "n_chars", "doc", "place", "nth", "start", *sharding.ADDED]
    check_shards(rows.collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert dealt(spark, empty_docs(spark)) == []


def test_names_that_a_third_of_all_rows_share_are_spread(spark):
    for hot in (7, None):
        texts = [(i + 100, "x" * (i % 90)) for i in range(8000)] + [(hot, f"copy {i % 5}") for i in range(4000)] + [(hot, "same") for _ in range(4000)]
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
        rows = dealt(spark, df)
        loads = check_shards(rows, texts)
        mean = sum(loads.values()) / 16
        assert max(abs(v - mean) for v in loads.values()) < 0.2 * mean
        assert max(Counter(r.virtual_slot for r in rows).values()) <= 2000


def test_slot_maps_have_versions_and_few_slots_move(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.createDataFrame([(i, "x" * (i % 97)) for i in range(20000)], DOCS.split(",")[0] + ", text string")
    first = {r.doc_id: r.shard for r in dealt(spark, docs, map_path=path)}
    again = {r.doc_id: r.shard for r in dealt(spark, docs, map_path=path)}
    assert first == again  # balanced as it is
    grown = docs.unionByName(docs.selectExpr("doc_id + 20000 as doc_id", "text"))
    rows = dealt(spark, grown, map_path=path, shards=17)
    loads = check_shards(rows, [(i, "x" * (i % 20000 % 97)) for i in range(40000)], 17)
    mean = sum(loads.values()) / 17
    assert max(loads.values()) <= 1.02 * mean and min(loads.values()) >= 0.8 * mean
    moved = [r for r in rows if r.doc_id < 20000 and r.shard != first[r.doc_id]]
    assert len(moved) < 0.12 * 20000 and sharding._versions(spark, path) == [1, 2, 3]
    old = sharding.load_map(spark, path, 1).collect()
    assert len(old) == sharding.SLOTS and {r.version for r in old} == {1}
    assert sharding.load_map(spark, path).first()["version"] == 3 and sharding.load_map(spark, path, 9) is None
    fewer = {r.shard for r in dealt(spark, docs, map_path=path, shards=5)}
    assert fewer == set(range(5))


def test_shards_are_written_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * i) for i in range(200)], "doc_id long, text string")
    sharding.write_shards(sharding.sharded(docs, shards=4), str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
