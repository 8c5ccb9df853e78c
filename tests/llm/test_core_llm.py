import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from promptledger.llm import exact_dedup, mixing, shard, simhash
from promptledger.llm.trie import self_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", None), (3, "A b", "a"), (4, "a B", "b"), (4, "a B", "b"), (5, " \t", "b"), (None, "x", "b"), (6, "é É", "a"), (7, "é é", "a"), (8, "w " * 30_000, "b")]


def test_dedup_edge_cases(spark):
    got = {}
    for r in exact_dedup.DigestIndex(spark, buckets=4).ingest(docs(spark, ODD).withColumn("row", F.lit(1))).collect():
        got.setdefault(r.text_sha256, []).append(r)
    same = got[hashlib.sha256(b"a b").hexdigest()]
    assert len(same) == 3 and {r.keep_id for r in same} == {4} and sum(r.kept for r in same) == 1 and same[0].group_size == 3
    empty = got[hashlib.sha256(b"").hexdigest()]
    assert sorted(r.doc_id for r in empty) == [1, 2] and {r.keep_id for r in empty} == {2}
    assert len(got[hashlib.sha256("é É".encode()).hexdigest()]) == 1  # only A to Z are lower-cased


def test_dedup_second_batch_and_replay(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.ingest(docs(spark, [(1, "x", "a"), (2, "y", "a")]), batch="one")
    second = docs(spark, [(10, "X", "a"), (11, "z", "a"), (12, "z", "a")])
    want = {(10, 1, False), (11, 12, False), (12, 12, True)}
    for _ in range(2):
        assert {(r.doc_id, r.keep_id, r.kept) for r in index.ingest(second, batch="two").collect()} == want
    assert index.rows().count() == 3
    again = exact_dedup.DigestIndex(spark, index.path, 4)  # opened by another session
    assert {(r.doc_id, r.kept) for r in again.ingest(docs(spark, [(20, "y", "a"), (21, "q", "a")])).collect()} == {(20, False), (21, True)}
    assert again.ingest(docs(spark, []), batch="none").count() == 0


def test_a_compacted_index_is_read_without_a_sort_and_outlives_a_failed_rewrite(spark):
    tables = spark.catalog.listTables
    before = len(tables())
    index = exact_dedup.DigestIndex(spark, buckets=4)
    for k in range(3):
        index.ingest(docs(spark, [(10 * k + i, f"t{k + i}", "a") for i in range(9)]), batch=str(k))
    digests = sorted(bytes(r["digest"]) for r in index.rows().collect())
    assert len(digests) == 11
    index.compact()
    assert sorted(bytes(r["digest"]) for r in index.rows().collect()) == digests and max(Counter(f.split("_")[-1] for f in index.rows().inputFiles()).values()) == 1
    (spark.range(3).write.parquet(f"{index.path}/gen-2"))  # a rewrite that did not end
    index.close()
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    got = again.ingest(docs(spark, [(90, "T2", "a"), (91, "new", "a")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(90, 2, False), (91, 91, True)}
    again.compact()
    assert again.rows().count() == 12
    again.close()
    assert len(tables()) == before


def test_shards_do_not_depend_on_how_files_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shard, "BLOCK_BITS", 6)
    spark.range(0, 3000, 1, 5).selectExpr("id as doc_id", "repeat('text ', 40) as text", "'k' as _key", "'c' as _cell").write.parquet(f"{tmp_path}/t")
    docs_, seen = spark.read.parquet(f"{tmp_path}/t"), []
    for size in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        out = shard.shuffle_to_shards(docs_, frozen=True)
        assert out.columns == ["doc_id", "text", "_key", "_cell", "shard", "slot"]
        seen.append(sorted((r.doc_id, r.shard, r.slot) for r in out.collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len({(s, t) for _, s, t in seen[0]}) == 3000
    with pytest.raises(ValueError, match="freeze"):
        shard.shuffle_to_shards(docs_.filter("doc_id % 2 = 0"), frozen=True)


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from promptledger.llm import common

    remote = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="local-cluster[3,2,1024]"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(remote)


def test_mix_edge_cases(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3] if i % 11 else None) for i in range(300)] + [(5, "w " * 5, "c")] * 3 + [(900, None, "z")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    total = sum(r.size for r in got)
    taken, want = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        want[r.source] = (r.target, r.source_size)
    assert all(t <= 2 * s + 1e-9 for t, s in want.values())
    assert abs(sum(t for t, _ in want.values()) - 1.5 * total) < 1e-6
    assert all(abs(taken[s] - want[s][0]) <= 7 for s in taken)
    assert sum(taken.values()) <= 1.5 * total
    copies = mixing.mixed_documents(docs(spark, rows))
    assert copies.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert copies.count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, None)])).first().taken == 0


@pytest.mark.parametrize("n", [0, 1, 15, 16, 1000])
def test_shards_are_exact_and_whole(spark, n):
    frame = docs(spark, [(i % 7, "t" * (i % 5), "s") for i in range(n)]).withColumn("slot", F.lit("x"))
    got = shard.shuffle_to_shards(frame).collect()
    assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(map(len, by.values()), reverse=True) == [x for x in shard.shard_sizes(n, 16) if x]


def test_communication_matrix():
    counts = [0, 3, 500, 17, 1, 1000]
    for seed in range(20):
        m = shard.communication_matrix(counts, 16, seed)
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == shard.shard_sizes(sum(counts), 16) and (m >= 0).all()
    first = np.mean([shard.communication_matrix([50, 50], 2, s)[0, 0] for s in range(400)])
    assert abs(first - 25) < 1
    big = shard.communication_matrix([3 * 10**9, 10**9], 4, 1)
    assert big.sum(axis=1).tolist() == [3 * 10**9, 10**9] and big.sum(axis=0).tolist() == [10**9] * 4


def classes(prints, distance):
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= distance:
                up[find(a)] = find(b)
    return {frozenset(q for q in prints if find(q) == r) for r in {find(p) for p in prints}}


@pytest.mark.parametrize("budget", [0, 1, 3, 4])
def test_trie_self_join_links_what_brute_force_links(budget):
    rng = random.Random(budget)
    base = [rng.getrandbits(64) for _ in range(40)]
    keys = set(base)
    for b in base:
        for _ in range(rng.randrange(8)):
            x = b
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            keys.add(x)
    keys = sorted(keys)
    links = self_join(np.array(keys, np.uint64), np.array([0, len(keys)]), 64, budget)
    root = links.find(np.arange(len(keys)))
    got = {}
    for k, r in zip(keys, root.tolist(), strict=True):
        got.setdefault(r, set()).add(k)
    assert {frozenset(v) for v in got.values()} == classes(keys, budget)


def fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    out = {}
    for c in classes(sorted(set(prints)), 4):
        ids = [i for (i, _), p in zip(rows, prints, strict=True) if p in c]
        out.update((i, min(ids)) for i in ids)
    return {i: (f"{p:016x}", out[i]) for (i, _), p in zip(rows, prints, strict=True)}


def test_simhash_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, sf).collect()}
    assert got == brute(rows)


def test_simhash_edge_cases_and_second_cut(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c d"), (7, "A  B\tc d")]
    for i in range(150):  # one large group of near copies
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(w)))
    monkeypatch.setattr(simhash, "SPLIT", 20)
    got = simhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]))
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got.collect()}
    assert got == brute(rows)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    twice = simhash.near_duplicates(docs(spark, [(9, "a b", "s"), (9, "a b", "s"), (None, "a b", "s")])).collect()
    assert [r.component_id for r in twice] == [9, 9, 9]


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    random.Random(1).shuffle(path)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000, 1002: 1000}


def test_large_draws_follow_the_exact_law(monkeypatch):
    rng = np.random.default_rng(3)
    got = np.array([shard._split(rng, 10**6, 2 * 10**9 - 10**6, 2000) for _ in range(4000)])
    assert abs((got == 0).mean() - np.exp(-1)) < 0.03 and abs((got == 2).mean() - np.exp(-1) / 2) < 0.03 and abs(got.mean() - 1) < 0.06
    assert [shard._split(rng, g, b, d) for g, b, d in ((0, 2 * 10**9, 5), (2 * 10**9, 0, 5), (10**9, 10**9, 2 * 10**9), (10**9, 10**9, 0))] == [0, 5, 10**9, 0]
    matrix = shard.communication_matrix([3 * 10**9, 0, 10**9 + 1, 7], 3, 9)
    assert matrix.sum(axis=1).tolist() == [3 * 10**9, 0, 10**9 + 1, 7] and matrix.sum(axis=0).tolist() == shard.shard_sizes(4 * 10**9 + 8, 3)
    monkeypatch.setattr(shard, "EXACT", 1)
    for good, bad, draws in ((7, 5, 6), (30, 40, 25), (3, 90, 50)):
        got = np.bincount([shard._split(rng, good, bad, draws) for _ in range(6000)], minlength=draws + 1) / 6000
        want = [math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(draws + 1)]
        assert np.abs(got - want).max() < 0.03
