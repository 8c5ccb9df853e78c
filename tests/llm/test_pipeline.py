import random

import pytest

from promptledger.llm import neardup

def jaccard(a, b):
    def sh(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = sh(a), sh(b)
    return len(a & b) / len(a | b) if a | b else 1.0

def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a c"), (None, "a b"), (903, "a b")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        for k in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((g * 100 + k, " ".join(w)))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(2000 + i, " ".join(rng.choice(words) for _ in range(150)) + " " + passage) for i in range(40)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    kept = [(r.doc_id, r.text) for r in neardup.drop_near_duplicates(docs).collect()]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                group[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        first[r] = min(first.get(r, (True, 0)), (d is None, d or 0))
    want = sorted(first.values())
    got = sorted((d is None, d or 0) for d, _ in kept)
    assert got == want
    assert neardup.drop_near_duplicates(docs.limit(0)).count() == 0

def test_pairs_that_meet_only_under_a_passage_of_thousands(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows, near = draw(60), [], 0
    for g in range(2000):
        own = draw(20)
        rows.append((2 * g, " ".join(own[:10] + passage + own[10:])))
        if g % 10 == 0:
            own[rng.randrange(1, 9)] = "other"
            rows.append((2 * g + 1, " ".join(own[:10] + passage + own[10:])))
            near += jaccard(rows[-2][1], rows[-1][1]) >= 0.8
    assert near == 200 and jaccard(rows[0][1], rows[2][1]) < 0.8
    kept = [r.doc_id for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == [2 * g for g in range(2000)]


def test_neighbours_of_a_hot_key_lie_side_by_side(spark):
    rows = [(k, top, 10_000 * k + i, 10_000 * k) for k, n in ((1, 3), (2, 3000), (3, 1), (4, 500)) for i, top in enumerate(random.Random(k).choices(range(-900, 900), k=n))]
    met = spark.createDataFrame(rows, "key long, top long, row long, first long").repartition(3)
    want = {(row, first) for _, _, row, first in rows if row != first}
    rows.sort()
    want |= {(b[2], a[2]) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0]}
    assert {(r.row, r.other) for r in neardup._neighbours(met)[0].collect()} == want
    assert neardup._neighbours(met.limit(0))[0].count() == 0


def test_shuffled_pairs_that_share_a_long_passage(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    passage, rows = draw(200), []
    for g in range(1000):
        own = draw(40)
        other = list(own)
        other[rng.randrange(2, 17)] = "x"
        other[rng.randrange(22, 37)] = "y"
        rows += [(2 * g, " ".join(own[:20] + passage + own[20:])), (2 * g + 1, " ".join(other[:20] + passage + other[20:]))]
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8 > jaccard(rows[0][1], rows[2][1])
    rng.shuffle(rows)
    kept = [r.doc_id for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == [2 * g for g in range(1000)]


def test_a_very_long_text_and_its_near_copy(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(9000)}" for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["x", *long])), (3, " ".join(long[:60_000])), (4, "short")]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_rows_keep_their_numbers_however_the_table_is_split(spark, tmp_path):
    from promptledger.llm.common import numbered

    spark.range(0, 5000, 1, 7).selectExpr("id as doc_id", "repeat('a b ', 50) as text").write.parquet(f"{tmp_path}/t")
    docs, seen = spark.read.parquet(f"{tmp_path}/t"), []
    for size in ("2k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows, row = numbered(docs.filter("doc_id > 9"))
        seen.append({(r[row], r.doc_id) for r in rows.collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len({n for n, _ in seen[0]}) == 4990


def test_columns_of_the_documents_pass_whatever_their_names(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    named = ["score", "matches", "size", "_row", "row", "taken", "target", "f1", "_key", "_copies", "_at", "_cell", "_ahead", "root", "_metadata"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.select("*", *[pipeline.F.concat_ws("-", pipeline.F.lit(n), "doc_id").alias(n) for n in named])
    docs = docs.unionByName(docs.filter("doc_id = 3").selectExpr(*[f"cast(null as {t}) as `{c}`" for c, t in docs.dtypes]))
    before = docs
    for name, stage in pipeline.STAGES:
        after = pipeline.freeze(stage(spark, before, sf), f"clash-{name}")
        assert after.columns == docs.columns + (["shard", "slot"] if name == "sharding" else [])
        for r in after.collect():
            assert all(r[n] == (n if r.doc_id is None else f"{n}-{r.doc_id}") for n in named if r.lang is not None)
        before = after
    none = pipeline.freeze(docs.limit(0), "clash-none")
    for _, stage in pipeline.STAGES:
        none = pipeline.freeze(stage(spark, none, sf), "clash-none")
    assert none.count() == 0


def test_stages_and_their_order(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in pipeline.STAGES:
        after = pipeline.freeze(stage(spark, before, sf), f"test-{name}")
        if name != "sharding":
            assert after.columns == docs.columns
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert after.count() <= before.count() and after.exceptAll(before).count() == 0
        if name == "mixing":
            assert after.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
        if name == "sharding":
            assert after.drop("shard", "slot").exceptAll(before).count() == 0 and after.count() == before.count()
            sizes = [r["count"] for r in after.groupBy("shard").count().collect()]
            assert max(sizes) - min(sizes) <= 1
        before = after
    assert before.count() > 0


def test_texts_that_share_a_passage_and_are_not_similar_make_no_pairs(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    passage, meeting, made = draw(60), neardup._meeting, []
    rows = [(i, " ".join([*draw(8), *passage, *draw(4)])) for i in range(400)]
    assert 0.6 < jaccard(rows[0][1], rows[1][1]) < 0.8
    monkeypatch.setattr(neardup, "_meeting", lambda met: made.append(meeting(met).count()) or meeting(met))
    assert neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 400
    assert made[0] < 1000  # of some 80,000 pairs, most of them under more than one shingle


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles():
    rng = neardup.np.random.default_rng(3)
    for n in (0, 1, 5, 100, 600, 5000):
        x = neardup.np.unique(rng.integers(0, 1 << 62, n))
        y = neardup.np.unique(neardup.np.append(x[: n - n // 9], rng.integers(0, 1 << 62, n // 9)))
        bits = sum(int(a).bit_count() for a in (neardup._parity(x) ^ neardup._parity(y)).view("uint64"))
        assert bits <= len(neardup.np.setxor1d(x, y)) and len(neardup._parity(x)) == neardup.PARITY


def test_the_driver_returns_heap_that_is_no_longer_used(spark):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    rows = [(i, f"the words of text {i % 7} and of no other text") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [spark.sparkContext._gateway.new_array(spark._jvm.long, 8 << 20) for _ in range(12)]
    grown = runtime.totalMemory()
    assert grown > 12 * (64 << 20)
    del held
    kept = neardup.drop_near_duplicates(docs)
    assert runtime.totalMemory() < grown - (256 << 20)
    assert kept.count() == 7
