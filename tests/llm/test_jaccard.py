import random

import numpy as np
import pytest

from tests.llm.helpers import DOCS, edge_docs, edge_rows, empty_docs, lower, prose, words
from txguard.llm.jaccard_join import jaccard_components, jaccard_dedup, linked, schemes


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute(rows):
    """(id, set size, smallest reachable id) of rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 90 * (len(a) + len(b) - both):
                up[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w = w or ["x"]
        k = rng.randrange(len(w))
        w[k:k + 1] = rng.choice([[], [f"new{rng.randrange(10**6)}"], [w[k], "more"]])
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for size in [1, 2, 3, 9, 12, 13, 20, 21, 22, 40, 60, 61, 120, 200, 400]:
        base = prose(rng, size)
        rows += [base, base.upper(), base + " tail", *[edited(rng, base, rng.randint(1, 1 + size // 50)) for _ in range(8)]]
        chain = base                 # each is close to the one before, the ends are not
        for _ in range(8):
            chain = edited(rng, chain, 1 + size // 100)
            rows.append(chain)
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "wide"), [(1, None), (2, 2), (3, 1000)])
def test_components_against_brute_force(spark, seed, wide):
    rows = corpus(seed)
    got = jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), wide=wide)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_star_without_a_common_neighbour(spark):
    """A centre that links everything, with copies that do not link with each other."""
    rng = random.Random(9)
    base = prose(rng, 300)
    rows = [(i + 10, edited(rng, base, 4)) for i in range(60)] + [(500, base)]
    got = jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(3)
    for wide in (None, 3, 1000):
        plan = schemes({500: 1000}, 30_000, wide)
        lows = np.array([p.low for p in plan])

        def keys(u):
            band = int(np.searchsorted(lows, len(u), side="right")) - 1
            out = set(plan[band].keys(u).tolist()) if band >= 0 else set()
            if 10 * len(u) >= 9 * plan[band + 1].low:
                out |= set(plan[band + 1].keys(u).tolist())
            return out

        for _ in range(600):
            size = int(rng.choice([9, 10, 11, 14, 15, 19, 20, 22, 23, 33, 34, 50, 75, 113, 200]))
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            new = rng.integers(0, 2**63, int(rng.integers(0, size // 8 + 2))).astype(np.uint64)
            b = np.unique(np.concatenate([a[int(rng.integers(0, size // 8 + 2)):], new]))
            if len(b) and not np.array_equal(a, b) and linked(a, b):
                assert keys(a) & keys(b)


def test_edges(spark):
    got = jaccard_components(spark, edge_docs(spark)).collect()
    assert sorted(map(tuple, got), key=repr) == brute([(r[0], r[1]) for r in edge_rows()])
    assert jaccard_components(spark, empty_docs(spark)).count() == 0


def test_dedup_keeps_one_of_each_group(spark):
    docs = edge_docs(spark)
    kept = jaccard_dedup(spark, docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    # 4 and the null id share a text, 6 is a near copy of 5; rows without words all stay
    assert ids == sorted([1, 2, 3, None, 4, 4, 5, 7, 8, 9, 10, 11, 12], key=repr)
    assert jaccard_dedup(spark, empty_docs(spark)).count() == 0
    rows = [(i, t, "en", "s", 1) for i, t in corpus(4)]
    groups = {}
    for d, n, c in brute([(r[0], r[1]) for r in rows]):
        groups.setdefault(c if n else ("none", d), []).append(d)
    got = jaccard_dedup(spark, spark.createDataFrame(rows, DOCS))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(min(g) for g in groups.values())


def test_sketch_never_rules_out_a_link():
    from txguard.llm.jaccard_join import differences, parity
    rng = np.random.default_rng(4)
    for size in (10, 50, 300, 3000):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for drop in range(0, size // 5, max(1, size // 40)):
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop // 2).astype(np.uint64)]))
            far = int(np.bitwise_count((parity(a) ^ parity(b)).view(np.uint64)).sum())
            assert far <= len(np.setxor1d(a, b))
            if linked(a, b):
                assert far <= differences(len(a), len(b))


def kept_by_brute(rows, k, percent):
    """Smallest id of each component by k-word shingles; rows without words all stay."""
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    least = [r[0] for r in rows]
    links = [(i, j) for i, a in enumerate(sets) for j in range(i)
             if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j])]
    while True:
        before = list(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            return sorted(d for (d, _), m in zip(rows, least) if d == m)


def test_the_pipelines_near_copies_against_brute_force(spark):
    from corpus_pipeline import near_copies
    rng = random.Random(6)
    texts = [t for _, t in corpus(5)]
    for size in [5, 6, 8, 9, 10, 11, 13, 16, 26, 100]:
        base = prose(rng, size)
        texts += [base, base + " tail", "head " + base, *[edited(rng, base, max(1, size // 40)) for _ in range(6)]]
    base = prose(rng, 100).split()
    texts += [" ".join(base), " ".join([*base[:30], "x", *base[31:70], "y", *base[71:]])]      # 0.811 of five words, 0.885 of three
    rows = list(enumerate(texts))
    got = near_copies(spark, spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS), "")
    ids = sorted(r["doc_id"] for r in got.collect())
    assert ids == kept_by_brute(rows, 5, 80) != kept_by_brute(rows, 3, 90)
    assert len(texts) - 1 not in ids


def test_every_pair_linked_at_80_shares_a_key():
    from txguard.llm.jaccard_join import differences, parity
    rng = np.random.default_rng(7)
    for wide in (None, 3, 1000):
        plan = schemes({500: 1000}, 30_000, wide, 80)
        lows = np.array([p.low for p in plan])

        def keys(u):
            band = int(np.searchsorted(lows, len(u), side="right")) - 1
            out = set(plan[band].keys(u).tolist()) if band >= 0 else set()
            if 100 * len(u) >= 80 * plan[band + 1].low:
                out |= set(plan[band + 1].keys(u).tolist())
            return out

        some = 0
        for _ in range(3000):
            size = int(rng.choice([4, 5, 6, 7, 8, 9, 10, 11, 12, 17, 18, 22, 27, 28, 33, 42, 63, 96, 150]))
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            new = rng.integers(0, 2**63, int(rng.integers(0, size // 5 + 2))).astype(np.uint64)
            b = np.unique(np.concatenate([a[int(rng.integers(0, size // 5 + 2)):], new]))
            if len(b) and not np.array_equal(a, b) and linked(a, b, 80):
                some += 1
                assert keys(a) & keys(b)
                far = int(np.bitwise_count((parity(a) ^ parity(b)).view(np.uint64)).sum())
                assert far <= len(np.setxor1d(a, b)) <= differences(len(a), len(b), 80)
        assert some > 500


def test_columns_of_any_name(spark):
    docs = edge_docs(spark)
    for name in ("__gone_id", "__print", "__gone_print", "gone_id", "twice", "_print", "GONE_PRINT"):
        docs = docs.withColumn(name, docs["source"])
    got = jaccard_dedup(spark, docs)
    assert got.columns == docs.columns and got.count() == 13
    assert got.filter("__print <=> source and gone_id <=> source and twice <=> source and __gone_id <=> source").count() == 13


def test_keys_per_document_do_not_grow():
    """From 10,000 documents to 10,000,000 at op8's 90 %; at 80 % to 1,000,000, beyond which neighbourhoods cost less."""
    for percent, most in ((90, 10**7), (80, 10**6)):
        sizes = {25: 0.1, 120: 0.2, 235: 0.4, 455: 0.2, 1200: 0.1}
        found = []
        for n in (10**4, most):
            plan = schemes({s: share * n for s, share in sizes.items()}, 30_000, None, percent)
            lows = [p.low for p in plan]
            rng = np.random.default_rng(1)
            total = 0.0
            for size, share in sizes.items():
                u = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                total += share * len(plan[int(np.searchsorted(lows, size, side="right")) - 1].keys(u))
            found.append(total)
        assert found[0] == found[1]


def test_agreement_is_counted_on_every_text(spark):
    """Pairs of shingles that agree, of all texts: a phrase that only texts with an odd hash have counts too; copies do not agree with themselves."""
    from collections import Counter

    from pyspark.sql import functions as F

    from txguard.llm.jaccard_join import agreement
    from txguard.llm.scratch import Scratch
    texts = [" ".join(f"w{k}x{i}" for i in range(20)) + (" a common phrase" if k % 2 else "") for k in range(200)] + ["a copied text"] * 50 + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("print", F.xxhash64("text"))

    def sets(t):
        w = (t or "").split()
        return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    n = Counter(s for t in texts for s in sets(t))
    own = sum(c * c * len(sets(t)) for t, c in Counter(texts).items())
    exact = (sum(c * c for c in n.values()) - own) / sum(n.values()) ** 2
    assert exact > 1e-4
    assert abs(agreement(Scratch(spark, "t"), rows.repartition(3), 3) / exact - 1) < 0.1


def test_long_sketches_tell_long_texts_apart_and_never_rule_out_a_link():
    """1,024 bits cannot differ in as many shingles as texts of 2,500 words and more may; a bit per shingle can."""
    from txguard.llm.jaccard_join import differences, long_parity, parity, sketches_differ

    rng = np.random.default_rng(8)
    assert long_parity(rng.integers(1, 2**63, 1024).astype(np.uint64)) is None
    for n in (1025, 2500, 6000, 20_000):
        a = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        other = np.unique(rng.integers(1, 2**63, n * 9 // 8).astype(np.uint64))
        most = differences(len(a), len(other), 80)
        assert sketches_differ(long_parity(a), long_parity(other)) > most
        if n >= 2500:
            assert int(np.bitwise_count((parity(a) ^ parity(other)).view(np.uint64)).sum()) <= most      # why it takes them
        for cut in (0, 1, n // 20, n // 12):
            b = np.unique(np.concatenate([a[cut:], other[:cut]]))
            far = sketches_differ(long_parity(a), long_parity(b))
            assert far <= len(np.setxor1d(a, b))
            assert linked(a, b, 80) and far <= differences(len(a), len(b), 80)
        # of unlike lengths the longer one is folded
        assert sketches_differ(long_parity(a), long_parity(np.concatenate([a, other[:n // 9]]))) <= n // 9


def test_texts_of_chance_pairs_do_not_move(spark, monkeypatch):
    """Long texts that share a passage are pairs of every group; only linked ones may come to the step with texts."""
    from txguard.llm import jaccard_join as J

    rng = random.Random(21)
    passage = prose(rng, 700)
    rows = [(i, f"{passage} {prose(rng, 1900, 100_000)}") for i in range(12)]
    rows += [(20 + i, edited(rng, rows[0][1], 3)) for i in range(2)]
    moved = []

    def seen(scratch, df):
        out = write(scratch, df)
        if df.columns == ["left", "right", "shingles"]:
            moved.append(out.count())
        return out
    write = J.Scratch.write
    monkeypatch.setattr(J.Scratch, "write", seen)
    got = J.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {**{i: i for i in range(12)}, 20: 0, 21: 0}
    assert moved and sum(moved) <= 3


def test_slices_and_classes_change_nothing(spark, monkeypatch):
    """Keys in all their classes, groups in several slices, texts of few pairs at a time."""
    from txguard.llm import components, jaccard_join as J

    monkeypatch.setattr(J, "CLASS_KEYS", 1)
    monkeypatch.setattr(J, "SLICE_SHINGLES", 1)
    monkeypatch.setattr(J, "SLICE_ROWS", 1)
    monkeypatch.setattr(components, "SLICE_ROWS", 1)
    used = []
    monkeypatch.setattr(components, "slices", lambda rows, most, f=components.slices: used.append(f(rows, most)) or used[-1])
    rows = [r for r in corpus(4) if len(r[1].split()) < 100]
    rows += [(i + 1000, t) for i, t in rows[:20]]                    # equal sets, which are no nodes of their own
    got = jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert max(used) > 1


def test_rows_without_a_list(spark):
    from txguard.llm.candidates import without
    from txguard.llm.scratch import Scratch

    df = spark.range(0, 3000, 1, 4).selectExpr("id row", "id * 2 x")
    for gone in (spark.range(0), spark.range(0, 2900, 3).selectExpr("id row"), spark.range(3000).selectExpr("id row")):
        rest = without(Scratch(spark, "t"), df, "row", gone.toDF("row"))
        left = sorted(map(tuple, rest.select("row", "x").collect()))
        out = {r[0] for r in gone.collect()}
        assert left == [(i, 2 * i) for i in range(3000) if i not in out]


def test_a_written_table_leaves_no_shuffle_files(spark):
    import os
    import time

    from txguard.llm import scratch as S

    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    before = files()
    out = S.Scratch(spark, "t").write(spark.range(0, 200_000, 1, 4).selectExpr("id % 5003 k").groupBy("k").count())
    end = time.time() + 20
    while files() - before and time.time() < end:      # files go in the background
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 5003 and spark.conf.get(S._CLEAN, None) is None
