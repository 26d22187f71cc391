import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import edge_docs, edge_rows, empty_docs, prose
from tests.llm.test_jaccard import corpus, edited, shingles
from txguard.llm.candidates import likely, one_per_member_list
from txguard.llm.jaccard_join import linked
from txguard.llm.minhash_dedup import least_linkable, match_threshold, minhash_components, signatures


def brute(rows, percent=85):
    """(id, set size, smallest reachable id, kept) of rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return sorted(((d, len(s), least[root(i)], d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(minhash_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_a_large_cluster_and_a_shared_passage(spark):
    """Copies that link only with the centre, copies that link with all, and texts that only share a passage."""
    rng = random.Random(9)
    base, other, passage = prose(rng, 200), prose(rng, 300), prose(rng, 40)
    rows = [(i, edited(rng, base, 4)) for i in range(120)] + [(400, base)]
    rows += [(500 + i, other + f" end{i}") for i in range(150)]
    rows += [(800 + i, prose(rng, 60) + " " + passage) for i in range(100)]
    rows += [(2000 + i, base) for i in range(100)]
    assert found(minhash_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_edges(spark):
    assert found(minhash_components(spark, edge_docs(spark))) == brute([(r[0], r[1]) for r in edge_rows()])
    assert minhash_components(spark, empty_docs(spark)).count() == 0


def test_threshold_and_smallest_pair():
    for percent in (60, 80, 85, 95):
        m = match_threshold(48, percent, 1e-10)
        p = percent / 100
        from math import comb
        tail = [sum(comb(48, k) * p ** k * (1 - p) ** (48 - k) for k in range(x)) for x in (m, m + 1)]
        assert tail[0] <= 1e-10 < tail[1]
        k = least_linkable(percent)
        assert 100 * k >= percent * (k + 1) and 100 * (k - 1) < percent * k
    assert match_threshold(48, 100, 1e-10) == 48


def test_agreement_follows_similarity():
    """The share of equal coordinates is the similarity, and no linked pair is below the threshold."""
    rng = np.random.default_rng(5)
    m, shares = match_threshold(48, 85, 1e-10), []
    for _ in range(400):
        size = int(rng.choice([7, 12, 30, 200, 1500]))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        k = max(1, size * 15 // 200)
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 2**63, k).astype(np.uint64)]))
        x, y = signatures([a, b], 48)
        assert (signatures([a], 48)[0] == x).all()
        if linked(a, b, 85):
            assert (x == y).sum() >= m
        both = len(np.intersect1d(a, b))
        shares.append((x == y).mean() - both / (len(a) + len(b) - both))
    assert abs(np.mean(shares)) < 0.01


def test_a_filter_lets_all_wanted_through(spark):
    df = spark.range(40_000).select(((F.col("id") * 7919) - 10**8).alias("v"))
    wanted = df.filter("v % 50 = 0")
    got = likely(df, "v", wanted)
    assert got.join(wanted, "v", "left_semi").count() == wanted.count()
    assert got.count() - wanted.count() < 0.03 * df.count()
    assert likely(df, "v", wanted.filter("false")).count() == 0


def test_equal_lists_are_one(spark):
    rows = [(1, 10), (1, 11), (2, 11), (2, 10), (3, 10), (4, 10), (4, 11), (4, 12), (5, 13), (6, 13)]
    got = one_per_member_list(spark.createDataFrame(rows, "key long, node long"))
    assert sorted(map(tuple, got.collect())) == [(1, 10, 2), (1, 11, 2), (4, 10, 3), (4, 11, 3), (4, 12, 3)]
