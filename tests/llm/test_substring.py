import hashlib
import random
from collections import Counter

import pytest

from tests.llm.helpers import edge_docs, edge_rows, empty_docs, prose, words
from txguard.llm.substring_dedup import repeated_substrings


def brute(texts):
    all_ = [words(t) for t in texts]
    n = Counter(tuple(w[i:i + 35]) for w in all_ for i in range(len(w) - 34))
    out = []
    for w in all_:
        gone = set()
        for i in range(len(w) - 34):
            if n[tuple(w[i:i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage, other = prose(rng, 90), prose(rng, 40)
    rows = []
    for i in range(120):
        body = prose(rng, rng.randint(0, 150)).split()
        if i % 3 == 0:
            p = passage.split()
            a = rng.randint(0, 40)
            body[len(body) // 2:len(body) // 2] = p[a:a + rng.randint(30, 50)]
        if i % 10 == 1:
            body += other.split() + ["between"] + other.split()
        rows.append(" ".join(body))
    rows += [rows[5], rows[5], rows[5] + " ", prose(rng, 34), prose(rng, 35)]
    rows += [rows[-1], rows[-2], "a " * 36, "b " * 35, "x y z " * 40, prose(rng, 50)]
    return rows


@pytest.mark.parametrize("group", [500_000, 50])
def test_against_brute_force(spark, group):
    texts = corpus(6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = repeated_substrings(spark, docs, group_suffixes=group).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == brute(texts)
    for r, t in zip(got, texts):
        kept = words(t)
        for s in reversed(r["spans"]):
            del kept[s["first"]:s["last"] + 1]
        assert hashlib.sha256(" ".join(kept).encode()).hexdigest() == r["kept_sha256"]


def test_edges(spark):
    got = repeated_substrings(spark, edge_docs(spark)).collect()
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in got) == sorted(
        repr((e[0], *b)) for e, b in zip(edge_rows(), brute([r[1] for r in edge_rows()])))
    assert repeated_substrings(spark, empty_docs(spark)).count() == 0
