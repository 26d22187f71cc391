import random
from collections import Counter

from tests.llm.helpers import SF001, edge_docs, edge_rows, empty_docs, lower, prose, words
from txguard.llm.decontaminate import decontaminate, find_leaks

ITEMS = "item_id long, text string"


def shingles(w):
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(text, items):
    """Items of which some window as long as the item is similar enough."""
    holders = Counter(s for _, t in items for s in shingles(words(lower(t))) if words(t or ""))
    w, out = words(lower(text)), set()
    for item, t in items:
        other = words(lower(t))
        size = min(len(other), len(w))
        if not size or len(w) < min(5, len(other)):
            continue
        b = shingles(other)
        for i in range(len(w) - size + 1):
            a = shingles(w[i:i + size])
            low = sum(min(a[s], b[s]) / holders.get(s, 1) for s in a.keys() | b.keys())
            high = sum(max(a[s], b[s]) / holders.get(s, 1) for s in a.keys() | b.keys())
            if low >= 0.8 * high:
                out.add(item)
    return out


def test_planted_passages_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(12, 60))) for i in range(25)]
    items += [(25, items[0][1]), (26, items[1][1] + " and more"), (27, "only four words here"), (28, ""), (29, None)]
    docs = []
    for d in range(150):
        body = prose(rng, rng.randint(5, 200)).split()
        if d % 3 == 0:
            passage = items[rng.randrange(27)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.choice([0, 1, -1, -2, rng.randrange(len(passage))])] = f"edit{d}"
            at = rng.randrange(len(body))
            body[at:at] = [x.upper() for x in passage] if d % 2 else passage
        docs.append((d, " ".join(body)))
    docs.append((150, "x ONLY four words here y"))
    got = find_leaks(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    have = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert have == {(d, i) for d, t in docs for i in brute(t, items)}
    assert len(have) > 30


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    from txguard.llm import decontaminate as m
    docs, bench = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted((r["doc_id"], r["item_id"]) for r in find_leaks(spark, docs, bench).collect())
    monkeypatch.setattr(m, "ITEMS_PER_PASS", 7)
    # weights are counted per block of items, which only exact passages are indifferent to
    blocks = sorted((r["doc_id"], r["item_id"]) for r in find_leaks(spark, docs, bench).collect())
    assert whole and blocks == whole


def test_stage_drops_leaks_and_keeps_the_rest(spark):
    docs, bench = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [r["text"] for r in bench.collect()]
    exact = {r["doc_id"] for r in docs.collect() if any(t in r["text"] for t in texts)}
    kept = decontaminate(spark, docs, bench)
    assert kept.columns == docs.columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()}
    assert gone == {r["doc_id"] for r in find_leaks(spark, docs, bench).collect()} >= exact


def test_edges(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (None, edge_rows()[4][1])], ITEMS)
    got = find_leaks(spark, edge_docs(spark), items).collect()
    assert sorted((repr(r["doc_id"]), repr(r["item_id"])) for r in got) == [("4", "None"), ("4", "None"), ("None", "None")]
    assert decontaminate(spark, edge_docs(spark), items).count() == len(edge_rows()) - 3
    assert find_leaks(spark, empty_docs(spark), items).count() == 0
    assert find_leaks(spark, edge_docs(spark), items.limit(0)).count() == 0
    assert decontaminate(spark, edge_docs(spark), items.limit(0)).count() == len(edge_rows())


def test_small_blocks_give_the_same_similarities_on_edited_passages(spark, monkeypatch):
    from txguard.llm import decontaminate as m
    rng = random.Random(12)
    frame = prose(rng, 9)
    items = [(i, f"{prose(rng, 12)} {frame} {prose(rng, 12)}") for i in range(30)]
    items += [(30 + i, prose(rng, 15)) for i in range(10)] + [(40 + i, f"  {t.upper()}\n") for i, (_, t) in enumerate(items[:5])]
    docs = []
    for d in range(200):
        passage = items[rng.randrange(40)][1].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            passage[rng.choice([0, -1, rng.randrange(len(passage))])] = f"edit{d}"
        docs.append((d, " ".join([prose(rng, 20), *passage, prose(rng, 20), frame])))
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)

    def found():
        return sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in find_leaks(spark, docs, bench).collect())

    whole = found()
    monkeypatch.setattr(m, "ITEMS_PER_PASS", 6)
    assert found() == whole and len({s for _, _, s in whole}) > 3


def test_an_item_that_repeats_keeps_its_near_copies(spark):
    text = prose(random.Random(3), 15)
    docs = spark.createDataFrame([(1, "a b " + text.rsplit(" ", 1)[0] + " other c d")], "doc_id long, text string")
    for ids in ([7], [7, 8, None]):
        got = find_leaks(spark, docs, spark.createDataFrame([(i, text) for i in ids], ITEMS)).collect()
        assert {r["item_id"] for r in got} == set(ids) and {round(r["similarity"], 3) for r in got} == {0.833}


def test_columns_of_any_name(spark):
    from tests.llm.helpers import edge_docs, edge_rows
    from txguard.llm.decontaminate import decontaminate
    docs = edge_docs(spark)
    for name in ("__text", "text_to_scan", "_text_to_scan"):
        docs = docs.withColumn(name, docs["source"])
    items = spark.createDataFrame([(1, "five words that nobody has written here")], "item_id long, text string")
    got = decontaminate(spark, docs, items)
    assert got.columns == docs.columns
    assert got.filter("__text <=> source and text_to_scan <=> source").count() == len(edge_rows())
