import random

from tests.llm.helpers import DOCS, edge_docs, edge_rows, empty_docs
from txguard.llm.line_dedup import line_dedup


def test_boilerplate_goes_and_copies_stay(spark):
    menu = "Home About Contact"
    rows = [(i, f"Own first {i}.\n{menu}\nOwn last {i}.", "en", f"s{i % 7}", 1) for i in range(40)]
    copy = "A story that is told.\nIt goes on for a while.\nAnd here it ends."
    rows += [(100 + i, copy, "en", f"s{i % 7}", 1) for i in range(40)]
    rows += [(200 + i, f"Text {i}.\nOnly on four sites\nMore {i}.", "en", f"s{i % 4}", 1) for i in range(40)]
    rows += [(300, menu, "en", "s1", 1), (301, f"{menu}\n\n{menu}", "en", "s2", 1)]
    got = {r["doc_id"]: r for r in line_dedup(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got[3]["text"] == "Own first 3.\nOwn last 3." and (got[3]["n_lines"], got[3]["n_removed"]) == (3, 1)
    assert got[103]["text"] == copy and got[203]["n_removed"] == 0
    assert got[300]["text"] == "" and got[301]["text"] == "" and got[301]["n_removed"] == 2


def test_edges(spark):
    docs = edge_docs(spark)
    got = line_dedup(spark, docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = got.collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in rows) == sorted(repr((r[0], r[1])) for r in edge_rows())
    assert {(r["n_lines"], r["n_removed"]) for r in rows if not r["text"]} == {(0, 0)}
    assert line_dedup(spark, empty_docs(spark)).count() == 0


def test_null_site_is_a_site(spark):
    rows = [(i, f"a{i}\nmenu\nb{i}", "en", s, 1) for i, s in enumerate([None, "a", "b", "c", "d"] * 4)]
    got = line_dedup(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert {r["n_removed"] for r in got} == {1}


def test_blocks_go_and_copies_do_not_dilute(spark):
    menu, foot = ["Home", "About us", "Contact"], ["All rights kept", "Printed here"]
    rows = [(i, "\n".join([*menu, f"Own first {i}.", f"Own last {i}.", *foot]), "en", f"s{i % 7}", 1) for i in range(40)]
    copy = "A story that is told.\nShared with others\nAnd here it ends."
    rows += [(100 + i, copy, "en", f"s{i % 7}", 1) for i in range(1000)]
    rows += [(2000 + i, f"Before {i}.\nShared with others\nAfter {i}.", "en", f"s{i % 7}", 1) for i in range(10)]
    got = {r["doc_id"]: r for r in line_dedup(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got[3]["text"] == "Own first 3.\nOwn last 3." and got[3]["n_removed"] == 5
    assert got[2003]["text"] == "Before 3.\nAfter 3."
    assert {got[100 + i]["text"] for i in range(1000)} == {"A story that is told.\nAnd here it ends."}


def test_lines_and_documents_against_brute_force(spark):
    rng = random.Random(5)
    blocks = [[f"block {b} line {k}" for k in range(rng.randint(1, 4))] for b in range(12)]
    rows = []
    for i in range(150):
        own = [f"own {i} {k}" for k in range(rng.randint(0, 3))]
        rows.append((i, "\n".join([*rng.choice(blocks), *own, *rng.choice(blocks)]), "en", rng.choice([None, *"abcdef"]), 1))
    rows += [(200 + i, rows[i % 5][1], "en", rng.choice("abcdef"), 1) for i in range(60)]
    sites, texts = {}, {}
    for _, t, _, s, _ in rows:
        for x in t.split("\n"):
            sites.setdefault(x, set()).add(s)
            texts.setdefault(x, set()).add(frozenset(t.split("\n")))
    bad = {x for x in sites if len(sites[x]) >= 5 and len(texts[x]) >= 5}
    want = {r[0]: "\n".join(x for x in r[1].split("\n") if x not in bad) for r in rows}
    got = {r["doc_id"]: r["text"] for r in line_dedup(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want and 0 < len(bad) < len(sites)


def test_the_query_takes_menus_and_leaves_copies(spark, tmp_path):
    """A three-line menu on all sites goes, a document copied a thousand times stays."""
    from txguard.llm.queries import QUERIES
    menu = ["Home", "About us", "Contact"]
    rows = [(i, "\n".join([*menu, f"Own line {i}."]), "en", f"s{i % 9}", 1) for i in range(90)]
    copy = "A story that is told.\nIt goes on.\nAnd here it ends."
    rows += [(1000 + i, copy, "en", f"s{i % 9}", 1) for i in range(1000)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert all(got[i]["text"] == f"Own line {i}." and got[i]["n_removed"] == 3 for i in range(90))
    assert all(got[1000 + i]["text"] == copy for i in range(1000))


def test_columns_of_any_name(spark):
    docs = edge_docs(spark)
    for name in ("__id", "__bad", "__lines", "__kept", "line_id", "line_bad", "line_all", "LINE_KEPT"):
        docs = docs.withColumn(name, docs["source"])
    got = line_dedup(spark, docs)
    assert got.filter("__lines <=> source and line_all <=> source and LINE_KEPT <=> source and __id <=> source").count() == len(edge_rows())
