import random
import re
from collections import Counter

import pyarrow as pa

from tests.llm.helpers import edge_docs, edge_rows, empty_docs, words
from txguard.llm.quality import base_counts, clean_lines, line_fails, quality_rules


def brute(text):
    w = words(text)
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_base_counts_against_brute_force():
    rng = random.Random(2)
    texts = [r[1] for r in edge_rows()] + ["".join(rng.choice("ab c\n\té|#") for _ in range(rng.randint(0, 300))) for _ in range(800)]
    got = base_counts(pa.array(texts, pa.string()))
    assert list(zip(*[v.tolist() for v in got.values()])) == [brute(t) for t in texts]


def test_line_rules():
    assert line_fails("Home | About | Contact")
    assert line_fails("buy*** now$$$ cheap%%% pills&&&")
    assert line_fails("Read more about it here.")
    assert line_fails(" ".join(["word"] * 13))
    assert not line_fails(" ".join(["word"] * 13) + ".")
    assert not line_fails("A short title")
    assert clean_lines("A title\n\nHome | About | Contact\nText.") == ("A title\n\nText.", len("Home|About|Contact"))


def test_documents(spark):
    good = "\n".join(f"a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k}." for k in range(12))
    junk = "\n".join(f"w{k}*** v{k}$$$ u{k}%%% t{k}&&& s{k}###" for k in range(20))
    docs = spark.createDataFrame([(1, good), (2, junk), (3, good + "\nHome | About | Contact")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == good
    assert not got[2]["kept"] and not got[2]["base_failed"]
    assert got[3]["kept"] and got[3]["clean_text"] == good


def test_edges(spark):
    rows = quality_rules(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows())
    assert sorted(repr((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in rows) == \
        sorted(repr(brute(r[1])) for r in edge_rows())
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    assert quality_rules(empty_docs(spark)).count() == 0
