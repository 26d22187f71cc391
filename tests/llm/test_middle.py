import hashlib
import random
import re

import pytest

from tests.llm.helpers import edge_docs, edge_rows, empty_docs
from txguard.llm.middle import fill_in_middle, rearrange, restore, restore_texts, swap_blocks

TOKEN = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_swapping_blocks_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        a, b, c = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        buf = bytearray(data)
        swap_blocks(buf, a, b, c)
        assert bytes(buf) == data[:a] + data[b:c] + data[a:b] + data[c:]
        swap_blocks(buf, a, a + c - b, c)
        assert bytes(buf) == data


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_pieces_of_sentinels_do_not_mislead_the_restoring(form):
    rng = random.Random(2)
    parts = ["<", ">", "P", "S", "M", "<P", "S>", "<M", " ", "\n", "é", "漢"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        if re.search("<[PSM]>", text):
            continue
        cuts = sorted(len(text[:rng.randrange(len(text) + 1)].encode()) for _ in range(2))
        assert restore(bytes(rearrange(text.encode(), *cuts, form)), form) == text.encode()


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in edge_rows()]
    rows += [(i + 100, "".join(rng.choice(["ab", " ", "\n", "\t\x0b", "é", "<P", ">", "漢", "<S>" if i % 9 == 0 else "x"])
                               for _ in range(rng.randrange(60)))) for i in range(300)]
    got = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    back = restore_texts(got).select("doc_id", "restored").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)


def test_edges(spark):
    docs = edge_docs(spark)
    for name in ("form", "output", "restored", "text_", "middle_chars"):
        docs = docs.withColumn(name, docs["source"])
    got = restore_texts(fill_in_middle(docs)).collect()
    assert sorted((r["doc_id"], r["output"]) for r in got if r["doc_id"] is not None) == sorted(
        (d, brute(d, t)[5]) for d, t, *_ in edge_rows() if d is not None)
    assert restore_texts(fill_in_middle(empty_docs(spark))).count() == 0
    kept = restore_texts(spark.createDataFrame([(1, None, "psm", "x"), (2, "a b", None, "y")],
                                               "k int, output string, form string, restored string"))
    assert [tuple(r) for r in kept.orderBy("k").collect()] == [(1, None, "psm", None), (2, "a b", None, "a b")]
