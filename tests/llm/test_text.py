import numpy as np
import pyarrow as pa

from tests.llm.helpers import edge_rows, words
from txguard.llm.text import Rolling, Words, pieces, sliding_min


def test_words_and_windows_agree_with_plain_python():
    texts = [r[1] for r in edge_rows()] + ["", None, "a", " b c "]
    w = Words(pa.array(texts, pa.string()).slice(1))
    ref = [[x.encode() for x in words(t)] for t in texts[1:]]
    flat = [x for r in ref for x in r]
    assert w.count.tolist() == [len(r) for r in ref]
    assert [bytes(w.buf[a:b]) for a, b in zip(w.start, w.end)] == flat
    h = w.hashes()
    assert len({*h.tolist()}) == len({*flat})
    assert len({(a, b) for a, b in zip(flat, h.tolist())}) == len({*flat})
    three = Rolling(h).windows(3)
    runs = [tuple(flat[i:i + 3]) for i in range(len(flat) - 2)]
    assert len({*zip(runs, three.tolist())}) == len({*runs}) == len({*three.tolist()})
    assert w.fits(3).sum() == sum(max(0, len(r) - 2) for r in ref)


def test_lower_cases_ascii_only():
    w = Words(pa.array(["AbC ÉÀ", "abc ÉÀ", "abc éà"]), lower=True)
    h = w.hashes().reshape(3, 2)
    assert (h[0] == h[1]).all() and h[1, 1] != h[2, 1]


def test_sliding_min_and_pieces():
    v = np.random.default_rng(1).random(60)
    assert (sliding_min(v, 7) == [v[i:i + 7].min() for i in range(54)]).all()
    assert len(sliding_min(v, 61)) == 0
    batch = pa.record_batch([pa.array(range(6)), pa.array(["x" * 10, None, "y" * 50, "", "z" * 9, "z" * 9])], names=["i", "text"])
    parts = list(pieces(batch, "text", 20))
    assert sum(p.num_rows for p in parts) == 6 and max(p.num_rows for p in parts) < 6
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(6))
