import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import SF001, edge_docs, edge_rows, empty_docs
from txguard.llm.packing import pack_documents, sweep_plan
from txguard.llm.queries import tokenizer_path
from txguard.llm.token_files import pack, read_tokens, unpack, write_tokens
from txguard.llm.tokens import Encoder

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(PATH)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_library(library):
    texts = [r[1] or "" for r in edge_rows()] + [" a", "a ", "a  b", "a \n b", "a\n b", "\n", "  ", "it's we'll 12ab é漢 x", "a\u3000b c", "a \u3000b",
                                                 "x <|endoftext|> y", "\x1c a\x1db c", "a\n\nB\n C", "\nA", "x\u00a0\nY", "x\u2028 y", "don't...Stop!!  ok", "É\nB…. x",
             "a1b2 c_d-e", "<|endoftext|>", "<|endoftext", "\t\tA\tb", "A\r\nB"]
    encode = Encoder(PATH)
    for _ in range(2):      # the second time from what it remembers
        assert [x.tolist() for x in encode(pa.array(texts))] == [library(t) for t in texts]


def test_encoder_holds_little(library):
    """Few units are with the library at once, and what a worker keeps of them afterwards are small arrays."""
    import gc
    import tracemalloc
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(str(k * 400 + i).translate(letters) for i in range(400)) for k in range(100)]
    encode = Encoder(PATH)
    encode.tok, at_once = Counting(encode.tok), []
    encode.tok.at_once = at_once
    gc.collect()
    tracemalloc.start()
    got = [x.tolist() for x in encode(pa.array(texts))]
    assert got == [library(t) for t in texts]
    units = sum(at_once)
    del got
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert units > 30_000 and max(at_once) <= 5_000
    assert kept < 50 * units
    assert [x.tolist() for x in encode(pa.array(texts))] == [library(t) for t in texts] and sum(at_once) == units


class Counting:
    """A tokenizer that notes how many units it gets at once."""

    def __init__(self, tok):
        self.tok = tok

    def encode_batch_fast(self, units, **options):
        self.at_once.append(len(units))
        return self.tok.encode_batch_fast(units, **options)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000, 70_000])
def test_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 200_000).astype("<u4")
    ranked, control, data = pack(ids)
    assert (unpack(n, ranked, control, data) == ids).all()
    assert len(control) == -(-n // 4)


def test_three_and_four_bytes():
    ids = np.arange(70_000, dtype="<u4") + np.uint32(2**31)
    assert (unpack(len(ids), *pack(ids)) == ids).all()


def test_token_files(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = read_tokens(write_tokens(spark, docs, PATH, 2)).orderBy("doc_id").collect()
    at = 0
    for row, have in zip(docs.orderBy("doc_id").collect(), got, strict=True):
        ids = [*library(row["text"]), 2]
        assert (have["doc_id"], have["start"], have["n_tokens"], have["ids_crc32"]) == (row["doc_id"], at, len(ids), crc(ids))
        at += len(ids)


def test_token_files_edges(spark, library):
    got = read_tokens(write_tokens(spark, edge_docs(spark), PATH, 2)).collect()
    assert sorted(repr((r["doc_id"], r["ids_crc32"])) for r in got) == sorted(
        repr((r[0], crc([*library(r[1]), 2]))) for r in edge_rows())
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(starts, starts[1:]))
    ids = [d for *_, d in starts if d is not None]
    assert ids == sorted(ids) and starts[0][2] is None
    assert read_tokens(write_tokens(spark, empty_docs(spark), PATH, 2)).count() == 0


def check_packing(rows, texts, library, capacity, slack=1.01):
    left = defaultdict(list)
    for doc, text in texts:
        ids = [*library(text), 0]
        head = len(ids) % capacity or capacity
        edges = [0, *range(head, len(ids) + 1, capacity)]
        left[doc] += [(k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    have, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        have[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: sorted(p) for d, p in have.items()} == {d: sorted(p) for d, p in left.items()}
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(n for parts in filled.values() for _, n in parts)
    assert len(filled) <= slack * -(-total // capacity) + 1


def test_packing(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = pack_documents(spark, docs, PATH).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], library, 2048, 1.02)


def test_packing_edges(spark, library):
    rows = pack_documents(spark, edge_docs(spark), PATH, capacity=64).collect()
    check_packing(rows, [(r[0], r[1]) for r in edge_rows()], library, 64, 1.1)
    assert pack_documents(spark, empty_docs(spark), PATH).count() == 0


@pytest.mark.parametrize("counts", [{}, {5: 1}, {2047: 3, 1: 7}, {1025: 10, 1023: 25, 3: 1000}, {k: 3 for k in range(1, 2048)}, {1: 5000}])
def test_plan_covers_every_rank_once(counts):
    plan, opened = sweep_plan(dict(counts), 2048)
    ranks = defaultdict(list)
    used = defaultdict(list)
    for length, rank, n, seq, offset in plan:
        ranks[length].append((rank, n))
        for s in range(seq, seq + n):
            used[s].append((offset, length))
    for length, n in counts.items():
        at = 0
        for rank, k in sorted(ranks[length]):
            assert rank == at
            at += k
        assert at == n
    assert len(used) == opened
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
