"""Encoding, decoding and packing against the tokenizers library and by exact round trip."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import bpe, packing
from tests.llm.conftest import SF, odd_texts


@pytest.fixture(scope="module")
def library(tokenizer_path):
    return Tokenizer.from_file(tokenizer_path)


@pytest.fixture(scope="module")
def own(tokenizer_path):
    return bpe.WordBpe(tokenizer_path)


def same(own, library, texts):
    for text, raw in zip(texts, own.encode_all(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == expected, text[:100]
        assert own.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_every_plain_character(own, library):
    plain = [chr(c) for c in range(0x2100) if bpe._PLAIN.fullmatch(chr(c))]
    assert len(plain) > 300
    same(own, library, [t for c in plain for t in (c, f"a{c}b {c}{c} Z{c}", f"'S{c}1{c}{c.upper()}x")])


def test_texts_of_all_kinds(own, library, monkeypatch):
    rng = random.Random(0)
    letters = "abcdeéêßñ'thinerst .,!"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    odd = [t for _, t, *_ in odd_texts() if t] + ["", "aaaaaaa aaaa aaa", "<|endoftext|>A<|startoftext|><|endoftext|> b I'LL", "x\x85y\x1cz　w"]
    same(own, library, made + odd)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 50)
    monkeypatch.setattr(bpe, "TOGETHER_CHARS", 300)
    same(own, library, made + odd)


def test_only_failing_words_are_merged(own, library):
    fresh = bpe.WordBpe.__new__(bpe.WordBpe)
    fresh.__dict__.update(own.__dict__, known={}, chunks={}, older={}, failed=0)
    same(fresh, library, ["the cat sat on the mat and was happy"])
    assert fresh.failed < len(fresh.known)
    before = fresh.failed
    same(fresh, library, ["thereof thinherst eringtionst"])
    assert fresh.failed >= before


def test_round_trip(spark, tokenizer_path, library, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.round_trip(docs, tokenizer_path).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(odd_docs, tokenizer_path).count() == len(odd_texts())
    assert bpe.encoded(odd_docs, tokenizer_path).filter("doc_id < 4").select(F.max(F.length("ids"))).first()[0] == 0
    assert bpe.round_trip(no_docs, tokenizer_path).collect() == []


def check_pieces(pieces, expected, length=2048):
    """Each id lies in one piece, sequences have no gap and all but the last are full."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(expected)
    for doc_id, own in by_doc.items():
        ids = b"".join(bytes(p.ids) for p in sorted(own, key=lambda p: (p.start, p.sequence_id)))
        assert ids == expected[doc_id] and {p.doc_tokens for p in own} == {len(ids) // 4}
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4 > 0
            at += p.length
        assert at <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(sum(p.length for p in own) < length for own in by_sequence.values()) <= 1


@pytest.mark.parametrize(
    "partitions, window, targets",
    [(1, packing.WINDOW, None), (5, 8192, None), (3, 8192, {"src1": 10**9, "src2": 0, "src3": 5}), (2, 100, {"src0": 1})],
)
def test_packing(spark, tokenizer_path, library, partitions, window, targets):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(partitions)
    expected = {
        r.doc_id: np.array(library.encode(r.text, add_special_tokens=False).ids + [1], "<u4").tobytes() for r in docs.collect()
    }
    pieces = packing.pack(docs, tokenizer_path, window=window, targets=targets).collect()
    check_pieces(pieces, expected)
    if targets is None:
        totals, windows = Counter(), defaultdict(Counter)
        for p in pieces:
            totals[p.source] += p.length
            windows[p.window_id][p.source] += p.length
        every, last = sum(totals.values()), max(windows)
        for w, counts in windows.items():
            if w < last:
                assert all(abs(counts[s] - window * n / every) <= 1 for s, n in totals.items())


def test_schedule_of_sources_that_run_out():
    plan = packing.Schedule([1000, 50, 0, 333], [1, 1, 5, 2], window=100)
    for s, total in enumerate(plan.totals):
        counts = [plan.served(s, w) for w in range(plan.windows + 1)]
        assert counts == sorted(counts) and counts[0] == 0 and counts[-1] == total
    assert [plan.served(s, 1) for s in range(4)] == [25, 25, 0, 50]
    assert all(sum(plan.served(s, w) for s in range(4)) <= 100 * w for w in range(plan.windows + 1))


def test_packing_odd_documents(spark, tokenizer_path, odd_docs, no_docs):
    pieces = packing.pack(odd_docs, tokenizer_path).collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert sum(p.start == 0 for p in pieces) == len(odd_texts())
    assert [p.length for p in pieces if p.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert {p.source for p in pieces} == {"a", "b", None}
    assert packing.pack(no_docs, tokenizer_path).collect() == []
    assert zlib.crc32(bytes(next(p.ids for p in pieces if p.doc_id == 2))) == zlib.crc32((1).to_bytes(4, "little"))


def test_a_worker_remembers_words_alone(own, library, monkeypatch):
    """What stands between white space is encoded once in a group of texts and not kept."""
    monkeypatch.setattr(bpe, "KEPT_WORDS", 100)
    monkeypatch.setattr(bpe, "TOGETHER_CHARS", 300)
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 1000)
    fresh = bpe.WordBpe.__new__(bpe.WordBpe)
    fresh.__dict__.update(own.__dict__, known={}, chunks={}, older={}, failed=0)
    same(fresh, library, [f"a{chr(97 + k % 26)}{chr(97 + k // 26)}, don't {k}%% \n{k}" * 3 for k in range(400)])
    assert sum(len(d) for d in (fresh.known, fresh.older, fresh.chunks)) < 400


def test_groups_are_spread():
    made = bpe.spread(np.array([5, 6, 7, 8]), np.array([1, 0, 3]), np.array([2, 1, 0, 2, 0]))
    assert made.tolist() == [6, 7, 8, 5, 6, 7, 8, 5]
