"""Periodic runs against a search that tries every period at every place."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import queries, runs
from tests.llm.conftest import SF


def brute(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def by_sequence(sequences, least=12):
    out = [[] for _ in sequences]
    for which, *run in zip(*[x.tolist() for x in runs.find_runs([np.array(s, np.int64) for s in sequences], least)], strict=True):
        out[which].append(tuple(run))
    return out


def test_cover_meets_each_pair():
    for i in range(runs.STEP):
        for j in range(runs.STEP):
            d = runs._SYNC[i, j]
            assert runs.FIRST <= d < runs.FIRST + runs.STEP
            assert (i + d) % runs.STEP in runs.COVER and (j + d) % runs.STEP in runs.COVER


def test_runs_of_many_sequences_at_once():
    rng = random.Random(3)
    sequences = [[], [0], [0] * 11, [0] * 12, [0] * 500, [0] * 500, list(range(100))]
    for _ in range(150):
        n, letters = rng.choice([12, 13, 40, 120, 400]), rng.choice([1, 2, 2, 3, 20])
        own = [rng.randrange(letters) for _ in range(n)]
        p, at = rng.randrange(1, n // 2), rng.randrange(n // 2)
        sequences.append(own[:at] + [own[at + k % p] for k in range(rng.randrange(n))] + own[at:])
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    sequences += [fibonacci[-1], fibonacci[-1]]
    assert by_sequence(sequences) == [brute(s) for s in sequences]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), max_size=4), st.sampled_from([2, 5, 12]))
def test_runs_of_any_sequences(sequences, least):
    assert by_sequence(sequences, least) == [brute(s, least) for s in sequences]


def test_a_long_document():
    rng = random.Random(5)
    block = [rng.randrange(1000) for _ in range(7000)]
    words = block + block + block[:500] + [1, 2] * 3000
    found = by_sequence([words])[0]
    assert (0, 14_500, 7000) in [(s, min(n, 14_500), q) for s, n, q in found if q == 7000]
    assert any(q == 2 and n >= 6000 for _, n, q in found)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op11_runs(spark, SF).collect())) == sorted(expected(*d) for d in docs)


def test_odd_documents(spark, odd_docs, no_docs):
    found = runs.runs_of(odd_docs).collect()
    rows = odd_docs.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    short = [r for r in rows if len((r["text"] or "").split()) < 1000]
    want = sorted((str(r["doc_id"]), brute((r["text"] or "").encode().split())) for r in short)
    long = {6, 7}
    assert sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]]) for r in found if r["doc_id"] not in long) == want
    assert runs.runs_of(no_docs).collect() == []
    looped = spark.createDataFrame([(1, "go on " * 20_000), (2, None)], "doc_id long, text string")
    first, second = sorted(runs.runs_of(looped).collect())
    assert [tuple(r) for r in first["runs"]] == [(0, 40_000, 2)] and first["collapsed"] == "go on"
    assert second["runs"] == [] and second["collapsed"] == ""
