"""Exact, near and line deduplication against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import common, components, exact_dedup, line_dedup, queries, simhash
from tallyframe.session import cut_lineage
from tests.llm.conftest import SF, odd_texts


@pytest.mark.parametrize("block, hot", [(4096, 500), (7, 3)])
def test_exact_duplicates(spark, odd_docs, block, hot):
    rows = odd_texts() + [(100 + k, "same text", None, None, 1) for k in range(20)] + [(200, "same\n \ttext", None, None, 1)]
    docs = spark.createDataFrame([(a, b) for a, b, *_ in rows], "doc_id long, text string")
    found = exact_dedup.exact_duplicates(docs, block, hot).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    expected = defaultdict(int)
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = defaultdict(int)
    for r in found:
        got[r.doc_id, r.keep_id, r.group_size, r.text_sha256] += 1
    assert got == expected
    assert sum(r.kept for r in found) == len(groups)
    assert exact_dedup.exact_duplicates(odd_docs).count() == len(odd_texts())


def test_names_tell_contents_apart(spark):
    rows = [(k, 0, v) for k, v in enumerate(["a", "b", None, "a", None, "a"] + ["hot"] * 30)]
    named = exact_dedup.name_values(spark.createDataFrame(rows, "rid long, pos int, v string"), ["v"], hot_rows=4)
    of = defaultdict(set)
    for r in named.collect():
        of[rows[r.rid][2]].add(r["name"])
    assert all(len(names) == 1 for names in of.values())
    assert len(set.union(*of.values())) == 4


def test_contents_of_single_blocks_stay_where_they_are(spark, monkeypatch):
    moved, keep = [], exact_dedup.contents_of_repeats
    monkeypatch.setattr(exact_dedup, "contents_of_repeats", lambda *a: moved.append(keep(*a)) or moved[-1])
    rows = [(k, 0, f"only {k}") for k in range(200)] + [(200 + k, 0, "twice") for k in range(2)] + [(300, 0, None)]
    named = exact_dedup.name_values(spark.createDataFrame(rows, "rid long, pos int, v string"), ["v"]).collect()
    assert len({r["name"] for r in named}) == 202
    assert [r.v for r in moved[0].collect() if r.v] == ["twice"] * 2  # the bitmap may let some through, of so few it does not


def test_windows_are_counted_over_all_batches(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    rows = [(k, f"a passage that some texts share {' '.join(f'w{k}x{j}' for j in range(20))}") for k in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16, "doc_id")
    known, ranks = simhash._frequent_windows(docs, 5)
    assert set(known) == set(simhash.window_hashes("a passage that some texts share", 5))
    assert sorted(ranks) == [1, 2]


def test_only_rows_that_may_go_are_moved(spark, monkeypatch):
    moved, mark = [], common.marked_in_bitmap
    monkeypatch.setattr(common, "marked_in_bitmap", lambda *a: moved.append(mark(*a)) or moved[-1])
    rows = spark.createDataFrame([(k, f"{k}") for k in range(100)] + [(None, "none")], "_word long, text string")
    gone = spark.createDataFrame([(3,), (50,), (None,)], "_word long")
    left = common.without(rows, "_word", gone).collect()
    assert sorted((r["_word"] is None, r["_word"], r.text) for r in left if r["_word"] is not None) == sorted(
        (False, k, f"{k}") for k in range(100) if k not in (3, 50)
    )
    assert sum(r["_word"] is None for r in left) == 1  # as in any anti join, null is in no table
    assert moved[0].filter("likely").count() <= 3


def slow_print(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(ids_and_prints, far=3):
    parent = {k: k for k, _ in ids_and_prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(ids_and_prints, 2):
        if (x ^ y).bit_count() <= far:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in parent}


def test_near_duplicates(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = simhash.near_duplicates(docs).collect()
    prints = sorted((r.doc_id, slow_print(r.text)) for r in docs.collect())
    assert sorted((r.doc_id, int(r.fingerprint, 16)) for r in found) == prints
    assert {r.doc_id: r.component_id for r in found} == linked(prints)
    assert len(simhash.near_duplicates(odd_docs).collect()) == len(odd_texts())
    assert {r.component_id for r in simhash.near_duplicates(odd_docs).filter("doc_id < 4").collect()} == {1}


@pytest.mark.parametrize("chunk", [1024, 16])
def test_links_of_planted_families(spark, chunk):
    rng = random.Random(1)
    prints = []
    for _ in range(12):
        family = [rng.getrandbits(64)]
        for _ in range(40):
            bits = rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 5]))
            family.append(rng.choice(family) ^ sum(1 << b for b in bits))
        prints += family
    prints = sorted(set(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, _f0 long")
    labels = components.components(simhash.links(nodes, ["_f0"], chunk=chunk)).collect()
    got = defaultdict(set)
    for r in labels:
        got[r.label].add(r.node)
    expected = defaultdict(set)
    for k, root in linked(list(enumerate(prints))).items():
        expected[root].add(k)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 500 + k) for k in range(1, 100)] + [(900, 900)]
    labels = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({labels[k] for k in range(201)}) == 1
    assert len({labels[k] for k in range(500, 600)}) == 1
    assert len(set(labels.values())) == 2


def test_drop_near_duplicates(spark, odd_docs, no_docs):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(4000)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(40)]
    rows, changed = [], []
    for k, text in enumerate(base):
        near = list(text)
        for at in rng.sample(range(400), 3):
            near[at] = rng.choice(words)
        rows += [(k, " ".join(text)), (100 + k, " ".join(text)), (200 + k, " ".join(near))]
        changed.append(200 + k)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(40)) <= kept and not kept & set(range(100, 140))
    assert len(kept & set(changed)) <= 4  # 96 % of their windows are the same
    out = simhash.drop_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    kept = sorted(r.doc_id or 0 for r in out.collect())
    assert kept == [0, 1, 4, 5, 6, 8, 9]  # 2 and 3 are as empty as 1; the long text of 7 is that of 6
    assert simhash.drop_near_duplicates(no_docs).collect() == []
    assert simhash.near_duplicates(no_docs).collect() == []
    assert exact_dedup.exact_duplicates(no_docs).collect() == []


def test_all_pairs_of_the_stated_similarity_are_linked(spark):
    rng = random.Random(8)
    words = [f"word{k}" for k in range(4000)]
    rows, passage = [], [rng.choice(words) for _ in range(60)]
    for k in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(3, 400))]
        rows.append((3 * k, text))
        for copy in (1, 2):  # from 60 to 100 % of windows in common
            near = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 20))):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((3 * k + copy, near + (passage if rng.random() < 0.2 else [])))
    sets = {i: {tuple(t[a : a + 5]) for a in range(max(1, len(t) - 4))} for i, t in rows}
    first = {i: i for i in sets}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if alike(a, b)]
    assert sum(5 * len(sets[a] & sets[b]) < 4.5 * len(sets[a] | sets[b]) for a, b in links) > 20
    for _ in range(5):  # links chain
        for a, b in links:
            first[a] = first[b] = min(first[a], first[b])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {i for i in first if first[i] == i}


def test_parities_never_claim_more_differences_than_there_are():
    rng = np.random.default_rng(5)
    for _ in range(300):
        both = rng.integers(0, 2**63, int(rng.integers(0, 900)), np.uint64)
        own = [rng.integers(0, 2**63, int(rng.integers(0, 300)), np.uint64) for _ in range(2)]
        x, y = (np.unique(np.concatenate([both, o])) for o in own)
        bound = simhash.least_difference(simhash.window_parity(x), simhash.window_parity(y))
        assert bound <= len(np.setxor1d(x, y)) and (len(own[0]) + len(own[1]) or not bound)
    # Long sets are told apart as well as short ones: a quarter of 5000 windows differs.
    x, y = (rng.integers(0, 2**63, 5000, np.uint64) for _ in range(2))
    y[:3500] = x[:3500]
    assert simhash.least_difference(simhash.window_parity(x), simhash.window_parity(y)) > 10000 - 2 * np.ceil(4 / 9 * 10000)


def slow_lines(rows, similarity=0.8):
    seen, out = [], {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        out[doc_id] = []
        for pos, line in enumerate((text or "").split("\n")):
            words = set(line.split())
            if not words:
                continue
            if any(len(words & s) >= similarity * len(words | s) - 1e-9 for s in seen):
                out[doc_id].append(pos)
            if words not in seen:
                seen.append(words)
    return out


def many_lines():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["the", "of"] * 5
    line = lambda: [rng.choice(words) for _ in range(rng.randint(3, 14))]
    base = [line() for _ in range(60)]
    rows = []
    for doc_id in range(300):
        lines = []
        for _ in range(rng.randint(0, 5)):
            made = list(rng.choice(base)) if rng.random() < 0.6 else line()
            for _ in range(rng.randint(0, 2)):
                made[rng.randrange(len(made))] = rng.choice(words)
            lines.append(" ".join(made))
        rows.append((doc_id, "\n".join(lines)))
    return [*rows, (300, None)]


def test_repeated_lines(spark):
    rows = many_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = slow_lines(rows)
    report = line_dedup.line_report(docs).collect()
    assert {r.doc_id: r.removed for r in report} == expected
    assert {r.doc_id: r.n_lines for r in report} == {d: 0 if t is None else t.count("\n") + 1 for d, t in rows}
    texts = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    for doc_id, text in rows:
        left = text and "\n".join(x for k, x in enumerate(text.split("\n")) if k not in expected[doc_id])
        assert texts.get(doc_id) == left or (doc_id not in texts and expected[doc_id] and not left.strip())


def test_short_lines_of_the_query(spark, tmp_path):
    rows = [
        (1, "All rights reserved.\n这是一行没有空格的文字\n\none two three four"),
        (2, "一行\nAll rights reserved.\n这是一行没有空格的文字\n"),
        (3, "one two three four five\nfour three two one\none two three\n \none two four"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.removed for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {1: [], 2: [1, 2], 3: [0, 1]}  # four words in five are 0.8 alike, three in four are not


def test_lines_of_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = slow_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.removed for r in line_dedup.line_report(docs).collect()} == expected


def test_lines_of_odd_documents(spark, odd_docs, no_docs):
    report = line_dedup.line_report(odd_docs).select("doc_id", "removed").collect()
    assert len(report) == len(odd_texts())
    assert [r.removed for r in report if r.doc_id == 4] == [[], []]  # rows that repeat id and text are one document
    assert [0, 1] in [r.removed for r in report if r.doc_id == 5]
    out = line_dedup.drop_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.filter(F.col("doc_id") == 5).count() == 1 and out.filter(F.col("doc_id") < 4).count() == 3
    assert line_dedup.line_report(no_docs).collect() == line_dedup.drop_repeated_lines(no_docs).collect() == []


def test_chains_link_near_duplicates_of_the_pipeline(spark, monkeypatch):
    """SimHash chains alone find texts within three bits; the join over windows then finds what is left, and no chained text is verified away."""
    rng, words, rows, far = random.Random(11), [f"w{i}" for i in range(3000)], [], 0
    for k in range(30):
        text = [rng.choice(words) for _ in range(400)]
        near = [*text[:-1], "changed"]
        bits = [simhash.fingerprint(" ".join(t), 5)[0] for t in (text, near)]
        far += (bits[0] ^ bits[1]).bit_count() > 3
        rows += [(k, " ".join(text)), (100 + k, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(range(30))
    none = lambda rows, *_: rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    monkeypatch.setattr(simhash, "_candidates", none)
    assert far < 30 and simhash.drop_near_duplicates(docs).count() == 30 + far


def test_verifying_moves_only_classes_in_pairs(spark, monkeypatch):
    """What is joined to the pairs are the few classes that they name, not all."""
    rows = [(k, f"word{k} other{k} third{k} fourth{k} fifth{k}") for k in range(400)] + [(1000 + k, f"word{k} other{k} third{k} fourth{k} fifth{k} {'x' if k < 5 else 'y z w v u'}") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup._lines(docs, 0.8, 1).withColumn("class", F.col("doc_id"))
    pairs = spark.createDataFrame([(1000 + k, k, False) for k in range(10)], "late long, early long, more boolean")
    seen = []
    thin = line_dedup.rows_in_bitmap
    monkeypatch.setattr(line_dedup, "rows_in_bitmap", lambda rows, key, needed: seen.append(thin(rows, key, needed)) or seen[-1])
    found = {(r["late"], r["match"]) for r in line_dedup._verified(docs, pairs, lines, 0.8, 1).collect()}
    assert found == {(1000 + k, k < 5) for k in range(10)}
    assert 20 <= seen[0].count() < 30


def test_frequent_words_by_bytes_and_white_space(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARE", 1000)
    texts = ["b a\x0ba\x0c a\r\n", None, "", " \t", "é\xa0x é\xa0x é\xa0x", "once a b"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert line_dedup.frequent_words(docs) == {b"a": 3, "é\xa0x".encode(): 2, b"b": 1}


def test_batches_are_cut(monkeypatch):
    monkeypatch.setattr(common, "ROWS_AT_ONCE", 3)
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (7, 0, 3)]
    assert [b.column(0).to_pylist() for b in common.in_slices(batches)] == [[0, 1, 2], [3, 4, 5], [6], [0, 1, 2]]


def line_classes(spark, sets, similarity=0.8):
    docs = spark.createDataFrame([(k, " ".join(sorted(x))) for k, x in enumerate(sets)], "doc_id long, text string").coalesce(1)
    lines = line_dedup._numbered_lines(cut_lineage(line_dedup._lines(docs, similarity, 1)))
    fold = {c: F.col(x).bitwiseXOR(F.col(y)) for x, y, c in (("p0", "p2", "even"), ("p1", "p3", "odd"))}
    return cut_lineage(lines.withColumns({**fold, "asks": F.lit(True)}))


def test_prefixes_travel_in_few_rows_and_lose_no_pair(spark, monkeypatch):
    """Words of prefixes are dealt out by buckets, many in a row; frequent ones are split, and all similar pairs still meet."""
    rng = random.Random(3)
    sets = [set(rng.sample([f"w{k}" for k in range(40)], rng.randint(1, 30))) for _ in range(150)]
    sets += [x ^ {rng.choice("w1 w2 w3 other new".split())} or {"w"} for x in sets]
    rows = line_classes(spark, sets)
    number = {r["doc_id"]: r["class"] for r in rows.collect()}
    similar = {(number[i], number[j]) for i in range(300) for j in range(i) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    assert len(similar) > 100 and sorted(number, key=number.get) == sorted(number)
    dealt, entries = [], line_dedup._entries
    monkeypatch.setattr(line_dedup, "_entries", lambda rows, function, schema: dealt.append(entries(rows, function, schema)) or dealt[-1])
    assert similar <= {(r["late"], r["early"]) for r in line_dedup._candidates(rows, 0.8, True).collect()}
    words = rows.agg(F.sum(F.size("prefix"))).first()[0]
    assert dealt[-1].count() < words / 10
    monkeypatch.setattr(line_dedup, "CHUNK", 20)
    assert line_dedup._hot(rows)
    assert similar <= {(r["late"], r["early"]) for r in line_dedup._candidates(rows, 0.8, True).collect()}


def test_word_hashes_follow_the_bytes_alone():
    words = [b"", b"a", b"a\x00", b"12345678", b"123456789", b"12345678\x00", b"x" * 256, b"x" * 257, "\u00e9\u8fd9".encode()]
    one, two = line_dedup.word_hashes(pa.array(words, pa.large_binary()))
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words)
    again = line_dedup.word_hashes(pa.array([b"filler", *words[::-1]], pa.large_binary())[1:])
    assert again[0][::-1].tolist() == one.tolist() and again[1][::-1].tolist() == two.tolist()


def test_no_word_of_a_batch_is_asked_for(spark):
    rows = line_classes(spark, [{"a", "b", "c", "d", "e"}, {"a", "b", "c", "d"}])
    assert line_dedup._candidates(rows, 0.8, True, np.zeros(1 << 10, bool)).collect() == []
    assert len(line_dedup._candidates(rows, 0.8, True, np.ones(1 << 10, bool)).collect()) == 1


def test_words_of_all_documents_are_ranked(spark):
    """Each document has a word of its own in all its lines; it stands behind the rare ones, so it is in no prefix."""
    rows = [(d, "\n".join(" ".join([f"own{d}", *(f"w{d}x{k}x{j}" for j in range(7))]) for k in range(10))) for d in range(24)]
    lines = line_dedup._lines(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, 1).collect()
    own = (line_dedup.word_hashes(pa.array([f"own{d}" for d in range(24)], pa.large_string()))[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    assert len(lines) == 240 and all(r.n == 8 and len(r.prefix) == 2 for r in lines)
    assert [(r.doc_id, r.pos) for r in lines if int(own[r.doc_id]) in r.prefix] == []


def test_windows_of_all_texts_are_ranked(spark, monkeypatch):
    """The most frequent windows by brute force, from whichever texts, and also if a slot that was left out could hold one."""
    words = [f"a{k} b{k} c{k} d{k} e{k}" for k in range(40)]
    rows = [(100 * k + j, f"{words[k]} {' '.join(f'w{k}x{j}x{i}' for i in range(9))}") for k in range(40) for j in range(2 + k % 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = {int(simhash.window_hashes(w, 5)[0]): 2 + k % 3 for k, w in enumerate(words)}
    known, ranks = simhash._frequent_windows(docs, 5)
    assert sorted(map(int, known)) == sorted(n) and list(known) == sorted(known)
    by_rank = [n[int(w)] for w in known[np.argsort(ranks)]]
    assert by_rank == sorted(by_rank) and sorted(ranks) == list(range(1, 41))
    monkeypatch.setattr(simhash, "BUCKET_BITS", 0)
    monkeypatch.setattr(simhash, "SLOT_BITS", 8)
    monkeypatch.setattr(simhash, "KEPT", 3)
    monkeypatch.setattr(simhash, "FREQUENT", 20)
    slots, left = simhash._frequent_slots(docs.select("text"), 5)
    assert len(slots) == 3 and left > 1
    known, ranks = simhash._frequent_windows(docs, 5)
    assert sorted((n[int(w)] for w in known), reverse=True) == sorted(n.values(), reverse=True)[:20]
