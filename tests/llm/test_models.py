"""Language, toxicity and quality: held-out accuracy, planted cases and counts by brute force."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import language, quality, queries, toxicity
from tallyframe.llm.common import bucket_of_id, hashed_sample, table
from tests.llm.conftest import odd_texts

SF01 = "/root/testdata/sf0.01"


# -- language -------------------------------------------------------------------------------------
def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in table(spark, SF01, "documents").collect()}
    rows = queries.op4_language(spark, SF01).collect()
    held_out = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 0.2 < len(held_out) / len(rows) < 0.5
    assert sum(r.lang_pred == truth[r.doc_id] for r in held_out) / len(held_out) > 0.97
    assert all(0 <= r.score <= 1 and r.lang_pred in set(truth.values()) for r in rows)
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_language_of_odd_documents(spark, odd_docs, no_docs):
    model = language.trained(odd_docs)
    assert model.languages == ["en", "de"]
    rows = {r.doc_id: r for r in language.predicted(odd_docs, model, ["doc_id"]).collect()}
    assert all((rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3))
    assert rows[6].lang_pred == "en" and rows[8].lang_pred == "de"
    kept = language.drop_unclear(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id < 4").count() == 0
    nothing = language.trained(no_docs)
    assert {r.lang_pred for r in language.predicted(odd_docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert language.drop_unclear(no_docs, model).collect() == []


def test_shared_lines_tell_no_language():
    licence = "this text is under a licence that everyone knows by heart"
    common = {language.letters(licence)}
    assert language.letters(licence) not in language.dictionary([f"{licence}\nmore words of its own"], common)


def test_languages_of_copies_and_of_shared_lines(spark):
    lines = {
        "en": ["the house by the river is old", "we went there with our friends", "nothing was left of the bread", "she told them what had happened"],
        "de": ["das haus am fluss ist sehr alt", "wir gingen mit unseren freunden hin", "vom brot war nichts mehr da", "sie sagte ihnen was geschehen war"],
    }
    french = "la maison au bord de la rivière est vieille\nnous y sommes allés avec nos amis\nil ne restait rien du pain"
    rows = [(k, "\n".join(x), of) for of, all_lines in lines.items() for k, x in enumerate(zip(all_lines, all_lines[1:], strict=False))]
    rows = [(10 * n, text, of) for n, (_, text, of) in enumerate(rows)] + [(1000 + k, french, "fr") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.predicted(docs, language.trained(docs), ["doc_id", "lang"]).collect()
    assert all(r.lang_pred == r.lang and not r.rejected for r in found)
    same = spark.createDataFrame([(k, french, of) for k, of in enumerate(["fr", "de", "en", "fr"])], "doc_id long, text string, lang string")
    model = language.trained(same)
    assert model.languages == ["fr", "de", "en"] and all(b"maison" in x for x in model.dictionaries)


def test_training_reads_the_ends_of_long_texts(spark):
    """What tells a language or a label apart stands after a hundred thousand characters that all texts have in common."""
    head = "\n".join(f"{k} " + "gemeinsam " * 20 for k in range(9))  # pieces of letters alone are the same line
    tails = {"en": "the quick brown fox jumps over the lazy dog", "de": "zwölf boxkämpfer jagen viktor quer über den deich"}
    rows = [(k, f"{head}\n{tails[of]} {k}", of) for k in range(20) for of in [["en", "de"][k % 2]]]
    model = language.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    by_language = dict(zip(model.languages, model.dictionaries, strict=True))
    assert b"jumps over" in by_language["en"] and "über den deich".encode() in by_language["de"]
    calm = ". ".join(f"sentence {k} of a long and calm text with nothing in it" for k in range(390))
    texts = [(k, calm + (". you rotter" if k % 3 == 0 else ". you friend")) for k in range(90)]
    assert min(len(t) for _, t in texts) > 20_000
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)], "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    assert model.score("what a day. you rotter!")[0] >= 0.5 > model.score("what a day. you friend!")[0]


def test_samples_by_hash(spark):
    rows = spark.range(50_000).select((F.col("id") % 3 == 0).cast("string").alias("g"), F.col("id").alias("k"))
    found = hashed_sample(rows, "g", "k", 300)
    ordered = sorted((r.g, r.h, r.k) for r in rows.withColumn("h", F.xxhash64("k")).collect())
    groups = {g: [k for of, _, k in ordered if of == g][:300] for g in ("false", "true")}
    assert sorted((r.g, r.k) for r in found.collect()) == sorted((g, k) for g, ks in groups.items() for k in ks)
    assert hashed_sample(rows.limit(0), "g", "k", 300).collect() == []


# -- toxicity -------------------------------------------------------------------------------------
def planted(n, seed):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(400)]
    texts, labels, places = [], [], []
    for _ in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(10)) for _ in range(rng.randint(2, 15))]
        bad = rng.random() < 0.3
        at = rng.randrange(len(lines))
        if bad:
            lines[at] += " " + rng.choice(["rotter", "swine", "knaves"])
        texts.append(". ".join(lines))
        labels.append(int(bad))
        places.append(lines[at] if bad else None)
    return texts, labels, places


def test_sentences_are_located_from_document_labels():
    model = toxicity.train(*planted(600, 1)[:2])
    texts, labels, places = planted(300, 2)
    right = located = 0
    for text, label, place in zip(texts, labels, places, strict=True):
        score, spans = model.score(text)
        right += (score >= 0.5) == bool(label)
        located += bool(label) and [text[a:b].strip() for a, b in spans] == [place]
    assert right >= 295 and located >= 0.95 * sum(labels)


def test_noisy_or():
    model = toxicity.Model(-1.0, {"bad": 2.0, "worse": 3.0})
    p = [1 / (1 + np.exp(-z)) for z in (-1.0, 1.0, 4.0)]
    assert model.score("fine. bad! bad worse\n...")[0] == pytest.approx(1 - np.prod([1 - x for x in p]))
    assert model.score(None) == model.score(" .. \n") == (0.0, [])
    assert toxicity.train(["a b c"] * 3, [1, 1, 1]) is toxicity.NOTHING


def test_toxicity_of_tables(spark, odd_docs, no_docs):
    labels = table(spark, SF01, "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = queries.op9_toxicity(spark, SF01).collect()
    counts = collections.Counter((r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth)
    assert counts[1, 0] <= 1 and counts[0, 0] >= 60 and counts[1, 1] >= 4
    assert all(0 <= r.score <= 1 for r in rows)
    docs = table(spark, SF01, "documents")
    model = toxicity.trained(docs, labels)
    assert toxicity.scored(odd_docs, model, ["doc_id"]).count() == len(odd_texts())
    kept = toxicity.drop_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id < 4").count() == 3
    assert toxicity.trained(docs, labels.limit(0)) is toxicity.NOTHING
    assert toxicity.drop_toxic(no_docs, model).collect() == []


# -- quality --------------------------------------------------------------------------------------
def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = collections.Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark, odd_docs, no_docs):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    texts = {r.doc_id: r.text for r in table(spark, SF01, "documents").collect()}
    rows = queries.op10_quality(spark, SF01).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in columns) == slow_counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    odd = quality.judge(odd_docs).collect()
    expected = sorted(slow_counts(t) for _, t, *_ in odd_texts())
    assert sorted(tuple(r[c] for c in columns) for r in odd) == expected
    assert quality.judge(no_docs).collect() == []


def test_junk_goes_and_the_rest_stays(spark):
    quality_of = {r.doc_id: r.quality for r in table(spark, SF01, "labels").collect()}
    judged = [r for r in queries.op10_quality(spark, SF01).collect() if not r.base_failed]
    counts = collections.Counter((r.kept, quality_of.get(r.doc_id)) for r in judged)
    assert counts[False, 1] <= 0.01 * counts[True, 1]
    assert counts[True, 0] <= 0.1 * counts[False, 0]


def test_repeated_lines_and_windows_are_outliers(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    lines = lambda n: [" ".join(rng.choice(words) for _ in range(10)) for _ in range(n)]
    texts = {k: lines(rng.randint(15, 25)) for k in range(300)}
    for k in range(300, 310):  # nearly half of the lines are copies of a short one
        texts[k] = [y for x in lines(12) for y in (x, "next part")]
    for k in range(310, 320):  # a third of the words lies in windows that are found again, no line does
        made = lines(20)
        again = " ".join(made[0].split()[:5])
        texts[k] = [f"{again} {' '.join(x.split()[:5])}" if n < 14 else x for n, x in enumerate(made)]
    for k in range(320, 330):  # a single copy of a short line
        made = lines(24)
        texts[k] = [*made, "end of part", "end of part"]
    rows = [(k, "\n".join(x), "en", "a") for k, x in texts.items()]
    judged = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(judged[k].base_failed for k in texts)
    assert not any(judged[k].kept for k in range(300, 320))
    assert all(judged[k].kept for k in range(320, 330))
    assert sum(judged[k].kept for k in range(300)) >= 290


def slow_precision(cov):
    """The inverse of a covariance whose Cholesky pivots are at least the floors."""
    low = np.zeros((4, 4))
    for j in range(4):
        low[j, j] = max(cov[j, j] - (low[j, :j] ** 2).sum(), quality.FLOORS[j] ** 2) ** 0.5
        for i in range(j + 1, 4):
            low[i, j] = (cov[i, j] - (low[i, :j] * low[j, :j]).sum()) / low[j, j]
    return np.linalg.inv(low @ low.T)


def slow_estimate(x):
    """Centre and precision by concentration and reweighting, with the operator's bins."""
    middle = lambda v: np.sort(v)[(len(v) + 1) // 2 - 1]
    m = np.array([middle(x[:, k]) for k in range(4)])
    p = slow_precision(np.diag([(1.4826 * middle(abs(x[:, k] - m[k]))) ** 2 for k in range(4)]))
    for step in range(quality.STEPS + quality.REWEIGHTED):
        d2 = np.einsum("ni,ij,nj->n", x - m, p, x - m)
        at = np.floor(32 * np.log2(d2 + 1e-6))
        near = at <= np.sort(at)[int(np.ceil(quality.BULK * len(x))) - 1]
        late = step >= quality.STEPS
        of = x[near | (d2 <= quality.WITHIN)] if late else x[near]
        m, p = of.mean(0), slow_precision(np.cov(of.T, bias=True) * (quality.CONSISTENT_WITHIN if late else quality.CONSISTENT))
    return m, p


def slow_verdicts(docs, precision=None):
    """Per row (text, lang, source): whether it is kept, by numpy from the counts on."""
    counts = [slow_counts(t) for t, _, _ in docs]
    names = [(lang, source) for _, lang, source in docs]
    sizes = collections.Counter(n for n, c in zip(names, counts, strict=True) if not c[-1])
    groups = collections.defaultdict(list)
    for k, c in enumerate(counts):
        if not c[-1]:
            groups[names[k] if sizes[names[k]] >= quality.LEAST_GROUP else None].append(k)
    kept = [False] * len(docs)
    for members in groups.values():
        x = []
        for k in members:
            n, chars, symbols, dup, repeat, _ = counts[k]
            lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", y)) for y in docs[k][0].split("\n"))
            x.append([np.log(chars / n), ((symbols + 0.375) / (n + 0.75)) ** 0.5, ((repeat + 24) / (n + 48)) ** 0.5, ((dup + 1) / (lines + 2)) ** 0.5])
        x = np.array(x)
        m, p = slow_estimate(x)
        p = p if precision is None else precision
        d2 = np.einsum("ni,ij,nj->n", x - m, p, x - m)
        at = np.sort(np.floor(32 * np.log2(d2 + 1e-6)))
        scale = max(1.0, 2 ** ((at[int(np.ceil(0.5 * len(x))) - 1] + 1) / 32) / quality.MEDIAN)
        for k, v in zip(members, d2 / scale, strict=True):
            kept[k] = bool(v <= quality.CUTOFF)
    return kept


def test_estimates_against_numpy(spark):
    """Concentration and reweighting by brute force from the same start, with the same bins."""
    rng = np.random.default_rng(4)
    cov = np.array([[1, 0.5, 0, 0], [0.5, 1, 0, 0], [0, 0, 2, 0.3], [0, 0, 0.3, 1]])
    good = rng.multivariate_normal([0, 1, 2, 3], cov, 900)
    x = np.concatenate([good, rng.normal(12, 0.5, (100, 4))])
    rows = [("g", *map(float, v)) for v in x]
    found = quality.estimates(spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double")).first()
    m, p = slow_estimate(x)
    assert [found[f"m{k}"] for k in range(4)] == pytest.approx(m.tolist(), abs=1e-6)
    assert [found[f"p{i}{j}"] for i in range(4) for j in range(i, 4)] == pytest.approx([p[i, j] for i in range(4) for j in range(i, 4)], abs=1e-6)
    assert np.abs(m - [0, 1, 2, 3]).max() < 0.2  # the far tenth has not moved the centre
    assert np.abs(np.linalg.inv(p) - cov).max() < 0.3  # nor the covariance


def test_verdicts_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text, r.lang, r.source) for r in table(spark, sf, "documents").collect())
    kept = {r.doc_id: r.kept for r in queries.op10_quality(spark, sf).collect()}
    assert [kept[d] for d, *_ in docs] == slow_verdicts([x[1:] for x in docs])


def test_correlated_outliers_need_the_covariance(spark):
    """Symbols grow with the length of words; documents that break this rule are ordinary in every single statistic."""
    rng = random.Random(3)

    def text(long, symbols):
        words = [f"{rng.randrange(10**5):05d}" + "x" * (rng.random() < long) * 6 for _ in range(190)]
        return " ".join(words + ["$" * symbols]) if symbols else " ".join(words)

    texts = [text(a, int(60 * a)) for a in (rng.random() for _ in range(300))]
    texts += [text(0.05, 55) for _ in range(6)] + [text(0.95, 3) for _ in range(6)]
    docs = [(t, "en", "a") for t in texts]
    rows = [(k, *d) for k, d in enumerate(docs)]
    judged = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [judged[k] for k in range(len(docs))] == slow_verdicts(docs)
    assert not any(judged[k] for k in range(300, 312))
    assert sum(judged[k] for k in range(300)) >= 285
    floors = slow_verdicts(docs, np.diag(1 / np.square(quality.FLOORS)))
    assert sum(floors[k] != judged[k] for k in range(312)) >= 12


def test_training_rows(spark):
    ids = table(spark, SF01, "documents").select("doc_id", bucket_of_id(F.col("doc_id"), 3).alias("b")).collect()
    import zlib

    assert all(r.b == zlib.crc32(str(r.doc_id).encode()) % 3 for r in ids)
