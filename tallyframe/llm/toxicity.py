"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is logistic in the words it has; a document's is the noisy-or of its
sentences, 1 - prod(1 - p). The weights are fitted to document labels alone, on a bounded sample of
labelled rows; what the sentences then score locates the offending ones.

Odd cases: null and empty texts have no sentence and score 0. Labels that are null are not used; a
document with several labels counts as toxic if one says so. If one of the two classes has no
labelled text, every score is 0. Columns of any other name pass through ``drop_toxic`` untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import hashed_pieces, hashed_sample, map_batches

TOXIC_SAMPLE = 2000  # at most so many labelled texts of each class are learned from
CLEAN_SAMPLE = 4000
SAMPLE_SENTENCES, SENTENCE_CHARS = 400, 1000  # of a text learned from, by hash where it has more; scoring reads all
STEM = 5  # characters that inflected forms of a word share
MIN_EVIDENCE = 15.0  # a word is learned if its G statistic against the labels is at least this
_BREAK = re.compile(r"[.!?\n\r]+")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each stretch between full stops, exclamation and question marks and line ends."""
    at = 0
    for mark in _BREAK.finditer(text):
        if mark.start() > at:
            yield at, mark.start()
        at = mark.end()
    if at < len(text):
        yield at, len(text)


def features(sentence: str) -> set[str]:
    """The words of a sentence, and the stems that stand for their inflections."""
    words = set(_WORD.findall(sentence.lower()))
    return words | {w[:STEM] + "~" for w in words if len(w) > STEM}


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    @cached_property
    def known(self) -> frozenset[str]:
        return frozenset(self.weights)

    def instances(self, text: str | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Sentences of a text and the logits of their probabilities."""
        known, spans, z = self.known, [], []
        for a, b in sentences(text or ""):
            if found := features(text[a:b]):
                spans.append((a, b))
                z.append(sum([self.weights[f] for f in sorted(found & known)]))
        return spans, np.clip(np.array(z) + self.bias, -60, 60)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """Noisy-or of a text's sentences, and those that offend: of probability 0.5 or more, else the highest if the text is toxic."""
        spans, z = self.instances(text)
        if not len(z):
            return 0.0, []
        whole = float(-np.expm1(-np.logaddexp(0, z).sum()))
        offending = [s for s, x in zip(spans, z.tolist(), strict=True) if x >= 0]
        return whole, offending or ([spans[int(z.argmax())]] if whole >= 0.5 else [])


NOTHING = Model(-60.0, {})


def telling_words(docs: Iterator[set[str]], y: np.ndarray) -> list[str]:
    """Words whose share of toxic texts differs from that of the others beyond chance."""
    spread = [Counter(), Counter()]
    for d, of in zip(docs, y.tolist(), strict=True):
        spread[of].update(d)
    words = sorted(w for w in set().union(*spread) if spread[0][w] + spread[1][w] >= 3)
    n = np.array([len(y) - y.sum(), y.sum()], float)
    have = np.array([[spread[c][w] for w in words] for c in (0, 1)], float).reshape(2, len(words))
    g = np.zeros(len(words))
    for seen, of in ((have, have.sum(0)), (n[:, None] - have, len(y) - have.sum(0))):
        expected = n[:, None] * of / len(y)
        g += 2 * (seen * np.log(np.where(seen > 0, seen, 1) / np.where(expected > 0, expected, 1))).sum(0)
    return [w for w, x in zip(words, g, strict=True) if x >= MIN_EVIDENCE]


def train(texts: list[str], toxic: list[int], rounds: int = 400, rate: float = 0.2, decay: float = 0.005) -> Model:
    """Fit by Adam on the noisy-or likelihood. Words are read twice, so that only numbers of the telling ones are held."""
    y = np.array(toxic)
    if not len(y) or y.min() == y.max():
        return NOTHING
    bags = lambda t: (features(t[a:b]) for a, b in sentences(t))
    index = {w: k for k, w in enumerate(telling_words((set().union(*bags(t)) for t in texts), y))}
    of_sentence, of_word, of_doc, n = [], [], [], 0
    for d, t in enumerate(texts):
        for bag in bags(t):
            known = sorted(index[w] for w in bag if w in index)
            of_word += known
            of_sentence += [n] * len(known)
            of_doc.append(d)
            n += 1
    of_sentence, of_word, of_doc = map(np.array, (of_sentence, of_word, of_doc))
    of_word, of_sentence = of_word.astype(np.int64), of_sentence.astype(np.int64)
    x = np.zeros(len(index) + 1)
    x[-1] = -5.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        z = np.clip(np.bincount(of_sentence, x[:-1][of_word], n) + x[-1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        missed = np.exp(-np.bincount(of_doc, np.logaddexp(0, z), len(y)))  # the probability of no toxic sentence
        slope = np.where(y == 1, -missed / np.maximum(1 - missed, 1e-9), 1.0) / len(y)
        g = p * slope[of_doc]
        grad = np.append(np.bincount(of_word, g[of_sentence], len(index)) + decay * x[:-1] / len(y), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return Model(float(x[-1]), {w: float(x[k]) for w, k in index.items() if abs(x[k]) > 0.01})


def trained(docs: DataFrame, labels: DataFrame, use: Column | None = None) -> Model:
    """A model of the labelled rows for which ``use`` (of ``doc_id``) holds, up to the sizes of the sample.

    Rows are taken in the order of a hash of their id. Ids are chosen before any text is read, and so
    few that they are broadcast.
    """
    truth = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    truth = truth.filter(use) if use is not None else truth
    truth = truth.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    toxic = hashed_sample(truth.filter("toxic = 1"), "toxic", "doc_id", TOXIC_SAMPLE)
    clean = hashed_sample(truth.filter("toxic = 0"), "toxic", "doc_id", CLEAN_SAMPLE)
    chosen = toxic.union(clean).select("doc_id", "toxic")
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    some = F.concat_ws("\n", hashed_pieces(F.col("text"), r"[^.!?\n\r]", SENTENCE_CHARS, SAMPLE_SENTENCES))
    rows = sorted(rows.select("doc_id", "toxic", some.alias("text")).collect(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])


def scored(docs: DataFrame, model: Model, passed: list[str]) -> DataFrame:
    """The columns ``passed``, score, predicted (1 from 0.5 on), and offending: the places of such sentences."""
    fields = [docs.schema[c] for c in passed]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType(
        [*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", T.ArrayType(span))]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [model.score(t) for t in batch.column("text").to_pylist()]
            scores = np.array([s for s, _ in found], float)
            spans = [[{"start": a, "end": b} for a, b in places] for _, places in found]
            made = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *made], [*passed, "score", "predicted", "offending"])

    return map_batches(docs.select(*dict.fromkeys([*passed, "text"])), score, schema)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t)[0] < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return map_batches(docs, keep, docs.schema)
