"""Language ID by compression: the language whose dictionary compresses a text best.

Each language has a raw-content dictionary for zstandard, made of labelled texts. A text is reduced to
its lower-case letters and compressed in short pieces, so that in long texts too it is the dictionary
that helps and not what came before. The smallest sum of sizes wins; where the second smallest is hardly
larger, the text is rejected.

Odd cases: a text that is null or has no letter is ``und``, scores 0 and is rejected. Of languages
that compress a text equally well, the one with more labelled rows is predicted. Copies of a labelled
text count as one. Languages whose labelled texts have all lines in common cannot be told apart, and
their texts are rejected. Without any labelled text, everything is ``und``. Columns of any other name pass through ``drop_unclear`` untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import hashed_pieces, hashed_sample, map_batches
from tallyframe.session import cut_lineage

SAMPLE_DOCS = 400  # different labelled texts that a dictionary is made of, at most
SAMPLE_LINES, LINE_CHARS = 16, 300  # of such a text, so many pieces of lines from anywhere in it; prediction reads whole texts
DICTIONARY_BYTES = 1 << 16
SHARE_BYTES = 600  # of a dictionary that one text may fill
PIECE_BYTES = 2048
LEVEL = 6
NARROW = 0.003  # a margin below this share of the second size is rejected
SHARPNESS = 50.0  # of the score: how fast it falls as another language's size comes closer
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}]+")


def letters(text: str | None) -> bytes:
    """The words of a text in lower case, letters only, in UTF-8."""
    return _OTHER.sub(" ", (text or "").lower()).strip().encode()


@dataclass
class Model:
    """Languages, those with more labelled rows first, and their dictionaries."""

    languages: list[str]
    dictionaries: list[bytes]

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "dictionaries": self.dictionaries}

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        if not hasattr(self, "_ready"):
            self._ready = []
            for raw in self.dictionaries:
                made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                made.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(dict_data=made, level=LEVEL, write_content_size=False, write_dict_id=False))
        return self._ready

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score between 0 and 1, and margin: how much larger the second size is, as its share."""
        raw = letters(text)
        if not raw or not self.languages:
            return UNKNOWN, 0.0, 0.0
        pieces = [raw[a : a + PIECE_BYTES] for a in range(0, len(raw), PIECE_BYTES)]
        sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in self.compressors()], float)
        best = int(sizes.argmin())
        score = 1 / np.exp(-SHARPNESS * (sizes / sizes[best] - 1)).sum()
        rest = np.delete(sizes, best)
        return self.languages[best], float(score), float(1 - sizes[best] / rest.min()) if len(rest) else 1.0


def dictionary(texts: list[str], common: set[bytes]) -> bytes:
    """The lines of some texts, each once and without those in ``common``, each text filling a bounded share."""
    out, size, had = [], 0, set(common)
    for text in texts:
        lines = [line for line in dict.fromkeys(letters(line) for line in text.split("\n")) if line and line not in had]
        had.update(lines)
        part = b" ".join(lines)[:SHARE_BYTES]
        if not part:
            continue
        out.append(part)
        size += len(part) + 1
        if size >= DICTIONARY_BYTES:
            break
    return (b" ".join(out) or b" " * 8)[:DICTIONARY_BYTES].ljust(8)


def trained(docs: DataFrame, use: Column | None = None) -> Model:
    """Dictionaries from the rows with text and lang for which ``use`` holds, up to the sizes of the sample.

    Equal texts are merged before any is chosen, in the order of a hash. Lines that the samples of several languages
    have, such as licences, tell no language and are left out, unless a language has no others.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = (known.filter(use) if use is not None else known).select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), "text")
    content = F.xxhash64("text").alias("content")
    texts = known.groupBy("of", content).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    texts = cut_lineage(texts, "texts")
    counts = {r["of"]: r["n"] for r in texts.groupBy("of").agg(F.sum("n").alias("n")).collect()}
    chosen = hashed_sample(texts.select("of", "content", "id"), "of", "content", SAMPLE_DOCS)
    rows = known.withColumn("content", content).join(F.broadcast(chosen), ["id", "of", "content"])
    rows = rows.groupBy("of", "content").agg(F.min("text").alias("text"))
    lines = F.concat_ws("\n", hashed_pieces(F.col("text"), r"[^\n]", LINE_CHARS, SAMPLE_LINES))
    rows = sorted((r["of"], r["content"], r["text"]) for r in rows.select("of", "content", lines.alias("text")).collect())
    seen = Counter(line for _, line in {(of, letters(x)) for of, _, text in rows for x in text.split("\n")})
    common = {line for line, n in seen.items() if n > 1}
    made = []
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    for language in languages:
        own = [text for of, _, text in rows if of == language]
        only = dictionary(own, common)
        made.append(only if only.strip() else dictionary(own, set()))
    return Model(languages, made)


def predicted(docs: DataFrame, model: Model, passed: list[str]) -> DataFrame:
    """The columns ``passed``, lang_pred, score, margin, rejected."""
    schema = T.StructType(
        [
            *(docs.schema[c] for c in passed),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("margin", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            margins = np.array([m for _, _, m in found], float)
            made = [
                pa.array([x for x, _, _ in found], pa.string()),
                pa.array([s for _, s, _ in found], pa.float64()),
                pa.array(margins),
                pa.array(margins < NARROW, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *made], schema.names)

    return map_batches(docs.select(*dict.fromkeys([*passed, "text"])), predict, schema)


def drop_unclear(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose language is rejected."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clear = [model.predict(t)[2] >= NARROW for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(clear, pa.bool_()))

    return map_batches(docs, keep, docs.schema)
