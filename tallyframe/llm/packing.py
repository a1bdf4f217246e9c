"""Packing of token streams into sequences of one length, with a mixture of sources in every window.

Each source is a queue of its documents' tokens. A window is a run of consecutive sequences. In deficit
round-robin every source earns its share of each window, may take whole tokens only, and carries what is
left over to the next window. So after w windows a source has been served its share of w windows, rounded
down: the deficit is a fraction of a token, at any place of the corpus and in any partition. That makes
every token's place a matter of arithmetic on two numbers: the tokens that its source has before it,
and the shares. The first is a prefix sum over partitions; no queue is ever held.

A source that runs out leaves its share to the others from the next window on. Documents are cut only
where a window or a sequence ends; the stream has no gaps, so only the last sequence needs padding.

Odd cases: a null or empty text has the end id alone. A null source is a source of its own. Rows that
share a doc_id are packed one by one. Only doc_id, source and text are read; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.bpe import tokenizer
from tallyframe.llm.common import map_batches
from tallyframe.session import cut_lineage, scratch_path

SEQUENCE = 2048
WINDOW = 64 * SEQUENCE
END_ID = 1


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Stored rows doc_id, source, part, before, n, ids: ``before`` counts the source's tokens earlier in the part."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, end = tokenizer(path), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        served: dict[str | None, int] = {}
        for batch in batches:
            before, ids, sources = [], [], batch.column("source").to_pylist()
            for source, own in zip(sources, bpe.encode_all(batch.column("text").to_pylist()), strict=True):
                ids.append(own + end)
                before.append(served.get(source, 0))
                served[source] = before[-1] + len(ids[-1]) // 4
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "source")),
                    pa.array([part] * len(ids), pa.int32()),
                    pa.array(before, pa.int64()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "source", "part", "before", "n", "ids"],
            )

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, part int, before bigint, n bigint, ids binary"
    path_of_ids = scratch_path(spark, "tokens")
    map_batches(rows, encode, schema).write.option("compression", "zstd").parquet(path_of_ids)
    return spark.read.schema(schema).parquet(path_of_ids)


@dataclass(frozen=True)
class Phase:
    """Windows from ``first`` on in which the same sources are served, ``served`` being what they had before."""

    first: int
    served: tuple[int, ...]
    shares: tuple[int, ...]


class Schedule:
    """How many tokens of each source are in the first w windows."""

    def __init__(self, totals: list[int], shares: list[int], window: int = WINDOW):
        self.totals, self.window, self.phases = totals, window, []
        served, first = [0] * len(totals), 0
        while any(s < t for s, t in zip(served, totals, strict=True)):
            left = [t - s for s, t in zip(served, totals, strict=True)]
            active = [share if rest else 0 for share, rest in zip(shares, left, strict=True)]
            active = active if any(active) else left
            self.phases.append(Phase(first, tuple(served), tuple(active)))
            every = sum(active)
            # It ends with the window in which the first of its sources runs out.
            first += min(-(-rest * every // (window * a)) for a, rest in zip(active, left, strict=True) if a)
            served = [self.served(s, first) for s in range(len(totals))]
        self.windows = first
        self._firsts = [p.first for p in self.phases]
        self.layout = lru_cache(maxsize=4096)(self._layout)

    def served(self, source: int, w: int) -> int:
        firsts = getattr(self, "_firsts", None) or [p.first for p in self.phases]
        p = self.phases[max(0, bisect_right(firsts, w - 1) - 1)]
        more = (w - p.first) * self.window * p.shares[source] // sum(p.shares)
        return min(self.totals[source], p.served[source] + more)

    def _layout(self, w: int) -> list[int]:
        """Where each source's tokens of window ``w`` begin in the whole stream."""
        had = [self.served(s, w) for s in range(len(self.totals))]
        at, out = sum(had), []
        for s, h in enumerate(had):
            out.append(at)
            at += self.served(s, w + 1) - h
        return out

    def pieces(self, source: int, start: int, n: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(start in the document, length, sequence, offset, window) of each piece of tokens start .. start+n."""
        low, high = 0, self.windows  # the last window that begins at or before the token
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.served(source, middle) <= start else (low, middle)
        w, done = low, 0
        while done < n:
            begins, ends = self.served(source, w), self.served(source, w + 1)
            here = min(n - done, ends - start - done)
            place = self.layout(w)[source] + start + done - begins
            while here > 0:
                offset = place % length
                size = min(here, length - offset)
                yield done, size, place // length, offset, w
                done, place, here = done + size, place + size, here - size
            w += 1


def pack(
    docs: DataFrame,
    path: str,
    length: int = SEQUENCE,
    window: int = WINDOW,
    targets: dict[str | None, int] | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, doc_tokens, window_id, sequence_id, offset, ids.

    ``targets``: integer shares by source; a source that is not named has its number of tokens, so without
    targets each window has the proportions of the corpus. A source with share 0 comes last. The totals by
    source go through the driver: a mixture's sources, not its documents.
    """
    tokens = tokenized(docs, path, end_id)
    counts = cut_lineage(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "counts")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("source").alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")
    )
    starts = cut_lineage(starts, "starts")
    totals = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    sources = sorted(totals, key=lambda s: (s is None, s or ""))
    index = {s: k for k, s in enumerate(sources)}
    every, shares = [totals[s] for s in sources], [(targets or {}).get(s, totals[s]) for s in sources]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(every, shares, window)
        for batch in batches:
            rows, cuts, parts = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("source", "start", "n", "ids"))
            for row, (source, start, n, ids) in enumerate(zip(*columns, strict=True)):
                for piece in plan.pieces(index[source], start, n, length):
                    rows.append(row)
                    cuts.append((piece[0], piece[1], n, piece[4], piece[2], piece[3]))
                    parts.append(ids[4 * piece[0] : 4 * (piece[0] + piece[1])])
            of = batch.select(["doc_id", "source"]).take(pa.array(rows, pa.int64()))
            numbers = [pa.array(c, pa.int64()) for c in zip(*cuts, strict=True)] if cuts else []
            if numbers:
                names = ["start", "length", "doc_tokens", "window_id", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays(
                    [*of.columns, *numbers, pa.array(parts, pa.binary())], ["doc_id", "source", *names, "ids"]
                )

    placed = tokens.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))).select(
        "doc_id", "source", (F.col("first") + F.col("before")).alias("start"), "n", "ids"
    )
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, start bigint, length bigint,"
        " doc_tokens bigint, window_id bigint, sequence_id bigint, offset bigint, ids binary"
    )
    return map_batches(placed, cut, schema)
