"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words: its share of all words by weight, but no more than ``most`` times its own words; what
is above that goes to the other sources by weight, until none is above. Within a source a document has an expected number
of copies, in proportion to its own weight and at most ``most``, such that the words of all expected copies make the
target. Whole copies are certain. What is left of the number is the probability p of one more copy: documents are ranked by
the odds of a random number divided by the odds of p, and the first in this order are taken until the words that are still
due are filled. So the sample's size is fixed, up to less than what the next smaller document has, while
the inclusion probabilities are close to p.

"First until filled" passes over a document that is longer than what is still due and goes on behind it. The order is never
sorted as a whole: words are summed in bins of the rank, all bins before the one in which a source's words
run out are taken, and only about FINE documents of a source from there on are taken one by one. That is repeated, with narrower bins
where a bin has more documents, until no document is left that fits. Sums combine before their shuffle, so a source may
hold any share of all rows. Only totals by source are joined to documents.

Odd cases: a null text has size 0 and is never drawn; nor is one whose weight is null, zero or less. Null sources are one source, the
last in order. Rows that share a doc_id have the same random number and are ranked by their place in the table.
Extra columns are not read. Empty tables and tables without a word have no target above 0. Reruns over the same files agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import WORD, map_batches, numbered
from tallyframe.session import cut_lineage

WEIGHTS = (5, 2, 1)  # of the sources in their order, repeating
MOST = 3  # copies of a document, and times a source's words
BINS = 4096
FINE = 1000  # documents of a source that are taken one by one at a time
_PLACES, _TIES = 40, 22  # bits of a rank: of the ratio of odds, and of what orders equal ones
_END = 1 << (_PLACES + _TIES)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: shares of all words by weight, none above ``most`` times its words.

    With the level t, a source's target is the lesser of t times its weight and its bound. Each round of resharing sets t
    to what the sources below their bounds share; it only grows, and ends when no further source reaches its bound.
    """
    bound, level = most * F.col("source_size"), None
    while True:
        above = F.lit(False) if level is None else level * F.col("weight") > bound
        sums = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, bound)).alias("bounds"), F.sum(F.when(~above, F.col("weight"))).alias("weights")
        ).first()
        if not sums["weights"]:
            break
        raised = (sums["all"] - (sums["bounds"] or 0)) / sums["weights"]
        if level is not None and raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(bound.cast("double"), F.lit(level or 0.0) * F.col("weight")))


def _with_rates(rows: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """``sources`` with ``rate``: the expected copies of a document are its weight times that, at most ``most``."""
    rated = sources.withColumn("rate", F.lit(0.0))
    while True:
        joined = rows.join(rated.select("sid", "target", "rate"), "sid")
        above = F.col("rate") * F.col("weight") > most
        sums = joined.groupBy("sid").agg(
            F.first("target").alias("due"),
            F.first("rate").alias("had"),
            F.coalesce(F.sum(F.when(above, most * F.col("size"))), F.lit(0)).alias("bounds"),
            F.sum(F.when(~above, F.col("weight") * F.col("size"))).alias("below"),
        )
        raised = F.when(F.col("below") > 0, F.greatest("had", (F.col("due") - F.col("bounds")) / F.col("below"))).otherwise(F.col("had"))
        sums = cut_lineage(sums.select("sid", "had", raised.alias("rate")), "rates")
        rated = sources.join(sums.select("sid", "rate"), "sid")
        if sums.filter("rate > had").isEmpty():
            return rated


def ranks(doc_id: Column, rid: Column, p: Column, seed: str) -> Column:
    """The integer that orders documents: random odds by the odds of ``p``, then a hash of the row's place."""
    hexed = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 13)
    u = (F.conv(hexed, 16, 10).cast("long") + 0.5) / float(1 << 52)
    ratio = (u / (1 - u)) / (p / (1 - p))
    place = F.least(F.floor(ratio / (1 + ratio) * float(1 << _PLACES)), F.lit((1 << _PLACES) - 1)).cast("long")
    return F.shiftleft(place, _TIES).bitwiseOR(F.pmod(F.xxhash64(rid), F.lit(1 << _TIES)))


def _one_by_one(rows: DataFrame) -> DataFrame:
    """rid, sid and size of ``rows`` (rid, sid, size, key, due) that are taken: in the order of keys what fits in the rest."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, due = None, 0
        for batch in batches:
            sids, sizes, dues = (batch.column(c).to_pylist() for c in ("sid", "size", "due"))
            kept = []
            for sid, size, all_due in zip(sids, sizes, dues, strict=True):
                if sid != source:
                    source, due = sid, all_due
                kept.append(size <= due)
                due -= size if kept[-1] else 0
            yield batch.select(["rid", "sid", "size"]).filter(pa.array(kept, pa.bool_()))

    dealt = rows.repartition("sid").sortWithinPartitions("sid", "key", "rid").select("rid", "sid", "size", "due")
    return map_batches(dealt, take, "rid bigint, sid bigint, size bigint")


def _draw(rows: DataFrame, due: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What is drawn from ``rows`` (rid, sid, size, key) to fill ``due`` (sid, due), in the order of keys.

    Returns per sid the stretches of keys of which all is drawn that was not longer than what was due, and single rows by rid.
    """
    stretch = "array<struct<low: bigint, high: bigint, due: bigint>>"
    state = due.select("sid", "due", F.lit(0).cast("long").alias("low"), F.lit(_END).alias("high"), F.array().cast(stretch).alias("drawn"))
    state, singles = cut_lineage(state, "state"), []
    while True:
        here = rows.join(state.drop("drawn"), "sid").filter((F.col("key") >= F.col("low")) & (F.col("size") <= F.col("due")))
        width = F.floor((F.col("high") - F.col("low")) / BINS).cast("long") + 1
        bin_ = F.floor((F.col("key") - F.col("low")) / width).cast("int")
        bins = here.filter("key < high").groupBy("sid", bin_.alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        stored = cut_lineage(bins, "bins")
        if stored.isEmpty() and state.filter(F.col("high") < _END).isEmpty():
            return state.select("sid", "drawn"), _union(singles)
        after = stored.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("bin", "words", "n"))).alias("bins"))  # BINS at most
        found = cut_lineage(_edges(state.join(after, "sid", "left")), "edges")
        picked = None
        fine = found.filter("fine")
        if not fine.isEmpty():
            near = rows.join(fine.select("sid", "due", "edge", "until"), "sid")
            near = near.filter((F.col("key") >= F.col("edge")) & (F.col("key") < F.col("until")) & (F.col("size") <= F.col("due")))
            picked = cut_lineage(_one_by_one(near), "picked")
            singles.append(picked.select("rid"))
        spent = F.lit(0)
        if picked is not None:
            found = found.join(picked.groupBy("sid").agg(F.sum("size").alias("spent")), "sid", "left")
            spent = F.coalesce("spent", F.lit(0))
        after_fine = F.when(F.col("fine"), F.col("until")).otherwise(F.col("edge"))
        state = cut_lineage(
            found.select(
                "sid",
                (F.col("due") - spent).alias("due"),
                after_fine.alias("low"),
                F.when(F.col("narrow"), F.col("until")).otherwise(F.lit(_END)).alias("high"),
                "drawn",
            ),
            "state",
        )


def _edges(state: DataFrame) -> DataFrame:
    """``state`` (with ``bins``) after its whole bins are drawn: due, edge (where that ends), until, and how to go on.

    ``fine``: rows of the keys from ``edge`` to ``until`` come one by one. ``narrow``: the same keys need narrower bins.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                width, due, low = (r["high"] - r["low"]) // BINS + 1, r["due"], r["low"]
                edge = until = r["high"]
                fine, narrow, count, bins = False, False, 0, r["bins"] or []
                for b in bins:
                    if not count and b["words"] <= due:
                        due -= b["words"]
                        continue
                    begins, ends = low + b["bin"] * width, min(low + (b["bin"] + 1) * width, r["high"])
                    if not count:
                        edge, until, count = begins, ends, b["n"]
                        fine = count <= FINE or ends - begins <= 1
                        narrow = not fine
                        if narrow:
                            break
                    elif count + b["n"] <= FINE:
                        until, count = ends, count + b["n"]
                    else:
                        until = begins
                        break
                else:
                    until = r["high"]
                drawn = r["drawn"] + ([{"low": low, "high": edge, "due": r["due"]}] if edge > low else [])
                rows.append((r["sid"], due, edge, until, fine, narrow, drawn))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            kinds = [pa.int64()] * 4 + [pa.bool_()] * 2 + [batch.schema.field("drawn").type]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["sid", "due", "edge", "until", "fine", "narrow", "drawn"]
    schema = "sid bigint, due bigint, edge bigint, until bigint, fine boolean, narrow boolean, drawn array<struct<low: bigint, high: bigint, due: bigint>>"
    return map_batches(state.select("sid", "due", "low", "high", "drawn", "bins"), walk, schema)


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.union(f)
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
    document_weight: Column | None = None,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (of its source), copies and taken (words).

    ``weights``: of the sources in order of their names, repeating. ``document_weight``: how much more often a document
    is taken than others of its source; without it all are alike.
    """
    weight = F.lit(1.0) if document_weight is None else F.greatest(F.coalesce(document_weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        words_in(F.col("text")).alias("size"),
        weight.alias("weight"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = cut_lineage(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    ordered = numbered(totals, ["last", "source"], [], "sid", "sources")
    of_source = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = cut_lineage(ordered.select("sid", "source", "source_size", of_source.alias("weight")), "sources")
    sources = with_targets(sources, most).drop("weight")
    sources = cut_lineage(sources.select("sid", F.col("source").alias("_source"), "source_size", "target"), "targets")

    known = rows.join(sources.select("sid", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    if document_weight is None:
        rated = sources.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    else:
        known = cut_lineage(known, "known")
        rated = _with_rates(known, sources, most)
    rated = cut_lineage(rated, "rated")
    expected = F.least(F.col("rate") * F.col("weight"), F.lit(float(most)))
    with_copies = known.join(rated.select("sid", "source_size", "target", "rate"), "sid").withColumn("certain", F.floor(expected))
    p = expected - F.col("certain")
    key = F.when((p > 0) & (F.col("size") > 0), ranks(F.col("doc_id"), F.col("rid"), p, seed))
    keyed = with_copies.withColumn("key", key).select("rid", "doc_id", "source", "sid", "size", "source_size", "target", "certain", "key")
    keyed = cut_lineage(keyed, "ranked")

    certain = keyed.groupBy("sid").agg(F.sum(F.col("certain") * F.col("size")).alias("certain"))
    due = rated.join(certain, "sid").select("sid", F.floor(F.col("target") - F.col("certain") + 1e-6).cast("long").alias("due"))
    stretches, singles = _draw(keyed.filter("key IS NOT NULL").select("rid", "sid", "size", "key"), due)
    out = keyed.join(stretches, "sid")
    inside = F.exists("drawn", lambda s: (F.col("key") >= s["low"]) & (F.col("key") < s["high"]) & (F.col("size") <= s["due"]))
    more = F.coalesce(inside, F.lit(False))
    if singles is not None:
        out = out.join(singles.withColumn("_single", F.lit(True)), "rid", "left")
        more = more | F.coalesce("_single", F.lit(False))
    copies = (F.col("certain") + more.cast("long")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def copied(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixture itself: ``docs`` (of different doc_ids) with each row as often as ``mixed`` has copies of it."""
    own = mixed.filter("copies > 0").select(F.col("doc_id").alias("_of"), F.col("copies").alias("_copies"))
    joined = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id")).join(own, F.col("_id").eqNullSafe(F.col("_of")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
