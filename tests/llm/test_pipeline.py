"""The pipeline's stages, each on what the one before kept, and the main path of native operators."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from tallyframe.llm import exact_dedup, language, quality, queries, simhash, toxicity, url_rules
from tallyframe.llm.common import table
from tallyframe.session import cut_lineage
from tests.llm.conftest import SF
from tests.llm.test_dedup import slow_lines

SF01 = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF01, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, SF01), name)
        kept[name] = docs
        if name == "packing":
            continue
        assert docs.columns == columns
        rows, had = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in before.collect()}
        assert set(rows) <= set(had) and rows
        if name != "line_dedup":
            assert all(rows[i] == had[i] for i in rows)
        if name == "language_id":
            model = language.trained(before)
            assert set(rows) == {i for i, r in had.items() if model.predict(r.text)[2] >= language.NARROW}
        if name == "toxicity":
            model = toxicity.trained(before, table(spark, SF01, "labels"))
            assert set(rows) == {i for i, r in had.items() if model.score(r.text)[0] < 0.5}
        if name == "line_dedup":
            for i, gone in slow_lines([(i, r.text) for i, r in had.items()]).items():
                left = "\n".join(x for k, x in enumerate(had[i].text.split("\n")) if k not in gone)
                if left.strip() or not gone:
                    assert rows[i].text == left and rows[i].n_chars == len(left)
                else:
                    assert i not in rows
        if name == "near_dedup":
            prints = {i: simhash.fingerprint(r.text, 5, 4) for i, r in had.items()}
            far = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True))
            # Near-duplicates by the four fingerprints together; links may chain, so a dropped one has some neighbour.
            assert all(any(far(i, j) <= 44 for j in had if j != i) for i in set(had) - set(rows))
            equal = {}
            for i in sorted(had):
                equal.setdefault(had[i].text, i)
            assert not set(rows) - set(equal.values())
    pieces = kept["packing"].collect()
    left = {r.doc_id for r in kept["near_dedup"].collect()}
    assert {p.doc_id for p in pieces} == left
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(corpus_pipeline.STAGES) == 5
    registered = __spark_entry__.queries()
    assert all(any(re.match(rf"op{n}_", q) for q in registered) for n in range(1, 11)) and "pipeline" in registered


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF), "stage")
        assert docs.count() == 0


@pytest.mark.parametrize(
    "frame",
    [
        lambda d, p, s: exact_dedup.exact_duplicates(d),
        lambda d, p, s: url_rules.judge(p, s.sql(queries.RULES)),
        lambda d, p, s: quality.judge(d),
    ],
)
def test_native_operators_have_no_python_in_their_plans(spark, frame, monkeypatch):
    import tallyframe.session as session

    plans = []
    parquet = session.cut_lineage

    def watched(df, name="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return parquet(df, name)

    for module in (exact_dedup, url_rules, quality):
        monkeypatch.setattr(module, "cut_lineage", watched)
    last = frame(table(spark, SF, "documents"), table(spark, SF, "pages"), spark)
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2
    assert not any(re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", p) for p in plans)
