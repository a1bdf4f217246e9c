"""One query per corpus operator, each over its whole table, beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, exact_dedup, language, line_dedup, merkle, mixing, packing, quality, runs, simhash, toxicity, url_rules, warc
from tallyframe.llm.common import bucket_of_id, table
from tallyframe.llm.registry import QUERIES, SQL, query  # noqa: F401
from tallyframe.session import scratch_path


def word_bpe() -> str:
    """The tokenizer file that the queries use; operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query(
    r"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d
    """
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, h, sha1(h) || '0' AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
    SELECT page_id, octet_length(encode(h)) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i:
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((instr('0123456789abcdef', substr(x, (5 * i) // 4 + 1, 1)) - 1) * 16
               + instr('0123456789abcdef', substr(x, (5 * i) // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31)::INT, 1)), '') AS payload_digest,
           CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last THEN last END AS refers_to
    FROM d
    """
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    of_page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:([^:]*):', 1) AS BIGINT)")
    return warc.resolved(warc.read_archives(spark, path, with_payload=False)).select(
        of_page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        of_page("refers_to").alias("refers_to"),
    )


@query()
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of_id(F.col("doc_id"), 3) == 1
    model = language.trained(docs, ~held_out)
    return language.predicted(docs, model, ["doc_id"]).withColumn("held_out", held_out)


@query()
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), word_bpe())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "window_id"
    )


@query()
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), word_bpe())


RULES = """
    SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                         ('org', '/fr/', 'allow') AS rules(host, path, verdict)"""


@query(
    r"""
    WITH u AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (
      SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, q, v)),
    fits AS (
      SELECT page_id, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS place
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
    SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
    FROM p LEFT JOIN fits ON p.page_id = fits.page_id AND place = 1
    """
)
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), spark.sql(RULES))


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of_id(F.col("doc_id"), 5) == 0
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.scored(docs, model, ["doc_id"]).withColumn("held_out", held_out)


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@query()
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.runs_of(table(spark, sf_dir, "documents"), rewrite=runs.spread)
    longest = F.array_sort(
        "runs", lambda a, b: F.coalesce(F.nullif(b["length"] - a["length"], F.lit(0)), F.nullif(a["start"] - b["start"], F.lit(0)), a["period"] - b["period"])
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", F.get(longest, 0)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").cast("long").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    r"""
    WITH RECURSIVE
    d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size,
        [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
      FROM d GROUP BY source),
    levels(level) AS (
      SELECT sum(source_size)::BIGINT / sum(weight) FROM s
      UNION
      SELECT (sum(source_size) - sum(CASE WHEN level * weight > 3 * source_size THEN 3 * source_size ELSE 0 END))::BIGINT
             / sum(CASE WHEN level * weight > 3 * source_size THEN 0 ELSE weight END)
      FROM s, levels GROUP BY level),
    g AS (
      SELECT source, source_size, target, target / source_size AS rate
      FROM (SELECT *, least(3 * source_size::DOUBLE, (SELECT max(level) FROM levels) * weight) AS target FROM s)),
    p AS (
      SELECT d.*, source_size, target, floor(rate) AS certain, rate - floor(rate) AS p,
        (('0x' || substr(md5(doc_id || ':mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
    q AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS ratio FROM p WHERE p > 0 AND size > 0),
    o AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(ratio / (1 + ratio) * 1099511627776.0::DOUBLE), doc_id) AS place,
        floor(target - certain * source_size + 1e-6)::BIGINT AS due FROM q),
    walk(source, place, doc_id, due, more) AS (
      SELECT source, place, doc_id, due - CASE WHEN size <= due THEN size ELSE 0 END, size <= due FROM o WHERE place = 1
      UNION ALL
      SELECT o.source, o.place, o.doc_id, w.due - CASE WHEN o.size <= w.due THEN o.size ELSE 0 END, o.size <= w.due
      FROM walk w JOIN o ON o.source IS NOT DISTINCT FROM w.source AND o.place = w.place + 1)
    SELECT p.doc_id, p.size::BIGINT AS size, source_size, target,
      (p.size * (certain + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM p LEFT JOIN walk ON walk.doc_id = p.doc_id
    """
)
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    """
    WITH RECURSIVE
    c AS (
      SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
          lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) & 1 = 1 AS tampered  -- an even CRC-32 before the last inversion
      FROM documents),
    f AS (
      SELECT doc_id, source, tampered, text,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        replace(text, chr(10), '') AS cut
      FROM c),
    d AS (
      SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN tampered THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) END AS claim,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
      FROM f),
    t(source, level, idx, h, n) AS (
      SELECT source, 0, idx, leaf, n FROM d
      UNION ALL
      SELECT source, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 2) // 3
      FROM t WHERE n > 1 GROUP BY source, level, idx // 3),
    sub AS (
      SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
      FROM t WHERE n = 1),
    s(level, idx, h, n) AS (
      SELECT 0, idx, subroot, n FROM sub
      UNION ALL
      SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 2) // 3 FROM s WHERE n > 1 GROUP BY level, idx // 3),
    runs AS (
      SELECT 0 AS phase, source, level, idx // 3 AS run, list(h ORDER BY idx) AS hs, max(n) AS n FROM t GROUP BY source, level, idx // 3
      UNION ALL
      SELECT 1, NULL, level, idx // 3, list(h ORDER BY idx), max(n) FROM s GROUP BY level, idx // 3),
    fold(doc_id, source, phase, level, idx, h, proof) AS (
      SELECT doc_id, source, 0, 0, idx, coalesce(claim, leaf), '' FROM d
      UNION ALL
      SELECT f.doc_id, f.source, CASE WHEN r.n = 1 THEN 1 ELSE f.phase END, CASE WHEN r.n = 1 THEN 0 ELSE f.level + 1 END,
        CASE WHEN r.n = 1 THEN sub.idx ELSE f.idx // 3 END,
        CASE WHEN r.n = 1 THEN f.h ELSE sha256(array_to_string(r.hs[:f.idx % 3] || [f.h] || r.hs[f.idx % 3 + 2:], '')) END,
        CASE WHEN r.n = 1 THEN f.proof ELSE f.proof || array_to_string(r.hs[:f.idx % 3] || r.hs[f.idx % 3 + 2:], '') END
      FROM fold f JOIN runs r ON r.phase = f.phase AND (f.phase = 1 OR r.source IS NOT DISTINCT FROM f.source)
          AND r.level = f.level AND r.run = f.idx // 3
        JOIN sub ON sub.source IS NOT DISTINCT FROM f.source
      WHERE r.n > 1 OR f.phase = 0)
    SELECT d.doc_id, d.source, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, fold.h AS folded_root, fold.h = top.h AS verified
    FROM d JOIN fold ON fold.doc_id = d.doc_id JOIN (SELECT * FROM s WHERE n = 1) top ON phase = 1 AND fold.level = top.level
      JOIN sub ON sub.source IS NOT DISTINCT FROM d.source
    """
)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = bucket_of_id(F.col("doc_id"), 2) == 0
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        merkle.leaf().alias("digest"),
        F.when(tampered, merkle.leaf(F.translate("text", "\n", ""))).alias("claim"),
    )
    return merkle.verified(merkle.manifest(rows))
