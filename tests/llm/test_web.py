"""WARC archives by round trip, and URL rules against brute force."""

import random
import re

from pyspark.sql import functions as F

from tallyframe.llm import url_rules, warc

PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark, tmp_path):
    big = "äöWARC/1.1\r\n" * 4000
    header = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"
    rows = [
        (1, "http://a\r\nb", "x"),
        (2, None, None),
        (3, "u", ""),
        (4, "u", big),
        (5, "u", big),
        (5, "u", big),
        (6, "u", header),
        (None, "u", "zz"),
        (7, "u", "x"),
        (8, "u", "0\r\n\r\n5\r\n" * 900),
    ]
    pages = spark.createDataFrame(rows, PAGES).withColumn("value", F.lit(1)).withColumn("response", F.lit(2))
    warc.write_archives(pages, str(tmp_path / "a"), segment_bytes=5000)
    read = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert all(r.complete for r in read)
    payloads = sorted((r.record_id.split(":")[2], bytes(r.payload).decode()) for r in read if r.record_type == "response")
    assert payloads == sorted([("7", "x"), ("3", ""), ("5", big), ("5", big), ("6", header), ("None", "zz"), ("8", rows[-1][2])])
    found = warc.resolved(warc.read_archives(spark, str(tmp_path / "a"), with_payload=False)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.payload_digest == r.stated_digest
    assert {r.record_id.split(":")[2]: r.refers_to.split(":")[2] for r in found if r.record_type == "revisit"} == {"1": "7", "2": "3", "4": "5"}
    assert next(r.payload_bytes for r in found if r.record_id.startswith("<urn:page:4:")) == len(big.encode())


def test_small_payloads_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES)
    warc.write_archives(pages, str(tmp_path / "a"), revisit_bytes=3)
    kinds = {r.record_id[10]: r.record_type for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "revisit", "4": "response"}
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).collect() == []


def record(kind, name, block, *fields):
    head = "\r\n".join([f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *fields, f"Content-Length: {len(block)}"])
    return f"WARC/1.1\r\n{head}\r\n\r\n{block}\r\n\r\n"


def test_broken_segments_are_told(spark, tmp_path):
    http = "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=1\r\nabc\r\n0\r\n\r\n"
    part = lambda name, n, text, *more: record(
        "continuation", f"{name}{n}", text, f"WARC-Segment-Origin-ID: {name}", f"WARC-Segment-Number: {n}", *more
    )
    total = f"WARC-Segment-Total-Length: {len(http)}"
    parts = [
        part("good", 2, http[20:40]),
        part("good", 3, http[40:], total),
        record("response", "good", http[:20], "WARC-Segment-Number: 1"),
        record("response", "hole", http[:20], "WARC-Segment-Number: 1"),
        part("hole", 3, http[40:], total),
        record("response", "long", http[:20], "WARC-Segment-Number: 1"),
        part("long", 2, http[20:], "WARC-Segment-Total-Length: 9999"),
        part("orphan", 2, "abc", "WARC-Segment-Total-Length: 3"),
        record("response", "frame", http[:-5]),
        record("warcinfo", "info", "software: none"),
    ]
    (tmp_path / "a.warc").write_bytes("".join(parts).encode())
    found = {r.record_id: (r.complete, bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert found.pop("good") == (True, b"abc") and found.pop("info") == (True, b"software: none")
    assert len(found) == 4 and not any(complete for complete, _ in found.values())


# -- URL rules ------------------------------------------------------------------------------------
def slow_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    held = {}
    for h, p, v in rules:
        held[h, p] = max(v, held.get((h, p), ""))
    fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in held.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


def test_rules(spark):
    rng = random.Random(3)
    labels = ["a", "b", "ab", "c", "x/"[:1]]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    path = lambda n: "".join(rng.choice(["/", "x", "y"]) for _ in range(rng.randint(0, n)))
    rules = [(host(3), path(3), rng.choice(["allow", "block"])) for _ in range(80)]
    urls = [(0, None), (1, "nothing"), (2, "http://"), (3, "://a.b/x"), (4, "http://É.a/x"), (None, "http://a.b/x")]
    urls += [(k, f"http://{host(4)}{path(6)}") for k in range(10, 300)]
    urls += [(k, f"HTTPS://{host(4).upper()}/{path(4)}{rng.choice(['?q=/x', '#f', ''])}") for k in range(300, 500)]
    urls += [(1000, "http://a.b/x")] * 100 + [(1001, "http://a.b/" + "x" * 50_000)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit("z") for c in ("key", "rid", "host", "rule")})
    frame = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    found = url_rules.judge(pages, frame).collect()
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found))) == sorted(
        str((k, *slow_verdict(u, rules))) for k, u in urls
    )
    nothing = url_rules.judge(pages, frame.limit(0), default="block").select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in nothing] == [(None, "block")]
    assert url_rules.judge(pages.limit(0), frame).collect() == []


def test_version_lines_at_every_border(spark, tmp_path):
    """The text of a version line at the end of a page, of a chunk, of a segment and of a URL."""
    pad = "p" * (warc.CHUNK_CHARS - len("WARC/1.1"))
    texts = [f"see WARC/1.{v}{end}" for v in "01" for end in ("", "\r", "\r\n", "\n")]
    texts += [f"{pad}WARC/1.1{rest}" for rest in ("", "\r\n", "WARC/1.0\r\n" * 300)]
    texts += ["x" * k + "WARC/1.1\r\n" * 40 for k in range(0, 60, 7)]
    rows = [(k, "http://h/WARC/1.1", t) for k, t in enumerate(texts)]
    for size in (12, 100, 5000):
        path = str(tmp_path / f"s{size}")
        warc.write_archives(spark.createDataFrame(rows, PAGES), path, segment_bytes=size)
        read = warc.read_archives(spark, path).collect()
        assert all(r.complete for r in read)
        assert sorted((int(r.record_id.split(":")[2]), bytes(r.payload).decode()) for r in read) == [(k, t) for k, _, t in rows]
        assert {r.target_uri for r in read} == {"http://h/WARC/1.%31"}


def test_both_versions(spark, tmp_path):
    old = lambda *a: record(*a).replace("WARC/1.1", "WARC/1.0", 1)
    parts = [old("response", "a", "first"), old("response", "b", "see WARC/1.0\r\nand more"), old("response", "b", "see WARC/1.0\r\nand more")]
    parts += [record("response", "c", "third"), old("response", "d", "x"), old("response", "e", "12", "WARC-Segment-Number: 1")]
    parts += [record("continuation", "f", "34", "WARC-Segment-Origin-ID: e", "WARC-Segment-Number: 2", "WARC-Segment-Total-Length: 4")]
    parts += [record("response", "g", "short").replace("Content-Length: 5", "Content-Length: 2")]
    (tmp_path / "a.warc").write_bytes("".join(parts).encode())
    want = [("a", True, "first")] + [("b", True, "see WARC/1.0\r\nand more")] * 2 + [("c", True, "third"), ("d", True, "x"), ("e", True, "1234"), ("g", False, "sh")]
    read = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, r.complete, bytes(r.payload).decode()) for r in read) == want
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.warc").write_bytes("".join([*parts[:1], parts[4]]).encode())
    read = warc.read_archives(spark, str(tmp_path / "old"), version="WARC/1.0").collect()
    assert sorted((r.record_id, r.complete) for r in read) == [("a", True), ("d", True)]
