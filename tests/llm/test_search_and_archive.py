"""Top-k search and WARC archives against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from densika.llm import topk, warc

VECTORS = "vec_id long, embedding array<float>, id string, v string, rank string"


def vectors(n=300, width=6):
    rng = random.Random(6)
    out = [(k, [rng.gauss(0, 1) for _ in range(width)]) for k in range(n)]
    out += [(n + k, list(out[7][1])) for k in range(40)]  # ties
    return out


def odd_vectors():
    return [*vectors(), (None, [1.0] * 6), (5000, None), (5001, []), (5050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5100, [float("nan")] * 6), (5150, [float("inf")] * 6), (5200, [1.0, 2.0]), (5203, [0.5, 2.0]), (3, vectors()[3][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], VECTORS)


@pytest.mark.parametrize(("queries", "candidates", "batch"), [(4096, 8192, 256), (3, 40, 8)])
def test_top_k(spark, monkeypatch, queries, candidates, batch):
    for name, x in (("QUERY_BLOCK", queries), ("CANDIDATE_BLOCK", candidates)):
        monkeypatch.setattr(topk, name, x)
    df = frame(spark, odd_vectors())
    asks = F.col("vec_id") % 50 == 0
    got = {tuple(r) for r in topk.top_k(df, asks, "vec_id", "embedding", batch=batch).collect()}
    stored = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["vec_id"] is not None]
    assert got == topk.brute_force(stored, {i for i, _ in stored if i % 50 == 0})


def test_few_and_no_vectors(spark):
    asks = F.col("vec_id") >= 0
    assert topk.top_k(frame(spark, []), asks, "vec_id", "embedding").count() == 0
    got = [tuple(r) for r in topk.top_k(frame(spark, [(1, [1.0]), (2, [0.5]), (3, [-1.0])]), asks, "vec_id", "embedding").orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 32768), (1, 2, 3, -65536), (2, 1, 1, 32768), (2, 2, 3, -32768), (3, 1, 2, -32768), (3, 2, 1, -65536)]


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2**28 + 64 * k), float(3 - k)]) for k in range(5)] + [(9, [1e30, 1e30])]
    got = {tuple(r) for r in topk.top_k(frame(spark, rows), F.col("vec_id") == 0, "vec_id", "embedding", k=2, scale=1.0).collect()}
    stored = [(r["vec_id"], r["embedding"]) for r in frame(spark, rows).collect()]
    exact = topk.brute_force(stored, {0}, k=2, scale=1.0)
    assert got == {(q, r, i, min(s, 2**63 - 1)) for q, r, i, s in exact}


def pages():
    rng = random.Random(3)
    big = "".join(chr(rng.choice([*range(32, 127), 233, 0x6F22])) for _ in range(60_000))
    same = "same page " * 30
    out = [(k, f"http://x/{k}", f"<html>{k} {'y' * rng.randint(0, 400)}</html>") for k in range(40)]
    out += [(50, "u\r\nv w", big), (41, "u", big), (60, None, same), (59, "b", same), (None, "c", same), (None, "d", "only without an id " * 10)]
    out += [(70, "e", None), (71, "f", ""), (72, "g", "short"), (73, "h", "short"), (74, "i", "WARC/1.1\r\n\r\n0\r\n\r\n" * 20), (59, "b", same), (59, "b", "other " * 40)]
    out += [(59, "another url", same), (60, None, same), (60, None, same), (70, "e", None), (None, None, None), (None, None, None)]
    return out


def expected_pages():
    first = {}
    for key, _, html in pages():
        data = (html or "").encode()
        if len(data) >= 100 and key is not None:
            first[data] = min(first.get(data, key), key)
    out = Counter()
    for key, _, html in pages():
        data = (html or "").encode()
        revisit = data in first and first[data] != key
        out[key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None] += 1
    return out


@pytest.mark.parametrize("segment_bytes", [warc.SEGMENT_BYTES, 64])
def test_archive_round_trip(spark, tmp_path, segment_bytes):
    df = spark.createDataFrame([(*p, "x", "x") for p in pages()], "page_id long, url string, html string, digest string, page string").repartition(3)
    warc.write(df, str(tmp_path / "a"), "page_id", "url", "html", segment_bytes)
    found = warc.read(spark, str(tmp_path / "a"), with_payload=True).withColumns({"key": warc.page_id("record_id"), "to": warc.page_id("refers_to")}).collect()
    assert all(r["complete"] for r in found)
    assert Counter((r["key"], r["payload_bytes"], r["payload_digest"], r["type"], r["to"]) for r in found) == expected_pages()
    assert len({r["record_id"] for r in found}) == len(found) == len(pages())
    urls = Counter((r["key"], r["url"]) for r in found)
    assert urls == Counter((key, (url or "").replace("\r", "%20").replace("\n", "%20").replace(" ", "%20")) for key, url, _ in pages())
    texts = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in pages()}
    assert all(bytes(r["payload"]) == texts[r["payload_digest"]] for r in found if r["type"] == "response")
    narrow = warc.read(spark, str(tmp_path / "a")).collect()
    assert Counter((r["record_id"], r["payload_digest"], r["payload_bytes"]) for r in narrow) == Counter((r["record_id"], r["payload_digest"], r["payload_bytes"]) for r in found)


def test_empty_archive(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(empty, str(tmp_path / "a"), "page_id", "url", "html")
    assert warc.read(spark, str(tmp_path / "a")).count() == 0


def test_missing_segments_are_seen(spark, tmp_path):
    parts = list(warc.records("urn:page:1:d", "u", b"z" * 500, hashlib.sha256(b"z" * 500).hexdigest(), 500, None, 100))
    assert len(parts) > 4
    for name, kept in (("whole", parts), ("hole", parts[:2] + parts[3:]), ("tail", parts[:-1]), ("shuffled", parts[::-1])):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.warc").write_bytes(b"".join(p + warc.END for p in kept))
        found = warc.read(spark, str(folder)).collect()
        assert len(found) == 1 and found[0]["complete"] == (name in ("whole", "shuffled"))


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 80))
def test_chunked_framing(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


def test_broken_framing():
    for body in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcX0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.dechunked(body)
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse(b"junk"))
