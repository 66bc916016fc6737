import base64
import gzip
import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taulab.llm import warc
from taulab.llm.warc import LoserTree, WarcParams, archived, capture_index, merged, read_archives, records, write_archives
from taulab.llm.workspace import Workspace

SCHEMA = "page_id long, url string, html string, sha string, spot long"


def documents():
    rng = random.Random(8)
    tricky = ["\r\n\r\n", "\r\n", "\r\n\r\n\r\n", "\r", "\n\r\n", "\r\r\n\r\n\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "\r\n\r\nWARC/1.1\r\n", "x\r\n\r", "\u0000", "é \r\n"]
    rows = [(k, "http://a.example.com/", t) for k, t in enumerate(tricky)]
    rows += [(100 + k, "http://a.example.com/hot", "".join(rng.choice(["\r", "\n", "a"]) for _ in range(rng.randrange(12)))) for k in range(200)]
    rows += [(400, None, None), (401, "HTTP://WWW2.Example.ORG:80", ""), (402, "https://u:p@x.org:8080?q=1#frag", "same"), (403, "not a url", "same"), (None, "ftp://é.org/É", "same"), (404, "http://x/\r\n y", "one"), (404, "http://x/", "two")]
    rows += [(500, "http://t/", "big " * 300_000), (501, "http://t/", "\r\n\r\n" * 50_000), (600, "http://t/", "twice"), (600, "http://t/", "twice"), (None, "http://n/", "only null"), (None, "http://n/", "only null")]
    return rows


def brute(rows, least=0):
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = bool(ids) and len(data) >= least and (i is None or i < max(ids))
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", max(ids) if again else None))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3)


NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("params", [WarcParams(), WarcParams(range_rows=20, fan_in=2, least_revisit_bytes=5)])
def test_round_trip_matches_brute_force(spark, params):
    rows = documents()
    out = archived(table(spark, rows), params).collect()
    assert sorted((tuple(r[c] for c in NAMES) for r in out), key=str) == sorted(brute(rows, params.least_revisit_bytes), key=str)
    assert all(r.intact for r in out)
    order = sorted(out, key=lambda r: (r.url_key, r.captured, r.page_id is not None, r.page_id or 0, r.payload_digest))
    assert [r.position for r in order] == list(range(1, len(rows) + 1))


def test_files_are_warc_and_every_payload_is_stored_once(spark, tmp_path):
    rows = [(1, "http://a/", "same " * 1000), (2, "http://b/", "same " * 1000), (3, "http://c/", "other")]
    work = Workspace(spark, "warc")
    write_archives(table(spark, rows), f"file://{tmp_path}/out", work)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("*.gz"))
    assert data.count(b"WARC/1.1\r\nWARC-Type: response\r\n") == 2 and data.count(b"same") == 1000
    block = re.search(rb"WARC-Type: revisit\r\nWARC-Record-ID: <urn:page:1:(\w+)>\r\n.*?WARC-Refers-To: <urn:page:2:(\w+)>\r\n", data, re.DOTALL)
    assert block and block[1] == block[2]


def test_damage_is_seen(spark, tmp_path):
    write_archives(table(spark, [(1, "http://a/", "abcdef")]), f"file://{tmp_path}/out", Workspace(spark, "warc"))
    (file,) = [p for p in (tmp_path / "out").glob("*.gz") if b"abcdef" in gzip.decompress(p.read_bytes())]
    data = gzip.decompress(file.read_bytes())
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.gz").write_bytes(gzip.compress(data.replace(b"abcdef", b"abcdeX")))
    (row,) = read_archives(spark, f"file://{tmp_path}/bad").collect()
    assert not row.intact and row.payload_digest == base64.b32encode(hashlib.sha1(b"abcdeX").digest()).decode()
    with pytest.raises(ValueError):
        list(records(iter([("f", p) for p in data.replace(b"abcdef", b"abc").split(b"\r\n\r\n")[:-1]])))


def test_empty_table(spark):
    assert archived(table(spark, documents()).limit(0)).collect() == []


def test_url_keys(spark):
    urls = {"http://www.Example.com": "com,example)/", "https://a.b.co.uk:443/P?x=1#f": "uk,co,b,a)/p?x=1", "http://h:81/x": "h:81)/x", "mailto:x": "mailto:x", None: ""}
    out = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.url_key(warc.F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in out} == urls


def test_a_url_of_many_captures_takes_many_merges(spark):
    rows = spark.range(4000, numPartitions=6).selectExpr("'a' AS archive", "id AS page_id", "'http://hot/' AS url", "'2024' AS captured", "0L AS payload_bytes", "'D' AS payload_digest", "'response' AS record_type", "CAST(NULL AS long) AS refers_to", "true AS intact")
    index = capture_index(rows, Workspace(spark, "warc"), WarcParams(range_rows=300, fan_in=3))
    parts = index.groupBy(warc.F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 4000
    assert [r.page_id for r in index.orderBy("position").collect()] == list(range(4000))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.text(max_size=2))), max_size=9), st.integers(2, 5))
def test_merges_are_sorts(runs, fan_in):
    runs = [sorted(r) for r in runs]
    everything = sorted(x for r in runs for x in r)
    assert list(merged(runs, fan_in)) == everything and list(LoserTree(runs)) == everything
