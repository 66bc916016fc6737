"""WARC archives of pages, read back into a globally ordered index of captures.

Writing: one record for each page.  Of pages with equal payloads the one of the largest id is a ``response`` record; the others are
``revisit`` records, which hold the HTTP headers only and refer to it.  Digests are grouped with partial sums, so a payload that a third of
all pages share is one row for each task.  Spark's text writer puts the records into gzip files, with the end of a record as separator of
its rows, so retried tasks never leave half an archive behind.

Reading: a gzip file is read from its first byte to its last, in pieces between separators; a piece may end inside a payload, so
records are put together again by their lengths.  A task holds one record besides the batch being read.  Digests are computed anew from the payloads.

Index: what a task reads is sorted where it is by URL key, time and id: a run.  The runs are cut at the same splitters, sampled from all captures,
and each range is one merge of as many sorted slices as there are runs in it, by loser trees of ``fan_in`` leaves, in rounds if there are more.
Splitters fall inside the captures of one URL too, so a URL that a third of all captures share takes as many merges as its captures need.

Defined cases: a null html is an empty payload; a null id is written as none and is smaller than all ids; rows of one id with equal payloads are all
responses if the id is the largest, and revisit the larger one otherwise; pages of one id with different payloads have records of
their own; a null URL gives no target and an empty key; CR and LF in a URL are percent-encoded; an empty table gives no records; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import placed
from .workspace import Workspace

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass(frozen=True)
class WarcParams:
    #: Shorter payloads are never revisits.
    least_revisit_bytes: int = 0
    #: A column of timestamps; without one, a page counts as captured as many seconds after ``epoch`` as its id says.
    captured: str | None = None
    epoch: str = "2024-01-01 00:00:00"
    range_rows: int = 100_000
    fan_in: int = 64


def base32(sha: Column) -> Column:
    """The base32 form of a SHA-1 in hex: eight characters for each ten."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(sha, k, 10), 16, 32), 8, "0"), digits, BASE32) for k in (1, 11, 21, 31)))


def _payloads(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    more = [c for c in pages.columns if c not in ("page_id", "url", "html")]
    shaped = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), *more)
    return shaped.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))


def revisits(pages: DataFrame, work: Workspace, params: WarcParams = WarcParams()) -> DataFrame:
    """page_id, sha, refers_to: the pages whose payload a page of a larger id has."""
    digests = work.save(_payloads(pages).where(F.col("size") >= params.least_revisit_bytes).select("page_id", "sha"), "digests")
    shared = digests.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("pages")).where("pages > 1").drop("pages")
    older = digests.join(shared, "sha").where("page_id < refers_to OR page_id IS NULL AND refers_to IS NOT NULL")
    return work.save(older.select("page_id", "sha", "refers_to").distinct(), "revisits")


def _record_id(page: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _moment(params: WarcParams) -> Column:
    if params.captured:
        return F.col(params.captured).cast("timestamp_ntz")
    seconds = F.coalesce(F.pmod(F.col("page_id"), F.lit(10**9)), F.lit(0))
    return F.lit(params.epoch).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def write_archives(pages: DataFrame, path: str, work: Workspace, params: WarcParams = WarcParams()) -> None:
    """gzip files of WARC records below path, one record for each page."""
    known = revisits(pages, work, params).select(F.col("page_id").alias("of"), F.col("sha").alias("of_sha"), "refers_to")
    joined = _payloads(pages).join(known, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("of_sha")), "left")
    digest, again = base32(F.col("sha")), F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(SEPARATOR))
    shaped = joined.select("page_id", "url", "html", "size", "refers_to", digest.alias("digest"), again.alias("again"), http.alias("http"), F.substring(_moment(params).cast("string"), 1, 19).alias("date"))
    length = F.octet_length("http") + F.when(F.col("again"), F.lit(0)).otherwise(F.col("size"))
    fields = [
        F.lit(f"{VERSION}\r\n"),
        _field("WARC-Type", F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _field("WARC-Date", F.concat(F.replace("date", F.lit(" "), F.lit("T")), F.lit("Z"))),
        _field("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _field("WARC-Refers-To", F.when(F.col("again"), _record_id(F.col("refers_to"), F.col("digest")))),
        _field("WARC-Profile", F.when(F.col("again"), F.lit(PROFILE))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        F.col("http"),
        F.when(F.col("again"), F.lit("")).otherwise(F.col("html")),
    ]
    shaped.select(F.concat(*fields).alias("value")).write.option("compression", "gzip").option("lineSep", SEPARATOR).text(path)


def records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(file, header, block) of the records in what stands between the separators of files, given in order."""
    held, header, end, gap, home = bytearray(), None, 0, SEPARATOR.encode(), ""
    for file, piece in pieces:
        if not held:
            home = file
        held += piece
        held += gap
        while True:
            if header is None:
                at = held.find(gap)
                if at < 0:
                    break
                lines = held[:at].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"{home}: no record where one should start")
                header = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
                start, end = at + len(gap), at + len(gap) + int(header["content-length"])
            if len(held) < end + len(gap):
                break
            yield home, header, bytes(held[start:end])
            del held[: end + len(gap)]
            header, home = None, file
    if held:
        raise ValueError(f"{home}: ends inside a record")


CAPTURES = "archive string, page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _page(record_id: str | None) -> int | None:
    number = record_id.removeprefix("<urn:page:").partition(":")[0] if record_id else ""
    return int(number) if number else None


def _capture(file: str, header: dict[str, str], block: bytes) -> dict[str, Any]:
    head, _, payload = block.partition(SEPARATOR.encode())
    digest = header["warc-payload-digest"].removeprefix("sha1:")
    size = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    again = header["warc-type"] == "revisit"
    found = digest if again else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "archive": file, "page_id": _page(header["warc-record-id"]), "url": header.get("warc-target-uri"), "captured": header["warc-date"],
        "payload_bytes": size if again else len(payload), "payload_digest": found, "record_type": header["warc-type"], "refers_to": _page(header.get("warc-refers-to")),
        "intact": found == digest and (again or size == len(payload)),
    }


#: Captures that a reading task puts into one batch.
BATCH = 4096


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """CAPTURES of all records below path.

    Size and digest are those of the payload that was read; of a revisit, those in its headers.  intact: both agree with the headers.
    """
    schema = pa.schema([("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("captured", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            files, values = batch.columns
            for k in range(batch.num_rows):
                yield files[k].as_py(), values[k].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for file, header, block in records(pieces(batches)):
            rows.append(_capture(file, header, block))
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    text = spark.read.schema("value string").option("lineSep", SEPARATOR).text(path)
    return text.select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, CAPTURES)


def url_key(url: Column) -> Column:
    """Host from its last part to its first, a port unless it is the usual one, and the path: neighbours in this order belong together."""
    low = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    part = lambda k: F.regexp_extract(low, URL, k)
    host = F.array_join(F.reverse(F.split(F.regexp_replace(part(1), r"^www[0-9]*\.", ""), r"\.")), ",")
    port = F.when(part(2).isin("", ":", ":80", ":443"), F.lit("")).otherwise(part(2))
    path = F.when(part(3) == "", F.lit("/")).otherwise(part(3))
    return F.when(low.rlike(URL), F.concat(host, port, F.lit(")"), path)).otherwise(low)


URL = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^#]*)"


class LoserTree:
    """Merges sorted sequences: every inner node holds the loser of its match, so a step plays one match for each level."""

    def __init__(self, runs: Sequence[Sequence[tuple]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.heads = [(0, r[0]) if len(r) else (1,) for r in runs]  # (1,) is behind all keys
        self.losers = [-1] * max(1, len(runs))  # -1 wins every match while the tree is filled
        for leaf in range(len(runs)):
            self._play(leaf)

    def _play(self, leaf: int) -> None:
        node = (leaf + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 or leaf >= 0 and self.heads[other] < self.heads[leaf]:
                leaf, self.losers[node] = other, leaf
            if leaf < 0:
                return
            node //= 2
        self.losers[0] = leaf

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and len(self.heads[self.losers[0]]) == 2:
            leaf = self.losers[0]
            yield self.heads[leaf][1]
            self.at[leaf] += 1
            run = self.runs[leaf]
            self.heads[leaf] = (0, run[self.at[leaf]]) if self.at[leaf] < len(run) else (1,)
            self._play(leaf)


def merged(runs: Sequence[Sequence[tuple]], fan_in: int) -> Sequence[tuple]:
    """One sorted sequence, in rounds of at most fan_in runs."""
    while len(runs) > 1:
        runs = [list(LoserTree(runs[k : k + fan_in])) for k in range(0, len(runs), fan_in)]
    return runs[0] if runs else []


ORDER = ("url_key", "captured", "page_id", "payload_digest")


def capture_index(captures: DataFrame, work: Workspace, params: WarcParams = WarcParams()) -> DataFrame:
    """The captures with url_key and position (from 1): their place by URL key, time, id and digest among all."""
    keyed = captures.withColumn("url_key", url_key(F.col("url")))
    # what a task holds is a run; spot has the run's number and the place in the run
    runs = work.save(keyed.sortWithinPartitions(*ORDER).withColumn("spot", F.monotonically_increasing_id()), "runs")
    ranges = max(int(work.spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // params.range_rows))
    dealt = runs.repartitionByRange(ranges, *ORDER, "spot").sortWithinPartitions("spot")
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None  # the slices of one range
        if rows is None or not rows.num_rows:
            return
        own = rows.column("spot").to_numpy() >> 33
        columns = [rows.column(c).to_pylist() for c in ORDER]
        keys = [(u, t, p is not None, p or 0, d, k) for k, (u, t, p, d) in enumerate(zip(*columns, strict=True))]
        edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(keys)]
        order = [k[-1] for k in merged([keys[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], params.fan_in)]
        yield from rows.take(pa.array(order, pa.int64())).combine_chunks().to_batches(max_chunksize=BATCH)

    sorted_ranges = dealt.mapInArrow(run, dealt.schema).select(*(c for c in names if c != "spot"), F.monotonically_increasing_id().alias("spot"))
    stored = work.save(sorted_ranges, "merged")
    work.drop(runs)
    return placed(stored, "spot", "place").withColumn("position", F.col("place") + 1).drop("place")


def archived(pages: DataFrame, params: WarcParams = WarcParams(), path: str | None = None) -> DataFrame:
    """Write the pages' archives (below path, or in the shared folder), read them back and index them."""
    work = Workspace(pages.sparkSession, "warc")
    path = path or f"{work.root}/archives"
    write_archives(pages, path, work, params)
    return capture_index(read_archives(pages.sparkSession, path), work, params)


_SHA_SQL = " || ".join(f"substr('{BASE32}', ((('0x' || sha[{5 * k + 1}:{5 * k + 5}])::BIGINT >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
_KEY_SQL = f"""CASE WHEN NOT regexp_matches(low, '{URL}') THEN low ELSE
  array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(low, '{URL}', 1), '^www[0-9]*\\.', ''), '.')), ',')
  || CASE WHEN regexp_extract(low, '{URL}', 2) IN ('', ':', ':80', ':443') THEN '' ELSE regexp_extract(low, '{URL}', 2) END
  || ')' || CASE WHEN regexp_extract(low, '{URL}', 3) = '' THEN '/' ELSE regexp_extract(low, '{URL}', 3) END END"""

#: The contract's columns, the URL key, the time and the position in DuckDB's SQL.
ORACLE_SQL = f"""WITH h AS (
  SELECT page_id, translate(coalesce(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), r AS (
  SELECT page_id, payload_bytes, {_SHA_SQL} AS payload_digest, max(page_id) OVER (PARTITION BY sha) AS last,
         {_KEY_SQL} AS url_key, strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0) % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
  FROM h
), k AS (SELECT *, last IS NOT NULL AND (page_id IS NULL OR page_id < last) AS again FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to,
       url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id NULLS FIRST, payload_digest) AS position
FROM k
"""
