"""WARC archives with an index first, and coalesced range reads.

Writing: every partition writes one archive, each record a gzip member of its
own, and returns one index row per record: file, offset, length, URL, digest.
The index is a table in the shared folder; only archives that a committed index
names belong to the result, so a lost or repeated task leaves at most a file that
nothing points to.  Of records with equal payloads the one with the largest page
id is a response and the others are revisits of it.

Reading: the selected index rows are dealt by file and sorted by offset; ranges
that lie close together become one read.

A null payload is empty, a null URL an empty one.  Records with a null page id
are responses and no record revisits them.  Rows that repeat a page id with the
same payload are all responses when that id is the largest.  An empty table
makes no records.  Files are reached through ``pyarrow.fs``, so the shared
folder may be any store that it knows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, stored

#: Ranges of one file with a smaller gap between them are read at once, up to so many bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Compressed bytes that a reading task gets, about.
TASK_BYTES = 16 << 20
#: Rows that a task handles at once.
ROWS = 200
#: The date of all records: archives of the same pages are the same.
DATE = "2000-01-01T00:00:00Z"

_INDEX = "page_id long, path string, offset long, length long, url string, digest string"


def _record(page_id: int | None, url: str, payload: bytes, digest: str, target: int | None) -> bytes:
    """One WARC/1.1 record; a revisit names the page it refers to and has no payload."""
    kind = "response" if target is None else "revisit"
    body = payload if target is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if target is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{target}>"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path, out, at = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in _parts(batches):
                rows = []
                for page_id, url, html, target in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "target")), strict=True):
                    payload = html.encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    member = gzip.compress(_record(page_id, url, payload, digest, target), 4, mtime=0)
                    if out is None:
                        out = store.open_output_stream(path, compression=None)
                    out.write(member)
                    rows.append((page_id, path, at, len(member), url, digest))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "path", "offset", "length", "url", "digest"]) if rows else _nothing()
        finally:
            if out is not None:
                out.close()

    return run


def _nothing() -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "path": pa.string(), "offset": pa.int64(), "length": pa.int64(), "url": pa.string(), "digest": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds.values()], list(kinds))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html)``; returns the stored index."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    # Digests travel without payloads; the largest page id of a digest combines before the shuffle.
    slim = rows.filter("page_id is not null").select("page_id", F.sha1("html").alias("sha1"), F.octet_length("html").alias("size"))
    last = slim.groupBy("sha1", "size").agg(F.max("page_id").alias("target"), F.min("page_id").alias("least")).filter("least < target").drop("least")
    revisits = slim.join(last, ["sha1", "size"]).filter("page_id < target").select("page_id", "sha1", "target").distinct()
    roles = rows.withColumn("sha1", F.sha1("html")).join(revisits.hint("shuffle_hash"), ["page_id", "sha1"], "left")
    return stored(roles.select("page_id", "url", "html", "target").mapInArrow(_write(folder), _INDEX))


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """``from, to`` of each read and the rows in it, for rows of ``offset, length`` in order."""
    begin = end = 0
    own: list[int] = []
    for i, (offset, length) in enumerate(rows):
        if own and (offset - end > GAP_BYTES or offset + length - begin > READ_BYTES):
            yield begin, end, own
            own = []
        if not own:
            begin = offset
        end = offset + length
        own.append(i)
    if own:
        yield begin, end, own


def _parse(member: bytes) -> dict[str, str | bytes]:
    head, _, body = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    length = int(fields["Content-Length"])
    if body[length:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where it should")
    return {**fields, "payload": body[:length]}


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        path, file = None, None
        for batch in _parts(batches):
            paths, spans = batch.column("path").to_pylist(), list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            digests, out, i = batch.column("digest").to_pylist(), [], 0
            while i < len(paths):
                j = i
                while j < len(paths) and paths[j] == paths[i]:
                    j += 1
                if paths[i] != path:
                    if file is not None:
                        file.close()
                    path, file = paths[i], store.open_input_file(paths[i])
                for begin, end, own in _ranges(spans[i:j]):
                    data = file.read_at(end - begin, begin)
                    for k in own:
                        offset, length = spans[i + k]
                        r = _parse(data[offset - begin : offset - begin + length])
                        digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                        sound = digest == digests[i + k]
                        if r["WARC-Type"] == "response":
                            sound &= base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == digest and len(r["payload"]) == int(r["WARC-Payload-Length"])
                        if not sound:
                            raise ValueError(f"{path} at {offset}: the digest doesn't match")
                        out.append((_page(r["WARC-Record-ID"]), r["WARC-Target-URI"], r["WARC-Type"], _page(r["WARC-Refers-To"]) if "WARC-Refers-To" in r else None, int(r["WARC-Payload-Length"]), digest, r["payload"]))
                i = j
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if file is not None:
            file.close()

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of ``index`` point to; a revisit has an empty payload.

    Filter the index first: only the ranges of its rows are read.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    rows = index.select("path", "offset", "length", "digest").repartitionByRange(max(1, -(-total // TASK_BYTES)), "path", "offset").sortWithinPartitions("path", "offset")
    return rows.mapInArrow(_read(folder), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    folder = scratch(spark)
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HEX_BITS = "CASE substr(h, k, 1) " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate("0123456789abcdef")) + " END"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
nibbles AS (SELECT h, k, {_HEX_BITS} AS v FROM (SELECT DISTINCT h FROM p), generate_series(1, 40) t(k)),
bits AS (SELECT h, (k - 1) * 4 + b AS i, (v >> (3 - b)) & 1 AS bit FROM nibbles, generate_series(0, 3) t(b)),
digits AS (SELECT h, i // 5 AS d, CAST(sum(bit << CAST(4 - i % 5 AS INT)) AS INT) AS v FROM bits GROUP BY ALL),
names AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY d) AS digest FROM digits GROUP BY h),
last AS (SELECT html, max(page_id) AS page_id FROM p GROUP BY html)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN p.page_id = last.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = last.page_id THEN NULL ELSE last.page_id END AS refers_to
FROM p JOIN names USING (h) JOIN last USING (html)
"""
