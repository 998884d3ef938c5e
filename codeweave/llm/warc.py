"""Deterministic sharded WARC writer.

Records are range-sorted by page_id (nulls first, ties by payload digest).
Shards are cut where the running total of payload bytes passes multiples of
SHARD_BYTES, so they depend on the rows alone; a shard is written by one
task (partitioned by shard number, so no task gets two large ones), which
rolls files at ROLL_BYTES compressed. All rows of one page_id are in one shard. Every record is its own
gzip member with regenerated headers: ids derived from page_id and payload,
a fixed date, fresh block and payload digests.

Of records with equal payloads of at least REVISIT_BYTES bytes the one with
the largest page_id is written as response, the others as revisits of it.

Commit: a task attempt writes under names of its own in ``tmp``; the names
reach the manifest that Spark commits with the job; a second job moves
exactly these files to their final names (repeatable: a file already in
place with the right size and SHA-1 is left), and the manifest of final names is the
last thing written. Files of lost attempts stay in ``tmp`` and are never
read.

Defined cases: null html is an empty payload, null url an empty target; a
null page_id is never referred to by another id's record unless all ids of
the payload are null; of repeated rows with the response's page_id one is
the response, the rest are revisits; an empty table gives no files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_dir, running_total, shared_uri, work_dir, written

QUERY = "op3_warc_shards"
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
REVISIT_BYTES = 1000
SLOTS = 256             # join keys that the pages of one payload are spread over
GZIP_LEVEL = 4
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")     # RFC 4122 URL namespace

MANIFEST = ("shard long, seq long, tmp string, file string, n_records long, n_bytes long, "
            "sha1 string")
REPORT = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'page:{page_id}:{digest}')}>"


def _b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP head only."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if kind == "revisit" else head + payload
    target = " ".join((url or "").split())      # a header value is one line
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
             f"WARC-Payload-Digest: {_b32(digest)}",
             f"WARC-Block-Digest: {_b32(hashlib.sha1(block).hexdigest())}",
             "Content-Type: application/http; msgtype=response",
             f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}",
                  f"WARC-Refers-To: {record_id(refers, digest)}"]
        if refers is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers}")
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class _Out:
    """One archive under a temporary name."""

    def __init__(self, folder: str, shard: int, seq: int):
        from pyarrow import fs
        files, root = fs.FileSystem.from_uri(folder)
        self.shard, self.seq, self.n, self.size = shard, seq, 0, 0
        self.file = f"pages-{shard:08d}-{seq:04d}.warc.gz"
        self.tmp = f"{self.file}.{uuid.uuid4().hex}.open"
        self.sha = hashlib.sha1()
        self.stream = files.open_output_stream(f"{root}/tmp/{self.tmp}")

    def add(self, raw: bytes) -> None:
        z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)      # header without a time
        b = z.compress(raw) + z.flush()
        self.stream.write(b)
        self.sha.update(b)
        self.n, self.size = self.n + 1, self.size + len(b)

    def close(self) -> tuple:
        self.stream.close()
        return self.shard, self.seq, self.tmp, self.file, self.n, self.size, self.sha.hexdigest()


def _writer(folder: str, roll: int):
    """Rows (shard, page_id, digest, refers, info, url, html) in order; an
    info row precedes the page rows of its (page_id, digest)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        revisit_key, revisit_to, first_done = None, None, None
        for batch in batches:
            names = batch.schema.names
            for lo in range(0, batch.num_rows, 128):
                rows = batch.slice(lo, 128)
                for r in zip(*(rows.column(n).to_pylist() for n in names), strict=True):
                    shard, page, digest, refers, info, url, html = r
                    if info:
                        revisit_key, revisit_to = (shard, page, digest), refers
                        continue
                    if out and (out.shard != shard or out.size >= roll):
                        seq = out.seq + 1 if out.shard == shard else 0
                        done.append(out.close())
                        out = _Out(folder, shard, seq)
                    out = out or _Out(folder, shard, 0)
                    payload = (html or "").encode("utf-8", "replace")
                    kind, key = "response", (shard, page, digest)
                    if revisit_key == key and (page != revisit_to or first_done == key):
                        kind = "revisit"
                    first_done = key
                    out.add(record(kind, page, url, payload, digest,
                                   revisit_to if kind == "revisit" else None))
        if out:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*done, strict=True)],
                names=["shard", "seq", "tmp", "file", "n_records", "n_bytes", "sha1"])
    return run


def _file_sha1(files, path: str) -> str:
    digest = hashlib.sha1()
    with files.open_input_stream(path, compression=None) as s:
        while data := s.read(1 << 20):
            digest.update(data)
    return digest.hexdigest()


def _mover(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for tmp, name, size, sha1 in zip(*(batch.column(c).to_pylist() for c in (
                    "tmp", "file", "n_bytes", "sha1")), strict=True):
                have = files.get_file_info(f"{root}/{name}")
                # A retried task finds what it moved before, whole and alike.
                if (have.type != fs.FileType.File or have.size != size
                        or _file_sha1(files, f"{root}/{name}") != sha1):
                    files.move(f"{root}/tmp/{tmp}", f"{root}/{name}")
            yield batch
    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", shard_bytes: int = SHARD_BYTES,
               roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` as archives below ``folder``; returns the manifest."""
    spark = pages.sparkSession
    make_dir(spark, f"{folder}/tmp")
    html = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                     F.col(html_col).alias("html"))
    slim = written(pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.sha1(F.encode(html, "UTF-8")).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes")), f"{folder}/state/slim")
    # First page_id of every shard: 8 bytes for each SHARD_BYTES of payload.
    placed = running_total(slim, ["page_id", "digest"], "bytes", "before", f"{folder}/state/sorted")
    bounds = np.array([r[0] for r in placed.filter("page_id is not null").groupBy(
        F.floor(F.col("before") / shard_bytes)).agg(F.min("page_id").alias("first"))
        .orderBy("first").select("first").collect()], dtype=np.int64)

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        at = np.searchsorted(bounds, ids.fillna(0).to_numpy(dtype=np.int64), "right")
        return pd.Series(np.where(known, at, 0))

    # Equal payloads: the pages of a digest are spread over SLOTS join keys.
    # Counts and the largest page come from one row per digest and slot, which
    # carries them back to the slots in use.
    large = slim.filter(F.col("bytes") >= REVISIT_BYTES).select(
        "page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SLOTS)).alias("slot"))
    per_slot = large.groupBy("digest", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top"))
    same = per_slot.groupBy("digest").agg(
        F.sum("n").alias("n"), F.max("top").alias("refers")).filter("n > 1").drop("n")
    slots = per_slot.select("digest", "slot").join(same, "digest")
    info = large.join(slots, ["digest", "slot"]).select("page_id", "digest", "refers").distinct()

    rows = p.withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))).select(
        "page_id", "digest", F.lit(None).cast("long").alias("refers"), F.lit(False).alias("info"),
        "url", "html").unionByName(info.select(
            "page_id", "digest", "refers", F.lit(True).alias("info"),
            F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")))
    cols = ["shard", "page_id", "digest", "refers", "info", "url", "html"]
    # Shards are numbered from 1; pages without an id are shard 0.
    ranged = (rows.withColumn("shard", shard_of("page_id")).select(*cols)
              .repartitionById(len(bounds) + 1, F.col("shard").cast("int"))
              .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest",
                                    F.col("info").desc(), "url"))
    tmp = written(ranged.mapInArrow(_writer(folder, roll_bytes), MANIFEST),
                  f"{folder}/state/attempts")
    return written(tmp.mapInArrow(_mover(folder), MANIFEST), f"{folder}/manifest")


# ----------------------------------------------------------------- reading

def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a compressed archive stream."""
    buf, z = b"", zlib.decompressobj(31)
    while True:
        data = stream.read(1 << 20)
        if not data:
            break
        while data:
            buf += z.decompress(data)
            data = z.unused_data
            if z.eof:
                head, block = buf.split(b"\r\n\r\n", 1)
                lines = head.decode("utf-8").split("\r\n")
                fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "")
                              for x in lines[1:])
                n = int(fields["Content-Length"])
                yield fields, block[:n]
                buf, z = b"", zlib.decompressobj(31)
            elif not data:
                break
    if buf:
        raise ValueError("archive ends inside a record")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as s:
                    for h, block in records(s):
                        digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
                        size = int(h["X-Payload-Length"])
                        if _b32(hashlib.sha1(block).hexdigest()) != h["WARC-Block-Digest"]:
                            raise ValueError(f"block digest differs in {name}")
                        if h["WARC-Type"] == "response":
                            payload = block.split(b"\r\n\r\n", 1)[1]
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"payload digest differs in {name}")
                        page, to = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        out.append((None if page is None else int(page), size, digest,
                                    h["WARC-Type"], None if to is None else int(to)))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type",
                           "refers_to"])
    return run


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives named in ``manifest``."""
    n = manifest.count()
    return manifest.select("file").repartition(max(1, min(n, 20_000))).mapInArrow(
        _reader(folder), REPORT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every page's record, as read back from the archives."""
    folder = shared_uri(work_dir(spark, "warc"))
    return read_warc(write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.page_id < g.top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < g.top THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.payload_bytes >= 1000 AND p.payload_digest = g.payload_digest
"""
