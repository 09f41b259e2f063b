"""WARC archives: a deterministic sharded writer and a reader.

Pages are cut into shards by page_id, at bounds from sums of bytes over intervals of page_ids, so the same table
gives the same shards on any cluster, each of about the same bytes; a page_id of more bytes than a shard is cut by digest.
A shard's records are sorted, written one gzip member each,
and rolled to a new file by compressed size. HTTP and WARC headers, record ids and digests are made
anew from the payload. Each file is written under a temporary name; the manifest of finished attempts is
stored, and a second job moves the files it names to their final names. Either job may run twice.

Of equal payloads of at least `least` bytes the largest page_id's is a response, the others revisit it;
that is decided on digests, by a grouped maximum, and reaches the writer as marker rows that sort next to
their page, so payloads cross one shuffle only.

Nulls, empties and repeats: a null html is an empty payload; a null url gives no target header; a null
page_id sorts first (cut by digest too, where there are many) and is never what others refer to; of repeated rows of one page, the first is as above
and the others revisit it. An empty table gives no file. Further columns aren't stored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import hot_join, lean, open_fs, scratch, store, table

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 9562
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, part long, path string, records long, n_bytes long"


def _urn(page_id, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{digest.hex()}')}>"


def _label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id, url: str | None, payload: bytes, digest: bytes, refers_to, date: str) -> bytes:
    """One WARC record; a revisit where refers_to isn't None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"WARC-Payload-Digest: {_label(digest)}", f"WARC-Block-Digest: {_label(hashlib.sha1(block).digest())}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roll:
    """Files of one shard, each rolled once it has `most` compressed bytes."""

    def __init__(self, out: str, most: int):
        self.out, self.most, self.f = out, most, None

    def add(self, shard: int, data: bytes):
        if self.f is not None and (self.shard != shard or self.size >= self.most):
            yield from self.close()
        if self.f is None:
            self.part = self.part + 1 if getattr(self, "shard", None) == shard else 0
            self.shard, self.size, self.n = shard, 0, 0
            self.path = f"{self.out}/open/{uuid.uuid4().hex}.warc.gz.open"
            fs, local = open_fs(self.path)
            fs.create_dir(local.rpartition("/")[0], recursive=True)
            self.f = fs.open_output_stream(local, compression=None)
        self.f.write(data)
        self.size += len(data)
        self.n += 1

    def close(self):
        if self.f is not None:
            self.f.close()
            self.f = None
            yield pa.RecordBatch.from_pydict({"shard": [self.shard], "part": [self.part], "path": [self.path], "records": [self.n], "n_bytes": [self.size]})


def _write(out: str, most: int, least: int, date: str, batches):
    roll, marks, last = _Roll(out, most), (None, None), None
    for batch in batches:
        for shard, page, digest, mark, url, payload, refers in zip(*(batch.column(k) for k in range(7)), strict=True):
            key, digest = (page.as_py(), digest.as_py()), digest.as_py()
            if mark.as_py() == 0:
                marks = key, refers.as_py()
                continue
            data = payload.as_py() or b""
            to = marks[1] if marks[0] == key else key[0] if last == key and len(data) >= least else None
            last = key
            yield from roll.add(shard.as_py(), _member(record(key[0], url.as_py(), data, bytes.fromhex(digest), to, date)))
    yield from roll.close()


def _commit(out: str, batches):
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            final = f"{out}/pages-{r['shard']:06d}-{r['part']:04d}.warc.gz"
            fs, there = open_fs(final)
            _, here = open_fs(r["path"])
            if fs.get_file_info(here).is_file:  # else an earlier attempt has moved it
                fs.move(here, there)
            if fs.get_file_info(there).size != r["n_bytes"]:
                raise OSError(f"{final} isn't whole")
            r["path"] = final
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


#: What a null page_id sorts as.
NO_PAGE = -(1 << 63)
#: Intervals that a round starts with, and parts that a heavy one is cut into.
_WIDE, _CUT = 1024, 16


def cuts(slim: DataFrame, shard_bytes: int, most_shards: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """(first page_ids of intervals, ascending from NO_PAGE; shards of each), from rows (page_id, n bytes).

    Intervals of equal width are summed up, and heavy ones cut and summed again until each is light or a single page_id;
    then neighbours are joined up to a shard's size. The driver sees a sum an interval: a few numbers a shard, of which
    there are at most most_shards, as shards grow beyond shard_bytes in very large tables.
    """
    low, high, total = slim.agg(F.min("page_id"), F.max("page_id"), F.sum("n")).first()
    if low is None:
        starts = np.array([NO_PAGE])
    else:
        starts = np.unique(np.array([NO_PAGE, *(low + (high + 1 - low) * k // _WIDE for k in range(_WIDE))], np.int64))
    room = max(shard_bytes, int(total or 0) // most_shards)
    while True:
        at = starts

        @F.pandas_udf("long")
        def interval(page: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(at, page.fillna(NO_PAGE).to_numpy(np.int64), side="right") - 1)  # noqa: B023

        sums = np.zeros(len(starts), np.int64)
        for k, n in slim.groupBy(interval("page_id").alias("k")).agg(F.sum("n").alias("n")).toLocalIterator():
            sums[k] = n or 0
        ends = [*starts[1:].tolist(), (high if high is not None else NO_PAGE) + 1]
        wide = np.array([b - a > 1 for a, b in zip(starts.tolist(), ends, strict=True)])
        wide[0] = False  # null page_ids
        heavy = np.flatnonzero((sums * 2 > room) & wide)
        joined, held = [], None
        for k, (start, n) in enumerate(zip(starts.tolist(), sums.tolist(), strict=True)):
            if held is None or held + n > room // (2 if len(heavy) else 1) or k in (0, 1):
                joined.append(k)
                held = 0
            held += n
        if not len(heavy):
            sums = np.add.reduceat(sums, joined)
            return starts[joined], np.maximum(1, -(-sums // (2 * room)))
        more = [a + (b - a) * j // _CUT for a, b in ((int(starts[k]), int(ends[k])) for k in heavy.tolist()) for j in range(_CUT)]
        after = heavy[heavy + 1 < len(starts)] + 1  # what follows a cut interval begins anew
        starts = np.unique(np.concatenate([starts[joined], np.array(more, np.int64), starts[after]]))


def write_warc(pages: DataFrame, out: str, least: int = 1000, shard_bytes: int = 32 << 20, roll_bytes: int = 32 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) as archives below `out`; returns the manifest (shard, part, path, records, n_bytes).

    Nulls, empties and repeats are as the module says.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    full = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    full = full.withColumn("digest", F.sha1("payload"))
    slim = store(full.select("page_id", "digest", F.octet_length("payload").cast("long").alias("n")), "digests")

    # a payload of very many copies is dealt to several tasks
    keyed = slim.where(F.col("n") >= least).withColumn("same", F.concat_ws("-", "digest", F.col("n").cast("string")))
    last = store(keyed.groupBy("same").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and last is not null"), "repeated")
    marks = hot_join(keyed, last, "same", "copies", 96).where("page_id is null or page_id < last").select("page_id", "digest", "last").distinct()

    starts, parts = cuts(slim, shard_bytes)
    first = np.cumsum(parts) - parts

    @F.pandas_udf("int")
    def shard_of(page: pd.Series, digest: pd.Series) -> pd.Series:
        k = np.searchsorted(starts, page.fillna(NO_PAGE).to_numpy(np.int64), side="right") - 1
        sub = digest.str[:12].map(lambda d: int(d, 16)).to_numpy(np.int64) % parts[k]
        return pd.Series((first[k] + sub).astype(np.int32))

    # a page and its marker have the same keys, and the marker sorts first
    both = full.select("page_id", "digest", F.lit(1).alias("mark"), "url", "payload", F.lit(None).cast("long").alias("refers")).unionAll(
        marks.select("page_id", "digest", F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("binary"), "last")
    )
    keyed = both.withColumn("shard", shard_of("page_id", "digest") if parts.sum() > 1 else F.lit(0)).select("shard", "page_id", "digest", "mark", "url", "payload", "refers")
    dealt = keyed.repartitionById(int(parts.sum()), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "mark", "url")
    attempts = store(dealt.mapInArrow(functools.partial(lean, _write, out, roll_bytes, least, date), MANIFEST), "warc-attempts")
    attempts.repartition(max(1, min(1000, int(parts.sum()))), "shard", "part").mapInArrow(functools.partial(lean, _commit, out), MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def records_in(f):
    """(headers, block) of each record of an open archive; a record at a time is held."""
    rest = f.read(1 << 18)
    while rest:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            parts.append(z.decompress(rest))
            rest = z.unused_data if z.eof else f.read(1 << 18)
            if not rest and not z.eof:
                raise ValueError("the archive ends inside a record")
        rest = rest or f.read(1 << 18)
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, body[: int(headers["Content-Length"])]


def _read(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, local = open_fs(path)
            f = fs.open_input_stream(local, compression=None)
            out = []
            for h, block in records_in(f):
                if _label(hashlib.sha1(block).digest()) != h["WARC-Block-Digest"]:
                    raise ValueError(f"{path}: a block's digest doesn't hold")
                payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                if payload is not None and _label(hashlib.sha1(payload).digest()) != h["WARC-Payload-Digest"]:
                    raise ValueError(f"{path}: a payload's digest doesn't hold")
                page, to = h.get("X-Page"), h.get("X-Refers-To-Page")
                out.append(
                    {
                        "page_id": int(page) if page else None,
                        "url": h.get("WARC-Target-URI"),
                        "payload": payload,
                        "payload_bytes": int(h["X-Payload-Length"]),
                        "payload_digest": base64.b32decode(h["WARC-Payload-Digest"][5:]).hex(),
                        "record_type": h["WARC-Type"],
                        "refers_to": int(to) if to else None,
                    }
                )
                if len(out) == 500:
                    yield pa.RecordBatch.from_pylist(out, schema=_ROWS)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ROWS)


_ROWS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """The records of the archives that the manifest names; digests are checked, a revisit's payload is null.

    Without a manifest the archives aren't finished, and Spark says that the path doesn't exist.
    """
    kinds = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    return manifest.repartition(max(1, min(manifest.count(), 100_000)), "path").select("path").mapInArrow(_read, kinds)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM q
"""
