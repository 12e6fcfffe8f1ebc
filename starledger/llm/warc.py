"""WARC: a deterministic sharded writer, and a reader that checks what it reads.

Records are range-sorted by page id.  The split points come from a sample chosen by hashed id, so
the same pages give the same shards, files and bytes on every run.  One task writes a shard as a
stream: headers and digests are generated anew, every record is its own gzip member, and a file is
rolled when its compressed size reaches the limit.  Files are written under temporary names that
only this attempt uses, renamed when the shard is complete, and named in the shard's manifest, which
appears last; a lost or repeated task therefore leaves the same files.  The reader opens only files
of the folder's manifest.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is
written in full and the others as revisits of it.

Defined results: a null html is an empty payload; a null url is written as ``urn:page:`` and the id;
null ids sort first, and payloads that only rows without an id have are revisits of no known id;
of repeated rows one is the response; further columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.llm.common import partitions, pick, slices
from starledger.session import cut_lineage

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 256 << 20      # compressed size at which a file is closed
SHARD_BYTES = 512 << 20     # payload per shard that the number of shards aims at
SAMPLES_PER_SHARD = 64
LEVEL = 5                   # gzip level
CHUNK = 1 << 20
SLICE = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-record")


# ---------------------------------------------------------------- records

def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{digest}/{copy}')}>"


def _target(url: str | None, page: int | None) -> str:
    if not url:
        return f"urn:page:{page}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers),
            f"WARC-Block-Digest: sha1:{payload_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, copy: int,
                refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers alone."""
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", DATE),
               ("WARC-Record-ID", record_id(page, digest, copy)), ("WARC-Target-URI", _target(url, page))]
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page-Id", str(refers_to)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    return _record(headers, http if revisit else http + payload)


def _info(name: str) -> bytes:
    body = b"software: sharded writer\r\nformat: WARC File Format 1.1\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Date", DATE), ("WARC-Filename", name),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"),
                    ("Content-Type", "application/warc-fields")], body)


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)     # no time in the header: equal bytes every run
    return packer.compress(record) + packer.flush()


# ---------------------------------------------------------------- files

def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; also of Spark's ``file:/`` spelling and of bare paths."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    if "://" not in folder:
        folder = "file://" + os.path.abspath(folder)
    return fs.FileSystem.from_uri(folder)


def _replace(store: fs.FileSystem, source: str, target: str) -> None:
    if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(target).type != fs.FileType.NotFound:
        store.delete_file(target)      # elsewhere a move does not overwrite
    store.move(source, target)


class _Shard:
    """The files of one shard while its task writes them."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.store, self.root = _open(folder)
        self.shard, self.roll = shard, roll_bytes
        self.attempt = f"_temporary/{uuid.uuid4().hex}"
        self.files: list[dict] = []
        self.out = None
        self.store.create_dir(f"{self.root}/{self.attempt}", recursive=True)

    def add(self, record: bytes) -> None:
        if self.out is None:
            name = f"pages-{self.shard:06d}-{len(self.files):05d}.warc.gz"
            self.out = self.store.open_output_stream(f"{self.root}/{self.attempt}/{name}", compression=None)
            self.files.append({"file": name, "shard": self.shard, "records": 0, "bytes": 0, "sum": hashlib.sha256()})
            self._write(_info(name))
        self._write(record)
        self.files[-1]["records"] += 1
        if self.files[-1]["bytes"] >= self.roll:
            self.close()

    def _write(self, record: bytes) -> None:
        packed = _member(record)
        self.out.write(packed)
        self.files[-1]["bytes"] += len(packed)
        self.files[-1]["sum"].update(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files[-1]["sha256"] = self.files[-1].pop("sum").hexdigest()
            self.out = None

    def commit(self) -> list[dict]:
        """Final names for the files, then the shard's manifest."""
        self.close()
        for entry in self.files:
            _replace(self.store, f"{self.root}/{self.attempt}/{entry['file']}", f"{self.root}/{entry['file']}")
        name = f"shard-{self.shard:06d}.json"
        with self.store.open_output_stream(f"{self.root}/{self.attempt}/{name}") as out:
            out.write(json.dumps(self.files, indent=1).encode())
        _replace(self.store, f"{self.root}/{self.attempt}/{name}", f"{self.root}/{name}")
        self.store.delete_dir(f"{self.root}/{self.attempt}")
        return self.files


# ---------------------------------------------------------------- writer

def _splits(pages: DataFrame, shards: int) -> np.ndarray:
    """Split points between shards from the ids with the smallest hashes: the same on every run."""
    sample = (pages.select("id").filter("id IS NOT NULL").distinct()
              .orderBy(F.xxhash64("id"), "id").limit(shards * SAMPLES_PER_SHARD).toArrow().column("id"))
    ids = np.sort(sample.to_numpy())
    return np.unique(ids[np.arange(1, shards) * len(ids) // shards]) if len(ids) else np.empty(0, np.int64)


def write(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", html: str = "html",
          min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Write every page and return the folder's manifest (file, shard, records, bytes, sha256)."""
    spark = pages.sparkSession
    slim = pick(pages, id=ident, url=url, html=html).select(
        F.col("id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    if shards is None:
        total = slim.agg(F.sum(F.octet_length("html").cast("bigint"))).first()[0] or 0
        shards = max(partitions(spark), -(-total // SHARD_BYTES))
    splits = _splits(slim, shards)
    # Copies: payload key and id only; the groups are counted before anything is joined.
    keyed = slim.filter(F.octet_length("html") >= min_bytes).select("id", F.sha2("html", 256).alias("key"))
    first = (keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("key", "first"))
    copies = (keyed.join(first, "key").filter(~F.col("id").eqNullSafe(F.col("first")))
              .select("id", F.lit(None).cast("string").alias("url"), F.col("key").alias("html"),
                      F.col("first"), F.lit(0).alias("kind")).distinct())
    # Marks of copies travel beside the pages and sort just before them, so payloads move once.
    both = slim.select("id", "url", "html", F.lit(None).cast("bigint").alias("first"), F.lit(1).alias("kind"))
    names = ["id", "url", "html", "first", "kind"]

    def dealt(batches):
        for whole in batches:
            for batch in slices(whole, "html", SLICE):
                ids = batch.column("id")
                known = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
                shard = np.searchsorted(splits, known, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shard)],
                                                 [*names, "shard"])

    def write_shard(batches):
        shard = None
        page, marks, seen = object(), {}, {}
        for whole in batches:
            for batch in slices(whole, "html", SLICE):
                for ident_, url_, body, first_, kind, number in zip(*(batch.column(c).to_pylist() for c in [*names, "shard"])):
                    if shard is None:
                        shard = _Shard(folder, number, roll_bytes)
                    if ident_ != page:
                        page, marks, seen = ident_, {}, {}
                    if kind == 0:
                        marks[body] = first_
                        continue
                    payload = body.encode()
                    key = hashlib.sha256(payload).hexdigest()
                    digest = payload_digest(payload)
                    copy = seen.get(key, 0)
                    seen[key] = copy + 1
                    revisit = key in marks or (copy > 0 and len(payload) >= min_bytes)
                    shard.add(page_record(ident_, url_, payload, digest, copy, marks.get(key, ident_), revisit))
        if shard is not None:
            done = shard.commit()
            yield pa.RecordBatch.from_pylist(done, pa.schema([
                ("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()),
                ("sha256", pa.string())]))

    files = (both.unionByName(copies).mapInArrow(dealt, "id bigint, url string, html string, first bigint, kind int, shard int")
             .repartitionById(len(splits) + 1, F.col("shard"))
             .sortWithinPartitions(F.col("id").asc_nulls_first(), "kind", "url", "html")
             .mapInArrow(write_shard, "file string, shard int, records bigint, bytes bigint, sha256 string"))
    files.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(files.schema).parquet(f"{folder}/manifest")


# ---------------------------------------------------------------- reader

def _members(stream):
    """Uncompressed gzip members of a file, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while chunk := stream.read(CHUNK):
        while chunk:
            parts.append(unpack.decompress(chunk))
            if not unpack.eof:
                break
            yield b"".join(parts)
            chunk, parts, unpack = unpack.unused_data, [], zlib.decompressobj(31)
    if parts and any(parts):
        raise ValueError("the archive ends within a record")


def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[:int(headers["content-length"])]
    if headers["warc-block-digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError(f"block digest of {headers['warc-record-id']} does not fit")
    return headers, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per page record: id, url, payload_bytes, payload_digest, record_type, refers_to, file."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]

    def records(batches):
        store, root = _open(folder)
        for batch in batches:
            for name, expected in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                rows, found = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        headers, block = _parsed(record)
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http).group(1))
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
                            raise ValueError(f"payload digest of {headers['warc-record-id']} does not fit")
                        ident, other = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                        rows.append((int(ident) if ident else None, headers["warc-target-uri"], length, digest, kind,
                                     int(other) if other else None, name))
                        found += 1
                        if len(rows) >= 4096:
                            yield _rows(rows, names)
                            rows = []
                if found != expected:
                    raise ValueError(f"{name} has {found} records, its manifest {expected}")
                if rows:
                    yield _rows(rows, names)

    n = max(1, min(manifest.count(), 4 * partitions(spark)))
    return manifest.select("file", "records").repartition(n).mapInArrow(
        records, "id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
                 "refers_to bigint, file string")


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def archived(pages: DataFrame, folder: str, ident: str = "page_id", **options) -> DataFrame:
    """Write all pages, read the archives back: what the records say of each page."""
    write(pages, folder, ident=ident, **options)
    return cut_lineage(read(pages.sparkSession, folder), "archived").select(
        F.col("id").alias(ident), "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file")
