"""Deterministic, sharded WARC archives: writer and reader."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage

#: Payload bytes from which equal payloads are written once.
REVISIT_BYTES = 100
SHARD_BYTES, ROLL_BYTES = 32 << 20, 8 << 20
#: Shards at most (beyond that they grow), and sampled rows for each from which their bounds are taken.
MOST_SHARDS, SAMPLES_PER_SHARD = 16_384, 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:orrery:warc")
_MANIFEST = "shard int, roll int, temporary string, name string, bytes long, records long, sha256 string"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, file string, file_offset long"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _deflate(data: bytes) -> bytes:
    """One gzip member; its header holds no time or name."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _clean(value: str) -> str:
    """A header value on one line; only white space at its ends and line breaks change."""
    return " ".join(value.split("\n")).replace("\r", " ").strip()


def _record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """Of the ``copy``-th of equal rows."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, json.dumps([page_id, url, digest, copy]))}>"


def page_record(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, str | None] | None, date: str) -> bytes:
    """A response record, or a revisit of the response of the first row of (page_id, url) ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _record_id(page_id, url, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url) if url else None),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", _PROFILE if refers_to is not None else None),
        ("WARC-Refers-To", _record_id(*refers_to, digest, 0) if refers_to is not None else None),
        ("X-Page-ID", None if page_id is None else str(page_id)),
        ("X-Refers-To-Page-ID", None if refers_to is None else str(refers_to[0])),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(headers, block)


class _Roll:
    """The open file of a shard: written under a temporary name, which no other attempt shares."""

    def __init__(self, base: str, shard: int, roll: int, date: str):
        from pyarrow import fs

        self.shard, self.roll, self.name = shard, roll, f"part-{shard:06d}-{roll:05d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        system, path = fs.FileSystem.from_uri(base)
        system.create_dir(f"{path}/_temporary", recursive=True)
        self.out = system.open_output_stream(f"{path}/{self.temporary}", compression=None)
        self.bytes = self.records = 0
        self.sha = hashlib.sha256()
        fields = b"software: orrery\r\nformat: WARC File Format 1.1\r\n"
        info = [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_IDS, self.name)}>"),
            ("WARC-Date", date),
            ("WARC-Filename", self.name),
            ("Content-Type", "application/warc-fields"),
        ]
        self.add(_record(info, fields))

    def add(self, record: bytes) -> None:
        member = _deflate(record)
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return (self.shard, self.roll, self.temporary, self.name, self.bytes, self.records, self.sha.hexdigest())


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [x.split()[0] for x in _MANIFEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


def _writer(base: str, roll_bytes: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by shard, page, url, digest and kind. A row without a page (kind 0) comes before the
        pages it is about and names the page that holds the response of their payload."""
        roll, now, first, copy = None, None, None, 0
        for batch in batches:
            for row in zip(*batch.columns):
                shard, page_id, url, digest, kind, first_id, first_url = (x.as_py() for x in row[:7])
                if (page_id, url, digest) != now:
                    now, first, copy = (page_id, url, digest), None, 0
                if kind == 0:
                    first = first_id, first_url
                    continue
                if roll is None or roll.shard != shard or roll.bytes >= roll_bytes:
                    number = roll.roll + 1 if roll is not None and roll.shard == shard else 0
                    if roll is not None:
                        yield _manifest_batch([roll.close()])
                    roll = _Roll(base, shard, number, date)
                refers_to = None if copy == 0 and first == (page_id, url) else first
                roll.add(page_record(page_id, copy, url, row[7].as_py() or b"", digest, refers_to, date))
                copy += 1
        if roll is not None:
            yield _manifest_batch([roll.close()])

    return write


def _order(page_id: int | None, url: str | None, digest: str) -> tuple:
    """Spark's order of the three: nulls first."""
    return page_id is not None, page_id or 0, url is not None, url or "", digest


def _bounds(keys: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first key of each shard but the first: (page_id, url, digest) by ``_order``.

    Quantiles, by payload bytes, of the rows whose hash falls below a share that gives about SAMPLES_PER_SHARD
    rows a shard (all rows of a small table), so that they depend on the rows alone, not on how these are
    dealt or spaced. Equal rows are one; rows of one page_id may lie in several shards.
    """
    total, rows = keys.agg(F.sum("n"), F.count("*")).first()
    shards = min(MOST_SHARDS, -(-(total or 0) // shard_bytes))
    if shards < 2:
        return []
    share = max(1, rows // (shards * SAMPLES_PER_SHARD))
    sample = keys.where(F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(share)) == 0)
    sample = sample.groupBy("page_id", "url", "digest").agg(F.sum("n").alias("n")).collect()
    sample = sorted((_order(r["page_id"], r["url"], r["digest"]), r["n"]) for r in sample)
    found, before, last, whole = [], 0, 0, max(1, sum(n for _, n in sample))
    for key, n in sample:
        if before * shards // whole > last:
            found.append(key)
            last = before * shards // whole
        before += n
    return found


def _place(bounds: list[tuple]):
    """Adds the shard, as the first column, to rows that begin with page_id, url and digest."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            shard = pa.array([bisect_right(bounds, _order(*k)) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, *batch.columns], names=["shard", *batch.schema.names])

    return place


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: datetime = datetime(2000, 1, 1, tzinfo=timezone.utc)) -> DataFrame:
    """Write one WARC record for each row into ``folder`` (a URI that executors and driver share) and
    return the manifest: (shard, roll, name, bytes, records, sha256) of each file.

    The payload is the html in UTF-8 (null: empty). Records are range-partitioned and sorted by
    page_id, then url and digest, so that equal tables give equal files, byte for byte; a shard has about
    ``shard_bytes`` of payload. A shard's next file begins once the compressed size of the last has reached ``roll_bytes``.
    Of equal payloads of REVISIT_BYTES or more, the one with the smallest page_id is a response (then the
    smallest url, then the first of repeated rows), the others are revisits; rows without a page_id are responses. Tasks
    write under temporary names and report them; only the files that a finished attempt has reported
    are renamed. The table ``manifest`` in the folder names them, and MANIFEST.json, with the
    totals, comes last: a folder without it isn't an archive.
    """
    spark = pages.sparkSession
    stamp = date.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"),
    )
    keys = cut_lineage(base.select("page_id", "url", "digest", F.octet_length("payload").alias("n")), "warc-keys")
    bounds = _bounds(keys, shard_bytes)
    large = keys.where(f"n >= {REVISIT_BYTES} and page_id is not null")
    first = large.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    first = cut_lineage(first, "warc-first")  # a side of its own, or the join couldn't be split on a hot payload
    told = large.select("page_id", "url", "digest").join(first, "digest").distinct()
    null = lambda kind: F.lit(None).cast(kind)
    rows = told.select("page_id", "url", "digest", F.lit(0).alias("kind"), "first_id", "first_url", null("binary").alias("payload"))
    rows = rows.unionByName(base.select("page_id", "url", "digest", F.lit(1).alias("kind"), null("long").alias("first_id"), null("string").alias("first_url"), "payload"))
    rows = rows.mapInArrow(_place(bounds), "shard int, page_id long, url string, digest string, kind int, first_id long, first_url string, payload binary")
    rows = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "url", "digest", "kind")
    written = cut_lineage(rows.mapInArrow(_writer(folder, roll_bytes, stamp), _MANIFEST), "warc-manifest")
    _commit(written, folder, len(bounds) + 1)
    return written.drop("temporary")


def _commit(written: DataFrame, folder: str, shards: int) -> None:
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for old, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if system.get_file_info(f"{path}/{old}").type != fs.FileType.NotFound:  # else an earlier attempt moved it
                    system.move(f"{path}/{old}", f"{path}/{new}")
            yield pa.RecordBatch.from_arrays([batch.column(1)], names=["name"])

    from pyarrow import fs

    moved = written.select("temporary", "name").mapInArrow(rename, "name string").count()
    files, size, records = written.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("records"), F.lit(0))).first()
    if moved != files:
        raise RuntimeError("files are missing")
    written.drop("temporary").write.mode("overwrite").parquet(f"{folder}/manifest")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/MANIFEST.json.tmp", compression=None) as out:
        out.write(json.dumps({"shards": shards, "files": files, "bytes": size, "records": records}, sort_keys=True).encode())
    system.move(f"{path}/MANIFEST.json.tmp", f"{path}/MANIFEST.json")
    if system.get_file_info(f"{path}/_temporary").type != fs.FileType.NotFound:
        system.delete_dir(f"{path}/_temporary")


def _members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of each gzip member."""
    at, rest = 0, b""
    while True:
        unpack, parts, size = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            rest = rest or stream.read(chunk)
            if not rest:
                if size:
                    raise ValueError("the last member isn't whole")
                return
            size += len(rest)
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        size -= len(rest)
        yield at, b"".join(parts)
        at += size


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers, in lower case, and the block of each record of an unpacked member."""
    at = 0
    while data[at:].strip():
        end = data.find(b"\r\n\r\n", at)
        version, *lines = data[at : max(at, end)].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not version.startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("the block isn't whole")
        yield headers, block
        at = end + 4 + size + 4


def _page_row(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    digest = headers["warc-payload-digest"].partition(":")[2]
    kind = headers["warc-type"]
    if hashlib.sha256(block).hexdigest() != headers["warc-block-digest"].partition(":")[2]:
        raise ValueError("the block has another digest")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["content-length"])):
        raise ValueError("the payload has another digest or length")
    number = lambda k: int(headers[k]) if k in headers else None
    size = len(payload) if kind == "response" else int(fields["content-length"])
    return number("x-page-id"), headers.get("warc-target-uri"), kind, number("x-refers-to-page-id"), size, digest, headers["warc-record-id"]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The page records of the archives that the manifest of ``folder`` names, in any order: page_id,
    url, record_type, refers_to, payload_bytes, payload_digest, record_id, file and offset. Blocks
    and payloads are held against their digests, files against their number of records; a difference
    fails the task."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/MANIFEST.json", compression=None) as file:
        totals = json.loads(file.read())
    files = spark.read.parquet(f"{folder}/manifest").select("name", "records", "shard")
    if files.count() != totals["files"]:
        raise ValueError("the manifest isn't whole")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = [x.split()[0] for x in _RECORDS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, n = [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as file:
                    for offset, data in _members(file):
                        for headers, block in parse_records(data):
                            n += 1
                            if headers["warc-type"] in ("response", "revisit"):
                                found.append((*_page_row(headers, block), name, offset))
                if n != records:
                    raise ValueError(f"{name} has {n} records, not {records}")
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names=columns)

    return files.repartitionById(totals["shards"], "shard").sortWithinPartitions("name").mapInArrow(rows, _RECORDS)
