"""WARC archives: a deterministic sharded writer, and a reader that checks digests.

Records are sorted by a range of their key and cut into shards whose bounds follow from the keys
alone, not from how the input is partitioned. Each shard is written by one task into files
that roll at a compressed size. Headers and digests are made anew. A task writes under temporary
names that no other attempt uses; the manifest, which Spark writes with the rows of one attempt per
shard, says which of them count. These are then renamed, the manifest is published last,
and a reader opens only what the manifest names. A lost executor or a second attempt leaves
temporary files that are removed in the end.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.llm.registered import query, table
from plumbscore.session import materialize, scratch_path

BINS = 4096
SPLIT = 64
MAX_TASKS = 20_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcSpec:
    """How archives are cut. ``date`` stands in all records, so that a second run gives the same bytes."""

    prefix: str = "pages"
    roll_bytes: int = 64 * 1024 * 1024
    rows_per_shard: int = 5_000
    min_revisit_bytes: int = 0
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"


MANIFEST = "shard int, part int, file string, temporary string, records long, bytes long, sha256 string, first_page long, last_page long"
_MANIFEST_COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]


def filesystem(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder that driver and executors share, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return arrow_fs.LocalFileSystem(), path


def base32_sha1(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """One row per record: ``page_id``, ``url``, ``payload`` (null in revisits), ``payload_bytes``, ``sha1`` and ``refers_to``.

    The payload is text in UTF-8, null is empty. Of records with equal payloads of at least
    ``min_revisit_bytes``, that with the largest key is a response and the others revisit it; rows that share
    the largest key are all responses. Rows with a null key revisit, and are responses if no key is there.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    # Only payloads that occur again are joined; written first, so that their size is known.
    again = rows.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("response"), F.max_by("url", "page_id").alias("response_url"), F.count("*").alias("n"))
    again = materialize(again.where(f"n > 1 AND response IS NOT NULL AND payload_bytes >= {min_revisit_bytes}").drop("n", "payload_bytes"), "copies")
    joined = rows.join(again, "sha1", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "sha1",
        F.when(revisit, F.col("response")).alias("refers_to"),
        F.when(revisit, F.col("response_url")).alias("refers_to_url"),
    )


def _sharded(records: DataFrame, rows_per_shard: int) -> tuple[DataFrame, int]:
    """``records`` plus ``shard``: ascending ranges of the key of about ``rows_per_shard`` rows.

    Keys are counted in at most ``BINS`` bins of equal width. A bin with more rows than a shard takes and more than
    four in ``BINS`` of all is split again and again, so keys far from the others do not push these into one bin; at
    most a fourth of ``BINS`` bins are split at a time. Only the counts reach the driver. Neighbouring bins share
    a shard until it is full; a bin that is still too full is cut by key, and where it is a single key by a hash of the record.
    """
    known = records.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), F.count("*").alias("n")).first()
    if not known["n"]:
        return records.withColumn("shard", F.lit(0)), 1
    lo, hi = (known["lo"], known["hi"]) if known["lo"] is not None else (0, 0)
    width = max(1, -((lo - hi - 1) // BINS))
    # Decimals, since the keys may span all longs. A null key goes first.
    wide = "decimal(20,0)"
    value = F.col("page_id").cast(wide)
    number = F.coalesce(F.floor((value - F.lit(str(lo)).cast(wide)) / F.lit(str(width)).cast(wide)), F.lit(-1)).cast("int")
    placed = records.withColumn("bin", number)
    bins = {r["bin"]: (lo + r["bin"] * width, width if r["bin"] >= 0 else 1, r["count"]) for r in placed.groupBy("bin").count().collect()}
    limit, fresh = max(rows_per_shard, 4 * known["n"] / BINS), BINS
    while crowded := [(at, *bins.pop(at)) for at in sorted(bins) if bins[at][1] > 1 and bins[at][2] > limit]:
        rows, parts = [], {}
        for at, first, size, _ in crowded:
            part = -(-size // SPLIT)
            rows.append((at, str(first), str(part), fresh))
            parts |= {fresh + i: (first + i * part, part) for i in range(SPLIT)}
            fresh += SPLIT
        level = records.sparkSession.createDataFrame(rows, "bin int, first string, part string, child int")
        level = level.withColumns({"first": F.col("first").cast(wide), "part": F.col("part").cast(wide)})
        inner = F.col("child") + F.floor((value - F.col("first")) / F.col("part")).cast("int")
        placed = placed.join(F.broadcast(level), "bin", "left").withColumn("bin", F.coalesce(inner, F.col("bin"))).drop("first", "part", "child")
        counts = placed.where(F.col("bin") >= min(parts)).groupBy("bin").count().collect()
        bins |= {r["bin"]: (*parts[r["bin"]], r["count"]) for r in counts}
    rows, shard, filled = [], -1, rows_per_shard
    for first, size, count, at in sorted((*v, k) if k >= 0 else (v[0] - 1, *v[1:], k) for k, v in bins.items()):
        cuts = max(1, math.ceil(count / rows_per_shard))
        if cuts > 1 or filled + count > rows_per_shard:
            shard, filled = shard + 1, 0
        rows.append((at, str(first), str(size), shard, cuts))
        filled += count
        if cuts > 1:
            shard, filled = shard + cuts - 1, rows_per_shard
    ranges = records.sparkSession.createDataFrame(rows, "bin int, first string, size string, first_shard int, cuts int")
    ranges = ranges.withColumns({"first": F.col("first").cast(wide), "size": F.col("size").cast(wide)})
    inside = F.when(F.col("size") > 1, F.floor((value - F.col("first")) * F.col("cuts") / F.col("size")).cast("int"))
    mixed = F.pmod(F.xxhash64("page_id", "url", "sha1"), F.col("cuts")).cast("int")
    cut = F.coalesce(inside, mixed)
    # A few numbers for each bin that has rows.
    found = placed.join(F.broadcast(ranges), "bin")
    made = found.withColumn("shard", F.col("first_shard") + F.when(F.col("cuts") > 1, cut).otherwise(0))
    return made.drop("bin", "first", "size", "first_shard", "cuts"), shard + 1


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _one_line(text: str) -> str:
    """A header value: line breaks and other control signs as percent codes."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record_id(prefix: str, page_id: int | None, ordinal: int) -> str:
    """The same for the same page at every run; ``ordinal`` counts rows that repeat a page."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{prefix}/{page_id}/{ordinal}')}>"


def _record(row: dict, ordinal: int, spec: WarcSpec) -> bytes:
    revisit = row["refers_to"] is not None
    body = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + body
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(spec.prefix, row["page_id"], ordinal)),
        ("WARC-Date", spec.date),
        ("WARC-Target-URI", _one_line(row["url"])),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if row["page_id"] is not None:
        fields.append(("X-Page-ID", str(row["page_id"])))
    if revisit:
        fields += [
            ("WARC-Profile", REVISIT),
            ("WARC-Refers-To", record_id(spec.prefix, row["refers_to"], 0)),
            ("WARC-Refers-To-Target-URI", _one_line(row["refers_to_url"] or "")),
            ("WARC-Refers-To-Date", spec.date),
            ("X-Refers-To-Page-ID", str(row["refers_to"])),
        ]
    return _head(fields) + block + b"\r\n\r\n"


def _info(file: str, spec: WarcSpec) -> bytes:
    block = b"software: plumbscore\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(spec.prefix, None, zlib.crc32(file.encode()) + 1)), ("WARC-Date", spec.date)]
    return _head([*fields, ("WARC-Filename", file), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    """A gzip member without a time, so equal records give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Shard:
    """The files of one shard, one open at a time."""

    def __init__(self, shard: int, path: str, spec: WarcSpec):
        self.shard, self.path, self.spec = shard, path, spec
        self.fs, self.folder = filesystem(path)
        self.out, self.part, self.last, self.ordinal = None, 0, object(), 0

    def add(self, row: dict) -> Iterator[dict]:
        self.ordinal = self.ordinal + 1 if row["page_id"] == self.last else 0
        self.last = row["page_id"]
        member = _member(_record(row, self.ordinal, self.spec), self.spec.level)
        if self.out is not None and self.bytes + len(member) > self.spec.roll_bytes:
            yield self.close()
        if self.out is None:
            self._open()
        self._write(member)
        self.records += 1
        if row["page_id"] is not None:
            self.first = row["page_id"] if self.first is None else self.first
            self.final = row["page_id"]

    def _open(self) -> None:
        self.file = f"{self.spec.prefix}-{self.shard:06d}-{self.part:05d}.warc.gz"
        self.temporary = f"_temporary/{self.file}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        self.hash, self.bytes, self.records, self.first, self.final = hashlib.sha256(), 0, 0, None, None
        self._write(_member(_info(self.file, self.spec), self.spec.level))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def close(self) -> dict:
        self.out.close()
        self.out = None
        self.part += 1
        values = (self.shard, self.part - 1, self.file, self.temporary, self.records, self.bytes, self.hash.hexdigest(), self.first, self.final)
        return dict(zip(_MANIFEST_COLUMNS, values, strict=True))


def write_archives(pages: DataFrame, path: str, spec: WarcSpec = WarcSpec(), key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as archives below ``path`` and return the published manifest.

    ``path`` is in a store that driver and executors share. An empty table gives an empty manifest and no file.
    """
    spark = pages.sparkSession
    fs, folder = filesystem(path)
    fs.create_dir(f"{folder}/_temporary", recursive=True)
    records, shards = _sharded(plan_records(pages, key, url, payload, spec.min_revisit_bytes), spec.rows_per_shard)
    ordered = records.repartitionByRange(min(shards, MAX_TASKS), "shard").sortWithinPartitions("shard", "page_id", "url", "sha1")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    if current is None or current.shard != row["shard"]:
                        if current is not None:
                            done.append(current.close())
                        current = _Shard(row["shard"], path, spec)
                    done += current.add(row)
            if done:
                yield _manifest_batch(done)
        if current is not None:
            yield _manifest_batch([current.close()])

    written = materialize(ordered.mapInArrow(write, MANIFEST), "manifest")
    commit(written, path)
    return spark.read.parquet(f"{path.rstrip('/')}/manifest")


def _manifest_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in MANIFEST.split(", ")]))


def commit(written: DataFrame, path: str) -> None:
    """Give the files of a manifest their names, then publish it; both may be done again."""

    def rename(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                if fs.get_file_info(f"{folder}/{row['temporary']}").type == arrow_fs.FileType.File:
                    fs.move(f"{folder}/{row['temporary']}", f"{folder}/{row['file']}")
                if fs.get_file_info(f"{folder}/{row['file']}").size != row["bytes"]:
                    raise OSError(f"{row['file']} has not the size that the manifest states")
            yield batch

    fs, folder = filesystem(path)
    named = written.mapInArrow(rename, MANIFEST).drop("temporary")
    hidden = f"_manifest-{uuid.uuid4().hex}"
    named.write.parquet(f"{path.rstrip('/')}/{hidden}")
    if fs.get_file_info(f"{folder}/manifest").type != arrow_fs.FileType.NotFound:
        fs.delete_dir(f"{folder}/manifest")
    fs.move(f"{folder}/{hidden}", f"{folder}/manifest")
    # What is left belongs to attempts that do not count.
    if fs.get_file_info(f"{folder}/_temporary").type == arrow_fs.FileType.Directory:
        fs.delete_dir(f"{folder}/_temporary")


RECORDS = "file string, record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _lines(head: bytes) -> dict[str, str]:
    rows = (x.partition(b": ") for x in head.split(b"\r\n")[1:] if x)
    return {k.decode(): v.decode() for k, _, v in rows}


def _members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        while chunk:
            parts.append(unpacker.decompress(chunk))
            chunk = b""
            if unpacker.eof:
                yield b"".join(parts)
                chunk, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends inside a record")


def parse_record(data: bytes) -> dict | None:
    """The values of one record after its digests were checked; nothing for a ``warcinfo`` record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _lines(head)
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_lines(http)["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "record_id": fields["WARC-Record-ID"],
        "page_id": number("X-Page-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": None if revisit else payload,
    }


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all files that the manifest names; a damaged record is an error."""
    manifest = spark.read.parquet(f"{path.rstrip('/')}/manifest").select("file")
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    target = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORDS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{folder}/{file}", compression=None) as stream:
                    for member in _members(stream):
                        row = parse_record(member)
                        if row is None:
                            continue
                        row["file"] = file
                        held += len(row["payload"] or b"")
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        if len(rows) >= 1000 or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema=target)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(tasks, "file").mapInArrow(read, RECORDS).select(*names)


def _oracle() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # Five hexadecimal digits are four digits of base 32.
    quad = "CAST('0x' || substr(h, 5 * g + 1, 5) AS INTEGER)"
    digits = " || ".join(f"substr('{letters}', (({quad} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda g: {digits}), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM m
"""


@query("op1_warc", _oracle())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as archives and read back."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
