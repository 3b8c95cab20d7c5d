"""WARC archives as a PySpark Python data source ("warc").

Writing: one archive per task and rollover size, each record its own gzip member, whose extra field
"sl" holds the member's compressed and plain sizes. Each commit adds a manifest of its files and of
places where a reader may begin, so files of failed or repeated task attempts are never read, earlier
appends stay, and large files are read by several tasks. Overwriting replaces what earlier manifests list.

Reading: partitions are planned from file sizes and those places; predicates on record_type and on header
columns are pushed down; each record's head is parsed first, and the payload of a record that a predicate
rejects, or that the query does not ask for, is not decoded: with the extra field, and in plain archives, it
is not even read or inflated; any other gzip member is inflated piece by piece to find its end, and
dropped. A folder without a manifest, or a single file, is read as standard archives (.warc, .warc.gz),
whole gzip files of many records included, one task a file. Their page_id is null.

Defined results: a null payload is empty; a null or odd url is kept out of, or escaped in, the header;
a null page_id is read back as null; rows with the same payload and the smallest page_id are all
responses; repeated rows are written one by one; very long payloads are held one at a time; other columns,
whatever their names, are not written; an empty table gives an archive folder without files.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from . import _common as C

SCHEMA = "record_type string, record_id string, page_id long, refers_to long, target_uri string, record_date string, payload_digest string, payload_bytes long, payload binary"
#: Columns known from a record's header alone.
HEADER_COLUMNS = ("record_type", "record_id", "page_id", "refers_to", "target_uri", "record_date", "payload_digest", "payload_bytes")
MANIFEST = "manifest-"
ROLL_BYTES = 256 << 20
SPLIT_BYTES = 64 << 20
#: Bytes read, or inflated, at once.
PIECE = 1 << 16
HEAD = "<BBBBIBBH"  # gzip header up to the extra field's length
EXTRA = "<2sHII"  # subfield "sl": 8 bytes, compressed and plain size
HEAD_SIZE, EXTRA_SIZE = struct.calcsize(HEAD), struct.calcsize(EXTRA)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def file_system(path: str):
    """(filesystem, path in it); executors reach whatever store the shared folder is in."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def record_id(page_id: int | None, digest: str, again: str = "") -> str:
    """Of the response with this payload; ``again`` tells other records of the page apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}/{again}')}>"


def head_of(row: dict, date: str, again: str = "") -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'], row['payload_digest'], again)}", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["target_uri"], safe="!#$%&'()*+,/:;=?@[]~ "))
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'], row['payload_digest'])}", f"X-Refers-To-Page: {row['refers_to']}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    return "\r\n".join(lines).encode()


def record_of(row: dict, date: str, again: str = "") -> bytes:
    """A record before compression; revisits carry the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (row["payload"] or b"") if row["record_type"] == "response" else http
    return head_of(row, date, again) + f"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}".encode() + END + block + END


def member_of(record: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = HEAD_SIZE + EXTRA_SIZE + len(body) + 8
    if size >= 1 << 32:  # the field cannot say so: a standard member
        return struct.pack("<BBBBIBB", 31, 139, 8, 0, 0, 0, 255) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    return struct.pack(HEAD, 31, 139, 8, 4, 0, 0, 255, EXTRA_SIZE) + struct.pack(EXTRA, b"sl", 8, size, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def fields_of(head: bytes) -> dict:
    """The header's columns and, below "", its block's length and kind."""
    pairs: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:  # a folded line
            pairs[last] = f"{pairs[last]} {line.strip()}".strip()
        elif ":" in line:
            last = line.partition(":")[0].strip().lower()
            pairs[last] = line.partition(":")[2].strip()
    number = lambda k: int(x) if (x := pairs.get(k, "")).lstrip("-").isdecimal() else None
    digest = pairs.get("warc-payload-digest")
    return {
        "record_type": pairs.get("warc-type"), "record_id": pairs.get("warc-record-id"), "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page"), "target_uri": pairs.get("warc-target-uri"),
        "record_date": pairs.get("warc-date"), "payload_digest": digest and digest.removeprefix("sha256:"), "payload_bytes": number("x-payload-length"), "": (number("content-length") or 0, pairs.get("content-type", "")),
    }


def payload_of(fields: dict, block: bytes) -> bytes:
    """What stands behind the HTTP head, or the whole block of other kinds of records."""
    return block.partition(END)[2] if fields[""][1].startswith("application/http") else block


class _Plain:
    """Bytes of an uncompressed archive; what is skipped is not read."""

    def __init__(self, f, at: int, end: int):
        self.f, self.at, self.end = f, at, end

    def read(self, n: int) -> bytes:
        self.f.seek(self.at)
        out = self.f.read(min(n, self.end - self.at))
        self.at += len(out)
        return out

    def back(self, n: int) -> None:
        self.at -= n

    def skip(self, n: int) -> None:
        self.at += n


class _Inflated:
    """Plain bytes of the gzip members from ``at`` up to ``end``, inflated as they are asked for. With ``one``,
    they are a single member, and what is skipped in it is left compressed."""

    def __init__(self, f, at: int, end: int, one: bool = False):
        self.f, self.at, self.end, self.one = f, at, end, one
        self.z, self.held, self.last = zlib.decompressobj(31), b"", b""

    def _more(self, n: int) -> bool:
        if self.z.eof:
            self.at -= len(self.z.unused_data)
            if self.one or self.at >= self.end:
                return False
            self.z = zlib.decompressobj(31)
        raw = self.z.unconsumed_tail
        if not raw:
            self.f.seek(self.at)
            raw = self.f.read(min(PIECE, self.end - self.at))
            self.at += len(raw)
        self.held += self.z.decompress(raw, n)
        return bool(raw)

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self._more(n - len(self.held)):
            pass
        self.last, self.held = self.held[:n], self.held[n:]
        return self.last

    def back(self, n: int) -> None:
        self.held = self.last[len(self.last) - n :] + self.held

    def skip(self, n: int) -> None:
        while n > 0 and not self.one and (out := self.read(min(n, PIECE))):
            n -= len(out)


def _record(source, wanted: Callable[[dict], bool | None]):
    """(fields, block or None) of the record that ``source`` stands before; None at its end. ``wanted`` says
    of the fields: True for the block too, False for the header, None to leave the record out."""
    head = b""
    while END not in head:
        piece = source.read(1024)
        if not piece:
            return None
        head = (head + piece).lstrip(b"\r\n")
    head, _, over = head.partition(END)
    source.back(len(over))
    if not head.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {head[:40]!r}")
    fields = fields_of(head)
    ask = wanted(fields)
    block = None
    if ask:
        block = bytearray()
        while len(block) < fields[""][0] and (piece := source.read(min(PIECE, fields[""][0] - len(block)))):
            block += piece
    else:
        source.skip(fields[""][0])
    return fields if ask is not None else None, bytes(block) if block is not None else None


def walk(f, start: int, end: int, wanted: Callable[[dict], bool | None]) -> Iterator[tuple[dict, bytes | None]]:
    """The records of an archive between two places where records or members begin."""
    at = start
    while at < end:
        f.seek(at)
        first = f.read(HEAD_SIZE + EXTRA_SIZE)
        size = None
        if first[:2] == b"\x1f\x8b" and len(first) == HEAD_SIZE + EXTRA_SIZE and first[3] == 4:
            name, _, size, _ = struct.unpack(EXTRA, first[HEAD_SIZE:])
            size = size if name == b"sl" else None
        if size:
            source = _Inflated(f, at, at + size, one=True)
            got = _record(source, wanted)
            at += size
            if got and got[0] is not None:
                yield got
            continue
        source = _Inflated(f, at, end) if first[:2] == b"\x1f\x8b" else _Plain(f, at, end)
        while got := _record(source, wanted):
            if got[0] is not None:
                yield got
        return


class WarcDataSource(DataSource):
    """Options: path; payload ("false" leaves payloads null and undecoded); date (WARC-Date of what is
    written, now if not given)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], str(self.options.get("payload", "true")).lower() != "false")

    def writer(self, schema, overwrite) -> DataSourceWriter:
        date = self.options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        return WarcWriter(self.options["path"], date, overwrite)


@dataclass
class Ranges(InputPartition):
    """(file, start, end) of archives that one task reads."""

    parts: list[tuple[str, int, int]] = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    """(file, size, places where records begin)."""

    files: list[tuple[str, int, list[int]]] = field(default_factory=list)


def _manifests(fs, root: str) -> list[str]:
    from pyarrow.fs import FileSelector

    return sorted(x.path for x in fs.get_file_info(FileSelector(root, allow_not_found=True)) if x.is_file and x.base_name.startswith(MANIFEST))


def _listed(fs, manifest: str) -> list:
    with fs.open_input_stream(manifest, compression=None) as f:
        return json.loads(f.read())


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADER_COLUMNS[:-1] and isinstance(f, EqualTo):
                self.wanted.append((column, (f.value,)))
            elif column in HEADER_COLUMNS[:-1] and isinstance(f, In):
                self.wanted.append((column, tuple(f.value)))
            elif column in HEADER_COLUMNS[:-1] and isinstance(f, IsNotNull):
                self.wanted.append((column, None))
            else:
                yield f

    def files(self, fs, root: str) -> list[tuple[str, int, list[int]]]:
        from pyarrow.fs import FileSelector

        if fs.get_file_info(root).is_file:
            return [(root, fs.get_file_info(root).size, [])]
        if manifests := _manifests(fs, root):
            return [(f"{root}/{name}", size, places) for m in manifests for name, size, places in _listed(fs, m)]
        return [(x.path, x.size, []) for x in fs.get_file_info(FileSelector(root, recursive=True)) if x.is_file and x.path.endswith((".warc", ".warc.gz"))]

    def partitions(self) -> list[Ranges]:
        fs, root = file_system(self.path)
        plan, room = [], 0
        for name, size, places in self.files(fs, root):
            ends = [0, *places, size]
            for start, end in zip(ends, ends[1:]):
                if end - start > room:
                    plan.append(Ranges())
                    room = SPLIT_BYTES
                plan[-1].parts.append((name, start, end))
                room -= end - start
        return plan or [Ranges()]

    def _ask(self, fields: dict) -> bool | None:
        if not all(fields[c] is not None if values is None else fields[c] in values for c, values in self.wanted):
            return None
        return self.payload and fields["record_type"] != "revisit"

    def read(self, partition: Ranges):
        fs, _ = file_system(self.path)
        for name, start, end in partition.parts:
            with fs.open_input_file(name) as f:
                for got, block in walk(f, start, end, self._ask):
                    payload = None if block is None else payload_of(got, block)
                    if payload is not None and got["payload_bytes"] is None:
                        got["payload_bytes"] = len(payload)
                    yield (*(got[c] for c in HEADER_COLUMNS), payload)


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, date: str, overwrite: bool = False):
        self.path, self.date, self.overwrite = path, date, overwrite

    def write(self, rows) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        done, out, seen, me = [], None, set(), uuid.uuid4().hex
        for number, row in enumerate(rows):
            if out is None:
                name, size, places = f"{uuid.uuid4().hex}.warc.gz", 0, []
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            row = row.asDict()
            key = (row["page_id"], row["payload_digest"])
            again = f"{me}/{number}" if row["record_type"] != "response" or key in seen else ""
            seen.add(key)
            member = member_of(record_of(row, self.date, again))
            if size - (places[-1] if places else 0) >= SPLIT_BYTES:
                places.append(size)
            out.write(member)
            size += len(member)
            if size >= ROLL_BYTES:
                out.close()
                done.append((name, size, places))
                out, seen = None, set()
        if out is not None:
            out.close()
            done.append((name, size, places))
        return Written(done)

    def commit(self, messages) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        old = _manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())
        for manifest in old:
            gone = _listed(fs, manifest)
            fs.delete_file(manifest)
            for name, *_ in gone:
                fs.delete_file(f"{root}/{name}")

    def abort(self, messages) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            for name, *_ in m.files if m else []:
                fs.delete_file(f"{root}/{name}")


def register(spark: SparkSession) -> None:
    C.ship_by_value(__name__)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 100) -> DataFrame:
    """The archive's rows: every payload of at least ``min_bytes`` is stored once, by the smallest id.

    Only (id, digest) pairs are compared; those that become revisits are joined back by id and digest,
    by broadcast if they are counted to be few, so that payloads are not shuffled for them.
    """
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    slim = rows.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest")
    first = slim.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = slim.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    later = later.select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), F.col("first").alias("refers_to"))
    out = rows.join(C.bounded(C.stage(later, "revisits")), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest")), "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return out.select(kind.alias("record_type"), "page_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))


def write_archive(rows: DataFrame, path: str, overwrite: bool = False, date: str | None = None) -> None:
    register(rows.sparkSession)
    writer = rows.write.format("warc").mode("overwrite" if overwrite else "append")
    (writer.option("date", date) if date else writer).save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Writes pages as an archive in the shared folder and reads it back: what responses return is
    measured and hashed anew from the payload read; revisits are read from their headers."""
    path = C.fresh_path(spark, "warc")
    write_archive(records(C.table(spark, sf_dir, "pages")), path)
    back = read_archive(spark, path)
    whole = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
