"""Operator 8: WARC archives, one whole-file gzip stream each, rewritten record by record.

Foreign archives often come as a single gzip stream, from which no record can be read
without inflating all before it.  The normaliser inflates such a stream once, in bounded
pieces, writes every record as a gzip member of its own, and leaves a sidecar index of
the members' offsets.  A reader then opens any record by seeking.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, field_ddl, shared_dir

PIECE = 1 << 18
#: Payloads from this size on are stored once; later ones refer back.
LEAST_REVISIT = 1000
#: Repeated payloads up to this many (some 20 MB) are sent to every task; more are joined by shuffle.
FEW_TWINS = 200_000


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share."""
    if folder.startswith("file:") or "://" not in folder:
        path = "/" + folder.removeprefix("file:").lstrip("/")
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(folder)


def _publish(store: pafs.FileSystem, made: str, name: str) -> None:
    """Give a finished file its name; a task that runs again replaces it with the same bytes."""
    store.move(made, name)


def record(kind: str, page: str, url: str | None, payload: bytes, digest: str, refers: str | None, date: str = "1970-01-01T00:00:00Z", mark: str = "") -> bytes:
    """One WARC/1.1 record; ``mark`` makes its id one of its own where pages repeat.

    A revisit has no block, so its payload's length is kept in a header of our own, as are the pages' ids.
    """
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{mark}/{page}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {page}",
        f"X-Payload-Length: {len(payload)}",
        *([f"X-Refers-To-Page: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers is not None else []),
        *(["Content-Type: text/html; charset=utf-8"] if body else []),
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    return {name: value.strip() for name, _, value in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


class _Inflated:
    """Bytes of a gzip file (any number of members), inflated as they are asked for."""

    def __init__(self, raw: BinaryIO) -> None:
        self.raw, self.rest, self.have = raw, b"", bytearray()
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.rest or self.raw.read(PIECE)
        if not data:
            return False
        self.have += self.inflate.decompress(data, PIECE)
        self.rest = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.rest = self.inflate.unused_data
            self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (at := self.have.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.have)
            if not self._more():
                if self.have.strip():
                    raise ValueError("the archive ends inside a record's head")
                return None
        out = bytes(self.have[: at + len(mark)])
        del self.have[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record's block")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def records(raw: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and whole bytes of each record of an archive, inflated once from start to end."""
    stream = _Inflated(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = parse_head(head[:-4])
        yield fields, head + stream.take(int(fields["Content-Length"]) + 4)


def normalise(raw: BinaryIO, out: BinaryIO, level: int = 1) -> Iterator[dict]:
    """Rewrite an archive with one gzip member a record; yields an index entry for each."""
    offset = 0
    for fields, whole in records(raw):
        member = zlib.compressobj(level, zlib.DEFLATED, 31)
        data = member.compress(whole) + member.flush()
        out.write(data)
        yield {"record": fields["WARC-Record-ID"], "type": fields["WARC-Type"], "offset": offset, "length": len(data)}
        offset += len(data)


def read_member(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record from its own gzip member."""
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = parse_head(head)
    return fields, rest[: int(fields["Content-Length"])]


def with_targets(pages: DataFrame, key: str, body: str, least: int) -> DataFrame:
    """Add ``digest`` (SHA-1 of the UTF-8 payload), ``length`` and ``refers``: the largest key of an equal payload, if another's."""
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    hashed = pages.withColumn("length", F.octet_length(payload).cast("long")).withColumn("digest", F.sha1(payload))
    twins = hashed.where(F.col("length") >= least).groupBy("digest", "length").agg(F.max(key).alias("largest"), F.count("*").alias("copies")).where("copies > 1")
    twins = checkpoint(twins)
    if twins.count() <= FEW_TWINS:
        joined = hashed.join(F.broadcast(twins.select("digest", "length", "largest")), ["digest", "length"], "left")
        return joined.withColumn("refers", F.when(F.col("largest") > F.col(key), F.col("largest"))).drop("largest")
    # at most a thousand payloads can each hold over a thousandth of all rows: these go to every task, the rest by shuffle
    hot = max(hashed.count() // 1000, 50)
    hashed = hashed.join(F.broadcast(twins.where(F.col("copies") > hot).select("digest", "length", F.col("largest").alias("_hot"))), ["digest", "length"], "left")
    rest = twins.where(F.col("copies") <= hot).select(F.col("digest").alias("_digest"), F.col("length").alias("_length"), F.col("largest").alias("_cold"))
    probe = F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64(F.col(key).cast("string")).cast("string")))
    joined = hashed.withColumn("_probe", probe).join(rest, (F.col("_probe") == F.col("_digest")) & (F.col("length") == F.col("_length")), "left")
    largest = F.coalesce("_hot", "_cold")
    return joined.withColumn("refers", F.when(largest > F.col(key), largest)).drop("_hot", "_cold", "_digest", "_length", "_probe")


def write_archives(pages: DataFrame, folder: str, key: str, body: str, url: str, per_archive: int) -> DataFrame:
    """Write ``pages`` (see ``with_targets``) into monolithic archives; returns a row for each archive."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        import pyarrow as pa

        store, top = _store(folder)
        store.create_dir(top)
        name, raw, pack, n = None, None, None, 0

        def close():
            raw.write(pack.flush())
            raw.close()
            _publish(store, f"{top}/{name}.part", f"{top}/{name}.warc.gz")
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64())})

        for b in batches:
            for page, html, where, digest, refers in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if name is None:
                    name, n = uuid.uuid4().hex, 0
                    raw, pack = store.open_output_stream(f"{top}/{name}.part"), zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record("revisit" if refers is not None else "response", "" if page is None else str(page), where, (html or "").encode(), digest, None if refers is None else str(refers), date, f"{name}/{n}")
                raw.write(pack.compress(data))
                n += 1
                if n >= per_archive:
                    yield close()
                    name = None
        if name is not None:
            yield close()

    return pages.select(key, body, url, "digest", "refers").mapInArrow(run, "archive string, records bigint")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive of the list: ``<archive>.members.warc.gz`` beside it and ``<archive>.index.jsonl``."""

    def run(batches):
        import pyarrow as pa

        store, top = _store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                mark = uuid.uuid4().hex
                made, index = f"{top}/{name}.{mark}.members", f"{top}/{name}.{mark}.index"
                n = 0
                with store.open_input_stream(f"{top}/{name}.warc.gz", compression=None) as raw, store.open_output_stream(made, compression=None) as out, store.open_output_stream(index, compression=None) as side:
                    for entry in normalise(raw, out):
                        side.write(json.dumps(entry | {"archive": name}).encode() + b"\n")
                        n += 1
                _publish(store, made, f"{top}/{name}.members.warc.gz")
                _publish(store, index, f"{top}/{name}.index.jsonl")
                yield pa.RecordBatch.from_pydict({"archive": [name], "members": pa.array([n], pa.int64())})

    return archives.select("archive").mapInArrow(run, "archive string, members bigint")


def read_records(index: DataFrame, folder: str, key_type: str) -> DataFrame:
    """Open each record of an index at its offset: key, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length are taken from its block, and must agree with its headers.
    """

    def run(batches):
        import pyarrow as pa

        store, top = _store(folder)
        name, opened = None, None
        for b in batches:
            rows = []
            for archive, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if archive != name:
                    if opened:
                        opened.close()
                    name, opened = archive, store.open_input_file(f"{top}/{archive}.members.warc.gz")
                fields, block = read_member(opened.read_at(length, offset))
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                if fields["WARC-Type"] == "response" and (hashlib.sha1(block).hexdigest(), len(block)) != (digest, size):
                    raise ValueError(f"record {fields['WARC-Record-ID']} of {archive} is damaged")
                rows.append((fields.get("X-Page-ID", ""), size, digest, fields["WARC-Type"], fields.get("X-Refers-To-Page")))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_pydict({"page": pa.array(columns[0], pa.string()), "payload_bytes": pa.array(columns[1], pa.int64()), "payload_digest": pa.array(columns[2], pa.string()), "record_type": pa.array(columns[3], pa.string()), "refers": pa.array(columns[4], pa.string())})
        if opened:
            opened.close()

    got = index.select("archive", "offset", "length").mapInArrow(run, "page string, payload_bytes bigint, payload_digest string, record_type string, refers string")
    return got.select(F.when(F.col("page") != "", F.col("page")).cast(key_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(key_type).alias("refers_to"))


def round_trip(pages: DataFrame, key: str = "page_id", body: str = "html", url: str = "url", least: int = LEAST_REVISIT, per_archive: int = 2000, folder: str | None = None) -> DataFrame:
    """Write monolithic archives of ``pages``, normalise them, and read every record back through the index.

    Of equal payloads of at least ``least`` bytes the one with the largest key is the response, and the
    others revisit it; shorter ones, null and empty ones are all responses.  Rows that repeat with one key
    are each written; an empty table gives no rows; null keys come back null.  The files stay in ``folder``
    (a new one under the shared folder by default): ``*.warc.gz``, ``*.members.warc.gz``, ``*.index.jsonl``.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = write_archives(with_targets(pages.select(key, body, url), key, body, least), folder, key, body, url, per_archive)
    # the list of archives is written down: later steps must see the names of this run, whichever tasks run again
    written.write.parquet(f"{folder}/_written")
    archives = spark.read.parquet(f"{folder}/_written")
    # a few names are small data whatever the archives hold: only a number of partitions keeps them from being merged into one task
    tasks = max(1, min(archives.count(), max(200, 4 * spark.sparkContext.defaultParallelism)))
    normalised = normalise_archives(archives.repartition(tasks, "archive"), folder)
    normalised.write.parquet(f"{folder}/_normalised")
    listed = spark.read.parquet(f"{folder}/_normalised").where("members > 0")
    if listed.limit(1).count() == 0:
        return read_records(spark.createDataFrame([], "archive string, offset bigint, length bigint"), folder, field_ddl(pages, key))
    index = spark.read.schema("record string, type string, offset bigint, length bigint, archive string").json(f"{folder}/*.index.jsonl")
    index = index.join(F.broadcast(listed.select("archive")), "archive", "left_semi")  # as many rows as archives
    return read_records(index, folder, field_ddl(pages, key))
