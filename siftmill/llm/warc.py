"""WARC archives compressed with Zstandard dictionaries, written and read back.

Writing. Pages are dealt by hash over archives of about ``ARCHIVE_BYTES`` of payload, ordered by
digest within. The task that writes an archive trains a dictionary on its first records (of random
digests, ``SAMPLE_BYTES`` at most), puts it in a leading skippable frame (magic 0x184D2A5D) and then
compresses each record as a frame of its own, so that any record can be read by its offset. Each
archive is written, and read, by a task of its own (rows go to tasks by the archive's number, not by a
hash of it). A task writes under a name of its own and renames when the archive is whole; a repeated task replaces an
equal file. Memory is bounded by the sample and a record.

Of records with equal payloads (by SHA-1) of at least ``LEAST_BYTES``, that with the smallest page_id
is a response; the others are revisits that refer to it. The smallest page_id per digest is a partial
aggregate; only digests that occur twice or more are joined back.

Reading streams each archive and returns a row per record; digest and length of a response are taken
from its payload and must agree with its headers.

Defined cases. Null html: an empty payload. Null url: no target header. Null page_id: no page
header; such a row is a revisit if its payload's group has a page_id, else a response. Repeated rows
with the smallest page_id of their payload are responses all. An empty table: no archive, an empty
result. Very long pages: one record. Columns of the input other than page_id, url and html aren't
used, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.common import scratch_path, table, written

LEAST_BYTES = 0
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES, DICTIONARY_BYTES = 512 << 10, 32 << 10
LEVEL = 3
MOST_TASKS = 1 << 16
DATE = "2024-01-01T00:00:00Z"
SKIPPABLE = 0x184D2A5D
_NAMESPACE = uuid.UUID("6f1dd2a6-54c7-4b0e-9c53-6d0f3f0f8a11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """An uncompressed record; a revisit of ``refers_to`` unless that is None."""
    digest = digest32(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; of too few samples, their bytes themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """An archive that is being written; ``put`` takes uncompressed records, ``close`` renames it."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        self.fs, path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path)
        self.path, self.own = f"{path}/{name}", f"{path}/_{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own, compression=None)
        self.held: list[bytes] = []
        self.held_bytes = self.records = 0
        self.packer: zstandard.ZstdCompressor | None = None

    def put(self, whole: bytes) -> None:
        self.records += 1
        if self.packer:
            self.out.write(self.packer.compress(whole))
            return
        self.held.append(whole)
        self.held_bytes += len(whole)
        if self.held_bytes >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        learned = dictionary([x[:SAMPLE_BYTES] for x in self.held])
        content = learned.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned)
        for whole in self.held:
            self.out.write(self.packer.compress(whole))
        self.held = []

    def close(self) -> None:
        if not self.packer:
            self._start()
        self.out.close()
        self.fs.move(self.own, self.path)


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive, in order."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary")
    learned = zstandard.ZstdCompressionDict(source.read(size))
    with zstandard.ZstdDecompressor(dict_data=learned).stream_reader(source, read_size=1 << 17, read_across_frames=True) as stream:
        held = b""

        def upto(n: int) -> bytes:
            nonlocal held
            parts, have = [held], len(held)
            while have < n:
                part = stream.read(max(1 << 16, n - have))
                if not part:
                    raise ValueError("the archive ends within a record")
                parts.append(part)
                have += len(part)
            whole = b"".join(parts)
            held = whole[n:]
            return whole[:n]

        while True:
            if not held:
                held = stream.read(1 << 16)
                if not held:
                    return
            while (end := held.find(b"\r\n\r\n")) < 0:
                part = stream.read(1 << 16)
                if not part:
                    raise ValueError("the archive ends within a header")
                held += part
            lines = upto(end + 4)[:-4].decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            yield headers, upto(int(headers["Content-Length"]) + 4)[:-4]


def _file(number: int) -> str:
    return f"archive-{number:06d}.warc.zst"


def _dealt(rows: DataFrame, archives: int) -> DataFrame:
    """Rows by the number in their column ``archive``: a task for each archive up to ``MOST_TASKS``
    tasks, beyond that as many archives each."""
    tasks = min(archives, MOST_TASKS)
    return rows.repartitionById(tasks, (F.col("archive") % tasks).cast("int"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``: a row for each archive, its
    number, name, number of records and the task that wrote it. The archives exist when this returns."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    size = F.length("payload")
    first = known.filter(size >= LEAST_BYTES).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    first = written(first, "payloads")
    total = first.agg(F.sum("bytes")).first()[0] or 0
    archives = max(1, -(-total // ARCHIVE_BYTES))
    # Written, so that its size is known when the join is planned: pages are shuffled for it only
    # where it is large.
    twice = written(first.filter("n > 1 AND first IS NOT NULL").select(F.col("sha1").alias("same"), "first"), "repeated-payloads")
    told = known.join(twice, (F.col("sha1") == F.col("same")) & (size >= LEAST_BYTES), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    dealt = told.select("page_id", "url", "payload", "sha1", refers.alias("refers_to"), F.pmod(F.xxhash64("page_id", "sha1"), F.lit(archives)).cast("int").alias("archive"))
    dealt = _dealt(dealt, archives).sortWithinPartitions("archive", "sha1", "page_id", "url")

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out, task = None, None, TaskContext.get().partitionId()

        def closed() -> pd.DataFrame:
            out.close()
            return pd.DataFrame({"number": [now], "archive": [_file(now)], "records": [out.records], "task": [task]})

        for part in parts:
            whole = lambda v: None if pd.isna(v) else int(v)
            for row in part.itertuples(index=False):
                if row.archive != now:
                    if out:
                        yield closed()
                    now, out = row.archive, Archive(folder, _file(row.archive))
                out.put(record(whole(row.page), row.url, row.payload, whole(row.refers)))
        if out:
            yield closed()

    # Ids pass as text, so that nulls don't turn them into floats.
    as_text = dealt.select("archive", F.col("page_id").cast("string").alias("page"), "url", "payload", F.col("refers_to").cast("string").alias("refers"))
    return written(as_text.mapInPandas(put, "number int, archive string, records long, task int"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the archives that ``write_archives`` told of: page_id, url,
    payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers", "payload"]
        store, path = fs.FileSystem.from_uri(folder)
        for part in parts:
            for name in part["name"]:
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for head, block in records(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size, told = int(http.rsplit(b"Content-Length: ", 1)[1]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                        full = head["WARC-Type"] == "response"
                        if full and (len(payload) != size or digest32(payload) != told):
                            raise ValueError(f"{name}: payload and headers of {head['WARC-Record-ID']} differ")
                        rows.append((head.get("WARC-Page-ID"), head.get("WARC-Target-URI"), size, told, head["WARC-Type"], head.get("WARC-Refers-To-Page-ID"), payload if full else None))
                        held += len(block)
                        if held > 16 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    last = archives.agg(F.max("number")).first()[0]
    named = _dealt(archives.select(F.col("number").alias("archive"), F.col("archive").alias("name")), 1 + (last or 0))
    found = named.mapInPandas(read, "page string, url string, payload_bytes long, payload_digest string, record_type string, refers string, payload binary")
    return found.select(F.col("page").cast("long").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast("long").alias("refers_to"), "payload")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(archives, folder).drop("url", "payload")


QUERY = ("op8_warc", op8_warc)
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x0' || substr(hex || '00', (i * 5) // 4 + 1, 3))::BIGINT // (1 << (7 - (i * 5) % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first OR page_id IS NULL THEN first END AS refers_to
FROM f
"""
