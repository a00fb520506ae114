"""WARC archives compressed record by record with a Zstandard dictionary that each archive carries."""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import delete, discard, shared_dir, small_batches, written

#: The skippable-frame magic number of dictionary-compressed WARC files, and of a Zstandard dictionary.
SKIPPABLE = 0x184D2A5D
DICTIONARY = b"\x37\xa4\x30\xec"
MANIFEST = "file string, records long, raw_bytes long, file_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(samples: list[bytes], size: int = 65_536) -> bytes:
    """A dictionary built from archived records; plain content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _uri(page_id: int | None, digest: str) -> str:
    """The record id of a page's response, which its revisits name: one for each page id and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit carries headers only; the payload is at the record that it refers to.

    A revisit's record id is drawn, a response's follows from page id and payload, so full repeats of a page share theirs.
    """
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head if revisit else head + payload
    target = "".join(c for c in (url or "") if c >= " " and c != "\x7f")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {f'<urn:uuid:{uuid.uuid4()}>' if revisit else _uri(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z", *([f"WARC-Target-URI: {target}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to, digest)}"]
        lines += [f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; the digest of a response is computed anew and held against its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    said = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    if not revisit and (payload_digest(payload) != digest or len(payload) != said):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None, "payload_digest": digest, "payload_bytes": said,
        "payload": None if revisit else payload,
    }


class ArchiveWriter:
    """Writes one archive: the dictionary in a leading skippable frame, then a frame for each record."""

    def __init__(self, folder: str, dictionary: bytes, level: int = 3):
        self.fs, root = open_store(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(f"{root}/{self.name}", compression=None)
        frame = zstandard.ZstdCompressor(level=level).compress(dictionary)
        self.out.write(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
        kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
        self.press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind), write_checksum=True)
        self.records, self.raw, self.size = 0, 0, 8 + len(frame)

    def add(self, record: bytes) -> None:
        frame = self.press.compress(record)
        self.out.write(frame)
        self.records, self.raw, self.size = self.records + 1, self.raw + len(record), self.size + len(frame)

    def close(self) -> tuple:
        self.out.close()
        return self.name, self.records, self.raw, self.size


def read_archive(path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The raw records of an archive, one at a time; memory is bounded by a chunk and the largest record."""
    fs, root = open_store(path)
    with fs.open_input_stream(root, compression=None) as src:
        magic, size = struct.unpack("<II", src.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} does not begin with a dictionary frame")
        dictionary = zstandard.ZstdDecompressor().decompress(src.read(size))
        kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind))
        frame, parts, data = opener.decompressobj(), [], src.read(chunk)
        while data:
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
            if frame.eof:
                yield b"".join(parts)
                frame, parts = opener.decompressobj(), []
            data = data or src.read(chunk)
        if any(parts):
            raise ValueError(f"{path} ends inside a record")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, roll_bytes: int = 256 << 20, dictionary_records: int = 400, dictionary_bytes: int = 65_536) -> DataFrame:
    """Write a record per page into archives under ``folder``; returns the manifest of the archives.

    Of pages with equal payloads of at least ``min_revisit_bytes`` the one with the largest id is a
    response and the others revisit it; smaller payloads are all responses. A null payload is empty. Null ids lose
    to any id and rows that repeat the largest id are further responses. The dictionary is trained on
    the ``dictionary_records`` records of the smallest hash among those of at most 64 KiB (a fixed sample, so its cost does not grow);
    every record is compressed with it. Each task streams its records into files of its own, rolled at
    ``roll_bytes``, under fresh names; only files of tasks that ended well are in the manifest, so a lost
    or repeated task leaves no record twice. Columns other than id, address and text are not archived, so their names do not
    matter. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("key", F.sha2("payload", 256))
    keepers = written(keyed.groupBy("key").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-keepers")
    marked = keyed.join(keepers, "key", "left").drop("key")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.octet_length("payload") >= min_revisit_bytes)
    marked = marked.withColumn("revisit", F.coalesce(revisits, F.lit(False)))
    order = F.xxhash64("page_id", F.md5("payload"))
    fit = rows.where(F.octet_length("payload") <= 65_536)
    picked = [r[0] for r in fit.select(order.alias("o")).distinct().orderBy("o").limit(dictionary_records).collect()]
    # Full repeats of a record teach nothing new: a row each, whatever their number.
    sample = fit.where(order.isin(picked)).dropDuplicates(["page_id", "payload"]).orderBy("page_id", "payload").collect() if picked else []
    records = [record_bytes(r.page_id, r.url, bytes(r.payload), payload_digest(bytes(r.payload)), False, None) for r in sample]
    dictionary = spark.sparkContext.broadcast(train_dictionary(records, dictionary_bytes))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, done = None, []
        for batch in batches:
            for page_id, url, payload, first_id, revisit in zip(batch["page_id"], batch["url"], batch["payload"], batch["first_id"], batch["revisit"], strict=True):
                if out is None:
                    out = ArchiveWriter(folder, dictionary.value)
                payload = bytes(payload)
                out.add(record_bytes(None if pd.isna(page_id) else int(page_id), None if url is None or url is pd.NA else url, payload, payload_digest(payload), bool(revisit), None if pd.isna(first_id) else int(first_id)))
                if out.size >= roll_bytes:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        yield pd.DataFrame(done, columns=["file", "records", "raw_bytes", "file_bytes"])

    slim = marked.select(F.col("page_id").cast("decimal(20,0)").alias("page_id"), "url", "payload", F.col("first_id").cast("decimal(20,0)").alias("first_id"), "revisit")
    return written(slim.mapInPandas(archive, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that ``manifest`` lists, a task per archive; responses are verified."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                held, size = [], 0
                for raw in read_archive(f"{folder}/{name}"):
                    x = parse_record(raw)
                    size += len(raw)
                    held.append(x if payloads else x | {"payload": None})
                    if size >= 8 << 20 or len(held) >= 4096:
                        yield frame(held)
                        held, size = [], 0
                yield frame(held)

    def frame(held: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(held, columns=[c.split()[0] for c in RECORDS.split(", ")])
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    files = max(1, manifest.count())
    return manifest.select("file").repartition(min(files, 100_000)).mapInPandas(records, RECORDS)


def verified_revisits(records: DataFrame) -> DataFrame:
    """``records`` (a written table) once every revisit is known to name a response of the same payload digest; else an error."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    on = F.col("r.refers_to").eqNullSafe(F.col("s.refers_to")) & (F.col("r.payload_digest") == F.col("s.payload_digest"))
    lost = records.where("record_type = 'revisit'").alias("r").join(responses.alias("s"), on, "left_anti")
    if not lost.isEmpty():
        raise ValueError("a revisit names a response that is not in the archives")
    return records


def round_trip(spark: SparkSession, pages: DataFrame, payloads: bool = False, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and verify every record; the archives are then deleted."""
    folder = os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    manifest = write_warc(pages, folder, **options)
    records = verified_revisits(written(read_warc(manifest, folder, payloads), "warc-records"))
    discard(manifest)
    delete(spark, folder)
    return records
