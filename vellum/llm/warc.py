"""WARC: Zstandard archives with a leading dictionary frame, written and read back.

An archive is a skippable frame (magic 0x184D2A5D) holding the dictionary, then one Zstandard frame
per WARC record. Archives are kept as rows (archive, content) of a Parquet table in the shared
folder, each of about `archive_bytes` at most before compression, so any executor can write or read
them and a lost task is simply run again; `read_archives` also takes Spark's binaryFile rows (one row
holds one archive there, so archives of more than two gigabytes must be split at frames first).

Reading loads the dictionary from the leading frame, decodes one frame per record and validates the
WARC version line, the needed headers, Content-Length against the block, and the payload digest.

Of records with equal payloads of at least `least` bytes that with the largest id is a response
and the others are revisits of it: equality is decided by a grouped aggregate over digests (partial
sums before the shuffle) and only digests that repeat are joined back.

Defined results: a null html is an empty payload; a null url is an empty target; a null page_id is
kept as null (and never referred to unless all of a group are null); an empty table gives no rows;
repeated ids with equal payloads: all of the largest id are responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._rt import ready, release, store

MAGIC = 0x184D2A5D
SALT = 32
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


class WarcError(ValueError):
    """A frame or record that breaks the format."""


def train_dictionary(pages: DataFrame, column: str = "html", rows: int = 400, size: int = 32768, most: int = 65536) -> bytes:
    """A dictionary from at most `rows` payloads (those with the smallest hashes of their ids), `most` bytes of each; it has a fixed bound."""
    ids = pages.where(F.col("page_id").isNotNull() & (F.length(column) > 0)).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(rows)
    part = pages.join(F.broadcast(ids), "page_id").select("page_id", F.substring(F.col(column).cast("binary"), 1, most).alias("x"))
    part = part.orderBy(F.xxhash64("page_id"), "page_id", "x").limit(rows)  # rows may repeat an id
    samples = sorted(bytes(r["x"]) for r in part.collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples for training: plain content is a dictionary too
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"


def dictionary_frame(raw: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(raw)) + raw


def split_dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive and where its records begin; the dictionary may itself be compressed."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != MAGIC:
        return None, 0
    n = struct.unpack_from("<I", data, 4)[0]
    if 8 + n > len(data):
        raise WarcError("the dictionary frame is cut off")
    raw = data[8 : 8 + n]
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
    return zstandard.ZstdCompressionDict(raw), 8 + n


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Validate one record; raises WarcError."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC version line")
    h = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if not colon:
            raise WarcError(f"a header without a colon: {x[:80]}")
        h[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in h:
            raise WarcError(f"{name} is missing")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("Content-Length differs from the block")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = h["warc-type"] == "revisit"
    if revisit:
        if payload or "warc-refers-to" not in h:
            raise WarcError("a revisit with a payload or without a target")
    elif length != len(payload) or hashlib.sha1(payload).hexdigest() != digest:
        raise WarcError("the payload differs from its length or digest")
    key = lambda x: (lambda v: int(v) if v else None)(h[x].removeprefix("<urn:page:").removesuffix(">"))
    return {"page_id": key("warc-record-id"), "payload_bytes": length, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": key("warc-refers-to") if revisit else None, "url": h.get("warc-target-uri", "")}


def records(content: bytes, step: int = 1 << 14):
    """Every record of an archive, one frame at a time; what is read beyond a frame's end is at most `step` bytes, so time grows with the archive's size."""
    dictionary, at = split_dictionary(content)
    inflate = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        d, parts = inflate.decompressobj(), []
        while not d.eof:
            if at >= len(content):
                raise WarcError("a frame is cut off")
            parts.append(d.decompress(view[at : at + step]))
            at = min(at + step, len(content)) - len(d.unused_data)
        yield b"".join(parts)


def decide(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages with payload, digest, refers_to and revisit, by native aggregates and joins."""
    body = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    again = body.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    # a third of all pages may be copies of one: such rows are dealt over SALT keys, and the few narrow rows of the other side are repeated
    body = body.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)))
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    revisit = (F.length("payload") >= least) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return body.join(again, ["digest", "salt"], "left").withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("keeper"))).select("page_id", "url", "payload", "digest", "refers_to", "revisit")


def write_archives(decided: DataFrame, dictionary: bytes, archive_bytes: int = 8 << 20, level: int = 3) -> DataFrame:
    """(archive, n_records, content): archives of whole records, each starting with the dictionary."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        head = dictionary_frame(dictionary)
        parts, size = [], 0
        for b in batches:
            for p, u, x, d, r, v in zip(*(b.column(i).to_pylist() for i in range(6))):
                data = record(p, u, x, d, r, v)
                if parts and size + len(data) > archive_bytes:
                    yield pa.record_batch([pa.array([len(parts)], pa.int64()), pa.array([head + b"".join(parts)], pa.large_binary())], ["n_records", "content"])
                    parts, size = [], 0
                parts.append(squeeze.compress(data))
                size += len(data)
        if parts:
            yield pa.record_batch([pa.array([len(parts)], pa.int64()), pa.array([head + b"".join(parts)], pa.large_binary())], ["n_records", "content"])
        parts = None
        release()

    return decided.mapInArrow(run, "n_records long, content binary")


def read_archives(archives: DataFrame, content: str | Column = "content") -> DataFrame:
    """The records of a table of archives (or of Spark's binaryFile rows), validated."""

    def run(batches):
        for b in batches:
            for x in (v.as_py() for v in b.column(0)):  # one archive at a time
                rows = []
                for data in records(x):
                    rows.append(parse(data))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
        b = x = rows = None
        release()

    return archives.select(content).mapInArrow(run, RECORD)


ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write every page as a record, then read all archives back."""
    ready(pages.sparkSession)
    archives = store(write_archives(decide(pages, least), train_dictionary(pages)), "warc")
    return read_archives(archives)
