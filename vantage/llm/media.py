"""Media columns: texts as 8-bit mono samples in Ogg, beside a stream of marks, and the way back."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm import ogg
from vantage.llm.arrays import slices, texts

RATE = 8000
SAMPLES, MARKS = 1, 2  # serials of the two logical streams
PACKET = 4000  # samples a packet: half a second
BLOCK = 64
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(raw: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


def encode(raw: bytes) -> bytes:
    """An Ogg file: a stream of unsigned 8-bit samples, one a byte, and one of marks that give the unpadded length."""
    payload = pad(raw)
    head = struct.pack("<8sIIQ", b"u8pcm\0\0\0", RATE, PACKET, len(payload))
    samples = [(head, 0)] + [(payload[at : at + PACKET], min(at + PACKET, len(payload))) for at in range(0, len(payload), PACKET)]
    marks = [(b"marks\0\0\0", 0), (struct.pack("<Q", len(raw)), len(payload))]
    return ogg.multiplex([ogg.pages(SAMPLES, samples), ogg.pages(MARKS, marks)])


def decode(media: bytes) -> tuple[bytes, int, list[float]]:
    """The payload, its unpadded length, and the seconds at which the pages of samples end."""
    streams = ogg.read_packets(media)
    samples, at = streams[SAMPLES]
    magic, rate, _, total = struct.unpack("<8sIIQ", samples[0])
    payload = b"".join(samples[1:])
    ends = np.cumsum([0, *map(len, samples[1:])])
    if magic != b"u8pcm\0\0\0" or len(payload) != total or any(g != ends[n - 1] for g, n in at):
        raise ValueError("granule positions don't agree with the samples")
    return payload, struct.unpack("<Q", streams[MARKS][0][1])[0], [g / rate for g, _ in at]


def feature(payload: bytes, times: list[float]) -> str:
    """Duration, pages, mean, root mean square about 128 and sign changes of the samples."""
    x = np.frombuffer(payload, np.uint8)
    centred = x.astype(np.int16) - 128
    power = int(np.square(centred, dtype=np.int64).sum())
    sign = centred >= 0
    crossings = int(np.count_nonzero(sign[1:] != sign[:-1]))
    return f"seconds={times[-1]:.6f};pages={len(times)};mean={int(x.sum(dtype=np.int64)) / len(x):.6f};rms={(power / len(x)) ** 0.5:.6f};crossings={crossings}"


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text as an Ogg file. A null or empty text becomes 64 zero samples.

    Cases: a text of any length is stored whole, in memory of a few times its length; equal texts have equal files, repeated
    rows each; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """

    def store(batches):
        for batch in slices(batches, "text"):
            raw = texts(batch).cast(pa.large_binary()).to_pylist()
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "media": pa.array([encode(x) for x in raw], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, "doc_id long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read media columns back: every checksum is verified, the streams are separated, and features are computed.

    Cases: equal media give equal rows, repeated rows each; a damaged, empty or null file fails the task; files of any length are read whole; an empty table gives no rows;
    other columns are ignored.
    """

    def read(batches):
        for batch in slices(batches, "media"):
            rows = []
            for raw in batch.column("media").to_pylist():
                payload, n, times = decode(raw)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(payload, times)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", *names])

    return media.select("doc_id", "media").mapInArrow(read, FEATURES)
