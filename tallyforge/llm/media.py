"""Media columns (operator 6): content-addressed payloads in tar shards, with rows of digest, offset and length.

A payload is kept as a greyscale PNG of 64 samples of 8 bits a row, which is lossless.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import scratch, spill, text_of

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the header chunk with its length, name and check sum.
HEADER = 33
TAR_BLOCK = 512


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (WIDTH - len(data) % WIDTH if len(data) % WIDTH or not data else 0)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(name)))


def encode(payload: bytes, level: int = 6) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row is led by its filter, 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    size = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", size) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode(media: bytes) -> bytes:
    width, height, bits = read_header(media[:HEADER])
    data, at = [], len(SIGNATURE)
    while at < len(media):
        (length,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + length])
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if bits != 8 or rows[:, 0].any():
        raise ValueError("not as encode() writes it")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and how many differ."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / len(payload)
    values = np.arange(256)
    mean = float(share @ values)
    spread = float(share @ (values - mean) ** 2) ** 0.5
    some = share[share > 0]
    return f"mean={mean:.4f};std={spread:.4f};entropy={max(0.0, float(-(some * np.log2(some)).sum())):.4f};distinct={len(some)}"


def _tar_header(name: str, size: int) -> bytes:
    fields = [name.encode(), b"0000644", b"0000000", b"0000000", b"%011o" % size if size < 8**11 else b"\x80" + size.to_bytes(11, "big"), b"00000000000", b" " * 8, b"0", b"", b"ustar\x0000"]
    raw = b"".join(f.ljust(n, b"\0")[:n] for f, n in zip(fields, (100, 8, 8, 8, 12, 12, 8, 1, 100, 8), strict=True)).ljust(TAR_BLOCK, b"\0")
    return raw[:148] + b"%06o\0 " % sum(raw) + raw[156:]


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _write_shards(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Writes the task's payloads, each digest once, to a shard with a name of its own; gives a row per document."""
    files, base = _filesystem(root)
    shard = f"shard-{uuid.uuid4().hex}.tar"  # a retry writes another, and only rows of the task that counts name it
    out, at = None, 0
    known: dict[bytes, tuple[int, int]] = {}
    for batch in batches:
        found = []
        for text in batch.column("text").cast(pa.binary()):
            data = text.as_py()
            payload = padded(data)
            digest = sha256(payload).digest()
            if digest not in known:
                if out is None:
                    out = files.open_output_stream(f"{base}/{shard}")
                media = encode(payload)
                out.write(_tar_header(digest.hex() + ".png", len(media)))
                out.write(media + b"\0" * (-len(media) % TAR_BLOCK))
                known[digest] = (at + TAR_BLOCK, len(media))
                at += TAR_BLOCK + len(media) + -len(media) % TAR_BLOCK
            found.append((digest, len(data), shard, *known[digest]))
        columns = zip(*found, strict=True)
        types = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)] if found else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "digest", "n_bytes", "shard", "offset", "length"])
    if out is not None:
        out.write(b"\0" * 2 * TAR_BLOCK)
        out.close()


def _ranges(frame: pd.DataFrame, root: str, length: int | None) -> Iterator[bytes]:
    """The bytes of each row's range, or its first `length`; rows come by shard and offset, so that a file is opened once."""
    files, base = _filesystem(root)
    name, file = None, None
    for shard, offset, size in zip(frame["shard"], frame["offset"], frame["length"], strict=True):
        if shard != name:
            if file is not None:
                file.close()
            name, file = shard, files.open_input_file(f"{base}/{shard}")
        yield file.read_at(size if length is None else min(size, length), offset)
    if file is not None:
        file.close()


def _read_headers(frames: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    for frame in frames:
        heads = [read_header(h) for h in _ranges(frame, root, HEADER)]
        yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(heads, columns=["width", "height", "bits"])], axis=1)


def _read_payloads(frames: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for frame in frames:
        rows = []
        for media in _ranges(frame, root, None):
            payload = decode(media)
            rows.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), sha256(media).hexdigest(), feature(payload)))
        yield pd.concat([frame[["digest"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)


def store(docs: DataFrame, root: str) -> DataFrame:
    """Writes the payloads to tar shards under `root`, a folder all executors share; a row per document: doc_id, digest, n_bytes, shard, offset, length.

    A task stores each digest once. Of the places of a digest that several tasks have stored, unique() takes the first, so that all
    equal texts are read from one. A null text counts as empty, which is stored as 64 zero bytes; null and repeated ids give a row each; an
    empty table writes nothing; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id bigint, digest binary, n_bytes bigint, shard string, offset bigint, length bigint"
    return spill(rows.mapInArrow(partial(_write_shards, root=root), schema), "media-rows")


def unique(stored: DataFrame) -> DataFrame:
    """One row per digest with the place it is read from."""
    return stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def headers(stored: DataFrame, root: str) -> DataFrame:
    """width, height and bits of each digest, from reads of the first HEADER bytes of its range alone."""
    places = unique(stored).repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return places.mapInPandas(partial(_read_headers, root=root), "digest binary, shard string, offset bigint, length bigint, width bigint, height bigint, bits int")


def payloads(stored: DataFrame, root: str) -> DataFrame:
    """What is computed from each digest's bytes, read back from its shard."""
    places = unique(stored).repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return places.mapInPandas(partial(_read_payloads, root=root), "digest binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_columns(docs: DataFrame, root: str | None = None) -> DataFrame:
    """One row per document: its place and size, what its header says, and what the bytes read back give."""
    root = root or scratch(docs.sparkSession, "media")
    files, base = _filesystem(root)
    files.create_dir(base, recursive=True)
    stored = store(docs, root)
    facts = spill(payloads(stored, root).join(headers(stored, root).select("digest", "width", "height", "bits"), "digest"), "media-facts")  # a plain table, so that the join can split a hot digest
    return stored.join(facts, "digest")
