"""Media columns: whole texts as lossless WebP images, stored in a table, read back and described.

Odd cases: a null text is empty; an empty one is one row of spaces; rows that share a doc_id
are rows of their own; a null doc_id is kept; an empty table gives no rows; extra columns are
ignored. A text of any length is a row of images of bounded size.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import webp
from codelode.llm.common import map_arrow, materialize

#: Bytes of media in a batch at most.
BATCH = 8 << 20


def padded(data: bytes, unit: int = webp.ROW_BYTES) -> bytes:
    return data + b" " * (-len(data) % unit if data else unit)


def feature(payload: bytes, grid: int = 8) -> str:
    """Which cells of a grid over the image are lighter than the mean cell, as hex; each cell by its mean sample."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, webp.ROW_BYTES)
    edges = np.linspace(0, len(image), grid + 1).astype(int)[:-1]
    columns = image.reshape(len(image), grid, -1).mean(axis=2)
    ends = np.append(edges[1:], len(image))
    cells = np.array([columns[a : max(b, a + 1)].mean(axis=0) for a, b in zip(edges, ends, strict=True)])
    return np.packbits(cells.ravel() > cells.mean()).tobytes().hex()


def _batches(rows, names, types):
    held, out = 0, []
    for size, row in rows:
        out.append(row)
        held += size
        if held >= BATCH or len(out) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
            held, out = 0, []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def _store(batches):
    def rows():
        for batch in batches:
            for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                media = webp.store(padded(data))
                yield len(media), (i.as_py(), len(data), media)

    yield from _batches(rows(), ["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()])


READ = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _read(batches):
    def rows():
        for batch in batches:
            for i, n, m in zip(batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), strict=True):
                media = m.as_py()
                payload = webp.load(media)
                yield 200, (i.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))

    yield from _batches(rows(), READ, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def store_texts(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """A written table (doc_id, n_bytes, media)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(map_arrow(rows, _store, "doc_id long, n_bytes long, media binary"), "media")


def describe(media: DataFrame) -> DataFrame:
    """Decode each image and compute its features."""
    return map_arrow(media, _read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
