"""Documents dealt into chunks, and exact questions about all chunks by packed arrays.

A chunk is a bounded set of whole documents (about `chunk_bytes` of text). Each chunk sends
its distinct hashes, sorted into buckets, and each bucket answers every chunk about those it sent. A
hash that a third of all documents hold is thus one entry for each chunk, not for each document.
Texts travel compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import written

CHUNK_BYTES = 8 << 20
CHUNKS_TO_BUCKET = 4  # a bucket hears of about the text of so many chunks


def _compress(marks: Callable[[list[bytes]], list[list[bytes]]] | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            column = batch.column(2).cast(pa.binary())
            for at in range(0, len(column), 500):
                texts = [t.as_py() or b"" for t in column[at : at + 500]]
                more = [pa.array(m, pa.binary()) for m in (marks(texts) if marks else [])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 500], batch.column(1)[at : at + 500], pa.array(map(squeeze, texts), pa.binary()), *more], ["chunk", "doc_id", "z", *names])

    return run


def chunked(docs: DataFrame, chunk_bytes: int, marks: Callable[[list[bytes]], list[list[bytes]]] | None = None, names: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(chunk, doc_id, z and what `marks` makes of the texts) of docs (doc_id, text), z the text compressed, and the number of buckets.

    Rows are dealt out at random, so that no id, null or not, and no text makes a chunk large; the written table says which
    row is where, so a task that runs again finds the same.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    rows = docs.select(F.floor(F.rand(7) * chunks).cast("int").alias("chunk"), "doc_id", "text")
    more = "".join(f", {n} binary" for n in names)
    return written(rows.mapInArrow(_compress(marks, list(names)), f"chunk int, doc_id long, z binary{more}"), "chunked"), max(1, chunks // CHUNKS_TO_BUCKET)


def texts_of(table: pa.Table) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [open_(z) for z in table["z"].to_pylist()]


def bucketed(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """Buckets of sorted 64-bit keys: equal shares of their range."""
    bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    cut = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    return [(i, slice(a, b)) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]


def joined(blobs: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def member_of(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted array `among`."""
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys
