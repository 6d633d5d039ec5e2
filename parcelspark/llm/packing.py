"""Packing along a space-filling curve.

Each text becomes a vector of hashed byte triples, which a fixed sign matrix projects to three dimensions. The
Hilbert index of the projected point orders documents so that neighbours have like contents; documents are
range-sorted by it and packed in that order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, hilbert_index, partitions, runs, sliced
from .encoding import encoder

WIDTH, DIMS, BITS = 256, 3, 10
#: Pieces, and bytes of their ids, that a task holds before it hands them on.
MOST_ROWS, MOST_BYTES = 20_000, 4 << 20


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert index of each text's projected hash vector; 0 for texts under three bytes."""
    signs = np.random.default_rng(7).choice([-1.0, 1.0], (WIDTH, DIMS))
    points = np.zeros((len(texts), DIMS))
    for i, t in enumerate(texts):
        if len(t) > 2:
            b = np.frombuffer(t, np.uint8).astype(np.uint32)
            h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
            v = np.bincount((h >> np.uint32(24)).astype(np.uint8), minlength=WIDTH).astype(float)
            points[i] = v @ signs / np.sqrt(v @ v)
    cells = np.clip((np.tanh(points / 2) + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_index(cells, BITS)


def with_curve_key(docs: DataFrame) -> DataFrame:
    """(doc_id, text, curve): the text empty for null, curve its place on the Hilbert curve."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(curve_keys(bytes_of(b["text"])), pa.int64())], ["doc_id", "text", "curve"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(keys, "doc_id long, text string, curve long")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, keeps_space: bool = False, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most `size` tokens, gapless and without padding.

    Documents are range-sorted by (curve, hash of doc_id, text), so a group of like or equal texts of any size
    spreads over tasks. Each task fills its sequences to `size`, cutting documents freely; the rest of its last
    one is cut into sequences whose lengths are powers of two, which need no padding. A sequence id is the task's
    partition number times 2**40 plus a count: it depends on the sorted order alone, so a task that runs again
    after an executor is lost gives the same rows.

    A null or empty text has the end id only. Rows that repeat a doc_id are packed each. Null doc_ids stay null.
    with_ids adds the ids of each piece (binary, little-endian unsigned 32-bit).
    """
    schema = PIECES + (", ids binary" if with_ids else "")
    end = np.asarray([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer, keeps_space), TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64()] * 7 + [pa.binary()] * with_ids
        open_rows: list[list] = []  # of the sequence that is being filled
        open_ids: list[bytes] = []
        filled = count = held = 0
        rows: list[list] = []

        def out():
            nonlocal rows, held
            r, rows, held = rows, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*r), types)], names)

        def close() -> None:
            nonlocal open_rows, open_ids, filled, count, held
            rows.extend(open_rows)
            held += 4 * filled
            open_rows, open_ids, filled, count = [], [], 0, count + 1

        def add(doc_id, start: int, ids: bytes, total: int) -> None:
            nonlocal filled
            row = [doc_id, start, len(ids) // 4, zlib.crc32(ids), total, base + count, filled]
            open_rows.append(row + [ids] if with_ids else row)
            open_ids.append(ids)
            filled += len(ids) // 4

        for b in batches:
            texts, doc_ids = b["text"], b["doc_id"].to_pylist()
            for lo, hi in runs(texts):
                for doc_id, ids in zip(doc_ids[lo:hi], enc.encode(texts.slice(lo, hi - lo))):
                    ids += end
                    total, at = len(ids) // 4, 0
                    while at < total:
                        take = min(size - filled, total - at)
                        add(doc_id, at, ids[4 * at : 4 * (at + take)], total)
                        at += take
                        if filled == size:
                            close()
                    if len(rows) > MOST_ROWS or with_ids and held > MOST_BYTES:
                        yield out()
        # the rest: binary digits of its length, largest first
        rest, rest_ids, left = open_rows, open_ids, filled
        open_rows, open_ids, filled = [], [], 0
        want = 1 << (left.bit_length() - 1) if left else 0
        for row, ids in zip(rest, rest_ids):
            at, n = 0, len(ids) // 4
            while at < n:
                take = min(want - filled, n - at)
                add(row[0], row[1] + at, ids[4 * at : 4 * (at + take)], row[4])
                at += take
                if filled == want:
                    left -= want
                    close()
                    want = 1 << (left.bit_length() - 1) if left else 0
        if rows:
            yield out()

    keyed = with_curve_key(docs).withColumn("tie", F.xxhash64("doc_id"))
    dealt = keyed.repartitionByRange(partitions(docs.sparkSession), "curve", "tie", "doc_id").sortWithinPartitions("curve", "tie", "doc_id", "text")
    return dealt.select("doc_id", "text").mapInArrow(packed, schema)


def op5_curve_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
