"""Token-id shards with a minimal perfect hash index.

A store is a Parquet table of blocks. Each block holds documents that follow one another in doc_id order:
  payload  raw ids, little-endian, 2 bytes each where the vocabulary allows it, else 4
  index    minimal perfect hash of the block's distinct keys: seeds of its buckets, then for each slot the
           stored fingerprint and the ordinal of the key's first document; then the documents' id offsets
  keys     the keys in order, for listing; keyed access doesn't read it
Blocks are rows, so Spark writes and reads them in any store, and a lost task is simply run again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, runs, shared_dir
from .encoding import encoder

#: Bytes of texts that are encoded together: the more, the fewer pieces are distinct in several slices. That saves more time
#: than remembering more pieces, and memory.
TOGETHER = 4_000_000
BLOCK = "part int, block int, first_key long, last_key long, n_docs int, n_null int, n_ids long, width int, payload binary, index binary, keys binary"
#: Stands for a null doc_id among keys; a block's first n_null documents are those with null.
NULL_KEY = -(2**63)


def _hashes(keys: np.ndarray, salt: int) -> np.ndarray:
    from .common import mixed

    return mixed(keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(xxhash.xxh3_64_intdigest(struct.pack("<q", salt))))


_GOLD, _ODD, _ALL = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 2**64 - 1


def _slot(h2: int, seed: int, n: int) -> int:
    return (((h2 ^ (seed * _GOLD & _ALL)) * _ODD & _ALL) >> 32) % n


def _place(h: np.ndarray, h2: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Each bucket's seed and each key's slot; None where two keys can't be told apart, for another salt."""
    n = len(h)
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable").tolist()
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    seeds, taken, slot_of, free = np.zeros(buckets, np.int32), bytearray(n), np.zeros(n, np.int64), 0
    h2s = h2.tolist()
    for b in np.argsort(-sizes, kind="stable").tolist():
        members = order[starts[b] : starts[b + 1]]
        if not members:
            break
        if len(members) == 1:  # its seed names the slot itself
            while taken[free]:
                free += 1
            taken[free], seeds[b], slot_of[members[0]] = 1, -free - 1, free
            continue
        for seed in range(50 * n + 1000):
            slots = [_slot(h2s[m], seed, n) for m in members]
            if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                break
        else:
            return None
        for m, s in zip(members, slots):
            taken[s], slot_of[m] = 1, s
        seeds[b] = seed
    return seeds, slot_of


def build_index(keys: np.ndarray, ordinals: np.ndarray, offsets: np.ndarray) -> bytes:
    """Hash-and-displace minimal perfect hash of distinct keys, with fingerprints, ordinals and id offsets."""
    n, buckets, salt = len(keys), len(keys) // 3 + 1, -1
    placed = None
    while placed is None:
        salt += 1
        h, h2 = _hashes(keys, salt), _hashes(keys, ~salt)
        placed = _place(h, h2, buckets)
    seeds, slot_of = placed
    prints, first = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    prints[slot_of] = (h2 >> np.uint64(32)).astype(np.uint32)
    first[slot_of] = ordinals
    return struct.pack("<IIII", n, buckets, salt, len(offsets)) + seeds.tobytes() + prints.tobytes() + first.tobytes() + offsets.astype("<u8").tobytes()


class Index:
    """Keyed access: a few array reads a key, whatever the size of the block."""

    def __init__(self, blob: bytes):
        n, buckets, self.salt, docs = struct.unpack_from("<IIII", blob)
        at = 16
        self.n, self.buckets = n, buckets
        self.seeds = np.frombuffer(blob, "<i4", buckets, at)
        self.prints = np.frombuffer(blob, "<u4", n, at := at + 4 * buckets)
        self.first = np.frombuffer(blob, "<u4", n, at := at + 4 * n)
        self.offsets = np.frombuffer(blob, "<u8", docs, at + 4 * n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The ordinal of each key's first document; -1 where the fingerprint shows that the key isn't here."""
        if not self.n:
            return np.full(len(keys), -1)
        h, h2 = _hashes(keys, self.salt), _hashes(keys, ~self.salt)
        seed = self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)].astype(np.int64)
        n = np.uint64(self.n)
        x = h2 ^ (np.where(seed < 0, 0, seed).astype(np.uint64) * np.uint64(_GOLD))
        placed = ((x * np.uint64(_ODD)) >> np.uint64(32)) % n
        slot = np.where(seed < 0, -seed - 1, placed.astype(np.int64))
        return np.where(self.prints[slot] == (h2 >> np.uint64(32)).astype(np.uint32), self.first[slot].astype(np.int64), -1)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, keeps_space: bool = True, block_ids: int = 1_000_000, id_bytes: int = 2) -> None:
    """Encodes every text (null: empty), appends end_id, and writes blocks in ascending doc_id order (nulls first).

    Rows that repeat a doc_id are all kept, in the order of their texts; the index leads to the first of them. An id that
    id_bytes can't hold raises.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, keeps_space), TaskContext.get().partitionId()
        end = np.asarray([end_id], "<u4").tobytes()
        keys: list[int] = []
        ids: list[bytes] = []
        lengths: list[int] = []
        number = held = nulls = 0

        def block() -> pa.RecordBatch:
            nonlocal keys, ids, lengths, number, held, nulls
            k = np.asarray(keys, np.int64)
            distinct, first = np.unique(k[nulls:], return_index=True)  # nulls come first, and are no keys of the index
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            payload = np.frombuffer(b"".join(ids), "<u4")
            if int(payload.max()) >= 1 << 8 * id_bytes:
                raise ValueError(f"an id of {int(payload.max())} doesn't fit {id_bytes} bytes")
            row = [part, number, keys[0], keys[-1], len(keys), nulls, int(offsets[-1]), id_bytes, payload.astype(f"<u{id_bytes}").tobytes(), build_index(distinct, first + nulls, offsets), k.astype("<i8").tobytes()]
            keys, ids, lengths, number, held, nulls = [], [], [], number + 1, 0, 0
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [x.split()[0] for x in BLOCK.split(", ")])

        for b in batches:
            texts, doc_ids = b["text"], b["doc_id"].to_pylist()
            for lo, hi in runs(texts, TOGETHER):
                for doc_id, x in zip(doc_ids[lo:hi], enc.encode(texts.slice(lo, hi - lo))):
                    keys.append(NULL_KEY if doc_id is None else doc_id)
                    nulls += doc_id is None
                    ids.append(x + end)
                    lengths.append(len(x) // 4 + 1)
                    held += lengths[-1]
                    if held >= block_ids:
                        yield block()
        if keys:
            yield block()

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = d.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(blocks, BLOCK).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Each document of a store: doc_id, start (ids before it in the whole store), n_tokens, ids_crc32, ids (uint32; without
    with_ids they are read for the checksum and stay in the worker)."""
    store = spark.read.parquet(path)
    sizes = store.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = sizes.select("part", "block", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("block_start"))
    starts = inside.join(before, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for b in batches:
            for row in b.to_pylist():
                ix, keys = Index(row["index"]), np.frombuffer(row["keys"], "<i8")
                nulls, at = row["n_null"], np.arange(len(keys))
                first = np.concatenate([at[:nulls], ix.find(keys[nulls:])])
                # rows that repeat a key follow its first
                new = np.concatenate([[True], keys[1:] != keys[:-1]]) | (at <= nulls)
                ordinal = first + at - np.maximum.accumulate(np.where(new, at, 0))
                payload = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")
                lo, hi = ix.offsets[ordinal].astype(np.int64), ix.offsets[ordinal + 1].astype(np.int64)
                ids = [payload[x:y].tobytes() if with_ids else payload[x:y] for x, y in zip(lo.tolist(), hi.tolist())]
                n = len(keys)
                cols = [[row["part"]] * n, [row["block"]] * n, [None] * row["n_null"] + keys[row["n_null"] :].tolist(), lo, hi - lo, [zlib.crc32(x) for x in ids]] + [ids] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    more = ["ids"] * with_ids
    schema = "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    found = store.select("part", "block", "n_null", "width", "payload", "index", "keys").mapInArrow(documents, schema)
    return found.join(starts, ["part", "block"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *more)


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """doc_id, ids (uint32) of given documents, the first of each key; keys that aren't there give no row.

    The key ranges of blocks tell which hold a wanted key: at most a few for each key. Only their rows are read, first the
    indexes, which give a document's place in a few array reads, then of their payloads the bytes of these documents.
    """
    store, wanted = spark.read.parquet(path), np.asarray(sorted({*keys}), np.int64)
    found_schema = "doc_id long, ids binary"
    if not len(wanted):
        return spark.createDataFrame([], found_schema)
    asked = F.array(*(F.lit(k) for k in wanted.tolist()))
    has = F.exists(asked, lambda k: (k >= F.col("first_key")) & (k <= F.col("last_key")))
    at = store.select("part", "first_key", "last_key").where(has).select("part", "first_key").distinct().collect()  # bounded by the keys that are asked for
    some = store.where(F.col("first_key").isin([r.first_key for r in at]) & F.col("part").isin([r.part for r in at]) & has)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                mine = wanted[(wanted >= row["first_key"]) & (wanted <= row["last_key"])]
                ix = Index(row["index"])
                first = ix.find(mine)
                ok = first >= 0
                lo, hi = ix.offsets[first[ok]].astype(np.int64), ix.offsets[first[ok] + 1].astype(np.int64)
                columns = [pa.array([row[c]] * int(ok.sum()), t) for c, t in (("part", pa.int32()), ("block", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(mine[ok]), pa.array(lo), pa.array(hi)], ["part", "block", "doc_id", "lo", "hi"])

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, f"<u{w}").astype("<u4").tobytes() for x, w in zip(b["raw"].to_pylist(), b["width"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    placed = some.select("part", "block", "first_key", "last_key", "index").mapInArrow(places, "part int, block int, doc_id long, lo long, hi long")
    raw = some.select("part", "block", "width", "payload").join(placed, ["part", "block"])
    raw = raw.select("doc_id", "width", F.expr("substring(payload, cast(lo * width + 1 as int), cast((hi - lo) * width as int))").alias("raw"))
    return raw.mapInArrow(widened, found_schema)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import owned, table

    path = owned(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_store(spark, path, with_ids=False)
