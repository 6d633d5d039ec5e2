"""Ranked lexical search by Block-Max WAND over an inverted index of all documents.

The index is dealt by documents: a task makes segments of its documents, and a segment holds, for each term, blocks of 128
postings (ordinals as differences, frequencies; each in as few bytes as its block allows) under a header with their first
and last ordinal and the greatest impact of any of them. Postings are never shuffled, and a segment is all that a task
holds.

A search moves over headers alone first (shallow moves): between any two ends of blocks, the sum of the maxima of the
blocks that cover the stretch bounds every score in it. Stretches below the score of the item's k-th best document so far
are skipped, and only blocks that cover another one are decompressed. The stretches of the highest bounds come first,
so that the score to beat rises early. Scores are whole numbers, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, partitions, sliced, table, written

BLOCK = 128
#: Documents and postings of a segment at most (one document more).
SEGMENT_DOCS, SEGMENT_POSTINGS = 8192, 1 << 20
#: Items that are searched together in one segment.
ITEMS = 1024
#: Stretches that are looked at before all others where an item has no score to beat yet; twice as many each time.
FIRST_STRETCHES = 8
HEADER = np.dtype([("first", "<u4"), ("last", "<u4"), ("at", "<u4"), ("impact", "<u4"), ("count", "u1"), ("gap_bytes", "u1"), ("tf_bytes", "u1")])
INDEX = "segment long, term string, df long, headers binary, postings binary"

#: Bytes of terms stand for themselves (A-Z lower-cased), all others are spaces; characters from U+0080 on are terms'.
_TERM_BYTES = bytes(c if c >= 0x80 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in order: its longest runs of ASCII letters and digits and of characters from U+0080 on."""
    return text.translate(_TERM_BYTES).split()


def impact(tf, m):
    """What a term of weight 1 adds to the score of a document with `tf` occurrences of it and length norm `m`."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def norm(n, documents: int, terms: int):
    """Length norm of documents of n terms among `documents` with `terms` in all."""
    return 100 - 90 + (90 * n * documents) // max(terms, 1)


@dataclass
class Index:
    """table: a row for each term of each segment, and one without a term that holds the segment's doc_ids and lengths."""

    table: DataFrame
    documents: int
    terms: int


class _Numbers(dict):
    """Numbers new keys in order."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _narrow(values: np.ndarray, widths: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    """Writes each value little-endian in its number of bytes at its place in out."""
    for w in (1, 2, 4):
        chosen = widths == w
        raw = values[chosen].astype(f"<u{w}").view(np.uint8).reshape(-1, w)
        out[starts[chosen][:, None] + np.arange(w)] = raw


def _widths(highest: np.ndarray) -> np.ndarray:
    return np.where(highest < 256, 1, np.where(highest < 65536, 2, 4))


def _binary(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose values lie one after the other in raw."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


class _Segment:
    """Postings of a task's documents, until they are enough for a segment."""

    def __init__(self, most_docs: int, most_postings: int, block: int):
        self.most_docs, self.most_postings, self.block = most_docs, most_postings, block
        self.numbers, self.ids, self.lengths = _Numbers(), [], []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int, words: list[bytes]) -> None:
        found, counts = np.unique(np.asarray([*map(self.numbers.__getitem__, words)], np.int64), return_counts=True)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.terms.append(found.astype(np.int32))
        self.counts.append(counts.astype(np.int32))
        self.postings += len(found)

    def full(self) -> bool:
        return len(self.ids) >= self.most_docs or self.postings >= self.most_postings

    def batches(self, segment: int, documents: int, all_terms: int) -> Iterator[pa.RecordBatch]:
        words = sorted(self.numbers)
        place = np.empty(len(words), np.int32)
        place[[self.numbers[w] for w in words]] = np.arange(len(words))
        term = place[np.concatenate(self.terms)]
        doc = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.terms])
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], np.concatenate(self.counts)[order].astype(np.int64)
        df = np.bincount(term, minlength=len(words))
        begins = np.cumsum(df) - df
        nth = np.arange(len(term)) - begins[term]
        heads = np.flatnonzero(nth % self.block == 0)
        size = np.diff(np.append(heads, len(term)))
        of = np.repeat(np.arange(len(heads)), size)
        gap = np.where(nth % self.block == 0, 0, doc - np.concatenate([[0], doc[:-1]]))
        m = norm(np.asarray(self.lengths, np.int64), documents, all_terms)
        header = np.zeros(len(heads), HEADER)
        header["first"], header["last"], header["count"] = doc[heads], doc[heads + size - 1], size - 1
        header["impact"] = np.maximum.reduceat(impact(tf, m[doc]), heads)
        gaps, tfs = _widths(np.maximum.reduceat(gap, heads)), _widths(np.maximum.reduceat(tf, heads))
        header["gap_bytes"], header["tf_bytes"] = gaps, tfs
        ends = np.cumsum(size * (gaps + tfs))
        starts = ends - size * (gaps + tfs)
        raw, inside = np.empty(ends[-1], np.uint8), np.arange(len(term)) - heads[of]
        _narrow(gap, gaps[of], starts[of] + inside * gaps[of], raw)
        _narrow(tf, tfs[of], starts[of] + size[of] * gaps[of] + inside * tfs[of], raw)
        blocks = -(-df // self.block)
        last = np.cumsum(blocks)
        header["at"] = starts - np.repeat(starts[last - blocks], blocks)
        head_bytes = header.view(np.uint8).reshape(len(header), -1)
        for lo in range(0, len(words), 4096):
            hi = min(lo + 4096, len(words))
            a, b = last[lo] - blocks[lo], last[hi - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(hi - lo, segment)), pa.array([w.decode("utf-8", "replace") for w in words[lo:hi]]), pa.array(df[lo:hi]),
                    _binary(head_bytes[a:b].ravel(), (last[lo:hi] - a) * HEADER.itemsize), _binary(raw[starts[a] : ends[b - 1]], ends[last[lo:hi] - 1] - starts[a]),
                ],
                ["segment", "term", "df", "headers", "postings"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([segment]), pa.array([None], pa.string()), pa.array([len(self.ids)]), pa.array([np.asarray(self.ids, "<i8").tobytes()]), pa.array([np.asarray(self.lengths, "<i8").tobytes()])],
            ["segment", "term", "df", "headers", "postings"],
        )


def build_index(docs: DataFrame, segment_docs: int = SEGMENT_DOCS, segment_postings: int = SEGMENT_POSTINGS, block: int = BLOCK) -> Index:
    """The index of docs (doc_id, text): one pass counts documents and terms, one writes the segments; nothing is shuffled.

    Documents without a term take no part, nor do rows without a doc_id. Rows that repeat a doc_id are documents each.
    """
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for b in sliced(batches):
            sizes = [len(terms_of(t)) for t in bytes_of(b["text"])]
            documents, terms = documents + sum(n > 0 for n in sizes), terms + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([terms])], ["documents", "terms"])

    total = docs.select("text").mapInArrow(counted, "documents long, terms long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    documents, all_terms = int(total[0]), int(total[1])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        first, made, segment = (context.partitionId() if context else 0) << 24, 0, _Segment(segment_docs, segment_postings, block)
        for b in sliced(batches):
            for doc_id, text in zip(b["doc_id"].to_pylist(), bytes_of(b["text"])):
                if words := terms_of(text):
                    segment.add(doc_id, words)
                    if segment.full():
                        yield from segment.batches(first + made, documents, all_terms)
                        made, segment = made + 1, _Segment(segment_docs, segment_postings, block)
        if segment.ids:
            yield from segment.batches(first + made, documents, all_terms)

    return Index(written(docs.mapInArrow(indexed, INDEX), "lexical"), documents, all_terms)


class _Postings:
    """The blocks of one term in one segment; `spans` are what shallow moves see of them."""

    def __init__(self, weight: int, headers: bytes, raw: bytes, norms: np.ndarray):
        self.header, self.raw, self.weight, self.norms = np.frombuffer(headers, HEADER), raw, weight, norms
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if len(self.header) == 1:  # a short list is read at once: each posting is a span of its own
            docs, scores = self.block(0)
            self.spans = docs, docs, scores, np.zeros(len(docs), np.int64)
        else:
            h = self.header
            self.spans = h["first"].astype(np.int64), h["last"].astype(np.int64), h["impact"].astype(np.int64) * weight, np.arange(len(h))

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals of the block's documents and what the term adds to their scores."""
        if i not in self.blocks:
            h = self.header[i]
            size, at, gaps, tfs = int(h["count"]) + 1, int(h["at"]), int(h["gap_bytes"]), int(h["tf_bytes"])
            docs = int(h["first"]) + np.cumsum(np.frombuffer(self.raw, f"<u{gaps}", size, at).astype(np.int64))
            tf = np.frombuffer(self.raw, f"<u{tfs}", size, at + size * gaps).astype(np.int64)
            self.blocks[i] = docs, impact(tf, self.norms[docs]) * self.weight
        return self.blocks[i]


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def threshold(self) -> int:
        """A document must reach this score to be among the best (or, equal, have a smaller doc_id)."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def search_segment(lists: list[_Postings], ids: np.ndarray, best: Best) -> int:
    """Adds the segment's documents that are among an item's best; returns how many blocks it read."""
    start, stop, bound, block = (np.concatenate([x.spans[i] for x in lists]) for i in range(4))
    owner = np.repeat(np.arange(len(lists)), [len(x.spans[0]) for x in lists])
    cuts = np.unique(np.concatenate([start, stop + 1]))
    i, j = np.searchsorted(cuts, start), np.searchsorted(cuts, stop + 1)
    # sums of whole numbers below 2**53
    bounds = np.cumsum(np.bincount(i, bound, len(cuts)) - np.bincount(j, bound, len(cuts)))
    read, done, most = 0, np.zeros(len(cuts), bool), FIRST_STRETCHES
    while True:
        alive = (bounds >= best.threshold()) & ~done
        if not alive.any():
            return read
        if len(best.scores) < best.k and alive.sum() > most:
            places = np.flatnonzero(alive)
            alive[:] = False
            alive[places[np.argsort(-bounds[places], kind="stable")[:most]]] = True
            most *= 2
        done |= alive
        before = np.concatenate([[0], np.cumsum(alive)])
        wanted = np.flatnonzero(before[j] > before[i])
        if not len(wanted):
            continue
        found = [lists[t].block(b) for t, b in {*zip(owner[wanted].tolist(), block[wanted].tolist())}]
        read += len(found)
        docs, scores = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        inside = alive[np.searchsorted(cuts, docs, side="right") - 1]
        sums = np.bincount(docs[inside], scores[inside], len(ids)).astype(np.int64)
        hits = np.flatnonzero(sums >= best.threshold())
        best.add(ids[hits], sums[hits])


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id and each distinct term of its texts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            items, terms = [], []
            for item, text in zip(b["item_id"].to_pylist(), bytes_of(b["text"])):
                found = {*terms_of(text)}
                items += [item] * len(found)
                terms += [t.decode("utf-8", "replace") for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.string())], ["item_id", "term"])

    asked = queries.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return asked.mapInArrow(split, "item_id long, term string").distinct()


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for each item of queries (item_id, text).

    Equal scores go by ascending doc_id. Items without a term, or whose terms no document holds, have no rows; rows that
    repeat an item_id are one item with the terms of all. An item's terms count once each.
    """
    documents, all_terms = index.documents, index.terms
    asked = written(query_terms(queries), "asked")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // ITEMS))
    lists = index.table.where("term is not null").join(asked.select("term").distinct(), "term")
    weight = F.floor(1000 * F.log((2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weights = lists.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight")).where("weight > 0")
    of = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("part")
    terms = asked.select("item_id", "term", of).groupBy("term", "part").agg(F.collect_list("item_id").alias("items")).join(weights, "term")
    rows = lists.join(terms, "term").select("segment", "part", F.lit(1).alias("kind"), "weight", "items", "headers", "postings")
    heads = index.table.where("term is null").select("segment", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("weight"), F.array().cast("array<long>").alias("items"), "headers", "postings")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        of_item: dict[int, list[_Postings]] = {}
        ids = norms = np.empty(0, np.int64)

        def finish() -> None:
            for item, held in of_item.items():
                search_segment(held, ids, best.setdefault(item, Best(k)))
            of_item.clear()

        for b in batches:
            for kind, weight, items, headers, raw in zip(b["kind"].to_pylist(), b["weight"].to_pylist(), b["items"].to_pylist(), b["headers"].to_pylist(), b["postings"].to_pylist()):
                if kind == 0:  # a segment's documents come before its terms
                    finish()
                    ids, norms = np.frombuffer(headers, "<i8"), norm(np.frombuffer(raw, "<i8"), documents, all_terms)
                    continue
                held = _Postings(weight, headers, raw, norms)
                for item in items:
                    of_item.setdefault(item, []).append(held)
        finish()
        for item, x in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.ids), item)), pa.array(x.ids), pa.array(x.scores)], ["item_id", "doc_id", "score"])

    dealt = heads.unionByName(rows).repartition(partitions(asked.sparkSession), "segment", "part").sortWithinPartitions("segment", "part", "kind")
    found = dealt.select("kind", "weight", "items", "headers", "postings").mapInArrow(searched, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.select("item_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def op12_block_max_wand(spark, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), items AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0
), postings AS (
    SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM docs) GROUP BY id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM postings, totals WHERE term IN (SELECT term FROM items) GROUP BY term, n_docs
), scored AS (
    SELECT item_id, id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN postings USING (term) JOIN docs USING (id), totals GROUP BY item_id, id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored JOIN docs USING (id) WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
