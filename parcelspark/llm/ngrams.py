"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays.

Counting: each task counts the word pairs of its documents and sends them, as sorted arrays, to a grid of shards (rows
by ranges of the first word's hash, columns by hash of the second), so that a word in a third of all pairs is split over
a whole row. A shard adds up its pairs, stores them as one file, and sends what it knows of each word (occurrences,
followers seen once, twice, ..., preceding words) to word shards, which add up and store these.

Scoring: workers map the files into memory and look up the sorted distinct pairs of a batch. Mapped pages are shared by
all workers of a machine and given back under pressure. Where the shared folder has no local path, the workers of an
executor fetch the files once.
"""

from __future__ import annotations

import atexit
import mmap
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import ceil, sqrt
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, lower_words, mixed, owned, partitions, remainder, runs, shared_dir, table, word_hashes

#: The token after each document's words, and the context before them (no words: they hold white space).
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end ", b" begin "))
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Tokens that a task holds before it counts their pairs; bytes of text whose words it holds as objects.
HELD, SLICE = 2_000_000, 2_000_000
#: Counts of a word: occurrences as a context, followers seen 1, 2, 3, 4 times, followers, preceding words.
STATS = 7
#: Discounts where the counts of counts can't give them.
DEFAULTS = (0.5, 1.0, 1.5)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _MULT + second)


def document_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' tokens, each closed by END; and the number of tokens of each."""
    words = [lower_words(t) for t in texts]
    n = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    out = np.empty(int(n.sum()), np.uint64)
    ends = np.cumsum(n) - 1
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end] = END
    out[~is_end] = word_hashes([w for ws in words for w in ws])
    return out, n


def contexts(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each token; BEGIN before a document's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(n) - n] = BEGIN
    return before


def summed(keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys in order (of the first key, then the second) and the sums of their values."""
    order = np.lexsort(keys[::-1])
    keys, values = tuple(k[order] for k in keys), values[order]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), np.add.reduceat(values, at, axis=0) if len(at) else values


def _range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal ranges of mixed hashes."""
    return ((mixed(hashes) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Folder:
    """A folder in the shared store; files in it are written whole, by one rename, and mapped for reading."""

    def __init__(self, uri: str):
        self.uri = uri
        self.local = uri.removeprefix("file://") if uri.startswith(("file:", "/")) else None
        if self.local and self.local.startswith("file:"):
            self.local = self.local.removeprefix("file:")

    def write(self, name: str, data: bytes) -> None:
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            part = f"{self.local}/.{name}-{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, f"{self.local}/{name}")
            return
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(self.uri)
        fs.create_dir(path, recursive=True)
        part = f"{path}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(data)
        fs.move(part, f"{path}/{name}")

    def sizes(self) -> dict[str, int]:
        """Bytes of each file, without parts of unfinished attempts."""
        if self.local:
            return {e.name: e.stat().st_size for e in os.scandir(self.local) if e.name[0] != "."}
        from pyarrow.fs import FileSelector, FileSystem

        fs, path = FileSystem.from_uri(self.uri)
        return {f.base_name: f.size for f in fs.get_file_info(FileSelector(path)) if f.base_name[0] != "."}

    def map(self, name: str) -> mmap.mmap:
        with open(f"{self.local}/{name}", "rb") if self.local else self._fetched(name) as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def _fetched(self, name: str):
        """The file, fetched once for all workers that share a temporary folder; files appear there whole, by a rename.

        The worker that fetched a file deletes it at its end; what others have opened stays readable, and who comes later
        fetches it again.
        """
        from pyarrow.fs import FileSystem

        fetched = f"{tempfile.gettempdir()}/parcelspark-model-{self.uri.rstrip('/').rpartition('/')[2]}"
        os.makedirs(fetched, exist_ok=True)
        path, part = f"{fetched}/{name}", f"{fetched}/.{name}-{uuid.uuid4().hex}"
        try:
            return open(path, "rb")
        except FileNotFoundError:
            fs, there = FileSystem.from_uri(self.uri)
            with fs.open_input_stream(f"{there}/{name}") as src, open(part, "wb") as f:
                shutil.copyfileobj(src, f)
            own = open(part, "rb")
            os.replace(part, path)
            atexit.register(lambda: Path(path).unlink(missing_ok=True))
            return own


@dataclass
class Model:
    """Where the arrays are, and the few numbers that scoring needs of the whole corpus."""

    uri: str
    side: int
    files: frozenset[str]  # shards without words or pairs have none
    tokens: int  # N
    types: int  # V
    pair_types: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_left: float  # probability mass that discounts take from continuation counts


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of Chen and Goodman, from the counts of counts."""
    if not (n1 and n2 and n3 and n4):
        return DEFAULTS
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(i)) for i, d in enumerate(found, 1))


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts as they are stored, unsigned 32 bits; one that doesn't fit raises, as a wrapped count falsifies scores."""
    if counts.size and int(counts.max()) >= 1 << 32:
        raise OverflowError(f"a count of {int(counts.max())} doesn't fit 32 bits: the training text is too large")
    return counts.astype("<u4")


def _blocks(tokens: np.ndarray, n: np.ndarray, side: int) -> Iterator[tuple[int, bytes]]:
    (first, second), c = summed((contexts(tokens, n), tokens), np.ones(len(tokens), np.uint32))
    shard = _range_of(first, side) * side + (mixed(second) % np.uint64(side)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    first, second, c, shard = first[order], second[order], c[order], shard[order]
    for s in np.unique(shard).tolist():
        lo, hi = np.searchsorted(shard, s), np.searchsorted(shard, s, side="right")
        words, runs = np.unique(first[lo:hi], return_counts=True)
        yield s, struct.pack("<qq", len(words), hi - lo) + words.tobytes() + narrow(runs).tobytes() + second[lo:hi].tobytes() + narrow(c[lo:hi]).tobytes()


def _block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = struct.unpack_from("<qq", data)
    words, runs = np.frombuffer(data, "<u8", n, 16), np.frombuffer(data, "<u4", n, 16 + 8 * n)
    return np.repeat(words, runs), np.frombuffer(data, "<u8", m, 16 + 12 * n), np.frombuffer(data, "<u4", m, 16 + 12 * n + 8 * m).astype(np.int64)  # to be summed


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    rows = ((s.as_py(), d) for b in batches for s, d in zip(b["shard"], b["data"]))
    for shard, group in groupby(rows, lambda r: r[0]):
        yield shard, (d.as_py() for _, d in group)


def _out(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "data"])


TOTALS = ("tokens", "types", "pair_types", *(f"n{i}" for i in range(1, 5)), *(f"m{i}" for i in range(1, 5)), "m_more")


def fit(docs: DataFrame) -> Model:
    """A model of all rows of docs. Null and empty texts are a lone END. Repeated rows count each. Without rows every token has probability 1."""
    spark = docs.sparkSession
    parts = partitions(spark)
    side, folder = ceil(sqrt(2 * parts)), Folder(owned(spark, f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            blocks = list(_blocks(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), side))
            for at in range(0, len(blocks), 16):
                yield _out(blocks[at : at + 16])

        for b in batches:
            for lo, hi in runs(b["text"], SLICE):
                held.append(document_tokens(bytes_of(b["text"].slice(lo, hi - lo))))
                size += len(held[-1][0])
                if size >= HELD:
                    yield from flushed()
                    held, size = [], 0
        if held:
            yield from flushed()

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _groups(batches):
            parts_ = list(zip(*map(_block, blocks)))
            (first, second), c = summed((np.concatenate(parts_[0]), np.concatenate(parts_[1])), np.concatenate(parts_[2]))
            keys = pair_hashes(first, second)
            order = np.argsort(keys, kind="stable")
            folder.write(f"pairs-{shard}", keys[order].tobytes() + narrow(c[order]).tobytes())
            before = np.stack([c, c == 1, c == 2, c == 3, c == 4, np.ones_like(c), np.zeros_like(c)], 1).astype(np.int64)
            (contexts_,), a = summed((first,), before)
            (words,), p = summed((second,), np.ones(len(second), np.int64))
            after = np.zeros((len(words), STATS), np.int64)
            after[:, -1] = p
            (words,), stats = summed((np.concatenate([contexts_, words]),), np.concatenate([a, after]))
            of = _range_of(words, side)
            rows = []
            for t in np.unique(of).tolist():
                some = of == t
                rows.append((t, struct.pack("<q", int(some.sum())) + words[some].tobytes() + narrow(stats[some]).T.tobytes()))
            yield _out(rows)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _groups(batches):
            words, stats = [], []
            for d in blocks:
                (n,) = struct.unpack_from("<q", d)
                words.append(np.frombuffer(d, "<u8", n, 8))
                stats.append(np.frombuffer(d, "<u4", n * STATS, 8 + 8 * n).reshape(STATS, n).T.astype(np.int64))
            (w,), s = summed((np.concatenate(words),), np.concatenate(stats))
            folder.write(f"words-{shard}", w.tobytes() + narrow(s).T.tobytes())
            token = w != BEGIN
            ends = s[w == BEGIN, 0].sum()  # END is no context; it occurs once in each document
            before = s[token, 6]
            row = [s[token, 0].sum() + ends, (before > 0).sum(), s[:, 5].sum(), *s[:, 1:5].sum(0), *((before == i).sum() for i in range(1, 5)), (before > 2).sum()]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.array([int(x)], pa.int64()) for x in row)], ["shard", *TOTALS])

    blocks = docs.select("text").mapInArrow(counted, "shard int, data binary").repartition(parts, "shard").sortWithinPartitions("shard")
    stats = blocks.mapInArrow(paired, "shard int, data binary").repartition(parts, "shard").sortWithinPartitions("shard")
    rows = stats.mapInArrow(gathered, "shard long, " + ", ".join(f"{x} long" for x in TOTALS)).collect()  # one small row for each of `side` word shards
    t = {k: sum(r[k] for r in rows) for k in TOTALS}
    d = discounts(t["m1"], t["m2"], t["m3"], t["m4"])
    left = (d[0] * t["m1"] + d[1] * t["m2"] + d[2] * t["m_more"]) / t["pair_types"] if t["pair_types"] else 1.0
    sizes = folder.sizes() if rows else {}
    if sum(n for k, n in sizes.items() if k.startswith("pairs-")) != 12 * t["pair_types"] or any(f"words-{r['shard']}" not in sizes for r in rows):
        raise RuntimeError(f"{folder.uri} is not shared by driver and executors")
    return Model(folder.uri, side, frozenset(sizes), t["tokens"], t["types"], t["pair_types"], discounts(t["n1"], t["n2"], t["n3"], t["n4"]), d, left)


class Reader:
    """Look-ups in the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.m, self.folder, self.maps = model, Folder(model.uri), {}

    def arrays(self, kind: str, shard: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and their `width` counts; empty where no file was written."""
        key = kind, shard
        if key not in self.maps:
            if f"{kind}-{shard}" not in self.m.files:
                self.maps[key] = np.empty(0, np.uint64), np.empty((width, 0), np.uint32)
                return self.maps[key]
            data = self.folder.map(f"{kind}-{shard}")
            n = len(data) // (8 + 4 * width)
            self.maps[key] = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n * width, 8 * n).reshape(width, n)
        return self.maps[key]

    def find(self, kind: str, shards: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """The counts of each key (rows: counts), zero where it isn't there. Keys are looked up in order within a shard."""
        out = np.zeros((width, len(keys)), np.int64)
        order = np.lexsort((keys, shards))
        ordered = shards[order]
        for s in np.unique(shards).tolist():
            at = order[np.searchsorted(ordered, s) : np.searchsorted(ordered, s, side="right")]
            have, counts = self.arrays(kind, s, width)
            if len(have):
                place = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
                hit = have[place] == keys[at]
                out[:, at[hit]] = counts[:, place[hit]]
        return out

    def words(self, hashes: np.ndarray) -> np.ndarray:
        return self.find("words", _range_of(hashes, self.m.side), hashes, STATS)

    def score(self, tokens: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """n_known, base and log-probability of each document of a batch."""
        m, starts = self.m, np.cumsum(n) - n
        distinct, at = np.unique(np.concatenate([tokens, [BEGIN]]), return_inverse=True)
        stats = self.words(distinct)
        end, begin = at[-2] if len(tokens) else 0, at[-1]
        count = stats[0].copy()
        count[end] = stats[0, begin]  # every document ends once
        at = at[:-1]
        base = np.log10((count + 1) / (m.tokens + m.types + 1))
        # the lower order: continuation counts over the uniform distribution of V + 1 words
        before = stats[6]
        d = np.asarray([0.0, *m.word_discounts])
        lower = m.word_left / (m.types + 1)
        if m.pair_types:
            lower = lower + np.maximum(before - d[np.minimum(before, 3)], 0) / m.pair_types
        lower = np.broadcast_to(lower, before.shape)
        # the mass that a context leaves to it
        d = np.asarray([0.0, *m.pair_discounts])
        total, n1, n2 = stats[0], stats[1], stats[2]
        more = stats[5] - n1 - n2
        left = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * more) / np.maximum(total, 1), 1.0)
        context = np.empty_like(at)
        context[1:] = at[:-1]
        context[starts] = begin
        pairs, back = np.unique(context.astype(np.int64) << 32 | at, return_inverse=True)
        first, second = pairs >> 32, pairs & 0xFFFFFFFF
        a, b = distinct[first], distinct[second]
        c = self.find("pairs", _range_of(a, m.side) * m.side + (mixed(b) % np.uint64(m.side)).astype(np.int64), pair_hashes(a, b), 1)[0]
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total[first], 1) + left[first] * lower[second]
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.empty(0)
        return {"n_known": add((count > 0)[at].astype(np.int64)), "base": add(base[at]), "score": add(np.log10(p)[back])}


_READERS: dict[str, Reader] = {}


def reader(model: Model) -> Reader:
    """One for each Python worker and model."""
    if model.uri not in _READERS:
        _READERS.clear()
        _READERS[model.uri] = Reader(model)
    return _READERS[model.uri]


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """n_tokens, n_known (tokens seen in training), train_tokens, base_score (add-one unigrams), score (log10 of the
    text's probability) and perplexity of each document. A null or empty text is a lone END. Repeated rows are scored each."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, hi - lo) for b in batches for lo, hi in runs(b["text"], SLICE)):
            tokens, n = document_tokens(bytes_of(b["text"]))
            r = reader(model).score(tokens, n)
            columns = [b["doc_id"], pa.array(n), pa.array(r["n_known"].astype(np.int64)), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(r["base"], pa.float64()), pa.array(r["score"], pa.float64()), pa.array(np.power(10.0, np.minimum(-r["score"] / n, 300.0)), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, SCORED)


def op9_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder("doc_id", 7) != 2))
    return score(docs, model).withColumn("held_out", remainder("doc_id", 7) == 2)
