"""Nearest neighbours by inner product through an inverted multi-index.

Vectors get one more coordinate so that largest inner product is smallest distance (the public reduction
[x, sqrt(M^2 - |x|^2)] against [q, 0]), and are cut into two halves. Each half has its own codebook; a vector's cell
is its pair of nearest centroids. A query first visits cells by summed half distances, in the order that a heap over
the two sorted centroid lists gives, until the visited cells hold enough vectors; their k-th score is its floor. Then it
visits every other cell whose bound (the centroids' product and the cell's radii) reaches the floor, so that no cell that
may hold one of the k nearest is left out: the result is exact. With a `share` the walk goes on until the cells hold that
part of all vectors, and nothing follows: then recall is to be measured.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table, written

#: Vectors that codebooks are fitted on, drawn by a hash of vec_id; Lloyd steps.
SAMPLE, STEPS = 20_000, 12
#: Centroids of each half grow with the square root of the vectors, so that a cell has about PER_CELL of them, between
#: these bounds: the upper one keeps what the driver and each task know of the cells under 12 MB.
PER_CELL, FEWEST, MOST = 64, 16, 512
#: A query's floor comes from cells that hold at least so many times k vectors.
TIMES = 25
#: Entries of a bucket: small cells share one, larger cells are cut, so that no task has a whole hot cell. On many
#: vectors up to WIDEST times as many, as each query is sent to each bucket that it visits.
CHUNK, WIDEST = 4096, 16
#: Part of |q| M by which bounds and block products are widened against rounding.
SLACK = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of double), without vectors that are null, empty, zero, or hold null or non-finite components."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    d = vectors.select("vec_id", x.alias("x")).where("x is not null and vec_id is not null")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return d.where(~F.exists("x", bad) & F.exists("x", lambda v: v != 0))


def _kmeans(x: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        for i in range(len(c)):
            if (m := near == i).any():
                c[i] = x[m].mean(0)
    return c


class Codebooks:
    """Two codebooks, the norm bound M, the cells' counts and radii: at most 4 MOST**2 numbers besides the centroids."""

    def __init__(self, first: np.ndarray, second: np.ndarray, bound: float, cut: int):
        self.first, self.second, self.bound, self.cut = first, second, bound, cut
        self.clear()

    def clear(self) -> None:
        """No vectors in any cell. radii: the largest distance from the centroid in the first half, the second and both."""
        self.counts = np.zeros((len(self.first), len(self.second)), np.int64)
        self.radii = np.zeros((3, len(self.first), len(self.second)))

    def halves(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.bound**2 - (x**2).sum(1), 0))
        return x[:, : self.cut], np.hstack([x[:, self.cut :], last[:, None]])

    def distances(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for h, c in zip(self.halves(x, query), (self.first, self.second)):
            out.append((h**2).sum(1)[:, None] - 2 * h @ c.T + (c**2).sum(1))
        return out[0], out[1]

    def visit(self, d1: np.ndarray, d2: np.ndarray, enough: float) -> list[int]:
        """Cells in order of summed distance until they hold `enough` vectors: the multi-sequence walk with a heap."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        heap, seen, got, cells = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, 0, []
        while heap and got < enough:
            _, i, j = heapq.heappop(heap)
            n = int(self.counts[o1[i], o2[j]])
            if n:
                got += n
                cells.append(int(o1[i]) * len(self.second) + int(o2[j]))
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(o1) and b < len(o2) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
        return cells

    def offsets(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of vectors from their cell's centroids in the original components of each half."""
        a, b = np.divmod(cell, len(self.second))
        return np.sqrt(((x[:, : self.cut] - self.first[a]) ** 2).sum(1)), np.sqrt(((x[:, self.cut :] - self.second[b, :-1]) ** 2).sum(1))

    def bounds(self, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The most that each query's product with a vector of each cell can be: q x = q c + q (x - c), by Cauchy and Schwarz."""
        a, b = np.divmod(cells, len(self.second))
        r1, r2, r = self.radii.reshape(3, -1)[:, cells]
        q1, q2 = q[:, : self.cut], q[:, self.cut :]
        n1, n2, n = (np.sqrt((h**2).sum(1))[:, None] for h in (q1, q2, q))
        return (q1 @ self.first.T)[:, a] + (q2 @ self.second[:, :-1].T)[:, b] + np.minimum(n1 * r1 + n2 * r2, n * r) + SLACK * n * self.bound

    def may_hold(self, q: np.ndarray, floor: float) -> np.ndarray:
        """Cells with vectors whose product with q may reach the floor."""
        cells = np.flatnonzero(self.counts > 0)
        return cells[self.bounds(q[None], cells)[0] >= floor]


def grown(n: int) -> int:
    """Centroids of each half for n vectors."""
    return int(min(max(np.ceil(np.sqrt(n / PER_CELL)), FEWEST), MOST))


def buckets(counts: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """The first bucket of each cell and the number of buckets over which it is spread, for buckets of about `size`."""
    first, parts, at, held = [], [], 0, 0
    for n in counts.ravel().tolist():
        if held and held + n > size:
            at, held = at + 1, 0
        first.append(at)
        parts.append(max(1, -(-n // size)))
        if n > size:
            at, held = at + parts[-1], 0
        else:
            held += n
    return first, parts


def fit(vectors: DataFrame, sample: int = SAMPLE, centroids: int | None = None, steps: int = STEPS) -> Codebooks | None:
    """Codebooks from about `sample` vectors at most; None for no vectors. vectors: as usable() gives them, of one length.
    centroids: of each half, as grown() gives them for the number of vectors if None."""
    n, squared, size = vectors.agg(F.count("*"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)), F.max(F.size("x"))).first()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30))
    rows = vectors.where(draw < int((1 << 30) * min(1.0, sample / n)) + 1).select("x").collect()  # bounded by `sample`
    x = np.asarray([r[0] for r in rows], float).reshape(-1, size)
    cut = size // 2
    books = Codebooks(np.zeros((1, cut)), np.zeros((1, size - cut + 1)), float(np.sqrt(squared)), cut)
    if len(x):
        a, b = books.halves(x, query=False)
        centroids = centroids or grown(n)
        books.first, books.second = _kmeans(a.copy(), centroids, steps, 1), _kmeans(b.copy(), centroids, steps, 2)
    books.clear()
    return books


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    for b in batches:
        if b.num_rows:
            x = b["x"]
            yield b["vec_id"].to_numpy(zero_copy_only=False), np.asarray(x.flatten()).reshape(b.num_rows, -1), b


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _nearest(batches: Iterator[pa.RecordBatch], books: Codebooks, k: int, rest: bool) -> Iterator[pa.RecordBatch]:
    """query_id, turn, vec_id, score: the k best of each query in a bucket that reach its floor. Entries come before queries."""
    bucket, parts = None, []
    for b in batches:
        if not b.num_rows:
            continue
        x, key, asks = _matrix(b), b["bucket"].to_numpy(), b["query"].to_numpy()
        ids, turn, cell, floor = (b[c].to_numpy() for c in ("vec_id", "turn", "cell", "floor"))
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(asks) != 0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if key[lo] != bucket:
                bucket, parts, held = key[lo], [], None
            if not asks[lo]:
                parts.append((x[lo:hi].copy(), ids[lo:hi].copy(), cell[lo:hi].copy()))
                continue
            if not parts:
                continue
            if held is None:
                entries, known, cells = (np.concatenate(p) for p in zip(*parts))
                local, place = np.unique(cells, return_inverse=True)
                held = entries, known, local, place, np.sqrt((entries**2).sum(1).max())
            step = max(1, (1 << 21) // len(held[0]))
            for i in range(lo, hi, step):
                j = min(i + step, hi)
                yield _block(held, books, rest, x[i:j], ids[i:j], turn[i:j], floor[i:j], b["cells"].slice(i, j - i).to_pylist(), k)


def _block(held: tuple, books: Codebooks, rest: bool, x: np.ndarray, ids: np.ndarray, turns: np.ndarray, floor: np.ndarray, listed: list[list[int]], k: int) -> pa.RecordBatch:
    """Of the listed cells, or of the others that may hold such as reach the floor: block products choose, with room for
    their rounding; sums of double products rank."""
    entries, known, local, place, longest = held
    open_to = np.zeros((len(x), len(local)), bool)
    for i, cells in enumerate(listed):
        open_to[i] = np.isin(local, cells)
    if rest:
        open_to = ~open_to & (books.bounds(x, local) >= floor[:, None])
    read = open_to.any(0)[place]
    if read.mean() < 0.75:
        entries, known, place = entries[read], known[read], place[read]
    q, t, v, s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for own, turn, mine, least, mask, row in zip(ids, turns, x, floor, open_to, x @ entries.T):
        row[~mask[place] | (known == own)] = -np.inf
        if len(row) > k:
            least = max(least, np.partition(row, -k)[-k])
        some = np.flatnonzero((row >= least - SLACK * longest * np.sqrt((mine**2).sum())) & (row > -np.inf))
        exact = (entries[some] * mine).sum(1)
        order = np.lexsort((known[some], -exact))[:k]
        q.append(np.full(len(order), own, np.int64))
        t.append(np.full(len(order), turn, np.int64))
        v.append(known[some][order])
        s.append(exact[order])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (q, t, v, s)], ["query_id", "turn", "vec_id", "score"])


class Index:
    """The vectors with their cells as a table, the codebooks with counts and radii, and the buckets that cells lie in."""

    def __init__(self, base: DataFrame, books: Codebooks, usual: int, chunk: int):
        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x, b in _batches(batches):
                d1, d2 = books.distances(x, query=False)
                cell = d1.argmin(1) * len(books.second) + d2.argmin(1)
                r1, r2 = books.offsets(x, cell)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b["vec_id"], b["x"], pa.array(r1), pa.array(r2)], ["cell", "vec_id", "x", "r1", "r2"])

        spark = base.sparkSession
        entries = written(base.mapInArrow(cells, "cell int, vec_id long, x array<double>, r1 double, r2 double"), "ann-entries")
        both = F.max(F.sqrt(F.col("r1") * F.col("r1") + F.col("r2") * F.col("r2")))
        for cell, n, *radii in entries.groupBy("cell").agg(F.count("*"), F.max("r1"), F.max("r2"), both).collect():  # at most MOST**2 rows
            books.counts.flat[cell] = n
            books.radii.reshape(3, -1)[:, cell] = radii
        size = min(max(chunk, int(books.counts.sum()) // (4 * partitions(spark))), chunk * WIDEST)
        self.books, self.usual, self.spark = books, usual, spark
        self.first, self.parts = (np.asarray(a, np.int32) for a in buckets(books.counts, size))
        lies = pa.table({"cell": pa.array(np.arange(len(self.first)), pa.int32()), "first": self.first, "parts": self.parts})
        known = F.broadcast(spark.createDataFrame(lies))  # at most MOST**2 rows of three numbers
        self.entries = entries.join(known, "cell").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("bucket"), "vec_id", "x", "cell")

    def asked(self, queries: DataFrame) -> DataFrame:
        """One row for each vec_id and vector."""
        return usable(queries).where(F.size("x") == self.usual).dropDuplicates(["vec_id", "x"]).select("vec_id", F.xxhash64("x").alias("turn"), "x")

    def walked(self, queries: DataFrame, enough: float) -> DataFrame:
        """The queries with the cells that they visit first."""
        books = self.books

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x, b in _batches(batches):
                d1, d2 = books.distances(x, query=True)
                visited = pa.array([books.visit(d1[i], d2[i], enough) for i in range(len(x))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["turn"], b["x"], visited], ["vec_id", "turn", "x", "cells"])

        return written(self.asked(queries).mapInArrow(walk, "vec_id long, turn long, x array<double>, cells array<int>"), "ann-walked")

    def best(self, wanted: DataFrame, k: int, rest: bool) -> DataFrame:
        """query_id, turn, vec_id, score: the k best of each query in each bucket, in its cells, or (rest) in all others that
        may hold what reaches its floor. A query goes to each bucket once, with those of its cells that lie there."""
        books, first, parts = self.books, self.first, self.parts

        def lying(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Buckets of cells, and the place of the cell in `cells` for each."""
            n = parts[cells]
            at = np.repeat(np.arange(len(cells)), n)
            return first[cells][at] + np.arange(len(at)) - (np.cumsum(n) - n)[at], at

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x, b in _batches(batches):
                at, bucket, some = [], [], []
                for i, (cells, floor) in enumerate(zip(b["cells"].to_pylist(), b["floor"].to_pylist())):
                    cells = np.asarray(cells, np.int32)
                    to: dict[int, list[int]] = {}
                    for lies, j in zip(*(a.tolist() for a in lying(cells))):
                        to.setdefault(lies, []).append(int(cells[j]))
                    if rest:
                        others = np.setdiff1d(books.may_hold(x[i], floor), cells)
                        to = {lies: to.get(lies, []) for lies in np.unique(lying(others)[0]).tolist()}
                    at += [i] * len(to)
                    bucket += to.keys()
                    some += to.values()
                for lo in range(0, len(at), 4096):  # a query goes to many buckets: not all copies of a batch at once
                    rows = pa.array(at[lo : lo + 4096], pa.int64())
                    columns = [pa.array(bucket[lo : lo + 4096], pa.int32()), b["vec_id"].take(rows), b["turn"].take(rows), b["x"].take(rows), pa.array(some[lo : lo + 4096], pa.list_(pa.int32())), b["floor"].take(rows)]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "vec_id", "turn", "x", "cells", "floor"])

        asks = wanted.select("vec_id", "turn", "x", "cells", "floor").mapInArrow(sent, "bucket int, vec_id long, turn long, x array<double>, cells array<int>, floor double")
        asks = asks.select("bucket", F.lit(1).alias("query"), "vec_id", "turn", "x", F.lit(-1).alias("cell"), "cells", "floor")
        none, least = F.lit(None).cast("array<int>"), F.lit(float("-inf"))
        held = self.entries.select("bucket", F.lit(0).alias("query"), "vec_id", F.lit(0).cast("long").alias("turn"), "x", "cell", none.alias("cells"), least.alias("floor"))
        dealt = asks.unionByName(held).repartition(partitions(self.spark), "bucket").sortWithinPartitions("bucket", "query")
        return dealt.mapInArrow(lambda batches: _nearest(batches, books, k, rest), "query_id long, turn long, vec_id long, score double")

    def floored(self, walked: DataFrame, near: DataFrame, k: int) -> DataFrame:
        floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "turn", F.col("score").alias("floor"))
        return walked.join(floors, ["vec_id", "turn"], "left").select("vec_id", "turn", "x", "cells", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))


def build(vectors: DataFrame, chunk: int = CHUNK) -> Index | None:
    """The index of all usable vectors of the usual length; None for none."""
    base = usable(vectors)
    lengths = base.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows"))
    usual = lengths.agg(F.max(F.struct("rows", "n"))["n"]).first()[0]
    base = base.where(F.size("x") == usual)
    books = None if usual is None else fit(base)
    return None if books is None else Index(base, books, usual, chunk)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "turn").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _first(index: Index, queries: DataFrame, k: int, enough: float) -> tuple[DataFrame, DataFrame]:
    walked = index.walked(queries, enough)
    return walked, written(_ranked(index.best(walked.withColumn("floor", F.lit(float("-inf"))), k, rest=False), k), "ann-near")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, times: int = TIMES, chunk: int = CHUNK, share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query by inner product, ties to the smaller vec_id.

    queries: rows of vectors (null, zero and non-finite ones take no part on either side, nor do vectors of another length
    than most have); vectors with a query's vec_id are no candidates of its. Rows that repeat a query are one query; rows
    with its vec_id and another vector are queries each. Every vector is indexed. Cells lie in buckets of about `chunk` entries, larger cells are cut by a hash, and
    a query is sent once to each bucket with cells that it visits. A bucket gives each query its k best, so that a query
    gets few rows from many vectors. Vectors without structure have no cell that a bound rules out: then all are visited.
    share: None for exact results; else a query visits its nearest cells until they hold that part of all vectors.
    Scores are sums of double products of the original components, the same for equal vectors wherever they lie.
    vec_ids that repeat with different vectors are candidates each.
    """
    index = build(vectors, chunk)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    enough = times * k if share is None else max(times * k, share * int(index.books.counts.sum()))
    walked, near = _first(index, queries, k, enough)
    if share is None:
        rest = index.best(index.floored(walked, near, k), k, rest=True)
        near = _ranked(near.drop("rank").unionByName(rest), k)
    return near.select("query_id", "rank", "vec_id", "score")


def shares(vectors: DataFrame, queries: DataFrame, k: int = 20, times: int = TIMES, chunk: int = CHUNK) -> DataFrame:
    """query_id, walked, read: the parts of all vectors in the cells that the walk visits and that the exact search visits."""
    index, schema = build(vectors, chunk), "query_id long, walked double, read double"
    if index is None:
        return vectors.sparkSession.createDataFrame([], schema)
    books = index.books

    def parts_read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = books.counts.ravel(), books.counts.sum()
        for ids, x, b in _batches(batches):
            lists = [np.asarray(c, int) for c in b["cells"].to_pylist()]
            walks = [counts[c].sum() / n for c in lists]
            reads = [counts[np.union1d(c, books.may_hold(q, f))].sum() / n for c, q, f in zip(lists, x, b["floor"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(walks), pa.array(reads)], ["query_id", "walked", "read"])

    return index.floored(*_first(index, queries, k, times * k), k).mapInArrow(parts_read, schema)


def op6_multi_index(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
