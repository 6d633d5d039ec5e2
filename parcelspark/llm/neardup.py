"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is its set of hashed word shingles; its sketch is the k smallest hashes. Inverted lists of retained values
give pairs that overlap, the sketch of a pair's union estimates its Jaccard similarity, and full sets confirm it.

How the lists stay small without losing a link: two linked sets share at least `common` of their `listed` smallest
hashes (see limits()), so with values in order of rarity it is enough to list each document under all but the last
common - 1 of the values that it doesn't have alone. Values of passages that many documents share come last, so
only documents that consist of them are listed there. Equal sets are one class from the start.

Lists are compared in chunks of bounded size. Sketches come first; only members with a candidate bring their full
sets, in one chunk for each pair, and a chunk gives a spanning forest of its links. In long lists the first chunk is
compared with all others; then, with connected components known, only members outside a list's largest component are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, forget, lower_words, mixed, partitions, sliced, table, word_hashes, written

#: Hashes of a sketch; the least number of them that are listed.
SKETCH, LISTED = 32, 16
#: Each of the two tests on sketches misses a link at the limit with no more than this chance.
MISS = 2e-7
#: Members of one chunk of a list, and about how many shingles these may have together.
CHUNK, CHUNK_SHINGLES = 256, 1 << 22
#: Rows of a chunk's visitors that are compared at once, and the bytes of their full sets.
PART, PART_BYTES = 256, 16 << 20
PERCENT, WIDTH = 85, 5
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; of the whole sequence if it is shorter; none without words."""
    h = word_hashes(lower_words(text))
    n = len(h)
    if not n:
        return h
    if n < width:
        out = np.uint64(n)
        with np.errstate(over="ignore"):
            for x in h:
                out = out * _MULT + x
        return mixed(np.asarray([out], np.uint64))
    s = h[: n - width + 1].copy()
    for i in range(1, width):
        s *= _MULT
        s += h[i : n - width + 1 + i]
    s = mixed(s)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def least_common(size: int, percent: int) -> int:
    """How many values are common among the `size` smallest of two linked sets' union, but for a chance of MISS.

    Each of them is common with a chance of percent at the limit, so their number is binomial at worst. The two sets'
    own smallest share as many if one set lies in the other, else more. For 85 %: 5 of 16 are missed with a chance of
    1.3e-7, 15 of 32 with 8.2e-8; for 80 %: 6 of 20 with 1.8e-7, 13 of 32 with 1.9e-7.
    """
    p, missed, n = percent / 100, 0.0, 0
    while n < size and (missed := missed + comb(size, n) * p**n * (1 - p) ** (size - n)) <= MISS:
        n += 1
    return n


def limits(percent: int) -> tuple[int, int, int]:
    """How many of a sketch's values are listed, how many of these two linked sets share at least, and how many of all.

    As many are listed as it takes for three tenths of them to be shared, so that passages of many documents stay at
    the end of the order of rarity: 16 at 85 %, 20 at 80 %.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"a similarity is over 0 and up to 100 %, not {percent}")
    for size in range(LISTED, SKETCH + 1):
        common = least_common(size, percent)
        if 10 * common >= 3 * size:
            return size, common, least_common(SKETCH, percent)
    raise ValueError(f"sketches of {SKETCH} values don't bear a similarity of {percent} %")


SKETCHES = "doc_id long, n long, h1 long, h2 long, low array<long>"


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (set size), h1 and h2 (fingerprint of the set), low (its sketch: the SKETCH smallest hashes)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n, h1, h2, low, ends = [], [], [], [], [0]
            for t in bytes_of(b["text"]):
                s = shingle_set(t, width)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                h1.append((d >> 64) - (1 << 63))
                h2.append((d & (1 << 64) - 1) - (1 << 63))
                low.append(s[:SKETCH].view(np.int64))
                ends.append(ends[-1] + len(low[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(low) if low else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], ["doc_id", "n", "h1", "h2", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketched, SKETCHES)


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and set: the sorted hashes as little-endian unsigned 64-bit integers."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([shingle_set(t, width).tobytes() for t in bytes_of(b["text"])], pa.binary())], ["doc_id", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(computed, "doc_id long, set binary")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes with a link, but roots themselves.

    Large-star and small-star steps in turn (Kiveris et al. 2014) until nothing changes; each step is written, so
    that lost executors cost no earlier step.
    """
    e = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == sign or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e, before = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars"), e
        forget(before)


def _listed(reps: DataFrame, percent: int) -> DataFrame:
    """rep, n, prefix: the rarest values of a representative under which it is listed; only where there are any."""
    size, least, _ = limits(percent)
    common = F.least(F.lit(least), F.ceil(F.col("n") * percent / 100)).cast("int")
    entries = reps.select("rep", "n", F.explode(F.slice("low", 1, size)).alias("value"))
    counts = entries.groupBy("value").agg(F.count("*").alias("docs")).where("docs > 1")
    held = entries.join(counts, "value").groupBy("rep", "n").agg(F.sort_array(F.array_distinct(F.collect_list(F.struct("docs", "value")))).alias("values"))
    held = held.withColumn("size", F.size("values") - common + 1).where("size > 0")
    return held.select("rep", "n", F.slice("values", F.lit(1), F.col("size"))["value"].alias("prefix"))


def _overlaps(held: list[np.ndarray], asks: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values, asks x held, by an inverted list of the held values."""
    owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
    values = np.concatenate(held)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = np.empty((len(asks), len(held)), np.int64)
    for i, x in enumerate(asks):
        start, stop = np.searchsorted(values, x), np.searchsorted(values, x, side="right")
        m = stop - start
        at = np.repeat(start - np.cumsum(m) + m, m) + np.arange(m.sum())
        out[i] = np.bincount(owner[at], minlength=len(held))
    return out


#: Fills up sketches of fewer values.
_NONE = np.uint64((1 << 64) - 1)


def union_estimate(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sketches (a row each, unsigned, filled up with _NONE): the size of the union's sketch, which is the
    SKETCH smallest values of both, and how many of these are common. Their ratio estimates the pairs' similarity; with
    fewer than SKETCH values it is the similarity."""
    z = np.sort(np.hstack([one, two]), axis=1)
    rank = np.hstack([np.ones((len(z), 1), np.int64), 1 + np.cumsum(z[:, 1:] != z[:, :-1], axis=1)])
    real = (z != _NONE) & (rank <= SKETCH)
    return (rank * real).max(1, initial=0), (real[:, 1:] & (z[:, 1:] == z[:, :-1])).sum(1)


def _filled(sketches: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(sketches), SKETCH), _NONE)
    for row, x in zip(out, sketches):
        row[: len(x)] = x.view(np.uint64)
    return out


def _lists(listed: DataFrame, reps: DataFrame, roots: DataFrame | None) -> DataFrame:
    """value, chunk, asks, rep, comp, n, low, earlier: the members of each chunk of each list, and those who visit it.

    Without roots the members of a list's first chunk visit all its chunks, so that lists of one chunk are compared
    whole. With roots only lists of several chunks and components are left, and all members outside the largest
    component visit all chunks. earlier: the values before this one under which the member is listed.
    """
    lists = listed.select("rep", "n", "prefix", F.posexplode("prefix").alias("at", "value")).select("rep", "n", "value", F.slice("prefix", F.lit(1), F.col("at")).alias("earlier"))
    if roots is None:
        sizes = lists.groupBy("value").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1").withColumn("largest", F.lit(None).cast("long"))
        lists = lists.withColumn("comp", F.col("rep"))
    else:
        lists = lists.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
        of = lists.groupBy("value", "comp").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
        sizes = of.groupBy("value").agg(F.max(F.struct("members", "comp"))["comp"].alias("largest"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"), F.count("*").alias("comps")).where("comps > 1")
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    sizes = sizes.select("value", "largest", chunks.alias("chunks"))
    some = lists.join(sizes if roots is None else sizes.where("chunks > 1"), "value")
    some = some.join(reps.select("rep", "low"), "rep").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    columns = ("rep", "comp", "n", "low", "earlier")
    visits = (F.col("chunk") == 0) if roots is None else (F.col("comp") != F.col("largest"))
    asking = some.where(visits).select("value", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("asks"), *columns)
    return some.select("value", "chunk", F.lit(0).alias("asks"), *columns).unionByName(asking)


def _chunks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list, Iterator[list]]]:
    """(value, chunk), its members, and batches of those who ask. Members come first in a chunk."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(b["value"].to_pylist(), b["chunk"].to_pylist(), b["asks"].to_pylist(), *(b[c].to_pylist() for c in columns))

    for key, group in groupby(rows(), lambda r: r[:2]):
        held: list[tuple] = []

        def asking(group=group, held=held):
            part, size = [], 0
            for r in group:
                if not r[2]:
                    held.append(r[3:])
                    continue
                part.append(r[3:])
                size += len(r[-1])  # bytes of a full set
                if len(part) == PART or size > PART_BYTES:
                    yield part
                    part, size = [], 0
            if part:
                yield part

        yield key, held, asking()


def _candidates(lists: DataFrame, percent: int) -> DataFrame:
    """value, chunk, asks, rep: who has a candidate in a chunk. Candidates have near sizes, an estimate over the union's
    sketch that doesn't rule a link out, different components, and no earlier list in common."""
    _, _, least = limits(percent)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (value, chunk), held, asking in _chunks(batches, ("rep", "comp", "n", "low", "earlier")):
            hit_held: set[int] = set()
            hit_asks: set[int] = set()
            for part in asking:
                if not held:
                    continue
                rep, comp, n = (np.asarray([r[i] for r in held], np.int64) for i in range(3))
                q_rep, q_comp, q_n = (np.asarray([r[i] for r in part], np.int64)[:, None] for i in range(3))
                ok = (100 * np.minimum(q_n, n) >= percent * np.maximum(q_n, n)) & (q_comp != comp)
                rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
                if not len(rows):
                    continue
                sub = np.ix_(rows, cols)
                arrays = lambda side, at, i: [np.asarray(side[k][i], np.int64) for k in at]
                low, q_low = arrays(held, cols, 3), arrays(part, rows, 3)
                smaller = np.minimum(q_n, n)[sub]
                # two sketches share no fewer values than the union's sketch has common ones: a cheap bound first
                good = ok[sub] & (_overlaps(low, q_low) >= np.minimum(least, -(-smaller * percent // 100)))
                good &= _overlaps(arrays(held, cols, 4), arrays(part, rows, 4)) == 0
                i, j = np.nonzero(good)
                one, two = _filled(q_low), _filled(low)
                for at in range(0, len(i), 8192):
                    x, y = i[at : at + 8192], j[at : at + 8192]
                    size, common = union_estimate(one[x], two[y])
                    good[x, y] = common >= np.where(size < SKETCH, -(-size * percent // 100), least)
                hit_asks.update(q_rep[rows[good.any(1)], 0].tolist())
                hit_held.update(rep[cols[good.any(0)]].tolist())
            reps = [*hit_held, *hit_asks]
            if reps:
                k = len(reps)
                columns = [pa.array([value] * k, pa.int64()), pa.array([chunk] * k, pa.int32()), pa.array([0] * len(hit_held) + [1] * len(hit_asks), pa.int32()), pa.array(reps, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["value", "chunk", "asks", "rep"])

    dealt = lists.repartition(partitions(lists.sparkSession), "value", "chunk").sortWithinPartitions("value", "chunk", "asks")
    return dealt.select("value", "chunk", "asks", "rep", "comp", "n", "low", "earlier").mapInArrow(found, "value long, chunk int, asks int, rep long")


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links among the members of each chunk, confirmed on full sets; of those that join what is joined already none."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, asking in _chunks(batches, ("rep", "set")):
            label: dict[int, int] = {}
            a, b = [], []

            def root(x: int) -> int:
                while label.setdefault(x, x) != x:
                    label[x] = label[label[x]]
                    x = label[x]
                return x

            for part in asking:
                if not held:
                    continue
                mine, others = ([np.frombuffer(r[1], np.uint64) for r in side] for side in (part, held))
                common = _overlaps(others, mine)
                n, q = np.asarray([len(x) for x in others]), np.asarray([len(x) for x in mine])[:, None]
                i, j = np.nonzero(100 * common >= percent * (n + q - common))
                for x, y in zip(i.tolist(), j.tolist()):
                    r, s = part[x][0], held[y][0]
                    u, v = root(r), root(s)
                    if u != v:
                        label[max(u, v)] = min(u, v)
                        a.append(r)
                        b.append(s)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    full = members.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    dealt = full.repartition(partitions(members.sparkSession), "value", "chunk").sortWithinPartitions("value", "chunk", "asks")
    return dealt.select("value", "chunk", "asks", "rep", "set").mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document, for a similarity of percent or more (see limits()).

    component_id is the smallest doc_id reachable over links, kept whether it is the document's own. Null and empty
    texts have no shingles and are linked with nothing. A null doc_id takes no part: its component_id is null and
    kept true. Rows that repeat a doc_id are documents each; where their texts are linked with others, they count as
    one document with several texts.
    """
    docs = docs.select("doc_id", "text")
    sk = written(sketches(docs, width), "sketches")
    classes = written(sk.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    own = classes.withColumnRenamed("rep", "doc_id")
    reps = written(sk.join(own, ["doc_id", "h1", "h2", "n"], "left_semi").select(F.col("doc_id").alias("rep"), "n", "low"), "representatives")
    listed = written(_listed(reps, percent), "listed")
    # the listed ids grow with the corpus: no broadcast at any size
    full = docs.join(listed.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = written(full_sets(full, width), "sets")
    links = written(_links(_candidates(_lists(listed, reps, None), percent), sets, percent), "links")
    roots = components(links)
    # what is left: members of long lists outside the component of most
    rest = written(_candidates(_lists(listed, reps, roots), percent), "candidates")
    if not rest.isEmpty():
        links = written(links.unionByName(_links(rest, sets, percent)), "links")
        roots = components(links)
    of_class = classes.join(roots, classes["rep"] == roots["node"], "left").select("h1", "h2", "n", F.coalesce("root", "rep").alias("component"))
    d = sk.select("doc_id", "n", "h1", "h2").join(of_class, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    d = d.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return d.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents with one of each group of near copies left, that with the smallest doc_id."""
    keep = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def op3_bottom_k_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
