"""Similarity join of n-gram sets by prefix trees, exact for any Jaccard limit.

Sets are ordered by one global order, rare n-grams first. Two linked sets then share an n-gram among the first
n - ceil(limit * n) + 1 of each, so a set is listed under these alone. The sets of a list are stored in a trie from that
n-gram on; those that visit it go down together, an edge is counted once for all sets below it (shared partial
overlaps), and a subtree is left where the overlap so far and what remains of either side can't reach the limit.

How the work stays small without losing a link:
- Equal sets are one class from the start; one document stands for it.
- In any order two linked sets share `l` n-grams among the first n - ceil(limit * n) + l. So a fifth of each set by order of
  hashes is counted first, and sets too few of whose n-grams occur elsewhere go. Only what is left is ordered.
- Lists hold no whole sets, but the beginnings in which two linked sets share `l` n-grams, by half keys. What the tries of
  these connect is one cluster, in which whole sets are compared in a second trie, so a whole set is moved once.
- Lists and clusters are compared in chunks of bounded size, of which a spanning forest of pairs is kept. In long ones the
  first chunk is compared with all others; then, with connected components known, members outside the largest one are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, forget, partitions, release, sliced, table, written
from .neardup import components, shingle_set

PERCENT, WIDTH = 85, 4
#: Members of one chunk of a list, and about how many n-grams these may have together.
CHUNK, CHUNK_KEYS = 256, 1 << 21
#: Visitors of a chunk that go down its trie together, and the n-grams these may have.
PART, PART_KEYS = 256, 1 << 21
#: Bits of the map that tells which documents are left.
PLACES = 1 << 23
#: Bits of an n-gram's hash in a key of the global order; above them stands the class of its frequency (up to 31).
KEY_BITS = 58


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def _needed(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("long")


def _least(n, percent: int):
    """The `l` of a set of n, for ints and columns: a third of what a link may miss of it. It never falls as n grows."""
    slack = n * (100 - percent)
    return (F.floor(slack / 300) if isinstance(n, Column) else slack // 300) + 1


PROFILES = "doc_id long, n long, h1 long, h2 long, low array<long>"


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n (set size), h1 and h2 (fingerprint of the set), low: its first n-grams by hash, as many as must be counted."""

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n, h1, h2, low = [], [], [], []
            for t in bytes_of(b["text"]):
                s = shingle_set(t, width)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                h1.append((d >> 64) - (1 << 63))
                h2.append((d & (1 << 64) - 1) - (1 << 63))
                low.append(s[: len(s) - needed(len(s), percent) + _least(len(s), percent)].view(np.int64))
            ends = np.cumsum([0, *map(len, low)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(low) if low else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], ["doc_id", "n", "h1", "h2", "low"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(profiled, PROFILES)


def _survivors(reps: DataFrame, percent: int) -> DataFrame:
    """doc_id of the sets that may have links: enough of their first n-grams by hash are among those of other sets."""
    entries = reps.select("doc_id", "n", F.explode("low").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("sets")).where("sets > 1").select("value")
    found = entries.join(shared, "value").groupBy("doc_id", "n").agg(F.count("*").alias("shared"))
    return found.where(F.col("shared") >= _least(_needed(F.col("n"), percent), percent)).select("doc_id").distinct()


def _sets(docs: DataFrame, some: DataFrame, width: int) -> DataFrame:
    """doc_id and set (see full_sets) of the documents in `some`, and of a few others whose ids fall on the same bits.

    A map of PLACES bits, of one size for any corpus, tells them, so that no text is shuffled; who comes along with them does
    no harm. Where the ids are too many for it, all sets come along.
    """
    spark = docs.sparkSession
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES)) + 1
    marks = some.select(F.bitmap_bucket_number(place("doc_id")).alias("part"), F.bitmap_bit_position(place("doc_id")).alias("bit"))
    found = marks.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # 4 kB each, PLACES / 8 bytes in all
    bits = spark.sparkContext.broadcast({r["part"]: bytes(r["bits"]) for r in found})

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids, sets = [], []
            for doc_id, text, part, bit in zip(b["doc_id"].to_pylist(), bytes_of(b["text"]), b["part"].to_pylist(), b["bit"].to_pylist()):
                if part in bits.value and bits.value[part][bit >> 3] >> (bit & 7) & 1:
                    ids.append(doc_id)
                    sets.append(shingle_set(text, width).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "set"])

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.withColumns({"part": F.bitmap_bucket_number(place("doc_id")), "bit": F.bitmap_bit_position(place("doc_id"))}).mapInArrow(computed, "doc_id long, set binary")


def _exploded(sets: DataFrame) -> DataFrame:
    """row and value of each n-gram of each set."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, rows = bytes_of(b["set"]), b["row"].to_numpy(zero_copy_only=False)
            at = 0
            while at < len(raw):
                stop, size = at, 0
                while stop < len(raw) and (stop == at or size + len(raw[stop]) <= 8 << 20):
                    size += len(raw[stop])
                    stop += 1
                values = np.frombuffer(b"".join(raw[at:stop]), np.int64)
                owner = np.repeat(rows[at:stop], [len(x) // 8 for x in raw[at:stop]])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(values)], ["row", "value"])
                at = stop

    return sets.select("row", "set").mapInArrow(out, "row long, value long")


def ordered_sets(sets: DataFrame, percent: int) -> DataFrame:
    """row, rep, n, keys (n-grams that other sets hold too, in the global order), listed: how many of them begin a list.

    A key is the class of an n-gram's frequency (two classes to each doubling) above 58 bits of its hash. N-grams of one set
    alone come first of all and are left out, but use up the places under which a set is listed.
    """
    entries = _exploded(sets)
    shared = entries.groupBy("value").agg(F.count("*").alias("sets")).where("sets > 1")
    rank = F.least(F.lit(31), F.floor(2 * F.log2("sets"))).cast("long")
    key = F.shiftleft(rank, KEY_BITS).bitwiseOR(F.shiftrightunsigned(F.col("value"), 64 - KEY_BITS))
    keys = entries.join(shared.select("value", key.alias("key")), "value").groupBy("row").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    listed = F.col("n") - _needed(F.col("n"), percent) + 1 - (F.col("n") - F.size("keys"))
    out = keys.join(sets.select("row", F.col("doc_id").alias("rep"), F.floor(F.octet_length("set") / 8).alias("n")), "row")
    return out.select("row", "rep", "n", "keys", listed.cast("int").alias("listed")).where("listed > 0")


class Trie:
    """Ascending arrays of keys in a path-compressed trie, each with the size of its whole set."""

    def __init__(self, arrays: list[np.ndarray], sizes: np.ndarray):
        by_bytes = [x.astype(">i8").tobytes() for x in arrays]
        self.order = sorted(range(len(arrays)), key=by_bytes.__getitem__)
        self.arrays, self.sizes = [arrays[i] for i in self.order], sizes[self.order]
        self.lengths = np.asarray([len(x) for x in self.arrays], np.int64)
        self.shared = np.zeros(len(arrays), np.int64)  # keys that an array and the one before it begin with
        for i in range(1, len(arrays)):
            a, b = self.arrays[i - 1], self.arrays[i]
            k = min(len(a), len(b))
            differ = a[:k] != b[:k]
            self.shared[i] = int(differ.argmax()) if differ.any() else k
        #: (first and last array below, depth above, depth of its end) of each node, parents first; children by node
        self.nodes: list[tuple[int, int, int, int]] = []
        self.children: list[list[int]] = []
        waiting = [(0, len(arrays), 0, -1)] if arrays else []
        while waiting:
            lo, hi, depth, parent = waiting.pop()
            end = int(self.shared[lo + 1 : hi].min()) if hi - lo > 1 else int(self.lengths[lo])
            if parent >= 0:
                self.children[parent].append(len(self.nodes))
            at = len(self.nodes)
            self.nodes.append((lo, hi, depth, end))
            self.children.append([])
            if hi - lo > 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(self.shared[lo + 1 : hi] == end)).tolist(), hi]
                waiting += [(x, y, end, at) for x, y in zip(cuts, cuts[1:])]

    def search(self, asks: list[np.ndarray], ask_sizes: np.ndarray, need: Callable[[np.ndarray, int], np.ndarray]) -> Iterator[tuple[int, int]]:
        """(ask, array) of each pair that has as many keys in common as it needs, given the asks' sizes and the least below."""
        if not self.arrays or not asks:
            return
        owner = np.repeat(np.arange(len(asks)), [len(x) for x in asks])
        values = np.concatenate(asks)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        lasts = np.asarray([self.arrays[lo][end - 1] if end else -1 for lo, _, _, end in self.nodes])
        left = np.stack([len(x) - np.searchsorted(x, lasts, side="right") for x in asks], 1)  # node, ask: keys after the node's end
        waiting = [(0, np.zeros(len(asks), np.int64), np.ones(len(asks), bool))]
        while waiting:
            at, overlap, active = waiting.pop()
            lo, hi, depth, end = self.nodes[at]
            if end > depth:
                edge = self.arrays[lo][depth:end]
                start, stop = np.searchsorted(values, edge), np.searchsorted(values, edge, side="right")
                m = stop - start
                if (total := int(m.sum())) > 0:
                    hits = owner[np.repeat(start - np.cumsum(m) + m, m) + np.arange(total)]
                    overlap = overlap + np.bincount(hits, minlength=len(asks))
            remaining = np.minimum(left[at], int(self.lengths[lo:hi].max()) - end)
            active = active & (overlap + remaining >= need(ask_sizes, int(self.sizes[lo:hi].min())))
            if not active.any():
                continue
            if hi - lo == 1:
                for q in np.flatnonzero(active).tolist():
                    yield q, self.order[lo]
                continue
            waiting += [(child, overlap, active) for child in self.children[at]]


def _lists(ordered: DataFrame) -> DataFrame:
    """row, rep, n, at, key: a row for each list of a set that others are in too; at: the key's place in the set."""
    lists = ordered.select("row", "rep", "n", F.posexplode(F.slice("keys", F.lit(1), F.col("listed"))).alias("at", "key"))
    return lists.join(lists.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key"), "key")


def _visits(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """key, chunk, asks, row, rep, comp, n, at: the members of each chunk of each list, and those who visit it.

    Without roots the members of a list's first chunk visit all its chunks, so that lists of one chunk are compared whole.
    With roots only lists of several chunks and components are left, and members outside the largest component visit all chunks.
    """
    if roots is None:
        lists = lists.withColumn("comp", F.col("rep"))
        sizes = lists.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.lit(None).cast("long").alias("largest")).where("members > 1")
    else:
        lists = lists.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
        of = lists.groupBy("key", "comp").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
        sizes = of.groupBy("key").agg(F.max(F.struct("members", "comp"))["comp"].alias("largest"), F.sum("members").alias("members"), F.sum("total").alias("total"), F.count("*").alias("comps")).where("comps > 1")
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("total") / CHUNK_KEYS)).cast("int")
    sizes = sizes.select("key", "largest", chunks.alias("chunks"))
    some = lists.join(sizes if roots is None else sizes.where("chunks > 1"), "key").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    visits = (F.col("chunk") == 0) if roots is None else (F.col("comp") != F.col("largest"))
    # asks: 0 a member, 1 a visitor, 2 both
    here = F.array(F.struct("chunk", F.when(visits, 2).otherwise(0).alias("asks")))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("chunk"))
    there = F.when(visits, F.transform(others, lambda c: F.struct(c.alias("chunk"), F.lit(1).alias("asks")))).otherwise(F.array().cast("array<struct<chunk:int,asks:int>>"))
    some = some.select("key", "row", "rep", "comp", "n", "at", F.explode(F.concat(here, there)).alias("place"))
    return some.select("key", "place.chunk", "place.asks", "row", "rep", "comp", "n", "at")


def _pairs(need: Callable[[np.ndarray, int], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Iterator[tuple[tuple, tuple]]]]:
    """A function over sorted batches of visits: for each chunk the pairs found, as a visitor's and a member's (rep, comp, n)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            lists = b["keys"]
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy(zero_copy_only=False)]))
            arrays = [values[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield from zip(*(b[c].to_pylist() for c in ("key", "chunk", "asks", "rep", "comp", "n")), arrays)

    def pairs(group: Iterator[tuple]) -> Iterator[tuple[tuple, tuple]]:
        held, asks = [], []
        size, trie = 0, None

        def search() -> Iterator[tuple[tuple, tuple]]:
            nonlocal trie
            if trie is None:  # members come before visitors
                trie = Trie([r[6] for r in held], np.asarray([r[5] for r in held], np.int64))
            for i, j in trie.search([r[6] for r in asks], np.asarray([r[5] for r in asks], np.int64), need):
                yield asks[i][3:6], held[j][3:6]

        for r in group:
            if r[2] != 1:
                held.append(r)
            if r[2] and held:
                asks.append(r)
                size += len(r[6])
            if r[2] == 1 and (len(asks) >= PART or size > PART_KEYS):
                yield from search()
                asks, size = [], 0
        if asks:
            yield from search()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[tuple, tuple]]]:
        for _, group in groupby(read(batches), lambda r: r[:2]):
            yield pairs(group)

    return chunks


def _forest(visits: DataFrame, arrays: DataFrame, need: Callable, percent: int) -> DataFrame:
    """a, b: pairs of each chunk that have what they need in common; of those that join what is joined already none.

    arrays: row and keys, from which a visit's keys follow after its place `at`; they join last, so they are moved once.
    """
    chunks = _pairs(need)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in chunks(batches):
            label: dict[int, int] = {}
            a, b = [], []

            def root(x: int) -> int:
                while label.setdefault(x, x) != x:
                    label[x] = label[label[x]]
                    x = label[x]
                return x

            for (rep, comp, n), (its_rep, its_comp, its_n) in pairs:
                u, v = root(comp), root(its_comp)
                if u != v and 100 * min(n, its_n) >= percent * max(n, its_n):
                    label[max(u, v)] = min(u, v)
                    a.append(rep)
                    b.append(its_rep)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    full = visits.join(arrays, "row").select("key", "chunk", "asks", "rep", "comp", "n", F.slice("keys", F.col("at") + 2, F.size("keys")).alias("keys"))
    # those who only visit come last
    dealt = full.repartition(partitions(full.sparkSession), "key", "chunk").sortWithinPartitions("key", "chunk", F.col("asks") == 1)
    return dealt.mapInArrow(linked, "a long, b long")


def _joined(lists: DataFrame, arrays: DataFrame, need: Callable, percent: int) -> DataFrame:
    """node, root of what the pairs in lists connect."""
    links = written(_forest(_visits(lists, None), arrays, need, percent), "links")
    roots = components(links)
    more = written(_forest(_visits(lists, roots), arrays, need, percent), "links")
    return roots if more.isEmpty() else components(links.unionByName(more))


def similarity_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of each document; links are pairs of sets with a similarity of percent or more.

    A set holds the distinct shingles of `width` words (A-Z lower-cased); of fewer words, the whole sequence as one.
    component_id is the smallest doc_id reachable by links, itself included. Null and empty texts have no shingles and are
    linked with nothing. A null doc_id takes no part: its component_id is null. Rows that repeat a doc_id are documents
    each; where their texts are linked with others, they count as one document with several texts. An empty table gives an
    empty one. No link is missed; shingles are told apart by 58 bits of their hashes.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"the similarity must be 50 to 100 %, not {percent}")
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    profile = written(profiles(docs, width, percent), "profiles")
    classes = written(profile.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = profile.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "h1", "h2", "n"], "left_semi")
    some = written(_survivors(reps, percent), "survivors")
    found = written(profile.drop("low"), "found")
    forget(profile)
    release(spark)
    sets = written(_sets(docs, some, width).where("octet_length(set) > 0").withColumn("row", F.monotonically_increasing_id()), "sets")
    ordered = written(ordered_sets(sets, percent), "ordered")
    forget(sets)
    release(spark)

    def some_common(sizes: np.ndarray, least: int) -> np.ndarray:
        return np.minimum(_least(sizes, percent), _least(least, percent)) - 1  # the list's key is common

    def enough_common(sizes: np.ndarray, least: int) -> np.ndarray:
        return -(-percent * (sizes + least) // (100 + percent))

    beginning = F.slice("keys", F.lit(1), (F.col("listed") + _least(F.col("n"), percent) - 1).cast("int"))
    upper = ordered.select("row", F.transform(beginning, lambda k: F.shiftright(k, 32).cast("int")).alias("keys"))
    near = _joined(written(_lists(ordered), "lists"), upper, some_common, percent)
    near = written(near.unionByName(near.select(F.col("root").alias("node"), "root")).distinct().withColumnsRenamed({"node": "rep", "root": "key"}), "near")
    release(spark)
    together = ordered.select("row", "rep", "n", F.lit(-1).alias("at")).join(near, "rep")
    roots = _joined(together, ordered.select("row", "keys"), enough_common, percent)
    of_class = classes.join(roots, classes["rep"] == roots["node"], "left").select("h1", "h2", "n", F.coalesce("root", "rep").alias("component"))
    out = found.select("doc_id", "n", "h1", "h2").join(of_class, ["h1", "h2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op11_prefix_tree_join(spark, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))
