"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, its documents in a fixed order, are packed into blocks of fixed length. Output shards of SHARD
slots each draw how many slots they give to each source: a multinomial draw over the sources, weighed by what each needs
for its target. A source's slots are numbered through the shards; slot j holds the block that a pseudorandom permutation
of the source's block indices gives for j, and blocks are joined by index. Where a source's draws add up to more slots
than it needs, the last ones give back the rest; where they add up to fewer, a closing shard holds what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, partitions, table, written

#: Words in a block, documents in a bucket of a source, slots in an output shard, slots in a range that one task fills.
BLOCK, BUCKET, SHARD, RANGE = 512, 1 << 11, 1 << 13, 1 << 13
#: The fewest cells that all slots are cut into for draws.
CELLS = 1 << 16
WEIGHTS = (5, 2, 1)
SPACES = " \t\n\x0b\x0c\r"
SHARE, MOST = 1.5, 2


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number quotient of non-negative longs below 2**53."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - a % b) / b).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, src (source as a key that is never null), size (words; 0 for a null text), key (a row hash)."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    src = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    return docs.select("doc_id", "source", src.alias("src"), words.alias("size"), F.xxhash64("doc_id", "text", "source").alias("key"))


def source_targets(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, src, source_size, docs, target: weights by code-point order of sources (null last) share `share` of all sizes.

    Targets stop at `most` times their source's size; the excess is shared again by weight until none is above. In
    closed form: with sources by cap / weight, those before the first whose even share lies within its cap are
    capped, and the others get that share times their weight. The windows see one row for each source.
    """
    per = sizes.groupBy("source", "src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    w = per.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "src")
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    w = w.withColumn("level", (share * F.sum("source_size").over(Window.partitionBy()) - capped) / left)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(Window.partitionBy())
    w = w.withColumn("final", F.coalesce(first["level"], F.lit(float("inf"))))
    return w.select("source", "src", "source_size", "docs", F.least("cap", F.col("weight") * F.col("final")).alias("target"))


def _permuted(j: Column, n: Column, salt: Column, rounds: int = 4, walks: int = 32) -> Column:
    """A bijection of 0..n-1: an alternating Feistel network on a grid a x b, a = ceil(sqrt(n)), b = ceil(n / a),
    walked on while it leaves 0..n-1. Fewer than a cells of the grid lie outside, so for n to 1024 no walk has over
    32 steps, and for larger n one has over 32 with a chance below 32**-32."""

    def step(x: Column, a: Column, b: Column) -> Column:
        left, right = _div(x, b), x % b
        for r in range(0, rounds, 2):
            left = F.pmod(left + F.pmod(F.xxhash64(salt, F.lit(r), right), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(salt, F.lit(r + 1), left), b), b)
        return left * b + right

    def walk(g: Column) -> Column:
        inside = lambda x: (x >= 0) & (x < n)
        return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), F.lit(-1).cast("long"), lambda x, _: F.when(inside(x), x).otherwise(step(F.when(x < 0, j).otherwise(x), g["a"], g["b"])))

    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n.cast("double") / F.ceil(F.sqrt(n.cast("double")))).cast("long")
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), walk)[0]  # a and b are bound once


def placed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes with start, the number of words before the document in its source.

    Documents of a source are dealt by hash to buckets of about BUCKET documents, whose sums are added up first, so
    that no task has a whole source. Within a bucket the order is (key, doc_id).
    """
    d = sizes.join(targets.select("src", F.greatest(_div(F.col("docs"), BUCKET), F.lit(1)).alias("buckets")), "src")
    d = d.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.col("buckets"))).drop("buckets")
    sums = d.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select("src", "bucket", (F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return d.withColumn("inside", inside).join(before, ["src", "bucket"]).select("doc_id", "source", "src", "size", "key", (F.col("before") + F.col("inside")).alias("start"))


def needs(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """src, want (rounded target), blocks, short (words that the last block lacks), n (slots), all (slots of all): for sources with words.

    A source has as many slots as its target needs, at most one for each block and pass.
    """
    t = targets.where("source_size > 0").select("src", "source_size", F.round("target").cast("long").alias("want"))
    t = t.withColumn("blocks", _div(F.col("source_size") + (block - 1), block))
    t = t.withColumn("short", F.col("blocks") * block - F.col("source_size"))
    n = F.least(MOST * F.col("blocks"), _div(F.col("want") + MOST * F.col("short") + (block - 1), block))
    return t.withColumn("n", n).where("n > 0").drop("source_size").withColumn("all", F.sum("n").over(Window.partitionBy()))


def draws(need: DataFrame, parts: int, shard_slots: int = SHARD, seed: int = 17) -> DataFrame:
    """shard, src, drawn: the multinomial counts of each output shard, none of them 0.

    There are as many shards as all slots fill; each has shard_slots draws, the last one the rest. A draw picks one of all
    needed slots by a hash of the draw's number, and so a source with a chance of its share of them. The sources, one after
    another, are cut into cells of equally many slots, with at least as many cells as sources, and draws meet the sources
    of their own cell. All together, whatever the sources' sizes, that is at most three pairs a draw on average, and hot
    sources spread over their cells. Spark broadcasts the cells while they are small; counts are combined before they are
    shuffled.
    """
    order = Window.orderBy("src")  # one row for each source
    n = need.withColumn("high", F.sum("n").over(order)).withColumn("low", F.col("high") - F.col("n"))
    cells = F.greatest(F.count("*").over(Window.partitionBy()), F.lit(CELLS))
    n = n.withColumn("cell_slots", _div(F.col("all") + cells - 1, cells))
    spans = n.select("src", "low", "high", F.explode(F.sequence(_div(F.col("low"), F.col("cell_slots")), _div(F.col("high") - 1, F.col("cell_slots")))).alias("cell"))
    one = n.agg(F.max("all").alias("all"), F.max("cell_slots").alias("cell_slots")).where("all > 0")
    shards = one.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("all") - 1, shard_slots)))).repartition(parts, "shard")
    first = F.col("shard") * shard_slots
    draw = shards.select("all", "cell_slots", "shard", F.explode(F.sequence(first, F.least(first + shard_slots, F.col("all")) - 1)).alias("draw"))
    draw = draw.select("shard", "cell_slots", F.pmod(F.xxhash64("draw", F.lit(seed + 1)), F.col("all")).alias("ticket"))
    draw = draw.select("shard", "ticket", _div(F.col("ticket"), F.col("cell_slots")).alias("cell"))
    hit = draw.join(spans, "cell").where("low <= ticket and ticket < high")
    return hit.groupBy("shard", "src").agg(F.count("*").alias("drawn"))


def dealt(need: DataFrame, drawn: DataFrame, shard_slots: int = SHARD) -> DataFrame:
    """src, shard, first, count: the source's slots first .. first + count - 1 lie in the shard.

    Slots are numbered by shard; those beyond the source's need go, missing ones lie in a closing shard after all others.
    """
    order = Window.partitionBy("src").orderBy("shard")
    d = drawn.join(need.select("src", "n"), "src").withColumn("first", F.sum("drawn").over(order) - F.col("drawn"))
    inside = d.select("src", "shard", "first", F.least("drawn", F.col("n") - F.col("first")).alias("count")).where("count > 0")
    sums = drawn.groupBy("src").agg(F.sum("drawn").alias("first"))
    closing = need.join(sums, "src", "left").withColumn("first", F.coalesce("first", F.lit(0))).where("first < n")
    closing = closing.select("src", (_div(F.col("all") - 1, shard_slots) + 1).alias("shard"), "first", (F.col("n") - F.col("first")).alias("count"))
    return inside.unionByName(closing)


def slots(targets: DataFrame, parts: int, block: int = BLOCK, shard_slots: int = SHARD, seed: int = 17) -> DataFrame:
    """src, slot, pass, block, used (words taken of the block, from its first), shard.

    A source's last slot is cut so that the used words add up to the rounded target.
    """
    need = needs(targets, block)
    ranges = dealt(need, written(draws(need, parts, shard_slots, seed), "mix-draws"), shard_slots)
    ranges = ranges.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("count") - 1, RANGE))))
    ranges = ranges.select("src", "shard", (F.col("first") + F.col("part") * RANGE).alias("low"), F.least(F.col("count") - F.col("part") * RANGE, F.lit(RANGE)).alias("count"))
    s = ranges.repartition(parts, "src", "low").select("src", "shard", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("count") - 1)).alias("slot"))
    s = s.join(need, "src").withColumn("pass", _div(F.col("slot"), F.col("blocks")).cast("int"))
    s = s.withColumn("block", _permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64("src", "pass", F.lit(seed))))
    # a source's last block is short: its slots, one a pass, move those after them
    tails = s.where("block = blocks - 1").groupBy("src").agg(F.sort_array(F.collect_list("slot")).alias("tails"))
    s = s.join(tails, "src", "left")
    passed = F.coalesce(F.size(F.filter("tails", lambda x: x < F.col("slot"))), F.lit(0))
    before = F.col("slot") * block - F.col("short") * F.when(F.col("tails").isNull(), 0).otherwise(passed)
    full = block - F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(0)
    used = F.least(full, F.greatest(F.col("want") - before, F.lit(0)))
    return s.select("src", "slot", "pass", "block", used.cast("long").alias("used"), "shard")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 17, shard_slots: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The documents, placed, with their source's size and target; and the pieces of them that the mix takes.

    Pieces: src, start (together they name a placed document), shard, slot, pass (a block is taken at most once in
    each of the two passes, so no document exceeds twice its size), at (first word within the document), words.
    Null texts have size 0 and no piece; a null source is a source; rows that repeat a doc_id are documents each.
    """
    sizes = written(sized(docs), "mix-sizes")
    targets = written(source_targets(sizes), "mix-targets")
    where = written(placed(sizes, targets), "mix-placed")
    spans = where.where("size > 0").select("src", "start", "size", F.explode(F.sequence(_div(F.col("start"), block), _div(F.col("start") + F.col("size") - 1, block))).alias("block"))
    low, high = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    spans = spans.withColumn("low", low).withColumn("high", high)
    drawn = slots(targets, partitions(docs.sparkSession), block, shard_slots, seed)
    # both sides grow with the corpus; Spark would take the slots, generated from a few rows, for small and broadcast them
    pieces = spans.join(drawn.hint("merge"), ["src", "block"]).withColumn("words", F.least("high", "used") - F.col("low")).where("words > 0")
    pieces = pieces.select("src", "start", "shard", "slot", "pass", (F.col("block") * block + F.col("low") - F.col("start")).alias("at"), "words")
    return where.join(targets.select("src", "source_size", "target"), "src"), pieces


def taken(docs: DataFrame, block: int = BLOCK, seed: int = 17, shard_slots: int = SHARD) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard of each document: the words that the mix takes of it, and the
    first output shard that has any of them (null: none)."""
    where, pieces = mix(docs, block, seed, shard_slots)
    sums = pieces.groupBy("src", "start").agg(F.sum("words").alias("words"), F.min("shard").alias("first_shard"))
    # documents of size 0 may share a start with the one after them
    has = F.col("size") > 0
    found = F.when(has, F.coalesce("words", F.lit(0))).otherwise(0).cast("long")
    return where.join(sums, ["src", "start"], "left").select("doc_id", "size", "source_size", "target", found.alias("taken"), F.when(has, F.col("first_shard")).alias("first_shard"))


def passages(docs: DataFrame, block: int = BLOCK, seed: int = 17, shard_slots: int = SHARD) -> DataFrame:
    """doc_id, text, lang, source, n_chars, shard, pass, at, words: the mix as passages of its output shards.

    A passage is a run of adjacent blocks of one document in one shard and pass, `words` words from word `at` on, with the
    white space that stands between them; a document taken in one run keeps its text and n_chars whole.
    """
    where, pieces = mix(docs, block, seed, shard_slots)
    runs = pieces.groupBy("src", "start").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "at", "words"))).alias("p"))
    p = F.col("p")
    goes_on = lambda i: (p[i]["pass"] == p[i - 1]["pass"]) & (p[i]["shard"] == p[i - 1]["shard"]) & (p[i]["at"] == p[i - 1]["at"] + p[i - 1]["words"])
    runs = runs.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.when(i == 0, True).otherwise(~goes_on(F.greatest(i, F.lit(1))))))
    b = F.col("begins")
    last = lambda k: p[F.coalesce(F.get(b, k + 1), F.size("p")) - 1]
    run = lambda i, k: F.struct(p[i]["shard"].alias("shard"), p[i]["pass"].alias("pass"), p[i]["at"].alias("at"), (last(k)["at"] + last(k)["words"] - p[i]["at"]).alias("words"))
    runs = runs.select("src", "start", F.transform("begins", run).alias("runs"))
    rows = where.where("size > 0").join(runs, ["src", "start"]).select("doc_id", "key", "size", "runs")
    # one row for each distinct content, on the join's own keys
    texts = docs.withColumn("key", F.xxhash64("doc_id", "text", "source")).groupBy("doc_id", "key").agg(*(F.first(c).alias(c) for c in ("text", "lang", "source", "n_chars")))
    full = rows.join(texts.withColumnRenamed("doc_id", "id").withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")))
    whole = lambda r: r["words"] == F.col("size")
    tokens = F.regexp_extract_all("text", F.lit(GAP[:-1] + "*" + WORD), F.lit(0))  # each word with the white space before it
    cut = lambda t: F.transform("runs", lambda r: F.when(~whole(r), F.ltrim(F.array_join(F.slice(t, (r["at"] + 1).cast("int"), r["words"].cast("int")), ""), F.lit(SPACES))))
    cuts = F.when(F.exists("runs", lambda r: ~whole(r)), F.transform(F.array(tokens), cut)[0]).otherwise(F.transform("runs", lambda r: F.lit(None).cast("string")))
    out = full.select("doc_id", F.col("text").alias("all"), "lang", "source", "n_chars", F.explode(F.arrays_zip(F.col("runs").alias("run"), cuts.alias("cut"))).alias("x"))
    r, part = F.col("x")["run"], F.col("x")["cut"]
    n_chars = F.when(part.isNull(), F.col("n_chars")).otherwise(F.length(part).cast("long"))
    return out.select("doc_id", F.coalesce(part, F.col("all")).alias("text"), "lang", "source", n_chars.alias("n_chars"), r["shard"].alias("shard"), r["pass"].alias("pass"), r["at"].alias("at"), r["words"].alias("words"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The passages of the mix with the columns of documents; a document has a row for each of its passages."""
    return passages(docs, block, seed).select("doc_id", "text", "lang", "source", "n_chars")


def write_mix(docs: DataFrame, path: str, block: int = BLOCK, seed: int = 17, shard_slots: int = SHARD, parts_a_shard: int = 4) -> None:
    """The passages under path/shard=N. A shard's passages come in an order of their hashes, in parts_a_shard files."""
    mixed = passages(docs, block, seed, shard_slots).withColumn("turn", F.xxhash64("doc_id", "pass", "at", F.lit(seed)))
    part = F.pmod(F.col("turn"), F.lit(parts_a_shard))
    dealt_out = mixed.withColumn("part", part).repartition(partitions(docs.sparkSession), "shard", "part").sortWithinPartitions("shard", "part", "turn")
    dealt_out.drop("part", "turn").write.partitionBy("shard").parquet(path)


def op10_source_mix(spark, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))
