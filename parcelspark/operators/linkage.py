"""Record linkage and duplicates where results depend on order.

Both sides of a document come as one sorted stream of Arrow batches, so that a task holds a batch and what one document
still offers, never a frame for each document.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.floorplans import type_letter, unit_key


def _streamed(df: DataFrame, run, schema: str, group: str, *order: str) -> DataFrame:
    """run over batches in which a group's rows follow one another, in order."""
    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in b.columns))


def _batch(rows: list[tuple], names: str, types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names.split())


def _likeness(bed: str | None, sub: str | None, letter: str | None, beds: int | None) -> list[tuple]:
    """What two labels can agree in, the most telling first."""
    keys = [("unit", bed, sub)] * bool(bed and sub) + [("letter", bed, letter)] * bool(bed and letter) + [("bed", bed)] * bool(bed)
    return keys + [("number", beds)] * (beds is not None)


class Offers:
    """The rows of one document that no plan has taken yet, by each key that they can be asked for."""

    def __init__(self):
        self.by_key: dict[tuple, deque] = {}
        self.taken: set[int] = set()

    def add(self, row: int, keys: list[tuple]) -> None:
        for k in keys:
            self.by_key.setdefault(k, deque()).append(row)

    def take(self, keys: list[tuple]) -> int | None:
        """The first free row under the first key that has one."""
        for k in keys:
            rows = self.by_key.get(k, ())
            while rows and rows[0] in self.taken:
                rows.popleft()
            if rows:
                self.taken.add(rows[0])
                return rows.popleft()
        return None


def link_plans(plans: DataFrame, specs: DataFrame) -> DataFrame:
    """doc_id, seq, row_no (null: none) of plans (doc_id, seq, unit_type, bedrooms) and specs (doc_id, row_no, unit_type, bedrooms).

    Plans choose in order of seq, each the first free row that agrees with it best, so that an earlier plan may take a
    row that fits a later one better. A plan without a label takes none.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, offers, keys_of = None, Offers(), Keys()
        for b in batches:
            out = []
            for doc_id, plan, at, *label in _rows(b):
                if doc_id != doc:
                    doc, offers = doc_id, Offers()
                if not plan:
                    offers.add(at, keys_of[*label])
                else:
                    out.append((doc_id, at, offers.take(keys_of[*label]) if label[0] else None))
            if out:
                yield _batch(out, "doc_id seq row_no", (pa.int64(), pa.int32(), pa.int64()))

    both = _side(specs, 0, "row_no").unionByName(_side(plans, 1, "seq"))
    return _streamed(both, link, "doc_id long, seq int, row_no long", "doc_id", "side", "at")


class Keys(dict):
    """_likeness() of labels, each found once; labels of one task are few beside its rows, and no more than 100,000 are held."""

    def __missing__(self, label: tuple) -> list[tuple]:
        if len(self) >= 100_000:
            self.clear()
        self[label] = found = _likeness(*label)
        return found


def _side(df: DataFrame, number: int, at: str, *more) -> DataFrame:
    key = unit_key(F.col("unit_type"))
    return df.select("doc_id", F.lit(number).alias("side"), F.col(at).cast("long").alias("at"), key["bed"].alias("bed"), key["sub"].alias("sub"), type_letter(F.col("unit_type")).alias("letter"), F.col("bedrooms").cast("int").alias("beds"), *more)


def linked_areas(plans: DataFrame, specs: DataFrame) -> DataFrame:
    """Plans linked as by link_plans() with the areas of their rows (confidence 0.99; zero and null give nothing), then rows
    that no plan took (0.95). Labels and areas travel with the rows that are linked, so nothing is joined afterwards."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, offers, keys_of, rest = None, Offers(), Keys(), {}
        left = lambda: [(doc, None, row, name, t or None, b or None, 0.95) for row, (name, t, b) in rest.items()]
        packed = lambda out: _batch(out, "doc_id seq row_no unit_type total_sqft balcony_sqft confidence", (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64()))
        for batch in batches:
            out = []
            for doc_id, plan, at, bed, sub, letter, beds, name, total, balcony, sure in _rows(batch):
                if doc_id != doc:
                    out += left()
                    doc, offers, rest = doc_id, Offers(), {}
                keys = keys_of[bed, sub, letter, beds]
                if not plan:
                    offers.add(at, keys)
                    rest[at] = (name, total, balcony)
                    continue
                hit = offers.take(keys) if bed else None
                if hit is not None:
                    its, t, b = rest.pop(hit)
                    name, total, balcony, sure = its if name is None else name, t or total, b or balcony, 0.99 if t or b else sure
                out.append((doc_id, at, hit, name, total, balcony, sure))
            if out:
                yield packed(out)
        if rest:
            yield packed(left())

    areas = [F.col("unit_type").alias("name"), F.col("total_sqft").cast("double").alias("total"), F.col("balcony_sqft").cast("double").alias("balcony")]
    both = _side(specs, 0, "row_no", *areas, F.lit(None).cast("double").alias("sure")).unionByName(_side(plans, 1, "seq", *areas, F.col("confidence").cast("double").alias("sure")))
    return _streamed(both, link, "doc_id long, seq int, row_no long, unit_type string, total_sqft double, balcony_sqft double, confidence double", "doc_id", "side", "at")


class Leaders:
    """Hashes of 64 bits that no earlier one is similar to, found again by bands.

    Two similar hashes differ in `most` bits at most, so of most + 1 bands of bits one is equal: a hash meets only
    leaders that share a band, however many there are.
    """

    def __init__(self, threshold: float):
        self.most = int((1 - threshold) * 64 + 1e-9)
        edges = [64 * i // (self.most + 1) for i in range(self.most + 2)]
        self.bands = [(lo, (1 << hi - lo) - 1) for lo, hi in zip(edges, edges[1:])]
        self.held: dict[tuple[int, int], tuple[array, array]] = {}
        self.ids: list[int] = []

    def place(self, phash: int | None, at: int) -> int | None:
        """The id of the first leader that is similar; a hash without one becomes a leader, null hashes never do."""
        if phash is None:
            return None
        phash &= (1 << 64) - 1  # longs are signed; their bits are compared
        keys = [(i, phash >> lo & mask) for i, (lo, mask) in enumerate(self.bands)]
        first = None
        for k in keys:
            if k in self.held:
                hashes, order = self.held[k]
                near = np.bitwise_count(np.frombuffer(hashes, np.uint64) ^ np.uint64(phash)) <= self.most
                at_ = int(near.argmax())
                if near[at_]:
                    first = order[at_] if first is None else min(first, order[at_])
        if first is not None:
            return self.ids[first]
        for k in keys:
            hashes, order = self.held.setdefault(k, (array("Q"), array("L")))
            hashes.append(phash)
            order.append(len(self.ids))
        self.ids.append(at)
        return None


def leader_duplicates(images: DataFrame, threshold: float, order: list[str], group: str = "doc_id") -> DataFrame:
    """group, image_id, duplicate_of (image_id; null for those that stay): not transitive, the first similar leader wins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, Leaders(threshold)
        for b in batches:
            out = []
            for g, image_id, phash in _rows(b.select([0, 1, 2])):
                if g != current:
                    current, known = g, Leaders(threshold)
                out.append((g, image_id, known.place(phash, image_id)))
            if out:
                yield _batch(out, f"{group} image_id duplicate_of", (pa.int64(),) * 3)

    rows = images.select(F.col(group).cast("long").alias(group), F.col("image_id").cast("long").alias("image_id"), "phash", *[c for c in order if c != "image_id"])
    return _streamed(rows, run, f"{group} long, image_id long, duplicate_of long", group, *order)


def without_covered(renders: DataFrame, embedded: DataFrame, threshold: float = 0.9, coverage: float = 0.7) -> DataFrame:
    """Page renders without those that an embedded image of the same page of the same document covers or resembles."""
    from ..functions.units import similarity64

    e = embedded.select(F.col("doc_id").alias("d"), F.col("page_no").alias("p"), (F.col("width") * F.col("height")).alias("area"), F.col("phash").alias("h"))
    own = F.col("width") * F.col("height")
    covered = (own > F.col("area")) & (F.col("area") / own >= coverage)
    alike = similarity64(F.col("phash"), F.col("h")) >= threshold
    return renders.join(e, (F.col("doc_id") == F.col("d")) & (F.col("page_no") == F.col("p")) & (covered | F.coalesce(alike, F.lit(False))), "left_anti")


def _boxes_of_plans(boxes: list[tuple[int, str]], plans: list[tuple[int, str]]) -> dict[int, int]:
    """box -> plan of one document, both in order, each plan once: by equal labels, by a label within the other, by order."""
    free, found = dict(plans), {}
    for agree in (str.__eq__, lambda a, b: a in b or b in a):
        for box, label in boxes:
            if label and box not in found:
                plan = next((p for p, x in free.items() if x and agree(label, x)), None)
                if plan is not None:
                    found[box] = plan
                    del free[plan]
    return found | dict(zip((box for box, _ in boxes if box not in found), list(free)))


def box_matches(boxes: DataFrame, plans: DataFrame) -> DataFrame:
    """doc_id, box_no, seq (null: none): boxes (doc_id, box_no, label, x) and plans (doc_id, seq, unit_type) by equal label,
    then by a label within the other, then in order of x."""
    none = F.lit(None)
    p = plans.select("doc_id", F.lit(0).alias("side"), none.cast("long").alias("x"), F.col("seq").cast("long").alias("at"), F.lower(F.coalesce("unit_type", F.lit(""))).alias("label"))
    b = boxes.select("doc_id", F.lit(1).alias("side"), F.col("x").cast("long").alias("x"), F.col("box_no").cast("long").alias("at"), F.lower(F.coalesce("label", F.lit(""))).alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, sides = None, ([], [])

        def matched() -> list[tuple]:
            found = _boxes_of_plans(sides[1], sides[0])
            return [(doc, box, found.get(box)) for box, _ in sides[1]]

        for batch in batches:
            out = []
            for doc_id, side, _, at, label in _rows(batch):
                if doc_id != doc:
                    out += matched()
                    doc, sides = doc_id, ([], [])
                sides[side].append((at, label))
            if out:
                yield _batch(out, "doc_id box_no seq", (pa.int64(), pa.int32(), pa.int32()))
        if sides[1]:
            yield _batch(matched(), "doc_id box_no seq", (pa.int64(), pa.int32(), pa.int32()))

    return _streamed(p.unionByName(b), run, "doc_id long, box_no int, seq int", "doc_id", "side", "x", "at")


def compare_maps(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, field, verdict: match, diff, missing or extra of two tables of maps (key, fields); both null counts nowhere.

    Values are compared without case and outer blanks.
    """
    a = expected.select(key, F.explode("fields").alias("field", "want"))
    b = actual.select(key, F.explode("fields").alias("field", "have"))
    j = a.join(b, [key, "field"], "full_outer")
    same = F.lower(F.trim("want")) == F.lower(F.trim("have"))
    verdict = F.when(F.col("want").isNull() & F.col("have").isNull(), None).when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(same, "match").otherwise("diff")
    return j.select(key, "field", verdict.alias("verdict")).where("verdict is not null")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
