"""Finding on op13_group_dictionary of round 3: a stem is encoded once, whatever stops or line feeds stand beside it."""

import random

import pyarrow as pa
import pytest

from parcelspark.llm import alignment

from .test_joins_and_search import COLUMNS, A, B, aligned

BITS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "a", "Word", "été", "x1", "42", "don't", "'s", ".", ",", "...", "&&&", "_", "²", "².", "①", "٣.", "́", "漢字", "🙂", "ﬁ", "ß.", "İ!", "<s>", "</s>", "<|endoftext|>", "▁", "\x00"]


class Asked:
    """Notes the texts that an encoder is asked for."""

    def __init__(self, of):
        self.of, self.texts = of, []

    def encode(self, texts, **options):
        self.texts += texts
        return self.of.encode(texts, **options)


def test_a_stem_is_encoded_once():
    one = alignment.Aligner(A, B)
    one.v.b = Asked(one.v.b)
    got = one.block(pa.array(["water, water. water\n\nwater!! water&&&", "water; the\n\n\nwater..."]))
    assert sorted(t for t in one.v.b.texts if "water" in t) == ["\nwater", "water"]
    again = one.block(pa.array(["water! water?\n\nwater, water. water;", "water:"]))
    assert sorted(t for t in one.v.b.texts if "water" in t) == ["\nwater", "water"] and got["sha"][0] != again["sha"][0]


@pytest.mark.parametrize("cuts_stops", [True, False])
def test_cuts_beside_white_space_and_stops(cuts_stops):
    rnd, one = random.Random(13), alignment.Aligner(A, B)
    assert one.v.cuts_stops
    one.v.cuts_stops = cuts_stops
    texts = ["".join(rnd.choices(BITS, k=rnd.randint(1, 12))) for _ in range(800)] + ["", None, "a \nb", "a \n\nb ", "a\n", "\n\na"]
    wanted = {i: x for i, *x in aligned([*enumerate(texts)])}
    for lo in range(0, len(texts), 300):
        x = one.block(pa.array(texts[lo : lo + 300], pa.string()))
        for i, row in enumerate(zip(x["n_a"].tolist(), x["n_b"].tolist(), x["n_groups"].tolist(), x["n_links"].tolist(), x["sha"])):
            assert (*row,) == (*wanted[lo + i][:4], wanted[lo + i][-1]), texts[lo + i]


def test_blocks_of_empty_texts():
    one = alignment.Aligner(A, B)
    for texts in ([], [None], ["", None, ""], ["a", ""], ["", "a"]):
        x = one.block(pa.array(texts, pa.string()))
        assert [bool(s) for s in x["sha"]] == [bool(t) for t in texts] and len(x["n_a"]) == len(x["ends"]) == len(texts)


def test_marks_of_other_texts_take_no_tokens_away(shipped):
    """A piece whose bytes differ empties its own text alone, through the whole query."""
    rows = [(i, t) for i, t in enumerate(["plain. x▁y plain,", "plain. plain,", "y\n\nx▁y", "y\n\nx", None])]
    got = alignment.align(shipped.createDataFrame(rows, "doc_id long, text string").repartition(1), A, B).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == aligned(rows)
