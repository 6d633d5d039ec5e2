"""Alignment of two tokenizers' ids over the same texts, by a dictionary of groups.

A text is cut wherever a token of either tokenizer ends at the same byte; the A ids and B ids between two cuts are a group.
Texts repeat few groups many times, so each distinct group is interned, and its links (pairs of tokens whose bytes overlap)
are expanded once: in a task for counting the documents that hold a pair, and once in the whole corpus for the sums over
the counts. Documents keep the numbers of their groups with frequencies, and get the groups' sums by the groups' key.

Neither tokenizer merges over what stands before a space or line feed that follows another character than white space, or
before a line feed that one follows; this is checked of B's vocabulary. So ids and groups of a text are those of its pieces
between such cuts. Where B's vocabulary doesn't merge them either, the stops that end a piece after a letter or digit are cut
off too. A worker remembers the groups of each stem and of each row of stops; new ones are cut into groups together, by the
places in their joined bytes where tokens of both end.
"""

from __future__ import annotations

import hashlib
import os
import re
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, sliced, table, written
from .encoding import BYTE_LETTERS, LETTERS, PLAIN, STOPS, _ends_of, _tails

#: Documents of a block, which share a dictionary, and their bytes of text, at most (one document more).
BLOCK_DOCS, BLOCK_BYTES = 4096, 4 << 20
#: Pieces that a worker remembers, and pairs of a task that are summed up before they are handed on.
MOST_PIECES, MOST_PAIRS = 250_000, 1_000_000
#: Bytes that are white space, and numbers of three bytes (the last two, if two) that are.
_SPACES = np.asarray([i < 128 and chr(i).isspace() for i in range(256)])
_WIDE_SPACES = np.asarray([int.from_bytes(chr(i).encode(), "big") for i in range(128, 0x10000) if chr(i).isspace()])
#: Letters below U+02B0 and digits, after which stops are cut off.
_LETTERS = "0-9A-Za-zÀ-ÖØ-öø-įı-ʯ"
#: Pieces of such letters alone, one piece to A as well.
_WORD = PLAIN.replace(r"^\n?", r"^[ \n]")
#: Between A ids and B ids of a group in a row.
_BETWEEN = 0xFFFFFFFF
_ALIGNED = "kind int, block long, number int, key string, pair long, docs long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups binary, times binary"


def links_of(a: tuple[int, ...], b: tuple[int, ...], a_bytes: list[bytes], b_bytes: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of the A and B tokens of a group whose bytes overlap, one for each pair of occurrences."""
    out, i, j, a_end, b_end = [], 0, 0, len(a_bytes[a[0]]), len(b_bytes[b[0]])
    while True:
        out.append((a[i], b[j]))
        step_a, step_b = a_end <= b_end, b_end <= a_end
        if step_a:
            i += 1
            if i < len(a):
                a_end += len(a_bytes[a[i]])
        if step_b:
            j += 1
            if j < len(b):
                b_end += len(b_bytes[b[j]])
        if i == len(a) or j == len(b):
            return out


def key_of(group: tuple[tuple[int, ...], tuple[int, ...]]) -> str:
    return ",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1]))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """counts[i] places from starts[i] on, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class _Ids:
    """Ids of pieces in a row, and how many each piece has."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat, self.counts = flat, counts

    @staticmethod
    def of(lists: list[list[int]]) -> _Ids:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return _Ids(np.fromiter(chain.from_iterable(lists), np.int64, counts.sum()), counts)

    def some(self, rows: np.ndarray) -> _Ids:
        starts = np.cumsum(self.counts) - self.counts
        return _Ids(self.flat[_spread(starts[rows], self.counts[rows])], self.counts[rows])

    def sums(self, sizes: np.ndarray) -> np.ndarray:
        """Of each piece, the sizes of its ids."""
        return np.diff(np.concatenate([[0], np.cumsum(sizes[self.flat])])[np.concatenate([[0], np.cumsum(self.counts)])])


class _Bytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, of: list[bytes]):
        self.sizes = np.fromiter(map(len, of), np.int64, len(of))
        self.starts, self.raw = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(of), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[_spread(self.starts[ids], self.sizes[ids])]


class Vocabularies:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a_model = self.a.model
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {c: b for b, c in BYTE_LETTERS.items()}
        self.a_bytes = [bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token in (self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size()))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(r"[^▁]▁|.\n|\n.", p) for p in pieces):
            raise ValueError("the second vocabulary merges over spaces or line feeds")
        self.space = self.b.piece_to_id("▁")
        text = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: whether stops after these letters are tokens of their own
        self.cuts_stops = not any(re.search(rf"[{_LETTERS}][{re.escape(STOPS)}]", p) for p in text) and len(self.b.encode("a")) == len(self.a.encode("a").ids) == 1

    def _a_ids(self, pieces: list[str]) -> list[list[int]]:
        """A word of letters is one piece to A, so the model alone is asked."""
        plain = pc.match_substring_regex(pa.array(pieces, pa.large_string()), _WORD).to_numpy(zero_copy_only=False).tolist()
        out: list[list[int]] = [[]] * len(pieces)
        words = [i for i, ok in enumerate(plain) if ok]
        feed, tokenize = [self.a_model.token_to_id(BYTE_LETTERS[10])], self.a_model.tokenize
        if words:
            # what follows a line feed has no space
            coded = charmap_decode("\n".join([pieces[i].removeprefix("\n") for i in words]).encode(), "strict", LETTERS)[0].split(BYTE_LETTERS[10])
            for i, x in zip(words, coded):
                ids = [t.id for t in tokenize(x)]
                out[i] = feed + ids if pieces[i][0] == "\n" else ids
        others = [i for i, ok in enumerate(plain) if not ok]
        for i, code in zip(others, self.a.encode_batch([pieces[i] for i in others], add_special_tokens=False)):
            out[i] = code.ids
        return out

    def encode(self, pieces: list[str]) -> tuple[_Ids, _Ids]:
        """A and B ids of pieces that begin with a space or line feed."""
        # B puts a space before each text: it takes the place of a piece's own, or goes before a line feed
        found = self.b.encode([p[p[0] == " " :] for p in pieces], num_threads=1)
        b = [(x if len(p) > 1 else [self.space]) if p[0] == " " else x[1:] if x and x[0] == self.space else [] for p, x in zip(pieces, found)]
        return _Ids.of(self._a_ids(pieces)), _Ids.of(b)

    def encode_stops(self, stops: list[str]) -> tuple[_Ids, _Ids]:
        """A and B ids of rows of stops after a letter."""
        after = ["a" + x for x in stops]
        return _Ids.of([x.ids[1:] for x in self.a.encode_batch(after, add_special_tokens=False)]), _Ids.of([x[1:] for x in self.b.encode(after, num_threads=1)])


class Aligner:
    """Groups of texts, remembered by stems and rows of stops."""

    def __init__(self, a_path: str, b_path: str):
        self.v = Vocabularies(a_path, b_path)
        self.a_bytes, self.b_bytes = _Bytes(self.v.a_bytes), _Bytes(self.v.b_bytes)
        self.b_size = len(self.v.b_bytes)
        self.forget()

    def forget(self) -> None:
        #: rows of stems and of the stops after them
        self.stems: dict[str, int] = {}
        self.stops: dict[str, int] = {"": 0}
        #: of each row, its groups' numbers and whether its ids' bytes aren't its own
        self.held, self.lost = _Ids(np.empty(0, np.int32), np.zeros(1, np.int64)), np.zeros(1, bool)
        #: of each group: its number by its ids, its key, its links, its numbers of A ids and B ids
        self.numbers: dict[bytes, int] = {}
        self.keys: list[str] = []
        self.links: list[np.ndarray] = []
        self.sizes: list[tuple[int, int]] = []

    def _groups(self, a: _Ids, b: _Ids, ends: np.ndarray) -> _Ids:
        """Numbers of the groups of pieces that end at these bytes of all pieces in a row."""
        a_ends, b_ends = np.cumsum(self.a_bytes.sizes[a.flat]), np.cumsum(self.b_bytes.sizes[b.flat])
        marks = np.zeros((2, (ends[-1] if len(ends) else 0) + 1), bool)
        marks[0, a_ends] = marks[1, b_ends] = True
        both = marks.all(0)
        n_a, n_b = (np.diff(np.flatnonzero(both[x]), prepend=-1) for x in (a_ends, b_ends))
        counts = n_a + n_b + 1
        starts = np.cumsum(counts) - counts
        ids = np.full(counts.sum(), _BETWEEN, "<u4")
        ids[_spread(starts, n_a)] = a.flat
        ids[_spread(starts + n_a + 1, n_b)] = b.flat
        bounds = 4 * np.concatenate([[0], np.cumsum(counts)])
        groups = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(ids)]).dictionary_encode()
        numbers = np.fromiter(map(self._number, groups.dictionary.to_pylist()), np.int32, len(groups.dictionary))
        return _Ids(numbers[groups.indices.to_numpy()], np.diff(np.searchsorted(np.flatnonzero(both), ends, side="right"), prepend=0))

    def _number(self, ids: bytes) -> int:
        n = self.numbers.get(ids)
        if n is None:
            n = self.numbers[ids] = len(self.keys)
            row = np.frombuffer(ids, "<u4").tolist()
            at = row.index(_BETWEEN)
            a, b = tuple(row[:at]), tuple(row[at + 1 :])
            self.keys.append(key_of((a, b)))
            self.links.append(np.asarray([x * self.b_size + y for x, y in links_of(a, b, self.v.a_bytes, self.v.b_bytes)], np.int64))
            self.sizes.append((len(a), len(b)))
        return n

    def _learn(self, pieces: list[str], a: _Ids, b: _Ids) -> None:
        """Rows of new pieces, after the others."""
        raw = pa.array(pieces, pa.large_string())
        sizes = np.diff(_ends_of(raw))
        same = np.flatnonzero((a.sums(self.a_bytes.sizes) == sizes) & (b.sums(self.b_bytes.sizes) == sizes))
        own = _ends_of(raw)[:-1]
        own = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[_spread(own[same], sizes[same])]
        a, b = a.some(same), b.some(same)
        differ = (self.a_bytes.joined(a.flat) != own) | (self.b_bytes.joined(b.flat) != own)
        if differ.any():
            ends = np.concatenate([[0], np.cumsum(sizes[same])])
            right = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(differ)])[ends]) == 0)
            same, a, b = same[right], a.some(right), b.some(right)
        groups = self._groups(a, b, np.cumsum(sizes[same]))
        counts, lost = np.zeros(len(pieces), np.int64), np.ones(len(pieces), bool)
        counts[same], lost[same] = groups.counts, False
        self.held = _Ids(np.concatenate([self.held.flat, groups.flat]), np.concatenate([self.held.counts, counts]))
        self.lost = np.concatenate([self.lost, lost])

    def _rows(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row of the stem and row of the stops of each of these distinct pieces."""
        stems = pieces
        if self.v.cuts_stops:
            cut = pc.utf8_rtrim(pieces, STOPS)
            stems = pc.if_else(pc.match_substring_regex(cut, rf"[{_LETTERS}]\z"), cut, pieces)
        stops = _tails(pieces, np.diff(_ends_of(pieces)) - np.diff(_ends_of(stems))).dictionary_encode()
        stems = stems.dictionary_encode()
        out = []
        for column, known, encode in ((stems, self.stems, self.v.encode), (stops, self.stops, self.v.encode_stops)):
            keys = column.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
            new = [k for k in keys if k not in known]
            if new:
                known.update(zip(new, range(len(self.lost), len(self.lost) + len(new))))
                self._learn(new, *encode(new))
            out.append(np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[column.indices.to_numpy()])
        return out[0], out[1]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct pieces of texts (with a space before each), and in a row the places of each text's pieces among these,
        with the text's number; none for null and empty ones. A piece begins with a space or line feed after another character
        than white space (but at the end), or with a line feed before one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", " ").cast(pa.large_string()), texts, pa.scalar("", pa.large_string()))
        bounds = _ends_of(texts)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        space, bounds = _SPACES[raw], bounds - bounds[0]
        two = np.flatnonzero(raw == 0xC2)  # what begins U+0080 to U+00BF
        two = two[np.isin(0xC200 | raw[two + 1].astype(np.int64), _WIDE_SPACES)]
        three = np.flatnonzero((raw >= 0xE1) & (raw <= 0xE3))
        three = three[np.isin(raw[three].astype(np.int64) << 16 | raw[three + 1].astype(np.int64) << 8 | raw[three + 2], _WIDE_SPACES)]
        space[np.concatenate([two, two + 1, three, three + 1, three + 2])] = True
        # each text begins with a space, so what stands last in one has white space after it
        first = np.zeros(len(raw) + 1, bool)
        first[bounds[:-1]] = True
        feed, last = raw == 10, first[1:].copy()
        last[-1:] = True
        begins = (feed | (raw == 32)) & ~np.concatenate([[True], space[:-1]]) & ~last | feed & ~np.concatenate([space[1:], [True]])[: len(raw)]
        starts = np.flatnonzero(begins | first[:-1])
        counts = np.diff(np.searchsorted(starts, bounds))
        ends = np.concatenate([starts, [len(raw)]]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), counts)

    def block(self, texts: pa.Array) -> dict[str, object]:
        """Of each text: n_a, n_b, n_groups, n_links, sha; of the block: numbers and times of the groups in each text (with
        ends), their keys, and the pairs linked with how many of the texts hold them."""
        if len(self.stems) + len(self.stops) > MOST_PIECES:
            self.forget()
        size = len(texts)
        pieces, at, owner = self.cut(texts)
        rows = self._rows(pieces)
        lost = np.zeros(size, bool)
        lost[owner[self.lost[rows[0]][at]]] = True
        at, owner = at[~lost[owner]], owner[~lost[owner]]
        at = self.held.some(np.stack(rows, 1)[at].ravel())
        owner, groups = np.repeat(np.repeat(owner, 2), at.counts), at.flat
        seen = np.zeros(len(self.keys), bool)
        seen[groups] = True
        held = np.flatnonzero(seen)
        number, keys = (np.cumsum(seen) - 1)[groups], [self.keys[g] for g in held.tolist()]
        sums = lambda of: np.bincount(owner, of, size).astype(np.int64)
        n_groups = np.bincount(owner, minlength=size).astype(np.int64)
        n_a, n_b = np.asarray([self.sizes[g] for g in held.tolist()], np.int64).reshape(-1, 2).T
        names = pa.array([k + ";" for k in keys], pa.large_string()).take(pa.array(number))
        bounds, raw = _ends_of(names)[np.concatenate([[0], np.cumsum(n_groups)])].tolist(), memoryview(names.buffers()[2] or b"")
        sha = [hashlib.sha256(raw[lo : hi - 1]).hexdigest() if lo < hi else "" for lo, hi in zip(bounds[:-1], bounds[1:])]
        k = max(len(held), 1)
        entries, times = np.unique(owner * k + number, return_counts=True)
        text, local = entries // k, entries % k
        links = [self.links[g] for g in held.tolist()]
        n = np.asarray([len(x) for x in links], np.int64)
        pairs, linked = np.unique(np.concatenate(links) if links else np.empty(0, np.int64), return_inverse=True)
        wide, p = n[local], max(len(pairs), 1)
        each = np.sort(np.repeat(text, wide) * p + linked[_spread((np.cumsum(n) - n)[local], wide)])
        each = each[np.diff(each, prepend=-1) > 0]  # a pair counts once in a text
        return {
            "n_a": sums(n_a[number]), "n_b": sums(n_b[number]), "n_groups": n_groups, "n_links": np.bincount(text, times * wide, size).astype(np.int64), "sha": sha,
            "numbers": local.astype("<i4"), "times": times, "ends": np.searchsorted(text, np.arange(size), side="right"), "keys": keys, "pairs": pairs, "docs": np.bincount(each % p, minlength=len(pairs)).astype(np.int64),
        }


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker, kept over its tasks."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _rows(n: int, **columns) -> pa.RecordBatch:
    """n rows of the aligned table, with null in the columns not given."""
    fields = [(c, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in _ALIGNED.split(", "))]
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if columns.get(c) is None else pa.array(columns[c], t) for c, t in fields], [c for c, _ in fields])


def _aligned(docs: DataFrame, a_path: str, b_path: str, block_docs: int) -> DataFrame:
    """Rows of three kinds. 0: number and key of each group of a block; 1: a document with its groups' numbers and times;
    2: a pair and how many documents of a task hold it linked (several rows a pair)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        held, size, rows = [], 0, 0
        for b in sliced(batches):
            n = b["text"].nbytes
            if held and (size + n > BLOCK_BYTES or rows + len(b) > block_docs):
                yield [x["doc_id"] for x in held], [x["text"] for x in held]
                held, size, rows = [], 0, 0
            held.append(b)
            size, rows = size + n, rows + len(b)
        if held:
            yield [x["doc_id"] for x in held], [x["text"] for x in held]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, by = TaskContext.get(), aligner(a_path, b_path)
        block = (context.partitionId() if context else 0) << 24
        pairs = docs_of = np.empty(0, np.int64)
        for ids, texts in blocks(batches):
            x = by.block(pa.concat_arrays(texts))
            n, keys = sum(map(len, ids)), x["keys"]
            if keys:
                yield _rows(len(keys), kind=np.zeros(len(keys), np.int32), block=np.full(len(keys), block), number=np.arange(len(keys), dtype=np.int32), key=keys)
            bounds = list(zip([0, *x["ends"][:-1].tolist()], x["ends"].tolist()))
            narrow = [x["times"][lo:hi] for lo, hi in bounds]
            yield _rows(
                n, kind=np.ones(n, np.int32), block=np.full(n, block), doc_id=pa.concat_arrays(ids), n_a=x["n_a"], n_b=x["n_b"], n_groups=x["n_groups"], n_links=x["n_links"], groups_sha256=x["sha"],
                groups=[x["numbers"][lo:hi].tobytes() for lo, hi in bounds], times=[t.astype("<u1" if not len(t) or t.max() < 256 else "<u4").tobytes() for t in narrow],
            )
            both = np.concatenate([pairs, x["pairs"]])
            pairs, place = np.unique(both, return_inverse=True)
            docs_of = np.bincount(place, np.concatenate([docs_of, x["docs"]]), len(pairs)).astype(np.int64)
            block += 1
            if len(pairs) > MOST_PAIRS:
                yield _rows(len(pairs), kind=np.full(len(pairs), 2, np.int32), pair=pairs, docs=docs_of)
                pairs = docs_of = np.empty(0, np.int64)
        if len(pairs):
            yield _rows(len(pairs), kind=np.full(len(pairs), 2, np.int32), pair=pairs, docs=docs_of)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(aligned, _ALIGNED), "aligned")


def _group_links(keys: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """key, pair, times: the links of each distinct group."""

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = aligner(a_path, b_path).v
        for b in batches:
            names, pairs = [], []
            for key in b["key"].to_pylist():
                a, c = (tuple(map(int, side.split(","))) for side in key.split("|"))
                found = links_of(a, c, v.a_bytes, v.b_bytes)
                names += [key] * len(found)
                pairs += [x * len(v.b_bytes) + y for x, y in found]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pairs, pa.int64())], ["key", "pair"])

    return keys.mapInArrow(expanded, "key string, pair long")


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """pair, a, b, docs, best: ids linked somewhere, how many documents hold them linked, and whether no other pair of the A id
    is held by more."""
    counts = aligned.where("kind = 2").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = written(counts.withColumns({"a": F.floor(F.col("pair") / b_size), "b": F.col("pair") % b_size}), "pairs")
    # a row for each id of A's vocabulary at most
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    a_path: a byte-level vocabulary of the tokenizers library, which reads a space and the text; b_path: a sentencepiece
    model with byte fallback, which puts that space itself. Special tokens' strings are plain text. Null and empty texts, and
    those whose tokens' bytes aren't a space and the text (as with U+2581 in it) have zeros and an empty digest. Rows that
    repeat a doc_id are documents each, as is one without an id.
    """
    aligned = _aligned(docs, a_path, b_path, block_docs)
    groups = aligned.where("kind = 0").select("block", "number", "key")
    counts = pair_counts(aligned, len(Vocabularies(a_path, b_path).b_bytes))
    links = _group_links(groups.select("key").distinct(), a_path, b_path)
    sums = links.join(counts.select("pair", "docs", "best"), "pair").groupBy("key").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("docs").alias("count_sum"))
    known = groups.join(sums, "key").select("block", F.lit(0).alias("kind"), "number", "n_best", "count_sum", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"), ("groups", "binary"), ("times", "binary"))))
    held = aligned.where("kind = 1").select("block", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("long").alias("n_best"), F.lit(None).cast("long").alias("count_sum"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "times")
    rows = known.unionByName(held).repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "kind", "number")
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = total = np.empty(0, np.int64)
        of = None
        for b in batches:
            block, kind = b["block"].to_numpy(), b["kind"].to_numpy()
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
                if lo == hi:
                    continue
                if block[lo] != of:
                    of, best, total = block[lo], best[:0], total[:0]
                part = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    best, total = np.concatenate([best, part["n_best"].to_numpy()]), np.concatenate([total, part["count_sum"].to_numpy()])
                    continue
                n_best, sums = [], []
                for groups, times in zip(part["groups"].to_pylist(), part["times"].to_pylist()):
                    g = np.frombuffer(groups, "<i4")
                    t = np.frombuffer(times, "<u1" if len(times) == len(g) else "<u4").astype(np.int64)
                    n_best.append(int((best[g] * t).sum()))
                    sums.append(int((total[g] * t).sum()))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), part["groups_sha256"]], [*columns, "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(joined, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_group_dictionary(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
