"""Token ids of whole texts with the tokenizers library, encoding each distinct piece once.

Both vocabularies cut a text before they merge bytes, and never merge over such a cut. A single space (or line
feed) between two other characters is such a cut, so the ids of a text are those of its space-separated pieces in
a row. Texts in which white space touches white space are encoded whole where the vocabulary keeps white space.
A batch is split, its distinct pieces are found and their ids are put in a row by Arrow; Python meets each distinct
stem of a batch once, and only stems not seen before reach the tokenizer.
"""

from __future__ import annotations

import os
from array import array
from codecs import charmap_decode
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of remembered pieces in each of a worker's two generations, unless told otherwise. It bounds memory and changes no result.
MOST_BYTES = 24 << 20
#: What a remembered piece takes beside its characters and ids: two objects and a place in the table.
OVERHEAD = 200
#: Between pieces that are encoded together; a character of its own for either vocabulary.
FEED, MARK = "\n", "\x01"
#: After a letter or digit, a run of these up to the next space is a piece of its own to either vocabulary.
STOPS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of letters below U+02B0 without U+0130, at the beginning of a line or not.
PLAIN = r"^\n?[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{2AF}]+$"


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)}


BYTE_LETTERS = _byte_letters()
#: The same, in order.
LETTERS = "".join(BYTE_LETTERS[b] for b in range(256))


def _rows(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.large_binary())


def _ends_of(column: pa.Array) -> np.ndarray:
    """Where each row of a large string or binary column begins in its bytes, and where the last one ends."""
    return np.frombuffer(column.buffers()[1], "<i8", len(column) + 1, 8 * column.offset)


def _tails(column: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The last so many bytes of each row."""
    ends, to = _ends_of(column)[1:], np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[np.repeat(ends - to[1:], sizes) + np.arange(to[-1])]
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(to), pa.py_buffer(raw))


class Encoder:
    def __init__(self, path: str, keeps_space: bool, most_bytes: int = MOST_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.keeps_space, self.most_bytes = self.tokenizer.model, keeps_space, most_bytes
        # no ids: where white space is kept, texts with such a piece are encoded whole
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of self.seen
        self.between = self.whole(FEED if keeps_space else MARK)
        if len(self.between) != 1:
            raise ValueError("the separator must be one id")

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _in_word(self, last: str) -> bool:
        """Whether a piece's last character is a letter or digit, and still ends with one when it is normalised."""
        return (last if self.keeps_space else normalize("NFC", last).lower())[-1:].isalnum()

    def _ids(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, null where texts with one are encoded whole. Stops after a letter or digit are pieces of
        their own to the vocabulary, so only what stands before them is remembered."""
        cut = pc.utf8_rtrim(pieces, STOPS)
        last = pc.utf8_slice_codeunits(cut, -1).dictionary_encode()
        stems = pc.if_else(pa.array(map(self._in_word, last.dictionary.to_pylist()), pa.bool_()).take(last.indices), cut, pieces)
        tails = _tails(pieces, np.diff(_ends_of(pieces)) - np.diff(_ends_of(stems))).dictionary_encode()
        if not self.keeps_space:
            stems = pc.if_else(pc.string_is_ascii(stems), pc.ascii_lower(stems), stems)
        stems = stems.dictionary_encode()
        ends = _rows([self.whole(t).tobytes() if t else b"" for t in tails.dictionary.to_pylist()])
        ids = self._remembered(stems.dictionary)
        if self.keeps_space:
            ids = pc.if_else(pc.greater(pc.binary_length(ids), 0), ids, pa.scalar(None, pa.large_binary()))
        return pc.binary_join_element_wise(ids.take(stems.indices), ends.take(tails.indices), pa.scalar(b"", pa.large_binary()))

    def _remembered(self, stems: pa.Array) -> pa.Array:
        keys = stems.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        found = [*map(self.seen.get, keys)]
        missing = [i for i, x in enumerate(found) if x is None]
        older = [i for i in missing if keys[i] in self.older]
        self._remember([keys[i] for i in older], [self.older.pop(keys[i]) for i in older])
        new = [i for i in missing if keys[i] not in self.seen]
        if new:
            plain = pc.match_substring_regex(stems.take(pa.array(new)), PLAIN).to_numpy(zero_copy_only=False).tolist()
            self._encode_words([keys[i] for i, ok in zip(new, plain) if ok])
            self._encode_others([keys[i] for i, ok in zip(new, plain) if not ok])
        for i in missing:
            found[i] = self.seen[keys[i]]
        if self.held > self.most_bytes:  # pieces that aren't asked for while the next generation fills are forgotten
            self.older, self.seen, self.held = self.seen, {}, 0
        return _rows(found)

    def _remember(self, pieces: list[str], ids: list[bytes]) -> None:
        self.seen.update(zip(pieces, ids))
        self.held += OVERHEAD * len(pieces) + sum(map(len, pieces)) + sum(map(len, ids))

    def _encode_words(self, words: list[str]) -> None:
        """Ids of PLAIN words (after a space, or a line feed): one piece without normalisation, so the model alone is asked."""
        if not words:
            return
        if self.keeps_space:
            lead, forms = self.between.tobytes(), [w[1:] if w[0] == FEED else " " + w for w in words]
        else:
            lead, forms = b"", [w.lower() for w in words]
        tokenize = self.model.tokenize
        coded = charmap_decode(FEED.join(forms).encode(), "strict", LETTERS)[0].split(BYTE_LETTERS[ord(FEED)])
        ids = [array("I", [t.id for t in tokenize(x)]).tobytes() for x in coded]
        self._remember(words, [lead + x if w[0] == FEED else x for w, x in zip(words, ids)])

    def _encode_others(self, new: list[str]) -> None:
        """Encodes pieces together, separated by an id that none of them can hold."""
        lead = self.between.tobytes()
        if self.keeps_space:
            # a piece that begins with a line feed begins a line; others follow a space
            plain = [p for p in new if p.strip(FEED) and not p.lstrip(FEED)[0].isspace() and not p[-1].isspace() and p.rfind(FEED) < 1]
            texts, joint = [p[1:] if p[0] == FEED else " " + p for p in plain], FEED
        else:
            plain = [p for p in new if MARK not in p and not p.isspace() and p]
            texts, joint = plain, f" {MARK} "
        for at in range(0, len(plain), 4000):
            ids = self.whole(joint.join(texts[at : at + 4000]))
            cuts, part = np.flatnonzero(ids == self.between), plain[at : at + 4000]
            if len(cuts) != len(part) - 1:
                found = [self.whole(t).tobytes() for t in texts[at : at + 4000]]
            else:
                raw, ends = ids.tobytes(), [4 * c for c in cuts.tolist()] + [4 * len(ids)]
                found = [raw[x:y] for x, y in zip([0] + [e + 4 for e in ends[:-1]], ends)]
            self._remember(part, [lead + x if self.keeps_space and p[0] == FEED else x for p, x in zip(part, found)])
        rest = [*set(new).difference(plain)]
        self._remember(rest, [b"" if self.keeps_space else self.whole(p).tobytes() for p in rest])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return []
        if self.keeps_space:
            ready = pc.binary_join_element_wise(pa.scalar(FEED, pa.large_string()), pc.replace_substring(texts, FEED, " " + FEED), pa.scalar("", pa.large_string()))
        else:
            ready = pc.replace_substring(texts, FEED, " ")
        lists = pc.split_pattern(ready, " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary)
        rows = ids.take(coded.indices)
        bounds = _ends_of(rows)[ends - ends[0]].tolist()
        stream, lead = rows.buffers()[2] or pa.py_buffer(b""), 4 * self.keeps_space  # each text began with a line feed
        out = [stream[a + lead : b].to_pybytes() for a, b in zip(bounds[:-1], bounds[1:])]
        if ids.null_count:
            bad = np.concatenate([[0], np.cumsum(rows.is_null().to_numpy(zero_copy_only=False))])[ends - ends[0]]
            for i in np.flatnonzero(np.diff(bad)).tolist():
                out[i] = self.whole(texts[i].as_py()).tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(path: str, keeps_space: bool, most_bytes: int = MOST_BYTES) -> Encoder:
    """One for each Python worker, kept over its tasks."""
    return Encoder(path, keeps_space, most_bytes)
