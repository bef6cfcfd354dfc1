"""Whole-batch tokenisation by public tokenizers, each different unit of a text encoded once.

A unit runs from a single space between two characters that are no white space (or the start of the text) to the next such space. Neither tokenizer has a token
across that place: the byte-level pattern starts a new match at such a space, and no piece of the other vocabulary holds a space mark after another character
(``Pieces`` checks its vocabulary). For the byte-level tokenizer a unit also ends where a letter a-z is followed by another ASCII sign that is none: its pattern has no match that goes on after
a letter with anything but letters. A text's ids are therefore those of its units in order, as the tests compare with whole texts.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(" ?[A-Za-z]+")
REMEMBERED = 300_000   # units a worker keeps
LONGEST = 64           # longer units are not kept
MARK = "▁"        # stands for a space in pieces

# White space that may not stand beside the space of a boundary: ASCII, and the first bytes of other white space, all of its characters or not.
_LEAD = np.zeros(256, dtype=bool)
_LEAD[[0xE1, 0xE2, 0xE3]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3]] = True


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[:128] = ~_LETTER[:128]


def unit_begins(data: np.ndarray, offsets: np.ndarray, signs: np.ndarray | None = None) -> np.ndarray:
    """Where the units of the rows begin; with ``signs`` also at one of these bytes after a letter."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    at = np.flatnonzero(data == 32)
    at = at[~(edge[at] | edge[at + 1])]
    before, after = data[at - 1], data[at + 1]
    wide = (before >= 128) & ((data[at - 2] == 0xC2) | _LEAD[data[at - 3]])
    at = at[~(_SPACE[after] | wide | ((before < 128) & _SPACE[before]))]
    edge[:] = False
    edge[at] = True
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    if signs is not None:
        edge[1:-1] |= _LETTER[data[:-1]] & signs[data[1:]]
    return np.flatnonzero(edge)


def strings(data: np.ndarray, begins: np.ndarray) -> pa.LargeStringArray:
    """The stretches of the bytes that begin at ``begins``."""
    ends = np.append(begins, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


@contextmanager
def uncollected() -> Iterator[None]:
    """Millions of kept strings and tuples hold no cycles; looking for some again and again would take a tenth of a task's time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class Kept(dict):
    """What was worked out for keys. When ``most`` entries are kept, those asked for again since they came stay, at most half of them; the others go."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.again = most, set()

    def find(self, keys: list) -> list:
        if len(self) >= self.most:
            stay = {k: self[k] for k in islice(self.again, self.most // 2)}
            self.clear()
            self.again.clear()
            self.update(stay)
        found = list(map(self.get, keys))
        self.again.update([k for k, x in zip(keys, found, strict=True) if x is not None])
        return found

    def add(self, entries) -> None:
        self.update(islice(entries, self.most - len(self)))


def gathered(values: list[bytes], place: pa.Array | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of ``values[place]``, and where each begins (one more entry)."""
    taken = pa.array(values, pa.large_binary()).take(pa.array(place))
    _, offsets, data = taken.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    return np.frombuffer(data if data is not None else b"", np.uint8)[:offsets[-1]], offsets


class Memo:
    """Ids of units by a tokenizer that is asked once for each different one among those kept."""

    def __init__(self, encode, most: int = REMEMBERED):
        self.encode, self.kept = encode, Kept(most)

    def ids(self, keys: list[str], place: pa.Array | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units ``keys[place]``, and where those of each begin (one more entry)."""
        found = self.kept.find(keys)
        new = [i for i, x in enumerate(found) if x is None]
        for low in range(0, len(new), 8192):
            some = new[low:low + 8192]
            for i, ids in zip(some, self.encode([keys[i] for i in some]), strict=True):
                found[i] = array("I", ids).tobytes()
        self.kept.add((keys[i], found[i]) for i in new if len(keys[i]) <= LONGEST)
        data, offsets = gathered(found, place)
        return data.view(np.uint32), offsets // 4


def encode_rows(memo: Memo, data: np.ndarray, offsets: np.ndarray, signs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and where each row's begin (one more entry than rows)."""
    begins = unit_begins(data, offsets, signs)
    coded = strings(data, begins).dictionary_encode()
    ids, first = memo.ids(coded.dictionary.to_pylist(), coded.indices)
    return ids, first[np.searchsorted(begins, offsets)]


class Bytes:
    """The byte-level tokenizer: ids of texts; with ``plain`` the strings of special tokens are ordinary text."""

    def __init__(self, content: str, plain: bool):
        self.model = Tokenizer.from_str(content)
        self.model.encode_special_tokens = plain
        self.memo = Memo(self.ids)
        # Signs at which a unit may end after a letter; none that follows a letter in a special token, which is never to be cut.
        self.signs = _SIGN.copy()
        for token in () if plain else (t.content for t in self.model.get_added_tokens_decoder().values()):
            if " " in token:
                raise ValueError("a special token holds a space; texts cannot be cut into units")
            self.signs[[b for a, b in zip(token.encode(), token.encode()[1:]) if _LETTER[a]]] = False

    def ids(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit. A run of letters a-z, with or without a space before it, is one match of the pattern, so the model is asked for it at once; in the
        byte alphabet letters stand for themselves and the space is U+0120. Other units go through the whole tokenizer."""
        found, look = [None] * len(units), self.model.model.tokenize
        for i, unit in enumerate(units):
            if WORD.fullmatch(unit):
                found[i] = [t.id for t in look("\u0120" + unit[1:] if unit[0] == " " else unit)]
        rest = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(rest, self.model.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id. Tokens are written in a byte alphabet: printable bytes as themselves, the others in order from U+0100 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        found = [b""] * (max(self.model.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            if all(c in alphabet for c in token):
                found[i] = bytes(alphabet[c] for c in token)
        return found


class Pieces:
    """The piece tokenizer, for units that begin with the space it adds itself."""

    def __init__(self, proto: bytes):
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(proto)
        if any(MARK in self.model.id_to_piece(i).lstrip(MARK) for i in range(self.model.vocab_size())):
            raise ValueError("a piece goes on after a space; texts cannot be cut into units")
        self.memo = Memo(lambda texts: self.model.encode([t[1:] for t in texts], num_threads=1))

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id; control and unknown tokens have none."""
        m = self.model
        return [b"" if m.is_control(i) or m.is_unknown(i) else bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i)
                else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(m.vocab_size())]


@lru_cache(4)
def byte_tokenizer(content: str, plain: bool) -> Bytes:
    """One for each worker, so that what it remembers serves all its tasks."""
    return Bytes(content, plain)


@lru_cache(2)
def piece_tokenizer(proto: bytes) -> Pieces:
    return Pieces(proto)
