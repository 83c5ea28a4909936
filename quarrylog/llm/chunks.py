"""Texts as chunks that tokenizers treat each by itself, and a bounded memo over them.

A text may be cut before a space if what precedes it is surely not white space,
or what follows it is not: no piece of the split pattern spans such a place.
The tokens of a text are then the tokens of its chunks, joined.  Words repeat,
so what was worked out for a word after a space is kept; whole texts never are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .vocabulary import pattern

#: Bytes that a worker's memo of words may take; at that size only words met again since the last time stay.
MEMO_BYTES = 32_000_000
#: Longer words are worked out anew each time.
MEMO_CHARS = 64
#: Pieces that are kept by themselves.
MEMO_PIECES = 100_000
#: Words that are handed on at once.
GROUP = 4096

#: Rows, and bytes of text, that are encoded at once: enough that a batch's own words repeat.
ROWS = {"rows": 2048, "chars": 4_000_000}

#: Python's \S has no character that is white space to the tokenizers.
_CUT = re.compile(r"(?<=\S)(?= )")
_POWERS = np.cumprod(np.full(MEMO_CHARS * 4 + 1, 0x9E3779B97F4A7C15, np.uint64))


def pieces_of(chunk: str) -> list[str]:
    """The pattern's pieces of a chunk."""
    word = chunk[1:] if chunk[:1] == " " else chunk
    if word.isalpha():
        return [chunk]
    if word[-1:] in tuple(".,;:") and word[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return pattern().findall(chunk)


class Pieces:
    """What ``work`` makes of a piece, kept for short pieces: words with and without a stop share theirs."""

    def __init__(self, work: Callable[[bytes], object]):
        self.work, self.known = work, {}

    def __call__(self, piece: str):
        found = self.known.get(piece)
        if found is None:
            found = self.work(piece.encode())
            if len(piece) <= MEMO_CHARS:
                if len(self.known) > MEMO_PIECES:
                    self.known.clear()
                self.known[piece] = found
        return found


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of ``flat`` with these starts and sizes, joined."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, joined, and where each word begins and the last ends."""
    words = words.cast(pa.binary())
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


class Memo:
    """Ids by word.  Words are found by hash in sorted arrays, which take a sixth of a dictionary's memory; then their bytes are compared."""

    def __init__(self, limit: int = MEMO_BYTES):
        self.limit = limit
        self.hashes, self.entries = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.text, self.text_ends = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)
        self.met = np.empty(0, bool)

    @staticmethod
    def hashed(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = np.diff(ends)
        place = np.arange(len(flat)) - np.repeat(ends[:-1], sizes)
        made = np.add.reduceat((flat + np.uint64(1)) * _POWERS[place], ends[:-1]) if len(sizes) else np.empty(0, np.uint64)
        return (made ^ made >> np.uint64(29)) * _POWERS[0]

    def find(self, flat: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The words' entries, -1 where there is none."""
        out = np.full(len(hashes), -1)
        if not len(self.hashes) or not len(hashes):
            return out
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        entry, sizes = self.entries[at], np.diff(ends)
        own = self.text_ends[entry]
        k = np.flatnonzero((self.hashes[at] == hashes) & (self.text_ends[entry + 1] - own == sizes))
        if len(k):
            same = gathered(self.text, own[k], sizes[k]) == gathered(flat, ends[k], sizes[k])
            k = k[np.logical_and.reduceat(same, np.cumsum(sizes[k]) - sizes[k])]
            out[k] = entry[k]
            self.met[entry[k]] = True
        return out

    def add(self, flat: np.ndarray, ends: np.ndarray, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Entries of new words; those before keep theirs until ``shrink``."""
        entries = len(self.met) + np.arange(len(hashes))
        self.text, self.text_ends = np.concatenate([self.text, flat]), np.concatenate([self.text_ends, self.text_ends[-1] + ends[1:]])
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.met = np.concatenate([self.met, np.zeros(len(hashes), bool)])
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.entries = np.insert(self.hashes, at, hashes[order]), np.insert(self.entries, at, entries[order])
        return entries

    def size(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.entries, self.text, self.text_ends, self.ids, self.ends, self.met))

    def shrink(self) -> None:
        """Beyond the limit only words that were met again stay; none, if that leaves too many."""
        if self.size() <= self.limit:
            return
        stay = np.flatnonzero(self.met & (np.diff(self.text_ends) <= MEMO_CHARS))
        if 2 * len(stay) > len(self.met):
            stay = stay[:0]
        number = np.full(len(self.met), -1)
        number[stay] = np.arange(len(stay))
        kept = number[self.entries] >= 0
        self.hashes, self.entries = self.hashes[kept], number[self.entries[kept]]
        sizes = np.diff(self.text_ends)[stay]
        self.text, self.text_ends = gathered(self.text, self.text_ends[stay], sizes), np.concatenate([[0], np.cumsum(sizes)])
        sizes = np.diff(self.ends)[stay]
        self.ids, self.ends = gathered(self.ids, self.ends[stay], sizes), np.concatenate([[0], np.cumsum(sizes)])
        self.met = np.zeros(len(stay), bool)


class Encoded:
    """Ids of texts: ``encode`` gives the ids of each of a list of chunks, once for each different word that the memo holds.

    A batch of texts is split at its spaces and its different words numbered by
    Arrow; the ids of all words are gathered at once.
    """

    def __init__(self, encode: Callable[[list[str]], list], before: str = " "):
        self.encode, self.before, self.memo = encode, before, Memo()

    def made(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' ids, joined, and how many each has."""
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(chunks), GROUP):
            found = self.encode(chunks[i : i + GROUP])
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words after a space: an array, and where in it each word's begin and how many they are."""
        self.memo.shrink()
        flat, ends = bytes_of(words)
        # longer words come after those that the memo keeps
        short = np.flatnonzero(np.diff(ends) <= MEMO_CHARS)
        sizes = np.diff(ends)[short]
        texts, places = gathered(flat, ends[short], sizes), np.concatenate([[0], np.cumsum(sizes)])
        hashes = self.memo.hashed(texts, places)
        entry = self.memo.find(texts, places, hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            ids, counts = self.made([self.before + w for w in words.take(pa.array(short[new])).to_pylist()])
            own = gathered(texts, places[new], sizes[new])
            entry[new] = self.memo.add(own, np.concatenate([[0], np.cumsum(sizes[new])]), hashes[new], ids, counts)
        starts, lengths = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[short] = self.memo.ends[entry]
        lengths[short] = self.memo.ends[entry + 1] - starts[short]
        long = np.flatnonzero(np.diff(ends) > MEMO_CHARS)
        ids = self.memo.ids
        if len(long):
            more, lengths[long] = self.made([self.before + w for w in words.take(pa.array(long)).to_pylist()])
            starts[long] = len(ids) + np.cumsum(lengths[long]) - lengths[long]
            ids = np.concatenate([ids, more])
        return ids, starts, lengths

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null is empty."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy()
        bounds = bounds - bounds[0]
        numbered = split.flatten().dictionary_encode()
        at, words = numbered.indices.to_numpy(), numbered.dictionary
        begin, n = bounds[:-1], len(words)
        rest = np.ones(len(at), bool)
        rest[begin] = False
        used = np.zeros(n, bool)
        used[at[rest]] = True
        # a word that is empty or begins with white space stands for no chunk
        odd = pc.or_(pc.equal(words, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1))).to_numpy(zero_copy_only=False)
        odd |= pc.match_substring_regex(words, r"^[\x1c-\x1f\x{85}]").to_numpy(zero_copy_only=False)
        where = np.flatnonzero(used & ~odd)
        ids, word_starts, word_sizes = self.words(words.take(pa.array(where)))
        # the words that begin texts have no space before them
        first, opening = np.unique(at[begin], return_inverse=True)
        more, sizes = self.made(words.take(pa.array(first)).to_pylist())
        starts, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        starts[where], counts[where] = word_starts, word_sizes
        start, size = starts[at], counts[at]
        start[begin], size[begin] = (len(ids) + np.cumsum(sizes) - sizes)[opening], sizes[opening]
        every = gathered(np.concatenate([ids, more]), start, size)
        cuts = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
        out = [every[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        for k in np.flatnonzero(np.logical_or.reduceat(odd[at] & rest, begin)).tolist():
            out[k] = self.made(_CUT.split(texts[k].as_py()))[0]
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text]))[0]
