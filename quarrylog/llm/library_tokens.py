"""Token ids as the tokenizers library gives them, each different word encoded once as long as it is remembered."""

from __future__ import annotations

import json
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chunks import GROUP, Encoded, bytes_of, gathered
from .vocabulary import byte_chars, tokenizer

STOPS = tuple(".,;:")
#: Bytes of letters: ASCII ones, and two-byte characters from U+00C0 to U+027F and from U+0400 to U+047F, all Latin or Cyrillic letters but for SIGNS.
LETTER = np.zeros(256, bool)
LETTER[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0xC0), *range(0xC3, 0xCA), 0xD0, 0xD1]] = True
#: Bytes that begin other characters than those and ASCII.
OTHER = (np.arange(256) > 0x7F) & ~LETTER
#: The signs of multiplication and division, and a letter whose lower case has a mark.
SIGNS = np.array([int.from_bytes(x.encode()) for x in "×÷İ"], np.uint16)
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def library_ids(path: str, texts: list[str]) -> list[list[int]]:
    return [x.ids for x in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


class Words:
    """Ids of chunks.  ASCII words, with a stop or without, are whole pieces and go to the library's model at once; all else goes through its whole pipeline."""

    def __init__(self, path: str, before: str, lower: bool):
        self.path, self.before, self.lower = path, before, lower
        self.mapped = "".join(byte_chars()[b] for b in before.encode())
        self.model = tokenizer(path).model
        self.stops = {x: tuple(library_ids(path, [x])[0]) for x in STOPS}

    def __call__(self, chunks: list[str]) -> list[list[int]]:
        out, rest, skip, mapped, tokenize = [], [], len(self.before), self.mapped, self.model.tokenize
        for k, chunk in enumerate(chunks):
            word, stop = chunk[skip:], ()
            if chunk[:skip] == self.before and word.isascii():
                if word[-1:] in STOPS:
                    word, stop = word[:-1], self.stops[word[-1]]
                if word.isalpha():
                    out.append([*[t.id for t in tokenize(mapped + (word.lower() if self.lower else word))], *stop])
                    continue
            out.append([])
            rest.append(k)
        if rest:
            for k, ids in zip(rest, library_ids(self.path, [chunks[k] for k in rest]), strict=True):
                out[k] = ids
        return out


class Pieces(Encoded):
    """For vocabularies of lower-case words that drop white space.  Words are cut where letters end or begin, and only their lower-case pieces are encoded and remembered: with a stop, a line's end or capitals a word costs no more.

    No piece of the split pattern spans a cut: only contractions go from another
    character, the apostrophe, to letters.  Words with characters beyond those
    of LETTER, which may be marks that change the letter before them, and words
    that hold an added token's string stay whole.
    """

    def __init__(self, path: str):
        super().__init__(None, "")
        self.path = path
        made = json.loads(tokenizer(path).to_str())
        self.added = [x["content"] for x in made["added_tokens"]]
        # a word's last token alone has the suffix
        self.ends = np.zeros(tokenizer(path).get_vocab_size(), bool)
        self.ends[[i for t, i in made["model"]["vocab"].items() if t.endswith(made["model"]["end_of_word_suffix"])]] = True

    def made(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = np.fromiter(map(str.isalpha, chunks), bool, len(chunks))
        ids, sizes = [np.empty(0, np.uint32)], np.zeros(len(chunks), np.int64)
        for which, joined in ((np.flatnonzero(letters), True), (np.flatnonzero(~letters), False)):
            for i in range(0, len(which), GROUP):
                at = which[i : i + GROUP]
                some = [chunks[k] for k in at.tolist()]
                if joined:
                    found = np.array(library_ids(self.path, [" ".join(some)])[0], np.uint32)
                    last = np.flatnonzero(self.ends[found])
                    # a word has one piece at least, so all have one
                    if len(last) == len(some):
                        ids.append(found)
                        sizes[at] = np.diff(last, prepend=-1)
                        continue
                found = library_ids(self.path, some)
                sizes[at] = [len(x) for x in found]
                ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[at].sum())))
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        starts = np.empty(len(chunks), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return gathered(np.concatenate(ids), starts, sizes), sizes

    def cut(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words' pieces, and how many each word has."""
        flat, ends = bytes_of(words)
        begin, sizes = ends[:-1], np.diff(ends)
        some = np.flatnonzero(sizes)
        if not len(some):
            return pa.array([], pa.string()), np.zeros(len(words), np.int64)
        odd = OTHER[flat]
        odd[1:] |= np.isin(flat[:-1].astype(np.uint16) << 8 | flat[1:], SIGNS)
        whole = np.zeros(len(words), bool)
        whole[some] = np.logical_or.reduceat(odd, begin[some])
        for x in self.added:
            whole |= pc.match_substring(words, x).to_numpy(zero_copy_only=False)
        whole = np.repeat(whole, sizes)
        letter = LETTER[flat]
        first = np.zeros(len(flat), bool)
        first[1:] = (letter[1:] != letter[:-1]) & ~whole[1:] & (flat[:-1] != ord("'"))
        first[begin[some]] = True
        at = np.append(np.flatnonzero(first), len(flat)).astype(np.int32)
        counts = np.zeros(len(words), np.int64)
        counts[some] = np.add.reduceat(first, begin[some], dtype=np.int64)
        lower = np.where(whole, flat, LOWER[flat])
        return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(lower)]), counts

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        bounds = split.offsets.to_numpy()
        numbered = split.flatten().dictionary_encode()
        pieces, counts = self.cut(numbered.dictionary)
        pieces = pieces.dictionary_encode()
        ids, starts, sizes = self.words(pieces.dictionary)
        at = pieces.indices.to_numpy()
        # the ids of each different word, joined
        sizes = sizes[at]
        ids = gathered(ids, starts[at], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        at = numbered.indices.to_numpy()
        sizes = np.diff(ends)[at]
        every = gathered(ids, ends[at], sizes)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[bounds - bounds[0]].tolist()
        return [every[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]


@cache
def byte_level(path: str) -> Encoded:
    """For byte-level vocabularies, whose pieces keep the space before a word."""
    return Encoded(Words(path, " ", False))


@cache
def word_level(path: str) -> Encoded:
    """For vocabularies of lower-case words that drop white space."""
    return Pieces(path)


def batch_ids(encoder: Encoded, texts, end: int) -> list[np.ndarray]:
    """Ids of each text, then the end id; a null text has the end id alone."""
    return [np.append(x, np.uint32(end)).astype("<u4") for x in encoder.batch(texts)]
