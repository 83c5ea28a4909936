"""Token counts without token ids: byte-pair merging over a heap and a linked list.

A piece starts as one symbol a byte.  The lowest-rank adjacent pair, leftmost
among equals, is popped and merged until none is left; every merge takes away
one symbol, so the count is the bytes minus the merges.  Symbols are numbered by
byte and by the merge that makes them; no token id is looked up.

Defined results: a null or empty text has no bytes and no tokens; a null doc_id
passes through; repeated rows are counted each; pairs of equal rank merge from
the left; the strings of added tokens inside a text are one token each; an empty
table gives an empty result; extra columns are ignored, whatever their names; a
very long text is counted whole, word by word.
"""

from __future__ import annotations

import re
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .chunks import ROWS, Encoded, Pieces, pieces_of
from .common import documents
from .vocabulary import byte_chars, json_model

LIMIT = 1024


class Counter:
    """Counts tokens of texts under the merges of one vocabulary file."""

    def __init__(self, path: str):
        _, merges, added = json_model(path)
        # symbols are numbered by byte, then in the order of the merges that make them
        number = {byte_chars()[b]: b for b in range(256)}
        for a, b in merges:
            number.setdefault(a + b, len(number))
        self.pairs = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in enumerate(merges)}
        self.added = re.compile("|".join(re.escape(x) for x in added)) if added else None
        self.piece = Pieces(self.merge)
        #: a chunk's one number is its count
        self.chunks = Encoded(lambda chunks: [[sum(map(self.piece, pieces_of(chunk)))] for chunk in chunks])

    def merge(self, piece: bytes) -> int:
        """Symbols left of ``piece``: its bytes minus the merges."""
        n, pairs = len(piece), self.pairs
        symbol = list(piece)
        heap = [(pair[0], i, pair[1], symbol[i], symbol[i + 1]) for i in range(n - 1) if (pair := pairs.get((symbol[i], symbol[i + 1])))]
        if not heap:
            return n
        heapify(heap)
        after, before, merged = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _, i, made, a, b = heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = made, -1
            merged += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if pair := pairs.get((made, symbol[k])):
                    heappush(heap, (pair[0], i, pair[1], made, symbol[k]))
            h = before[i]
            if h >= 0 and (pair := pairs.get((symbol[h], made))):
                heappush(heap, (pair[0], h, pair[1], symbol[h], made))
        return n - merged

    def batch(self, texts: pa.Array) -> list[int]:
        """Tokens of each text; a null has none."""
        out = [int(x.sum()) for x in self.chunks.batch(texts)]
        if self.added:
            for k in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, self.added.pattern), False)).tolist():
                text = texts[k].as_py()
                out[k] = len(self.added.findall(text)) + sum(self.batch(pa.array(self.added.split(text)))) if self.added.split(text) != [text] else out[k]
        return out

    def __call__(self, text: str) -> int:
        return self.batch(pa.array([text]))[0]


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit under the vocabulary file at ``path``."""

    def make():
        count = counter(path)

        def run(part):
            texts = part.column(1)
            n = count.batch(texts)
            return [part.column(0), pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64()), n, [x > limit for x in n]]

        return run

    return map_texts(docs.select("doc_id", F.col("text")), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make, **ROWS)


def op4_token_counts(spark, sf_dir):
    """doc_id, n_bytes, n_tokens and over_limit of every whole text of ``documents``."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
