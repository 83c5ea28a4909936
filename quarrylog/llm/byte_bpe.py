"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding.  Rank-order merging obeys a local rule: a sequence of tokens is the
encoding of its bytes exactly if each token encodes to itself and each adjacent
pair encodes to that pair.  So a nondeterministic transducer reads a token's
bytes along the vocabulary's trie and may enter the next token only if the pair
is stable.  Determinised on demand, a state is the set of open hypotheses: a
trie node, the last whole token, and the tokens that are whole but not yet
certain.  Tokens shared by all hypotheses are emitted at once; no hypothesis
lives longer than the longest token, which bounds the lookahead.

Decoding.  Token bytes drive a UTF-8 automaton that emits the bytes of whole
characters and carries an unfinished one over to the next token.

Defined results: a null text is empty; an empty text has no ids; bytes that the
vocabulary can't spell raise; a null doc_id passes through; repeated rows are
encoded each; an empty table gives an empty result; extra columns are ignored,
whatever their names; a very long text is encoded whole, its words one by one.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .arrow import map_texts
from .chunks import ROWS, Encoded, Pieces, pieces_of
from .common import documents
from .vocabulary import ranks

#: Determinised states that are kept; beyond that all are forgotten and made anew.
MAX_STATES = 120_000


class Transducer:
    def __init__(self, vocabulary: dict[bytes, int]):
        self.ranks = vocabulary
        self.tokens = {i: b for b, i in vocabulary.items()}
        self.stable: dict[int, bool] = {}  # a << 32 | b ->
        # the trie: node -> {byte: node}, node -> token; and the halves that a token's last merge joins
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.halves: dict[int, tuple[int, int]] = {}
        for piece, i in vocabulary.items():
            if not self.reachable(piece, i):
                continue
            node = 0
            for b in piece:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = self.next[node][b]
            self.token[node] = i
        self.right, self.left = {}, {}
        self.forget()

    def reachable(self, piece: bytes, i: int) -> bool:
        """Whether merging makes the token of its own bytes; keeps its halves."""
        if len(piece) == 1:
            return True
        parts, known = [piece[k : k + 1] for k in range(len(piece))], self.ranks
        while len(parts) > 2:
            rank, at = min((known.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.halves[i] = (known[parts[0]], known[parts[1]])
        return True

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The symbols that stand at a token's left (0) or right (1) edge while it is merged, each with the rank that ends it."""
        out = [(self.tokens[token], 1 << 60)]
        while token in self.halves:
            rank, token = token, self.halves[token][side]
            out.append((self.tokens[token], rank))
        return out[::-1]

    def follows(self, a: int, b: int) -> bool:
        """Whether no merge joins token a to token b: at no time is the pair at their border the next to merge."""
        if a < 0:
            return True
        key = a << 32 | b
        known = self.stable.get(key)
        if known is not None:
            return known
        if len(self.stable) > 2 * MAX_STATES:
            self.stable.clear()
        xs = self.right.get(a) or self.right.setdefault(a, self.edge(a, 1))
        ys = self.left.get(b) or self.left.setdefault(b, self.edge(b, 0))
        i = j = 0
        ok = True
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            joined = self.ranks.get(x + y, 1 << 60)
            # at equal ranks the leftmost pair goes first
            if joined < x_ends and joined <= y_ends and joined != 1 << 60:
                ok = False
                break
            if x_ends == y_ends == 1 << 60:
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        self.stable[key] = ok
        return ok

    def forget(self) -> None:
        self.numbers = {(start := ((0, -1, ()),)): 0}
        self.states = [start]
        self.steps: dict[int, tuple[int, tuple]] = {}  # state * 256 + byte ->

    def step(self, state: int, byte: int) -> tuple[int, tuple]:
        """The next state and the tokens that are now certain, worked out once for each state and byte.

        Hypotheses are in the order of where their open token begins.  Bytes
        have one encoding, so at most one of them becomes whole.
        """
        reached, whole = [], None
        following, tokens, stable = self.next, self.token, self.stable
        for node, last, pending in self.states[state]:
            to = following[node].get(byte)
            if to is None:
                continue
            if following[to]:
                reached.append((to, last, pending))
            token = tokens[to]
            if token >= 0 and whole is None:
                joins = stable.get(last << 32 | token)
                if self.follows(last, token) if joins is None else joins:
                    whole = (0, token, (*pending, token))
        if whole:
            reached.append(whole)
        if not reached:
            raise ValueError("the vocabulary can't spell this text")
        first = reached[0][2]
        n = len(first)
        for _, _, p in reached:
            n = min(n, len(p))
            while n and p[:n] != first[:n]:
                n -= 1
            if not n:
                break
        made = tuple([(node, last, p[n:]) for node, last, p in reached]) if n else tuple(reached)
        number = self.numbers.get(made)
        if number is None:
            number = self.numbers[made] = len(self.states)
            self.states.append(made)
        self.steps[state << 8 | byte] = found = (number, first[:n])
        return found

    def end(self, state: int, byte: int) -> tuple:
        """What is still to emit if ``byte`` is the last."""
        for node, last, pending in self.states[state]:
            to = self.next[node].get(byte)
            if to is not None and self.token[to] >= 0 and self.follows(last, self.token[to]):
                return (*pending, self.token[to])
        raise ValueError("the vocabulary can't spell this text")

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece, which the split pattern has cut off."""
        if len(self.states) > MAX_STATES:
            self.forget()
        state, out, steps = 0, [], self.steps
        for byte in piece[:-1]:
            state, certain = steps.get(state << 8 | byte) or self.step(state, byte)
            if certain:
                out += certain
        return [*out, *self.end(state, piece[-1])]


@cache
def transducer(path: str) -> Transducer:
    return Transducer(ranks(path))


@cache
def encoder(path: str) -> Encoded:
    piece = Pieces(transducer(path).encode)
    return Encoded(lambda chunks: [[i for x in pieces_of(chunk) for i in piece(x)] for chunk in chunks])


def encode(path: str, text: str) -> np.ndarray:
    """Ids of a whole text."""
    return encoder(path)(text)


#: The automaton of well-formed UTF-8.  State -> [(first byte, last byte, next state)]; 0 is between characters.
UTF8 = {
    0: [(0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)],
    1: [(0x80, 0xBF, 0)],
    2: [(0xA0, 0xBF, 1)],
    3: [(0x80, 0xBF, 1)],
    4: [(0x80, 0x9F, 1)],
    5: [(0x90, 0xBF, 3)],
    6: [(0x80, 0xBF, 3)],
    7: [(0x80, 0x8F, 3)],
}
BAD = 8


class Decoder:
    """Streaming decoder: ``feed`` ids as they come, get the bytes of the characters that are whole by then.

    A token takes the automaton from state to state; that is worked out once for
    each token and state, and whole tokens are known to leave it between
    characters if they find it there.  A byte that can't follow ends what is
    pending and is looked at again between characters; such bytes pass as they
    are, and become U+FFFD where text is made of them.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.table = np.full((8, 256), BAD, np.uint8)
        for state, ways in UTF8.items():
            for a, b, to in ways:
                self.table[state, a : b + 1] = to
        self.bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.known: dict[tuple[int, int], tuple[int, int]] = {}
        self.whole = np.array([self.step(0, i)[0] == 0 for i in range(len(self.bytes))])
        self.reset()

    def step(self, state: int, token: int) -> tuple[int, int]:
        """The state after the token, and how many of its bytes belong to a character that begins in it and is not whole; -1 if one from before still isn't."""
        key = state, token
        if (found := self.known.get(key)) is None:
            begun, piece = -1 if state else 0, self.bytes[token]
            for at, b in enumerate(piece):
                to = int(self.table[state, b])
                if to == BAD:
                    # what was pending is over; the byte may begin a character
                    to, begun = int(self.table[0, b]) % BAD, at
                elif not state:
                    begun = at
                state = to
            found = self.known[key] = (0, 0) if not state else (state, -1 if begun < 0 else len(piece) - begun)
        return found

    def reset(self) -> None:
        self.state, self.carried = 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        tokens = ids.tolist()
        state, pending, at = self.state, len(self.carried), 0
        loose = iter([*np.flatnonzero(~self.whole[ids]).tolist(), len(tokens)])
        while at < len(tokens):
            if not state:
                # whole tokens leave the automaton where it is
                at = next(k for k in loose if k >= at)
                pending = 0
                if at == len(tokens):
                    break
            state, begun = self.step(state, tokens[at])
            pending = pending + len(self.bytes[tokens[at]]) if begun < 0 else begun
            at += 1
        self.state = state
        pending = pending if state else 0
        data = self.carried + b"".join(map(self.bytes.__getitem__, tokens))
        self.carried = data[len(data) - pending :]
        return data[: len(data) - pending]

    def end(self) -> bytes:
        """What is left of a character that never became whole."""
        rest = self.carried
        self.reset()
        return rest


@cache
def decoder(path: str) -> Decoder:
    return Decoder(transducer(path).tokens)


#: Ids that the decoder is fed at once.
STREAM_IDS = 65_536


def decode(path: str, ids: np.ndarray) -> bytes:
    """The bytes of a whole stream of ids."""
    machine = decoder(path)
    machine.reset()
    return b"".join([*(machine.feed(ids[i : i + STREAM_IDS]) for i in range(0, len(ids), STREAM_IDS)), machine.end()])


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids``: the document's ids as little-endian unsigned 32-bit integers."""

    def make():
        encode = encoder(path)
        return lambda part: [part.column(0), [x.astype("<u4").tobytes() for x in encode.batch(part.column(1))]]

    return map_texts(docs.select("doc_id", "text"), "doc_id long, ids binary", make, **ROWS)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the ``data`` that they decode to: bytes, which are UTF-8 if the ids spell a text."""

    def make():
        return lambda part: [part.column(0), part.column(1), [decode(path, np.frombuffer(b or b"", "<u4")) for b in part.column(1).to_pylist()]]

    return map_texts(rows.select("doc_id", "ids"), "doc_id long, ids binary, data binary", make, **ROWS)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``decoded`` of ``encoded`` in one worker, so that its tables are held once a task."""

    def make():
        encode = encoder(path)

        def run(part):
            ids = encode.batch(part.column(1))
            return [part.column(0), [x.astype("<u4").tobytes() for x in ids], [decode(path, x) for x in ids]]

        return run

    return map_texts(docs.select("doc_id", "text"), "doc_id long, ids binary, data binary", make, **ROWS)


def op7_byte_bpe(spark, sf_dir):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text of ``documents``."""
    import public_tokenizers

    rows = round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return rows.selectExpr("doc_id", "cast(length(ids) / 4 as long) AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(data, 256) AS decoded_sha256")
