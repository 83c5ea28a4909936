"""Public vocabularies, read on each worker by the path that the caller names."""

from __future__ import annotations

import base64
import json
from functools import cache


@cache
def ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def json_model(path: str) -> tuple[dict[str, int], list[list[str]], list[str]]:
    """Vocabulary, merges and the added tokens' strings of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
    return made["model"]["vocab"], merges, [x["content"] for x in made["added_tokens"]]


@cache
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)
