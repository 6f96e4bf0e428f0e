"""Ids by byte-level BPE, read from a ``tokenizers`` file.

Encoding runs on ``tiktoken`` with the merges of the same file, which gives the same ids several times faster;
``tokenizers`` itself takes the texts whose runs of white space are too long for the other's pattern matching.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import tiktoken

# Characters encoded at once; longer texts are cut at a space between two other characters, where ids never join.
LONGEST = 1 << 20
_LONG_RUN = re.compile(r"\s{2048}")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def load_tokenizer(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    added, bytes_of = {t["content"]: t["id"] for t in stored["added_tokens"]}, byte_characters()
    ranks = {bytes(bytes_of[c] for c in token): rank for token, rank in stored["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def _slow_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def boundary(text: str, at: int) -> int:
    """The first place from ``at`` on at a space between two other characters: ids never join over it.

    A pre-token has white space at its start or is nothing else, and only the last space of a run belongs to the
    word behind it.
    """
    at = max(at, 1)
    while 0 < (at := text.find(" ", at)) < len(text) - 1:
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at += 1
    return len(text)


def parts(text: str, longest: int) -> list[str]:
    """``text`` in parts of about ``longest`` characters that encode on their own."""
    out, at = [], 0
    while len(text) - at > longest:
        end = boundary(text, at + longest)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def encode_text(text: str, path: str) -> list[int]:
    """The ids of the whole text. The text of an added token gives its id, as ``tokenizers`` does by default."""
    out: list[int] = []
    for part in parts(text, LONGEST):
        if len(part) >= 2048 and _LONG_RUN.search(part):
            out += _slow_tokenizer(path).encode(part, add_special_tokens=False).ids
        else:
            out += load_tokenizer(path).encode(part, allowed_special="all")
    return out
