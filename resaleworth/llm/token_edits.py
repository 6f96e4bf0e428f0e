"""Edit-aware token counts: a segment tree of pre-token counts per document, mended where edits touch it.

A document's leaves are spans of about ``LEAF`` characters, cut where ids never join over the cut. The tree holds the
characters and tokens below each node. An edit finds its leaves by character position and replaces their text; where
the new text could join with a neighbour over the cut, the neighbour is taken in. Leaves that edits have touched are
encoded again once, when the count is asked for, and their sums change on the paths to the root.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from resaleworth.llm.text import fresh, with_columns
from resaleworth.llm.tokens import encode_text, parts

LEAF = 512
EDITS = "array<struct<start: long, end: long, new: string>>"


class TokenTree:
    """Counts of one text under edits. ``encoded`` is the number of characters encoded so far."""

    def __init__(self, text: str, path: str, leaf: int = LEAF) -> None:
        self.path, self.leaf, self.encoded = path, leaf, 0
        self._build(parts(text, leaf), [])
        self.changed = set(range(len(self.leaves)))

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = leaves
        self.width = width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.chars, self.tokens = np.zeros(2 * width, dtype=np.int64), np.zeros(2 * width, dtype=np.int64)
        self.chars[width : width + len(leaves)] = [len(leaf) for leaf in leaves]
        self.tokens[width : width + len(tokens)] = tokens
        while width > 1:
            for sums in (self.chars, self.tokens):
                sums[width // 2 : width] = sums[width : 2 * width].reshape(-1, 2).sum(axis=1)
            width //= 2

    def __len__(self) -> int:
        return int(self.chars[1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def count(self) -> int:
        """The number of tokens; encodes what has changed since it was asked last."""
        if len(self.changed) == len(self.leaves):  # all new: sums from below, not path by path
            self.encoded += len(self)
            self._build(self.leaves, [len(encode_text(text, self.path)) for text in self.leaves])
            self.changed = set()
        for leaf in self.changed:
            text = self.leaves[leaf]
            self.encoded += len(text)
            self._add(self.tokens, leaf, len(encode_text(text, self.path)) - self.tokens[self.width + leaf])
        self.changed = set()
        return int(self.tokens[1])

    def _add(self, sums: np.ndarray, leaf: int, more: int) -> None:
        node = self.width + leaf
        while node:
            sums[node] += more
            node //= 2

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and that leaf's first character. The end is in the last leaf with text."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.width, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end`` by ``new``. Places outside the text are moved to its ends."""
        start = max(0, min(start, len(self)))
        end = max(start, min(end, len(self)))
        first, before = self._find(start)
        last, behind = self._find(end)
        region = self.leaves[first][: start - before] + new + self.leaves[last][end - behind :]
        while first > 0 and not apart(self.leaves[first - 1], region):
            first -= 1
            region = self.leaves[first] + region
        while last + 1 < len(self.leaves) and not apart(region, self.leaves[last + 1]):
            last += 1
            region += self.leaves[last]
        if len(region) > 4 * self.leaf and len(cut := parts(region, self.leaf)) > 1:
            tokens = self.tokens[self.width : self.width + len(self.leaves)].tolist()
            moved = len(cut) - (last + 1 - first)
            self.changed = {i for i in self.changed if i < first} | {i + moved for i in self.changed if i > last}
            self.changed |= set(range(first, first + len(cut)))
            leaves = [*self.leaves[:first], *cut, *self.leaves[last + 1 :]]
            self._build(leaves, [*tokens[:first], *[0] * len(cut), *tokens[last + 1 :]])
            return
        for leaf, text in zip(range(first, last + 1), [region, *[""] * (last - first)], strict=True):
            self._add(self.chars, leaf, len(text) - len(self.leaves[leaf]))
            self.leaves[leaf] = text
            self.changed.add(leaf)


def apart(left: str, right: str) -> bool:
    """True if ids never join over this cut; not told for an empty side."""
    return bool(left) and len(right) > 1 and right[0] == " " and not right[1].isspace() and not left[-1].isspace()


def replacements(text: Column, patterns: Sequence[tuple[str, str, tuple[str, ...] | re.Pattern]]) -> Column:
    """The edits that put a fixed text for each match of the first pattern that matches there, last match first.

    A pattern is (expression, new text, needs): every match holds one of the texts ``needs``, or something that the
    expression ``needs`` finds. Only patterns whose needs a text holds are searched for in it, together.
    """

    def together(chosen: tuple[int, ...]) -> tuple[re.Pattern, list[str]]:
        if chosen not in known:
            known[chosen] = re.compile("|".join(f"({patterns[i][0]})" for i in chosen)), [patterns[i][1] for i in chosen]
        return known[chosen]

    def needed(needs: tuple[str, ...] | re.Pattern, value: str) -> bool:
        return any(part in value for part in needs) if isinstance(needs, tuple) else needs.search(value) is not None

    known: dict[tuple[int, ...], tuple[re.Pattern, list[str]]] = {}

    @F.pandas_udf(EDITS)
    def edits(texts: pd.Series) -> pd.Series:
        out = []
        for value in texts:
            chosen = tuple(i for i, (_, _, needs) in enumerate(patterns) if needed(needs, value or ""))
            if not chosen:
                out.append([])
                continue
            found, news = together(chosen)
            matches = [(m.start(), m.end(), news[m.lastindex - 1]) for m in found.finditer(value)]
            out.append([{"start": a, "end": b, "new": new} for a, b, new in reversed(matches)])
        return pd.Series(out)

    return edits(text)


def count_with_edits(docs: DataFrame, edits: Column, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_edits``, ``n_tokens_after``, ``n_encoded`` and ``edited_text``.

    ``edits`` is an array of (start, end, new) per row; places are characters of the text as the edits before have
    left it. ``n_encoded`` is the number of characters that were encoded again. Nothing moves between tasks.

    Null or empty text: no token; edits apply to an empty text. No or null edits change nothing; an edit with a null
    place or text is left out; places outside the text are moved to its ends. Columns of the five names are replaced.
    """

    @F.pandas_udf("n_tokens long, n_edits long, n_tokens_after long, n_encoded long, edited_text string")
    def counted(texts: pd.Series, changes: pd.Series) -> pd.DataFrame:
        rows = []
        for text, edits_ in zip(texts, changes, strict=True):
            tree = TokenTree(text or "", tokenizer)
            before, encoded = tree.count(), tree.encoded
            usable = [e for e in (() if edits_ is None else edits_) if e is not None and not any(map(pd.isna, e.values()))]
            for e in usable:
                tree.edit(int(e["start"]), int(e["end"]), e["new"])
            rows.append((before, len(usable), tree.count(), tree.encoded - encoded, tree.text))
        return pd.DataFrame(rows, columns=["n_tokens", "n_edits", "n_tokens_after", "n_encoded", "edited_text"])

    names = ("n_tokens", "n_edits", "n_tokens_after", "n_encoded", "edited_text")
    name = fresh(docs, "_counted")
    found = docs.withColumn(name, counted(F.col(f"`{text_col}`"), edits))
    return with_columns(found, {c: F.col(f"{name}.{c}") for c in names}, drop=(name,))
