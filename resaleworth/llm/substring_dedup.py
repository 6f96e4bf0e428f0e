"""Substring dedup: words inside a passage that also starts somewhere else are removed.

Level-wise doubling. A passage is a window of ``window`` words. Its anchor is the start of the half-window inside
it whose hash is smallest (the first of equals), so equal windows have equal anchors, and a tenth of all positions
are anchors. At each length (a quarter, a half, the whole) only what occurred twice at the length before is looked at:

- quarter: anchors whose first quarter-window occurs at one place only go. This is the only level that moves a row per anchor.
- half: the same with half-windows.
- whole: windows that share an anchor lie side by side, as one run. Runs that are equal as a whole are repeated as a whole
  and need no row per window. What is left are runs at the edges of repeated passages; they are compared window by
  window, with one stand-in for each group of equal runs. So a passage that very many documents share costs one stand-in.

Counting is by aggregates with map-side merging; joins bring back rows to keys that occur once on the other side, so AQE
can split hot ones. Texts move twice, compressed: to hash the windows of edge runs, and to lose their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from resaleworth.llm.text import encoded, fresh, map_batches, mixed, word_hashes
from resaleworth.session import materialise

# Words whose windows are hashed at once; longer texts go through in steps.
STEP = 1 << 18
_BASE = 0xD1342543DE82EF95


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Hashed:
    """Hashes of any run of the words of some texts, from sums of powers."""

    def __init__(self, words: np.ndarray):
        # Sizes are rounded up, so that few tables are made.
        up, self.down = _powers(1 << len(words).bit_length())
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + np.uint64(salt))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :])


def anchored_runs(words: np.ndarray, texts: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows with one anchor: text, first and last window, and the hashes of the three lengths.

    ``texts`` gives the number of the text of each word; windows never cross texts.
    """
    half, n = math.ceil(window / 2), len(words)
    quarter = math.ceil(half / 2)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return {name: none for name in ("text", "lo", "hi", "quarter", "half", "whole")}
    hashed, places = Hashed(words), np.arange(n - half + 1)
    halves = hashed.runs(places, places + half, 1)
    # The place in the low bits makes the first of equals the smallest.
    ranked = (mixed(halves) & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    anchor = (_smallest(ranked, window - half + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = texts[: n - window + 1] == texts[window - 1 :]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return {name: none for name in ("text", "lo", "hi", "quarter", "half", "whole")}
    own = anchor[starts]
    first = np.concatenate(([True], (np.diff(own) != 0) | (np.diff(starts) != 1)))
    lo, hi, at = starts[first], starts[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(starts) - 1]))], own[first]
    return {
        "text": texts[lo],
        "lo": lo,
        "hi": hi,
        "quarter": hashed.runs(at, at + quarter, 2).view(np.int64),
        "half": halves[at].view(np.int64),
        "whole": hashed.runs(lo, hi + window, 3).view(np.int64),
    }


def _steps(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of several texts together, or of a part of a long one: hashes, text number, place in its text."""
    parts, size = [], 0

    def together():
        number = np.repeat([i for i, _ in parts], [len(w) for _, w in parts])
        place = np.concatenate([np.arange(len(w)) for _, w in parts])
        return np.concatenate([w for _, w in parts]), number, place

    for i, words in enumerate(word_hashes(texts, lower=False)):
        if len(words) < window:
            continue
        if len(words) > STEP:
            for at in range(0, len(words) - window + 1, STEP):
                part = words[at : at + STEP + window - 1]
                yield part, np.full(len(part), i), np.arange(at, at + len(part))
            continue
        if size + len(words) > STEP:
            yield together()
            parts, size = [], 0
        parts.append((i, words))
        size += len(words)
    if parts:
        yield together()


def _key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row: rows that repeat an id are told apart by their texts."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def _pressed(texts: pa.Array) -> list[bytes | None]:
    """Texts as they move: compressed one by one."""
    press = zstandard.ZstdCompressor(level=3)
    return [None if text is None else press.compress(text.encode()) for text in texts.to_pylist()]


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    def find(batch: pa.RecordBatch) -> dict[str, list]:
        docs, out = batch["doc"].to_numpy(), {n: [] for n in ("doc", "lo", "hi", "quarter", "half", "whole")}
        with np.errstate(over="ignore"):
            for words, number, place in _steps(encoded(batch["text"].to_pylist()), window):
                runs = anchored_runs(words, number, window)
                out["doc"].append(docs[runs["text"]])
                out["lo"].append(place[runs["lo"]].astype(np.int32))
                out["hi"].append(place[runs["hi"]].astype(np.int32))
                for name in ("quarter", "half", "whole"):
                    out[name].append(runs[name])
        return {name: np.concatenate(parts) if parts else [] for name, parts in out.items()}

    return map_batches(rows, find, "doc long, lo int, hi int, quarter long, half long, whole long")


def _edge_windows(rows: DataFrame, edges: DataFrame, window: int) -> DataFrame:
    """(doc, at, half, whole, judged) for each window of the runs in ``edges``."""
    runs = edges.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "half", "judged")).alias("runs"))

    def windows(batch: pa.RecordBatch) -> dict[str, list]:
        out = {n: [] for n in ("doc", "at", "half", "whole", "judged")}
        unpack = zstandard.ZstdDecompressor()
        with np.errstate(over="ignore"):
            for doc, packed, wanted in zip(batch["doc"].to_pylist(), batch["packed"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                hashed = Hashed(next(word_hashes([unpack.decompress(packed)], lower=False)))
                sizes = [run["hi"] - run["lo"] + 1 for run in wanted]
                at = np.concatenate([np.arange(run["lo"], run["hi"] + 1) for run in wanted])
                out["doc"].append(np.full(len(at), doc))
                out["at"].append(at.astype(np.int32))
                out["half"].append(np.repeat(np.array([run["half"] for run in wanted], dtype=np.int64), sizes))
                out["whole"].append(hashed.runs(at, at + window, 4).view(np.int64))
                out["judged"].append(np.repeat([run["judged"] for run in wanted], sizes))
        return {name: np.concatenate(parts) if parts else [] for name, parts in out.items()}

    packed = map_batches(rows, lambda batch: {"doc": batch["doc"], "packed": _pressed(batch["text"])}, "doc long, packed binary")
    return map_batches(packed.join(runs, "doc"), windows, "doc long, at int, half long, whole long, judged boolean")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """(doc, lo, hi): runs of windows, by the place of their first word, whose words also start somewhere else."""
    if window < 4:
        raise ValueError("a window has four words at least")
    rows = docs.select(_key(id_col, text_col).alias("doc"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    anchors = _anchors(rows, window)
    twice = anchors.groupBy("quarter").agg(F.count("*").alias("n")).where("n > 1").select("quarter")
    found = materialise(anchors.join(twice, "quarter").drop("quarter"), "quarters")
    place = F.struct("doc", "lo", "hi")
    equal = found.groupBy("half", "whole").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    equal = materialise(equal, "halves")
    again = equal.where("n > 1").select("half", "whole")
    as_a_whole = found.join(again, ["half", "whole"]).select("doc", "lo", "hi")
    # A half-window at two places or more, one of which at least is in a run of its own.
    open_halves = equal.groupBy("half").agg(F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("single"))
    open_halves = open_halves.where("all > 1 AND single > 0").select("half")
    edges = equal.join(open_halves, "half").select("first.*", "half", (F.col("n") == 1).alias("judged"))
    windows = materialise(_edge_windows(rows, edges, window), "windows")
    more = windows.groupBy("half", "whole").agg(F.count("*").alias("n")).where("n > 1").select("half", "whole")
    one_by_one = windows.where("judged").join(more, ["half", "whole"]).select("doc", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return as_a_whole.unionByName(one_by_one)


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``docs`` without the words of repeated windows; ``n_words`` (before) and ``n_removed`` are added.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]``, unchanged. A window of ``window`` words whose words also
    start anywhere else, in the same text or another, is removed; windows are judged on the input. The words that
    stay are joined by one space.

    Null text: no words, and null stays. An empty text or one that loses all words becomes empty. Texts of fewer words than a
    window lose none. Rows that repeat an id are rows of their own; equal texts of enough words lose all of theirs,
    since each occurs in the other. Rows without an id count like any other. Columns named ``n_words`` or ``n_removed``
    are replaced; all others stay.
    """
    lost = repeated_windows(docs, id_col, text_col, window)
    doc, runs = fresh(docs, "_doc"), fresh(docs, "_runs")
    # No more than one entry per word of the text.
    per_doc = lost.groupBy(F.col("doc").alias(doc)).agg(F.collect_set(F.struct("lo", "hi")).alias(runs))
    kept = [f for f in docs.schema if f.name.lower() not in ("n_words", "n_removed")]
    names = [f.name for f in kept]
    moved = docs.select(*[F.col(f"`{name}`") for name in names], _key(id_col, text_col).alias(doc))
    packed = StructType([StructField(f.name, BinaryType()) if f.name == text_col else f for f in moved.schema])

    def pack(batch: pa.RecordBatch) -> dict[str, Any]:
        return {**{name: batch[name] for name in batch.schema.names}, text_col: _pressed(batch[text_col])}

    def rebuild(batch: pa.RecordBatch) -> dict[str, Any]:
        unpack = zstandard.ZstdDecompressor()
        texts, counts, removed = [], [], []
        for text, gone in zip(batch[text_col].to_pylist(), batch[runs].to_pylist(), strict=True):
            words = [] if text is None else unpack.decompress(text).split()
            depth = np.zeros(len(words) + 1, dtype=np.int64)
            for run in gone or ():
                depth[run["lo"]] += 1
                depth[run["hi"] + window] -= 1
            stay = np.cumsum(depth)[:-1] == 0
            left = words if stay.all() else [words[i] for i in np.flatnonzero(stay).tolist()]
            texts.append(None if text is None else b" ".join(left).decode())
            counts.append(len(words))
            removed.append(len(words) - len(left))
        return {**{name: batch[name] for name in names}, text_col: texts, "n_words": counts, "n_removed": removed}

    joined = map_batches(moved, pack, packed).join(per_doc, doc, "left").select(*[F.col(f"`{name}`") for name in [*names, runs]])
    return map_batches(joined, rebuild, StructType([*kept, StructField("n_words", LongType()), StructField("n_removed", LongType())]))
