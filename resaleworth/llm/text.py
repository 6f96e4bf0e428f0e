"""Arrow batches of documents, ASCII words and their hashes.

A word is a run of characters outside ``[\\x20\\x09-\\x0D]``, with A-Z in lower case. On UTF-8
bytes ``lower()`` and ``split()`` mean exactly that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from resaleworth.session import configure

# Bytes hashed at once; longer texts are hashed in pieces that end between words.
PIECE = 1 << 18
SPACES = " \t\n\x0b\x0c\r"
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


# Rows and bytes that reach a Python worker at once: it holds several copies of a batch, and documents can be long.
ARROW_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def text_session(spark: SparkSession) -> SparkSession:
    """The library's settings, and small batches for Python."""
    for key, value in ARROW_CONF.items():
        configure(spark).conf.set(key, value)
    return spark


def arrow_schema(df: DataFrame, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns the columns of ``schema`` by name, as values or Arrow arrays."""
    arrow = arrow_schema(df, schema)

    def column(values: Any, kind: pa.DataType) -> pa.Array:
        return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch)
                yield pa.record_batch([column(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    return [b"" if text is None else text.encode() for text in texts]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a value for each byte."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(PIECE + 1, base, dtype=np.uint64), np.full(PIECE + 1, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    values = np.random.default_rng(20240901).integers(1, 1 << 63, 256, dtype=np.uint64)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), values


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_endings(data: bytes) -> np.ndarray:
    """The last four bytes of each word, the last one first, as one number; so like endings are near in order."""
    raw = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _WHITE[raw], [True]))))
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), dtype=np.int64)
    for back in range(1, 5):
        at = ends - back
        out = (out << 8) | np.where(at >= starts, raw[np.maximum(at, 0)], 0)
    return out


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) > PIECE:  # one word, or words longer than a piece: rare, hashed by the same sum in steps
        return _hash_long(raw)
    up, down, values = _powers()
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _WHITE[raw], [True]))))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def _hash_long(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, _, values = _powers()
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _WHITE[raw], [True]))))
    hashes = []
    for start, end in zip(edges[::2], edges[1::2], strict=True):
        total, scale = np.uint64(0), np.uint64(1)
        for at in range(start, end, PIECE):
            part = raw[at : min(at + PIECE, end)]
            total = total + scale * np.sum(values[part] * up[: len(part)], dtype=np.uint64)
            scale = scale * up[PIECE]
        hashes.append(total)
    return mixed(np.array(hashes, dtype=np.uint64)), edges[::2]


def word_hashes(texts: list[bytes], lower: bool = True) -> Iterator[np.ndarray]:
    """The 64-bit hashes of the words of each text, in order. Memory: a piece, plus 8 bytes a word of one text."""
    folded = bytes.lower if lower else bytes
    with np.errstate(over="ignore"):
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size == 0 or size + len(texts[end]) + 1 <= PIECE):
                size += len(texts[end]) + 1
                end += 1
            if size <= PIECE:
                group = texts[at:end]
                hashes, starts = _hash_piece(folded(b"\n".join(group)))
                bounds = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group])[:-1])
                yield from np.split(hashes, bounds)
            else:
                yield np.concatenate([_hash_piece(p)[0] for p in _pieces(folded(texts[at]))])
            at = end


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            cut = max(text.rfind(bytes((c,)), at + 1, end) for c in (9, 10, 11, 12, 13, 32))
            if cut < 0:
                found = [i for c in (9, 10, 11, 12, 13, 32) if (i := text.find(bytes((c,)), end)) >= 0]
                cut = min(found, default=len(text))
            end = cut
        yield text[at:end]
        at = end


def shingle_hashes(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of k-word shingles, and the word at which each starts first.

    All words are one shingle if there are fewer than k; without words there is none.
    """
    if not len(words):
        return words, np.zeros(0, dtype=np.int64)
    n = max(1, len(words) - k + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(k, len(words)), dtype=np.uint64)
        for i in range(min(k, len(words))):
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    return np.unique(out, return_index=True)


def tagged(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns of ``df``, under names of our own, so that clashing extra columns never matter."""
    return df.select([F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_columns(df: DataFrame, new: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the new columns last; columns of those names, in any case, give way to them."""
    gone = {c.lower() for c in (*new, *drop)}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]
    return df.select(*kept, *[value.alias(name) for name, value in new.items()])
