"""Packing by power-of-two decomposition: every sequence is one piece of one document.

A document's length is cut into full sequences and the powers of two of what remains, longest first. Pieces of
one length form a bucket, and a batch takes sequences of one bucket, so nothing is padded and no sequence crosses
documents. Tokens never move: the task that cuts a document also counts its pieces of each length, the pieces are stored once,
and the sums of these counts say where the numbers of each task begin.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from resaleworth.llm.text import arrow_schema, tagged
from resaleworth.llm.tokens import encode_text
from resaleworth.session import materialise

# Bytes of an id.
WIDTH = 4


def piece_lengths(total: int, limit: int) -> Iterator[int]:
    """``total`` as full sequences and descending powers of two. ``limit`` is a power of two."""
    yield from [limit] * (total // limit)
    rest = total % limit
    while rest:
        piece = 1 << (rest.bit_length() - 1)
        yield piece
        rest -= piece


def split_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, end_id: int = 1
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, part, nth): the pieces of every row, ids packed as little-endian 32-bit values.

    ``tokenizer`` is a file of the ``tokenizers`` library. A row's ids are those of its whole text and then ``end_id``. Null or empty text: the end alone. Repeated rows
    and null ids are cut like any other row. Other columns play no part. A piece is the ``nth`` of its length in the task ``part``.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("the longest sequence must be a power of two")
    rows = tagged(docs, {"doc_id": id_col, "text": text_col})
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, part int, nth long"
    arrow = arrow_schema(rows, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.array([*encode_text(text or "", tokenizer), end_id], dtype="<u4").tobytes()
                start, total = 0, len(ids) // WIDTH
                for length in piece_lengths(total, limit):
                    out.append((key, start, length, ids[start * WIDTH : (start + length) * WIDTH], total, part, seen[length]))
                    seen[length] += 1
                    start += length
            if out:
                yield pa.record_batch([pa.array(column, type=f.type) for column, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(cut, schema)


def number_sequences(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in place of ``part`` and ``nth``: ids run through the buckets, longest first, without a gap.

    So a bucket is a range of ids and a batch is any part of that range. Every piece is a sequence of its own. The pieces are
    stored, since their numbers must be those of one run; after that no piece moves.
    """
    stored = materialise(pieces, "pieces")
    counts = materialise(stored.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    # One row per length: the pieces of all longer ones.
    lengths = counts.groupBy("length").agg(F.sum("n").alias("all"))
    longer = W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    above = lengths.select("length", F.coalesce(F.sum("all").over(longer), F.lit(0)).alias("above"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")).join(above, "length")
    # One row per task and length, of which there are no more than twelve at a limit of 2,048.
    first = F.broadcast(first.select("length", "part", (F.col("above") + F.col("earlier")).alias("first")))
    numbered = stored.join(first, ["length", "part"])
    kept = [F.col(c) for c in pieces.columns if c not in ("part", "nth")]
    return numbered.select(*kept, (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """The sequences of ``docs``: its pieces with their ids, ``sequence_id`` and ``offset``."""
    return number_sequences(split_documents(docs, tokenizer, **settings))
