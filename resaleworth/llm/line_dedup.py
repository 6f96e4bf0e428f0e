"""Line dedup: lines that many documents share stay in one of them only.

Lines become 128-bit hashes in the scan. Counting documents per hash is an aggregate with map-side
merging, so a line that a third of all documents hold makes no large task; the join that finds who loses
a line leaves such a hash to AQE's skew handling. Texts move once, to meet the lines they lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from resaleworth.llm.text import fresh, map_batches, tagged, with_columns
from resaleworth.session import materialise

_WHITE = b" \t\n\x0b\x0c\r"


def keyed_lines(text: str | None, min_chars: int) -> Iterator[tuple[bytes, bytes | None]]:
    """Each line with its hash, which is None for keys of under ``min_chars`` code points."""
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(_WHITE).lower()
        counts = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        yield line, xxhash.xxh3_128_digest(key) if counts else None


def lost_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, key) for each document and line hash that it loses."""

    def hashes(batch: pa.RecordBatch) -> dict[str, list]:
        out = {"key": [], "doc": []}
        for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), strict=True):
            keys = {key for _, key in keyed_lines(text, min_chars) if key}
            out["key"] += keys
            out["doc"] += [doc] * len(keys)
        return out

    rows = tagged(docs, {"doc": id_col, "text": text_col}).where("doc is not null")
    held = materialise(map_batches(rows, hashes, f"key binary, doc {rows.schema['doc'].dataType.simpleString()}"), "lines")
    counts = held.groupBy("key").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("last"))
    common = counts.where(F.col("docs") >= min_docs).select("key", "last")
    return held.join(common, "key").where(F.col("doc") != F.col("last")).select("doc", "key")


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``docs`` with shared lines dropped from the text, and ``n_lines`` (before) and ``n_dropped`` added.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of at least
    ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in the largest
    id that holds them. The other lines stay as they are, in their order.

    Null or empty text: one empty line, left as it is. A text whose lines all go becomes empty. Rows that repeat
    an id count as one document and lose the same lines. Rows without an id count for nothing and stay whole.
    Columns named ``n_lines`` or ``n_dropped`` are replaced; all others stay.
    """
    lost = lost_lines(docs, id_col, text_col, min_chars, min_docs)
    doc, keys, out = fresh(docs, "_doc"), fresh(docs, "_keys"), fresh(docs, "_kept")
    # A document has no more keys than lines, so this list is never longer than its text.
    per_doc = lost.groupBy("doc").agg(F.collect_set("key").alias(keys)).withColumnRenamed("doc", doc)

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def rebuilt(texts: pd.Series, lost_keys: pd.Series) -> pd.DataFrame:
        rows = []
        for text, gone in zip(texts, lost_keys, strict=True):
            if gone is None or not len(gone):
                rows.append((text, 1 + (text or "").count("\n"), 0))
                continue
            gone = {bytes(key) for key in gone}
            lines = list(keyed_lines(text, min_chars))
            kept = [line for line, key in lines if key not in gone]
            rows.append((b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    joined = docs.join(per_doc, docs[f"`{id_col}`"] == per_doc[doc], "left")
    joined = joined.withColumn(out, rebuilt(F.col(f"`{text_col}`"), F.col(keys)))
    columns = [F.col(f"{out}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    counts = {"n_lines": F.col(f"{out}.n_lines"), "n_dropped": F.col(f"{out}.n_dropped")}
    base = joined.select(*columns, out)
    return with_columns(base, counts, drop=(out,))
