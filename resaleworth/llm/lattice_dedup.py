"""Embedding near-dedup by lattice hashing.

Unit vectors are projected onto random sets of eight directions, one per table, and each projection is decoded to
its E8 lattice point. A vector is listed under its own point and the nearest neighbouring points of each table, and
two vectors meet where the own point of one is a listed point of the other. All that meet are compared by cosine in
double precision, inside blocks of bounded size. Of the places where a linked pair meets only the first counts it,
so links are counted without a list of pairs: a block gives each vector its number of links and the smallest linked
one of its part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from resaleworth.llm.components import connected_components
from resaleworth.llm.lattice import cell_keys
from resaleworth.llm.text import fresh, map_batches, with_columns
from resaleworth.llm.vectors import vector_rows
from resaleworth.session import materialise

# Vectors in one half of a comparison, and linked pairs whose places are compared at once.
BLOCK, PAIRS = 1024, 100_000


def _unit(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The unit vectors of a batch, together where they have one length."""
    vectors = batch["vec"]
    flat, ends = vectors.flatten().to_numpy(), np.cumsum(vectors.value_lengths().to_numpy())
    rows = np.split(flat, ends[:-1])
    return [row / np.linalg.norm(row) if np.isfinite(np.linalg.norm(row)) else _rescaled(row) for row in rows]


def _rescaled(row: np.ndarray) -> np.ndarray:
    row = row / np.abs(row).max()
    return row / np.linalg.norm(row)


def listed(classes: DataFrame, tables: int, probes: int, spread: float, seed: int) -> DataFrame:
    """(key, own, node): every class under its own and its probed cells. Vectors stay behind until a cell is known to have two."""

    def keys(batch: pa.RecordBatch) -> dict[str, list]:
        units = _unit(batch)
        out: dict[str, list] = {"key": [], "own": [], "node": []}
        nodes = batch["node"].to_pylist()
        by_length: dict[int, list[int]] = {}
        for i, unit in enumerate(units):
            by_length.setdefault(len(unit), []).append(i)
        for rows in by_length.values():
            found = cell_keys(np.stack([units[i] for i in rows]), tables, probes, spread, seed)
            own = np.zeros(found.shape[1:], dtype=bool)
            own[:, 0] = True
            for i, cells in zip(rows, found, strict=True):
                out["key"] += cells.ravel().tolist()
                out["own"] += own.ravel().tolist()
                out["node"] += [nodes[i]] * cells.size
        return out

    kind = classes.schema["node"].dataType.simpleString()
    return map_batches(classes, keys, f"key long, own boolean, node {kind}")


def unit_vectors(classes: DataFrame) -> DataFrame:
    """(of, mult, unit) of every class."""
    kind = classes.schema["node"].dataType.simpleString()
    units = lambda batch: {"of": batch["node"], "mult": batch["mult"], "unit": [unit.tobytes() for unit in _unit(batch)]}
    return map_batches(classes, units, f"of {kind}, mult long, unit binary")


def first_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of (tables, 1 + probes) keys: the one key at which each pair counts, of the first table where they meet."""
    at_a = (a[:, :, :1] == b).any(axis=2)
    at_b = (b[:, :, :1] == a).any(axis=2)
    table = (at_a | at_b).argmax(axis=1)
    rows = np.arange(len(a))
    most = np.iinfo(np.int64).max
    own_a = np.where(at_a[rows, table], a[rows, table, 0], most)
    own_b = np.where(at_b[rows, table], b[rows, table, 0], most)
    return np.minimum(own_a, own_b)


def _compare(key, first, second, own, block, node, mult, unit, min_cosine, keys_of) -> Iterator[tuple]:
    """(node, links, root) for the linked vectors of one block."""
    cosines = unit @ unit.T
    near = np.triu(cosines >= min_cosine, 1) & (own[:, None] | own[None, :])
    if first != second:
        near &= block[:, None] != block[None, :]
    left, right = np.nonzero(near)
    if not len(left):
        return
    members = np.unique(np.concatenate([left, right]))
    keys = np.zeros((len(unit), *(cells := keys_of(unit[members])).shape[1:]), dtype=np.int64)
    keys[members] = cells
    links = np.zeros(len(unit), dtype=np.int64)
    for at in range(0, len(left), PAIRS):
        i, j = left[at : at + PAIRS], right[at : at + PAIRS]
        here = first_places(keys[i], keys[j]) == key
        np.add.at(links, i[here], mult[j[here]])
        np.add.at(links, j[here], mult[i[here]])
    root = np.arange(len(unit))
    while True:
        least = root.copy()
        np.minimum.at(least, left, root[right])
        np.minimum.at(least, right, root[left])
        least = least[least]
        if (least == root).all():
            break
        root = least
    yield from zip(node[members].tolist(), links[members].tolist(), node[root[members]].tolist(), strict=True)


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = 0.9, tables: int = 8, probes: int = 2,
    spread: float = 1.6, seed: int = 8,
) -> DataFrame:
    """``table`` with ``n_links``, ``component_id`` and ``kept``.

    ``n_links``: other rows whose vectors have a cosine of at least ``min_cosine`` with this one's, found with the
    chance that tables, probes and spread give (0.998 for a pair at a cosine of 0.9, more above it); none below is
    ever linked. ``component_id``: the smallest id reachable by links, the own one included. ``kept``: it is the own
    one. ``spread`` is the lattice scale: larger tables take a larger one, with more tables.

    Exact copies are one node with a count. Vectors of different lengths don't link. Vectors that are null, empty,
    zero or hold a null or non-finite component, and rows without an id, link with nothing. Rows that repeat an id
    count as rows, and their links count for the id. Columns of the three names are replaced; others stay.
    """
    rows = vector_rows(table, id_col, vec_col)
    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("mult"), F.first("vec").alias("vec"))
    classes = materialise(classes, "classes")
    places = materialise(listed(classes.select("node", "vec"), tables, probes, spread, seed), "places")
    counts = places.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("n > 1 and owners > 0")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    met = places.join(counts.select("key", parts.alias("parts")), "key")
    met = met.join(unit_vectors(classes.select("node", "mult", "vec")), F.col("node") == F.col("of"))
    block = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts")).cast("int")
    met = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    group = ["key", "first", "second"]
    met = met.select(*group, "own", "block", "node", "mult", "unit").repartition(*group).sortWithinPartitions(*group, "node")

    def keys_of(unit: np.ndarray) -> np.ndarray:
        return cell_keys(unit, tables, probes, spread, seed)

    kind = classes.schema["node"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, rows in _groups(batches, group):
            vectors = rows["unit"].to_pylist()
            size = np.array([len(v) for v in vectors])
            for length in np.unique(size):
                at = np.flatnonzero(size == length)
                part = {c: rows[c].to_numpy(zero_copy_only=False)[at] for c in ("own", "block", "node", "mult")}
                unit = np.frombuffer(b"".join([vectors[i] for i in at])).reshape(len(at), -1)
                found = list(_compare(*names, **part, unit=unit, min_cosine=min_cosine, keys_of=keys_of)) if len(at) > 1 else []
                if found:
                    node, links, root = zip(*found, strict=True)
                    yield pa.record_batch(
                        [pa.array(node, rows["node"].type), pa.array(links, pa.int64()), pa.array(root, rows["node"].type)],
                        ["node", "links", "root"],
                    )

    found = materialise(met.mapInArrow(compare, f"node {kind}, links long, root {kind}"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = classes.select("h1", "h2", "node", "mult").join(links, "node", "left").join(labels, "node", "left")
    placed = placed.select(
        "h1", "h2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component")
    )
    return _attached(table, id_col, vec_col, placed)


def _attached(table: DataFrame, id_col: str, vec_col: str, placed: DataFrame) -> DataFrame:
    """The rows of ``table`` with what was found for their vectors; only a null id or vector finds nothing."""
    h1, h2, of1, of2, found = (fresh(table, c) for c in ("_h1", "_h2", "_of1", "_of2", "_found"))
    ident, vec = F.col(f"`{id_col}`"), F.col(f"`{vec_col}`").cast("array<double>")
    hashed = table.withColumns({h1: F.xxhash64(vec), h2: F.xxhash64(F.lit(1), vec)})
    placed = placed.select(F.col("h1").alias(of1), F.col("h2").alias(of2), F.struct("links", "component").alias(found))
    joined = hashed.join(placed, [F.col(h1) == F.col(of1), F.col(h2) == F.col(of2), ident.isNotNull()], "left")
    component = F.when(ident.isNotNull(), F.coalesce(F.col(f"{found}.component"), ident))
    new = {
        "n_links": F.coalesce(F.col(f"{found}.links"), F.lit(0)).cast("long"),
        "component_id": component,
        "kept": component == ident,
    }
    return with_columns(joined, new, drop=(h1, h2, of1, of2, found))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal whole-number keys in sorted batches; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch[k].to_numpy() for k in keys], axis=1)
        starts = np.concatenate(([0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, [len(values)]))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            name = tuple(values[a].tolist())
            if current is not None and name != current:
                yield current, pa.Table.from_batches(held).combine_chunks()
                held = []
            current = name
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held).combine_chunks()
