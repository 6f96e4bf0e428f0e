"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Vectors are dealt into shards of a bounded number by a hash, and a shard into bands of like length. Largest inner product becomes
smallest distance by one more coordinate that gives all vectors of a band the same length; as they differ little in length, that
coordinate is small, and a query, brought to the same length, lies among them. A task builds the graphs of a shard's bands: greedy searches
from the band's medoid propose neighbours, a neighbour that is much nearer to an accepted one than to the vector is
pruned (relaxed by ``alpha``), so that edges point in diverse directions, and edges are made mutual. Queries search
the bands of every shard with a beam, longest vectors first, in groups that numpy handles together; a band whose longest vector can't reach
a query's last place is left out. The best of all shards are ranked by exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from resaleworth.llm.vectors import vector_rows
from resaleworth.session import materialise

# Vectors or queries that walk the graph together.
GROUP = 256
# Rows of a band: so many at most; so many at least where lengths differ by more than the ratio.
BAND, LEAST, RATIO = 768, 192, 1.1


class PrunedGraph:
    """Out-edges of up to ``degree`` neighbours for each row of ``points``."""

    def __init__(self, points: np.ndarray, edges: np.ndarray) -> None:
        self.points, self.edges, self.degree = points, edges, edges.shape[1]
        self.norms = np.einsum("ij,ij->i", points, points)
        self.start = int((self.norms - 2 * points @ points.mean(axis=0)).argmin())

    @classmethod
    def built(cls, points: np.ndarray, degree: int, beam: int, alpha: float, seed: int) -> PrunedGraph:
        """From random edges, all rows are inserted again twice, the second time with relaxed pruning."""
        n, rng = len(points), np.random.default_rng(seed)
        graph = cls(points, np.full((n, degree), -1, dtype=np.int64))
        if n > 1:
            first = rng.integers(0, n - 1, (n, min(degree, n - 1)))
            graph.edges[:, : first.shape[1]] = first + (first >= np.arange(n)[:, None])
            for relax in (1.0, alpha):
                order = rng.permutation(n)
                for at in range(0, n, GROUP):
                    graph._insert(order[at : at + GROUP], beam, relax)
        return graph

    def distances(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Squared distances, up to a constant per query, of each query to its own rows; infinite where the row is -1."""
        found = self.norms[rows] - 2 * np.einsum("qd,qnd->qn", queries, self.points[rows])
        return np.where(rows >= 0, found, np.inf)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest rows met by each query's greedy walk and their distances, nearest first."""
        q = len(queries)
        if len(self.points) <= beam:
            rows = np.tile(np.arange(len(self.points)), (q, 1))
            far = self.distances(queries, rows)
            order = np.argsort(far, axis=1, kind="stable")
            return np.take_along_axis(rows, order, axis=1), np.take_along_axis(far, order, axis=1)
        rows = np.full((q, beam), -1, dtype=np.int64)
        rows[:, 0] = self.start
        far = self.distances(queries, rows)
        done = rows < 0
        seen = np.zeros((q, len(self.points)), dtype=bool)
        seen[:, self.start] = True
        active = np.arange(q)
        while len(active):
            pick = np.where(done[active], np.inf, far[active]).argmin(axis=1)
            done[active, pick] = True
            near = self.edges[rows[active, pick]]
            new = (near >= 0) & ~seen[active[:, None], near]
            near = np.where(new, near, -1)
            width = max(1, int(new.sum(axis=1).max()))
            near = np.take_along_axis(near, np.argsort(~new, axis=1, kind="stable")[:, :width], axis=1)
            at, col = np.nonzero(near >= 0)
            seen[active[at], near[at, col]] = True
            both = np.concatenate([rows[active], near], axis=1)
            away = np.concatenate([far[active], self.distances(queries[active], near)], axis=1)
            finished = np.concatenate([done[active], near < 0], axis=1)
            order = np.argsort(away, axis=1, kind="stable")[:, :beam]
            rows[active] = np.take_along_axis(both, order, axis=1)
            far[active] = np.take_along_axis(away, order, axis=1)
            done[active] = np.take_along_axis(finished, order, axis=1)
            active = active[~done[active].all(axis=1)]
        return rows, far

    def pruned(self, at: np.ndarray, near: np.ndarray, relax: float) -> np.ndarray:
        """For each row of ``at``, up to ``degree`` of its candidates, skipping those nearer to an accepted one by ``relax``."""
        near = np.where(near == at[:, None], -1, near)
        ordered = np.sort(near, axis=1)
        repeated = np.concatenate([np.zeros((len(at), 1), bool), ordered[:, 1:] == ordered[:, :-1]], axis=1)
        near = np.where(repeated, -1, ordered)
        away = self.distances(self.points[at], near) + self.norms[at][:, None]
        order = np.argsort(away, axis=1, kind="stable")
        near, away = np.take_along_axis(near, order, axis=1), np.take_along_axis(away, order, axis=1)
        vectors = self.points[near]
        gram = np.einsum("qnd,qmd->qnm", vectors, vectors)
        norms = self.norms[near]
        between = norms[:, :, None] + norms[:, None, :] - 2 * gram
        alive = near >= 0
        out = np.full((len(at), self.degree), -1, dtype=np.int64)
        rows = np.arange(len(at))
        for slot in range(self.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            out[some, slot] = near[rows, pick][some]
            alive &= relax * relax * between[rows, pick] > away
            alive[rows, pick] = False
        return out

    def _insert(self, at: np.ndarray, beam: int, relax: float) -> None:
        found, _ = self.search(self.points[at], beam)
        self.edges[at] = self.pruned(at, np.concatenate([found, self.edges[at]], axis=1), relax)
        # Mutual edges: each new target takes the rows of this group as candidates too.
        source, slot = np.nonzero(self.edges[at] >= 0)
        target, origin = self.edges[at][source, slot], at[source]
        order = np.argsort(target, kind="stable")
        target, origin = target[order], origin[order]
        places, first, count = np.unique(target, return_index=True, return_counts=True)
        free = (self.edges[places] < 0).sum(axis=1)
        rank = np.arange(len(target)) - np.repeat(first, count)
        width = int(count.max()) if len(count) else 0
        extra = np.full((len(places), width), -1, dtype=np.int64)
        extra[np.repeat(np.arange(len(places)), count), rank] = origin
        known = (extra[:, :, None] == self.edges[places][:, None, :]).any(axis=2)
        extra[known] = -1
        full = (extra >= 0).sum(axis=1) > free
        for rows in np.array_split(np.flatnonzero(full), max(1, -(-int(full.sum()) // GROUP))):
            if len(rows):
                both = np.concatenate([self.edges[places[rows]], extra[rows]], axis=1)
                self.edges[places[rows]] = self.pruned(places[rows], both, relax)
        rows = np.flatnonzero(~full & (extra >= 0).any(axis=1))
        if len(rows):
            both = np.concatenate([self.edges[places[rows]], extra[rows]], axis=1)
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
            self.edges[places[rows]] = packed[:, : self.degree]


def bands(lengths: np.ndarray) -> np.ndarray:
    """The first row of each band, of lengths in descending order."""
    starts, top = [0], lengths[0] if len(lengths) else 0.0
    for i in range(1, len(lengths)):
        rows = i - starts[-1]
        if rows == BAND or (rows >= LEAST and lengths[i] * RATIO < top):
            starts.append(i)
            top = lengths[i]
    return np.array(starts)


def _lifted(points: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all rows are as long as the longest."""
    squares = np.einsum("ij,ij->i", points, points)
    return np.column_stack([points, np.sqrt(squares.max() - squares)])


def banded_edges(points: np.ndarray, degree: int, beam: int, alpha: float, seed: int) -> np.ndarray:
    """Out-edges of all bands together, as rows of ``points``, which are in descending order of length."""
    edges = np.full((len(points), degree), -1, dtype=np.int64)
    starts = bands(np.sqrt(np.einsum("ij,ij->i", points, points)))
    for start, end in zip(starts, [*starts[1:], len(points)], strict=True):
        own = PrunedGraph.built(_lifted(points[start:end]), degree, beam, alpha, seed).edges
        edges[start:end] = np.where(own >= 0, own + start, -1)
    return edges


def banded_search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, keep: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` best rows of ``points`` for each query and their inner products, best first; -1 where there are fewer."""
    lengths = np.sqrt(np.einsum("ij,ij->i", points, points))
    starts = bands(lengths)
    found, scores = np.full((len(queries), keep), -1, dtype=np.int64), np.full((len(queries), keep), -np.inf)
    sizes = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    for start, end in zip(starts, [*starts[1:], len(points)], strict=True):
        own, top = points[start:end], lengths[start]
        graph = PrunedGraph(_lifted(own), np.where(edges[start:end] >= 0, edges[start:end] - start, -1))
        # Within rounding, no row of the band beats what such a query has.
        live = np.flatnonzero(sizes * top * (1 + 1e-9) >= scores[:, -1])
        for part in np.array_split(live, max(1, -(-len(live) // GROUP))):
            if not len(part):
                continue
            flat = np.column_stack([queries[part] * (top / sizes[part])[:, None], np.zeros(len(part))])
            rows, _ = graph.search(flat, max(beam, keep))
            own_scores = np.where(rows >= 0, np.einsum("qd,qnd->qn", queries[part], own[rows]), -np.inf)
            both = np.concatenate([scores[part], own_scores], axis=1)
            names = np.concatenate([found[part], np.where(rows >= 0, rows + start, -1)], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :keep]
            scores[part], found[part] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
    return found, scores


def _matrix(vectors: list) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def build_graphs(
    points: DataFrame, shard_size: int = 8192, degree: int = 24, beam: int = 48, alpha: float = 1.2, seed: int = 4
) -> DataFrame:
    """(dim, shard, place, c1, c2, vec, edges): the graphs of every shard of (c1, c2, vec).

    ``place`` numbers a shard's rows, longest vectors first, and ``edges`` are places. A shard holds ``shard_size`` vectors of one
    dimension on average, dealt by the hashes c1 and c2.
    """
    points = points.withColumn("dim", F.size("vec"))
    sizes = points.groupBy("dim").agg(F.ceil(F.count("*") / shard_size).alias("shards"))
    shard = F.pmod(F.xxhash64("c1", "c2", F.lit(seed)), F.col("shards")).cast("int").alias("shard")
    dealt = points.join(sizes, "dim").select("dim", shard, "c1", "c2", "vec")
    # A shard is little data and much work: a task for each, however small.
    n = sizes.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["c1", "c2"], ignore_index=True)
        points = _matrix(rows["vec"])
        order = np.argsort(-np.einsum("ij,ij->i", points, points), kind="stable")
        rows = rows.iloc[order].reset_index(drop=True)
        return rows.assign(place=np.arange(len(rows)), edges=list(banded_edges(points[order], degree, beam, alpha, seed)))

    schema = "dim int, shard int, place int, c1 long, c2 long, vec array<double>, edges array<long>"
    return dealt.repartition(n, "dim", "shard").groupBy("dim", "shard").applyInPandas(lambda rows: build(rows)[schema_names(schema)], schema)


def schema_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def search_graphs(graphs: DataFrame, queries: DataFrame, keep: int, beam: int = 64, block: int = 20_000) -> DataFrame:
    """(q1, q2, c1, c2, score): for each query (q1, q2, vec) the ``keep`` best rows of every shard of its dimension.

    Queries come in blocks, so a task holds one shard and one block. Scores are exact inner products.
    """
    queries = queries.withColumn("dim", F.size("vec"))
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = queries.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("q1", "q2"), F.col("blocks")).cast("int"))
    shards = graphs.select("dim", F.col("shard").alias("of")).distinct()
    asked = dealt.join(shards, "dim").select(
        F.col("dim").alias("asked_dim"), F.col("of").alias("asked_shard"), F.col("block").alias("asked_block"), "q1", "q2", "vec"
    )
    held = graphs.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    names = ["q1", "q2", "c1", "c2", "score"]

    def search(index: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(wanted):
            return pd.DataFrame([], columns=names)
        index = index.sort_values("place", ignore_index=True)
        points, asked_vectors = _matrix(index["vec"]), _matrix(wanted["vec"])
        rows, _ = banded_search(points, np.stack(index["edges"].to_list()), asked_vectors, keep, beam)
        asked_at, slot = np.nonzero(rows >= 0)
        found = rows[asked_at, slot]
        score = (asked_vectors[asked_at] * points[found]).sum(axis=1)
        q, c = wanted.iloc[asked_at], index.iloc[found]
        return pd.DataFrame({"q1": q["q1"].to_numpy(), "q2": q["q2"].to_numpy(), "c1": c["c1"].to_numpy(), "c2": c["c2"].to_numpy(), "score": score})

    n = max(1, shards.join(blocks, "dim").agg(F.coalesce(F.sum("blocks"), F.lit(1))).first()[0])
    held = held.repartition(n, "dim", "shard", "block").groupBy("dim", "shard", "block")
    both = held.cogroup(asked.repartition(n, "asked_dim", "asked_shard", "asked_block").groupBy("asked_dim", "asked_shard", "asked_block"))
    return both.applyInPandas(search, "q1 long, q2 long, c1 long, c2 long, score double")


def nearest_rows(
    table: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_size: int = 8192,
    degree: int = 24, beam: int = 64, alpha: float = 1.2,
) -> DataFrame:
    """(query_id, rank, id, score): for each row where ``is_query`` holds, its ``k`` nearest other rows that were found.

    Nearest means the largest inner product in double precision, ties to the smaller id; rank starts at 1. With
    ``k`` other rows or fewer, all are returned. Exact copies are indexed once and ranked by their ids, of which the
    k + 1 smallest suffice. Shards of up to ``beam`` vectors are compared in full.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part.
    Vectors meet those of their own length. A row is never its own neighbour, nor is another row of the same id.
    """
    rows = vector_rows(table.where(F.col(f"`{id_col}`").isNotNull()), id_col, vec_col)
    rows = materialise(rows.withColumn("asks", is_query(F.col("id"))), "vectors")
    in_class = W.partitionBy("h1", "h2").orderBy("id")
    firsts = rows.select("h1", "h2", "id").distinct().withColumn("n", F.row_number().over(in_class)).where(F.col("n") <= k + 1)
    members = firsts.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = rows.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.max("asks").alias("asks"))
    classes = materialise(classes.withColumnsRenamed({"h1": "c1", "h2": "c2"}), "classes")
    graphs = materialise(build_graphs(classes.select("c1", "c2", "vec"), shard_size, degree, 3 * beam // 4, alpha), "graphs")
    queries = classes.where("asks").select(F.col("c1").alias("q1"), F.col("c2").alias("q2"), "vec")
    found = materialise(search_graphs(graphs, queries, k + 1, beam), "found")
    per_query = W.partitionBy("q1", "q2")
    named = found.join(members.withColumnsRenamed({"h1": "c1", "h2": "c2"}), ["c1", "c2"])
    best = named.withColumn("n", F.row_number().over(per_query.orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("n") <= k + 1)
    ids = best.select("q1", "q2", "score", F.explode("ids").alias("id"))
    ids = ids.withColumn("n", F.row_number().over(per_query.orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    lists = ids.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("near"))
    asking = rows.where("asks").select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asking.join(lists, ["q1", "q2"]).select("query_id", F.posexplode(others).alias("at", "one"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.id").alias(id_col), F.col("one.score").alias("score"))
