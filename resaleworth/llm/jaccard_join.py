"""N-gram Jaccard join: prefix filtering with the rarest shingles first.

Each text is the set of its k-word shingles, in an order that puts rare ones first. Sets of similarity t or more
share a shingle among the first n - ceil(t n) + 1 of each, so only those meet in the join. Lengths and positions rule
out some of what meets. A suffix filter rules out most of the rest: how many shingles each set has in ``BINS`` parts
of the hash range bounds what two sets can share. What remains is intersected, once per pair; only the texts in it
are cut into shingles again.

Rarity is estimated from two tables of ``CELLS`` hash cells that count all words and all shingles of the corpus: a
shingle of rare words is rare, unless its own cell shows that a passage is often copied. Any order that all texts
share is right; cells only make it coarser, and the tables that go to the tasks keep their size.

Copies are one node. A shingle that many texts hold is not turned into all pairs: its holders first meet the one that
has it earliest in its order, which is the text with the least of its own, the likely middle of a group. Whoever
links takes over its label, and only texts of different labels that still share a shingle meet again. When that finds
little more, all pairs of different labels are compared, so no link that joins two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from resaleworth.llm.components import connected_components
from resaleworth.llm.text import encoded, fresh, map_batches, mixed, shingle_hashes, tagged, word_hashes
from resaleworth.session import materialise

CELLS, CHUNK = 1 << 20, 1 << 12
BINS = 128
# Star rounds go on while more than ``FEW`` pairs per posting are left and one in ``IDLE`` postings finds a link.
FEW, IDLE = 1, 20
# Shingles looked back at, so that a pair that shares many of them is not emitted at each.
NEAR = 4


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    texts = encoded(batch["text"].to_pylist())
    return [shingle_hashes(hashes, words)[0] for hashes in word_hashes(texts)]


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(44)).astype(np.int64)


def corpus_counts(rows: DataFrame, words: int) -> np.ndarray:
    """(2, CELLS): how many words, and how many (text, shingle) pairs, of all ``rows`` fall into each cell.

    Tasks count on their own; reducers add up the chunks of cells that they own, one row at a time.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS), dtype=np.int64)
        for batch in batches:
            for hashes in word_hashes(encoded(batch["text"].to_pylist())):
                np.add.at(total[0], _cell(hashes), 1)
                np.add.at(total[1], _cell(shingle_hashes(hashes, words)[0]), 1)
        yield _chunk_rows(dict(enumerate(total.reshape(-1, CHUNK))))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, "<i8")
        yield _chunk_rows(total)

    schema = "chunk int, counts binary"
    parts = rows.select("text").mapInArrow(counted, schema).repartition("chunk").mapInArrow(summed, schema)
    out = np.zeros((2 * CELLS // CHUNK, CHUNK), dtype=np.int64)
    for chunk, counts in parts.collect():  # 2 * CELLS / CHUNK rows at most
        out[chunk] = np.frombuffer(counts, "<i8")
    return out.reshape(2, CELLS)


def _chunk_rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    used = {chunk: counts.tobytes() for chunk, counts in total.items() if counts.any()}
    return pa.record_batch([pa.array(list(used), pa.int32()), pa.array(list(used.values()), pa.binary())], ["chunk", "counts"])


def rarity_tables(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By cell: the logarithm of the words, and the shingles where they are too many for a mere sum of rare ones."""
    usual = counts[1].sum() / CELLS
    often = np.where(counts[1] > usual + 6 * np.sqrt(usual) + 1, counts[1], 0)
    return np.log(counts[0] + 1).astype(np.float32), often.astype(np.int64)


def _prefixed(rows: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """(doc, n, fp, prefix, bins): set size, fingerprint of the set, its rarest shingles, rarest first, and its bins."""
    tables = rows.sparkSession.sparkContext.broadcast(rarity_tables(corpus_counts(rows, words)))
    num, den = threshold.numerator, threshold.denominator

    def prefixes(batch: pa.RecordBatch) -> dict[str, list]:
        common, often = tables.value
        out: dict[str, list] = {"doc": batch["doc"], "n": [], "fp": [], "prefix": [], "bins": []}
        for hashes in word_hashes(encoded(batch["text"].to_pylist())):
            shingles, at = shingle_hashes(hashes, words)
            n = len(shingles)
            size = n - -(-num * n // den) + 1 if n else 0
            logs = common[_cell(hashes)]
            sums = sum((logs[at + i] for i in range(min(words, len(hashes)))), np.zeros(n, dtype=np.float32))
            order = np.lexsort((shingles, sums, often[_cell(shingles)]))[:size]
            out["n"].append(n)
            out["fp"].append(xxhash.xxh3_128_digest(shingles.tobytes()) if n else None)
            out["prefix"].append(shingles[order].view(np.int64))
            out["bins"].append(binned(shingles).tobytes() if n else None)
        return out

    kind = rows.schema["doc"].dataType.simpleString()
    return map_batches(rows, prefixes, f"doc {kind}, n long, fp binary, prefix array<long>, bins binary")


def binned(shingles: np.ndarray) -> np.ndarray:
    """How many shingles are in each part of the hash range."""
    return np.bincount((shingles >> np.uint64(57)).astype(np.int64), minlength=BINS).astype("<u4")


def _reachable(na: Column, pa_: Column, nb: Column, pb: Column, threshold: Fraction) -> Column:
    """Length and positional filter for sets of na and nb that share the shingle at places pa_ and pb.

    Similar sets have all their common shingles from their first common one on, so at that one enough must be left in
    both. Where a later one fails this, the first one lets the pair through.
    """
    num, den = threshold.numerator, threshold.denominator
    length = F.greatest(na, nb) * num <= F.least(na, nb) * den
    return length & (F.least(na - pa_, nb - pb) * (num + den) >= (na + nb) * num)


def similar(a: np.ndarray, b: np.ndarray, threshold: Fraction) -> bool:
    """Exact test of two sorted sets."""
    at = np.searchsorted(a, b)
    shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return threshold.denominator * shared >= threshold.numerator * (len(a) + len(b) - shared)


def _paired(pairs: DataFrame, values: DataFrame, value: str, fn) -> DataFrame:
    """The rows of ``pairs`` (a, b and more) for whose values (of a node each) ``fn`` says true; it gets two lists of bytes."""
    names = pairs.columns
    both = pairs.join(values.select(F.col("node").alias("a"), F.col(value).alias("va")), "a")
    both = both.join(values.select(F.col("node").alias("b"), F.col(value).alias("vb")), "b")

    def check(batch: pa.RecordBatch) -> dict[str, list]:
        kept = batch.filter(pa.array(fn(batch["va"].to_pylist(), batch["vb"].to_pylist()), pa.bool_()))
        return {name: kept[name] for name in names}

    return map_batches(both.select(*names, "va", "vb"), check, ", ".join(f"{c} {t}" for c, t in pairs.dtypes))


def _screened(pairs: DataFrame, bins: DataFrame, threshold: Fraction) -> DataFrame:
    num, den = threshold.numerator, threshold.denominator

    def near(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a, b = (np.frombuffer(b"".join(v), "<u4").reshape(-1, BINS).astype(np.int64) for v in (left, right))
        return np.minimum(a, b).sum(axis=1) * (num + den) >= (a.sum(axis=1) + b.sum(axis=1)) * num

    return _paired(pairs, bins, "bins", near)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    def linked(left: list[bytes], right: list[bytes]) -> list[bool]:
        return [similar(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), threshold) for a, b in zip(left, right, strict=True)]

    return _paired(pairs, sets, "shingles", linked)


def _new_sets(pairs: DataFrame, sets: DataFrame | None, texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of all texts in ``pairs``, added to those that are there already."""
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    if sets is not None:
        wanted = wanted.join(sets.select(F.col("node").alias("doc")), "doc", "left_anti")

    def as_sets(batch: pa.RecordBatch) -> dict[str, list]:
        return {"node": batch["doc"], "shingles": [s.astype("<u8").tobytes() for s in _sets(batch, words)]}

    kind = texts.schema["doc"].dataType.simpleString()
    found = map_batches(texts.join(wanted, "doc").select("doc", "text"), as_sets, f"node {kind}, shingles binary")
    found = materialise(found.where(F.length("shingles") > 0), "sets")
    return found if sets is None else sets.unionByName(found)


def _links(nodes: DataFrame, texts: DataFrame, words: int, threshold: Fraction) -> DataFrame | None:
    """(node, component) of all nodes with a link, or None without any."""
    # An id may have several texts; which one tells them apart.
    postings = nodes.select("node", "which", "n", F.posexplode("prefix").alias("pos", "token"))
    tokens = postings.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    live = postings.join(tokens.select("token"), "token").withColumn("label", F.col("node"))
    live = materialise(live, "postings")
    bins = materialise(nodes.select("node", "bins").join(live.select("node").distinct(), "node"), "bins")
    links, sets, turn, idle = None, None, 0, False
    while True:
        by_label = live.groupBy("token", "label").agg(F.count("*").alias("c"))
        sums = by_label.groupBy("token").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count("*").alias("labels"))
        share = ((F.col("m") * F.col("m") - F.col("q")) / (F.col("m") * 2)).alias("share")
        live = live.select("token", "node", "which", "n", "pos", "label").join(sums.where("labels > 1").select("token", share), "token")
        live = materialise(live, "postings")
        rows, left = live.agg(F.count("*"), F.sum("share")).first()
        if not rows:
            break
        last = idle or left <= FEW * rows
        one = live.drop("share")
        if last:
            one = _with_earlier(one)
            other = one
        else:
            first = F.min(F.struct("pos", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "label")).alias("p")
            other = one.groupBy("token").agg(first).select("token", "p.node", "p.n", "p.pos", "p.label")
        other = other.select([F.col(c).alias(c if c == "token" else f"{c}_") for c in other.columns])
        near = _reachable(F.col("n"), F.col("pos"), F.col("n_"), F.col("pos_"), threshold)
        met = one.join(other, "token").where((F.col("label") != F.col("label_")) & near)
        if last:  # not again where they have met just before; at the first shingle that both have, they always do
            met = met.where((F.col("node") < F.col("node_")) & ~F.arrays_overlap("earlier", "earlier_"))
        # b is the pivot of a star; the other way round it is another star.
        pairs = met.select(F.col("node").alias("a"), F.col("node_").alias("b"), "label", "label_").distinct()
        close = _screened(pairs, bins, threshold)
        if links is not None:
            tried = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            close = close.join(tried, ["a", "b"], "left_anti")
        close = materialise(close, "pairs")
        sets = _new_sets(close, sets, texts, words)
        # A repeated id has several texts: one link of a pair suffices.
        found = materialise(_verified(close, sets, threshold).distinct(), "links")
        links = found if links is None else links.unionByName(found)
        if last:
            break
        live, idle = _merged(live, found), found.count() * IDLE < rows
        turn += 1
    return None if links is None else connected_components(links)


def _with_earlier(postings: DataFrame) -> DataFrame:
    """``earlier``: up to ``NEAR`` shingles of the same text before this one, of those in ``postings``."""
    own = F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("own")
    texts = postings.groupBy("node", "which").agg(F.first("n").alias("n"), F.first("label").alias("label"), own)
    each = texts.select("node", "n", "label", "own", F.posexplode("own").alias("at", "one"))
    before = F.slice("own", F.greatest(F.col("at") - NEAR, F.lit(0)) + 1, F.least(F.col("at"), F.lit(NEAR)))
    earlier = F.transform(before, lambda x: x["token"]).alias("earlier")
    return each.select(F.col("one.token").alias("token"), "node", "n", F.col("one.pos").alias("pos"), "label", earlier)


def _merged(live: DataFrame, found: DataFrame) -> DataFrame:
    """``live`` with the label of the pivot for each label that has linked with one, where that lowers its hash.

    One step, not the whole component: labels only ever join what is linked, and what they miss is compared later.
    """
    both = found.select(F.col("label").alias("u"), F.col("label_").alias("v")).union(found.select("label_", "label"))
    degree = both.distinct().groupBy("v").agg(F.count("*").alias("degree"))
    ranked = both.distinct().join(degree, "v").select("u", F.struct((-F.col("degree")).alias("d"), F.xxhash64("v").alias("h"), "v").alias("to"))
    own = degree.select(F.col("v").alias("u"), F.struct((-F.col("degree")).alias("d"), F.xxhash64("v").alias("h"), "v").alias("self"))
    best = ranked.groupBy("u").agg(F.min("to").alias("to")).join(own, "u").where("to < self")
    moves = best.select(F.col("u").alias("label"), F.col("to.v").alias("target"))
    return live.join(moves, "label", "left").withColumn("label", F.coalesce("target", "label")).drop("target")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(id, ``n_shingles``, ``component_id``) for every row: set size, and smallest id reachable by links, its own included.

    Words are separated by ASCII white space, with A-Z in lower case. Texts of fewer than ``words`` words are one
    shingle. Two documents link when the Jaccard similarity of their sets is at least ``threshold``, tested with
    whole numbers. Shingles are compared by 64-bit hashes.

    Null or empty text, or no words: size 0, linked with nothing. Rows that repeat an id are one node: what links
    with one of its texts links with it. A null id links with nothing and has no component. An empty table gives an
    empty one. Other columns play no part.
    """
    t = Fraction(str(threshold))
    rows = tagged(docs, {"doc": id_col, "text": text_col})
    sets = materialise(_prefixed(rows, words, t), "shingles")
    full = sets.where("fp is not null and doc is not null")
    classes = materialise(full.groupBy("fp").agg(F.min("doc").alias("rep")), "classes")
    # Both keys: the copies of one text don't meet in one task.
    nodes = full.join(classes, (full["fp"] == classes["fp"]) & (full["doc"] == classes["rep"]))
    nodes = nodes.select(F.col("rep").alias("node"), F.hash(full["fp"]).alias("which"), "n", "prefix", "bins")
    labels = _links(nodes, rows.where("doc is not null"), words, t)
    placed = classes.withColumnRenamed("rep", "node")
    if labels is not None:
        placed = placed.join(labels, "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component")
    ids = sets.join(placed, "fp", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("node", "doc"))
    return ids.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of its group. Rows without an id stay."""
    groups = similar_groups(docs, id_col, text_col, **settings)
    gone = fresh(docs, "_gone")
    others = groups.where(F.col("component_id") != F.col(f"`{id_col}`")).select(F.col(f"`{id_col}`").alias(gone)).distinct()
    return docs.join(others, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
