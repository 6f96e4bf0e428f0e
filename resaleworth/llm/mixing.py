"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is its source's target over the source's size. The whole part is taken
with certainty; what the source still lacks comes from one more copy of some documents. A document's inclusion
probability p for that is proportional to its size, and 1 where that would be more (a certain copy), so that the expected
words are those that the source lacks. Pareto sampling ranks documents by u/(1-u) over p/(1-p), with u from
a hash of the id, and takes the first ones, here until their words come nearest to what is lacking.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from resaleworth.llm.text import fresh, with_columns
from resaleworth.operators.ranking import with_row_number
from resaleworth.session import materialise

# Ranks are counted in so many cells of odds/(1+odds) per source, and those of the cut's cell in as many again; only the cut's own is sorted.
CELLS = 4096
# So many hexadecimal digits of a hash make u; exact in a double.
DIGITS = 13


@F.pandas_udf(T.LongType())
def word_count(texts: pd.Series) -> pd.Series:
    """Words outside ASCII white space; null: 0."""
    return pd.Series([0 if text is None else len(text.encode().split()) for text in texts], dtype="int64")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most_copies: float) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source, nulls being one of them.

    Sources in code point order, null last, take the weights in turn. Targets share ``share`` of all words by
    weight; one above ``most_copies`` times its source's size stops there, and its excess goes to the others by
    weight, until none is above. Sources stay a table: the driver sees a few sums per round.
    """
    keyed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    keyed = materialise(keyed.withColumn("_null", F.col("source").isNull()), "sources")
    placed = with_row_number(keyed, ["_null", "source"], "place", start=0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    sources = materialise(placed.select("source", "source_size", weight.alias("weight")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(most_copies)
    level, full, before = 0.0, F.lit(False), -1
    while True:
        capped, open_weight, n_full = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if n_full == before or not open_weight:
            break
        before, level = n_full, max(level, (share * total - capped) / open_weight)
        full = F.col("weight") * level >= cap
    return sources.select("source", "source_size", F.when(full, cap).otherwise(F.col("weight") * level).alias("target"))


def _uniform(id_col: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(1 << (4 * DIGITS))


def _ratio(size: Column, scale: Column, u: Column) -> Column:
    """odds / (1 + odds), with odds = u/(1-u) over p/(1-p) and p = min(1, scale * size)."""
    p = scale * size
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.when(p < 1, odds / (1 + odds)).otherwise(0.0)


def _cell(rank: Column) -> Column:
    return F.least(F.floor(rank * (CELLS * CELLS)), F.lit(CELLS * CELLS - 1))


def _cut(ranked: DataFrame, before: Column) -> DataFrame:
    """(cut_of, cut_cell, before): the cell ``at`` in which the words of a source reach what it lacks, and the words before it.

    ``before`` are the words that come before all of ``ranked``. A source has ``CELLS`` cells at most.
    """
    cells = ranked.groupBy("of", "lack", before.alias("base"), "at").agg(F.sum("size").alias("words"))
    lower = F.col("base") + F.sum("words").over(W.partitionBy("of").orderBy("at")) - F.col("words")
    cut = cells.withColumn("before", lower).where("before <= lack and lack < before + words")
    return materialise(cut.select(F.col("of").alias("cut_of"), F.col("at").alias("cut_cell"), "before"), "cuts")


def _scales(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with the ``scale`` of its source's inclusion probabilities; null where the source lacks nothing.

    With all sizes above some size certain, the scale is what is left of the lack over the sum of the squares of the others; the
    largest size whose probability is then below 1 is the right one. Only distinct sizes of a source are sorted.
    """
    sizes = rows.where("size > 0").groupBy("source", "size").agg((F.count("*") * F.col("size")).alias("words"))
    sizes = materialise(sizes, "distinct-sizes").join(plan.where("lack > 0").select(F.col("source").alias("of"), "lack"), F.col("source").eqNullSafe(F.col("of")))
    above = F.sum("words").over(W.partitionBy("of").orderBy(F.desc("size"))) - F.col("words")
    squares = F.sum(F.col("words").cast("decimal(38,0)") * F.col("size")).over(W.partitionBy("of").orderBy("size")).cast("double")
    tried = sizes.select("of", "size", ((F.col("lack") - above) / squares).alias("scale"))
    best = tried.where(F.col("scale") * F.col("size") < 1).groupBy("of").agg(F.max_by("scale", "size").alias("scale"))
    return plan.join(best, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def sample_copies(
    docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_copies: int = 2, seed: int = 5,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the row).

    No row is taken more than ``most_copies`` times, and a source's words end within half a document of its target.
    Reruns agree: the order comes from a hash of the id. Null or empty text has size 0 and is not taken; the null
    source is a source of its own; a null id is an id. Rows that repeat id and size are taken or left together.
    Columns named as the new ones are replaced. An empty table gives an empty one.
    """
    source, ident = F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`")
    rows = docs.select(source.alias("source"), ident.alias("id"), word_count(F.col(f"`{text_col}`")).alias("size"))
    rows = materialise(rows, "sizes")
    targets = source_targets(rows, weights, share, most_copies)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    plan = targets.withColumn("whole", whole).withColumn("lack", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialise(_scales(rows, materialise(plan, "plan")), "targets")

    rank = _ratio(F.col("size"), F.col("scale"), _uniform(F.col("id"), seed))
    wanted = plan.where("scale IS NOT NULL").withColumnRenamed("source", "of")
    ranked = rows.where("size > 0").join(wanted, F.col("source").eqNullSafe(F.col("of")))
    ranked = ranked.select("of", "lack", "id", "size", rank.alias("rank"), _cell(rank).alias("cell"))
    coarse = _cut(ranked.withColumn("at", F.floor(F.col("cell") / CELLS)), F.lit(0))
    inside = ranked.join(coarse, F.col("of").eqNullSafe(F.col("cut_of")) & (F.floor(F.col("cell") / CELLS) == F.col("cut_cell")))
    cut = _cut(inside.withColumn("at", F.col("cell")), F.col("before"))
    # One cell of each source: equal ranks are one step, so that rows that repeat an id stay together.
    inside = ranked.join(cut, F.col("of").eqNullSafe(F.col("cut_of")) & (F.col("cell") == F.col("cut_cell")))
    steps = inside.groupBy("of", "lack", "before", "rank", "id", "size").agg(F.sum("size").alias("words"))
    upper = F.col("before") + F.sum("words").over(W.partitionBy("of").orderBy("rank", "id", "size"))
    near = F.abs(F.col("upper") - F.col("lack")) <= F.abs(F.col("upper") - F.col("words") - F.col("lack"))
    last = steps.withColumn("upper", upper).where(near).groupBy("of").agg(F.max(F.struct("rank", "id", "size")).alias("last"))
    marks = cut.join(last, F.col("cut_of").eqNullSafe(F.col("of")), "left").drop("of", "before")
    marks = plan.join(marks, F.col("source").eqNullSafe(F.col("cut_of")), "left")
    marks = materialise(marks.select(F.struct("source_size", "target", "whole", "scale", "cut_cell", "last").alias("mark"), "source"), "marks")

    mark, of, size, rank_ = (fresh(docs, c) for c in ("_mark", "_of", "_size", "_rank"))
    marks = marks.select(F.col("mark").alias(mark), F.col("source").alias(of))
    out = docs.join(marks, source.eqNullSafe(F.col(of)), "left").withColumn(size, word_count(F.col(f"`{text_col}`")))
    m = {c: F.col(f"{mark}.{c}") for c in ("source_size", "target", "whole", "scale", "cut_cell", "last")}
    out = out.withColumn(rank_, F.when(m["scale"].isNotNull() & (F.col(size) > 0), _ratio(F.col(size), m["scale"], _uniform(ident, seed))))
    own_rank = F.col(rank_)
    own_cell = _cell(own_rank)
    here = F.struct(own_rank.alias("rank"), ident.alias("id"), F.col(size).alias("size"))
    # Without a cut cell, by rounding, the source lacks all its words.
    extra = m["cut_cell"].isNull() | (own_cell < m["cut_cell"]) | ((own_cell == m["cut_cell"]) & (here <= m["last"]))
    copies = m["whole"] + F.when(m["scale"].isNotNull() & F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    new = {
        "size": F.col(size), "source_size": m["source_size"], "target": m["target"],
        "copies": F.when(F.col(size) > 0, copies).otherwise(0).cast("long"),
    }
    return with_columns(out, new, drop=(mark, of, size, rank_))


def mix_sources(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs`` only, whatever their names."""
    named = {"source": source_col, "text": text_col, "id": id_col}
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, *[F.col(f"`{column}`").alias(name) for name, column in named.items()])
    sampled = sample_copies(rows, "source", "text", "id", **settings).where("copies > 0")
    return sampled.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
