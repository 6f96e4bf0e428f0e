"""License scans: texts of known licences inside documents, with DataFrame functions only.

Templates fall into classes by length. A class looks at windows of twice its longest template, rounded up to a power
of two, which overlap by half, so a template in a document lies whole in some window. A window and a template whose
smallest shingle hashes agree in a band meet, and the share of the template's shingles that the window holds is
checked exactly. Bands are of one row, and a class has so many that a template that is whole in a window meets it
with a probability of at least ``certainty``.

Only shingles of some template of the class count in a window: the others can't be shared, and without them a band
agrees more often. Windows with fewer of them than the share asks of the smallest template of the class are dropped
before any hashing; nothing is lost by that. Templates are a stored table, joined on the shingles and on band and hash.

Versions of a licence share nearly all shingles, so a template can name phrases that its window must have whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from resaleworth.llm.license_templates import NOTICES, TEMPLATES, VERSIONS  # noqa: F401
from resaleworth.llm.text import tagged
from resaleworth.session import materialise


def split_words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: word != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once per row, however often it is named inside."""
    return F.transform(F.array(value), use)[0]


def shingle_at(words: Column, i: Column, k: int) -> Column:
    return F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])


def places_of(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def shingles_of(words: Column, k: int) -> Column:
    """The different k-word shingles of an array of words; none of fewer words."""
    return let(words, lambda w: F.array_distinct(F.transform(places_of(w, k), lambda i: shingle_at(w, i, k))))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]], versions: Mapping[str, Sequence[str]], k: int) -> DataFrame:
    """(template, width, shingles, needed), one row per template; ``needed`` are the shingles of its version phrases."""
    rows = [(name, text, list(versions.get(name, ()))) for name, text in templates]
    table = spark.createDataFrame(rows, "template string, text string, phrases array<string>").withColumn("words", split_words(F.col("text")))
    width = F.pow(F.lit(2), F.ceil(F.log2(F.size("words").cast("double"))) + 1).cast("int")
    needed = F.array_distinct(F.flatten(F.transform("phrases", lambda phrase: shingles_of(split_words(phrase), k))))
    return table.select("template", width.alias("width"), shingles_of(F.col("words"), k).alias("shingles"), needed.alias("needed"))


def bands_for(share: float, certainty: float) -> int:
    """Bands of one row so that sets of this Jaccard similarity agree in one with this probability."""
    return max(1, math.ceil(math.log(1 - certainty) / math.log(1 - share))) if share < 1 else 1


def smallest_hashes(ids: Column, bands: Column) -> Column:
    """The smallest hash of the shingles under each of ``bands`` hash functions."""
    return F.transform(
        F.sequence(F.lit(1), bands),
        lambda i: F.struct(i.alias("band"), F.array_min(F.transform(ids, lambda h: F.xxhash64(h, i))).alias("least")),
    )


def window_starts(place: Column, step: Column) -> Column:
    """The starts of the two windows over a place; windows start every ``step`` words, the first at 0."""
    return F.filter(F.array(place - place % step, place - place % step - step), lambda start: start >= 0)


def scan_licenses(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
    min_share: float = 0.8, certainty: float = 0.9999, versions: Mapping[str, Sequence[str]] = VERSIONS,
) -> DataFrame:
    """(id, template, share, window_start, n_windows) for every row and template that match.

    ``share`` is the largest part of the template's shingles of ``k`` words found in one window, at least
    ``min_share``; ``window_start`` the first word of the first window that has it, ``n_windows`` the number of
    windows that match. Words are runs of letters and digits in lower case. Templates of fewer than ``k`` words are refused.
    A window matches a template of ``versions`` only if it also has all shingles of the phrases given there.

    Null, empty or short texts match nothing. Rows that repeat an id are one document; a null id is one too. An empty
    table gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    table = materialise(template_table(spark, templates, versions, k), "templates")
    sizes = table.select("template", "width", F.size("shingles").alias("n"), F.size(F.array_except("needed", "shingles")).alias("strange")).collect()
    if any(not row["n"] for row in sizes):
        raise ValueError(f"a template needs {k} words or more")
    if strange := [row["template"] for row in sizes if row["strange"]]:
        raise ValueError(f"version phrases that the template does not have, or of fewer than {k} words: {strange}")
    classes = []
    for width in sorted({row["width"] for row in sizes}):
        least = min(row["n"] for row in sizes if row["width"] == width)
        alike = min_share * least / (width - k + 1 + (1 - min_share) * least)  # at least, of a window and what it must hold
        classes.append((width, math.ceil(min_share * least - 1e-9), bands_for(alike, certainty)))
    kinds = spark.createDataFrame(classes, "width int, enough int, bands int")
    own = table.join(F.broadcast(kinds), "width").select("template", "width", "bands", *[F.transform(name, lambda s: F.xxhash64(s)).alias(name) for name in ("shingles", "needed")])
    own = own.select("template", "width", "shingles", "needed", F.inline(smallest_hashes(F.col("shingles"), F.col("bands"))))
    known = table.select("width", F.explode("shingles").alias("s")).groupBy("s").agg(F.collect_set("width").alias("widths"))

    rows = tagged(docs, {"doc": id_col, "text": text_col}).withColumn("row", F.monotonically_increasing_id())
    at = lambda words: F.transform(places_of(words, k), lambda i: F.struct(i.alias("place"), shingle_at(words, i, k).alias("s")))
    places = rows.select("row", "doc", F.inline(let(split_words(F.col("text")), at)))
    hits = places.join(F.broadcast(known), "s").select("row", "doc", "place", F.xxhash64("s").alias("hash"), "widths")
    hits = materialise(hits, "hits")

    over = hits.select("row", "doc", "place", "hash", F.explode("widths").alias("width"))
    starts = F.explode(window_starts(F.col("place"), (F.col("width") / 2).cast("int")))
    over = over.select("row", "doc", "place", "hash", "width", starts.alias("start")).where(F.col("place") + k <= F.col("start") + F.col("width"))
    windows = over.groupBy("row", "doc", "width", "start").agg(F.collect_set("hash").alias("has"))
    windows = windows.join(F.broadcast(kinds), "width").where(F.size("has") >= F.col("enough"))
    signs = windows.select("doc", "width", "start", "has", F.inline(smallest_hashes(F.col("has"), F.col("bands"))))
    met = signs.join(F.broadcast(own), ["width", "band", "least"])  # bands times templates rows
    share = F.size(F.array_intersect("has", "shingles")) / F.size("shingles")
    whole = F.size(F.array_except("needed", "has")) == 0
    found = met.where(whole).select("doc", "start", "template", share.alias("share")).where(F.col("share") >= min_share)
    one = found.distinct().groupBy("doc", "template").agg(F.min(F.struct((-F.col("share")).alias("share"), "start")).alias("best"), F.count("*").alias("n_windows"))
    return one.select(F.col("doc").alias(id_col), "template", (-F.col("best.share")).alias("share"), F.col("best.start").alias("window_start"), "n_windows")
