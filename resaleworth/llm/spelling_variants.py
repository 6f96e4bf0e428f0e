"""Spelling variant grouping: words one edit apart, found by walking a trie with joins.

The trie is a distributed edge table (parent, label, child), once over the words and once over the reversed words.
Nodes are hashes of prefixes; chains without a branch are one edge, so the walk is as long as the deepest branching
and not as the longest word. A state is (word, position, node, edits). Those without an edit are a word's own path, which
building the trie lists anyway. One join gives every state its edit inside one edge; then states are
joined with the edge table level by level, letter for letter, until none is left. A state that ends where a
word ends is a neighbour.

Two words one edit apart share the first half of the one, or all that follows it. So the walk forth only edits behind
the first half, the walk on reversed words behind the rest; near the root, where all words meet, nothing branches.
The edge table is dealt by parent once and stays so. Each step is stored in the shared folder.

Both sides of every join grow with the words. Spark takes a table for as large as its compressed file, also after rows were made out of
its arrays or letters, and would send tables of a gigabyte through the driver; so the joins are told to sort and merge.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from resaleworth.llm.substring_dedup import Hashed
from resaleworth.llm.text import map_batches, mixed, tagged
from resaleworth.session import materialise

# Distinct words that a task counts before it passes them on.
HELD = 200_000
# Words up to this length are their own key; longer ones go by their hash, so that a row per letter never carries the word.
KEY_LENGTH = 64


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, slip_every: int = 0
) -> DataFrame:
    """(word, n): maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case, counted over whole texts.

    With ``slip_every``, a run whose crc32 of ``id:run`` is a multiple of it loses the letter at that crc32 modulo its length, before
    lengths and counts are looked at. Null text: no words; a null id is written as nothing.
    """
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = Counter(runs.findall(text.encode().lower().decode()))
                if slip_every:
                    seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    slips = [(run, h) for run in found if (h := zlib.crc32(run.encode(), seed)) % slip_every == 0]
                    for run, h in slips:
                        at, n = h % len(run), found.pop(run)
                        if len(run) > min_length:
                            held[run[:at] + run[at + 1 :]] += n
                for run, n in found.items():
                    held[run] += n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    texts = tagged(docs, {"doc": id_col, "text": text_col}).where("text is not null")
    counted = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _dealt(df: DataFrame) -> DataFrame:
    """For a join: both sides are dealt by the key, however small Spark takes them for."""
    return df.hint("merge")


def _letters(rows: DataFrame) -> DataFrame:
    """(key, way, depth, node, next) for every prefix of every word, the empty and the whole one included; next is -1 at the end."""

    def prefixes(batch: pa.RecordBatch) -> dict[str, object]:
        words = [word.encode("utf-32-le") for word in batch["text"].to_pylist()]
        sizes = np.array([len(word) // 4 for word in words])
        codes = np.frombuffer(b"".join(words), dtype="<u4").astype(np.int64)
        which = np.repeat(np.arange(len(words)), sizes + 1)
        start = np.cumsum(sizes) - sizes
        depth = np.arange(len(which)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
        end = start[which] + depth
        salts = np.repeat(batch["way"].to_numpy().astype(np.uint64) + np.uint64(1), sizes + 1)
        following = np.where(depth < sizes[which], np.append(codes, -1)[end], -1)
        with np.errstate(over="ignore"):
            node = mixed(Hashed(mixed(codes.astype(np.uint64) + np.uint64(1 << 32))).runs(start[which], end, 0) + salts)
        at = pa.array(which)
        return {"key": batch["key"].take(at), "way": batch["way"].take(at), "depth": depth, "node": node.view(np.int64), "next": following}

    return map_batches(rows, prefixes, "key string, way int, depth int, node long, next int")


def _paths(words: DataFrame) -> DataFrame:
    """(word, n, way, text, path): the kept nodes of each word, forth and back; path is an array of (depth, node)."""
    ways = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"))
    ways = ways.withColumn("text", F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word")))
    ways = ways.withColumn("key", F.when(F.length("text") <= KEY_LENGTH, F.col("text")).otherwise(F.concat(F.lit("#"), F.sha2("text", 256))))
    letters = _letters(ways.select("key", "way", "text"))
    # Where words part or one ends.
    kept = letters.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high")).where("low < high OR low = -1 OR high = -1")
    # Every word starts at its root: no need to look that up.
    stops = letters.where("depth > 0").join(_dealt(kept.select("node")), "node").unionByName(letters.where("depth = 0"))
    paths = stops.groupBy("key", "way").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))
    return ways.join(_dealt(paths), ["key", "way"]).select("word", "n", "way", "text", "path")


def _edges(paths: DataFrame) -> DataFrame:
    """(parent, child, label, ending, heads): ``ending`` is the word that ends at the child, ``heads`` the first letters behind it."""
    pair = F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path")).alias("b"))).alias("p")
    steps = paths.select("word", "n", "text", pair)
    label = F.substring("text", F.col("p.a.depth") + 1, F.col("p.b.depth") - F.col("p.a.depth"))
    ending = F.when(F.col("p.b.depth") == F.length("text"), F.struct("word", "n"))
    each = steps.select(F.col("p.a.node").alias("parent"), F.col("p.b.node").alias("child"), label.alias("label"), ending.alias("ending"))
    edges = materialise(each.groupBy("parent", "child", "label").agg(F.max("ending").alias("ending")), "edges")
    # No more than the letters of the alphabet.
    heads = edges.groupBy(F.col("parent").alias("child")).agg(F.array_join(F.collect_set(F.left("label", F.lit(1))), "").alias("heads"))
    return edges.join(_dealt(heads), "child", "left")


def _text() -> Column:
    return F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))


def _goes_on(at: Column) -> Column:
    """Whether a state at ``at`` ends with a word, or has an edge that starts with its next letter."""
    size = F.length("word")
    next_letter = F.substring(F.col("text"), at + 1, F.lit(1))
    return F.when(at == size, F.col("ending").isNotNull()).otherwise((at < size) & (F.instr("heads", next_letter) > 0))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all pairs of distinct words that differ by one inserted, deleted or replaced code point, both ways round."""
    spark = words.sparkSession
    paths = materialise(_paths(words), "paths")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    edges = materialise(_edges(paths), "trie").repartition(parts, "parent").persist(StorageLevel.DISK_ONLY)
    columns = ("word", "way", "at", "node", "ending")

    size = F.length("word")
    exact = F.when(F.col("way") == 0, F.floor(size / 2)).otherwise(size - F.floor(size / 2)).cast("int")
    # From the last node within the part that must be equal; the word without its last letter may end right behind that part.
    behind = "get(path, i + 1).depth > exact OR (get(path, i + 1).depth = exact AND exact + 1 = length(text))"
    useful = F.expr(f"filter(path, (p, i) -> p.depth >= exact OR {behind})")
    starts = paths.withColumn("exact", exact).select("word", "way", "text", "exact", F.explode(useful).alias("p"))
    starts = starts.select("word", "way", "text", "exact", F.col("p.depth").alias("pos"), F.col("p.node").alias("from"))
    met = starts.join(_dealt(edges), F.col("from") == F.col("parent"))
    met = met.where("pos >= exact OR substring(text, pos + 1, exact - pos) = left(label, exact - pos)")
    # The label against one letter less, as many, one more.
    reached = F.explode(F.array(*[F.col("pos") + F.length("label") + d for d in (-1, 0, 1)]))
    tried = met.withColumn("at", reached).where(_goes_on(F.col("at")))
    once = tried.where("levenshtein(substring(text, pos + 1, at - pos), label, 1) = 1")
    level = materialise(once.select(*columns[:3], F.col("child").alias("node"), "ending"), "states")
    levels = [level]
    while not level.where("at < length(word)").isEmpty():
        open_states = level.where("at < length(word)").select("word", "way", _text().alias("text"), F.col("at").alias("pos"), F.col("node").alias("from"))
        # The label is compared as a whole, so that the join stays on the node, as the edges are dealt.
        met = open_states.join(_dealt(edges), (F.col("from") == F.col("parent")) & (F.expr("substring(text, pos + 1, length(label))") == F.col("label")))
        walked = met.withColumn("at", F.col("pos") + F.length("label")).where(_goes_on(F.col("at")))
        level = materialise(walked.select(*columns[:3], F.col("child").alias("node"), "ending"), "states")
        levels.append(level)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    ended = found.where("at = length(word) AND ending IS NOT NULL").select("word", F.col("ending.word").alias("near"), F.col("ending.n").alias("near_n"))
    # Equal hashes of different prefixes can't add a pair.
    pairs = materialise(ended.where("levenshtein(word, near, 1) = 1").distinct(), "pairs")
    edges.unpersist()
    return pairs


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, form, root, n_near, form_n) for a table of distinct (word, n).

    A word's form is the most frequent word one edit away (equally frequent ones: the least in code-point order), if it occurs
    at least ``times`` times as often; else null. Its root is the last word on the way from form to form, itself without one.
    ``n_near`` counts the words one edit away. Null words are left out; an empty table gives no row; other columns are left out.
    """
    words = materialise(tagged(words, {"word": "word", "n": "n"}).where("word is not null"), "words")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    chosen = words.join(_dealt(near), "word", "left")
    strong = -F.col("best.minus") >= F.lit(times) * F.col("n")
    forms = chosen.select(
        "word",
        "n",
        F.when(strong, F.col("best.near")).alias("form"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("best.minus")).alias("form_n"),
    )
    forms = materialise(forms, "forms")
    # Each round doubles the steps that an entry has gone; a form is more frequent than its word, so there is no circle.
    links = materialise(forms.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(_dealt(further), "root", "left")
        links = materialise(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    final = forms.join(_dealt(links.select("word", "root")), "word", "left")
    return final.select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
