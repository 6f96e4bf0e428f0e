"""Substring dedup against brute force, and its defined results for odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from resaleworth.llm import substring_dedup


def corpus(seed=3, n=150):
    """Random words with shared passages, near copies and texts of one word only."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "é"]
    shared = [rng.choices(vocabulary, k=rng.randint(30, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choices(vocabulary, k=rng.randint(0, 60))
            if rng.random() < 0.4:
                start = rng.randint(0, 10)
                words += rng.choice(shared)[start : start + rng.randint(20, 90)]
        if rows and rng.random() < 0.25:
            words = (rng.choice(rows)[1] or "").split()
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = "X"
        rows.append((i, "\n ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "a " * 100), (903, "a " * 100), (904, "b " * 35), (905, "q " * 36), (None, "q " * 36), (None, None)]


def expected(rows, window):
    counts = Counter()
    for _, value in rows:
        words = (value or "").split()
        counts.update(tuple(words[p : p + window]) for p in range(len(words) - window + 1))
    out = []
    for doc, value in rows:
        words = (value or "").split()
        lost = set()
        for p in range(len(words) - window + 1):
            if counts[tuple(words[p : p + window])] > 1:
                lost.update(range(p, p + window))
        kept = None if value is None else " ".join(word for i, word in enumerate(words) if i not in lost)
        out.append((doc, len(words), len(lost), kept))
    return sorted(out, key=repr)


def result(docs, window):
    kept = substring_dedup.drop_repeated(docs, window=window)
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in kept.collect()], key=repr)


@pytest.mark.parametrize("window", [35, 4, 5, 7, 12, 90])
def test_removed_words(spark, window):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(docs, window) == expected(rows, window)


def test_long_texts_in_steps(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "STEP", 50)
    rows = corpus(seed=8, n=40)
    parts = list(substring_dedup._steps([(value or "").encode() for _, value in rows], 35))
    covered = {(i, p) for _, number, place in parts for i, p in zip(number.tolist(), place.tolist(), strict=True)}
    assert covered == {(i, p) for i, (_, v) in enumerate(rows) for p in range(len((v or "").split())) if len((v or "").split()) >= 35}
    windows = [(n[p], place[p]) for _, n, place in parts for p in range(len(n) - 34) if n[p] == n[p + 34]]
    assert len(windows) == len(set(windows)) == sum(max(0, len((v or "").split()) - 34) for _, v in rows)


def test_equal_windows_have_equal_runs():
    rng = random.Random(1)
    words = [hash(rng.random()) & 0xFFFFFFFFFFFF for _ in range(500)]
    import numpy as np

    twice = np.array(words + words, dtype=np.uint64)
    runs = substring_dedup.anchored_runs(twice, np.repeat([0, 1], 500), 35)
    half = len(runs["lo"]) // 2
    for name in ("quarter", "half", "whole"):
        assert (runs[name][:half] == runs[name][half:]).all()
    assert (runs["hi"] - runs["lo"] + 1).sum() == 2 * (500 - 34)
    assert half < 100  # one anchor for about ten windows


def test_extra_columns_and_empty_table(spark):
    schema = "DOC long, Text string, n_words string, `_doc` string, `a b` struct<x:int,`y z`:array<string>>"
    rows = [(i, "same " * 40, "old", "mine", (i, ["é"])) for i in range(3)]
    kept = substring_dedup.drop_repeated(spark.createDataFrame(rows, schema), "DOC", "Text")
    assert kept.columns == ["DOC", "Text", "_doc", "a b", "n_words", "n_removed"]
    assert sorted(map(tuple, kept.collect()))[2] == (2, "", "mine", (2, ["é"]), 40, 40)
    assert substring_dedup.drop_repeated(spark.createDataFrame([], schema), "DOC", "Text").count() == 0
    with pytest.raises(ValueError, match="four words"):
        substring_dedup.repeated_windows(spark.createDataFrame([], schema), "DOC", "Text", 3)


def test_hot_passage_makes_no_pairs(spark):
    """A passage in every text costs one stand-in and the windows at its edges."""
    passage = " ".join(f"p{i}" for i in range(200))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.concat_ws(" ", *[F.hash("id", F.lit(i)) for i in range(40)]), F.lit(" " + passage)).alias("text"))
    kept = substring_dedup.drop_repeated(docs)
    assert kept.where("n_removed <> 200 OR n_words <> 240").count() == 0
