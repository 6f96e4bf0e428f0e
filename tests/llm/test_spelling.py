"""Spelling variants against brute force over all one-edit strings."""

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from resaleworth.llm import spelling_variants


def brute_words(rows, every, least=6, often=5):
    counts = Counter()
    for doc, value in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", value or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {word: n for word, n in counts.items() if len(word) >= least and n >= often}


def brute_groups(counts, times=5):
    letters = sorted({c for word in counts for c in word})
    near = defaultdict(set)
    for w in counts:
        ways = {w[:i] + w[i + 1 :] for i in range(len(w))}
        ways |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = {x for x in ways if x in counts and x != w}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, counts[w], form[w], root, len(near[w]), counts.get(form[w])))
    return sorted(rows, key=repr)


def vocabulary(seed):
    """Short words over few letters with many edits between them, and long ones that share nearly everything."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(100)]
    words += ["x" * 200, "x" * 201, "x" * 100 + "y" + "x" * 100, "x" * 100 + "y" + "x" * 101, "a", "ab", "b", "é"]
    counts = {}
    for word in words:
        for _ in range(4):
            value = list(word)
            for _ in range(rng.randint(0, 2)):
                at, what = rng.randrange(len(value)), rng.random()
                if what < 0.4:
                    value[at] = rng.choice("abcéÿ")
                elif what < 0.7:
                    value.insert(at, rng.choice("abcd"))
                elif len(value) > 1:
                    del value[at]
            counts["".join(value)] = 5 * 2 ** rng.randint(0, 10)
    return counts


def test_groups(spark):
    for seed in (7, 8):
        counts = vocabulary(seed)
        table = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string").repartition(4)
        got = sorted(map(tuple, spelling_variants.group_variants(table).collect()), key=repr)
        assert got == brute_groups(counts)


def test_counted_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(None, "Überall überall " * 3), (7, None), (8, ""), (9, "ÀÿÀÿÀÿ" * 40_000), (9, "wörter42wörter Wörter WÖRTER " * 5)]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema)).select(F.lit(1).alias("word"), "*", F.lit(2).alias("n"))
    rows = [(r.doc_id, r.text) for r in both.collect()]
    for every in (0, 3, 199):
        got = {r.word: r.n for r in spelling_variants.count_words(both, slip_every=every).collect()}
        assert got == brute_words(rows, every)


def test_tasks_pass_words_on(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD", 3)
    docs = spark.createDataFrame([(i, "eleven " * 3 + f"word{chr(97 + i % 26) * 4} ") for i in range(60)], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.word: r.n for r in spelling_variants.count_words(docs, min_count=2).collect()} == brute_words(rows, 0, often=2)


def test_empty_and_null(spark):
    schema = "word string, n long"
    assert spelling_variants.group_variants(spark.createDataFrame([], schema)).count() == 0
    rows = spelling_variants.group_variants(spark.createDataFrame([(None, 9), ("alone", 5)], schema)).collect()
    assert list(map(tuple, rows)) == [("alone", 5, None, "alone", 0, None)]
    # Equally frequent neighbours: the least in code-point order.
    tied = spark.createDataFrame([("wordz", 50), ("worda", 50), ("word", 10)], schema)
    assert {r.word: r.form for r in spelling_variants.group_variants(tied).collect()}["word"] == "worda"


def test_no_table_of_words_goes_through_the_driver(spark, monkeypatch):
    plans, store = [], spelling_variants.materialise

    def watched(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return store(df, label)

    monkeypatch.setattr(spelling_variants, "materialise", watched)
    table = spark.createDataFrame([(w, n) for w, n in vocabulary(7).items()], "word string, n long")
    final = spelling_variants.group_variants(table)
    plans.append(("final", final._jdf.queryExecution().executedPlan().toString()))
    assert sum("SortMergeJoin" in plan for _, plan in plans) >= 6
    assert [label for label, plan in plans if "Broadcast" in plan] == []
