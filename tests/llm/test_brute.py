"""Second implementations in plain Python: the whole pipeline, language ID, the language model's score, inclusion odds."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from resaleworth.llm import language, max_entropy, mixing
from resaleworth.llm.text import word_hashes
from resaleworth.session import materialise

from .test_texts import SCHEMA, empty, expected_groups, expected_lines, frame, words_of

SF_DIR = "/root/testdata/sf0.001"


def guess(value, models, chunk=1024, least=0.005):
    """Language, score and whether it is rejected."""
    if not models or value is None or not any(c.isalpha() for c in value):
        return "und", 0.0, True
    data = "".join(c if c.isalpha() and c not in "_" else " " for c in value.lower())
    data = " ".join(data.split()).encode()
    settings = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=17, chain_log=18, search_log=4, min_match=4, target_length=32,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0,
    )
    sizes = []
    for name, content in models.items():
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tool = zstandard.ZstdCompressor(dict_data=words, compression_params=settings)
        sizes.append((sum(len(tool.compress(data[i : i + chunk])) for i in range(0, max(1, len(data)), chunk)), name))
    sizes.sort()
    margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
    return sizes[0][1], min(1.0, 4 * margin), margin < least


def test_language_id_again(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    models = language.fit_languages(docs.where("doc_id % 4 <> 2"))
    found = language.identify_language(docs, models).collect()
    # Letters outside the basic categories may differ; words of them do not occur here.
    for r in found:
        name, score, rejected = guess(r["text"], models)
        assert (r["lang_pred"], r["rejected"]) == (name, rejected) and r["score"] == pytest.approx(score)
    assert language.identify_language(empty(spark), models).collect() == []


def test_model_score_again(spark):
    """log P(class | history) + log P(word | class), token by token; one text is longer than a group of texts."""
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    rows = [(i, " ".join(words[40 * i : 40 * i + 40]), None, None, None) for i in range(60)]
    rows += [(100, "w1 " * 1_500_000, None, None, None), (101, "w1 new unseen w2", None, None, None), (102, None, None, None, None)]
    docs = frame(spark, rows)
    model = max_entropy.fit_model(docs.where("doc_id < 50"))
    got = {r["doc_id"]: r for r in max_entropy.score_texts(docs, model).collect()}
    counts = {r["word"]: r["n"] for r in model.counts.collect()}
    place = {int(word): i for i, word in enumerate(model.head)}
    start = int(max_entropy.START)

    def score(value):
        own = [int(h) for h in next(word_hashes([(value or "").encode()]))] + [int(max_entropy.END)]
        total = 0.0
        for i, word in enumerate(own):
            history = np.array([[own[j] for j in (i - 2, i - 1) if j >= 0]], dtype=np.uint64).ravel()
            tokens = np.append(history, np.uint64(word))
            rows_ = max_entropy.features(tokens, np.array([len(tokens)]), len(model.weights))[-1]
            logits = model.weights[rows_].astype(np.float64).sum(axis=0) + model.class_log
            group = int(model.head_class[place[word]]) if word in place else 0
            total += logits[group] - np.log(np.exp(logits).sum())
            if word in place:
                total += model.word_log[place[word]]
            else:
                n = counts.get(int(np.uint64(word).view(np.int64)), 0)
                unseen = model.discount * model.rest_words / model.rest_tokens if model.rest_tokens else 1.0
                seen = (n - model.discount) / max(model.rest_tokens, 1)
                total += math.log(seen if n else max(unseen, 0.5 / (model.rest_tokens + 0.5)))
        return total / math.log(10)

    assert start
    for doc, value, *_ in rows:
        if doc != 100:
            assert got[doc]["score"] == pytest.approx(score(value), rel=1e-4)
    assert got[100]["n_tokens"] == 1_500_001 and got[100]["n_known"] == 1_500_001


def test_weight_rows_grow_with_the_words():
    sizes = [max_entropy.weight_rows(n) for n in (0, 10**6, 10**7, 10**8, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == max_entropy.LEAST_ROWS and sizes[-1] == max_entropy.MOST_ROWS
    assert all(n & (n - 1) == 0 and n % max_entropy.CHUNK == 0 for n in sizes)


def uniform(doc):
    return (int(hashlib.md5(f"5:{'' if doc is None else doc}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13


def mixed(rows, weights=(5, 2, 1), share=1.5, most=2):
    """How often each (id, text, source) is taken."""
    size = [len(words_of(value)) for _, value, _ in rows]
    total = defaultdict(int)
    for (_, _, source), n in zip(rows, size, strict=True):
        total[source] += n
    order = sorted((s for s in total if s is not None), key=str.encode) + [s for s in total if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full = set()
    while True:
        free = [s for s in total if s not in full]
        level = (share * sum(total.values()) - sum(most * total[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level >= most * total[s]}
        if not above:
            break
        full |= above
    copies = [0] * len(rows)
    for source in total:
        target = most * total[source] if source in full else weight[source] * level
        whole = math.floor(target / total[source]) if total[source] else 0
        lack = target - whole * total[source]
        own = [i for i, row in enumerate(rows) if row[2] == source and size[i]]
        scale = None
        for n in sorted({size[i] for i in own}, reverse=True):
            tried = (lack - sum(size[i] for i in own if size[i] > n)) / sum(size[i] ** 2 for i in own if size[i] <= n)
            if tried * n < 1:
                scale = tried
                break
        ranked = []
        for i in own:
            copies[i] = whole
            p = scale * size[i] if lack > 0 else None
            if p is not None:
                odds = uniform(rows[i][0]) / (1 - uniform(rows[i][0])) / (p / (1 - p)) if p < 1 else 0.0
                ranked.append((odds / (1 + odds), rows[i][0], size[i], i))
        upto = 0
        for _, _, n, i in sorted(ranked):
            copies[i] += abs(upto + n - lack) <= abs(upto - lack)
            upto += n
    return copies


def test_mixing_again(spark):
    rng = random.Random(11)
    rows = [(i, "w " * int(rng.paretovariate(0.8)), None, rng.choice("abcd"), 0) for i in range(400)]
    got = {r["doc_id"]: r["copies"] for r in mixing.sample_copies(frame(spark, rows)).collect()}
    expected = mixed([(doc, value, source) for doc, value, _, source, _ in rows])
    assert got == {row[0]: n for row, n in zip(rows, expected, strict=True)}
    # The odds are unequal: in a source that lacks some words, long texts are taken more often.
    taken = defaultdict(list)
    for doc, value, _, source, _ in rows:
        if len({got[r[0]] for r in rows if r[3] == source}) > 1:
            taken[len(value) > 8].append(got[doc])
    assert np.mean(taken[True]) > np.mean(taken[False])


def brute_pipeline(rows, columns, models, tokenizer):
    """The pieces (id, start, length, ids) that the stages give, each on what its predecessor kept."""
    at = {name: i for i, name in enumerate(columns)}
    doc, text, source = at["doc_id"], at["text"], at["source"]
    rows = [row for row in rows if not guess(row[text], models)[2]]
    lines = {key: kept for key, _, _, kept in expected_lines([(r[doc], r[text]) for r in rows])}
    rows = [tuple(lines[r[doc]] if i == text and r[text] is not None else v for i, v in enumerate(r)) for r in rows]
    groups = expected_groups([(r[doc], r[text]) for r in rows], 5, 8, 10)
    rows = [r for r in rows if r[doc] is None or groups[r[doc]] == r[doc]]
    slow, pieces = Tokenizer.from_file(tokenizer), []
    for row, n in zip(rows, mixed([(r[doc], r[text], r[source]) for r in rows]), strict=True):
        ids = [*slow.encode(row[text] or "", add_special_tokens=False).ids, 1]
        start = 0
        while start < len(ids):
            left = len(ids) - start
            length = 2048 if left >= 2048 else 1 << (left.bit_length() - 1)
            pieces += [(row[doc], start, length, np.array(ids[start : start + length], dtype="<u4").tobytes())] * n
            start += length
    return sorted(pieces)


def run_stages(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF_DIR), name)
    return docs


def test_pipeline_again(spark, tokenizer):
    """Rows of the whole pipeline, texts that are null, empty, without a letter, repeated and long among them."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    long = docs.where("text is not null").orderBy(F.desc("n_chars")).first()
    odd = [(9001, None, "en", "web", 0), (9002, "", None, None, 0), (9003, "12 .. 3", "en", "web", 7)]
    odd += [(9004, long["text"], long["lang"], "other", 1), (9005, f"{long['text']} {long['text']}", long["lang"], long["source"], 1)]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, SCHEMA))
    both = materialise(both.withColumn("sequence_id", F.lit("extra")), "odd")
    models = language.fit_languages(both)
    got = run_stages(spark, both).collect()
    expected = brute_pipeline([tuple(r) for r in both.collect()], both.columns, models, tokenizer)
    assert sorted((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in got) == expected
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))


def test_pipeline_of_nothing(spark):
    assert run_stages(spark, empty(spark)).collect() == []
    only_odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "web", 0)], SCHEMA)
    assert run_stages(spark, only_odd).collect() == []
