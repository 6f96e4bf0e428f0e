"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class comes from a softmax over hashed features of the
history: the word before, the one before that (a skip), and both together. Frequent words are the head: the most
frequent have a class of their own, the others share classes of like endings and about equal mass, in which their
counts decide. All other words, unseen ones included, are one more class, whose members share its mass by their
counts less a discount, which is the mass of the unseen.

Counts come from all training texts. So do the gradient updates: tasks walk over their texts in small batches, and
their weights are averaged, each row by how often a task has met it. Weights, head and classes have a fixed size, so
they may go to every task; the counts of rare words stay a table and meet the texts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from resaleworth.llm.text import encoded, fresh, map_batches, mixed, tagged, with_columns, word_endings, word_hashes
from resaleworth.session import materialise

# Words of the head at most, those with a class of their own, and classes in all.
HEAD, ALONE, CLASSES = 1 << 18, 24, 64
# Rows of weights: one for about so many different words, within these bounds (64 rows are 16 KB).
WORDS_A_ROW, LEAST_ROWS, MOST_ROWS = 64, 1 << 14, 1 << 18
# Tokens of one gradient update, of one walk, and weight rows sent together.
STEP, WALK, CHUNK = 4096, 1 << 22, 1024
# Characters of texts that a task turns into arrays at once; a longer text is taken alone.
GROUP = 1 << 22
END, START = np.uint64(0xE0D), np.uint64(0x57A27)
KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


@dataclass
class Model:
    """What the tasks need; ``counts`` is the table (word, n) of all training words."""

    counts: DataFrame
    tokens: int  # of training texts
    words: int  # different ones
    head: np.ndarray  # sorted hashes
    head_counts: np.ndarray
    head_class: np.ndarray
    word_log: np.ndarray  # log P(word | class) of the head
    class_log: np.ndarray  # log of each class's share
    rest_tokens: int  # tokens outside the head, and different words there
    rest_words: int
    rest_single: int  # words of the rest seen once
    weights: np.ndarray

    @property
    def discount(self) -> float:
        """What each word of the rest gives to the unseen; about the share of words seen once."""
        return min(0.9, self.rest_single / self.rest_words) if self.rest_words else 0.0

    def rest_probability(self, n) -> object:
        """P(word | rest) for a word seen n times, as a column; unseen words share one outcome."""
        unseen = self.discount * self.rest_words / self.rest_tokens if self.rest_tokens else 1.0
        seen = (n - self.discount) / max(self.rest_tokens, 1)
        return F.when(n > 0, seen).otherwise(max(unseen, 0.5 / (self.rest_tokens + 0.5)))


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of at most ``GROUP`` characters together."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text or "") > GROUP:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield held


def _token_arrays(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts with an end after each, and the number of tokens of each text."""
    parts = [np.append(words, END) for words in word_hashes(encoded(texts))]
    return np.concatenate(parts), np.array([len(p) for p in parts])


def count_words(texts: DataFrame) -> DataFrame:
    """(word, ending, n) of the column ``text``: hashes, counted per batch and then over all."""

    def counted(batch: pa.RecordBatch) -> dict[str, list]:
        parts = []
        for group in groups(batch["text"].to_pylist()):
            data = encoded(group)
            words = np.concatenate([*word_hashes(data), np.full(len(data), END)])
            endings = np.concatenate([*[word_endings(d.lower()) for d in data], np.zeros(len(data), dtype=np.int64)])
            found, first, n = np.unique(words, return_index=True, return_counts=True)
            parts.append((found.view(np.int64), endings[first], n))
        return dict(zip(("word", "ending", "n"), map(np.concatenate, zip(*parts, strict=True)), strict=True))

    rows = map_batches(texts, counted, "word long, ending long, n long")
    return rows.groupBy("word", "ending").agg(F.sum("n").alias("n")).groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def _head(counts: DataFrame) -> list:
    """The most frequent words: those of at least the count at which there are ``HEAD`` or fewer, and the end."""
    cell = F.floor(F.log2("n") * 8).cast("int")
    cells = {r["cell"]: r["words"] for r in counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("words")).collect()}
    total, least = 0, None
    for at in sorted(cells, reverse=True):
        total += cells[at]
        if total > HEAD:
            break
        least = at
    chosen = F.col("word") == int(END)
    return counts.where(chosen if least is None else chosen | (cell >= least)).collect()


def _classes(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and classes of the head, sorted by hash. Class 0 is for all other words, 1 for the end."""
    words = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64)
    n = np.array([r["n"] for r in rows], dtype=np.int64)
    endings = np.array([r["ending"] for r in rows], dtype=np.int64)
    order = np.argsort(words)
    words, n, endings = words[order], n[order], endings[order]
    by_count = np.lexsort((words, -n))
    by_count = by_count[words[by_count] != END]
    group = np.zeros(len(words), dtype=np.int64)
    group[words == END] = 1
    alone, shared = by_count[:ALONE], by_count[ALONE:]
    group[alone] = 2 + np.arange(len(alone))
    shared = shared[np.lexsort((words[shared], endings[shared]))]
    mass = np.cumsum(n[shared])
    if len(shared):
        places = CLASSES - 2 - ALONE
        group[shared] = 2 + ALONE + np.minimum((mass - n[shared]) * places // mass[-1], places - 1)
    return words, n, group


def weight_rows(words: int) -> int:
    """Rows of weights for a corpus of so many different words: a power of two that grows with them, up to what tasks can hold."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << (words // WORDS_A_ROW).bit_length()))


def features(tokens: np.ndarray, sizes: np.ndarray, n_rows: int) -> np.ndarray:
    """(tokens, 3) rows of weights: the word before, the skip, both. No history reaches over a text's start."""
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    back1, back2 = np.empty_like(tokens), np.empty_like(tokens)
    back1[1:], back2[2:] = tokens[:-1], tokens[:-2]
    back1[first] = START
    back2[:2] = START
    back2[first] = START
    back2[first[sizes > 1] + 1] = START
    with np.errstate(over="ignore"):
        one, skip = mixed(back1 * KINDS[0]), mixed(back2 * KINDS[1])
        both = mixed(one ^ (skip * KINDS[2]))
    return np.stack([(h & np.uint64(n_rows - 1)).astype(np.int32) for h in (one, skip, both)], axis=1)


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Up to a constant per token; the largest is 0."""
    logits = weights[rows[:, 0]]
    logits += weights[rows[:, 1]]
    logits += weights[rows[:, 2]]
    logits += bias
    logits -= logits.max(axis=1, keepdims=True)
    return logits


def log_probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(class of each token | its history)."""
    logits = _logits(weights, bias, rows)
    chosen = logits[np.arange(len(target)), target]
    return chosen - np.log(np.exp(logits, out=logits).sum(axis=1))


def _sums(values: np.ndarray, source: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each segment of ``source`` the sum of the rows of ``values`` that it names; most segments are short."""
    total, taken = values[source[first]], 1
    left = np.flatnonzero(sizes > taken)
    while len(left) and taken < 16:
        total[left] += values[source[first[left] + taken]]
        taken += 1
        left = left[sizes[left] > taken]
    for i in left:
        total[i] += values[source[first[i] + taken : first[i] + sizes[i]]].sum(axis=0)
    return total


class Trainer:
    """Gradient updates with steps that shrink by what a row has seen."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, rate: float) -> None:
        self.weights, self.bias, self.rate = weights.copy(), bias, rate
        self.squares, self.met = np.full(len(weights), 1.0, dtype=np.float32), np.zeros(len(weights), dtype=np.int64)

    def update(self, rows: np.ndarray, target: np.ndarray) -> None:
        gradient = _logits(self.weights, self.bias, rows)
        np.exp(gradient, out=gradient)
        gradient *= -1 / gradient.sum(axis=1, keepdims=True)
        gradient[np.arange(len(target)), target] += 1
        # All three kinds in one sort by row; 16-bit rows sort by radix.
        flat = rows.T.ravel()
        order = np.argsort(flat.astype(np.uint16) if len(self.weights) <= 1 << 16 else flat, kind="stable")
        sorted_rows = flat[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
        used, n = sorted_rows[first], np.diff(first, append=len(order))
        total = _sums(gradient, order % len(target), first, n)
        self.squares[used] += np.einsum("rc,rc->r", total, total)
        total *= (self.rate / np.sqrt(self.squares[used]))[:, None]
        self.weights[used] += total
        self.met[used] += n


def classes_of(tokens: np.ndarray, head: np.ndarray, head_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each token in the head, or -1, and its class."""
    if not len(head):
        return np.full(len(tokens), -1), np.zeros(len(tokens), dtype=np.int64)
    at = np.minimum(np.searchsorted(head, tokens), len(head) - 1)
    known = head[at] == tokens
    return np.where(known, at, -1), np.where(known, head_class[at], 0)


def train_weights(
    texts: DataFrame, tokens: int, n_rows: int, head: np.ndarray, head_class: np.ndarray, class_log: np.ndarray, rounds: int, rate: float
) -> np.ndarray:
    """Weights after ``rounds`` rounds over all texts. A walk goes over about ``WALK`` of the ``tokens``, so it does not grow with the input."""
    context = texts.sparkSession.sparkContext
    weights = np.zeros((n_rows, CLASSES), dtype=np.float32)
    schema = "chunk int, met binary, weights binary"
    for _ in range(rounds):
        state = context.broadcast((head, head_class, class_log.astype(np.float32), weights))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, classes, bias, start = state.value
            trainer = Trainer(start, bias, rate)
            for batch in batches:
                for texts_ in groups(batch["text"].to_pylist()):
                    tokens, sizes = _token_arrays(texts_)
                    rows, target = features(tokens, sizes, len(start)), classes_of(tokens, words, classes)[1]
                    for at in range(0, len(tokens), STEP):
                        trainer.update(rows[at : at + STEP], target[at : at + STEP])
            for at in range(0, len(start), CHUNK):
                met = trainer.met[at : at + CHUNK]
                if met.any():
                    own = trainer.weights[at : at + CHUNK] * met[:, None].astype(np.float32)
                    yield pa.record_batch([pa.array([at // CHUNK], pa.int32()), pa.array([met.tobytes()]), pa.array([own.tobytes()])], ["chunk", "met", "weights"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for chunk, met, own in zip(*(batch[c].to_pylist() for c in ("chunk", "met", "weights")), strict=True):
                    sums = total.setdefault(chunk, [0, 0])
                    sums[0] = sums[0] + np.frombuffer(met, dtype=np.int64)
                    sums[1] = sums[1] + np.frombuffer(own, dtype=np.float32).astype(np.float64)
            for chunk, (met, own) in total.items():
                mean = (own.reshape(CHUNK, CLASSES) / np.maximum(met, 1)[:, None]).astype(np.float32)
                yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([met.tobytes()]), pa.array([mean.tobytes()])], ["chunk", "met", "weights"])

        walkers = texts.coalesce(max(1, -(-tokens // WALK))).mapInArrow(walk, schema)
        weights = weights.copy()
        for chunk, _, mean in walkers.repartition("chunk").mapInArrow(added, schema).collect():  # n_rows / CHUNK rows
            weights[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(mean, dtype=np.float32).reshape(CHUNK, CLASSES)
        state.destroy()
    return weights


def fit_model(docs: DataFrame, text_col: str = "text", rounds: int = 1, rate: float = 1.0, n_rows: int | None = None) -> Model:
    """Counts and weights from all rows of ``docs``. Null texts are empty: an end alone. No rows: all is unseen.

    ``n_rows``, a power of two of at least ``CHUNK``, is the number of weight rows; without it the counted words decide.
    """
    texts = tagged(docs, {"text": text_col})
    counts = materialise(count_words(texts), "words")
    tokens, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head, n, group = _classes(_head(counts))
    mass = np.bincount(group, weights=n, minlength=CLASSES)
    mass[0] = tokens - n.sum()
    smooth = (mass + 0.5) / (mass + 0.5).sum()
    word_log = np.log(n / np.maximum(mass[group], 1)) if len(n) else np.zeros(0)
    single = counts.where("n = 1").count() - int((n == 1).sum())
    weights = train_weights(texts, tokens, n_rows or weight_rows(words), head, group, np.log(smooth), rounds, rate)
    return Model(counts, tokens, words, head, n, group, word_log, np.log(smooth), int(mass[0]), words - len(n), single, weights)


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``, both base-10 logarithms.

    Tokens are the words of the whole text and one end. ``base_score`` adds log10((c + 0.5) / (N + 0.5 * (V + 1))) for
    tokens seen c times in training of N tokens, V different. ``score`` is the model's probability of the same tokens.
    ``n_known`` counts tokens with c > 0. Words are compared by 64-bit hashes.

    Null or empty text: the end alone. Repeated rows are scored one by one. Columns of the five names are replaced.
    """
    context = docs.sparkSession.sparkContext
    scale = model.tokens + 0.5 * (model.words + 1)
    sent = context.broadcast((model.head, model.head_counts, model.head_class, model.word_log, model.class_log.astype(np.float32), model.weights))
    row = fresh(docs, "_row")
    names = ("n_tokens", "head", "score", "base", "rest", "times")

    def score(texts: pd.Series) -> pd.DataFrame:
        found = [score_group(group) for group in groups(texts.to_list())]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame([], columns=list(names))

    def score_group(texts: list[str | None]) -> pd.DataFrame:
        head, counts, group, word_log, bias, weights = sent.value
        tokens, sizes = _token_arrays(texts)
        rows = features(tokens, sizes, len(weights))
        at, target = classes_of(tokens, head, group)
        logs = np.empty(len(tokens))
        for i in range(0, len(tokens), STEP):
            logs[i : i + STEP] = log_probabilities(weights, bias, rows[i : i + STEP], target[i : i + STEP])
        inside = at >= 0
        if len(head):
            logs += np.where(inside, word_log[at], 0.0)
            base = np.where(inside, np.log10((counts[at] + 0.5) / scale), 0.0)
        else:
            base = np.zeros(len(tokens))
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        out = {"n_tokens": sizes, "head": np.add.reduceat(inside.astype(np.int64), first)}
        out |= {"score": np.add.reduceat(logs, first) / np.log(10), "base": np.add.reduceat(base, first)}
        rest, times = [], []
        for start, size in zip(first, sizes, strict=True):
            own = tokens[start : start + size]
            found, n = np.unique(own[~inside[start : start + size]], return_counts=True)
            rest.append(found.view(np.int64))
            times.append(n)
        return pd.DataFrame(out | {"rest": rest, "times": times}, columns=list(names))

    scored = F.pandas_udf(score, "n_tokens long, head long, score double, base double, rest array<long>, times array<long>")
    kept = [c for c in docs.columns if c.lower() not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    parts = fresh(docs, "_parts")
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(row), scored(F.col(f"`{text_col}`")).alias(parts))
    stored = materialise(out, "scores")
    rest = stored.select(row, F.explode(F.arrays_zip(F.col(f"{parts}.rest"), F.col(f"{parts}.times"))).alias("one"))
    rest = rest.select(row, F.col("one.rest").alias("word"), F.col("one.times").alias("times"))
    seen = rest.join(model.counts.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = seen.groupBy(row).agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(model.rest_probability(F.col("n")))).alias("score"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(scale))).alias("base"),
    )
    of, more = fresh(stored, "_of"), fresh(stored, "_more")
    sums = sums.select(F.col(row).alias(of), F.struct("known", "score", "base").alias(more))
    joined = stored.join(sums, F.col(row) == F.col(of), "left")
    zero = F.lit(0.0)
    new = {
        "n_tokens": F.col(f"{parts}.n_tokens"),
        "n_known": F.col(f"{parts}.head") + F.coalesce(F.col(f"{more}.known"), F.lit(0)),
        "train_tokens": F.lit(model.tokens).cast("long"),
        "base_score": F.col(f"{parts}.base") + F.coalesce(F.col(f"{more}.base"), zero),
        "score": F.col(f"{parts}.score") + F.coalesce(F.col(f"{more}.score"), zero),
    }
    return with_columns(joined, new, drop=(row, of, parts, more))
