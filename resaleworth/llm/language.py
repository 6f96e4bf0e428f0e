"""Language ID by compression: the language whose sample words help most to shorten a text."""

from __future__ import annotations

import random
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame, Window as W, functions as F

from resaleworth.llm.text import fresh, with_columns

# Characters read from one sample document, so that a few long ones don't fill a dictionary.
SAMPLE_CHARS = 2000
# Dictionaries together; they are sent to every task.
MAX_BYTES = 64 << 20
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Letters in lower case, anything else as one space."""
    return _OTHER.sub(" ", text.lower()).strip().encode()


def dictionaries(samples: dict[str, list[bytes]], dictionary_bytes: int) -> dict[str, bytes]:
    """Raw content for each language from its sample texts.

    Words that are more frequent in another language are left out, so that a foreign passage in a sample does
    not count for the language. The rest are shuffled, so that words match and passages don't.
    """
    counts = {lang: Counter(b" ".join(texts).split()) for lang, texts in samples.items()}
    totals = {lang: max(1, found.total()) for lang, found in counts.items()}
    out = {}
    for lang, found in sorted(counts.items()):
        own = {w for w, n in found.items() if all(n * totals[o] >= counts[o][w] * totals[lang] for o in counts)}
        words = [w for w in b" ".join(samples[lang]).split() if w in own]
        random.Random(lang).shuffle(words)
        if content := b" ".join(words)[:dictionary_bytes]:
            out[lang] = content
    return out


def fit_languages(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", samples: int = 300,
    dictionary_bytes: int = 1 << 16,
) -> dict[str, bytes]:
    """A raw-content dictionary for each language, from a bounded sample of its labelled rows.

    The sample is the ``samples`` documents of smallest id hash in each language, from whose middles at most
    ``SAMPLE_CHARS`` characters are read. So what the driver sees is bounded by the number of languages;
    dictionaries of more than ``MAX_BYTES`` in all are an error.
    Rows without a label or a letter teach nothing; no rows at all give no language.
    """
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`").cast("string")
    start = F.greatest(F.lit(1), ((F.length(text) - SAMPLE_CHARS) / 2).cast("int"))
    rows = docs.where(lang.isNotNull() & text.rlike(r"\p{L}")).select(
        lang.alias("lang"), F.substring(text, start, F.lit(SAMPLE_CHARS)).alias("text"),
        F.xxhash64(F.lit(6), F.col(f"`{id_col}`")).alias("place"),
    )
    first = W.partitionBy("lang").orderBy("place", "text")
    chosen = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= samples)
    parts: dict[str, list[bytes]] = {}
    for row in chosen.orderBy("lang", "n").collect():
        parts.setdefault(row["lang"], []).append(plain(row["text"]))
    models = dictionaries(parts, dictionary_bytes)
    if sum(map(len, models.values())) > MAX_BYTES:
        raise ValueError(f"{len(models)} languages need more than {MAX_BYTES} bytes of dictionaries")
    return models


@lru_cache(maxsize=2)
def compressors(models: tuple[tuple[str, bytes], ...]) -> list[zstd.ZstdCompressor]:
    """One per language; matches of four bytes count, and none are sought far."""
    found = []
    for _, content in models:
        settings = zstd.ZstdCompressionParameters(
            window_log=18, hash_log=17, chain_log=18, search_log=4, min_match=4, target_length=32,
            strategy=zstd.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0,
        )
        words = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=settings)
        found.append(zstd.ZstdCompressor(dict_data=words, compression_params=settings))
    return found


def identify_language(
    docs: DataFrame, models: dict[str, bytes], text_col: str = "text", chunk: int = 1024, min_margin: float = 0.005
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    The whole text is cut into chunks of ``chunk`` bytes, each compressed with the dictionary of every language.
    The language of smallest total wins, ties by name. With a the winner's total and b the next one's, the margin
    is 1 - a/b and the score min(1, 4 * margin). ``rejected`` means a margin under ``min_margin``.

    Null text or no letter: ``und``, score 0, rejected. The same if no language was learned. With a single
    learned language there is nothing to compare: it wins with score 1. Columns of the three names are replaced.
    """
    ordered = tuple(sorted(models.items()))
    names = [name for name, _ in ordered]

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        tools, rows = compressors(ordered), []
        for text in texts:
            if not names or text is None or not any(map(str.isalpha, text)):
                rows.append(("und", 0.0, True))
                continue
            data = plain(text)
            pieces = [data[i : i + chunk] for i in range(0, len(data), chunk)] or [b""]
            sizes = sorted((sum(len(tool.compress(p)) for p in pieces), name) for tool, name in zip(tools, names, strict=True))
            margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
            rows.append((sizes[0][1], min(1.0, 4 * margin), margin < min_margin))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    name = fresh(docs, "_found")
    found = docs.withColumn(name, predicted(F.col(f"`{text_col}`")))
    return with_columns(found, {c: F.col(f"{name}.{c}") for c in ("lang_pred", "score", "rejected")}, drop=(name,))
