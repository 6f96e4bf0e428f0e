"""One query per training-data operator over its whole table, and the pipeline."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from resaleworth.llm import (
    conversation_repair,
    graph_search,
    jaccard_join,
    language,
    lattice_dedup,
    license_scan,
    line_dedup,
    max_entropy,
    mixing,
    packing,
    spelling_variants,
    substring_dedup,
    token_edits,
)
from resaleworth.llm.text import text_session
from resaleworth.queries.registry import Registry

query = Registry()

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


@query(
    """
WITH RECURSIVE units AS (
  SELECT vec_id, list_transform(e, lambda x: x / n) AS u
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  WHERE n > 0
),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM units a JOIN units b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.9
),
reach AS (
  SELECT vec_id AS start, vec_id AS node FROM embeddings
  UNION
  SELECT r.start, l.y FROM reach r JOIN links l ON r.node = l.x
),
lowest AS (SELECT start, min(node) AS component_id FROM reach GROUP BY start)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id)::BIGINT AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN lowest ON start = e.vec_id
"""
)
def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), min_cosine=0.9)
    return found.select("vec_id", "n_links", "component_id", "kept")


# Personal data, keys and runs of one sign; what takes their place; what every match holds.
DIGIT = re.compile(r"\d")
REDACTIONS = (
    (r"[\w.+-]+@[\w-]+\.[\w.-]*\w", "[email]", ("@",)),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "[address]", DIGIT),
    (r"\+?\d[\d .()-]{6,}\d", "[number]", DIGIT),
    (r"\b[0-9a-f]{32,}\b", "[key]", re.compile(r"[0-9a-f]{32}")),
    (r"\${3,}|%{3,}|&{3,}|#{3,}|\*{3,}|!{3,}", "", ("$$$", "%%%", "&&&", "###", "***", "!!!")),
)


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edits = token_edits.replacements(F.col("text"), REDACTIONS)
    counted = token_edits.count_with_edits(docs, edits, TOKENIZER)
    digest = F.sha2("edited_text", 256).alias("edited_sha256")
    return counted.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded", digest)


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.split_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "part", "nth")
    return packing.number_sequences(digests)


@query()
def op4_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest_rows(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


@query(
    """
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size
  FROM documents
),
sources AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
    CASE (row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)
),
levels AS (
  SELECT 0 AS turn, 1.5::DOUBLE * (SELECT sum(source_size) FROM sources) / (SELECT sum(weight) FROM sources) AS level
  UNION ALL
  SELECT turn + 1, greatest(level, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
    - coalesce((SELECT sum(cap) FROM sources WHERE weight * level >= cap), 0))
    / (SELECT sum(weight) FROM sources WHERE weight * level < cap))
  FROM levels
  WHERE turn < 30 AND EXISTS (SELECT 1 FROM sources WHERE weight * level < cap)
),
targets AS (
  SELECT source, source_size, CASE WHEN weight * level >= cap THEN cap ELSE weight * level END AS target
  FROM sources, (SELECT max(level) AS level FROM levels)
),
plan AS (
  SELECT *, target - whole * source_size AS lack
  FROM (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM targets)
),
by_size AS (SELECT source, size, (count(*) * size)::BIGINT AS words FROM sizes WHERE size > 0 GROUP BY source, size),
tried AS (
  SELECT b.source, size, (lack - (sum(words) OVER (PARTITION BY b.source ORDER BY size DESC) - words)::DOUBLE)
    / (sum(words::HUGEINT * size) OVER (PARTITION BY b.source ORDER BY size))::DOUBLE AS scale
  FROM by_size b JOIN plan t ON b.source IS NOT DISTINCT FROM t.source WHERE lack > 0
),
scales AS (SELECT source, arg_max(scale, size) AS scale FROM tried WHERE scale * size < 1 GROUP BY source),
ranked AS (
  SELECT doc_id, size, s.source, source_size, target, whole, lack, c.scale, scale * size AS p,
    (('0x' || substr(md5('5:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN plan t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN scales c ON s.source IS NOT DISTINCT FROM c.source
),
steps AS (
  SELECT *, sum(CASE WHEN scale IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id, size) AS upto
  FROM (SELECT *, CASE WHEN p < 1 THEN odds / (1 + odds) ELSE 0 END AS rank
    FROM (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM ranked))
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * (whole
  + CASE WHEN scale IS NOT NULL AND abs(upto - lack) <= abs(upto - size - lack) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM steps
"""
)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = mixing.sample_copies(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most_copies=2)
    return sampled.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query()
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    models = language.fit_languages(docs.where(~held_out))
    found = language.identify_language(docs.select("doc_id", "text"), models)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query()
def op7_max_entropy_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 1
    model = max_entropy.fit_model(docs.where(~held_out))
    scored = max_entropy.score_texts(docs, model)
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return scored.select("doc_id", held_out.alias("held_out"), *names)


def _license_sql() -> str:
    """The best window of every template by brute force: all windows, all templates of the class, all version phrases."""

    def rows(pairs: list[tuple[str, str]]) -> str:
        return ", ".join("(" + ", ".join("'" + value.replace("'", "''") + "'" for value in pair) + ")" for pair in pairs)

    phrases = [(name, phrase) for name, own in license_scan.VERSIONS.items() for phrase in own]
    return f"""
WITH notices(template, txt) AS (VALUES {rows(license_scan.TEMPLATES)}),
phrases(template, txt) AS (VALUES {rows(phrases)}),
tw AS (
  SELECT template, list_filter(regexp_split_to_array(lower(txt), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM notices
),
pw AS (
  SELECT template, list_filter(regexp_split_to_array(lower(txt), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM phrases
),
needed AS (
  SELECT DISTINCT template, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT template, w, unnest(generate_series(1, len(w) - 2)) AS i FROM pw)
),
ts AS (
  SELECT DISTINCT template, array_to_string(w[i:i + 2], ' ') AS s, CAST(2 * pow(2, ceil(log2(len(w)))) AS BIGINT) AS width
  FROM (SELECT template, w, unnest(generate_series(1, len(w) - 2)) AS i FROM tw)
),
marked AS (SELECT ts.*, needed.s IS NOT NULL AS need FROM ts LEFT JOIN needed ON ts.template = needed.template AND ts.s = needed.s),
tn AS (SELECT template, width, count(*) AS n, count(*) FILTER (need) AS needs FROM marked GROUP BY ALL),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents
),
ds AS (
  SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM dw WHERE len(w) >= 3)
),
hits AS (
  SELECT doc_id, template, width, s, need, p, (p // (width // 2) - b) * (width // 2) AS start
  FROM ds JOIN marked USING (s), (VALUES (0), (1)) AS back(b)
),
windows AS (
  SELECT doc_id, template, start, count(DISTINCT s) AS c, count(DISTINCT s) FILTER (need) AS has FROM hits
  WHERE start >= 0 AND p + 3 <= start + width GROUP BY ALL
),
good AS (
  SELECT doc_id, template, start, c / n AS share FROM windows JOIN tn USING (template) WHERE c / n >= 0.8 AND has = needs
)
SELECT doc_id, template, max(share) AS share, arg_min(start, struct_pack(a := -share, b := start))::INT AS window_start,
  count(*) AS n_windows
FROM good GROUP BY doc_id, template
"""


@query(_license_sql())
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query(
    """
WITH lines AS (
  SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(c.last <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


@query(
    """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL
),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 90 * (p.n + q.n - c)
),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS start, doc_id AS node FROM documents
  UNION
  SELECT r.start, l.y FROM reach r JOIN both_ways l ON r.node = l.x
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT start, min(node) AS component_id FROM reach GROUP BY start) ON start = d.doc_id
"""
)
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"), words=3, threshold=0.9)


@query(
    """
WITH words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') END AS w FROM documents
),
windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS p FROM words WHERE len(w) >= 35)
),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM windows WHERE h IN (SELECT h FROM again)),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM words),
lost AS (SELECT DISTINCT doc_id, p + d AS pos FROM hit, range(35) AS t(d)),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS txt, count(*) AS n
  FROM placed p ANTI JOIN lost l ON p.doc_id = l.doc_id AND p.pos = l.pos GROUP BY p.doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""
)
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


@query()
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.count_words(table(spark, sf_dir, "documents"), min_length=6, min_count=5, slip_every=199)
    return spelling_variants.group_variants(words, times=5)


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage_turns(table(spark, sf_dir, "conversations"))
    return conversation_repair.audit_conversations(damaged, gone="gone")


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
