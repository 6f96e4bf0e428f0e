"""Text operators against brute force, and their defined results for odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from resaleworth.llm import jaccard_join, language, license_scan, line_dedup, max_entropy, mixing, packing, text, token_edits, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = " \t\n\x0b\x0c\r"


def words_of(value):
    return (value or "").encode().lower().split()


def corpus(seed=1, n=150):
    """Prose of few words, copies, near copies, shared lines, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    shared = [" ".join(rng.choices(vocabulary, k=8)) for _ in range(4)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 25))).capitalize() for _ in range(rng.randint(1, 6))]
        lines += [rng.choice(shared) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 2))]
        value = "\n".join(lines)
        if rows and rng.random() < 0.3:
            old = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(0, 2)):
                old[rng.randrange(len(old))] = rng.choice(vocabulary)
            value = " ".join(old)
        rows.append((i, value, "xx", rng.choice(["a", "b", "é", None]), len(value)))
    rows += [(n, None, None, None, None), (n + 1, "", None, "a", 0), (n + 2, " \n\t ", None, "a", 3), (n + 3, "one", "xx", "b", 3)]
    rows += [(n + 4, "ONE", "xx", "b", 3), (n + 5, "two words", None, "b", 9), (n + 6, "w " * 30_000, None, "c", 60_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- words and shingles


def test_word_hashes_in_pieces(monkeypatch):
    values = [b"", b"  ", b"ab cd\tab", b"x" * 700, b"one two " * 200, b"y" * 300 + b" z"]
    whole = list(text.word_hashes(values))
    assert [len(h) for h in whole] == [len(v.split()) for v in values]
    assert whole[2][0] == whole[2][2] != whole[2][1]
    monkeypatch.setattr(text, "PIECE", 64)
    text._powers.cache_clear()
    small = list(text.word_hashes(values))
    text._powers.cache_clear()
    for a, b in zip(whole, small, strict=True):
        assert (a == b).all()


# --- line dedup


def expected_lines(rows, least=20, docs=3):
    holders = defaultdict(set)
    key = lambda line: line.encode().strip(WHITE.encode()).lower().decode()
    for doc, value, *_ in rows:
        for line in (value or "").split("\n"):
            if len(key(line)) >= least and doc is not None:
                holders[key(line)].add(doc)
    out = []
    for doc, value, *_ in rows:
        lines = (value or "").split("\n")
        kept = [x for x in lines if doc is None or len(holders[key(x)]) < docs or doc == max(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rows = corpus()
    rows += [rows[3], (rows[3][0], "another text\n" + (rows[5][1] or ""), None, None, None), (None, rows[5][1], None, None, None)]
    found = line_dedup.drop_common_lines(frame(spark, rows).withColumn("n_lines", F.lit("x")).withColumn("_keys", F.lit(1)))
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "_keys", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in found.collect()), key=repr)
    assert got == expected_lines(rows)
    assert line_dedup.drop_common_lines(empty(spark)).collect() == []


# --- n-gram Jaccard join


def expected_groups(rows, k, num, den):
    sets = defaultdict(list)
    for doc, value, *_ in rows:
        w = words_of(value)
        if doc is not None:
            sets[doc].append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    ids = sorted(sets)
    links = {i: set() for i in ids}
    for i in ids:
        for j in ids:
            for a in sets[i]:
                for b in sets[j]:
                    if i != j and a and b and den * len(a & b) >= num * len(a | b):
                        links[i].add(j)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = min(seen)
    return out


@pytest.mark.parametrize(("k", "threshold", "few"), [(3, 0.9, 1), (5, 0.8, 0), (2, 0.5, 1000)])
def test_jaccard_join(spark, monkeypatch, k, threshold, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rows = corpus(seed=k)
    rows += [rows[4], (rows[4][0], rows[9][1], None, None, None), (None, rows[9][1], None, None, None)]
    found = jaccard_join.similar_groups(frame(spark, rows).withColumn("component_id", F.lit("x")), words=k, threshold=threshold).collect()
    assert len(found) == len(rows)
    groups = expected_groups(rows, k, int(threshold * 10), 10)
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == groups
    assert all(r["component_id"] is None for r in found if r["doc_id"] is None)
    assert {r["n_shingles"] for r in found if r["doc_id"] in (150, 151, 152)} == {0}
    kept = jaccard_join.keep_one_per_group(frame(spark, rows), words=k, threshold=threshold)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in groups.items() if i == c} | {None}


def test_jaccard_join_of_a_large_group(spark):
    """Near copies of one text meet through few of them, and none is lost."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(300):
        own = list(base)
        own[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(own), None, None, None))
    found = jaccard_join.similar_groups(frame(spark, rows), words=3, threshold=0.8).collect()
    groups = expected_groups(rows, 3, 8, 10)
    assert {r["doc_id"]: r["component_id"] for r in found} == groups
    assert jaccard_join.similar_groups(empty(spark)).collect() == []


# --- language ID


def test_language_id(spark):
    rng = random.Random(5)
    parts = {"en": ["th", "ing", "er", "ou", "nd"], "de": ["sch", "ung", "ei", "üb", "tz"], "es": ["ción", "os", "ar", "ñe", "lla"]}
    make = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, make(lang := rng.choice(list(parts)), rng.randint(20, 200)), lang, "s", 0) for i in range(240)]
    docs = frame(spark, rows)
    models = language.fit_languages(docs.where("doc_id % 4 <> 2"))
    odd = [(900, None, None, None, None), (901, "", "en", None, 0), (902, "12 .. 3", "en", None, 0), (903, make("de", 50_000), None, None, 0)]
    held = [r for r in rows if r[0] % 4 == 2]
    asked = frame(spark, held + odd + held[:1]).withColumn("score", F.lit("x"))
    found = language.identify_language(asked, models)
    assert found.columns[-3:] == ["lang_pred", "score", "rejected"]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in found.collect()]
    assert len(got) == len(held) + len(odd) + 1
    by_id = {i: (lang, score) for i, lang, score in got}
    right = sum(by_id[i][0] == lang for i, _, lang, *_ in held)
    assert right >= 0.95 * len(held)
    assert all(by_id[i] == ("und", 0.0) for i in (900, 901, 902))
    assert by_id[903][0] == "de"
    assert all(0 <= score <= 1 for _, _, score in got)
    assert language.fit_languages(empty(spark)) == {}
    assert {r["lang_pred"] for r in language.identify_language(docs, {}).collect()} == {"und"}


# --- mixing


def test_mixing(spark):
    rows = corpus(seed=8, n=300)
    rows += [rows[0], rows[0], (None, "a b c", None, "a", 5)]
    found = mixing.sample_copies(frame(spark, rows).withColumn("copies", F.lit("x")))
    got = found.collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.sample_copies(frame(spark, rows).withColumn("copies", F.lit("x"))).collect()))
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len(words_of(r["text"])) and 0 <= r["copies"] <= 2
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        above = {s for s in size if s not in full and weight[s] * level > 2 * size[s]}
        if not above:
            break
        full |= above
    for s in size:
        assert target[s] == pytest.approx(2 * size[s] if s in full else weight[s] * level)
        most = max(r["size"] for r in got if r["source"] == s)
        assert abs(taken[s] - target[s]) <= 2 * most
    mix = mixing.mix_sources(frame(spark, rows))
    assert mix.columns == frame(spark, rows).columns
    assert mix.count() == sum(r["copies"] for r in got)
    assert mixing.sample_copies(empty(spark)).collect() == []


# --- packing


def test_ids_agree_with_the_tokenizer(tokenizer, monkeypatch):
    slow = Tokenizer.from_file(tokenizer)
    slow.encode_special_tokens = True
    monkeypatch.setattr(tokens, "LONGEST", 40)
    rng, signs = random.Random(4), " \t\n\r\x0b\x1c\xa0 'sdlm aBé1!?.🙂漢<|endoftext|>"
    values = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 300))) for _ in range(500)]
    for value in [*values, " " * 5000 + "x", "a" * 3000, *[r[1] or "" for r in corpus()]]:
        assert tokens.encode_text(value, tokenizer) == slow.encode(value, add_special_tokens=False).ids


def test_added_tokens_have_their_ids(tokenizer, monkeypatch):
    plain = Tokenizer.from_file(tokenizer)
    assert tokens.encode_text("foo <|endoftext|> bar", tokenizer) == [21943, 220, 50256, 2318]
    monkeypatch.setattr(tokens, "LONGEST", 40)
    rng, bits = random.Random(5), ["<|endoftext|>", " ", "  ", "\n", "a", "word", "1", "<|", "|>", "endoftext", "é", "'s"]
    values = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for value in [*values, "a <|endoftext|>" + " " * 5000 + "<|endoftext|> x"]:
        assert tokens.encode_text(value, tokenizer) == plain.encode(value, add_special_tokens=False).ids


def test_packing(spark, tokenizer):
    rows = corpus(n=40)
    rows += [rows[2], (None, "some words", None, None, None)]
    docs = frame(spark, rows).withColumn("length", F.lit("x"))
    got = packing.pack_documents(docs, tokenizer, limit=64).collect()
    slow = Tokenizer.from_file(tokenizer)
    pieces = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) // 4 and r["length"] <= 64 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    lengths = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)
    for doc, value, *_ in rows:
        ids = np.array([*slow.encode(value or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        times = sum(r[0] == doc for r in rows)
        own = sorted(pieces[doc])[::times]
        assert b"".join(p for _, p, _ in own) == ids
        assert [s for s, _, _ in own] == [sum(len(p) for _, p, _ in own[:i]) // 4 for i in range(len(own))]
        assert {t for _, _, t in own} == {len(ids) // 4}
    assert packing.pack_documents(empty(spark), tokenizer).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        packing.split_documents(docs, tokenizer, limit=100)


# --- token counts under edits


def test_token_tree(tokenizer):
    rng, signs = random.Random(3), " \n\t abcdé1!?.'s"
    for _ in range(150):
        value = "".join(rng.choice(signs) for _ in range(rng.randint(0, 400)))
        tree = token_edits.TokenTree(value, tokenizer, leaf=16)
        for _ in range(rng.randint(1, 12)):
            a = rng.randint(-2, len(value) + 2)
            b, new = a + rng.choice([0, 0, 1, 3, 40]), "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 3, 100])))
            start = max(0, min(a, len(value)))
            value = value[:start] + new + value[max(start, min(b, len(value))) :]
            tree.edit(a, b, new)
            if rng.random() < 0.3:
                assert tree.count() == len(tokens.encode_text(value, tokenizer))
        assert tree.text == value and tree.count() == len(tokens.encode_text(value, tokenizer))


def test_small_edits_encode_little(tokenizer):
    value = " ".join(f"word{i % 97}" for i in range(20_000))
    tree = token_edits.TokenTree(value, tokenizer)
    tree.count()
    before = tree.encoded
    tree.edit(70_000, 70_003, "abc def")
    tree.edit(5, 5, "x")
    assert tree.count() == len(tokens.encode_text(tree.text, tokenizer))
    assert tree.encoded - before < 2000


def test_counts_with_edits(spark, tokenizer):
    rows = [(1, "call +1 555 777 8888 now $$$ or mail a.b@c.org", "x", "s", 0), (2, None, None, None, None), (3, "", None, None, 0)]
    rows += [(4, "w " * 5000 + "!!!!", None, None, 0), (5, "é" * 700 + "###", None, None, 0), rows[0]]
    patterns = (
        (r"[\w.]+@[\w.]+", "[mail]", ("@",)),
        (r"\+\d[\d ]{6,}\d", "[number]", re.compile(r"\d")),
        (r"\${3,}|#{3,}|!{3,}", "", ("$$$", "###", "!!!")),
    )
    docs = frame(spark, rows).withColumn("n_edits", F.lit("x"))
    found = token_edits.count_with_edits(docs, token_edits.replacements(F.col("text"), patterns), tokenizer).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["n_tokens"] == len(tokens.encode_text(r["text"] or "", tokenizer))
        assert r["n_tokens_after"] == len(tokens.encode_text(r["edited_text"], tokenizer))
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["edited_text"] == "call [number] now  or mail [mail]" and by_id[1]["n_edits"] == 3
    assert by_id[2]["edited_text"] == "" and by_id[2]["n_tokens"] == 0
    assert by_id[4]["n_encoded"] < 1000
    some = F.expr("array(named_struct('start', 0L, 'end', 1L, 'new', 'q'), named_struct('start', CAST(NULL AS BIGINT), 'end', 1L, 'new', 'q'), NULL)")
    got = {r["doc_id"]: r["edited_text"] for r in token_edits.count_with_edits(docs, some, tokenizer).collect()}
    assert got[1].startswith("qall") and got[2] == "q"
    none = F.lit(None).cast(token_edits.EDITS)
    assert {r["n_edits"] for r in token_edits.count_with_edits(docs, none, tokenizer).collect()} == {0}


# --- language model


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(max_entropy, "HEAD", 64)
    rows = corpus(seed=6, n=300)
    rows += [rows[0], (None, "one two", None, None, None)]
    docs = frame(spark, rows).withColumn("score", F.lit("x"))
    train = docs.where("doc_id % 5 <> 1")
    model = max_entropy.fit_model(train)
    got = max_entropy.score_texts(docs, model).collect()
    assert len(got) == len(rows)
    counts = defaultdict(int)
    for doc, value, *_ in rows:
        if doc is not None and doc % 5 != 1:
            for w in [*words_of(value), None]:
                counts[w] += 1
    n, v = sum(counts.values()), len(counts)
    held = [0.0, 0.0]
    for r in got:
        own = [*words_of(r["text"]), None]
        assert (r["n_tokens"], r["train_tokens"]) == (len(own), n)
        assert r["n_known"] == sum(counts.get(w, 0) > 0 for w in own)
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert r["base_score"] == pytest.approx(base)
        if r["doc_id"] is not None and r["doc_id"] % 5 == 1:
            held[0] += r["base_score"]
            held[1] += r["score"]
    assert held[1] > held[0]


def test_probabilities_sum_to_one(spark, monkeypatch):
    """Over all words and the unseen one, after one history."""
    monkeypatch.setattr(max_entropy, "HEAD", 16)
    docs = frame(spark, corpus(seed=6, n=60))
    model = max_entropy.fit_model(docs)
    counts = {np.int64(r["word"]).view(np.uint64): r["n"] for r in model.counts.collect()}
    history = np.array([[1, 2, 3]])
    classes = [np.exp(max_entropy.log_probabilities(model.weights, model.class_log.astype(np.float32), history, np.array([c])))[0] for c in range(max_entropy.CLASSES)]
    assert sum(classes) == pytest.approx(1, abs=1e-4)
    used = set(model.head_class.tolist())
    inside = {c: np.exp(model.word_log[model.head_class == c]).sum() for c in used}
    assert all(total == pytest.approx(1) for total in inside.values())
    rest = [n for word, n in counts.items() if word not in set(model.head.tolist())]
    ns = spark.createDataFrame([(n,) for n in [*rest, 0]], "n long")
    assert ns.agg(F.sum(model.rest_probability(F.col("n")))).first()[0] == pytest.approx(1, abs=1e-6)


def test_language_model_of_nothing(spark):
    model = max_entropy.fit_model(empty(spark))
    got = max_entropy.score_texts(frame(spark, [(1, None, None, None, None), (2, "a b", None, None, None)]), model).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert max_entropy.score_texts(empty(spark), model).collect() == []


# --- license scan


def test_license_scan(spark):
    rng = random.Random(9)
    filler = lambda n: " ".join(rng.choice(["foo", "bar", "the", "license", "under"]) for _ in range(n))
    rows = []
    for i, (_, notice) in enumerate(license_scan.NOTICES * 4):
        rows.append((i, f"{filler(rng.randint(0, 90))}\n{notice.upper() if i % 2 else notice}\n{filler(rng.randint(0, 90))}", None, None, None))
    changed = license_scan.NOTICES[6][1].replace("program", "thing", 1).replace("version", "edition", 1)
    rows += [(100, changed, None, None, None), (101, None, None, None, None), (102, "", None, None, None), (103, filler(5000), None, None, None)]
    rows += [(104, "rights reserved", None, None, None), rows[0], (None, "All Rights, Reserved", None, None, None)]
    found = license_scan.scan_licenses(frame(spark, rows).withColumn("share", F.lit("x"))).collect()
    got = {(r["doc_id"], r["template"]): r["share"] for r in found}
    for i, (name, _) in enumerate(license_scan.NOTICES * 4):
        assert got[i, name] == 1.0
    assert 0.8 <= got[100, "gpl-3-notice"] < 1
    assert got[None, "all-rights-reserved"] == 1.0
    assert not {i for i, _ in got} & {101, 102, 103, 104}
    assert license_scan.scan_licenses(empty(spark)).collect() == []
    with pytest.raises(ValueError, match="words or more"):
        license_scan.scan_licenses(empty(spark), [("short", "two words")])


def test_license_texts_and_versions(spark):
    texts = dict(license_scan.TEMPLATES)
    assert len(texts) == len(license_scan.TEMPLATES)
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["foo", "bar", "baz"]) for _ in range(n))
    whole = [name for name in texts if name.endswith("-text")]
    notice = texts["gpl-2-notice"].replace("version 2", "version 4")
    odd = {
        "agpl": texts["agpl-3-notice"], "lgpl": texts["lgpl-2.1-notice"], "gpl2": "licensed under the GNU General Public License, version 2.",
        "four": notice, "cc": texts["cc-by-sa-4.0-notice"], "spdx": "// SPDX-License-Identifier: MPL-2.0\n", "apache": "Licensed under the Apache License, Version 1.0",
    }
    names = [*whole, *odd]
    rows = [(i, f"{filler(700)} {texts.get(name) or odd[name]} {filler(300)}", None, None, None) for i, name in enumerate(names)]
    got = defaultdict(dict)
    for r in license_scan.scan_licenses(frame(spark, rows)).collect():
        got[names[r["doc_id"]]][r["template"]] = r["share"]
    for name in whole:
        assert got[name][name] == 1.0
    for family in ("gpl", "lgpl", "gfdl", "mpl", "cc-by-sa"):
        for name in whole:
            if name.startswith(family):  # of the whole texts only its own version
                assert {t for t in got[name] if t in whole and t.startswith(family)} == {name}
    assert "gpl-3-notice" not in got["agpl"] and "lgpl-3-notice" not in got["agpl"] and got["agpl"]["agpl-3-notice"] == 1.0
    assert {t for t in got["lgpl"] if "notice" in t} == {"lgpl-2.1-notice"}
    assert set(got["gpl2"]) == {"gpl-2-name"} and not got["four"] and not got["apache"]
    assert {t for t in got["cc"] if t.startswith("cc-by")} == {"cc-by-sa-4.0-notice"}
    assert set(got["spdx"]) == {"spdx-mpl-2.0"}


# --- digests


def test_crc_is_of_packed_ids(spark, tokenizer):
    docs = frame(spark, [(1, "some words to pack", None, None, None)])
    r = packing.split_documents(docs, tokenizer, limit=4).withColumn("crc", F.crc32("ids")).orderBy("start").first()
    ids = [*tokens.encode_text("some words to pack", tokenizer), 1][:4]
    assert r["crc"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
