"""Awkward rows: empty tables, null and repeated ids, repeated rows, ties, very long texts, clashing columns."""

import random
import re
import zlib
from collections import Counter
from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import common, jaccard, langid, lm, mixing, packing, quality, rules, secrets, topk, toxicity
from test_llm import TEXTS, brute_components, frame, words

LONG = " ".join(f"w{k % 977}" for k in range(150_000))


def clashing(df, *names):
    return df.withColumns({n: F.lit(7) for n in names})


# ---------------------------------------------------------------- language


def brute_language(rows, per_row=None):
    """Naive Bayes with dictionaries: {row number: (language, posterior)}."""
    mask = (1 << 32) - 1

    def buckets(text):
        low, out = text.lower(), []
        for n in (1, 2, 3):
            for k in range(len(low) - n + 1):
                h = ord(low[k])
                for c in low[k + 1 : k + n]:
                    h = (h * 0x01000193 + ord(c)) & mask
                out.append(((h + n) * 0x9E3779B1 & mask) >> 16)
        return out

    counts, docs = {}, Counter()
    for i, text, lang in rows:
        if text is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 5):
            docs[lang] += 1
            counts.setdefault(lang, Counter()).update(buckets(text))
    out = []
    for _, text, _ in rows:
        if not text or not docs or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        score = {x: log(docs[x] / sum(docs.values())) + sum(log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * 65536)) for b in buckets(text)) for x in docs}
        best = min(score, key=lambda x: (-score[x], x))
        out.append((best, 1 / sum(exp(v - score[best]) for v in score.values())))
    return out


def test_language_equals_brute_force(spark):
    rng = random.Random(2)
    letters = {"en": "etaoinsh", "fr": "éèaeuist", "de": "üßnerist"}
    rows = [(i, " ".join("".join(rng.choice(letters[x]) for _ in range(5)) for _ in range(rng.randint(0, 12))), x) for i, x in enumerate(rng.choice(sorted(letters)) for _ in range(60))]
    rows += [(None, "etao nish", None), (7, rows[7][1], "en"), (7, rows[7][1], "en"), (61, None, "fr"), (62, "½ ² 3", "de"), (63, "", None), (64, "é" * 5, None)]
    got = langid.identify(clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "score", "held_out", "bucket").coalesce(1)).collect()
    assert [(r["lang_pred"], round(r["score"], 4)) for r in got] == [(x, round(p, 4)) for x, p in brute_language(rows)]
    assert [r["held_out"] for r in got] == [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]


def test_language_ties_empty_tables_and_long_texts(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.identify(spark.createDataFrame([], schema)).count() == 0
    same = [(1, "abc", "b"), (2, "abc", "a"), (3, "abc", "b"), (4, "abc", "a"), (100, "abc", None)]
    same = [r for r in same if zlib.crc32(str(r[0]).encode()) % 5 or r[2] is None]
    n = Counter(r[2] for r in same)
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(same, schema)).collect()}
    assert got[100]["lang_pred"] == ("a" if n["a"] >= n["b"] else "b")
    long = [(i, "the and of " * 5, "en") for i in range(1, 9)] + [(i, "le des que " * 5, "fr") for i in range(11, 19)] + [(50, "the and of " * 120_000, None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(long, schema)).collect()}
    assert got[50]["lang_pred"] == "en" and got[50]["score"] > 0.99


def test_language_has_no_least_or_most_languages(spark):
    rows = [(i, chr(0x4E00 + i % 600) * 4, f"l{i % 600:03d}") for i in range(1200)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), matrix_mb=8).collect()
    assert len(got) == 1200 and sum(r["lang_pred"] == f"l{r['doc_id'] % 600:03d}" for r in got) > 800


# ---------------------------------------------------------------- secrets


def test_secrets_in_empty_tables_repeats_and_long_texts(spark):
    assert secrets.scan_table(frame(spark, []).limit(0)).count() == secrets.redact(frame(spark, []).limit(0)).count() == 0
    key = "AKIA" + "B" * 16
    docs = spark.createDataFrame([(None, key), (None, key), (3, "é" * 400_000 + " " + key + " x" * 100_000)], "doc_id long, text string")
    got = secrets.scan_table(clashing(docs, "spans", "n_hex")).collect()
    assert sorted(r["spans"] for r in got) == sorted(["access:0:20", "access:0:20", "access:400001:400021"]) and all(r["n_access"] == 1 for r in got)
    assert {r["text"][:8] for r in secrets.redact(docs.where("doc_id is null")).collect()} == {"[access]"}


# ---------------------------------------------------------------- top k


def brute_top(rows, k):
    vec = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in vec if i % 50 == 0}):
        found = [(-sum(a * b for a, b in zip(x, v)), i) for j, x in vec if j == q for i, v in vec if i != q and len(v) == len(x)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("block,group", [(4096, 2048), (40, 3)])
def test_top_k_over_many_blocks_lengths_and_repeated_ids(spark, monkeypatch, block, group):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "BUNDLE", 2)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 8)) * 3
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(size=8)]) for i in range(700)]
    rows += [(1000 + i, [1.0] * 8) for i in range(150)] + [(3000 + i, [float(x) for x in rng.normal(size=3)]) for i in range(60)] + [(5000, [2.0, 1.0])]
    rows += [(0, [3.0] * 8), (0, [-3.0] * 8), (17, [9.0] * 8), (17, [9.0] * 8), (None, [1.0] * 8), (6000, []), (6050, [None, 1.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), "row", "v", "rank", "cell", "team", "block")
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == sorted(brute_top(rows, 5))


def test_top_k_of_empty_tables(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("leaf,step", [(64, 1024), (3, 1)])
def test_trees_give_what_sorting_gives(monkeypatch, leaf, step):
    monkeypatch.setattr(topk, "LEAF", leaf)
    monkeypatch.setattr(topk, "STEP", step)
    rng = np.random.default_rng(4)
    x, q = rng.integers(-50, 50, (300, 4)).astype(float), rng.integers(-50, 50, (20, 4)).astype(float)
    best = topk.dual_search(q, np.arange(20), topk.CoverTree(x), np.arange(300), 5, np.full(20, -np.inf))
    for j in range(20):
        want = sorted((-int(q[j] @ v), i) for i, v in enumerate(x) if i != j)[:5]
        assert list(zip((-best.score[j]).tolist(), best.id[j].tolist())) == want


def test_a_tree_covers_its_points():
    x = np.random.default_rng(6).normal(size=(900, 5)) * np.geomspace(1, 1e6, 900)[:, None]
    tree = topk.CoverTree(np.concatenate([x, x[:200], np.ones((300, 5))]))
    assert sorted(tree.order.tolist()) == list(range(1400))
    for i in range(len(tree.radius)):
        own = tree.x[tree.order[tree.start[i] : tree.end[i]]]
        assert np.sqrt(((own - tree.x[tree.centre[i]]) ** 2).sum(1)).max() <= tree.radius[i] * (1 + 1e-9)
        assert tree.children[i] or len(own) <= topk.LEAF or tree.radius[i] == 0


def test_pairs_of_nodes_are_pruned_at_the_registered_sizes(spark):
    """10 queries and 500 vectors, as many as at sf0.01, in five clusters: most pairs are never multiplied."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 64))
    x = np.floor(256 * (centres[np.arange(500) // 100] * 3 + rng.normal(size=(500, 64)) * 0.05))
    best = topk.dual_search(x[::50], np.arange(0, 500, 50), topk.CoverTree(x), np.arange(500), 5, np.full(10, -np.inf))
    for j in range(10):
        want = sorted((-int(x[50 * j] @ v), i) for i, v in enumerate(x) if i != 50 * j)[:5]
        assert list(zip((-best.score[j]).tolist(), best.id[j].tolist())) == want
    assert best.met < 0.5 * 10 * 500


# ---------------------------------------------------------------- near copies


def test_jaccard_exact_prefixes_and_awkward_ids(spark):
    rng = random.Random(13)
    base = [rng.choice(["a", "b", "c", "d", "e"]) + str(rng.randrange(40)) for _ in range(80)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        texts.append(" ".join(w))
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(900 + i, t) for i, t in enumerate(TEXTS)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "mark", "sid", "size", "grams", "hub")
    want = brute_components(rows, 4, 85, 100)
    assert sorted(map(tuple, jaccard.join(df).collect())) == want
    assert sorted(map(tuple, jaccard.join(df, exact=True).collect())) == want


def test_jaccard_null_and_repeated_ids_and_empty_tables(spark):
    assert jaccard.join(frame(spark, []).limit(0)).count() == jaccard.one_of_each(frame(spark, []).limit(0)).count() == 0
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(None, one), (None, one), (None, two), (5, two), (9, one + " x"), (9, ""), (7, two + " y"), (None, None), (9, LONG), (9, LONG)]
    got = Counter(tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    n = len(set(zip(*(LONG.split()[k:] for k in range(4)))))
    assert got == Counter([(None, 57, 9), (None, 57, 9), (9, 58, 9), (None, 57, 5), (5, 57, 5), (7, 58, 5), (9, 0, 9), (None, 0, None), (9, n, 9), (9, n, 9)])


def test_one_of_each_keeps_columns_that_clash(spark):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(4, one), (3, one + " x"), (5, two), (5, two), (6, "short"), (6, "short")]
    names = ("__id", "__again", "__sid", "__key", "__KEPT_sid", "__kept", "mark", "sid", "root")
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), *names)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["__KEPT_sid"]) for r in kept.collect()) == sorted([(3, one + " x", 7), (5, two, 7), (6, "short", 7)])


# ---------------------------------------------------------------- packing


def test_packing_takes_the_tokenizers_plain_call(spark):
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(packing.default_tokenizer()), random.Random(5)
    parts = ["a", "Bc", "é", "日", "²", "1", " ", "  ", "\n", "\n\n", ".", ",", "'", "s", "ll", "_", "-", "<|endoftext|>", "\t", "\xa0", "ª", "ǅ", "\u0301", "#", "\r", "<|end", "oftext|>"]
    texts = ["a <|endoftext|> b", "x.\ny, 'z'"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(20_000)]
    for text, data in zip(texts, packing.WordEncoder(packing.default_tokenizer()).encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text
    tok.encode_special_tokens = True
    for text, data in zip(texts, packing.WordEncoder(packing.default_tokenizer(), True).encode(texts[:3000])):
        assert np.frombuffer(data, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_packing_goes_on_until_nothing_joins(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 6)
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, k]), "word " * rng.randint(0, 600)) for k in range(120)] + [(2, None), (2, None)]
    got = packing.pack(clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(12), "bin", "fill", "into", "at")).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    fills = []
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        fills.append(at)
    assert max(fills) <= 1024 and sum(r["piece"] == 0 for r in got) == len(rows)
    assert len(fills) <= 1.1 * sum(fills) / 1024 + 2


# ---------------------------------------------------------------- mixing


def brute_mix(rows):
    """Taken times by row, from sorting whole sources."""
    import hashlib

    size = [len(words(t)) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows if s is not None}, key=lambda s: s.encode()) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {s: sum(n for n, (_, _, x) in zip(size, rows) if x == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    full, level = set(), 0.0
    while len(full) < len(sources):
        level = (sum(total.values()) - 3 * sum(total[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and 3 * total[s] < level * weight[s]}
        if not more:
            break
        full |= more
    out = [0] * len(rows)
    for s in sources:
        target = min(3 * total[s], level * weight[s])
        whole = int(target // total[s]) if total[s] else 0
        budget, at = target - whole * total[s], 0
        by_hash = {}
        for k, (i, t, x) in enumerate(rows):
            if x == s:
                by_hash.setdefault(int(hashlib.md5(f"{'null' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16), []).append(k)
        for h in sorted(by_hash):
            n = sum(size[k] for k in by_hash[h])
            once = 2 * at + n <= 2 * budget
            for k in by_hash[h]:
                out[k] = whole + once
            at += n
    return out


def test_mixed_documents_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, k, k, k, 3]), rng.choice([None, "", "w " * rng.randint(1, 40)]), rng.choice(["a"] * 9 + ["B", "b", "ä", "", None])) for k in range(300)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), "key", "__key", "__COPIES", "cut", "whole", "edge")
    want = Counter()
    for row, n in zip(rows, brute_mix(rows)):
        want[row] += n
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect()) == +want
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"], r["size"]] += r["taken"]
    assert sum(taken.values()) == sum(n * len(words(t)) for (_, t, _), n in zip(rows, brute_mix(rows)))


def test_a_source_of_null_ids_comes_within_a_document_of_its_target(spark):
    """A source without ids, and one whose rows share one: their texts tell them apart."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 40)))
    rows = [(None, text(), "none") for _ in range(300)] + [(5, text(), "one") for _ in range(300)] + [(100 + k, text(), "own") for k in range(300)]
    taken, target = Counter(), {}
    size = Counter()
    for i, t, s in rows:
        size[s] += len(t.split())
    by_size = {n: s for s, n in size.items()}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[by_size[r["source_size"]]] += r["taken"]
        target[by_size[r["source_size"]]] = r["target"]
    assert len(by_size) == 3 and all(abs(taken[s] - target[s]) <= 41 for s in target)


def test_mix_of_nothing_and_of_one_source(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == mixing.mixed_documents(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], schema)).collect()
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in got) == [(1, 2, 3.0), (2, 1, 3.0)]
    assert {r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, "s"), (2, "", None)], schema)).collect()} == {0}


# ---------------------------------------------------------------- language model


def test_lm_repeats_null_ids_and_long_texts(spark):
    docs = clashing(spark.createDataFrame([(None, "a b", False), (None, "a b", False), (1, LONG, True), (2, None, False)], "doc_id long, text string, held_out boolean"), "block", "rows", "score", "slot")
    got = lm.score(docs, 3, 100, 100).collect()
    assert len(got) == 4 and {r["train_tokens"] for r in got} == {7}
    assert sorted((r["n_tokens"], r["n_known"]) for r in got) == [(1, 1), (3, 3), (3, 3), (150_001, 1)]


# ---------------------------------------------------------------- quality


def test_quality_contradictions_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "good words here today " * (3 + i % 4) if i % 2 else "### $$ %%" * (1 + i % 3)) for i in range(80)] + [(None, None), (None, ""), (1, "good words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, 0), (None, 1), (2, None)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    got = quality.score(clashing(docs, "score", "predicted").withColumn("held_out", F.lit(False)), model).collect()
    assert len(got) == 83 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert min(by[5]) > max(by[4]) and len(set(by[None])) == 1  # null and empty texts alike
    assert quality.score(docs.limit(0).withColumn("held_out", F.lit(False)), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.score(docs.withColumn("held_out", F.lit(True)), none).collect()} == {0.5}


def test_quality_risk_never_goes_below_zero_for_long():
    """All unlabelled rows are positives and the prior is too high: the plain estimate of the negative risk would fall without end."""
    rng = np.random.default_rng(1)
    p = rng.normal(size=(200, quality.STATS))
    model = quality.fit_pu(p, p[:150], 0.95, steps=600)
    g = model.features(p) @ model.weights + model.bias
    negative = np.logaddexp(0, g[:150]).mean() - 0.95 * np.logaddexp(0, g).mean()
    assert negative > -0.05 and np.abs(g).max() < 12


# ---------------------------------------------------------------- toxicity


def test_toxicity_contradictions_repeats_and_categories(spark):
    rng = random.Random(9)
    clean = lambda: " ".join(rng.choice(["river", "stone", "walks", "green"]) for _ in range(30))
    rows = [(i, clean(), 0, 0) for i in range(60)] + [(60 + i, clean() + rng.choice([" grobian", " vilain"]) * 3, 1, i % 2) for i in range(40)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, toxic int, rude int"), "marks", "at", "of", "bucket")
    labels = df.select("doc_id", "toxic", "rude").union(spark.createDataFrame([(60, 0, 0), (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, rude int"))
    docs = df.union(df.where("doc_id in (0, 60)")).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    chain = toxicity.fit(docs, labels, ("rude", "toxic"), kinds=2)
    assert chain.categories == ("kind_1", "kind_2", "rude", "toxic")
    got = toxicity.score(docs, chain).collect()
    assert len(got) == 103 and all(r["rejected"] == (r["doc_id"] is not None and r["doc_id"] >= 60) for r in got)
    assert toxicity.keep_clean(docs, chain).columns == docs.columns and toxicity.keep_clean(docs, chain).count() == 62
    assert toxicity.score(docs.limit(0), chain).count() == toxicity.keep_clean(docs.limit(0), chain).count() == 0
    assert chain.probabilities(b"") == [0.0] * 4 and len(chain.probabilities(LONG.encode())) == 4


def test_kinds_are_found_by_direction():
    rng = np.random.default_rng(3)
    x = np.zeros((90, 9), np.float32)
    for k in range(3):
        x[30 * k : 30 * k + 30, 3 * k : 3 * k + 3] = rng.random((30, 3)) * rng.uniform(0.2, 5, (30, 1))
    got = toxicity.clusters(x, 3)
    assert all(len(set(got[30 * k : 30 * k + 30].tolist())) == 1 for k in range(3)) and len(set(got.tolist())) == 3
    assert toxicity.clusters(np.zeros((2, 4), np.float32), 3).tolist() == [0, 0]


# ---------------------------------------------------------------- rules


def brute_rules(t):
    w, t = words(t), t or ""
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = len({k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)})
    chars, lines = sum(map(len, w)), [x for x in t.split("\n") if words(x)]
    symbols, dup = sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * covered > 50 * len(w)
    upper, letters = sum(c.isupper() for c in t), sum(c.isalpha() for c in t)
    rejected = 10 * symbols > 3 * len(w) or not 2 * len(w) <= chars <= 20 * len(w) or 100 * dup > 30 * len(t.split("\n")) or upper > 0.5 * chars or letters < 0.5 * chars
    return len(w), chars, symbols, dup, covered, failed, not (failed or rejected)


def test_rules_equal_brute_force_in_both_forms(spark):
    rng = random.Random(12)
    make = lambda pool, n: " ".join(rng.choice(pool) + rng.choice("abcdefgh") * rng.randint(0, 2) + rng.choice(["", "", "\n"]) for _ in range(n))
    pools = [["river", "stone", "Haus", "été"], ["#", "*", "$%"], ["NASA", "EU"], ["x", "y"], ["123", "45"], ["a" * 30]]
    texts = TEXTS + [make(rng.choice(pools) + rng.choice(pools), rng.randint(40, 160)) for _ in range(120)] + ["same line of words here\n" * 30 + make(pools[0], 90), LONG]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "n_words", "__words", "kept")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = [brute_rules(t) for t in texts]
    assert {x[-1] for x in want} == {True, False}
    got = Counter((r["doc_id"], *(r[n] for n in names)) for r in rules.judge(docs).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, want))
    kept = rules.accept(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(row for row, x in zip(rows, want) if x[-1])
    assert rules.judge(docs.limit(0)).count() == rules.accept(docs.limit(0)).count() == 0


def test_a_rule_behind_one_that_rejects_is_not_evaluated(spark):
    docs = spark.createDataFrame([(1, "no"), (2, "no no")], "doc_id long, text string")
    trap = F.raise_error(F.lit("evaluated")).cast("boolean")
    conditions = {"cheap": F.length("text") < 10, "dear": trap}
    assert docs.where(rules.cascade(conditions, ["cheap", "dear"])).count() == 0
    with pytest.raises(Exception, match="evaluated"):
        docs.where(rules.cascade(conditions, ["dear", "cheap"])).count()


def test_rules_are_ordered_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(i, "ab cd " * 400 + str(i)) for i in range(300)], "doc_id long, text string")
    dear = F.length(F.regexp_replace("text", r"(a|b|c|d)+( |$)", "")) >= 0  # rejects all, at a price
    assert rules.measured_order(docs, {"never": F.length("text") < 0, "dear": dear, "cheap": F.length("text") > 5})[0] == "cheap"


# ---------------------------------------------------------------- common


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Far:
        class sparkContext:
            master = "spark://far:7077"

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Far)


def test_words_of_all_operators_are_the_same():
    text = "a\x0bb\x0cc\x1cd\x85e\u2028f  g"
    assert [w.decode() for w in common.words_of(text.encode())] == re.findall(r"[^\x20\x09-\x0D]+", text) == words(text)
