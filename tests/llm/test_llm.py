"""The subpackage's operators against brute force on small fixtures and awkward rows."""

import hashlib
import random
import re
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import jaccard, langid, lm, mixing, packing, quality, rules, secrets, topk, toxicity
from tickerloom.llm.common import crc_fold

TEXTS = [None, "", " \n\t", "a", "the cat sat on the mat", "x " * 3000, "é à ü", "12345 !!", "a\x0bb\x0cc\x1cd"]


def frame(spark, texts, extra=""):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "score") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_language_id(spark):
    en, fr = "the and with of that this ", "le la avec des que une "
    rows = [(i, (en if i % 2 else fr) * 5, "en" if i % 2 else "fr") for i in range(60)] + [(100, None, "en"), (101, "123", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") and 0 <= got[i]["score"] <= 1 for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und"
    assert langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()["lang_pred"] == "und"


def test_language_slices_do_not_change_counts():
    text = "abc " * 200
    whole = np.concatenate([ids for _, _, ids in langid.gram_buckets([text], (1, 2, 3), 16)])
    small, langid.SLICE = langid.SLICE, 97
    try:
        cut = np.concatenate([ids for _, _, ids in langid.gram_buckets([text], (1, 2, 3), 16)])
    finally:
        langid.SLICE = small
    assert sorted(whole) == sorted(cut)


def test_secrets_equal_regexes(spark):
    scanner, rng = secrets.Scanner(), random.Random(3)
    parts = ["password", "SeCret", "token", "api_key", "=", ":", " ", '"', "AKIA", "ABCDEFGHIJKLMNOP0", "deadbeef" * 3, "é", "ghp_" + "a" * 36, "abcdef", "ſ", "-----BEGIN PRIVATE KEY-----"]
    for _ in range(2000):
        data = "".join(rng.choice(parts) for _ in range(rng.randint(0, 15))).encode()
        want = sorted(((k, m.start(), m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.regex, data) if not r.least or len(m[r.group]) >= r.least), key=lambda x: (x[1], x[0]))
        assert scanner.byte_spans(data) == want
    got = secrets.scan_table(frame(spark, ["é password: hunter22", None])).collect()
    assert got[0]["spans"] == "assign:2:20" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = secrets.redact(frame(spark, ["é password: hunter22 x", "plain", None]).withColumn("n_chars", F.length("text"))).collect()
    assert [r["text"] for r in clean] == ["é [assign] x", "plain", None] and clean[0]["n_chars"] == 12


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(300, None), (350, [float("nan")] * 6), (400, rows_equal := [0.5] * 6), (401, rows_equal), (402, rows_equal)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    vec = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if v and not np.isnan(v[0])}
    want = []
    for q in (i for i in vec if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(vec[q], v)), i) for i, v in vec.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        m = min(n, len(w))
        sets.append({tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 1 << 60), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def test_ngram_jaccard(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(200)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 6, 40, 90]))] + (passage if g % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rows += [(5000 + i, t) for i, t in enumerate(TEXTS)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert sorted(map(tuple, got.collect())) == brute_components(rows, 4, 85, 100)


def test_word_hashes_tell_words_apart():
    shingler, rng = jaccard.Shingler(4), random.Random(8)
    made = {"".join(rng.choice("abcé\x1c") for _ in range(rng.randint(1, 12))).encode() for _ in range(20000)}
    made = {w.lower() for w in made}
    hashes = {w: int(shingler.words(w)[0]) for w in made}
    assert len(set(hashes.values())) == len(made)
    text = b" ".join(rng.choice(sorted(made)) for _ in range(500)) + b"\n\tQ  Zz\x0b"
    want = [int(shingler.words(w)[0]) for w in text.split()]
    assert shingler.words(text).tolist() == want
    whole, jaccard.SLICE = jaccard.SLICE, 100
    try:
        assert shingler.words(text).tolist() == want
    finally:
        jaccard.SLICE = whole


def test_large_group_of_near_copies(spark):
    """Copies with a few to many edits of one text, some of them linked to each other only."""
    rng = random.Random(21)
    base, rows = [f"w{rng.randrange(500)}" for _ in range(120)], []
    for k in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((2 * k, " ".join(w)))
        if k % 10 == 0:
            w[rng.randrange(len(w))] = "again"
            rows.append((2 * k + 1, " ".join(w)))
    rows += [(1000 + k, " ".join([f"p{j}" for j in range(50)] + [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([3, 40, 200]))])) for k in range(60)]
    for n, num, den in ((4, 85, 100), (5, 80, 100)):
        got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n, num, den)
        assert sorted(map(tuple, got.collect())) == brute_components(rows, n, num, den)


def test_prefix_tree_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(50):
        probe = np.unique(rng.integers(0, 200, 80)).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(len(probe)) < 0.1, rng.integers(0, 200, len(probe)), probe)).astype(np.uint64) for _ in range(6)]
        for s, o in zip(sets, jaccard.PrefixTree(sets).overlaps(probe, 80, 100)):
            true = len(np.intersect1d(s, probe))
            assert o == (true if true >= jaccard.least_overlap(len(s), len(probe), 80, 100) else -1)


def test_prefix_tree_differences():
    rng = np.random.default_rng(5)
    for _ in range(50):
        probe = np.unique(rng.integers(0, 200, 80)).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(len(probe)) < rng.random(), rng.integers(0, 200, len(probe)), probe)).astype(np.uint64) for _ in range(6)]
        got = {k: (common, added.tolist(), gone.tolist()) for k, common, added, gone in jaccard.PrefixTree(sets).differences(probe, 3, 10)}
        assert got == {
            k: (len(np.intersect1d(s, probe)), np.setdiff1d(s, probe).tolist(), np.setdiff1d(probe, s).tolist())
            for k, s in enumerate(sets)
            if 10 * len(np.intersect1d(s, probe)) >= 3 * len(np.union1d(s, probe))
        }


def test_links_around_a_hub_come_from_the_tree(spark):
    """The tree's verdicts on a hub's classes, and the join's components over them, equal brute force."""
    rng, rows = random.Random(9), []
    for g in range(4):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(15):
            w = list(base)
            for _ in range(rng.choice([1, 2, 4])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute_components(rows, 4, 85, 100)
    assert sorted(map(tuple, jaccard.join(df).collect())) == want and len({c for _, _, c in want}) < len(rows) * 2 / 3  # most are linked, some differ too much
    shingler = jaccard.Shingler(4)
    sets = {i: shingler.hashes(t.encode()) for i, t in rows}
    hub, others = sets[0], [sets[i] for i in range(1, 15)]
    tree = jaccard.PrefixTree(others)
    linked = [o >= jaccard.least_overlap(len(s), len(hub), 85, 100) for s, o in zip(others, tree.overlaps(hub, 3, 10))]
    assert linked == [100 * len(np.intersect1d(s, hub)) >= 85 * len(np.union1d(s, hub)) for s in others] and any(linked)
    assert sum(tree.shared) > 0  # beginnings are shared


def test_one_of_each_with_null_and_repeated_ids(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(9)]
    near = texts[0] + " more"  # a near copy of id 3
    rows = [(3, texts[0]), (7, texts[1]), (7, near), (None, texts[2]), (None, texts[3]), (None, texts[4]), (None, texts[4]), (None, ""), (None, None), (5, ""), (5, ""), (8, texts[5]), (8, texts[5]), (8, texts[6]), (None, texts[5]), (9, texts[1] + " end"), (None, texts[7] + " x"), (None, texts[7])]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = Counter((r["doc_id"], r["text"]) for r in kept)
    last = [g for g in got if g[1] and g[1].startswith(texts[7])]
    want = [(3, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[4]), (None, ""), (None, None), (5, ""), (5, ""), (8, texts[5]), (8, texts[6])]
    assert len(last) == 1 and got == Counter(want) + Counter(last)


def test_packing_round_trip(spark):
    texts = [*TEXTS, "word " * 2500, "don't  stop \n now"] + ["some words here " * k for k in range(60)]
    got = packing.pack(frame(spark, texts).repartition(3)).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    import zlib

    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:]) and len(own) == -(-len(ids) // 1024)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in got) // 1024) + 3
    assert packing.pack(frame(spark, []).limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a"] * 6 + ["b", "c", None])) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    by = {}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        t = by.setdefault(source[r["doc_id"]], [r["target"], 0, r["source_size"]])
        t[1] += r["taken"]
    assert abs(sum(t[0] for t in by.values()) - sum(t[2] for t in by.values())) < 1e-6
    assert all(abs(t[0] - t[1]) <= 31 and t[0] <= 3 * t[2] + 1e-9 for t in by.values())
    assert mixing.mix(frame(spark, TEXTS)).count() == len(TEXTS)


def test_lm_equals_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "B", "c", "d", f"r{k}"]) for _ in range(rng.randint(0, 40))) for k in range(80)] + TEXTS
    docs = frame(spark, texts).withColumn("held_out", crc_fold(F.col("doc_id"), 10) == 0)
    held = {r["doc_id"]: r["held_out"] for r in docs.collect()}
    tokens = {i: [x.encode() for x in words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [lm.END] for i, t in enumerate(texts)}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    pairs = Counter(g for i, ws in tokens.items() if not held[i] for g in zip(ws, ws[1:]))
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda h, w: (pairs[h, w] + lm.MU * p1(w)) / (c[h] + lm.MU)
    for sizes in ((lm.BLOCK, lm.RANGE), (300, 500)):
        got = {r["doc_id"]: r for r in lm.score(docs, 2, *sizes).collect()}
        assert len(got) == len(texts)
        for i, ws in tokens.items():
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
            assert abs(r["base_score"] - sum(log10(p1(w)) for w in ws)) < 1e-6
            want = log10(p1(ws[0])) + sum(log10(p2(h, w)) for h, w in zip(ws, ws[1:]))
            assert abs(r["score"] - want) < 1e-6
    assert lm.score(docs.limit(0)).count() == 0
    alone = lm.score(docs.withColumn("held_out", F.lit(True))).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in alone)


def test_lm_trigrams_equal_a_walk_with_a_carried_state(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["a", "b", "c", f"r{k % 9}"]) for _ in range(rng.randint(0, 40))) for k in range(80)] + TEXTS
    docs = frame(spark, texts).withColumn("held_out", crc_fold(F.col("doc_id"), 10) == 0)
    held = {r["doc_id"]: r["held_out"] for r in docs.collect()}
    tokens = {i: [x.encode() for x in words(t)] + [lm.END] for i, t in enumerate(texts)}
    grams = Counter(tuple(ws[k : k + n]) for i, ws in tokens.items() if not held[i] for n in (1, 2, 3) for k in range(len(ws) - n + 1))
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)

    def p(gram):
        if len(gram) == 1:
            return (grams[gram] + 0.1) / (n + 0.1 * (v + 1))
        return (grams[gram] + lm.MU * p(gram[1:])) / (grams[gram[:-1]] + lm.MU)

    def walk(ws):
        state, total = (), 0.0
        for w in ws:
            context = state
            while context and not grams[*context, w]:
                total += log10(lm.MU / (grams[context] + lm.MU))
                context = context[1:]
            total += log10(p((*context, w)))
            state = (*context, w)[-2:]
            while state and not grams[state]:
                state = state[1:]
        return total

    assert {len(g) for g, c in grams.items() if c > 2} == {1, 2, 3}
    for sizes in ((lm.BLOCK, lm.RANGE), (300, 500)):
        got = {r["doc_id"]: r["score"] for r in lm.score(docs, 3, *sizes).collect()}
        assert len(got) == len(texts) and all(abs(got[i] - walk(ws)) < 1e-6 for i, ws in tokens.items())
    assert lm.score(docs.limit(0), 3).count() == 0
    assert all(r["score"] == 0 for r in lm.score(docs.withColumn("held_out", F.lit(True)), 3).collect())


def test_automaton_contexts_sum_to_one():
    block = lm.Block()
    block.add([b"a b c", b"a b a b", b"b b c", b"a c"] * 3, [False] * 12)
    keys, totals = block.finish().gram_counts()
    assert (lm._unpack_keys(lm._pack_keys(keys)) == keys).all()
    place, first = block.gram_places()
    assert (keys[place] == block.keys).all() and (np.bincount(place) == totals).all()
    counts = block.word_counts()
    model = lm.build(block, first, counts, totals, int(counts.sum()), len(counts))
    source, _, logp = model.orders[0]
    arcs = {(h, w): p for h, w, p in zip(source.tolist(), block.tokens[block.at[first]].tolist(), logp.tolist())}
    unseen = 0.1 / (counts.sum() + 0.1 * (len(counts) + 1))
    assert model.word_state[0] == 0
    for state in range(2, 1 + len(counts)):
        seen = [arcs.get((state, w), model.fail_logp[state] + model.word_logp[w]) for w in range(len(counts))]
        assert abs(sum(10**x for x in seen) + 10 ** model.fail_logp[state] * unseen - 1) < 1e-9


@pytest.mark.parametrize("order", [2, 3])
def test_carried_states_are_the_longest_trained_contexts(order):
    rng = random.Random(2)
    rows = [[rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 2, 5, 300]))] for _ in range(40)]
    held = [k % 3 == 0 for k in range(40)]
    block = lm.Block()
    block.add([" ".join(r).encode() for r in rows], held)
    block.finish()
    block.add_triples()
    place, first = block.gram_places()
    triple, step = block.gram_places(True)
    n = lambda places, at, size: np.bincount(places[block.train[at]], minlength=size)
    totals, counts = n(place, block.at, len(first)), block.word_counts()
    triples = (place[block.third[step] - 1], place[block.third[step]], n(triple, block.at[block.third], len(step)))
    model = lm.build(block, first, counts, totals, int(counts.sum()), int((counts > 0).sum()), triples if order > 2 else None)
    arcs = [block.by_token(block.at, place), block.by_token(block.at[block.third], triple)][: order - 1]
    name = {v: k for k, v in block.words.items()}
    labels = [(), *((name[w],) for w in range(len(counts))), *((name[block.tokens[block.at[i] - 1]], name[block.tokens[block.at[i]]]) for i in first.tolist())]
    trained = {g for r, h in zip(rows, held) if not h for k in range(len(r)) for g in (tuple(r[k : k + 1]), tuple(r[k : k + 2]))} | {()}
    want = []
    for r in rows:
        for k in range(len(r)):
            context = tuple(r[: k + 1][1 - order :])
            while context not in trained:
                context = context[1:]
            want.append(context)
        want.append(None)
    whole = model.walk(block, arcs, 10**9)
    for span in (64, 7, 1):
        logp, states = model.walk(block, arcs, span)
        assert (states == whole[1]).all() and np.allclose(logp, whole[0], rtol=0, atol=1e-12)
        got = [tuple(w.decode() for w in labels[i]) for i in states.tolist()]
        assert all(w is None or g == w for g, w in zip(got, want))


def test_quality_learns_from_positives(spark):
    rng = random.Random(1)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(80)) + "." for _ in range(200)]
    junk = ["SPAM!! " * 60 for _ in range(60)]
    rows = [(i, t, int(i < 200)) for i, t in enumerate(good + junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "label"))
    got = {r["doc_id"]: r for r in quality.score(df.withColumn("held_out", F.lit(False)), model).collect()}
    assert all(got[i]["predicted"] == 1 for i in range(200)) and all(got[i]["predicted"] == 0 for i in range(200, 260))
    empty = quality.fit(df.select("doc_id", "text").limit(0), df.select("doc_id", "label").limit(0))
    assert quality.score(frame(spark, TEXTS).withColumn("held_out", F.lit(False)), empty).count() == len(TEXTS)


def test_toxicity_chain(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["river", "stone", "walks", "slowly", "green", "house"]) for _ in range(30)) for _ in range(90)]
    toxic = [c + rng.choice([" you idiot", " utterly pathetic"]) for c in clean[:40]]
    rows = [(i, t, int(i >= 90)) for i, t in enumerate(clean + toxic)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["rejected"] for r in toxicity.score(df, chain).collect()}
    assert all(got[i] == (i >= 90) for i in got)
    assert toxicity.keep_clean(frame(spark, TEXTS), chain).count() == len(TEXTS)
    none = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0))
    assert not any(r["rejected"] for r in toxicity.score(df, none).collect())


def test_toxicity_sees_how_often_a_marker_recurs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(6))
    text = lambda often: "     ".join([word() for _ in range(30)] + ["réeuxvoyant"] * often + [word() for _ in range(30)])
    rows = [(i, text(1 if i < 150 else 12), int(i >= 150)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    new = spark.createDataFrame([(i, text(1 if i < 20 else 12)) for i in range(40)], "doc_id long, text string")
    assert {r["doc_id"] for r in toxicity.score(new, chain).collect() if r["rejected"]} == set(range(20, 40))


def test_toxicity_features_are_of_whole_characters(monkeypatch):
    text = "Ünïcöde réeux 漢字かな x " * 20
    whole = toxicity.gram_values(text.encode())
    for got, want in zip(toxicity.gram_values(text.lower().encode()), whole):
        assert (got == want).all()
    monkeypatch.setattr(toxicity, "SLICE", 7)  # slices end between words
    for got, want in zip(toxicity.gram_values(text.encode()), whole):
        assert (got == want).all()
    assert set(toxicity.gram_values("かな".encode())[0]) <= set(whole[0])


def test_toxicity_learns_from_a_small_table(spark):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(40))
    rows = [(i, text() + (" you moron" if i < 6 else ""), int(i < 6)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    new = spark.createDataFrame([(i, text() + (" you moron" if i < 5 else "")) for i in range(10)], "doc_id long, text string")
    got = {r["doc_id"]: r["toxic_prob"] for r in toxicity.score(new, chain).collect()}
    assert min(got[i] for i in range(5)) > 2 * max(got[i] for i in range(5, 10)) and min(got.values()) > 0


def test_quality_rules(spark):
    texts = [*TEXTS, " ".join(f"w{k}" for k in range(60)), "a b c d " * 40, "line\n" * 60, "x\n\nx\n y", " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))]
    got = {r["doc_id"]: r for r in rules.judge(frame(spark, texts).select("doc_id", "text")).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered)), t
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert not got[len(TEXTS)]["kept"]  # more digits than letters
    assert got[len(texts) - 1]["kept"]
