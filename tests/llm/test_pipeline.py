"""The corpus pipeline, each stage and the whole, against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tickerloom.llm import packing, secrets, toxicity
from test_edges import brute_mix
from test_llm import words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents():
    rng = random.Random(17)
    pool = ["river", "stone", "walks", "slowly", "green", "house", "over", "under", "table", "light"] + [f"w{k}" for k in range(300)]
    text = lambda n=60: " ".join(rng.choice(pool) for _ in range(n))
    rows = []
    for k in range(50):
        rows.append((k, text() + (" grobian" * 4 if k % 5 == 0 else "")))
    for k in range(12):  # near and exact copies
        w = rows[1][1].split()
        if k % 3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((60 + k, " ".join(w)))
    rows += [(80, text(20) + ' password = "hunter2hunter2" ' + text(20)), (81, "AKIA" + "Q" * 16 + " " + text(30)), (82, "word " * 3000)]
    rows += [(None, text()), (None, text()), (None, None), (None, ""), (90, ""), (90, ""), (91, text()), (91, rows[2][1]), (7, text()), (92, "short one")]
    rows.append(rows[3])  # a repeated row
    return [(i, t, "en", rng.choice(["a", "a", "a", "b", None]), None if t is None else len(t)) for i, t in rows]


def labels():
    return [(k, int(k % 4 != 0), int(k % 5 == 0)) for k in range(50)] + [(None, 1, 1), (3, 1, None)]


def brute_groups(rows):
    """One row of each group: of the least id (null last)."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                root[find(a)] = find(b)
    groups = {}
    for k, s in enumerate(sets):
        groups.setdefault(find(k) if s else -1 - k, []).append(k)
    return [[rows[k] for k in g] for g in groups.values()]


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    rows, d = documents(), str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels(), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "secrets", "mix", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    bag = lambda df: Counter(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())

    # toxicity: what the chain rejects goes, whatever else the row holds
    chain = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"))
    clean = [r for r in rows if chain.probabilities((r[1] or "").encode())[-1] < 0.5]
    assert {r[0] for r in rows} - {r[0] for r in clean} == set(range(0, 50, 5))
    after = stage["toxicity"](spark, docs, d)
    assert after.columns == docs.columns and bag(after) == Counter(clean)

    # near copies: one of each group, of the least id
    groups = brute_groups(clean)
    kept = [tuple(r[c] for c in COLUMNS) for r in stage["ngram_jaccard"](spark, after, d).collect()]
    order = lambda r: (r[0] is None, r[0] or 0)
    assert len(kept) == len(groups) and not Counter(kept) - Counter(clean)
    for g in groups:
        own = [r for r in kept if r in g]
        assert own and order(min(own, key=order))[:2] == order(min(g, key=order))[:2]

    # secrets: what the regexes find is replaced
    def redacted(t):
        spans = sorted(((m.start(), m.end(), r.kind) for r in secrets.RULES for m in re.finditer(r.regex, t.encode()) if not r.least or len(m[r.group]) >= r.least), key=lambda x: x[0])
        data, out, at = t.encode(), [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [data[at:a], f"[{kind}]".encode()]
            at = max(at, b)
        return b"".join([*out, data[at:]]).decode()

    small = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")
    safe = [(i, None if t is None else redacted(t), x, s, n if t is None or redacted(t) == t else len(redacted(t))) for i, t, x, s, n in kept]
    assert sum(a != b for a, b in zip(kept, safe)) == 2 and bag(stage["secrets"](spark, small, d)) == Counter(safe)

    # mix: as often as brute force takes them
    times = brute_mix([(i, t, s) for i, t, _, s, _ in safe])
    want = Counter()
    for r, n in zip(safe, times):
        want[r] += n
    mixed = stage["mix"](spark, spark.createDataFrame(safe, small.schema), d)
    assert mixed.columns == docs.columns and bag(mixed) == +want

    # packing: every token once, no sequence too long; and the whole run
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces = Counter()
    for (i, t, *_), n in (+want).items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            length = min(len(ids), first) if k == 0 else 1024
            pieces[i, k, a, length, zlib.crc32(ids[a : a + length].tobytes())] += n
    for got in (stage["packing"](spark, mixed, d).collect(), corpus_pipeline.run(spark, d).collect()):
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
        room = Counter()
        for r in got:
            room[r["sequence_id"]] += r["length"]
        assert max(room.values()) <= 1024 and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_stages_of_empty_tables(spark, tmp_path):
    d, schema = str(tmp_path), "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.createDataFrame([], schema)
    docs.write.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, d).count() == 0


def test_words_are_those_of_the_contract():
    assert words("a\x1cb c\td") == ["a\x1cb", "c", "d"]
