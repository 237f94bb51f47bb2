"""Cross-tokenizer alignment against loops over all tokens of each text, encoded whole."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickerloom.llm import align

LETTERS = align.byte_letters()


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def spans(tokenizers, text):
    """[(id, start, end)] of both sides, or nothing."""
    a, b = tokenizers
    if not text:
        return [], []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    one = [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in ids]
    two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if not b"".join(x for _, x in one) == b"".join(x for _, x in two) == (" " + text).encode():
        return [], []
    out = []
    for side in (one, two):
        at, own = 0, []
        for i, x in side:
            own.append((i, at, at + len(x)))
            at += len(x)
        out.append(own)
    return out


def brute(tokenizers, rows):
    aligned = []
    for _, text in rows:
        a, b = spans(tokenizers, text)
        links = [(i, j) for i, s, e in a for j, u, v in b if max(s, u) < min(e, v)]
        shared = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for high in shared:
            groups.append(([i for i, s, e in a if low < e <= high], [i for i, s, e in b if low < e <= high], low, high))
            low = high
        aligned.append((a, b, links, groups))
    count = Counter(p for _, _, links, _ in aligned for p in set(links))
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for (doc_id, _), (a, b, links, groups) in zip(rows, aligned):
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _, _ in groups).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), digest, sum(len(x) * len(y) for x, y, _, _ in groups)))
    return out, aligned


AWKWARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb\n\n c", "tab\tand  two", "x▁y", "▁", "<s> </s> <unk> <|endoftext|>", "<0x41> <0x0A>", "naïve café déjà-vu", "Straße über", "日本語 のテキスト", "👩‍👩‍👧 emoji🙂 end",
    "\x00 nul\x00", "é combining", "ﬁ ligature", "…  odd … space", "http://a.b/c?d=e&f=g#h", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890 12 3", "don't we'll I'M", " nbsp  x", "\r\n crlf\r\n",
]


def test_alignment_equals_loops(spark, tokenizers):
    rng = random.Random(5)
    rows = list(enumerate(AWKWARD)) + [(None, "no id"), (3, "same id"), (3, "same id")]
    words = ["the", "der", "über", "naïve", "token", "ization,", "x\ny", "…", "é.", "42", "(a)", "日本"]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    rows += [(400 + i, "".join(rng.choice("ab é\n.▁日🙂<>|") for _ in range(rng.randint(0, 20)))) for i in range(150)]
    want, _ = brute(tokenizers, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("block", "codes", "n_a")})
    key = lambda r: tuple(map(repr, r))
    for block in (align.BLOCK, 50):
        assert sorted(map(tuple, align.score(df.repartition(3), block=block).collect()), key=key) == sorted(want, key=key)


def test_groups_and_products(spark, tokenizers):
    rows = [(i, t) for i, t in enumerate(AWKWARD)]
    _, aligned = brute(tokenizers, rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = align.groups(df)
    want = sorted((i, k, s, e, x, y) for i, (_, _, _, groups) in enumerate(aligned) for k, (x, y, s, e) in enumerate(groups))
    assert sorted(map(tuple, got.collect())) == want
    pairs = Counter((r.doc_id, r.group, r.a_id, r.b_id) for r in align.products(got).collect())
    assert pairs == Counter((i, k, a, b) for i, k, _, _, x, y in want for a in x for b in y)


def test_no_rows_no_tokens_and_long_texts(spark, tokenizers):
    schema = "doc_id long, text string"
    assert align.score(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in align.score(spark.createDataFrame([(1, None), (2, "")], schema)).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "", 0) for i in (1, 2)]
    long = " ".join(f"w{k % 977} word" for k in range(60_000))
    first = align.score(spark.createDataFrame([(1, long)], schema)).collect()[0]
    a, b = spans(tokenizers, long)
    assert (first.n_a, first.n_b, first.n_links) == (len(a), len(b), len({e for _, _, e in a} | {e for _, _, e in b}))
    assert first.count_sum == first.n_links == first.n_best


def test_a_small_cache_changes_nothing(spark, monkeypatch, tokenizers):
    both = align.Pair(align.default_tokenizer(), align.default_pieces())
    texts = [f"alpha{k} beta{k % 7}, gamma é{k}" for k in range(700)]
    want = [(g, c.tolist(), n.tolist()) for g, c, n in both.digest(texts)]
    monkeypatch.setattr(align, "CACHE", 10)
    small = align.Pair(align.default_tokenizer(), align.default_pieces())
    assert [(g, c.tolist(), n.tolist()) for k in range(0, 700, 70) for g, c, n in small.digest(texts[k : k + 70])] == want
