"""Language-model scoring with weighted backoff automata.

The model holds every word, bigram and trigram of all training texts (words and bigrams with
``order`` 2), so it grows with the corpus and is never held in one place. Texts are dealt into blocks of about
``BLOCK`` bytes, by input partition. Each block sends its distinct words, bigrams and trigrams with
its own training counts, packed by hash range, to the task of that range, which adds
them up over all blocks and answers with what a block can't know: how much each total exceeds
the block's own count, in the order that they came in. A frequent n-gram is one entry of each block, so no range
is hot, and the number of ranges follows the corpus' size; a block sends a row to those ranges alone in which
it has something, so there are never more rows than n-grams. Its texts travel once, as one packed row.

A block then builds the part of the automaton that its texts can reach, with the totals
over all training texts. A state is a context: a trained bigram, a trained word, or the empty
one. An n-gram's arc carries its smoothed log-probability; every other token follows the failure
arc, which carries the context's left-over weight: from a bigram to its last word, and from a
word to the empty context. Smoothing adds ``MU`` tokens to each context, spread as the next shorter
context says, and the add-0.1 unigram base at last: an n-gram has (c(hw) + MU p(w)) / (c(h) + MU), so a
context's probabilities sum to 1. All texts of a block are walked from left to right together, a token of each at a time, and
each carries its state: it takes the state's arc for its next token, or follows failure arcs until a state has one.

Words are counted exactly. Bigrams and trigrams are told apart by hashes of their words, of ``SPARE`` bits more than
the corpus' size in bytes has, and 63 at most: of a million million n-grams, no more than about ten thousand share a
count with another one, whatever the corpus' size.

Defined results: a null or empty text is its end token alone; a text of any length is one block at
least, and whole; a null id is in
training; repeated rows count and are scored once each; with no training rows N is
0 and V is 0, so each token has probability 1; extra columns are ignored; no rows
give no rows. The input's partitions must be the same each time they are read, as those of
files and checkpoints are; if a block reads differently the second time, the job fails.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import bytes_of, words_of, written

#: Bytes of text of a block, and of the corpus for each hash range.
BLOCK, RANGE = 4 << 20, 4 << 20
#: Bits of an n-gram's hash beyond those of the corpus' size.
SPARE = 24
MU, ADD = 4.0, 0.1
END = b""  # no word is empty
#: Texts that are cut into words together.
TEXTS = 512


def _mixed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    key = first * np.uint64(0x9E3779B97F4A7C15) + (last >> np.uint64(1))
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(32))) & ~np.uint64(1)  # the last bit is free


@dataclass
class Block:
    """Numbered tokens of some texts: ``words`` numbers them, the end token is 0. The last ``drop`` bits of n-grams'
    hashes are 0."""

    drop: int = 1
    words: dict[bytes, int] = field(default_factory=lambda: {END: 0})
    parts: list[np.ndarray] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    trained: list[bool] = field(default_factory=list)

    def add(self, texts: list[bytes], held_out: list[bool]) -> None:
        give, words = self.words.setdefault, self.words
        for at in range(0, len(texts), TEXTS):
            rows = [words_of(t, True) for t in texts[at : at + TEXTS]]
            sizes = [len(r) + 1 for r in rows]
            self.parts.append(np.fromiter((give(w, len(words)) for r in rows for w in (*r, END)), np.int64, sum(sizes)))
            self.sizes += sizes
        self.trained += [not h for h in held_out]

    def finish(self) -> Block:
        self.tokens = np.concatenate([np.zeros(0, np.int64), *self.parts])
        self.parts = []
        sizes = np.array(self.sizes, np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.train = np.repeat(np.array(self.trained, bool), sizes)
        inner = np.ones(len(self.tokens), bool)
        inner[self.starts] = False
        self.at = np.flatnonzero(inner)  # tokens that have one before them
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        self.keys = self._kept(_mixed(hashes[self.tokens[self.at - 1]], hashes[self.tokens[self.at]]))
        return self

    def add_triples(self) -> None:
        """``third``: the two-token steps that follow one in the same text; each ends a trigram."""
        self.third = np.flatnonzero(np.diff(self.at) == 1) + 1
        self.triples = self._kept(_mixed(self.keys[self.third - 1], self.keys[self.third]))

    def _kept(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(self.drop) << np.uint64(self.drop)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.words))

    def gram_counts(self, triples: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order, and how often each occurs in training texts."""
        keys, at = (self.triples, self.at[self.third]) if triples else (self.keys, self.at)
        marked = np.sort(keys | self.train[at].astype(np.uint64))
        key = marked & ~np.uint64(1)
        if not len(key):
            return key, np.zeros(0, np.int64)
        first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        return key[first], np.add.reduceat((marked & np.uint64(1)).astype(np.int64), first)

    def word_order(self, slots: int) -> tuple[list[bytes], np.ndarray, list[tuple[int, int, int]]]:
        """Words by hash range and then by name, their numbers, and the ranges' parts of them."""
        names = sorted(self.words)
        slot = np.fromiter((zlib.crc32(w) % slots for w in names), np.int64, len(names))
        order = np.argsort(slot, kind="stable")
        names = [names[i] for i in order.tolist()]
        return names, np.fromiter(map(self.words.__getitem__, names), np.int64, len(names)), _runs(slot[order])

    def gram_places(self, triples: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The place of each step (of ``third``, or of two tokens) among the distinct keys, and the first step of each key."""
        keys = self.triples if triples else self.keys
        order = np.argsort(keys)
        key = keys[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(new) - 1
        return place, order[new]

    def by_token(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each token the n-gram that ends there, or -1."""
        out = np.full(len(self.tokens), -1)
        out[at] = place
        return out


@dataclass
class Automaton:
    """State 0 is the empty context, 1 + w that of word w, and 1 + words + i that of bigram i. A state's failure arc leads to
    the next shorter context (``fail_to``) with weight ``fail_logp``. ``orders`` holds the arcs of bigrams and then of trigrams:
    arc i of an order leads from state ``source[i]`` to ``target[i]`` with ``logp[i]``, which is NaN if training lacks it. The empty
    context has an arc for each word. Each list of arcs ends with one that leaves no state, for steps without any."""

    word_logp: np.ndarray
    word_state: np.ndarray
    fail_to: np.ndarray
    fail_logp: np.ndarray
    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def walk(self, block: Block, arcs: list[np.ndarray], span: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and the state behind it, for each token. ``arcs``: for each order, the n-gram that ends at
        each token, or -1. Step t of all texts is taken together, and each carries its state. Texts are walked in stretches of ``span``
        tokens; one that doesn't begin a text starts from the empty context as many tokens earlier as a context is long,
        and so is in the state that a walk from the text's begin would carry."""
        logp, seen = np.empty(len(block.tokens)), np.empty(len(block.tokens), np.int64)
        sizes = np.array(block.sizes, np.int64)
        n = -(-sizes // span)
        text = np.repeat(np.arange(len(sizes)), n)
        first = block.starts[text] + (np.arange(len(text)) - (np.cumsum(n) - n)[text]) * span
        begin, end = np.maximum(block.starts[text], first - len(self.orders)), np.minimum(first + span, (block.starts + sizes)[text])
        order = np.argsort(begin - end, kind="stable")  # the longest first
        begin, end, first = begin[order], end[order], first[order]
        state = np.zeros(len(begin), np.int64)
        for t in range(int((end - begin).max(initial=0))):
            live = int(np.searchsorted(begin - end, -t))  # those with more than t tokens
            at, now = begin[:live] + t, state[:live]
            gained, todo = np.zeros(live), np.ones(live, bool)
            to = np.zeros(live, np.int64)
            shorter = (len(self.word_state), 0)[-len(self.orders) :]  # the last state of a shorter context, by order
            for (source, target, weight), arc, last in zip(self.orders[::-1], arcs[::-1], shorter):
                own = arc[at]
                take = todo & (source[own] == now) & ~np.isnan(weight[own])
                gained[take] += weight[own[take]]
                to[take] = target[own[take]]
                todo &= ~take
                fail = todo & (now > last)
                gained[fail] += self.fail_logp[now[fail]]
                now = np.where(fail, self.fail_to[now], now)
            word = block.tokens[at[todo]]
            gained[todo] += self.word_logp[word]
            to[todo] = self.word_state[word]
            state[:live] = to
            mine = at >= first[:live]
            logp[at[mine]], seen[at[mine]] = gained[mine], to[mine]
        return logp, seen


def build(block: Block, first: np.ndarray, counts: np.ndarray, totals: np.ndarray, n: int, kinds: int, triples: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Automaton:
    """``counts`` and ``totals``: training counts of the block's words and of its bigrams, over the whole
    corpus; ``first``: a step of each bigram. ``triples``: the bigrams that a trigram begins and ends with, and its training count."""
    p1 = (counts + ADD) / (n + ADD * (kinds + 1))
    context = counts > 0
    context[0] = False
    word_state = np.where(context, 1 + np.arange(len(counts)), 0)
    source, word = block.tokens[block.at[first] - 1], block.tokens[block.at[first]]
    pair = np.where(totals > 0, np.log10((totals + MU * p1[word]) / (counts[source] + MU)), np.nan)
    fail_to, fail_logp = np.zeros(1 + len(counts), np.int64), np.concatenate([[0.0], np.log10(MU / (counts + MU))])
    ends = lambda *c: tuple(np.append(x, none) for x, none in zip(c, (-1, 0, np.nan)))
    if triples is None:
        return Automaton(np.log10(p1), word_state, fail_to, fail_logp, [ends(1 + source, word_state[word], pair)])
    begins, last, count = triples
    bigram = 1 + len(counts)  # the first bigram's state
    with np.errstate(invalid="ignore"):  # a trained trigram's bigrams are trained
        triple = np.where(count > 0, np.log10((count + MU * 10 ** pair[last]) / (totals[begins] + MU)), np.nan)
    arcs = [ends(1 + source, bigram + np.arange(len(pair)), pair), ends(bigram + begins, bigram + last, triple)]
    return Automaton(np.log10(p1), word_state, np.concatenate([fail_to, word_state[word]]), np.concatenate([fail_logp, np.log10(MU / (totals + MU))]), arcs)


def _pack(numbers: np.ndarray) -> bytes:
    """All numbers' first bytes, then all second ones, and so on: bytes that are mostly zero lie together."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray, drop: int = 0) -> bytes:
    """The differences of keys without their last bits; two keys that differ do so without them."""
    return _zip(_pack(np.diff(keys >> np.uint64(drop), prepend=np.uint64(0))))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(_unzip(data), "<u8"), dtype=np.uint64)


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _blocks(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows with their block's number, which depends on the partition's rows alone."""
    before, task = 0, TaskContext.get().partitionId() << 32
    for part in parts:
        if not part.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (before + np.cumsum(size) - size) // most
        before += int(size.sum())
        for at, end in zip(cuts := [0, *(np.flatnonzero(np.diff(block)) + 1).tolist()], [*cuts[1:], len(block)]):
            yield task + int(block[at]), part.slice(at, end - at)


def _mark(texts: list[bytes]) -> int:
    """A sum of checksums that doesn't depend on the texts' order."""
    return sum(zlib.crc32(t) + 1 for t in texts)


_SENT = pa.schema([("slot", pa.int32()), ("block", pa.int64()), ("grams", pa.binary()), ("gram_n", pa.binary()), ("words", pa.binary()), ("word_n", pa.binary()), ("mark", pa.int64())])
_SENT_DDL = "slot int, block long, grams binary, gram_n binary, words binary, word_n binary, mark long"
_TOLD_DDL = "slot int, block long, gram_more binary, word_more binary, mark long, tokens long, kinds long"


def _frozen(parts: list[pa.RecordBatch]) -> bytes:
    """Rows as one compressed stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for part in parts:
            out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _runs(slot: np.ndarray) -> list[tuple[int, int, int]]:
    """Ordered numbers' distinct values, and where each begins and ends."""
    cuts = np.flatnonzero(np.diff(slot, prepend=-1, append=-1)).tolist() if len(slot) else []
    return [(int(slot[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def _slots(keys: np.ndarray, slots: int) -> np.ndarray:
    """The range of each key, one of ``slots`` equal parts of all 64-bit numbers: the product's upper 64 bits."""
    high, low, n = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), np.uint64(slots)
    return ((high * n + (low * n >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def _packed(block: int, held: Block, mark: int, slots: int, order: int) -> Iterator[pa.RecordBatch]:
    """A row for each hash range in which the block has n-grams or words. Words have no space, so spaces join them.
    Trigrams have ranges of their own, numbered from ``slots``."""
    held.finish()
    keys, n = held.gram_counts()
    names, number, runs = held.word_order(slots)
    grams, words = {k: (a, b) for k, a, b in _runs(_slots(keys, slots))}, {k: (a, b) for k, a, b in runs}
    word_n = held.word_counts()[number].astype("<u4")
    rows: list[tuple] = []
    for k in sorted(grams.keys() | words.keys()):
        (a, b), (c, d) = grams.get(k, (0, 0)), words.get(k, (0, 0))
        rows.append((k, block, _pack_keys(keys[a:b], held.drop), _pack(n[a:b].astype("<u4")), _zip(b" ".join(names[c:d])) if c < d else None, _pack(word_n[c:d]), None))
    if order > 2:
        held.add_triples()
        keys, n = held.gram_counts(True)
        for k, a, b in _runs(_slots(keys, slots)):
            rows.append((slots + k, block, _pack_keys(keys[a:b], held.drop), _pack(n[a:b].astype("<u4")), None, b"", None))
    rows.append((block % slots, block, b"", b"", None, b"", mark))
    for at in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256]), _SENT.types)], schema=_SENT)


def _totals(key, table):
    """Add up one hash range; tell each block how much the totals exceed its own counts."""
    rows = table.to_pylist()
    out: list[tuple] = [(-1, r["block"], b"", b"", r["mark"], None, None) for r in rows if r["mark"] is not None]
    rows = [r for r in rows if r["mark"] is None]
    keys = [_unpack_keys(r["grams"]) for r in rows]
    n = [_unpack(r["gram_n"], "<u4").astype(np.int64) for r in rows]
    distinct, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([np.zeros(0), *n]), minlength=len(distinct)).astype(np.int64)
    number: dict[bytes, int] = {}
    words = [[] if r["words"] is None else [number.setdefault(w, len(number)) for w in _unzip(r["words"]).split(b" ")] for r in rows]
    word_n = [_unpack(r["word_n"], "<u4").astype(np.int64) for r in rows]
    sums = np.zeros(len(number), np.int64)
    for some, counts in zip(words, word_n):
        sums[some] += counts  # a row's words differ
    at = 0
    for r, k, c, some, counts in zip(rows, keys, n, words, word_n):
        out.append((r["slot"], r["block"], _pack(total[place[at : at + len(k)]] - c), _pack(sums[some] - counts), None, None, None))
        at += len(k)
    out.append((-1, None, b"", b"", None, int(sums.sum()), int((sums > 0).sum())))
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["slot", "block", "gram_more", "word_more", "mark", "tokens", "kinds"])


def score(docs: DataFrame, order: int = 2, block_bytes: int = BLOCK, range_bytes: int = RANGE) -> DataFrame:
    """``docs`` (doc_id, text, held_out) -> doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score; learns from the rows that aren't held out, n-grams of up to ``order`` (2 or 3) words."""
    docs = docs.select("doc_id", "held_out", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots, drop = max(1, -(-size // range_bytes)), max(1, 64 - SPARE - size.bit_length())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, mark = None, Block(drop), 0
        for number, part in _blocks(parts, block_bytes):
            if block not in (None, number):
                yield from _packed(block, held, mark, slots, order)
                held, mark = Block(drop), 0
            block, texts = number, bytes_of(part.column("text"))
            held.add(texts, part.column("held_out").to_pylist())
            mark += _mark(texts)
        if block is not None:
            yield from _packed(block, held, mark, slots, order)

    def by_block(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, some in itertools.groupby(_blocks(parts, block_bytes), lambda x: x[0]):
            rows = _frozen([part for _, part in some])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows], pa.binary())], names=["block", "rows"])

    told = written(docs.mapInArrow(gather, _SENT_DDL).groupBy("slot").applyInArrow(_totals, _TOLD_DDL), "lm-totals")
    n, kinds = told.where(F.col("block").isNull()).agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    def walk(left, right):
        if left.num_rows != 1:
            raise ValueError("the input's partitions changed between two reads")
        left = pa.ipc.open_stream(left.column("rows")[0].as_buffer()).read_all()
        texts = bytes_of(left.column("text"))
        if _mark(texts) != (pc.sum(right.column("mark")).as_py() or 0):
            raise ValueError("the input's partitions changed between two reads")
        block = Block(drop)
        block.add(texts, left.column("held_out").to_pylist())
        del texts
        block.finish()
        place, first = block.gram_places()
        told_rows = sorted((r for r in right.select(["slot", "gram_more", "word_more"]).to_pylist() if r["slot"] >= 0), key=lambda r: r["slot"])
        counts, (_, number, _) = block.word_counts(), block.word_order(slots)
        counts[number] += np.concatenate([_unpack(r["word_more"], "<i8") for r in told_rows])
        totals = np.bincount(place[block.train[block.at]], minlength=len(first))
        totals += np.concatenate([_unpack(r["gram_more"], "<i8") for r in told_rows if r["slot"] < slots])
        arcs, triples = [block.by_token(block.at, place)], None
        if order > 2:
            block.add_triples()
            triple, step = block.gram_places(True)
            more = np.bincount(triple[block.train[block.at[block.third]]], minlength=len(step))
            more += np.concatenate([np.zeros(0, np.int64), *(_unpack(r["gram_more"], "<i8") for r in told_rows if r["slot"] >= slots)])
            arcs.append(block.by_token(block.at[block.third], triple))
            triples = place[block.third[step] - 1], place[block.third[step]], more
        model = build(block, first, counts, totals, n, kinds, triples)
        del first, triples, told_rows
        sizes = np.array(block.sizes, np.int64)
        base = np.add.reduceat(model.word_logp[block.tokens], block.starts)
        known = np.add.reduceat((counts[block.tokens] > 0).astype(np.int64), block.starts)
        found = np.add.reduceat(model.walk(block, arcs)[0], block.starts)
        return pa.Table.from_arrays(
            [left.column("doc_id"), left.column("held_out"), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n), pa.int64()), pa.array(base), pa.array(found)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    texts = docs.mapInArrow(by_block, "block long, rows binary")
    about = told.where(F.col("block").isNotNull()).drop("tokens", "kinds")
    return (
        texts.groupBy("block")
        .cogroup(about.groupBy("block"))
        .applyInArrow(walk, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
