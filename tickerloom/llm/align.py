"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers cut a space and the text into tokens. The union of both lists of end offsets gives the elementary intervals;
``searchsorted`` finds the token of either side that an interval lies in, so each interval is one overlap of two tokens. An end that both
sides share closes a group; a group's tokens can be expanded to all its pairs.

Both also cut before a space that follows a letter or printable character, so a word's tokens don't depend on its neighbours: new words
are aligned together, many in one call, and a bounded cache holds what they give. Other texts are aligned whole.

How many documents link two ids is counted in blocks: a block of about 8 MB of text becomes one row with its documents' pairs, as places
in the block's own list of pairs. The lists meet by pair, are added up, and each block gets its pairs' counts back. So a pair travels once for
each block and not for each document, and nothing is broadcast or held for the whole corpus.

Defined results: texts that are null or empty, or that a tokenizer doesn't give back byte by byte, have no tokens (zeros, and no group
text), and link nothing; special tokens' strings are ordinary text; a text of any length is aligned whole; repeated rows and rows that
share an id, or have none, are documents of their own; of a first id's pairs that are linked in equally many documents all are best;
extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import few_rows, written
from tickerloom.llm.packing import _BEFORE_SPACE, WordEncoder, default_tokenizer

#: Characters of text of a block, about, and words whose alignment a task keeps.
BLOCK, CACHE = 8_000_000, 120_000
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_products")


def default_pieces() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elementary intervals of two cuts of the same bytes: their ends, the token of either side, and whether both end there."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


class _Words(WordEncoder):
    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of a space and each word."""
        if len(self.words) > CACHE:
            self.words.clear()
            self.bare.clear()
            self.marks.clear()
        self._learn(set(words).difference(self.words))
        return [*map(self.words.__getitem__, words)]


@dataclass
class Aligned:
    """Of some texts, one after another: ids, and by text where they and the intervals end; which texts are given back whole."""

    whole: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    ends: np.ndarray
    a: np.ndarray
    b: np.ndarray
    closes: np.ndarray
    upto: dict[str, np.ndarray]  # a, b, intervals, groups: how many up to the end of each text


class Grown:
    """Rows of an array that grows by doubling."""

    def __init__(self, *shape: int, dtype: str) -> None:
        self.n, self.all = 0, np.zeros((1024, *shape), dtype)

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.all):
            self.all = np.concatenate([self.all[: self.n], np.zeros((self.n + 2 * len(rows), *self.all.shape[1:]), self.all.dtype)])
        self.all[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


class Pair:
    """Two tokenizers: a byte-level one and one of pieces."""

    def __init__(self, bytes_path: str, pieces_path: str) -> None:
        import sentencepiece

        self.first = _Words(bytes_path, special_as_text=True)
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        letters, vocabulary = byte_letters(), self.first.tokenizer.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.opens_b = np.array([p.startswith("▁") for p in names])
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.span, self.codes_end = len(names), len(self.bytes_a) * len(names)
        self.by_word = not any("▁" in p.lstrip("▁") for p in names)  # no piece goes on past a space
        # a token's text with what follows it: another of its side, the other side or group, or the end of its text
        self.written = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"] + [f"{i}{end}" for i in range(self.span) for end in (",", ";", "\n")]
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.whole, self.counts = Grown(dtype="?"), Grown(len(COUNTS), dtype="<u4")
        self.codes, self.codes_upto = Grown(dtype="<i8"), Grown(dtype="<i8")
        self.codes_upto.add(np.zeros(1, np.int64))

    def _pieces(self, texts: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Second ids of the texts, and how many each has. Many words are encoded as one text, which is cut at each piece that begins with
        a space; where these aren't as many as the words, each word is encoded alone."""
        ids, n = [], []
        for at in range(0, len(texts), 500):
            some = texts[at : at + 500]
            own = np.array(self.second.encode(" ".join(some)), np.int64) if words else None
            first = np.flatnonzero(self.opens_b[own]) if words else []
            if len(first) == len(some):
                n.append(np.diff(np.append(first, len(own))))
            else:
                lists = self.second.encode(some, num_threads=1)
                own = np.array([i for x in lists for i in x], np.int64)
                n.append(np.array([len(x) for x in lists], np.int64))
            ids.append(own)
        return np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *n])

    def align(self, texts: list[str], words: bool) -> Aligned:
        """Of texts that stand behind a space; ``words``: they have none of their own."""
        data = self.first.ids(texts) if words else self.first._ids([" " + t for t in texts])
        ids_a, n_a = np.frombuffer(b"".join(data), "<u4").astype(np.int64), np.array([*map(len, data)], np.int64) // 4
        ids_b, n_b = self._pieces(texts, words)
        raw = [b" " + t.encode() for t in texts]
        size = np.array([*map(len, raw)], np.int64)
        sizes = [np.diff(np.concatenate([[0], np.cumsum(of[ids])])[np.concatenate([[0], np.cumsum(n)])]) for of, ids, n in ((self.size_a, ids_a, n_a), (self.size_b, ids_b, n_b))]
        joined = [b"".join(map(of.__getitem__, ids.tolist())) for of, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))]
        whole = (sizes[0] == size) & (sizes[1] == size)
        if not (whole.all() and joined[0] == joined[1] == b"".join(raw)):
            to = [np.cumsum(x) for x in sizes]
            for k in np.flatnonzero(whole).tolist():
                whole[k] = all(text[upto[k] - size[k] : upto[k]] == raw[k] for text, upto in zip(joined, to))
            ids_a, ids_b = ids_a[np.repeat(whole, n_a)], ids_b[np.repeat(whole, n_b)]
            n_a, n_b = n_a * whole, n_b * whole
        n_a, n_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        ends_a = np.cumsum(self.size_a[ids_a])
        ends, a, b, closes = intervals(ends_a, np.cumsum(self.size_b[ids_b]))
        n_links = np.searchsorted(ends, np.concatenate([[0], ends_a])[n_a], "right")
        n_groups = np.concatenate([[0], np.cumsum(closes)])[n_links]
        return Aligned(whole, ids_a, ids_b, ends, a, b, closes, {"a": n_a, "b": n_b, "intervals": n_links, "groups": n_groups})

    def texts_of(self, x: Aligned) -> list[str]:
        """The groups of each text, written down: all tokens in order of their groups, first ids before second ones."""
        to_a, to_b, group_of = x.a[x.closes] + 1, x.b[x.closes] + 1, lambda to, n: np.repeat(np.arange(len(to)), np.diff(to, prepend=0)) if n else np.zeros(0, np.int64)
        if not len(to_a):
            return [""] * len(x.whole)
        index = np.zeros(len(x.ids_a) + len(x.ids_b), np.int64)
        last_a, last_b = np.zeros(len(x.ids_a), np.int64), np.zeros(len(x.ids_b), np.int64)
        last_a[to_a - 1], last_b[to_b - 1] = 1, 1
        last_b[x.upto["b"][1:][np.diff(x.upto["b"]) > 0] - 1] = 2
        index[np.arange(len(x.ids_a)) + np.concatenate([[0], to_b[:-1]])[group_of(to_a, len(x.ids_a))]] = 2 * x.ids_a + last_a
        index[np.arange(len(x.ids_b)) + to_a[group_of(to_b, len(x.ids_b))]] = 2 * len(self.bytes_a) + 3 * x.ids_b + last_b
        found = iter("".join(map(self.written.__getitem__, index.tolist())).split("\n"))
        return [next(found) if whole else "" for whole in x.whole.tolist()]

    def measures(self, texts: list[str], words: bool) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: their groups as text, which are given back whole, their ``COUNTS``, and their overlaps' codes with how many up to each."""
        x = self.align(texts, words)
        products = np.diff(x.a[x.closes], prepend=-1) * np.diff(x.b[x.closes], prepend=-1)
        products = np.concatenate([[0], np.cumsum(products)])[x.upto["groups"]]
        counts = np.stack([np.diff(v) for v in (x.upto["a"], x.upto["b"], x.upto["groups"], x.upto["intervals"], products)], axis=1)
        return self.texts_of(x), x.whole, counts, x.ids_a[x.a] * self.span + x.ids_b[x.b], x.upto["intervals"]

    def _learn(self, new: list[str]) -> None:
        groups, whole, counts, codes, upto = self.measures(new, True)
        self.place.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        self.groups += groups
        self.codes_upto.add(upto[1:] + self.codes.n)
        self.codes.add(codes)
        self.whole.add(whole)
        self.counts.add(counts)

    def digest(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Of each text: the SHA-256 of its groups, its overlaps' codes, and its ``COUNTS``."""
        cut = [t.split(" ") if self.by_word and t and not t.endswith(" ") and not _BEFORE_SPACE.search(t) else None for t in texts]
        used = set().union(*(c for c in cut if c))
        if len(self.groups) > CACHE:
            self._forget()
        self._learn([*used.difference(self.place)])
        rest = self.measures([t for t, c in zip(texts, cut) if t and c is None], False)
        k = 0
        for text, c in zip(texts, cut):
            good, codes, total = False, np.zeros(0, np.int64), np.zeros(len(COUNTS), np.int64)
            if c:
                own = [*map(self.place.__getitem__, c)]
                at = np.array(own)
                if good := bool(self.whole.all[at].all()):
                    groups = ";".join(map(self.groups.__getitem__, own))
                    total = self.counts.all[at].sum(axis=0, dtype=np.int64)
                    low, high = self.codes_upto.all[at], self.codes_upto.all[at + 1]
                    codes = self.codes.all[np.arange(total[3]) + np.repeat(high - np.cumsum(high - low), high - low)]
            elif text:
                if good := bool(rest[1][k]):
                    groups, total, codes = rest[0][k], rest[2][k], rest[3][rest[4][k] : rest[4][k + 1]]
                k += 1
            yield hashlib.sha256(groups.encode()).hexdigest() if good else "", codes, total


@functools.cache
def pair(bytes_path: str, pieces_path: str) -> Pair:
    """One for each pair of files and worker process."""
    return Pair(bytes_path, pieces_path)


def planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all their lowest bytes first: small ones compress well."""
    return x.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def blocks(docs: DataFrame, bytes_path: str, pieces_path: str, block: int = BLOCK) -> DataFrame:
    """One row for each block: by document its id, digest, counts and number of different pairs; these pairs as steps between places in
    ``codes`` and how often each occurs; and by pair how many of the block's documents hold it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"block long, doc_id array<{kind}>, groups_sha256 array<string>, {', '.join(f'{c} array<long>' for c in COUNTS)}, n_pairs array<long>, steps binary, times binary, codes array<long>, holders array<long>"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number, id_type = pair(bytes_path, pieces_path), 0, None
        ids, digests, counts, held, size = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            doc = np.repeat(np.arange(len(held), dtype=np.int64), [len(x) for x in held])
            key, times = np.unique(doc * both.codes_end + np.concatenate(held), return_counts=True)
            doc, code = key // both.codes_end, key % both.codes_end
            own, place, holders = np.unique(code, return_inverse=True, return_counts=True)
            steps = np.diff(place, prepend=0)
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            steps[starts] = place[starts]
            one = lambda values, of: pa.array([values], pa.list_(of))
            by_count = np.array(counts, np.int64).reshape(-1, len(COUNTS)).T
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()), one(ids, id_type), one(digests, pa.string()), *(one(x, pa.int64()) for x in by_count),
                    one(np.bincount(doc, minlength=len(held)), pa.int64()), pa.array([planes(steps)], pa.binary()), pa.array([planes(times)], pa.binary()), one(own, pa.int64()), one(holders, pa.int64()),
                ],
                names=["block", "doc_id", "groups_sha256", *COUNTS, "n_pairs", "steps", "times", "codes", "holders"],
            )

        for part in few_rows(parts):
            id_type = part.column("doc_id").type
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids += part.column("doc_id").to_pylist()
            for text, (digest, code, total) in zip(texts, both.digest(texts)):
                digests.append(digest)
                held.append(code)
                counts.append(total)
                size += len(text)
            if size >= block:
                yield row()
                number += 1
                ids, digests, counts, held, size = [], [], [], [], 0
        if ids:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def pair_counts(made: DataFrame, span: int) -> DataFrame:
    """code, count (documents that hold the pair), best (no pair of its first id has more)."""
    each = made.select(F.explode(F.arrays_zip("codes", "holders")).alias("x")).select("x.codes", "x.holders")
    total = each.groupBy(F.col("codes").alias("code")).agg(F.sum("holders").alias("count"))
    total = written(total.withColumn("a", F.floor(F.col("code") / span)), "align-counts")
    most = total.groupBy("a").agg(F.max("count").alias("most"))
    return total.join(most, "a").select("code", "count", (F.col("count") == F.col("most")).alias("best"))


def score(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_products."""
    bytes_path, pieces_path = bytes_path or default_tokenizer(), pieces_path or default_pieces()
    made = written(blocks(docs, bytes_path, pieces_path, block), "align-blocks")
    counted = pair_counts(made, pair(bytes_path, pieces_path).span)
    wanted = made.select(F.col("block").alias("of"), F.posexplode("codes").alias("place", "code")).join(counted, "code").select("of", "place", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_products long"

    def answer(own: pa.Table, counts: pa.Table) -> pa.Table:
        get = lambda c: own.column(c).combine_chunks().flatten()
        place = counts.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place] = counts.column("count").to_numpy()
        best[place] = counts.column("best").to_numpy(zero_copy_only=False)
        n_pairs, steps, times = get("n_pairs").to_numpy(), from_planes(own.column("steps")[0].as_py()), from_planes(own.column("times")[0].as_py())
        doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
        at, run = np.cumsum(n_pairs) - n_pairs, np.cumsum(steps)
        some = n_pairs > 0
        at = run - np.repeat((run[at[some]] - steps[at[some]]), n_pairs[some])
        total = lambda x: np.bincount(doc, weights=x, minlength=len(n_pairs)).round().astype(np.int64) if x.sum() < 1 << 52 else summed(doc, x, len(n_pairs))
        columns = {c: get(c) for c in ("doc_id", "groups_sha256", *COUNTS)}
        columns |= {"n_best": total(times * best[at]), "count_sum": total(times * count[at])}
        return pa.table({c.split()[0]: columns[c.split()[0]] for c in ddl.split(", ")})

    return made.drop("codes", "holders").groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(answer, ddl)


def summed(group: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums by group in whole numbers."""
    out = np.zeros(n, np.int64)
    np.add.at(out, group, x)
    return out


def groups(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """The alignment itself: doc_id, group (from 0), start, end (bytes of the space and the text), a_ids, b_ids."""
    paths = bytes_path or default_tokenizer(), pieces_path or default_pieces()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*paths)
        for part in few_rows(parts, 64):
            texts = [t or "" for t in part.column("text").to_pylist()]
            keep = [k for k, t in enumerate(texts) if t]
            x = both.align([texts[k] for k in keep], False)
            per_text = np.diff(x.upto["groups"])
            of = np.repeat(np.arange(len(keep)), per_text)
            end = x.ends[x.closes]
            start = np.concatenate([[0], end[:-1]]) if len(end) else end
            begin = np.concatenate([[0], end])[x.upto["groups"][:-1]] if len(keep) else end
            lists = lambda ids, to: pa.ListArray.from_arrays(np.concatenate([[0], to + 1]).astype(np.int32), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(np.array(keep, np.int64)[of])), pa.array(np.arange(len(of)) - x.upto["groups"][of]), pa.array(start - begin[of]), pa.array(end - begin[of]),
                    lists(x.ids_a, x.a[x.closes]), lists(x.ids_b, x.b[x.closes]),
                ],
                names=["doc_id", "group", "start", "end", "a_ids", "b_ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, group long, start long, end long, a_ids array<long>, b_ids array<long>")


def products(grouped: DataFrame) -> DataFrame:
    """Rows of ``groups`` expanded: every first id of a group with every second one."""
    return grouped.select("*", F.explode("a_ids").alias("a_id")).select("doc_id", "group", "start", "end", "a_id", F.explode("b_ids").alias("b_id"))
