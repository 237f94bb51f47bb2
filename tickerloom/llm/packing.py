"""Best-fit packing of token sequences, in tree-merged rounds.

Each document becomes token ids plus one end id; one longer than ``size`` is cut
into pieces of ``size`` tokens of which the first may be shorter. A task packs the
pieces of its partition, longest first, into the open bin with the least room that
fits; bins that are nearly full are final. The underfull ones are items of the next
round: dealt anew into groups of bounded size, fewer each time, until one group has seen
all that are left, or a round joins nothing. Only bin numbers and fills travel between
rounds, never tokens, and the pieces meet their bins' last place once, at the end.

Tokenising goes word by word: before a space that follows a printable ASCII
character or a letter the byte-level pre-tokenizer always cuts, so a word's ids
don't depend on its neighbours, and a bounded per-task cache holds them. It also cuts
between letters, marks and single line ends, so a new word is put together from its
letters' ids and its marks' where those are known. Texts with white space before a space, or with
one of the tokenizer's added tokens, are encoded whole.

Defined results: a null or empty text yields its end id alone; a text of any length is
encoded whole and cut into as many pieces as it needs; repeated
rows are packed once each, and so are rows that share an id or have none; equal lengths go by
place in the partition; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import batches, few_rows, written

SIZE, END_ID = 1024, 2
#: A bin with at most this much room left is final.
SLACK = 3
#: Underfull bins that one task of a later round gets, about.
GROUP = 50_000
#: Words whose ids a task keeps.
CACHE = 250_000

#: Marks that may follow a word's letters: neither letters, digits nor white space.
MARKS = ".,;:!?\"'()[]{}-#*$%&|<>/@+=~^_`\\"
#: A space at the start, or after anything else.
_BEFORE_SPACE = re.compile(r" (?<![!-~\w] )")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose token begins with a space
        self.opens[[i for token, i in vocabulary.items() if token[:1] in ("\u0120", " ")]] = True
        self.words: dict[str, bytes] = {}  # ids of a space and the word
        self.bare: dict[str, bytes] = {}  # ids of letters alone
        self.marks: dict[str, bytes] = {}
        self.line_end = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """In blocks of texts, so that what a block lacks is encoded in few calls."""
        for at in range(0, len(texts), 256):
            yield from self._block(texts[at : at + 256])

    def _spaced(self, words: list[str]) -> None:
        """Many words in one text: it is cut at each id that begins with a space. Where those aren't as many
        as the words, each word is encoded alone."""
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            first = (np.flatnonzero(self.opens[ids]) * 4).tolist()
            if len(first) == len(some):
                data = ids.tobytes()
                self.words.update((w, data[a:b]) for w, a, b in zip(some, first, [*first[1:], len(data)]))
            else:
                self.words.update(zip(some, self._ids([" " + w for w in some])))

    def _learn(self, lacking: set[str]) -> None:
        """Words whose lines are letters with marks behind them are put together; others are encoded."""
        whole, marked, stems, lines = [w for w in lacking if w.isalpha()], [], [], []
        letters, bare, marks = set(), set(), set()
        for w in lacking.difference(whole):
            stem = w.rstrip(MARKS)
            if stem.isalpha():
                marked.append(w)
                stems.append(stem)
                continue
            parts = w.split("\n")
            heads = [x.rstrip(MARKS) for x in parts]
            if all(map(str.isalpha, heads)):
                lines.append(w)
                letters.add(heads[0])
                bare.update(heads[1:])
                marks.update(x[len(h) :] for x, h in zip(parts, heads))
            else:
                whole.append(w)
        letters.update(stems)
        marks.update([w[len(x) :] for w, x in zip(marked, stems)])
        self._spaced([*whole, *letters.difference(self.words, whole)])
        for known, new in ((self.bare, [*bare.difference(self.bare)]), (self.marks, [*marks.difference(self.marks)])):
            known.update(zip(new, self._ids(new)))
        words, mark_ids = self.words, self.marks
        words.update(zip(marked, [words[x] + mark_ids[w[len(x) :]] for w, x in zip(marked, stems)]))
        for w in lines:
            known, ids = words, b""
            for x in w.split("\n"):
                head = x.rstrip(MARKS)
                ids += (self.line_end if known is self.bare else b"") + known[head] + mark_ids[x[len(head) :]]
                known = self.bare
            words[w] = ids

    def _block(self, texts: list[str]) -> list[bytes]:
        cut = [None if _BEFORE_SPACE.search(text) or any(t in text for t in self.added) else text.split(" ") for text in texts]
        firsts = iter(self._ids([c.pop(0) for c in cut if c is not None]))
        used = set().union(*(c for c in cut if c))
        if len(self.words) > CACHE:  # what this block has again stays
            self.words = {w: self.words[w] for w in used.intersection(self.words)}
            self.bare.clear()
            self.marks.clear()
        lacking = used.difference(self.words)
        if "" in lacking:  # of a text that ends with a space
            lacking.remove("")
            self.words[""] = self._ids([" "])[0]
        self._learn(lacking)
        whole = iter(self._ids([t for t, c in zip(texts, cut) if c is None]))
        return [next(whole) if c is None else next(firsts) + b"".join(map(self.words.__getitem__, c)) for c in cut]


@functools.cache
def encoder(path: str, special_as_text: bool) -> WordEncoder:
    """One for each tokenizer file and worker process."""
    return WordEncoder(path, special_as_text)


def best_fit(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its offset there, and the bins' fills: longest items first, each into the
    open bin with the least room that holds it. A bit mask tells which rooms occur."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(fills), size
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += n
        room -= n
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return bin_of, offset, np.array(fills, np.int64)


def cut_pieces(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    first = n % size or size
    yield 0, min(n, first)
    for start in range(first, n, size):
        yield start, size


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, special_as_text: bool = False) -> DataFrame:
    """Tokenise, cut and pack within each partition."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"
    end = np.array([end_id], "<u4").tobytes()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ids, number, start, length, crc = encoder(tokenizer, special_as_text), [], [], [], [], []
        id_type = None
        for part in few_rows(parts, 512):
            id_type = part.column("doc_id").type
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc_id, data in zip(part.column("doc_id").to_pylist(), enc.encode(texts)):
                data += end
                for k, (a, n) in enumerate(cut_pieces(len(data) // 4, size)):
                    ids.append(doc_id)
                    number.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * a : 4 * (a + n)]))
        if not ids:
            return
        b, o, fills = best_fit(np.array(length), size)
        schema = pa.schema([("doc_id", id_type), ("piece", pa.int32()), *((x, pa.int64()) for x in ("start", "length", "ids_crc32", "bin", "offset", "fill"))])
        rows = {"doc_id": ids, "piece": number, "start": start, "length": length, "ids_crc32": crc, "bin": b + (TaskContext.get().partitionId() << 32), "offset": o, "fill": fills[b]}
        for at in range(0, len(ids), 50_000):
            yield batches({k: v[at : at + 50_000] for k, v in rows.items()}, schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def _round(bins: DataFrame, groups: int, size: int, level: int) -> DataFrame:
    """bin, fill -> bin, into, at, fill: one best-fit round within each of ``groups`` groups."""

    def pack(key, table):
        order = np.argsort(table.column("bin").to_numpy())
        own, sizes = table.column("bin").to_numpy()[order], table.column("fill").to_numpy()[order]
        b, o, fills = best_fit(sizes, size)
        return pa.table({"bin": own, "into": b + (level << 56) + (int(key[0].as_py()) << 32), "at": o, "fill": fills[b]})

    dealt = bins.withColumn("deal", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).cast("int"))
    return dealt.groupBy("deal").applyInArrow(pack, "bin long, into long, at long, fill long")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) -> one row for each piece with its sequence and place there.

    Where a text has the string of one of the tokenizer's special tokens, it is that token, as the tokenizer's plain
    call has it, or ordinary text with ``special_as_text``.
    """
    placed = written(pieces(docs, tokenizer or default_tokenizer(), size, end_id, special_as_text), "pack-pieces")
    bins = written(placed.groupBy("bin").agg(F.max("fill").alias("fill")).where(F.col("fill") < size - SLACK), "pack-open")
    place = bins.select("bin", F.col("bin").alias("into"), F.lit(0).cast("long").alias("at"))  # where a bin's items are by now
    level, n = 0, bins.count()
    while n > 1:
        level += 1
        groups = -(-n // GROUP)
        moved = written(_round(bins, groups, size, level), f"pack-round{level}")
        step = moved.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("at").alias("further"))
        place = written(place.join(step, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("at") + F.coalesce("further", F.lit(0))).alias("at")), f"pack-place{level}")
        bins = moved.groupBy(F.col("into").alias("bin")).agg(F.max("fill").alias("fill"))
        kept = bins.count()
        bins = bins.where(F.col("fill") < size - SLACK)
        if groups == 1 or kept == n:
            break
        n = bins.count()
    return placed.join(place, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset")
    )
