"""N-gram Jaccard join with a prefix tree, and the components of its links.

A document's set is its distinct word n-grams, as 64-bit hashes of word hashes, in one
global order: light n-grams by hash, then heavy ones by hash. Heavy are the buckets of
hashed counts over all documents that stand far above the mean, so what many documents
share comes last.

1. ``heavy_buckets``: one pass over the texts adds up hashed counts.
2. ``signed``: a second pass gives each row its set's size, a 128-bit name of the set, a
   min-hash sketch, and the n-grams by which it can meet partners (``Meeting``). Rows
   with equal sets are one *class* from here on.
3. ``areas``: classes whose sketches agree choose a hub, the one with the fewest light
   n-grams, and learn how they differ from it. Hub and class may be linked at once.
   Two classes x, y around a hub differ by what one of dx, dy has alone, so
   |x ^ y| = |dx| + |dy| - 2 |dx & dy|: pairs of which at least one isn't linked to the
   hub must share differences, and are found by a prefix of them, rare ones first.
   Classes are compared with their hub, and differences with each other, in the prefix tree of step 5.
4. ``meetings``: classes of different areas that share enough of their n-grams of step 2
   are compared.
5. ``verify``: comparisons of sets run in the prefix tree: the partner sets of one probe
   are stored in order, shared beginnings once; a walk carries partial overlaps down
   the tree and drops a subtree as soon as the overlap plus what remains of either
   set can't reach the least overlap.
6. ``components``: labels of the least id spread over the links.

Defined results: null and wordless texts have size 0, no links and their own id as
component; shorter texts are one n-gram, their whole word sequence; rows with equal
ids are rows of their own, null ids never name a component unless all its ids are
null; a text of any length is read whole, in slices of about ``SLICE`` bytes; an empty table
gives no rows; extra columns, whatever their names, are ignored by ``join`` and kept by
``one_of_each``.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tickerloom.llm.common import add_sketches, bytes_of, cut_sketch, few_rows, free_names, written

#: Buckets and slices of the hashed counts; also buckets of marks.
BUCKETS, SLICES = 1 << 20, 16
#: Sketch: values, bands of values that must agree to suggest a hub, and values that must agree then.
SKETCH, BANDS, AGREE = 16, 8, 6
#: N-grams of lowest hash that a set looks at, shared ones that a pair must show, and the
#: probability that a linked pair shows fewer (that of two n-grams' hashes being equal is 5e-20 a pair).
LOWEST, NEED, MISS = 64, 4, 1e-15
#: Hashes that a task holds before it counts them.
HELD = 1_000_000
#: Least similarity to its hub at which a class keeps its differences.
AROUND = (3, 10)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_SALT = (np.arange(1, SKETCH + 1, dtype=np.uint64) * _MULT[1]) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULT[3]
    return h ^ (h >> np.uint64(29))


#: Word hashes: a number for each byte, and the base whose powers place it. Texts come in slices of about SLICE bytes.
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([c]), digest_size=8).digest(), "little") for c in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C17
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_SEPARATOR = re.compile(rb"[ \t\n\x0b\x0c\r]")
SLICE = 1 << 20


class Shingler:
    """Sorted distinct n-gram hashes of texts. A word's hash is a polynomial in its bytes, modulo 2**64, taken
    for all words at once from running sums over the text."""

    def __init__(self, n: int) -> None:
        self.n, self.up, self.down = n, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = np.full(max(n, 1 << 13) + 1, _BASE, np.uint64)
            size[0] = 1
            self.up = np.multiply.accumulate(size)
            size[1:] = _BASE_INVERSE
            self.down = np.multiply.accumulate(size)

    def _words(self, text: bytes) -> np.ndarray:
        code = np.frombuffer(text.lower(), np.uint8)
        self._powers(len(code))
        inside = np.zeros(len(code) + 2, bool)
        inside[1:-1] = ~_SPACE[code]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(_BYTE[code] * self.up[: len(code)], out=sums[1:])
        return _mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _MULT[1])

    def words(self, text: bytes) -> np.ndarray:
        found, at = [], 0
        while len(text) - at > 2 * SLICE:
            cut = _SEPARATOR.search(text, at + SLICE)
            if cut is None:
                break
            found.append(self._words(text[at : cut.start()]))
            at = cut.start()
        found.append(self._words(text[at:]))
        return found[0] if len(found) == 1 else np.concatenate(found)

    def hashes(self, text: bytes) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return h
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mixed(out * _MULT[0] + h[k : len(h) - n + 1 + k] * _MULT[2])
        return np.unique(out)


def sketch_of(h: np.ndarray) -> np.ndarray:
    """Least values of a set's hashes under fixed multipliers."""
    blocks = [(h[at : at + 65536] * _SALT[:, None] >> np.uint64(34)).min(1) for at in range(0, len(h), 65536)]
    return functools.reduce(np.minimum, blocks).astype(np.int32)


def least_overlap(a: int, b: int, num: int, den: int) -> int:
    """den * overlap >= num * union."""
    return -(-num * (a + b) // (den + num))


#: A set of n members must share 1 + n // SHARED of its prefix's members with a partner.
SHARED = 40


def prefix_length(n: int, num: int, den: int) -> int:
    """A partner shares at least ceil(n * num / den) members, so 1 + n // SHARED of these first ones.

    Both sets' prefixes hold the first of their common members, as many as the smaller of the two
    numbers says.
    """
    return n - -(-n * num // den) + 1 + n // SHARED


class Meeting:
    """The n-grams by which a set meets its partners, and how many of them a pair must share.

    Among the m lowest hashes of a linked pair's union, each lies outside the intersection with a
    probability of at most 1 - num / den, whatever the texts are. A set whose m lowest hashes have so
    many light n-grams that all but ``NEED - 1`` of them lie outside with a probability below
    ``MISS`` alone needs no others; the smallest such m will do. Any other set gives its exact prefix
    in the global order, and all light n-grams among its ``LOWEST`` lowest, for partners of the first kind.
    With ``exact``, every set gives its exact prefix, and no pair is left to a probability.
    """

    def __init__(self, num: int, den: int, exact: bool = False) -> None:
        self.num, self.den, out = num, den, 1 - num / den
        self.enough = np.full(LOWEST + 1, LOWEST + NEED)
        for m in range(1, 1 if exact else LOWEST + 1):
            tail = 0.0
            for k in range(m, -1, -1):
                tail += math.comb(m, k) * out**k * (1 - out) ** (m - k)
                if tail > MISS:
                    break
                self.enough[m] = k + NEED - 1

    def of(self, h: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, int]:
        low, light = h[:LOWEST], ~heavy[:LOWEST]
        good = np.flatnonzero(np.cumsum(light) >= self.enough[1 : len(low) + 1])
        if len(good):
            return low[: good[0] + 1][light[: good[0] + 1]], NEED
        first = np.concatenate([h[~heavy], h[heavy]])[: prefix_length(len(h), self.num, self.den)]
        return np.unique(np.concatenate([first, low[light]])), 1 + len(h) // SHARED


class PrefixTree:
    """Sets in the global order (here by hash), equal beginnings stored once.

    Sets are kept sorted; ``shared[i]`` is how far set i begins like set i - 1, so the tree's path to a
    set is the previous one's up to there, and its counts are reused from the walk's stack.
    """

    STEP = 32

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0] * len(sets)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared[i] = int(differ[0]) if len(differ) else m

    def walk(self, probe: np.ndarray, needs: list[int]) -> Iterator[tuple[int, np.ndarray | None]]:
        """Each set's number and its overlaps with the probe (of its first 0, 1, ... members), or None where it can't reach its need."""
        counts, done = np.zeros(1, np.int64), 0
        for i, own in enumerate(self.sets):
            n, need = len(own), needs[self.order[i]]
            done = min(done, self.shared[i])
            row = np.empty(n + 1, np.int64)
            row[: done + 1] = counts[: done + 1]
            alive = min(n, len(probe)) >= need
            while alive and done < n:
                end = min(n, done + self.STEP)
                place = np.searchsorted(probe, own[done:end])
                hit = probe[np.minimum(place, len(probe) - 1)] == own[done:end]
                row[done + 1 : end + 1] = row[done] + np.cumsum(hit)
                passed = int(place[-1]) + int(hit[-1])
                done = end
                alive = row[done] + min(n - done, len(probe) - passed) >= need
            counts = row
            yield self.order[i], row if alive and row[n] >= need else None

    def overlaps(self, probe: np.ndarray, num: int, den: int) -> list[int]:
        """Overlap of each set with the probe, or -1 where it can't reach the least overlap."""
        return self.reaching(probe, [least_overlap(n, len(probe), num, den) for n in self.sizes()])

    def reaching(self, probe: np.ndarray, needs: list[int]) -> list[int]:
        out = [-1] * len(self.sets)
        for k, row in self.walk(probe, needs):
            if row is not None:
                out[k] = int(row[-1])
        return out

    def sizes(self) -> list[int]:
        out = [0] * len(self.sets)
        for k, own in zip(self.order, self.sets):
            out[k] = len(own)
        return out

    def differences(self, probe: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Number, overlap, what the set has beside the probe and what it lacks, of the sets that reach the least overlap."""
        needs, own_of = [least_overlap(n, len(probe), num, den) for n in self.sizes()], dict(zip(self.order, self.sets))
        for k, row in self.walk(probe, needs):
            if row is not None:
                hit = np.diff(row) > 0
                lacks = np.ones(len(probe), bool)
                lacks[np.searchsorted(probe, own_of[k][hit])] = False
                yield k, int(row[-1]), own_of[k][~hit], probe[lacks]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h * _MULT[0] >> np.uint64(44)).astype(np.int64)


class _Once:
    """True for a name that a task hasn't met lately; bounded."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()

    def __call__(self, name: bytes) -> bool:
        if name in self.seen:
            return False
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen.add(name)
        return True


def heavy_buckets(docs: DataFrame, n: int) -> np.ndarray:
    """Buckets whose count stands five deviations and 2 above the mean; a vector of fixed size."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, shingler, once, held = np.zeros(BUCKETS, np.int32), Shingler(n), _Once(), []

        def add() -> None:
            if held:
                np.add(acc, np.bincount(_bucket(np.concatenate(held)), minlength=BUCKETS), out=acc, casting="unsafe")
                held.clear()

        size = 0
        for part in few_rows(parts):
            for text in bytes_of(part.column("text")):
                if text and once(hashlib.blake2b(text, digest_size=16).digest()):
                    held.append(shingler.hashes(text))
                    size += len(held[-1])
                    if size > HELD:
                        add()
                        size = 0
        add()
        r = cut_sketch(acc, SLICES, TaskContext.get().partitionId())
        yield pa.RecordBatch.from_pydict({"slice": pa.array(r["slice"], pa.int32()), "part": pa.array(r["part"], pa.int32()), "counts": pa.array(r["counts"], pa.binary())})

    total, width = np.zeros(BUCKETS, np.int64), BUCKETS // SLICES
    sums = add_sketches(docs.select("text").mapInArrow(count, "slice int, part int, counts binary"), "int32", "int64")
    for r in sums.collect():
        total[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    mean = total.mean()
    return total > mean + 5 * math.sqrt(mean) + 2


def set_name(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def signed(docs: DataFrame, heavy: np.ndarray, n: int, num: int, den: int, exact: bool = False) -> DataFrame:
    """``docs`` (doc_id, mark, text) -> doc_id, mark, size, sid (name of the set; null if empty), and where a task meets a set for the first
    time: light (share of light n-grams), sketch, grams, need."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, once, meeting = Shingler(n), _Once(), Meeting(num, den, exact)
        for part in few_rows(parts):
            size, sid, light, sketch, grams, need = [], [], [], [], [], []
            for text in bytes_of(part.column("text")):
                h = shingler.hashes(text)
                size.append(len(h))
                sid.append(set_name(h))
                if sid[-1] is None or not once(sid[-1]):
                    for column in (light, sketch, grams, need):
                        column.append(None)
                    continue
                marked = sent.value[_bucket(h)]
                own, least = meeting.of(h, marked)
                light.append(1 - float(marked.mean()))
                sketch.append(sketch_of(h))
                grams.append(own.view(np.int64))
                need.append(least)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("mark"), pa.array(size, pa.int64()), pa.array(sid, pa.binary()), pa.array(light, pa.float64()), pa.array(sketch, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.int64())), pa.array(need, pa.int64())],
                names=["doc_id", "mark", "size", "sid", "light", "sketch", "grams", "need"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, mark long, size long, sid binary, light double, sketch array<int>, grams array<long>, need long")


def text_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, text of the wanted classes, once each; ``docs``: mark, text; ``wanted``: sid, mark of one row, and ``again``,
    whether other rows have the mark. Rows of equal id and text have one mark, so neither a frequent id nor a frequent text
    meets itself."""
    w = written(wanted, "jaccard-wanted")
    bucket = F.pmod("mark", F.lit(BUCKETS))
    # at most BUCKETS numbers, so they can be broadcast; most texts that aren't wanted then don't move
    some = w.select(bucket.alias("bucket")).distinct()
    near = docs.where(F.col("text").isNotNull()).join(F.broadcast(some), bucket == F.col("bucket"), "left_semi")
    found = written(near.join(w, "mark").select("sid", "again", F.col("text").cast("binary").alias("text")), "jaccard-texts")
    return found.where(~F.col("again")).select("sid", "text").union(found.where("again").groupBy("sid").agg(F.any_value("text").alias("text")))


def sets_of(shingler: Shingler, names: list[bytes], texts: pa.Array) -> list[np.ndarray | None]:
    """The sets of texts; None where the text isn't one of the named class. Equal neighbours are done once."""
    out: list[np.ndarray | None] = []
    last: tuple = (None, None, None)
    for name, text in zip(names, texts.to_pylist()):
        if (name, text) != last[:2]:
            h = shingler.hashes(text)
            last = (name, text, h if hashlib.blake2b(h.tobytes(), digest_size=16).digest() == name else None)
        out.append(last[2])
    return out


def verify(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """a, b -> the linked ones among them. Each probe's partners go through a prefix tree."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for part in few_rows(parts):
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            of_a, of_b = sets_of(shingler, a, part.column("of_a")), sets_of(shingler, b, part.column("of_b"))
            by_probe: dict[bytes, list[int]] = {}
            for i, x in enumerate(a):
                if of_a[i] is not None and of_b[i] is not None:
                    by_probe.setdefault(x, []).append(i)
            linked = [False] * len(a)
            for rows in by_probe.values():
                for i, o in zip(rows, PrefixTree([of_b[i] for i in rows]).overlaps(of_a[rows[0]], num, den)):
                    linked[i] = o >= 0
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    first = texts.select(F.col("sid").alias("a"), F.col("text").alias("of_a"))
    second = texts.select(F.col("sid").alias("b"), F.col("text").alias("of_b"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary")


def suggested(classes: DataFrame) -> DataFrame:
    """sid, hub: of the classes that agree with it in a band and in ``AGREE`` values of the sketch, the
    one with the least share of light n-grams; a hub's own hub takes its place."""
    width = SKETCH // BANDS
    bands = F.array(*[F.xxhash64(F.lit(k), *[F.col("sketch")[k * width + j] for j in range(width)]) for k in range(BANDS)])
    rows = classes.select("sid", "sketch", "light", F.explode(bands).alias("band"))
    heads = rows.groupBy("band").agg(F.min(F.struct("light", "sid", "sketch")).alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head")
    same = F.aggregate(F.zip_with("sketch", F.col("head.sketch"), lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    near = rows.join(heads, "band").where((same >= AGREE) & (F.col("sid") != F.col("head.sid")))
    first = written(near.groupBy("sid").agg(F.min(F.struct("head.light", "head.sid")).alias("m")).select("sid", F.col("m.sid").alias("hub")), "jaccard-suggested")
    over = first.select(F.col("sid").alias("hub"), F.col("hub").alias("above"))
    return first.join(over, "hub", "left").select("sid", F.coalesce("above", "hub").alias("hub")).where("sid <> hub")


def differences(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """sid, hub -> with linked, size, added, gone: what the class has beside its hub, and lacks. Only of
    classes that are ``AROUND`` their hub. The classes of a hub go through one prefix tree for each batch of rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for part in few_rows(parts):
            names, hubs = part.column("sid").to_pylist(), part.column("hub").to_pylist()
            of_sid, of_hub = sets_of(shingler, names, part.column("of_sid")), sets_of(shingler, hubs, part.column("of_hub"))
            rows, by_hub = [], {}
            for i, hub in enumerate(hubs):
                if of_sid[i] is not None and of_hub[i] is not None:
                    by_hub.setdefault(hub, []).append(i)
            for hub, at in by_hub.items():
                c = of_hub[at[0]]
                for k, common, added, gone in PrefixTree([of_sid[i] for i in at]).differences(c, *AROUND):
                    x = of_sid[at[k]]
                    rows.append((names[at[k]], hub, common >= least_overlap(len(x), len(c), num, den), len(x), added.view(np.int64), gone.view(np.int64)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["sid", "hub", "linked", "size", "added", "gone"])

    own = texts.select("sid", F.col("text").alias("of_sid"))
    above = texts.select(F.col("sid").alias("hub"), F.col("text").alias("of_hub"))
    rows = pairs.join(own, "sid").join(above, "hub").select("sid", "hub", "of_sid", "of_hub")
    return rows.mapInArrow(run, "sid binary, hub binary, linked boolean, size long, added array<long>, gone array<long>").dropDuplicates(["sid"])


def links_around_hubs(around: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links between classes around one hub of which at least one isn't linked to it.

    With ``most`` the largest difference of a linked pair of such sizes, dx and dy of a linked pair share
    at least (|dx| + |dy| - most) / 2. For a class that isn't linked to the hub that is at least
    |dx| - most for any partner, and for one that is, at least |dx| / 2 where the partner isn't: so many may be
    left out of what they meet by. Differences are ordered by how many classes around the hub have them, rare
    ones first, so a linked pair's first common one is in both beginnings, and all that is common lies from
    there on in both: the join keeps a match only if what remains of both from its place on could be enough.
    """
    least = lambda a, b: F.ceil(F.lit(num) * (a + b) / F.lit(den + num))
    n_diff = F.size("added") + F.size("gone")
    # the largest partner's difference: its size is at most size * den / num
    most = F.floor(F.col("size") * (den / num - 1) + 1e-9) + 1
    out = F.when(F.col("linked"), F.ceil(n_diff / 2)).otherwise(F.greatest(n_diff - most, F.lit(1)))
    rows = around.select("hub", "sid", "size", "linked", F.concat("added", "gone").alias("diff"), n_diff.alias("n_diff"), (n_diff - out + 1).alias("keep"))
    # a number for a hub and a gram; two that share one only meet more often
    each = rows.select("sid", F.explode(F.transform("diff", lambda x: F.xxhash64("hub", x))).alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("n"))
    ordered = each.join(often, "gram").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("order"))
    first = rows.join(ordered, "sid").select("hub", "sid", "size", "n_diff", "linked", F.posexplode(F.slice("order", 1, F.greatest("keep", F.lit(0)).cast("int"))).alias("at", "one"))
    met = written(first.select("hub", "sid", "size", "n_diff", "linked", F.col("one.gram").alias("gram"), (F.col("n_diff") - F.col("at")).alias("rest")), "jaccard-first-differences")
    side = lambda x: met.select("hub", "gram", *[F.col(c).alias(f"{c}_{x}") for c in ("sid", "size", "n_diff", "linked", "rest")])
    overlap = least(F.col("size_x"), F.col("size_y"))
    need = F.col("n_diff_x") + F.col("n_diff_y") + 2 * overlap - F.col("size_x") - F.col("size_y")  # twice the least overlap of differences
    both = side("x").where("not linked_x").join(side("y"), ["hub", "gram"]).where("(linked_y and sid_x <> sid_y) or (not linked_y and sid_x < sid_y)")
    both = both.where((overlap <= F.least("size_x", "size_y")) & (need <= 2 * F.least("rest_x", "rest_y")))
    open_ = both.withColumn("need", need).groupBy(F.col("sid_x").alias("a"), F.col("sid_y").alias("b")).agg(F.first("need").alias("need"))
    diffs = lambda x: rows.select(F.col("sid").alias(x), F.col("diff").alias(f"diff_{x}"))
    found = written(open_, "jaccard-near-pairs").join(diffs("b"), "b").join(diffs("a"), "a").select("a", "b", "need", "diff_a", "diff_b")
    return found.mapInArrow(_share_differences, "a binary, b binary")


def _share_differences(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, need, diff_a, diff_b -> a, b of those that share half of ``need`` differences. The partners of one probe go through one prefix
    tree for each batch of rows."""
    for part in few_rows(parts):
        a, need, linked = part.column("a").to_pylist(), part.column("need").to_pylist(), np.zeros(part.num_rows, bool)
        sets = lambda c, at: np.sort(part.column(c)[at].values.to_numpy(zero_copy_only=False).view(np.uint64))
        by_probe: dict[bytes, list[int]] = {}
        for i, x in enumerate(a):
            by_probe.setdefault(x, []).append(i)
        for at in by_probe.values():
            found = PrefixTree([sets("diff_b", i) for i in at]).reaching(sets("diff_a", at[0]), [-(-need[i] // 2) for i in at])
            linked[at] = np.array(found) >= 0
        yield part.select(["a", "b"]).filter(pa.array(linked))


def meetings(rows: DataFrame, num: int, den: int) -> DataFrame:
    """a < b: classes of different areas that share as many of their n-grams as linked ones do.
    ``rows``: sid, area (a class's name), size, need, grams.

    N-grams are grouped by numbers made of the names' first seven bytes; all classes of such a
    number come back in the last join.
    """
    number = lambda c: F.conv(F.hex(F.substring(c, 1, 7)), 16, 10).cast("long")
    shared = rows.select(number("sid").alias("node"), number("area").alias("area"), "size", "need", F.explode("grams").alias("gram"))
    split = shared.groupBy("gram").agg(F.min("area").alias("low"), F.max("area").alias("high")).where("low <> high").select("gram")
    met = written(shared.join(written(split, "jaccard-shared"), "gram", "left_semi").distinct(), "jaccard-met")
    side = lambda x: met.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "area", "size", "need")])
    both = side("x").join(side("y"), "gram").where("area_x <> area_y and node_x < node_y")
    both = both.where((F.col("size_x") * den >= F.col("size_y") * num) & (F.col("size_y") * den >= F.col("size_x") * num))
    nodes = both.groupBy("node_x", "node_y").agg(F.count("*").alias("n"), F.min(F.least("need_x", "need_y")).alias("need")).where("n >= need")
    nodes = written(nodes.select(F.col("node_x").alias("low"), F.col("node_y").alias("high")), "jaccard-nodes")
    names = rows.select("sid", number("sid").alias("node"))
    a, b = names.select(F.col("sid").alias("x"), F.col("node").alias("low")), names.select(F.col("sid").alias("y"), F.col("node").alias("high"))
    return nodes.join(a, "low").join(b, "high").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """a, b -> sid, root: the least name that links lead to. Labels spread and jump until none changes."""
    edges = written(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "jaccard-edges")
    label = written(edges.groupBy(F.col("a").alias("sid")).agg(F.min("b").alias("low")).select("sid", F.least("sid", "low").alias("root")), "jaccard-label")
    while True:
        near = edges.join(label.select(F.col("sid").alias("b"), "root"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("root").alias("near"))
        spread = label.join(near, "sid").select("sid", F.least("root", "near").alias("next"), F.col("root").alias("old"))
        up = label.select(F.col("sid").alias("next"), F.col("root").alias("above"))
        new = written(spread.join(up, "next", "left").select("sid", F.least("next", F.coalesce("above", "next")).alias("root"), "old"), "jaccard-label")
        changed = new.where(F.col("root") != F.col("old")).limit(1).count()
        label = new.select("sid", "root")
        if not changed:
            return label


def links_of(docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """a, b: links between classes, enough to connect all that links connect."""
    ids = lambda *columns: functools.reduce(DataFrame.union, [c.toDF("sid") for c in columns]).distinct()
    texts = lambda wanted: text_table(docs, classes.join(wanted, "sid", "left_semi").select("sid", "mark", "again"))
    hubs = written(suggested(classes), "jaccard-hubs")
    near = texts(ids(hubs.select("sid"), hubs.select("hub")))
    around = written(differences(hubs, near, n, num, den), "jaccard-around")
    links = written(around.where("linked").select(F.col("hub").alias("a"), F.col("sid").alias("b")).union(links_around_hubs(around, num, den)), "jaccard-near-links")
    rows = classes.select("sid", "size", "need", "grams").join(around.select("sid", "hub"), "sid", "left").withColumn("area", F.coalesce("hub", "sid"))
    pairs = written(meetings(rows, num, den), "jaccard-pairs")
    far = texts(ids(pairs.select("a"), pairs.select("b")))
    return links.union(written(verify(pairs, far, n, num, den), "jaccard-links"))


def grouped(docs: DataFrame, n: int, num: int, den: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of ``signed``, and sid, doc_id (its least), root of each set."""
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text")
    rows = written(signed(docs, heavy_buckets(docs, n), n, num, den, exact), "jaccard-signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark", "n")).alias("first")
    marks = rows.where(F.col("sid").isNotNull()).groupBy("sid", "doc_id", "mark").agg(F.count("*").alias("n"))
    names = marks.groupBy("sid").agg(least).select("sid", "first.doc_id", "first.mark", (F.col("first.n") > 1).alias("again"))
    full = rows.where(F.col("grams").isNotNull()).select("sid", "size", "light", "sketch", "grams", "need").dropDuplicates(["sid"])
    classes = written(names.join(full, "sid"), "jaccard-classes")
    roots = components(links_of(docs, classes, n, num, den))
    return rows, classes.select("sid", "doc_id").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, exact: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_shingles, component_id. ``exact``: meet by exact prefixes alone."""
    rows, labelled = grouped(docs, n, num, den, exact)
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = labelled.join(least, "root").select("sid", "component_id")
    found = rows.select("doc_id", F.col("size").alias("n_shingles"), "sid").join(by_class, "sid", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def named(docs: DataFrame, n: int, column: str) -> DataFrame:
    """``docs`` with the name of each row's set as ``column``; null if the set is empty."""
    names, at = [*docs.columns, column], docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for part in few_rows(parts):
            sid = pa.array([set_name(shingler.hashes(t)) for t in bytes_of(part.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, sid], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, BinaryType())]))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, exact: bool = False) -> DataFrame:
    """``docs`` with one row of each component: of its rows with the least id (null ids are last), one of
    the least set. Rows without a set (null and wordless texts) stay, and ids may repeat or be null.
    """
    rows, labelled = grouped(docs, n, num, den, exact)
    sid, key, kept_sid, kept_id, twice = free_names(docs, "sid", "key", "kept_sid", "kept_id", "twice")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "sid")).alias("first")
    best = labelled.groupBy("root").agg(first).select(F.col("first.sid").alias(kept_sid), F.col("first.doc_id").alias(kept_id))
    again = rows.where(F.col("sid").isNotNull()).groupBy("sid", "doc_id").agg(F.count("*").alias("n")).where("n > 1").select("sid", "doc_id", F.lit(True).alias(twice))
    same = (F.col(kept_sid) == again["sid"]) & F.col(kept_id).eqNullSafe(again["doc_id"])
    kept = written(best.join(again, same, "left").select(kept_sid, kept_id, F.coalesce(twice, F.lit(False)).alias(twice)), "jaccard-kept")
    # rows without a set get keys that differ, so they don't meet in one task; no name is that long
    lone = F.concat(F.lit("row without a set "), F.monotonically_increasing_id().cast("string")).cast("binary")
    found = named(docs, n, sid).withColumn(key, F.coalesce(sid, lone)).join(kept, F.col(key) == F.col(kept_sid), "left")
    chosen = F.col("doc_id").eqNullSafe(F.col(kept_id))
    single = found.where(F.col(sid).isNull() | (chosen & F.col(kept_sid).isNotNull() & ~F.col(twice))).select(*docs.columns)
    if kept.where(twice).limit(1).count():
        return single.unionByName(found.where(F.col(twice) & chosen).dropDuplicates([sid]).select(*docs.columns))
    return single
