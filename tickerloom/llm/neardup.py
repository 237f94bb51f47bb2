"""Near-duplicate embeddings: sign hashes of random hyperplanes in several tables, exact cosines, connected components.

Equal vectors are one class. Each class has a code in each table: which side of the table's hyperplanes it is on. Classes
that share a code meet in that bucket and their cosines are worked out in doubles from the vectors themselves. A pair counts
in the first table in which its codes agree, so the links of a class are the sum over its buckets and no list of pairs
is needed: a bucket gives one row for each linked class, with its links there and the least class that it leads to.
A bucket with many classes is cut into pieces by a hash of the class; each pair of pieces is a task's group, so that no
group holds more than two pieces. Those least classes are the edges of the components.

Bits grow with the logarithm of the number of classes, so that a bucket of spread-out vectors holds about ``occupancy``; tables
are as many as a pair at the threshold needs to meet with the probability ``recall``. More alike pairs meet more often.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do
vectors of different lengths. Rows with one id are vectors of their own, and a null id is the least of a component only if
it has no other; repeated rows link with one another; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import few_rows, written
from tickerloom.llm.jaccard import components

THRESHOLD, RECALL = 0.9, 0.98
#: Classes of spread-out vectors that share a bucket, about; the least bits of a code.
OCCUPANCY, LEAST_BITS = 2048, 8
#: Classes of a piece of a bucket, about.
PIECE = 4096
#: Rows of cosines that are held at a time.
STRIP = 256


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL, occupancy: int = OCCUPANCY) -> tuple[int, int]:
    """Bits and tables for ``n`` classes."""
    bits = min(31, max(LEAST_BITS, round(math.log2(max(n, 1) / occupancy))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


@functools.lru_cache(maxsize=8)
def hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    """Normals, one column for each bit of each table: the same in every worker."""
    return np.random.default_rng([dim, bits, tables]).standard_normal((dim, bits * tables))


def codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """rows x tables."""
    side = (vectors @ hyperplanes(vectors.shape[1], bits, tables) > 0).reshape(len(vectors), tables, bits)
    return side @ (1 << np.arange(bits, dtype=np.int64))


def scaled(raw: list[bytes], width: int) -> np.ndarray:
    """Doubles with a largest component of size 1: the cosines are the same and squares neither overflow nor vanish."""
    v = np.frombuffer(b"".join(raw), f"<f{width}").reshape(len(raw), -1).astype(np.float64)
    return v / np.abs(v).max(axis=1, keepdims=True)


def width_of(rows: DataFrame) -> int:
    """Bytes of a component as it is stored."""
    return 8 if rows.schema["embedding"].dataType.elementType.simpleString() == "double" else 4


def named(rows: DataFrame) -> DataFrame:
    """vec_id, name (null for a vector that links with nothing), vector (its bytes), dim."""
    ddl, number = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, name binary, vector binary, dim int", np.dtype(f"<f{width_of(rows)}")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts, 4096):
            vectors: list[bytes | None] = []
            for x in part.column("embedding"):
                v = x.values.to_numpy().astype(number) if x.is_valid and len(x.values) and not x.values.null_count else None
                vectors.append((v + number.type(0)).tobytes() if v is not None and np.isfinite(v).all() and v.any() else None)  # -0 becomes 0
            names = [x and blake2b(x, digest_size=16).digest() for x in vectors]
            dims = [x and len(x) // number.itemsize for x in vectors]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(names, pa.binary()), pa.array(vectors, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "name", "vector", "dim"])

    return rows.select("vec_id", "embedding").mapInArrow(run, ddl)


def hashed(classes: DataFrame, width: int, bits: int, tables: int) -> DataFrame:
    """name, n, dim, vector -> the same and codes, by table: worked out once, so that all buckets see the same ones."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in few_rows(parts, 4096):
            dims = part.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                some = part.take(pa.array(np.flatnonzero(dims == dim)))
                own = codes(scaled(some.column("vector").to_pylist(), width), bits, tables)
                lists = pa.ListArray.from_arrays(np.arange(0, own.size + 1, tables, dtype=np.int32), pa.array(own.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=["name", "n", "dim", "vector", "codes"])

    return classes.select("name", "n", "dim", "vector").mapInArrow(run, "name binary, n long, dim int, vector binary, codes array<long>")


BUCKET = ("dim", "table", "code")


def pieces(signed: DataFrame, piece: int = PIECE) -> DataFrame:
    """A row for each class and table, and for each pair of its bucket's pieces (low, high) that its own is part of."""
    each = signed.select("*", F.posexplode("codes").alias("table", "code"))
    large = each.groupBy(*BUCKET).agg(F.count("*").alias("in_bucket")).where(F.col("in_bucket") > piece)
    cut = each.join(large, list(BUCKET), "left").withColumn("pieces", F.ceil(F.coalesce("in_bucket", F.lit(1)) / piece).cast("int"))
    own = cut.withColumn("piece", F.pmod(F.xxhash64("name"), F.col("pieces")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return met.select("name", "n", "vector", "codes", *BUCKET, "piece", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"))


def join_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make ``root`` (the least of each one's component) hold for the links a, b too."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def strips(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``left`` and of ``right`` with a cosine of the threshold or more, a strip of rows at a time."""
    length = np.sqrt((right * right).sum(axis=1))
    for at in range(0, len(left), STRIP):
        own = left[at : at + STRIP]
        i, j = np.nonzero((own @ right.T) / (np.sqrt((own * own).sum(axis=1))[:, None] * length) >= threshold)
        yield i + at, j


def links(met: DataFrame, width: int, threshold: float) -> DataFrame:
    """name, links (vectors), root: a row for each class that has links in a bucket's pair of pieces."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        table, low, high = (key[k].as_py() for k in (1, 3, 4))
        rows = rows.sort_by("name")
        v, n = scaled(rows.column("vector").to_pylist(), width), rows.column("n").to_numpy()
        own = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(v), -1)
        piece = rows.column("piece").to_numpy()
        a = np.flatnonzero(piece == low)
        b = a if low == high else np.flatnonzero(piece == high)
        total, root = np.zeros(len(v), np.int64), np.arange(len(v))
        for i, j in strips(v[a], v[b], threshold):
            i, j = a[i], b[j]
            new = i < j if low == high else np.ones(len(i), bool)
            for t in range(table):  # a pair counts in the first table in which its codes agree
                new &= own[i, t] != own[j, t]
            i, j = i[new], j[new]
            np.add.at(total, i, n[j])
            np.add.at(total, j, n[i])
            join_up(root, i, j)
        linked, names = np.flatnonzero(total), rows.column("name")
        return pa.table({"name": names.take(pa.array(linked)), "links": total[linked], "root": names.take(pa.array(root[linked]))})

    return met.groupBy(*BUCKET, "low", "high").applyInArrow(run, "name binary, links long, root binary")


def dedup(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, occupancy: int = OCCUPANCY, piece: int = PIECE) -> DataFrame:
    """``rows`` (vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    width = width_of(rows)
    named_rows = written(named(rows), "neardup-rows")
    own = named_rows.where(F.col("name").isNotNull())
    classes = own.groupBy("name").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    classes = written(classes, "neardup-classes")
    bits, tables = plan(classes.count(), threshold, recall, occupancy)
    signed = written(hashed(classes, width, bits, tables), "neardup-codes")
    found = written(links(pieces(signed, piece), width, threshold), "neardup-links")
    roots = components(found.where(F.col("name") != F.col("root")).select(F.col("name").alias("a"), F.col("root").alias("b")))
    total = found.groupBy("name").agg(F.sum("links").alias("links"))
    labelled = classes.select("name", "n", "least").join(total, "name", "left").join(roots.withColumnRenamed("sid", "name"), "name", "left")
    labelled = written(labelled.select("name", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "least", F.coalesce("root", "name").alias("root")), "neardup-labelled")
    first = written(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "neardup-first")
    by_name = written(labelled.join(first, "root").select("name", "n_links", "component_id"), "neardup-names")
    alone = named_rows.where(F.col("name").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = own.select("vec_id", "name").join(by_name, "name").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
