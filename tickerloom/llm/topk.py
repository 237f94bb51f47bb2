"""Exact top-k by inner product: dual-tree search over cover trees.

The data are dealt into cells around pivots (a bounded sample of the rows, picked
by a hash of the id; every row is indexed), and a cell with many rows into several
blocks, so a block's size is bounded even if a third of all rows are equal. Queries are dealt
alike, into teams. Cells are the upper nodes of both trees; within a task a block and a team
become cover trees: each level halves the cover radius, children keep their distance, every point
lies under the nearest child. All pairs of nodes of a level are looked at together, and pairs of leaves best bound first; with centres c and p, radii r
and s, no pair below scores more than c.p + s|c| + r|p| + r s, and a pair whose bound
is under the worst kth score of the query node's group is pruned: pairs of teams and cells before any
row moves, and pairs below them within tasks. A first pass searches each query's own block, so that every
team has a worst kth score; a second brings teams to all other blocks that their bound reaches. Teams that
ask for the same block come ``BUNDLE`` at a time, so a block travels once for so many.

Defined results: null and empty vectors, null ids and vectors with null or non-finite
components take no part; vectors are compared with those of their own length only;
ties go to the smaller id; equal rows are rows of their own, and a query skips rows
with its own id; query rows that share an id answer together, with the best of all their scores;
with fewer candidates than k all are returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickerloom.llm.common import hash_share, written

#: Rows of a block and of a query team, about; teams that come to a block together; pivots at most; points of a tree's leaf.
BLOCK, GROUP, BUNDLE, PIVOTS, LEAF = 4096, 2048, 8, 1024, 64
#: Children of a node at most; data points that a query leaf meets between two looks at its worst kth score; pairs of bundles and blocks
#: of a task; queries of a leaf.
FAN, STEP, PAIRS, QUERIES = 8, 1024, 16, 8


class CoverTree:
    """Nodes in arrays: centre, covering radius, children. Points are put in the leaves' order (``order``), so that those
    below node i are ``start[i]`` to ``end[i]``."""

    def __init__(self, x: np.ndarray, leaf: int | None = None) -> None:
        self.x, centre, radius, self.children, start, end, self._leaves = x, [], [], [], [], [], []
        self._lists, self._size, self._most = (centre, radius, start, end), 0, leaf or LEAF
        if len(x):
            self._node(np.arange(len(x)), 0)
        self.order = np.concatenate([np.zeros(0, np.int64), *self._leaves])
        self.centre, self.start, self.end = (np.array(c, np.int64) for c in (centre, start, end))
        self.radius = np.array(radius, float)
        n = np.array([len(c) for c in self.children], np.int64)
        self.n_children, self.first_child = n, np.cumsum(n) - n
        self.child = np.array([c for own in self.children for c in own], np.int64)
        self.leaves = np.flatnonzero(n == 0)

    def _node(self, members: np.ndarray, head: int) -> int:
        centre, radius, start, end = self._lists
        d = np.sqrt(np.maximum(((self.x[members] - self.x[head]) ** 2).sum(1), 0))
        at = len(centre)
        centre.append(head)
        radius.append(float(d.max()))
        start.append(self._size)
        end.append(self._size + len(members))
        self.children.append([])
        heads, near, owner = [head], d.copy(), np.zeros(len(members), np.int64)
        if len(members) > self._most:
            while near.max() > radius[at] / 2 and len(heads) < FAN:
                heads.append(int(members[near.argmax()]))
                e = np.sqrt(((self.x[members] - self.x[heads[-1]]) ** 2).sum(1))
                owner[e < near] = len(heads) - 1
                near = np.minimum(near, e)
        if len(heads) == 1:
            self._leaves.append(members)
            self._size += len(members)
        else:
            self.children[at] = [self._node(members[owner == k], h) for k, h in enumerate(heads)]
        return at

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes, and for each the place of its parent in ``nodes``; a leaf stands for itself."""
        n = self.n_children[nodes]
        parent = np.repeat(np.arange(len(nodes)), np.maximum(n, 1))
        nth = np.arange(len(parent)) - np.repeat(np.cumsum(np.maximum(n, 1)) - np.maximum(n, 1), np.maximum(n, 1))
        inner = (n > 0)[parent]
        out = nodes[parent]
        out[inner] = self.child[self.first_child[nodes[parent[inner]]] + nth[inner]]
        return out, parent


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(q, v)) for v in b] for q in a], object).clip(-(2**63), 2**63 - 1).astype(np.int64)


class _Best:
    """The k best (score, id) of each query so far; ``met`` counts the pairs whose product was taken."""

    def __init__(self, k: int, worst: np.ndarray) -> None:
        self.k, self.worst, self.met = k, worst, 0
        self.n = np.zeros(len(worst), np.int64)
        self.score, self.id = np.zeros((2, len(worst), k), np.int64)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """A row of ``scores`` for each of ``queries``, which differ; those that aren't ``allowed`` don't count."""
        self.met += scores.size
        use = allowed & (scores >= self.worst[queries][:, None])
        if scores.shape[1] > 4 * self.k:  # only what reaches the row's own kth score
            least = np.partition(np.where(use, scores, np.iinfo(np.int64).min), -self.k, axis=1)[:, -self.k]
            use &= scores >= least[:, None]
        row, col = np.nonzero(use)
        if not len(row):
            return
        old, nth = np.nonzero(np.arange(self.k) < self.n[queries][:, None])
        row = np.concatenate([old, row])
        score = np.concatenate([self.score[queries[old], nth], scores[use]])
        vec = np.concatenate([self.id[queries[old], nth], ids[col]])
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        n = np.bincount(row, minlength=len(queries))
        place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        top = place < self.k
        self.score[queries[row[top]], place[top]], self.id[queries[row[top]], place[top]] = score[top], vec[top]
        self.n[queries] = np.minimum(n, self.k)
        full = queries[n >= self.k]
        self.worst[full] = np.maximum(self.worst[full], self.score[full, self.k - 1])


def top_bound(q: np.ndarray, q_radius: np.ndarray, p: np.ndarray, p_radius: np.ndarray) -> np.ndarray:
    """For centres of queries and of data, and the radii around them, the greatest score that any pair below may have."""
    bound = q @ p.T + q_radius[:, None] * np.linalg.norm(p, axis=1) + np.linalg.norm(q, axis=1)[:, None] * p_radius + q_radius[:, None] * p_radius
    return bound + 1e-9 * np.abs(bound) + 1e-6


def dual_search(queries: np.ndarray, query_ids: np.ndarray, tree: CoverTree, data_ids: np.ndarray, k: int, worst: np.ndarray) -> _Best:
    """The best of the tree's points for each query, above what it has already (``worst``). Both trees are gone down together,
    all pairs of nodes of a level at once; the pairs of leaves that are left are taken by query leaf, best bound first, until a
    bound is under the leaf's worst kth score."""
    best = _Best(k, worst.astype(float).copy())
    if not len(queries) or not len(tree.x):
        return best
    qt, dt = CoverTree(queries, QUERIES), tree
    bound = top_bound(queries[qt.centre], qt.radius, dt.x[dt.centre], dt.radius)

    def meet(leaf: int, others: np.ndarray) -> None:
        qs = qt.order[qt.start[leaf] : qt.end[leaf]]
        ds = np.concatenate([dt.order[dt.start[d] : dt.end[d]] for d in others.tolist()])
        best.add(qs, _products(queries[qs], dt.x[ds]), data_ids[ds], query_ids[qs][:, None] != data_ids[ds])

    nearest = dt.leaves[bound[np.ix_(qt.leaves, dt.leaves)].argmax(1)]
    for leaf, d in zip(qt.leaves.tolist(), nearest.tolist()):  # so that every group has a worst kth score early
        if bound[leaf, d] >= best.worst[qt.order[qt.start[leaf] : qt.end[leaf]]].min():
            meet(leaf, np.array([d]))
    least = np.array([best.worst[qt.order[a:b]].min() for a, b in zip(qt.start.tolist(), qt.end.tolist())])
    q = d = np.zeros(1, np.int64)  # pairs of nodes, from both roots down
    while True:
        live = bound[q, d] >= least[q]
        q, d = q[live], d[live]
        if not (qt.n_children[q].any() or dt.n_children[d].any()):
            break
        q, parent = qt.below(q)
        d, parent = dt.below(d[parent])
        q = q[parent]
    home = np.full(len(qt.radius), -1)
    home[qt.leaves] = nearest
    q, d = q[home[q] != d], d[home[q] != d]
    order = np.lexsort((-bound[q, d], q))
    q, d = q[order], d[order]
    cuts = np.flatnonzero(np.diff(q, prepend=-1, append=-1)).tolist() if len(q) else []
    for a, b in zip(cuts, cuts[1:]):
        leaf, asked = int(q[a]), d[a:b]
        bounds, size = bound[leaf, asked], np.cumsum(dt.end[asked] - dt.start[asked])
        qs, at = qt.order[qt.start[leaf] : qt.end[leaf]], 0
        while at < len(asked) and bounds[at] >= best.worst[qs].min():
            reach = np.searchsorted(-bounds, -best.worst[qs].min(), side="right")
            end = min(int(reach), max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP, side="right"))))
            meet(leaf, asked[at:end])
            at = end
    return best


_RESULT = pa.schema([(c, pa.int64()) for c in ("row", "query_id", "vec_id", "score")])


def _rows(best: list[tuple[np.ndarray, np.ndarray, _Best]]) -> pa.Table:
    """Searches' results; each has its queries' rows and ids."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    for rows, ids, found in best:
        has = np.arange(found.k) < found.n[:, None]
        for column, values in zip(out, (np.repeat(rows, found.n), np.repeat(ids, found.n), found.id[has], found.score[has])):
            column.append(values)
    return pa.Table.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], schema=_RESULT)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as a matrix."""
    flat = pa.concat_arrays(column.chunks).flatten().to_numpy() if column.num_chunks else np.zeros(0)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> query_id, rank, vec_id, score. ``is_query``: a condition on vec_id."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = written(
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0)).select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("is_query"),
        ),
        "topk-vectors",
    )
    n = v.count()
    wanted = max(1, min(PIVOTS, n // BLOCK))
    sample = v.where(hash_share(4 * wanted / max(n, 1), "row", "vec_id")).select("v").limit(8 * wanted).collect()
    pivots: dict[int, np.ndarray] = {}
    for r in sample or v.select("v").limit(1).collect():
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {dim: np.unique(np.array(p), axis=0)[:wanted] for dim, p in pivots.items()}
    sent = spark.sparkContext.broadcast(pivots)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's nearest pivot and the way to it; a length without pivots has one cell around the origin."""
        for part in parts:
            own = part.column("v")
            flat, start = own.flatten().to_numpy(), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
            size, cells, away = np.diff(start), np.empty(len(own), object), np.zeros(len(own))
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                x = flat[start[at][:, None] + np.arange(dim)]
                p = sent.value.get(dim, np.zeros((1, dim)))
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1), 0))
                cells[at] = [f"{dim}:{c}" for c in d.argmin(1).tolist()]
                away[at] = np.sqrt(((x - p[d.argmin(1)]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.string()), pa.array(away, pa.float64())], names=["row", "vec_id", "v", "is_query", "cell", "away"])

    dealt = written(v.mapInArrow(deal, "row long, vec_id long, v array<double>, is_query boolean, cell string, away double"), "topk-dealt")
    parts = F.ceil(F.col("cell_rows") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("cell_queries") / GROUP).cast("int").alias("teams")
    counts = dealt.groupBy("cell").agg(F.count("*").alias("cell_rows"), F.count_if("is_query").alias("cell_queries"), F.max("away").alias("radius"))
    known = {r["cell"]: r for r in counts.select("cell", "radius", *parts).collect()}  # at most PIVOTS cells of each vector length
    table = spark.createDataFrame([(c, r["blocks"], max(r["teams"], 1)) for c, r in known.items()], "cell string, blocks int, teams int")
    lot = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("string")
    placed = written(
        dealt.join(F.broadcast(table), "cell").select("row", "vec_id", "v", "is_query", "away", F.concat_ws("/", "cell", lot("blocks", 0)).alias("block"), F.when(F.col("is_query"), F.concat_ws("/", "cell", lot("teams", 1))).alias("team")),
        "topk-placed",
    )

    def own_block(key, table):
        table = table.sort_by("row")
        x, ids, rows = _vectors(table.column("v")), table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        mine = np.flatnonzero(table.column("is_query").to_numpy(zero_copy_only=False))
        if not len(mine):
            return _rows([])
        return _rows([(rows[mine], ids[mine], dual_search(x[mine], ids[mine], CoverTree(x), ids, k, np.full(len(mine), -np.inf)))])

    result = "row long, query_id long, vec_id long, score long"
    first = written(placed.groupBy("block").applyInArrow(own_block, result), "topk-first")
    kth = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    queries = written(placed.where("is_query").join(kth, "row", "left").select("row", "vec_id", "v", "block", "team", "away", "kth"), "topk-queries")
    teams = queries.groupBy("team").agg(F.max("away").alias("radius"), F.min(F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf")))).alias("worst"))
    info: dict[int, list] = {}
    for cell, r in sorted(known.items()):
        info.setdefault(int(cell.split(":")[0]), []).append((int(cell.split(":")[1]), r["blocks"], r["radius"]))
    cells = spark.sparkContext.broadcast(info)

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of the cells whose bound with a team reaches the team's worst kth score."""
        for part in parts:
            team, blocks, bundles = [], [], []
            for name, radius, worst in zip(*(c.to_pylist() for c in part.columns)):
                dim, own = map(int, name.split("/")[0].split(":"))
                p, numbers = sent.value.get(dim, np.zeros((1, dim))), cells.value[dim]
                at = np.array([c for c, _, _ in numbers])
                bound = top_bound(p[[own]], np.array([radius]), p[at], np.array([r for _, _, r in numbers]))[0]
                asked = [f"{dim}:{c}/{i}" for (c, n, _), b in zip(numbers, bound) if b >= worst for i in range(n)]
                team += [name] * len(asked)
                blocks += asked
                bundles += [zlib.crc32(name.encode())] * len(asked)
            yield pa.RecordBatch.from_arrays([pa.array(team, pa.string()), pa.array(blocks, pa.string()), pa.array(bundles, pa.int64())], names=["team", "block", "lot"])

    n_bundles = max(1, -(-sum(r["teams"] for r in known.values()) // BUNDLE))
    asked = teams.select("team", "radius", "worst").mapInArrow(ask, "team string, block string, lot long")
    asked = written(asked.select("team", F.col("block").alias("to"), F.pmod("lot", F.lit(n_bundles)).cast("int").alias("bundle")), "topk-asked")
    meets = written(asked.select("to", "bundle").distinct(), "topk-meets")
    pairs = meets.count()
    tasks = max(1, min(pairs, int(spark.conf.get("spark.sql.shuffle.partitions")) + pairs // PAIRS))
    left = queries.join(asked, "team").where("block <> to").select("to", "bundle", "team", "row", "vec_id", "v", "kth").repartition(tasks, "to", "bundle")
    right = placed.join(meets, F.col("block") == F.col("to")).select("to", "bundle", "row", "vec_id", "v").repartition(tasks, "to", "bundle")

    def others(key, left, right):
        if not left.num_rows or not right.num_rows:
            return _rows([])
        right = right.sort_by("row")
        tree, ids, found = CoverTree(_vectors(right.column("v"))), right.column("vec_id").to_numpy(), []
        for team in sorted(set(left.column("team").to_pylist())):
            own = left.filter(pc.equal(left.column("team"), team)).sort_by("row")
            rows, qids = own.column("row").to_numpy(), own.column("vec_id").to_numpy()
            worst = np.array([-np.inf if x is None else x for x in own.column("kth").to_pylist()])
            found.append((rows, qids, dual_search(_vectors(own.column("v")), qids, tree, ids, k, worst)))
        return _rows(found)

    second = left.groupBy("to", "bundle").cogroup(right.groupBy("to", "bundle")).applyInArrow(others, result)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
