"""Embedding near-dedup (operator 6): subspace pigeonhole join.

Two unit vectors of cosine >= `threshold` have a squared distance of at most D = 2 (1 - threshold). Vectors are
rotated to the principal axes of the whole table's second moments, and the axes are dealt into `blocks` low-dimensional
blocks. Block b gets the budget D_b = D x its share of the second moments. The budgets sum to D, so a pair within D
is within D_b in one block at least: nothing is lost.

Each block is range-joined: a grid of cells of width 2 sqrt(D_b) over the block's first `axes` axes. A vector lies in its home
cell and visits, as a guest, the smaller ones of the cells that its radius reaches, so a pair meets in one cell of a block. Cells with
more than TILE rows are cut into tiles and joined tile by tile, which bounds a task's memory. A row carries the vector as
one byte a coordinate with its exact rounding error: distances are compared with that allowance, so that no
pair is lost and few false ones are passed on. A pair that an earlier block finds for certain is not reported again. The union
of the candidates is verified on the exact vectors, which are sent once to each task that has a pair for them.

Equal vectors are one in the search: each further one is paired with the one of the least vec_id
(similarity 1), so the result stays linear in copies.

Defined cases: null or empty vectors, vectors with a null, NaN or infinite element and zero vectors have no partner; vectors of different
length are never partners; rows without vec_id are left out; rows that repeat a vec_id are versions of one vector: it has the best
similarity of its versions and is never its own partner; ties at the threshold count; an empty table gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stage

THRESHOLD, BLOCKS, AXES, TILE = 0.95, 8, 3, 16_000
CELLS = "block int, cell long, guest boolean, v long, code binary"
PAIRS = "vec_a long, vec_b long, similarity double"


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    lengths, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[start[rows][:, None] + np.arange(d)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(v, key, e): searchable vectors and a hash of their elements."""
    e = F.col("embedding").cast("array<float>")
    good = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("v"), e.alias("e")).where(good)
    # -0.0 and 0.0 are equal but hash apart
    return rows.withColumn("e", F.transform("e", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x))).withColumn("key", F.xxhash64("e"))


class Grid:
    """Rotation, blocks and budgets for the vectors of one length."""

    def __init__(self, moments: np.ndarray, threshold: float, blocks: int, axes: int):
        d = len(moments)
        values, vectors = np.linalg.eigh(moments)
        order = np.argsort(-values, kind="stable")
        values = np.maximum(values[order], values.sum() * 1e-9 + 1e-300)
        count = max(1, min(blocks, d // 2))
        deal = [np.arange(b, d, count) for b in range(count)]
        self.rotation = np.ascontiguousarray(vectors[:, order[np.concatenate(deal)]])
        width = [len(x) for x in deal]
        self.end = np.cumsum(width).tolist()
        self.start = (np.cumsum(width) - width).tolist()
        share = np.array([values[x].sum() for x in deal])
        self.budget = 2 * (1 - threshold) * share / share.sum()
        self.axes = [min(axes, w) for w in width]

    def cells(self, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """(block, rows, cells, guest)"""
        for b, (s, n) in enumerate(zip(self.start, self.axes)):
            r = math.sqrt(self.budget[b]) * (1 + 1e-6) + 1e-9
            z = y[:, s : s + n] / (2 * r)
            home = np.floor(z).astype(np.int64)
            low = np.floor(z - 0.5).astype(np.int64)
            here = number(home)
            yield b, np.arange(len(y)), here, False
            for step in itertools.product((0, 1, 2), repeat=n):
                # the radius reaches two cells of an axis, three where the edge is hit
                other = low + np.array(step)
                there = number(other)
                rows = np.flatnonzero((other <= np.floor(z + 0.5)).all(axis=1) & (there < here))
                if len(rows):
                    yield b, rows, there[rows], True


def number(cells: np.ndarray) -> np.ndarray:
    """Cell coordinates as one integer; the radius is at least 1e-9, so an axis has fewer than 2**31 cells."""
    out = np.zeros(len(cells), np.int64)
    for k in range(cells.shape[1]):
        out = out * (1 << (62 // cells.shape[1])) + cells[:, k]
    return out


def second_moments(reps: DataFrame) -> dict[int, np.ndarray]:
    """Mean outer product of all unit vectors, by length; length**2 / 2 sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows, x in by_length(batch.column(0)):
                x = unit(x)
                total[x.shape[1]] = total.get(x.shape[1], 0) + x.T @ x
        for d, m in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(m[i, j])], ["d", "i", "j", "s"])

    table = reps.select("e").mapInArrow(run, "d long, i long, j long, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toArrow()
    d, i, j, s = (table[c].to_numpy() for c in ("d", "i", "j", "s"))
    out = {}
    for n in np.unique(d).tolist():
        m = np.zeros((n, n))
        mine = d == n
        m[i[mine], j[mine]] = m[j[mine], i[mine]] = s[mine]
        out[n] = m / max(np.trace(m), 1e-300)
    return out


def candidates(reps: DataFrame, threshold: float, blocks: int, axes: int) -> DataFrame:
    """(block, cell, x, y, a, b), a < b: pairs that may be within the threshold, and the task that found them."""
    spark = reps.sparkSession
    grids = spark.sparkContext.broadcast({d: Grid(m, threshold, blocks, axes) for d, m in second_moments(reps).items()})
    bound = math.sqrt(2 * (1 - threshold))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, x in by_length(batch.column(1)):
                d = x.shape[1]
                grid = grids.value[d]
                y = unit(x) @ grid.rotation
                scale = (np.abs(y).max(axis=1) / 127).astype(np.float32)
                q = np.rint(y / scale[:, None]).clip(-127, 127).astype(np.int8)
                error = (np.sqrt(((y - q * scale[:, None].astype(np.float64)) ** 2).sum(axis=1)) + 1e-6).astype(np.float32)
                code = np.concatenate([scale[:, None].view(np.uint8), error[:, None].view(np.uint8), q.view(np.uint8)], axis=1)
                for b, who, cell, guest in grid.cells(y):
                    n = len(who)
                    values = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (d + 8)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(code[who]))])
                    # vectors of different length share no cell
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d * 64 + b, np.int32)), pa.array(cell), pa.array(np.full(n, guest)), pa.array(ids[rows[who]]), values], ["block", "cell", "guest", "v", "code"])

    def occupy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                d, grid, held = x.shape[1], grids.value[x.shape[1]], {}
                for b, _, cell, _ in grid.cells(unit(x) @ grid.rotation):
                    held.setdefault(b, []).append(cell)
                for b, lots in held.items():
                    cell, n = np.unique(np.concatenate(lots), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), d * 64 + b, np.int32)), pa.array(cell), pa.array(n)], ["block", "cell", "n"])

    copies = reps.select("v", "e").mapInArrow(encode, CELLS)
    large = reps.select("e").mapInArrow(occupy, "block int, cell long, n long").groupBy("block", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > TILE)
    large = large.select("block", "cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    tiled = copies.join(large, ["block", "cell"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("v", F.lit(5)), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tasks = tiled.select("block", "cell", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "guest", "v", "code")
    tasks = tasks.repartition("block", "cell", "x", "y").sortWithinPartitions("block", "cell", "x", "y")

    def pairs_of(task: tuple, tile: np.ndarray, guest: np.ndarray, v: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        block, _, tx, ty = task
        grid, b = grids.value[block // 64], block % 64
        scale, error = code[:, :4].copy().view(np.float32)[:, 0], code[:, 4:8].copy().view(np.float32)[:, 0]
        x = code[:, 8:].view(np.int8).astype(np.float32) * scale[:, None]
        s, e = grid.start[b], grid.end[b]
        mine = x[:, s:e]
        norm = (mine * mine).sum(axis=1, keepdims=True)
        # one product gives squared distances: (-2 x, |x|**2, 1) . (y, 1, |y|**2)
        here, there = np.hstack([-2 * mine, norm, np.ones_like(norm)]), np.hstack([mine, np.ones_like(norm), norm])
        root = np.sqrt(grid.budget)
        slack = 2 * float(error.max())
        reach, limit = float(root[b]) + slack + 1e-5, np.float32((root[b] + slack) ** 2 + 1e-5)
        # rows in the order of one axis more than the grid's: a stretch of them is near a stretch of the others only
        along = mine[:, min(grid.axes[b], e - s - 1)]

        def near(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            left, right = left[np.argsort(along[left], kind="stable")], right[np.argsort(along[right], kind="stable")]
            other, at = np.ascontiguousarray(there[right].T), along[right]
            for i in range(0, len(left), 128):
                rows = left[i : i + 128]
                x0, x1 = np.searchsorted(at, along[rows[0]] - reach, "left"), np.searchsorted(at, along[rows[-1]] + reach, "right")
                if x0 < x1:
                    spot = np.flatnonzero(here[rows] @ other[:, x0:x1] <= limit)
                    yield rows[spot // (x1 - x0)], right[x0 + spot % (x1 - x0)]

        home = [np.flatnonzero((tile == t) & ~guest) for t in (tx, ty)]
        guests = [np.flatnonzero((tile == t) & guest) for t in (tx, ty)]
        # two guests need not meet here
        if tx == ty:
            meetings = itertools.chain(near(home[0], home[0]), near(home[0], guests[0]))
        else:
            meetings = itertools.chain(near(home[0], np.concatenate([home[1], guests[1]])), near(guests[0], home[1]))
        for p, q in meetings:
            ok = v[p] != v[q]
            if tx == ty:
                ok &= (p < q) | guest[q]
            p, q = p[ok], q[ok]
            for lot in np.array_split(np.arange(len(p)), len(p) // 100_000 + 1):
                k, m = p[lot], q[lot]
                apart = (x[k] - x[m]) ** 2
                allow = error[k] + error[m]
                ok = np.sqrt(apart.sum(axis=1)) <= bound + allow + 1e-5
                ok &= np.sqrt(apart[:, s:e].sum(axis=1)) <= root[b] + allow + 1e-5
                for earlier in range(b):
                    ok &= np.sqrt(apart[:, grid.start[earlier] : grid.end[earlier]].sum(axis=1)) > root[earlier] - allow - 1e-5
                if ok.any():
                    yield v[k[ok]], v[m[ok]]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if sum(len(h[2]) for h in held) < 2:
                return
            tile, guest, v, code = (np.concatenate(z) for z in zip(*held))
            for a, b in pairs_of(now, tile, guest, v, code):
                yield pa.RecordBatch.from_arrays([*(pa.array([c] * len(a), t) for c, t in zip(now, (pa.int32(), pa.int64(), pa.int32(), pa.int32()))), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["block", "cell", "x", "y", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            tile, guest, v = batch.column(4).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False), batch.column(6).to_numpy()
            for i, j in zip(cut[:-1], cut[1:]):
                if tuple(key[i].tolist()) != now:
                    yield from close()
                    now, held = tuple(key[i].tolist()), []
                # the binary column of one task has one width
                part = batch.column(7).slice(i, j - i)
                offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
                raw = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                held.append((tile[i:j], guest[i:j], v[i:j], raw.reshape(j - i, -1)))
        yield from close()

    return tasks.mapInArrow(match, "block int, cell long, x int, y int, a long, b long")


def verified(reps: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """PAIRS of the candidates, by their exact vectors."""
    task = ["block", "cell", "x", "y"]
    needed = pairs.select(*task, F.explode(F.array("a", "b")).alias("v")).distinct()
    sent = needed.join(reps.select("v", "e"), "v").select(*task, F.col("v").alias("a"), F.lit(None).cast("long").alias("b"), "e")
    rows = sent.unionByName(pairs.select(*task, "a", "b", F.lit(None).cast("array<float>").alias("e")))
    rows = rows.repartition(*task).sortWithinPartitions(*task, F.col("b").isNotNull(), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, lots, ready = None, [], [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            pair = np.asarray(batch.column(5).is_valid().to_numpy(zero_copy_only=False))
            a, b = batch.column(4).to_numpy(), batch.column(5).fill_null(0).to_numpy()
            new = (key[1:] != key[:-1]).any(axis=1) | (pair[1:] != pair[:-1])
            cut = [0, *(np.flatnonzero(new) + 1).tolist(), len(key)] if len(key) else []
            for i, j in zip(cut[:-1], cut[1:]):
                if tuple(key[i].tolist()) != now:
                    now, ids, lots, ready = tuple(key[i].tolist()), [], [], None
                if not pair[i]:
                    ids.append(a[i:j])
                    lots.append(next(by_length(batch.column(6).slice(i, j - i)))[1])
                    continue
                if ready is None:
                    ready = np.concatenate(ids), unit(np.concatenate(lots))
                who, x = ready
                # versions of one vec_id lie together; all of them are compared
                p, q = (np.searchsorted(who, c[i:j], "left") for c in (a, b))
                np_, nq = (np.searchsorted(who, c[i:j], "right") - s for c, s in ((a, p), (b, q)))
                pair_at = np.arange(j - i)
                if (np_ * nq).max() > 1:
                    pair_at = np.repeat(pair_at, np_ * nq)
                    nth = np.arange(len(pair_at)) - np.repeat(np.cumsum(np_ * nq) - np_ * nq, np_ * nq)
                    p, q = p[pair_at] + nth // nq[pair_at], q[pair_at] + nth % nq[pair_at]
                for lot in np.array_split(np.arange(len(p)), len(p) // 100_000 + 1):
                    sim = (x[p[lot]] * x[q[lot]]).sum(axis=1)
                    ok = sim >= threshold - 1e-12
                    at = pair_at[lot][ok]
                    yield pa.RecordBatch.from_arrays([pa.array(a[i:j][at]), pa.array(b[i:j][at]), pa.array(np.minimum(sim[ok], 1.0).round(6))], ["vec_a", "vec_b", "similarity"])

    return rows.mapInArrow(run, PAIRS)


def classes_and_pairs(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, axes: int = AXES) -> tuple[DataFrame, DataFrame]:
    """(vec_id, class_id, n_copies) and PAIRS: the class of equal vectors that each one is in, named by its least vec_id, and the similar pairs of classes."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    if not 1 <= blocks <= 64:
        raise ValueError("blocks must be from 1 to 64")
    rows = stage(usable(vectors), "vectors")
    # one hot class is one row here; AQE splits its rows in the join
    shared = rows.groupBy("key").agg(F.min("v").alias("rep"), F.countDistinct("v").alias("n")).where("n > 1")
    all_rows = stage(rows.join(shared, "key", "left").withColumn("rep", F.coalesce("rep", "v")).withColumn("n", F.coalesce("n", F.lit(1))), "vector-classes")
    reps = all_rows.where("v = rep").dropDuplicates(["v", "key"])
    pairs = stage(candidates(reps, threshold, blocks, axes), "vector-pairs")
    members = all_rows.select(F.col("v").alias("vec_id"), F.col("rep").alias("class_id"), (F.col("n") - 1).alias("n_copies")).distinct()
    return members, stage(verified(reps, pairs, threshold).groupBy("vec_a", "vec_b").agg(F.max("similarity").alias("similarity")), "similar")


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, axes: int = AXES) -> DataFrame:
    """PAIRS, vec_a < vec_b: vectors of cosine >= threshold; of equal vectors the least vec_id stands for all and is paired with each."""
    members, found = classes_and_pairs(vectors, threshold, blocks, axes)
    equal = members.where("vec_id != class_id").select(F.col("class_id").alias("vec_a"), F.col("vec_id").alias("vec_b"), F.lit(1.0).alias("similarity"))
    return found.unionByName(equal).groupBy("vec_a", "vec_b").agg(F.max("similarity").alias("similarity"))


def similar_links(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, axes: int = AXES) -> DataFrame:
    """(vec_id, class_id, n_copies, n_links, best) of every vector that is like another one, a row for each.

    class_id is the least vec_id of equal vectors, n_copies the number of the others, n_links the number of other classes within the threshold, best the
    highest similarity to another vector. A vector with several versions has the least class, the sums and the highest similarity of them.
    """
    members, found = classes_and_pairs(vectors, threshold, blocks, axes)
    both = found.unionByName(found.select(F.col("vec_b").alias("vec_a"), F.col("vec_a").alias("vec_b"), "similarity"))
    links = both.groupBy(F.col("vec_a").alias("class_id")).agg(F.countDistinct("vec_b").alias("n_links"), F.max("similarity").alias("best"))
    rows = members.join(links, "class_id", "left").where("n_copies > 0 OR n_links IS NOT NULL")
    best = F.max(F.when(F.col("n_copies") > 0, 1.0).otherwise(F.col("best")))
    return rows.groupBy("vec_id").agg(F.min("class_id").alias("class_id"), F.sum("n_copies").alias("n_copies"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"), best.alias("best"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that are like another one, with their class and number of links."""
    return similar_links(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def vectors_sql(threshold: float = THRESHOLD) -> str:
    """The same rows as one SQL text: every pair of different vectors."""
    return f"""
    WITH rep AS (SELECT vec_id, embedding, min(vec_id) OVER (PARTITION BY embedding) AS class_id, count(*) OVER (PARTITION BY embedding) - 1 AS n_copies FROM embeddings),
    one AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM rep WHERE vec_id = class_id),
    pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS s FROM one x JOIN one y ON x.vec_id < y.vec_id),
    near AS (SELECT a, b, round(s, 6) AS s FROM pairs WHERE s >= {threshold}::DOUBLE - 1e-12),
    links AS (SELECT class_id, count(*) AS n_links, max(s) AS best FROM (SELECT a AS class_id, s FROM near UNION ALL SELECT b, s FROM near) GROUP BY 1)
    SELECT vec_id, class_id, n_copies, coalesce(n_links, 0)::BIGINT AS n_links, (CASE WHEN n_copies > 0 THEN 1.0 ELSE best END)::DOUBLE AS best
    FROM rep LEFT JOIN links USING (class_id) WHERE n_copies > 0 OR n_links IS NOT NULL"""
