"""N-gram Jaccard join (operator 5) with PartEnum signatures.

A document is the set of its `n`-token shingles. Sizes are cut into bands such that two sets with
Jaccard similarity >= `threshold` lie in the same band or in neighbouring ones; a set belongs to its
own band's group and to the next one's. In a group whose largest size is r, two similar sets differ in
at most k = 2 r (1 - t) / (1 + t) shingles. The shingle domain is cut into P partitions by hash. PartEnum's signatures are the subsets of s
partitions with their content: with P = k + s + 1, s + 1 partitions at least agree whatever the k differences hit. The subsets are not written out
(there are P over s of them): each non-empty partition's content is sent, and two sets share a subset's signature where they
share s of these. s is 1 for small sets and 2 from SHARED_FROM shingles on, which keeps out sets that agree by chance in one partition of
common shingles.

Partitions that are empty in both sets agree without a signature; below EXACT shingles there are so many partitions (more than k + s + 1 where need be) that
this hides a pair with a probability of MISS = 1e-5 at most, computed exactly for the least similar pairs. Where k is larger the guarantee is exchanged for a bound, as k + 3 signatures a text cost more than the texts: P is the least for
which two sets exactly at the threshold share fewer signatures with a probability of MISS at most (more similar ones: far less). Groups
with r above FEATURES take signatures from a hash-chosen part 2**-j of the shingle domain, the same for all
sets of the group; the bound counts that in. All pairs that share s signatures and do not differ too much in a sketch are candidates; all candidates are verified
on their whole sets. The sketch has SKETCH min-hash bits of a set's part of the shingle domain: two sets at the threshold agree on them far more often
than sets that share a signature by chance; the least agreement asked for is 4.5 standard deviations below what a pair at the threshold has.

Sets that are equal are one class in the search, named by its least document, so the work stays linear in copies.
Buckets of a signature, and the sets of a connected component of candidates for verification, are joined in tiles of bounded size.

Defined cases: null or empty texts, and texts without tokens, have no set and no partner; a text of fewer
than n tokens is one shingle, all its tokens; very long texts are read whole; a similarity equal to the threshold counts; rows without doc_id are left
out of the search and stay in the filter; rows that repeat a doc_id
are versions of one document: it has the best similarity of its versions and is never its own partner;
an empty table gives no rows; extra columns are ignored, and come through the filter whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, stage, unused
from .tokens import SQL_TOKENS, U64, Chunk, chunks, mix

N, THRESHOLD, FEATURES, MISS, TILE, SHARED_FROM = 2, 0.7, 128, 1e-5, 3000, 18
#: Sets of fewer shingles get so many partitions that a pair can only be missed by partitions that are empty in both.
EXACT = 60
#: Bits of the candidates' filter: eight for each candidate, within these bounds (16 MB at most are broadcast); a full one lets more rows through.
BLOOM_BITS = (16, 27)
#: Bits of the sketch that tells candidates from sets that share a signature by chance.
SKETCH = 128
_KEYS = mix(np.arange(1, 2 * SKETCH + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).astype(np.uint32).reshape(2, SKETCH)
#: The low bits of a signature name its partition.
PART = U64(63)


def missed_exactly(parts: int, differ: int, common: int, shared: int) -> float:
    """Probability that fewer than `shared` of the partitions that no difference hits hold a common shingle, each shingle falling in any partition."""

    def fallen(balls: int, bins: int) -> list[float]:
        """Probability of each number of the first `bins` partitions that the balls hit."""
        p = [1.0] + [0.0] * bins
        for _ in range(balls):
            p = [p[k] * (parts - bins + k) / parts + (p[k - 1] * (bins - k + 1) / parts if k else 0.0) for k in range(bins + 1)]
        return p

    return sum(p * sum(fallen(common, parts - hit)[:shared]) for hit, p in enumerate(fallen(differ, parts)) if p > 1e-12)


@functools.lru_cache(maxsize=64)
def small_parts(low: int, high: int, threshold: float, shared: int, miss: float) -> int:
    """Partitions for the sets of a small band: k + s + 1 at least, and so many that no pair of sizes is missed with more than `miss`, as agreeing partitions may be empty."""
    parts = math.floor(2 * high * (1 - threshold) / (1 + threshold) + 1e-9) + shared + 1
    pairs = []
    for big in (low, high):
        for size in range(max(1, math.ceil(threshold * big - 1e-9)), big + 1):
            common = math.ceil(threshold * (size + big) / (1 + threshold) - 1e-9)
            if common <= size and size + big > 2 * common:
                pairs.append((size + big - 2 * common, common))
    while parts < 64 and any(missed_exactly(parts, d, o, shared) > miss for d, o in set(pairs)):
        parts += 1
    return parts


class Bands:
    """Size bands of a threshold: first size, sampling shift and number of partitions of each group."""

    def __init__(self, threshold: float, features: int = FEATURES, miss: float = MISS, largest: int = 1 << 40):
        low = [1]
        while low[-1] <= largest:
            low.append(math.floor(low[-1] / threshold + 1e-9) + 1)
        self.low = np.array(low)
        self.shift, self.parts, self.shared = [], [], []
        for g in range(len(low) - 1):
            r = low[g + 1] - 1
            shift = max(0, math.ceil(math.log2(r / features)))
            k = 2 * r * (1 - threshold) / (1 + threshold)
            seen = k / 2**shift
            s = 2 if low[g] >= SHARED_FROM else 1
            parts = math.floor(seen + 1e-9) + s + 1
            if r < EXACT:
                parts = small_parts(low[g], r, threshold, s, miss)
            elif parts > EXACT // 2:
                parts = next((p for p in range(2, parts) if self.missed(p, seen, 2 * r / 2**shift / (1 + 1 / threshold), s) <= miss), parts)
            if parts > 64:
                raise ValueError("threshold too low for this number of features")
            self.shift.append(shift)
            self.parts.append(parts)
            self.shared.append(s)
        self.shift, self.parts = np.array(self.shift + self.shift[-1:], U64), np.array(self.parts + self.parts[-1:], U64)

    @staticmethod
    def missed(parts: int, differ: float, common: float, shared: int) -> float:
        """Probability that fewer than `shared` partitions are non-empty and free of differences."""
        q = math.exp(-differ / parts) * (1 - math.exp(-common / parts))
        return sum(math.comb(parts, i) * q**i * (1 - q) ** (parts - i) for i in range(shared))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1


def shingle_sets(c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all documents of the chunk, first one of each document)."""
    grams, at = c.grams(n)
    doc = c.doc[at]
    count = np.diff(c.at)
    for k in range(1, n):  # shorter texts: one shingle of all tokens
        g, a = c.grams(k)
        short = count[c.doc[a]] == k
        grams, doc = np.concatenate([grams, g[short]]), np.concatenate([doc, c.doc[a][short]])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(c.n + 1))


def sketches(grams: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """SKETCH one-bit min-hashes of each of `count` documents, packed; doc is ascending."""
    out = np.zeros((count, SKETCH), bool)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        values = (grams >> U64(32)).astype(np.uint32)
        for i in range(SKETCH):
            least = np.minimum.reduceat((values ^ _KEYS[0, i]) * (_KEYS[1, i] | np.uint32(1)), first)
            out[doc[first], i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(out, axis=1)


def least_agreement(threshold: float) -> int:
    """Bits of the sketch on which two sets at the threshold agree, less 4.5 standard deviations."""
    p = (1 + threshold) / 2
    return math.floor(SKETCH * (p - 4.5 * math.sqrt(p * (1 - p) / SKETCH + threshold * (1 - threshold) / (4 * 0.75 * FEATURES))))


def signatures(grams: np.ndarray, doc: np.ndarray, group: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document) of every non-empty partition, and the documents' sketches; group: of each document."""
    g = group[doc]
    sampled = (mix(grams ^ U64(0x5851F42D4C957F2D)) & ((U64(1) << bands.shift[g]) - U64(1))) == 0
    grams, doc, g = grams[sampled], doc[sampled], g[sampled]
    if not len(grams):
        return np.empty(0, U64), np.empty(0, np.int64), sketches(grams, doc, len(group))
    scattered = mix(grams ^ U64(0x14057B7EF767814F))
    part = (scattered >> U64(32)) % bands.parts[g]
    key = doc * 4096 + part.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    content = np.add.reduceat(scattered[order], first, dtype=U64)
    d = key[first] // 4096
    p = (key[first] % 4096).astype(U64)
    return (mix(content ^ mix((group[d].astype(U64) << U64(20)) + p)) & ~PART) | p, d, sketches(grams, doc, len(group))


SETS = "doc_id long, key long, size long, own array<long>, also array<long>, own_bits binary, also_bits binary"


def describe(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """SETS: of each document the hash of its set, its size, the signatures and the sketch in its own and in the next group."""
    bands = Bands(threshold)

    def lists(values: np.ndarray, doc: np.ndarray, count: int) -> pa.Array:
        offsets = np.searchsorted(doc, np.arange(count + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                grams, at = shingle_sets(c, n)
                size = np.diff(at)
                doc = np.repeat(np.arange(c.n), size)
                total = np.concatenate([[U64(0)], np.cumsum(mix(grams.copy()), dtype=U64)])
                key = mix((total[at[1:]] - total[at[:-1]]) ^ size.astype(U64))
                band = bands.of(size)
                own, also = (signatures(grams, doc, band + up, bands) for up in (0, 1))
                ends = pa.py_buffer((np.arange(c.n + 1) * (SKETCH // 8)).astype(np.int32))
                bits = [pa.Array.from_buffers(pa.binary(), c.n, [None, ends, pa.py_buffer(x[2])]) for x in (own, also)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array(key.view(np.int64)), pa.array(size), *(lists(x[0], x[1], c.n) for x in (own, also)), *bits], ["doc_id", "key", "size", "own", "also", "own_bits", "also_bits"])
                yield out.filter(pa.array(size > 0))

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(run, SETS)


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, tree), a < b, each once: documents that share enough signatures in the later one of their own groups.

    Signatures that one set has alone go first, then sets with too few left. Each remaining signature's bucket gets its sets
    along with their other signatures in the group, so a pair is reported in the first bucket that it
    shares only, and nothing of the size of all pairs is shuffled. The pairs marked `tree` connect what all pairs connect, with at most
    one pair for each row of a bucket.
    """
    two = int(Bands(threshold).low[Bands(threshold).shared.index(2)])
    least = float(threshold)

    def group_rows(column: str, mine: bool) -> DataFrame:
        return reps.select("doc_id", "size", F.lit(mine).alias("mine"), F.explode(column).alias("sig"))

    rows = group_rows("own", True).unionByName(group_rows("also", False))
    # a hot signature is one row of the counts; AQE splits its rows in the join
    often = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    rows = rows.join(often, "sig").select("doc_id", "size", "mine", F.struct("sig", "tiles").alias("sig"), F.lit(None).cast("binary").alias("bits"))
    for column, mine in (("own", True), ("also", False)):  # the sketches join in the grouping, not in the shuffle by signature
        rows = rows.unionByName(reps.select("doc_id", "size", F.lit(mine).alias("mine"), F.lit(None).cast("struct<sig:long,tiles:int>").alias("sig"), F.col(f"{column}_bits").alias("bits")))
    held = rows.groupBy("doc_id", "size", "mine").agg(F.collect_list("sig").alias("sigs"), F.max("bits").alias("bits")).where((F.size("sigs") > 1) | ((F.size("sigs") > 0) & (F.col("size") < two)))
    # of the other signatures 32 bits are sent, which still name their partition
    short = F.transform("sigs", lambda x: (x["sig"].bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int"))
    buckets = held.select("doc_id", "size", "mine", "bits", short.alias("others"), F.explode("sigs").alias("s")).select("doc_id", "size", "mine", "bits", "others", "s.*")
    # a bucket of more than TILE rows is cut into tiles, and joined tile by tile
    buckets = buckets.withColumn("tile", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    buckets = buckets.withColumns({"x": F.least("tile", "other"), "y": F.greatest("tile", "other")}).repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y", "doc_id")

    agree = least_agreement(threshold)

    def pairs_of(task: tuple, doc: np.ndarray, size: np.ndarray, mine: np.ndarray, bits: np.ndarray, table: np.ndarray, tile: np.ndarray) -> Iterator[tuple]:
        """table: a row of signatures by partition for each set of the bucket, 0 where there is none."""
        part, label, across = task[0] & 63, np.arange(len(doc)), task[1] != task[2]
        for i in range(len(doc) - 1):
            rest = np.flatnonzero((mine[i + 1 :] | mine[i]) & (np.minimum(size[i + 1 :], size[i]) >= least * np.maximum(size[i + 1 :], size[i]) - 1e-6) & (doc[i + 1 :] != doc[i]) & (~across | (tile[i + 1 :] != tile[i]))) + i + 1
            if len(rest):
                rest = rest[np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1) <= SKETCH - agree]
            if not len(rest):
                continue
            same = (table[rest] == table[i]) & (table[i] != 0)
            fits = ~same[:, :part].any(axis=1) & ((same.sum(axis=1) > 1) | (np.maximum(size[rest], size[i]) < two))
            rest = rest[fits]
            if not len(rest):
                continue
            value, first = np.unique(label[rest], return_index=True)
            new = value != label[i]
            tree = np.zeros(len(rest), bool)
            tree[first[new]] = True
            label[np.isin(label, value)] = label[i]
            yield doc[i].repeat(len(rest)), doc[rest], tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # what has been read of the bucket at hand
        now = None

        def close() -> list[tuple]:
            if sum(len(h[0]) for h in held) < 2:
                return []
            return list(pairs_of(now, *(np.concatenate(x) for x in zip(*held))))

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            low, high, tree = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(low, high)), pa.array(np.maximum(low, high)), pa.array(tree)], ["a", "b", "tree"])

        for batch in batches:
            if not batch.num_rows:
                continue
            doc, size, mine, bits, sigs, sig, tile, tx, ty = (batch.column(i) for i in range(9))
            doc, size, sig, mine, tile, tx, ty = doc.to_numpy(), size.to_numpy(), sig.to_numpy(), mine.to_numpy(zero_copy_only=False), tile.to_numpy(), tx.to_numpy(), ty.to_numpy()
            bits = np.frombuffer(bits.buffers()[2], U64).reshape(-1, SKETCH // 64)[bits.offset : bits.offset + len(bits)]
            flat = (sigs.flatten().to_numpy().astype(np.int64) + (1 << 31)).astype(np.uint32)
            row = np.repeat(np.arange(len(doc)), sigs.value_lengths().to_numpy())
            table = np.zeros((len(doc), 64), np.uint32)
            table[row, (flat & np.uint32(63)).astype(np.int64)] = flat
            cut = np.concatenate([[0], np.flatnonzero((sig[1:] != sig[:-1]) | (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])) + 1, [len(sig)]])
            found = []
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                task = (int(sig[x]), int(tx[x]), int(ty[x]))
                if task != now:
                    found += close()
                    now, held = task, []
                held.append((doc[x:y], size[x:y], mine[x:y], bits[x:y], table[x:y], tile[x:y]))
            if found:
                yield batch_of(found)
        if found := close():
            yield batch_of(found)

    return buckets.select("doc_id", "size", "mine", "bits", "others", "sig", "tile", "x", "y").mapInArrow(run, "a long, b long, tree boolean")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the least member c of the connected component of every end v of the edges (a, b).

    Alternating large-star and small-star steps: each round is two windows over the edges, no join,
    and the number of rounds grows with the logarithm of the longest path.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", m).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = stage(small, "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), "v")).distinct().select(F.col("u").alias("v"), F.col("v").alias("c"))


TASKS = "c long, x int, y int, a long, b long, grams binary"
PAIRS = "doc_a long, doc_b long, jaccard double"


def verify(docs: DataFrame, pairs: DataFrame, member: DataFrame, n: int, threshold: float) -> DataFrame:
    """PAIRS of those candidates that are similar, by their whole sets."""
    spark = docs.sparkSession
    size = member.groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    tiled = member.join(size, "c").select("v", "c", F.ceil(F.col("m") / TILE).cast("int").alias("t")).withColumn("h", F.pmod(F.xxhash64("v"), F.col("t")).cast("int"))
    tiled = stage(tiled, "tiles")
    left = tiled.select(F.col("v").alias("a"), "c", F.col("h").alias("ha"))
    right = tiled.select(F.col("v").alias("b"), F.col("h").alias("hb"))
    todo = pairs.join(left, "a").join(right, "b").select("c", F.least("ha", "hb").alias("x"), F.greatest("ha", "hb").alias("y"), "a", "b", F.lit(None).cast("binary").alias("grams"))

    wide = min(max(math.ceil(math.log2(8 * max(1, tiled.count()))), BLOOM_BITS[0]), BLOOM_BITS[1])
    place = tiled.select(F.pmod(F.xxhash64("v"), F.lit(1 << wide)).cast("int").alias("p"))
    bits = place.select(F.expr("p DIV 32").alias("w"), F.expr("shiftleft(1L, p % 32)").alias("bit"))
    bloom = np.zeros(1 << (wide - 5), np.int64)
    for w, bit in bits.groupBy("w").agg(F.bit_or("bit")).toLocalIterator():
        bloom[w] = bit
    wanted = spark.sparkContext.broadcast(bloom.astype(np.uint32))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        for batch in batches:
            p = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((words[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1))
            for c in chunks(batch.column(2)):
                grams, at = shingle_sets(c, n)
                values = pa.Array.from_buffers(pa.binary(), c.n, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(grams)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), values], ["v", "grams"])

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << wide)).cast("long"), "text")
    # a set goes to the tasks that have a pair for it, and to no other tile
    needed = todo.select("c", "x", "y", F.explode(F.array("a", "b")).alias("v")).distinct()
    members = texts.mapInArrow(sets, "v long, grams binary").join(needed, "v").select("c", "x", "y", F.col("v").alias("a"), F.lit(None).cast("long").alias("b"), "grams")
    # a task's sets come first, then its pairs; the single-tile case is the common one
    rows = members.unionByName(todo).repartition("c", "x", "y").sortWithinPartitions("c", "x", "y", F.col("b").isNotNull(), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, ids = None, {}, {}
        for batch in batches:
            c, x, y, a, b = (batch.column(i).to_pylist() for i in range(5))
            grams, found = batch.column(5), []
            anchor, mine = None, None
            for i in range(batch.num_rows):
                if (c[i], x[i], y[i]) != task:
                    task, held, ids, anchor = (c[i], x[i], y[i]), {}, {}, None
                if b[i] is None:
                    held.setdefault(a[i], []).append(np.frombuffer(grams[i].as_buffer(), U64).copy())
                    continue
                if a[i] != anchor:
                    anchor, mine = a[i], held.get(a[i], [])
                best = 0.0
                for p in mine:
                    for q in held.get(b[i], []):
                        low, high = (p, q) if len(p) <= len(q) else (q, p)
                        spot = np.searchsorted(high, low)
                        spot[spot == len(high)] = 0
                        same = int(np.count_nonzero(high[spot] == low))
                        best = max(best, same / (len(p) + len(q) - same))
                if best >= threshold:
                    found.append((a[i], b[i], best))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))], ["doc_a", "doc_b", "jaccard"])

    return rows.mapInArrow(run, PAIRS)


MEMBERS = "doc_id long, class_id long, n_copies long"


def classes_and_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """MEMBERS and PAIRS: the class of equal sets that each document is in, named by its least doc_id, with the number of
    its other documents; and the similar pairs of class names, doc_a < doc_b. A document with several versions is in the class of each."""
    described = stage(describe(docs, n, threshold), "sets")
    # one hot class is one row here; AQE splits its rows in the join
    shared = described.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.countDistinct("doc_id").alias("n")).where("n > 1")
    sets = stage(described.join(shared, "key", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")).withColumn("n", F.coalesce("n", F.lit(1))), "classes")
    members = sets.select("doc_id", "class_id", (F.col("n") - 1).alias("n_copies")).distinct()
    reps = sets.where("doc_id = class_id").dropDuplicates(["doc_id", "key"])
    pairs = stage(candidates(reps, threshold), "pairs")
    if pairs.isEmpty():
        return members, docs.sparkSession.createDataFrame([], PAIRS)
    return members, stage(verify(docs, pairs.select("a", "b"), components(pairs.where("tree")), n, threshold), "near")


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """PAIRS, doc_a < doc_b: similar documents; of documents with equal sets the least stands for all and is paired with each."""
    members, near = classes_and_pairs(docs, n, threshold)
    equal = members.where("doc_id != class_id").select(F.col("class_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(equal).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def jaccard_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, best) of every document that is like another one, a row for each.

    class_id is the least document of the same set, n_copies the number of others with that set, n_links the number of other classes similar to it, best
    the highest similarity to another document. A document with several versions has the least class, the sums and the highest similarity of them.
    """
    members, near = classes_and_pairs(docs, n, threshold)
    both = near.unionByName(near.select(F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b"), "jaccard"))
    links = both.groupBy(F.col("doc_a").alias("class_id")).agg(F.countDistinct("doc_b").alias("n_links"), F.max("jaccard").alias("best"))
    rows = members.join(links, "class_id", "left").where("n_copies > 0 OR n_links IS NOT NULL")
    best = F.max(F.when(F.col("n_copies") > 0, 1.0).otherwise(F.col("best")))
    return rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_copies").alias("n_copies"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"), best.alias("best"))


def one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that a chain of similar pairs links to a document of smaller doc_id; columns unchanged.

    Rows without doc_id, and texts without tokens, stay; of rows that repeat a doc_id all stay or all go; any column names will do.
    """
    pairs = stage(jaccard_pairs(docs.select("doc_id", "text"), n, threshold), "near-all")
    groups = components(pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))
    drop = unused("drop", docs.columns)
    gone = groups.where("v != c").select(F.col("v").alias(drop))
    return docs.join(gone, docs["doc_id"] == F.col(drop), "left_anti")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are like another one, with their class and number of links."""
    return jaccard_links(load(spark, sf_dir, "documents").select("doc_id", "text"))


def pairs_sql(table: str = "documents", n: int = N, threshold: float = THRESHOLD) -> str:
    """The same rows as one SQL text: every shared shingle of the classes, counted."""
    return f"""
    WITH tok AS (SELECT doc_id, {SQL_TOKENS.format("text")} AS w FROM {table} WHERE doc_id IS NOT NULL),
    sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {n} THEN list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s FROM tok WHERE len(w) > 0),
    rep AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) - 1 AS n_copies FROM sets),
    one AS (SELECT doc_id, len(s) AS size, unnest(s) AS g FROM rep WHERE doc_id = class_id),
    near AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / (any_value(x.size) + any_value(y.size) - count(*)) AS jaccard
        FROM one x JOIN one y ON x.g = y.g AND x.doc_id < y.doc_id AND least(x.size, y.size) >= {threshold} * greatest(x.size, y.size) - 1e-6 GROUP BY 1, 2),
    links AS (SELECT class_id, count(*) AS n_links, max(jaccard) AS best FROM (SELECT a AS class_id, jaccard FROM near WHERE jaccard >= {threshold} UNION ALL SELECT b, jaccard FROM near WHERE jaccard >= {threshold}) GROUP BY 1)
    SELECT doc_id, class_id, n_copies, coalesce(n_links, 0)::BIGINT AS n_links, (CASE WHEN n_copies > 0 THEN 1.0 ELSE best END)::DOUBLE AS best
    FROM rep LEFT JOIN links USING (class_id) WHERE n_copies > 0 OR n_links IS NOT NULL"""
