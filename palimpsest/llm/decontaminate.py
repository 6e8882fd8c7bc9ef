"""Benchmark decontamination (operator 3): SimHash of item-sized windows, multi-index Hamming search,
exact weighted-shingle similarity.

Every document is searched with a window of each item's own token count, at every token. A window
gets a 64-bit SimHash of its weighted shingles. The fingerprint is cut into radius + 1 blocks: two
fingerprints within the radius agree on a block at least, so looking up each block finds all of
them. The radius (21 at the threshold of 0.7) lies 2.5 standard deviations above the distance that is expected of two windows at the threshold; beyond it
are under 1 % of pairs just at the threshold, and next to none of more similar ones. Blocks are narrow at such a radius (3 bits), so they prune
little, and the weight bounds below do most of the work. Candidates are then compared exactly: weighted Jaccard similarity of the shingle multisets,
at least `threshold`. A shingle weighs ln(1 + items / items that hold it); one that no item holds
weighs as one that a single item holds.

Before hashing, windows are left out by bounds that lose nothing which could be verified. A window similar to an item shares `threshold` of the
item's weight, so it holds one of the item's rarest shingles, taken until the others weigh less than that: only windows of the item's length over such
a shingle are looked at. For each of them and that very item, the weight of the window's shingles that the item holds bounds what both share, and with both
whole weights the similarity. So a copy of one item is not searched at the lengths of all others. The benchmark is searched in slices of at most `items_per_pass` items, a larger one
in several passes over the documents. Every slice has the weights of all the benchmark's shingles, so
hits do not depend on the slicing; the weights travel with each slice and grow with the benchmark.

Defined cases: null or empty texts and items have no windows and no hits; an item of fewer than
`shingle` tokens uses shingles of its own length; documents shorter than an item cannot hold it; very long texts are read whole; of
several windows on one item the most similar counts, then the earliest; repeated rows give the same hit
once; items that have the same text are each reported; extra columns are ignored by the search and kept by the filter.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .tokens import U64, Chunk, chunks, windows

THRESHOLD, SHINGLE, ITEMS_PER_PASS = 0.7, 3, 20_000
HITS = "doc_id long, item_id long, start_token long, n_tokens long, hamming int, similarity double"
#: Grams that are looked at together, for the memory of a task.
LOT = 1 << 18
_BITS = np.arange(64, dtype=U64)


def radius_for(threshold: float) -> int:
    """Bits in which two windows at the threshold differ, and 2.5 standard deviations more.

    Windows of like weight with weighted Jaccard similarity t have the cosine 2 t / (1 + t); each bit differs with the probability angle / pi.
    """
    p = math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi
    return min(63, math.ceil(64 * p + 2.5 * math.sqrt(64 * p * (1 - p))))


def simhash(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes with their weights."""
    signs = ((shingles[:, :, None] >> _BITS) & U64(1)).astype(np.float32) * 2 - 1
    total = np.einsum("ij,ijk->ik", weights.astype(np.float32), signs)
    return ((total > 0).astype(U64) << _BITS).sum(axis=1, dtype=U64)


def in_lots(sizes: np.ndarray, limit: int) -> list[np.ndarray]:
    """Indexes of consecutive sizes, split where about `limit` is reached."""
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1)


def block_bounds(radius: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, 64, radius + 2).round().astype(int)
    return list(zip(cuts[:-1].tolist(), np.diff(cuts).tolist()))


def weighted_jaccard(a: np.ndarray, b: np.ndarray, weight: dict[int, float], other: float) -> float:
    """Sum of weight x smaller count over sum of weight x larger count."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    low = high = 0.0
    for s in sorted(x.keys() | y.keys()):
        w = weight.get(s, other)
        low += w * min(x[s], y[s])
        high += w * max(x[s], y[s])
    return low / high if high else 0.0


class Items:
    """A slice of the benchmark, indexed for search; df is of the whole benchmark."""

    def __init__(self, ids: list[int], texts: list[str], total: int, df: dict[int, dict[int, int]], radius: int, threshold: float, shingle: int):
        self.ids, self.radius, self.threshold = ids, radius, threshold
        self.shingles: list[np.ndarray] = []
        self.groups: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # shingle size -> tokens -> items
        for i, c in enumerate(one for text in texts for one in chunks(pa.array([text]))):
            n = len(c.hash)
            k = max(1, min(shingle, n))
            self.shingles.append(c.grams(k)[0])
            if n:
                self.groups[k][n].append(i)
        self.groups = {k: dict(v) for k, v in self.groups.items()}
        self.other = math.log1p(total)
        self.weight = {k: {s: math.log1p(total / d) for s, d in df.get(k, {}).items()} for k in self.groups}
        self.known, self.filter = {}, {}
        self.size = np.array([len(g) for g in self.shingles])
        self.mass = np.zeros(len(ids))
        self.held, self.rare = {}, {}
        for k, by in self.groups.items():
            here = np.array(sorted(self.weight[k]), U64)
            w = np.array([self.weight[k][s] for s in here.tolist()])
            self.known[k] = (here, w)
            self.filter[k] = np.zeros(1 << max(16, (len(here) * 16).bit_length()), bool)
            self.filter[k][here & U64(len(self.filter[k]) - 1)] = True
            held, rare = [], []
            for i in sorted(i for group in by.values() for i in group):
                one, count = np.unique(np.searchsorted(here, self.shingles[i]), return_counts=True)
                self.mass[i] = (w[one] * count).sum()
                order = np.argsort(-w[one], kind="stable")
                rest = self.mass[i] - np.cumsum((w[one] * count)[order])
                held.append(i * len(here) + one)
                first = order[: 1 + (rest >= threshold * self.mass[i] - 1e-6).sum()]
                rare.append(np.stack([one[first], np.full(len(first), i)]))
            self.held[k] = np.concatenate(held)
            at, items = np.concatenate(rare, axis=1)
            order = np.argsort(at, kind="stable")
            self.rare[k] = (np.searchsorted(at[order], np.arange(len(here) + 1)), items[order])
        self.prints, self.blocks = {}, {}
        for k, by in self.groups.items():
            for n, group in by.items():
                rows = np.stack([self.shingles[i] for i in group])
                self.prints[k, n] = simhash(rows, self._weights(k, rows))
                for b, (low, bits) in enumerate(block_bounds(radius)):
                    value = (self.prints[k, n] >> U64(low)) & U64((1 << bits) - 1)
                    order = np.argsort(value, kind="stable")
                    self.blocks[k, n, b] = (low, bits, value[order], order)

    def _weights(self, k: int, rows: np.ndarray) -> np.ndarray:
        here, w = self.known[k]
        at = np.searchsorted(here, rows).clip(0, len(here) - 1)
        return np.where(here[at] == rows, w[at], self.other)

    def search(self, c: Chunk) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(document in chunk, item, first token in document, tokens, Hamming distance, similarity) of verified windows."""
        for k, by in self.groups.items():
            grams, at = c.grams(k)
            if not len(at):
                continue
            maybe = np.flatnonzero(self.filter[k][grams & U64(len(self.filter[k]) - 1)])
            here, w = self.known[k]
            spot = np.searchsorted(here, grams[maybe]).clip(0, len(here) - 1)
            hit = here[spot] == grams[maybe]
            maybe, spot = maybe[hit], spot[hit]
            cuts = self.rare[k][0]
            calls = np.flatnonzero(cuts[spot + 1] > cuts[spot])
            if not len(calls):
                continue
            place, whole, shared = np.full(len(grams), -1), np.full(len(grams), self.other), np.zeros(len(grams))
            place[maybe], whole[maybe], shared[maybe] = spot, w[spot], w[spot]
            sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (whole, shared)]
            doc = c.doc[at]
            edge = np.searchsorted(doc, np.arange(c.n + 1))
            for lot in in_lots(cuts[spot[calls] + 1] - cuts[spot[calls]], LOT):
                for item, first in self._possible(k, maybe[calls[lot]], spot[calls[lot]], place, sums, doc, edge):
                    for m in np.unique(self.size[item]).tolist():
                        mine = self.size[item] == m
                        pairs = np.unique(first[mine] * len(self.ids) + item[mine])
                        starts = np.unique(first[mine])
                        for few in np.array_split(starts, len(starts) * m // (LOT // 4) + 1):
                            if len(few):
                                yield from self._verify(c, k, m + k - 1, by[m + k - 1], grams, at, doc, few, pairs)

    def _possible(self, k, at, spot, place, sums, doc, edge) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items and first grams of windows over the grams `at`, rare ones of the item, that can be similar to it by weight."""
        (cuts, items), (_, w), (whole, shared) = self.rare[k], self.known[k], sums
        count = cuts[spot + 1] - cuts[spot]
        item = items[np.arange(count.sum()) - np.repeat(count.cumsum() - count - cuts[spot], count)]
        at = np.repeat(at, count)
        m = self.size[item]
        low, high = np.maximum(at - m + 1, edge[doc[at]]), np.minimum(at, edge[doc[at] + 1] - m)
        good = low <= high
        good[good] = (shared[high[good] + m[good]] - shared[low[good]]) >= self.threshold * self.mass[item[good]] - 1e-6
        order = np.flatnonzero(good)
        order = order[np.argsort(item[order], kind="stable")]
        item, low, high = item[order], low[order], high[order]
        if not len(item):
            return
        # runs of overlapping stretches of one item; ends rise with the position, and no stretch leaves its document
        new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (low[1:] > high[:-1])]))
        runs = item[new], low[new], high[np.append(new[1:], len(high)) - 1]
        for lot in in_lots(runs[2] - runs[1] + self.size[runs[0]], LOT):
            item, low, high = (x[lot] for x in runs)
            m, n = self.size[item], high - low + 1
            skip = (m + n - 1).cumsum() - (m + n - 1)
            gram = place[np.arange((m + n - 1).sum()) - np.repeat(skip - low, m + n - 1)]
            key = np.repeat(item, m + n - 1) * len(w) + gram
            held = self.held[k][np.searchsorted(self.held[k], key).clip(0, len(self.held[k]) - 1)] == key
            both = np.concatenate([[0.0], np.cumsum(np.where(held & (gram >= 0), w[gram], 0.0))])
            step = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
            item, m, first, begin = np.repeat(item, n), np.repeat(m, n), np.repeat(low, n) + step, np.repeat(skip, n) + step
            both = np.minimum(both[begin + m] - both[begin], self.mass[item])
            good = both * (1 + self.threshold) >= self.threshold * (whole[first + m] - whole[first] + self.mass[item]) - 1e-6
            yield item[good], first[good]

    def _verify(self, c, k, n, group, grams, at, doc, first, possible):
        rows = grams[first[:, None] + np.arange(n - k + 1)]
        prints = simhash(rows, self._weights(k, rows))
        seen = np.zeros(len(first) * len(group), bool)
        for b in range(self.radius + 1):
            low, bits, value, order = self.blocks[k, n, b]
            mine = (prints >> U64(low)) & U64((1 << bits) - 1)
            left, right = np.searchsorted(value, mine, "left"), np.searchsorted(value, mine, "right")
            count = right - left
            who = np.repeat(np.arange(len(mine)), count)
            which = order[np.arange(count.sum()) - np.repeat(count.cumsum() - count, count) + np.repeat(left, count)]
            seen[who * len(group) + which] = True
        pairs = np.flatnonzero(seen)
        who, which = pairs // len(group), pairs % len(group)
        far = np.bitwise_count(prints[who] ^ self.prints[k, n][which])
        near = (far <= self.radius) & np.isin(first[who] * len(self.ids) + np.array(group)[which], possible)
        for a, g, h in zip(who[near].tolist(), which[near].tolist(), far[near].tolist()):
            i = group[g]
            s = weighted_jaccard(rows[a], self.shingles[i], self.weight[k], self.other)
            if s >= self.threshold:
                d = int(doc[first[a]])
                yield d, self.ids[i], int(at[first[a]] - c.at[d]), n, h, s


def index_items(items: DataFrame, radius: int | None = None, threshold: float = THRESHOLD, shingle: int = SHINGLE, items_per_pass: int = ITEMS_PER_PASS) -> list[Items]:
    """The benchmark's slices. Its rows come to the driver, as a benchmark does not grow with the corpus."""
    radius = radius_for(threshold) if radius is None else radius
    rows = sorted({(r[0], r[1]) for r in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator()})
    df: dict[int, Counter] = defaultdict(Counter)
    for _, text in rows:
        for c in chunks(pa.array([text])):
            k = max(1, min(shingle, len(c.hash)))
            df[k].update(set(c.grams(k)[0].tolist()))
    lots = [rows[i : i + items_per_pass] for i in range(0, len(rows), items_per_pass)]
    return [Items([r[0] for r in lot], [r[1] for r in lot], len(rows), df, radius, threshold, shingle) for lot in lots]


def contamination(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The best window of each (document, item) that is similar enough: HITS."""
    spark = docs.sparkSession
    slices = [spark.sparkContext.broadcast(x) for x in index_items(items, **how)]

    def scan(lot):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = lot.value
            for batch in batches:
                ids = batch.column(0)
                out = [(ids[c.first + d].as_py(), *rest) for c in chunks(batch.column(1)) for d, *rest in index.search(c)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()))], ["doc_id", "item_id", "start_token", "n_tokens", "hamming", "similarity"])

        return run

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    hits = spark.createDataFrame([], HITS)
    for lot in slices:
        hits = hits.unionByName(texts.mapInArrow(scan(lot), HITS))
    best = F.max_by(F.struct("start_token", "n_tokens", "hamming", "similarity"), F.struct("similarity", -F.col("start_token"))).alias("b")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def decontaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without those that hold a benchmark item: filtered in the scan, without a shuffle."""
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index("text")
    for lot in [spark.sparkContext.broadcast(x) for x in index_items(items, **how)]:

        def keep(batches: Iterator[pa.RecordBatch], lot=lot) -> Iterator[pa.RecordBatch]:
            index = lot.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for c in chunks(batch.column(at)):
                    for d, *_ in index.search(c):
                        clean[c.first + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, schema)
    return docs


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the best window."""
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
