"""Language identification (operator 1) by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier over hashed byte trigrams (letters folded,
all else a space) predicts the bit: its weights are log odds of the trigrams' frequencies in the
languages with a 1 against those with a 0, each language counting the same. A text's margin is the mean weight over
its trigrams. Decoding is loss-weighted: distance(language) = sum over bits of
reliability(language, bit) x ln(1 + exp(-2 x codeword bit x margin)), where a bit's reliability is
its share of right signs on the training rows of that language. The least distance wins; the text is
ambiguous if the runner-up is nearer than `gap` to it, per unit of reliability, or fewer than `least` trigrams were seen.

Training: on labelled rows (text and `lang` known) whose keyed hash falls under a share that gives `sample`
rows in expectation: the bound of the fit, a parameter. Scoring reads whole texts of all rows in one scan, without a shuffle.

Codes: all 2**(L-1) - 1 distinct two-way splits for up to 5 languages; above, the widest-apart of 200
keyed random codes of ceil(10 log2 L) bits.

Defined cases: null, empty and letterless texts have no language, are ambiguous and rejected; very long texts are read whole; ties between
languages are ambiguous (the alphabetically first is named); rows with a null lang are scored but
don't train; a single language in training needs no bits and is given to every text with letters; with no labelled row
there is no model: nothing is identified, and the filter rejects nothing; a null doc_id stays null; repeated rows are scored alike; extra columns pass the filter unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stage
from .tokens import CHUNK, utf8

SAMPLE, GAP, LEAST, BITS, SEED = 40_000, 0.15, 1, 16, 7
SPACE = 32
_FOLD = np.full(256, SPACE, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def code_matrix(n: int, seed: int = SEED) -> np.ndarray:
    """Codewords (+1/-1) of n languages, one a row."""
    if n <= 5:
        bits = [[1] + [1 if (s >> i) & 1 else -1 for i in range(n - 1)] for s in range(2 ** (n - 1) - 1)] if n > 1 else []
        return np.array(bits, np.int8).T.reshape(n, -1)
    rng, width, best, apart = np.random.default_rng(seed), math.ceil(10 * math.log2(n)), None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), size=(n, width))
        m = m[:, np.abs(m.sum(axis=0, dtype=int)) < n]
        d = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if d > apart:
            best, apart = m, d
    return best


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, hashed trigrams, first trigram of each row) of chunks of a column; runs of spaces count as one."""
    data, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        folded, at = _FOLD[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        keep = folded != SPACE
        keep[1:] |= keep[:-1]  # the space after a word
        edge = at[:-1][at[:-1] < len(folded)]
        keep[edge] = folded[edge] != SPACE
        folded, at = folded[keep].astype(np.uint32), np.concatenate([[0], np.cumsum(keep)])[at]
        grams = ((folded[:-2] * np.uint32(0x9E3779B1)) ^ (folded[1:-1] * np.uint32(0x85EBCA77)) ^ (folded[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(32 - BITS)
        row = np.repeat(np.arange(j - i), np.diff(at))
        inside = row[2:] == row[:-2]
        yield i, j - i, grams[inside].astype(np.int64), np.searchsorted(row[:-2][inside], np.arange(j - i + 1))
        i = j


class Model:
    """Languages, codewords, trigram weights by bit, and reliability by language and bit."""

    def __init__(self, langs: list[str], counts: np.ndarray, seed: int = SEED):
        self.langs, self.code = langs, code_matrix(len(langs), seed)
        rate = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        self.weights = np.array([np.log(rate[c > 0].mean(axis=0)) - np.log(rate[c < 0].mean(axis=0)) for c in self.code.T], np.float32).reshape(self.code.shape[1], -1)
        self.scale = np.ones(self.code.shape[1])
        self.reliability = np.ones(self.code.shape)

    def margins(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean weight of each row's trigrams, by bit, in units of the training rows' mean margin."""
        count, out = np.diff(at), np.zeros((len(at) - 1, len(self.weights)))
        some = count > 0
        if some.any():
            for b, w in enumerate(self.weights):
                out[some, b] = np.add.reduceat(w[grams], at[:-1][some]) / count[some] / self.scale[b]
        return out

    def distances(self, margins: np.ndarray) -> np.ndarray:
        loss = np.logaddexp(0, -2 * self.code[None] * margins[:, None, :])
        return (loss * self.reliability[None]).sum(axis=2) / np.maximum(self.reliability.sum(axis=1), 1e-9)

    def decode(self, margins: np.ndarray, count: np.ndarray, gap: float, least: int) -> tuple[np.ndarray, ...]:
        """(winner, runner-up, distance between them, ambiguous) of each row."""
        d = self.distances(margins)
        order = np.argsort(d, axis=1, kind="stable")
        first = order[:, 0]
        second = order[:, min(1, d.shape[1] - 1)]
        apart = np.full(len(d), np.inf) if d.shape[1] == 1 else np.take_along_axis(d, second[:, None], 1)[:, 0] - np.take_along_axis(d, first[:, None], 1)[:, 0]
        return first, second, apart, (apart < gap) | (count < least)


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model | None:
    """A model of the labelled rows; `sample` bounds the rows that it is fitted on (in expectation)."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    n = known.select("lang").count()
    if not n:
        return None
    share = min(1.0, sample / n)
    # a share of the texts by hash: the same rows whatever the partitions; scanned once by as many tasks as the input has, and kept for two reads
    picked = stage(known.where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_003)) < share * 1_000_003), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, rows, grams, at in trigrams(batch.column(1)):
                owner = np.array(names[first : first + rows])
                for name in set(owner.tolist()):
                    mine = np.repeat(owner == name, np.diff(at))
                    total[name] = total.get(name, 0) + np.bincount(grams[mine], minlength=1 << BITS)
        for name, c in total.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some])], ["lang", "gram", "n"])

    table = picked.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # at most languages x 2**BITS rows
    if not table.num_rows:
        return None
    names = np.array(table["lang"].to_pylist())
    langs = sorted(set(names.tolist()))
    counts = np.zeros((len(langs), 1 << BITS))
    np.add.at(counts, (np.searchsorted(langs, names), table["gram"].to_numpy()), table["n"].to_numpy())
    model = Model(langs, counts, seed)
    if len(langs) > 1:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            size, right, n = np.zeros(m.code.shape), np.zeros(m.code.shape), np.zeros(len(m.langs))
            for batch in batches:
                owner = np.searchsorted(m.langs, batch.column(0).to_pylist())
                for first, rows, grams, at in trigrams(batch.column(1)):
                    f, lang = m.margins(grams, at), owner[first : first + rows]
                    some = np.diff(at) > 0
                    np.add.at(n, lang[some], 1)
                    np.add.at(size, lang[some], np.abs(f[some]))
                    np.add.at(right, lang[some], f[some] * m.code[lang[some]] > 0)
            rows = [(i, b, size[i, b], right[i, b], n[i]) for i in range(len(m.langs)) for b in range(m.code.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["i", "b", "size", "hits", "n"])

        stats = picked.mapInArrow(rate, "i long, b long, size double, hits double, n double").groupBy("i", "b").agg(*(F.sum(c).alias(c) for c in ("size", "hits", "n"))).toArrow()
        i, b = stats["i"].to_numpy(), stats["b"].to_numpy()
        n = np.maximum(stats["n"].to_numpy(), 1e-9)
        mean = np.zeros(model.code.shape)
        mean[i, b] = stats["size"].to_numpy() / n
        model.reliability[i, b] = (stats["hits"].to_numpy() + 1) / (n + 2)
        model.scale = np.maximum(mean.mean(axis=0).round(9), 1e-9)
        model.reliability = model.reliability.round(9)
    return model


IDENTIFIED = "doc_id long, lang_id string, runner_up string, margin double, ambiguous boolean"


def identify(docs: DataFrame, model: Model | None, gap: float = GAP, least: int = LEAST) -> DataFrame:
    """IDENTIFIED, a row for each row of docs; margin: by how much the runner-up is farther."""
    spark = docs.sparkSession
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang_id"), F.lit(None).cast("string").alias("runner_up"), F.lit(None).cast("double").alias("margin"), F.lit(True).alias("ambiguous"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.langs)
        for batch in batches:
            for first, rows, grams, at in trigrams(batch.column(1)):
                count = np.diff(at)
                one, two, apart, unsure = m.decode(m.margins(grams, at), count, gap, least)
                none = count == 0
                other = none | (len(m.langs) == 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), names.take(pa.array(one, mask=none)), names.take(pa.array(two, mask=other)), pa.array(np.round(apart, 9), mask=other), pa.array(unsure | none)], ["doc_id", "lang_id", "runner_up", "margin", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, IDENTIFIED)


def identified_only(docs: DataFrame, model: Model | None, gap: float = GAP, least: int = LEAST) -> DataFrame:
    """docs without the rows that are ambiguous or have no language, filtered in the scan; columns unchanged."""
    if model is None:
        return docs
    shared, at_text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, rows, grams, at in trigrams(batch.column(at_text)):
                count = np.diff(at)
                keep[first : first + rows] = ~m.decode(m.margins(grams, at), count, gap, least)[3] & (count > 0)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of the documents' own lang column."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
