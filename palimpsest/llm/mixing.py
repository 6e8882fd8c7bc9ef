"""Mixing sources to target weights (operator 2).

1. Packing: a source's documents, in a keyed pseudorandom order, become one token stream per bucket (a hash
   slice of the source of about `bucket_bytes` of text), cut into blocks of `block_tokens` tokens. A
   token is a word between white space; an end token follows every document. Blocks of a source are
   numbered 0, 1, ... over its buckets; a bucket's last block may be shorter.
2. Drawing: the output has `epochs` times as many slots as there are blocks, in shards of `shard_blocks`.
   A shard's source counts are one multinomial draw with the target weights, from a generator keyed by
   (seed, shard); its slots are shuffled by the same key.
3. Mapping: the t-th draw of a source takes block perm(t mod N) of its N blocks, perm being a keyed
   Feistel permutation of 0..N-1, another one for every pass t div N: no block repeats within a pass.
4. Joining: a draw knows its block's bucket by index arithmetic over the bucket table; draws and documents meet in
   one shuffle on (source, bucket), where the blocks are cut as the documents stream by. Text moves once.
   A block's text is its tokens with one space between them: line breaks and indentation are not kept.

Target weights: a mapping source -> weight, or None for shares proportional to the square root of a
source's tokens. Weights of sources without any block are left out and the others rescaled.

Defined cases: null, empty and blank texts give no token and no end token; a null source is the source
'(none)'; a null doc_id is packed, and shown as null among a block's doc_ids; repeated rows are packed as often as
they occur; an empty table, or weights of zero in sum, give no rows; a document longer than a block, however long, spans several; equal draws go to the slot order of their shard; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, stage
from .tokens import U64, mix

BLOCK_TOKENS, SHARD_BLOCKS, BUCKET_BYTES, SEED, END = 1024, 1024, 8 << 20, 20240, "<|endoftext|>"
#: Rows of a table of sources that may be broadcast.
SMALL = 100_000
MIXED = "shard long, slot int, source string, block long, n_tokens int, doc_ids array<long>, text string"


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at the given places: a Feistel network, walked until it is back in range."""
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    low = U64((1 << half) - 1)
    out = index.astype(U64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> U64(half), x & low
        for r in range(6):
            left, right = right, left ^ (mix(right + U64((key + r * 0x9E3779B97F4A7C15) % (1 << 64))) & low)
        out[todo] = (left << U64(half)) | right
        todo[todo] = out[todo] >= U64(n)
    return out.astype(np.int64)


def draw_counts(shard: int, size: int, weights: list[float], seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(size, weights)


def shuffled_slots(shard: int, size: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed + 1, shard])).permutation(size)


def pass_key(seed: int, source: str, turn: int) -> int:
    h = np.frombuffer(source.encode().ljust(8, b"\0")[: max(8, len(source.encode()) // 8 * 8)], U64)
    return int(mix(np.array([U64((seed * 1_000_003 + turn) % (1 << 64)) ^ np.bitwise_xor.reduce(mix(h + np.arange(len(h), dtype=U64)))], U64))[0])


def parts(docs: DataFrame, seed: int) -> DataFrame:
    return docs.where("text IS NOT NULL").select(F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text").alias("ord"))


def token_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(source, ord, bytes, tokens) of every document that has a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(t.split()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(n, pa.int64())], ["source", "ord", "bytes", "tokens"])

    return parts(docs, seed).select("source", "doc_id", "text", "ord", F.octet_length("text").cast("long").alias("bytes")).mapInArrow(run, "source string, ord long, bytes long, tokens long").where("tokens > 0")


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """MIXED: one row for every output slot."""
    spark = docs.sparkSession
    counts = stage(token_counts(docs, seed), "tokens")
    source_bytes = stage(counts.groupBy("source").agg(F.ceil(F.sum("bytes") / bucket_bytes).cast("long").alias("buckets")), "sources")
    # a row a source: sent to every task, so that text is not shuffled by its source, unless there are too many
    if source_bytes.count() <= SMALL:
        source_bytes = F.broadcast(source_bytes)
    bucket = F.pmod("ord", "buckets").alias("bucket")
    table = counts.join(source_bytes, "source").select("source", bucket, "tokens").groupBy("source", "bucket").agg(F.sum(F.col("tokens") + 1).alias("tokens"))
    table = table.withColumn("blocks", F.ceil(F.col("tokens") / block_tokens).cast("long"))
    table = table.withColumn("base", F.sum("blocks").over(Window.partitionBy("source").orderBy("bucket")) - F.col("blocks"))
    table = stage(table, "buckets")
    known = {r["source"]: (r["blocks"], r["tokens"]) for r in table.groupBy("source").agg(F.sum("blocks").alias("blocks"), F.sum("tokens").alias("tokens")).collect()}  # a row a source
    names = sorted(known)
    want = np.array([float((weights or {}).get(s, 0.0)) if weights is not None else math.sqrt(known[s][1]) for s in names])
    if not names or want.sum() <= 0:
        return spark.createDataFrame([], MIXED)
    share = (want / want.sum()).tolist()
    total = max(1, round(epochs * sum(b for b, _ in known.values())))
    shards = math.ceil(total / shard_blocks)
    blocks = {s: known[s][0] for s in names}

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in batches:
            for shard in lot["id"].tolist():
                n = draw_counts(shard, min(shard_blocks, total - shard * shard_blocks), share, seed)
                yield pd.DataFrame({"shard": shard, "source": names, "n": n, "slot0": np.cumsum(n) - n})

    draws = spark.range(shards).mapInPandas(draw, "shard long, source string, n long, slot0 long")
    draws = draws.withColumn("t0", F.sum("n").over(Window.partitionBy("source").orderBy("shard")) - F.col("n")).where("n > 0")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lot in batches:
            for shard, source, n, slot0, t0 in lot[["shard", "source", "n", "slot0", "t0"]].itertuples(index=False):
                t, size = np.arange(t0, t0 + n), blocks[source]
                index = np.empty(n, np.int64)
                for turn in np.unique(t // size).tolist():
                    now = t // size == turn
                    index[now] = permute(t[now] % size, size, pass_key(seed, source, turn))
                slots = shuffled_slots(shard, min(shard_blocks, total - shard * shard_blocks), seed)
                yield pd.DataFrame({"shard": shard, "source": source, "slot": slots[slot0 : slot0 + n], "block": index})

    placed = draws.mapInPandas(place, "shard long, source string, slot int, block long")
    # blocks to buckets: a range join, made an equi-join on stretches of block numbers
    stretch = 1024
    reach = table.select("source", "bucket", "base", "blocks", F.explode(F.sequence(F.expr(f"base DIV {stretch}"), F.expr(f"(base + blocks - 1) DIV {stretch}"))).alias("part"))
    placed = placed.withColumn("part", F.expr(f"block DIV {stretch}")).join(reach, ["source", "part"]).where("block >= base AND block < base + blocks")
    slots = placed.select("source", "bucket", F.lit(0).alias("kind"), F.col("block") - F.col("base"), "shard", "slot", F.col("block").alias("block"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")).toDF("source", "bucket", "kind", "ord", "shard", "slot", "block", "doc_id", "text")
    texts = parts(docs, seed).join(source_bytes, "source").select("source", bucket, F.lit(1).alias("kind"), "ord", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("block"), "doc_id", "text")
    both = slots.unionByName(texts).repartition("source", "bucket").sortWithinPartitions("source", "bucket", "kind", "ord", "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wanted, words, ids, done, head = None, {}, [], [], 0, 0
        out: list[tuple] = []

        def emit(n: int) -> None:
            """The n tokens from `head` on are the next block; ids: (document, end of its tokens in words)."""
            nonlocal words, ids, done, head
            draws_of = wanted.get(done)
            if draws_of:
                start, members = head, []
                for doc, end in ids:
                    if start < head + n:
                        members.append(doc)
                    start = end
                text = " ".join(words[head : head + n])
                out.extend((shard, slot, now[0], block, n, members, text) for shard, slot, block in draws_of)
            head += n
            done += 1
            if head * 2 > len(words):  # what is cut goes when it is the larger part, so a token is moved a few times at most
                words = words[head:]
                ids = [(doc, end - head) for doc, end in ids if end > head]
                head = 0
            else:
                ids = [(doc, end) for doc, end in ids if end > head]

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string()))], ["shard", "slot", "source", "block", "n_tokens", "doc_ids", "text"])
            out.clear()
            return made

        for batch in batches:
            source, bucket_, kind, ord_, shard, slot, block, doc_id, text = (batch.column(i).to_pylist() for i in range(9))
            for i in range(batch.num_rows):
                if (source[i], bucket_[i]) != now:
                    if len(words) > head:
                        emit(len(words) - head)
                    now, wanted, words, ids, done, head = (source[i], bucket_[i]), {}, [], [], 0, 0
                if kind[i] == 0:
                    wanted.setdefault(ord_[i], []).append((shard[i], slot[i], block[i]))
                    continue
                own = text[i].split()
                if not own:
                    continue
                words += own
                words.append(END)
                ids.append((doc_id[i], len(words)))
                while len(words) - head >= block_tokens:
                    emit(block_tokens)
                if len(out) > 500:
                    yield rows()
        if len(words) > head:
            emit(len(words) - head)
        if out:
            yield rows()

    return both.mapInArrow(cut, MIXED)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed to square-root shares of their sources, as one epoch's worth of blocks."""
    return mix_sources(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))
