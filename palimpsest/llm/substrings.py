"""Substring dedup (operator 9): Rabin-Karp hashes of every fixed-length token window, counted in Spark.

Every window of `width` tokens of every document has a rolling polynomial hash of 64 bits; equal windows
agree on it and on the 64-bit hash of a part of theirs (below), by which they are partitioned.
Windows that occur more than once are repeated; those that overlap or touch in a document merge
into maximal intervals: `copy` = 'later' is what a dedup removes (windows that occur earlier, by doc_id and
position), 'first' is where the first occurrences of repeated windows lie, which stay.

Most windows are unique, and they need no shuffle to be known as such: the least `gram`-token hash inside a
window is a function of its content, so two equal windows select equal grams. Only the selected
positions (about one token in twenty) are counted over the corpus first; a window whose selected gram occurs at one position
is unique and done. Every other window is hashed and counted. The result is the same as counting them all.

Defined cases: null or empty texts, and texts of fewer than `width` tokens, have no window; rows without
doc_id are left out; rows that repeat doc_id and text count once; of rows that share a doc_id only, each is a
document of its own, ordered by a hash of the text; a window that overlaps its own repeat (a a a a ...) counts like any other;
an empty table gives no interval; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load
from .tokens import SQL_TOKENS, U64, Chunk, chunks, windows

WIDTH, GRAM = 50, 16


def selected(c: Chunk, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token of every window, token of its selected gram, hashes of the grams by token).

    The selected gram is the least by the high bits of its hash, then the leftmost.
    """
    grams, at = c.grams(gram)
    n = len(c.hash) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    whole = np.full(len(c.hash), ~U64(0))
    whole[at] = grams
    bits = U64(max(1, len(whole).bit_length()))
    least = (whole >> bits << bits) | np.arange(len(whole), dtype=U64)
    span, have = width - gram + 1, 1
    while have < span:  # sliding minimum by doubling
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    first = np.flatnonzero(c.doc[:n] == c.doc[width - 1 :])
    return first, (least[first] & ((U64(1) << bits) - U64(1))).astype(np.int64), whole


def text_rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")


def anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(doc_id, th, at, gram): positions that some window selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in chunks(batch.column(2)):
                _, spots, whole = selected(c, width, gram)
                spots = np.unique(spots)
                d = c.doc[spots]
                yield pa.RecordBatch.from_arrays([pa.array(ids[c.first + d]), pa.array(th[c.first + d]), pa.array((spots - c.at[d]).astype(np.int32)), pa.array(whole[spots].view(np.int64))], ["doc_id", "th", "at", "gram"])

    return text_rows(docs).mapInArrow(run, "doc_id long, th long, at int, gram long")


#: Windows of one selected position that travel in a row; their marks are bits of a long.
SEGMENT = 60
#: A gram of more positions is hot: its windows travel one by one, to so many parts by their hash.
HOT, PARTS = 20_000, 64


def candidate_segments(docs: DataFrame, spots: DataFrame, width: int, gram: int) -> DataFrame:
    """(gram, hot, doc_id, th, at, hashes): hashes of the windows from token `at` on that select the same one of the document's spots.

    A spot is a token's place in its document, or the complement of it where its gram is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            values, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for c in chunks(batch.column(2)):
                first, spot, whole = selected(c, width, gram)
                mine = values[offsets[c.first] : offsets[c.first + c.n]]
                owner = np.repeat(np.arange(c.n), np.diff(offsets[c.first : c.first + c.n + 1]))
                wanted, busy = np.zeros(len(c.hash), bool), np.zeros(len(c.hash), bool)
                place = c.at[owner] + np.where(mine < 0, ~mine, mine)
                wanted[place], busy[place] = True, mine < 0
                hit = wanted[spot]
                first, spot = first[hit], spot[hit]
                if not len(first):
                    continue
                hashes, at = windows(c.hash, c.doc, width)
                hashes = hashes[np.searchsorted(at, first)]
                start = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
                length = np.diff(np.concatenate([start, [len(spot)]]))
                if length.max() > SEGMENT:
                    run_ = np.arange(len(spot)) - np.repeat(start, length)
                    start = np.flatnonzero(run_ % SEGMENT == 0)
                d = c.doc[first[start]]
                rows = pa.ListArray.from_arrays(pa.array(np.concatenate([start, [len(spot)]]).astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(whole[spot[start]].view(np.int64)), pa.array(busy[spot[start]]), pa.array(ids[c.first + d]), pa.array(th[c.first + d]), pa.array((first[start] - c.at[d]).astype(np.int32)), rows], ["gram", "hot", "doc_id", "th", "at", "hashes"])

    return text_rows(docs).join(spots, ["doc_id", "th"]).select("doc_id", "th", "text", "spots").mapInArrow(run, "gram long, hot boolean, doc_id long, th long, at int, hashes array<long>")


def intervals(marks: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, copy, start_token, end_token) of windows marked by bits `first` and `later` from token `at` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}  # the interval of each kind that may go on

        def rows(kind: str, found: list) -> pa.RecordBatch:
            doc, th, a, b = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array([kind] * len(doc)), pa.array(a), pa.array(b)], ["doc_id", "th", "copy", "start_token", "end_token"])

        for batch in batches:
            ids, ths, ats = (batch.column(i).to_numpy() for i in range(3))
            for i, kind in ((3, "first"), (4, "later")):
                bits = (batch.column(i).to_numpy()[:, None] >> np.arange(SEGMENT)) & 1
                row, o = np.nonzero(bits)
                doc, th, a = ids[row], ths[row], ats[row].astype(np.int64) + o
                b = a + width
                if kind in held:
                    old = held.pop(kind)
                    doc, th, a, b = (np.concatenate([[x], y]) for x, y in zip(old, (doc, th, a, b)))
                if not len(doc):
                    continue
                start = np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (a[1:] > b[:-1])])
                s = np.flatnonzero(start)
                e = np.concatenate([s[1:], [len(doc)]]) - 1
                held[kind] = [doc[e[-1]], th[e[-1]], a[s[-1]], b[e[-1]]]
                if len(s) > 1:
                    yield rows(kind, [(doc[s[:-1]], th[s[:-1]], a[s[:-1]], b[e[:-1]])])
        for kind, (doc, th, a, b) in held.items():
            yield rows(kind, [tuple(np.array([x]) for x in (doc, th, a, b))])

    together = marks.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "at")
    return together.mapInArrow(run, "doc_id long, th long, copy string, start_token long, end_token long")


def repeated_intervals(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, copy, start_token, end_token): maximal intervals of repeated windows, ends exclusive."""
    if width < 1:
        raise ValueError("width must be at least 1")
    gram = min(gram, width)
    picked = anchors(docs, width, gram)
    place = F.struct("doc_id", "th", "at")
    # rows that repeat doc_id and text share a position, so they do not make a gram repeated; a hot gram is one row here, and AQE splits its rows in the join
    often = picked.groupBy("gram").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count(F.lit(1)).alias("n")).where("lo != hi").select("gram", (F.col("n") > HOT).alias("hot"))
    spot = F.when(F.col("hot"), F.bitwise_not("at")).otherwise(F.col("at"))
    spots = picked.join(often, "gram").groupBy("doc_id", "th").agg(F.collect_set(spot).alias("spots"))
    # equal windows have equal grams and equal hashes: everything from here to the marks happens on one partitioning by gram and part
    segments = candidate_segments(docs, spots, width, gram)
    alone = F.transform("hashes", lambda h, o: F.struct(F.pmod(h, F.lit(PARTS)).cast("int").alias("part"), o.cast("int").alias("from"), F.array(h).alias("hashes")))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("from"), F.col("hashes")))
    keyed = segments.select("gram", "doc_id", "th", "at", F.explode(F.when(F.col("hot"), alone).otherwise(whole)).alias("s")).select("gram", "doc_id", "th", "at", "s.*")
    keyed = keyed.repartition("gram", "part").dropDuplicates(["gram", "part", "doc_id", "th", "at", "from"])
    each = keyed.select("gram", "part", "doc_id", "th", "at", "from", F.posexplode("hashes").alias("k", "h")).withColumn("o", F.col("from") + F.col("k"))
    order = Window.partitionBy("gram", "part", "h").orderBy("doc_id", "th", F.col("at") + F.col("o"))
    counted = each.withColumn("nth", F.row_number().over(order)).withColumn("more", F.lead(F.lit(True)).over(order))
    bit = F.expr("shiftleft(1L, o)")
    later, first = F.when(F.col("nth") > 1, bit).otherwise(F.lit(0)), F.when((F.col("nth") == 1) & F.col("more").isNotNull(), bit).otherwise(F.lit(0))
    marks = counted.groupBy("gram", "part", "doc_id", "th", "at").agg(F.bit_or(first).alias("first"), F.bit_or(later).alias("later")).where("first != 0 OR later != 0")
    marks = marks.repartition("doc_id", "th").groupBy("doc_id", "th", "at").agg(F.bit_or("first").alias("first"), F.bit_or("later").alias("later"))
    return intervals(marks.select("doc_id", "th", "at", "first", "later"), width)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal repeated token intervals of documents: doc_id, copy, start_token, end_token, n_tokens."""
    found = repeated_intervals(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "copy", F.col("start_token").cast("long"), F.col("end_token").cast("long"), (F.col("end_token") - F.col("start_token")).cast("long").alias("n_tokens"))


def intervals_sql(table: str = "documents", width: int = WIDTH) -> str:
    """The same intervals as one SQL text, with the windows' words as keys."""
    return f"""
    WITH tok AS (SELECT doc_id, {SQL_TOKENS.format("text")} AS w FROM {table}),
    win AS (SELECT doc_id, unnest(generate_series(0, len(w) - {width})) AS pos, w FROM tok WHERE len(w) >= {width}),
    keyed AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1:pos + {width}], ' ')) AS k FROM win),
    seen AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth, count(*) OVER (PARTITION BY k) AS n FROM keyed),
    m AS (SELECT doc_id, pos, CASE WHEN nth = 1 THEN 'first' ELSE 'later' END AS copy FROM seen WHERE n > 1),
    f AS (SELECT *, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id, copy ORDER BY pos) + {width} THEN 1 ELSE 0 END AS fresh FROM m),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, copy ORDER BY pos) AS island FROM f)
    SELECT doc_id, copy, min(pos)::BIGINT AS start_token, (max(pos) + {width})::BIGINT AS end_token, (max(pos) + {width} - min(pos))::BIGINT AS n_tokens
    FROM i GROUP BY doc_id, copy, island"""
