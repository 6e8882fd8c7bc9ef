"""Toxicity (operator 7) by weak supervision.

Many voters look at every text: lexicons of insults in several languages, patterns (address +
insult, hostile phrases, shouting, exclamation runs, repeated insults), and learnt lexicons. A voter says toxic, clean, or nothing.
A learnt lexicon holds words, another word beginnings (BEGINNINGS bytes), of one language: those that stand out among its labelled rows, whose
labelled rows of any language are toxic with a share of `precision` at least, and that cover, chosen greedily, LEAST different toxic texts that no
earlier choice covers (so copies of one text bring no words in). They are read from labelled rows whose expected number `labelled` is a parameter: the bound
of that fit. Languages of few toxic labels, and those beyond the LANGUAGES with most, share one pair of learnt lexicons.

A generative label model over the corpus' vote patterns estimates by expectation-maximisation how each
voter behaves on toxic and on clean texts. Voters whose votes stay correlated within the classes are
found from the residual correlations of a first, independent fit, and joined: a group of correlated voters has
one joint table a class, so that it doesn't count its evidence several times over. The posterior of each text labels it.

A linear classifier over presence of hashed tokens and word beginnings is then trained on the posterior labels of a sample of
texts, whose expected number `sample` is a parameter. Features are screened first, by counts taken in Spark: those whose
share of toxic texts is above the average by more than `z` standard errors and three times. It scores whole texts of
all rows in one scan; texts with a probability of at least `threshold` are toxic.

Vote patterns are counted over all texts; the driver receives one row for each different pattern (at most
3**voters, in practice some hundred), the screened features and, of each text of the bounded sample, those of them that it has.

Defined cases: null and empty texts get no vote but 'nothing', and are not toxic; rows without doc_id are
counted by the label model but not reported; repeated rows are counted as often as they occur and reported alike, once each; very
long texts are read whole (a text is one chunk); a probability equal to `threshold` is toxic; of several labels of a document the
highest counts, null labels and labels of unknown documents none; without labels only the written lexicons and patterns vote;
an empty table, or one in which no voter ever says toxic, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stage
from .tokens import U64, Chunk, chunks

SAMPLE, LABELLED, Z, PRECISION, THRESHOLD, SEED, BUCKETS = 30_000, 30_000, 6.0, 0.6, 0.5, 11, 1 << 31
LANGUAGES, LEAST, LIFT = 10, 10, 3.0
#: Bytes of the word beginnings that count as features beside whole words.
BEGINNINGS = (4, 5, 6)
LEXICONS = {
    "stupidity": "idiot idiots moron morons stupid dumb dumbass imbecile cretin halfwit dimwit brainless dunce fool fools airhead",
    "worth": "worthless pathetic useless loser losers failure nobody clown clowns laughable",
    "filth": "scum trash garbage vermin filth filthy disgusting disgrace maggot parasite",
    "profane": "damn damned crap ass asshole bastard bitch shit shitty bullshit piss fuck fucking fucker",
    "hate": "hate despise loathe detest subhuman",
    "german": "dummkopf trottel versager abschaum arschloch scheisse scheiße blödmann drecksau widerlich",
    "french": "imbécile crétin connard salaud ordure merde minable débile abruti",
    "spanish": "estúpido idiota imbécil basura escoria payaso mierda inútil pendejo cabrón",
}
#: Adjacent tokens.
PHRASES = "shut up|get lost|go away|drop dead|screw you|hate you|you people|shame on|you suck|kill yourself|fuck you|piss off"
ADDRESS = "you your youre u ur"
WRITTEN = [*LEXICONS, "phrase", "address", "several", "dense", "shout", "exclaim", "none"]
#: Languages that the written lexicons cover.
COVERED = ("en", "de", "fr", "es")


def _hashes(words: str) -> np.ndarray:
    return np.unique(next(iter(chunks(pa.array([words])))).hash)


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, document, whether it is a word beginning) of every token and beginning; features have 31 bits."""
    parts = [(c.hash, np.arange(len(c.hash)), False), *((*c.beginnings(k), True) for k in BEGINNINGS)]
    value = np.concatenate([p[0] for p in parts]) & U64(BUCKETS - 1)
    return value.astype(np.int64), c.doc[np.concatenate([p[1] for p in parts])].astype(np.int64), np.concatenate([np.full(len(p[0]), p[2]) for p in parts])


class Known:
    """Membership of 31-bit features in a fixed set, and the position there."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(np.asarray(values, np.int64))
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.values & ((1 << 18) - 1)] = True

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in value, positions in the set)"""
        spot = np.flatnonzero(self.maybe[value & ((1 << 18) - 1)])
        if not len(self.values) or not len(spot):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        where = np.searchsorted(self.values, value[spot]).clip(0, len(self.values) - 1)
        good = self.values[where] == value[spot]
        return spot[good], where[good]


class Lexicon:
    """The voters: token hashes with a bit for each written lexicon that has them, patterns, and learnt lexicons.

    learnt: the features of each learnt voter; languages: those that some lexicon covers.
    """

    def __init__(self, learnt: dict[str, np.ndarray] | None = None, languages: tuple[str, ...] = COVERED) -> None:
        found: dict[int, int] = {}
        for i, words in enumerate(LEXICONS.values()):
            for h in _hashes(words).tolist():
                found[h] = found.get(h, 0) | 1 << i
        self.hashes = np.array(sorted(found), U64)
        self.bits = np.array([found[h] for h in self.hashes.tolist()])
        self.address = _hashes(ADDRESS)
        self.phrases = np.unique([next(iter(chunks(pa.array([p])))).grams(2)[0][0] for p in PHRASES.split("|")])
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.hashes & U64(0xFFFF)] = True
        learnt = learnt or {}
        self.languages = set(languages)
        self.voters = [*WRITTEN, *learnt]
        self.known = Known(np.concatenate([*learnt.values(), np.empty(0, np.int64)]))
        self.learnt = np.array([np.isin(self.known.values, v) for v in learnt.values()]).reshape(len(learnt), len(self.known.values))

    def votes(self, c: Chunk, languages: list[str | None] | None = None) -> np.ndarray:
        """Votes of every voter on each document of the chunk: 1 toxic, -1 clean, 0 nothing."""
        out, n = np.zeros((c.n, len(self.voters)), np.int8), np.diff(c.at)
        spot = np.flatnonzero(self.maybe[c.hash & U64(0xFFFF)])
        where = np.searchsorted(self.hashes, c.hash[spot]).clip(0, len(self.hashes) - 1)
        good = self.hashes[where] == c.hash[spot]
        spot, bits = spot[good], self.bits[where[good]]
        for i in range(len(LEXICONS)):
            out[c.doc[spot[bits >> i & 1 == 1]], i] = 1
        hits = np.bincount(c.doc[spot], minlength=c.n)
        k = len(LEXICONS)
        pairs, at = c.grams(2)
        out[c.doc[at[np.isin(pairs, self.phrases)]], k] = 1
        near = np.zeros(len(c.hash), bool)
        near[spot] = True
        you = np.flatnonzero(np.isin(c.hash, self.address))
        for ahead in (1, 2, 3):
            ok = you[you + ahead < len(c.hash)]
            ok = ok[near[ok + ahead] & (c.doc[ok] == c.doc[ok + ahead])]
            out[c.doc[ok], k + 1] = 1
        out[hits >= 2, k + 2] = 1
        out[(hits > 0) & (hits * 100 >= n), k + 3] = 1
        raw = c.data
        upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])[c.offsets]
        alpha = np.concatenate([[0], np.cumsum(((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122)) | (raw >= 128))])[c.offsets]
        caps, letters = np.diff(upper), np.diff(alpha)
        out[(letters >= 20) & (caps * 2 > letters), k + 4] = 1
        bangs = (raw[:-1] == 33) & (raw[1:] == 33) if len(raw) > 1 else np.zeros(0, bool)
        out[np.unique(np.searchsorted(c.offsets, np.flatnonzero(bangs), "right") - 1), k + 5] = 1
        clean = (hits == 0) & (n > 0)
        if len(self.learnt):
            value, doc, _ = features(c)
            spot, where = self.known.find(value)
            for i, mine in enumerate(self.learnt):
                out[doc[spot[mine[where]]], len(WRITTEN) + i] = 1
            clean[doc[spot]] = False
        if languages is not None:
            # where no lexicon speaks the language, silence says nothing
            clean &= np.array([x is None or x in self.languages for x in languages], bool)
        out[clean, k + 6] = -1
        return out


def pack(votes: np.ndarray) -> np.ndarray:
    return ((votes.astype(np.int64) + 1) * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def unpack(packed: np.ndarray, voters: int) -> np.ndarray:
    return (packed[:, None] // 3 ** np.arange(voters) % 3 - 1).astype(np.int8)


class LabelModel:
    """P(toxic), and for each group of correlated voters P(their votes | class).

    known: how many labelled rows (clean, toxic) have each pattern. They count in the tables with their classes, as much in all as
    the corpus does whatever its size, and so keep the two classes from drifting to another division of the texts.
    """

    def __init__(self, votes: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, rounds: int = 100, linked: float = 0.4):
        self.linked, weight = linked, counts / counts.sum()
        self.known = np.zeros((len(votes), 2)) if known is None else known / max(known.sum(), 1e-12)
        start = np.clip(0.5 + 0.4 * np.sign((votes == 1).sum(axis=1) - 0.5 * (votes == -1).sum(axis=1)), 0.1, 0.9)
        groups = [[v] for v in range(votes.shape[1])]
        post = self._em(votes, weight, groups, start, rounds)
        self.correlations = self._residual(votes, weight, post)
        # the most correlated voters first, in groups of three at most: larger joint tables would leave nothing to agree with
        group = {v: [v] for v in range(votes.shape[1])}
        for a, b in sorted(zip(*np.nonzero(np.triu(self.correlations > linked, 1))), key=lambda ab: -self.correlations[ab]):
            if group[a] is not group[b] and len(group[a]) + len(group[b]) <= 3:
                group[a] += group[b]
                for v in group[a]:
                    group[v] = group[a]
        self.groups = [g for v, g in group.items() if g[0] == v]
        self.posterior = self._em(votes, weight, self.groups, post, rounds)
        #: a voter's accuracy: its vote's agreement with the class, where it votes
        agree = np.where(votes == 1, self.posterior[:, None], np.where(votes == -1, 1 - self.posterior[:, None], 0))
        cast = (votes != 0) * weight[:, None]
        self.accuracy = (agree * weight[:, None]).sum(axis=0) / np.maximum(cast.sum(axis=0), 1e-12)

    def _residual(self, votes: np.ndarray, weight: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Positive correlations of votes that the classes leave over, the larger of the two."""
        total = np.zeros((votes.shape[1],) * 2)
        for w in (weight * post, weight * (1 - post)):
            x = votes - (w[:, None] * votes).sum(axis=0) / max(w.sum(), 1e-12)
            cov = (x * w[:, None]).T @ x
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            total = np.maximum(total, np.where(np.diag(cov)[:, None] * np.diag(cov)[None] > 1e-18, cov / sd[:, None] / sd[None], 0) * (w.sum() > 1e-6))
        return total

    def _em(self, votes, weight, groups, post, rounds):
        keys = [pack(votes[:, g]) for g in groups]
        codes = [np.unique(k, return_inverse=True) for k in keys]
        for _ in range(rounds):
            mass = [weight * p + self.known[:, k] for p, k in ((post, 1), (1 - post, 0))]
            share = float(np.clip(mass[0].sum() / (mass[0].sum() + mass[1].sum()), 1e-6, 1 - 1e-6))
            score = np.full(len(votes), np.log(share) - np.log1p(-share))
            for (values, code), g in zip(codes, groups):
                table = [np.bincount(code, weights=w, minlength=len(values)) + 1e-6 for w in mass]
                score += (np.log(table[0] / table[0].sum()) - np.log(table[1] / table[1].sum()))[code]
            new = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
            if np.abs(new - post).max() < 1e-9:
                post = new
                break
            post = new
        # identifiability: the class in which voters say toxic more is the toxic one
        said = (votes == 1).any(axis=1)
        if not self.known.any() and (post * weight)[said].sum() / max(weight[said].sum(), 1e-12) < (post * weight)[~said].sum() / max(weight[~said].sum(), 1e-12):
            post = 1 - post
        return post


def feature_counts(rows: DataFrame, group: str, target: str) -> DataFrame:
    """(group, feature, start, seen, toxic) of rows (group, target, text): how many texts have a feature, and the sum of their targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, weight = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            names = sorted(set(groups))
            code = np.searchsorted(names, groups)
            for c in chunks(batch.column(2)):
                value, doc, start = features(c)
                if not len(value):
                    continue
                both = np.unique((doc * 2 + start) * BUCKETS + value)
                doc, value, start = both // BUCKETS // 2 + c.first, both % BUCKETS, both // BUCKETS % 2
                key, at = np.unique((code[doc] * 2 + start) * BUCKETS + value, return_inverse=True)
                which = [names[i] for i in (key // BUCKETS // 2).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(key % BUCKETS), pa.array(key // BUCKETS % 2 == 1), pa.array(np.bincount(at)), pa.array(np.bincount(at, weights=weight[doc]))], [group, "feature", "start", "seen", "toxic"])

    counts = rows.select(F.col(group).cast("string"), F.col(target).cast("double"), "text").mapInArrow(run, f"{group} string, feature long, start boolean, seen long, toxic double")
    return counts.groupBy(group, "feature", "start").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))


def standing_out(counts: DataFrame, share: str, z: float) -> DataFrame:
    """The features whose share of toxic texts is above the average `share` by z standard errors and LIFT times."""
    error = F.sqrt(F.expr(f"seen * {share} * (1 - {share})"))
    return counts.where(F.col("seen") >= LEAST).where(F.expr(f"toxic - seen * {share}") > z * error).where(F.expr(f"toxic > {LIFT} * {share} * seen"))


def learnt_lexicons(docs: DataFrame, labels: DataFrame, size: int = LABELLED, z: float = Z, precision: float = PRECISION, seed: int = SEED) -> tuple[dict[str, np.ndarray], tuple[str, ...], DataFrame | None]:
    """Features of the learnt voters, the languages that they cover, and the labelled rows (text, lang, target)."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("of")).agg((F.max("toxic") > 0).cast("double").alias("target"))
    n = marks.count()
    if not n:
        return {}, COVERED, None
    picked = marks.where(F.pmod(F.xxhash64(F.lit(seed), "of"), F.lit(1_000_003)) < min(1.0, size / n) * 1_000_003)
    # about `size` rows of 16 bytes, whatever the tables hold
    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("of"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), "text").join(F.broadcast(picked), "of")
    marked = rows = stage(rows.select("lang", "target", "text"), "labelled")
    by_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("t")).where(F.col("t") >= LEAST).orderBy(F.desc("t"), "lang").limit(LANGUAGES)
    named = [r.lang for r in by_lang.collect()]
    rows = rows.withColumn("lang", F.when(F.col("lang").isin(named), F.col("lang")).otherwise(F.lit("*"))) if named else rows.withColumn("lang", F.lit("*"))
    rows = stage(rows.dropDuplicates(["text", "target"]), "labelled-texts")
    shares = rows.groupBy("lang").agg(F.avg("target").alias("share")).where("share > 0 AND share < 1")
    counts = stage(feature_counts(rows, "lang", "target"), "labelled-features")
    everywhere = counts.groupBy("feature", "start").agg(F.sum("seen").alias("all_seen"), F.sum("toxic").alias("all_toxic")).where(F.col("all_toxic") >= precision * F.col("all_seen"))
    out = standing_out(counts.join(F.broadcast(shares), "lang"), "share", z).join(everywhere, ["feature", "start"])
    table = out.select("lang", "start", "feature", (F.col("all_toxic") / F.col("all_seen")).alias("precise")).orderBy("lang", "start", "feature").toArrow().to_pandas()
    candidates = docs.sparkSession.sparkContext.broadcast(Known(table["feature"].to_numpy(np.int64)))
    got = with_found(rows.where("target > 0").select("lang", "text"), candidates, "lang string").toArrow()
    lists, spoken = got["found"].combine_chunks(), np.array(got["lang"].to_pylist())
    at, value = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), candidates.value.values[lists.flatten().to_numpy()]
    learnt = {}
    for (lang, start), part in table.groupby(["lang", "start"]):
        chosen = covering(at, value, np.flatnonzero(spoken == lang), part["feature"].to_numpy(np.int64), part["precise"].to_numpy())
        if len(chosen):
            learnt[f"learnt {lang} {'beginnings' if start else 'words'}"] = chosen
    return learnt, tuple({*COVERED, *(name.split(" ")[1] for name in learnt)}), marked


def covering(row: np.ndarray, value: np.ndarray, wanted: np.ndarray, features: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Of the features those that cover, greedily, LEAST more of the wanted rows each; row, value: which row has which feature."""
    mine = np.isin(row, wanted) & np.isin(value, features)
    row, col, chosen = row[mine], np.searchsorted(features, value[mine]), []
    while len(row):
        gain = np.bincount(col, minlength=len(features))
        best = int(np.argmax(np.where(gain >= LEAST, gain * weight, 0)))
        if gain[best] < LEAST:
            break
        chosen.append(features[best])
        rest = ~np.isin(row, row[col == best])
        row, col = row[rest], col[rest]
    return np.array(chosen, np.int64)


def with_found(rows: DataFrame, known: object, schema: str) -> DataFrame:
    """rows (one column of the schema, text) with the positions of those features of the broadcast set that each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(known.value.values) + 1
        for batch in batches:
            for c in chunks(batch.column(1)):
                value, doc, _ = features(c)
                spot, where = known.value.find(value)
                both = np.unique(doc[spot] * width + where)
                at = np.searchsorted(both // width, np.arange(c.n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array((both % width).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), lists], [schema.split(" ")[0], "found"])

    return rows.mapInArrow(run, f"{schema}, found array<int>")


def vote_patterns(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(pattern, target, n) of rows (text, lang, target): how many texts of a target get each combination of votes."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, target = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            found = [pack(shared.value.votes(c, lang[c.first : c.first + c.n])) for c in chunks(batch.column(0))]
            if found:
                value, n = np.unique(np.stack([np.concatenate(found), target], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value[:, 0]), pa.array(value[:, 1]), pa.array(n)], ["pattern", "target", "n"])

    rows = docs.where("text IS NOT NULL").select("text", "lang", F.col("target").cast("int"))
    return rows.mapInArrow(run, "pattern long, target long, n long").groupBy("pattern", "target").agg(F.sum("n").alias("n"))


class Classifier:
    """Logistic regression over presence of the screened features; rows, cols: which texts have which of them."""

    def __init__(self, values: np.ndarray, rows: np.ndarray, cols: np.ndarray, target: np.ndarray, rounds: int = 800, lasso: float = 2e-3, ridge: float = 1e-5):
        share = float(np.clip(target.mean(), 1e-6, 1 - 1e-6)) if len(target) else 0.5
        weights = self._fit(rows, cols, target, len(values), share, rounds, lasso, 0.0)
        # the lasso chooses features; their weights are then fitted without its shrinkage
        chosen = weights[:-1] != 0
        rows, cols = self._active(rows, cols, chosen)
        self.known = Known(values[chosen])
        weights = self._fit(rows, cols, target, int(chosen.sum()), share, rounds, 0.0, ridge)
        self.weights, self.bias = weights[:-1], float(weights[-1])

    @staticmethod
    def _active(rows: np.ndarray, cols: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = kept[cols]
        return rows[mine], (np.cumsum(kept) - 1)[cols[mine]]

    @staticmethod
    def _fit(rows, cols, target, width, share, rounds, lasso, ridge):
        """Accelerated proximal gradient over the whole sample; the bias is the last weight and not shrunk."""
        n = max(1, len(target))
        times = lambda w: w[-1] + np.bincount(rows, weights=w[cols], minlength=len(target))
        back = lambda r: np.append(np.bincount(cols, weights=r[rows], minlength=width), r.sum()) / n
        v = np.ones(width + 1)
        for _ in range(30):
            v = back(times(v))
            top = float(np.linalg.norm(v))
            v /= max(top, 1e-12)
        step = 1 / (0.25 * top * 1.1 + ridge + 1e-9)
        w = np.zeros(width + 1)
        w[-1] = np.log(share / (1 - share))
        look, t = w.copy(), 1.0
        for _ in range(rounds):
            miss = 1 / (1 + np.exp(-np.clip(times(look), -50, 50))) - target
            new = look - step * (back(miss) + ridge * np.append(look[:-1], 0))
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * lasso, 0)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            look, w, t = new + (t - 1) / after * (new - w), new, after
        return w

    def probability(self, c: Chunk) -> np.ndarray:
        value, doc, _ = features(c)
        spot, where = self.known.find(value)
        score = np.full(c.n, self.bias)
        if len(spot):
            both = np.unique(doc[spot] * len(self.weights) + where)
            score += np.bincount(both // len(self.weights), weights=self.weights[both % len(self.weights)], minlength=c.n)
        return 1 / (1 + np.exp(-np.clip(score, -50, 50)))


def with_lang(docs: DataFrame) -> DataFrame:
    return docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))


def train(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, z: float = Z, seed: int = SEED) -> tuple[LabelModel, Classifier] | None:
    """The label model of all texts and the classifier of a sample; None if no voter says toxic."""
    docs = with_lang(docs)
    *learnt, marked = learnt_lexicons(docs, labels, z=z, seed=seed) if labels is not None else (None, COVERED, None)
    lexicon = Lexicon(*learnt)
    found = vote_patterns(docs.withColumn("target", F.lit(-1)), lexicon)
    if marked is not None:
        found = found.unionByName(vote_patterns(marked, lexicon))
    table = found.orderBy("pattern", "target").toArrow().to_pandas()
    # one row a pattern: texts of the corpus, clean labelled ones, toxic labelled ones
    table = table.pivot_table(index="pattern", columns="target", values="n", aggfunc="sum", fill_value=0).reindex(columns=[-1, 0, 1], fill_value=0)
    patterns, counts, known = table.index.to_numpy(), table[-1].to_numpy().astype(float), table[[0, 1]].to_numpy().astype(float)
    if not counts.sum():
        return None
    votes = unpack(patterns, len(lexicon.voters))
    if not (votes == 1).any():
        return None
    label = LabelModel(votes, counts, known)
    posterior = dict(zip(patterns.tolist(), label.posterior.tolist()))
    share = min(1.0, sample / counts.sum())
    picked = docs.where("text IS NOT NULL").select("text", "lang").where(F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_003)) < share * 1_000_003)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, posterior))

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, table = shared.value
        for batch in batches:
            lang = batch.column(1).to_pylist()
            for c in chunks(batch.column(0)):
                target = [table[p] for p in pack(voters.votes(c, lang[c.first : c.first + c.n])).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([""] * c.n), pa.array(target), batch.column(0).slice(c.first, c.n)], ["part", "target", "text"])

    rows = stage(picked.mapInArrow(targets, "part string, target double, text string"), "toxicity-sample")
    mean = rows.agg(F.avg("target")).first()[0]
    if mean is None:
        return None
    mean = float(np.clip(mean, 1e-6, 1 - 1e-6))
    kept = standing_out(feature_counts(rows, "part", "target"), repr(mean), z).select("feature").distinct().orderBy("feature").toArrow()
    values = kept["feature"].to_numpy()
    known = docs.sparkSession.sparkContext.broadcast(Known(values))

    got = with_found(rows.select("target", "text"), known, "target double").toArrow()
    lists = got["found"].combine_chunks()
    at = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    return label, Classifier(values, at, lists.flatten().to_numpy().astype(np.int64), got["target"].to_numpy())


def toxic(docs: DataFrame, model: tuple[LabelModel, Classifier] | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, probability) of the toxic documents."""
    spark, schema = docs.sparkSession, "doc_id long, probability double"
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for c in chunks(batch.column(1)):
                p = m.probability(c)
                p[np.diff(c.at) == 0] = 0
                hit = pa.array(p >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n).filter(hit), pa.array(p).filter(hit)], ["doc_id", "probability"])

    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents with their probability."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return toxic(docs, train(docs, load(spark, sf_dir, "labels").select("doc_id", "toxic")))
