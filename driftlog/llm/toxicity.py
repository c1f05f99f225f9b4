"""Toxicity by weak supervision.

1.  Voters.  Word lists for common insults are lexicon voters.  Pattern voters
    are word beginnings and whole words that labelled training rows show to be
    far more frequent in toxic texts.  A voter fires or abstains.
2.  Label model.  A generative model of the votes is fitted by expectation
    maximisation over the votes of all documents: the rate at which a voter
    fires in toxic and in other texts gives its accuracy, and its correlation
    with the other voters inside a class lowers its weight, so that several
    voters seeing the same thing do not count several times.
3.  Classifier.  A logistic regression over word features is trained on the
    model's posterior labels of a bounded sample of labelled training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.reduce import sum_vectors
from driftlog.llm.sampling import bounded_sample
from driftlog.llm.text import Texts, find_words, hash_spans, slices
from driftlog.session import save_and_reload

SAMPLE_ROWS = 20_000
FEATURES = 4_096
PATTERN_VOTERS = 48
EVIDENCE = 11.5
BUCKET_BITS = 18
PREFIXES = (4, 5, 6)
HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"

LEXICONS = [
    ["idiot", "idiots", "moron", "morons", "imbecile", "imbeciles"],
    ["stupid", "dumb", "fool", "fools", "brainless"],
    ["loser", "losers", "clown", "clowns", "jerk"],
    ["pathetic", "worthless", "useless"],
    ["trash", "garbage", "filth"],
    ["scum", "vermin", "parasite", "parasites"],
    ["disgusting", "revolting", "repulsive"],
    ["hate", "despise", "kill", "die"],
]

_SEPARATORS = np.ones(256, bool)
_SEPARATORS[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False
_SEPARATORS[128:] = False


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, and the text of each."""
    low = texts.lowered()
    words = find_words(low, _SEPARATORS)
    owner = np.repeat(np.arange(len(texts)), words.counts())
    hashes, owners = [hash_spans(low.data, words.starts, words.ends)], [owner]
    for size in PREFIXES:
        longer = np.flatnonzero(words.ends - words.starts > size)
        starts = words.starts[longer]
        # A beginning is not the word of the same letters.
        hashes.append(hash_spans(low.data, starts, starts + size) ^ np.uint64(size))
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


class Lookup:
    """Positions of known 64-bit hashes; -1 for all others."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.near = np.zeros(1 << BUCKET_BITS, bool)
        self.near[hashes >> np.uint64(64 - BUCKET_BITS)] = True

    def find(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, owner) of every known hash."""
        maybe = np.flatnonzero(self.near[hashes >> np.uint64(64 - BUCKET_BITS)])
        at = np.searchsorted(self.sorted, hashes[maybe])
        at[at == len(self.sorted)] = 0
        hit = self.sorted[at] == hashes[maybe] if len(self.sorted) else np.zeros(len(maybe), bool)
        return self.order[at[hit]], owner[maybe[hit]]


class Voters(NamedTuple):
    lookup: Lookup
    voter: np.ndarray
    count: int

    def vote(self, hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """One bit per voter that fires, in a 64-bit number per text."""
        at, who = self.lookup.find(hashes, owner)
        out = np.zeros(texts, np.uint64)
        np.bitwise_or.at(out, who, np.uint64(1) << self.voter[at].astype(np.uint64))
        return out


def _word_hash(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    texts = Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    found = find_words(texts, _SEPARATORS)
    return hash_spans(texts.data, found.starts, found.ends)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled training documents.

    The sample has a fixed bound, so its ids may be broadcast.
    """
    ids = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic is not null")
        .filter(f"not ({HELD_OUT})")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(bounded_sample(ids, rows)), "doc_id"
    ).select("text", "toxic")


def _log_odds(toxic: np.ndarray, other: np.ndarray, toxic_texts: float, other_texts: float) -> np.ndarray:
    return np.log((toxic + 0.5) / (toxic_texts + 1)) - np.log((other + 0.5) / (other_texts + 1))


def mine(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features typical of toxic texts, best first, and their log odds."""
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(2 * size + 2)
        for part, texts in slices(batches):
            toxic = np.asarray(part.column("toxic")) > 0
            h, owner = _distinct(*features(texts))
            bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            out[:size] += np.bincount(bucket[toxic[owner]], minlength=size)
            out[size : 2 * size] += np.bincount(bucket[~toxic[owner]], minlength=size)
            out[-2:] += toxic.sum(), (~toxic).sum()
        return out

    totals = sum_vectors(sample, count, 2 * size + 2)
    toxic_texts, other_texts = totals[-2:]
    odds = _log_odds(totals[:size], totals[size:-2], toxic_texts, other_texts)
    odds[totals[:size] < 3] = -np.inf
    rate = (toxic_texts + 1) / (toxic_texts + other_texts + 2)
    share = F.col("share")
    divergence = share * F.log(share / rate) + F.when(
        share < 1, (1 - share) * F.log((1 - share) / (1 - rate))
    ).otherwise(0.0)
    # Buckets only preselect; the features in them are counted by full hash.
    likely = np.zeros(size, bool)
    likely[np.argsort(-odds, kind="stable")[: 8 * FEATURES]] = True
    likely &= odds > 1

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            toxic = np.asarray(part.column("toxic")) > 0
            h, owner = _distinct(*features(texts))
            chosen = likely[h >> np.uint64(64 - BUCKET_BITS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[chosen].view(np.int64)), pa.array(toxic[owner[chosen]].astype(np.int64))], ["h", "toxic"]
            )

    best = (
        sample.mapInArrow(spell, "h bigint, toxic bigint")
        .groupBy("h")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other"))
        .withColumn("share", F.col("toxic") / (F.col("toxic") + F.col("other")))
        .withColumn("odds", F.log((F.col("toxic") + 0.5) / (F.col("other") + 0.5)))
        # Many features are tried: the evidence that a feature is more frequent
        # in toxic texts, n times the divergence from their share, must be high.
        .filter((F.col("share") > rate) & ((F.col("toxic") + F.col("other")) * divergence >= EVIDENCE))
        .orderBy(F.desc("odds"), F.desc("toxic"), "h")
        .limit(FEATURES)
        .toPandas()
    )
    h = best["h"].to_numpy(np.int64).view(np.uint64)
    weights = _log_odds(best["toxic"].to_numpy(float), best["other"].to_numpy(float), toxic_texts, other_texts)
    return h[weights > 1], weights[weights > 1]


def build_voters(mined: np.ndarray) -> Voters:
    hashes, voter = [], []
    for i, lexicon in enumerate(LEXICONS):
        own = _word_hash(lexicon)
        hashes.append(own)
        voter.append(np.full(len(own), i))
    patterns = mined[~np.isin(mined, np.concatenate(hashes))][:PATTERN_VOTERS]
    hashes.append(patterns)
    voter.append(len(LEXICONS) + np.arange(len(patterns)))
    return Voters(Lookup(np.concatenate(hashes)), np.concatenate(voter), len(LEXICONS) + len(patterns))


class LabelModel(NamedTuple):
    """Firing rates per class, prior, and weights lowered by correlation."""

    toxic_rate: np.ndarray
    other_rate: np.ndarray
    prior: float
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1; a voter that abstains says nothing, but a
        text on which no voter fires is likelier to be clean."""
        fired = unpack(votes, len(self.weight))
        evidence = self.weight * (np.log(self.toxic_rate) - np.log(self.other_rate))
        silent = np.log1p(-self.toxic_rate).sum() / max(len(self.weight), 1) * 4
        logit = np.log(self.prior) - np.log1p(-self.prior) + fired @ evidence + (votes == 0) * silent
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def unpack(votes: np.ndarray, count: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(count, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)


def fit_label_model(votes: DataFrame, voters: int, start: LabelModel, rounds: int = 4) -> LabelModel:
    """Expectation maximisation; ``votes`` holds (votes, gold, n) with gold NULL
    where no training label is known.  A round moves voters x voters sums."""
    model = start
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], model: LabelModel = model) -> np.ndarray:
            out = np.zeros(2 + 2 * voters + 2 * voters * voters)
            for batch in batches:
                mask = np.asarray(batch.column("votes")).view(np.uint64)
                n = np.asarray(batch.column("n")).astype(np.float64)
                gold = np.asarray(batch.column("gold").cast(pa.float64()).fill_null(-1.0))
                r = np.where(gold < 0, model.posterior(mask), gold)
                fired = unpack(mask, voters)
                for k, w in enumerate((r * n, (1 - r) * n)):
                    out[k] += w.sum()
                    out[2 + k * voters : 2 + (k + 1) * voters] += w @ fired
                    at = 2 + 2 * voters + k * voters * voters
                    out[at : at + voters * voters] += ((fired * w[:, None]).T @ fired).ravel()
            return out

        sums = sum_vectors(votes, count, 2 + 2 * voters + 2 * voters * voters)
        mass = sums[:2] + 1e-9
        rates = (sums[2 : 2 + 2 * voters].reshape(2, voters) + 0.05) / (mass[:, None] + 0.1 * voters + 1)
        joint = sums[2 + 2 * voters :].reshape(2, voters, voters) / mass[:, None, None]
        rates = np.clip(rates, 1e-7, 1 - 1e-6)
        spread = np.sqrt(rates * (1 - rates))
        correlated = np.zeros((voters, voters))
        for k in range(2):
            rho = (joint[k] - np.outer(rates[k], rates[k])) / np.outer(spread[k], spread[k])
            correlated = np.maximum(correlated, np.clip(rho, 0, 1) * mass[k] / mass.sum() if k else np.clip(rho, 0, 1))
        np.fill_diagonal(correlated, 0)
        prior = float(np.clip(mass[0] / mass.sum(), 1e-4, 0.5))
        model = LabelModel(rates[0], rates[1], prior, 1 / (1 + (correlated**2).sum(axis=1)))
    return model


class Classifier(NamedTuple):
    lookup: Lookup
    weights: np.ndarray
    bias: float

    def score(self, texts: Texts) -> np.ndarray:
        at, who = self.lookup.find(*features(texts))
        pair = np.unique(who * np.int64(max(len(self.weights), 1)) + at)
        logit = self.bias + np.bincount(
            pair // max(len(self.weights), 1), self.weights[pair % max(len(self.weights), 1)], minlength=len(texts)
        )
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_classifier(
    rows: np.ndarray, cols: np.ndarray, target: np.ndarray, width: int, start: np.ndarray, steps: int = 300
) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with a small L2 penalty."""
    w, bias = 0.2 * start.copy(), -2.0
    g2, b2, n = np.full(width, 1e-8), 1e-8, max(len(target), 1)
    for _ in range(steps):
        logit = bias + np.bincount(rows, w[cols], minlength=len(target))
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target
        grad = np.bincount(cols, error[rows], minlength=width) / n + 1e-6 * w
        g2 += grad**2
        b2 += error.mean() ** 2
        w -= 0.3 * grad / np.sqrt(g2)
        bias -= 0.3 * error.mean() / np.sqrt(b2)
    return w, float(bias)


class VoteScorer:
    """Stands in for the classifier where no row is labelled: the label
    model's posterior of a text's votes; a text without votes is clean."""

    def __init__(self, voters: Voters, model: LabelModel):
        self.voters, self.model = voters, model

    def score(self, texts: Texts) -> np.ndarray:
        votes = self.voters.vote(*features(texts), len(texts))
        return np.where(votes == 0, 0.0, self.model.posterior(votes))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier | VoteScorer:
    """Voters, label model and classifier; see the module text.

    Only labels of rows outside the held-out fifth are read.  Without labels
    the lexicon voters alone train the label model.
    """
    sample = save_and_reload(_sample(docs, labels, sample_rows), "toxic-sample")
    mined, odds = mine(sample)
    voters = build_voters(mined)

    def cast_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            votes = voters.vote(*features(texts), len(texts))
            gold = part.column("toxic")
            yield pa.RecordBatch.from_arrays([pa.array(votes.view(np.int64)), gold], ["votes", "gold"])

    texts = docs.select(F.col("text").cast("string").alias("text"), F.lit(None).cast("int").alias("toxic"))
    votes = (
        texts.union(sample)
        .mapInArrow(cast_votes, "votes bigint, gold int")
        .groupBy("votes", "gold")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    votes = save_and_reload(votes, "toxic-votes")
    start = LabelModel(
        np.full(voters.count, 0.1), np.full(voters.count, 0.002), 0.1, np.full(voters.count, 0.5)
    )
    model = fit_label_model(votes, voters.count, start)

    lookup = Lookup(np.concatenate([mined, _word_hash([w for lexicon in LEXICONS for w in lexicon])]))
    width = len(lookup.sorted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            h, owner = features(texts)
            target = model.posterior(voters.vote(h, owner, len(texts)))
            at, who = lookup.find(h, owner)
            pair = np.unique(who * np.int64(width) + at)
            lists = np.split(pair % width, np.searchsorted(pair // width, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tolist() for x in lists], pa.list_(pa.int32())), pa.array(target)], ["cols", "target"]
            )

    if sample.isEmpty():
        return VoteScorer(voters, model)
    # At most sample_rows short lists reach the driver.
    fitted = sample.mapInArrow(project, "cols array<int>, target double").toArrow().combine_chunks()
    sizes = np.asarray(pc.list_value_length(fitted["cols"]), np.int64)
    cols = np.asarray(pc.list_flatten(fitted["cols"]), np.int64)
    begin = np.concatenate([odds, np.full(width - len(odds), 3.0)])
    weights, bias = fit_classifier(np.repeat(np.arange(len(sizes)), sizes), cols, fitted["target"].to_numpy(), width, begin)
    return Classifier(lookup, weights, bias)


def score_documents(docs: DataFrame, classifier: Classifier | VoteScorer) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row of ``docs``.

    The score depends on the text only.  NULL and empty texts score like a text
    without any known feature.  A NULL doc_id is not held out.  Repeated rows
    get equal rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(classifier.score(texts))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, score double"
    )
    return scored.select(
        "doc_id",
        F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, classifier: Classifier | VoteScorer) -> DataFrame:
    """The rows of ``docs`` scored below 0.5, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield part.filter(pa.array(classifier.score(texts) < 0.5))

    return docs.mapInArrow(run, docs.schema)
