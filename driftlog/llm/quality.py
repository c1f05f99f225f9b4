"""Rule checks and a hashed n-gram likelihood ratio for document quality.

Two multinomials over hashed byte n-grams are counted, one from trusted texts
and one from the whole raw corpus.  A document's score is the mean log ratio of
its n-grams, so it does not depend on length, and every document with a score
at or above its language's cut is kept: no sampling, no noise.  The cuts follow
from the scores of all trusted documents of the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlog.llm.reduce import sum_vectors
from driftlog.llm.text import SPACES, Texts, find_words, hash_spans, slices, windows
from driftlog.session import save_and_reload

BUCKET_BITS = 16
GRAM = 3
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
TRUSTED_TAIL = 0.005
SCORE_STEP = 1 / 256
SPREAD = 2
MARGIN = 0.02
LEAST_TRUSTED = 5
MOST_LANGUAGES = 1_000
TRUSTED_BLOCK = 1 << 20

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_CHAR_STARTS = (np.arange(256) & 0xC0) != 0x80


def gram_buckets(texts: Texts, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram inside one text, and bounds per text."""
    data = texts.data.astype(np.uint32)
    n = max(len(data) - GRAM + 1, 0)
    codes = data[:n] | data[1 : n + 1] << np.uint32(8) | data[2 : n + 2] << np.uint32(16) if n else data[:0]
    buckets = (codes * np.uint32(2_654_435_761)) >> np.uint32(32 - bits)
    inside = np.ones(n, bool)
    for back in range(1, GRAM):
        at = texts.bounds[1:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    # An n-gram across a border belongs to no text; short texts have none.
    kept = np.flatnonzero(inside)
    return buckets[kept].astype(np.int64), np.searchsorted(kept, texts.bounds)


def _count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    counts = np.zeros(1 << BUCKET_BITS)
    for _, texts in slices(batches):
        counts += np.bincount(gram_buckets(texts)[0], minlength=len(counts))
    return counts


class Model(NamedTuple):
    """Log ratio of trusted to raw probability per bucket, and the least score
    that is kept in each language; languages without a cut keep every score.

    ``cuts`` holds the ``MOST_LANGUAGES`` with most trusted documents; ``more``
    is a table (lang, cut) of all others, if there are any, and is joined."""

    ratios: np.ndarray
    cuts: dict[str | None, float]
    more: DataFrame | None = None

    def with_cuts(self, rows: DataFrame, lang: str) -> DataFrame:
        """``rows`` with the cut of a language that ``cuts`` does not hold."""
        if self.more is None:
            return rows.withColumn("_cut", F.lit(None).cast("double"))
        more = self.more.select(F.col("lang").alias("_cut_lang"), F.col("cut").alias("_cut"))
        return rows.join(more, rows[lang].eqNullSafe(F.col("_cut_lang")), "left").drop("_cut_lang")


def _least(cuts: dict[str | None, float], langs: pa.Array, others: pa.Array) -> np.ndarray:
    """The least kept score of each row."""
    other = others.fill_null(-np.inf).to_pylist()
    return np.array([cuts.get(lang, o) for lang, o in zip(langs.to_pylist(), other, strict=True)], np.float64)


def _columns(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")
    )


def train(docs: DataFrame, trusted: DataFrame, trusted_block: int = TRUSTED_BLOCK) -> Model:
    """The ratios and the cuts, from all of ``docs`` and all trusted documents.

    ``trusted`` names its documents in the column doc_id.  Their ids are
    broadcast in blocks of about ``trusted_block``, so no text is shuffled and
    every pass reads all of ``docs``.  Scores are uncentred: a language that is
    rarer among the trusted texts scores lower as a whole.  So each language
    has its own cut.  It lies ``SPREAD`` times as far below the median of its
    trusted documents as the score under which ``TRUSTED_TAIL`` of them lie, and
    ``MARGIN`` more; with fewer than ``LEAST_TRUSTED`` of them it has none.
    The cuts of the ``MOST_LANGUAGES`` with most of them are collected, those of
    all others stay a table.  Without any trusted text every ratio is 0 and
    nothing is cut.
    """
    ids = trusted.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct()
    ids = save_and_reload(ids, "trusted-ids")
    blocks = max(1, -(-ids.count() // trusted_block))

    def trusted_texts(block: int) -> DataFrame:
        own = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block)
        return _columns(docs).join(F.broadcast(own), "doc_id", "left_semi")

    size = 1 << BUCKET_BITS
    raw = sum_vectors(_columns(docs).select("text"), _count, size)
    target = sum(sum_vectors(trusted_texts(b).select("text"), _count, size) for b in range(blocks))
    if not target.sum():
        return Model(np.zeros(size), {})
    ratios = np.log((target + 0.5) / (target.sum() + 0.5 * size)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * size))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = measure(texts, ratios)
            fine = ~base_failed(found)
            step = np.floor(found["quality_score"] / SCORE_STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(step)], ["lang", "step"]).filter(pa.array(fine))

    scored = trusted_texts(0)
    for b in range(1, blocks):
        scored = scored.union(trusted_texts(b))
    counts = scored.select("lang", "text").mapInArrow(steps, "lang string, step bigint").groupBy("lang", "step").count()
    counts = save_and_reload(counts, "trusted-scores")
    upto = F.sum("count").over(Window.partitionBy("lang").orderBy("step"))
    total = F.sum("count").over(Window.partitionBy("lang"))
    # The steps of a language are bounded by the range of the ratios.
    cuts = (
        counts.select("lang", "step", upto.alias("upto"), total.alias("total"))
        .groupBy("lang")
        .agg(
            F.min(F.when(F.col("upto") > TRUSTED_TAIL * F.col("total"), F.col("step"))).alias("tail"),
            F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("step"))).alias("middle"),
            F.first("total").alias("total"),
        )
        .filter(F.col("total") >= LEAST_TRUSTED)
        .select("lang", "total", ((F.col("middle") - SPREAD * (F.col("middle") - F.col("tail"))) * SCORE_STEP - MARGIN).alias("cut"))
    )
    most = cuts.orderBy(F.col("total").desc(), "lang").limit(MOST_LANGUAGES).collect()
    more = None
    if len(most) == MOST_LANGUAGES:
        last = most[-1]
        behind = F.col("lang").isNotNull() if last.lang is None else F.col("lang") > last.lang
        rest = cuts.filter((F.col("total") < last.total) | ((F.col("total") == last.total) & behind)).select("lang", "cut")
        rest = save_and_reload(rest, "more-cuts")
        more = None if rest.isEmpty() else rest
    return Model(ratios, {r.lang: r.cut for r in most}, more)


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def _repeated_words(values: np.ndarray, first: np.ndarray, size: int) -> int:
    """Words covered by windows that occur at least twice."""
    if len(values) < 2:
        return 0
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    twice = np.zeros(len(values), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    marks = np.zeros(len(values) + size, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + size, -1)
    return int((np.cumsum(marks) > 0).sum())


def measure(texts: Texts, ratios: np.ndarray) -> dict[str, np.ndarray]:
    """The rule counts and the score of each text."""
    words = find_words(texts)
    counts = words.counts()
    spans = hash_spans(texts.data, words.starts, words.ends)
    values, first = windows(spans, words, 5)
    cuts = np.searchsorted(first, words.bounds)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[texts.bounds[1:]] - sums[texts.bounds[:-1]]

    buckets, bounds = gram_buckets(texts)
    sums = np.concatenate(([0.0], np.cumsum(ratios[buckets])))
    grams = np.diff(bounds)
    return {
        "n_words": counts,
        "word_chars": per_text(_CHAR_STARTS[texts.data] & ~SPACES[texts.data]),
        "n_symbols": per_text(_SYMBOLS[texts.data]),
        "n_dup_lines": np.array([_duplicate_lines(texts.raw(i)) for i in range(len(texts))], np.int64),
        "n_repeat_words": np.array(
            [_repeated_words(values[a:b], first[a:b], 5) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.int64
        ),
        "quality_score": (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(grams, 1),
    }


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    words = found["n_words"]
    return (words < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEATED_PERCENT * words)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, rule counts, quality_score, base_failed and kept, one row per row.

    NULL and empty texts have no words, fail the base rules and are dropped.
    A text without n-grams scores 0.  Repeated rows get equal rows; other
    columns are ignored.
    """

    ratios, cuts = model.ratios, model.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = measure(texts, ratios)
            failed = base_failed(found)
            kept = ~failed & (found["quality_score"] >= _least(cuts, part.column(2), part.column(3)))
            columns = [pa.array(found[name].astype(np.int64)) for name in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *columns, pa.array(found["quality_score"]), pa.array(failed), pa.array(kept)],
                ["doc_id", *COUNTS, "quality_score", "base_failed", "kept"],
            )

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", quality_score double, base_failed boolean, kept boolean"
    return model.with_cuts(_columns(docs), "lang").mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a good verdict, all columns unchanged."""

    ratios, cuts = model.ratios, model.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = measure(texts, ratios)
            own = part.num_columns - 2
            kept = ~base_failed(found) & (found["quality_score"] >= _least(cuts, part.column(own), part.column(own + 1)))
            yield part.select(list(range(own))).filter(pa.array(kept))

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return model.with_cuts(docs.select("*", lang.alias("_lang")), "_lang").mapInArrow(run, docs.schema)
