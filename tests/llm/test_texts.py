"""Operators that judge or encode single texts, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from made_texts import prose
from tokenizers import Tokenizer

from driftlog.llm import bpe, licenses, lm, quality, simple8b, toxicity

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def rows_by_text(df):
    return sorted(df.collect(), key=repr)


# ------------------------------------------------------------------ quality


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rule_counts(make_docs, edge_rows):
    rows = edge_rows + [(20, "a b\na b\n\n \na b"), (21, "x " * 30), (22, "é# b*\n" * 3), (23, prose(5, 20) + "\n" + prose(5, 20))]
    got = quality.score_documents(make_docs(rows, clash=True), quality.Model(np.zeros(1 << quality.BUCKET_BITS), {})).collect()
    found = Counter((r.doc_id, *[r[c] for c in quality.COUNTS], r.base_failed) for r in got)
    want = Counter()
    for i, text in rows:
        n = rules(text)
        want[(i, *n, n[0] < 10 or 100 * n[4] > 20 * n[0])] += 1
    assert found == want
    assert all(r.kept == (not r.base_failed) for r in got)


def test_ratio_is_the_multinomials(make_docs, spark):
    rows = [(1, "abcabc"), (2, "xyz###"), (3, None), (4, "ab"), (None, "q")]
    ratios = quality.train(make_docs(rows), spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id long"))
    size = 1 << quality.BUCKET_BITS
    raw, target = np.zeros(size), np.zeros(size)
    for i, text in rows:
        for k in range(len(text or "") - 2):
            a, b, c = text.encode()[k : k + 3]
            bucket = ((a | b << 8 | c << 16) * 2_654_435_761 & 0xFFFFFFFF) >> (32 - quality.BUCKET_BITS)
            raw[bucket] += 1
            target[bucket] += i == 1
    want = np.log((target + 0.5) / (target.sum() + size / 2)) - np.log((raw + 0.5) / (raw.sum() + size / 2))
    assert np.allclose(ratios.ratios, want)
    none = quality.train(make_docs(rows), spark.createDataFrame([], "doc_id long"))
    assert not none.ratios.any() and not none.cuts


def test_keeping_passes_all_columns(make_docs, edge_rows):
    docs = make_docs(edge_rows, clash=True)
    ratios = quality.Model(np.zeros(1 << quality.BUCKET_BITS), {})
    kept = quality.keep_good(docs, ratios)
    assert kept.columns == docs.columns
    assert kept.count() == quality.score_documents(docs, ratios).filter("kept").count()
    assert quality.keep_good(make_docs([]), ratios).count() == 0


# ----------------------------------------------------------------- toxicity


def test_toxicity_learns_unknown_words(make_docs, spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = prose(i, 60).split()
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(50), rng.choice(["idiot", "zorku", "zorkan", "blivsa"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(None, "zorkan idiot"), (5000, None), (5001, ""), (5002, prose(1, 50_000))]
    docs = make_docs(rows, clash=True)
    classifier = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_documents(docs, classifier).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in range(900))
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[None].predicted == 1 and got[5001].predicted == 0 and got[5000].score == got[5001].score
    clean = toxicity.keep_clean(docs, classifier)
    assert clean.columns == docs.columns and clean.count() == sum(r.predicted == 0 for r in got.values())


def test_toxicity_without_labels(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(i, prose(i, 30) + (" idiot moron" if i % 5 == 0 else "")) for i in range(50)])
    assert toxicity.score_documents(docs, toxicity.train(docs, none)).count() == 50
    empty = make_docs([])
    assert toxicity.score_documents(empty, toxicity.train(empty, none)).count() == 0


# ---------------------------------------------------------------- token ids


def hard_texts():
    rng = random.Random(8)
    texts = ["", "a" * 900, " " * 300, "x<|endoftext|> y", "<|startoftext|>A", "it's'll 12 34\r\n\x1c\x85 z"]
    texts += ["".join(rng.choice("aab  bc") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(32, 126), rng.randint(0x300, 0x36F)])) for _ in range(25)) for _ in range(60)]
    return texts + [prose(1, 500)]


def test_bpe_equals_the_library(make_docs, edge_rows):
    rows = edge_rows + [(100 + i, t) for i, t in enumerate(hard_texts())]
    docs = make_docs(rows, clash=True)
    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, BYTES).collect())) == want
    encoded = bpe.encode_documents(docs, BYTES)
    texts = Counter((r.doc_id, r.text) for r in bpe.decode_documents(encoded, BYTES).collect())
    assert texts == Counter((i, t or "") for i, t in rows)


def test_simple8b_packs_any_number():
    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 5_000):
        for high in (1, 2, 300, 1 << 20, 1 << 45):
            values = rng.integers(0, high, n).astype(np.uint64)
            values[3::11] = np.uint64((1 << 63) + 9)
            words, starts, escapes = simple8b.pack(values)
            assert (simple8b.unpack(words, starts, escapes, n) == values).all()


def test_token_id_files(make_docs, edge_rows, spark, tmp_path):
    rows = edge_rows + [(100 - i, t) for i, t in enumerate(hard_texts())]
    path = str(tmp_path / "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    simple8b.write_ids(make_docs(rows, clash=True), WORDS, path, file_ids=3_000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = simple8b.read_ids(simple8b.locate_files(spark, path)).orderBy("start").collect()
    library = Tokenizer.from_file(WORDS)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, text) in zip(got, order, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        start += len(ids)
    digests = simple8b.read_ids(simple8b.locate_files(spark, path), digest=True).orderBy("start").collect()
    assert [r.ids_crc32 for r in digests] == [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got]
    assert len(list((tmp_path / "ids").glob("part-*"))) > 1


# ----------------------------------------------------------------- licences


def test_exact_phrases(make_docs, edge_rows):
    rows = edge_rows + [
        (30, "The MIT-License, and mit\nlicense; CC BY-SA"), (31, "GNU General Public  License"), (32, "amit license"),
        (33, "Apache Licenses apache license"), (34, "cc" ), (35, "by cc"),
    ]
    got = licenses.scan_documents(make_docs(rows, clash=True)).collect()
    want = Counter()
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        want[(i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_fuzzy_notices_and_spans(make_docs):
    rows = [(1, "foo: Permision is herby granted, free of charge, to any persn obtaining a copy of this software"), (2, "all right reserved"), (3, "all things reserved"), (4, "released under the mit license " * 300)]
    got = {r.doc_id: r for r in licenses.scan_documents(make_docs(rows)).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.9 < got[1].score < 1
    span = got[1].notices[0]
    assert (span.first_word, span.last_word, span.edits) == (1, 16, 3)
    assert got[2].labels == "proprietary" and got[3].labels == ""
    assert got[4].n_base == 300 and len(got[4].notices) == 300


# ------------------------------------------------------------ language model


def test_language_model(make_docs, edge_rows):
    rows = edge_rows + [(200 + i, prose(i, 80)) for i in range(60)]
    docs = make_docs(rows, clash=True)
    got = lm.score_documents(docs, RANKS, rounds=1).collect()
    assert len(got) == len(rows)
    counts: Counter = Counter()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    for i, text in rows:
        if not held[i]:
            counts.update((text or "").encode().lower().split() + ["<end>"])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, text in rows:
        tokens = (text or "").encode().lower().split() + ["<end>"]
        base = sum(np.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens)
        want[(i, held[i], len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 3))] += 1
    found = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got)
    assert found == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_documents(make_docs([]), RANKS, rounds=1).count() == 0


def test_gradient_and_single_scoring():
    from driftlog.llm import attention as att

    rng = np.random.default_rng(0)
    theta = att.initial(np.ones(att.CLASSES)).astype(np.float64)
    streams = rng.integers(1, att.CLASSES, 70).astype(np.uint8)
    bounds = np.array([0, 1, 30, 70])
    windows = att.Windows(streams, bounds)
    inputs, valid, targets, scored = windows.rows(np.arange(len(windows.stream)))
    assert scored.sum() == 70 and (targets[scored] == streams).all()

    def loss(t):
        return -(att.log_probabilities(t, inputs, valid, targets) * scored).sum() / scored.sum()

    grad = att.gradient(theta, inputs, valid, targets, scored.astype(float))
    for at in rng.integers(0, att.SIZE, 25):
        step = np.zeros(att.SIZE)
        step[at] = 1e-5
        assert grad[at] == pytest.approx((loss(theta + step) - loss(theta - step)) / 2e-5, abs=2e-5)
    # A later token does not change an earlier score.
    before = att.score_streams(theta, streams, bounds)
    changed = streams.copy()
    changed[69] = (changed[69] + 1) % att.CLASSES
    assert np.allclose(before[:69], att.score_streams(theta, changed, bounds)[:69])
