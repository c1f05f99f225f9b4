"""Links, cuts and windows that a bound must not leave out."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_pairs_and_mix import brute

from driftlog.llm import attention, components, lm, minhash, quality, reduce


def near_threshold():
    """Pairs and chains around the threshold, most of them just above it."""
    rng = random.Random(4)
    rows = []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(104)]
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 4):
            other = list(words)
            first = rng.randrange(10, 90)
            for at in range(first, first + rng.randrange(3, 7)):
                other[at] = f"v{k}x{j}x{at}"
            rows.append((10 * k + j, " ".join(other)))
    return rows


@pytest.mark.parametrize("rows", [6, 40])
def test_no_link_depends_on_the_bands(make_docs, rows):
    """With one long band hardly any link is proposed by a bucket."""
    texts = near_threshold()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(texts), bands=1, rows=rows).collect()}
    assert got == brute(texts)
    assert 0 < sum(got[i] != i for i in got) < len(got)


def test_open_pairs_hold_every_link_at_the_threshold(spark):
    """Rare shingles of one text come first in its order, so the first common
    shingle stands late and what follows it must be counted from there."""
    texts = near_threshold()
    nodes = spark.createDataFrame([(i, i) for i, _ in texts], "id long, component long")
    table = spark.createDataFrame(texts, "id long, text string")
    found = {(r.u, r.v) for r in minhash._open_pairs(nodes, table, minhash.THRESHOLD).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(100)} for i, t in texts}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert want and want <= found


def test_every_language_has_its_cut(spark, make_docs, monkeypatch):
    """The cuts of languages beyond those collected are joined, not dropped."""
    rng = random.Random(6)
    langs = [None, "a", "b", "c", "d"]
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(30))) for i in range(60)]
    junk = [(100 + i, " ".join("".join(rng.choices("xqzjkw", k=7)) for _ in range(30))) for i in range(10)]
    docs = make_docs(good + junk).drop("lang")
    named = spark.createDataFrame([(i, langs[i % 5]) for i, _ in good + junk], "id long, lang string")
    docs = docs.join(named, docs.doc_id == named.id).drop("id")
    trusted = spark.createDataFrame([(i,) for i, _ in good], "doc_id long")
    whole = quality.train(docs, trusted)
    assert whole.more is None and set(whole.cuts) == set(langs)
    want = {r.doc_id for r in quality.score_documents(docs, whole).filter("kept").collect()}
    assert not want & {i for i, _ in junk}
    monkeypatch.setattr(quality, "MOST_LANGUAGES", 2)
    bounded = quality.train(docs, trusted)
    assert len(bounded.cuts) == 2 and {**bounded.cuts, **{r.lang: r.cut for r in bounded.more.collect()}} == whole.cuts
    assert {r.doc_id for r in quality.score_documents(docs, bounded).filter("kept").collect()} == want
    left = quality.keep_good(docs, bounded)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == want


def test_all_rounds_together_learn_from_every_window(spark, monkeypatch):
    """Each rare word of each training text is a target, not those of one
    window a text; texts that are held out are none."""
    rng = np.random.default_rng(2)
    streams, want = [], 0
    for i in range(40):
        data = rng.integers(1, 40, rng.integers(1, 900)).astype(np.uint8)
        data[rng.random(len(data)) < 0.05] |= lm.RARE
        streams.append((bytearray(data.tobytes() + b"\0"), i % 4 == 0))
        want += int((data >= lm.RARE).sum()) if i % 4 else 0
    table = spark.createDataFrame(streams, "classes binary, held_out boolean").coalesce(1)
    monkeypatch.setattr(attention, "TRAIN_BATCH", 8)
    seen = []
    monkeypatch.setattr(lm, "sum_vectors", lambda df, count, size: count(iter(df.toArrow().to_batches())))
    monkeypatch.setattr(lm, "LEAST_STEPS", 1)
    monkeypatch.setattr(
        attention, "train_locally",
        lambda theta, batches, steps, rate: (seen.extend(b for b, _ in zip(batches, range(steps), strict=False)), theta)[1],
    )
    for block in (1 << 25, 2_000):
        monkeypatch.setattr(lm, "BLOCK_BYTES", block)
        seen.clear()
        lm._train(table, attention.initial(np.ones(attention.CLASSES)), 3)
        scored = {(i.tobytes(), t.tobytes()): int(s.sum()) for b in seen for i, _, t, s in zip(*b, strict=True)}
        assert sum(scored.values()) == want


def test_training_learns_every_subword_and_end(make_docs, monkeypatch):
    """Words seen again and again are targets as well, and so are the ends;
    texts that are held out are none."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(i, "the cat sat on the mat and the cat sat " * (i % 9)) for i in range(30)] + [(None, None), (31, "unheard-of")]
    with open(ranks, encoding="ascii") as file:
        encoding = lm._encoding(file.read())
    want = 0
    for i, text in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            want += 1 + sum(len(encoding.encode_ordinary(" " + w)) for w in (text or "").split())
    found = []

    def train(streams, theta, rounds):
        lists = [bytes(r.classes) for r in streams.filter("not held_out").collect()]
        examples = next(lm._blocks(iter([pa.RecordBatch.from_pydict({"classes": lists})])))
        found.append(int(sum(examples.batch(examples.which[i : i + 7])[3].sum() for i in range(0, len(examples.which), 7))))
        held = [bytes(r.classes) for r in streams.filter("held_out").collect()]
        found.append(sum(max(x) >= lm.LEARNED for x in held))
        return theta

    monkeypatch.setattr(lm, "_train", train)
    assert lm.score_documents(make_docs(rows), ranks).count() == len(rows)
    assert found == [want, 0]


def test_gradients_of_windows_and_of_places_agree():
    rng = np.random.default_rng(6)
    theta = attention.initial(rng.random(attention.CLASSES) * 100) + rng.normal(0, 0.1, attention.SIZE).astype(np.float32)
    bounds = np.array([0, 1, 20, 24, 90, 500])
    windows = attention.Windows(rng.integers(0, attention.CLASSES, 500).astype(np.uint8), bounds)
    inputs, valid, targets, scored = windows.rows(np.arange(len(windows.stream)))
    parts = [f(theta, inputs, valid, targets, scored.astype(np.float32)) for f in (attention._gradient_of_windows, attention._gradient_of_places)]
    assert np.allclose(*parts, atol=1e-6) and np.abs(parts[0]).max() > 0.01


def test_training_only_computes_scored_places(monkeypatch):
    """A batch with one scored place costs one row of attention and logits,
    and has the same gradient as alone."""
    rng = np.random.default_rng(3)
    theta = attention.initial(np.ones(attention.CLASSES))
    data = rng.integers(1, 40, 3_000).astype(np.uint8)
    inputs, valid, targets, _ = attention.Windows(data, np.array([0, 3_000])).rows(np.arange(100))
    scored = np.zeros(targets.shape, np.float32)
    scored[7, 5] = 1
    seen, exp = [], attention._exp
    monkeypatch.setattr(attention, "_exp", lambda values: (seen.append(values.size), exp(values))[1])
    got = attention.gradient(theta, inputs, valid, targets, scored)
    assert sum(seen) == attention.WIDTH + attention.CLASSES
    alone = attention.gradient(theta, inputs[7:8], valid[7:8], targets[7:8], scored[7:8])
    assert np.allclose(got, alone, atol=1e-7) and np.abs(got).max() > 0


def test_scoring_computes_inputs_once_for_all_batches(monkeypatch):
    """Queries, keys and values of a class at a place are computed once, not in
    every window; each chance is that of the model taken place by place."""
    rng = np.random.default_rng(4)
    theta = attention.initial(rng.random(attention.CLASSES) * 100)
    theta += rng.normal(0, 0.2, attention.SIZE).astype(np.float32)
    sizes = [1, 23, 24, 25, 48, 49, 130]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    data = rng.integers(1, attention.CLASSES, bounds[-1]).astype(np.uint8)
    data[bounds[1:] - 1] = attention.END
    p, want = attention.views(theta.astype(np.float64)), []
    for start, size in zip(bounds[:-1], sizes, strict=True):
        for at in range(size):
            first = at // attention.STRIDE * attention.STRIDE - (attention.WIDTH - attention.STRIDE)
            seen = [i for i in range(first, at + 1) if i >= 0]
            x = np.array([p["embed"][data[start + i - 1] if i else attention.END] + p["place"][i - first] for i in seen])
            weights = np.exp(x @ p["key"] @ (x[-1] @ p["query"]) / np.sqrt(attention.DIM))
            h = x[-1] + weights @ (x @ p["value"]) / weights.sum() @ p["mix"]
            z = h + np.maximum(h @ p["up"] + p["up_bias"], 0) @ p["down"] + p["down_bias"]
            logits = z @ p["out"] + p["out_bias"]
            want.append(logits[data[start + at]] - np.log(np.exp(logits).sum()))
    tables, make = [], attention.Scorer.__init__
    monkeypatch.setattr(attention.Scorer, "__init__", lambda self, theta: (tables.append(1), make(self, theta))[1])
    monkeypatch.setattr(attention, "BATCH", 3)
    assert np.allclose(attention.score_streams(theta, data, bounds), want, rtol=1e-4, atol=1e-4)
    assert len(tables) == 1
    assert len(attention.score_streams(theta, data[:0], bounds[:1])) == 0


def test_scoring_holds_a_few_texts_at_a_time():
    """Slices have all rows in their order, and only a text alone is larger than a slice."""
    sizes = [0, 3, 9, 1, 1, 40, 0, 7, 4, 30, 2]
    rows = pa.RecordBatch.from_pydict({"doc_id": [*range(len(sizes))], "classes": [b"x" * n for n in sizes]})
    batches = iter([rows.slice(0, 6), rows.slice(6, 0), rows.slice(6)])
    cuts = [c.column("doc_id").to_pylist() for c in lm._row_slices(batches, 10)]
    assert cuts == [[0, 1], [2, 3], [4], [5], [6, 7], [8], [9], [10]]


def test_links_that_are_stars_take_no_pass(spark, monkeypatch):
    passes, step = [], components._larger_to_least
    monkeypatch.setattr(components, "_larger_to_least", lambda edges: (passes.append(1), step(edges))[1])
    stars = spark.createDataFrame([(1, 5), (9, 1), (2, 3), (4, 4)], "u long, v long")
    got = {r.id: r.component for r in components.connected_components(stars).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 2: 2, 3: 2} and not passes
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    found = components.connected_components(chain).collect()
    assert {r.id for r in found if r.component == 0} == set(range(21)) and len(found) == 21 and passes


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_sums_reach_the_driver_in_slices(spark, monkeypatch, parts):
    size = 2 * reduce.SLICE + 5
    sizes, collect = [], type(spark.range(1)).collect

    def spied(df):
        rows = collect(df)
        sizes.extend(len(r.v) for r in rows if "v" in df.columns)
        return rows

    monkeypatch.setattr(type(spark.range(1)), "collect", spied)
    table = spark.range(0, 100, 1, parts)

    def count(batches):
        out = np.zeros(size)
        for batch in batches:
            np.add.at(out, np.asarray(batch.column(0)) * 600, 1.0)
        return out

    got = reduce.sum_vectors(table, count, size)
    want = np.zeros(size)
    want[np.arange(100) * 600] = 1
    assert (got == want).all() and sizes and max(sizes) <= 8 * reduce.SLICE
