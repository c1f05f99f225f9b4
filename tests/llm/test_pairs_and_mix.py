"""Near duplicates and mixing against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from made_texts import prose

from driftlog.llm import minhash, mixing
from driftlog.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets[i] = min(sets[i], text or "") if i in sets else (text or "")
    sets = {i: shingles(t) for i, t in sets.items()}
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_near_duplicates_on_edge_rows(make_docs, edge_rows):
    got = minhash.near_duplicates(make_docs(edge_rows, clash=True)).collect()
    want = brute(edge_rows)
    assert len(got) == len(edge_rows)
    for row in got:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert row.component_id == want[row.doc_id]
            assert row.kept == (row.doc_id == row.component_id)


def test_chain_and_star_of_near_copies(make_docs):
    """A chain whose ends are unlike, and many copies only like their centre."""
    words = prose(9, 200).split()
    rows = [(100 + k, " ".join(["z%d" % i for i in range(k)] + words[k:])) for k in range(0, 30, 3)]
    centre = prose(10, 300).split()
    rows += [(1, " ".join(centre))]
    for k in range(40):
        changed = list(centre)
        changed[7 * k + 5] = f"y{k}"
        changed[(7 * k + 150) % 300] = f"x{k}"
        rows.append((1000 + k, " ".join(changed)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_near_duplicates_of_nothing(make_docs):
    docs = make_docs([])
    assert minhash.near_duplicates(docs).count() == 0
    assert minhash.drop_near_duplicates(docs).count() == 0


def test_dropping_keeps_columns_and_unnamed_rows(make_docs, edge_rows):
    docs = make_docs(edge_rows, clash=True)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    want = brute(edge_rows)
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert ids == sorted(i for i, _ in edge_rows if i is not None and want[i] == i)
    assert left.filter("doc_id is null").count() == 2


def test_signature_densifies_every_bin():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 5, dtype=np.uint64))
    sig = minhash.signatures(values, np.array([0, 1, 5]), 192)
    assert sig.shape == (2, 192) and set(sig[0]) == {values[0]} and set(sig[1]) <= set(values[1:])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_sainte_lague_follows_the_quotients():
    rng = np.random.default_rng(3)
    for _ in range(30):
        claims = rng.integers(0, 50, 6).astype(float)
        most = rng.integers(0, 20, 6)
        seats = int(rng.integers(0, 60))
        given = np.zeros(6, int)
        for _ in range(min(seats, int(np.where(claims > 0, most, 0).sum()))):
            q = np.where((given < most) & (claims > 0), claims / (2 * given + 1), -1)
            given[int(np.argmax(q))] += 1
        assert mixing.sainte_lague(claims, seats, most).tolist() == given.tolist()


def test_targets_are_capped_and_reshared():
    sizes = np.array([10, 100, 100])
    got = mixing.capped_targets(sizes, np.array([5.0, 2.0, 1.0]), 315.0, 2.0)
    assert got.tolist() == pytest.approx([20.0, 295 * 2 / 3, 295 / 3])


def test_mix_takes_what_its_targets_say(make_docs):
    rows = [(i, prose(i, 5 + i % 90), f"s{i % 4}" if i % 9 else None) for i in range(400)]
    rows += [(None, "a b c", "s1")] * 3 + [(3, None, "s0"), (4, "", "s0"), (7, prose(7, 50), "s3"), (7, prose(7, 50), "s3")]
    docs = make_docs(rows, clash=True)
    first = mixing.mix(docs, block=4, shard_words=900).collect()
    again = mixing.mix(docs.repartition(5), block=4, shard_words=900).collect()
    assert sorted(first, key=repr) == sorted(again, key=repr) and len(first) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = {n: sum(len((r[1] or "").split()) for r in rows if r[2] == n) for n in names}
    weights = np.array([5.0, 2.0, 1.0, 5.0, 2.0])
    targets = mixing.capped_targets(np.array([sizes[n] for n in names]), weights, 1.5 * sum(sizes.values()), 2.0)
    for name, target in zip(names, targets, strict=True):
        own = [r for r in first if r.source == name]
        assert {r.source_size for r in own} == {sizes[name]}
        assert {round(r.target, 6) for r in own} == {round(target, 6)}
        assert abs(sum(r.taken for r in own) - target) <= 12
    assert all(r.taken <= 2 * r.size for r in first)


def test_mixed_documents_hold_the_words_taken(make_docs):
    rows = [(i, prose(i, 5 + i % 90), f"s{i % 3}") for i in range(120)] + [(900, "", "s0"), (None, None, None)]
    docs = make_docs(rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, block=4).collect()}
    out = mixing.mix_documents(docs, block=4)
    assert out.columns == docs.columns
    found: dict = {}
    for r in out.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert found == {i: n for i, n in taken.items() if n}
    assert mixing.mix(make_docs([])).count() == 0 and mixing.mix_documents(make_docs([])).count() == 0
