"""Inputs that once gave wrong results."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from made_texts import prose
from test_pairs_and_mix import brute
from tokenizers import Tokenizer

from driftlog.llm import licenses, minhash, quality, simple8b, text, toxicity
from driftlog.session import scratch_path


def thue_morse(letters: str) -> str:
    return "".join(letters[bin(i).count("1") % 2] for i in range(1024))


def test_sums_that_cancel_do_not_share_a_hash():
    words = [thue_morse("ab"), thue_morse("ba"), thue_morse("aB"), "x" * 5000, "x" * 4999 + "y"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    assert len(set(text.hash_spans(data, starts, ends).tolist())) == len(words)
    assert text.same_spans(data, starts, ends, data, starts, ends).all()
    assert not text.same_spans(data, starts[:1], ends[:1], data, starts[1:2], ends[1:2]).any()


def test_hashes_follow_the_bytes():
    rng = random.Random(1)
    words = [bytes(rng.randrange(97, 99) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    hashes = text.hash_spans(data, ends - [len(w) for w in words], ends)
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist(), strict=True)))


def test_long_words_stay_apart(make_docs, spark):
    docs = make_docs([(1, thue_morse("ab")), (2, thue_morse("ba")), (3, thue_morse("ab"))])
    groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 1}
    model = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(model)
    path = scratch_path(spark, "ids")
    simple8b.write_ids(docs, model, path)
    got = {r.doc_id: list(r.ids) for r in simple8b.read_ids(simple8b.locate_files(spark, path)).collect()}
    for doc_id, letters in ((1, "ab"), (2, "ba"), (3, "ab")):
        assert got[doc_id] == [*library.encode(thue_morse(letters), add_special_tokens=False).ids, 1]


def test_words_that_share_a_hash_are_encoded_alone(monkeypatch):
    model = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(model)
    # Words of up to eight bytes keep their own hashes, as they always do.
    real = text.hash_spans
    monkeypatch.setattr(
        simple8b, "hash_spans",
        lambda data, starts, ends: np.where(ends - starts > 8, (ends - starts).astype(np.uint64), real(data, starts, ends)),
    )
    coder = simple8b.WordEncoder(open(model, encoding="utf-8").read())
    line = "red fox greetings don't mountains \u00e9t\u00e9\u00e9t\u00e9\u00e9 Mountains notebooks \u00e9t\u00ea\u00e9t\u00ea\u00ea greetings"
    raw = np.frombuffer(line.encode(), np.uint8)
    ids, _ = coder.encode(text.Texts(raw, np.array([0, len(raw)])))
    assert ids.tolist() == library.encode(line, add_special_tokens=False).ids


@pytest.mark.parametrize("members", [200, 400])
def test_families_lose_no_link(make_docs, members):
    """Texts that share a long passage and are all just below the threshold,
    with pairs among them that are above it."""
    rng = random.Random(members)
    passage = prose(77, 277)
    rows = []
    for i in range(members):
        twin = i // 2 if i < 60 else i
        own = random.Random(f"{members} {twin}")
        tail = [f"w{own.randrange(10**9)}" for _ in range(27)]
        if i < 60 and i % 2:
            tail[-3:] = [f"v{rng.randrange(10**9)}" for _ in range(3)]
        rows.append((i, passage + " " + " ".join(tail)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert got == brute(rows)
    assert sum(got[i] == i - 1 for i in range(1, 60, 2)) == 30


def test_without_labels_clean_texts_stay(make_docs, spark):
    rows = [(i, prose(i, 30) + (" you stupid idiot moron" if i % 5 == 0 else "")) for i in range(1, 51)]
    docs = make_docs([*rows, (99, None), (100, "")])
    for labels in ([], [(5, 1, 1), (10, 1, 0)]):  # none, and held-out ones only
        named = [r for r in labels if __import__("zlib").crc32(str(r[0]).encode()) % 5 == 0]
        table = spark.createDataFrame(named, "doc_id long, quality int, toxic int")
        model = toxicity.train(docs, table)
        got = toxicity.score_documents(docs, model).collect()
        assert len(got) == 52 and all(0 <= r.score <= 1 for r in got)
        assert all(r.predicted == 0 for r in got if r.doc_id % 5 or r.doc_id == 100)
        assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} >= {i for i in range(1, 51) if i % 5}


def test_minority_languages_pass(spark):
    """Languages that are rarer among trusted texts are not rejected whole."""
    letters = {"en": "abcdefg", "de": "hijklmn"}
    words = {k: ["".join(random.Random(i).choices(v, k=4)) for i in range(30)] for k, v in letters.items()}

    def line(seed: int, lang: str) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(words[lang]) for _ in range(120))

    rows = [(i, line(i, "en" if i % 5 else "de"), "en" if i % 5 else "de") for i in range(300)]
    junk = [(1000 + i, "#$%^ " * 40 + " ".join(f"{k}{i}" for k in range(30)), "de") for i in range(40)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i, _, lang in rows if lang == "en" or i % 25 == 0], "doc_id long")
    model = quality.train(docs, trusted)
    kept = {r.doc_id for r in quality.score_documents(docs, model).filter("kept").collect()}
    assert kept == {i for i, _, _ in rows}
    assert {r.doc_id for r in quality.keep_good(docs, model).collect()} == kept
    split = quality.train(docs, trusted, trusted_block=50)
    assert np.allclose(split.ratios, model.ratios) and split.cuts == model.cuts


def test_edits_never_change_the_licence():
    for words in ("released under the mpl license today", "the bit license", "all rights deserved here"):
        assert "mit" not in {f.label for f in licenses.find_notices(words)}
        assert "proprietary" not in {f.label for f in licenses.find_notices(words)}
    found = licenses.find_notices("code relesed under the mit license x " * 2)
    assert [(f.label, f.first_word, f.last_word) for f in found] == [("mit", 1, 5), ("mit", 8, 12)]
    own = (("shared under the blue accord", "blue", "blue"),)
    assert [f.label for f in licenses.find_notices("shred under the blue accord", own)] == ["blue"]
    assert not licenses.find_notices("shared under the glue accord", own)


def test_scanning_nothing(make_docs):
    assert licenses.scan_documents(make_docs([])).count() == 0
