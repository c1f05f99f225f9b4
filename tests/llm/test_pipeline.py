"""The pipeline: each stage's decisions by brute force on a small fixture."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from made_texts import prose
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_pairs_and_mix import shingles
from tokenizers import Tokenizer

import corpus_pipeline
from driftlog.session import save_and_reload, scratch_path

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def fixture(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, prose(i, 80 + i % 50), f"s{i % 3}") for i in range(120)]
    toxic = [(200 + i, prose(200 + i, 60) + " you stupid idiot moron", "s1") for i in range(40)]
    junk = [(300 + i, "#$%& " * 60 + str(i), "s2") for i in range(10)] + [(320, "three words only", "s0")]
    near = []
    for i in range(10):
        words = prose(400 + i, 200).split()
        near.append((400 + 2 * i, " ".join(words), "s0"))
        words[100] = f"x{rng.randrange(10**6)}"
        near.append((401 + 2 * i, " ".join(words), "s1"))
    near += [(500, prose(0, 80), "s0"), (501, prose(0, 80), "s0")]
    odd = [(None, prose(600, 90), "s0"), (None, None, None), (601, None, "s1"), (602, "", None), (603, prose(603, 20_000), "s2"),
           (604, prose(604, 70), None), (604, prose(604, 70), None), (605, prose(605, 30), "tiny")]
    docs = make_docs(rows + toxic + junk + near + odd, clash=True)
    path = scratch_path(spark, "pipeline-input")
    docs.write.parquet(f"{path}/documents.parquet")
    marks = [(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 1, 1) for i in range(40)] + [(300 + i, 0, 0) for i in range(10)]
    spark.createDataFrame(marks, LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def columns_of(docs):
    return [c for c in docs.columns]


def test_stages_decide_what_they_say(spark, fixture):
    docs = spark.read.parquet(f"{fixture}/documents.parquet")
    names = columns_of(docs)
    tables = {"start": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save_and_reload(stage(spark, docs, fixture), name)
        assert docs.columns == names
        tables[name] = docs
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in tables.items()}
    good = ids["quality_rules"]
    assert not good & {*range(300, 310), 320, 601, 602} and good >= set(range(120)) | set(range(400, 420)) | {603, 604, 605, None}
    clean = ids["toxicity"]
    assert not clean & set(range(200, 240)) and clean == good - set(range(200, 240))
    # One of every group at 0.8, by the full sets.
    sets = {r.doc_id: shingles(r.text) for r in tables["toxicity"].collect() if r.doc_id is not None}
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                group[max(root(a), root(b))] = min(root(a), root(b))
    assert ids["near_duplicates"] - {None} == {i for i in sets if root(i) == i}
    assert tables["near_duplicates"].filter("doc_id = 604").count() == 2
    # Every source gets about its target, also one with a single short text.
    size = lambda df: Counter({r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split("text", r"\\s+"))).alias("n")).collect()})
    before, after = size(tables["near_duplicates"]), size(tables["source_mix"])
    assert after["tiny"] == 2 * before["tiny"]
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) <= 1_024
    texts = {r.doc_id: r.text for r in tables["near_duplicates"].collect()}
    for r in tables["source_mix"].collect():
        assert set(r.text.split()) <= set(texts[r.doc_id].split()) and r.n_chars == len(r.text)
    # Encoding and decoding, by the library.
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in tables["source_mix"].collect():
        own = library.encode(r.text, add_special_tokens=False).ids
        digest = hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        want[(r.doc_id, len(own), digest, hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest())] += 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, fixture)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last.collect())
    assert got == want
    # Runs agree.
    again = corpus_pipeline.run(spark, fixture)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in again.collect()) == want


def test_empty_tables_and_empty_labels(spark, make_docs):
    path = scratch_path(spark, "pipeline-input")
    make_docs([]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
    other = scratch_path(spark, "pipeline-input")
    rows = [(i, prose(i, 60), "s0") for i in range(12)] + [(20, None, "s0")]
    make_docs(rows).write.parquet(f"{other}/documents.parquet")
    held = [(i, 1, 0) for i in range(12) if zlib.crc32(str(i).encode()) % 5 == 0]
    spark.createDataFrame(held, LABELS).write.parquet(f"{other}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, other).collect()} <= set(range(12))
    docs = spark.read.parquet(f"{other}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = save_and_reload(stage(spark, docs, other), name)
    assert {r.doc_id for r in docs.collect()} == set(range(12))
    assert isinstance(docs.schema, T.StructType)
