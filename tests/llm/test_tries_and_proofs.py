"""Conversation tries, Merkle manifests and decontamination by brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from made_texts import prose

from driftlog.llm import decontaminate, merkle, ranks, trie

TALK = "conv_id long, turn long, role string, text string"


def crc(value) -> int:
    return zlib.crc32(str(value).encode())


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df):
    columns = sorted(df.columns)
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ------------------------------------------------------------------- ranks


def test_places_in_groups_over_many_tasks(spark):
    data = [(k, v) for k in (None, "a", "b") for v in [None, None, *range(40), 7, 7]] + [("hot", v % 5) for v in range(500)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k string, v int").repartition(6)
    got = defaultdict(list)
    for r in ranks.number_rows(df, ["k"], ["v"]).collect():
        got[r.k].append((r.pos, r.v))
    want = defaultdict(list)
    for k, v in data:
        want[k].append(v)
    for k, values in want.items():
        order = sorted(values, key=lambda v: (v is not None, v))
        assert sorted(got[k]) == list(enumerate(order))
    whole = ranks.number_rows(df, [], ["k", "v"], "at").collect()
    assert sorted(r["at"] for r in whole) == list(range(len(data)))
    assert ranks.number_rows(df.filter("k = 'none'"), ["k"], ["v"]).count() == 0


# ------------------------------------------------------------------- tries


def brute_trie(talk):
    turns = defaultdict(list)
    for c, t, role, text in talk:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, seq in own.items():
        h = crc(c) % 4
        source = int(abs(c) // 20 * 20 * (1 if c >= 0 else -1))
        built[c] = tuple(own.get(source, [])[:h] + seq[h:])
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    out = Counter()
    leaves, saved = Counter(), Counter()
    for path, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(members) - 1) * words
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(path)))
        out[(min(members), len(path), sha(ends), children[path], len(members), leaves[path],
             min(nodes[path[:-1]]) if path else None, saved[path])] += 1
    return out


def talk_rows(seed: int, convs: int, longest: int):
    rng = random.Random(seed)
    lines = ["hi", "hello you", "", None, "a b  c", "x\ty\nz"]
    out = []
    for c in range(-3, convs):
        if rng.random() < 0.1:
            continue
        for t in range(rng.randrange(1, longest)):
            out.append((c, t, rng.choice(["user", "user", None]), lines[min(int(rng.expovariate(1.2)), 5)]))
    return out


@pytest.mark.parametrize(("burst", "segment"), [(16_384, 1_024), (7, 4), (12, 3), (5, 1), (40, 8)])
def test_trie_equals_brute_force(spark, burst, segment):
    talk = talk_rows(burst, 90, 12)
    talk += [(None, 1, "user", "lost"), (5, None, "user", "first"), (5, None, "user", "first"), (200, 1, None, None)]
    talk += [(c, t, "user", f"copy {t}") for c in range(300, 330) for t in range(9)]  # exact copies
    talk += [(400, t, "user", "long " * (t % 3)) for t in range(50)]
    df = spark.createDataFrame(talk, TALK).repartition(5).selectExpr("*", "'x' as key", "1 as n", "'y' as low")
    assert rows(trie.prefix_trie(df, burst, segment)) == brute_trie(talk)


def test_conversations_without_turns_and_no_conversations(spark):
    # The only turns of these fall before h, and there is no source to lend any.
    short = [c for c in range(1, 200) if c % 20 and crc(c) % 4 >= 1][:5]
    talk = [(c, 0, "user", "gone") for c in short]
    got = trie.prefix_trie(spark.createDataFrame(talk, TALK)).collect()
    assert len(got) == 1
    root = got[0]
    assert (root.conv_id, root.depth, root.parent_conv_id, root.n_convs) == (short[0], 0, None, 5)
    assert (root.n_children, root.n_leaves, root.saved_tokens) == (0, 1, 0)
    assert root.ends_sha256 == sha(",".join(map(str, short)))
    assert trie.prefix_trie(spark.createDataFrame([], TALK)).count() == 0
    with pytest.raises(ValueError):
        trie.prefix_trie(spark.createDataFrame([], TALK), 8, 8)


def test_very_long_turns(spark):
    talk = [(c, t, "user", prose(t, 20_000)) for c in (20, 21, 40) for t in range(3)]
    assert rows(trie.prefix_trie(spark.createDataFrame(talk, TALK))) == brute_trie(talk)


# ------------------------------------------------------------------ Merkle

LEAVES = "doc_id long, text string, lang string, source string, n_chars long"


def brute_manifest(table):
    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, j):
        out = []
        for level in tree[:-1]:
            run = level[j // 2 * 2 : j // 2 * 2 + 2]
            out.append((j % 2, run[:j % 2] + run[j % 2 + 1 :]))
            j //= 2
        return out

    groups = defaultdict(list)
    for r in table:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: levels([x[2] for x in sorted(groups[n], key=lambda x: x[:3])]) for n in names}
    top = levels([trees[n][-1][0] for n in names])
    out = Counter()
    for at, n in enumerate(names):
        for j, (_, _, own, r) in enumerate(sorted(groups[n], key=lambda x: x[:3])):
            whole = path(trees[n], j) + path(top, at)
            proof = sha("".join(s for _, more in whole for s in more))
            hit = r[0] is not None and r[4] is not None and crc(r[0]) % 7 == 0
            folded = leaf(*r[:4], r[4] + 1) if hit else own
            for place, more in whole:
                folded = sha("".join(more[:place] + [folded] + more[place:]))
            out[(r[0], folded, own, proof, top[-1][0], trees[n][-1][0], folded == top[-1][0])] += 1
    return out


@pytest.mark.parametrize("bits", [1, 2, 9])
def test_manifest_equals_brute_force(spark, bits):
    rng = random.Random(bits)
    table = [(i, prose(i, 5), f"l{int(rng.expovariate(0.7))}", "s", 5 + i) for i in range(150)]
    table += [(None, None, None, None, None), (3, "\U0001f600 é", None, None, 9), (7, prose(1, 30_000), "", "s", None)]
    table += [(8, "same", "en", "s", 4)] * 3 + [(8, "other", "en", "s", 5), (None, "t", "en", "s", 1), (-4, "x", "alone", "s", 1)]
    df = spark.createDataFrame(table, LEAVES).repartition(4).selectExpr("*", "1 as pos", "'x' as leaf", "2 as chunk", "'t' as tree")
    assert rows(merkle.verify_documents(df, bits)) == brute_manifest(table)


def test_small_manifests(spark):
    empty = spark.createDataFrame([], LEAVES)
    assert merkle.verify_documents(empty).count() == 0
    table = [(2, "a", "en", "s", 1)]
    got = merkle.verify_documents(spark.createDataFrame(table, LEAVES)).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == sha("")


@pytest.mark.parametrize("leaves", [1, 2, 3, 7, 8, 13])
def test_log_positions_are_the_completion_order(leaves):
    height = (leaves - 1).bit_length()
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(leaves)]
    log = merkle.build_log(digests, height)
    level = digests
    for depth in range(height + 1):
        for i, node in enumerate(level):
            at = int(merkle.node_place(depth, i, leaves)) * 32
            assert log[at : at + 32] == node
        level = [merkle.combine(level[i : i + 2]) for i in range(0, len(level), 2)]
    assert len(log) // 32 == int(merkle.leaf_place(leaves - 1)) + height + 1


# --------------------------------------------------------- decontamination

ITEMS = "item_id long, text string"


def brute_passages(docs, items):
    def words(text):
        low = (text or "").encode().lower().decode() if text is None or text.isascii() else "".join(c.lower() if c < "\x80" else c for c in text)
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    own = defaultdict(set)
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            own[tuple(w[k : k + n])].add(i)
    sizes = {len(x) for x in own}
    out = Counter()
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in own:
                    hit |= set(range(k, k + n))
                    found |= own[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out[(bool(hit), i, sha(",".join(names)), len(hit), len(names), len(w))] += 1
    return out


def passage_tables():
    items = [(i, prose(100 + i, 30)) for i in range(12)] + [(20, "One, TWO"), (21, "solo"), (22, "three b C"), (23, ""), (24, None)]
    items += [(None, prose(300, 15)), (3, prose(301, 12)), (30, prose(100, 30)), (31, " ".join(["la"] * 14)), (32, "été ça va bien")]
    docs = [(i, prose(i, 60)) for i in range(20)]
    for i in range(12):
        part = prose(100 + i, 30).split()
        docs.append((200 + i, prose(i, 9) + " " + ", ".join(part[i : i + 9 + i % 3]) + " " + prose(i + 1, 9)))
    docs += [(300, prose(300, 15)), (301, prose(301, 12).upper()), (302, "a one two b"), (303, "solo solo"), (304, "x three b c three b"),
             (305, "la " * 40), (306, None), (307, ""), (308, "Été ça va bien"), (309, "été;ça va!bien"), (None, prose(105, 30))]
    docs += [(310, prose(7, 20_000) + " " + prose(104, 30) + " " + prose(8, 20_000)), (311, "one"), (311, "two"), (311, "one")]
    return docs + [(400 + i, prose(102, 30)) for i in range(40)], items


def test_passages_equal_brute_force(spark):
    docs, items = passage_tables()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as row", "1 as hits", "2 as window", "3 as words")
    bench = spark.createDataFrame(items, ITEMS).selectExpr("*", "'x' as window", "1 as shingle")
    got = rows(decontaminate.contaminated_documents(frame, bench))
    assert got == brute_passages(docs, items)
    assert rows(decontaminate.contaminated_documents(frame.repartition(7), bench.repartition(3))) == got


def test_passages_of_nothing(spark):
    docs, items = passage_tables()
    none = spark.createDataFrame([], "doc_id long, text string")
    frame, bench = spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    assert decontaminate.contaminated_documents(none, bench).count() == 0
    assert rows(decontaminate.contaminated_documents(frame, spark.createDataFrame([], ITEMS))) == brute_passages(docs[:5], [])
