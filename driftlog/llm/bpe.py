"""Byte-level BPE encoding and decoding by speculation and verification.

Pre-tokens are encoded once per distinct spelling.  Greedy longest match
proposes their tokens; a proposal is the BPE result exactly if every adjacent
pair of tokens is compatible, that is, if no merge across the border comes
before the merges that built the two tokens.  The check undoes merges on both
sides of all borders at once, in arrays.  Only words with a failing pair, and
words too long for the arrays, undergo exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.text import Spans, Texts, gather, slices

LONG_WORD = 256
CACHED_WORDS = 200_000
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file:
    visible Latin-1 characters for themselves, others from code point 256 on."""
    visible = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class Codec:
    """Tokens are numbered by age: 256 bytes, then one token per merge."""

    def __init__(self, model_json: str):
        spec = json.loads(model_json)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        number = {c: b for b, c in enumerate(letters)}
        self.left = np.full(256 + len(merges), -1, np.int64)
        self.right = np.full(256 + len(merges), -1, np.int64)
        names = list(letters)
        for i, (a, b) in enumerate(merges):
            self.left[256 + i], self.right[256 + i] = number[a], number[b]
            number.setdefault(a + b, 256 + i)
            names.append(a + b)
        self.pair_rank = {(number[a], number[b]): 256 + i for i, (a, b) in reversed(list(enumerate(merges)))}
        keys = np.array([a << 32 | b for a, b in self.pair_rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_tokens = np.array(list(self.pair_rank.values()), np.int64)[order]
        self.ids = np.array([vocab[name] for name in names], np.int64)
        self.bytes = [bytes(byte_of[c] for c in name) for name in names]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None

        spelled = {int(i): b for i, b in zip(self.ids, self.bytes, strict=True)}
        spelled |= {i: s.encode() for s, i in self.special.items()}
        parts = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.spelling = np.frombuffer(b"".join(parts), np.uint8)
        self.spelling_bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        self._index_tokens()
        self.forget()

    def _index_tokens(self) -> None:
        """Sorted hashes of the tokens that are their own encoding, by length."""
        whole = np.ones(len(self.bytes), bool)
        made = np.arange(256, len(self.bytes))
        whole[made] = self.compatible(self.left[made], self.right[made], made)
        for t in made:
            whole[t] &= whole[self.left[t]] and whole[self.right[t]]
        data = np.frombuffer(b"".join(self.bytes), np.uint8)
        ends = np.cumsum([len(b) for b in self.bytes])
        starts = ends - [len(b) for b in self.bytes]
        hashes = Spans(data).hash(starts, ends)
        kept = np.flatnonzero(whole & (ends - starts <= LONG_WORD))
        order = kept[np.argsort(hashes[kept], kind="stable")]
        self.token_hash, self.token_at = hashes[order], order
        self.near = np.zeros(1 << 20, bool)
        self.near[self.token_hash >> np.uint64(44)] = True
        self.lengths = np.unique((ends - starts)[kept])[::-1]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_tokens[at], _NONE) if len(self.pair_keys) else np.full(len(a), _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the border between tokens a and b outlives all merges older
        than ``limit``.  The younger side is undone step by step; its parts next
        to the border must not have merged with the other side before."""
        good = np.zeros(len(a), bool)
        rows = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _NONE) if limit is None else limit.copy()
        while len(rows):
            alive = self.merged(a, b) >= limit
            rows, a, b = rows[alive], a[alive], b[alive]
            bytes_left, bytes_right = a < 256, b < 256
            done = bytes_left & bytes_right
            good[rows[done]] = True
            rows, a, b = rows[~done], a[~done], b[~done]
            undo_left = ((a > b) & (a >= 256)) | (b < 256)
            limit = np.where(undo_left, a, b + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all words and the word of each."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        at = ends - [len(w) for w in words]
        spans = Spans(data)
        who = np.flatnonzero(at < ends)
        at = at[who]
        tokens, owners, turns = [], [], []
        turn = 0
        while len(who):
            found = np.full(len(who), -1, np.int64)
            size = np.zeros(len(who), np.int64)
            room = ends[who] - at
            for length in self.lengths[self.lengths <= room.max()]:
                open_ = np.flatnonzero((found < 0) & (room >= length))
                if not len(open_):
                    continue
                h = spans.hash(at[open_], at[open_] + length)
                maybe = np.flatnonzero(self.near[h >> np.uint64(44)])
                slot = np.minimum(np.searchsorted(self.token_hash, h[maybe]), len(self.token_hash) - 1)
                hit = self.token_hash[slot] == h[maybe]
                rows = open_[maybe[hit]]
                found[rows], size[rows] = self.token_at[slot[hit]], length
            tokens.append(found)
            owners.append(who)
            turns.append(np.full(len(who), turn))
            turn += 1
            at = at + size
            more = at < ends[who]
            who, at = who[more], at[more]
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate(owners)
        order = np.lexsort((np.concatenate(turns), owner))
        return np.concatenate(tokens)[order], owner[order]

    def merge_exactly(self, word: bytes) -> list[int]:
        """Plain BPE: always the oldest, then leftmost, possible merge."""
        token = list(word)
        after = list(range(1, len(token) + 1))
        before = list(range(-1, len(token) - 1))
        rank = self.pair_rank
        heap = [(rank[p], i) for i, p in enumerate(zip(token, token[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            new, i = heapq.heappop(heap)
            j = after[i]
            if token[i] < 0 or j >= len(token) or rank.get((token[i], token[j])) != new:
                continue
            token[i], token[j] = new, -1
            after[i] = after[j]
            if after[i] < len(token):
                before[after[i]] = i
                if (p := (new, token[after[i]])) in rank:
                    heapq.heappush(heap, (rank[p], i))
            if before[i] >= 0 and (p := (token[before[i]], new)) in rank:
                heapq.heappush(heap, (rank[p], before[i]))
        return [t for t in token if t >= 0]

    def merge_together(self, words: list[bytes]) -> list[np.ndarray]:
        """``merge_exactly`` of many short words: one merge of each per round."""
        tokens = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        out: list = [None] * len(words)

        def ranks(at: np.ndarray) -> np.ndarray:
            """Rank of the pair that begins at each place; none across words."""
            inside = at[at + 1 < len(tokens)]
            inside = inside[owner[inside] == owner[inside + 1]]
            found = np.full(len(tokens), _NONE)
            found[inside] = self.merged(tokens[inside], tokens[inside + 1])
            return found[at]

        rank = ranks(np.arange(len(tokens)))
        while len(tokens):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(first, len(tokens)))
            least = np.minimum.reduceat(rank, first)
            over = least == _NONE
            for i, a, n in zip(owner[first[over]].tolist(), first[over].tolist(), sizes[over].tolist(), strict=True):
                out[i] = tokens[a : a + n]
            at = np.flatnonzero((rank == np.repeat(least, sizes)) & np.repeat(~over, sizes))
            at = at[np.concatenate(([True], owner[at][1:] != owner[at][:-1]))] if len(at) else at
            tokens = tokens.copy()
            tokens[at] = rank[at]
            kept = np.repeat(~over, sizes)
            kept[at + 1] = False
            moved = np.cumsum(kept) - 1
            at = moved[at]
            tokens, owner, rank = tokens[kept], owner[kept], rank[kept]
            touched = np.concatenate((at, at[at > 0] - 1))
            rank[touched] = ranks(touched)
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of all words, concatenated, and bounds."""
        short = [w if len(w) <= LONG_WORD else b"" for w in words]
        tokens, owner = self.propose(short)
        exact = np.array([len(w) > LONG_WORD for w in words], bool)
        border = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(tokens[border] << 32 | tokens[border + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        exact[owner[border[~fine[which]]]] = True
        failing = np.flatnonzero(exact).tolist()
        brief = [i for i in failing if len(words[i]) <= LONG_WORD]
        redone = dict(zip(brief, self.merge_together([words[i] for i in brief]), strict=True))
        redone |= {i: self.merge_exactly(words[i]) for i in failing if len(words[i]) > LONG_WORD}
        sizes = np.bincount(owner, minlength=len(words))
        for i, new in redone.items():
            sizes[i] = len(new)
        bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        out = np.zeros(bounds[-1], np.int64)
        kept = ~exact[owner]
        out[np.repeat(~exact, sizes)] = tokens[kept]
        for i, new in redone.items():
            out[bounds[i] : bounds[i + 1]] = new
        return self.ids[out], bounds

    # ---------------------------------------------------------------- texts

    def forget(self) -> None:
        self.known = _Numbers()
        self.word_ids = np.zeros(0, np.int64)
        self.word_bounds = np.zeros(1, np.int64)
        self.word_uses = np.zeros(0, np.int64)

    def forget_rare(self) -> None:
        """Keep the quarter of the known words that were used most."""
        kept = np.sort(np.argsort(-self.word_uses, kind="stable")[: CACHED_WORDS // 4])
        spelled = list(self.known)
        ids, sizes = gather(self.word_ids, self.word_bounds, kept)
        uses = self.word_uses[kept]
        self.forget()
        for i in kept.tolist():
            self.known[spelled[i]] = len(self.known)
        self.word_ids, self.word_bounds, self.word_uses = ids, np.concatenate(([0], np.cumsum(sizes))), uses

    def _words(self, text: str) -> list:
        if self.splitter is None or not self.splitter.search(text):
            return self.pattern.findall(text)
        out: list = []
        end = 0
        for m in self.splitter.finditer(text):
            out += self.pattern.findall(text[end : m.start()])
            out.append((m.group(),))
            end = m.end()
        return out + self.pattern.findall(text[end:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and bounds."""
        if len(self.known) > CACHED_WORDS:
            self.forget_rare()
        words = [self._words(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        fresh = self.known.fresh
        if fresh:
            plain = [w.encode() if isinstance(w, str) else b"" for w in fresh]
            ids, bounds = self.encode_words(plain)
            sizes = np.diff(bounds)
            marks = [i for i, w in enumerate(fresh) if not isinstance(w, str)]
            if marks:
                ids = np.insert(ids, bounds[marks], [self.special[fresh[i][0]] for i in marks])
                sizes[marks] = 1
            self.word_ids = np.concatenate((self.word_ids, ids))
            more = self.word_bounds[-1] + np.cumsum(sizes)
            self.word_bounds = np.concatenate((self.word_bounds, more))
            self.known.fresh = []
        uses = np.bincount(flat, minlength=len(self.known))
        uses[: len(self.word_uses)] += self.word_uses
        self.word_uses = uses
        ids, sizes = gather(self.word_ids, self.word_bounds, flat)
        sums = np.concatenate(([0], np.cumsum(sizes)))
        return ids, sums[np.concatenate(([0], np.cumsum(counts)))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of id lists; bytes that are no UTF-8 become U+FFFD."""
        data, sizes = gather(self.spelling, self.spelling_bounds, ids)
        sums = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(sums[:-1], sums[1:], strict=True)]


class _Numbers(dict):
    """Numbers words in order of appearance and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


@lru_cache(maxsize=2)
def codec(model_json: str) -> Codec:
    return Codec(model_json)


def read_model(path: str) -> str:
    """The vocabulary file, read once on the driver; its size is fixed."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text; NULL counts as empty.

    Empty texts have no ids.  Repeated rows get equal rows; other columns are
    ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model.value)
        for part, texts in slices(batches):
            ids, bounds = coder.encode(_strings(texts))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return _named(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of id lists; a NULL list gives an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model.value)
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            bounds = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))))
            texts = coder.decode(np.asarray(lists.flatten(), np.int64), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    Each text is encoded and decoded again in one pass; the digests are those
    of the ids in decimal, joined by commas, and of the decoded text.  NULL and
    empty texts have no ids, and the digests are those of empty strings.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model.value)
        decimal = [b"%d" % i for i in range(len(coder.spelling_bounds))]
        for part, texts in slices(batches):
            ids, bounds = coder.encode(_strings(texts))
            written = list(map(decimal.__getitem__, ids.tolist()))
            digests = [
                hashlib.sha256(b",".join(written[a:b])).hexdigest()
                for a, b in zip(bounds[:-1], bounds[1:], strict=True)
            ]
            decoded = [hashlib.sha256(t.encode()).hexdigest() for t in coder.decode(ids, bounds)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(bounds)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _named(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _strings(texts: Texts) -> list[str]:
    return [texts.raw(i).decode() for i in range(len(texts))]
