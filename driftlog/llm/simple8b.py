"""Token ids in word-aligned binary files (Simple-8b).

A 64-bit word holds a 4-bit selector and up to 120 ids of equal width.  Ids of
60 bits or more stand in an escape table, and an escape word holds their place.
Ids are packed in blocks of 128 whose first words are listed, so all blocks are
packed and unpacked side by side in arrays.

File: magic, file number, counts of documents, ids, words and escapes; document
ids with a flag for NULL, ids per document, first word of every block, words,
escapes; CRC-32 of all that; a line feed.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlog.llm.blobs import RangeReader, list_blobs, write_blobs
from driftlog.llm.text import SPACES, Texts, find_words, gather, hash_spans, same_spans, slices

BLOCK = 128
CHUNK = 512 * BLOCK
FILE_IDS = 8_000_000
CACHED_WORDS = 2_000_000
CACHED_PIECES = 300_000
#: Selector: (ids in a word, bits of an id).  Selector 0 is the escape.
WIDTHS = [(1, 60), (1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1), (120, 0)]
ESCAPE_BITS = 61
# Little-endian: magic, file number, documents, ids, words, escapes.
_HEADER = "<8s5q"
_HEADER_BYTES = struct.calcsize(_HEADER)
_MAGIC = b"S8BIDS01"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; ``ESCAPE_BITS`` from 60 bits on."""
    limits = np.left_shift(np.uint64(1), np.arange(60, dtype=np.uint64))
    need = np.searchsorted(limits, values, "right").astype(np.uint8)
    need[values >> np.uint64(60) > 0] = ESCAPE_BITS
    return need


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (and the total), and escapes."""
    # Some hundred blocks at a time stay in the processor's cache.
    parts = [_pack_some(values[at : at + CHUNK]) for at in range(0, len(values), CHUNK)]
    starts, escapes, words_before, escapes_before = [np.zeros(1, np.int64)], [], 0, 0
    for words, own, out in parts:
        starts.append(own[1:] + words_before)
        words[words >> np.uint64(60) == 0] += np.uint64(escapes_before)
        escapes.append(out)
        words_before += len(words)
        escapes_before += len(out)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *(p[0] for p in parts)]), np.concatenate(starts), np.concatenate([empty, *escapes])


def _pack_some(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = values.astype(np.uint64)
    blocks = -(-len(values) // BLOCK)
    padded = np.zeros((blocks, 2 * BLOCK), np.uint64)
    sizes = np.full(blocks, BLOCK, np.int64)
    if blocks:
        sizes[-1] = len(values) - BLOCK * (blocks - 1)
        whole = np.zeros(blocks * BLOCK, np.uint64)
        whole[: len(values)] = values
        padded[:, :BLOCK] = whole.reshape(blocks, BLOCK)
    need = np.zeros(padded.shape, np.uint8)
    need[:, :BLOCK] = _bits(padded[:, :BLOCK].ravel()).reshape(blocks, BLOCK)

    # For every place the selector that packs the most of the ids after it.
    best = np.zeros((blocks, BLOCK), np.uint8)
    reach, span = need, 1
    for selector in range(1, len(WIDTHS)):
        count, width = WIDTHS[selector]
        while 2 * span <= count:
            wider = reach.copy()
            wider[:, :-span] = np.maximum(reach[:, :-span], reach[:, span:])
            reach, span = wider, 2 * span
        last = reach[:, :BLOCK] if count == span else np.maximum(reach[:, :BLOCK], reach[:, count - span : count - span + BLOCK])
        best[last <= width] = selector

    # All blocks advance together, one word at a time.
    counts = np.array([c for c, _ in WIDTHS])
    at = np.zeros(blocks, np.int64)
    rows = np.flatnonzero(at < sizes)
    turns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        selector = best[rows, at[rows]]
        turns.append((rows, at[rows].copy(), selector))
        at[rows] += counts[selector]
        rows = rows[at[rows] < sizes[rows]]
    if not turns:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    block = np.concatenate([t[0] for t in turns])
    order = np.argsort(block, kind="stable")
    block = block[order]
    place = np.concatenate([t[1] for t in turns])[order]
    selector = np.concatenate([t[2] for t in turns])[order]
    words = selector.astype(np.uint64) << np.uint64(60)
    flat = padded.ravel()
    first = block * 2 * BLOCK + place
    for s, (count, width) in enumerate(WIDTHS):
        own = np.flatnonzero(selector == s)
        if s and width and len(own):
            part = flat[first[own, None] + np.arange(count)]
            part <<= np.arange(count, dtype=np.uint64) * np.uint64(width)
            words[own] |= np.bitwise_or.reduce(part, axis=1)
    escaped = np.flatnonzero(selector == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, np.searchsorted(block, np.arange(blocks + 1)).astype(np.int64), flat[first[escaped]]


def unpack(words: np.ndarray, starts: np.ndarray, escapes: np.ndarray, total: int) -> np.ndarray:
    """The ids again; every block is unpacked from its first word."""
    step = CHUNK // BLOCK
    parts = [
        _unpack_some(words[starts[at] : starts[min(at + step, len(starts) - 1)]], starts[at : at + step + 1] - starts[at], escapes)
        for at in range(0, len(starts) - 1, step)
    ]
    return np.concatenate([np.zeros(0, np.uint64), *parts])[:total]


def _unpack_some(words: np.ndarray, starts: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in WIDTHS])[selector]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first = block * BLOCK + before - before[starts[:-1]][block] if len(words) else before
    out = np.zeros((len(starts) - 1) * BLOCK + 2 * BLOCK, np.uint64)
    # The last word of a block may hold more places than ids are left; what it
    # would write into the next block is zero and is left out.
    end = (block + 1) * BLOCK
    for s, (count, width) in enumerate(WIDTHS):
        own = np.flatnonzero(selector == s)
        if s == 0:
            out[first[own]] = escapes[words[own].astype(np.int64)]
        elif width and len(own):
            mask = np.uint64((1 << width) - 1)
            part = (words[own, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))) & mask
            at = first[own, None] + np.arange(count)
            inside = at < end[own, None]
            out[at[inside]] = part[inside]
    return out[: (len(starts) - 1) * BLOCK]


class IdFile(NamedTuple):
    number: int
    doc_ids: list[int | None]
    bounds: np.ndarray
    ids: np.ndarray


def build_file(number: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file without its final line feed."""
    words, starts, escapes = pack(ids)
    parts = [
        struct.pack(_HEADER, _MAGIC, number, len(doc_ids), len(ids), len(words), len(escapes)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        counts.astype("<u4").tobytes(), starts.astype("<u4").tobytes(),
        words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
    ]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def parse_file(raw: bytes) -> IdFile:
    magic, number, docs, total, n_words, n_escapes = struct.unpack_from(_HEADER, raw)
    body = raw[:-5]
    if magic != _MAGIC or raw[-1:] != b"\n" or struct.unpack("<I", raw[-5:-1])[0] != zlib.crc32(body):
        raise ValueError("not a sound token-id file")
    at = _HEADER_BYTES

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    names, missing = take("<i8", docs), take(np.uint8, docs)
    counts = take("<u4", docs)
    starts = take("<u4", -(-total // BLOCK) + 1).astype(np.int64)
    words, escapes = take("<u8", n_words), take("<u8", n_escapes)
    bounds = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
    return IdFile(number, [None if m else int(d) for d, m in zip(names, missing, strict=True)], bounds, unpack(words, starts, escapes, total))


# ----------------------------------------------------------------- tokenizer


class WordEncoder:
    """Ids by the tokenizers library, asked once per distinct word.

    The vocabulary's pre-tokens never cross white space, so a text is the
    sequence of its words, and words are known again by a 64-bit hash.  A plain
    word (ASCII without ``'`` and ``<``) is the sequence of its runs of letters,
    digits and other signs; other words are asked as they are.  Many pieces are
    asked in one text, with a sign between them that no piece holds.
    """

    SIGN = b"\x1d"
    GROUP = 48

    def __init__(self, model_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model_json)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.sign_ids = self._ids([self.SIGN])[0].tolist()
        self.runs = regex.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
        self.forget()
        self._forget_pieces()

    def forget(self) -> None:
        # Known words by hash: many, sorted, and the latest ones beside them.
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.ids = np.zeros(0, np.int32)
        self.bounds = np.zeros(1, np.int64)
        self.spelled = np.zeros(0, np.uint8)
        self.spelled_bounds = np.zeros(1, np.int64)

    def _forget_pieces(self) -> None:
        self.piece_rows: dict[bytes, int] = {}
        self.piece_ids = np.zeros(0, np.int32)
        self.piece_bounds = np.zeros(1, np.int64)

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in encoded]

    def _ask(self, pieces: list[bytes]) -> None:
        """Learn the ids of new pieces."""
        joined = [p for p in pieces if self.SIGN not in p]
        alone = [p for p in pieces if self.SIGN in p]
        groups = [joined[at : at + self.GROUP] for at in range(0, len(joined), self.GROUP)]
        order, parts, sizes = [], [], []
        for group, ids in zip(groups, self._ids([(b" " + self.SIGN + b" ").join(g) for g in groups]), strict=True):
            signs = np.flatnonzero(ids == self.sign_ids[0])
            if len(signs) == len(group) - 1 and len(self.sign_ids) == 1:
                order += group
                parts.append(np.delete(ids, signs))
                sizes.append(np.diff(np.concatenate(([-1], signs, [len(ids)]))) - 1)
            else:
                alone += group
        own = self._ids(alone)
        order += alone
        parts += own
        sizes.append(np.array([len(x) for x in own], np.int64))
        first = len(self.piece_rows)
        self.piece_rows.update(zip(order, range(first, first + len(order)), strict=True))
        self.piece_ids = np.concatenate([self.piece_ids, *parts])
        self.piece_bounds = np.concatenate((self.piece_bounds, self.piece_bounds[-1] + np.cumsum(np.concatenate(sizes))))

    def _learn(self, words: list[bytes], mixed: list[bool], hashes: np.ndarray) -> np.ndarray:
        """Learn words in the order of their hashes, of which only ``mixed`` ones
        are cut; their rows."""
        if len(self.piece_rows) > CACHED_PIECES:
            self._forget_pieces()
        cut = [self.runs.findall(w) if m else [w] for w, m in zip(words, mixed, strict=True)]
        flat = [p for own in cut for p in own]
        self._ask(list(dict.fromkeys(p for p in flat if p not in self.piece_rows)))
        rows = np.fromiter(map(self.piece_rows.__getitem__, flat), np.int64, len(flat))
        ids, sizes = gather(self.piece_ids, self.piece_bounds, rows)
        counts = np.array([len(own) for own in cut], np.int64)
        sizes = np.add.reduceat(sizes, np.cumsum(counts) - counts)
        first = len(self.bounds) - 1
        self.spelled = np.concatenate((self.spelled, np.frombuffer(b"".join(words), np.uint8)))
        ends = self.spelled_bounds[-1] + np.cumsum([len(w) for w in words])
        self.spelled_bounds = np.concatenate((self.spelled_bounds, ends))
        self.ids = np.concatenate((self.ids, ids))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(sizes)))
        rows_of = first + np.arange(len(words))
        late = self._merge(self.known[1], (hashes, rows_of))
        if 4 * len(late[0]) > len(self.known[0][0]):
            self.known = [self._merge(self.known[0], late), (late[0][:0], late[1][:0])]
        else:
            self.known[1] = late
        return rows_of

    @staticmethod
    def _merge(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        # Both are sorted already.
        at = np.searchsorted(one[0], two[0])
        return np.insert(one[0], at, two[0]), np.insert(one[1], at, two[1])

    def _rows(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of known words, -1 for others."""
        rows = np.full(len(hashes), -1, np.int64)
        for known, own in self.known:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                rows = np.where(known[at] == hashes, own[at], rows)
        return rows

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and bounds."""
        if len(self.bounds) > CACHED_WORDS:
            self.forget()
        words = find_words(texts)
        # Plain words are looked up in lower case, others as they stand.
        data = texts.data
        odd = np.flatnonzero((data >= 128) | (data == 39) | (data == 60))
        plain = np.ones(len(words.starts), bool)
        plain[np.searchsorted(words.starts, odd, "right") - 1] = False
        capital = np.flatnonzero((data >= 65) & (data <= 90))
        capital = capital[plain[np.searchsorted(words.starts, capital, "right") - 1]]
        data = data.copy()
        data[capital] += 32
        hashes = hash_spans(data, words.starts, words.ends)
        seen, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        rows = self._rows(seen)
        fresh = rows < 0
        if fresh.any():
            picked = first[fresh]
            # A plain word of letters alone is one piece.
            signs = np.zeros(len(plain), bool)
            other = np.flatnonzero((data < 97) & ~SPACES[data] | (data > 122))
            signs[np.searchsorted(words.starts, other, "right") - 1] = True
            raw, mixed = data.tobytes(), (plain & signs)[picked].tolist()
            spans = zip(words.starts[picked].tolist(), words.ends[picked].tolist(), strict=True)
            rows[fresh] = self._learn([raw[a:b] for a, b in spans], mixed, seen[fresh])
        rows = rows[which]
        ids, sizes = gather(self.ids, self.bounds, rows)
        # Words that only share the hash of a known word are encoded alone.
        at = self.spelled_bounds
        # Only spans over eight bytes can do so, or spans of unlike length.
        alike = same_spans(data, words.starts, words.ends, self.spelled, at[rows], at[rows + 1], known=8)
        if not alike.all():
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(~alike).tolist():
                word = data[words.starts[i] : words.ends[i]].tobytes()
                parts[i] = np.concatenate(self._ids(self.runs.findall(word) if plain[i] else [word]))
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        sums = np.concatenate(([0], np.cumsum(sizes)))
        return ids, sums[words.bounds]


@lru_cache(maxsize=2)
def encoder(model_json: str) -> WordEncoder:
    return WordEncoder(model_json)


# --------------------------------------------------------------------- Spark


def write_ids(docs: DataFrame, model_path: str, path: str, end_id: int = 1, file_ids: int = FILE_IDS) -> None:
    """Encode every whole text and write its ids and ``end_id`` to files.

    Documents stand in ascending doc_id order (NULL first, equal ids by text)
    across and within files; a file is closed at ``file_ids`` ids.  NULL and
    empty texts are the end id alone.  An empty table writes no file.
    """
    with open(model_path, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model.value)
        number = TaskContext.get().partitionId() << 20
        doc_ids, counts, parts, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            blob = build_file(number, doc_ids, np.concatenate(counts), np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["file"])

        for part, texts in slices(batches):
            ids, bounds = coder.encode(texts)
            ids = np.insert(ids, bounds[1:], end_id)
            doc_ids += part.column(0).to_pylist()
            counts.append(np.diff(bounds) + 1)
            parts.append(ids.astype(np.uint64))
            total += len(ids)
            if total >= file_ids:
                yield close()
                doc_ids, counts, parts, total = [], [], [], 0
                number += 1
        if doc_ids:
            yield close()

    # Range partitions keep their order, also when small ones are joined.
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    write_blobs(ordered.mapInArrow(run, "file binary"), "file", path)


def locate_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, base): each file with the number of ids before it.

    Only headers are read; one short row per file is ordered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            heads = [struct.unpack(_HEADER, reader.read(p, 0, _HEADER_BYTES)) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([h[1] for h in heads]), pa.array([h[3] for h in heads])],
                ["path", "length", "number", "ids"],
            )

    heads = list_blobs(spark, path).mapInArrow(run, "path string, length bigint, number bigint, ids bigint")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return heads.select("path", "length", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def read_ids(files: DataFrame, digest: bool = False, tasks: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (or their CRC-32) of located files.

    ``start`` counts the ids of all documents before.  With ``digest`` the ids
    are not returned but the CRC-32 of them as little-endian 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            for path, length, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                file = parse_file(reader.read(path, 0, length))
                sizes = np.diff(file.bounds)
                if digest:
                    small = file.ids.astype("<u4")
                    last = pa.array(
                        [zlib.crc32(small[a:b]) for a, b in zip(file.bounds[:-1], file.bounds[1:], strict=True)], pa.int64()
                    )
                else:
                    last = pa.ListArray.from_arrays(pa.array(file.bounds.astype(np.int32)), pa.array(file.ids.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64()), pa.array(base + file.bounds[:-1]), pa.array(sizes), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    # The number of files is known, so each task can have about one.
    dealt = files.repartition(tasks or max(files.count(), 1), "path")
    return dealt.select("path", "length", "base").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids array<bigint>")
    )
