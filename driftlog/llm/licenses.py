"""Licence scans: exact phrases and fuzzy search for short notices.

A notice that may have k edits is cut into k + 1 pieces; whatever the edits,
one piece must stand in the text unchanged.  An Aho-Corasick automaton finds
all pieces in one pass, each hit names a window, and the regex library's
bounded-error matching verifies the edits there and gives the span.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlog.llm.text import Texts, find_words, hash_spans, slices

#: The exact phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Common wording of licence notices, as words; the label; the
#: words that tell it from other notices, which must stand unedited.
NOTICES = [
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general", "gpl", "gnu general"),
    ("licensed under the gnu general public license", "gpl", "gnu general"),
    ("gnu general public license as published by the free software foundation", "gpl", "gnu general"),
    ("licensed under the gnu lesser general public license", "lgpl", "lesser"),
    ("licensed under the gnu affero general public license", "agpl", "affero"),
    ("licensed under the apache license version 2 0", "apache", "apache"),
    ("you may not use this file except in compliance with the license", "apache", "compliance"),
    ("released under the mit license", "mit", "mit"),
    ("licensed under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "granted charge"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "source binary"),
    ("licensed under the bsd license", "bsd", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used", "bsd", "neither nor"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc", "purpose fee"),
    ("subject to the terms of the mozilla public license", "mpl", "mozilla"),
    ("released under the mpl license", "mpl", "mpl"),
    ("licensed under the eclipse public license", "epl", "eclipse"),
    ("distributed under the boost software license version 1 0", "boost", "boost"),
    ("licensed under the artistic license", "artistic", "artistic"),
    ("licensed under the zlib license", "zlib", "zlib"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered"),
    ("this work is dedicated to the public domain", "public-domain", "public domain"),
    ("to the extent possible under law the author has waived all copyright and related rights", "cc0", "waived"),
    ("licensed under a creative commons attribution", "cc-by", "commons attribution"),
    ("licensed under cc by", "cc-by", "cc by"),
    ("do what the fuck you want to public license", "wtfpl", "want"),
    ("all rights reserved", "proprietary", "all reserved"),
]
CHARS_PER_EDIT = 12

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[:128] = True
_SEPARATORS[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False


class Notice(NamedTuple):
    text: str
    label: str
    naming: list[str]
    edits: int
    pattern: regex.Pattern


def allowed_edits(text: str) -> int:
    return max(1, len(text) // CHARS_PER_EDIT)


@lru_cache(maxsize=4)
def _search(notices: tuple[tuple[str, str, str], ...]) -> tuple[list[Notice], ahocorasick.Automaton]:
    built, pieces = [], {}
    for number, (text, label, naming) in enumerate(notices):
        edits = allowed_edits(text)
        pattern = regex.compile(rf"(?<![^ ])(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}(?![^ ])", regex.ENHANCEMATCH)
        built.append(Notice(text, label, naming.split(), edits, pattern))
        cuts = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            pieces.setdefault(text[a:b], []).append((number, a))
    automaton = ahocorasick.Automaton()
    for piece, uses in pieces.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    return built, automaton


class Found(NamedTuple):
    """A notice in a text: words first to last, from 0, and its edits."""

    label: str
    notice: str
    first_word: int
    last_word: int
    edits: int


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(out.pop()[1], b)
        out.append((a, b))
    return out


def find_notices(words: str, notices: tuple[tuple[str, str, str], ...] = tuple(NOTICES)) -> list[Found]:
    """All fuzzy notices in lower-case words joined by single spaces.

    Edits may fall anywhere but in the naming words of a notice, which must
    stand in the found span in their order.
    """
    built, automaton = _search(notices)
    windows: dict[int, list[tuple[int, int]]] = {}
    for end, (size, uses) in automaton.iter(words):
        for number, offset in uses:
            notice = built[number]
            start = end + 1 - size - offset
            a, b = max(0, start - notice.edits), start + len(notice.text) + notice.edits
            # A window reaches to the ends of the words it cuts.
            a = words.rfind(" ", 0, a) + 1
            b = words.find(" ", b) if words.find(" ", b) >= 0 else len(words)
            windows.setdefault(number, []).append((a, b))
    found = []
    for number, spans in windows.items():
        notice = built[number]
        first, counted = 0, 0
        for a, b in _merged(spans):
            for m in notice.pattern.finditer(words[a:b]):
                # Spans come in order, so each space is counted once.
                first += words.count(" ", counted, a + m.start())
                counted = a + m.start()
                own = iter(m.group().split(" "))
                if not all(word in own for word in notice.naming):
                    continue
                found.append(
                    Found(notice.label, notice.text, first, first + m.group().count(" "), sum(m.fuzzy_counts))
                )
    return sorted(found, key=lambda f: (f.first_word, f.last_word, f.notice))


def _normal(texts: Texts, inside: np.ndarray) -> list[str]:
    """Each text's words joined by single spaces."""
    data = np.where(inside, texts.data, np.uint8(32))
    keep = inside.copy()
    keep[1:] |= inside[:-1] & ~inside[1:]
    sums = np.concatenate(([0], np.cumsum(keep)))[texts.bounds]
    kept = data[keep].tobytes()
    # A separator at a text's start can follow the word that ends the text before.
    return [kept[a:b].strip().decode() for a, b in zip(sums[:-1], sums[1:], strict=True)]


def _phrase_places(texts: Texts) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Word counts, and for each phrase the words it starts at (all texts)."""
    words = find_words(texts, _SEPARATORS)
    hashes = hash_spans(texts.data, words.starts, words.ends)
    ends = np.repeat(words.bounds[1:], words.counts())
    places = []
    for phrase, _ in PHRASES:
        data = np.frombuffer(phrase.encode(), np.uint8)
        own = find_words(Texts(data, np.array([0, len(data)])), _SEPARATORS)
        keys = hash_spans(data, own.starts, own.ends)
        at = np.flatnonzero(hashes == keys[0])
        at = at[at + len(keys) <= ends[at]]
        for k in range(1, len(keys)):
            at = at[hashes[at + k] == keys[k]]
        places.append(at)
    return words.counts(), places, words.bounds


_SPANS = pa.list_(
    pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])
)


def scan_documents(docs: DataFrame, notices: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Licence labels of every whole text, one row per row of ``docs``.

    ``notices`` replaces the table of (wording, label, naming words).

    doc_id, n_words; n_base, first_word, last_word and base_labels of the exact
    phrases; labels, these and those of the fuzzy notices; score, 1 for an
    exact phrase, else the share of the best notice's characters that are not
    edited, 0 without any; notices, all fuzzy spans with their edits.

    Words are runs of ASCII letters, digits and all non-ASCII characters, after
    lower-casing A-Z.  NULL and empty texts have no words and no labels; a text
    without exact phrase has NULL first_word and last_word.  Very long texts are
    searched whole.  Of overlapping spans of one notice the first is reported.
    Repeated rows get equal rows; other columns are ignored; an empty table
    gives an empty result.
    """
    table = tuple(NOTICES if notices is None else notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            low = texts.lowered()
            counts, places, bounds = _phrase_places(low)
            n = len(texts)
            base = np.zeros(n, np.int64)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set[str]] = [set() for _ in range(n)]
            for at, (_, label) in zip(places, PHRASES, strict=True):
                owner = np.searchsorted(bounds, at, "right") - 1
                base += np.bincount(owner, minlength=n)
                np.minimum.at(first, owner, at - bounds[owner])
                np.maximum.at(last, owner, at - bounds[owner])
                for i in set(owner.tolist()):
                    labels[i].add(label)
            spans = [find_notices(t, table) for t in _normal(low, ~_SEPARATORS[low.data])]
            score = [
                1.0 if labels[i] else max((1 - f.edits / len(f.notice) for f in own), default=0.0)
                for i, own in enumerate(spans)
            ]
            everything = [own | {f.label for f in fuzzy} for own, fuzzy in zip(labels, spans, strict=True)]
            none = base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(counts), pa.array(base),
                    pa.array(first, mask=none), pa.array(last.astype(np.int64), mask=none),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array([",".join(sorted(x)) for x in everything], pa.string()),
                    pa.array(score, pa.float64()), pa.array([[f._asdict() for f in own] for own in spans], _SPANS),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run,
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, notices array<struct<label:string,notice:string,first_word:bigint,last_word:bigint,edits:bigint>>",
    )
