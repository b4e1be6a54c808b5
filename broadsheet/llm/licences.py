"""Licence scans: texts are streamed through a suffix automaton of licence templates."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Phrases whose every place counts, and the label of each.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Public licence notices, in words; a label may have several.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file "
               "except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 "
                 "international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms "
            "of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files the software to deal in the software "
            "without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied"),
)
# A match of so many words is long; links of a chain leave out at most GAP words; a chain that
# covers SHARE of its template is a span.
LONG, GAP, SHARE = 4, 10, 0.8

_TO_SPACE = bytes(
    c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or b"").lower().translate(_TO_SPACE).split()


@dataclass
class Automaton:
    """Suffix automaton of several token sequences.

    A state stands for the sequences that end at the same places of the templates; ``ends`` lists
    those places as (template, last token).
    """

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, like: int | None = None) -> int:
        self.step.append(dict(self.step[like]) if like is not None else {})
        self.link.append(self.link[like] if like is not None else 0)
        self.length.append(length)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, at: int, token: int) -> int:
        """The state of exactly the longest sequence of ``at`` and ``token``."""
        old = self.step[at][token]
        if self.length[old] == self.length[at] + 1:
            return old
        new = self._state(self.length[at] + 1, old)
        self.link[old] = new
        while at >= 0 and self.step[at].get(token) == old:
            self.step[at][token] = new
            at = self.link[at]
        return new

    def add(self, number: int, tokens: list[int]) -> int:
        """Add a template; returns the state of the whole sequence."""
        last = 0
        for place, token in enumerate(tokens):
            if token in self.step[last]:
                last = self._split(last, token)
            else:
                new = self._state(self.length[last] + 1)
                at = last
                while at >= 0 and token not in self.step[at]:
                    self.step[at][token] = new
                    at = self.link[at]
                self.link[new] = 0 if at < 0 else self._split(at, token)
                last = new
            self.ends[last].append((number, place))
        return last

    def finish(self) -> None:
        """Pass the places of longer sequences on to their suffixes."""
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            above = self.ends[self.link[state]]
            known = set(above)
            above.extend(e for e in self.ends[state] if e not in known)


class Scanner:
    """The automaton of all phrases and templates, ready to read texts."""

    def __init__(self, base: dict[str, str], templates: tuple[tuple[str, str], ...]):
        self.ids: dict[bytes, int] = {}
        self.automaton = Automaton()
        self.templates = [(label, self._tokens(text)) for label, text in templates]
        self.phrases = [(label, self._tokens(text)) for text, label in base.items()]
        whole = []
        for number, (_, tokens) in enumerate(self.templates + self.phrases):
            whole.append(self.automaton.add(number, tokens))
        self.automaton.finish()
        # A clone may have taken over a phrase's state, so phrases are read from the root.
        terminal: dict[int, list[int]] = {}
        for p, (_, tokens) in enumerate(self.phrases):
            state = 0
            for token in tokens:
                state = self.automaton.step[state][token]
            terminal.setdefault(state, []).append(p)
        self.phrases_at = []
        for state in range(len(self.automaton.link)):
            at, found = state, []
            while at > 0:
                found += terminal.get(at, [])
                at = self.automaton.link[at]
            self.phrases_at.append([(p, len(self.phrases[p][1])) for p in found])
        self.shortest = min(len(t) for _, t in self.templates + self.phrases)

    def _tokens(self, text: str) -> list[int]:
        return [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text.encode())]

    def matches(self, words: list[bytes]):
        """Places of phrases (phrase, first word), and maximal long matches (last word, length,
        state), read off the matching statistics of the text."""
        get = self.ids.get
        tokens = np.array([get(w, 0) for w in words], dtype=np.int32)
        inside = np.flatnonzero(np.diff(np.concatenate(([0], tokens > 0, [0])).astype(np.int8)))
        firsts, lasts = inside[::2], inside[1::2]
        wide = lasts - firsts >= min(self.shortest, LONG)
        step, link, length = self.automaton.step, self.automaton.link, self.automaton.length
        phrases_at = self.phrases_at
        places, long = [], []
        for first, last in zip(firsts[wide].tolist(), lasts[wide].tolist()):
            state = matched = 0
            for i, token in enumerate(tokens[first:last].tolist(), first):
                before = state, matched
                while state and token not in step[state]:
                    state = link[state]
                    matched = length[state]
                if token in step[state]:
                    state = step[state][token]
                    matched += 1
                if matched <= before[1] and before[1] >= LONG:
                    long.append((i - 1, before[1], before[0]))
                for p, size in phrases_at[state]:
                    if size <= matched:
                        places.append((p, i - size + 1))
            if matched >= LONG:
                long.append((last - 1, matched, state))
        return places, long

    def spans(self, long) -> list[tuple[str, int, int, float]]:
        """Chains of long matches in template order: (label, first word, last word, share)."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for last, size, state in long:
            for template, end in self.automaton.ends[state]:
                if template < len(self.templates):
                    by_template.setdefault(template, []).append((last - size + 1, end - size + 1, size))
        found = []
        for template, matches in by_template.items():
            label, tokens = self.templates[template]
            chain = None
            for at, place, size in sorted(matches):
                if chain is not None:
                    first, end, place_end, covered = chain
                    skip = max(end - at, place_end - place, 0)  # words that the chain has already
                    if at - end <= GAP and 0 <= place + skip - place_end <= GAP and skip < size:
                        chain = (first, at + size, place + size, covered + size - skip)
                        continue
                    if at < end:  # the same words again at another place of the template
                        continue
                    found.append((label, first, end - 1, covered / len(tokens)))
                chain = (at, at + size, place + size, size)
            first, end, _, covered = chain
            found.append((label, first, end - 1, covered / len(tokens)))
        return sorted(s for s in found if s[3] >= SHARE)

    def scan(self, text: bytes | None) -> dict:
        words = words_of(text)
        places, long = self.matches(words)
        spans = self.spans(long)
        covered = np.zeros(len(words), dtype=bool)
        for p, first in places:
            covered[first : first + len(self.phrases[p][1])] = True
        for _, first, last, _ in spans:
            covered[first : last + 1] = True
        base = {self.phrases[p][0] for p, _ in places}
        starts = [first for _, first in places]
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s[0] for s in spans})),
            "score": float(covered.sum() / len(words)) if words else 0.0,
            "spans": [dict(zip(("label", "first", "last", "share"), s)) for s in spans],
        }


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, "
    "spans array<struct<label: string, first: long, last: long, share: double>>"
)
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
     ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
     ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)


def licence_scan(docs: DataFrame, base=None, templates=None) -> DataFrame:
    """Licence phrases and notices of every document; one row per row of ``docs``.

    ``n_base`` counts all places of the base phrases, overlapping ones too; ``first_word`` and
    ``last_word`` are their smallest and largest first word, null without any. ``spans`` are
    chains of long matches that cover four fifths of a template or more. ``labels`` holds the base
    labels and those of the spans; ``score`` is the share of words that either covers. A null
    or empty text has no words, no labels and score 0; a null ``doc_id`` stays null; repeated
    rows are scanned each; other columns are not read. No shuffle.
    """
    base, templates = base or BASE, templates or TEMPLATES

    def run(batches):
        scanner = Scanner(base, templates)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rows = [
                {"doc_id": i, **scanner.scan(t.as_py())} for i, t in zip(batch.column("doc_id").to_pylist(), texts)
            ]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
