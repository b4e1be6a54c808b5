"""Quality rules: lines are judged and removed first, then documents that lost too much."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the contract.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# A document goes if its failing lines hold more than this share of its words.
MOST_LOST_PERCENT = 30

# Line rules, on a line in lower-case ASCII without blanks at its ends.
# A sentence ends in one of these marks, perhaps inside closing quotes or brackets.
SENTENCE_ENDS = ".!?:;…。！？؟۔।"
CLOSERS = "\"')]»”’"
# Three or more runs of marks of one kind: shouting, or words hung with symbols.
MARKS = "!?#*$%&"
MARKED = r"[!?]{2}.*[^!?][!?]{2}.*[^!?][!?]{2}|[#*$%&]{2}.*[^#*$%&][#*$%&]{2}.*[^#*$%&][#*$%&]{2}"
# A whole line that is one link of a page's frame, perhaps with an arrow behind it.
FRAME = (
    "home|menu|search|next|previous|prev|back|back to top|top|skip to content|skip to main content"
    "|read more|more|show more|load more|see also|share|share this|tweet|print|email|reply|comments?"
    "|log in|login|sign in|sign up|register|subscribe|contact|contact us|about|about us|help|faq|sitemap"
    "|next page|previous page|page [0-9]{1,6}( of [0-9]{1,6})?"
)
FRAME_TAIL, FRAME_LENGTH = " .:!>»", 30
# Links in a row: two or more dividers with something on either side.
DIVIDERS, DIVIDED = "|>»·", 2
NOTICES = (
    "all rights reserved", "privacy policy", "cookie policy", "terms of use", "terms of service", "use cookies",
    "uses cookies", "enable javascript", "javascript is disabled", "javascript is required", "lorem ipsum",
    "click here", "subscribe to our", "sign up for our", "powered by", "is licensed under", "copyright (c)",
    "copyright ©",
)
NOTICE_STARTS = ("licensed under", "released under", "©", "(c) ")
RULES = ("punctuation", "navigation", "boilerplate")

_WORDS = re.compile(WORD).findall
_MARKED = re.compile(MARKED).search
_FRAME = re.compile(FRAME).fullmatch
_ENDS = frozenset(SENTENCE_ENDS)


def _is_navigation(line: str) -> bool:
    if sum(line.count(d) for d in DIVIDERS) >= DIVIDED:
        pieces = re.split(f"[{DIVIDERS}]", line)
        return all(p.strip(" ") for p in pieces)
    bare = line.rstrip(FRAME_TAIL)
    return len(bare) <= FRAME_LENGTH and bool(_FRAME(bare))


def line_fault(line: str) -> str | None:
    """The first rule that a line with words breaks."""
    plain = line.strip(BLANKS)
    # Bytes have lower case for A to Z only.
    plain = plain.encode().lower().decode()
    if plain.rstrip(CLOSERS)[-1:] not in _ENDS:
        # A frame's links rarely end like sentences: they are told apart for the counts.
        return "navigation" if _is_navigation(plain) else "punctuation"
    if sum(plain.count(m) for m in MARKS) >= 6 and _MARKED(plain):
        return "punctuation"
    if _is_navigation(plain):
        return "navigation"
    if plain.startswith(NOTICE_STARTS) or any(n in plain for n in NOTICES):
        return "boilerplate"
    return None


def repeated_words(words: list[str]) -> int:
    """Words that stand in a window of three words found twice or more."""
    if len(words) <= WINDOW:
        return 0
    numbers = dict(zip(dict.fromkeys(words), range(len(words))))
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    keys = ids
    for k in range(1, WINDOW):
        if int(keys.max()) >= 2**62 // len(numbers):
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys[:-1] * len(numbers) + ids[k:]
    ordered = np.sort(keys)
    twice = ordered[:-1][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(keys, twice))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(WINDOW):
        covered[starts + k] = True
    return int(covered.sum())


def judge(text: str | None) -> tuple:
    """Counts, verdicts and the cleaned text of one document."""
    text = text or ""
    words: list[str] = []
    faults = dict.fromkeys(RULES, 0)
    seen: set[str] = set()
    duplicates, lost, kept_lines = 0, 0, []
    for line in text.split("\n"):
        own = _WORDS(line)
        if not own:
            kept_lines.append(line)
            continue
        words += own
        duplicates += line in seen
        seen.add(line)
        fault = line_fault(line)
        if fault is None:
            kept_lines.append(line)
        else:
            faults[fault] += 1
            lost += len(own)
    n = len(words)
    repeats = repeated_words(words)
    base_failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED_PERCENT * n
    kept = not base_failed and 100 * lost <= MOST_LOST_PERCENT * n
    letters = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    return (n, letters, symbols, duplicates, repeats, base_failed, kept, lost, *faults.values(), "\n".join(kept_lines))


_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
_RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lost_words long, n_punctuation long, n_navigation long, n_boilerplate long, clean_text string"
)


def quality(docs: DataFrame, texts: bool = True) -> DataFrame:
    """All columns of ``docs`` with counts, verdicts and ``clean_text``.

    Every line with a word is judged: it must end like a sentence and not be full of marks (punctuation), be
    no frame of a page (navigation) and no notice (boilerplate). Failing lines are left out of
    ``clean_text``; ``kept`` is false if they hold over 30 percent of the words, or if
    ``base_failed``: under 50 words, or over half of them in repeated windows of three words.
    ``clean_text`` is given for rejected documents too. ``texts=False`` leaves it out.

    A null text counts as empty: no words, base failed, empty ``clean_text``. Rows are judged one
    by one, so repeated rows and null ids stay as they are. Columns of ``docs`` with a name of the
    result are replaced. Texts are read whole, one at a time; nothing is shuffled.
    """
    fields = _RESULT if texts else _RESULT.rsplit(",", 1)[0]
    names = [f.split()[0] for f in fields.split(", ")]
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # A slice ends once it holds a few million characters, however long one text is.
                found, room, start = [], 4_000_000, at
                while at < batch.num_rows and room > 0:
                    text = batch.column("text")[at].as_py()
                    found.append(judge(text))
                    room -= 1 + len(text or "")
                    at += 1
                part = batch.slice(start, at - start)
                columns = [list(c) for c in zip(*found)][: len(names)]
                arrays = [pa.array(c, _ARROW[f.split()[1]]) for c, f in zip(columns, fields.split(", "))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *names])

    return rows.mapInArrow(run, f"{schema}, {fields}")
