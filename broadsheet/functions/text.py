"""Text columns: titles, language, tokens, lengths."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, functions as F

from broadsheet.fixed import CHINESE, ENGLISH, UNKNOWN, UNK_TOKEN, SAFE_NAME_LENGTH
from broadsheet.fixed import UNSAFE_NAME_CHARS, UNTITLED
from broadsheet.functions.core import collapse_ws, is_blank, let
from broadsheet.functions.core import ws_trim

HAN = "[一-鿿]"
LATIN = "[A-Za-z]"
# Han characters of a word and of a run that is read at once, at most.
LONGEST_WORD, LONGEST_RUN = 4, 256
# What a character outside the lexicon costs more than its rarest word, in thousandths of a nat.
UNKNOWN_COST = 1_000
# Distinct runs that a task remembers the words of.
_RUNS_HELD = 200_000
# One token per match: a Han character with its neighbour, one that has none, or a run. Pairs
# overlap because the match itself takes one character only.
_HAN_TOKEN = f"(?=({HAN}{{2}}|(?<!{HAN}){HAN}|[a-z0-9]+))(?:{HAN}|[a-z0-9]+)"


def normalise_title(title: Column) -> Column:
    """One line, single blanks, trimmed; null becomes empty."""
    return collapse_ws(F.coalesce(title, F.lit("")))


def _count_in(text: Column, letters: str) -> Column:
    """Characters of a class, counted by taking whole runs of them out."""
    left = F.char_length(F.regexp_replace(text, f"{letters}+", ""))
    return F.coalesce(F.char_length(text) - left, F.lit(0))


def han_count(text: Column) -> Column:
    return _count_in(text, HAN)


def latin_count(text: Column) -> Column:
    return _count_in(text, LATIN)


def han_ratio(text: Column) -> Column:
    """Han characters as a share of Han plus Latin letters; null when there are neither."""
    han = han_count(text)
    return F.try_divide(han, han + latin_count(text))


def language_of_ratio(ratio: Column, threshold: float = 0.5) -> Column:
    """Language for a Han share. The share at the threshold itself is still English."""
    if threshold >= 1:
        is_han = ratio == 1.0  # Han only is Chinese whatever the threshold
    else:
        is_han = ratio > max(threshold, 0.0)  # Latin only is English whatever the threshold
    # A map lookup keeps the ratio a single, always evaluated expression.
    names = F.create_map(F.lit(True), F.lit(CHINESE), F.lit(False), F.lit(ENGLISH))
    return F.coalesce(F.try_element_at(names, is_han), F.lit(UNKNOWN))


def detect_language(text: Column, threshold: float = 0.5) -> Column:
    """``Chinese``, ``English`` or ``Unknown`` by letter counts."""
    return language_of_ratio(han_ratio(text), threshold)


def latin_tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers, ``['<UNK>']`` when there are none."""
    return or_unknown(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def or_unknown(words: Column) -> Column:
    """The words, or the sentinel that stands for a text without any."""
    sentinel = F.array(F.lit(UNK_TOKEN))
    return let(words, lambda found: F.when(F.size(found) > 0, found).otherwise(sentinel))


def latin_token_count(text: Column) -> Column:
    """``size(latin_tokens(text))`` without building the array."""
    return F.greatest(F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")), F.lit(1))


def han_tokens(text: Column) -> Column:
    """Overlapping Han pairs, single Han characters standing alone, Latin and digit runs.

    For texts without a lexicon: word boundaries are not guessed, every adjacent pair is a token.
    """
    return or_unknown(F.regexp_extract_all(F.lower(text), F.lit(_HAN_TOKEN), F.lit(1)))


def _segmenter(lexicon: Mapping[str, int]):
    """The words of every text of an Arrow array, as a function that needs nothing of this package.

    For every length of a run's beginning the best sum of scores is kept and the length of its
    last word; of equal sums the longer last word wins. Words are read off backwards. Equal runs
    are read once while they are among the last ``_RUNS_HELD`` that a task has met.
    """
    known, unknown = dict(lexicon), min(lexicon.values(), default=0) - UNKNOWN_COST
    pieces = re.compile(f"{HAN}{{1,{LONGEST_RUN}}}|[a-z0-9]+").findall
    longest, held, most, sentinel = LONGEST_WORD, {}, _RUNS_HELD, [UNK_TOKEN]

    def read(run: str) -> list[str]:
        if run[0] < "\x80":
            return [run]
        sums, sizes = [0], [0]
        for i in range(1, len(run) + 1):
            best, size = sums[i - 1] + known.get(run[i - 1], unknown), 1
            for n in range(2, min(i, longest) + 1):
                score = known.get(run[i - n : i])
                if score is not None and sums[i - n] + score >= best:
                    best, size = sums[i - n] + score, n
            sums.append(best)
            sizes.append(size)
        words, at = [], len(run)
        while at:
            words.append(run[at - sizes[at] : at])
            at -= sizes[at]
        return words[::-1]

    def words_of(text: str | None) -> list[str]:
        found: list[str] = []
        for piece in pieces(text or ""):
            words = held.get(piece)
            if words is None:
                if len(held) >= most:
                    held.clear()
                words = held[piece] = read(piece)
            found += words
        return found or sentinel

    def segment(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = [
            pa.array([words_of(t) for t in texts.slice(at, 256).to_pylist()], kind) for at in range(0, len(texts), 256)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return segment


def han_words(text: Column, lexicon: Mapping[str, int]) -> Column:
    """Words of a lexicon that make up the Han runs at the greatest sum of scores, and Latin runs.

    Every single character is a word, so any run can be read; one that the lexicon lacks costs more
    than its rarest word. Runs are cut after ``LONGEST_RUN`` characters, so the cost is linear. An
    empty lexicon takes runs apart into characters. Texts are read in Arrow batches.
    """
    return F.arrow_udf(_segmenter(lexicon), "array<string>")(F.lower(text))


def tokens(text: Column, language: str, lexicon: Mapping[str, int] | None = None) -> Column:
    """Tokens under one language's rule; Chinese ones are words where a lexicon is given."""
    if language != CHINESE:
        return latin_tokens(text)
    return han_tokens(text) if lexicon is None else han_words(text, lexicon)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def utf16_left(text: Column, units: int) -> Column:
    """The first ``units`` UTF-16 units; a character that would be cut in half is left out."""
    head = F.substring(text, 1, units)
    wide = F.substring(F.encode(text, "UTF-16BE"), 1, 2 * units)
    # A dangling high surrogate (D800-DBFF) has no text form.
    whole = F.when(
        F.hex(F.substring(wide, 2 * units - 1, 1)).rlike("^D[89AB]$"),
        F.substring(wide, 1, 2 * units - 2),
    ).otherwise(wide)
    return F.when(utf16_length(head) <= units, head).otherwise(F.decode(whole, "UTF-16BE"))


def safe_name(name: Column) -> Column:
    """A name that can be a folder: refused characters become ``_``, blank is 'untitled'."""
    given = F.when(is_blank(name), F.lit(UNTITLED)).otherwise(name)
    cleaned = ws_trim(F.regexp_replace(given, UNSAFE_NAME_CHARS, "_"))
    named = F.when(cleaned == "", F.lit(UNTITLED)).otherwise(cleaned)
    return utf16_left(named, SAFE_NAME_LENGTH)


def short_hash(text: Column) -> Column:
    """First six bytes of SHA-256 as upper-case hex."""
    return F.upper(F.substring(F.sha2(text, 256), 1, 12))


def archive_key(title: Column, url: Column) -> Column:
    """``{safe title}_{short hash of the URL}``."""
    return F.concat(safe_name(title), F.lit("_"), short_hash(url))


def link_text(title: Column, url: Column) -> Column:
    """``title -> url`` with nulls as empty text."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" -> "), F.coalesce(url, F.lit("")))


def default_text(text: Column, default: str) -> Column:
    """Trimmed text, or the default when blank."""
    return F.when(is_blank(text), F.lit(default)).otherwise(ws_trim(text))


def cut_text(text: Column, units: int, mark: str) -> Column:
    """Text longer than ``units`` UTF-16 units is cut there and marked."""
    return F.when(
        utf16_length(text) > units, F.concat(utf16_left(text, units), F.lit(mark))
    ).otherwise(text)


