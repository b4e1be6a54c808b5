"""Language identification by words first and character n-grams for words never seen."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from broadsheet.llm import runs
from broadsheet.llm.common import tidy

UNDETERMINED = "und"
# Bounds of the model, whatever the size of the corpus.
DOCS_PER_LANGUAGE = 5_000
LANGUAGES = 1_000
WORDS_PER_LANGUAGE = 20_000
GRAMS_PER_LANGUAGE = 10_000  # for each length
GRAM = 4
CACHE = 200_000
_LETTERS = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: a quarter, by the checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if no character is a letter."""
    words = _LETTERS((text or "").lower())
    return words if any(w.isalpha() or any(map(str.isalpha, w)) for w in words) else []


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word between its marks; single characters go without them."""
    marked = word if n == 1 else f"_{word}_"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies per language of words and of n-grams; a bounded table.

    Each kind of unit has one matrix with a row per unit, and the row numbers by unit.
    """

    def __init__(self, languages: list[str], counts: list[tuple[int, str, int, int]]):
        self.languages = languages
        size = len(languages)
        self.numbers: list[dict[str, int]] = [{} for _ in range(GRAM + 1)]
        for kind, unit, _, _ in counts:
            self.numbers[kind].setdefault(unit, len(self.numbers[kind]))
        self.tables: list[np.ndarray] = []
        for kind, numbers in enumerate(self.numbers):
            table = np.zeros((len(numbers), size))
            own = [(numbers[unit], language, n) for k, unit, language, n in counts if k == kind]
            rows, columns, sums = np.array(own, dtype=np.int64).reshape(-1, 3).T
            np.add.at(table, (rows, columns), sums)
            floor = 0.5
            shares = (table + floor) / (table.sum(axis=0) + floor * (len(numbers) + 1))
            self.tables.append(np.log(shares).astype(np.float32))
        self._forget()

    def _forget(self) -> None:
        self._rows: dict[str, int] = {}
        self._matrix = np.zeros((1024, len(self.languages)), np.float32)

    def __getstate__(self):
        return {"languages": self.languages, "numbers": self.numbers, "tables": self.tables}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def word_scores(self, word: str) -> np.ndarray:
        """Log frequency of a known word; else the mean over its longest known n-grams."""
        known = self.numbers[0].get(word)
        if known is not None:
            return self.tables[0][known]
        for n in range(GRAM, 0, -1):
            numbers = self.numbers[n]
            found = [numbers[g] for g in grams_of(word, n) if g in numbers]
            if found:
                return self.tables[n][found].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def _row(self, word: str) -> int:
        if len(self._rows) >= CACHE:  # only a cache of scores: they are worked out again
            self._rows.clear()
        at = len(self._rows)
        if at == len(self._matrix):
            self._matrix = np.concatenate([self._matrix, np.zeros_like(self._matrix)])
        self._matrix[at] = self.word_scores(word)
        self._rows[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.languages:
            return UNDETERMINED, 0.0
        total, get = np.zeros(len(self.languages)), self._rows.get
        for at in range(0, len(words), CACHE // 4):
            part = words[at : at + CACHE // 4]
            if len(self._rows) + len(part) > CACHE:
                self._rows.clear()
                get = self._rows.get
            rows = [self._row(w) if (r := get(w)) is None else r for w in part]
            total += self._matrix[rows].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())  # ties go to the first language by code point
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def train(
    docs: DataFrame,
    docs_per_language: int = DOCS_PER_LANGUAGE,
    words_per_language: int = WORDS_PER_LANGUAGE,
    grams_per_language: int = GRAMS_PER_LANGUAGE,
) -> Model:
    """Learn from ``text`` and ``lang`` of the rows that are not held out.

    The sample is bounded: about ``docs_per_language`` documents of each language, chosen by a
    hash of the id (all of them where there are fewer); rows with a null ``lang``, ``text`` or
    ``doc_id`` are not learned from. Words and n-grams are counted by Spark; the driver
    gets the most frequent ones, at most ``words_per_language`` words and ``grams_per_language``
    n-grams of each length. More than ``LANGUAGES`` distinct labels are an error.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    )
    sizes = labelled.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], [])
    share = F.create_map(
        *[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, docs_per_language / r["count"]))]
    )
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def words(batches):
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                found = words_of(text)
                yield pa.RecordBatch.from_pydict({"unit": pa.array(found, pa.string()), "lang": pa.array([lang] * len(found), pa.string())})

    counted = (
        labelled.filter(drawn).select("text", "lang").mapInArrow(tidy(words), "unit string, lang string").groupBy("lang", "unit").agg(F.count("*").alias("n"))
    )

    def grams(batches):
        for batch in batches:
            rows: dict[tuple[int, str, str], int] = {}
            for unit, lang, n in zip(*(batch.column(c).to_pylist() for c in ("unit", "lang", "n"))):
                rows[0, unit, lang] = rows.get((0, unit, lang), 0) + n
                for size in range(1, GRAM + 1):
                    for gram in grams_of(unit, size):
                        rows[size, gram, lang] = rows.get((size, gram, lang), 0) + n
            keys = list(rows)
            yield pa.RecordBatch.from_pydict(
                {"kind": pa.array([k[0] for k in keys], pa.int32()), "unit": [k[1] for k in keys],
                 "lang": [k[2] for k in keys], "n": pa.array([rows[k] for k in keys], pa.int64())}
            )

    units = (
        counted.select("unit", "lang", "n").mapInArrow(tidy(grams), "kind int, unit string, lang string, n long")
        .groupBy("kind", "lang", "unit").agg(F.sum("n").alias("n"))
    )
    most = F.when(F.col("kind") == 0, words_per_language).otherwise(grams_per_language)
    order = Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "unit")
    top = units.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    number = {lang: i for i, lang in enumerate(languages)}
    counts = [(r["kind"], r["unit"], number[r["lang"]], r["n"]) for r in top.collect()]
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` with two more: the language and its posterior.

    A null text, or one without a letter, is ``und`` with score 0; of equal languages the first by
    code point is taken. Only the text is read; whole texts are. Columns of the given names are
    replaced. No shuffle; a task holds the model, a few megabytes of text and what it has cached.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        ready = shipped.value
        for batch in batches:
            for part in runs.slices(batch):
                found = [ready.predict(text.as_py()) for text in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    [*part.schema.names, *names],
                )

    return rows.mapInArrow(tidy(run), f"{schema}, `{names[0]}` string, `{names[1]}` double")
