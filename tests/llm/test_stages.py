"""Columns of any name and type, null ids and odd texts on every stage of the pipeline."""

import hashlib
import time

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from broadsheet.llm import language, mixing, runs, simhash, substrings
from broadsheet.llm.rangecoder import Model, encode_block
from broadsheet.llm.common import importable

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog", "en"), (2, "the quick brown fox jumps over the lazy dog", "en"),
    (3, "一二三", "zh"), (4, "Ⅷ 12 ½", None), (5, None, None), (6, "der schnelle braune Fuchs springt", "de"),
    (None, "ein Text ohne Nummer", "de"), (None, "and another one", "en"), (6, "der schnelle braune Fuchs springt", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    clashing = ["score", "lang_pred", "_lang_pred", "taken", "_taken", "size", "copy", "hash", "route", "words", "nth", "taken_id"]
    return rows.withColumns(
        {"source": F.lit("a"), "n_chars": F.length("text").cast("long"), "tags": F.create_map(F.lit("k"), F.col("lang")),
         "nested": F.struct(F.create_map(F.lit("n"), F.lit(1)).alias("m"))} | {c: F.lit(f"own {c}") for c in clashing}
    ).repartition(2)


def own_columns(rows):
    found = rows.collect()
    return {c for c in rows.columns if found and all(r[c] == f"own {c}" for r in found)}


def test_every_stage_keeps_columns_of_any_name(spark, docs):
    clashing = own_columns(docs)
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, None)
        assert rows.columns == docs.columns
        assert own_columns(rows) == clashing and len(clashing) == 12
        assert rows.filter("doc_id IS NULL").count() >= 2
    assert {r.doc_id for r in rows.collect()} == {1, 3, 6, None}
    last = corpus_pipeline.STAGES[-1][1](spark, rows, None).collect()
    assert len(last) == rows.count() and all(r.n_tokens == len(r.ids) for r in last)


def test_letters_that_are_numbers_too(docs):
    model = language.Model(["en", "zh"], [(0, "一二三", 1, 5), (1, "a", 0, 1)])
    assert model.predict("一二三")[0] == "zh"
    assert model.predict("Ⅷ 12 ½") == ("und", 0.0)
    # Equal languages: the first by code point.
    assert language.Model(["de", "en"], [(0, "x", 0, 1), (0, "x", 1, 1)]).predict("x") == ("de", 0.5)


def test_bounds_of_the_language_model_are_parameters(docs):
    model = language.train(docs, docs_per_language=5, words_per_language=2, grams_per_language=3)
    assert sum(len(n) for n in model.numbers) <= 3 * (2 + 4 * 3)


def test_smallest_row_of_a_repeated_document_with_maps(spark):
    rows = spark.createDataFrame([(1, "a b c d", {"k": 2}), (1, "a b c d", {"k": 1}), (2, "a b c d", {"k": 0})], "doc_id long, text string, m map<string,int>")
    assert [(r.doc_id, r.m) for r in simhash.drop_near_duplicates(rows).collect()] == [(1, {"k": 1})]


def test_null_ids_take_part_in_the_mixture(spark):
    rows = spark.createDataFrame([(None, "one two three", "s"), (1, "four five", "s"), (None, None, "s")], "doc_id long, text string, source string")
    mixed = mixing.mixed_documents(rows, share=2.0)
    assert sorted((r.doc_id or 0, r.text) for r in mixed.collect()) == [(0, "one two three")] * 2 + [(1, "four five")] * 2


WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def test_runs_are_cut_as_by_pattern(monkeypatch):
    rng = np.random.default_rng(3)
    characters = list("ab é中\t\n\x85\xa0     　\x1c​Ââã‐")
    monkeypatch.setattr(runs, "RUNS", 7)
    for _ in range(800):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(characters, rng.integers(0, 9))) for _ in range(rng.integers(0, 6))]
        column = pa.array([*texts, "behind"], pa.string()).slice(0, len(texts))
        data, borders, first = runs.units(column)
        want = [regex.findall(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+$", t or "") for t in texts]
        got = [data[a:b].tobytes().decode() for a, b in zip(borders, borders[1:])]
        assert got == [w for own in want for w in own] and np.diff(first).tolist() == [len(own) for own in want]
        assert [words[i] for words, which in runs.dictionaries(data, borders) for i in which.to_pylist()] == got


def test_slices_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(runs, "BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["abc", None, "x" * 50, "", "de", "fghijklm"])})
    parts = [p.column("text").to_pylist() for p in runs.slices(batch)]
    assert [t for p in parts for t in p] == batch.column("text").to_pylist() and ["x" * 50] in [p[:1] for p in parts]
    assert list(runs.slices(batch.slice(0, 0))) == []


def test_a_passage_in_every_document(spark, docs):
    """Only the first document keeps it."""
    words = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(i, f"{i} {words} {i}") for i in range(6)], "doc_id long, text string")
    found = substrings.repeated(rows.withColumn("lang", F.lit("x")))
    got = {r.doc_id: r.n_removed for r in found.collect()}
    assert got == {0: 0, **dict.fromkeys(range(1, 6), 30)}
    kept = {r.doc_id: r.text for r in found.collect()}
    assert kept[3] == "3 3" and hashlib.md5(kept[0].encode()).digest() == substrings.digest_of(f"0 {words} 0".encode())


def test_known_runs_stay_within_their_limit():
    """Ids stay right when the table turns over; it took hundreds of bytes a run before."""
    asked = []

    def learn(new):
        asked.extend(got := new.to_pylist())
        return runs.lists(np.array([len(r) + k for r in got for k in range(2)]), np.full(len(got), 2))

    known = runs.Known(learn, 3000)
    rng = np.random.default_rng(1)
    for _ in range(40):
        texts = pa.array([" ".join("x" * int(n) for n in rng.integers(1, 60, 30)), None, "", " \u3000 x "], pa.string())
        ids, borders = known.ids_of_all(*runs.words(texts))
        want = [[len(w) + k for w in (t or "").split() for k in range(2)] for t in texts.to_pylist()]
        assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == want
        assert known.runs.nbytes + known.ids.nbytes <= 3000
    assert 59 < len(asked) < 40 * 30


def test_known_runs_are_not_gone_through_again():
    """Looking a few runs up took as long as all known ones before."""
    known = runs.Known(lambda new: runs.lists(np.arange(len(new)), np.ones(len(new), np.int64)), 1 << 30)
    all_runs = pa.array([f"run{i}" for i in range(200_000)], pa.large_string())
    assert (known.ids_of(all_runs)[0] == np.arange(200_000)).all()
    began = time.process_time()
    pa.concat_arrays([all_runs] * 10).dictionary_encode()
    ended = time.process_time()
    for i in range(0, 200_000, 2_000):
        assert known.ids_of(all_runs.slice(i, 2))[0].tolist() == [i, i + 1]
    assert time.process_time() - ended < ended - began


def test_runs_with_one_hash_are_told_apart(monkeypatch):
    """And strings have the same hash whatever stands beside them."""
    monkeypatch.setattr(runs, "PIECE", 50)
    strings = ["", "a", "é", "x" * 49, "x" * 50, "x" * 51, "x" * 120, *(f"w{i}" for i in range(40)), "y" * 200]
    each = [int(runs.keys(pa.array([s], pa.large_string()))[0]) for s in strings]
    assert runs.keys(pa.array(strings, pa.large_string())).tolist() == each and len(set(each)) == len(strings)

    monkeypatch.setattr(runs, "keys", lambda distinct: np.array([len(s) % 3 for s in distinct.to_pylist()], np.uint64))
    known = runs.Known(lambda new: pa.array([list(s.encode()) for s in new.to_pylist()], pa.large_list(pa.uint32())), 2000)
    rng = np.random.default_rng(2)
    for _ in range(30):
        wanted = [strings[i] for i in rng.integers(0, len(strings), 20)]
        ids, sizes = known.ids_of(pa.array(wanted, pa.large_string()))
        assert bytes(ids.tolist()) == "".join(wanted).encode()
        assert sizes.tolist() == [len(s.encode()) for s in wanted]


def test_blocks_are_the_bytes_they_were():
    mixed = (np.arange(300_000) * 2654435761 >> 9) % 7919 ** 2 % 5000
    ids = np.concatenate((mixed, np.tile(np.arange(700), 100), np.zeros(5000, int))).astype("<u4")
    small = encode_block(ids[:1], 5000) + encode_block(ids[:1000], 1 << 19) + encode_block(ids[-100:], 1)
    found = [hashlib.sha256(b).hexdigest()[:16] for b in (encode_block(ids, 5000), small)]
    assert found == ["6a719cb25ef61909", "54b225bc59e956b7"]


def test_a_place_is_found_in_the_ids_range():
    model = Model(1000)
    model.counts[3] += 100_000
    model._share()
    model.index()
    slots = np.concatenate((np.arange(0, 1 << 20, 97), model.id_ends - 1, [(1 << 20) - 1]))
    want = np.minimum(np.searchsorted(model.id_ends, slots, side="right"), 999)
    assert (model.holder(slots) == want).all()


def test_windows_of_many_texts_are_those_of_each():
    """Runs, anchors and joined words do not depend on the texts beside, on white space or on slices."""
    rng = np.random.default_rng(3)
    texts = ["", None, " \t", "a " * 40]
    for _ in range(60):
        words = ["w" * int(n) + str(n % 7) for n in rng.integers(0, 24, int(rng.integers(0, 60)))]
        texts.append(rng.choice(["", " ", "\n"]) + "".join(w + rng.choice([" ", "\r\n", "  ", "\x0b"]) for w in words) + rng.choice(["", "é"]))
    every = substrings.Windows(pa.array(texts, pa.string()), 13, 6)
    got = {}
    for owner, start, end, anchor in zip(every.owners.tolist(), every.starts.tolist(), every.ends.tolist(), every.anchors().tolist()):
        base = int(every.before[owner])
        for i in range(start, end + 1):
            got[owner, i - base] = (anchor, every.words(i, i))
    by_words = {}
    for owner, text in enumerate(texts):
        words = (text or "").encode().split()
        alone = substrings.Windows(pa.array(["x y", text], pa.string()), 13, 6)
        assert alone.before[2] - alone.before[1] == len(words)
        for i in range(max(0, len(words) - 12)):
            anchor, piece = got.pop((owner, i))
            assert piece == b" ".join(words[i : i + 13])
            assert by_words.setdefault(piece, anchor) == anchor
            assert anchor in alone.anchors()
    assert not got


def test_the_leftmost_least_value_of_every_stretch():
    values = np.random.default_rng(5).integers(0, 5, 300).astype(np.uint64)
    for width in (1, 2, 3, 8, 13):
        views = np.lib.stride_tricks.sliding_window_view(values, width)
        assert (substrings._leftmost_least(values, width) == np.arange(len(views)) + views.argmin(axis=1)).all()
