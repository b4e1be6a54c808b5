"""The operators for training corpora against brute force, on small and awkward tables."""

import hashlib
import io
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import example, given, settings, strategies as st
from oracle import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from broadsheet.llm import bpe, cells, curves, language, licences, mixing, simhash, substrings
from broadsheet.llm import tokenfiles, warc
from broadsheet.llm.common import importable
from broadsheet.llm.components import components
from broadsheet.llm.fmindex import FmIndex
from broadsheet.llm.queries import ORACLES, QUERIES
from broadsheet.llm.rangecoder import HEAD_BYTES, decode_block, encode_block

WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"common{i}" for i in range(40))
# Null, empty and very long texts, ties, repeats, a null id, passages shared inside texts.
AWKWARD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one", None, "b"),
    (5, LONG, "en", "b"), (6, LONG, "en", None), (7, LONG + " tail", "fr", None),
    (8, f"before {PASSAGE} after", "en", "a"), (9, f"other {PASSAGE} end", "en", "a"),
    (10, PASSAGE, "de", "c"), (10, PASSAGE, "de", "c"), (None, PASSAGE, "de", "c"),
    (11, "All Rights Reserved. CC-BY; GNU General Public License all rights reserved", "en", "c"),
    (12, "Released under the MIT license. é Ünï <|endoftext|> Σ 12345 　 x", "de", "d"),
    (13, "12345 !!! 678", "en", "d"), (14, "a " * 400, "es", "d"), (15, "a " * 390, "es", "d"),
]
CLASHES = "known string, hot string, rest string, first string, route string, size long, score string, lang_pred string"


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string")
    extra = {c.split()[0]: F.lit("7").cast(c.split()[1]) for c in CLASHES.split(", ")}
    return rows.withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.limit(0)


def words(text):
    return re.findall(WORD, text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    con = connect(sf_dir)
    same, line = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
    con.close()
    assert same, line


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_equal_union_find(spark, pairs):
    parent = {n: n for p in pairs if p[0] != p[1] for n in p}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    found = components(spark.createDataFrame(pairs or [(None, None)], "a long, b long")).collect()
    want = {n: find(n) for n in parent}
    assert {r.node: r.component for r in found} == {n: c for n, c in want.items() if n != c}


def brute_fingerprint(text, size):
    w = words(ascii_lower(text))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints_and_groups(docs, no_docs):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(AWKWARD)
    prints = {i: brute_fingerprint(t, 3) for i, t, *_ in AWKWARD if i}
    for row in found:
        if row.doc_id:
            assert row.fp % 2**64 == prints[row.doc_id]
            assert row.component_id <= row.doc_id
    groups = {r.doc_id: r.component_id for r in found}
    assert groups[2] == groups[3] == 1 and groups[6] == 5 and groups[None] == 10
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.filter("doc_id IN (2, 3, 6)").count() == 0 and kept.filter("doc_id = 10").count() == 1


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_lose_no_pair_and_join_no_distant_ones(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(8):
            v = int(b)
            for bit in rng.choice(63, rng.integers(1, 5), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    nodes = sorted(values)
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(nodes)], "fp long, node long")
    parent = list(range(len(nodes)))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for j in range(i):
            if (a ^ nodes[j]).bit_count() <= radius:
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    got = {r.node: r.component for r in components(simhash.links(frame, radius)).collect()}
    assert {i: got.get(i, i) for i in range(len(nodes))} == {i: find(i) for i in range(len(nodes))}


def test_covering_masks_cover_all_pairs():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
    assert all(
        any(not m & (1 << a | 1 << b) for m in simhash.covering_masks(2)) for a in range(64) for b in range(64)
    )


def test_licence_phrases_equal_brute_force(docs, no_docs):
    rows = licences.licence_scan(docs).collect()
    assert len(rows) == len(AWKWARD)
    texts = {i: t for i, t, *_ in AWKWARD}
    for row in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(texts.get(row.doc_id, PASSAGE)))
        at = [(i, lab) for p, lab in licences.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (row.n_words, row.n_base) == (len(w), len(at))
        assert row.first_word == min((i for i, _ in at), default=None)
        assert row.last_word == max((i for i, _ in at), default=None)
        assert row.base_labels == ",".join(sorted({lab for _, lab in at}))
        assert 0 <= row.score <= 1 and set(row.base_labels.split(",")) <= set(row.labels.split(",")) | {""}
    assert next(r for r in rows if r.doc_id == 12).labels == "mit"
    assert licences.licence_scan(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=60))
def test_automaton_finds_every_place(text):
    base = {"a b": "x", "b a b": "y", "c c": "z"}
    scanner = licences.Scanner(base, (("t", "a b c a b b"),))
    w = text.encode().split()
    places, _ = scanner.matches(w)
    want = [(p, i) for p, phrase in enumerate(base) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.encode().split()]
    assert sorted(places) == sorted(want)


def test_cells_find_close_pairs(spark):
    importable(spark)
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(1500, 24))
    rows = np.concatenate([rows, rows[:300] + rng.normal(size=(300, 24)) * 0.25, np.repeat(rows[:1], 40, 0)])
    data = [(i, r.tolist()) for i, r in enumerate(rows)]
    data += [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, [None] * 24), (9004, [1e300] * 24), (None, [1.0] * 24), (5, data[5][1])]
    found = {r.vec_id: r for r in cells.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    linked = units @ units.T >= 0.9
    np.fill_diagonal(linked, False)
    got = sum(found[i].n_links for i in range(len(rows)))
    assert 0.99 * linked.sum() <= got <= linked.sum()
    assert all(found[i].n_links <= linked[i].sum() for i in range(len(rows)))
    for i in (9000, 9001, 9002, 9003, 9004, None):
        assert found[i].n_links == 0 and found[i].kept and found[i].component_id == i
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert cells.near_duplicates(empty).count() == 0


def test_cells_recall_at_the_threshold_itself():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(6000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    side = rng.normal(size=rows.shape)
    side -= (side * rows).sum(1)[:, None] * rows
    side /= np.linalg.norm(side, axis=1)[:, None]
    other = 0.9 * rows + np.sqrt(1 - 0.81) * side
    centres = cells.spherical_kmeans(rows, 200)
    near = [np.argpartition(-(x @ centres.T), cells.PROBES - 1, axis=1)[:, : cells.PROBES] for x in (rows, other)]
    met = [bool(set(a) & set(b)) for a, b in zip(*near)]
    assert np.mean(met) >= 0.99


def test_curves_are_exact(spark):
    importable(spark)
    rng = np.random.default_rng(8)
    rows = np.concatenate([rng.normal(size=(900, 10)) * rng.uniform(0.2, 3, (900, 1)), np.ones((30, 10))])
    data = [(i, r.tolist()) for i, r in enumerate(rows)] + [(2000, None), (2020, [0.0] * 10), (None, [1.0] * 10), (3, rows[3].tolist())]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = curves.nearest(frame, F.col("vec_id") % 20 == 0, k=7).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 930, 20))
    for q, ids in got.items():
        score = rows @ rows[q]
        best = sorted((i for i in range(930) if i != q), key=lambda i: (-round(score[i], 9), i))[:7]
        assert ids == best
    few = curves.nearest(frame.filter("vec_id < 4"), F.col("vec_id") % 20 == 0, k=7)
    assert few.count() == 3
    assert curves.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_keys_are_neighbours():
    side = np.arange(16)
    points = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    keys = curves.hilbert_keys(points, 4)
    walk = points[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(16**3))
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_language_of_held_out_documents(spark, sf_dir, docs, no_docs):
    importable(spark)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = language.predict(table, language.train(table)).filter(language.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    right = done.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    model = language.train(docs)
    rows = language.predict(docs, model).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= float(r.score) <= 1
    assert language.predict(docs, language.train(no_docs)).filter("lang_pred <> 'und'").count() == 0
    assert language.predict(no_docs, model).count() == 0


def test_language_backs_off_to_shorter_grams():
    model = language.Model(["a", "b"], [(0, "known", 0, 9), (2, "xy", 1, 5), (1, "q", 0, 5)])
    assert model.predict("KNOWN")[0] == "a" and model.predict("wxyz")[0] == "b" and model.predict("qqq")[0] == "a"
    assert model.predict("12 !")[0] == model.predict(None)[0] == "und"


def brute_repeats(rows, window=13):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def check_repeats(frame, rows):
    found = substrings.repeated(frame).collect()
    want = brute_repeats(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.n_removed, r.text) == want[r.doc_id]
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed


def test_repeats_equal_brute_force(docs, no_docs):
    check_repeats(docs, AWKWARD)
    assert substrings.repeated(no_docs).count() == 0
    kept = substrings.drop_repeated(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 6").count() == 0
    assert kept.filter("doc_id = 2").first().text == ""


@pytest.mark.parametrize("hot", [10_000, 3])
def test_shared_passages_with_hot_anchors(spark, monkeypatch, hot):
    importable(spark)
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = np.random.default_rng(hot)
    rows = []
    for i in range(60):
        own = [f"x{v}" for v in rng.integers(0, 6, 30)]
        at = int(rng.integers(0, 30))
        cut = int(rng.integers(10, 40))
        rows.append((i, " ".join(own[:at] + PASSAGE.split()[:cut] + own[at:])))
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=20), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 4), max_size=20), max_size=3), st.integers(1, 6))
def test_fm_index_equals_brute_force(sequences, streams, depth):
    index = FmIndex([np.array(s) for s in sequences], depth)
    numbers = np.arange(len(sequences))[::-1].copy()
    got = {}
    for who, place, low in index.matches([np.array(s, dtype=np.int64) for s in streams + sequences]):
        for x, y, z in zip(who.tolist(), place.tolist(), index.group_minimum(numbers, low).tolist()):
            got[x, y] = z
    want = {}
    for x, s in enumerate(streams + sequences):
        for y in range(len(s) - depth + 1):
            held = [numbers[n] for n, t in enumerate(sequences) if any(t[k : k + depth] == s[y : y + depth] for k in range(len(t)))]
            if held:
                want[x, y] = min(held)
    assert got == want


def test_a_long_segment_does_not_widen_the_others():
    """Memory of a shard goes with its symbols, not with segments times the longest of them."""
    draw = np.random.default_rng(3)
    segments = [b" ".join(b"w%d" % i for i in draw.integers(0, 2000, n)) for n in [3000] + [13] * 6000]
    tracemalloc.start()
    try:
        minima = substrings.shard_minima([*segments, segments[0]], np.arange(1, 6003), 13)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (minima[-1] == 1).all() and peak < 80e6


def test_warc_round_trip_in_chunks(spark):
    importable(spark)
    big = "<p>é" * 200_000
    pages = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/\r\nX: y", big), (4, "u", None), (5, "u", ""), (None, "u", "x"), (7, "u", big), (7, "u", big)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    files = warc.write_archives(frame, warc.archive_folder(spark))
    chunks = warc.read_archives(files, chunk=1000).collect()
    assert max(len(c.data) for c in chunks) <= 1000
    last = [c for c in chunks if c["last"]]
    assert len(last) == len(pages)
    assert {(c.page_id, c.record_type, c.refers_to) for c in last} == {
        (1, "revisit", 2), (2, "response", None), (3, "revisit", 7), (4, "revisit", 5), (5, "response", None),
        (None, "response", None), (7, "response", None)}
    for c in last:
        html = dict((p[0], p[2]) for p in pages)[c.page_id] or ""
        assert c.bytes == len(html.encode())
        assert c.digest == __import__("base64").b32encode(hashlib.sha1(html.encode()).digest()).decode()
    body = b"".join(c.data for c in sorted((c for c in chunks if c.page_id == 7), key=lambda c: c.chunk))
    assert body.startswith(b"<p>") and len(body) == 2 * len(big.encode())
    assert warc.read_archives(warc.write_archives(frame.limit(0), warc.archive_folder(spark))).count() == 0
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(__import__("gzip").compress(b"no record\r\n"))))


def test_mix_takes_the_budget_exactly(docs, no_docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(AWKWARD)
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by_source.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    total = sum(r.size for r in rows)
    for target, size, taken in by_source.values():
        assert taken == int(target) and target <= 2 * size + 1e-9
    assert abs(sum(t for t, _, _ in by_source.values()) - 1.5 * total) < 1e-6
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.mix(no_docs).count() == 0
    mixed = mixing.mixed_documents(docs.filter("doc_id <> 10"))
    assert mixed.columns == docs.columns
    sizes = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    assert sizes == {r.doc_id: r.taken for r in mixing.mix(docs.filter("doc_id <> 10")).collect() if r.taken}


def test_bpe_equals_the_library(docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = {i: t for i, t, *_ in AWKWARD} | {None: PASSAGE}
    rows = bpe.encode(docs, path).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(no_docs, path).count() == 0


_BPE = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
_WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
_BYTES = tokenfiles.LibraryTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
_PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@example(":\U000323b0")  # unassigned when the library was made
@example("a\ua7daB \U00010d50:\u1c89x")  # newer than Python's tables
@given(st.text(max_size=40) | st.text("ab'st \n　\x1c<|>ΣÉé1", max_size=40))
def test_tokenizers_equal_the_library_on_any_text(text):
    ids, decoded = _BPE.encode_decode(text)
    want = _WORDS.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want and decoded.decode() == _WORDS.decode(want, skip_special_tokens=False)
    assert _BYTES.encode(text).tolist() == _PLAIN.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = tokenfiles.write_token_files(docs, tokenfiles.token_folder(spark), path)
    rows = sorted(tokenfiles.read_token_files(files).collect(), key=lambda r: r.start)
    ordered = sorted(AWKWARD, key=lambda d: (d[0] is not None, d[0] or 0))
    start = 0
    for row, (i, text, *_) in zip(rows, ordered, strict=True):
        ids = _PLAIN.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row.doc_id, row.start) == (i, start)
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        start += len(ids)
    none = tokenfiles.write_token_files(no_docs, tokenfiles.token_folder(spark), path)
    assert tokenfiles.read_token_files(none).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 999), min_size=1, max_size=600), st.integers(1, 5))
def test_range_coder_round_trip(ids, times):
    ids = np.array(ids * times, dtype=np.uint32)
    block = encode_block(ids, 1000)
    assert (decode_block(block[:HEAD_BYTES], block[HEAD_BYTES:]) == ids).all()
    damaged = bytearray(block)
    damaged[-1] ^= 1
    with pytest.raises(ValueError):
        decode_block(bytes(damaged[:HEAD_BYTES]), bytes(damaged[HEAD_BYTES:]))


def test_pipeline_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    importable(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "SimHash near-dedup", "substring dedup", "mixing sources", "BPE encoding"]
    current = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        current = stage(spark, current, sf_dir)
        assert current.columns == docs.columns
    before = {r.doc_id: r.text for r in current.collect()}
    after = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_passages(spark, current, sf_dir).collect()}
    want = brute_repeats(list(before.items()))
    assert after == {i: (before[i] if gone == 0 else kept) for i, (n, gone, kept) in want.items() if gone < n}
    final = corpus_pipeline.run(spark, sf_dir)
    assert final.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and final.count() > 0


def test_checksums_are_those_of_zlib(spark, sf_dir):
    row = QUERIES["op10_tokenfiles"](spark, sf_dir).filter("doc_id = 0").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id = 0").first().text
    ids = _PLAIN.encode(text, add_special_tokens=False).ids + [0]
    assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and row.start == 0
