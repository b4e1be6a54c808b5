import json

import pytest
from hypothesis import given, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from broadsheet.fixed import CHINESE
from broadsheet.operators import corpus as C
from broadsheet.operators.lookup import hot_keys, lookup
from broadsheet.sources import corpora as src

TEXTS = ["b a b", "A c!", "", "b d", "中文"]


@pytest.fixture(scope="module")
def tokenised(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    return C.with_tokens(rows)


def test_frequency_leaves_the_sentinel_out(tokenised):
    got = {r.token: r.cnt for r in C.token_frequency(tokenised).collect()}
    assert got == {"a": 2, "b": 3, "c": 1, "d": 1}


@pytest.mark.parametrize("size,words", [(10, "bacd"), (4, "ba"), (2, ""), (0, "")])
def test_vocabulary(tokenised, size, words):
    rows = C.vocabulary(C.token_frequency(tokenised), size).orderBy("id").collect()
    assert [r.token for r in rows] == list(words)
    assert [r.id for r in rows] == list(range(2, 2 + len(words)))


def test_sequence_length(spark, tokenised):
    assert C.sequence_length(tokenised).first().seq_len == 3
    assert C.sequence_length(tokenised.limit(0)).first().seq_len == 50
    long = C.with_tokens(spark.createDataFrame([(1, "x " * 80)], "id long, text string"))
    assert C.sequence_length(long).first().seq_len == 50


def test_label_index(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "label string")
    assert {r.label: r.idx for r in C.label_index(rows).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(PySparkException, match="At least 2 unique labels"):
        C.label_index(rows.filter("label = 'b'")).collect()


def test_row_guard(spark):
    assert C.require_rows(spark.range(2), 2, "too few").count() == 2
    with pytest.raises(PySparkException, match="too few"):
        C.require_rows(spark.range(1), 2, "too few").collect()


def test_both_encodings_agree(spark, tokenised):
    vocab = C.vocabulary(C.token_frequency(tokenised), 4)
    local = C.encode(tokenised, C.vocabulary_words(vocab), 3).select("id", "ids")
    joined = C.encode_by_join(tokenised, vocab, 3).select("id", "ids")
    want = {0: [2, 3, 2], 1: [3, 1, 0], 2: [1, 0, 0], 3: [2, 1, 0], 4: [1, 0, 0]}
    assert {r.id: r.ids for r in local.collect()} == want
    assert {r.id: r.ids for r in joined.collect()} == want


def test_encoding_does_not_shuffle(tokenised):
    plan = C.encode(tokenised, ["a", "b"], 50)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_encoding_with_a_large_vocabulary(spark):
    words = [f"w{i}" for i in range(50_000)]
    rows = spark.createDataFrame([(1, ["w0", "w49999", "x", "w777"])], "id long, tokens array<string>")
    assert C.encode(rows, words, 6).first().ids == [2, 50_001, 1, 779, 0, 0]
    with pytest.raises(ValueError, match="encode_by_join"):
        C.encode(rows, words * 3, 6)


def test_vocabulary_words_is_bounded(spark):
    vocab = spark.range(5).select((F.col("id") + 2).alias("id"), F.col("id").cast("string").alias("token"))
    with pytest.raises(ValueError):
        C.vocabulary_words(vocab, 4)


@pytest.mark.parametrize("length", [0, 1, 3, 7])
def test_fit_length(one, length):
    got = one(C.fit_length(F.col("v"), length), [[1, 2, 3], []], "array<int>")
    assert got == [([1, 2, 3] + [0] * length)[:length], [0] * length]


def test_evaluation(spark):
    rows = spark.createDataFrame(
        [(0, 0.0, 0.5), (1, 0.0, 0.25)], "label_idx int, predicted_idx double, probability double"
    )
    result = C.evaluation(rows).first()
    assert (round(result.loss, 5), result.accuracy, result.n) == (1.03972, 0.5, 2)
    assert tuple(C.evaluation(rows.limit(0)).first()) == (None, None, 0)


def test_han_corpus(spark):
    rows = C.with_tokens(spark.createDataFrame([(1, "国家新闻")], "id long, text string"), CHINESE)
    assert rows.first().tokens == ["国家", "家新", "新闻"]


def write(path, text):
    path.write_text(text, encoding="utf8")
    return str(path)


def test_labelled_csv(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        'Category,Title\n tech , "Say ""hi"", all" \nsport,plain,extra\nonly\n,no label\nx,  \n\n'
        'world,"two\nlines"\n',
    )
    got = sorted((r.label, r.text) for r in src.read_labelled_csv(spark, path).collect())
    assert ("sport", "plain") in got and ("world", "two\nlines") in got
    assert [label for label, _ in got] == ["sport", "tech", "world"]


def test_delimited(spark, tmp_path):
    path = write(tmp_path / "a.txt", "1_!_101_!_news_tech_!_标题_!_k\nshort_!_x\n2_!_1_!_stock_!_t\n")
    lines = src.read_delimited(spark, path)
    assert sorted((r.label, r.text) for r in src.corpus_rows(lines).collect()) == [
        ("news_tech", "标题"), ("stock", "t"),
    ]
    assert tuple(src.corpus_rejects(lines).first()) == (1, 3)


def test_plain_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Id,Text,Category\n1,some "text,tech\n2,short\n3,,empty\n')
    lines = src.read_plain_csv(spark, path)
    assert sorted((r.label, r.text) for r in src.corpus_rows(lines).collect()) == [
        ("empty", ""), ("tech", 'some "text'),
    ]
    assert json.dumps(tuple(src.corpus_rejects(lines).first())) == "[1, 3]"


RECORDS = [
    ("sport", "plain"), ("tech", "two\nlines"), ("tech", 'a "quoted" word, and\n\n a blank line'), ("sport", "comma, inside"),
    ("business", "ends with a quote\""), ("tech", "x\ny\nz\n" * 40), ("sport", '5" disk'.replace('"', "")), ("tech", '"'), ("sport", "é中"),
]


def written_csv(rows, line_end="\n", header="Category,Title,More"):
    quote = lambda t: f'"{t.replace(chr(34), chr(34) * 2)}"' if any(c in t for c in ',"\n') else t
    return line_end.join([header, *(f"{quote(c)},{quote(t)},surplus" for c, t in rows)]) + line_end


@pytest.mark.parametrize("size", [64, 200, 1 << 20])
def test_quoted_csv_is_split(spark, tmp_path, size):
    """Equal to the reader that takes whole files, wherever a file is cut."""
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text(written_csv(RECORDS * 7))
    (tmp_path / "csv" / "b.csv").write_text(written_csv(RECORDS[::-1], "\r\n", '"Cat\negory",Title'))
    (tmp_path / "csv" / "c.csv").write_text('Category,Title\nsport,5" disk\ntech,6" and 7"\n"tech","say ""hi"""\nshort\n\n,\nsport,last')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    path = str(tmp_path / "csv")
    want = spark.read.csv(path, schema="category string, title string", header=True, multiLine=True, quote='"', escape='"')
    want = sorted((r.category.strip(), r.title.strip()) for r in want.collect() if r.title and r.title.strip() and r.category)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = src.read_labelled_csv(spark, path)
        got = sorted((r.label, r.text) for r in rows.collect())
        pieces = src.csv_records(spark, path)
        assert size > 1000 or pieces.rdd.getNumPartitions() > 8
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == want and ("sport", '5" disk') in got and ("sport", "last") in got


@given(st.lists(st.sampled_from(['a', '"', ',', '""', ' ', 'b,"', '",']), max_size=8).map("".join), st.booleans())
def test_quote_state_of_a_line(line, inside):
    """Character by character: a quote counts where a field begins, and inside quotes."""
    at_start, state = not inside, "in" if inside else "start"
    for k, c in enumerate(line):
        if state == "start":
            state = "in" if c == '"' else "start" if c == "," else "out"
        elif state == "out":
            state = "start" if c == "," else "out"
        elif state == "in":
            state = "quote" if c == '"' else "in"
        else:
            state = "in" if c == '"' else "start" if c == "," else "out"
    assert src.ends_inside(line, inside) == (state == "in")


def test_hot_tokens_and_many_rare_ones(spark):
    """One token is in every row; the others have their one copy."""
    rows = spark.range(3_000).select(
        "id", F.concat(F.lit("the w"), (F.col("id") % 1_500).cast("string"), F.lit(" the")).alias("text")
    )
    tokenised = C.with_tokens(rows)
    vocab = C.vocabulary(C.token_frequency(tokenised), 1_000)
    for given_vocab in (vocab, vocab.drop("cnt")):
        joined = C.encode_by_join(tokenised, given_vocab, 3)
        local = C.encode(tokenised, C.vocabulary_words(vocab), 3)
        assert sorted(map(str, joined.select("id", "ids").collect())) == sorted(map(str, local.select("id", "ids").collect()))
    plan = C.encode_by_join(tokenised, vocab, 3)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(0" not in plan


def test_lookup_of_hot_keys(spark):
    rows = spark.range(5_000).select("id", F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 2 == 0, F.col("id")).alias("k"))
    table = spark.range(4_000).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v")).filter("k % 5 > 0")
    found = lookup(rows, table, "k", "v", hot_keys(rows.groupBy("k").count(), "k", share=10), F.col("id"))
    want = rows.join(table, "k", "left").select("id", "k", "v")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert [r.k for r in hot_keys(rows.groupBy("k").count(), "k").collect()] == [7]
