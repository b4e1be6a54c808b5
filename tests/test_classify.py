import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from broadsheet.fixed import CHINESE, ENGLISH
from broadsheet.operators import classify as K
from broadsheet.sources import archive as A

WORDS = {"tech": "chip code robot", "sport": "goal match team", "business": "stock profit market"}
HAN = {"news_game": "游戏玩家", "news_car": "汽车发动"}


def corpus(spark, words, n=30):
    rows = [(i, f"{text} {i % 3}", label) for i, (label, text) in enumerate(list(words.items()) * n)]
    return spark.createDataFrame(rows, "id long, text string, label string")


@pytest.fixture(scope="module")
def models(spark):
    return {
        ENGLISH: K.train(corpus(spark, WORDS), ENGLISH, 100, max_iter=10),
        CHINESE: K.train(corpus(spark, HAN), CHINESE, 100, max_iter=10),
    }


def test_held_out_rows_are_told_apart(models):
    for model in models.values():
        assert model.accuracy == 1.0 and model.loss < 0.2


def test_predictions_survive_a_reload(spark, models, tmp_path):
    model = models[ENGLISH]
    model.save(str(tmp_path / "m"))
    again = K.TextModel.load(spark, str(tmp_path / "m"))
    assert (again.labels, again.language, again.accuracy) == (model.labels, ENGLISH, model.accuracy)
    rows = spark.createDataFrame([("the team",), ("robot code",), ("nothing known",)], "text string")
    first = [r.predicted for r in model.predict(rows).collect()]
    assert first == [r.predicted for r in again.predict(rows).collect()]
    assert first[:2] == ["sport", "tech"]


def test_missing_parts_of_a_model(spark, models, tmp_path):
    with pytest.raises(ValueError):
        models[ENGLISH].save(" ")
    with pytest.raises(Exception):
        K.TextModel.load(spark, str(tmp_path / "none"))


def test_each_language_has_its_model(spark, models):
    titles = ["market profit", "游戏 abc 玩家玩家", "汽车发动", "123", None]
    rows = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    got = K.classify_by_language(rows, models).orderBy("id").collect()
    assert [r.language for r in got] == ["English", "Chinese", "Chinese", "Unknown", "Unknown"]
    assert [r.raw_label for r in got] == ["business", "news_game", "news_car", None, None]
    assert [r.category for r in got] == [1 << 18, 1 << 7, 1 << 5, 0, 0]


def test_unknown_labels(spark):
    rows = spark.createDataFrame([("Tech",), ("weather",)], "label string")
    assert [r.category for r in K.label_rows(rows).collect()] == [8, None]
    with pytest.raises(PySparkException, match="unknown label: weather"):
        K.label_rows(rows, strict=True).collect()


def test_too_little_data(spark):
    with pytest.raises(Exception, match="at least 2 samples"):
        K.train(corpus(spark, WORDS, 1).limit(1))
    with pytest.raises(Exception, match="At least 2 unique labels"):
        K.train(corpus(spark, {"tech": "chip"}, 5))


def test_no_held_out_rows(spark):
    model = K.train(corpus(spark, {"tech": "chip", "sport": "goal"}, 2))
    assert (model.loss, model.accuracy) == (None, None)


def test_majority_is_beaten(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")
    )
    share = rows.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert K.train(rows, vocab_size=500, max_iter=20).accuracy > max(0.8, share)


def test_export_needs_a_root(spark):
    with pytest.raises(ValueError):
        A.export_texts(spark.range(1), "  ")


def test_every_text_gets_a_known_label(spark):
    """Also one without any known token, where only the share of the classes decides."""
    rows = corpus(spark, WORDS, 10)
    lopsided = rows.filter((F.col("label") == "tech") | (F.col("id") < 6))
    model = K.train(lopsided, ENGLISH, 100, max_iter=10)
    strange = spark.createDataFrame([("",), ("zzz",), ("游戏",)], "text string")
    assert {r.predicted for r in model.predict(strange).collect()} <= set(model.labels)


def test_training_keeps_no_tokens_in_blocks(spark, monkeypatch):
    """A block of kept tokens is as large as its input split makes it, many times the split."""

    def refused(self, *args):
        raise AssertionError("tokens are kept")

    monkeypatch.setattr(type(spark.range(0)), "persist", refused)
    monkeypatch.setattr(type(spark.range(0)), "cache", refused)
    model = K.train(corpus(spark, WORDS), ENGLISH, 100, max_iter=10)
    assert model.accuracy == 1.0


def test_ids_of_other_types_split_alike(spark):
    rows = corpus(spark, WORDS)
    narrow = K.train(rows.withColumn("id", F.col("id").cast("int")), ENGLISH, 100, max_iter=3)
    named = K.train(rows.withColumn("id", F.col("id").cast("string")), ENGLISH, 100, max_iter=3)
    assert narrow.loss == pytest.approx(named.loss)
