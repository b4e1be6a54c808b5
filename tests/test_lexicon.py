"""Han words: segmentation against all readings, and a lexicon learned from made-up texts."""

import math
import random
import time
from functools import cache

import pytest
from pyspark.sql import functions as F

from broadsheet.fixed import CHINESE
from broadsheet.functions import text as X
from broadsheet.operators import classify as K
from broadsheet.operators.lexicon import learn_lexicon, lexicon_scores

V = F.col("v")
LEXICON = {"中": -4000, "国": -4100, "人": -4200, "中国": -5000, "国人": -5050, "中国人": -9000, "人民": -5200, "中国人民": -9050}


def readings(run):
    """Every way to cut a run into words of up to four characters that are known or single."""
    if not run:
        yield []
    for n in range(1, min(4, len(run)) + 1):
        if n == 1 or run[:n] in LEXICON:
            yield from ([run[:n], *rest] for rest in readings(run[n:]))


@cache
def best(run):
    cost = lambda words: sum(LEXICON.get(w, min(LEXICON.values()) - X.UNKNOWN_COST) for w in words)
    # Of equal sums the longer last word wins, then the longer one before it.
    return max(readings(run), key=lambda words: (cost(words), [len(w) for w in reversed(words)]))


def test_segmentation_is_the_best_of_all_readings(one):
    draw = random.Random(8)
    texts = ["".join(draw.choice("中国人民x") for _ in range(draw.randrange(10))) for _ in range(600)]
    got = one(X.han_words(V, LEXICON), texts)
    for text, words in zip(texts, got):
        runs, at = [], 0
        while at < len(text):
            end = at
            while end < len(text) and (text[end] == "x") == (text[at] == "x"):
                end += 1
            runs += [text[at:end]] if text[at] == "x" else best(text[at:end])
            at = end
        assert words == (runs or ["<UNK>"])


def test_other_texts_and_long_runs(one):
    assert one(X.han_words(V, LEXICON), ["中国人民 AB-12", "", None, "..."]) == [
        ["中国人民", "ab", "12"], ["<UNK>"], ["<UNK>"], ["<UNK>"],
    ]
    assert one(X.han_words(V, {}), ["中国a"]) == [["中", "国", "a"]]
    assert one(F.size(X.han_words(V, LEXICON)), ["中国" * 5_000]) == [5_000]
    assert one(X.tokens(V, CHINESE, LEXICON), ["中国人"]) == [["中国人"]]
    assert one(X.tokens(V, CHINESE), ["中国人"]) == [["中国", "国人"]]


def test_long_runs_take_time_by_the_character(one):
    """Seconds for half a million characters in full runs, in one task."""
    draw = random.Random(5)
    text = "".join(draw.choice("中国人民") for _ in range(500_000))
    began = time.monotonic()
    assert one(F.length(F.array_join(X.han_words(V, LEXICON), "")), [text]) == [500_000]
    assert time.monotonic() - began < 15


@pytest.fixture(scope="module")
def made_up(spark):
    """Texts of three words and single characters in random order."""
    draw = random.Random(4)
    words = ["新闻", "体育馆", "经济", "大", "小", "上", "下", "来", "去"]
    rows = [(i, "".join(draw.choice(words) for _ in range(8)) + ("。" if i % 2 else " x")) for i in range(400)]
    return spark.createDataFrame(rows, "id long, text string")


def test_lexicon_finds_the_words(spark, made_up):
    lexicon = learn_lexicon(made_up, least_count=20)
    found = {r.word: r for r in lexicon.collect()}
    assert {w for w in found if len(w) > 1} == {"新闻", "体育馆", "经济"}
    texts = [r.text for r in made_up.collect()]
    total = sum(c not in "。 x" for t in texts for c in t)
    assert found["新闻"].cnt == sum(t.count("新闻") for t in texts)
    assert found["大"].score == round(1000 * math.log(found["大"].cnt / total))
    assert [r.word for r in learn_lexicon(made_up, size=1, least_count=20).filter(F.length("word") > 1).collect()] == [
        max(["新闻", "体育馆", "经济"], key=lambda w: found[w].cnt)
    ]
    assert learn_lexicon(made_up.limit(0)).count() == 0 and learn_lexicon(made_up.withColumn("text", F.lit(None).cast("string"))).count() == 0
    with pytest.raises(ValueError):
        lexicon_scores(lexicon, limit=2)


def test_a_model_keeps_its_lexicon(spark, made_up, tmp_path):
    lexicon = lexicon_scores(learn_lexicon(made_up, least_count=20))
    has = F.when(F.col("text").contains("新闻"), "news_tech").otherwise("news_world")
    model = K.train(made_up.withColumn("label", has), CHINESE, 100, max_iter=15, lexicon=lexicon)
    assert "新闻" in [r.token for r in model.vocab.collect()] and model.accuracy > 0.9
    model.save(str(tmp_path / "m"))
    again = K.TextModel.load(spark, str(tmp_path / "m"))
    assert again.lexicon == lexicon
    rows = spark.createDataFrame([("大新闻来",), ("小经济去",)], "text string")
    assert [r.predicted for r in again.predict(rows).collect()] == ["news_tech", "news_world"]
    pairs = K.train(made_up.withColumn("label", has), CHINESE, 100, max_iter=2)
    pairs.save(str(tmp_path / "m"))
    assert K.TextModel.load(spark, str(tmp_path / "m")).lexicon is None
