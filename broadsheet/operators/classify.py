"""Text classification with Spark ML, and labelling routed by language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, IndexToString, Normalizer
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from broadsheet.files import delete, exists
from broadsheet.fixed import CATEGORY_NONE, CHINESE, ENGLISH, UNKNOWN
from broadsheet.functions.categories import label_to_flag
from broadsheet.functions.text import detect_language, tokens
from broadsheet.operators.corpus import (
    LOCAL_VOCABULARY,
    evaluation,
    label_index,
    require_rows,
    token_frequency,
    vocabulary,
    vocabulary_words,
    with_tokens,
)
from broadsheet.operators.lexicon import lexicon_scores
from broadsheet.operators.selection import split_at, split_edge
from broadsheet.session import kept

_META = "meta"
_VOCAB = "vocab"
_MODEL = "model"
_LEXICON = "lexicon"


@dataclass
class TextModel:
    """A trained classifier: the fitted stages, its vocabulary and its language."""

    stages: PipelineModel
    vocab: DataFrame
    labels: list[str]
    language: str
    loss: float | None = None
    accuracy: float | None = None
    lexicon: dict[str, int] | None = None  # Han words; character pairs without

    def tokens(self, text: Column) -> Column:
        """Tokens as they were when the model was trained."""
        return tokens(text, self.language, self.lexicon)

    def predict(self, rows: DataFrame, text: str = "text", output: str = "predicted") -> DataFrame:
        """Add the highest-scoring label."""
        tokenised = rows.withColumn("tokens", self.tokens(F.col(text)))
        return self.predict_tokens(tokenised, output).drop("tokens")

    def predict_tokens(self, tokenised: DataFrame, output: str = "predicted") -> DataFrame:
        """``predict`` for rows that carry ``tokens``."""
        kept = [c for c in tokenised.columns if c != output]
        scored = self.stages.transform(tokenised)
        return scored.select(*kept, F.col("predicted_label").alias(output))

    def save(self, path: str) -> None:
        """Write stages, vocabulary and metadata under ``path``."""
        if not path or not path.strip():
            raise ValueError("model path is required")
        self.stages.write().overwrite().save(f"{path}/{_MODEL}")
        self.vocab.write.mode("overwrite").parquet(f"{path}/{_VOCAB}")
        spark = self.vocab.sparkSession
        meta = spark.createDataFrame(
            [(self.language, self.labels, self.loss, self.accuracy)],
            "language string, labels array<string>, loss double, accuracy double",
        )
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/{_META}")
        if self.lexicon is None:
            delete(spark, f"{path}/{_LEXICON}")
        else:
            words = spark.createDataFrame(list(self.lexicon.items()), "word string, score int")
            words.coalesce(1).write.mode("overwrite").parquet(f"{path}/{_LEXICON}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextModel:
        """Read a saved model; a missing part is an error, a missing language is Chinese."""
        if not path or not path.strip():
            raise ValueError("model path is required")
        meta = spark.read.schema(
            "language string, labels array<string>, loss double, accuracy double"
        ).json(f"{path}/{_META}").first()
        if meta is None:
            raise ValueError(f"no metadata under {path}")
        return TextModel(
            PipelineModel.load(f"{path}/{_MODEL}"),
            spark.read.parquet(f"{path}/{_VOCAB}"),
            list(meta["labels"]),
            meta["language"] or CHINESE,
            meta["loss"],
            meta["accuracy"],
            lexicon_scores(spark.read.parquet(f"{path}/{_LEXICON}")) if exists(spark, f"{path}/{_LEXICON}") else None,
        )


def train(
    rows: DataFrame,
    language: str = ENGLISH,
    vocab_size: int = 10_000,
    seed: int | str = 42,
    max_iter: int = 50,
    reg_param: float = 1e-5,
    tol: float = 1e-4,
    id_column: str = "id",
    max_labels: int = 10_000,
    lexicon: dict[str, int] | None = None,
) -> TextModel:
    """Fit a multinomial classifier on ``id, text, label`` rows.

    With a ``lexicon`` (``learn_lexicon``) Chinese texts are read as words, without as pairs.

    Features are token shares (the mean over a text's tokens), so word order is not used. One
    fifth of the rows is held out by an exact seeded split and scored at the end. The driver
    holds the vocabulary (at most ``vocab_size``, itself at most ``LOCAL_VOCABULARY``) and the
    labels (more than ``max_labels`` are an error), never rows.
    """
    if vocab_size > LOCAL_VOCABULARY:
        raise ValueError(f"vocab_size is at most {LOCAL_VOCABULARY}")
    checked = require_rows(rows, 2, "Dataset must have at least 2 samples.")
    # The edge is looked for once. Texts are read and cut again for the counts, the fit and the
    # evaluation: kept tokens of one input split are many times as large as the split.
    edge = rows.sparkSession.range(1).select(split_edge(checked, seed, id_column).alias("edge")).first()["edge"]
    kind = rows.schema[id_column].dataType
    known = F.struct(F.lit(edge["_key"]).alias("_key"), F.lit(edge["_id"]).cast(kind).alias("_id"))
    prepared = split_at(checked, known, seed, id_column)

    def tokenised(split: str) -> DataFrame:
        return with_tokens(prepared.filter(F.col("split") == split), language, lexicon=lexicon)

    training = tokenised("train")
    vocab = vocabulary(token_frequency(training), vocab_size)
    words = vocabulary_words(vocab)
    # Every label counts, also one that only the held-out rows have.
    names = checked.select("label").distinct()
    found = names.limit(max_labels + 1).count()
    if found > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    labels = [r["label"] for r in label_index(checked).orderBy("idx").collect()]
    features = [
        CountVectorizerModel.from_vocabulary(
            words or ["<UNK>"], inputCol="tokens", outputCol="counts"
        ),
        Normalizer(p=1.0, inputCol="counts", outputCol="features"),
    ]
    indexer = StringIndexerModel.from_labels(
        labels, inputCol="label", outputCol="label_idx"
    )
    ready = indexer.transform(PipelineModel(features).transform(training))
    # Every iteration reads these rows again: from the shared folder they survive a lost
    # executor, and tasks do not carry the plan that made them.
    ready = kept(ready.select("features", "label_idx"))
    fitted = LogisticRegression(
        featuresCol="features",
        labelCol="label_idx",
        predictionCol="predicted_idx",
        probabilityCol="probabilities",
        family="multinomial",
        maxIter=max_iter,
        regParam=reg_param,
        tol=tol,
    ).fit(ready)
    naming = IndexToString(
        inputCol="predicted_idx", outputCol="predicted_label", labels=labels
    )
    stages = PipelineModel([*features, fitted, naming])
    valid = indexer.transform(stages.transform(tokenised("valid")))
    given = F.get(vector_to_array("probabilities"), F.col("label_idx").cast("int"))
    # A class no training row has gets no probability; the floor keeps its loss finite.
    scored = valid.select(
        "label_idx",
        "predicted_idx",
        F.greatest(F.coalesce(given, F.lit(0.0)), F.lit(1e-15)).alias("probability"),
    )
    quality = evaluation(scored).first()
    kept_vocab = rows.sparkSession.createDataFrame(
        list(enumerate(words, start=2)), "id int, token string"
    )
    return TextModel(
        stages, kept_vocab, labels, language, quality["loss"], quality["accuracy"], lexicon
    )


def label_rows(rows: DataFrame, strict: bool = False, label: str = "label") -> DataFrame:
    """Add ``category`` from a raw label; unknown labels are null, or an error when strict."""
    flag = label_to_flag(F.col(label))
    if strict:
        problem = F.concat(F.lit("unknown label: "), F.coalesce(F.col(label), F.lit("null")))
        flag = F.coalesce(flag, F.raise_error(problem).cast("int"))
    return rows.withColumn("category", flag)


def route(language: Column) -> Column:
    """Which model labels a text: the language's own, none for Unknown."""
    return F.nullif(language, F.lit(UNKNOWN))


def classify_by_language(
    rows: DataFrame, models: dict[str, TextModel], text: str = "title", threshold: float = 0.5
) -> DataFrame:
    """Add ``language``, ``raw_label`` and ``category`` to every row.

    All models run in one pass over the rows: each sees tokens only for its own language and
    an empty list otherwise, so the input is not read once per language. A row of no language
    has category 0; a label without a flag leaves ``category`` null for the caller to reject.
    """
    kept = rows.columns
    current = rows.withColumn("language", detect_language(F.col(text), threshold))
    raw = F.lit(None).cast("string")
    for language, model in models.items():
        own = F.when(F.col("language") == language, model.tokens(F.col(text)))
        blank = F.array().cast("array<string>")
        current = current.withColumn("tokens", F.coalesce(own, blank))
        name = f"_label_{language}"
        current = model.predict_tokens(current, name).drop("tokens")
        raw = F.when(F.col("language") == language, F.col(name)).otherwise(raw)
    labelled = current.withColumn("raw_label", raw)
    unrouted = F.when(F.col("raw_label").isNull(), F.lit(CATEGORY_NONE))
    return labelled.select(
        *kept,
        "language",
        "raw_label",
        F.coalesce(label_to_flag(F.col("raw_label")), unrouted).alias("category"),
    )
