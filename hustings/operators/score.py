"""Scoring and labelling of texts by models the user plugs in, and a classifier fitted on Spark."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import fixed, stance, text
from ..functions.stance import PROBS
from . import evaluate
from .joins import per_distinct_text

Scorer = Callable[[list[str]], np.ndarray]
Labeler = Callable[[list[str]], list[str]]


def lexical_scorer(against: Sequence[str], favor: Sequence[str], neutral: float = 1.0) -> Callable[[], Scorer]:
    """Scorer that counts words speaking against and for; neutral has a constant logit."""
    def make() -> Scorer:
        word = re.compile(r"\w+")
        con, pro = set(against), set(favor)

        def score(texts: list[str]) -> np.ndarray:
            found = [word.findall(t.lower()) for t in texts]
            return np.array(
                [[sum(w in con for w in ws), sum(w in pro for w in ws), neutral] for ws in found], dtype="float64"
            )

        return score

    return make


def score_chunks(df: DataFrame, composed: str, scorer: Callable[[], Scorer]) -> DataFrame:
    """Adds the three probabilities of the composed text.

    ``scorer`` is called once per task. Only the text travels to Python; all other columns
    stay where they are.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch.fillna("").tolist()), dtype="float64")))

    scored = df.withColumn("_logits", logits(F.col(composed)))
    probs = stance.softmax([F.col("_logits")[i] for i in range(3)])
    return scored.withColumns(dict(zip(PROBS, probs))).drop("_logits")


def generate_labels(
    df: DataFrame, col: str, labeler: Callable[[], Labeler], out: str = "label", retries: int = 5,
    default: str = fixed.MISC,
) -> DataFrame:
    """Adds a label per text, asked for once per distinct text.

    A batch that fails, or gives another number of labels than it has texts, is asked again text
    by text, each up to ``retries`` times; what still fails, or comes out empty, gets the default.
    """
    @F.pandas_udf(T.StringType())
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = labeler()

        def ask(texts: list[str]) -> list[str | None] | None:
            try:
                got = model(texts)
            except Exception:
                return None
            return got if len(got) == len(texts) else None

        def one(item: str) -> str | None:
            for _ in range(retries):
                got = ask([item])
                if got is not None:
                    return got[0]
            return None

        for batch in batches:
            texts = batch.tolist()
            found = ask(texts) or [one(t) for t in texts]
            yield pd.Series([f.strip() if f and f.strip() else default for f in found], dtype="object")

    named = per_distinct_text(df, col, lambda texts: texts.withColumn(out, label(F.col(col))), out)
    return named.withColumn(out, F.coalesce(out, F.lit(default)))


def labels_from_parents(links: DataFrame, docs: DataFrame, labeler: Callable[[], Labeler], retries: int = 5) -> DataFrame:
    """Second-level labels: each document of a node is labelled under its node's name.

    Documents below ``Misc.`` are passed by and get no label.
    """
    linked = links.join(docs, "doc_id")
    asked = F.concat(F.lit("Subtopic of "), "subtopic_1", F.lit(": "), F.coalesce("document", F.lit("")))
    todo = linked.where(F.col("subtopic_1") != fixed.MISC).withColumn("_asked", asked)
    done = generate_labels(todo, "_asked", labeler, "subtopic_2", retries).drop("_asked")
    passed = linked.where(F.col("subtopic_1") == fixed.MISC)
    return done.unionByName(passed.withColumn("subtopic_2", F.lit(None).cast("string")))


def fit_stance(
    train: DataFrame, val: DataFrame, col: str = "document", label: str = "label",
    features: int = 1 << 16, strengths: Sequence[float] = (0.1, 0.01, 0.001),
) -> tuple[PipelineModel, float, float]:
    """Stance classifier on labelled chunks: hashed weighted words, logistic regression.

    The regularisation with the best macro F1 on the validation rows wins. Gives the model,
    its regularisation and its F1.
    """
    def words(df: DataFrame) -> DataFrame:
        return df.withColumns({"_words": text.plain_words(col), "_y": F.col(label).cast("double")})

    front = Pipeline(
        stages=[
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_features"),
        ]
    ).fit(words(train))
    fitted, held = front.transform(words(train)).persist(), front.transform(words(val)).persist()
    best = None
    for reg in strengths:
        model = LogisticRegression(
            featuresCol="_features", labelCol="_y", regParam=reg, maxIter=30, probabilityCol="_prob"
        ).fit(fitted)
        judged = model.transform(held).select(
            F.col("_y").cast("int").alias("truth"), F.col("prediction").cast("int").alias("pred")
        )
        f1 = evaluate.macro(evaluate.classification_report(judged)).first()["f1"] or 0.0
        if best is None or f1 > best[2]:
            best = (model, reg, f1)
    fitted.unpersist()
    held.unpersist()
    model, reg, f1 = best
    return PipelineModel(stages=[*front.stages, model]), reg, f1


def predict_stance(model: PipelineModel, df: DataFrame, col: str = "document") -> DataFrame:
    """Adds the probabilities of the fitted classes and the likeliest class."""
    ready = df.withColumn("_words", text.plain_words(col))
    out = model.transform(ready).withColumn("_prob", vector_to_array("_prob"))
    kept = out.withColumn("pred", F.col("prediction").cast("int")).withColumn("probabilities", F.col("_prob"))
    return kept.select(*df.columns, "pred", "probabilities")
