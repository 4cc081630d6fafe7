"""Scores for texts from a user-supplied scorer or a small Spark ML model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpanel.session import materialize

# Score columns and rows per call of the scorer.
LABELS = ["anger_v2", "fear_v2", "disgust_v2", "sadness_v2", "joy_v2", "enthusiasm_v2", "pride_v2", "hope_v2"]
BATCH = 32


Scorer = Callable[[list[str]], Sequence[Sequence[float]]]

# Scorers of this process by the number of their loading.
_loaded: dict[str, Scorer] = {}


def once_per_worker(load: Callable[[], Scorer]) -> Scorer:
    """A scorer that ``load`` makes on the first batch a worker process gets; all its
    later tasks use the same one."""
    name = uuid.uuid4().hex

    def score(batch: list[str]) -> Sequence[Sequence[float]]:
        from feedpanel.operators import scoring

        if name not in scoring._loaded:
            scoring._loaded[name] = load()
        return scoring._loaded[name](batch)

    return score


def accelerated(gpus: int = 1, cores: int = 4, memory: str = "16g", script: str | None = None) -> ResourceProfile:
    """Executors of their own for the scoring stage, a GPU and its cores to a task;
    the stages before and after keep the session's. ``script`` lists an executor's
    GPUs (the cluster's own setting if none is given)."""
    executor = ExecutorResourceRequests().cores(cores).memory(memory).resource("gpu", gpus, script or "")
    return ResourceProfileBuilder().require(executor).require(TaskResourceRequests().cpus(cores).resource("gpu", 1)).build


def score_texts(
    texts: DataFrame, scorer: Scorer, labels: Sequence[str] = LABELS, batch: int = BATCH, profile: ResourceProfile | None = None
) -> DataFrame:
    """(id, text_cleaned, one column per label). The scorer gets whole texts in
    small batches on the executors; wrap its loading in ``once_per_worker``. With a
    ``profile`` the stage runs on executors of that kind."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch].reset_index(drop=True)
                scores = pd.DataFrame(list(scorer(part["text_cleaned"].tolist())), columns=list(labels))
                yield pd.concat([part, scores.astype("float64")], axis=1)

    schema = "id string, text_cleaned string, " + ", ".join(f"`{c}` double" for c in labels)
    return texts.select("id", "text_cleaned").mapInPandas(run, schema, profile=profile)


def train_scorer(labelled: DataFrame, label: str, features: int = 4096) -> PipelineModel:
    """Bag-of-words logistic regression on (text_cleaned, label). The texts are read
    and split into words once: their counts are stored for both fits."""
    words = RegexTokenizer(inputCol="text_cleaned", outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    counted = materialize(counts.transform(words.transform(labelled.dropna(subset=[label]))).select(label, "_tf"))
    weights = IDF(inputCol="_tf", outputCol="_x").fit(counted)
    regression = LogisticRegression(featuresCol="_x", labelCol=label, predictionCol="_hat", probabilityCol="_p",
                                    rawPredictionCol="_raw", regParam=0.1, maxIter=50)
    return PipelineModel([words, counts, weights, regression.fit(weights.transform(counted))])


def apply_scorer(model: PipelineModel, texts: DataFrame, name: str) -> DataFrame:
    out = model.transform(texts)
    return out.select("id", "text_cleaned", F.get(vector_to_array("_p"), F.lit(1)).alias(name))
