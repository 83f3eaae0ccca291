"""Features and models on pyspark.ml: median imputation, scaling, one-hot, forests, logistic, chains."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.text import as_text, parse_boolish, to_number
from sparloom.operators.forest import MultiOutputForest
from sparloom.operators.medians import medians


def typed_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], boolish: Sequence[str] = ("Has_Physical_Data", "Has_Toxicity_Data")) -> DataFrame:
    """Numbers coerced, categories as text; absent columns are null or empty."""
    have = set(df.columns)
    cols = {n: to_number(F.col(n)) if n in have else F.lit(None).cast("double") for n in numeric}
    cols |= {c: (parse_boolish(F.col(c)) if c in boolish else as_text(F.col(c))) if c in have else F.lit("") for c in categorical}
    return df.withColumns(cols)


def feature_pipeline(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], vectors: Sequence[str] = (), out: str = "features") -> PipelineModel:
    """Fitted on train rows alone.  Missing numbers become the exact median.  Numeric columns without any value are
    left out, as they tell nothing; unknown categories are all zeros."""
    middle = medians(train, numeric)
    some = [n for n in numeric if middle[n] is not None]
    stages, parts = [], list(vectors)
    if some:
        stages += [
            SQLTransformer(statement="SELECT *, " + ", ".join(f"coalesce(if(isnan(`{n}`), null, `{n}`), double('{middle[n]!r}')) AS `_i_{n}`" for n in some) + " FROM __THIS__"),
            VectorAssembler(inputCols=[f"_i_{n}" for n in some], outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ]
        parts.append("_scaled")
    if categorical:
        # the empty text is a category like others, but the indexer takes no empty names
        named = ", ".join(f"CASE WHEN `{c}` = '' THEN ' ' ELSE `{c}` END AS `_b_{c}`" for c in categorical)
        stages += [
            SQLTransformer(statement=f"SELECT *, {named} FROM __THIS__"),
            StringIndexer(inputCols=[f"_b_{c}" for c in categorical], outputCols=[f"_x_{c}" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"),
            # the indexer's bucket for unknowns is the category that the encoder drops
            OneHotEncoder(inputCols=[f"_x_{c}" for c in categorical], outputCols=[f"_h_{c}" for c in categorical], handleInvalid="error", dropLast=True),
        ]
        parts += [f"_h_{c}" for c in categorical]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol=out)]).fit(train)


def _weights(label: str, n: int, pos: int) -> Column:
    """Balanced: n / (2 * n of the class)."""
    return F.when(F.col(label) == 1, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(n - pos, 1)))


def _model(kind: str, features: str, label: str, trees: int, seed: int, n: int, c: float):
    if kind == "forest":
        return RandomForestClassifier(featuresCol=features, labelCol=label, weightCol="_w", numTrees=trees, minInstancesPerNode=2, maxDepth=20, seed=seed, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r")
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol="_w", regParam=1.0 / (c * max(n, 1)), maxIter=200, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r")


class OneVsRest:
    """One balanced model a label; a label with one class is that class."""

    def __init__(self, labels: Sequence[str], kind: str = "forest", trees: int = 500, seed: int = 123, c: float = 1.0):
        self.labels, self.kind, self.trees, self.seed, self.c = list(labels), kind, trees, seed, c
        self.models: dict[str, object] = {}

    def fit(self, df: DataFrame, features: str = "features") -> OneVsRest:
        # the features are worked out once for all labels
        kept = df.select(features, *self.labels).persist()
        try:
            counts = kept.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(x) == 1).alias(x) for x in self.labels]).first()
            n = counts["_n"]
            for label in self.labels:
                pos = counts[label]
                if pos in (0, n):
                    self.models[label] = int(pos == n and n > 0)
                    continue
                data = kept.select(features, F.col(label).cast("double").alias(label)).withColumn("_w", _weights(label, n, pos))
                self.models[label] = _model(self.kind, features, label, self.trees, self.seed, n, self.c).fit(data)
        finally:
            kept.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``pred_<label>`` and ``score_<label>``."""
        for label in self.labels:
            m = self.models[label]
            if isinstance(m, int):
                df = df.withColumns({f"score_{label}": F.lit(float(m)), f"pred_{label}": F.lit(m)})
            else:
                scored = m.transform(df)
                df = scored.withColumns({f"score_{label}": vector_to_array("_p")[1], f"pred_{label}": F.col("_y").cast("int")}).drop("_p", "_r", "_y")
        return df


class ClassifierChain:
    """Each label's model sees the labels before it: true ones when fitted, predicted ones after."""

    def __init__(self, labels: Sequence[str], trees: int = 500, seed: int = 123, kind: str = "forest", order: Sequence[str] | None = None):
        self.order = list(order) if order else random.Random(seed).sample(list(labels), len(labels))
        self.trees, self.seed, self.kind = trees, seed, kind
        self.steps: list[tuple[str, OneVsRest]] = []

    def _with(self, df: DataFrame, features: str, before: Sequence[str]) -> DataFrame:
        df = df.withColumns({f"_c_{b}": F.col(b).cast("double") for b in before})
        return VectorAssembler(inputCols=[features, *[f"_c_{b}" for b in before]], outputCol="_chain").transform(df).drop(*[f"_c_{b}" for b in before])

    def fit(self, df: DataFrame, features: str = "features") -> ClassifierChain:
        self.features = features
        for i, label in enumerate(self.order):
            step = OneVsRest([label], self.kind, self.trees, self.seed)
            self.steps.append((label, step.fit(self._with(df, features, self.order[:i]), "_chain")))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for i, (_, step) in enumerate(self.steps):
            df = step.transform(self._with(df, self.features, [f"pred_{b}" for b in self.order[:i]])).drop("_chain")
        return df


def model_grid(train: DataFrame, test: DataFrame, labels: Sequence[str], feature_sets: dict[str, str], kinds: Sequence[str] = ("forest", "logistic", "chain"), trees: int = 500, seed: int = 123) -> dict[str, DataFrame]:
    """Predictions of every model and feature set by name."""
    out = {}
    for name, column in feature_sets.items():
        for kind in kinds:
            model = ClassifierChain(labels, trees, seed) if kind == "chain" else OneVsRest(labels, kind, trees, seed)
            out[f"{kind}_{name}"] = model.fit(train, column).transform(test)
    return out


#: The usual baselines by name: the feature set and the kind of model.  ``joint`` is one forest for all labels.
BASELINES = {"both_joint": ("both", "joint"), "physical_joint": ("physical", "joint"), "structure_joint": ("structure", "joint"), "physical_logistic": ("physical", "logistic"), "structure_logistic": ("structure", "logistic")}


def baselines(train: DataFrame, test: DataFrame, labels: Sequence[str], id_col: str, feature_sets: dict[str, str], which: dict[str, tuple[str, str]] = BASELINES, trees: int = 500, seed: int = 123, depth: int = 30) -> dict[str, DataFrame]:
    """Predictions for ``test`` of every model named, each fitted on ``train`` alone; ``feature_sets`` says which
    column holds which set."""
    out = {}
    for name, (features, kind) in which.items():
        column = feature_sets[features]
        if kind == "joint":
            model = MultiOutputForest(labels, trees, seed, depth=depth).fit(train, id_col, column)
        else:
            model = OneVsRest(labels, kind, trees, seed).fit(train, column)
        out[name] = model.transform(test, column) if kind == "joint" else model.transform(test)
    return out


def frozen_transfer(train: DataFrame, external: DataFrame, labels: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], kind: str = "forest", trees: int = 500, seed: int = 123) -> DataFrame:
    """Predictions for an external set: imputation, scaling, categories and models are fitted on ``train``
    alone and then only applied."""
    known, new = (typed_features(d, numeric, categorical) for d in (train, external))
    pipeline = feature_pipeline(known, numeric, categorical)
    model = OneVsRest(labels, kind, trees, seed).fit(pipeline.transform(known))
    return model.transform(pipeline.transform(new))
