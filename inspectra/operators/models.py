"""Risk models with MLlib: candidates, selection by validation, calibration, cluster bootstrap, readiness and scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectra.operators.evaluation import average_precision, interval
from inspectra.session import checkpoint

# What a candidate must gain, and what calibration needs.
GAIN, FEW_ROWS, ISOTONIC_ROWS, ISOTONIC_MINORITY, SEED = 0.01, 30, 1000, 400, 20260101


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles with an indicator of absence each; MLlib takes no NaN, so the median fills in later."""
    return df.withColumns({f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features} | {f"{f}_missing": F.col(f).isNull().cast("double") for f in features})


def _stages(train: DataFrame, features: list[str]) -> tuple[list, list[str]]:
    counts = train.agg(*[F.count(f).alias(f) for f in features]).first()
    usable = [f for f in features if counts[f]]  # a column without a value has no median
    filled = [f"{f}_filled" for f in usable]
    columns = [*filled, *[f"{f}_missing" for f in features]]
    return ([Imputer(inputCols=usable, outputCols=filled, strategy="median")] if usable else []) + [VectorAssembler(inputCols=columns, outputCol="raw_features")], columns


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows over twice the rows of the class."""
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # two classes
    total, w = sum(n.values()), F.lit(1.0)
    for k, c in n.items():
        w = F.when(F.col(label) == k, total / (len(n) * c)).otherwise(w)
    return df.withColumn("weight", w)


def fit_logistic(train: DataFrame, features: list[str], label: str, *, weight: bool = False) -> PipelineModel:
    """Median filling, scaling and a ridge of one over the rows, which is the usual penalty of strength one."""
    data = weighted(prepared(train, features), label) if weight else prepared(train, features)
    stages, _ = _stages(data, features)
    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / max(1, data.count()), standardization=False, maxIter=200, **({"weightCol": "weight"} if weight else {}))
    return Pipeline(stages=[*stages, StandardScaler(inputCol="raw_features", outputCol="features", withMean=True), model]).fit(data)


def fit_boosted(train: DataFrame, features: list[str], label: str, *, weight: bool = False, rounds: int = 20, seed: int = SEED) -> PipelineModel:
    data = weighted(prepared(train, features), label) if weight else prepared(train, features)
    stages, _ = _stages(data, features)
    model = GBTClassifier(featuresCol="raw_features", labelCol=label, maxIter=rounds, maxDepth=3, seed=seed, **({"weightCol": "weight"} if weight else {}))
    return Pipeline(stages=[*stages, model]).fit(data)


def scored(model: Transformer | float, df: DataFrame, features: list[str], out: str = "probability_1") -> DataFrame:
    """Adds the probability of class 1; a plain number stands for the prevalence baseline."""
    if isinstance(model, float):
        return df.withColumn(out, F.lit(model))
    t = model.transform(prepared(df, features)).withColumn(out, vector_to_array("probability")[1])
    return t.select(*df.columns, out)


@dataclass
class Selection:
    name: str
    weighted: bool
    model: object
    average_precision: float
    baseline: float
    status: str = "selected"
    scores: dict[str, float] = field(default_factory=dict)


def select_model(train: DataFrame, validation: DataFrame, features: list[str], label: str, *, boosted: bool = True) -> Selection:
    """The best candidate by average precision on validation; never sees other rows.

    Each kind is fitted with and without class weights (without wins ties). The linear one must beat the prevalence by
    ``GAIN``, else the prevalence stays; the boosted one must beat the linear one by as much.
    """
    prevalence = float(train.agg(F.avg(F.col(label).cast("double"))).first()[0])
    ap = lambda m: average_precision(scored(m, validation, features).withColumn("_all", F.lit(1)), label, "probability_1", ["_all"]).first()["average_precision"] or 0.0
    base = ap(prevalence)
    best = lambda fit: max(((fit(train, features, label, weight=w), w) for w in (False, True)), key=lambda m: (ap(m[0]), not m[1]))
    linear, lw = best(fit_logistic)
    scores = {"prevalence": base, "logistic": ap(linear)}
    if scores["logistic"] < base + GAIN:
        return Selection("prevalence", False, prevalence, base, base, "insufficient_performance", scores)
    chosen = Selection("logistic", lw, linear, scores["logistic"], base, scores=scores)
    if boosted:
        trees, tw = best(fit_boosted)
        scores["boosted"] = ap(trees)
        if scores["boosted"] >= scores["logistic"] + GAIN:
            chosen = Selection("boosted", tw, trees, scores["boosted"], base, scores=scores)
    return chosen


def calibrate(validation: DataFrame, label: str, p: str = "probability_1") -> tuple[str, object]:
    """``(method, model)``: raw with one class or few rows, isotonic with many rows of both classes, else a sigmoid."""
    n, pos = validation.agg(F.count("*"), F.count_if(F.col(label) == 1)).first()
    if n < FEW_ROWS or pos in (0, n):
        return "raw", None
    if n >= ISOTONIC_ROWS and min(pos, n - pos) >= ISOTONIC_MINORITY:
        return "isotonic", IsotonicRegression(featuresCol=p, labelCol=label).fit(validation.withColumn(label, F.col(label).cast("double")))
    logit = VectorAssembler(inputCols=[p], outputCol="p_vector").transform(validation)
    return "sigmoid", LogisticRegression(featuresCol="p_vector", labelCol=label, probabilityCol="p_probability", rawPredictionCol="p_raw", predictionCol="p_pred").fit(logit)


def calibrated(df: DataFrame, calibration: tuple[str, object], p: str = "probability_1", out: str = "calibrated") -> DataFrame:
    method, model = calibration
    if method == "raw":
        return df.withColumn(out, F.col(p))
    if method == "isotonic":
        return model.copy({model.featuresCol: p}).transform(df).withColumn(out, F.col("prediction")).select(*df.columns, out)
    t = model.transform(VectorAssembler(inputCols=[p], outputCol="p_vector").transform(df))
    return t.withColumn(out, vector_to_array("p_probability")[1]).select(*df.columns, out)


def bootstrap_multiplicities(clusters: DataFrame, cluster: str, members: int, *, base_seed: int = SEED) -> DataFrame:
    """``(member, cluster, times)``: as many clusters as there are, drawn with replacement for each member.

    Drawn without collecting: every draw is a position hashed from (seed, draw), and positions are numbered clusters.
    """
    spark = clusters.sparkSession
    ids = clusters.select(cluster).where(F.col(cluster).isNotNull()).distinct()
    n = ids.count()
    numbered = ids.rdd.map(lambda r: r[0]).zipWithIndex().toDF([cluster, "position"]) if n else ids.withColumn("position", F.lit(0).cast("long"))
    draws = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member")).select(
        "member", F.pmod(F.xxhash64(F.col("member") + base_seed, "id"), F.lit(max(1, n)).cast("long")).alias("position"))
    return draws.groupBy("member", "position").agg(F.count("*").alias("times")).join(numbered, "position").select("member", cluster, "times")


@dataclass
class Member:
    """One fit of the bootstrap with its own calibration; a failed one has no model but a reason."""

    number: int
    model: object = None
    calibration: tuple[str, object] = ("raw", None)
    reason: str | None = None


@dataclass
class Trained:
    """What scoring needs of an artifact: the chosen model, its calibration, the members and how many of them an interval needs."""

    model: object
    calibration: tuple[str, object]
    members: list[Member]
    needed: int


def fit_members(train: DataFrame, validation: DataFrame, features: list[str], label: str, cluster: str, members: int, *, fit=fit_logistic, weight: bool = False, base_seed: int = SEED) -> list[Member]:
    """The members of the cluster bootstrap: each fitted in the way that was chosen and calibrated on validation, which is never drawn from."""
    if members < 1:
        return []
    times = bootstrap_multiplicities(train, cluster, members, base_seed=base_seed).persist()
    out = []
    for m in range(members):
        drawn = train.join(times.where(F.col("member") == m), cluster).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_copy", "member", "times").persist()
        if drawn.select(label).distinct().limit(2).count() < 2:
            out.append(Member(m, reason="single_class"))
        else:
            model = fit(drawn, features, label, weight=weight)
            out.append(Member(m, model, calibrate(scored(model, validation, features), label)))
        drawn.unpersist()
    times.unpersist()
    return out


def scored_with_interval(trained: Trained, df: DataFrame, features: list[str], key: str) -> DataFrame:
    """Adds ``probability_1``, calibrated, and ``lower`` and ``upper`` from the calibrated scores of every member; ``key`` is unique."""
    def one(model: object, calibration: tuple[str, object], d: DataFrame, out: str) -> DataFrame:
        return calibrated(scored(model, d, features, "_raw"), calibration, "_raw", out).drop("_raw")

    good = [m for m in trained.members if m.reason is None]
    d = one(trained.model, trained.calibration, df, "probability_1")
    if not good:
        return d.withColumns({"lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double")})
    names = [f"_member{m.number}" for m in good]
    for i, (m, name) in enumerate(zip(good, names)):
        d = one(m.model, m.calibration, d if i % 10 else checkpoint(d), name)  # a plan of a hundred models is too long
    d = checkpoint(d)
    each = d.select(key, "probability_1", F.explode(F.array(*names)).alias("value"))
    return d.drop(*names).join(interval(each, key, "value", "probability_1", least=trained.needed).drop("n"), key)


def readiness(*, model_status: str, calibration: str, members: int, needed: int, features: list[str], splits_ok: bool, test_ok: bool) -> str:
    """The first thing that keeps a model from being used, or ``ready``."""
    for status, bad in (("no_features", not features), ("insufficient_performance", model_status != "selected"), ("invalid_splits", not splits_ok), ("uncalibrated", calibration == "raw"),
                        ("insufficient_uncertainty", members < needed), ("no_test_metrics", not test_ok)):
        if bad:
            return status
    return "ready"
