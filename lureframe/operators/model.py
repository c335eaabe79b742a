"""Model features, heuristic probability and the Spark ML classifier."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions.rounding import clamp
from .signals import evidence


def features(df: DataFrame) -> DataFrame:
    """``features``: struct of the 18 doubles, in vector order.  URL presence is left out on purpose."""
    body = F.col("body")
    size = F.greatest(F.length(body), F.lit(1))
    count = lambda chars: F.length(body) - F.length(F.translate(body, chars, ""))
    words = F.size(F.filter(F.split(body, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    cols = {
        "message_length": F.length(body), "word_count": words,
        "special_char_frequency": count("_@%*&!") / size,
        "uppercase_ratio": F.length(F.regexp_replace(body, r"[^\p{Lu}]", "")) / size,
        "urgency_score": F.col("urgency_score"), "fear_threat_score": F.col("fear_threat_score"),
        "reward_score": F.col("reward_score"), "pressure_score": F.col("pressure_score"),
        "authority_score": clamp(F.lit(0.25) * F.size("phrases.authority")),
        "payment_request": F.col("payment_request"), "credential_request": F.col("credential_request"),
        "otp_request": F.col("otp_request"), "sensitive_info_request": F.col("sensitive_request"),
        "has_phone": F.size("phones") > 0, "has_email": F.size("emails") > 0, "amount_count": F.size("amounts"),
        "scam_keyword_hits": F.size("matches"), "punctuation_ratio": count(".,;:!?") / size,
    }
    return df.withColumn("features", F.struct(*[cols[n].cast("double").alias(n) for n in lx.FEATURES]))


def heuristic_probability(f: Column) -> Column:
    # FIXED VALUES: weights of the fallback estimate
    weights = [("payment_request", 0.20), ("credential_request", 0.20), ("otp_request", 0.15),
               ("sensitive_info_request", 0.10), ("fear_threat_score", 0.08), ("urgency_score", 0.05),
               ("reward_score", 0.05), ("pressure_score", 0.05), ("authority_score", 0.04)]
    total = F.lit(0.22) * f["scam_keyword_hits"] * F.lit(0.33)
    for name, w in weights:
        total = total + F.lit(w) * f[name]
    return clamp(total)


def predict_heuristic(df: DataFrame, threshold: float = lx.ML_THRESHOLD) -> DataFrame:
    df = df.withColumn("_p", heuristic_probability(F.col("features")))
    return df.withColumns({
        "probability": F.bround("_p", 4), "ml_label": F.when(F.col("_p") >= threshold, "scam").otherwise("benign"),
        "raw_probability": F.col("_p"), "ml_model": F.lit("none"), "ml_is_mock": F.lit(True),
    }).drop("_p")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.col("features")[n].alias(f"f_{n}") for n in lx.FEATURES])


def train_classifier(df: DataFrame, label: str = "label", c: float = 0.8, max_iter: int = 2000, tol: float = 1e-4) -> PipelineModel:
    """Standardised logistic regression with balanced class weights.

    Class sizes are one aggregate; the rest is Spark ML's distributed solver.
    The penalty 1/(C * sum of weights) equals the usual ``C`` parametrisation,
    since balanced weights sum to the number of rows.  Spark scales by the sample
    deviation; the factor (n - 1) / n of the penalty makes that the population's.
    """
    known = F.col(label).isin("scam", "benign")
    if df.where(~F.coalesce(known, F.lit(False))).limit(1).count():
        raise ValueError("labels other than scam and benign")
    sizes = {r[label]: r["n"] for r in df.where(known).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {"scam", "benign"}:
        raise ValueError("training needs rows of both labels")
    n = sum(sizes.values())
    w = {k: n / (2.0 * v) for k, v in sizes.items()}
    data = _flat(df).withColumns({
        "y": (F.col(label) == "scam").cast("double"),
        "w": F.when(F.col(label) == "scam", w["scam"]).otherwise(w["benign"]),
    })
    stages = [
        VectorAssembler(inputCols=[f"f_{f}" for f in lx.FEATURES], outputCol="raw_vector"),
        StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True, withStd=True),
        LogisticRegression(featuresCol="vector", labelCol="y", weightCol="w", maxIter=max_iter, regParam=(n - 1) / n / (c * n), tol=tol,
                           elasticNetParam=0.0, standardization=False, probabilityCol="p", predictionCol="predicted",
                           rawPredictionCol="margin"),
    ]
    return Pipeline(stages=stages).fit(data)


def predict_model(df: DataFrame, model: PipelineModel, threshold: float = lx.ML_THRESHOLD) -> DataFrame:
    drop = [f"f_{f}" for f in lx.FEATURES] + ["raw_vector", "vector", "margin", "p", "predicted", "_p"]
    out = model.transform(_flat(df)).withColumn("_p", vector_to_array("p")[1])
    return out.withColumns({
        "probability": F.bround("_p", 4), "ml_label": F.when(F.col("_p") >= threshold, "scam").otherwise("benign"),
        "raw_probability": F.col("_p"), "ml_model": F.lit("LogisticRegression"), "ml_is_mock": F.lit(False),
    }).drop(*drop)


def feature_importance(spark, model: PipelineModel) -> DataFrame:
    coefs = model.stages[-1].coefficients.toArray()
    rows = [(f, round(abs(float(c)), 4)) for f, c in zip(lx.FEATURES, coefs)]
    return spark.createDataFrame(rows, "feature string, importance double")


def ml_evidence() -> Column:
    high = F.col("probability") >= 0.5
    return F.array(evidence(
        "ml_classifier", F.when(high, "ml_probability_high").otherwise("ml_probability_low"),
        F.when(high, "medium").otherwise("info"), F.least(F.lit(0.9), F.lit(0.4) + F.col("probability")),
        F.concat(F.lit("The model"), F.when(F.col("ml_is_mock"), " [heuristic fallback]").otherwise(""), F.lit(" puts the probability of a scam at "),
                 F.bround(F.col("probability") * 100, 0).cast("int").cast("string"), F.lit("% (label: "), F.col("ml_label"), F.lit(").")),
        probability=F.col("probability"), label=F.col("ml_label"), model=F.col("ml_model")))
