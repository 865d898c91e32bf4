"""Layer 1: train and apply a distributed token classifier (M1–M5).

M1a is multinomial naive Bayes written as aggregates: one pass of per-token
conditional counts (map-side combined, so a token in every row costs one
partial count per task) and a handful of scalar totals read as scalar
subqueries -- no cross join.  Scoring looks the weights up inside the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lookup import lookup_sum

METRIC_DECIMALS = 6
DECISION_THRESHOLD = 0.5
LOG_CLAMP = -100.0

# Per-row failure outputs.
ERROR_CONFIDENCE = 0.5
ERROR_PREDICTION = 0
STATUS_PHISHING, STATUS_LEGITIMATE, STATUS_ERROR = "phishing", "legitimate", "error"


@dataclass
class TokenModel:
    weights: DataFrame   # token, c1, c0, weight
    bias: DataFrame | float      # one row: bias (log prior odds), or the number itself
    tok: str = "url"     # the tokenizer whose tokens the weights are of


def train_token_weights(train: DataFrame, tokens: str = "tokens", label: str = "label",
                        alpha: float = 1.0, min_freq: int = 1, materialize: bool = True) -> TokenModel:
    """weight(token) = ln((c1+a)/(N1+aV)) - ln((c0+a)/(N0+aV));
    bias = ln((n1+1)/(n0+1)).  Tokens seen fewer than ``min_freq`` times in
    the training rows are left out (the T4 vocabulary rule); V = kept tokens."""
    ex = train.select(F.col(label).alias("_y"), F.explode(tokens).alias("token"))
    per_token = ex.groupBy("token").agg(
        F.count(F.when(F.col("_y") == 1, 1)).alias("c1"),
        F.count(F.when(F.col("_y") == 0, 1)).alias("c0"))
    if min_freq > 1:
        per_token = per_token.where(F.col("c1") + F.col("c0") >= min_freq)
    if materialize:  # vocabulary-sized; read by the totals and by the weights
        per_token = cut_lineage(per_token)
    totals = per_token.agg(F.struct(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"),
                                    F.count(F.lit(1)).alias("v")).alias("t")).scalar()
    big_n1, big_n0, vocab = totals["n1"], totals["n0"], totals["v"]
    a = F.lit(float(alpha))
    w = (F.ln((F.col("c1") + a) / (big_n1 + a * vocab))
         - F.ln((F.col("c0") + a) / (big_n0 + a * vocab)))
    weights = per_token.select("token", "c1", "c0", w.alias("weight"))
    rows = train.agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"),
                     F.count(F.when(F.col(label) == 0, 1)).alias("q"))
    bias = rows.select(F.ln((F.col("p") + 1.0) / (F.col("q") + 1.0)).alias("bias"))
    if materialize:  # the model is read by every scoring job: compute it once
        weights, bias = cut_lineage(weights), cut_lineage(bias)
    return TokenModel(weights, bias)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def score_layer1(df: DataFrame, model: TokenModel, row_id: str = "row_id", url: str | None = "url",
                 tokens: str = "tokens", threshold: float = DECISION_THRESHOLD) -> DataFrame:
    """M2 (+M4): adds layer1_confidence = P(phishing), layer1_prediction =
    confidence > 0.5, layer1_error (the token array is dropped).  A null url
    or a non-finite score gives the error row (0.5, 0).  ``url=None`` skips the
    null-url check.

    Weights are looked up and summed inside the row, so rows do not move, other
    columns are not touched, and rows with equal ids are scored each.  The
    confidence is not rounded: decisions and routing see it as it is.
    """
    scored = lookup_sum(df, model.weights, "token", "weight", F.coalesce(F.col(tokens), F.array().cast("array<string>")), "_s")
    scored = scored.drop(tokens)
    bias = F.lit(model.bias) if isinstance(model.bias, float) else model.bias.select("bias").scalar()
    raw = sigmoid(bias + F.col("_s"))
    bad = raw.isNull() | F.isnan(raw)
    if url is not None:
        bad = F.col(url).isNull() | bad
    return (scored
            .withColumn("layer1_error", bad)
            .withColumn("layer1_confidence", F.when(F.col("layer1_error"), F.lit(ERROR_CONFIDENCE)).otherwise(raw))
            .withColumn("layer1_prediction",
                        F.when(F.col("layer1_error"), F.lit(ERROR_PREDICTION))
                        .otherwise((F.col("layer1_confidence") > threshold).cast("int")))
            .drop("_s"))


def score_standalone(scored: DataFrame, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """M3: url, confidence, prediction, status (phishing / legitimate / error)."""
    status = (F.when(F.col("layer1_error"), STATUS_ERROR)
              .when(F.col("layer1_prediction") == 1, STATUS_PHISHING)
              .otherwise(STATUS_LEGITIMATE))
    return scored.select("row_id", url, F.col("layer1_confidence").alias("confidence"),
                         F.col("layer1_prediction").alias("prediction"), status.alias("status"), *(keep or []))


def clamped_log(p: Column) -> Column:
    """ln(p) clamped at -100 (ln(0) -> -100 rather than null / -inf)."""
    return F.when(p <= 0, F.lit(LOG_CLAMP)).otherwise(F.greatest(F.ln(p), F.lit(LOG_CLAMP)))


def binary_counts(truth: Column, pred: Column, prefix: str = "") -> list[Column]:
    return [F.count(F.when((truth == 1) & (pred == 1), 1)).alias(prefix + "tp"),
            F.count(F.when((truth == 0) & (pred == 1), 1)).alias(prefix + "fp"),
            F.count(F.when((truth == 1) & (pred == 0), 1)).alias(prefix + "fn"),
            F.count(F.when((truth == 0) & (pred == 0), 1)).alias(prefix + "tn")]


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 when b is 0 (zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """accuracy, precision, recall, f1, auc on hard labels (0 if one class)."""
    n = tp + fp + fn + tn
    precision = ratio(tp, tp + fp)
    recall = ratio(tp, tp + fn)
    f1 = ratio(2 * tp, 2 * tp + fp + fn)
    tnr = ratio(tn, tn + fp)
    both = ((tp + fn) > 0) & ((tn + fp) > 0)
    auc = F.when(both, (recall + tnr) / 2).otherwise(F.lit(0.0))
    return {"accuracy": ratio(tp + tn, n), "precision": precision, "recall": recall,
            "f1_score": f1, "auc_roc": auc}


def validation_metrics(scored: DataFrame, label: str = "label",
                       conf: str = "layer1_confidence", group_by: tuple[str, ...] = ()) -> DataFrame:
    """M5: mean binary cross-entropy over rows + hard-label metrics at > 0.5
    (one aggregate; ``group_by`` e.g. ``("split",)`` for several splits at once)."""
    y = F.col(label).cast("double")
    p = F.col(conf)
    loss = -(y * clamped_log(p) + (F.lit(1.0) - y) * clamped_log(F.lit(1.0) - p))
    pred = (p > DECISION_THRESHOLD).cast("int")
    agg = scored.groupBy(*group_by).agg(F.avg(loss).alias("_loss"), *binary_counts(F.col(label), pred))
    m = metric_columns(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return agg.select(*group_by, F.round("_loss", METRIC_DECIMALS).alias("val_loss"),
                      *[F.round(v, METRIC_DECIMALS).alias(k) for k, v in m.items()],
                      F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
                      F.col("fn").cast("bigint").alias("fn"), F.col("tn").cast("bigint").alias("tn"))


RIDGE, MAX_STEPS, GRADIENT_NORM = 1.0, 100, 1e-9


def log_odds(df: DataFrame, model: TokenModel, tokens: str = "tokens", out: str = "log_odds") -> DataFrame:
    """Adds ``out``: the row's vocabulary counts weighted by M1a, plus the bias."""
    summed = lookup_sum(df, model.weights, "token", "weight", F.coalesce(F.col(tokens), F.array().cast("array<string>")), out)
    return summed.withColumn(out, F.col(out) + model.bias.select("bias").scalar())


@dataclass
class LogisticModel:
    slope: float
    intercept: float
    steps: int
    gradient: float     # its norm at the end


def train_logistic(train: DataFrame, feature: str = "log_odds", label: str = "label", ridge: float = RIDGE) -> LogisticModel:
    """Logistic regression of the label on the log-odds, with a ridge, by Newton's method.

    Rows with equal feature and label are counted once, so a step is one aggregate over
    the distinct values: five sums reach the driver, which solves two equations.  The loss
    is strictly convex; a step that does not lower the gradient's norm is halved.  Ends
    when that norm is below ``GRADIENT_NORM`` times the number of rows."""
    cells = cut_lineage(train.groupBy(F.col(feature).alias("z"), F.col(label).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n")))

    def sums(a: float, b: float) -> tuple:
        p = sigmoid(F.lit(a) * F.col("z") + F.lit(b))
        error, weight = F.col("n") * (p - F.col("y")), F.col("n") * p * (1 - p)
        g1, g0, h11, h10, h00, n = (x or 0.0 for x in cells.agg(
            F.sum(error * F.col("z")), F.sum(error), F.sum(weight * F.col("z") * F.col("z")), F.sum(weight * F.col("z")), F.sum(weight),
            F.sum("n").cast("double")).first())
        return g1 + ridge * a, g0 + ridge * b, h11 + ridge, h10, h00 + ridge, n

    a = b = 0.0
    g1, g0, h11, h10, h00, n = sums(a, b)
    steps, size = 0, 1.0
    while (norm := (g1 * g1 + g0 * g0) ** 0.5) > GRADIENT_NORM * max(n, 1.0) and steps < MAX_STEPS:
        det = h11 * h00 - h10 * h10
        da, db = (g1 * h00 - g0 * h10) / det, (g0 * h11 - g1 * h10) / det
        new = sums(a - size * da, b - size * db)
        steps += 1
        if (new[0] ** 2 + new[1] ** 2) ** 0.5 < norm:
            a, b, size = a - size * da, b - size * db, 1.0
            g1, g0, h11, h10, h00, n = new
        else:
            size /= 2
    return LogisticModel(a, b, steps, norm)


def score_logistic(df: DataFrame, model: LogisticModel, feature: str = "log_odds") -> DataFrame:
    """Apply M1b: layer1_confidence = P(class 1), layer1_prediction."""
    p = sigmoid(F.lit(model.slope) * F.col(feature) + F.lit(model.intercept))
    return df.withColumn("layer1_confidence", p).withColumn("layer1_prediction", (p > DECISION_THRESHOLD).cast("int"))


def train_logreg(train: DataFrame, tokens: str = "tokens", label: str = "label",
                 num_features: int = 1 << 18, max_iter: int = 20):
    """M1b, another form: hashed term counts + logistic regression (pyspark.ml, distributed)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    tf = HashingTF(inputCol=tokens, outputCol="features", numFeatures=num_features)
    lr = LogisticRegression(featuresCol="features", labelCol="_y", maxIter=max_iter)
    data = train.withColumn("_y", F.col(label).cast("double")).withColumn(
        tokens, F.coalesce(F.col(tokens), F.array().cast("array<string>")))
    return Pipeline(stages=[tf, lr]).fit(data)


def score_logreg(df: DataFrame, model, tokens: str = "tokens") -> DataFrame:
    """Apply the other form of M1b: layer1_confidence = P(class 1), layer1_prediction."""
    from pyspark.ml.functions import vector_to_array

    data = df.withColumn(tokens, F.coalesce(F.col(tokens), F.array().cast("array<string>")))
    out = model.transform(data)
    p = vector_to_array("probability")[1]
    return (out.withColumn("layer1_confidence", p)
            .withColumn("layer1_prediction", (F.col("layer1_confidence") > DECISION_THRESHOLD).cast("int"))
            .drop("features", "rawPrediction", "probability", "prediction"))
