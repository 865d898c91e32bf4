"""End-to-end flows built from the operators (the user-level jobs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import tokenizer
from ..operators import cascade as H
from ..operators import layer1 as M
from ..operators.sampling import stratified_split
from ..session import cut_lineage


def tokenized(df: DataFrame, text_col: str = "url", tok="url") -> DataFrame:
    return df.withColumn("tokens", tokenizer(tok)(F.col(text_col)))


def train_layer1_split(labelled: DataFrame, text_col: str = "url", tok="url", seed: int = 42) -> DataFrame:
    """T1 tokens + P2 split column, materialised (read by training and scoring)."""
    return cut_lineage(stratified_split(tokenized(labelled, text_col, tok), seed=seed))


def train_layer1(labelled: DataFrame, text_col: str = "url", tok="url", min_freq: int = 2,
                 seed: int = 42) -> tuple[M.TokenModel, DataFrame]:
    """P2 split -> M1a on the train split.  Returns (model, split table)."""
    split = train_layer1_split(labelled, text_col, tok, seed)
    model = M.train_token_weights(split.where(F.col("split") == "train"), min_freq=min_freq)
    model.tok = tok
    return model, split


def score_urls(df: DataFrame, model: M.TokenModel) -> DataFrame:
    return M.score_layer1(tokenized(df, "url", model.tok), model)


def url_cascade(labelled: DataFrame, layer2_fn, threshold: float = H.DEFAULT_BAND,
                model: M.TokenModel | None = None) -> DataFrame:
    """Flagship: T1 -> P2 -> M1a -> M2 -> H1 -> H3 -> layer 2 -> H8 over a
    labelled url table (row_id, url, label)."""
    if model is None:
        model, _ = train_layer1(labelled)
    scored = score_urls(labelled, model)   # token arrays are dropped by the scorer
    final = H.cascade(scored, layer2_fn, threshold)
    return final.select("row_id", *H.FINAL_COLUMNS, F.col("label").alias("true_label"))


def fixture_cascade(scored: DataFrame, layer2_fn, threshold: float = H.DEFAULT_BAND,
                    on_missing: str = "reference") -> DataFrame:
    """Cascade over a table that already holds layer-1 confidences."""
    s = scored.withColumn("layer1_prediction",
                          (F.col("layer1_confidence") > M.DECISION_THRESHOLD).cast("int"))
    final = H.cascade(s, layer2_fn, threshold, on_missing=on_missing)
    return final.select("row_id", *H.FINAL_COLUMNS, "true_label")
