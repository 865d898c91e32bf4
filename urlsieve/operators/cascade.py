"""The two-layer cascade: route, layer-2 work list, answer parsing, merge,
statistics, listing (H1–H11) and the pluggable batch scorer (U1).

The costly layer runs only on the uncertain band and only once per distinct
url: filter -> distinct -> score -> left join back.  (Putting a scorer inside
``F.when`` would still call it for every row.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_BAND = 0.3
#: A url in so many rows is hot; at most so many are, of so many that the sketch tracks; bytes of their answers.
HOT_URL_ROWS, HOT_URLS, HOT_TRACKED, HOT_BYTES = 100_000, 1_000, 100_000, 32 << 20

# Names, texts and tags of the cascade output.
LAYER1_NAME = "BiGRU"
LAYER2_NAME = "Phi3"
NOT_ANALYZED = "Not analyzed by Layer 2"
MODEL_NOT_AVAILABLE = "Model not available"
ERROR_PREFIX = "Error: "
ASSISTANT_TAG = "<|assistant|>\n"
TAG_PHISHING, TAG_LEGITIMATE = "[PHISHING]", "[LEGITIMATE]"
EXPLANATION_CHARS = 100
ANSWER_HEAD_CHARS = 20


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- H1, H2 -----------------------------------------------------------------

def route_band(conf, threshold: float = DEFAULT_BAND) -> Column:
    """H1: threshold < confidence < 1 - threshold (strict).  NaN is never in
    the band (Spark orders NaN above every number, so it is excluded
    explicitly)."""
    c = _c(conf)
    return (c > F.lit(float(threshold))) & (c < F.lit(1.0 - float(threshold))) & ~F.isnan(c)


def route(df: DataFrame, threshold: float = DEFAULT_BAND, conf: str = "layer1_confidence",
          error: str | None = "layer1_error") -> DataFrame:
    """Adds ``used_layer2``; a layer-1 error row always goes to layer 2 (M4)."""
    band = route_band(conf, threshold)
    if error and error in df.columns:
        band = F.col(error) | band
    return df.withColumn("used_layer2", F.coalesce(band, F.lit(False)))


def triage_counts(routed: DataFrame) -> DataFrame:
    """H2: definite legitimate / definite phishing / suspicious, one row."""
    u, p = F.col("used_layer2"), F.col("layer1_prediction")
    return routed.agg(
        F.count(F.when(~u & (p == 0), 1)).alias("definite_legitimate"),
        F.count(F.when(~u & (p != 0), 1)).alias("definite_phishing"),
        F.count(F.when(u, 1)).alias("suspicious"))


# --- H3 -----------------------------------------------------------------------

def layer2_worklist(routed: DataFrame, url: str = "url") -> DataFrame:
    """H3: each routed url once."""
    return routed.where(F.col("used_layer2")).select(url).distinct()


# --- prompts (shared with the training-data operators) ------------------------

def render_prompt(instruction, url, url_prefix: bool = True) -> Column:
    """Chat prompt: ``<|user|>\\n{instruction}\\n[URL: ]{url}<|end|>\\n<|assistant|>\\n``."""
    parts = [F.lit("<|user|>\n"), _c(instruction), F.lit("\n")]
    if url_prefix:
        parts.append(F.lit("URL: "))
    parts += [_c(url), F.lit("<|end|>\n" + ASSISTANT_TAG)]
    return F.concat(*parts)


DEFAULT_INSTRUCTION = "Decide if this is phishing and explain why."


# --- H4, H5 -------------------------------------------------------------------

def extract_answer(text) -> Column:
    """H4: text after the last ``<|assistant|>\\n``, stripped of whitespace."""
    last = F.element_at(F.split(_c(text), r"<\|assistant\|>\n", -1), -1)
    return F.regexp_replace(last, r"^\s+|\s+$", "")


def _count(hay: Column, needle: str) -> Column:
    return F.floor((F.length(hay) - F.length(F.replace(hay, F.lit(needle), F.lit("")))) / len(needle))


def parse_answer(answer) -> Column:
    """H5: 0/1 from an answer text (rules on the lower-cased text)."""
    low = F.lower(_c(answer))
    head = F.substring(low, 1, ANSWER_HEAD_CHARS)
    return (F.when(low.contains("phishing") & ~head.contains("legitimate:"), F.lit(1))
            .when(low.contains("legitimate") & ~head.contains("phishing:"), F.lit(0))
            .when(_count(low, "phishing") > _count(low, "legitimate"), F.lit(1))
            .otherwise(F.lit(0)))


def layer2_results(responses: DataFrame, url: str = "url", text: str = "response",
                   error: str = "error") -> DataFrame:
    """H4 + H5 + H6: url, layer2_prediction, layer2_explanation, layer2_confidence.
    An error row gives prediction 0, ``Error: …`` and confidence 0.0."""
    ans = extract_answer(text)
    has_err = F.col(error).isNotNull() if error in responses.columns else F.lit(False)
    err_txt = F.col(error) if error in responses.columns else F.lit(None).cast("string")
    return responses.select(
        url,
        F.when(has_err, F.lit(0)).otherwise(parse_answer(ans)).alias("layer2_prediction"),
        F.when(has_err, F.concat(F.lit(ERROR_PREFIX), err_txt)).otherwise(ans).alias("layer2_explanation"),
        F.when(has_err, F.lit(0.0)).otherwise(F.lit(1.0)).alias("layer2_confidence"))


def layer2_unavailable(worklist: DataFrame, url: str = "url") -> DataFrame:
    """H7: the reference policy when layer 2 cannot load: 0, ``Model not available``."""
    return worklist.select(url, F.lit(0).alias("layer2_prediction"),
                           F.lit(MODEL_NOT_AVAILABLE).alias("layer2_explanation"),
                           F.lit(0.0).alias("layer2_confidence"))


# --- H8 -----------------------------------------------------------------------

def combine(routed: DataFrame, layer2: DataFrame | None, url: str = "url",
            on_missing: str = "reference") -> DataFrame:
    """H8: layer 1 with layer 2 on url (null-safe); the layer-2 answer wins for routed
    rows that have one.

    ``layer2=None`` means layer 2 is unavailable: ``on_missing='reference'``
    gives H7 rows (prediction 0, credited to layer 2); ``'layer1'`` keeps the
    layer-1 decision.
    """
    if layer2 is None:
        if on_missing == "layer1":
            return _final(routed.withColumn("_hit", F.lit(False))
                          .withColumn("layer2_prediction", F.lit(None).cast("int"))
                          .withColumn("layer2_explanation", F.lit(None).cast("string")))
        layer2 = layer2_unavailable(layer2_worklist(routed, url), url)
    l2 = layer2.select(F.col(url).alias("_l2url"), "layer2_prediction", "layer2_explanation",
                       F.lit(True).alias("_hit"))
    if routed.isStreaming:
        return _final(_joined(routed, l2, url))
    # rows that are not routed take no part in any join; rows of hot urls meet their answers in
    # a broadcast of bounded bytes, so no task gets all rows of one url; the others shuffle
    none = [F.lit(None).cast(l2.schema[c].dataType).alias(c) for c in ("layer2_prediction", "layer2_explanation", "_hit")]
    parts = [routed.where(~F.col("used_layer2")).select("*", *none)]
    rest = routed.where(F.col("used_layer2"))
    hot = hot_answers(rest, l2, url)
    if hot is not None:
        met = _joined(rest, F.broadcast(hot), url)
        parts.append(met.where("_hit"))
        rest = met.where("_hit is null").drop("layer2_prediction", "layer2_explanation", "_hit")
    parts.append(_joined(rest, l2, url))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _final(out)


def _joined(rows: DataFrame, answers: DataFrame, url: str) -> DataFrame:
    return rows.join(answers, F.col(url).eqNullSafe(F.col("_l2url")), "left").drop("_l2url")


def hot_answers(rows: DataFrame, answers: DataFrame, url: str) -> DataFrame | None:
    """Answers of the urls that a sketch of frequent items counts at least ``HOT_URL_ROWS`` times,
    most frequent first, as far as they take ``HOT_BYTES`` together; None without any."""
    top = rows.agg(F.expr(f"approx_top_k({_quoted(url)}, {HOT_URLS}, {HOT_TRACKED})").alias("top"))
    hot = top.select(F.explode("top").alias("t")).where(F.col("t.count") >= HOT_URL_ROWS).select(
        F.col("t.item").alias("_hot"), F.col("t.count").alias("_rows"))
    if not hot.head(1):
        return None
    found = answers.join(F.broadcast(hot), F.col("_l2url").eqNullSafe(F.col("_hot")))       # HOT_URLS rows at most
    size = F.octet_length("_l2url").cast("long") + F.coalesce(F.octet_length("layer2_explanation"), F.lit(0)) + 64
    order = Window.orderBy(F.desc("_rows"), "_l2url").rowsBetween(Window.unboundedPreceding, 0)
    fits = found.withColumn("_bytes", F.sum(size).over(order)).where(F.col("_bytes") <= HOT_BYTES)
    return cut_lineage(fits.select(answers.columns))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _final(j: DataFrame) -> DataFrame:
    use2 = F.col("used_layer2") & F.coalesce(F.col("_hit"), F.lit(False))
    return (j.withColumn("final_prediction",
                         F.when(use2, F.col("layer2_prediction")).otherwise(F.col("layer1_prediction")))
            .withColumn("layer2_explanation",
                        F.when(use2, F.col("layer2_explanation")).otherwise(F.lit(NOT_ANALYZED)))
            .withColumn("decision_maker", F.when(use2, F.lit(LAYER2_NAME)).otherwise(F.lit(LAYER1_NAME)))
            .drop("_hit", "layer2_prediction"))


def cascade(scored: DataFrame, layer2_fn, threshold: float = DEFAULT_BAND, url: str = "url",
            on_missing: str = "reference", materialize: bool = True) -> DataFrame:
    """H1 -> H3 -> layer 2 -> H8.  ``layer2_fn(worklist) -> layer2 results`` or
    ``None`` when layer 2 is unavailable.

    ``materialize``: the routed layer-1 rows feed both the work list and the
    merge, and layer-2 answers come from a costly (possibly non-deterministic)
    model; both are checkpointed to the shared folder so neither is computed
    twice and a lost executor does not re-run the model."""
    routed = route(scored, threshold)
    if materialize:
        routed = cut_lineage(routed)
    l2 = layer2_fn(layer2_worklist(routed, url)) if layer2_fn is not None else None
    if l2 is not None and materialize:
        l2 = cut_lineage(l2)
    return combine(routed, l2, url, on_missing)


FINAL_COLUMNS = ("url", "layer1_confidence", "layer1_prediction", "used_layer2",
                 "final_prediction", "layer2_explanation", "decision_maker")


# --- H9, H10, H11 ----------------------------------------------------------------

def cascade_stats(final: DataFrame) -> DataFrame:
    """H9: totals and efficiency % = (total - layer 2) / total (null for 0 rows)."""
    u = F.col("used_layer2")
    agg = final.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count(F.when(~u & (F.col("layer1_prediction") == 0), 1)).alias("layer1_legitimate"),
        F.count(F.when(u, 1)).alias("layer1_suspicious"),
        F.count(F.when(u, 1)).alias("layer2_processed"),
        F.count(F.when(F.col("final_prediction") == 1, 1)).alias("final_phishing"),
        F.count(F.when(F.col("final_prediction") != 1, 1)).alias("final_legitimate"))
    eff = F.try_divide((F.col("total_processed") - F.col("layer2_processed")).cast("double") * 100,
                       F.col("total_processed").cast("double"))
    return agg.withColumn("efficiency_pct", eff)


def standalone_stats(standalone: DataFrame) -> DataFrame:
    """Total, phishing, everything else legitimate (errors included)."""
    return standalone.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count(F.when(F.col("prediction") == 1, 1)).alias("phishing_detected"),
        F.count(F.when(F.col("prediction") != 1, 1)).alias("legitimate_detected"))


def result_listing(final: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Status tag, decision maker, confidence to 3 places, explanation cut
    to 100 chars + ``...`` (shown only for rows that went to layer 2)."""
    e = F.col("layer2_explanation")
    cut = F.when(F.length(e) > EXPLANATION_CHARS,
                 F.concat(F.substring(e, 1, EXPLANATION_CHARS), F.lit("..."))).otherwise(e)
    return final.select(
        row_id, "url",
        F.when(F.col("final_prediction") == 1, TAG_PHISHING).otherwise(TAG_LEGITIMATE).alias("status"),
        "decision_maker",
        F.round("layer1_confidence", 3).alias("confidence"),
        F.when(F.col("used_layer2"), cut).alias("explanation"))


# --- U1: pluggable batch scorer ----------------------------------------------------

_LOADED: dict[str, object] = {}    # by the scorer's pickled state


def _loaded(scorer):
    """Load a scorer once per Python worker process and reuse it; scorers of other
    settings are other models."""
    key = hashlib.sha256(cloudpickle.dumps(scorer)).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = scorer.load()
    return _LOADED[key]


def _batches(batches: Iterator[pd.DataFrame], rows: int | None) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), rows or max(len(pdf), 1)):
            yield pdf.iloc[at:at + (rows or len(pdf))]


def plugin_responses(worklist: DataFrame, scorer, instruction: str = DEFAULT_INSTRUCTION,
                     url: str = "url", batch_rows: int | None = None,
                     num_partitions: int | None = None) -> DataFrame:
    """Run a Python model over the distinct routed urls in Arrow batches of at most
    ``batch_rows`` rows.

    Output url, response, error (per-row failure captured, the job goes on).
    A scorer whose ``load`` raises makes every row an error row.
    ``num_partitions`` spreads a costly model over more tasks (the work list
    is already deduplicated, so no url is scored twice).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = _loaded(scorer)
            load_error = None
        except Exception as exc:  # noqa: BLE001 - reported per row
            model, load_error = None, str(exc)
        for pdf in _batches(batches, batch_rows):
            urls = pdf[url]
            if model is None:
                yield pd.DataFrame({url: urls, "response": [None] * len(urls),
                                    "error": [load_error] * len(urls)})
                continue
            try:
                resp, err = model.generate(urls, instruction)
            except Exception:  # noqa: BLE001 - fall back to one row at a time
                resp, err = [], []
                for u in urls:
                    try:
                        r, e = model.generate(pd.Series([u]), instruction)
                        resp.append(r[0]); err.append(e[0])
                    except Exception as exc:  # noqa: BLE001
                        resp.append(None); err.append(str(exc))
            yield pd.DataFrame({url: urls, "response": resp, "error": err})

    from ..session import ship_package
    ship_package(worklist.sparkSession)
    schema = f"{url} string, response string, error string"
    wl = worklist.select(url)
    if num_partitions:
        wl = wl.repartition(num_partitions, url)
    return wl.mapInPandas(run, schema)
