"""Registry of queries (one per operator of the inventory) and their oracle SQL.

Every query reads the driver tables of ``sf_dir`` (or data Spark derives from
them) in full; none runs on fixed input alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_tokens, url_tokens_structured
from ..operators import cascade as H
from ..operators import cleaning as C
from ..operators import evaluation as E
from ..operators import layer1 as M
from ..operators import promptdata as PD
from ..operators import runs as V
from ..operators import sampling as P
from ..operators import tokens as T
from ..session import cut_lineage, fresh_path
from ..sources import files as S
from ..streaming import cascade_stream as X
from . import fixtures as fx
from . import flows
from . import jobs as J
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


def _rounded(df: DataFrame, col: str = "layer1_confidence") -> DataFrame:
    """A confidence that exp made, to 6 places (two engines differ in the last bits).
    Decisions are made before; only a query's result is rounded."""
    return df.withColumn(col, F.round(col, 6))


# ---------------------------------------------------------------- C1–C4
CLEAN_SQL = O.with_(O.RAW_URLS) + (
    "SELECT page_id, url, CASE status WHEN 'legitimate' THEN 0 WHEN 'phishing' THEN 1 END AS status "
    "FROM raw_urls WHERE url IS NOT NULL AND status IS NOT NULL")


@register("clean_rows", CLEAN_SQL)
def q_clean_rows(spark, sf):
    raw = fx.raw_urls(spark, sf)
    url_col, label_col = C.detect_columns(raw)
    return C.normalize_labels(C.clean_rows(raw, url_col, label_col, keep=["page_id"]), label_col)


@register("detect_columns", O.with_(O.RAW_URLS) + "SELECT page_id, url, status AS label FROM raw_urls")
def q_detect_columns(spark, sf):
    """The url and label columns found by name in a raw table, read whole."""
    raw = fx.raw_urls(spark, sf)
    url_col, label_col = C.detect_columns(raw)
    return raw.select("page_id", F.col(url_col).alias("url"), F.col(label_col).alias("label"))


@register("normalize_labels", O.with_(O.RAW_URLS) + (
    "SELECT page_id AS row_id, url, CASE status WHEN 'legitimate' THEN 0 WHEN 'phishing' THEN 1 END AS label "
    "FROM raw_urls WHERE url IS NOT NULL AND status IS NOT NULL"))
def q_normalize_labels(spark, sf):
    return C.load_labelled(fx.raw_urls(spark, sf).withColumnRenamed("page_id", "row_id"))


@register("label_distribution", O.with_(O.URLS) +
          "SELECT label, count(*) AS n FROM urls GROUP BY label")
def q_label_distribution(spark, sf):
    return C.label_distribution(fx.urls(spark, sf))


@register("dataset_profile", O.with_(O.TEXTS) + (
    "SELECT count(*) AS rows, count(DISTINCT label) AS distinct_labels, "
    "count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives FROM texts"))
def q_dataset_profile(spark, sf):
    return C.dataset_profile(fx.texts(spark, sf))


# ---------------------------------------------------------------- T1–T8
@register("tokenize_url", O.with_(O.URLS) + f"SELECT row_id, url, {O.t1('url')} AS tokens FROM urls")
def q_tokenize_url(spark, sf):
    return fx.urls(spark, sf).select("row_id", "url", url_tokens("url").alias("tokens"))


@register("tokenize_url_structured", O.with_(O.URLS) +
          f"SELECT row_id, url, {O.t2('url')} AS tokens FROM urls")
def q_tokenize_url_structured(spark, sf):
    return fx.urls(spark, sf).select("row_id", "url", url_tokens_structured("url").alias("tokens"))


def _sql_counts(src: str, name: str = "tc") -> str:
    return (f"{name}_ex AS (SELECT row_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM {src}), "
            f"{name} AS (SELECT token, count(*) AS cnt, min(struct_pack(r := row_id, p := pos)) AS f "
            f"FROM {name}_ex GROUP BY token)")


TOK = f"tok AS (SELECT row_id, url, label, {O.t1('url')} AS tokens FROM urls)"


@register("token_counts", O.with_(O.URLS, TOK, _sql_counts("tok")) +
          "SELECT token, cnt, f.r AS first_row, CAST(f.p AS INTEGER) AS first_pos FROM tc")
def q_token_counts(spark, sf):
    return T.token_counts(flows.tokenized(fx.urls(spark, sf)))


def _sql_vocab(src: str = "train", min_freq: int = 2) -> str:
    return (_sql_counts(src) + ", vocab AS (SELECT token, cnt, CAST(row_number() OVER (ORDER BY f.r, f.p) + 1 "
            f"AS INTEGER) AS idx FROM tc WHERE cnt >= {min_freq} AND token NOT IN ('<PAD>', '<UNK>'))")


VOCAB_CTES = [O.URLS, TOK, *O.split_ctes("tok"), "train AS (SELECT * FROM split WHERE split = 'train')",
              _sql_vocab()]


def _vocab(spark, sf):
    split = flows.train_layer1_split(fx.urls(spark, sf))
    train = split.where(F.col("split") == "train")
    return split, T.build_vocab(T.token_counts(train))


@register("build_vocab", O.with_(*VOCAB_CTES) + "SELECT token, cnt, idx FROM vocab")
def q_build_vocab(spark, sf):
    return _vocab(spark, sf)[1]


def _sql_encode(src: str, max_len: int, out: str = "enc") -> str:
    return (f"{out}_ex AS (SELECT row_id, unnest(list_slice(tokens, 1, {max_len})) AS token, "
            f"unnest(range(len(list_slice(tokens, 1, {max_len})))) AS pos FROM {src}), "
            f"{out}_ids AS (SELECT e.row_id, list(coalesce(v.idx, 1) ORDER BY e.pos) AS ids "
            f"FROM {out}_ex e LEFT JOIN vocab v ON e.token = v.token GROUP BY e.row_id), "
            f"{out} AS (SELECT s.*, list_resize(coalesce(i.ids, CAST([] AS INTEGER[])), {max_len}, 0) AS sequence "
            f"FROM {src} s LEFT JOIN {out}_ids i ON s.row_id = i.row_id)")


@register("encode_sequence", O.with_(*VOCAB_CTES, _sql_encode("split", 200)) +
          "SELECT row_id, sequence FROM enc")
def q_encode_sequence(spark, sf):
    split, vocab = _vocab(spark, sf)
    return T.encode(split, vocab, 200).select("row_id", "sequence")


@register("attention_mask", O.with_(*VOCAB_CTES, _sql_encode("split", 200)) +
          "SELECT row_id, list_transform(sequence, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END) AS mask FROM enc")
def q_attention_mask(spark, sf):
    split, vocab = _vocab(spark, sf)
    return T.encode(split, vocab, 200).select("row_id", T.attention_mask("sequence").alias("mask"))


@register("decode_sequence", O.with_(*VOCAB_CTES, _sql_encode("split", 200)) + (
    "SELECT row_id, coalesce((SELECT list(coalesce(v.token, '<UNK>') ORDER BY d.pos) FROM "
    "(SELECT unnest(sequence) AS idx, unnest(range(len(sequence))) AS pos) d LEFT JOIN vocab v ON d.idx = v.idx "
    "WHERE d.idx <> 0), CAST([] AS VARCHAR[])) AS decoded FROM enc"))
def q_decode_sequence(spark, sf):
    split, vocab = _vocab(spark, sf)
    enc = T.encode(split, vocab, 200).select("row_id", "sequence")
    return T.decode(enc, vocab).select("row_id", "decoded")


@register("training_table", O.with_(*VOCAB_CTES, _sql_encode("split", 150)) + (
    "SELECT row_id, split, sequence, list_transform(sequence, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END) AS mask, "
    "CAST(label AS DOUBLE) AS label FROM enc"))
def q_training_table(spark, sf):
    from ..session import fresh_path
    split, vocab = _vocab(spark, sf)
    table = T.model_ready(split, vocab, 150)
    return T.write_training_table(table, fresh_path(spark, "training_table")).select(
        "row_id", "split", "sequence", "mask", "label")


# ---------------------------------------------------------------- M1–M5
URL_MODEL_CTES = [O.URLS, TOK, *O.split_ctes("tok"), "train AS (SELECT * FROM split WHERE split = 'train')",
                  *O.nb_ctes("train"), *O.score_ctes("split")]


@register("train_token_weights", O.with_(*URL_MODEL_CTES) +
          "SELECT token, c1, c0, round(weight, 6) AS weight FROM nb_w")
def q_train_token_weights(spark, sf):
    model, _ = flows.train_layer1(fx.urls(spark, sf))
    return model.weights.select("token", "c1", "c0", F.round("weight", 6).alias("weight"))


@register("score_layer1", O.with_(*URL_MODEL_CTES) +
          "SELECT row_id, url, split, round(layer1_confidence, 6) AS layer1_confidence, layer1_prediction FROM l1")
def q_score_layer1(spark, sf):
    model, split = flows.train_layer1(fx.urls(spark, sf))
    return _rounded(M.score_layer1(split, model).select("row_id", "url", "split", "layer1_confidence", "layer1_prediction"))


@register("score_standalone", O.with_(*URL_MODEL_CTES) + (
    "SELECT row_id, url, round(layer1_confidence, 6) AS confidence, layer1_prediction AS prediction, "
    "CASE WHEN layer1_error THEN 'error' WHEN layer1_prediction = 1 THEN 'phishing' ELSE 'legitimate' END AS status "
    "FROM l1"))
def q_score_standalone(spark, sf):
    model, split = flows.train_layer1(fx.urls(spark, sf))
    return _rounded(M.score_standalone(M.score_layer1(split, model)), "confidence")


ERR_SRC = ("errsrc AS (SELECT row_id, CASE WHEN label = 1 THEN NULL ELSE url END AS url, label, "
           f"{O.t1('CASE WHEN label = 1 THEN NULL ELSE url END')} AS tokens FROM urls)")


@register("score_error_rows", O.with_(O.URLS, TOK, *O.split_ctes("tok"),
                                      "train AS (SELECT * FROM split WHERE split = 'train')",
                                      *O.nb_ctes("train"), ERR_SRC, *O.score_ctes("errsrc")) + (
    "SELECT row_id, url, round(layer1_confidence, 6) AS layer1_confidence, layer1_prediction, layer1_error FROM l1"))
def q_score_error_rows(spark, sf):
    """M4: urls of one class nulled out; those rows must come back as error rows."""
    u = fx.urls(spark, sf)
    model, _ = flows.train_layer1(u)
    broken = u.withColumn("url", F.when(F.col("label") == 1, F.lit(None).cast("string")).otherwise(F.col("url")))
    s = M.score_layer1(flows.tokenized(broken), model)
    return _rounded(s.select("row_id", "url", "layer1_confidence", "layer1_prediction", "layer1_error"))


def _val_sql(where: str) -> str:
    clamp = lambda p: f"(CASE WHEN {p} <= 0 THEN -100.0 ELSE greatest(ln({p}), -100.0) END)"
    loss = (f"-(CAST(label AS DOUBLE) * {clamp('layer1_confidence')} + (1.0 - CAST(label AS DOUBLE)) * "
            f"{clamp('1.0 - layer1_confidence')})")
    pred = "CAST(layer1_confidence > 0.5 AS INTEGER)"
    return (f"v AS (SELECT avg({loss}) AS _loss, count(*) FILTER (WHERE label = 1 AND {pred} = 1) AS tp, "
            f"count(*) FILTER (WHERE label = 0 AND {pred} = 1) AS fp, count(*) FILTER (WHERE label = 1 AND {pred} = 0) AS fn, "
            f"count(*) FILTER (WHERE label = 0 AND {pred} = 0) AS tn FROM l1 WHERE {where})")


METRIC_SQL = (
    f"round({O.ratio('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, round({O.ratio('tp', 'tp + fp')}, 6) AS precision, "
    f"round({O.ratio('tp', 'tp + fn')}, 6) AS recall, round({O.ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1_score, "
    f"round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN ({O.ratio('tp', 'tp + fn')} + {O.ratio('tn', 'tn + fp')}) / 2 "
    f"ELSE 0.0 END, 6) AS auc_roc")


@register("validation_metrics", O.with_(*URL_MODEL_CTES, _val_sql("split = 'validation'")) +
          f"SELECT round(_loss, 6) AS val_loss, {METRIC_SQL}, tp, fp, fn, tn FROM v")
def q_validation_metrics(spark, sf):
    model, split = flows.train_layer1(fx.urls(spark, sf))
    return M.validation_metrics(M.score_layer1(split.where(F.col("split") == "validation"), model))


TEXT_TOK = f"ttok AS (SELECT row_id, text AS url, label, {O.whitespace_tokens('text')} AS tokens FROM texts)"
TEXT_MODEL_CTES = [O.TEXTS, TEXT_TOK, *O.split_ctes("ttok"), "train AS (SELECT * FROM split WHERE split = 'train')",
                   *O.nb_ctes("train"), *O.score_ctes("split")]


@register("text_validation_metrics", O.with_(*TEXT_MODEL_CTES, _val_sql("split = 'test'")) +
          f"SELECT round(_loss, 6) AS val_loss, {METRIC_SQL}, tp, fp, fn, tn FROM v")
def q_text_validation_metrics(spark, sf):
    """M1 + M2 + M5 over whole documents with a whitespace tokenizer, on the test split."""
    texts = flows.tokenized(fx.texts(spark, sf), "text", "whitespace").select("row_id", "label", "tokens")
    split = cut_lineage(P.stratified_split(texts))        # whole texts are tokenised once, then dropped
    model = M.train_token_weights(split.where(F.col("split") == "train"), min_freq=2)
    scored = M.score_layer1(split.where(F.col("split") == "test"), model, url=None)
    return M.validation_metrics(scored)


# ---------------------------------------------------------------- H1–H11
FLAG = O.url_cascade_ctes()
FLAG_COLS = O.FINAL_COLS.replace("layer1_confidence", "round(layer1_confidence, 6) AS layer1_confidence")


@register("cascade_predict", O.with_(*FLAG) + f"SELECT {FLAG_COLS}, label AS true_label FROM final")
def q_cascade_predict(spark, sf):
    return _rounded(flows.url_cascade(fx.urls(spark, sf), fx.rule_layer2))


@register("route_band", O.with_(O.SCORED) +
          f"SELECT row_id, url, layer1_confidence, coalesce({O.band('layer1_confidence')}, false) AS used_layer2 FROM scored")
def q_route_band(spark, sf):
    s = fx.scored(spark, sf)
    return s.select("row_id", "url", "layer1_confidence",
                    F.coalesce(H.route_band("layer1_confidence"), F.lit(False)).alias("used_layer2"))


FIX = O.fixture_cascade_ctes()


@register("triage_counts", O.with_(*FIX) + (
    "SELECT count(*) FILTER (WHERE NOT used_layer2 AND layer1_prediction = 0) AS definite_legitimate, "
    "count(*) FILTER (WHERE NOT used_layer2 AND layer1_prediction <> 0) AS definite_phishing, "
    "count(*) FILTER (WHERE used_layer2) AS suspicious FROM final_rt"))
def q_triage_counts(spark, sf):
    s = fx.scored(spark, sf).withColumn("layer1_prediction", (F.col("layer1_confidence") > 0.5).cast("int"))
    return H.triage_counts(H.route(s))


@register("layer2_worklist", O.with_(*FIX) + "SELECT url FROM final_wl")
def q_layer2_worklist(spark, sf):
    s = fx.scored(spark, sf).withColumn("layer1_prediction", (F.col("layer1_confidence") > 0.5).cast("int"))
    return H.layer2_worklist(H.route(s))


@register("extract_answer", O.with_(*FIX) + (
    f"SELECT url, {O.extract_answer(O.rule_response('url'))} AS answer FROM final_wl"))
def q_extract_answer(spark, sf):
    wl = q_layer2_worklist(spark, sf)
    return fx.rule_responses(wl).select("url", H.extract_answer("response").alias("answer"))


@register("parse_answer", O.with_(*FIX) + "SELECT url, layer2_prediction, layer2_explanation FROM final_l2")
def q_parse_answer(spark, sf):
    wl = q_layer2_worklist(spark, sf)
    return H.layer2_results(fx.rule_responses(wl)).select("url", "layer2_prediction", "layer2_explanation")


@register("layer2_error_rows", O.with_(*FIX) + (
    "SELECT url, CASE WHEN (" + O.hex16("md5(url)") + " % 2) = 0 THEN 0 ELSE " +
    O.parse_answer(O.extract_answer(O.rule_response("url"))) + " END AS layer2_prediction, "
    "CASE WHEN (" + O.hex16("md5(url)") + " % 2) = 0 THEN 'Error: scorer failed' ELSE " +
    O.extract_answer(O.rule_response("url")) + " END AS layer2_explanation, "
    "CASE WHEN (" + O.hex16("md5(url)") + " % 2) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS layer2_confidence FROM final_wl"))
def q_layer2_error_rows(spark, sf):
    """H6: half of the answers fail (even md5 prefix) and must become error rows."""
    wl = q_layer2_worklist(spark, sf)
    resp = fx.rule_responses(wl)
    fail = F.pmod(F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("int"), F.lit(2)) == 0
    resp = resp.withColumn("error", F.when(fail, F.lit("scorer failed")))
    return H.layer2_results(resp)


@register("layer2_unavailable", O.with_(*FIX) + (
    f"SELECT row_id, url, used_layer2, CASE WHEN used_layer2 THEN 0 ELSE layer1_prediction END AS final_prediction, "
    "CASE WHEN used_layer2 THEN 'Model not available' ELSE 'Not analyzed by Layer 2' END AS layer2_explanation, "
    "CASE WHEN used_layer2 THEN 'Phi3' ELSE 'BiGRU' END AS decision_maker FROM final_rt"))
def q_layer2_unavailable(spark, sf):
    f = flows.fixture_cascade(fx.scored(spark, sf), layer2_fn=None)
    return f.select("row_id", "url", "used_layer2", "final_prediction", "layer2_explanation", "decision_maker")


@register("fixture_cascade", O.with_(*FIX) + f"SELECT {O.FINAL_COLS}, true_label FROM final")
def q_fixture_cascade(spark, sf):
    return flows.fixture_cascade(fx.scored(spark, sf), fx.rule_layer2)


STATS_SQL = (
    "SELECT count(*) AS total_processed, count(*) FILTER (WHERE NOT used_layer2 AND layer1_prediction = 0) AS layer1_legitimate, "
    "count(*) FILTER (WHERE used_layer2) AS layer1_suspicious, count(*) FILTER (WHERE used_layer2) AS layer2_processed, "
    "count(*) FILTER (WHERE final_prediction = 1) AS final_phishing, count(*) FILTER (WHERE final_prediction <> 1) AS final_legitimate, "
    "(count(*) - count(*) FILTER (WHERE used_layer2)) * 100.0 / nullif(count(*), 0) AS efficiency_pct FROM final")


@register("cascade_stats", O.with_(*FIX) + STATS_SQL)
def q_cascade_stats(spark, sf):
    return H.cascade_stats(flows.fixture_cascade(fx.scored(spark, sf), fx.rule_layer2))


@register("standalone_stats", O.with_(*URL_MODEL_CTES) + (
    "SELECT count(*) AS total_processed, count(*) FILTER (WHERE layer1_prediction = 1) AS phishing_detected, "
    "count(*) FILTER (WHERE layer1_prediction <> 1) AS legitimate_detected FROM l1"))
def q_standalone_stats(spark, sf):
    model, split = flows.train_layer1(fx.urls(spark, sf))
    return H.standalone_stats(M.score_standalone(M.score_layer1(split, model)))


@register("result_listing", O.with_(*FLAG) + (
    "SELECT row_id, url, CASE WHEN final_prediction = 1 THEN '[PHISHING]' ELSE '[LEGITIMATE]' END AS status, "
    "decision_maker, round(layer1_confidence, 3) AS confidence, CASE WHEN used_layer2 THEN CASE WHEN "
    "length(layer2_explanation) > 100 THEN substr(layer2_explanation, 1, 100) || '...' ELSE layer2_explanation END "
    "END AS explanation FROM final"))
def q_result_listing(spark, sf):
    return H.result_listing(flows.url_cascade(fx.urls(spark, sf), fx.rule_layer2))


# ---------------------------------------------------------------- P1–P4

SCORED_LABELLED = "sl AS (SELECT row_id, url, true_label AS label FROM scored)"
BALANCED_SQL = (f"bs AS (SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY "
                f"{O.md5_key(42, 'row_id')}, row_id) AS _r FROM sl) WHERE _r <= 2000)")


def _scored_labelled(spark, sf):
    return fx.scored(spark, sf).select("row_id", "url", F.col("true_label").alias("label"))


@register("sample_n", O.with_(O.SCORED) +
          f"SELECT row_id, url, true_label FROM scored ORDER BY {O.md5_key(42, 'row_id')}, row_id LIMIT 10000")
def q_sample_n(spark, sf):
    return P.sample_n(fx.scored(spark, sf).select("row_id", "url", "true_label"), n=10_000)


@register("stratified_split", O.with_(O.SCORED, SCORED_LABELLED, *O.split_ctes("sl")) +
          "SELECT row_id, label, split FROM split")
def q_stratified_split(spark, sf):
    return P.stratified_split(_scored_labelled(spark, sf)).select("row_id", "label", "split")


@register("balanced_sample", O.with_(O.SCORED, SCORED_LABELLED, BALANCED_SQL) + (
    f"SELECT row_id, label, row_number() OVER (ORDER BY {O.md5_key(43, 'row_id')}, row_id) AS position FROM bs"))
def q_balanced_sample(spark, sf):
    return P.balanced_sample(_scored_labelled(spark, sf), per_class=2_000).select("row_id", "label", "position")


@register("sample_reduction", O.with_(O.SCORED, SCORED_LABELLED, BALANCED_SQL) + (
    "SELECT (SELECT count(*) FROM sl) AS original_rows, count(*) AS sampled_rows, "
    "count(*) FILTER (WHERE label = 1) AS sampled_positives, count(*) FILTER (WHERE label = 0) AS sampled_negatives, "
    "(1.0::DOUBLE - coalesce(CAST(count(*) AS DOUBLE) / nullif(CAST((SELECT count(*) FROM sl) AS DOUBLE), 0), 1.0)) "
    "* 100.0::DOUBLE AS reduction_pct FROM bs"))
def q_sample_reduction(spark, sf):
    sl = _scored_labelled(spark, sf)
    return P.sample_reduction(sl, P.balanced_sample(sl, per_class=2_000))


# ---------------------------------------------------------------- F1–F4

ALL_ROWS = "bs AS (SELECT * FROM sl)"
A_ROWS = ("arows AS (SELECT page_id AS row_id, url AS input, 'Decide if this is phishing and explain why.' AS instruction, "
          "CASE WHEN status = 'phishing' THEN 'Phishing: The URL ''' || url || ''' contains suspicious keywords or "
          "patterns typical for phishing attempts.' ELSE 'Legitimate: The URL ''' || url || ''' does not show common "
          "phishing indicators.' END AS output FROM raw_urls)")
B_ROWS = ("brows AS (SELECT row_id, url AS input, 'Analyze the following URL and determine if it is a phishing attempt "
          "or legitimate. Explain your reasoning.' AS instruction, CASE WHEN label = 1 THEN 'Phishing: This URL is "
          "classified as phishing based on its structure and characteristics.' ELSE 'Legitimate: This URL is "
          "classified as legitimate based on its structure and characteristics.' END AS output FROM bs)")


def _rendered_sql(src: str, out: str, url_prefix: bool) -> str:
    return (f"{out} AS (SELECT *, {O.prompt('instruction', 'input', url_prefix)} AS prompt, "
            f"output || '<|end|>' AS target FROM {src})")


def _rows_a(spark, sf):
    return PD.instruction_rows_a(fx.raw_urls(spark, sf).withColumnRenamed("page_id", "row_id"))


def _rows_b(spark, sf):
    return PD.instruction_rows_b(_scored_labelled(spark, sf))


@register("instruction_rows_a", O.with_(O.RAW_URLS, A_ROWS) + "SELECT row_id, input, instruction, output FROM arows")
def q_instruction_rows_a(spark, sf):
    return _rows_a(spark, sf)


@register("instruction_rows_b", O.with_(O.SCORED, SCORED_LABELLED, ALL_ROWS, B_ROWS) +
          "SELECT row_id, input, instruction, output FROM brows")
def q_instruction_rows_b(spark, sf):
    return _rows_b(spark, sf)


@register("render_prompt", O.with_(O.RAW_URLS, A_ROWS, _rendered_sql("arows", "ra", True)) +
          "SELECT row_id, prompt, target FROM ra")
def q_render_prompt(spark, sf):
    return PD.rendered(_rows_a(spark, sf)).select("row_id", "prompt", "target")


@register("render_conversation", (
    "SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' "
    "ORDER BY turn) AS text, count(*) AS turns FROM conversations GROUP BY conv_id"))
def q_render_conversation(spark, sf):
    return PD.render_conversation(fx.table(spark, sf, "conversations"))


def _pack_sql(rows: str, full_len: int, prompt_len: int, fast: bool) -> str:
    ws = O.whitespace_tokens
    parts = [
        f"ptok AS (SELECT row_id, {ws('prompt || target')} AS tokens, len({ws('prompt')}) AS plen FROM {rows})",
        "tc_ex AS (SELECT row_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM ptok)",
        "tc AS (SELECT token, count(*) AS cnt, min(struct_pack(r := row_id, p := pos)) AS f FROM tc_ex GROUP BY token)",
        "vocab AS (SELECT token, cnt, CAST(row_number() OVER (ORDER BY f.r, f.p) + 1 AS INTEGER) AS idx FROM tc "
        "WHERE cnt >= 2 AND token NOT IN ('<PAD>', '<UNK>'))",
        f"pex AS (SELECT row_id, unnest(list_slice(tokens, 1, {full_len})) AS token, "
        f"unnest(range(len(list_slice(tokens, 1, {full_len})))) AS pos FROM ptok)",
        "pids AS (SELECT e.row_id, list(coalesce(v.idx, 1) ORDER BY e.pos) AS ids FROM pex e "
        "LEFT JOIN vocab v ON e.token = v.token GROUP BY e.row_id)",
        f"pj AS (SELECT t.row_id, least(t.plen, {prompt_len}) AS p, coalesce(i.ids, CAST([] AS INTEGER[])) AS ids "
        f"FROM ptok t LEFT JOIN pids i ON t.row_id = i.row_id)",
        f"pk AS (SELECT row_id, p, ids, len(ids) AS n, list_concat(ids, list_resize(CAST([] AS INTEGER[]), "
        f"{full_len} - len(ids), 0)) AS input_ids FROM pj)",
    ]
    rep = lambda n, v: f"list_resize(CAST([] AS INTEGER[]), {n}, {v})"
    if fast:
        labels = f"list_concat({rep('p', -100)}, list_slice(input_ids, p + 1, {full_len}))"
    else:
        labels = (f"list_concat({rep('p', -100)}, CASE WHEN n > p THEN list_slice(ids, p + 1, n) "
                  f"ELSE CAST([] AS INTEGER[]) END, {rep(f'{full_len} - n', -100)})")
    attn = f"list_concat({rep('n', 1)}, {rep(f'{full_len} - n', 0)})"
    return ",\n".join(parts) + f"\nSELECT row_id, input_ids, {attn} AS attention_mask, {labels} AS labels FROM pk"


@register("pack_supervised", O.with_(O.RAW_URLS, A_ROWS, _rendered_sql("arows", "ra", True)).rstrip("\n") + ",\n" +
          _pack_sql("ra", 512, 384, False))
def q_pack_supervised(spark, sf):
    rows = cut_lineage(PD.rendered(_rows_a(spark, sf), url_prefix=True))   # read by vocab and packing
    return PD.pack_supervised(rows, PD.packing_vocab(rows))


@register("pack_supervised_fast", O.with_(O.SCORED, SCORED_LABELLED, ALL_ROWS, B_ROWS,
                                          _rendered_sql("brows", "rb", False)).rstrip("\n") + ",\n" +
          _pack_sql("rb", 256, 200, True))
def q_pack_supervised_fast(spark, sf):
    rows = cut_lineage(PD.rendered(_rows_b(spark, sf), url_prefix=False))  # read by vocab and packing
    return PD.pack_supervised(rows, PD.packing_vocab(rows), fast=True)


# ---------------------------------------------------------------- M1b
# Newton's steps as recursion: 30 of them, each over the distinct (log-odds, label) of the train split
LOGISTIC_CTES = [
    "zr AS (SELECT t.row_id, t.label, t.split, (SELECT bias FROM nb_b) + coalesce(s._s, 0.0) AS z FROM split t "
    "LEFT JOIN l1_s s ON t.row_id = s.row_id)",
    "zc AS (SELECT z, CAST(label AS DOUBLE) AS y, count(*) AS n FROM zr WHERE split = 'train' GROUP BY z, label)",
    "nt AS (SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL "
    "SELECT step + 1, a - (g1 * h00 - g0 * h10) / (h11 * h00 - h10 * h10), b - (g0 * h11 - g1 * h10) / (h11 * h00 - h10 * h10) FROM ("
    "SELECT step, a, b, sum(n * (p - y) * z) + a AS g1, sum(n * (p - y)) + b AS g0, sum(n * p * (1 - p) * z * z) + 1 AS h11, "
    "sum(n * p * (1 - p) * z) AS h10, sum(n * p * (1 - p)) + 1 AS h00 FROM ("
    "SELECT step, a, b, z, y, n, 1.0 / (1.0 + exp(-(a * z + b))) AS p FROM nt, zc WHERE step < 30) GROUP BY step, a, b))",
    "lr AS (SELECT row_id, label, 1.0 / (1.0 + exp(-((SELECT a FROM nt WHERE step = 30) * z + (SELECT b FROM nt WHERE step = 30)))) AS p "
    "FROM zr WHERE split = 'validation')"]


@register("train_logreg", O.with_(*URL_MODEL_CTES, *LOGISTIC_CTES).replace("WITH", "WITH RECURSIVE", 1) +
          "SELECT row_id, label, round(p, 6) AS layer1_confidence, CAST(p > 0.5 AS INTEGER) AS layer1_prediction FROM lr")
def q_train_logreg(spark, sf):
    """Logistic regression on vocabulary counts weighted by M1a, scored on validation."""
    model, split = flows.train_layer1(fx.urls(spark, sf))
    rows = cut_lineage(M.log_odds(split, model).select("row_id", "label", "split", "log_odds"))
    fitted = M.train_logistic(rows.where(F.col("split") == "train"))
    scored = M.score_logistic(rows.where(F.col("split") == "validation"), fitted)
    return _rounded(scored.select("row_id", "label", "layer1_confidence", "layer1_prediction"))


# ---------------------------------------------------------------- E1–E11


def _final_fixture(spark, sf):
    return flows.fixture_cascade(fx.scored(spark, sf), fx.rule_layer2)


def _cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def _cells(y: str, p: str, pre: str, guard: str = "true") -> str:
    return ", ".join([f"{_cnt(f'{guard} AND {y} = 1 AND {p} = 1')} AS {pre}tp",
                      f"{_cnt(f'{guard} AND {y} = 0 AND {p} = 1')} AS {pre}fp",
                      f"{_cnt(f'{guard} AND {y} = 1 AND {p} = 0')} AS {pre}fn",
                      f"{_cnt(f'{guard} AND {y} = 0 AND {p} = 0')} AS {pre}tn"])


EC = ("ec AS (SELECT count(*) AS total, " + _cells("true_label", "final_prediction", "h_") + ", "
      + _cells("true_label", "layer1_prediction", "l_") + ", "
      + _cells("true_label", "final_prediction", "s_", "used_layer2") + ", "
      + f"{_cnt('used_layer2 AND layer1_prediction = true_label')} AS s_l1_correct, {_cnt('used_layer2')} AS routed, "
      + f"{_cnt('used_layer2 AND layer1_prediction <> final_prediction AND final_prediction = true_label')} AS corrections, "
      + f"{_cnt('used_layer2 AND layer1_prediction <> final_prediction AND final_prediction <> true_label')} AS mistakes, "
      + f"{_cnt('true_label = 0')} AS y0, {_cnt('true_label = 1')} AS y1, {_cnt('final_prediction = 0')} AS f0, "
      + f"{_cnt('final_prediction = 1')} AS f1, {_cnt('layer1_prediction = 0')} AS p0, "
      + f"{_cnt('layer1_prediction = 1')} AS p1 FROM final)")
EVAL = [*O.fixture_cascade_ctes(), EC]


def _m(pre: str) -> dict[str, str]:
    tp, fp, fn, tn = (f"{pre}{c}" for c in ("tp", "fp", "fn", "tn"))
    rec = O.ratio(tp, f"{tp} + {fn}")
    return {"accuracy": O.ratio(f"{tp} + {tn}", f"{tp} + {fp} + {fn} + {tn}"),
            "precision": O.ratio(tp, f"{tp} + {fp}"), "recall": rec,
            "f1_score": O.ratio(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"),
            "auc_roc": f"(CASE WHEN {tp} + {fn} > 0 AND {tn} + {fp} > 0 THEN ({rec} + "
                       f"{O.ratio(tn, f'{tn} + {fp}')}) / 2 ELSE 0.0 END)"}


def _msel(pre: str) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in _m(pre).items()) + \
        ", " + ", ".join(f"{pre}{c} AS {c}" for c in ("tp", "fp", "fn", "tn"))


@register("metrics_overall", O.with_(*EVAL) + f"SELECT {_msel('h_')} FROM ec")
def q_metrics_overall(spark, sf):
    return E.metrics_overall(_final_fixture(spark, sf))


@register("metrics_layer1", O.with_(*EVAL) + f"SELECT {_msel('l_')} FROM ec")
def q_metrics_layer1(spark, sf):
    return E.metrics_layer1(_final_fixture(spark, sf))


@register("metrics_layer2_subset", O.with_(*EVAL) + (
    f"SELECT routed AS count, {O.ratio('s_tp + s_tn - s_l1_correct', 'routed')} AS accuracy_improvement, "
    f"{_m('s_')['precision']} AS precision_layer2, {_m('s_')['recall']} AS recall_layer2, "
    f"{_m('s_')['f1_score']} AS f1_layer2 FROM ec WHERE routed > 0"))
def q_metrics_layer2_subset(spark, sf):
    return E.metrics_layer2_subset(_final_fixture(spark, sf))


@register("metrics_efficiency", O.with_(*EVAL) + (
    "SELECT total AS total_samples, total - routed AS layer1_resolved, routed AS layer2_processed, "
    "(total - routed) * 100.0::DOUBLE / nullif(total, 0) AS efficiency_percentage, "
    "routed * 100.0::DOUBLE / nullif(total, 0) AS layer2_usage_percentage FROM ec"))
def q_metrics_efficiency(spark, sf):
    return E.metrics_efficiency(_final_fixture(spark, sf))


@register("metrics_improvement", O.with_(*EVAL) + "SELECT " + ", ".join(
    f"{_m('h_')[k]} - {_m('l_')[k]} AS {k}_improvement" for k in E.METRIC_NAMES) + " FROM ec")
def q_metrics_improvement(spark, sf):
    return E.metrics_improvement(_final_fixture(spark, sf))


@register("model_comparison", O.with_(*EVAL) + " UNION ALL ".join(
    f"SELECT '{k}' AS metric, {_m('l_')[k]} AS layer1, {_m('h_')[k]} AS hybrid, "
    f"{_m('h_')[k]} - {_m('l_')[k]} AS improvement FROM ec" for k in E.METRIC_NAMES))
def q_model_comparison(spark, sf):
    return E.model_comparison(_final_fixture(spark, sf))


@register("confusion_matrix", O.with_(*EVAL) + " UNION ALL ".join(
    f"SELECT '{m}' AS model, {a} AS actual, {p} AS predicted, {pre}{c} AS n FROM ec"
    for m, pre in (("layer1", "l_"), ("hybrid", "h_"))
    for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))))
def q_confusion_matrix(spark, sf):
    return E.confusion_matrix(_final_fixture(spark, sf))


@register("error_reduction", O.with_(*EVAL) + (
    "SELECT l_fp AS fp_layer1, h_fp AS fp_hybrid, l_fp - h_fp AS fp_reduction, "
    "(l_fp - h_fp) * 100.0::DOUBLE / greatest(l_fp, 1) AS fp_reduction_pct, l_fn AS fn_layer1, h_fn AS fn_hybrid, "
    "l_fn - h_fn AS fn_reduction, (l_fn - h_fn) * 100.0::DOUBLE / greatest(l_fn, 1) AS fn_reduction_pct FROM ec "
    "WHERE y0 + p0 > 0 AND y1 + p1 > 0 AND y0 + f0 > 0 AND y1 + f1 > 0"))
def q_error_reduction(spark, sf):
    return E.error_reduction(_final_fixture(spark, sf))


@register("layer2_effect", O.with_(*EVAL) + (
    "SELECT routed AS layer2_samples, corrections, mistakes, (corrections - mistakes) * 100.0::DOUBLE / routed "
    "AS net_improvement_pct FROM ec WHERE routed > 0"))
def q_layer2_effect(spark, sf):
    return E.layer2_effect(_final_fixture(spark, sf))


@register("layer2_examples", O.with_(*O.fixture_cascade_ctes()) + (
    "SELECT kind, CAST(rank AS INTEGER) AS rank, row_id, substr(url, 1, 60) || '...' AS url_head, "
    "CASE WHEN layer1_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS layer1, "
    "CASE WHEN final_prediction = 1 THEN 'Phishing' ELSE 'Legitimate' END AS layer2 FROM "
    "(SELECT *, CASE WHEN final_prediction = true_label THEN 'correction' ELSE 'mistake' END AS kind, "
    "row_number() OVER (PARTITION BY final_prediction = true_label ORDER BY row_id) AS rank FROM final "
    "WHERE used_layer2 AND layer1_prediction <> final_prediction) WHERE rank <= 3"))
def q_layer2_examples(spark, sf):
    return E.layer2_examples(_final_fixture(spark, sf))


def _report_sql() -> str:
    fixed = lambda x, k: f"floor(({x}) * {10.0**k} + 0.5) / {10.0**k}"
    f4, sgn = (lambda x: f"printf('%.4f', {fixed(x, 4)})"), (lambda x: f"printf('%+.4f', {fixed(x, 4)})")
    pct = lambda x: f"printf('%.1f', {fixed(f'{x} * 100.0::DOUBLE / nullif(total, 0)', 1)}) || '%'"
    text = lambda x: f"CAST({x} AS VARCHAR)"
    names = (("Accuracy:  ", "accuracy"), ("Precision: ", "precision"), ("Recall:    ", "recall"), ("F1-Score:  ", "f1_score"), ("AUC-ROC:   ", "auc_roc"))
    h, l1, s = _m("h_"), _m("l_"), _m("s_")
    gain = O.ratio("s_tp + s_tn - s_l1_correct", "routed")
    lines = [("CASCADE EVALUATION", None), ("-" * 40, None), ("FINAL DECISIONS", None), *((n, f4(h[k])) for n, k in names),
             ("LAYER 1 ALONE", None), *((n, f4(l1[k])) for n, k in names),
             ("ROWS GIVEN TO LAYER 2", None), ("Rows: ", text("routed")), ("Accuracy gained: ", sgn(gain)),
             ("Their precision: ", f4(s["precision"])), ("Their recall:    ", f4(s["recall"])), ("Their F1-score:  ", f4(s["f1_score"])),
             ("WORK", None), ("Rows in all: ", text("total")), ("Decided by layer 1: ", text("total - routed")), ("Given to layer 2: ", text("routed")),
             ("Share of layer 1: ", pct("(total - routed)")), ("Share of layer 2: ", pct("routed")),
             ("GAIN OVER LAYER 1", None), ("Accuracy: ", sgn(f"{h['accuracy']} - {l1['accuracy']}")),
             ("F1-score: ", sgn(f"{h['f1_score']} - {l1['f1_score']}"))]
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS line_no, '{head}'" + (f" || {value}" if value else "") + " AS line FROM ec"
        + (" WHERE routed > 0" if 14 <= i <= 19 else "") for i, (head, value) in enumerate(lines, 1))


@register("evaluation_report", O.with_(*EVAL) + _report_sql())
def q_evaluation_report(spark, sf):
    """The report lines."""
    return E.evaluation_report(_final_fixture(spark, sf))


# ---------------------------------------------------------------- V1–V4


@register("best_checkpoint", O.with_(O.HISTORY) + (
    "SELECT run_id, b.e AS best_epoch, b.l AS best_val_loss, epochs FROM (SELECT run_id, "
    "min(struct_pack(l := val_loss, e := epoch)) AS b, count(*) AS epochs FROM history GROUP BY run_id)"))
def q_best_checkpoint(spark, sf):
    return V.best_checkpoint(fx.history(spark, sf))


@register("early_stop", O.with_(
    O.HISTORY,
    "imp AS (SELECT run_id, epoch, (pb IS NULL OR val_loss < pb) AS improved FROM (SELECT *, min(val_loss) OVER "
    "(PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM history))",
    "win AS (SELECT run_id, epoch, count(*) FILTER (WHERE NOT improved) OVER w AS bad, count(*) OVER w AS n FROM imp "
    "WINDOW w AS (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))",
    "stops AS (SELECT run_id, min(epoch) AS stop_epoch FROM win WHERE n = 3 AND bad = 3 GROUP BY run_id)",
    "per AS (SELECT run_id, max(epoch) FILTER (WHERE improved) AS last_imp, count(*) AS epochs FROM imp GROUP BY run_id)")
    + ("SELECT p.run_id, s.stop_epoch, CAST(CASE WHEN s.stop_epoch IS NOT NULL THEN s.stop_epoch - 3 ELSE p.last_imp "
       "END AS INTEGER) AS best_epoch, CAST(coalesce(s.stop_epoch, p.epochs) AS INTEGER) AS epochs_trained "
       "FROM per p LEFT JOIN stops s ON p.run_id IS NOT DISTINCT FROM s.run_id"))
def q_early_stop(spark, sf):
    return V.early_stop(fx.history(spark, sf))


@register("early_stop_window", O.with_(
    O.HISTORY,
    "w AS (SELECT run_id, epoch, val_loss, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch "
    "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS wmin FROM history)",
    "t AS (SELECT run_id, min(epoch) AS trigger_epoch FROM w WHERE epoch > 3 AND val_loss > wmin GROUP BY run_id)")
    + ("SELECT r.run_id, CAST(t.trigger_epoch AS INTEGER) AS trigger_epoch FROM (SELECT DISTINCT run_id FROM history) r "
       "LEFT JOIN t ON r.run_id IS NOT DISTINCT FROM t.run_id"))
def q_early_stop_window(spark, sf):
    return V.early_stop_window(fx.history(spark, sf))


@register("log_rate", O.with_(
    O.HISTORY,
    "l AS (SELECT run_id, epoch, epoch_us(ts) AS now_us, lag(epoch_us(ts)) OVER (PARTITION BY run_id ORDER BY epoch) "
    "AS prev_us, count(*) OVER (PARTITION BY run_id) AS logs FROM history)",
    "r AS (SELECT *, 60.0::DOUBLE / nullif((now_us - prev_us) / 1e6, 0) * 50.0::DOUBLE AS spm FROM l)")
    + ("SELECT run_id, epoch, epoch * 50 AS global_step, spm AS steps_per_minute, "
       "CAST((logs - epoch) * 50 AS DOUBLE) / nullif(spm, 0) AS eta_minutes FROM r"))
def q_log_rate(spark, sf):
    return V.log_rate(fx.history(spark, sf))


@register("training_history", O.with_(O.HISTORY) + " UNION ALL ".join(
    f"SELECT run_id, epoch, '{m}' AS metric, {m} AS value FROM history" for m in ("train_loss", "val_loss", "accuracy")))
def q_training_history(spark, sf):
    return V.training_history(fx.history(spark, sf))


@register("training_estimate", O.with_(O.SCORED, SCORED_LABELLED, ALL_ROWS) + (
    "SELECT count(*) AS rows, CAST(floor(count(*) / 32) AS BIGINT) AS total_steps, "
    "CAST(floor(count(*) / 32) AS BIGINT) * 0.8::DOUBLE AS estimated_seconds, "
    "CAST(floor(count(*) / 32) AS BIGINT) * 0.8::DOUBLE / 3600.0::DOUBLE AS estimated_hours FROM bs"))
def q_training_estimate(spark, sf):
    return V.training_estimate(_scored_labelled(spark, sf))


# ---------------------------------------------------------------- B1–B5

BATCH_OUT = ("url, round(layer1_confidence, 6) AS layer1_confidence, layer1_prediction, used_layer2, final_prediction, layer2_explanation, "
             "decision_maker")


def _write_urls_csv(spark, sf) -> str:
    src = fresh_path(spark, "batch_input")
    fx.urls(spark, sf).select(F.col("row_id").alias("page_id"), "url", "label") \
        .write.option("header", True).csv(src)
    return src


@register("batch_job", O.with_(*FLAG) + (
    f"SELECT {BATCH_OUT}, row_id AS original_page_id, label AS original_label, label AS true_label, "
    "label = final_prediction AS correct_prediction FROM final"))
def q_batch_job(spark, sf):
    model, _ = flows.train_layer1(fx.urls(spark, sf))
    src = _write_urls_csv(spark, sf)
    _, res = J.batch_job(spark, src, model, "url", "label", fresh_path(spark, "batch_output"),
                         schema="page_id bigint, url string, label int", layer2_fn=fx.rule_layer2)
    return _rounded(res)


@register("batch_metrics", O.with_(*FLAG, (
    "bm AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = final_prediction) AS hit, "
    "count(*) FILTER (WHERE final_prediction = 1 AND label = 1) AS tp, count(*) FILTER (WHERE final_prediction = 1) AS pp, "
    "count(*) FILTER (WHERE label = 1) AS ap FROM final)"),
    "pr AS (SELECT *, tp / CAST(greatest(pp, 1) AS DOUBLE) AS p, tp / CAST(greatest(ap, 1) AS DOUBLE) AS r FROM bm)") + (
    "SELECT CAST(hit AS DOUBLE) / nullif(CAST(n AS DOUBLE), 0) AS accuracy, p AS precision, r AS recall, "
    "2.0::DOUBLE * p * r / greatest(p + r, 0.001::DOUBLE) AS f1_score FROM pr"))
def q_batch_metrics(spark, sf):
    u = fx.urls(spark, sf)
    model, _ = flows.train_layer1(u)
    final = J.with_truth(J.score_table(u.select(F.col("row_id").alias("page_id"), "url", "label"), model,
                                       layer2_fn=fx.rule_layer2), "label")
    return J.batch_metrics(final)


@register("url_list_job", O.with_(*FLAG) + f"SELECT {BATCH_OUT} FROM final")
def q_url_list_job(spark, sf):
    u = fx.urls(spark, sf)
    model, _ = flows.train_layer1(u)
    _, res = J.url_list_job(spark, u.select("url"), model, fresh_path(spark, "url_list_output"),
                            layer2_fn=fx.rule_layer2)
    return _rounded(res)


@register("standalone_job", O.with_(*URL_MODEL_CTES) + (
    "SELECT url, round(layer1_confidence, 6) AS confidence, layer1_prediction AS prediction, "
    "CASE WHEN layer1_error THEN 'error' WHEN layer1_prediction = 1 THEN 'phishing' ELSE 'legitimate' END AS status, "
    "row_id AS original_page_id FROM l1"))
def q_standalone_job(spark, sf):
    """Layer 1 alone as a job: score, write, count."""
    u = fx.urls(spark, sf)
    model, _ = flows.train_layer1(u)
    _, result, _ = J.standalone_job(spark, u.select(F.col("row_id").alias("page_id"), "url"), model, output_dir=fresh_path(spark, "standalone"))
    return _rounded(result, "confidence")


STRUCTURED = [O.URLS, f"tok AS (SELECT row_id, url, label, {O.t2('url')} AS tokens FROM urls)", *O.split_ctes("tok"),
              "train AS (SELECT * FROM split WHERE split = 'train')", *O.nb_ctes("train"), *O.cascade_ctes("l1")]


@register("saved_structured_model", O.with_(*STRUCTURED[:-len(O.cascade_ctes("l1"))], *O.score_ctes("tok"), *O.cascade_ctes("l1")) +
          "SELECT url, round(layer1_confidence, 6) AS layer1_confidence, used_layer2, final_prediction, row_id AS original_row_id FROM final")
def q_saved_structured_model(spark, sf):
    """A model of T2's tokens, saved and loaded again: the job scores with the tokenizer that was saved with it."""
    u = fx.urls(spark, sf)
    model, _ = flows.train_layer1(u, tok="structured")
    path = fresh_path(spark, "structured_model")
    J.save_model(model, path)
    final = J.score_table(u.select("row_id", "url"), J.load_model(spark, path), layer2_fn=fx.rule_layer2)
    return _rounded(final.select("url", "layer1_confidence", "used_layer2", "final_prediction", "original_row_id"))


def _sim_sql(seed: int = 42) -> str:
    def u(j):
        return f"(CAST('0x' || substr(md5('{seed}|' || CAST(row_id AS VARCHAR) || '|{j}'), 1, 4) AS INTEGER) / 65536.0::DOUBLE)"
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    lo = {k: d(v[0]) for k, v in J.SIM_RANGES.items()}
    wd = {k: d(v[1] - v[0]) for k, v in J.SIM_RANGES.items()}
    conf = (f"CASE WHEN label = 0 AND {u(1)} < {d(J.SIM_L1_FP_RATE)} THEN {lo['fp']} + {wd['fp']} * {u(2)} "
            f"WHEN label = 0 THEN {lo['tn']} + {wd['tn']} * {u(2)} "
            f"WHEN {u(1)} < {d(J.SIM_L1_FN_RATE)} THEN {lo['fn']} + {wd['fn']} * {u(2)} "
            f"ELSE {lo['tp']} + {wd['tp']} * {u(2)} END")
    pred = (f"CASE WHEN label = 0 THEN CASE WHEN {u(1)} < {d(J.SIM_L1_FP_RATE)} THEN 1 ELSE 0 END "
            f"ELSE CASE WHEN {u(1)} < {d(J.SIM_L1_FN_RATE)} THEN 0 ELSE 1 END END")
    l2 = (f"CASE WHEN label = 0 THEN CASE WHEN {u(3)} < {d(J.SIM_L2_FP_RATE)} THEN 1 ELSE 0 END "
          f"ELSE CASE WHEN {u(3)} < {d(J.SIM_L2_FN_RATE)} THEN 0 ELSE 1 END END")
    return (f"sim AS (SELECT row_id, url, label AS true_label, {conf} AS layer1_confidence, {pred} AS layer1_prediction, "
            f"{l2} AS _l2 FROM urls), sim2 AS (SELECT *, layer1_confidence > {d(J.SIM_BAND[0])} AND "
            f"layer1_confidence < {d(J.SIM_BAND[1])} AS used_layer2 FROM sim)")


@register("simulate_scored", O.with_(O.URLS, _sim_sql()) + (
    "SELECT row_id, url, true_label, layer1_confidence, layer1_prediction, used_layer2, "
    "CASE WHEN used_layer2 THEN _l2 ELSE layer1_prediction END AS final_prediction, "
    "CASE WHEN used_layer2 THEN 'Phi3' ELSE 'BiGRU' END AS decision_maker FROM sim2"))
def q_simulate_scored(spark, sf):
    return J.simulate_scored(fx.urls(spark, sf))


# ---------------------------------------------------------------- S1–S5
@register("csv_scan", O.with_(O.URLS) + "SELECT row_id, url, label FROM urls")
def q_csv_scan(spark, sf):
    path = fresh_path(spark, "csv_scan")
    fx.urls(spark, sf).write.option("header", True).csv(path)
    return S.read_csv(spark, path, "row_id bigint, url string, label int")


@register("json_scan", O.with_(O.URLS) + "SELECT row_id, url AS text, label FROM urls")
def q_json_scan(spark, sf):
    path = fresh_path(spark, "json_scan")
    fx.urls(spark, sf).select("row_id", F.col("url").alias("text"), "label").write.json(path)
    return S.read_json_records(spark, path, "row_id bigint, text string, label int", array_file=False)


_NA_SQL = "(" + ", ".join("'" + t + "'" for t in S.NA_TOKENS) + ")"


@register("csv_multiline_scan", (
    f"SELECT doc_id, CASE WHEN text NOT IN {_NA_SQL} THEN text END AS text, n_chars, "
    f"CASE WHEN source NOT IN {_NA_SQL} THEN source END AS source FROM documents"))
def q_csv_multiline_scan(spark, sf):
    """Whole documents, with their line breaks and quotes, in CSV files written by many tasks, each read by many tasks."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", "n_chars", "source")
    path = S.write_results(docs, fresh_path(spark, "csv_multiline_scan"), "documents")
    return S.read_csv(spark, path, "doc_id bigint, text string, n_chars bigint, source string")


@register("json_array_scan", (
    "SELECT CASE WHEN doc_id % 3 <> 0 THEN doc_id ELSE -1 END AS row_id, text, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS label "
    "FROM documents"))
def q_json_array_scan(spark, sf):
    """JSON arrays of records, a third of them without an id, in files written by many tasks, each read by many tasks."""
    d = fx.table(spark, sf, "documents")
    records = d.select(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("row_id"), "text",
                       F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("label"))
    path = S.write_json_arrays(records, fresh_path(spark, "json_array_scan"))
    read = S.read_json_records(spark, path, "row_id bigint, text string, label int").where("label is not null")
    return read.withColumn("row_id", F.coalesce("row_id", F.lit(-1)))      # -1: the record has none


@register("csv_sink", O.with_(*FLAG) + f"SELECT {FLAG_COLS}, label AS true_label FROM final")
def q_csv_sink(spark, sf):
    final = flows.url_cascade(fx.urls(spark, sf), fx.rule_layer2)
    path = S.write_results(final, fresh_path(spark, "csv_sink"), prefix="hybrid_detection_results")
    return _rounded(S.read_back(spark, path, final.schema))


_JSON_GROUPS = {"overall": "metrics_overall", "layer1_only": "metrics_layer1", "layer2_samples": "metrics_layer2_subset",
                "efficiency": "metrics_efficiency"}


@register("metrics_json", " UNION ALL ".join(
    f"SELECT '{g}' AS grp, metric, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM ({SQL[k]})) ON COLUMNS(*) INTO NAME metric VALUE value)"
    for g, k in _JSON_GROUPS.items()))
def q_metrics_json(spark, sf):
    """The nested evaluation report, written as JSON text, read back and parsed."""
    final = _final_fixture(spark, sf)
    groups = {"overall": E.metrics_overall(final), "layer1_only": E.metrics_layer1(final),
              "layer2_samples": E.metrics_layer2_subset(final), "efficiency": E.metrics_efficiency(final)}
    return S.read_metrics_json(spark, S.write_metrics_json(groups, fresh_path(spark, "metrics_json")))


@register("evaluation_job", SQL["metrics_json"])
def q_evaluation_job(spark, sf):
    """Evaluation of a saved result file: the cascade's CSV is read back and reported on."""
    path = S.write_results(_final_fixture(spark, sf), fresh_path(spark, "evaluation_input"))
    return J.evaluation_job(spark, path, fresh_path(spark, "evaluation_output"))[1]


# ---------------------------------------------------------------- X1, X2, U1


def _run_stream_cascade(spark, sf) -> str:
    out = fresh_path(spark, "stream_cascade")
    stream = X.scored_stream(spark, f"{sf.rstrip('/')}/orders*.parquet", schema=fx.table(spark, sf, "orders").schema)
    X.stream_cascade(stream, fx.rule_layer2, out, fresh_path(spark, "stream_cascade_ckpt"))
    return out


@register("stream_cascade", O.with_(*FIX) + f"SELECT {O.FINAL_COLS}, true_label FROM final")
def q_stream_cascade(spark, sf):
    out = _run_stream_cascade(spark, sf)
    return spark.read.schema(X.FINAL_SCHEMA).parquet(out).select("row_id", *H.FINAL_COLUMNS, "true_label")


@register("stream_cascade_stats", O.with_(*FIX) + STATS_SQL)
def q_stream_cascade_stats(spark, sf):
    out = _run_stream_cascade(spark, sf)
    stats = fresh_path(spark, "stream_stats")
    X.stream_stats(X.final_stream(spark, out), stats, fresh_path(spark, "stream_stats_ckpt"))
    return X.with_efficiency(spark.read.parquet(stats))


@register("plugin_scorer", O.with_(*FIX) + (
    "SELECT url, layer2_prediction, layer2_explanation, 1.0::DOUBLE AS layer2_confidence FROM final_l2"))
def q_plugin_scorer(spark, sf):
    s = fx.scored(spark, sf).withColumn("layer1_prediction", (F.col("layer1_confidence") > 0.5).cast("int"))
    wl = H.layer2_worklist(H.route(s))
    return H.layer2_results(H.plugin_responses(wl, fx.RuleScorer()))


# ---------------------------------------------------------------- training path
def _val_grouped_sql(where: str) -> str:
    clamp = lambda p: f"(CASE WHEN {p} <= 0 THEN -100.0 ELSE greatest(ln({p}), -100.0) END)"
    loss = (f"-(CAST(label AS DOUBLE) * {clamp('layer1_confidence')} + (1.0 - CAST(label AS DOUBLE)) * "
            f"{clamp('1.0 - layer1_confidence')})")
    pred = "CAST(layer1_confidence > 0.5 AS INTEGER)"
    return (f"v AS (SELECT split, avg({loss}) AS _loss, count(*) FILTER (WHERE label = 1 AND {pred} = 1) AS tp, "
            f"count(*) FILTER (WHERE label = 0 AND {pred} = 1) AS fp, count(*) FILTER (WHERE label = 1 AND {pred} = 0) AS fn, "
            f"count(*) FILTER (WHERE label = 0 AND {pred} = 0) AS tn FROM l1 WHERE {where} GROUP BY split)")


TRAIN_JOB_CTES = [
    O.RAW_URLS,
    "lab AS (SELECT page_id AS row_id, url, CASE status WHEN 'legitimate' THEN 0 WHEN 'phishing' THEN 1 END AS label "
    "FROM raw_urls WHERE url IS NOT NULL AND status IS NOT NULL)",
    f"tok AS (SELECT row_id, url, label, {O.t1('url')} AS tokens FROM lab)", *O.split_ctes("tok"),
    # the sample that fits the weights is the feature here: at most 100,000 rows of the train split
    f"train AS (SELECT * FROM split WHERE split = 'train' ORDER BY {O.md5_key(42, 'row_id')}, row_id LIMIT 100000)",
    *O.nb_ctes("train"), *O.score_ctes("split"), _val_grouped_sql("split <> 'train'")]


@register("training_job", O.with_(*TRAIN_JOB_CTES) +
          f"SELECT split, round(_loss, 6) AS val_loss, {METRIC_SQL}, tp, fp, fn, tn FROM v")
def q_training_job(spark, sf):
    """C1-C3 -> P2 -> T4 -> T8 -> P1 (fit rows) -> M1 -> M5 on validation and test, model saved."""
    raw = fx.raw_urls(spark, sf).withColumnRenamed("page_id", "row_id")
    _, metrics = J.training_job(raw, fresh_path(spark, "training_job"))
    return metrics


# ---------------------------------------------------------------- tuning-data path
JSON_ROWS = ("jrows AS (SELECT row_id, url, label FROM urls WHERE row_id IS NOT NULL AND url IS NOT NULL "
             "AND label IS NOT NULL)")
JSON_BALANCED = (f"bs AS (SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY "
                 f"{O.md5_key(42, 'row_id')}, row_id) AS _r FROM jrows) WHERE _r <= 2000)")


@register("instruction_data_job", O.with_(O.URLS, JSON_ROWS, JSON_BALANCED, B_ROWS,
                                          _rendered_sql("brows", "rb", False)).rstrip("\n") + ",\n" +
          _pack_sql("rb", 256, 200, True))
def q_instruction_data_job(spark, sf):
    """S2 -> C2 -> P3 -> F2 -> F3 -> F4 -> parquet over the pages urls written as JSON records."""
    src = fresh_path(spark, "json_records")
    fx.urls(spark, sf).select("row_id", F.col("url").alias("text"), "label").write.json(src)
    out = J.instruction_data_job(spark, src, fresh_path(spark, "instruction_data"))
    return out.select("row_id", "input_ids", "attention_mask", "labels")


@register("stream_cascade_urls", O.with_(*FLAG) + f"SELECT {FLAG_COLS}, label AS true_label FROM final")
def q_stream_cascade_urls(spark, sf):
    """X2 from raw urls: arriving pages are scored in the stream with saved weights and joined to saved answers."""
    u = fx.urls(spark, sf)
    model, _ = flows.train_layer1(u)
    answers = cut_lineage(fx.rule_layer2(u.select("url").distinct()))
    pages = spark.readStream.schema(fx.table(spark, sf, "pages").schema).parquet(f"{sf.rstrip('/')}/pages*.parquet")
    stream = fx.urls_of(pages)
    out = fresh_path(spark, "stream_urls")
    X.stream_url_cascade(stream, model, answers, out, fresh_path(spark, "stream_urls_ckpt"), keep=("row_id", "label"))
    return _rounded(spark.read.parquet(out).withColumnRenamed("label", "true_label").select("row_id", *H.FINAL_COLUMNS, "true_label"))


@register("stream_cascade_static", O.with_(*FIX) + f"SELECT {O.FINAL_COLS}, true_label FROM final")
def q_stream_cascade_static(spark, sf):
    """X2 as a stream-static join with layer-2 answers saved ahead of the stream."""
    s = fx.scored(spark, sf).withColumn("layer1_prediction", (F.col("layer1_confidence") > 0.5).cast("int"))
    answers = cut_lineage(fx.rule_layer2(H.layer2_worklist(H.route(s))))
    out = fresh_path(spark, "stream_static")
    stream = X.scored_stream(spark, f"{sf.rstrip('/')}/orders*.parquet", schema=fx.table(spark, sf, "orders").schema)
    X.stream_cascade_static(stream, answers, out, fresh_path(spark, "stream_static_ckpt"))
    return spark.read.parquet(out)
