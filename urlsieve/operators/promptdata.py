"""Instruction rows, chat rendering and supervised packing for tuning a
language model as layer 2 (F1–F4).

Strings are built with ``concat`` (never ``format_string``: urls hold ``%``).
Token ids come from a vocabulary built with T4 over whitespace tokens; a
subword tokenizer would plug in as a scorer-style ``mapInPandas`` stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import whitespace_tokens
from .cascade import DEFAULT_INSTRUCTION, render_prompt
from .tokens import PAD_ID, build_vocab, token_counts, token_ids

# Instruction texts and answer templates.
INSTRUCTION_A = DEFAULT_INSTRUCTION
OUTPUT_A_PHISHING = ("Phishing: The URL '", "' contains suspicious keywords or patterns typical for phishing attempts.")
OUTPUT_A_LEGITIMATE = ("Legitimate: The URL '", "' does not show common phishing indicators.")
INSTRUCTION_B = ("Analyze the following URL and determine if it is a phishing attempt or legitimate. "
                 "Explain your reasoning.")
OUTPUT_B = ": This URL is classified as {} based on its structure and characteristics."
END_TAG = "<|end|>"
IGNORE_ID = -100
# Packing lengths (full text / prompt) of the two variants.
STANDARD_LEN, STANDARD_PROMPT_LEN = 512, 384
FAST_LEN, FAST_PROMPT_LEN = 256, 200
TURN_BLOCK = 1024


def instruction_rows_a(df: DataFrame, url: str = "url", status: str = "status",
                       keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """label text exactly ``phishing`` -> the phishing answer, anything
    else -> the legitimate answer."""
    u = F.col(url)
    out = (F.when(F.col(status) == "phishing",
                  F.concat(F.lit(OUTPUT_A_PHISHING[0]), u, F.lit(OUTPUT_A_PHISHING[1])))
           .otherwise(F.concat(F.lit(OUTPUT_A_LEGITIMATE[0]), u, F.lit(OUTPUT_A_LEGITIMATE[1]))))
    return df.select(*keep, u.alias("input"), F.lit(INSTRUCTION_A).alias("instruction"), out.alias("output"))


def instruction_rows_b(df: DataFrame, url: str = "url", label: str = "label",
                       keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """label 1 -> ``Phishing: … classified as phishing …``, else Legitimate."""
    name = F.when(F.col(label) == 1, F.lit("Phishing")).otherwise(F.lit("Legitimate"))
    tail = F.when(F.col(label) == 1, F.lit(OUTPUT_B.format("phishing"))) \
        .otherwise(F.lit(OUTPUT_B.format("legitimate")))
    return df.select(*keep, F.col(url).alias("input"), F.lit(INSTRUCTION_B).alias("instruction"),
                     F.concat(name, tail).alias("output"))


def rendered(rows: DataFrame, url_prefix: bool = True) -> DataFrame:
    """prompt = chat template of instruction + input; target = output + end tag."""
    return rows.withColumn("prompt", render_prompt(F.col("instruction"), F.col("input"), url_prefix)) \
               .withColumn("target", F.concat(F.col("output"), F.lit(END_TAG)))


def render_conversation(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                        block: int = TURN_BLOCK) -> DataFrame:
    """F3, multi-turn: ``<|role|>\\ntext<|end|>\\n`` per turn in turn order.

    Two-level: turns are first joined inside (conversation, turn block), so a
    conversation with a huge number of turns is concatenated by many tasks;
    the second level joins at most turns/block pieces."""
    piece = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.coalesce(F.col("text"), F.lit("")),
                     F.lit(END_TAG + "\n"))
    t = conv.select(conv_id, turn, piece.alias("_p")).withColumn("_blk", F.floor(F.col(turn) / block))
    lvl1 = t.groupBy(conv_id, "_blk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "_p"))), lambda x: x["_p"]), "")
        .alias("_p"), F.count(F.lit(1)).alias("_n"))
    lvl2 = lvl1.groupBy(conv_id).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_blk", "_p"))), lambda x: x["_p"]), "")
        .alias("text"), F.sum("_n").alias("turns"))
    return lvl2


def packing_vocab(rows: DataFrame, min_freq: int = 2, row_id: str = "row_id") -> DataFrame:
    """Vocabulary of the full training texts (prompt + target)."""
    toks = rows.select(row_id, whitespace_tokens(F.concat("prompt", "target")).alias("tokens"))
    return build_vocab(token_counts(toks, row_id), min_freq)


def _ones(n: Column, v: int) -> Column:
    return F.array_repeat(F.lit(v), n)


def pack_supervised(rows: DataFrame, vocab: DataFrame, row_id: str = "row_id", fast: bool = False) -> DataFrame:
    """input_ids, attention_mask, labels with the prompt masked (-100).

    standard: full ids cut at 512, prompt at 384; labels = -100 x prompt
    length + answer ids; padding gets pad id / 0 / -100.
    fast: full ids cut and padded to 256 first, prompt cut at 200; labels =
    -100 x prompt length + the padded ids after it (pad ids stay), 256 long.
    """
    full_len, prompt_len = (FAST_LEN, FAST_PROMPT_LEN) if fast else (STANDARD_LEN, STANDARD_PROMPT_LEN)
    toks = rows.select(row_id, whitespace_tokens(F.concat("prompt", "target")).alias("tokens"),
                       F.size(whitespace_tokens("prompt")).alias("_plen"))
    j = token_ids(toks, vocab, max_tokens=full_len)
    n = F.size("ids")
    p = F.least(F.col("_plen"), F.lit(prompt_len))
    pad = full_len - n
    padded = F.concat(F.col("ids"), _ones(pad, PAD_ID))
    attn = F.concat(_ones(n, 1), _ones(pad, 0))
    if fast:
        labels = F.concat(_ones(p, IGNORE_ID), F.slice(padded, p + 1, full_len))
        labels = F.slice(F.concat(labels, _ones(F.lit(full_len) - F.size(labels), IGNORE_ID)), 1, full_len)
    else:
        answer = F.when(n > p, F.slice(F.col("ids"), p + 1, full_len)).otherwise(F.array().cast("array<int>"))
        labels = F.concat(_ones(p, IGNORE_ID), answer, _ones(pad, IGNORE_ID))
    return j.select(row_id, padded.alias("input_ids"), attn.alias("attention_mask"), labels.alias("labels"))
