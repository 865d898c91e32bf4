"""Token frequencies, vocabulary, encoding, masks, decoding.

The vocabulary is a DataFrame ``token, cnt, idx`` (idx >= 2); ids 0 and 1 are
the reserved padding and unknown ids and never appear in it.  Lookups
run inside the row (see ``lookup``): nothing is exploded, shuffled or regrouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import tokenizer
from ..session import cut_lineage
from .lookup import lookup
from .ranking import distributed_rank, quantile_cells

# Fixed values.
PAD_ID, UNK_ID = 0, 1
PAD_TOKEN, UNK_TOKEN = "<PAD>", "<UNK>"
FIRST_ID = 2
DEFAULT_MAX_LEN = 200
DEFAULT_MIN_FREQ = 2


def with_tokens(df: DataFrame, text_col: str = "url", tok="url", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokenizer(tok)(F.col(text_col)))


def exploded_tokens(df: DataFrame, row_id: str = "row_id", tokens: str = "tokens") -> DataFrame:
    """(row_id, pos, token) for every token; rows with a null array give none."""
    return df.select(row_id, F.posexplode(tokens).alias("pos", "token"))


POS_BITS = 20                 # packed first-occurrence key: row_id << 20 | pos
MAX_PACKED_ROW = 1 << (63 - POS_BITS)


def token_counts(df: DataFrame, row_id: str = "row_id", tokens: str = "tokens",
                 materialize: bool = True) -> DataFrame:
    """Token, cnt, first occurrence (first_row, first_pos).

    The first occurrence is the minimum of ``row_id << 20 | pos``, a long, so
    the whole count is one hash aggregate with map-side partials (a token in
    every row costs one partial row per task).  The packing is exact while
    row ids lie in [0, 2^43) and positions below 2^20; that is checked on the
    materialised per-token table, and any other input takes the exact
    (sort-based) struct minimum instead."""
    ex = exploded_tokens(df, row_id, tokens)
    packed = F.shiftleft(F.col(row_id).cast("long"), POS_BITS) + F.col("pos")
    agg = ex.groupBy("token").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(packed).alias("_k"),
        F.min(row_id).alias("_rmin"), F.max(row_id).alias("_rmax"), F.max("pos").alias("_pmax"))
    if materialize:
        agg = cut_lineage(agg)
        g = agg.agg(F.min("_rmin"), F.max("_rmax"), F.max("_pmax")).first()
        exact = g[0] is None or (g[0] >= 0 and g[1] < MAX_PACKED_ROW and g[2] < (1 << POS_BITS))
        if exact:
            return agg.select("token", "cnt", F.shiftright("_k", POS_BITS).cast(df.schema[row_id].dataType)
                              .alias("first_row"),
                              (F.col("_k").bitwiseAND((1 << POS_BITS) - 1)).cast("int").alias("first_pos"))
    slow = ex.groupBy("token").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min(F.struct(F.col(row_id).alias("r"), F.col("pos").alias("p"))).alias("first"))
    return slow.select("token", "cnt", F.col("first.r").alias("first_row"), F.col("first.p").alias("first_pos"))


def build_vocab(counts: DataFrame, min_freq: int = DEFAULT_MIN_FREQ, materialize: bool = True) -> DataFrame:
    """T4: tokens with cnt >= min_freq, ids from 2 in order of first occurrence.

    The rank runs in cells of about equal counts along the first occurrence
    (see ranking), not as one unpartitioned window."""
    kept = counts.where((F.col("cnt") >= min_freq) & ~F.col("token").isin(PAD_TOKEN, UNK_TOKEN))
    celled = quantile_cells(kept, "first_row", tie="first_pos", out="_cell")
    ranked = distributed_rank(celled, ["first_row", "first_pos"], F.col("_cell"), rank_col="_r")
    vocab = ranked.select("token", "cnt", (F.col("_r") + (FIRST_ID - 1)).cast("int").alias("idx"))
    # read by every encode / decode job: compute once, cut the lineage
    return cut_lineage(vocab) if materialize else vocab


def pad_to(ids: Column, length: int, fill: int = PAD_ID) -> Column:
    """Truncate to ``length`` or right-pad with ``fill``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill), length)), 1, length)


def token_ids(df: DataFrame, vocab: DataFrame, tokens: str = "tokens", max_tokens: int | None = None,
              out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids of each row's tokens, unknown -> 1 (an empty array for a row
    without tokens).  Tokens past ``max_tokens`` are cut before the lookup."""
    toks = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    if max_tokens is not None:
        toks = F.slice(toks, 1, max_tokens)
    return lookup(df, vocab, "token", "idx", toks, out, UNK_ID)


def encode(df: DataFrame, vocab: DataFrame, max_len: int = DEFAULT_MAX_LEN, row_id: str = "row_id",
           tokens: str = "tokens", out: str = "sequence") -> DataFrame:
    """T5: fixed-length id array for every row of ``df``; the token array is
    replaced by the id array, other columns are kept.  Rows do not move, and
    rows with equal ids stay rows of their own."""
    ids = token_ids(df, vocab, tokens, max_len, out)
    return ids.withColumn(out, pad_to(F.col(out), max_len)).drop(tokens)


def attention_mask(seq) -> Column:
    """1 where the id is not padding."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.transform(s, lambda x: F.when(x != PAD_ID, 1).otherwise(0))


def decode(df: DataFrame, vocab: DataFrame, row_id: str = "row_id", seq: str = "sequence",
           out: str = "decoded") -> DataFrame:
    """Ids back to tokens through the inverse vocabulary; padding dropped,
    unknown ids as ``<UNK>``.  The id array is replaced by the token array;
    rows do not move."""
    ids = F.filter(F.coalesce(F.col(seq), F.array().cast("array<int>")), lambda x: x.isNotNull() & (x != PAD_ID))
    return lookup(df, vocab, "idx", "token", ids, out, UNK_TOKEN, "string").drop(seq)


def model_ready(df: DataFrame, vocab: DataFrame, max_len: int = DEFAULT_MAX_LEN,
                row_id: str = "row_id", extra: Sequence[str] = ("split",)) -> DataFrame:
    """Sequence, mask, label (double) per row."""
    enc = encode(df, vocab, max_len, row_id)
    cols = [row_id, *[c for c in extra if c in df.columns]]
    return enc.select(*cols, "sequence", attention_mask("sequence").alias("mask"),
                      F.col("label").cast("double").alias("label"))


def write_training_table(df: DataFrame, path: str) -> DataFrame:
    """T8 sink: parquet partitioned by split, read back for the trainer."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)
    return df.sparkSession.read.parquet(path)
