"""Vocabulary goldens, encoding, masks, decoding, distributed ranks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from urlsieve.operators import tokens as T
from urlsieve.operators.ranking import distributed_rank, hash_bucket, md5_order_key, quantile_cells, running_agg
from urlsieve.plans import flows

SEED_A = ["http://maple.org", "https://cedar.org", "http://plum-shop.org", "https://fern-coop.org", "http://willow.page"]
SEED_B = SEED_A + ["https://larch.org", "http://thorny.shop", "https://hazel.org", "http://mock-coop.test"]


def _urls(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "row_id bigint, url string")
    return flows.tokenized(df)


def _vocab(spark, urls, min_freq=2):
    v = T.build_vocab(T.token_counts(_urls(spark, urls)), min_freq)
    return {r.token: r.idx for r in v.collect()}


def test_vocab_seed_a(spark):
    v = _vocab(spark, SEED_A)
    assert v == {"org": 2}
    assert len(v) + 2 == 3


def test_vocab_seed_b(spark):
    v = _vocab(spark, SEED_B)
    assert v == {"org": 2, "shop": 3, "coop": 4}


def test_encode_pad_truncate_and_mask(spark):
    df = _urls(spark, SEED_B + [None, "http://org.org.org.org.org"])
    vocab = T.build_vocab(T.token_counts(df))
    enc = T.encode(df, vocab, max_len=4).withColumn("mask", T.attention_mask("sequence"))
    rows = {r.row_id: r for r in enc.collect()}
    assert rows[2].sequence == [1, 3, 2, 0]          # plum(unk) shop org pad
    assert rows[2].mask == [1, 1, 1, 0]
    assert rows[9].sequence == [0, 0, 0, 0]          # null url -> all padding
    assert rows[10].sequence == [2, 2, 2, 2]         # truncated to 4
    assert all(len(r.sequence) == 4 for r in rows.values())


def test_decode_inverts_encode_in_vocabulary(spark):
    df = _urls(spark, SEED_B)
    vocab = T.build_vocab(T.token_counts(df), min_freq=1)
    enc = T.encode(df, vocab, max_len=10)
    assert "tokens" not in enc.columns
    dec = T.decode(enc, vocab).join(df.select("row_id", "tokens"), "row_id")
    for r in dec.collect():
        assert r.decoded == r.tokens


def test_distributed_rank_equals_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("row_id"),
                                     (F.col("id") % 3 == 0).cast("int").alias("label"))
    keyed = df.withColumn("_k", md5_order_key(42, "row_id"))
    got = distributed_rank(keyed, ["_k", "row_id"], hash_bucket(F.col("_k"), 2), partition_by=["label"])
    want = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("_k", "row_id")))
    assert got.select("row_id", "rank").exceptAll(want.select("row_id", "rank")).count() == 0
    assert got.count() == 5000


def test_quantile_cells_rank_with_hot_key(spark):
    # one partition value holds a third of the rows
    df = spark.range(0, 3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("g"),
                                     ((F.col("id") * 37) % 1000).alias("v"))
    got = distributed_rank(quantile_cells(df, "v", "id", ["g"], 16, "cell"), ["v", "id"], F.col("cell"), partition_by=["g"])
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert got.select("id", "rank").exceptAll(want.select("id", "rank")).count() == 0


def test_running_min_equals_window(spark):
    df = spark.range(0, 2000).select((F.col("id") % 4).alias("run"), (F.col("id") / 4).cast("int").alias("epoch"),
                                     ((F.col("id") * 7919) % 101).cast("double").alias("loss"))
    got = running_agg(quantile_cells(df, "epoch", cells=8, out="cell"), ["run"], ["epoch"], F.col("cell"), "loss", "min", "rm")
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("rm", F.min("loss").over(w))
    assert got.select("run", "epoch", "rm").exceptAll(want.select("run", "epoch", "rm")).count() == 0


def test_token_counts_fallback_for_unpackable_row_ids(spark):
    urls = SEED_B
    small = _urls(spark, urls)
    big = spark.createDataFrame([((i - 3) * (1 << 50), u) for i, u in enumerate(urls)], "row_id bigint, url string")
    big = flows.tokenized(big)
    a = {r.token: (r.cnt, r.first_pos) for r in T.token_counts(small).collect()}
    b_rows = T.token_counts(big).collect()
    b = {r.token: (r.cnt, r.first_pos) for r in b_rows}
    assert a == b
    first = {r.token: r.first_row for r in b_rows}
    assert first["org"] == -3 * (1 << 50) and first["coop"] == 0
    assert _vocab(spark, urls) == {r.token: r.idx for r in T.build_vocab(T.token_counts(big)).collect()}


def test_segments_edges(spark):
    from urlsieve.operators.ranking import with_segments
    # label 0: 3000 rows (hot), label 1: 1 row, label 2: 40 rows
    df = spark.range(0, 3041).select(F.col("id").alias("row_id"),
                                     F.when(F.col("id") < 3000, 0).when(F.col("id") == 3000, 1).otherwise(2)
                                     .alias("label"))
    keyed = df.withColumn("_k", md5_order_key(7, "row_id"))
    w = Window.partitionBy("label").orderBy("_k", "row_id")
    ranked = keyed.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label")))
    for cuts, want in (
        (lambda t: [F.lit(0)], lambda r, n: 1),
        (lambda t: [t], lambda r, n: 0),
        (lambda t: [F.lit(10), F.lit(10_000)], lambda r, n: 0 if r <= 10 else 1),
        (lambda t: [F.ceil(t / 5), F.ceil(t / 5) + F.ceil((t - F.ceil(t / 5)) / 5)],
         lambda r, n: 0 if r <= -(-n // 5) else (1 if r <= -(-n // 5) + -(-(n - -(-n // 5)) // 5) else 2)),
    ):
        for sort_rows in (1, 5, 1_000_000):     # many rounds of radix selection, some, one
            got = with_segments(ranked, "_k", "row_id", ["label"], cuts, "seg", sort_rows).select("r", "n", "seg").collect()
            assert len(got) == 3041 and all(x.seg == want(x.r, x.n) for x in got)


def test_reserved_tokens_never_enter_the_vocabulary(spark):
    # T2 does not lower-case: a literal <PAD>/<UNK> token must not take a reserved id
    urls = ["http://a.com/<PAD>/<UNK>", "http://b.com/<PAD>/<UNK>", "http://c.com/x"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "row_id bigint, url string")
    df = flows.tokenized(df, tok="structured")
    vocab = T.build_vocab(T.token_counts(df), min_freq=2)
    v = {r.token: r.idx for r in vocab.collect()}
    assert "<PAD>" not in v and "<UNK>" not in v and v == {"com": 2}
    enc = {r.row_id: r.sequence for r in T.encode(df, vocab, 4).collect()}
    assert enc[0] == [2, 1, 1, 0]        # com, <PAD>, <UNK> (one-char "a" dropped) -> com, unk, unk, pad


def test_null_partition_values_are_their_own_group(spark):
    from urlsieve.operators.ranking import with_segments
    df = spark.range(0, 600).select(F.col("id").alias("row_id"),
                                    F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("label"))
    keyed = df.withColumn("_k", md5_order_key(5, "row_id"))
    w = Window.partitionBy("label").orderBy("_k", "row_id")
    want = {r.row_id: r.r for r in keyed.withColumn("r", F.row_number().over(w)).collect()}
    got = {r.row_id: r.rank for r in distributed_rank(keyed, ["_k", "row_id"], hash_bucket(F.col("_k"), 1),
                                                      partition_by=["label"]).collect()}
    assert got == want
    segs = {r.row_id: r.s for r in with_segments(keyed, "_k", "row_id", ["label"], lambda t: [F.lit(50)], "s").collect()}
    assert all(segs[i] == (0 if want[i] <= 50 else 1) for i in want)
    rm = running_agg(keyed.withColumn("v", F.col("row_id").cast("double")), ["label"], ["row_id"],
                     F.floor(F.col("row_id") / 150), "v", "min", "m")
    assert rm.count() == 600


def test_partition_rank_splits_only_hot_values(spark):
    from urlsieve.operators.ranking import partition_rank
    df = spark.range(0, 4000).select(F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id") % 37 + 1).alias("g"),
                                     ((F.col("id") * 7919) % 4000).alias("t"), "id")
    w = Window.partitionBy("g").orderBy("t", "id")
    want = {r.id: r.rank for r in df.withColumn("rank", F.row_number().over(w)).collect()}
    for hot_rows in (100, 10_000):          # with and without a hot value
        got = {r.id: r.rank for r in partition_rank(df, ["g"], ["t", "id"], "t", hot_rows=hot_rows, cells=16).collect()}
        assert got == want
