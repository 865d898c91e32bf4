"""Cases every operator defines: empty tables, repeated rows, clashing columns, nulls, very long texts; the whole pipeline."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urlsieve.llm import (ann, chat, decontamination, fill_in_middle, html_text, lm_scoring, merkle, packing, quality, simhash, substring_dedup,
                          suffix_array_dedup, token_counts)
from urlsieve.llm.common import row_bytes, sliced

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDITS = "array<struct<start: long, end: long, insert: string>>"


def with_edits(docs):
    return docs.withColumn("edits", F.expr(f"cast(array(struct(0L, 1L, 'x')) as {EDITS})"))


OPERATORS = {
    "op1": lambda spark, d: quality.quality_scores(d, spark.createDataFrame([], "doc_id long, quality int")),
    "op2": lambda spark, d: decontamination.benchmark_hits(d, spark.createDataFrame([(1, "some benchmark item that is long enough")], "item_id long, text string")),
    "op3": lambda spark, d: suffix_array_dedup.repeated_byte_digest(d),
    "op4": lambda spark, d: simhash.near_duplicate_components(d),
    "op6": lambda spark, d: token_counts.recount(with_edits(d)),
    "op9": lambda spark, d: substring_dedup.repeated_word_digest(d),
    "op10": lambda spark, d: packing.pack(d),
    "op11": lambda spark, d: fill_in_middle.fill_in_middle_digest(d),
    "op12": lambda spark, d: merkle.verified_manifest(d),
    "op13": lambda spark, d: lm_scoring.lm_scores(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_documents(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], DOCS)).collect() == []


def test_other_empty_tables(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 2 == 0).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("op1", "op2")])
def test_repeated_rows_nulls_and_clashing_columns(spark, name):
    """Equal rows are rows each with equal results; columns named like results change nothing."""
    text = "A text of some words that stands here, more than once. " * 8
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (None, "x y", "en", "s", 1), (3, "", "", "", 0)]
    plain = spark.createDataFrame(rows, DOCS)
    clash = plain.select("*", *[F.lit("clash").alias(c) for c in ("score", "row", "id", "t", "k", "g", "fp", "leaf", "block", "form", "start", "bucket")])
    own = [c for c in OPERATORS[name](spark, plain).columns if c != "edits"]
    got, want = (sorted(map(repr, OPERATORS[name](spark, d).select(own).collect())) for d in (clash, plain))
    if name not in ("op10", "op12"):        # there equal rows have places of their own
        assert got == want
    assert len(got) == len(want) >= 5


def test_repeated_pages_and_turns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>One text.</p>", "x", 9), (1, "u", "<p>One text.</p>", "x", 9), (None, None, None, "x", 9)],
                                  "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(repr, (tuple(r) for r in html_text.extract_main_text(pages).select("page_id", "url", "text", "n_chars").collect()))) == sorted(
        map(repr, [(1, "u", "One text.", 9), (1, "u", "One text.", 9), (None, None, "", 0)]))
    turns = [(1, 0, "user", "Hello there, how are you?", 7), (1, 1, "bot", "> Hello there, how are you?\nFine.", 7), (1, 0, "user", "Hello there, how are you?", 7), (None, None, None, None, 7)]
    conv = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, depth int")
    assert chat.format_conversations(conv).count() == 4


def test_very_long_texts(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away from it"
    long = " ".join(f"w{i}" for i in range(120_000))
    docs = spark.createDataFrame([(1, long + " " + item + " " + long), (2, long)], "doc_id long, text string")
    hits = decontamination.benchmark_hits(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(h.doc_id, h.item_id, h.distance) for h in hits] == [(1, 7, 0)]
    line = "A paragraph of the page, and another sentence."
    page = "<html><body><article>" + f"<p>{line}</p>" * 30_000 + "</article></body></html>"
    got = html_text.extract_main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert got.text == " ".join([line] * 30_000) and got.n_chars == len(got.text)
    said = "A sentence that is said here. " * 20_000
    conv = spark.createDataFrame([(1, 0, "user", said), (1, 1, "bot", "> A sentence that is said here.\nYes.")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(conv).count() == 2


def test_slices_are_bounded_by_bytes():
    texts = ["x" * n for n in (10, 900, 20, 5000, 1, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([[1, 2]] * 7)], names=["t", "l"])
    parts = list(sliced([batch], rows=3, size=1000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or (p.num_rows <= 3 and row_bytes(p).sum() <= 1000) for p in parts)
    assert list(sliced([batch.slice(0, 0)])) == []


def test_packing_refuses_tokenizers_that_merge_across_white_space():
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_nearest_against_brute_force_with_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [1.0, None] * 4), (20, [1.0] * 8)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=5).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and all(r.vec_id < 100 for r in got)


def _sentence(r, words):
    return " ".join(r.choice(words) for _ in range(r.randint(6, 14))).capitalize() + "."


def test_pipeline_on_planted_cases(spark, tmp_path):
    """Junk goes, one of each group of copies stays, a shared passage goes, a leak goes, clean documents are packed whole."""
    from tokenizers import Tokenizer

    r = random.Random(4)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(900)]
    good = {i: " ".join(_sentence(r, words) for _ in range(r.randint(12, 30))) for i in range(200)}
    junk = {1000 + i: " ".join(r.choice(["$$$", "!!!", "CLICK", "BUY", "###", "77"]) + str(r.randint(0, 99)) for _ in range(120)) for i in range(200)}
    item = " ".join(_sentence(r, words) for _ in range(2))
    passage = " ".join(_sentence(r, words) for _ in range(8))
    texts = good | junk | {300: good[3], 301: good[4], 302: good[5] + " " + item, 303: good[6][:200] + passage + " " + _sentence(r, words), 304: passage + " " + good[7][:300]}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i in [*good, *junk]], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, d).collect()
    kept = {p.doc_id for p in pieces}
    assert not kept & set(junk) and 302 not in kept and not {300, 301} & kept
    clean = set(good) - {3, 4, 5, 6, 7}
    assert len(clean & kept) >= 0.97 * len(clean)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for p in pieces:
        if p.doc_id in clean:
            assert p.doc_tokens == len(tokenizer.encode(good[p.doc_id], add_special_tokens=False).ids) + 1
    places = {}
    for p in pieces:
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in places.values():
        assert sum(n for _, n in own) <= packing.SEQ_LEN and all(sum(n for o, n in own if o < at) == at for at, _ in own)
