"""Quality, token counts, chat, HTML, packing and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from urlsieve.llm import chat, packing, quality, token_counts
from urlsieve.llm.html_text import main_text

SF = "/root/testdata/sf0.01"


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(None, "x"), (5000, None), (5001, "")], "doc_id long, text string")
    scores = quality.quality_scores(docs.select("doc_id", "text").unionByName(extra), labels)
    rows = scores.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.95 * len(rows)
    assert scores.count() == docs.count() + 3 and not scores.where("score is null or not score between 0 and 1").head(1)
    with pytest.raises(ValueError):
        quality.train(docs, labels.where("quality = 1"))


def test_quality_fits_one_row_of_a_repeated_id(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs, vectors, fitted, fit = docs.select("doc_id", "text"), quality.word_vectors(docs), [], quality.fit
    monkeypatch.setattr(quality, "word_vectors", lambda *_: vectors)
    monkeypatch.setattr(quality, "fit", lambda x, y: (fitted.append(len(x)), fit(x, y))[1])
    again = docs.join(labels.where(~quality.held_out(F.col("doc_id"))).orderBy("doc_id").limit(3), "doc_id", "left_semi")
    again = again.crossJoin(spark.range(400)).drop("id")
    other = again.withColumn("text", F.concat("text", F.lit(" and "), F.rand(1).cast("string")))
    plain, copies, others = (quality.train(d, labels).network for d in (docs, docs.unionByName(again).repartition(7), docs.unionByName(other)))
    assert fitted[0] == fitted[1] == fitted[2] <= labels.count()
    assert (plain.w1 == copies.w1).all() and plain.temperature == copies.temperature
    assert np.abs(plain.scores(plain.mean) - others.scores(plain.mean)) < 0.2


def test_count_tree_equals_full_recount():
    encoder, r = token_counts.Encoder(token_counts.default_tokenizer()), random.Random(5)
    parts = ["a", "B", "ab", "é", " ", "  ", "\n", "'s", "'", "l", "9", "!", "...", "<|endoftext|>", "x y z "]
    for n in range(400):
        text = "".join(r.choice(parts) for _ in range(r.choice([0, 3, 30, 400])))
        tree = token_counts.CountTree.of(text, encoder)
        for _ in range(r.randint(1, 5)):
            a = r.randint(0, len(text) + 2)
            insert = "".join(r.choice(parts) for _ in range(r.choice([0, 1, 3, 300 if n % 20 == 0 else 2])))
            text, _ = tree.replace(text, a, a + r.choice([0, 1, 3, 1000]), insert, encoder)
            assert tree.tokens[1] == len(encoder.tokenizer.encode(text, add_special_tokens=False).ids) and tree.chars[1] == len(text)


def test_recount_from_stored_state(spark):
    docs = spark.createDataFrame([(1, "one two three " * 200), (2, None), (2, "")], "doc_id long, text string")
    edits = F.array(F.struct(F.lit(5).cast("long").alias("start"), F.lit(9).cast("long").alias("end"), F.lit("XX y").alias("insert")))
    state = token_counts.count_tokens(docs).where("doc_id = 1")
    now = token_counts.recount(docs.join(state.drop("n_tokens"), "doc_id").withColumn("edits", edits), state=True).head()
    again = token_counts.count_tokens(spark.createDataFrame([(1, now.text)], "doc_id long, text string")).head()
    assert now.tokens_after == again.n_tokens == sum(now.leaf_tokens) and now.reencoded_chars < len(now.text)
    assert token_counts.recount(docs.withColumn("edits", F.lit(None).cast("array<struct<start:long,end:long,insert:string>>"))).count() == 3


def test_chat_links_nested_quotes(spark):
    rows = [(1, 0, "user", "Hello there. How are you?"), (1, 1, "assistant", "I am fine. Thanks for asking."),
            (1, 2, "user", "> I am fine.\n> Thanks for\n> asking.\nGood. What is new?"),
            (1, 3, "assistant", "On day user wrote:\n> > I am fine.\n> Good. What is new?\nNothing much."),
            (1, 4, "user", ">Hello there. How are you?\nI said that first."), (2, 0, None, None), (None, 0, "user", "> x"), (2, None, "user", "y")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.reply_to, r.depth, r.text) for r in out if r.conv_id == 1] == [
        (0, None, 0, "Hello there. How are you?"), (4, 0, 1, "I said that first."), (1, None, 0, "I am fine. Thanks for asking."),
        (2, 1, 1, "Good. What is new?"), (3, 2, 2, "Nothing much.")]
    assert len(out) == len(rows)


def test_chat_links_lines_and_parts_of_sentences(spark):
    long = "The committee met on the second of May and found that nothing at all had been done about the old bridge."
    rows = [(1, 0, "user", "- milk and eggs\n- brown bread\n- tea"), (1, 1, "assistant", "你好。今天天气很好！我们去公园吧。\nx = f(y)"),
            (1, 2, "user", long), (1, 3, "user", "Something else, and tea as well"),
            (1, 4, "user", "> - brown bread\nWhich?"), (1, 5, "user", "> 今天天气很好！\n好"), (1, 6, "user", "> 去公园\n好"),
            (1, 7, "user", "> nothing at all had\n> been done about the old\nOh"), (1, 8, "user", "> second of May\nLate"),
            (1, 9, "user", "> The committee met ... the old bridge\nWell"), (1, 10, "user", "> milk\n> bread\nYes"), (1, 11, "user", "> x = f(y)\nCode"),
            (1, 12, "user", "> nobody said this\nNo"), (1, 13, "user", "> > - TEA\n> Which?\nThat"), (2, 0, "user", "> second of May\nOther"),
            (2, 1, "user", "the second of May"), (None, 0, "user", "> second of May"), (2, None, "user", "> second of May")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(messages).collect()
    assert {r.turn: r.reply_to for r in out if r.conv_id == 1} == {
        0: None, 1: None, 2: None, 3: None, 4: 0, 5: 1, 6: 1, 7: 2, 8: 2, 9: 2, 10: 0, 11: 1, 12: None, 13: 4}
    assert len(out) == len(rows) and all(r.reply_to is None for r in out if r.conv_id != 1)
    assert [r.turn for r in out if r.conv_id == 1] == [0, 4, 10, 13, 1, 5, 6, 11, 2, 7, 8, 9, 3, 12]


def test_chat_depth_of_a_long_chain(spark):
    rows = [(1, i, "user", (f"> Message {i - 1} says so.\n" if i else "") + f"Message {i} says so.") for i in range(40)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.depth, r.thread) for r in out] == [(i, i, 0) for i in range(40)]


def test_html_main_text():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1><a href=/>x</a></header><nav><a href=1>one</a></nav>
    <div class="layout has-sidebar"><div id=content><h2>Title &amp; more</h2><p>First para with <a href=x>a link</a> and text that counts.
    <p>Second   para<br>line two of the thing.<div class="cookie-notice">We use cookies</div><ul><li>item one<li>item two</ul></div>
    <div class="sidebar"><a href=1>rel</a></div></div><section id="comments"><p>I am a reader comment which is long</p></section>
    <form><p>Subscribe now</p></form><footer>(c)</footer><script>var a="</div><p>bad</p>"</script></body></html>"""
    assert main_text(page) == "Title & more First para with a link and text that counts. Second para line two of the thing. item one item two"
    assert main_text(None) == main_text("") == main_text("<p") == ""
    assert main_text("just text &lt;b&gt;") == "just text <b>"
    assert main_text("<div>" * 50_000 + "x") == "x"


def test_html_article_keeps_its_own_parts():
    """Inside the marked article: formulas, lists of links and names that only contain a cut word stay."""
    links = "".join(f"<li><a href={i}>Source {i}</a>" for i in range(4))
    parts = {
        "Title here": "<h1 class=page-header>Title here</h1>", "Lead.": "<header><h2>Lead.</h2></header>",
        "So x=2 holds.": "<p>So <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> holds.</p>",
        "Method": "<h2 class=section-header id=comments>Method</h2>", "An ad-hoc rule.": "<p class=ad-hoc>An ad-hoc rule.</p>",
        "Others did so too.": "<div id=related-work><p>Others did so too.</p></div>",
        "a # why": "<pre>a <span class='token comment'># why</span></pre>", "Wise words. Someone": "<blockquote><p>Wise words.<footer>Someone</footer></blockquote>",
        "Source 0 Source 1 Source 2 Source 3": f"<ul>{links}</ul>"}
    cut = "".join(f"<div {x}>Gone</div>" for x in ("class=ad", "class='notice alert'", "id=comments", "class='x share'", "class=newsletter", "class=cookie-notice", "class=related-posts",
                                                  "hidden", "role=navigation", "class=ad_slot")) + "<nav>Gone</nav><footer>Gone</footer>"
    for name in ("article", "main"):
        page = f"<body><nav><a href=/>Home</a></nav><div class=ad>Buy</div><{name}>{''.join(parts.values())}{cut}</{name}><footer>(c)</footer></body>"
        assert main_text(page) == " ".join(parts)
        assert main_text(f"<body><{name}><ul>{links}</ul></{name}><p>Short.</p></body>") == "Source 0 Source 1 Source 2 Source 3"
    text = "A paragraph that is long enough to be the text of the page. " * 5
    assert main_text(f"<body><div><h1 class=page-header>Title</h1><p>{text}</p></div><div class=site-header>Gone</div></body>") == f"Title {text}".strip()


def test_html_pages_whole_articles(spark):
    rows = entry.queries()["op8_html_extraction"](spark, SF).collect()
    assert len(rows) == 250 and all(r.n_chars == len(r.text) > 0 for r in rows)


def test_cutting_stock_covers_demand():
    rng = np.random.default_rng(0)
    for demand in (rng.integers(0, 3000, 63), np.eye(63, dtype=int)[40] * 7, np.zeros(63, int)):
        plan = packing.cutting_stock(demand, 64)
        assert (sum((p * n for p, n in plan), np.zeros(63, int)) == demand).all() and all(p @ np.arange(1, 64) <= 64 for p, _ in plan)
    demand = rng.integers(0, 3000, 63) * (np.arange(63) < 32)  # nothing over half a bin: the volume is the bound
    assert sum(n for _, n in packing.cutting_stock(demand, 64)) <= -(-(demand @ np.arange(1, 64)) // 64) * 1.01 + 2


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    odd = [(None, "x <|endoftext|> Y."), (9001, None), (9002, ""), (9003, "A. İ. ÉÀ, ΑΣ. Σ, ﬁ, it's\tB " * 900), (9003, "A b.")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got, tokenizer = packing.pack(docs, with_ids=True).collect(), Tokenizer.from_file(packing.default_tokenizer())
    want = sorted(tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.collect())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    assert sorted(tuple(i for r in sorted(x, key=lambda r: r.start) for i in r.ids) for x in pieces.values()) == want
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    assert padding <= 2 * 4096 and packing.pack(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").head().text
    planted = spark.createDataFrame([(10_000, "Before. " + item + " After.", None, None, None)], docs.schema)
    kept = corpus_pipeline.drop_leaks(spark, docs.where("doc_id < 50").unionByName(planted), SF)
    assert kept.columns == docs.columns and not kept.where("doc_id = 10000").head(1)
    out = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert 700 < len(ids) < 950


def test_word_ids_equal_the_tokenizers():
    """Ids by cached words are the tokenizer's own, also for slices of a column and odd white space, case and marks."""
    import pyarrow as pa

    odd = ["", "  ", " a.b, c. <|endoftext|>Q A", "İSTANBUL É ß ẞ ǅ \u0085x y z", "don't it's, o'clock.'", "a.,", "..",
           "x\x00y\tZ\r\n", "é é.", "가 한국", "<|ENDOFTEXT|>", "ſ. K. Å,", "9.,8.", "Plain Words, plain words.\nAnd more"]
    words = packing.WordTokenizer.of(packing.default_tokenizer())
    want = [words.tokenizer.encode(x, add_special_tokens=False).ids for x in odd]
    column = pa.array(["Before " * 50, *odd, None])
    for low in range(len(odd)):
        ids, at = words.encode(column.slice(1 + low))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [*want[low:], []]


def test_outside_an_article_only_names_of_nothing_else_are_cut():
    body = "<p>" + "The long text of the page goes on and on, sentence after sentence. " * 8 + "</p>"
    kept = {"Others did so too, and this is how they went about it.": "<div id=related-work><p>%s</p></div>",
            "A monarchy is one of several forms that a state may take.": "<p class=form-of-government>%s</p>",
            "See one and two and three": "<p>See <a href=1>one</a> and <a href=2>two</a> and <a href=3>three</a></p>"}
    gone = ["class=site-header", "id=siteFooter", "class='left-sidebar x'", "class=related_posts", "id=cookie-consent-banner", "class=ad-slot"]
    for text, html in kept.items():
        html = html % text if "%s" in html else html
        assert text in main_text(f"<html><body><div>{body}{html}{body}</div></body></html>"), text
    for name in gone:
        assert "Gone" not in main_text(f"<html><body><div>{body}<div {name}><p>Gone is gone.</p></div>{body}</div></body></html>"), name
    article = f"<html><body><article><h1>T</h1>{body}<label>Size</label><div class='site-notice'>Gone</div><div class=notice>Gone</div></article></body></html>"
    assert "Size" in main_text(article) and "Gone" not in main_text(article)
