"""Byte and word repeat removal against brute force, with and without crowded grams."""

import random
import tracemalloc

import brute
import pyarrow as pa
import pytest

from urlsieve.llm import anchors, repeats, substring_dedup, suffix_array_dedup

SCHEMA = "doc_id long, text string, k int, c string, kept_text string"


def corpus(seed: int, passage: int) -> list[str]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, out = [text(passage) for _ in range(3)], [None, "", " ", "x"]
    for _ in range(40):
        t = text(r.randint(0, 60)) + " " + r.choice(shared)[r.randint(0, 20):] + "\n" + text(r.randint(0, 40))
        if r.random() < 0.3:
            at = r.randrange(len(t))
            t = t[:at] + "Q" + t[at + 1:]
        out.append(t)
    out += [out[5], out[5], "ab " * 300, shared[0] + " " + shared[0]]
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "z", "own") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("hot", [2048, 2])
def test_bytes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = corpus(hot, 60)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_array_dedup.repeated_byte_digest(table(spark, texts), length=100).collect()}
    assert [got[i] for i in range(len(texts))] == brute.byte_digest(texts, 100)


@pytest.mark.parametrize("hot", [2048, 2])
def test_words_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = corpus(hot + 1, 60)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.repeated_word_digest(table(spark, texts), length=20).collect()}
    assert [got[i] for i in range(len(texts))] == brute.word_digest(texts, 20)


def test_equal_and_null_ids_and_kept_text(spark):
    long = "word " * 3 + "".join(chr(97 + i % 26) for i in range(150))
    rows = [(1, long), (1, long), (None, "tail " + long), (2, "only here"), (2, None)]
    out = suffix_array_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), length=100).collect()
    assert sorted((r.doc_id or 0, r.kept_text) for r in out) == [(0, "tail "), (1, ""), (1, ""), (2, ""), (2, "only here")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeated_words(empty).count() == suffix_array_dedup.remove_repeated_bytes(empty).count() == 0


def test_long_text_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK", 64)
    r = random.Random(4)
    base = "".join(r.choice("abcdefgh ") for _ in range(700))
    texts = [base + "1" + base[:350], "x" + base[100:600], base[300:]]
    got = suffix_array_dedup.repeated_byte_digest(table(spark, texts).repartition(1), length=50).orderBy("doc_id").collect()
    assert [tuple(g)[1:] for g in got] == brute.byte_digest(texts, 50)


def test_automaton_counts_occurrences():
    words = [list(b"abcabcd"), list(b"xbcab")]
    a = substring_dedup.SuffixAutomaton([[bytes([w]) for w in s] for s in words])
    joined = [bytes(s) for s in words]
    for s in joined:
        for end, size in enumerate(a.matches([bytes([w]) for w in s]), 1):
            best = max(n for n in range(end + 1) if n == 0 or sum(t[i:i + n] == s[end - n:end] for t in joined for i in range(len(t))) > 1)
            assert size == best


def thue_morse(n):
    return bytes(97 + (i.bit_count() & 1) for i in range(n))


def test_texts_that_a_rolling_hash_cannot_tell_apart(spark):
    """A random start and then a Thue-Morse string or its complement: all windows of 2,048 bytes differ."""
    r = random.Random(5)
    rows, plain = [], thue_morse(1024)
    swapped = plain.translate(bytes.maketrans(b"ab", b"ba"))
    for i in range(60):
        start = bytes(r.choice(b"cdefgh") for _ in range(1024))
        rows += [(2 * i, (start + plain).decode()), (2 * i + 1, (start + swapped).decode())]
    got = suffix_array_dedup.repeated_byte_digest(spark.createDataFrame(rows, "doc_id long, text string"), length=2048).collect()
    assert len(got) == 120 and all(x.n_removed == 0 for x in got)
    copied = [*rows, (1000, rows[0][1])]
    got = suffix_array_dedup.repeated_byte_digest(spark.createDataFrame(copied, "doc_id long, text string"), length=2048).where("n_removed > 0").collect()
    assert {x.doc_id for x in got} == {0, 1000}


@pytest.mark.parametrize("resolver", ["own", "hot"])
def test_lengths_of_the_queries(spark, monkeypatch, resolver):
    """200 bytes and 35 words against brute force, with shared passages around those lengths."""
    if resolver == "hot":
        monkeypatch.setattr(repeats, "HOT", 1)
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghijé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (20, 34, 35, 36, 60, 120)]
    texts = [None, "", passages[5] * 3]
    for i in range(60):
        parts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 4))]
        texts.append((" " if i % 2 else "\n").join([parts[0], r.choice(passages), *parts[1:], r.choice(passages)[: r.randint(150, 400)]]))
    texts += [texts[5], texts[6] + " x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_array_dedup.repeated_byte_digest(docs, length=200).collect()}
    assert got == dict(enumerate(brute.byte_digest(texts, 200)))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.repeated_word_digest(docs, length=35).collect()}
    assert got == dict(enumerate(brute.word_digest(texts, 35)))


def test_stretches_are_resolved_a_few_at_a_time():
    """What a task holds follows neither the batches nor the number of stretches; groups stay whole."""
    r = random.Random(5)
    texts = [bytes(r.choice(b"ab ") for _ in range(340)) for _ in range(40)]
    rows = [(g, 1000 * g + j, 0, texts[r.randrange(40)]) for g in range(2000) for j in range(r.randint(2, 12))]
    rows += [(2000, 10_000_000 + j, 0, texts[j % 40]) for j in range(5000)]
    schema = pa.schema([("g", pa.int64()), ("k", pa.int64()), ("lo", pa.int32()), ("data", pa.binary())])
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
    held = list(repeats._groups([batch]))
    assert [x for part in held for x in part] == rows
    assert max(map(len, held[:-1])) <= 1.25 * repeats.TOGETHER and len(held[-1]) >= 5000
    assert not any(a[-1][0] == b[0][0] for a, b in zip(held, held[1:]))

    some = batch.slice(0, 13_000)
    resolve = repeats._resolved(repeats.equal_windows(repeats.ByteUnits, 200))
    tracemalloc.start()
    found = sum(x.num_rows for x in resolve([some]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 90 << 20
