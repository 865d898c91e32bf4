"""Language-model scores: counts and base score against a plain version, the network against itself and numeric gradients."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import words

from urlsieve.llm import lm_scoring as L

SF = "/root/testdata/sf0.001"


def late(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return [w.lower() for w in words(text)] + [b""]  # bytes.lower folds A-Z alone


def plain(rows):
    train = Counter(t for i, x in rows if not late(i) for t in tokens(x))
    n, v = sum(train.values()), len(train)
    out = []
    for i, x in rows:
        t = tokens(x)
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t)
        out.append((i, late(i), len(t), sum(train[w] > 0 for w in t), n, round(base, 6)))
    return out


def rows_of(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df]


EDGE = [None, "", " \t\n", "A a b Éé", "x" * 5000 + " y", "word " * 20_000, "one\x0btwo\x0cthree\rfour", "naïve\x85café 你好 <|endoftext|> 's '"]


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocabulary) + ("" if r.random() < 0.9 else str(r.randint(0, 999))) for _ in range(r.randint(0, 200)))) for i in range(120)]
    rows += [(1000 + i, t) for i, t in enumerate(EDGE)] + [(None, "abc abc"), (5, "twice"), (5, "twice"), (5, None)]
    return rows, spark.createDataFrame([(*x, "clash", 1.0) for x in rows], "doc_id long, text string, word string, score double")


@pytest.mark.parametrize("frequent_bytes", [L.FREQUENT_BYTES, 1 << 12, 1])
def test_base_score_matches_brute_force(table, monkeypatch, frequent_bytes):
    """Also where most words, or all but the end, are joined over the cluster."""
    rows, docs = table
    monkeypatch.setattr(L, "FREQUENT_BYTES", frequent_bytes)
    got = L.lm_scores(docs).collect()
    assert sorted(rows_of(got), key=repr) == sorted(plain(rows), key=repr)
    assert all(-math.inf < r.score < 0 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 3  # of four rows, two are equal and score alike


@pytest.mark.parametrize("rows", [[], [(0, None)], [(i, "held out") for i in range(40) if late(i)]], ids=["empty", "null", "no training rows"])
def test_small_tables(spark, rows):
    got = L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(rows_of(got), key=repr) == sorted(plain(rows), key=repr)
    assert all(math.isfinite(r.score) for r in got)


def random_model(seed=0, own=6):
    """A small model with random parameters; ids 1 and 2 open words."""
    rng = np.random.default_rng(seed)
    opens = np.zeros(12, bool)
    opens[[1, 2, 7]] = True
    pairs = rng.integers(0, 30, (own + 2, own + 2)).astype(float)
    pairs[:, [2, 3, own + 1]] = 0  # nothing opens a word inside one
    first, last = np.zeros(own + 2), rng.integers(1, 9, own + 2).astype(float)
    first[[2, 3, own + 1]] = 5
    m = L.initial_model("-", np.arange(own), opens, pairs, first, last, 4.0)
    return m.with_parameters(m.parameters() + rng.normal(0, 0.3, m.parameters().size)).bounded()


def test_windows_score_each_id_once_with_context():
    """The windowed, batched result equals plain attention over the ids that an id's window holds."""
    m, rng = random_model(), np.random.default_rng(1)
    sizes = np.array([1, 15, 16, 17, 40, 1200])
    rows = rng.integers(0, len(m.group) - 1, sizes.sum())
    x, y, place = L.layout(rows, sizes, m.start)
    lp, opens, kinds = m.log_probabilities(x, y, place)
    assert len(set(place)) == len(rows) and (y[place] == rows).all()
    at = 0
    for n in sizes:
        text, before = rows[at : at + n], np.r_[[m.start] * (L.CONTEXT + 1), rows[at : at + n]]
        for j in range(n):
            low = j // L.STRIDE * L.STRIDE  # the window's first input
            seen = before[low : j + L.CONTEXT + 1]
            a = np.exp(m.k[seen] @ m.q[seen[-1]] + m.r[np.arange(len(seen))[::-1]])
            state = a @ m.v[seen] / a.sum() + m.h[seen[-1]]
            p = np.exp(state @ m.u + m.b)
            want = math.log(p[m.group[text[j]]] / p.sum()) + m.inside[seen[-1], text[j]]
            assert abs(want - lp[place[at + j]]) < 1e-3
            assert abs(math.log(p[m.opening].sum() / p.sum()) - opens[place[at + j]]) < 1e-3
            assert abs(kinds[at + j].sum() - 1) < 1e-4
        at += n


def test_next_rows_sum_to_one():
    m = random_model()
    many = np.array([(m.slot == r).sum() if r < m.end else r == m.end for r in range(len(m.group))])  # ids of each row
    x = np.full(2 * L.STRIDE, m.start, np.int32)
    total = 0.0
    for row in range(len(m.group) - 1):
        y = np.full(len(x), row, np.int32)
        total += many[row] * math.exp(m.log_probabilities(x, y, np.zeros(0, int))[0][L.STRIDE])
    assert abs(total - 1) < 1e-3


def test_gradients():
    m, rng = random_model(), np.random.default_rng(2)
    x = rng.integers(0, len(m.group), (5, L.WIDTH))
    y, use, kind = rng.integers(0, len(m.group) - 1, (5, L.STRIDE)), (rng.random((5, L.STRIDE)) < 0.8).astype(np.float32), rng.integers(0, L.KINDS, 5)
    _, grads = L.gradients(m, x, y, use, kind)
    for name in m.NAMES:
        value, flat = getattr(m, name), grads[name].ravel()
        for i in np.argsort(-np.abs(flat))[:3]:
            ends = []
            for step in (-1e-2, 1e-2):
                moved = value.astype(np.float64).ravel().copy()
                moved[i] += step
                changed = L.Model(**{**m.__dict__, name: moved.reshape(value.shape)})
                ends.append(L.gradients(changed, x, y, use, kind)[0])
            assert abs((ends[1] - ends[0]) / 2e-2 - flat[i]) < 0.05 * abs(flat[i]) + 1e-3, name


def test_steps_that_share_arrays_learn_the_same():
    """A pass of Adam equals one written out with arrays of its own in every step, also where the last step is shorter."""
    m, rng = random_model(), np.random.default_rng(3)
    n, rate = 2 * L.STEP + 7, 0.05
    x = rng.integers(0, len(m.group), (n, L.WIDTH))
    y, use, kind = rng.integers(0, len(m.group) - 1, (n, L.STRIDE)), (rng.random((n, L.STRIDE)) < 0.8).astype(np.float32), rng.integers(0, L.KINDS, n)
    before, room = m.parameters(), L.Room()
    for size in (9, 4, 9):
        alone, shared = (L.gradients(m, x[:size], y[:size], use[:size], kind[:size], r) for r in (None, room))
        assert alone[0] == shared[0] and all((alone[1][k] == shared[1][k]).all() for k in m.NAMES)
    got = L.adam(m, x, y, use, kind, rate, 5).parameters()
    assert (m.parameters() == before).all()  # other blocks start from it
    first, second, order, want = {k: 0.0 for k in m.NAMES}, {k: 0.0 for k in m.NAMES}, np.random.default_rng(5).permutation(n), m
    for t in (1, 2, 3):
        some = order[(t - 1) * L.STEP : t * L.STEP]
        _, grads = L.gradients(want, x[some], y[some], use[some], kind[some])
        moved = {}
        for k in m.NAMES:
            first[k], second[k] = 0.9 * first[k] + 0.1 * grads[k], 0.99 * second[k] + 0.01 * grads[k] ** 2
            change = rate * (1 - 0.9 * (t - 1) / 3) * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-6)
            moved[k] = (getattr(want, k) - change).astype(np.float32)
        want = L.Model(**{**want.__dict__, **moved}).bounded()
    assert np.abs(got - want.parameters()).max() < 1e-3 < np.abs(got - before).max()


def test_expected_counts_of_kinds():
    """Sums over segments that are counted some at a time equal those over each segment's rows in turn."""
    rng, width = np.random.default_rng(4), 12
    kinds, weight = np.log(rng.dirichlet(np.ones(width), L.KINDS).T), rng.dirichlet(np.ones(L.KINDS))
    segments = [rng.integers(0, width, rng.integers(1, 130)).astype("<u2") for _ in range(2 * L.COUNTED + 3)]
    counts = np.concatenate(list(L._row_counts(np.concatenate(segments), np.array(list(map(len, segments))), width)))
    assert (counts == [np.bincount(s, minlength=width) for s in segments]).all()
    want, own = np.zeros((width, L.KINDS)), np.zeros(L.KINDS)
    for s in segments:
        p = np.exp(kinds[s].sum(axis=0) + np.log(weight))
        np.add.at(want, s, p / p.sum())
        own += p / p.sum()
    (got,) = L._kind_sums(kinds, weight)([pa.RecordBatch.from_pydict({"rows": pa.array([s.tobytes() for s in segments], pa.binary())})])
    assert np.allclose(got.column(2).to_numpy(), np.r_[want.ravel(), own])


def test_words_are_spelled_alone_as_together():
    s = L.Speller.of(L.default_tokenizer())
    some = [w for t in EDGE for w in tokens(t)[:-1]] + [b"'s", b"don't", " x ".encode(), " ".encode(), b"a" * 64, b"1234"]
    for group in (some, [w for w in some if len(w) <= L.PART]):
        ids, lengths = s.many(group)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == list(map(s.one, group))
    assert all(s.encoding.decode_bytes(s.one(w)) == b" " + w for w in some)


def test_learned_scores_beat_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")  # a small table of its own
    got = [r for r in L.lm_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_every_training_segment_takes_part(spark):
    """In the written segments, in each round of gradient steps and in the mixture, whatever a task holds at a time."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 130))) for i in range(200)], "doc_id long, text string").repartition(3)
    train = [tokens(r.text) for r in docs.collect() if not late(r.doc_id)]
    path, counts = L.default_tokenizer(), L.word_counts(docs)
    assert counts.agg({"c": "sum"}).first()[0] == sum(map(len, train))
    words = [bytes(r.word) for r in counts.limit(40).collect()]
    s = L.Speller.of(path)
    opens = np.array([k.startswith(b" ") for k, _ in sorted(s.ranks.items(), key=lambda x: x[1])] + [False] * (s.size - len(s.ranks)))
    n = 8
    m = L.initial_model(path, np.arange(n), opens, np.ones((n + 2, n + 2)), np.ones(n + 2), np.ones(n + 2), 1.0)
    texts = docs.where(~L.held_out(docs.doc_id, 7, 2)).select("text")
    segments = L.materialise(texts.mapInArrow(L._segments(spark.sparkContext.broadcast((m, words))), L.SEGMENT_COLUMNS), "segments")
    rows = segments.collect()
    assert len(rows) == sum(-(-len(t) // L.SEGMENT) for t in train) and sum(r.opens for r in rows) == len(train)
    ids = sum(1 if w == L.END else len(s.one(w)) for t in train for w in t)
    assert sum(len(r.rows) for r in rows) == 2 * ids and sum(np.frombuffer(r.sizes, "<i4").sum() for r in rows) == ids
    places = {w: i for i, w in enumerate(words)}
    assert sorted(c for r in rows for c in np.frombuffer(r.codes, "<i4").tolist()) == sorted(places.get(w, -1) for t in train for w in t)

    kinds = np.random.default_rng(0).normal(size=(len(m.group), L.KINDS))
    batches = [pa.RecordBatch.from_pylist([r.asDict() for r in rows[at : at + 37]], pa.schema(
        [("opens", pa.bool_()), ("rows", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary())])) for at in range(0, len(rows), 37)]
    scored = ids - sum(np.frombuffer(r.rows, "<u2").size > 0 and not r.opens for r in rows)  # a segment's first id has nothing before it
    before, value = m.parameters(), type("Broadcast", (), {"value": m})
    for held in (1 << 20, 500):
        L.BLOCK_IDS, kept = held, L.BLOCK_IDS
        try:
            (out,) = L._trained(value, kinds, 0.01, 0)(b.select(["opens", "rows"]) for b in batches)
            lift = type("Broadcast", (), {"value": (np.ones(len(words), np.int64), np.ones((len(words), L.KINDS), np.float32))})
            (share,) = L._mixture(value, lift)(b.select(["rows", "sizes", "codes"]) for b in batches)
        finally:
            L.BLOCK_IDS = kept
        assert set(out.column(1).to_pylist()) == {float(scored)}
        assert share.column(1).to_pylist() == [float(sum(map(len, train)))]
        assert (m.parameters() == before).all()  # every block starts from the same model
