"""Scores of texts under a causal self-attention model on subword ids, trained in numpy on the corpus itself.

Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased, and every text ends with one end token.  A word's
subword ids are those of a space and the word, so a text's ids can be read back as its words, and the product of their
probabilities is a probability of the text.

Model.  One layer of causal self-attention over the last ids: query, key and value are rows of the current and earlier
ids, a bias per distance is added, and what is attended to joins the row of the current id.  The result gives the
probability of the next id's *class* (the id within its class follows from the corpus count of (id, next id)) and of the
text's *kind*.  Texts are
laid out in windows of ``CONTEXT + STRIDE`` ids that overlap by ``CONTEXT``; a window scores its last ``STRIDE`` ids, so
each id is scored once, with at least ``CONTEXT`` ids before it (or the start of the text).

Ids that open a word are told from those that go on, so the network also says how likely a word ends.  A word's
probability mixes two, each of which sums to at most one over all words:

* the product of its ids' probabilities and that of its end (its first id among those that open words);
* for frequent words, its share of the training tokens of a text's kind, over the kinds that the network expects.

Learning, all of it from training rows, and all of it growing with them:

* every word is counted; ids, (id, next id), first and last ids of words are counted from the counted words;
* ids' classes, their distribution within a class, and the first rows of the network follow from these counts;
* all texts are cut into segments of ``SEGMENT`` words, and every segment takes part in every pass of what follows;
* the kinds are a mixture of ``KINDS`` id distributions, fitted to the segments by expectation maximisation;
* in every round Adam runs over each ``BLOCK_IDS`` ids of a task's segments from the same start, and the results are
  averaged by their number of ids (grouped by pieces of the parameters, so no task holds more than one piece of all tasks'
  results);
* the mixture's share is fitted to the segments (expectation maximisation over each ``BLOCK_IDS`` ids, averaged), where a
  word's own occurrence is left out of its count.

Frequent words are sent to every task.  A word of b bytes is frequent if it makes up ``(32 + b) / FREQUENT_BYTES`` of all
tokens, so that together they never take more than ``FREQUENT_BYTES``, whatever the input.  All other words of a text are
joined with the counts over the cluster, one row per text and different word, so the base score is exact.

Defined cases: a null text is empty, an empty text is one end token; a null id counts as a training row; rows that share
an id are scored each; an empty table gives an empty result; without training rows every id is equally likely and the
base score uses N = V = 0; extra columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.common import materialise, sliced, utf8
from urlsieve.llm.quality import held_out

#: Ids a window takes up before those it scores, and ids it scores.
CONTEXT, STRIDE = 16, 16
WIDTH = CONTEXT + STRIDE
#: Width of the model, classes of ids, and ids with rows of their own (the others share one).
DIMS, CLASSES, SINGLE, SLOTS, KINDS = 8, 64, 40, 1023, 8
VALUES = DIMS + KINDS
#: Words of a training segment, rounds, windows of a gradient step, ids of the segments that a task holds at a time.
SEGMENT, ROUNDS, STEP, BLOCK_IDS = 48, 2, 256, 1 << 20
#: Passes that fit the kinds, and the weight of the kind in the loss.
KIND_ROUNDS, KIND_LOSS = 10, 0.3
FREQUENT_BYTES = 1 << 26
#: Words that a counting task holds at a time, windows scored at a time, characters of a word encoded at a time.
HELD, CHUNK, PART = 800_000, 512, 64
#: Segments whose rows are counted at a time.
COUNTED = 250
#: Rows and bytes of text scored at a time.
SCORE_ROWS, SCORE_BYTES = 1000, 2 << 20
#: Pseudo-counts of the class given the id before, and of the id in its class.
PRIOR_CLASS, PRIOR_ID = 20.0, 5.0
PIECE = 256
END = b""  # stands for the end token among words


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Pre-token pattern that belongs to the ranks.  Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Speller:
    """Subword ids of words."""

    _made: dict[str, Speller] = {}

    @classmethod
    def of(cls, path: str) -> Speller:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.size, self.feed = max(self.ranks.values()) + 1, self.ranks[b"\n"]

    def one(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        ids = self.encoding.encode_ordinary(" " + text[:PART])
        for at in range(PART, len(text), PART):
            ids += self.encoding.encode_ordinary(text[at : at + PART])
        return ids

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn, and how many each has.  No word holds a line feed, so one ends each."""
        if words and max(map(len, words)) <= PART:
            text = (b" " + b"\n ".join(words) + b"\n").decode("utf-8", "replace")
            ids = np.array(self.encoding.encode_ordinary(text), np.int64)
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) == len(words):
                return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
        each = list(map(self.one, words))
        return np.array([i for x in each for i in x], np.int64), np.array(list(map(len, each)), np.int64)


# ---------------------------------------------------------------- counting


_FOLD = np.arange(256, dtype=np.uint8)     # A-Z in lower case, white space as spaces
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def coded_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Number of each word of all texts in turn, the different words by number, and the words of each text.  The end, which
    each text has after its words, is number 0."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"").take(pa.array(np.arange(len(texts))))
    _, ends, data = texts.buffers()
    folded = _FOLD[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    folded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, ends, pa.py_buffer(folded)])
    parts = pc.split_pattern(folded, " ")
    coded = parts.flatten().dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64) + 1
    # by one join and split, as no word holds a space; the empty word between two spaces is not END's number
    joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(b" ", pa.large_binary()))[0].as_py()
    distinct = [END, *(joined.split(b" ") if len(coded.dictionary) else [])]
    sizes = parts.value_lengths().to_numpy().astype(np.int64)
    empty = np.array([i for i, w in enumerate(distinct) if i and not w], np.int64)
    real = number != (empty[0] if len(empty) else -1)
    kept = np.r_[0, np.cumsum(real)]
    last = np.cumsum(sizes)
    sizes = kept[last] - kept[last - sizes]
    return np.insert(number[real], np.cumsum(sizes), 0), distinct, sizes + 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, held out) to (word, times in training rows, times in all rows)."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("n", pa.int64())])
    held: dict[bytes, tuple[int, int]] = {}

    def flush() -> pa.RecordBatch:
        c, n = zip(*held.values(), strict=True)
        words = pa.array(list(held), pa.binary())
        held.clear()
        return pa.RecordBatch.from_arrays([words, pa.array(c, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    for batch in sliced(batches, rows=4000):
        if not batch.num_rows:
            continue
        number, distinct, sizes = coded_words(batch.column(0))
        train = ~batch.column(1).to_numpy(zero_copy_only=False)
        n = np.bincount(number, minlength=len(distinct))
        c = np.bincount(number[np.repeat(train, sizes)], minlength=len(distinct))
        none = (0, 0)
        for w, a, b in zip(distinct, c.tolist(), n.tolist(), strict=True):
            if b:
                x, y = held.get(w, none)
                held[w] = x + a, y + b
        if len(held) > HELD:
            yield flush()
    if held:
        yield flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """Written table (word, c, n) of all words: times in training rows and in all rows."""
    texts = docs.select(F.col(text_col).alias("t"), held_out(F.col(id_col), folds, fold).alias("h"))
    counted = texts.mapInArrow(_counted, "word binary, c long, n long")
    return materialise(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")


def _pairs(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, times) to (id, next id, times): -1 before a word's first id and after its last."""
        speller = Speller.of(path)
        keys, times, held = [], [], 0
        size = speller.size + 1

        def flush() -> pa.RecordBatch:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(times)).astype(np.int64)
            keys.clear()
            times.clear()
            return pa.RecordBatch.from_arrays([pa.array(key // size - 1), pa.array(key % size - 1), pa.array(n)], names=["a", "b", "n"])

        for batch in sliced(batches, rows=50_000):
            ids, lengths = speller.many(batch.column(0).to_pylist())
            n = batch.column(1).to_numpy()
            some = lengths > 0
            n, lengths = n[some], lengths[some]
            ends = np.cumsum(lengths)
            before, after = np.r_[-1, ids[:-1]], np.r_[ids[1:], -1]
            before[ends - lengths] = -1
            last = ends - 1
            keys += [(before + 1) * size + ids + 1, (ids[last] + 1) * size]
            times += [np.repeat(n, lengths), n]
            held += len(ids)
            if held > 2_000_000:
                keys[:], times[:], held = [np.concatenate(keys)], [np.concatenate(times)], 0
                yield flush()
        if keys:
            yield flush()

    return rows


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """``slot``: row of each id (0: all others that go on, then own rows, all others that open a word, the end, the start).
    ``group``: class of each row.  ``opening``: whether a class is of ids that open a word, or the end."""

    path: str
    slot: np.ndarray
    group: np.ndarray
    opening: np.ndarray
    inside: np.ndarray  # log probability of (row before, row) within the row's class
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    h: np.ndarray
    u: np.ndarray
    b: np.ndarray
    r: np.ndarray  # bias per distance
    uk: np.ndarray  # to the kinds
    bk: np.ndarray

    NAMES = ("q", "k", "v", "h", "u", "b", "r", "uk", "bk")

    @property
    def end(self) -> int:
        return len(self.group) - 2

    @property
    def start(self) -> int:
        return len(self.group) - 1

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float32)

    def with_parameters(self, flat: np.ndarray) -> Model:
        values, at = {}, 0
        for n in self.NAMES:
            old = getattr(self, n)
            values[n] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return Model(self.path, self.slot, self.group, self.opening, self.inside, **values)

    def bounded(self) -> Model:
        """The same with rows short enough that no exponential overflows: |q k| <= 36, |r| <= 8, |logit| <= 64
        (kinds subtract the largest)."""

        out = Model(self.path, self.slot, self.group, self.opening, self.inside, *(np.array(getattr(self, n)) for n in self.NAMES))
        out.bound()
        return out.with_parameters(out.parameters())

    def bound(self) -> None:
        """The same in place."""
        for n, most in (("q", 6.0), ("k", 6.0), ("v", 6.0), ("h", 6.0), ("u", 4.0), ("uk", 16.0)):
            rows = getattr(self, n) if n in "qkvh" else getattr(self, n).T
            rows *= np.minimum(1, most / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9))
        for n, most in (("b", 16), ("r", 8), ("bk", 16)):
            np.clip(getattr(self, n), -most, most, out=getattr(self, n))

    def over(self, flat: np.ndarray) -> Model:
        """A model whose parameters are views of ``flat``, which is as ``parameters`` gives it."""
        ends = np.cumsum([getattr(self, n).size for n in self.NAMES])
        parts = zip(self.NAMES, np.split(flat, ends[:-1]), strict=True)
        return Model(self.path, self.slot, self.group, self.opening, self.inside, **{n: x.reshape(getattr(self, n).shape) for n, x in parts})

    def bias(self) -> np.ndarray:
        distance = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(WIDTH)[None, :]
        return np.where(distance >= 0, self.r[np.maximum(distance, 0)], np.float32(-1e9)).astype(np.float32)

    def log_probabilities(self, x: np.ndarray, y: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural logs of the probability of row ``y[i]`` after the rows up to ``x[i]``, and of any row that opens a word; and
        the probabilities of the kinds at the places ``asked`` (ascending).  ``x`` and ``y`` are whole strides; the window of a stride starts ``CONTEXT`` earlier, and the first stride's
        result is without meaning."""
        windows = len(x) // STRIDE - 1
        out, opens = np.zeros(len(x), np.float32), np.zeros(len(x), np.float32)
        kinds = [np.zeros((0, KINDS), np.float32)]
        bias, width, single = self.bias(), len(self.group), np.float32(1)
        values = np.column_stack([self.v, np.full(width, single)])     # the last column adds up the weights
        sums = np.column_stack([self.opening, np.full(len(self.opening), True)]).astype(np.float32)
        inside, group = self.inside.ravel(), self.group.astype(np.int32)
        classes = np.arange(CHUNK * STRIDE, dtype=np.int64) * len(self.opening)
        for low in range(0, windows, CHUNK):
            n = min(CHUNK, windows - low)
            seen = x[low * STRIDE : (low + n) * STRIDE + CONTEXT]
            now = slice((low + 1) * STRIDE, (low + 1 + n) * STRIDE)
            current, then = x[now], y[now]
            kw, vw = (np.lib.stride_tricks.as_strided(t, (n, WIDTH, t.shape[1]), (STRIDE * t.strides[0], *t.strides), writeable=False)
                      for t in (self.k.take(seen, axis=0), values.take(seen, axis=0)))
            a = np.matmul(self.q.take(current, axis=0).reshape(n, STRIDE, DIMS), kw.transpose(0, 2, 1))
            a += bias
            np.exp(a, out=a)
            added = np.matmul(a, vw).reshape(-1, VALUES + 1)
            state = added[:, :VALUES] / added[:, VALUES:]
            state += self.h.take(current, axis=0)
            here = asked[slice(*np.searchsorted(asked, (now.start, now.stop)))]
            kinds.append(_softmax(state.take(here - now.start, axis=0) @ self.uk + self.bk))
            logits = state @ self.u
            logits += self.b
            picked = logits.ravel().take(classes[: len(then)] + group.take(then))
            np.exp(logits, out=logits)
            total = np.log(logits @ sums)
            out[now] = picked - total[:, 1] + inside.take(current * np.int64(width) + then)
            opens[now] = total[:, 0] - total[:, 1]
        return out, opens, np.concatenate(kinds)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def layout(rows: np.ndarray, sizes: np.ndarray, start: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of texts as whole strides, and the place of each row.  Before each text comes a stride of
    ``start``, so windows never reach into another text."""
    strides = -(-sizes // STRIDE) + 1
    base = (np.cumsum(strides) - strides) * STRIDE
    total = int(strides.sum()) * STRIDE
    place = np.arange(len(rows)) + np.repeat(base + STRIDE - (np.cumsum(sizes) - sizes), sizes)
    x, y = np.full(total + 1, start, np.int32), np.zeros(total, np.int32)
    y[place] = rows
    x[place + 1] = rows
    x[base] = start
    return x[:total], y, place


def _classes(rows: np.ndarray, weight: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of ``rows``: a number below ``many`` each."""
    if len(rows) <= many:
        return np.arange(len(rows))
    centres = rows[np.argsort(-weight, kind="stable")[:many]].copy()
    for _ in range(12):
        near = np.argmin((centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T, axis=1)
        for j in range(many):
            own = near == j
            if own.any():
                centres[j] = np.average(rows[own], axis=0, weights=weight[own])
    return near


def initial_model(path: str, ids: np.ndarray, opens: np.ndarray, pairs: np.ndarray, first: np.ndarray, last: np.ndarray, ends: float,
                  seed: int = 42) -> Model:
    """The model that the counts give.

    ``ids`` are those with rows of their own, ``opens`` whether an id (of all) opens a word; ``pairs[a, b]`` counts row b
    after row a within words, ``first`` and ``last`` count rows at a word's start and end, ``ends`` counts ends.
    """
    rng = np.random.default_rng(seed)
    own = len(ids)
    rows, other, end, start = own + 4, own + 1, own + 2, own + 3
    slot = np.where(opens, other, 0).astype(np.int32)
    slot[ids] = np.arange(1, own + 1)
    opener = np.zeros(rows, bool)
    opener[1 : own + 1], opener[[other, end]] = opens[ids], True
    count = np.r_[pairs.sum(axis=0) + first, ends, 0.0]

    group = np.zeros(rows, np.int64)
    single = min(SINGLE, own)
    group[1 : single + 1] = np.arange(1, single + 1)
    group[other], group[end] = single + 1, single + 2
    made = single + 3
    rest = np.arange(single + 1, own + 1)
    turn = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    turned = np.sqrt(pairs / np.maximum(pairs.sum(axis=0, keepdims=True), 1)).T
    features = np.concatenate([turn, turned], axis=1) @ (rng.normal(size=(2 * len(pairs), 32)) / np.sqrt(32))
    half = (CLASSES - SINGLE - 3) // 2
    for kind in (True, False):
        some = rest[opener[rest] == kind]
        if len(some):
            near = np.unique(_classes(features[some], count[some], half, rng), return_inverse=True)[1]
            group[some] = made + near
            made += int(near.max()) + 1
    opening = np.zeros(made, bool)
    opening[group[opener]] = True

    in_class = np.zeros((rows, made))
    in_class[np.arange(rows), group] = 1
    in_class[start] = 0  # the start is never predicted
    share = count + 0.5
    share = share / (in_class.T @ share)[group]  # of the row in its class
    after = np.zeros((rows, rows))
    after[:end, :end] = pairs
    inside = np.log((after + PRIOR_ID * share[None, :]) / ((after @ in_class)[:, group] + PRIOR_ID)).astype(np.float32)
    inside[:, 0] -= np.log(max((~opens).sum() - (~opens[ids]).sum(), 1))  # the ids of a shared row are equally likely
    inside[:, other] -= np.log(max(opens.sum() - opens[ids].sum(), 1))
    inside[:, start] = 0

    openings = np.r_[first, ends, 0.0] + 1e-3 * opener
    openings /= openings.sum()
    total = (count + 0.5) @ in_class / (count + 0.5).sum()
    closing = np.r_[last, 1.0, 1.0]
    nexts = after @ in_class + closing[:, None] * (openings @ in_class)[None, :]
    chance = (nexts + PRIOR_CLASS * total) / (nexts.sum(axis=1, keepdims=True) + PRIOR_CLASS)
    b = np.log(np.maximum(total, 1e-6))
    weight = np.sqrt(count + 1)
    left, scale, right = np.linalg.svd(weight[:, None] * (np.log(chance) - b), full_matrices=False)
    d = min(DIMS, len(scale))
    h, u = np.zeros((rows, VALUES)), np.zeros((VALUES, made))
    h[:, :d], u[:d] = left[:, :d] * scale[:d] / weight[:, None], right[:d]
    balance = np.sqrt(max(np.abs(u).max(), 1e-6) / max(np.percentile(np.abs(h), 99), 1e-6))
    h, u = h * balance, u / balance

    def small(scale: float, width: int) -> np.ndarray:
        return rng.normal(0, scale, (rows, width))

    return Model(path, slot, group, opening, inside, small(0.3, DIMS), small(0.3, DIMS), small(0.02, VALUES), h, u, b, np.zeros(WIDTH),
                 np.zeros((VALUES, KINDS)), np.zeros(KINDS)).bounded()


def with_kinds(m: Model, kinds: np.ndarray, weight: np.ndarray) -> Model:
    """The model whose last values of a row say how much likelier each kind makes it: spread over a window, they are what a
    naive Bayes classifier of the kinds adds up.  ``kinds`` are logs of the rows' probabilities, ``weight`` the kinds' own."""
    v = m.v.copy()
    v[:, DIMS:] = np.clip(kinds - kinds.mean(axis=1, keepdims=True), -2, 2)
    v[[m.end, m.start], DIMS:] = 0
    uk = np.zeros((VALUES, KINDS))
    uk[DIMS:] = 8 * np.eye(KINDS)
    changed = dict(zip(m.NAMES, (getattr(m, n) for n in m.NAMES), strict=True)) | {"v": v, "uk": uk, "bk": np.log(weight + 1e-3)}
    return Model(m.path, m.slot, m.group, m.opening, m.inside, **changed).bounded()


class Room:
    """Arrays that one step leaves to the next, by name: a step would take and return some 10 MB of memory otherwise."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
        if name not in self.held or self.held[name].shape != shape:
            self.held[name] = np.empty(shape, kind)
        return self.held[name]


def _scatter(index: np.ndarray, values: list[np.ndarray], rows: int, room: Room) -> Iterator[np.ndarray]:
    """Sums of each array's last axis by the index, which has the other axes."""
    at = index.ravel()
    for x in values:
        flat = x.reshape(len(at), -1)
        columns = room(f"columns {flat.shape}", *flat.shape[::-1], kind=np.float64)
        np.copyto(columns, flat.T)
        yield np.array([np.bincount(at, c, rows) for c in columns], np.float32).T


def gradients(m: Model, x: np.ndarray, y: np.ndarray, use: np.ndarray, kind: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the targets in use (negative log probability of the class and, weighted, of the kind) and its gradients.

    ``x`` is (windows, WIDTH), ``y`` and ``use`` (windows, STRIDE), ``kind`` (windows)."""
    room, n = room or Room(), len(x)
    x = x.astype(np.intp)
    now = np.ascontiguousarray(x[:, CONTEXT:])
    ones = np.ones((WIDTH, 1), np.float32)

    def rows_of(name: str, at: np.ndarray) -> np.ndarray:
        table = getattr(m, name)
        return table.take(at, axis=0, out=room(name, *at.shape, table.shape[1]), mode="clip")  # all are in range; "raise" copies

    q, k, v = rows_of("q", now), rows_of("k", x), rows_of("v", x)
    a = np.matmul(q, k.transpose(0, 2, 1), out=room("a", n, STRIDE, WIDTH))
    a += m.bias()
    np.exp(a, out=a)
    a /= np.matmul(a, ones)
    state = np.matmul(a, v, out=room("state", n, STRIDE, VALUES))
    state += rows_of("h", now)
    state = state.reshape(-1, VALUES)
    used = (use.ravel() / max(use.sum(), 1)).astype(np.float32)
    at = np.arange(used.size)
    loss, outs = 0.0, []
    for out, bias, target, scale in ((m.u, m.b, m.group.take(y).ravel(), 1.0), (m.uk, m.bk, np.repeat(kind, STRIDE), KIND_LOSS)):
        # classes by places, as numpy adds and compares long rows faster
        p = np.matmul(out.T, state.T, out=room("p" if out is m.u else "pk", len(bias), used.size))
        p += bias[:, None]
        if out is m.uk:  # the others are bounded
            p -= p.max(axis=0)
        np.exp(p, out=p)
        p *= 1 / p.sum(axis=0)
        place = target * used.size + at
        own = p.ravel().take(place)
        loss -= scale * float((np.log(own + 1e-30) * used).sum())
        p.ravel()[place] = own - 1
        p *= np.float32(scale) * used
        outs.append(p)
    p, pk = outs
    dstate = np.matmul(m.u, p, out=room("dstate", VALUES, used.size))
    dstate += m.uk @ pk
    dstate = dstate.T.reshape(-1, STRIDE, VALUES)
    ds = np.matmul(dstate, v.transpose(0, 2, 1), out=room("ds", n, STRIDE, WIDTH))
    ds -= np.matmul(np.multiply(a, ds, out=room("ads", n, STRIDE, WIDTH)), ones)
    ds *= a
    distance = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(WIDTH)[None, :]
    rows = len(m.group)
    h, dq = _scatter(now, [dstate, np.matmul(ds, k, out=room("dq", n, STRIDE, DIMS))], rows, room)
    dk, dv = _scatter(x, [np.matmul(ds.transpose(0, 2, 1), q, out=room("dk", n, WIDTH, DIMS)),
                          np.matmul(a.transpose(0, 2, 1), dstate, out=room("dv", n, WIDTH, VALUES))], rows, room)
    return loss, {
        "u": (p @ state).T, "b": p.sum(axis=1), "uk": (pk @ state).T, "bk": pk.sum(axis=1),
        "h": h, "q": dq, "k": dk, "v": dv,
        "r": np.bincount(np.maximum(distance, 0).ravel(), (ds.sum(axis=0) * (distance >= 0)).ravel(), WIDTH).astype(np.float32),
    }


def adam(m: Model, x: np.ndarray, y: np.ndarray, use: np.ndarray, kind: np.ndarray, rate: float, seed: int) -> Model:
    """One pass over the windows in steps of ``STEP``, with a rate that falls to a tenth."""
    order = np.random.default_rng(seed).permutation(len(x))
    flat = m.parameters()
    m = m.over(flat)  # a copy: other blocks start from the given one
    first, second, g, step, root = (np.zeros_like(flat) for _ in range(5))
    room, steps = Room(), -(-len(x) // STEP)
    for t in range(1, steps + 1):
        some = order[(t - 1) * STEP : t * STEP]
        _, grads = gradients(m, x[some], y[some], use[some], kind[some], room)
        np.concatenate([grads[n].ravel() for n in m.NAMES], out=g)
        now = rate * (1 - 0.9 * (t - 1) / steps)
        np.subtract(g, first, out=step)
        step *= 0.1
        first += step
        g *= g
        g -= second
        g *= 0.01
        second += g
        np.divide(first, 1 - 0.9**t, out=step)
        step *= now
        np.divide(second, 1 - 0.99**t, out=root)
        np.sqrt(root, out=root)
        root += 1e-6
        step /= root
        flat -= step
        m.bound()
    return m


# ---------------------------------------------------------------- training over the cluster


def spelled(m: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all words' ids in turn, and how many each word has."""
    real = np.array([w != END for w in words], bool)
    ids, lengths = Speller.of(m.path).many([w for w in words if w != END])
    n = np.ones(len(words), np.int64)
    n[real] = lengths
    rows = np.full(int(n.sum()), m.end, np.int32)
    rows[np.repeat(real, n)] = m.slot[ids]
    return rows, n


def _packed(values: np.ndarray, per: np.ndarray) -> pa.Array:
    """``per[i]`` of the values, in turn, as the i-th binary value."""
    ends = np.r_[0, np.cumsum(per) * values.itemsize].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all binary values in turn, and how many each has."""
    column, size = column.cast(pa.binary()), np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], kind, (ends[-1] - ends[0]) // size, ends[0]), np.diff(ends) // size


def _spans(first: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the stretches ``which`` of a flat array, in turn."""
    n = size[which]
    ends = np.cumsum(n)
    return np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class Reader:
    """What a process needs to read texts as rows of ids: the frequent words, spelled once."""

    _last: tuple | None = None

    @classmethod
    def of(cls, payload: tuple) -> Reader:
        """The reader of a broadcast value, made once a process, which holds the last one only."""
        if Reader._last is None or Reader._last[0] is not payload:
            Reader._last = None
            Reader._last = payload, cls(*payload)
        return Reader._last[1]

    def __init__(self, m: Model, words: list[bytes]):
        self.m, self.index = m, dict(zip(words, range(len(words)), strict=True))
        self.rows, self.sizes = spelled(m, words)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Words of each text; number of each word in turn (its place in ``index``, from the index's size on in the last list),
        and how many ids it has; rows of all ids in turn; the words outside the index."""
        number, distinct, sizes = coded_words(texts)
        of = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero((of < 0) & (np.bincount(number, minlength=len(distinct)) > 0))
        rare = [distinct[i] for i in new.tolist()]
        of[new] = len(self.index) + np.arange(len(new))
        code = of[number]
        more, more_sizes = spelled(self.m, rare)
        size = np.r_[self.sizes, more_sizes]
        return sizes, code, size[code], np.r_[self.rows, more][_spans(np.cumsum(size) - size, size, code)], rare


SEGMENT_COLUMNS = "opens boolean, rows binary, sizes binary, codes binary"


def _segments(payload):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to segments: whether one opens its text, the rows of its ids (16 bits each), how many each word has and the
        word's place among the frequent ones or -1 (32 bits each)."""
        reader = Reader.of(payload.value)
        for batch in sliced(batches, rows=SCORE_ROWS, size=SCORE_BYTES):
            if not batch.num_rows:
                continue
            words, code, per_word, ids, _ = reader.read(batch.column(0))
            many = -(-words // SEGMENT)
            last = np.cumsum(many) - 1
            per = np.full(many.sum(), SEGMENT)
            per[last] = words - (many - 1) * SEGMENT
            opens = np.zeros(len(per), bool)
            opens[last - many + 1] = True
            per_segment = np.add.reduceat(per_word, np.cumsum(per) - per)
            code = np.where(code < len(reader.index), code, -1)
            yield pa.RecordBatch.from_arrays([pa.array(opens), _packed(ids.astype("<u2"), per_segment), _packed(per_word.astype("<i4"), per),
                                              _packed(code.astype("<i4"), per)], names=["opens", "rows", "sizes", "codes"])

    return rows


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``BLOCK_IDS`` ids, of which ``column`` holds the rows."""
    held, size = [], 0
    for batch in sliced(batches, rows=2000):
        held.append(batch)
        size += batch.column(column).nbytes // 2
        if size >= BLOCK_IDS:
            yield pa.concat_batches(held)
            held, size = [], 0
    if size:
        yield pa.concat_batches(held)


def _row_counts(rows: np.ndarray, per: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """How often each segment has each row, some segments at a time (a few MB, so that products with it are fast)."""
    ends = np.r_[0, np.cumsum(per)]
    for low in range(0, len(per), COUNTED):
        n = per[low : low + COUNTED]
        at = np.repeat(np.arange(len(n)) * width, n)
        at += rows[ends[low] : ends[low + len(n)]]
        yield np.bincount(at, minlength=len(n) * width).reshape(-1, width).astype(np.float64)


def _windows(m: Model, rows: np.ndarray, per: np.ndarray, opens: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all segments: inputs, targets, which targets count, kind.  ``opens``: whether a segment opens its text."""
    first = np.cumsum(per) - per
    kind = np.concatenate([np.argmax(c @ kinds, axis=1) for c in _row_counts(rows, per, len(kinds))])
    x, y, place = layout(rows, per, m.start)
    use, of = np.zeros(len(x), np.float32), np.zeros(len(x), np.int64)
    use[place], of[place] = 1, np.repeat(kind, per)
    use[place[first[~opens]]] = 0  # nothing is known before a segment from inside a text
    wu = use.reshape(-1, STRIDE)
    some = np.flatnonzero(wu[1:].any(axis=1)) + 1
    wx = x[(some * STRIDE - CONTEXT)[:, None] + np.arange(WIDTH)]
    return wx, y.reshape(-1, STRIDE)[some], wu[some], of[some * STRIDE]


def _kind_sums(kinds: np.ndarray, weight: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Expected counts of (kind, row) and, as row -1, of segments."""
        total, own = np.zeros((len(kinds), KINDS)), np.zeros(KINDS)
        for batch in sliced(batches, rows=2000):
            if not batch.num_rows:
                continue
            for count in _row_counts(*_unpacked(batch.column(0), "<u2"), len(kinds)):
                belongs = _softmax(count @ kinds + np.log(weight))
                total += count.T @ belongs
                own += belongs.sum(axis=0)
        if own.any():
            row, kind = np.divmod(np.arange(total.size + KINDS), KINDS)
            row[-KINDS:] = -1
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(kind), pa.array(np.r_[total.ravel(), own])], names=["row", "kind", "n"])

    return rows


def fit_kinds(segments: DataFrame, count: np.ndarray, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Logs of the rows' probabilities in each kind, and the kinds' shares.  A pass over the segments a round; the sums of a
    round are ``KINDS`` numbers a row, whatever the number of segments."""
    usual = (count + 0.5) / (count + 0.5).sum()
    kinds = np.log(usual)[:, None] + np.random.default_rng(seed).normal(0, 0.3, (len(count), KINDS))
    weight = np.full(KINDS, 1 / KINDS)
    for _ in range(KIND_ROUNDS):
        sums = segments.select("rows").mapInArrow(_kind_sums(kinds, weight), "row long, kind long, n double").groupBy("row", "kind").agg(F.sum("n").alias("n")).toPandas()
        if not len(sums):
            break
        table = np.zeros((len(count) + 1, KINDS))
        table[sums["row"].to_numpy(), sums["kind"].to_numpy()] = sums["n"].to_numpy()
        weight = (table[-1] + 1) / (table[-1] + 1).sum()
        near = table[:-1] + 20 * usual[:, None]
        kinds = np.log(near / near.sum(axis=0))
    return kinds, weight


def _trained(model, kinds: np.ndarray, rate: float, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = 0.0, 0.0
        for batch in _blocks(batches, 1):
            r, per = _unpacked(batch.column(1), "<u2")
            windows = _windows(model.value, r, per, batch.column(0).to_numpy(zero_copy_only=False), kinds)
            own = float(windows[2].sum(dtype=np.float64))
            if own:
                total = total + own * adam(model.value, *windows, rate, seed).parameters().astype(np.float64)
                weight += own
        if not weight:
            return
        flat = total / weight
        flat = np.pad(flat, (0, -len(flat) % PIECE)).reshape(-1, PIECE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat))), pa.array(np.full(len(flat), weight)), pa.array(list(flat), pa.list_(pa.float64()))],
            names=["piece", "weight", "x"])

    return rows


def _average(trained: DataFrame, m: Model) -> Model:
    """Parameters averaged over the tasks, weighted by their ids.  One row a piece reaches the driver."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(array_to_vector(F.col("x")), F.col("weight"))
    pieces = trained.groupBy("piece").agg(vector_to_array(mean).alias("x")).orderBy("piece").toPandas()
    if not len(pieces):
        return m
    return m.with_parameters(np.concatenate(pieces["x"].to_list())[: m.parameters().size]).bounded()


@dataclass
class Lexicon:
    """Frequent words with their counts, and the number of training tokens and of different ones."""

    words: list[bytes]
    c: np.ndarray
    tokens: int
    vocabulary: int
    lift: np.ndarray | None = None  # per word and kind, how much more frequent the kind makes it

    def learn(self, m: Model, kinds: np.ndarray, weight: np.ndarray) -> None:
        rows, sizes = spelled(m, self.words)
        first = np.cumsum(sizes) - sizes
        likely = np.add.reduceat(kinds[rows], first, axis=0) if len(first) else np.zeros((0, KINDS))
        likely[rows[first] == m.end] = 0
        belongs = _softmax(likely + np.log(weight)) if len(first) else likely
        share = (self.c / max(self.c.sum(), 1)) @ belongs
        self.lift = (belongs / np.maximum(share, 1e-12)).astype(np.float32)  # frequencies times lift sum to one in each kind


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(x, out=np.full(len(x), -np.inf), where=np.asarray(x) > 0)


def word_terms(m: Model, rows: np.ndarray, per_text: np.ndarray, per_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: log probability of its ids and its end, and the kinds' probabilities before it.  ``rows`` are
    the ids' rows in turn, ``per_text`` and ``per_word`` how many each text and word has."""
    x, y, place = layout(rows, per_text, m.start)
    first = np.cumsum(per_word) - per_word
    lp, opens, kinds = m.log_probabilities(x, y, place[first])
    lp, opens = lp[place], opens[place]
    goes_on = np.ones(len(rows) + 1, bool)  # whether the next id belongs to the same text
    goes_on[np.cumsum(per_text) - per_text] = False
    goes_on[-1] = False
    after = np.r_[opens, np.float32(0)][first + per_word] * goes_on[first + per_word]
    return np.add.reduceat(lp, first, dtype=np.float64) - opens[first] + after, kinds


def _mixture(model, lexicon, rounds: int = 30):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The share of word frequencies that suits this task's segments, times their words, and their words."""
        m, (c, lift) = model.value, lexicon.value
        fitted = words = 0.0
        for block in _blocks(batches, 0):
            a, b = [], []
            for batch in sliced([block], rows=2000):
                (r, per), (per_word, _), (code, _) = (_unpacked(batch.column(i), kind) for i, kind in enumerate(("<u2", "<i4", "<i4")))
                whole, kinds = word_terms(m, r.astype(np.int32), per, per_word.astype(np.int64))
                left = np.where(code >= 0, c[code] - 1, 0)  # there are segments, so there are words
                a.append(np.exp(whole))
                b.append(left / max(c.sum(), 1) * np.einsum("ij,ij->i", lift[code], kinds))
            a, b = np.concatenate(a), np.concatenate(b)
            share = 0.5
            for _ in range(rounds):
                share = float(np.mean(share * b / (share * b + (1 - share) * a + 1e-300)))
            fitted += share * len(a)
            words += len(a)
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([fitted]), pa.array([words])], names=["share", "n"])

    return rows


@dataclass
class LanguageModel:
    model: Model
    lexicon: Lexicon
    share: float  # of word frequencies in the mixture
    counts: DataFrame  # (word, c) of all words, written


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, folds: int = 7, fold: int = 2,
          rounds: int = ROUNDS, rate: float = 0.02) -> LanguageModel:
    """Learn from the rows outside the held-out fold.  ``tokenizer`` names a file of byte-pair ranks that every executor can read."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    counts = word_counts(docs, id_col, text_col, folds, fold)
    sums = counts.agg(F.sum("c").alias("tokens"), F.count(F.when(F.col("c") > 0, 1)).alias("words"), F.sum("n").alias("n")).first()
    tokens, vocabulary, everything = sums.tokens or 0, sums.words, sums.n or 0
    frequent = counts.where((F.col("n").cast("double") * FREQUENT_BYTES >= F.lit(float(everything)) * (F.octet_length("word") + 32)) | (F.col("word") == F.lit(END)))
    got = frequent.orderBy(F.desc("n"), "word").toPandas()  # at most FREQUENT_BYTES, see above
    c = got["c"].to_numpy(np.int64)
    lexicon = Lexicon([bytes(w) for w in got["word"]], c, tokens, vocabulary)

    pairs = materialise(counts.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word", "c").mapInArrow(
        _pairs(path), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    speller = Speller.of(path)
    top = pairs.where("b >= 0").groupBy("b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "b").limit(SLOTS).toPandas()
    ids = top["b"].to_numpy(np.int64)
    own = len(ids)
    slots = F.broadcast(spark.createDataFrame([(int(i), k + 1) for k, i in enumerate(ids)], "id long, row int"))  # SLOTS rows at most
    left, right = slots.select(F.col("id").alias("a"), F.col("row").alias("ra")), slots.select(F.col("id").alias("b"), F.col("row").alias("rb"))
    by_row = pairs.join(left, "a", "left").join(right, "b", "left")
    bytes_of = {v: k for k, v in speller.ranks.items()}
    opens = np.array([bytes_of.get(i, b"").startswith(b" ") for i in range(speller.size)], bool)
    before = F.when(F.col("a") < 0, -1).otherwise(F.coalesce("ra", F.lit(0)))  # only a word's first id opens it
    opened = F.when(F.col("a") < 0, own + 1).otherwise(0)
    by_row = by_row.select(before.alias("ra"), F.when(F.col("b") < 0, -1).otherwise(F.coalesce("rb", opened)).alias("rb"), "n")
    by_row = by_row.groupBy("ra", "rb").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((own + 3, own + 3))  # place -1 is before or after the word; (SLOTS + 3) ** 2 cells at most
    table[by_row["ra"].to_numpy(), by_row["rb"].to_numpy()] = by_row["n"].to_numpy()
    ends = float(dict(zip(lexicon.words, c.tolist(), strict=True)).get(END, 0))
    m = initial_model(path, ids, opens, table[:-1, :-1], table[-1, :-1], table[:-1, -1], ends)

    sc = spark.sparkContext
    texts = docs.where(~held_out(F.col(id_col), folds, fold)).select(F.col(text_col).alias("t"))
    segments = materialise(texts.mapInArrow(_segments(sc.broadcast((m, lexicon.words))), SEGMENT_COLUMNS), "segments")
    kinds, weight = fit_kinds(segments, np.bincount(np.arange(own + 4), np.r_[table[:-1, :-1].sum(axis=0) + table[-1, :-1], ends, 0.0]))
    lexicon.learn(m, kinds, weight)
    m = with_kinds(m, kinds, weight)
    for k in range(rounds):
        m = _average(segments.select("opens", "rows").mapInArrow(_trained(sc.broadcast(m), kinds, rate / (1 + k), k), "piece long, weight double, x array<double>"), m)
    fitted = segments.select("rows", "sizes", "codes").mapInArrow(_mixture(sc.broadcast(m), sc.broadcast((lexicon.c, lexicon.lift))), "share double, n double")
    fitted = fitted.agg(F.sum("share").alias("share"), F.sum("n").alias("n")).first()
    share = min(fitted.share / fitted.n, 0.99) if fitted.n else 0.0  # something is left for words never seen
    return LanguageModel(m, lexicon, share, counts)


# ---------------------------------------------------------------- scoring


class Scorer(Reader):
    """What a process needs to score texts."""

    def __init__(self, m: Model, lex: Lexicon, share: float):
        super().__init__(m, lex.words)
        self.frequency = (share * lex.c[:, None] / max(lex.c.sum(), 1) * lex.lift).astype(np.float32)
        self.log_rest = np.log1p(-share)
        self.log_c, self.known = np.log10(lex.c + 1.0), lex.c > 0

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Per text: words, known frequent words, their sum of log10(c + 1), score; the other words; and per text and other
        word: text, word, times."""
        sizes, code, per_word, rows, rare = self.read(texts)
        many = len(self.index)
        first = np.cumsum(sizes) - sizes
        of_word, kinds = word_terms(self.m, rows, np.add.reduceat(per_word, first), per_word)
        of_word += self.log_rest
        common = code < many
        frequent = code[common]
        of_word[common] = np.logaddexp(of_word[common], _log(np.einsum("ij,ij->i", self.frequency[frequent], kinds[common])))
        score = np.add.reduceat(of_word, first) / np.log(10)
        log_c, known = np.zeros(len(code)), np.zeros(len(code), np.int64)
        log_c[common], known[common] = self.log_c[code[common]], self.known[code[common]]
        other = ~common
        pair, times = np.unique(np.repeat(np.arange(len(texts)), sizes)[other] * max(len(rare), 1) + code[other] - many, return_counts=True)
        return sizes, np.add.reduceat(known, first), np.add.reduceat(log_c, first), score, rare, pair // max(len(rare), 1), pair % max(len(rare), 1), times


def _scored(payload):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, row = Scorer.of(payload.value), TaskContext.get().partitionId() << 40
        for batch in sliced(batches, rows=SCORE_ROWS, size=SCORE_BYTES):
            sizes, known, log_c, score, rare, text, word, times = scorer.score(batch.column(2))
            ends = np.r_[0, np.cumsum(np.bincount(text, minlength=batch.num_rows))]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in
                     (pa.array(rare, pa.binary()).take(pa.array(word, pa.int64())), pa.array(times, pa.int64()))]
            columns = [pa.array(row + np.arange(batch.num_rows)), batch.column(0), batch.column(1), pa.array(sizes), pa.array(known),
                       pa.array(log_c), pa.array(score), *lists]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "held_out", "n_tokens", "known", "log_c", "score", "words", "times"])

    return rows


def score(docs: DataFrame, learned: LanguageModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    payload = sc.broadcast((learned.model, learned.lexicon, learned.share))
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), folds, fold).alias("held_out"), F.col(text_col).alias("t"))
    scored = materialise(texts.mapInArrow(
        _scored(payload), f"row long, id {id_type}, held_out boolean, n_tokens long, known long, log_c double, score double, "
        "words array<binary>, times array<long>"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(learned.counts.where("c > 0").select("word", "c"), "word").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("more_log_c"))
    lex = learned.lexicon
    zero = F.lit(0)
    n = F.col("n_tokens")
    base = F.col("log_c") + F.coalesce("more_log_c", F.lit(0.0)) - n * F.lit(float(np.log10(lex.tokens + lex.vocabulary + 1)))
    return scored.drop("words", "times").join(found, "row", "left").select(
        F.col("id").alias(id_col), "held_out", n, (F.col("known") + F.coalesce("more_known", zero)).cast("long").alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, folds: int = 7, fold: int = 2) -> DataFrame:
    """Learn from the training rows of ``docs`` and score all of them."""
    return score(docs, train(docs, id_col, text_col, tokenizer, folds, fold), id_col, text_col, folds, fold)
