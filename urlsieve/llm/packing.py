"""Packing by cutting-stock column generation.

Texts are tokenised once.  A document's ids (with the end id) are cut into full sequences, one *body* of a whole
number of ``unit`` ids, and a *tail* shorter than a unit.  Two cutting-stock problems over length histograms then plan
all of the packing: tails into units, and bodies (with the units made of tails) into sequences.  Each is a linear
program over patterns: the simplex method prices new patterns by a knapsack dynamic program until none helps, pattern
counts are rounded down, and what is left over is packed first-fit decreasing.  The driver sees histograms only (at most
``2 * seq_len / unit`` counts), and its plan does not grow with the corpus.

Pieces of one length class are ranked over the whole corpus by counts per (class, hash bucket) and row numbers inside
the buckets; the plan gives each range of ranks its pattern, so a rank names its sequence.

Sequences are padded to ``seq_len``; as all lengths but the last tails' are whole units, nearly all are full.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; null ids are allowed; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlsieve.llm.common import materialise, sliced

SEQ_LEN = 4096
UNIT = 64
END_ID = 2
#: Cached words of one generation, and characters tokenised at a time.
CACHE_WORDS, CHUNK_CHARS = 350_000, 2_000_000

#: Latin letters that stay one letter in lower case; a word of them is one pre-token, unchanged by its neighbours.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1)
_PLAIN = re.compile(f"[{_LETTERS}]+")
#: Texts on which a tokenizer must show that it treats words one by one.
_PROBES = ("Hello  world it is", " A lead", "Trail \n", "two\nlines\n\nHere", "\u00dcn\u00efc\u00f6de \u00e9t\u00e9 n\u00fal", "Don't stop, now. (Or 12 3)", "a b c", "")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of whole texts, word by word through a bounded cache.

    Only for tokenizers that drop white space and never merge across it: a text's ids are then its words' ids in
    turn.  Words are cut at spaces and line feeds, which every such tokenizer takes as white space.  With
    ``fold_case`` (for tokenizers that lower-case), A-Z are folded first, except in texts that may hold a special token.
    The cache has two generations of at most ``CACHE_WORDS``: words met again move to the newer one, the others go.
    """

    _made: dict[str, WordTokenizer] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """This process's tokenizer, whose cache outlives a task."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str, fold_case: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.fold_case = Tokenizer.from_file(path), fold_case
        self._verify(path)
        self.letters = self._spelling()
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _verify(self, path: str) -> None:
        """Refuse tokenizers whose ids of a text are not its words' ids in turn."""
        for text in _PROBES:
            words = text.replace("\n", " ").split(" ")
            folded = "".join(chr(ord(c) + 32) if self.fold_case and "A" <= c <= "Z" else c for c in text)
            whole, each = self._encode([text])[0], [i for x in self._encode(words) for i in x]
            if whole != each or whole != self._encode([folded])[0]:
                raise ValueError(f"{path}: ids depend on the white space or the case around a word")

    def _spelling(self) -> dict[int, str]:
        """How the model spells each plain letter; empty unless it spells plain words letter by letter."""
        before, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        if before is None:
            return {}
        spelled = {ord(c): "".join(x for x, _ in before.pre_tokenize_str(normal.normalize_str(c) if normal else c)) for c in _LETTERS}
        for word in (_LETTERS, _LETTERS[::-1], "Plain"):
            if [t.id for t in self.tokenizer.model.tokenize(word.translate(spelled))] != self._encode([word])[0]:
                return {}
        return spelled

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        plain = list(filter(_PLAIN.fullmatch, words)) if self.letters else []
        spell = self.tokenizer.model.tokenize
        spelled = "\n".join(plain).translate(self.letters).split("\n") if plain else []
        self.cache.update((w, array("I", [t.id for t in spell(x)]).tobytes()) for w, x in zip(plain, spelled, strict=True))
        rest = list(set(words).difference(plain))
        self.cache.update(zip(rest, (np.array(x, "<u4").tobytes() for x in self._encode(rest)), strict=True))

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of each of the distinct ``words``."""
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {"": b""}
        cache, older = self.cache, self.older
        found = list(map(cache.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = [words[i] for i in missing]
            cache.update((w, x) for w, x in zip(new, map(older.get, new), strict=True) if x is not None)
            new = [w for w in new if w not in cache]
            # a word's last "." or "," after a letter is a token of its own: look the bare word up instead
            ended = [w for w in new if w[-1] in ".," and w[-2:-1] in _LETTERS and len(w) > 1]
            wanted = {".", ",", *new}.difference(ended)
            wanted.update(w[:-1] for w in ended)
            cache.update((w, older[w]) for w in wanted if w in older and w not in cache)
            self._learn([w for w in wanted if w not in cache])
            cache.update((w, cache[w[:-1]] + cache[w[-1]]) for w in ended)
            for i in missing:
                found[i] = cache[words[i]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's ids start (with the end of the last)."""
        # a compact copy: ascii_lower misreads the offsets of slices
        texts = texts.cast(pa.large_string()).fill_null("").take(np.arange(len(texts)))
        if self.fold_case:
            texts = pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts))
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        known = self._known(as_list(coded.dictionary))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.cumsum(n)
        shift = (np.cumsum(size) - size)[code] - (ends - n)  # from a word's place in the output to that among the known
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(shift, n) + np.arange(n.sum())]
        last = np.cumsum(pc.list_value_length(words).to_numpy())
        return ids, np.r_[0, np.r_[0, ends][last]]


def as_list(words: pa.Array) -> list[str]:
    """Strings without spaces as a list, by one join and split: an Arrow value at a time takes ten times as long."""
    if not len(words):
        return []
    lists = pa.LargeListArray.from_arrays([0, len(words)], words)
    return pc.binary_join(lists, pa.scalar(" ", words.type))[0].as_py().split(" ")


def _pieces(path: str, end_id: int, seq_len: int, unit: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def cut(n: int) -> list[tuple[int, int]]:
        full = n // seq_len * seq_len
        body = (n - full) // unit * unit
        parts = [(s, seq_len) for s in range(0, full, seq_len)]
        return parts + [(s, k) for s, k in ((full, body), (full + body, n - full - body)) if k]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(path)
        for batch in sliced(batches):
            sizes = pc.utf8_length(batch.column(1)).fill_null(0).to_pylist()
            at = 0
            while at < len(sizes):
                stop, size = at, 0
                while stop < len(sizes) and (stop == at or size + sizes[stop] <= CHUNK_CHARS):
                    size += sizes[stop]
                    stop += 1
                row, out = [], []
                ids_of_all, bounds = tokenizer.encode(batch.column(1).slice(at, stop - at))
                raw, bounds = ids_of_all.tobytes(), (bounds * 4).tolist()
                for i, (low, high) in enumerate(pairwise(bounds), at):
                    ids = raw[low:high] + end
                    n = len(ids) // 4
                    for start, length in cut(n):
                        part = ids[start * 4 : (start + length) * 4]
                        row.append(i)
                        out.append((start, length, zlib.crc32(part), n, np.frombuffer(part, "<i4") if with_ids else None))
                columns = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:4]]
                if with_ids:
                    columns.append(pa.array([x[4] for x in out], pa.list_(pa.int32())))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *columns], names=names)
                at = stop

    return rows


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and item counts of an unbounded knapsack; item i has size i + 1."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        gains = best[c - 1 :: -1][: len(values)] + values[:c]
        j = int(np.argmax(gains))
        best[c], last[c] = (gains[j], j + 1) if gains[j] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    counts, c = np.zeros(len(values), int), capacity
    while c:
        counts[max(last[c] - 1, 0)] += last[c] > 0
        c -= max(last[c], 1)
    return float(best[capacity]), counts


def cutting_stock(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold exactly ``demand[i]`` items of size i + 1 each, in about the fewest bins."""
    demand = np.asarray(demand, int)
    have = np.flatnonzero(demand)
    if not len(have):
        return []
    sizes = have + 1
    basis = np.diag((capacity // sizes).astype(float))
    amount = demand[have] / np.diag(basis)
    for _ in range(200 * len(have) + 200):
        prices = np.linalg.solve(basis.T, np.ones(len(have)))
        values = np.full(capacity, -1.0)
        values[have] = prices
        gain, counts = knapsack(values[: sizes.max()], capacity)
        if gain <= 1 + 1e-9:
            break
        column = counts[have].astype(float)
        step = np.linalg.solve(basis, column)
        ratios = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratios))
        amount = np.maximum(amount - ratios[leave] * step, 0)
        amount[leave] = ratios[leave]
        basis[:, leave] = column
    times = np.floor(amount + 1e-6).astype(int)
    patterns, left = Counter(), demand.copy()
    for j in np.argsort(-amount):
        pattern = np.zeros(len(demand), int)
        pattern[have] = basis[:, j].round().astype(int)
        used = pattern > 0
        n = min(int(times[j]), int((left[used] // pattern[used]).min()))
        if n > 0:
            patterns[tuple(pattern)] += n
            left -= n * pattern
    bins: list[list[int]] = []  # what rounding left: first-fit decreasing
    room: list[int] = []
    for size in np.repeat(np.arange(len(demand)) + 1, left)[::-1].tolist():
        k = next((i for i, r in enumerate(room) if r >= size), None)
        if k is None:
            bins.append([])
            room.append(capacity)
            k = len(bins) - 1
        bins[k].append(size)
        room[k] -= size
    for items in bins:
        patterns[tuple(np.bincount(np.array(items) - 1, minlength=len(demand)))] += 1
    return [(np.array(p), n) for p, n in sorted(patterns.items(), reverse=True)]


def _ranges(plan: list[tuple[np.ndarray, int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(size, first rank, rank after the last, items per bin, first bin) of each pattern's items; bins in all."""
    rows, taken, bins = [], Counter(), 0
    for pattern, times in plan:
        for i in np.flatnonzero(pattern).tolist():
            per = int(pattern[i])
            rows.append((i + 1, taken[i], taken[i] + per * times, per, bins))
            taken[i] += per * times
        bins += times
    return rows, bins


def _assigned(spark: SparkSession, items: DataFrame, plan: list[tuple[np.ndarray, int]], size: str, rank: str, into: str) -> DataFrame:
    """``items`` with the bin that the plan gives the item of this size and rank, as column ``into``."""
    rows, _ = _ranges(plan)
    table = spark.createDataFrame(rows or [(0, 0, 0, 1, 0)], "_size long, _from long, _to long, _per long, _bin long")
    inside = (F.col(size) == F.col("_size")) & (F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_to"))
    found = items.join(F.broadcast(table), inside)  # as many rows as the plan has (size, pattern) pairs
    return found.withColumn(into, F.col("_bin") + F.floor((F.col(rank) - F.col("_from")) / F.col("_per"))).drop(
        "_size", "_from", "_to", "_per", "_bin")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
         seq_len: int = SEQ_LEN, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    ``tokenizer`` names a tokenizers file that every executor can read; see ``WordTokenizer`` for what it must be.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _pieces(tokenizer or default_tokenizer(), end_id, seq_len, unit, with_ids), schema)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # by row, too, so that rows which share an id are spread; written, so it stays
    bucket = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(buckets))
    pieces = materialise(cut.withColumn("bucket", bucket), "pieces")

    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = materialise(counts, "lengths")  # a row per class and bucket
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    tails = np.array([histogram.get(i, 0) for i in range(1, unit)], int)
    tail_plan = cutting_stock(tails, unit)
    made = sum(n for _, n in tail_plan)
    bodies = np.array([histogram.get(i * unit, 0) for i in range(1, seq_len // unit)], int)
    own_units = int(bodies[0])
    bodies[0] += made
    body_plan = cutting_stock(bodies, seq_len // unit)
    used = sum(n for _, n in body_plan)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    offsets = counts.select("length", "bucket", before.alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "bucket")
    ranked = ranked.withColumn("size", F.when(F.col("length") < unit, F.lit(1)).otherwise(F.col("length") / unit).cast("long"))

    full = ranked.where(F.col("length") == seq_len).withColumn("sequence_id", F.col("rank") + used)
    whole = ranked.where((F.col("length") >= unit) & (F.col("length") < seq_len))
    loose = _assigned(spark, ranked.where(F.col("length") < unit), tail_plan, "length", "rank", "made")
    loose = loose.withColumn("rank", F.col("made") + own_units).drop("made")
    rest = _assigned(spark, whole.unionByName(loose), body_plan, "size", "rank", "sequence_id")
    placed = full.unionByName(rest)
    # bodies first, so that a unit that tails do not fill comes last and offsets have no gap
    within = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "rank", "doc_id", "start", "ids_crc32")
    offset = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return placed.withColumn("offset", offset).select(
        F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"), *["ids"] * with_ids)
