"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and white space runs become one space.  An item of m characters may occur with k = ``error_rate``
* m errors (insertions, deletions, substitutions).  It is split into k + 1 pieces: in any such occurrence one piece is
left exact.  An Aho-Corasick automaton finds the exact piece hits; around each hit the q-gram lemma (an
occurrence keeps all but 4k of the item's 4-grams) and then Myers' bit-parallel distance decide.  No occurrence within the budget
is missed.

The benchmark is the stated query set.  It goes to every task in blocks of at most ``block_chars`` characters, however
large it is, one pass over the documents for each block.  Items under ``min_chars`` characters occur inside clean texts, so
they are looked for without errors and only where they fill a whole text, a whole line of it or consecutive whole lines;
elsewhere they do not count.

Defined cases: null and empty texts hold nothing; null items are not looked for; repeated documents are each
reported, once per id; documents with a null id are reported under it; repeated items under each of their ids;
empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.common import materialise, sliced, text_key

ERROR_RATE = 0.1
MIN_CHARS = 25
BLOCK_CHARS = 8_000_000
_GRAM = 4


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their places."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text`` and the first end of such a substring (Myers,
    one arbitrary-length integer per column)."""
    m, where = len(pattern), defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        match = where.get(c, 0)
        across = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | (~(across | plus) & full)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, j
        up = (up << 1) & full
        down = (down << 1) & full
        stay = match | minus
        plus, minus = down | (~(stay | up) & full), up & stay
    return best, end


class Matcher:
    """Occurrences of a block of items in one text after another."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float = ERROR_RATE):
        import ahocorasick

        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.errors = [int(len(t) * error_rate) for t in self.texts]
        self.grams = [[t[i : i + _GRAM] for i in range(len(t) - _GRAM + 1)] for t in self.texts]
        found = defaultdict(list)
        for n, text in enumerate(self.texts):
            for at, piece in pieces(text, self.errors[n]):
                found[piece].append((n, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item id, distance, start, end) of the best occurrence of each item in a normalised text."""
        if not self.texts:
            return
        starts = defaultdict(set)
        for end, places in self.automaton.iter(text):
            for n, reach in places:
                starts[n].add(end + 1 - reach)
        for n, begins in starts.items():
            best = self._best(n, sorted(begins), text)
            if best:
                yield self.ids[n], *best

    def _best(self, n: int, begins: list[int], text: str) -> tuple[int, int, int] | None:
        item, k = self.texts[n], self.errors[n]
        m, best, i = len(item), None, 0
        while i < len(begins):
            low = high = begins[i]
            while i < len(begins) and begins[i] <= high + 2 * k + 1:
                high = begins[i]
                i += 1
            a, b = max(0, low - k), high + m + k
            window = text[a:b]
            kept = {window[j : j + _GRAM] for j in range(len(window) - _GRAM + 1)}
            if sum(g in kept for g in self.grams[n]) < len(self.grams[n]) - _GRAM * k:
                continue
            distance, end = least_distance(item, window)
            if distance <= k and (best is None or distance < best[0]):
                _, back = least_distance(item[::-1], window[:end][::-1])
                best = distance, a + end - back, a + end
        return best


class LineMatcher:
    """Texts and lines that are one of the short items of a block."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids, self.longest = defaultdict(list), max((len(t) for _, t in items), default=0)
        for i, t in items:
            self.ids[t].append(i)

    def find(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item id, 0, start, end) of the first occurrence of each item; places are those in the normalised text."""
        if not self.ids:
            return
        lines, starts, at, seen = [y for x in text.lower().splitlines() if (y := " ".join(x.split()))], [], 0, set()
        for line in lines:
            starts.append(at)
            at += len(line) + 1
        for n, line in enumerate(lines):
            held, m = line, n
            while len(held) <= self.longest:
                if held in self.ids and held not in seen:
                    seen.add(held)
                    yield from ((i, 0, starts[n], starts[n] + len(held)) for i in self.ids[held])
                m += 1
                if m == len(lines):
                    break
                held += " " + lines[m]


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list]:
    """Items of at most ``block_chars`` characters together (or one larger item), one block after the other."""
    total = items.agg(F.sum(F.length("t")).alias("n")).head().n or 0
    count = max(1, -(-2 * total // block_chars))
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(count)) == b).orderBy("t", "i").collect()
        while rows:
            size, n = 0, 0
            while n < len(rows) and (n == 0 or size + len(rows[n].t) <= block_chars):
                size += len(rows[n].t)
                n += 1
            yield [(r.i, r.t) for r in rows[:n]]
            rows = rows[n:]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS,
                   block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, match_start, match_end) of each document and benchmark item that occurs in it;
    places are characters of the normalised text."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    spaced = F.trim(F.regexp_replace(F.lower(item_text_col), r"\s+", " "))
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where(F.length(spaced) > 0)
    schema = (f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, "
              "distance int, match_start long, match_end long")
    found = spark.createDataFrame([], schema)
    for block in _blocks(items, block_chars):
        named = [(i, t) for i, t in ((i, normalise(t)) for i, t in block) if t]
        shared = spark.sparkContext.broadcast(([x for x in named if len(x[1]) >= min_chars], [x for x in named if len(x[1]) < min_chars]))

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher, lines = Matcher(shared.value[0], error_rate), LineMatcher(shared.value[1])
            for batch in sliced(batches):
                row, out = [], []
                for j, text in enumerate(batch.column(1).to_pylist()):
                    hits = [*matcher.find(normalise(text or "")), *lines.find(text or "")]
                    row += [j] * len(hits)
                    out += hits
                if out:
                    i, d, s, e = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(i), pa.array(d, pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64())],
                        names=["doc_id", "item_id", "distance", "match_start", "match_end"])

        found = found.unionByName(texts.mapInArrow(rows, schema))
    return found.distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark item."""
    keyed = docs.select(text_key(F.col(id_col), F.col(text_col)).alias("k"), F.col(text_col).alias("t"))
    hits = materialise(benchmark_hits(keyed, benchmark, "k", "t").select(F.col("doc_id").alias("k")).distinct(), "contaminated")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    key = text_key(F.col(names[docs.columns.index(id_col)]), F.col(names[docs.columns.index(text_col)]))
    return own.withColumn("k", key).join(hits, "k", "left_anti").drop("k").toDF(*docs.columns)
