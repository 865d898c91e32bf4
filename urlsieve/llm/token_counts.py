"""Edit-aware token counts: a segment tree of pre-tokens per document.

A text is cut into pre-tokens by the tokenizer's pattern.  Leaves hold up to ``LEAF`` neighbouring pre-tokens; every
node has the characters and the tokens below it.  An edit finds its leaves by descending over character sums, re-encodes
from the leaf that holds the text ``CONTEXT`` characters before it until a pre-token ends where an old leaf did, and
adds the difference to the sums above.  The pattern only looks forward, and at most two characters past a match, so
the rest of the text keeps its pre-tokens and counts.

The state is a row per document (``leaf_chars``, ``leaf_tokens``), so edits that come later need the text and that row
alone; sums above the leaves are rebuilt from it.

Defined cases: null and empty texts have no tokens; an edit's places are cut to the text as it then is, a null insert
is empty, and a null list has no edits; repeated rows are each counted; null ids are kept; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.common import sliced

LEAF, CONTEXT = 64, 4
CACHE_WORDS = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token counts of pre-tokens, through a bounded cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cache: dict[str, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        new = set(words).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache, new = {}, set(words)
        if new:
            listed = list(new)
            self.cache.update(zip(listed, map(len, self.tokenizer.encode_batch_fast(listed, add_special_tokens=False)), strict=True))
        return [self.cache[w] for w in words]


class CountTree:
    """Characters and tokens of a text's leaves, and of every node above them (a heap: node i over 2i and 2i + 1)."""

    def __init__(self, leaf_chars: list[int], leaf_tokens: list[int]):
        self.width = 1
        while self.width < max(len(leaf_chars), 1):
            self.width *= 2
        self.size = len(leaf_chars)
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + self.size] = leaf_chars
        self.tokens[self.width : self.width + self.size] = leaf_tokens
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @classmethod
    def of(cls, text: str, encoder: Encoder) -> CountTree:
        return cls(*_leaves(encoder.pattern.findall(text), encoder))

    def leaves(self) -> tuple[list[int], list[int]]:
        w = self.width
        return self.chars[w : w + self.size], self.tokens[w : w + self.size]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` and the place of its first character."""
        node, at = 1, 0
        while node < self.width:
            node *= 2
            if place >= at + self.chars[node] and self.chars[node + 1]:
                at += self.chars[node]
                node += 1
        return node - self.width, at

    def _add(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def replace(self, text: str, start: int, end: int, insert: str, encoder: Encoder) -> tuple[str, int]:
        """The edited text and the number of its characters that were re-encoded."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        edited, shift = text[:start] + insert + text[end:], len(insert) - (end - start)
        if not self.size:
            self.__init__(*_leaves(encoder.pattern.findall(edited), encoder))
            return edited, len(edited)
        first, at = self.find(max(start - CONTEXT, 0))
        last, reach = first, at + self.chars[self.width + first]  # old leaves first .. last end at reach (old places)
        while reach < end and last + 1 < self.size:
            last += 1
            reach += self.chars[self.width + last]
        words, place = [], at
        for match in encoder.pattern.finditer(edited, at):
            words.append(match[0])
            place = match.end()
            while reach + shift < place and last + 1 < self.size:
                last += 1
                reach += self.chars[self.width + last]
            if place == reach + shift and reach >= end:
                break
        if place == at:  # nothing is left from here on: the old leaves up to the end go
            last = self.size - 1
        counts, leaves = encoder.counts(words), last - first + 1
        per = -(-len(words) // leaves)
        if per > 4 * LEAF or place == len(edited) and last < self.size - 1:
            chars, tokens = self.leaves()
            more = _leaves(words, encoder)
            tail = slice(last + 1, None) if place < len(edited) else slice(self.size, None)
            self.__init__(chars[:first] + more[0] + chars[tail], tokens[:first] + more[1] + tokens[tail])
        else:
            for i in range(leaves):
                node, part = self.width + first + i, slice(i * per, (i + 1) * per)
                self._add(first + i, sum(map(len, words[part])) - self.chars[node], sum(counts[part]) - self.tokens[node])
        return edited, place - at


def _leaves(words: list[str], encoder: Encoder) -> tuple[list[int], list[int]]:
    if not words:
        return [], []
    starts = np.arange(0, len(words), LEAF)
    chars = np.add.reduceat(np.fromiter(map(len, words), np.int64, len(words)), starts)
    tokens = np.add.reduceat(np.array(encoder.counts(words), np.int64), starts)
    return chars.tolist(), tokens.tolist()


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, n_tokens, leaf_chars, leaf_tokens) per document: the state that ``recount`` takes."""
    path = tokenizer or default_tokenizer()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in sliced(batches):
            found = [CountTree.of(t or "", encoder) for t in batch.column(1).to_pylist()]
            leaves = [t.leaves() for t in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.tokens[1] for t in found], pa.int64()), *(pa.array([x[j] for x in leaves], pa.list_(pa.int32())) for j in (0, 1))],
                names=["id", "n_tokens", "leaf_chars", "leaf_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        rows, f"id {kind}, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>")
    return out.withColumnRenamed("id", id_col)


def recount(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", tokenizer: str | None = None,
            state: bool = False) -> DataFrame:
    """(id, tokens_before, tokens_after, n_edits, reencoded_chars, text) per document after its edits, an array of
    (start, end, insert) applied in turn; with ``state`` true, ``docs`` brings the leaves and the new ones are returned too."""
    path = tokenizer or default_tokenizer()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in sliced(batches):
            out = []
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for text, edits, *leaves in zip(*columns, strict=True):
                text = text or ""
                tree = CountTree(leaves[0] or [], leaves[1] or []) if state else CountTree.of(text, encoder)
                before, redone, edits = tree.tokens[1], 0, [x for x in edits or [] if x]
                for x in edits:
                    start = x["start"] or 0
                    text, n = tree.replace(text, start, start if x["end"] is None else x["end"], x["insert"] or "", encoder)
                    redone += n
                out.append((before, tree.tokens[1], len(edits), redone, text, *(tree.leaves() if state else ())))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int32())] * (2 * state)
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=False)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    names = ["id", "tokens_before", "tokens_after", "n_edits", "reencoded_chars", "text"] + ["leaf_chars", "leaf_tokens"] * state
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, tokens_before long, tokens_after long, n_edits long, reencoded_chars long, text string"
    schema += ", leaf_chars array<int>, leaf_tokens array<int>" * state
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"), *["leaf_chars", "leaf_tokens"] * state)
    return source.mapInArrow(rows, schema).withColumnRenamed("id", id_col)
