"""Substring dedup: remove every word covered by a window of ``length`` words that starts more than once.

Suffix automata of reference shards: a shard holds the distinct stretches of text that share one gram (see
``repeats``), so any two places that can match are in one shard.  Each shard's automaton counts the occurrences of
its states; its stretches are streamed through it for matching statistics (the longest suffix at each word that occurs
at least twice), and every position with a match of ``length`` words or more marks a window.

The corpus is its own reference here, so shards are not broadcast: their number grows with the corpus, and streaming
every document past every shard would be all pairs.  Documents go to the shards that share a gram with them instead.
Shards beyond ``repeats.HOT`` stretches are resolved by window hash over the cluster.

Defined cases: a null or empty text has no words; repeated rows are copies; windows never cross rows; an empty table
gives an empty result; extra columns are carried or ignored and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from urlsieve.llm.repeats import WordUnits, remove_repeats

LENGTH = 35


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences with the occurrence count of each state."""

    def __init__(self, sequences: list[list[bytes]]):
        self.length, self.link, self.next = [0], [-1], [{}]
        self.count = [0]
        for words in sequences:
            state = 0
            for word in words:
                state = self._extend(state, word)
                self.count[state] += 1
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def _state(self, length: int, link: int, follow: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The state of exactly ``state``'s longest string followed by ``word``; cut from a longer one if need be."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def matches(self, words: list[bytes], least: int = 2) -> Iterator[int]:
        """At each word, the length of the longest suffix read so far that occurs ``least`` times."""
        state = size = 0
        follow, count, link, length = self.next, self.count, self.link, self.length
        for word in words:
            to = follow[state].get(word)
            while state and (to is None or count[to] < least):
                state = link[state]
                size = length[state]
                to = follow[state].get(word)
            if to is not None and count[to] >= least:
                state, size = to, size + 1
            yield size


def automaton_windows(unit, length: int) -> Callable:
    """Resolver: windows that the matching statistics of a shard's automaton reach."""

    def repeated(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        first = 0
        while first < len(rows):
            last = first
            while last < len(rows) and rows[last][0] == rows[first][0]:
                last += 1
            words = [unit.split(r[3]) for r in rows[first:last]]
            if len(words) > 1:
                automaton = SuffixAutomaton(words)
                for i, sequence in enumerate(words, first):
                    for end, size in enumerate(automaton.matches(sequence), 1):
                        if size >= length:
                            yield i, end - length
            first = last

    return repeated


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _text(unit, words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> tuple:
    spans = [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return unit.without(words, starts, ends).decode("utf-8", "ignore"), spans


def _digest(unit, words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> tuple:
    return len(words), int((ends - starts).sum()), hashlib.sha256(unit.without(words, starts, ends)).hexdigest()


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                          kept_col: str = "kept_text", spans_col: str = "removed_spans") -> DataFrame:
    """All columns but the text, with the kept words joined by spaces and the removed word runs."""
    carry = [c for c in docs.columns if c != text_col]
    return remove_repeats(docs, id_col, text_col, carry, WordUnits, length, _text,
                          [(kept_col, pa.string()), (spans_col, _SPANS)], automaton_windows)


def repeated_word_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row."""
    return remove_repeats(docs, id_col, text_col, [id_col], WordUnits, length, _digest,
                          [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())], automaton_windows)
