"""Chat formatting by quotation linking.

A message's lines that start with ``>`` are quotes; the number of marks is their level.  Runs of lines of one level are
passages.  Passages and the messages' own words are cut into sentences, normalised (case, white space) and hashed, so a
quote finds its origin even where its lines were wrapped anew.  A passage without a sentence of known origin is looked
up by its lines, and one without such a line by its windows of ``WINDOW`` words (all of its words, if fewer), first of the
whole passage, then of each line or piece between ellipses; so parts of sentences and lines are found, too.  A unit's
origin is the first message of the conversation that says it unquoted; a passage found by windows is one unit, of the
message that most of them come from.  A message replies to the earlier message that most units of its outermost quotes
come from (the latest on ties).

Words are runs of letters and digits; a letter of a script that is written without spaces is a word.  A window is looked
for only in conversations that hold a passage without origin, and only at the sizes these need.

Replies make trees.  Depth and first message of each tree are found by pointer doubling over (conversation, turn), a
constant amount of state per message.  Output rows are ordered by conversation, first message of the tree and turn, so
threads stand together and every reply follows what it quotes; quotes are gone from the texts.  No conversation is
gathered in one place: all steps are grouped minima, equi-joins and a range sort that splits large conversations.

Defined cases: a passage that no earlier message says has no origin; null and empty texts have no words; a message of quotes only has an empty text and keeps its links;
rows with a null conversation or turn are kept and not linked; repeated rows are kept, and rows that share a turn are
one place in the tree; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.llm.common import materialise, sliced

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f\uff61])\s*|\n\s*\n")
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_PIECE = re.compile(r"\n|\.{3,}|\u2026")
WINDOW, _HELD = 8, 20_000
#: Lines that introduce a quote ("... wrote:") go with it.
_INTRODUCES = re.compile(r"\S.*\b(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.I)


def _hash(unit: str) -> int:
    return xxhash.xxh64_intdigest(unit) - (1 << 63)


def _hashes(units: list[str]) -> list[int]:
    words = (" ".join(x.lower().split()) for x in units)
    return [_hash(x) for x in words if x]


def sentences(lines: list[str]) -> list[int]:
    """Hashes of the normalised sentences of a passage."""
    return _hashes(_SENTENCE.split("\n".join(lines)))


def windows(text: str, sizes: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """(size, hash) of the windows of a text's words, at ``sizes`` or at the one size that suits a quote."""
    words = _WORD.findall(text.lower())
    for size in sizes if sizes is not None else [min(len(words), WINDOW)] if words else []:
        for at in range(len(words) - size + 1):
            yield size, _hash(" ".join(words[at : at + size]))


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """A message's own words and its quoted passages as (level, lines)."""
    own, passages, level = [], [], 0
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        if marks:
            now = marks[1].count(">")
            if not level and own and _INTRODUCES.match(own[-1]):
                own.pop()
            if now != level:
                passages.append((now, []))
            passages[-1][1].append(line[marks.end():])
            level = now
        else:
            own.append(line)
            level = 0
    return "\n".join(own).strip("\n") if passages else text, passages


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unit = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.int64()), ("tier", pa.int32()), ("h", pa.int64())]))
    passage = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.int64()), ("words", pa.string())]))
    for batch in sliced(batches):
        found = [parse(t or "") for t in batch.column(3).to_pylist()]
        said = [sorted({*sentences(own.split("\n")), *_hashes(own.split("\n"))}) for own, _ in found]
        passages = [[{"level": level, "passage": _hash(f"{level} " + "\n".join(lines)), "words": "\n".join(lines)} for level, lines in p] for _, p in found]
        quoted = [[{"level": x["level"], "passage": x["passage"], "tier": tier, "h": h} for x in p
                   for tier, units in enumerate((sentences([x["words"]]), _hashes(x["words"].split("\n")))) for h in sorted(set(units))] for p in passages]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([own for own, _ in found], pa.string()), pa.array([len(p) for _, p in found], pa.int32()),
             pa.array(said, pa.list_(pa.int64())), pa.array(quoted, unit), pa.array(passages, passage)],
            names=["conv", "turn", "role", "text", "n_quotes", "said", "quoted", "passages"])


def _said_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, turn, hashes) of the windows of each message, at most ``_HELD`` a row, from (conv, turn, text, sizes)."""
    for batch in sliced(batches):
        for i, (text, sizes) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            every = (h for _, h in windows(text or "", sizes))
            while held := list(islice(every, _HELD)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([held], pa.list_(pa.int64()))],
                                                 names=["conv", "turn", "said"])


def _quoted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, turn, level, passage, tier, size, hashes) from (conv, turn, level, passage, words)."""
    for batch in sliced(batches):
        for i, words in enumerate(batch.column(4).to_pylist()):
            for tier, pieces in enumerate(([words], _PIECE.split(words))):
                every = ((size, h) for x in pieces for size, h in windows(x))
                while held := list(islice(every, _HELD)):
                    for size in sorted({s for s, _ in held}):
                        row = [*(batch.column(c).slice(i, 1) for c in range(4)), pa.array([tier], pa.int32()), pa.array([size], pa.int32()),
                               pa.array([sorted({h for s, h in held if s == size})], pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays(row, names=["conv", "turn", "level", "passage", "tier", "size", "said"])


def _origins(said: DataFrame, name: str) -> DataFrame:
    """(conv, h, source): the first message of the conversation that says a unit."""
    return materialise(said.select("conv", "turn", F.explode("said").alias("h")).groupBy("conv", "h").agg(F.min("turn").alias("source")), name)


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, source, n): how many quoted units of a message and level come from an earlier turn."""
    passage = ["conv", "turn", "level", "passage"]
    quoting = messages.where("n_quotes > 0")
    quoted = quoting.select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.*").distinct()
    found = materialise(quoted.join(_origins(messages, "origins"), ["conv", "h"]).where("source < turn"), "found")
    first = found.groupBy(*passage).agg(F.min("tier").alias("tier"))
    links = found.join(first, [*passage, "tier"]).select("conv", "turn", "level", "h", "source").distinct().select("conv", "turn", "level", "source", F.lit(1).alias("n"))
    rest = quoting.where("conv is not null and turn is not null").select("conv", "turn", F.explode("passages").alias("p")).select("conv", "turn", "p.*").distinct()
    rest = materialise(rest.join(first, passage, "left_anti").where("words != ''"), "rest")
    if rest.head(1):
        links = links.union(_window_links(messages, rest))
    return links.groupBy("conv", "turn", "level", "source").agg(F.sum("n").alias("n"))


def _window_links(messages: DataFrame, rest: DataFrame) -> DataFrame:
    """(conv, turn, level, source, 1) of each passage of ``rest`` that shares word windows with an earlier message."""
    kind, passage = rest.schema["conv"].dataType.simpleString(), ["conv", "turn", "level", "passage"]
    wanted = materialise(rest.select(*passage, "words").mapInArrow(
        _quoted_windows, f"conv {kind}, turn long, level int, passage long, tier int, size int, said array<long>"), "windows")
    sizes = wanted.groupBy("conv").agg(F.collect_set("size").alias("sizes"))  # at most WINDOW of them
    said = messages.join(sizes, "conv").select("conv", "turn", "text", "sizes").mapInArrow(_said_windows, f"conv {kind}, turn long, said array<long>")
    units = wanted.select(*passage, "tier", F.explode("said").alias("h")).distinct()
    shared = units.join(_origins(said, "window-origins"), ["conv", "h"]).where("source < turn").groupBy(*passage, "tier", "source").agg(F.count("*").alias("n"))
    best = shared.groupBy(*passage).agg(F.max(F.struct(-F.col("tier"), "n", "source")).alias("b"))
    return best.select("conv", "turn", "level", F.col("b.source").alias("source"), F.lit(1).alias("n"))


def reply_trees(links: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, thread, depth) of every message that replies."""
    best = links.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), "n", "source")).alias("b")).select("conv", "turn", F.col("b.source").alias("reply_to"))
    trees = materialise(best.select("conv", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "trees")
    while True:
        above = trees.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        joined = trees.join(above, ["conv", "thread"], "left").select(
            "conv", "turn", "reply_to", F.coalesce("next", "thread").alias("thread"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        joined = materialise(joined, "trees")
        trees = joined.drop("moved")
        if not joined.where("moved").head(1):
            return trees


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", template: str = "<|{role}|>\n{text}\n") -> DataFrame:
    """(conv, thread, turn, depth, reply_to, role, text, n_quotes, formatted) in reply order; ``formatted`` is the message in
    the chat template."""
    source = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    parsed = materialise(source.mapInArrow(_parsed, f"conv {kinds['conv']}, turn long, role {kinds['role']}, text string, n_quotes int, "
                                           "said array<long>, quoted array<struct<level:int,passage:long,tier:int,h:long>>, "
                                           "passages array<struct<level:int,passage:long,words:string>>"), "messages")
    trees = reply_trees(quote_links(parsed))
    head, tail = template.split("{text}", 1)
    before, after = head.split("{role}", 1)
    formatted = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(after), "text", F.lit(tail))
    out = parsed.join(trees, ["conv", "turn"], "left").select(
        F.col("conv").alias(conv_col), F.coalesce("thread", "turn").alias("thread"), F.col("turn").alias(turn_col),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "reply_to", F.col("role").alias(role_col), F.col("text").alias(text_col),
        F.col("n_quotes").cast("long").alias("n_quotes"), formatted.alias("formatted"))
    return out.orderBy(conv_col, "thread", turn_col, text_col)
