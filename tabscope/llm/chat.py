"""Chat formatting: conversations rendered whole, encoded once with offsets, and masked for the loss by offsets.

A turn is ``<s>[INST]role[/INST]text</s>``. The four marks are tokens of their own, so no other token crosses the border of
a text, and marks inside roles and texts are escaped: a backslash after their first character, one more where there are
some already. Only such places change, so the escape is undone exactly.

A conversation is rendered as one string that is encoded once. The spans of its turns and of its tokens are both sorted;
two binary searches find the tokens of each text that is trained on. Conversations are dealt in blocks of turns, and the
texts of a block in segments, so that neither a conversation of any length nor its tokens meet in one task's memory;
marks are hard borders, so segments have the tokens that the whole has. A conversation within one block and segment
(the usual one) is one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import AddedToken, Tokenizer, processors

from tabscope.llm.rows import SLICE, record_batch, small_batches

#: Marks of the template: before a turn, before and after its role, after its text.
BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
MARKS = (BEGIN, ROLE, TEXT, END)
#: Roles whose texts are trained on.
TRAINED = ("assistant",)
#: Turns of a conversation that are dealt together, by the number of the turn.
BLOCK_TURNS = 512
#: Characters after which a segment ends with its turn.
SEGMENT_CHARS = 1_000_000

_LIKE_A_MARK = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]))")
_ESCAPED_MARK = re.compile(r"([<\[])\\(\\*)(?=/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    """The text without marks: what looks like a mark, escaped or not, gets one more backslash."""
    return _LIKE_A_MARK.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _ESCAPED_MARK.sub(r"\1\2", text)


@dataclass
class Rendered:
    """A rendered run of turns and where its trained texts stand: sorted starts and ends in characters."""

    text: str
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)


def render(turns: Iterable[tuple[str | None, str | None]], trained: Sequence[str] = TRAINED) -> Rendered:
    """Render (role, text) turns in their order; null is empty."""
    parts, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head = f"{BEGIN}{ROLE}{escape(role or '')}{TEXT}"
        body = escape(text or "")
        if role in trained:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return Rendered("".join(parts), starts, ends)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """A byte-level tokenizer whose only whole strings are the marks; other special tokens in a text are ordinary text."""
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.add_tokens([AddedToken(mark, normalized=False) for mark in MARKS])
    found.post_processor = processors.ByteLevel(trim_offsets=False)
    return found


def masked(rendered: Rendered, token_starts: np.ndarray, token_ends: np.ndarray) -> list[tuple[int, int]]:
    """Runs of tokens (first, one past the last) under the trained texts, one for each text that is not empty.

    Tokens that share a character have its span, so starts and ends never fall. A run that doesn't fit its text is an error.
    """
    first = np.searchsorted(token_ends, rendered.starts, side="right")
    last = np.searchsorted(token_starts, rendered.ends, side="left")
    runs = []
    for lo, hi, start, end in zip(first.tolist(), last.tolist(), rendered.starts, rendered.ends, strict=True):
        if start == end:
            continue
        if token_starts[lo] != start or token_ends[hi - 1] != end:
            raise ValueError(f"tokens cross the border of a text at characters {start} to {end}")
        runs.append((lo, hi))
    return runs


def encoded(rendered: Rendered, path: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Token ids of a rendered run of turns, and the runs of tokens to train on."""
    found = tokenizer(path).encode(rendered.text, add_special_tokens=False)
    spans = np.array(found.offsets, np.int64).reshape(-1, 2)
    return found.ids, masked(rendered, spans[:, 0], spans[:, 1])


FORMATTED = (
    "conv_id bigint, block bigint, segment bigint, n_turns bigint, text string, ids array<int>, "
    "loss array<struct<first:int,last:int>>"
)


def format_conversations(
    turns: DataFrame, tokenizer_path: str, trained: Sequence[str] = TRAINED, block_turns: int = BLOCK_TURNS,
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """Formatted conversations of ``conv_id, turn, role, text``: ``conv_id, block, segment, n_turns, text, ids, loss``.

    ``text`` is the formatted string, ``ids`` its tokens, ``loss`` the runs of tokens (from ``first`` to before ``last``) to
    train on. A conversation is one row, unless its turns lie in several blocks of ``block_turns`` or its texts pass
    ``segment_chars``; then its rows, in the order of block and segment, follow each other without a gap.

    Turns are in the order of ``turn``, equal ones in that of role and text; null comes first. Repeated rows are turns of
    their own. A null role or text is empty; rows with a null ``conv_id`` are one conversation. Texts are whole, whatever
    their length. Other columns are ignored, whatever they are called; an empty table gives no row.
    """
    target = to_arrow_schema(T.StructType.fromDDL(FORMATTED))
    trained = tuple(trained)
    small_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, segment, held, size, rows = None, 0, [], 0, []

        def done() -> tuple:
            rendered = render(held, trained)
            ids, loss = encoded(rendered, tokenizer_path)
            return (*key, segment, len(held), rendered.text, ids, [{"first": a, "last": b} for a, b in loss])

        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                piece = batch.slice(first, SLICE).to_pydict()
                for conv_id, block, role, text in zip(piece["c"], piece["b"], piece["r"], piece["x"], strict=True):
                    if held and (key != (conv_id, block) or size >= segment_chars):
                        rows.append(done())
                        segment = segment + 1 if key == (conv_id, block) else 0
                        held, size = [], 0
                    key = conv_id, block
                    held.append((role, text))
                    size += len(text or "") + len(role or "")
                if rows:
                    yield record_batch(rows, target)
                    rows = []
        if held:
            yield record_batch([done()], target)

    block = F.floor(F.col("turn") / F.lit(block_turns)).cast("bigint")
    dealt = turns.select(F.col("conv_id").alias("c"), block.alias("b"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"))
    ordered = dealt.repartition("c", "b").sortWithinPartitions("c", "b", "t", "r", "x")
    return ordered.select("c", "b", "r", "x").mapInArrow(run, FORMATTED)


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
    "n_tokens bigint, n_loss_tokens bigint"
)


def digests(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """What can be read back from formatted conversations, one row each; the roles and texts come from decoded tokens.

    ``turns_sha256`` digests role, line feed, text, line feed of each turn, ``loss_sha256`` all text under the loss mask,
    both unescaped. A conversation of several rows is digested row by row, so no more than one row is held.
    """
    target = to_arrow_schema(T.StructType.fromDDL(DIGESTS))
    small_batches(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokenizer(tokenizer_path).decode
        key, seen, rows = None, False, []
        turns = loss = None
        counts = [0] * 5

        def done() -> tuple:
            return key, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), *counts[2:]

        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                for r in batch.slice(first, SLICE).to_pylist():
                    if not seen or key != r["conv_id"]:
                        if seen:
                            rows.append(done())
                        key, seen, turns, loss, counts = r["conv_id"], True, hashlib.sha256(), hashlib.sha256(), [0] * 5
                    ids = r["ids"]
                    text = decode(ids, skip_special_tokens=False)
                    for role, said in parse(text):
                        turns.update(f"{role}\n{said}\n".encode())
                        counts[0] += 1
                    for span in r["loss"]:
                        part = unescape(decode(ids[span["first"] : span["last"]], skip_special_tokens=False))
                        loss.update(part.encode())
                        counts[1] += len(part)
                        counts[4] += span["last"] - span["first"]
                    counts[2] += len(text)
                    counts[3] += len(ids)
                if rows:
                    yield record_batch(rows, target)
                    rows = []
        if seen:
            yield record_batch([done()], target)

    ordered = formatted.select("conv_id", "block", "segment", "ids", "loss").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "block", "segment").mapInArrow(run, DIGESTS)
