"""Quality rules: plain counts, and a calibrated logistic regression on hashed word and character n-grams.

The regression is fitted on a bounded sample of labelled rows and scores whole texts in Arrow batches; a text is
kept if no plain rule fails and its probability of good quality reaches the fixed threshold.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import linear
from tabscope.llm.rows import map_rows, octets
from tabscope.llm.textbytes import Rolling, byte_array, packed, profile, shingles, unpacked, words

#: Bound of the training sample, for each of the two labels.
SAMPLE_PER_LABEL = 1000
GRAMS, WORD_GRAMS, BITS = (3,), (1, 2), 11
#: A text needs this probability of good quality.
THRESHOLD = 0.5
#: Plain rules: fewest words, and the largest share (in percent) of words in repeated windows of ``WINDOW`` words.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.array([chr(b) in SYMBOLS for b in range(256)])


class Counts(NamedTuple):
    """What the plain rules count in one text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEATED * self.n_words


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words which the text has twice or more."""
    if len(hashes) < window:
        return 0
    grams = shingles(hashes, window)
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[: len(grams)] += twice
    cover[window : window + len(grams)] -= twice
    return int((np.cumsum(cover)[:-1] > 0).sum())


def count(text: bytes) -> Counts:
    """The plain counts of one text."""
    raw = byte_array(text)
    starts, ends = words(raw)
    letters = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points up to each byte
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return Counts(
        len(starts), int((letters[ends] - letters[starts]).sum()), int(_SYMBOL[raw].sum()),
        len(lines) - len(set(lines)), repeated_words(Rolling(raw).spans(starts, ends)),
    )


def features(text: bytes) -> np.ndarray:
    return profile(text, GRAMS, WORD_GRAMS, BITS)


class Model(NamedTuple):
    """Weights of the regression and its calibration."""

    weights: np.ndarray
    slope: float
    offset: float

    def probability(self, text: bytes) -> float:
        margin = float(features(text) @ self.weights[:-1] + self.weights[-1])
        return float(linear.sigmoid(np.float64(self.slope * margin + self.offset)))


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    """Fit on at most ``per_label`` rows of each quality label, drawn by a hash of the id.

    None if a label is missing: there is nothing to learn then.
    """
    drawn = [
        labels.where(F.col("quality") == value).select("doc_id", "quality").where(F.col("doc_id").isNotNull())
        .dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        for value in (0, 1)
    ]
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    vectors = map_rows(sample, ["quality", octets()], "quality int, vector binary",
                       lambda: lambda quality, text: (quality, packed(features(text or b""))))
    found = sorted(vectors.collect(), key=lambda r: (r.vector, r.quality))[: 4 * per_label]  # repeated ids only
    signs = np.array([1.0 if r.quality else -1.0 for r in found], np.float32)
    if len(set(signs)) < 2:
        return None
    return Model(*linear.fit_calibrated(unpacked([r.vector for r in found], 2 << BITS), signs, "logistic"))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, probability and verdict of each text.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept``.
    A null text counts as empty and fails. Without a model ``quality`` is null and the plain rules decide.
    Each row is judged alone: ties and repeated rows come out as they come in, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        learned = shared.value

        def work(doc_id: int | None, text: bytes | None) -> tuple:
            counts = count(text or b"")
            p = learned.probability(text or b"") if learned else None
            return (doc_id, *counts, counts.failed, p, not counts.failed and (p is None or p >= threshold))

        return work

    schema = (
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, quality double, kept boolean"
    )
    return map_rows(docs, ["doc_id", octets()], schema, start)
