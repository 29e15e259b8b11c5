"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

The merges of a rank file define which token sequences are encodings. A sequence is the encoding of its
bytes exactly if every two neighbours are the encoding of their joined bytes, so whether a token may
follow another is a property of the pair. The transducer reads bytes from left to right and knows, for
every end of a vocabulary prefix that is still open, the last token of the encoding up to there. Tokens on
which all open ends agree are emitted; the lookahead is bounded by the longest token. States are built as
they are reached, one for each new piece, until the transition table is full; beyond the table, the open ends are
followed one at a time, longest tokens first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import regex
from pyspark.sql import DataFrame

from tabscope.llm.rows import map_rows

#: Pieces, transitions, token pairs and openings a worker keeps over its tasks, to bound its memory; results don't depend on them.
WORD_CACHE, TRANSITION_CACHE, PAIR_CACHE, OPENING_CACHE = 400_000, 60_000, 400_000, 100_000
#: Bytes whose tokens are looked up at once.
WINDOW = 4
#: Longer pieces (in characters) are encoded each time they are met.
KEPT_PIECE = 64
#: Tokens decoded at a time.
CHUNK = 4096
#: A rank above all ranks.
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file with a base64 token and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Transducer:
    """Encode byte strings by merge ranks, from left to right."""

    def __init__(self, ranks: dict[bytes, int], limit: int = TRANSITION_CACHE) -> None:
        self.ranks, self.limit = ranks, limit
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Bytes to (rank + 1) * 2 for a token, plus 1 for what a longer token begins with.
        self.parts = {token: 2 * rank + 2 for token, rank in ranks.items()}
        for part in {token[:n] for token in ranks for n in range(1, len(token))}:
            self.parts[part] = self.parts.get(part, 0) | 1
        self.longest = max(map(len, ranks), default=0)
        self.openings: dict[bytes, tuple[tuple[tuple[int, int], ...], bool]] = {}
        self.spines: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # state * 256 + byte to state and tokens
        self._number((-1, b"", ((0, ()),)))

    def _number(self, state: tuple) -> int:
        found = self.ids.get(state[:2])
        if found is None:
            found = self.ids[state[:2]] = len(self.states)
            self.states.append(state)
        return found

    def merged(self, data: bytes, below: int = NEVER) -> list[bytes]:
        """Encode by definition: join the pair of lowest rank, leftmost first, while one is under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int) -> tuple | None:
        """What the token's first and last part grow through while its merges are made: two lists of
        (rank, bytes), from one byte to the whole. None if its merges don't make it.
        """
        if token not in self.spines:
            data = self.tokens[token]
            found: tuple | None = ([(-1, data)], [(-1, data)])
            if len(data) > 1:
                halves = self.merged(data, token)
                ranks = [self.ranks[h] for h in halves]
                found = None
                if len(halves) == 2 and max(ranks) < token:
                    left, right = self._spine(ranks[0]), self._spine(ranks[1])
                    if left and right:
                        found = ([*left[0], (token, data)], [*right[1], (token, data)])
            self.spines[token] = found
        return self.spines[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether the two tokens' bytes are encoded as these two tokens; ``before`` is -1 at the start of a piece."""
        key = (before + 1) << 32 | token
        if key not in self.pairs:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            self.pairs[key] = self._follows(before, token)
        return self.pairs[key]

    def _follows(self, before: int, token: int) -> bool:
        """Merges happen in the order of their ranks, so replay both sides' merges at the boundary: the pair
        stands unless the parts that meet there would be joined before either grows further.
        """
        right = self._spine(token)
        if before < 0 or right is None:
            return right is not None
        grows, meets = self._spine(before)[1], right[0]
        i = j = 0
        while True:
            cross = self.ranks.get(grows[i][1] + meets[j][1], NEVER)
            next_left = grows[i + 1][0] if i + 1 < len(grows) else NEVER
            next_right = meets[j + 1][0] if j + 1 < len(meets) else NEVER
            if cross < next_left and cross <= next_right and cross < NEVER:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """A state is the last emitted token, the pending bytes, and for each open start its place in them and
        the tokens up to it; the last start is the end of the bytes.
        """
        before, pending, starts = self.states[state]
        pending += bytes((byte,))
        kept, found = [], None
        for at, path in starts:
            rest = pending[at:]
            if found is None:
                token = self.ranks.get(rest)
                if token is not None and self.follows(path[-1] if path else before, token):
                    found = (*path, token)
            if self.parts.get(rest, 0) & 1:
                kept.append((at, path))
        if found is None:
            raise ValueError("the vocabulary has no token for some byte")
        kept.append((len(pending), found))
        first = kept[0][1]  # emit the tokens that all open starts have in common
        common = 0
        while common < len(first) and all(path[: common + 1] == first[: common + 1] for _, path in kept):
            common += 1
        out = first[:common]
        if common:
            cut = sum(len(self.tokens[t]) for t in out)
            before, pending = out[-1], pending[cut:]
            kept = [(at - cut, path[common:]) for at, path in kept]
        return self._number((before, pending, tuple(kept))), out

    def _opening(self, window: bytes) -> tuple[tuple[tuple[int, int], ...], bool]:
        """(length, token) of all tokens that the bytes begin with, the longest last, and whether more bytes may add one."""
        found, code = [], 1
        for length in range(1, len(window) + 1):
            code = self.parts.get(window[:length], 0)
            if code > 1:
                found.append((length, (code >> 1) - 1))
            if not code & 1:
                break
        opening = tuple(found), bool(code & 1)
        if len(window) <= WINDOW:
            if len(self.openings) >= OPENING_CACHE:
                self.openings.clear()
            self.openings[window] = opening
        return opening

    def _simulate(self, state: int, data: bytes, at: int) -> list[int]:
        """The rest of a piece from byte ``at`` on, without building states: follow one open end, and go back to the next one
        where no token can follow. The encoding of the bytes up to an end is unique, so each end is followed once at most.
        """
        first, pending, _ = self.states[state]
        before, start, size = first, at - len(pending), len(data)
        openings, pairs = self.openings, self.pairs
        ids: list[int] = []
        left: list[tuple[int, tuple, int]] = []  # for each token: its start, what can start there, and how many are not tried
        closed: set[int] = set()
        while start < size:
            window = data[start : start + WINDOW]
            found, more = openings.get(window) or self._opening(window)
            if more and start + WINDOW < size:
                found, _ = self._opening(data[start : start + self.longest])
            untried = len(found)
            while True:
                while untried:
                    untried -= 1
                    length, token = found[untried]
                    if start + length in closed:
                        continue
                    fits = pairs.get((before + 1) << 32 | token)
                    if fits or (fits is None and self.follows(before, token)):
                        break
                else:
                    if not left:
                        raise ValueError("the vocabulary has no token for some byte")
                    closed.add(start)
                    start, found, untried = left.pop()
                    ids.pop()
                    before = ids[-1] if ids else first
                    continue
                break
            left.append((start, found, untried))
            ids.append(token)
            start, before = start + length, token
        return ids

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece of text; a piece that is a token is that token.

        A piece adds at most one state: the table grows along what is read often, and stays as it is when full.
        """
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        ids: list[int] = []
        state, moves = 0, self.moves
        for at, byte in enumerate(data):
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(moves) < self.limit:
                    move = moves[state << 8 | byte] = self._step(state, byte)
                    state = move[0]
                    ids.extend(move[1])
                    at += 1
                ids.extend(self._simulate(state, data, at))
                return ids
            state, out = move
            if out:
                ids.extend(out)
        ids.extend(self.states[state][2][-1][1])
        return ids


class Words(dict):
    """Ids of the pieces met so far, in two generations: what is met again while the older one lasts stays."""

    def __init__(self, transducer: Transducer, limit: int = WORD_CACHE) -> None:
        super().__init__()
        self.transducer, self.limit = transducer, limit
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.transducer.encode(piece.encode()))
            if len(piece) > KEPT_PIECE:
                return ids
        if 2 * len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Utf8Machine:
    """Text of a byte stream that arrives in pieces: bytes of an unfinished character wait for the next piece.

    States: 0 between characters, otherwise (bytes still due, lowest and highest next byte). Bytes that
    can't be UTF-8 come out as U+FFFD.
    """

    #: First byte of a character to (bytes due, lowest and highest second byte), from the Unicode standard.
    LEADS = (
        (0xC2, 0xDF, (1, 0x80, 0xBF)), (0xE0, 0xE0, (2, 0xA0, 0xBF)), (0xE1, 0xEC, (2, 0x80, 0xBF)),
        (0xED, 0xED, (2, 0x80, 0x9F)), (0xEE, 0xEF, (2, 0x80, 0xBF)), (0xF0, 0xF0, (3, 0x90, 0xBF)),
        (0xF1, 0xF3, (3, 0x80, 0xBF)), (0xF4, 0xF4, (3, 0x80, 0x8F)),
    )

    def __init__(self) -> None:
        self.lead = {byte: due for low, high, due in self.LEADS for byte in range(low, high + 1)}
        self.waiting = b""

    def feed(self, data: bytes) -> str:
        """The text that is complete with these bytes."""
        data = self.waiting + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):  # a character has at most three more bytes to come
            due = self.lead.get(data[-back])
            if due:
                seen = data[len(data) - back + 1 :]
                whole = len(seen) >= due[0] or any(
                    not (due[1] <= b <= due[2] if i == 0 else 0x80 <= b <= 0xBF) for i, b in enumerate(seen)
                )
                cut -= 0 if whole else back
                break
            if not 0x80 <= data[-back] <= 0xBF:
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        """What is left at the end of the stream."""
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], tokens: dict[int, bytes], chunk: int = CHUNK) -> Iterator[str]:
    """Text of a stream of ids, piece by piece; a character split between tokens comes out once, whole."""
    machine, ids = Utf8Machine(), iter(ids)
    while part := list(islice(ids, chunk)):
        yield machine.feed(b"".join(map(tokens.__getitem__, part)))
    yield machine.finish()


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        self.transducer = Transducer(read_ranks(ranks_path))
        self.words = Words(self.transducer)
        self.pieces = regex.compile(pattern).findall

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.pieces(text))))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(decode_stream(ids, self.transducer.tokens))


@lru_cache(maxsize=2)
def codec_of(ranks_path: str, pattern: str) -> Codec:
    """The codec of a worker process: its rank table, transitions and pieces last over the tasks it runs."""
    return Codec(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Ids of each document: ``doc_id, ids array<int>``. A null or empty text has no ids.

    Documents are independent: no shuffle, ties and repeated rows come out as they come in, other columns
    are ignored. ``ranks_path`` must exist on every executor.
    """

    def start():
        codec = codec_of(ranks_path, pattern)
        return lambda doc_id, text: (doc_id, codec.encode(text or ""))

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, ids array<int>", start)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Texts of ``doc_id, ids``: ``doc_id, text``; null ids are an empty text."""

    def start():
        tokens = {rank: token for token, rank in read_ranks(ranks_path).items()}
        return lambda doc_id, ids: (doc_id, "".join(decode_stream(ids or (), tokens)))

    return map_rows(encoded, ["doc_id", "ids"], "doc_id bigint, text string", start)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode each document in one pass; return counts and digests of both sides. A null text is empty.

    ``doc_id, n_tokens, ids_sha256`` (decimal ids joined by commas), ``decoded_sha256`` (UTF-8 of the decoded text).
    """

    def start():
        codec = codec_of(ranks_path, pattern)
        names = {rank: str(rank) for rank in codec.transducer.tokens}

        def work(doc_id: int | None, text: str | None) -> tuple:
            ids = codec.encode(text or "")
            decoded = hashlib.sha256()
            for piece in decode_stream(ids, codec.transducer.tokens):
                decoded.update(piece.encode())
            joined = ",".join(map(names.__getitem__, ids)).encode()
            return doc_id, len(ids), hashlib.sha256(joined).hexdigest(), decoded.hexdigest()

        return work

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs, ["doc_id", "text"], schema, start)
