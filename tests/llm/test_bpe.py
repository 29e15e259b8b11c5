import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tabscope.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("limit", [0, 40, 60_000])
def test_same_ids_as_the_public_library(reference, rows, limit):
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    codec.transducer.limit, codec.words.limit = limit, 50
    source = random.Random(2)
    texts = [r[1] or "" for r in rows]
    texts += ["".join(source.choice("theniga é日\n\t0🎉'sx§ ") for _ in range(source.randrange(60))) for _ in range(300)]
    texts += ["ab" * 3000 + "the" * 2000, "<|endoftext|>", " " * 500, "\n\n \n" * 50]
    for text in texts:
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text


def test_transducer_agrees_with_the_definition():
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    source = random.Random(3)
    for _ in range(400):
        data = bytes(source.choice(b"aeinrst \xc3\xa9\xe6\x97") for _ in range(source.randrange(1, 25)))
        assert [codec.transducer.tokens[i] for i in codec.transducer.encode(data)] == codec.transducer.merged(data)


def test_streams_are_cut_between_characters():
    text = "é日🎉a" * 20
    for size in range(1, 6):
        machine, data = bpe.Utf8Machine(), text.encode()
        parts = [machine.feed(data[i : i + size]) for i in range(0, len(data), size)]
        assert "".join(parts) + machine.finish() == text and all("�" not in p for p in parts)
    broken = bpe.Utf8Machine()
    assert broken.feed(b"a\xe6\x97") + broken.feed(b"b\xf0") + broken.finish() == "a�b�"


def test_digests_of_documents(docs, nothing, rows, reference):
    found = {r["doc_id"]: r for r in bpe.round_trip_digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert len(found) == len(rows)
    for doc_id, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        assert tuple(found[doc_id])[1:] == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(),
        )
    assert bpe.round_trip_digests(nothing, PATH, public_tokenizers.PATTERN).count() == 0
    encoded = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, PATH).collect()}
    assert back == {doc_id: text or "" for doc_id, text, *_ in rows}


def test_pieces_last_over_tasks_and_long_ones_are_not_kept(reference):
    assert bpe.codec_of(PATH, public_tokenizers.PATTERN) is bpe.codec_of(PATH, public_tokenizers.PATTERN)
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    codec.words.limit = 4
    texts = ["one two three", "x" * 500, "one four five six seven", "one two", "eight nine one", "x" * 500] * 3
    assert [codec.encode(t) for t in texts] == [reference.encode_ordinary(t) for t in texts]
    assert len(codec.words) + len(codec.words.older) <= 4 and all(len(p) <= bpe.KEPT_PIECE for p in codec.words)


def test_decoding_takes_ids_as_they_come(reference):
    taken = []

    def ids():
        for i in reference.encode_ordinary("é日🎉 and more " * 50):
            taken.append(i)
            yield i

    stream = bpe.decode_stream(ids(), {i: t for t, i in bpe.read_ranks(PATH).items()}, 7)
    assert next(stream) and len(taken) == 7
    assert "é日🎉 and more " * 50 == reference.decode(taken[:7]) + "".join(stream)


def test_pieces_beyond_the_table_cost_a_lookup_a_token():
    """Openings that were met before are not walked byte by byte again."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    transducer = bpe.Transducer(ranks, 0)
    pieces = [b" thesorth", b" onhahent", b"zq zq xj", "enbeein\u00e4tz\u00f6".encode(), b"aaaaaaaaaaaaaaaaaaab", bytes(range(256))]

    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    transducer.parts = Counted(transducer.parts)
    first = [transducer.encode(p) for p in pieces]
    assert first == [[ranks[t] for t in transducer.merged(p)] for p in pieces]
    Counted.asked = 0
    assert [transducer.encode(p) for p in pieces] == first
    assert Counted.asked < sum(map(len, pieces)) / 4
