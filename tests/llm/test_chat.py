import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscope.llm import chat
from tabscope.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"
odd_texts = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "/", "s>", "\\", "INST]", "ok", " ", "\n", "é", "🎉", "日", "<|endoftext|>"]), max_size=12).map("".join)


def order(row):
    """Nulls first, then turn, role and text."""
    return [(v is not None, v.encode() if isinstance(v, str) else v) if v is not None else (False, b"") for v in row[1:]]


def brute(rows, conv_id):
    own = sorted((r for r in rows if r[0] == conv_id), key=order)
    turns = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
    loss = "".join(text or "" for _, _, role, text in own if role == "assistant")
    return len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@given(odd_texts)
@settings(max_examples=300, deadline=None)
def test_escape_is_undone_and_hides_every_mark(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(mark in hidden for mark in chat.MARKS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "</s>", "", "<s>[INST]"]), odd_texts), max_size=6))
@settings(max_examples=200, deadline=None)
def test_masks_cover_the_trained_texts_and_nothing_else(turns):
    rendered = chat.render(turns)
    ids, runs = chat.encoded(rendered, PATH)
    decode = chat.tokenizer(PATH).decode
    assert decode(ids, skip_special_tokens=False) == rendered.text
    assert chat.parse(rendered.text) == turns
    said = [text for role, text in turns if role == "assistant" and text]
    assert [chat.unescape(decode(ids[a:b], skip_special_tokens=False)) for a, b in runs] == said


def test_a_token_that_crosses_a_border_is_an_error():
    rendered = chat.Rendered("abcd", [1], [3])
    with pytest.raises(ValueError, match="cross"):
        chat.masked(rendered, chat.np.array([0, 2]), chat.np.array([2, 4]))


@pytest.fixture(scope="module")
def conversations():
    source = random.Random(4)
    words = ["hello", "</s>", "[INST]", "é", "🎉🎉", "<\\s>", "\n\n", "  ", "日本"]
    rows = [(c, t, source.choice(["user", "assistant", "system"]), " ".join(source.choices(words, k=source.randrange(9)))) for c in range(30) for t in range(source.randrange(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(700)]  # several blocks
    rows += [(51, 3, "user", "same"), (51, 3, "user", "same"), (51, 3, "assistant", "tie"), (51, -5, "system", "below")]
    rows += [(52, 0, None, "no role"), (52, 1, "assistant", None), (52, None, "assistant", "no turn"), (None, 0, "assistant", "no id"), (None, 1, "user", "x")]
    rows += [(53, 0, "assistant", "long é " * 60_000), (54, 0, "assistant", "")]
    return rows


def test_digests_agree_with_plain_python(spark, conversations):
    df = spark.createDataFrame(conversations, SCHEMA).repartition(5)
    df = df.withColumns({c: F.lit(1) for c in ("ids", "block", "segment", "loss", "c", "b", "t", "r", "x")})
    for blocks, chars in ((512, 1_000_000), (3, 40)):
        formatted = chat.format_conversations(df, PATH, block_turns=blocks, segment_chars=chars)
        found = chat.digests(formatted, PATH).collect()
        assert len(found) == len({r[0] for r in conversations})
        for r in found:
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(conversations, r.conv_id)
    rows = chat.format_conversations(df, PATH).where("conv_id < 50").collect()
    assert len(rows) == 30 and all(chat.render([(t[2], t[3]) for t in sorted((c for c in conversations if c[0] == r.conv_id), key=order)]).text == r.text for r in rows)


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA), PATH), PATH).count() == 0


def test_query_with_the_planted_conversation(spark):
    folder = "/root/testdata/sf0.001"
    found = {r["conv_id"]: r for r in QUERIES["op11_chat_format"](spark, folder).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    assert set(found) == {r[0] for r in rows}
    for conv_id, r in found.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute(rows, conv_id)
    assert found[-7].formatted_chars == len(chat.render([("user", odd), ("assistant", odd)]).text)
