import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scoreframe.llm import chat_masks
from scoreframe.llm.tokens import default_tokenizer, tokenizer

from .awkward import CLASHES

BITS = [*chat_masks.MARKERS, "\\", "<", "[", ">", "]", "/", "s>", "INST]", "<|endoftext|>", "a", "é", " ", "\n", "日本", "🙂", "ok"]
TEXT = st.lists(st.sampled_from(BITS), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant", "", "tool"]), TEXT), TEXT), max_size=6)


@pytest.fixture(scope="module")
def tok():
    return tokenizer(default_tokenizer(), chat_masks.MARKERS)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escaping_is_reversible(text):
    hidden = chat_masks.escape(text)
    assert chat_masks.unescape(hidden) == text
    assert not any(m in hidden for m in chat_masks.MARKERS)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_round_trip(turns):
    tok = tokenizer(default_tokenizer(), chat_masks.MARKERS)
    data, loss, tokens = chat_masks.encode(tok, turns)
    ids = np.frombuffer(data, "<u4")
    assert chat_masks.parse(tok, ids) == turns
    assert chat_masks.masked_texts(tok, ids, loss) == [t for r, t in turns if r == "assistant" and t]
    rendered, spans = chat_masks.render(turns)
    edges = chat_masks.token_spans(tok, ids)
    for (a, b), (first, end), (_, text) in zip(spans, tokens.tolist(), turns, strict=True):
        assert rendered.encode()[a:b].decode() == chat_masks.escape(text)
        # The edges of a turn are edges of tokens.
        assert (edges[first], edges[end]) == (a, b)


def test_ids_of_texts_equal_the_library(tok):
    reference = Tokenizer.from_file(default_tokenizer())
    reference.encode_special_tokens = True
    turns = [("system", "be  brief "), ("user", " hi\n\nthere <|endoftext|>"), ("assistant", "l'été 日本  "), ("tool", "x" * 50)]
    data, _, tokens = chat_masks.encode(tok, turns)
    ids = np.frombuffer(data, "<u4").tolist()
    for (_, text), (a, b) in zip(turns, tokens.tolist(), strict=True):
        assert ids[a:b] == reference.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=20), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)), max_size=6))
def test_intersection(lengths, spans):
    """Also where spans begin and end within tokens: those that share a byte."""
    edges = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
    spans = sorted((a, a + n) for a, n in spans)
    for (a, b), (first, end) in zip(spans, chat_masks.intersect(edges, spans).tolist(), strict=True):
        want = [k for k in range(len(lengths)) if edges[k] < b and edges[k + 1] > a and a < b]
        assert list(range(first, end)) == want or not want and (a == b or end == first)


def test_damaged_ids_raise(tok):
    data, _, _ = chat_masks.encode(tok, [("user", "hi"), ("assistant", "yes")])
    ids = np.frombuffer(data, "<u4")
    for bad in (ids[1:], ids[:-1], np.delete(ids, 2), ids[::-1]):
        with pytest.raises(ValueError):
            chat_masks.parse(tok, bad)


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    out = []
    for conv, turns in by.items():
        said = [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        out.append((conv, len(said), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat_masks.render(said)[0])))
    return Counter(out)


def rows():
    r = random.Random(5)
    out = []
    for conv in range(40):
        for turn in range(r.choice([1, 2, 7, 60])):
            role = r.choice(["system", "user", "assistant", "assistant", "tool", None, "</s>"])
            out.append((conv, turn, role, r.choice([None, "", "".join(r.choice(BITS) for _ in range(r.randint(0, 30)))])))
    out += [out[0], out[0], (3, 0, "assistant", "again"), (None, 1, "user", "x"), (None, None, "assistant", "y"), (4, None, None, None)]
    return [*out, (50, 1, "assistant", "word " * 60_000), (50, 5000, "assistant", " " * 12_000), (50, -3, "user", "first"), (50, 2, "assistant", "z" * 5000)]


def table(spark, data):
    names = ", ".join(f"{c} string" for c in [*CLASHES, "block", "ids", "loss", "turns"])
    schema = f"conv_id long, turn long, role string, text string, {names}"
    return spark.createDataFrame([(*x, *["clash"] * (len(CLASHES) + 4)) for x in data], schema).repartition(3)


@pytest.mark.parametrize("turns, chunk", [(1024, 1 << 18), (3, 40)])
def test_tables(spark, monkeypatch, turns, chunk):
    """Whole conversations, and the same through many blocks and rows."""
    monkeypatch.setattr(chat_masks, "TURNS", turns)
    monkeypatch.setattr(chat_masks, "CHUNK", chunk)
    formatted = chat_masks.format_conversations(table(spark, rows()))
    assert (formatted.groupBy("conv_id").count().where("count > 1").count() > 5) == (turns == 3)
    got = chat_masks.read_back(formatted)
    assert Counter(map(tuple, got.collect())) == brute(rows())


def test_empty_table_and_other_roles(spark, tok):
    assert chat_masks.read_back(chat_masks.format_conversations(table(spark, []))).count() == 0
    formatted = chat_masks.format_conversations(table(spark, [(1, 0, "user", "ab"), (1, 1, "tool", "cd")]), loss_roles=("tool", "user"))
    row = formatted.collect()[0]
    ids = np.frombuffer(bytes(row.ids), "<u4")
    loss = np.unpackbits(np.frombuffer(bytes(row.loss), np.uint8), count=len(ids))
    assert chat_masks.masked_texts(tok, ids, loss) == ["ab", "cd"]
    assert [t.role for t in row.turns] == ["user", "tool"]
