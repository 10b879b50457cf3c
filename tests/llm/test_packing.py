import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from scoreframe.llm import swap_packing, token_output
from scoreframe.llm.tokens import default_tokenizer, tokenizer

from . import awkward


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(default_tokenizer())


def test_ids_equal_the_library(reference):
    r = random.Random(1)
    bits = [" ", "  ", "\n", "\t", "a", "b", "é", "日", "the", "1", "23", "!", "'s", "<|endoftext|>", "\x1c", "\x85", "　", "​", "🙂"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randint(33, 126), r.randint(160, 1500)])) for _ in range(8)) for _ in range(3000)]
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    tok = tokenizer(default_tokenizer())
    assert [np.frombuffer(tok.encode(t), "<u4").tolist() for t in texts] == want


@pytest.mark.parametrize("size", [50_000, 1_000_000])
def test_ids_of_long_words_and_runs(reference, size):
    r = random.Random(2)
    word = "".join(r.choice("abcdefgh") for _ in range(size))
    texts = [word, "x" * size, "a" + " " * size + "b \n", "\n" * size, "a" + "\u3000" * size + "\x1cb <|endoftext|>" + "\t" * size]
    texts += ["b" + " " * size + "<|endoftext|> c", " " * size]
    tok = tokenizer(default_tokenizer())
    for t in texts:
        assert np.frombuffer(tok.encode(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids


def ids(reference, text):
    return [*reference.encode(text or "", add_special_tokens=False).ids, 2]


def check_pieces(reference, rows, got, first_shorter):
    """Every document's ids once, in pieces that are cut as they should be, at places without gaps."""
    texts = Counter()
    for r in rows:
        texts[(r[0], tuple(ids(reference, r[1])))] += 1
    seen = defaultdict(list)
    for p in got:
        seen[(p.doc_id, p.start, p.length, p.ids_crc32, p.piece)].append(p)
    want = Counter()
    for (i, all_ids), n in texts.items():
        size = len(all_ids)
        if first_shorter:
            cuts = [0, *range(size % 1024 or 1024, size, 1024), size]
        else:
            cuts = [*range(0, size, 1024), size]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            crc = zlib.crc32(np.array(all_ids[a:b], "<u4").tobytes())
            want[(i, a, b - a, crc, k)] += n
    assert Counter({k: len(v) for k, v in seen.items()}) == want
    places = defaultdict(list)
    for p in got:
        places[p.sequence_id].append((p.offset, p.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places), -(-sum(p.length for p in got) // 1024)


def test_swap_packing(spark, reference):
    got = swap_packing.pack(awkward.docs(spark)).collect()
    used, least = check_pieces(reference, awkward.rows(), got, first_shorter=True)
    assert used <= least + 1
    assert swap_packing.pack(awkward.empty(spark)).count() == 0


def test_assembled_ids(spark, reference):
    placed = swap_packing.pack(awkward.docs(spark).where("length(text) < 500"), with_ids=True)
    rows = {r.doc_id: r.text for r in awkward.docs(spark).where("length(text) < 500 AND doc_id != 9").collect()}
    for s in swap_packing.assemble(placed).collect():
        all_ids = np.frombuffer(bytes(s["ids"]), "<u4").tolist()
        for seg in s.segments:
            if seg.doc_id in rows:
                assert all_ids[seg.offset : seg.offset + seg.length] == ids(reference, rows[seg.doc_id])


def plain_bfd(lengths, width):
    bins = []
    for x in sorted(lengths, reverse=True):
        fitting = [b for b in bins if sum(b) + x <= width]
        if fitting:
            max(fitting, key=sum).append(x)
        else:
            bins.append([x])
    return bins


@pytest.mark.parametrize("low, high, n", [(1, 50, 60), (20, 50, 80), (1, 100, 40), (34, 36, 50)])
def test_best_fit_and_search(low, high, n):
    r = random.Random(n)
    lengths = [r.randint(low, high) for _ in range(n)]
    want = plain_bfd(lengths, 100)
    bins = swap_packing.best_fit(Counter(lengths), 100)
    assert sum(bins.values()) == len(want)
    after = swap_packing.local_search(bins, 100)
    assert sum(after.values()) <= len(want)
    for packing in (bins, after):
        held = Counter()
        for pattern, k in packing.items():
            assert sum(pattern) <= 100
            for x in pattern:
                held[x] += k
        assert held == Counter(lengths)
    rows = token_output.best_fit_decreasing(lengths, 100)
    assert len(rows) == len(want) and sorted(k for row in rows for k in row) == list(range(n))
    assert all(sum(lengths[k] for k in row) <= 100 for row in rows)


def test_search_empties_a_bin():
    """Best fit needs four bins of 10, three suffice: 6+4, 5+5, 4+3+3."""
    bins = Counter({(6, 3): 1, (5, 4): 1, (5, 4): 1, (3,): 1})
    bins[(5, 4)] = 2
    after = swap_packing.local_search(bins, 10)
    assert sum(after.values()) == 3


@pytest.mark.parametrize("block_tokens", [4_000_000, 3000])
def test_matrices(spark, reference, block_tokens):
    got = token_output.written(awkward.docs(spark), block_tokens=block_tokens).collect()
    check_pieces(reference, awkward.rows(), got, first_shorter=False)
    assert {r.resets for r in got} == {1}
    assert token_output.written(awkward.empty(spark)).count() == 0
