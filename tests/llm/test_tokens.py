"""Automaton and grammar against the tokenizers library."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from recurra.llm import automaton, grammar

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "   ", "a  b\n\n c", "日本語 text ١٢ ³½ x", "😀😀 ok", "don't we'll  'S", "\x1c\x1d a\x85b\xa0c", "a" * 50, "<|endoftext|>a<|endoftext|> b", "ΑΣ ΑΣ. İX Ⱥx", "é é", "***&&&$$$"]


@pytest.fixture(scope="module")
def coder():
    return automaton.Coder(open(BYTE, encoding="utf-8").read())


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


def texts():
    r = random.Random(3)
    return ODD + ["".join(r.choice("abcdefghi thern'é0ß  \n*") for _ in range(r.randint(1, 80))) for _ in range(800)]


def test_automaton_equals_library(coder, byte_library):
    for t in texts():
        want = byte_library.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == want, t
        ids = coder.coded(t)
        assert [int(i) for i in ids.split(",") if i] == want, t
        assert coder.emitted(ids) == t.encode()
        assert coder.decode(want) == byte_library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_automaton_equals_library_on_any_text(coder, byte_library, t):
    assert coder.encode(t) == byte_library.encode(t, add_special_tokens=False).ids


def test_path_goes_back_where_the_longest_label_leads_nowhere(coder, byte_library):
    r = random.Random(8)
    words = ["".join(r.choice("ehtnoairs") for _ in range(r.randint(1, 40))) for _ in range(4000)]
    back = 0
    for w in words:
        want = byte_library.encode(w, add_special_tokens=False).ids
        assert coder.encode_word(w) == want, w
        back += want[0] != coder.machine.longest(w.encode(), 0)
    assert back > 100                                               # words whose path does not begin with the longest label
    assert coder.machine.encode(b"") == []


def test_gadgets_by_hand():
    # a b c = 0 1 2; merges aa -> 3, ab -> 4
    g = automaton.Gadgets(5)
    g.merge(0, 0, 3, 0)
    g.merge(0, 1, 4, 1)
    assert not g.arc(0, 0) and not g.arc(0, 1) and not g.arc(0, 3) and g.arc(0, 2)
    assert g.arc(3, 0) and g.arc(3, 3) and g.arc(3, 4) and g.arc(4, 0)
    assert not g.arc(0, 4)                       # a + ab is read as aa + b


def test_encode_decode_of_odd_input(make, byte_library):
    long = "word and " * 200_000
    docs = make([(1, None), (2, ""), (None, "the"), (3, long), (3, long), (4, "<|endoftext|>")])
    rows = automaton.encode_decode(docs, BYTE, keep_ids=True).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 6 and by[1].n_tokens == 0 and by[1].ids == [] and by[1].ids_sha256 == by[1].decoded_sha256 == nothing
    assert by[4].ids == [50256] and by[3].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert by[3].ids == byte_library.encode(long, add_special_tokens=False).ids
    assert automaton.encode_decode(docs.limit(0), BYTE).count() == 0


def test_word_encoder_equals_library():
    e, lib = grammar.Encoder(open(WORD, encoding="utf-8").read()), Tokenizer.from_file(WORD)
    assert e.known
    for t in texts() + ["x" + chr(c) * 2 + " B" + chr(c) for c in range(0x300)]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(1, 8))
def test_grammar_round_trip(ids, rounds):
    a = np.array(ids, "<u4")
    left, right, lengths, seq = grammar.compress(a, 6, rounds, 2)
    g = grammar.Grammar(6, left.tobytes(), right.tobytes(), lengths.tobytes())
    s = seq.astype(np.int64)
    assert (g.expand(s) == a).all()
    for b, e in ((0, len(a)), (len(a) // 3, len(a) // 2)):
        if e > b:
            assert (grammar.decode_range(g, s, b, e) == a[b:e]).all()


def test_grammar_compresses_repeats():
    a = np.array([1, 2, 3, 4] * 1000, "<u4")
    left, _, _, seq = grammar.compress(a, 10, 20, 2)
    assert len(seq) + 3 * len(left) < 200


def test_rounds_go_on_until_no_pair_is_frequent():
    r = np.random.default_rng(1)
    a = np.concatenate([r.integers(0, 50, 3000), np.tile(r.integers(0, 50, 500), 6)]).astype("<u4")
    left, right, lengths, seq = grammar.compress(a, 50, None, 4)
    assert lengths.max() > 64                                     # a copied passage is one rule or few
    g = grammar.Grammar(50, left.tobytes(), right.tobytes(), lengths.tobytes())
    assert (g.expand(seq.astype(np.int64)) == a).all()
    fewer = grammar.compress(a, 50, 6, 4)
    assert len(seq) < len(fewer[3])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300), st.integers(2, 5))
def test_rules_are_the_frequent_pairs(pairs, least):
    a = np.array(pairs, np.int64) << 30
    rule, use, which = grammar._rules(a, least)
    want, n = np.unique(a, return_counts=True)
    assert rule.tolist() == want[n >= least].tolist()
    assert use.tolist() == np.nonzero(np.isin(a, rule))[0].tolist() and (rule[which] == a[use]).all()


def test_rare_pairs_are_not_sorted_round_after_round(monkeypatch):
    r = np.random.default_rng(2)
    a = np.minimum(r.zipf(1.3, 200_000), 40_000).astype("<u4")
    seen, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *args, **kw: seen.append(len(x)) or unique(x, *args, **kw))
    left, right, lengths, seq = grammar.compress(a, 40_001, None, 4)
    g = grammar.Grammar(40_001, left.tobytes(), right.tobytes(), lengths.tobytes())
    assert (g.expand(seq.astype(np.int64)) == a).all() and len(seen) > 5
    assert sum(seen) < len(a) // 10


def test_word_with_one_mark_is_cut_without_the_rule(monkeypatch):
    e, lib = grammar.Encoder(open(WORD, encoding="utf-8").read()), Tokenizer.from_file(WORD)
    text = "Then, the cat. sat! on² it7 über; ß' x"
    monkeypatch.setattr(grammar, "PIECES", None)
    assert np.frombuffer(e.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_shards_read_back(spark, make):
    lib = Tokenizer.from_file(WORD)
    rows = [(7, "The cat."), (None, "zero"), (3, None), (5, ""), (9, "dog " * 3000), (9, "dog " * 3000), (4, "b a")]
    got = sorted(grammar.round_trip(make(rows), WORD, shard_tokens=500).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 3, 4, 5, 7, 9, 9]
    start = 0
    for r, t in zip(got, ["zero", "", "b a", "", "The cat.", "dog " * 3000, "dog " * 3000]):
        ids = lib.encode(t, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert grammar.round_trip(make(rows).limit(0), WORD).count() == 0
