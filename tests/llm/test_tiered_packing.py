"""Hierarchical packing: an exact round trip, full windows, balanced steps; and the word tokenizer against the library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import queries
from graphloom.llm.common import table
from graphloom.llm.tiered_packing import TIERS, Plan, filling, pack_tiers
from graphloom.llm.word_tokens import WordStore

WORDS = public_tokenizers.path("word_bpe_49k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(rows, texts, windows=None):
    """The pieces of (id, text) rows against the tokenizer itself."""
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in texts:
        want[(i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]))] += 1
    by_id = defaultdict(list)
    for (i, ids), n in want.items():
        by_id[i] += [ids] * n
    seqs, covered = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        covered[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(covered) == set(by_id)
    for i, texts_of_id in by_id.items():
        need = Counter()  # of equal ids, any pieces that together are all the ids of all texts
        for ids in texts_of_id:
            need.update((len(ids), p) for p in range(len(ids)))
        have = Counter()
        for start, length, sha, tokens in covered[i]:
            assert any(len(ids) == tokens and crc(ids[start : start + length]) == sha for ids in texts_of_id)
            have.update((tokens, p) for p in range(start, start + length))
        assert have == need
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own]).tolist()
        assert [r.offset for r in own] == [0, *ends[:-1]]
        assert ends[-1] & (ends[-1] - 1) == 0 and ends[-1] <= 2048 and {r.window for r in own} == {ends[-1]}
    assert sum(w[-1].offset + w[-1].length for w in seqs.values()) == sum(len(ids) * n for (_, ids), n in want.items())
    return seqs


def test_the_query_packs_the_whole_table(spark):
    docs = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    rows = queries.op13_tiered_packing(spark, "/root/testdata/sf0.001").collect()
    seqs = check(rows, docs)
    steps = defaultdict(list)
    for own in seqs.values():
        steps[(own[0].window, own[0].step)].append(sum(r.length**2 for r in own))
    assert len({s for _, s in steps}) == len(steps)  # a step has windows of one length
    for size in TIERS:
        own = [v for (w, _), v in steps.items() if w == size]
        assert max(map(len, own), default=0) - min(map(len, own), default=0) <= 1
    tokens = sum(r.length for r in rows)
    assert sum(r.length for r in rows if r.window in TIERS) >= tokens - 256


ODD = [(None, None), (1, None), (2, ""), (3, " \n "), (4, "a"), (5, "a b"), (5, "a b"), (6, "b"), (6, "c d e"), (7, "it's <|endoftext|> É ﬁ 中文 \x1c"), (8, "word " * 9000), (2**62 + 1, "q" * 9000)]


def test_odd_texts(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").select("*", *(F.lit(7).alias(c) for c in ("_id", "_text", "length", "start", "_ids", "_part", "window")))
    check(pack_tiers(df, WORDS).collect(), ODD)
    assert pack_tiers(df.where("false"), WORDS).collect() == []
    equal = spark.createDataFrame([(i, "one two three " * 50) for i in range(60)], "doc_id long, text string").repartition(5)
    check(pack_tiers(equal, WORDS).collect(), [(i, "one two three " * 50) for i in range(60)])


@pytest.mark.parametrize("seed", range(12))
def test_plans_use_every_token_once(seed):
    rnd = random.Random(seed)
    top = rnd.choice([16, 64, 2048])
    tiers = tuple(top >> i for i in range(rnd.randint(1, 3)))
    counts = {rnd.randint(1, top): rnd.choice([1, 2, 3, 1000]) for _ in range(rnd.randint(0, 30))}
    plan = Plan(dict(counts), tiers, step_tokens=4 * top)
    find = plan.lookup()
    length = np.repeat(list(counts), list(counts.values())).astype(np.int64) if counts else np.zeros(0, np.int64)
    rank = np.concatenate([np.arange(n) for n in counts.values()]) if counts else np.zeros(0, np.int64)
    piece, part = find.find(length, rank)
    tokens = Counter()
    for p, skip, n in zip(piece.tolist(), part["skip"].tolist(), part["length"].tolist()):
        tokens.update((p, i) for i in range(skip, skip + n))
    assert set(tokens.values()) <= {1} and len(tokens) == int(length.sum())
    fill = defaultdict(set)
    for s, offset, n, window in zip(*(part[c].tolist() for c in ("sequence_id", "offset", "length", "window"))):
        own = set(range(offset, offset + n))
        assert not fill[(s, window)] & own
        fill[(s, window)] |= own
    assert all(own == set(range(window)) for (_, window), own in fill.items())
    assert sorted(s for s, _ in fill) == list(range(len(fill)))


def test_huge_counts_need_few_patterns():
    rnd = np.random.default_rng(1)
    counts = {int(n): int(c) for n, c in zip(range(1, 2049), rnd.uniform(0.5, 1.5, 2048) * 1e9 * np.exp(-np.arange(2048) / 500))}
    plan = Plan(counts)
    assert len(plan.patterns) < 6000 and sum(w.size * w.times for w in plan.patterns) == sum(n * c for n, c in counts.items())
    assert sum(w.times for w in plan.patterns if w.cut) < 0.05 * sum(w.times for w in plan.patterns)
    assert len(Plan({1500: 10**9}).patterns) < 500


def test_gaps_prefer_two_that_close_them():
    left = np.zeros(11, np.int64)
    left[[8, 7, 3]] = 1
    assert filling(left.copy(), 10) == ([(7, 1), (3, 1)], None, 0)
    assert filling(left.copy(), 2) == ([], (8, 2), 0)
    assert filling(np.zeros(11, np.int64), 2) == ([], None, 2)


def test_words_have_the_librarys_tokens():
    rnd = random.Random(2)
    parts = ["a", "B", "'s", "'S", "'ll", "\n", " ", " ", "  ", "\t", "\x1c", "\x85", " ", "é", "É", "é", "İ", "ŉ", "ſ", "ŷ", "Ÿ", "ß", "×", "÷", "ª", "²", "1", "23", "中", "<|endoftext|>", "<|", "don't", "\r", ".", "--'", "Ω", "­", "_", "ĳ", "Σ"]
    whole, store = Tokenizer.from_file(WORDS), WordStore(WORDS, limit=40)
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(store.ids(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    for i in [*range(0x21, 0x7F), *range(0xA0, 0x250)]:
        for t in (chr(i), f"a{chr(i)}b", f"{chr(i)}1{chr(i)}"):
            assert np.frombuffer(store.ids(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
