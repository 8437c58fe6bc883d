"""Periodic runs against the definition, checked period by period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries
from graphloom.llm.common import table
from graphloom.llm.periodic_runs import Names, collapsed, lempel_ziv, periodic_runs, planted_run, run_digest, runs_of


def all_runs(words, shortest=12):
    """By definition: of each period the longest stretches of words that equal the one a period before."""
    out = []
    text = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.zeros(0, int)
    n, seen = len(text), set()
    for q in range(1, n // 2 + 1):
        same = np.concatenate(([False], text[q:] == text[:-q], [False])).astype(int)
        edge = np.diff(same)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if b - a >= q and (a, b + q) not in seen:  # a multiple of a shorter period has the same stretch
                seen.add((a, b + q))
                if b + q - a >= shortest:
                    out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(words, doc_id):
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def words_of(text):
    out, now = [], b""
    for c in (text or "").encode() + b" ":
        if c == 0x20 or 9 <= c <= 13:
            out += [now] * bool(now)
            now = b""
        else:
            now += bytes([c])
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def test_the_query_gives_the_definitions_runs(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = [digest(words_of(r.text), r.doc_id) for r in docs.collect()]
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) >= 10


def word(rnd, letters):
    return rnd.choice("abcdefgh"[:letters]).encode()


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_texts(letters):
    rnd = random.Random(letters)
    for turn in range(250):
        n = rnd.randint(0, 70)
        words = [word(rnd, letters) for _ in range(n)]
        for _ in range(rnd.randint(0, 3)):  # repetitions, nested and next to each other
            if words:
                a = rnd.randrange(len(words))
                part = words[a : a + rnd.randint(1, 9)]
                words[a:a] = part * rnd.randint(1, 4)
        text = np.append(np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int), 99)
        assert [tuple(r) for r in runs_of(text).tolist()] == all_runs(words, 0), words


def test_blocks_are_the_longest_earlier_strings():
    rnd = random.Random(3)
    for _ in range(60):
        words = [rnd.randrange(3) for _ in range(rnd.randint(1, 50))] + [9]
        names = Names(np.array(words))
        begins = lempel_ziv(names).tolist()
        at, want = 0, []
        while at < len(words):
            want.append(at)
            length = 0
            while any(words[j : j + length + 1] == words[at : at + length + 1] for j in range(at)) and at + length < len(words):
                length += 1
            at += max(length, 1)
        assert begins == [*want, len(words)]


ODD = [
    (None, None), (1, None), (2, ""), (3, " \n\x0b "), (4, "a b " * 6), (5, "a " * 11), (5, "a " * 12), (5, "a " * 12), (6, "a b\x1c é " * 7),
    (7, "x y " * 40000), (8, " ".join(map(str, range(50000)))), (9, ("p q r s t u v w x y z " * 3 + "and ") * 5), (10, "q" * 300000),
    (2**62 + 1, "long id " * 9),
]


def test_odd_texts(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("_id", "_text", "runs", "_by", "n_words", "collapsed")))
    got = [tuple(r) for r in run_digest(periodic_runs(df)).collect()]

    def plain(i, t):
        row = digest(words_of(t) if len(t or "") < 10000 else [], None)
        return (i, *row[1:])

    want = [plain(i, t) for i, t in ODD]
    short = [k for k, (_, t) in enumerate(ODD) if len(t or "") < 10000]
    assert len(got) == len(ODD)
    assert sorted((want[k] for k in short), key=key) == sorted((r for r in got if r[0] not in (7, 8, 10)), key=key)
    long = {r[0]: r for r in got if r[0] in (7, 8, 10)}
    assert long[7][1:6] == (1, 0, 80000, 2, 40000000) and long[7][7] == hashlib.sha256(b"x y").hexdigest()
    assert long[8][1:6] == long[10][1:6] == (0, None, None, None, None)
    assert periodic_runs(df.where("false")).collect() == []
    text = {r.doc_id: r.collapsed for r in periodic_runs(df, with_text=True).collect()}
    assert text[4] == "a b" and text[7] == "x y" and text[2] == ""


def test_the_planted_run_changes_every_tenth_text():
    words = [bytes([65 + i]) for i in range(20)]
    for seed in range(0, 4000, 7):
        want = digest(words, None) if seed % 10 else None
        changed = planted_run(words, seed)
        assert len(changed) == 20 and (want is None or changed == words)
    assert planted_run(words, None) == words and planted_run([], 10) == []


def test_overlapping_runs_keep_each_first_period():
    assert collapsed(list("aaaabab"), [(0, 4, 1), (3, 4, 2)]) == ["a", "b"]
