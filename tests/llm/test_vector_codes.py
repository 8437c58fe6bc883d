"""Vector codes against full scans in Python's integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import queries
from graphloom.llm.common import table
from graphloom.llm.vector_codes import LONGEST, Codebooks, code_digest, compress_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, _id string, _x int, codes int, error string, vec_ID2 long"


def by_full_scans(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error, codebooks_sha256 of (vec_id, vector, label)."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    longest = max((len(v) for _, v, _ in kept), default=1) or 1
    width = -(-longest // parts)
    cut = [[(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        d = ((np.array(books[p], object) - np.array(x, object)) ** 2).sum(axis=1).tolist()
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(p, c[p])[0]].append(c[p])
            new.append([[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else e for j, e in enumerate(books[p])])
        books = new
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [
        (i, "".join(f"{j:02x}" for j, _ in f), min(e, LONGEST), min(by_label[label], LONGEST), sha)
        for (i, _, label), f, e in zip(kept, found, errors)
    ]


def key(row):
    return tuple((x is None, x) for x in row)


def test_the_query_gives_the_full_scans_rows(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in queries.op11_vector_codes(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=key) == sorted(by_full_scans(rows), key=key)


ODD = [
    (None, [1.0, 2.0, 3.0], None), (1, None, 1), (2, [], 1), (3, [float("nan"), 1.0], 2), (4, [float("inf")], 2), (5, [None, 1.0], 2),
    (6, [0.1, -0.1, 0.003, -0.003], 3), (6, [0.1, -0.1, 0.003, -0.003], 3), (7, [0.5] * 20, None), (8, [1e9, -1e9], 4), (9, [0.0] * 17, 1),
    (9, [-0.0] * 16, 1), (-3, [-1.5] * 5, 3),
]


@pytest.mark.parametrize("entries", [1, 3, 64])
def test_odd_vectors(spark, entries):
    df = spark.createDataFrame([(*r, None, None, None, None, None) for r in ODD], SCHEMA)
    rows = [tuple(r)[:3] for r in df.collect()]
    got = [tuple(r) for r in code_digest(compress_vectors(df, entries=entries)).collect()]
    want = by_full_scans(rows, entries=entries)
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == 9


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1, None, None, None, None, None)], SCHEMA)
    for some in (df, df.where("false")):
        out = compress_vectors(some)
        assert code_digest(out).collect() == [] and out.codebook_rows().collect() == []


def test_many_ties_go_to_the_lower_index(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) / 256 for x in rnd.integers(-2, 3, 16)], int(i % 3)) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in code_digest(compress_vectors(df, parts=4, entries=20, rounds=4)).collect()]
    assert sorted(got) == sorted(by_full_scans(rows, 4, 20, 4))


def test_bounds_spare_scans_and_never_change_a_code():
    rnd = np.random.default_rng(6)
    centres = rnd.integers(-400, 400, (12, 2, 4))
    x = centres[rnd.integers(0, 12, 4000)] + rnd.integers(-9, 10, (4000, 2, 4))
    books = Codebooks(np.ascontiguousarray(x[:12].transpose(1, 0, 2)))
    code, upper, lower = np.zeros((4000, 2), np.int64), np.full((4000, 2), 1 << 61), np.zeros((4000, 2), np.int64)
    for turn in range(6):
        books.assign(x, code, upper, lower)
        d = ((x[:, :, None, :] - books.books[None]) ** 2).sum(axis=3)
        assert (code == d.argmin(axis=2)).all()
        second = np.sort(d, axis=2)[:, :, 1]
        assert (upper**2 >= d.min(axis=2) * 65536).all() and (lower**2 <= second * 65536).all()
        assert books.seen == 8000 and (books.scanned <= 8000)
        last = books.scanned
        sums, counts = np.zeros((2, 12, 4), object), np.zeros((2, 12), np.int64)
        for p in range(2):
            for j in range(12):
                own = x[code[:, p] == j, p]
                counts[p, j] = len(own)
                sums[p, j] = own.sum(axis=0)
        books = books.update(sums, counts)
    assert last < 800
