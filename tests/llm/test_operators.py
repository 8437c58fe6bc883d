"""Each operator against brute force on small fixtures, and on every kind of odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import packing, queries
from graphloom.llm.chunk_tokens import ChunkStore, byte_chunks, chunk_ids, id_bytes, id_counts, space_chunks
from graphloom.llm.components import connected_components
from graphloom.llm.decontamination import contamination_digest, find_contamination, without_contaminated
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.packing import fullest, pack, plan_bins
from graphloom.llm.personal_data import find_personal_data, personal_data_digest, score_graph
from graphloom.llm.sharding import longest_walk, numbered, permute, rectangle, shard_rows
from graphloom.llm.simhash import near_duplicates
from graphloom.llm.suffix_dedup import common_prefixes, repeated_passages, repeated_windows, suffix_order
from graphloom.llm.token_counts import PrefixCounter, token_counts
from graphloom.llm.toxicity import fit_severity, score_toxicity, without_toxic
from graphloom.llm.url_filters import judge_urls, sweep

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
CLASH = ["_id", "_row", "_text", "_sha", "_fp", "_key", "_name", "_bytes", "_n", "kept", "text_sha256", "__keep_id", "lang"]
#: Null id and text, empty and blank texts, ties, a row given twice, one id with two texts, a long text.
ODD = [
    (None, None), (1, None), (2, ""), (3, " \n "), (4, "a"), (5, "a"), (5, "a"), (6, "b"), (6, "c"),
    (7, "The +1 (132) 555-1352 or x@y.zz, 1.2.3.4 it's <|endoftext|> \x01\x02 \U0001F600 é"), (8, "word " * 30000), (9, "q" * 100000), (10, "word " * 30000),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, None, 1), (None, 1, 1), (8, 1, None), (8, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word word word"), (2, None), (None, "b"), (3, ""), (3, "q " * 20), (1, "word word word")], "item_id long, text string")


OPERATORS = {
    "token_counts": lambda d, l, b: token_counts(d, WORDS),
    "shard_rows": lambda d, l, b: shard_rows(d),
    "judge_urls": lambda d, l, b: judge_urls(d, queries.URL_RULES, "doc_id", "text"),
    "near_duplicates": lambda d, l, b: near_duplicates(d),
    "score_toxicity": lambda d, l, b: score_toxicity(d, l),
    "find_personal_data": lambda d, l, b: personal_data_digest(find_personal_data(d)),
    "find_contamination": lambda d, l, b: contamination_digest(find_contamination(d, b)),
    "repeated_passages": lambda d, l, b: repeated_passages(d),
    "pack": lambda d, l, b: pack(d, BYTES),
    "exact_dedup": lambda d, l, b: exact_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_input_gives_every_row_a_result(name, odd, empty, labels, bench):
    op = OPERATORS[name]
    rows = op(odd, labels, bench).collect()
    ids = Counter(r["doc_id"] for r in rows)
    want = Counter(i for i, _ in ODD)
    assert set(ids) == set(want)
    if name != "pack":
        assert ids == want
    none = op(empty, labels, bench)
    assert none.collect() == [] and none.columns == op(odd, labels, bench).columns
    by_id = {r["doc_id"]: tuple(r)[1:] for r in rows}
    if name in ("token_counts", "near_duplicates", "score_toxicity", "find_personal_data", "repeated_passages"):
        assert by_id[1][0] == by_id[2][0]  # null is empty


@pytest.mark.parametrize("name", ["score_toxicity", "find_contamination"])
def test_empty_side_tables(name, odd, labels, bench):
    assert OPERATORS[name](odd, labels.where("false"), bench.where("false")).count() == len(ODD)


def test_chunks_have_the_tokens_of_the_whole_text():
    rnd = random.Random(1)
    parts = ["a", "b", "'s", "\n", " ", " ", "  ", "\t", "\x1c", "\x85", "\u00a0", "é", "e\u0301", "İ", "1", "中", "<|endoftext|>", "don't", "\r", "."]
    whole, words = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    store, counter = ChunkStore(BYTES, id_bytes, limit=50), PrefixCounter(WORDS)
    for _ in range(1500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        got = b"".join(store.lookup([space_chunks(t, store.special)], str)[0])
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
        sums = counter.counts([t.encode()])[0]
        each = [len(words.encode(t[:p], add_special_tokens=False).ids) for p in range(len(t) + 1)]
        assert sums[-1] == each[-1], repr(t)
        assert [counter.count(t, sums, p) for p in range(len(t) + 1)] == each
        assert counter.longest_prefix(t, sums, 3) == max(p for p, n in enumerate(each) if n <= 3)


def test_chunks_of_many_texts_have_their_tokens():
    rnd = random.Random(41)
    parts = [*"abZé19.,'-\n\n\t\r   ×÷ªſŉ²", "the", "Über", "'s", "'t", "'LL", "don't", " \u00a0", "\x1c", "\x85", "\u0301", "\u1680", "\u180e", "\u2003", "\u2028", "\u200b", "\u3000", "“", "—", "中", "ж", "😀", "\0"]
    parts += ["<|endoftext|>", "<|", "".join(map(chr, range(0xC0, 0x180)))]
    whole, store = Tokenizer.from_file(BYTES), ChunkStore(BYTES, id_bytes, limit=50)
    for _ in range(300):
        texts = ["".join(rnd.choice(parts[: rnd.choice([9, 30, 99])]) for _ in range(rnd.randint(0, 14))) for _ in range(rnd.randint(0, 12))]
        chunks, firsts = byte_chunks(pa.array(["left out", *texts], pa.string())[1:], store.special)
        ids, begins = chunk_ids(store, chunks)
        got = [ids[a:b].tolist() for a, b in zip(begins[firsts], begins[firsts[1:]])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts], texts


def test_new_words_are_encoded_once_and_without_the_pattern():
    rnd = random.Random(42)
    words = ["".join(rnd.choice("aeioußénrst") for _ in range(9)) for _ in range(500)]
    texts = [f"{rnd.choice('AB')} {w}. {w}, {w}\n{w}!! {w}" for w in words]
    store, told, patterned = ChunkStore(BYTES, id_bytes), [], []
    encode, others = store.encode, store._others
    store.encode = lambda texts: told.extend(texts) or encode(texts)
    store._others = lambda texts: patterned.extend(texts) or others(texts)
    chunks, firsts = byte_chunks(pa.array(texts), store.special)
    ids, begins = chunk_ids(store, chunks)
    assert len(told) == len(set(told)) <= 2 * len(set(words)) + 10 and len(patterned) <= 5, (len(told), patterned)
    whole = Tokenizer.from_file(BYTES)
    assert [ids[a:b].tolist() for a, b in zip(begins[firsts], begins[firsts[1:]])] == [whole.encode(t).ids for t in texts]


def test_batches_are_cut_into_slices_by_bytes(monkeypatch):
    texts = ["", "a b", "x. " * 90, " ", "<|endoftext|> a", "é", ""] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(21)), pa.array(texts)], ["_id", "_text"])
    for size in (1, 5, 300, 1 << 22):
        monkeypatch.setattr(packing, "SLICE", size)
        slices = [s.column(1).to_pylist() for s in packing._slices(batch)]
        assert [t for s in slices for t in s] == texts and all(len(s) == 1 or sum(len(t.encode()) for t in s) <= size for s in slices)
    assert len(slices) == 1 and list(packing._slices(batch.slice(0, 0))) == []


def test_packing_keeps_ids_of_any_type(spark):
    texts = [None, "", "a b", "x. " * 90, " ", "<|endoftext|> a"]
    docs = spark.createDataFrame([(f"d{i}" if i else None, t) for i, t in enumerate(texts)], "doc_id string, text string")
    rows = pack(docs, BYTES, capacity=64).collect()
    whole = Tokenizer.from_file(BYTES)
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == {f"d{i}" if i else None: len(whole.encode(t or "").ids) + 1 for i, t in enumerate(texts)}


def test_token_counts_of_a_text_without_white_space(spark):
    row = token_counts(spark.createDataFrame([(1, "ab" * 5000)], "doc_id long, text string"), WORDS, limit=50).first()
    words = Tokenizer.from_file(WORDS)
    assert row.n_tokens == len(words.encode("ab" * 5000, add_special_tokens=False).ids)
    assert len(words.encode(("ab" * 5000)[: row.fit_chars], add_special_tokens=False).ids) <= 50 and row.fit_chars > 0


def test_long_runs_are_cut_at_the_longest_prefix():
    rnd = random.Random(14)
    words, counter = Tokenizer.from_file(WORDS), PrefixCounter(WORDS)
    syllables = ["in", "the", "an", "tion", "qu", "ist", "z", "ver", "É", "ß", "中", "er"]
    runs = ["".join(rnd.choice(syllables) for _ in range(150)) for _ in range(2)]
    runs += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)), "".join(rnd.choice(["don't", "a1", "..", "İ", "it's", "w'reb", "\u00a0"]) for _ in range(120))]
    runs += ["x" * 300, "e\u0301" * 140, "<|endoftext|>ab" * 20]
    for t in runs:
        assert len(t) > 256
        each = [len(words.encode(t[:p], add_special_tokens=False).ids) for p in range(len(t) + 1)]
        sums = counter.counts([t.encode()])[0]
        for budget in range(0, each[-1], 3):
            assert counter.longest_prefix(t, sums, budget) == max(p for p, n in enumerate(each) if n <= budget), (t, budget)


ALPHABETS = [
    ["a", "b", "\u0301"], ["\u0301", "\u0327", "a"], ["a", "\u0301", "\u0327", "\u0323"], ["\u1100", "\u1161", "\u11a8", "x", "\uac01"], ["don't", "'s", "'", "S", "l", "'LL", "r", "e"],
    ["<|endoftext|>", "a", "<|", "é", "<|startoftext|>", "\u0338"], ["İ", "i", "\u0307", "ß", "\u00a0", "\u3000"], ["e", "é", "中", "1", ".", "\u0e01\u0e33"], ["Σ", "ς", "Ω", "\u212b", "\u212a", "\u0958", "\u09c7", "\u09be"],
]


@pytest.mark.parametrize("letters", ALPHABETS)
def test_prefix_tables_of_any_run(letters):
    rnd = random.Random(21)
    words, counter = Tokenizer.from_file(WORDS), PrefixCounter(WORDS)
    for n in (0, 1, 2, 3, 5, 8, 13, 40, 40, 90, 290):
        t = "".join(rnd.choice(letters) for _ in range(n))
        each = [len(words.encode(t[:p], add_special_tokens=False).ids) for p in range(len(t) + 1)]
        assert counter.prefix_table(t).tolist() == each, t
        sums = counter.counts([t.encode()])[0]
        for budget in range(0, each[-1], 1 + n // 20):
            assert counter.longest_prefix(t, sums, budget) == max(p for p, k in enumerate(each) if k <= budget), (t, budget)


def test_the_token_query_over_a_whole_table(spark):
    words = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n = len(words.encode(t, add_special_tokens=False).ids)
        assert tuple(got[i])[1:4] == (len(t.encode()), n, n > 2048)
        if n > 2048:
            fits = [len(words.encode(t[:p], add_special_tokens=False).ids) <= 2048 for p in range(got[i].fit_chars, min(len(t), got[i].fit_chars + 40) + 1)]
            assert fits[0] and not any(fits[1:])


def test_id_counts_with_separators():
    assert id_counts(np.array([9, 1, 2, 9, 9, 3]), np.array([0, 3, 4])) == [0, 2, 0, 1]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 1000])
def test_permutation_is_a_bijection(spark, n):
    rows = permute(spark.range(n).withColumnRenamed("id", "p"), "p", n, 3)
    assert sorted(r.p for r in rows.collect()) == list(range(n))
    a, b = rectangle(n)
    assert a * b >= n and longest_walk(spark, n, 3) >= 1


def test_shards(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(203)], "doc_id long, text string")
    rows = shard_rows(docs).collect()
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (25, 26)
    assert all(r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 7)) and r["size"] == r.doc_id % 7 + 1 for r in rows)
    again = {r.doc_id: (r.shard, r.slot) for r in shard_rows(docs.repartition(7)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}
    assert [r.row_number for r in sorted(rows, key=lambda r: r.doc_id)] == list(range(203))


def test_numbers_are_dense(spark):
    df = spark.createDataFrame([(i % 5,) for i in range(100)], "k long")
    assert sorted(r._n for r in numbered(df, ["k"]).collect()) == list(range(100))


def test_url_rules_by_sweep_and_by_ranges(spark):
    rnd = random.Random(2)
    label, seg = ["a", "b", "org", "com", ""], ["", "/", "/x", "/x/y", "/y/"]
    rules = [(rnd.choice(["allow", "block"]), ".".join(rnd.choice(label) for _ in range(rnd.randint(1, 3))), rnd.choice(seg)) for _ in range(60)]
    hosts = [".".join(rnd.choice([*label, "A"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    urls = [f"{rnd.choice(['http', 'x'])}://{h}{rnd.choice(seg)}{rnd.choice(['', '?q=/x', '#f'])}" for h in hosts] + [None, "", "no url", "://", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    best = {}
    for v, h, p in rules:
        best[h, p] = "block" if v == "block" or best.get((h, p)) == "block" else v

    def brute(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), len(h), h, p, v) for (h, p), v in best.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(((f := max(fits))[2] + f[3], f[4]) if fits else (None, "allow")))

    for most in (1000, 5):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules, max_broadcast_rules=most).collect()}
        assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert list(sweep([("ab", 0), ("abc", 1), ("b", 2)], [("a", 0), ("ab", 1)])) == [(0, 1), (1, 1)]


def _fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("width,dense", [(4, 16), (2, 16), (4, 1), (1, 1)])
def test_near_duplicates(spark, width, dense):
    rnd = random.Random(4)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(300)] for _ in range(8)]
    texts = []
    for _ in range(160):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(300)] = f"w{rnd.randint(0, 400)}"
        texts.append(" ".join(words))
    texts += [None, "", "A b", "a B", "one"]
    rows = list(enumerate(texts))
    prints = {i: _fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width, dense=dense).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (prints[i], find(i)) for i in prints}
    assert len({find(i) for i in prints}) < len(texts) - 40


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 202), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 201: 200, 202: 200}


def test_the_fit_is_the_least_of_its_loss():
    """Against the loss written out in plain Python: no step of any weight or threshold lowers it."""
    rnd = np.random.default_rng(5)
    dense = rnd.poisson(0.7, (60, 6)).astype(float)
    grades = np.clip((dense[:, 0] + rnd.normal(0, 0.7, 60)).astype(int), 0, 2)
    rows, cols = np.nonzero(dense)
    penalty = 1e-2
    model = fit_severity(rows, cols, dense[rows, cols], grades, np.arange(6, dtype=np.uint64), penalty=penalty, rounds=3000)
    spread = dense.std(0)

    def loss(w, t):
        out = 0.0
        for x, g in zip(dense, grades):
            for k in (0, 1):
                p = 1 / (1 + np.exp(t[k] - x @ w))
                out -= np.log(p if g > k else 1 - p) / len(dense)
        return out + penalty * float(np.abs(w) @ np.sqrt(spread))  # weights of columns scaled by the root of their deviation

    w, t = np.array([model.weights.get(i, 0.0) for i in range(6)]), np.array(model.thresholds)
    best = loss(w, t)
    assert w[0] > 0.5 and t[0] < t[1]
    for step in (1e-2, -1e-2, 0.2, -0.2):
        for i in range(6):
            assert loss(w + step * (np.arange(6) == i), t) > best - 1e-6
        for k in (0, 1):
            assert loss(w, t + step * (np.arange(2) == k)) > best - 1e-6


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(6)
    docs, marks = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [f"w{rnd.randint(0, 900)}" for _ in range(80)] + [rnd.choice(["zonkish", "zonkers", "blargo"]) for _ in range(3 if toxic else 0)]
        rnd.shuffle(words)
        docs.append((i, " ".join(words)))
        marks.append((i, int(i % 3 > 0), int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    m = spark.createDataFrame([x for x in marks if x[0] < 400], "doc_id long, quality int, toxic int")
    rows = score_toxicity(d, m).where("doc_id >= 400").collect()
    right = sum(r.rejected == (r.doc_id % 4 == 0) for r in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 <= r.p_toxic <= 1 and r.p_toxic <= r.severity <= 2 * r.p_toxic + 1e-9 for r in rows)
    left = without_toxic(d, m)
    assert left.columns == d.columns and left.count() == 600 - score_toxicity(d, m).where("rejected").count()


def test_labels_without_a_document_leave_the_sample_to_others(spark):
    docs = spark.createDataFrame([(i, "zonk word" if i % 2 else "plain word") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(4000)], "doc_id long, quality int, toxic int")
    rows = score_toxicity(docs, labels, max_labels=40).collect()
    assert all(r.rejected == bool(r.doc_id % 2) for r in rows)


def _base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_on_random_texts(spark):
    rnd = random.Random(3)
    parts = [*"ab19 .@_%+-() ", "4539148803436467", "1.2.3.4", "a@b.c", "+1 (132) 555-1352", "é", "\x01", "\n", "4539 1488 0343 6467", "256", "@x.y", "\U0001F600"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(1500)]
    for r in personal_data_digest(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        text = rows[r.doc_id][1]
        want = _base_spans(text)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), text
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in want) for k in ("email", "ip", "card", "phone"))


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please reach mailbox user{i}@mail.example now") for i in range(9)] + [(20, "my mailbox user77(at)mail ok"), (21, "it was 1984 then")]
    got = {r.doc_id: r.spans for r in personal_data_digest(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[20] == "found:11:25" and got[21] == ""


def test_long_tokens_and_words_are_found(spark):
    front = "m" * 70
    rows = [(i, f"please reach {front} user{i}@mail.example now") for i in range(9)]
    rows += [(20, f"my {front} {'k7' * 60} ok"), (21, f"my {front}{' ' * 80}user77(at)mail ok"), (22, f"my x{front} user78(at)mail")]
    got = {r.doc_id: r.spans for r in personal_data_digest(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (got[20], got[21], got[22]) == ("found:74:194", "found:153:167", "")


def test_linear_time_on_hostile_texts(spark):
    texts = ["9" * 50000, "a." * 20000 + "@b" + ".c" * 20000, "1 " * 30000, "+1" + "(" * 50000, "1." * 30000, "x@y.z " * 3000]
    rows = personal_data_digest(find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert {r.doc_id: r.n_email for r in rows}[5] == 3000 and {r.doc_id: r.n_email for r in rows}[1] == 1


def test_pattern_scores(spark):
    edges = spark.createDataFrame([("p", f"s{i}", True) for i in range(8)] + [("p", "new", False), ("q", "new", False), ("q", "s0", True)], "left string, value string, seed boolean")
    patterns, scores = score_graph(edges, 3, 0.8)
    assert [(r.left, r.confidence) for r in patterns.collect()] == [("p", 8 / 9)]  # q has two known instances only
    assert {r.value: r.score for r in scores.collect()} == {"new": pytest.approx(8 / 9), **{f"s{i}": 1.0 for i in range(8)}}


def test_pattern_scores_are_those_of_sets(spark):
    rnd = random.Random(8)
    for least, accept in ((2, 0.6), (1, 0.5), (3, 0.8)):
        pairs = {(f"p{rnd.randrange(12)}", f"v{rnd.randrange(40)}") for _ in range(110)}
        seeds = {f"v{i}" for i in range(18)}
        accepted: set[str] = set()
        while True:
            found = {}
            for p in {p for p, _ in pairs}:
                own = [v for q, v in pairs if q == p]
                known = [v for v in own if v in seeds or any((q, v) in pairs for q in accepted - {p})]
                if len(known) >= least:
                    found[p] = len(known) / len(own)
            now = {p for p, c in found.items() if c >= accept}
            if now == accepted:
                break
            assert now > accepted
            accepted = now
        edges = spark.createDataFrame([(p, v, v in seeds) for p, v in sorted(pairs)], "left string, value string, seed boolean")
        patterns, scores = score_graph(edges, least, accept)
        assert {r.left: r.confidence for r in patterns.collect()} == pytest.approx(found)
        for r in scores.collect():
            fails = [1 - found[p] for p, v in pairs if v == r.value and p in found]
            assert r.score == pytest.approx(1.0 if r.value in seeds else 1 - np.prod(fails), abs=1e-9)


def test_found_identifiers_support_new_patterns(spark):
    rows = [(i, f"mailbox a{i}@b.cc") for i in range(9)] + [(9, "mailbox u7 and"), (10, "mailbox u8")]
    rows += [(20, "account u7"), (21, "account u8"), (22, "account c@d.ee"), (23, "so account q9 is"), (24, "in 1984"), (25, "in 2001")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once, all_rounds = ({r.doc_id: r.spans for r in personal_data_digest(find_personal_data(docs, rounds=n, accept=0.75)).collect()} for n in (1, None))
    assert once[9] == "found:8:10" and once[20] == once[23] == ""  # one seed of four instances
    assert all_rounds[20] == "found:8:10" and all_rounds[23] == "found:11:13" and all_rounds[24] == "" and all_rounds[9] == "found:8:10"


@pytest.mark.parametrize("how", [{}, {"block_bytes": 300}, {"shard_bytes": 200}])
def test_contamination(spark, how):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["ab", "Cd", "e1", "é", "zz"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 4, 10, 14])))) for i in range(12)] + [(50, None), (3, "xx yy")]
    docs = [(i, " ".join(rnd.choice([word(), "other", "-", items[rnd.randrange(12)][1]]) for _ in range(rnd.randint(0, 12)))) for i in range(120)] + [(900, None)]
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    got = contamination_digest(find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), **how)).collect()
    for r in got:
        w, hit, found = words(dict(docs)[r.doc_id]), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= own
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_contamination_in_blocks_is_that_of_one_block(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice(["ab", "cd", "ef", "é1"]) for _ in range(n))
    items = [(str(i % 7), text(rnd.choice([0, 2, 10, 13]))) for i in range(15)] + [(None, "lone words"), (None, None), ("a,b", "cd cd")]
    docs = [(rnd.choice([None, 1, 2, 3]), text(rnd.randint(0, 30)) if i % 9 else None, i) for i in range(60)] + [(4, "nothing here", 60), (4, "see lone words", 61)]
    docs = spark.createDataFrame(docs + docs[:5], "doc_id long, text string, _row int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = lambda df: sorted(map(repr, df.collect()))
    one, several = find_contamination(docs, bench), find_contamination(docs, bench, block_bytes=200)
    assert rows(one) == rows(several) and len(rows(one)) == 67
    kept = rows(without_contaminated(docs, bench))
    assert kept == rows(without_contaminated(docs, bench, block_bytes=200)) and 0 < len(kept) == one.where("size(spans) = 0").count() < 67


def test_suffix_order_and_prefixes():
    rnd = random.Random(7)
    for _ in range(30):
        t = bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(1, 200)))
        data = np.frombuffer(t, np.uint8)
        order, _ = suffix_order(data, 40)
        keys = [t[i : i + 40].ljust(40, b"\0") for i in order]
        assert keys == sorted(keys)
        share = common_prefixes(data, order, 40)
        for a, b in zip(order, order[1:]):
            n = 0
            while n < 40 and max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert share[b] == n


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 3000}, {"hot_segments": 2}])
def test_repeated_passages(spark, how):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcd ") for _ in range(300)) for _ in range(6)]
    texts = []
    for _ in range(150):
        t = ""
        for _ in range(rnd.randint(0, 4)):
            x = rnd.randint(0, 200)
            t += rnd.choice(base)[x : x + rnd.randint(0, 200)] if rnd.random() < 0.6 else "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 120)))
        texts.append(t)
    texts += [None, "a" * 500, "ab" * 100, "x" * 39, texts[3]]
    length, raw = 40, [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    for r in repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length, **how).collect():
        t = raw[r.doc_id]
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        assert tuple(r)[1:] == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_copies_behind_different_bytes_are_found():
    rnd = random.Random(11)
    copy = bytes(rnd.choice(b"abcdefgh") for _ in range(241))
    for first, second in ((b"Q", b"R"), (b"R", b"Q")):
        hits = repeated_windows([b"z" * 9 + first + copy, second + copy], 200)
        assert hits[0].tolist() == [False] * 10 + [True] * 42 + [False] * 199
        assert hits[1].tolist() == [False] + [True] * 42 + [False] * 199


def test_bins():
    left = np.zeros(11, np.int64)
    left[[3, 4, 9]] = [2, 1, 1]
    assert fullest(left, 10) == {4: 1, 3: 2}
    rnd = random.Random(8)
    counts = Counter(rnd.randint(1, 64) for _ in range(3000))
    plan = plan_bins(dict(counts), 64)
    used = Counter()
    for times, inside in plan:
        assert times > 0 and sum(length * k for length, k in inside) <= 64
        for length, k in inside:
            used[length] += times * k
    assert used == counts
    assert sum(t for t, _ in plan) <= 1.01 * sum(n * c for n, c in counts.items()) / 64 + 1


def test_packing_round_trip(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["one", "two", "ten,"]) for _ in range(rnd.choice([0, 3, 30, 300]))) for _ in range(90)] + [None]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES, capacity=64, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = [x for r in own for x in r.ids]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert all(r.length == 64 for r in own[1:]) and all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    for s in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 64


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_exact_dedup(spark, block):
    rnd = random.Random(10)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 7))) for _ in range(200)] + [None, "é", "é" * 40, "é" * 40]
    got = exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_bytes=block).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    for r in got:
        own = groups[texts[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_a_block_of_a_third_of_all_rows_is_split(spark):
    from graphloom.llm import exact_dedup as module

    low = {"advisoryPartitionSizeInBytes": "1k", "skewJoin.skewedPartitionThresholdInBytes": "1k", "skewJoin.skewedPartitionFactor": "1.5", "coalescePartitions.enabled": "false"}
    for k, v in low.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    docs = spark.range(6000, numPartitions=24).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    try:
        blocks = docs.select(F.col("doc_id").alias("_row"), F.col("text").cast("binary").alias("_block"))
        joined = module._handed_back(blocks)
        assert joined.count() == 6000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        out = exact_dedup(docs)
        rows = out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in low:
            spark.conf.unset(f"spark.sql.adaptive.{k}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r.group_size for r in rows) == [1] * 4000 + [2000] * 2000 and sum(r.kept for r in rows) == 4001


def test_blocks_with_one_checksum_go_by_their_bytes(spark):
    from graphloom.llm.exact_dedup import _handed_back

    blocks = spark.createDataFrame([(0, b"a"), (1, b"b"), (2, b"a"), (3, b"")], "_row long, _block binary")
    for check in (None, F.lit(b"same")):
        got = {r._row: r._name for r in _handed_back(blocks, check).select("_row", "_name").collect()}
        assert got[0] == got[2] and len(set(got.values())) == 3 and len(got) == 4


def test_unseen_identifiers_in_known_contexts_are_found(spark):
    rnd = random.Random(30)
    code = lambda: "".join(rnd.choice("ABCDEFGH") for _ in range(3)) + str(rnd.randint(1000, 9999))
    contexts = ["reach me under", "account holder", "signed in as", "Rückruf bei"]
    known = ["{}@mail{}.org", "10.{}.{}.7", "+49 151 {}{}123"]
    rows, planted = [], set()
    for i in range(400):
        words = [rnd.choice(["alpha", "beta", "gamma", "delta", "see"]) for _ in range(rnd.randint(3, 30))]
        words.insert(rnd.randrange(len(words)), f"release {rnd.randint(1, 99)}.{rnd.randint(0, 9)}")  # a number in no such context
        if i % 2 == 0:
            unseen = i % 20 == 0
            value = code() if unseen else rnd.choice(known).format(rnd.randint(10, 99), rnd.randint(10, 99))
            words.insert(rnd.randrange(len(words)), f"{rnd.choice(contexts)} {value}")
            if unseen:
                planted.add((i, value))
        rows.append((i, " ".join(words)))
    found = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, s.value) for r in found for s in r.spans if s.kind == "found"}
    recall, precision = len(got & planted) / len(planted), len(got & planted) / max(1, len(got))
    assert len(planted) == 20 and recall >= 0.9 and precision >= 0.9, (recall, precision)
