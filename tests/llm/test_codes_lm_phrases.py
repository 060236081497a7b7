"""Vector codes, language-model scores and phrases against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telmora.llm import codes, lm, phrases, queries


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


# --- vector codes -----------------------------------------------------------------------------------


def _plain_kmeans(vectors: dict[int, list[float]], parts=8, entries=16, rounds=6):
    """Full assignments in plain integers."""
    x = {i: [math.floor(4096 * c) for c in v] for i, v in vectors.items()}
    width = len(next(iter(x.values()))) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in x.items()}
    book = [[cut[i][p] for i in sorted(x)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((c - d) ** 2 for c, d in zip(a, b))
    for r in range(rounds + 1):
        code = {i: [min(range(len(book[p])), key=lambda e: (far(v[p], book[p][e]), e)) for p in range(parts)] for i, v in cut.items()}
        if r < rounds:
            for p in range(parts):
                for e in range(len(book[p])):
                    mine = [cut[i][p] for i in x if code[i][p] == e]
                    if mine:
                        book[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    error = {i: sum(far(v[p], book[p][code[i][p]]) for p in range(parts)) for i, v in cut.items()}
    return code, error, hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.05), (3, 1e-4)])
def test_codes_equal_plain_kmeans(spark, tmp_path, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 16))
    vectors = {i: (centres[i % 7] + spread * rng.normal(size=16)).tolist() for i in range(300)}
    vectors |= {400 + i: vectors[3] for i in range(40)}  # repeated vectors, many ties
    rows = [(i, v, i % 3 if i % 5 else None) for i, v in vectors.items()]
    rows += [(900, None, 1), (901, [float("nan")] * 16, 1), (902, [1.0] * 15 + [None], 1), (903, [float("inf")] * 16, None)]
    _write(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in queries.QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()}
    code, error, digest = _plain_kmeans(vectors)
    assert set(got) == set(vectors)
    labels = {i: (i % 3 if i % 5 else None) for i in vectors}
    for i, r in got.items():
        assert r["code"] == "".join(f"{c:02x}" for c in code[i])
        assert r["error"] == error[i] and r["codebooks_sha256"] == digest
        assert r["label_error"] == sum(error[j] for j in vectors if labels[j] == labels[i])


def test_balls_leave_no_nearer_entry():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (2000, 4))
    book = codes.Codebook(rng.integers(-50, 50, (1, 16, 4)), np.zeros((1, 16), np.int64), np.zeros((1, 16), bool))
    code, best = codes.nearest(x, book.entries[0])
    for _ in range(5):
        reach2 = np.full((1, 16), -1, np.int64)
        np.maximum.at(reach2[0], code, best)
        count = np.bincount(code, minlength=16)[None]
        sums = [[x[code == i].sum(0).tolist() for i in range(16)]]
        book = codes._moved(book, count, sums, reach2)
        code, best = codes.reassigned(x, code, book, 0)
        plain = codes.nearest(x, book.entries[0])
        assert (code == plain[0]).all() and (best == plain[1]).all()


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, codes string, error int, __vector int"
    assert codes.encode(spark.createDataFrame([], schema), "vec_id", "embedding").rows.count() == 0
    rows = [(2, [0.5] * 8, "a", 1, 2), (2, [0.5] * 8, "a", 1, 2), (None, [0.25] * 3, None, None, None), (1, [], "x", 0, 0)]
    found = codes.encode(spark.createDataFrame(rows, schema), "vec_id", "embedding")
    assert found.entries.shape == (8, 4, 1)
    got = sorted(((r["vec_id"] or 0, list(r["codes"]), r["error"]) for r in found.rows.collect()), key=str)
    assert [g[2] for g in got] == [0, 0, 0, 0]  # four rows, an entry each
    assert got[2][1] == got[3][1] == [1] * 8 and got[1][1] == [0] * 8  # equal rows share the lower entry
    huge = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 8) for i in range(20)], "vec_id long, embedding array<double>")
    assert {r["error"] for r in codes.encode(huge, "vec_id", "embedding").rows.collect()} == {0}


def test_many_labels_are_joined_over_salted_keys(spark, monkeypatch):
    rows = spark.createDataFrame([([i], i, i % 4 if i % 3 else None) for i in range(60)], "codes array<int>, error long, label int")
    plain = sorted(codes.label_errors(rows, F.col("label")).toPandas().astype(str).values.tolist())
    monkeypatch.setattr("telmora.llm.common.BROADCAST_ROWS", 0)
    assert sorted(codes.label_errors(rows, F.col("label")).toPandas().astype(str).values.tolist()) == plain


# --- language-model scores --------------------------------------------------------------------------


def _plain_ctw(train: list[str], texts: list[str], depth: int) -> list[float]:
    """log10 probabilities by the recursion over whole trees, one for each node of the byte's bits."""

    def steps(text):
        data = bytes(text.encode()) + b"\xff"
        history = b"\xfe" * depth + data
        for i, y in enumerate(data):
            context = history[i : i + depth][::-1]
            for k in range(8):
                yield context, (k, y >> (8 - k)), (y >> (7 - k)) & 1

    counts = Counter()
    for text in train:
        for context, node, bit in steps(text):
            for d in range(depth + 1):
                counts[context[:d], node, bit] += 1
    children: dict = {}
    for context, node, _ in counts:
        if context:
            children.setdefault((context[:-1], node), set()).add(context)
    memo: dict = {}

    def log_weighted(context, node):
        if (context, node) not in memo:
            n0, n1 = counts[context, node, 0], counts[context, node, 1]
            kt = math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)
            if len(context) == depth:
                memo[context, node] = kt, kt, None
            else:
                below = sum(log_weighted(c, node)[0] for c in children.get((context, node), ()))
                whole = np.logaddexp(kt, below) + math.log(0.5)
                memo[context, node] = whole, kt, math.exp(kt + math.log(0.5) - whole)
        return memo[context, node]

    def probability(context, node, bit, d):
        here = context[:d]
        n = [counts[here, node, 0], counts[here, node, 1]]
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        weight = log_weighted(here, node)[2]
        return weight * own + (1 - weight) * probability(context, node, bit, d + 1)

    return [sum(math.log10(probability(c, node, bit, 0)) for c, node, bit in steps(t)) for t in texts]


_TEXTS = ["the cat sat on the mat", "The cat\tsat  again\n\nand again and again", "", "ünïcode wörds 漢字 漢字", "the the the the", "a", "zzz qqq\x0bxyzzy \x1fé", None]


def test_scores_equal_plain_context_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 64)
    monkeypatch.setattr(lm, "SLICE_BYTES", 30)
    random.seed(4)
    texts = _TEXTS + [" ".join(random.choice(["cat", "sat", "mat", "dog", "and"]) for _ in range(random.randint(0, 30))) for _ in range(30)]
    rows = list(enumerate(texts)) + [(3, texts[3])]  # one row twice
    _write(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = queries.QUERIES["op12_lm_scores"](spark, str(tmp_path)).toPandas()
    assert len(got) == len(rows)
    lowered = [(i, "".join(c.lower() if c.isascii() else c for c in t or "")) for i, t in rows]
    crc = lambda i: __import__("zlib").crc32(str(i).encode())
    train = [t for i, t in lowered if crc(i) % 7 != 2]
    assert 0 < len(train) < len(rows)
    split = lambda t: [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    counts = Counter(w for t in train for w in split(t))
    n, v, ends = sum(counts.values()) + len(train), len(counts) + 1, len(train)
    plain = dict(zip([i for i, _ in lowered], _plain_ctw(train, [t for _, t in lowered], lm.DEPTH)))
    of = dict(lowered)
    for r in got.itertuples():
        c = [counts[w] for w in split(of[r.doc_id])] + [ends]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(c), sum(x > 0 for x in c), n)
        assert r.held_out == (crc(r.doc_id) % 7 == 2) and r.n_bytes == len(of[r.doc_id].encode())
        assert r.base_score == pytest.approx(sum(math.log10((x + 1) / (n + v + 1)) for x in c), rel=1e-9)
        assert r.score == pytest.approx(plain[r.doc_id], rel=1e-6)


def test_scores_of_odd_tables(spark):
    schema = "doc_id long, text string, score string, k0 int, `odd name` int"
    assert lm.score_texts(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    docs = spark.createDataFrame([(1, "ab", "s", 5, 6), (2, None, "s", 5, 6)], schema)
    none = lm.score_texts(docs, F.lit(False)).orderBy("doc_id").collect()
    assert [r["score"] for r in none] == pytest.approx([24 * math.log10(0.5), 8 * math.log10(0.5)])
    assert [(r["n_known"], r["train_tokens"], r["k0"], r["odd name"]) for r in none] == [(0, 0, 5, 6)] * 2
    assert lm.score_texts(docs, F.lit(None).cast("boolean")).count() == 2


def test_counts_beyond_the_table_of_factorials():
    n = np.array([0, 1, 70_000, 5_000_000, 10**12])
    plain = [math.lgamma(a + 0.5) + math.lgamma(3.5) - math.lgamma(a + 4) - math.log(math.pi) for a in n.tolist()]
    assert lm.log_kt(n, np.full(5, 3)) == pytest.approx(plain, rel=1e-8, abs=0.01)


def test_deeper_contexts_code_held_out_text_shorter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = [lm.score_texts(docs, ~held_out, depth).where(held_out).agg(F.sum("score")).first()[0] for depth in (3, 5)]
    assert found[0] < found[1] < 0


# --- phrases ------------------------------------------------------------------------------------------


def _plain_phrases(rows, min_count, longest, share, top):
    import re

    f: Counter = Counter()
    n: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for (lang, p), a in found.items():
        inside = any(
            l2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a
            for (l2, q), b in found.items()
        )
        if not inside:
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(ranked)


@pytest.mark.parametrize("min_count,longest,bits", [(10, 3, 1 << 28), (10, 3, 1 << 15), (3, 4, 1 << 20), (1, 2, 1 << 20)])
def test_phrases_equal_plain_counts(spark, monkeypatch, min_count, longest, bits):
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 200)
    monkeypatch.setattr(phrases, "BUCKET_ENTRIES", 50)
    random.seed(min_count)
    vocabulary = ["New", "york", "city", "the", "of", "é", "漢字", "a\xa0b"]
    text = lambda: "".join(random.choice(vocabulary) + random.choice([" ", " ", "\t ", ", ", "\n"]) for _ in range(random.randint(0, 40)))
    rows = [(random.choice(["en", "de", None, ""]), text()) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("xx", ".,;"), ("en", "New York City"), ("en", "New York City")] + [("rare", "one two three")] * 9
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, f int, word string").repartition(5)
    got = phrases.collocations(docs, min_count, longest, 50, 12)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == _plain_phrases(rows, min_count, longest, 50, 12)


def test_phrases_of_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 999_999_999_999, 10**13 + 7, 10**12 + 3
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases._exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row["s"] == 10**6 * a * a // (l * r)


def test_word_hashes_agree_with_the_functions_of_spark(spark):
    words = phrases._Words.of("en", ["ab ünï. c".encode()])
    got = spark.createDataFrame([("en", w.decode()) for w in words.names.to_pylist()], "lang string, w string")
    spark_side = [r[0] % 2**64 for r in got.select(phrases.word_hash(F.col("lang"), F.col("w"))).collect()]
    assert spark_side == words.hashes.tolist()
    assert words.piece.tolist() == [0, 0, 1]
    assert isinstance(pd.factorize(words.hashes), tuple)


def test_words_are_sorted_by_both_parts_of_their_hash():
    rnd = np.random.default_rng(1)
    keys = np.zeros(400, lm._WORD)
    keys["h"], keys["g"] = rnd.integers(0, 90, 400), rnd.integers(0, 4, 400)
    counts = rnd.integers(0, 9, 400)
    want = Counter()
    for k, n in zip(keys.tolist(), counts.tolist()):
        want[k] += n
    found, sums = lm._summed([(keys[:150], counts[:150]), (keys[150:], counts[150:])])
    assert dict(zip(found.tolist(), sums.tolist())) == want and found.tolist() == sorted(want)
    alone = np.unique(keys["h"]).astype(lm._WORD)
    assert lm._sorted_words(alone[::-1]).tolist() == list(range(len(alone)))[::-1]
