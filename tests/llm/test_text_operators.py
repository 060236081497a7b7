"""The text operators against brute force on small rows with nulls, ties, repeats and odd texts."""

import hashlib
import json
import os
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telmora.llm import chat, components, decontam, jaccard, knn, lines, packing, paragraphs, queries, sharding, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "Beta", "gamma", "delta,", "é", "Été", "zeta9", "the", "of", "x"]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ing", str(rnd.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    base, passage = prose(rnd, 200), prose(rnd, 60)
    edited = " ".join(w if i not in (40, 90) else w + "q" for i, w in enumerate(base.split()))
    far = " ".join(w if i % 6 else w + "q" for i, w in enumerate(base.split()))
    texts = [base, None, "", base, edited, far, " \n\t ", "one", "One", base.upper(), prose(rnd, 4000)]
    texts += [f"{prose(rnd, 30)} {passage} {prose(rnd, 20)}" for _ in range(4)]
    texts += [f"{prose(rnd, 12)}\n  A common line, to drop.\t\n{prose(rnd, 12)}\nshort\n\nshort" for _ in range(5)]
    out = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return out + [(3, base, "en", "s", 1), (20, "last\r\n" + passage, None, None, None), (None, "no id " + passage, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (7, None)]
    df = spark.createDataFrame([*edges, *edges[:9]], "a long, b long")
    want = roots([e for e in edges if None not in e and e[0] != e[1]], {x for e in edges if None not in e and e[0] != e[1] for x in e})
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == want
    assert components.components(df.where("false")).count() == 0


def test_near_duplicates(docs, rows, none):
    sets = {}
    for i, t, *_ in rows:
        sets[2**63 - 1 if i is None else i] = shingle_set(t)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(links, sets)
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        key = 2**63 - 1 if r["doc_id"] is None else r["doc_id"]
        assert r["n_shingles"] == len(sets[key])
        assert (2**63 - 1 if r["component_id"] is None else r["component_id"]) == want[key]
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(None if k == 2**63 - 1 else k) for k in sets if want[k] == k)
    assert jaccard.near_duplicates(none).count() == 0 and jaccard.drop_near_duplicates(none).count() == 0


def test_many_copies_keep_every_link(spark):
    rnd = random.Random(8)
    base = prose(rnd, 120).split()
    texts = [list(base) for _ in range(60)]
    for i, t in enumerate(texts):
        for j in rnd.sample(range(120), i % 4):
            t[j] += f"q{i}"
    texts = [" ".join(t) for t in texts]
    sets = dict(enumerate(map(shingle_set, texts)))
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == roots(links, sets)


def test_rows_of_a_class_may_differ_by_shingle(spark, monkeypatch):
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    near = [*base[:60], "other", *base[61:]]
    texts = dict(enumerate([" ".join(base), " ".join(near)] * 3 + [prose(rnd, 40) for _ in range(30)]))
    live = jaccard._live

    def shuffled(batches):
        """Each shingle keeps the copy of a class that some other task sent."""
        t = pa.Table.from_batches([*batches]).to_pylist()
        t = [{**r, "row": r["row"] + 2 * (abs(r["token"]) % 3) if r["row"] < 2 else r["row"]} for r in t]
        yield from live(pa.Table.from_pylist(t, KIND).to_batches())

    KIND = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("c", pa.int64()), ("row", pa.int64()), *[(x, pa.int32()) for x in ("n", "l", "pos")], ("weight", pa.int64())])
    monkeypatch.setattr(jaccard, "_live", shuffled)
    monkeypatch.setattr(jaccard, "MATCHES", 6)
    monkeypatch.setattr(jaccard, "VERIFY_COST", 1e9)  # as many matches as possible
    got = jaccard.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string").coalesce(1))
    assert {r["doc_id"]: r["component_id"] for r in got.collect() if r["doc_id"] < 6} == dict.fromkeys(range(6), 0)


def test_pairs_across_components_are_counted_once(spark):
    # 1, 2, 3 and 11, 12, 13 are components; 1 and 11 share tokens of which either may hold the main component.
    held = {t: [1, 2, 3, 11] if t % 2 else [1, 11, 12, 13] for t in range(8)}
    entries = spark.createDataFrame([(t, c, 100 * (c in (3, 13)), c * 10) for t, cs in held.items() for c in cs], "token long, c long, weight long, n int")
    seen = []

    def links_of(pairs):
        rows = pairs.groupBy("a", "b", "n_a", "n_b").count().collect()
        assert all((r["n_a"], r["n_b"]) == (10 * r["a"], 10 * r["b"]) for r in rows)
        seen.append({(r["a"], r["b"]): r["count"] for r in rows})
        same = [(r["a"], r["b"]) for r in rows if (r["a"] < 10) == (r["b"] < 10)]
        return spark.createDataFrame(same, "a long, b long")

    components.linked_within(entries, links_of, ["n"], lambda a, b: F.lit(True)).collect()
    assert all(a < b for found in seen for a, b in found)
    assert seen[1][1, 11] == 8


def test_substrings(docs, rows, none):
    first, want = {}, {}
    data = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in sorted(data):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        want[i] = (bytes(x for x, g in zip(b, gone) if not g), len(b), sum(gone), runs)
    got = substrings.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        key = 2**63 - 1 if r["doc_id"] is None else r["doc_id"]
        assert (bytes(r["kept"]), r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]]) == want[key], r["doc_id"]
    assert substrings.remove_repeats(none).count() == 0


def test_parse_is_content_defined():
    rnd = random.Random(2)
    a, b, mid = (bytes(rnd.choices(b"abc d", k=n)) for n in (300, 170, 400))
    t1, c1, f1, l1 = substrings.parse(a + mid)
    t2, c2, f2, l2 = substrings.parse(b + mid + a)
    strings = lambda data, t, f, l: {(data[i : i + 50], int(x)) for x, lo, hi in zip(t, f, l) for i in range(lo, hi + 1)}  # noqa: E731, E741
    one, two = strings(a + mid, t1, f1, l1), strings(b + mid + a, t2, f2, l2)
    assert len({s for s, _ in one | two}) == len(one | two)  # equal strings, equal triggers
    phrases = lambda data, c, f, l: {int(x): data[lo : hi + 50] for x, lo, hi in zip(c, f, l)}  # noqa: E731, E741
    p, q = phrases(a + mid, c1, f1, l1), phrases(b + mid + a, c2, f2, l2)
    assert all(p[k] == q[k] for k in p.keys() & q.keys()) and len(p.keys() & q.keys()) > 10


def test_lines(docs, rows, none):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = {}
    for i, t, *_ in rows:
        for k in {key(s) for s in (t or "").split("\n")}:
            holders.setdefault(k, set()).add(2**63 - 1 if i is None else i)
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.deduplicate_lines(docs).collect()}
    want = set()
    for i, t, *_ in rows:
        own = 2**63 - 1 if i is None else i
        parts = (t or "").split("\n")
        kept = [s for s in parts if len(key(s)) < 10 or min(holders[key(s)]) == own]
        want.add((i, t if len(kept) == len(parts) else "\n".join(kept), len(parts), len(parts) - len(kept)))
    assert got == want
    clash = lines.deduplicate_lines(docs.withColumn("n_lines", F.lit("x")))
    assert clash.columns == [*docs.columns, "n_lines", "n_dropped"] and clash.count() == len(rows)
    assert lines.deduplicate_lines(none).count() == 0


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    h, f = rnd.integers(0, 2**63, 5000).astype(np.uint64), rnd.integers(0, 2**31, 5000).astype(np.uint32)
    h[:10] = h[0]  # equal first halves are still told apart
    built = lines.PerfectHash.from_bytes(lines.PerfectHash.build(h, f).to_bytes())
    assert sorted(built.find(h, f).tolist()) == list(range(5000))
    assert lines.PerfectHash.build(h[:0], f[:0]).find(h, f).tolist() == [-1] * 5000


ITEMS = "item_id long, text string"


def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def test_decontamination(spark, docs, rows, none):
    base, long = rows[0][1].split(), rows[10][1].split()
    items = [(1, " ".join(base[5:18])), (2, " ".join(long[3:9]) + "!"), (3, None), (4, "..."), (10, "One"), (10, "one"), (None, " ".join(base[50:60])), (5, "not there at all")]
    windows = {}
    for i, t in items:
        w = bench_words(t)
        for s in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).update([] if i is None else [str(i)])
    want = []
    for i, t, *_ in rows:
        w, hit, found = bench_words(t), set(), set()
        for ww, ids in windows.items():
            for s in range(len(w) - len(ww) + 1):
                if tuple(w[s : s + len(ww)]) == ww:
                    hit |= set(range(s, s + len(ww)))
                    found |= ids
        want.append((i, len(w), len(hit), tuple(sorted(found))))
    bench = spark.createDataFrame(items, ITEMS)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontam.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not n for _, _, n, _ in want)
    assert decontam.decontaminate(docs, bench.where("false")).count() == len(rows)
    assert decontam.contamination(none, bench).count() == 0


def test_sharding(spark, none):
    rnd = random.Random(4)
    data = [(i, rnd.choice([5, 5, 5, rnd.randint(1, 900)]), rnd.random() if i % 7 else None, 1.0) for i in range(3000)]
    df = spark.createDataFrame([*data, *[(9, 5, 0.5, 1.0)] * 1000], "id long, size long, x double, shard double")
    got = sharding.kd_shards(df, "size", ["size", "x"], 12).groupBy("shard").agg(
        F.sum("size").alias("w"), F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("d")
    )
    found = got.collect()
    mean = sum(r["w"] for r in found) / 12
    assert sorted(r["shard"] for r in found) == list(range(12)) and all(abs(r["w"] - mean) < 950 for r in found)
    assert all((r["low"], r["high"], r["d"]) == (0, r["n"] - 1, r["n"]) for r in found)
    assert sharding.kd_shards(none.withColumn("w", F.lit(1)), "w", ["n_chars"], 4).count() == 0


def test_knn(spark):
    rnd = random.Random(6)
    data = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    data += [(300 + i, [0.5] * 8) for i in range(120)] + [(7, data[7][1]), (500, None), (501, [float("nan")] * 8), (502, [None] * 8), (550, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(data, "id long, v array<double>").where(knn.usable(F.col("v"))).withColumn("v", knn.quantised(F.col("v")))
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.top_k(df, df.where("id % 50 = 0"), 5).collect()}
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data if i is not None and v and None not in v and all(np.isfinite(v))]
    want = set()
    for i, q in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5])}
    assert got == want
    assert knn.top_k(df, df.where("false"), 5).count() == 0 and knn.top_k(df.where("false"), df.where("id = 0"), 5).count() == 0
    huge = spark.createDataFrame([(0, [2**40, 1]), (1, [2**20, 3])], "id long, v array<long>")
    assert knn.top_k(huge, huge.where("id = 0"), 1).first()["score"] == 2**60 + 3


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    whole = Tokenizer.from_file(files[0])
    pieces = packing.pack(docs, *files, window=256, with_ids=True)
    got = pieces.collect()
    want = sorted(str((i, *whole.encode(t or "", add_special_tokens=False).ids, 1)) for i, t, *_ in rows)
    by_doc = {}
    for r in sorted(got, key=lambda r: r["start"]):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault(r["doc_id"], []).append(r)
    single = {d: p for d, p in by_doc.items() if d != 3}  # 3 is there twice
    read = [str((d, *[x for r in p for x in np.frombuffer(r["ids"], "<u4").tolist()])) for d, p in single.items()]
    assert sorted(read) == [w for w in want if not w.startswith("(3,")]
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 256) + 1
    padded = packing.sequences(pieces, 256).collect()
    assert all(len(r["ids"]) == 4 * (r["n_tokens"] if r["n_tokens"].bit_count() == 1 else 256) for r in padded)
    assert packing.pack(none, *files).count() == 0


def test_bin_slack_against_all_subsets():
    rnd = random.Random(5)
    for _ in range(60):
        counts = {rnd.randint(1, 40): rnd.randint(1, 3) for _ in range(4)}
        room = rnd.randint(1, 90)
        reach = {0}
        for k, n in counts.items():
            reach = {s + k * i for s in reach for i in range(n + 1) if s + k * i <= room}
        used = packing._fullest(np.array(sorted(counts, reverse=True)), np.array([counts[k] for k in sorted(counts, reverse=True)]), room)
        assert sum(k * n for k, n in used.items()) == max(reach) and all(n <= counts[k] for k, n in used.items())


def test_encoder_cuts_where_the_tokenizer_does():
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    whole, encoder = Tokenizer.from_file(files[0]), packing.Encoder(*files)
    rnd = random.Random(7)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "　", "12", "!?", "<|endoftext|>", "\xa0", "\x1c", "漢", "\r\n", "\x85"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_repeated_paragraphs(docs, rows, none):
    found = paragraphs.repeated_paragraphs(docs)
    got = {r["doc_id"]: r["keep_doc_id"] for r in found.collect()}
    assert {3, 4, 12, 13, 14, 20, None} <= set(got) and 0 not in got and 11 not in got and 10 not in got
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    rest = {r["doc_id"]: r["text"] for r in paragraphs.remove_repeated(docs).collect()}
    for r in found.collect():
        assert 0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]]) and len(rest[r["doc_id"]].encode()) < len(texts[r["doc_id"]])
    assert rest[10] == rows[10][1] and rest[1] is None
    assert paragraphs.repeated_paragraphs(none).count() == 0


def test_short_lines_and_wrapped_paragraphs(spark):
    rnd = random.Random(21)
    word = lambda: f"u{rnd.randint(0, 10**9)}"
    long = [word() for _ in range(80)]
    edited = [w + "x" if i == 40 else w for i, w in enumerate(long)]
    wrapped = "\n".join(" ".join(edited[i : i + 8]) for i in range(0, 80, 8))
    short, tiny = " ".join(word() for _ in range(5)), " ".join(word() for _ in range(4))
    own = [" ".join(word() for _ in range(30)) for _ in range(5)]
    texts = [" ".join(long), f"{own[0]}\n\n{wrapped}\n\n{own[1]}", f"{own[2]}\n{short}\n{tiny}", f"{tiny}\n{short}\n{own[3]}", f"{own[4]} {short}"]
    rest = paragraphs.remove_repeated(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    got = {r["doc_id"]: r["text"].split() for r in rest.collect()}
    want = [texts[0], f"{own[0]} {own[1]}", texts[2], f"{tiny} {own[3]}", texts[4]]
    assert got == {i: t.split() for i, t in enumerate(want)}


def test_settled_stars_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "checkpointed", lambda df, inner=components.checkpointed: written.append(1) or inner(df))
    stars = spark.createDataFrame([(1, 5), (7, 1), (2, 9), (5, 1)], "a long, b long")
    assert {tuple(r) for r in components.components(stars).collect()} == {(1, 1), (5, 1), (7, 1), (2, 2), (9, 2)}
    assert len(written) == 1


def test_rounds_have_as_many_tasks_as_their_edges_need(spark, monkeypatch):
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    parts = []

    def spy(df, inner=components.checkpointed):
        out = inner(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components, "checkpointed", spy)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for least, most in ((components.EDGES_A_TASK, components.LEAST_TASKS), (1, 24)):
            monkeypatch.setattr(components, "EDGES_A_TASK", least)
            parts.clear()
            assert {r["node"]: r["component"] for r in components.components(chain).collect()} == dict.fromkeys(range(201), 0)
            assert len(parts) > 4 and max(parts[1:]) == most
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_links_of_the_first_round_come_as_stars(spark):
    # All of 1 to 5 are alike, in ten links; 6 meets only 5, outside the leader's group.
    held = {t: [1, 2, 3, 4, 5] for t in range(5)} | {9: [5, 6]}
    entries = spark.createDataFrame([(t, c, 100 * (c == t + 1)) for t, cs in held.items() for c in cs], "token long, c long, weight long")
    got = components.linked_within(entries, lambda pairs: pairs.select("a", "b").distinct(), [], lambda a, b: F.lit(True))
    found = [(r["a"], r["b"]) for r in got.collect()]
    assert len(found) == 5
    assert roots(found, range(1, 7)) == dict.fromkeys(range(1, 7), 1)


def test_the_driver_passes_on_a_packed_sketch(spark, monkeypatch):
    sent = []

    def spy(sc, value, inner=type(spark.sparkContext).broadcast):
        sent.append((len(pickle.dumps(value)), value))
        return inner(sc, value)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", spy)
    texts = ["a b c d e f", "a b c d e f g", "x y"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_shingles"] for r in jaccard.near_duplicates(docs).collect()} == {0: 2, 1: 3, 2: 1}
    assert 0 < sum(size for size, _ in sent) < 1_000_000
    counts = np.zeros(jaccard.SLOTS, np.int64)
    for t in texts:
        np.add.at(counts, jaccard._slots(jaccard.shingles(t, 5, jaccard._Words())), 1)
    assert (jaccard._sketch(sent[0][1]) == counts).all()


def test_paragraphs_write_blocks_of_spots_and_shared_bands_only(spark, monkeypatch):
    rnd, written = random.Random(31), []

    def spy(df, inner=paragraphs.checkpointed):
        out = inner(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(paragraphs, "checkpointed", spy)
    line = lambda: " ".join(f"v{rnd.randint(0, 10**9)}" for _ in range(12))
    again = line()
    texts = ["\n".join([line() for _ in range(6)] + [again] * (i < 2)) for i in range(40)]
    found = paragraphs.repeated_paragraphs(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["keep_doc_id"], r["n_words"]) for r in found] == [(1, 0, 12)]
    assert sum(written) < 6 * 40


def test_paragraphs_too_far_apart_are_not_paired_across_components(spark, monkeypatch):
    rnd, seen = random.Random(33), []
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(80):
        words = list(base)
        for j in rnd.sample(range(60), d % 13):
            words[j] = f"own{d}x{j}"
        texts[d] = " ".join(words)
    sets = {d: shingle_set(t) for d, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(links, sets)
    in_order = components._in_order
    monkeypatch.setattr(components, "_in_order", lambda pairs, *x: seen.append(pairs.count()) or in_order(pairs, *x))
    found = paragraphs.repeated_paragraphs(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["keep_doc_id"] for r in found if r["end"] - r["start"] == len(texts[r["doc_id"]])} == {d: c for d, c in root.items() if c < d}
    assert seen[1] <= 2 * len(texts)


def test_sketches_never_tell_similar_paragraphs_apart(spark):
    rnd, rows, want = random.Random(34), [], set()
    for i in range(200):
        a = {rnd.getrandbits(63) for _ in range(rnd.choice([1, 5, 40, 400, 3000]))}
        b = {x if rnd.random() > 0.3 * rnd.random() else rnd.getrandbits(63) for x in a}
        if 100 * len(a & b) >= 80 * len(a | b):
            want.add(i)
        row = [i]
        for s in (a, b):
            v = np.array(sorted(s), np.uint64)
            row += [len(s), *paragraphs._sketches(v, np.array([[0, len(v)]])).view(np.int64)[0].tolist(), 7, 8 + len(row)]
        rows.append(row)
    columns = [x + end for end in ("_a", "_b") for x in ("n", *(f"s{i}" for i in range(paragraphs.SKETCH)), "t0", "t1")]
    df = spark.createDataFrame(rows, ", ".join(f"{x} long" for x in ["i", *columns]))
    maybe = paragraphs._maybe_similar(80, 2)
    kept = {r["i"] for r in df.where(maybe("_a", "_b", F.lit(7))).collect()}
    assert want <= kept and 20 < len(want) < 180 and len(kept) < 190
    assert df.where(maybe("_a", "_b", F.lit(9))).count() == 0


def test_blocks_of_documents_have_the_lines_and_pieces_of_each():
    rnd = random.Random(32)
    parts = ["w", "x ", "yy y ", "\n", "\n\n", " \n", "\r", "\x0b", "\x1c", "é ", "z z z z z z z z "]
    raws = ["".join(rnd.choices(parts, k=rnd.randint(0, 40))).encode() for _ in range(300)]
    block = paragraphs._Block(raws, paragraphs._Words())
    want: list[list] = [[], []]
    at = 0
    for raw in raws:
        counts = [len(x.split()) for x in raw.split(b"\n")]
        begin, run = at, 0
        for k in [*counts, 0]:
            if k:
                want[0].append([at, at + k])
                begin, run = (begin, run + 1) if run else (at, 1)
            else:
                if run > 1:
                    want[1].append([begin, at])
                run = 0
            at += k
    assert [u.tolist() for u in block.units] == [[x for x in w if x[1] - x[0] >= paragraphs.LEAST_WORDS] for w in want]
    words = [w for raw in raws for w in raw.split()]
    starts, ends = block.starts - block.begins[block.doc], block.ends - block.begins[block.doc]
    assert [raws[d][a:b] for d, a, b in zip(block.doc, starts, ends)] == words
    cuts = set(paragraphs._cuts(block.h, block.doc, 3).tolist())
    alone, at = {0}, 0
    for raw in raws:
        if raw.split():
            one = paragraphs._Block([raw], paragraphs._Words())
            alone |= {at + x for x in paragraphs._cuts(one.h, one.doc, 3).tolist()}
            at += len(one.h)
    assert cuts == alone and len(cuts) > 300
    for u, _, _, sets in block.sets(7):
        assert [set(s.tolist()) for s in sets] == [set(jaccard.shingles(b" ".join(words[a:b]).decode(), 7, paragraphs._Words()).tolist()) for a, b in u.tolist()]


def test_bands_find_pairs_at_the_threshold():
    bands, k = paragraphs.tune(0.8)
    assert 1 - (1 - 0.8**k) ** bands >= paragraphs.RECALL and bands * k <= paragraphs.HASHES


def brute_marginals(e, trans):
    n = len(e)
    p, z = np.zeros(n), 0.0
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        z += w
        p += w * np.array(y)
    return p / z


def test_marginals_against_all_labellings():
    rnd = np.random.default_rng(3)
    lengths = np.array([3, 0, 6, 1])
    e, trans = rnd.normal(size=10), np.array([[0, -0.7], [-1.1, 0.9]])
    p, _, _ = toxicity.marginals(e, lengths, trans)
    want = np.concatenate([brute_marginals(e[a : a + n], trans) for a, n in zip(np.cumsum(lengths) - lengths, lengths)])
    assert p == pytest.approx(want)


def test_toxicity(spark, docs, none):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = prose(rnd, rnd.randint(10, 60)).split()
        if bad:
            for _ in range(2):
                w.insert(rnd.randint(0, len(w)), rnd.choice(["Vile,", "vileness", "nasty!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.train(*toxicity.sample(df, marks))
    got = toxicity.score_toxicity(df, chain).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r["out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(r["toxicity"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    spans = [r["text"][s["start"] : s["end"]].lower() for r in held for s in r["toxic_spans"]]
    assert spans and np.mean(["vile" in s or "nasty" in s for s in spans]) > 0.9
    odd = toxicity.score_toxicity(docs.withColumn("toxicity", F.lit("x")), chain)
    assert odd.count() == docs.count() and odd.where("toxicity between 0 and 1").count() == docs.count()
    assert toxicity.score_toxicity(none, chain).count() == 0
    empty = toxicity.train(*toxicity.sample(none, marks))
    same = [r["toxicity"] for r in toxicity.score_toxicity(docs, empty).collect()]
    assert same == pytest.approx([toxicity.UNLEARNT] * docs.count())


@pytest.mark.parametrize("labels", [[], [0] * 9, [1] * 9, [None] * 9])
def test_toxicity_without_both_labels_keeps_everything(spark, docs, labels):
    marks = spark.createDataFrame([(i + 1, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    chain = toxicity.train(*toxicity.sample(docs, marks))
    got = toxicity.score_toxicity(docs, chain)
    assert got.where("toxicity < 0.5 and size(toxic_spans) = 0").count() == docs.count()


def test_toxicity_in_chunks_and_pieces(monkeypatch):
    rnd = random.Random(4)
    texts = [prose(rnd, rnd.choice([0, 3, 40])) + (" vile" if i % 3 == 1 else "") for i in range(90)]
    labels = [int(i % 3 == 1) for i in range(90)]
    whole = toxicity.train(texts, labels)
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 50)
    parts = toxicity.train(texts, labels)
    assert parts.document == pytest.approx(whole.document) and parts.weights == pytest.approx(whole.weights)
    assert toxicity._pieces(np.array([0, 1, 500, 501, 1200])).tolist() == [1, 500, 500, 1, 500, 500, 200]


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def test_tool_calls(spark):
    calls = [
        (1, "a", 1, "f", '{"b": 1.0, "a": [true, null]}', None), (1, "b", 3, "f", '{"a": "é"}', ["a", "gone"]), (1, "c", 2, "g", "{", ["b", "b"]),
        (1, "a", 9, "f", "{}", ["c"]), (2, "x", 1, "f", None, ["y"]), (2, "y", 2, None, "1", ["x"]), (2, "z", 3, "f", '{"a": 1, "k": 0}', ["y"]),
        (None, "n", 1, "f", "{}", None), (1, None, 1, "f", "{}", None),
    ]
    results = [(1, "a", 4, "late"), (1, "a", 2, "early"), (1, "b", 5, None), (3, "q", 1, "orphan")]
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["array", "string"]}}, "additionalProperties": False}
    got = chat.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), {"f": schema}).collect()
    by = {(r["conv_id"], r["call_id"]): r for r in got}
    assert {k: r["level"] for k, r in by.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (2, "x"): None, (2, "y"): None, (2, "z"): None}
    assert {k for k, r in by.items() if r["linked"]} == {(1, "a"), (1, "b")}
    assert by[1, "a"]["errors"] == ["$.b: unknown"] and by[1, "b"]["errors"] == [] and by[1, "c"]["errors"] == ["$: not JSON"]
    assert by[2, "x"]["errors"] == ["$: not array|string"] or by[2, "x"]["errors"] == ["$: not object"]
    assert by[2, "y"]["errors"] == ["$: no schema"] and by[2, "z"]["errors"] == ["$.a: not array|string", "$.k: unknown"]
    assert by[1, "a"]["json"] == (
        '{"call":{"function":{"arguments":{"a":[true,null],"b":1},"name":"f"},"id":"a","type":"function"},"result":{"content":"early","tool_call_id":"a"}}'
    )
    assert json.loads(by[1, "b"]["json"])["result"] == {"tool_call_id": "b", "content": None}
    empty = chat.link_tool_calls(spark.createDataFrame([], CALLS), spark.createDataFrame(results, RESULTS), {})
    assert empty.count() == 0


def test_tool_calls_with_odd_arguments(spark):
    deep = lambda n: "[" * n + "]" * n
    arguments = {
        "deep": deep(100_000), "nested": deep(3000), "limit": deep(chat.MAX_DEPTH), "over": deep(chat.MAX_DEPTH + 2), "half": '{"\\ud800": "\\udc00x"}',
        "pair": '"\\ud83d\\ude00"', "digits": "1" * 5000, "true": "true", "nan": "NaN",
    }
    calls = [(1, k, i, "f", v, None) for i, (k, v) in enumerate(arguments.items())]
    no_results = spark.createDataFrame([], RESULTS)
    frame = spark.createDataFrame(calls, CALLS)
    got = {r["call_id"]: r for r in chat.link_tool_calls(frame, no_results, {"f": {"additionalProperties": False}}).collect()}
    errors = {k: r["errors"] for k, r in got.items()}
    assert errors == {
        "deep": ["$: too deep"], "nested": ["$: too deep"], "limit": [], "over": ["$: too deep"], "half": ["$.\\ud800: unknown"], "pair": [],
        "digits": ["$: not JSON"], "true": [], "nan": [],
    }
    read = {k: json.loads(r["json"])["call"]["function"]["arguments"] for k, r in got.items()}
    assert read["half"] == {"\ud800": "\udc00x"} and read["pair"] == "\U0001f600" and read["deep"] == arguments["deep"] and read["nan"] is None
    assert chat.violations(True, {"enum": [1]}) == ["$: not in enum"] and chat.violations(1.0, {"enum": [1]}) == []
    assert chat.violations({"a": 1}, {"properties": {"a": False}}) == ["$.a: not allowed"]
    with pytest.raises(ValueError, match="unknown type 'text'"):
        chat.link_tool_calls(frame, no_results, {"f": {"properties": {"a": {"type": "text"}}}})


def test_levels_of_long_chains_and_of_large_conversations(spark, monkeypatch):
    """A chain of 1,000 calls takes one pass; rounds and one pass give the same levels, cycles included."""
    schema = "conv_id long, call_id string, depends_on array<string>"
    chain = [(1, f"c{i}", [f"c{i - 1}", None, "gone"] if i else []) for i in range(1000)]
    assert {r["call_id"]: r["level"] for r in chat.levels(spark.createDataFrame(chain, schema)).collect()} == {f"c{i}": i for i in range(1000)}
    rnd = random.Random(5)
    rows = [(c, f"{i}", [str(rnd.randrange(0, i + 1 + (rnd.random() < 0.05) * 3)) for _ in range(rnd.randrange(3))]) for c in range(9) for i in range(3 + 2 * c)]
    df = spark.createDataFrame(rows, schema).repartition(5)
    whole = sorted(map(tuple, chat.levels(df).collect()), key=str)
    monkeypatch.setattr(chat, "GROUP_ENTRIES", 20)
    assert sorted(map(tuple, chat.levels(df).collect()), key=str) == whole
    assert len(whole) == len(rows) and any(r[2] is None for r in whole) and any(r[2] for r in whole)


def test_queries_with_sql_agree(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, sf)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns), name
        assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(str(tuple(r)) for r in found.fetchall()), name


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        out[name] = docs.collect()
        assert before.columns == docs.columns or name == "packing"
        docs = spark.createDataFrame(out[name], docs.schema)
    texts = {r["doc_id"]: r["text"] for r in out["line_dedup"]}
    assert set(texts) == {r["doc_id"] for r in out["toxicity"]}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    kept = {r["doc_id"] for r in out["ngram_jaccard_join"]}
    assert kept == set(roots(links, sets).values())
    hit = {r["doc_id"] for r in out["packing"]}
    assert hit == {r["doc_id"] for r in out["benchmark_decontamination"]} and hit <= kept
    digest = hashlib.sha256("".join(sorted(str(r["ids_crc32"]) for r in out["packing"])).encode()).hexdigest()
    ran = corpus_pipeline.run(spark, sf).collect()
    assert digest == hashlib.sha256("".join(sorted(str(r["ids_crc32"]) for r in ran)).encode()).hexdigest()


def test_near_copies_below_the_threshold_are_not_paired_with_each_other(spark, monkeypatch):
    base = [f"w{i}" for i in range(150)]
    texts = {}
    rnd = random.Random(4)
    for d in range(60):  # words of its own each: most pairs are just below the threshold
        words = list(base)
        for j in rnd.sample(range(150), 4):
            words[j] = f"own{d}x{j}"
        texts[d] = " ".join(words)
    texts[100] = texts[7].replace("own7x", "other")
    sets = {d: shingle_set(t) for d, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    seen = []
    in_order = components._in_order
    monkeypatch.setattr(components, "_in_order", lambda pairs, *x: seen.append(pairs.count()) or in_order(pairs, *x))
    got = jaccard.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == roots(links, sets)
    assert seen[1] <= 2 * len(texts)


def test_groups_of_pairs_that_meet_once_are_all_counted(spark):
    # 2 and 12 share four groups; only the first meets the stricter condition.
    rows = [(t, c, 100 * (c in (1, 11)), t) for t in range(4) for c in (1, 2, 11, 12)]
    entries = spark.createDataFrame(rows, "token long, c long, weight long, pos int")
    seen = []

    def links_of(pairs):
        found = pairs.groupBy("a", "b").agg(F.sum("shared").alias("m"), F.count("*").alias("rows")).collect()
        seen.append({(r["a"], r["b"]): (r["m"], r["rows"]) for r in found})
        return spark.createDataFrame([(a, b) for a, b in seen[-1] if (a < 10) == (b < 10)], "a long, b long")

    first = lambda a, b: (F.col("pos" + a) == 0) & (F.col("pos" + b) == 0)
    components.linked_within(entries, links_of, ["pos"], lambda a, b: F.lit(True), first).collect()
    assert seen[1] and set(seen[1].values()) == {(4, 1)}


def test_texts_are_cut_unless_white_space_meets_and_words_encoded_once(monkeypatch):
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]

    def cuttable(text):
        lines = [line.split(" ") for line in text.split("\n")]
        return all(w and not w[0].isspace() and not w[-1].isspace() for words in lines for w in words)

    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a", "é", " ", "\n", rnd.choice(spaces)]) for _ in range(rnd.randint(0, 8))) for _ in range(3000)]
    assert [packing._single_spaced(t) for t in texts] == [cuttable(t) for t in texts]
    encoder, met = packing.Encoder(*queries.tokenizer_files()), []
    encode = encoder._word
    encoder.first.encode = encoder.later.encode = lambda word: met.append(word) or encode(word)
    encoder.encode(["one two two\ntwo one", "two one"])
    assert sorted(met) == [" one", " two", "one", "two"]


def test_toxicity_is_learnt_in_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    want = toxicity.train(*toxicity.sample(docs, marks))
    got = toxicity.learn(docs, marks)
    assert got.weights == want.weights and got.bias == want.bias
    assert np.array_equal(got.trans, want.trans) and np.array_equal(got.document, want.document)
    assert toxicity.learn(docs, marks.where("false")).weights == {}
    here = os.getpid()
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: toxicity.Chain({}, float(os.getpid() != here), want.trans, want.document))
    assert toxicity.learn(docs, marks).bias == 1.0


def test_toxicity_names_only_features_that_may_be_kept(monkeypatch):
    rnd, named = random.Random(41), []
    only = toxicity.FeatureLists.only
    monkeypatch.setattr(toxicity.FeatureLists, "only", lambda self, chosen: named.append(len(self.names)) or only(self, chosen))
    word = lambda toxic: rnd.choice(["vile", "nasty"] if toxic else ["kind", "plain", "quiet"])
    labels = [i % 3 % 2 for i in range(60)]
    texts = [" ".join(word(y) if k % 2 else f"w{rnd.randint(0, 10**9)}" for k in range(40)) for y in labels]
    few = toxicity.train(iter(texts), labels)
    monkeypatch.setattr(toxicity, "SLOTS", 1)  # every feature may be kept
    every = toxicity.train(texts, labels)
    assert few.weights == every.weights and few.bias == every.bias and np.array_equal(few.document, every.document)
    assert named[0] < named[1] / 2
