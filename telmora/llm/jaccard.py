"""Near duplicates by n-gram Jaccard similarity: an adaptive multi-match prefix join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.llm.common import checkpointed, partitions, row_key
from telmora.llm.components import components, linked_within

N = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Slots of the count sketch that orders shingles; its size is fixed, so it may go to every task.
SLOTS = 1 << 22
_SLICE = 1 << 16
#: Slices that one job sends to the driver.
_SLICES_AT_ONCE = 8
#: Longest prefix extension that the cost estimate considers.
MATCHES = 6
#: Cost of verifying a candidate, in posting entries read.
VERIFY_COST = 8.0
#: Shingles that may be in more documents than this are dealt over several tasks.
HOT = 2000
#: Document ids are hashed to so many values; the values that are needed form the filter of the text scan.
FILTER = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, kept for the words of a batch."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` word hashes."""
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return out


def shingles(text: str | None, n: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles (A-Z lower-cased, ASCII white space
    between words); fewer words make one shingle, none an empty set."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    return np.unique(windows(h, min(n, len(h))))


def set_hash(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set and its size."""
    x = xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))
    return x - 2**64 if x >= 2**63 else x


def _texts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Row, hash of its text, hash of its set, and the set."""
    words = _Words()
    for batch in batches:
        if len(words) > 500_000:
            words.clear()
        for row, key, text in zip(*[batch.column(x).to_pylist() for x in ("row", "key", "text")]):
            s = shingles(text, n, words)
            yield row, key, set_hash(s), s


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def _describe(n: int):
    """Size and hash of every document's set; slices of the task's count sketch, each text class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(SLOTS, np.uint32), set()
        rows: list[tuple[int, int, int, int]] = []
        names = ["row", "key", "set_hash", "n", "slice", "counts"]

        def out() -> pa.RecordBatch:
            none = pa.nulls(len(rows))
            found = [pa.array(x, pa.int64()) for x in zip(*rows)]
            return pa.RecordBatch.from_arrays([*found, none.cast(pa.int32()), none.cast(pa.binary())], names)

        for row, key, fp, s in _texts(batches, n):
            rows.append((row, key, fp, len(s)))
            if fp not in seen:
                seen.add(fp)
                np.add.at(sketch, _slots(s), 1)
            if len(rows) == 10_000:
                yield out()
                rows = []
        if rows:
            yield out()
        for i in range(0, SLOTS, _SLICE):
            part = sketch[i : i + _SLICE]
            if part.any():
                none = pa.nulls(1).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i // _SLICE], pa.int32()), pa.array([part.astype("<u4").tobytes()], pa.binary())], names)

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            sums[i] = sums.get(i, np.zeros(_SLICE, np.uint64)) + np.frombuffer(data, "<u4")
    for i, x in sums.items():
        packed = pa.compress(np.minimum(x, 2**32 - 1).astype("<u4").tobytes(), codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed], pa.binary())], ["slice", "counts"])


def _sketch(slices: list[tuple[int, bytes]]) -> np.ndarray:
    """The count sketch from its packed slices."""
    counts = np.zeros(SLOTS, "<u4")
    for i, packed in slices:
        counts[i * _SLICE : (i + 1) * _SLICE] = np.frombuffer(pa.decompress(packed, 4 * _SLICE, codec="zstd"), "<u4")
    return counts


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set similar to it."""
    return -(-n * percent // 100)


def prefix(s: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rarest shingles of a set, their estimated counts, and how many of them a similar set shares.

    Sets that overlap in t elements share at least l of their first n - t + l. Reading the entries
    of a prefix costs the sum S of its counts, and at most S / l documents reach l matches, so the
    l of least S + VERIFY_COST * S / l is taken.
    """
    counts = sketch[_slots(s)].astype(np.int64)
    order = np.lexsort((s, counts))
    short = len(s) - needed(len(s), percent)
    total = np.cumsum(np.maximum(counts[order] - 1, 0))
    matches = np.arange(1, min(MATCHES, len(s) - short) + 1)
    cost = total[short + matches - 1] * (1 + VERIFY_COST / matches)
    best = int(matches[np.argmin(cost)])
    first = order[: short + best]
    return s[first], counts[first], best


def _postings(n: int, percent: int, sketch):
    """(shingle, salt, class, row, size, matches, place, sum of counts) of the prefixes; a class once in
    each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = _sketch(sketch.value), set()
        parts: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*parts)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["token", "salt", "c", "row", "n", "l", "pos", "weight"])

        for row, _, fp, s in _texts(batches, n):
            if not len(s) or fp in seen:
                continue
            seen.add(fp)
            tokens, df, matches = prefix(s, counts, percent)
            salt = np.where(df > HOT, 1 + fp % (df // HOT + 1), 0)  # 0: not hot
            full = lambda x, kind=np.int64, m=len(tokens): np.full(m, x, kind)
            parts.append((tokens.view(np.int64), salt.astype(np.int32), full(fp), full(row), full(len(s), np.int32), full(matches, np.int32), np.arange(len(tokens), dtype=np.int32), full(int(df.sum()))))
            held += len(tokens)
            if held > 200_000:
                yield out()
                parts, held = [], 0
        if parts:
            yield out()

    return run


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of shingles that two classes or more share (or might, in another task), once each."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    t = pa.concat_tables(tables)
    token, salt, c = (t.column(x).to_numpy() for x in ("token", "salt", "c"))
    order = np.lexsort((c, salt, token))
    token, salt, c = token[order], salt[order], c[order]
    new_group = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
    new = new_group | np.concatenate([[True], c[1:] != c[:-1]])
    group = np.cumsum(new_group) - 1
    classes = np.bincount(group[new])
    keep = new & ((classes[group] > 1) | (salt > 0))
    yield from t.take(pa.array(order[keep])).to_batches(max_chunksize=50_000)


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        last, sa = None, np.empty(0, np.uint64)
        for batch in batches:
            if len(words) > 500_000:
                words.clear()
            a, b = [], []
            columns = [batch.column(x).to_pylist() for x in ("a", "b", "text_a", "text_b")]
            for ca, cb, ta, tb in zip(*columns):
                if last != (ca, ta):
                    last, sa = (ca, ta), shingles(ta, n, words)
                sb = shingles(tb, n, words)
                if set_hash(sa) != ca or set_hash(sb) != cb:  # another text under the same doc_id
                    continue
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if 100 * both >= percent * (len(sa) + len(sb) - both):
                    a.append(ca)
                    b.append(cb)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b, row_a, row_b) of classes whose texts really are similar."""
    rows = pairs.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct()
    wanted = rows.select(F.pmod(F.xxhash64("row"), F.lit(FILTER)).alias("bucket")).distinct()  # at most FILTER rows
    few = texts.select("row", "text").withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(FILTER))).join(F.broadcast(wanted), "bucket", "left_semi")
    once = few.join(rows, "row", "left_semi").withColumn("same", F.xxhash64("text")).dropDuplicates(["row", "same"])
    some = checkpointed(once.select("row", "text"))
    with_a = pairs.join(some.select(F.col("row").alias("row_a"), F.col("text").alias("text_a")), "row_a")
    with_b = with_a.join(some.select(F.col("row").alias("row_b"), F.col("text").alias("text_b")), "row_b")
    return checkpointed(with_b.select("a", "b", "text_a", "text_b").mapInArrow(_verify(n, percent), "a long, b long"))


def _reachable(percent: int):
    """Whether a shared shingle can be among the first l that a similar pair shares, l being the fewer
    matches of the two: at most l - 1 come before it and the rest of the smaller remainder after it,
    which must allow the overlap. So a similar pair keeps at least l shared shingles."""

    def condition(a: str, b: str) -> Column:
        n_a, n_b = F.col("n" + a), F.col("n" + b)
        most = F.least("l" + a, "l" + b) - 1 + F.least(n_a - F.col("pos" + a), n_b - F.col("pos" + b))
        return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (most * (100 + percent) >= (n_a + n_b) * percent)

    return condition


def _first_shared(percent: int):
    """Whether a shared shingle can be the first one that a similar pair shares: the whole overlap lies
    in what remains of both from there on."""

    def condition(a: str, b: str) -> Column:
        n_a, n_b = F.col("n" + a), F.col("n" + b)
        most = F.least(n_a - F.col("pos" + a), n_b - F.col("pos" + b))
        return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (most * (100 + percent) >= (n_a + n_b) * percent)

    return condition


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``n_shingles``, ``class_id`` (least
    doc_id with the same set), ``component_id`` (least doc_id reachable by links), ``text_key``.

    Documents with equal sets are one class. A class takes the rarest shingles of its set as prefix,
    longer where the estimated number of candidates is high; two classes of (l1, l2) matches can be
    similar only if their prefixes share min(l1, l2) shingles. Rarity comes from a count sketch of
    fixed size over all documents; it steers speed only, as any common order gives the same result.

    Candidates are found in two rounds (see ``linked_within``), so that groups of copies don't become
    all their pairs: classes with the leader of each shingle they share, then what is still apart.
    Pairs with too few matches in the first round come again in the second, where all are counted. A
    shared shingle's places in both prefixes bound the overlap; in the second round only shingles that can
    be a similar pair's first shared one make pairs, so that near copies below the threshold, which share
    common shingles only, are not compared with each other. Both rounds verify the exact similarity on the texts.

    Texts without words (null, empty) have no shingles and no links. Repeated rows and equal texts
    are one class, also under the same doc_id. A null doc_id counts as the greatest id. An empty
    table stays empty; other columns are ignored.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    texts = docs.select(own.alias("row"), row_key().alias("key"), "text")
    described = checkpointed(texts.mapInArrow(_describe(n), "row long, key long, set_hash long, n long, slice int, counts binary"))
    slices = described.where("slice is not null").select("slice", "counts")
    added = slices.repartitionById(SLOTS // _SLICE // _SLICES_AT_ONCE, F.expr(f"slice div {_SLICES_AT_ONCE}").cast("int")).mapInArrow(_add_slices, "slice int, counts binary")
    # At most SLOTS counts, whatever the input; the driver passes them on as the tasks packed them.
    sketch_everywhere = spark.sparkContext.broadcast([(r["slice"], bytes(r["counts"])) for r in added.toLocalIterator()])

    every = described.where("slice is null").select("row", "key", F.col("set_hash").alias("c"), "n")
    classes = every.groupBy("c").agg(F.min("row").alias("class_id"))
    kind = "token long, salt int, c long, row long, n int, l int, pos int, weight long"
    postings = texts.mapInArrow(_postings(n, percent, sketch_everywhere), kind)
    entries = checkpointed(postings.repartition(partitions(spark), "token", "salt").mapInArrow(_live, kind).drop("salt"))

    def links_of(pairs: DataFrame) -> DataFrame:
        # A class has one n and l; its row depends on the task that an entry came from, and any will do.
        least = [F.min(x + end).alias(x + end) for end in ("_a", "_b") for x in ("row", "n", "l", "pos")]
        shared = pairs.groupBy("a", "b").agg(F.sum("shared").alias("m"), *least)
        most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))  # from the first one they share
        enough = shared.where(F.col("m") >= F.least("l_a", "l_b")).where(most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
        return _links(checkpointed(enough.select("a", "b", "row_a", "row_b")), texts, n, percent)

    links = linked_within(entries, links_of, ["row", "n", "l", "pos"], _reachable(percent), _first_shared(percent))

    linked = components(links).withColumnsRenamed({"node": "c", "component": "root"})
    named = classes.join(linked, "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = checkpointed(named)
    least_id = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    by_class = checkpointed(named.join(checkpointed(least_id), "root").select("c", "class_id", "component_id"))
    final = every.join(by_class, "c")
    no_words = F.col("n") == 0
    back = lambda x: F.nullif(x, F.lit(2**63 - 1))
    return final.select(
        back(F.col("row")).alias("doc_id"), F.col("n").alias("n_shingles"),
        back(F.when(no_words, F.col("row")).otherwise(F.col("class_id"))).alias("class_id"),
        back(F.when(no_words, F.col("row")).otherwise(F.col("component_id"))).alias("component_id"),
        F.col("key").alias("text_key"),
    )


def drop_near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One document of each component: that with the least doc_id, with all its columns.

    Of repeated rows one stays, and of several texts of a component under one doc_id too. Documents
    without words all stay.
    """
    found = near_duplicates(docs, n, percent)
    none = F.lit(2**63 - 1)
    first = found.where("doc_id <=> component_id").select(F.coalesce("doc_id", none).alias("__id"), "component_id", "text_key", "n_shingles")
    group = F.when(F.col("n_shingles") == 0, F.col("text_key"))
    kept = checkpointed(first.groupBy("__id", group.alias("wordless")).agg(F.min("text_key").alias("__key")).select("__id", "__key"))
    marked = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), none), "__key": row_key()})
    return marked.join(kept, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"]).select(*docs.columns)
