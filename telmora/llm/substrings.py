"""Repeated byte strings: a prefix-free parse of the corpus, and suffix order of its phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telmora.llm.common import checkpointed, partitions, row_key
from telmora.llm.jaccard import _mix

LENGTH = 50
#: Bytes of the rolling hash that triggers phrases.
TRIGGER = 20
FILTER = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_LOW48, _LOW40 = np.uint64(2**48 - 1), np.uint64(2**40 - 1)
#: Documents that are parsed together at most.
_TOGETHER = 50_000
_ENTRY = np.dtype([("t", "<u4"), ("u", "u1"), ("c", "<u4"), ("v", "<u2"), ("doc", "<u2")])
_DOCUMENT = np.dtype([("row", "<i8"), ("key", "<i8")])


def parse(data: bytes, length: int = LENGTH, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a text: hash of the trigger, hash of the phrase, and the first and last start in it
    of strings of ``length`` bytes.

    A string's trigger is the least rolling hash of ``trigger`` bytes inside it, so equal strings have
    equal triggers wherever they stand. Neighbouring strings of one trigger form a phrase; phrases
    overlap so far that each string lies in exactly one. No phrase is cut by anything outside it.
    """
    n, w = len(data), trigger
    if n < length:
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        padded = data + b"\0" * 16
        eight = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
        h = _mix(_mix(eight[: n - w + 1] + _BASE) + eight[8 : n - w + 9] * np.uint64(0xD6E8FEB86659FD93))
        tail = eight[16 : n - w + 17] & np.uint64(2 ** (8 * (w - 16)) - 1)
        h = _mix(h + tail * np.uint64(0xA24BAED4963EE407))
        least, size, window = h, 1, length - w + 1
        while size * 2 <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: n - length + 1], least[window - size : window - size + n - length + 1])
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(least) - 1]])
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h) - 1, _BASE)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h) - 1, _INVERSE)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers, dtype=np.uint64)])
        # Sums of a phrase, moved back to its beginning, so that the place in the text does not matter.
        phrase = _mix((sums[last + window] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    return least[first], phrase, first, last


def _entries(t: np.ndarray, c: np.ndarray, doc: np.ndarray) -> np.ndarray:
    out = np.empty(len(t), _ENTRY)
    out["t"], out["u"] = t & np.uint64(2**32 - 1), (t >> np.uint64(32)) & np.uint64(2**8 - 1)
    out["c"], out["v"] = c & np.uint64(2**32 - 1), (c >> np.uint64(32)) & np.uint64(2**16 - 1)
    out["doc"] = doc
    return out


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_SENT = "shard int, docs binary, data binary"
#: 0: the phrase's trigger is in several documents, 1: so, and its strings must be compared, 2: an earlier document holds the phrase.
_STATUS = "row long, key long, c long, status int"


def _dictionary(length: int, shards: int):
    """Distinct phrases of a batch with their first document, by shard of the trigger. Phrases that an
    earlier document of the batch holds are settled here and only passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, _TOGETHER) for b in batches for i in range(0, b.num_rows, _TOGETHER)):
            rows, keys, texts = (batch.column(x).to_pylist() for x in ("row", "key", "text"))
            order = sorted(range(len(rows)), key=lambda i: (rows[i], keys[i]))
            parts = []
            for d, i in enumerate(order):
                t, c, _, _ = parse(_bytes(texts[i]), length)
                pair = np.unique(np.stack([t & _LOW40, c & _LOW48, t >> np.uint64(40)], 1), axis=0) if len(t) else np.empty((0, 3), np.uint64)
                parts.append((pair, np.full(len(pair), d, np.uint32)))
            if not parts:
                continue
            x, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            docs = np.array([(rows[i], keys[i]) for i in order], _DOCUMENT)
            by = np.lexsort((doc, x[:, 1], x[:, 0]))
            x, doc = x[by], doc[by]
            if not len(x):
                continue
            new = np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(1)])
            first = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
            settled = docs["row"][doc] > docs["row"][first]
            # Repeats under the same doc_id stay in: they are not earlier documents.
            shard = (x[:, 2] % np.uint64(shards)).astype(np.int64)
            # Settled ones only pass through, so they go wherever their document's key says.
            shard = np.where(settled, docs["key"][doc] % shards, shard)
            out = []
            for s in np.unique(shard).tolist():
                for passed, mark in ((False, b""), (True, b"-")):
                    these = np.flatnonzero((shard == s) & (settled == passed))
                    own, at = np.unique(doc[these], return_inverse=True)
                    if len(own):
                        out.append((s, mark + docs[own].tobytes(), _entries(x[these, 0], x[these, 1], at).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "docs", "data"])

    return run


def _statuses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Order a shard's phrases by trigger and phrase, and tell which need no look at their bytes."""
    names, kinds = ["row", "key", "c", "status"], (pa.int64(), pa.int64(), pa.int64(), pa.int32())

    def out(docs: np.ndarray, c: np.ndarray, status: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(c), 100_000):
            cut = slice(i, i + 100_000)
            columns = (docs["row"][cut], docs["key"][cut], c[cut].view(np.int64), status[cut])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names)

    parts = []
    for batch in batches:
        for docs, data in zip(batch.column("docs").to_pylist(), batch.column("data").to_pylist()):
            x = np.frombuffer(data, _ENTRY)
            t = x["t"].astype(np.uint64) | (x["u"].astype(np.uint64) << np.uint64(32))
            c = x["c"].astype(np.uint64) | (x["v"].astype(np.uint64) << np.uint64(32))
            if len(docs) % 16:
                yield from out(np.frombuffer(docs, _DOCUMENT, offset=1)[x["doc"]], c, np.full(len(c), 2, np.int32))
            else:
                parts.append((t, c, np.frombuffer(docs, _DOCUMENT)[x["doc"]]))
    if not parts:
        return
    t, c, docs = (np.concatenate(p) for p in zip(*parts))
    del parts
    by = np.lexsort((docs["row"], c, t))
    t, c, docs = t[by], c[by], docs[by]
    new_t = np.concatenate([[True], t[1:] != t[:-1]])
    new_c = new_t | np.concatenate([[True], c[1:] != c[:-1]])
    group = np.cumsum(new_t) - 1
    starts = np.flatnonzero(new_t)
    several = (np.maximum.reduceat(docs["row"], starts) != np.minimum.reduceat(docs["row"], starts))[group]
    phrases = np.add.reduceat(new_c.astype(np.int64), starts)[group]
    first = docs["row"][np.flatnonzero(new_c)[np.cumsum(new_c) - 1]]
    status = np.where(docs["row"] > first, 2, np.where(phrases > 1, 1, 0)).astype(np.int32)
    keep = several & (status > 0)
    yield from out(docs[keep], c[keep], status[keep])


_FOUND = "row long, key long, t long, start int, end int, phrase binary"


def _expand(length: int):
    """Byte ranges of phrases that an earlier document holds (t null), and the phrases to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "key", "t", "start", "end", "phrase"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(x).to_pylist() for x in ("row", "key", "text", "lost", "open")]
            for row, key, text, lost, open_ in zip(*columns):
                data = _bytes(text)
                t, c, first, last = parse(data, length)
                c = (c & _LOW48).view(np.int64)
                gone = np.isin(c, np.array(lost, np.int64))
                for a, b in _merge(first[gone], last[gone] + length):
                    out.append((row, key, None, a, b, None))
                wanted = np.flatnonzero(np.isin(c, np.array(open_, np.int64)) & ~gone)
                for i in wanted.tolist():
                    out.append((row, key, int(t[i].view(np.int64)), int(first[i]), int(last[i]) + length, data[first[i] : last[i] + length]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return run


def _merge(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of sorted ranges that overlap or touch."""
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])
    return list(zip(a[new].tolist(), b[ends].tolist()))


def _suffix_order(length: int):
    """Sort the suffixes of a shard's phrases to the depth of ``length`` bytes; those that agree so far
    stand side by side, and all but the first document's are removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        table = pa.concat_tables(tables)
        del tables
        order = np.argsort(table.column("t").to_numpy(), kind="stable")
        t_all = table.column("t").to_numpy()[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(t_all)) + 1, [len(t_all)]])
        low = 0
        while low < len(bounds) - 1:  # some triggers' phrases at a time
            high = int(np.searchsorted(bounds, bounds[low] + 20_000, "left"))
            high = max(min(high, len(bounds) - 1), low + 1)
            part = table.take(pa.array(order[bounds[low] : bounds[high]]))
            yield from _ordered(part, length)
            low = high

    return run


def _ordered(part: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    phrases = part.column("phrase").to_pylist()
    row, key, start = (part.column(x).to_numpy() for x in ("row", "key", "start"))
    sizes = np.array([len(p) for p in phrases]) - length + 1
    data = b"".join(phrases) + b"\0" * 64
    begins = np.concatenate([[0], np.cumsum(sizes + length - 1)[:-1]])
    owner = np.repeat(np.arange(len(phrases)), sizes)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = begins[owner] + inside
    eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    columns = [eight[at + i].astype(np.uint64) for i in range(0, length - 7, 8)]
    if length % 8:
        columns.append(eight[at + length - 8].astype(np.uint64))
    order = np.lexsort((row[owner], *columns[::-1]))
    differs = np.zeros(len(order), bool)
    differs[0] = True
    for x in columns:
        differs[1:] |= x[order][1:] != x[order][:-1]
    first = row[owner[order]][np.flatnonzero(differs)[np.cumsum(differs) - 1]]
    lost = np.zeros(len(order), bool)
    lost[order] = row[owner[order]] > first
    hit = np.flatnonzero(lost)
    if not len(hit):
        return
    who, a = owner[hit], start[owner[hit]] + inside[hit]
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (a[1:] != a[:-1] + 1)])
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])
    columns_out = (row[who[new]], key[who[new]], a[new], a[ends] + length)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns_out, kinds)], ["row", "key", "start", "end"])


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, key, start, end): byte ranges of strings of ``length`` bytes that also start in a document
    with a smaller doc_id. ``row`` is the doc_id (null: the greatest), ``key`` tells its texts apart.

    Every text is parsed into phrases at triggers of a rolling hash. Equal phrases are one entry of
    the dictionary, with the first document: later documents lose all strings of the phrase, whatever
    the text repeats. Only where several phrases share a trigger can different phrases hold equal
    strings; their suffixes are sorted to ``length`` bytes, and equal neighbours go to the first
    document. Order of phrases and of suffixes inside them is the order of the corpus' suffixes as
    far as it matters here: strings of different triggers differ.

    Phrases are told apart by 88 bits of hash of trigger and phrase, besides the shard; suffixes by
    their bytes.
    """
    spark = docs.sparkSession
    shards = partitions(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("row"), row_key().alias("key"), "text")
    sent = texts.mapInArrow(_dictionary(length, shards), _SENT).repartitionById(shards, F.col("shard"))
    status = sent.mapInArrow(_statuses, _STATUS)
    marks = lambda s: F.collect_set(F.when(F.col("status") == s, F.col("c")))
    of_doc = status.groupBy("row", "key").agg(marks(2).alias("lost"), marks(1).alias("open"))
    joined = texts.join(of_doc, ["row", "key"]).dropDuplicates(["row", "key"])
    found = checkpointed(joined.mapInArrow(_expand(length), _FOUND))
    compared = found.where("t is not null").repartition(shards, "t").mapInArrow(_suffix_order(length), "row long, key long, start int, end int")
    return found.where("t is null").select("row", "key", "start", "end").unionByName(compared)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text) as ``doc_id``, ``kept`` (remaining bytes), ``n_bytes``, ``n_removed``,
    ``spans`` (start, end of the maximal removed runs).

    Each byte covered by a string of ``length`` bytes that also starts in a document with a smaller
    doc_id goes; strings are judged on the input. Null and empty texts have no bytes. Rows with the
    same doc_id are not earlier than each other. An empty table stays empty; other columns are
    ignored.
    """
    ranges = repeated_strings(docs, length)
    spans = checkpointed(ranges.groupBy("row", "key").agg(F.collect_set(F.struct("start", "end")).alias("ranges")))
    bucket = F.pmod(F.xxhash64("row"), F.lit(FILTER))
    touched = spans.select(bucket.alias("bucket")).distinct()  # at most FILTER rows
    row = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    marked = docs.select("doc_id", "text", row.alias("row"), row_key().alias("key")).withColumn("bucket", bucket)
    clean = marked.join(F.broadcast(touched), "bucket", "left_anti")
    rest = marked.join(F.broadcast(touched), "bucket", "left_semi").join(spans, ["row", "key"], "left")
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    same = clean.withColumn("ranges", F.lit(None).cast(kind))
    columns = ["doc_id", "text", "ranges"]
    schema = "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>"
    return same.select(columns).unionByName(rest.select(columns)).mapInArrow(_cut, schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    for batch in batches:
        out = []
        for doc, text, ranges in zip(*[batch.column(x).to_pylist() for x in ("doc_id", "text", "ranges")]):
            data = _bytes(text)
            runs = _merge(*np.array([(r["start"], r["end"]) for r in ranges]).T) if ranges else []
            kept, at = [], 0
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            out.append((doc, b"".join([*kept, data[at:]]), len(data), sum(b - a for a, b in runs), [{"start": a, "end": b} for a, b in runs]))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["doc_id", "kept", "n_bytes", "n_removed", "spans"])
