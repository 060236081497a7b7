"""Repeated paragraphs: MinHash banding, exact verification, and removal by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.llm.common import checkpointed, partitions, row_key
from telmora.llm.components import Bounds, components, linked_within
from telmora.llm.jaccard import N, PERCENT, _mix, _Words, set_hash, shingles, windows

#: Lines, and blocks of lines between blank ones, of at least so many words are paragraphs.
LEAST_WORDS = 5
#: Words between two cuts of the finer division at least.
PIECE_WORDS = 6
#: Repeated runs of fewer words stay, unless they hold a paragraph.
RUN_WORDS = 16
#: Hashes that the bands may use, and the share of pairs at the threshold that they must find.
HASHES = 84
RECALL = 0.995
FILTER = 1 << 20
#: 64-bit words of the sketch of a set. Each shingle sets one of its bits.
SKETCH = 8
#: Text that is read together, a longer one alone.
BLOCK_BYTES = 2 << 20


def tune(threshold: float, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) with at most ``hashes`` hashes that find a pair at the threshold with probability
    ``recall`` or more: the most rows that allow it, as those give fewest false candidates, then the
    fewest bands."""
    for rows in range(hashes, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return hashes, 1


def _ordered_hashes(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Hashes of the sequences of word hashes between cuts."""
    starts = cuts[:-1]
    place = np.arange(len(h)) - np.repeat(starts, np.diff(cuts)) + 1
    with np.errstate(over="ignore"):
        x = _mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.add.reduceat(x, starts)


def _cuts(h: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Ends of documents, and cuts before words whose hash, with the next word's, is least in its
    neighbourhood; they depend on nearby words only, so equal passages are cut alike wherever they stand.
    ``doc`` numbers the documents of the words; a short one is not cut."""
    ends = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    within = np.flatnonzero(doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        x = _mix(h[within] * np.uint64(3) + h[within + 1])
    of = doc[within]
    low = np.bincount(doc)[of] >= 2 * least + 2
    for d in range(1, least + 1):
        apart = of[d:] != of[:-d]
        low[d:] &= (x[d:] < x[:-d]) | apart
        low[:-d] &= (x[:-d] < x[d:]) | apart
    return np.sort(np.concatenate([[0], within[low] + 1, ends, [len(h)]]))


class _Block:
    """Documents that are read together: places and hashes of their words, and their lines and blocks of lines."""

    def __init__(self, raws: list[bytes], words: _Words):
        whole = b"\n".join(raws)  # so no line goes on in the next document
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        raw = np.frombuffer(whole, np.uint8)
        space = np.concatenate([[True], (raw == 32) | (raw - np.uint8(9) < 5), [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.h = np.fromiter(map(words.__getitem__, whole.split()), np.uint64, len(self.starts))
        self.doc = np.searchsorted(self.begins, self.starts, "right") - 1
        line = np.searchsorted(np.flatnonzero(raw == 10), self.starts)
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        lines = np.stack([first, np.append(first[1:], len(line))], 1)
        go_on = (line[first[1:]] == line[first[:-1]] + 1) & (self.doc[first[1:]] == self.doc[first[:-1]])
        at = np.flatnonzero(np.concatenate([[True], ~go_on]))
        to = np.append(at[1:], len(first))
        blocks = np.stack([first[at], lines[to - 1, 1]], 1)[to - at > 1]  # a single line is there already
        #: Words (from, to) of the units in order, without those that are too short; none overlap in one of the two.
        self.units = [u[u[:, 1] - u[:, 0] >= LEAST_WORDS] for u in (lines, blocks)]

    def sets(self, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For lines and blocks: the units, hashes of shingles one after another, where each unit's begin and end
        there, and the units' sets of shingles, sorted."""
        out = []
        shingle = windows(self.h, n) if len(self.h) >= n else np.empty(0, np.uint64)
        for u in self.units:
            values, spans = shingle, np.stack([u[:, 0], u[:, 1] - n + 1], 1)
            if (few := u[:, 1] - u[:, 0] < n).any():  # all words of such a unit are its one shingle
                at = len(values) + np.arange(few.sum())
                values = np.concatenate([values, *(windows(self.h[a:b], b - a) for a, b in u[few].tolist())])
                spans[few] = np.stack([at, at + 1], 1)
            sets = []
            for a, b in spans.tolist():
                s = np.sort(values[a:b])
                new = s[1:] != s[:-1]
                sets.append(s if new.all() else s[np.concatenate([[True], new])])
            out.append((u, values, spans, sets))
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, _Block]]:
    """Rows and keys of documents, and what they hold."""
    words = _Words()
    for batch in batches:
        rows, keys = (batch.column(x).to_numpy() for x in ("row", "key"))
        at, held, raws = 0, 0, []
        texts = batch.column("text")
        for i in range(len(texts)):
            raws.append((texts[i].as_py() or "").encode("utf-8", "surrogatepass").lower())
            held += len(raws[-1])
            if held > BLOCK_BYTES or i == len(texts) - 1:
                if len(words) > 500_000:
                    words.clear()
                block = _Block(raws, words)
                if len(block.h):
                    yield rows[at : i + 1], keys[at : i + 1], block
                at, held, raws = i + 1, 0, []


_SPOT = pa.schema([(x, pa.int64()) for x in ("c", "row", "key")] + [(x, pa.int32()) for x in ("w0", "w1", "b0", "b1")])
_BITS = [f"s{i}" for i in range(SKETCH)]


def _packed(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def _fixed(rows: np.ndarray) -> pa.Array:
    """A row of numbers as one value."""
    return pa.Array.from_buffers(pa.binary(8 * rows.shape[1]), len(rows), [None, pa.py_buffer(rows.tobytes())])


def _signatures(bands: int, rows: int):
    # Shingle hashes are mixed already, so an odd factor and a shift of the origin permute them well enough.
    numbers = np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)
    factors, origins = _mix(numbers * np.uint64(0xD1B54A32D192ED03)).reshape(2, -1)
    factors = factors | np.uint64(1)

    def signatures(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Band keys, a row for each span (they don't overlap and are in order)."""
        keys = np.zeros((len(spans), bands), np.uint64)
        flat = spans.ravel()
        values = np.append(values, np.uint64(0))  # a last end is a place too
        with np.errstate(over="ignore"):
            for i in range(bands):
                for j in range(rows):
                    least = np.minimum.reduceat(values * factors[i * rows + j] + origins[i * rows + j], flat)[::2]
                    keys[:, i] += least * factors[j]
                keys[:, i] = _mix(keys[:, i] + np.uint64(i))
        return keys

    return signatures


def _sketches(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Bits that the shingles of each span set (spans don't overlap and are in order)."""
    place = np.append(values, np.uint64(0)) % np.uint64(64 * SKETCH)
    bit = np.uint64(1) << (place & np.uint64(63))
    word, flat = place >> np.uint64(6), spans.ravel()
    return np.stack([np.bitwise_or.reduceat(np.where(word == i, bit, np.uint64(0)), flat)[::2] for i in range(SKETCH)], 1)


def _spots(n: int, bands: int, rows: int):
    """As packed tables of many documents: the lines and blocks of lines ("whole"), the pieces of the finer division
    ("fine"), and the classes of the lines and blocks with size, sketch and band keys ("class", once in each task).
    Offsets are words and bytes."""
    signatures = _signatures(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for ids, keys, block in _blocks(batches):
            def spots(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
                doc = block.doc[a]
                word, byte = np.searchsorted(block.doc, doc), block.begins[doc]  # the document's first
                offsets = (a - word, b - word, block.starts[a] - byte, block.ends[b - 1] - byte)
                return _packed(pa.RecordBatch.from_arrays([pa.array(x) for x in (c.view(np.int64), ids[doc], keys[doc])] + [pa.array(x.astype(np.int32)) for x in offsets], schema=_SPOT))

            cuts = _cuts(block.h, block.doc, PIECE_WORDS)
            out = [("fine", spots(_ordered_hashes(block.h, cuts), cuts[:-1], cuts[1:]))]
            whole = []
            for u, values, spans, sets in block.sets(n):
                c = np.array([set_hash(s) for s in sets], np.int64)
                whole.append((c, u))
                new = np.zeros(len(c), bool)
                for i, x in enumerate(c.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new[i] = True
                if new.any():
                    at = np.flatnonzero(new)
                    at = at[np.argsort(spans[at, 0])]
                    sizes = np.array([len(sets[i]) for i in at.tolist()], np.int32)
                    columns = [pa.array(c[at]), pa.array(sizes), _fixed(_sketches(values, spans[at])), _fixed(signatures(values, spans[at]))]
                    out.append(("class", _packed(pa.RecordBatch.from_arrays(columns, ["c", "n", "sketch", "bands"]))))
            c, u = (np.concatenate(x) for x in zip(*whole))
            out.append(("whole", spots(c, u[:, 0], u[:, 1])))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out]), pa.array([x for _, x in out], pa.binary())], ["kind", "packed"])

    return run


def _tables(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("packed"):
            for table in pa.ipc.open_stream(data.as_buffer()):
                yield table.select(columns)


def _unpacked(found: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Columns of the spots."""
    kinds = ", ".join(f"{x} {'int' if pa.types.is_int32(_SPOT.field(x).type) else 'long'}" for x in columns)
    return found.where(F.col("kind") == kind).select("packed").mapInArrow(lambda batches: _tables(batches, columns), kinds)


def _numbers(rows: pa.Array) -> np.ndarray:
    """The numbers in values of ``_fixed``, a row for each."""
    return np.frombuffer(b"".join(rows.to_pylist()), np.int64).reshape(len(rows), -1)


def _tokens(found: DataFrame) -> DataFrame:
    """(token, c): the band keys of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches, ["c", "bands"]):
            tokens = _numbers(table["bands"])
            yield pa.RecordBatch.from_arrays([pa.array(tokens.ravel()), pa.array(np.repeat(table["c"].to_numpy(), tokens.shape[1]))], ["token", "c"])

    return found.where("kind = 'class'").select("packed").mapInArrow(run, "token long, c long")


def _described(found: DataFrame, wanted: DataFrame, bands: int) -> DataFrame:
    """(c, n, s0, ..., t0, ...): sizes, sketches and band keys of the sets of wanted classes (c)."""
    names = [*_BITS, *(f"t{i}" for i in range(bands))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches, ["c", "n", "sketch", "bands"]):
            numbers = np.ascontiguousarray(np.concatenate([_numbers(table["sketch"]), _numbers(table["bands"])], 1).T)
            yield pa.RecordBatch.from_arrays([table["c"], table["n"], *map(pa.array, numbers)], ["c", "n", *names])

    every = found.where("kind = 'class'").select("packed").mapInArrow(run, ", ".join(["c long", "n int", *(f"{x} long" for x in names)]))
    return _among(every, "c", wanted).dropDuplicates(["c"]).join(wanted, "c", "left_semi")


def _maybe_similar(percent: int, bands: int):
    """What every similar pair of sets fulfils in the group of the first band key that they share: a bit that only
    one of them sets is a shingle at least that the other lacks, which bounds what they share."""

    def maybe(a: str, b: str, token: Column) -> Column:
        def shared(x: str, y: str) -> Column:
            lacking = [F.bit_count(F.col(s + x).bitwiseAND(F.bitwise_not(F.col(s + y)))) for s in _BITS]
            return F.col("n" + x) - sum(lacking[1:], lacking[0])

        first = F.coalesce(*[F.when(F.col(f"t{i}{a}") == F.col(f"t{i}{b}"), F.col(f"t{i}{a}")) for i in range(bands)])
        bound = (100 + percent) * F.least(shared(a, b), shared(b, a)).cast("long") >= percent * (F.col("n" + a) + F.col("n" + b)).cast("long")
        return bound & (first == token)

    return maybe


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of tokens that two classes or more share, once each, with the number of these classes."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    token, c = (pa.concat_tables(tables).column(x).to_numpy() for x in ("token", "c"))
    order = np.lexsort((c, token))
    token, c = token[order], c[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (c[1:] != c[:-1])])
    token, c = token[new], c[new]
    group = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]]))
    m = np.bincount(group)[group]
    t = pa.Table.from_arrays([pa.array(x[m > 1]) for x in (token, c, m)], ["token", "c", "m"])
    yield from t.to_batches(max_chunksize=50_000)


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            words.clear()
            sets: dict[int, np.ndarray] = {}
            a, b = [], []
            for ca, cb, ta, tb in zip(*[batch.column(x).to_pylist() for x in ("a", "b", "text_a", "text_b")]):
                for c, text in ((ca, ta), (cb, tb)):
                    if c not in sets:
                        sets[c] = shingles(text, n, words)
                sa, sb = sets[ca], sets[cb]
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if 100 * both >= percent * (len(sa) + len(sb) - both):
                    a.append(ca)
                    b.append(cb)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _bucket(x: str) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(FILTER)).alias("bucket")


def _among(df: DataFrame, x: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``x`` may be among those of ``wanted``; its buckets (at most FILTER rows) go to every task."""
    few = df.withColumn("bucket", _bucket(x)).join(F.broadcast(wanted.select(_bucket(x)).distinct()), "bucket", "left_semi")
    return few.drop("bucket")


def _texts_of(classes: DataFrame, where: DataFrame, texts: DataFrame) -> DataFrame:
    """(c, text) of classes (c), cut from the document of their first occurrence."""
    wanted = checkpointed(classes)
    places = _among(where, "c", wanted).groupBy("c").agg(F.min(F.struct("row", "key", "b0", "b1")).alias("at"))
    spots = checkpointed(places.join(wanted, "c", "left_semi").select("c", "at.*"))
    cut = F.substring(F.col("text").cast("binary"), F.col("b0") + 1, F.col("b1") - F.col("b0")).cast("string")
    once = _among(texts, "row", spots).dropDuplicates(["row", "key"])
    return checkpointed(once.join(spots, ["row", "key"]).select("c", cut.alias("text")))


def repeated_paragraphs(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per passage to remove: ``doc_id``, ``start`` and ``end`` (bytes of the text, UTF-8),
    ``n_words``, ``keep_doc_id`` (least document that holds it), ``text_key``.

    Paragraphs are lines, and blocks of lines between blank ones, of ``LEAST_WORDS`` words or more,
    compared by the sets of their ``n``-word shingles. As passages are also set inside other lines, the words of a document are divided once
    more into short pieces at places that depend on nearby words only; those are compared as they
    are. Equal sets or pieces are one class. Paragraphs collide if a band of their MinHash agrees; bands
    are tuned for recall at the threshold. Colliding classes are verified by exact Jaccard, and
    components of classes that lie in several documents stay in the first document only. Touching
    removals are joined, and runs of fewer than ``RUN_WORDS`` words that hold no paragraph stay.

    Passages inside longer lines go by whole pieces only: their words before the first and after the
    last piece that both texts hold stay, and a short passage without such a piece is not found.

    Null and empty texts have no paragraphs. Rows with the same doc_id count as one document, so
    repeated rows lose nothing to each other. A null doc_id is the greatest. Other columns are
    ignored; an empty table gives no rows.
    """
    bands, rows = tune(percent / 100)
    none = F.lit(2**63 - 1)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("row"), row_key().alias("key"), "text")
    found = checkpointed(texts.mapInArrow(_spots(n, bands, rows), "kind string, packed binary"))
    tokens = _tokens(found).repartition(partitions(docs.sparkSession), "token")
    shared = checkpointed(tokens.mapInArrow(_shared, "token long, c long, m long"))
    # The text from which copies were made collides with most of them.
    weights = checkpointed(shared.groupBy("c").agg(F.sum("m").alias("weight")))
    entries = checkpointed(shared.drop("m").join(weights, "c"))
    where = _unpacked(found, "whole", ["c", "row", "key", "b0", "b1"])

    def links_of(pairs: DataFrame) -> DataFrame:
        once = checkpointed(pairs.select("a", "b").distinct())
        known = _texts_of(once.select(F.explode(F.array("a", "b")).alias("c")).distinct(), where, texts)
        with_a = once.join(known.select(F.col("c").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(known.select(F.col("c").alias("b"), F.col("text").alias("text_b")), "b")
        return checkpointed(with_b.select("a", "b", "text_a", "text_b").mapInArrow(_verify(n, percent), "a long, b long"))

    anything = lambda a, b: F.lit(True)
    columns = ["n", *_BITS, *(f"t{i}" for i in range(bands))]
    bounds = Bounds(columns, lambda classes: _described(found, classes, bands), _maybe_similar(percent, bands))
    placed = components(linked_within(entries, links_of, [], anything, bounds=bounds)).withColumnRenamed("node", "c")

    def classes(kind: str) -> DataFrame:
        return _unpacked(found, kind, ["c", "row"]).groupBy("c").agg(F.min("row").alias("low"), F.max("row").alias("high"))

    # A class that is in one document and has no links loses nothing.
    rooted = classes("whole").join(placed, "c", "left").where("component is not null or low <> high")
    rooted = checkpointed(rooted.select("c", "low", "high", F.coalesce("component", "c").alias("root")))
    owners = rooted.groupBy("root").agg(F.min("low").alias("keep"), F.max("high").alias("last")).where("keep <> last")
    doomed = {"whole": rooted.join(checkpointed(owners), "root").select("c", "keep"), "fine": classes("fine").where("low <> high").select("c", F.col("low").alias("keep"))}

    def lost_of(kind: str) -> DataFrame:
        gone = checkpointed(doomed[kind])
        spots = _among(_unpacked(found, kind, _SPOT.names), "c", gone)
        return spots.join(gone, "c").where("row <> keep").withColumn("fine", F.lit(kind == "fine"))

    lost = lost_of("whole").unionByName(lost_of("fine"))
    per_doc = lost.groupBy("row", "key").agg(F.array_sort(F.collect_set(F.struct("w0", "w1", "b0", "b1", "keep", (~F.col("fine")).alias("whole")))).alias("all"))
    run = F.explode(_joined(F.col("all")))
    runs = per_doc.select("row", "key", run.alias("r")).where((F.col("r.w1") - F.col("r.w0") >= RUN_WORDS) | F.col("r.whole"))
    back = lambda x: F.nullif(x, none)
    return runs.select(
        back(F.col("row")).alias("doc_id"), F.col("r.b0").alias("start"), F.col("r.b1").alias("end"),
        (F.col("r.w1") - F.col("r.w0")).alias("n_words"), back(F.col("r.keep")).alias("keep_doc_id"), F.col("key").alias("text_key"),
    )


def _joined(spans: Column) -> Column:
    """Runs of sorted spans that overlap or touch in words, with the least document that holds a part."""
    kind = "array<struct<w0:int,w1:int,b0:int,b1:int,keep:long,whole:boolean>>"

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(
            last["w0"].alias("w0"), F.greatest(last["w1"], x["w1"]).alias("w1"), last["b0"].alias("b0"),
            F.greatest(last["b1"], x["b1"]).alias("b1"), F.least(last["keep"], x["keep"]).alias("keep"),
            (last["whole"] | x["whole"]).alias("whole"),
        )
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (x["w0"] <= last["w1"]), grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast(kind), step)


def remove_repeated(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the passages that ``repeated_paragraphs`` finds."""
    lost = repeated_paragraphs(docs, n, percent).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    spans = lost.agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (row_key() == F.col("__key"))
    raw = F.col("text").cast("binary")
    start = F.struct(F.lit(b"").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.substring(raw, s["at"] + 1, x["start"] - s["at"])).alias("out"), x["end"].alias("at"))
    done = F.aggregate("__spans", start, step)
    rest = F.concat(done["out"], F.substring(raw, done["at"] + 1, F.octet_length("text"))).cast("string")
    joined = docs.join(spans, same, "left").withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(rest))
    return joined.select(*docs.columns)
