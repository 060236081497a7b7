"""Vector code compression: one codebook for each part of the vectors, learnt by ball k-means."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telmora.llm.common import checkpointed, hinted
from telmora.llm.knn import usable

SCALE = 4096
#: Components of one block of vectors, at most; a block holds one vector at least.
BLOCK_COMPONENTS = 1 << 20
#: Copies of the label totals when they are too many to broadcast, so that a common label has many tasks.
SALTS = 32

_WIDTHS = ("<i2", "<i4", "<i8")


@dataclass
class Codebook:
    """Entries of all parts, and what is known of the balls around them.

    ``entries[p, i]`` is an entry; ``reach[p, i]`` an upper bound of the distance of its members;
    ``still[p, i]`` tells that neither the entry nor an entry near enough to take a member has moved.
    """

    entries: np.ndarray
    reach: np.ndarray
    still: np.ndarray
    between: np.ndarray = field(init=False)
    near: list[list[np.ndarray]] = field(init=False)

    def __post_init__(self) -> None:
        x = self.entries
        self.between = ((x[:, :, None, :] - x[:, None, :, :]) ** 2).sum(-1)
        self.near = [[self._neighbours(p, i) for i in range(x.shape[1])] for p in range(x.shape[0])]

    def _neighbours(self, p: int, i: int) -> np.ndarray:
        """Entries whose ball may meet ball ``i``, nearest first: at most twice the reach away."""
        away = self.between[p, i]
        order = np.argsort(away, kind="stable")
        limit = 4 * int(self.reach[p, i]) ** 2
        return np.array([j for j in order.tolist() if j != i and int(away[j]) <= limit], np.int64)


def _root(x: int) -> int:
    """The square root, rounded up."""
    r = math.isqrt(x)
    return r if r * r == x else r + 1


def _limit(dim: int) -> int:
    """Greatest integer component for which the error of a whole vector of ``dim`` components fits in 62 bits."""
    return math.isqrt((1 << 60) // max(dim, 1))


def _quantised(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * scale)
    return np.clip(scaled, -limit, limit).astype(np.int64)


def _padded(column: pa.Array, dim: int, scale: int, limit: int) -> np.ndarray:
    """One row of ``dim`` integers for each vector; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), np.int64)
    flat = _quantised(column.flatten().to_numpy(zero_copy_only=False), scale, limit)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for each row, ties to the lower index."""
    best, index = _squares(x, entries[0]), np.zeros(len(x), np.int64)
    for j in range(1, len(entries)):
        d = _squares(x, entries[j])
        closer = d < best
        best[closer], index[closer] = d[closer], j
    return index, best


def reassigned(x: np.ndarray, code: np.ndarray, book: Codebook, p: int) -> tuple[np.ndarray, np.ndarray]:
    """New entries of the rows of part ``p``, and their squared distances, from the balls they were in.

    A row at distance d of its entry can only be taken by entries at most 2 d from that entry. Rows with no
    such entry are the stable core; the others fall into rings, by how many of the sorted neighbours
    are that near, and are compared with just these.
    """
    entries, between = book.entries[p], book.between[p]
    new, best = code.copy(), _squares(x, entries[code])
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(entries) + 1))
    for i in range(len(entries)):
        members = order[starts[i] : starts[i + 1]]
        near = book.near[p][i]
        if not len(members) or not len(near) or book.still[p, i]:
            continue
        ring = np.searchsorted(between[i][near], 4 * best[members], side="right")
        widest = np.argsort(-ring, kind="stable")
        members, ring = members[widest], ring[widest]
        for t, j in enumerate(near.tolist()):
            here = members[: np.searchsorted(-ring, -t, side="left")]
            if not len(here):
                break
            d = _squares(x[here], entries[j])
            closer = (d < best[here]) | ((d == best[here]) & (j < new[here]))
            taken = here[closer]
            best[taken], new[taken] = d[closer], j
    return new, best


_STATE = T.StructType(
    [
        T.StructField("size", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("codes", T.BinaryType()),
        T.StructField("slot", T.IntegerType()),
        T.StructField("count", T.LongType()),
        T.StructField("reach2", T.LongType()),
        T.StructField("sums", T.ArrayType(T.LongType())),
    ]
)


def _state_schema(rows: T.StructType) -> T.StructType:
    return T.StructType([*_STATE, T.StructField("kept", T.ArrayType(T.StructType(list(rows))))])


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype(_WIDTHS[0] if most < 1 << 15 else _WIDTHS[1] if most < 1 << 31 else _WIDTHS[2])


class _Moves:
    """Change of counts and sums of the entries in one task, and how far their members reach."""

    def __init__(self, parts: int, entries: int, width: int):
        self.count = np.zeros((parts, entries), np.int64)
        self.sums = np.zeros((parts, entries, width), np.int64)
        self.reach2 = np.full((parts, entries), -1, np.int64)

    def add(self, p: int, x: np.ndarray, old: np.ndarray | None, new: np.ndarray, best: np.ndarray) -> None:
        np.maximum.at(self.reach2[p], new, best)
        if old is None:
            np.add.at(self.count[p], new, 1)
            np.add.at(self.sums[p], new, x)
            return
        moved = np.flatnonzero(old != new)
        np.add.at(self.count[p], new[moved], 1)
        np.add.at(self.sums[p], new[moved], x[moved])
        np.subtract.at(self.count[p], old[moved], 1)
        np.subtract.at(self.sums[p], old[moved], x[moved])

    def rows(self) -> list[tuple]:
        used = np.argwhere((self.count != 0) | (self.reach2 >= 0) | self.sums.any(-1))
        n = self.count.shape[1]
        return [(int(p * n + i), int(self.count[p, i]), int(self.reach2[p, i]), self.sums[p, i].tolist()) for p, i in used.tolist()]


def _moves_batch(moves: _Moves, schema: pa.Schema) -> pa.RecordBatch:
    rows = [{"slot": s, "count": c, "reach2": r, "sums": x} for s, c, r, x in moves.rows()]
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _state_batch(x: np.ndarray, codes: np.ndarray, kept: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    small = _narrow(x)
    whole = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
    columns = {
        "size": pa.array([small.dtype.itemsize], pa.int32()),
        "data": pa.array([small.tobytes()], pa.binary()),
        "codes": pa.array([codes.astype(np.uint8 if codes.max(initial=0) < 256 else "<u4").tobytes()], pa.binary()),
        "kept": whole.cast(schema.field("kept").type),
    }
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)


def _first_pass(book: Codebook, names: list[str], dim: int, scale: int, schema: pa.Schema):
    """Blocks of vectors with their nearest entries of the first codebook, and the sums of the entries."""
    parts, entries, width = book.entries.shape
    limit, most = _limit(dim), max(1, BLOCK_COMPONENTS // max(dim, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = _Moves(parts, entries, width)
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                x = _padded(batch.column("__vector"), dim, scale, limit)
                codes = np.zeros((len(x), parts), np.int64)
                for p in range(parts):
                    part = x[:, p * width : (p + 1) * width]
                    codes[:, p], best = nearest(part, book.entries[p])
                    moves.add(p, part, None, codes[:, p], best)
                kept = pa.StructArray.from_arrays([batch.column(n) for n in names], names)
                yield _state_batch(x, codes, kept, schema)
        yield _moves_batch(moves, schema)

    return run


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column("data")[i]
            if not data.is_valid:
                continue
            kept = batch.column("kept")[i].values
            dtype = {2: _WIDTHS[0], 4: _WIDTHS[1], 8: _WIDTHS[2]}[batch.column("size")[i].as_py()]
            x = np.frombuffer(data.as_py(), dtype).reshape(len(kept), dim).astype(np.int64)
            raw = batch.column("codes")[i].as_py()
            codes = np.frombuffer(raw, np.uint8 if len(raw) == len(kept) * parts else "<u4")
            yield x, codes.reshape(len(kept), parts).astype(np.int64), kept


def _next_pass(book: Codebook, dim: int, schema: pa.Schema):
    parts, entries, width = book.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = _Moves(parts, entries, width)
        for x, codes, kept in _blocks(batches, dim, parts):
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                new, best = reassigned(part, codes[:, p], book, p)
                moves.add(p, part, codes[:, p], new, best)
                codes[:, p] = new
            yield _state_batch(x, codes, kept, schema)
        yield _moves_batch(moves, schema)

    return run


def _last_pass(book: Codebook, dim: int):
    parts, _, width = book.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, codes, kept in _blocks(batches, dim, parts):
            error = np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], best = reassigned(x[:, p * width : (p + 1) * width], codes[:, p], book, p)
                error += best
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts, pa.int32()), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([kept, flat, pa.array(error)], ["kept", "codes", "error"])

    return run


def _moved(book: Codebook, count: np.ndarray, sums: list[list[list[int]]], reach2: np.ndarray) -> Codebook:
    """The next codebook: entries at the floored means of their parts, balls grown by the entries' moves."""
    parts, entries, width = book.entries.shape
    new = book.entries.copy()
    for p in range(parts):
        for i in range(entries):
            if count[p, i]:
                new[p, i] = [s // int(count[p, i]) for s in sums[p][i]]
    shift = ((new - book.entries) ** 2).sum(-1)
    reach = np.array([[_root(max(int(reach2[p, i]), 0)) + _root(int(shift[p, i])) for i in range(entries)] for p in range(parts)], np.int64)
    found = Codebook(new, reach, np.zeros((parts, entries), bool))
    for p in range(parts):
        for i in range(entries):
            found.still[p, i] = shift[p, i] == 0 and not shift[p, found.near[p][i]].any()
    return found


def codebook_digest(entries: np.ndarray) -> str:
    """SHA-256 of the integers of all entries in order, joined by commas."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


@dataclass
class Codes:
    """``rows``: the kept columns, ``codes`` (one entry index per part) and ``error``; ``entries``: the codebooks."""

    rows: DataFrame
    entries: np.ndarray


def encode(
    rows: DataFrame, id_col: str, vector_col: str, keep: list[str] | None = None,
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE,
) -> Codes:
    """Codes of all vectors for codebooks learnt from all of them; every step is exact integer arithmetic.

    A component x counts as floor(scale * x). Codebooks start as the vectors of the smallest ids. A pass over
    the blocks of vectors moves parts to nearer entries and sums what moved; the driver only gets one row of
    sums for each part and entry. Vectors are held as blocks in the checkpoint folder, with their codes; a
    pass writes the next version and the one before the last is deleted.

    Rows whose vector is null or holds null, NaN or infinite components are left out. Repeated rows are coded
    each; equal ids start in order of their vectors, null ids come last. With fewer rows than entries the
    codebooks are smaller. Vectors end in zeros up to the longest one, rounded up to whole parts; a component
    beyond 2^30 / sqrt(components) after scaling is held at that limit. An empty table gives no
    rows and empty codebooks. Columns outside ``keep`` don't matter, whatever their names.
    """
    keep = keep or [id_col]
    good = rows.where(usable(F.col(vector_col)))
    wide = good.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(vector_col).alias("__vector"))
    longest = good.agg(F.max(F.size(vector_col))).first()[0] or 0
    width = max(1, -(-longest // parts))
    dim = width * parts
    seeds = good.orderBy(F.col(id_col).asc_nulls_last(), vector_col).select(vector_col).limit(entries).collect()
    names = {f"k{i}": c for i, c in enumerate(keep)}
    kept_type = wide.drop("__vector").schema
    empty = T.StructType([T.StructField("kept", kept_type), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    back = lambda df: df.select(*[F.col(f"kept.{k}").alias(c) for k, c in names.items()], "codes", "error")
    if not seeds:
        return Codes(back(rows.sparkSession.createDataFrame([], empty)), np.zeros((parts, 0, width), np.int64))

    first = np.zeros((len(seeds), dim), np.int64)
    for i, (vector,) in enumerate(seeds):
        first[i, : len(vector)] = _quantised(np.array(vector, np.float64), scale, _limit(dim))
    shape = (parts, len(seeds), width)
    start = np.ascontiguousarray(first.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    book = Codebook(start, np.zeros(shape[:2], np.int64), np.zeros(shape[:2], bool))

    schema = _state_schema(kept_type)
    arrow = _arrow_schema(schema)
    count, sums = np.zeros(shape[:2], np.int64), [[[0] * width for _ in range(shape[1])] for _ in range(parts)]
    state = wide.mapInArrow(_first_pass(book, list(names), dim, scale, arrow), schema)
    older: DataFrame | None = None
    for r in range(rounds):
        state = checkpointed(state)
        reach2 = _gather(state, count, sums)
        if older is not None:
            _forget(older)
        older = state
        book = _moved(book, count, sums, reach2)
        last = r == rounds - 1
        state = state.mapInArrow(_last_pass(book, dim), empty) if last else state.mapInArrow(_next_pass(book, dim, arrow), schema)
    if not rounds:
        state = checkpointed(state).mapInArrow(_last_pass(book, dim), empty)
    return Codes(back(state), book.entries)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _gather(state: DataFrame, count: np.ndarray, sums: list[list[list[int]]]) -> np.ndarray:
    """Add the moves of all tasks to the totals: one row for each part and entry reaches the driver."""
    width, entries = len(sums[0][0]), count.shape[1]
    moves = state.where("slot is not null")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)] if width <= 64 else []
    if total:
        found = moves.groupBy("slot").agg(F.sum("count").alias("n"), F.max("reach2").alias("far"), F.array(*total).alias("s")).collect()
    else:
        each = moves.select("slot", "count", "reach2", F.posexplode("sums").alias("i", "s"))
        by = each.groupBy("slot", "i").agg(F.sum("count").alias("n"), F.max("reach2").alias("far"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        found = by.groupBy("slot").agg(F.first("n").alias("n"), F.max("far").alias("far"), F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s")).collect()
    reach2 = np.zeros(count.shape, np.int64)
    for row in found:
        p, i = divmod(row["slot"], entries)
        count[p, i] += row["n"]
        reach2[p, i] = max(row["far"], 0)
        for at, s in enumerate(row["s"]):
            sums[p][i][at] += int(s if total else s["s"])
    return reach2


def _forget(state: DataFrame) -> None:
    """Delete a checkpoint that nothing reads any more."""
    sc = state.sparkSession.sparkContext
    name = state._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if name.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(name.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def label_errors(coded: DataFrame, label: Column) -> DataFrame:
    """Add ``label_error``: the error summed over rows of the same label, nulls together.

    Sums are aggregated before the shuffle and joined back; many labels are joined over salted keys.
    """
    rows = checkpointed(coded.withColumn("__label", label))
    totals = checkpointed(rows.groupBy("__label").agg(F.sum("error").alias("label_error")).withColumnRenamed("__label", "__of"))
    n = totals.count()
    match = F.col("__label").eqNullSafe(F.col("__of"))
    small = hinted(totals, n)
    if small is totals:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64("codes", "error"), F.lit(SALTS)))
        small = totals.withColumn("__salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        match = match & (F.col("__salt") == F.col("__salted"))
    return rows.join(small, match).drop("__label", "__of", "__salt", "__salted")
