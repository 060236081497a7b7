"""Line de-duplication: documents probe a sharded minimal perfect hash instead of joining lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telmora.llm.common import checkpointed, partitions

MIN_CHARS = 10
#: A line that makes up more than this share of all distinct (line, document) pairs is answered on the
#: map side. There are at most 1 / HOT_SHARE such lines, so the list that goes to all tasks is bounded.
HOT_SHARE = 1e-4
#: Lines in no more documents than this are never hot.
HOT_COUNT = 64
#: Distinct lines that a task gathers before it passes them on.
FLUSH = 1_000_000

_SPACE = " \t\n\x0b\x0c\r"
_NO_ID = np.iinfo(np.int64).max
_LINE = np.dtype([("h", "<u8"), ("f", "<u4"), ("lo", "<i8"), ("hi", "<i8"), ("n", "<u4")])
_PROBE = np.dtype([("h", "<u8"), ("f", "<u4"), ("doc", "<i8")])
_HOT = np.dtype([("h", "<u8"), ("f", "<u4"), ("lo", "<i8")])


def line_key(line: str, min_chars: int) -> tuple[int, int] | None:
    """64 and 32 bits of hash of a line's key; None for short keys."""
    key = line.strip(_SPACE)
    if len(key) < min_chars:
        return None
    x = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())
    return x & 0xFFFFFFFFFFFFFFFF, (x >> 64) & 0xFFFFFFFF


def _mixed(h: np.ndarray, f: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of (h, f) for each seed."""
    with np.errstate(over="ignore"):
        x = h ^ (f.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed * 0xD1B54A32D192ED03 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash as a cascade of bit arrays: a key is settled on the first level where
    no other key falls into its place, and its number is the count of set bits before that place."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        sizes = [int(x.sum()) for x in levels]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = [np.cumsum(x, dtype=np.int64) - 1 for x in levels]

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray) -> PerfectHash:
        levels = []
        while len(h):
            at = _mixed(h, f, len(levels)) % np.uint64(2 * len(h) + 1)
            alone = np.bincount(at.astype(np.int64), minlength=2 * len(h) + 1) == 1
            settled = alone[at.astype(np.int64)]
            levels.append(alone)
            h, f = h[~settled], f[~settled]
        return cls(levels)

    def find(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Numbers of keys; one that was not built in gets some number or -1."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for i, level in enumerate(self.levels):
            at = (_mixed(h[left], f[left], i) % np.uint64(len(level))).astype(np.int64)
            here = level[at]
            out[left[here]] = self.starts[i] + self.ranks[i][at[here]]
            left = left[~here]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *[len(x) for x in self.levels]], "<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<i8", n, 8), 8 * (n + 1), []
        for m in sizes.tolist():
            packed = np.frombuffer(data, np.uint8, (m + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=m).astype(bool))
            at += (m + 7) // 8
        return cls(levels)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """One entry for each line: least and greatest document, summed counts."""
    x = np.concatenate(parts) if parts else np.empty(0, _LINE)
    if not len(x):
        return x
    x = x[np.lexsort((x["f"], x["h"]))]
    first = np.flatnonzero(np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["f"][1:] != x["f"][:-1])]))
    out = x[first].copy()
    out["lo"] = np.minimum.reduceat(x["lo"], first)
    out["hi"] = np.maximum.reduceat(x["hi"], first)
    out["n"] = np.minimum(np.add.reduceat(x["n"].astype(np.int64), first), 2**32 - 1)
    return out


def _by_shard(x: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    shard = (x["h"] % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    x, shard = x[order], shard[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for part, s in zip(np.split(x, cuts), shard[np.concatenate([[0], cuts])] if len(x) else []):
        yield int(s), part.tobytes()


def _rows(pairs: list[tuple[int, bytes]], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.int32()), pa.array([kind] * len(pairs), pa.int32()), pa.array([p[1] for p in pairs], pa.binary())],
        ["shard", "kind", "data"],
    )


_PACKED = "shard int, kind int, data binary"


def _entries(batch: pa.RecordBatch, min_chars: int) -> np.ndarray:
    """Distinct (line, document) pairs of a batch."""
    out = []
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        keys = {k for line in (text or "").split("\n") if (k := line_key(line, min_chars))}
        out += [(h, f, _NO_ID if doc is None else doc) for h, f in keys]
    return np.array(out, _PROBE)


def _count_lines(min_chars: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            x = _entries(batch, min_chars)
            line = np.empty(len(x), _LINE)
            line["h"], line["f"], line["lo"], line["hi"], line["n"] = x["h"], x["f"], x["doc"], x["doc"], 1
            held = [_merged([*held, line])]
            if len(held[0]) > FLUSH:
                yield _rows(list(_by_shard(held[0], shards)), 0)
                held = []
        if held and len(held[0]):
            yield _rows(list(_by_shard(held[0], shards)), 0)

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arrays of the shards of this partition: perfect hash, fingerprints, documents, counts."""
    parts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist()):
            parts.setdefault(shard, []).append(np.frombuffer(data, _LINE))
    for shard, lists in parts.items():
        x = _merged(lists)
        found = PerfectHash.build(x["h"], x["f"])
        table = np.empty(len(x), _LINE)
        table[found.find(x["h"], x["f"])] = x
        perfect = found.to_bytes()
        counts = np.where(table["lo"] == table["hi"], 1, np.maximum(table["n"], 2)).astype("<u4")
        head = np.array([len(x), len(perfect)], "<i8").tobytes()
        arrays = [head, perfect, table["f"].tobytes(), counts.tobytes(), table["lo"].tobytes(), table["h"].tobytes()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([int(x["n"].sum())], pa.int64()), pa.array([b"".join(arrays)], pa.binary())],
            ["shard", "total", "data"],
        )


class _Arrays:
    def __init__(self, data: bytes):
        n, size = np.frombuffer(data, "<i8", 2).tolist()
        self.hash = PerfectHash.from_bytes(data[16 : 16 + size])
        self.prints = np.frombuffer(data, "<u4", n, 16 + size)
        self.counts = np.frombuffer(data, "<u4", n, 16 + size + 4 * n)
        self.keepers = np.frombuffer(data, "<i8", n, 16 + size + 8 * n)
        self.hashes = np.frombuffer(data, "<u8", n, 16 + size + 16 * n)


def _hot_lines(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                a = _Arrays(data)
                at = np.flatnonzero(a.counts > limit)
                hot = np.empty(len(at), _HOT)
                hot["h"], hot["f"], hot["lo"] = a.hashes[at], a.prints[at], a.keepers[at]
                yield pa.RecordBatch.from_arrays([pa.array([hot.tobytes()], pa.binary())], ["data"])

    return run


def _probes(min_chars: int, shards: int, hot: dict[tuple[int, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([h for h, _ in hot], np.uint64)
        for batch in batches:
            x = _entries(batch, min_chars)
            maybe = np.flatnonzero(np.isin(x["h"], known))
            cold = np.ones(len(x), bool)
            cold[[i for i in maybe if (int(x["h"][i]), int(x["f"][i])) in hot]] = False
            if cold.any():
                yield _rows(list(_by_shard(x[cold], shards)), 1)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays come first in each shard; then the probes of one batch of documents after another."""
    shard, arrays = None, None
    for batch in batches:
        for s, kind, data in zip(*[batch.column(c).to_pylist() for c in ("shard", "kind", "data")]):
            if kind == 0:
                shard, arrays = s, _Arrays(data)
                continue
            x = np.frombuffer(data, _PROBE)
            assert arrays is not None and shard == s
            at = arrays.hash.find(x["h"], x["f"])
            lost = (at >= 0) & (arrays.prints[at] == x["f"]) & (arrays.counts[at] > 1) & (arrays.keepers[at] != x["doc"])
            gone = x[lost]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gone["doc"], pa.int64()), pa.array(gone["h"].view(np.int64), pa.int64())], ["__id", "__line"]
            )


def _rewrite(min_chars: int, hot: dict[tuple[int, int], int], schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for doc, text, lost in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "__lost")]):
                own = _NO_ID if doc is None else doc
                gone, kept = set(lost or ()), []
                parts = (text or "").split("\n")
                for line in parts:
                    k = line_key(line, min_chars)
                    signed = k and (k[0] - 2**64 if k[0] >= 2**63 else k[0])
                    if k is None or (signed not in gone and hot.get(k, own) == own):
                        kept.append(line)
                texts.append(text if len(kept) == len(parts) else "\n".join(kept))
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            new = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in schema.names], schema.names)

    return run


def deduplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated lines, and ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without ASCII space at its ends, A-Z lower-cased. A key of at least
    ``min_chars`` characters that occurs in two documents or more stays only in the one with the
    least doc_id, with all its lines there.

    Documents send each shard its part of their distinct line hashes, with counts summed in the task
    first. A shard builds a minimal perfect hash over its distinct lines, which numbers compact
    arrays of fingerprints, counts and first documents. The documents' lines, packed by shard, are
    then looked up in the arrays; only lines to drop come back. Very frequent lines (a bounded
    number) are answered where the documents are read, so no shard gets all documents' probes.

    Lines are told apart by 96 bits of hash. A null text is one empty line and stays null. Rows with
    the same doc_id count as one document; null ids are one document after all others. An empty
    table stays empty. Columns ``n_lines`` and ``n_dropped`` are replaced; others are kept.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    shards = partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = texts.mapInArrow(_count_lines(min_chars, shards), _PACKED)
    arrays = counted.repartitionById(shards, F.col("shard")).mapInArrow(_build, "shard int, total long, data binary")
    arrays = checkpointed(arrays)
    total = arrays.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    found = arrays.select("data").mapInArrow(_hot_lines(max(int(total * HOT_SHARE), HOT_COUNT)), "data binary").collect()
    hot = {(int(r["h"]), int(r["f"])): int(r["lo"]) for x in found for r in np.frombuffer(x["data"], _HOT)}

    probes = texts.mapInArrow(_probes(min_chars, shards, hot), _PACKED)
    tables = arrays.select("shard", F.lit(0).alias("kind"), "data")
    met = tables.unionByName(probes).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    lost = met.mapInArrow(_answer, "__id long, __line long").groupBy("__id").agg(F.collect_set("__line").alias("__lost"))
    joined = docs.join(lost, F.coalesce(docs["doc_id"].cast("long"), F.lit(int(_NO_ID))) == lost["__id"], "left").drop("__id")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_rewrite(min_chars, hot, schema), schema)
