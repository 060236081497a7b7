"""Language-model scores by context-tree weighting over byte contexts, and by word frequencies."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.llm.common import ascii_lower, checkpointed

#: Bytes of context. A context and its next byte fit in 64 bits.
DEPTH = 5
#: Bytes of text in one block, about; a document is never cut.
BLOCK_BYTES = 32 << 20
#: Bytes of text whose contexts are held at once while a block is worked on.
SLICE_BYTES = 4 << 20
#: Most recent bytes of a context that pick its subtree, and parts into which the next byte deals a subtree.
SPLIT, SPREAD = 2, 8
#: Buckets of the words' hashes.
WORD_BUCKETS = 4096

# Bytes that UTF-8 never has: before the first byte of a text, and after its last one.
_BEFORE, _END = 0xFE, 0xFF
_WORDS = 1 << 30
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_WORD = np.dtype([("h", "<u8"), ("g", "<u4")])
_HALF = np.log(0.5)
_CODEC = "zstd"


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec=_CODEC, asbytes=True)


def _unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec=_CODEC, asbytes=True)


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(n) + 0.5))])


#: log of (1/2)(3/2)...(n - 1/2), and of n!, for small n.
_SMALL = 1 << 16
_HALVES = _log_factorials(_SMALL)
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; for x above 10^4 it is exact to double precision."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""

    def halves(n: np.ndarray) -> np.ndarray:
        big = n >= _SMALL
        out = _HALVES[np.where(big, 0, n)]
        out[big] = _log_gamma(n[big] + 0.5) - 0.5 * np.log(np.pi)
        return out

    total = zeros + ones
    big = total >= _SMALL
    whole = _WHOLES[np.where(big, 0, total)]
    whole[big] = _log_gamma(total[big] + 1.0)
    return halves(zeros) + halves(ones) - whole


def _kt_next(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probability that the next bit is 1."""
    return (ones + 0.5) / (zeros + ones + 1)


def _mixture(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes and the weight of their own estimate, from log KT and the
    children's summed logs."""
    weighted = np.logaddexp(kt, children) + _HALF
    return weighted, np.exp(kt + _HALF - weighted)


def grams(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For every byte, its context and itself as one number: the most recent byte first, the byte itself last.

    ``starts`` are the places where documents begin; what lies before them counts as the byte 0xFE.
    """
    data = np.full(len(text) + len(starts) * depth + 8, _BEFORE, np.uint8)
    gaps = np.zeros(len(text), bool)
    gaps[starts] = True
    at = np.arange(len(text)) + depth * np.cumsum(gaps)
    data[at] = text
    # Eight bytes from ``depth`` before each byte on: read low end first, the most recent byte of the context is the highest.
    windows = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = windows[at - depth]
    out &= np.uint64((1 << (8 * depth)) - 1)
    out <<= np.uint64(8)
    out |= text
    return out


def _cell(g: np.ndarray, depth: int) -> np.ndarray:
    """Number of the subtree part of a gram: the two most recent bytes and three bits of the third."""
    recent = (g >> np.uint64(8 * (depth + 1 - SPLIT))).astype(np.int64)
    third = (g >> np.uint64(8 * (depth - SPLIT))).astype(np.int64) & (SPREAD - 1)
    return recent * SPREAD + third


class Block:
    """Some documents as bytes, one after another, each ended by 0xFF."""

    def __init__(self, texts: list[bytes], train: np.ndarray):
        self.train = train
        self.sizes = np.array([len(t) + 1 for t in texts], np.int64)
        end = bytes([_END])
        self.data = np.frombuffer(end.join([*texts, b""]), np.uint8)
        self.ends = np.cumsum(self.sizes)

    def slices(self) -> Iterator[tuple[int, int]]:
        """Runs of documents of about SLICE_BYTES."""
        first = 0
        while first < len(self.sizes):
            base = self.ends[first] - self.sizes[first]
            last = max(first + 1, int(np.searchsorted(self.ends, base + SLICE_BYTES, side="right")))
            yield first, last
            first = last

    def contexts(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """Per slice: grams, where its documents start in them, and the slice's bounds."""
        for first, last in self.slices():
            base = int(self.ends[first] - self.sizes[first])
            starts = self.ends[first:last] - self.sizes[first:last] - base
            yield grams(self.data[base : self.ends[last - 1]], starts, depth), starts, first, last

    def gram_counts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams, sorted, and how often each occurs in documents to learn from."""
        return _total(self._slice_counts(g, first, last) for g, _, first, last in self.contexts(depth))

    def _slice_counts(self, g: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        codes, distinct = pd.factorize(g)
        learns = np.repeat(self.train[first:last], self.sizes[first:last])
        return np.asarray(distinct, np.uint64), np.bincount(codes[learns], minlength=len(distinct))

    def words(self) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """Hashes of the distinct words, sorted by bucket and hash; per slice the numbers and documents of its words."""
        parts = [self._slice_words(first, last) for first, last in self.slices()]
        every, _ = _total((p[0], np.zeros(len(p[0]), np.int64)) for p in parts)
        order = np.argsort((every["h"] % np.uint64(WORD_BUCKETS)).astype(np.uint16), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        numbered = ((place[_places(every, hashes)][ids], doc) for hashes, ids, doc in parts)
        return every[order], numbered

    def _slice_words(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        base = int(self.ends[first] - self.sizes[first])
        data = self.data[base : self.ends[last - 1]]
        inside = ~(_SPACE[data] | (data == _END))
        edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = flat.dictionary_encode()
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist())), ">u8").reshape(-1, 2)
        hashes = np.empty(len(digests), _WORD)
        hashes["h"], hashes["g"] = digests[:, 1], digests[:, 0] & np.uint64(2**32 - 1)
        doc = first + np.searchsorted(self.ends[first:last] - base, starts, side="right")
        return hashes, coded.indices.to_numpy().astype(np.int32), doc.astype(np.int32)


def _places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where words are among the sorted ``keys``, which hold them all."""
    at = np.searchsorted(np.ascontiguousarray(keys["h"]), np.ascontiguousarray(asked["h"]))
    while (wrong := keys["g"][at] != asked["g"]).any():  # equal 64 bits, other 32
        at[wrong] += 1
    return at


def _sorted_words(keys: np.ndarray) -> np.ndarray:
    """Order of words by both parts of their hash; equal words in any order."""
    order = np.argsort(np.ascontiguousarray(keys["h"]))
    h, g = keys["h"][order], keys["g"][order]
    if ((h[1:] == h[:-1]) & (g[1:] != g[:-1])).any():  # equal 64 bits, other 32
        return np.lexsort((keys["g"], keys["h"]))
    return order


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts added."""
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if not len(keys):
        return keys, counts
    order = _sorted_words(keys) if keys.dtype == _WORD else np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    if keys.dtype == _WORD:
        new[1:] = (keys["h"][1:] != keys["h"][:-1]) | (keys["g"][1:] != keys["g"][:-1])
    else:
        new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first], np.add.reduceat(counts, first)


def _pack_grams(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return _squeezed(np.concatenate([np.diff(keys, prepend=np.uint64(0)), counts.astype(np.uint64)]).tobytes())


def _unpack_grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(_unsqueezed(data), np.uint64)
    n = len(both) // 2
    return np.cumsum(both[:n], dtype=np.uint64), both[n:].astype(np.int64)


def _pack_words(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return _squeezed(keys.tobytes() + counts.astype("<u4").tobytes())


def _unpack_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _unsqueezed(data)
    n = len(raw) // (_WORD.itemsize + 4)
    return np.frombuffer(raw, _WORD, n), np.frombuffer(raw, "<u4", n, n * _WORD.itemsize).astype(np.int64)


_MESSAGE = "block long, cell int, kind int, data binary, n_tokens long"
#: Kinds of rows. A block's text and its documents; what it asks; a subtree part; the top of a subtree.
_TEXT, _ASK, _TABLE, _TOP, _ANSWER = 0, 3, 2, 1, 4


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["block", "cell", "kind", "data", "n_tokens"])


def _pieces(cells: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values."""
    cuts = np.flatnonzero(np.diff(cells, prepend=-1))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(cells)).tolist()):
        yield int(cells[a]), a, b


def _read(batches: Iterator[pa.RecordBatch], depth: int):
    """Blocks of a task: the block's text as one row, and one row for each part of what it asks."""

    def block_rows(number: int, table: pa.Table) -> Iterator[tuple]:
        block = _block(table)
        hashes, slices = block.words()
        n, learnt = np.zeros(len(hashes), np.int64), int(block.train.sum())
        for number_of, doc in slices:
            learns = block.train[doc]
            n += np.bincount(number_of[learns], minlength=len(hashes))
            learnt += int(learns.sum())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
            out.write_table(table)
        yield number, -1, _TEXT, sink.getvalue().to_pybytes(), learnt
        for bucket, a, b in _pieces((hashes["h"] % np.uint64(WORD_BUCKETS)).astype(np.int64)):
            yield number, _WORDS + bucket, _ASK, _pack_words(hashes[a:b], n[a:b]), None
        keys, counts = block.gram_counts(depth)
        order = np.argsort(_cell(keys, depth), kind="stable")
        keys, counts = keys[order], counts[order]
        for cell, a, b in _pieces(_cell(keys, depth)):
            yield number, cell, _ASK, _pack_grams(keys[a:b], counts[a:b]), None

    def run() -> Iterator[pa.RecordBatch]:
        base, held, size, made = TaskContext.get().partitionId() << 32, [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for row in block_rows(base + made, pa.Table.from_batches(held)):
                rows.append(row)
                if row[2] == _TEXT or len(rows) == 1000:
                    yield _messages(rows)
                    rows = []
            if rows:
                yield _messages(rows)

        for whole in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False) + 1
            at = 0
            while at < whole.num_rows:
                room = int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_BYTES - size, side="right"))
                take = max(room, 0 if size else 1)
                held.append(whole.slice(at, take))
                size += int(sizes[at : at + take].sum())
                at += take
                if at < whole.num_rows:
                    yield from flush()
                    held, size, made = [], 0, made + 1
        if size:
            yield from flush()

    return run()


def _block(table: pa.Table) -> Block:
    texts = table.column("text").cast(pa.binary()).to_pylist()
    return Block(texts, table.column("train").to_numpy(zero_copy_only=False).astype(bool))


class Subtrees:
    """All trees below some contexts: one context tree for each node of the binary decomposition.

    ``next_one[:, k]`` is the probability, mixed over the depths below SPLIT, of bit k of each
    gram's byte; ``top`` has, for each node, zeros, ones and summed logs of the children at depth SPLIT + 1.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.next_bit = np.zeros((len(keys), 8))
        self.top = np.zeros((3, 256))
        of_gram = np.arange(len(keys))
        below: list[tuple[np.ndarray, np.ndarray]] | None = None
        for d in range(depth, SPLIT, -1):
            if d < depth:
                shorter = ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255))
                keys, up = np.unique(shorter, return_inverse=True)
                counts = np.bincount(up, weights=counts, minlength=len(keys)).astype(np.int64)
                of_gram = up[of_gram]
            level = []
            for k in range(8):
                node = keys >> np.uint64(8 - k)
                first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                number = np.cumsum(np.concatenate([[False], node[1:] != node[:-1]]))
                bit = ((keys >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
                total = np.add.reduceat(counts, first)
                ones = np.add.reduceat(np.where(bit, counts, 0), first)
                kt = log_kt(total - ones, ones)
                p = _kt_next(total - ones, ones)[number]
                p = np.where(bit, p, 1 - p)[of_gram]
                if below is None:
                    weighted = kt
                    self.next_bit[:, k] = p
                else:
                    child_first, child_log = below[k]
                    children = np.bincount(number[up[child_first]], weights=child_log, minlength=len(first))
                    weighted, own = _mixture(kt, children)
                    own = own[number][of_gram]
                    self.next_bit[:, k] = own * p + (1 - own) * self.next_bit[:, k]
                level.append((first, weighted))
                if d == SPLIT + 1:
                    place = (1 << k) | (node[first].astype(np.int64) & ((1 << k) - 1))
                    np.add.at(self.top[0], place, total - ones)
                    np.add.at(self.top[1], place, ones)
                    np.add.at(self.top[2], place, weighted)
            below = level


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    """Rows arrive sorted by cell: each cell with an iterator over its (block, kind, data)."""
    rows = ((c, (b, k, d)) for batch in batches for b, c, k, d in zip(*(batch.column(n).to_pylist() for n in ("block", "cell", "kind", "data"))))
    for cell, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield cell, (r[1] for r in group)


def _total(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of a stream of counted keys; holds little more than the distinct keys."""
    held, size, merged = [], 0, 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > 2 * merged + 1_000_000:
            held = [_summed(held)]
            size = merged = len(held[0][0])
    return _summed(held) if held else (np.empty(0, _WORD), np.empty(0, np.int64))


def _build(depth: int):
    """Sum what all blocks counted in a cell, and weight its subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _by_cell(batches):
            if cell >= _WORDS:
                keys, counts = _total(_unpack_words(d) for _, _, d in rows)
                yield _messages([(None, cell, _TABLE, keys.tobytes() + counts.astype("<i8").tobytes(), int((counts > 0).sum()))])
                continue
            keys, counts = _total(_unpack_grams(d) for _, _, d in rows)
            trees = Subtrees(keys, counts, depth)
            table = _squeezed(np.diff(keys, prepend=np.uint64(0)).tobytes())
            data = len(table).to_bytes(8, "little") + table + trees.next_bit.astype("<f4").tobytes()
            yield _messages([(None, cell, _TABLE, data, None), (None, cell, _TOP, _squeezed(trees.top.tobytes()), None)])

    return run


def _top_levels(table: pa.Table) -> pa.Table:
    """The nodes at depth SPLIT of the contexts with one most recent byte, and their sums for depth 1.

    At most 256 x SPREAD rows of 6 KB meet here, whatever the input.
    """
    cells, data = table.column("cell").to_numpy(), table.column("data").to_pylist()
    tops: dict[int, np.ndarray] = {}
    for cell, raw in zip(cells.tolist(), data):
        x = np.frombuffer(_unsqueezed(raw), np.float64).reshape(3, 256)
        tops[cell // SPREAD] = tops.get(cell // SPREAD, 0) + x
    above, rows = np.zeros((3, 256)), []
    for context, (zeros, ones, children) in sorted(tops.items()):
        weighted, own = _mixture(log_kt(zeros.astype(np.int64), ones.astype(np.int64)), children)
        above += [zeros, ones, weighted]
        rows.append((context, np.stack([own, own * _kt_next(zeros, ones)]).tobytes()))
    rows.append((-1 - (rows[0][0] >> 8), above.tobytes()))
    return pa.table({"context": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _root_levels(first: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each most recent byte and node: the part of the probability of a 1 that depths 0 and 1 give, and
    the weight that is left for the depths below."""
    total, first_level = np.zeros((3, 256)), {}
    for byte, (zeros, ones, children) in first.items():
        weighted, own = _mixture(log_kt(zeros.astype(np.int64), ones.astype(np.int64)), children)
        total += [zeros, ones, weighted]
        first_level[byte] = (own, _kt_next(zeros, ones))
    zeros, ones, children = total
    _, own0 = _mixture(log_kt(zeros.astype(np.int64), ones.astype(np.int64)), children)
    p0 = own0 * _kt_next(zeros, ones)
    return {b: np.stack([p0 + (1 - own0) * own * p, (1 - own0) * (1 - own)]) for b, (own, p) in first_level.items()}


def _log_probabilities(keys: np.ndarray, next_bit: np.ndarray, base: np.ndarray, top: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's byte in its context."""
    y, out = (keys & np.uint64(255)).astype(np.int64), np.zeros(len(keys))
    for k in range(8):
        node = (1 << k) | (y >> (8 - k))
        bit = (y >> (7 - k)) & 1
        known, left = base[0][node] + base[1][node] * top[1][node], base[1][node] * (1 - top[0][node])
        known = np.where(bit == 1, known, 1 - left - known)
        out += np.log10(known + left * next_bit[:, k])
    return out


def _answer(roots: dict[int, np.ndarray]):
    """Each block gets the counts of the words and the probabilities of the grams that it asked for."""

    def words(rows: Iterator[tuple[int, int, bytes]], cell: int) -> Iterator[tuple]:
        keys, counts = np.empty(0, _WORD), np.empty(0, np.int64)
        for block, kind, data in rows:
            if kind == _TABLE:
                n = len(data) // (_WORD.itemsize + 8)
                keys, counts = np.frombuffer(data, _WORD, n), np.frombuffer(data, "<i8", n, n * _WORD.itemsize)
                continue
            asked, _ = _unpack_words(data)
            yield block, cell, _ANSWER, _squeezed(counts[_places(keys, asked)].tobytes()), None

    def contexts(rows: Iterator[tuple[int, int, bytes]], cell: int) -> Iterator[tuple]:
        top, keys, logs = None, None, None
        for block, kind, data in rows:
            if kind == _TOP:
                top = np.frombuffer(data, np.float64).reshape(2, 256)
            elif kind == _TABLE:
                n = int.from_bytes(data[:8], "little")
                keys = np.cumsum(np.frombuffer(_unsqueezed(data[8 : 8 + n]), np.uint64), dtype=np.uint64)
                bits = np.frombuffer(data, "<f4", offset=8 + n).reshape(len(keys), 8).astype(np.float64)
                logs = _log_probabilities(keys, bits, roots[cell // SPREAD >> 8], top)
            else:
                asked, _ = _unpack_grams(data)
                out = logs[np.searchsorted(keys, asked)].astype("<f4")
                yield block, cell, _ANSWER, _squeezed(np.diff(asked, prepend=np.uint64(0)).tobytes() + out.tobytes()), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for cell, rows in _by_cell(batches):
            for row in (words if cell >= _WORDS else contexts)(rows, cell):
                out.append(row)
                size += len(row[3])
                if size > 4 << 20:
                    yield _messages(out)
                    out, size = [], 0
        if out:
            yield _messages(out)

    return run


def _block_scores(table: pa.Table, counts: np.ndarray, keys: np.ndarray, logs: np.ndarray, depth: int, n: int, v: int, end: int) -> list[np.ndarray]:
    """Per document: tokens, known tokens, bytes, base score and score."""
    block = _block(table)
    docs = len(block.sizes)
    n_tokens, known = np.ones(docs, np.int64), np.full(docs, int(end > 0))
    base = np.full(docs, np.log10(end + 1.0))
    for number, doc in block.words()[1]:
        c = counts[number]
        n_tokens += np.bincount(doc, minlength=docs)
        known += np.bincount(doc[c > 0], minlength=docs)
        base += np.bincount(doc, weights=np.log10(c + 1.0), minlength=docs)
    base -= n_tokens * np.log10(n + v + 1.0)
    score = np.zeros(docs)
    for g, starts, first, last in block.contexts(depth):
        codes, distinct = pd.factorize(g)
        found = logs[np.searchsorted(keys, np.asarray(distinct, np.uint64))].astype(np.float64)
        score[first:last] = np.add.reduceat(found[codes], starts)
    return [n_tokens, known, block.sizes, base, score]


def _score(depth: int, n: int, v: int, end: int, names: list[str]):
    """Rows arrive sorted by block, a block's text before the answers, these in order of cells."""

    def scored(text: bytes, words: list[bytes], contexts: list[bytes]) -> pa.RecordBatch:
        table = pa.ipc.open_stream(text).read_all()
        counts = np.concatenate([np.frombuffer(_unsqueezed(w), "<i8") for w in words]) if words else np.empty(0, np.int64)
        keys, logs = [], []
        for raw in map(_unsqueezed, contexts):
            m = len(raw) // 12
            keys.append(np.cumsum(np.frombuffer(raw, np.uint64, m), dtype=np.uint64))
            logs.append(np.frombuffer(raw, "<f4", m, 8 * m))
        k, p = np.concatenate(keys), np.concatenate(logs)
        order = np.argsort(k)
        columns = _block_scores(table, counts, k[order], p[order], depth, n, v, end)
        kept = [table.column(c).combine_chunks() for c in names]
        return pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns)], [*names, "n_tokens", "n_known", "n_bytes", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, text, words, contexts = None, None, [], []
        for batch in batches:
            for b, cell, kind, data in zip(*(batch.column(c).to_pylist() for c in ("block", "cell", "kind", "data"))):
                if b != block:
                    if text is not None:
                        yield scored(text, words, contexts)
                    block, text, words, contexts = b, None, [], []
                if kind == _TEXT:
                    text = data
                else:
                    (words if cell >= _WORDS else contexts).append(data)
        if text is not None:
            yield scored(text, words, contexts)

    return run


def score_texts(docs: DataFrame, train: Column, depth: int = DEPTH) -> DataFrame:
    """Scores of all whole texts of ``docs`` under models learnt from the rows where ``train`` holds.

    Returns the columns of ``docs`` but for text and those added: n_tokens, n_known, train_tokens, base_score,
    score, n_bytes and bits_per_byte. A-Z become a-z first. ``score`` is log10 of the probability that a context-tree weighting
    model gives the bytes of the text and its end: each byte is eight binary decisions, each decision has a
    tree of the contexts of up to ``depth`` bytes, and each node mixes its Krichevsky-Trofimov estimate with its
    children's, half and half. ``base_score`` sums log10 of (c + 1) / (N + V + 1) over words and end.

    Documents are packed into blocks once. A block asks each subtree for its distinct contexts and each bucket for
    its distinct words, with its counts; subtrees are summed and weighted from the deepest contexts upwards, and
    answer the blocks. What is gathered are all distinct contexts of the corpus, spread over up to 524,288
    cells; only depths 0 and 1 (at most 256 rows of 6 KB) reach the driver.

    Null texts are empty; an empty text has one token, its end. A null ``train`` counts as false. Repeated rows count and are scored
    each. Without rows to learn from every estimate is 1/2. An empty table gives no rows. Columns named like
    added ones are replaced.
    """
    added = ["n_tokens", "n_known", "n_bytes", "base_score", "score", "train_tokens", "bits_per_byte"]
    kept = [c for c in docs.columns if c.lower() not in {*added, "text"}]
    inner = [f"k{i}" for i in range(len(kept))]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(kept, inner)],
        ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    blocks = checkpointed(rows.mapInArrow(lambda batches: _read(batches, depth), _MESSAGE))
    asks = blocks.where(F.col("kind") == _ASK)
    tables = checkpointed(asks.repartition("cell").sortWithinPartitions("cell").mapInArrow(_build(depth), _MESSAGE))

    tops = tables.where(F.col("kind") == _TOP).withColumn("byte", F.shiftright("cell", 8 + SPREAD.bit_length() - 1))
    levels = checkpointed(tops.groupBy("byte").applyInArrow(lambda t: _top_levels(t.drop_columns(["byte"])), "context int, data binary"))
    found = levels.where("context < 0").collect()
    roots = _root_levels({-1 - r["context"]: np.frombuffer(r["data"], np.float64).reshape(3, 256) for r in found})
    part = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    seconds = levels.where("context >= 0").select("context", "data", part.alias("part")).select(
        F.lit(None).cast("long").alias("block"), (F.col("context") * SPREAD + F.col("part")).alias("cell"),
        F.lit(_TOP).alias("kind"), "data", F.lit(None).cast("long").alias("n_tokens"),
    )
    asked = seconds.unionByName(tables.where(F.col("kind") == _TABLE)).unionByName(asks)
    answers = asked.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_answer(roots), _MESSAGE)

    learnt = blocks.where(F.col("kind") == _TEXT).agg(F.sum("n_tokens")).first()[0] or 0
    ends = rows.where("train").count()
    distinct = (tables.where(F.col("kind") == _TABLE).agg(F.sum("n_tokens")).first()[0] or 0) + (ends > 0)
    both = blocks.where(F.col("kind") == _TEXT).unionByName(answers).repartition("block").sortWithinPartitions("block", "kind", "cell")
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in inner)
    schema = f"{types}{', ' if inner else ''}n_tokens long, n_known long, n_bytes long, base_score double, score double"
    scored = both.mapInArrow(_score(depth, learnt, distinct, ends, inner), schema)
    return scored.select(
        *[F.col(k).alias(c) for c, k in zip(kept, inner)],
        "n_tokens", "n_known", F.lit(learnt).cast("long").alias("train_tokens"), "base_score", "score",
        (F.col("n_bytes") - 1).alias("n_bytes"),
        (-F.col("score") * float(np.log2(10.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
