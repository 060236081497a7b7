"""Phrase collocations by partition: phrases frequent in some shard are counted over all shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telmora.llm.common import ascii_lower, checkpointed
from telmora.operators.ordered import top_per_group

#: Words that a task gathers before it counts their phrases.
BLOCK_WORDS = 1_000_000
#: Entries (distinct phrases of a block) that meet in one bucket of a shard, about.
BUCKET_ENTRIES = 2_000_000
#: Bits of the filter for each phrase found frequent so far, and the most bits it may have. It goes to all tasks and
#: never takes more than 32 MB. It only saves work; what passes wrongly is told apart by text in the last count.
BITS_EACH, FILTER_BITS = 16, 1 << 28
SEED = 42

_CUT, _GAP = b".,;:!?\n\x0b\x0c\r", b" \t"
#: 0: inside a word, 1: between words, 2: between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_GAP)] = 1
_CLASS[list(_CUT)] = 2
_EMPTY = np.empty(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def phrase_hash(head: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its words before the last one, and of the last one."""
    with np.errstate(over="ignore"):
        return _mixed(head * np.uint64(0x9E3779B97F4A7C15) + _mixed(last))


def word_hash(lang: Column, word: Column) -> Column:
    """The hash that ``_Words`` gives a word of a language."""
    return F.xxhash64(lang, word)


class BitSet:
    """A set of hashes as bits; it may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @classmethod
    def of(cls, hashes: DataFrame) -> BitSet:
        """From the column ``h``; the bits are set on the executors, and segments of 4 KB reach the driver."""
        most = max(1 << 15, BITS_EACH * hashes.count())
        size = min(1 << most.bit_length(), FILTER_BITS)
        at = F.pmod("h", F.lit(size)) + 1
        rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
        bits = np.zeros(max(size // 8, 4096), np.uint8)
        for b, m in rows.toLocalIterator():
            bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)
        return cls(bits, size)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.int64) % np.int64(self.size)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@dataclass
class _Words:
    """The words of some texts of one language: ``ids`` into ``names``, and ``piece``, the number of the piece."""

    names: pa.Array
    hashes: np.ndarray
    ids: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, lang: str, texts: list[bytes]) -> _Words:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        kind = _CLASS[data]
        inside = kind == 0
        edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])]
        )
        coded = words.dictionary_encode()
        names = coded.dictionary
        seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names.to_pylist()), np.uint64, len(names))
        piece = np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)
        return cls(names, hashes, coded.indices.to_numpy().astype(np.int64), piece)

    def phrases(self, length: int, known: list[BitSet]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the phrases of ``length`` words within a piece whose parts may all be
        frequent: ``known[m]`` has the words for m = 0, else the phrases of m + 1 words."""
        good = known[0].has(self.hashes)[self.ids]
        at = np.flatnonzero(good)
        h = self.hashes[self.ids[at]]
        for m in range(1, length):
            fits = at + m < len(self.ids)
            at, h = at[fits], h[fits]
            fits = good[at + m] & (self.piece[at + m] == self.piece[at])
            at, h = at[fits], h[fits]
            h = phrase_hash(h, self.hashes[self.ids[at + m]])
            if m + 1 < length:
                fits = known[m].has(h)
                at, h = at[fits], h[fits]
        if length > 2:
            tail = self.hashes[self.ids[at + 1]]
            for m in range(2, length):
                tail = phrase_hash(tail, self.hashes[self.ids[at + m]])
            fits = known[length - 2].has(tail)
            at, h = at[fits], h[fits]
        return at, h


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(h)
    return np.asarray(distinct, np.uint64), np.bincount(codes, minlength=len(distinct))


def _blocks(batches: Iterator[pa.RecordBatch], sharded: bool = False) -> Iterator[tuple[str, int, _Words]]:
    """Texts of a task as blocks of words of one language, and of one shard if ``sharded``."""
    held: dict[tuple[str, int], list[bytes]] = {}
    size = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("lang", "shard")]
        for lang, shard, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist()):
            held.setdefault((lang, shard if sharded else 0), []).append(text)
            size += len(text)
            if size > 12 * BLOCK_WORDS:
                yield from ((*key, _Words.of(key[0], texts)) for key, texts in held.items())
                held, size = {}, 0
    yield from ((*key, _Words.of(key[0], texts)) for key, texts in held.items())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, _, words in _blocks(batches):
        n = np.bincount(words.ids, minlength=len(words.names))
        names = pa.concat_arrays([words.names.cast(pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())])
        counts = pa.array(np.append(n, len(words.ids)))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), names, counts], ["lang", "word", "c"])


def _mine(length: int, known: list[BitSet], shards: int, buckets: int):
    """Distinct phrases of each block with their counts, packed by shard and bucket of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard, words in _blocks(batches, sharded=True):
            h, n = _counted(words.phrases(length, known)[1])
            bucket = (h >> np.uint64(32)).astype(np.int64) % buckets
            order = np.lexsort((h, bucket))
            h, n, bucket = h[order], n[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cuts[1:], len(h))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[cuts] * shards + shard, pa.int64()),
                    pa.array([h[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                    pa.array([n[a:b].astype("<u4").tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                ],
                ["cell", "hashes", "counts"],
            )

    return run


def _frequent(support: int):
    """Hashes that reach the local support in one shard. Entries of a cell arrive together, as rows are sorted by it."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], np.add.reduceat(n, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, size, merged = None, [], 0, 0

        def found() -> pa.RecordBatch:
            h, n = summed(parts) if size else (_EMPTY, np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(h[n >= support].view(np.int64))], ["h"])

        for batch in batches:
            for c, h, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if c != cell:
                    if size:
                        yield found()
                    cell, parts, size, merged = c, [], 0, 0
                parts.append((np.frombuffer(h, np.uint64), np.frombuffer(n, "<u4").astype(np.int64)))
                size += len(parts[-1][0])
                if size > 2 * merged + BUCKET_ENTRIES:
                    parts = [summed(parts)]
                    size = merged = len(parts[0][0])
        if size:
            yield found()

    return run


def _count_candidates(known: list[BitSet], longest: int):
    """Texts and counts of the candidates in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, words in _blocks(batches):
            for length in range(2, longest + 1):
                at, h = words.phrases(length, known)
                fits = known[length - 1].has(h)
                at, h = at[fits], h[fits]
                codes, _ = pd.factorize(h)
                order = np.argsort(codes, kind="stable")
                # Occurrences of one hash with different words are different phrases.
                ids = np.stack([words.ids[at[order] + m] for m in range(length)]) if len(at) else np.zeros((length, 0), np.int64)
                changed = np.flatnonzero(np.concatenate([[True], (np.diff(ids) != 0).any(0)])) if len(at) else np.zeros(0, np.int64)
                n = np.diff(np.append(changed, len(at)))
                names = words.names.cast(pa.binary()).cast(pa.string())
                texts = pc.binary_join_element_wise(*[names.take(pa.array(ids[m][changed])) for m in range(length)], " ")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(changed), pa.string()), texts, pa.array(n)], ["lang", "phrase", "c"])

    return run


def _words_of(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_count_words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("f"))


def count_phrases(docs: DataFrame, min_count: int = 10, longest: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, phrases and totals of each language: (lang, word, f), (lang, phrase, f, w), with w its words, and (lang, n).

    Words are counted first, exactly. Documents are dealt by hash to min_count / 2 shards of equal weight, so a phrase
    that occurs ``min_count`` times does so at least min_count / shards times in one of them: the local
    support. Each shard is mined whole at that support, length by length, only through phrases whose parts may
    be frequent; its counting is spread over buckets of the phrases' hashes, so neither a shard nor a common
    phrase is held by one task. What is frequent in some shard is a candidate, and all candidates are
    counted by text over all documents.
    """
    shards = max(1, min_count // 2)
    support = -(-min_count // shards)
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), F.lit(shards)).cast("int").alias("shard"),
    )
    counted = checkpointed(_words_of(texts).where((F.col("f") >= min_count) | F.col("word").isNull()))
    totals = counted.where("word is null").select("lang", F.col("f").alias("n"))
    words = counted.where("word is not null")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    # Buckets follow the data and not the cluster: each block sends one row to each bucket it has phrases for.
    buckets = max(1, -(-n_words // BUCKET_ENTRIES))

    known = [BitSet.of(words.select(word_hash(F.col("lang"), F.col("word")).alias("h")))]
    for length in range(2, longest + 1):
        cells = texts.mapInArrow(_mine(length, known, shards, buckets), "cell long, hashes binary, counts binary")
        found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_frequent(support), "h long")
        known.append(BitSet.of(checkpointed(found)))
    exact = texts.mapInArrow(_count_candidates(known, longest), "lang string, phrase string, c long")
    phrases = exact.groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= min_count)
    return words, checkpointed(phrases.withColumn("w", F.split("phrase", " "))), totals


def _exact_score(a: Column, lower: Column, rest: Column) -> Column:
    """floor(10^6 a^2 / (l r)) in decimals that hold counts up to 10^15."""
    wide = lambda c: c.cast("decimal(15,0)")
    squares = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", squares, wide(lower) * wide(rest))


def collocations(
    docs: DataFrame, min_count: int = 10, longest: int = 3, share: int = 50, top: int = 2000
) -> DataFrame:
    """The best phrases of each language of ``docs`` (text, lang): lang, rank, phrase, a, l, r, n, score.

    Text is cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs; A-Z become a-z. A
    phrase has two to ``longest`` words of one piece and occurs ``min_count`` times (a). The cut after k words with the
    least score floor(10^6 a^2 / (l r)), ties to the least k, gives l and r, the counts of both parts. A phrase inside a longer
    one with ``share`` percent of its occurrences goes. Each language keeps ``top`` by score, a and phrase.

    Null texts are empty and null languages are ``und``. Repeated rows count each. Texts without words and an
    empty table give no rows. Only text and lang are read, so other columns may have any names. Arithmetic is exact up to counts of 10^15.
    """
    words, phrases, totals = count_phrases(docs, min_count, longest)
    counts = words.select("lang", F.col("word").alias("part"), F.col("f").alias("part_f")).unionByName(
        phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    )
    rows = phrases.select("lang", "phrase", "w", F.size("w").alias("len"), F.col("f").alias("a"))
    cuts = rows.select(
        "lang", "phrase", "a",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.col("len") - 1),
                lambda k: F.struct(
                    k.alias("k"),
                    F.array_join(F.slice("w", F.lit(1), k), " ").alias("head"),
                    F.array_join(F.slice("w", k + 1, F.col("len") - k), " ").alias("tail"),
                ),
            )
        ).alias("cut"),
    ).select("lang", "phrase", "a", "cut.*")
    heads = counts.select("lang", F.col("part").alias("head"), F.col("part_f").alias("l"))
    tails = counts.select("lang", F.col("part").alias("tail"), F.col("part_f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    scored = scored.withColumn("score", _exact_score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = rows.where("len > 2").select(
        "lang", "a",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(2), F.col("len") - 1),
                        lambda m: F.transform(
                            F.sequence(F.lit(1), F.col("len") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")
                        ),
                    )
                )
            )
        ).alias("phrase"),
    )
    covering = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(covering, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scores = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    first = top_per_group(scores, ["lang"], order, top, "phrase")  # a language meets in one task only as ``top`` of each slice
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
