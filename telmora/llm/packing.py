"""Packing of tokenised documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telmora.llm.common import checkpointed, partitions

WINDOW = 2048
END_ID = 1
#: Words whose ids a task keeps; the store is emptied when it is full.
WORDS_KEPT = 800_000

_DOUBLE = ("  ", "\n\n", " \n", "\n ")
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_OTHER_ASCII = [c for c in _OTHER if c.isascii()]
_ODD = re.compile(r"\A\s|\s\Z|[ \n]\s|\s[ \n]")


class Encoder:
    """Token ids of whole texts, word by word.

    The tokenizer never joins a character other than white space with a space that follows it, nor
    a line break between two such characters with anything, so a text may be cut there and equal
    words need be encoded once. Texts with other white space or with a special token's text are
    encoded whole. With ``ranks``, the same vocabulary as a file of ranks, single words take the
    shorter way through those.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_rank = _rank_encoding(ranks) if ranks else None
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.packers = [struct.Struct(f"<{n}I").pack for n in range(32)]
        self.first, self.later = _Ids(self._word, ""), _Ids(self._word, " ")
        self.newline = self._whole(["\n"])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _word(self, word: str) -> bytes:
        if self.by_rank is None:
            return self._whole([word])[0]
        ids = self.by_rank.encode_ordinary(word)
        return self.packers[len(ids)](*ids) if len(ids) < len(self.packers) else struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.first) + len(self.later) > WORDS_KEPT:
            self.first.clear()
            self.later.clear()
        whole, cut = [], {}
        for i, text in enumerate(texts):
            if any(s in text for s in self.specials) or not _single_spaced(text):
                whole.append(i)
            else:
                cut[i] = [line.split(" ") for line in text.split("\n")]
        out = dict(zip(whole, self._whole([texts[i] for i in whole])))
        first, later = self.first.__getitem__, self.later.__getitem__
        for i, lines in cut.items():
            out[i] = self.newline.join([b"".join([first(words[0]), *map(later, words[1:])]) for words in lines])
        return [out[i] for i in range(len(texts))]


class _Ids(dict):
    """Ids of words with what comes before them, kept as they are met."""

    def __init__(self, encode: Callable[[str], bytes], before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(self.before + word)
        return ids


def _single_spaced(text: str) -> bool:
    """Whether no space or line break is at an end of the text or beside other white space."""
    if any(c in text for c in (_OTHER_ASCII if text.isascii() else _OTHER)):
        return not _ODD.search(text)
    ends = " \n"
    return text != "" and text[0] not in ends and text[-1] not in ends and not any(c in text for c in _DOUBLE)


def _rank_encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, ranks: str | None, window: int, with_ids: bool):
    """Full windows and one rest for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for low in range(0, len(texts), 256):
                rows, pieces = [], []
                for doc, ids in zip(docs[low : low + 256], encoder.encode(texts[low : low + 256])):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total))
                        if with_ids:
                            pieces.append(piece)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns, names = [*columns, pa.array(pieces, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _fullest(lengths: np.ndarray, counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum comes closest to ``room``, never above it.

    Reachable sums are the set bits of one integer. A length with count c is added in powers of two
    of items, longest lengths first; the bits before each addition are kept to trace back which
    additions the best sum needs.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length, count in zip(lengths.tolist(), counts.tolist()):
        left, block = min(count, room // length), 1
        while left > 0:
            n = min(block, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left, block = left - n, 2 * block
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, n, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + n
            best -= length * n
    return used


def minimum_bin_slack(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """Bins for ``counts[length]`` items of each length below ``window``: (bins, items in each bin).

    A bin is seeded with the longest item left and filled by the multiset that leaves least slack;
    it is repeated as long as the counts allow. So the work depends on the number of lengths, not
    on the number of items.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    plan: list[tuple[int, dict[int, int]]] = []
    while left:
        seed = max(left)
        left[seed] -= 1
        lengths = np.array(sorted((k for k, v in left.items() if v > 0), reverse=True), np.int64)
        used = _fullest(lengths, np.array([left[k] for k in lengths.tolist()], np.int64), window - seed) if len(lengths) else {}
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        bins = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
        plan.append((bins, used))
    return plan


def _places(plan: list[tuple[int, dict[int, int]]], window: int, full: int) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, items in a bin, first bin, offset of the first item)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {window: [(0, 1, 0, 0)]}
    given: dict[int, int] = {}
    bin_ = full
    for bins, used in plan:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.setdefault(length, []).append((given.get(length, 0), n, bin_, offset))
            given[length] = given.get(length, 0) + n * bins
            offset += length * n
        bin_ += bins
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _place(places: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                here, table = np.flatnonzero(length == n), places[n]
                row = table[np.searchsorted(table[:, 0], rank[here], "right") - 1]
                inside = rank[here] - row[:, 0]
                sequence[here] = row[:, 2] + inside // row[:, 1]
                offset[here] = row[:, 3] + inside % row[:, 1] * n
            names = [n for n in batch.schema.names if n != "__rank"]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document and its place: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` the ids (little-endian 32 bits).

    A document's ids, with the end id, are cut into full windows and one rest. Only the counts of
    rest lengths (fewer than ``window`` numbers) go to the driver, which plans bins by minimum slack.
    Pieces of a length are ranked in blocks and look their bin up in the plan by rank.

    Null and empty texts are the end id alone. Repeated rows are packed once each. An empty table
    gives no pieces. Columns other than doc_id and text are ignored.
    """
    schema = _PIECE + (", ids binary" if with_ids else "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = texts.mapInArrow(_cut(tokenizer, ranks, window, with_ids), schema)
    pieces = checkpointed(pieces.withColumn("__row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = minimum_bin_slack({k: v for k, v in counts.items() if k < window}, window)
    places = _places(plan, window, counts.get(window, 0))

    blocks = max(64, partitions(docs.sparkSession))
    split = pieces.withColumn("__block", F.pmod(F.col("__row"), F.lit(blocks)))
    inside = Window.partitionBy("length", "__block").orderBy("__row")
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = split.groupBy("length", "__block").agg(F.count("*").alias("__n"))
    starts = sizes.select("length", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = split.withColumn("__at", F.row_number().over(inside)).join(starts, ["length", "__block"])
    ranked = ranked.withColumn("__rank", F.col("__start") + F.col("__at") - 1)
    names = [c.split()[0] for c in schema.split(", ")]
    return ranked.select(*names, "__rank").mapInArrow(_place(places), schema + ", sequence_id long, offset long")


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The padded sequences of ``pack(..., with_ids=True)``: sequence_id, ids, n_tokens.

    A sequence is padded with id 0 to ``window``, except one whose length is a power of two.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(ordered, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    joined = pieces.groupBy("sequence_id").agg(whole.alias("ids"), F.sum("length").alias("n_tokens"))
    even = F.bit_count(F.col("n_tokens")) == 1
    padding = F.when(even, F.lit(0)).otherwise(window - F.col("n_tokens")) * 4
    zeros = F.unhex(F.repeat(F.lit("00"), padding.cast("int")))
    return joined.select("sequence_id", F.concat("ids", zeros).alias("ids"), "n_tokens")
