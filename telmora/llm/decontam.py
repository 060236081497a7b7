"""Benchmark decontamination: a prefix-filtered set join with exact containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telmora.llm.common import ascii_lower, checkpointed, hinted, row_key

WINDOW = 10
SHINGLE = 5
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of letters, digits and characters outside ASCII; null has none."""
    found = F.array_remove(F.split(ascii_lower(text), _NO_WORD), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _shingle(words_: Column, at: Column, k: int) -> Column:
    """Hash of ``k`` words from position ``at`` (from 0) on."""
    return F.xxhash64(F.lit(k), *[F.get(words_, at + i) for i in range(k)])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``ww`` (words), ``m`` (their number) and ``items`` (ids, as text).

    A shorter item is one window; an item without words has none. An item without an id takes
    part in hits but is in no list.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))))
    cut = items.select("item", "w", start.alias("at")).select("item", F.slice("w", F.col("at"), window).alias("ww"))
    return cut.groupBy("ww").agg(F.collect_set("item").alias("items")).withColumn("m", F.size("ww"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``n_words``, ``n_hit`` (words inside an
    occurrence of a window), ``items`` (sorted ids whose windows occur) and ``spans`` (first word and
    end of each maximal run of hit words).

    A window is the set of its shingles. Every occurrence holds the shingle that is rarest in the
    documents, so this one token is the necessary prefix at full containment. One scan looks up the
    documents' shingles among those of the benchmark and keeps the words around each match; their
    counts give the order of rarity. A window is then joined on its rarest shingle only, at the
    position that this fixes; it must lie inside the document (length bound) and all its words must
    be equal. Windows with a shingle that occurs nowhere drop out before.

    Nulls and texts without words have no hits. Rows with the same id and text give the same row
    each; the same id with another text is another document. Empty inputs give no rows or no hits.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    windows = checkpointed(benchmark_windows(benchmark, window))
    k = F.least(F.col("m"), F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(k).distinct().collect())  # at most ``shingle`` values
    token = F.lit(None).cast("long")
    for n in sizes:
        token = F.when(k == n, _shingle(F.col("ww"), F.col("r"), n)).otherwise(token)
    offsets = F.explode(F.sequence(F.lit(0), F.col("m") - k))
    grams = checkpointed(windows.select("ww", "m", "items", offsets.alias("r")).withColumn("token", token))
    tokens = grams.select("token").distinct()
    n_tokens = tokens.count()

    # Positions from -1: that row stands for the document itself.
    reach = window - min([shingle, *sizes])
    worded = docs.select("doc_id", row_key().alias("text_key"), words(F.col("text")).alias("w"))
    placed = worded.select("*", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("i"))
    ahead = [_shingle(F.col("w"), F.col("i"), n) for n in sizes]
    hashed = placed.withColumn("token", ahead[0] if len(ahead) == 1 else F.explode(F.array(*ahead)) if ahead else F.lit(None).cast("long"))
    known = hinted(tokens.withColumn("known", F.lit(True)), n_tokens)
    first = F.greatest(F.col("i") - reach, F.lit(0))
    found = hashed.join(known, "token", "left").where("i < 0 or known")
    found = checkpointed(
        found.select(
            "doc_id", "text_key", "i", F.size("w").alias("n_words"), first.alias("first"),
            F.when(F.col("i") >= 0, F.col("token")).alias("token"),
            F.when(F.col("i") >= 0, F.slice("w", first + 1, 2 * window)).alias("near"),
        )
    )
    copies = max(len(sizes), 1)
    base = found.where("i < 0").groupBy("doc_id", "text_key", "n_words").agg((F.count("*") / copies).cast("long").alias("copies"))
    hits = found.where("i >= 0").dropDuplicates(["doc_id", "text_key", "i", "token"])

    counts = hits.groupBy("token").agg(F.count("*").alias("df"))
    ranked = grams.join(hinted(counts, n_tokens), "token", "left")
    prefix = (
        ranked.groupBy("ww", "m", "items")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "r")).alias("least"))
        .where("least.df > 0")
        .select("ww", "m", "items", "least.token", "least.r")
    )
    start = F.col("i") - F.col("r")
    exact = (
        hits.join(hinted(prefix, n_tokens), "token")
        .withColumn("s", start)
        .where((F.col("s") >= 0) & (F.col("s") + F.col("m") <= F.col("n_words")))
        .where(F.slice("near", F.col("s") - F.col("first") + 1, F.col("m")) == F.col("ww"))
        .select("doc_id", "text_key", "s", (F.col("s") + F.col("m")).alias("e"), "items")
    )
    per_doc = exact.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("s", "e")).alias("at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    per_doc = per_doc.select(
        F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"),
        _runs(F.col("at")).alias("spans"), F.array_sort("items").alias("items"),
    )
    joined = base.join(per_doc, base["doc_id"].eqNullSafe(F.col("hit_id")) & (base["text_key"] == F.col("hit_key")), "left")
    n_hit = F.aggregate("spans", F.lit(0), lambda n, x: n + x["e"] - x["s"])
    return joined.select(
        "doc_id", "text_key", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"),
    ).drop("copy")


def _runs(intervals: Column) -> Column:
    """Maximal runs of overlapping or touching intervals, in order."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (x["s"] <= last["e"])
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(joins, longer).otherwise(F.concat(done, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))

    return F.aggregate(F.array_sort(intervals), empty, step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with all their columns."""
    hit = contamination(docs, benchmark, window).where("n_hit > 0")
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (row_key() == F.col("__key"))
    return docs.join(hit, same, "left_anti")
