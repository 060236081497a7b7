"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telmora.llm import chat, codes, decontam, jaccard, knn, lines, lm, packing, paragraphs, phrases, sharding, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


@_query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near equal bytes, split by size, language and source."""
    docs = _table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    rows = docs.select(
        "doc_id",
        size.alias("size"),
        _crc(F.col("text")).cast("long").alias("text_crc32"),
        F.log1p(size.cast("double")).alias("log_size"),
        F.pmod(F.xxhash64("lang"), F.lit(1000)).alias("lang_code"),
        F.pmod(F.xxhash64("source"), F.lit(1000)).alias("source_code"),
    )
    placed = sharding.kd_shards(rows, "size", ["log_size", "lang_code", "source_code"], 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_WORDS8 = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_OP8_SQL = f"""
with d as (select doc_id, {_WORDS8} as w from documents),
b as (select item_id, {_WORDS8} as w from benchmark),
win as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) as ww from b where len(w) > 0),
lens as (select distinct len(ww) as m from win),
pos as (select doc_id, m, s, w[s:s + m - 1] as ww
        from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as s from d, lens)),
hit as (select doc_id, m, s, item_id from pos join win using (ww)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + m)) as p from hit) group by all),
found as (select doc_id, count(distinct item_id) as n_items,
          sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as items_sha256 from hit group by all)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
"""


@_query("op8_decontamination", _OP8_SQL)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in windows of ten benchmark words."""
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_OP7_SQL = r"""
with l as (select doc_id, pos, line,
             translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
           from (select doc_id, unnest(s) as line, unnest(range(1, len(s) + 1)) as pos
                 from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents))),
r as (select k, min(doc_id) as keeper from l where length(k) >= 10 group by k having count(distinct doc_id) > 1),
m as (select l.*, keeper is not null and keeper <> doc_id as gone from l left join r using (k))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""


@_query("op7_line_dedup", _OP7_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    kept = lines.deduplicate_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256"))


def tokenizer_files() -> tuple[str, str]:
    """The byte-level vocabulary, and the same as ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@_query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into windows of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), *tokenizer_files())


@_query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles are at least 0.8 similar."""
    found = jaccard.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


_OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
s as (select q.vec_id as query_id, d.vec_id, list_dot_product(q.v, d.v)::bigint as score
      from v q join v d on q.vec_id <> d.vec_id and len(q.v) = len(d.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@_query("op10_exact_top_k", _OP10_SQL)
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every vector whose id is divisible by 50."""
    rows = _table(spark, sf_dir, "embeddings").where(knn.usable(F.col("embedding")))
    vectors = rows.select(F.col("vec_id").alias("id"), knn.quantised(F.col("embedding")).alias("v"))
    return knn.top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)


@_query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels outside the held-out fifth."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, chain).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"),
    )


_TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "maximum": 200}}},
    "translate": {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {"text": {"type": "string"}, "words": {"type": "integer"}}},
}


@_query("op1_tool_calls")
def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results derived from ``conversations``: a user turn calls a tool, the turn after it
    is the result, and a call depends on the call at about half its turn."""
    turns = _table(spark, sf_dir, "conversations")
    code = lambda turn: F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")), 256)
    size = F.size(F.split(F.coalesce("text", F.lit("")), " "))
    searches = F.crc32(F.coalesce("text", F.lit("")).cast("binary")) % 2 == 0
    arguments = F.when(searches, F.to_json(F.struct(size.alias("limit"), F.col("text").alias("query"))))
    arguments = arguments.otherwise(F.to_json(F.struct(size.alias("words"), F.col("text").alias("text"), F.lit(True).alias("final"))))
    half = (F.col("turn") / 4).cast("long") * 2
    calls = turns.where("role = 'user'").select(
        "conv_id", code(F.col("turn")).alias("call_id"), F.col("turn").cast("long").alias("turn"),
        F.when(searches, "search").otherwise("translate").alias("name"), arguments.alias("arguments"),
        F.array_remove(F.array(code(half), code(half + 1)), code(F.col("turn"))).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", code(F.col("turn") - 1).alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("content")
    )
    found = chat.link_tool_calls(calls, results, _TOOLS)
    return found.select("conv_id", "call_id", "turn", "name", "level", "linked", "errors", "json")


@_query("op4_repeated_paragraphs")
def op4_repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that an earlier document holds, exactly or nearly."""
    found = paragraphs.repeated_paragraphs(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "n_words", "keep_doc_id")


@_query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the strings of 50 bytes that an earlier document holds."""
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def _op11_sql(rounds: int = 6) -> str:
    """The assignments and means written out round by round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} as materialized (select x.vec_id, x.p, e.i, sum((x.x - e.c) * (x.x - e.c))::bigint as d from x join e{r} e using (p, q) group by all),
a{r} as materialized (select vec_id, p, arg_min(i, d::hugeint * 16 + i) as i, min(d) as d from d{r} group by all)""")
        if r < rounds:
            steps.append(f"""
m{r} as materialized (select x.p, a.i, x.q, sum(x.x)::bigint as s, count(*) as n from a{r} a join x using (vec_id, p) group by all),
e{r + 1} as materialized (select p, i, q, coalesce((s - ((s % n) + n) % n) // n, c) as c from e{r} left join m{r} using (p, i, q))""")
    chain = ",".join(steps)
    return f"""
with k as materialized (select vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
w as (select max(len(embedding)) // 8 as w from k),
x as materialized (select vec_id, t // w as p, t % w as q, floor(4096 * embedding[t + 1]::double)::bigint as x
  from (select vec_id, embedding, unnest(range(len(embedding))) as t from k), w),
e0 as materialized (select p, i, q, x as c from x
  join (select vec_id, row_number() over (order by vec_id) - 1 as i from k order by vec_id limit 16) using (vec_id)),{chain},
s as (select sha256(string_agg(c::varchar, ',' order by p, i, q)) as codebooks_sha256 from e{rounds}),
f as (select vec_id, string_agg(printf('%02x', i), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by all)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from f join k using (vec_id), s
"""


@_query("op11_vector_codes", _op11_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in eight parts of sixteen entries, and their squared errors by label."""
    found = codes.encode(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", keep=["vec_id", "label"])
    digits = F.transform("codes", lambda i: F.lower(F.lpad(F.hex(i), 2, "0")))
    return codes.label_errors(found.rows, F.col("label")).select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", F.col("label_error").cast("long").alias("label_error"),
        F.lit(codes.codebook_digest(found.entries)).alias("codebooks_sha256"),
    )


_OP13_SQL = r"""
with pieces as materialized (select lang, unnest(list_transform(string_split_regex(t, '[.,;:!?\x0A-\x0D]'),
    lambda p: list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> ''))) as w
  from (select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)),
n as (select lang, sum(len(w))::bigint as n from pieces group by lang),
grams as materialized (select lang, m, p, count(*) as f from (
    select lang, 1 as m, unnest(w) as p from pieces
    union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from pieces
    union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from pieces)
  group by all),
cand as materialized (select lang, m, p, f as a, string_split(p, ' ') as w from grams where m >= 2 and f >= 10),
parts as materialized (select lang, p, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail
  from (select *, unnest(range(1, m)) as k from cand)),
cuts as (select c.lang, c.p, c.a, k, l.f as l, r.f as r, ((1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f))::bigint as score
  from parts c join grams l on l.lang = c.lang and l.p = c.head join grams r on r.lang = c.lang and r.p = c.tail),
best as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
inner_p as (select lang, p, max(a) as longer from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as p from cand where m = 3) group by all),
kept as (select b.* from best b left join inner_p i using (lang, p) where i.longer is null or 100 * i.longer < 50 * b.a)
select lang, rank::bigint as rank, p as phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, p) as rank from kept) join n using (lang)
where rank <= 2000
"""


@_query("op13_collocations", _OP13_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


@_query("op12_lm_scores")
def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all texts under context-tree weighting and under word frequencies."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_crc(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found = lm.score_texts(docs.withColumn("held_out", held_out), ~F.col("held_out"))
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"
    )
