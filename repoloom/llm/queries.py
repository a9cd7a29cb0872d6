"""One query per operator, with oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoloom.llm import chat, decontaminate, exactdup, histpack, lmscore, neardup, packing, pii, quality, resample, secrets, warc, whitening
from repoloom.runtime import stage

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Said by both rows of conversation -1.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        RUNS[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
OP1_SQL = f"""
with i as (select item_id, {_WORDS} as w from benchmark), d as (select doc_id, {_WORDS} as w from documents),
win as (
  select distinct item_id, array_to_string(w[k:k + 9], ' ') as t, least(len(w), 10) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from i where len(w) > 0)
), sizes as (select distinct n from win),
spots as (
  select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)
), hits as (select doc_id, s.n, k, item_id from spots s join win on win.t = s.t and win.n = s.n),
hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) group by doc_id),
hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


@query("op1_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.word_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    light, _ = stage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(light).withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as n
  from rows
), lengths as (
  select *, length(role) + 8 + length(text)
    + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '</?s>')) + len(regexp_extract_all(text, '<\|'))
    + len(regexp_extract_all(text, '\|>')) + len(regexp_extract_all(text, '\[/?INST\]')) as block
  from escaped
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(block))::bigint as formatted_chars
from lengths group by conv_id
"""


@query("op4_chat_formatting", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    # a linear conversation is a tree of one branch: each turn replies to the one before
    rows = rows.unionByName(said).withColumn("node", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    rows = rows.withColumn("parent", F.nullif(F.col("node") - 1, F.lit(0)))
    back = chat.read_back(chat.format_conversations(rows, "conv_id", "node", "parent"))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_all, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: Key of the query's surrogates; a real job brings its own secret.
SURROGATE_KEY = b"repoloom surrogate key"


@query("op5_pii_surrogates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "text", "entities", "n_entities")


OP6_SQL = r"""
with recursive d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), w as (
  select doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d
), s as (
  select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from w where len(w) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by all)
  join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)
), reach(doc_id, r) as (
  select doc_id, doc_id from documents union select reach.doc_id, links.b from reach join links on links.a = reach.r
)
select d.doc_id, coalesce(n, 0) as n_shingles, min(r) as component_id, d.doc_id = min(r) as kept
from d left join n using (doc_id) join reach on reach.doc_id = d.doc_id group by d.doc_id, n
"""


@query("op6_minhash_near_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP7_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages
), last as (select html, max(page_id) as last_id from p where n >= 1000 group by html)
select page_id, n::bigint as payload_bytes, sha1(p.html) as payload_digest,
  case when page_id < last_id then 'revisit' else 'response' end as record_type,
  case when page_id < last_id then last_id end as refers_to
from p left join last on last.html = p.html and n >= 1000
"""


@query("op7_warc", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(spark, index, keep_payload=False).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _spans_sql(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Findings of one kind: positions from the pieces between the matches."""
    return f"""
  select doc_id, '{kind}' as kind, {rank} as rank, a, a + length(m) as b from (
    select doc_id, m, sum(length(piece) + coalesce(length(before), 0)) over (partition by doc_id order by i) as a, {keep} as ok from (
      select doc_id, i, ms[i] as m, ps[i] as piece, ms[i - 1] as before from (
        select doc_id, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as ps from d
      ), unnest(range(1, len(ms) + 1)) as u(i)
    )
  ) where ok"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
OP8_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents), spans as (
{_spans_sql("assign", 0, _ASSIGN, r"length(regexp_extract(m, '[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12")}
  union all
{_spans_sql("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 18")}
  union all
{_spans_sql("hex", 2, "[0-9a-f]+", "length(m) >= 16")}
), per as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex, string_agg(concat(kind, ':', a, ':', b), ',' order by a, rank) as spans
  from spans group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per on per.doc_id = d.doc_id
"""


@query("op8_secret_scan", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # an earlier state of the corpus fills the ledger; the scan of the whole then takes from it what that state had
    earlier = docs.filter(F.sha2(F.coalesce("text", F.lit("")), 256) < "8")
    _, ledger = secrets.scan_versions(earlier)
    findings, _ = secrets.scan_versions(docs, ledger)
    return findings.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


OP9_SQL = r"""
with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
), g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g on g.t = d.t
"""


@query("op9_exact_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.lm_scores(table(spark, sf_dir, "documents"))
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))


@query("op11_histogram_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return histpack.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


_WORD_LIST = f"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB has no CRC-32: a table of 256 remainders, folded over the bytes of each distinct word.
OP13_SQL = f"""
with recursive steps(b, k, r) as (
  select b, 0, b from range(256) t(b)
  union all select b, k + 1, case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end from steps where k < 8
), remainders as (select list(r order by b) as rs from steps where k = 8),
d as (select doc_id, {_WORD_LIST} as w from documents), i as (select {_WORD_LIST} as w from benchmark),
dw as (select doc_id, word, count(*) as c from (select doc_id, unnest(w) as word from d) group by all),
iw as (select word, count(*) as c from (select unnest(w) as word from i) group by all),
hashed as (
  select word, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(hex(encode(word))), 2), lambda k: ('0x' || substr(hex(encode(word)), k, 2))::bigint)),
      lambda a, x: xor(a >> 8, rs[xor(a & 255, x) + 1])), 4294967295) % 10000 as bucket
  from (select word from dw union select word from iw), remainders
), s as (select bucket, sum(c)::double as n from dw join hashed using (word) group by bucket),
t as (select bucket, sum(c)::double as n from iw join hashed using (word) group by bucket),
sizes as (select (select coalesce(sum(n), 0) from s) + 10000 as s_all, (select coalesce(sum(n), 0) from t) + 10000 as t_all),
gains as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * s_all / ((s.n + 1) * t_all)))::bigint as gain
  from s left join t using (bucket), sizes
), weights as (select doc_id, sum(c)::bigint as n_features, sum(c * gain)::bigint as weight from dw join hashed using (word) join gains using (bucket) group by doc_id),
scored as (
  select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score, len(w) >= 20 as eligible
  from d left join weights on weights.doc_id = d.doc_id
), ranked as (select *, row_number() over (partition by eligible order by score desc, doc_id) as r, count(*) over (partition by eligible) as n from scored)
select doc_id, n_features, weight, score, case when eligible and r <= floor(10 * n / 100) then r end as rank from ranked
"""


@query("op13_importance_resampling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
