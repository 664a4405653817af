"""One query per operator over the driver's tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereolith.llm import decontaminate, html_text, jaccard_join, language_id, license_scan, lm_score, merkle, packing, ranked_search, substring_dedup, topk_search, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(toxicity.label_rows(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op2_decontaminate"] = r"""
with words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
shingles as (
  select distinct kind, id, array_to_string(w[k : k + 4], ' ') as s
  from (select kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from words where len(w) > 0)),
size as (select id as item_id, count(*) as item_shingles from shingles where kind = 'i' group by 1),
met as (
  select d.id as doc_id, i.id as item_id, count(*) as shared
  from shingles d join shingles i on d.s = i.s and d.kind = 'd' and i.kind = 'i' group by 1, 2)
select doc_id, item_id, shared, item_shingles, cast(shared as double) / item_shingles as containment
from met join size using (item_id) where 100 * shared >= 80 * item_shingles
""".replace("\\\\", "\\")


@query
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round(F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")), 6).alias("mean_score"))


SQL["op3_lm_score"] = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select r, w[k] as c, case when k > 1 then w[k - 1] end as b, case when k > 2 then w[k - 2] end as a from (select r, w, unnest(range(1, len(w) + 1)) as k from d)),
one as (select c as word, count(*) as n from p group by 1),
two as (select b, c, count(*) as n from p where b is not null group by 1, 2),
three as (select a, b, c, count(*) as n from p where a is not null group by 1, 2, 3),
n as (select count(*) as n from p),
s as (
  select p.r, case when three.n >= 1 then ln(cast(three.n as double) / before.n)
    when two.n >= 1 then case when p.a is not null then ln(0.4e0) else 0e0 end + ln(cast(two.n as double) / ctx.n)
    else case when p.a is not null then 2 * ln(0.4e0) when p.b is not null then ln(0.4e0) else 0e0 end + ln(cast(own.n as double) / n.n) end as s
  from p cross join n join one own on own.word = p.c left join two on two.b = p.b and two.c = p.c left join one ctx on ctx.word = p.b
  left join three on three.a = p.a and three.b = p.b and three.c = p.c left join two before on before.b = p.a and before.c = p.b),
t as (select r, sum(s) as score from s group by 1)
select doc_id, cast(len(w) as bigint) as n_words, round(coalesce(score, 0), 4) as score, case when len(w) > 0 then round(score / len(w), 6) end as mean_score
from d left join t using (r)
""".replace("\\\\", "\\")


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.assign(packing.pieces(table(spark, sf_dir, "documents"), word_bpe(), with_ids=False))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "response.refers_to")


SQL["op5_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as hex, min(page_id) over (partition by b) as first from p),
bits as (
  select page_id, payload_bytes, first,
    list_reduce(list_transform(range(1, 11), lambda i: lpad(bin(cast('0x' || substr(hex, 4 * i - 3, 4) as integer)), 16, '0')), lambda a, c: a || c) as b from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: cast(substr(b, 5 * i + j, 1) as integer) * cast(power(2, 5 - j) as integer)))::integer, 1)), lambda a, c: a || c) as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from bits
"""


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL["op6_license_scan"] = license_scan.oracle()


@query
def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


SQL["op7_topk_search"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(language_id.train_rows_of(docs))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedupe(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op11_substring_dedup"] = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select r, unnest(range(1, len(w) - 33)) as k from d where len(w) >= 35),
s as (select r, k, sha256(array_to_string(w[k : k + 34], ' ')) as h from p join d using (r)),
many as (select r, k from s where h in (select h from s group by h having count(*) > 1)),
gone as (select distinct r, unnest(range(k, k + 35)) as k from many),
g as (select r, list(k order by k) as ks from gone group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(ks), 0) as bigint) as n_removed,
  sha256(array_to_string(case when ks is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(ks, i)), lambda i: w[i]) end, ' ')) as kept_sha256
from d left join g using (r)
"""


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


SQL["op12_merkle"] = merkle.oracle()


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_ranked_search"] = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
i as (select row_number() over () as i, item_id, t from (select distinct item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from benchmark)),
g as (select cast(count(*) filter (where len(t) > 0) as bigint) as N, cast(sum(len(t)) as bigint) as L from d),
m as (select r, 75 + (25 * cast(len(t) as bigint) * N) // L as m from d cross join g where len(t) > 0),
tf as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) group by 1, 2),
w as (select term, cast(floor(1000 * ln(cast(2 * N + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf cross join g group by term, N),
q as (select i, term, count(*) as times from (select i, unnest(t) as term from i) group by 1, 2),
s as (select q.i, tf.r, cast(sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) as bigint) as score
  from q join w using (term) join tf using (term) join m using (r) group by 1, 2),
k as (select i, d.doc_id, score, row_number() over (partition by i order by score desc, d.doc_id nulls last) as rank from s join d using (r) where score > 0)
select item_id, cast(rank as integer) as rank, k.doc_id, score from k join i using (i) where rank <= 20
"""
