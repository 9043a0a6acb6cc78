"""Queries of the language-model problems and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval
from ..sources.tables import table
from . import leakage, neighbours, reading, survivors, tokenizer


def _p9(**how):
    return lambda s, d: leakage.leaks(table(s, d, "documents").select("doc_id", "text"), table(s, d, "eval_items").select("item_id", "text"), **how)


def _p1(f):
    cols = ["review_id", "parent_asin", "user_id", "event_ts", "rating", "text", "helpful_vote", "kafka_partition", "kafka_offset"]
    return lambda s, d: f(table(s, d, "review_collisions").select(*cols))


def _p10(f):
    return lambda s, d: f(table(s, d, "documents").select("doc_id", "text", "lang"), table(s, d, "reading_labels"))


def _p2_near(s, d):
    df = table(s, d, "review_embeddings").select("review_id", "vector", "embedding_spec_hash", "embedded_at")
    return neighbours.neighbours(df, 5, "review_id", "vector", 384, "embedding_spec_hash", "embedded_at")


def _p2_search(s, d):
    df = table(s, d, "embeddings")
    near = neighbours.neighbours(df, 10, "vec_id", "embedding", 64, queries="vec_id % 50 = 0")
    return near.select(F.col("id").cast("bigint").alias("vec_id"), F.col("neighbour").cast("bigint").alias("neighbour"), F.round("cosine", 4).alias("cosine"))


def _p2_recall(s, d):
    """Recall of an index of many small lists against exact search, for vectors whose hashed id divides by 5."""
    df = table(s, d, "review_embeddings").select("review_id", "vector", "embedding_spec_hash", "embedded_at")
    asked = "conv(substr(md5(review_id), 1, 4), 16, 10) % 5 = 0"
    near = neighbours.neighbours(df, 5, "review_id", "vector", 384, "embedding_spec_hash", "embedded_at", asked, neighbours.Shape(size=40, fan=4, group=256))
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    usable = df.where((F.size("vector") == 384) & (size > 0) & ~F.isnan(size)).groupBy("embedding_spec_hash", "review_id").agg(F.max(F.struct("embedded_at", "vector")).alias("m"))
    named = usable.select("embedding_spec_hash", F.concat_ws("|", "embedding_spec_hash", "review_id").alias("id"), "review_id", F.col("m.vector").alias("v"))
    exact = None
    for spec in [r[0] for r in named.select("embedding_spec_hash").distinct().collect()]:
        own = named.where(F.col("embedding_spec_hash") == spec)
        one = retrieval.cosine_knn(own.select("id", "v"), own.where(asked).select(F.col("id").alias("query_id"), F.col("v").alias("q")), 5, "id")
        exact = one if exact is None else exact.unionByName(one)
    found = near.select(F.concat_ws("|", "spec", "id").alias("query_id"), F.concat_ws("|", "spec", "neighbour").alias("id"), F.lit(1).alias("hit"))
    j = exact.join(found, ["query_id", "id"], "left")
    return j.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("recall_of_90_percent"))


QUERIES = {
    "p1_found": _p1(survivors.stated_best),
    "p1_merged": _p1(survivors.representatives),
    "p1_sources": _p1(survivors.source_qualities),
    "p2_found": lambda s, d: neighbours.mutual(_p2_near(s, d), 0.8).select(F.col("a").alias("review_id_a"), F.col("b").alias("review_id_b")),
    "p2_neighbours": lambda s, d: _p2_near(s, d).withColumn("cosine", F.round("cosine", 4)),
    "p2_search": _p2_search,
    "p2_recall": _p2_recall,
    "p8_ids": lambda s, d: tokenizer.encode_table(table(s, d, "documents"), "doc_id", "text"),
    "p8_pieces": lambda s, d: tokenizer.piece_census(table(s, d, "documents"), "doc_id", "text"),
    "p9_found": lambda s, d: _p9()(s, d).select("doc_id", "item_id"),
    "p9_report": _p9(coverage=leakage.COVERAGE),
    "p10_found": _p10(reading.demanding),
    "p10_levels": _p10(lambda d, l: reading.levels(d, l).select("doc_id", "level", "english")),
}

ORACLE: dict[str, str] = {
    "p2_found": """with v as (
  select distinct review_id, embedding_spec_hash spec, vector from review_embeddings
  where len(vector) = 384 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 and list_sum(list_transform(vector, lambda x: x * x)) > 0),
s as (
  select a.spec, a.review_id i, b.review_id j, list_cosine_similarity(a.vector, b.vector) c
  from v a join v b on a.spec = b.spec and a.review_id <> b.review_id),
t as (select * from s qualify row_number() over (partition by spec, i order by c desc, j) <= 5)
select distinct x.i review_id_a, x.j review_id_b from t x join t y on x.spec = y.spec and x.i = y.j and x.j = y.i
where x.i < x.j and x.c >= 0.8""",
    "p2_recall": """with v as (
  select distinct embedding_spec_hash spec, review_id from review_embeddings
  where len(vector) = 384 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0 and list_sum(list_transform(vector, lambda x: x * x)) > 0),
q as (select *, least(5, count(*) over (partition by spec) - 1) n from v)
select count(*) filter (where n > 0) queries, sum(n)::bigint neighbours, true recall_of_90_percent from q where ('0x' || substr(md5(review_id), 1, 4))::int % 5 = 0""",
    "p2_search": """with s as (
  select a.vec_id, b.vec_id neighbour, list_cosine_similarity(a.embedding, b.embedding) c
  from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select vec_id, neighbour, round(c, 4)::double as cosine from s qualify row_number() over (partition by vec_id order by c desc, neighbour) <= 10""",
    "p1_found": """with m as (
  select distinct kafka_partition, kafka_offset, nullif(lower(regexp_replace(review_id, '^\\s+|\\s+$', '', 'g')), '') id,
    (trim(user_id), trim(parent_asin), event_ts) place, rating,
    case when helpful_vote >= 0 then helpful_vote else -1 end votes,
    coalesce(length(regexp_replace(text, '^[\\s\u00a0\u2000-\u200a\u3000]+|[\\s\u00a0\u2000-\u200a\u3000]+$', '', 'g')), 0) size
  from review_collisions),
n as (select place, min(id) named from m where id is not null group by 1),
g as (select m.*, coalesce(id, named, place::varchar) grp from m left join n using (place)),
r as (
  select *, count(*) over w messages, min(rating) over w low, max(rating) over w high,
    row_number() over (partition by grp order by votes desc, size desc, kafka_offset, kafka_partition) rn
  from g window w as (partition by grp))
select kafka_partition, kafka_offset from r where rn = 1 and messages >= 2 and low is not distinct from high""",
}
