"""Queries over the operators of feeds, documents, vectors, filters, reviews and texts, each beside its SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.filterlang import compile_filter, filter_rows
from marlspike.functions import text as tx
from marlspike.operators import docs as dp
from marlspike.operators import feed, joins, reviews, vectors
from marlspike.operators.ordered import running_sum
from marlspike.session import latest, load, small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def micros(c: str):
    """A zoneless time as microseconds, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


# ---- keyed tables (ST)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def kv_point_get(spark, d):
    return feed.point_get(load(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 2000")
def kv_range_scan(spark, d):
    return feed.range_scan(load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", 100, 2000)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 500 ORDER BY o_orderkey LIMIT 100")
def kv_view_limit(spark, d):
    return feed.range_scan(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 500, limit=100)


@query("""SELECT user_id, event_type AS val FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def kv_batch_last_op(spark, d):
    ops = load(spark, d, "events")
    return feed.apply_ops(ops, "user_id", ["ts", "event_id"], F.col("event_type") == "error", "event_type").withColumnRenamed("event_type", "val")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderkey BETWEEN 1000 AND 5000) GROUP BY 1")
def kv_delete_range(spark, d):
    return feed.delete_range(load(spark, d, "orders"), "o_orderkey", 1000, 5000).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 NOT IN (0, 1) AND NOT (o_orderkey BETWEEN 500 AND 900)
UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 10 = 0""")
def overlay_read(spark, d):
    base = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    over = base.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    points = base.filter("o_orderkey % 10 = 1")
    ranges = spark.createDataFrame([(500, 900)], "lo bigint, hi bigint")
    return feed.overlay_read(base, over, "o_orderkey", points, ranges)


@query("""WITH a AS (SELECT o_orderkey k, o_totalprice p FROM orders), b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END p FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey + 10000000, o_totalprice FROM orders WHERE o_orderkey % 13 = 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'delete' ELSE 'set' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE b.k IS NULL OR a.k IS NULL OR a.p IS DISTINCT FROM b.p""")
def snapshot_diff(spark, d):
    a = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    b = a.filter("k % 7 <> 0").withColumn("p", F.when(F.col("k") % 11 == 0, F.col("p") + 1).otherwise(F.col("p")))
    return feed.snapshot_diff(a, b.unionByName(a.filter("k % 13 = 0").withColumn("k", F.col("k") + 10000000)), "k", ["p"])


@query("""SELECT vec_id, 'set' AS change FROM embeddings WHERE vec_id % 9 = 0 AND embedding IS DISTINCT FROM list_reverse(embedding)""")
def vector_snapshot_diff(spark, d):
    a = load(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    return feed.snapshot_diff(a, b, "vec_id", ["embedding"])


@query("""WITH gone AS (SELECT DISTINCT url FROM documents WHERE starts_with(url, 'https://forge.example/quern/'))
SELECT 'document' AS what, doc_id::VARCHAR AS id FROM documents WHERE url IS NULL OR NOT starts_with(url, 'https://forge.example/quern/')
UNION ALL SELECT 'vector', id FROM doc_vector v WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.url = v.id)""")
def cascade_delete(spark, d):
    docs, vecs = joins.cascade_delete(load(spark, d, "documents").select("doc_id", "url"), load(spark, d, "doc_vector").select("id"), "url", "id", "https://forge.example/quern/")
    return docs.select(F.lit("document").alias("what"), F.col("doc_id").cast("string").alias("id")).unionByName(vecs.select(F.lit("vector").alias("what"), "id"))


# ---- feeds (TM)


@query("SELECT project, number, meta_rev_id, status, mod_time FROM (SELECT *, row_number() OVER (PARTITION BY project, number ORDER BY mod_time DESC) r FROM change_info) WHERE r = 1")
def timed_latest(spark, d):
    return latest(load(spark, d, "change_info"), ["project", "number"], ["mod_time"], ["meta_rev_id", "status", "mod_time"])


@query("SELECT project, number, mod_time FROM (SELECT *, row_number() OVER (PARTITION BY project, number ORDER BY mod_time DESC) r FROM discussion) WHERE r = 1 AND mod_time > 1650000000000000000")
def timed_changes_since(spark, d):
    cur = latest(load(spark, d, "discussion"), ["project", "number"], ["mod_time"], ["mod_time"])
    return feed.changes_since(cur, 1650000000000000000)


@query("SELECT doc_id, text FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text, text AS was FROM documents) WHERE text IS DISTINCT FROM was OR doc_id % 7 = 0")
def corpus_upsert_changed(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    new = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return feed.changed_docs(docs.filter("doc_id % 7 <> 0"), new, "doc_id", ["text"])


@query("SELECT doc_id, url FROM documents WHERE starts_with(url, 'https://forge.example/quern/loom/issues/')")
def doc_prefix_scan(spark, d):
    return feed.prefix_scan(load(spark, d, "documents").select("doc_id", "url"), "url", "https://forge.example/quern/loom/issues/")


@query("SELECT project, max(mod_time) AS latest, count(*) AS entries FROM issue_event GROUP BY project")
def cursor_lag(spark, d):
    return load(spark, d, "issue_event").groupBy("project").agg(F.max("mod_time").alias("latest"), F.count(F.lit(1)).alias("entries"))


@query("SELECT project, number, meta_rev_id, min(mod_time) AS first_seen FROM change_info GROUP BY ALL")
def meta_rev_dedupe(spark, d):
    return load(spark, d, "change_info").groupBy("project", "number", "meta_rev_id").agg(F.min("mod_time").alias("first_seen"))


@query("SELECT project, issue, api, id, mod_time FROM tracker_event WHERE project = 'quern/loom' AND issue BETWEEN 2000 AND 2400 AND api = '/issues/comments'")
def event_reader(spark, d):
    t = load(spark, d, "tracker_event").filter("project = 'quern/loom' AND api = '/issues/comments'")
    return feed.range_scan(t, "issue", 2000, 2400).select("project", "issue", "api", "id", "mod_time")


@query("SELECT event_id, (SELECT min(v.event_id) FROM (SELECT arg_min(event_id, (ts, event_id)) AS event_id, ts FROM events GROUP BY ts) v WHERE v.ts = (SELECT min(ts) FROM events w WHERE w.ts > e.ts)) AS feed_time FROM events e WHERE event_type = 'error'")
def walltime_to_feedtime(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type", micros("ts").alias("wall"))
    asked = e.filter("event_type = 'error'").select(F.col("event_id").alias("q"), "wall")
    return feed.feed_time_after(e.select("wall", "event_id"), asked, "wall", "event_id", "wall").select(F.col("q").alias("event_id"), "feed_time")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) r FROM events) e
WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-03' AND s.user_id = e.user_id AND s.event_type = e.event_type)""")
def log_insert_absent(spark, d):
    e = load(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    stored = e.filter(F.col("ts") < F.lit(dt.datetime(2024, 1, 3)))
    return feed.insert_absent(stored, e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT name, CASE WHEN h.k IS NULL THEN 'create' WHEN coalesce(h.description, '') = '' AND coalesce(w.description, '') <> '' THEN 'describe' WHEN coalesce(h.description, '') <> coalesce(w.description, '') THEN 'warn' ELSE 'keep' END AS action
FROM (SELECT subject AS name, description FROM subject_area) w LEFT JOIN (SELECT lower(label.name) k, max(label.description) description FROM issue_event WHERE label.name IS NOT NULL GROUP BY 1) h ON lower(w.name) = h.k""")
def label_set_merge(spark, d):
    have = load(spark, d, "issue_event").filter("label.name IS NOT NULL").groupBy(F.lower("label.name").alias("name")).agg(F.max("label.description").alias("description"))
    return feed.label_merge(have, load(spark, d, "subject_area").select(F.col("subject").alias("name"), "description"))


# ---- documents (DP)


@query("""SELECT json_extract_string(j, '$.html_url') AS id, coalesce(json_extract_string(j, '$.title'), '') AS title, coalesce(json_extract_string(j, '$.body'), '') AS text
FROM (SELECT CASE WHEN json_valid(json) THEN json::JSON END AS j FROM tracker_event WHERE api = '/issues') WHERE json_extract_string(j, '$.html_url') IS NOT NULL""")
def issue_docs(spark, d):
    return dp.issue_docs(load(spark, d, "tracker_event"))


@query("SELECT url AS id, coalesce(title, '') AS title, coalesce(body, '') AS text FROM (SELECT *, row_number() OVER (PARTITION BY project, number ORDER BY mod_time DESC) r FROM discussion) WHERE r = 1 AND url IS NOT NULL")
def discussion_docs(spark, d):
    return dp.discussion_docs(latest(load(spark, d, "discussion"), ["project", "number"], ["mod_time"], ["url", "title", "body"]))


@query("""SELECT 'https://' || instance || '/c/' || project || '/+/' || number || '#related-content' AS id, coalesce(subject, '') AS title,
array_to_string(list_filter(list_concat([trim(coalesce(description, ''), ' ')], list_transform(list_sort(list_transform(coalesce(messages, []), lambda m, i: {'d': m.date, 'i': i, 'm': trim(m.message, ' ')}), 'ASC', 'NULLS FIRST'), lambda s: s.m)), lambda p: p <> ''), chr(10) || chr(10)) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY project, number ORDER BY mod_time DESC) r FROM change_info) WHERE r = 1 AND instance IS NOT NULL""")
def change_docs(spark, d):
    return dp.change_docs(latest(load(spark, d, "change_info").drop("labels", "attention_set"), ["project", "number"], ["mod_time"], ["instance", "subject", "description", "messages"]))


@query("SELECT discussion_url AS id, coalesce(body, '') AS text FROM (SELECT *, row_number() OVER (PARTITION BY discussion_url ORDER BY mod_time, url) r FROM discussion_comment WHERE discussion_url IS NOT NULL) WHERE r = 1")
def thread_first_message(spark, d):
    return dp.first_message_docs(load(spark, d, "discussion_comment"), "discussion_url", ["mod_time", "url"], "body")


@query("SELECT discussion_url, url, mod_time FROM (SELECT *, sum(length(coalesce(body, '')) + 2) OVER (PARTITION BY discussion_url ORDER BY mod_time, url ROWS UNBOUNDED PRECEDING) s FROM discussion_comment) WHERE s < 1000")
def thread_truncate(spark, d):
    c = load(spark, d, "discussion_comment").select("discussion_url", "url", "mod_time", "body")
    return feed.running_sum_keep(c, ["discussion_url"], ["mod_time", "url"], F.length(F.coalesce("body", F.lit(""))) + 2, 1000).drop("body")


@query("SELECT kind, count(*) AS docs FROM (SELECT DISTINCT id, kind FROM (SELECT url AS id, 'document' AS kind FROM documents WHERE url IS NOT NULL UNION ALL SELECT url, 'discussion' FROM discussion WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM documents WHERE url IS NOT NULL))) GROUP BY kind")
def corpus_union(spark, d):
    a = load(spark, d, "documents").filter("url IS NOT NULL").select(F.col("url").alias("id"), F.lit("document").alias("title"), "text")
    b = load(spark, d, "discussion").filter("url IS NOT NULL").select(F.col("url").alias("id"), F.lit("discussion").alias("title"), F.col("body").alias("text"))
    return dp.corpus(a, b).groupBy(F.col("title").alias("kind")).agg(F.count(F.lit(1)).alias("docs"))


# ---- vectors (VS)

_DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vec(spark, d, vec_id: int) -> list[float]:
    r = load(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(r[0]) if r else [0.0] * 64


@query(f"SELECT e.vec_id, round({_DOT}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_DOT} DESC, e.vec_id DESC LIMIT 10")
def vec_topk(spark, d):
    return vectors.top_k(load(spark, d, "embeddings"), _vec(spark, d, 0), 10, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query(f"SELECT label, vec_id, round(s, 6) AS score FROM (SELECT e.label, e.vec_id, {_DOT} s, row_number() OVER (PARTITION BY e.label ORDER BY {_DOT} DESC, e.vec_id DESC) r FROM embeddings e, embeddings q WHERE q.vec_id = 1) WHERE r <= 3")
def vec_topk_per_label(spark, d):
    q = F.array(*(F.lit(float(x)) for x in _vec(spark, d, 1)))
    s = load(spark, d, "embeddings").select("label", "vec_id", vectors.dot(F.col("embedding"), q).alias("s"))
    w = Window.partitionBy("label").orderBy(F.desc("s"), F.desc("vec_id"))
    return s.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("label", "vec_id", F.round("s", 6).alias("score"))


@query(f"SELECT vec_id, round(s, 6) AS score, label FROM (SELECT e.vec_id, e.label, {_DOT} s FROM embeddings e, embeddings q WHERE q.vec_id = 2 ORDER BY s DESC, e.vec_id DESC LIMIT 20) WHERE s >= 0.1 AND label NOT IN (1, 2)")
def vec_search_options(spark, d):
    hits = vectors.search(load(spark, d, "embeddings"), _vec(spark, d, 2), 20, 0.1, kind="label", deny=[1, 2], id_col="vec_id", vec="embedding")
    return hits.select("vec_id", F.round("score", 6).alias("score"), "label")


@query(f"""WITH h AS (SELECT e.vec_id, {_DOT} s FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY s DESC, e.vec_id DESC LIMIT 6), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id DESC) k FROM h)
SELECT vec_id, round(s, 6) AS score, coalesce(d.title, '') AS title FROM (SELECT * FROM r WHERE k > 1 OR vec_id <> 0 ORDER BY k LIMIT 5) x LEFT JOIN documents d ON d.doc_id = x.vec_id""")
def vec_related_drop_self(spark, d):
    hits = vectors.top_k(load(spark, d, "embeddings"), _vec(spark, d, 0), 6, "vec_id", "embedding")
    kept = vectors.drop_first_self(hits, 0, 5, "vec_id")
    return vectors.titled(kept, load(spark, d, "documents").withColumnRenamed("doc_id", "vec_id"), "vec_id").select("vec_id", F.round("score", 6).alias("score"), "title")


@query(f"SELECT q.vec_id AS query, e.vec_id AS id, round({_DOT}, 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, e.vec_id DESC) <= 5")
def vec_batch_topk(spark, d):
    e = load(spark, d, "embeddings")
    return vectors.batch_top_k(e, e.filter("vec_id % 20 = 0"), 5, 64, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query("SELECT id, mod_time, round(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 4) AS norm FROM doc_vector WHERE len(vec) = 64 AND list_aggregate(list_transform(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x)), 'bool_or') = false")
def vec_norms(spark, d):
    v = load(spark, d, "doc_vector").filter(F.size("vec") == 64)
    fine = v.filter(F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    return fine.select("id", "mod_time", F.round(F.sqrt(vectors.dot(F.col("vec"), F.col("vec"))), 4).alias("norm"))


@query("SELECT vec_id, true AS same FROM embeddings")
def vec_codec_roundtrip(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    return e.select("vec_id", (vectors.decode(vectors.encode(F.col("embedding"))) == F.col("embedding")).alias("same"))


@query("""WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT doc_id, 123 AS dims, coalesce(list_sum(list_transform(range(0, least(length(h) // 2, 122)), lambda i: (i + 1) * ('0x' || h[2 * i + 1 : 2 * i + 2])::INT)), 0)::BIGINT AS moment FROM b""")
def quote_embed(spark, d):
    """The size of each text's embedding and the first moment of the bytes it quotes, which hangs on every number and its place."""
    v = load(spark, d, "documents").select("doc_id", vectors.quote_embed(F.col("text")).alias("vec"))
    byte = F.transform("vec", lambda x, i: F.when(x > 0, F.round(x / -F.array_min("vec") * 256) * (i + 1)).otherwise(0.0).cast("bigint"))
    return v.select("doc_id", F.size("vec").alias("dims"), F.aggregate(byte, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("moment"))


# ---- addresses and texts (TX)

_HOST = "^https?://[^/]+"


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN url IS NULL OR NOT regexp_matches(url, '^https?://[^/\\s]+') THEN 'unknown' WHEN regexp_matches(url, '{_HOST}/[^/]+/[^/]+/issues/\\d+$') THEN 'issue' WHEN regexp_matches(url, '{_HOST}/[^/]+/[^/]+/issues/\\d+#') THEN 'comment' WHEN regexp_matches(url, '{_HOST}/[^/]+/[^/]+/discussions/\\d+') THEN 'discussion' WHEN regexp_matches(url, '/\\+/\\d+(#|$)') THEN 'change' WHEN regexp_matches(url, '/(g|group|groups)/') THEN 'conversation' WHEN contains(url, '/wiki/') THEN 'wiki' WHEN contains(url, '/blog/') THEN 'blog' WHEN regexp_matches(url, '/(releases|tag)/') THEN 'release' ELSE 'page' END AS kind FROM documents) GROUP BY kind""")
def kind_classify(spark, d):
    return load(spark, d, "documents").select(tx.doc_kind(F.col("url")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT discussion_url, regexp_replace(discussion_url, '[?#].*$', '') AS clean FROM discussion_comment WHERE discussion_url IS NOT NULL")
def url_clean(spark, d):
    return load(spark, d, "discussion_comment").filter("discussion_url IS NOT NULL").select("discussion_url", tx.clean_url(F.col("discussion_url")).alias("clean"))


@query("""SELECT url, CASE WHEN url = 'https://forge.example/quern/loom' OR regexp_matches(url, '^https://forge\\.example/quern/loom[/?#]') THEN false WHEN starts_with(url, 'https://forge.example/quern/') OR starts_with(url, 'https://forge.example/varnish/') THEN true ELSE false END AS allowed FROM documents WHERE url IS NOT NULL""")
def url_allow_deny(spark, d):
    rules = [("https://forge.example/quern/", True), ("https://forge.example/quern/loom", False), ("https://forge.example/varnish/", True), ("https://forge.example/var", False)]
    return tx.url_allowed(load(spark, d, "documents").filter("url IS NOT NULL").select("url"), rules)


@query("SELECT doc_id, regexp_extract(url, '^.*/([^/]+/[^/]+)/issues/(\\d+)(?:[#?].*)?$', 1) AS project, regexp_extract(url, '^.*/([^/]+/[^/]+)/issues/(\\d+)(?:[#?].*)?$', 2)::BIGINT AS number FROM documents WHERE regexp_matches(url, '^.*/([^/]+/[^/]+)/issues/(\\d+)(?:[#?].*)?$')")
def issue_refs(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.issue_ref(F.col("url")).alias("r")).filter("r IS NOT NULL").select("doc_id", "r.*")


@query("SELECT doc_id, regexp_replace(text, '<!--.*?-->', '', 'gs') AS text FROM documents WHERE contains(text, '<!--')")
def html_comment_strip(spark, d):
    t = load(spark, d, "documents").filter(F.contains("text", F.lit("<!--")))
    return t.select("doc_id", tx.strip_comments(F.col("text")).alias("text"))


@query("""SELECT doc_id, 'indexer' AS maker, '{"lang":"' || coalesce(lang, '') || '"}' AS meta, title AS body, 'before  after' AS rest FROM documents WHERE title IS NOT NULL""")
def tag_wrap_parse(spark, d):
    t = load(spark, d, "documents").filter("title IS NOT NULL")
    meta = F.concat(F.lit('{"lang":"'), F.coalesce("lang", F.lit("")), F.lit('"}'))
    w = t.select("doc_id", F.concat(F.lit("before "), tx.wrap(F.col("title"), "indexer", meta), F.lit(" after")).alias("w"))
    return w.select("doc_id", tx.unwrap(F.col("w")).alias("u"), tx.unwrap_all(F.col("w")).alias("rest")).select("doc_id", "u.*", "rest")


@query("SELECT doc_id, sha256('search' || chr(31) || 'm1' || chr(31) || title || chr(31) || text) AS key FROM documents WHERE title IS NOT NULL AND text IS NOT NULL")
def llm_cache_key(spark, d):
    t = load(spark, d, "documents").filter("title IS NOT NULL AND text IS NOT NULL")
    return t.select("doc_id", tx.cache_key("search", "m1", F.col("title"), F.col("text")).alias("key"))


@query("SELECT doc_id, list_transform(list_filter([{'n': 'fixes', 'h': regexp_matches(text, 'Fixes [a-z-]+/[a-z]+#\\d+')}, {'n': 'path', 'h': regexp_matches(text, '[a-z]+/[a-z]+\\.go')}, {'n': 'thanks', 'h': contains(text, 'Thanks')}], lambda x: x.h), lambda x: x.n) AS broken FROM documents WHERE text IS NOT NULL")
def rule_violations(spark, d):
    rules = [("fixes", r"Fixes [a-z-]+/[a-z]+#\d+"), ("path", r"[a-z]+/[a-z]+\.go"), ("thanks", "Thanks")]
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), n) for n, p in rules)))
    return load(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", hits.alias("broken"))


@query(r"SELECT project, count(*) AS docs, sum(len(regexp_extract_all(text, '[#-''*/;?@A-Z\[\]\^-}\\\x{a1}-\x{ffff}]+|[^\s]')))::BIGINT AS words FROM documents WHERE text IS NOT NULL GROUP BY project")
def word_counts(spark, d):
    t = load(spark, d, "documents").filter("text IS NOT NULL")
    return t.groupBy("project").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size(tx.split_words(F.col("text")))).alias("words"))


@query("SELECT doc_id, regexp_replace(url, '[?#].*$', '') AS link FROM documents WHERE regexp_matches(url, '^https?://')")
def page_links(spark, d):
    """The links of a page that names each document's address twice."""
    t = load(spark, d, "documents").filter(F.col("url").rlike("^https?://"))
    page = F.concat(F.lit('<p>See <a href="'), "url", F.lit('">it</a> and <a href="'), "url", F.lit('">again</a>, not <b>that</b>.</p>'))
    return t.select("doc_id", F.explode(tx.links(page, F.lit("https://forge.example/"))).alias("link")).select("doc_id", tx.clean_url(F.col("link")).alias("link")).distinct()


@query()
def html_sections(spark, d):
    t = load(spark, d, "documents").filter(F.contains("text", F.lit("<h")))
    return t.select("doc_id", "url", F.explode(tx.sections(F.col("text"))).alias("s")).select("doc_id", F.concat_ws("#", "url", "s.id").alias("id"), "s.title", "s.text")


@query()
def markdown_fixes(spark, d):
    rules = [("link", r"\b([a-z-]+/[a-z]+)#(\d+)\b", r"https://forge.example/\1/issues/\2"), ("text", r"\bThanks\b", "Thank you"), ("url", r"http://", "https://")]
    t = load(spark, d, "documents").select("doc_id", "text", tx.fixed(F.col("text"), rules).alias("new")).filter("new IS NOT NULL")
    return t.select("doc_id", tx.body_diff(F.col("text"), F.col("new")).alias("diff"))


# ---- reviews and reports (AG, RV, OR)

_CH = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, number ORDER BY mod_time DESC) r FROM change_info) WHERE r = 1)"


def _changes(spark, d, *cols: str) -> DataFrame:
    return latest(load(spark, d, "change_info"), ["project", "number"], ["mod_time"], list(cols))


_STATS = f"""WITH ch AS (SELECT c.*, CASE WHEN b.e IS NOT NULL THEN list_filter(revisions, lambda v: v.number = 1)[1].commit_author ELSE owner_email END AS owner FROM {_CH} c LEFT JOIN (SELECT DISTINCT lower(email) e FROM account WHERE kind = 'bot') b ON lower(owner_email) = b.e),
did AS (SELECT owner AS email, 1 AS c, 0 AS r, false AS s, false AS v FROM ch WHERE status = 'MERGED' UNION ALL SELECT submitter_email, 0, 0, true, false FROM ch
UNION ALL SELECT coalesce(m.real_author, m.author), 0, 1, false, false FROM (SELECT owner, unnest(messages) AS m FROM ch) WHERE coalesce(m.real_author, m.author) IS DISTINCT FROM owner
UNION ALL SELECT x.email, 0, 0, false, true FROM (SELECT unnest(labels['Code-Review']) AS x FROM ch) WHERE x.value >= 2)
SELECT email, sum(c)::BIGINT AS commits, sum(r)::BIGINT AS reviews, bool_or(s) AS can_submit, bool_or(v) AS can_vote FROM did WHERE email IS NOT NULL GROUP BY email"""
_LEVEL = "CASE WHEN can_submit OR can_vote THEN 'maintainer' WHEN reviews > 0 THEN 'reviewer' WHEN commits > 0 THEN 'contributor' ELSE 'unknown' END"


def _stats(spark, d) -> DataFrame:
    changes = _changes(spark, d, "status", "owner_email", "submitter_email", "messages", "revisions", "labels")
    return reviews.account_stats(changes, small(load(spark, d, "account").filter("kind = 'bot'").select("email"), 10_000))


@query(_STATS)
def account_stats(spark, d):
    return _stats(spark, d)


@query(f"SELECT level, count(*) AS accounts FROM (SELECT {_LEVEL} AS level FROM ({_STATS})) GROUP BY level")
def account_levels(spark, d):
    return _stats(spark, d).groupBy(reviews.authority().alias("level")).agg(F.count(F.lit(1)).alias("accounts"))


@query(f"SELECT project, number, array_to_string(list_sort(list_distinct(list_filter(list_transform(messages, lambda m: coalesce(m.real_author, m.author)), lambda x: x IS NOT NULL AND x IS DISTINCT FROM owner_email))), ',') AS reviewers FROM {_CH} WHERE messages IS NOT NULL")
def change_reviewers(spark, d):
    c = _changes(spark, d, "owner_email", "messages").filter("messages IS NOT NULL")
    return c.select("project", "number", F.array_join(reviews.reviewers(c), ",").alias("reviewers"))


@query(f"SELECT project, number, epoch_us(list_filter(messages, lambda m: starts_with(m.message, 'Abandoned'))[-1].date) AS abandoned_us, epoch_us(list_filter(revisions, lambda v: v.uploader = owner_email)[-1].created) AS owner_us FROM {_CH}")
def change_times(spark, d):
    c = _changes(spark, d, "owner_email", "messages", "revisions")
    c = c.select("project", "number", reviews.last_message_time("Abandoned").alias("a"), reviews.owner_update_time().alias("o"))
    return c.select("project", "number", micros("a").alias("abandoned_us"), micros("o").alias("owner_us"))


@query(f"""SELECT project, number, total, applied FROM (SELECT project, number, CASE WHEN coalesce(unresolved_comment_count, 0) > 0 THEN -1 ELSE 0 END + CASE WHEN coalesce(len(messages), 0) > 2 THEN 1 ELSE 0 END + CASE WHEN len(hashtags) > 0 THEN 2 ELSE 0 END AS total,
array_to_string(list_filter([CASE WHEN coalesce(unresolved_comment_count, 0) > 0 THEN 'open' END, CASE WHEN coalesce(len(messages), 0) > 2 THEN 'busy' END, CASE WHEN len(hashtags) > 0 THEN 'tagged' END], lambda x: x IS NOT NULL), ',') AS applied FROM {_CH} WHERE NOT coalesce(work_in_progress, false))""")
def change_score(spark, d):
    c = _changes(spark, d, "unresolved_comment_count", "messages", "hashtags", "work_in_progress")
    s = reviews.score(c, [("open", -1, F.col("unresolved_comment_count") > 0), ("busy", 1, F.size("messages") > 2), ("tagged", 2, F.size("hashtags") > 0)], [("draft", F.col("work_in_progress"))])
    return s.select("project", "number", F.col("total").cast("int").alias("total"), F.array_join("applied", ",").alias("applied"))


@query(f"SELECT category, count(*) AS n FROM (SELECT CASE WHEN lower(status) = 'merged' AND coalesce(total_comment_count, 0) > 5 AND total_comment_count IS NOT NULL THEN 'discussed' WHEN list_has_any(list_transform(coalesce(hashtags, []), lambda x: lower(x)), ['security', 'backport']) THEN 'tagged' WHEN lower(status) IN ('new', 'abandoned') THEN 'open' ELSE 'Remainder' END AS category FROM {_CH}) GROUP BY category")
def change_categories(spark, d):
    c = _changes(spark, d, "status", "total_comment_count", "hashtags")
    defs = [("discussed", "status = merged AND total_comment_count > 5"), ("tagged", "hashtags = security OR hashtags = backport"), ("open", "status = (new OR abandoned)")]
    cat = reviews.categorize([(n, compile_filter(f, c.schema)[0]) for n, f in defs])
    return c.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT discussion_url, count(*) AS total, count(*) FILTER (WHERE a.kind = 'bot') AS skipped, max(url) AS last_url FROM discussion_comment c LEFT JOIN (SELECT lower(login) l, max(kind) FILTER (WHERE kind = 'bot') kind FROM account WHERE login IS NOT NULL GROUP BY 1) a ON lower(c.author.login) = a.l GROUP BY discussion_url")
def overview_meta(spark, d):
    bots = small(load(spark, d, "account").filter("kind = 'bot' AND login IS NOT NULL").select(F.lower("login").alias("l"), F.lit(True).alias("bot")).distinct())
    c = load(spark, d, "discussion_comment").join(bots, F.lower("author.login") == F.col("l"), "left")
    return c.groupBy("discussion_url").agg(F.count(F.lit(1)).alias("total"), F.count_if("bot").alias("skipped"), F.max("url").alias("last_url"))


@query("SELECT discussion_url, count(*) FILTER (WHERE mod_time > 1650000000000000000) AS fresh, count(*) FILTER (WHERE mod_time <= 1650000000000000000) AS old FROM discussion_comment GROUP BY discussion_url")
def overview_old_new(spark, d):
    t = F.lit(1650000000000000000)
    return load(spark, d, "discussion_comment").groupBy("discussion_url").agg(F.count_if(F.col("mod_time") > t).alias("fresh"), F.count_if(F.col("mod_time") <= t).alias("old"))


@query("SELECT project, issue, id, CASE WHEN event = 'labeled' THEN '+' ELSE '-' END || label.name AS step, sum(CASE WHEN event = 'labeled' THEN 1 ELSE -1 END) OVER (PARTITION BY project, issue ORDER BY id, mod_time ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM issue_event WHERE event IN ('labeled', 'unlabeled') AND label.name <> ''")
def label_history(spark, d):
    e = load(spark, d, "issue_event").filter("event IN ('labeled', 'unlabeled') AND label.name <> ''")
    up = F.col("event") == "labeled"
    steps = e.select("project", "issue", "id", "mod_time", F.concat(F.when(up, "+").otherwise("-"), "label.name").alias("step"), F.when(up, 1).otherwise(-1).alias("by"))
    return running_sum(steps, ["project", "issue"], ["id", "mod_time"], F.col("by"), "running").drop("by", "mod_time")


@query("SELECT s.subject, count(*) AS labelled, count(*) FILTER (WHERE contains(lower(d.text), s.subject)) AS hits, round(100.0 * count(*) FILTER (WHERE contains(lower(d.text), s.subject)) / count(*), 3) AS percent FROM (SELECT DISTINCT doc_id, subject FROM subject_label WHERE subject IS NOT NULL) s JOIN documents d USING (doc_id) GROUP BY s.subject")
def label_eval_report(spark, d):
    s = load(spark, d, "subject_label").filter("subject IS NOT NULL").select("doc_id", "subject").distinct()
    hit = F.coalesce(F.contains(F.lower("text"), F.col("subject")), F.lit(False))
    g = load(spark, d, "documents").select("doc_id", "text").join(s, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("labelled"), F.count_if(hit).alias("hits"))
    return g.withColumn("percent", F.round(100.0 * F.col("hits") / F.col("labelled"), 3))


@query(f"SELECT c.project, c.number, d.title IS NOT NULL AS found FROM {_CH} c LEFT JOIN (SELECT DISTINCT url, min(title) AS title FROM documents GROUP BY url) d ON d.url = 'https://forge.example/' || c.project || '/+/' || c.number || '#related-content'")
def change_doc_lookup(spark, d):
    c = _changes(spark, d, "status")
    docs = load(spark, d, "documents").filter("url IS NOT NULL").groupBy("url").agg(F.min("title").alias("title"))
    key = F.concat(F.lit("https://forge.example/"), "project", F.lit("/+/"), F.col("number").cast("string"), F.lit("#related-content"))
    return c.withColumn("url", key).join(docs, "url", "left").select("project", "number", F.col("title").isNotNull().alias("found"))


# ---- the filter language (FL)

#: (name, table, filter, SQL condition)
FILTERS = [
    ("eq_ci", "orders", 'o_orderpriority = "1-urgent"', "lower(o_orderpriority) = '1-urgent'"),
    ("prefix", "customer", "c_mktsegment = auto*", "starts_with(lower(c_mktsegment), 'auto')"),
    ("suffix", "customer", 'c_name = "*1"', "ends_with(lower(c_name), '1')"),
    ("neq_missing", "documents", "lang != en", "NOT coalesce(lower(lang) = 'en', false)"),
    ("has_word", "documents", "title : text", r"regexp_matches(lower(title), '(^|[^a-z0-9\x80-\x{10ffff}])text($|[^a-z0-9\x80-\x{10ffff}])')"),
    ("regex", "part", 'p_name =~ "^[a-m].*e"', "regexp_matches(p_name, '^[a-m].*e')"),
    ("not_regex", "documents", 'source !~ "^i"', "source IS NOT NULL AND NOT regexp_matches(source, '^i')"),
    ("or_binds_tighter", "orders", "o_orderstatus = F o_custkey < 500 OR o_custkey > 900", "lower(o_orderstatus) = 'f' AND (o_custkey < 500 OR o_custkey > 900)"),
    ("and_binds_loosest", "orders", "o_orderstatus = F AND o_custkey < 500 OR o_custkey > 900 o_orderkey < 5000", "lower(o_orderstatus) = 'f' AND (o_custkey < 500 OR o_custkey > 900) AND o_orderkey < 5000"),
    ("negation", "orders", "NOT o_orderstatus = (F OR O) -o_orderkey > 30000", "NOT lower(o_orderstatus) IN ('f', 'o') AND NOT o_orderkey > 30000"),
    ("time_partial", "orders", 'o_orderdate >= "1995-06" AND o_orderdate < "Mar 1997"', "o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1997-03-01'"),
    ("numeric_base0", "orders", "o_custkey = 0x20 OR o_custkey = 010", "o_custkey IN (32, 8)"),
    ("float_compare", "lineitem", "l_discount >= 0.05 l_quantity < 10", "l_discount >= 0.05 AND l_quantity < 10"),
    ("presence", "issue_event", "commit_id:*", "coalesce(commit_id, '') <> ''"),
    ("empty_matches_missing", "issue_event", 'commit_id = ""', "coalesce(commit_id, '') = ''"),
    ("nested_member", "issue_event", "label.name = bug", "coalesce(lower(label.name) = 'bug', false)"),
    ("any_in_array", "issue_event", "assignees.login = limvingott", "len(list_filter(coalesce(assignees, []), lambda x: lower(x.login) = 'limvingott')) > 0"),
    ("and_per_leaf", "issue_event", "labels.name = (bug AND docs)", "len(list_filter(coalesce(labels, []), lambda x: lower(x.name) = 'bug')) > 0 AND len(list_filter(coalesce(labels, []), lambda x: lower(x.name) = 'docs')) > 0"),
    ("array_differs", "change_info", "hashtags != backport", "len(list_filter(coalesce(hashtags, []), lambda x: lower(x) <> 'backport' OR x IS NULL)) > 0"),
    ("map_has_key", "change_info", "labels:Code-Review", "coalesce(map_contains(labels, 'Code-Review'), false)"),
    ("bool_member", "change_info", "work_in_progress = true", "coalesce(work_in_progress, false)"),
    ("camel_case", "change_info", "totalCommentCount > 3", "coalesce(total_comment_count > 3, false)"),
    ("text_order", "customer", "c_name >= Customer#000000700 c_mktsegment < FURNITURE", "c_name >= 'Customer#000000700' AND c_mktsegment < 'FURNITURE'"),
    ("struct_has", "issue_event", "label : bug", "coalesce(lower(label.name) = 'bug' OR lower(label.description) = 'bug' OR lower(label.color) = 'bug' OR regexp_matches(lower(concat_ws(chr(10), label.name, label.description, label.color)), '(^|[^a-z0-9\\x80-\\x{10ffff}])bug($|[^a-z0-9\\x80-\\x{10ffff}])'), false)"),
    ("dotted_value", "project_site", "instance = review-quern.forge.example", "lower(instance) = 'review-quern.forge.example'"),
    ("struct_presence", "issue_event", "rename.to:*", 'coalesce("rename"."to", \'\') <> \'\''),
    ("deep_array_and_not", "change_info", "messages.author:* NOT hashtags = security", "len(list_filter(coalesce(messages, []), lambda x: coalesce(x.author, '') <> '')) > 0 AND NOT len(list_filter(coalesce(hashtags, []), lambda x: lower(x) = 'security')) > 0"),
    ("global_word", "project_site", "quern", "contains(lower(project), 'quern') OR contains(lower(instance), 'quern') OR contains(lower(time_zone), 'quern')"),
]
_KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "documents": ["doc_id"], "part": ["p_partkey"], "lineitem": ["l_orderkey", "l_linenumber"], "issue_event": ["project", "id", "mod_time"], "change_info": ["project", "number", "mod_time"], "project_site": ["project"]}


def _filter_query(table: str, text: str):
    return lambda spark, d: filter_rows(load(spark, d, table), text).select(*_KEYS[table])


for _name, _table, _text, _sql in FILTERS:
    QUERIES[f"filter_{_name}"] = _filter_query(_table, _text)
    ORACLE[f"filter_{_name}"] = f"SELECT {', '.join(_KEYS[_table])} FROM {_table} WHERE {_sql}"
