"""Queries over joins of entities, rankings, deletions and windows, each beside its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marlspike.filterlang import compile_filter
from marlspike.functions import text as tx
from marlspike.operators import feed, joins, reviews, vectors
from marlspike.operators.ordered import rank_in
from marlspike.plans.core import _CH, _LEVEL, _STATS, _changes, _stats, micros, query
from marlspike.session import latest, load, small


def _tracker(spark, d, api: str, *cols: str) -> DataFrame:
    rows = load(spark, d, "tracker_event").filter(F.col("api") == api)
    return latest(rows, ["project", "issue", "id"], ["mod_time"], list(cols) or ["mod_time"])


_TRACKER = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, issue, id ORDER BY mod_time DESC) r FROM tracker_event WHERE api = '{}') WHERE r = 1)"


# ---- entities with what belongs to them (JN)


@query(f"SELECT project, issue, i.id AS issue_id, c.id AS comment_id FROM {_TRACKER.format('/issues')} i LEFT JOIN {_TRACKER.format('/issues/comments')} c USING (project, issue)")
def issue_with_comments(spark, d):
    issues = _tracker(spark, d, "/issues").select("project", "issue", F.col("id").alias("issue_id"))
    comments = _tracker(spark, d, "/issues/comments").select("project", "issue", F.col("id").alias("comment_id"))
    return joins.with_children(issues, comments, ["project", "issue"])


@query(f"""SELECT instance, project, number, status, k::INT AS place, m.author AS author FROM (SELECT instance, project, number, status FROM {_CH}) LEFT JOIN
(SELECT instance, project, number, unnest(messages) AS m, generate_subscripts(messages, 1) - 1 AS k FROM {_CH}) USING (instance, project, number)""")
def change_with_comments(spark, d):
    c = _changes(spark, d, "instance", "status", "messages")
    said = c.select("instance", "project", "number", F.posexplode("messages").alias("place", "_m")).select("instance", "project", "number", "place", F.col("_m.author").alias("author"))
    return joins.with_children(c.drop("messages"), said, ["instance", "project", "number"])


_CANDIDATES = ["halyard/sextant", "quern/loom", "sorrel/trellis", "varnish/sluice"]


@query(f"""SELECT number, arg_min(p, k) AS project FROM (SELECT DISTINCT number FROM change_info) n LEFT JOIN (SELECT DISTINCT number AS m, project AS p, list_position({_CANDIDATES!r}, project) AS k FROM change_info WHERE project IN ({', '.join(repr(c) for c in _CANDIDATES)})) ON m = number GROUP BY number""")
def change_candidate_project(spark, d):
    c = load(spark, d, "change_info").select("number", "project")
    return joins.first_candidate(c, c, "number", "project", _CANDIDATES)


@query(f"""SELECT c.project, c.number, coalesce(a.login, 'unknown') AS login, coalesce(a.kind, 'unknown') AS kind FROM {_CH} c LEFT JOIN
(SELECT e, x.login AS login, x.kind AS kind FROM (SELECT lower(email) AS e, min({{'login': login, 'kind': kind}}) AS x FROM account WHERE email IS NOT NULL GROUP BY 1)) a ON lower(c.owner_email) = a.e""")
def change_author(spark, d):
    accounts = load(spark, d, "account").select("email", "login", "kind")
    return joins.with_account(_changes(spark, d, "owner_email"), accounts, "owner_email", ["login", "kind"]).select("project", "number", "login", "kind")


_ISSUE = r"'^.*/([^/]+/[^/]+)/issues/(\d+)(?:[#?].*)?$'"


@query(f"""SELECT doc_id, regexp_extract(url, {_ISSUE}, 1) AS project, regexp_extract(url, {_ISSUE}, 2)::BIGINT AS number, coalesce(s.state, 'unknown') AS state FROM documents LEFT JOIN
(SELECT project AS p, issue AS i, arg_max(event, id) AS state FROM issue_event WHERE event IN ('closed', 'reopened') GROUP BY 1, 2) s ON s.p = regexp_extract(url, {_ISSUE}, 1) AND s.i = try_cast(regexp_extract(url, {_ISSUE}, 2) AS BIGINT) WHERE regexp_matches(url, {_ISSUE})""")
def doc_issue_state(spark, d):
    """Documents that are issues, with the last event that closed or reopened them."""
    refs = load(spark, d, "documents").select("doc_id", tx.issue_ref(F.col("url")).alias("r")).filter("r IS NOT NULL").select("doc_id", "r.*")
    e = load(spark, d, "issue_event").filter("event IN ('closed', 'reopened')").groupBy("project", F.col("issue").alias("number")).agg(F.max_by("event", "id").alias("state"))
    return joins.with_children(refs, e, ["project", "number"]).withColumn("state", F.coalesce("state", F.lit("unknown")))


@query("SELECT project, number FROM (SELECT DISTINCT project, number, lower(author.login) AS l FROM discussion) WHERE project IN (SELECT project FROM project_site WHERE time_zone LIKE 'America/%') AND l IN (SELECT lower(login) FROM account WHERE kind = 'member')")
def discussions_of_members(spark, d):
    """Semi-joins: enabled projects, and authors of a kind."""
    rows = load(spark, d, "discussion").select("project", "number", F.lower("author.login").alias("l")).distinct()
    sites = small(load(spark, d, "project_site").filter("time_zone LIKE 'America/%'").select("project"), 10_000)
    members = load(spark, d, "account").filter("kind = 'member'").select(F.lower("login").alias("l"))
    return rows.join(sites, "project", "left_semi").join(members, "l", "left_semi").select("project", "number")


# ---- feeds (TM, OR-6)


@query("SELECT project, number, mod_time FROM (SELECT *, row_number() OVER (PARTITION BY project, number ORDER BY mod_time DESC) r FROM discussion) WHERE r = 1 AND NOT coalesce(locked, false)")
def timed_delete(spark, d):
    """Locked discussions are deleted by entries appended to the feed."""
    rows = load(spark, d, "discussion").select("project", "number", "mod_time", "locked")
    current = latest(rows, ["project", "number"], ["mod_time"])
    gone = joins.delete_entries(current, rows.columns, ["project", "number"], F.col("locked"), "mod_time", 1 << 62, "deleted")
    return joins.timed_view(rows.withColumn("deleted", F.lit(False)).unionByName(gone), ["project", "number"], ["mod_time", "deleted"], "deleted").select("project", "number", "mod_time")


@query("SELECT project, greatest(max(CASE WHEN event = 'labeled' THEN mod_time END), 1650000000000000000) AS at FROM issue_event WHERE project <> 'quern/loom' GROUP BY project HAVING max(CASE WHEN event = 'labeled' THEN mod_time END) IS NOT NULL")
def cursor_mark_old(spark, d):
    e = load(spark, d, "issue_event").filter("event = 'labeled'").groupBy("project").agg(F.max("mod_time").alias("at"))
    return joins.mark_old(e, e.select("project", F.lit(1650000000000000000).alias("at")), ["project"], "at", restart=F.col("project") == "quern/loom")


@query(f"""SELECT project, issue, max(id) AS id FROM {_TRACKER.format('/issues/comments')} c GROUP BY project, issue HAVING max(id) > coalesce((SELECT max(id) FROM tracker_event o WHERE o.api = '/issues/comments' AND o.mod_time < 1640000000000000000 AND o.project = c.project AND o.issue = c.issue), -1)""")
def newest_comment_once(spark, d):
    """Issues whose newest comment wasn't seen before a time."""
    c = load(spark, d, "tracker_event").filter("api = '/issues/comments'").select("project", "issue", "id", "mod_time")
    return joins.newest_comment(c, ["project", "issue"], "id", c.filter("mod_time < 1640000000000000000"))


@query("SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-11 18:00:00' AND lower(event_type) = 'error'")
def log_between(spark, d):
    e = load(spark, d, "events")
    window = joins.time_window(dt.timedelta(hours=36), dt.datetime(2024, 1, 11, 18), dt.datetime(2024, 2, 1))
    return joins.between(e, "ts", window, compile_filter("event_type = error", e.schema)[0]).select("event_id", "event_type")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS completed, count(*) FILTER (WHERE event_type = 'view') AS skipped, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'view')) AS errors FROM events GROUP BY user_id")
def run_report(spark, d):
    return joins.run_report(load(spark, d, "events"), ["user_id"], F.col("event_type") == "purchase", F.col("event_type") == "view")


# ---- reviews (AG, OR, RV)

_NEED = "(CASE WHEN coalesce(unresolved_comment_count, 0) > 0 THEN 1 ELSE 0 END | CASE WHEN len(list_filter(coalesce(labels['Code-Review'], []), lambda x: x.value >= 2)) = 0 THEN 2 ELSE 0 END | CASE WHEN list_contains(coalesce(hashtags, []), 'backport') THEN 4 ELSE 0 END)"


def _voted():
    return F.coalesce(F.exists(F.col("labels")["Code-Review"], lambda x: F.coalesce(x["value"] >= 2, F.lit(False))), F.lit(False))


@query(f"SELECT project, number, {_NEED} AS needs FROM {_CH}")
def change_needs(spark, d):
    c = _changes(spark, d, "unresolved_comment_count", "labels", "hashtags")
    flags = [(1, F.col("unresolved_comment_count") > 0), (2, ~_voted()), (4, F.array_contains("hashtags", "backport"))]
    return c.select("project", "number", joins.needs(flags).alias("needs"))


@query(f"""SELECT project, number, row_number() OVER (ORDER BY coalesce(total_comment_count, 0) DESC, created DESC NULLS LAST, number, project) AS place FROM {_CH}""")
def change_ranking(spark, d):
    """Changes by comments and age, then number; places come from a range sort."""
    c = _changes(spark, d, "total_comment_count", "created")
    c = c.select("project", "number", (-F.coalesce("total_comment_count", F.lit(0))).alias("a"), F.coalesce(-micros("created"), F.lit(1 << 62)).alias("b"))
    return rank_in(c, [], ["a", "b", "number", "project"], "place").select("project", "number", "place")


@query(f"""SELECT project, number, CASE WHEN level = 'maintainer' THEN 3 WHEN level = 'reviewer' THEN 2 ELSE 1 END + CASE WHEN coalesce(unresolved_comment_count, 0) > 0 THEN -1 ELSE 0 END AS total
FROM {_CH} c LEFT JOIN (SELECT email, {_LEVEL} AS level FROM ({_STATS})) s ON s.email = c.owner_email WHERE status = 'NEW' AND NOT coalesce(work_in_progress, false)""")
def change_review_scores(spark, d):
    """Two passes in one plan: what is known of all accounts, then rejects and scores of open changes."""
    levels = _stats(spark, d).select(F.col("email").alias("owner_email"), reviews.authority().alias("level"))
    c = _changes(spark, d, "status", "owner_email", "work_in_progress", "unresolved_comment_count").filter("status = 'NEW'").join(levels, "owner_email", "left")
    level = lambda *x: F.coalesce(F.col("level").isin(*x), F.lit(False))
    rules = [("maintainer", 3, level("maintainer")), ("reviewer", 2, level("reviewer")), ("other", 1, ~level("maintainer", "reviewer")), ("open", -1, F.col("unresolved_comment_count") > 0)]
    return reviews.score(c, rules, [("draft", F.col("work_in_progress"))]).select("project", "number", F.col("total").cast("int").alias("total"))


@query(f"SELECT category, count(*) AS n FROM (SELECT CASE WHEN coalesce(unresolved_comment_count, 0) > 0 THEN 'unresolved' WHEN created >= TIMESTAMP '2023-01-01' THEN 'recent' ELSE 'Remainder' END AS category FROM {_CH} WHERE lower(project) = 'quern/loom') GROUP BY category")
def review_dashboard(spark, d):
    """A user's filter, then the first category that fits; both are texts of the filter language."""
    c = _changes(spark, d, "unresolved_comment_count", "created")
    mine = compile_filter('project = "quern/loom"', c.schema)[0]
    cats = [(n, compile_filter(f, c.schema)[0]) for n, f in [("unresolved", "unresolved_comment_count > 0"), ("recent", 'created >= "2023-01-01"')]]
    return c.filter(mine).groupBy(reviews.categorize(cats).alias("category")).agg(F.count(F.lit(1)).alias("n"))


# ---- searches (VS)

_QUOTED = "list_concat(list_transform(range(1, least(strlen({0}), 122) + 1), lambda i: ascii(substr({0}, i, 1))::FLOAT / 256), [-1::FLOAT])"


@query(f"""WITH s AS (SELECT doc_id, t, list_resize({_QUOTED.format('t')}, 123, 0::FLOAT)::DOUBLE[] AS v FROM (SELECT doc_id, title AS t FROM documents WHERE regexp_matches(title, '^[ -~]+$'))),
n AS (SELECT doc_id, t, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM s), a AS (SELECT * FROM n WHERE doc_id % 20 = 0)
SELECT a.doc_id AS query, round(list_dot_product(a.v, n.v), 3) AS score FROM a, n QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY list_dot_product(a.v, n.v) DESC) <= 3""")
def vec_id_or_text(spark, d):
    """Scores of the three titles nearest to each question: the id of a document with an odd twentieth, else its title."""
    titles = load(spark, d, "documents").filter(F.col("title").rlike("^[ -~]+$")).select(F.col("doc_id").alias("id"), "title")
    store = titles.select("id", vectors.quote_embed(F.col("title")).alias("vec"))
    asked = titles.filter("id % 20 = 0").select(F.col("id").alias("query"), F.when(F.col("id") % 40 == 20, F.col("id").cast("string")).otherwise(F.col("title")).alias("q"))
    known = vectors.resolve_queries(asked, store, vectors.quote_embed).select(F.col("query").alias("id"), "vec")
    return vectors.batch_top_k(store, known, 3, 123).select("query", F.round("score", 3).alias("score"))


@query("SELECT doc_id, true AS absolute FROM documents WHERE starts_with(url, 'https://') UNION ALL SELECT doc_id, false FROM documents WHERE url IS NULL")
def url_absolute(spark, d):
    return load(spark, d, "documents").select("doc_id", vectors.is_url(F.col("url")).alias("absolute"))


_FINE = "len(vec) = 64 AND list_aggregate(list_transform(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x)), 'bool_or') = false"


@query("SELECT id, mod_time FROM (SELECT id, mod_time, vec, row_number() OVER (PARTITION BY id ORDER BY mod_time DESC) r FROM doc_vector) WHERE r = 1 AND len(vec) = 64")
def vec_batch_ops(spark, d):
    """A batch of stored vectors applied in order; one of another length deletes its id."""
    v = load(spark, d, "doc_vector").select("id", "mod_time", (F.coalesce(F.size("vec"), F.lit(-1)) != 64).alias("gone"))
    return feed.apply_ops(v.withColumn("at", F.col("mod_time")), "id", ["mod_time"], F.col("gone"), "at").withColumnRenamed("at", "mod_time")


@query(f"SELECT id, mod_time, CASE WHEN sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) <= 1e-10 THEN 0.0 ELSE 1.0 END AS norm FROM doc_vector WHERE {_FINE}")
def vec_normalize(spark, d):
    v = load(spark, d, "doc_vector").filter(F.size("vec") == 64)
    v = v.filter(F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    unit = v.select("id", "mod_time", vectors.normalize(F.col("vec")).alias("u"))
    return unit.select("id", "mod_time", F.round(F.sqrt(vectors.dot(F.col("u"), F.col("u"))), 4).alias("norm"))


# ---- stored fields (AG-8, ST-15, CL-13)


@query(f"SELECT project, number, coalesce(total_comment_count, 0) AS total, coalesce(unresolved_comment_count, 0) AS unresolved FROM {_CH}")
def change_comment_counts(spark, d):
    c = _changes(spark, d, "total_comment_count", "unresolved_comment_count")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return c.select("project", "number", zero("total_comment_count").alias("total"), zero("unresolved_comment_count").alias("unresolved"))


@query("SELECT project, id, mod_time, label IS NOT NULL AS labelled, coalesce(label.name, '') AS name FROM issue_event")
def json_roundtrip(spark, d):
    """Labels encoded as JSON, stored and decoded again."""
    e = load(spark, d, "issue_event").select("project", "id", "mod_time", F.to_json("label").alias("j"))
    back = F.from_json("j", "name string, description string, color string")
    return e.select("project", "id", "mod_time", F.col("j").isNotNull().alias("labelled"), F.coalesce(back["name"], F.lit("")).alias("name"))


@query("SELECT category, count(*) AS n FROM (SELECT trim(unnest(string_split(array_to_string(hashtags, ', '), ','))) AS category FROM change_info) WHERE category <> '' GROUP BY 1")
def stored_categories(spark, d):
    """Categories stored as one text with commas."""
    c = load(spark, d, "change_info").select(F.array_join("hashtags", ", ").alias("stored"))
    return c.select(F.explode(F.transform(F.split("stored", ","), lambda x: F.trim(x))).alias("category")).filter("category <> ''").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
