"""Queries over training text: problems 2, 3, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.timestamps import with_instant
from marlspike.llm import conversations as conv
from marlspike.llm import mixing
from marlspike.llm.leaks import leaks, reparameterised
from marlspike.llm.neighbors import nearest
from marlspike.llm.subjects import subjects
from marlspike.plans.found import zoned
from marlspike.session import cut, latest, load, small


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """login in lower case -> kind; where accounts that share a login are of several kinds, none can be told and there is no row."""
    accounts = load(spark, sf_dir, "account").filter("login IS NOT NULL").select(F.lower("login").alias("login"), F.lower(F.trim("kind")).alias("kind"))
    one = accounts.groupBy("login").agg(F.min("kind").alias("kind"), F.max("kind").alias("_max")).filter("kind = _max")
    return small(one.filter(F.col("kind").isin("bot", "maintainer")).select("login", "kind"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments that count, with project, discussion, id, parent, at (microseconds), login and role."""
    c = load(spark, sf_dir, "discussion_comment").withColumn("id", F.regexp_extract("url", r"(\d+)\D*$", 1).try_cast("bigint"))
    c = with_instant(c.filter("id IS NOT NULL"), "updated_at", "_up")
    c = latest(c, ["id"], ["_up", "mod_time"], ["discussion_url", "reply_to_url", "author", "created_at", "body"])
    c = c.filter(~conv.blank(F.col("body"))).select("id", conv.discussion_project(F.col("discussion_url")).alias("_p"), conv.discussion_number(F.col("discussion_url")).alias("discussion"), conv.reply_target(F.col("reply_to_url")).alias("parent"), F.lower("author.login").alias("login"), "created_at")
    d = latest(load(spark, sf_dir, "discussion").filter("number IS NOT NULL"), ["project", "number"], ["mod_time"], ["author"])
    d = d.select("project", F.lower("project").alias("_p"), F.col("number").alias("discussion"), F.lower("author.login").alias("asker"))
    rows = zoned(c.join(d, ["_p", "discussion"]).drop("_p"), spark, sf_dir, "created_at", "at")
    rows = rows.join(_accounts(spark, sf_dir), "login", "left")
    role = F.when(F.col("login") == F.col("asker"), "asker").otherwise(F.coalesce("kind", F.lit("participant")))
    return rows.select("project", "discussion", "id", "parent", "at", "login", role.alias("role"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound discussion as an ordered sequence of comments. No silence ends a discussion, so each is one session."""
    rows = conv.conversations(messages(spark, sf_dir), ["project", "discussion"], gap_us=None)
    return rows.select("project", "discussion", "turn_no", F.col("id").alias("comment_id"), F.col("role").alias("speaker_role"))


def p2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discussions split at a calibrated inactivity gap, in reading order, with the sessions in which one speaker replies to another."""
    m = cut(messages(spark, sf_dir).filter("at IS NOT NULL"))
    channel = ["project", "discussion"]
    rows = conv.conversations(m, channel, gap_us=conv.calibrate_gap(m, channel), cut_replies=True, sound=conv.RECIPROCAL)
    return rows.groupBy(*channel, "session_no").agg(F.count(F.lit(1)).alias("turns"), F.min("at").alias("first_us"), F.max("at").alias("last_us"), F.min_by("id", "turn_no").alias("first_id"), F.max_by("id", "turn_no").alias("last_id"))


def p3_neighbors(spark: SparkSession, sf_dir: str, min_score: float = -1.0) -> DataFrame:
    """The five most similar other documents of every document with a usable vector."""
    v = latest(load(spark, sf_dir, "doc_vector").filter("id IS NOT NULL"), ["id"], ["mod_time"], ["vec"])
    return nearest(v, 64, k=5, min_score=min_score)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the five most similar of the other, at a score of 0.90 or more."""
    n = p3_neighbors(spark, sf_dir, 0.90)
    return n.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document holds a passage of which evaluation item."""
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p6_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document asks which evaluation item's question with other parameters."""
    return reparameterised(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_item"))


_PLAN = "source string, k string, target_share double, exponent double, share double, budget double, short boolean"


def _planned(spark: SparkSession, counted: DataFrame, sf_dir: str) -> tuple[list[dict], DataFrame]:
    """The plan for a mixture as large as the corpus, as rows and as a table of one row per source."""
    rows = mixing.plan(mixing.source_sizes(counted, load(spark, sf_dir, "mix_target")))
    names = [x.split()[0] for x in _PLAN.split(", ")]
    return rows, spark.createDataFrame([tuple(r[n] for n in names) for r in rows], _PLAN)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources whose limit of repeats cuts the plan short of their share."""
    docs = load(spark, sf_dir, "documents").select("source", "text")
    return _planned(spark, mixing.sized(docs), sf_dir)[1].filter("short").select("source")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture as large as the corpus: per source the shares asked for, planned and reached, repeats and blocks."""
    counted = cut(mixing.sized(load(spark, sf_dir, "documents")))
    rows, asked = _planned(spark, counted, sf_dir)
    got = mixing.mix(counted, rows).groupBy(F.col("source").alias("k")).agg(F.sum("tokens").alias("taken"), F.max("copy").alias("most_copies"), F.countDistinct("block").alias("blocks"))
    got = cut(got)
    reached = got.agg(F.sum("taken").alias("_t"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("taken", "most_copies", "blocks")}
    share = F.coalesce(F.col("taken") / F.col("_t"), F.lit(0.0)).alias("reached_share")
    whole = asked.join(got, "k", "left").crossJoin(F.broadcast(reached)).withColumns(zero)
    return whole.select("source", "target_share", "exponent", "share", F.floor("budget").alias("budget"), "taken", share, "most_copies", "blocks", "short")


def _areas(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r["subject"] for r in load(spark, sf_dir, "subject_area").filter("subject IS NOT NULL").select("subject").distinct().orderBy("subject").collect()]


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's subjects with their shares of its prose."""
    return subjects(load(spark, sf_dir, "documents"), load(spark, sf_dir, "subject_label"), _areas(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that make up about a quarter or more of a document."""
    return p8_subjects(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per subject, alone and beside others."""
    s = p8_subjects(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("subject").alias("_s"))
    return s.select(F.explode("_s").alias("subject"), (F.size("_s") == 1).alias("_one")).groupBy("subject").agg(F.count(F.lit(1)).alias("docs"), F.count_if("_one").alias("docs_alone"))


QUERIES = {"p2_found": p2_found, "p2_sessions": p2_sessions, "p3_found": p3_found, "p3_neighbors": p3_neighbors, "p6_found": p6_found, "p6_reparameterised": p6_reparameterised,
    "p7_found": p7_found, "p7_mixture": p7_mixture, "p8_found": p8_found, "p8_composition": p8_composition}
_REF = r"^(https?:)?//[^/]+/+(repos/+)?([^/?#]+)/+([^/?#]+)/+discussions/+([0-9]+)([/?#].*)?$"

_MESSAGES = rf"""c AS (SELECT * FROM (SELECT *, regexp_extract(url, '([0-9]+)$', 1)::BIGINT AS id FROM discussion_comment) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, mod_time DESC) = 1),
d AS (SELECT project, number, lower(author.login) AS asker FROM discussion QUALIFY row_number() OVER (PARTITION BY project, number ORDER BY mod_time DESC) = 1),
k AS (SELECT lower(login) AS login, min(kind) AS kind FROM account WHERE login IS NOT NULL GROUP BY 1 HAVING count(DISTINCT kind) = 1 AND min(kind) IN ('bot', 'maintainer')),
m AS (SELECT d.project, d.number AS discussion, c.id, try_cast(nullif(regexp_extract(reply_to_url, '#discussioncomment-([0-9]+)$', 1), '') AS BIGINT) AS parent, epoch_us(try_cast(created_at AS TIMESTAMPTZ)) AS at,
 CASE WHEN lower(c.author.login) = d.asker THEN 'asker' ELSE coalesce(k.kind, 'participant') END AS role, lower(c.author.login) AS login
 FROM c JOIN d ON lower(regexp_extract(discussion_url, '{_REF}', 3) || '/' || regexp_extract(discussion_url, '{_REF}', 4)) = lower(d.project) AND try_cast(regexp_extract(discussion_url, '{_REF}', 5) AS BIGINT) = d.number LEFT JOIN k ON k.login = lower(c.author.login)
 WHERE regexp_matches(body, '[^\s\pZ\x{{85}}]'))"""

#: The same gap rule as in ``calibrate_gap``, on exact quantiles; replies across sessions count as none.
_SESSIONS = rf"""WITH RECURSIVE {_MESSAGES},
t AS (SELECT * FROM m WHERE "at" IS NOT NULL),
took AS (SELECT t.at - p.at AS d FROM t JOIN t p ON p.id = t.parent AND p.project = t.project AND p.discussion = t.discussion WHERE t.at >= p.at),
gap AS (SELECT greatest(3600000000, coalesce(quantile_disc(d, 0.99), 0)) AS g FROM took),
b AS (SELECT t.*, CASE WHEN "at" - lag("at") OVER (PARTITION BY project, discussion ORDER BY "at") > g THEN 1 ELSE 0 END AS new FROM t, gap),
n AS (SELECT *, 1 + sum(new) OVER (PARTITION BY project, discussion ORDER BY "at" RANGE UNBOUNDED PRECEDING) AS s FROM b),
r AS (SELECT n.* EXCLUDE (parent), p.id IS NOT NULL AS there, p.at AS pat, p.login AS plogin, p.s IS NOT DISTINCT FROM n.s AS same, CASE WHEN p.id IS NULL OR p.s = n.s THEN n.parent END AS parent
 FROM n LEFT JOIN n p ON p.id = n.parent AND p.project = n.project AND p.discussion = n.discussion),
ok AS (SELECT project, discussion, s, count(*) AS turns FROM r GROUP BY ALL HAVING bool_and(parent IS NULL OR (there AND same AND pat <= "at")) AND bool_or(there AND same AND login IS DISTINCT FROM plogin)),
w AS (SELECT r.project, r.discussion, r.s, r.id, [{{'at': r.at, 'id': r.id}}] AS path, r.at FROM r JOIN ok USING (project, discussion, s) WHERE parent IS NULL
 UNION ALL SELECT r.project, r.discussion, r.s, r.id, list_append(w.path, {{'at': r.at, 'id': r.id}}), r.at FROM r JOIN w ON r.parent = w.id AND r.project = w.project AND r.discussion = w.discussion AND r.s = w.s)
SELECT project, discussion, s::BIGINT AS session_no, count(*) AS turns, min("at") AS first_us, max("at") AS last_us, arg_min(id, path) AS first_id, arg_max(id, path) AS last_id
FROM w JOIN ok o USING (project, discussion, s) GROUP BY project, discussion, s HAVING count(*) = any_value(o.turns)"""

#: Sizes in words and marks, as the simplest public tokenizers count them: which sources are short doesn't hang on the tokenizer.
_P7 = r"""WITH d AS (SELECT lower(trim(source)) AS k, sum(len(regexp_extract_all(coalesce(text, ''), '\w+|[^\w\s]'))) AS n FROM documents GROUP BY 1),
t AS (SELECT source, weight / sum(weight) OVER () AS share, max_repeats, lower(trim(source)) AS k FROM mix_target)
SELECT source FROM t LEFT JOIN d USING (k) WHERE share * (SELECT sum(n) FROM d) > max_repeats * coalesce(n, 0)"""

ORACLE: dict[str, str] = {
    "p7_found": _P7,
    "p2_sessions": _SESSIONS,
    "p2_found": rf"""WITH RECURSIVE {_MESSAGES},
s AS (SELECT m.project, m.discussion, count(*) AS n FROM m LEFT JOIN m p ON p.id = m.parent AND p.project = m.project AND p.discussion = m.discussion GROUP BY 1, 2
 HAVING bool_and(m.at IS NOT NULL AND (m.parent IS NULL OR coalesce(p.at <= m.at, false))) AND bool_or(m.role IN ('maintainer', 'participant'))),
t AS (SELECT m.project, m.discussion, m.id, m.role, [{{'at': m.at, 'id': m.id}}] AS path FROM m JOIN s USING (project, discussion) WHERE m.parent IS NULL
 UNION ALL SELECT m.project, m.discussion, m.id, m.role, list_append(t.path, {{'at': m.at, 'id': m.id}}) FROM m JOIN t ON m.parent = t.id AND m.project = t.project AND m.discussion = t.discussion)
SELECT t.project, t.discussion, row_number() OVER (PARTITION BY t.project, t.discussion ORDER BY path) AS turn_no, t.id AS comment_id, t.role AS speaker_role
FROM t JOIN s USING (project, discussion) WHERE s.n = (SELECT count(*) FROM t q WHERE q.project = t.project AND q.discussion = t.discussion)""",
    "p3_found": """WITH l AS (SELECT id, vec::DOUBLE[] AS v FROM (SELECT id, vec, row_number() OVER (PARTITION BY id ORDER BY mod_time DESC) r FROM doc_vector) WHERE r = 1 AND len(vec) = 64
 AND list_aggregate(list_transform(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x)), 'bool_or') = false AND list_aggregate(list_transform(vec, lambda x: x <> 0), 'bool_or')),
n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS w FROM l), s AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) / a.w / b.w AS s FROM n a JOIN n b ON a.id <> b.id),
t AS (SELECT a, b FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) r FROM s WHERE s >= 0.9) WHERE r <= 5) SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM t""",
}
