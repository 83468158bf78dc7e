"""The pN_ queries of the core: mixed timestamps (1), nested records (4) and the change feed (5)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.timestamps import _MONTHS, ABBREVIATIONS, CASCADE, with_instant
from marlspike.operators.cdc import apply_changes, issue_state
from marlspike.operators.shred import places, shred, table
from marlspike.session import latest, load, small


def site_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project -> zone, one row each."""
    sites = load(spark, sf_dir, "project_site").groupBy("project").agg(F.min("time_zone").alias("time_zone"))
    return small(sites, 10_000)


def zoned(df: DataFrame, spark: SparkSession, sf_dir: str, text: str, out: str = "instant_us") -> DataFrame:
    """``df`` with the instant of ``text``, read in the zone of the row's project."""
    return with_instant(df.join(site_zones(spark, sf_dir), "project", "left"), text, out, "time_zone").drop("time_zone")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored text that isn't in the plain UTC form and denotes one instant, with that instant."""
    ie = load(spark, sf_dir, "issue_event").select(F.lit("issue_event").alias("src"), "project", F.col("id").alias("rec_id"), F.col("created_at").alias("at"))
    di = load(spark, sf_dir, "discussion").select(F.lit("discussion").alias("src"), "project", F.col("number").alias("rec_id"), F.col("created_at").alias("at"))
    ci = load(spark, sf_dir, "change_info").select(F.lit("change_info").alias("src"), "project", F.col("number").alias("rec_id"), F.col("updated").alias("at"))
    rows = ie.unionByName(di).unionByName(ci).filter(~F.col("at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"))
    rows = rows.join(site_zones(spark, sf_dir), "project", "left").withColumn("zone", F.when(F.col("src") == "change_info", "UTC").otherwise(F.col("time_zone")))
    got = with_instant(rows, "at", "instant_us", "zone")
    return got.filter("instant_us IS NOT NULL").select("src", "project", "rec_id", "instant_us").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present state of every issue, from the latest delivery of each of its events."""
    cols = ["issue", "event", "label", "labels", "created_at", "assignees", "milestone", "rename"]
    events = latest(load(spark, sf_dir, "issue_event"), ["project", "id"], ["mod_time"], cols)
    return issue_state(zoned(events, spark, sf_dir, "created_at"))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per user out of a feed: errors delete it, sign-ups replace it, purchases set its value and views its props."""
    e = load(spark, sf_dir, "events")
    kind = F.col("event_type")
    return apply_changes(e, ["user_id"], ["ts", "event_id"], ["value", "props"], kind == "error", kind == "signup", {"value": kind == "purchase", "props": kind == "view"})


#: path -> the member of an element that is its leaf.
P4_LEAVES = {"labels": "name", "assignees": "login", "reactions.groups": "content", "reactions.groups.users": "login"}
P4_SET, P4_TAGS = "attention_set", "attention_set.account.tags"


_P4_KEYS = ["src", "project", "rec_id"]


def _tracker_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled nodes of the newest version of every tracker event."""
    te = latest(load(spark, sf_dir, "tracker_event"), ["project", "issue", "api", "id"], ["mod_time"], ["json"])
    te = te.select(F.concat(F.lit("tracker_event"), "api").alias("src"), "project", F.col("id").alias("rec_id"), "issue", "json")
    return shred(te, "json", [*_P4_KEYS, "issue"], lists=list(P4_LEAVES), keep=list(P4_LEAVES))


def _change_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled nodes of the attention sets of the newest version of every change."""
    ci = load(spark, sf_dir, "change_info").select("project", "number", "mod_time", F.to_json("attention_set", {"ignoreNullFields": "false"}).alias("json"))
    ci = latest(ci, ["project", "number"], ["mod_time"]).select(F.lit("change_info").alias("src"), "project", F.col("number").alias("rec_id"), "json")
    return shred(ci, "json", _P4_KEYS, maps=[P4_SET], lists=[P4_TAGS], keep=[P4_SET, P4_TAGS], root=P4_SET).filter("kind <> 'null'")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the nested members of tracker events and changes, with the place that their labels give."""
    member = F.create_map(*(F.lit(x) for kv in P4_LEAVES.items() for x in kv))
    a = _tracker_nodes(spark, sf_dir).withColumn("leaf", F.coalesce(F.col("fields")[""], F.col("fields")[member[F.col("path")]]))
    leaf = F.when(F.col("path") == P4_SET, F.coalesce(F.col("fields")["account.email"], F.lit(""))).otherwise(F.col("fields")[""])
    b = _change_nodes(spark, sf_dir).withColumn("leaf", leaf)

    def flat(rows: DataFrame, tables: list[str], maps: list[str]) -> DataFrame:
        pos = F.coalesce(*(F.when(F.col("path") == p, places(p, tables, maps)) for p in tables))
        return rows.filter("leaf IS NOT NULL").select(*_P4_KEYS, "path", pos.alias("pos"), "leaf")

    return flat(a, list(P4_LEAVES), []).unionByName(flat(b, [P4_SET, P4_TAGS], [P4_SET]))


def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The related tables of tracker events and changes: each row with its place, and the place of the row its parent link leads to."""

    def linked(nodes: DataFrame, keys: list[str], tables: list[str], maps: list[str]) -> DataFrame:
        rows = functools.reduce(DataFrame.unionByName, (table(nodes, p, {}, keys, tables, maps).withColumn("path", F.lit(p)) for p in tables))
        above = rows.select(*keys, F.col("path").alias("parent_table"), F.col("node_id").alias("parent_id"), F.col("pos").alias("parent_pos"))
        joined = rows.join(above, [*keys, "parent_table", "parent_id"], "left")
        return joined.select(*_P4_KEYS, "path", "pos", "parent_table", F.coalesce("parent_pos", F.lit("")).alias("parent_pos"))

    a = linked(_tracker_nodes(spark, sf_dir), [*_P4_KEYS, "issue"], list(P4_LEAVES), [])
    return a.unionByName(linked(_change_nodes(spark, sf_dir), _P4_KEYS, [P4_SET, P4_TAGS], [P4_SET]))


# ---- SQL counterparts, for DuckDB


def _instants(rows: str) -> str:
    """CTEs that end in ``inst`` (all columns of ``rows``, u) where ``rows`` has the columns v and zone.

    The texts are levelled by the same patterns; what they denote is worked out anew, with DuckDB's calendar.
    """
    case = " ".join(f"WHEN regexp_matches(t, '{p}') THEN regexp_replace(t, '{p}', '{_duck(to)}')" for _, p, to in CASCADE)
    zones = "', '".join(sorted(ABBREVIATIONS))
    minutes = ", ".join(str(ABBREVIATIONS[z]) for z in sorted(ABBREVIATIONS))
    months = _MONTHS.replace("|", "")
    return f"""rows AS ({rows}), a AS (SELECT *, trim(v, E' \\t\\r\\n') AS t FROM rows), b AS (SELECT *, string_split(CASE {case} END, '|') AS l FROM a),
c AS (SELECT *, CASE WHEN length(l[1]) = 2 THEN 2000 + l[1]::INT ELSE try_cast(l[1] AS INT) END AS y, coalesce(try_cast(l[2] AS INT), (instr('{months}', lower(l[2])) + 2) // 3) AS mo, try_cast(l[3] AS INT) AS dd,
 CASE WHEN l[8] = '' THEN try_cast(l[4] AS INT) WHEN try_cast(l[4] AS INT) BETWEEN 1 AND 12 THEN try_cast(l[4] AS INT) % 12 + CASE WHEN lower(l[8]) = 'pm' THEN 12 ELSE 0 END END AS h,
 try_cast(l[5] AS INT) AS mi, coalesce(try_cast(l[6] AS INT), 0) AS se, coalesce(try_cast(rpad(l[7], 6, '0')[1:6] AS BIGINT), 0) AS us, replace(replace(nullif(l[9], ''), '[', ''), ']', '') AS z FROM b),
d AS (SELECT *, CASE WHEN regexp_matches(z, '^[+-]') THEN (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (z[2:3]::INT * 60 + coalesce(try_cast(replace(z[4:], ':', '') AS INT), 0)) ELSE map(['{zones}'], [{minutes}])[upper(z)] END AS off,
 CASE WHEN z IS NULL THEN zone WHEN contains(z, '/') THEN z END AS rg, h::BIGINT * 3600000000 + mi::BIGINT * 60000000 + se::BIGINT * 1000000 + us AS clock FROM c),
q AS (SELECT *, try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', y, mo, dd) AS DATE) AS d1, CASE WHEN l[11] = 'two' THEN try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', y, dd, mo) AS DATE) END AS d2 FROM d),
e AS (SELECT *, CASE WHEN d1 <> d2 THEN NULL ELSE coalesce(d1, d2) END AS day FROM q WHERE y > 1 AND h < 24 AND mi < 60 AND se < 60),
f AS (SELECT *, make_timestamp(epoch_us(day) + clock) AS loc FROM e WHERE day IS NOT NULL),
g AS (SELECT *, CASE WHEN off IS NOT NULL THEN [epoch_us(loc) - off::BIGINT * 60000000] WHEN rg IS NOT NULL THEN list_distinct(list_filter([epoch_us(timezone(rg, loc)), epoch_us(timezone(rg, loc)) - 3600000000, epoch_us(timezone(rg, loc)) + 3600000000], lambda x: timezone(rg, make_timestamptz(x)) = loc)) ELSE [] END AS us_ FROM f),
p AS (SELECT DISTINCT v, zone, unnest(us_) AS u FROM g), one AS (SELECT v, zone, min(u) AS u FROM p GROUP BY ALL HAVING count(*) = 1),
inst AS (SELECT a.* EXCLUDE (t), CASE WHEN regexp_matches(t, '^[0-9]{{9,10}}(\\.[0-9]+)?$') THEN split_part(t, '.', 1)::BIGINT * 1000000 + rpad(split_part(t, '.', 2), 6, '0')[1:6]::BIGINT WHEN regexp_matches(t, '^[0-9]{{13}}$') THEN t::BIGINT * 1000 WHEN regexp_matches(t, '^[0-9]{{16}}([0-9]{{3}})?$') THEN t[1:16]::BIGINT ELSE one.u END AS u FROM a LEFT JOIN one ON a.v = one.v AND a.zone IS NOT DISTINCT FROM one.zone)"""


def _duck(to: str) -> str:
    return to.replace("$", "\\")


P1_SQL = f"""WITH {_instants("SELECT 'issue_event' AS src, project, id AS rec_id, created_at AS v, time_zone AS zone FROM issue_event LEFT JOIN project_site USING (project) UNION ALL SELECT 'discussion', project, number, created_at, time_zone FROM discussion LEFT JOIN project_site USING (project) UNION ALL SELECT 'change_info', project, number, updated, 'UTC' FROM change_info")}
SELECT DISTINCT src, project, rec_id, u AS instant_us FROM inst WHERE u IS NOT NULL AND NOT regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$')"""

P5_SQL = f"""WITH {_instants("SELECT i.*, created_at AS v, time_zone AS zone FROM (SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY mod_time DESC) rn FROM issue_event) i LEFT JOIN project_site USING (project) WHERE rn = 1")},
cells AS (SELECT project, issue, u, id, 'label' AS item_kind, x AS field, CASE WHEN event = 'labeled' THEN x END AS val FROM (SELECT *, unnest(list_distinct(list_transform(list_append(list_transform(coalesce(labels, []), lambda q: q.name), label.name), lambda q: lower(trim(q, ' '))))) AS x FROM inst WHERE event IN ('labeled', 'unlabeled')) WHERE x <> ''
UNION ALL SELECT project, issue, u, id, 'assignee', x, CASE WHEN event = 'assigned' THEN x END FROM (SELECT *, unnest(list_distinct(list_transform(assignees, lambda q: lower(q.login)))) AS x FROM inst WHERE event IN ('assigned', 'unassigned')) WHERE x <> ''
UNION ALL SELECT project, issue, u, id, 'state', '', CASE WHEN event = 'closed' THEN 'closed' ELSE 'open' END FROM inst WHERE event IN ('closed', 'reopened')
UNION ALL SELECT project, issue, u, id, 'milestone', '', CASE WHEN event = 'milestoned' THEN milestone.title END FROM inst WHERE event = 'demilestoned' OR (event = 'milestoned' AND milestone.title IS NOT NULL)
UNION ALL SELECT project, issue, u, id, 'title', '', "rename"."to" FROM inst WHERE event = 'renamed' AND "rename"."to" IS NOT NULL)
SELECT project, issue, item_kind, val AS item FROM (SELECT *, row_number() OVER (PARTITION BY project, issue, item_kind, field ORDER BY u DESC, id DESC) k FROM cells WHERE u IS NOT NULL) WHERE k = 1 AND val IS NOT NULL AND (project, issue) NOT IN (SELECT (project, issue) FROM inst WHERE event = 'deleted')"""


P5_TABLE_SQL = """WITH s AS (SELECT *, {'ts': ts, 'id': event_id} AS s FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
b AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN s END) AS d, max(CASE WHEN event_type = 'signup' THEN s END) AS r FROM s GROUP BY 1)
SELECT s.user_id, (arg_max({'v': value}, s) FILTER (WHERE event_type IN ('purchase', 'signup'))).v AS value, (arg_max({'v': props}, s) FILTER (WHERE event_type IN ('view', 'signup'))).v AS props
FROM s JOIN b ON s.user_id IS NOT DISTINCT FROM b.user_id WHERE event_type <> 'error' AND (d IS NULL OR s > d) AND (r IS NULL OR s >= r) GROUP BY s.user_id"""


def _list(x: str) -> str:
    """SQL: the elements of a JSON value, whatever the list is wrapped in."""
    flat = lambda y, rest: f"CASE json_type({y}) WHEN 'ARRAY' THEN json_extract({y}, '$[*]') WHEN 'NULL' THEN [] {rest} END"
    inner = f"json_extract({x}, '$.nodes')"
    wrapped = flat(inner, f"ELSE [{inner}]")
    return f"coalesce({flat(x, f'''WHEN 'OBJECT' THEN CASE WHEN {inner} IS NOT NULL THEN {wrapped} ELSE [{x}] END ELSE [{x}]''')}, [])"


def _leaf(e: str, member: str) -> str:
    return f"CASE json_type({e}) WHEN 'OBJECT' THEN json_extract_string({e}, '$.{member}') WHEN 'NULL' THEN NULL ELSE json_extract_string({e}, '$') END"


def _member(name: str) -> str:
    return f"coalesce(json_extract(j, '$.{name}'), json_extract(j, '$.{name.capitalize()}'))"


P4_SQL = f"""WITH te AS (SELECT 'tracker_event' || api AS src, project, id AS rec_id, ltrim(replace(ltrim(json, chr(65279)), ')]}}''' || chr(10), ''), E' \\n\\r\\t') AS t FROM tracker_event QUALIFY row_number() OVER (PARTITION BY project, issue, api, id ORDER BY mod_time DESC) = 1),
a AS (SELECT *, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t::JSON) = 'VARCHAR' THEN json_extract_string(t::JSON, '$') ELSE t END END AS s FROM te),
b AS (SELECT src, project, rec_id, CASE WHEN json_valid(s) THEN s::JSON END AS j FROM a),
tops AS (SELECT src, project, rec_id, 'labels' AS path, {_list(_member("labels"))} AS l FROM b WHERE j IS NOT NULL UNION ALL SELECT src, project, rec_id, 'assignees', {_list(_member("assignees"))} FROM b WHERE j IS NOT NULL
UNION ALL SELECT src, project, rec_id, 'reactions.groups', {_list("json_extract(j, '$.reactions.groups')")} FROM b WHERE j IS NOT NULL),
el AS (SELECT src, project, rec_id, path, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS k FROM tops),
us AS (SELECT src, project, rec_id, k, {_list("json_extract(e, '$.users')")} AS l FROM el WHERE path = 'reactions.groups' AND json_type(e) = 'OBJECT'),
ue AS (SELECT src, project, rec_id, k, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS k2 FROM us),
ci AS (SELECT project, number, map_entries(attention_set) AS m FROM change_info QUALIFY row_number() OVER (PARTITION BY project, number ORDER BY mod_time DESC) = 1),
ce AS (SELECT project, number, unnest(m) AS x FROM ci), tg AS (SELECT project, number, x.key AS key, unnest(x.value.account.tags) AS tag, generate_subscripts(x.value.account.tags, 1) - 1 AS k FROM ce WHERE x.value IS NOT NULL)
SELECT src, project, rec_id, path, k::VARCHAR AS pos, CASE path WHEN 'labels' THEN {_leaf("e", "name")} WHEN 'assignees' THEN {_leaf("e", "login")} ELSE {_leaf("e", "content")} END AS leaf FROM el WHERE leaf IS NOT NULL
UNION ALL SELECT src, project, rec_id, 'reactions.groups.users', k || '.' || k2, {_leaf("e", "login")} AS lf FROM ue WHERE lf IS NOT NULL
UNION ALL SELECT 'change_info', project, number, 'attention_set', x.key::VARCHAR, coalesce(x.value.account.email, '') FROM ce WHERE x.value IS NOT NULL
UNION ALL SELECT 'change_info', project, number, 'attention_set.account.tags', key || '.' || k, tag FROM tg WHERE tag IS NOT NULL"""

_P4_TREES = P4_SQL.split("\nSELECT src, project, rec_id, path, k::VARCHAR")[0]
P4_TABLES_SQL = f"""{_P4_TREES}
SELECT src, project, rec_id, path, k::VARCHAR AS pos, '' AS parent_table, '' AS parent_pos FROM el WHERE e IS NOT NULL
UNION ALL SELECT src, project, rec_id, 'reactions.groups.users', k || '.' || k2, 'reactions.groups', k::VARCHAR FROM ue WHERE e IS NOT NULL
UNION ALL SELECT 'change_info', project, number, 'attention_set', x.key::VARCHAR, '', '' FROM ce WHERE x.value IS NOT NULL
UNION ALL SELECT 'change_info', project, number, 'attention_set.account.tags', key || '.' || k, 'attention_set', key::VARCHAR FROM tg WHERE tag IS NOT NULL"""
