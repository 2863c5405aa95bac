"""Queries over registries, quotas and watched content."""

from __future__ import annotations

from pyspark.sql import functions as F

from clarispan.functions.scalars import employer_name, with_page_text
from clarispan.operators import publication, quotas, registries
from clarispan.plans.base import query, table
from clarispan.policy import EMPLOYER_SUFFIXES

NOW = "2024-01-15 12:00:00"
_SUFFIX = " (" + "|".join(EMPLOYER_SUFFIXES) + ")"
EMPLOYERS = f"""
raw AS (
  SELECT p_partkey AS ord, CASE p_size % 3 WHEN 0 THEN 'The ' ELSE '' END || p_name || CASE p_size % 5 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Holdings LLC' WHEN 2 THEN ' Co' WHEN 3 THEN ' Group The' ELSE '' END AS name,
    lpad(CAST(p_partkey % 40 + 120000000 AS VARCHAR), 9, '0') AS ein, CASE WHEN p_partkey % 4 = 0 THEN '1B4A' WHEN p_partkey % 4 = 1 THEN '14A2' ELSE '4A' END AS welfare_code, CASE WHEN p_partkey % 9 > 0 THEN p_size END AS participants FROM part
), e0 AS (SELECT *, trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')) AS plain FROM raw WHERE welfare_code <> '14A2'),
e1 AS (SELECT *, regexp_replace(regexp_replace(plain, '^(.+?)(({_SUFFIX})+)$', '\\1'), '^(THE )+', '') AS name_norm FROM e0),
employers AS (SELECT ein, name_norm, name, participants FROM e1 QUALIFY row_number() OVER (PARTITION BY ein, name_norm ORDER BY -coalesce(participants, -1), ord) = 1)"""


def employer_rows(spark, sf_dir):
    size, k = F.col("p_size"), F.col("p_partkey")
    suffix = F.when(size % 5 == 0, ", Inc.").when(size % 5 == 1, " Holdings LLC").when(size % 5 == 2, " Co").when(size % 5 == 3, " Group The").otherwise("")
    return table(spark, sf_dir, "part").select(
        k.alias("ord"), F.concat(F.when(size % 3 == 0, "The ").otherwise(""), "p_name", suffix).alias("name"), F.lpad((k % 40 + 120000000).cast("string"), 9, "0").alias("ein"),
        F.when(k % 4 == 0, "1B4A").when(k % 4 == 1, "14A2").otherwise("4A").alias("welfare_code"), F.when(k % 9 > 0, size).alias("participants"), F.lit("OH").alias("state"))


@query("WITH" + EMPLOYERS + "\nSELECT ein, name_norm, name, participants FROM employers")
def employer_norm_dedup(spark, sf_dir):
    return registries.employers(employer_rows(spark, sf_dir)).select("ein", "name_norm", "name", "participants")


@query("WITH" + EMPLOYERS + "\nSELECT name, ein, participants FROM employers WHERE contains(lower(name_norm), 'widget') ORDER BY participants DESC NULLS LAST, name, ein LIMIT 10")
def employer_search(spark, sf_dir):
    return registries.search_employers(registries.employers(employer_rows(spark, sf_dir)), "Widget").select("name", "ein", "participants")


@query("WITH" + EMPLOYERS + "\nSELECT plain AS name, name_norm, count(*) AS n FROM e1 GROUP BY ALL")
def employer_names(spark, sf_dir):
    rows = employer_rows(spark, sf_dir).where("welfare_code <> '14A2'")
    plain = F.trim(F.regexp_replace(F.upper("name"), "[^A-Z0-9]+", " "))
    return rows.groupBy(plain.alias("name"), employer_name(F.col("name")).alias("name_norm")).agg(F.count("*").alias("n"))


NPPES = """
np AS (
  SELECT c_custkey AS ord, CASE WHEN c_custkey % 13 = 0 THEN '12345' ELSE CAST(1000000000 + c_custkey % 900 AS VARCHAR) END AS npi, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS organization, c_mktsegment AS last_name,
    CASE WHEN c_nationkey % 3 = 0 THEN 'OH' ELSE 'PA' END AS state, '44' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '-1' AS postal_code, CASE WHEN c_custkey % 4 = 0 THEN '207Q' ELSE '363L' END AS taxonomy,
    CASE WHEN c_custkey % 10 = 0 THEN '01/01/2020' ELSE '' END AS deactivated, CASE WHEN c_custkey % 20 = 0 THEN '01/01/2021' ELSE '' END AS reactivated FROM customer
)"""


def nppes_rows(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("ord"), F.when(k % 13 == 0, "12345").otherwise((k % 900 + 1000000000).cast("string")).alias("npi"), F.lit("1").alias("entity_type"), F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("organization"),
        F.col("c_mktsegment").alias("last_name"), F.lit("").alias("first_name"), F.when(n % 3 == 0, "OH").otherwise("PA").alias("state"), F.concat(F.lit("44"), F.lpad(n.cast("string"), 3, "0"), F.lit("-1")).alias("postal_code"),
        F.when(k % 4 == 0, "207Q").otherwise("363L").alias("taxonomy"), F.when(k % 10 == 0, "01/01/2020").otherwise("").alias("deactivated"), F.when(k % 20 == 0, "01/01/2021").otherwise("").alias("reactivated"))


@query("WITH" + NPPES + """
SELECT npi, CASE WHEN organization <> '' THEN organization ELSE last_name END AS name, state, postal_code, taxonomy FROM np WHERE (deactivated = '' OR reactivated <> '') AND state = 'OH' AND (postal_code LIKE '4400%' OR postal_code LIKE '4401%') AND taxonomy LIKE '20%'
  AND regexp_full_match(npi, '[0-9]{10}') QUALIFY row_number() OVER (PARTITION BY npi ORDER BY ord) = 1""")
def nppes_filter(spark, sf_dir):
    return registries.npi_allowlist(nppes_rows(spark, sf_dir), "oh", ["4400", "4401"], ["20"])


@query("WITH" + NPPES + """
SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE deactivated <> '' AND reactivated = '') AS deactivated, count(*) FILTER (WHERE NOT (deactivated <> '' AND reactivated = '') AND NOT regexp_full_match(npi, '[0-9]{10}')) AS malformed_npi FROM np""")
def nppes_audit(spark, sf_dir):
    return registries.npi_audit(nppes_rows(spark, sf_dir))


@query("""
WITH p AS (SELECT s_suppkey AS plan, s_nationkey % 3 AS grp, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS region FROM supplier),
u AS (SELECT c_custkey % 150 AS plan, arg_max(c_nationkey, c_custkey) AS region FROM customer GROUP BY ALL)
SELECT p.plan, grp, coalesce(u.region, p.region) AS region FROM p LEFT JOIN u USING (plan)""")
def region_backfill(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    plans = s.select(F.col("s_suppkey").alias("plan"), (F.col("s_nationkey") % 3).alias("grp"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("region"))
    updates = c.select((F.col("c_custkey") % 150).alias("plan"), F.col("c_nationkey").alias("region"), F.col("c_custkey").alias("ord"))
    return registries.backfill_regions(plans, updates, ["plan"])


def ledger(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("visitor"), (F.col("user_id") % 10).alias("network"), F.col("ts").alias("created"), "event_id")


@query(f"""
WITH e AS (SELECT k.scope, CASE k.scope WHEN 'visitor' THEN CAST(user_id AS VARCHAR) ELSE CAST(user_id % 10 AS VARCHAR) END AS key, ts FROM events CROSS JOIN (VALUES ('visitor'), ('network')) k(scope) WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '{NOW}'),
g AS (SELECT scope, key, count(*) AS month, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS day, count(*) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 60 SECOND) AS minute FROM e GROUP BY ALL)
SELECT scope, key, month, day, minute, CASE WHEN month >= CASE scope WHEN 'visitor' THEN 50 ELSE 150 END THEN 'month' WHEN day >= CASE scope WHEN 'visitor' THEN 10 ELSE 30 END THEN 'day' WHEN minute >= CASE scope WHEN 'visitor' THEN 3 ELSE 10 END THEN 'minute' ELSE 'none' END AS reached FROM g""")
def quota_usage(spark, sf_dir):
    return quotas.usage(ledger(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(f"""
SELECT count(*) * 50000 AS month_micro, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') * 50000 AS day_micro FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '{NOW}'""")
def quota_site_cost(spark, sf_dir):
    return quotas.site_cost(ledger(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query("""
SELECT visitor, max(n) AS most FROM (SELECT user_id AS visitor, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY visitor""")
def quota_sliding_hour(spark, sf_dir):
    return quotas.sliding(ledger(spark, sf_dir), 3600)


PAGE_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '<nav\b[^>]*>.*?</nav>', ' ', 'gis'),
    '<header\b[^>]*>.*?</header>', ' ', 'gis'), '<footer\b[^>]*>.*?</footer>', ' ', 'gis'), '<([^>"'']|"[^"]*"|''[^'']*'')*>', ' ', 'gs'),
  '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'))"""


@query(f"SELECT page_id, sha256({PAGE_TEXT}) AS text_sha256 FROM pages")
def page_texts(spark, sf_dir):
    return with_page_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.sha2("text", 256).alias("text_sha256"))


@query("""
WITH b AS (SELECT page_id AS id, sha256(CASE WHEN page_id % 2 = 0 THEN html || 'x' ELSE html END) AS fingerprint FROM pages), c AS (SELECT CASE WHEN page_id % 7 = 0 THEN -1 - page_id ELSE page_id END AS id, sha256(html) AS fingerprint FROM pages)
SELECT id, CASE WHEN b.fingerprint IS NULL THEN 'first' WHEN c.fingerprint IS NULL THEN 'missing' WHEN b.fingerprint = c.fingerprint THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN c USING (id)""")
def page_fingerprint_change(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    base = p.select(k.alias("id"), F.sha2(F.when(k % 2 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256).alias("fingerprint"))
    return publication.content_changes(base, p.select(F.when(k % 7 == 0, -1 - k).otherwise(k).alias("id"), F.sha2("html", 256).alias("fingerprint")))


@query("""
WITH s AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer),
t AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN -1 - c_custkey ELSE c_custkey END AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS nation, c_mktsegment AS segment FROM customer)
SELECT id, CASE WHEN t.name IS NULL THEN 'missing' ELSE concat_ws(',', CASE WHEN s.name IS DISTINCT FROM t.name THEN 'name' END, CASE WHEN s.nation IS DISTINCT FROM t.nation THEN 'nation' END, CASE WHEN s.segment IS DISTINCT FROM t.segment THEN 'segment' END) END AS mismatch
FROM s LEFT JOIN t USING (id)""")
def source_pair_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    source = c.select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    served = c.select(F.when(k % 11 == 0, -1 - k).otherwise(k).alias("id"), F.when(k % 3 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("name"), F.when(k % 4 != 0, F.col("c_nationkey")).alias("nation"), F.col("c_mktsegment").alias("segment"))
    return publication.compare(source, served, "id", ["name", "nation", "segment"])


@query("""
WITH e AS (SELECT DISTINCT c_custkey % 300 AS item, true AS wanted FROM customer), f AS (SELECT DISTINCT s_suppkey * 4 AS item, true AS there FROM supplier)
SELECT item, CASE WHEN there IS NULL THEN 'unresolved' WHEN wanted IS NULL THEN 'unexpected' ELSE 'matched' END AS state FROM e FULL JOIN f USING (item)""")
def expected_inventory(spark, sf_dir):
    e = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 300).alias("item"))
    return publication.inventory(e, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 4).alias("item")), "item")


@query("""
WITH ev AS (SELECT user_id AS action, arg_max(event_type, event_id) AS k, arg_max(value, event_id) AS f FROM events GROUP BY user_id),
b AS (SELECT event_id AS binding_id, user_id AS action, event_type AS request_key, value AS fingerprint FROM events)
SELECT binding_id, NOT (k = request_key AND f = fingerprint) AS stale FROM b LEFT JOIN ev USING (action)""")
def evidence_superseded(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("action"), F.col("event_type").alias("request_key"), F.col("value").alias("fingerprint"), F.col("event_id").alias("ord"))
    return publication.superseded(e.withColumnRenamed("ord", "binding_id"), e)
