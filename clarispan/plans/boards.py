"""Queries over the live board, the serving tables' state and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from clarispan.functions.web import network_of, strict_date
from clarispan.operators import boards, serving
from clarispan.plans.base import AS_OF, as_of, query, table
from clarispan.plans.network import FILES, LINKS, MEMBERS, SETS, files, groups, links, listed, memberships, shared_sets
from clarispan.sources import catalogs

DOCTORS, DRUGS = ["1000000001", "1000000002", "1000000003"], ["3", "5", "7", "11"]
BOARD = """
WITH plans AS (SELECT CAST(p_partkey AS VARCHAR) AS plan_id, p_retailprice / 4.0::DOUBLE AS premium, CASE WHEN p_partkey % 6 = 0 THEN 'Catastrophic' ELSE 'Silver' END AS metal, p_partkey AS ord FROM part),
cover AS (SELECT CAST(l_partkey AS VARCHAR) AS plan_id, CAST(l_suppkey % 20 AS VARCHAR) AS drug, CAST(1000000000 + l_suppkey % 20 AS VARCHAR) AS npi,
  CASE l_returnflag WHEN 'A' THEN 'Covered' WHEN 'R' THEN 'NotCovered' ELSE 'DataNotProvided' END AS coverage, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS ord, l_quantity AS q, l_extendedprice AS e FROM lineitem),
d AS (SELECT plan_id, count(*) FILTER (WHERE coverage = 'Covered') AS doctors_covered FROM (SELECT * FROM cover WHERE npi IN ('1000000001', '1000000002', '1000000003') QUALIFY row_number() OVER (PARTITION BY plan_id, npi ORDER BY ord DESC, q DESC, e DESC) = 1) GROUP BY plan_id),
r AS (SELECT plan_id, count(*) FILTER (WHERE coverage = 'Covered') AS drugs_covered FROM (SELECT * FROM cover WHERE drug IN ('3', '5', '7', '11') QUALIFY row_number() OVER (PARTITION BY plan_id, drug ORDER BY ord DESC, q DESC, e DESC) = 1) GROUP BY plan_id),
b AS (
  SELECT plan_id, metal, coalesce(doctors_covered, 0) AS doctors_covered, coalesce(drugs_covered, 0) AS drugs_covered, coalesce(doctors_covered, 0) = 3 AS keeps_all_doctors, CAST(floor(premium + 0.5) AS BIGINT) AS gross_monthly,
    CAST(floor(CASE WHEN metal = 'Catastrophic' THEN premium ELSE greatest(0.0::DOUBLE, premium - 120.0::DOUBLE) END + 0.5) AS BIGINT) AS net_monthly, ord FROM plans LEFT JOIN d USING (plan_id) LEFT JOIN r USING (plan_id)
)
SELECT * EXCLUDE (ord), net_monthly * 12 AS net_annual, CAST(row_number() OVER (ORDER BY keeps_all_doctors DESC, drugs_covered DESC, net_monthly, ord) AS INTEGER) AS rank FROM b QUALIFY rank <= 400"""


@query(BOARD)
def live_board(spark, sf_dir):
    """The best plans of one place; the limit is the most that one request pages through."""
    k = F.col("p_partkey")
    plans = table(spark, sf_dir, "part").select(k.cast("string").alias("plan_id"), (F.col("p_retailprice") / 4.0).alias("premium"), F.when(k % 6 == 0, "Catastrophic").otherwise("Silver").alias("metal"), k.alias("ord"))
    l = table(spark, sf_dir, "lineitem")
    wording = F.when(F.col("l_returnflag") == "A", "Covered").when(F.col("l_returnflag") == "R", "NotCovered").otherwise("DataNotProvided")
    order = F.struct(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_suppkey")).alias("a"), F.col("l_quantity").alias("b"), F.col("l_extendedprice").alias("c"))
    cover = lambda key: l.select(F.col("l_partkey").cast("string").alias("plan_id"), key.cast("string").alias("key"), wording.alias("coverage"), order.alias("ord"))
    return boards.live_board(plans, cover(F.col("l_suppkey") % 20 + 1000000000), cover(F.col("l_suppkey") % 20), DOCTORS, DRUGS, 120.0)


@query("WITH" + FILES + "," + LINKS + "," + SETS + "," + MEMBERS + f""",
idx AS (SELECT file_id, count(*) % 3 AS npi_count FROM memberships GROUP BY file_id)
SELECT file_id, reporting_entity FROM files WHERE active AND (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(source_last_updated)) / 86400000000.0::DOUBLE BETWEEN 0 AND 60
  AND (file_id IN (SELECT file_id FROM idx WHERE npi_count > 0) OR file_id IN (SELECT file_id FROM memberships)) AND (file_id IN (SELECT file_id FROM links) OR file_id IN (SELECT file_id FROM sets))""")
def ready_files(spark, sf_dir):
    m = memberships(spark, sf_dir)
    index = m.groupBy("file_id").agg((F.count("*") % 3).alias("npi_count"))
    return serving.ready_files(files(spark, sf_dir), index, m, links(spark, sf_dir), shared_sets(spark, sf_dir)[0], as_of()).select("file_id", "reporting_entity")


@query("WITH" + SETS + "\nSELECT set_id, plan_id, plan_id_type FROM entries WHERE set_id NOT IN (SELECT set_id FROM sets WHERE set_id % 4 > 0)")
def orphan_sets(spark, sf_dir):
    """Entries of sets that no file has; every fourth set's files are left out here."""
    sets, entries = shared_sets(spark, sf_dir)
    return serving.orphan_sets(entries, sets.where("set_id % 4 > 0")).select("set_id", "plan_id", "plan_id_type")


@query("WITH" + FILES + """,
ledger AS (SELECT event_id AS entry, 'https://files.example/' || CAST(event_id % 977 AS VARCHAR) || '?k=' || CAST(user_id AS VARCHAR) AS url FROM events), f AS (SELECT file_id, 'https://files.example/' || CAST(file_id AS VARCHAR) AS url FROM files)
SELECT entry, file_id FROM ledger l LEFT JOIN f ON split_part(l.url, '?', 1) = f.url""")
def ledger_files(spark, sf_dir):
    place = lambda c: F.concat(F.lit("https://files.example/"), c.cast("string"))
    ledger = table(spark, sf_dir, "events").select(F.col("event_id").alias("entry"), F.concat(place(F.col("event_id") % 977), F.lit("?k="), F.col("user_id").cast("string")).alias("url"))
    return serving.ledger_files(ledger, files(spark, sf_dir).select("file_id", place(F.col("file_id")).alias("url"))).select("entry", "file_id")


@query("""
WITH c AS (SELECT c_custkey AS run_id, c_custkey % 600 AS supervision_id, c_nationkey AS pid, CASE c_custkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN NULL ELSE 'running' END AS state FROM customer),
o AS (SELECT s_suppkey * 3 AS supervision_id, s_nationkey AS pid, CASE WHEN s_suppkey % 2 = 0 THEN 'killed' ELSE 'failed' END AS state FROM supplier),
g AS (SELECT run_id, c.state, max(o.state) FILTER (WHERE o.pid = c.pid) AS exact, coalesce(bool_or(o.pid <> c.pid), false) AS wrong FROM c LEFT JOIN o USING (supervision_id) GROUP BY ALL)
SELECT run_id, CASE WHEN wrong THEN 'unknown' WHEN state = 'running' AND exact IS NOT NULL THEN exact ELSE coalesce(state, 'unknown') END AS effective_state, CASE WHEN exact IS NOT NULL THEN 'interrupted' ELSE 'unverified' END AS process_outcome FROM g""")
def supervised_state(spark, sf_dir):
    k = F.col("c_custkey")
    runs = table(spark, sf_dir, "customer").select(k.alias("run_id"), (k % 600).alias("supervision_id"), F.col("c_nationkey").alias("pid"), F.when(k % 4 == 0, "complete").when(k % 4 > 1, "running").alias("state"))
    seen = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("supervision_id"), F.col("s_nationkey").alias("pid"), F.when(F.col("s_suppkey") % 2 == 0, "killed").otherwise("failed").alias("state"))
    return serving.supervised_state(runs, seen)


@query("""
SELECT l_partkey % 50 AS tin, l_suppkey AS npi, l_returnflag AS kind, count(*) AS times FROM lineitem GROUP BY ALL""")
def interned_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("tin"), F.col("l_suppkey").alias("npi"), F.col("l_returnflag").alias("kind"))
    return serving.interned_groups(rows, ["tin", "npi", "kind"])


@query("""
SELECT o_custkey % 300 AS identity, min('https://x/' || CAST(o_orderkey AS VARCHAR)) AS url, array_to_string(list_sort(list(DISTINCT CAST(o_custkey AS VARCHAR))), ',') AS eins FROM orders GROUP BY ALL""")
def url_provenance(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("identity"), F.concat(F.lit("https://x/"), F.col("o_orderkey").cast("string")).alias("url"), F.col("o_custkey").cast("string").alias("ein"))
    return serving.url_provenance(rows).withColumn("eins", F.array_join("eins", ","))


@query("WITH" + MEMBERS + "\nSELECT DISTINCT CAST(file_id AS VARCHAR) AS file_id, npi FROM memberships")
def bucket_round_trip(spark, sf_dir):
    """Memberships packed into compressed buckets and read back."""
    return serving.unpack_buckets(serving.pack_buckets(listed(spark, sf_dir)))


@query("""
WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'OH-' ELSE 'OHX ' END || o_orderpriority AS plan_name, o_orderstatus || CASE WHEN o_orderkey % 7 = 0 THEN '_oh' ELSE '' END AS file_description, 'https://x/' || CAST(o_orderkey AS VARCHAR) AS file_url FROM orders)
SELECT id, plan_name FROM m WHERE regexp_matches(plan_name, '(?i)urgent|high') AND regexp_matches(concat_ws(' ', plan_name, file_description, file_url), '(?i)(^|[-_\\s])OH($|[-_\\s])')""")
def manifest_state_filter(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.when(k % 5 == 0, "OH-").otherwise("OHX "), "o_orderpriority").alias("plan_name"), F.concat("o_orderstatus", F.when(k % 7 == 0, "_oh").otherwise("")).alias("file_description"), F.concat(F.lit("https://x/"), k.cast("string")).alias("file_url"))
    return catalogs.by_plan_and_state(rows, "(urgent|high)", "oh").select("id", "plan_name")


@query("""
WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.' || CAST(user_id % 256 AS VARCHAR) || '.0.7' WHEN 1 THEN '::ffff:10.' || CAST(user_id % 256 AS VARCHAR) || '.0.7' WHEN 2 THEN '2001:DB8:' || CAST(user_id % 9 + 1 AS VARCHAR) || '::' || CAST(event_id % 9999 + 1 AS VARCHAR) ELSE 'x' END AS ip, user_id FROM events)
SELECT CASE event_id % 4 WHEN 2 THEN '2001:db8:' || CAST(user_id % 9 + 1 AS VARCHAR) || ':0::/64' WHEN 3 THEN NULL ELSE '10.' || CAST(user_id % 256 AS VARCHAR) || '.0.7' END AS network, count(*) AS n FROM e GROUP BY ALL""")
def visitor_networks(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id")
    v4 = F.concat(F.lit("10."), (u % 256).cast("string"), F.lit(".0.7"))
    v6 = F.concat(F.lit("2001:DB8:"), (u % 9 + 1).cast("string"), F.lit("::"), (k % 9999 + 1).cast("string"))
    rows = table(spark, sf_dir, "events").select(F.when(k % 4 == 0, v4).when(k % 4 == 1, F.concat(F.lit("::ffff:"), v4)).when(k % 4 == 2, v6).otherwise("x").alias("ip"))
    once = rows.groupBy("ip").agg(F.count("*").alias("n"))  # an address is looked at once
    return once.groupBy(network_of(F.col("ip")).alias("network")).agg(F.sum("n").alias("n"))


@query("""
WITH d AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-13-%d') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS t FROM orders)
SELECT id, CASE WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(t AS DATE) END AS day FROM d""")
def strict_dates(spark, sf_dir):
    form = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 0, form("yyyy-MM-dd")).when(k % 3 == 1, form("yyyy-'13'-dd")).otherwise(form("yyyy/MM/dd")).alias("t"))
    return rows.select("id", strict_date(F.col("t")).alias("day"))
