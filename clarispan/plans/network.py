"""Queries over network files: extraction, serving index, search, publication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clarispan.functions.scalars import shard_name, url_identity
from clarispan.operators import network_files as nf
from clarispan.operators import publication
from clarispan.operators.ranking import ranked, ranked_within
from clarispan.plans.base import AS_OF, as_of, query, table


def files(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    url = F.concat(F.lit("https://files.example/"), "n_name", F.lit("/"), day, F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".json.gz?Signature=s&v="), (F.col("o_orderkey") % 3).cast("string"))
    return rows.select(
        F.col("o_orderkey").alias("file_id"), (F.col("o_orderstatus") != "P").alias("active"), F.col("o_orderdate").alias("source_last_updated"), F.col("n_name").alias("reporting_entity"),
        url.alias("url"), (F.floor("o_totalprice") * 10000).alias("bytes"), F.col("o_custkey").alias("custkey"))


def links(spark, sf_dir):
    """Plans of files that have no shared set."""
    o, c = table(spark, sf_dir, "orders").where("o_orderkey % 3 > 0"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("file_id"), *_plan())


def _plan():
    k = F.col("c_custkey")
    return [F.col("c_name").alias("plan_name"), F.when(k % 2 == 0, "ein").otherwise("hios").alias("plan_id_type"), F.expr("CAST(c_custkey DIV 2 AS STRING)").alias("plan_id"), F.col("c_mktsegment").alias("plan_market_type")]


def shared_sets(spark, sf_dir):
    """(file_id, set_id) of files without links of their own, and the entries of sets: five customers' plans."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sets = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("file_id"), F.expr("o_custkey DIV 5").alias("set_id"))
    return sets, c.select(F.expr("c_custkey DIV 5").alias("set_id"), *_plan())


def memberships(spark, sf_dir):
    return listed(spark, sf_dir).distinct()


def listed(spark, sf_dir):
    """Memberships as often as they are listed, for what takes each NPI of a file once by itself."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("file_id"), (F.col("l_suppkey") + 1000000000).cast("string").alias("npi"), F.col("l_partkey").cast("string").alias("tin_value"))


def groups(spark, sf_dir):
    """Provider groups with NPIs of every class, in an order that rows of equal content cannot change."""
    l = table(spark, sf_dir, "lineitem")
    k = F.col("l_suppkey")
    npi = F.when(k % 11 == 0, F.lit("0")).when(k % 11 == 1, (k + 100000000).cast("string")).when(k % 11 == 2, F.lit("x1")).when(k % 11 == 3, F.col("l_partkey").cast("string")).otherwise((k + 1000000000).cast("string"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    tin = F.when(F.col("l_returnflag") == "A", "EIN").when(F.col("l_returnflag") == "R", "npi").otherwise(F.lit(" "))
    return l.select(F.col("l_orderkey").alias("file_id"), order.alias("ord"), tin.alias("tin_type"), (F.col("l_partkey") % 50).cast("string").alias("tin_value"), F.array(npi, (k + 1000000000).cast("string")).alias("npi"))


FILES = """
files AS (
  SELECT o_orderkey AS file_id, o_orderstatus <> 'P' AS active, CAST(o_orderdate AS TIMESTAMP) AS source_last_updated, n_name AS reporting_entity,
    'https://files.example/' || n_name || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || CAST(o_orderkey AS VARCHAR) || '.json.gz?Signature=s&v=' || CAST(o_orderkey % 3 AS VARCHAR) AS url,
    CAST(floor(o_totalprice) AS BIGINT) * 10000 AS bytes FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
_PLAN = "c_name AS plan_name, CASE WHEN c_custkey % 2 = 0 THEN 'ein' ELSE 'hios' END AS plan_id_type, CAST(c_custkey // 2 AS VARCHAR) AS plan_id, c_mktsegment AS plan_market_type"
LINKS = f"""
links AS (SELECT o_orderkey AS file_id, {_PLAN} FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 > 0)"""
SETS = f"""
sets AS (SELECT o_orderkey AS file_id, o_custkey // 5 AS set_id FROM orders WHERE o_orderkey % 3 = 0),
entries AS (SELECT c_custkey // 5 AS set_id, {_PLAN} FROM customer)"""
MEMBERS = """
memberships AS (SELECT DISTINCT l_orderkey AS file_id, CAST(l_suppkey + 1000000000 AS VARCHAR) AS npi, CAST(l_partkey AS VARCHAR) AS tin_value FROM lineitem)"""
GROUPS = """
gx AS (
  SELECT l_orderkey AS file_id, [l_orderkey, l_linenumber, l_partkey, l_suppkey] AS ord, l_returnflag, CASE l_returnflag WHEN 'A' THEN 'ein' WHEN 'R' THEN 'npi' ELSE '' END AS tin_type, CAST(l_partkey % 50 AS VARCHAR) AS tin_value, pos,
    CASE WHEN pos = 1 THEN CAST(l_suppkey + 1000000000 AS VARCHAR) WHEN l_suppkey % 11 = 0 THEN '0' WHEN l_suppkey % 11 = 1 THEN CAST(l_suppkey + 100000000 AS VARCHAR) WHEN l_suppkey % 11 = 2 THEN 'x1' WHEN l_suppkey % 11 = 3 THEN CAST(l_partkey AS VARCHAR) ELSE CAST(l_suppkey + 1000000000 AS VARCHAR) END AS npi
  FROM lineitem CROSS JOIN range(2) t(pos)
), classed AS (
  SELECT *, CASE WHEN npi = '0' THEN 'zero' WHEN regexp_full_match(npi, '[0-9]{9}') THEN 'tin' WHEN NOT regexp_full_match(npi, '[0-9]{10}') THEN 'malformed' WHEN tin_type = 'ein' AND npi = tin_value THEN 'tin' ELSE 'ok' END AS class
  FROM gx WHERE tin_type <> ''
)"""


@query("WITH" + GROUPS + """
SELECT file_id, npi, tin_value, tin_type FROM classed WHERE class = 'ok' QUALIFY row_number() OVER (PARTITION BY file_id, npi, tin_value ORDER BY ord, l_returnflag, pos) = 1""")
def membership_dedup(spark, sf_dir):
    return nf.extract_memberships(groups(spark, sf_dir))[0]


@query("WITH" + GROUPS + """
SELECT file_id, count(*) FILTER (WHERE class = 'zero') AS n_zero, count(*) FILTER (WHERE class = 'tin') AS n_tin, count(*) FILTER (WHERE class = 'malformed') AS n_malformed, count(*) FILTER (WHERE class = 'ok') AS n_ok FROM classed GROUP BY file_id""")
def npi_validity_classes(spark, sf_dir):
    return nf.extract_memberships(groups(spark, sf_dir))[1]


@query("""
WITH uses AS (SELECT l_orderkey % 50 AS file_id, l_partkey % 300 AS ref_id, min(l_orderkey * 100 + l_linenumber) AS ord FROM lineitem GROUP BY ALL),
refs AS (SELECT o_custkey % 50 AS file_id, o_orderkey % 250 AS ref_id, max(o_orderkey) AS ord FROM orders GROUP BY ALL)
SELECT r.file_id, r.ref_id, u.ord, 'G' || CAST(r.ord AS VARCHAR) AS name FROM refs r JOIN uses u USING (file_id, ref_id)""")
def used_reference_groups(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    uses = l.select((F.col("l_orderkey") % 50).alias("file_id"), (F.col("l_partkey") % 300).alias("ref_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    refs = o.select((F.col("o_custkey") % 50).alias("file_id"), (F.col("o_orderkey") % 250).alias("ref_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("G"), F.col("o_orderkey").cast("string")).alias("name"))
    return nf.used_reference_groups(uses, refs)


@query("""
SELECT DISTINCT 'https://files.example/' || CAST(o_orderkey % 40 AS VARCHAR) AS file_url, o_orderpriority AS file_description, c_name AS plan_name, CASE WHEN c_custkey % 2 = 0 THEN 'ein' ELSE 'hios' END AS plan_id_type,
  CAST(c_custkey % 500 AS VARCHAR) AS plan_id, c_mktsegment AS plan_market_type, CAST(c_nationkey AS VARCHAR) AS reporting_entity
FROM customer JOIN orders ON o_custkey = c_custkey""")
def manifest(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    plan = F.array(F.struct(F.col("c_name").alias("plan_name"), F.when(F.col("c_custkey") % 2 == 0, "EIN").otherwise("HIOS").alias("plan_id_type"), (F.col("c_custkey") % 500).cast("string").alias("plan_id"), F.col("c_mktsegment").alias("plan_market_type")))
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(F.concat(F.lit("https://files.example/"), (F.col("o_orderkey") % 40).cast("string")).alias("location"), F.col("o_orderpriority").alias("description"))).alias("files"))
    return nf.build_manifest(c.join(per, "c_custkey").select(F.col("c_nationkey").cast("string").alias("reporting_entity"), plan.alias("plans"), "files"))


COUNTED = "WITH" + FILES + "," + LINKS + """,
counted AS (
  SELECT f.*, coalesce(n, 0) AS plan_count FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM (SELECT DISTINCT file_id, plan_id_type, plan_id, plan_market_type, plan_name FROM links) GROUP BY file_id) USING (file_id)
)
"""


def _counted(spark, sf_dir):
    return nf.plan_counts(files(spark, sf_dir), links(spark, sf_dir))


@query(COUNTED + "SELECT file_id, plan_count FROM counted")
def manifest_plan_count(spark, sf_dir):
    return _counted(spark, sf_dir).select("file_id", "plan_count")


@query(COUNTED + "SELECT file_id, plan_count, bytes FROM counted WHERE plan_count >= 1 AND contains(url, '/1999-') AND bytes > 0 AND bytes <= 2000000000")
def tiering_a(spark, sf_dir):
    return nf.tiers(_counted(spark, sf_dir), 1, 2_000_000_000, "/1999-")[0].select("file_id", "plan_count", "bytes")


@query(COUNTED + "SELECT file_id, plan_count, bytes FROM counted WHERE plan_count >= 1 AND contains(url, '/1999-') AND bytes > 2000000000")
def tiering_b(spark, sf_dir):
    return nf.tiers(_counted(spark, sf_dir), 1, 2_000_000_000, "/1999-")[1].select("file_id", "plan_count", "bytes")


PLAN_FILES = "WITH" + FILES + "," + LINKS + "," + SETS + "," + MEMBERS + """,
wanted AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'ein' ELSE 'hios' END AS plan_id_type, CAST(c_custkey // 2 AS VARCHAR) AS plan_id FROM customer),
plan_files AS (
  SELECT file_id, plan_id_type, plan_id, active, source_last_updated FROM (
    SELECT plan_id_type, plan_id, file_id FROM links JOIN wanted USING (plan_id_type, plan_id) UNION SELECT plan_id_type, plan_id, file_id FROM entries JOIN wanted USING (plan_id_type, plan_id) JOIN sets USING (set_id))
  JOIN files USING (file_id) WHERE active
)"""


def _plan_files(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(*_plan()[1:3])
    sets, entries = shared_sets(spark, sf_dir)
    return nf.plan_files(files(spark, sf_dir), links(spark, sf_dir), sets, entries, wanted)


@query(PLAN_FILES + "\nSELECT file_id, plan_id_type, plan_id FROM plan_files")
def plan_files(spark, sf_dir):
    return _plan_files(spark, sf_dir).select("file_id", "plan_id_type", "plan_id")


@query(PLAN_FILES + f""",
requests AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 2 = 0 THEN 'ein' ELSE 'hios' END AS plan_id_type, CAST(c_custkey // 2 AS VARCHAR) AS plan_id, CAST(1000000000 + c_custkey % 100 AS VARCHAR) AS npi FROM customer),
r AS (
  SELECT q.*, f.file_id, f.source_last_updated AS d, m.file_id IS NOT NULL AS present, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(f.source_last_updated)) / 86400000000.0::DOUBLE AS age
  FROM requests q LEFT JOIN plan_files f USING (plan_id_type, plan_id) LEFT JOIN (SELECT DISTINCT file_id, npi FROM memberships) m ON m.file_id = f.file_id AND m.npi = q.npi
), g AS (
  SELECT request_id, plan_id, npi, count(file_id) AS files, count(*) FILTER (WHERE present) AS matched, count(*) FILTER (WHERE present AND age BETWEEN 0 AND 60) AS listed, count(*) FILTER (WHERE age BETWEEN 0 AND 60) AS cur,
    count(*) FILTER (WHERE age < 0) AS undated, count(*) FILTER (WHERE present AND age < 0) AS mundated, max(d) FILTER (WHERE present AND age BETWEEN 0 AND 60) AS freshest FROM r GROUP BY ALL
)
SELECT request_id, plan_id, npi, files, matched, CASE WHEN files = 0 THEN 'plan_missing' WHEN listed > 0 THEN 'listed' WHEN matched > 0 OR cur = 0 THEN (CASE WHEN (CASE WHEN matched > 0 THEN mundated ELSE undated END) > 0 THEN 'source_date_unknown' ELSE 'source_stale' END)
  ELSE 'incomplete_index' END AS evidence, CASE WHEN listed > 0 THEN 'yes' ELSE 'unknown' END AS value, strftime(freshest, '%Y-%m-%d') AS freshest FROM g""")
def tic_evidence(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    requests = c.select(F.col("c_custkey").alias("request_id"), *_plan()[1:3], (F.col("c_custkey") % 100 + 1000000000).cast("string").alias("npi"))
    out = nf.evidence(requests, _plan_files(spark, sf_dir).select("file_id", "plan_id_type", "plan_id", "source_last_updated"), memberships(spark, sf_dir), as_of())
    return out.withColumn("freshest", F.date_format("freshest", "yyyy-MM-dd"))


ELIGIBLE = "WITH" + FILES + "," + LINKS + "," + MEMBERS + f""",
idx AS (SELECT file_id, count(*) % 3 AS npi_count FROM memberships WHERE file_id % 2 = 0 GROUP BY file_id),
fresh AS (SELECT * FROM files WHERE active AND (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(source_last_updated)) / 86400000000.0::DOUBLE BETWEEN 0 AND 60),
eligible AS (
  SELECT * FROM fresh WHERE file_id IN (SELECT file_id FROM idx WHERE npi_count > 0) UNION SELECT * FROM fresh WHERE file_id NOT IN (SELECT file_id FROM idx) AND file_id IN (SELECT file_id FROM memberships)
)"""


def _eligible(spark, sf_dir):
    m = memberships(spark, sf_dir)
    index = m.where("file_id % 2 = 0").groupBy("file_id").agg((F.count("*") % 3).alias("npi_count"))
    return nf.eligible_files(files(spark, sf_dir), m, index, as_of())


@query(ELIGIBLE + "\nSELECT file_id, reporting_entity, url FROM eligible")
def eligible_files(spark, sf_dir):
    return _eligible(spark, sf_dir).select("file_id", "reporting_entity", "url")


@query(ELIGIBLE + """,
turns AS (SELECT file_id, reporting_entity, row_number() OVER (PARTITION BY reporting_entity ORDER BY file_id) AS turn FROM eligible)
SELECT file_id, reporting_entity, CAST(turn AS INTEGER) AS turn FROM turns ORDER BY turn, reporting_entity, file_id LIMIT 40""")
def plan_search_interleave(spark, sf_dir):
    turn = F.row_number().over(Window.partitionBy("reporting_entity").orderBy("file_id"))
    return _eligible(spark, sf_dir).select("file_id", "reporting_entity", turn.alias("turn")).orderBy("turn", "reporting_entity", "file_id").limit(40)


@query(ELIGIBLE + """,
turns AS (SELECT file_id, reporting_entity, row_number() OVER (PARTITION BY reporting_entity ORDER BY file_id) AS turn FROM eligible)
SELECT file_id, reporting_entity, turn, row_number() OVER (ORDER BY turn, reporting_entity, file_id) AS place FROM turns""")
def plan_search_interleave_all(spark, sf_dir):
    turns = ranked_within(_eligible(spark, sf_dir).select("file_id", "reporting_entity"), "reporting_entity", [F.asc("file_id")], "turn")
    return ranked(turns, [F.asc("turn"), F.asc("reporting_entity"), F.asc("file_id")], "place")


@query(ELIGIBLE + """,
turns AS (SELECT file_id, reporting_entity, row_number() OVER (PARTITION BY reporting_entity ORDER BY file_id) AS turn FROM eligible),
hits AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY plan_name, plan_id_type, plan_id) AS n FROM links JOIN turns USING (file_id) WHERE contains(lower(plan_name), '#00000') QUALIFY n <= 24),
found AS (SELECT * FROM hits ORDER BY turn, reporting_entity, file_id, n LIMIT 288)
SELECT plan_id_type, plan_id, plan_name, min(plan_market_type) AS market, min(reporting_entity) AS issuer FROM found GROUP BY ALL ORDER BY plan_name, plan_id_type, plan_id LIMIT 12""")
def plan_search(spark, sf_dir):
    return nf.search_plans(_eligible(spark, sf_dir), links(spark, sf_dir), " #00000 ")


@query(ELIGIBLE + "," + SETS + """,
turns AS (SELECT file_id, reporting_entity, row_number() OVER (PARTITION BY reporting_entity ORDER BY file_id) AS turn FROM eligible WHERE file_id NOT IN (SELECT file_id FROM sets)),
hits AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY plan_name, plan_id_type, plan_id) AS n FROM links JOIN turns USING (file_id) WHERE contains(lower(plan_name), '#00000') QUALIFY n <= 24),
found AS (SELECT * FROM hits ORDER BY turn, reporting_entity, file_id, n LIMIT 288),
issuers AS (SELECT set_id, arg_min(reporting_entity, file_id) AS reporting_entity FROM eligible JOIN sets USING (file_id) GROUP BY set_id),
candidates AS (
  SELECT plan_id_type, plan_id, plan_name, plan_market_type, reporting_entity FROM found
  UNION ALL SELECT plan_id_type, plan_id, plan_name, plan_market_type, reporting_entity FROM entries JOIN issuers USING (set_id) WHERE contains(lower(plan_name), '#00000')
)
SELECT plan_id_type, plan_id, plan_name, min(plan_market_type) AS market, min(reporting_entity) AS issuer FROM candidates GROUP BY ALL ORDER BY plan_name, plan_id_type, plan_id LIMIT 12""")
def plan_search_shared(spark, sf_dir):
    """As plan_search, and the plans of files with a shared set."""
    sets, entries = shared_sets(spark, sf_dir)
    return nf.search_plans(_eligible(spark, sf_dir), links(spark, sf_dir), " #00000 ", sets=sets, set_entries=entries)


@query("WITH" + MEMBERS + """
SELECT file_id, prefix, count(*) AS n, sha256(string_agg(suffix, chr(10) ORDER BY suffix) || chr(10)) AS raw_sha256 FROM (SELECT DISTINCT file_id, npi[1:4] AS prefix, npi[5:10] AS suffix FROM memberships) GROUP BY ALL""")
def compact_buckets(spark, sf_dir):
    return nf.compact_buckets(listed(spark, sf_dir))


@query("WITH" + MEMBERS + """,
requests AS (SELECT o_orderkey AS file_id, CAST(1000000000 + o_orderkey % 100 AS VARCHAR) AS npi FROM orders)
SELECT r.file_id, r.npi, m.npi IS NOT NULL AS found FROM requests r LEFT JOIN (SELECT DISTINCT file_id, npi FROM memberships) m USING (file_id, npi)""")
def compact_lookup(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") % 100 + 1000000000).cast("string").alias("npi"))
    return nf.compact_lookup(requests, listed(spark, sf_dir))


@query("WITH" + MEMBERS + """
SELECT file_id, count(*) AS n, sha256(string_agg(npi, chr(10) ORDER BY npi) || chr(10)) AS digest FROM (SELECT DISTINCT file_id, npi FROM memberships) GROUP BY file_id""")
def npi_set_digest(spark, sf_dir):
    return nf.set_digest(memberships(spark, sf_dir), ["file_id"], "npi")


@query("WITH" + SETS + """,
rows AS (SELECT DISTINCT set_id AS file_id, unhex(printf('%08x', strlen(plan_name))) || encode(plan_name) || unhex(printf('%08x', strlen(plan_id_type))) || encode(plan_id_type) || unhex(printf('%08x', strlen(plan_id))) || encode(plan_id)
  || unhex(printf('%08x', strlen(plan_market_type))) || encode(plan_market_type) AS row FROM entries)
SELECT file_id, CAST(count(*) AS INTEGER) AS plans, sha256(unhex(hex('plan-set/1') || string_agg(sha256(row), '' ORDER BY row))) AS set_id FROM rows GROUP BY file_id""")
def plan_set_digest(spark, sf_dir):
    return nf.plan_set_ids(shared_sets(spark, sf_dir)[1].withColumnRenamed("set_id", "file_id"))


@query("WITH" + FILES + """,
l AS (SELECT file_id, regexp_replace('https://files.example/' || reporting_entity || '/' || strftime(source_last_updated, '%Y-%m-%d') || '/' || CAST(file_id % 7 AS VARCHAR), '[0-9]{4}-[0-9]{2}-[0-9]{2}', '{date}', 'g') AS key, source_last_updated FROM files),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_last_updated DESC, file_id DESC) AS n FROM l)
SELECT file_id, key, CASE WHEN n = 1 THEN 'active' WHEN n = 2 THEN 'rollback' ELSE 'retired' END AS role FROM n""")
def ledger_generations(spark, sf_dir):
    f = files(spark, sf_dir)
    key = F.concat(F.lit("https://files.example/"), "reporting_entity", F.lit("/"), F.date_format("source_last_updated", "yyyy-MM-dd"), F.lit("/"), (F.col("file_id") % 7).cast("string"))
    ledger = f.select("file_id", key.alias("stable_key"), F.col("source_last_updated").alias("source_date"), F.col("file_id").alias("created"))
    return publication.generations(ledger).select("file_id", "key", "role")


@query("WITH" + FILES + """
SELECT file_id, split_part(url, '?', 1) || '?query-sha256=' || sha256('v=' || CAST(file_id % 3 AS VARCHAR)) AS identity, CAST(file_id AS VARCHAR) AS shard FROM files""")
def url_identities(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", url_identity(F.col("url")).alias("identity"), shard_name(F.col("url")).alias("shard"))


@query("""
WITH a AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(ts AS TIMESTAMP) AS source_date, (event_id * 7919) % 100003 AS arrival FROM events)
SELECT key, arrival, coalesce(source_date < max(source_date) OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS regression FROM a""")
def late_regression_drop(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("source_date"), (F.col("event_id") * 7919 % 100003).alias("arrival"))
    return publication.regressions(e).select("key", "arrival", "regression")


@query("WITH" + FILES + """
SELECT reporting_entity, CAST(sum(bytes) FILTER (WHERE active) AS BIGINT) AS active_bytes, CAST(sum(bytes) FILTER (WHERE active) AS BIGINT) + 1000000 <= 1000000000000 AS fits FROM files GROUP BY reporting_entity""")
def publication_capacity(spark, sf_dir):
    g = files(spark, sf_dir).groupBy("reporting_entity").agg(F.sum(F.when(F.col("active"), F.col("bytes"))).alias("active_bytes"))
    return g.withColumn("fits", publication.capacity_ok(F.col("active_bytes"), F.lit(1_000_000), 1_000_000_000_000))

