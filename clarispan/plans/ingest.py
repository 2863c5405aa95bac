"""Queries over sources, sinks, checks of documents, gates, admissions and eligibility."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from clarispan.operators import admission, checks, contents, eligibility, formulary, network_files, publication, quotas, registries, serving, watch
from clarispan.plans.base import query, table
from clarispan.plans.formularies import DRUGS, formulary_drugs, suggestion_responses
from clarispan.plans.network import FILES, GROUPS, LINKS, files, groups, links
from clarispan.plans.registers import EMPLOYERS, PAGE_TEXT, employer_rows
from clarispan.shared import materialise, shared_folder
from clarispan.sources import catalogs, sinks, text
from clarispan.sources.strict_json import with_problems


def place(spark, name):
    """A new folder for files that a query writes and reads back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Endings of a document: what follows its first members, what that makes of it, and the place after them.
_ENDS = (
    ("}", None, None), (', "a": [1 2]}', "syntax", 10), (', "b": {"x" 1}}', "syntax", 12), (', "text": 1}', "duplicate_key", 2), ("} x", "syntax", 2), (', "a": ' + "[" * 64 + "]" * 64 + "}", "depth", 70), ("", "end", 0),
    (', "a": [1,,2]}', "syntax", 10), (', "a": 01}', "syntax", 8), (', "a": tru}', "syntax", 7), ("} {}", "trailing", 2), (', "a": "\t"}', "syntax", 8), (', "a": "\\u00e9\\n", "n": [1, -2.5e+3, true, null, {}]}', None, None),
)


@query(f"""
WITH d AS (
  SELECT doc_id, '{{"id": ' || CAST(doc_id AS VARCHAR) || ', "text": "' AS head, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g') AS t, doc_id % {len(_ENDS)} AS k FROM documents
)
SELECT doc_id, CASE WHEN strlen(t) > 65536 THEN 'scalar' ELSE CASE k {" ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind, _) in enumerate(_ENDS) if kind)} END END AS problem,
  CASE WHEN strlen(t) > 65536 THEN length(head) - 1 ELSE CASE k {" ".join(f"WHEN {i} THEN length(head) + length(t) + 1 + {at}" for i, (_, kind, at) in enumerate(_ENDS) if kind)} END END AS at
FROM d""")
def json_document_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "")
    end = F.get(F.array(*[F.lit(e) for e, _, _ in _ENDS]), (F.col("doc_id") % len(_ENDS)).cast("int"))
    json = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "text": "'), t, F.lit('"'), end)
    return with_problems(d.select("doc_id", json.alias("json"))).select("doc_id", "problem", "at")


@query("""
WITH RECURSIVE e AS (
  SELECT CAST(user_id % 16 AS VARCHAR) AS site, CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) AS t, 'v' || CAST(user_id AS VARCHAR) AS v, 'n' || CAST(event_id % 5 AS VARCHAR) AS n,
    epoch_us(date_trunc('month', ts)) AS mon, epoch_us(date_trunc('day', ts)) AS day, epoch_us(date_trunc('month', ts) + INTERVAL 1 MONTH) AS next_mon,
    row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, CAST(event_id AS VARCHAR)) AS i
  FROM events
), step AS (
  SELECT DISTINCT site, 0::BIGINT AS i, []::STRUCT(t BIGINT, v VARCHAR, n VARCHAR)[] AS kept, ''::VARCHAR AS event_id, 0::BIGINT AS t, 0::BIGINT AS day, 0::BIGINT AS next_mon, ''::VARCHAR AS reason FROM e
  UNION ALL
  SELECT site, i, CASE WHEN reason = '' THEN list_append(kept, {'t': t, 'v': v, 'n': n}) ELSE kept END, event_id, t, day, next_mon, reason
  FROM (
    SELECT *, CASE WHEN len(kept) >= 2000 THEN 'site month' WHEN len(list_filter(kept, lambda x: x.t >= day)) >= 100 THEN 'site day'
        WHEN len(mine) >= 50 THEN 'visitor month' WHEN len(list_filter(mine, lambda x: x.t >= day)) >= 10 THEN 'visitor day' WHEN len(list_filter(mine, lambda x: x.t >= t - 60000000)) >= 3 THEN 'visitor minute'
        WHEN len(nets) >= 150 THEN 'network month' WHEN len(list_filter(nets, lambda x: x.t >= day)) >= 30 THEN 'network day' WHEN len(list_filter(nets, lambda x: x.t >= t - 60000000)) >= 10 THEN 'network minute' ELSE '' END AS reason
    FROM (
      SELECT *, list_filter(kept, lambda x: x.v = v) AS mine, list_filter(kept, lambda x: x.n = n) AS nets
      FROM (SELECT s.site, e.i, list_filter(s.kept, lambda x: x.t >= e.mon) AS kept, e.event_id, e.t, e.v, e.n, e.day, e.next_mon FROM step s JOIN e ON e.site = s.site AND e.i = s.i + 1)
    )
  )
)
SELECT site, event_id, reason = '' AS accepted, split_part(reason, ' ', 1) AS scope, split_part(reason, ' ', 2) AS "limit",
  CASE split_part(reason, ' ', 2) WHEN '' THEN 0 WHEN 'minute' THEN 60 WHEN 'day' THEN greatest(1, CAST(ceil((day + 86400000000 - t) / 1000000.0) AS BIGINT)) ELSE greatest(1, CAST(ceil((next_mon - t) / 1000000.0) AS BIGINT)) END AS retry_after
FROM step WHERE i > 0""")
def gate_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 16).alias("site"), "event_id", F.col("ts").alias("created"), F.concat(F.lit("v"), "user_id").alias("visitor"), F.concat(F.lit("n"), F.col("event_id") % 5).alias("network"))
    return quotas.replay(e).drop("created")


@query("""
WITH RECURSIVE c AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id AS arrival, event_type = 'purchase' AS back, 'g' || CAST(event_id AS VARCHAR) AS g, strftime(ts - to_days(CAST(event_id % 4 AS INTEGER)), '%Y-%m-%d') AS d,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i
  FROM events
), step AS (
  SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS arrival, NULL::VARCHAR AS a, NULL::VARCHAR AS ad, NULL::VARCHAR AS r, NULL::VARCHAR AS rd, []::VARCHAR[] AS out FROM c
  UNION ALL
  SELECT s.key, c.i, c.arrival,
    CASE WHEN c.back THEN CASE WHEN s.a IS NULL OR s.r IS NULL THEN s.a ELSE s.r END WHEN c.d < s.ad THEN s.a ELSE c.g END, CASE WHEN c.back THEN CASE WHEN s.a IS NULL OR s.r IS NULL THEN s.ad ELSE s.rd END WHEN c.d < s.ad THEN s.ad ELSE c.d END,
    CASE WHEN c.back THEN CASE WHEN s.a IS NULL OR s.r IS NULL THEN s.r END WHEN c.d < s.ad THEN s.r ELSE s.a END, CASE WHEN c.back THEN CASE WHEN s.a IS NULL OR s.r IS NULL THEN s.rd END WHEN c.d < s.ad THEN s.rd ELSE s.ad END,
    CASE WHEN c.back THEN CASE WHEN s.a IS NULL OR s.r IS NULL THEN [coalesce(s.a, '') || ' refused'] ELSE [s.a || ' withdrawn', s.r || ' active'] END
      WHEN c.d < s.ad THEN [c.g || ' regression'] ELSE list_filter([c.g || ' active', s.a || ' rollback', s.r || ' retired'], lambda x: x IS NOT NULL) END
  FROM step s JOIN c ON c.key = s.key AND c.i = s.i + 1
)
SELECT key, arrival, split_part(o, ' ', 1) AS generation, split_part(o, ' ', 2) AS role FROM (SELECT key, arrival, unnest(out) AS o FROM step WHERE i > 0)""")
def generation_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    back = F.expr("timestampadd(DAY, -CAST(event_id % 4 AS INT), ts)")
    return publication.role_changes(e.select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("arrival"), F.when(F.col("event_type") == "purchase", "withdraw").otherwise("publish").alias("action"),
        F.concat(F.lit("g"), "event_id").alias("generation"), F.date_format(back, "yyyy-MM-dd").alias("source_date")))


@query("""
WITH uses AS (SELECT l_orderkey % 50 AS file_id, CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(l_partkey % 300 AS VARCHAR) END AS ref_id FROM lineitem),
refs AS (SELECT o_custkey % 50 AS file_id, CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE CAST(o_orderkey % 290 AS VARCHAR) END AS ref_id, o_orderkey % 43 = 0 AS none FROM orders),
r AS (SELECT file_id, ref_id, count(*) AS n, count(*) FILTER (WHERE none) AS none FROM refs GROUP BY ALL), u AS (SELECT file_id, ref_id, count(*) AS uses FROM uses GROUP BY ALL),
b AS (SELECT coalesce(r.file_id, u.file_id) AS file_id, coalesce(r.ref_id, u.ref_id) AS ref_id, n, none, coalesce(uses, 0) AS uses FROM r FULL JOIN u ON r.file_id = u.file_id AND r.ref_id IS NOT DISTINCT FROM u.ref_id)
SELECT file_id, ref_id, uses, CASE WHEN n IS NULL THEN 'unresolved' WHEN trim(ref_id) = '' THEN 'without id' WHEN none > 0 THEN 'without groups' ELSE 'twice' END AS problem FROM b WHERE n IS NULL OR trim(ref_id) = '' OR none > 0 OR n > 1""")
def reference_closure(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    uses = l.select((F.col("l_orderkey") % 50).alias("file_id"), F.when(F.col("l_partkey") % 97 != 0, (F.col("l_partkey") % 300).cast("string")).alias("ref_id"), F.col("l_orderkey").alias("ord"))
    k = F.col("o_orderkey")
    refs = o.select((F.col("o_custkey") % 50).alias("file_id"), F.when(k % 31 == 0, " ").otherwise((k % 290).cast("string")).alias("ref_id"), k.alias("ord"), F.when(k % 43 != 0, F.array(F.lit(1))).alias("gs"))
    return network_files.closure_problems(uses, refs)


CONTENTS = "WITH" + FILES + "," + LINKS + """,
chosen AS (SELECT reporting_entity, min(url) AS url FROM files GROUP BY 1),
wanted AS (
  SELECT CASE WHEN length(reporting_entity) % 2 = 0 THEN replace(url, 'https://files.example', '') ELSE replace(url, 'Signature=s', 'Expires=9') END AS requested, replace(url, 'Signature=s&', '') AS found FROM chosen
), met AS (SELECT requested, w.found, f.file_id, f.url FROM wanted w JOIN files f ON replace(f.url, 'Signature=s&', '') = w.found)
"""
_NO_PLANS = "array<struct<plan_name:string,plan_id_type:string,plan_id:string,plan_market_type:string>>"


def _structures(spark, sf_dir):
    """A file's plans and the file; each file is named by one structure a plan."""
    plan = F.struct("plan_name", F.upper("plan_id_type").alias("plan_id_type"), "plan_id", "plan_market_type")
    rows = links(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "url"), "file_id", "right")
    return rows.select(F.when(F.col("plan_id").isNull(), F.array().cast(_NO_PLANS)).otherwise(F.array(plan)).alias("plans"), F.array(F.struct(F.col("url").alias("location"), F.lit("d").alias("description"))).alias("files"))


def _selected(spark, sf_dir):
    """A file of each reporting entity: by its path or by its URL under another signature."""
    chosen = files(spark, sf_dir).groupBy("reporting_entity").agg(F.min("url").alias("url"))
    by_path = F.replace("url", F.lit("https://files.example"), F.lit(""))
    return chosen.select(F.when(F.length("reporting_entity") % 2 == 0, by_path).otherwise(F.replace("url", F.lit("Signature=s"), F.lit("Expires=9"))).alias("requested"))


@query(CONTENTS + "SELECT DISTINCT requested, plan_id_type, plan_id, plan_name, plan_market_type FROM met JOIN links USING (file_id)")
def selected_plans(spark, sf_dir):
    return contents.selected_contents(_structures(spark, sf_dir), _selected(spark, sf_dir))[0]


@query(CONTENTS + """
SELECT requested, found, plans, CAST(1 AS BIGINT) AS "references", CASE WHEN plans = 0 THEN 'no plans' END AS problem
FROM (SELECT requested, found, count(DISTINCT plan_id_type || ' ' || plan_id || ' ' || plan_name) AS plans FROM met LEFT JOIN links USING (file_id) GROUP BY ALL)""")
def selected_files(spark, sf_dir):
    return contents.selected_contents(_structures(spark, sf_dir), _selected(spark, sf_dir))[1]


@query("""
WITH RECURSIVE h AS (
  SELECT 'https://r.example/' || CAST(o_orderkey AS VARCHAR) AS location, CASE o_orderkey % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' ELSE 'unknown' END AS schema,
    CASE o_orderkey % 4 WHEN 2 THEN 'https://r.example/' || CAST(o_orderkey + 1 AS VARCHAR) WHEN 3 THEN CASE WHEN o_orderkey % 8 = 3 THEN 'https://r.example/' || CAST(o_orderkey + 5 AS VARCHAR) END END AS next
  FROM orders
), go AS (
  SELECT location, location AS at, 0 AS step FROM (SELECT 'https://r.example/' || CAST(o_orderkey + 2 AS VARCHAR) AS location FROM orders)
  UNION ALL SELECT g.location, h.next, g.step + 1 FROM go g JOIN h ON h.location = g.at WHERE h.schema = 'unknown' AND h.next IS NOT NULL AND g.step < 2
), last AS (SELECT * FROM go QUALIFY row_number() OVER (PARTITION BY location ORDER BY step DESC) = 1)
SELECT l.location, h.schema, l.step AS steps FROM last l LEFT JOIN h ON h.location = l.at""")
def probed_schemas(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = lambda n: F.concat(F.lit("https:\\/\\/r.example\\/"), (k + n).cast("string"))
    head = (
        F.when(k % 4 == 0, '{"provider_references": [{').when(k % 4 == 1, '{"in_network": [{"negotiated_rates": [{"provider_groups": [').when(k % 4 == 2, F.concat(F.lit('{"x": {"location" : "'), at(1), F.lit('"}}')))
        .when(k % 8 == 3, F.concat(F.lit('{"location": "/relative", "y": {"location":"https://r.example/'), (k + 5).cast("string"), F.lit('", "location": "https://r.example/0"}}'))).otherwise('{"location": "ftp://r.example/1"}'))
    name = lambda n: F.concat(F.lit("https://r.example/"), (k + n).cast("string")).alias("location")
    return contents.probed_schemas(o.select(name(2)), o.select(name(0), head.alias("text")))


# Facts of a customer's request, by the key's remainders.
_REQUEST = """
req AS (
  SELECT c_custkey AS request_id, CASE WHEN c_custkey % 23 = 0 THEN 'ZZ' ELSE ['oh', 'PA', 'TX', 'CA', 'NY'][c_custkey % 5 + 1] END AS state0, CASE WHEN c_custkey % 17 = 0 THEN '99999' ELSE '4' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') END AS zip,
    CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 1 END AS household_size, CASE WHEN c_custkey % 41 = 0 THEN 2020 ELSE 2026 END AS year, c_custkey % 19 <> 0 AS live,
    c_custkey % 7 = 0 AS medicaid, CASE WHEN c_custkey % 6 = 0 THEN 0.0 ELSE abs(c_acctbal) END AS aptc, c_custkey % 29 = 0 AS gap, c_custkey % 4 AS plans, c_custkey % 3 AS c3, c_custkey % 43 = 0 AS none FROM customer
)"""


@query("WITH" + _REQUEST + """,
place AS (SELECT '4' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS zip, ['OH', 'PA', 'TX'][n_nationkey % 3 + 1] AS cs, n_name AS county, n_nationkey % 6 = 5 AS two FROM nation),
x AS (SELECT r.*, upper(state0) AS state, p.cs, p.county || ', ' || p.cs AS place, p.two, CASE WHEN none THEN 0 ELSE CAST(floor(aptc + 0.5) AS BIGINT) END AS credit, CASE WHEN p.cs IS NULL THEN 'not_found' WHEN p.cs <> upper(state0) THEN 'state_mismatch' WHEN p.two THEN 'ambiguous' ELSE 'unique' END AS found
  FROM req r LEFT JOIN place p USING (zip)),
v AS (SELECT *, CASE WHEN year <> 2026 THEN 0 WHEN state = 'ZZ' THEN 1 WHEN household_size > 1 THEN 2 WHEN state IN ('CA', 'NY') THEN 3 WHEN NOT live THEN 4 WHEN found = 'not_found' THEN 5 WHEN found = 'state_mismatch' THEN 6 WHEN found = 'ambiguous' THEN 7
    WHEN none THEN 12 WHEN gap THEN 8 WHEN medicaid THEN 9 WHEN credit > 0 THEN 10 WHEN plans > 0 THEN 11 ELSE 12 END AS rule FROM x)
SELECT request_id, rule, ['unsupported_year', 'unsupported_state', 'official_handoff', 'state_marketplace', 'official_handoff', 'unknown', 'unknown', 'official_handoff', 'coverage_gap', 'medicaid', 'marketplace', 'marketplace', 'unknown'][rule + 1] AS verdict,
  CASE rule WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'For a household of two or more, use the official application for an accurate coverage estimate.'
    WHEN 3 THEN 'State ' || state || ' makes its own Medicaid and Marketplace decisions, so we won''t guess from federal-only data.' WHEN 4 THEN 'Program ' || state || ' can make the official coverage decision—we won''t guess while the live estimate is unavailable.'
    WHEN 5 THEN 'We couldn''t find a county for ZIP ' || zip || '. Double-check the ZIP.' WHEN 6 THEN 'That ZIP does not appear to be in ' || state || '.' WHEN 7 THEN 'This ZIP spans multiple counties, so we won''t choose a Marketplace rating area for you.'
    WHEN 8 THEN 'Your income may fall in a coverage gap in ' || place || ' — a Navigator can help.' WHEN 9 THEN 'At this income you may qualify for Medicaid in ' || place || '.'
    WHEN 10 THEN 'You likely qualify for a subsidy of about $' || format('{:,}', credit) || '/month toward a Marketplace plan in ' || place || '.' WHEN 11 THEN 'Marketplace plans may be an option in ' || place || '; confirm your eligibility through the official application.'
    ELSE 'We couldn''t determine eligibility from these inputs in ' || place || '.' END AS headline,
  [0, 0, 2, 2, 2, 1, 1, 2, 1, 2, 2, 2, 1][rule + 1] AS steps, [0, 0, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 1][rule + 1] + CASE WHEN rule IN (10, 11) AND c3 = 0 THEN 1 ELSE 0 END AS notes,
  CASE WHEN state = 'OH' AND rule IN (8, 12) THEN 'getcoveredohio.org' WHEN rule IN (8, 12) THEN 'localhelp.healthcare.gov' ELSE '' END AS navigator,
  CAST(CASE WHEN rule >= 8 THEN credit ELSE 0 END AS BIGINT) AS aptc_monthly, rule >= 8 AND medicaid AND NOT none AS medicaid_eligible, rule >= 8 AND gap AND NOT none AS in_coverage_gap FROM v""")
def eligibility_answers(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    zip_ = lambda x: F.concat(F.lit("4"), F.lpad(x.cast("string"), 4, "0"))
    requests = c.select(
        k.alias("request_id"), F.when(k % 23 == 0, "ZZ").otherwise(F.get(F.array(*map(F.lit, ("oh", "PA", "TX", "CA", "NY"))), (k % 5).cast("int"))).alias("state"), F.when(k % 17 == 0, "99999").otherwise(zip_(F.col("c_nationkey"))).alias("zip"),
        F.when(k % 13 == 0, 2).otherwise(1).alias("household_size"), F.when(k % 41 == 0, 2020).otherwise(2026).alias("year"), (k % 19 != 0).alias("live"))
    key = F.col("n_nationkey")
    one = F.struct(F.get(F.array(*map(F.lit, ("OH", "PA", "TX"))), (key % 3).cast("int")).alias("county_state"), key.cast("string").alias("fips"), F.col("n_name").alias("county"))
    two = F.when(key % 6 == 5, F.array(one, one.withField("fips", F.lit("x")))).otherwise(F.array(one, one))
    counties = n.select(zip_(key).alias("zip"), F.explode(two).alias("c")).select("zip", "c.*")
    states = n.sparkSession.createDataFrame([(s, f"Program {s}") for s in ("OH", "PA", "TX", "CA", "NY")], "state string, program string")
    own = n.sparkSession.createDataFrame([(2026, s, f"State {s}", f"Market {s}") for s in ("CA", "NY")], "year int, state string, own_state string, own_name string")
    estimates = c.where(k % 43 != 0).select(
        k.alias("request_id"), (k % 7 == 0).alias("medicaid"), F.when(k % 6 == 0, 0.0).otherwise(F.abs("c_acctbal")).alias("aptc"), (k % 29 == 0).alias("gap"), (k % 4).alias("plans"), F.when(k % 3 == 0, F.abs("c_acctbal")).alias("cheapest"))
    found = eligibility.eligibility(requests, counties, states, own, estimates, [2026])
    navigator = F.regexp_extract(F.array_join("next_steps", " "), r"free Navigator \(([^)]*)\)", 1)
    return found.select(
        "request_id", "rule", "verdict", "headline", F.size("next_steps").alias("steps"), F.size("notes").alias("notes"), navigator.alias("navigator"), "aptc_monthly", "medicaid_eligible", "in_coverage_gap")


_CANDIDATES = """
cand AS (
  SELECT o_custkey % 40 AS cycle, o_orderkey AS candidate, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS i, 2000000000 + (o_custkey % 40) * 10000000 AS db,
    CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS m, o_orderkey % 3000 AS p, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE greatest(1, o_orderkey % 3000) END AS rp, o_orderkey % 17 = 0 AS replay,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) * 100 END AS enc, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10500 END AS buckets FROM orders
), priced AS (
  SELECT *, CASE WHEN replay THEN 0 WHEN enc IS NOT NULL THEN enc * 3 + buckets * 1024 + rp * 2000 + 16000000 ELSE m * 1500 + rp * 2000 END AS res,
    CASE WHEN p > 0 AND rp < 1 THEN 'measure' WHEN NOT replay AND enc IS NOT NULL AND (enc > 32000000 OR buckets > 10000) THEN 'compact' WHEN m < 1 OR m > CASE WHEN enc IS NULL THEN 200000 ELSE 5000000 END THEN 'memberships' WHEN p < 1 OR p > 30000 THEN 'plans' END AS bad FROM cand
)"""


def _candidates(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.floor("o_totalprice")
    cycle = F.col("o_custkey") % 40
    return table(spark, sf_dir, "orders").select(
        cycle.alias("cycle"), k.alias("candidate"), price.alias("ord"), (cycle * 10_000_000 + 2_000_000_000).alias("database_bytes"), F.when(k % 11 == 0, 0).otherwise(price).alias("memberships"), (k % 3000).alias("plans"),
        F.when(k % 13 == 0, 0).otherwise(F.greatest(F.lit(1), k % 3000)).alias("reserved_plans"), (k % 17 == 0).alias("replay"), F.when(k % 3 == 0, price * 100).alias("encoded_bytes"), F.when(k % 3 == 0, k % 10500).alias("buckets"))


@query("WITH" + _CANDIDATES + """
SELECT candidate, res AS reserved_bytes, db + res AS projected_bytes, coalesce(bad, CASE WHEN NOT replay AND db + res > 2500000000 THEN 'database' END) AS problem FROM priced""")
def publication_capacity_gate(spark, sf_dir):
    return admission.capacity(_candidates(spark, sf_dir)).select("candidate", "reserved_bytes", "projected_bytes", "problem")


@query("WITH RECURSIVE" + _CANDIDATES + """,
step AS (
  SELECT DISTINCT cycle, 0::BIGINT AS i, NULL::BIGINT AS candidate, ''::VARCHAR AS decision, 0::BIGINT AS reserved_bytes, CAST(db AS BIGINT) AS projected_bytes FROM priced
  UNION ALL
  SELECT cycle, i, candidate, decision, CASE WHEN decision = 'admit' THEN res ELSE 0 END, CASE WHEN decision = 'admit' THEN before + res ELSE before END
  FROM (SELECT p.cycle, p.i, p.candidate, p.res, s.projected_bytes AS before, CASE WHEN p.bad IS NOT NULL THEN p.bad WHEN p.replay THEN 'replay' WHEN s.projected_bytes + p.res > 2500000000 THEN 'database' ELSE 'admit' END AS decision
    FROM step s JOIN priced p ON p.cycle = s.cycle AND p.i = s.i + 1 WHERE p.i <= 64)
)
SELECT cycle, candidate, decision, reserved_bytes, projected_bytes FROM step WHERE i > 0
UNION ALL SELECT cycle, candidate, 'next_cycle', 0, NULL FROM priced WHERE i > 64""")
def admission_cycles(spark, sf_dir):
    return admission.admission_plan(_candidates(spark, sf_dir))


_MORE = """'<a href="/out">o</a><a href=''/in/' || CAST(page_id AS VARCHAR) || '''>i</a><a href="/out">o</a>'"""


@query(rf"""
WITH w AS (
  SELECT page_id, url, page_id % 9 AS k, CASE WHEN page_id % 10 = 0 THEN html ELSE html || {_MORE} END AS inner_html FROM pages
), t AS (SELECT *, {PAGE_TEXT.replace("html", "inner_html")} AS text, regexp_extract(url, '^(\w+://[^/?#]+)', 1) AS host FROM w),
f AS (SELECT *, CASE WHEN k = 2 OR length(text) < 100 THEN NULL ELSE sha256('guidance-fingerprint/2' || chr(10) || CAST(to_json({{'text': text, 'links': CASE WHEN page_id % 10 = 0 THEN []::VARCHAR[] ELSE list_sort([host || '/in/' || CAST(page_id AS VARCHAR), host || '/out']) END}}) AS VARCHAR)) END AS fp FROM t)
SELECT page_id AS id, CASE WHEN k = 0 THEN 'network_unavailable' WHEN k = 1 THEN 'http_error' WHEN fp IS NULL THEN 'content_unparsed' WHEN k = 3 THEN 'first_observation' WHEN k = 4 THEN 'baseline_refresh_required' WHEN k = 5 THEN 'content_changed' ELSE 'unchanged_observation' END AS status,
  CASE WHEN k > 1 THEN fp END AS fingerprint, NOT (k > 5 AND fp IS NOT NULL) AS needs_review FROM f""")
def guidance_watch(spark, sf_dir):
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 9
    more = F.when(F.col("page_id") % 10 == 0, "").otherwise(F.concat(F.lit('<a href="/out">o</a><a href=\'/in/'), F.col("page_id").cast("string"), F.lit("'>i</a><a href=\"/out\">o</a>")))
    inner = F.concat("html", more)
    body = F.when(k == 2, inner).otherwise(F.concat(F.lit('<MAIN id="m">'), inner, F.lit("</main>")))
    sources = p.select(F.col("page_id").alias("id"))
    fetched = p.where(k != 0).select(F.col("page_id").alias("id"), F.when(k == 1, 404).otherwise(200).alias("http_status"), "url", F.lit("text/html; charset=utf-8").alias("content_type"), body.alias("body"))
    # The baseline is a fetch before: some pages were not seen then, some were other pages.
    before = watch.content_fingerprints(materialise(fetched.where((F.col("id") % 9 > 1) & (F.col("id") % 9 != 3)), "watch-before"))
    baseline = before.select("id", F.when(F.col("id") % 9 == 5, F.concat(F.lit("x"), "fingerprint")).otherwise(F.col("fingerprint")).alias("fingerprint"))
    old = watch.watch(sources.where("id % 9 = 4"), fetched, baseline, F.lit(1))
    return old.unionByName(watch.watch(sources.where("id % 9 <> 4"), fetched, baseline))


@query("WITH" + EMPLOYERS + """,
digits AS (SELECT *, regexp_replace(ein, '[^0-9]', '', 'g') AS d FROM raw)
SELECT count(*) AS rows_scanned, count(*) FILTER (WHERE welfare_code <> '14A2') AS kept, count(*) FILTER (WHERE welfare_code = '14A2') AS dropped_non_health, count(*) FILTER (WHERE welfare_code <> '14A2' AND length(d) <> 9) AS dropped_bad_ein,
  (SELECT count(*) FROM employers) AS employers_emitted FROM digits""")
def employer_counters(spark, sf_dir):
    """Counters come from the pass that writes the employers, as an ingest has them."""
    counters = Observation()
    emitted = materialise(registries.employers(employer_rows(spark, sf_dir), counters), "employers").count()
    seen = counters.get
    names = ["rows_scanned", "kept", "dropped_non_health", "dropped_bad_ein"]
    return spark.createDataFrame([(*[seen[n] for n in names], emitted)], ", ".join(f"{n} long" for n in [*names, "employers_emitted"]))


@query("WITH" + EMPLOYERS + "\nSELECT ein, name_norm, name, participants FROM employers")
def employers_file(spark, sf_dir):
    path = place(spark, "employers")
    sinks.write_employers(registries.employers(employer_rows(spark, sf_dir)), path)
    return catalogs.read_employers(spark, path).select("ein", "name_norm", "name", F.col("participants").cast("int").alias("participants"))


def _manifest(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    return c.join(o, F.col("o_custkey") == k).select(
        F.concat(F.lit("https://files.example/"), (F.col("o_orderkey") % 40).cast("string")).alias("file_url"), F.col("o_orderpriority").alias("file_description"), F.when(k % 9 == 0, 'A "quoted", name').otherwise(F.col("c_name")).alias("plan_name"),
        F.when(k % 2 == 0, "ein").otherwise("hios").alias("plan_id_type"), (k % 500).cast("string").alias("plan_id"), F.col("c_mktsegment").alias("plan_market_type"), F.col("c_nationkey").cast("string").alias("reporting_entity")).distinct()


@query("""
SELECT DISTINCT 'https://files.example/' || CAST(o_orderkey % 40 AS VARCHAR) AS file_url, o_orderpriority AS file_description, CASE WHEN c_custkey % 9 = 0 THEN 'A "quoted", name' ELSE c_name END AS plan_name, CASE WHEN c_custkey % 2 = 0 THEN 'ein' ELSE 'hios' END AS plan_id_type,
  CAST(c_custkey % 500 AS VARCHAR) AS plan_id, c_mktsegment AS plan_market_type, CAST(c_nationkey AS VARCHAR) AS reporting_entity FROM customer JOIN orders ON o_custkey = c_custkey""")
def manifest_file(spark, sf_dir):
    rows, path = _manifest(spark, sf_dir), place(spark, "manifest")
    sinks.write_manifest(rows, path, path + ".files")
    return catalogs.read_manifest(spark, path).drop("ord")


@query("""
WITH m AS (SELECT DISTINCT o_orderkey % 40 AS f, CASE WHEN c_custkey % 9 = 0 THEN 'A' ELSE c_name END AS n, c_custkey % 2 AS t, c_custkey % 500 AS p, c_mktsegment AS k FROM customer JOIN orders ON o_custkey = c_custkey)
SELECT 'https://files.example/' || CAST(f AS VARCHAR) AS url, d AS file_description, count(*) AS plan_count FROM m JOIN (SELECT o_orderkey % 40 AS f, min(o_orderpriority) AS d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (f) GROUP BY ALL""")
def manifest_files_file(spark, sf_dir):
    rows, path = _manifest(spark, sf_dir), place(spark, "manifest")
    sinks.write_manifest(rows, path, path + ".files")
    return catalogs.read_manifest_files(spark, path + ".files").select("url", "file_description", "plan_count")


@query("WITH" + DRUGS + """
SELECT CAST(formulary_id AS VARCHAR) AS formulary_id, contract_year, rxcui, tier, prior_authorization, step_therapy, coalesce(quantity_limit, false) AS quantity_limit FROM drugs""")
def formulary_file(spark, sf_dir):
    """A published drug file of the table's lines, read back: the first line of each drug counts."""
    path, yes_no = place(spark, "formulary"), lambda c: F.when(F.col(c), "Y").when(~F.col(c), "N").otherwise(F.lit(" "))
    again = F.explode(F.array(F.lit(0), F.lit(1)))  # every drug comes twice, with another tier the second time
    rows = formulary_drugs(spark, sf_dir).select(again.alias("again"), "*").orderBy("again", "formulary_id", "rxcui")
    named = rows.select(
        F.concat(F.lit(" "), "formulary_id").alias(" FORMULARY_ID"), F.col("contract_year").alias("Contract_Year"), F.col("rxcui").alias("RXCUI"), F.when(F.col("again") == 0, F.coalesce(F.col("tier").cast("string"), F.lit(""))).otherwise("9").alias("TIER_LEVEL_VALUE"),
        F.when(F.col("quantity_limit"), "y").otherwise("N").alias("QUANTITY_LIMIT_YN"), F.lit("").alias("QUANTITY_LIMIT_AMOUNT"), F.lit("30").alias("QUANTITY_LIMIT_DAYS"), yes_no("prior_authorization").alias("PRIOR_AUTHORIZATION_YN"), yes_no("step_therapy").alias("STEP_THERAPY_YN"))
    named.write.option("header", True).option("sep", "|").option("quote", "").option("emptyValue", "").csv(path)
    return text.read_formulary(spark, path).select("formulary_id", "contract_year", "rxcui", "tier", "prior_authorization", "step_therapy", "quantity_limit")


@query("WITH" + LINKS + """,
rows AS (SELECT DISTINCT file_id, unhex(printf('%08x', strlen(plan_name))) || encode(plan_name) || unhex(printf('%08x', strlen(plan_id_type))) || encode(plan_id_type) || unhex(printf('%08x', strlen(plan_id))) || encode(plan_id)
  || unhex(printf('%08x', strlen(plan_market_type))) || encode(plan_market_type) AS row FROM links),
d AS (SELECT file_id, sha256(unhex(hex('plan-set/1') || string_agg(sha256(row), '' ORDER BY row))) AS set_id, count(*) AS plans FROM rows GROUP BY file_id)
SELECT set_id, any_value(plans) AS plans, count(*) AS files, any_value(plans) AS stored FROM d GROUP BY set_id""")
def plan_set_store(spark, sf_dir):
    """Files' sets stored in two runs, the second with sets that are there: each once, with all its plans."""
    store, rows = sinks.PlanSets(spark, place(spark, "plan-sets")), links(spark, sf_dir)
    store.store(rows.where("file_id % 2 = 0"))
    store.store(rows)
    stored = store.entries().groupBy("set_id").agg(F.count("*").alias("stored"))
    return store.sets().join(store.files().groupBy("set_id").agg(F.count("*").alias("files")), "set_id").join(stored, "set_id").select("set_id", "plans", "files", "stored")


@query("""
WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN '4411' ELSE '44' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') END AS zip, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Ohio' ELSE 'oh' END AS state, 2020 + c_custkey % 8 AS year,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS income, CASE WHEN c_custkey % 17 = 0 THEN 130.0 WHEN c_custkey % 19 = 0 THEN 30.5 ELSE c_custkey % 90 END AS age, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 2 WHEN 2 THEN 13 ELSE 1 END AS size,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'none' ELSE CASE WHEN c_custkey % 7 = 0 THEN 'offered' ELSE 'none' END END AS offer FROM customer)
SELECT k AS request_id, CASE WHEN NOT regexp_full_match(zip, '[0-9]{5}') THEN 'zip' WHEN state = 'Ohio' THEN 'state' WHEN year NOT IN (2025, 2026, 2027) THEN 'year' WHEN income IS NULL OR income < 0 THEN 'income' WHEN age > 120 OR age <> floor(age) THEN 'age'
  WHEN size = 13 THEN 'household_size' WHEN offer = 'offered' THEN 'employer_offer' WHEN size > 1 THEN 'several_persons' END AS problem FROM r""")
def household_validation(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("request_id"), F.when(k % 11 == 0, "4411").otherwise(F.concat(F.lit("44"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"))).alias("zip"), F.when(k % 5 == 1, "Ohio").when(k % 5 > 1, "oh").alias("state"), (k % 8 + 2020).alias("year"),
        F.when(k % 13 != 0, F.col("c_acctbal")).alias("income"), F.when(k % 17 == 0, 130.0).when(k % 19 == 0, 30.5).otherwise((k % 90).cast("double")).alias("age"), F.when(k % 6 == 1, 2).when(k % 6 == 2, 13).when(k % 6 > 2, 1).alias("household_size"),
        F.when((k % 3 == 2) & (k % 7 == 0), "offered").when(k % 3 > 0, "none").alias("employer_offer"))
    return checks.household_problems(rows, [2025, 2026, 2027]).select("request_id", "problem")


@query("WITH" + GROUPS + """,
allowed AS (SELECT DISTINCT CAST(s_suppkey + 1000000000 AS VARCHAR) AS npi FROM supplier WHERE s_nationkey % 2 = 0)
SELECT file_id, npi, tin_value, tin_type FROM classed JOIN allowed USING (npi) WHERE class = 'ok' QUALIFY row_number() OVER (PARTITION BY file_id, npi, tin_value ORDER BY ord, l_returnflag, pos) = 1""")
def membership_allowlist(spark, sf_dir):
    allowed = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select((F.col("s_suppkey") + 1000000000).cast("string").alias("npi"))
    return network_files.extract_memberships(groups(spark, sf_dir), allowed)[0]


@query("""
WITH l AS (SELECT event_id, user_id % 40 AS k, ts, event_type = 'refund' OR event_id % 6 = 0 AS withdrawn FROM events)
SELECT a.event_id, coalesce(sum(CASE WHEN withdrawn THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS survivors,
  NOT withdrawn AND coalesce(sum(CASE WHEN withdrawn THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) >= 2 AS may_retire FROM l a""")
def retirement_survivors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.concat(F.lit("https://x.example/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("_"), (F.col("user_id") % 40).cast("string"))
    rows = e.select("event_id", key.alias("stable_key"), F.col("ts").alias("created"), ((F.col("event_type") == "refund") | (F.col("event_id") % 6 == 0)).alias("withdrawn"))
    return publication.survivors(rows).select("event_id", "survivors", "may_retire")


@query("""
WITH l AS (SELECT p_brand AS response_id, CAST(p_size AS VARCHAR) AS rxcui, p_name || ' ' || CASE p_partkey % 3 WHEN 0 THEN '(Oral Pill)' WHEN 1 THEN 'Oral Liquid' ELSE 'Injectable' END AS label, p_partkey FROM part WHERE p_partkey % 7 <> 0),
f AS (SELECT *, CASE WHEN contains(lower(label), '(oral pill)') THEN 0.0::DOUBLE WHEN contains(lower(label), 'oral') THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS rank FROM l QUALIFY row_number() OVER (PARTITION BY response_id, rxcui ORDER BY p_partkey) = 1)
SELECT response_id, CAST(row_number() OVER (PARTITION BY response_id ORDER BY rank, p_partkey) AS INTEGER) AS position, rxcui, label, rank FROM f QUALIFY position <= 20""")
def drug_suggestion_order(spark, sf_dir):
    return formulary.first_suggestions(suggestion_responses(spark, sf_dir))


@query("""
WITH m AS (SELECT DISTINCT o_orderkey % 60 AS f, CASE WHEN c_custkey % 9 = 0 THEN 'A' ELSE c_name END AS n, c_custkey % 2 AS t, c_custkey % 500 AS p, CAST(c_nationkey AS VARCHAR) AS e FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 60 < 40),
g AS (SELECT f, count(*) AS plans, min(e) AS reporting_entity FROM m GROUP BY f)
SELECT o_orderkey AS shard, 'https://files.example/' || CAST(o_orderkey % 60 AS VARCHAR) AS file_url, coalesce(plans, 0) AS plans, reporting_entity FROM orders LEFT JOIN g ON f = o_orderkey % 60""")
def shard_manifest(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k, url = F.col("c_custkey"), F.concat(F.lit("https://files.example/"), (F.col("o_orderkey") % 60).cast("string")).alias("file_url")
    manifest = c.join(o.where("o_orderkey % 60 < 40"), F.col("o_custkey") == k).select(
        url, F.when(k % 2 == 0, "ein").otherwise("hios").alias("plan_id_type"), (k % 500).cast("string").alias("plan_id"), F.when(k % 9 == 0, "A").otherwise(F.col("c_name")).alias("plan_name"), F.col("c_nationkey").cast("string").alias("reporting_entity"))
    return serving.shard_files(o.select(F.col("o_orderkey").alias("shard"), url), manifest)
