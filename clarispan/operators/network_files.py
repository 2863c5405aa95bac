"""Membership extraction from network files and the serving index over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clarispan.functions.scalars import contains_text, days_between, fresh_file
from clarispan.operators.ranking import ranked_within
from clarispan.policy import FILE_FRESH_DAYS


def npi_class(npi: Column, tin_type: Column, tin_value: Column) -> Column:
    """zero, tin, malformed or ok, in this order of tests."""
    return (
        F.when(npi == "0", "zero").when(npi.rlike(r"^\d{9}$"), "tin").when(~npi.rlike(r"^\d{10}$"), "malformed")
        .when((tin_type == "ein") & (npi == tin_value), "tin").otherwise("ok"))


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def first_payload(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """As first_by, for a few payload columns: one aggregate that combines before the shuffle, so a hot
    key is no hot task."""
    g = rows.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("__p"))
    return g.select(*keys, "__p.*")


def extract_memberships(groups: DataFrame, allowlist: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Memberships (file_id, npi, tin_value, tin_type) and drop counts of provider groups (file_id, ord,
    tin_type, tin_value, npi array of text), the first tin_type of a (npi, tin_value) staying.

    An allowlist (npi) keeps what it names.
    """
    tin = F.lower(F.trim("tin_type"))
    rows = groups.where((tin != "") & F.col("tin_value").isNotNull() & F.col("npi").isNotNull())
    rows = rows.select("file_id", "ord", tin.alias("tin_type"), "tin_value", F.posexplode("npi").alias("pos", "npi"))
    rows = rows.withColumn("class", npi_class(F.col("npi"), F.col("tin_type"), F.col("tin_value")))
    counts = rows.groupBy("file_id").agg(*[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in ("zero", "tin", "malformed", "ok")])
    ok = rows.where("class = 'ok'")
    if allowlist is not None:
        ok = ok.join(allowlist.select("npi").distinct(), "npi", "left_semi")
    return first_payload(ok, ["file_id", "npi", "tin_value"], ["ord", "pos"], ["tin_type"]), counts


def used_reference_groups(uses: DataFrame, references: DataFrame, strict: bool = False) -> DataFrame:
    """Groups of the references (file_id, ref_id, ord, ...) that are used (file_id, ref_id, ord), each
    once, in order of first use; the last definition of an id counts. Strict: an unresolved use is an error."""
    first = uses.groupBy("file_id", "ref_id").agg(F.min("ord").alias("use_ord"))
    rest = [c for c in references.columns if c not in ("file_id", "ref_id")]
    last = references.groupBy("file_id", "ref_id").agg(F.max_by(F.struct(*rest), "ord").alias("last")).select("file_id", "ref_id", "last.*")
    out = first.join(last, ["file_id", "ref_id"], "left" if strict else "inner")
    if strict:
        out = out.withColumn("ref_id", F.when(F.col("ord").isNull(), F.raise_error(F.concat(F.lit("unresolved reference "), F.col("ref_id").cast("string")))).otherwise(F.col("ref_id")))
    return out.drop("ord").withColumnRenamed("use_ord", "ord")


def closure_problems(uses: DataFrame, references: DataFrame) -> DataFrame:
    """What keeps files from being whole by themselves, a row for each id: references (file_id, ref_id, ord, gs) without an
    id, without groups of their own, or with an id that occurs twice, and uses (file_id, ref_id, ord) of none.

    Ids are counted before they meet, so one that a file uses very often is one row.
    """
    blank = F.coalesce(F.trim("ref_id"), F.lit("")) == ""
    named = references.groupBy("file_id", "ref_id").agg(F.count("*").alias("n"), F.count_if(F.col("gs").isNull()).alias("empty"))
    used = uses.groupBy("file_id", "ref_id").agg(F.count("*").alias("uses"))
    both = named.join(used, (named["file_id"] == used["file_id"]) & named["ref_id"].eqNullSafe(used["ref_id"]), "full")
    both = both.select(F.coalesce(named["file_id"], used["file_id"]).alias("file_id"), F.coalesce(named["ref_id"], used["ref_id"]).alias("ref_id"), "n", "empty", "uses")
    problem = F.when(F.col("n").isNull(), "unresolved").when(blank, "without id").when(F.col("empty") > 0, "without groups").when(F.col("n") > 1, "twice")
    return both.select("file_id", "ref_id", problem.alias("problem"), F.coalesce("uses", F.lit(0)).alias("uses")).where("problem IS NOT NULL")


def build_manifest(structures: DataFrame) -> DataFrame:
    """Rows of file x plan from structures (reporting_entity, plans array, files array), distinct."""
    rows = structures.select("reporting_entity", F.explode("files").alias("f"), "plans").select("reporting_entity", "f", F.explode("plans").alias("p"))
    return rows.select(
        F.col("f.location").alias("file_url"), F.col("f.description").alias("file_description"), F.col("p.plan_name").alias("plan_name"), F.lower("p.plan_id_type").alias("plan_id_type"),
        F.col("p.plan_id").alias("plan_id"), F.col("p.plan_market_type").alias("plan_market_type"), "reporting_entity").distinct()


def plan_counts(files: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct plans of each file; files without plans count zero."""
    n = links.select("file_id", "plan_id_type", "plan_id", "plan_market_type", "plan_name").distinct().groupBy("file_id").agg(F.count("*").alias("plan_count"))
    return files.join(n, "file_id", "left").withColumn("plan_count", F.coalesce("plan_count", F.lit(0).cast("long")))


def tiers(files: DataFrame, least_plans: int, most_bytes: int, url_part: str = "") -> tuple[DataFrame, DataFrame]:
    """Tier A, small files with many plans first, and tier B, large files, largest first."""
    rows = files.where((F.col("plan_count") >= least_plans) & F.col("url").contains(url_part))
    a = rows.where((F.col("bytes") > 0) & (F.col("bytes") <= most_bytes)).orderBy(F.desc("plan_count"), "url")
    return a, rows.where(F.col("bytes") > most_bytes).orderBy(F.desc("bytes"), "url")


def plan_files(files: DataFrame, links: DataFrame, sets: DataFrame, set_entries: DataFrame, plans: DataFrame) -> DataFrame:
    """Active files of plans (plan_id_type, plan_id), linked directly or through a shared set, each once."""
    key = ["plan_id_type", "plan_id"]
    wanted = plans.select(*key).distinct()
    direct = links.join(wanted, key).select(*key, "file_id")
    shared = set_entries.join(wanted, key).select(*key, "set_id").join(sets, "set_id").select(*key, "file_id")
    return direct.union(shared).distinct().join(files.where("active"), "file_id")


def evidence(requests: DataFrame, plan_file: DataFrame, memberships: DataFrame, as_of: Column) -> DataFrame:
    """Status of each request (request_id, plan_id_type, plan_id, npi): only `listed` answers yes, and
    absence is never a no."""
    files = requests.join(plan_file, ["plan_id_type", "plan_id"], "left")
    present = memberships.select("file_id", "npi", F.lit(True).alias("present")).distinct()
    rows = files.join(present, ["file_id", "npi"], "left").withColumn("present", F.coalesce("present", F.lit(False)))
    age = days_between(as_of, F.col("source_last_updated"))
    rows = rows.withColumns({"current": fresh_file(F.col("source_last_updated"), as_of), "undated": F.col("file_id").isNotNull() & (age.isNull() | (age < 0))})
    g = rows.groupBy("request_id", "npi", "plan_id").agg(
        F.count("file_id").alias("files"), F.count_if("present").alias("matched"), F.count_if(F.col("present") & F.col("current")).alias("listed"),
        F.count_if("current").alias("current"), F.count_if("undated").alias("undated"), F.count_if(F.col("present") & F.col("undated")).alias("matched_undated"),
        F.max(F.when(F.col("present") & F.col("current"), F.col("source_last_updated"))).alias("freshest"))
    none_current = F.when(F.col("matched") > 0, F.lit(True)).otherwise(F.col("current") == 0)
    undated = F.when(F.col("matched") > 0, F.col("matched_undated")).otherwise(F.col("undated"))
    state = (
        F.when(F.col("files") == 0, "plan_missing").when(F.col("listed") > 0, "listed")
        .when(none_current, F.when(undated > 0, "source_date_unknown").otherwise("source_stale")).otherwise("incomplete_index"))
    return g.select("request_id", "plan_id", "npi", "files", "matched", state.alias("evidence"), F.when(F.col("listed") > 0, "yes").otherwise("unknown").alias("value"), "freshest")


def eligible_files(files: DataFrame, memberships: DataFrame, index: DataFrame, as_of: Column) -> DataFrame:
    """Active, fresh files with an index of some rows, or without an index but with memberships."""
    fresh = files.where(F.col("active") & fresh_file(F.col("source_last_updated"), as_of, FILE_FRESH_DAYS))
    indexed = fresh.join(index.where("npi_count > 0"), "file_id", "left_semi")
    plain = fresh.join(index, "file_id", "left_anti").join(memberships, "file_id", "left_semi")
    return indexed.union(plain).distinct()


def search_plans(
    eligible: DataFrame, links: DataFrame, query: str, limit: int = 12, per_file: int = 24, sets: DataFrame | None = None, set_entries: DataFrame | None = None
) -> DataFrame:
    """Plans whose name holds the query: issuers take turns by file, at most per_file rows of a file,
    one row for each plan. Every limit has a full order.

    With sets (file_id, set_id) and set_entries (set_id, plan fields), files that have a set are searched
    through its entries, all of them, and a set's issuer is that of its smallest eligible file.
    """
    fields = ["plan_id_type", "plan_id", "plan_name", "plan_market_type", "reporting_entity"]
    single = eligible if sets is None else eligible.join(sets, "file_id", "left_anti")
    files = ranked_within(single.select("file_id", "reporting_entity"), "reporting_entity", [F.asc("file_id")], "turn")
    hits = links.where(contains_text(F.col("plan_name"), query)).join(files, "file_id")
    first = Window.partitionBy("file_id").orderBy("plan_name", "plan_id_type", "plan_id")
    hits = hits.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_file)
    found = hits.orderBy("turn", "reporting_entity", "file_id", "n").limit(per_file * limit).select(*fields)
    if sets is not None:
        issuers = eligible.join(sets, "file_id").groupBy("set_id").agg(F.min_by("reporting_entity", "file_id").alias("reporting_entity"))
        found = found.unionByName(set_entries.where(contains_text(F.col("plan_name"), query)).join(issuers, "set_id").select(*fields))
    plans = found.groupBy("plan_id_type", "plan_id", "plan_name").agg(F.min("plan_market_type").alias("market"), F.min("reporting_entity").alias("issuer"))
    return plans.orderBy("plan_name", "plan_id_type", "plan_id").limit(limit)


def compact_buckets(memberships: DataFrame) -> DataFrame:
    """Per file and four-digit prefix the sorted distinct suffixes: count, their text, its SHA-256. A
    bucket holds a million suffixes at most, by its key."""
    npis = memberships.select("file_id", F.substring("npi", 1, 4).alias("prefix"), F.substring("npi", 5, 6).alias("suffix")).distinct()
    g = npis.groupBy("file_id", "prefix").agg(F.array_join(F.array_sort(F.collect_list("suffix")), "\n").alias("suffixes"), F.count("*").alias("n"))
    return g.select("file_id", "prefix", "n", F.sha2(F.concat("suffixes", F.lit("\n")), 256).alias("raw_sha256"))


#: Memberships of a task of a lookup.
LOOKUP_ROWS = 400_000


def compact_lookup(requests: DataFrame, memberships: DataFrame) -> DataFrame:
    """Requests (file_id, npi) whose suffix is in its bucket: a join on all three parts, so no bucket is scanned.

    Tasks grow in number with the memberships, so one of them holds about LOOKUP_ROWS; these move once.
    """
    key = ["file_id", "prefix", "suffix"]
    parts = [F.substring("npi", 1, 4).alias("prefix"), F.substring("npi", 5, 6).alias("suffix")]
    tasks = max(1, -(-memberships.count() // LOOKUP_ROWS))
    members = memberships.select("file_id", *parts).repartition(tasks, *key).distinct().withColumn("found", F.lit(True))
    return requests.select("*", *parts).repartition(tasks, *key).join(members, key, "left").select("file_id", "npi", F.coalesce("found", F.lit(False)).alias("found"))


def set_digest(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """SHA-256 of each key's sorted distinct values, a line each."""
    g = values.select(*by, column).distinct().groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(column)), "\n").alias("t"))
    return g.select(*by, "n", F.sha2(F.concat("t", F.lit("\n")), 256).alias("digest"))


def plan_set_ids(links: DataFrame, domain: str = "plan-set/1") -> DataFrame:
    """Order-free identity of each file's plans: SHA-256 over a domain and the SHA-256 of every plan's
    length-prefixed fields, in binary order."""
    def field(c: str) -> Column:
        b = F.encode(F.col(c), "UTF-8")
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b)), 8, "0")), b)

    plans = links.select("file_id", F.concat(*[field(c) for c in ("plan_name", "plan_id_type", "plan_id", "plan_market_type")]).alias("row")).distinct()
    plans = plans.select("file_id", F.struct("row", F.sha2("row", 256).alias("digest")).alias("p"))
    g = plans.groupBy("file_id").agg(F.array_sort(F.collect_list("p")).alias("rows"))
    whole = F.concat(F.encode(F.lit(domain), "UTF-8"), F.unhex(F.array_join(F.col("rows.digest"), "")))
    return g.select("file_id", F.size("rows").alias("plans"), F.sha2(whole, 256).alias("set_id"))
