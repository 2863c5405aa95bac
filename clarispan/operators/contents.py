"""Selected files of a table of contents, and what kind of rate file a location leads to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispan.functions.scalars import let, source_identity
from clarispan.shared import materialise
from clarispan.sources.catalogs import PROBE_CHARS, rate_schema

# Bounds of a selection, of a file's plans and references, and of nested locations.
MOST_SELECTED, MOST_PLANS, MOST_REFERENCES, MOST_SCOPE, NESTED = 400, 30_000, 64, 10_000, 2
_LOCATION = r'"location"\s*:\s*"((?:\\.|[^"\\])+)"'


def checked_selection(selected: DataFrame) -> DataFrame:
    """Rows (requested, key, path, path_only) of selected URLs or paths (requested). None, more than MOST_SELECTED, one that
    is no https URL or path, and two of one identity are errors; so the selection is small and may be broadcast."""
    rows = selected.select("requested", source_identity(F.col("requested")).alias("i")).limit(MOST_SELECTED + 1).collect()
    keys = [r["i"] and r["i"]["key"] for r in rows]
    if not 0 < len(rows) <= MOST_SELECTED:
        raise ValueError(f"a selection has 1 to {MOST_SELECTED} files")
    if None in keys:
        raise ValueError(f"not a URL or path: {rows[keys.index(None)]['requested']}")
    if len(set(keys)) < len(keys):
        raise ValueError("two selected files have one identity")
    return selected.sparkSession.createDataFrame([(r["requested"], k, r["i"]["path"], k.startswith("path:")) for r, k in zip(rows, keys)], "requested string, key string, path string, path_only boolean")


def selected_contents(structures: DataFrame, selected: DataFrame, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Plans (requested, plan_id_type, plan_id, plan_name, plan_market_type) of selected files, distinct, and of each
    selection its `found` identity, counts of plans and references, and a `problem`.

    Structures (plans, files) name files by their URLs; URLs meet by identity, and a selected path meets any host. A scope
    (plan_id_type, plan_id) leaves other plans out. Problems: unresolved, ambiguous (a path on several hosts), no plans,
    plans or references beyond the bounds.
    """
    wanted = F.broadcast(checked_selection(selected).withColumn("at", F.when(F.col("path_only"), F.col("path")).otherwise(F.col("key"))).select("requested", "path_only", "at"))
    # A location is looked up by its key and by its path; structures are read, and an identity worked out, once.
    ways = lambda i: F.when(i.isNotNull(), F.array(*[F.struct(F.lit(p).alias("path_only"), i[c].alias("at"), i["key"].alias("found")) for p, c in ((False, "key"), (True, "path"))]))
    located = structures.select("plans", F.explode("files").alias("f")).select("plans", "f", F.explode(let(source_identity(F.col("f.location")), ways)).alias("i"))
    met = located.select("plans", "f", "i.*").join(wanted, ["path_only", "at"]).select("requested", "found", "f", "plans")
    met = materialise(met, "selected")
    fields = ["plan_id_type", "plan_id", "plan_name", "plan_market_type"]
    plans = met.select("requested", F.explode("plans").alias("p")).select("requested", F.lower("p.plan_id_type").alias("plan_id_type"), "p.plan_id", "p.plan_name", "p.plan_market_type").distinct()
    if scope is not None:
        plans = plans.join(scope.select(F.lower("plan_id_type").alias("plan_id_type"), "plan_id").distinct(), ["plan_id_type", "plan_id"], "left_semi")
    references = met.select("requested", "found", F.to_json("f").alias("f")).distinct().groupBy("requested").agg(F.count("f").alias("references"), F.count_distinct("found").alias("hosts"), F.min("found").alias("found"))
    counts = plans.groupBy("requested").agg(F.count("*").alias("plans"))
    rows = wanted.select("requested").join(references, "requested", "left").join(counts, "requested", "left").fillna(0, ["references", "plans"])
    problem = (
        F.when(F.col("references") == 0, "unresolved").when(F.col("hosts") > 1, "ambiguous").when(F.col("references") > MOST_REFERENCES, "references")
        .when(F.col("plans") == 0, "no plans").when(F.col("plans") > MOST_PLANS, "plans"))
    return plans.select("requested", *fields), rows.select("requested", F.when(F.col("hosts") == 1, F.col("found")).alias("found"), "plans", "references", problem.alias("problem"))


def containing(selected: DataFrame) -> list[str]:
    """Texts of which every structure with a selected file holds one, for a reader's `containing`: the paths before their
    parameters."""
    return sorted({r["path"].split("?")[0] for r in checked_selection(selected).collect()})


def probed_schemas(starts: DataFrame, heads: DataFrame, nested: int = NESTED) -> DataFrame:
    """Schema (v1, v2, unknown) of the rate file at each location of starts, by heads (location, text), the beginnings of
    what was fetched: one that tells nothing leads to the first web location in it, at most `nested` times. Null where
    nothing was fetched. Rows (location, schema, steps)."""
    decoded = lambda x: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>"), 0), x)
    named = F.transform(F.regexp_extract_all(F.substring("text", 1, PROBE_CHARS), F.lit(_LOCATION), 1), decoded)
    known = heads.select(
        F.col("location").alias("__at"), rate_schema(F.col("text")).alias("__schema"), F.get(F.filter(named, lambda x: x.rlike(r"(?i)^https?://")), 0).alias("__next"))
    rows = starts.select("location").distinct().withColumns({"at": F.col("location"), "schema": F.lit(None).cast("string"), "steps": F.lit(0)})
    done = []
    for step in range(nested + 1):  # a join for each step that there may be
        met = rows.join(known, F.col("at") == F.col("__at"), "left")
        goes_on = (F.col("__schema") == "unknown") & F.col("__next").isNotNull() & F.lit(step < nested)
        met = met.withColumn("on", F.coalesce(goes_on, F.lit(False)))
        done.append(met.where("NOT on").select("location", F.col("__schema").alias("schema"), F.lit(step).alias("steps")))
        rows = met.where("on").select("location", F.col("__next").alias("at"), "schema", "steps")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
