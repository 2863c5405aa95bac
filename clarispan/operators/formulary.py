"""Drug formulary answers, plan shortlists and plan search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clarispan.functions.scalars import half_up
from clarispan.policy import PDP_REGIONS

RESTRICTIONS = ["prior_authorization", "step_therapy", "quantity_limit"]
SHORTLIST_ORDER = [
    F.desc, F.asc, F.asc, F.asc_nulls_last, F.asc, F.asc, F.asc, F.asc]
SHORTLIST_COLUMNS = ["listed", "restricted_drugs", "restriction_flags", "average_tier", "plan_name", "contract_id", "plan_id", "segment_id"]


def region_table(spark: SparkSession) -> DataFrame:
    rows = [(s, int(r)) for r, states in PDP_REGIONS.items() for s in states.split()]
    return spark.createDataFrame(rows, "state string, region int")


def regions_of(rows: DataFrame, state: str = "state") -> DataFrame:
    """Adds the region of a state's code, in any case; the fixed table is broadcast."""
    table = region_table(rows.sparkSession).withColumnRenamed("state", "__state")
    return rows.join(F.broadcast(table), F.upper(F.trim(F.col(state))) == F.col("__state"), "left").drop("__state")


def answer(requests: DataFrame, plans: DataFrame, drugs: DataFrame) -> DataFrame:
    """Answers to (request_id, contract_id, plan_id, rxcui): a plan that is not indexed is unknown, a drug
    that its formulary does not list is a no."""
    rows = requests.join(plans.select("contract_id", "plan_id", "formulary_id", "contract_year"), ["contract_id", "plan_id"], "left")
    rows = rows.join(drugs.select("formulary_id", "contract_year", "rxcui", "tier", F.lit(True).alias("listed")), ["formulary_id", "contract_year", "rxcui"], "left")
    value = F.when(F.col("formulary_id").isNull(), "unknown").when(F.col("listed"), "yes").otherwise("no")
    return rows.select("request_id", "contract_id", "plan_id", "rxcui", value.alias("value"), F.col("tier").cast("string").alias("tier"))


def shortlist_metrics(plans: DataFrame, drugs: DataFrame, rxcuis: DataFrame) -> DataFrame:
    """Per plan: how many of the drugs are listed, restricted, flagged, and their mean tier. The asked
    drugs are a form's few and are broadcast."""
    asked = F.broadcast(rxcuis.select("rxcui").distinct())
    on = ["formulary_id", "contract_year"]
    listed = drugs.join(asked, "rxcui", "left_semi")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    flags = flag(RESTRICTIONS[0]) + flag(RESTRICTIONS[1]) + flag(RESTRICTIONS[2])
    per = listed.groupBy(*on).agg(
        F.count("*").alias("listed"), F.count_if(flags > 0).alias("restricted_drugs"), F.sum(flags.cast("long")).alias("restriction_flags"),
        half_up(F.sum("tier") / F.count("tier"), 1).alias("average_tier"))
    out = plans.join(per, on, "left")
    return out.fillna(0, ["listed", "restricted_drugs", "restriction_flags"])


def shortlist(plans: DataFrame, drugs: DataFrame, rxcuis: DataFrame, region: Column, limit: int = 12) -> DataFrame:
    """The best stand-alone plans of a region for some drugs."""
    local = plans.where(F.col("contract_id").rlike(r"^S\d{4}$") & region)
    order = [f(c) for f, c in zip(SHORTLIST_ORDER, SHORTLIST_COLUMNS)]
    return shortlist_metrics(local, drugs, rxcuis).orderBy(*order).limit(limit)


def search(plans: DataFrame, year: int, state: str | None, region: int | None, query: str, limit: int = 12) -> DataFrame:
    """Plans of a year and place (plans without a place fit any) whose name holds the query or whose
    contract or plan id starts with it."""
    q = query.strip()
    place = (F.col("state").isNull() & F.col("region").isNull()) | F.coalesce(F.col("state") == F.lit(state), F.lit(False)) | F.coalesce(F.col("region") == F.lit(region), F.lit(False))
    text = F.lower("plan_name").contains(q.lower()) | F.col("contract_id").startswith(q.upper()) | F.col("plan_id").startswith(q)
    return plans.where((F.col("contract_year") == year) & place & text).orderBy("plan_name", "contract_id", "plan_id", "segment_id").limit(limit)


def flatten_suggestions(responses: DataFrame) -> DataFrame:
    """Suggestions (response_id, rxcui, label, rank) of parallel arrays names, forms, rxcuis: the first
    of each code, plain oral pills first, then the order of the response."""
    one = responses.select("response_id", F.posexplode(F.arrays_zip("names", "forms", "rxcuis")).alias("i", "z"))
    two = one.select("response_id", "i", "z.names", F.posexplode(F.arrays_zip("z.forms", "z.rxcuis")).alias("j", "y"))
    rows = two.where("y.rxcuis IS NOT NULL AND y.rxcuis <> ''")
    label = F.trim(F.regexp_replace(F.concat_ws(" ", "names", "y.forms"), r"\s+", " "))
    rows = rows.groupBy("response_id", F.col("y.rxcuis").alias("rxcui")).agg(F.min_by(F.struct(label.alias("label"), "i", "j"), F.struct("i", "j")).alias("s"))
    low = F.lower("s.label")
    rank = F.when(low.contains("(oral pill)"), F.when(low.rlike(r"\bsensor\b"), 0.5).otherwise(0.0)).when(low.contains("oral"), 1.0).otherwise(2.0)
    return rows.select("response_id", "rxcui", "s.label", rank.alias("rank"), "s.i", "s.j")


def first_suggestions(responses: DataFrame, limit: int = 20) -> DataFrame:
    """Each response's suggestions in their final order: `position` from 1 to the limit."""
    order = Window.partitionBy("response_id").orderBy("rank", "i", "j")
    rows = flatten_suggestions(responses).withColumn("position", F.row_number().over(order))
    return rows.where(F.col("position") <= limit).select("response_id", "position", "rxcui", "label", "rank")
