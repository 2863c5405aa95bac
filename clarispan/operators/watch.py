"""Watched pages: what of a page counts as content, and whether it changed since a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispan.functions.scalars import AROUND, with_page_text
from clarispan.functions.web import page_links

# Version and name of the fingerprint, least characters of a page's text, least bytes of another document.
VERSION, DOMAIN, LEAST_TEXT, LEAST_BYTES = 2, "guidance-fingerprint/", 100, 100


def content_fingerprints(fetched: DataFrame) -> DataFrame:
    """Fetched documents (url, content_type, body) with `fingerprint`, a SHA-256 over the version and what counts, and
    `problem`.

    Of an HTML page that is the text and the sorted links of its main element; one without it (main_missing) or with
    little text (incomplete) has no fingerprint. A PDF counts by its bytes; other types and very short ones are
    unexpected. body is text of a page and the bytes' hexadecimal digits of a PDF.
    """
    kind = F.coalesce("content_type", F.lit(""))
    is_page, is_pdf = kind.rlike("(?i)html"), kind.rlike("(?i)pdf")
    rows = fetched.withColumn("__page", F.when(is_page, F.col("body"))).withColumn("__main", F.regexp_extract("__page", r"(?is)<main\b[^>]*+>(.*?)</main>", 1))
    rows = with_page_text(rows, "__page", "__text")
    content = F.regexp_replace(F.regexp_replace("__main", r"(?s)<!--.*?-->", " "), rf"(?is)<({'|'.join(AROUND)})\b[^>]*+>.*?</\1>", " ")
    rows = rows.withColumn("__links", page_links(content, F.col("url")))
    problem = (
        F.when(is_page & (F.col("__main") == ""), "main_missing").when(is_page & (F.length("__text") < LEAST_TEXT), "incomplete")
        .when(~is_page & (~is_pdf | (F.length(F.coalesce("body", F.lit(""))) < 2 * LEAST_BYTES)), "unexpected"))
    head = F.lit(f"{DOMAIN}{VERSION}\n")
    of_page = F.sha2(F.concat(head, F.to_json(F.struct(F.col("__text").alias("text"), F.col("__links").alias("links")))), 256)
    of_pdf = F.sha2(F.concat(F.encode(head, "UTF-8"), F.unhex("body")), 256)
    rows = rows.withColumn("problem", problem)
    return rows.withColumn("fingerprint", F.when(F.col("problem").isNull(), F.when(is_page, of_page).otherwise(of_pdf))).drop("__page", "__main", "__text", "__links")


def watch(sources: DataFrame, fetched: DataFrame, baseline: DataFrame, version: Column | None = None) -> DataFrame:
    """Status of each source (id, url) by what was fetched (id, http_status, url, content_type, body; nothing for a source
    that could not be reached) and the baseline (id, fingerprint) that was recorded under a version of the fingerprint:
    network_unavailable, http_error, content_unparsed, first_observation, baseline_refresh_required (recorded under
    another version), unchanged_observation or content_changed. All but the unchanged need a review."""
    version = F.lit(VERSION) if version is None else version
    got = content_fingerprints(fetched.select("id", "http_status", "url", "content_type", "body")).select("id", "http_status", "fingerprint")
    rows = sources.select("id").join(got.withColumn("reached", F.lit(True)), "id", "left").join(baseline.select("id", F.col("fingerprint").alias("before")), "id", "left")
    good = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    status = (
        F.when(F.col("reached").isNull(), "network_unavailable").when(~good, "http_error").when(F.col("fingerprint").isNull(), "content_unparsed")
        .when(F.col("before").isNull(), "first_observation").when(version != VERSION, "baseline_refresh_required")
        .when(F.col("before") == F.col("fingerprint"), "unchanged_observation").otherwise("content_changed"))
    return rows.select("id", status.alias("status"), F.when(good, F.col("fingerprint")).alias("fingerprint")).withColumn("needs_review", F.col("status") != "unchanged_observation")
