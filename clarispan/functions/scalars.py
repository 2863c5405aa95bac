"""Column functions that more than one operator uses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clarispan import policy


def half_up(c: Column, places: int = 2) -> Column:
    """Rounds halves toward positive infinity, on the double as it is (not F.round's decimal)."""
    f = float(10**places)
    return F.floor(c * F.lit(f) + F.lit(0.5)) / F.lit(f)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is worked out once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def freshness(fetched: Column, updated: Column) -> Column:
    """Half for every HALF_LIFE_DAYS between the source's date and retrieval; 1 if there is no such age."""
    age = days_between(fetched, updated)
    return F.when(age > 0, F.pow(F.lit(0.5), age / F.lit(float(policy.HALF_LIFE_DAYS)))).otherwise(F.lit(1.0))


def base_confidence(source: Column) -> Column:
    first, *rest = policy.BASE_CONFIDENCE.items()
    return reduce(lambda c, kv: c.when(source == kv[0], kv[1]), rest, F.when(source == first[0], first[1]))


def answer_confidence(source: Column, value: Column, fetched: Column, updated: Column) -> Column:
    known = half_up(base_confidence(source) * freshness(fetched, updated))
    return F.when(value == "unknown", F.lit(policy.UNKNOWN_CONFIDENCE)).otherwise(known)


def tristate(coverage: Column) -> Column:
    """yes, no or unknown from a source's wording."""
    c = F.lower(F.trim(coverage))
    no = c.contains("notcovered") | c.contains("not covered") | (c == "out")
    return F.when(no, "no").when(c.contains("covered") | (c == "in"), "yes").otherwise("unknown")


def employer_name(name: Column) -> Column:
    """Upper case words without trailing legal suffixes and leading articles; one word always stays."""
    plain = F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "))
    cut = F.regexp_replace(plain, "^(.+?)((?: (?:" + "|".join(policy.EMPLOYER_SUFFIXES) + "))+)$", "$1")
    return F.regexp_replace(cut, "^(?:THE )+(?=.)", "")


def has_health_benefit(code: Column) -> Column:
    """Whether one of the aligned two-character codes is 4A."""
    plain = F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")
    return F.exists(F.regexp_extract_all(plain, F.lit("(..)"), 1), lambda x: x == "4A")


def shard_name(url: Column) -> Column:
    """Last part of a URL's path without data suffixes."""
    base = F.regexp_extract(F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "([^/]*)$", 1)
    name = F.regexp_replace(F.regexp_replace(base, r"(?i)\.json\.gz$", ""), r"(?i)\.(gz|json|zip)$", "")
    return F.when(name == "", "shard").otherwise(name)


def ledger_key(key: Column) -> Column:
    """A source's key without its dates, so that its generations share it."""
    key = F.regexp_replace(key, r"\d{4}-\d{2}-\d{2}", "{date}")
    key = F.regexp_replace(key, r"reporting_month=\d{4}-\d{2}", "reporting_month={month}")
    return F.regexp_replace(key, r"/\d{4}-\d{2}_", "/{month}_")


def url_identity(url: Column) -> Column:
    """A URL without transport signatures; its other parameters are kept as a digest of their sorted text."""
    base, query = F.split_part(url, F.lit("?"), F.lit(1)), F.split_part(url, F.lit("?"), F.lit(2))
    key = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    signed = lambda p: key(p).isin("signature", "expires", "policy", "key-pair-id") | key(p).startswith("x-amz-")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~signed(p)))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?query-sha256="), F.sha2(F.array_join(kept, "&"), 256))).otherwise(base)


# Parameters of a URL that sign it.
SIGNATURES = (
    "signature", "expires", "policy", "key-pair-id", "x-amz-algorithm", "x-amz-credential", "x-amz-date", "x-amz-expires",
    "x-amz-signedheaders", "x-amz-signature", "x-amz-security-token",
)


def source_identity(url: Column) -> Column:
    """A struct (key, path) of an https URL, or of a path that begins with one slash: the text without the parameters that
    sign it, the others as they are and in their order. `path` leaves out the host. Null for what has another scheme, a
    user, a port or a fragment."""
    place = F.when(url.rlike("^/(?!/)"), url).when(url.rlike(r"(?i)^https://[^/?#@:\s]+(:443)?(?=[/?]|$)"), F.regexp_replace(url, r"(?i)^https://[^/?#]+", ""))
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"(?i)^(https://[^/?#]+)", 1), ":443$", ""))
    name = lambda p: F.lower(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))))
    kept = lambda query: F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.coalesce(name(p).isin(*SIGNATURES), F.lit(False))), "&")
    asked = lambda query: let(kept(query), lambda k: F.when(k == "", "").otherwise(F.concat(F.lit("?"), k)))
    path = lambda place: let(F.regexp_replace(place, r"(?s)\?.*$", ""), lambda p: F.when(p == "", "/").otherwise(p))
    whole = let(place, lambda p: F.concat(path(p), asked(F.regexp_extract(p, r"(?s)\?(.*)$", 1))))
    of = lambda w: F.struct(let(host, lambda h: F.when(h == "", F.concat(F.lit("path:"), w)).otherwise(F.concat(h, w))).alias("key"), w.alias("path"))
    return F.when(~url.contains("#"), let(whole, lambda w: F.when(w.isNotNull(), of(w))))


# Entities that have a name, and the white space that text runs together.
ENTITIES = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "nbsp": " "}
WHITE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


#: The names, or a number, that begin a reference's part of a text cut at its ampersands.
_REFERENCE = r"(?i)^(#x[0-9a-f]+|#[0-9]+|" + "|".join(ENTITIES) + ");"


def decode_entities(text: Column) -> Column:
    """Named and numeric character references of a text, each decoded once; unknown ones stay. Only parts that begin
    with a reference are looked at further."""
    def decoded(part: Column) -> Column:
        name = F.lower(F.substring_index(part, ";", 1))
        point = F.when(name.startswith("#x"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).try_cast("bigint")
        valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        named = F.element_at(F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv]), name)
        char = F.when(~part.startswith("#"), named).when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        return F.coalesce(F.concat(char, F.substr(part, F.instr(part, ";") + 1)), F.concat(F.lit("&"), part))

    parts = F.split(text, "&", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).when(p.rlike(_REFERENCE), decoded(p)).otherwise(F.concat(F.lit("&"), p))), "")


def without_tags(html: Column) -> Column:
    """Each tag as a space. A tag ends at the first > outside its quoted values; a < that none closes stays. The
    quantifiers are possessive, which the JVM matches in a loop and not by recursion, and nothing after the last >
    is searched."""
    last = F.length(html) - F.instr(F.reverse(html), ">") + 1
    closed = F.when(F.contains(html, F.lit(">")), F.substr(html, F.lit(1), last)).otherwise("")
    plain = F.regexp_replace(closed, r"""<(?>[^>"']++|"[^"]*+"|'[^']*+')*+>""", " ")
    return F.concat(plain, F.substr(html, F.length(closed) + 1))


# Elements that hold code or surround the content.
AROUND = ("script", "style", "nav", "header", "footer")


def with_page_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Pages with the text of their main part (of the whole page, if it has none) on one line, without comments, without
    elements that hold code or surround the content, and without tags; entities decoded. Each step is a column of its
    own, so that no later one works it out again."""
    parts = F.split(F.col(html), r"(?i)<main\b[^>]*+>", 2)
    inner = F.split(F.get(parts, 1), r"(?i)</main>", 2)
    plain = F.regexp_replace(F.regexp_replace("__body", r"(?s)<!--.*?-->", " "), rf"(?is)<({'|'.join(AROUND)})\b[^>]*+>.*?</\1>", " ")
    out = pages.withColumn("__inner", inner).withColumn("__body", F.when(F.size("__inner") > 1, F.get("__inner", 0)).otherwise(F.col(html)))
    out = out.withColumn("__body", plain)
    out = out.withColumn("__body", without_tags(F.col("__body"))).withColumn("__body", decode_entities(F.col("__body")))
    return out.withColumn(text, F.trim(F.regexp_replace("__body", WHITE, " "))).drop("__inner", "__body")


def fresh_file(updated: Column, as_of: Column, days: int = policy.FILE_FRESH_DAYS) -> Column:
    """Whether a source's date lies within the window that ends now, both ends included."""
    age = days_between(as_of, updated)
    return F.coalesce((age >= 0) & (age <= days), F.lit(False))


def contains_text(column: Column, query: str) -> Column:
    """Case-insensitive containment of a query, which counts up to 120 characters; below 2 nothing matches."""
    q = query.strip()[:120]
    return F.lit(False) if len(q) < 2 else F.contains(F.lower(column), F.lit(q.lower()))


def sorted_text(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


def covered_flag(wording: Column) -> Column:
    """Whether a marketplace's wording says covered; null if it says neither."""
    c = F.lower(wording)
    return F.when(c.contains("notcovered"), False).when(c.contains("covered"), True)


def member_name(name: Column) -> Column:
    """An archive member's name with its separators as single blanks, in lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[._/-]+", " "), r"\s+", " "))


def provider_label(npi: Column, first: Column, last: Column, plain: Column) -> Column:
    """A provider's display name: the plain one if there is one, else first and last, else the number alone."""
    full = F.trim(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))))
    name = F.coalesce(F.nullif(plain, F.lit("")), F.nullif(full, F.lit("")))
    return F.coalesce(F.concat(name, F.lit(" (NPI "), npi, F.lit(")")), F.concat(F.lit("NPI "), npi))


def drug_label(rxcui: Column, name: Column) -> Column:
    return F.coalesce(F.concat(F.nullif(name, F.lit("")), F.lit(" (RxCUI "), rxcui, F.lit(")")), F.concat(F.lit("RxCUI "), rxcui))
