"""Column functions over pages, addresses and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clarispan.functions.scalars import let

_ATTRIBUTE = r"""(?is)<(?:a|area)\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def page_links(html: Column, base: Column) -> Column:
    """Sorted distinct absolute links of a page: full URLs as they are, others under the base's host or folder."""
    host = F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1)
    folder = F.when(base.rlike(r"^\w+://[^/?#]+/"), F.regexp_extract(base, r"^(\w+://[^?#]*/)", 1)).otherwise(F.concat(host, F.lit("/")))
    found = F.zip_with(F.regexp_extract_all(html, F.lit(_ATTRIBUTE), 1), F.regexp_extract_all(html, F.lit(_ATTRIBUTE), 2), lambda a, b: F.trim(F.concat(a, b)))
    whole = lambda x: (
        F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), x).when(x.startswith("//"), F.concat(F.regexp_extract(base, r"^(\w+:)", 1), x))
        .when(x.startswith("/"), F.concat(host, x)).when((x == "") | x.startswith("#") | x.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), x)).otherwise(F.concat(folder, x)))
    return F.array_sort(F.array_distinct(F.transform(found, whole)))


def network_of(address: Column) -> Column:
    """The network of a client's address: an IPv4 address itself (also when mapped into IPv6), the /64 of
    an IPv6 address, null for anything else."""
    number = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    v4 = rf"{number}(?:\.{number}){{3}}"

    def hexed(raw: Column) -> Column:
        """With an IPv4 end as two words."""
        def words(tail: Column) -> Column:
            last = lambda i: F.split_part(tail, F.lit("."), F.lit(i)).try_cast("int")
            word = lambda a, b: F.lower(F.hex(last(a) * 256 + last(b)))
            return F.when(tail != "", F.concat(F.regexp_replace(raw, rf"{v4}$", ""), word(1, 2), F.lit(":"), word(3, 4))).otherwise(raw)

        return let(F.regexp_extract(raw, rf"({v4})$", 1), words)

    def filled(halves: Column) -> Column:
        """All words, with zeros for the gap."""
        words = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
        gap = lambda a: F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(a)))
        whole = let(words(0), lambda a: let(words(1), lambda b: F.concat(a, gap(F.concat(a, b)), b)))
        return F.when(F.size(halves) == 2, whole).when(F.size(halves) == 1, F.split(F.get(halves, F.lit(0)), ":"))

    def named(plain: Column) -> Column:
        ok = (F.size(plain) == 8) & F.forall(plain, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        mapped = (F.array_join(F.slice(plain, 1, 5), "") == "00000") & (F.get(plain, F.lit(5)) == "ffff")
        at = lambda i: F.conv(F.get(plain, F.lit(i)), 16, 10).cast("int")
        four = F.concat_ws(".", *[x.cast("string") for i in (6, 7) for x in (F.floor(at(i) / 256), at(i) % 256)])
        return F.when(ok & mapped, four).when(ok, F.concat(F.array_join(F.slice(plain, 1, 4), ":"), F.lit("::/64")))

    plain = lambda full: F.transform(full, lambda x: F.lower(F.regexp_replace(x, "^0+(?=.)", "")))
    six = lambda raw: let(F.split(hexed(raw), "::"), lambda halves: let(plain(filled(halves)), named))
    return let(F.lower(F.trim(address)), lambda raw: F.when(raw.rlike(f"^{v4}$"), raw).when(raw.contains(":"), six(raw)))


def strict_date(text: Column) -> Column:
    """A date of the form YYYY-MM-DD that is in the calendar, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))
