"""Column functions over addresses, hosts and domains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.functions.text import literal_array, strip_space, text_or_empty

OFFICIAL_DOMAINS = sorted({d for domains in lx.BRANDS.values() for d in domains})


def sender_domain(sender: Column) -> Column:
    """Domain after the first ``@`` that is followed by one; '' when there is none."""
    raw = F.regexp_extract(text_or_empty(sender), r"@([A-Za-z0-9.\-]+)", 1)
    return F.regexp_replace(F.lower(raw), r"\.+$", "")


def url_host(url: Column) -> Column:
    """Host of a link without credentials and port, lower case, no trailing dots."""
    authority = F.regexp_extract(url, r"^(?:.*?://)?([^/?#]*)", 1)
    host = F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), "^([^:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def suffixes(domain: Column) -> Column:
    """A domain and each of its parent domains, longest first."""
    parts = F.split(domain, r"\.")
    n = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")
    )


def belongs_to(domain: Column, official: str) -> Column:
    return (domain == official) | domain.endswith("." + official)


def belongs_to_any(domain: Column, officials: Iterable[str]) -> Column:
    """Is the domain one of ``officials`` or below one of them? Equality on its suffixes."""
    return (domain != "") & F.arrays_overlap(suffixes(domain), literal_array(list(officials)))


def organisation(domain: Column) -> Column:
    """Label used to compare organisations: third from the right, or the first of a short name.

    Right for ``shop.co.il``; for ``mail.site.com`` it yields ``mail``, which the published
    rules accept, so the default keeps it (see ``same_organisation(strict=True)``).
    """
    parts = F.split(domain, r"\.")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -3)).otherwise(F.element_at(parts, 1))


def registrable(domain: Column) -> Column:
    """Registered name: last two labels, or three below a two-letter country's second level."""
    parts = F.split(domain, r"\.")
    country = domain.rlike(r"\.(co|org|net|gov|ac|com|edu)\.[a-z]{2}$")
    keep = F.when(country, 3).otherwise(2)
    start = F.greatest(F.size(parts) - keep + 1, F.lit(1))
    return F.array_join(F.slice(parts, start, keep), ".")


def same_organisation(a: Column, b: Column, strict: bool = False) -> Column:
    part = registrable if strict else organisation
    return (part(a) != "") & (part(a) == part(b))


def display_name(address: Column) -> Column:
    return F.substring_index(address, "@", 1)


def canonical_mailbox(address: Column) -> Column:
    """Mailbox identity: no ``+tag``; Gmail ignores dots and has two domain names."""
    cleaned = F.lower(strip_space(address))
    parts = F.split(cleaned, "@")
    local = F.substring_index(F.element_at(parts, 1), "+", 1)
    domain = F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise("")
    gmail = domain.isin("gmail.com", "googlemail.com")
    return F.concat(
        F.when(gmail, F.regexp_replace(local, r"\.", "")).otherwise(local),
        F.lit("@"),
        F.when(gmail, "gmail.com").otherwise(domain),
    )


def trusted_company(domain: Column) -> Column:
    """A known company's own domain. Free mail providers never count as the company."""
    return belongs_to_any(domain, OFFICIAL_DOMAINS) & ~belongs_to_any(domain, lx.FREE_MAIL)
