"""Recovering the sender of a raw message, as column expressions.

``head_chars`` and ``inline_chars`` bound the header region: an address deeper in a message belongs
to a quoted one. They are part of the published definition, not a shortcut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.functions.text import SPACE, text_or_empty

# What counts as an address, a header line, a recipient, or infrastructure.
WORD = r"\p{L}\p{N}_"
ADDRESS = rf"[{WORD}.+%-]+@[{WORD}-]+(?:\.[{WORD}-]+)+"
LINE = r"(?i)(?:\A|\n)"
HEADER_METHODS = [
    ("from", LINE + r"from[ \t]*:([^\n]*)"),
    ("mbox", LINE + rf"from[ \t]+([^{SPACE}]+@[^{SPACE}]+)"),
    ("sender", LINE + r"x?-?sender[ \t]*:([^\n]*)"),
    ("return-path", LINE + r"return-path[ \t]*:([^\n]*)"),
]
RECIPIENT_LINE = LINE + r"(?:to|cc|bcc|delivered-to|x-original-to|envelope-to|for)[ \t]*:([^\n]*)"
RECIPIENT_INLINE = (
    rf"(?i)(?:\A|[^{WORD}])(?:to|cc|bcc|delivered-to|x-original-to|envelope-to)[ \t]*:[ \t]*<?({ADDRESS})"
)
FLAT_FROM = (
    rf"(?i)(?:\A|[^{WORD}])from[ \t]*:[ \t]*(?:[^<>@{SPACE}]{{0,60}}?[ \t])?<?({ADDRESS})"
)
HEADER_LINE = rf"^([A-Za-z][{WORD}-]{{1,40}}[ \t]*:|from[ \t]+[^{SPACE}]+@|[ \t]+[^{SPACE}])"
NOT_A_SENDER = (
    r"(?i)(listmaster|majordomo|owner-|-owner@|-request@|-admin@|-bounces@|bounce|postmaster"
    r"|mailer-daemon|no-?reply-daemon|root@|daemon@)"
)
WRAPPERS = r"<>()\[\]{}\"'.,;:"
# The address pattern for a search: it starts only at the edge of a run of address characters, or
# where the last match ended, and never backs out of a run, so each character is read about once.
_RUN = rf"[{WORD}.+%-]"
SEARCH_ADDRESS = rf"(?:\G|(?<!{_RUN})){_RUN}++@[{WORD}-]+(?:\.[{WORD}-]+)+"
MAX_HEADER_LINES, REGION_LINES, OPENING_LINES = 200, 8, 6


def clean_address(c: Column) -> Column:
    """Lower-cased address without wrappers, or '' when it cannot be one."""
    bare = F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")
    bare = F.lower(F.regexp_replace(bare, f"^[{WRAPPERS}]+|[{WRAPPERS}]+$", ""))
    local, domain = F.substring_index(bare, "@", 1), F.substring_index(bare, "@", -1)
    usable = (
        (F.length(bare) - F.length(F.replace(bare, F.lit("@"), F.lit(""))) == 1)
        & F.contains(domain, F.lit("."))
        & (F.length(local) <= 64)
        & (F.length(domain) <= 255)
        & (F.length(F.substring_index(domain, ".", -1)) >= 2)
    )
    return F.when(usable, bare).otherwise("")


def _first_lines(text: Column, n: int) -> Column:
    return F.slice(F.split(text, "\n", -1), 1, n)


def header_block(text: Column) -> Column:
    """Lines before the first blank one, as long as they look like headers; '' below three lines."""
    lines = _first_lines(text, MAX_HEADER_LINES)
    stops = F.transform(
        lines,
        lambda line, i: ~F.rlike(line, F.lit(f"[^{SPACE}]"))
        | ((i >= 3) & ~F.rlike(line, F.lit(HEADER_LINE))),
    )
    first_stop = F.array_position(stops, F.lit(True)).cast("int")
    n = F.when(first_stop > 0, first_stop - 1).otherwise(F.size(lines))
    return F.when(n >= 3, F.array_join(F.slice(lines, F.lit(1), n), "\n")).otherwise("")


def _addresses(text: Column) -> Column:
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(SEARCH_ADDRESS), F.lit(0))
    return F.when(F.contains(text, F.lit("@")), found).otherwise(none)


def _cleaned_addresses(raws: Column) -> Column:
    return F.transform(F.flatten(F.transform(raws, _addresses)), clean_address)


def _acceptable(address: Column) -> Column:
    return (address != "") & ~F.rlike(address, F.lit(NOT_A_SENDER))


def extract_sender(
    df: DataFrame, text: str, head_chars: int = 8000, inline_chars: int = 3000
) -> DataFrame:
    """Add ``extracted`` and ``extract_method``: the best-ranked sender the message records."""
    body = text_or_empty(F.col(text))
    head = F.substring(body, 1, head_chars)
    regions = df.select(
        "*", F.when(F.contains(body, F.lit("@")), head).otherwise("").alias("_head")
    ).select("*", header_block(F.col("_head")).alias("_block"))
    regions = regions.select(
        "*",
        F.when(F.col("_block") != "", F.col("_block"))
        .otherwise(F.array_join(_first_lines(F.col("_head"), REGION_LINES), "\n"))
        .alias("_region"),
        F.substring("_head", 1, inline_chars).alias("_near"),
        F.array_join(_first_lines(F.col("_head"), OPENING_LINES), "\n").alias("_opening"),
    )

    def first(addresses: Column) -> Column:
        return F.get(F.filter(addresses, _acceptable), F.lit(0))

    def all_of(c: str, pattern: str) -> Column:
        return F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(1))

    ranked = [
        (method, first(_cleaned_addresses(all_of("_region", pattern)))) for method, pattern in HEADER_METHODS
    ]
    flat = clean_address(F.regexp_extract("_near", FLAT_FROM, 1))
    ranked.append(("flat", F.when((F.col("_block") == "") & _acceptable(flat), flat)))
    recipients = F.concat(
        _cleaned_addresses(all_of("_region", RECIPIENT_LINE)),
        F.transform(all_of("_near", RECIPIENT_INLINE), clean_address),
    )
    opening = F.transform(_addresses(F.col("_opening")), clean_address)
    ranked.append(("bare", first(F.array_except(opening, recipients))))
    hits = [
        F.when(found.isNotNull(), F.struct(found.alias("address"), F.lit(method).alias("method")))
        for method, found in ranked
    ]
    none = F.struct(F.lit("").alias("address"), F.lit("").alias("method"))
    chosen = F.when(F.col("_head") != "", F.coalesce(*hits, none)).otherwise(none)
    return regions.select(*df.columns, chosen.alias("_found")).select(
        *df.columns,
        F.col("_found.address").alias("extracted"),
        F.col("_found.method").alias("extract_method"),
    )
