"""Column functions over message text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it, spelled out so that every regex engine reads it alike.
SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
HEBREW = "[֐-׿]"
URL_PATTERN = r"https?://(?:[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%])+"
IP_LINK_PATTERN = r"https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_space(c: Column) -> Column:
    """Text without white space of any kind at either end; null is empty."""
    return F.regexp_replace(text_or_empty(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_hebrew_term(term: str) -> bool:
    return any("֐" <= ch <= "׿" for ch in term)


def clean_text(c: Column, max_chars: int | None = None) -> Column:
    """Drop tags, cut links after 80 characters, squeeze white space; keep ``max_chars`` if given.

    The cleaning always reads the whole text. ``max_chars`` is the stored length of the
    training corpus (``ScoringConfig.clean_chars``); without it the whole text is kept.
    """
    out = F.regexp_replace(text_or_empty(c), "<[^>]+>", " ")
    out = F.regexp_replace(out, f"(https?://[^{SPACE}]{{1,80}})[^{SPACE}]*", "$1")
    out = F.trim(F.regexp_replace(out, f"[{SPACE}]+", " "))
    return out if max_chars is None else F.substring(out, 1, max_chars)


def has_hebrew(c: Column) -> Column:
    return text_or_empty(c).rlike(HEBREW)


def language_of(c: Column) -> Column:
    return F.when(has_hebrew(c), "Hebrew").otherwise("English")


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _terms_by_script(terms: Sequence[str]) -> tuple[list[str], list[str]]:
    hebrew = [t for t in terms if is_hebrew_term(t)]
    return [t for t in terms if not is_hebrew_term(t)], hebrew


def count_terms(text: Column, terms: Sequence[str], hebrew: Column) -> Column:
    """How many of ``terms`` occur in ``text``; Hebrew ones are only tried where ``hebrew`` holds."""

    def hits(part: list[str]) -> Column:
        return F.size(F.filter(literal_array(part), lambda k: F.contains(text, k)))

    latin, heb = _terms_by_script(terms)
    total = hits(latin) if latin else F.lit(0)
    return total + F.when(hebrew, hits(heb)).otherwise(0) if heb else total


def any_term(text: Column, terms: Sequence[str], hebrew: Column | None = None) -> Column:
    """Does any of ``terms`` occur in ``text``?"""

    def hit(part: list[str]) -> Column:
        return F.exists(literal_array(part), lambda k: F.contains(text, k))

    latin, heb = _terms_by_script(terms)
    found = hit(latin) if latin else F.lit(False)
    if not heb:
        return found
    return found | ((has_hebrew(text) if hebrew is None else hebrew) & hit(heb))


def urls_in(c: Column) -> Column:
    """All links in a text; the regex runs only where a scheme separator occurs."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(c, F.lit(URL_PATTERN), F.lit(0))
    return F.when(F.contains(c, F.lit("://")), found).otherwise(none)


def snippet(c: Column, n: int = 60) -> Column:
    """One line, at most ``n`` characters, with an ellipsis where it was cut."""
    one = F.trim(F.regexp_replace(text_or_empty(c), f"[{SPACE}]+", " "))
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n), F.lit("..."))).otherwise(one)


def head_and_tail(c: Column, limit: int = 6000, head: int = 4000, tail: int = 1500) -> Column:
    """Long bodies keep their opening and their end, joined by an ellipsis line."""
    cut = F.concat(F.substring(c, 1, head), F.lit("\n...\n"), F.right(c, F.lit(tail)))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def fingerprint(c: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(text_or_empty(c), 256), 1, 32)


def row_identity(sender: Column, subject: Column, position: Column | None = None) -> Column:
    """Stable identity of a listed message; ``position`` tells apart rows of one list with the same sender and subject."""
    parts = [text_or_empty(sender), text_or_empty(subject)]
    return F.md5(F.concat_ws("|", *parts, *([] if position is None else [position.cast("string")])))


def model_input(sender: Column, subject: Column, content: Column) -> Column:
    return F.concat_ws(" ", *[text_or_empty(x) for x in (sender, subject, content)])


def draw(salt: str, *parts: Column) -> Column:
    """Reproducible 32-bit draw from a row's own values; never ``rand()``."""
    digest = F.md5(F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def pick(values: Sequence[str], number: Column) -> Column:
    """The value at ``number`` modulo the list's length."""
    return F.element_at(literal_array(values), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def round_half_even_exact(c: Column, digits: int = 2) -> Column:
    """Round as IEEE-exact half-even: ties are judged on the binary value, not its decimal print.

    ``x * 10**digits`` is split into the rounded product and its exact error, so a value that
    only looks like a tie goes to the side it really lies on.
    """
    scale = float(10**digits)
    p = c * F.lit(scale)
    split = c * F.lit(134217729.0)
    hi = split - (split - c)
    err = (hi * F.lit(scale) - p) + (c - hi) * F.lit(scale)
    whole = F.floor(p).cast("double")
    frac = p - whole
    even = F.pmod(whole, F.lit(2.0)) == 0
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & ~even)))
    return (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
