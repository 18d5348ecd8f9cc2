"""Rule scoring of single links. A narrow projection with its own band ladder (70/40/20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.functions.text import any_term, literal_array, strip_space, text_or_empty

URL_POINTS = ["u_http", "u_ip", "u_shortener", "u_tld", "u_long", "u_dots", "u_homoglyph", "u_brand",
              "u_path"]


def _foreign_brand(host: Column) -> Column:
    """First brand named in the host that is not exactly the two-label host of that brand."""
    cases = [
        F.when(F.contains(host, F.lit(b)) & ~host.rlike(rf"^{b}\.[^.]*$"), F.lit(b))
        for b in lx.URL_BRANDS
    ]
    return F.coalesce(*cases)


def score_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``url_scored``, points per check, ``url_score``, level, reasons, advice and flag."""
    trimmed = strip_space(F.col(url))
    full = F.when(trimmed.rlike("^https?://"), trimmed).otherwise(F.concat(F.lit("http://"), trimmed))
    authority = F.regexp_extract("_url", "^https?://([^/?#]*)", 1)
    path = F.regexp_extract("_url", "^https?://[^/?#]*([^?#]*)", 1)
    parsed = (
        df.select("*", (F.length(trimmed) < 4).alias("_blank"), full.alias("_url"))
        .select(
            "*",
            F.replace(F.lower(authority), F.lit("www."), F.lit("")).alias("_host"),
            F.lower(F.regexp_replace(path, ";[^/]*$", "")).alias("_path"),
            (F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]"))).alias("_broken"),
        )
        .select(
            "*",
            _foreign_brand(F.col("_host")).alias("_brand"),
            F.filter(literal_array(lx.URL_PATH_TERMS), lambda w: F.contains(F.col("_path"), w)).alias(
                "_words"
            ),
        )
    )
    host, link = F.col("_host"), F.col("_url")

    def points(cond: Column, value: int) -> Column:
        return F.when(cond, value).otherwise(0)

    shortener = reduce(
        lambda a, b: a | b, [(host == s) | host.endswith("." + s) for s in lx.URL_SHORTENERS]
    )
    tld = F.exists(literal_array(lx.URL_TLDS), lambda t: F.endswith(host, t))
    checked = parsed.select(
        "*",
        points(link.startswith("http://"), 15).alias("u_http"),
        points(link.rlike(r"^https?://([0-9]{1,3}\.){3}[0-9]{1,3}"), 35).alias("u_ip"),
        points(shortener, 20).alias("u_shortener"),
        points(tld, 25).alias("u_tld"),
        points(F.length(link) > 100, 10).alias("u_long"),
        points(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) >= 3, 15).alias("u_dots"),
        points(any_term(host, lx.URL_HOMOGLYPHS), 40).alias("u_homoglyph"),
        points(F.col("_brand").isNotNull(), 30).alias("u_brand"),
        F.least(F.size("_words") * 10, F.lit(25)).alias("u_path"),
    )
    total = F.least(reduce(lambda a, b: a + b, [F.col(p) for p in URL_POINTS]), F.lit(100))
    lines = [
        F.when(F.col("u_http") > 0, F.lit(lx.URL_REASON_HTTP)),
        F.when(F.col("u_ip") > 0, F.lit(lx.URL_REASON_IP)),
        F.when(F.col("u_shortener") > 0, F.lit(lx.URL_REASON_SHORTENER)),
        F.when(F.col("u_tld") > 0, F.format_string(lx.URL_REASON_TLD, F.substring_index(host, ".", -1))),
        F.when(F.col("u_long") > 0, F.format_string(lx.URL_REASON_LONG, F.length(link))),
        F.when(F.col("u_dots") > 0, F.lit(lx.URL_REASON_DOTS)),
        F.when(F.col("u_homoglyph") > 0, F.lit(lx.URL_REASON_HOMOGLYPH)),
        F.when(F.col("u_brand") > 0, F.format_string(lx.URL_REASON_BRAND, F.col("_brand"))),
        F.when(
            F.col("u_path") > 0, F.format_string(lx.URL_REASON_PATH, F.array_join("_words", ", "))
        ),
    ]
    blank, broken = F.col("_blank"), F.col("_broken")
    score = F.when(blank, 0).when(broken, 50).otherwise(total)
    scored = checked.select("*", score.alias("url_score"), F.array_compact(F.array(*lines)).alias("_lines"))

    def ladder(values: tuple[str, ...]) -> Column:
        s = F.col("url_score")
        return (
            F.when(s >= 70, values[0]).when(s >= 40, values[1]).when(s >= 20, values[2]).otherwise(values[3])
        )

    reasons = (
        F.when(blank, F.array(F.lit(lx.URL_INVALID_REASON)))
        .when(broken, F.array(F.lit(lx.URL_BROKEN_REASON)))
        .when(F.size("_lines") == 0, F.array(F.lit(lx.NOTHING_FOUND)))
        .otherwise(F.col("_lines"))
    )
    live = ~blank & ~broken
    return scored.select(
        *df.columns,
        F.when(blank, text_or_empty(F.col(url))).otherwise(link).alias("url_scored"),
        *[F.when(live, F.col(p)).otherwise(0).alias(p) for p in URL_POINTS],
        "url_score",
        F.when(blank, lx.URL_INVALID_LEVEL)
        .when(broken, lx.URL_BROKEN_LEVEL)
        .otherwise(ladder(lx.URL_LEVELS))
        .alias("url_level"),
        reasons.alias("url_indicators"),
        F.when(blank, "").when(broken, lx.URL_BROKEN_ADVICE).otherwise(ladder(lx.URL_ADVICE)).alias("url_advice"),
        (live & (F.col("url_score") >= 70)).alias("is_dangerous"),
    )
