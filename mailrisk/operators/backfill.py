"""Filling missing senders: extraction first, then label-aware draws from shared pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.functions.senders import extract_sender
from mailrisk.functions.terms import first_term
from mailrisk.functions.text import draw, pick, strip_space, text_or_empty
from mailrisk.operators import hot_groups as hg
from mailrisk.session import materialise


def with_extraction(df: DataFrame) -> DataFrame:
    """Add ``sender_extracted`` and ``extract_method``; a sender already present is kept."""
    present = strip_space(F.col("sender"))
    has = F.contains(present, F.lit("@"))
    found = extract_sender(df, "text")
    return found.select(
        *df.columns,
        F.when(has, F.lower(present)).otherwise(F.col("extracted")).alias("sender_extracted"),
        F.when(has, "already-present").otherwise(F.col("extract_method")).alias("extract_method"),
    )


def extraction_table(df: DataFrame) -> DataFrame:
    """Extraction, text digest and named brand per row, written once to the shared folder.

    Every report and the back-fill read this narrow table. Without it a filter or join on an
    extracted column would be pushed below the extraction and run it again for every use.
    """
    facts = with_extraction(df).select(
        "row_id", "label", "source", "sender", "sender_extracted", "extract_method",
        F.md5(text_or_empty(F.col("text"))).alias("text_digest"),
        first_brand(F.col("text")).alias("brand"),
    )
    return materialise(facts, "senders")


def first_brand(text: Column, first_chars: int | None = None) -> Column:
    """First brand, in list order, named anywhere in the text (plain containment)."""
    lowered = F.lower(text_or_empty(text))
    if first_chars is not None:
        lowered = F.substring(lowered, 1, first_chars)
    return first_term(lowered, list(lx.BRANDS))


def lookalike(domain: Column, number: Column, second: Column) -> Column:
    """An imitation of a domain in one of six styles."""
    stem = F.substring_index(domain, ".", 1)
    rest = F.regexp_extract(domain, r"^[^.]*(\..*)$", 1)
    tail = F.when(F.contains(domain, F.lit(".")), rest).otherwise(".com")
    swapped = (
        F.when(F.contains(stem, F.lit("o")), F.regexp_replace(stem, "^([^o]*)o", "$1\\0"))
        .when(F.contains(stem, F.lit("l")), F.regexp_replace(stem, "^([^l]*)l", "$1\\1"))
        .when(F.contains(stem, F.lit("i")), F.regexp_replace(stem, "^([^i]*)i", "$1\\1"))
        .otherwise(F.concat(stem, F.lit("s")))
    )
    style = F.pmod(number, F.lit(6))
    return (
        F.when(style == 0, F.concat(stem, F.lit("-secure"), tail))
        .when(style == 1, F.concat(stem, F.lit("-verify"), tail))
        .when(style == 2, F.concat(F.lit("secure-"), stem, tail))
        .when(style == 3, F.concat(swapped, tail))
        .when(style == 4, F.concat(stem, pick(lx.POOL_TLDS, second)))
        .otherwise(F.concat(stem, pick(lx.LOOKALIKE_TAILS, second), tail))
    )


def pool_table() -> list[tuple[str, int, int]]:
    """Pools with their weights in hundredths (phishing, legitimate)."""
    return [(name, round(p * 100), round(q * 100)) for name, (p, q) in lx.POOLS.items()]


def choose_pool(label: Column, has_brand: Column, number: Column) -> Column:
    """Weighted draw; the two brand pools take part only when the text names a brand."""

    def ladder(index: int, brand: bool) -> Column:
        rows = [
            (name, weights[index])
            for name, *weights in pool_table()
            if weights[index] > 0 and (brand or name not in lx.BRAND_POOLS)
        ]
        roll = F.pmod(number, F.lit(sum(w for _, w in rows)))
        out, upto = None, 0
        for name, weight in rows:
            upto += weight
            out = F.when(roll < upto, name) if out is None else out.when(roll < upto, name)
        return out

    phishing = label == 1
    return (
        F.when(phishing & has_brand, ladder(0, True))
        .when(phishing, ladder(0, False))
        .when(has_brand, ladder(1, True))
        .otherwise(ladder(1, False))
    )


def generate_senders(df: DataFrame) -> DataFrame:
    """Add ``sender_generated``, ``sender_pool``, ``sender_filled`` to an extraction table.

    Draws are seeded by label, occurrence number and the whole text, so a row gets the same
    address in every run. Occurrences of one text are numbered in salted slices.
    """
    numbered = hg.salted_row_number(
        df.withColumn("_missing", F.col("sender_extracted") == ""),
        ["text_digest", "label", "_missing"], "row_id", "_nth",
    )

    def number(salt: str) -> Column:
        return draw(salt, F.col("label"), F.col("_nth") - 1, F.col("text_digest"))

    official = F.element_at(
        F.from_json(F.lit(_first_domains()), "map<string,string>"), F.col("brand")
    )
    local = pick(lx.POOL_LOCAL, number("local"))
    pooled = numbered.select(
        "*",
        choose_pool(F.col("label"), F.col("brand").isNotNull(), number("pool")).alias("_pool"),
        official.alias("_official"),
    )
    no_reply_domain = F.when(
        number("mix") % 10 < 7, pick(lx.POOL_CORPORATE, number("domain"))
    ).otherwise(pick(lx.POOL_FREE, number("domain")))
    odd = F.concat(
        F.substring_index(pick(lx.POOL_CORPORATE, number("domain")), ".", 1), pick(lx.POOL_TLDS, number("tld"))
    )
    at = F.lit("@")
    address = (
        F.when(F.col("_pool") == "free", F.concat(local, at, pick(lx.POOL_FREE, number("domain"))))
        .when(F.col("_pool") == "corporate", F.concat(local, at, pick(lx.POOL_CORPORATE, number("domain"))))
        .when(F.col("_pool") == "no-reply", F.concat(pick(lx.POOL_NO_REPLY, number("box")), at, no_reply_domain))
        .when(F.col("_pool") == "odd-tld", F.concat(local, at, odd))
        .when(F.col("_pool") == "brand-official", F.concat(local, at, F.col("_official")))
        .otherwise(F.concat(local, at, lookalike(F.col("_official"), number("style"), number("tail"))))
    )
    missing = F.col("_missing")
    return pooled.select(
        *df.columns,
        F.when(missing, address).otherwise("").alias("sender_generated"),
        F.when(missing, F.col("_pool")).otherwise("extracted").alias("sender_pool"),
        F.when(missing, address).otherwise(F.col("sender_extracted")).alias("sender_filled"),
    )


def _first_domains() -> str:
    import json

    return json.dumps({name: domains[0] for name, domains in lx.BRANDS.items()})


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows that had a sender, that got one by extraction, by filling, and from genuine sources."""
    found = F.col("sender_extracted") != ""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.contains(text_or_empty(F.col("sender")), F.lit("@"))).alias("n_had"),
        F.count_if(found).alias("n_extracted"),
        F.count_if(F.col("sender_filled") != "").alias("n_filled"),
        F.count_if(found & ~F.col("source").isin(lx.SYNTHETIC_SOURCES)).alias("n_genuine"),
    )


def method_shares(df: DataFrame) -> DataFrame:
    """How senders were found, as shares of the rows that have one."""
    counted = (
        df.filter("sender_extracted <> ''").groupBy("extract_method").agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return counted.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(W.partitionBy(F.lit(0))))


def top_domains(df: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent sender domains with their share of all found senders."""
    counted = (
        df.filter("sender_extracted <> ''")
        .groupBy(F.substring_index("sender_extracted", "@", -1).alias("domain"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    total = counted.agg(F.sum("n_rows").alias("_total"))
    top = counted.orderBy(F.desc("n_rows"), "domain").limit(n)
    return top.join(F.broadcast(total)).select("domain", "n_rows", (F.col("n_rows") / F.col("_total")).alias("share"))


def pool_crosstab(df: DataFrame) -> DataFrame:
    """Generated mixture per class: share of each pool within legitimate and phishing rows."""
    made = df.filter(F.col("sender_pool").isin(list(lx.POOLS)))
    table = made.groupBy("sender_pool").pivot("label", [0, 1]).count().fillna(0, ["0", "1"])
    everywhere = W.partitionBy(F.lit(0))

    def share(c: str) -> Column:
        total = F.sum(c).over(everywhere)
        return F.when(total > 0, F.col(c) / total).otherwise(0.0)

    return table.select(
        "sender_pool", F.col("0").alias("n_legit"), F.col("1").alias("n_phish"),
        share("0").alias("share_legit"), share("1").alias("share_phish"),
    )


def method_samples(df: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` rows of each extraction method, to look at. Pruned before the shuffle."""
    order = W.partitionBy("extract_method").orderBy("row_id")
    return (
        df.filter("sender_extracted <> ''")
        .select("extract_method", "row_id", "label", "sender_extracted")
        .withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= n)
    )


def write_filled(corpus: DataFrame, filled: DataFrame, path: str) -> None:
    """Store the corpus under a new path with ``sender`` replaced by the filled one."""
    keep = [c for c in ("row_id", "subject", "text", "label", "source", "split") if c in corpus.columns]
    senders = filled.select("row_id", F.col("sender_filled").alias("sender"), "sender_pool")
    out = corpus.select(*keep).join(senders, "row_id")
    writer = out.write.mode("errorifexists")
    (writer.partitionBy("split") if "split" in keep else writer).parquet(path)
