"""URL rules by a sort-merge range join.

A host is written with its labels reversed and a dot after each, so a host and its subdomains are the keys
with one prefix, and a rule is an interval of keys. Addresses and rules are dealt out together by
ranges of (key, path, id). Each range is swept once in that order with a stack of the rules whose interval is
open; a host's rules lie on top of those of the domains above it. Rules opened in an earlier range are handed to
a range by equality with the domains of its first key, a few rows per range. No range depends on
another, a popular host is split by path and id, and memory holds the rules of one chain of domains.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk.session import materialise

DEFAULT = "allow"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels with a dot after each; the empty host is the root of all."""
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.concat_ws(".", labels), F.lit(".")))


def _domains(key: Column) -> Column:
    """Keys of a host and of the domains above it, the root included."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(key), F.lit(1)))
    dots = F.filter(places, lambda i: F.substring(key, i, F.lit(1)) == ".")
    return F.concat(F.array(F.lit("")), F.transform(dots, lambda i: F.substring(key, F.lit(1), i)))


_ROWS = "p int, carried int, key string, path string, kind int, id bigint, host string, verdict string"


class _Stack:
    """Open rules, outermost domain first: per domain its paths with their rule and verdict."""

    def __init__(self):
        self.open: list[tuple[str, dict[str, tuple[str, str]], set[int]]] = []

    def close_before(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, path: str, host: str, verdict: str) -> None:
        self.close_before(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, set()))
        _, paths, lengths = self.open[-1]
        old = paths.get(path)
        # The same rule twice: to block wins.
        if old is None or verdict == "block":
            paths[path] = (host + path, verdict)
        lengths.add(len(path))

    def longest(self, path: str) -> tuple[str, str] | None:
        best = None
        for _, paths, lengths in self.open:
            for n in lengths:
                if n <= len(path) and (hit := paths.get(path[:n])) and (best is None or len(hit[0]) >= len(best[0])):
                    best = hit
        return best


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack, part = _Stack(), None
    for batch in batches:
        ids, hosts, paths, rules, verdicts = [], [], [], [], []
        for p, _, key, path, kind, id_, host, verdict in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                stack, part = _Stack(), p
            if kind == 0:
                stack.add(key, path, host, verdict)
                continue
            stack.close_before(key)
            hit = stack.longest(path)
            ids.append(id_)
            hosts.append(host)
            paths.append(path)
            rules.append(hit[0] if hit else None)
            verdicts.append(hit[1] if hit else DEFAULT)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in (hosts, paths, rules, verdicts))],
            ["id", "host", "path", "rule", "verdict"],
        )


def judge(pages: DataFrame, key: str, url: str, rules: DataFrame) -> DataFrame:
    """One row per page: ``key`` (bigint), ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``). A rule fits its host and all subdomains if
    the page's path starts with the rule's; of several the one with the longest host and path together
    wins, of equally long ones that of the longer host; of one rule given twice with both verdicts, ``block``. A rule
    with an empty host fits every host. Where none fits, ``rule`` is null and the verdict ``allow``. A null
    url, or one without ``://``, has an empty host and path. Null parts of a rule count as empty. Null ids and
    repeated rows are kept; empty tables are fine; other columns are not read.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    asked = pages.select(
        host_key(host).alias("key"), path.alias("path"), F.lit(1).alias("kind"),
        F.col(key).cast("bigint").alias("id"), host.alias("host"), F.lit(None).cast("string").alias("verdict"),
    )
    rule_host = F.lower(F.coalesce("host", F.lit("")))
    given = rules.select(
        host_key(rule_host).alias("key"), F.coalesce("path", F.lit("")).alias("path"), F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("id"), rule_host.alias("host"), "verdict",
    ).distinct()
    # Sorted by (key, kind, path, id) a host's rules come before its pages.
    order = ["key", "kind", "path", "id"]
    dealt = asked.unionByName(given).repartitionByRange(*order).withColumn("p", F.spark_partition_id())
    dealt = materialise(dealt, "url-ranges")
    # A range starts with the rules of its first key's domains that lie in earlier ranges.
    starts = dealt.groupBy("p").agg(F.min("key").alias("first")).select("p", F.explode(_domains(F.col("first"))).alias("key"))
    before = dealt.filter("kind = 0").withColumnRenamed("p", "q")
    carried = starts.join(before, "key").filter("q < p").withColumn("carried", F.lit(0)).drop("q")
    rows = dealt.withColumn("carried", F.lit(1)).unionByName(carried)
    columns = [c.split()[0] for c in _ROWS.split(", ")]
    swept = (
        rows.select(*columns)
        .repartition("p")
        .sortWithinPartitions("p", "carried", *order)
        .mapInArrow(_sweep, "id bigint, host string, path string, rule string, verdict string")
    )
    return swept.withColumnRenamed("id", key)
