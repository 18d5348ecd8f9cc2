"""Registered queries on corpus preparation and sender recovery, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT as CFG
from mailrisk.functions import senders as sd
from mailrisk.functions import text as tx
from mailrisk.operators import backfill as bf
from mailrisk.operators import corpus as cp
from mailrisk.plans import oracle_base as ob
from mailrisk.plans.mail_view import corpus_view, raw_view
from mailrisk.plans.registry import register
from mailrisk.session import materialise

q, arr, clean = ob.q, ob.arr, ob.clean

# Cleaned and deduplicated corpus, whole texts.
CLEAN_SQL = f"""{ob.CORPUS},
K AS (SELECT * REPLACE ({clean('text')} AS text) FROM C),
D AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, row_id) AS rn
    FROM K WHERE length(text) > {cp.MIN_TEXT_CHARS}
  ) WHERE rn = 1
)"""

QUOTA_SQL = """
ST AS (
  SELECT source, count(*) AS n, sum(label)::BIGINT AS positives,
    avg(label) >= 97e-2 OR avg(label) <= 3e-2 AS single_class
  FROM D GROUP BY source
),
QT AS (
  SELECT source, n, positives, single_class,
    CASE WHEN single_class AND mixed > 0
      THEN least(n, greatest(floor(floor(mixed * 15e-2 / 85e-2) / singles)::BIGINT, {floor}))
      ELSE n END AS quota
  FROM ST, (SELECT coalesce(sum(n) FILTER (WHERE NOT single_class), 0) AS mixed,
                   count(*) FILTER (WHERE single_class) AS singles FROM ST)
),
BAL AS (
  SELECT D.* FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('balance|' || text), row_id) AS pos FROM D
  ) D JOIN QT USING (source) WHERE pos <= quota
)"""

SPLIT_SQL = """
SZ AS (SELECT label, count(*) AS n FROM {src} GROUP BY label),
SP AS (
  SELECT r.*, CASE WHEN spos <= tr THEN 'train' WHEN spos <= tr + floor((n - tr) / 2::DOUBLE) THEN 'val'
    ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('split|' || text), row_id) AS spos FROM {src}) r
  JOIN (SELECT *, n - ceil(n * 3e-1) AS tr FROM SZ) z ON r.label = z.label
)"""


def unique_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, deduplicated corpus; written once because its readers pass over it several times."""
    return materialise(cp.dedup_text(cp.clean_texts(corpus_view(spark, sf_dir))), "corpus-unique")


@register("clean_text", f"""WITH {ob.CORPUS}
SELECT row_id, length({clean('text')}) AS n_chars, md5({clean('text')}) AS digest,
  md5(substring({clean('text')}, 1, {CFG.clean_chars})) AS stored_digest,
  length({clean('text')}) > {cp.MIN_TEXT_CHARS} AS kept FROM C""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = corpus_view(spark, sf_dir).select("row_id", tx.clean_text(F.col("text")).alias("t"))
    return cleaned.select(
        "row_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"),
        F.md5(F.substring("t", 1, CFG.clean_chars)).alias("stored_digest"),
        (F.length("t") > cp.MIN_TEXT_CHARS).alias("kept"),
    )


@register("corpus_clean_dedup", f"""WITH {CLEAN_SQL}
SELECT row_id, source, label, md5(text) AS digest FROM D""")
def corpus_clean_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = cp.dedup_text(cp.clean_texts(corpus_view(spark, sf_dir)))
    return unique.select("row_id", "source", "label", F.md5("text").alias("digest"))


@register("composite_dedup", f"""WITH {ob.RAW}, T AS (SELECT *, md5(substring(text, 1, 150)) AS opening FROM R)
SELECT 'source and label' AS key_kind, count(*) AS n_kept, sum(row_id)::BIGINT AS id_sum FROM (SELECT min(row_id) AS row_id FROM T GROUP BY source, label)
UNION ALL SELECT 'opening', count(*), sum(row_id)::BIGINT FROM (SELECT min(row_id) AS row_id FROM T GROUP BY opening)
UNION ALL SELECT 'text', count(*), sum(row_id)::BIGINT FROM (SELECT min(row_id) AS row_id FROM T GROUP BY text)""")
def composite_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row per composite key, per 150-character opening (the key itself), and per text."""
    rows = raw_view(spark, sf_dir).select("row_id", "source", "label", "text")
    keys = {
        "source and label": F.struct("source", "label"),
        "opening": F.substring("text", 1, 150),
        "text": F.sha2("text", 256),
    }
    out = None
    for kind, key in keys.items():
        slim = rows.select("row_id", key.alias("k"))
        kept = cp.dedup_first(slim, F.col("k"), ["row_id"]).agg(
            F.lit(kind).alias("key_kind"), F.count(F.lit(1)).alias("n_kept"), F.sum("row_id").alias("id_sum")
        )
        out = kept if out is None else out.unionByName(kept)
    return out


@register("source_balance", f"""WITH {CLEAN_SQL}, {QUOTA_SQL.format(floor=10)}
SELECT q.source, q.n, q.single_class, q.quota, count(b.row_id) AS n_kept, sum(b.row_id)::BIGINT AS id_sum
FROM QT q JOIN BAL b USING (source) GROUP BY ALL""")
def source_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = unique_corpus(spark, sf_dir)
    kept = cp.balance_sources(table, floor=10).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_kept"), F.sum("row_id").alias("id_sum")
    )
    quotas = cp.source_quotas(table, floor=10).select("source", "n", "single_class", "quota")
    return quotas.join(kept, "source")


@register("source_quotas", f"""WITH {CLEAN_SQL}, {QUOTA_SQL.format(floor=100)}
SELECT source, n, positives, single_class, quota FROM QT""")
def source_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.source_quotas(unique_corpus(spark, sf_dir))


@register("stratified_split", f"""WITH {CLEAN_SQL}, {SPLIT_SQL.format(src='D')}
SELECT row_id, label, split FROM SP""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.stratified_split(unique_corpus(spark, sf_dir)).select("row_id", "label", "split")


_LEAK = """SELECT '{kind}' AS kind, count(*) AS distinct_texts,
  count(*) FILTER (WHERE tr AND va) AS train_and_val, count(*) FILTER (WHERE tr AND te) AS train_and_test
  FROM (SELECT text, bool_or(split = 'train') AS tr, bool_or(split = 'val') AS va, bool_or(split = 'test') AS te
        FROM {src} GROUP BY text)"""


@register("split_leakage", f"""WITH {CLEAN_SQL}, {SPLIT_SQL.format(src='D')},
NV AS (SELECT text, ['train','train','train','val','test'][({ob.draw('nv', 'row_id')} % 5)::INTEGER + 1] AS split FROM K)
{_LEAK.format(kind='deduplicated', src='SP')} UNION ALL {_LEAK.format(kind='naive', src='NV')}""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts shared between splits: none after dedup, some when copies are split at random."""
    raw = corpus_view(spark, sf_dir).withColumn("text", tx.clean_text(F.col("text")))
    naive = raw.withColumn(
        "split", tx.pick(["train", "train", "train", "val", "test"], tx.draw("nv", F.col("row_id")))
    )
    ours = cp.split_leakage(cp.stratified_split(unique_corpus(spark, sf_dir)))
    return ours.select(F.lit("deduplicated").alias("kind"), "*").unionByName(
        cp.split_leakage(naive).select(F.lit("naive").alias("kind"), "*")
    )


@register("class_balance", f"""WITH {CLEAN_SQL}, {SPLIT_SQL.format(src='D')}
SELECT 'split' AS kind, split AS name, count(*) AS n_rows, sum(label)::BIGINT AS n_phishing,
  sum(label)::BIGINT / count(*)::DOUBLE AS share FROM SP GROUP BY split
UNION ALL SELECT 'source', source, count(*), sum(label)::BIGINT, sum(label)::BIGINT / count(*)::DOUBLE
FROM SP GROUP BY source""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = cp.stratified_split(unique_corpus(spark, sf_dir)).select("split", "source", "label")
    kinds = split.select(
        "label",
        F.explode(
            F.array(
                F.struct(F.lit("split").alias("kind"), F.col("split").alias("name")),
                F.struct(F.lit("source").alias("kind"), F.col("source").alias("name")),
            )
        ).alias("k"),
    ).select("label", "k.*")
    counted = kinds.groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("bigint").alias("n_phishing")
    )
    return counted.withColumn("share", F.col("n_phishing") / F.col("n_rows"))


@register("class_weights", f"""WITH {CLEAN_SQL}, N AS (SELECT label, count(*) AS n FROM D GROUP BY label)
SELECT label, n, 1e0 / n / (SELECT sum(1e0 / n) FROM N) * (SELECT count(*) FROM N) AS weight FROM N""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.class_weights(unique_corpus(spark, sf_dir))


@register("oversample_language", f"""WITH {CLEAN_SQL}, {SPLIT_SQL.format(src='D')}
SELECT split, lang, count(*) AS n_rows, count(DISTINCT row_id) AS n_originals, sum(copy)::BIGINT AS copy_sum
FROM (SELECT split, lang, row_id,
        unnest(range(1, CASE WHEN lang = 'fr' AND split = 'train' THEN 6 ELSE 2 END)) AS copy FROM SP)
GROUP BY split, lang""")
def oversample_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minority language repeated five times, in train only. French stands for the minority."""
    split = cp.stratified_split(unique_corpus(spark, sf_dir)).select("split", "lang", "row_id")
    repeated = cp.oversample(split, F.col("lang") == "fr")
    return repeated.groupBy("split", "lang").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("copy") == 1).alias("n_originals"),
        F.sum("copy").cast("bigint").alias("copy_sum"),
    )


@register("exact_sample", f"""WITH {ob.CORPUS}
SELECT row_id FROM C QUALIFY row_number() OVER (ORDER BY md5('sample|' || text || '|' || row_id), row_id)
  <= least(137, (SELECT count(*) FROM C))""")
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator itself: an exact number of rows, reproducible."""
    return cp.exact_sample(corpus_view(spark, sf_dir), 137).select("row_id")


@register("stratified_sample", f"""WITH {ob.CORPUS}
SELECT row_id, label FROM (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('stratified|' || text || '|' || row_id), row_id) AS pos,
    count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM C
) WHERE pos <= least(n, round(n * 300e0 / greatest(total, 1)::DOUBLE))""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.stratified_sample(corpus_view(spark, sf_dir), 300).select("row_id", "label")


@register("balanced_sample", f"""WITH {ob.CORPUS}
SELECT row_id, label FROM (
  SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('balanced|' || text || '|' || row_id), row_id) AS pos
  FROM C WHERE length(text) BETWEEN 40 AND 4500 AND NOT regexp_matches(text, '{ob.HEBREW_PATTERN}')
) WHERE pos <= 60""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.balanced_sample(cp.translatable(corpus_view(spark, sf_dir)), 120).select("row_id", "label")


@register("union_sources", f"""WITH {ob.RAW}, U AS (
  SELECT sender, subject, source FROM (SELECT row_id, sender, '' AS subject, source FROM R)
  UNION ALL SELECT '', '', 'unknown' FROM conversations
)
SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE sender <> '') AS n_sender,
  count(*) FILTER (WHERE subject = '') AS n_no_subject FROM U GROUP BY source""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = raw_view(spark, sf_dir)
    plain = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("row_id"), "text", F.lit(0).alias("label")
    )
    stacked = cp.union_sources([rich, plain])
    return stacked.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("sender") != "").alias("n_sender"),
        F.count_if(F.col("subject") == "").alias("n_no_subject"),
    )


# Sender recovery ------------------------------------------------------------------------------


def _clean_address(c: str) -> str:
    sp, wr = ob.SP, sd.WRAPPERS.replace("'", "''")
    bare = f"regexp_replace({c}, '^[{sp}]+|[{sp}]+$', '', 'g')"
    bare = f"lower(regexp_replace({bare}, '^[{wr}]+|[{wr}]+$', '', 'g'))"
    parts = f"string_split({bare}, '@')"
    return (
        f"CASE WHEN len({parts}) = 2 AND contains({parts}[2], '.') AND length({parts}[1]) <= 64 "
        f"AND length({parts}[2]) <= 255 AND length(string_split({parts}[2], '.')[-1]) >= 2 "
        f"THEN {bare} ELSE '' END"
    )


def _ok(c: str) -> str:
    return f"({c} <> '' AND NOT regexp_matches({c}, {q(sd.NOT_A_SENDER)}))"


def _extract_sql(source: str) -> str:
    blank = f"regexp_replace(l, '[{ob.SP}]+', '', 'g') = ''"

    def cleaned(raws: str) -> str:
        flat = f"flatten(list_transform({raws}, lambda r: regexp_extract_all(r, {q(sd.ADDRESS)})))"
        return f"list_transform({flat}, lambda a: {_clean_address('a')})"

    def first(addresses: str) -> str:
        return f"list_filter({addresses}, lambda a: {_ok('a')})[1]"

    methods = ",\n    ".join(
        f"{first(cleaned(f'regexp_extract_all(region, {q(p)}, 1)'))} AS m{i}"
        for i, (_, p) in enumerate(sd.HEADER_METHODS)
    )
    names = " ".join(f"WHEN m{i} IS NOT NULL THEN '{m}'" for i, (m, _) in enumerate(sd.HEADER_METHODS))
    values = " ".join(f"WHEN m{i} IS NOT NULL THEN m{i}" for i in range(len(sd.HEADER_METHODS)))
    return f"""
X0 AS (SELECT *, substring(text, 1, 8000) AS head, string_split(substring(text, 1, 8000), chr(10))[1:200] AS lines
  FROM {source}),
X1 AS (SELECT *, list_transform(lines, lambda l, i: {blank} OR (i > 3 AND NOT regexp_matches(l, {q(sd.HEADER_LINE)}))) AS stops FROM X0),
X2 AS (SELECT *, coalesce(list_position(stops, true) - 1, len(lines)) AS n_head FROM X1),
X3 AS (SELECT *, CASE WHEN n_head >= 3 THEN array_to_string(lines[1:n_head], chr(10)) ELSE '' END AS block,
  array_to_string(lines[1:8], chr(10)) AS top, array_to_string(lines[1:6], chr(10)) AS opening,
  substring(head, 1, 3000) AS near FROM X2),
X4 AS (SELECT *, CASE WHEN block <> '' THEN block ELSE top END AS region FROM X3),
X5 AS (SELECT *, {methods},
    {_clean_address(f"regexp_extract(near, {q(sd.FLAT_FROM)}, 1)")} AS flat,
    list_concat({cleaned(f"regexp_extract_all(region, {q(sd.RECIPIENT_LINE)}, 1)")},
      list_transform(regexp_extract_all(near, {q(sd.RECIPIENT_INLINE)}, 1), lambda a: {_clean_address('a')})) AS recipients,
    list_transform(regexp_extract_all(opening, {q(sd.ADDRESS)}), lambda a: {_clean_address('a')}) AS candidates
  FROM X4),
X6 AS (SELECT *, list_filter(candidates, lambda a: {_ok('a')} AND NOT list_contains(recipients, a))[1] AS bare FROM X5),
X AS (SELECT row_id, sender, text, label, source,
  CASE WHEN contains(trim(sender), '@') THEN lower(trim(sender)) WHEN NOT contains(head, '@') THEN '' {values}
    WHEN block = '' AND {_ok('flat')} THEN flat WHEN bare IS NOT NULL THEN bare ELSE '' END AS sender_extracted,
  CASE WHEN contains(trim(sender), '@') THEN 'already-present' WHEN NOT contains(head, '@') THEN '' {names}
    WHEN block = '' AND {_ok('flat')} THEN 'flat' WHEN bare IS NOT NULL THEN 'bare' ELSE '' END AS extract_method
  FROM X6)"""


EXTRACT_SQL = f"{ob.RAW}, {_extract_sql('R')}"


@register("sender_extract", f"WITH {EXTRACT_SQL} SELECT row_id, sender_extracted, extract_method FROM X")
def sender_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.with_extraction(raw_view(spark, sf_dir)).select("row_id", "sender_extracted", "extract_method")


def _fill_sql() -> str:
    def num(salt: str) -> str:
        return f"({ob.draw(salt, 'label', 'nth - 1', 'digest')})"

    def ladder(index: int, brand: bool) -> str:
        rows = [(n, w[index]) for n, *w in bf.pool_table() if w[index] > 0 and (brand or n not in lx.BRAND_POOLS)]
        total, upto, out = sum(w for _, w in rows), 0, "CASE"
        for name, weight in rows:
            upto += weight
            out += f" WHEN {num('pool')} % {total} < {upto} THEN '{name}'"
        return out + " END"

    brands = arr(lx.BRANDS)
    domains = arr(d[0] for d in lx.BRANDS.values())
    stem, tail = "split_part(official, '.', 1)", "substr(official, length(split_part(official, '.', 1)) + 1)"
    swap = " ".join(
        f"WHEN contains({stem}, '{a}') THEN substr({stem}, 1, instr({stem}, '{a}') - 1) || '{b}' || substr({stem}, instr({stem}, '{a}') + 1)"
        for a, b in (("o", "0"), ("l", "1"), ("i", "1"))
    )
    corp = ob.pick(lx.POOL_CORPORATE, num("domain"))
    free = ob.pick(lx.POOL_FREE, num("domain"))
    local = ob.pick(lx.POOL_LOCAL, num("local"))
    return f"""{EXTRACT_SQL},
F0 AS (SELECT *, md5(text) AS digest, sender_extracted = '' AS missing,
  list_filter({brands}, lambda b: contains(lower(text), b))[1] AS brand FROM X),
F1 AS (SELECT *, row_number() OVER (PARTITION BY digest, label, missing ORDER BY substr(md5(row_id::VARCHAR), 1, 2), row_id) AS nth,
  {domains}[list_position({brands}, brand)] AS official FROM F0),
F2 AS (SELECT *, CASE WHEN label = 1 AND brand IS NOT NULL THEN {ladder(0, True)}
  WHEN label = 1 THEN {ladder(0, False)} WHEN brand IS NOT NULL THEN {ladder(1, True)} ELSE {ladder(1, False)} END AS pool FROM F1),
F3 AS (SELECT *, CASE pool WHEN 'free' THEN {local} || '@' || {free} WHEN 'corporate' THEN {local} || '@' || {corp}
  WHEN 'no-reply' THEN {ob.pick(lx.POOL_NO_REPLY, num('box'))} || '@' || CASE WHEN {num('mix')} % 10 < 7 THEN {corp} ELSE {free} END
  WHEN 'odd-tld' THEN {local} || '@' || split_part({corp}, '.', 1) || {ob.pick(lx.POOL_TLDS, num('tld'))}
  WHEN 'brand-official' THEN {local} || '@' || official
  ELSE {local} || '@' || CASE {num('style')} % 6 WHEN 0 THEN {stem} || '-secure' || {tail} WHEN 1 THEN {stem} || '-verify' || {tail}
    WHEN 2 THEN 'secure-' || {stem} || {tail} WHEN 3 THEN (CASE {swap} ELSE {stem} || 's' END) || {tail}
    WHEN 4 THEN {stem} || {ob.pick(lx.POOL_TLDS, num('tail'))} ELSE {stem} || {ob.pick(lx.LOOKALIKE_TAILS, num('tail'))} || {tail} END
  END AS made FROM F2),
FL AS (SELECT *, CASE WHEN missing THEN made ELSE '' END AS sender_generated, CASE WHEN missing THEN pool ELSE 'extracted' END AS sender_pool,
  CASE WHEN missing THEN made ELSE sender_extracted END AS sender_filled FROM F3)"""


FILL_SQL = _fill_sql()


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.generate_senders(bf.extraction_table(raw_view(spark, sf_dir)))


@register("sender_backfill", f"WITH {FILL_SQL} SELECT row_id, label, sender_generated, sender_pool, sender_filled FROM FL")
def sender_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir).select("row_id", "label", "sender_generated", "sender_pool", "sender_filled")


@register("sender_coverage", f"""WITH {FILL_SQL}
SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE contains(sender, '@')) AS n_had,
  count(*) FILTER (WHERE sender_extracted <> '') AS n_extracted, count(*) FILTER (WHERE sender_filled <> '') AS n_filled,
  count(*) FILTER (WHERE sender_extracted <> '' AND source NOT IN ({', '.join(q(s) for s in lx.SYNTHETIC_SOURCES)})) AS n_genuine
FROM FL GROUP BY source""")
def sender_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.coverage(filled(spark, sf_dir), ["source"])


@register("sender_methods", f"""WITH {EXTRACT_SQL}
SELECT extract_method, count(*) AS n_rows, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share
FROM X WHERE sender_extracted <> '' GROUP BY extract_method""")
def sender_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.method_shares(bf.extraction_table(raw_view(spark, sf_dir)))


@register("sender_method_samples", f"""WITH {EXTRACT_SQL}
SELECT extract_method, row_id, label, sender_extracted, nth FROM (
  SELECT *, row_number() OVER (PARTITION BY extract_method ORDER BY row_id) AS nth FROM X WHERE sender_extracted <> ''
) WHERE nth <= 3""")
def sender_method_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.method_samples(bf.extraction_table(raw_view(spark, sf_dir)))


@register("top_sender_domains", f"""WITH {EXTRACT_SQL}
SELECT domain, n_rows, n_rows / total::DOUBLE AS share FROM (
  SELECT string_split(sender_extracted, '@')[-1] AS domain, count(*) AS n_rows, sum(count(*)) OVER () AS total
  FROM X WHERE sender_extracted <> '' GROUP BY 1) ORDER BY n_rows DESC, domain LIMIT 5""")
def top_sender_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.top_domains(bf.extraction_table(raw_view(spark, sf_dir)))


@register("pool_crosstab", f"""WITH {FILL_SQL}, T AS (
  SELECT sender_pool, count(*) FILTER (WHERE label = 0) AS n_legit, count(*) FILTER (WHERE label = 1) AS n_phish
  FROM FL WHERE sender_pool <> 'extracted' GROUP BY sender_pool)
SELECT *, coalesce(n_legit / nullif((sum(n_legit) OVER ())::DOUBLE, 0), 0) AS share_legit,
  coalesce(n_phish / nullif((sum(n_phish) OVER ())::DOUBLE, 0), 0) AS share_phish FROM T""")
def pool_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bf.pool_crosstab(filled(spark, sf_dir))


@register("sender_share", f"""WITH {ob.RAW} SELECT count(*) AS n_rows, count(*) FILTER (WHERE trim(sender) <> '') AS n_sender,
  count(*) FILTER (WHERE regexp_matches(text, '{ob.HEBREW_PATTERN}')) AS n_hebrew,
  count(*) FILTER (WHERE trim(sender) <> '') / count(*)::DOUBLE AS sender_share,
  count(*) FILTER (WHERE trim(sender) <> '') / count(*)::DOUBLE < 5e-1 AS partial_engine FROM R""")
def sender_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.sender_share(raw_view(spark, sf_dir))


@register("corpus_prepare", f"""WITH {EXTRACT_SQL},
K AS (SELECT row_id, sender_extracted AS sender, {clean('text')} AS text, label, source, substr(source, 4)::INTEGER AS source_rank FROM X),
D AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, row_id) AS rn FROM K
  WHERE length(text) > {cp.MIN_TEXT_CHARS}) WHERE rn = 1),
{QUOTA_SQL.format(floor=100)}, {SPLIT_SQL.format(src='BAL')},
OV AS (SELECT split, label, sender, unnest(range(1, CASE WHEN regexp_matches(text, '{ob.HEBREW_PATTERN}') AND split = 'train' THEN 6 ELSE 2 END)) AS copy FROM SP)
SELECT split, label, count(*) AS n_rows, count(*) FILTER (WHERE copy = 1) AS n_originals,
  count(*) FILTER (WHERE sender <> '') AS n_sender,
  (SELECT count(*) FROM (SELECT text FROM SP GROUP BY text HAVING bool_or(split = 'train') AND bool_or(split <> 'train'))) AS n_leaked
FROM OV GROUP BY split, label""")
def corpus_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sources to balanced, split and oversampled corpus, with the leak check."""
    raw = raw_view(spark, sf_dir).withColumn("source_rank", F.substring("source", 4, 10).cast("int"))
    corpus, leak = cp.prepare_corpus([raw])
    counted = corpus.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("copy") == 1).alias("n_originals"),
        F.count_if(F.col("sender") != "").alias("n_sender"),
    )
    # One row: the leak report is an aggregate over everything.
    leaked = leak.select((F.col("train_and_val") + F.col("train_and_test")).alias("n_leaked"))
    return counted.join(F.broadcast(leaked))
