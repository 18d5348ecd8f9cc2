"""SQL text the oracles share: the derived messages and an independent, relational scoring."""

from __future__ import annotations

from mailrisk import lexicon as lx
from mailrisk.config import DEFAULT as CFG
from mailrisk.functions.domains import OFFICIAL_DOMAINS
from mailrisk.functions.text import HEBREW, IP_LINK_PATTERN, SPACE, URL_PATTERN
from mailrisk.plans import mail_view as mv

# Braced hex needs the x in RE2: Java reads \x{..} as well, so SPACE is shared as it is.
SP = SPACE


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def draw(salt: str, *parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{salt}', {', '.join(parts)})), 1, 8))::BIGINT"


def h(salt: str) -> str:
    return draw(salt, "doc_id")


def pick(values, number: str) -> str:
    return f"{arr(values)}[({number}) % {len(values)} + 1]"


def hits(text: str, terms) -> str:
    return f"len(list_filter({arr(terms)}, lambda k: contains({text}, k)))"


def below(domain: str, officials: str) -> str:
    return f"(len(list_filter({officials}, lambda o: {domain} = o OR ends_with({domain}, '.' || o))) > 0)"


def sender_domain(c: str) -> str:
    return f"rtrim(lower(regexp_extract({c}, '@([A-Za-z0-9.\\-]+)', 1)), '.')"


def url_host(c: str) -> str:
    cut = f"regexp_extract({c}, '^(?:.*?://)?([^/?#]*)', 1)"
    return f"rtrim(lower(split_part(regexp_replace({cut}, '^.*@', ''), ':', 1)), '.')"


def organisation(c: str) -> str:
    return (
        f"CASE WHEN len(string_split({c}, '.')) >= 3 THEN string_split({c}, '.')[-3] "
        f"ELSE string_split({c}, '.')[1] END"
    )


def clean(c: str) -> str:
    out = f"regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g')"
    out = f"regexp_replace({out}, '(https?://[^{SP}]{{1,80}})[^{SP}]*', '\\1', 'g')"
    return f"trim(regexp_replace({out}, '[{SP}]+', ' ', 'g'))"


def py_round(c: str, digits: int = 2) -> str:
    """Half-even on the exact binary value, by the rounded product and its exact error."""
    s = f"{10 ** digits}::DOUBLE"
    p = f"({c} * {s})"
    split = f"({c} * 134217729::DOUBLE)"
    hi = f"({split} - ({split} - {c}))"
    err = f"(({hi} * {s} - {p}) + ({c} - {hi}) * {s})"
    frac = f"({p} - floor({p}))"
    up = (
        f"({frac} > 5e-1 OR ({frac} = 5e-1 AND ({err} > 0 OR ({err} = 0 AND floor({p})::BIGINT % 2 <> 0))))"
    )
    return f"((floor({p}) + CASE WHEN {up} THEN 1::DOUBLE ELSE 0::DOUBLE END) / {s})"


LABELLED = """
lab AS (
  SELECT d.doc_id, d.text, d.lang, d.source, l.toxic, l.quality
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""

MAIL = f"""{LABELLED},
M AS (
  SELECT doc_id AS msg_id,
    {h('u')} % 50 AS user_id,
    {pick(mv.SENDERS, h('s'))} AS sender,
    {pick(mv.SUBJECTS, h('j'))} AS subject,
    coalesce(text, '') || ' ' || {pick(mv.PASSAGES, h('c'))} AS content,
    1704067200 + {h('t')} % 2592000 AS at_epoch,
    coalesce(toxic, CASE WHEN {h('y')} % 100 < 48 THEN 1 ELSE 0 END)::INTEGER AS label,
    source, lang,
    ({h('m')} % {mv.MODEL_RANGE}) / 100::DOUBLE AS model_score
  FROM lab
)"""

_RAW_SENDERS = [s for s in mv.SENDERS if "." in s.rpartition("@")[2]]
RAW = f"""{LABELLED},
R AS (
  SELECT doc_id AS row_id,
    CASE WHEN {h('o')} % 10 = 0 THEN {pick(_RAW_SENDERS, h('s'))} ELSE '' END AS sender,
    replace({pick(mv.HEADERS, h('r'))}, '{{a}}', {pick(_RAW_SENDERS, h('s'))})
      || coalesce(text, '') || ' ' || {pick(mv.PASSAGES, h('c'))} AS text,
    coalesce(toxic, CASE WHEN {h('y')} % 100 < 48 THEN 1 ELSE 0 END)::INTEGER AS label,
    source
  FROM lab
)"""

CORPUS = f"""{LABELLED},
C AS (
  SELECT doc_id AS row_id, text, source, lang, substr(source, 4)::INTEGER AS source_rank,
    (CASE WHEN substr(source, 4)::INTEGER % 5 = 0 THEN 0
          WHEN substr(source, 4)::INTEGER % 5 = 1 THEN 1
          ELSE coalesce(toxic, CASE WHEN {h('y')} % 100 < 48 THEN 1 ELSE 0 END) END)::INTEGER AS label
  FROM lab
)"""


def prepared(source: str = "M", extra: str = "") -> str:
    """CTEs PL and P: lowered texts, links, hosts and sender facts of a message table."""
    return f"""
PL AS (
  SELECT *, lower(sender || ' ' || subject || ' ' || content) AS full_text, lower(subject) AS subj,
    lower(content) AS cont, lower(sender) AS sndr, {sender_domain('sender')} AS dom,
    regexp_extract_all(content, {q(URL_PATTERN)}) AS urls
  FROM {source}
),
P AS (
  SELECT *, list_transform(urls, lambda u: {url_host('u')}) AS hosts,
    dom <> '' AND {below('dom', arr(OFFICIAL_DOMAINS))}
      AND NOT {below('dom', arr(lx.FREE_MAIL))} AS trusted
  FROM PL
)"""


def _brand_rows() -> str:
    rows = []
    for i, (name, officials) in enumerate(lx.BRANDS.items()):
        ambiguous = "true" if name in lx.AMBIGUOUS_BRANDS else "false"
        rows.append(f"({i}, {q(name)}, {arr(officials)}, {ambiguous})")
    return ",\n    ".join(rows)


def _candidates(text: str, where: str, links: bool) -> str:
    edge = r"[^\p{L}\p{N}_]"
    pattern = f"'(^|{edge})' || regexp_escape(b.name) || '($|{edge})'"
    alnum = "regexp_replace({}, '[^a-z0-9]+', '', 'g')"
    claimed = (
        f"{alnum.format('b.name')} <> '' AND len(list_filter(list_concat([p.dom], p.hosts), lambda x: "
        f"contains({alnum.format('x')}, {alnum.format('b.name')}) "
        f"AND NOT {below('x', 'b.officials')})) > 0"
    )
    linked = (
        f"len(list_filter(p.hosts, lambda x: {below('x', 'b.officials')})) > 0" if links else "false"
    )
    return f"""
  SELECT msg_id, arg_min(CASE WHEN off OR linked THEN -1 ELSE ord END, ord) AS chosen
  FROM (
    SELECT p.msg_id, b.ord, b.ambiguous, {below('p.dom', 'b.officials')} AS off, {claimed} AS claimed,
      {linked} AS linked
    FROM {where} AND CASE WHEN contains(p.{text}, b.name)
      THEN regexp_matches(p.{text}, {pattern}) ELSE false END
  ) WHERE off OR NOT ambiguous OR claimed GROUP BY msg_id"""


def scored(source: str = "M") -> str:
    """CTEs up to S: points, rule score, reasons and legitimacy flags per message."""
    c = CFG

    def pts(cond: str, value: int) -> str:
        return f"CASE WHEN {cond} THEN {value} ELSE 0 END"

    def templ(template: str, *args: str) -> str:
        pieces = template.replace("%%", "%").split("%d" if "%d" in template else "%s")
        out = q(pieces[0])
        for piece, a in zip(pieces[1:], args):
            out += f" || {a} || {q(piece)}"
        return out

    mailbox = "CASE WHEN contains(sndr, '@') THEN string_split(sndr, '@')[-1] ELSE '' END"
    reasons = [
        f"CASE WHEN n_strong > 0 THEN {templ(lx.REASON_STRONG, 'n_strong')} END",
        f"CASE WHEN n_weak > 0 AND n_strong = 0 THEN {templ(lx.REASON_WEAK, 'n_weak')} END",
        f"CASE WHEN p_lookalike > 0 THEN {q(lx.REASON_LOOKALIKE)} END",
        f"CASE WHEN p_links > 0 THEN {templ(lx.REASON_LINKS, 'n_urls')} END",
        f"CASE WHEN p_urgency > 0 THEN {q(lx.REASON_URGENCY)} END",
        f"CASE WHEN p_suffix > 0 THEN {q(lx.REASON_SUFFIX)} END",
        f"CASE WHEN p_brand > 0 THEN {templ(lx.REASON_BRAND, 'brand', 'dom')} END",
        f"CASE WHEN p_ip > 0 THEN {q(lx.REASON_IP)} END",
        f"CASE WHEN p_shortener > 0 THEN {q(lx.REASON_SHORTENER)} END",
        f"CASE WHEN p_official > 0 THEN {q(lx.REASON_OFFICIAL)} END",
    ]
    points = ["p_strong", "p_weak", "p_lookalike", "p_links", "p_urgency", "p_suffix", "p_brand", "p_ip",
              "p_shortener", "p_official"]
    spoken = "(subj || ' ' || cont)"
    stays = (
        f"len(list_filter(hosts, lambda x: NOT (x = '' OR x = dom OR ends_with(x, '.' || dom) "
        f"OR (({organisation('x')}) = ({organisation('dom')}) AND ({organisation('x')}) <> '') "
        f"OR {below('x', arr(OFFICIAL_DOMAINS))}))) = 0"
    )
    return f"""{prepared(source)},
BR(ord, name, officials, ambiguous) AS (VALUES
    {_brand_rows()}
),
SB AS ({_candidates('subj', "P p, BR b WHERE p.dom <> '' AND NOT p.trusted", False)}
),
BB AS ({_candidates('cont', "P p ANTI JOIN SB USING (msg_id), BR b WHERE p.dom <> '' AND NOT p.trusted AND len(p.urls) > 0", True)}
),
S0 AS (
  SELECT P.*, coalesce(SB.chosen, BB.chosen, -1) AS chosen, SB.chosen IS NOT NULL AS by_subject
  FROM P LEFT JOIN SB USING (msg_id) LEFT JOIN BB USING (msg_id)
),
S1 AS (
  SELECT S0.*, BR.name AS brand,
    CASE WHEN chosen < 0 THEN NULL WHEN by_subject THEN 'subject' ELSE 'body' END AS brand_where,
    {hits('full_text', lx.STRONG_TERMS)} AS n_strong, {hits('full_text', lx.WEAK_TERMS)} AS n_weak,
    len(urls) AS n_urls
  FROM S0 LEFT JOIN BR ON BR.ord = S0.chosen
),
S2 AS (
  SELECT *, least(n_strong * {c.strong_points}, {c.strong_cap}) AS p_strong,
    least(n_weak * {c.weak_points}, {c.weak_cap}) AS p_weak,
    {pts(hits('sndr', lx.LOOKALIKE_PATTERNS) + ' > 0', c.lookalike_points)} AS p_lookalike,
    {pts(f'n_urls > {c.many_links_over}', c.many_links_points)} AS p_links,
    {pts(hits('full_text', lx.URGENCY_TERMS) + ' > 0', c.urgency_points)} AS p_urgency,
    {pts("contains(sndr, '@') AND " + hits('sndr', lx.ACCEPTED_SUFFIXES) + ' = 0', c.odd_suffix_points)} AS p_suffix,
    CASE brand_where WHEN 'subject' THEN {c.impersonation_subject_points}
      WHEN 'body' THEN {c.impersonation_body_points} ELSE 0 END AS p_brand,
    {pts(f"regexp_matches(content, {q(IP_LINK_PATTERN)})", c.ip_link_points)} AS p_ip,
    {pts(hits('cont', lx.MAIL_SHORTENERS) + ' > 0', c.shortener_points)} AS p_shortener,
    {pts(f"({hits('subj', lx.OFFICIAL_TERMS)} > 0 OR {hits('cont', lx.OFFICIAL_TERMS)} > 0) AND {hits(mailbox, lx.FREE_MAIL)} > 0", c.official_on_free_points)} AS p_official,
    {hits(spoken, lx.ATTACK_TERMS)} > 0 AS asks_credentials,
    {hits(spoken, lx.PROMO_TERMS)} > 0 AND {hits(spoken, lx.ATTACK_TERMS)} = 0 AS promotional,
    trusted AND {hits(spoken, lx.TRANSACTION_TERMS)} > 0 AND {hits(spoken, lx.ATTACK_TERMS)} = 0
      AND {stays} AS transactional
  FROM S1
),
S AS (
  SELECT *, least({' + '.join(points)}, 100) AS rule_score,
    CASE WHEN {' + '.join(points)} = 0 THEN [{q(lx.NOTHING_FOUND)}]
      ELSE list_filter([{', '.join(reasons)}], lambda r: r IS NOT NULL) END AS rule_reasons
  FROM S2
)"""


def level(score: str) -> str:
    low, medium, high = CFG.bands
    return (
        f"CASE WHEN {score} >= {high} THEN {q(lx.LEVEL_HIGH)} WHEN {score} >= {medium} THEN "
        f"{q(lx.LEVEL_MEDIUM)} WHEN {score} >= {low} THEN {q(lx.LEVEL_LOW)} ELSE {q(lx.LEVEL_SAFE)} END"
    )


def advice(score: str, reasons: str) -> str:
    low, medium, high = CFG.bands
    denial = " OR ".join(f"starts_with(i, {q(p)})" for p in lx.DENIAL_PREFIXES)
    real = f"len(list_filter({reasons}, lambda i: i <> '' AND NOT ({denial}))) > 0"
    return (
        f"CASE WHEN {score} >= {high} THEN {q(lx.ADVICE_HIGH)} WHEN {score} >= {medium} THEN "
        f"{q(lx.ADVICE_MEDIUM)} WHEN {score} >= {low} THEN {q(lx.ADVICE_LOW)} WHEN {real} THEN "
        f"{q(lx.ADVICE_WEAK_SIGNS)} ELSE {q(lx.ADVICE_SAFE)} END"
    )


def combined(multiplier: str, capped: bool = True) -> str:
    score = (
        f"least(greatest(model_score * {multiplier} + 5e-1 * rule_score::DOUBLE, rule_score::DOUBLE), 1e2)"
    )
    if not capped:
        return score
    return (
        f"CASE WHEN rule_score < {CFG.corroboration_floor} THEN least({score}, {CFG.ceiling}::DOUBLE) "
        f"ELSE {score} END"
    )


def dbl(value: float) -> str:
    return f"{value!r}::DOUBLE"


DAMPING = (
    f"CASE WHEN sender <> '' AND transactional THEN {dbl(CFG.transactional_damping)} "
    f"WHEN sender <> '' AND trusted AND NOT asks_credentials THEN {dbl(CFG.trust_damping)} ELSE 1e0 END"
)
REASON = (
    "CASE WHEN sender <> '' AND transactional THEN 'transactional' "
    "WHEN sender <> '' AND trusted AND NOT asks_credentials THEN 'known sender' ELSE 'none' END"
)
PROMO_REASON = (
    "CASE WHEN sender <> '' AND transactional THEN 'transactional' "
    "WHEN sender <> '' AND trusted AND NOT asks_credentials THEN 'known sender' "
    "WHEN promotional THEN 'promotional' ELSE 'none' END"
)


def variants(source: str = "M") -> str:
    """CTEs up to V: every compared score per message."""
    promo = (
        f"CASE WHEN promo_reason = 'promotional' THEN {dbl(CFG.promotional_damping)} ELSE d END"
    )
    return f"""{scored(source)},
V0 AS (SELECT *, {DAMPING} AS d, {REASON} AS reason, {PROMO_REASON} AS promo_reason FROM S),
V AS (
  SELECT *, rule_score::DOUBLE AS v_rules, model_score AS v_model, {combined('d')} AS v_ensemble,
    {combined('d', False)} AS v_uncapped, {combined(promo)} AS v_promo, {combined('1e0')} AS v_undamped,
    {dbl(CFG.legacy_model_weight)} * model_score + {dbl(CFG.legacy_rule_weight)} * rule_score AS v_legacy
  FROM V0
)"""


HEBREW_PATTERN = HEBREW
