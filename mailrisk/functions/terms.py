"""Finding many fixed terms in a text in one pass.

The rules look for about 300 terms as substrings. One ``contains`` per term reads each text 300
times; an Aho-Corasick automaton reads it once, in Arrow batches on the executors. Every term has a bit, so the
terms of a message are one number, and a list of terms is a mask of it.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailrisk import lexicon as lx
from mailrisk.functions import text as tx

HIT_SCHEMA = (
    "n_strong int, n_weak int, urgent boolean, attack boolean, promo boolean, order_words boolean, "
    "official boolean, shortener boolean, brands_subject array<int>, brands_content array<int>"
)
_CACHE: dict = {}


def automaton(terms: Sequence[str]):
    """Automaton over ``terms``; one per Python worker and list."""
    key = tuple(terms)
    if key not in _CACHE:
        machine = ahocorasick.Automaton()
        for i, term in enumerate(key):
            machine.add_word(term, (i, len(term)))
        machine.make_automaton()
        _CACHE[key] = machine
    return _CACHE[key]


_LISTS = {
    "strong": lx.STRONG_TERMS, "weak": lx.WEAK_TERMS, "urgent": lx.URGENCY_TERMS, "attack": lx.ATTACK_TERMS,
    "promo": lx.PROMO_TERMS, "order": lx.TRANSACTION_TERMS, "official": lx.OFFICIAL_TERMS, "shortener": lx.MAIL_SHORTENERS,
    "brands": list(lx.BRANDS),
}


def _scanner():
    """Automaton whose hits are (bit of the term, length), the mask of each list, and the brands' bits in order."""
    if "scanner" not in _CACHE:
        every = list(dict.fromkeys(t for terms in _LISTS.values() for t in terms))
        bit = {t: 1 << i for i, t in enumerate(every)}
        machine = ahocorasick.Automaton()
        for term in every:
            machine.add_word(term, (bit[term], len(term)))
        machine.make_automaton()
        masks = {name: sum(bit[t] for t in set(terms)) for name, terms in _LISTS.items()}
        _CACHE["scanner"] = machine, masks, [bit[b] for b in lx.BRANDS]
    return _CACHE["scanner"]


def _scan_messages(sender: pd.Series, subject: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Per message, which lists hit and where. Positions tell sender, subject and content apart."""
    machine, mask, brand_bits = _scanner()
    strong, weak, urgent, attack, promo, order, official, shortener, brands = mask.values()

    def brands_of(found: int) -> list[int]:
        return [i for i, b in enumerate(brand_bits) if found & b] if found & brands else []

    rows = []
    for s, j, c in zip(sender, subject, content):
        subject_at = len(s) + 1
        content_at = subject_at + len(j) + 1
        anywhere = spoken = in_subject = in_content = 0
        for end, (term, length) in machine.iter(f"{s} {j} {c}"):
            start = end - length + 1
            anywhere |= term
            if start >= content_at:
                in_content |= term
            elif start >= subject_at:
                spoken |= term
                if end < content_at - 1:
                    in_subject |= term
        spoken |= in_content
        rows.append((
            (anywhere & strong).bit_count(), (anywhere & weak).bit_count(), anywhere & urgent != 0, spoken & attack != 0,
            spoken & promo != 0, spoken & order != 0, (in_subject | in_content) & official != 0,
            in_content & shortener != 0, brands_of(in_subject), brands_of(in_content),
        ))
    return pd.DataFrame(rows, columns=[part.split()[0] for part in HIT_SCHEMA.split(", ")])


def with_hits(df: DataFrame) -> DataFrame:
    """Add ``_hits`` to a frame with ``_sender``, ``_subject``, ``_content``, ``_full``, ``_hebrew``."""
    return df.select("*", F.pandas_udf(_scan_messages, HIT_SCHEMA)("_sender", "_subject", "_content").alias("_hits"))


def first_term(text: Column, terms: Sequence[str]) -> Column:
    """First of ``terms``, in list order, that occurs in the text."""
    names = list(terms)

    def lowest(texts: pd.Series) -> pd.Series:
        machine = automaton(names)
        return texts.map(lambda t: min((i for _, (i, _) in machine.iter(t)), default=-1))

    return F.get(tx.literal_array(names), F.pandas_udf(lowest, "int")(text))
