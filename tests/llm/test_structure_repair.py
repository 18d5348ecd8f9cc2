import hashlib
import random
from functools import cache
from zlib import crc32

import numpy as np
import pytest

from mailrisk.llm import structure_repair
from mailrisk.llm.structure_repair import Repair, damage, solve_blocks, structure_report

SCHEMA = "conv_id long, turn long, role string, text string, kind int, n int, part string, symbol int, audit string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            x = ""
        if kind == 2:
            x = "".join(ch for ch in x if ch not in ".!?")
        if kind == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """Least (cost, audit) by trying every edit at every node; a turn is (initial, truncated, must go)."""
    def step(q, c):
        return {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}.get((q, c))

    n = len(turns)
    best = {}
    for i in range(n, -1, -1):
        here = {}
        for q in "0123":
            ways = [(0, "")] if i == n and q in "03" else []
            if i < n:
                c, cut, gone = turns[i]
                ways.append((3 + best[i + 1, q][0], "D" + best[i + 1, q][1]))
                for letter, price, roles in (("K", 0, c), ("R", 2, "ua")):
                    ways += [(price + cut + best[i + 1, to][0], letter + best[i + 1, to][1])
                             for r in roles if not gone and (to := step(q, r))]
            here[q] = min(ways, default=(10**9, ""))
        for _ in range(4):
            for q in "0123":
                for r in "ua":
                    if to := step(q, r):
                        here[q] = min(here[q], (2 + here[to][0], "I" + here[to][1]))
        best |= {(i, q): v for q, v in here.items()}
    return best[0, "0"]


def brute(original, rows):
    out = []
    for c in dict.fromkeys(r[0] for r in original):
        own = [r[1:] for r in rows if r[0] == c]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, turns, counts, illegal = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0
        for i, (_, role, text) in enumerate(own):
            kept = text.rstrip(WHITE)
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            turns.append((role[:1], int(fault == "truncated"), fault in ("blank", "duplicate")))
            illegal += i > 0 and (own[i - 1][1][:1] + "|" + role[:1]) not in ("s|u", "u|a", "a|u")
        cost, audit = cheapest(turns)
        lines, at, state = [], 0, ""
        for letter in audit:
            if letter == "D":
                at += 1
                continue
            other = "assistant" if state == "user" else "user"
            role, text = (other, "") if letter == "I" else own[at][1:]
            at += letter != "I"
            role = other if letter == "R" else role
            state = {"u": "user", "a": "assistant", "s": "system"}[role[0]]
            lines.append(f"{role}:{text}")
        numbers = [r[0] for r in own if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((c, gaps, *counts.values(), illegal, cost, audit, digest))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def report(spark, rows, block=2048):
    df = spark.createDataFrame([(*r, 1, 2, "p", 3, "x") for r in rows], SCHEMA)
    hurt = damage(df, "conv_id", "turn", "role", "text").withColumnRenamed("conv", "conv_id")
    return structure_report(hurt, "conv_id", "turn", "role", "text", df, block)


def made(seed, conversations, longest):
    random.seed(seed)
    rows = []
    for c in range(conversations):
        for t in range(random.randint(1, longest)):
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "uncle"])
            text = random.choice(["Yes.", "No", "yes!", "", None, " \t", "Why? ", "ok", f"text {t}.", f"text {t}", "é "])
            rows.append((c, random.choice([t, t, t, t, t + 1, None]), role, text))
    return rows


@pytest.mark.parametrize("block", [3, 2048])
def test_equals_brute_force(spark, block):
    rows = made(1, 60, 25) + [(None, 0, "user", "Hi."), (None, 1, "user", None), (777, 0, "user", "x" * 300_000 + ".")]
    rows += [(500, t % 4, "user", "Again.") for t in range(30)] + [(501, 1, "assistant", "cut off")] * 9
    assert rows_of(report(spark, rows, block)) == brute(rows, damaged(rows))


def test_empty_and_dropped(spark):
    assert report(spark, []).count() == 0
    gone = next(c for c in range(100) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert rows_of(report(spark, [(gone, 0, "user", "Hi.")])) == [
        (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_are_well_formed(spark):
    rows = [r for r in made(4, 30, 12)]
    df = spark.createDataFrame([(*r, 1, 2, "p", 3, "x") for r in rows], SCHEMA)
    repair = Repair(df, "conv_id", "turn", "role", "text")
    by_conv = {}
    for r in repair.repaired_turns().orderBy("conv", "position").collect():
        by_conv.setdefault(r.conv, []).append(r)
    import re

    assert by_conv
    for turns in by_conv.values():
        assert [t.position for t in turns] == list(range(len(turns)))
        assert re.fullmatch("s?(ua)+", "".join(t.role[0] for t in turns))
        assert all((t.text == "") == (t.edit == "I") for t in turns)


def test_blocks_chain_like_one():
    random.seed(8)
    turns = bytes(random.choice([0, 1, 2, 1, 2, 3, 5, 6, 9, 10]) for _ in range(500))
    whole = solve_blocks([turns], structure_repair._END[None, :])[0][0]

    @cache
    def behind(at):
        if at >= len(turns):
            return tuple(structure_repair._END)
        costs = structure_repair.block_matrices([turns[at : at + 37]])[0]
        return tuple((costs + np.array(behind(at + 37))).min(axis=1))

    state, audit = 0, b""
    for at in range(0, len(turns), 37):
        part, _, state = solve_blocks([turns[at : at + 37]], np.array([behind(at + 37)]))[0][state]
        audit += part
    assert (audit, state) == (whole[0], whole[2])
