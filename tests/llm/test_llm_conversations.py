"""Conversation repair against a search over all audits, on cut conversations and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from loanstrata.llm import conversations
from loanstrata.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [] if fate == 0 else [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def plain_cheapest(rows, flags):
    """(cost, audit, turns) by plain strings: for every state the least (cost, audit) of all rows so far."""
    def moves(state, made):
        for name in made:
            for new in {"user": [(0, 2), (1, 2), (3, 2)], "assistant": [(2, 3)], "system": [(0, 1)]}.get(name, []):
                if new[0] == state:
                    yield new[1]

    def filled(best):
        for _ in range(6):
            for s, (cost, audit, turns) in list(best.items()):
                for name in ("user", "assistant"):
                    for t in moves(s, [name]):
                        new = (cost + 2, audit + "I", turns + ((name, ""),))
                        if t not in best or new[:2] < best[t][:2]:
                            best[t] = new
        return best

    best = filled({0: (0, "", ())})
    for (role, text), (must, late) in zip(rows, flags):
        new = {}
        for s, (cost, audit, turns) in best.items():
            options = [(s, (cost + 3, audit + "D", turns))]
            if not must:
                kind = {"s": "system", "u": "user", "a": "assistant"}.get(role[:1])
                options += [(t, (cost + late, audit + "K", turns + ((role, text),))) for t in moves(s, [kind])]
                for name in ("user", "assistant"):
                    options += [(t, (cost + 2 + late, audit + "R", turns + ((name, text),))) for t in moves(s, [name])]
            for t, option in options:
                if t not in new or option[:2] < new[t][:2]:
                    new[t] = option
        best = filled(new)
    return min((best[s] for s in (0, 3) if s in best), key=lambda b: b[:2])


def plain_audit(rows):
    """Rows of one conversation, already damaged."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    seen, flags, faults = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, _, role, text in rows:
        core = text.strip(SPACE)
        fault = ("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        flags.append((fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, left = plain_cheapest([r[2:] for r in rows], flags)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in left))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest), left


def expected(rows, damaged):
    return {c: plain_audit([r for r in damaged if r[0] == c])[0] for c in {r[0] for r in rows}}


def audited(df):
    return {r[0]: tuple(r)[1:] for r in df.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def random_rows(seed, conversations_, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t", "Done. ", "é?", "ok "]
    rows = []
    for c in range(conversations_):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice([*texts, f"text {t}.", f"text {c} {t}", None])))
    return rows


@pytest.mark.parametrize("part_rows", [20_000, 7])
def test_random_conversations(spark, monkeypatch, part_rows):
    monkeypatch.setattr(conversations, "PART_ROWS", part_rows)
    rows = random_rows(3, 60, 9) + [(500, t, ["user", "assistant", "system"][t * t % 3], f"t{t % 11}" + ".!x"[t % 3]) for t in range(150)]
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (700, None, None, None)] + [(600, 2, "user", "same.")] * 40
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("part", "digest", "step", "cost", "audit", "whole", "fate", "copy")})
    assert audited(conversations.audit(df)) == expected(rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert audited(conversations.audit_damaged(df)) == expected(rows, plain_damage(rows))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert audited(QUERIES["op13_conversation_repair"](spark, SMALL)) == expected(rows, plain_damage(rows))


def test_repaired_turns(spark):
    rows = [r for r in random_rows(5, 20, 8) if None not in r]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in conversations.repaired(df, conversations.audit(df)).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    for c in {r[0] for r in rows}:
        assert got.get(c, []) == list(plain_audit([r for r in rows if r[0] == c])[1])


def test_no_rows_and_all_dropped(spark):
    assert conversations.audit_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = audited(conversations.audit_damaged(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_comparison_of_audits_and_colliding_hashes(monkeypatch):
    rng = random.Random(2)

    def built(text):
        node = conversations.Node(None, "")
        for letter in text:
            node = conversations.Node(node, letter)
        return node

    words = ["".join(rng.choice("DIKR") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    words += [w + "K" for w in words[:20]] + [w[:5] + "D" + w[6:] for w in words[:20]]
    for modulus in (conversations.MOD, 3):
        monkeypatch.setattr(conversations, "MOD", modulus)
        nodes = [built(w) for w in words]
        for a, x in zip(words, nodes):
            assert x.spell() == a
            for b, y in zip(words, nodes):
                if a != b:
                    assert conversations.less(x, y) == (a < b), (a, b, modulus)
