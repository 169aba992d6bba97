"""Conversation repair against a plain search over all edits."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import pytest

from exprstudy.llm import turnrepair

FOLDER = "/root/testdata/sf0.001"
SOLID = re.compile(r"[^\x20\x09-\x0D]")
PATTERN = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out.extend([(conv, turn, role, text)] * (2 if fault == 3 else 1))
    return out


def plain_plan(codes):
    """The least (cost, audit) over layers of partial audits, one row after the other; no agenda."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserts(layer):
        layer = dict(layer)
        for _ in range(4):
            for state, (cost, audit) in list(layer.items()):
                for role in "ua":
                    if (state, role) in after:
                        new = after[state, role]
                        layer[new] = min(layer.get(new, (1 << 60, "")), (cost + 3, audit + "I"))
        return layer

    layer = inserts({"": (0, "")})
    for code in codes:
        new = {}

        def put(state, value):
            new[state] = min(new.get(state, (1 << 60, "")), value)

        for state, (cost, audit) in layer.items():
            put(state, (cost + 4, audit + "D"))
            if code == "d":
                continue
            more = 3 if code.isupper() else 0
            if (state, code.lower()) in after:
                put(after[state, code.lower()], (cost + more, audit + "K"))
            for role in "ua":
                if (state, role) in after:
                    put(after[state, role], (cost + 3 + more, audit + "R"))
        layer = inserts(new)
    return min(layer[s] for s in ("", "a") if s in layer)


def everything(codes):
    """The least (cost, audit) of all edit sequences with up to two insertions in a row, tried one by one."""
    best = (1 << 60, "")

    def go(i, roles, cost, audit, run):
        nonlocal best
        if (cost, audit) > best and cost > best[0]:
            return
        if i == len(codes) and PATTERN.fullmatch(roles):
            best = min(best, (cost, audit))
        if run < 2:
            for role in "ua":
                go(i, roles + role, cost + 3, audit + "I", run + 1)
        if i < len(codes):
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if codes[i] != "d":
                more = 3 if codes[i].isupper() else 0
                go(i + 1, roles + codes[i].lower(), cost + more, audit + "K", 0)
                for role in "ua":
                    go(i + 1, roles + role, cost + 3 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def plain_reports(rows):
    after = defaultdict(list)
    for row in plain_damage(rows):
        after[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(after[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:32].encode(), hashlib.md5(r[3].encode()).digest()))
        turns = {t for _, t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts, codes, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), "", set()
        for _, _, role, text in mine:
            solid = SOLID.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            code = role[:1] if role[:1] and role[:1] in "sua" else "x"
            codes += "d" if fault in ("blank", "duplicate") else code.upper() if fault else code
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_plan(codes)
        made, left = [], list(mine)
        for letter in audit:
            role, text = (None, "") if letter == "I" else left.pop(0)[2:]
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if made and made[-1][0][0] == "u" else "user"
            made.append((role, text))
        assert not left and PATTERN.fullmatch("".join(r[0] for r, _ in made))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def compare(frame):
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    got = turnrepair.reports(turnrepair.damaged(frame)).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == plain_reports(rows)
    assert len(got) == len({r[0] for r in rows})


def test_agenda_finds_the_least_of_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        codes = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(0, 4)))
        assert turnrepair.plan(codes) == everything(codes) == plain_plan(codes)


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(6)
    for size in (1, 3, 512):
        monkeypatch.setattr(turnrepair, "BLOCK", size)
        for _ in range(60):
            codes = "".join(rng.choice("suaxuauaSUAd") for _ in range(rng.randint(0, 40)))
            fed = turnrepair.Plan()
            for code in codes:
                fed.add(code)
            assert fed.result() == plain_plan(codes)


def test_agenda_stops_at_the_goal_and_waits_for_all_premises():
    d = turnrepair.Deduction
    steps = [d(("a", "b"), "c", 1, "x"), d(("a",), "c", 9, "y"), d(("c",), "goal", 0, "")]
    assert turnrepair.lightest({"a": (0, ""), "b": (2, "b")}, steps, {"goal"}) == {"goal": (3, "bx")}
    assert turnrepair.lightest({"b": (2, "b")}, steps, {"goal"}) == {}


ODD = [
    (1, 0, "system", "Be kind."),
    (1, 1, "user", "Hello there."),
    (1, 2, "assistant", "Yes!"),
    (1, 5, "user", "Hello there."),
    (1, 6, "assistant", "cut off he"),
    (2, None, "user", "No turn?"),
    (2, None, None, None),
    (2, 3, "", "nobody says this."),
    (2, 3, "tool", "out \x0b\n"),
    (None, 1, "user", "Whose is this?"),
    (None, None, "assistant", " "),
    (3, 4, "assistant", ""),
    (4, None, "user", None),
    (5, -3, "user", "a long one. " * 20_000),
    (5, 9, "assistant", "é日本." * 5),
    *[(6, t, "user", "Same again.") for t in (1, 1, 1, 2, 3)],
    *[(7, t, ("user", "assistant", "system")[t % 3], f"turn {t}" + "." * (t % 4 > 0)) for t in range(1500)],
]
ODD += [(c, t, "assistant" if t % 2 else "user", f"so it goes {c % 3}.") for c in range(20, 80) for t in range(c % 7)]


def test_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, gone_by string, kind int, mark string"
    frame = spark.createDataFrame([(*r, "x", 1, "m") for r in ODD], schema).repartition(5)
    compare(frame)
    assert turnrepair.reports(turnrepair.damaged(frame.where("conv_id > 1000"))).count() == 0


def test_repaired_turns_are_legal_and_give_the_digest(spark):
    frame = turnrepair.damaged(spark.createDataFrame(ODD, "conv_id bigint, turn bigint, role string, text string")).cache()
    found = defaultdict(list)
    for r in turnrepair.repaired(frame).orderBy("conv_id", "place").collect():
        assert r.place == len(found[r.conv_id])
        found[r.conv_id].append((r.edit, r.role, r.text))
    for r in turnrepair.reports(frame).collect():
        mine = found[r.conv_id]
        assert "".join(e for e, _, _ in mine) == r.audit.replace("D", "")
        assert PATTERN.fullmatch("".join(role[0] for _, role, _ in mine))
        assert hashlib.sha256("\n".join(f"{role}:{t}" for _, role, t in mine).encode()).hexdigest() == r.repaired_sha256


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
def test_given_conversations(spark):
    compare(spark.read.parquet(f"{FOLDER}/conversations.parquet"))
