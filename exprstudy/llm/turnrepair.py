"""Repair of conversation structure by lightest derivations.

A conversation is a run of rows ordered by turn.  Its repair is deduced: the item
``(i, state)`` says that the first ``i`` rows have been made into a legal beginning that ends
in ``state``.  A deduction takes such an item together with the item of row ``i`` and keeps,
reroles or deletes the row, or takes it alone and inserts a turn.  The value of an item is
``(cost, audit)``; a deduction adds its cost and appends its letter, so it never gives less
than its premises get, and a lesser premise never gives more: such functions are superior,
and Knuth's agenda may settle items in ascending order of value until the goal is settled.
Two audits of one item are never equal in cost and one the beginning of the other, since the
longer one would have insertions left over; that is what makes appending monotone.

Only faults and role initials decide, so the agenda sees one letter a row and answers are
remembered by their letters.  A long conversation is worked off in blocks: the items at the
end of a block are the axioms of the next one, and what their audits have in common is
settled.  Rows travel twice: short ones (no texts) to find the plans, then the texts once,
in the same order, to be repaired while they stream by.  A copy of a turn finds its first
place by an aggregate over (conversation, role, digest), not by a set in memory.  So no
conversation is ever held whole, however long; its audit, one cell by contract, is.

Cases: rows of one turn come in the order of role, the first 32 characters and the digest of
the text; a null turn comes first and counts for no gap; a null role or text is one space; an
empty role has no initial; rows with a null ``conv_id`` are one conversation; equal rows are
copies, the first stays; a conversation whose rows are all gone has the empty plan; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from exprstudy.session import durable

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: Added to the cost of a truncated row that stays.
TRUNCATED = 3

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL_ENDS = (EMPTY, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")

#: Rows of one conversation that an agenda works off at once.
BLOCK = 512

_SPACES = " \t\n\x0b\f\r"

Value = tuple[int, str]


# --- the agenda ----------------------------------------------------------------


@dataclass(slots=True)
class Deduction:
    """From all of ``premises`` follows ``conclusion``, at a cost and with a letter."""

    premises: tuple
    conclusion: object
    cost: int
    letter: str
    open: int = 0


def lightest(axioms: dict, deductions: list[Deduction], goals: set) -> dict:
    """The least ``(cost, audit)`` of every goal that can be deduced (Knuth 1977)."""
    uses: dict = {}
    for d in deductions:
        d.open = len(d.premises)
        for p in d.premises:
            uses.setdefault(p, []).append(d)
    agenda = [(cost, audit, item) for item, (cost, audit) in axioms.items()]
    heapq.heapify(agenda)
    settled: dict = {}
    missing = set(goals)
    while agenda and missing:
        cost, audit, item = heapq.heappop(agenda)
        if item in settled:
            continue
        settled[item] = (cost, audit)
        missing.discard(item)
        for d in uses.get(item, ()):
            d.open -= 1
            if d.open == 0:
                values = [settled[p] for p in d.premises]
                total = sum(v[0] for v in values) + d.cost
                heapq.heappush(agenda, (total, "".join(v[1] for v in values) + d.letter, d.conclusion))
    return {g: settled[g] for g in goals if g in settled}


def deductions_of(codes: str) -> list[Deduction]:
    """How rows, one letter each, can be repaired.

    ``d`` must be deleted; else the letter is the role initial (``x``: none of s, u, a), a
    capital one for a truncated row.  Items are ``(rows done, state)`` and ``(row, -1)``.
    """
    out = []
    for i in range(len(codes) + 1):
        for (state, initial), after in NEXT.items():
            if initial in ROLES:
                out.append(Deduction(((i, state),), (i, after), COSTS[INSERT], INSERT))
            if i == len(codes) or codes[i] == "d":
                continue
            more = TRUNCATED if codes[i].isupper() else 0
            if codes[i].lower() == initial:
                out.append(Deduction(((i, state), (i, -1)), (i + 1, after), COSTS[KEEP] + more, KEEP))
            if initial in ROLES:
                out.append(Deduction(((i, state), (i, -1)), (i + 1, after), COSTS[REROLE] + more, REROLE))
        if i < len(codes):
            out.extend(Deduction(((i, state), (i, -1)), (i + 1, state), COSTS[DELETE], DELETE) for state in range(4))
    return out


def _axioms(codes: str, begin: dict[int, Value]) -> dict:
    return {(i, -1): (0, "") for i in range(len(codes))} | {(0, state): value for state, value in begin.items()}


def advance(codes: str, begin: dict[int, Value]) -> dict[int, Value]:
    """The values of all states after these rows, from those before them."""
    ends = {(len(codes), state) for state in range(4)}
    return {state: value for (_, state), value in lightest(_axioms(codes, begin), deductions_of(codes), ends).items()}


def finish(codes: str, begin: dict[int, Value]) -> Value:
    """The value of the goal: a legal conversation of all rows."""
    goal = (-1, 0)
    ends = [Deduction(((len(codes), state),), goal, 0, "") for state in LEGAL_ENDS]
    return lightest(_axioms(codes, begin), deductions_of(codes) + ends, {goal})[goal]


@lru_cache(maxsize=1 << 15)
def plan(codes: str) -> Value:
    """Cost and audit of a whole conversation of one block."""
    return finish(codes, {EMPTY: (0, "")})


class Plan:
    """The plan of one conversation, fed row by row."""

    def __init__(self):
        self.codes: list[str] = []
        self.begin: dict[int, Value] | None = None
        self.base = 0
        self.audit: list[str] = []

    def add(self, code: str) -> None:
        self.codes.append(code)
        if len(self.codes) == BLOCK:
            self.begin = advance("".join(self.codes), self.begin or {EMPTY: (0, "")})
            self.codes = []
            common = os.path.commonprefix([audit for _, audit in self.begin.values()])
            least = min(cost for cost, _ in self.begin.values())
            self.audit.append(common)
            self.base += least
            self.begin = {state: (cost - least, audit[len(common) :]) for state, (cost, audit) in self.begin.items()}

    def result(self) -> Value:
        codes = "".join(self.codes)
        cost, audit = plan(codes) if self.begin is None else finish(codes, self.begin)
        return self.base + cost, "".join(self.audit) + audit


# --- rows ------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """Plant faults by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties it, 2 takes its end marks, 3 repeats it, 4 makes it the user's.

    Returns ``conv_id, turn, role, text`` and ``gone``; dropped rows are still there, so that no conversation is lost.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


_ORDER = ("turn", "role", "head", "mark")


def _prepared(turns: DataFrame) -> DataFrame:
    """The rows under internal names, with what puts them in order."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), F.coalesce(gone, F.lit(False)).alias("gone"))
    return rows.withColumns({"head": F.substring("text", 1, 32), "mark": F.unhex(F.md5(F.col("text").cast("binary")))})


def _sorted(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv", *first, *_ORDER)))


def _first_places(slim: DataFrame) -> DataFrame:
    """The first place of every turn that is said again at a later place."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    found = slim.where("NOT gone").groupBy("conv", "role", "mark").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return found.where("last > first").select(*(F.col(c).alias(f"{c}_f") for c in ("conv", "role", "mark")), "first")


_PLAN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plans(turns: DataFrame) -> DataFrame:
    """One row a conversation: counts of gaps and faults, illegal neighbours, cost and audit of the lightest repair."""
    rows = _prepared(turns)
    body = F.rtrim("text", F.lit(_SPACES))
    ended = F.right(body, F.lit(1)).isin(".", "!", "?")
    slim = rows.select(
        "conv", "turn", "role", "head", "mark", "gone", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"), (~ended).alias("truncated")
    )
    firsts = _first_places(slim)
    same = [slim[c].eqNullSafe(firsts[f"{c}_f"]) for c in ("conv", "role", "mark")]
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    # a merge join at every size, so that growth is in proportion
    flagged = slim.join(firsts.hint("merge"), same[0] & same[1] & same[2], "left").withColumn("later", F.coalesce(place > F.col("first"), F.lit(False)))
    flagged = flagged.select("conv", *_ORDER, "gone", "initial", "blank", "truncated", "later")
    schema = StructType().add("conv_id", turns.schema["conv_id"].dataType)
    for name in _PLAN:
        schema = schema.add(name, LongType())
    schema = schema.add("audit", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tally, out, kind = None, None, [], None
        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if tally is None or conv != current:
                    if tally is not None:
                        out.append((current, *tally.result()))
                    current, tally = conv, _Tally()
                tally.add(*row)
            if len(out) >= 1000:
                yield _batch(out, kind, schema)
                out = []
        if tally is not None:
            out.append((current, *tally.result()))
            yield _batch(out, kind, schema)

    return _sorted(flagged).mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType, schema: StructType) -> pa.RecordBatch:
    types = [kind, *(pa.int64() if isinstance(f.dataType, LongType) else pa.int32() if isinstance(f.dataType, IntegerType) else pa.string() for f in schema[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)


class _Tally:
    """Counts of one conversation whose rows come in order, and its plan."""

    def __init__(self):
        self.low = self.high = self.turn = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None
        self.initial = None
        self.plan = Plan()

    def add(self, turn, role, head, mark, gone, initial, blank, truncated, later) -> None:
        if gone:
            return
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.distinct += 1
        if self.initial is not None and self.initial + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.initial = initial
        again = later or (turn, role, mark) == self.before
        self.before = (turn, role, mark)
        code = initial if initial in ("s", "u", "a") else "x"
        if blank:
            self.blank += 1
            code = "d"
        elif again:
            self.duplicate += 1
            code = "d"
        elif truncated:
            self.truncated += 1
            code = code.upper()
        self.plan.add(code)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.plan.result()


# --- repaired turns ------------------------------------------------------------------


class _Script:
    """An audit being carried out on rows that come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def _emit(self, edit: str, role: str | None, text: str) -> tuple[str, str, str]:
        initial = role[:1] if role is not None else "a" if self.state == USER else "u"
        self.state = NEXT[self.state, initial]
        return edit, role if role is not None else ROLES[initial], text

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            yield self._emit(INSERT, None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != DELETE:
            yield self._emit(letter, role if letter == KEEP else None, text)


def _with_plans(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Texts in order, each conversation led by its plan (``kind`` 0)."""
    texts = _prepared(turns).where("NOT gone").select("conv", F.lit(1).alias("kind"), *_ORDER, "text", *(F.lit(None).cast("bigint").alias(c) for c in _PLAN))
    head = found.select(
        F.col("conv_id").alias("conv"), F.lit(0).alias("kind"), *(F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in _ORDER), F.col("audit").alias("text"), *_PLAN
    )
    return _sorted(texts.unionByName(head), "kind")


def repaired(turns: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the turns of every repaired conversation, from place 0 on."""
    found = durable(plans(turns), "plans") if found is None else found
    schema = StructType().add("conv_id", turns.schema["conv_id"].dataType).add("place", IntegerType()).add("edit", StringType()).add("role", StringType()).add("text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script, conv, place = None, None, 0
        for batch in batches:
            kind, out = batch.schema.field("conv").type, []
            for c, k, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "role", "text"))):
                if k == 0:
                    made = list(script.inserted()) if script is not None else []
                else:
                    made = list(script.row(role, text))
                for turn in made:
                    out.append((conv, place, *turn))
                    place += 1
                if k == 0:
                    script, conv, place = _Script(text), c, 0
            if out:
                yield _batch(out, kind, schema)
        if script is not None:
            rest = [(conv, place + i, *turn) for i, turn in enumerate(script.inserted())]
            if rest:
                yield _batch(rest, kind, schema)

    return _with_plans(turns, found).mapInArrow(run, schema)


def reports(turns: DataFrame) -> DataFrame:
    """The plan of each conversation and the SHA-256 of its repaired ``role:text`` lines."""
    found = durable(plans(turns), "plans")
    schema = StructType().add("conv_id", turns.schema["conv_id"].dataType)
    for name in _PLAN:
        schema = schema.add(name, LongType())
    schema = schema.add("audit", StringType()).add("repaired_sha256", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script, lead, digest, out, kind = None, None, None, [], None

        def note(made) -> None:
            nonlocal first
            for _, role, text in made:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        first = True
        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, k, role, text, *numbers in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "role", "text", *_PLAN))):
                if k:
                    note(script.row(role, text))
                    continue
                if script is not None:
                    note(script.inserted())
                    out.append((*lead, digest.hexdigest()))
                script, lead, digest, first = _Script(text), (conv, *numbers, text), hashlib.sha256(), True
            if len(out) >= 1000:
                yield _batch(out, kind, schema)
                out = []
        if script is not None:
            note(script.inserted())
            out.append((*lead, digest.hexdigest()))
            yield _batch(out, kind, schema)

    return _with_plans(turns, found).mapInArrow(run, schema)
