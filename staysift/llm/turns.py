"""Conversation structure repair: turns aligned with every feasible length of an alternating grammar.

The roles of a conversation have to read ``(s?(ua)+)?``: system (optional), then user and assistant in
turn, ending with the assistant; or nothing. Edits are Keep (cost 0), Rerole to user or assistant (1), Delete
(2, and required for blank and repeated turns) and Insert of an empty user or assistant turn (5); a
truncated turn that stays adds 5. The cheapest edits are found by Wagner-Fischer alignment with the
grammar's strings, in a band that the cheapest script known so far leaves open (Ukkonen). Scripts
are written as audits, one initial an edit, and the least one in ASCII is taken among the cheapest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame, functions as F

from staysift.operators.ranking import numbered
from staysift.session import cut_and_measure, cut_lineage

INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
# Turns that are aligned at once; a longer conversation is cut into parts of so many turns.
PART = 512
# Names of the roles that edits can give, and what ends a turn that is whole.
USER, ASSISTANT = "user", "assistant"
NOT_BLANK = r"[^\x20\x09-\x0D]"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"

# Where a script stands in the grammar: at its start, after system, after user, after assistant.
START, SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
FIRST = {START: "u", SYSTEM: "u", AFTER_USER: "a", AFTER_ASSISTANT: "u"}
LAST = {AFTER_USER: "u", AFTER_ASSISTANT: "a"}
OTHER = {"u": "a", "a": "u"}
LEGAL = frozenset(("su", "ua", "au"))
FAR = 1 << 60

# A turn for the alignment is one character: its role's initial (s, u, a, or x for any other), as a
# capital if it is truncated, or D if it has to go.
GONE = "D"


def turn_kind(role: str, must_go: bool, truncated: bool) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return GONE if must_go else initial.upper() if truncated else initial


def _bound(kinds: str, start: int, end: int) -> int:
    """The cost of one script from ``start`` to ``end``: turns alternate, truncated ones go."""
    cost, want, emitted = 0, FIRST[start], ""
    for k in kinds:
        if k == "s" and start == START and not emitted:
            emitted = "s"
        elif k.islower():
            cost += REROLE * (k != want)
            emitted, want = want, OTHER[want]
        else:
            cost += DELETE
    lacking = 1 if want == LAST[end] else 0 if emitted in ("u", "a") else 2
    return cost + INSERT * lacking


def _suffix_costs(kinds: str, last: str, most: int) -> list[tuple[int, list[int]]]:
    """For every turn i the least costs of the turns from i on against the last r symbols.

    The symbols alternate and end with ``last``, so strings of all lengths share the table. A
    cell is left out if a script through it costs over ``most``: with m turns to go that may stay, r
    symbols need at least m - r deletions or r - m insertions. A row is (its least r, costs).
    """
    n = len(kinds)
    slack = most - DELETE * kinds.count(GONE)
    fewer, more = slack // DELETE, slack // INSERT
    symbol = (OTHER[last], last)
    stay = 0
    low, costs = 0, [INSERT * r for r in range(more + 1)]
    rows = [(low, costs)]
    for i in range(n - 1, -1, -1):
        kind = kinds[i]
        stay += kind != GONE
        own = kind.lower()
        extra = TRUNCATED if kind.isupper() else 0
        first = max(0, stay - fewer)
        ahead = low + len(costs)
        here, left = [], FAR
        for r in range(first, stay + more + 1):
            best = DELETE + costs[r - low] if low <= r < ahead else FAR
            best = min(best, left + INSERT)
            if kind != GONE and low < r <= ahead:
                best = min(best, costs[r - 1 - low] + extra + (own != symbol[r & 1]))
            here.append(best)
            left = best
        low, costs = first, here
        rows.append((low, costs))
    return rows[::-1]


def _trace(kinds: str, last: str, rows: list[tuple[int, list[int]]], i: int, r: int) -> str:
    """The least audit among the cheapest scripts of the turns from i on against the last r symbols."""

    def cost(i: int, r: int) -> int:
        low, costs = rows[i]
        return costs[r - low] if low <= r < low + len(costs) else FAR

    symbol = (OTHER[last], last)
    audit = []
    while i < len(kinds):
        now = cost(i, r)
        if now == DELETE + cost(i + 1, r):
            audit.append("D")
            i += 1
        elif r and now == INSERT + cost(i, r - 1):
            audit.append("I")
            r -= 1
        else:
            audit.append("K" if kinds[i].lower() == symbol[r & 1] else "R")
            i, r = i + 1, r - 1
    return "".join(audit) + "I" * r


def align(kinds: str, start: int = START, end: int | None = None) -> tuple[int, str] | None:
    """Cost and audit of the cheapest script that leads from ``start`` to ``end``, None if none does.

    Without ``end`` the script has to end a conversation: with nothing, or after the assistant.
    Every length of the grammar's string that the incumbent cost leaves possible is looked up, the incumbent
    falls with each cheaper one, and the audits of the cheapest are compared.
    """
    n = len(kinds)
    if end is None:
        found = [align(kinds, start, start if start == START else AFTER_ASSISTANT)]
        found.append(align(kinds, start, AFTER_ASSISTANT))
        return min(f for f in found if f)
    nothing = [(DELETE * n, "D" * n)] if start == end else []
    if end == SYSTEM and start == START:  # one system turn stays, the last of the cheapest
        stays = [(DELETE * (n - 1) + (TRUNCATED if kinds[k] == "S" else 0), "D" * k + "K" + "D" * (n - 1 - k))
                 for k in range(n) if kinds[k] in "sS"]
        return min(stays, default=None)
    if end not in LAST:
        return nothing[0] if nothing else None
    last = LAST[end]
    incumbent = min([_bound(kinds, start, end), *[c for c, _ in nothing]])
    rows = _suffix_costs(kinds, last, incumbent)
    odd = FIRST[start] == last
    ways = []  # cost, turns deleted or kept as system before the alignment, symbols
    for k in [-1, *[k for k in range(n) if start == START and kinds[k] in "sS"]]:
        before = 0 if k < 0 else DELETE * k + (TRUNCATED if kinds[k] == "S" else 0)
        if DELETE * k > incumbent:
            break
        low, costs = rows[k + 1]
        for r in range(low, low + len(costs)):
            if r > 0 and r % 2 == odd and before + costs[r - low] <= incumbent:
                incumbent = before + costs[r - low]
                ways.append((incumbent, k, r))
    best = [(c, ("D" * k + "K" if k >= 0 else "") + _trace(kinds, last, rows, k + 1, r))
            for c, k, r in ways if c == incumbent]
    return min([*best, *[f for f in nothing if f[0] == incumbent]])


@lru_cache(maxsize=1 << 15)
def _align_short(kinds: str) -> tuple[int, str]:
    return align(kinds)


def _apply(turns: list[tuple[str, str]], audit: str, start: int = START) -> list[dict]:
    """The repaired turns that an audit makes of the given ones (role, text)."""
    out, want, rest = [], FIRST[start], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K" and start == START and not out and role[:1] == "s":
            out.append({"role": role, "text": text})
            continue
        if edit != "K":
            role = USER if want == "u" else ASSISTANT
        out.append({"role": role, "text": text})
        want = OTHER[want]
    return out


def _look(rows: list[tuple], seen: set | None) -> dict:
    """Faults and kinds of ordered turns (turn, role, text, blank, truncated, repeated).

    With ``seen``, repeated turns are found here.
    """
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns_known": 0}
    kinds, turns, before = [], [], None
    low = high = None
    for turn, role, text, blank, cut, repeated in rows:
        if seen is not None:
            repeated = (role, text) in seen
            seen.add((role, text))
        out["blank"] += blank
        out["duplicate"] += repeated and not blank
        out["truncated"] += cut and not blank and not repeated
        out["illegal"] += before is not None and before + role[:1] not in LEGAL
        before = role[:1]
        if turn is not None:
            low = turn if low is None else low
            out["turns_known"] += turn != high
            high = turn
        kinds.append(turn_kind(role, blank or repeated, cut))
        turns.append((role, text))
    first = rows[0][1][:1] if rows else None
    return out | {"low": low, "high": high, "first": first, "last": before, "kinds": "".join(kinds), "turns": turns}


FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
TOTALS = ", ".join([*[f"{c} long" for c in FAULTS], "cost long"])
TURNS = "array<struct<role: string, text: string>>"


def _batches(rows: Iterator[dict], schema, most: int = 1 << 22) -> Iterator:
    """Arrow batches of rows, each of about ``most`` characters at most or one row."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(t["text"]) for t in row.get("turns") or ()) + len(row.get("audit") or "")
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _grouped(batches: Iterable, keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows with the same first ``keys`` columns, from sorted Arrow batches."""

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # texts become strings in slices
                part = batch.slice(at, 512)
                yield from zip(*[c.to_pylist() for c in part.columns])

    for key, group in groupby(rows(), lambda r: r[:keys]):
        yield key, (r[keys:] for r in group)


def _arrow_schema(df: DataFrame, key: str, rest: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    kept = StructType([StructField("conv", df.schema[key].dataType)])
    schema = StructType([*kept.fields, *StructType.fromDDL(rest).fields])
    return schema, to_arrow_schema(schema)


def marked_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, turn, role, text, blank, truncated`` of every row; a null role or text is empty."""
    rows = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return rows.select("*", (~F.col("text").rlike(NOT_BLANK)).alias("blank"), (~F.col("text").rlike(WHOLE)).alias("truncated"))


def repair(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    part: int = PART,
) -> DataFrame:
    """The cheapest repair of every conversation, as parts of at most ``part`` turns.

    Columns: conv; part (from 0) and n_parts; the totals of the conversation: gaps (numbers missing between its
    least and greatest turn), blank, duplicate, truncated (each row's first fault), illegal (neighbours that
    the grammar does not allow), cost; and of this part: audit and turns (role, text), in order.

    Rows go by turn (null first), then role, then text. Rows with a null conversation make up one
    conversation, null roles and texts count as empty, repeated rows are duplicates, other columns are not read
    and may have any name. An empty table gives an empty one.

    A conversation of up to ``part`` rows meets in one task. A longer one is numbered over ranges and cut;
    each part is aligned on its own, once for each pair of places in the grammar where it can begin and
    end, and only costs and audits of the parts (a byte a turn) meet to choose the pairs.
    """
    rows = marked_turns(df, conv, turn, role, text)
    counts = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part)
    long, seen = cut_and_measure(counts.select("conv"))
    if not seen["rows"]:
        return _repair_short(rows)
    same = F.col("conv").eqNullSafe(F.col("_long"))
    long = long.select(F.col("conv").alias("_long"))
    few = F.broadcast(long) if seen["rows"] <= 100_000 else long
    shorter = rows.join(few, same, "left_anti")
    return _repair_short(shorter).unionByName(_repair_long(rows.join(few, same, "left_semi"), part))


def _repair_short(rows: DataFrame) -> DataFrame:
    schema, arrow = _arrow_schema(rows, "conv", f"part int, n_parts int, {TOTALS}, audit string, turns {TURNS}")

    def repaired(batches):
        for (key,), group in _grouped(batches, 1):
            found = _look([(*r, False) for r in group], set())
            cost, audit = _align_short(found["kinds"])
            gaps = 0 if found["low"] is None else found["high"] - found["low"] + 1 - found["turns_known"]
            yield {"conv": key, "part": 0, "n_parts": 1, "gaps": gaps, "cost": cost, "audit": audit,
                   **{c: found[c] for c in FAULTS[1:]}, "turns": _apply(found["turns"], audit)}

    placed = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return placed.mapInArrow(lambda batches: _batches(repaired(batches), arrow), schema)


CELL = "array<struct<start: int, end: int, cost: long, audit: string>>"
PART_STATE = f"part int, blank long, duplicate long, truncated long, illegal long, turns_known long, low long, high long, first string, last string, cells {CELL}"


def _repair_long(rows: DataFrame, part: int) -> DataFrame:
    ordered = [F.asc("turn"), F.asc("role"), F.asc("text"), F.asc("_id")]
    every = numbered(rows.withColumn("_id", F.monotonically_increasing_id()), "conv", ordered, "_number")
    every = cut_lineage(every.drop("_id"))
    firsts = every.groupBy("conv", "role", F.sha2("text", 256).alias("_text")).agg(F.min("_number").alias("_first"))
    firsts = firsts.select(F.col("conv").alias("_of"), "_first")
    is_first = F.col("conv").eqNullSafe(F.col("_of")) & (F.col("_number") == F.col("_first"))
    parts = every.join(firsts, is_first, "left").select(
        "conv",
        F.floor((F.col("_number") - 1) / part).cast("int").alias("part"),
        "_number", "turn", "role", "text", "blank", "truncated",
        F.col("_first").isNull().alias("repeated"),
    )
    parts = cut_lineage(parts.repartition("conv", "part").sortWithinPartitions("conv", "part", "_number"))
    states_schema, states_arrow = _arrow_schema(rows, "conv", PART_STATE)
    names = [f.name for f in states_schema.fields]

    def states(batches):
        for (key, number), group in _grouped(batches, 2):
            found = _look([r[1:] for r in group], None)
            cells = []
            for start in range(4):
                for end in range(4):
                    if number == 0 and start != START:
                        continue
                    way = align(found["kinds"], start, end)
                    if way:
                        cells.append({"start": start, "end": end, "cost": way[0], "audit": way[1]})
            row = {"conv": key, "part": number, **found, "cells": cells}
            yield {k: row[k] for k in names}

    # A part may come in two pieces if the rows were written in several files: they are placed once more.
    again = parts.repartition("conv", "part").sortWithinPartitions("conv", "part", "_number")
    found = cut_lineage(again.mapInArrow(lambda b: _batches(states(b), states_arrow), states_schema))
    choice_schema, choice_arrow = _arrow_schema(rows, "conv", f"part int, n_parts int, {TOTALS}, audit string, start int")

    def chosen(batches):
        for (key,), group in _grouped(batches, 1):
            yield from _choose(key, group)

    by_part = found.repartition("conv").sortWithinPartitions("conv", "part")
    choice = by_part.mapInArrow(lambda b: _batches(chosen(b), choice_arrow), choice_schema)
    told = [c for c in choice_schema.names if c not in ("conv", "part")]
    choice = cut_lineage(choice).select(
        F.col("conv").alias("_of"), F.col("part").alias("_part"), F.struct(*told).alias("_told")
    )
    out_schema, out_arrow = _arrow_schema(rows, "conv", f"part int, n_parts int, {TOTALS}, audit string, turns {TURNS}")

    def applied(batches):
        for (key, number), group in _grouped(batches, 2):
            group = list(group)
            row = dict(zip(told, group[0][3:]))
            turns = _apply([r[1:3] for r in group], row["audit"], row.pop("start"))
            yield {"conv": key, "part": number, **row, "turns": turns}

    of = F.col("conv").eqNullSafe(F.col("_of")) & (F.col("part") == F.col("_part"))
    both = parts.join(choice, of).select("conv", "part", "_number", "role", "text", "_told.*")
    both = both.repartition("conv", "part").sortWithinPartitions("conv", "part", "_number")
    return both.mapInArrow(lambda b: _batches(applied(b), out_arrow), out_schema)


def _choose(key, parts: Iterator[tuple]) -> Iterator[dict]:
    """The cheapest way through the parts of one conversation, least audit first, and its totals."""
    ways = {START: (0, "", ())}  # cost, audit, the places where the parts begin
    totals = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns_known"), 0)
    low = high = last = None
    sizes = []
    for _, blank, duplicate, truncated, illegal, known, own_low, own_high, first, own_last, cells in parts:
        totals["illegal"] += last is not None and last + first not in LEGAL
        totals["turns_known"] -= own_low is not None and own_low == high
        for name, n in zip(totals, (blank, duplicate, truncated, illegal, known)):
            totals[name] += n
        low = own_low if low is None else low
        high = high if own_high is None else own_high
        last = own_last
        onward = {}
        for c in cells:
            if c["start"] in ways:
                cost, audit, steps = ways[c["start"]]
                way = (cost + c["cost"], audit + c["audit"], (steps, c["start"], len(c["audit"])))
                if c["end"] not in onward or way[:2] < onward[c["end"]][:2]:
                    onward[c["end"]] = way
        ways = onward
        sizes.append(None)
    cost, audit, steps = min((ways[e] for e in (START, AFTER_ASSISTANT) if e in ways), key=lambda w: w[:2])
    known = totals.pop("turns_known")
    totals |= {"gaps": 0 if low is None else high - low + 1 - known, "cost": cost}
    at, rows = len(audit), []
    for number in range(len(sizes) - 1, -1, -1):
        steps, start, length = steps
        rows.append({"conv": key, "part": number, "n_parts": len(sizes), **totals,
                     "audit": audit[at - length : at], "start": start})
        at -= length
    yield from rows


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: conv, its totals, the whole audit, and ``repaired_sha256``.

    The digest is of the repaired turns as ``role:text``, joined by line ends. That of a conversation of several
    parts is computed in one task, part by part, since a digest has no pieces; no more than a part is held.
    """
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    totals = [*FAULTS, "cost"]
    one = repaired.where("n_parts = 1").select("conv", *totals, "audit", F.sha2(line, 256).alias("repaired_sha256"))
    schema, arrow = _arrow_schema(repaired, "conv", f"{TOTALS}, audit string, repaired_sha256 string")

    def joined(batches):
        import hashlib

        for (key,), group in _grouped(batches, 1):
            digest, audits, first = hashlib.sha256(), [], True
            for _, *sums, audit, some, body in group:
                if some:
                    digest.update(("" if first else "\n").encode() + body.encode())
                    first = False
                audits.append(audit)
            yield {"conv": key, **dict(zip(totals, sums)), "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

    several = repaired.where("n_parts > 1").select(
        "conv", "part", *totals, "audit", (F.size("turns") > 0).alias("some"), line.alias("body")
    )
    several = several.repartition("conv").sortWithinPartitions("conv", "part")
    return one.unionByName(several.mapInArrow(lambda b: _batches(joined(b), arrow), schema))
