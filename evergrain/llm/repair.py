"""Repair of conversation structure: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`.

A conversation is a path through nodes (rows passed, state of the role pattern). Forward and backward minimum costs tell which
arcs lie on a cheapest path (tight arcs: cost so far + arc + cost to go = total); a set of nodes walks along them and takes the
least edit letter (D, I, K, R) at each step.

Conversations may be of any length: the rows are dealt to ranges of (conversation, turn), and a range's part of a conversation
is a piece. Each piece gives its costs from every state to every state, a conversation's pieces (no more than ranges) give the
costs at their bounds, and each piece is then walked for itself from each state that a cheapest path may enter it in.

Nulls and ties: rows go by turn (null first), then role, then text; a null role or text is one space; rows without a
conversation id are one conversation. A row is a duplicate where an earlier one has its role and text. Empty texts are blank.
An empty table gives no rows; columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, written

INK = r"[^\x20\x09-\x0D]"
#: States of the pattern: nothing yet, after s, after u, after a; and what a turn of user or assistant makes of each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ACCEPTED = (NOTHING, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Letter of a row that has to go; other rows are their role's initial (o: another one), a capital where truncated.
GONE = "x"
FAR = 1 << 40
#: Rows of a piece up to which workers keep what they have worked out: short conversations look alike.
SHORT = 16


def damage(turns: DataFrame) -> DataFrame:
    """The turns after the damage that CRC-32 of `conv_id:turn` modulo 20 chooses: 0 drops a row, 1 empties its text, 2 removes
    its `[.!?]`, 3 repeats it, 4 makes it the user's. A null is one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text, role = F.crc32(key) % 20, F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = turns.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("__times"))
    return rows.withColumn("__times", F.explode(F.array_repeat(F.lit(0), F.col("__times")))).drop("__times")


def _arcs(code: str) -> list[tuple[int, str, int, int]]:
    """Arcs (from, letter, to, cost) over a row."""
    out = [(s, "D", s, DELETE) for s in STATES]
    if code != GONE:
        extra = TRUNCATED if code.isupper() else 0
        out += [(s, "K", t, extra) for s, t in KEEP.get(code.lower(), {}).items()]
        out += [(s, "R", NEXT[s], REROLE + extra) for s in STATES]
    return out


ARCS = {c: _arcs(c) for c in GONE + "suaoSUAO"}
INSERTS = [(s, "I", NEXT[s], INSERT) for s in STATES]


def _inserted(costs: list[int] | tuple[int, ...]) -> list[int]:
    """Costs of the states of a column after insertions in it."""
    for _ in STATES:
        costs = [min([costs[s], *[costs[a] + w for a, _, b, w in INSERTS if b == s]]) for s in STATES]
    return costs


def forward(codes: str, start: list[int] | tuple[int, ...], last: bool) -> list[list[int]]:
    """Least costs from the start to every state of every column; the last column takes insertions only at a conversation's end."""
    columns = [_inserted(start) if codes or last else start]
    for i, code in enumerate(codes):
        costs = [FAR] * 4
        for a, _, b, w in ARCS[code]:
            costs[b] = min(costs[b], columns[-1][a] + w)
        columns.append(_inserted(costs) if last or i + 1 < len(codes) else costs)
    return columns


def backward(codes: str, end: list[int] | tuple[int, ...], last: bool) -> list[list[int]]:
    """Least costs to the end from every state of every column."""

    def before(costs: list[int]) -> list[int]:
        for _ in STATES:
            costs = [min([costs[s], *[costs[b] + w for a, _, b, w in INSERTS if a == s]]) for s in STATES]
        return costs

    columns = [before(end) if last else end]
    for code in reversed(codes):
        costs = [FAR] * 4
        for a, _, b, w in ARCS[code]:
            costs[a] = min(costs[a], columns[-1][b] + w)
        columns.append(before(costs))
    return columns[::-1]


def transfer(codes: str, last: bool) -> list[int]:
    """Least costs from every state before the rows (by rows) to every state after them."""
    return [c for s in STATES for c in forward(codes, [0 if s == t else FAR for t in STATES], last)[-1]]


def walk(codes: str, start: int, before: tuple[int, ...], after: tuple[int, ...], total: int, last: bool) -> tuple[str, int] | None:
    """The least letters along tight arcs from a state before the rows to the state after them; None where no cheapest path enters there."""
    fore, back = forward(codes, before, last), backward(codes, after, last)
    if before[start] + back[0][start] != total:
        return None
    frontier, letters, n = {(0, start)}, [], len(codes)
    while True:
        if not last and all(i == n for i, _ in frontier):
            break
        if last and any(i == n and after[s] == 0 and fore[i][s] == total for i, s in frontier):
            break
        options: dict[str, set[tuple[int, int]]] = {}
        for i, s in frontier:
            arcs = [(letter, i, b, w) for a, letter, b, w in INSERTS if a == s and (i < n or last)]
            arcs += [(letter, i + 1, b, w) for a, letter, b, w in ARCS[codes[i]] if a == s] if i < n else []
            for letter, j, b, w in arcs:
                if fore[i][s] + w + back[j][b] == total:
                    options.setdefault(letter, set()).add((j, b))
        letters.append(least := min(options))
        frontier = options[least]
    # the letters fix the states: an inserted or changed turn is the only one the pattern takes there
    (state,) = {s for _, s in frontier}
    return "".join(letters), state


_kept_transfer, _kept_walk = lru_cache(1 << 15)(transfer), lru_cache(1 << 15)(walk)


def edits(codes: str, start: int, letters: str) -> list[tuple[list[str], str, str | None, list[str]]]:
    """For each row: roles inserted before it, its letter, its new role if it gets one, and (at the last row) roles inserted after."""
    out, state, waiting, rows = [], start, [], iter(codes)
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            waiting.append(NAMES[state])
            continue
        code, new = next(rows), None
        if letter == "K":
            state = KEEP[code.lower()][state]
        elif letter == "R":
            state = NEXT[state]
            new = NAMES[state]
        out.append((waiting, letter, new, []))
        waiting = []
    if waiting:
        out[-1][3].extend(waiting)
    return out


def _legal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def _costs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({
            "ckey": f["ckey"], "piece": f["piece"], "costs": [(_kept_transfer if len(c) <= SHORT else transfer)(c, False) for c in f["codes"]],
            "broken": [_legal(s) for s in f["initials"]], "first": f["initials"].str[0], "last": f["initials"].str[-1],
        })


def _bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs before and after each piece of a conversation, its total, and its illegal neighbours."""
    for f in frames:
        out = []
        for ckey, pieces in zip(f["ckey"], f["pieces"]):
            before = [[0 if s == NOTHING else FAR for s in STATES]]
            for p in pieces:
                before.append([min(before[-1][s] + int(p["costs"][4 * s + t]) for s in STATES) for t in STATES])
            end = [0 if s in ACCEPTED else FAR for s in STATES]
            tail = backward("", end, True)[0]
            after = [tail]
            for p in reversed(pieces):
                after.append([min(int(p["costs"][4 * s + t]) + after[-1][t] for t in STATES) for s in STATES])
            after = after[::-1]
            illegal = sum(int(p["broken"]) for p in pieces) + sum(_legal(a["last"] + b["first"]) for a, b in zip(pieces, pieces[1:]))
            for k, p in enumerate(pieces):
                is_last = k + 1 == len(pieces)
                out.append((ckey, int(p["piece"]), before[k], end if is_last else after[k + 1], after[0][NOTHING], is_last, illegal))
        yield pd.DataFrame(out, columns=["ckey", "piece", "before", "after", "total", "ends", "illegal"])


def _walks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r in f.itertuples():
            before, after = tuple(int(c) for c in r.before), tuple(int(c) for c in r.after)
            for start in STATES:
                found = (_kept_walk if len(r.codes) <= SHORT else walk)(r.codes, start, before, after, int(r.total), bool(r.ends)) if before[start] < FAR else None
                if found:
                    out.append((r.ckey, r.piece, start, found[1], found[0]))
        yield pd.DataFrame(out, columns=["ckey", "piece", "start", "end", "letters"])


def _row_edits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = [(at, *e) for r in f.itertuples() for at, e in zip(r.ats, edits(r.codes, r.start, r.letters))]
        yield pd.DataFrame(out, columns=["at", "before", "letter", "new_role", "after"])


def _chosen(walks: DataFrame) -> DataFrame:
    """Of the walks of a conversation's pieces those that continue each other from the first piece, chained by native aggregation."""
    steps = F.array_sort(F.collect_list(F.struct("piece", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))))
    paths = walks.groupBy("ckey").agg(steps.alias("steps"))
    taken = F.aggregate(
        "steps",
        F.struct(F.lit(NOTHING).alias("state"), F.lit(-1).cast("long").alias("piece"), F.array().cast("array<struct<piece:bigint,start:int>>").alias("taken")),
        lambda acc, s: F.when(
            (s["piece"] > acc["piece"]) & (s["start"] == acc["state"]),
            F.struct(s["end"].alias("state"), s["piece"].alias("piece"), F.concat(acc["taken"], F.array(F.struct(s["piece"].alias("piece"), s["start"].alias("start")))).alias("taken")),
        ).otherwise(acc),
    )
    picks = paths.select("ckey", F.explode(taken["taken"]).alias("t")).select("ckey", "t.piece", "t.start")
    return walks.join(picks, ["ckey", "piece", "start"])


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables. Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Edited rows: conv_id, at (their
    order), role and text (of the row), before and after (roles inserted around it), letter, new_role (null where it keeps its own).
    """
    ckey = F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit(""))
    space = F.lit(" ")
    rows = turns.select("conv_id", ckey.alias("ckey"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    order = ["ckey", "turn", "role", "text"]
    dealt = rows.repartitionByRange(shuffle_width(turns.sparkSession), *order).sortWithinPartitions(*order)
    pieces = written(dealt.select("*", F.spark_partition_id().cast("long").alias("piece"), F.monotonically_increasing_id().alias("at")), "repair-rows", compression="zstd")

    blank = ~F.col("text").rlike(INK)
    whole = F.regexp_extract("text", rf"({INK})[\x20\x09-\x0D]*\z", 1).rlike("^[.!?]$")
    firsts = pieces.where(~blank).groupBy("ckey", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    narrow = pieces.select("conv_id", "ckey", "turn", "piece", "at", initial.alias("initial"), blank.alias("blank"), (~whole).alias("cut")).join(firsts, "at", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    narrow = narrow.withColumn("fault", fault).withColumn("code", code)
    narrow = written(narrow.select("conv_id", "ckey", "turn", "piece", "at", "initial", "fault", "code"), "repair-faults", compression="zstd")

    in_order = F.array_sort(F.collect_list(F.struct("at", "initial", "code")))
    coded = narrow.groupBy("ckey", "piece").agg(in_order.alias("r"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform("r", lambda x: x[name]), "").alias(name + "s")

    coded = written(coded.select("ckey", "piece", F.transform("r", lambda x: x["at"]).alias("ats"), joined("initial"), joined("code")), "repair-pieces", compression="zstd")
    costs = coded.select("ckey", "piece", "initials", "codes").mapInPandas(_costs, "ckey string, piece long, costs array<long>, broken long, first string, last string")
    listed = costs.groupBy("ckey").agg(F.array_sort(F.collect_list(F.struct("piece", "costs", "broken", "first", "last"))).alias("pieces"))
    bounds = listed.mapInPandas(_bounds, "ckey string, piece long, before array<long>, after array<long>, total long, ends boolean, illegal long")
    bounds = written(bounds, "repair-bounds")
    walks = coded.select("ckey", "piece", "codes").join(bounds.drop("illegal"), ["ckey", "piece"]).mapInPandas(_walks, "ckey string, piece long, start long, end long, letters string")
    chosen = written(_chosen(written(walks, "repair-walks")), "repair-chosen")

    def count(which: str) -> Column:
        return F.count_if(F.col("fault") == which).alias(which)

    audits = chosen.groupBy("ckey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    by_turn = narrow.groupBy("ckey", "turn").agg(F.first("conv_id").alias("conv_id"), count("blank"), count("duplicate"), count("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = by_turn.groupBy("ckey").agg(F.first("conv_id").alias("conv_id"), gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    totals = bounds.where("ends").select("ckey", "illegal", F.col("total").alias("cost"))
    found = counts.join(totals, "ckey").join(audits, "ckey").drop("ckey")

    coded = coded.select("ckey", "piece", "ats", "codes").join(chosen.drop("end"), ["ckey", "piece"])
    by_row = coded.mapInPandas(_row_edits, "at long, before array<string>, letter string, new_role string, after array<string>")
    return found, pieces.select("conv_id", "at", "role", "text").join(by_row, "at")


def lines(edited: DataFrame) -> DataFrame:
    """conv_id, at and the repaired turns (role, text) that stand at each edited row, in order."""

    def added(roles: str) -> Column:
        return F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))

    own = F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))
    own = F.when(F.col("letter") != "D", own).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return edited.select("conv_id", "at", F.concat(added("before"), own, added("after")).alias("turns"))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0 within a row's place), role and text, ordered by at and turn."""
    return lines(repair(turns)[1]).select("conv_id", "at", F.posexplode("turns").alias("k", "t")).select("conv_id", "at", "k", "t.role", "t.text")


def digests(edited: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: SHA-256 of the repaired `role:text`, joined by line feeds.

    A digest goes through its conversation in order: the rows of a conversation come sorted to one task, which keeps the running
    hash and no rows.
    """
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    rows = lines(edited).where(F.size("turns") > 0).select(F.col("conv_id").cast("string").alias("key"), "at", F.array_join(line, "\n").alias("line"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hashed, started = None, None, False
        for f in frames:
            out = []
            for k, text in zip(f["key"], f["line"]):
                k = None if k is None or k != k else k
                if started and k == key:
                    hashed.update(b"\n")
                else:
                    if started:
                        out.append((key, hashed.hexdigest()))
                    key, hashed, started = k, hashlib.sha256(), True
                hashed.update(text.encode())
            yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
        if started:
            yield pd.DataFrame([(key, hashed.hexdigest())], columns=["key", "repaired_sha256"])

    width = shuffle_width(edited.sparkSession)
    return rows.repartition(width, "key").sortWithinPartitions("key", "at").mapInPandas(run, "key string, repaired_sha256 string")
