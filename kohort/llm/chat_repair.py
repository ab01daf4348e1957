"""Repair of a conversation's structure as a lightest derivation.

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``: an optional system turn, then pairs of user and
assistant. Turns are edited at a cost: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant turn
3; a truncated turn that is not deleted costs 3 more, blank and duplicate turns must be deleted.

Items are (turns consumed, state of the pattern); an edit derives one item from another, and of two spans that meet in a
state a longer one follows. The agenda (Knuth's generalisation of Dijkstra's algorithm) pops items by (cost, turns consumed,
audit), where the audit is the string of the edits' initials. Every rule is superior in that order (it adds cost or consumes a
turn), so an item is final when it is popped, with the least cost and of these the least audit in ASCII order; the search ends
when the goal item is popped.

Rows are ranged over the partitions by (conversation, turn, ...), so that a conversation of any length is spread; at most
1 << ``SPAN_BITS`` rows that follow each other there are searched together. A span that may go on in the next one is searched from
every state to every state, and the chains of spans are searched by the same agenda, whose rules then join two spans. One
string per conversation (the audit) and one running hash of its text go through one task, as a stream: both are sequential by
definition. Everything else is split by place.

Turns are taken by number, nulls first; turns of one number by role, then by a hash of their text. A null role or text is one
space. A role that starts with none of s, u, a cannot stay as it is. Null conversation ids are one conversation; repeated
rows are turns of their own (and duplicates); empty tables give empty ones; other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kohort.session import stage_table

SPAN_BITS = 10
CHAIN = 64
REROLE, DELETE, INSERT, LATE = 3, 4, 3, 3
#: States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
STATES = (0, 1, 2, 3)
ACCEPTED = (0, 3)
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after the one turn that may be put in: a user turn, or an assistant turn after a user turn.
_PUT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
LEGAL = ("su", "ua", "au")
SOUND, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
WHITE = " \t\n\x0b\x0c\r"


def lightest(turns: list[tuple[str, int]], start: int, goals: Iterable[int]) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the lightest derivation from ``start`` to each of the ``goals`` after all turns (initial, fault)."""
    n, wanted = len(turns), set(goals)
    agenda: list[tuple[int, int, str, int]] = [(0, 0, "", start)]
    final: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while agenda and len(found) < len(wanted):
        cost, i, audit, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        put = _PUT[state]
        heapq.heappush(agenda, (cost + INSERT, i, audit + "I", put))
        if i == n:
            if state in wanted:
                found[state] = cost, audit
            continue
        initial, fault = turns[i]
        heapq.heappush(agenda, (cost + DELETE, i + 1, audit + "D", state))
        if fault in (SOUND, TRUNCATED):
            late = LATE if fault == TRUNCATED else 0
            kept = _STEP.get((state, initial))
            if kept is not None:
                heapq.heappush(agenda, (cost + late, i + 1, audit + "K", kept))
            heapq.heappush(agenda, (cost + REROLE + late, i + 1, audit + "R", put))
    return found


def lightest_whole(turns: list[tuple[str, int]]) -> tuple[int, str, int]:
    """(cost, audit, last state) of a whole conversation: the least of what its accepted states give."""
    found = lightest(turns, 0, ACCEPTED)
    return min((*found[s], s) for s in ACCEPTED if s in found)


def join_spans(spans: list[dict[tuple[int, int], tuple[int, str]]], starts: dict[int, tuple[int, str, tuple]]) -> dict[int, tuple[int, str, tuple]]:
    """Carry ``starts`` (state: cost, audit, states so far) over spans (from, to: cost, audit) that follow each other."""
    n = len(spans)
    agenda = [(cost, 0, audit, s, path) for s, (cost, audit, path) in starts.items()]
    heapq.heapify(agenda)
    final: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str, tuple]] = {}
    while agenda:
        cost, k, audit, state, path = heapq.heappop(agenda)
        if (k, state) in final:
            continue
        final.add((k, state))
        if k == n:
            ends[state] = cost, audit, path
            continue
        for (a, b), (more, edits) in spans[k].items():
            if a == state:
                heapq.heappush(agenda, (cost + more, k + 1, audit + edits, b, (path, b)))
    return ends


def edited(turns: list[tuple[str, str]], audit: str, state: int) -> list[tuple[int, str, str | None, str | None]]:
    """(turn it belongs to, edit, role, text) of every edit; turns are (role, text), deleted ones have no role and text."""
    out: list[tuple[int, str, str | None, str | None]] = []
    at = 0
    for edit in audit:
        if edit == "I":
            state = _PUT[state]
            out.append((min(at, len(turns) - 1), edit, ROLE[state], ""))
            continue
        role, text = turns[at]
        if edit == "R":
            state = _PUT[state]
            role = ROLE[state]
        elif edit == "K":
            state = _STEP[state, role[:1]]
        out.append((at, edit, None, None) if edit == "D" else (at, edit, role, text))
        at += 1
    return out


def _spans(rows: Iterator[tuple], first: bool, last: bool) -> dict:
    """What a span's turns (initial, fault) of one conversation give; ``first`` and ``last``: it may have begun before, go on after."""
    turns = list(rows)
    items: dict[tuple[int, int], tuple[int, str]] = {}
    if not first and not last:
        cost, audit, end = lightest_whole(turns)
        items[0, end] = cost, audit
    else:
        for a in STATES if first else (0,):
            items |= {(a, b): got for b, got in lightest(turns, a, STATES if last else ACCEPTED).items()}
    initials = [i for i, _ in turns]
    faults = [f for _, f in turns]
    return {
        "items": [{"a": a, "b": b, "cost": c, "audit": t} for (a, b), (c, t) in items.items()],
        "head": initials[0],
        "tail": initials[-1],
        "illegal": sum(x + y not in LEGAL for x, y in pairwise(initials)),
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(TRUNCATED),
    }


_ITEMS = "items array<struct<a:int,b:int,cost:bigint,audit:string>>, head string, tail string, illegal bigint, blank bigint, duplicate bigint, truncated bigint"
_ITEM_TYPES = pa.struct([("items", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))), ("head", pa.string()), ("tail", pa.string()), *[(c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated")]])


def _runs(conv: list) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = [0, *[i for i in range(1, len(conv)) if conv[i] != conv[i - 1]], len(conv)]
    return [(a, b) for a, b in pairwise(cuts) if b > a]


def _search(part: pa.Table) -> pa.Table:
    part = part.sort_by("place")
    conv, initial, fault = (part.column(c).to_pylist() for c in ("conv", "initial", "fault"))
    runs = _runs(conv)
    got = [_spans(zip(initial[a:b], fault[a:b], strict=True), a == 0, b == len(conv)) for a, b in runs]
    fields = pa.array(got, _ITEM_TYPES).flatten()
    span = [part.column("span")[0].as_py()] * len(runs)
    return pa.Table.from_arrays([pa.array([conv[a] for a, _ in runs], part.column("conv").type), pa.array(span, pa.int64()), *fields], names=["conv", "span", *[f.name for f in _ITEM_TYPES]])


_PLAN = "conv bigint, span bigint, state int, cost bigint, audit string, illegal bigint, blank bigint, duplicate bigint, truncated bigint"


def _chain(batches):
    """Rows sorted by conversation and span: the path through each conversation's spans, with the illegal pairs at their borders."""
    held: list[dict] = []
    rows: list[dict] = []
    ends: dict[int, tuple[int, str, tuple]] = {0: (0, "", ())}

    def carry() -> None:
        nonlocal ends
        ends = join_spans([{(i["a"], i["b"]): (i["cost"], i["audit"]) for i in r["items"]} for r in held], ends)
        for r in held:
            border = 0 if not rows else int(rows[-1]["tail"] + r["head"] not in LEGAL)
            r["illegal"] += border
            # audits stay in the table; what is kept of a span is small
            rows.append(r | {"items": {(i["a"], i["b"]): (i["cost"], len(i["audit"])) for i in r["items"]}})
        held.clear()

    def finish() -> pa.RecordBatch:
        nonlocal ends
        carry()
        _, audit, path = min(ends[s] for s in ACCEPTED if s in ends)
        states = []
        while path:
            path, s = path
            states.append(s)
        states = [0, *states[::-1]]
        out, at = [], 0
        for r, (a, b) in zip(rows, pairwise(states), strict=True):
            cost, size = r["items"][a, b]
            out.append({"conv": r["conv"], "span": r["span"], "state": a, "cost": cost, "audit": audit[at : at + size], **{c: r[c] for c in ("illegal", "blank", "duplicate", "truncated")}})
            at += size
        rows.clear()
        ends = {0: (0, "", ())}
        return pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.int64()), ("span", pa.int64()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), *[(c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated")]]))

    for batch in batches:
        for r in batch.to_pylist():
            last = held[-1] if held else rows[-1] if rows else None
            if last is not None and last["conv"] != r["conv"]:
                yield finish()
            held.append(r)
            if len(held) >= CHAIN:
                carry()
    if held or rows:
        yield finish()


_TURNS = "conv bigint, place bigint, step int, edit string, role string, text string"


def _apply(turns: pa.Table, plan: pa.Table) -> pa.Table:
    turns = turns.sort_by("place")
    conv, place, role, text = (turns.column(c).to_pylist() for c in ("conv", "place", "role", "text"))
    of = {r["conv"]: r for r in plan.to_pylist()}
    out = []
    for a, b in _runs(conv):
        how = of[conv[a]]
        for step, (at, edit, new_role, new_text) in enumerate(edited(list(zip(role[a:b], text[a:b], strict=True)), how["audit"], how["state"])):
            out.append((conv[a], place[a + at], step, edit, new_role, new_text))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
    columns = list(zip(*out, strict=True)) or [()] * len(types)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv", "place", "step", "edit", "role", "text"])


def _digest(batches):
    """Rows sorted by conversation, place and step: the whole audit and the hash of the repaired turns, as they stream by."""
    names = ["conv", "audit", "repaired_sha256"]
    types = (pa.int64(), pa.string(), pa.string())
    last, begun, audit, digest, any_turn = None, False, [], hashlib.sha256(), False

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for batch in batches:
        out = []
        conv, _, _, edit, role, text = (c.to_pylist() for c in batch.columns)
        for c, e, r, t in zip(conv, edit, role, text, strict=True):
            if not begun or c != last:
                if begun:
                    out.append((last, "".join(audit), digest.hexdigest()))
                last, begun, audit, digest, any_turn = c, True, [], hashlib.sha256(), False
            audit.append(e)
            if e != "D":
                digest.update((("\n" if any_turn else "") + f"{r}:{t}").encode("utf-8", "surrogatepass"))
                any_turn = True
        if out:
            yield made(out)
    if begun:
        yield made([(last, "".join(audit), digest.hexdigest())])


def _faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it is not closed by a full stop, question mark or exclamation mark."""
    end = F.rtrim(text, F.lit(WHITE))
    return end == "", ~F.coalesce(F.right(end, F.lit(1)).isin(".", "!", "?"), F.lit(False))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows``: conv_id, turn, role, text. Gives (conversations, repaired turns).

    Conversations: conv_id, blank, duplicate, truncated (turns by their first fault), illegal (neighbours whose initials are not
    su, ua or au), cost, audit, repaired_sha256 (of ``role:text`` lines). Turns: conv_id, place and step (their order), edit,
    role, text; deleted ones have neither role nor text.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    turns = turns.withColumn("hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "hash", "tie"]
    # the place is taken once and written down: what follows may be computed again
    placed = stage_table(turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("place", F.monotonically_increasing_id()), "turns")
    blank, open_end = _faults(F.col("text"))
    light = placed.select("conv", "place", "role", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), open_end.alias("open_end"), "hash")
    first = light.groupBy("conv", "role", "hash").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = light.join(first, "place", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("open_end"), TRUNCATED).otherwise(SOUND)
    span = F.shiftright("place", SPAN_BITS).alias("span")
    spans = marked.select("conv", "place", "initial", fault.alias("fault"), span).groupBy("span").applyInArrow(_search, f"conv bigint, span bigint, {_ITEMS}")
    plan = stage_table(spans.repartition("conv").sortWithinPartitions("conv", "span").mapInArrow(_chain, _PLAN), "repair-plan")
    texts = placed.select("conv", "place", "role", "text", span)
    made = stage_table(texts.groupBy("span").cogroup(plan.select("span", "conv", "state", "audit").groupBy("span")).applyInArrow(_apply, _TURNS), "repaired")
    digests = made.repartition("conv").sortWithinPartitions("conv", "place", "step").mapInArrow(_digest, "conv bigint, audit string, repaired_sha256 string")
    counts = plan.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    both = counts.join(digests.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
    return both.select(F.col("conv").alias("conv_id"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), made.withColumnRenamed("conv", "conv_id")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text, 2 removes its
    full stops, question and exclamation marks, 3 repeats it, 4 makes its role user. Nulls in strings are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    hurt = turns.withColumn("kind", kind).where("kind <> 0")
    new_text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return hurt.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Damage, then repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``gaps``: numbers missing between the least and the largest turn after damage, ignoring nulls (0 beyond the range of bigint).
    Conversations that lost all rows have zeros, an empty audit and the hash of nothing.
    """
    hurt = damage(rows)
    found, _ = repair(hurt)
    numbers = hurt.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id").agg(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), 1 - F.count("turn")).alias("gaps"))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(numbers.withColumnRenamed("conv_id", "g"), F.col("conv_id").eqNullSafe(F.col("g")), "left").drop("g")
    out = out.join(found.withColumnRenamed("conv_id", "f"), F.col("conv_id").eqNullSafe(F.col("f")), "left").drop("f")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The same in DuckDB SQL: the states of all conversations, turn by turn."""
    crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"
    put = ", ".join(f"({p}, {j}, {q}, '{t}')" for p in STATES for j, q, t in _puts(p))
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
    c AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM r),
    h AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
    n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k, left(role, 1) AS initial, rtrim(text, {white}) AS body FROM h),
    f AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM n),
    s AS (SELECT DISTINCT conv_id FROM conversations),
    puts(p, j, q, lines) AS (VALUES {put}),
    d AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''}} AS best FROM s
      UNION ALL
      SELECT conv_id, k, state, min(best) FROM (
        SELECT d.conv_id, f.k, CASE e.edit WHEN 'D' THEN q WHEN 'R' THEN CASE q WHEN 2 THEN 3 ELSE 2 END ELSE CASE WHEN q = 0 AND initial = 's' THEN 1 WHEN q <> 2 AND initial = 'u' THEN 2 WHEN q = 2 AND initial = 'a' THEN 3 END END AS state,
          {{'cost': best.cost + j * {INSERT} + CASE e.edit WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE 0 END + CASE WHEN fault = 3 AND e.edit <> 'D' THEN {LATE} ELSE 0 END,
            'audit': best.audit || repeat('I', j) || e.edit,
            'lines': best.lines || puts.lines || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || text || chr(10) END}} AS best
        FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.k = d.k + 1 JOIN puts ON p = d.state CROSS JOIN (VALUES ('K'), ('R'), ('D')) e(edit)
        WHERE fault IN (0, 3) OR e.edit = 'D') WHERE state IS NOT NULL GROUP BY conv_id, k, state),
    m AS (SELECT conv_id, max(k) AS last FROM d GROUP BY conv_id),
    z AS (SELECT d.conv_id, min({{'cost': best.cost + j * {INSERT}, 'audit': best.audit || repeat('I', j), 'lines': best.lines || puts.lines}}) AS best
      FROM d JOIN m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND d.k = m.last JOIN puts ON p = d.state WHERE q IN (0, 3) GROUP BY d.conv_id),
    t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
    SELECT s.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      best.cost AS cost, best.audit AS audit, sha256(left(best.lines, greatest(length(best.lines) - 1, 0))) AS repaired_sha256
    FROM s JOIN z ON z.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id"""


def _puts(state: int) -> list[tuple[int, int, str]]:
    """Up to two turns put in one after another: (how many, state after them, their lines)."""
    out, lines = [(0, state, "")], ""
    for j in (1, 2):
        state = _PUT[state]
        lines += f"{ROLE[state]}:\n"
        out.append((j, state, lines))
    return out


SQL = _sql()
