"""Repair of the structure of conversations at least cost, by a dynamic program that stores few of its vectors.

A repaired conversation is empty, or has user and assistant in turn, user first and assistant last, after at most one
system message: ``(s?(ua)+)?`` in initials of roles. A walk over the rows is in one of four states: nothing yet, after
system, after user, after assistant. Edits: K keep (0), R give the role that the state asks for (2), D delete (3), I insert
an empty message of that role (2); a kept or rerolled truncated row costs 1 more.

1. Rows are put in order by ranges, over any number of partitions, and numbered; each 4096 numbers are a block. A long
   conversation has rows in many blocks; a block's rows of one conversation are a run.
2. Each run gives the least costs between its states, 16 numbers. A conversation's runs are put together from its end: this
   stores the vector of least costs to the end at each run's end, a checkpoint.
3. From that, each run walks forward from each state that it may begin in. It has vectors at every square root of its length
   only, and recomputes those between as it goes; of the edges that lie on a cheapest way it takes the least letter. As
   letter and state determine the next state, the letters of all are the ASCII-least audit.
4. The walk that begins where the run before ends is the one that counts. Rows and letters meet in order, and the text that
   is left is hashed as it streams by.

A task of steps 1 to 3 holds a block. Step 2 gathers 16 numbers for 4096 rows of a conversation. SHA-256 has to see a
conversation's text in order, so step 4 streams each conversation through one task, of which it holds a batch and the audit.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, discard, small_hint, stored

#: Bits of a row's number that tell its place in its block.
BLOCK = 12
FAR = 1 << 40
#: What follows an inserted or rerolled message, by state; and the role it has.
NEXT = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
#: The costs to the end where no row is left.
END = np.array([0, 4, 2, 0])
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def _edits(code: int) -> list[list[tuple[str, int, int]]]:
    """By state, the edits that use up a row: letter, cost, next state. code: 4 * place of the initial in "sua?" + fault."""
    initial, fault = "sua?"[code >> 2], code & 3
    out = []
    for s in range(4):
        out.append([("D", 3, s)])
        if fault not in (BLANK, DUPLICATE):
            more = int(fault == TRUNCATED)
            if s in _KEPT.get(initial, {}):
                out[s].append(("K", more, _KEPT[initial][s]))
            out[s].append(("R", 2 + more, NEXT[s]))
    return out


EDITS = [_edits(c) for c in range(16)]


def _steps() -> np.ndarray:
    """For each code, the least cost from a state before the row to one after it, with insertions before the row."""
    t = np.full((16, 4, 4), FAR)
    for c in range(16):
        for s in range(4):
            for _, cost, to in EDITS[c][s]:
                t[c, s, to] = min(t[c, s, to], cost)
        plain = t[c].copy()
        for s in range(4):
            t[c, s] = np.minimum(t[c, s], np.minimum(2 + plain[NEXT[s]], 4 + plain[NEXT[NEXT[s]]]))
    return t


STEPS = _steps()


def before(codes, after: np.ndarray) -> np.ndarray:
    """The vector (or matrix, by column) of costs before the rows from that after them."""
    v = after
    for c in reversed(codes):
        v = (STEPS[c][:, :, None] + v[None]).min(1) if v.ndim == 2 else (STEPS[c] + v).min(1)
    return np.minimum(v, FAR)


def walked(codes, after: np.ndarray, state: int, last: bool) -> tuple[list[str], int]:
    """For each row its letters, insertions before it included, on the ASCII-least cheapest way from a state; and the state
    at the end. last: insertions after the last row belong to it."""
    n = len(codes)
    step = max(1, math.isqrt(n))
    marks = {n: np.asarray(after)}
    for at in range((n - 1) // step * step, -1, -step):
        marks[at] = before(codes[at : min(at + step, n)], marks[min(at + step, n)])
    out = []
    for at in range(0, n, step):
        to = min(at + step, n)
        vectors = [marks[to]]
        for c in reversed(codes[at:to]):
            vectors.append((STEPS[c] + vectors[-1]).min(1))
        vectors = [v.tolist() for v in reversed(vectors)]
        for k in range(at, to):
            here, there, letters = vectors[k - at], vectors[k - at + 1], ""
            while True:
                tight = [(x, to_, True) for x, cost, to_ in EDITS[codes[k]][state] if cost + there[to_] == here[state]]
                if 2 + here[NEXT[state]] == here[state]:
                    tight.append(("I", NEXT[state], False))
                letter, state, used = min(tight)
                letters += letter
                if used:
                    break
            out.append(letters)
    while last and n and state not in (0, 3):
        out[-1] += "I"
        state = NEXT[state]
    return out, state


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in, by crc32 of conv_id:turn modulo 20: 0 drops the row, 1 empties
    its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's. A null is
    one space, but for conv_id and turn themselves."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    own = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), fate.alias("fate")).where("fate != 0")
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("nth")).drop("nth")


def _runs(t: pa.Table):
    """The block's runs: their first number, and their rows' places in it."""
    first = np.flatnonzero(np.concatenate([[True], t.column("fresh").to_numpy()[1:]]))
    return zip(t.column("at").to_numpy()[first].tolist(), first.tolist(), [*first[1:].tolist(), t.num_rows])


def _own_runs(t: pa.Table):
    conv = t.column("conv_id").to_pylist()
    fresh = np.array([True, *[x != y for x, y in zip(conv, conv[1:])]])
    return t.append_column("fresh", pa.array(fresh))


_SUMMARY = "run bigint, costs array<bigint>, first int, last int, illegal bigint, blank bigint, duplicate bigint, truncated bigint"


def _summed(t: pa.Table) -> pa.Table:
    t = _own_runs(t.sort_by("at"))
    codes, conv, out = t.column("code").to_numpy(), t.column("conv_id").combine_chunks(), []
    for run, lo, hi in _runs(t):
        own = codes[lo:hi]
        faults, initials = np.bincount(own & 3, minlength=4), (own >> 2).tolist()
        costs = before(own.tolist(), np.where(np.eye(4, dtype=bool), 0, FAR))
        illegal = sum((x, y) not in LEGAL for x, y in zip(initials, initials[1:]))
        out.append((lo, run, costs.ravel().tolist(), initials[0], initials[-1], illegal, *faults[1:].tolist()))
    c = list(zip(*out))
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in _SUMMARY.split(", ")]
    return pa.table({"conv_id": conv.take(pa.array(c[0]))} | {n: pa.array(x, k) for n, x, k in zip(names, c[1:], kinds)})


#: Pairs of places in "sua?" that may follow each other: su, ua, au.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _put_together(batches):
    """A conversation's runs from the end: its cost, its counts, and for each run the costs after it."""
    for b in batches:
        cost, illegal, plans = [], [], []
        for runs in b.column("runs").to_pylist():
            v, plan = END, []
            for k in range(len(runs) - 1, -1, -1):
                plan.append({"run": runs[k]["run"], "after": v.tolist(), "first": k == 0, "last": k == len(runs) - 1})
                v = (np.array(runs[k]["costs"]).reshape(4, 4) + v).min(1)
            cost.append(int(v[0]))
            illegal.append(sum(r["illegal"] for r in runs) + sum((x["last"], y["first"]) not in LEGAL for x, y in zip(runs, runs[1:])))
            plans.append(plan)
        kind = pa.list_(pa.struct([("run", pa.int64()), ("after", pa.list_(pa.int64())), ("first", pa.bool_()), ("last", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()), pa.array(plans, kind)], ["conv_id", "cost", "illegal", "plan"])


def _walks(t: pa.Table, plan: pa.Table) -> pa.Table:
    """The letters of a block's rows from each state that their run may begin in, and the state at the run's end."""
    t = _own_runs(t.sort_by("at"))
    codes, ats, known = t.column("code").to_numpy().tolist(), t.column("at").to_numpy(), {p["run"]: p for p in plan.to_pylist()}
    rows, out = [], []
    for run, lo, hi in _runs(t):
        p = known[run]
        for state in (0,) if p["first"] else range(4):
            letters, end = walked(codes[lo:hi], np.array(p["after"]), state, p["last"])
            rows += range(lo, hi)
            out += [(run, state, end, x) for x in letters]
    c = list(zip(*out))
    taken = pa.array(rows)
    return pa.table({"conv_id": t.column("conv_id").combine_chunks().take(taken), "at": pa.array(ats).take(taken), "run": pa.array(c[0], pa.int64()), "state": pa.array(c[1], pa.int32()), "end": pa.array(c[2], pa.int32()), "letters": pa.array(c[3], pa.string())})


def _followed(batches):
    """Of a conversation's runs in order, the states that they begin in."""
    for b in batches:
        found = []
        for runs in b.column(0).to_pylist():
            state, ends = 0, {(r["run"], r["state"]): r["end"] for r in runs}
            for run in sorted({r["run"] for r in runs}):
                found.append((run, state))
                state = ends[run, state]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32())], ["run", "state"])


def _written(digest: bool):
    """Rows in order, each after its letters: each conversation's audit and its lines (digest: their SHA-256)."""

    def run(batches):
        nobody = object()
        conv, state, letters, audit, lines, sha = nobody, 0, "", [], [], hashlib.sha256()
        out: list = []

        def line(role, text):
            if digest:
                sha.update((b"\n" if lines else b"") + f"{role}:{text}".encode())
                lines[:] = [True]
            else:
                lines.append({"role": role, "text": text})

        def ended():
            if conv is not nobody:
                out.append((conv, "".join(audit), sha.hexdigest() if digest else list(lines)))

        kind = pa.string() if digest else pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

        def told(like):
            some = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], like), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], kind)], ["conv_id", "audit", "repaired"])
            out.clear()
            return some

        like = None
        for b in batches:
            like = b.column(0).type
            for c, is_text, role, text in zip(*[b.column(k).to_pylist() for k in range(4)]):
                if c != conv or conv is nobody:
                    ended()
                    conv, state, audit, lines, sha = c, 0, [], [], hashlib.sha256()
                if not is_text:
                    letters = text
                    audit.append(letters)
                    continue
                for x in letters:
                    if x == "I":
                        line(ROLES[state], "")
                    elif x == "R":
                        line(ROLES[state], text)
                    elif x == "K":
                        line(role, text)
                    if x == "K":
                        state = {"s": 1, "u": 2, "a": 3}[role[0]]
                    elif x != "D":
                        state = NEXT[state]
            yield told(like)
        ended()
        if out:
            yield told(like)

    return run


def repaired(rows: DataFrame, digest: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired of rows(conv_id, turn, role, text).

    repaired: the messages (role, text) of the repaired conversation (digest: the SHA-256 of its lines role:text joined by
    line feeds). gaps: turns missing between the least and the greatest. A row's first fault counts: blank (no character
    but white space), duplicate (role and text were there before), truncated (the last such character is no full stop,
    exclamation or question mark). illegal: neighbours whose roles' initials aren't su, ua or au.

    Rows are in order of turn, nulls first; those of one turn by role, then by MD5 of the text. Repeated rows are
    duplicates. A null role or text is one space: an unknown role, a blank text. Null conv_id is a conversation of its own.
    An empty table gives no rows."""
    spark = rows.sparkSession
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), known("role").alias("role"), known("text").alias("text"), F.monotonically_increasing_id().alias("nth"))
    order = ("conv_id", "turn", "role", "digest", "nth")  # nth: many equal rows needn't stay in one range
    dealt = own.withColumn("digest", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stored(dealt.select(F.monotonically_increasing_id().alias("at"), "conv_id", "turn", "role", "text", "digest"))
    again = stored(ordered.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first_at"), F.count("*").alias("n")).where("n > 1").drop("n"))
    c, r, d = (F.col(f"again.{x}") for x in ("conv_id", "role", "digest"))
    met = ordered.alias("own").join(small_hint(again).alias("again"), F.col("own.conv_id").eqNullSafe(c) & (F.col("own.role") == r) & (F.col("own.digest") == d), "left")
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    fault = F.when(blank, BLANK).when(F.col("at") != F.col("first_at"), DUPLICATE).when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), TRUNCATED).otherwise(NONE)
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("own.role", 1, 1)) * F.when(F.col("own.role") == "", 0).otherwise(1), F.lit(0)), F.lit(4)) - 1
    marks = stored(met.select("own.conv_id", "at", F.shiftright("at", BLOCK).alias("block"), (initial * 4 + fault).cast("int").alias("code")))
    conv = marks.schema["conv_id"].dataType.simpleString()
    summaries = marks.groupBy("block").applyInArrow(_summed, f"conv_id {conv}, {_SUMMARY}")
    fields = F.struct("run", "costs", "first", "last", "illegal")  # a row for 4096 of a conversation
    counted = [F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")]
    gathered = stored(summaries.groupBy("conv_id").agg(F.array_sort(F.collect_list(fields)).alias("runs"), *counted))
    plan_kind = "array<struct<run: bigint, after: array<bigint>, first: boolean, last: boolean>>"
    plans = stored(gathered.select("conv_id", "runs").mapInArrow(_put_together, f"conv_id {conv}, cost bigint, illegal bigint, plan {plan_kind}"))
    of_runs = plans.select(F.explode("plan").alias("p")).select("p.*").withColumn("block", F.shiftright("run", BLOCK))
    walks = stored(marks.groupBy("block").cogroup(of_runs.groupBy("block")).applyInArrow(_walks, f"conv_id {conv}, at bigint, run bigint, state int, end int, letters string"))
    ends = walks.groupBy("conv_id", "run", "state").agg(F.first("end").alias("end"))
    begun = stored(ends.groupBy("conv_id").agg(F.collect_list(F.struct("run", "state", "end")).alias("runs")).select("runs").mapInArrow(_followed, "run bigint, state int"))
    letters = walks.join(small_hint(begun), ["run", "state"], "left_semi").select("conv_id", "at", F.lit(False).alias("is_text"), F.lit(None).cast("string").alias("role"), F.col("letters").alias("text"))
    texts = ordered.select("conv_id", "at", F.lit(True).alias("is_text"), "role", "text")
    stream = letters.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "at", "is_text").select("conv_id", "is_text", "role", "text")
    kind = "string" if digest else "array<struct<role: string, text: string>>"
    with batch_bytes(spark):
        left = stored(stream.mapInArrow(_written(digest), f"conv_id {conv}, audit string, repaired {kind}"))
    turn = lambda f: f("turn").cast("decimal(20,0)")
    missing = F.least(turn(F.max) - turn(F.min) + 1 - F.count_distinct("turn"), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("bigint")
    gaps = ordered.groupBy("conv_id").agg(F.when(F.count("turn") > 0, missing).otherwise(0).alias("gaps"))
    out = left
    for more in (gaps, gathered.drop("runs"), plans.drop("plan")):
        more = more.withColumnRenamed("conv_id", "its")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("its"))).drop("its")
    out = stored(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"))
    discard(ordered, again, marks, gathered, plans, walks, begun, left)
    return out


def oracle_sql() -> str:
    """The rows of the query in SQL: the vectors of (cost, audit, lines) to the end, from a conversation's last row to its
    first."""
    least = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda w: w is not null))"
    way = lambda cost, letter, to, line: f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'l': {f'list_prepend({line}, {to}.l)' if line else f'{to}.l'}}}"
    used = []
    for s in range(4):
        kept = " ".join(f"when '{i}' then {way('n.cut', 'K', f'v{to}', 'n.role || chr(58) || n.text')}" for i, by in _KEPT.items() if (to := by.get(s)) is not None)
        keep = f"case when n.fault in ('', 'truncated') then case n.initial {kept} end end"
        role = f"case when n.fault in ('', 'truncated') then {way('2 + n.cut', 'R', f'v{NEXT[s]}', f'{ROLES[s]!r} || chr(58) || n.text')} end"
        used.append(f"{least(way(3, 'D', f'v{s}', None), keep, role)} as b{s}")
    added = lambda s, to: way(2, "I", to, f"'{ROLES[s]}:'")
    full = [least(f"b{s}", added(s, f"b{NEXT[s]}"), added(s, added(NEXT[s], f"b{NEXT[NEXT[s]]}"))) + f" as v{s}" for s in range(4)]
    none, one, two = "[]::varchar[]", "['assistant:']::varchar[]", "['user:', 'assistant:']::varchar[]"
    end = f"{{'c': 0, 'a': '', 'l': {none}}} as v0, {{'c': 4, 'a': 'II', 'l': {two}}} as v1, {{'c': 2, 'a': 'I', 'l': {one}}} as v2, {{'c': 0, 'a': '', 'l': {none}}} as v3"
    crc = "xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::bigint), lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)), lambda c, i: xor(c // 2, 3988292384 * (c % 2))), 4294967295), 4294967295) % 20"
    return rf"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
dealt as (select *, {crc} as fate from keyed),
harmed as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case when fate = 1 then '' when fate = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when fate = 3 then 2 else 1 end)) as nth
  from dealt where fate <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), nth) as i from harmed),
marked as (
  select *, substr(role, 1, 1) as initial,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
      when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault,
    lag(substr(role, 1, 1)) over (partition by conv_id order by i) as initial_before
  from placed),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (i > 1 and initial_before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from marked group by conv_id),
walk as (
  select conv_id, n as i, {end} from counted
  union all
  select conv_id, i, {', '.join(full)} from (
    select w.conv_id, w.i - 1 as i, {', '.join(used)}
    from walk w join (select *, (fault = 'truncated')::int as cut from marked) n on w.conv_id is not distinct from n.conv_id and w.i = n.i))
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(w.v0.c, 0)::bigint as cost, coalesce(w.v0.a, '') as audit, sha256(coalesce(array_to_string(w.v0.l, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counted on c.conv_id is not distinct from counted.conv_id
left join walk w on c.conv_id is not distinct from w.conv_id and w.i = 0"""
