import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest

from crownwork.llm import conversations
from crownwork.llm.conversations import END, before, damaged, repaired, walked

sys.setrecursionlimit(20_000)  # for the brute-force version
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fate = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def cheapest(rows):
    """Least cost and then the ASCII-least audit, with its lines, by trying all ways from the front, cheapest first."""
    from functools import cache

    nxt = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    @cache
    def best(i, s, inserts=0):
        ways = [(0, "", ())] if i == len(rows) and s in (0, 3) else []
        role, state = nxt[s]
        if inserts < 2:
            c, a, l = best(i, state, inserts + 1)
            ways.append((c + 2, "I" + a, ((role, ""), *l)))
        if i < len(rows):
            who, text, fault = rows[i]
            c, a, l = best(i + 1, s)
            ways.append((c + 3, "D" + a, l))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                c, a, l = best(i + 1, state)
                ways.append((c + 2 + more, "R" + a, ((role, text), *l)))
                to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(who[:1])
                if to:
                    c, a, l = best(i + 1, to)
                    ways.append((c + more, "K" + a, ((who, text), *l)))
        return min(ways, default=(10**9, "", ()))

    return best(0, 0)


def brute(rows, text=False):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r[1:])
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, t in own:
            left = t.strip(SPACE)
            fault = "blank" if not left else "duplicate" if (role, t) in seen else "truncated" if left[-1] not in ".!?" else None
            seen.add((role, t))
            marked.append((role, t, fault))
            if fault:
                count[fault] += 1
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        cost, audit, lines = cheapest(tuple(marked))
        last = "\n".join(f"{r}:{t}" for r, t in lines)
        out.append((conv, gaps, *count.values(), illegal, cost, audit, last if text else hashlib.sha256(last.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.choice([1, 2, 3, 5, 8, 12])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "", None, "Assistant", "étude"])
            text = rng.choice(["Yes.", "no", " \n", "", None, "What?\t", "a. b", " ", "Long one! " + str(rng.random()), "énd "])
            rows.append((None if c == 3 else c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), role, text))
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_walk_with_checkpoints(seed):
    rng = random.Random(seed)
    faults = [None, "blank", "duplicate", "truncated"]
    for n in [0, 1, 2, 3, 5, 9, 17]:
        rows = [(rng.choice("sua?"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        codes = ["sua?".index(i) * 4 + f for i, f in rows]
        cost, audit, _ = cheapest(tuple((i, f"x{k}", faults[f]) for k, (i, f) in enumerate(rows)))
        assert before(codes, END)[0] == cost
        assert "".join(walked(codes, END, 0, True)[0]) == audit
        for cut in range(1, n):  # in two runs
            costs = before(codes[:cut], np.where(np.eye(4, dtype=bool), 0, conversations.FAR))
            after = before(codes[cut:], END)
            assert ((costs + after).min(1) == before(codes, END)).all()
            one, state = walked(codes[:cut], after, 0, False)
            assert "".join(one + walked(codes[cut:], END, state, True)[0]) == audit


@pytest.mark.parametrize("seed,bits", [(1, 12), (2, 2), (3, 1)])
def test_against_brute_force(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(conversations, "BLOCK", bits)
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 at", "2 run", "3 state").repartition(5)
    want = brute(harm(rows))
    assert len({r[7] for r in want}) > 20
    assert got(repaired(damaged(df), digest=True)) == want


def test_one_conversation_of_many_rows_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 3)
    rng = random.Random(7)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "Is it " + str(t) + "?"])) for t in range(300)]
    rows += [(1, 20, "user", "A.")] * 100 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "x" * 300_000 + ".")]
    assert got(repaired(spark.createDataFrame(rows, SCHEMA).repartition(6), digest=True)) == brute(rows)


def test_messages_and_no_rows(spark):
    rows = [(5, 0, "system", "Be kind."), (5, 1, "user", "Hello."), (5, 2, "user", "Hello."), (5, 4, "assistant", "Bye")]
    (one,) = repaired(spark.createDataFrame(rows, SCHEMA)).collect()
    assert tuple(one)[:8] == (5, 1, 0, 1, 1, 1, 4, "KKDK")
    assert [tuple(m) for m in one["repaired"]] == [("system", "Be kind."), ("user", "Hello."), ("assistant", "Bye")]
    assert repaired(damaged(spark.createDataFrame([], SCHEMA)), digest=True).collect() == []


def test_query_over_whole_table(spark, tmp_path):
    from crownwork.llm.queries import op13_conversation_repair

    dropped = next(c for c in range(10**6, 2 * 10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = made(11) + [(dropped, 0, "user", "Gone."), (-(1 << 63), -(1 << 63), "user", "a"), (-(1 << 63), (1 << 63) - 1, "user", "b")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    left = brute(harm(rows))
    want = [r if r[0] != -(1 << 63) else (r[0], min(r[1], (1 << 63) - 1), *r[2:]) for r in left]
    want += [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in {r[0] for r in rows} - {r[0] for r in left}]
    assert dropped in {r[0] for r in want}
    assert got(op13_conversation_repair(spark, str(tmp_path))) == sorted(want, key=repr)


def test_query_equals_its_sql(spark):
    import duckdb

    from crownwork.llm.queries import op13_conversation_repair, oracle_sql

    d = "/root/testdata/sf0.01"
    want = duckdb.sql(oracle_sql()["op13_conversation_repair"].replace("from conversations", f"from '{d}/conversations.parquet'")).fetchall()
    assert got(op13_conversation_repair(spark, d)) == sorted(want, key=repr) != []
