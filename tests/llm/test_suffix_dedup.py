import hashlib
import random

import numpy as np
import pytest

from crownwork.llm import suffix_dedup


def brute(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["é", "the", "of", "lorem", "ipsum", "dolor", "sit", "amet", "ça", "x"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(k))
    passages, rows = [text(40) for _ in range(5)], []
    for i in range(n):
        t = [text(rng.choice([0, 3, 30, 80]))]
        if rng.random() < 0.5:
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            t.append(p if rng.random() < 0.5 else p[:cut] + "#" + p[cut:])
        if rng.random() < 0.2 and rows:
            t = [rng.choice(rows)]
        rows.append("\n".join([*t, text(rng.choice([0, 5]))]))
    rows += ["a" * 700, "a" * 250, "ab" * 300, "", None, "z" * 99, "z" * 100, "z" * 101, text(2000) * 2]
    rng.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,limit,parts", [(1, 1 << 26, 5), (2, 0, 3), (3, 1 << 26, 1)])
def test_against_brute_force(spark, seed, limit, parts):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 ord", "2 lo", "3 n", "4 kept0", "5 name").repartition(parts)
    df = df.selectExpr("*", "1 kept", "2 left", "3 th").drop("kept0")
    got = suffix_dedup.deduplicated(df, digest=True, broadcast_bytes=limit)
    assert sorted(map(tuple, got.selectExpr("kept.doc_id", "n_bytes", "n_removed", "n_spans", "left").collect())) == brute(rows, 100)


def test_small_batches_and_long_documents(spark, monkeypatch):
    rows = made(5, 30)
    monkeypatch.setattr(suffix_dedup, "_PLACE", 12)
    raw = {i: (t or "").encode() for i, t in rows}
    for i, r in raw.items():
        pieces = suffix_dedup._parts(r, 100)
        strings = [r[k : k + 100] for k in range(len(r) - 99)]
        assert [p[k : k + 100] for _, p in pieces for k in range(len(p) - 99)] == strings
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = suffix_dedup.deduplicated(df, digest=True).selectExpr("kept.doc_id", "n_bytes", "n_removed", "n_spans", "left")
        assert sorted(map(tuple, got.collect())) == brute(rows, 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_rows_null_ids_and_no_rows(spark):
    t = "q" + "".join(chr(97 + k * 7 % 26) + str(k) for k in range(90))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, "short"), (2, "other" + t)], "doc_id bigint, text string")
    got = sorted(((r["kept"]["doc_id"] or 0, r["n_bytes"] - r["n_removed"]) for r in suffix_dedup.deduplicated(df).collect()))
    assert got == [(0, 5), (1, len(t)), (1, len(t)), (2, 0), (2, 5)]
    assert suffix_dedup.deduplicated(df.limit(0)).collect() == []


def test_levels_merge_geometrically():
    levels = suffix_dedup.Levels()
    rng = np.random.default_rng(0)
    every = []
    for _ in range(13):
        x = np.sort(rng.integers(0, 1000, 5))
        every.append(x)
        levels.add(x)
    assert [r for r, _ in levels.levels] == [3, 2, 0]
    assert sorted(np.concatenate([x for (x,) in levels]).tolist()) == sorted(np.concatenate(every).tolist())
    assert all((np.diff(x) >= 0).all() for (x,) in levels)


def test_common_runs_go_on_once(spark):
    """A passage that all documents hold, dealt in falling order of doc_id and by slices of one document."""
    passage = "common passage " * 20
    rows = [(i, f"{i} begins " * 3 + passage + f" and {i} ends") for i in range(200, 0, -1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = suffix_dedup.deduplicated(df, digest=True)
    assert sorted(map(tuple, got.selectExpr("kept.doc_id", "n_bytes", "n_removed", "n_spans", "left").collect())) == brute(rows, 100)
    rising = spark.createDataFrame(sorted(rows) * 1, "doc_id bigint, text string").coalesce(1)
    named = rising.selectExpr("doc_id ord", "0 th", "text").mapInArrow(suffix_dedup._named(100), suffix_dedup.ROWS)
    assert named.where("not again").groupBy("name", "run").count().where("count > 1").isEmpty()


def test_texts_of_one_id_whose_hashes_agree(spark, monkeypatch):
    """(null, a), (null, b) and (1, a), (1, b) of equal hash: both stay documents of their own."""
    from pyspark.sql import functions as F

    whole, seeds = suffix_dedup._identity, []

    def poor(text, seed):
        seeds.append(seed)
        return F.pmod(whole(text, seed), F.lit((2, 3)[seed])) if seed < 2 else whole(text, seed)

    monkeypatch.setattr(suffix_dedup, "_identity", poor)
    rng = random.Random(8)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(277)) for _ in range(2))
    extra = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(6)]
    for first in (None, 1):
        df = spark.createDataFrame([(first, x) for x in (a, b, *extra)] + [(5, b), (6, a)], "doc_id bigint, text string")
        got = suffix_dedup.deduplicated(df).where("kept.doc_id >= 5").selectExpr("kept.doc_id", "n_removed").collect()
        assert sorted(map(tuple, got)) == [(5, 277), (6, 277)]
    assert max(seeds) == 2


def test_many_rows_without_id_and_a_seam(spark):
    """Rows without doc_id come first, in the order of a hash; a text of 300 kB is looked at in parts, with repeats over
    the seam."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    own = [text(120) for _ in range(4000)]
    seam, tail = text(600), text(150)
    long = text((1 << 18) - 300) + seam + text(40_000) + tail
    rows = [(None, t) for t in own] + [(1, long), (2, "x" + seam), (3, tail), (4, own[7] + "!" + own[8])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.deduplicated(df).selectExpr("kept.doc_id", "n_bytes", "n_removed").where("doc_id is not null").collect()}
    assert got == {1: (len(long), 0), 2: (601, 600), 3: (150, 150), 4: (241, 240)}
