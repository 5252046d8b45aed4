import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from crownwork.llm import simhash
from crownwork.llm.simhash import classed, links, prints, unary_counts


def plain(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    n = min(size, len(words))
    hashes = [xxhash.xxh64(" ".join(words[k : k + n]).encode(), seed=42).intdigest() for k in range(len(words) - n + 1)] if words else []
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def components(values, apart=2):
    """The least place that links lead to, for each value, by comparing all."""
    out = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= apart and out[i] != out[j]:
                lo, hi = sorted((out[i], out[j]))
                out = [lo if x == hi else x for x in out]
    return out


def brute(rows):
    found = [plain(t) for _, t in rows]
    group = components(found)
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, found, group)), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["É", "the", "Of", "LOREM", "ipsum", "dolor", "sit", "ÀB", "ça", "x", " y", "K"]  # the Kelvin sign stays
    text = lambda k: rng.choice([" ", "\n", "\t ", "\x0b"]).join(rng.choice(words) + str(rng.randrange(30)) for _ in range(k))
    texts = [text(rng.choice([0, 1, 2, 3, 4, 30, 300])) for _ in range(n)]
    for _ in range(n):
        w = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    rows = [(5 * k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, "alone here and nowhere else"), (7, None), (3, ""), (3, texts[1]), (3, texts[1]), (-4, " \n")]
    rng.shuffle(rows)
    return rows


def test_prints_of_texts(monkeypatch):
    texts = [t or "" for _, t in made(1)] + ["one two three four " * 500]
    want = [plain(t) for t in texts]
    assert prints([t.encode() for t in texts]).tolist() == want
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert prints([t.encode() for t in texts]).tolist() == want


@pytest.mark.parametrize("seed", [2, 3])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 print", "2 node", "3 first").repartition(4)
    want = brute(rows)
    assert sum(i != c for i, _, c in want) > 40
    assert got(classed(df)) == want


@pytest.mark.parametrize("apart,crowd", [(2, 256), (2, 20), (1, 4), (2, 1)])
def test_links_lose_nothing_where_prints_crowd(spark, apart, crowd):
    rng = random.Random(apart)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = {0, 1 << 63, (1 << 64) - 1} | {rng.getrandbits(64) for _ in range(100)}
    for b in base:  # all values of few bits, and of bits anywhere
        values |= {b ^ x for x in range(256)} | {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= apart}
    df = spark.createDataFrame([(v,) for v in signed], "print bigint")
    assert set(map(tuple, links(df, apart, crowd).collect())) == want


def test_unary_counts_are_a_lower_bound(spark):
    rng = random.Random(9)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(200)] + [(1 << 63, 0), ((1 << 64) - 1, 0), (1 << 62, 1 << 63)]
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(sign(a), sign(b)) for a, b in pairs], "a bigint, b bigint")
    rows = df.select(F.bit_count(unary_counts(F.col("a")).bitwiseXOR(unary_counts(F.col("b")))).alias("d")).collect()
    for (a, b), r in zip(pairs, rows):
        assert r["d"] == sum(abs((a >> k & 3).bit_count() - (b >> k & 3).bit_count()) for k in range(0, 64, 2)) <= (a ^ b).bit_count()


def test_no_rows_and_settings_stay(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "9m")
    assert classed(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "9m"
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_very_long_text_and_many_copies(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(200_000))
    rows = [(9, long), (4, long + " end")] + [(100 + k, "the same few words") for k in range(300)]
    want = [(i, f"{plain(t):016x}") for i, t in rows[:3]]
    out = got(classed(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [(i, p) for i, p, _ in out if i in (9, 4, 100)] == sorted(want, key=repr)
    assert {c for i, _, c in out if i >= 100} == {100} and {c for i, _, c in out if i < 100} == {4}
