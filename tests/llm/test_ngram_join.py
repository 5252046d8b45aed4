import random
import re

import numpy as np
import pytest

from crownwork.llm import ngram_join
from crownwork.llm.components import components


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute(rows, percent=90):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {k: k for k in range(len(rows))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k][1]), least[find(k)]) for k, (i, _) in enumerate(rows))


def made(seed, groups=12, words=160):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 4, 12, 40, words]))]
        for _ in range(rng.choice([1, 3, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(50)}"
            if rng.random() < 0.2:
                t = t[: rng.randrange(len(t) + 1)]
            rows.append(" ".join(t))
    rows += ["", None, " \t\n", "Case A\x0bb", "case a b", "case a b", "É one two", "é one two", "one two", "ONE  two", "rep " * 40_000, "rep " * 9]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"family_docs": 4}), (3, {"family_docs": 4, "leaders": 1, "broadcast_bytes": 0}), (4, {"family_grams": 100}), (5, {"crowd": 1}), (6, {"crowd": 3, "broadcast_bytes": 0})])
def test_classes_against_brute_force(spark, seed, options):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 n", "2 node", "3 family", "4 first", "5 key").repartition(5)
    assert sorted(map(tuple, ngram_join.classed(df, **options).collect())) == brute(rows)


def variants(seed, copies, steps, words=460):
    """Two variants of a text, too far apart to be linked (12 words differ), in many copies of a word's change each; and
    for each of steps a text that has so many of the 12."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]

    def text(n, change=None):
        t = [f"v{k}" if k % 33 == 5 and k // 33 < n else w for k, w in enumerate(base)]
        if change is not None:
            t[33 * (change % 12) + 12 + change // 12] = f"own{change}"
        return " ".join(t)

    rows = [text(n, k) for n in (0, 12) for k in range(copies)] + [text(n) for n in steps]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("steps", [(6,), (4, 9), (3, 6, 9), ()])  # one row linked to both variants' leaders; rows of different leaders linked; a chain; none
def test_links_across_leaders_of_a_large_family(spark, steps):
    rows = variants(1, 150, steps)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute(rows)
    assert len({c for _, _, c in want}) == (1 if steps else 2)
    assert sorted(map(tuple, ngram_join.classed(df, family_docs=50).collect())) == want


def chain(n):
    """Each text is linked to the next one only."""
    return [" ".join(f"w{k}" for k in range(4 * i, 4 * i + 100)) for i in range(n)]


def stars(copies):
    """Copies of the first and of the last of four texts, each linked to the next, with another last word each."""
    texts = [[f"w{k}" for k in range(9 * i, 9 * i + 200)] for i in range(4)]
    return [" ".join(t) for t in texts] + [" ".join([*t[:-1], f"x{n}"]) for n, t in enumerate([*[texts[0]] * copies, *[texts[3]] * copies])]


@pytest.mark.parametrize("family_docs", [1, 4, 1500])
def test_chains_and_bridged_stars(spark, family_docs):
    for texts in (chain(24), stars(100)):
        rows = list(enumerate(random.Random(family_docs).sample(texts, len(texts))))
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        want = brute(rows)
        assert {c for _, _, c in want} == {0}
        assert sorted(map(tuple, ngram_join.classed(df, family_docs=family_docs).collect())) == want


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "q r s"), (3, "t u v"), (None, "a b c d")]
    got = sorted(map(tuple, ngram_join.classed(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3), (3, 1, 3), (None, 2, None)], key=str)
    assert ngram_join.classed(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("percent", [90, 80])
def test_leading_grams_lose_no_link(percent):
    rng = np.random.default_rng(0)
    level = rng.integers(0, 4, 1 << 22).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = x.copy()
        for _ in range(int(rng.integers(0, 40))):
            if rng.random() < 0.5 and len(y) > 2:
                y = np.delete(y, rng.integers(len(y)))
            else:
                y = np.unique(np.append(y, rng.integers(0, 2**63, 1).astype(np.uint64)))
        if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)):
            keys, sizes = ngram_join.leading_grams(np.concatenate([x, y]), np.array([len(x), len(y)]), percent, level)
            assert set(keys[: sizes[0]]) & set(keys[sizes[0] :])


def test_bit_strings_bound_the_difference():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.sort(rng.choice(pool, rng.integers(1, 900), replace=False)) for _ in range(60)]
    bits = ngram_join.parities(np.concatenate(sets), np.array([len(x) for x in sets]))
    raw = [np.frombuffer(x, np.uint8)[None] for x in bits]
    for k, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert ngram_join.differing(raw[k], raw[j])[0] <= len(np.setxor1d(a, b))
    assert all(len(x) * 8 >= 4 * len(a) for x, a in zip(bits, sets))


@pytest.mark.parametrize("percent", [90, 80])
def test_leaders_of_linked_sets_are_chained(percent):
    rng = np.random.default_rng(3)
    for n in (60, 500, 900):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sets = []
        for _ in range(80):  # sizes on both sides of a power of two, more and less alike
            own = rng.choice(base, int(n * rng.uniform(0.75, 1)), replace=False)
            sets.append(np.unique(np.append(own, rng.integers(0, 2**63, int(n * rng.uniform(0, 0.2))).astype(np.uint64))))
        size, bits = np.array([len(x) for x in sets]), ngram_join.parities(np.concatenate(sets), np.array([len(x) for x in sets]))
        lead = ngram_join.led(size, bits, percent)
        links = 0
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                    links += 1
                    assert lead[i] == lead[j] or lead[j] in ngram_join.near(size, bits, lead[i], np.array([lead[j]]), percent, 3)
        assert links
        far = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(40)]
        bits = ngram_join.parities(np.concatenate(far), np.array([len(x) for x in far]))
        assert sum(len(ngram_join.near(np.array([len(x) for x in far]), bits, i, np.arange(i + 1, 40), percent, 3)) for i in range(40)) < 40 * 39 / 2 * (0.2 if n == 60 else 0.02)  # few unrelated ones are


def test_sets_of_words():
    texts = ["", None, " \t\n", " a b  c\x0bD e ", "A b C d E", "x", "É a", "é a", "p q", "a b c"]
    hashes, counts = ngram_join.word_sets(texts, 3)
    assert counts.tolist() == [len(shingles(t)) for t in texts]
    sets = [tuple(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
    for k, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (sets[k] == sets[j]) == (shingles(a) == shingles(b))
    again, _ = ngram_join.word_sets(texts[3:], 3)
    assert (again == hashes).all()


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200)).astype(np.uint64)) for _ in range(60)]
    want = [[len(np.intersect1d(a, b)) for b in sets[:40]] for a in sets]
    for dense_from in (0, 24, 1000):
        assert (ngram_join.overlaps(sets, sets[:40], dense_from=dense_from, columns=64) == want).all()


def test_components(spark):
    chain = [(k, k + 1) for k in range(500)] + [(1000, 2000), (2000, 1000), (7000, 7000)] + [(3000, 3000 + k) for k in range(300)]
    edges = spark.createDataFrame(chain, "x bigint, y bigint")
    found = components(edges.selectExpr("xxhash64(x) a", "xxhash64(y) b"))
    name = edges.selectExpr("explode(array(x, y)) x").distinct().selectExpr("x", "xxhash64(x) node")
    got = {r["x"]: r["root"] for r in found.join(name, "node").collect()}
    assert len({got[k] for k in range(501)}) == 1 and got[1000] == got[2000] and len({got[3000 + k] for k in range(300)}) == 1 and len(set(got.values())) == 3


def test_one_ngram_in_common_makes_no_pair(spark, monkeypatch):
    rng, seen, plain = random.Random(8), [], ngram_join.stored
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [[word() for _ in range(3)] for _ in range(60)]
    rows = [(k, " ".join(w for part in (rng.sample(shared, 5) if k else shared[:5]) for w in [*part, *[word() for _ in range(4)]])) for k in range(300)]
    rows += [(400, rows[7][1] + " more"), (401, "a b c"), (402, "a b c d"), (403, "a b c d e")]

    def kept(df, *path):
        out = plain(df, *path)
        if out.columns == ["a", "b", "kind"] and not seen:
            seen.append(out.where(f"kind = {ngram_join.OPEN}").count())
        return out

    monkeypatch.setattr(ngram_join, "stored", kept)
    for percent in (50, 80):
        seen.clear()
        found = ngram_join.classed(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=percent)
        assert sorted(map(tuple, found.collect())) == brute(rows, percent)
        assert 0 < seen[0] < 300  # of some thousands that have an n-gram in common
