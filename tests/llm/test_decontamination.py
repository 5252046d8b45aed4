import random

import numpy as np
import pytest

from crownwork.llm import decontamination, queries

W, E = 40, 2


def windows_within(item, doc, w=W, e=E):
    """Whether some w characters of item are within e edits of a part of doc (Sellers), and where those windows start."""
    out = []
    for y in range(len(item) - w + 1):
        col = list(range(w + 1))
        best = w
        for c in doc:
            new = [0]
            for i in range(1, w + 1):
                new.append(min(col[i - 1] + (item[y + i - 1] != c), col[i] + 1, new[i - 1] + 1))
            col = new
            best = min(best, col[w])
        if best <= e:
            out.append(y)
    return out


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        what = rng.choice("ids")
        if what == "i":
            t.insert(k, rng.choice("xyz"))
        elif what == "d" and len(t) > 1:
            del t[k]
        else:
            t[k] = rng.choice("xyz")
    return "".join(t)


@pytest.mark.parametrize("seed", range(6))
def test_windows_against_sellers(seed):
    rng = random.Random(seed)
    words = ["the", "of", "thing", "and", "stone", "river", "é"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.choice([10, 14, 20]))) for k in range(4)]
    index = decontamination.Index(items, W, E)
    docs = []
    for _ in range(8):
        item = rng.choice(items)[1]
        a = rng.randrange(len(item) // 3)
        docs.append(text(6) + " " + edited(rng, item[a:], rng.choice([0, 1, 3, 6])) + " " + text(6) if rng.random() < 0.8 else text(20))
    found = index.found([decontamination.normal(d) for d in docs])
    for k, d in enumerate(docs):
        for i, t in items:
            want = windows_within(decontamination.normal(t), decontamination.normal(d))
            got = [r for r in found if r[:2] == (k, i)]
            assert bool(want) == bool(got)
            if want:
                assert min(want) == min(r[4] for r in got) and max(want) + W == max(r[5] for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_short_items_against_sellers(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["the", "of", "thing", "and", "stone", "river", "é"]) for _ in range(n))
    items = [(k, text(40)[:n].strip().ljust(n, "q")) for k, n in enumerate([20, 25, 39, 40, 59, 60, 79])]
    index = decontamination.Benchmark(items, 80, 4)
    docs = [text(9) + " " + edited(rng, t, n) + " " + text(9) for _, t in items for n in (0, 1, 2, 3, 5)]
    found = {r[:2] for r in index.found([decontamination.normal(d) for d in docs])}
    for k, d in enumerate(docs):
        for i, t in items:
            assert ((k, i) in found) == bool(windows_within(t, decontamination.normal(d), len(t), 4 * len(t) // 80))


def test_tiny_items_are_whole_words():
    index = decontamination.Benchmark([(1, "Yes"), (2, "a"), (3, "(b)"), (4, "北京")], 80, 4)
    got = index.found(["yesterday eyes a", "oh yes, yes!", "x(b)y", "在北京市", "yes"])
    assert sorted(r[:4] for r in got) == [(0, 2, 15, 16), (1, 1, 3, 6), (1, 1, 8, 11), (2, 3, 1, 4), (3, 4, 1, 3), (4, 1, 0, 3)]


def test_aligned_band():
    p = np.frombuffer(b"abcdefghij", np.uint8)[None]
    t = np.frombuffer(b"zabcdXefghijzz", np.uint8)[None]
    edits, end = decontamination.aligned(p, t)
    assert edits[0] == 1 and end[0] == 12


def test_edge_cases(spark):
    item = "Which of these rivers flows\n through the city that was the capital of two kingdoms in turn?"
    rows = [(1, "x " + item.upper().replace(" ", "  ") + " y"), (2, None), (3, ""), (4, "clean text " * 50_000), (5, item), (5, item), (None, item), (6, item.replace("city", "town")), (7, "a short item"), (8, item[:60]), (9, item + " and again " + item)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 item_id", "2 doc_start", "3 edits")
    bench = spark.createDataFrame([(1, item), (2, "Short Item"), (3, None), (4, ""), (5, "q")], "item_id bigint, text string").selectExpr("*", "1 doc_id")
    got = decontamination.contaminated(docs, bench).collect()
    ids = sorted((r["doc_id"] or 0, r["item_id"]) for r in got if r["item_id"] != 5)
    assert ids == [(0, 1), (1, 1), (5, 1), (5, 1), (6, 1), (7, 2), (9, 1), (9, 1)]
    one = next(r for r in got if r["doc_id"] == 1 and r["item_id"] == 1)
    text = decontamination.normal(rows[0][1])
    assert text[one["doc_start"] : one["doc_end"]] == decontamination.normal(item) and one["edits"] == 0
    assert decontamination.contaminated(docs.limit(0), bench).collect() == [] and decontamination.contaminated(docs, bench.limit(0)).collect() == []
    parted = decontamination.contaminated(docs, bench, part_chars=20).collect()
    assert sorted(parted, key=str) == sorted(got, key=str)


def test_all_whole_items_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: decontamination.normal(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: decontamination.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, x in docs.items() for i, t in items.items() if t in x}
    got = queries.op6_decontamination(spark, sf).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in got} and want
    for r in got:  # every region holds a window of the item
        part = docs[r["doc_id"]][max(0, r["doc_start"] - 4) : r["doc_end"] + 4]
        item = items[r["item_id"]][r["item_start"] : r["item_end"]]
        assert item in part or windows_within(item[:90], part, 80, 4) or windows_within(item[-90:], part, 80, 4)
