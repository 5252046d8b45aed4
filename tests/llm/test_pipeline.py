import hashlib
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from crownwork.llm import decontamination, queries
from tests.llm.test_ngram_join import shingles
from tests.llm.test_suffix_dedup import brute as cut_of

SF = "/root/testdata/sf0.001"


def classes(rows, size=5, percent=80):
    """The least doc_id of each document's class, by the definition."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in sets}


def check_stages(spark, docs, sf_dir):
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    def after(name, df):
        out = corpus_pipeline.stored(stages[name](spark, df, sf_dir))
        if name != "best-fit packing":
            assert out.columns == columns and out.dtypes == df.dtypes
        return out

    one = after("language ID", docs)
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    two = after("n-gram Jaccard join", one)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(set(classes(rows).values()))
    rows = [(r["doc_id"], r["text"]) for r in two.collect()]
    want = {i: (n - gone, sha) for i, n, gone, _, sha in cut_of(rows, 100) if n != gone or not n}
    three = after("suffix-array dedup", two)
    got = {r["doc_id"]: r["text"] for r in three.collect()}
    assert set(got) == set(want)
    texts = dict(rows)
    for i, t in got.items():
        if hashlib.sha256(t.encode()).hexdigest() != want[i][1]:  # a cut inside a character loses the rest of it
            assert want[i][0] - 6 * (len(texts[i].encode()) // 100 + 1) <= len(t.encode()) < want[i][0] and not texts[i].isascii()
    four = after("benchmark decontamination", three)
    items = [decontamination.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r["doc_id"]: decontamination.normal(r["text"]) for r in four.collect()}
    assert not any(t in x for x in left.values() for t in items)
    gone = [decontamination.normal(t) for i, t in got.items() if i not in left]
    assert all(any(t[k : k + 20] in x for t in items for k in range(0, len(t) - 19)) for x in gone)
    five = after("best-fit packing", four).collect()
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in four.collect()}
    by_doc, by_bin = {}, {}
    for r in five:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert set(by_doc) == set(left)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == [sum(r["length"] for r in parts[:k]) for k in range(len(parts))] and sum(r["length"] for r in parts) == len(ids[i])
    for parts in by_bin.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    return {r["doc_id"] for r in five}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(check_stages(spark, docs, SF)) > 0.8 * docs.count()


def test_long_texts_ties_and_runs_as_one(spark, tmp_path):
    """Very long texts, near copies as like to two others, equal texts under several ids; and run() gives what its stages give."""
    own = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null").orderBy("doc_id").limit(60).collect()
    words = own[5]["text"].split()
    rows = [tuple(r) for r in own] + [
        (9001, " ".join(r["text"] for r in own for _ in range(4)), own[0]["lang"], "s", 0), (9002, own[7]["text"], own[7]["lang"], "s", 0), (9003, own[7]["text"], own[7]["lang"], "t", 0),
        (9004, " ".join(["new", *words[1:]]), own[5]["lang"], "s", 0), (9005, " ".join([*words[:-1], "last"]), own[5]["lang"], "s", 0), (9006, "word " * 200_000, own[0]["lang"], "s", 0),
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = check_stages(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert not {9002, 9003} & kept
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept


def test_near_copies_by_five_words(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(1, words), (2, [f"x{k}" if k in (20, 60, 100, 140) else w for k, w in enumerate(words)])]  # J of 5 words 0.815, of 3 words 0.886
    rows += [(3, [f"a{k}" for k in range(100)]), (4, [f"a{k}" for k in range(90)] + [f"b{k}" for k in range(10)]), (5, [f"a{k}" for k in range(75)])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "a", 1) for i, w in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")

    def brute(words):
        grams = [{tuple(w[k : k + words]) for k in range(len(w) - words + 1)} for _, w in rows]
        return [(a + 1, b + 1) for b in range(5) for a in range(b) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]

    assert brute(5) == [(1, 2), (3, 4)]
    got = corpus_pipeline.ngram_join(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 5]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], shingles(r["text"], 5)) for r in docs.collect())
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    least = {i: i for i, _ in rows}
    for _ in rows:
        least |= {i: min([least[i], *[least[a + b - i] for a, b in pairs if i in (a, b)]]) for i in least}
    got = corpus_pipeline.ngram_join(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(least.values()))


def test_odd_rows(spark):
    text = "der hund und die katze sind in dem haus und die maus ist nicht da " * 3
    rows = [(1, text, "de", "a", 1), (1, text, "de", "a", 1), (2, text, None, None, None), (3, None, "de", "a", 0), (4, "", "de", "a", 0), (None, "die katze und der hund", "de", "a", 1), (5, "123", "de", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "'x' lang_pred", "1 rows", "2 bad", "3 kept", "4 left", "5 ord", "6 score", "7 `odd name:`")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1]
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []
