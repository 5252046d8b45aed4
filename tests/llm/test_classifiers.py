import zlib

import numpy as np
import pytest

from crownwork.llm import langid, queries, toxicity
from crownwork.llm.words import words_of

SF = "/root/testdata/sf0.01"


def plain_word(model, word):
    """Log frequencies of a word by the definition."""
    k = len(model["languages"])

    def logs(counts, i):
        n = [[x + 0.5 for x in row] for row in counts]
        return [np.log(n[i][j] / sum(row[j] for row in n)) for j in range(k)]

    if word in model["words"]:
        return logs(model["word_counts"].tolist(), model["words"].index(word))
    w = f"^{word}$"
    for n in range(model["longest"], 0, -1):
        found = [model["grams"].index(w[j : j + n]) for j in range(len(w) - n + 1) if w[j : j + n] in model["grams"]]
        if found:
            return np.mean([logs(model["gram_counts"].tolist(), i) for i in found], axis=0).tolist()
    return [0.0] * k


def test_language_scores_by_definition(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de"), ("der der die", "de")])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), least=1)
    scorer = langid.Scorer(model)
    for word in ("the", "cat", "unds", "xqq", "katzen", "中"):
        assert np.allclose(scorer.of([word])[0, :3], plain_word(model, word), atol=1e-5)
    assert scorer.rows.table.dtype == np.float32


def test_words_are_letters_with_their_marks():
    import regex

    texts = ["½ ² ³ x² Ⅷ ①", "हिन्दी में", "naïve cafe\u0301 \u0301x", "中文 русский", "a1b_c-d", "\U00010400\U00010428 x", "", "ªº", "x\u200dy"]
    for t in texts:
        assert words_of(t) == regex.findall(r"\p{L}[\p{L}\p{M}]*", t), t
    assert words_of(None) == []


def test_ties_of_languages(spark):
    rows = [(1, "aa", "fr"), (3, "bb", "en"), (4, "aa bb", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), least=1)).collect()}
    assert got[4] == "en"  # as many training texts, as likely: the first by name


def test_language_edge_cases(spark):
    rows = [(1, "the the cat", "en"), (3, "le le chat", "fr"), (4, None, "fr"), (5, "", None), (6, "123 !?", "en"), (7, "中文", None), (7, "中文", None), (None, "the", None), (9, "the " * 200_000, "fr"), (10, "½ ² ³ Ⅷ ①", None), (11, "हिन्दी में है", "hi"), (15, "हिन्दी", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 held_out", "2 score", "3 kept")
    got = langid.identified(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (4, 5, 6, 10))
    assert by[15]["lang_pred"] == "hi"
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert by[7]["lang_pred"] in ("en", "fr", "hi")
    assert langid.identified(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in langid.identified(df.withColumn("lang", df["lang"].substr(9, 1).cast("string")).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_language_accuracy_on_held_out(spark):
    got = queries.op4_language_id(spark, SF)
    true = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = [r for r in got.join(true, "doc_id").collect() if r["held_out"] and r["lang"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_thresholds_share_weights():
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.uniform(0, 4, n)
    latent = 1.5 * x + rng.logistic(size=n)
    grade = (latent > 2).astype(int) + (latent > 5)
    w, t = toxicity._fit(np.arange(n), np.zeros(n, int), x, grade, 1, 2, 1500, 0.0)
    assert np.allclose([w[0], *t], [1.5, 2, 5], atol=0.4) and t[0] < t[1]

    def loss(w, t):
        below = 1 / (1 + np.exp(-(np.array(t)[None] - w * x[:, None])))
        full = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        return -np.log(full[np.arange(n), grade + 1] - full[np.arange(n), grade]).mean()

    best = loss(w[0], t)
    for step in (-0.02, 0.02):
        assert best <= loss(w[0] + step, t) + 1e-6 and best <= loss(w[0], [t[0] + step, t[1]]) + 1e-6 and best <= loss(w[0], [t[0], t[1] + step]) + 1e-6


def test_expected_severity_by_definition():
    model = {"features": ["bad", "aw*"], "weights": np.array([0.4, 0.2]), "thresholds": np.array([1.0, 3.0])}
    (e, top, over), *_ = list(toxicity.Scorer(model).score(["bad awful fine", None, ""]))
    s = 100 / (3 + toxicity.SHORT) * 0.4
    p = [1 / (1 + np.exp(-(t - s))) for t in (1.0, 3.0)]
    assert np.isclose(e[0], (p[1] - p[0]) + 2 * (1 - p[1])) and np.isclose(over[0], 1 - p[0]) and e[1] == e[2] and top[1] == 0


def test_toxicity_edge_cases(spark):
    rows = [(i, "you idiot " * 3 if i % 3 == 0 else "fine words here", None) for i in range(60)] + [(70, None, None), (71, "", None), (5, "fine words here", None), (None, "x", None), (72, "fine words here " * 100_000, None), (73, "you idiot " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string").selectExpr("*", "1 grade", "2 n", "3 f")
    labels = spark.createDataFrame([(i, 1 if i % 6 else 0, int(i % 3 == 0)) for i in range(60)] + [(0, None, None), (3, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(toxicity.severity_labels(docs, labels))
    got = toxicity.graded(docs, model).collect()
    assert len(got) == len(rows) and all(r["toxic"] == (r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    long = {r["doc_id"]: r["toxic"] for r in got}
    assert not long[72] and long[73]
    none = toxicity.fit(toxicity.severity_labels(docs, labels.limit(0)))
    assert {r["expected_severity"] for r in toxicity.graded(docs, none).collect()} == {0.0}
    assert toxicity.graded(docs.limit(0), model).collect() == []


def test_toxicity_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic_chance", "doc_id").collect()
    true = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    hit = [r["toxic_chance"] >= 0.5 for r in got if true[r["doc_id"]]]
    wrong = [r["toxic_chance"] >= 0.5 for r in got if not true[r["doc_id"]]]
    assert np.mean(hit) > 0.85 and np.mean(wrong) < 0.02
