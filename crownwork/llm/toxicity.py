"""Toxicity by cumulative-link ordinal regression.

Grades are whole numbers from 0, in order of severity: P(grade <= k) = 1 / (1 + exp(w.x - t_k)) with one weight vector w
for all thresholds t_0 < t_1 < ... Features are sparse: how many of 100 words of the text are a given word, or begin
with given 3 to 7 characters (of words and SHORT). Features are chosen in the sample: the ``most_features`` that tell its
grades apart best (chi-square over documents), of those that at least ``least`` documents hold.
A text's result is its expected grade, its likeliest grade and the chance that its grade is over 0.

The model is fitted on the driver to a bounded sample of labelled rows: about ``sample`` of them, by a hash of doc_id,
and the tables that choose the features come from that sample. Null texts, and those without a word, have no features,
so they get the grade that the thresholds give at 0. Without labelled rows every expected grade is 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept as in_worker
from .common import small_batches, stored
from .words import WordRows, words_of

SHORT = 20  # words added to each text's number of words, so that one word of a short text doesn't outweigh all else


def features(word: str) -> list[str]:
    """The word, and its beginnings of 3 to 7 characters."""
    return [word, *(f"{word[:n]}*" for n in range(3, min(7, len(word) - 1) + 1))]


def _featured(batches):
    for b in batches:
        texts, found, counts, n = b.column(1).to_pylist(), [], [], []
        for t in texts:
            words = Counter(words_of(t.lower()))
            both: Counter = Counter()
            for w, k in words.items():
                for f in features(w):
                    both[f] += k
            n.append(words.total())
            found.append(list(both))
            counts.append(list(both.values()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int32()), pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "grade", "n", "f", "c"])


def _chosen(names: list[str]):
    """Numbers and values of a document's features among the chosen ones."""
    number = {f: k for k, f in enumerate(names)}

    def run(batches):
        for b in batches:
            cols, values = [], []
            for n, found, counts in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                hits = sorted((number[f], 100 * c / (n + SHORT)) for f, c in zip(found, counts) if f in number)
                cols.append([h[0] for h in hits])
                values.append([h[1] for h in hits])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "grade", "col", "value"])

    return run


def fit(labelled: DataFrame, sample: int = 6000, most_features: int = 2000, least: int = 5, rounds: int = 400, l2: float = 2e-3) -> dict:
    """labelled: doc_id, text, grade (whole numbers from 0; null rows are left out)."""
    known = labelled.where("text is not null and grade is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("grade").cast("int").alias("grade")).dropDuplicates(["doc_id"])
    size, most = known.agg(F.count("*"), F.max("grade")).first()
    if not size:
        return {"features": [], "weights": np.zeros(0), "thresholds": np.zeros(0)}
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(min(1, sample / size) * (1 << 30)))
    some = stored(some.mapInArrow(_featured, "doc_id bigint, grade int, n int, f array<string>, c array<int>"))
    rows = some.select("doc_id", "grade", F.explode(F.arrays_zip("f", "c")).alias("x")).select("doc_id", "grade", "x.f", "x.c")
    # chi-square of a feature against "grade over 0", over the documents of the sample
    n_docs, n_over = some.agg(F.count("*"), F.sum((F.col("grade") > 0).cast("int"))).first()
    by = rows.groupBy("f").agg(F.count("*").alias("docs"), F.sum((F.col("grade") > 0).cast("int")).alias("over")).where(F.col("docs") >= least)
    expected = F.col("docs") * F.lit((n_over or 0) / max(n_docs, 1))
    best = by.withColumn("chi", (F.col("over") - expected) ** 2 / F.greatest(expected, F.lit(1e-9))).orderBy(F.desc("chi"), "f").limit(most_features)
    names = [r["f"] for r in best.select("f").collect()]
    kept = some.mapInArrow(_chosen(names), "doc_id bigint, grade int, col array<int>, value array<double>").toPandas().drop_duplicates("doc_id")  # a row a document of the sample
    sizes = kept["col"].map(len).to_numpy()
    row = np.repeat(np.arange(len(kept)), sizes)
    col, value = (np.concatenate([np.zeros(0), *kept[c]]) for c in ("col", "value"))
    w, t = _fit(row, col.astype(np.int64), value, kept["grade"].to_numpy(), len(names), int(most), rounds, l2)
    return {"features": names, "weights": w, "thresholds": t}


def _fit(row, col, value, grade, n_features, top, rounds, l2):
    """Adam on the mean negative log-likelihood; thresholds are a first one and logs of the steps to the next."""
    if top < 1:
        return np.zeros(n_features), np.zeros(0)
    n = len(grade)
    params = np.zeros(n_features + top)
    share = np.clip([(grade <= k).mean() for k in range(top)], 0.01, 0.99)
    start = np.log(share / (1 - share))
    params[n_features] = start[0]
    params[n_features + 1 :] = np.log(np.maximum(np.diff(start), 0.05))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, rounds + 1):
        w, steps = params[:n_features], np.exp(params[n_features + 1 :])
        t = params[n_features] + np.concatenate([[0], np.cumsum(steps)])
        s = np.bincount(row, weights=value * w[col], minlength=n)
        below = 1 / (1 + np.exp(-np.clip(t[None, :] - s[:, None], -40, 40)))
        full = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        slope = full * (1 - full)
        hi, lo = full[np.arange(n), grade + 1], full[np.arange(n), grade]
        dhi, dlo = slope[np.arange(n), grade + 1], slope[np.arange(n), grade]
        p = np.maximum(hi - lo, 1e-9)
        ds = (dhi - dlo) / p / n
        g = np.zeros_like(params)
        g[:n_features] = np.bincount(col, weights=value * ds[row], minlength=n_features) + l2 * w
        dt = np.zeros(top)
        np.add.at(dt, np.minimum(grade, top - 1), np.where(grade < top, -dhi / p / n, 0))
        np.add.at(dt, np.maximum(grade - 1, 0), np.where(grade > 0, dlo / p / n, 0))
        tail = np.cumsum(dt[::-1])[::-1]
        g[n_features] = tail[0]
        g[n_features + 1 :] = tail[1:] * steps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return params[:n_features], params[n_features] + np.concatenate([[0], np.cumsum(np.exp(params[n_features + 1 :]))])


class Scorer:
    def __init__(self, model: dict):
        self.weight = dict(zip(model["features"], np.asarray(model["weights"]).tolist()))
        self.thresholds = np.asarray(model["thresholds"], float)
        self.rows = WordRows(self.of, 1)

    def of(self, words: list[str]) -> np.ndarray:
        return np.array([[sum(self.weight.get(f, 0.0) for f in features(w))] for w in words])

    def score(self, texts: list[str | None]):
        """Expected grade, likeliest grade, chance of a grade over 0."""
        for counts, sums in self.rows.sums(texts):
            s = 100 * sums[:, 0] / (counts + SHORT)
            below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - s[:, None], -40, 40)))
            full = np.hstack([np.zeros((len(s), 1)), below, np.ones((len(s), 1))])
            chance = np.diff(full, axis=1)
            over = 1 - below[:, 0] if below.shape[1] else np.zeros(len(s))
            yield chance @ np.arange(chance.shape[1]), chance.argmax(1), over


def graded(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, expected_severity, severity, toxic_chance, toxic (chance of at least 1/2) of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: most_features features
    taken = small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))

    def run(batches):
        model = sent.value
        scorer = in_worker(("severity", id(model)), lambda: (Scorer(model), model))[0]
        for b in batches:
            parts = list(scorer.score(b.column(1).to_pylist()))
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1].astype(np.int32)), pa.array(cols[2], pa.float64()), pa.array(cols[2] >= 0.5)],
                ["doc_id", "expected_severity", "severity", "toxic_chance", "toxic"],
            )

    return taken.mapInArrow(run, "doc_id bigint, expected_severity double, severity int, toxic_chance double, toxic boolean")


def severity_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, grade: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in one of poor quality.

    Repeated labels of a document give its highest grade."""
    toxic, poor = F.col("toxic") == 1, F.coalesce(F.col("quality") == 0, F.lit(False))
    grade = F.when(toxic & poor, 2).when(toxic, 1).when(F.col("toxic") == 0, 0)
    of = labels.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.max("grade").alias("grade")).where("grade is not null")
    return docs.select("doc_id", "text").join(of, "doc_id")
