"""Language ID by word-first backoff.

A word that the training texts hold is scored by its log frequency in each language; another one by its longest
character n-grams that they hold, of ``longest`` characters, else of one fewer, down to single ones. A text's language
has the greatest sum over its words; its score is the mean, over the words, of that language's share in the word.

The model is fitted to a bounded sample: about ``per_language`` texts of each language, by a hash of doc_id. Of what the
sample holds, the ``most_words`` commonest words and as many n-grams are its parameters, so a worker's memory is bounded;
other words go by n-grams. Ties go to the language with more training texts, then to
the first by name. Texts without a letter, and null ones, are ``und`` with score 0; so are all if nothing was learned.
A text none of whose letters was seen in training gets the language with most training texts, at an even score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept as in_worker
from .common import small_batches, stored
from .words import WordRows, words_of


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


class Scorer:
    """Rows of a word: its log frequency in each language, then each language's share."""

    def __init__(self, model: dict):
        self.languages, self.prior = model["languages"], np.array(model["docs"], float)
        self.longest = model["longest"]
        self.words = {w: k for k, w in enumerate(model["words"])}
        self.grams = {g: k for k, g in enumerate(model["grams"])}
        self.word_logs, self.gram_logs = (self._logs(model[k]) for k in ("word_counts", "gram_counts"))
        self.rows = WordRows(self.of, 2 * len(self.languages))

    def _logs(self, counts: list) -> np.ndarray:
        n = np.array(counts, float).reshape(-1, len(self.languages)) + 0.5
        return np.log(n / n.sum(0)) if len(n) else n

    def of(self, words: list[str]) -> np.ndarray:
        logs = np.zeros((len(words), len(self.languages)))
        for k, w in enumerate(words):
            if (i := self.words.get(w)) is not None:
                logs[k] = self.word_logs[i]
                continue
            marked = f"^{w}$"
            for n in range(min(self.longest, len(marked)), 0, -1):
                found = [i for j in range(len(marked) - n + 1) if (i := self.grams.get(marked[j : j + n])) is not None]
                if found:
                    logs[k] = self.gram_logs[found].mean(0)
                    break
        share = np.exp(logs - logs.max(1, keepdims=True))
        return np.hstack([logs, share / share.sum(1, keepdims=True)])

    def predict(self, texts: list[str | None]):
        k = len(self.languages)
        for counts, sums in self.rows.sums(texts):
            logs = sums[:, :k] - sums[:, :k].max(1, keepdims=True)
            best = np.lexsort((np.broadcast_to(np.arange(k), logs.shape), np.broadcast_to(-self.prior, logs.shape), -logs.round(9)), axis=1)[:, 0]
            score = np.take_along_axis(sums[:, k:], best[:, None], 1)[:, 0] / np.maximum(counts, 1)
            yield [(self.languages[b], float(min(1, s))) if n else ("und", 0.0) for b, s, n in zip(best, score, counts)]


def _counted(batches):
    """The words of a batch by language, cut as for a prediction, with their numbers."""
    for b in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text.lower()))
        rows = [(lang, w, n) for lang, own in counts.items() for w, n in own.items()]
        kinds = (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lang", "w", "n"])


def fit(docs: DataFrame, per_language: int = 5000, most_words: int = 150_000, longest: int = 5, least: int = 2) -> dict:
    """A model from docs(doc_id, text, lang): rows with text and lang. ``least``: counts below it are left out."""
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    model = {"languages": languages, "docs": [sizes[x] for x in languages], "longest": longest, "words": [], "grams": [], "word_counts": [], "gram_counts": []}
    if not languages:
        return model
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(min(1, per_language / sizes[lang]) * (1 << 30)))])
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")])
    counted = small_batches(some.select("lang", F.col("text").cast("string").alias("text"))).mapInArrow(_counted, "lang string, w string, n bigint")
    words = stored(counted.groupBy("lang", "w").agg(F.sum("n").alias("n")))
    marked = F.concat(F.lit("^"), "w", F.lit("$"))
    each = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1))), lambda j: F.substring(marked, j, n))))
    grams = words.select("lang", F.explode(each).alias("w"), "n").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    for name, table in (("word", words), ("gram", grams)):
        wide = table.groupBy("w").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(languages)], F.sum("n").alias("total"))
        kept = wide.where(F.col("total") >= least).orderBy(F.desc("total"), "w").limit(most_words).toPandas()
        model[f"{name}s"] = kept["w"].tolist()
        model[f"{name}_counts"] = kept[[f"n{k}" for k in range(len(languages))]].to_numpy(np.int64)
    return model


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), nested: bool = False) -> DataFrame:
    """The columns ``keep`` of docs (nested: as a struct, ``kept``) with lang_pred and score. Only text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: most_words words and n-grams
    taken = small_batches(docs.select(F.col("text").cast("string").alias("text"), F.struct(*keep).alias("kept")))

    def run(batches):
        model = sent.value
        scorer = in_worker(("languages", id(model)), lambda: (Scorer(model), model))[0] if model["languages"] else None
        for b in batches:
            texts = b.column(0).to_pylist()
            out = [x for some in scorer.predict(texts) for x in some] if scorer else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["kept", "lang_pred", "score"])

    schema = T.StructType([taken.schema["kept"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = taken.mapInArrow(run, schema)
    return found if nested else found.select("kept.*", "lang_pred", "score")


def identified(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of docs(doc_id, text, lang); learned from those that are not held out.

    A null doc_id counts as empty text for the fold. Repeated rows are predicted alike, each in its own row."""
    taken = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    taken = taken.withColumn("held_out", held_out(F.col("doc_id")))
    return predict(taken, fit(taken.where(~F.col("held_out")), **options), ("doc_id", "held_out"))
