import math
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crownwork.llm import ann, licenses, queries, urls


def test_hilbert_visits_all_cells_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        axes = np.indices([1 << bits] * dims).reshape(dims, -1).T
        keys = ann.hilbert_keys(axes, bits)
        assert sorted(keys) == list(range(len(axes)))
        assert (np.abs(np.diff(axes[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def brute(rows, k, every):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    for q, x in ok:
        if q % every == 0:
            near = sorted((-(x * y).sum(), i) for i, y in ok if i != q)[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_nearest_small_table_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(200)]
    same = rng.normal(size=5).astype(np.float32).tolist()
    rows += [(i, same) for i in range(200, 300)]
    rows += [(400, None), (401, [0.0] * 5), (402, [1.0, None, 0.0, 0.0, 0.0]), (403, [1.0, float("nan"), 0.0, 0.0, 0.0]), (404, [float("inf")] * 5), (None, same), (405, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 gid", "2 rank", "3 score", "'x' query_id")
    got = {}
    for r in ann.nearest(df, k=7, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows[:-1], 7, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], want[q]))
    assert ann.nearest(df.limit(0)).collect() == []
    assert sorted(r["vec_id"] for r in ann.nearest(df.where("vec_id < 4 or vec_id = 400")).collect()) == [1, 2, 3]


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, float(i)]) for i in range(600)] + [(700, [1.0, 1.0]), (701, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for options in ({}, {"block": 64}):
        got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, **options).where("query_id = 0").orderBy("rank").collect()]
        assert got[0][2] == 1.0 and [g[0] for g in got] == list(range(1, 21)) and all(g[2] == 1.0 for g in got)
        if not options:  # all rows are in one block
            assert [g[1] for g in got] == list(range(1, 21))


def recall_of(spark, table, x, ids, queries_checked, **options):
    got = {}
    for r in ann.nearest(table, **options).select("query_id", "vec_id").toPandas().itertuples():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    place = {int(i): k for k, i in enumerate(ids)}
    hit = 0
    for q in queries_checked:
        s = x @ x[place[q]]
        s[place[q]] = -np.inf
        hit += len(set(ids[np.argpartition(-s, 20)[:20]].tolist()) & got[q])
    return hit / (20 * len(queries_checked))


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    assert recall_of(spark, table, x, ids, ids[ids % 20 == 0].tolist(), block=128) >= 0.9  # blocks much smaller than the table, as at scale


def test_recall_of_many_vectors_as_registered(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 100_000
    centres = rng.normal(size=(2000, 32))
    x = np.where(np.arange(n)[:, None] % 2 == 0, rng.normal(size=(n, 32)), centres[rng.integers(0, 2000, n)] + 0.3 * rng.normal(size=(n, 32))).astype(np.float32)
    ids = rng.permutation(n)
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "e.parquet", row_group_size=20_000)
    asked = rng.choice(ids[ids % 20 == 0], 300, replace=False).tolist()
    assert recall_of(spark, spark.read.parquet(str(tmp_path / "e.parquet")), x.astype(float), ids, asked) >= 0.9


URLS = [
    "http://example.org/es/1", "https://a.EXAMPLE.org/en/12", "http://b.org/x", "http://b.org", "ftp://x.com/fr/?q=1&b=2", "http://x.com/de/1#f", "http://xcom/fr/1",
    "http://x.net/a-b/c?x=1&y=22", "nothing", "", None, "a://b://c/d", "HTTP://É.ORG/Ü?x", "http://x.net\n/a\nb", "http://u@h.com:80/fr/", "http://notexample.org/es/1", "http://x.com/de/2", "http://x.net/" + "9" * 50000, "http://b.org/x",
]


def by_hand(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    best = None
    for _, rule in queries.URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_every_suffix_has_its_share(spark, broadcast_bytes):
    rows = [(n, f"https://www.site{n % 1500}.org/{n % 2900}", f"site{n % 1500}.org", float(n % 1500 % 3 == 0)) for n in range(3000)]
    rows += [(9000, "https://new.org/", "new.org", None), (9001, "https://site3.org/", "site3.org", None)]
    found = spark.createDataFrame(rows, "page_id bigint, url string, label_2 string, block double")
    got = {r["page_id"]: r["suffix_2"] for r in urls.with_shares(found, found.where("block is not null"), "label_2", 0.25, broadcast_bytes).collect()}
    assert len(got) == 3002 and got[9000] == 0.25 and math.isclose(got[9001], (2 + 5 * 0.25) / 7)
    fold = {r["page_id"]: r["f"] for r in found.selectExpr("page_id", f"pmod(xxhash64(url, 11), {urls.FOLDS}) f").collect()}
    for n, _, suffix, b in rows[:3000]:  # what the URLs of the other folds say
        others = [r[3] for r in (rows[n % 1500], rows[n % 1500 + 1500]) if fold[r[0]] != fold[n]]
        assert math.isclose(got[n], (sum(others) + 5 * 0.25) / (len(others) + 5))


def test_unique_hosts_teach_nothing_of_their_own_label(spark):
    """Each host is seen once, so its share is everybody's: trees that saw their own labels would go by the host."""
    rows = [(i, f"http://h{i}.com/{'de' if i % 2 else 'fr'}/a") for i in range(600)]
    own = urls.lexical(urls.parsed(spark.createDataFrame(rows, "page_id bigint, url string"))).withColumn("block", (F.col("page_id") % 2).cast("double"))
    shares = urls.with_shares(own, own, "label_2", 0.5, 1 << 20).select("suffix_2").distinct().collect()
    assert [r["suffix_2"] for r in shares] == [0.5]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").selectExpr("*", "1 host", "2 path", "3 rule", "4 block", "5 label_1")
    got = {r["page_id"]: r for r in urls.judged(df, queries.URL_RULES).collect()}
    action = {rule: a for a, rule in queries.URL_RULES}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        host, path, rule = by_hand(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] in ("allow", "block") and (rule is None or got[k]["verdict"] == action[rule])
    assert urls.judged(df.limit(0), queries.URL_RULES).collect() == []
    assert {r["verdict"] for r in urls.judged(df, []).collect()} == {"allow"}


def test_lexical_features(spark):
    df = urls.lexical(urls.parsed(spark.createDataFrame([(u,) for u in URLS], "url string")))
    for r in df.collect():
        u = r["url"] or ""
        p = [c / len(u) for c in Counter(u).values()]
        assert math.isclose(r["entropy"], -sum(x * math.log2(x) for x in p), abs_tol=1e-9)
        assert r["url_length"] == len(u) and math.isclose(r["digit_ratio"], sum(c in "0123456789" for c in u) / max(len(u), 1))
        query = u.split("#")[0].partition("?")[2]
        assert r["parameters"] == (query.count("&") + 1 if query else 0) and r["depth"] == r["path"].count("/")


def test_trees_learn(spark):
    rows = [(i, f"http://s{i % 7}.site.com/de/{'9' * (i % 5 + 3)}" if i % 2 else f"http://s{i % 7}.site.com/fr/words") for i in range(400)]
    rows += [(1000 + i, f"http://t.other.net/x/{'9' * (i % 5 + 3)}") for i in range(20)] + [(2000 + i, "http://t.other.net/words") for i in range(20)]
    got = urls.judged(spark.createDataFrame(rows, "page_id bigint, url string"), queries.URL_RULES).where("page_id >= 1000").collect()
    assert all(r["verdict"] == ("block" if r["page_id"] < 2000 else "allow") for r in got)


def best_parts(text, least=0.8):
    """By license: the best part and its line, from all parts that the definition names."""
    best = {}
    words, line_of = [], []
    for k, part in enumerate(text.split("\n")):
        own = licenses.template_words(part)
        words += own
        line_of += [k + 1] * len(own)
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    for name, template in licenses.TEMPLATES:
        b = set(licenses.bigrams_of(template))
        parts = [(0, set(grams)), *((k + 1, set(licenses.bigrams_of(part))) for k, part in enumerate(text.split("\n")))]
        lengths, n = [math.ceil(len(b) * least / (2 - least) - 1e-9)], 0
        while lengths[-1] < int(len(b) * (2 - least) / least + 1e-9):
            lengths.append(min(max(lengths[-1] + 1, math.ceil(lengths[-1] * 1.1)), int(len(b) * (2 - least) / least + 1e-9)))
        parts += [(line_of[k], set(grams[k : k + n])) for k, g in enumerate(grams) if g in b for n in {*lengths, len(licenses.template_words(template)) - 1}]
        for line, a in parts:
            d = 2 * len(a & b) / (len(a) + len(b))
            if d >= least:
                best[name] = max(best.get(name, (0, 0)), (round(d, 6), -line))
    return {name: (-line, d) for name, (d, line) in best.items()}


def test_licenses(spark):
    apache, mit = licenses.TEMPLATES[2][1], licenses.TEMPLATES[4][1]
    full = dict(licenses.TEMPLATES)["MIT"]
    other = [f"word{k}" for k in range(600)]
    wrapped = "\n".join(" ".join(mit.split()[k : k + 10]) for k in range(0, len(mit.split()), 10))
    rows = [
        (1, "some words\nReleased under the MIT License.\nmore"), (2, "released UNDER the   mit license"), (3, "Released under no License"), (4, None), (5, ""), (6, "x"), (6, "Licensed under CC BY-NC 4.0."),
        (7, apache.replace("applicable ", "")), (8, "word " * 100_000), (9, "\n\n"), (10, apache.replace(", ", ",\n")), (None, "Released under the MIT License."), (11, "Released under the MIT License.\nReleased under the MIT License."),
        (12, " ".join(other[:300]) + "\n" + wrapped + "\n" + " ".join(other[300:])), (13, "MIT License\n\nCopyright (c) 2020 someone\n\n" + textwrap.fill(full, 78)), (14, " ".join(other[:50]) + " Released under the MIT License. " + " ".join(other[50:])),
        (15, "license " * 5000), (16, "Licensed under the Apache License, some words more, Version 2.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 line", "2 dice", "3 license", "4 words", "5 grams")
    want = {(i, name, line, d) for i, t in rows if t is not None for name, (line, d) in best_parts(t).items()}
    got = {tuple(r) for r in licenses.scanned(df).collect()}
    assert got == want and {r[0] for r in want} >= {1, 2, 6, 7, 10, None, 11, 12, 13, 14} and (12, "MIT", 2, 1.0) in want
    assert licenses.scanned(df.limit(0)).collect() == [] and licenses.scanned(df, []).collect() == []


def test_licenses_and_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = {tuple(r) for r in con.sql(licenses.oracle_sql()).select("doc_id", "license", "line", "dice").fetchall()}
    got = {tuple(r) for r in queries.op2_license_scan(spark, "/root/testdata/sf0.001").select("doc_id", "license", "line", "dice").collect()}
    assert got == want and want
