import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crownwork.llm import huffman, packing
from crownwork.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b ", "  ", " ", ",", ".", "\n", "\n\n", " \n", "'s", "1", "é", "中", "-", "!", "\t", " ", "́", "\x1f", " the", " ,", "\x00", "<|endoftext|>"]


@pytest.fixture(scope="module")
def enc():
    return PieceEncoder(PATH)


def plain(enc, texts):
    return [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=12).map("".join) | st.text(max_size=20), min_size=1, max_size=20))
def test_pieces_give_the_ids_of_whole_texts(enc, texts):
    ids, n = enc.ids(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == plain(enc, texts)


def test_memo_starts_anew_when_full():
    small = PieceEncoder(PATH, most=5)
    for t in ("one two three four five six", "seven eight", "one two"):
        assert small.ids([t])[0].tolist() == plain(small, [t])[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=2000), st.integers(6, 12))
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids)
    counts = np.bincount(ids)
    lengths = huffman.code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    payload, checkpoints = huffman.pack(ids, huffman.canonical(lengths), lengths)
    assert (huffman.unpack(payload, checkpoints, len(ids), huffman.decode_table(lengths, limit), limit) == ids).all()


def test_lengths_are_best():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    import heapq

    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        best += x
        heapq.heappush(heap, x)
    assert (huffman.code_lengths(counts, 15) * counts).sum() == best
    assert (huffman.code_lengths(counts, 5) * counts).sum() > best


def docs(spark):
    random.seed(3)
    words = ["alpha", "beta,", "gamma.", "\n", "  ", "é", "delta"]
    rows = [(i, " ".join(random.choices(words, k=random.choice([0, 3, 40, 900, 5000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (7, rows[7][1]), (7, "again"), (None, "no id")]
    random.shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 start", "2 n_tokens", "3 length", "4 slice", "5 rank")


def test_token_file(spark, enc):
    rows, df = docs(spark)
    path = huffman.write_ids(df.repartition(7), PATH, segment_bytes=20_000)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in huffman.read_ids(spark, path).collect()))
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(plain(enc, [t or ""])[0] + [0], "<u4")
        want.append((at, i, len(ids), ids.tobytes()))
        at += len(ids)
    assert got == want
    crc = {(r["start"], r["ids_crc32"]) for r in huffman.read_ids(spark, path, digest=True).collect()}
    assert crc == {(s, zlib.crc32(x)) for s, _, _, x in want}


def test_token_file_of_no_rows(spark):
    path = huffman.write_ids(docs(spark)[1].limit(0), PATH)
    assert huffman.read_ids(spark, path).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 40))
def test_fullest_is_the_fullest(counts, room):
    lengths = sorted(counts, reverse=True)
    sums = {0}
    for x in lengths:
        sums = {s + k * x for s in sums for k in range(counts[x] + 1) if s + k * x <= room}
    found = packing.fullest(lengths, [counts[x] for x in lengths], room)
    assert sum(x * n for x, n in found) == max(sums) and all(n <= counts[x] for x, n in found)


@pytest.mark.parametrize("width", [16, 2048])
def test_packing(spark, enc, width):
    rows, df = docs(spark)
    got = packing.packed(df.repartition(5), PATH, width).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
    total = sum(r["length"] for r in got)
    assert total / width <= len(by_bin) <= total / width * 1.1 + 1
    seven = [np.array(plain(enc, [t or ""])[0] + [0], "<u4") for i, t in rows if i == 7]  # rows that repeat a doc_id are documents of their own
    cut = lambda x: [0, *range(len(x) % width or min(len(x), width), len(x) + 1, width)]
    want = [(k, a, b - a, zlib.crc32(x[a:b].tobytes())) for x in seven for k, (a, b) in enumerate(zip(cut(x), cut(x)[1:]))]
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[7]) == sorted(want)
    for i, t in rows:
        if i == 7:
            continue
        ids = np.array(plain(enc, [t or ""])[0] + [0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == width or k == 0
            at += r["length"]
        assert at == len(ids)


def test_packing_of_no_rows(spark):
    assert packing.packed(docs(spark)[1].limit(0), PATH).collect() == []


def test_added_tokens_as_plain_calls():
    from tokenizers import Tokenizer

    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b, c. d\n<|endoftext|>", "one <|endoftext| > two", ""]
    ids, sizes = PieceEncoder(PATH).ids(texts)
    want = [Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == [len(w) for w in want]
    assert want[0] == [505, 220, 50256, 734]
