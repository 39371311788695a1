import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from threatscan.llm import packing

DOCS = "doc_id long, text string, length string, __part int"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")


def brute(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, texts, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array(brute(text), dtype="<u4")
        got = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        at = 0
        for r in got:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == capacity for r in got[1:])
        assert len(got) == -(-len(ids) // capacity)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), sum(r.length for r in rows)


def test_real_documents(spark, real):
    texts = {r.doc_id: r.text for r in real.collect()}
    sequences, tokens = check(packing.pack_documents(real).collect(), texts, 1024)
    assert sequences <= 1.02 * tokens / 1024 + 1


def test_odd_texts(spark):
    texts = {1: None, 2: "", 3: "a  b\n\n c\t<|endoftext|> 's don't 12ab x ​\U0001f600²Ⅷ", 4: " " * 50, 5: "x" * 5000, 6: "word " * 3000, 7: "\r\n\x0b\x1c\x85", 8: "日本語 テスト १२"}
    df = spark.createDataFrame([(k, v, "c", 1) for k, v in texts.items()], DOCS)
    check(packing.pack_documents(df, capacity=64).collect(), texts, 64)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "", 0)] * 5 + [(None, "a", "", 0)], DOCS)
    rows = packing.pack_documents(df).collect()
    assert len(rows) == 6 and len({(r.sequence_id, r.offset) for r in rows}) == 6
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_plan_uses_every_piece_and_fills():
    rng = np.random.default_rng(1)
    for capacity, n in ((64, 500), (1024, 4000)):
        counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, capacity + 1, n), return_counts=True))}
        used = {}
        total = sequences = 0
        for kind, times in packing.plan(counts, capacity):
            assert sum(kind) <= capacity
            sequences += times
            for x in kind:
                used[x] = used.get(x, 0) + times
                total += x * times
        assert used == counts
        least = max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
        assert sequences <= 1.03 * least + 1  # uniform lengths leave some gaps even at the best


def test_ids_are_real_output(spark, real):
    r = packing.pieces(real.limit(3), ids=True).collect()
    assert all(zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.length for x in r)


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rng = random.Random(1)
    usual = " \n  ab1.,'\u00e9\t\xa0\x1c \u65e5s\x85\U0001f600'll \r\x00\xff\u00b2\u2167\u200b"
    for n in range(3000):
        text = "".join(rng.choice(usual) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 40)))
        assert packing.token_ids(text, path) == np.array([*t.encode(text, add_special_tokens=False).ids, 2], dtype="<u4").tobytes(), ascii(text)


def test_another_vocabulary_goes_through_its_own_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(path).encode("Some words, and MORE", add_special_tokens=False).ids
    assert packing.token_ids("Some words, and MORE", path) == np.array([*want, 2], dtype="<u4").tobytes()


def test_ids_of_documents_pass_unchanged(spark):
    df = spark.createDataFrame([(9007199254740993, "a b"), (None, "c"), (-1, None)], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack_documents(df).collect()} == {9007199254740993, None, -1}
    named = packing.pack_documents(spark.createDataFrame([("x/1", "a " * 100), ("y", "c")], "doc_id string, text string"), capacity=64)
    assert sorted((r.doc_id, r.piece) for r in named.collect()) == [("x/1", 0), ("x/1", 1), ("y", 0)]


def optimum(sizes, capacity):
    """The least number of sequences, by trying every place for each piece."""
    best = len(sizes)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(sizes):
            best = len(free)
            return
        for gap in sorted(set(free)):
            if gap >= sizes[i]:
                place(i + 1, sorted([*free[: free.index(gap)], *free[free.index(gap) + 1 :], gap - sizes[i]]))
        place(i + 1, [*free, capacity - sizes[i]])

    place(0, [])
    return best


def test_plans_are_near_the_optimum():
    rng = random.Random(3)
    more = 0
    for _ in range(150):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {x: sizes.count(x) for x in sizes}
        got = sum(times for _, times in packing.plan(counts, 20))
        least = optimum(sizes, 20)
        assert least <= got <= least + 1
        more += got - least
    assert more <= 8
