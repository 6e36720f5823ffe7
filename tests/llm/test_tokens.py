import random

import pytest

from chartloom.llm import tokens as T

enc = T.encoding()


def whole(text):
    return enc.encode_ordinary(text)


def by_parts(text, long=64, leaf=32):
    units = {}
    for unit, raw, body in T.pieces(text, long, leaf):
        ids = enc._core_bpe.encode_single_piece(body) if raw else list(T.encode_text(enc, body.decode()))
        units.setdefault(unit, []).append([int(i) for i in ids])
    return [i for leaves in units.values() for i in T.join_tree(enc, leaves)]


def test_parts_equal_whole_on_random_texts():
    rnd = random.Random(7)
    alphabets = ["ab", "abc ", "a1!' \n", "the of and ' s t re", "今日は。東京", "नमस्ते ", "  \n\t", "aAé'll", "🙂👍🏽a"]
    for n in range(1500):
        a = rnd.choice(alphabets)
        text = "".join(rnd.choice(a) for _ in range(rnd.randrange(0, 900)))
        assert by_parts(text) == whole(text), (n, text)


def test_long_unsplit_letters_join_exactly():
    rnd = random.Random(3)
    for text in ("a" * 5000, "".join(rnd.choice("etaoinshrdlu") for _ in range(9000)), "supercalifragilistic" * 300, "漢字仮名" * 900, " " * 4000 + "x", "=" * 3001):
        assert by_parts(text, 128, 64) == whole(text)


def test_query_on_defined_cases(spark):
    rows = [(1, "Hello  world's end."), (2, ""), (3, None), (4, "x" * 300_000), (4, "x" * 300_000), (5, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as uid")
    got = sorted((r.doc_id, r.ids) for r in T.encode_corpus(df, long=1 << 12, leaf=1 << 10).collect())
    assert got == sorted((d, whole(t) if t else []) for d, t in rows)
    assert T.encode_corpus(df.limit(0)).count() == 0


def test_vocabulary_is_a_parameter():
    with pytest.raises(FileNotFoundError):
        T.encoding("/nowhere")


def test_default_sizes_and_texts_of_letters_only(spark, sf):
    text = "".join(random.Random(5).choice("etaoinshrdlu") for _ in range(3 * T.LONG))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string")
    assert [r.ids for r in T.encode_corpus(df).collect()] == [whole(text)] * 2
    docs = {r.doc_id: r.t for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "regexp_replace(text, '[^\\\\p{L}]+', '') as t").collect()}
    got = {r.doc_id: r.ids for r in T.p7_unsplit_ids(spark, sf).collect()}
    assert got == {d: whole(t) if t else [] for d, t in docs.items()} and sum(len(t) > T.UNSPLIT for t in docs.values() if t) > 30
