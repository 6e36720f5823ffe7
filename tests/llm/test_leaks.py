import random

from chartloom.llm import leaks as L

ITEMS = "item_id bigint, passage string"


def made_up(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta rust stone river cloud amber willow copper marsh tower lantern anchor violet".split()) + str(r.randrange(40)) for _ in range(n))


def brute_force(docs, items):
    return {(d, i) for d, t in docs if t for i, p in items if p and L.words(p) and len(L.aligned(L.words(p), L.words(t))) / len(L.words(p)) >= L.SHARE}


def test_equals_alignment_of_every_pair(spark):
    rnd = random.Random(5)
    items = [(i, made_up(i, 60 + 5 * i)) for i in range(8)]
    docs = []
    for d in range(120):
        w = made_up(1000 + d, 150).split()
        if d % 2:
            p = items[d % 8][1].split()
            part = p[rnd.randrange(0, len(p) // 2) :][: rnd.randrange(5, len(p))]
            part = [x if rnd.random() > 0.06 else "other" for x in part]
            w[70:70] = part
        t = " ".join(w)
        docs.append((d, t.upper() if d % 7 == 0 else t.replace(" ", ",\r\n") if d % 5 == 0 else t))
    got = {(r.doc_id, r.item_id) for r in L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute_force(docs, items) and len(got) > 15


def test_real_tables_against_every_pair(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.passage) for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in L.p8_found(spark, sf).collect()}
    assert got == brute_force(docs, items)
    blocks = L.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet"), block=5000)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == got


def test_two_pieces_and_short_phrases(spark):
    p = made_up(1, 100)
    w = p.split()
    docs = [(1, " ".join(w[:30]) + " x" * 80 + " " + " ".join(w[60:90])), (2, " ".join(w[:12])), (3, p), (4, p), (4, p), (5, None), (6, ""), (7, " \n"), (8, "z " * 30_000 + p)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as pos", "3 as term")
    items = spark.createDataFrame([(9, p), (9, p), (10, None), (11, " "), (12, "one")], ITEMS).selectExpr("*", "5 as doc_id", "'q' as text")
    assert sorted((r.doc_id, r.item_id) for r in L.leaks(df, items).collect()) == [(1, 9), (3, 9), (4, 9), (8, 9)]
    assert L.leaks(df.limit(0), items).count() == 0 and L.leaks(df, items.limit(0)).count() == 0


def test_short_passages_are_found_whole_and_in_half(spark):
    short, middle = made_up(21, 12), made_up(22, 24)
    rest = made_up(23, 60)
    docs = [(1, f"{rest} {short} {rest}"), (2, f"{rest} {' '.join(middle.split()[:12])} {rest}"), (3, rest), (4, f"{rest} {' '.join(middle.split()[:6])} {rest}")]
    got = L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, short), (2, middle)], ITEMS))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (2, 2)]


def test_passages_of_every_length_are_found_verbatim_and_in_half(spark):
    rest = made_up(50, 70)
    sizes = [2, 3, 5, 7, 10, 12, 13, 30, 36, 64]
    items = [(n, made_up(100 + n, n)) for n in sizes]
    whole = [(n, f"{rest} {p} {rest}") for n, p in items]
    half = [(1000 + n, f"{rest} {' '.join(p.split()[: n // 2])} {rest}") for n, p in items if n >= 30]
    odd = [(2000 + n, f"{rest} {' '.join(p.split()[n // 2 :])}") for n, p in items if n >= 30]
    df = spark.createDataFrame(whole + half + odd, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in L.leaks(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert set(got) == {(n, n) for n in sizes} | {(1000 + n, n) for n in sizes if n >= 30} | {(2000 + n, n) for n in sizes if n >= 30}
    assert all(got[n, n].kind == "exact" and (got[n, n].lo, got[n, n].hi) == (70, 70 + n) and got[n, n].share == 1.0 for n in sizes) and got[1030, 30].kind == "proximity"


def test_pieces_at_both_ends_of_a_very_long_text_and_one_index_for_two_item_sets(spark):
    p, q = made_up(7, 80), made_up(8, 60)
    w = p.split()
    df = spark.createDataFrame([(1, " ".join(w[:40]) + " z" * 300_000 + " " + " ".join(w[40:])), (2, q), (2, q), (3, (p + " ") * 50)], "doc_id bigint, text string")
    index = L.build_index(df)
    for key, text, want in ((1, p, [1, 3]), (2, q, [2])):
        assert sorted(r.doc_id for r in L.leaks(df, spark.createDataFrame([(key, text)], ITEMS), index).collect()) == want


def test_windows_cover_the_spans_in_bounded_pieces():
    assert L.windows([(5, 9), (12, 20)], 10) == [(0, 32)]
    pieces = L.windows([(0, 1000)], 10)
    assert pieces[0][0] == 0 and pieces[-1][1] == 1012 and all(e - s <= 80 for s, e in pieces) and all(b[0] <= a[1] - 20 for a, b in zip(pieces, pieces[1:]))


def test_hashes_follow_the_words_alone(monkeypatch):
    texts = ["One two  three", "ONE,two-three!", "", "one", "x one two three", "naïve Straße 東京 42_7", "one two three " * 40]
    got = L.pair_terms(texts)
    assert [len(t) for t in got] == [max(0, len(L.words(t)) - 1) for t in texts]
    assert (got[0] == got[1]).all() and (got[4][1:] == got[0]).all() and len({int(x) for x in got[5]}) == 4
    monkeypatch.setattr(L, "AT_ONCE", 30)
    assert all((a == b).all() for a, b in zip(got, L.pair_terms(texts)))
