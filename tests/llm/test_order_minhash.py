import hashlib

from mendseq.llm import order_minhash as m
from tests.llm.data import documents, empty


def test_edits_follow_the_next_document(spark):
    rows = m.fingerprint_edits(documents(spark)).collect()
    given = {}
    for r in documents(spark).collect():
        given.setdefault(r.doc_id, r.text or "")
    order = sorted((i for i in given if i is not None), reverse=True) + [None]
    after = dict(zip(order, order[1:] + order[:1]))
    assert len(rows) == documents(spark).count()
    for r in rows:
        text, cut = given[r.doc_id], len(given[r.doc_id]) // 3
        edited = text[:len(text) - cut] + given[after[r.doc_id]][:cut]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_equal_texts_and_order(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "e f g h a b c d"), (4, "q r s t u v w x"), (5, ""), (6, None)]
    df = m.with_fingerprint(spark.createDataFrame(rows, "id long, text string").fillna("", ["text"]), "text", "codes")
    codes = {r.id: r.codes for r in df.collect()}
    assert codes[1] == codes[2] != codes[3] and codes[5] == codes[6] == []
    pairs = df.alias("a").crossJoin(df.alias("b"))
    like = {(r[0], r[1]): r[2] for r in pairs.selectExpr("a.id", "b.id", "a.codes x", "b.codes y").select(
        "a.id", "b.id", m.likeness(m.F.col("x"), m.F.col("y"))).collect()}
    assert like[1, 2] == 1 and like[5, 6] == 1 and like[1, 4] == 0 and like[1, 5] == 0
    # The same words in another order share fewer tuples than all.
    assert 0 < like[1, 3] < 1


def test_repeats_count(spark):
    rows = [(1, "x y " * 3), (2, "x y " * 30)]
    df = m.with_fingerprint(spark.createDataFrame(rows, "id long, text string"), "text", "codes")
    assert [len(r.codes) for r in df.orderBy("id").collect()][0] < [len(r.codes) for r in df.orderBy("id").collect()][1]


def test_no_python_in_the_plan(spark):
    plan = m.with_fingerprint(documents(spark).fillna("", ["text"]), "text", "codes")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_single(spark):
    assert m.fingerprint_edits(empty(documents(spark))).count() == 0
    one = m.fingerprint_edits(documents(spark).where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1
