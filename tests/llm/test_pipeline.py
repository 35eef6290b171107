import random

import corpus_pipeline
from mendseq.llm import byte_cnn, golay_simhash, toxicity
from tests.llm.test_models import labelled, written
from tests.llm.test_search import plain_components, plain_fingerprint


def tables(spark, folder):
    rows = [(i, t + " " + t[::-1], "xx") for i, t, _ in labelled(150, 5)]
    rows += [(1000 + i, t, name) for i, t, name in written(200, 6)]
    words = rows[200][1].split(" ") * 8
    rows += [(2000, " ".join(words), "xx"), (2001, " ".join(words), "xx"), (2002, " ".join(words[:40] + ["other"] + words[41:]), "xx"),
             (3000, None, "xx"), (3001, "", "xx"), (3002, "1 2 3 !!", "yy")]
    docs = spark.createDataFrame([(i, t, name, "s", len(t or "")) for i, t, name in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in labelled(150, 5)] + [(1000 + i, 1, 0) for i in range(100)],
                                   "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), labels


def test_stages(spark, tmp_path):
    docs, labels = tables(spark, str(tmp_path))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near-duplicates", "packing"]
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        out = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(given)
            break
        assert out.columns == docs.columns
        found = {r.doc_id: r for r in out.collect()}
        assert all(given[k] == r for k, r in found.items())
        kept.append(set(found))
        if name == "toxicity":
            scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
            assert set(found) == {r.doc_id for r in scored if not r.predicted}
            assert not {i for i, _, y in labelled(150, 5) if y} <= set(found)
        elif name == "language":
            judged = byte_cnn.identify(docs, byte_cnn.fit(docs)).collect()
            assert set(found) == {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= 0.5}
            assert not {3000, 3001, 3002} & set(found)
        else:
            rows = [(k, plain_fingerprint(r.text)) for k, r in given.items()]
            assert set(found) == set(plain_components(rows))
            assert 2000 in found and 2001 not in found
        docs = out
    assert kept[0] > kept[1] > kept[2]
    rows = [tuple(sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())) for df in (
        corpus_pipeline.run(spark, str(tmp_path)), spark.read.parquet(str(tmp_path / "stage3")))]
    assert rows[0] == rows[1]


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_documents_stay_once(spark):
    rng = random.Random(1)
    text = " ".join(str(rng.random()) for _ in range(60))
    docs = spark.createDataFrame([(5, text), (5, text), (6, text)], "doc_id long, text string")
    assert [r.doc_id for r in golay_simhash.first_of_each(docs).collect()] == [5]
