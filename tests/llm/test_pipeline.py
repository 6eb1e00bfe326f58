"""The pipeline's stages one by one on a small corpus."""

import random

import corpus_pipeline
from tests.llm.test_operators import prose


def test_run(spark, tmp_path):
    r = random.Random(8)
    item = prose(r, 30)
    base = [prose(r, 60) + "." for _ in range(8)]
    rows = [(k, t) for k, t in enumerate(base)] + [(20, base[0]), (21, prose(r, 50) + " " + item + " end"), (22, "too short"), (23, None), (24, base[1] + " write to me.now@mail.example.org")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            kept.append({x.doc_id for x in docs.collect()})
    assert kept[0] == {i for i, _ in rows} - {22, 23}
    assert 20 not in kept[1] and set(range(8)) <= kept[1]
    assert kept[2] == kept[1] - {21}
    last = {x.doc_id: x.text for x in docs.collect()}
    assert 24 not in last or "[EMAIL]" in last[24]
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[3]


def stages(spark, docs, folder):
    """The rows after every stage, each written and read again."""
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name == "bpe":
            return kept, out.collect()
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(docs.collect())


def test_awkward_rows_through_all_stages(spark, make, tmp_path):
    """Repeated and null ids, columns whose names the operators use inside, very long texts and copies, against each row's own merits."""
    r = random.Random(18)
    item = prose(r, 30)
    spark.createDataFrame([(1, item), (1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [prose(r, 60) + "." for _ in range(9)]
    long = ". ".join(prose(r, 12) for _ in range(6_000)) + "."
    bad = clean[8] + " " + item + "."
    rows = [(1, clean[0]), (1, clean[1]), (1, clean[1]), (None, clean[2]), (None, clean[3]), (None, clean[3]), (5, clean[0]), (6, long), (7, long), (None, bad), (8, bad), (9, None), (None, None), (10, ""), (3, clean[4] + " mail to some.one@mail.example.org")]
    kept, last = stages(spark, make(rows), str(tmp_path))
    texts = lambda k: sorted((x.doc_id if x.doc_id is not None else -1, x.text[:20]) for x in kept[k])
    named = lambda *x: sorted((i if i is not None else -1, t[:20]) for i, t in x)
    assert texts(0) == named(*[x for x in rows if x[1]])
    left = [(1, clean[0]), (1, clean[1]), (None, clean[2]), (None, clean[3]), (6, long), (8, bad), (3, clean[4])]
    assert texts(1) == named(*left)
    assert texts(2) == named(*[x for x in left if x[1] != bad])
    assert texts(3) == texts(2) and all("@" not in x.text for x in kept[3]) and all(x.rk == "x" for x in kept[3])
    assert sorted((x.doc_id if x.doc_id is not None else -1) for x in last) == sorted(i for i, _ in texts(3))


def test_empty_tables_through_all_stages(spark, make, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, last = stages(spark, make([]), str(tmp_path))
    assert kept == [[]] * 4 and last == []
