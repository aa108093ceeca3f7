"""The pipeline on the smallest tables: each stage on its own input, and all of it."""

import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first, sizes = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == first.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert first.count() > sizes[0] >= sizes[1] > sizes[2] == sizes[3]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = labels.where("quality = 1").join(first, "doc_id").where("size(split(trim(text), '\\\\s+')) >= 20")
    lost = good.join(spark.read.parquet(str(tmp_path / "quality_classifier")), "doc_id", "left_anti")
    assert lost.count() <= 0.02 * good.count()
    pieces = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_run(spark):
    assert pipeline.run(spark, DATA).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    prose = " ".join(f"word{k} of text." for k in range(60))
    texts = [None, "", " \n", prose, prose, prose + " more", "short", "z" * 100_000, "x y. " * 30_000, "日本語。" * 500, "a $$$ *** " * 30]
    rows = [(i, t, None, None, None, k, "e", 1) for k, (i, t) in enumerate([(None, t) for t in texts] + [(3, t) for t in texts] + [(3, prose)] * 2)]
    kinds = "doc_id long, text string, lang string, source string, n_chars int, row long, key string, __doc int"
    odd = spark.createDataFrame(rows, kinds).repartition(3)
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, odd, str(tmp_path))
        assert found.schema == odd.schema, name
        ids = [r.row for r in found.select("row").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(range(len(rows))), name
        wordless = {k for k, r in enumerate(rows) if not (r[1] or "").split()}
        if name in ("quality_classifier", "quality_rules"):
            assert not wordless & set(ids)
            verdict = {rows[k][1] for k in ids}
            assert {k for k, r in enumerate(rows) if r[1] in verdict} == set(ids)  # equal texts, equal verdicts
        elif name == "minhash_near_dedup":
            assert wordless <= set(ids) and len({rows[k][1] for k in ids} & {prose, prose + " more"}) == 1
        else:
            assert len(ids) == len(rows) and {r.row for r in found.collect() if r.text is None} == {k for k, r in enumerate(rows) if r[1] is None}
    pieces = pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).collect()
    assert sum(r.length for r in pieces if r.start == 0) and {r.doc_id for r in pieces} == {None, 3}
    empty = odd.limit(0)
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in pipeline.STAGES)


def test_run_against_stages_one_by_one(spark, tmp_path):
    """run() gives the rows of its stages in turn; of the tables between them the last one alone is left."""
    rng = __import__("random").Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" + rng.choice(["", "", "."]) for _ in range(rng.choice([8, 80, 200]))]
        text = " ".join(words) + (f" {passage}" if k % 3 == 0 else "")
        rows.append((k, rows[-1][1] if k % 7 == 6 else text, "en", "s", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id: r.text for r in docs.collect()}
    copies = [k for k in range(60) if k % 7 == 6]
    assert not set(copies) & set(kept) and sum(passage in t for t in kept.values()) == 1
    assert all(len(t.split()) >= 20 or passage in rows[k][1] for k, t in kept.items())
    found = pipeline.run(spark, str(tmp_path)).collect()
    total = {r.doc_id: r.doc_tokens for r in found}
    assert set(total) == set(kept) and all(sum(r.length for r in found if r.doc_id == k) == n for k, n in total.items())
