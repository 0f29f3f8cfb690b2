import hashlib

import corpus_pipeline as op
from tests.llm import test_bpe, test_decontaminate, test_minhash, test_quality
from tidemark.llm import toxicity


def test_stages_against_plain_python(spark):
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: r for r in op.run(spark, d).collect()}

    left = {r.doc_id: r for r in table}
    kept = {x[0] for x in test_quality.brute([(r.doc_id, r.text, r.source) for r in left.values()], 100, 0.5, 50) if x[-1]}
    left = {k: r for k, r in left.items() if k in kept}
    labels = spark.read.parquet(f"{d}/labels.parquet").where(~toxicity.held_out())
    model = toxicity.train(spark.createDataFrame(list(left.values()), spark.read.parquet(f"{d}/documents.parquet").schema), labels)
    left = {k: r for k, r in left.items() if model.score(r.text) < 0.5}
    kept = {x[0] for x in test_minhash.brute([(k, r.text) for k, r in left.items()], 5, 80) if x[3]}
    left = {k: r for k, r in left.items() if k in kept}
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {x[0] for x in test_decontaminate.brute([(k, r.text) for k, r in left.items()], items, 10) if not x[2]}
    assert set(got) == clean and 50 < len(clean) < len(table)
    one = test_bpe.library()
    for k, r in got.items():
        assert r.ids == one.encode_ordinary(left[k].text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(left[k].text.encode()).hexdigest()


def test_stage_columns_nulls_and_empty_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = docs.limit(30).unionByName(spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], docs.schema))
    for rows in (odd, docs.limit(0)):
        for name, stage in op.STAGES:
            out = stage(spark, rows, d)
            assert name == "token_ids" or out.columns == docs.columns
            assert out.count() <= rows.count()
    assert len(op.STAGES) == 5 and op.ORACLE_SQL is None


def test_columns_whose_names_the_stages_use_pass_through(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").drop("n_chars").limit(60)
    names = ["SCORE", "predicted", "Kept", "n_words", "node", "row_key", "hit_spans", "item_ids", "n_hit", "gone", "host", "component_id", "body", "id"]
    wide = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    plain, own = docs, wide
    for name, stage in op.STAGES[:-1]:
        plain, own = stage(spark, plain, d), stage(spark, own, d)
        assert own.columns == wide.columns, name
        rows = own.collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in plain.collect()}
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert op.STAGES[-1][1](spark, own, d).columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
