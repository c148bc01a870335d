import pytest

import corpus_pipeline
from purlin.llm.queries import ORACLE_SQL, QUERIES


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("rows", [0, 40])
def test_stages_keep_the_columns(spark, docs_of, tmp_path, rows):
    texts = [f"alpha{i % 30} beta{i} gamma delta{i % 7} epsilon{i} zeta eta{i} theta iota{i}" for i in range(rows)]
    docs = docs_of([(i, None if i == 3 else t) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(rows)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, now = {r.doc_id for r in docs.collect()}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        assert ids <= seen
        seen = ids
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen


def test_stages_with_copies_ties_long_texts_and_clashing_columns(spark, docs_of, tmp_path):
    prose = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = [prose] * 5 + [prose + " phi"] * 2 + [None, "", "", "long " * 60_000, "long " * 60_000] + [f"one{i} two{i} three{i} four{i} five{i} six{i}" for i in range(20)]
    docs = docs_of([(i // 2 if 20 < i < 25 else i, t) for i, t in enumerate(texts)]).withColumnRenamed("score", "probability").withColumnRenamed("kept", "ids")
    spark.createDataFrame([(i, int(i > 2), 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    once = stages["exact_dedup"](spark, docs, str(tmp_path))
    assert once.columns == docs.columns and once.count() == len({t or "" for t in texts})
    near = stages["minhash_dedup"](spark, once, str(tmp_path))
    kept = [r.text for r in near.collect()]
    assert near.columns == docs.columns and sum((t or "").startswith(prose) for t in kept) == 1 and sum((t or "").startswith("long") for t in kept) == 1
    packed = stages["packing"](spark, near, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in near.collect()}
    assert stages["quality_classifier"](spark, docs, str(tmp_path)).columns == stages["mixing"](spark, docs, str(tmp_path)).columns == docs.columns
