"""Results that the third review found wrong, and the shapes of plans that it found too dear."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from purlin.operators import graph, retrieval, spatial


def rows_of(frame, columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_recent_window_keeps_the_line_break_that_begins_the_summary(spark, tmp_path):
    """The newer lines and their breaks fill the summary exactly, or nearly; nulls as DuckDB has them."""
    rows = []
    for conv, size in enumerate((388, 389, 390, 391, 392, 393, 394)):
        rows += [(conv, t, "user", "new") for t in range(2, 6)] + [(conv, 1, "user", "x" * size), (conv, 0, "assistant", "old")]
    rows += [(90, t, "user", None if t % 2 else f"t{t}") for t in range(8)] + [(91, None, "user", "lost")] + [(91, t, None, f"t{t}") for t in range(6)]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    name = "conversation_recent_window"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}/*.parquet'")
    want = sorted(con.sql(f"select conv_id, messages, recent, summary from ({entry.oracle_sql()[name]})").fetchall())
    assert rows_of(entry.queries()[name](spark, str(tmp_path)), ("conv_id", "messages", "recent", "summary")) == want


def boxes(spark, n=400, seed=5):
    """Boxes of mixed sizes on a few metres, some without coordinates or file, some flat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        low = [rng.choice((rng.uniform(0, 6), rng.randrange(6) * 1.0)) for _ in "xyz"]
        size = [rng.choice((0.0, 0.25, 1.0, rng.uniform(0, 3))) for _ in "xyz"]
        box = [*low, *[a + b for a, b in zip(low, size)]] if i % 17 else [None] * 6
        rows.append((f"e{i}", f"g{i % 90}", rng.choice(("IfcBeam", "IfcColumn", "IfcSlab", "IfcFlowSegment")), rng.choice(("F0", "F1", "F2", None)), rng.choice(("s1", "s2", None)), f"Basic:{i}", "P", *box))
    axes = ", ".join(f"{m}_{a} double" for m in ("min", "max") for a in "xyz")
    return spark.createDataFrame(rows, f"id string, ifc_guid string, ifc_type string, source_file_id string, storey_name string, name string, project_id string, {axes}").persist()


@pytest.mark.parametrize("k", [1, 25, 300, 100_000])
@pytest.mark.parametrize("only", [True, False])
def test_worst_issues_are_those_of_all_boxes(spark, monkeypatch, k, only):
    """Also where a share of the boxes is tried first: with enough issues there, too few, and none that outweighs a violation."""
    monkeypatch.setattr(spatial, "ALL_AT_ONCE", 0)
    monkeypatch.setattr(spatial, "SHARES", (0.05, 0.3))
    elements = boxes(spark)
    wanted = F.col("a_storey_name").eqNullSafe("s1") | F.col("b_storey_name").eqNullSafe("s1")
    every = spatial.clash_pairs(elements, carry=["storey_name"]).where(wanted)
    every = every.where("issue = 'CLASH'") if only else every
    want = [tuple(r) for r in every.orderBy(F.col("metric").desc_nulls_first(), "a_id", "b_id").limit(k).collect()]
    assert [tuple(r) for r in spatial.worst_issues(elements, k, ["storey_name"], wanted, only_clashes=only).collect()] == want


def test_listing_joins_only_boxes_that_can_be_listed(spark, monkeypatch):
    """The worst issues of many small boxes and a few large ones are found among the large ones."""
    monkeypatch.setattr(spatial, "ALL_AT_ONCE", 0)
    joined = []
    pairs = spatial.clash_pairs
    monkeypatch.setattr(spatial, "clash_pairs", lambda rows, *a, **b: joined.append(rows.count()) or pairs(rows, *a, **b))
    rows = spark.range(3000).select(
        F.concat(F.lit("e"), "id").alias("id"), F.lit("").alias("ifc_guid"), F.lit("IfcBeam").alias("ifc_type"), F.lit("F0").alias("source_file_id"), F.lit("s").alias("storey_name"), F.lit("P").alias("project_id"),
        *[F.lit(0.0).alias(f"min_{a}") for a in "xyz"], *[F.when(F.col("id") % 100 == 0, 2.0).otherwise(0.5).alias(f"max_{a}") for a in "xyz"],
    )
    found = graph.issue_listing(rows, issue="CLASH", limit=20).collect()
    assert [r["metric"] for r in found] == [8.0] * 20
    assert joined and max(joined) == 30


def test_typed_issues_join_the_two_types_alone(spark):
    elements = boxes(spark)
    a, b = F.col("a_ifc_type"), F.col("b_ifc_type")
    every = spatial.clash_pairs(elements, carry=["ifc_type"]).where(((a == "IfcBeam") & (b == "IfcColumn")) | ((a == "IfcColumn") & (b == "IfcBeam")))
    order = [F.col("metric").desc_nulls_first(), F.col("a_id"), F.col("b_id")]
    want = [tuple(r) for r in every.orderBy(*order).limit(40).select("a_id", "b_id", "issue", "metric").collect()]
    assert len(want) == 40
    assert [tuple(r) for r in graph.typed_issues(elements, "IfcBeam", "IfcColumn", 40).select("a_id", "b_id", "issue", "metric").collect()] == want


@pytest.mark.parametrize("few", [0, 20_000])
def test_issues_among_some_elements_are_those_with_such_an_end(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "FEW", few)
    elements = boxes(spark)
    among = F.col("name").endswith("7") & (F.col("storey_name") == "s1")
    some = {r["id"] for r in elements.where(among).collect()}
    want = sorted(tuple(r) for r in spatial.clash_pairs(elements).collect() if r["a_id"] in some or r["b_id"] in some)
    assert want and sorted(tuple(r) for r in spatial.clash_pairs(elements, among=among).collect()) == want
    both = [(h, t, i, m) for a, b, _, i, m in want for h, t in ((a, b), (b, a)) if h in some]
    assert sorted(tuple(r) for r in graph.issues_around(elements, among).select("e_id", "o_id", "issue", "metric").collect()) == sorted(both)


def test_nearest_vectors_of_blocks_are_those_of_pairs(spark):
    """Scores to the last bit and ties by id as pair by pair; copies, nulls, short vectors and several batches included."""
    rng = random.Random(8)
    one = [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, one if i % 5 == 0 else None if i % 41 == 1 else one[:3] if i % 41 == 2 else [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).persist()
    asked = vectors.where("vec_id % 50 in (0, 7) and vec_id % 41 > 2")
    ordered = lambda frame: sorted(tuple(r) for r in frame.select("query_id", "vec_id", "score", "rank").collect())
    plan = retrieval._topk_block(asked, vectors, 10)
    assert "MapInArrow" in plan._jdf.queryExecution().toString()
    assert ordered(plan) == ordered(retrieval._topk_plain(asked, vectors, 10))


def test_a_repeated_word_is_sorted_once(monkeypatch):
    """Counts of n-grams are those of every occurrence, while a text's word goes through the sort of n-grams once."""
    import numpy as np
    import pyarrow as pa

    from purlin.operators import retrieval

    sizes, sort = [], np.sort
    monkeypatch.setattr(np, "sort", lambda x: sizes.append(len(x)) or sort(x))
    grams, text, place, tf = retrieval._gram_counts()(pa.array(["ab " * 1000, None, "abc ab"]))
    assert max(sizes) == 1002  # words; their n-grams are few
    assert sum(tf[text == 0]) == 3000 and len(tf[text == 0]) == 3 and not (text == 1).any()  # " ab", "ab " and " ab "
    assert sorted(tf[text == 2].tolist()) == [1] * 7 + [2]  # " ab" of both words
    assert len(grams) == len(set(grams.tolist())) == place.max() + 1
