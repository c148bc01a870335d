"""Issues in one pass against ``clash_pairs``, with cells dealt whole and in parts; what the queries that need every issue make of them."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from purlin.operators import issue_pass
from purlin.operators.spatial import clash_pairs
from tests.test_round3 import boxes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def elements(spark):
    """Mixed boxes; some as long as the building, so there is more than one level of cells."""
    long = boxes(spark, 20, seed=6).selectExpr("concat('long', id) as id", "ifc_guid", "nullif(ifc_type, 'IfcSlab') as ifc_type", "source_file_id", "storey_name", "name", "project_id", *[f"min_{x} - 20 as min_{x}" if x != "z" else "min_z" for x in "xyz"], *[f"max_{x} + 20 as max_{x}" if x != "z" else "max_z" for x in "xyz"])
    return boxes(spark).unionByName(long).persist()


@pytest.fixture(scope="module")
def every(elements):
    return clash_pairs(elements, carry=["ifc_type", "storey_name", "source_file_id", "ifc_guid"]).persist()


def plain(frame, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())


@pytest.mark.parametrize("most", [50_000, 37])
def test_rows_are_those_of_the_join(elements, every, most):
    columns = ["a_id", "b_id", "cross_file", "issue", "metric", "a_storey_name", "b_storey_name"]
    assert plain(issue_pass.issue_rows(elements, ["storey_name"], most=most), columns) == plain(every, columns)
    marked = elements.withColumn("told", F.col("ifc_type") == "IfcBeam")
    want = every.where("cross_file and (a_ifc_type = 'IfcBeam' or b_ifc_type = 'IfcBeam')")
    assert plain(issue_pass.issue_rows(marked, among="told", only_cross=True, most=most), columns[:5]) == plain(want, columns[:5])


@pytest.mark.parametrize("most", [50_000, 37])
def test_counts_by_columns_of_both_ends(elements, every, most):
    keys = ["a_ifc_type", "b_ifc_type", "a_storey_name", "b_storey_name", "issue", "cross_file"]
    want = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    assert plain(issue_pass.issue_counts(elements, ["ifc_type", "storey_name"], most=most), [*keys, "n"]) == plain(want, [*keys, "n"])


def joins(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["issues_by_storey_either_end", "scope_delete_survivors", "run_summary_by_type", "issue_text_search"])
def test_issues_are_not_moved(spark, name):
    """Issues grow with the square of the boxes: what is shuffled after the pass is a row a group and kind, and no issue is joined."""
    plan = joins(entry.queries()[name](spark, SF))
    assert "FlatMapGroupsInArrow" in plan and plan.count("Join") == 1  # the sizes of crowded cells


@pytest.mark.parametrize("most", [50_000, 37])
@pytest.mark.parametrize("k", [1, 60, 5000])
def test_first_issues_of_both_orders(elements, every, k, most):
    found = issue_pass.first_issues(elements, k, ("metric", "source"), most=most)
    orders = {"metric": [F.col("metric").desc(), "a_id", "b_id"], "source": ["a_source_file_id", "b_source_file_id", "a_id", "b_id"]}
    for name, order in orders.items():
        want = every.orderBy(*order).limit(k)
        assert plain(found.where(F.col("in_order") == name), ["a_id", "b_id", "metric", "issue"]) == plain(want, ["a_id", "b_id", "metric", "issue"])
    only = issue_pass.first_issues(elements, k, issue="CLEARANCE_VIOLATION", most=most)
    want = every.where("issue = 'CLEARANCE_VIOLATION'").orderBy(*orders["metric"]).limit(k)
    assert plain(only, ["a_id", "b_id", "metric"]) == plain(want, ["a_id", "b_id", "metric"])


@pytest.mark.parametrize("most", [50_000, 37])
def test_worst_issue_of_every_guid(elements, every, most):
    """Ties go to the joined ids' order, in which an id that begins another doesn't always come first."""
    best = {}
    for r in every.collect():
        for side, x in enumerate("ab"):
            guid = r[f"{x}_ifc_guid"] if r[f"{x}_ifc_guid"] is not None else r[f"{x}_id"]
            key = (-r["metric"], r["a_id"] + r["b_id"], side)
            best[guid] = min(best.get(guid, (key, None, None)), (key, r[f"{x}_id"], r[f"{x}_ifc_type"]), key=lambda v: v[0])
            if best[guid][1] is None:
                best[guid] = (key, r[f"{x}_id"], r[f"{x}_ifc_type"])
    found = issue_pass.worst_ends(elements, ["ifc_type"], most=most)
    assert plain(found, ["guid", "id", "ifc_type"]) == sorted(repr((g, v[1], v[2])) for g, v in best.items())


@pytest.mark.parametrize("most", [50_000, 37])
def test_places_are_counted_among_all_issues(elements, every, most):
    rows = [(r["a_id"], r["b_id"], r["metric"], r["a_source_file_id"], r["b_source_file_id"]) for r in every.collect()]
    null_first = lambda v: (v is not None, v or "")
    orders = {"metric": lambda r: (-r[2], r[0], r[1]), "source": lambda r: (null_first(r[3]), null_first(r[4]), r[0], r[1])}
    asked = random.Random(3).sample(rows, 40)
    found = issue_pass.issue_places(elements, asked, most=most)
    for name, order in orders.items():
        places = {r: i for i, r in enumerate(sorted(rows, key=order), 1)}
        assert found[name] == [places[r] for r in asked]


@pytest.mark.parametrize("k", [1, 40, 5000])
def test_first_by_source_with_and_without_enough_in_the_first_file(elements, every, k):
    for rows, issues in ((elements, every), (elements.where("source_file_id is not null"), every.where("a_source_file_id is not null and b_source_file_id is not null"))):
        want = issues.orderBy("a_source_file_id", "b_source_file_id", "a_id", "b_id").limit(k)
        assert plain(issue_pass.first_by_source(rows, k), ["a_id", "b_id", "metric"]) == plain(want, ["a_id", "b_id", "metric"])


def test_client_sorts_number_no_issues(spark):
    """Rows beside the 600 that are returned aren't dealt by range or numbered; only those reach the driver."""
    plan = joins(entry.queries()["issue_client_sorts"](spark, SF))
    assert "Window" not in plan and "RepartitionByExpression" not in plan


def test_enrichment_joins_scores_to_elements_alone(spark):
    plan = joins(entry.queries()["clash_anomaly_enrichment"](spark, SF))
    assert "FlatMapGroupsInArrow" in plan and plan.count("Join") <= 3  # scores, where they are read, and the sizes of crowded cells
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]
