import hashlib
from collections import defaultdict

from purlin.llm.exact_dedup import drop_copies, exact_dedup


def brute(rows, largest):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        out.append((i, keep, len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (6, "x" * 60_000), (7, "x" * 60_000 + "y"), (8, "x" * 60_000), (9, " a")]


def test_matches_brute_force(docs_of):
    for largest in (True, False):
        got = exact_dedup(docs_of(ROWS), keep="largest" if largest else "smallest").collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(ROWS, largest)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_hot_group_is_spread_and_whole(docs_of):
    rows = [(i, "same" if i % 3 == 0 else f"text {i % 250}") for i in range(900)]
    got = exact_dedup(docs_of(rows), keep="largest").collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows, True)
    assert sum(r.kept for r in got) == len({t for _, t in rows})


def test_repeated_rows_null_ids_and_empty_tables(docs_of):
    got = exact_dedup(docs_of([(1, "a"), (1, "a"), (None, "b"), (None, "c"), (4, "c")])).collect()
    assert len(got) == 5 and sum(r.kept for r in got) == 3
    assert {r.keep_id for r in got if r.text_sha256 == hashlib.sha256(b"c").hexdigest()} == {4}
    assert exact_dedup(docs_of([])).collect() == []


def test_drop_copies_keeps_columns_and_one_row_each(docs_of):
    docs = docs_of(ROWS)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 9]


def test_normaliser(docs_of):
    from pyspark.sql import functions as F

    got = exact_dedup(docs_of([(1, "A b"), (2, "a B")]), normalise=F.lower).collect()
    assert {r.keep_id for r in got} == {1} and {r.group_size for r in got} == {2}


def test_hot_texts_with_long_heads_nulls_and_no_python(spark, docs_of):
    long = "é" * 80_000
    rows = [(i if i % 7 else None, (long, "", None, f"t{i % 90}")[i % 4]) for i in range(700)] + [(5, long)] * 3
    for largest in (True, False):
        got = exact_dedup(docs_of(rows), keep="largest" if largest else "smallest")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=repr) == brute(rows, largest)
        assert got.where("kept").count() == len({t or "" for _, t in rows})
    assert sorted(drop_copies(docs_of(rows)).toPandas()["text"].fillna("").unique()) == sorted({t or "" for _, t in rows})
