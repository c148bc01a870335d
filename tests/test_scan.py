import warnings

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purlin.functions import nested
from purlin.sources import scan as sc

SCHEMA = "id string, n bigint"


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.jsonl").write_text(text)


GOOD = '{"id": "a", "n": 1}\n{"id": "b", "n": 2}\n'


def short(file):
    return file.rsplit("/", 1)[1].removesuffix(".jsonl")


def test_bad_and_empty_files_dont_stop_good_ones(spark, tmp_path):
    put(tmp_path, good=GOOD, other='\n{"id": "c"}', broken='{"id": "x", "n": 1}\n{"id": ', typed='{"id": "x", "n": "much"}', lacking='{"n": 3}', empty="", blank="\n  \n")
    found = sc.scan(spark, f"{tmp_path}", SCHEMA, required=("id",))
    status = {short(r.file): (r.status, r.records) for r in found.status.collect()}
    assert status == {"good": ("processed", 2), "other": ("processed", 1), "broken": ("failed", 0), "typed": ("failed", 0), "lacking": ("failed", 0), "empty": ("empty", 0), "blank": ("empty", 0)}
    errors = {short(r.file): r.error for r in found.status.where("status = 'failed'").collect()}
    assert errors["lacking"] == "without id" and errors["broken"].startswith("not a record")
    assert sorted((short(r.file), r.id, r.n) for r in found.rows.collect()) == [("good", "a", 1), ("good", "b", 2), ("other", "c", None)]


def test_only_changed_files_are_read_again(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, a=GOOD, b='{"id": "z", "n": 9}', c="not json", d="")
    cache = sc.FileCache(spark, f"{tmp_path}/cache", SCHEMA)
    read = []
    lines_of = sc.lines_of
    monkeypatch.setattr(sc, "lines_of", lambda s, paths: read.extend(map(short, lines_of(s, paths).inputFiles())) or lines_of(s, paths))

    def build(**more):
        read.clear()
        with warnings.catch_warnings(record=True):
            warnings.simplefilter("always")
            return {short(r.file): (r.status, r.records) for r in cache.build(f"{folder}", **more).collect()}

    assert build() == {"a": ("processed", 2), "b": ("processed", 1), "c": ("failed", 0), "d": ("empty", 0)} and sorted(read) == ["a", "b", "c", "d"]
    assert build() == {"a": ("cached", 2), "b": ("cached", 1), "c": ("failed", 0), "d": ("empty", 0)} and read == []
    put(folder, b='{"id": "y", "n": 10}\n{"id": "w"}', e='{"id": "e"}')
    (folder / "a.jsonl").unlink()
    assert build() == {"b": ("processed", 2), "c": ("failed", 0), "d": ("empty", 0), "e": ("processed", 1)} and sorted(read) == ["b", "e"]
    assert sorted((short(r.file), r.id) for r in cache.rows().collect()) == [("b", "w"), ("b", "y"), ("e", "e")]
    assert set(read) == {"b", "e"} and build(force=True)["b"] == ("processed", 2) and sorted(read) == ["b", "c", "d", "e"]
    with pytest.warns(RuntimeWarning), pytest.raises(ValueError):
        (tmp_path / "bad").mkdir()
        put(tmp_path / "bad", x="nothing")
        sc.FileCache(spark, f"{tmp_path}/other", SCHEMA).build(f"{tmp_path}/bad")


def test_numbers_by_key_at_any_depth(spark):
    deep = '{"a": ' * 40 + '{"carbon kgCO2e": 7}' + "}" * 40
    docs = [
        (1, '{"total_carbon_kgCO2e": 5.5, "run": {"Carbon_KGCO2E_list": [1, [2, {"x": 9}], "3"], "other": 8}, "carbon_kgco2e": null}'),
        (2, deep),
        (3, "{broken"),
        (4, None),
        (5, '[{"carbon_kgco2e": true}, {"carbon_kgco2e": "n/a"}, 4]'),
        (6, "12"),
    ]
    rows = spark.createDataFrame(docs, "doc int, json string")
    found = nested.harvested(rows, "json", ["doc"], ("carbon", "kgco2e")).orderBy("doc", "path").collect()
    assert [(r.doc, r.key, r.value) for r in found if r.doc == 1 and r.key.startswith("C")] == [(1, "Carbon_KGCO2E_list", v) for v in (1.0, 2.0, 3.0)]
    assert sorted((r.doc, r.value) for r in found) == [(1, 1.0), (1, 2.0), (1, 3.0), (1, 5.5), (2, 7.0)]


def test_rounding_of_nested_numbers(spark):
    row = spark.createDataFrame([([[0.12345678951, 1.0], [2.00000000049]], (1.9999999996, "x"), 3)], "m array<array<double>>, s struct<v: double, t: string>, n int")
    out = row.select(*[nested.rounded(F.col(f.name), f.dataType).alias(f.name) for f in row.schema.fields]).first()
    assert out.m == [[0.12345679, 1.0], [2.0]] and tuple(out.s) == (2.0, "x") and out.n == 3


def test_boxes_from_vertices(spark):
    rows = [(1, [0.0, 5.0, -1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0]), (3, []), (4, None), (5, [1.0, float("nan"), 2.0]), (6, [1.0, None, 2.0]), (7, [3.0, 2.0, 1.0])]
    got = {r.i: r.b for r in spark.createDataFrame(rows, "i int, v array<double>").select("i", nested.vertex_box(F.col("v")).alias("b")).collect()}
    assert tuple(got[1]) == (0.0, 3.0, -1.0, 2.0, 5.0, 4.0, None) and tuple(got[7])[:6] == (3.0, 2.0, 1.0, 3.0, 2.0, 1.0)
    assert got[3] is None and got[4] is None
    assert {got[i].fault for i in (2, 5, 6)} == {"malformed vertices"} and got[5].min_x is None


def test_records_in_both_spellings(spark):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("min_x", T.DoubleType()), T.StructField("storey_name", T.StringType()), T.StructField("type", T.StringType())])
    frame = spark.createDataFrame([("a", 1.5, None, "L1", "IfcWall"), ("b", 2.0, "S", "L2", None)], "id string, minX double, storey_name string, storeyName string, ifcType string")
    got = sorted(map(tuple, nested.canonical(frame, schema, {"type": ("ifcType",)}).collect()))
    assert got == [("a", 1.5, "L1", "IfcWall"), ("b", 2.0, "S", None)]
