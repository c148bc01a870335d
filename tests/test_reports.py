import json

from pyspark.sql import functions as F

from purlin.operators import carbon_report
from purlin.sources import reports
from purlin.sources.reports import Section


def joined(spark, path):
    return b"".join(open(f"{path}/{p}", "rb").read() for p in reports.parts_in_order(spark, path)).decode()


def test_sections_as_one_csv(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a section has several parts
    many = spark.range(200).select(F.col("id").alias("n"), F.format_string("k%03d", "id").alias("key"), (F.col("id") * 0.5).alias("value")).repartition(5)
    odd = spark.createDataFrame([('say "hi", you', None, "a\r\nb"), ("plain", 1.5, "é")], "key string, value double, citation string")
    path = f"{tmp_path}/r"
    reports.write_csv([Section("many", many, ["n"]), Section("odd,", odd, ["key"])], path, ["key", "value", "citation"])
    want = "section,key,value,citation\r\n" + "".join(f"many,k{i:03d},{i * 0.5},\r\n" for i in range(200))
    want += '"odd,",plain,1.5,é\r\n"odd,","say ""hi"", you",,"a\r\nb"\r\n'
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert joined(spark, path) == want and len(reports.parts_in_order(spark, path)) > 3
    (tmp_path / "r" / "_COMPLETE").unlink()
    assert reports.parts_in_order(spark, path) == []


def test_table_for_spreadsheets(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, 'a"x', 0.25)], "i int, name string, metric double")
    reports.write_table_csv(rows, f"{tmp_path}/t", {"name": 'The "name"', "metric": "Metric"}, ["i"])
    assert joined(spark, f"{tmp_path}/t") == '﻿"The ""name""","Metric"\r\n"a""x","0.25"\r\n"b",""\r\n'


def results(spark):
    rows = [
        ("e1", "u1", "Steel", "steel", "IfcBeam", "arch", "m.ifc", "F1", "f1", 2.0, "kgCO2e/kg", 3.0, "ifc_explicit", 6.0, "calculated_explicit"),
        ("e2", "u2", "<Wood>", "wood", "IfcSlab", None, "m.ifc", "F1", "f2", 1.0, "kgCO2e/m3", 9.0, "geometry_derived", 9.0, "calculated_estimate"),
        ("e3", None, None, None, "IfcSlab", "arch", "n.ifc", "F2", None, None, None, None, "unavailable", None, "missing_material"),
    ]
    schema = "element_id string, material_use_id string, material_raw string, material_normalized string, ifc_type string, discipline string, source_ifc_file string, source_file_id string, factor_id string, factor_value double, factor_unit string, normalized_quantity double, quantity_source string, carbon_kgco2e double, calculation_status string"
    return spark.createDataFrame(rows, schema)


def test_carbon_report_in_three_forms(spark, tmp_path):
    findings = spark.createDataFrame([("Daylight", "none", "insufficient_evidence", "doc / 1-2 / p.3")], "criterion string, evidence string, assessment_status string, citation string")
    sections = carbon_report.report_sections(results(spark), {"id": "r1", "project_id": "P", "commit": {}}, findings, ("Not a certificate.", "Second."))
    reports.write_csv(sections, f"{tmp_path}/c", carbon_report.FIELDS)
    text = joined(spark, f"{tmp_path}/c")
    lines = text.split("\r\n")
    assert lines[0] == "section," + ",".join(carbon_report.FIELDS)
    heads = [x.split(",")[0] for x in lines[1:-1]]
    assert list(dict.fromkeys(heads)) == ["analysis", "selected_ifc_model", "summary", "breakdown:material", "breakdown:ifc_type", "breakdown:discipline", "breakdown:source_ifc_file", "top_contributor", "carbon_factor", "data_quality", "leed_oriented_finding", "limitation"]
    assert "analysis,run_id,r1" + "," * 16 in lines and "breakdown:ifc_type,IfcSlab,9.0" + "," * 16 in lines and "data_quality,missing_material,1" + "," * 16 in lines
    top = [x.split(",") for x in lines if x.startswith("top_contributor")]
    assert [(t[3], t[8], t[9], t[10], t[16]) for t in top] == [("e2", "<Wood>", "9.0", "m3", "9.0"), ("e1", "Steel", "3.0", "kg", "6.0")]
    reports.write_html(sections, f"{tmp_path}/h", "A & B", "No <advice>")
    page = joined(spark, f"{tmp_path}/h")
    assert page.startswith("<!doctype html>") and "A &amp; B" in page and "&lt;Wood&gt;" in page and page.count("<table>") == page.count("</table>") == len(sections) and page.endswith("</body></html>\n")
    reports.write_json(sections, f"{tmp_path}/j")
    items = [json.loads(x) for x in joined(spark, f"{tmp_path}/j").splitlines()]
    assert [i["item"]["value"] for i in items if i["section"] == "limitation"] == ["Not a certificate.", "Second."]
