"""Clause segmentation, retrieval over several questions and answer checks, against literal cases and plain Python."""

import pytest
from pyspark.sql import functions as F

from purlin.functions import answers, clauses
from purlin.functions.text import heading
from purlin.operators import chunking, registry, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_clause_numbers():
    text = "intro\n15-1-2 first\nsee ASME B16.1 and ISO 15-2\n- 3 - 2 - 15 turned\n15.4.1 dots 2023-15"
    assert [c.clause_id for c in clauses.clauses(text, "15")] == ["15-1-2", "15-3-2", "15-4-1"]
    assert clauses.clause_ids("20-1 a 20-1 c 20-2", "20") == ["20-1", "20-2"] and clauses.last_clause("x", "20") is None
    assert [c.clause_id for c in clauses.clauses("4-2-1 and 7.3", None)] == ["4-2-1", "7-3"]
    assert clauses.canonical("- 1 - 2 - 20", "20") == "20-1-2" and clauses.canonical("3-4", "20") is None and clauses.canonical("20", "20") is None


def decimals(spark, text):
    return [tuple(d) for d in one(spark, clauses.slash_decimals(F.lit(clauses.normalised(text))))]


def test_decimals_need_a_unit(spark):
    assert decimals(spark, "ارتفاع ۳۸/۰ متر و ۵/۲ متر بر ثانیه") == [("38/0", "0.38", "متر"), ("5/2", "2.5", "متر")]
    assert decimals(spark, "در ۱۳۹۹/۵/۲ و ۳/۴") == []


def test_blocks_pieces_and_tables(spark):
    text = "para one\ngoes on\n\n- item a\nwrapped\n- item b\nب- ج"
    assert clauses.blocks(text) == ["para one goes on", "- item a wrapped", "- item b", "ب- ج"]
    assert clauses.pieces(text, 20) == ["para one goes on", "- item a wrapped", "- item b\nب- ج"]
    assert clauses.pieces("a" * 45 + "\n\nb", 20) == ["a" * 20, "a" * 20, "a" * 5, "b"] and clauses.pieces("", 20) == []
    assert clauses.windows("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"] and clauses.windows("  ", 4) == []
    rows = [["Size", ""], ["10", "x"], ["20", ""]]
    assert clauses.table_parts(rows, 60) == ["Table columns: 1=Size | 2=Column 2\nTable row 1: Size=10 | Column 2=x", "Table columns: 1=Size | 2=Column 2\nTable row 2: Size=20"]
    assert clauses.table_section([["A1", "2.5"], ["B2", ""]], [("9-1", "has A1"), ("9-2", "has B2 and 2.5"), ("9-3", "B2 and 2.5")]) == "9-2"
    assert clauses.is_grid(rows) and not clauses.is_grid([["a", "b"]])
    page = lambda text: one(spark, clauses.printed_page(F.lit(text), F.lit(9), F.lit(20)))
    assert page("12\ntext\n7") == 7 and page("text") == 0
    assert clauses.first_line("\n 9-2-1 - Scope \nmore") == "9-2-1 - Scope" and one(spark, heading(F.lit("\n 9-2-1 - Scope \nmore"))) == "Scope"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        ("d", 1, "front matter\n۱۵-۱-۱ Scope\nThe lift.\n15-1-2 Doors\nDoors close", None),
        ("d", 2, "by themselves.\n15-1-3 Cars\nalpha\n15-2-1 X", [[["Code", "Size"], ["A1", "10"], ["B2", "20"]]]),
        ("d", 3, "پیوست ۱\n15-9-9 not a clause here", None),
        ("d", 4, "after the appendix\n15-3-1 Last", None),
        ("e", 1, "nothing numbered at all", None),
    ]
    return spark.createDataFrame(rows, f"document_id string, page_number long, text string, tables {chunking.TABLES}")


def test_chunks_of_pages(pages):
    got = chunking.chunk_pages(pages).orderBy("document_id", "chunk_index").collect()
    assert [(r.document_id, r.page_number, r.clause_id, r.section_id, r.heading) for r in got] == [
        ("d", 1, None, "page-1", "front matter"), ("d", 1, "15-1-1", "15-1-1", "Scope"), ("d", 1, "15-1-2", "15-1-2", "Doors"),
        ("d", 2, "15-1-2", "15-1-2", "by themselves."), ("d", 2, "15-1-3", "15-1-3", "Cars"), ("d", 2, "15-2-1", "15-2-1", "X"), ("d", 2, "15-1-2", "15-1-2", "Code"),
        ("d", 4, None, "page-4", "after the appendix"), ("d", 4, "15-3-1", "15-3-1", "Last"), ("e", 1, None, "page-1", "nothing numbered at all"),
    ]
    doors = [r for r in got if r.section_id == "15-1-2"]
    assert [r.section_chunk_index for r in doors] == [0, 1, 2] and doors[0].next_section_chunk_id == doors[1].chunk_id and doors[1].chunk_id == "d-p2-c3"
    assert doors[2].chunk_kind == "table" and doors[2].chunk_id == "d-p2-table0-part0" and doors[2].table_rows == 3
    assert got[1].parent_section_id == "15-1" and got[0].parent_section_id == "" and got[9].next_chunk_id == ""
    flags = {(r.document_id, r.page_number): (r.is_appendix, r.clause_ids) for r in chunking.page_diagnostics(pages).collect()}
    assert flags["d", 3] == (True, []) and flags["d", 4] == (False, ["15-3-1"])
    chunks = chunking.chunk_pages(pages)
    assert [r.chunk_index for r in chunking.by_clause(chunks, "۱۵ - ۱", "15", children=True).collect()] == [1, 2, 3, 4, 6]
    assert chunking.clause_text(chunks, "15-1-3", "15").first().text == "15-1-3 Cars alpha" or "alpha" in chunking.clause_text(chunks, "15-1-3", "15").first().text
    assert {r.document_id: (r.pages, r.total_pages) for r in chunking.catalogue(chunks).collect()} == {"d": (3, 4), "e": (1, 1)}
    assert {r.document_id: r.root for r in chunking.clause_roots(pages.withColumn("text", F.translate("text", "۱۵", "15"))).collect()} == {"d": "15"}
    moved = chunking.corrected_roots(chunks, "d", "16").where("document_id = 'd' and clause_id is not null")
    assert all(r.section_id.startswith("16-") and r.chapter == "16" for r in moved.collect())
    with pytest.raises(ValueError):
        chunking.by_clause(chunks, "nonsense", "15")


@pytest.fixture(scope="module")
def corpus(spark):
    """Chunks of two documents; vectors along axes, so nearness is known."""
    rows, n = [], 0
    for doc in ("15 lifts", "4 roofs"):
        for section, parent, title in (("9-1", "", "Motor room"), ("9-1-1", "9-1", "Door sizes"), ("9-1-2", "9-1", "Vents"), ("9-2", "", "Pits")):
            for k in range(2):
                near = "" if k == 0 else f"c{n - 1}"
                rows.append((f"c{n}", doc, "", "regulation", section, parent, title, f"{title} of {doc} part {k} {'x' * 40}", "text", False, n, n, f"h{n}", near, f"c{n + 1}" if k == 0 else "", [1.0 if i == n else 0.1 for i in range(16)]))
                n += 1
    schema = "id string, document_id string, document_number string, domain string, section_id string, parent_section_id string, title string, text string, chunk_kind string, is_toc boolean, page_number int, chunk_index int, content_hash string, previous_section_chunk_id string, next_section_chunk_id string, embedding array<double>"
    return spark.createDataFrame(rows, schema)


def test_retrieval_finds_and_completes(spark, corpus):
    axis = lambda i: [1.0 if j == i else 0.0 for j in range(16)]
    questions = spark.createDataFrame([(1, "mabhas 15 door sizes"), (2, "what are vents")], "query_id long, question string")
    vectors = spark.createDataFrame([(1, 0, axis(2)), (1, 1, axis(3)), (2, 0, axis(4))], "query_id long, variant int, embedding array<double>")
    complete = questions.where("query_id = 1").select("query_id")
    got = retrieval.retrieve(questions, corpus, vectors, complete, candidates=6, k=2).collect()
    first = [r.id for r in sorted(got, key=lambda r: r.position) if r.query_id == 1]
    assert set(first[:2]) == {"c2", "c3"} and not any(r.weak for r in got)
    second = {r.id for r in got if r.query_id == 2}
    assert {"c4", "c5"} <= second  # the neighbour in the section comes along
    used = [r.used for r in sorted(got, key=lambda r: r.position) if r.query_id == 1]
    assert used == sorted(used)


def test_expansion_policy(spark, corpus):
    ranked = corpus.join(spark.createDataFrame([(1, "c2", 0.9, 0.2, 1), (1, "c4", 0.8, 0.2, 2), (2, "c0", 0.7, 0.9, 1), (3, "c6", 0.5, 0.1, 1)], "query_id long, id string, score double, heading double, rank int"), "id")
    complete = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {}
    for r in retrieval.expanded(ranked, corpus, complete).collect():
        got.setdefault(r.query_id, {})[r.id] = (r.reason, round(r.score, 4))
    # two ranked leaves share a parent that isn't ranked: all of it comes, once
    assert got[1]["c0"] == ("inferred_complete_parent", round(0.9 * 0.94, 4)) and got[1]["c3"] == ("complete_section", round(0.9 * 0.92, 4)) and "c6" not in got[1]
    # a fitting heading brings the sections below it
    assert {i for i in got[2]} == {"c0", "c1", "c2", "c3", "c4", "c5"} and got[2]["c5"][0] == "complete_section_tree"
    assert got[3] == {"c6": ("retrieved", 0.5), "c7": ("section_neighbor", 0.44)}


def test_context_budget_takes_whole_sections(spark, corpus):
    items = corpus.select(F.lit(1).cast("long").alias("query_id"), "id", (1 - F.col("chunk_index") / 100).alias("score"))
    cost = {r.id: len(r.text) + 120 for r in corpus.collect()}
    got = retrieval.assembled(items, corpus, budget=cost["c0"] + cost["c1"] + cost["c2"]).orderBy("position").collect()
    assert [r.id for r in got] == ["c0", "c1"] and got[-1].used == cost["c0"] + cost["c1"]
    same = corpus.withColumn("content_hash", F.lit("h"))
    assert [r.id for r in retrieval.assembled(items, same).collect()] == ["c0"]
    assert retrieval.assembled(items.where("false"), corpus).collect() == []


def test_citations_and_numbers(spark):
    text = "a [Clause 9–1, Page 3] b (بند ۹ - ۲، صفحه ۴) c Clause 9-3 p. 5 d [9-4, 6] 12.5 e [Document X y, Section 9-1 , Page ۷]"
    assert [tuple(c) for c in one(spark, answers.clause_citations(F.lit(text)))] == [("9-1", 3), ("9-2", 4), ("9-3", 5)]
    assert [tuple(c) for c in one(spark, answers.document_citations(F.lit(text)))] == [("X y", "9-1", 7)]
    assert one(spark, answers.numbers(F.lit("a -1,50 b x-3 ٢٫ 4"))) == [-1.5, 2.0, 4.0]
    said = "Total carbon is 5 kg\nThe standard area is 7 m2 [Clause 9-1, Page 3]\n8 doors"
    assert one(spark, answers.ungrounded_numbers(F.lit(said), F.lit("carbon 5"), F.lit("area 7"))) == []
    assert one(spark, answers.ungrounded_numbers(F.lit(said), F.lit("carbon 6"), F.lit("area 9"))) == [5.0, 7.0]
    assert one(spark, answers.unsupported_numbers(F.lit("1. five 5 and 6 [Clause 9-1, Page 3]"), F.lit("6"))) == ["5"]
    assert one(spark, answers.fact_covered(F.lit("Fire-Door: 90 cm"), F.array(F.array(F.lit("x")), F.array(F.lit("fire door"), F.lit("90cm")))))
    assert one(spark, answers.sections_meet(F.lit("9-1"), F.lit("9-1-2"))) and not one(spark, answers.sections_meet(F.lit("9-1"), F.lit("9-11")))
    assert one(spark, answers.doubts_a_number(F.lit("12.5 sure??"))) and one(spark, answers.asks_for_all(F.lit("please list them")))
    assert answers.json_object('```json\n{"a": 1}\n```') == {"a": 1}
    for bad in ("", "[1]", "{"):
        with pytest.raises(ValueError):
            answers.json_object(bad)


def test_checklist_takes_one_list(spark):
    asked = spark.createDataFrame([(1, "list all"), (2, "standards in the table")], "query_id long, question string")
    lines = "\n".join(f"{c}- item {k} word{k}" for k, c in enumerate("الف ب پ ت".split()))
    rows = [(1, 1, "d", "9-1", lines, ""), (1, 2, "d", "9-2", "ب- only one", ""), (2, 1, "d", "9-3", "", '[["Part","Standard"],["flange","ISO 7005"],["pipe","none"]]')]
    chunks = spark.createDataFrame(rows, "query_id long, position int, document_id string, section_id string, text string, table_data_json string")
    got = sorted((r.query_id, r.place, r.label, r.kind) for r in answers.checklist(asked, chunks).collect())
    assert [g[1:3] for g in got if g[0] == 1] == [(1, "الف- item 0 word0"), (2, "ب- item 1 word1"), (3, "پ- item 2 word2"), (4, "ت- item 3 word3")]
    assert [g[2:] for g in got if g[0] == 2] == [("ISO 7005", "exact")]
    said = spark.createDataFrame([(1, "first item word0; item word3"), (2, "ISO-7005")], "query_id long, answer string")
    covered = {(r.query_id, r.place): r.covered for r in answers.coverage(answers.checklist(asked, chunks), said).collect()}
    assert covered == {(1, 1): True, (1, 2): False, (1, 3): False, (1, 4): True, (2, 1): True}


def test_registry_and_state(spark):
    files = spark.createDataFrame([("P", "a", "ingested", 1, "/a"), ("P", "b", "uploaded", 2, "/b"), ("Q", "c", "ingested", 3, "/c")], "project_id string, file_id string, status string, uploaded_at int, stored_path string")
    assert [r.file_id for r in registry.resolve_scope(files, "P", None).collect()] == ["a"]
    with pytest.raises(LookupError):
        registry.resolve_scope(files, "P", ["zz"])
    with pytest.raises(ValueError):
        registry.resolve_scope(files, "P", ["b"])
    with pytest.raises(LookupError):
        registry.resolve_scope(files, "none", None)
    assert registry.patched(files, "P", "a", status="x").where("status = 'x'").count() == 1
    with pytest.raises(KeyError):
        registry.patched(files, "P", "zz", status="x")
    left, gone = registry.removed(files, "Q", ["c"])
    assert {r.project_id for r in left.collect()} == {"P"} and gone.count() == 1 and registry.removed(files, "Q", [])[1].count() == 0
    entries = spark.createDataFrame([("k", t, "MR" if t % 2 else "mr", "P", ["b", "a"] if t < 3 else ["a"]) for t in range(30)], "conv_id string, turn int, criterion string, project_id string, file_ids array<string>")
    kept = registry.ledger(entries)
    assert sorted(r.turn for r in kept.collect()) == [2, 29] and [r.turn for r in registry.findings_of(kept, "k", "P", ["a", "b"]).collect()] == [2]
    fits = registry.index_manifest(spark.createDataFrame([("d",)], "document_id string"), "3", "p", "m")
    assert registry.index_fits(fits, "3", "p", "m") and not registry.index_fits(fits, "3", "p", "n")
