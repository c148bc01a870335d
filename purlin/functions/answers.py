"""Checks of generated answers and routing of questions, as column expressions."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purlin.functions.text import LOCAL_DIGITS, nfkc, normalise_query, stripped, valid_source

# How citations, numbers, lists and kinds of questions are written.
DASH = "[-‐‑‒–—−]"
BRACKETED = rf"[\[(]\s*(?:(?:Clause|بند)\s*)?(\d+(?:\s*{DASH}\s*\d+)+)\s*[,،;؛]\s*(?:Page|p\.?|صفحه)\s*(\d+)\s*[\])]"
LABELLED = rf"(?:Clause|بند)\s+(\d+(?:\s*{DASH}\s*\d+)+)\s*[,،;؛]?\s*(?:Page|p\.?|صفحه)\s*(\d+)"
CLAUSE_CITATION = rf"(?i)(?:{BRACKETED}|{LABELLED})"
DOCUMENT_CITATION = r"(?i)\[Document\s+([^,\]\r\n]+)\s*,\s*Section\s+([^,\]\r\n]+)\s*,\s*Page\s+(\d+)\s*\]"
NUMBER = r"(?<![\w-])[-+]?\d+(?:[.,]\d+)?"
PLAIN_NUMBER = r"(?<![\w-])\d+(?:[./]\d+)?"
COMPLETENESS = (
    r"(?i)(?:همه|تمام|کامل|جا\s*افتاده|ادامه|بیشتر|فهرست|چه\s+مواردی|چه\s+نکاتی|استاندارد(?:ها|هایی)|الزامات|گزینه(?:ها|هایی)|ابعاد|ردیف(?:ها|هایی)|"
    r"\ball\b|\bcomplete\b|\bevery\b|\blist\b|\bstandards?\b|\brequirements?\b|\bdimensions?\b)"
)
NUMERIC_DOUBT = r"(?i)(?:\d|[۰-۹٠-٩]).{0,30}(?:[؟?]{2,}|یعنی|درست|اشتباه|مطمئن|واقعاً|واقعا)"
QUANTITY_LINE = r"(?i)(?:carbon|co2e|co₂e|factor|quantity|volume|area|mass|kg\b|m[²³23]\b|کربن|ضریب|مقدار|حجم|مساحت|جرم|کیلوگرم|متر\s*(?:مربع|مکعب))"
PROJECT_VALUE = r"(?i)(?:\b(?:project|building|model|BIM|IFC|calculated|estimated|total|contribution|result)\b|پروژه|ساختمان|مدل|محاسبه|برآورد|مجموع|سهم|نتیجه)"
CERTIFIED = (
    r"(?i)(?:\b(?:project|building)\b.{0,35}\b(?:is|achieves?|earns?|qualifies?\s+for|certified\s+as)\b.{0,20}\bLEED\s+(?:Certified|Silver|Gold|Platinum)\b|"
    r"(?:پروژه|ساختمان).{0,35}(?:دارای|کسب|واجد|گواهی).{0,25}(?:LEED|لید).{0,15}(?:طلایی|نقره[‌-]?ای|پلاتین|گواهی))"
)
STATES = ("satisfied_from_available_evidence", "not_satisfied_from_available_evidence", "insufficient_evidence", "not_automatically_evaluable")
LIST_ITEM = r"(?:^|\s)((?:الف|ب|پ|ت|ث|ج|چ|ح|خ|د|ذ|ر|ز|ژ|س|ش|ص|ض|ط|ظ|ع|غ|ف|ق|ک|گ|ل|م|ن|و|ه|ی))\s*[-–—]\s*(.+)$"
ASKS_VECTOR = r"(?i)\bpdfs?\b|\buploaded\s+(?:document|file|pdf)\b|(?:پی[‌\- ]?دی[‌\- ]?اف|سند\s+(?:بارگذاری|آپلود)\s*شده|فایل\s+(?:بارگذاری|آپلود)\s*شده)"
ASKS_GRAPH = r"(?i)\bIfc[A-Za-z][A-Za-z0-9_]*\b|\bNeo4j\b|\bCLASHES_WITH\b|\b(?:CLASH|CLEARANCE_VIOLATION|anomalyScore|isAnomaly)\b|(?:گره|نود|رابطه).{0,40}(?:نوع|تعداد|ویژگی|پراپرتی)"
REGULATION = r"(?i)(?:مقررات|ضوابط|استاندارد|الزام|مطابق|سند|منبع|LEED|پایداری|regulation|code|compliance|sustainab)"
LEED = r"(?i)(?:\bLEED\b|استاندارد\s+لید|معیار\s+LEED|اعتبار\s+LEED|(?:sustainability|sustainable|پایداری).{0,35}(?:requirement|standard|guidance|document|الزام|استاندارد|سند))"
SUSTAINABILITY = (
    r"(?i)(?:kg\s*co2e|kgco₂e|embodied\s+carbon|carbon\s+(?:footprint|contribution|result)|material\s+sustainability|sustainable\s+materials?|environmental\s+impact|"
    r"کربن\s+(?:نهفته|تجسم[‌-]?یافته|مجسم|محاسبه|برآورد|سهم)|سهم\s+کربن|ردپای\s+کربن|مصالح\s+پایدار|پایداری\s+مصالح|اثر(?:ات)?\s+زیست[‌-]?محیطی)"
)
PROJECT = r"(?i)(?:\bproject\b|\bmodel\b|\bBIM\b|\bIFC\b|\belement|material.{0,20}(?:largest|contribut)|پروژه|مدل|عنصر|مصالح|بیشترین\s+سهم|فایل\s+IFC|اطلاعات\s+موجود)"
ASSESS = r"(?i)(?:\b(?:evaluate|assess|satisf(?:y|ied)|evidence|enough|sufficient|available)\b|بررسی|ارزیابی|سنجش|کافی|شواهد|اطلاعات\s+موجود|برآورده|تأمین|تامین)"
ORDINARY = r"(?i)(?:\b(?:regulations?|building\s+code|construction\s+code)\b|مقررات|ضوابط|آیین[‌-]?نامه)"
CLASH_WORDS = r"(?:\bclash\b|\bclearance\b|کلش|تداخل|مدل\s*(?:ساختمان|بیم)?|عنصر\s*(?:شماره)?|این\s+(?:لوله|دیوار|تیر|عنصر))"
COMPLIANCE_WORDS = r"(?:مقررات|ضوابط|استاندارد|مطابق|مجاز|الزام|compliance|regulation|code)"
SOCIAL = ("سلام", "درود", "ممنون", "متشکرم", "سپاس", "خداحافظ", "خیلی خوب بود", "فهمیدم", "باشه", "thanks", "thank you", "hello", "hi")
GREEN_DOMAINS = ("leed", "standard", "sustainability")
SIMPLE_STOP = ("برای", "مورد", "این", "باید", "باشد", "است")
LINES = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def local_digits(text: Column) -> Column:
    return F.translate(text, *LOCAL_DIGITS)


def clause_form(clause: Column) -> Column:
    """A clause with plain digits and hyphens, without blanks around them."""
    return F.regexp_replace(stripped(local_digits(clause)), rf"\s*{DASH}\s*", "-")


def _groups(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def clause_citations(answer: Column) -> Column:
    """array of (clause, page): cited clauses, bracketed or labelled, in order."""
    text = local_digits(F.coalesce(answer, F.lit("")))
    pick = lambda a, b: F.zip_with(_groups(text, CLAUSE_CITATION, a), _groups(text, CLAUSE_CITATION, b), lambda x, y: F.when(x != "", x).otherwise(y))
    return F.zip_with(pick(1, 3), pick(2, 4), lambda c, p: F.struct(clause_form(c).alias("clause"), p.cast("int").alias("page")))


def document_citations(answer: Column) -> Column:
    """array of (document_id, section_id, page)."""
    text = local_digits(F.coalesce(answer, F.lit("")))
    both = F.zip_with(_groups(text, DOCUMENT_CITATION, 1), _groups(text, DOCUMENT_CITATION, 2), lambda d, s: F.struct(stripped(d).alias("document_id"), stripped(s).alias("section_id")))
    return F.zip_with(both, _groups(text, DOCUMENT_CITATION, 3), lambda x, p: F.struct(x["document_id"].alias("document_id"), x["section_id"].alias("section_id"), p.cast("int").alias("page")))


def without_citations(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(local_digits(text), CLAUSE_CITATION, ""), DOCUMENT_CITATION, "")


def source_clause(sources: DataFrame) -> DataFrame:
    """Regulation sources that may be cited, with ``clause`` in one form; ``named``: whether they have a clause."""
    named = valid_source(F.col("clause_id"))
    known = F.col("page_number").isNotNull() & (named | (valid_source(F.col("document_id")) & valid_source(F.col("section_id"))))
    return sources.where((F.coalesce("type", F.lit("regulation")) == "regulation") & known).withColumns({"clause": clause_form(F.col("clause_id")), "named": named})


def citation_faults(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, kind, cited, page) of what answers cite and none of their sources supports. ``sources`` by answer_id."""
    good = source_clause(sources)
    pairs = answers.select("answer_id", F.explode(clause_citations(F.col("answer"))).alias("c")).select("answer_id", F.col("c.clause").alias("cited"), F.col("c.page").alias("page")).distinct()
    triples = answers.select("answer_id", F.explode(document_citations(F.col("answer"))).alias("c"))
    triples = triples.select("answer_id", F.concat_ws("|", "c.document_id", "c.section_id").alias("cited"), F.col("c.page").alias("page")).distinct()
    allowed = good.where("named").select("answer_id", F.col("clause").alias("cited"), F.col("page_number").cast("int").alias("page"))
    documents = good.select("answer_id", F.concat_ws("|", F.trim("document_id"), F.trim("section_id")).alias("cited"), F.col("page_number").cast("int").alias("page"))
    keys = ["answer_id", "cited", "page"]
    return pairs.join(allowed, keys, "left_anti").withColumn("kind", F.lit("clause")).unionByName(triples.join(documents, keys, "left_anti").withColumn("kind", F.lit("document")))


def used_sources(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that aren't regulations, and those whose clause or section and page the answer cites."""
    cited = answers.select("answer_id", clause_citations(F.col("answer")).alias("pairs"), document_citations(F.col("answer")).alias("triples"))
    page = F.col("page_number").cast("int")
    pair = F.exists("pairs", lambda c: (c["clause"] == clause_form(F.col("clause_id"))) & (c["page"] == page))
    triple = F.exists("triples", lambda c: (c["document_id"] == F.trim("document_id")) & (c["section_id"] == F.trim("section_id")) & (c["page"] == page))
    joined = sources.join(cited, "answer_id")
    return joined.where((F.coalesce("type", F.lit("regulation")) != "regulation") | F.coalesce(pair, F.lit(False)) | F.coalesce(triple, F.lit(False))).drop("pairs", "triples")


def distinct_sources(sources: DataFrame, order: str = "place") -> DataFrame:
    """The first source of each key; regulations and others have keys of their own."""
    regulation = F.coalesce("type", F.lit("regulation")) == "regulation"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    key = F.when(regulation, F.concat_ws("\x01", F.lit("regulation"), F.coalesce("document_id", "source"), text("clause_id"), text("section_id"), text("page_number"))).otherwise(
        F.concat_ws("\x01", text("type"), F.coalesce("element_id", F.lit("\x00")), text("name"))
    )
    first = Window.partitionBy("answer_id", key).orderBy(order)
    return sources.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def canonical_citations(answer: Column) -> Column:
    """The answer with every citation of a clause or document in its public form."""
    text = F.regexp_replace(local_digits(F.coalesce(answer, F.lit(""))), CLAUSE_CITATION, r"[Clause $1$3, Page $2$4]")
    tight = F.regexp_replace(text, rf"(?<=\[Clause [^\]]{{0,40}}\d)\s*{DASH}\s*(?=\d)", "-")
    return F.regexp_replace(tight, DOCUMENT_CITATION, "[Document $1, Section $2, Page $3]")


def asks_for_all(question: Column) -> Column:
    return normalise_query(question).rlike(COMPLETENESS)


def doubts_a_number(question: Column) -> Column:
    return question.rlike(NUMERIC_DOUBT)


def numbers(text: Column) -> Column:
    """Distinct numbers of a text as doubles; a comma may be the decimal point."""
    found = F.regexp_extract_all(local_digits(F.coalesce(text, F.lit(""))), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")))


def ungrounded_numbers(answer: Column, evidence: Column, documents: Column) -> Column:
    """Numbers of the answer's quantity lines that neither the evidence holds nor, in lines that cite a document and don't
    speak of the project, the documents."""
    own, other = numbers(evidence), numbers(documents)

    def of_line(line: Column) -> Column:
        bare = without_citations(line)
        cited = local_digits(line).rlike(CLAUSE_CITATION) | local_digits(line).rlike(DOCUMENT_CITATION)
        allowed = F.when(cited & ~bare.rlike(PROJECT_VALUE), F.concat(own, other)).otherwise(own)
        return F.when(bare.rlike(QUANTITY_LINE), F.array_except(numbers(bare), allowed)).otherwise(F.array().cast("array<double>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(answer, F.lit("")), LINES), of_line))))


def unsupported_numbers(answer: Column, evidence: Column) -> Column:
    """Numbers as written that the answer has and the evidence doesn't; citations and list numbers don't count."""
    bare = F.regexp_replace(without_citations(answer), r"(?m)^\s*\d+\s*[.)-]\s*", "")
    found = lambda t: F.regexp_extract_all(local_digits(t), F.lit(PLAIN_NUMBER), F.lit(0))
    return F.array_sort(F.array_except(found(bare), found(evidence)))


def leed_language_fits(answer: Column, state: Column) -> Column:
    """No claim of certification, and no assessment but the deterministic one (null: none)."""
    text = F.coalesce(answer, F.lit(""))
    named = F.array_compact(F.array(*[F.when(text.rlike(rf"(?<![a-z_]){s}(?![a-z_])"), F.lit(s)) for s in STATES]))
    return ~text.rlike(CERTIFIED) & ((F.size(named) == 0) | (state.isNotNull() & (F.size(named) == 1) & F.coalesce(F.get(named, F.lit(0)) == state, F.lit(False))))


def compact(text: Column) -> Column:
    return F.regexp_replace(normalise_query(text), r"(?U)[\s._-]+", "")


def simple_terms(text: Column, compose: bool = True) -> Column:
    """Terms of three characters or more, without stop words. ``compose``: see ``normalise_text``."""
    found = F.regexp_extract_all(normalise_query(text, compose), F.lit(r"[A-Za-z]+(?:[.-]?\d+)*|[؀-ۿ]+|\d+(?:[.-]\d+)*"), F.lit(0))
    bare = F.transform(found, lambda t: F.btrim(t, F.lit("،؛؟؍٫٬")))
    return F.array_distinct(F.filter(bare, lambda t: (F.length(t) >= 3) & ~t.isin(list(SIMPLE_STOP))))


def list_items(text: Column) -> Column:
    """Lettered items of a text, one a line: "marker- body"."""
    lines = F.split(F.coalesce(text, F.lit("")), LINES)
    item = lambda x: F.concat(F.regexp_extract(x, LIST_ITEM, 1), F.lit("- "), stripped(F.regexp_extract(x, LIST_ITEM, 2)))
    return F.transform(F.filter(lines, lambda x: x.rlike(LIST_ITEM)), item)


def table_items(wanted: Column, standards: Column, rows: Column) -> Column:
    """Values of the table's column whose header shares most terms with the question (of all columns if none does); if the
    question asks for standards, those alone that look like one. ``wanted``: the question's terms; ``rows``: cells in NFKC
    form. All three must be plain columns, as no Python may stand within a lambda."""
    overlaps = F.transform(F.get(rows, F.lit(0)), lambda h: F.size(F.array_intersect(wanted, simple_terms(F.coalesce(h, F.lit("")), False))))
    top = F.array_max(overlaps)
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    columns = F.filter(F.sequence(F.lit(0), F.size(overlaps) - 1), lambda i: (top == 0) | (F.get(overlaps, i) == top))
    values = F.flatten(F.transform(columns, lambda i: F.transform(body, lambda r: stripped(F.coalesce(F.get(r, i), F.lit(""))))))
    fine = lambda v: (v != "") & (~standards | (v.rlike("[A-Za-z]") & v.rlike(r"\d")))
    return F.when(F.size(rows) >= 2, F.filter(values, fine)).otherwise(F.array().cast("array<string>"))


def checklist(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, place, label, kind): what a complete answer must name: the items of one section, the one with most.

    ``asked``: query_id, question; ``chunks`` of their contexts: query_id, position, document_id, section_id, text,
    table_data_json. Sections with a table, or of four items or more, can be it; a question for a table or standards prefers tables.
    """
    noted = asked.select("query_id", "question", simple_terms(F.col("question")).alias("wanted"), normalise_query(F.col("question")).rlike("(?:استاندارد|standard)").alias("standards"))
    cells = F.coalesce("table_data_json", F.lit(""))
    grid = chunks.select("query_id", "position", "document_id", "section_id", nfkc(F.coalesce("text", F.lit(""))).alias("text"), nfkc(cells).alias("cells"))
    rows = grid.join(noted, "query_id").withColumn("grid", F.from_json(F.nullif("cells", F.lit("")), "array<array<string>>"))
    exact = F.transform(F.when(F.col("grid").isNotNull(), table_items(F.col("wanted"), F.col("standards"), F.col("grid"))).otherwise(F.array().cast("array<string>")), lambda v: F.struct(v.alias("label"), F.lit("exact").alias("kind")))
    fuzzy = F.transform(list_items(F.col("text")), lambda v: F.struct(v.alias("label"), F.lit("fuzzy").alias("kind")))
    is_table = F.coalesce(F.size("grid") >= 2, F.lit(False))
    items = rows.select("query_id", "question", "document_id", "section_id", "position", is_table.alias("is_table"), F.concat(exact, fuzzy).alias("items"))
    sized = items.groupBy("query_id", "question", "document_id", "section_id").agg(F.sum(F.size("items")).alias("n"), F.max(F.col("is_table").cast("int")).alias("table"), F.min("position").alias("first"))
    able = sized.where("table = 1 or n >= 4")
    prefers = F.col("question").rlike(r"(?i)(?:جدول|ردیف|استاندارد|standards?|table|rows?)")
    order = [F.when(prefers, F.col("table")).otherwise(0).desc(), F.col("n").desc(), F.col("first")]
    chosen = able.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("r = 1").select("query_id", "document_id", "section_id")
    found = items.join(chosen, ["query_id", "document_id", "section_id"]).select("query_id", "position", F.posexplode("items").alias("pos", "i"))
    keyed = found.select("query_id", "position", "pos", "i.label", "i.kind", compact(F.col("i.label")).alias("key")).where("key != ''")
    once = keyed.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("position", "pos"))).where("r = 1")
    return once.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("position", "pos")).alias("place"), "label", "kind")


def coverage(items: DataFrame, answers: DataFrame) -> DataFrame:
    """``items`` with ``covered``: the answer (query_id, answer) holds the label, or two terms of a list item's body."""
    rows = items.join(answers, "query_id")
    body = F.when(F.col("kind") == "fuzzy", F.regexp_replace("label", "^[^-]*-", "")).otherwise(F.col("label"))
    terms = simple_terms(body)
    needed = F.least(F.lit(2), F.size(terms))
    shared = F.size(F.array_intersect(terms, simple_terms(F.col("answer"))))
    whole = F.contains(compact(F.col("answer")), compact(F.col("label")))
    return rows.withColumn("covered", whole | ((F.col("kind") == "fuzzy") & (needed > 0) & (shared >= needed))).drop("answer")


def fact_form(text: Column, compose: bool = True) -> Column:
    return F.regexp_replace(normalise_query(text, compose), r"(?U)[\s‌ـ_.,،؛:;()\[\]`*'\"-]+", "")


def fact_covered(text: Column, alternatives: Column) -> Column:
    """Whether the text has all terms of any alternative (array of arrays of terms in NFKC form)."""
    found = lambda plain: F.exists(alternatives, lambda terms: F.forall(terms, lambda t: F.contains(plain, fact_form(t, False))))
    return F.get(F.transform(F.array(fact_form(text)), lambda plain: found(plain)), F.lit(0))


def sections_meet(a: Column, b: Column) -> Column:
    """Equal sections, or one below the other."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("-"))) | F.startswith(b, F.concat(a, F.lit("-")))


def routed(questions: DataFrame, question: str = "question") -> DataFrame:
    """The guard over a router's decision. Columns needs_vector, needs_graph, needs_sustainability, needs_leed, is_technical
    and domains (array) are its decision (nulls take the defaults); none of them is ever narrowed but the vector search of a
    question for the graph alone."""
    q = F.col(question)
    have = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    topic, project, leed = q.rlike(SUSTAINABILITY), q.rlike(PROJECT), q.rlike(LEED)
    documents = leed | (topic & ~project)
    data = (topic & project) | (leed & project & q.rlike(ASSESS))
    own = F.array_distinct(F.coalesce(F.col("domains"), F.array().cast("array<string>")))
    green = F.array(*[F.lit(d) for d in GREEN_DOMAINS])
    domains = F.when(documents & q.rlike(ORDINARY), F.array_sort(F.concat(green, F.array(F.lit("regulation"))))).when(documents, F.array_sort(green)).otherwise(own)
    technical = have("is_technical", False) | documents | data
    vector = have("needs_vector", True) | documents | (F.size(domains) > 0)
    graph_asked = q.rlike(ASKS_GRAPH)
    vector = F.when(graph_asked & ~q.rlike(REGULATION), F.lit(False)).otherwise(vector)
    graph, green_data = have("needs_graph", True) | graph_asked, have("needs_sustainability", False) | data
    technical = technical | graph_asked
    final = vector | q.rlike(ASKS_VECTOR) | (technical & ~(vector | graph | green_data))
    return questions.withColumns(
        {"needs_vector": final, "needs_graph": graph, "needs_sustainability": green_data, "needs_leed": have("needs_leed", False) | (leed & data), "is_technical": technical, "domains": domains}
    )


def routed_without_router(questions: DataFrame, question: str = "question") -> DataFrame:
    """A decision where the router is out: small talk needs nothing; a follow-up (topic and last_vector known) goes where the
    last question went; others go by their words."""
    q = F.col(question)
    plain = stripped(F.regexp_replace(F.lower(q), r"[!؟?،,.\s]+", " "))
    social = plain.isin(list(SOCIAL))
    known = F.coalesce("topic", F.lit("")) != ""
    follows = known & F.col("last_vector").isNotNull()
    topic, project, leed = q.rlike(SUSTAINABILITY), q.rlike(PROJECT), q.rlike(LEED)
    documents, data = leed | (topic & ~project), (topic & project) | (leed & project & q.rlike(ASSESS))
    graph = q.rlike(ASKS_GRAPH) | plain.rlike(CLASH_WORDS)
    vector = plain.rlike(COMPLIANCE_WORDS) | documents | ~(graph | data)
    pick = lambda last, new: F.when(social, F.lit(False)).when(follows, F.coalesce(F.col(last), F.lit(False))).otherwise(new)
    more = known & ((F.length(stripped(q)) <= 40) | plain.rlike(r"(?:همه|تمام|کامل|ادامه|بیشتر|بازم|more|complete|continue)"))
    return questions.withColumns(
        {
            "needs_vector": pick("last_vector", vector), "needs_graph": pick("last_graph", graph), "needs_sustainability": pick("last_sustainability", data),
            "is_technical": ~social, "is_follow_up": ~social & known, "completeness_requested": ~social & more, "standalone_query": F.when(~social & known, F.concat("topic", F.lit(": "), q)).otherwise(q),
        }
    )


def json_object(text: str | None) -> dict[str, Any]:
    """The outermost JSON object of a model's response, fenced or not."""
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", (text or "").strip(), flags=re.I)
    first, last = bare.find("{"), bare.rfind("}")
    if first < 0 or last < first:
        raise ValueError("no JSON object in the response")
    found = json.loads(bare[first : last + 1])
    if not isinstance(found, dict):
        raise ValueError("the response isn't a JSON object")
    return found


def page_count_answer(question: Column, documents: DataFrame) -> DataFrame:
    """The document whose pages a question for a page count means: with a chapter number its documents, else all; none unless
    exactly one is left. ``question`` is one literal."""
    text = local_digits(question)
    chapter = F.regexp_extract(text, r"(?i)(?:مبحث|mabhas)\s*(\d{1,2})", 1)
    own = (F.coalesce("document_number", F.lit("")) == chapter) | F.regexp_extract("filename", r"^\s*(\d+)(?:\D|$)", 1).eqNullSafe(chapter)
    left = documents.where(text.rlike(r"(?i)(?:چند\s*صفحه|تعداد\s*صفحات|تعداد\s*صفحه|page\s*count|how\s+many\s+pages)")).where("total_pages > 0").where((chapter == "") | own)
    one = left.agg(F.count(F.lit(1)).alias("n"), F.min("filename").alias("filename"), F.min("total_pages").alias("total_pages"))
    return one.where("n = 1").drop("n")
