"""Literal cases of elements, sheets, versions and enhanced queries."""

import json
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators import hybrid, metadata, retrieval
from siltstone.sources import sheets

# elements


def test_images_of_three_forms_do_not_overlap():
    text = "Text one. [IMAGE_1: cat] ![x](a.png) <img src=\"b.gif\" alt='no'> [IMAGE_2: in ![y](c.png)] ![<img src='d'>](e.jpg) [IMAGE_3: ]"
    got = [(x["content"], x["alt"], x["source"], x["number"]) for x in sorted(hybrid.image_elements(text), key=lambda x: x["start"])]
    assert got == [
        ("[Image: cat]", "cat", None, 0), ("[Image: x]", "x", "a.png", None), ("[Image: b.gif]", "", "b.gif", None), ("[Image: in ![y]", "in ![y", None, 1),
        ("[Image: <img src='d'>]", "<img src='d'>", "e.jpg", None), ("[Image]", "", None, 2),
    ]


def test_placeholders_find_their_pictures(spark):
    docs = spark.createDataFrame([(1, "[IMAGE_1: own] and [IMAGE_2: two] ![m](x/y.JPG)"), (2, "[IMAGE_1: own]"), (3, None), (4, "")], "doc_id long, text string")
    images = hybrid.extract_elements(docs, "image")
    pictures = spark.createDataFrame([(1, 0, "alt", "cap", "/p/0.png", None), (1, 1, None, "cap", "/p/1", "image/webp"), (2, 5, "no", None, "z", None)], "doc_id long, image_index int, alt_text string, caption string, file_path string, mime_type string")
    got = {(r["doc_id"], r["start"]): (r["content"], r["source"], r["format"]) for r in hybrid.with_pictures(images, pictures).collect()}
    assert got == {(1, 0): ("[Image: alt]", "/p/0.png", "png"), (1, 19): ("[Image: cap]", "/p/1", "webp"), (1, 34): ("[Image: m]", "x/y.JPG", "jpg"), (2, 0): ("[Image: own]", None, None)}


def test_chunk_hybrid_rows(spark):
    text = "# A\n\nOne. Two.\n\n## B [IMAGE_1: cat] said.\n\n|h|i|\n|-|-|\n|1|2|\n\nEnd of it."
    got = hybrid.chunk_hybrid(spark.createDataFrame([(7, text), (8, None)], "doc_id long, text string"), "paragraph").orderBy("chunk_index").collect()
    assert [(r["chunk_type"], r["content"], r["section_title"]) for r in got] == [
        ("text", "# A\n\nOne. Two.\n\n## B", None), ("image", "[Image: cat]", "## B"), ("text", "said.", "## B [IMAGE_1: cat]"),
        ("table", "|h|i|\n|-|-|\n|1|2|", "## B [IMAGE_1: cat] said."), ("text", "End of it.", "## B [IMAGE_1: cat] said."),
    ]
    image, table = got[1], got[3]
    assert image["context_before"] == "## B" and image["context_after"].startswith("said.") and (table["row_count"], table["column_count"], table["headers"]) == (1, 2, ["h", "i"])


def test_surroundings():
    near = hybrid.Surroundings("intro\n# One\nx # no\n  ## Two  \n#nothing\n# ")
    text = near.text
    assert near.title(3) is None and near.title(text.index("x # no")) == "# One" and near.title(len(text)) == "## Two" and near.title(text.index("# One") + 2) is None
    assert near.title(text.index("# One") + 4) == "# On"
    before, after = hybrid.Surroundings("a" * 20 + ". tail X. rest " + "b" * 40).window(27, 28)
    assert before == "tail" and after == ". rest " + "b" * 40
    assert hybrid.Surroundings("abc").window(0, 3) == ("", "")


def test_long_documents_of_many_elements_take_time_in_proportion():
    part = "# H\n\n" + "word " * 20 + "\n\n|a|b|\n|-|-|\n|1|2|\n\n"
    def took(n):
        began = time.perf_counter()
        hybrid.hybrid_chunks(part * n, "none")
        return time.perf_counter() - began
    took(100)
    assert took(4000) < 12 * max(took(1000), 0.01)


# sheets


def test_sheet_pages(spark):
    pages = [(1, 1, "A", "Sheet: A\nk\tv\n1\t2\t3"), (1, 2, "B", "  "), (1, 3, "C", "plain text\n\nmore"), (1, 4, None, None), (1, 5, "E", "a\tb\nx\ny"), (2, 1, "Z", "only\tone line")]
    got = hybrid.chunk_sheet_pages(spark.createDataFrame(pages, "doc_id long, page_number int, sheet_name string, text string")).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["chunk_index"], r["sheet_name"], r["chunk_type"], r["start"], r["end"]) for r in got] == [(1, 0, "A", "table", 0, 18), (1, 1, "C", "text", 24, 40), (1, 2, "E", "text", 44, 51), (2, 0, "Z", "text", 0, 13)]
    assert (got[0]["row_count"], got[0]["column_count"], got[0]["headers"]) == (2, 3, ["k", "v"])
    assert hybrid.chunk_sheet_pages(spark.createDataFrame([], "doc_id long, page_number int, sheet_name string, text string")).count() == 0


@pytest.mark.parametrize(
    ("answer", "markdown", "names"),
    [
        ({"json_content": {"groups": [{"name": "sheet: A"}, {"label": "SHEET:B "}, {"name": "x"}, {"name": "sheet: A"}]}, "groups": [{"name": "sheet: Z"}]}, "", ["A", "B"]),
        ({"json_content": json.dumps({"furniture": {"children": [{"label": "a Sheet", "text": "F"}, {"label": "y", "text": "G"}]}})}, "", ["F"]),
        ({"json_content": "broken", "groups": [{"name": "sheet: C"}]}, "## Sheet: D", ["C"]),
        ({"body": {"groups": [{"name": "sheet:  E "}]}}, "", ["E"]),
        ({}, "x\n## Sheet: G one\n##  sheet: H\n### Sheet: no", ["G one", "H"]),
        ({"sections": [{"type": "worksheet", "name": "S"}, {"title": "sheet: T"}, {"name": "u"}]}, "", ["S", "T"]),
        ("not json", "", []), (None, None, []), ([1], "", []), ({"groups": ["x", 1]}, "", []),
    ],
)
def test_sheet_names(answer, markdown, names):
    assert sheets.sheet_names(answer, markdown) == names


def test_split_by_sheets():
    assert sheets.split_by_sheets("|a|\n|1|\n\n|b|\n", ["A", "B"]) == [(1, "A", "|a|\n|1|", 8), (2, "B", "|b|", 4)]
    assert sheets.split_by_sheets("one\n\n\n\ntwo\n\nstill", ["A", "B"]) == [(1, "A", "one", 3), (2, "B", "two\n\nstill", 10)]
    five = "\n\n".join("12345")
    assert [t for *_, t, _ in sheets.split_by_sheets(five, ["A", "B", "C"])] == ["1\n\n2", "3\n\n4", "5"]
    assert [t for *_, t, _ in sheets.split_by_sheets("1\n\n2", ["A", "B", "C"])] == ["1", "2", ""]
    assert sheets.split_by_sheets("", ["A"]) == [(1, "A", "", 0)] and sheets.split_by_sheets("text", []) == []


# versions


VERSION = "document_id long, strategy string, result_id long, params map<string,string>, version long, previous_id long, is_active boolean"


def saved(rows):
    return sorted((r["document_id"], r["version"], r["result_id"], r["previous_id"], r["is_active"]) for r in rows.collect())


def test_saving_a_version_replaces_or_appends(spark):
    size = lambda n: {"chunk_size": str(n), "overlap": "50"}
    rows = [(1, "s", 10, size(500), 1, None, False), (1, "s", 11, size(500), 2, 10, True), (2, "s", 20, size(500), 1, None, True), (3, "s", 30, size(500), 1, None, False), (4, "s", 40, size(0), 1, None, True)]
    new = [(1, "s", 12, size(512)), (2, "s", 21, size(2000)), (3, "s", 31, size(500)), (4, "s", 41, size(1)), (5, "s", 50, size(1)), (1, None, 60, size(9))]
    got = metadata.save_versions(spark.createDataFrame(rows, VERSION), spark.createDataFrame(new, "document_id long, strategy string, result_id long, params map<string,string>"))
    assert saved(got) == [
        (1, 1, 10, None, False), (1, 1, 60, None, True), (1, 2, 12, 10, True), (2, 1, 20, None, False), (2, 2, 21, 20, True), (3, 1, 30, None, False), (3, 2, 31, None, True),
        (4, 1, 40, None, False), (4, 2, 41, 40, True), (5, 1, 50, None, True),
    ]


def test_activation_is_exclusive(spark):
    rows = [(1, "s", 10, {}, 1, None, False), (1, "s", 11, {}, 2, 10, True), (1, "t", 12, {}, 1, None, True), (2, "s", 20, {}, 1, None, True), (None, "s", 30, {}, 1, None, False), (None, "s", 31, {}, 2, 30, True)]
    df = spark.createDataFrame(rows, VERSION)
    on = lambda asked: sorted(r["result_id"] for r in metadata.activate(df, spark.createDataFrame(asked, "result_id long, turn int")).filter("is_active").collect())
    assert on([]) == [11, 12, 20, 31] and on([(10, 1)]) == [10, 12, 20, 31] and on([(10, 2), (11, 1), (99, 1), (30, 1)]) == [10, 12, 20, 30] and on([(10, 1), (11, 1)]) == [11, 12, 20, 31]


@pytest.mark.parametrize(
    ("old", "new", "change"),
    [
        ({"chunk_size": "500"}, {"chunk_size": "600"}, "minor"), ({"chunk_size": "500"}, {"chunk_size": "601"}, "major"), ({"chunk_size": "0"}, {"chunk_size": "0.0"}, "none"),
        ({"chunk_size": "0"}, {"chunk_size": "1"}, "major"), ({"a": "1"}, {"a": "1.01"}, "major"), ({"a": "1"}, {"a": "1", "b": "2"}, "major"), ({"separator": "x"}, {"separator": "y"}, "major"),
        ({"separator": "x", "overlap": "10"}, {"separator": "x", "overlap": "12"}, "minor"), ({}, {"a": "1"}, "major"), (None, {"a": "1"}, "major"),
    ],
)
def test_change_of_parameters(spark, old, new, change):
    df = spark.createDataFrame([(old, new)], "o map<string,string>, n map<string,string>")
    assert df.select(metadata.parameter_change(F.col("o"), F.col("n"))).first()[0] == change


# enhanced queries


@pytest.mark.parametrize(
    ("answer", "rewritten", "is_complex", "subs", "parsed"),
    [
        ('{"rewritten_query": " r ", "is_complex": true, "sub_queries": ["a", "", 1, " b", {"x": 1}]}', "r", True, ["a", "b"], True),
        ('```json\n{"rewritten_query": "r", "is_complex": false, "sub_queries": ["a"]}\n```', "r", False, [], True),
        ('```\n{"rewritten_query": "r", "is_complex": "yes", "sub_queries": ["a"]}', "r", True, ["a"], True),
        ('{"is_complex": [1], "sub_queries": "a"}', "q", True, [], True), ('{"rewritten_query": "r", "is_complex": 0}', "r", False, [], True), ('{"rewritten_query": "r", "is_complex": {}}', "r", False, [], True),
        ('{"rewritten_query": 5, "is_complex": true, "sub_queries": ["a"]}', "q", False, [], False), ("[1]", "q", False, [], False), ("{broken", "q", False, [], False),
        ("", "q", False, [], False), (None, "q", False, [], False), ("```", "q", False, [], False), ("null", "q", False, [], False), ('{"rewritten_query": "  "}', "q", False, [], True),
    ],
)
def test_enhanced_queries(spark, answer, rewritten, is_complex, subs, parsed):
    r = spark.createDataFrame([(answer, "q")], "a string, q string").select(retrieval.parse_enhancement(F.col("a"), F.col("q")).alias("e")).first()["e"]
    assert (r["rewritten"], r["is_complex"], r["sub_queries"], r["all_queries"], r["parsed"]) == (rewritten, is_complex, subs, [rewritten, *subs], parsed)


# uploads, inverted index, context


def test_uploads(spark):
    from siltstone.sources import files

    rows = [("a/b.PDF", 1), ("b.tar.gz", 1), (".txt", 1), ("c.md", 0), ("d.md", files.UPLOAD_BYTES), ("e.md", files.UPLOAD_BYTES + 1), (None, 5), ("f.md", None), ("noend", 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, s long").select(files.validate_upload(F.col("n"), F.col("s"))).collect()]
    assert got == [None, "Unsupported file format: .gz", "Unsupported file format: ", "Empty file not allowed", None, "File size exceeds limit: 52428801 bytes", "Unsupported file format: ", "Empty file not allowed", "Unsupported file format: "]


def test_inverted_search_reads_only_near_lists(spark):
    import random

    from siltstone.operators import dense

    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 60 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    c = v.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("list"), F.col("embedding").alias("c"))
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())
    exact = key(dense.search(v, q, 5))
    assert key(dense.inverted_search(v, q, c, 5, probes=15)) == exact and key(dense.inverted_search(v, q, c, 5, probes=99, part=7)) == exact
    some = key(dense.inverted_search(v, q, c, 5, probes=3))
    assert {(a, x): s for a, _, x, s in some if (a, x) in {(b, y) for b, _, y, _ in exact}}.items() <= {(a, x): s for a, _, x, s in exact}.items() and some != exact
    assert dense.inverted_search(v.limit(0), q, c, 5).count() == 0


def test_context_of_search_results(spark):
    rows = [(1, 1, 10, "one", "file", 0.9), (1, 2, 11, None, None, 0.3), (1, 3, 12, "low", "x", 0.29), (1, 4, 13, "last", "", None), (2, 1, 14, "two", "y", 0.5)]
    found = spark.createDataFrame(rows, "query_id long, place long, chunk_id long, text string, name string, score double")
    items = retrieval.context_items(found)
    assert [tuple(r) for r in items.orderBy("query_id", "index").collect()] == [(1, 1, "file", 0.9, "one", 10), (1, 2, "来源 2", 0.3, "", 11), (2, 1, "y", 0.5, "two", 14)]
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, query string")
    got = {r["query_id"]: (r["prompt"], r["sources"], r["files"]) for r in retrieval.prompt_of(items.join(asked, "query_id")).collect()}
    assert got[1] == ("[1] one\n来源：file\n\n[2] \n来源：来源 2\n\n问题：why?", 2, ["file", "来源 2"])


def test_markdown_and_structured_text_of_a_page():
    from siltstone.sources import html

    page = "<title>T</title><body><p>Hello <b>bold</b> <a href='/x'>link</a></p><ul><li>a <i>b</i><li></ul><figure><img src=s alt=A><figcaption>Cap</figcaption></figure><p><img src=t alt=B></p><p>x<img src=u></p><b>strong</b><pre><code>y = 1\n</code></pre><pre>no</pre><a href='#k'>k</a></body>"
    root = html.parse(page)
    assert html.to_markdown(root) == "# T\n\nHelloboldlink\n\n- ab\n\n[IMAGE_1: Cap]\n\nCap\n\n[IMAGE_2: B]\n\nx\n\n**strong**\n\n```\ny = 1\n\n```\n\nk"
    assert html.structured_text(html.parse("<h2>H</h2><div>d<img alt=q></div><p></p><ol><li>a<li>b</ol>")) == "\n## H\n\nd\n\n[IMAGE_1: q]\n\n\n1. a\n1. b\n"


def test_images_of_a_page():
    from siltstone.sources import html

    got = html.images(html.parse("<p>a<b>b</b> <img src='data:image/png;base64,AA' style='width:3px'>c</p><img srcset='x.JPG?v=1 2x,, y 3w'><img data-lazy-src=z.unknown title=t height=4>" + "<i>" + "w " * 80 + "</i>tail"))
    assert [(x["src"], x["mime"], x["is_base64"], x["width"], x["height"], x["before"], x["after"][:4]) for x in got] == [
        ("data:image/png;base64,AA", "image/png", True, "3px", None, "a b", "c"), ("x.JPG?v=1", "image/jpeg", False, None, None, "abc", ("w " * 50)[:4]), ("z.unknown", None, False, None, "4", "abc", "w w "),
    ]
    assert got[1]["srcset"] == [{"url": "x.JPG?v=1", "descriptor": "2x"}, {"url": "y", "descriptor": "3w"}] and len(got[2]["after"]) == 100 and got[2]["caption"] == "t"


def test_hybrid_chunks_of_more_documents_than_are_held_at_once(spark):
    from siltstone.operators import hybrid

    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"text {i}\n![p{i}](u{i})\nmore") for i in range(3 * hybrid.AT_ONCE + 1)], "doc_id long, text string").coalesce(1)
    x = hybrid.chunk_hybrid(df)
    assert "MapInArrow" in x._jdf.queryExecution().executedPlan().toString()
    got = [(r["doc_id"], r["chunk_index"], r["content"]) for r in x.filter("chunk_type = 'image'").orderBy("doc_id").collect()]
    assert got == [(i, 1, f"[Image: p{i}]") for i in range(3 * hybrid.AT_ONCE + 1) if i % 7]
