"""Literal cases whose results were worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import analysis, chunking, dense, headings, index_maintenance, metadata, retrieval, sparse
from siltstone.sources import files, html, loading, office


@pytest.mark.parametrize(("n", "spans"), [(500, [(0, 500)]), (501, [(0, 500), (450, 501)]), (950, [(0, 500), (450, 950)]), (1200, [(0, 500), (450, 950), (900, 1200)]), (0, [])])
def test_character_windows(spark, n, spans):
    df = spark.createDataFrame([(1, "x" * n)], "doc_id long, text string")
    assert [(r["start"], r["end"]) for r in chunking.chunk_character(df).orderBy("chunk_index").collect()] == spans


def test_windows_reject_a_step_over_the_size(spark):
    with pytest.raises(ValueError, match="step"):
        chunking.chunk_windows(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 10, 11)


def test_null_and_blank_texts_give_no_chunks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "   ")], "doc_id long, text string")
    assert chunking.chunk_character(df).count() == 0
    assert chunking.chunk_paragraph(df).count() == 0
    assert chunking.chunk_parent(df).count() == 0


CORPUS = [(0, "red fox jumps"), (1, "red dog sleeps soundly"), (2, "blue fox"), (3, "green green tree")]


def test_bm25(spark):
    df = spark.createDataFrame(CORPUS, "chunk_id long, text string")
    corpus = sparse.corpus_statistics(df)
    vocab = sparse.vocabulary(sparse.document_frequencies(df), corpus)
    assert corpus.first()["avgdl"] == 3.0
    ids = {r["term"]: r["term_id"] for r in sparse.with_term_ids(vocab).collect()}
    assert ids == {"blue": 0, "dog": 1, "fox": 2, "green": 3, "jumps": 4, "red": 5, "sleeps": 6, "soundly": 7, "tree": 8}
    w = sparse.encode_documents(sparse.term_counts(df, "chunk_id"), vocab, corpus, "chunk_id")
    got = {(r["term"], r["chunk_id"]): r["weight"] for r in w.collect()}
    assert got["red", 0] == 0.693147 and got["red", 1] == 0.602737 and got["fox", 2] == 0.815467 and got["green", 3] == 1.719961
    q = sparse.encode_queries(spark.createDataFrame([(9, "red fox")], "query_id long, text string"), vocab, "query_id")
    s = {r["chunk_id"]: r["score"] for r in sparse.score(w, q, "chunk_id", "query_id").collect()}
    assert s == pytest.approx({0: 0.960906, 2: 0.565239, 1: 0.417785}, abs=2e-6)


def test_bm25_of_one_text_has_no_vocabulary(spark):
    df = spark.createDataFrame(CORPUS[:1], "chunk_id long, text string")
    assert sparse.vocabulary(sparse.document_frequencies(df), sparse.corpus_statistics(df)).count() == 0


@pytest.mark.parametrize("by", [(), ("label",)])
def test_search_with_more_queries_than_one_block(spark, sf, by):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    q = v.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = lambda most: sorted(tuple(r) for r in dense.search(v, q, 5, by=by, most=most).collect())
    assert q.count() > 8 and rows(8) == rows(4096)


def test_rrf(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, k long, rank long")
    two = spark.createDataFrame([(1, 10, 3)], "query_id long, k long, rank long")
    got = {r["k"]: r["rrf_score"] for r in retrieval.rrf_fuse([one, two], "k", 5).collect()}
    assert got == {10: 0.032266458, 11: 0.016129032}


def test_threshold_refills_to_five(spark):
    rows = [(1, i, s) for i, s in enumerate([0.9, 0.6, 0.46, 0.44, 0.3, 0.2, 0.1])]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, score double")
    got = retrieval.threshold(df).orderBy("final_rank").collect()
    assert [r["score"] for r in got] == [0.9, 0.6, 0.46, 0.44, 0.3]
    assert [r["backfilled"] for r in got] == [False, False, True, True, True]


def test_near_dedup_keeps_the_better_and_exempts_one_document(spark):
    rows = [(1, 1, 1, 0.9, "the quick brown fox"), (1, 2, 2, 0.8, "the quick brown cat"), (1, 3, 1, 0.7, "the quick brown fog")]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, doc_id long, score double, text string")
    assert {(r["a"], r["b"]): r["jaccard"] for r in retrieval.near_pairs(df).collect()}[1, 2] == 0.7
    assert sorted(r["vec_id"] for r in retrieval.near_dedup(df).collect()) == [1, 3]


def test_exact_dedup_keeps_the_winning_document(spark):
    rows = [(1, 1, 7, 0.9, 1, "a "), (1, 2, 8, 0.8, 2, "a"), (1, 3, 7, 0.7, 3, " a"), (1, 4, 8, 0.1, 4, " "), (1, 5, 9, 0.1, 5, "")]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, doc_id long, score double, position long, text string")
    assert sorted(r["vec_id"] for r in retrieval.exact_dedup_cross_doc(df).collect()) == [1, 3, 4, 5]


def test_changes_and_plan(spark):
    a = spark.createDataFrame([(1, "h1"), (2, "h2"), (4, "h4")], "chunk_id long, hash string")
    b = spark.createDataFrame([(1, "h1"), (2, "x"), (3, "h3")], "chunk_id long, hash string")
    c = metadata.detect_changes(a, b)
    assert {r["chunk_id"]: r["change"] for r in c.collect()} == {1: "unchanged", 2: "modified", 3: "new", 4: "deleted"}
    p = metadata.incremental_plan(c).first()
    assert (p["to_embed"], p["savings_percent"]) == (2, 33.3)


def test_ema_folds_a_group_in_several_ranges(spark):
    import random

    rng = random.Random(2)
    rows = [("a" if i % 10 else "b", i // 3, i, rng.random() * 100) for i in range(30000)] + [("c", 1, 1, 5.0), ("d", 1, 1, None), ("d", 2, 2, 1.0), (None, 1, 1, 2.0), (None, 1, 2, 4.0)]
    want = {}
    for g, _, _, v in rows:
        want[g] = None if v is None or (g in want and want[g] is None) else v if g not in want else want[g] * 0.9 + v * (1 - 0.9)
    df = spark.createDataFrame(rows, "g string, at long, id long, v double").repartition(7)
    got = metadata.ema(df, ["g"], "v", ["at", "id"])
    assert {r["g"]: r["ema"] for r in got.collect()} == {g: None if v is None else pytest.approx(v, abs=2e-6) for g, v in want.items()}
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "MapInArrow" in plan and "rangepartitioning" in plan  # no task gathers the rows of a group


def test_parameter_change(spark):
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    row = spark.range(1).select(
        metadata.parameter_change(m("chunk_size", 500.0), m("chunk_size", 512.0)).alias("a"),
        metadata.parameter_change(m("chunk_size", 500.0), m("chunk_size", 2000.0)).alias("b"),
        metadata.parameter_change(m("chunk_size", 500.0), m("chunk_size", 500.0, "overlap", 1.0)).alias("c"),
    ).first()
    assert tuple(row) == ("minor", "major", "major")


def test_heading_sections(spark):
    df = spark.createDataFrame([(1, "lost\n# A\nx\n## B\ny\n# C\nz"), (2, "# only\none")], "doc_id long, text string")
    got = headings.sections(df).orderBy("chunk_index").collect()
    assert [(r["title"], r["path"]) for r in got] == [("A", "A"), ("B", "A > B"), ("C", "C")]
    assert got[1]["content"] == "## B\ny"
    parents = {r["seq"]: r["parent"] for r in headings.heading_parents(headings.heading_rows(df)).filter("doc_id = 1").collect()}
    assert parents == {1: None, 2: 1, 3: None}


def test_texts_with_fewer_than_two_headings_go_to_the_paragraph_chunker(spark):
    df = spark.createDataFrame([(1, "# A\nx\n## B\ny"), (2, "# only\none"), (3, "plain"), (4, None)], "doc_id long, text string")
    joined = headings.sections_or_paragraphs(df).orderBy("doc_id", "chunk_index").collect()
    assert [(r["title"], r["content"], r["merged_headings"]) for r in joined if r["doc_id"] == 1] == [("A", "# A\nx\n\n## B\ny", "B")]
    html = spark.createDataFrame([(1, "a <h2>One</h2> b <H3> Two </H3>\n# Three")], "doc_id long, text string")
    assert [(r["start"], r["level"], r["title"]) for r in headings.heading_rows(html).orderBy("seq").collect()] == [(2, 2, "One"), (17, 3, "Two"), (32, 1, "Three")]
    got = headings.sections_or_paragraphs(df, least=0).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["title"], r["content"], r["fallback"]) for r in got] == [(1, "A", "# A\nx", False), (1, "B", "## B\ny", False), (2, None, "# only\none", True), (3, None, "plain", True)]


def test_every_page_with_text_gives_a_chunk(spark, sf):
    from siltstone.plans import source_queries

    want = {r["page_id"] for r in source_queries.md(spark, sf).filter(F.length(F.trim("text")) > 0).collect()}
    assert {r["page_id"] for r in source_queries.QUERIES["chunk_heading_pages"](spark, sf).select("page_id").collect()} == want


def test_html():
    root = html.parse('<h1>T</h1><ol><li>a<li>b</ol><a href="#x">n</a><a href="/y">m</a><script>x()</script>')
    assert html.to_markdown(root).split("\n") == ["# T", "", "1. a", "2. b", "", "n", "[m](/y)"]
    root = html.parse("<table><caption>c</caption><tr><th>a<th>b<tr><td>1</table><figure><img data-src=p alt=q><figcaption>f</figcaption></figure>")
    assert html.tables(root) == [{"headers": ["a", "b"], "rows": [["1"]], "caption": "c"}]
    assert html.table_markdown(["a", "b"], [["1"]]).split("\n") == ["| a | b |", "| --- | --- |", "| 1 |  |"]
    assert [{k: x[k] for k in ("src", "alt", "caption", "after")} for x in html.images(root)] == [{"src": "p", "alt": "q", "caption": "f", "after": "f"}]
    assert html.to_markdown(html.parse(None)) == ""


def test_json_lines():
    assert files.flattened({"a": {"b": [1, True, None]}}) == ["a.b[0]: 1", "a.b[1]: True", "a.b[2]: null"]


def test_properties(spark):
    df = spark.createDataFrame([(1, "# c\nk=v:w\nx: y\n\nnone")], "doc_id long, text string")
    assert [(r["key"], r["value"]) for r in files.scan_properties(df, "text", ["doc_id"]).orderBy("line_no").collect()] == [("k", "v:w"), ("x", "y")]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h,i\n1,\n2,b\n")
    assert sorted(r["text"] for r in files.scan_csv(spark, str(tmp_path / "a.csv")).collect()) == ["h: 1 | i: ", "h: 2 | i: b"]
    (tmp_path / "a.txt").write_text("one\ntwo\nthree")
    assert loading.scan_text(loading.binary_files(spark, str(tmp_path / "a.txt"))).first()["line_count"] == 3


def test_content_hash(spark):
    got = spark.createDataFrame([("",), (None,), ("a",)], "t string").select(T.content_hash(F.col("t"))).collect()
    assert got[0][0] == got[1][0] == "sha256:" + "0" * 64 and got[2][0].startswith("sha256:ca978112")


def test_line_uniformity_and_params(spark):
    df = spark.createDataFrame([("a" * 10 + "\n" + "b" * 20 + "\n" + "c" * 30, "pdf", 1000), ("x", "pdf", 60000), ("x", "csv", 1000)], "t string, f string, n long")
    size, over = analysis.adaptive_params(F.col("f"), F.col("n"))
    got = df.select(analysis.line_uniformity(F.col("t")).alias("u"), size.alias("s"), over.alias("o")).collect()
    assert got[0]["u"] == 0.592 and [(r["s"], r["o"]) for r in got] == [(480, 75), (1200, 225), (300, 0)]


def test_recommend_model(spark):
    df = spark.createDataFrame([(1, "en", 1.0, "technical", 0.95, False, False)], "doc_id long, language string, language_confidence double, domain string, domain_confidence double, has_images boolean, has_tables boolean")
    got = [(r["model"], r["score"]) for r in analysis.recommend_model(df).orderBy("rank").collect()]
    assert got == [("qwen3-embedding-8b", 0.872775), ("bge-m3", 0.831825), ("qwen3-vl-embedding-8b", 0.830062)] or math.isclose(got[2][1], 0.830063)


def test_tfidf_of_sentences(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma. alpha beta delta. omega psi.")], "doc_id long, text string")
    s = chunking.sentence_rows(df)
    w = {(r["sentence_index"], r["term"]): round(r["weight"], 6) for r in chunking.tfidf_sentences(s).collect()}
    assert w[0, "alpha"] == 0 and w[0, "gamma"] == 0.135155 and w[2, "psi"] == 0.202733
    assert [r["similarity"] for r in chunking.adjacent_similarity(s).orderBy("sentence_index").collect()] == [0.0, 0.0]


def test_sentence_weights_shuffle_once_and_keep_odd_rows(spark):
    """All of it stays within a document, so its sentences are shuffled once; sentences without words, rows without a document."""
    df = spark.createDataFrame([(1, "alpha beta beta. 12 34. beta gamma. beta gamma. delta"), (2, "one"), (3, None), (None, "a. a b")], "doc_id long, text string")
    s = chunking.sentence_rows(df)
    for out in (chunking.tfidf_sentences(s), chunking.adjacent_similarity(s)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {(r["doc_id"], r["sentence_index"]): r["similarity"] for r in chunking.adjacent_similarity(s).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 0.0, (1, 3): 1.0, (1, 4): 0.0, (None, 1): 0.0}
    w = {(r["doc_id"], r["sentence_index"], r["term"]): round(r["weight"], 6) for r in chunking.tfidf_sentences(s).collect()}
    assert w == {(1, 0, "alpha"): round(math.log(5 / 2) / 3, 6), (1, 0, "beta"): round(2 / 3 * math.log(5 / 4), 6), (1, 2, "beta"): round(math.log(5 / 4) / 2, 6), (1, 2, "gamma"): round(math.log(5 / 3) / 2, 6),
                 (1, 3, "beta"): round(math.log(5 / 4) / 2, 6), (1, 3, "gamma"): round(math.log(5 / 3) / 2, 6), (1, 4, "delta"): round(math.log(5 / 2), 6), (2, 0, "one"): round(math.log(1 / 2), 6)}


def test_windows_are_cut_and_reversed_once(spark):
    """A window that moves back to a mark is one expression, however many marks are looked for."""
    df = spark.createDataFrame([(1, "a. " * 900 + "x" * 300)], "doc_id long, text string")
    x = chunking.chunk_parent(df)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1 and plan.count("substring(") == 2
    assert [(r["start"], r["end"]) for r in x.orderBy("start").collect()] == [(0, 1997), (1800, 3000)]


def test_lists_are_found_for_few_rows_at_once(spark, monkeypatch):
    from siltstone.operators import dense

    most, nearest = [], dense._nearest
    monkeypatch.setattr(dense, "RANKED", 7)
    monkeypatch.setattr(dense, "_nearest", lambda ids, c, v, n: most.append(len(v)) or nearest(ids, c, v, n))
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<double>").coalesce(1)
    c = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "list long, c array<double>")
    seen = {}
    monkeypatch.setattr(type(v), "mapInPandas", lambda self, f, schema: seen.update(run=f) or self)
    dense.in_lists(v, c)
    out = list(seen["run"](iter([v.toPandas()])))
    assert max(most) == 7 and [x for p in out for x in p["list"]] == [i % 5 for i in range(40)]


def test_coverage(spark):
    df = spark.createDataFrame([(1, a, b) for a, b in [(0, 10), (5, 15), (15, 20), (30, 40), (7, 7)]], "doc_id long, start long, end long")
    assert chunking.chunk_coverage(df).first()["covered"] == 30


def test_records():
    got = chunking.paragraphs("a1: x\nb2: y\nc3: z")
    assert [c for c, *_ in got] == ["a1: x", "b2: y", "c3: z"] and all(r for *_, r in got)


def test_streaming_upsert(spark, tmp_path):
    from siltstone.streaming import ingest

    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    for rows in ([(1, "one text"), (2, "two")], [(1, "one text"), (2, "two changed")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        ingest.upsert(ingest.chunk_stream(spark, src), out, mark).awaitTermination()
    got = [(r["chunk_id"], r["content"]) for r in spark.read.parquet(out).orderBy("batch", "chunk_id").collect()]
    assert got == [("1-0", "one text"), ("2-0", "two"), ("2-0", "two changed")]


def test_merged_sentences_flush_before_the_sentence_that_reaches_the_least():
    from siltstone.operators import chunking

    text = ". ".join(c * 200 for c in "abc") + "."
    assert [(len(c), a, b) for c, a, b, _ in chunking.merged_sentences(text)] == [(200, 0, 200), (200, 202, 402), (200, 404, 605)]


def test_hybrid_elements():
    from siltstone.operators import hybrid

    text = "# T\n\nBefore it.\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```py\nx = 1\ny = 2\nz = 3\n```\n\n![alt](u.png) after"
    got = hybrid.hybrid_chunks(text, "paragraph")
    assert [c["kind"] for c in got] == ["text", "table", "code", "image", "text"]
    assert (got[1]["rows"], got[1]["columns"], got[1]["headers"], got[1]["section_title"]) == (1, 2, ["a", "b"], "# T")
    assert (got[2]["language"], got[2]["content"]) == ("py", "x = 1\ny = 2\nz = 3")
    assert all(text[c["start"] : c["end"]].strip() for c in got) and hybrid.hybrid_chunks("") == []


def test_office_files_with_merged_cells_pictures_and_damage(spark):
    w = "<document><body><p><r><t>One</t><tab/><t>two</t><br/><t>x</t></r><hyperlink><r><t> link</t></r></hyperlink></p><p><r><drawing><docPr descr='A cat'/><blip/></drawing></r></p><p/>"
    w += "<tbl><tr><tc><tcPr><gridSpan val='2'/></tcPr><p><r><t>H</t></r></p></tc></tr><tr><tc><tcPr><vMerge val='restart'/></tcPr><p><r><t>a</t></r></p></tc><tc><p/></tc></tr><tr><tc><tcPr><vMerge/></tcPr><p/></tc></tr></tbl></body></document>"
    bomb = "<!DOCTYPE d [<!ENTITY a 'b'>]><document><body/></document>"
    files_ = [("good", office.zipped({"word/document.xml": w})), ("bomb", office.zipped({"word/document.xml": bomb})), ("none", None), ("empty", b""), ("other", office.zipped({"x": "y"}))]
    got = office.read_office(spark.createDataFrame(files_, "path string, content binary"), "docx").collect()
    text = "One\ttwo\nx link\n\n[IMAGE_1: A cat]\n\n| H | H |\n| --- | --- |\n| a |  |\n| a |  |"
    assert [(r["kind"], r["text"]) for r in got if r["path"] == "good" and r["kind"] != "table"] == [("page", text), ("document", text)]
    assert {r["path"] for r in got if r["kind"] == "error"} == {"bomb", "none", "empty", "other"}


def test_sheets_keep_gaps_and_types(spark, tmp_path):
    rel = '<Relationships><Relationship Id="r1" Target="/xl/worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>'
    ns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    a = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row><row r="3"><c r="B3"><v>2.50</v></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>'
    book = office.zipped({"xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="A" r:id="r1"/><sheet name="B" r:id="r2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rel,
                          "xl/sharedStrings.xml": "<sst><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>", "xl/worksheets/a.xml": a, "xl/worksheets/b.xml": "<worksheet><sheetData/></worksheet>"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(book)
    (tmp_path / "in" / "note.txt").write_text("x")
    got = {r["kind"]: r for r in office.scan_office(spark, str(tmp_path), "xlsx").collect()}
    assert set(got) == {"page", "table", "document"}
    assert got["page"]["text"] == "Sheet: A\nrich\t\tTrue\n\t\t\n\t2.5\t7\n"
    assert got["table"]["rows"] == [["", "", ""], ["", "2.5", "7"]]
    assert office.read_office(spark.createDataFrame([], "path string, content binary"), "xlsx").count() == 0


def test_first_rule_of_a_text_strategy_wins(spark):
    df = spark.createDataFrame(
        [(1, "XLSX", True, True, True, False, False, 0), (2, "csv", False, False, True, False, False, 0), (3, "csv", None, None, None, None, None, None), (4, "txt", True, False, True, True, True, 9),
         (5, "PPT", True, False, False, False, True, 9), (6, "json", True, False, False, False, True, 9), (7, None, True, False, False, False, True, 5), (8, "md", True, False, False, False, True, 4)],
        "i int, fmt string, layout boolean, flat boolean, log boolean, slides boolean, clear boolean, n int",
    )
    got = df.select("i", analysis.recommend_text_strategy(*[F.col(c) for c in df.columns[1:]]).alias("r")).orderBy("i").collect()
    assert [(r["r"]["strategy"], r["r"]["rule"]) for r in got] == [
        ("paragraph", "flattened table"), ("paragraph", "sheet without layout"), ("semantic", "default"), ("paragraph", "log"), ("paragraph", "slides"), ("paragraph", "records"), ("heading", "headings"), ("semantic", "default")]


def test_queries_are_stripped_and_bounded(spark):
    df = spark.createDataFrame([(0, None), (1, " \t"), (2, " a b "), (3, " " + "x" * 2000), (4, "x" * 2001)], "i int, q string")
    got = [tuple(r["v"]) for r in df.select("i", retrieval.validate_query(F.col("q")).alias("v")).orderBy("i").collect()]
    assert got == [(None, "empty"), (None, "empty"), ("a b", None), ("x" * 2000, None), (None, "too long")]


def test_search_falls_back_to_dense_without_statistics(spark):
    asked = spark.createDataFrame([(1, 7, "auto"), (2, 7, "dense_only"), (3, 8, "hybrid"), (4, None, None), (5, 7, None)], "i int, index_id int, mode string")
    got = retrieval.search_modes(asked, spark.createDataFrame([(7,), (7,), (None,)], "index_id int")).orderBy("i").collect()
    assert [r["search_mode"] for r in got] == ["hybrid", "dense_only", "dense_only", "dense_only", "hybrid"]


def test_chunk_text_of_pictures(spark):
    rows = [(0, "text", "c", "a", "t", "b", "f", True, True), (1, "image", "c", "Image", None, None, "", True, True), (2, "image", "c", "a", "t", "b" * 201 + "!", "f" * 300, True, True),
            (3, "image", "c", "a", "t", "b" * 201 + "!", "f" * 300, True, False), (4, "image", "c", "a", "t", "b", "f", None, True)]
    df = spark.createDataFrame(rows, "i int, kind string, content string, alt string, caption string, before string, after string, path boolean, loaded boolean")
    got = [r["t"] for r in df.select("i", index_maintenance.prepare_chunk_text(*[F.col(c) for c in df.columns[1:]]).alias("t")).orderBy("i").collect()]
    assert got == ["c", "c", "图片标题: t\n图片描述: a\n前文: " + "b" * 199 + "!\n后文: " + "f" * 200, "t a " + "b" * 149 + "! " + "f" * 150, "c"]


@pytest.mark.parametrize(("text", "want"), [
    ("", ""), ("plain (x)", "plain (x)"), ("a ![b](c(d)e) f", "a [IMAGE_1: b] f"), ("![](x)![y](z)", "[IMAGE_1: 图片][IMAGE_2: y]"), ("![a](b(c) ![d](e)", "![a](b(c) [IMAGE_1: d]"),
    ("![" + "x" * 501 + "](y)", "![" + "x" * 501 + "](y)"), (f"one\ncat {files.BROKEN_IMAGE} now -->\n![p](q)", "one\n[IMAGE_2: cat]\n[IMAGE_1: p]"), (f"{files.BROKEN_IMAGE} open", f"{files.BROKEN_IMAGE} open"),
])
def test_pictures_become_placeholders(text, want):
    assert files.placeholders(text) == want


def test_lines_of_a_text_are_taken_once(spark):
    df = spark.createDataFrame([("a,b\n" * 40, "csv"), ("a line of 20 characters\nanother of 20 characters\n\n third of 20 characters", "xlsx"), ("", "csv"), (None, "csv")], "text string, fmt string")
    t, f = F.col("text"), F.col("fmt")
    exprs = [analysis.is_flattened_tabular(t, f), analysis.line_uniformity(t), analysis.is_log_like(t), analysis.is_structured(t)]
    for e in exprs:
        assert df.select(e.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = df.select(*[e.alias(str(i)) for i, e in enumerate(exprs)]).collect()
    assert [tuple(r) for r in got[:3]] == [(False, 0.0, False, False), (True, 0.98, False, False), (False, 0.0, False, False)]


def test_keyword_hits(spark):
    df = spark.createDataFrame([("the latest api of a database",), ("合同 and 变量",), ("",), (None,)], "text string")
    hits = [r["h"] for r in df.select(analysis.keyword_hits(F.col("text")).alias("h")).collect()]
    # test (in latest) counts for technical and medical, api and database for technical; 变量 for technical and academic
    assert analysis.domains_of() == list(analysis.DOMAINS) and hits[0][0] >= 3 and hits[0][2] == 1 and hits[2] == [0] * len(analysis.DOMAINS) and hits[3] is None
    assert hits[1][:2] == [1, 1] and hits[1][4] == 1
    plan = analysis.domain_shares(df.withColumn("doc_id", F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert "hits(" in plan and "contains" not in plan.lower()


def test_windows_count_a_text_once_and_strip_every_white_space(spark):
    """The number of characters stands once in the plan, not at every window; contents are stripped of the same characters as by `text.strip`."""
    df = spark.createDataFrame([(1, " \t\r\n\f\x0b é中  x" * 9 + "\x0b\f "), (2, ""), (3, None), (4, " \n\t")], "doc_id long, text string")
    found = chunking.chunk_windows(df, 7, 5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("length(text") == 1
    cut = df.select("doc_id", F.explode(chunking.window_starts(F.length("text").cast("long"), 7, 5)).alias("s"), "text").select("doc_id", "s", T.strip(F.substring("text", (F.col("s") + 1).cast("int"), F.lit(7))).alias("content"))
    want = sorted((r["doc_id"], r["s"], r["content"]) for r in cut.collect() if r["content"])
    assert sorted((r["doc_id"], r["start"], r["content"]) for r in found.collect()) == want and want
