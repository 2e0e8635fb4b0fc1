from __future__ import annotations

import io
import json
import zipfile

import fixtures as X
import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark import cli, register
from docspark.core import single
from docspark.operators import adapters as A, chunks as C, edit as E, extract as EX, figures as FG, layout as L, render as RD, serialize as S, signals as SG, tagged as TG
from docspark.pdf.errors import PdfError
from docspark.pdf.image import decode_png
from docspark.sources import from_binary, parsed_tables, read_pdfs, read_pdfs_stream, register_data_source, validate
from docspark.streaming import chunk_stream

NAMES = [*X.ALL, "encrypted", "broken", "null"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, n, X.ALL[n]() if n in X.ALL else X.encrypted() if n == "encrypted" else b"%PDF-1.7 nothing" if n == "broken" else None) for i, n in enumerate(NAMES)]
    return spark.createDataFrame(rows, "doc_id bigint, name string, content binary")


@pytest.fixture(scope="module")
def parsed(docs):
    return from_binary(docs).cache()


def name_of(i: int) -> str:
    return NAMES[i]


def test_errors_are_rows(spark, docs, parsed):
    got = {name_of(r.doc_id): r.code for r in parsed_tables(parsed)["errors"].collect()}
    assert got == {"encrypted": "password_required_or_incorrect", "broken": "malformed_pdf", "null": "malformed_pdf"}
    own = docs.withColumn("pw", F.when(F.col("name") == "encrypted", "open-sesame"))
    assert from_binary(own, passwords="pw").where("error is null").count() == len(X.ALL) + 1
    assert {name_of(r.doc_id) for r in validate(docs).where("error is not null").collect()} == {"null"}
    assert from_binary(docs.limit(0)).count() == 0


def test_fused_chunks_are_those_of_one_document(parsed):
    made = {}
    for r in C.chunk_parsed(parsed, contextual_prefix=True).orderBy("doc_id", "chunk_ix").collect():
        made.setdefault(name_of(r.doc_id), []).append((r.kind, r.text, r.id, r.char_start, r.char_len, r.context, list(r.heading_path)))
    for n, f in X.ALL.items():
        want = [(c["kind"], c["text"], c["id"], c["char_start"], c["char_len"], c["context"], c["heading_path"]) for c in single.chunk_document(f(), contextual_prefix=True)]
        assert made.get(n, []) == want, n
    assert [x[:2] for x in made["tagged_minimal"]] == [("Heading", "Title"), ("Paragraph", "Paragraph."), ("Figure", "A pie chart")]


def test_tables_of_tagged_documents(parsed):
    t = parsed_tables(parsed)
    tree = TG.subtree(TG.node_text(t["nodes"], t["kids"], t["runs"]))
    blocks = TG.tagged_blocks(tree, TG.tagged_tables(tree))
    got = {name_of(r.doc_id): r for r in blocks.where("kind = 'Table'").collect()}
    grid = got["tagged_table"].table
    assert (grid["columns"], grid.header_rows, [[c.text for c in row] for row in grid.rows]) == (2, 1, [["Name", "Role"], ["Ada", "Eng"], ["Note", ""]])
    html = blocks.where("kind = 'Table'").select(S.table_to_html(F.col("table")).alias("h")).first().h
    assert html == '<table><thead><tr><th>Name</th><th>Role</th></tr></thead><tbody><tr><td>Ada</td><td>Eng</td></tr><tr><td colspan="2">Note</td></tr></tbody></table>'
    fused = next(c for c in single.chunk_document(X.tagged_table()) if c["table"])
    assert [[c["text"] for c in row] for row in fused["table"]["rows"]] == [["Name", "Role"], ["Ada", "Eng"], ["Note", ""]]


def test_html_with_rowspans(spark):
    cell = lambda t, c, cs=1, rs=1: {"text": t, "bbox": [0.0] * 4, "col": c, "colspan": cs, "rowspan": rs}
    table = {"columns": 3, "header_rows": 0, "rows": [[cell("a<", 0, 1, 2), cell("b", 1, 2), cell("", 2)], [cell("", 0), cell("c", 1), cell("d", 2)]]}
    more = {"columns": 2, "header_rows": 5, "rows": [[cell("x", 0, 2), cell("kept", 1)]]}
    from docspark import schema

    rows = spark.createDataFrame([(1, table), (2, more)], f"doc_id int, table {schema.TABLE}").select("doc_id", S.table_to_html(F.col("table")).alias("h"), S.table_to_csv(F.col("table")).alias("c"), S.grid_to_markdown(F.col("table")).alias("m"))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].h == '<table><tbody><tr><td rowspan="2">a&lt;</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></tbody></table>'
    assert got[2].h == '<table><thead><tr><th colspan="2">x</th><th>kept</th></tr></thead></table>'
    assert got[1].c == "a<,b,\n,c,d" and got[2].m == "| x | kept |\n| --- | --- |"


def test_serialized_chunks(spark, parsed):
    made = C.chunk_parsed(parsed)
    md = {name_of(r.doc_id): r.markdown for r in S.to_markdown(made).collect()}
    js = {name_of(r.doc_id): json.loads(r.json) for r in S.to_json(made).collect()}
    from docspark.core.markdown import to_markdown

    for n, f in X.ALL.items():
        chunks = single.chunk_document(f())
        if chunks:
            assert md[n] == to_markdown(chunks), n
            assert [c["text"] for c in js[n]] == [c["text"] for c in chunks] and ("table" in js[n][0]) == bool(chunks[0]["table"])
    assert "| Name | Role | Level |\n| --- | --- | --- |" in md["table_doc"] and "*Figure 1: Team roster table.*" in md["table_doc"]
    tabbed = spark.createDataFrame([("a\tb|\nc",), ("one\n",), ("x\ty\r\nz\tw\n",)], "t string").select(S.text_to_markdown(F.col("t")).alias("m")).collect()
    assert [r.m for r in tabbed] == ["| a | b\\| |\n| --- | --- |\n| c |  |", "one", "| x | y |\n| --- | --- |\n| z | w |"]


def test_signals_and_kinds(spark):
    docs = spark.createDataFrame([(0, X.born_digital()), (1, X.scanned()), (2, X.scanned(0.68, 2)), (3, X.scanned(0.3))], "doc_id bigint, content binary")
    t = parsed_tables(from_binary(docs))
    signals = SG.page_signals(t["pages"], t["runs"], t["draws"])
    assert {r.doc_id: r.kind for r in SG.classify(signals).collect()} == {0: "TextBased", 1: "Scanned", 2: "Mixed", 3: "ImageOnly"}


def test_figures_and_rules(parsed):
    t = parsed_tables(parsed)
    lines = L.lines(t["runs"])
    got = {name_of(r.doc_id): r for r in FG.image_regions(t["draws"], lines).collect()}
    assert got["figure_with_caption"].caption == "Figure 1: A sample chart." and got["scanned"].caption is None and got["scanned"].x1 == 612
    blocks = C.blocks_with(t["runs"], t["draws"], t["rules"])
    ruled = {name_of(r.doc_id): r for r in FG.lattices(blocks, t["rules"]).collect()}
    assert ruled["ruled_spanning"].col_x == [72.0, 250.0, 430.0] and ruled["ruled_spanning"].row_y == [712.0, 690.0, 670.0, 650.0]
    kept = FG.adopted_captions(C.blocks(t["runs"]), FG.image_regions(t["draws"], lines)).where("kind = 'Caption'")
    assert [name_of(r.doc_id) for r in kept.collect()] == ["table_doc"]
    lined = {(name_of(r.doc_id), r.vertical): r.boundaries for r in FG.rule_boundaries(t["rules"]).collect()}
    assert lined["ruled_spanning", True] == [72.0, 250.0, 430.0]


def test_edit_columns(spark):
    docs = spark.createDataFrame([(1, X.pages_doc(3), "a"), (2, X.pages_doc(2), "a"), (3, b"broken", "b"), (4, X.form(), "c")], "doc_id int, content binary, g string")
    row = lambda c: {r.doc_id: r.x for r in docs.select("doc_id", c.alias("x")).collect()}
    assert {k: (v.value, v.error) for k, v in row(E.page_count(F.col("content"))).items()} == {1: (3, None), 2: (2, None), 3: (None, "malformed_pdf"), 4: (1, None)}
    cut = row(E.split(F.col("content"), F.array(F.array(F.lit(1), F.lit(1)), F.array(F.lit(2), F.lit(2)))))
    assert cut[4].error == "page_out_of_range" and len(cut[1].value) == 2
    assert row(E.split(F.col("content"), F.array().cast("array<array<int>>")))[1].error == "empty_ranges"
    assert row(E.rotate_page(F.col("content"), F.lit(1), F.lit(45)))[1].error == "invalid_degrees"
    assert row(E.remove_pages(F.col("content"), F.array(F.lit(3))))[2].error == "page_out_of_range"
    filled = docs.select("doc_id", E.fill_form(F.col("content"), F.create_map(F.lit("name"), F.lit("Ada"))).value.alias("content"))
    assert filled.where("doc_id = 4").select(E.form_field_value(F.col("content"), F.lit("name")).value.alias("v")).first().v == "Ada"
    assert row(E.extract_text(F.col("content")))[1].value == "\n".join(f"Page number {i} body" for i in (1, 2, 3))
    merged = {r.g: r.merged for r in E.merge_groups(docs, by="g", order="doc_id").collect()}
    assert merged["a"].error is None and merged["b"].error == "expected_multiple_files"
    marked = docs.where("doc_id = 2").select(E.extract_text(E.watermark(F.col("content"), F.lit("DRAFT")).value).value.alias("t")).first().t
    assert marked.count("DRAFT") == 2
    z = docs.where("doc_id = 1").select(E.zip_parts(F.array("content", "content")).value.alias("z")).first().z
    assert zipfile.ZipFile(io.BytesIO(bytes(z))).namelist() == ["part-000.pdf", "part-001.pdf"]


def test_rendering_ocr_and_extraction(spark):
    docs = spark.createDataFrame([(1, X.scanned()), (2, X.born_digital()), (3, X.scanned(0.3))], "doc_id bigint, content binary").cache()
    drawn = {r.doc_id: r.i for r in docs.select("doc_id", RD.render(F.col("content"), F.lit(1), width=120).alias("i")).collect()}
    assert (drawn[1].width, drawn[1].height) == (120, 155) and decode_png(bytes(drawn[1].png))[70, 60].tolist() == [160] * 3
    assert docs.select(RD.render(F.col("content"), F.lit(1), width=50_000).error.alias("e")).first().e == "budget_exceeded"
    assert docs.select(RD.render(F.col("content"), F.lit(7)).error.alias("e")).first().e == "page_out_of_range"
    part = docs.where("doc_id = 1").select(RD.crop(F.col("content"), F.lit(1), F.array(*map(F.lit, (0.0, 0.0, 306.0, 396.0))), width=120).alias("c")).first().c
    assert (part.width, part.height) == (60, 78)
    with pytest.raises(PdfError):
        RD.renderer("pdfium")

    def provider():
        def read(image: np.ndarray) -> dict:
            if image.mean() > 200:
                raise PdfError("backend_error", "blank")
            return {"text": "recognised", "confidence": 1.0, "words": [{"text": "recognised", "x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0, "confidence": 1.0}]}

        return read

    t = parsed_tables(from_binary(docs))
    texts = t["pages"].select("doc_id", "page").join(L.page_text(L.lines(t["runs"])), ["doc_id", "page"], "left")
    kinds = SG.classify(SG.page_signals(t["pages"], t["runs"], t["draws"]))
    got = {r.doc_id: r for r in RD.extract_with_ocr(docs, texts, kinds, provider).collect()}
    assert got[1].text == "recognised" and got[1].png is None
    assert got[2].text.startswith("Line 1") and got[2].png is None and not got[2].recognised
    assert got[3].text == "" and got[3].png is not None
    pages = t["pages"]
    auto = {r.doc_id: r for r in EX.extract(texts, pages).collect()}
    assert auto[1].image_pages == [1] and auto[2].image_pages == [] and auto[2].text.startswith("Line 1")
    assert {r.doc_id: r.image_pages for r in EX.extract(texts, pages, mode="both").collect()} == {1: [1], 2: [1], 3: [1]}
    assert {r.text for r in EX.extract(texts, pages, mode="images").collect()} == {""}
    asked = spark.createDataFrame([(1, [1, 1]), (2, [2])], "doc_id bigint, pages array<int>")
    some = {r.doc_id: r for r in EX.extract(texts, pages, mode="text", requested=asked).collect()}
    assert some[2].error == "page_out_of_range" and some[2].text is None and some[1].pages_processed == [1, 1]
    assert EX.page_errors(pages, spark.createDataFrame([(1, 1), (1, 9)], "doc_id bigint, page int")).count() == 1
    with pytest.raises(ValueError):
        EX.extract(texts, pages, mode="other")


@pytest.mark.parametrize("cap", [0, 1, 3, 4, 5, 6, 7, 100])
def test_capped_joins_agree(spark, cap):
    cases = [["ab", "cd"], ["", "", "ab"], ["abcd", "", ""], ["abcd", "", "x"], ["abc", "d"], [], ["", ""], ["abcdefgh"]]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t array<string>").select("i", EX.join_capped(F.col("t"), cap).alias("j")).collect()
    assert {r.i: (r.j.text, r.j.truncated) for r in got} == {i: single.join_capped(c, cap) for i, c in enumerate(cases)}


def test_adapters(spark):
    rows = spark.createDataFrame([("t", [bytes([1, 2, 3, 4, 5]), bytes(100)]), ("", [])], "t string, p array<binary>")
    got = [r.b for r in rows.select(A.to_message_content(F.col("t"), F.col("p")).alias("b")).collect()]
    assert [x.type for x in got[0]] == ["text", "image", "image"] and got[0][1].data == "AQIDBAU=" and "\n" not in got[0][2].data and got[1] == []
    assert rows.select(A.to_data_urls(F.col("p")).alias("u")).first().u[0] == "data:image/png;base64,AQIDBAU="


def test_sources_and_streams(spark, tmp_path):
    for n in ("born_digital", "multi_heading"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.pdf").write_bytes(X.ALL[n]())
    (tmp_path / "in" / "other.txt").write_text("x")
    got = read_pdfs(spark, str(tmp_path / "in")).collect()
    assert sorted(r.doc_id.rsplit("/", 1)[1] for r in got) == ["born_digital.pdf", "multi_heading.pdf"]
    register_data_source(spark)
    assert spark.read.format("docspark_pdf").load(str(tmp_path / "in")).count() == 8 + 9
    query = chunk_stream(read_pdfs_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 + 7
    (tmp_path / "in" / "late.pdf").write_bytes(X.table_doc())
    chunk_stream(read_pdfs_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 + 7 + 2


def test_sql_names(spark, docs):
    assert set(register.register(spark)) >= {"docspark_page_count", "docspark_chunks"}
    docs.where("content is not null").createOrReplaceTempView("pdf_docs")
    got = {r.name: r.n for r in spark.sql("select name, docspark_page_count(content) as n from pdf_docs").collect()}
    assert got["outline_and_links"] == 2 and got["broken"] is None
    rows = spark.sql("select name, c.kind, c.text from pdf_docs, lateral docspark_chunks(content) c where name = 'table_doc'").collect()
    assert [r.kind for r in rows] == ["Table", "Caption"]


def test_command_line(tmp_path, capsys, monkeypatch):
    path = tmp_path / "a.pdf"
    path.write_bytes(X.multi_heading())
    assert cli.main([str(path)]) == 0 and "Chapter One" in capsys.readouterr().out
    assert cli.main(["extract", str(path), "--json"]) == 0 and json.loads(capsys.readouterr().out)["pages_processed"] == [1]
    assert cli.main(["chunk", str(path), "--format", "md"]) == 0 and "## Section A" in capsys.readouterr().out
    assert cli.main(["chunk", str(path), "--context"]) == 0 and json.loads(capsys.readouterr().out)[1]["context"] == "Headed > Chapter One (p.1)"
    assert cli.main(["chunk", str(path), "--format", "text"]) == 0 and cli.main(["structure", str(path)]) == 0 and '"tagged": false' in capsys.readouterr().out
    path.write_bytes(X.outline_and_links())
    assert cli.main(["outline", str(path)]) == 0 and [x["title"] for x in json.loads(capsys.readouterr().out)] == ["Chapter 1", "Chapter 2"]
    path.write_bytes(X.figure_with_caption())
    assert cli.main(["figures", str(path)]) == 0 and json.loads(capsys.readouterr().out)[0]["caption"] == "Figure 1: A sample chart."
    assert cli.main(["render", str(path), "-o", str(tmp_path / "o.png"), "--dpi", "36"]) == 0 and decode_png((tmp_path / "o.png").read_bytes()).shape == (396, 306, 3)
    path.write_bytes(X.encrypted())
    assert cli.main([str(path)]) == 3
    (tmp_path / "pw").write_text(" open-sesame\n")
    assert cli.main([str(path), "--password-file", str(tmp_path / "pw")]) == 0
    assert cli.main([str(tmp_path / "none.pdf")]) == 1 and cli.main(["render"]) == 2 and cli.main(["render", str(path), "--password", "open-sesame", "--page", "9"]) == 1
    assert cli.main(["render", str(path), "--backend", "pdfium"]) == 1


def test_matrix_columns(spark):
    from docspark.functions import geometry as G

    row = spark.createDataFrame([(3.0, 4.0)], "c double, d double").select(G.vertical_scale(F.col("c"), F.col("d")).alias("s")).first()
    assert row.s == 5.0


def test_file_sink(spark, tmp_path):
    from docspark.sources import write_files

    rows = [("a/one.pdf", X.born_digital()), ("two.png", b"png"), ("../out", b"x"), ("/abs", b"x"), (None, b"x"), ("three", None), ("..", b"x")]
    made = write_files(spark.createDataFrame(rows, "n string, c binary"), str(tmp_path), name="n", content="c")
    for _ in range(2):  # a second run replaces the files
        got = {r.name: (r.length, r.error) for r in made.collect()}
    assert got["a/one.pdf"] == (len(X.born_digital()), None) and got["two.png"] == (3, None)
    assert got["three"][1] == "no_content" and {got[k][1] for k in ("../out", "/abs", None, "..")} == {"bad_name"}
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a/one.pdf", "two.png"]
    md = spark.createDataFrame([("x.md", "# é")], "n string, c string")
    write_files(md, str(tmp_path), name="n", content="c").collect()
    assert (tmp_path / "x.md").read_text(encoding="utf-8") == "# é"
