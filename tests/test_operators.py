"""Operators on small tables: quality, OCR words, layout, links, context, Markdown, sinks, pipeline, streaming; nulls, ties, empty tables."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchflow import exporters, options, schema, sinks
from parchflow.operators import blocks as B
from parchflow.operators import engines, layout, links, ocr, quality, sequences
from parchflow.options import ReaderMissingError, formats_known, normal_formats, target_paths
from parchflow.plans.pipeline import Pipeline, progress
from parchflow.sources import engine, pdf
from parchflow.streaming import blocks as S


def pages(spark, rows):
    return spark.createDataFrame(rows, schema.PAGES)


def test_sampling(spark):
    want = {0: [], 1: [0], 5: [0, 1, 2, 3, 4], 6: [0, 1, 3, 4, 5], 100: [0, 1, 50, 98, 99]}
    got = {r.n: r.v for r in spark.createDataFrame([(n,) for n in want], "n int").select("n", quality.sample_pages(F.col("n")).alias("v")).collect()}
    assert got == want
    few = lambda m: spark.createDataFrame([(10,)], "n int").select(quality.sample_pages(F.col("n"), m).alias("v")).first().v
    assert (few(1), few(2), few(3), few(4), few(9)) == ([0], [0, 9], [0, 5, 9], [0, 1, 5, 9], [0, 1, 5, 8, 9])


def test_quality(spark):
    rows = [(1, 1, 1, False, "readable words " * 5), (2, 1, 1, True, ""), (3, 1, 1, None, "�" * 20 + "word " * 20), (4, 1, 1, False, "few"), (5, 1, 1, False, None)]
    got = {r.doc_id: r for r in quality.quality_report(pages(spark, rows)).collect()}
    assert [got[i].recommended_strategy for i in range(1, 6)] == ["native_text"] + ["ocr_fallback"] * 4
    assert got[2].reason.startswith("Nenhum") and got[2].has_images and got[3].corruption_ratio == pytest.approx(20 / 120, abs=1e-4)
    assert "(3 caracteres" in got[4].reason and got[5].total_chars == 0 and got[1].pages_sampled == [0]
    assert {r.strategy for r in quality.detect_strategy(pages(spark, rows), True).collect()} == {"ocr_fallback"}
    assert quality.quality_report(pages(spark, [])).count() == 0


def test_percent_is_rounded_as_binary(spark):
    x = [i / 10_000 for i in range(0, 10_001, 7)] + [0.9255, 0.0005, 0.0015, 0.1235]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", F.format_string("%.1f%%", quality.percent(F.col("x"))).alias("p")).collect()
    assert [r.p for r in got] == [f"{r.x:.1%}" for r in got]


def words(spark, rows):
    return spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], schema.OCR_WORDS)


def test_ocr_words(spark):
    w = words(spark, [(1, 1, 2, 10, 30, 5, 5, 90.0, "c"), (1, 1, 1, 10, 10, 5, 5, 3.0, "a"), (1, 1, 1, 20, 10, 5, 8, None, " b "), (1, 1, 1, 0, 0, 1, 1, -1.0, "noise"), (2, 1, 1, 0, 0, 1, 1, 1.0, " "), (1, 2, 1, 4, 4, 4, 4, 1.0, "z")])
    got = {(r.block_num, r.par_num): r for r in ocr.word_blocks(w, scale=2.0).collect()}
    assert set(got) == {(1, 1), (1, 2)} and got[1, 1].raw_text == "a b\nc" and got[1, 1].normalized_text == "a b c"
    assert (got[1, 1].x0, got[1, 1].y0, got[1, 1].x1, got[1, 1].y1) == (5.0, 5.0, 12.5, 17.5)
    t = ocr.text_blocks(pages(spark, [(1, 1, 1, False, " a\nb\n\n\n\nc"), (2, 1, 1, False, None)]))
    assert [(r.doc_id, r.normalized_text) for r in t.orderBy("doc_id", "block_no").collect()] == [(1, "a b"), (1, "c")]
    assert spark.range(1).select(ocr.tesseract_config(None, 1, " x ").alias("v")).first().v == "--oem 1 x"


def order(*boxes, tables=()):
    return layout.reading_order(np.array(boxes, float).reshape(-1, 4), np.array([i in tables for i in range(len(boxes))], bool))


def test_layout(spark):
    two = [(0, 0, 500, 20), (0, 40, 240, 90), (260, 40, 500, 90), (0, 100, 240, 150), (260, 100, 500, 150), (0, 170, 500, 190)]
    assert order(*two) == [0, 1, 3, 2, 4, 5] and order() == [] and order((0, 0, 1, 1)) == [0]
    rows = [(1, 1, i, False, *map(float, b)) for i, b in enumerate(two)] + [(1, 2, 9, False, None, 0.0, 1.0, 1.0), (1, 2, 10, True, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, block_no int, is_table boolean, x0 double, y0 double, x1 double, y1 double")
    got = [(r.page_number, r.block_no) for r in layout.sort_blocks(df.repartition(5)).orderBy("page_number", "page_ord").collect()]
    assert got == [(1, 0), (1, 1), (1, 3), (1, 2), (1, 4), (1, 5), (2, 10), (2, 9)]
    pairs = {(r.top_no, r.bottom_no) for r in layout.stacked_pairs(df.where("page_number = 1")).collect()}
    assert pairs == {(1, 3), (2, 4), (0, 5)} - {(0, 5)}
    box = spark.createDataFrame([(1, 1, 0.0, 35.0, 250.0, 160.0)], "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    assert {r.block_no for r in layout.outside_tables(df.where("page_number = 1"), box).collect()} == {0, 2, 4, 5}


def test_links(spark):
    w = spark.createDataFrame([(1, 1, 0, 0, i, i * 10.0, 0.0, i * 10.0 + 8, 8.0, t) for i, t in enumerate(["see", "the", "site", "now", "ok"])], schema.WORDS_RAW)
    k = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 1.0, 1.0, None), (1, 1, 1, 9.0, 0.0, 29.0, 9.0, " http://a "), (1, 1, 2, 9.0, 0.0, 29.0, 9.0, "http://b")], schema.LINKS_RAW)
    got = links.word_links(w, k)
    assert [r.uri for r in got.orderBy("word_no").collect()] == [None, "http://a", "http://a", None, None]
    assert [(r.phrase, r.uri) for r in links.link_runs(got).collect()] == [("the site", "http://a")] and links.link_majority(got).count() == 0
    b = spark.createDataFrame([(1, 1, 0, "see the site now ok", "see the site now ok"), (1, 1, 5, "the site", "the site")], "doc_id long, page_number int, block_no int, raw_text string, normalized_text string")
    assert {r.block_no: r.normalized_text for r in links.apply_links(b, got).collect()} == {0: "see [the site](http://a) now ok", 5: "the site"}
    assert links.set_link("breathe the", "the", "u") == "breathe [the](u)" and links.set_link("[the](u) the", "the", "v") == "[the](u) [the](v)"


def seq(spark, texts, doc=1):
    return spark.createDataFrame([(doc, i, t, None) for i, t in enumerate(texts)], "doc_id long, block_ord int, raw_text string, normalized_text string")


def kinds(df):
    return [r.block_type for r in B.classify_documents(df).orderBy("block_ord").collect()]


def test_context(spark):
    assert kinds(seq(spark, ["return (", "<div>", "Hello world", "</div>", ");", "}"])) == ["code_block"] * 6
    assert kinds(seq(spark, ["x = 1;", "A full sentence.", "y = 2;"])) == ["code_block", "paragraph", "code_block"]
    assert kinds(seq(spark, ["x = 1;", "short", "y = 2;"])) == ["code_block"] * 3 and kinds(seq(spark, ["x = 1;", "main.py", "y = 2;"]))[1] == "paragraph"
    assert kinds(seq(spark, [])) == []


def test_repeated_and_missing_places(spark):
    df = seq(spark, ["x = 1;", "short", "y = 2;"])
    twice = df.unionByName(df.where("block_ord = 1")).unionByName(spark.createDataFrame([(1, None, "- a", None), (None, 3, "# b", None)], df.schema))
    got = B.classify_documents(twice).collect()
    assert len(got) == 6 and sorted(r.block_type for r in got) == ["code_block", "code_block", "heading", "list_item", "paragraph", "paragraph"]


def test_markdown(spark):
    df = seq(spark, ["# T", "x = 1;", "y = 2;", " ", "```\nz\n```", "- a", "end"])
    md = B.build_markdown(B.classify_documents(df)).first().markdown
    assert md == "# T\n\n```\nx = 1;\ny = 2;\n```\n\n```\nz\n```\n\n- a\n\nend"
    assert B.build_markdown(B.classify_documents(seq(spark, [" ", None]))).first().markdown == ""
    simple = B.classify_documents(seq(spark, ["# T", "x = 1;", "10. x", "1. y"])).withColumn("block_type", F.when(F.col("block_ord") > 1, "list_item").otherwise(F.col("block_type")))
    assert B.simple_markdown(simple).first().markdown == "# T\n\n```\nx = 1;\n```\n\n- 10. x\n\n1. y"


def test_tables_stay(spark):
    df = seq(spark, ["x = 1;", "a|b", "y = 2;"]).withColumns({"block_type": F.when(F.col("block_ord") == 1, "table").otherwise("paragraph"), "heading_level": F.lit(0)})
    assert kinds(df) == ["code_block", "table", "code_block"]


def test_order_holds_over_chunks(spark):
    n = 3 * sequences.CHUNK
    df = spark.range(0, n, 7).select(F.lit(1).alias("k"), F.col("id").alias("o")).repartition(9)
    x = sequences.running_sum(sequences.neighbours(df, "k", "o", {"o": F.col("o")}), "k", "o", F.lit(1), "s")
    bad = x.where("coalesce(prev_o <> o - 7, o <> 0) or coalesce(next_o <> o + 7, o + 7 < %d) or s <> o / 7 + 1" % n)
    assert bad.count() == 0 and x.count() == -(-n // 7)


def test_engines(spark):
    e = spark.createDataFrame([(1, True, ["por", " ENG"]), (2, True, None), (None, None, [])], "engine_id int, is_available boolean, available_languages array<string>")
    got = {r.engine_id: (r.usable, r.missing) for r in engines.check_engines(e, ["eng", "rus"]).collect()}
    assert got == {1: (False, ["rus"]), 2: (False, ["eng", "rus"]), None: (False, ["eng", "rus"])}
    s = spark.createDataFrame([("tesseract 5.3.1\n x", "List of available languages in \"x\":\nrus\neng\neng\nbad one")], "v string, l string")
    assert s.select(engines.version_of(F.col("v")), engines.language_list(F.col("l"))).first() == ("5.3.1", ["eng", "rus"])
    assert not engine.diagnose("/nowhere/tesseract").is_available and "spark" in engine.info()


def test_options(spark):
    assert options.parse_formats(["md,HTML", ".md"]) == ("md", "html") and options.parse_formats(None) == ("md", "html")
    with pytest.raises(options.InvalidOptionError):
        options.export_formats(["docx"])
    with pytest.raises(options.InvalidOptionError):
        Pipeline(dpi=0)
    assert options.output_targets("/a/b.pdf", None, None) == ("b.md", "b.html") and options.output_targets("/a/b.pdf", "/o/x.txt", None) == ("/o/x.md", "/o/x.html")
    assert options.output_targets(b"..", "/o/", None) == ("/o/output.md", "/o/output.html") and options.output_stem(None, "c.pdf") == "c"
    assert [r[0] for r in spark.range(1, 5).select(progress(F.col("id"), F.lit(4))).collect()] == [0.275, 0.4, 0.525, 0.65]


def test_sinks(spark, tmp_path):
    f = sinks.write_file(tmp_path / "d" / "a.md", "x")
    assert f.read_text() == "x\n" and [p.name for p in f.parent.iterdir()] == ["a.md"]
    with pytest.raises(options.DestinationExistsError):
        sinks.write_file(f, "y", overwrite=False)
    d = spark.createDataFrame([(1, "/s/one.pdf", "# A"), (2, None, None)], "doc_id long, source_path string, markdown string")
    got = {r.doc_id: r for r in sinks.write_documents(d, str(tmp_path / "o")).collect()}
    assert got[1].markdown_path.endswith("one_1.md") and got[2].html_path.endswith("output_2.html") and (tmp_path / "o" / "one_1.md").read_text() == "# A\n"
    again = sinks.write_documents(d, str(tmp_path / "o"), ("md",), overwrite=False).collect()
    assert all("exists" in r.error and r.markdown_path is None for r in again)


def test_pdf_source_reports_errors(spark, tmp_path):
    """Spark's source skips empty files; what can't be opened gives a row with a code."""
    (tmp_path / "b.pdf").write_bytes(b"%PDF-broken")
    got = pdf.inspect(pdf.decode(pdf.files(spark, str(tmp_path)))).collect()
    assert len(got) == 1 and got[0].error_code in (4, 6) and not got[0].is_valid
    assert pdf.decode_one(b"")["error_code"] == 3 and pdf.decode_one(None)["error_code"] == 3


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "/x/n.pdf", 1), (2, "/x/o.pdf", 1), (3, "/x/e.pdf", 0)], schema.DOCUMENTS)
    t = {
        "documents": docs,
        "pages": pages(spark, [(1, 1, 1, False, "native text that is long enough to count"), (2, 1, 1, True, "")]),
        "blocks_raw": spark.createDataFrame([(1, 1, 0, 0, 0.0, 0.0, 100.0, 10.0, "# Head"), (1, 1, 1, 0, 0.0, 20.0, 100.0, 30.0, "exem-\nplo​ text"), (1, 1, 2, 1, 0.0, 0.0, 9.0, 9.0, "image"), (1, 1, 3, 0, 0.0, 42.0, 100.0, 48.0, "in table")], schema.BLOCKS_RAW),
        "tables_raw": spark.createDataFrame([(1, 1, 0, 0.0, 40.0, 100.0, 50.0, "|a|b|\n|---|---|\n|1|2|")], schema.TABLES_RAW),
        "ocr_words": spark.createDataFrame([(2, 1, 0, 1, 1, 1, 0, 0, 9, 9, 9.0, "scanned"), (2, 1, 1, 1, 1, 1, 10, 0, 9, 9, 9.0, "words")], schema.OCR_WORDS),
    }
    got = {r.doc_id: r for r in Pipeline().run(t).collect()}
    assert got[1].markdown == "# Head\n\nexemplo text\n\n| a | b |\n| --- | --- |\n| 1 | 2 |" and got[1].strategy == "native_text"
    assert got[2].markdown == "scanned words" and got[2].strategy == "ocr_fallback" and got[3].markdown == "" and "<td>2</td>" in got[1].html
    assert "html" not in Pipeline(formats=("md",)).run(t).columns


def test_streaming(spark, tmp_path, sf):
    src = spark.read.parquet(f"{sf}/blocks.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    S.write_markdown(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert S.read_markdown(spark, str(tmp_path / "out")).count() == src.select("doc_id").distinct().count()
    assert S.cleaned(stream).isStreaming and S.arrivals(stream).isStreaming


def test_row_checks(spark):
    df = spark.createDataFrame([(1, 0, "table", 0.0), (0, 9, "x", None)], "page_number int, heading_level int, block_type string, x0 double").withColumns({c: F.col("x0") for c in ("y0", "x1", "y1")})
    assert [r.f for r in df.select(schema.block_faults().alias("f")).collect()] == [[], ["page_number", "heading_level", "block_type", "bbox"]]
    assert schema.valid(df, schema.block_faults()).count() == 1
    with pytest.raises(Exception, match="invalid row"):
        schema.require(df, schema.block_faults()).collect()


def stub(content, password="", ocr=False, dpi=300, **_):
    """A reader of texts: a file of "scan" has no text layer, only what OCR sees; one of "bad" is corrupt."""
    t = bytes(content).decode()
    if t.startswith("bad"):
        return {"error_code": 4, "error": "corrupt"}
    if t.startswith("scan"):
        page = {"pages": [(1, True, "")], "n_pages": 1}
        return page | {"ocr_words": [(1, i, 0, 0, 0, 10 * i, 0, 9, 9, 90.0, w) for i, w in enumerate(t.split()[1:])]} if ocr else page
    return {"pages": [(1, False, t)], "n_pages": 1, "blocks": [] if ocr else [(1, 0, 0, 0.0, 0.0, 9.0, 9.0, t)]}


def test_scanned_files_are_read_by_ocr_unasked(spark, tmp_path):
    for name, t in (("a", "The text layer of this file holds more than thirty characters."), ("b", "scan words that only the engine sees"), ("c", "bad")):
        (tmp_path / f"{name}.pdf").write_text(t)
    told = []
    p = Pipeline(formats=("md",), listener=lambda stage, done: told.append((stage, done)))
    rows = {r.source_path[-5:]: r for r in p.convert(str(tmp_path), str(tmp_path / "out"), spark=spark, reader=stub).collect()}
    read = lambda r: Path(r.markdown_path).read_text()
    assert read(rows["a.pdf"]).startswith("The text layer") and rows["a.pdf"].strategy == "native_text" and read(rows["b.pdf"]) == "words that only the engine sees\n"
    assert rows["b.pdf"].strategy == "ocr_fallback" and rows["c.pdf"].error == "corrupt" and rows["c.pdf"].markdown_path is None and rows["a.pdf"].pages_processed == 1
    assert [s for s, _ in told] == ["opening", "detecting", "extracting", "exporting", "finished"] and all(r.execution_time_seconds > 0 for r in rows.values())
    one = p.convert(b"scan from memory", str(tmp_path / "mem"), spark=spark, reader=stub).first()
    assert one.source_path == "<memory>" and read(one) == "from memory\n"
    with pytest.raises(Exception, match="corrupt"):
        pdf.validate(pdf.decode(pdf.files(spark, str(tmp_path)), reader=stub)).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("Some text")
    with pdf.PdfReader(spark, str(tmp_path / "a.pdf"), reader=stub) as r:
        assert r.is_valid() and r.inspect().first().n_pages == 1 and r.tables()["blocks_raw"].count() == 1 and not r.is_closed
    assert r.is_closed and not pdf.PdfReader(spark, b"bad", reader=stub).is_valid()
    assert pdf._as_far_as_possible(x if x < 2 else 1 / 0 for x in range(5)) == [0, 1]


def test_engine_reports():
    assert engine.version_in("tesseract v5.3.1\n leptonica") == "5.3.1" and engine.version_in("\nother 2\n") == "other 2" and engine.version_in("") is None
    assert engine.languages_in("List of available languages (2):\nrus\neng\neng\nchi_sim\n") == ["chi_sim", "eng", "rus"]
    e = engine.Engine("/nowhere/engine")
    assert e.binary is None and e.fault(["eng"]) == "no binary found" and e.lacks(["eng", "eng"]) == ["eng"]
    with pytest.raises(ReaderMissingError):
        engine.require(["eng"], "/nowhere/engine")


def test_late_blocks_give_a_document_anew(spark, tmp_path):
    ddl = "block_id long, doc_id long, block_ord long, raw_text string, normalized_text string, arrived_at timestamp"
    for n, rows in enumerate(([(1, 1, 0, "# One", None, None), (2, 2, 0, "two", None, None)], [(3, 1, 1, "late", None, None), (1, 1, 0, "# One", None, None)])):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        S.write_markdown(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = {r.doc_id: r.markdown for r in S.read_markdown(spark, str(tmp_path / "out")).collect()}
        assert got == {1: "# One" if n == 0 else "# One\n\nlate", 2: "two"}


def test_options_as_columns(spark):
    d = spark.createDataFrame([("a/b.c.pdf",), ("<memory>",), (None,), ("",)], "s string")
    assert [tuple(r) for r in d.select(*target_paths(F.col("s"), "o/")).collect()] == [("o/b.c.md", "o/b.c.html"), *[("o/output.md", "o/output.html")] * 3]
    f = spark.createDataFrame([(" .MD, html,md",), ("pdf",), (None,)], "f string")
    assert [tuple(r) for r in f.select(normal_formats(F.col("f")), formats_known(F.col("f"))).collect()] == [(["md", "html"], True), (["pdf"], False), ([], True)]


def test_exporters(spark, tmp_path):
    blocks = spark.createDataFrame([(1, 0, "heading", 2, "Title", None), (1, 1, "paragraph", 0, "Text", None)], "doc_id long, block_ord long, block_type string, heading_level int, raw_text string, normalized_text string")
    m = exporters.MarkdownExporter(tmp_path)
    assert m.export(blocks, "a").read_text() == "## Title\n\nText\n" and m.export("x", source="in/b.pdf") == tmp_path / "b.md" and m.export("x", "sub/", filename="c.txt") == tmp_path / "sub" / "c.md"
    assert m.export("x", "a.txt") == tmp_path / "a.txt" and m.export("x", tmp_path, source="<memory>") == tmp_path / "output.md"
    with pytest.raises(ValueError):
        m.export("x")
    with pytest.raises(TypeError):
        m.export(3, "d")
    with pytest.raises(options.DestinationExistsError):
        exporters.MarkdownExporter(tmp_path, overwrite=False).export("x", "a")
    h = exporters.HtmlExporter(tmp_path, lang="en", extra_css="p { color: red }")
    assert h.compile_body("# a") == "<h1>a</h1>"
    page = h.export(blocks, source="in/<b>.pdf").read_text()
    assert "<title>&lt;b&gt;</title>" in page and "<h2>Title</h2>" in page and 'lang="en"' in page and "color: red" in page and "<title>T</title>" in h.compile("x", title="T") and "Documento" in h.compile("x")
