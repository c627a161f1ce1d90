"""Pairs of input and result for cleaning, line repair, classification, rendering and HTML."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchflow.functions import classify, html, lines, render, text


def check(spark, pairs, fn):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, t string, want string").withColumn("got", fn(F.col("t")).cast("string"))
    bad = df.where("not (got <=> want)").collect()
    assert not bad, [(r.t, r.got, r.want) for r in bad]


def test_cleaning(spark):
    check(spark, [("a\x00b", "ab"), ("", ""), (None, "")], text.remove_null_bytes)
    check(spark, [("a�b￼c", "abc")], text.remove_replacement_characters)
    check(spark, [("a\x01\x07b\n\tc\x85", "ab\n\tc")], text.remove_control_characters)
    check(spark, [("a\n\tb", "ab")], lambda c: text.remove_control_characters(c, False, False))
    check(spark, [("a​b­c﻿", "abc")], text.remove_invisible_characters)
    check(spark, [("a­b​", "a­b")], lambda c: text.remove_invisible_characters(c, False))
    check(spark, [("a b c　d", "a b c d")], text.normalize_spaces)
    check(spark, [("a   b\t\tc\td", "a b c\td"), ("a  \n  b", "a \n b")], text.collapse_consecutive_spaces)
    check(spark, [("café", "café"), ("plain", "plain")], text.normalize_unicode)
    check(spark, [("ﬁ", "fi")], lambda c: text.normalize_unicode(c, "NFKC"))
    check(spark, [("\x00a​ ção� ", "a ção "), (None, ""), ("", "")], text.clean_text)


def test_clean_is_idempotent_and_equals_its_steps(spark):
    rows = [(t,) for t in ("a\x00 ​b", "  x\t\ty\r\n", "é   ­z\x85", "", "\x07")]
    df = spark.createDataFrame(rows, "t string")
    once = text.clean_text(F.col("t"))
    steps = text.normalize_unicode(text.normalize_spaces(text.remove_invisible_characters(text.remove_control_characters(text.remove_replacement_characters(text.remove_null_bytes(F.col("t")))))))
    assert not df.select(once.alias("a"), text.clean_text(once).alias("b"), steps.alias("c")).where("a <> b or a <> c").count()


def test_character_classes(spark):
    check(spark, [("\x00", "true"), ("�", "true"), ("\n", "false"), ("a", "false"), (" ", "false")], text.is_corrupted)
    check(spark, [("a", "true"), (" ", "true"), ("\n", "true"), ("\xa0", "false"), ("​", "false"), ("\x01", "false")], text.is_readable)


@pytest.mark.parametrize(
    ("prefix", "suffix", "keeps"),
    [("guarda", "chuva", True), ("ex", "aluno", True), ("exem", "plo", False), ("disse", "me", True), ("micro", "ondas", True), ("anti", "inflamatório", True), ("auto", "hemoterapia", True), ("sub", "base", True),
     ("super", "homem", True), ("inter", "racial", True), ("COVID", "19", True), ("Porto", "Alegre", True), ("", "a", False), ("inter", "nacional", False), ("sub", "solo", False)],
)
def test_morphological_hyphen(spark, prefix, suffix, keeps):
    assert lines.keeps_hyphen(prefix, suffix) is keeps
    assert spark.range(1).select(lines.is_morphological_hyphen(F.lit(prefix), F.lit(suffix)).alias("v")).first().v is keeps


def test_line_repair(spark):
    check(spark, [("exem-\nplo", "exemplo"), ("bem-\nestar", "bem-estar"), ("des-\nen-\nvol", "desenvol"), ("a\r\nb\rc", "a\nb\nc"), ("fim-de-\nsemana", "fim-de-semana"), (None, "")], lines.dehyphenate_text)
    check(spark, [("a\nb\n\nc\n \nd", "a b\n\nc\n\nd"), ("  a  \n\n\n", "a"), ("", "")], lines.consolidate_paragraphs)
    check(spark, [("exem-\nplo de\ntexto\n\nfim", "exemplo de texto\n\nfim")], lines.normalize_line_breaks)
    assert lines.join_broken("foo-\nbar", frozenset({"foo-bar"})) == "foo-bar"


@given(st.text(alphabet="ab-\n \r­", max_size=40))
@settings(max_examples=200, deadline=None)
def test_joining_is_stable(t):
    assert lines.join_broken(lines.join_broken(t)) == lines.join_broken(t)


def test_classification(spark):
    kinds = [
        ("", "paragraph"), (None, "paragraph"), ("def f(x):", "code_block"), ("```\nx\n```", "code_block"), ("    a = 1\n    b = 2", "code_block"), ("Olá,", "code_block"), ("x = 1;", "code_block"),
        ("# Title", "heading"), ("1.2 Scope", "heading"), ("1. Introduction", "heading"), ("Capítulo 3", "heading"), ("ANNUAL REPORT", "heading"), ("- item", "list_item"), ("a) item", "list_item"), ("• a\n• b", "list_item"),
        ("Some plain sentence.", "paragraph"), ("main.py", "paragraph"), ("A LOUD END!", "paragraph"),
    ]
    check(spark, kinds, lambda c: classify.classify_text(c)["block_type"])
    levels = [("### x", "3"), ("####### x", "6"), ("1.2.3 x", "3"), ("2 - Método", "1"), ("1️⃣ Start", "3"), ("Section 4", "2"), ("Chapter 2.", "0"), ("text", "0"), ("X" * 151, "0"), ("A\nB\nC", "0")]
    check(spark, levels, classify.heading_level)


def test_rendering(spark):
    check(spark, [("Title", "## Title"), ("### Title\nmore", "## Title more"), ("", ""), ("##", "##")], lambda c: render.format_heading(c, 2))
    check(spark, [("* a\n• b", "- a\n- b"), ("1) a\n(2) b\na. c", "1. a\n2. b\na. c"), ("first\nsecond", "- first\n  second")], render.format_list_item)
    check(spark, [("a | b\n--- | ---\n1 | 2 | 3", "| a | b |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |"), ("a\tb", "| a | b |\n| --- | --- |"), (r"a \| b | c", "| a \\| b | c |\n| --- | --- |"), ("---|---", "")], render.format_table)
    check(spark, [("a <b>x</b> < 3\n\n c ", "a &lt;b>x&lt;/b> < 3\nc")], render.format_paragraph)
    check(spark, [("  x = 1\n    y\n\n  z", "```py\nx = 1\n  y\n\nz\n```"), ("```\na\n```", "```\na\n```"), (" ", "")], lambda c: render.format_code_block(c, "py"))


def test_html(spark):
    assert html.markdown_to_html("# A & B\n\ntext **b** `c<d`") == "<h1>A &amp; B</h1>\n<p>text <strong>b</strong> <code>c&lt;d</code></p>"
    assert html.markdown_to_html("- a\n  - b\n- c") == "<ul>\n<li>a\n<ul>\n<li>b</li>\n</ul>\n</li>\n<li>c</li>\n</ul>"
    assert "<td>2</td>" in html.markdown_to_html("| a | b |\n| --- | --- |\n| 1 | 2 |")
    assert html.markdown_to_html("```py\nx < 1\n```") == '<pre><code class="language-py">x &lt; 1\n</code></pre>'
    assert html.markdown_to_html(None) == "" and html.markdown_to_html("[a](http://x)") == '<p><a href="http://x">a</a></p>'
    page = spark.range(1).select(html.render_html(F.lit("hi"), None, F.lit("/a/b<c>.pdf")).alias("v")).first().v
    assert "<title>b&lt;c&gt;</title>" in page and "<p>hi</p>" in page and page.startswith("<!DOCTYPE html>")


def test_sql_functions(spark):
    from parchflow.functions.sql import register

    register(spark)
    assert spark.sql("SELECT clean_text(concat('a', char(0), 'b')) a, strip_text('  x ') b, nfc('e') c, dehyphenate('exem-\\nplo') d").first() == ("ab", "x", "e", "exemplo")
