"""Queries over the test tables, by name, and the SQL that they equal. All run over whole tables.

Blocks of converted documents are the main input; what the tables don't hold (OCR words, links, page texts) is derived from them in
the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchflow.functions import classify as C
from parchflow.functions import fixed, lines, render, text
from parchflow.functions.html import compile_markdown_to_html, escape_html, html_frame, render_html, stem
from parchflow.operators import blocks as B
from parchflow.operators import engines, layout, links, ocr, quality
from parchflow.options import formats_known, normal_formats, target_paths
from parchflow.plans.pipeline import Pipeline, progress
from parchflow.runtime import cut, table
from parchflow.schema import block_faults, report_faults, result_faults
from parchflow.sinks import with_newline
from parchflow.sources import pdf

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- inputs

BLOCK_COLUMNS = ("block_id", "doc_id", "page_number", "block_ord", "block_type", "heading_level", "raw_text", "normalized_text", "x0", "y0", "x1", "y1")
_B = f"b AS (SELECT DISTINCT {', '.join(BLOCK_COLUMNS)} FROM blocks)"


def distinct_blocks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "blocks").select(*BLOCK_COLUMNS).distinct()


def block_lines(s: SparkSession, d: str) -> DataFrame:
    """Distinct lines of blocks and documents."""
    each = lambda t, c: table(s, d, t).select(F.explode(F.split(c, "\n")).alias("line"))
    return each("blocks", "raw_text").unionByName(each("documents", "text")).distinct()


_LINES = "l AS (SELECT DISTINCT unnest(string_split(raw_text, chr(10))) AS line FROM blocks UNION SELECT DISTINCT unnest(string_split(text, chr(10))) FROM documents)"

# white space as Python sees it
_WS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+\z', '', 'g')"


_CC = r"\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}"
_ZS = r"[ \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"


def _clean(x: str, nfc: bool = True) -> str:
    out = rf"regexp_replace(regexp_replace({x}, '[{_CC}\x{{fffd}}\x{{fffc}}]|\p{{Cf}}', '', 'g'), '{_ZS}', ' ', 'g')"
    return f"nfc_normalize({out})" if nfc else out


def _splitlines(x: str) -> str:
    return rf"(CASE WHEN {x} = '' THEN [] ELSE regexp_split_to_array(regexp_replace({x}, '(?:\r\n|[\n\r\x{{b}}\x{{c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}])\z', ''), '\r\n|[\n\r\x{{b}}\x{{c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]') END)"


def _solid(x: str) -> str:
    return f"list_filter(list_transform({_splitlines(x)}, lambda q: {_strip('q')}), lambda q: q <> '')"


# --- cleaning


def _on_text(fn: Callable[[Column], Column], name: str = "cleaned") -> Query:
    return lambda s, d: distinct_blocks(s, d).select("block_id", fn(F.col("raw_text")).alias(name))


def _text_sql(expr: str, name: str = "cleaned") -> str:
    return f"WITH {_B} SELECT block_id, {expr} AS {name} FROM b"


query("clean_text", _text_sql(_clean("raw_text")))(_on_text(text.clean_text))
query("remove_null_bytes", _text_sql(r"regexp_replace(raw_text, '\x{0}', '', 'g')"))(_on_text(text.remove_null_bytes))
query("remove_replacement_characters", _text_sql(r"regexp_replace(raw_text, '[\x{fffd}\x{fffc}]', '', 'g')"))(_on_text(text.remove_replacement_characters))
query("remove_control_characters", _text_sql(rf"regexp_replace(raw_text, '[{_CC}]', '', 'g')"))(_on_text(text.remove_control_characters))
query("remove_control_characters_all", _text_sql(r"regexp_replace(raw_text, '[\x{0}-\x{1f}\x{7f}-\x{9f}]', '', 'g')"))(_on_text(lambda c: text.remove_control_characters(c, False, False)))
query("remove_invisible_characters", _text_sql(r"regexp_replace(raw_text, '\p{Cf}', '', 'g')"))(_on_text(text.remove_invisible_characters))
query("remove_invisible_keep_soft_hyphens", _text_sql(r"replace(regexp_replace(replace(raw_text, chr(173), chr(57344)), '\p{Cf}', '', 'g'), chr(57344), chr(173))"))(_on_text(lambda c: text.remove_invisible_characters(c, False)))
query("normalize_spaces", _text_sql(rf"regexp_replace(raw_text, '{_ZS}', ' ', 'g')"))(_on_text(text.normalize_spaces))
query("collapse_consecutive_spaces", _text_sql(r"regexp_replace(raw_text, '[\t\x{b}\x{c}\x{85}\x{2028}\x{2029} \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]{2,}', ' ', 'g')"))(_on_text(text.collapse_consecutive_spaces))
query("normalize_unicode", _text_sql(r"nfc_normalize(regexp_replace(raw_text, '\x{0}', '', 'g'))"))(_on_text(lambda c: text.normalize_unicode(text.remove_null_bytes(c))))
query("strip_text", _text_sql(_strip("raw_text")))(_on_text(lambda c: text.strip(text.text_of(c))))

_CRLF = "replace(raw_text, '.' || chr(10), '.' || chr(13) || chr(10))"
query("line_endings", _text_sql(rf"regexp_replace({_CRLF}, '\r\n?', chr(10), 'g')"))(_on_text(lambda c: lines.normalize_line_endings(F.replace(c, F.lit(".\n"), F.lit(".\r\n")))))
_PARAS = r"regexp_split_to_array(regexp_replace(replace(raw_text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), '\r\n?', chr(10), 'g'), '\n" + _WS + r"*\n+')"
query(
    "consolidate",
    _text_sql(f"array_to_string(list_filter(list_transform({_PARAS}, lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda q: {_strip('q')}), lambda q: q <> ''), ' ')), lambda p: p <> ''), chr(10) || chr(10))"),
)(_on_text(lambda c: lines.consolidate_paragraphs(F.replace(c, F.lit(".\n"), F.lit(".\n \n")))))


def _list(words: Iterable[str]) -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(words))


_MORPH = rf"""(length(p) > 0 AND length(s) > 0 AND (
  regexp_matches(p, '\p{{Nd}}') OR regexp_matches(s, '\p{{Nd}}') OR (regexp_matches(p, '^\p{{Lu}}') AND regexp_matches(s, '^\p{{Lu}}'))
  OR lower(p) || '-' || lower(s) IN ({_list(fixed.COMPOUNDS)}) OR lower(s) IN ({_list(fixed.ENCLITICS)}) OR lower(p) IN ({_list(fixed.PREFIXES)})
  OR (lower(p) IN ({_list(fixed.VOWEL_PREFIXES)}) AND (lower(s)[1] = 'h' OR lower(s)[1] = right(lower(p), 1)))
  OR (lower(p) = 'sub' AND lower(s)[1] IN ('b', 'r', 'h')) OR (lower(p) IN ('super', 'hiper', 'inter') AND lower(s)[1] IN ('r', 'h'))))"""
_W = fixed.WORD_CLASS
_PAIRS = rf"""w AS (SELECT DISTINCT unnest(regexp_extract_all(raw_text, '{_W}+')) AS w FROM blocks),
pr AS (SELECT DISTINCT regexp_extract(x, '^({_W}+)', 1) AS p, regexp_extract(x, '({_W}+)$', 1) AS s FROM (SELECT unnest(regexp_extract_all(raw_text, '{_W}+-\n?{_W}+')) AS x FROM blocks)
  UNION SELECT w[1:3], w[4:] FROM w UNION SELECT w[1:5], w[6:] FROM w)"""


def word_pairs(s: SparkSession, d: str) -> DataFrame:
    """Parts that a hyphen joins in blocks, and all words cut after three and five letters."""
    b = table(s, d, "blocks")
    x = b.select(F.explode(F.regexp_extract_all("raw_text", F.lit(rf"{_W}+-\n?{_W}+"), 0)).alias("x"))
    pairs = x.select(F.regexp_extract("x", rf"^({_W}+)", 1).alias("p"), F.regexp_extract("x", rf"({_W}+)$", 1).alias("s"))
    w = b.select(F.explode(F.regexp_extract_all("raw_text", F.lit(rf"{_W}+"), 0)).alias("w")).distinct()
    cut = lambda n: w.select(F.substring("w", 1, n).alias("p"), F.substr("w", F.lit(n + 1)).alias("s"))
    return pairs.unionByName(cut(3)).unionByName(cut(5)).distinct()


query("morph_hyphen", f"WITH {_PAIRS} SELECT p, s, {_MORPH} AS keeps FROM pr")(lambda s, d: word_pairs(s, d).select("p", "s", lines.is_morphological_hyphen(F.col("p"), F.col("s")).alias("keeps")))
query("dehyphenate_pairs", f"WITH {_PAIRS} SELECT p, s, CASE WHEN {_MORPH} THEN p || '-' || s ELSE p || s END AS joined FROM pr WHERE p <> '' AND s <> ''")(
    lambda s, d: word_pairs(s, d).where("p <> '' and s <> ''").select("p", "s", lines.dehyphenate_text(F.concat("p", F.lit("-\n"), "s")).alias("joined"))
)
_G = r"[\t\x{b}\x{c}\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
_HY = r"[-‐‑\x{ad}]"
_BROKEN = rf"({_W}+){_HY}{_G}\n{_G}(-?){_G}({_W}+)"


def _dehyphenated(name: str, source: str, key: str, x: str) -> str:
    """A recursive table (key, t) of texts, one break joined a step, and its last rows."""
    return rf"""{name}_r AS (SELECT {key}, regexp_replace({x}, '\r\n?', chr(10), 'g') AS t FROM {source}
  UNION ALL SELECT {key}, a || p || CASE WHEN again = '-' OR regexp_matches(a, '(?s)[^\r\n \t]{_HY}\z') OR regexp_matches(e, '(?s)\A{_HY}[^\r\n \t]') OR {_MORPH} THEN '-' ELSE '' END || s || e
    FROM (SELECT {key}, m.a AS a, m.p AS p, m.again AS again, m.s AS s, m.e AS e FROM (SELECT {key}, regexp_extract(t, '(?s)\A(.*?){_BROKEN}(.*)\z', ['a', 'p', 'again', 's', 'e']) AS m FROM {name}_r WHERE regexp_matches(t, '{_BROKEN}')))),
{name} AS (SELECT {key}, t FROM {name}_r WHERE NOT regexp_matches(t, '{_BROKEN}'))"""


def _consolidated(x: str) -> str:
    paras = rf"regexp_split_to_array({x}, '\n{_WS}*\n+')"
    return f"array_to_string(list_filter(list_transform({paras}, lambda p: array_to_string(list_filter(list_transform(string_split(p, chr(10)), lambda q: {_strip('q')}), lambda q: q <> ''), ' ')), lambda p: p <> ''), chr(10) || chr(10))"


query("dehyphenate", f"WITH RECURSIVE {_B}, {_dehyphenated('dh', 'b', 'block_id', 'raw_text')} SELECT block_id, t AS cleaned FROM dh")(_on_text(lines.dehyphenate_text))
query("normalize_line_breaks", f"WITH RECURSIVE {_B}, {_dehyphenated('dh', 'b', 'block_id', _clean('raw_text'))} SELECT block_id, {_consolidated('t')} AS cleaned FROM dh")(_on_text(lambda c: lines.normalize_line_breaks(text.clean_text(c))))

# --- quality

_PAGES = """pg AS (SELECT b.doc_id, page_number, string_agg(raw_text, chr(10) ORDER BY block_ord, block_id) AS text FROM b GROUP BY ALL),
dc AS (SELECT doc_id, max(total_pages) AS n_pages FROM structures GROUP BY doc_id),
im AS (SELECT doc_id, bool_or(has_images) AS has_images FROM quality_reports GROUP BY doc_id),
pages AS (SELECT pg.*, n_pages, coalesce(has_images, false) AS has_images FROM pg JOIN dc USING (doc_id) LEFT JOIN im USING (doc_id))"""
_SAMPLE = "CASE WHEN n_pages <= 5 THEN range(0, n_pages) ELSE [0, 1, CAST(n_pages // 2 AS BIGINT), n_pages - 2, n_pages - 1] END"


def pages(s: SparkSession, d: str) -> DataFrame:
    """Page texts of blocks in order, with the pages and images of their documents."""
    b = distinct_blocks(s, d)
    t = b.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "block_id", "raw_text"))), lambda x: x.raw_text), "\n").alias("text"))
    n = table(s, d, "structures").groupBy("doc_id").agg(F.max("total_pages").alias("n_pages"))
    i = table(s, d, "quality_reports").groupBy("doc_id").agg(F.bool_or("has_images").alias("has_images"))
    return t.join(n, "doc_id").join(i, "doc_id", "left").withColumn("has_images", F.coalesce("has_images", F.lit(False)))


query("sample_pages", f"SELECT DISTINCT total_pages, {_SAMPLE.replace('n_pages', 'total_pages')} AS sampled FROM structures")(
    lambda s, d: table(s, d, "structures").select("total_pages").distinct().select("total_pages", quality.sample_pages(F.col("total_pages")).alias("sampled"))
)
_READ = r"[^\x{0}-\x{1f}\x{7f}-\x{a0}\p{C}\p{Z}\x{fffd}\x{fffc}]"
_QUALITY = rf"""
WITH {_B}, {_PAGES},
c AS (SELECT doc_id, page_number, has_images, length(text) AS t, length(text) - length(regexp_replace(text, '{_READ}|[ \n\r\t]', '', 'g')) AS p,
      length(text) - length(regexp_replace(text, '[{_CC}\x{{fffd}}\x{{fffc}}]', '', 'g')) AS k, length(text) - length(regexp_replace(text, '{_READ}', '', 'g')) AS r
      FROM pages WHERE list_contains({_SAMPLE}, page_number - 1)),
q AS (SELECT doc_id, sum(t) AS total_chars, sum(p) AS printable_chars, sum(k) AS corrupted_chars, sum(r) AS solid_chars, bool_or(has_images) AS has_images, list_sort(list(page_number - 1)) AS pages_sampled FROM c GROUP BY doc_id),
x AS (SELECT *, CASE WHEN total_chars > 0 THEN round_even(printable_chars / total_chars, 4) ELSE 0 END AS readable_ratio, CASE WHEN total_chars > 0 THEN round_even(corrupted_chars / total_chars, 4) ELSE 0 END AS corruption_ratio FROM q)
"""
query(
    "quality_report",
    _QUALITY + "SELECT doc_id, CAST(total_chars AS BIGINT) AS total_chars, CAST(printable_chars AS BIGINT) AS printable_chars, CAST(corrupted_chars AS BIGINT) AS corrupted_chars, CAST(solid_chars AS BIGINT) AS solid_chars, has_images, pages_sampled,"
    " readable_ratio, corruption_ratio, CASE WHEN corruption_ratio > 0.15 OR solid_chars < 30 OR readable_ratio < 0.8 THEN 'ocr_fallback' ELSE 'native_text' END AS recommended_strategy FROM x",
)(lambda s, d: quality.quality_report(pages(s, d)).drop("reason"))
query(
    "quality_reason",
    _QUALITY
    + """SELECT doc_id, CASE WHEN corruption_ratio > 0.15 THEN printf('Taxa de corrupção textual (%.1f%%) excede o limiar máximo permitido (15.0%%).', corruption_ratio * 100)
    WHEN solid_chars < 30 AND total_chars = 0 THEN 'Nenhum caractere textual detectado nas páginas amostradas.' WHEN solid_chars < 30 THEN printf('Densidade textual insuficiente (%d caracteres legíveis, mínimo 30).', CAST(solid_chars AS BIGINT))
    WHEN readable_ratio < 0.8 THEN printf('Taxa de caracteres legíveis (%.1f%%) está abaixo do limiar mínimo (80.0%%).', readable_ratio * 100)
    ELSE printf('Camada textual íntegra detectada (%d caracteres legíveis, legibilidade de %.1f%%).', CAST(printable_chars AS BIGINT), readable_ratio * 100) END AS reason FROM x""",
)(lambda s, d: quality.quality_report(pages(s, d)).select("doc_id", "reason"))
query("forced_strategy", f"WITH {_B}, {_PAGES} SELECT DISTINCT doc_id, 'ocr_fallback' AS strategy FROM pages")(lambda s, d: quality.detect_strategy(pages(s, d), force_ocr=True))

# --- OCR words: the words of blocks, with numbers and boxes made from their places

_WORDS = r"""ln AS (SELECT doc_id, page_number, block_id, block_ord, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS line_num FROM b),
wd AS (SELECT doc_id, page_number, block_ord, block_id, line_num, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) AS k FROM ln),
words AS (SELECT doc_id, page_number, CAST(block_ord % 3 AS INTEGER) AS block_num, CAST(block_ord AS INTEGER) AS par_num, line_num, block_ord * 1000000 + line_num * 1000 + k AS idx, text,
  (k * 37 + block_ord) % 500 AS l, line_num * 12 AS t, 10 + k % 7 AS w, 9 + line_num % 4 AS h, CASE WHEN (k + line_num + block_ord) % 11 = 0 THEN -1.0 ELSE (k * 7 % 100) END AS conf FROM wd)"""


def ocr_words(s: SparkSession, d: str) -> DataFrame:
    b = distinct_blocks(s, d)
    ln = b.select("doc_id", "page_number", "block_ord", F.posexplode(F.split("raw_text", "\n")).alias("i", "line")).withColumn("line_num", F.col("i") + 1)
    wd = ln.select("doc_id", "page_number", "block_ord", "line_num", F.posexplode(F.split("line", " ")).alias("j", "text")).withColumn("k", F.col("j") + 1)
    return wd.selectExpr(
        "doc_id", "page_number", "cast(block_ord % 3 as int) block_num", "cast(block_ord as int) par_num", "line_num", "block_ord * 1000000L + line_num * 1000L + k idx", "text",
        "(k * 37 + block_ord) % 500 left", "line_num * 12 top", "10 + k % 7 width", "9 + line_num % 4 height", "cast(case when (k + line_num + block_ord) % 11 = 0 then -1 else k * 7 % 100 end as double) conf",
    )


_OCR = rf"""WITH {_B}, {_WORDS},
v AS (SELECT * EXCLUDE (text), {_strip('text')} AS text FROM words WHERE {_strip('text')} <> '' AND conf <> -1),
g AS (SELECT doc_id, page_number, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY idx, text) AS line, min(idx) AS i, min(l) AS x0, min(t) AS y0, max(l + w) AS x1, max(t + h) AS y1 FROM v GROUP BY ALL),
p AS (SELECT doc_id, page_number, block_num, par_num, min(i) AS first_idx, string_agg(line, chr(10) ORDER BY line_num) AS raw_text, min(x0) * 4 / 16 AS x0, min(y0) * 4 / 16 AS y0, max(x1) * 4 / 16 AS x1, max(y1) * 4 / 16 AS y1 FROM g
  GROUP BY doc_id, page_number, block_num, par_num)
SELECT * FROM p"""
query("ocr_paragraphs", _OCR)(lambda s, d: ocr.word_blocks(ocr_words(s, d), scale=4.0, normalize=False).drop("normalized_text"))
query("ocr_valid_words", f"WITH {_B}, {_WORDS} SELECT doc_id, page_number, count(*) AS words FROM words WHERE {_strip('text')} <> '' AND conf <> -1 GROUP BY ALL")(
    lambda s, d: ocr.valid_words(ocr_words(s, d)).groupBy("doc_id", "page_number").agg(F.count("*").alias("words"))
)
_SPLIT = "string_split(replace(raw_text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10))"
query(
    "ocr_text_blocks",
    f"WITH {_B}, x AS (SELECT block_id AS doc_id, page_number, unnest({_SPLIT}) AS part, generate_subscripts({_SPLIT}, 1) - 1 AS block_no FROM b) SELECT doc_id, page_number, CAST(block_no AS INTEGER) AS block_no, {_strip('part')} AS raw_text FROM x WHERE {_strip('part')} <> ''",
)(lambda s, d: ocr.text_blocks(distinct_blocks(s, d).select(F.col("block_id").alias("doc_id"), "page_number", F.replace("raw_text", F.lit(".\n"), F.lit(".\n\n")).alias("text")), normalize=False).drop("normalized_text"))
query("ocr_config", "SELECT DISTINCT engine_id, '--psm ' || (engine_id % 14) || CASE WHEN engine_id % 3 = 0 THEN '' ELSE ' --oem ' || (engine_id % 4) END || CASE WHEN tessdata_path IS NULL THEN '' ELSE ' --tessdata-dir ' || tessdata_path END AS config FROM ocr_engines")(
    lambda s, d: table(s, d, "ocr_engines").select(
        "engine_id",
        ocr.tesseract_config((F.col("engine_id") % 14), F.when(F.col("engine_id") % 3 != 0, F.col("engine_id") % 4), F.concat(F.lit("--tessdata-dir "), F.col("tessdata_path"))).alias("config"),
    ).distinct()
)

# --- boxes: tables, links, layout

_BOX = "x0, y0, x1, y1"
query(
    "table_anti",
    f"WITH {_B} SELECT block_id FROM b WHERE block_type <> 'table' AND NOT EXISTS (SELECT 1 FROM b t WHERE t.block_type = 'table' AND t.doc_id = b.doc_id AND t.page_number = b.page_number AND (b.x0 + b.x1) / 2 BETWEEN t.x0 AND t.x1 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 AND t.y1)",
)(lambda s, d: layout.outside_tables(distinct_blocks(s, d).where("block_type <> 'table'"), distinct_blocks(s, d).where("block_type = 'table'")).select("block_id"))


def box_words(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks as words; headings and lists as links, with the address of every third missing or blank."""
    b = distinct_blocks(s, d)
    w = b.select("doc_id", "page_number", F.col("block_id").alias("block_no"), F.lit(0).alias("line_no"), F.lit(0).alias("word_no"), "x0", "y0", "x1", "y1", F.col("block_type").alias("word"))
    k = b.where("block_type in ('heading', 'list_item')").selectExpr("doc_id", "page_number", "block_ord link_no", "x0", "y0", "x1", "y1 + 60 y1", "case when block_id % 3 = 0 then null when block_id % 7 = 0 then '' else ' u/' || block_id || ' ' end uri")
    return w, k


query(
    "word_links",
    f"""WITH {_B}, k AS (SELECT doc_id, page_number, block_ord AS link_no, x0, y0, x1, y1 + 60 AS y1, ' u/' || block_id || ' ' AS uri FROM b WHERE block_type IN ('heading', 'list_item') AND block_id % 3 <> 0 AND block_id % 7 <> 0)
    SELECT b.block_id AS block_no, arg_min(trim(k.uri), k.link_no) AS uri FROM b LEFT JOIN k ON k.doc_id = b.doc_id AND k.page_number = b.page_number
      AND (((b.x0 + b.x1) / 2 >= k.x0 AND (b.x0 + b.x1) / 2 < k.x1 AND (b.y0 + b.y1) / 2 >= k.y0 AND (b.y0 + b.y1) / 2 < k.y1) OR (greatest(b.x0, k.x0) < least(b.x1, k.x1) AND greatest(b.y0, k.y0) < least(b.y1, k.y1)))
    GROUP BY b.block_id""",
)(lambda s, d: links.word_links(*box_words(s, d)).select("block_no", "uri"))


def linked_words(s: SparkSession, d: str) -> DataFrame:
    """Words of blocks with an address on some."""
    b = distinct_blocks(s, d)
    w = b.select("doc_id", "page_number", F.col("block_id").alias("block_no"), F.posexplode(F.split(F.replace("raw_text", F.lit("\n"), F.lit(" ")), " ")).alias("word_no", "word"))
    return w.selectExpr("doc_id", "page_number", "block_no", "0 line_no", "word_no", "word", "case when block_no % 5 = 0 then 'u/a' when (word_no + 1) % 7 in (1, 2) then null when block_no % 2 = 0 then 'u/' || cast(floor((word_no + 1) / 5) as int) else 'u/b' end uri")


_LINKED = """w AS (SELECT doc_id, page_number, block_id AS block_no, unnest(string_split(replace(raw_text, chr(10), ' '), ' ')) AS word, generate_subscripts(string_split(replace(raw_text, chr(10), ' '), ' '), 1) AS n FROM b),
u AS (SELECT *, CASE WHEN block_no % 5 = 0 THEN 'u/a' WHEN n % 7 IN (1, 2) THEN NULL WHEN block_no % 2 = 0 THEN 'u/' || (n // 5) ELSE 'u/b' END AS uri FROM w)"""
query(
    "link_runs",
    f"WITH {_B}, {_LINKED}, c AS (SELECT *, CASE WHEN uri IS NOT DISTINCT FROM lag(uri) OVER (PARTITION BY block_no ORDER BY n) THEN 0 ELSE 1 END AS f FROM u), r AS (SELECT *, sum(f) OVER (PARTITION BY block_no ORDER BY n) AS run FROM c)"
    " SELECT block_no, CAST(run AS BIGINT) AS run, uri, string_agg(word, ' ' ORDER BY n) AS phrase FROM r WHERE uri IS NOT NULL GROUP BY block_no, run, uri",
)(lambda s, d: links.link_runs(linked_words(s, d)).select("block_no", "run", "uri", "phrase"))
query(
    "link_majority",
    f"WITH {_B}, {_LINKED} SELECT block_no, count(*) AS words, count(uri) AS linked, min(uri) AS uri FROM u GROUP BY block_no HAVING count(DISTINCT uri) = 1 AND count(uri) >= greatest(1, count(*) * 7 // 10)",
)(lambda s, d: links.link_majority(linked_words(s, d)).select("block_no", "words", "linked", "uri"))
_WD = r"[\p{L}\p{N}_]"


def _free(parts: str) -> str:
    """The number of the first part after which the phrase stands free, null if there is none."""
    word = lambda x: f"regexp_matches({x}, '{_WD}')"
    before = f"CASE WHEN {parts}[i] <> '' THEN right({parts}[i], 1) WHEN i > 1 THEN right(phrase, 1) ELSE ' ' END"
    after = f"CASE WHEN {parts}[i + 1] <> '' THEN left({parts}[i + 1], 1) WHEN i + 1 < len({parts}) THEN left(phrase, 1) ELSE ' ' END"
    return f"list_filter(range(1, len({parts})), lambda i: {before} <> '[' AND {after} <> ']' AND {word(before)} <> {word('left(phrase, 1)')} AND {word(after)} <> {word('right(phrase, 1)')})[1]"


def _set_link(x: str, parts: str, at: str) -> str:
    """The text x, split at a phrase, with its first free occurrence made a link."""
    size = f"(list_sum(list_transform({parts}[1:{at}], lambda z: length(z))) + ({at} - 1) * length(phrase))::BIGINT"
    return f"CASE WHEN phrase = '' OR uri = '' OR {at} IS NULL THEN {x} ELSE left({x}, {size}) || '[' || phrase || '](' || uri || ')' || substr({x}, {size} + length(phrase) + 1) END"


def _whole_link(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '[') AND ends_with({x}, '](' || m.uri || ')') THEN {x} ELSE '[' || {x} || '](' || m.uri || ')' END"


query(
    "apply_links",
    f"""WITH RECURSIVE {_B}, {_LINKED}, c AS (SELECT *, CASE WHEN uri IS NOT DISTINCT FROM lag(uri) OVER (PARTITION BY block_no ORDER BY n) THEN 0 ELSE 1 END AS f FROM u), r0 AS (SELECT *, sum(f) OVER (PARTITION BY block_no ORDER BY n) AS run FROM c),
    r1 AS (SELECT block_no, run, uri, string_agg(word, ' ' ORDER BY n) AS phrase FROM r0 WHERE uri IS NOT NULL GROUP BY block_no, run, uri), r AS (SELECT *, row_number() OVER (PARTITION BY block_no ORDER BY run) AS k FROM r1),
    m AS (SELECT block_no, min(uri) AS uri FROM u GROUP BY block_no HAVING count(DISTINCT uri) = 1 AND count(uri) >= greatest(1, count(*) * 7 // 10)),
    x AS (SELECT block_id, raw_text AS raw, replace(raw_text, chr(10), ' ') AS norm FROM b), st AS (SELECT block_id, CAST(0 AS BIGINT) AS k, raw, norm FROM x WHERE block_id NOT IN (SELECT block_no FROM m) AND {_strip('norm')} <> ''
      UNION ALL SELECT block_id, k, {_set_link('raw', 'rp', 'ri')}, {_set_link('norm', 'np', 'ni')} FROM (SELECT *, {_free('rp')} AS ri, {_free('np')} AS ni
        FROM (SELECT st.block_id, st.k + 1 AS k, raw, norm, phrase, uri, string_split(raw, phrase) AS rp, string_split(norm, phrase) AS np FROM st JOIN r ON r.block_no = st.block_id AND r.k = st.k + 1)))
    SELECT block_id, arg_max(raw, k) AS raw_text, arg_max(norm, k) AS normalized_text FROM st GROUP BY block_id
    UNION ALL SELECT block_id, CASE WHEN {_strip('norm')} = '' THEN raw ELSE {_whole_link('raw')} END, CASE WHEN {_strip('norm')} = '' THEN norm ELSE {_whole_link('norm')} END FROM x JOIN m ON m.block_no = x.block_id
    UNION ALL SELECT block_id, raw, norm FROM x WHERE {_strip('norm')} = '' AND block_id NOT IN (SELECT block_no FROM m)""",
)(lambda s, d: links.apply_links(distinct_blocks(s, d).withColumn("block_no", F.col("block_id")).withColumn("normalized_text", F.replace("raw_text", F.lit("\n"), F.lit(" "))), linked_words(s, d)).select("block_id", "raw_text", "normalized_text"))


def boxes(s: SparkSession, d: str) -> DataFrame:
    return distinct_blocks(s, d).select("doc_id", "page_number", F.col("block_id").alias("block_no"), (F.col("block_type") == "table").alias("is_table"), "x0", "y0", "x1", "y1")


query(
    "layout_edges",
    f"""WITH {_B}, n AS (SELECT * FROM b WHERE block_type <> 'table'),
    p AS (SELECT t.doc_id, t.page_number, t.block_id AS top_no, u.block_id AS bottom_no, t.y1 AS ty1, u.y0 AS by0, least(t.x0, u.x0) AS l, greatest(t.x1, u.x1) AS r FROM n t JOIN n u USING (doc_id, page_number)
      WHERE t.block_id <> u.block_id AND (t.y0 < u.y0 OR (t.y0 = u.y0 AND t.block_id < u.block_id)) AND t.y1 <= u.y0 + 3
        AND greatest(t.x1 - t.x0, u.x1 - u.x0) > 0 AND least(t.x1 - t.x0, u.x1 - u.x0) / greatest(t.x1 - t.x0, u.x1 - u.x0) >= 0.6 AND (least(t.x1, u.x1) - greatest(t.x0, u.x0)) / nullif(least(t.x1 - t.x0, u.x1 - u.x0), 0) >= 0.6)
    SELECT doc_id, page_number, top_no, bottom_no FROM p WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = p.doc_id AND o.page_number = p.page_number AND o.block_id NOT IN (p.top_no, p.bottom_no)
      AND o.y0 >= p.ty1 - 3 AND o.y1 <= p.by0 + 3 AND least(p.r, o.x1) > greatest(p.l, o.x0))""",
)(lambda s, d: layout.stacked_pairs(boxes(s, d)))


def _ordered(boxes: str) -> str:
    """Tables lp (stacks' edges), lc (reachable blocks), lg (stacks) and lo (doc_id, page_number, block_no, page_ord) of a table of boxes (doc_id, page_number, block_no, is_table, x0, y0, x1, y1).
    A stack's place is the number of stacks that come before it, which is its place wherever the comparison is transitive on the page."""
    return f"""lp AS (SELECT t.doc_id, t.page_number, t.block_no AS top_no, u.block_no AS bottom_no FROM (SELECT * FROM {boxes} WHERE NOT is_table) t JOIN (SELECT * FROM {boxes} WHERE NOT is_table) u USING (doc_id, page_number)
      WHERE t.block_no <> u.block_no AND (t.y0 < u.y0 OR (t.y0 = u.y0 AND t.block_no < u.block_no)) AND t.y1 <= u.y0 + 3
        AND greatest(t.x1 - t.x0, u.x1 - u.x0) > 0 AND least(t.x1 - t.x0, u.x1 - u.x0) / greatest(t.x1 - t.x0, u.x1 - u.x0) >= 0.6 AND (least(t.x1, u.x1) - greatest(t.x0, u.x0)) / nullif(least(t.x1 - t.x0, u.x1 - u.x0), 0) >= 0.6
        AND NOT EXISTS (SELECT 1 FROM {boxes} o WHERE o.doc_id = t.doc_id AND o.page_number = t.page_number AND o.block_no <> t.block_no AND o.block_no <> u.block_no
          AND o.y0 >= t.y1 - 3 AND o.y1 <= u.y0 + 3 AND least(greatest(t.x1, u.x1), o.x1) > greatest(least(t.x0, u.x0), o.x0))),
    le AS (SELECT doc_id, page_number, top_no AS i, bottom_no AS j FROM lp UNION ALL SELECT doc_id, page_number, bottom_no, top_no FROM lp),
    lc AS (SELECT doc_id, page_number, block_no, block_no AS r FROM {boxes} UNION SELECT lc.doc_id, lc.page_number, lc.block_no, le.j FROM lc JOIN le ON le.doc_id = lc.doc_id AND le.page_number = lc.page_number AND le.i = lc.r),
    lr AS (SELECT doc_id, page_number, block_no, min(r) AS g FROM lc GROUP BY ALL),
    lg AS (SELECT doc_id, page_number, g, min(x0) AS x0, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM {boxes} JOIN lr USING (doc_id, page_number, block_no) GROUP BY doc_id, page_number, g),
    lb AS (SELECT a.doc_id, a.page_number, a.g, coalesce(sum(z.n) FILTER (z.g <> a.g AND CASE WHEN z.y1 <= a.y0 + 3 THEN true WHEN a.y1 <= z.y0 + 3 THEN false ELSE (z.x0, z.y0) < (a.x0, a.y0) END), 0) AS before FROM lg a JOIN lg z USING (doc_id, page_number) GROUP BY a.doc_id, a.page_number, a.g),
    lo AS (SELECT doc_id, page_number, block_no, CAST(before + row_number() OVER (PARTITION BY doc_id, page_number, g ORDER BY y0, x0, block_no) - 1 AS INTEGER) AS page_ord FROM {boxes} JOIN lr USING (doc_id, page_number, block_no) JOIN lb USING (doc_id, page_number, g))"""


_BOXES = "bx AS (SELECT doc_id, page_number, block_id AS block_no, block_type = 'table' AS is_table, x0, y0, x1, y1 FROM b)"
query("layout_order")(lambda s, d: layout.sort_blocks(boxes(s, d)))


def clear_boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes of the pages on which no two overlap in height, where the comparison of stacks can't go round in a circle."""
    x = boxes(s, d)
    o = x.select("doc_id", "page_number", F.col("block_no").alias("n2"), F.col("y0").alias("a"), F.col("y1").alias("b"))
    over = x.join(o, ["doc_id", "page_number"]).where("block_no < n2 and y1 > a + 3 and b > y0 + 3").select("doc_id", "page_number").distinct()
    return x.join(over, ["doc_id", "page_number"], "left_anti")


_CLEAR = "cx AS (SELECT * FROM bx WHERE (doc_id, page_number) NOT IN (SELECT (p.doc_id, p.page_number) FROM bx p JOIN bx q USING (doc_id, page_number) WHERE p.block_no < q.block_no AND p.y1 > q.y0 + 3 AND q.y1 > p.y0 + 3))"
query("layout_order_clear", f"WITH RECURSIVE {_B}, {_BOXES}, {_CLEAR}, {_ordered('cx')} SELECT doc_id, page_number, block_no, page_ord FROM lo")(lambda s, d: layout.sort_blocks(clear_boxes(s, d)))


def columns(s: SparkSession, d: str) -> DataFrame:
    """Blocks set in two columns without gaps between neighbours, so that the order is known: left column first."""
    b = distinct_blocks(s, d)
    n = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy(F.col("block_id") % 97, "block_id")) - 1
    b = b.withColumn("n", n)
    x = (F.col("n") % 2) * 300.0
    y = F.floor(F.col("n") / 2) * 50.0
    return b.select("doc_id", "page_number", F.col("block_id").alias("block_no"), F.lit(False).alias("is_table"), x.alias("x0"), y.alias("y0"), (x + 250).alias("x1"), (y + 45).alias("y1"))


query(
    "layout_columns",
    f"""WITH {_B}, n AS (SELECT doc_id, page_number, block_id AS block_no, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_id % 97, block_id) - 1 AS n FROM b)
    SELECT doc_id, page_number, block_no, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY n % 2, n) - 1 AS INTEGER) AS page_ord FROM n""",
)(lambda s, d: layout.sort_blocks(columns(s, d)))

# --- classification. \w and \b are wider in Spark; the SQL writes \w out

_U = r"[\p{L}\p{M}\p{N}_]"


def _rx(p: str) -> str:
    """A pattern for SQL: Unicode words and spaces written out, quotes doubled."""
    inside = 0
    out = []
    i = 0
    while i < len(p):
        two = p[i : i + 2]
        if p[i] == "[" and (i == 0 or p[i - 1] != "\\"):
            inside = 1
        elif p[i] == "]" and p[i - 1] != "\\":
            inside = 0
        if two == r"\w":
            out.append(_U[1:-1] if inside else _U)
            i += 2
        elif two == r"\s":
            out.append(_WS[1:-1] if inside else _WS)
            i += 2
        else:
            out.append(p[i])
            i += 1
    return "".join(out).replace("️", r"\x{fe0f}").replace("⃣", r"\x{20e3}").replace("'", "''")


_CODE = "(?i)" + "|".join(f"(?:{_rx(p)})" for p in fixed.CODE_LINES)
_FILENAME = "(?i)" + _rx(fixed.FILENAME)
_ITEM = f"{_rx(fixed.BULLET)}|{_rx(fixed.ORDINAL)}"
_JS = r"^(?:\* @|/\*|\*/)|^\*[\s]+[a-zA-Z_]" + _U + r"*" + _WS + r"*-"


def _is_code(x: str) -> str:
    s = _strip(x)
    ls = f"list_filter(string_split({x}, chr(10)), lambda q: {_strip('q')} <> '')"
    item = f"(regexp_matches({_strip('q')}, '{_ITEM}') AND NOT regexp_matches({_strip('q')}, '{_JS}'))"
    hits = f"len(list_filter({ls}, lambda q: regexp_matches({_strip('q')}, '{_CODE}')))"
    return (
        f"CASE WHEN {s} = '' OR regexp_matches({s}, '{_FILENAME}') THEN false WHEN starts_with({s}, '```') OR starts_with({s}, '~~~') THEN true"
        f" WHEN len(list_filter({ls}, lambda q: NOT (starts_with(q, '    ') OR starts_with(q, chr(9))))) = 0 THEN true WHEN len(list_filter({ls}, lambda q: NOT {item})) = 0 THEN false"
        f" ELSE {hits} > 0 AND (len({ls}) = 1 OR {hits} * 2 >= len({ls})) END"
    )


def _level(x: str) -> str:
    s = _strip(x)
    n = f"len({_solid(s)})"
    single = r"^(\d+)(?:\.|" + _WS + r"+-|" + _WS + r"+–)" + _WS + r"+([^\n]+)$"
    t = _strip(f"regexp_extract({s}, '{single}', 2)")
    letters = rf"regexp_replace({s}, '\P{{L}}+', '', 'g')"
    return (
        f"CASE WHEN {s} = '' OR length({s}) > 150 OR {n} > 2 THEN 0 WHEN regexp_matches({s}, '^(#+){_WS}+[^\\n]+$') THEN least(6, length(regexp_extract({s}, '^(#+)', 1)))"
        f" WHEN regexp_matches({s}, '^(\\d+(?:\\.\\d+)+)\\.?{_WS}+[^\\n]+$') THEN least(6, len(string_split(regexp_extract({s}, '^(\\d+(?:\\.\\d+)+)', 1), '.')))"
        f" WHEN regexp_matches({s}, '{single}') AND {n} = 1 AND NOT regexp_matches({t}, '[;,]$') AND NOT (ends_with({t}, '.') AND len(list_filter(regexp_split_to_array({t}, '{_WS}+'), lambda w: w <> '')) > 6)"
        f" AND (regexp_matches({t}, '^\\p{{Lu}}') OR (regexp_matches({t}, '\\p{{Lu}}') AND NOT regexp_matches({t}, '[\\p{{Ll}}\\p{{Lt}}]'))) THEN 1"
        f" WHEN regexp_matches({s}, '^[0-9]\\x{{fe0f}}?\\x{{20e3}}{_WS}+[^\\n]+$') AND {n} = 1 THEN 3"
        f" WHEN regexp_matches({s}, '(?i)^(?:Capítulo|Capitulo|Chapter|Parte|Part)(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') AND NOT regexp_matches({s}, '[.;]$') THEN 1"
        f" WHEN regexp_matches({s}, '(?i)^(?:Seção|Secao|Section|Anexo|Apêndice|Apendice|Appendix)(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') AND NOT regexp_matches({s}, '[.;]$') THEN 2"
        f" WHEN length({letters}) >= 4 AND regexp_matches({letters}, '^\\p{{Lu}}+$') AND NOT regexp_matches({s}, '[.;!?,]$') AND NOT regexp_matches({s}, '^[-*+•] ') THEN 1 ELSE 0 END"
    )


def _is_list(x: str) -> str:
    s = _strip(x)
    return f"(regexp_matches({s}, '{_ITEM}') OR (len({_solid(s)}) > 1 AND len(list_filter({_solid(s)}, lambda q: regexp_matches(q, '{_ITEM}'))) * 2 >= len({_solid(s)})))"


query("code_lines", f"WITH {_LINES} SELECT line, {_is_code('line')} AS is_code FROM l")(lambda s, d: block_lines(s, d).select("line", C.is_code_block(F.col("line")).alias("is_code")))
query("heading_levels", f"WITH {_LINES} SELECT line, CAST({_level('line')} AS INTEGER) AS level FROM l")(lambda s, d: block_lines(s, d).select("line", C.heading_level(F.col("line")).alias("level")))
query("list_items", f"WITH {_LINES} SELECT line, {_is_list('line')} AS is_item FROM l")(lambda s, d: block_lines(s, d).select("line", C.is_list_item(F.col("line")).alias("is_item")))
_KIND = "CASE WHEN stripped = '' THEN 'paragraph' WHEN code THEN 'code_block' WHEN level > 0 THEN 'heading' WHEN item THEN 'list_item' ELSE 'paragraph' END"
# the text that classification reads: derived structure on some blocks, so that all kinds occur next to each other
_SHAPE = """CASE block_id % 9 WHEN 0 THEN 'const x' || block_id || ' = ' || block_ord || ';' WHEN 1 THEN 'return ' || block_ord || ';' WHEN 2 THEN raw_text WHEN 3 THEN 'print(' || block_id || ')' WHEN 4 THEN '<div class="a">' WHEN 5 THEN '# Teil ' || block_ord WHEN 6 THEN 'word ' || block_id WHEN 7 THEN '- point ' || block_ord ELSE raw_text END"""
_SHAPED = f"sh AS (SELECT block_id, doc_id, block_ord, {_SHAPE} AS raw_text FROM b)"
_CLASSED = f"cl AS (SELECT *, {_KIND} AS block_type FROM (SELECT *, {_strip('raw_text')} AS stripped, {_is_code('raw_text')} AS code, CAST({_level('raw_text')} AS INTEGER) AS level, {_is_list('raw_text')} AS item FROM sh)), kl AS (SELECT block_id, doc_id, block_ord, raw_text, stripped, block_type, CASE WHEN block_type = 'heading' THEN level ELSE 0 END AS heading_level FROM cl)"


def shaped(s: SparkSession, d: str) -> DataFrame:
    return distinct_blocks(s, d).select("block_id", "doc_id", "block_ord", F.expr(_SHAPE).alias("raw_text"), F.lit(None).cast("string").alias("normalized_text"))


query("classify_blocks", f"WITH {_B}, {_SHAPED}, {_CLASSED} SELECT block_id, block_type, heading_level FROM kl")(lambda s, d: B.classify(shaped(s, d)).select("block_id", "block_type", "heading_level"))
_SMOOTH = f"""wn AS (SELECT *, lag(block_type) OVER o AS pt, lead(block_type) OVER o AS nt, lag(stripped) OVER o AS pp, lead(stripped) OVER o AS nn FROM kl WINDOW o AS (PARTITION BY doc_id ORDER BY block_ord)),
sm AS (SELECT block_id, doc_id, block_ord, raw_text, CASE WHEN hit THEN 'code_block' ELSE block_type END AS block_type, CASE WHEN hit THEN 0 ELSE heading_level END AS heading_level FROM (SELECT *, coalesce(
  block_type NOT IN ('code_block', 'heading') AND pt = 'code_block' AND nt = 'code_block' AND NOT regexp_matches(stripped, '{_FILENAME}') AND NOT starts_with(pp, 'export default')
  AND (ends_with(pp, '>') OR regexp_matches(pp, '<([a-zA-Z][\\w.:-]*)(\\s+[^>]*)?>\\s*$') OR starts_with(nn, '</')
    OR ((ends_with(pp, '`') OR contains(pp, '${{')) AND (starts_with(nn, '`') OR contains(nn, '}}'))) OR (len({_splitlines('stripped')}) <= 3 AND NOT regexp_matches(stripped, '[.?!]$'))), false) AS hit FROM wn))"""
query("smooth", f"WITH {_B}, {_SHAPED}, {_CLASSED}, {_SMOOTH} SELECT block_id, block_type, heading_level FROM sm")(lambda s, d: B.classify_documents(shaped(s, d)).select("block_id", "block_type", "heading_level"))

# --- Markdown

_HEAD = rf"""CASE WHEN {{s}} = '' THEN '' ELSE repeat('#', greatest(1, least(6, {{n}}))) || CASE WHEN {_strip("regexp_replace({s}, '^#{{1,6}}" + _WS.replace('{', '{{').replace('}', '}}') + "*', '')")} = '' THEN '' ELSE ' ' || array_to_string({{lines}}, ' ') END END"""


def _fmt_heading(x: str, n: str) -> str:
    s = _strip(x)
    body = _strip(f"regexp_replace({s}, '^#{{1,6}}{_WS}*', '')")
    return f"CASE WHEN {s} = '' THEN '' WHEN {body} = '' THEN repeat('#', greatest(1, least(6, {n}))) ELSE repeat('#', greatest(1, least(6, {n}))) || ' ' || array_to_string({_solid(body)}, ' ') END"


def _fmt_paragraph(x: str) -> str:
    # the look-ahead of the pattern is matched and put back; tags that touch are matched one at a time
    s = _strip(x)
    esc = s
    for _ in range(2):
        esc = rf"regexp_replace({esc}, '<(/?[a-zA-Z]{_U[:-1]}.:-]*(?:{_WS}|>|/|$))', '&lt;\1', 'g')"
    return f"array_to_string({_solid(esc)}, chr(10))"


def _fmt_list(x: str) -> str:
    line = f"""CASE WHEN {_strip('q')} = '' THEN NULL
      WHEN regexp_matches(q, '^{_WS}*[-*+•◦▪▫–—]{_WS}+[^\\n]+$') THEN regexp_extract(q, '^({_WS}*)', 1) || '- ' || {_strip(f"regexp_extract(q, '^{_WS}*[-*+•◦▪▫–—]{_WS}+([^{chr(92)}n]+)$', 1)")}
      WHEN regexp_matches(q, '^{_WS}*\\d+[.)]{_WS}+[^\\n]+$') THEN regexp_extract(q, '^({_WS}*)', 1) || regexp_extract(q, '(\\d+)', 1) || '. ' || {_strip(f"regexp_extract(q, '^{_WS}*{chr(92)}d+[.)]{_WS}+([^{chr(92)}n]+)$', 1)")}
      WHEN regexp_matches(q, '^{_WS}*\\(\\d+\\){_WS}+[^\\n]+$') THEN regexp_extract(q, '^({_WS}*)', 1) || regexp_extract(q, '(\\d+)', 1) || '. ' || {_strip(f"regexp_extract(q, '^{_WS}*{chr(92)}({chr(92)}d+{chr(92)}){_WS}+([^{chr(92)}n]+)$', 1)")}
      WHEN regexp_matches(q, '^{_WS}*(?:[a-zA-Z]|[ivxlcdmIVXLCDM]+)[.)]{_WS}+[^\\n]+$') THEN regexp_extract(q, '^({_WS}*)', 1) || regexp_extract(q, '([a-zA-Z]+)', 1) || '. ' || {_strip(f"regexp_extract(q, '^{_WS}*[a-zA-Z]+[.)]{_WS}+([^{chr(92)}n]+)$', 1)")}
      WHEN i = 1 THEN regexp_extract(q, '^({_WS}*)', 1) || '- ' || {_strip('q')} WHEN length(regexp_extract(q, '^({_WS}*)', 1)) >= 2 THEN regexp_replace(q, '{_WS}+\\z', '') ELSE '  ' || {_strip('q')} END"""
    return f"CASE WHEN {_strip(x)} = '' THEN '' ELSE array_to_string(list_filter(list_transform({_splitlines(x)}, lambda q, i: {line}), lambda q: q IS NOT NULL), chr(10)) END"


def _fmt_table(x: str) -> str:
    ls = _solid(_strip(f"replace({x}, '{chr(92)}|', chr(57344))"))
    return f"""CASE WHEN {_strip(x)} = '' THEN '' ELSE (WITH r AS (SELECT unnest({ls}) AS q, generate_subscripts({ls}, 1) AS i),
      k AS (SELECT min(i) AS k FROM r WHERE regexp_matches(q, '^[\\s|:-]+$') AND contains(q, '-')),
      c AS (SELECT i, list_transform(CASE WHEN contains(q, '|') THEN string_split(regexp_replace(regexp_replace(q, '^\\|', ''), '\\|$', ''), '|') WHEN contains(q, chr(9)) THEN string_split(q, chr(9)) ELSE [q] END, lambda z: {_strip('z')}) AS c FROM r WHERE i IS DISTINCT FROM (SELECT k FROM k)),
      w AS (SELECT max(len(c)) AS w FROM c), f AS (SELECT i, '| ' || array_to_string(list_concat(c, list_transform(range(0, (SELECT w FROM w) - len(c)), lambda z: '')), ' | ') || ' |' AS t FROM c),
      h AS (SELECT i, t FROM f UNION ALL SELECT (SELECT min(i) FROM f) + 0.5, '| ' || array_to_string(list_transform(range(0, (SELECT w FROM w)), lambda z: '---'), ' | ') || ' |' WHERE (SELECT w FROM w) IS NOT NULL)
      SELECT replace(coalesce(string_agg(t, chr(10) ORDER BY i), ''), chr(57344), '{chr(92)}|') FROM h) END"""


def _fmt(fn: Callable[[Column], Column]) -> Query:
    return lambda s, d: distinct_blocks(s, d).select("block_id", fn(F.col("raw_text")).alias("markdown"))


def _fmt_sql(expr: str) -> str:
    return f"WITH {_B} SELECT block_id, {expr} AS markdown FROM b"


query("fmt_heading", _fmt_sql(_fmt_heading("CASE WHEN block_id % 3 = 0 THEN '## ' || raw_text ELSE raw_text END", "heading_level")))(
    lambda s, d: distinct_blocks(s, d).select("block_id", render.format_heading(F.expr("case when block_id % 3 = 0 then '## ' || raw_text else raw_text end"), F.col("heading_level")).alias("markdown"))
)
query("fmt_paragraph", _fmt_sql(_fmt_paragraph("CASE WHEN block_id % 3 = 0 THEN replace(raw_text, ' a', ' <b>a</b> <1') ELSE raw_text END")))(
    lambda s, d: distinct_blocks(s, d).select("block_id", render.format_paragraph(F.expr("case when block_id % 3 = 0 then replace(raw_text, ' a', ' <b>a</b> <1') else raw_text end")).alias("markdown"))
)
query("fmt_list", _fmt_sql(_fmt_list("raw_text")))(_fmt(render.format_list_item))
query("fmt_table", _fmt_sql(_fmt_table("raw_text")))(_fmt(render.format_table))


_INDENTED = r"array_to_string(list_transform(string_split(replace(regexp_replace(raw_text, '[^\x{21}-\x{10ffff}\n]+', ' ', 'g'), '`', ''), chr(10)), lambda q, i: CASE WHEN i % 5 = 0 THEN '  ' ELSE repeat(' ', 2 + i % 3) || q END), chr(10))"
_LINES_OF = f"list_transform(string_split({_INDENTED}, chr(10)), lambda q: CASE WHEN regexp_matches(q, '^[ \\t]*$') THEN '' ELSE q END)"
_DEDENTED = f"(SELECT array_to_string(list_transform(ls, lambda q: substr(q, 1 + coalesce(list_min(list_transform(list_filter(ls, lambda z: z <> ''), lambda z: length(regexp_extract(z, '^ *')))), 0))), chr(10)) FROM (SELECT {_LINES_OF} AS ls))"


def _fmt_code(x: str) -> str:
    return f"CASE WHEN {_strip(_INDENTED)} = '' THEN '' ELSE '```sql' || chr(10) || {_strip(x)} || chr(10) || '```' END"


def indented(c: Column) -> Column:
    """Lines with two to four spaces before them, every fifth blank."""
    ls = F.split(F.replace(F.regexp_replace(c, r"[^\x{21}-\x{10ffff}\n]+", " "), F.lit("`"), F.lit("")), "\n")
    return F.array_join(F.transform(ls, lambda q, i: F.when((i + 1) % 5 == 0, F.lit("  ")).otherwise(F.concat(F.repeat(F.lit(" "), 2 + (i + 1) % 3), q))), "\n")


query("fmt_code", _fmt_sql(_fmt_code(_DEDENTED)))(lambda s, d: distinct_blocks(s, d).select("block_id", render.format_code_block(indented(F.col("raw_text")), "sql").alias("markdown")))
_MD_BLOCK = f"""CASE WHEN {_strip('raw_text')} = '' THEN '' WHEN block_type = 'heading' THEN {_fmt_heading('raw_text', 'heading_level')} WHEN block_type = 'list_item' THEN {_fmt_list('raw_text')} ELSE {_fmt_paragraph('raw_text')} END"""
_FENCED = f"(len({_splitlines(_strip('raw_text'))}) >= 2 AND starts_with({_strip('raw_text')}, '```') AND {_strip(_splitlines(_strip('raw_text')) + '[-1]')} = '```')"
_ISLANDS = f"""il AS (SELECT *, block_type = 'code_block' AND NOT {_FENCED} AS loose FROM sm WHERE block_type <> 'code_block' OR {_strip('raw_text')} <> ''),
iq AS (SELECT *, CASE WHEN NOT loose OR NOT coalesce(lag(loose) OVER o, false) THEN 1 ELSE 0 END AS f FROM il WINDOW o AS (PARTITION BY doc_id ORDER BY block_ord)),
ir AS (SELECT *, CAST(sum(f) OVER (PARTITION BY doc_id ORDER BY block_ord) AS BIGINT) AS island FROM iq)"""
query("code_islands", f"WITH {_B}, {_SHAPED}, {_CLASSED}, {_SMOOTH}, {_ISLANDS} SELECT block_id, island FROM ir")(lambda s, d: B.code_islands(B.classify_documents(shaped(s, d))).select("block_id", "island"))
query(
    "markdown_doc",
    f"""WITH {_B}, {_SHAPED}, {_CLASSED}, {_SMOOTH}, {_ISLANDS},
    pt AS (SELECT doc_id, island, min(block_ord) AS o, '```' || chr(10) || {_strip("string_agg(" + _strip('raw_text') + ", chr(10) ORDER BY block_ord)")} || chr(10) || '```' AS m FROM ir WHERE loose GROUP BY doc_id, island
      UNION ALL SELECT doc_id, island, block_ord, CASE WHEN block_type = 'code_block' THEN {_strip('raw_text')} ELSE {_MD_BLOCK} END FROM ir WHERE NOT loose)
    SELECT d.doc_id, coalesce(string_agg(m, chr(10) || chr(10) ORDER BY o) FILTER (m <> ''), '') AS markdown FROM (SELECT DISTINCT doc_id FROM b) d LEFT JOIN pt USING (doc_id) GROUP BY d.doc_id""",
)(lambda s, d: B.build_markdown(B.classify_documents(shaped(s, d))))
_SIMPLE = f"""CASE WHEN block_type = 'heading' AND heading_level > 0 THEN CASE WHEN starts_with(t, '#') THEN t ELSE repeat('#', heading_level) || ' ' || t END
  WHEN block_type = 'code_block' THEN CASE WHEN starts_with(t, '```') AND ends_with(t, '```') THEN t ELSE '```' || chr(10) || t || chr(10) || '```' END
  WHEN block_type = 'list_item' THEN CASE WHEN regexp_matches(t, '^[-*+] ') OR (length(t) > 3 AND regexp_matches(t, '^\\p{{Nd}}[.)] ')) THEN t ELSE '- ' || t END ELSE t END"""
query(
    "simple_markdown",
    f"WITH {_B}, x AS (SELECT *, {_strip('coalesce(nullif(normalized_text, chr(1)), raw_text)').replace('chr(1)', chr(39) * 2)} AS t FROM b), y AS (SELECT doc_id, block_ord, {_SIMPLE} AS m FROM x WHERE t <> '') SELECT d.doc_id, coalesce(string_agg(m, chr(10) || chr(10) ORDER BY block_ord), '') AS markdown FROM (SELECT DISTINCT doc_id FROM b) d LEFT JOIN y USING (doc_id) GROUP BY d.doc_id",
)(lambda s, d: B.simple_markdown(distinct_blocks(s, d)))
_MARKDOWN = f"""pt AS (SELECT doc_id, island, min(block_ord) AS o, '```' || chr(10) || {_strip("string_agg(" + _strip('raw_text') + ", chr(10) ORDER BY block_ord)")} || chr(10) || '```' AS m FROM ir WHERE loose GROUP BY doc_id, island
      UNION ALL SELECT doc_id, island, block_ord, CASE WHEN block_type = 'code_block' THEN {_strip('raw_text')} WHEN block_type = 'table' THEN {_fmt_table('raw_text')} ELSE {_MD_BLOCK} END FROM ir WHERE NOT loose)"""
query(
    "markdown_as_typed",
    f"""WITH {_B}, sm AS (SELECT block_id, doc_id, block_ord, coalesce(nullif(normalized_text, ''), raw_text, '') AS raw_text, block_type, coalesce(heading_level, 0) AS heading_level FROM b), {_ISLANDS}, {_MARKDOWN}
    SELECT d.doc_id, coalesce(string_agg(m, chr(10) || chr(10) ORDER BY o) FILTER (m <> ''), '') AS markdown FROM (SELECT DISTINCT doc_id FROM b) d LEFT JOIN pt USING (doc_id) GROUP BY d.doc_id""",
)(lambda s, d: B.build_markdown(distinct_blocks(s, d)))

# --- the same over the whole texts of blocks; those that came as tables stay tables

_WHOLE = "sh AS (SELECT block_id, doc_id, block_ord, coalesce(nullif(normalized_text, ''), raw_text, '') AS raw_text FROM b)"
_WHOLE_SMOOTH = (
    _SMOOTH.replace("sm AS (", "s0 AS (", 1)
    + """, sm AS (SELECT s0.block_id, s0.doc_id, s0.block_ord, s0.raw_text, CASE WHEN b.block_type = 'table' THEN 'table' ELSE s0.block_type END AS block_type,
  CASE WHEN b.block_type = 'table' THEN coalesce(b.heading_level, 0) ELSE s0.heading_level END AS heading_level FROM s0 JOIN b USING (block_id))"""
)


def whole(s: SparkSession, d: str) -> DataFrame:
    return distinct_blocks(s, d).select("block_id", "doc_id", "block_ord", "block_type", "heading_level", "raw_text", "normalized_text")


query("classify_text_blocks", f"WITH {_B}, {_WHOLE}, {_CLASSED} SELECT block_id, block_type, heading_level FROM kl")(lambda s, d: B.classify(whole(s, d)).select("block_id", "block_type", "heading_level"))
query("smooth_text", f"WITH {_B}, {_WHOLE}, {_CLASSED}, {_WHOLE_SMOOTH} SELECT block_id, block_type, heading_level FROM sm")(lambda s, d: B.classify_documents(whole(s, d)).select("block_id", "block_type", "heading_level"))
query("code_islands_text", f"WITH {_B}, {_WHOLE}, {_CLASSED}, {_WHOLE_SMOOTH}, {_ISLANDS} SELECT block_id, island FROM ir")(lambda s, d: B.code_islands(B.classify_documents(whole(s, d))).select("block_id", "island"))
query(
    "markdown_text",
    f"""WITH {_B}, {_WHOLE}, {_CLASSED}, {_WHOLE_SMOOTH}, {_ISLANDS},
    pt AS (SELECT doc_id, island, min(block_ord) AS o, '```' || chr(10) || {_strip("string_agg(" + _strip('raw_text') + ", chr(10) ORDER BY block_ord)")} || chr(10) || '```' AS m FROM ir WHERE loose GROUP BY doc_id, island
      UNION ALL SELECT doc_id, island, block_ord, CASE WHEN block_type = 'code_block' THEN {_strip('raw_text')} WHEN block_type = 'table' THEN {_fmt_table('raw_text')} ELSE {_MD_BLOCK} END FROM ir WHERE NOT loose)
    SELECT d.doc_id, coalesce(string_agg(m, chr(10) || chr(10) ORDER BY o) FILTER (m <> ''), '') AS markdown FROM (SELECT DISTINCT doc_id FROM b) d LEFT JOIN pt USING (doc_id) GROUP BY d.doc_id""",
)(lambda s, d: B.build_markdown(B.classify_documents(whole(s, d))))

# --- HTML and names

query("html_title", """SELECT DISTINCT doc_id, replace(replace(replace(replace(replace(coalesce(title, 'Documento'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS title FROM structures""")(
    lambda s, d: table(s, d, "structures").select("doc_id", escape_html(F.coalesce("title", F.lit("Documento"))).alias("title")).distinct()
)
query("output_stem", r"SELECT DISTINCT doc_id, regexp_replace(regexp_extract(source_path, '([^/\\]*)[/\\]*$', 1), '\.[^.]*$', '') AS stem FROM structures")(lambda s, d: table(s, d, "structures").select("doc_id", stem(F.col("source_path")).alias("stem")).distinct())


def html_parts(s: SparkSession, d: str) -> DataFrame:
    """Markdown of every kind of element, made of the letters of blocks, and a title with marks to escape."""
    b = distinct_blocks(s, d)
    words = F.concat(F.lit("a "), F.regexp_replace("raw_text", r"[^\p{L}]+", " "), F.lit(" z"))
    b = b.select("block_id", words.alias("w"), F.concat(F.lit("\"T\" & <"), F.col("block_id").cast("string"), F.lit(">'s")).alias("title"))
    md = F.concat(F.lit("## "), F.col("w"), F.lit("\n\n"), F.col("w"), F.lit("\nb\n\n- "), F.col("w"), F.lit("\n- c\n\n```sql\nx < "), F.col("w"), F.lit("\n```\n\n| "), F.col("w"), F.lit(" | y |\n| --- | --- |\n| 1 | 2 |"))
    return b.withColumn("markdown", md)


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_PAGE_HEAD, _PAGE_MIDDLE, _PAGE_END = html_frame("pt-BR")
_ESC = """replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
query(
    "html_page",
    rf"""WITH {_B}, w AS (SELECT block_id, 'a ' || regexp_replace(raw_text, '[^\p{{L}}]+', ' ', 'g') || ' z' AS w, '"T" & <' || block_id || '>''s' AS title FROM b)
    SELECT block_id, {_sql_text(_PAGE_HEAD)} || {_ESC} || {_sql_text(_PAGE_MIDDLE)} || '<h2>' || w || '</h2>' || chr(10) || '<p>' || w || chr(10) || 'b</p>' || chr(10) || '<ul>' || chr(10) || '<li>' || w || '</li>' || chr(10) || '<li>c</li>' || chr(10) || '</ul>' || chr(10)
      || '<pre><code class="language-sql">x &lt; ' || w || chr(10) || '</code></pre>' || chr(10) || '<table>' || chr(10) || '<thead>' || chr(10) || '<tr>' || chr(10) || '<th>' || w || '</th>' || chr(10) || '<th>y</th>' || chr(10) || '</tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10)
      || '<tr>' || chr(10) || '<td>1</td>' || chr(10) || '<td>2</td>' || chr(10) || '</tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || {_sql_text(_PAGE_END)} AS html FROM w""",
)(lambda s, d: html_parts(s, d).select("block_id", render_html(F.col("markdown"), F.col("title")).alias("html")))
query("html_documents")(lambda s, d: B.build_markdown(distinct_blocks(s, d)).select("doc_id", compile_markdown_to_html(F.col("markdown")).alias("html")))

# --- engines and row checks

query("lang_missing", "SELECT DISTINCT engine_id, list_filter(['por', 'ENG', ' rus ', 'jpn'], lambda r: NOT list_contains(list_transform(coalesce(available_languages, []), lambda x: lower(trim(x))), lower(trim(r)))) AS missing FROM ocr_engines")(
    lambda s, d: table(s, d, "ocr_engines").select("engine_id", engines.missing_languages(F.col("available_languages"), F.array(*map(F.lit, ("por", "ENG", " rus ", "jpn")))).alias("missing")).distinct()
)
query("lang_list", r"SELECT DISTINCT engine_id, list_sort(list_distinct(list_filter(list_transform(available_languages, lambda x: trim(x)), lambda x: regexp_matches(x, '^[a-zA-Z0-9_-]+$')))) AS languages FROM ocr_engines")(
    lambda s, d: table(s, d, "ocr_engines").select("engine_id", engines.language_list(F.concat(F.lit("List of available languages (3):\n"), F.array_join("available_languages", "\n"))).alias("languages")).distinct()
)
query("engine_version", "SELECT DISTINCT engine_id, version FROM ocr_engines")(lambda s, d: table(s, d, "ocr_engines").select("engine_id", engines.version_of(F.concat(F.lit("tesseract v"), "version", F.lit("\n leptonica"))).alias("version")).distinct())
query("engine_check", "SELECT DISTINCT engine_id, is_available AND list_has_all(list_transform(available_languages, lambda x: lower(trim(x))), ['por', 'rus']) AS usable FROM ocr_engines")(
    lambda s, d: engines.check_engines(table(s, d, "ocr_engines"), ["por", "rus"]).select("engine_id", "usable").distinct()
)
_FAULTY = "block_id, page_number - (block_id % 5)::INTEGER AS page_number, heading_level + (block_id % 8)::INTEGER AS heading_level, CASE WHEN block_id % 7 = 0 THEN 'figure' ELSE block_type END AS block_type, CASE WHEN block_id % 11 = 0 THEN NULL ELSE x0 END AS x0, y0, x1, y1"
query(
    "block_faults",
    f"""WITH {_B}, x AS (SELECT {_FAULTY} FROM b) SELECT block_id, list_filter([CASE WHEN NOT coalesce(page_number >= 1, false) THEN 'page_number' END, CASE WHEN NOT coalesce(heading_level BETWEEN 0 AND 6, false) THEN 'heading_level' END,
      CASE WHEN NOT coalesce(block_type IN ({_list(fixed.BLOCK_TYPES)}), false) THEN 'block_type' END, CASE WHEN x0 IS NULL OR y0 IS NULL OR x1 IS NULL OR y1 IS NULL THEN 'bbox' END], lambda z: z IS NOT NULL) AS faults FROM x""",
)(
    lambda s, d: distinct_blocks(s, d).selectExpr(
        "block_id", "page_number - cast(block_id % 5 as int) page_number", "heading_level + cast(block_id % 8 as int) heading_level", "case when block_id % 7 = 0 then 'figure' else block_type end block_type", "case when block_id % 11 = 0 then null else x0 end x0", "y0", "x1", "y1"
    ).select("block_id", block_faults().alias("faults"))
)
query("report_faults", "SELECT DISTINCT report_id, total_chars < 0 OR printable_chars < 0 OR corrupted_chars < 0 OR NOT coalesce(readable_ratio BETWEEN 0 AND 1, true) OR NOT coalesce(corruption_ratio BETWEEN 0 AND 1, true) AS faulty FROM quality_reports")(
    lambda s, d: table(s, d, "quality_reports").select("report_id", (F.size(report_faults()) > 0).alias("faulty")).distinct()
)
query("result_faults", "SELECT DISTINCT result_id, NOT (pages_processed >= 0 AND execution_time_seconds >= 0 AND strategy_used IN ('native_text', 'ocr_fallback')) AS faulty FROM extraction_results")(
    lambda s, d: table(s, d, "extraction_results").select("result_id", (F.size(result_faults()) > 0).alias("faulty")).distinct()
)

# --- reading, writing, options

query("progress", "SELECT DISTINCT page_number, total_pages, round_even(0.15::DOUBLE + 0.5::DOUBLE * page_number / greatest(total_pages, 1), 4) AS done FROM blocks JOIN structures USING (doc_id)")(
    lambda s, d: table(s, d, "blocks").select("doc_id", "page_number").join(table(s, d, "structures").select("doc_id", "total_pages"), "doc_id").select("page_number", "total_pages").distinct().withColumn("done", progress(F.col("page_number"), F.col("total_pages")))
)
query("with_newline", f"WITH {_B}, x AS (SELECT block_id, CASE WHEN block_id % 3 = 0 THEN raw_text || chr(10) WHEN block_id % 7 = 0 THEN NULL ELSE raw_text END AS t FROM b) SELECT block_id, CASE WHEN ends_with(coalesce(t, ''), chr(10)) THEN t ELSE coalesce(t, '') || chr(10) END AS t FROM x")(
    lambda s, d: distinct_blocks(s, d).selectExpr("block_id", "case when block_id % 3 = 0 then raw_text || '\n' when block_id % 7 = 0 then null else raw_text end t").select("block_id", with_newline(F.col("t")).alias("t"))
)
_NAMES = "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '<memory>' WHEN 2 THEN 'in/' || doc_id || '.tar.pdf' ELSE source_path END"
query(
    "output_paths",
    rf"""WITH x AS (SELECT DISTINCT doc_id, {_NAMES} AS p FROM structures), y AS (SELECT doc_id, coalesce(nullif(CASE WHEN p = '<memory>' THEN '' ELSE regexp_replace(regexp_extract(p, '([^/\\]*)[/\\]*$', 1), '\.[^.]*$', '') END, ''), 'output') AS s FROM x)
    SELECT doc_id, 'out/' || s || '.md' AS markdown_path, 'out/' || s || '.html' AS html_path FROM y""",
)(lambda s, d: table(s, d, "structures").selectExpr("doc_id", f"{_NAMES} p").distinct().select("doc_id", *target_paths(F.col("p"), "out")))
query(
    "normal_formats",
    """WITH x AS (SELECT DISTINCT result_id, CASE WHEN html_path IS NULL THEN ' .MD,markdown ,md' WHEN result_id % 3 = 0 THEN 'pdf, HTML' ELSE ' HTML ,.html5,html,' END AS f FROM extraction_results),
    y AS (SELECT result_id, list_filter(list_transform(string_split(f, ','), lambda z: ltrim(lower(trim(z)), '.')), lambda z: z <> '') AS f FROM x)
    SELECT result_id, list_filter(f, lambda z, i: list_position(f, z) = i) AS formats, len(list_filter(f, lambda z: z NOT IN ('md', 'markdown', 'html', 'html5'))) = 0 AS known FROM y""",
)(
    lambda s, d: table(s, d, "extraction_results").selectExpr("result_id", "case when html_path is null then ' .MD,markdown ,md' when result_id % 3 = 0 then 'pdf, HTML' else ' HTML ,.html5,html,' end f").distinct().select("result_id", normal_formats(F.col("f")).alias("formats"), formats_known(F.col("f")).alias("known"))
)
_CODES = "CASE doc_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 6 ELSE NULL END"


def decoded_files(s: SparkSession, d: str) -> DataFrame:
    """Documents as a decoder would report on their files: errors, permissions, encryption."""
    return table(s, d, "structures").selectExpr("doc_id", "source_path", "total_pages n_pages", "doc_id % 4 = 2 is_encrypted", "doc_id % 6 = 2 needs_password", "doc_id % 9 = 0 is_repaired", "cast(doc_id % 64 as int) permissions", "title", "cast(null as string) author", "'PDF 1.7' format", f"{_CODES} error_code", f"case when {_CODES} is null then null else 'code ' || {_CODES} end error").distinct()


query(
    "inspected",
    f"""SELECT DISTINCT doc_id, source_path, total_pages AS n_pages, doc_id % 4 = 2 AS is_encrypted, doc_id % 6 = 2 AS needs_password, doc_id % 9 = 0 AS is_repaired, CAST(doc_id % 64 AS INTEGER) AS permissions, (doc_id % 64) // 4 % 2 = 1 AS can_print, (doc_id % 64) // 16 % 2 = 1 AS can_copy,
    coalesce(title, '') AS title, '' AS author, 'PDF 1.7' AS format, {_CODES} IS NULL AS is_valid, {_CODES} AS error_code, CASE WHEN {_CODES} IS NULL THEN NULL ELSE 'code ' || {_CODES} END AS error FROM structures""",
)(lambda s, d: pdf.inspect(decoded_files(s, d)))
query("validated", f"SELECT DISTINCT doc_id, source_path FROM structures WHERE {_CODES} IS NULL")(lambda s, d: pdf.validate(decoded_files(s, d).where("error_code is null")).select("doc_id", "source_path"))

# --- the whole pipeline


def page_words(s: SparkSession, d: str) -> DataFrame:
    """The words of blocks outside tables, each with its share of the box of its block."""
    b = distinct_blocks(s, d).where("block_type <> 'table'").withColumn("ls", F.split("raw_text", "\n"))
    ln = b.select("doc_id", "page_number", F.col("block_id").alias("block_no"), "x0", "x1", "y0", ((F.col("y1") - F.col("y0")) / F.size("ls")).alias("h"), F.posexplode("ls").alias("line_no", "line"))
    ln = ln.withColumn("ws", F.filter(F.split("line", " "), lambda w: w != "")).withColumn("w", (F.col("x1") - F.col("x0")) / F.size("ws"))
    wd = ln.select("doc_id", "page_number", "block_no", "line_no", "x0", "y0", "w", "h", F.posexplode("ws").alias("word_no", "word"))
    return wd.selectExpr("doc_id", "page_number", "block_no", "line_no", "word_no", "x0 + word_no * w x0", "y0 + line_no * h y0", "x0 + (word_no + 1) * w x1", "y0 + (line_no + 1) * h y1", "word")


def decoded_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables a decoder would give, made of blocks: native text, its words, links, tables, and OCR words."""
    b = cut(distinct_blocks(s, d))
    docs = table(s, d, "structures").groupBy("doc_id").agg(F.min("source_path").alias("source_path"), F.max("total_pages").alias("n_pages"))
    raw = b.where("block_type <> 'table'").select("doc_id", "page_number", F.col("block_id").alias("block_no"), F.lit(0).alias("kind"), "x0", "y0", "x1", "y1", F.col("raw_text").alias("text"))
    tabs = b.where("block_type = 'table'").select("doc_id", "page_number", F.col("block_ord").alias("table_no"), "x0", "y0", "x1", "y1", F.col("raw_text").alias("markdown"))
    return {"documents": docs, "pages": pages(s, d), "blocks_raw": raw, "tables_raw": tabs, "words_raw": page_words(s, d), "links_raw": box_words(s, d)[1], "ocr_words": ocr_words(s, d)}


_CLEAN_NATIVE = f"nc AS (SELECT block_id, raw_text FROM b WHERE block_type <> 'table' AND {_strip('raw_text')} <> '' AND block_id IN (SELECT block_id FROM ta)), {_dehyphenated('nd', 'nc', 'block_id', _clean('raw_text'))}"
_TABLE_ANTI = "ta AS (SELECT block_id FROM b WHERE block_type <> 'table' AND NOT EXISTS (SELECT 1 FROM b t WHERE t.block_type = 'table' AND {strip} <> '' AND t.doc_id = b.doc_id AND t.page_number = b.page_number AND (b.x0 + b.x1) / 2 BETWEEN round_even(t.x0, 2) AND round_even(t.x1, 2) AND (b.y0 + b.y1) / 2 BETWEEN round_even(t.y0, 2) AND round_even(t.y1, 2)))".replace("{strip}", _strip("t.raw_text"))
_BOX2 = ", ".join(f"round_even({c}, 2) AS {c}" for c in ("x0", "y0", "x1", "y1"))
_NATIVE_SQL = f"""{_TABLE_ANTI}, {_CLEAN_NATIVE},
nb AS (SELECT doc_id, page_number, block_id AS block_no, false AS is_table, raw_text, {_strip(_consolidated('t'))} AS normalized_text, {_BOX2} FROM b JOIN nd USING (block_id)
  UNION ALL SELECT doc_id, page_number, block_ord + 524288, true, {_strip('raw_text')}, {_strip('raw_text')}, {_BOX2} FROM b WHERE block_type = 'table' AND {_strip('raw_text')} <> '')"""


def plain_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """decoded_tables without words and links; OCR words of later blocks stand lower on the page, so that the order of stacks is transitive."""
    t = decoded_tables(s, d)
    t["ocr_words"] = t["ocr_words"].withColumn("top", F.col("top") + F.col("par_num") * 20000)
    return {k: v for k, v in t.items() if k not in ("words_raw", "links_raw")}


query("native_blocks", f"WITH RECURSIVE {_B}, {_NATIVE_SQL} SELECT * FROM nb")(lambda s, d: Pipeline().native_blocks(plain_tables(s, d)))
_OCR_SQL = rf"""{_WORDS}, v AS (SELECT * EXCLUDE (text), {_strip('text')} AS text FROM words WHERE {_strip('text')} <> '' AND conf <> -1),
g AS (SELECT doc_id, page_number, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY idx, text) AS line, min(idx) AS i, min(l) AS x0, min(t) AS y0, max(l + w) AS x1, max(t + h) AS y1 FROM v GROUP BY ALL),
po AS (SELECT doc_id, page_number, min(i) AS block_no, string_agg(line, chr(10) ORDER BY line_num) AS raw_text, min(x0) AS x0, min(y0) + par_num * 20000 AS y0, max(x1) AS x1, max(y1) + par_num * 20000 AS y1 FROM g GROUP BY doc_id, page_number, block_num, par_num),
{_dehyphenated('od', 'po', 'doc_id, block_no', _clean('raw_text'))},
ob AS (SELECT doc_id, page_number, CAST(block_no AS BIGINT) AS block_no, false AS is_table, raw_text, {_strip(_consolidated('t'))} AS normalized_text, {", ".join(f"round_even({c} / (300 / 72.0::DOUBLE), 2) AS {c}" for c in ("x0", "y0", "x1", "y1"))} FROM po JOIN od USING (doc_id, block_no))"""
query("ocr_blocks", f"WITH RECURSIVE {_B}, {_OCR_SQL} SELECT * FROM ob")(lambda s, d: Pipeline().ocr_blocks(plain_tables(s, d)))
_STRATEGY = "CASE WHEN corruption_ratio > 0.15 OR solid_chars < 30 OR readable_ratio < 0.8 THEN 'ocr_fallback' ELSE 'native_text' END"
query(
    "pipeline_plain",
    f"""{_QUALITY.strip().replace("WITH b AS", "WITH RECURSIVE b AS", 1)}, str AS (SELECT dc.doc_id, coalesce({_STRATEGY}, 'ocr_fallback') AS strategy FROM dc LEFT JOIN x USING (doc_id)), {_NATIVE_SQL}, {_OCR_SQL},
    bx AS (SELECT nb.* FROM nb JOIN str USING (doc_id) WHERE strategy = 'native_text' UNION ALL SELECT ob.* FROM ob JOIN str USING (doc_id) WHERE strategy = 'ocr_fallback'), {_ordered('bx')},
    pl AS (SELECT doc_id, page_number::BIGINT * 1048576 + page_ord AS block_ord, row_number() OVER () AS block_id, is_table, coalesce(nullif(normalized_text, ''), raw_text, '') AS raw_text FROM bx JOIN lo USING (doc_id, page_number, block_no)),
    sh AS (SELECT block_id, doc_id, block_ord, raw_text FROM pl), {_CLASSED}, {_SMOOTH.replace("sm AS (", "s0 AS (", 1)},
    sm AS (SELECT s0.block_id, s0.doc_id, s0.block_ord, s0.raw_text, CASE WHEN is_table THEN 'table' ELSE s0.block_type END AS block_type, CASE WHEN is_table THEN 0 ELSE s0.heading_level END AS heading_level FROM s0 JOIN pl USING (block_id)), {_ISLANDS}, {_MARKDOWN}
    SELECT dc.doc_id, any_value(s.source_path) AS source_path, any_value(str.strategy) AS strategy, any_value(n_pages) AS total_pages, coalesce(any_value(md.markdown), '') AS markdown
    FROM dc JOIN (SELECT doc_id, min(source_path) AS source_path FROM structures GROUP BY doc_id) s USING (doc_id) JOIN str USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(m, chr(10) || chr(10) ORDER BY o) FILTER (m <> '') AS markdown FROM pt GROUP BY doc_id) md USING (doc_id) GROUP BY dc.doc_id""",
)(lambda s, d: Pipeline(formats=("md",)).run(plain_tables(s, d)))
query("pipeline")(lambda s, d: Pipeline(formats=("md",)).run(decoded_tables(s, d)))
query("pipeline_html")(lambda s, d: Pipeline(formats=("md", "html")).run(decoded_tables(s, d)))


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Markdown of each document, from raw lines through classification, smoothing and code islands."""
    return QUERIES["markdown_text"](spark, root)
