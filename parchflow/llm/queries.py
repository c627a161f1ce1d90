"""Queries of the training-data problems, by name, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parchflow.llm import boilerplate, encoding, language, leakage, mixing, normal, prose, residue, scan
from parchflow.runtime import table


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, name)


blocks, structures, documents = _t("blocks"), _t("structures"), _t("documents")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: prose.not_prose(blocks(s, d), structures(s, d)),
    "p1_statistics": lambda s, d: prose.statistics(blocks(s, d), structures(s, d), table(s, d, "quality_reports")),
    "p2_found": lambda s, d: scan.noise(blocks(s, d), structures(s, d)),
    "p2_paragraphs": lambda s, d: scan.paragraphs(blocks(s, d), structures(s, d)),
    "p3_found": lambda s, d: normal.lookalike_pairs(blocks(s, d)),
    "p3_classes": lambda s, d: normal.lookalike_classes(blocks(s, d)),
    "p3_normalized": lambda s, d: normal.normalize(blocks(s, d)).distinct(),
    "p4_found": lambda s, d: boilerplate.repeated_lines(blocks(s, d)),
    "p4_blocks": lambda s, d: boilerplate.boilerplate_blocks(blocks(s, d)),
    "p4_clean": lambda s, d: boilerplate.without_repeated(blocks(s, d)),
    "p5_found": lambda s, d: language.unlabelled(blocks(s, d), structures(s, d), table(s, d, "ocr_engines")),
    "p5_segments": lambda s, d: language.segments(blocks(s, d), language.train(blocks(s, d), structures(s, d), table(s, d, "ocr_engines"))).dropDuplicates(["block_id", "lang"]),
    "p5_documents": lambda s, d: language.document_languages(blocks(s, d), structures(s, d), table(s, d, "ocr_engines")),
    "p6_found": lambda s, d: encoding.garbled(blocks(s, d)),
    "p6_restored": lambda s, d: encoding.restored(blocks(s, d)).distinct(),
    "p7_found": lambda s, d: leakage.leaked(documents(s, d), table(s, d, "eval_items")),
    "p7_report": lambda s, d: leakage.leaks(documents(s, d), table(s, d, "eval_items")),
    "p7_reordered": lambda s, d: leakage.leaks(documents(s, d), table(s, d, "eval_items"), k=6, min_coverage=0.5),
    "p8_mix": lambda s, d: mixing.mix(documents(s, d), table(s, d, "mix_targets"))[1],
    "p8_copies": lambda s, d: mixing.mix(documents(s, d), table(s, d, "mix_targets"))[0],
    "p9_found": lambda s, d: residue.residue_only(documents(s, d)),
    "p9_report": lambda s, d: residue.residue_report(documents(s, d)),
}

_P4 = """
WITH l AS (SELECT site, doc_id, block_id, i AS line_no, regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') AS k
           FROM (SELECT site, doc_id, block_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i
                 FROM blocks WHERE site IS NOT NULL AND doc_id IS NOT NULL)),
n AS (SELECT site, count(DISTINCT doc_id) AS n FROM blocks WHERE site IS NOT NULL GROUP BY site),
k AS (SELECT l.site, k, count(DISTINCT doc_id) AS docs FROM l JOIN n USING (site) WHERE length(k) >= 12 GROUP BY l.site, k, n.n
      HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.25 * n.n)
"""
ORACLES: dict[str, str] = {
    "p4_found": _P4 + "SELECT DISTINCT block_id, CAST(line_no AS INTEGER) AS line_no FROM l JOIN k USING (site, k)",
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(CASE WHEN contains(text, '\u') THEN
             array_to_string(list_transform(string_split(regexp_replace(text, '\\\\u([0-9a-fA-F]{4})', chr(1) || '\1' || chr(2), 'g'), chr(1)),
               lambda p: CASE WHEN contains(p, chr(2)) THEN chr(CAST('0x' || split_part(p, chr(2), 1) AS INTEGER)) || substr(p, 6) ELSE p END), '') ELSE text END),
             '\\+[nrtbfv]', ' ', 'g'), '_', ' ', 'g'), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
h AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)""",
}
