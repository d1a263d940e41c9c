"""Queries of the training-data operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from spanforge.llm import encoding, format_dups, language, mojibake, one_form, packing, split_overlap, subjects, term_counts

QUERIES = {
    "p1_found": term_counts.p1_found,
    "p1_counts": term_counts.p1_counts,
    "p1_changes": term_counts.p1_changes,
    "p2_found": language.p2_found,
    "p2_segments": language.p2_segments,
    "p3_found": mojibake.p3_found,
    "p3_restored": mojibake.p3_restored,
    "p4_found": one_form.p4_found,
    "p4_forms": one_form.p4_forms,
    "p5_found": split_overlap.p5_found,
    "p5_report": split_overlap.p5_report,
    "p5_fractions": split_overlap.p5_fractions,
    "p6_found": format_dups.p6_found,
    "p6_collapsed": format_dups.p6_collapsed,
    "p7_ids": encoding.p7_ids,
    "p7_decode": encoding.p7_decode,
    "p8_containers": packing.p8_containers,
    "p8_fill": packing.p8_fill,
    "p9_found": subjects.p9_found,
    "p9_composition": subjects.p9_composition,
}

_TERMS = """
WITH v AS (SELECT vocab AS term, count(*) AS occurrences, count(DISTINCT export_id) AS records FROM vocab WHERE vocab IS NOT NULL GROUP BY 1),
     e AS (SELECT count(DISTINCT export_id) AS n FROM vocab),
     p AS (SELECT line_no, unnest(string_split_regex(trg, '[ \\t\\r\\n]+')) AS term FROM paired_sp_train WHERE trg IS NOT NULL),
     t AS (SELECT term, count(*) AS occurrences, count(DISTINCT line_no) AS records FROM p WHERE term <> '' GROUP BY 1),
     r AS (SELECT count(trg) AS n FROM paired_sp_train),
     m AS (SELECT 'vocab' AS field, term, occurrences, records, CASE WHEN occurrences = 1 THEN 'rare' WHEN records > 0.4 * n THEN 'common' END AS mark FROM v, e
           UNION ALL SELECT 'trg', term, occurrences, records, CASE WHEN occurrences <= 2 THEN 'rare' WHEN records > 0.02 * n THEN 'common' END FROM t, r)
"""
_CHANGED = _TERMS.replace("vocab WHERE vocab IS NOT NULL", "vocab WHERE vocab IS NOT NULL AND export_id <> 1").replace("AS n FROM vocab)", "AS n FROM vocab WHERE export_id <> 1)").replace("(trg, '", "(CASE WHEN split = 'dev' THEN lower(trg) ELSE trg END, '").replace(
    "paired_sp_train WHERE trg IS NOT NULL", "paired_sp_train WHERE trg IS NOT NULL AND split <> 'devtest'").replace("AS n FROM paired_sp_train)", "AS n FROM paired_sp_train WHERE split <> 'devtest')")
_COPIES = """
WITH k AS (SELECT line_no, regexp_replace(lower(src), '[^\\p{L}\\p{N}]+', '', 'g') AS x, regexp_replace(lower(trg), '[^\\p{L}\\p{N}]+', '', 'g') AS y FROM paired_sp_train),
     m AS (SELECT line_no, min(line_no) OVER (PARTITION BY least(x, y), greatest(x, y)) AS first_line FROM k WHERE x <> '' AND y <> '')
"""
_OVERLAP = """
WITH t AS (SELECT line_no, coalesce(split IN ('dev', 'devtest'), FALSE) AS ev, 0 AS f, src AS x FROM paired_sp_train UNION ALL SELECT line_no, coalesce(split IN ('dev', 'devtest'), FALSE), 1, trg FROM paired_sp_train),
     w AS (SELECT line_no, ev, f, list_distinct(regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+')) AS s FROM t WHERE x IS NOT NULL),
     e AS (SELECT line_no, ev, f, len(s) AS n, unnest(s) AS word FROM w),
     p AS (SELECT a.line_no AS a, b.line_no AS b, a.f AS fa, b.f AS fb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.word = b.word WHERE a.ev AND NOT b.ev GROUP BY 1, 2, 3, 4),
     m AS (SELECT DISTINCT a, b FROM p WHERE k >= 0.8 * (na + nb - k))
"""
ORACLE = {
    "p7_decode": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p5_found": _OVERLAP + "SELECT least(a, b) AS line_a, greatest(a, b) AS line_b FROM m",
    "p5_report": _OVERLAP + "SELECT split, source, count(*) AS pairs, count(DISTINCT a) AS eval_rows, count(DISTINCT b) AS train_rows FROM m JOIN paired_sp_train ON a = line_no GROUP BY 1, 2",
    "p1_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_counts": _TERMS + "SELECT field, term, CAST(occurrences AS BIGINT) AS occurrences, CAST(records AS BIGINT) AS records, mark FROM m",
    "p1_changes": _CHANGED + "SELECT field, term, CAST(occurrences AS BIGINT) AS occurrences, CAST(records AS BIGINT) AS records, mark FROM m",
    "p6_found": _COPIES + "SELECT first_line, line_no FROM m WHERE line_no <> first_line",
    "p6_collapsed": _COPIES + "SELECT first_line AS line_no, count(*) AS copies FROM m GROUP BY 1",
}
