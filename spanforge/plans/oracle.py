"""DuckDB SQL of the queries SQL can express, built from a few shared table expressions."""

from __future__ import annotations

import unicodedata

from spanforge.functions.text import STABLE

MAXLEN, LEAST = 6, 50
SYMBOL = "(▁+[^\\p{L}\\p{N}_\\p{Z}]|[^\\p{L}\\p{N}_\\p{Z}▁])"
BLANK = "[ \\t\\r\\n]+"


def _forms() -> str:
    """Compatibility forms as rows, by rule from the character database."""
    chars = [chr(c) for c in [*range(0xA0, 0x2FF0), *range(0x3000, 0x3400), *range(0xF900, 0xFB50), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)]]
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({q(c)}, {q(n)})" for c in chars if (n := unicodedata.normalize("NFKC", c)) != c)


def prep(source: str) -> str:
    """CTEs that end in prep(t, p): the prepared form p of each distinct text t of `source`."""
    return f"""texts AS MATERIALIZED (SELECT DISTINCT t FROM ({source}) WHERE t IS NOT NULL),
    nf(c, d) AS (VALUES {_forms()}),
    odd AS (SELECT t, nfc_normalize(string_agg(coalesce(d, ch), '' ORDER BY i)) AS u
      FROM (SELECT t, i, substring(t, i, 1) AS ch FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM texts WHERE NOT regexp_matches(t, '{STABLE}'))) LEFT JOIN nf ON ch = c GROUP BY t),
    prep AS MATERIALIZED (SELECT t, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(u, t), '[\\r\\n]+', ' ', 'g'), '[\\p{{Zl}}\\p{{Zp}}\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]', '', 'g'),
      '([0-9]+)', ' \\1 ', 'g'), '{SYMBOL}', ' \\1 ', 'g'), '\\p{{Z}}+', ' ', 'g')) AS p FROM texts LEFT JOIN odd USING (t))"""


TOKENS = "list_filter(string_split({}, ' '), lambda x: x <> '')"
MARKED = "'▁' || regexp_replace({}, '\\p{{Z}}+', '▁', 'g')"
LINES = f"""WITH {prep("SELECT src AS t FROM paired_sp_train UNION ALL SELECT trg FROM paired_sp_train")},
  pairs AS MATERIALIZED (SELECT line_no, {TOKENS.format("a.p")} AS src, {MARKED.format("b.p")} AS trg, a.p AS sp, b.p AS tp
    FROM paired_sp_train l JOIN prep a ON l.src = a.t JOIN prep b ON l.trg = b.t),
  lw AS (SELECT line_no, list_transform(list_filter(string_split(trg, '▁'), lambda x: x <> ''), lambda x: '▁' || x) AS ws, src FROM pairs)
"""
WORD_LINKS = f"""WITH al AS (SELECT line_no, unnest(links) AS l FROM alignment),
  cut AS (SELECT line_no, list_filter(string_split_regex(src, '{BLANK}'), lambda x: x <> '') AS s, list_filter(string_split_regex(trg, '{BLANK}'), lambda x: x <> '') AS t FROM paired_sp_train),
  aw AS MATERIALIZED (SELECT line_no, l.si AS si, l.ti AS ti, s[l.si + 1] AS src_word, t[l.ti + 1] AS trg_word FROM al JOIN cut USING (line_no) WHERE s[l.si + 1] IS NOT NULL AND t[l.ti + 1] IS NOT NULL)
"""
ALIGNED = (
    WORD_LINKS
    + f""", {prep("SELECT src_word AS t FROM aw UNION ALL SELECT trg_word FROM aw")},
  ap AS MATERIALIZED (SELECT {TOKENS.format("a.p")} AS src, {MARKED.format("b.p")} AS trg, count(*) AS n FROM aw JOIN prep a ON src_word = a.t JOIN prep b ON trg_word = b.t GROUP BY 1, 2),
  pw AS MATERIALIZED (SELECT src, word, sum(n) AS n FROM (SELECT src, n, '▁' || unnest(list_filter(string_split(trg, '▁'), lambda x: x <> '')) AS word FROM ap) GROUP BY 1, 2),
  wc AS (SELECT word, sum(n) AS n FROM pw GROUP BY 1),
  ws AS MATERIALIZED (SELECT word, i - 1 AS "start", i - 1 + k AS "end", substring(word, i, k) AS span FROM (SELECT word, i, unnest(range(1, least(length(word) - i + 1, {MAXLEN}) + 1)) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM wc))),
  freq AS MATERIALIZED (SELECT span, CAST(sum(n) AS BIGINT) AS freq FROM ws JOIN wc USING (word) GROUP BY 1),
  inv AS (SELECT count_if(length(span) >= 2 AND freq < {LEAST}) > count_if(NOT (length(span) >= 2 AND freq < {LEAST})) AS inverted FROM freq),
  kept AS MATERIALIZED (SELECT span, freq FROM freq, inv WHERE CASE WHEN inverted THEN freq > {LEAST} OR length(span) = 1 ELSE NOT (length(span) >= 2 AND freq < {LEAST}) END)
"""
)
COUNTS = (
    ALIGNED
    + """, wt AS (SELECT word, unnest(list_distinct(src)) AS token, n FROM (SELECT src, n, '▁' || unnest(list_filter(string_split(trg, '▁'), lambda x: x <> '')) AS word FROM ap)),
  wt2 AS (SELECT word, token, sum(n) AS c FROM wt GROUP BY 1, 2),
  wm AS (SELECT word, span, count(*) AS m FROM ws WHERE span IN (SELECT span FROM kept) GROUP BY 1, 2),
  k AS MATERIALIZED (SELECT span, token, CAST(sum(c * m) AS BIGINT) AS c FROM wt2 JOIN wm USING (word) GROUP BY 1, 2),
  ct AS (SELECT token, CAST(sum(c) AS BIGINT) AS ct FROM k GROUP BY 1),
  cs AS (SELECT span, CAST(sum(c) AS BIGINT) AS cs, max(c) AS cm FROM k GROUP BY 1),
  nn AS (SELECT CAST(sum(c) AS BIGINT) AS norm FROM k)
"""
)
UNITS = (
    COUNTS
    + """, un AS MATERIALIZED (SELECT DISTINCT src, span FROM pw JOIN ws USING (word) WHERE span IN (SELECT span FROM cs)),
  ue AS (SELECT src, span, unnest(src) AS token, unnest(range(0, len(src))) AS pos FROM un),
  uc AS MATERIALIZED (SELECT src, span, pos, token, c, ct, cs, norm FROM ue LEFT JOIN k USING (span, token) LEFT JOIN ct USING (token) JOIN cs USING (span), nn),
  ug AS (SELECT src, span, coalesce(sum(c), 0) AS sc, coalesce(max(c), 0) AS mc, sum(ct) AS sct, max(ln(c) - ln(cs) - ln(ct) + ln(norm)) AS pmi, any_value(norm) AS norm FROM uc GROUP BY 1, 2)
"""
)
UNIQUE = """, ud AS (SELECT src, span, sum(c) AS sc, sum(ct) AS sct, max(ln(c) - ln(ct)) AS cond FROM (SELECT DISTINCT src, span, token, c, ct FROM uc) GROUP BY 1, 2)
"""
SEARCH = """,
  r AS (SELECT uid, word, 0 AS i, [CAST(0 AS DOUBLE)] AS b, [0] AS z FROM un_w
    UNION ALL SELECT uid, any_value(word), any_value(i) + 1, list_append(any_value(b), coalesce(max(x).best, 0)), list_append(any_value(z), coalesce(-max(x).sz, 1))
    FROM (SELECT r.uid, word, i, b, z, CASE WHEN ed.uid IS NOT NULL THEN {'r': round(b[s + 1] + score, 9), 'sz': CAST(s - e AS INTEGER), 'best': b[s + 1] + score} END AS x
      FROM r LEFT JOIN ed ON r.uid = ed.uid AND e = r.i + 1 WHERE i < length(word)) GROUP BY uid),
  bt AS (SELECT uid, word, b[length(word) + 1] AS loss, z, length(word) AS till, CAST([] AS VARCHAR[]) AS toks FROM r WHERE i = length(word)
    UNION ALL SELECT uid, word, loss, z, till - z[till + 1], list_prepend(substring(word, till - z[till + 1] + 1, z[till + 1]), toks) FROM bt WHERE till > 0),
  best AS MATERIALIZED (SELECT uid, word, loss, toks FROM bt WHERE till = 0)
"""


def _search(base: str, units: str, edges: str, longest: int) -> str:
    """CTEs that end in best(uid, word, loss, toks): units (uid, word) and edges (uid, s, e, score) of at most `longest` characters."""
    sql = base + f""", un_w AS MATERIALIZED ({units}), ed AS MATERIALIZED (SELECT * FROM ({edges}) WHERE e - s <= {longest}) {SEARCH}"""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _viterbi(longest: int) -> str:
    edges = """SELECT uid, "start" AS s, "end" AS e, CASE WHEN sc > 0 THEN ln(sc) - ln(sct) ELSE low END AS score FROM pu JOIN ws USING (word) JOIN ug ON pu.src = ug.src AND ws.span = ug.span, (SELECT CAST(min(c) AS DOUBLE) AS low FROM k)"""
    return _search(UNITS + ", pu AS MATERIALIZED (SELECT row_number() OVER () AS uid, src, word, n FROM pw)", "SELECT uid, word FROM pu", edges, longest)


def _best(longest: int) -> str:
    return _viterbi(longest) + "SELECT array_to_string(src, ' ') AS src, best.word, CAST(n AS BIGINT) AS n, round(loss, 6) + 0.0 AS loss, array_to_string(toks, ' ') AS tokens FROM best JOIN pu USING (uid)"


# whole sentence pairs: spans from one occurrence per LINES_PER lines, counts of (span, token), every word given all tokens of its line
LINES_PER = 4
SENTENCES = LINES + f""", lu AS MATERIALIZED (SELECT DISTINCT src, unnest(ws) AS word FROM lw),
  lwc AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM lw) GROUP BY 1),
  lws AS MATERIALIZED (SELECT word, i - 1 AS "start", i - 1 + k AS "end", substring(word, i, k) AS span FROM (SELECT word, i, unnest(range(1, least(length(word) - i + 1, {MAXLEN}) + 1)) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM lwc))),
  lfreq AS MATERIALIZED (SELECT span, CAST(sum(n) AS BIGINT) AS freq FROM lws JOIN lwc USING (word) GROUP BY 1),
  lleast AS (SELECT greatest(2, count(*) // {LINES_PER}) AS least FROM pairs),
  linv AS (SELECT count_if(length(span) >= 2 AND freq < least) > count_if(NOT (length(span) >= 2 AND freq < least)) AS inverted FROM lfreq, lleast),
  lkept AS MATERIALIZED (SELECT span FROM lfreq, linv, lleast WHERE CASE WHEN inverted THEN freq > least OR length(span) = 1 ELSE NOT (length(span) >= 2 AND freq < least) END),
  lwt AS (SELECT word, token, count(*) AS c FROM (SELECT word, unnest(list_distinct(src)) AS token FROM (SELECT src, unnest(ws) AS word FROM lw)) GROUP BY 1, 2),
  lwm AS MATERIALIZED (SELECT word, span, count(*) AS m FROM lws WHERE span IN (SELECT span FROM lkept) GROUP BY 1, 2),
  lk AS MATERIALIZED (SELECT span, token, CAST(sum(c * m) AS BIGINT) AS c FROM lwt JOIN lwm USING (word) GROUP BY 1, 2)
"""
_LUNITS = """, ls AS MATERIALIZED (SELECT row_number() OVER () AS sid, src FROM (SELECT DISTINCT src FROM {units})),
  lp AS MATERIALIZED (SELECT row_number() OVER () AS uid, sid, word FROM (SELECT DISTINCT src, word FROM {units}) JOIN ls USING (src)),
  lt AS MATERIALIZED (SELECT sid, unnest(src) AS token FROM ls), lct AS (SELECT token, sum(c) AS ct FROM lk GROUP BY 1), lst AS (SELECT sid, sum(ct) AS sct FROM lt JOIN lct USING (token) GROUP BY 1),
  lq AS MATERIALIZED (SELECT DISTINCT sid, span FROM lp JOIN lwm USING (word)),
  lsc AS MATERIALIZED (SELECT sid, span, sum(c) AS sc FROM lq JOIN lt USING (sid) JOIN lk USING (span, token) GROUP BY 1, 2)
"""
_LEDGES = """SELECT uid, "start" AS s, "end" AS e, CASE WHEN sc > 0 THEN ln(sc) - ln(sct) ELSE low END AS score FROM lp JOIN lws USING (word) JOIN (SELECT span FROM lkept) USING (span) LEFT JOIN lsc USING (sid, span) LEFT JOIN lst USING (sid), (SELECT CAST(min(c) AS DOUBLE) AS low FROM lk)"""


def _expected() -> str:
    base = UNITS + f""", pu AS MATERIALIZED (SELECT row_number() OVER () AS uid, src, word, n FROM pw),
  e0 AS MATERIALIZED (SELECT uid, "start" AS s, "end" AS e, ws.span AS span, CASE WHEN sc > 0 THEN ln(sc) - ln(sct) END AS score FROM pu JOIN ws USING (word) JOIN ug ON pu.src = ug.src AND ws.span = ug.span),
  e1 AS (SELECT uid, s, e, span, score FROM e0 WHERE score IS NOT NULL UNION ALL
    SELECT uid, i - 1, i, substring(word, i, 1), 0 FROM (SELECT uid, word, unnest(range(1, length(word) + 1)) AS i FROM pu) WHERE (uid, i - 1) NOT IN (SELECT (uid, s) FROM e0 WHERE e = s + 1)),
  tz AS (SELECT uid, max(score) AS top FROM e1 GROUP BY 1), zz AS (SELECT uid, any_value(top) AS top, sum(exp(score - top)) AS z FROM e1 JOIN tz USING (uid) GROUP BY 1),
  ew AS MATERIALIZED (SELECT uid, s, e, span, exp(score - top) / z AS w FROM e1 JOIN zz USING (uid)),
  fa AS (SELECT uid, word, 0 AS i, [CAST(1 AS DOUBLE)] AS a FROM pu UNION ALL SELECT uid, any_value(word), any_value(i) + 1, list_append(any_value(a), coalesce(sum(x), 0)) FROM
    (SELECT fa.uid, word, i, a, a[s + 1] * w AS x FROM fa LEFT JOIN ew ON fa.uid = ew.uid AND e = i + 1 WHERE i < length(word)) GROUP BY uid),
  fb AS (SELECT uid, word, 0 AS i, [CAST(1 AS DOUBLE)] AS b FROM pu UNION ALL SELECT uid, any_value(word), any_value(i) + 1, list_append(any_value(b), coalesce(sum(x), 0)) FROM
    (SELECT fb.uid, word, i, b, b[length(word) - e + 1] * w AS x FROM fb LEFT JOIN ew ON fb.uid = ew.uid AND s = length(word) - i - 1 WHERE i < length(word)) GROUP BY uid)
  SELECT span, token, round(sum(p), 6) + 0.0 AS c FROM (SELECT ew.span, unnest(src) AS token, n * w * a[s + 1] * b[length(pu.word) - e + 1] / len(src) AS p
    FROM ew JOIN pu USING (uid) JOIN fa ON fa.uid = ew.uid AND fa.i = length(pu.word) JOIN fb ON fb.uid = ew.uid AND fb.i = length(pu.word) WHERE ew.span IN (SELECT span FROM cs)) GROUP BY 1, 2"""
    return base.replace("WITH ", "WITH RECURSIVE ", 1)


CELL = """, cell AS (SELECT span, token, c, c / ct AS cond, ln(c) - ln(cs) - ln(ct) + ln(norm) AS pmi FROM k JOIN ct USING (token) JOIN cs USING (span), nn)
"""


def psi(x: str) -> str:
    y, i = f"({x} + 10.0)", f"(1 / (({x} + 10.0) * ({x} + 10.0)))"
    low = " + ".join(f"1 / ({x} + {k}.0)" for k in range(10))
    return f"(ln({y}) - 0.5 / {y} - {i} * (1 / 12.0 - {i} * (1 / 120.0 - {i} * (1 / 252.0 - {i} * (1 / 240.0 - {i} / 132.0)))) - ({low}))"


def _align(score: str, every: bool = False) -> str:
    each = f"SELECT array_to_string(src, ' ') AS src, span, pos, token, {score} AS score FROM uc JOIN cell USING (span, token)"
    rank = "" if every else " QUALIFY row_number() OVER (PARTITION BY src, span ORDER BY round(score, 9) DESC, pos) = 1"
    return UNITS + CELL + f"SELECT src, span, CAST(pos AS INTEGER) AS pos, token, round(score, 6) AS score FROM ({each}){rank}"


CELLS = """WITH clean AS (SELECT DISTINCT * FROM intrinsic_metrics),
  cells AS (SELECT pair, size, vocab, alignment, model, avg(length) AS length, avg(renyi) AS renyi, avg(vocab_overlap) AS vocab_overlap, avg(single_char_macro) AS single_char_macro,
    avg(single_char_micro) AS single_char_micro, avg(vocab_usage) AS vocab_usage, avg(fertility) AS fertility, avg(start_word) AS start_word FROM clean
    WHERE greatest(coalesce(length, 0), coalesce(renyi, 0), coalesce(vocab_overlap, 0), coalesce(single_char_macro, 0), coalesce(single_char_micro, 0), coalesce(vocab_usage, 0), coalesce(fertility, 0), coalesce(start_word, 0)) > 0
    GROUP BY ALL),
  base AS (SELECT * FROM cells WHERE model = 'unigram')
"""


def _ratio(value: str) -> str:
    return CELLS + f"""SELECT c.pair, c.size, c.vocab, c.alignment, c.model, round(CASE WHEN b.{value} <> 0 THEN c.{value} / b.{value} END, 6) AS ratio FROM cells c JOIN base b ON c.pair = b.pair AND c.size = b.size AND c.vocab = b.vocab AND c.alignment = b.alignment WHERE c.model <> 'unigram'"""


_LOG = "ln(CAST(size AS DOUBLE))"

ORACLE: dict[str, str] = {
    "line_scan": "SELECT line_no, trim(regexp_replace(src, '[\\x{2028}\\x{2029}]', '', 'g')) AS src, trim(regexp_replace(trg, '[\\x{2028}\\x{2029}]', ' ', 'g')) AS trg FROM paired_sp_train",
    "prepare_src": LINES + "SELECT line_no, array_to_string(src, ' ') AS src FROM pairs",
    "prepare_trg": LINES + "SELECT line_no, trg FROM pairs",
    "detokenize": LINES + "SELECT line_no, trim(replace(replace(array_to_string(ws, ' '), ' ', ''), '▁', ' ')) AS text FROM lw",
    "text_lengths": LINES + "SELECT line_no, CAST(length(t) AS INTEGER) AS chars, CAST(strlen(t) AS INTEGER) AS bytes, CAST(len(src) AS INTEGER) AS words FROM (SELECT *, array_to_string(src, ' ') AS t FROM pairs)",
    "split_buckets": "SELECT line_no, CAST(floor((line_no - 1) / (SELECT ceil(count(*) / 20) FROM paired_sp_train)) AS INTEGER) AS bucket FROM paired_sp_train",
    "head_lines": "SELECT line_no, src, trg FROM paired_sp_train WHERE line_no <= 1000",
    "span_enumerate": ALIGNED + 'SELECT word, CAST("start" AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", span FROM ws',
    "span_set": ALIGNED + "SELECT span FROM freq",
    "span_frequency": ALIGNED + "SELECT span, freq FROM freq",
    "line_span_frequency": LINES
    + f""", w AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM lw) GROUP BY 1)
    SELECT span, CAST(sum(n) AS BIGINT) AS freq FROM (SELECT n, substring(word, i, unnest(range(1, least(length(word) - i + 1, {MAXLEN}) + 1))) AS span FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)) GROUP BY 1""",
    "span_threshold": ALIGNED + "SELECT span, freq FROM kept",
    "span_list_filter": ALIGNED + "SELECT span, freq FROM freq WHERE span IN (SELECT vocab FROM vocab WHERE vocab IS NOT NULL)",
    "alphabet": ALIGNED + "SELECT DISTINCT span AS char FROM freq WHERE length(span) = 1",
    "cooccurrence": COUNTS + "SELECT span, token, c FROM k",
    "count_marginals": COUNTS + "SELECT 'span' AS axis, span AS key, cs AS total FROM cs UNION ALL SELECT 'token', token, ct FROM ct UNION ALL SELECT 'all', '', norm FROM nn",
    "count_minmax": COUNTS + "SELECT span AS key, min(c) AS least, max(c) AS most FROM k GROUP BY 1",
    "table_add": COUNTS + "SELECT span, token, CASE WHEN c >= 10 THEN 2 * c ELSE c END AS c FROM k",
    "table_scale": COUNTS + "SELECT span, token, round(c * 3 / 2, 6) AS c FROM k",
    "table_upsert": COUNTS + "SELECT span, token, CAST(CASE WHEN c = 1 THEN 5 ELSE c END AS BIGINT) AS c FROM k",
    "sparsity": COUNTS + "SELECT count(*) AS nnz, count(DISTINCT span) AS n_spans, count(DISTINCT token) AS n_tokens, round(1 - count(*) / (count(DISTINCT span) * count(DISTINCT token)), 9) AS sparsity FROM k",
    "delete_spans": COUNTS
    + f""", inv2 AS (SELECT count_if(length(span) >= 2 AND freq < {10 * LEAST}) > count_if(NOT (length(span) >= 2 AND freq < {10 * LEAST})) AS inverted FROM freq)
    SELECT span, token, c FROM k WHERE span NOT IN (SELECT span FROM freq, inv2 WHERE CASE WHEN inverted THEN freq > {10 * LEAST} OR length(span) = 1 ELSE NOT (length(span) >= 2 AND freq < {10 * LEAST}) END)""",
    "row_select": UNITS + "SELECT array_to_string(src, ' ') AS unit, span, CAST(pos AS INTEGER) AS pos, token, coalesce(c, 0) AS c FROM uc",
    "reindex": COUNTS + "SELECT span, row_number() OVER (ORDER BY span) - 1 AS span_id FROM cs",
    "score_max": UNITS + f"SELECT array_to_string(src, ' ') AS src, span, round({psi('mc')} - ln(norm), 6) AS score FROM ug WHERE mc > 0",
    "score_sum": UNITS + f"SELECT array_to_string(src, ' ') AS src, span, round({psi('sc')} - ln(norm), 6) AS score FROM ug WHERE sc > 0",
    "score_max_unpaired": UNITS + f"SELECT array_to_string(src, ' ') AS src, span, round({psi('cm')} - ln(norm), 6) AS score FROM un JOIN cs USING (span), nn",
    "score_sum_unpaired": UNITS + f"SELECT array_to_string(src, ' ') AS src, span, round({psi('cs')} - ln(norm), 6) AS score FROM un JOIN cs USING (span), nn",
    "score_cond_exact": UNITS + "SELECT array_to_string(src, ' ') AS src, span, round(ln(sc) - ln(sct), 6) AS score FROM ug WHERE sc > 0",
    "score_pmi": UNITS + "SELECT array_to_string(src, ' ') AS src, span, round(pmi, 6) AS score FROM ug WHERE pmi IS NOT NULL",
    "score_cpmi": UNITS + UNIQUE + "SELECT array_to_string(src, ' ') AS src, span, round(cond - ln(sc) + ln(sct), 6) AS score FROM ud WHERE sc > 0",
    "align_max": _align("cell.c / 1.0"),
    "align_sum": _align("cell.c / 1.0", every=True),
    "align_cond_exact": _align("cell.cond"),
    "align_pmi": _align("cell.pmi"),
    "align_cpmi": UNITS + UNIQUE + """SELECT array_to_string(src, ' ') AS src, span, CAST(pos AS INTEGER) AS pos, token, round(score, 6) AS score FROM (SELECT uc.src, uc.span, pos, token, ln(c) - ln(sc) - ln(uc.ct) + ln(sct) AS score FROM uc JOIN ud ON uc.src = ud.src AND uc.span = ud.span WHERE c IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY src, span ORDER BY round(score, 9) DESC, pos) = 1""",
    "extract_topk": COUNTS + CELL + "SELECT span, token, round(cond, 6) AS score FROM cell QUALIFY row_number() OVER (PARTITION BY span ORDER BY round(cond, 9) DESC, token) <= 3",
    "information": COUNTS + "SELECT span, round(sum(c * (ln(c) - ln(ct) - ln(cs) + ln(norm)) / norm), 9) AS info FROM k JOIN ct USING (token) JOIN cs USING (span), nn WHERE length(span) > 1 GROUP BY 1",
    "prune_information": COUNTS
    + """, i AS (SELECT span, round(sum(c * (ln(c) - ln(ct) - ln(cs) + ln(norm)) / norm), 12) AS info FROM k JOIN ct USING (token) JOIN cs USING (span), nn WHERE length(span) > 1 GROUP BY 1),
    z AS (SELECT greatest(least(CAST(floor(0.25 * count(*)) AS BIGINT), count(*) - 1000), 0) AS z FROM cs)
    SELECT span, round(info, 9) AS info FROM (SELECT *, row_number() OVER (ORDER BY info, span) AS r FROM i), z WHERE r <= z""",
    "rare_characters": COUNTS
    + """, ch AS (SELECT span AS char, sum(c) AS c FROM k WHERE length(span) = 1 GROUP BY 1), r AS (SELECT char, c, sum(c) OVER (ORDER BY c, char ROWS UNBOUNDED PRECEDING) AS run, sum(c) OVER () AS total FROM ch)
    SELECT char, CAST(c AS BIGINT) AS c FROM r WHERE run <= (1 - CAST(0.99 AS DOUBLE)) * total""",
    "prune_characters": COUNTS
    + """, ch AS (SELECT span AS char, sum(c) AS c FROM k WHERE length(span) = 1 GROUP BY 1), r AS (SELECT char, c, sum(c) OVER (ORDER BY c, char ROWS UNBOUNDED PRECEDING) AS run, sum(c) OVER () AS total FROM ch),
    gone AS (SELECT list(char) AS g FROM r WHERE run <= (1 - CAST(0.99 AS DOUBLE)) * total)
    SELECT span, token, c FROM k, gone WHERE NOT list_has_any(list_transform(range(1, length(span) + 1), lambda i: substring(span, i, 1)), coalesce(g, []))""",
    "word_pairs": WORD_LINKS + "SELECT line_no, si, ti, src_word, trg_word FROM aw",
    "lexical_step": LINES
    + """, e AS (SELECT line_no, list_distinct(src) AS s, list_distinct(ws) AS t FROM lw),
    x AS (SELECT line_no, len(s) AS z, s, unnest(t) AS trg FROM e), y AS (SELECT unnest(s) AS src, trg, 1.0 / z AS p FROM x),
    c AS (SELECT src, trg, sum(p) AS c FROM y GROUP BY 1, 2), g AS (SELECT src, sum(c) AS cs FROM c GROUP BY 1)
    SELECT src, trg, round(c / cs, 8) AS p FROM c JOIN g USING (src)""",
    "vocab_export": ALIGNED
    + """SELECT token, CAST(id AS BIGINT) AS id FROM (VALUES ('<unk>', 0), ('<s>', 1), ('</s>', 2), ('<pad>', 3)) v(token, id) UNION ALL SELECT '▁▁{' || b || '}', b + 4 FROM range(256) r(b)
    UNION ALL SELECT span, 259 + row_number() OVER (ORDER BY span) FROM kept""",
    "decode_ids": LINES + "SELECT line_no, array_to_string(ws, '') AS text FROM lw",
    "extract_max": COUNTS + CELL + "SELECT span, token, round(c / 1.0, 6) AS score FROM cell QUALIFY row_number() OVER (PARTITION BY span ORDER BY c DESC, token) <= 3",
    "extract_pmi": COUNTS + CELL + "SELECT span, token, round(pmi, 6) + 0.0 AS score FROM cell QUALIFY row_number() OVER (PARTITION BY span ORDER BY round(pmi, 9) DESC, token) <= 3",
    "table_increase": COUNTS + "SELECT span, token, CASE WHEN c >= 100 THEN c + 2 ELSE c END AS c FROM k",
    "table_replace": COUNTS + "SELECT span, token, c FROM k WHERE length(span) = 1",
    "ratio_matrix": CELLS
    + """SELECT c.pair, c.size, c.vocab, c.alignment, c.model, round(CASE WHEN b.renyi <> 0 THEN c.renyi / b.renyi END, 6) AS ratio_src, round(CASE WHEN i.renyi <> 0 THEN c.renyi / i.renyi END, 6) AS ratio_trg FROM cells c
    LEFT JOIN base b ON c.pair = b.pair AND c.size = b.size AND c.vocab = b.vocab AND c.alignment = b.alignment
    LEFT JOIN base i ON c.pair = split_part(i.pair, '-', 2) || '-' || split_part(i.pair, '-', 1) AND c.size = i.size AND c.vocab = i.vocab AND c.alignment = i.alignment WHERE c.model <> 'unigram'""",
    "metric_grid": CELLS
    + """, g AS (SELECT * FROM (VALUES ('fra-ita'), ('ita-fra'), ('ces-ukr'), ('ukr-ces')) p(pair), (VALUES (100000), (500000)) s(size), (VALUES (8000), (16000), (32000)) v(vocab), (VALUES ('align')) a(alignment), (VALUES ('unigram'), ('cond-exact')) m(model))
    SELECT pair, CAST(size AS BIGINT) AS size, CAST(vocab AS BIGINT) AS vocab, alignment, model, round(length, 6) AS length, round(renyi, 6) AS renyi, round(vocab_overlap, 6) AS vocab_overlap, round(single_char_macro, 6) AS single_char_macro,
      round(single_char_micro, 6) AS single_char_micro, round(vocab_usage, 6) AS vocab_usage, round(fertility, 6) AS fertility, round(start_word, 6) AS start_word FROM g LEFT JOIN cells USING (pair, size, vocab, alignment, model)""",
    "vocab_merge": """WITH f AS (SELECT vocab AS token, min({'x': export_id, 'i': id}) AS f FROM vocab WHERE vocab IS NOT NULL GROUP BY 1)
    SELECT token, row_number() OVER (ORDER BY f.x, f.i, token) - 1 AS id FROM f""",
    "vocab_overlap": """WITH t AS (SELECT DISTINCT export_id, vocab AS token FROM vocab WHERE vocab IS NOT NULL), n AS (SELECT export_id, count(*) AS n FROM t GROUP BY 1),
    x AS (SELECT export_id, n, lead(export_id) OVER (ORDER BY export_id) AS other_id, lead(n) OVER (ORDER BY export_id) AS m FROM n),
    k AS (SELECT x.export_id, count(*) AS k FROM x JOIN t a ON a.export_id = x.export_id JOIN t b ON b.export_id = x.other_id AND a.token = b.token GROUP BY 1)
    SELECT export_id, other_id, round(coalesce(k, 0) / (n + m - coalesce(k, 0)), 6) AS overlap FROM x LEFT JOIN k USING (export_id) WHERE other_id IS NOT NULL""",
    "viterbi_tokens": _best(MAXLEN - 1),
    "viterbi_inclusive": _best(MAXLEN),
    "hard_count_step": _viterbi(MAXLEN - 1) + "SELECT span, token, CAST(sum(n) AS BIGINT) AS c FROM (SELECT span, unnest(src) AS token, n FROM (SELECT uid, unnest(toks) AS span FROM best) JOIN pu USING (uid)) GROUP BY 1, 2",
    "expected_counts_step": _expected(),
    "sentence_counts": SENTENCES + "SELECT span, token, c FROM lk",
    "tokenize_paired": _search(SENTENCES + _LUNITS.format(units="lu"), "SELECT uid, word FROM lp", _LEDGES, MAXLEN)
    + """SELECT line_no, array_to_string(flatten(list(toks ORDER BY pos)), ' ') AS tokens, round(sum(loss), 4) + 0.0 AS loss FROM (SELECT line_no, src, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM lw) w
    JOIN ls USING (src) JOIN lp ON lp.sid = ls.sid AND lp.word = w.word JOIN best ON best.uid = lp.uid GROUP BY 1""",
    "alphabet_filter": ALIGNED + f""", alph AS (SELECT list(span) AS a FROM freq WHERE length(span) = 1 AND freq >= {10 * LEAST})
    SELECT word, CAST(n AS BIGINT) AS n, len(list_filter(list_transform(range(1, length(word) + 1), lambda i: substring(word, i, 1)), lambda c: NOT list_contains(a, c))) = 0 AS known FROM wc, alph""",
    "encode_ids": LINES + f""", w AS (SELECT line_no, unnest(ws) AS token, unnest(range(0, len(ws))) AS pos FROM lw), wn AS (SELECT token AS word, count(*) AS n FROM w GROUP BY 1),
    fr AS (SELECT span, sum(n) AS freq FROM (SELECT n, substring(word, i, unnest(range(1, least(length(word) - i + 1, {MAXLEN}) + 1))) AS span FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM wn)) GROUP BY 1),
    iv AS (SELECT count_if(length(span) >= 2 AND freq < 200) > count_if(NOT (length(span) >= 2 AND freq < 200)) AS inverted FROM fr),
    vo AS (SELECT span AS token, 259 + row_number() OVER (ORDER BY span) AS id FROM fr, iv WHERE CASE WHEN inverted THEN freq > 200 OR length(span) = 1 ELSE NOT (length(span) >= 2 AND freq < 200) END),
    ids AS (SELECT line_no, pos, CASE WHEN id IS NOT NULL THEN [id] ELSE list_transform(range(0, strlen(token)), lambda i: CAST('0x' || substring(hex(encode(token)), 2 * i + 1, 2) AS BIGINT) + 4) END AS x FROM w LEFT JOIN vo USING (token))
    SELECT line_no, array_to_string(list_concat([1], coalesce(flatten(list(x ORDER BY pos) FILTER (x IS NOT NULL)), []), [2]), ' ') AS ids FROM pairs LEFT JOIN ids USING (line_no) GROUP BY 1""",
    "token_metrics": LINES
    + """, a AS (SELECT ws AS tokens, len(src) AS w, len(list_filter(ws, lambda x: length(regexp_replace(x, '^▁', '')) = 1)) AS single FROM lw),
    s AS (SELECT sum(len(tokens)) AS n, count(*) AS lines, sum(w) AS words, sum(single) AS single, avg(CASE WHEN len(tokens) > 0 THEN single / len(tokens) END) AS macro FROM a),
    f AS (SELECT t, count(*) AS c FROM (SELECT unnest(tokens) AS t FROM a) GROUP BY 1),
    g AS (SELECT count(*) AS used, sum(pow(c / n, 3)) AS p3, sum(CASE WHEN starts_with(t, '▁') THEN c ELSE 0 END) AS starts FROM f, s)
    SELECT round(n / lines, 6) AS length, round(n / words, 6) AS fertility, round(macro, 6) AS single_char_macro, round(single / n, 6) AS single_char_micro, round(starts / n, 6) AS start_word, round(ln(p3) / -2 / ln(used), 6) AS renyi, round(used / used, 6) AS vocab_usage FROM s, g""",
    "lm_metrics": LINES
    + """, e AS (SELECT line_no, unnest(src) AS w FROM pairs), f AS (SELECT w, count(*) AS c FROM e GROUP BY 1), n AS (SELECT count(*) AS n FROM e),
    l AS (SELECT line_no, sum(-ln(c / n)) AS loss FROM e JOIN f USING (w), n GROUP BY 1),
    s AS (SELECT sum(loss) AS l, count(*) AS n, sum(len(src)) AS tokens, sum(length(array_to_string(src, ' '))) AS chars, sum(strlen(array_to_string(src, ' '))) AS bytes FROM pairs JOIN l USING (line_no))
    SELECT round(l / n, 4) AS eval_loss, round(exp(l / n), 4) AS eval_ppl, round(exp(l / tokens), 4) AS eval_ppl_token, round(exp(l / tokens), 4) AS eval_ppl_words, round(exp(l / chars), 4) AS eval_ppl_chars, round(exp(l / bytes), 4) AS eval_ppl_bytes,
      round(l / bytes / ln(2.0), 4) AS eval_bpb, round(l / chars / ln(2.0), 4) AS eval_bpc FROM s""",
    "cell_mean": CELLS
    + "SELECT pair, size, vocab, alignment, model, round(length, 6) AS length, round(renyi, 6) AS renyi, round(vocab_overlap, 6) AS vocab_overlap, round(single_char_macro, 6) AS single_char_macro, round(single_char_micro, 6) AS single_char_micro, round(vocab_usage, 6) AS vocab_usage, round(fertility, 6) AS fertility, round(start_word, 6) AS start_word FROM cells",
    "parity_ratio": CELLS
    + "SELECT c.pair, c.size, c.vocab, c.alignment, c.model, round(c.length / b.length, 6) AS parity FROM cells c JOIN base b ON c.pair = split_part(b.pair, '-', 2) || '-' || split_part(b.pair, '-', 1) AND c.size = b.size AND c.vocab = b.vocab AND c.alignment = b.alignment",
    "renyi_ratio": _ratio("renyi"),
    "length_ratio": _ratio("length"),
    "metric_pivot": CELLS
    + "SELECT pair, alignment, model, size, " + ", ".join(f"round(avg(fertility) FILTER (vocab = {v}), 6) AS v{v}" for v in (8000, 16000, 32000)) + " FROM cells GROUP BY 1, 2, 3, 4",
    "metric_trend": CELLS + "SELECT pair, size, vocab, alignment, model, round(renyi, 6) AS renyi FROM cells WHERE (pair, size) IN (SELECT (pair, max(size)) FROM cells GROUP BY pair)",
    "linear_extrapolation": CELLS
    + f""", g AS (SELECT pair, vocab, alignment, max(renyi) AS goal FROM base GROUP BY 1, 2, 3),
    f AS (SELECT pair, vocab, alignment, model, regr_slope(renyi, {_LOG}) AS slope, regr_intercept(renyi, {_LOG}) AS intercept FROM cells WHERE model <> 'unigram' AND renyi IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT pair, vocab, alignment, model, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(goal, 5) AS goal, round(CASE WHEN slope <> 0 THEN (goal - intercept) / slope END, 5) AS log_size FROM f JOIN g USING (pair, vocab, alignment)""",
}
# the same searches by SQL, too slow for whole tables: compared on small ones
SLOW = {k: ORACLE.pop(k) for k in ("viterbi_tokens", "hard_count_step", "expected_counts_step", "tokenize_paired")}
ORACLE |= {k: v.replace(", 6) AS score", ", 6) + 0.0 AS score") for k, v in ORACLE.items() if k.startswith(("score_", "align_"))}  # no negative zero
