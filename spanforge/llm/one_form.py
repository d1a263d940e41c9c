"""Problem 4: texts that look alike brought to one consistent form.

Every Arrow partition is handed to an embedded DuckDB, whose SQL maps compatibility forms, invisible characters, blanks,
hyphens and look-alike letters with nfc_normalize, translate and regular expressions.  Look-alikes are folded inside
words of mixed script, and in whole words only where all letters of the other script in the text are look-alikes;
whole words in another script stay.

Defined results: null stays null, empty stays empty; ordinary dashes, quotation marks, repeated blanks and tabs stay;
superscripts, fractions and symbols stay; texts of any length are mapped whole; repeated rows come out as often as they
occur; other columns are not touched.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.common import materialise, ship, table

# look-alike pairs, fixed values: Cyrillic, then Greek, with the Latin letter of the same look
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮҺаесіјорѕухһԁԛԝӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYhaecijopsyxhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχϳϲϹ"
GREEK_AS = "ABEZHIKMNOPTYXaivopuxjcC"
OTHERS = "օոսհցզՍՕԼᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏔᏙᏚᏞᏟᏢᏦᏴ"  # Armenian, Cherokee
OTHERS_AS = "onuhgqUOLDRTAJEWMHGZWVSLCPKB"
GREEK_CYRILLIC = "ΑΒΕΗΙΚΜΟΡΤΥΧαικορχ"
GREEK_CYRILLIC_AS = "АВЕНІКМОРТУХаікорх"
LATIN = "ıɑɡɩⅼ"
LATIN_AS = "iagil"
INVISIBLE = "[\\x{AD}\\x{34F}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{206F}\\x{FEFF}]"
BLANK = "[\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
HYPHEN = "[\\x{2010}\\x{2011}\\x{2212}\\x{FE63}\\x{FF0D}]"


@lru_cache(1)
def compat() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility forms of letters and digits, by rule from the character database: single-character maps as two strings, and longer ones."""
    a, b, longer = [], [], []
    for c in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        ch = chr(c)
        tag = unicodedata.decomposition(ch).partition(">")[0]
        to = unicodedata.normalize("NFKC", ch)
        if ch == "µ" or ch in GREEK or to == ch or tag not in ("<font", "<wide", "<narrow", "<compat", "<circle", "<initial", "<medial", "<final", "<isolated"):
            continue
        if tag not in ("<wide", "<narrow") and (unicodedata.category(ch)[0] == "S" and tag != "<circle" or not all(unicodedata.category(x)[0] in "LN" for x in to)):
            continue
        if len(to) == 1 and ch != "　":
            a.append(ch)
            b.append(to)
        elif len(to) > 1:
            longer.append((ch, to))
    return "".join(a), "".join(b), longer


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(1)
def form_sql() -> str:
    """The mapping of column t of view x, as SQL text of DuckDB."""
    a, b, longer = compat()
    wide = f"translate(t, {_quote(a)}, {_quote(b)})"
    for ch, to in longer:
        if "LATIN" in unicodedata.name(ch, "") or 0xFB00 <= ord(ch) < 0xFB07:
            wide = f"replace({wide}, {_quote(ch)}, {_quote(to)})"
    odd = "[^\\x{0}-\\x{9F}\\x{A1}-\\x{AC}\\x{AE}-\\x{130}\\x{132}-\\x{17F}\\x{400}-\\x{481}\\x{48A}-\\x{52F}\\x{2012}-\\x{2027}\\x{2030}-\\x{205E}\\x{20A0}-\\x{20CF}{signs}]|[\\x{132}\\x{133}\\x{17F}]".replace("{signs}", "".join(chr(c) for c in range(0x2100, 0x2150) if unicodedata.category(chr(c))[0] != "L"))
    to_lat = f"translate(w, {_quote(CYRILLIC + GREEK + LATIN + OTHERS)}, {_quote(CYRILLIC_AS + GREEK_AS + LATIN_AS + OTHERS_AS)})"
    lat_from = "ABEIKMHOPCTYXaeciopyx"  # those whose look-alike stands in a Cyrillic alphabet of the data
    to_cyr = f"translate(w, {_quote(lat_from)}, {_quote('АВЕІКМНОРСТУХаесіорух')})"
    foreign = "[\\p{Cyrillic}\\p{Greek}\\p{Armenian}\\p{Cherokee}]"
    in_word = lambda s: f"length(regexp_replace(w, '[^{s}]+', '', 'g'))"
    cyr, lat = in_word(chr(92) + "p{Cyrillic}"), in_word(chr(92) + "p{Latin}")
    more_cyr = f"({cyr} > {lat} OR {cyr} = {lat} AND mostly_cyr)"  # most letters of the word decide, then those of the text
    word = f"""CASE WHEN regexp_matches(w, '\\p{{Greek}}') AND regexp_matches(w, '\\p{{Cyrillic}}') AND NOT regexp_matches(w, '\\p{{Latin}}')
          THEN translate(w, {_quote(GREEK_CYRILLIC)}, {_quote(GREEK_CYRILLIC_AS)})
        WHEN NOT (regexp_matches(w, '{foreign}|[{LATIN}]') AND (any_lat OR regexp_matches(w, '\\p{{Latin}}'))) THEN w
        WHEN regexp_matches(w, '\\p{{Latin}}') THEN CASE WHEN NOT regexp_matches({to_lat}, '{foreign}') THEN CASE WHEN {more_cyr} AND NOT regexp_matches({to_cyr}, '\\p{{Latin}}') THEN {to_cyr} ELSE {to_lat} END
             WHEN NOT regexp_matches({to_cyr}, '\\p{{Latin}}') THEN {to_cyr} ELSE w END
        WHEN all_like AND NOT mostly_cyr THEN {to_lat} ELSE w END"""
    latin_word = f"CASE WHEN lat_like AND mostly_cyr AND regexp_matches(w, '\\p{{Latin}}') AND NOT regexp_matches(w, '{foreign}') AND NOT regexp_matches({to_cyr}, '\\p{{Latin}}') THEN {to_cyr} ELSE {word} END"
    letters = lambda s: f"length(regexp_replace(u, '[^{s}]+', '', 'g'))"
    return f"""
    WITH plain AS (
      SELECT i, t, CASE WHEN NOT regexp_matches(t, '{odd}|\\x{{A0}}|\\x{{AD}}') THEN nfc_normalize(t)
        ELSE nfc_normalize(regexp_replace(regexp_replace(regexp_replace({wide}, '{INVISIBLE}', '', 'g'), '{BLANK}', ' ', 'g'), '{HYPHEN}', '-', 'g')) END AS u FROM x),
    mixed AS (SELECT i, u, {letters(chr(92) + 'p{Latin}')} AS n_lat, {letters(foreign[1:-1])} AS n_cyr,
        {letters(CYRILLIC + GREEK + OTHERS)} AS n_like, {letters(lat_from)} AS n_lat_like
      FROM plain WHERE regexp_matches(u, '\\p{{Latin}}') AND regexp_matches(u, '{foreign}|[{LATIN}]') OR regexp_matches(u, '\\p{{Greek}}') AND regexp_matches(u, '\\p{{Cyrillic}}')),
    folded AS (SELECT i, array_to_string(list_transform(regexp_extract_all(u, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: {latin_word}), '') AS u
      FROM (SELECT i, u, n_lat > 0 AS any_lat, n_cyr > n_lat AS mostly_cyr, n_cyr = n_like AS all_like, n_lat = n_lat_like AS lat_like FROM mixed))
    SELECT coalesce(nfc_normalize(f.u), p.u) AS u FROM plain p LEFT JOIN folded f USING (i) ORDER BY p.i"""


def connect():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    con.execute("SET preserve_insertion_order = true")
    return con


def _run(keys: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, sql = connect(), form_sql()
        for b in batches:
            out = list(b.columns[:keys])
            for c in range(keys, b.num_columns):
                x = pa.table({"i": pa.array(range(b.num_rows), pa.int64()), "t": b.column(c).cast(pa.string())})  # noqa: F841
                con.register("x", x)
                out.append(con.sql(sql).to_arrow_table()["u"].combine_chunks().cast(pa.string()))
                con.unregister("x")
            yield pa.RecordBatch.from_arrays(out, names=b.schema.names)

    return run


def one_form(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The rows with each field in its one form."""
    ship(rows.sparkSession)
    out = rows.select(*keys, *fields)
    return out.mapInArrow(_run(len(keys)), out.schema)


def may_differ(text: Column) -> Column:
    """False only for texts of printable ASCII and precomposed letters of one script, which are in their one form already."""
    latin = "^[\\x{0}-\\x{9F}\\x{A1}-\\x{AC}\\x{AE}-\\x{130}\\x{134}-\\x{17E}\\x{2012}-\\x{2027}\\x{2030}-\\x{205E}\\x{20A0}-\\x{20CF}]*$"
    cyrillic = "^[\\x{0}-@\\[-`{-\\x{9F}\\x{A1}-\\x{A9}\\x{AB}\\x{AC}\\x{AE}-\\x{B9}\\x{BB}-\\x{BF}\\x{400}-\\x{481}\\x{48A}-\\x{52F}\\x{2012}-\\x{2027}\\x{2030}-\\x{205E}]*$"
    return ~(text.rlike(latin) | text.rlike(cyrillic))


def changed(rows: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, field, text, form) of the fields that are not in their one form."""
    each = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("e")).select("id", "e.field", "e.text")
    odd = each.where(may_differ(F.col("text"))).select("id", "field", "text", F.col("text").alias("form"))
    ship(rows.sparkSession)
    return odd.mapInArrow(_run(3), odd.schema).where("form <> text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm import mojibake

    rows = table(spark, sf_dir, "paired_sp_train").select("line_no", "src", "trg")
    out = materialise(changed(rows, "line_no", ("src", "trg")).select("id", "field", "text"), "changed")
    garbled = mojibake.damaged(spark, rows, "line_no", ("src", "trg"), out)
    return out.select("id", "field").join(garbled, ["id", "field"], "left_anti").select(F.col("id").alias("line_no"), "field")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with both texts in their one form."""
    return one_form(table(spark, sf_dir, "paired_sp_train"), ["line_no"], ["src", "trg"])
