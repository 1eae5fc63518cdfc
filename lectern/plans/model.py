"""The analytics tables, built from the given ones, with the SQL that says the same.

Notes are documents; what was read from their images are the turns of the
conversation with the note's number; the image inventory is made of pages;
prices of line items; coders and machine of labels.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coding, derived, populations, reliability, resolve
from ..operators.codebook import Code, load
from ..sources.shared import cut

ROOT = ["Root"]
DATES = [r"(\d{4})\s*-\s*(\d{2})\s*-\s*(\d{2})", r"(\d{4})(\d{2})(\d{2})"]
#: family, code, label, objective, patterns with the SQL that counts each in lower-case text t.
_found = lambda p: f"len(regexp_extract_all(t, '{p}'))"
_word = lambda w: f"len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'), lambda x: x = '{w}'))"
CODEBOOK = [
    ("typology", "T1_licence", "Licence line", "rights", [(r"\blicen[sc]ed?\b", _found(r"\blicen[sc]ed?\b"))]),
    ("typology", "T2_mail", "Mail address", "personal", [(r"[a-z0-9.]+@[a-z0-9.]+", _found(r"[a-z0-9.]+@[a-z0-9.]+"))]),
    ("typology", "T3_host", "Network address", "personal", [(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", _found(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"))]),
    ("typology", "T4_secret", "Secret", "security", [(r"password=[0-9a-f]+", _found("password=[0-9a-f]+")), (r"akia[a-z0-9]{16}", _found("akia[a-z0-9]{16}"))]),
    ("typology", "T5_near", "The before of", "language", [(r"\bthe\b.{0,40}\bof\b", _found(r"(?s)\bthe\b.{0,40}\bof\b"))]),
    ("typology", "T6_german", "German words", "language", [(r"\bund\b", _word("und")), (r"\bder\b", _word("der"))]),
    ("typology", "T7_spanish", "Spanish words", "language", [(r"\bque\b", _word("que")), (r"\blos\b", _word("los"))]),
    ("typology", "T8_never", "Never there", "language", [("zzqqzz", _found("zzqqzz"))]),
    ("typology", "T9_quality", "Broken text", "data_quality", [("[#]{3}", _found("[#]{3}")), ("[&]{3}", _found("[&]{3}"))]),
    ("indicator", "I1_contact", "Contact", "personal", [("@[a-z0-9]+", _found("@[a-z0-9]+"))]),
    ("indicator", "I2_legal", "Legal words", "rights", [(r"\bcopyright\b", _word("copyright")), (r"\blicensed\b", _word("licensed"))]),
    ("indicator", "I3_common", "Common words", "language", [(r"\bthe\b", _word("the")), (r"\bde\b", _word("de"))]),
]
QUALITY = ["T9_quality"]
LINKED = [("T2_mail", "I1_contact"), ("T1_licence", "I2_legal")]
GROUPS = [("T2_mail", "person"), ("T3_host", "person"), ("T4_secret", "person"), ("T6_german", "language"), ("T7_spanish", "language")]
KEYWORDS = {"licence": r"licen[sc]e", "address": r"[a-z0-9.]+@[a-z0-9.]+"}
TERMS = {"article": ["the", "der", "la"], "phrase": ["apache license"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def codebook(spark: SparkSession) -> DataFrame:
    rows = [(f, c, lab, o, i, p) for f, c, lab, o, ps in CODEBOOK for i, (p, _) in enumerate(ps)]
    return spark.createDataFrame(rows, "family string, code string, label string, objective string, pattern_idx int, pattern string")


def codes(spark: SparkSession, family: str) -> list[Code]:
    return load(codebook(spark), family)


def raw_notes(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, raw_path, text: a third of the names without a date, the others with one of two kinds."""
    mm, dd = F.lpad((1 + F.col("doc_id") % 12).cast("string"), 2, "0"), F.lpad((1 + F.col("doc_id") % 28).cast("string"), 2, "0")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("note "), "doc_id")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("log2024"), mm, dd, F.lit("-"), "doc_id")).otherwise(F.concat(F.lit("2024 - "), mm, F.lit(" - "), dd, F.lit(" n"), "doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Root/"), "source", F.lit("/"), name, F.lit(".md")).alias("raw_path"), "text")


RAW_SQL = """raw_notes AS (
  SELECT doc_id, 'Root/' || source || '/' || CASE doc_id % 3 WHEN 0 THEN 'note ' || doc_id
    WHEN 1 THEN 'log2024' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || '-' || doc_id
    ELSE '2024 - ' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || ' - ' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || ' n' || doc_id END || '.md' AS raw_path, text
  FROM documents)"""


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """note_id, legacy_note_id, doc_id, relative_path, source, collection_date, text, word_count, char_count."""
    rows = raw_notes(spark, sf)
    path = F.col("raw_path")
    return rows.select(
        T.record_id(path, ascii_only=True).alias("note_id"), T.short_id(F.concat(F.lit("old/"), path)).alias("legacy_note_id"), "doc_id", T.posix_path(path, ascii_only=True).alias("relative_path"),
        T.source_in(path, ROOT).alias("source"), T.date_in(F.element_at(F.split(path, "/"), -1), DATES).alias("collection_date"), "text", T.words(F.col("text")).alias("word_count"), T.chars(F.col("text")).alias("char_count"),
    ).where("source <> ''")


NOTES_SQL = RAW_SQL + """, notes AS (
  SELECT substr(sha256(raw_path), 1, 16) AS note_id, substr(sha256('old/' || raw_path), 1, 16) AS legacy_note_id, doc_id, raw_path AS relative_path, split_part(raw_path, '/', 2) AS source,
    CASE doc_id % 3 WHEN 0 THEN '' ELSE '2024-' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') END AS collection_date,
    text, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS word_count, length(text) AS char_count
  FROM raw_notes)"""


def joined_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised references of notes: the turns of the conversation that has the note's number."""
    talk = table(spark, sf, "conversations")
    ok = F.col("role") != "system"
    text = F.when(ok, F.col("c.text")).otherwise(F.lit(""))
    rows = notes(spark, sf).select("note_id", "source", "doc_id").join(talk.alias("c"), F.col("doc_id") == F.col("c.conv_id"))
    return rows.select(
        "note_id", "source", (F.col("turn") + 1).cast("int").alias("ref_index"), F.concat(F.lit("img/"), F.substring(F.sha2("c.text", 256), 1, 12), F.lit(".png")).alias("path"), F.sha2("c.text", 256).alias("sha256"),
        F.when(ok, "ok").otherwise("empty").alias("ocr_status"), T.words(text).alias("ocr_word_count"), T.chars(text).alias("ocr_char_count"), text.alias("ocr_text"),
    )


REFS_SQL = NOTES_SQL + """, joined_refs AS (
  SELECT note_id, source, CAST(turn + 1 AS INTEGER) AS ref_index, 'img/' || substr(sha256(c.text), 1, 12) || '.png' AS path, sha256(c.text) AS sha256, CASE WHEN role <> 'system' THEN 'ok' ELSE 'empty' END AS ocr_status,
    CASE WHEN role <> 'system' THEN len(regexp_extract_all(c.text, '[\\p{L}\\p{N}_]+')) ELSE 0 END AS ocr_word_count, CASE WHEN role <> 'system' THEN length(c.text) ELSE 0 END AS ocr_char_count, CASE WHEN role <> 'system' THEN c.text ELSE '' END AS ocr_text
  FROM notes JOIN conversations c ON doc_id = conv_id)"""


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Notes with the text of note and images together, its hash and words, and which of the two there is."""
    own = notes(spark, sf)
    ocr = resolve.text_of_notes(joined_refs(spark, sf)).select("note_id", "ocr_text")
    rows = resolve.note_text(own, ocr)
    both = T.normalized(T.combined(F.col("text"), F.col("ocr_text")))
    md, oc = T.filled(F.col("text")).cast("int"), T.filled(F.col("ocr_text")).cast("int")
    rows = rows.select("note_id", "source", "collection_date", both.alias("text"), md.alias("markdown_present"), oc.alias("ocr_present"), (md + oc).alias("text_source_count"))
    return rows.withColumns({"combined_word_count": T.words(F.col("text")), "combined_text_sha256": T.fingerprint(F.col("text"))})


CORPUS_SQL = REFS_SQL + """, firsts AS (
  SELECT note_id, sha256, min(ref_index) AS i, min_by(ocr_text, ref_index) AS x FROM joined_refs WHERE ocr_status = 'ok' GROUP BY ALL
), note_ocr AS (SELECT note_id, string_agg(x, chr(10) || chr(10) ORDER BY i) AS ocr_text FROM firsts WHERE trim(x) <> '' GROUP BY note_id
), corpus AS MATERIALIZED (
  SELECT *, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS combined_word_count, sha256(text) AS combined_text_sha256 FROM (
    SELECT note_id, source, collection_date,
      regexp_replace(regexp_replace(concat_ws(chr(10) || chr(10), CASE WHEN trim(text) <> '' THEN text END, CASE WHEN trim(ocr_text) <> '' THEN ocr_text END), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g') AS text,
      CAST(coalesce(trim(text), '') <> '' AS INTEGER) AS markdown_present, CAST(coalesce(trim(ocr_text), '') <> '' AS INTEGER) AS ocr_present,
      CAST(coalesce(trim(text), '') <> '' AS INTEGER) + CAST(coalesce(trim(ocr_text), '') <> '' AS INTEGER) AS text_source_count
    FROM notes LEFT JOIN note_ocr USING (note_id)))"""


def coded(spark: SparkSession, sf: str, family: str = "typology") -> DataFrame:
    return coding.code_notes(corpus(spark, sf), codes(spark, family))


def _coding_sql(family: str, name: str) -> str:
    parts = [
        f"SELECT note_id, source, markdown_present, ocr_present, text_source_count, '{c}' AS code, '{lab}' AS label, '{o}' AS objective, [{', '.join(s for _, s in ps)}] AS hits FROM lowered"
        for f, c, lab, o, ps in CODEBOOK if f == family
    ]
    return f""", {name} AS MATERIALIZED (
  SELECT * EXCLUDE (hits, text_source_count), CAST(hit_count > 0 AS INTEGER) AS present,
    CASE WHEN hit_count >= 5 AND pattern_count >= 2 AND text_source_count >= 1 THEN 'high' WHEN hit_count >= 2 OR pattern_count >= 2 THEN 'medium' WHEN hit_count >= 1 THEN 'low' ELSE 'none' END AS rule_match_intensity
  FROM (SELECT *, CAST(list_sum(hits) AS BIGINT) AS hit_count, len(list_filter(hits, lambda x: x > 0)) AS pattern_count FROM ({' UNION ALL '.join(parts)})))"""


CODED_SQL = CORPUS_SQL + ", lowered AS MATERIALIZED (SELECT *, lower(text) AS t FROM corpus)" + _coding_sql("typology", "coding")
INDICATED_SQL = CODED_SQL + _coding_sql("indicator", "indicating")


class Populations(NamedTuple):
    """What the tables over populations are derived from: narrow, and coded once."""

    notes: DataFrame
    members: DataFrame
    types: DataFrame
    indicators: DataFrame


def over_populations(spark: SparkSession, sf: str) -> Populations:
    """All texts are read and coded in one pass, whose result, without texts, is kept; the rest derives from it."""
    rows = cut(carried(spark, sf))
    own = populations.membership(rows)
    carry = lambda family: rows.select("note_id", F.explode(family).alias("c")).select("note_id", "c.code", "c.label", F.lit(1).alias("present"))
    return Populations(rows, own, *[populations.presence(carry(f), own, QUALITY) for f in ("typology", "indicator")])


def carried(spark: SparkSession, sf: str) -> DataFrame:
    """Notes without texts, with the codes of both families that they carry: one pass over the texts."""
    return coding.carried(corpus(spark, sf), {f: codes(spark, f) for f in ("typology", "indicator")})


def cube(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of notes, codes and pairs of both families: texts are read once, and no row is a note and a code."""
    families = ("typology", "indicator")
    rows = carried(spark, sf)
    kept = lambda f: F.transform(F.filter(f, lambda c: ~c["code"].isin(*QUALITY)), lambda c: F.struct(F.lit(f).alias("family"), c["code"].alias("code"), c["label"].alias("label")))
    rows = cut(rows.select("note_id", "source", "combined_text_sha256", F.concat(*map(kept, families)).alias("carried")))
    return derived.cube(populations.marked(rows))


PRESENCE_SQL = INDICATED_SQL + """, members AS MATERIALIZED (
  SELECT 'full_corpus' AS population, note_id, source FROM corpus
  UNION ALL SELECT 'text_unique', note_id, source FROM (SELECT *, row_number() OVER (PARTITION BY combined_text_sha256 ORDER BY source, note_id) AS r FROM corpus) WHERE r = 1
), sizes AS (SELECT population, count(*) AS denominator_n FROM members GROUP BY population
), presence AS MATERIALIZED (SELECT population, code, label, note_id, m.source FROM coding c JOIN members m USING (note_id) WHERE present = 1 AND code <> 'T9_quality'
), ipresence AS MATERIALIZED (SELECT population, code, label, note_id, m.source FROM indicating c JOIN members m USING (note_id) WHERE present = 1
), codes AS (SELECT DISTINCT code FROM presence), labels_of AS (SELECT code, min(label) AS label FROM presence GROUP BY code)
, pairs AS (SELECT a.code AS code_a, b.code AS code_b FROM codes a JOIN codes b ON a.code < b.code), sources AS (SELECT DISTINCT source FROM members)"""


def priced(spark: SparkSession, sf: str) -> DataFrame:
    """Line items told as notes with two prices each."""
    rows = table(spark, sf, "lineitem")
    text = F.concat(F.lit("paid USD $"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit(" or "), F.col("l_quantity").cast("decimal(9,2)").cast("string"), F.lit(" bitcoin"))
    return rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("note_id"), F.col("l_returnflag").alias("source"), text.alias("text"))


PRICES_SQL = """mentions AS MATERIALIZED (
  SELECT note_id, source, currency, regexp_replace(CAST(CAST(x AS DECIMAL(18,8)) AS VARCHAR), '\\.?0+$', '') AS amount, raw, 'paid ' || dollars || ' or ' || coins AS context
  FROM (SELECT *, unnest(['USD', 'BTC']) AS currency, unnest([CAST(price AS DECIMAL(12,2)), CAST(quantity AS DECIMAL(12,2))]) AS x, unnest([dollars, coins]) AS raw
    FROM (SELECT concat_ws('-', l_orderkey, l_linenumber) AS note_id, l_returnflag AS source, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_quantity AS DECIMAL(9,2)) AS quantity,
      'USD $' || CAST(l_extendedprice AS DECIMAL(12,2)) AS dollars, CAST(l_quantity AS DECIMAL(9,2)) || ' bitcoin' AS coins FROM lineitem))
  WHERE x > 0 AND x <= 10000000)"""


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """An image a page: some names repeat across folders."""
    rows = table(spark, sf, "pages")
    base = F.concat(F.lit("shot "), (F.col("page_id") % 97).cast("string"), F.lit(".png"))
    path = F.concat_ws("/", F.concat(F.lit("dir"), (F.col("page_id") % 13).cast("string")), base)
    return rows.select(path.alias("path"), F.lower(base).alias("basename"), F.sha2("url", 256).alias("sha256"), "page_id").groupBy("path", "basename").agg(F.min_by("sha256", "page_id").alias("sha256"))


INVENTORY_SQL = """inventory AS (
  SELECT path, basename, min_by(sha256, page_id) AS sha256 FROM (SELECT 'dir' || page_id % 13 || '/shot ' || page_id % 97 || '.png' AS path, 'shot ' || page_id % 97 || '.png' AS basename, sha256(url) AS sha256, page_id FROM pages) GROUP BY ALL)"""


def path_refs(spark: SparkSession, sf: str) -> DataFrame:
    """A reference a page, from a folder, in seven kinds."""
    k, d, b = F.col("page_id") % 7, (F.col("page_id") % 13).cast("string"), (F.col("page_id") % 97).cast("string")
    ref = (
        F.when(k == 0, F.concat(F.lit("<shot%20"), b, F.lit(".png>"))).when(k == 1, F.concat(F.lit("../dir"), d, F.lit("/shot%20"), b, F.lit(".png")))
        .when(k == 2, F.concat(F.lit("dir"), d, F.lit("\\shot "), b, F.lit(".png"))).when(k == 3, F.lit("https://example.org/a.png"))
        .when(k == 4, F.lit("C:/x.png")).when(k == 5, F.lit("../../outside.png")).otherwise(F.concat(F.lit("gone "), b, F.lit(".png")))
    )
    return table(spark, sf, "pages").select(F.col("page_id").alias("ref_id"), F.concat(F.lit("dir"), d).alias("note_dir"), ref.alias("ref"))


def sheets(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Machine key, two coders and an adjudication, from labels."""
    lab = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    k = F.col("doc_id") % 11
    first = F.when(k == 7, "ambiguous").when(k == 8, "insufficient_text").when(k == 9, " Not_Applicable ").when(F.col("quality") == 1, "present").otherwise("Absent")
    second = F.when(k == 3, F.when(F.col("quality") == 1, "absent").otherwise("present")).when(k == 10, "ambiguous").otherwise(first)
    rid = F.concat(F.lit("r"), "doc_id").alias("record_id")
    target = F.concat(F.lit("C"), F.col("doc_id") % 4).alias("code")
    machine = lab.select(rid, F.when(F.col("doc_id") % 4 < 2, "typology").otherwise("indicator").alias("target_type"), target, F.when(F.col("doc_id") % 5 == 0, F.col("toxic")).otherwise(F.col("quality")).cast("string").alias("model_present"), (1 + F.col("doc_id") % 5).cast("string").alias("analysis_weight"))
    c1, c2 = lab.select(rid, first.alias("decision")), lab.select(rid, second.alias("decision"))
    said = lab.select(rid, first.alias("coder_1_decision"), second.alias("coder_2_decision"), F.when(k == 3, F.lit("present")).when(k == 10, F.lit("")).otherwise(first).alias("adjudicated_decision"))
    return {"machine": machine, "coder_1": c1, "coder_2": c2, "adjudication": said}


SHEETS_SQL = """lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), said AS (SELECT *, 'r' || doc_id AS record_id, CASE doc_id % 11 WHEN 7 THEN 'ambiguous' WHEN 8 THEN 'insufficient_text' WHEN 9 THEN 'not_applicable' ELSE CASE quality WHEN 1 THEN 'present' ELSE 'absent' END END AS decision_1 FROM lab
), records AS MATERIALIZED (SELECT *, CASE doc_id % 11 WHEN 3 THEN 'present' WHEN 10 THEN '' ELSE decision_1 END AS final FROM (
  SELECT doc_id, record_id, CASE WHEN doc_id % 4 < 2 THEN 'typology' ELSE 'indicator' END AS target_type, 'C' || doc_id % 4 AS code, (CASE WHEN doc_id % 5 = 0 THEN toxic ELSE quality END) = 1 AS model_present, CAST(1 + doc_id % 5 AS DOUBLE) AS weight, decision_1,
    CASE doc_id % 11 WHEN 3 THEN CASE quality WHEN 1 THEN 'absent' ELSE 'present' END WHEN 10 THEN 'ambiguous' ELSE decision_1 END AS decision_2 FROM said))"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    s = sheets(spark, sf)
    return reliability.records(s["machine"], s["coder_1"], s["coder_2"], s["adjudication"])
