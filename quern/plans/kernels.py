"""Registered queries of single rules, sources and joins, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import features, records, text
from quern.operators import alignment, builders, dedup, evaluation, filters, joins, layout, windows
from quern.plans.queries import PAIRS, W, docs, pairs, query, rounded, table, whole
from quern.sources import tables

# numerals, ids, labels

_ROMAN = "['XII', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI']"
_DECIMAL = "CAST(p_size AS VARCHAR(9)) || CASE p_partkey % 4 WHEN 0 THEN '.25' WHEN 1 THEN '.3333' WHEN 2 THEN '.5' ELSE '.777' END"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 13 < 12 THEN CASE p_partkey % 12 WHEN 0 THEN 12 ELSE p_partkey % 12 END END AS number,
  'in Month ' || CASE WHEN p_partkey % 12 = 0 THEN '12' ELSE CAST(p_partkey % 12 AS VARCHAR) END || ' of x' AS month,
  CAST(p_size AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN ' ¼' WHEN 1 THEN ' ⅓' WHEN 2 THEN ' ½' ELSE '.777' END AS weight FROM part""")
def numerals(spark, sf_dir):
    signs = F.array(*[F.lit(x.strip("' ")) for x in _ROMAN.strip("[]").split(",")])
    d = table(spark, sf_dir, "part").select("p_partkey", F.get(signs, (F.col("p_partkey") % 12).cast("int")).alias("r"), F.expr(_DECIMAL.replace("VARCHAR(9)", "STRING")).alias("w"))
    numeral = F.when(F.col("p_partkey") % 13 < 12, F.lower("r")).otherwise("IIII")
    return d.select("p_partkey", text.roman(numeral).cast("long").alias("number"), records.roman_months(F.concat(F.lit("in Month "), "r", F.lit(" of x"))).alias("month"), records.snapped_decimals("w").alias("weight"))


_OWN = "CASE WHEN doc_id % 2 = 0 THEN '0123abcd-' ELSE 'z-' END || CAST(doc_id AS VARCHAR(19))"
_LINE = "CASE doc_id % 4 WHEN 0 THEN '12. ' WHEN 1 THEN '3''. ' WHEN 2 THEN '4.a1. ' ELSE 'a. ' END || left(text, 20)"
_PERIOD = "CASE doc_id % 5 WHEN 0 THEN 'Old Assyrian (ca. 1950 BC)' WHEN 1 THEN 'Ur III' WHEN 2 THEN 'OLD BABYLONIAN' WHEN 3 THEN 'Achaemenid' END"
_ORIGIN = "CASE doc_id % 5 WHEN 0 THEN ' OCR ' WHEN 1 THEN 'synthetic' WHEN 2 THEN 'official' WHEN 3 THEN 'silver' ELSE source END"


@query(rf"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'z-' || CAST(doc_id AS VARCHAR) END AS base, trim(regexp_replace({_LINE}, '^[0-9]+[\p{{L}}0-9.'']*[.'']\s*', '')) AS body,
  CASE doc_id % 5 WHEN 0 THEN 'OA' WHEN 1 THEN 'UrIII' WHEN 2 THEN 'OB' WHEN 3 THEN 'NB' ELSE 'other' END AS variety, regexp_replace(regexp_replace(lower(source || ' É_x! '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN doc_id % 5 IN (0, 1, 3) THEN 'ocr' ELSE 'official' END AS origin, left(text, 12) || CASE WHEN length(text) > 12 THEN '...' ELSE '' END AS preview, CASE WHEN doc_id % 3 = 0 THEN left(text, 9) ELSE 'OAOX ' || left(text, 9) END AS bare FROM documents WHERE text IS NOT NULL""")
def label_kernels(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text", "source").where("text IS NOT NULL")
    return d.select(
        "doc_id", records.base_id(F.expr(_OWN)).alias("base"), records.line_body(F.expr(_LINE)).alias("body"), records.variety(F.expr(_PERIOD)).alias("variety"), text.slug(F.concat("source", F.lit(" É_x! "))).alias("slug"),
        features.source_label(F.expr(_ORIGIN)).alias("origin"), text.preview(F.col("text"), 12).alias("preview"), features.strip_prefix(F.concat(F.when(F.col("doc_id") % 3 == 0, "OBND ").otherwise("OAOX "), F.left("text", F.lit(9)))).alias("bare"),
    )


_GENRE = "CASE doc_id % 4 WHEN 0 THEN 'Lexical list' WHEN 1 THEN 'Letter' WHEN 2 THEN 'SCHOOL text' END"


@query(rf"""SELECT doc_id, doc_id % 4 IN (1, 3) AS genre_ok, doc_id % 4 = 1 AS genre_known_ok, doc_id % 3 = 0 AS boilerplate, CASE trim(left(text, 3)) WHEN '' THEN 'b' WHEN 'b' THEN 'b' ELSE trim(left(text, 3)) || '|b' END AS candidates,
  doc_id % 2 = 0 AND trim(left(text, 3)) <> '' AS judgeable FROM documents WHERE text IS NOT NULL""")
def row_predicates(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text").where("text IS NOT NULL").withColumn("genre", F.expr(_GENRE)).withColumn("c", F.array(F.left("text", F.lit(3)), F.lit(" b "), F.lit(""), F.left("text", F.lit(3))))
    said = F.when(F.col("doc_id") % 3 == 0, " Basket of Tablets").otherwise("text")
    two = F.array(F.left("text", F.lit(3)), F.when(F.col("doc_id") % 2 == 0, "b"), F.lit(" "))
    return d.select("doc_id", filters.blocked_genre(F.col("genre"), ["lexical", "school"]).alias("genre_ok"), filters.blocked_genre(F.col("genre"), ["lexical", "school"], False).alias("genre_known_ok"), records.boilerplate(said).alias("boilerplate"), F.array_join(dedup.distinct_trimmed(F.col("c")), "|").alias("candidates"), filters.judgeable(F.lit("r"), two).alias("judgeable"))


_BARE = r"(length(regexp_replace(source_text, '\s', '', 'g')) / greatest(length(regexp_replace(target_text, '\s', '', 'g')), 1))"


@query(PAIRS + rf""" SELECT row_id, length(target_text) >= 20 AND length(source_text) >= 10 AND length(target_text) / greatest(length(source_text), 1) BETWEEN 0.1 AND 8 AS parallel, trim(source_text) <> '' AND trim(target_text) <> '' AS both,
  CASE WHEN turn % 3 = 1 THEN 'skip' WHEN len({W('source_text')}) <= 5 THEN 'protected' WHEN {_BARE} > 2.5 THEN 'trim_source' WHEN {_BARE} < 0.4 THEN 'trim_target' ELSE 'keep' END AS action FROM p""")
def pair_predicates(spark, sf_dir):
    s, t = F.col("source_text"), F.col("target_text")
    origin = F.when(F.col("turn") % 3 == 1, " OCR").otherwise("official")
    return pairs(spark, sf_dir).select("row_id", filters.parallel_quality(s, t).alias("parallel"), filters.both_sides(s, t).alias("both"), filters.action(s, t, origin).alias("action"))


@query(PAIRS + r""" SELECT row_id, regexp_replace(source_text, '[\x00-\x7F]|[^\p{L}]', '', 'g') AS marks, CAST(len(regexp_extract_all(source_text || ' 10 ½', '\d+(?:[./]\d+)?[½⅓⅔¼¾⅕⅙⅚⅛⅜⅝⅞]?|[½⅓⅔¼¾⅕⅙⅚⅛⅜⅝⅞]')) AS BIGINT) AS numbers, 3::BIGINT AS gaps FROM p""")
def alignment_kernels(spark, sf_dir):
    s = F.col("source_text")
    return pairs(spark, sf_dir).select("row_id", alignment.mark_signature(s).alias("marks"), F.size(alignment.number_list(F.concat(s, F.lit(" 10 ½")))).cast("long").alias("numbers"), filters.gap_count(F.lit("<gap> <GAP> <gap>")).cast("long").alias("gaps"))


_REF = "CASE turn % 4 WHEN 0 THEN CAST(turn AS VARCHAR(9)) || '-' || CAST(turn + 3 AS VARCHAR(9)) WHEN 1 THEN 'rev. ' || CAST(turn AS VARCHAR(9)) WHEN 2 THEN 'x' ELSE '10''-12''' END"


@query(rf"""WITH r AS (SELECT conv_id, turn, {_REF} AS ref FROM conversations), k AS (SELECT *, coalesce(TRY_CAST(regexp_extract(ref, '(\d+)', 1) AS INT), 1000000) AS lo, coalesce(TRY_CAST(regexp_extract(ref, '\d+\D+(\d+)', 1) AS INT), TRY_CAST(regexp_extract(ref, '(\d+)', 1) AS INT), 1000000) AS hi FROM r)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY lo, hi, ref, turn) - 1 AS place FROM k""")
def line_order(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", records.line_range(F.expr(_REF)).alias("r"))
    d = d.withColumn("k", F.struct("r.first", "r.last", "r.text", "turn"))
    return windows.running_index(d, "conv_id", "k", "place").select("conv_id", "turn", *whole("place"))


@query("""WITH s AS (SELECT event_id, user_id, value, abs(value - lag(value) OVER w) > 2 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)) SELECT event_id, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM s""")
def line_groups(spark, sf_dir):
    return windows.line_groups(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value", "event_id", 2.0).select("event_id", *whole("line"))


@query("""SELECT doc_id, CASE WHEN n_chars % 100 < 52 THEN 'left' ELSE 'right' END AS side FROM documents""")
def page_sides(spark, sf_dir):
    return layout.columns(docs(spark, sf_dir, "doc_id", "n_chars").select("doc_id", (F.col("n_chars") % 100).alias("x0"), F.lit(100).alias("width"))).select("doc_id", "side")


@query("""SELECT conv_id, turn AS page, 1::BIGINT AS line, left(text, 10) AS "left", CASE WHEN turn % 2 = 0 THEN right(text, 10) ELSE '' END AS "right" FROM conversations WHERE text IS NOT NULL""")
def two_runs(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", F.col("turn").alias("page"), F.lit(1).cast("long").alias("line"), F.left("text", F.lit(10)).alias("left"), F.right("text", F.lit(10)).alias("right"))
    return layout.from_two_runs(d, d.where("page % 2 = 0"), "conv_id")


@query(PAIRS + """, d AS (SELECT row_id, [lower(source_text), lower(left(target_text, 10)), lower(source_text)] AS s FROM p) SELECT row_id, round(1 - len(list_distinct(list_transform(s, lambda x: trim(regexp_replace(regexp_replace(x, '[^\\p{L}\\p{N}]+', ' ', 'g'), '\\s+', ' ', 'g'))))) / 3, 6) AS ratio FROM d""")
def duplicate_ratios(spark, sf_dir):
    one = F.struct(F.col("source_text").alias("source"), F.lit("x").alias("target"))
    other = F.struct(F.left("target_text", F.lit(10)).alias("source"), F.lit("X!").alias("target"))
    return pairs(spark, sf_dir).select("row_id", F.round(dedup.duplicate_ratio(F.array(one, other, one)), 6).alias("ratio"))


# joins


@query("""SELECT row_id, genre FROM (SELECT conv_id || '-' || turn AS row_id, conv_id AS c, turn AS t FROM (""" + PAIRS.strip() + """ SELECT * FROM p)) x LEFT JOIN (SELECT doc_id, source AS genre FROM documents WHERE doc_id % 2 = 0) d ON d.doc_id = x.c""")
def attached_columns(spark, sf_dir):
    meta = docs(spark, sf_dir, "doc_id", "source").where("doc_id % 2 = 0").select(F.col("doc_id").alias("conv_id"), F.col("source").alias("genre"))
    return joins.attached(pairs(spark, sf_dir), meta, "conv_id", ["genre"], F.col("genre")).select("row_id", "genre")


@query("SELECT doc_id, source FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, source || '-' || part FROM documents, (SELECT unnest([1, 2]) AS part) WHERE doc_id % 5 = 0 AND doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 10 = 5")
def manual_parts(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "source")
    parts = d.where("doc_id % 10 = 0").withColumn("part", F.explode(F.array(F.lit("1"), F.lit("2")))).select("doc_id", F.concat_ws("-", "source", "part").alias("source"))
    return joins.replaced_by_parts(d, parts, "doc_id")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN n_name ELSE p_type END AS gloss FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 30 WHERE p_size % 3 <> 0 OR n_name IS NOT NULL".replace("CASE WHEN p_size % 3 = 0 THEN n_name ELSE p_type END", "coalesce(n_name, CASE WHEN p_size % 3 <> 0 THEN p_type END)"))
def two_hop_glosses(spark, sf_dir):
    forms = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 30).alias("word"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("guide"))
    entries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entry"), F.col("n_name").alias("definition"))
    return joins.two_hop(forms, entries.withColumnRenamed("entry", "word"), "p_partkey", "word", "definition", "guide")


@query(PAIRS + r""", f AS (SELECT row_id, conv_id, source_text, target_text, trim(regexp_replace(regexp_replace(lower(source_text), '[^\p{L}\p{N}]+', ' ', 'g'), '\s+', ' ', 'g')) || chr(1) || trim(regexp_replace(regexp_replace(lower(target_text), '[^\p{L}\p{N}]+', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_id) AS i FROM f WHERE k NOT IN (SELECT k FROM f WHERE conv_id % 3 = 0)) SELECT row_id FROM r WHERE i = 1""")
def new_pairs(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return joins.new_pairs(p, p.where("conv_id % 3 = 0"), "source_text", "target_text", "row_id").select("row_id")


@query(rf"""WITH t AS (SELECT doc_id, {W('text')} AS w FROM documents WHERE doc_id % 3 > 0 AND text IS NOT NULL), s AS (SELECT doc_id, unnest([1, 4, 9]) AS start FROM documents), n AS (SELECT s.doc_id, start, w, coalesce(lead(start) OVER (PARTITION BY s.doc_id ORDER BY start), len(w) + 1) AS stop FROM s JOIN t ON t.doc_id = s.doc_id)
SELECT doc_id, CAST(start AS BIGINT) AS start, array_to_string(w[start : least(stop, len(w) + 1) - 1], ' ') AS part FROM n""")
def aligned_slices(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text")
    texts = d.where("doc_id % 3 > 0 AND text IS NOT NULL").select("doc_id", text.words(F.col("text")).alias("w"))
    sentences = d.select("doc_id", F.posexplode(F.array(F.lit(1), F.lit(4), F.lit(9))).alias("i", "start"))
    return joins.aligned_slices(sentences, texts, "doc_id", "i", "start", "w").select("doc_id", *whole("start"), "part")


@query("WITH u AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS w FROM part), k AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS w FROM part WHERE p_partkey % 700 = 0) SELECT w AS word FROM u WHERE w NOT IN (SELECT w FROM k)")
def missing_words(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asked = p.select(records.linked_word(F.concat(F.lit("x?word="), F.split("p_name", " ")[0])).alias("word"))
    known = p.where("p_partkey % 700 = 0").select(records.entry_stem(F.concat(F.split("p_name", " ")[0], F.lit(" IV"))).alias("word"))
    return joins.missing_from(asked.select(F.lower("word").alias("word")).distinct(), known, ["word"])


# names, months, batches, records


@query("SELECT p_partkey, '<e0> is here' AS source, 'seen <e0>' AS target, p_name || ' is here' AS again FROM part")
def masked_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    d = p.select("p_partkey", "p_name", builders.mask_names(F.concat("p_name", F.lit(" is here")), F.concat(F.lit("seen "), F.upper("p_name")), F.create_map("p_name", F.upper("p_name"))).alias("m"))
    return d.select("p_partkey", "m.source", "m.target", F.lower(builders.unmask_names(F.col("m.source"), F.col("m.held"))).alias("again")).withColumn("again", F.regexp_replace("again", "^", ""))


@query("SELECT doc_id, t || CASE doc_id % 3 WHEN 0 THEN ' ## MONTH: ke-na-tim=month 3' WHEN 1 THEN ' ## MONTH: hu-bu-ur=month 6' ELSE '' END AS text FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ITU Ke-na-tim ' WHEN 1 THEN 'hu-bu-ur ' ELSE '' END || left(source, 9) AS t FROM documents)")
def month_hints(spark, sf_dir):
    t = F.expr("CASE doc_id % 3 WHEN 0 THEN 'ITU Ke-na-tim ' WHEN 1 THEN 'hu-bu-ur ' ELSE '' END || left(source, 9)")
    return docs(spark, sf_dir, "doc_id", "source").select("doc_id", builders.month_hints(t).alias("text"))


@query("""WITH g AS (SELECT doc_id // 16 AS b, count(*) AS n, sum(n_chars + n_chars % 100) AS used, max(n_chars) + max(n_chars % 100) AS widest FROM documents GROUP BY 1) SELECT count(*) AS batches, round(avg(n), 6) AS mean_rows, round(avg(used / greatest(n * widest, 1)), 6) AS fill FROM g""")
def batch_fill(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "n_chars").selectExpr("doc_id div 16 AS b", "n_chars AS s", "n_chars % 100 AS t")
    return evaluation.batch_fill(d, "b", "s", "t").select(*whole("batches"), *rounded("mean_rows", "fill"))


@query("""SELECT page_id, '2' || (1000 + page_id % 7) || ',200123' AS ids FROM pages""".replace("'2' || (1000 + page_id % 7) || ',200123'", "CAST(1001 + page_id % 7 AS VARCHAR) || ',200123'"))
def artifact_links(spark, sf_dir):
    html = F.concat(F.lit("<a href='/artifacts/"), (F.col("page_id") % 7 + 1001).cast("string"), F.lit("'>P200123</a> /artifacts/12 /artifacts/200123"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(records.artifact_ids(html), ",").alias("ids"))


_JSON = """'{"id":"' || CAST(doc_id AS VARCHAR(19)) || '","genres":[{"genre":{"genre":"' || source || '"}},{"genre":{"genre":"b"}}],"languages":[{"language":{"language":"' || lang || '"}}],"period":{"period":"Ur III"}}'"""


@query(f"SELECT doc_id, json_extract_string(j, '$.id') AS id, array_to_string(CAST(json_extract_string(j, '$.genres[*].genre.genre') AS VARCHAR[]), '; ') AS genres, array_to_string(CAST(json_extract_string(j, '$.languages[*].language.language') AS VARCHAR[]), '; ') AS languages, json_extract_string(j, '$.period.period') AS period FROM (SELECT doc_id, {_JSON} AS j FROM documents WHERE lang IS NOT NULL)")
def artifact_records(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "source", "lang").where("lang IS NOT NULL").select("doc_id", records.artifact(F.expr(_JSON.replace("VARCHAR(19)", "STRING"))).alias("x"))
    return d.select("doc_id", "x.id", "x.genres", "x.languages", "x.period")


@query(PAIRS + " SELECT row_id, unnest([0, 1])::BIGINT AS place, unnest([left(source_text, 9), left(target_text, 9)]) AS sentence FROM p")
def sentence_rows(spark, sf_dir):
    d = pairs(spark, sf_dir).select("row_id", F.array(F.left("source_text", F.lit(9)), F.left("target_text", F.lit(9))).alias("s"))
    return d.select("row_id", F.posexplode("s").alias("place", "sentence")).select("row_id", *whole("place"), "sentence")


# sources: what is written is read again


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents")
def csv_round_trip(spark, sf_dir):
    """Texts with line feeds, quotes and commas through a CSV sink and scan, columns picked and required."""
    path = tables.scratch(spark)
    tables.write_csv(docs(spark, sf_dir, "doc_id", "text", "source"), path)
    return tables.csv_strings(spark, path, ["doc_id", "text"], needed=["doc_id", "text", "source"])


@query("SELECT doc_id, text, [lang, source] AS tags FROM documents".replace("[lang, source] AS tags", "coalesce(lang, '-') || '|' || source AS tags"))
def json_round_trip(spark, sf_dir):
    path = tables.scratch(spark)
    tables.write_json_lines(docs(spark, sf_dir, "doc_id", "text", "lang", "source").withColumn("tags", F.array(F.coalesce("lang", F.lit("-")), "source")), path)
    return tables.json_lines(spark, path, "doc_id long, text string, tags array<string>").select("doc_id", "text", F.array_join("tags", "|").alias("tags"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def split_round_trip(spark, sf_dir):
    """One folder a language; a reader of one reads no other."""
    path = tables.scratch(spark)
    tables.write_split(docs(spark, sf_dir, "doc_id", "lang", "source"), path, "lang")
    return spark.read.parquet(path).where("lang = 'en'").select("doc_id", F.col("lang").cast("string").alias("lang"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 < 3 THEN '1' ELSE '1,3' END WHEN doc_id % 3 = 1 THEN '2' END AS selected FROM documents WHERE doc_id % 5 > 0 AND (doc_id % 3 <> 1 OR doc_id % 5 >= 2)")
def page_selection(spark, sf_dir):
    found = docs(spark, sf_dir, "doc_id").where("doc_id % 5 > 0 AND (doc_id % 3 <> 1 OR doc_id % 5 >= 2)")
    found = found.selectExpr("doc_id", "CASE doc_id % 3 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.pdf' ELSE 'c.pdf' END AS name", "CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS stem", "'x/y.pdf' AS path", "doc_id % 5 AS pages")
    return tables.selected_pages(found, tables.page_rules(["a.pdf:1,3", "b:2"])).select("doc_id", F.array_join("selected", ",").alias("selected"))


@query(PAIRS + """ SELECT 'P' || lpad(CAST(row_number() OVER (ORDER BY row_id) AS VARCHAR), 6, '0') AS id, 'akk' AS language, trim(regexp_replace(left(source_text, 20), '\\s+', ' ', 'g')) || ' second' AS source_text, trim(regexp_replace(left(target_text, 20), '\\s+', ' ', 'g')) AS target_text FROM p""")
def record_files(spark, sf_dir):
    """Records of a line-oriented file: headers, a language, numbered lines, translations and comments."""
    from pyspark.sql import Window

    p = pairs(spark, sf_dir).select(F.row_number().over(Window.orderBy("row_id")).alias("n"), text.squeeze(F.left("source_text", F.lit(20))).alias("s"), text.squeeze(F.left("target_text", F.lit(20))).alias("t"))
    lines = F.array(F.concat(F.lit("&P"), F.lpad(F.col("n").cast("string"), 6, "0"), F.lit(" = x")), F.lit("#atf: lang akk"), F.lit("@tablet"), F.concat(F.lit("1. "), "s"), F.lit("$ blank"), F.lit("2'. second"), F.concat(F.lit("#tr.en: "), "t"))
    d = p.select(F.lit("f").alias("file"), "n", F.posexplode(lines).alias("i", "value")).select("file", (F.col("n") * 10 + F.col("i")).alias("line_no"), "value")
    return tables.atf_records(d).select("id", "language", "source_text", "target_text")
