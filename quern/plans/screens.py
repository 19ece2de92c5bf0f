"""Registered queries of the screens, kernels, names, rewards and reports, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import records, roles, text
from quern.operators import aggregates, alignment, augment, chunking, filters, joins, names, rewards, screening, splits, windows
from quern.plans.queries import PAIRS, SQ, W, docs, pairs, query, rounded, table, whole

# The driver's pairs have no editors' remarks, gaps or names: these come in by rules that both engines read alike, as SQL.
MARKED = {
    "source_text": """CASE WHEN turn % 7 = 1 THEN 'a-na A-šùr-ma ma-na x ' || source_text WHEN turn % 7 = 2 THEN left(source_text, 12) WHEN turn % 7 = 3 THEN 'um-ma <gap> ' || left(source_text, 40)
  WHEN turn % 7 = 4 THEN '(1) obv. a-na-ku 12 ma-na' ELSE left(source_text, 150) END""",
    "target_text": """CASE conv_id % 19 WHEN 0 THEN 'Witnesses: the date of ' || left(target_text, 60) WHEN 1 THEN '<gap> the man ' || left(target_text, 30) || ' <gap>' WHEN 2 THEN 'lines 3 - 9 (remainder lost) ' || left(target_text, 90)
  WHEN 3 THEN 'PN2 gave silver to DN ' || left(target_text, 50) WHEN 4 THEN 'To Enlil-bani, from Ashur-idi, Puzur-Sin and Imdi-ilum: 12 minas are owed.' WHEN 5 THEN 'Pourquoi as-tu ' || target_text WHEN 6 THEN 'ainsi parle moi donne. Say to him that ' || target_text
  WHEN 7 THEN 'dans le haus avec silber ' || target_text WHEN 8 THEN '"' || left(target_text, 70) || '(' WHEN 9 THEN replace(target_text, ' de ', ' <gap> ') WHEN 10 THEN replace(target_text, ' of ', ' <gap> ') || ','
  WHEN 11 THEN 'The priest sang a hymn and an omen in the school exercise of the temple' WHEN 12 THEN 'Thus he says ' || left(target_text, 30) WHEN 13 THEN left(target_text, 8) WHEN 14 THEN 'wwork <gap> ' || target_text ELSE target_text END""",
    "align_type": "CASE turn % 3 WHEN 0 THEN 'Sentence' WHEN 1 THEN 'doc_grouped' END",
    "line_ref": "CASE turn % 4 WHEN 0 THEN CAST(turn AS VARCHAR(9)) || ' - ' || CAST(turn AS VARCHAR(9)) WHEN 1 THEN '3-5' WHEN 2 THEN 'x' END",
}
MARKED_SQL = PAIRS + ", k AS (SELECT row_id, conv_id, turn, " + ", ".join(f"{x} AS {c}" for c, x in MARKED.items()) + " FROM p)"


def marked(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_id", "conv_id", "turn", *[F.expr(x).alias(c) for c, x in MARKED.items()])


_EDGE = r"[^\p{L}\p{M}\p{Nd}_]"


def RX(column: str, pattern: str, flags: str = "(?i)") -> str:
    """SQL for: a pattern occurs. Edges of words are spelled out, since the other engine knows those of ASCII alone."""
    bounded = pattern.replace(r"\b|", "|").replace(r"\b", f"(?:^|$|{_EDGE})").replace("'", "''")
    return f"regexp_matches({column}, '{flags}{bounded}')"


_S, _T = "source_text", "target_text"
_NS, _NT = f"greatest(len({W(_S)}), 1)", f"greatest(len({W(_T)}), 1)"


def _n(column: str, mark: str) -> str:
    return f"((length({column}) - length(replace({column}, '{mark}', ''))) // {len(mark)})"


_GS, _GT = _n(_S, "<gap>"), _n(_T, "<gap>")
_DENSITY = f"(({_GS} + {_GT}) / ({_NS} + {_NT}))"


@query(MARKED_SQL + f""" SELECT row_id, {RX(_T, screening.STRONG_META)} OR ({RX(_T, screening.PLACEHOLDER_NAME, '')} AND ({_GT} >= 1 OR {_NT} <= 18)) OR ({RX(_T, screening.EDITORIAL_META)} AND {_DENSITY} >= 0.18)
  OR {_DENSITY} >= 0.38 OR ({_GT} / {_NT} >= 0.22 AND {_NT} <= 24) OR ({RX(_T, screening.UGLY_RECOGNITION)} AND {_GT} >= 1) AS fragmentary FROM k""")
def fragmentary_pairs(spark, sf_dir):
    return marked(spark, sf_dir).select("row_id", screening.fragmentary(F.col(_S), F.col(_T)).alias("fragmentary"))


@query(MARKED_SQL + f" SELECT row_id, {RX(_T, screening.EDITORIAL_JUNK)} AND ({_GT} / {_NT} >= 0.18 OR {_NT} <= 18) AS editorial FROM k")
def residual_editorial(spark, sf_dir):
    return marked(spark, sf_dir).select("row_id", screening.residual_editorial(F.col(_T)).alias("editorial"))


_GROUPED = "coalesce(lower(align_type) = 'doc_grouped', false)"
_SIGNS = {
    "many_gaps": f"{_GT} >= CASE WHEN {_GROUPED} THEN 5 ELSE 3 END", "dense_fragment": f"{_DENSITY} >= 0.15", "dangling_editorial": RX(_T, screening.DANGLING_EDITORIAL),
    "quote_imbalance": f"{_n(_T, chr(34))} % 2 <> 0", "paren_imbalance": f"{_n(_T, '(')} <> {_n(_T, ')')}",
    "long_fragment": f"CASE WHEN {_GROUPED} THEN {_NT} >= 100 AND {_GT} >= 3 ELSE {_NT} >= 60 AND {_GT} >= 1 END", "broken_tail": f"{RX(_T, screening.BROKEN_TAIL)} AND {_GT} >= 1",
}


@query(MARKED_SQL + ", f AS (SELECT " + ", ".join(f"({x}) AS {name}" for name, x in _SIGNS.items()) + " FROM k)\n" + "\nUNION ALL ".join(f"SELECT '{name}' AS reason, count(*) AS n FROM f WHERE {name} HAVING count(*) > 0" for name in _SIGNS))
def fragment_reasons(spark, sf_dir):
    d = marked(spark, sf_dir)
    found = d.select(screening.reasons(**screening.fragment_signs(F.col(_S), F.col(_T), F.col("align_type"))).alias("reasons"))
    return filters.reason_counts(found.select(F.array_join("reasons", ",").alias("reason")))


_SENTENCE = "coalesce(lower(align_type) = 'sentence', false)"


@query(MARKED_SQL + f""" SELECT row_id, {_SENTENCE} AND ({RX(_T, screening.WITNESS_DATE)} OR {RX(_T, screening.BROKEN_NOTE)} OR {RX(_T, screening.META_ONLY)}) AND ({_NT} <= 18 OR contains({_T}, '<gap>')) AS metadata,
  {RX(_S, screening.SCHOLARLY_PLACEHOLDER, '')} OR {RX(_T, screening.SCHOLARLY_PLACEHOLDER, '')} AS placeholder,
  {_SENTENCE} AND coalesce(regexp_extract(line_ref, '{screening.LINE_RANGE}', 1) <> '' AND regexp_extract(line_ref, '{screening.LINE_RANGE}', 1) = regexp_extract(line_ref, '{screening.LINE_RANGE}', 2), false)
    AND (({_NS} <= 1 AND {_NT} >= 7) OR ({_NS} <= 2 AND {_NT} >= 12)) AS single_line FROM k""")
def sentence_screens(spark, sf_dir):
    s, t, kind = F.col(_S), F.col(_T), F.col("align_type")
    return marked(spark, sf_dir).select("row_id", screening.sentence_metadata(t, kind).alias("metadata"), screening.has_placeholder(s, t).alias("placeholder"), screening.single_line_sentence(s, t, kind, F.col("line_ref")).alias("single_line"))


_FR = r"(?:ainsi|parle|pourquoi|arriv[ée]\w*|donn[ée]?\w*|serviteurs?|p[ée]ch[ée]s?|contestes?|venue|toi|moi|libre|champ|fasse|correspondant|choix|ann[ée]e|entrer|porte|temple)"


def FRENCH(c: str) -> str:
    word = rf"len(list_filter(regexp_extract_all({c}, '[\p{{L}}\p{{M}}\p{{Nd}}_]+'), lambda y: regexp_full_match(y, '(?i){_FR}')))"
    return f"({RX(f'trim({c})', screening.FRENCH_START)} OR {word} + {_n(f'lower({c})', 'cris-tu')} >= 4)"


_TAIL = rf"trim(regexp_extract({_T}, '(?s)(?:Say to|Speak to).*'), chr(32) || chr(9) || chr(10) || chr(13) || '-;:,')"


@query(MARKED_SQL + f""", h AS (SELECT *, {_TAIL} AS tail FROM k), st AS (SELECT *, CASE WHEN tail <> '' AND {FRENCH(f'left({_T}, CAST(greatest(strpos({_T}, tail) - 1, 1) AS INT))')} THEN 'recovered' WHEN NOT {FRENCH(_T)} THEN 'kept' ELSE 'drop' END AS state FROM h)
SELECT row_id, state AS french_state, CASE WHEN state = 'recovered' THEN tail ELSE {_T} END AS target_text FROM st WHERE row_id NOT IN (SELECT row_id FROM st WHERE state = 'drop')""")
def french_repair(spark, sf_dir):
    return screening.repaired_or_dropped(marked(spark, sf_dir), "row_id", _T).select("row_id", "french_state", "target_text")


_FOREIGN_WORDS = r"(?:Sekel|Silber|Gerste|Sohn|Gattin|Haus|Jahr|Monat|Schmied|bezahlt|Zeuge|Zeugen|T[ée]moins?|Temoins?|Année|reçu|dans|avec|pour)"


@query(MARKED_SQL + rf""" SELECT row_id, len(list_filter(regexp_extract_all({_T}, '[\p{{L}}\p{{M}}\p{{Nd}}_]+'), lambda y: regexp_full_match(y, '(?i){_FOREIGN_WORDS}')))
  + len(regexp_extract_all(regexp_replace({_T}, '{_EDGE}', '  ', 'g'), '(?i)(?:^| )(?:fils  de|fille  de|le  roi|la  ville)(?: |$)')) >= 2 AS "foreign",
  (turn % 2 = 0) AND ((length({_T}) < 60 AND {_GT} >= 1) OR len(list_filter({W(_T)}, lambda y: length(y) <= 3 AND ends_with(y, '.'))) / {_NT} > 0.3) AS damaged FROM k""")
def foreign_and_damaged(spark, sf_dir):
    variety = F.when(F.col("turn") % 2 == 0, "OA").otherwise("OB")
    return marked(spark, sf_dir).select("row_id", screening.foreign(F.col(_T)).alias("foreign"), screening.high_damage(F.col(_T), variety).alias("damaged"))


_LOWER = rf"list_transform(regexp_extract_all({_T}, '[A-Za-z]+'), lambda y: lower(y))"


def _among(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_CLEAN = SQ(_T)


@query(MARKED_SQL + rf""", w AS (SELECT row_id, {_CLEAN} AS t, list_transform(regexp_extract_all({_CLEAN}, '[A-Za-z]+'), lambda y: lower(y)) AS w FROM k)
SELECT row_id, t <> '' AND NOT {RX('t', screening.COMMENTARY)} AND NOT regexp_matches(t, '(?:^|{_EDGE})\d{{4}}(?:$|{_EDGE})|[A-Za-z][/\\][A-Za-z]') AND len(w) >= 3 AND (w[1] = 'witnessed' OR len(list_filter(w, lambda y: y IN {_among(screening.SIGNAL_WORDS)})) >= 1
  OR (regexp_matches(t, '^[0-9"'']') AND len(w) >= 6) OR (len(w) >= 5 AND len(list_filter(w, lambda y: y IN {_among(screening.TRADE_WORDS)})) >= 1) OR starts_with(t, 'Thus ') OR starts_with(t, 'Say to ') OR (regexp_matches(t, '[āēīūṣṭ]') AND len(w) >= 4)) AS reads FROM w""")
def reads_like_target(spark, sf_dir):
    return marked(spark, sf_dir).select("row_id", screening.reads_like_target(F.col(_T)).alias("reads"))


@query()
def candidate_reasons(spark, sf_dir):
    return marked(spark, sf_dir).select("row_id", screening.candidate_reason(F.col(_S), F.col(_T)).alias("reason"))


@query(MARKED_SQL + rf""", w AS (SELECT *, {W(_T)} AS w FROM k) SELECT row_id,
  length({_T}) >= 20 AND NOT contains(lower({_T}), '<gap>') AND trim({_T}) <> '' AND length(trim({_S})) > 5 AND (len(w) <= 3 OR len(list_distinct(w)) / len(w) >= 0.3) AS example,
  {_S} <> '' AND {_T} <> '' AND NOT contains({_S}, '<gap>') AND NOT contains({_T}, '<gap>') AND turn % 3 <> 1 AS translation,
  len({W(_S)}) BETWEEN 2 AND 24 AND length({_S}) <= 160 AND {_S} <> '' AND {_T} <> '' AND NOT contains({_S}, '<gap>') AND NOT contains({_T}, '<gap>') AS segmentation FROM w""")
def example_pools(spark, sf_dir):
    s, t = F.col(_S), F.col(_T)
    unsure = F.when(F.col("turn") % 3 == 1, "unsure")
    return marked(spark, sf_dir).select("row_id", screening.clean_example(s, t).alias("example"), screening.translation_pool(s, t, unsure).alias("translation"), screening.segmentation_pool(s, t).alias("segmentation"))


@query(f"""WITH s AS (SELECT d.doc_id, text, source, lang, quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)
SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN quality * 2 - 3.0 ELSE quality * 60.0 END >= CASE WHEN lang = 'en' THEN -1.5 ELSE 55.0 END AND length(left(text, 90)) / (length(left(text, 80)) + 1e-9) BETWEEN 0.6 AND 2.0, false) AS confident FROM s""")
def confident_answers(spark, sf_dir):
    d = joins.first_by(table(spark, sf_dir, "labels"), ["doc_id"], [F.col("quality").desc()]).select(F.col("doc_id").alias("i"), "quality")
    d = docs(spark, sf_dir, "doc_id", "text", "lang").join(d, F.col("doc_id") == F.col("i"), "left")
    beam = F.col("lang") == "en"
    score = F.when(beam, F.col("quality") * 2 - 3.0).otherwise(F.col("quality") * 60.0)
    found = screening.confident_answer(score, F.left("text", F.lit(80)), F.left("text", F.lit(90)), F.when(beam, "beam").otherwise("choice"))
    return d.select("doc_id", F.coalesce(found, F.lit(False)).alias("confident"))


_BLOB = "string_agg(trim(target_text), ' ' ORDER BY turn)"


@query(MARKED_SQL + f""", b AS (SELECT conv_id, {_BLOB} AS t FROM k WHERE trim(target_text) <> '' GROUP BY conv_id), r AS (SELECT conv_id, concat_ws(',', """ + ", ".join(f"CASE WHEN {RX('t', p)} THEN '{name}' END" for name, p in screening.DOMAINS.items()) + """) AS reasons FROM b)
SELECT row_id, nullif(reasons, '') AS drop_reason FROM k LEFT JOIN r ON r.conv_id = k.conv_id""")
def document_reasons(spark, sf_dir):
    d = marked(spark, sf_dir)
    return screening.with_document_reasons(d, "conv_id", screening.document_reasons(d, "conv_id", ["turn"], [_T])).select("row_id", "drop_reason")


_FILE = "CASE doc_id % 6 WHEN 0 THEN 'm/optimizer.pt' WHEN 1 THEN 'm/rng_state_' || CAST(doc_id AS VARCHAR(19)) || '.pth' WHEN 2 THEN 'rng_state.pt' WHEN 3 THEN 'm/model.bin' WHEN 4 THEN 'trainer_state.json' ELSE 'x/rng_state_a.pt' END"


@query(f"SELECT doc_id, regexp_extract(f, '[^/]*$') IN {_among(screening.RESUME_FILES)} OR regexp_full_match(regexp_extract(f, '[^/]*$'), 'rng_state(_[0-9]+)?\\.(pth|pt)') AS excluded FROM (SELECT doc_id, {_FILE} AS f FROM documents)")
def upload_exclusions(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id").select("doc_id", screening.upload_excluded(F.expr(_FILE)).alias("excluded"))


# kernels of records


@query(MARKED_SQL + rf""" SELECT row_id, coalesce(lower(regexp_extract_all({_T}, '[A-Za-zÀ-ÿḫḪšŠṣṢṭṬ]+')[1]), '') AS first_word, coalesce(lower(regexp_extract_all({_T}, '[A-Za-zÀ-ÿḫḪšŠṣṢṭṬ]+')[-1]), '') AS last_word,
  regexp_matches(replace(trim(regexp_replace({_T}, '\s+', ' ', 'g')), chr(173), ''), '(?:[.!?;:]|<gap>)(?:["'')\]]+)?$') AS ends, CAST(length(regexp_replace({_T}, '\s+', '', 'g')) AS BIGINT) AS bare,
  CASE WHEN length({_T}) <= 40 THEN {_T} ELSE left({_T}, 40) || '...[truncated ' || (length({_T}) - 40) || ' chars]' END AS cut,
  regexp_replace({_T}, '(<gap>)(?:\s+<gap>)+', '\1', 'g') AS gaps, trim(left(trim(regexp_replace({_T}, '\s+', ' ', 'g')), 30)) AS page FROM k""")
def text_kernels(spark, sf_dir):
    t = F.col(_T)
    return marked(spark, sf_dir).select(
        "row_id", records.first_word(t).alias("first_word"), records.last_word(t).alias("last_word"), records.ends_sentence(t).alias("ends"), records.bare_length(t).cast("long").alias("bare"),
        records.cut_with_note(t, 40).alias("cut"), records.adjacent_gaps(t).alias("gaps"), F.trim(records.page_text(t, 30)).alias("page"),
    )


_LINE = "CASE turn % 5 WHEN 0 THEN '12* 3 obv. a-hu-u[r] ' || source_text WHEN 1 THEN '4 ' || source_text || ' rev. x' WHEN 2 THEN '.; a–b … *ma <<x>> ' || source_text WHEN 3 THEN '7 8 ' || source_text ELSE source_text END"


@query(PAIRS + rf""", l AS (SELECT row_id, {_LINE} AS t FROM p) SELECT row_id, regexp_replace(t, '\[([^\]]*)\]', '\1', 'g') AS joined,
  replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)^(?:(?:\d+\*?\s+)+)?(?:obv\.?|rev\.?)\s*', ''), '^(?:\d+\*?\s+)+', ''), '^[.,;:-]+\s*', ''), '\s+', ' ', 'g')), chr(173), '') AS bare,
  trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(t, chr(173), ''), '[–—]', '-', 'g'), '…', ' ... '), '\*([A-Za-zÀ-ÿ])', '\1', 'g'), '\s+', ' ', 'g')) AS target_side,
  trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(t, chr(173), ''), '[–—]', '-', 'g'), '…', ' ... '), '\*([A-Za-zÀ-ÿ])', '\1', 'g'), '<<|>>', '', 'g'), '\s+', ' ', 'g')) AS source_side FROM l""")
def line_kernels(spark, sf_dir):
    d = pairs(spark, sf_dir).select("row_id", F.expr(_LINE).alias("t"))
    t = F.col("t")
    return d.select("row_id", records.joined_brackets(t).alias("joined"), records.without_left_prefix(t).alias("bare"), records.visual_noise(t, True).alias("target_side"), records.visual_noise(t, False).alias("source_side"))


_ECHO = "CASE doc_id % 4 WHEN 0 THEN 'Examples: a\nb to English: ' || left(text, 50) WHEN 1 THEN left(text, 50) || ' ## HINTS: a=b' WHEN 2 THEN 'OA to English: ' || left(text, 50) || ' ## MONTH: x' ELSE left(text, 50) END"


@query(rf"""WITH e AS (SELECT doc_id, string_split(string_split({_ECHO}, '## HINTS:')[1], '## MONTH:')[1] AS t FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, CASE WHEN starts_with(t, 'Examples:') THEN string_split(trim(t, ' ' || chr(9) || chr(10) || chr(13)), chr(10))[-1] ELSE t END AS t FROM e)
SELECT doc_id, trim(CASE WHEN strpos(t, 'to English:') > 0 THEN substring(t, CAST(strpos(t, 'to English:') + 11 AS INT)) ELSE t END, ' ' || chr(9) || chr(10) || chr(13)) AS answer FROM l""")
def answer_echoes(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").where("text IS NOT NULL").select("doc_id", records.without_echo(F.expr(_ECHO)).alias("answer"))


_PATH = "'archive ' || source || '/Vol.' || CAST(doc_id % 9 AS VARCHAR(9)) || '/é ' || CAST(doc_id AS VARCHAR(19)) || '.PDF'"


@query(rf"""WITH f AS (SELECT doc_id, source, lang, regexp_replace({_PATH}, '\.[^./]+$', '') AS rel FROM documents)
SELECT doc_id, trim(regexp_replace(replace(rel, '/', '__'), '[^0-9A-Za-z._-]+', '_', 'g'), '._') || '__' || left(sha1(rel), 10) AS document, 'task-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS task, lpad(CAST(doc_id AS VARCHAR), 6, '0') AS catalogue,
  coalesce(nullif(trim(CASE WHEN lang = 'de' THEN ' ' ELSE lang END), ''), 'OA') AS variety FROM f WHERE doc_id < 1000000""")
def row_ids(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "source", "lang").where("doc_id < 1000000")
    return d.select("doc_id", records.document_id(F.expr(_PATH)).alias("document"), records.task_id(F.lit("task"), F.col("doc_id")).alias("task"), records.catalogue_key(F.col("doc_id")).alias("catalogue"), records.variety_or(F.when(F.col("lang") == "de", " ").otherwise(F.col("lang"))).alias("variety"))


@query(r"""WITH f AS (SELECT row_id, 'a/b.pdf::page=' || turn || '::pair=' || conv_id || '::' || source_text || '::' || target_text AS name FROM (SELECT * FROM p)),
h AS (SELECT row_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) AS h FROM f)
SELECT row_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', CAST((('0x' || substring(h, 17, 1))::INT & 3) + 1 AS INT), 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS id FROM h""".replace("WITH f AS", PAIRS + ", f AS", 1))
def pair_ids(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_id", records.pair_id(F.lit("a/b.pdf"), F.col("turn"), F.col("conv_id"), F.col("source_text"), F.col("target_text")).alias("id"))


_URL = "CASE p_partkey % 3 WHEN 0 THEN 'https://x.org/d?word=' || p_name || ' I' WHEN 1 THEN 'https://x.org/' ELSE 'word=' || upper(p_name) END"


@query(rf"""SELECT p_partkey, CASE WHEN contains({_URL}, 'word=') THEN trim(string_split({_URL}, 'word=')[-1]) END AS word, lower(trim(regexp_replace(trim(p_name || ' IV'), '\s+[IVX]+$', ''))) AS stem,
  coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, ''), nullif(regexp_extract('n. "' || p_name || '" or "x"', '"([^"]+)"', 1), ''), '') AS gloss, translate(trim(p_name || '₄₁'), '₀₁₂₃₄₅₆₇₈₉', '0123456789') AS token FROM part""")
def dictionary_kernels(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", records.linked_word(F.expr(_URL)).alias("word"), records.entry_stem(F.expr("p_name || ' IV'")).alias("stem"),
        records.entry_gloss(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(""), F.expr("""'n. "' || p_name || '" or "x"'""")).alias("gloss"), records.plain_token(F.expr("p_name || '₄₁'")).alias("token"),
    )


# names


@query(rf"""SELECT DISTINCT trim(n) AS name FROM (SELECT upper(left(p_name, 1)) || substring(p_name, 2) AS n FROM part UNION ALL SELECT 'The' UNION ALL SELECT n_name FROM nation) WHERE regexp_matches(trim(n), '^\p{{Lu}}') AND length(trim(n)) > 2 AND trim(n) NOT IN {_among(names.COMMON_WORDS)}""")
def name_sets(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.initcap(F.split("p_name", " ")[0]).alias("n")).limit(0)
    d = d.unionByName(table(spark, sf_dir, "part").select(F.expr("upper(left(p_name, 1)) || substring(p_name, 2)").alias("n"))).unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("n")))
    return names.name_set(d.unionByName(d.limit(1).select(F.lit("The").alias("n"))), "n")


@query(rf"""WITH l AS (SELECT lower({SQ("p_name")}) AS form, trim({SQ("p_type || '.'")}, '.,;:?! ') AS norm, p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')), r AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY p_partkey, norm) AS i FROM l WHERE form <> '' AND norm <> '')
SELECT form, norm FROM r WHERE i = 1""")
def name_lexicon(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("p_type", F.concat("p_type", F.lit(".")))
    return names.name_lexicon(p, "p_name", "p_type", "p_brand", F.col("p_partkey"), kinds=("Brand#1", "Brand#2", "Brand#3"))


@query(rf"""WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey < 40), d AS (SELECT doc_id, lower(left(text, 200)) || ' ' || p_name || '.' AS t FROM documents LEFT JOIN part ON p_partkey = doc_id % 60)
SELECT name, doc_id FROM n, (SELECT *, ' ' || array_to_string(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{Nd}}_]+'), ' ') || ' ' AS w FROM d) WHERE contains(t, name) AND contains(w, ' ' || name || ' ')""")
def name_containment(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    d = docs(spark, sf_dir, "doc_id", "text").join(p.withColumn("k", F.col("p_partkey")), F.col("doc_id") % 60 == F.col("k"), "left")
    d = d.select("doc_id", F.concat(F.lower(F.left("text", F.lit(200))), F.lit(" "), "p_name", F.lit(".")).alias("t"))
    return names.containing(p.where("p_partkey < 40"), "p_name", d, "doc_id", "t")


@query()
def name_focus(spark, sf_dir):
    p = marked(spark, sf_dir)
    first = F.explode(names.names_of(F.col(_T)))
    ranked = p.select(first.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("misses"))
    return names.name_focus(p, "row_id", _S, _T, ranked, "name", "misses")


# rewards, splits, reports


@query(PAIRS + rf""", w AS (SELECT row_id, {W('target_text')} AS a, {W('source_text')} AS r, trim(target_text) AS ta FROM p), l AS (SELECT *, greatest(len(a), 1) / greatest(len(r), 1) AS q FROM w)
SELECT row_id, round(CASE WHEN ta = '' OR len(r) = 0 THEN 0.0 ELSE 50.0 - (80.0 * pow(greatest(0.0, 0.85 - q), 2) + 40.0 * pow(greatest(0.0, q - 1.25), 2)) END, 6) AS reward FROM l""")
def mixed_rewards(spark, sf_dir):
    """The reward around its likeness, which is given here as 50 and 50; `composite_rewards` takes the real one."""
    given = F.struct(F.lit(50.0).alias("chrf"), F.lit(50.0).alias("bleu"))
    return pairs(spark, sf_dir).select("row_id", F.round(rewards.mixed_reward(F.col("target_text"), F.col("source_text"), scores=given), 6).alias("reward"))


@query()
def composite_rewards(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_id", F.round(rewards.reward(F.col("target_text"), F.col("source_text")), 6).alias("reward"))


@query("""WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'eval' ELSE 'train' END AS split FROM documents) SELECT source, count(DISTINCT split) AS splits FROM d GROUP BY source HAVING count(DISTINCT split) > 1""")
def split_overlap(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "source").withColumn("split", F.when(F.col("doc_id") % 3 == 0, "eval").otherwise("train"))
    return splits.shared_groups(d, "source", "split")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r // ((n + 2) // 3) = 1")
def rank_shard(spark, sf_dir):
    return splits.rank_shard(docs(spark, sf_dir, "doc_id"), "doc_id", 1, 3)


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 100 AS BIGINT) AS bucket FROM documents")
def bucket_numbers(spark, sf_dir):
    d = splits.with_place(docs(spark, sf_dir, "doc_id", "n_chars"), "n_chars", "doc_id")
    return d.select("doc_id", F.floor(F.col("place") / 100).cast("long").alias("bucket"))


@query("""
SELECT CASE WHEN doc_id % 4 = 0 THEN 'eval' ELSE 'train' END AS split, count(*) AS examples, count(*) FILTER (doc_id % 3 > 0) AS annotated_examples, round(count(*) FILTER (doc_id % 3 > 0) / count(*), 4) AS annotated_example_ratio,
  CAST(sum(doc_id % 5) AS BIGINT) AS masked_spans, CAST(sum(doc_id % 3) AS BIGINT) AS annotated_spans, round(sum(doc_id % 3) / sum(doc_id % 5), 4) AS annotated_span_ratio, round(avg(n_chars), 2) AS avg_input_len, round(avg(n_chars * 2), 2) AS avg_label_len FROM documents GROUP BY 1""")
def record_summary(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "n_chars").selectExpr("CASE WHEN doc_id % 4 = 0 THEN 'eval' ELSE 'train' END AS split", "doc_id % 5 AS masked_spans", "doc_id % 3 AS annotated_spans", "n_chars AS input_len", "n_chars * 2 AS label_len")
    return aggregates.record_summary(d, "split").select("split", *whole("examples", "annotated_examples"), "annotated_example_ratio", *whole("masked_spans", "annotated_spans"), "annotated_span_ratio", "avg_input_len", "avg_label_len")


@query(PAIRS + """, x AS (SELECT 'source' AS side, strlen(source_text) + 1 AS raw, 128 AS cap FROM p UNION ALL SELECT 'target', strlen(target_text) + 1, 256 FROM p), c AS (SELECT *, least(raw, cap) AS cut FROM x)
SELECT side, CAST(cap AS BIGINT) AS cap, count(*) AS n, CAST(min(raw) AS BIGINT) AS raw_min, CAST(max(raw) AS BIGINT) AS raw_max, round(avg(raw), 6) AS raw_avg, CAST(min(cut) AS BIGINT) AS cut_min, CAST(max(cut) AS BIGINT) AS cut_max, round(avg(cut), 6) AS cut_avg,
  count(*) FILTER (raw > cap) AS truncated, count(*) FILTER (cut = cap) AS at_cap FROM c GROUP BY side, cap""")
def truncation_stats(spark, sf_dir):
    d = aggregates.truncation(pairs(spark, sf_dir), "source_text", "target_text", 128, 256)
    return d.select("side", *whole("cap", "n", "raw_min", "raw_max"), *rounded("raw_avg"), *whole("cut_min", "cut_max"), *rounded("cut_avg"), *whole("truncated", "at_cap"))


@query("""WITH u AS (SELECT 0 AS place, 'old' AS part, doc_id AS k FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 1, 'new', doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 2, 'labels', doc_id FROM labels), f AS (SELECT k AS fk, min(place) AS first FROM u GROUP BY k)
SELECT part, count(*) AS n, count(DISTINCT k) AS keys, count(DISTINCT CASE WHEN place > first THEN k END) AS known FROM u JOIN f ON k = fk GROUP BY part""")
def merge_report(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id")
    return aggregates.merge_report({"old": d.where("doc_id % 3 = 0"), "new": d.where("doc_id % 2 = 0"), "labels": table(spark, sf_dir, "labels").select("doc_id")}, "doc_id").select("part", *whole("n", "keys", "known"))


@query("""WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS t, [left(text, 3), role] AS c FROM conversations)
SELECT conv_id, string_agg(trim(t), ' ' ORDER BY turn, t) FILTER (trim(t) <> '') AS text, round(avg(turn), 6) AS confidence, len(list_distinct(flatten(list(c)))) AS candidates, count(*) AS parts FROM s GROUP BY conv_id""")
def reassembled_segments(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.col("turn").cast("double").alias("confidence"), F.array(F.left("text", F.lit(3)), F.col("role")).alias("candidates"))
    return aggregates.reassembled(d, "conv_id", "turn", "text", "confidence", "candidates").select("conv_id", "text", *rounded("confidence"), F.size("candidates").cast("long").alias("candidates"), *whole("parts"))


_HALF = PAIRS + rf""", h AS (SELECT row_id, source_text, CASE conv_id % 4 WHEN 0 THEN left(target_text, 40) || ' <gap>' WHEN 1 THEN left(target_text, 20) || ',' ELSE target_text END AS target_text FROM p),
w AS (SELECT *, len({W('source_text')}) AS s, len({W('target_text')}) AS t, len({W('source_text')}) / greatest(len({W('target_text')}), 1) AS r, regexp_matches(target_text, '(?i)<gap>\s*$') AS ends, regexp_matches(target_text, '[,;-]\s*$') AS abrupt FROM h),
u AS (SELECT least(median(r) * 1.3, 1.5) AS k FROM w WHERE NOT ends AND r < 1.5), c AS (SELECT *, CAST(floor(t * k) AS INT) + 2 AS keep, (ends AND r > 1.5) OR (r > 2.5 AND s > 20) OR (abrupt AND r > 2.0 AND s > 10) AS suspect FROM w, u)"""


@query(_HALF + rf""" SELECT row_id, suspect AND keep < s AS cropped, CASE WHEN suspect AND keep < s THEN regexp_replace(array_to_string(({W('source_text')})[1:keep], ' ') || ' <gap>', '(<gap>)(?: <gap>)+', '\1', 'g') ELSE source_text END AS source_text FROM c""")
def cropped_halves(spark, sf_dir):
    cut = F.expr("CASE conv_id % 4 WHEN 0 THEN left(target_text, 40) || ' <gap>' WHEN 1 THEN left(target_text, 20) || ',' ELSE target_text END")
    return chunking.cropped_halves(pairs(spark, sf_dir).withColumn("target_text", cut), "source_text", "target_text").select("row_id", "cropped", "source_text")


@query("""WITH d AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'y' END || CAST(doc_id % 50 AS VARCHAR) AS k, source AS v FROM documents), c AS (SELECT k, v, count(*) AS c FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, v) AS i FROM c),
l AS (SELECT k, first(v ORDER BY i) AS v FROM r WHERE i <= 2 GROUP BY k HAVING max(CASE WHEN i = 2 THEN c END) IS NULL OR max(c) >= 2 * max(CASE WHEN i = 2 THEN c END))
SELECT k, v FROM l UNION ALL SELECT k, 'base' FROM (SELECT DISTINCT k FROM d) WHERE k NOT IN (SELECT k FROM l)""")
def lexicon_fallback(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "source").selectExpr("CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'y' END || CAST(doc_id % 50 AS STRING) AS k", "source AS v")
    return aggregates.with_fallback(aggregates.decisive(d, "k", "v").select("k", "v"), d.select("k").distinct().withColumn("v", F.lit("base")), "k")


# alignment, roles, augmentation


@query(PAIRS + rf""" SELECT row_id, len(list_filter(regexp_extract_all(replace(lower(source_text), '-', ''), '[a-z]{{3,}}'), lambda y: y IN {_among(alignment.ENGLISH)})) > 0 AS english FROM p""")
def english_sources(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_id", alignment.english_in_source(F.col("source_text")).alias("english"))


@query()
def suspicious_sentences(spark, sf_dir):
    p = pairs(spark, sf_dir).select("row_id", F.concat(F.lit("0.3333 ma-na₄ "), "source_text").alias("s"), "target_text")
    return alignment.suspicious_pairs(p.select("row_id", F.array(F.struct(F.col("s").alias("source"), F.col("target_text").alias("target"))).alias("pairs")), "row_id", "pairs").select("row_id", "sentence", "source_forms.decimals", "source_forms.subscripts")


@query(r"""WITH c AS (SELECT unnest(string_split(left(text, 300) || ' <gap> 2½ [x b] ...', '')) AS c, doc_id FROM documents WHERE text IS NOT NULL)
SELECT 'numeric' AS role, CAST(sum(CASE WHEN regexp_matches(c, '[0-9]') THEN 1 WHEN c IN ('½', '⅓', '⅔', '¼', '¾') THEN strlen(c) ELSE 0 END) AS BIGINT) AS n FROM c""")
def role_distribution(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text").where("text IS NOT NULL").select(roles.text_ids(F.concat(F.left("text", F.lit(300)), F.lit(" <gap> 2½ [x b] ..."))).alias("ids"))
    return roles.role_distribution(d, "ids").where("role = 'numeric'").select("role", *whole("n"))


@query(rf"""WITH l AS (SELECT lower(p_name) AS w, min(p_type) AS g FROM part GROUP BY 1), t AS (SELECT p_partkey, unnest({W("p_name || ' and'")}) AS w, unnest(range(1, len({W("p_name || ' and'")}) + 1)) AS i FROM part),
f AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS w FROM part) SELECT p_partkey, string_agg(CASE WHEN w IN (SELECT w FROM f) THEN w || ' [' || upper(w) || ']' ELSE w END, ' ' ORDER BY i) AS text FROM t GROUP BY p_partkey""")
def glossed_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.select(F.split("p_name", " ")[1].alias("w")).distinct().select(F.col("w").alias("k"), F.upper("w").alias("v"))
    lexicon = F.map_from_entries(F.array(*[F.struct(F.lit(r["k"]), F.lit(r["v"])) for r in known.collect()]))  # a few words of parts
    return p.select("p_partkey", augment.glossed(F.concat("p_name", F.lit(" and")), lexicon).alias("text"))


@query()
def correction_examples(spark, sf_dir):
    return augment.correction_examples(pairs(spark, sf_dir), "row_id", "source_text", "correct")


@query()
def training_inputs(spark, sf_dir):
    d = joins.previous_in_group(pairs(spark, sf_dir), "conv_id", ["turn"], "target_text")
    return augment.training_inputs(d, "row_id", "source_text", context=F.col("context"), prefix=F.lit("OAOI ")).select("row_id", "input_text")


@query()
def shuffled_buckets(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "n_chars").withColumn("t", F.col("n_chars") % 100)
    return windows.shuffled_buckets(d, "doc_id", "n_chars", "t").select("doc_id", "bucket", "place")
