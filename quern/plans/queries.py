"""The registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schema
from quern.functions import features, metrics, records, similarity, text
from quern.operators import aggregates, alignment, augment, builders, chunking, consensus, correction, dedup, evaluation, filters, joins, retrieval, splits, windows
from quern.plans.tables import ORACLE, QUERIES
from quern.streaming import append


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of very few files has as few scan tasks, whatever the cores; work on its texts is dealt out first. Others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df._jdf.queryExecution().toRdd().getNumPartitions()  # a number alone comes to the driver's Python
    return df.repartition(cores) if tasks < min(cores, 32) else df


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text", "lang", "source"))))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.conversation_pairs(table(spark, sf_dir, "conversations"))


def whole(*names: str) -> list:
    """Counts as long, so that both engines give the same type."""
    return [F.col(n).cast("long").alias(n) for n in names]


def rounded(*names: str, digits: int = 6) -> list:
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]


PAIRS = r"""
WITH p0 AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, lead(role) OVER w AS nr, lead(turn) OVER w AS nt, coalesce(lead(text) OVER w, '') AS ntext
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), p AS (
  SELECT conv_id || '-' || turn AS row_id, conv_id, turn, text AS source_text, ntext AS target_text
  FROM p0 WHERE role = 'user' AND nr = 'assistant' AND nt = turn + 1
)"""


def W(t: str) -> str:
    """SQL for the words of a text."""
    return rf"list_filter(string_split(trim(regexp_replace({t}, '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


def SQ(t: str) -> str:
    return rf"trim(regexp_replace(coalesce({t}, ''), '\s+', ' ', 'g'))"


# cleaning and filtering


@query(rf"""
WITH c AS (SELECT doc_id, source, {SQ('text')} AS clean FROM documents),
f AS (SELECT *, len({W('clean')}) AS n FROM c),
k AS (SELECT * FROM f WHERE length(clean) >= 10 AND n >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY doc_id) AS i FROM k)
SELECT doc_id, source, clean, CAST(n AS BIGINT) AS n_words FROM r WHERE i = 1""")
def clean_corpus(spark, sf_dir):
    """Flagship: normalise white space, reject short texts with a reason, keep the first of equal texts."""

    def made(t):
        return F.struct(t.alias("clean"), F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long").alias("n_words"))

    def reason(x):
        return F.when(F.length(x["clean"]) < 10, "short").when(x["n_words"] < 3, "few_words")

    d = filters.made_and_kept(docs(spark, sf_dir, "doc_id", "source", "text"), ["doc_id", "source"], text.squeeze(F.col("text")), made, reason)
    return dedup.keep_first_text(d, "clean", "doc_id")


@query(rf"SELECT doc_id, {SQ('text')} AS clean FROM documents WHERE len({W('coalesce(text, chr(32))')}) >= 3")
def norm_ws_filter(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text").select("doc_id", text.squeeze(F.col("text")).alias("clean"))
    return d.where(text.word_count(F.col("clean")) >= 3)


@query(PAIRS + rf"""
SELECT row_id, round(length(source_text) / (length(target_text) + 1), 6) AS ratio FROM p
WHERE length(source_text) / (length(target_text) + 1) BETWEEN 0.1 AND 3.5 AND length(target_text) >= 10
  AND len({W('source_text')}) / greatest(len({W('target_text')}), 1) <= 6""")
def length_ratio_filter(spark, sf_dir):
    p = pairs(spark, sf_dir)
    s, t = F.col("source_text"), F.col("target_text")
    d = p.where(filters.length_ratio(s, t).between(0.1, 3.5) & (F.length(t) >= 10) & (filters.word_ratio(s, t) <= 6))
    return d.select("row_id", F.round(filters.length_ratio(s, t), 6).alias("ratio"))


_MARKS = " OR ".join(f"contains(lower(source_text), '{m}') OR contains(lower(target_text), '{m}')" for m in filters.ENTRY_MARKS)
_TABLE = " + ".join(f"CAST(contains(lower(source_text || ' ' || target_text), '{m}') AS INT)" for m in filters.TABLE_WORDS)


@query(PAIRS + rf""", r AS (SELECT CASE
  WHEN length(target_text) < 10 THEN 'short_target'
  WHEN length(source_text) / (length(target_text) + 1) < 0.1 THEN 'ratio_low'
  WHEN length(source_text) / (length(target_text) + 1) > 3.5 THEN 'ratio_high'
  WHEN {_MARKS} OR (len({W('source_text')}) < 2 AND len({W('target_text')}) < 3 AND NOT contains(lower(source_text), '<gap>')) THEN 'auxiliary'
  WHEN len(regexp_extract_all(source_text, '\d+:\d+')) >= 3 THEN 'page_references_in_source'
  WHEN {_TABLE} >= 2 THEN 'tabular_data'
  WHEN len({W('source_text')}) > 10 AND len(list_filter({W('source_text')}, lambda y: regexp_full_match(y, '[a-z]{{1,2}}'))) / len({W('source_text')}) > 0.3 THEN 'abbreviation_heavy'
  END AS reason FROM p)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def reject_reason_counts(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return filters.reason_counts(filters.with_reason(p, filters.pair_reason(F.col("source_text"), F.col("target_text"))))


@query(PAIRS + rf"""
SELECT row_id, (len({W('source_text')}) <= 16 AND len({W('target_text')}) >= 25)
  OR (len({W('source_text')}) / greatest(len({W('target_text')}), 1) < 0.30 AND len({W('target_text')}) >= 18)
  OR (len({W('source_text')}) <= 2 AND len({W('target_text')}) >= 10)
  OR (len({W('source_text')}) / greatest(len({W('target_text')}), 1) < 0.12 AND len({W('target_text')}) >= 10) AS risk FROM p""")
def alignment_risk_flags(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_id", filters.alignment_risk(F.col("source_text"), F.col("target_text")).alias("risk"))


@query(r"""
SELECT doc_id, regexp_matches(text, '^\s*[-/,:]|[-/,:]\s*$')
  OR length(replace(text, '(', '')) <> length(replace(text, ')', '')) OR length(replace(text, '[', '')) <> length(replace(text, ']', ''))
  OR length(replace(text, '{', '')) <> length(replace(text, '}', ''))
  OR regexp_matches(text, '(?i)\b(?:and|or|of|the|to|a|an|in|on|for|with|from|by)\s*$') AS incomplete FROM documents""")
def incomplete_texts(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", filters.incomplete(F.col("text")).alias("incomplete"))


@query(rf"""
SELECT doc_id, round(len(list_filter({W('text')}, lambda y: length(y) <= 3 AND ends_with(y, '.'))) / greatest(len({W('text')}), 1), 6) AS share FROM documents""")
def damaged_word_share(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.round(filters.damaged_words(F.col("text")), 6).alias("share"))


# deduplication and joins


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS i FROM documents) WHERE i = 1")
def dedup_keep_first(spark, sf_dir):
    return dedup.keep_first(docs(spark, sf_dir, "doc_id", "text"), ["text"], ["doc_id"])


@query(PAIRS + """
SELECT source_text, target_text, row_id FROM (SELECT *, row_number() OVER (PARTITION BY source_text, target_text ORDER BY row_id) AS i FROM p) WHERE i = 1""")
def dedup_pairs(spark, sf_dir):
    return dedup.keep_first_pair(pairs(spark, sf_dir).select("source_text", "target_text", "row_id"), "source_text", "target_text", "row_id")


@query(rf"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {SQ('text')} ORDER BY doc_id) AS i FROM documents) WHERE i = 1")
def dedup_fingerprint(spark, sf_dir):
    return dedup.keep_first_fingerprint(docs(spark, sf_dir, "doc_id", "text"), "text", "doc_id").select("doc_id")


@query(PAIRS + ", u AS (SELECT source_text, min(target_text) AS target_text FROM p GROUP BY source_text HAVING min(target_text) = max(target_text)) SELECT * FROM u")
def unambiguous_key_pairs(spark, sf_dir):
    return joins.unambiguous(pairs(spark, sf_dir), ["source_text"], "target_text")


@query("SELECT item_id, text FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)")
def eval_leakage_antijoin(spark, sf_dir):
    return joins.without_leakage(table(spark, sf_dir, "benchmark").select("item_id", "text"), docs(spark, sf_dir, "text"), "text")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0")
def append_only_new_ids(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "lang")
    return joins.append_new(d.where("doc_id % 3 = 0"), d.where("doc_id % 2 = 0"), ["doc_id"])


@query(r"""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 60) || '...' ELSE text END AS text FROM documents),
o AS (SELECT doc_id, text AS old FROM documents)
SELECT c.doc_id, length(CASE WHEN b THEN old ELSE text END) AS n_chars, b AS backfilled FROM (
  SELECT c.doc_id, c.text, old, coalesce(old <> '' AND (
    ((ends_with(c.text, '...') OR ends_with(c.text, '<gap>')) AND length(old) > length(c.text))
    OR (length(c.text) - length(replace(c.text, ' ', '')) < 8 AND length(old) > length(c.text) + 40)
    OR ends_with(rtrim(c.text), '/') OR ends_with(rtrim(c.text), '-')
    OR (length(trim(c.text)) >= 12 AND starts_with(trim(old), trim(c.text)) AND length(trim(old)) > length(trim(c.text)) + 20)), false) AS b
  FROM c LEFT JOIN o ON c.doc_id = o.doc_id) c""")
def backfill_coalesce(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text")
    cut = d.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.substring("text", 1, 60), F.lit("..."))).otherwise(F.col("text")))
    return joins.backfill(cut, d, "doc_id", "text", F.col("doc_id")).select("doc_id", F.length("text").cast("long").alias("n_chars"), "backfilled")


@query("SELECT doc_id, length(CASE WHEN doc_id % 2 = 0 AND length(text) <= 400 THEN left(text, 300) ELSE text END) AS n_chars, doc_id % 2 = 0 AND length(text) > 400 AS restored FROM documents")
def restore_longer(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text")
    cut = d.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 300)).otherwise(F.col("text")))
    out = joins.restore_longer(cut, d, "doc_id", "text", F.col("doc_id"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), "restored")


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 10 <> 0 THEN 'reviewed' ELSE source END AS source, doc_id % 5 = 0 AND doc_id % 10 <> 0 AS changed FROM documents""")
def review_override(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "source")
    review = d.where("doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "").otherwise("reviewed").alias("source"), F.col("doc_id").alias("o"))
    return joins.override(d, review, "doc_id", ["source"], F.col("o")).select("doc_id", "source", "changed")


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS text FROM documents LEFT JOIN (SELECT doc_id AS i, max(quality) AS quality FROM labels GROUP BY 1) ON i = doc_id")
def complete_ids(spark, sf_dir):
    found = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("text"))
    return joins.complete(docs(spark, sf_dir, "doc_id"), found, "doc_id", "text")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def blacklist_ids(spark, sf_dir):
    return filters.blacklist(docs(spark, sf_dir, "doc_id"), table(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@query(rf"""
WITH v AS (SELECT token AS w, count(*) AS f FROM (SELECT unnest({W('lower(p_name)')}) AS token FROM part) GROUP BY 1),
t AS (SELECT DISTINCT left(w, length(w) - 1) AS t FROM v WHERE length(w) > 3),
m AS (SELECT t, w, f, levenshtein(t, w) AS d FROM t, v WHERE abs(length(t) - length(w)) <= 2 AND levenshtein(t, w) <= 2)
SELECT t AS token, w AS word, CAST(d AS INTEGER) AS distance, f AS freq FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d, f DESC, w) AS i FROM m) WHERE i = 1""")
def levenshtein_vocab_match(spark, sf_dir):
    v = aggregates.token_counts(table(spark, sf_dir, "part").select("p_name"), "p_name").select(F.col("token").alias("word"), F.col("n").alias("freq"))
    t = v.where(F.length("word") > 3).select(F.expr("substring(word, 1, length(word) - 1)").alias("token")).distinct()
    return joins.nearest_word(t, v)


# aggregations


@query(rf"SELECT token, count(*) AS n FROM (SELECT unnest({W('lower(text)')}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 30")
def token_top30(spark, sf_dir):
    return aggregates.top_tokens(docs(spark, sf_dir, "text"), "text")


@query(rf"""
WITH t AS (SELECT doc_id, unnest({W('lower(text)')}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t GROUP BY token)
SELECT d.doc_id, round(coalesce(r, 0), 6) AS rare_token_ratio FROM (SELECT DISTINCT doc_id FROM documents) d
LEFT JOIN (SELECT doc_id, avg(CASE WHEN n <= 2 THEN 1.0 ELSE 0.0 END) AS r FROM t JOIN c USING (token) GROUP BY doc_id) USING (doc_id)""")
def rare_token_ratio(spark, sf_dir):
    return aggregates.rare_token_ratio(docs(spark, sf_dir, "doc_id", "text"), "doc_id", "text").select("doc_id", *rounded("rare_token_ratio"))


@query(rf"""
WITH w AS (SELECT row_number() OVER () AS r, {W('text')} AS w FROM documents), z AS (SELECT unnest([2, 3, 4, 5, 6, 8]) AS n),
g AS (SELECT r, n, array_to_string(w[i : i + n - 1], chr(1)) AS g FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM w, z WHERE len(w) >= n)),
c AS (SELECT r, n, g, count(*) AS c FROM g GROUP BY ALL), s AS (SELECT r, n, sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) / count(*) AS rate FROM c GROUP BY r, n)
SELECT CAST(n AS BIGINT) AS n, round(avg(rate), 6) AS mean, round(median(rate), 6) AS median, round(max(rate), 6) AS high, CAST(count(*) FILTER (rate > 0) AS BIGINT) AS texts_with_repeat FROM s GROUP BY n""")
def ngram_repeat_rate(spark, sf_dir):
    return aggregates.ngram_repeats(docs(spark, sf_dir, "text"), "text").select(*whole("n"), *rounded("mean", "median", "high"), *whole("texts_with_repeat"))


_TOKEN_LANG = rf"WITH t AS (SELECT lang, unnest({W('lower(text)')}) AS token FROM documents WHERE lang IS NOT NULL), c AS (SELECT token, lang, count(*) AS c FROM t GROUP BY ALL)"


def token_langs(spark, sf_dir):
    d = docs(spark, sf_dir, "lang", "text").where("lang IS NOT NULL")
    return d.select("lang", F.explode(text.words(F.lower("text"))).alias("token"))


@query(_TOKEN_LANG + """, s AS (SELECT token, sum(c) AS total, max(c) AS top, first(lang ORDER BY c DESC, lang) AS lang FROM c GROUP BY token)
SELECT token, CAST(total AS BIGINT) AS total, CAST(top AS BIGINT) AS top, lang FROM s WHERE total >= 2 AND top / total >= 0.8""")
def support_dominance_lexicon(spark, sf_dir):
    return aggregates.dominant(token_langs(spark, sf_dir), "token", "lang").select("token", *whole("total", "top"), "lang")


@query(_TOKEN_LANG + """, r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY c DESC, lang) AS i FROM c)
SELECT token, first(lang ORDER BY i) AS lang, CAST(max(c) AS BIGINT) AS top FROM r WHERE i <= 2 GROUP BY token
HAVING max(CASE WHEN i = 2 THEN c END) IS NULL OR max(c) >= 2 * max(CASE WHEN i = 2 THEN c END)""")
def calibrated_lexicon(spark, sf_dir):
    return aggregates.decisive(token_langs(spark, sf_dir), "token", "lang").select("token", "lang", *whole("top"))


@query("SELECT source, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY source")
def source_shares(spark, sf_dir):
    return aggregates.shares(docs(spark, sf_dir, "source"), "source").select("source", *whole("n"), *rounded("share"))


@query("""
SELECT source AS grp, count(length(text) / (n_chars + 1)) AS n, round(avg(length(text) / (n_chars + 1)), 6) AS mean, round(median(length(text) / (n_chars + 1)), 6) AS median,
  round(min(length(text) / (n_chars + 1)), 6) AS low, round(max(length(text) / (n_chars + 1)), 6) AS high, round(stddev_samp(length(text) / (n_chars + 1)), 6) AS deviation
FROM documents GROUP BY GROUPING SETS ((source), ())""")
def ratio_summary(spark, sf_dir):
    d = aggregates.ratio_summary(docs(spark, sf_dir, "source", "text", "n_chars"), F.length("text") / (F.col("n_chars") + 1), "source")
    return d.select("grp", *whole("n"), *rounded("mean", "median", "low", "high", "deviation"))


@query("""
WITH f AS (SELECT l_linenumber AS fold, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1),
u AS (SELECT 'quantity' AS metric, quantity AS v FROM f UNION ALL SELECT 'discount', discount FROM f)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round(median(v), 6) AS median, round(min(v), 6) AS worst, round(max(v), 6) AS best, round(max(v) - min(v), 6) AS spread FROM u GROUP BY metric""")
def cross_fold_summary(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return aggregates.fold_summary(f, ["quantity", "discount"]).select("metric", *rounded("mean", "deviation", "median", "worst", "best", "spread"))


@query("SELECT min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 6) AS avg_chars, CAST(min(strlen(text)) AS BIGINT) AS min_bytes, CAST(max(strlen(text)) AS BIGINT) AS max_bytes, round(avg(strlen(text)), 6) AS avg_bytes, count(*) FILTER (strlen(text) > 512) AS over_cap FROM documents")
def byte_length_stats(spark, sf_dir):
    d = aggregates.byte_lengths(docs(spark, sf_dir, "text"), "text", 512)
    return d.select(*whole("min_chars", "max_chars"), *rounded("avg_chars"), *whole("min_bytes", "max_bytes"), *rounded("avg_bytes"), *whole("over_cap"))


@query("SELECT event_type, dow, count(*) AS n FROM (SELECT event_type, CAST(user_id % 3 AS BIGINT) AS dow FROM events) GROUP BY ROLLUP (event_type, dow)")
def status_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("dow"))
    return aggregates.status_counts(d, "event_type", "dow")


@query("SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn, text) AS text, count(*) AS parts FROM conversations GROUP BY conv_id")
def ordered_group_concat(spark, sf_dir):
    return aggregates.ordered_text(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text").select("conv_id", "text", *whole("parts"))


@query("""
WITH g AS (SELECT user_id AS u, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN s < 1e-8 THEN 0.0 ELSE greatest(-3.0, least(3.0, (value - m) / (s + 1e-8))) END, 4) AS advantage FROM events JOIN g ON u = user_id""")
def group_advantage(spark, sf_dir):
    return aggregates.advantages(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", *rounded("advantage", digits=4))


@query("""
WITH x AS (SELECT label + 1 AS w, unnest(embedding) AS x, unnest(range(len(embedding))) AS place FROM embeddings)
SELECT place, round(sum(CAST(x AS DOUBLE) * w) / sum(w), 6) AS value FROM x GROUP BY place""")
def weighted_embedding_average(spark, sf_dir):
    d = aggregates.weighted_average(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("label") + 1)
    return d.select(*whole("place"), *rounded("value"))


@query("""
WITH s AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT conv_id, CAST(island AS BIGINT) AS island, string_agg(text, ' ' ORDER BY turn, text) AS text, count(*) AS parts FROM i GROUP BY conv_id, island""")
def stitched_records(spark, sf_dir):
    d = aggregates.stitched(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", "text")
    return d.select("conv_id", *whole("island"), "text", *whole("parts"))


# windows and sorting


@query("""WITH l AS (SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS t FROM conversations)
SELECT conv_id, turn, left(t, list_max(list_filter(range(0, 151), lambda n: strlen(left(t, n)) <= 150))) AS context FROM l""")
def prev_context_lag(spark, sf_dir):
    """The row before, cut to whole characters within 150 bytes."""
    d = table(spark, sf_dir, "conversations")
    return joins.previous_in_group(d, "conv_id", ["turn"], "text").select("conv_id", "turn", "context")


@query("\nUNION ALL\n".join(rf"""
SELECT conv_id, first, CAST({n} AS BIGINT) AS size, text FROM (
  SELECT conv_id, turn AS first, list(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS p, array_to_string(p, ' ') AS text FROM conversations)
WHERE len(p) = {n} AND list_sum(list_transform(p, lambda x: length(x))) <= 260""" for n in (2, 3, 4)))  # fmt: skip
def sliding_turn_windows(spark, sf_dir):
    return windows.sliding_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "first", *whole("size"), "text")


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1000) AS stop FROM conversations")
def next_start(spark, sf_dir):
    return windows.next_start(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn", F.lit(1000)).select("conv_id", "turn", *whole("stop"))


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS r, count(*) OVER () AS n, (SELECT count(DISTINCT n_chars) FROM documents) AS u FROM documents)
SELECT doc_id, 'len_' || CASE WHEN u <= 1 THEN 0 ELSE greatest(0, ((r - 1) * least(5, u) + n - 2) // greatest(n - 1, 1) - 1) END AS n_chars_bucket FROM r""")
def quantile_bucket_label(spark, sf_dir):
    return windows.quantile_buckets(docs(spark, sf_dir, "doc_id", "n_chars"), "n_chars", "doc_id", 5, "len").select("doc_id", "n_chars_bucket")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def worst_n(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


_FULL = "(f.n + 1) * 2 * greatest(f.m, x.a) > 20000"


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, n_chars AS a, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), x AS (SELECT doc_id, a, i // 512 AS bucket, i % 512 AS k FROM r),
f AS (SELECT bucket, k, doc_id, 0 AS batch, 1 AS n, a AS m FROM x WHERE k = 0
  UNION ALL SELECT x.bucket, x.k, x.doc_id, f.batch + CASE WHEN {_FULL} THEN 1 ELSE 0 END, CASE WHEN {_FULL} THEN 1 ELSE f.n + 1 END, CASE WHEN {_FULL} THEN x.a ELSE greatest(f.m, x.a) END FROM f JOIN x ON x.bucket = f.bucket AND x.k = f.k + 1)
SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, CAST(batch AS BIGINT) AS batch FROM f""")
def token_budget_batches(spark, sf_dir):
    """Batches within runs of 512 rows, of which there are as many as the table needs."""
    d = windows.bucket_number(docs(spark, sf_dir, "doc_id", "n_chars").selectExpr("doc_id", "n_chars AS a", "n_chars AS b"), "doc_id", 512)
    return windows.batched(d, "bucket", "doc_id", "a", "b", 20_000).select("doc_id", *whole("bucket", "batch"))


# text functions


@query(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '(?s)<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query()
def damage_token_unify(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", text.unify_gaps(F.col("text")).alias("text"))


@query()
def fraction_normalise(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", text.unify_fractions(F.col("text")).alias("text"))


@query()
def clean_source_texts(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_id", text.clean_source(F.col("source_text")).alias("source_text"), text.clean_target(F.col("target_text")).alias("target_text"))


@query()
def postprocess_outputs(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_id", text.trim_fragment(text.postprocess(F.col("target_text"))).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), '\s+', ' ', 'g')) AS form FROM documents")
def compare_form(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", text.compare_form(F.col("text")).alias("form"))


@query("SELECT doc_id, left(sha256(source || '|' || text), 16) AS id FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def text_ids(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "source", "text").where("text IS NOT NULL AND source IS NOT NULL")
    return d.select("doc_id", text.text_id(F.col("source"), F.col("text")).alias("id"))


# features


def _any(column: str, marks) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in marks) + ")"


_N = r"(length({0}) - length(replace({0}, '{1}', ''))) / {2}"


@query(PAIRS + rf""", l AS (SELECT row_id, trim(source_text) AS s, trim(target_text) AS t, lower(s) AS sl, lower(t) AS tl FROM p)
SELECT row_id, CASE
  WHEN ({_N.format('sl', '<gap>', 5)} + {_N.format('tl', '<gap>', 5)} >= 2) OR ({_N.format('s', '...', 3)} + {_N.format('t', '...', 3)} >= 2) OR ({_N.format('s', '…', 1)} + {_N.format('t', '…', 1)} >= 2) THEN 'fragmentary'
  WHEN {_any('tl', features.WITNESS)} THEN 'witness' WHEN {_any('tl', features.LOAN)} THEN 'loan'
  WHEN (starts_with(sl, 'a-na ') AND (contains(sl, 'qí-bi-ma') OR contains(sl, 'qi-bi-ma') OR contains(sl, 'um-ma'))) OR (contains(sl, 'um-ma') AND (contains(sl, 'qí-bi-ma') OR contains(sl, 'qi-bi-ma') OR contains(sl, 'qí-bi4-ma')))
    OR starts_with(t, 'To ') OR starts_with(t, 'From ') OR ({_any('tl', features.LETTER)} AND contains(tl, 'to ') AND contains(tl, ' from ')) THEN 'letter'
  WHEN {_any('tl', features.ACCOUNT)} OR {_any('sl', features.SOURCE_ACCOUNT)} THEN 'account' WHEN {_any('tl', features.LEGAL)} THEN 'legal'
  WHEN {_any('tl', features.OATH)} OR {_any('sl', features.SOURCE_OATH)} THEN 'oath' WHEN {_any('tl', features.DATE)} OR {_any('sl', features.SOURCE_DATE)} THEN 'date' ELSE 'other' END AS doc_type FROM l""")
def doc_type_case(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_id", features.document_type(F.col("source_text"), F.col("target_text")).alias("doc_type"))


@query(PAIRS + rf""", w AS (SELECT row_id, source_text, {W('source_text')} AS s, regexp_extract_all(target_text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?') AS t FROM p)
SELECT row_id, length(source_text) AS src_len_char, len(s) AS src_len_tok, len(t) AS tgt_len_tok, round(len(t) / greatest(len(s), 1), 6) AS len_ratio,
  round(CASE WHEN len(t) = 0 THEN 0 ELSE list_sum(list_transform(t, lambda x: length(x))) / len(t) END, 6) AS avg_word_len FROM w""")
def pair_features(spark, sf_dir):
    d = features.pair_features(pairs(spark, sf_dir).select("row_id", "source_text", "target_text"), "source_text", "target_text")
    return d.select("row_id", *whole("src_len_char", "src_len_tok", "tgt_len_tok"), *rounded("len_ratio", "avg_word_len"))


@query(r"""
SELECT doc_id, CASE trim(lang) WHEN 'OB' THEN 'OB' WHEN 'OAkk' THEN 'XX' WHEN 'Sumerian' THEN 'XX' ELSE 'OA' END || 'O'
  || CASE WHEN contains(text, '<gap>') OR contains(text, '[') OR contains(text, ']') OR regexp_matches(text, '(?i)(?:^|[^\pL\pM\p{Nd}_])x(?:$|[^\pL\pM\p{Nd}_])') OR contains(text, '⸢') OR contains(text, '⸣') OR contains(text, '...') THEN 'D' ELSE 'I' END || ' ' AS prefix FROM documents""")
def meta_prefix(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text", "lang", "source").select("doc_id", features.meta_prefix(F.col("text"), F.col("source"), F.col("lang")).alias("prefix"))


# similarity and metrics


@query(PAIRS + rf""", w AS (SELECT row_id, list_distinct({W('lower(source_text)')}) AS a, list_distinct({W('lower(target_text)')}) AS b FROM p)
SELECT row_id, round(CASE WHEN len(a) + len(b) = 0 THEN 100.0 ELSE 100.0 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM w""")
def word_jaccard_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_id", F.round(dedup.word_jaccard(F.col("source_text"), F.col("target_text")), 6).alias("jaccard"))


@query(PAIRS + rf""", a AS (SELECT row_id, w, count(*) AS c FROM (SELECT row_id, unnest({W('lower(source_text)')}) AS w FROM p) GROUP BY ALL),
b AS (SELECT row_id, w, count(*) AS c FROM (SELECT row_id, unnest({W('lower(target_text)')}) AS w FROM p) GROUP BY ALL)
SELECT p.row_id, CAST(coalesce(n, 0) AS BIGINT) AS shared FROM p LEFT JOIN (SELECT a.row_id, sum(least(a.c, b.c)) AS n FROM a JOIN b ON a.row_id = b.row_id AND a.w = b.w GROUP BY 1) x ON x.row_id = p.row_id""")
def multiset_token_overlap(spark, sf_dir):
    s, t = text.words(F.lower("source_text")), text.words(F.lower("target_text"))
    return pairs(spark, sf_dir).select("row_id", dedup.multiset_overlap(s, t).cast("long").alias("shared"))


@query(PAIRS + rf""", n AS (SELECT row_id, greatest(len({W('target_text')}), 1) / greatest(len({W('source_text')}), 1) AS r FROM p)
SELECT row_id, round(80.0 * pow(greatest(0.0, 0.85 - r), 2) + 40.0 * pow(greatest(0.0, r - 1.25), 2), 6) AS length_penalty, round(CASE WHEN r >= 0.8 THEN 0.0 ELSE (0.8 - r) * 50.0 END, 6) AS coverage_penalty FROM n""")
def length_penalties(spark, sf_dir):
    h, r = F.col("target_text"), F.col("source_text")
    return pairs(spark, sf_dir).select("row_id", F.round(metrics.length_penalty(h, r), 6).alias("length_penalty"), F.round(metrics.coverage_penalty(h, r), 6).alias("coverage_penalty"))


@query(rf"""
WITH w AS (SELECT doc_id, {W('text')} AS w FROM documents),
g AS (SELECT doc_id, w, list_transform(range(1, greatest(len(w), 2)), lambda i: array_to_string(w[i : i + 1], chr(1))) AS b FROM w)
SELECT doc_id, round(CASE WHEN len(w) < 2 THEN 0.0 ELSE greatest(0.0, 0.6 - len(list_distinct(w)) / len(w)) * 20.0 + greatest(0.0, 0.7 - len(list_distinct(b)) / len(b)) * 20.0 END, 6) AS penalty FROM g""")
def repetition_penalty(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text")
    return d.select("doc_id", F.round(metrics.repetition_penalty(F.col("text")), 6).alias("penalty"))


@query()
def corpus_metrics(spark, sf_dir):
    return metrics.corpus_metrics(pairs(spark, sf_dir), "target_text", "source_text")


@query()
def word_edit_stats(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("row_id", similarity.word_edits("source_text", "target_text").alias("e"), F.round(similarity.gestalt_ratio("source_text", "target_text"), 6).alias("ratio")).select("row_id", "e.*", "ratio")


@query()
def consensus_choice(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return consensus.consensus(d, "conv_id", "turn", "text")


@query()
def alignment_validation(spark, sf_dir):
    p = pairs(spark, sf_dir)
    answer = F.to_json(F.struct(F.array(F.struct(F.col("source_text").alias("transliteration"), F.col("target_text").alias("translation"))).alias("sentence_pairs")))
    return alignment.validated(p.withColumn("answer", answer), "source_text", "target_text", "answer").select("row_id", "keep", "reason")


# retrieval


_BM25 = rf"""
WITH w AS (SELECT doc_id AS doc, {W('lower(text)')} AS w FROM documents), t AS (SELECT doc, len(w) AS size, unnest(w) AS term FROM w),
p AS (SELECT doc, term, count(*) AS tf, any_value(size) AS size FROM t GROUP BY doc, term),
q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({W('lower(text)')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, s), i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
b AS (SELECT query, doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / a))) AS score, sum(times * idf * tf * 2.5 / (tf + 1.5)) AS flat FROM p JOIN q USING (term) JOIN i USING (term), s GROUP BY query, doc)"""


@query(_BM25 + " SELECT query, doc, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS i FROM b) WHERE i <= 5")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25_top(docs(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"), 5).select("query", "doc", *rounded("score", digits=4))


@query(_BM25 + """, x AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) - 1 AS rank FROM b),
y AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(flat, 6) DESC, doc) - 1 AS rank FROM b),
u AS (SELECT * FROM x WHERE rank < 30 UNION ALL SELECT * FROM y WHERE rank < 30)
SELECT query, doc, round(sum(1.0 / (60 + rank + 1)), 6) AS score FROM u GROUP BY query, doc""")
def rrf_fuse(spark, sf_dir):
    """The ranking that counts a document's length and the one that does not, fused."""
    d, q = docs(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark")
    return retrieval.fused([retrieval.bm25_top(d, q, 30, b=b) for b in (0.75, 0.0)]).select("query", "doc", *rounded("score"))


@query()
def hybrid_retrieval(spark, sf_dir):
    return retrieval.hybrid(docs(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


# splits, augmentation, builders, chunks


@query()
def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(docs(spark, sf_dir, "doc_id", "source", "lang", "n_chars"), "source", "lang", ["n_chars"], 5).select("doc_id", "source", "fold")


@query()
def exact_holdout(spark, sf_dir):
    return splits.exact_split(docs(spark, sf_dir, "doc_id"), "doc_id", 0.1)


@query()
def group_split(spark, sf_dir):
    return splits.only_official_eval(splits.hash_split(docs(spark, sf_dir, "doc_id", "source"), "source", 0.2), "source", "src1")


@query()
def resampled(spark, sf_dir):
    return splits.resample(docs(spark, sf_dir, "doc_id"), "doc_id", 1.5)


@query()
def damaged_sources(spark, sf_dir):
    return augment.augmented(pairs(spark, sf_dir), "row_id", "source_text", "damage", chance=0.5).select("row_id", "augmented")


@query()
def noisy_sources(spark, sf_dir):
    return augment.augmented(pairs(spark, sf_dir), "row_id", "source_text", "ocr_noise").select("row_id", "augmented")


@query()
def denoising_set(spark, sf_dir):
    """Whole texts, as chunks that fit a model's input."""
    d = chunking.chunk_texts(pairs(spark, sf_dir), "row_id", "source_text")
    return augment.denoising_set(d.withColumn("row_id", F.concat_ws("#", "row_id", "chunk")), "row_id", "source_text")


@query()
def chunked_documents(spark, sf_dir):
    return chunking.chunk_texts(docs(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


@query()
def chunked_pairs(spark, sf_dir):
    return chunking.chunk_pairs(pairs(spark, sf_dir), "row_id", "source_text", "target_text")


@query(rf"""
WITH c AS (SELECT lang, CAST(n_chars AS VARCHAR) AS size, {SQ('text')} AS text FROM documents), r AS (SELECT lang, CAST(n_chars AS VARCHAR) AS size, {SQ('left(text, 100)')} AS text FROM documents),
cu AS (SELECT lang, size, min(text) AS chosen FROM c WHERE text <> '' AND lang <> '' GROUP BY ALL HAVING min(text) = max(text)), ru AS (SELECT lang, size, min(text) AS rejected FROM r WHERE text <> '' AND lang <> '' GROUP BY ALL HAVING min(text) = max(text))
SELECT lang, size, chosen, rejected FROM cu JOIN ru USING (lang, size) WHERE chosen <> rejected""")
def preference_pairs(spark, sf_dir):
    d = docs(spark, sf_dir, "lang", "n_chars", "text").withColumnRenamed("n_chars", "size")
    return builders.preference_pairs(d, d.withColumn("text", F.substring("text", 1, 100)), ["lang", "size"], "text")


@query(PAIRS + """, i AS (SELECT row_id, target_text AS t, (row_number() OVER (ORDER BY row_id) - 1) // 4096 AS b FROM p), n AS (SELECT *, coalesce(lead(t) OVER w, first(t) OVER w) AS one,
  CASE WHEN lead(t) OVER w IS NULL THEN nth_value(t, 2) OVER (PARTITION BY b ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE coalesce(lead(t, 2) OVER w, first(t) OVER w) END AS two FROM i WINDOW w AS (PARTITION BY b ORDER BY row_id))
SELECT row_id, t AS target_text, CASE WHEN one <> t THEN one WHEN two <> t THEN two END AS rejected FROM n""")
def shifted_negatives(spark, sf_dir):
    return builders.shifted_negatives(pairs(spark, sf_dir).select("row_id", "target_text"), "row_id", "target_text")


@query()
def weight_pairs(spark, sf_dir):
    return builders.weight_pairs(spark, 1000)


@query(PAIRS + """
SELECT row_id, '{"messages":[{"role":"system","content":"translate"},{"role":"user","content":' || CAST(to_json(source_text) AS VARCHAR) || '},{"role":"assistant","content":' || CAST(to_json(target_text) AS VARCHAR) || '}]}' AS record FROM p""")
def chat_records(spark, sf_dir):
    return pairs(spark, sf_dir).select("row_id", builders.messages("translate", F.col("source_text"), F.col("target_text")).alias("record"))


@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(unnest(regexp_split_to_array(coalesce(text, ''), '\n+')), '\s+', ' ', 'g')) AS chunk FROM documents)
SELECT DISTINCT sha256(chunk) AS fingerprint, chunk FROM c WHERE length(chunk) >= 10 AND sha256(chunk) NOT IN (SELECT sha256(chunk) FROM c WHERE doc_id % 4 = 0 AND length(chunk) >= 10)""")
def append_missing_chunks(spark, sf_dir):
    p = append.paragraphs(docs(spark, sf_dir, "doc_id", "text"))
    return append.append_missing(spark, p, p.where("doc_id % 4 = 0")).select("fingerprint", "chunk")


# records, correction, evaluation


@query("""
SELECT doc_id, CASE WHEN contains(lower(lang), 'akk') AND contains(lower(lang), 'sux') THEN 'Akkadian-Sumerian' WHEN contains(lower(lang), 'akk') THEN 'Akkadian' WHEN contains(lower(lang), 'sux') THEN 'Sumerian'
  WHEN contains(lower(lang), 'hit') THEN 'Hittite' WHEN contains(lower(lang), 'egy') THEN 'Egyptian' ELSE lower(lang) END AS language FROM documents""")
def language_codes(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "lang").select("doc_id", records.language(F.col("lang")).alias("language"))


_SETS = r"list_sort(list_distinct(regexp_extract_all({0}, '\b\d+(?:\.\d+)?(?:/\d+)?\b')))"
_AGAIN = " OR ".join(f"len(list_filter(range(1, greatest(len(w) - {2 * n} + 2, 1)), lambda i: w[i : i + {n - 1}] = w[i + {n} : i + {2 * n - 1}])) > 0" for n in (3, 4, 5))


@query(PAIRS + f""", f AS (SELECT row_id, source_text AS r, target_text AS p, {W('target_text')} AS w FROM p),
e AS (SELECT row_id, 'proper_noun' AS error, false AS hit FROM f
  UNION ALL SELECT row_id, 'number', len({_SETS.format('r')}) > 0 AND {_SETS.format('r')} <> {_SETS.format('p')} FROM f
  UNION ALL SELECT row_id, 'repeated', len(w) >= 6 AND ({_AGAIN}) FROM f
  UNION ALL SELECT row_id, 'truncated', length(p) < 0.5 * length(r) AND length(r) > 50 FROM f
  UNION ALL SELECT row_id, 'gap', contains(lower(r), '<gap>') AND (contains(p, '...') OR contains(lower(p), 'xxx')) FROM f
  UNION ALL SELECT row_id, 'tag', list_sort(list_distinct(regexp_extract_all(r, '\\[\\[[EN]\\d+\\]\\]'))) <> list_sort(list_distinct(regexp_extract_all(p, '\\[\\[[EN]\\d+\\]\\]'))) FROM f)
SELECT error, CAST(count(*) FILTER (hit) AS BIGINT) AS n, round(100.0 * count(*) FILTER (hit) / count(*), 6) AS percent, min(CASE WHEN hit THEN row_id END) AS first FROM e GROUP BY error""")
def error_summary(spark, sf_dir):
    d = evaluation.error_flags(pairs(spark, sf_dir), "target_text", "source_text")
    return evaluation.error_summary(d, "row_id").select("error", *whole("n"), *rounded("percent"), "first")


_NUMS = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?'), lambda x: lower(x)), lambda x: regexp_full_match(x, '\\d+(?:/\\d+)?(?:\\.\\d+)?') OR x IN (" + ", ".join(f"'{w}'" for w in features.NUMBER_WORDS) + "))))"


@query(PAIRS + f""", x AS (SELECT len({W('target_text')}) / greatest(len({W('source_text')}), 1) AS x, len({W('target_text')}) < 2 AS near, contains(lower(source_text), '<gap>') AS gap, {_NUMS.format('source_text')} AS nr, {_NUMS.format('target_text')} AS np FROM p)
SELECT count(*) AS n, round(avg(x), 6) AS length_ratio, round(avg(CASE WHEN x < 0.8 THEN 1.0 ELSE 0.0 END), 6) AS under, round(avg(CASE WHEN x > 1.35 THEN 1.0 ELSE 0.0 END), 6) AS "over", round(avg(CASE WHEN near THEN 1.0 ELSE 0.0 END), 6) AS near_empty,
  round(coalesce(avg(CASE WHEN nr = np THEN 1.0 ELSE 0.0 END) FILTER (len(nr) > 0), 1.0), 6) AS number_match, count(*) FILTER (gap) AS gap_cases FROM x""")
def evaluation_rates(spark, sf_dir):
    d = evaluation.rates(pairs(spark, sf_dir), "target_text", "source_text", "source_text")
    return d.select(*whole("n"), *rounded("length_ratio", "under", "over", "near_empty", "number_match"), *whole("gap_cases"))


@query()
def vocabulary_correction(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("p_name"))
    vocab = correction.vocabulary(p, "p_name", table(spark, sf_dir, "nation").select(F.lower("n_name").alias("form")), "form")
    cut = p.withColumn("p_name", F.regexp_replace("p_name", "a", "e"))
    return correction.corrected(cut, "p_partkey", "p_name", vocab).select("p_partkey", "p_name", F.size("corrections").alias("n"))


@query()
def restored_marks(spark, sf_dir):
    d = docs(spark, sf_dir, "doc_id", "text")
    older = d.withColumn("text", F.regexp_replace("text", "(?<=e)s ", "'s "))
    return correction.restore_marks(d, older, "doc_id", "text", F.col("doc_id"))


@query()
def record_texts(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("row_id", records.record_source(F.col("source_text")).alias("source_text"), records.record_target(F.col("target_text")).alias("target_text"))


@query()
def line_number_strip(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", records.without_line_numbers("text").alias("text"))
