"""Keyed joins of corpus versions. All are equi-joins that AQE may turn into broadcasts or split where a key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.schema import unused


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key.

    Spark cuts each task's rows to the first of each key before the exchange,
    so a hot key sends one row a task. A hash goes before the keys, so that
    long texts are compared only where they are equal.
    """
    w, i = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order), unused("row_in_key", df)
    return df.withColumn(i, F.row_number().over(w)).where(F.col(i) == 1).drop(i)


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_by(df, keys, [c.desc() for c in order])


def unambiguous(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Keys with one distinct text, and that text: ambiguous keys go whole. One pass, with partial sums."""
    most = unused("greatest_text", df)
    d = df.groupBy(*keys).agg(F.min(text).alias(text), F.max(text).alias(most))
    return d.where(F.col(text) == F.col(most)).drop(most)


def missing_from(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other table lacks."""
    names = {k: unused(f"other_{k}", df) for k in keys}
    o = other.select(*[F.col(k).alias(n) for k, n in names.items()]).distinct()
    return df.join(o, [F.col(k) == F.col(n) for k, n in names.items()], "left_anti")


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows, and the new ones with keys of their own."""
    return old.unionByName(missing_from(new, old, keys), allowMissingColumns=True)


def replaced_by_parts(df: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Documents that have been split by hand give way to their parts."""
    return missing_from(df, parts, [key]).unionByName(parts, allowMissingColumns=True)


def without_leakage(evaluation: DataFrame, train: DataFrame, text: str) -> DataFrame:
    """Evaluation rows whose text no training row has."""
    return missing_from(evaluation, train, [text])


def override(base: DataFrame, review: DataFrame, key: str, columns: list[str], order: Column) -> DataFrame:
    """Reviewed values replace the base's: the first review of a key counts, blanks do not, unknown keys are ignored. Adds `changed`."""
    at, own, new = unused("review_order", review), unused("review_key", base), {c: unused(f"reviewed_{c}", base) for c in columns}
    r = first_by(review.select(key, *columns, order.alias(at)), [key], [F.col(at)])
    r = r.select(F.col(key).alias(own), *[F.when(F.trim(c) != "", F.col(c)).alias(n) for c, n in new.items()])
    d = base.join(r, F.col(key) == F.col(own), "left")
    changed = F.lit(False)
    for c, n in new.items():
        changed = changed | F.coalesce(F.col(n) != F.col(c), F.lit(False))
    d = d.withColumn("changed", changed).withColumns({c: F.coalesce(n, c) for c, n in new.items()})
    return d.drop(own, *new.values())


def _with_older(current: DataFrame, older: DataFrame, key: str, text: str, order: Column) -> tuple[DataFrame, str, str]:
    """The rows with the last older text of their key, and the names of the two columns that were added."""
    own, old, at = unused("older_key", current), unused("older_text", current), unused("older_order", older)
    o = last_by(older.select(key, text, order.alias(at)), [key], [F.col(at)]).select(F.col(key).alias(own), F.col(text).alias(old))
    return current.join(o, F.col(key) == F.col(own), "left"), own, old


def backfill(current: DataFrame, older: DataFrame, key: str, text: str, order: Column) -> DataFrame:
    """Cut texts get the older version's: adds `backfilled`. The last older row of a key counts.

    A text is cut if it ends in dots or a gap, is short while the older has 40
    characters more, ends in a slash or hyphen, or is the older's beginning
    with 20 characters missing.
    """
    d, own, older_text = _with_older(current, older, key, text, order)
    now, old = F.col(text), F.coalesce(older_text, F.lit(""))
    spaces = F.length(now) - F.length(F.replace(now, F.lit(" "), F.lit("")))
    a, b = F.trim(now), F.trim(old)
    begins = (F.length(a) >= 12) & b.startswith(a) & (F.length(b) > F.length(a) + 20)
    cut = (
        ((now.endswith("...") | now.endswith("<gap>")) & (F.length(old) > F.length(now)))
        | ((spaces < 8) & (F.length(old) > F.length(now) + 40))
        | F.rtrim(now).endswith("/")
        | F.rtrim(now).endswith("-")
        | begins
    )
    cut = F.coalesce((old != "") & cut, F.lit(False))
    return d.withColumn("backfilled", cut).withColumn(text, F.when(cut, old).otherwise(now)).drop(own, older_text)


def restore_longer(current: DataFrame, older: DataFrame, key: str, text: str, order: Column, by: int = 100) -> DataFrame:
    """Texts whose older version is longer by more than `by` characters get it; adds `restored`."""
    d, own, old = _with_older(current, older, key, text, order)
    longer = F.coalesce(F.length(old) > F.length(text) + by, F.lit(False))
    return d.withColumn("restored", longer).withColumn(text, F.when(longer, F.col(old)).otherwise(F.col(text))).drop(own, old)


def two_hop(forms: DataFrame, entries: DataFrame, form: str, word: str, definition: str, guide: str) -> DataFrame:
    """form -> word -> definition, and the guide word where the entry lacks one."""
    e = entries.select(F.col(word).alias("__word"), F.col(definition).alias("__def"))
    d = forms.join(e, F.col(word) == F.col("__word"), "left")
    return d.select(form, F.coalesce("__def", guide).alias("gloss")).where("gloss IS NOT NULL")


def complete(ids: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each id; those without a result get an empty text."""
    own, given = unused("found_key", ids), unused("found_text", ids)
    f = found.select(F.col(key).alias(own), F.col(text).alias(given))
    return ids.join(f, F.col(key) == F.col(own), "left").select(*ids.columns, F.coalesce(given, F.lit("")).alias(text))


def nearest_word(tokens: DataFrame, vocabulary: DataFrame, token: str = "token", word: str = "word", freq: str = "freq", most: int = 2) -> DataFrame:
    """For each token the vocabulary word within `most` edits: fewest edits, then the most frequent, then the first in order.

    An edit changes a word's signature of deleted characters in a bounded way:
    two words within k edits share one of their variants with up to k
    characters deleted. Variants are joined by equality, so no token meets the
    whole vocabulary, and the distance is taken for those pairs only.
    """

    def variants(c: Column) -> Column:
        out = F.array(c)
        for _ in range(most):
            cut = F.flatten(F.transform(out, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x))))))
            out = F.array_distinct(F.concat(out, cut))
        return out

    t = tokens.select(F.col(token).alias("t")).distinct().withColumn("v", F.explode(variants(F.col("t"))))
    w = vocabulary.select(F.col(word).alias("w"), F.col(freq).alias("f")).withColumn("v", F.explode(variants(F.col("w"))))
    pairs = t.join(w, "v").select("t", "w", "f").distinct().withColumn("d", F.levenshtein("t", "w")).where(F.col("d") <= most)
    best = pairs.groupBy("t").agg(F.min_by(F.struct("w", "d", "f"), F.struct("d", -F.col("f"), "w")).alias("b"))
    return best.select(F.col("t").alias(token), F.col("b.w").alias(word), F.col("b.d").cast("int").alias("distance"), F.col("b.f").alias(freq))


def previous_in_group(df: DataFrame, group: str, order: list[str], text: str, max_bytes: int = 150) -> DataFrame:
    """Adds `context`: the group's row before, cut to whole characters within `max_bytes` bytes."""
    w = Window.partitionBy(group).orderBy(*order)
    before = F.coalesce(F.lag(text).over(w), F.lit(""))
    d = df.withColumn("context", before)
    # the longest prefix of whole characters that fits: bytes that follow a cut character are continuation bytes
    cut = F.expr(f"if(octet_length(context) <= {max_bytes}, context, decode(substring(encode(context, 'UTF-8'), 1, aggregate(sequence({max_bytes}, {max_bytes} - 3), {max_bytes}, (a, i) -> if(a = i and (ascii(decode(substring(encode(context, 'UTF-8'), i + 1, 1), 'ISO-8859-1')) between 128 and 191), i - 1, a))), 'UTF-8'))")
    return d.withColumn("context", cut)


def attached(df: DataFrame, meta: DataFrame, key: str, columns: list[str], order: Column) -> DataFrame:
    """The rows with columns of a table of what is known of them: its first row of a key counts; null for unknown keys."""
    first = first_by(meta.select(F.col(key).alias("attached_key"), *columns, order.alias("attached_order")), ["attached_key"], [F.col("attached_order")])
    return df.join(first.drop("attached_order"), F.col(key).eqNullSafe(F.col("attached_key")), "left").drop("attached_key")


def new_pairs(df: DataFrame, known: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """Pairs whose normalised form the known table lacks, each once, the first in order."""
    from quern.functions.text import compare_form

    def keyed(d: DataFrame) -> DataFrame:
        return d.withColumn("pair_form", F.concat_ws("\u0001", compare_form(F.col(source)), compare_form(F.col(target))))

    return first_by(missing_from(keyed(df), keyed(known), ["pair_form"]), ["pair_form"], [F.col(order)]).drop("pair_form")


def aligned_slices(sentences: DataFrame, texts: DataFrame, key: str, order: str, start: str, tokens: str) -> DataFrame:
    """(key, order, start, part): the tokens of a text from a sentence's start to the next one's; sentences of unknown texts are left out.

    Starts count from 1; a text's last sentence ends with it.
    """
    from quern.operators.windows import next_start

    t = texts.select(F.col(key).alias("slice_key"), tokens)
    d = sentences.join(t, F.col(key) == F.col("slice_key"))
    d = next_start(d, key, order, start, F.size(tokens) + 1)
    size = F.greatest(F.least("stop", F.size(tokens) + 1) - F.col(start), F.lit(0))
    return d.select(key, order, start, F.array_join(F.slice(tokens, F.greatest(F.col(start), F.lit(1)), size), " ").alias("part"))
