"""Readers and sinks. Nothing is inferred: columns are strings until a contract says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.schema import no_nulls, require


def csv_strings(spark: SparkSession, path: str, columns: list[str], needed: list[str] | None = None) -> DataFrame:
    """A CSV with a header as strings without nulls; cells may hold line feeds and doubled quotes."""
    d = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    require(d, needed or columns, path)
    return no_nulls(d.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns if c in d.columns]))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines under a schema; a broken line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def has_header(first: str, source_names: set[str], target_names: set[str]) -> bool:
    """Whether a first line names a source and a target column."""
    cells = {c.strip().strip('"').lower() for c in first.split(",")}
    return bool(cells & source_names) and bool(cells & target_names)


def pairs_of(spark: SparkSession, path: str, names: list[str], source_names: set[str], target_names: set[str]) -> DataFrame:
    """JSON lines or CSV by suffix; a CSV without a header gets `names`."""
    if path.endswith((".jsonl", ".json")):
        return json_lines(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    first = spark.read.text(path).limit(1).collect()
    if first and has_header(first[0][0], source_names, target_names):
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path, multiLine=True, escape='"')


def first_filled(columns: list[str]) -> tuple[Column, Column]:
    """(text, name) of the first column that is not blank."""
    text = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in columns], F.lit(""))
    name = F.coalesce(*[F.when(F.trim(c) != "", F.lit(c)) for c in columns])
    return text, name


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; only a local session may do without one."""
    import uuid

    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/quern-{uuid.uuid4().hex}"


def files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path, name, stem, bytes) of all files below a folder."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return d.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("bytes"))


def page_rules(specs: list[str]) -> list[tuple[str, list[int]]]:
    """(file, pages) of rules like `file:1-3,5`; a rule must name positive pages in order."""
    out = []
    for spec in specs:
        name, _, ranges = spec.rpartition(":")
        pages: set[int] = set()
        for part in filter(None, (p.strip() for p in ranges.split(","))):
            lo, _, hi = part.partition("-")
            if not (lo.isdigit() and (not hi or hi.isdigit()) and 1 <= int(lo) <= int(hi or lo)):
                raise ValueError(f"no page range: {part!r} in {spec!r}")
            pages |= set(range(int(lo), int(hi or lo) + 1))
        if not name or not pages:
            raise ValueError(f"no page rule: {spec!r}")
        out.append((name, sorted(pages)))
    return out


def selected_pages(found: DataFrame, rules: list[tuple[str, list[int]]], total: str = "pages") -> DataFrame:
    """Adds `selected`: the pages of all rules that match a file by name, stem, path or its end; null where none does."""
    arrays = [F.when((F.col("name") == n) | (F.col("stem") == n) | (F.col("path") == n) | F.col("path").endswith("/" + n), F.array(*map(F.lit, p))) for n, p in rules]
    hit = F.array_compact(F.array(*arrays)) if arrays else F.array().cast("array<array<int>>")
    pages = F.array_sort(F.array_distinct(F.filter(F.flatten(hit), lambda x: x <= F.col(total))))
    return found.withColumn("selected", F.when(F.size(hit) > 0, pages))


def atf_records(lines: DataFrame, order: str = "line_no", text: str = "value") -> DataFrame:
    """Records of a line-oriented text file: id, language, source and translation lines joined in order.

    A line `&P...` opens a record; a running count of them is every line's
    record, within the file.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col(text).rlike(r"^&P\d+")
    d = lines.withColumn("__r", F.sum(F.when(opens, 1).otherwise(0)).over(w)).where("__r > 0")

    def joined(pattern: str) -> Column:
        hit = F.regexp_extract(F.col(text), pattern, 1)
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(text).rlike(pattern), F.struct(F.col(order).alias("o"), hit.alias("t"))))), lambda x: x["t"]), " ")

    g = d.groupBy("file", "__r").agg(F.max(F.when(opens, F.regexp_extract(text, r"^&(P\d+)", 1))).alias("id"), joined(r"^#atf:\s*lang\s+(\S+)").alias("language"), joined(r"^\d+'?\.\s+(.*)$").alias("source_text"), joined(r"^#tr\.en:\s*(.*)$").alias("target_text"))
    return g.drop("__r")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one file only where a consumer needs it."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_split(df: DataFrame, path: str, *by: str) -> None:
    """One folder for each language and variety."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def report(counts: DataFrame) -> str:
    """A table of counters as JSON; it has one row a counter."""
    import json

    return json.dumps([r.asDict() for r in counts.collect()], ensure_ascii=False, indent=2, default=str)


def enriched(df: DataFrame, fn, schema) -> DataFrame:
    """Rows through an external client, a batch at a time; `fn` makes the client once a task. Offline, a client that changes nothing."""
    return df.mapInPandas(fn, schema)
