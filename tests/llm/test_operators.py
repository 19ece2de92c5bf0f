"""The operators as Spark runs them: brute force, round trips, held-out accuracy, SQL, and defined results for odd input."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import decontamination, html_extraction, language_id, license_scan, packing, pii, quality_crf, quality_rules, simhash, suffix_dedup
from quern.llm.graph import components
from quern.llm.queries import ORACLE, QUERIES

import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PASSAGE = "an exact passage of words that stands in several documents and is well over fifty bytes long"
LONG = "word after word in a very long text, " * 20_000
ODD = [
    (None, PASSAGE, "en", 1),
    (1, None, None, None),
    (2, "", "en", 1),
    (3, " \n\t ", "en", 1),
    (4, PASSAGE + " first", "en", 1),
    (5, "second " + PASSAGE, "en", 1),
    (5, "second " + PASSAGE, "en", 1),
    (6, PASSAGE + " first", "en", 1),
    (7, "日本語 \U0001f600 é ß", "en", 1),
    (8, LONG, "en", 1),
    (9, "x", None, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with the results'."""
    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string, n_words long")
    extra = {c: F.lit("clash") for c in ("score", "kept", "component_id", "fp", "start", "length", "labels", "n_pii", "row", "block", "digest", "key", "node", "u", "v", "t", "w", "g", "p", "lines", "base_failed")}
    return d.withColumns(extra).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def test_names():
    assert [f"op{i}" for i in range(1, 11)] == sorted({n.split("_")[0] for n in QUERIES}, key=lambda x: int(x[2:]))


# 1


def test_language(spark, sf, docs):
    got = QUERIES["op1_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_odd(odd, empty):
    sample = language_id.sample(odd, "lang", "doc_id", "text", F.lit(True))
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(odd, sample).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (7, "en"), (8, "en")} <= got
    assert language_id.predict(odd, {}).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert language_id.sample(empty, "lang", "doc_id", "text", F.lit(True)) == {} and language_id.predict(empty, sample).count() == 0


def test_language_of_long_rows_is_learned(spark):
    """A language with rows of any length is learned from, by the first characters of each."""
    rows_ = [(i, "příliš žluťoučký kůň úpěl ďábelské ódy " * 400, "cs") for i in range(20)] + [(100 + i, "the cat sat on the mat and the hat", "en") for i in range(20)]
    d = spark.createDataFrame([*rows_, *rows_[:3]], "doc_id long, text string, lang string").repartition(5)
    texts = language_id.sample(d, "lang", "doc_id", "text", F.lit(True), max_rows=8, max_chars=4000)
    assert sorted(texts) == ["cs", "en"] and all(len(t) <= 4100 for t in texts.values()) and texts == language_id.sample(d.repartition(2), "lang", "doc_id", "text", F.lit(True), max_rows=8, max_chars=4000)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(d, texts).collect()}
    assert got == {i: lang for i, _, lang in rows_}


# 2


def packed(found):
    """Checks the pieces, and gives each document's number of tokens."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) and len(r["ids"]) == r["length"]
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    filled = sum(r["length"] for r in found)
    padded = sum(n if n & (n - 1) == 0 else 1024 for n in (sum(r["length"] for r in own) for own in by_seq.values()))
    assert filled == padded
    return by_doc


def test_packing(docs, texts):
    by_doc = packed(packing.pack(docs, TOKENIZER, with_ids=True).collect())
    slow = Tokenizer.from_file(TOKENIZER)
    for i, t in texts:
        own = sorted(by_doc[i], key=lambda r: r["start"])
        ids = [x for r in own for x in r["ids"]]
        assert ids == slow.encode(t, add_special_tokens=False).ids + [0] and {r["doc_tokens"] for r in own} == {len(ids)}


def test_packing_special_tokens(spark):
    """A special token's string in a text is that token, as tokenizers has it; on demand it is ordinary text."""
    given = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|><|endoftext|>  y <|endoftext"), (4, "plain")]
    d = spark.createDataFrame(given, "doc_id long, text string")
    plain = Tokenizer.from_file(TOKENIZER)
    for specials in (False, True):
        plain.encode_special_tokens = specials
        got = {r["doc_id"]: r["ids"] for r in packing.pack(d, TOKENIZER, with_ids=True, plain_specials=specials).collect()}
        assert {r["doc_id"] for r in packing.pack(d, TOKENIZER).collect()} == {1, 2, 3, 4}
        for i, t in given:
            want = plain.encode(t, add_special_tokens=False).ids + [0]
            own = sorted((r["start"], r["ids"]) for r in packing.pack(d.where(F.col("doc_id") == i), TOKENIZER, with_ids=True, plain_specials=specials).collect())
            assert [x for _, ids in own for x in ids] == want and got[i]


def test_packing_odd(odd, empty):
    by_doc = packed(packing.pack(odd, TOKENIZER, with_ids=True).collect())
    assert [r["length"] for i in (1, 2) for r in by_doc[i]] == [1, 1]
    assert sum(r["length"] for r in by_doc[5]) == 2 * by_doc[5][0]["doc_tokens"]
    assert packing.pack(empty, TOKENIZER).count() == 0


# 3


def without_repeats(docs, n=50):
    first = {}
    for i, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            first.setdefault(b[p : p + n], i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - n + 1):
                if first[b[p : p + n]] < i:
                    gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block_bytes", "fan", "depth"), [(1 << 30, 1024, 1), (60_000, 1024, 1), (60_000, 3, 2), (30_000, 2, 5)])
def test_suffix_dedup(spark, docs, texts, block_bytes, fan, depth):
    size = sum(len(t.encode()) for _, t in texts if t)
    assert suffix_dedup.Levels(max(1, -(-size // block_bytes)), fan, 44).depth == depth
    tables = spark.sql("SHOW TABLES").count()
    assert sorted((tuple(r) for r in suffix_dedup.dedup(docs, block_bytes=block_bytes, fan=fan).collect()), key=str) == without_repeats(texts)
    assert spark.sql("SHOW TABLES").count() == tables


def test_suffix_hot_passage(spark):
    """One passage in every document, and groups of copies: no level sends it up more than once a group."""
    given = [(i, f"{i} start {PASSAGE} end {i % 3}" if i % 4 else "copy " + PASSAGE) for i in range(60)]
    d = spark.createDataFrame(given, "doc_id long, text string")
    got = suffix_dedup.dedup(d, block_bytes=600, fan=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == without_repeats(given)


def test_suffix_dedup_odd(spark, odd, empty):
    given = [(r[0], r[1]) for r in ODD] + [(10, "ab\0cd" * 30), (11, "y" + "ab\0cd" * 30 + "\0"), (12, "a" * 400), (13, "b" + "a" * 100), (14, PASSAGE[:49]), (15, PASSAGE[:50])]
    d = spark.createDataFrame(given, "doc_id long, text string").withColumn("block", F.lit("clash"))
    got = suffix_dedup.dedup(d, block_bytes=100_000, fan=2, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == without_repeats(given)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert suffix_dedup.dedup(empty).count() == 0


# 4


def test_rules_odd(odd, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(odd).collect()}
    assert (got[1]["n_words"], got[1]["base_failed"], got[1]["kept"]) == (0, True, False)
    assert got[8]["n_words"] == 160_000 and got[8]["base_failed"] and got[8]["n_repeat_words"] == 160_000
    assert got[4]["failed_rules"] == [] and got[4]["base_failed"] and got[7]["failed_rules"] == ["mean_word_length", "stop_words"] and quality_rules.judge(empty).count() == 0


def test_rules_reject(spark):
    good = " ".join(f"the word{i} thing{i} of item{i}" for i in range(30))
    cases = {"good": good, "symbols": " ".join(f"the wo{i}## thing{i}$$ of item{i}" for i in range(40)), "no_stop": " ".join(f"word{i}" for i in range(80)), "upper": good.upper(), "lines": "\n".join(f"the w{i} x{i} of y{i}" for i in range(30)) + "\nsame" * 40}
    d = spark.createDataFrame(list(cases.items()), "doc_id string, text string")
    got = {r["doc_id"]: (r["kept"], r["failed_rules"]) for r in quality_rules.judge(d).collect()}
    assert got["good"] == (True, []) and got["symbols"][1] == ["symbols_per_word"] and got["no_stop"][1] == ["stop_words"] and got["upper"][1] == ["upper_case"]
    assert "duplicate_lines" in got["lines"][1]


def test_rules_stay_native(spark, odd):
    plan = quality_rules.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 5


def test_decontamination_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "."), (4, "second an")], "item_id long, text string")
    found = decontamination.decided(decontamination.hits(odd, bench))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in found.collect()}
    n = len(PASSAGE.split())
    assert got[1] == got[2] == (0, 0, 0, False) and got[4] == (n + 1, n, 1, True) and got[5] == (n + 1, n + 1, 2, True) and got[7][1] == 0
    pieces, blocks = decontamination.blocks_of(bench, "item_id", "text", 13, 1000)
    assert blocks > 1 and pieces.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).where("13 * n > 4000").count() == 0
    many = decontamination.decided(decontamination.hits(odd, bench, max_pattern_bytes=100))
    assert sorted(map(str, found.select(*many.columns[:-1]).drop("digest").collect())) == sorted(map(str, many.select(*many.columns[:-1]).drop("digest").collect()))
    spans = {r["doc_id"]: r["spans"] for r in decontamination.spans(decontamination.hits(odd, bench, with_text=True)).collect()}
    assert PASSAGE == (PASSAGE + " first")[spans[4][0]["start"] : spans[4][0]["end"]]
    assert decontamination.hits(odd, bench.limit(0)).where("size(hits) > 0").count() == 0 and decontamination.hits(empty, bench).count() == 0
    kept = decontamination.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 7, 8, 9}
    assert {r["doc_id"] for r in decontamination.remove_contaminated(odd, bench, max_pattern_bytes=100).collect()} == {1, 2, 3, 7, 8, 9}


def test_decontamination_long_item(spark):
    """An item longer than the bound is cut into pieces that hold all its windows."""
    words = [f"w{i}" for i in range(400)]
    bench = spark.createDataFrame([(1, ", ".join(words)), (2, "W7 w8")], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(["x", *words[i : i + 13 + i % 4], "y"])) for i in range(380)] + [(999, "w1 w3 w5"), (1000, None)], "doc_id long, text string")
    one, many = (sorted(map(str, decontamination.decided(decontamination.hits(d, bench, max_pattern_bytes=size)).drop("digest").collect())) for size in (1 << 20, 20_000))
    assert one == many and sum("contaminated=True" in r for r in one) == 380


def test_decontamination_by_row(spark, duck):
    """Null and shared ids of documents, and null ids of items, at any number of blocks."""
    given = [(None, PASSAGE), (None, "a clean text of its own"), (1, PASSAGE), (1, "another clean text"), (2, None), (None, None), (3, PASSAGE), (3, PASSAGE)]
    d = spark.createDataFrame(given, "doc_id long, text string")
    bench = spark.createDataFrame([(None, PASSAGE), (None, "second an"), (7, "some other words")], "item_id long, text string")
    want = sorted([r for r in given if r[1] != PASSAGE], key=str)
    for size in (64 << 20, 100):
        assert sorted(map(tuple, decontamination.remove_contaminated(d, bench, max_pattern_bytes=size).collect()), key=str) == want
        found = decontamination.decided(decontamination.hits(d, bench, max_pattern_bytes=size)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").toPandas()
        con = duck.cursor()
        con.register("documents", d.toPandas().astype({"doc_id": "Int64"}))
        con.register("benchmark", bench.toPandas().astype({"item_id": "Int64"}))
        sql = ORACLE["op5_decontamination"].replace("FROM documents", "FROM temp.documents").replace("FROM benchmark", "FROM temp.benchmark")
        assert rows(found.astype({"doc_id": "Int64"}), list(found.columns)) == rows(con.execute(sql).df().astype({"doc_id": "Int64"}), list(found.columns))


# 6


def linked(prints):
    """(doc, component) by comparing every pair of distinct fingerprints."""
    ids = defaultdict(list)
    for i, fp in prints:
        ids[fp].append(i)
    root = {fp: fp for fp in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(ids)
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for fp in fps:
        least[find(fp)] += [i for i in ids[fp] if i is not None]
    return sorted(((i, min(least[find(fp)], default=None)) for i, fp in prints), key=str)


def test_simhash(docs, texts):
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == linked([(i, simhash.fingerprint(t)) for i, t in texts])
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == {i: simhash.fingerprint(t) for i, t in texts}


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == linked([(r[0], simhash.fingerprint(r[1])) for r in ODD])
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicate(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and sorted(ids, key=str) == sorted({c for _, c in linked([(r[0], simhash.fingerprint(r[1])) for r in ODD])}, key=str)


def test_deduplicate_by_row(spark):
    """One row of each component, whether ids are null or shared."""
    a, b, c, e = (" ".join(f"{w}{i}" for i in range(40)) for w in ("ab", "cd", "ef", "gh"))
    given = [(None, a, 1), (None, b, 2), (None, b, 3), (1, a, 4), (5, b, 5), (5, c, 6), (7, c, 7), (8, e, 8), (8, "x " + b, 9), (None, "only null", 10), (None, "only nil", 11), (8, None, 12), (9, "", 13)]
    d = spark.createDataFrame(given, "doc_id long, text string, n long").repartition(3)
    print_of = {n: simhash.fingerprint(t) for _, t, n in given}
    parts = defaultdict(list)
    for i, t, n in given:
        root = min(fp for fp in set(print_of.values()) if (fp ^ print_of[n]).bit_count() <= 3)
        parts[root].append((i is None, i or 0, hashlib.md5(t.encode()).digest() if t is not None else b"", i, t))
    assert len(parts) >= 6
    got = [(r["doc_id"], r["text"]) for r in simhash.deduplicate(d).collect()]
    assert sorted(got, key=str) == sorted((min(p)[3:] for p in parts.values()), key=str)


@pytest.mark.parametrize("hot", [1, 40])
def test_hot_anchors_lose_no_link(spark, hot):
    """Fingerprints that share a half, with near ones; the groups of crowded anchors are dealt before the exchange."""
    rng = random.Random(4)
    half = rng.getrandbits(32)
    fps = {half | rng.getrandbits(32) << 32 for _ in range(300)} | {rng.getrandbits(64) for _ in range(20)}
    fps |= {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for x in fps}
    d = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    got = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(d, hot=hot).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    every = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]

    def parts(edges):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in fps}

    assert parts(got) == parts(every)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 40)]
    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)} | {(200 + i, 200) for i in range(40)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7


def test_pii(docs, odd, empty):
    got = pii.findings(docs, b"key")
    again = pii.replace(docs, b"key")
    assert again.columns == docs.columns
    a = {r["doc_id"]: r for r in got.collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sum(r["n_pii"] for r in a.values()) > 0
    for r in again.collect():
        assert r["text"] == a[r["doc_id"]]["text"]
        for s, k in zip(a[r["doc_id"]]["spans"], a[r["doc_id"]]["kinds"], strict=True):
            value = before[r["doc_id"]][s["start"] : s["end"]]
            assert pii.pseudonymise(value if k != "credential" else f'token = "{value}"', b"key")[0] != value
    seen = {}  # equal values get equal pseudonyms, and others get others
    for i, t in before.items():
        found = pii._find(t or "", b"key")
        assert [k for _, _, k, _ in found] == a[i]["kinds"] and [(x, y) for x, y, _, _ in found] == [tuple(x) for x in a[i]["spans"]]
        out, at = "", 0
        for x, y, k, new in found:
            assert seen.setdefault((k, t[x:y]), new) == new
            out, at = out + t[at:x] + new, y
        assert a[i]["text"] == (out + t[at:] if t else t)
    assert len({(k, new) for (k, _), new in seen.items()}) == len(seen)
    got = {r["doc_id"]: (r["text"], r["n_pii"]) for r in pii.findings(odd, b"key").collect()}
    assert got[1] == (None, 0) and got[2] == ("", 0) and got[8] == (LONG, 0) and pii.findings(empty, b"key").count() == 0


def test_pii_finds_what_brute_force_finds(spark, sf, docs):
    """Dates, addresses and numbers of fixed shapes, looked for at every place of every text by other means."""
    import datetime

    digits = set("0123456789")

    def shape(s):
        return "".join("9" if c in digits else c for c in s)

    def day(s):
        for style in ("%Y{0}%m{0}%d", "%d{0}%m{0}%Y", "%m{0}%d{0}%Y"):
            for sep in "-/.":
                try:
                    if 1900 <= datetime.datetime.strptime(s, style.format(sep)).year < 2100:
                        return True
                except ValueError:
                    pass
        return False

    days = {x.replace("-", sep) for x in ("9999-99-99", "99-99-9999") for sep in "-/."}
    want, got = set(), set()
    for r in pii.findings(docs, b"key").collect():
        got |= {(r["doc_id"], s["start"], s["end"], k) for s, k in zip(r["spans"], r["kinds"], strict=True) if k in ("date", "ssn", "ip")}
    texts_ = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {x for x in got if x[3] != "date" or shape(texts_[x[0]][x[1] : x[2]]) in days}
    for i, t in texts_.items():
        for p in range(len(t)):
            if t[p] not in digits:
                continue
            before, ten, eleven = t[p - 1 : p] if p else "", t[p : p + 10], t[p : p + 11]
            after = t[p + 10 : p + 12]
            if shape(ten) in days and before not in digits | set("./-") and after[:1] not in digits and not (after[:1] in ("-", "/", ".") and after[1:] in digits) and day(ten):
                want.add((i, p, p + 10, "date"))
            if shape(eleven) == "999-99-9999" and before not in digits | {"-"} and t[p + 11 : p + 12] not in digits | {"-"} and eleven[:3] not in ("000", "666") and eleven[0] != "9" and eleven[4:6] != "00" and eleven[7:] != "0000":
                want.add((i, p, p + 11, "ssn"))
            if before not in digits | {"."}:
                q = p
                while q < len(t) and t[q] in digits | {"."}:
                    q += 1
                parts = t[p:q].rstrip(".").split(".")
                if len(parts) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) < 256 and str(int(x)) == x for x in parts):
                    want.add((i, p, p + len(".".join(parts)), "ip"))
    assert want and got == want


def test_pii_keys(spark):
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 32
    spark.conf.set("quern.pii.key", "k" * 100)
    try:
        a = pii.session_key(spark)
        spark.conf.set("quern.pii.key", "k" * 99 + "x")
        assert a != pii.session_key(spark)
        spark.conf.set("quern.pii.key", "")
        with pytest.raises(ValueError):
            pii.session_key(spark)
    finally:
        spark.conf.unset("quern.pii.key")


# 8


def test_licenses(docs, odd, empty):
    for r in license_scan.licenses(docs).where("n_base > 0").collect():
        assert r["base_labels"] and set(r["base_labels"]) <= set(r["labels"]) and 0 < r["score"] <= 1
    got = {r["doc_id"]: (r["n_words"], r["labels"], r["score"]) for r in license_scan.licenses(odd).collect()}
    assert got[1] == got[2] == (0, [], 0.0) and got[8] == (160_000, [], 0.0) and license_scan.licenses(empty).count() == 0


def test_license_base(docs, texts):
    import re

    for r in license_scan.licenses(docs).collect():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), dict(texts)[r["doc_id"]]))
        at = [(i, label) for p, label in license_scan.BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(ws), len(at)) and r["base_labels"] == sorted({x for _, x in at})
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))


def test_license_results(spark, docs, texts):
    """Labels, score and detections by definition: every rule at every place, then suppression by comparing all pairs."""
    import re

    rules = sorted(license_scan.build_rules(), key=lambda r: r.priority)
    probes = [(-1, "GNU General Public License version 3 or later, MIT License; Apache License, Version 2.0 and the Apache License"), (-2, "licensed under the apache license version 2 0 " * 3), (-3, "x license mit licensed submit license")]
    some = [x for x in texts if x[1] and "icen" in x[1].lower()][:40] + probes
    d = spark.createDataFrame(some, "doc_id long, text string")
    for r in license_scan.licenses(d).collect():
        t = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), dict(some)[r["doc_id"]])))
        found = [(x.priority, m.start() - m.end(), m.start(), i, m.end(), x) for i, x in enumerate(rules) for m in re.finditer(rf"(?<!\S){x.pattern}(?!\S)", t)]
        kept = []
        for x in sorted(found, key=lambda x: x[:4]):
            if not any(a <= x[2] and x[4] <= b for a, b, _ in kept):
                kept.append((x[2], x[4], x[5]))
        spans = sorted((x.label, t[:a].count(" "), t[:b].count(" ")) for a, b, x in kept)
        assert sorted((x["label"], x["first_word"], x["last_word"]) for x in r["detections"]) == spans
        assert r["labels"] == sorted({x.label for _, _, x in kept} | set(r["base_labels"]))
        assert r["score"] == max([x.score for _, _, x in kept] + [0.8] * bool(r["base_labels"]), default=0.0)


# 9


def test_pages(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op9_html_extraction"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pages_odd(spark):
    given = [(None, None, None), (1, "u", ""), (2, None, "<p>" + "long text, " * 50_000), (2, None, "<div>" * 3000 + "deep" + "</div>" * 3000), (3, "u", "<<<>>><p")]
    d = spark.createDataFrame(given, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["n_chars"]) for r in html_extraction.main_text(d).collect()]
    assert sorted(got, key=str) == [(1, 0), (2, 4), (2, 549_999), (3, 6), (None, 0)] and html_extraction.main_text(d.limit(0)).count() == 0


# 10


def test_quality(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op10_quality_crf"](spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.85 and got["score"].between(0, 1).all()


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, 1), (8, 0), (99, 1), (None, 1), (5, None)], "doc_id long, quality int")
    crf = quality_crf.learn(odd, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality_crf.score(odd, crf).collect()}
    assert len(got) == 10 and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2] == got[3]
    none = quality_crf.learn(odd, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality_crf.score(odd, none).collect()} == {0.5} and quality_crf.score(empty, crf).count() == 0


# pipeline


def test_pipeline(spark, sf, docs):
    import corpus_pipeline
    from quern.llm.common import persisted, table

    assert len(corpus_pipeline.STAGES) == 5
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert kept.columns == names
    want = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    kept = persisted(kept)
    assert {r["doc_id"] for r in kept.collect()} == want
    one = persisted(corpus_pipeline.STAGES[1][1](spark, kept, sf))
    firsts = {c for _, c in linked([(r["doc_id"], simhash.fingerprint(r["text"])) for r in kept.collect()])}
    assert one.columns == names and sorted(r["doc_id"] for r in one.collect()) == sorted(firsts)
    clean = persisted(corpus_pipeline.STAGES[2][1](spark, one, sf))
    bad = {r["doc_id"] for r in decontamination.decided(decontamination.hits(one, table(spark, sf, "benchmark"))).where("contaminated").collect()}
    assert clean.columns == names and {r["doc_id"] for r in clean.collect()} == firsts - bad
    safe = persisted(corpus_pipeline.STAGES[3][1](spark, clean, sf))
    assert safe.columns == names and safe.count() == clean.count()
    by_doc = packed(corpus_pipeline.STAGES[4][1](spark, safe, sf).collect())
    assert set(by_doc) == {r["doc_id"] for r in safe.collect()}
    assert corpus_pipeline.run(spark, sf).count() == sum(map(len, by_doc.values()))


def test_stages_with_extra_columns(spark, sf):
    import corpus_pipeline

    d = spark.createDataFrame([tuple([*r, "x"]) for r in ODD], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("kept", T.StringType())]))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, d, sf).columns == d.columns
    got = {name: [tuple(r) for r in stage(spark, d, sf).collect()] for name, stage in corpus_pipeline.STAGES[:4]}
    given = [tuple(r) for r in d.collect()]
    assert got["quality_rules"] == [] and sorted(map(str, got["decontamination"])) == sorted(map(str, given)) == sorted(map(str, got["pii"]))
    roots = {c for _, c in linked([(r[0], simhash.fingerprint(r[1])) for r in ODD])}
    assert sorted((r[0] for r in got["simhash"]), key=str) == sorted(roots, key=str)
    odd_names = d.withColumnsRenamed({"n_words": "row_id", "kept": "row_digest"}).withColumn("bad", F.lit(1)).withColumn("__id", F.lit(2))
    assert simhash.deduplicate(odd_names).count() == len(roots) and simhash.deduplicate(odd_names).columns == odd_names.columns
