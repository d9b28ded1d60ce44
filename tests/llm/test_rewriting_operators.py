"""Fill-in-middle, line dedup and importance resampling against brute force, with odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

from paneloom.llm import fill_in_middle as FIM
from paneloom.llm import line_dedup as LD
from paneloom.llm import resampling as RS
from paneloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_line_dedup"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert got.columns == want.columns
    assert rows(got) == collections.Counter(want.fetchall())


# 11 --------------------------------------------------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim(doc_id, text, percent=50):
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("percent", [50, 100])
def test_fill_in_middle_is_findall(spark, odd_docs, percent):
    more = [(100 + i, x, "en", "a", 1) for i, x in enumerate(["<P> a b", "x<S", "a <M", "<S", "   a b ", " \n\t", "P> <", "\U0001f642 " * 9, "<<P", "a", ">"] * 6)]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema))
    made = FIM.fill_in_middle(docs, percent=percent)
    assert made.columns == [*docs.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    want = collections.Counter((r.doc_id, *fim(r.doc_id, r.text or "", percent)) for r in docs.collect())
    assert rows(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) == want
    back = made.select("text", FIM.restored(made.output, made.form).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)
    if percent == 100:
        assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "spm", "psm"}


def test_fill_in_middle_clashing_columns_and_no_rows(spark, no_docs):
    docs = spark.createDataFrame([(7, "a b c", "mine", 3)], "doc_id long, text string, output string, N long")
    made = FIM.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"] and made.first().n == 3
    assert FIM.fill_in_middle(no_docs).count() == 0


# 12 --------------------------------------------------------------------------------------------------------------------


def deduped(docs, chars=40, least=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = collections.defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(doc_id)
    top = {k: max(v, key=lambda x: (x is not None, x)) for k, v in holders.items() if len(v) >= least}
    out = collections.Counter()
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in top or top[key(x)] == doc_id]
        out[doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    return out


def test_line_dedup_is_brute_force(spark, odd_docs):
    shared, other = "The same Long Line of forty code points or more", "Été " * 12
    more = [(20 + i, f"start {i}\n  {shared.upper() if i % 2 else shared}\t\n{other}{'x' if i > 3 else ''}\n\n{shared}\n") for i in range(7)]
    more += [(20, shared), (20, shared), (None, shared), (None, other), (None, None), (31, f"{shared}"), (32, "\n".join([shared] * 50)), (33, other.lower()), (34, "short\nshort"), (35, "a" * 39), (36, "İ" + "b" * 40)]
    more += [(40 + i, "z" * 39 + f"\n{'y' * 40} \n" + "w" * 40 + "\x1c") for i in range(4)] + [(44, "y" * 40 + " ")]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    found = LD.drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")
    assert rows(found) == deduped([tuple(r) for r in docs.collect()])


def test_line_dedup_light_keys_and_no_rows(spark, no_docs):
    """More than a thousand common lines: none of them is heavy."""
    docs = spark.createDataFrame([(d, "\n".join(f"line {i} shared by some of the documents here" for i in range(d % 3, 1500, 3))) for d in range(18)], "doc_id long, text string")
    found = LD.drop_common_lines(docs)
    assert rows(found.select("doc_id", "n_lines", "n_dropped", "text")) == deduped([tuple(r) for r in docs.collect()])
    assert LD.drop_common_lines(no_docs).count() == 0


def test_line_dedup_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "k", "one line that is long enough to be counted", "g", i, i) for i in range(6)], "doc_id long, key string, text string, gone string, row long, n_lines long")
    found = LD.drop_common_lines(docs)
    assert found.columns == ["doc_id", "key", "text", "gone", "row", "n_lines", "n_dropped"]
    assert [(r.key, r.gone, r.row, r.text) for r in found.orderBy("doc_id").collect()] == [("k", "g", i, "") for i in range(5)] + [("k", "g", 5, "one line that is long enough to be counted")]


# 13 --------------------------------------------------------------------------------------------------------------------

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = WORDS.findall(low)
    return w, [zlib.crc32(x) % 10000 for x in w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)]]


def test_checksums_are_crc32():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 40_000, np.uint8)
    starts = np.concatenate((rng.integers(0, 30_000, 3000), [0, 0, 0, 0, 5]))
    ends = starts + np.concatenate((rng.integers(1, 200, 3000), [63, 64, 65, 40_000, 1024]))
    got = RS.checksums(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def test_features_of_whole_texts():
    texts = ["", None, "One two  TWOÉ 中文", "...", "x" * 5000 + " y " + "中" * 99, "1a-2b", " z "]
    words, text, bucket = RS.features([(t or "").encode() for t in texts])
    want = [grams(t) for t in texts]
    assert words.tolist() == [len(w) for w, _ in want]
    assert collections.Counter(zip(text.tolist(), bucket.tolist(), strict=True)) == collections.Counter((i, b) for i, (_, f) in enumerate(want) for b in f)


def resampled(docs, target):
    def counts(texts):
        c = collections.Counter()
        for t in texts:
            c.update(grams(t)[1])
        return c

    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in docs:
        w, f = grams(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: 25 * len(able) // 100])}
    return collections.Counter((*r[:4], rank.get(id(r))) for r in out)


@pytest.mark.parametrize("partitions", [1, 7])
def test_resampling_is_brute_force(spark, odd_docs, partitions):
    more = [(100 + i, " ".join(f"w{(i * j) % 83}" for j in range(i % 60)), None, "a", 1) for i in range(300)]
    docs = odd_docs.union(spark.createDataFrame(more, odd_docs.schema)).repartition(partitions)
    target = spark.createDataFrame([("w1 w2 w3 of it",), (None,), ("",), ("W7 word7",)], "text string")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    got = RS.importance_resample(docs, target)
    assert rows(got.select(*columns)) == resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert RS.drawn_documents(docs, got).select("doc_id").distinct().count() == got.where("rank IS NOT NULL").select("doc_id").distinct().count()


def test_resampling_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows(QUERIES["op13_importance_resampling"](spark, SF)) == resampled(docs, target)


def test_resampling_repeated_rows_and_no_rows(spark, no_docs):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 5)] * 9 + [(2, text, 5)], "doc_id long, text string, score long")
    found = RS.importance_resample(docs, no_docs.select("text")).collect()
    assert sorted(r.rank for r in found if r.rank) == [1, 2] and len(found) == 10
    assert RS.importance_resample(no_docs, docs).count() == 0


def test_near_copies_keep_columns_of_any_name(spark):
    from paneloom.llm.near_copies import keep_one_of_each

    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "a", 1, 2, 3), (2, text + " end", "b", 4, 5, 6), (3, "another text of its own with more words", "c", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __own string, __WORD int, __bit int, node int")
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
