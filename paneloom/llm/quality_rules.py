"""Quality rules whose cutoffs are chosen under a proven risk, in DataFrame functions alone.

Each rule rejects a document whose value lies above its cutoff. A setting gives every rule a cutoff, and the settings run from
the loosest to the strictest. A labelled holdout tells, for a stratum (a language), how many good documents (quality 1 that
pass the fixed base checks) a setting would reject, by any of its rules. With n good documents and k of them rejected,
P(Bin(n, risk) <= k) is the exact p-value of "the setting rejects more than ``risk`` of the stratum's good documents".
Settings are tested in their order and testing stops at the first that fails; such a fixed sequence needs no correction of its
own. The strata share ``delta`` by Tarone's correction: with n good documents no p-value is below (1 - risk)^n, so strata with
too few to reach their share can never be certified and take none; the number of strata that share is the least K such that
no more than K of them can reach delta / K. It depends on the n alone, not on what the rules do. So with probability
1 - delta no stratum loses more than ``risk`` of its good documents. Of the certified settings the one is taken that rejects
most bad labelled documents net of good ones, the loosest of equals. A stratum without a certified setting uses no rule.

Defined results: null texts are texts without words (base_failed); null languages are one stratum of their own; strata
without labels use no rule; labels that are null are not counted, a document with several labels counts as bad if one
says so; repeated rows each keep a row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, table

SYMBOLS = "[#*$%&|<>]"

#: Each rule's value and its candidate cutoffs, loosest first.
RULES: dict[str, tuple[Column | str, tuple[float, ...]]] = {
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01)),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", (0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "word_length": ("word_chars / greatest(n_words, 1)", (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0)),
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def bound(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column, width: int) -> Column:
    """Words inside windows of ``width`` that occur twice or more in one list of words. Windows are compared by their
    64-bit hash; within one text a collision is rarer than 1e-9 even at a million words."""
    last = F.size(words) - (width - 1)
    windows = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        ends = F.transform(starts, lambda x, k: F.least(F.coalesce(F.get(starts, k + 1) - x, F.lit(width)), F.lit(width)).cast("long"))
        return F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x)

    def heavy(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"], F.lit(False)) & (k > 0))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        return bound(bound(placed, starts), covered)

    return bound(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(heavy(h)))


def counted(docs: DataFrame, width: int = 8) -> DataFrame:
    """``docs`` with the struct ``counts`` of its whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    of_words = bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w, width).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    of_lines = bound(lines, lambda s: F.struct(F.size(s).cast("long").alias("n_lines"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines")))
    symbols = F.regexp_count(text, F.lit(SYMBOLS)).cast("long")
    return docs.withColumn("counts", F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("n_symbols")))


def flat(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the counts as columns, with base_failed."""
    c = F.col("counts")
    out = docs.select(*keep, *(c["w"][x].alias(x) for x in ("n_words", "word_chars", "n_repeat_words")), *(c["l"][x].alias(x) for x in ("n_lines", "n_dup_lines")), c["n_symbols"].alias("n_symbols"))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def tail_probability(n: Column, k: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), exactly summed from its terms; 1 where k >= n * risk (it is then above any level used)."""
    odds = risk / (1 - risk)
    first = F.struct((n * F.log1p(F.lit(-risk))).alias("term"), F.exp(n * F.log1p(F.lit(-risk))).alias("sum"))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j * odds)
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    few = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * risk, F.lit(1.0)).otherwise(F.aggregate(few, first, add, lambda a: a["sum"]))


def stratum(lang: str) -> Column:
    """The stratum of a language; null is one of its own."""
    return F.when(F.col(lang).isNull(), "none").otherwise(F.concat(F.lit("lang "), lang))


STEPS = 12


def setting(step: int) -> dict[str, float]:
    """The cutoff of each rule at a step from 0 (loosest) to STEPS - 1 (strictest)."""
    return {name: cutoffs[step * len(cutoffs) // STEPS] for name, (_, cutoffs) in RULES.items()}


def _hit(cutoffs: dict[str, Column | float]) -> Column:
    """A value of some rule lies above its cutoff."""
    out = F.lit(False)
    for name, (value, _) in RULES.items():
        out = out | F.coalesce(F.expr(value) > cutoffs[name], F.lit(False))
    return out


def certified(features: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, step, n_good, k_good, n_bad_hit, p_value, a column for each rule's cutoff) of each stratum's setting."""
    one = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = features.where(~F.col("base_failed")).join(one, "doc_id")
    sums = []
    for i in range(STEPS):
        hit = _hit(setting(i))
        sums += [F.count_if(hit & (F.col("quality") == 1)).alias(f"good_{i}"), F.count_if(hit & (F.col("quality") == 0)).alias(f"bad_{i}")]
    wide = staged(seen.groupBy("stratum").agg(F.count_if(F.col("quality") == 1).alias("n_good"), *sums), "holdout")
    able = wide.withColumn("least", F.pow(F.lit(1 - risk), "n_good")).where(F.col("least") <= delta)
    # K = 1 + the number of K whose delta / K more than K strata can reach; one row for each stratum of some hundred labels
    ranked = able.withColumn("rank", F.row_number().over(Window.orderBy("least", "stratum")))
    sharing = ranked.agg((1 + F.count_if((F.col("rank") > 1) & (F.col("least") <= F.lit(delta) / (F.col("rank") - 1)))).alias("sharing"))
    cells = [F.struct(F.lit(i).alias("step"), F.col(f"good_{i}").alias("k_good"), F.col(f"bad_{i}").alias("n_bad_hit"), *(F.lit(float(x)).alias(name) for name, x in setting(i).items())) for i in range(STEPS)]
    tested = able.select("stratum", "n_good", F.inline(F.array(*cells))).join(F.broadcast(sharing))  # one row
    tested = tested.withColumn("p_value", tail_probability(F.col("n_good"), F.col("k_good"), risk))
    failed = F.when(F.col("p_value") > F.lit(delta) / F.col("sharing"), F.col("step"))
    tested = tested.withColumn("stop", F.min(failed).over(Window.partitionBy("stratum")))
    passed = tested.where(F.col("stop").isNull() | (F.col("step") < F.col("stop")))
    kept = F.struct("step", "n_good", "k_good", "n_bad_hit", "p_value", *RULES)
    return passed.groupBy("stratum").agg(F.max_by(kept, F.struct(F.col("n_bad_hit") - F.col("k_good"), -F.col("step"))).alias("b")).select("stratum", "b.*")


def judged(features: DataFrame, cuts: DataFrame, few: int = 10_000) -> DataFrame:
    """``features`` with ``kept``: false if base_failed or above a taken cutoff of its stratum."""
    wide = staged(cuts.select("stratum", *RULES), "cutoffs")
    side = F.broadcast(wide) if wide.count() <= few else wide  # a row a stratum; broadcast only when counted few
    met = features.alias("f").join(side.alias("cut"), F.col("f.stratum") == F.col("cut.stratum"), "left")
    return met.select("f.*", (~F.col("f.base_failed") & ~_hit({name: F.col(f"cut.{name}") for name in RULES})).alias("kept"))


def keep_by_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    inner = [F.col(c) for c in docs.columns]
    whole = staged(counted(docs.select(F.struct(*inner).alias("row"), "text")).drop("text"), "counted")
    features = flat(whole.select("row", "counts", stratum("row.lang").alias("stratum"), F.col("row.doc_id").alias("doc_id")), "row", "stratum", "doc_id")
    return judged(features, certified(features.drop("row"), labels, risk, delta)).where("kept").select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base check and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    features = staged(flat(counted(docs).withColumn("stratum", stratum("lang")), "doc_id", "stratum"), "rules")
    found = judged(features, certified(features, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
