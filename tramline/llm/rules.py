"""Quality rules whose cutoffs control the risk of rejecting good documents.

Rules are ratios of a document's statistics; a document is rejected where a ratio lies above the rule's
cutoff. Labelled documents are a holdout: for each stratum, rule and candidate cutoff, the good ones
above it are counted, and the exact binomial tail P(Bin(n, a) <= k) is the p-value of "the rule rejects more than a
share ``a`` of good documents". ``a`` is the permitted share ``alpha`` divided among the rules, so that all
rules together stay below ``alpha``. The candidates of a rule are tested from the laxest to the strictest and
the test stops at the first that fails (fixed sequence), which needs no further correction within a
rule; ``delta`` is divided by the number of (stratum, rule) pairs. With confidence 1 - delta, no
stratum loses more than ``alpha`` of its good documents. Where nothing can be shown, as in a stratum with few labels,
the rule rejects nothing.

All of it is DataFrame functions; statistics are computed inside each row, without a shuffle of words.

Defined cases: null text counts as empty (no words: fails the base rules); null strata form one stratum;
labels with null quality or without a document are not used; repeated labels count each; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import GAP
from tramline.llm.components import _written

WINDOW = 8
#: rule -> (numerator, denominator) over the statistics below
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "n_letters"),
    "bar_share": ("n_bars", "n_words"),
}
#: candidate cutoffs of every rule, laxest first
CUTOFFS = (2.0, 1.0, 0.8, 0.65, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)


def _pairs(hashes: Column, step: int) -> Column:
    """Hashes of neighbours ``step`` apart: from stretches of ``step`` words to stretches twice as long."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with the statistics of the whole text, all long:

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines, n_repeat_words (words in windows of
    eight words that occur twice or more), n_letters, n_upper, n_bars (words that are one
    vertical bar).
    """
    rest = [c for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    n_of = lambda p: F.regexp_count(F.col("_t"), F.lit(p)).cast("long")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), t.alias("_t"))
    d = d.select(
        "_row",
        "_t",
        F.filter(F.split("_t", GAP), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.rtrim(x, F.lit("\t\n\x0b\x0c\r ")) != "").alias("_l"),
    )
    d = d.select(
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_t", GAP, "")).cast("long").alias("word_chars"),
        n_of(r"[#*$%&|<>]").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        n_of(r"\p{L}").alias("n_letters"),
        n_of(r"\p{Lu}").alias("n_upper"),
        F.size(F.filter("_w", lambda w: w == "|")).cast("long").alias("n_bars"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    for step in (1, 2, 4):
        d = d.withColumn("_h", _pairs(F.col("_h"), step))
    # windows of eight words: hash i covers words i..i+7
    d = d.withColumn("_h", F.slice("_h", 1, F.greatest(F.lit(0), F.col("n_words") - F.lit(WINDOW - 1)).cast("int")))
    d = d.withColumn("_rep", F.size(F.array_distinct("_h")) < F.size("_h"))
    # windows in the order of their hashes: those equal to a neighbour occur twice or more
    sort = F.when(F.col("_rep"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_s", sort).drop("_h")
    same = lambda x, j, k: F.coalesce(F.get(F.col("_s"), j + k)["h"] == x["h"], F.lit(False))
    hit = F.filter("_s", lambda x, j: F.when(j > 0, same(x, j, -1)).otherwise(F.lit(False)) | same(x, j, 1))
    d = d.withColumn("_p", F.array_sort(F.transform(hit, lambda x: x["i"]))).drop("_s")
    # words covered: each window adds what lies before the next window, at most its own eight words
    added = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), j + 1) - p, F.lit(WINDOW))))
    n_rep = F.when(F.col("_rep"), F.aggregate(added, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0)).cast("long")
    d = d.withColumn("n_repeat_words", n_rep)
    stats = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_bars"]
    return d.select(*[F.col("_row")[c].alias(c) for c in rest if c not in stats], *stats)


def base_failed(min_words: int = 20, repeat_pct: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"))


def binomial_tail(k: Column, n: Column, a: float) -> Column:
    """P(Bin(n, a) <= k), exact; 1 where k >= n * a, since such a k can prove nothing.

    The largest term is the last; the others follow from it by ratios, and its logarithm is summed from
    small factors, so that nothing underflows.
    """
    logs = F.when(k == 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, j: s + F.log((n - k + j) / j)))
    top = F.exp(logs + k * F.log(F.lit(a)) + (n - k) * F.log(F.lit(1 - a)))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    odds = (1 - a) / a

    def down(s, j):
        term = s["term"] * (k - j + 1) / (n - k + j) * odds
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.when(k == 0, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), zero, down, lambda s: s["sum"]))
    return F.when((n == 0) | (k >= n * a), F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * total))


def ratio(rule: str) -> Column:
    over, under = RATIOS[rule]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def cutoffs(good: DataFrame, stratum: str, alpha: float = 0.05, delta: float = 0.05, rules: dict = RATIOS, grid: tuple = CUTOFFS) -> DataFrame:
    """The strictest proven cutoff of each rule: one row (stratum, cutoffs map) per stratum of ``good``.

    ``good`` holds the statistics of labelled good documents. Only counts per (stratum, rule, cutoff) leave
    the scan of ``good``; the tests run on these few rows.
    """
    a = alpha / len(rules)
    counted = good.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(ratio(r) > c).alias(f"{r}:{i}") for r in rules for i, c in enumerate(grid)],
    )
    counted = counted.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))  # a few rows
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"`{r}:{i}`").alias("k")) for r in rules for i, c in enumerate(grid)])
    tests = counted.select("stratum", "n", "strata", F.explode(each).alias("t")).select("stratum", "n", "strata", "t.*")
    tests = tests.withColumn("p", binomial_tail(F.col("k"), F.col("n"), a))
    failed = F.max((F.col("p") > delta / (F.col("strata") * len(rules))).cast("int"))
    so_far = Window.partitionBy("stratum", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    best = tests.withColumn("failed", failed.over(so_far)).filter("failed = 0").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(stats: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """``stats`` (see ``statistics``) with base_failed, failed_rules and kept.

    Good documents are those of ``labels`` with quality 1 that pass the base rules; the promise holds for these.
    """
    marked = stats.withColumn("base_failed", base_failed())
    ids = labels.filter("quality = 1").select(F.col(id_col).alias("_id"))
    good = marked.filter(~F.col("base_failed")).join(ids, F.col(id_col) == F.col("_id"))
    table = _written(cutoffs(good, stratum, alpha, delta).select(F.col("stratum").alias("_stratum"), F.col("cutoffs").alias("_cutoffs")), "cutoffs")
    small = table.count() <= 10_000  # one row per stratum with a proof; otherwise Spark picks the join
    got = marked.join(F.broadcast(table) if small else table, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(ratio(r) > F.col("_cutoffs")[r], F.lit(r)) for r in RATIOS]))
    return got.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_stratum", "_cutoffs")
