"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Measures of each text are compared with cutoffs, one for each rule and stratum (language). All rules tighten together
along a fixed path of `LEVELS` steps, so what is decided for a stratum is one number: how far along the path. It is taken
from labelled holdouts. The steps are tested from the loosest on, each by the exact binomial tail: a step holds if the
labelled good texts that it rejects are so few that a share above `alpha` can be ruled out. A sequence in a fixed order that
ends at its first failure needs no correction within itself; over strata the level `delta` is dealt by Bonferroni in
proportion to their holdouts, whose numbers say nothing of the outcomes. So, with confidence 1 - delta, no stratum loses
more than a share alpha of its good texts. Where the labels cannot show this, nothing is rejected in that stratum.

Power: a stratum that holds a share s of the good labelled texts shows its first step from ln(s * delta) / ln(1 - alpha)
of them on, if that step rejects none: 149 texts if it is alone, 217 if it is one of four alike.

Inputs: a null text has no words (and fails the base rule of ten words); a null or unlabelled stratum is one of its own,
named ''; several labels of one document count as good only if all are; repeated rows are judged each; an empty table,
or no labels, gives no cutoffs; only the named columns are read, so further columns never clash. Whole texts are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Accepted false rejections, their confidence, and the words in a window.
ALPHA, DELTA, SPAN = 0.02, 0.05, 5
#: Strata whose cutoffs are broadcast, and labels whose ids are; more are joined.
STRATA, LABELS = 10_000, 1_000_000
#: White space that separates words, and characters that count as symbols: fixed values of the contract.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Steps of the path, and for each rule the tightest and the loosest cutoff on it; a text whose measure is above the cutoff is rejected.
LEVELS = 40
ENDS = {
    "symbol_ratio": (0.02, 0.40),
    "dup_line_ratio": (0.30, 0.90),
    "repeat_word_ratio": (0.10, 0.20),
    "short_words": (-4.4, -2.0),
    "long_words": (6.0, 12.0),
}
#: Rule -> its cutoffs along the path, the tightest first.
RULES = {rule: [round(low + (high - low) * k / (LEVELS - 1), 6) for k in range(LEVELS)] for rule, (low, high) in ENDS.items()}


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id", stratum: str | None = "lang", whole: bool = False) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), without a shuffle; with `whole`, `row` (all columns) instead of doc_id."""
    group = F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")) if stratum and stratum in docs.columns else F.lit("")
    first = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if whole else F.col(f"`{key}`").cast("long").alias("doc_id")
    name = "row" if whole else "doc_id"
    df = docs.select(first, group.alias("stratum"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    bare = F.length(F.translate("t", SPACE, ""))
    df = df.select(
        name, "stratum",
        F.expr(r"filter(split(t, '[\\x20\\x09-\\x0D]+'), w -> w != '')").alias("words"),
        bare.cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr(r"filter(split(t, '\n'), l -> length(translate(l, ' \t\x0b\x0c\r', '')) > 0)".replace(r"\x0b", "\x0b").replace(r"\x0c", "\x0c")).alias("lines"),
    )
    df = df.select(
        name, "stratum", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(words, w -> xxhash64(w))").alias("h"),
    )
    following = ", ".join(f"get(h, i + {k})" for k in range(1, SPAN))
    df = df.withColumn("windows", F.expr(f"CASE WHEN size(h) < {SPAN} THEN cast(array() AS array<bigint>) ELSE transform(slice(h, 1, size(h) - {SPAN - 1}), (x, i) -> xxhash64(x, {following})) END"))
    # Windows that occur once are by far the most, and most texts have no others: only where some repeat are they
    # sorted with their places, those next to an equal one picked out, and the words they cover counted.
    twice = "filter(transform(sequence(0, size(s) - 1), j -> CASE WHEN get(s, j).v = get(s, j + 1).v OR (j > 0 AND get(s, greatest(j - 1, 0)).v = get(s, j).v) THEN get(s, j).p END), p -> p IS NOT NULL)"
    df = df.withColumn("s", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN array_sort(transform(windows, (v, p) -> struct(v, p))) END"))
    df = df.withColumn("places", F.expr(f"CASE WHEN s IS NOT NULL THEN array_sort({twice}) END"))
    covered = f"CASE WHEN places IS NULL THEN 0L ELSE aggregate(transform(places, (p, j) -> least({SPAN}, coalesce(get(places, j + 1), p + {SPAN}) - p)), 0L, (a, x) -> a + x) END"
    # A value that the optimiser takes for one that may change keeps filters on the measures above them: pushed down, a
    # filter would repeat the whole chain of expressions many times over.
    fixed = F.when(F.monotonically_increasing_id() < 0, F.lit(None)).otherwise(F.expr(covered))
    return df.select(name, "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", fixed.alias("n_repeat_words"))


def rule_values() -> dict[str, Column]:
    """The value that each rule compares with its cutoff."""
    c = F.col
    over = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": over("n_symbols", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "repeat_word_ratio": over("n_repeat_words", "n_words"),
        "short_words": F.when(c("n_words") > 0, 0.0 - over("word_chars", "n_words")).otherwise(F.lit(-10.0)),
        "long_words": over("word_chars", "n_words"),
    }


def log_factorial(n: Column) -> Column:
    """ln(n!), by Stirling's series with shifted argument; exact to about 1e-12."""
    z = n + F.lit(9.0)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    down = F.log((n + 1.0) * (n + 2.0) * (n + 3.0) * (n + 4.0)) + F.log((n + 5.0) * (n + 6.0) * (n + 7.0) * (n + 8.0))
    return series - down


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, step): the tightest step that holds in each stratum that has one, from rows of measures of texts labelled good.

    Each step's false rejections k of n are tested exactly: it holds if Binomial(n, alpha) takes k or less with a
    probability of at most the stratum's part of delta, which is the Clopper-Pearson upper bound being at most alpha.
    Counts are gathered as histograms over the path, so what is shuffled does not grow with the labels.
    """
    values = rule_values()
    # How many steps reject a text: those at which any rule's value is above its cutoff, which are all from the tightest on.
    below = lambda name: F.size(F.filter(F.array(*map(F.lit, RULES[name])), lambda c: c < values[name]))
    placed = labelled.select("stratum", F.greatest(*map(below, RULES)).alias("above")).groupBy("stratum", "above").agg(F.count("*").alias("n"))
    held = placed.groupBy("stratum").agg(F.sum("n").alias("n"), F.collect_list(F.struct("above", "n")).alias("bars"))
    total = held.agg(F.sum("n").alias("total"))
    tried = held.join(F.broadcast(total), how="cross").select("stratum", "n", "bars", "total", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("step"))  # one row
    tried = tried.withColumn("k", F.expr("aggregate(filter(bars, b -> b.above > step), 0L, (a, b) -> a + b.n)")).drop("bars")
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    # The tail from its largest term down: terms fall at least by the ratio k(1-p)/((n-k+1)p) < 1, so the fold ends early in effect.
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(alpha) + (n - k) * math.log1p(-alpha)
    tried = tried.filter(F.col("k") <= F.col("n") * alpha).withColumn("top", top)
    tail = f"aggregate(CASE WHEN k > 0 THEN sequence(k, 1L, -1L) ELSE cast(array() AS array<bigint>) END, named_struct('term', 1.0D, 'sum', 1.0D), (a, j) -> named_struct('term', a.term * j * {1 - alpha!r}D / ((n - j + 1) * {alpha!r}D), 'sum', a.sum + a.term * j * {1 - alpha!r}D / ((n - j + 1) * {alpha!r}D)), a -> top + ln(a.sum))"
    shown = tried.filter(F.expr(tail) <= F.log(F.lit(delta) * F.col("n") / F.col("total")))
    # k falls as the step loosens, so the tests that hold are those from the loosest down to the first failure.
    return shown.groupBy("stratum").agg(F.min("step").alias("step"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, text: str = "text", key: str = "doc_id", stratum: str | None = "lang") -> DataFrame:
    """Measures, base_failed, the rules that reject (sorted, with commas) and kept, of each row.

    `labels` has doc_id and quality (1: to be kept). The measures are written once to the shared folder; texts are read once.
    """
    found = common.written(measures(docs, text, key, stratum), "measures")
    return _judged(found, _cut(found, labels, alpha, delta)).drop("stratum")


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _good(labels: DataFrame) -> DataFrame:
    """The ids of texts that are labelled good, and nothing else."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return given.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")


def _cut(found: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, cut): the cutoffs of each stratum by rule. The rules add to the base rule, so their holdouts are the good texts that it keeps."""
    taken = cutoffs(found.filter(~_failed()).join(_good(labels), "doc_id", "left_semi"), alpha, delta)
    at = F.create_map(*(x for name, grid in RULES.items() for x in (F.lit(name), F.get(F.array(*map(F.lit, grid)), F.col("step")))))
    return common.written(taken.select("stratum", at.alias("cut")), "cutoffs")


def _judged(found: DataFrame, cut: DataFrame) -> DataFrame:
    # A row for each stratum: few by what strata are, but broadcast only after a look.
    cut = F.broadcast(cut) if cut.count() <= STRATA else cut
    values = rule_values()
    broken = F.array(*(F.when(values[name] > F.element_at("cut", name), F.lit(name)) for name in sorted(RULES)))
    out = found.join(cut, "stratum", "left").withColumn("base_failed", _failed())
    out = out.withColumn("rejected_by", F.when(F.col("cut").isNull(), F.lit("")).otherwise(F.concat_ws(",", broken)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == "")).drop("cut")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, text: str = "text", key: str = "doc_id", stratum: str | None = "lang") -> DataFrame:
    """The rows of docs that judge() keeps, with their columns, in their order, without a shuffle of texts.

    Only the labelled texts are measured for the cutoffs, where the ids that are labelled good are few enough to be
    broadcast (LABELS); beyond that all texts are measured a first time, which still costs less than to shuffle them.
    """
    named = stratum if stratum and stratum in docs.columns else None
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), (F.col(f"`{named}`") if named else F.lit("")).alias("lang"))
    good = common.written(_good(labels), "good")
    if good.count() <= LABELS:
        found = measures(own.join(F.broadcast(good), "doc_id", "left_semi"))
    else:
        found = common.written(measures(own), "measures")
    return _judged(measures(docs, text, key, stratum, whole=True), _cut(found, labels, alpha, delta)).filter("kept").select("row.*")
