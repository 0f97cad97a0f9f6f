"""Quality rules whose cutoffs are chosen on labelled documents with a bound on false rejections.

Each rule is a ratio, higher for worse texts, on a fixed grid of cutoffs. The rules of a
stratum are bounded together: one after the other takes the k-th largest value among the
good documents that the rules before it left, and rejects what lies above. With K such
blocks in all, the rejected part of n good documents is at most a Beta(K, n - K + 1)
variable whatever the distribution (statistically equivalent blocks), so K is the largest
number for which the exact binomial tail at K - 1 is within the level, the chance of
failure divided by the number of strata. Equal values and the grid only reject less.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomarket.llm.tables import written

SPACES = r"[\x20\x09-\x0D]+"
# Cutoffs of each rule: 1 / GRID, 2 / GRID, ..., 1.
GRID = 40
# Good documents that all rules together may reject, and the chance that the bound fails.
FALSE_REJECTIONS, FAILURE = 0.05, 0.05
RULES = ["symbol_share", "upper_share", "dup_line_share", "repeat_share", "long_word_share"]


def _measured(docs: DataFrame) -> DataFrame:
    """Word, line and window counts of each whole text; null counts as no text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), F.xxhash64("text").alias("text_hash"),
        F.array_remove(F.split(text, SPACES), "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).alias("n_symbols"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))).alias("n_upper"))
    counted = base.select(
        "*", F.size("words").alias("n"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.char_length(F.array_join("words", "")).alias("word_chars"))
    windows = F.when(
        F.col("n") >= 3,
        F.transform(F.sequence(F.lit(0), F.col("n") - 3),
                    lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(3)]))).otherwise(
        F.array().cast("array<bigint>"))
    return counted.select("*", windows.alias("windows"))


def _repeated_words(windows: Column) -> Column:
    """Words in windows that occur twice or more: equal windows stand side by side once sorted."""
    placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    neighbours = F.zip_with(
        placed, F.slice(placed, F.lit(2), F.size(windows)),
        lambda p, q: F.when(p["x"] == q["x"], F.array(p["i"], q["i"])).otherwise(F.array().cast("array<int>")))
    starts = F.array_sort(F.array_distinct(F.flatten(neighbours)))
    gaps = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(windows)),
                      lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(0)


def features(docs: DataFrame) -> DataFrame:
    """Counts and rule values of each document, without its text."""
    rows = _measured(docs).select("*", _repeated_words(F.col("windows")).alias("n_repeat_words"))

    def share(part: Column | str, whole: Column | str) -> Column:
        part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
        return F.when(whole > 0, F.least(F.lit(1.0), part / whole)).otherwise(0.0)

    long = lambda c: F.col(c).cast("long").alias({"n": "n_words"}.get(c, c))
    return rows.select(
        "doc_id", "stratum", "text_hash", *map(long, ["n", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]),
        ((F.col("n") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n").alias("repeat_share"),
        # Mean word length, from 0 at 4 characters to 1 at 24.
        share(F.greatest(F.lit(0.0), F.col("word_chars") / F.greatest(F.col("n"), F.lit(1)) - 4), F.lit(20.0)).alias(
            "long_word_share"))


def _tail_sql(k: str, n: str, p: float) -> str:
    """SQL for the log of the chance of at most ``k`` successes in ``n`` trials, term by term."""
    return f"""
        aggregate(sequence(0, cast({k} as int)), struct(cast(0 as double) as term, cast(0 as double) as total),
          (acc, j) -> if(j = 0,
            struct({n} * ln(1 - {p}D) as term, {n} * ln(1 - {p}D) as total),
            struct(acc.term + ln(({n} - j + 1) / j) + ln({p}D / (1 - {p}D)) as term,
              greatest(acc.total, acc.term + ln(({n} - j + 1) / j) + ln({p}D / (1 - {p}D))) + ln(1 + exp(
                -abs(acc.total - acc.term - ln(({n} - j + 1) / j) - ln({p}D / (1 - {p}D))))) as total)),
          acc -> acc.total)"""


def _log_binomial_tail(k: str, n: str, p: float) -> Column:
    return F.expr(_tail_sql(k, n, p))


def _blocks(n: str, p: float, level: str) -> Column:
    """One more than the largest k whose tail is within the level, by bisection; 0 if there is none."""
    return F.expr(f"""
        aggregate(sequence(1, 40), struct(-1L as low, cast(floor({p}D * {n}) as bigint) + 1L as high),
          (s, i) -> if(s.high - s.low <= 1, s, transform(array((s.low + s.high) div 2), mid ->
            if({_tail_sql("mid", n, p)} <= {level},
              struct(mid as low, s.high as high), struct(s.low as low, mid as high)))[0]),
          s -> s.low + 1)""")


def cutoffs(measured: DataFrame, labels: DataFrame, rules: list[str] = RULES, grid: int = GRID,
            false_rejections: float = FALSE_REJECTIONS, failure: float = FAILURE) -> DataFrame:
    """The chosen cutoff of each rule in each stratum: stratum, rule, cutoff.

    Equal texts count once, for copies are no independent evidence; a document with
    several labels counts as good only if all say so; null labels are left out. A
    stratum with too few good documents gets no cutoff, and so rejects none; one with
    fewer blocks than rules has cutoffs for the first rules only.
    """
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    held = (
        measured.where("not base_failed").join(good, "doc_id", "left_semi")
        .groupBy("stratum", "text_hash").agg(*[F.first(r).alias(r) for r in rules])
    )
    # Value v is rejected by cutoff c / grid when v > c / grid, that is c < ceil(v * grid).
    left = written(held.groupBy("stratum", *[F.ceil(F.col(r) * grid).cast("int").alias(r) for r in rules]).agg(
        F.count("*").alias("docs")), "quality-good")
    sizes = left.groupBy("stratum").agg(F.sum("docs").alias("n"))
    strata = sizes.agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    # One row of counts.
    blocks = written(sizes.join(F.broadcast(strata), F.lit(True)).withColumn(
        "level", F.ln(failure / F.col("strata"))).select(
        "stratum", _blocks("n", false_rejections, "level").alias("blocks")), "quality-blocks")
    chosen = blocks.select("stratum", F.lit("").alias("rule"), F.lit(0).alias("bin")).limit(0)
    for place, rule in enumerate(rules):
        # The bin of the k-th largest value; a histogram has at most grid + 1 rows.
        downwards = Window.partitionBy("stratum").orderBy(F.desc(rule))
        share = F.expr(f"blocks div {len(rules)} + int({place} < blocks % {len(rules)})")
        counts = left.groupBy("stratum", rule).agg(F.sum("docs").alias("docs"))
        found = written(
            counts.withColumn("reached", F.sum("docs").over(downwards)).join(blocks, "stratum")
            .where((share > 0) & (F.col("reached") >= share)).groupBy("stratum")
            .agg(F.greatest(F.lit(1), F.max(rule)).alias("bin")), "quality-rule")
        chosen = chosen.unionByName(found.select("stratum", F.lit(rule).alias("rule"), "bin"))
        left = left.join(found, "stratum", "left").where(F.col("bin").isNull() | (F.col(rule) <= F.col("bin"))).drop("bin")
    return chosen.select("stratum", "rule", (F.col("bin") / float(grid)).alias("cutoff"))


def judge(measured: DataFrame, chosen: DataFrame, rules: list[str] = RULES) -> DataFrame:
    """Add ``kept``: the base rules pass and no rule of the stratum rejects."""
    by_rule = chosen.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cutoff_{r}") for r in rules])
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"cutoff_{r}"), F.lit(False))
    return measured.join(by_rule, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Repeated rows are judged each; a null language is a stratum of its own; an empty
    table gives no rows. Texts of any length are read whole.
    """
    measured = written(features(docs), "quality-features")
    chosen = written(cutoffs(measured, labels), "quality-cutoffs")
    return judge(measured, chosen).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
