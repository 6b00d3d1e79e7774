"""Quality rules: text statistics, base limits and robust multivariate outliers, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from threatloom.llm.common import SPACE_CHARS, SPACE_CLASS, fresh, written
from threatloom.session import cut_lineage

WINDOW = 3
#: Base limits: fewest words, and most words in repeated windows as a share of all.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Share of a group that each concentration step keeps.
KEPT_SHARE = 0.75
#: Groups with fewer documents are judged with the rest of their language, then with the rest of the table.
LEAST_GROUP = 200
#: Names of the transformed statistics, and the spread below which a difference means nothing.
AXES = {"word_length": 0.35, "symbols": 0.1, "dup_lines": 0.2, "repeats": 0.2, "capitals": 0.1, "marks": 0.1}
STEPS = 4
#: Most groups whose estimates, some 200 bytes each, are broadcast; more are joined by shuffle.
FEW_GROUPS = 20_000
#: Chance that a normal vector lies beyond the cut. The transformed statistics have longer tails than that.
TAIL = 1e-4


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_capitals, n_marks, n_repeat_words) of whole texts; null counts as no words.

    Repeated windows are found inside the row: window hashes, cut to leave room for the position, are sorted as plain longs,
    and neighbours with equal hashes are compared word by word.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    split = docs.select(
        "doc_id", "lang", "source",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+")).alias("words"),
        F.length(F.regexp_replace(text, f"[{SPACE_CLASS}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"), F.regexp_count(text, F.lit(r"[\p{P}\p{S}]")).cast("long").alias("n_marks"), lines.alias("lines"))
    counted = split.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "n_capitals", "n_marks", "words", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.bin(F.size("words").cast("long"))).alias("width"))
    keys = counted.withColumn("keys", F.expr("""
        CASE WHEN n_words < 3 THEN CAST(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, n_words - 3), i ->
            shiftleft(shiftright(xxhash64(words[i], words[i + 1], words[i + 2]), width), width) | i)) END""")).withColumn(
        "low", F.expr("shiftleft(1L, width) - 1"))
    same = """(k >= 0 AND k + 1 < size(keys) AND shiftright(keys[k], width) = shiftright(keys[k + 1], width)
        AND words[keys[k] & low] = words[keys[k + 1] & low] AND words[(keys[k] & low) + 1] = words[(keys[k + 1] & low) + 1]
        AND words[(keys[k] & low) + 2] = words[(keys[k + 1] & low) + 2])"""
    marked = keys.withColumn("places", F.expr(f"""
        sort_array(filter(transform(keys, (key, k) -> CASE WHEN {same} OR {_shifted(same)} THEN key & low END), p -> p IS NOT NULL))"""))
    return marked.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_capitals", "n_marks",
        F.expr("""aggregate(places, named_struct('until', 0L, 'total', 0L),
            (a, p) -> named_struct('until', p + 3, 'total', a.total + p + 3 - greatest(a.until, p)), a -> a.total)""").alias("n_repeat_words"))


def _shifted(condition: str) -> str:
    """The same condition for the pair that ends at k."""
    return condition.replace("keys[k + 1]", "keys[?]").replace("keys[k]", "keys[k - 1]").replace("keys[?]", "keys[k]").replace(
        "k >= 0 AND k + 1 < size(keys)", "k >= 1")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _transformed(stats: DataFrame) -> DataFrame:
    """Mean word length, and square roots of the shares of symbols, repeated lines (per word), repeated words, capitals and marks.
    All are null for a text without words, which the base limits reject."""
    words, chars = (F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("n_words", "word_chars"))
    return stats.select("*", (chars / words).alias("word_length"), F.sqrt(F.col("n_symbols") / chars).alias("symbols"),
                        F.sqrt(F.col("n_dup_lines") / words).alias("dup_lines"), F.sqrt(F.col("n_repeat_words") / words).alias("repeats"),
                        F.sqrt(F.col("n_capitals") / chars).alias("capitals"), F.sqrt(F.col("n_marks") / chars).alias("marks"))


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_square_tail_point(tail: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        survived = math.exp(-middle / 2) * sum((middle / 2) ** k / math.factorial(k) for k in range(degrees // 2))
        low, high = (middle, high) if survived > tail else (low, middle)
    return high


def _keys(stats: DataFrame) -> DataFrame:
    """Adds ``by_both`` and ``by_lang``, never null: null languages and sources are values of their own."""
    parts = [F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in ("lang", "source")]
    return stats.withColumn("by_both", F.concat_ws("\x1f", *parts)).withColumn("by_lang", parts[0])


def _groups(rows: DataFrame) -> DataFrame:
    """(by_both, grp): language and source where large enough, or the rest of the language, or the rest of all."""
    sizes = rows.groupBy("by_lang", "by_both").agg(F.count("*").alias("n")).withColumn("big", F.col("n") >= LEAST_GROUP)
    rest = sizes.where("not big").groupBy("by_lang").agg(F.sum("n").alias("rest_n"))
    named = F.when(F.col("big"), F.concat(F.lit("group "), "by_both")).when(F.col("rest_n") >= LEAST_GROUP, F.concat(F.lit("rest "), "by_lang"))
    return sizes.join(rest, "by_lang", "left").select("by_both", F.coalesce(named, F.lit("rest")).alias("grp"))


def _estimate(rows: DataFrame, scale: float) -> DataFrame:
    """Mean and triangular root of the covariance, times ``scale`` and widened by the least spread, of each group."""
    axes = list(AXES)
    pairs = [(i, j) for i in range(len(axes)) for j in range(i + 1)]
    sums = rows.groupBy("grp").agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m{i}") for i, a in enumerate(axes)), *(
        F.avg(F.col(axes[i]) * F.col(axes[j])).alias(f"c{i}{j}") for i, j in pairs))
    for i, j in pairs:
        spread = (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
        sums = sums.withColumn(f"c{i}{j}", F.greatest(spread, F.lit(0.0)) + AXES[axes[i]] ** 2 if i == j else spread)
    for i, j in pairs:
        left = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        sums = sums.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(AXES[axes[i]] ** 2 / 4))) if i == j else left / F.col(f"l{j}{j}"))
    return cut_lineage(sums.select("grp", *(f"m{i}" for i in range(len(axes))), *(f"l{i}{j}" for i, j in pairs)))


def _measured(joined: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance from the estimate joined to each row, by forward substitution."""
    for i, axis in enumerate(AXES):
        known = sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        joined = joined.withColumn(f"z{i}", (F.col(axis) - F.col(f"m{i}") - known) / F.col(f"l{i}{i}"))
    return joined.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(AXES))), F.lit(0.0)))


def _by_group(rows: DataFrame, groups: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the row of their group. A table of few groups travels to the rows, so a large group is not gathered."""
    return rows.join(F.broadcast(groups) if small else groups, "grp", how)


def _distances(rows: DataFrame, estimate: DataFrame, small: bool) -> DataFrame:
    return _measured(_by_group(rows, estimate, small)).select(*rows.columns, "d2")


def _nearest(rows: DataFrame, small: bool) -> DataFrame:
    """The rows of each group up to the distance that at least KEPT_SHARE of it reaches; distances are counted in narrow logarithmic bins."""
    binned = rows.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * 32))
    counts = binned.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("grp").orderBy("bin")
    reached = counts.select("grp", "bin", (F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"), F.sum("n").over(
        Window.partitionBy("grp")).alias("all")).where(F.col("before") < KEPT_SHARE * F.col("all"))
    last = reached.groupBy("grp").agg(F.max("bin").alias("last"))
    return _by_group(binned, last, small).where("bin <= last")


def judged(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed, grp, d2 and kept of every row of ``docs``.

    A group's centre and covariance are those of its most concentrated three quarters (minimum covariance determinant by
    concentration steps from a start of medians and quartile ranges), reweighted once. Each axis has a least spread, so that a
    statistic that is constant in a group rejects nobody over a trifle. A row is kept if it passes the base limits and its
    squared distance is within the cut; rows of a rest with fewer than LEAST_GROUP rows are kept. Steps pass per-group sums and
    bin counts only.
    """
    stats = written(_keys(text_statistics(docs)), "quality").withColumn("base_failed", base_failed())
    passed = _transformed(stats.where("not base_failed")).select("by_lang", "by_both", *AXES)
    groups = cut_lineage(_groups(passed))
    small = groups.count() <= FEW_GROUPS
    named = F.broadcast(groups) if small else groups
    estimate = fit(written(passed.join(named, "by_both").select("grp", *AXES), "quality_vectors"))
    scored = _measured(_by_group(_transformed(stats).join(named, "by_both", "left"), estimate, small, "left"))
    cut = chi_square_tail_point(TAIL, len(AXES))
    return scored.select(*(c for c in stats.columns if not c.startswith("by_")), "grp", "d2").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cut, F.lit(True)))


def fit(rows: DataFrame) -> DataFrame:
    """Means and roots by group, from rows with ``grp`` and the axes."""
    degrees = len(AXES)
    sizes = cut_lineage(rows.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_GROUP).select("grp"))
    small = sizes.count() <= FEW_GROUPS
    rows = _by_group(rows, sizes, small)
    quarters = rows.groupBy("grp").agg(*(F.percentile_approx(a, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, a in enumerate(AXES)))
    start = [F.col(f"q{i}")[1].alias(f"m{i}") for i in range(degrees)]
    for i, least in enumerate(AXES.values()):
        start += [F.lit(0.0).alias(f"l{i}{j}") for j in range(i)] + [F.sqrt(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + least ** 2).alias(f"l{i}{i}")]
    estimate = cut_lineage(quarters.select("grp", *start))
    inside = chi_square_tail_point(1 - KEPT_SHARE, degrees)
    for _ in range(STEPS):
        estimate = _estimate(_nearest(_distances(rows, estimate, small), small), KEPT_SHARE / chi_square_cdf(inside, degrees + 2))
    usual = chi_square_tail_point(0.025, degrees)
    return _estimate(_distances(rows, estimate, small).where(F.col("d2") <= usual), 0.975 / chi_square_cdf(usual, degrees + 2))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns; a doc_id goes only if all its rows are rejected."""
    good = judged(docs).where("kept").select("doc_id").distinct()
    kept = fresh(docs, "kept_id")
    return docs.join(good.withColumnRenamed("doc_id", kept), F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi")
