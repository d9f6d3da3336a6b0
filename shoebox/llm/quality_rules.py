"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

One pass measures every whole text by SQL functions only. A sketch per (language, source) and measure counts its rows in bins whose
edges grow by ``STEP``: some thousand bins at most, and sums of counts merge sketches per language and into one for all. Counts have
one outcome however rows are dealt or tasks rerun, so the verdicts are the same in every run. The threshold of a measure is
a fence over the quartiles, plus a margin below which no difference counts, so even groups lose nothing:
upper = q3 + FENCE * (q3 - q1) + margin. A group's fence is drawn to its language's, and that to the one of all rows, as if ``WEIGHT``
rows more stood there: smoothly, the less the larger the group. Documents are then joined with the thresholds of their group.

A null text has no words. Ties do not matter: equal measures get equal verdicts. Very long texts are measured whole. A null language or source is a group of its own. Repeated rows are judged each, alike.
An empty table gives no rows. Extra columns are ignored.

Fixed values: words, symbols, windows of eight words, at least 20 words and at most 30 % repeated ones are the contract's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoebox.llm.spark import lookup
from shoebox.session import durable

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30
TINY, STEP = 1e-6, 1.01  # where bins begin, and how they grow: a quartile is right to half a percent
WEIGHT = 100  # rows by which a group's thresholds are drawn to its language's, and those to all rows'
FENCE = 3.0
#: Measure: (expression over the counts, margin).
MEASURES = {
    "symbol_share": ("n_symbols / word_chars", 0.02),
    "dup_line_share": ("n_dup_lines / n_lines", 0.25),
    "repeat_share": ("n_repeat_words / n_words", 0.10),
    "word_length": ("word_chars / n_words", 2.0),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _let(value: Column, body) -> Column:
    """``body`` over one evaluation of ``value``."""
    return F.get(F.transform(F.array(value), body), 0)


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash is in the array more than once."""

    def spans(starts: Column) -> Column:
        step = F.transform(starts, lambda s, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), s - F.get(starts, k - 1))))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    def repeated(sorted_pairs: Column) -> Column:
        def same(pair, other):
            return F.coalesce(F.get(sorted_pairs, other)["h"] == pair["h"], F.lit(False))

        twice = F.filter(sorted_pairs, lambda pair, k: same(pair, k + 1) | (F.when(k > 0, same(pair, k - 1)).otherwise(False)))
        return _let(F.sort_array(F.transform(twice, lambda pair: pair["at"])), spans)

    pairs = F.transform(windows, lambda h, at: F.struct(h.alias("h"), at.alias("at")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(F.sort_array(pairs), repeated))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeats(hashes: Column) -> Column:
        ends = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        windows = F.transform(ends, lambda k: F.xxhash64(F.slice(hashes, k, WINDOW)))
        return F.when(F.size(hashes) < WINDOW, 0).otherwise(_let(windows, _covered))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), _let(F.transform(w, lambda x: F.xxhash64(x)), repeats).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    solid = F.translate(text, SPACES, "")
    chars = _let(solid, lambda x: F.struct(F.length(x).alias("word_chars"), (F.length(x) - F.length(F.translate(x, SYMBOLS, ""))).alias("n_symbols")))
    found = docs.select("doc_id", "lang", "source", _let(words, of_words).alias("w"), of_lines.alias("l"), chars.alias("c"))
    return found.select("doc_id", "lang", "source", *(F.col(f"{g}.{c}").cast("long").alias(c) for c, g in zip(COUNTS, "wccl" + "wl", strict=True)))


def _bin(measure: str) -> Column:
    """Bin 0 for what is next to nothing, then bins that grow by ``STEP``."""
    value = F.col(measure)
    return F.when(value <= TINY, 0).otherwise(1 + F.floor(F.ln(value / TINY) / F.lit(math.log(STEP)))).cast("int")


def _middle(bins: str) -> Column:
    return F.when(F.col(bins) == 0, 0.0).otherwise(TINY * F.pow(F.lit(STEP), F.col(bins) - 0.5))


def _fences(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows and upper fence per group and measure, from the counts of its bins."""
    whole = Window.partitionBy(*keys, "measure")
    so_far = F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    counted = sketch.withColumn("upto", so_far).withColumn("rows", F.sum("n").over(whole))
    quartile = {q: F.min(F.when(F.col("upto") >= share * F.col("rows"), F.col("bin"))).alias(q) for q, share in (("q1", 0.25), ("q3", 0.75))}
    found = counted.groupBy(*keys, "measure").agg(F.max("rows").alias(f"{name}_rows"), *quartile.values())
    margin = F.element_at(F.create_map(*(F.lit(x) for m, (_, gap) in MEASURES.items() for x in (m, gap))), F.col("measure"))
    fence = _middle("q3") + (_middle("q3") - _middle("q1")) * FENCE + margin
    return found.select(*keys, "measure", f"{name}_rows", fence.alias(name))


def _drawn(rows: str, own: str, above: Column) -> Column:
    """A group's fence, drawn to the one above as if ``WEIGHT`` rows more stood there: smooth in the group's size."""
    return (F.col(rows) * F.col(own) + WEIGHT * above) / (F.col(rows) + WEIGHT)


def thresholds(measured: DataFrame) -> DataFrame:
    """Per (lang, source): its rows, and a struct of upper thresholds per measure."""
    cells = F.array(*(F.struct(F.lit(m).alias("measure"), _bin(m).alias("bin")) for m in MEASURES))
    counted = measured.select("lang", "source", F.inline(cells)).groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))
    own = durable(counted)
    # The sketches of one language and of all are sums over groups, not over documents.
    langs = durable(own.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n")))
    everything = langs.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    of_lang = _fences(langs, ["lang"], "of_lang").withColumnsRenamed({"lang": "its_lang", "measure": "its_measure"})
    of_all = F.broadcast(_fences(everything, [], "of_all").drop("of_all_rows"))  # a row per measure
    levels = _fences(own, ["lang", "source"], "own").join(
        of_lang, F.col("lang").eqNullSafe(F.col("its_lang")) & (F.col("measure") == F.col("its_measure"))
    ).join(of_all, "measure")
    limit = _drawn("own_rows", "own", _drawn("of_lang_rows", "of_lang", F.col("of_all")))
    level = levels.select("lang", "source", "measure", F.col("own_rows").alias("rows"), limit.alias("limit"))
    found = level.groupBy("lang", "source").agg(
        F.max("rows").alias("group_rows"), F.struct(*(F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(m) for m in MEASURES)).alias("limit")
    )
    return durable(found)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the measures that failed."""
    of = {m: F.coalesce(F.expr(f"try_divide({e.replace(' / ', ', ')})"), F.lit(0.0)).alias(m) for m, (e, _) in MEASURES.items()}
    group = F.struct("lang", "source").alias("group")
    measured = durable(counts(docs).select("*", *of.values()))
    limits = thresholds(measured).select(group, "group_rows", "limit")
    joined = lookup(measured.withColumn("group", group), limits, "group", "group_rows")
    failed = F.array_compact(F.array(*(F.when(F.col(m) > F.col(f"limit.{m}"), F.lit(m)) for m in MEASURES)))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    judged = joined.select("*", base.alias("base_failed"), failed.alias("failed"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed",
    )
