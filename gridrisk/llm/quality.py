"""Quality rules whose cutoffs follow the corpus: quantile sketches per language and source.

Column functions only. Each text is measured where it stands; the measures of a group go into
mergeable KLL sketches map-side, the sketches of a group merge into those of its language and of
the whole corpus, and every row meets the cutoffs of its group in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridrisk.llm.text import named_back, numbered, place
from gridrisk.session import cut_lineage

WINDOW = 8  # words of the windows that repeat
SKETCH = 400  # KLL size: about 0.7% rank error
LEAST_ROWS = 200  # a group with fewer rows takes the cutoffs of its language, then the corpus'
SPREADS = 3.0  # cutoff: the upper quartile and so many times the spread between the quartiles
#: Measures and the least spread each may get, so that a group without spread rejects no ordinary text.
MEASURES = {"symbol_ratio": 0.02, "dup_line_share": 0.05, "repeat_share": 0.05, "echo_share": 0.02, "word_length": 0.5}
#: Measures with a lower cutoff too, so many spreads under the lower quartile; of the others less is never worse.
LOWER = ("word_length",)
BASE_WORDS, BASE_REPEAT_PERCENT = 20, 30

_GAP = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words: longest runs without blanks, tabs, line feeds and the like."""
    return F.array_remove(F.split(F.regexp_replace(text, f"{_GAP}+", " "), " "), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))
    return bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that stand twice or more in the text.

    A window is the 64-bit hash of its words' hashes. Texts without a repeated window, nearly all,
    end at the comparison of two sizes; in the others the windows are sorted beside their places.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda k: F.xxhash64(F.slice(h, k, window)))

    def covered(places: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda k: F.least(places[k] - places[k - 1], F.lit(window)))
        return (F.aggregate(steps, F.lit(0), lambda a, b: a + b) + window).cast("long")

    def repeated(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, k: F.struct(x.alias("w"), k.alias("k"))))

        def places(p: Column) -> Column:
            last = F.size(p) - 1
            twice = F.filter(F.sequence(F.lit(0), last), lambda k: (p[F.greatest(k - 1, F.lit(0))]["w"] == p[k]["w"]) & (k > 0) | (p[F.least(k + 1, last)]["w"] == p[k]["w"]) & (k < last))
            return F.sort_array(F.transform(twice, lambda k: p[k]["k"]))

        return bound(pairs, lambda p: bound(places(p), covered))

    found = bound(hashes, lambda h: bound(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(repeated(w))))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(found)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the counts of their texts; n_echoes are words equal to the word before."""
    whole = F.coalesce(F.col(text), F.lit(""))
    listed = docs.withColumn("_words", words_of(whole))
    return listed.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(whole, f"{_GAP}+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        duplicate_lines(whole).alias("n_dup_lines"),
        F.size(F.filter(F.split(whole, "\n"), lambda line: line.rlike(_WORD))).cast("long").alias("n_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w, k: (k > 0) & (w == F.col("_words")[F.greatest(k - 1, F.lit(0))]))).cast("long").alias("n_echoes"),
    )


def ratios() -> list[Column]:
    """The measures that get cutoffs, of measured rows."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return [(F.col("n_symbols") / words).alias("symbol_ratio"), (F.col("n_dup_lines") / lines).alias("dup_line_share"), (F.col("n_repeat_words") / words).alias("repeat_share"), (F.col("n_echoes") / words).alias("echo_share"), (F.col("word_chars") / words).alias("word_length")]


def cutoffs(rows: DataFrame, keys: tuple[str, str] = ("lang", "source"), least_rows: int = LEAST_ROWS, spreads: float = SPREADS, size: int = SKETCH) -> DataFrame:
    """Per key pair a cutoff `max_<measure>`, for some `min_<measure>` too, from merged quantile sketches.

    Sketches of the pairs merge into those of the first key and of all rows, which stand in for a
    pair with fewer than `least_rows` rows; nulls among the keys are a group like any other.
    """
    one, two = keys
    sketches = rows.groupBy(one, two).agg(F.count("*").alias("n"), *[F.expr(f"kll_sketch_agg_double({m}, {size})").alias(m) for m in MEASURES])
    sketches = cut_lineage(sketches, "quality-sketches")
    quartiles = (0.25, 0.75)
    merged = [F.expr(f"kll_merge_agg_double({m}, {size})").alias(f"m_{m}") for m in MEASURES]
    # two numbers a measure for the whole corpus; sketches of no rows have no quantiles
    some = sketches.limit(1).count() > 0
    whole = sketches.agg(*merged).select([F.kll_sketch_get_quantile_double(f"m_{m}", F.lit(q)).alias(f"{m}_{q}") for m in MEASURES for q in quartiles]).first() if some else {f"{m}_{q}": None for m in MEASURES for q in quartiles}
    first = sketches.groupBy(F.col(one).alias("one")).agg(F.sum("n").alias("m_n"), *merged)
    joined = sketches.join(first, F.col(one).eqNullSafe(F.col("one")), "left")

    def cutoff(measure: str) -> list[Column]:
        own, wider = F.col(measure), F.col(f"m_{measure}")
        low, high = (F.when(F.col("n") >= least_rows, F.kll_sketch_get_quantile_double(own, F.lit(q))).when(F.col("m_n") >= least_rows, F.kll_sketch_get_quantile_double(wider, F.lit(q))).otherwise(F.lit(whole[f"{measure}_{q}"]).cast("double")) for q in quartiles)
        reach = spreads * F.greatest(high - low, F.lit(MEASURES[measure]))
        return [(high + reach).alias(f"max_{measure}"), *[(low - reach).alias(f"min_{measure}")] * (measure in LOWER)]

    return joined.select(one, two, *[c for m in MEASURES for c in cutoff(m)])


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True, **options) -> DataFrame:
    """All rows and columns of `docs`, with a struct `_quality` of counts, base_failed and kept.

    A row fails the base rules with under 20 words or over 30 % of its words in repeated windows;
    it is kept if it passes them and no measure is beyond its group's cutoffs. Null and empty texts
    have no words and fail. Null languages and sources are groups of their own; repeated rows
    are judged alike; an empty table gives an empty one. Other columns may have any names.
    """
    base = numbered(docs)
    at, groups = place(docs, text), (place(docs, lang), place(docs, source))
    rows = measured(base, at)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = rows.select(*[c for c in base.columns if keep_text or c != at], *counts, *ratios())
    rows = cut_lineage(rows, "quality-measures")
    limits = cut_lineage(cutoffs(rows, groups, **options), "quality-cutoffs")
    limits = limits.withColumnsRenamed({groups[0]: "g_lang", groups[1]: "g_source"})
    # the cutoffs are one row a group; Spark broadcasts them by their written size, or splits hot groups
    met = rows.join(limits, F.col(groups[0]).eqNullSafe(F.col("g_lang")) & F.col(groups[1]).eqNullSafe(F.col("g_source")), "left")
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    beyond = F.lit(False)
    for measure in MEASURES:
        beyond = beyond | (F.col(measure) > F.col(f"max_{measure}"))
    for measure in LOWER:
        beyond = beyond | (F.col(measure) < F.col(f"min_{measure}"))
    verdict = F.struct(*counts, failed.alias("base_failed"), (~failed & ~beyond).alias("kept"), *[f"max_{m}" for m in MEASURES], *[f"min_{m}" for m in LOWER])
    return met.select(*named_back(docs, verdict.alias("_quality"), skip=() if keep_text else (text,)))


def passing(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are kept, with their columns as they came."""
    return judged(docs, **options).where("_quality.kept").drop("_quality")


def digest(docs: DataFrame) -> DataFrame:
    found = judged(docs.select("doc_id", "text", "lang", "source"), keep_text=False)
    return found.select("doc_id", *[F.col(f"_quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
