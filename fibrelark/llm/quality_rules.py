"""Quality rules: one table of thresholds, compiled into one projection of built-in functions.

No user function runs: words, lines, repeated word windows and stop words are
counted with array functions in projections over the scan, and the table of
thresholds becomes one projection over the counts, so the plan has no exchange and
no Python.

Defined results: a null or blank text has no words, so it fails the base rule and
is not kept; very long texts are measured whole; a null doc_id passes through;
repeated rows and ties are judged each by itself; an empty table gives an empty
result; further columns are ignored by ``measure`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrelark.llm.common import WHITE, WHITE_CLASS

# Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with a an in is it for on as by this from was are or "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et en un une du que dans est pour par sur au il ne se "
    "el los las del y una con por para al lo como más su no"
).split()

WINDOW = 8
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop")


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= value <= high``, or if it is shorter than ``from_words``.

    ``value`` is a SQL expression over the measured columns.
    """

    name: str
    value: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


# The verdict beyond the base rule. Ratios of very short texts say little, hence from_words.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "word_chars / n_words", low=2.0, high=20.0),
    Rule("symbols_per_word", "n_symbols / n_words", high=0.5),
    Rule("duplicate_lines", "n_dup_lines / n_lines", high=0.3),
    Rule("stop_words", "n_stop / n_words", low=0.02, from_words=50),
)


def _words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WHITE_CLASS)).otherwise(F.array().cast("array<string>"))


def _joined(hashes: str, reach: int) -> Column:
    """From hashes of stretches those of stretches longer by ``reach`` words, at the same starts."""
    return F.transform(F.col(hashes), lambda h, i: F.xxhash64(h, F.get(F.col(hashes), i + reach)))


def _repeated_starts() -> Column:
    """Starts of windows that are there twice or more, in order; __sorted has (hash, start) by hash."""
    rows = F.col("__sorted")
    same = F.transform(
        rows,
        lambda entry, k: F.when(
            ((k > 0) & (F.get(rows, k - 1)["h"] == entry["h"])) | F.coalesce(F.get(rows, k + 1)["h"] == entry["h"], F.lit(False)), entry["i"]
        ),
    )
    return F.sort_array(F.filter(same, lambda i: i.isNotNull()))


def _covered() -> Column:
    """Words below those windows: a fold over the starts, each adds what lies beyond the end so far."""
    return F.aggregate(
        "__starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + F.lit(WINDOW) - F.greatest(acc["end"], i)).alias("n"), (i + F.lit(WINDOW)).alias("end")),
        lambda acc: acc["n"],
    )


def _counted(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and a struct __m of all counts. Each select names what the next uses more than once, so nothing is evaluated twice.

    Hashes of eight words come by doubling: two, four and eight words from halves.
    """
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(WHITE))) > 0)
    count = lambda column, name: column.cast("long").alias(name)
    names = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_stop"]
    return (
        # The text comes under a name of its own, so that a column called like a count cannot clash.
        docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
        .select(*keep, "__text", _words(text).alias("__words"), lines.alias("__lines"))
        .select(
            *keep,
            count(F.size("__words"), "n_words"),
            count(F.length(F.translate(text, WHITE, "")), "word_chars"),
            count(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), "n_symbols"),
            count(F.size("__lines") - F.size(F.array_distinct("__lines")), "n_dup_lines"),
            count(F.size("__lines"), "n_lines"),
            count(F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))), "n_stop"),
            F.when(F.size("__words") > WINDOW, F.transform("__words", lambda w: F.xxhash64(w))).alias("__one"),
        )
        .select(*names, _joined("__one", 1).alias("__two"))
        .select(*names, _joined("__two", 2).alias("__four"))
        .select(*names, F.slice(_joined("__four", 4), F.lit(1), F.greatest(F.lit(0), F.size("__four") - F.lit(WINDOW - 1))).alias("__windows"))
        .select(
            *names,
            F.when(
                F.size(F.array_distinct("__windows")) < F.size("__windows"),
                F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ).alias("__sorted"),
        )
        .select(*names, _repeated_starts().alias("__starts"))
        # A row number in the struct bars the optimizer from moving a filter on the counts
        # below them, where it would repeat the measurement for each use of a count.
        .select(
            *keep,
            F.struct(*names[len(keep) :], count(F.coalesce(_covered(), F.lit(0)), "n_repeat_words"), F.monotonically_increasing_id().alias("row")).alias("__m"),
        )
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The table as one boolean column over the measured columns; no words pass no rule."""
    verdict = F.col("n_words") > 0
    for rule in rules:
        value = F.expr(f"try_divide({rule.value.split('/')[0]}, {rule.value.split('/')[1]})") if "/" in rule.value else F.expr(rule.value)
        holds = F.lit(True)
        if rule.low is not None:
            holds = holds & (value >= F.lit(rule.low))
        if rule.high is not None:
            holds = holds & (value <= F.lit(rule.high))
        verdict = verdict & ((F.col("n_words") < F.lit(rule.from_words)) | F.coalesce(holds, F.lit(True)))
    return verdict


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and verdict of every document: ``keep`` columns, the counts, base_failed, kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = _counted(docs, keep).select(*keep, *[F.col(f"__m.{name}").alias(name) for name in COUNTS])
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & compile_rules(rules))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text"))
    return measure(packed, rules, keep=("__doc",)).filter("kept").select("__doc.*")
