"""Quality rules: a table of thresholds compiled into one projection. Built-in functions only; no shuffle, no Python."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefork.functions.arrays import let
from tracefork.llm.tables import free_name

WORDS = r"[^\x20\x09-\x0D]+"
NOT_WORDS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: The commonest function words of the four languages of the tables.
STOP_WORDS = (
    "the of and to in is that it for on with as are was be by this from or an a at not have "
    "der die das und ist von mit nicht auf für den ein eine im zu sich des dem in es "
    "le la les de des et est un une que qui pour dans sur en avec par au du ne pas "
    "el los las de del y que en un una por con para es se al no lo su"
).split()


@dataclass(frozen=True)
class Rule:
    """``scale * value`` must be at least ``low * base`` and at most ``high * base``; whole numbers, so nothing rounds.
    Where ``seen`` names a count, the rule is only for texts in which that is not 0."""

    name: str
    value: str
    base: str
    scale: int = 100
    low: int | None = None
    high: int | None = None
    seen: str | None = None


#: Rules that reject a text whatever else holds.
BASE_RULES = (
    Rule("words", "n_words", "one", scale=1, low=50),
    Rule("repeated words", "n_repeat_words", "n_words", high=50),
)
#: The other rules: length, symbol, stop-word and line ratios. A text without any of the stop words may be in a language
#: that the list doesn't know, so that rule is not for it.
RULES = (
    Rule("shortest mean word", "word_chars", "n_words", scale=1, low=2),
    Rule("longest mean word", "word_chars", "n_words", scale=1, high=15),
    Rule("symbols to words", "n_symbols", "n_words", high=30),
    Rule("stop words", "n_stop_words", "n_words", low=2, seen="n_stop_words"),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=40),
)


def verdict(rules: tuple[Rule, ...]) -> Column:
    """True where every rule of the table holds."""
    holds = F.lit(True)
    for rule in rules:
        value, own = F.col(rule.value) * rule.scale, F.lit(True)
        if rule.low is not None:
            own = own & (value >= F.col(rule.base) * rule.low)
        if rule.high is not None:
            own = own & (value <= F.col(rule.base) * rule.high)
        holds = holds & (own | (F.col(rule.seen) == 0) if rule.seen else own)
    return holds


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs at least twice in the text.

    Windows are sorted by their hash, so that equal ones are neighbours; the places of those, sorted again, tell how
    many words each adds.
    """

    def covered(hashed: Column) -> Column:
        def repeated(window: Column, i: Column) -> Column:
            same = lambda other: F.coalesce(other["h"] == window["h"], F.lit(False))
            return same(F.get(hashed, i - 1)) | same(F.get(hashed, i + 1))

        def count(places: Column) -> Column:
            gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
            return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

        return let(F.array_sort(F.transform(F.filter(hashed, repeated), lambda w: w["p"])), count)

    last = F.size(words) - 2
    windows = F.transform(
        F.sequence(F.lit(1), last),
        lambda p: F.struct(
            F.xxhash64(F.get(words, p - 1), F.get(words, p), F.get(words, p + 1)).alias("h"), p.alias("p")
        ),
    )
    return F.when(last >= 2, let(F.sort_array(windows), covered)).otherwise(F.lit(0))


def measure(text: Column) -> Column:
    """All counts of one text as a struct; null has none."""
    whole = F.coalesce(text, F.lit(""))
    stop = sorted(set(STOP_WORDS))

    def of_text(t: Column) -> Column:
        symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORDS))
        words = F.filter(F.split(t, NOT_WORDS), lambda w: w != "")
        return let(
            words,
            lambda w: let(
                lines,
                lambda ls: F.struct(
                    F.size(w).cast("bigint").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                    symbols.cast("bigint").alias("n_symbols"),
                    F.size(ls).cast("bigint").alias("n_lines"),
                    (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
                    repeated_words(w).cast("bigint").alias("n_repeat_words"),
                    F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("bigint").alias("n_stop_words"),
                    F.lit(1).cast("bigint").alias("one"),
                ),
            ),
        )

    return let(whole, of_text)


def judge_quality(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the struct ``quality``: the counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Nothing is dropped and rows don't depend on each other.
    The column gets a trailing underscore where ``docs`` has one of its name.
    """
    name, own = free_name(docs, "quality"), free_name(docs, "_measured")
    measured = docs.withColumn(own, measure(F.col("text")))

    def in_struct(table: tuple[Rule, ...]) -> Column:
        return verdict(
            tuple(Rule(r.name, f"{own}.{r.value}", f"{own}.{r.base}", r.scale, r.low, r.high, r.seen and f"{own}.{r.seen}") for r in table)
        )

    return measured.withColumn(
        name, F.struct(f"{own}.*", (~in_struct(base)).alias("base_failed"), (in_struct(base) & in_struct(rules)).alias("kept"))
    ).drop(own)


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns. Repeated rows stay as often as they come; null, empty and
    wordless texts go; an empty table stays empty."""
    judged = judge_quality(docs)
    name = judged.columns[-1]
    return judged.where(F.col(f"{name}.kept")).select(*docs.columns)
