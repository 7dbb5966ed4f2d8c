"""Quality rules: a table of thresholds, compiled into one projection without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import GAP, col, fresh

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that was for on with by this at from be are as have "
    "de la le les des et un une du en que qui est dans pour sur pas au avec par "
    "der die das und zu den von mit ist nicht ein eine im dem auf sich auch es an sie "
    "el los las y con para del se por no su lo como al una"
).split()
SYMBOLS = "#*$%&|<>"
STRIPPED = ".,;:!?()\"'"


@dataclass(frozen=True)
class Rule:
    """A text fails the rule if ``feature`` is below ``least`` or above ``most``."""

    name: str
    feature: str
    least: float | None = None
    most: float | None = None


#: The thresholds. Ratios are to words, but for lines.
RULES = (
    Rule("too_few_words", "n_words", least=50),
    Rule("repeated_words", "repeat_word_ratio", most=0.5),
    Rule("word_length", "mean_word_chars", least=3.0, most=7.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_word_ratio", least=0.06),
    Rule("repeated_lines", "dup_line_ratio", most=0.4),
)
#: The rules that the contract calls base.
BASE = ("too_few_words", "repeated_words")

_LONG = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def compile_rules(rules: tuple[Rule, ...], feature: dict[str, Column]) -> Column:
    """The names of the failed rules, as one array expression."""
    tests = []
    for rule in rules:
        value = feature[rule.feature]
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (value < F.lit(rule.least))
        if rule.most is not None:
            bad = bad | (value > F.lit(rule.most))
        tests.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*tests))


def quality_rules(docs: DataFrame, text_col: str = "text", out_col: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a struct ``quality``: the features (long), ``failed`` (rule names) and ``kept``.

    Defined cases: a null text has no words and no lines, like an empty one, and fails the word
    count; texts of any length are taken whole; each row is judged alone, so ties and repeated rows
    do not matter; an empty table gives no rows; all other columns stay, and one named like
    ``out_col`` is replaced. No rows move between tasks.
    """
    keep = [c for c in docs.columns if c != out_col]
    words, lines, grams, places, feats, mark = fresh(docs, "words", "lines", "grams", "places", "features", "mark")
    text = F.coalesce(col(text_col), F.lit(""))
    one = docs.select(
        *[col(c) for c in keep],
        F.filter(F.split(text, GAP), lambda w: w != "").alias(words),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
    )
    # Windows of three words with their places, in the order of the words.
    two = one.withColumn(
        grams,
        F.expr(f"sort_array(IF(size({words}) < 3, CAST(array() AS array<struct<g:string,i:int>>), transform(slice({words}, 1, size({words}) - 2), (w, i) -> struct(concat(w, ' ', {words}[i + 1], ' ', {words}[i + 2]) AS g, i AS i))))"),
    )
    # Equal windows are neighbours now; the places at which they begin.
    three = two.withColumn(
        places,
        F.expr(f"array_sort(transform(filter(transform({grams}, (s, k) -> IF((k > 0 AND {grams}[greatest(k - 1, 0)].g = s.g) OR (k < size({grams}) - 1 AND {grams}[least(k + 1, size({grams}) - 1)].g = s.g), s.i, -1)), i -> i >= 0), i -> i))"),
    )
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    marks = STRIPPED.replace("'", "\\'")
    four = three.select(
        *[col(c) for c in keep],
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
            # A window covers its three words, less what the next one covers.
            F.expr(f"CAST(aggregate(transform({places}, (p, k) -> IF(k < size({places}) - 1, least(3, {places}[least(k + 1, size({places}) - 1)] - p), 3)), 0, (a, x) -> a + x) AS BIGINT)").alias("n_repeat_words"),
            F.expr(f"CAST(size(filter({words}, w -> translate(lower(w), '{marks}', '') IN ({stop}))) AS BIGINT)").alias("n_stop_words"),
            F.size(lines).cast("long").alias("n_lines"),
        ).alias(feats),
        # Never negative. It keeps a filter on the verdict above this projection: pushed below, the
        # filter would take in the arrays' expressions and sort all windows again for each window.
        F.monotonically_increasing_id().alias(mark),
    )
    f = {name: F.col(f"{feats}.{name}") for name in _LONG}
    per_word = F.greatest(f["n_words"], F.lit(1))
    f |= {
        "repeat_word_ratio": f["n_repeat_words"] / per_word,
        "mean_word_chars": f["word_chars"] / per_word,
        "symbol_ratio": f["n_symbols"] / per_word,
        "stop_word_ratio": f["n_stop_words"] / per_word,
        "dup_line_ratio": f["n_dup_lines"] / F.greatest(f["n_lines"], F.lit(1)),
    }
    failed = compile_rules(rules, f)
    return four.select(*[col(c) for c in keep], F.struct(*[f[name].alias(name) for name in _LONG], failed.alias("failed"), ((F.size(failed) == 0) & (F.col(mark) >= 0)).alias("kept")).alias(out_col))
