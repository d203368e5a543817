"""Quality rules: a table of thresholds compiled into one Spark projection; DataFrame functions only.

A rule bounds a ratio of two measures in percent: mean word length, symbols and marks a word, stop words a word, repeated
lines, lines a word, lines that end in an ellipsis or begin with a bullet. The measures and all rules are columns of one
projection over the scan: no shuffle, no state, no function of Python, and rows are judged one by one wherever they are.

Repeated three-word windows are found within a row: its windows are sorted as (word, word, word, place), and those equal to
a neighbour cover the words that count. This is exact, and a text of n words takes n log n comparisons. Texts of which all
windows have different hashes repeat none and are not sorted.

Defined results: a null text has no words; without words every ratio is undefined, no rule of the table fails and the
word count rejects the row; rows that share a doc_id are judged one by one; other columns are carried along whatever they
are called; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
MIN_WORDS = 50
MAX_REPEATED = 50

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to a in is that it for was on with as be by this are at from or an not but have has had were which their they
der die und in den von zu das mit sich des ein auf für ist im nicht dem eine als auch es an werden aus er hat dass sie
de la le et les des en un du une que pour est par qui dans avec sur pas au plus ne ce il sont aux se son
el y los se del las por con no su para al lo como más o pero sus ha este una
""".split()  # noqa: SIM905


class Rule(NamedTuple):
    """``least <= 100 * part / whole <= most``, where ``whole`` is not 0; None is no bound."""

    name: str
    part: str
    whole: str
    least: int | None
    most: int | None


#: The table. Bounds are percent.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 300, 1000),
    Rule("symbols_a_word", "n_symbols", "n_words", None, 10),
    Rule("marks_a_word", "n_marks", "n_words", None, 50),
    Rule("stop_words_a_word", "n_stop", "n_words", 8, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("lines_a_word", "n_lines", "n_words", None, 50),
    Rule("ellipsis_lines", "n_ellipsis", "n_lines", None, 40),
    Rule("bullet_lines", "n_bullet", "n_lines", None, 90),
)


def stop_forms(words: list[str] = STOP_WORDS) -> list[str]:
    """Each stop word in lower case, with a capital, and in capitals."""
    return sorted({f for w in words for f in (w, w.capitalize(), w.upper())})


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _size(x: Column) -> Column:
    return F.size(x).cast("long")


def _bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` bound to a variable: made once, also where the planner moves the expression into a filter."""
    return F.transform(F.array(x), body)[0]


def _field(x: Column, i: int) -> Column:
    return x.getField(str(i))


def _equal(p: Column) -> Column:
    a, b = _field(p, 0), _field(p, 1)
    return (_field(a, 0) == _field(b, 0)) & (_field(a, 1) == _field(b, 1)) & (_field(a, 2) == _field(b, 2))


def _covered(p: Column) -> Column:
    a, b = _field(_field(p, 0), 3), _field(_field(p, 1), 3)
    return F.array(a, a + 1, a + 2, b, b + 1, b + 2)


def _repeated(w: Column) -> Column:
    m = F.greatest(F.size(w) - 2, F.lit(0))
    places = F.sequence(F.lit(1), F.greatest(m, F.lit(1)))
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
    suspect = (m > 1) & (F.size(F.array_distinct(hashes)) < m)
    windows = F.sort_array(F.arrays_zip(F.slice(w, 1, m), F.slice(w, 2, m), F.slice(w, 3, m), places))
    twins = _bound(windows, lambda s: F.filter(F.arrays_zip(F.slice(s, 1, m - 1), F.slice(s, 2, m - 1)), _equal))
    return F.when(suspect, _size(F.array_distinct(F.flatten(F.transform(twins, _covered))))).otherwise(F.lit(0).cast("long"))


def repeated_words(w: Column) -> Column:
    """Words of an array in three-word windows that occur in it twice or more."""
    return _bound(w, _repeated)


def measured(documents: DataFrame) -> DataFrame:
    """``carried`` (the row) and its measures."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.struct("*").alias("carried"), text.alias("text"))
    rows = rows.select("carried", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    kept_of = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]+", "")).cast("long")
    n = _size(F.col("w"))
    return rows.select(
        "carried",
        n.alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        kept_of("#*$%&|<>").alias("n_symbols"),
        kept_of("!?").alias("n_marks"),
        _size(F.filter(F.split("text", r"[\x20\x09-\x0D.,;:!?]+"), lambda x: x.isin(stop_forms()))).alias("n_stop"),
        _size(F.col("lines")).alias("n_lines"),
        (_size(F.col("lines")) - _size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z"))).alias("n_ellipsis"),
        _size(F.filter("lines", lambda x: x.rlike(r"\A[\x20\x09-\x0D]*[-*•]"))).alias("n_bullet"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )


def failed(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of measures fails."""
    out = []
    for r in rules:
        low = 100 * F.col(r.part) < r.least * F.col(r.whole) if r.least is not None else F.lit(False)
        high = 100 * F.col(r.part) > r.most * F.col(r.whole) if r.most is not None else F.lit(False)
        out.append(F.when((F.col(r.whole) > 0) & (low | high), F.lit(r.name)))
    return F.array_compact(F.array(*out))


def judged(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``carried``, the measures, ``base_failed``, ``failed`` (names of rules) and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    found = measured(documents).withColumns({"base_failed": base, "failed": failed(rules)})
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
