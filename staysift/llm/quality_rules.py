"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]"
BLANK_RUN = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Symbols, exclamation marks and capital letters, met in one pass over the text.
MARK = r"[#*$%&|<>!\p{Lu}]"
BULLET = r"^[ \t]*[-*•·‣]"
CUT = r"(\.\.\.|…)[\x20\x09-\x0D]*$"
# Up to so many repeated hashes are looked up window by window; for more, all windows are sorted.
FEW = 32
# Limits of the base rule.
LEAST_WORDS = 50
REPEATED_PERCENT = 50

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on are with as by this be at from or an have not "
    "der die das und ist nicht von mit den dem ein eine zu im auf für sich als auch es "
    "le la les des et un une en du est qui que dans pour pas au ce il elle par avec "
    "el los las de y no se con por para del su al lo una como más"
).split()
SPELLINGS = [*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures and the closed range it has to lie in; ``per`` None: the measure itself."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None

    def broken(self, measures: Column) -> Column:
        value = measures[self.measure].cast("double")
        if self.per:  # a text with nothing to divide by has a ratio of zero
            value = F.coalesce(value / F.nullif(measures[self.per], F.lit(0)), F.lit(0.0))
        low = F.lit(False) if self.least is None else value < F.lit(float(self.least))
        high = F.lit(False) if self.most is None else value > F.lit(float(self.most))
        return low | high


RULES = (
    Rule("length", "n_words", None, LEAST_WORDS, 500_000),
    Rule("word_length", "word_chars", "n_words", 2, 15),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("exclamations", "n_exclamations", "n_words", None, 0.1),
    Rule("capitals", "n_capitals", "word_chars", None, 0.3),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window of three words found twice or more.

    Sorted hashes tell which ones repeat: none in most texts. The windows with such a hash are sorted
    by it with their places, so equal ones are neighbours, and their words are compared there.
    """

    def of_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - 3)

        def same(x: Column, y: Column) -> Column:
            word = [F.get(words, x["i"] + k) == F.get(words, y["i"] + k) for k in range(3)]
            return (x["h"] == y["h"]) & word[0] & word[1] & word[2]

        def covered(s: Column) -> Column:
            again = F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x))
            each = F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
            return F.size(F.array_distinct(F.flatten(each)))

        def places(repeated: Column) -> Column:
            few = F.filter(starts, lambda i: F.array_contains(repeated, hashes[i]))
            some = F.when(F.size(repeated) <= FEW, few).otherwise(starts)
            placed = F.transform(some, lambda i: F.struct(hashes[i].alias("h"), i.alias("i")))
            return F.when(F.size(repeated) == 0, F.lit(0)).otherwise(let(F.sort_array(placed), covered))

        again = let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, k: x == F.get(s, k - 1)))
        return let(F.array_distinct(again), places)

    starts = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, of_hashes))


def measures(text: Column | str = "text") -> Column:
    """A struct of the counts that rules are made of, as one expression; a null text counts as empty.

    n_words, word_chars (code points), n_symbols, n_exclamations, n_capitals, n_stop_words,
    n_repeat_words, n_lines (with a word), n_dup_lines (equal to an earlier line), n_bullet_lines
    (begin with a bullet), n_cut_lines (end with three dots). All are longs.
    """

    def of_text(t: Column) -> Column:
        def counts(words: Column, lines: Column, marks: Column) -> Column:
            found = {
                "n_words": F.size(words),
                "word_chars": F.length(F.array_join(words, "")),
                "n_symbols": F.size(F.filter(marks, lambda m: m.isin([*SYMBOLS]))),
                "n_exclamations": F.size(F.filter(marks, lambda m: m == "!")),
                "n_capitals": F.size(F.filter(marks, lambda m: ~m.isin([*SYMBOLS, "!"]))),
                "n_stop_words": F.size(F.filter(words, lambda w: w.isin(SPELLINGS))),
                "n_repeat_words": _repeat_words(words),
                "n_lines": F.size(lines),
                "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
                "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(BULLET))),
                "n_cut_lines": F.size(F.filter(lines, lambda x: x.rlike(CUT))),
            }
            return F.struct(*[c.cast("long").alias(n) for n, c in found.items()])

        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        marks = F.regexp_extract_all(t, F.lit(MARK), F.lit(0))
        return let(_words(t), lambda w: let(lines, lambda x: let(marks, lambda m: counts(w, x, m))))

    col = F.col(text) if isinstance(text, str) else text
    return let(F.coalesce(col, F.lit("")), of_text)


def base_failed(found: Column) -> Column:
    """True for texts of under LEAST_WORDS words, or with over half of them in repeated windows."""
    few = found["n_words"] < LEAST_WORDS
    return few | (100 * found["n_repeat_words"] > REPEATED_PERCENT * found["n_words"])


def failed_rules(found: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The names of the rules that a struct of measures breaks, in the order of the table."""
    names = [F.when(r.broken(found), F.lit(r.name)) for r in rules]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def judge(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, into: str = "quality"
) -> DataFrame:
    """All rows and columns, and a struct ``into``: the measures, ``base_failed``, ``failed``, ``kept``.

    One projection, no shuffle. A null or empty text has no words and fails; repeated rows are judged
    alike and all stay; an empty table gives an empty table. Where ``docs`` has a column ``into``
    (in any case), the struct is named with an underscore more, until the name is free. A text is held in memory
    with its words and windows (about 40 times its bytes), rows one by one.
    """
    taken = {c.lower() for c in docs.columns}
    while into.lower() in taken:
        into += "_"
    found = docs.withColumn(into, measures(docs[text]))
    told = F.col(into)
    found = found.withColumn(
        into, told.withField("base_failed", base_failed(told)).withField("failed", failed_rules(told, rules))
    )
    kept = ~F.col(into)["base_failed"] & (F.size(F.col(into)["failed"]) == 0)
    return found.withColumn(into, F.col(into).withField("kept", kept))


def keep(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass the base rule and all rules, with exactly their own columns."""
    judged = judge(docs, text, rules)
    name = judged.columns[-1]
    return judged.where(F.col(name)["kept"]).drop(name)
