"""Column functions of the exam model, built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at either end, as Python strips it (the Unicode class lacks four control characters).
_ENDS = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
_INNER = "(?U)[\\s\\x1c-\\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value computed once for a row however often `then` names it: written out, an expression is
    repeated at each place, and within lambdas Spark doesn't find what repeats."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def final_score(teacher="teacher_score", ai="ai_score") -> Column:
    """The teacher's score, else the model's, else null."""
    return F.coalesce(col(teacher), col(ai))


def final_score_or_zero(teacher="teacher_score", ai="ai_score") -> Column:
    return F.coalesce(col(teacher), col(ai), F.lit(0.0))


def type_or_essay(c="question_type") -> Column:
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit("essay"))


def has_text(c) -> Column:
    """Neither null nor empty; white space alone is text."""
    return F.coalesce(F.length(col(c)), F.lit(0)) > 0


def strip(c) -> Column:
    return F.regexp_replace(col(c), _ENDS, "")


def first_word(c) -> Column:
    """The first white-space token, '' where there is none."""
    return F.coalesce(F.get(F.split(strip(c), _INNER), F.lit(0)), F.lit(""))


def words(c) -> Column:
    """White-space tokens; none for blank text."""
    s = strip(c)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, _INNER))


def fold(c) -> Column:
    return F.upper(strip(c))


def clamp(c, low: float, high) -> Column:
    """Into [low, high]; null stays null."""
    return F.when(col(c).isNotNull(), F.greatest(F.lit(low), F.least(col(high) if isinstance(high, (str, Column)) else F.lit(high), col(c))))


def ratio(x, y) -> Column:
    """x / y where y > 0, else null."""
    return F.when(col(y) > 0, col(x) / col(y))


def number(c) -> Column:
    """A plain decimal number, else null."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def integer(c) -> Column:
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))


def found_in(term: str, *columns) -> Column:
    """Whether any column contains the term, without regard to case; % and _ stand for themselves."""
    hits = [F.coalesce(F.contains(F.lower(col(c)), F.lit(term.lower())), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, hits)


def band(c, limits: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first limit that the value reaches."""
    out = None
    for low, name in limits:
        out = (F if out is None else out).when(col(c) >= low, F.lit(name))
    return out.otherwise(F.lit(rest))


def percent_of(value, most) -> Column:
    """Percentage for a bar: 0 without a maximum, at most 100."""
    return F.when(col(most) > 0, F.least(F.lit(100.0), col(value) / col(most) * 100)).otherwise(F.lit(0.0))


def half_up(c) -> Column:
    """Rounded to a whole number, halves upwards."""
    return F.floor(col(c) + 0.5)


STEPS = ("draft", "submitted", "ocr_done", "graded")


def step_of(status) -> Column:
    """Place of a status in the life cycle, -1 if it has none."""
    return (F.coalesce(F.array_position(F.array(*map(F.lit, STEPS)), col(status)), F.lit(0)) - 1).cast("int")


def letter(i) -> Column:
    """A for 0, B for 1, ..."""
    return F.char(col(i) + 65)


def latin1(c) -> Column:
    return F.regexp_replace(col(c), "[^\\x00-\\xFF]", "?")


def cer(reference, given) -> Column:
    """Character error rate: edits for each character of the reference, 0 where it is empty; may exceed 1."""
    r, g = col(reference), col(given)
    return F.when(F.length(r) == 0, F.lit(0.0)).otherwise(F.levenshtein(r, g).cast("double") / F.length(r))


def wer(reference, given) -> Column:
    """Word error rate: each distinct word of the pair becomes one private character, then as cer()."""
    r, g = words(reference), words(given)
    vocabulary = F.array_distinct(F.concat(r, g))
    text = lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 0x4DFF), 4, "0")), "UTF-16BE")), "")
    return F.when(F.size(r) == 0, F.lit(0.0)).otherwise(F.levenshtein(text(r), text(g)).cast("double") / F.size(r))


def collapse_lines(c) -> Column:
    """White space within lines made single, blank lines dropped."""
    lines = F.transform(F.split(col(c), "\n"), lambda x: strip(F.regexp_replace(x, _INNER, " ")))
    return F.array_join(F.filter(lines, lambda x: F.length(x) > 0), "\n")


def choices_json(c) -> Column:
    """Choices parted by |, trimmed, blanks dropped, as a JSON list; null without any."""
    parts = F.filter(F.transform(F.split(col(c), "\\|"), strip), lambda x: F.length(x) > 0)
    return F.when(F.size(parts) > 0, F.to_json(parts))


def without_fences(c) -> Column:
    """Text without code fences at line starts and ends, stripped."""
    return strip(F.regexp_replace(col(c), "(?m)^\\x60{3}(?:json)?\\s*|\\s*\\x60{3}$", ""))


def mm_to_px(mm, dpi=200.0) -> Column:
    return (col(mm) * (col(dpi) if isinstance(dpi, (str, Column)) else F.lit(dpi)) / 25.4).cast("int")


def general(c) -> Column:
    """A number with up to six significant digits and no needless zeros, for sizes from 0.0001 to a million."""
    x = col(c).cast("double")
    unit = F.pow(F.lit(10.0), F.lit(5) - F.floor(F.log10(F.abs(x))))
    short = F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * unit) / unit)
    return F.regexp_replace(short.cast("string"), r"\.0$", "")


def percent(c) -> Column:
    """A share in whole percent, halves to the even number."""
    return F.concat(F.rint(col(c) * 100).cast("long").cast("string"), F.lit("%"))


def enrolment_label(name, ident) -> Column:
    """`name (#id)`, or `#id` without a name."""
    number = F.concat(F.lit("#"), col(ident).cast("string"))
    return F.coalesce(F.concat(col(name), F.lit(" ("), number, F.lit(")")), number)
