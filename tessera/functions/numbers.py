"""Quantities in texts: digits with groups and scales, number words, and checks of written calculations."""

from __future__ import annotations

import re
from bisect import bisect
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Number words, ordinals and scales.
UNITS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20), strict=True)) | dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10), strict=True))
ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11, "twelfth": 12, "fifteenth": 15, "twentieth": 20, "thirtieth": 30}
SCALES = {"thousand": 1_000, "lakh": 100_000, "million": 1_000_000, "crore": 10_000_000, "billion": 1_000_000_000}

# The words before the number of a legal reference, and the ordinals of schedules.
LEGAL = set("section sections sub-section sub-sections clause clauses sub-clause sub-clauses rule rules sub-rule sub-rules chapter chapters division divisions paragraph paragraphs article articles item items serial u/s".split())
LINKS = {",", "or", "and", "to", "through", "of"}
SCHEDULES = set("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth".split())

#: The kind of each word: unit, ordinal, hundred, scale, and the words of "and a half"; "." for any other.
_KIND = dict.fromkeys(UNITS, "u") | dict.fromkeys(ORDINALS, "o") | dict.fromkeys(SCALES, "s") | {"hundred": "h", "and": "&", "a": "a", "half": "f"}
#: A number phrase in a string of kinds: an ordinal alone, or units, hundreds and scales, with "and" only between a scale
#: or hundred and a unit; an ordinal may end it, but not right after a scale.
_PHRASE = re.compile("o|[uh](?:[uhs]|&af|(?<=[sh])&(?=u))*(?:(?<![sh])o)?")


def _below_scale(words: list[str]) -> float:
    """The value of words without scales: a hundred multiplies what stands before it (one where nothing does)."""
    def add(value: float, word: str) -> float:
        if word == "hundred":
            return (value or 1) * 100
        return value + (0.5 if word == "half" else UNITS.get(word, ORDINALS.get(word, 0)))

    return reduce(add, words, 0.0)


def phrase_values(words: list[str]) -> list[float]:
    """The value of a number phrase, after the values that it has before each of its scales: ten million is 10 and
    10,000,000."""
    total, part, before = 0.0, [], []
    for word in words:
        if word in SCALES:
            before.append(total + _below_scale(part))
            total, part = total + _below_scale(part) * SCALES[word], []
        else:
            part.append(word)
    return [*before, total + _below_scale(part)]


def word_numbers(text: str, skip_lone_one: bool = False) -> set[float]:
    """"one hundred and eighty-three" is 183, "ten million" 10 and 10,000,000, "first" 1. No number spans punctuation."""
    found: set[float] = set()
    for part in re.split(r"[;:,.()]", text.lower()):
        words = re.findall("[a-z]+", part)
        kinds = "".join(_KIND.get(w, ".") for w in words)
        for m in _PHRASE.finditer(kinds):
            values = phrase_values(words[m.start() : m.end()])
            lone_one = m.end() - m.start() == 1 and values == [1.0]
            found.update([] if lone_one and skip_lone_one else values)
    return found


_NEXT_WORD = re.compile(r"\s*([A-Za-z]+)")


def _grouped(whole: str) -> bool:
    """Whether commas stand between groups of digits as thousands or lakhs do."""
    head, *groups = whole.split(",")
    return len(head) <= 3 and all(2 <= len(g) <= 3 for g in groups)


def digit_numbers(text: str) -> set[float]:
    """What stands in digits: commas that group, as in 12,500 or 3,75,000, are dropped, and a number before lakh, million
    and the like counts both as it stands and times that scale. Digits that go on from a letter (v2) are none."""
    found: set[float] = set()
    for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*", text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        whole, *decimals = m[0].split(".")
        numbers = [whole.replace(",", "")] if _grouped(whole) else whole.split(",")
        numbers[-1] += f".{decimals[0].split(',')[0]}" if decimals else ""
        found.update(map(float, numbers))
        after = _NEXT_WORD.match(text, m.end())
        for scale, times in SCALES.items():
            if after and scale != "thousand" and after[1].lower().startswith(scale):
                found.add(float(numbers[-1]) * times)
    return found


def without_legal_references(text: str) -> str:
    """A text without the numbers of sections, clauses, schedules and the like, which are no quantities."""
    parts = re.findall(r"u/s|[A-Za-z]+(?:-[A-Za-z]+)*|\(?[0-9]+[A-Z]*\)?|\([a-z]+\)|[0-9.,]+|\s+|.", text, re.S)
    out, at = [], 0

    def skip_blanks(i: int) -> int:
        while i < len(parts) and parts[i].isspace():
            i += 1
        return i

    while at < len(parts):
        word, then = parts[at].lower(), skip_blanks(at + 1)
        if word in SCHEDULES and then < len(parts) and parts[then].lower() == "schedule":
            at = then + 1
            continue
        if word not in LEGAL:
            out.append(parts[at])
            at += 1
            continue
        end = at + 1
        while then < len(parts) and re.fullmatch(r"\(?[0-9]+[A-Z]*\)?|\([a-z]+\)", parts[then]):
            end = then + 1
            then = skip_blanks(end)
            if then < len(parts) and parts[then].lower() in LINKS:
                then = skip_blanks(then + 1)
        out.append(" ")
        at = end
    return "".join(out)


def numbers_in(text: str, skip_lone_one: bool = False, legal: bool = True) -> set[float]:
    """All quantities of a text; amendment brackets count for nothing, legal references only if `legal`."""
    text = re.sub(r"[\[\]]", " ", text or "")
    text = text if legal else without_legal_references(text)
    return digit_numbers(text) | word_numbers(text, skip_lone_one)


class _Sum:
    """A written calculation, read from left to right: sums of products of signed numbers, percentages and brackets."""

    SIGNS = {"x": "*", "X": "*", "×": "*", "−": "-", "–": "-"}

    def __init__(self, text: str):
        self.parts = re.findall(r"[0-9]+(?:\.[0-9]+)?|\S", text.replace(",", "").replace("Rs.", "").replace("Rs", ""))
        self.parts = [self.SIGNS.get(p, p) for p in self.parts]
        self.at = 0

    def next(self, *wanted: str) -> str | None:
        if self.at < len(self.parts) and self.parts[self.at] in wanted:
            self.at += 1
            return self.parts[self.at - 1]
        return None

    def sum(self) -> float:
        value = self.product()
        while sign := self.next("+", "-"):
            value += self.product() if sign == "+" else -self.product()
        return value

    def product(self) -> float:
        value = self.number()
        while sign := self.next("*", "/"):
            value = value * self.number() if sign == "*" else value / self.number()
        return value

    def number(self) -> float:
        if self.next("-"):
            return -self.number()
        if self.next("("):
            value = self.sum()
            if not self.next(")"):
                raise ValueError("open bracket")
        elif self.at < len(self.parts) and self.parts[self.at][0] in "0123456789":
            value = float(self.parts[self.at])
            self.at += 1
        else:
            raise ValueError("no number")
        return value / 100 if self.next("%") else value


def calculate(text: str) -> float | None:
    """The value of a written calculation ("5% x 200,000"); None if it is none. Nothing but arithmetic is evaluated."""
    reader = _Sum(text)
    try:
        value = reader.sum()
    except (ValueError, ZeroDivisionError, RecursionError):
        return None
    return value if reader.at == len(reader.parts) else None


def calculated(text: str) -> set[float]:
    """What a text works out itself: the right side of each equation whose left side comes to it, half a rupee more or less."""
    found = set()
    for line in re.split(r"[;:]|[.]\s", re.sub(r"Rs[.]\s*", "", text)):
        left, equals, right = line.rpartition("=")
        result = re.match(r"\s*([0-9][0-9,]*(?:[.][0-9]+)?)", right)
        sums = re.search(r"[0-9.,%xX×*/+()\s−–-]+$", left)
        value = calculate(sums[0]) if equals and result and sums else None
        if value is not None and abs(value - float(result[1].replace(",", ""))) <= 0.5:
            found.add(float(result[1].replace(",", "")))
    return found


def far_from(values: set[float], known: set[float], apart: float = 1e-9) -> list[float]:
    """The values, in order, that lie at least `apart` from every known one: each is looked up among its two neighbours."""
    places = sorted(known)
    out = []
    for value in sorted(values):
        at = bisect(places, value)
        if all(abs(value - near) >= apart for near in places[max(0, at - 1) : at + 1]):
            out.append(value)
    return out


def missing_numbers(answer: str, source: str, question: str, year: int | None) -> list[float]:
    """The quantities of an answer that neither its source nor the question has and that it does not work out; the
    question's own tax year is none."""
    own = re.sub(rf"(?i)\btax years?\s+{year}\b", "", answer or "") if year else answer or ""
    claimed = numbers_in(own, skip_lone_one=True, legal=False)
    return far_from(claimed, numbers_in(source) | numbers_in(question) | calculated(own)) if claimed else []


@F.pandas_udf(ArrayType(DoubleType()))
def _numbers(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(numbers_in(t)))


@F.pandas_udf(ArrayType(DoubleType()))
def _missing(answers: pd.Series, sources: pd.Series, questions: pd.Series, years: pd.Series) -> pd.Series:
    return pd.Series([missing_numbers(*r[:3], None if pd.isna(r[3]) else int(r[3])) for r in zip(answers, sources, questions, years, strict=True)])


@F.pandas_udf(DoubleType())
def calculate_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: calculate(t or "")).astype("float64")


def may_have_numbers(text: Column) -> Column:
    """Whether a text has a digit or a number word: only such texts need to be read by Python."""
    return F.coalesce(text.rlike(r"[0-9]|(?i)\b(?:" + "|".join([*UNITS, *ORDINALS, "hundred"]) + r")\b"), F.lit(False))


def numbers_udf(text: Column) -> Column:
    """The sorted quantities of each text; an empty list for null."""
    return F.when(may_have_numbers(text), _numbers(text)).otherwise(F.array().cast("array<double>"))


def missing_numbers_udf(answer: Column, source: Column, question: Column, year: Column) -> Column:
    """An empty list where the answer has neither a digit nor a number word: such answers never reach Python."""
    return F.when(may_have_numbers(answer), _missing(answer, source, question, year)).otherwise(F.array().cast("array<double>"))
