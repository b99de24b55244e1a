"""Rules on texts as tables of phrases: a text becomes one line of tokens, and phrases are looked for in it.

A line has a blank on either side of every token, so that a phrase can be matched with its own blanks and neighbouring
matches never share one: "u/s 149" is " u  /  s  149 ". A token is a number with its letters, a word, or any other
character that is no white space. The patterns need no lookaround, so SQL engines with plain regular expressions can
run them too.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[0-9]+[A-Za-z]*|[\p{L}\p{M}_]+|[^\s\p{L}\p{M}\p{N}_]"


def token_line(text: Column) -> Column:
    """The tokens of a text in one line, as they are written."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), "  "), F.lit(" "))


def spaced(phrase: str) -> str:
    """A phrase of tokens as a pattern for a line, without its outer blanks."""
    plain = "".join(f"\\{c}" if c in r".^$|()[]{}*+?\-/" else c for c in phrase)
    return "  ".join(plain.split())


def one_of(phrases: Iterable[str]) -> str:
    return "(?:" + "|".join(spaced(p) for p in phrases) + ")"


def phrase_pattern(phrases: Iterable[str]) -> str:
    """Any of the phrases; one that ends in `*` may go on in its last word."""
    ends = [f" {spaced(p[:-1])}" if p.endswith("*") else f" {spaced(p)} " for p in phrases]
    return "|".join(ends)


def near_pattern(first: Iterable[str], last: Iterable[str], between: int) -> str:
    """One of the first phrases, then one of the last ones, with at most so many tokens between them."""
    return rf" {one_of(first)}  (?:[^ ]+  ){{0,{between}}}{one_of(last)} "


def says(line: Column, phrases: Iterable[str]) -> Column:
    return line.rlike(phrase_pattern(phrases))


def holds(text: Column, parts: Iterable[str]) -> Column:
    """Any of the parts anywhere in the text, white space left out: for scripts that join words freely."""
    squeezed = F.regexp_replace(text, r"\s+", "")
    return reduce(or_, [F.contains(squeezed, F.lit(p.replace(" ", ""))) for p in parts])
