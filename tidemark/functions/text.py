"""Text normalisation and matching keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import udfs

# Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
LEET_PAIR = ("}{", "h")
# Cyrillic, then Greek letters that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "α": "a", "ο": "o",
}
# Fixed value: runs of two or more combining marks.
COMBINING = r"[̀-ͯ҉᷀-᷿⃐-⃿︠-︯]{2,}"
# Letters written as digits.
FORWARD_LEET = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5", "t": "7"}
MAX_LONG = 2**63 - 1


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_html(c: Column, closed: bool = False) -> Column:
    """Character references first, then tags to spaces. closed: a reference without a semicolon, as at a page's cut, stays."""
    return strip(F.regexp_replace(udfs.html_unescape(c, closed), r"<[^>]+>", " "))


def clean_body(c: Column, normalise: bool = True) -> Column:
    """Compatibility form, lower case, without quote arrows at line starts, white space folded."""
    c = udfs.nfkc(c) if normalise else c
    return fold_space(F.regexp_replace(F.lower(c), r"(?md)^>{1,3}\s*", ""))


def reply_ids(c: Column) -> Column:
    """Numbers after `>>`; those beyond a long are dropped, none gives an empty array."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r">>(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<bigint>"))


def tokens(c: Column, least: int = 1) -> Column:
    """Lower-case words of `least` characters or more."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"(?U)\b\w{{{least},}}\b"), F.lit(0))


def deleet(c: Column) -> Column:
    return F.translate(F.replace(c, F.lit(LEET_PAIR[0]), F.lit(LEET_PAIR[1])), "".join(LEET), "".join(LEET.values()))


def latinise(c: Column) -> Column:
    return F.translate(c, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def strip_combining(c: Column) -> Column:
    return F.regexp_replace(c, COMBINING, "")


def shorten_runs(c: Column) -> Column:
    """Three or more of one character become two."""
    return F.regexp_replace(c, r"(.)\1{2,}", "$1$1")


def adversarial(c: Column, normalise: bool = True) -> Column:
    """The form under which disguised spellings meet. The order of the steps matters."""
    c = udfs.nfkc(c) if normalise else c
    return fold_space(F.lower(shorten_runs(deleet(strip_combining(latinise(c))))))


def skeleton(c: Column) -> Column:
    """Consonants, without repeats even across vowels."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[aeiou]", ""), r"(?s)(.)\1+", "$1")


def variants(c: Column) -> Column:
    """Spellings to look for: itself, its skeleton and itself without vowels if of three letters, and its digit form."""
    low = F.lower(c)
    bare = F.regexp_replace(low, "[aeiou]", "")
    digits = F.translate(low, "".join(FORWARD_LEET), "".join(FORWARD_LEET.values()))
    long_enough = F.filter(F.array(skeleton(c), bare), lambda x: F.length(x) >= 3)
    return F.array_sort(F.array_distinct(F.concat(F.array(low, digits), long_enough)))


def split_list(c: Column, by: str = ";") -> Column:
    """Trimmed parts, without empty ones."""
    return F.filter(F.transform(F.split(c, by), lambda x: F.trim(x)), lambda x: x != "")


def short_label(c: Column) -> Column:
    return F.element_at(F.split(c, "-"), -1)


def label_column(name: str, prefix: str = "") -> str:
    """A class label as a column name."""
    return prefix + name.lower().replace(" ", "_")
