"""Text expressions with the semantics of Python's ``str`` and ``re``."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's Unicode \s leaves out the four separators U+001C..U+001F.
_SPACE = r"\s\x1c-\x1f"


def java_pattern(pattern: str) -> str:
    """A Python ``str`` pattern as a Java one with the same matches.

    ``(?U)`` makes the classes Unicode-aware, ``(?d)`` leaves ``\\n`` as the only
    line end, and ``\\s`` is widened to Python's set of spaces.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
            i += 2
        elif two == r"\S" and not in_class:
            out.append(f"[^{_SPACE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            in_class = (in_class or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i += 1
    return "(?Ud)" + "".join(out)


# Letters that case-insensitive matching equates with ASCII ones but ``lower`` does not.
FOLDS = (("ſ", "s"), ("K", "k"), ("İ", "i"), ("ı", "i"))

# Python's white space, for trimming by character set.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def sql_text(value: str) -> str:
    """A string literal for SQL text."""
    out = value.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + "".join(c if c.isprintable() else f"\\u{ord(c):04x}" for c in out) + "'"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACES))


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(java_pattern(pattern))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is referred to.

    Without it the optimizer may copy a costly expression to every reference.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(text: Column) -> Column:
    """Lower case, with the letters that case-insensitive matching equates with ASCII ones but ``lower`` does not."""
    for special, plain in FOLDS:
        text = F.replace(text, F.lit(special), F.lit(plain))
    return F.lower(text)


def _either(parts) -> str:
    return "|".join(re.escape(p) for p in parts)


# One alternation per list keeps plans small; meant for short texts.
def contains_any(c: Column, parts) -> Column:
    return c.rlike(_either(parts))


def equals_any(c: Column, parts) -> Column:
    return c.isin(*parts)


def starts_with_any(c: Column, parts) -> Column:
    return c.rlike(rf"\A(?:{_either(parts)})")


def ends_with_any(c: Column, parts) -> Column:
    return c.rlike(rf"(?:{_either(parts)})\z")


def ellipsis(c: Column, width: int) -> Column:
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("..."))).otherwise(c)


def before_first(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def after_first(c: Column, mark: str) -> Column:
    """Everything behind the first ``mark``; empty when there is none."""
    at = F.locate(mark, c)
    return F.when(at > 0, F.substring(c, at + F.lit(len(mark)), F.length(c))).otherwise(F.lit(""))


def entropy(c: Column) -> Column:
    """Shannon entropy in bits per character."""
    n = F.length(c).cast("double")

    def term(ch):
        k = (F.length(c) - F.length(F.replace(c, ch, F.lit("")))).cast("double")
        return k / n * F.log2(k / n)

    total = F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0),
                        lambda acc, ch: acc + F.when(ch == "", 0.0).otherwise(term(ch)))
    return F.when(F.length(c) > 0, F.abs(total)).otherwise(F.lit(0.0))


def python_repr(c: Column) -> Column:
    """The quoted form of a text, for printable text and common escapes."""
    body = c
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    double = F.concat(F.lit('"'), body, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(c.contains("'") & ~c.contains('"'), double).otherwise(single)


def html_escape(c: Column) -> Column:
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def percent_quote(c: Column) -> Column:
    """URL quoting that keeps ``/`` and ``~`` and writes blanks as ``%20``."""
    c = F.url_encode(c)
    for raw, shown in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def page_fingerprint(body: Column, width: int | None = None) -> Column:
    """MD5 of a page, or of its head, with numbers and blanks evened out; null when empty."""
    t = F.left(body, F.lit(width)) if width else body
    t = F.regexp_replace(t, java_pattern(r"\d+"), "#")
    t = F.trim(F.regexp_replace(t, java_pattern(r"\s+"), " "))
    return F.when(F.length(body) > 0, F.md5(t))
