"""Text expressions and regular-expression pieces.

Line-oriented rules see text that was split on '\\n' only, so white space and
'any character' are written out instead of relying on one dialect's classes.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space beyond ASCII that both source dialects treat as blank.
WIDE_SPACES = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Blank inside one line (everything but the line feed).
INLINE_BLANKS = "\t\x0b\x0c\r " + WIDE_SPACES + "\ufeff"
BLANKS = "\n" + INLINE_BLANKS
# Blank in headers of source files.
HEADER_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85" + WIDE_SPACES


def char_class(chars: str) -> str:
    """Regular-expression class of the given characters, as code point ranges."""
    ranges: list[list[int]] = []
    for point in sorted(map(ord, chars)):
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(
        f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges
    ) + "]"


def quoted(literal: str) -> str:
    """The literal as a pattern, valid in Java and RE2 alike."""
    return "".join(c if c.isalnum() or c in "_" else f"\\x{{{ord(c):x}}}" for c in literal)


def strip(text, chars: str = BLANKS) -> Column:
    return F.btrim(text, F.lit(chars))


def first_lines(text, n: int) -> Column:
    return F.substring_index(text, "\n", n)


def unix_lines(text) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def header(content, chars: int, lines: int) -> Column:
    """First `chars` characters after line-end normalisation, first `lines`
    lines of those, stripped.

    Twice as many raw characters always contain `chars` normalised ones, so the
    rest of a large text is never touched.
    """
    head = F.substring(unix_lines(F.substring(content, 1, 2 * chars)), 1, chars)
    return strip(first_lines(head, lines), HEADER_BLANKS)
