"""Text folding, trimming and tokenising as built-in Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six bytes a whitespace trim removes, and the accent
# folding pairs (each accented letter maps to the plain letter at the same
# position). They must stay equal to what the SQL oracle uses.
WS_CHARS = " \t\n\r\x00\x0b"
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# Words are runs of letters and digits; everything else separates them.
WORD_SPLIT = r"[^\p{L}\p{N}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Trim spaces, tabs, newlines, carriage returns, NUL and vertical tabs."""
    return F.btrim(_c(x), F.lit(WS_CHARS))


def fold(x) -> Column:
    """Lower-case and strip the common Latin accents."""
    return F.translate(F.lower(_c(x)), ACCENTED, PLAIN)


def tokens(x) -> Column:
    """Folded words of a text, in order, empty pieces removed.

    ``array_remove`` (not a lambda ``filter``) keeps the expression in
    generated code.
    """
    return F.array_remove(F.split(fold(x), WORD_SPLIT), "")


def is_blank(x) -> Column:
    """Null, or nothing left after the whitespace trim."""
    c = _c(x)
    return c.isNull() | (strip_ws(c) == F.lit(""))


def php_empty(x) -> Column:
    """The loose "empty" test: null, '' or '0'."""
    c = _c(x).cast("string")
    return c.isNull() | c.isin("", "0")


def sorted_join(arr, sep: str = ",") -> Column:
    """Join an array of strings after sorting it (stable text for comparisons)."""
    return F.array_join(F.array_sort(_c(arr)), sep)
