"""Text expressions matching Python's ``str`` semantics where it matters.

Python's ``strip``/``split`` treat all Unicode white space as space while
Spark's ``trim`` only removes U+0020, and Java's ``\\s`` misses U+00A0,
U+0085 and U+001C-U+001F.  The class below covers the same characters as
Python's ``str.isspace``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_CLASS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
_LEAD_TRAIL = f"^{WS_CLASS}+|{WS_CLASS}+$"
# Python's str.isalnum keeps letters and numbers of every script.
NON_ALNUM = r"[^\p{L}\p{N}]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing Unicode white space."""
    return F.regexp_replace(col_(c), _LEAD_TRAIL, "")


def py_split_join(c) -> Column:
    """``' '.join(s.split())``: collapse white space runs, strip ends."""
    return py_strip(F.regexp_replace(col_(c), f"{WS_CLASS}+", " "))


def keep_alnum(c) -> Column:
    """``''.join(ch for ch in s if ch.isalnum())``."""
    return F.regexp_replace(col_(c), NON_ALNUM, "")


def _hit(text: Column, k: str, ws_runs: bool) -> Column:
    """``k`` occurs in ``text``.  With ``ws_runs`` the space inside a
    multi-word keyword matches any run of white space, i.e. the test equals a
    substring test on the white-space-collapsed text (single words match the
    same either way), without collapsing the text; the regex only runs when
    the words are all present."""
    if not ws_runs or " " not in k:
        return text.contains(k)
    words = k.split(" ")
    cond = None
    for w in words:
        c = text.contains(w)
        cond = c if cond is None else (cond & c)
    pattern = f"{WS_CLASS}+".join(r"\Q" + w + r"\E" for w in words)
    return cond & text.rlike(pattern)


def _minimal(keywords) -> list[str]:
    """Drop keywords that contain another keyword of the list: for an
    any-of test they can never change the result."""
    ws = list(dict.fromkeys(keywords))
    return [k for k in ws if not any(o != k and o in k for o in ws)]


def contains_any(text: Column, keywords, ws_runs: bool = False) -> Column:
    """True if any keyword occurs as a substring.

    An OR-chain of ``contains`` (a byte search per keyword, short-circuited)
    measured about 8x faster than one regex alternation or ``instr`` on the
    same keyword lists.  Single words are tested first, multi-word ones last.
    """
    ks = sorted(_minimal(keywords), key=lambda k: " " in k)
    cond = None
    for k in ks:
        c = _hit(text, k, ws_runs)
        cond = c if cond is None else (cond | c)
    return cond


def count_present(text: Column, keywords, ws_runs: bool = False) -> Column:
    """Number of distinct keywords occurring as substrings.

    ``size(array_compact(array(when(hit, 1), ...)))``: one cheap byte search
    per keyword and no chain of overflow-checked additions, so the generated
    code stays small even when the optimizer copies the expression into a
    pushed-down filter.
    """
    hits = [F.when(_hit(text, k, ws_runs), F.lit(1)) for k in dict.fromkeys(keywords)]
    return F.size(F.array_compact(F.array(*hits)))


def search_blob(cols) -> Column:
    """Lower-cased text of all given columns, for case-insensitive search."""
    return F.lower(F.concat_ws(" ", *[col_(c).cast("string") for c in cols]))
