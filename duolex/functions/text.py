"""Text cleaning, word and piece splitting as native expressions."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.strip() sees it.  The lookbehind lets a run be tried once
# only, so long runs stay linear.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]+$"
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_BLANK = r"(?U)^[\s\x1c-\x1f]*$"

_WORD = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
PIECE = 4

# Literals and preprocessor lines (kept) or comments (replaced).  Possessive
# loops: no stack growth on long literals.
_LITERAL_OR_COMMENT = (
    r"('[^\\']*+(?:\\[\s\S][^\\']*+)*+'"
    r'|"[^\\"]*+(?:\\[\s\S][^\\"]*+)*+"'
    r"|#[^\r\n]*(?:\\\r?\n[^\r\n]*)*)"
    r"|//[^\n]*|/\*[\s\S]*?\*/"
)
_OPEN, _CLOSE, _ESC = "\ue000", "\ue001", "\ue002"


def strip(text: Column) -> Column:
    """Trim all white space, not just blanks."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?<![\s\x1c-\x1f])[\s\x1c-\x1f]+$", "")


def after_separator(text: Column, sep: str = "|") -> Column:
    """Trimmed text behind the first ``sep``; text without one is kept."""
    at = F.instr(text, sep)
    return F.when(at > 0, strip(F.substr(text, at + len(sep)))).otherwise(text)


def without_c_comments(text: Column) -> Column:
    """Line comments, then block comments, then blank lines."""
    text = F.regexp_replace(text, r"//[^\n]*\n", "\n")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    lines = F.split(text, _LINE_BREAK, -1)
    return F.array_join(F.filter(lines, lambda x: ~F.rlike(x, F.lit(_BLANK))), "\n")


def without_fortran_comments(text: Column) -> Column:
    """``!`` comments but not ``!$`` directives, column-0 comment lines, then
    repeated line ends."""
    text = F.regexp_replace(text, r"(?md)![^$].*?$|^[cC*].*?$", "")
    return F.regexp_replace(text, r"\n{2,}", "\n")


def without_comments_keep_literals(text: Column) -> Column:
    """Comments become one space; quoted literals and preprocessor lines stay.

    Every match is wrapped in two marker characters; a match that captured
    nothing (a comment) leaves the bare marker pair behind.  Marker characters
    in the input are escaped first.
    """
    text = F.replace(text, F.lit(_ESC), F.lit(_ESC + "a"))
    text = F.replace(text, F.lit(_OPEN), F.lit(_ESC + "b"))
    text = F.replace(text, F.lit(_CLOSE), F.lit(_ESC + "c"))
    text = F.regexp_replace(text, _LITERAL_OR_COMMENT, f"{_OPEN}$1{_CLOSE}")
    text = F.replace(text, F.lit(_OPEN + _CLOSE), F.lit(" "))
    text = F.translate(text, _OPEN + _CLOSE, "")
    text = F.replace(text, F.lit(_ESC + "c"), F.lit(_CLOSE))
    text = F.replace(text, F.lit(_ESC + "b"), F.lit(_OPEN))
    return F.replace(text, F.lit(_ESC + "a"), F.lit(_ESC))


def contains_any(text: Column, keywords) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords])


def words(text: Column, specials=(), lower=True) -> Column:
    """Runs of letters and digits, and single other characters, in lower case.

    Tokens in ``specials`` are found first and stay as they are.
    """
    if not specials:
        return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(_WORD), F.lit(0))
    pattern = "|".join([re.escape(t) for t in specials] + [_WORD])
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda w: F.when(w.isin(*specials), w).otherwise(F.lower(w)),
    )


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def space_words(text: Column) -> Column:
    """Split on every single space; empty strings count."""
    return F.split(text, " ", -1)


def word_pieces(word: Column, specials=()) -> Column:
    """Pieces of four characters; all but the first carry a ``##`` prefix."""
    whole = F.length(word) <= PIECE
    if specials:
        whole = whole | word.isin(*specials)
    return F.when(whole, F.array(word)).otherwise(
        F.transform(
            F.sequence(F.lit(0), ((F.length(word) - 1) / PIECE).cast("int")),
            lambda j: F.concat(
                F.when(j > 0, F.lit("##")).otherwise(F.lit("")),
                word.substr(j * PIECE + 1, F.lit(PIECE)),
            ),
        )
    )


def piece_count(word: Column, specials=()) -> Column:
    n = ((F.length(word) + (PIECE - 1)) / PIECE).cast("int")
    return F.when(word.isin(*specials), F.lit(1)).otherwise(n) if specials else n


def marked(pieces: Column) -> Column:
    """Plain pieces of a word with the ``##`` prefix on all but the first."""
    return F.transform(pieces, lambda p, i: F.when(i > 0, F.concat(F.lit("##"), p)).otherwise(p))


def join_pieces(pieces: Column) -> Column:
    """Words separated by one blank, continuation pieces glued on."""
    return F.replace(F.array_join(pieces, " "), F.lit(" ##"), F.lit(""))
