"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes a cell's text unreadable.
GLYPH = r"GLYPH<[0-9A-Fa-f]+>"
SLASH_G = r"(?:/G\d+){2,}"
FRAGMENT = r"\b[A-Za-z](?:/[a-z]{1,3}\.[a-z]{1,3}){2,}\b"
SLASH_START = r"^(?:/\w+\s*){2,}"
WHOLE_WORD = r"^[\p{L}\p{N}]+$"
REPLACEMENT = "�"
#: Typographic characters and their plain forms.
TYPOGRAPHIC, PLAIN = "⁄’‘“”•", "/''\"\"·"
#: Unicode white space, as ``(?U)\s`` matches it.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Unicode white space off both ends. It is looked for at the ends alone; a pattern would be tried at every character."""
    return F.btrim(text, F.lit(SPACES))


def quality(text: Column) -> Column:
    """Zero for unreadable text; else one, less a tenth for each of three or more fragments."""
    hard = (F.instr(text, REPLACEMENT) > 0) | text.rlike(GLYPH) | text.rlike("(?U)" + SLASH_G) | text.rlike("(?U)" + SLASH_START)
    n = F.regexp_count(text, F.lit("(?U)" + FRAGMENT))
    return F.when(hard, 0.0).when(n >= 3, F.greatest(F.lit(1.0) - F.lit(0.1) * n, F.lit(0.0))).otherwise(1.0)


def clean_line(text: Column) -> Column:
    """Control hyphens made plain, stripped."""
    return strip(F.replace(text, F.lit("\x02"), F.lit("-")))


def clean_lines(lines: Column) -> Column:
    """Cleaned lines that are not blank."""
    return F.filter(F.transform(lines, clean_line), lambda x: x != "")


def plain(text: Column) -> Column:
    for fancy, simple in zip(TYPOGRAPHIC, PLAIN, strict=True):
        text = F.replace(text, F.lit(fancy), F.lit(simple))
    return strip(text)


def joined(lines: Column) -> Column:
    """Lines as one text, hyphenated words mended; one line or none is taken as it is."""

    def piece(x: Column, i: Column) -> Column:
        last_word = F.regexp_extract(x, r"(?U)(\w+)\W*$", 1)
        next_word = F.regexp_extract(F.coalesce(F.get(lines, i + 1), F.lit("")), r"(?U)^\W*(\w+)", 1)
        split_word = last_word.rlike(WHOLE_WORD) & next_word.rlike(WHOLE_WORD)
        mended = F.when(x.endswith("-"), F.when(split_word, F.regexp_replace(x, "-$", "")).otherwise(x))
        return F.when(i == F.size(lines) - 1, x).otherwise(F.coalesce(mended, F.concat(x, F.lit(" "))))

    return F.when(F.size(lines) <= 1, F.array_join(lines, "")).otherwise(plain(F.array_join(F.transform(lines, piece), "")))
