"""Text folding inside the JVM: case, accents, words, clocks."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that no canonical decomposition reduces to ASCII, and their transliterations.
SPECIAL_LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "đ": "d", "ð": "d", "ħ": "h",
    "ı": "i", "ĸ": "k", "ł": "l", "ŋ": "n", "ŧ": "t", "ƀ": "b", "ɓ": "b", "ɖ": "d",
}


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Characters and their one-letter replacements, built by decomposing the Latin blocks; the marks at the end have none."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        low = chr(code).lower()
        plain = SPECIAL_LETTERS.get(low) or "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code) and plain.isascii():
            source.append(chr(code))
            target.append(plain)
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(source + marks), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without accents: ``Ødegaard`` and ``ODEGAARD`` become ``odegaard``; null stays null."""
    source, target = fold_table()
    out = F.translate(F.lower(text), source, target)
    for letter, plain in SPECIAL_LETTERS.items():
        if len(plain) > 1:
            out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def normalize_name(text: Column) -> Column:
    """Folded name without outer white space; inner white space is kept."""
    return F.trim(fold(text))


def words(text: Column) -> Column:
    """Runs of letters and digits of the folded text, in order; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(fold(text), F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def clock_seconds(clock: Column) -> Column:
    """``mm:ss`` or ``mmm:ss``, outer spaces allowed, as whole seconds; anything else is null."""
    text = F.trim(clock)
    return F.when(
        text.rlike(r"^\d{1,4}:\d{1,2}$"),
        F.split_part(text, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(text, F.lit(":"), F.lit(2)).cast("int"),
    )
