"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is an unbroken run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Words of a text in order, lower case; null gives null, a text without words an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def group_key(raw: Column) -> Column:
    """One spelling per group: 'g-' and the number without leading zeros; null and blank give null.

    Spellings differ in case, outer spaces and padding zeros.
    """
    clean = F.lower(F.trim(raw))
    prefix = F.regexp_extract(clean, r"^(.*?)0*(\d*)$", 1)
    number = F.regexp_extract(clean, r"^(.*?)0*(\d*)$", 2)
    ends_in_digit = clean.rlike(r"\d$")
    number = F.when(ends_in_digit & (number == ""), F.lit("0")).otherwise(number)
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(None)).otherwise(F.concat(prefix, number))


def truncate_text(text: Column, max_chars: int) -> Column:
    """At most ``max_chars`` UTF-16 units, never half a surrogate pair.

    Characters outside the basic plane count two units; a JVM-side running sum finds the cut.
    """
    chars = F.split(text, "")
    unit = F.transform(chars, lambda c: F.when(F.octet_length(c) > 3, F.lit(2)).otherwise(F.lit(1)))
    ends = F.aggregate(
        unit,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("kept")),
        lambda a, u: F.struct(
            (a["n"] + u).alias("n"),
            (a["kept"] + F.when(a["n"] + u <= max_chars, F.lit(1)).otherwise(F.lit(0))).alias("kept"),
        ),
        lambda a: a["kept"],
    )
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.substring(text, 1, max_chars)).otherwise(F.expr("''") if max_chars == 0 else text.substr(F.lit(1), ends))
