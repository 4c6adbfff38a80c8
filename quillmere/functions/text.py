"""Names, identifiers and categories as they come in files."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters with accents, and what they become.
ACCENTED, ASCII = "àâäçéèêëîïôöùûüÿ", "aaaceeeeiioouuuy"


def plain_names(df: DataFrame) -> DataFrame:
    """df with column names stripped, without accents, and `_` for white space."""
    bare = lambda n: unicodedata.normalize("NFKD", n.strip()).encode("ascii", "ignore").decode()
    return df.toDF(*[re.sub(r"\s+", "_", bare(n)) for n in df.columns])


def cleaned(c: Column) -> Column:
    """A category in lower case, without accents and outer or repeated blanks; blank is null."""
    x = F.translate(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), ACCENTED, ASCII)
    return F.when(x != "", x)


def whole_number_id(c: Column) -> Column:
    """`1010191.0` and 1010191 as the string 1010191; null where there is no whole number."""
    x = F.trim(c.cast("string"))
    return F.when(x.rlike(r"^[0-9]{1,18}([.]0*)?$"), F.regexp_extract(x, r"^([0-9]+)", 1).try_cast("bigint").cast("string"))


def id_class(c: Column) -> Column:
    """Of an identifier: blank, numeric, a letter prefix with a number, letters alone, or other."""
    x = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(x == "", "blank").when(x.rlike("^[0-9]+$"), "numeric").when(x.rlike("^[A-Z]+-[0-9]+$"), "prefixed").when(x.rlike("^[A-Z]+$"), "letters").otherwise("other")


def stored_decimals(c: Column) -> Column:
    """Digits after the point of a number kept as text."""
    return F.length(F.regexp_extract(c, r"^-?[0-9]+[.]([0-9]*)$", 1))
