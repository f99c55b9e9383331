"""Text and value expressions with one meaning for nulls, empty strings and non-matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that stands for a missing value in landed tables.
MISSING = ("", "null", "none", "None")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str, *missing: str) -> Column:
    """Null for the given stand-ins of a missing value, by default the empty string."""
    c = col(c)
    return F.when(c.isin(*(missing or ("",))), None).otherwise(c)


def concat_skipping_nulls(*parts: Column | str) -> Column:
    """Concatenation to which nulls add nothing; an expression of nulls gives an empty string."""
    return F.concat_ws("", *[col(p) for p in parts])


def first_group(c: Column | str, pattern: str) -> Column:
    """The first group of the first match, null without a match."""
    c = col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def without_scheme(c: Column | str) -> Column:
    """The text without a leading http:// or https://."""
    return F.regexp_replace(col(c), r"^https?://", "")


def letters_and_spaces(c: Column | str) -> Column:
    """X11: only letters A to Z, a to z and spaces stay."""
    return F.regexp_replace(col(c), "[^a-zA-Z ]", "")


def same_name(a: Column | str, b: Column | str) -> Column:
    """Equality without regard to case and accents; an equality of keys, so it is joined by sorting or hashing."""
    return F.collate(col(a), "UNICODE_CI_AI") == F.collate(col(b), "UNICODE_CI_AI")


#: Accented letters and what they are without accents.
ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿŁłŠšŽž"
PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyyLlSsZz"


def unaccented(c: Column | str) -> Column:
    """Text without accents: combining marks go, listed letters lose theirs, ß becomes ss."""
    plain = F.translate(F.regexp_replace(col(c), r"\p{Mn}+", ""), ACCENTED, PLAIN)
    return F.replace(plain, F.lit("ß"), F.lit("ss"))


def digest(*parts: Column | str) -> Column:
    """md5 in hex of the parts joined by ^; null if any part is null."""
    return F.md5(_joined(parts, "^"))


def _joined(parts, by: str) -> Column:
    out = [col(parts[0])]
    for p in parts[1:]:
        out += [F.lit(by), col(p)]
    return F.concat(*out)


def doi_of_link(c: Column | str) -> Column:
    """The DOI in a https://doi.org/ link, anything else as it is."""
    return F.replace(col(c), F.lit("https://doi.org/"), F.lit(""))


def host_of(c: Column | str) -> Column:
    """The text before the first slash after place 8, without its scheme; empty without such a slash."""
    c = col(c)
    at = F.locate("/", c, 9)
    head = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise("")
    return F.regexp_replace(head, r"^https?://", "")


def collapsed(c: Column | str) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def column_key(c: Column | str) -> Column:
    """A title as a column name: collapsed, lower case, spaces as underscores."""
    return F.lower(F.replace(collapsed(c), F.lit(" "), F.lit("_")))


def file_of_key(key: Column | str) -> Column:
    """The name of the file that belongs to a publication key."""
    return F.concat(F.replace(col(key), F.lit("/"), F.lit("_")), F.lit(".pdf"))


def key_of_file(name: Column | str) -> Column:
    """The publication key that a file name was made of."""
    return F.replace(F.replace(col(name), F.lit("_"), F.lit("/")), F.lit(".pdf"), F.lit(""))


def wide_split(c: Column | str) -> Column:
    """Cells of a line: the trimmed text cut where two or more white space characters stand."""
    return F.split(F.trim(col(c)), r"\s\s+")


def last_first(c: Column | str) -> Column:
    """A struct (last, first) of a name written "Last, First"; nulls unless there are two parts."""
    parts = F.split(col(c), ",")
    two = F.size(F.filter(parts, lambda p: p != "")) >= 2
    return F.struct(F.when(two, F.trim(parts[0])).alias("last"), F.when(two, F.trim(F.get(parts, F.lit(1)))).alias("first"))


def name_and_parenthesis(c: Column | str) -> Column:
    """A struct (name, affiliation): text before the first parenthesis and inside it; no parenthesis, no affiliation."""
    c = col(c)
    return F.struct(F.trim(F.split_part(c, F.lit("("), F.lit(1))).alias("name"), first_group(c, r"\((.*?)\)").alias("affiliation"))


def free_date(c: Column | str) -> Column:
    """A date written as 2020-03-01 or as 1 March 2020; null for anything else."""
    c = col(c)
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "d MMMM yyyy"), F.try_to_date(c, "d MMM yyyy"))


def rounded(c: Column | str, places: int = 2) -> Column:
    """Half up."""
    return F.round(col(c), places)
