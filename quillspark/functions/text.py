"""Column functions of ingest and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a segment of an affiliation as an institution.
INSTITUTION_WORDS = "University|Universit|Institut|Hospital|College|Center|Centre|School|Clinic"


#: How a country is read from the end of an affiliation.
NOTE, FULL_STOP, POSTAL_CODE, COUNTRY_LENGTH = r"(?i)\s*(electronic address|email)\s*:.*\z", r"\.\s*\z", r"^\d{4,6}\s*", 60


def strip(x: Column) -> Column:
    """Without white space at both ends, non-breaking spaces included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def country_from_affiliation(x: Column) -> Column:
    """The last comma-separated part, without a trailing e-mail note, full stop or leading postal code, of 60 characters at most."""
    bare = F.regexp_replace(F.regexp_replace(x, NOTE, ""), FULL_STOP, "")
    last = strip(F.element_at(F.split(bare, ","), -1))
    return F.substring(F.regexp_replace(last, POSTAL_CODE, ""), 1, COUNTRY_LENGTH)


def institution_from_affiliation(x: Column) -> Column:
    """The first comma-separated part that names an institution; null if none does."""
    return strip(F.get(F.filter(F.split(x, ","), lambda s: s.rlike(f"(?i){INSTITUTION_WORDS}")), 0))


def orcid(x: Column) -> Column:
    """An ORCID iD as 4-4-4-4, from an address or bare digits; null unless it has 16 characters."""
    bare = F.upper(F.replace(F.element_at(F.split(F.regexp_replace(strip(x), r"/+\z", ""), "/"), -1), F.lit("-"), F.lit("")))
    return F.when(F.char_length(bare) == 16, F.regexp_replace(bare, r"^(.{4})(.{4})(.{4})(.{4})\z", "$1-$2-$3-$4"))


def author_key(orcid_col: Column, last: Column, initials: Column, fore: Column) -> Column:
    """By ORCID iD, else by surname and first initial; null without either."""
    initial = F.lower(F.substring(F.coalesce(F.nullif(initials, F.lit("")), fore, F.lit("")), 1, 1))
    named = F.when(F.coalesce(last, F.lit("")) != "", F.concat(F.lit("name:"), F.lower(last), F.lit("|"), initial))
    return F.coalesce(F.concat(F.lit("orcid:"), orcid_col), named)


def publication_year(year: Column, medline_date: Column, article_year: Column) -> Column:
    """The year if it is digits, else the first four-digit word of the free date, else the electronic date's year."""
    word = F.get(F.filter(F.split(F.replace(medline_date, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: w.rlike(r"^\d{4}\z")), 0)
    return F.coalesce(F.when(year.rlike(r"^\d+\z"), year.try_cast("int")), word.try_cast("int"), article_year.try_cast("int"))


def publication_month(month: Column) -> Column:
    """A number, or the number of an English month by its first three letters, as written."""
    names = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    at = F.array_position(F.array(*map(F.lit, names)), F.substring(month, 1, 3)).cast("int")
    return F.coalesce(F.when(month.rlike(r"^\d+\z"), month.try_cast("int")), F.nullif(at, F.lit(0)))


def keyword_id(term: Column) -> Column:
    return F.concat(F.lit("kw:"), F.lower(strip(term)))


def snippet(x: Column, n: int = 300) -> Column:
    return F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n), F.lit("…"))).otherwise(x)


def tokens(x: Column) -> Column:
    """Runs of two or more word characters, lower-cased. A run is taken as long as it is, so that its bounds need no look."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w{2,}"), F.lit(0))


def nearest_quantile_rank(n: Column, q: float) -> Column:
    """The rank, from 0, of the nearest-rank quantile."""
    return F.round((n - 1) * q).cast("long")
