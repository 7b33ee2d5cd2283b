"""Text cleaning and guarded parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number text that is accepted; Spark's own cast would also take forms such as '1d'.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"


#: Fixed value: the characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_all(c: Column) -> Column:
    """Trim white space of any kind, not only blanks."""
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def upper_text(c: Column) -> Column:
    return F.upper(blank_to_null(c))


def pad_left(c: Column, width: int, fill: str = "0") -> Column:
    """Pad to ``width``; longer text is never cut."""
    return F.when(F.length(c) < width, F.lpad(c, width, fill)).otherwise(c)


def zfill(c: Column, width: int = 2) -> Column:
    """Pad with zeros after a sign, never cutting."""
    s = c.cast("string")
    signed = s.rlike(r"^[+-]")
    rest = F.substring(s, 2, 1 << 20)
    padded = F.concat(F.substring(s, 1, 1), F.lpad(rest, max(width - 1, 0), "0"))
    return F.when(F.length(s) >= width, s).when(signed, padded).otherwise(F.lpad(s, width, "0"))


def parse_number(c: Column, trimmed: bool = False) -> Column:
    """A finite double from text with a point or a comma; NULL for anything else."""
    s = F.replace(c if trimmed else trim_all(c), F.lit(","), F.lit("."))
    value = F.when(s.rlike(NUMBER), s.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def parse_cents(c: Column, trimmed: bool = False) -> Column:
    """Hundredths, rounded half away from zero, as a double."""
    return F.round(parse_number(c, trimmed) * 100)


def parse_whole(c: Column, kind: str, non_negative: bool = False, trimmed: bool = False) -> Column:
    """An integer of ``kind`` (short, int, long) from integer text; out of range or, if asked, negative: NULL."""
    s = c if trimmed else trim_all(c)
    value = F.when(s.rlike(INTEGER), s.try_cast("long"))
    fits = {"short": 1 << 15, "int": 1 << 31, "long": None}[kind]
    if fits:
        value = F.when((value >= -fits) & (value < fits), value)
    if non_negative:
        value = F.when(value >= 0, value)
    return value.cast(kind)


def parse_iso_date(c: Column, trimmed: bool = False) -> Column:
    s = c if trimmed else trim_all(c)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date"))


def parse_any_date(c: Column) -> Column:
    """A date from the common layouts; text that is none of them, or no day of the calendar, is NULL."""
    s = c.cast("string")
    layouts = [(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), (r"^\d{4}-\d{2}-\d{2}[T ].*$", None)]
    found = [F.when(s.rlike(p), F.try_to_timestamp(s if f else F.substring(s, 1, 10), F.lit(f or "yyyy-MM-dd")).cast("date")) for p, f in layouts]
    return F.coalesce(*found)


# -- cleaning of serving rows ------------------------------------------------------------------------------


def norm_text(c: Column) -> Column:
    """Trimmed, runs of white space as one blank; '', na, n/a and null in any case are NULL."""
    t = trim_all(c)
    return F.when(F.lower(t).isin("", "na", "n/a", "null"), None).otherwise(F.regexp_replace(t, r"(?U)\s+", " "))


def norm_upper(c: Column) -> Column:
    """As ``norm_text``, upper case; '0' counts as nothing."""
    t = norm_text(c)
    return F.when(t != "0", F.upper(t))


def norm_title(c: Column) -> Column:
    t = norm_text(c)
    return F.when(t != "0", F.initcap(F.lower(t)))


def norm_float(c: Column) -> Column:
    return parse_number(norm_text(c))


def norm_int(c: Column) -> Column:
    """Numeric text truncated to a whole number; '2A' is NULL."""
    s = norm_text(c)
    value = F.when(s.rlike(NUMBER), s.try_cast("double"))
    return F.when(F.abs(value) < float(1 << 62), value.cast("long"))


def norm_date(c: Column) -> Column:
    """YYYY-MM-DD or DD-MM-YYYY, with slashes or dashes."""
    s = F.regexp_replace(norm_text(c), "/", "-")
    return F.coalesce(
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date")),
        F.when(s.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_timestamp(s, F.lit("dd-MM-yyyy")).cast("date")),
    )
