"""Row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pk_key(columns: list[str]) -> Column:
    """Length-prefixed text of the key columns: different keys give different texts, but for NULL, which counts as the text <NULL>."""
    parts: list[Column] = []
    for name in columns:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("<NULL>"))
        parts += [F.length(text).cast("string"), F.lit(":"), text, F.lit("|")]
    return F.concat(*parts)


def joined_key(parts: list[Column]) -> Column:
    """The parts joined by bars; a NULL part counts as empty text."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def digest_key(parts: list[Column]) -> Column:
    """SHA-256 of the joined parts."""
    return digest(joined_key(parts))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))
