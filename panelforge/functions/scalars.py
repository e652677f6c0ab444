"""Column functions of the panel: hashes, scores, texts, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(*cols: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) fixed by the seed and the values: the first 32 bits of an MD5."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)


def clamp(value: Column, lo: float, hi: float) -> Column:
    """value within [lo, hi]; what isn't a number counts as 0."""
    number = F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(lo), F.least(F.lit(hi), number))


def daily_rate(annual: Column) -> Column:
    """The rate of one of 252 sessions that compounds to the annual one."""
    return F.pow(1 + annual, F.lit(1 / 252)) - 1


def verdict(ic: Column) -> Column:
    """Band of an information coefficient."""
    return F.when(ic.isNull() | F.isnan(ic), "undefined").when(ic > 0.15, "strong").when(ic >= 0.10, "good").when(ic >= 0, "weak").otherwise("negative")


def choose_model(delta: Column, least: float = 0.05) -> Column:
    """B only where it is ahead by more than `least`."""
    return F.when(delta > least, "B").otherwise("A")


def normalize_title(title: Column) -> Column:
    """Lower case, only a-z, 0-9 and blanks, single blanks, 80 characters."""
    kept = F.regexp_replace(F.lower(title), "[^a-z0-9 ]", "")
    return F.left(F.trim(F.regexp_replace(kept, " +", " ")), F.lit(80))


def news_hash(source: Column, published: Column, title: Column) -> Column:
    """First 16 hex digits of the SHA-256 of source|time|title."""
    key = F.concat_ws("|", source, F.date_format(published, "yyyy-MM-dd'T'HH:mm:ss"), title)
    return F.left(F.sha2(key.cast("binary"), 256), F.lit(16))


def parse_percent(text: Column) -> Column:
    """'1,045.64%' -> 1045.64; anything else that isn't a number is null."""
    return F.regexp_replace(F.trim(text), "[,%]", "").try_cast("double")


def parse_period_end(text: Column) -> Column:
    """'06/25' -> 2025-06-30."""
    return F.last_day(F.try_to_timestamp(F.concat(F.lit("01/"), F.trim(text)), F.lit("dd/MM/yy")).cast("date"))


def normalize_symbol(symbol: Column, alias: dict[str, str] | None = None, suffix: str = "") -> Column:
    """Trimmed, upper case, through the alias map, with the suffix."""
    s = F.upper(F.trim(symbol))
    for old, new in (alias or {}).items():
        s = F.when(s == old, F.lit(new)).otherwise(s)
    return F.concat(s, F.lit(suffix)) if suffix else s


def is_fallback(has_event: Column, confidence: Column, warnings: Column) -> Column:
    """No event, a confidence under 0.3, or any warning."""
    return ~F.coalesce(has_event, F.lit(False)) | F.coalesce(confidence < 0.3, F.lit(True)) | (F.coalesce(F.size(warnings), F.lit(0)) > 0)


def classify_degradation(warnings: Column, markers: tuple[str, ...] = ("parse error", "call failed", "empty response")) -> Column:
    """The first marker that any warning contains, else null."""
    joined = F.array_join(warnings, "\n")
    out = F.lit(None).cast("string")
    for m in reversed(markers):
        out = F.when(joined.contains(m), F.lit(m)).otherwise(out)
    return out


def was_evaluated(degradation: Column, justification: Column, tokens_in: Column) -> Column:
    """Not if degraded; surely if justified; else if any tokens went in."""
    return F.when(degradation.isNotNull(), False).when(justification.isNotNull(), True).otherwise(F.coalesce(tokens_in > 0, F.lit(False)))


def score_degraded(has_event: Column, confidence: Column) -> Column:
    """An event scored without any confidence."""
    return F.coalesce(has_event & (confidence == 0), F.lit(False))


def event_weight(has_event: Column, weight: float = 5.0) -> Column:
    """Training weight of a row."""
    return F.when(F.coalesce(has_event, F.lit(False)), F.lit(weight)).otherwise(F.lit(1.0))
