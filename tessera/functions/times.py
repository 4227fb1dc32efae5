"""Instants as ISO texts: read only with a zone, written in UTC, whatever the session's zone is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date, hours and minutes, seconds, their fraction, hours and minutes of the offset.
_ISO = r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2})(?::([0-9]{2})(\.[0-9]{1,6})?)?(?:Z|([+-][0-9]{2})(?::?([0-9]{2}))?)\z"


def instant(text: Column) -> Column:
    """The timestamp that an ISO text with a zone names; null for null, and for any other text: one without a zone, or a time that isn't one."""
    part = lambda k: F.regexp_extract(text, _ISO, k)
    filled = lambda c, blank: F.when(c == "", blank).otherwise(c)
    plain = F.concat(part(1), F.lit(" "), part(2), F.lit(":"), filled(part(3), "00"), part(4), filled(part(5), "+00"), F.lit(":"), filled(part(6), "00"))
    return F.when(text.rlike(_ISO), F.try_to_timestamp(plain))


def zoned(text: Column) -> Column:
    """As :func:`instant`, but a text that names no instant is an error."""
    return F.when(text.isNotNull(), F.coalesce(instant(text), F.raise_error(F.concat(F.lit("no time with a zone: "), text)).cast("timestamp")))


def iso(at: Column) -> Column:
    """A timestamp as Python writes one in UTC: ``2024-01-02T03:04:05+00:00``, with six digits of a fraction if there is one."""
    none = F.lit(0)
    seconds = F.unix_micros(at).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    local = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(none, none, none, seconds.cast("decimal(18,6)"))
    # as a text, not by a format: those go through the session's zone, which has hours that don't exist
    plain = F.replace(F.substring_index(local.cast("string"), ".", 1), F.lit(" "), F.lit("T"))
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    return F.concat(plain, F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("+00:00"))
