"""Time parsing and spans. Unreadable text becomes null, also under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two text forms of a time in the incident files.
OFFSET_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"
PLAIN_PATTERN = "yyyy-MM-dd HH:mm:ss"


def parse_offset_time(text: Column) -> Column:
    """Text with a zone offset to an instant."""
    return F.try_to_timestamp(text, F.lit(OFFSET_PATTERN))


def parse_plain_time(text: Column) -> Column:
    """Text without an offset, read in the session time zone."""
    return F.try_to_timestamp(text, F.lit(PLAIN_PATTERN))


def parse_any_time(text: Column) -> Column:
    """Text in any form Spark's own cast accepts."""
    return F.try_to_timestamp(text)


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from start to end, each first cut to whole seconds."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(60.0)


def minutes_between_exact(start: Column, end: Column) -> Column:
    """Minutes from start to end with fractional seconds.

    Between instants: ``timestampdiff`` would count local clock time, which
    jumps where the session's zone changes its offset.
    """
    micros = [F.unix_micros(moment.cast("timestamp")) for moment in (start, end)]
    return (micros[1] - micros[0]) / F.lit(6e7)
