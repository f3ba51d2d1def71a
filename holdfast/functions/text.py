"""Text forms: decimals, shares, dates and translated labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions import labels as L
from holdfast.functions.numbers import exact_round


def decimal_text(value: Column, digits: int = 2) -> Column:
    """Fixed number of decimals with a comma; empty for NULL."""
    text = F.format_string(f"%.{digits}f", exact_round(value.cast("double"), digits))
    return F.when(value.isNull(), "").otherwise(F.replace(text, F.lit("."), F.lit(",")))


def percent_text(share: Column) -> Column:
    """A share as a whole percentage; empty for NULL."""
    whole = F.rint(share * 100).cast("bigint").cast("string")
    return F.when(share.isNull(), "").otherwise(F.concat(whole, F.lit("%")))


def timestamp_text(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, with microseconds only where there are any."""
    whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    fine = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.when(fine.endswith(".000000"), whole).otherwise(fine)


def day_text(value: Column, is_text: bool = False) -> Column:
    """``dd.MM.yyyy``; text that is no date stays as it is, NULL becomes empty."""
    moment = F.try_to_timestamp(value) if is_text else value
    shown = F.date_format(moment, "dd.MM.yyyy")
    return F.coalesce(shown, value.cast("string"), F.lit(""))


def minute_text(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` for the screen; unparsable text loses its fraction."""
    shown = F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd HH:mm")
    return F.when(F.coalesce(value, F.lit("")) == "", "-").otherwise(
        F.coalesce(shown, F.substring_index(value, ".", 1))
    )


def dictionary(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in entries.items() for part in pair])


def translated(value: Column, entries: dict[str, str]) -> Column:
    """The dictionary text; unknown values and NULL stay as they are."""
    return F.coalesce(F.try_element_at(dictionary(entries), value), value)


def screen_text(value: Column, entries: dict[str, str]) -> Column:
    """As ``translated``, with a dash for NULL and empty values."""
    return F.when(F.coalesce(value, F.lit("")) == "", "-").otherwise(translated(value, entries))


def screen_group_text(value: Column, entries: dict[str, str]) -> Column:
    """As ``translated``, with a dash for NULL only (empty text stays empty)."""
    return F.coalesce(translated(value, entries), F.lit("-"))


def short_action_text(value: Column) -> Column:
    return screen_text(value, {**L.ACTION_TEXT, **L.SHORT_ACTION_TEXT})


def reason_text(value: Column) -> Column:
    """Translate a reason by its exact text, else by the phrases it contains."""
    lowered = F.lower(value)
    shown = F.try_element_at(dictionary(L.SCREEN_REASON_TEXT), value)
    by_phrase = None
    for phrases, text in L.REASON_PHRASES:
        hit = lowered.contains(phrases[0])
        for phrase in phrases[1:]:
            hit = hit | lowered.contains(phrase)
        by_phrase = F.when(hit, text) if by_phrase is None else by_phrase.when(hit, text)
    return F.when(F.coalesce(value, F.lit("")) == "", "-").otherwise(
        F.coalesce(shown, by_phrase, value)
    )
