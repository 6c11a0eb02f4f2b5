"""Text expressions: title case, state and facility names, month names, slugs, delta sentences."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import is_finite, plain_number

# Spanish month names and their short forms.
MONTHS = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
SHORT_MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")

# State names that do not follow the title-case rule.
STATE_NAMES = {
    "MICHOACAN DE OCAMPO": "Michoacan",
    "VERACRUZ DE IGNACIO DE LA LLAVE": "Veracruz",
    "HRAES": "HRAES",
}

# Acronyms kept in capitals inside facility names.
ACRONYMS = ("HG", "IMSS")

NO_DATA = "s/d"

# A word starts after any character that Unicode word breaking treats as a boundary. Apostrophe, full stop
# and colon join letters on both sides, so they open a word only when no letter precedes them.
_WORD_START = r"(?<=[^\p{L}\p{M}\p{N}_'’.:])|(?<=(?<![\p{L}\p{M}])['’.:])"


def _capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def title_case(text: Column) -> Column:
    """First letter of every word upper, the rest lower; hyphens and brackets start a new word."""
    return F.array_join(F.transform(F.split(F.lower(text), _WORD_START), _capitalised), "")


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def state_name(text: Column) -> Column:
    """Display name of a state: long official names shortened, one acronym kept, the rest in title case."""
    name = title_case(text)
    for raw, shown in STATE_NAMES.items():
        name = F.when(text == raw, F.lit(shown)).otherwise(name)
    return name


def facility_name(text: Column, acronyms: Iterable[str] = ACRONYMS) -> Column:
    name = title_case(text)
    for acronym in acronyms:
        name = F.regexp_replace(name, rf"\b{acronym.capitalize()}\b", acronym)
    return name


def month_name(day: Column, names: tuple[str, ...] = MONTHS) -> Column:
    return month_label(F.month(day), names)


def month_label(month: Column, names: tuple[str, ...] = MONTHS) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in names]), month.cast("int"))


def slug(text: Column) -> Column:
    """Runs of anything but lower-case letters and digits become ``_``, then the text is lowered."""
    return F.lower(F.regexp_replace(text, "[^a-z0-9]+", "_"))


def year_in_text(text: Column) -> Column:
    """The first four-digit run of a text as an integer, NULL when there is none."""
    return F.regexp_extract(text.cast("string"), r"(\d{4})", 1).try_cast("int")


# Fixed values in the next functions: the report's signs, icons, colour names and sentence parts.


def delta_label(delta: Column) -> Column:
    """Signed percent for a card."""
    number = plain_number(delta)
    return (
        F.when(delta.isNull(), F.lit(NO_DATA))
        .when(delta > 0, F.concat(F.lit("+"), number, F.lit("%")))
        .when(delta < 0, F.concat(number, F.lit("%")))
        .otherwise(F.lit("0%"))
    )


def delta_icon(delta: Column) -> Column:
    return (
        F.when(delta.isNull(), F.lit(""))
        .when(delta > 0, F.lit("▲ "))
        .when(delta < 0, F.lit("▼ "))
        .otherwise(F.lit("• "))
    )


def accent(first: Column, second: Column) -> Column:
    """Green when neither delta is negative, yellow when one is, red when both are."""
    down_first = F.coalesce(first < 0, F.lit(False))
    down_second = F.coalesce(second < 0, F.lit(False))
    return (
        F.when(down_first & down_second, F.lit("rojo"))
        .when(down_first != down_second, F.lit("amarillo"))
        .otherwise(F.lit("verde"))
    )


def delta_sentence(delta: Column, year: int) -> Column:
    number = plain_number(F.abs(delta))
    return (
        F.when(~is_finite(delta), F.lit(f"{NO_DATA} que en {year}"))
        .when(delta > 0, F.concat(number, F.lit(f"% más que {year}")))
        .when(delta < 0, F.concat(number, F.lit(f"% menos que {year}")))
        .otherwise(F.lit(f"igual que en {year}"))
    )


def delta_lines(first: Column, first_year: int, second: Column, second_year: int) -> Column:
    """Two delta sentences on two lines."""
    return F.concat_ws("\n", delta_sentence(first, first_year), delta_sentence(second, second_year))
