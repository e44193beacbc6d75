"""Values as people read them (in Spanish): ages, dates, money, countdowns, labels; clubs, dates and places of birth as keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP_WORDS, fold_name, strip_accents

# Labels, months, days; the dash for what is missing.
EVENTS = {"injury": "Lesión", "suspension": "Sanción", "doubt": "Duda", "transfer": "Fichaje"}
SEVERITIES = {"none": "Sin gravedad", "light": "Leve", "moderate": "Moderada", "serious": "Grave", "out": "Baja segura"}
RUNS = {"running": "En curso", "success": "OK", "partial": "Parcial", "failed": "Fallo"}
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
SHORT_MONTHS = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sept", "oct", "nov", "dic"]
DAYS = ["domingo", "lunes", "martes", "miércoles", "jueves", "viernes", "sábado"]
SHORT_DAYS = ["dom", "lun", "mar", "mié", "jue", "vie", "sáb"]
MISSING = "—"


def label(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code, or the code."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), code), code)


def severity_rank(severity: Column) -> Column:
    """Severities in order, 0 for none or an unknown one."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)) - 1, F.lit(0)).cast("int")


def age(then: Column, now: Column) -> Column:
    """How long ago: a moment, minutes, hours, days, and from 30 days on the date."""
    seconds = F.greatest(F.lit(0), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1_000_000 + 0.5))
    text = lambda n, unit: F.concat(F.lit("hace "), F.floor(seconds / n).cast("string"), F.lit(f" {unit}"))
    date = F.concat_ws("/", F.day(then).cast("string"), F.month(then).cast("string"), F.year(then).cast("string"))
    return F.when(then.isNull(), MISSING).when(seconds < 60, "hace un momento").when(seconds < 3600, text(60, "min")).when(seconds < 86_400, text(3600, "h")).when(seconds < 30 * 86_400, text(86_400, "d")).otherwise(date)


def _pick(names: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), at)


def day_and_time(ts: Column) -> Column:
    """12 ago, 14:35"""
    return F.coalesce(F.concat(F.day(ts).cast("string"), F.lit(" "), _pick(SHORT_MONTHS, F.month(ts) - 1), F.date_format(ts, ", HH:mm")), F.lit(MISSING))


def match_date(ts: Column, long: bool = False) -> Column:
    """sáb, 12 ago, 14:35 or sábado, 12 de agosto, 14:35; null for null."""
    day = _pick(DAYS if long else SHORT_DAYS, F.dayofweek(ts) - 1)
    month = F.concat(F.lit(" de " if long else " "), _pick(MONTHS if long else SHORT_MONTHS, F.month(ts) - 1))
    return F.concat(day, F.lit(", "), F.day(ts).cast("string"), month, F.date_format(ts, ", HH:mm"))


def euros(cents: Column) -> Column:
    """Whole cents as money: 1234,50 € (a no-break space); groups of thousands from five digits on."""
    whole, part = F.floor(F.abs(cents) / 100), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0")
    grouped = F.when(whole >= 10_000, F.translate(F.format_number(whole, 0), ",", ".")).otherwise(whole.cast("string"))
    return F.coalesce(F.concat(F.when(cents < 0, "-").otherwise(""), grouped, F.lit(","), part, F.lit("\u00a0€")), F.lit(MISSING))


def one_decimal(value: Column) -> Column:
    return F.when(value.isNull(), MISSING).otherwise(F.format_string("%.1f", value.cast("double")))


def to_next_quarter(ts: Column) -> Column:
    """Milliseconds to the next full quarter of an hour; 15 minutes at a full one."""
    quarter = 15 * 60 * 1_000_000
    return F.floor((F.lit(quarter) - F.unix_micros(ts.cast("timestamp")) % quarter) / 1000)


def countdown(milliseconds: Column) -> Column:
    """en 42s, en 4:07 (below ten minutes), en 14 min."""
    s = F.greatest(F.lit(0), F.floor(milliseconds / 1000 + 0.5))
    minutes = F.floor(s / 60)
    return F.when(s < 60, F.concat(F.lit("en "), s.cast("string"), F.lit("s"))).when(minutes < 10, F.concat(F.lit("en "), minutes.cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))).otherwise(F.concat(F.lit("en "), minutes.cast("string"), F.lit(" min")))


def birth_day(value: Column) -> Column:
    """The digits of a date; blank for null."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"\D", "")


def nationality(value: Column) -> Column:
    """Plain capital letters; blank for null."""
    return F.regexp_replace(strip_accents(F.upper(F.coalesce(value, F.lit("")))), "[^A-Z]", "")


def club_known(local: Column, name: Column, slug: Column) -> Column:
    """Whether all telling words of a local club stand in a name and slug; null if neither is known, false if the local
    club has no telling word."""
    ours = F.array_except(F.filter(F.split(fold_name(local), " "), lambda t: t != ""), F.array(*map(F.lit, STOP_WORDS)))
    theirs = F.split(fold_name(F.concat_ws(" ", name, F.translate(slug, "-", " "))), " ")
    return F.when(name.isNull() & slug.isNull(), None).otherwise((F.size(ours) > 0) & (F.size(F.array_except(ours, theirs)) == 0))


def club_within(a: Column, b: Column) -> Column:
    """Whether two club names are equal or one holds the other; false where either is blank."""
    x, y = fold_name(a), fold_name(b)
    return F.coalesce((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False))
