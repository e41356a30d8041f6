"""Times of day, holidays, working days and schedule dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from campovia.functions.text import NULL_WORDS

# National holidays (month, day), days from Easter (Carnival twice, Good Friday), weekday labels from Monday.
FIXED_HOLIDAYS = ((1, 1), (4, 21), (5, 1), (9, 7), (10, 12), (11, 2), (11, 15), (11, 20), (12, 25))
EASTER_OFFSETS = (-48, -47, -2)
WEEKDAYS = ("Seg", "Ter", "Qua", "Qui", "Sex", "Sáb", "Dom")


def minutes_of_day(c: Column) -> Column:
    """H:MM, HH:MM:SS or plain minutes as 0 to 1439; anything else is null."""
    s = F.trim(c.cast("string"))
    pattern = r"^(\d{1,2}):(\d{2})(?::\d{2}(?:\.\d+)?)?$"
    hour, minute = F.regexp_extract(s, pattern, 1).try_cast("int"), F.regexp_extract(s, pattern, 2).try_cast("int")
    clock = F.when((hour < 24) & (minute < 60), hour * 60 + minute)
    number = F.replace(s, F.lit(","), F.lit(".")).try_cast("double").cast("int")
    plain = F.when((number >= 0) & (number < 1440), number)
    return F.when(s.rlike(pattern), clock).when(F.lower(s).isin(*NULL_WORDS), F.lit(None)).otherwise(plain).cast("int")


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian year, by integer arithmetic."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    g = div(b - div(b + 8, 25) + 1, 3)
    h = (19 * a + b - div(b, 4) - g + 15) % 30
    week = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * week, 451)
    total = h + week - 7 * m + 114
    return F.make_date(year, div(total, 31).cast("int"), (total % 31 + 1).cast("int"))


def holidays_of(year: Column) -> Column:
    """The national holidays of a year as an array of dates."""
    fixed = [F.make_date(year, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    return F.array_distinct(F.array(*fixed, *(F.date_add(easter(year), n) for n in EASTER_OFFSETS)))


def working_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day, nth): Monday to Friday without national holidays, both ends included, numbered from 1.

    One row a day of the period, so the number of rows is bounded by its length.
    """
    days = spark.sql("SELECT explode(sequence(DATE '%s', DATE '%s')) AS day" % (first, last)) if first <= last else spark.sql("SELECT DATE '1970-01-01' AS day").limit(0)
    open_days = days.where((F.weekday("day") < 5) & ~F.array_contains(holidays_of(F.year("day")), F.col("day")))
    return open_days.withColumn("nth", F.row_number().over(Window.orderBy("day")))


def effective_date(planned: Column, date: Column) -> Column:
    """The planned date if there is one."""
    return F.coalesce(planned, date)


def effective_status(stored: Column, date: Column, today: Column) -> Column:
    """A pending visit is vencida once its date has passed and a_realizar until then; other statuses stay."""
    return F.when(stored != "pendente", stored).when(date < today, "vencida").otherwise("a_realizar")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, rounded."""
    return F.round(F.unix_micros(end) / 1e6 - F.unix_micros(start) / 1e6).cast("long")


def weekday_label(date: Column) -> Column:
    """The Portuguese short name of the weekday."""
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(date) + 1)


def itinerary_message(name: Column, date: Column, visits: Column, km: Column) -> Column:
    """A seller's message: greeting, one numbered line a visit in order (array of structs seq, name, address), closing count."""
    first = F.initcap(F.split(F.trim(name), r"\s+")[0])
    line = lambda v: F.concat(F.lit("*"), v["seq"].cast("string"), F.lit(".* "), v["name"], F.when(v["address"] != "", F.concat(F.lit("\n"), v["address"])).otherwise(""))
    lines = F.array_join(F.transform(F.array_sort(visits), line), "\n\n")
    distance = F.coalesce(F.concat(F.lit(" | ~"), F.round(km).cast("long").cast("string"), F.lit(" km")), F.lit(""))
    return F.concat(
        F.lit("*Roteiro - "), F.date_format(date, "dd/MM/yyyy"), F.lit(" ("), weekday_label(date), F.lit(")*\n\nOlá, "), first, F.lit("!\n\n"),
        lines, F.lit("\n\n---\n*"), F.size(visits).cast("string"), F.lit(" visita(s)"), distance, F.lit("*"),
    )
