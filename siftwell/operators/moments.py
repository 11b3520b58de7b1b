"""Moments written in many ways, with or without a zone, as one point in UTC.

A text is matched against a handful of layouts and taken apart once; the parts give a local
time in microseconds. Local times that state no offset are joined as of the zone-offset
intervals of their zone, exploded to one row per zone and year: two matching intervals mean
that the local time occurs twice (the first one is taken), none that it is skipped (it moves
forward by the skipped length), one gives the offset directly.

All of it is built-in expressions and one broadcast join; rows are never shuffled. The
interval table holds (zones x 201 years) rows; zone names come from the IANA list, so it is
bounded by about 600 x 201 rows whatever the input.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST_YEAR, LAST_YEAR = 1900, 2100
DAY = 86_400_000_000

# Zone abbreviations and their fixed offsets in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "AWST": 480,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180,
}

# Month names in English, German, French, Spanish, and their common short forms.
MONTHS = {
    1: "jan january januar janvier janv enero ene jänner",
    2: "feb february februar février févr fevrier febrero",
    3: "mar march märz maerz mär mars marzo mrz",
    4: "apr april avril avr abril abr",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet juil julio",
    8: "aug august août aout agosto ago",
    9: "sep sept september septembre septiembre",
    10: "oct october oktober okt octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec december dezember dez décembre déc decembre diciembre dic",
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm](?![A-Za-z])\.?)?"
_ZONE = r"(?:\s*([A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?|[A-Za-z]+(?:/[A-Za-z_+-]+)+)?(?:\[([A-Za-z_+/-]+)\])?)"
_TAIL = rf"(?:(?:[T,]?\s*)(?<=[T,\s]){_TIME}{_ZONE})?$"
#: Layout name, pattern, and the replacement that brings its groups into the order
#: kind | a | b | c | hour | minute | second | fraction | half of day | zone | zone in brackets
LAYOUTS = [
    ("ymd", rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){_TAIL}", "ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("slash", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}){_TAIL}", "slash|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("dmy", rf"^(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}}|\d{{2}}){_TAIL}", "dmy|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("dmony", rf"^(?:\p{{L}}+\.?,?\s+)?(\d{{1,2}})[-.\s]+(\p{{L}}+)\.?[-,\s]+(\d{{4}}|\d{{2}}){_TAIL}", "dmony|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("mondy", rf"^(\p{{L}}+)\.?\s+(\d{{1,2}}),?\s+(\d{{4}}){_TAIL}", "mondy|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("packed", r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:\.(\d{1,9}))?(Z|[+-]\d{2}:?\d{2})?$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8|"),
]
_COUNT = r"^[+-]?\d{9,14}$"


def zone_intervals(zones: list[str]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Per zone its intervals of constant offset: (first UTC second, first UTC second after it, offset in seconds)."""
    out, known = [], available_timezones()
    start, end = datetime(FIRST_YEAR - 1, 12, 30, tzinfo=UTC), datetime(LAST_YEAR + 1, 1, 2, tzinfo=UTC)
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    for name in sorted(set(zones)):
        if name not in known:
            continue
        zone = ZoneInfo(name)
        offset = lambda t, zone=zone: int(t.astimezone(zone).utcoffset().total_seconds())
        at, value, parts, since = start, offset(start), [], start
        while at < end:
            ahead = min(at + timedelta(days=20), end)
            if offset(ahead) != value:
                low, high = at, ahead
                while high - low > timedelta(seconds=1):
                    mid = low + timedelta(seconds=(high - low).total_seconds() // 2)
                    low, high = (mid, high) if offset(mid) == value else (low, mid)
                parts.append((int((since - epoch).total_seconds()), int((high - epoch).total_seconds()), value))
                since, at, value = high, high, offset(high)
            else:
                at = ahead
        parts.append((int((since - epoch).total_seconds()), int((end - epoch).total_seconds()), value))
        out.append((name, parts))
    return out


_INTERVALS = T.StructType([
    T.StructField("zone_name", T.StringType()),
    T.StructField("zone_year", T.IntegerType()),
    T.StructField("parts", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("lo", "hi", "off")]))),
])


def interval_table(spark: SparkSession, zones: list[str]) -> DataFrame:
    """One row per zone and local year with the intervals (local microseconds, end exclusive) that touch it, in order."""
    rows, epoch = [], datetime(1970, 1, 1)
    for name, parts in zone_intervals(zones):
        local = [((lo + off) * 1_000_000, (hi + off) * 1_000_000, off * 1_000_000) for lo, hi, off in parts]
        local[0], local[-1] = (-(2**62), *local[0][1:]), (local[-1][0], 2**62, local[-1][2])
        first = 0
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            lo = -(2**61) if year == FIRST_YEAR else int((datetime(year, 1, 1) - epoch).total_seconds() - 172_800) * 1_000_000
            hi = 2**61 if year == LAST_YEAR else int((datetime(year + 1, 1, 1) - epoch).total_seconds() + 172_800) * 1_000_000
            while local[first][1] <= lo and first < len(local) - 1:
                first += 1
            own = []
            for part in local[max(0, first - 1) :]:
                if part[0] >= hi:
                    break
                own.append(part)
            rows.append((name, year, own))
    return spark.createDataFrame(rows, _INTERVALS)


def _number(text: Column) -> Column:
    return F.when(text != "", text).cast("int")


def parts_of(text: Column) -> Column:
    """The fields of a written moment as array<string>, or null if no layout fits."""
    return F.split(F.coalesce(*[F.when(F.rlike(text, F.lit(p)), F.regexp_replace(text, p, r)) for _, p, r in LAYOUTS]), r"\|", -1)


def _month(text: Column) -> Column:
    names = [x for k, v in MONTHS.items() for n in v.split() for x in (F.lit(n), F.lit(k))]
    return F.element_at(F.create_map(*names), F.lower(text))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def local_fields(df: DataFrame, text: str, order: Column) -> DataFrame:
    """Adds local_us (local microseconds, null if the text names no moment), zone_us (stated offset) and zone_text (stated zone name).

    order: a column that is 'dmy' where slashed dates are day first.
    """
    p = F.col("_p")
    get = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))
    kind, a, b, c = (get(i) for i in range(4))
    year_text = F.when(kind == "ymd", a).otherwise(c)
    year = F.when(F.length(year_text) == 2, _number(year_text) + 2000).otherwise(_number(year_text))
    day_first = (kind == "dmy") | ((kind == "slash") & (order == "dmy"))
    month = F.when(kind == "dmony", _month(b)).when(kind == "mondy", _month(a)).when(F.lower(kind) == "ymd", _number(b)).when(day_first, _number(b)).otherwise(_number(F.when(kind == "slash", a)))
    day = F.when(kind == "ymd", _number(c)).when((kind == "dmony") | day_first, _number(F.when((kind == "dmony") | day_first, a))).otherwise(_number(F.when((kind == "mondy") | (kind == "slash"), b)))
    half = F.lower(get(8))
    hour0 = F.coalesce(_number(get(4)), F.lit(0))
    hour = F.when(half == "", hour0).when(hour0.between(1, 12), hour0 % 12 + F.when(half == "p", 12).otherwise(0))
    minute, second = F.coalesce(_number(get(5)), F.lit(0)), F.coalesce(_number(get(6)), F.lit(0))
    micro = F.rpad(F.substring(get(7), 1, 6), 6, "0").cast("int")
    # Each generator keeps Catalyst from pushing later filters below it, which would copy the whole expression.
    df = df.withColumn("_t", F.explode(F.array(trimmed(F.col(text)))))
    df = df.withColumn("_p", F.explode(F.array(parts_of(F.col("_t")))))
    df = df.withColumns({"_y": year, "_m": month, "_d": day, "_h": hour, "_s": minute * 60 + second, "_u": micro, "_ok": (minute < 60) & (second < 60), "_z": get(9), "_b": get(10)})
    start = F.when((F.col("_y").between(1, 9999)) & F.col("_m").between(1, 12), F.make_date(F.col("_y"), F.col("_m"), F.lit(1)))
    valid = F.col("_ok") & F.col("_h").between(0, 23) & F.col("_d").between(1, F.dayofmonth(F.last_day(start)))
    count = F.when(F.rlike(F.col("_t"), F.lit(_COUNT)), F.col("_t").cast("bigint"))
    z = F.col("_z")
    sign = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(z, "[^0-9]", "")
    hours, mins = F.substring(digits, 1, 2).cast("int"), F.coalesce(_number(F.substring(digits, 3, 2)), F.lit(0))
    numeric = F.when(F.rlike(z, F.lit(r"^[+-]\d")) & (hours <= 18) & (mins < 60), sign * (hours * 60 + mins))
    fixed = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    offset = F.coalesce(numeric, F.element_at(fixed, F.upper(z)))
    named = F.when(F.contains(z, F.lit("/")), z).when(z == "", F.nullif(F.col("_b"), F.lit("")))
    df = df.withColumn("_x", F.explode(F.array(F.struct(
        F.when(count.isNotNull(), F.lit(0)).otherwise(offset).cast("bigint").alias("zone_minutes"),
        named.alias("zone_text"),
        F.when(count.isNotNull(), F.when(F.abs(count) >= 100_000_000_000, count * 1000).otherwise(count * 1_000_000)).when(
            valid & ((z == "") | offset.isNotNull() | named.isNotNull()),
            (F.unix_date(start).cast("bigint") + F.col("_d") - 1) * DAY + (F.col("_h") * 3600 + F.col("_s")).cast("bigint") * 1_000_000 + F.col("_u"),
        ).alias("local_us"),
    ))))
    df = df.withColumns({"zone_us": F.col("_x.zone_minutes") * 60_000_000, "zone_text": F.col("_x.zone_text"), "local_us": F.col("_x.local_us")})
    return df.drop("_x", "_t", "_p", "_y", "_m", "_d", "_h", "_s", "_u", "_ok", "_z", "_b")


def to_utc(df: DataFrame, intervals: DataFrame, zone: str = "zone_used", local: str = "local_us", stated: str = "zone_us", out: str = "utc_micros") -> DataFrame:
    """Adds the moment in UTC, as-of joining local times to the intervals of their zone; see the module's text.

    An unknown zone name gives null. `how_found` says which case held: stated, direct, ambiguous or nonexistent.
    """
    year = F.year(F.date_from_unix_date(F.floor(F.col(local) / DAY).cast("int")))
    keyed = df.withColumn("_year", F.when(F.col(stated).isNull(), F.least(F.lit(LAST_YEAR), F.greatest(F.lit(FIRST_YEAR), year))))
    keyed = keyed.join(F.broadcast(intervals), (keyed[zone] == intervals["zone_name"]) & (keyed["_year"] == intervals["zone_year"]), "left")
    at = F.col(local)
    fits = F.filter("parts", lambda x: (x["lo"] <= at) & (at < x["hi"]))
    before = F.filter("parts", lambda x: x["hi"] <= at)
    return (
        keyed.withColumn("_fits", fits)
        .withColumn("_off", F.when(F.size("_fits") > 0, F.get("_fits", F.lit(0))["off"]).otherwise(F.element_at(F.when(F.size(before) > 0, before), -1)["off"]))
        .withColumn(out, F.col(local) - F.coalesce(F.col(stated), F.col("_off")))
        .withColumn("how_found", F.when(F.col(out).isNull(), None).when(F.col(stated).isNotNull(), "stated").when(F.size("_fits") > 1, "ambiguous").when(F.size("_fits") == 1, "direct").otherwise("nonexistent"))
        .drop("_year", "_fits", "_off", "zone_name", "zone_year", "parts")
    )


def normalise_moments(
    df: DataFrame,
    origins: DataFrame,
    key: str = "id",
    fields: tuple[str, ...] = ("created_at", "updated_at"),
    origin: str = "origin",
    default_zone: str = "UTC",
    default_order: str = "mdy",
) -> DataFrame:
    """One row (key, field, utc_micros, how_found) per field whose text names an existing moment.

    origins: one row per origin with zone_name and slash_order (repeated rows: the first in
    order of zone_name counts). A null or unknown origin means default_zone and default_order.
    Null, blank, unreadable texts and dates that no calendar has give no row; repeated input
    rows give repeated results; other columns of df are ignored, whatever their names; an
    empty table gives an empty result. Texts of any length are read whole: white space
    around a moment does not matter, however long.
    """
    spark = df.sparkSession
    cells = df.select(F.col(key).alias("_key"), F.col(origin).alias("_origin"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("_x"))
    cells = cells.select("_key", "_origin", "_x.field", "_x.text").filter("text <> ''")
    rules = origins.groupBy(F.col(origin).alias("_origin")).agg(F.min(F.struct("zone_name", "slash_order")).alias("_r")).select("_origin", F.col("_r.zone_name").alias("_zone"), F.col("_r.slash_order").alias("_order"))
    cells = cells.join(rules, "_origin", "left")
    cells = local_fields(cells, "text", F.coalesce(F.col("_order"), F.lit(default_order))).filter(F.col("local_us").isNotNull())
    cells = cells.withColumn("zone_used", F.coalesce("zone_text", "_zone", F.lit(default_zone)))
    # The names that occur are at most those of the IANA list; only texts with a slash after a letter can hold one.
    texts = [df.filter(F.rlike(F.col(f).cast("string"), F.lit(r"[A-Za-z]/[A-Za-z]"))).select(F.regexp_extract(F.col(f).cast("string"), r"([A-Za-z_]+(?:/[A-Za-z_+-]+)+)", 1).alias("z")) for f in fields]
    named = texts[0]
    for other in texts[1:]:
        named = named.unionByName(other)
    zones = [r["z"] for r in named.unionByName(origins.select(F.col("zone_name").alias("z"))).filter(F.col("z").isin(sorted(available_timezones()))).distinct().collect()]
    found = to_utc(cells, interval_table(spark, [*zones, default_zone]))
    return found.filter(F.col("utc_micros").isNotNull()).select(F.col("_key").alias(key), "field", "utc_micros", "how_found")
