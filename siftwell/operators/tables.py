"""The lead table: filters, paging, counts by dimension, profile, and changes to a snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.config import CHANNELS, FILLABLE, PATCHABLE, STATUSES
from siftwell.functions import clean
from siftwell.operators.classify import extract_source

FILTERS = ("status", "owner", "country", "channel", "q")


def with_source(leads: DataFrame, notes: str = "notes", page_url: Column | None = None, model: Column | None = None) -> DataFrame:
    """Adds source_channel, source_detail, source_confidence, source_method, source_taxonomy_gap from the note."""
    s = leads.withColumn("_s", F.explode(F.array(extract_source(F.col(notes), page_url, model))))
    return s.withColumns({f"source_{k}": F.col(f"_s.{k}") for k in ("channel", "detail", "confidence", "method", "taxonomy_gap")}).drop("_s")


def _canonical_status(value: str) -> str:
    bare = "".join(c for c in value.lower() if "a" <= c <= "z")
    return next((s for s in STATUSES if "".join(c for c in s.lower() if c.isalpha()) == bare), value)


def predicate(filters: dict[str, str | None]) -> Column:
    """One condition from the filters that are set: status, owner, country (both without case), channel, q (text in name, firm or address)."""
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    parts: list[Column] = []
    f = {k: v for k, v in filters.items() if v}
    if "status" in f:
        parts.append(F.col("status") == _canonical_status(f["status"]))
    if "owner" in f:
        parts.append(F.lower("owner") == " ".join(f["owner"].split()).lower())
    if "country" in f:
        parts.append(F.lower("country") == f["country"].strip().lower())
    if "channel" in f:
        parts.append(F.col("source_channel") == f["channel"])
    if "q" in f:
        needle = F.lit(f["q"].strip().lower())
        parts.append(reduce(lambda x, y: x | y, [F.contains(F.lower(F.coalesce(c, F.lit(""))), needle) for c in ("display_name", "company_name", "email")]))
    return reduce(lambda x, y: x & y, parts, F.lit(True))


def checked(name: str, value: object, default: int, low: int, high: int) -> int:
    if value is None or value == "":
        return default
    try:
        number = int(str(value))
    except ValueError:
        raise ValueError(f"{name} must be a whole number") from None
    if not low <= number <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return number


def page(leads: DataFrame, filters: dict[str, str | None] | None = None, limit: object = None, offset: object = None) -> tuple[DataFrame, DataFrame]:
    """(rows ordered by id, one row with the total) of the leads that fit; the page is the feature, the total covers all."""
    own = leads.filter(predicate(filters or {}))
    n, skip = checked("limit", limit, 50, 1, 500), checked("offset", offset, 0, 0, 10_000_000)
    return own.orderBy("id").offset(skip).limit(n), own.agg(F.count(F.lit(1)).alias("total"))


def dashboard(leads: DataFrame, dimensions: tuple[str, ...] = ("status", "owner", "country", "origin", "source_channel", "source_taxonomy_gap"), top: dict[str, int] | None = None) -> DataFrame:
    """(dimension, key, n, place) in one pass over the leads; null keys count as (unknown), gaps only where there is one.

    top: how many keys a dimension reports (country: 10), by count and then key. Counts are
    partially aggregated; what is ranked is one row per distinct key.
    """
    top = {"country": 10} if top is None else top
    cell = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions]))
    rows = leads.select(cell.alias("x")).select("x.dimension", "x.key").filter((F.col("dimension") != "source_taxonomy_gap") | F.col("key").isNotNull())
    counts = rows.groupBy("dimension", F.coalesce("key", F.lit("(unknown)")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "key"))
    most = reduce(lambda c, d: c.when(F.col("dimension") == d, F.lit(top[d])), top, F.when(F.lit(False), F.lit(0))).otherwise(F.lit(2_147_483_647))
    return counts.withColumn("place", place).filter(F.col("place") <= most)


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, fill_pct, distinct_values, always_empty) for each column, blank texts not counted as filled; one pass."""
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]))
    filled = F.trim(F.coalesce("v", F.lit(""))) != ""
    out = rows.select(cell.alias("x")).select("x.column", "x.v").groupBy("column").agg(F.count_if(filled).alias("filled"), F.count(F.lit(1)).alias("rows"), F.countDistinct(F.when(filled, F.col("v"))).alias("distinct_values"))
    return out.select("column", "filled", F.round(100 * F.col("filled") / F.col("rows"), 1).alias("fill_pct"), "distinct_values", (F.col("filled") == 0).alias("always_empty"))


def slash_dates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many slashed dates the columns hold and the greatest first and second part."""
    pattern = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    v = rows.select(F.explode(F.array(*[F.trim(F.col(c)) for c in columns])).alias("v")).filter(F.rlike("v", F.lit(pattern)))
    return v.agg(F.count(F.lit(1)).alias("slash_dates"), F.max(F.regexp_extract("v", pattern, 1).cast("int")).alias("max_first"), F.max(F.regexp_extract("v", pattern, 2).cast("int")).alias("max_second"))


def normalised(raw: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Raw export rows to the stored columns, in one projection; rows without a whole-number id are dropped.

    columns maps a field to the raw column that holds it; the default names are those of the export.
    """
    names = {"id": "Record ID", "first": "First Name", "last": "Last Name", "full": "Full Name", "email": "Email", "phone": "Phone Number", "job_title": "Job Title", "company": "Company Name", "country": "Country/Region", "status": "Lead Status", "lifecycle": "Lifecycle Stage", "source": "Original Source", "owner": "Contact Owner", "created": "Create Date", "updated": "Last Modified Date", "notes": "Notes", "score": "Lead Score"} | (columns or {})
    c = {k: (F.col(f"`{v}`").cast("string") if v in raw.columns else F.lit(None).cast("string")) for k, v in names.items()}
    some = lambda x: clean.blank_to_null(clean.trimmed(x))
    digits = clean.phone_digits(c["phone"])
    address = clean.email(c["email"])
    base = raw.select(
        clean.whole_number(c["id"]).cast("bigint").alias("id"), *[v.alias(k) for k, v in clean.resolved_name(c["first"], c["last"], c["full"]).items()], some(c["full"]).alias("full_name"),
        some(c["job_title"]).alias("job_title"), some(c["company"]).alias("company_name"), clean.blank_to_null(clean.company_core(c["company"])).alias("company_core"),
        address.alias("email"), clean.email_local(address).alias("email_local"), clean.blank_to_null(clean.email_domain(address)).alias("email_domain"), clean.blank_to_null(clean.domain_root(clean.email_domain(address))).alias("domain_root"),
        some(c["phone"]).alias("phone_raw"), clean.blank_to_null(digits).alias("phone_digits"), clean.blank_to_null(clean.phone_key(digits)).alias("phone_key"), clean.country(c["country"]).alias("country"),
        clean.status(c["status"]).alias("status"), c["status"].alias("status_raw"), some(c["lifecycle"]).alias("lifecycle_stage"), some(c["source"]).alias("original_source"), clean.owner(c["owner"]).alias("owner"), c["owner"].alias("owner_raw"),
        clean.date(c["created"]).alias("created_at"), clean.date(c["updated"]).alias("updated_at"), some(c["notes"]).alias("notes"), clean.whole_number(c["score"]).alias("lead_score"),
        F.lit("seed").alias("origin"), F.current_timestamp().alias("ingested_at"), F.to_json(F.struct(*[F.col(f"`{x}`") for x in raw.columns])).alias("raw_json"),
    )
    return with_source(base.filter("id is not null"))


def last_by_id(rows: DataFrame, sequence: str) -> DataFrame:
    """The last row of each id by the sequence column; a partial aggregation, no sort."""
    return rows.groupBy("id").agg(F.max(F.struct(F.col(sequence).alias("_s"), F.struct(*[c for c in rows.columns if c != "id"]).alias("_r"))).alias("m")).select("id", "m._r.*").select(*rows.columns)


def from_submissions(forms: DataFrame) -> DataFrame:
    """Form submissions as lead rows (submission_id kept); form_id and form_name are not trusted."""
    some = lambda x: clean.blank_to_null(clean.trimmed(F.col(x)))
    none = F.lit(None).cast("string")
    digits, address = clean.phone_digits(F.col("phone")), clean.email(F.col("email"))
    base = forms.select(
        "submission_id", *[v.alias(k) for k, v in clean.resolved_name(none, none, F.col("name")).items()], some("name").alias("full_name"), none.alias("job_title"), some("company").alias("company_name"),
        clean.blank_to_null(clean.company_core(F.col("company"))).alias("company_core"), address.alias("email"), clean.email_local(address).alias("email_local"), clean.blank_to_null(clean.email_domain(address)).alias("email_domain"),
        clean.blank_to_null(clean.domain_root(clean.email_domain(address))).alias("domain_root"), some("phone").alias("phone_raw"), clean.blank_to_null(digits).alias("phone_digits"), clean.blank_to_null(clean.phone_key(digits)).alias("phone_key"),
        clean.country(F.col("country")).alias("country"), F.lit("New").alias("status"), none.alias("status_raw"), F.lit("Lead").alias("lifecycle_stage"), none.alias("original_source"), none.alias("owner"), none.alias("owner_raw"),
        clean.date(F.col("submitted_at")).alias("created_at"), some("message").alias("notes"), F.lit(None).cast("int").alias("lead_score"), F.lit("form").alias("origin"), "page_url",
    )
    return with_source(base, page_url=F.col("page_url")).drop("page_url")


def allocate_ids(leads: DataFrame, rows: DataFrame, order: str, first: int = 100_000_000) -> DataFrame:
    """rows with an id after the greatest one in leads (or `first`), in the order of a column.

    Positions come from counts per range partition of that order, not from one sorted task.
    """
    top = leads.agg(F.coalesce(F.max("id"), F.lit(first)).alias("_top"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    ranged = rows.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    before = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return ranged.join(F.broadcast(before), "_p").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + 1 + F.col("_before") + F.col("_i")).drop("_m", "_p", "_i", "_n", "_before", "_top")


def check_patch(patch: dict[str, object]) -> dict[str, object]:
    if extra := set(patch) - set(PATCHABLE):
        raise ValueError(f"fields cannot be changed: {', '.join(sorted(extra))}")
    if not patch:
        raise ValueError("nothing to change")
    if "status" in patch:
        if not isinstance(patch["status"], str) or _canonical_status(patch["status"]) not in STATUSES:
            raise ValueError("unknown status")
    return patch


def apply_patches(leads: DataFrame, patches: DataFrame, today: Column | None = None, order: str | None = None) -> DataFrame:
    """The snapshot with patches (id, status, owner, notes; null means unchanged) applied; updated_at becomes today where a patch fits.

    A status that is no stage is an error of the caller (check_patch); here it changes nothing, and a patch that
    holds nothing else does not date the lead. Several patches of one id: per field the last one by the column `order`, the
    greatest value where no order is given.
    """
    fits = patches.filter(clean.status(F.col("status")).isNotNull() | F.col("owner").isNotNull() | F.col("notes").isNotNull())
    known = F.when(clean.status(F.col("status")).isNotNull(), F.col("status"))
    last = lambda value: F.max(value) if order is None else F.max_by(value, F.when(value.isNotNull(), F.col(order)))
    one = fits.groupBy("id").agg(last(known).alias("_status"), last(F.col("owner")).alias("_owner"), last(F.col("notes")).alias("_notes"), F.lit(True).alias("_hit"))
    df = leads.join(one, "id", "left")
    day = (F.current_date() if today is None else today).cast(dict(leads.dtypes)["updated_at"])
    return df.withColumns({
        "status": F.coalesce(clean.status(F.col("_status")), F.col("status")), "status_raw": F.when(clean.status(F.col("_status")).isNotNull(), F.col("_status")).otherwise(F.col("status_raw")),
        "owner": F.coalesce(clean.owner(F.col("_owner")), F.col("owner")), "owner_raw": F.coalesce("_owner", "owner_raw"), "notes": F.coalesce("_notes", "notes"),
        "updated_at": F.when(F.col("_hit"), day).otherwise(F.col("updated_at")),
    }).select(*leads.columns)


def enrich(leads: DataFrame, payloads: DataFrame) -> DataFrame:
    """(id, filled, the fillable columns, notes): what matched payloads (id, fillable columns, notes) add to leads; notes is a text or a list of texts. A text alone leaves the line break before it where the lead has no notes (as the SQL twin does), a list doesn't.

    Only blanks are filled, a note is added on a new line unless it is already contained; status and owner are never touched.
    """
    new = payloads.select("id", *[F.col(c).alias(f"_{c}") for c in (*FILLABLE, "notes")])
    df = leads.join(new, "id")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fills = {c: blank(c) & ~blank(f"_{c}") for c in FILLABLE}
    many = dict(payloads.dtypes)["notes"].startswith("array")
    given = F.col("_notes") if many else F.array("_notes")
    old = F.coalesce("notes", F.lit(""))

    def add(text: Column, note: Column) -> Column:
        note = F.trim(F.coalesce(note, F.lit("")))
        more = F.trim(F.concat(F.trim(text), F.lit("\n"), note))
        return F.when((note != "") & ~F.contains(text, note), F.when(F.trim(text) == "", note).otherwise(more) if many else more).otherwise(text)

    df = df.withColumn("_all", F.aggregate(F.coalesce(given, F.array().cast("array<string>")), old, add))
    adds = F.col("_all") != old
    filled = F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in fills.items()], F.when(adds, F.lit("notes"))))
    return df.select("id", filled.alias("filled"), *[F.when(t, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c, t in fills.items()], F.when(adds, F.col("_all")).otherwise(F.col("notes")).alias("notes"))


# What the export's own source column may say for each channel.
EXPECTED_SOURCES = {
    "Website": ["Direct Traffic"],
    "Organic Search": ["Organic Search"],
    "LinkedIn": ["Social Media"],
    "Referral": ["Referrals"],
    "Event": ["Offline Sources", "Other Campaigns"],
    "Manual/Sales": ["Other Campaigns"],
    "Other": ["Other Campaigns", "Paid Search", "Offline Sources"],
}
assert set(EXPECTED_SOURCES) == set(CHANNELS)


def source_agreement(leads: DataFrame) -> DataFrame:
    """(source_channel, n, agree) over leads whose original_source is not blank: a semi-join of each against the expected values."""
    table = F.create_map(*[x for k, v in EXPECTED_SOURCES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = leads.filter(F.trim(F.coalesce("original_source", F.lit(""))) != "")
    return own.groupBy("source_channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains(F.element_at(table, F.col("source_channel")), F.trim("original_source"))).alias("agree"))
