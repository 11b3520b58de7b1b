"""What identifies a person in a lead: the name in parts, the mailbox, the phone line, the firm.

Everything here works on distinct texts in Arrow batches; nothing depends on other rows except
the table of given names, which is learned from all of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.names import FORMAL, PARTICLES, TITLES, edits, fold, name_parts, plain, squash
from siftwell.session import observed

#: Mail providers open to everybody: their domain says nothing about a firm.
PROVIDERS = frozenset({"postvane", "gmail", "googlemail", "outlook", "hotmail", "yahoo", "icloud", "aol", "gmx", "proton"})

# Shared mailboxes of a firm.
ROLES = frozenset("info office hello sales contact admin support mail team service help enquiries billing accounts hr marketing kontakt post".split())

# Legal forms and words of trade in firms' names, with common short forms.
LEGAL = frozenset("the ltd limited pty pte llc ab ag gmbh mbh gesellschaft group grp oy inc sa srl bv co company and corp corporation plc nv kg spa sl sarl as aps incorporated aktiengesellschaft osakeyhtio aktiebolag".split())
TRADE = frozenset(
    "accounting advisory aerospace agency agriculture agro analytics apparel architects associates automation automotive aviation bank banking beverages biotech brewing broadcasting builders building capital catering ceramics "
    "chemicals cleaning clothing coatings communications components computing construction consultants consulting contractors cosmetics couriers dairy data dental design development diagnostics digital distribution education "
    "electric electrical electronics energy engineering entertainment environmental enterprises equipment events exports fabrics farms fashion finance financial fisheries fittings foods forestry freight furniture gaming "
    "glass global graphics hardware health healthcare holding holdings hospitality hotels imaging imports industrial industries instruments insurance interiors international investments labs laboratories laser leasing legal lighting "
    "logistics machinery management manufacturing marine marketing materials media medical metals mining mobility motors music networks nutrition optics outdoor packaging paints paper partners pharma pharmaceuticals photonics plastics "
    "plumbing power precision printing products properties publishing realty recruitment recycling renewables research resources restaurants retail robotics rubber safety sciences security seeds semiconductors services shipping software "
    "solar solutions sports stationery steel storage stores studio studios supplies supply systems technologies technology telecom textiles tiles timber tobacco tools tourism toys trading training transport travel ventures "
    "veterinary water welding wholesale wines wireless wood "
    "eng log sol tech techs cons ins intl matls mfg pkg instr sw svcs mgmt dev dist".split()
)
_WORD = re.compile(r"[^\W_]+(?:[.'’][^\W_]+)*\.?")


@lru_cache(maxsize=200_000)
def firm_core(text: str) -> str:
    """The distinctive part of a firm's name: folded, without legal forms, words of trade and marks."""
    words = [squash(w) for w in _WORD.findall(fold(text))]
    words = [w for w in words if w]
    kept = [w for w in words if w not in LEGAL and w not in TRADE]
    return "".join(kept) or "".join(w for w in words if w not in LEGAL) or "".join(words)


@lru_cache(maxsize=200_000)
def domain_core(root: str) -> str:
    """The distinctive part of a mail domain's first label, '' for open providers."""
    if root in PROVIDERS:
        return ""
    first, *rest = fold(root).split("-")
    if rest and all(r in TRADE or r in LEGAL for r in rest):
        return squash(first)
    whole = squash(root)
    for word in TRADE:
        if len(word) > 3 and whole.endswith(word) and len(whole) - len(word) >= 4:
            return whole[: -len(word)]
    return whole


def mailbox(email: str | None) -> tuple[str, bool]:
    """(mailbox apart from the way it is written, whether it is a role's); ('', False) if there is none."""
    if not email:
        return "", False
    text = fold(email).strip()
    local, at, host = text.partition("@")
    if not at:
        local, at, host = text.partition(" ")
    local = local.split("+")[0].strip()
    root = host.strip().split(".")[0]
    return (f"{local}@{root}", local in ROLES) if local and root else ("", False)


_EXTENSION = re.compile(r"(?i)\s*(?:ext|extension|x|durchwahl|dw|#)\.?\s*\d+\s*$")


def phone_line(raw: str | None, digits: str | None = None) -> str:
    """The last nine digits of the line without extension, '' for anything shorter than seven digits."""
    text = _EXTENSION.sub("", raw) if raw else (digits or "")
    found = re.sub(r"\D", "", text)
    return found[-9:] if len(found) >= 7 and len(set(found[-9:])) > 1 else ""


@lru_cache(maxsize=200_000)
def person(text: str | None, given_names: frozenset[str] = frozenset()) -> tuple[str, str]:
    """(given, family) folded; turned round where only the second is a known given name."""
    given, family, others = name_parts(text)
    if not family:
        return "", ""
    known = lambda t: t in given_names or t in FORMAL
    if given and known(family) and not known(given) and len(given) > 1:
        given, family = family, given
    elif len(family) == 1 and len(given) > 1:
        given, family = family, given
    return given, family


def formal(given: str) -> frozenset[str]:
    return FORMAL.get(given, frozenset()) | {given}


def full_form(given: str) -> str:
    """The full name behind a pet form, the first in order of several; any other name as it is."""
    return min(FORMAL[given]) if given in FORMAL else given


def same_given(a: str, b: str, given_names: frozenset[str]) -> bool:
    if a == b:
        return True
    if not a or not b:
        return False
    if len(a) == 1 or len(b) == 1:
        return any(x[0] == y[0] for x in formal(a) for y in formal(b))
    if formal(a) & formal(b):
        return True
    if a in given_names and b in given_names:
        return False
    for x in formal(a):
        for y in formal(b):
            if edits(x, y, 2) <= (1 if min(len(x), len(y)) < 4 else 2) and not (x in given_names and y in given_names):
                return True
    return False


def same_family(a: str, b: str) -> bool:
    if a == b:
        return True
    return bool(a and b) and edits(a, b, 2) <= (1 if min(len(a), len(b)) < 5 else 2)


def same_name(a: tuple[str, str], b: tuple[str, str], given_names: frozenset[str]) -> bool:
    """Whether two names can be one person's: families within two edits, given names equal, short, a pet form or mistyped."""
    if same_family(a[1], b[1]) and same_given(a[0], b[0], given_names):
        return True
    return bool(a[0] and b[0]) and len(a[0]) > 2 and len(b[0]) > 2 and same_family(a[0], b[1]) and same_given(a[1], b[0], given_names) and same_family(a[1], b[0])


def given_name_table(leads: DataFrame, name: str = "display_name", share: float = 0.0005, least: int = 3) -> list[str]:
    """Folded words that occur in at least `share` as many different names as there are rows (and in `least`).

    A row adds at most a few words, so at most words-per-name / share words can reach that: the
    list is bounded whatever the input. It holds the given names in use: a family name occurs in few
    different names, a typing error of a given name in fewer than the name itself by far.
    """
    names = leads.filter(F.col(name).isNotNull()).groupBy(F.lower(name).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    words = names.select(F.explode(F.array_append(F.filter(F.array_distinct(F.split(F.regexp_replace("n", r"[^\p{L}'-]+", " "), " ")), lambda w: F.length(w) > 2), F.lit(""))).alias("w"), "rows")
    # '' stands for all rows.
    counts, found = observed(words.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")), "words", total=F.max(F.when(F.col("w") == "", F.col("rows"))))
    common = counts.filter((F.col("w") != "") & (F.col("n") >= max(least, share * (found["total"] or 0)))).collect()
    return sorted({plain(squash(r["w"])) for r in common if r["w"] not in TITLES and r["w"] not in PARTICLES})


#: The columns of a lead that tell who it is.
READ = ("display_name", "email", "phone_raw", "phone_digits", "domain_root", "company_name")
IDENTITY = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("batch_no", T.IntegerType()),
    T.StructField("given", T.StringType()), T.StructField("family", T.StringType()),
    T.StructField("mailbox", T.StringType()), T.StructField("role", T.BooleanType()), T.StructField("line", T.StringType()),
    T.StructField("firms", T.ArrayType(T.StringType())),
])


def identities(leads: DataFrame, given_names: list[str], add: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: T.StructType = IDENTITY) -> DataFrame:
    """One row per lead (id, batch_no, given, family, mailbox, role, line, firms); absent parts are ''. add: what else is done to each batch of them, with the schema it then has."""
    known = frozenset(given_names)
    base = leads.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("batch_no").cast("int"), F.lit(0)).alias("batch_no"), *[F.col(c).cast("string").alias(c) for c in READ])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = [person(n, known) for n in b["display_name"]]
            boxes = [mailbox(e) for e in b["email"]]
            firms = []
            for (box, _), root, company in zip(boxes, b["domain_root"], b["company_name"], strict=True):
                root = root or (box.partition("@")[2] if box else "")
                own = {firm_core(company) if company else "", domain_core(root) if root else ""} - {""}
                firms.append(sorted(x for x in own if len(x) > 2))
            own = pd.DataFrame({
                "id": b["id"], "batch_no": b["batch_no"], "given": [n[0] for n in names], "family": [n[1] for n in names],
                "mailbox": [x[0] for x in boxes], "role": [x[1] for x in boxes],
                "line": [phone_line(r, d) for r, d in zip(b["phone_raw"], b["phone_digits"], strict=True)], "firms": firms,
            })
            yield add(own) if add else own

    return base.mapInPandas(read, schema)


def evidence(people: DataFrame, *more: str) -> DataFrame:
    """(ev, kind, id, given, family, *more): one row per named lead and piece of evidence: mailbox, phone line, each firm. ev is a hash of kind and value."""
    piece = lambda kind, value: F.struct(F.xxhash64(F.lit(kind), value).alias("ev"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<ev: bigint, kind: string>>")
    pieces = F.concat(
        F.when(F.col("mailbox") != "", F.array(piece("mailbox", F.col("mailbox")))).otherwise(none),
        F.when(F.col("line") != "", F.array(piece("line", F.col("line")))).otherwise(none),
        F.transform("firms", lambda f: piece("firm", f)),
    )
    return people.filter("family <> ''").select("id", "given", "family", *more, F.explode(pieces).alias("x")).select("x.ev", "x.kind", "id", "given", "family", *more)
