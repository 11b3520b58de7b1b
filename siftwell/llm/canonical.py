"""Free-entered values mapped to a canonical list with a BK-tree under a true edit metric.

The metric is the unrestricted Damerau-Levenshtein distance on folded text, so the triangle
inequality prunes subtrees without losing an entry within the threshold. The tree holds each entry and its other
spellings that are no mistakes, which are met at distance 0 only. Each distinct typed value is searched once. A
reference list of up to `shard_size` entries is one tree that every task holds; a longer one is split into shards, every
value searches each of them, and what they found is merged: the answer does not depend on the number of shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.names import FORMAL, edits, fold, plain, squash
from siftwell.operators.skew import lookup_join
from siftwell.session import materialise

UNMATCHED = "(unmatched)"
SHARD = 20_000

# Other words for the sales stages.
STATUS_WORDS = {
    "New": "neu nuevo nouveau brandnew freshnew",
    "Contacted": "ctd contactmade kontaktiert contactado contacté",
    "Connected": "conn verbunden conectado",
    "Qualified": "qlfd qual qualifiziert cualificado qualifié",
    "Opportunity": "opp oppty openopportunity oportunidad chance",
    "Closed Won": "won gewonnen clwon ganado gagné closewon",
    "Closed Lost": "lost verloren cllost perdido perdu closelost",
}

# Names of countries that are in use but neither codes nor a language's usual name.
INFORMAL = {
    "Bolivia": "Plurinational State of Bolivia", "Cabo Verde": "Cape Verde", "China": "PRC|P.R. China|People's Republic of China|Mainland China", "Congo - Kinshasa": "DRC|Zaire|DR Congo", "Czechia": "Czech Republic|Czech Rep.",
    "Côte d’Ivoire": "Ivory Coast", "Eswatini": "Swaziland", "France": "French Republic|République française", "Germany": "BRD|FRG", "Greece": "Hellas", "India": "Bharat", "Iran": "Persia|Islamic Republic of Iran", "Ireland": "Éire", "Japan": "Nippon|Nihon",
    "Laos": "Lao PDR", "Malaysia": "Msia", "Myanmar (Burma)": "Burma|Myanmar", "Netherlands": "Holland", "New Zealand": "Aotearoa", "North Korea": "DPRK", "North Macedonia": "Macedonia|FYROM", "Russia": "Russian Federation",
    "Saudi Arabia": "KSA|Saudi", "Slovakia": "Slovak Republic", "South Africa": "RSA", "South Korea": "Korea|ROK", "Sri Lanka": "Ceylon", "Switzerland": "Swiss Confederation|Helvetia", "Thailand": "Siam", "Timor-Leste": "East Timor",
    "Turkey": "Türkiye", "United Arab Emirates": "Emirates|The Emirates", "United Kingdom": "Great Britain|Britain", "United States": "America|the States|United States of America", "Vatican City": "Holy See", "Vietnam": "Viet Nam",
}
#: Languages whose names of countries are known spellings, beside the country's own codes.
LANGUAGES = "en de fr es it pt nl sv nb da fi is pl cs sk sl hu ro hr el tr ru uk ja ko zh ar he hi th vi id".split()
# Words of official names that name no country.
_OFFICIAL = frozenset("the of and du de la republic republique republica republik rep kingdom konigreich royaume reino fed federal federation bundesrepublik state".split())


def country_words(spark: SparkSession, entries: list[str]) -> dict[str, list[str]]:
    """{entry: other spellings} for the entries that name a country: its ISO codes of two (in capitals) and three letters and its name in LANGUAGES, from the JVM's locale data (ISO 3166 and CLDR), and INFORMAL."""
    locale = spark.sparkContext._jvm.java.util.Locale
    informal = {squash(k): v.split("|") for k, v in INFORMAL.items()}
    named = {squash(e): e for e in entries}
    out: dict[str, list[str]] = {}
    for code in locale.getISOCountries():
        place = locale("", code)
        english = squash(place.getDisplayCountry(locale.ENGLISH))
        own = next((k for k in (english, *(squash(x) for x in informal.get(english, ()))) if k in named), None)
        if own:
            names = [place.getDisplayCountry(locale.forLanguageTag(x)) for x in LANGUAGES]
            out[named[own]] = [code, place.getISO3Country(), *names]
    for k, words in informal.items():
        if k in named:
            out.setdefault(named[k], []).extend(words)
    return out


def _words(text: str) -> list[str]:
    return [w for w in (squash(x) for x in re.split(r"[\s.,()\-]+", text)) if w]


def spellings(field: str, entry: str, words: list[str] = ()) -> Iterator[str]:  # type: ignore[assignment]
    """The other ways of writing an entry of a field that are no mistakes, before folding. words: those known from elsewhere."""
    yield from words
    if field == "status_raw":
        yield from STATUS_WORDS.get(entry, "").split()
    elif field == "country":
        own = entry.split()
        if len(own) > 1:  # U.A.E., Korea (South), S. Africa
            yield "".join(w[0] for w in own if w[0].isupper()).ljust(3)
            yield " ".join(own[::-1])
            yield f"{own[0][0]} {' '.join(own[1:])}"
    elif field == "owner_raw":
        first, _, last = entry.partition(" ")
        if last:
            own = fold(first)
            for given in [own, *(short for short, formal in FORMAL.items() if plain(own) in formal)]:
                yield from (f"{given} {last}", f"{last} {given}", f"{given} {last[0]}")
            yield from (f"{own[0]} {last}", f"{last} {own[0]}", f"{last} {own}"[: len(last) + 2])


class Tree:
    """A BK-tree over folded strings; each node holds the entries that fold to its string, or have a spelling that does."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, key: str, entry: object) -> None:
        if self.root is None:
            self.root = [key, [entry], {}]
            return
        node = self.root
        while d := edits(key, node[0]):
            if d not in node[2]:
                node[2][d] = [key, [entry], {}]
                return
            node = node[2][d]
        node[1].append(entry)

    def within(self, key: str, radius: int) -> list[tuple[int, str, object]]:
        """(distance, string, entry) of every entry within radius."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            text, entries, children = todo.pop()
            d = edits(key, text, max(children, default=0) + radius)
            if d <= radius:
                found += [(d, text, e) for e in entries]
            todo += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        return found


_BRACKETS, _NUMBERED, _SPLIT = re.compile(r"\s*[(\[].*?[)\]]\s*"), re.compile(r"^\W*\d+\W+"), re.compile(r"\s+[-–—/|]\s+|[:;|/]")


def reach(key: str, radius: int) -> int:
    """The edits within which an entry is met: none under three letters, one under five, else radius."""
    return 0 if len(key) < 3 else min(1, radius) if len(key) < 5 else radius


class Matcher:
    """What a field's entries, or a shard of them, know about a typed text: see hits()."""

    def __init__(self, field: str, entries: list[str], radius: int = 2, words: dict[str, list[str]] | None = None) -> None:
        self.field, self.radius, self.tree = field, radius, Tree()
        self.codes: dict[str, str] = {}
        self.parts: list[tuple[str, str, str]] = []
        for entry in sorted(set(entries)):
            if k := squash(entry):
                self.tree.add(k, (entry, True))
                self.parts.append((k[:1], k[-1:], entry))
            for text in spellings(field, entry, (words or {}).get(entry, ())):
                if len(text) == 2 and text.isupper():
                    self.codes[text] = entry
                elif (k := squash(text)) and k != squash(entry):
                    self.tree.add(k, (entry, False))

    def at(self, form: str, radius: int) -> list[tuple[int, bool, str, str]]:
        """(distance, whether by a spelling, string, entry) of what lies near a form of a text."""
        key = squash(form)
        found = self.tree.within(key, radius) if key else []
        if (other := plain(key)) != key and not radius:  # ue, oe, ae for umlauts
            found += self.tree.within(other, 0)
        return [(d, not own, text, entry) for d, text, (entry, own) in found if d <= (reach(text, radius) if own else 0)]

    def hits(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """(step, distance, -common beginning, -length, entry) of each entry near the text; step: how directly, the least one counts.

        0 a code; 1 the text and 2 the text without brackets and number is an entry; 3 and 4 such a spelling of one; 5 and 6 a part of it is; 7 what is left
        without words of official names; 8 letters left out for an apostrophe; 9 within the radius.
        """
        out: list[tuple[int, int, int, int, str]] = []
        if (code := text.strip()) in self.codes:
            out.append((0, 0, 0, 0, self.codes[code]))
        bare = _NUMBERED.sub("", _BRACKETS.sub(" ", text)) or text
        for step, form in enumerate((text, bare), 1):
            out += [(step + 2 * spelt, 0, 0, -len(k), e) for _, spelt, k, e in self.at(form, 0)]
        for part in _SPLIT.split(bare):
            out += [(5 + spelt, 0, 0, 0, e) for _, spelt, _, e in self.at(part, 0)]
        if self.field == "country":
            if (kept := [w for w in _words(text) if w not in _OFFICIAL]) and len(kept) < len(_words(text)):
                out += [(7, 0, 0, 0, e) for _, _, _, e in self.at(" ".join(kept), 0)]
            if m := re.fullmatch(r"\s*(\w+)['’](\w{2,})\s*", text):
                a, z = squash(m[1]), squash(m[2])
                out += [(8, 0, 0, 0, e) for e in (e for _, _, e in self.parts) if squash(e).startswith(a) and squash(e).endswith(z)]
        key = squash(bare)
        for d, spelt, k, e in self.at(bare, self.radius):
            if not spelt:
                same = next((n for n, (p, q) in enumerate(zip(key, k, strict=False)) if p != q), min(len(key), len(k)))
                out.append((9, d, -same, -len(k), e))
        return out


#: Steps at which two entries contradict each other; at the others the nearest one wins.
_STRICT = (0, 3, 4, 5, 6, 7, 8)


def match_values(values: DataFrame, ref: DataFrame, shard_size: int = SHARD, radius: int = 2) -> DataFrame:
    """(field, value, canonical) for distinct (field, value); canonical is null where nothing is near enough, or where the least step names two entries and the next ones none.

    ref (field, canonical) is counted first and split by a hash into shards of about shard_size entries; each goes to the
    tasks as one tree a field, so a task holds one shard at a time. Of each step a shard keeps its first and last entry; the merge
    of all shards sees whether a step is unanimous.
    """
    spark = values.sparkSession
    entries = ref.filter("field is not null and canonical is not null").select("field", "canonical").distinct()
    shards = max(1, -(-entries.count() // shard_size))
    out = "field string, value string, step int, d int, same int, size int, canonical string"
    found = None
    for shard in range(shards):
        own = entries if shards == 1 else entries.filter(F.pmod(F.xxhash64("canonical"), F.lit(shards)) == shard)
        lists: dict[str, list[str]] = {}
        for r in own.collect():  # about shard_size rows
            lists.setdefault(r["field"], []).append(r["canonical"])
        words = {"country": country_words(spark, lists["country"])} if "country" in lists else {}

        def search(batches: Iterator[pd.DataFrame], lists=lists, words=words) -> Iterator[pd.DataFrame]:
            matchers = {f: Matcher(f, e, radius, words.get(f)) for f, e in lists.items()}
            for batch in batches:
                rows = []
                for f, v in zip(batch["field"], batch["value"], strict=True):
                    got: dict[int, list] = {}
                    for h in matchers[f].hits(v) if f in matchers else ():
                        got.setdefault(h[0], []).append(h)
                    for own in got.values():
                        rows += [(f, v, *h) for h in {min(own), min(own, key=lambda h: h[4]), max(own, key=lambda h: h[4])}]
                yield pd.DataFrame(rows, columns=["field", "value", "step", "d", "same", "size", "canonical"])

        part = values.select("field", "value").mapInPandas(search, out)
        found = part if found is None else found.unionByName(part)
    steps = found.groupBy("field", "value", "step").agg(F.min(F.struct("d", "same", "size", "canonical")).alias("m"), F.min("canonical").alias("lo"), F.max("canonical").alias("hi"))
    sure = steps.filter((F.col("lo") == F.col("hi")) | ~F.col("step").isin(*_STRICT))
    return sure.groupBy("field", "value").agg(F.min(F.struct("step", "m"))["m"]["canonical"].alias("canonical"))


def map_values(df: DataFrame, ref: DataFrame, key: str = "id", fields: tuple[str, ...] = ("status_raw", "owner_raw", "country"), shard_size: int = SHARD) -> DataFrame:
    """One row (key, field, canonical) per row and field whose text is neither blank nor exactly an entry of ref for the field.

    canonical is the entry meant or '(unmatched)'. Null and white-space texts give no row;
    repeated rows repeat their results; other columns are ignored; without any entries every
    text is unmatched. Texts of over 200 characters are compared like any other.
    """
    cell = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    cells = df.select(F.col(key).alias("_key"), cell.alias("x")).select("_key", "x.field", "x.value").filter(F.regexp_replace("value", r"(?U)[\s\p{Z}]+", "") != "")
    known = ref.filter("field is not null and canonical is not null").select("field", F.col("canonical").alias("value")).distinct()
    typed = cells.join(known, ["field", "value"], "left_anti")
    found = materialise(match_values(typed.select("field", "value").distinct(), ref, shard_size), "matches")
    mapped = lookup_join(typed, found, ["field", "value"], "left")
    return mapped.select(F.col("_key").alias(key), "field", F.coalesce("canonical", F.lit(UNMATCHED)).alias("canonical"))
