"""Deduplicating new batches against everything accepted before, with bit-difference fingerprints.

Every lead has up to four pieces of evidence (mailbox, phone line, firm by name, firm by
domain). With each goes a 64-bit fingerprint of the name: four blocks of 16 bits, each a
similarity hash of the letter pairs of one part of the name, so that a typing error changes a few bits
of a few blocks. The fingerprints are stored in rotated block tables: table r is keyed by the
evidence and block r. A new lead looks up its exact block matches in each table; what it
finds is verified by the Hamming distance of the whole fingerprints and then by the names
themselves. Its fingerprints are appended, so the history is never processed again.

The index is a folder: `blocks` (the rotated tables, and the names that their rows stand for by their hash, in buckets
by key) and `linked` (a log by batch: the new leads that were linked, and the stored persons that they showed to be
one). Both are only ever appended to. A batch is appended first and then looked up, so that one join finds its
matches in the history and in itself. It shuffles the new keys and what they meet; the stored buckets are read where
they lie, and no row of them if there is nothing to look up.

Leads of one evidence and one name are one row a batch (the smallest id) and are linked to it directly; only different
names that share evidence and a block are ever paired. A key holds names of one evidence with one block, so a firm with
a large part of all leads is spread over many keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.names import FORMAL
from siftwell.llm.people import IDENTITY, READ, evidence, full_form, given_name_table, identities, same_name
from siftwell.operators.components import LOCAL_LINKS, _finish, connected_components
from siftwell.operators.skew import HOT_LEAST, lookup_join
from siftwell.session import discard, exists, materialise, observed, release, shared_folder

#: Two names of one person differ in at most so many of the 64 bits; names that share one block by chance differ in about 24.
MOST_BITS = 28
#: Rows of the block tables that one bucket of a new index is made for.
BUCKET_ROWS = 2_000_000
LEAST_BUCKETS = 8

# Lane j of _LANES[x] is bit j of the byte x: the sums of eight votes are kept in one number.
_LANES = [sum((x >> j & 1) << (16 * j) for j in range(8)) for x in range(256)]


@lru_cache(maxsize=300_000)
def block(text: str, salt: int) -> int:
    """A 16-bit similarity hash of the letter pairs of text."""
    if not text:
        return 0
    padded, low, high = f"^{text}$", 0, 0
    n = len(padded) - 1
    for i in range(n):
        h = (ord(padded[i]) * 0x9E3779B1 + ord(padded[i + 1]) * 0x85EBCA77 + salt) & 0xFFFFFFFF
        h ^= h >> 15
        h = (h * 0x2C1B3C6D) & 0xFFFFFFFF
        h ^= h >> 12
        low += _LANES[h & 255]
        high += _LANES[h >> 8 & 255]
    return sum(1 << k for k in range(16) if 2 * ((low if k < 8 else high) >> (16 * (k & 7)) & 0xFFFF) > n)


def fingerprint(given: str, family: str) -> int:
    """The signed 64-bit fingerprint: family, given name (its full form), beginning and end of the family name with the initial."""
    full = full_form(given)
    parts = (family, full, full[:1] + family[:4], full[:1] + family[-4:])
    value = sum(block(p, i * 7919 + 17) << (16 * i) for i, p in enumerate(parts))
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprinted(leads: DataFrame, given_names: list[str]) -> DataFrame:
    """identities() with the fingerprint fp and the initials of each name; a name of which neither or each part is a given name in use may be written in either order and has a row for both."""
    known = frozenset(given_names) | frozenset(FORMAL)

    def add(b: pd.DataFrame) -> pd.DataFrame:
        one = lru_cache(maxsize=50_000)(fingerprint)
        turn = [len(g) > 2 and len(f) > 2 and (g in known) == (f in known) for g, f in zip(b["given"], b["family"], strict=True)]
        b = pd.concat([b, b[turn].rename(columns={"given": "family", "family": "given"})], ignore_index=True)
        pairs = list(zip(b["given"], b["family"], strict=True))
        return b.assign(fp=[one(g, f) for g, f in pairs], initials=[full_form(g)[:1] + f[:1] for g, f in pairs])

    schema = T.StructType([*IDENTITY.fields, T.StructField("fp", T.LongType()), T.StructField("initials", T.StringType())])
    return identities(leads, given_names, add, schema)


def one_per_name(people: DataFrame) -> DataFrame:
    """The rows of the block tables before rotation: per evidence and name the smallest id, the greatest, and the number n of rows.

    A mailbox of one's own gives one more row of kind 'box': of those with it the first lead, a named one before one without a
    name, whose family is ''. It serves the leads without a name.
    """
    named = evidence(people, "fp", "initials", "batch_no")
    names = named.groupBy("ev", "kind", "given", "family", "fp", "initials").agg(F.min("id").alias("id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"), F.min("batch_no").alias("batch_no"))
    box = people.filter("mailbox <> '' and not role").groupBy(F.xxhash64(F.lit("box"), F.col("mailbox")).alias("ev")).agg(F.min(F.struct(F.col("family") == "", F.col("id"), F.col("family"), F.col("batch_no"))).alias("m"))
    first = box.select("ev", F.lit("box").alias("kind"), F.lit("").alias("given"), F.col("m.family").alias("family"), F.lit(0).cast("bigint").alias("fp"), F.lit("").alias("initials"), F.col("m.id").alias("id"), F.col("m.id").alias("last_id"), F.lit(1).cast("bigint").alias("n"), F.col("m.batch_no").alias("batch_no"))
    return names.unionByName(first).withColumn("c", F.xxhash64("ev", "given", "family"))


#: Of a firm's leads those are compared that share the family name's block or the given name's; mailboxes and lines use all four tables.
TABLES = {"mailbox": 4, "line": 4, "firm": 2, "box": 1}


def rotated(names: DataFrame) -> DataFrame:
    """(key, c, fp): the rotated block tables of names, one row per table, keyed by evidence and block (and an initial where the block alone is common). A box has one row, its fp says whether its lead is without a name."""
    bits = lambda r: F.shiftrightunsigned("fp", 16 * r).bitwiseAND(F.lit(0xFFFF))
    key = lambda r: F.xxhash64("ev", F.lit(r), bits(r), F.substring("initials", -1, 1) if r == 1 else F.lit(""))
    number = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in TABLES.items()])
    box = F.col("kind") == "box"
    keys = F.when(box, F.array(F.xxhash64("ev", F.lit("box")))).otherwise(F.slice(F.array(*[key(r) for r in range(4)]), F.lit(1), number))
    return names.select(F.explode(keys).alias("key"), "c", F.when(box, (F.col("family") == "").cast("bigint")).otherwise(F.col("fp")).alias("fp"), box.alias("box"))


def met(new: DataFrame, table: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(ca, cb): pairs of names (hashes c) of the table and of new block rows that share a block and are near enough by their fingerprints.

    Boxes meet each other only, and one of two must be without a name.
    """
    side = lambda df, s: df.select("key", F.col("c").alias(f"c{s}"), F.col("fp").alias(f"fp_{s}"), F.col("box").alias(f"box_{s}"))
    both = side(table.filter("c is not null"), "a").join(side(new, "b").hint("shuffle_hash"), "key")
    near = F.when(F.col("box_b"), F.col("fp_a") + F.col("fp_b") > 0).otherwise(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= most_bits)
    return both.filter(near).select("ca", "cb").distinct()


def verified(pairs: DataFrame, given_names: list[str]) -> DataFrame:
    """(a, a_batch, b) of pairs with box and both names: those that share a box, and those whose names can be one person's."""
    known = frozenset(given_names)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ok = lru_cache(maxsize=100_000)(lambda a, b, c, d: same_name((a, b), (c, d), known))
        for x in batches:
            mask = [sure or ok(*row) for sure, *row in zip(x["box"], x["given_a"], x["family_a"], x["given_b"], x["family_b"], strict=True)]
            yield x.loc[mask, ["a", "a_batch", "b"]].astype({"a_batch": "Int32"})

    return pairs.mapInPandas(keep, "a bigint, a_batch int, b bigint")


def name_links(people: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(a, b): leads with the row that stands for their evidence and name. most: the greatest n of names; two leads of a name need no join."""
    two = names.filter("n > 1 and id <> last_id").select(F.col("id").alias("a"), F.col("last_id").alias("b"))
    if most <= 2:
        return two
    first = names.filter("n > 2").select("c", F.col("id").alias("a"), "n")
    counts = first.select("c", F.col("n").alias("_n"))
    rows = evidence(people).select(F.xxhash64("ev", "given", "family").alias("c"), F.col("id").alias("b"))
    return two.unionByName(lookup_join(rows, first.drop("n"), ["c"], "inner", counts=counts).filter("a <> b").select("a", "b"))


#: A row of the block tables has key, c, fp and box; one of the names has its hash as key, and the rest.
BLOCKS = "key bigint, c bigint, fp bigint, box boolean, id bigint, given string, family string, batch_no int"
LINKED = "id bigint, person bigint, first_batch int, stored boolean"


def _persons_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """persons_of() of all links in one task."""
    frames = list(batches)
    if not frames:
        return
    own = pd.concat(frames, ignore_index=True)
    roots = pd.concat(_finish(iter([own.rename(columns={"a": "u", "b": "v"})])), ignore_index=True)
    first = own[own["a_batch"].notna()].groupby("a")["a_batch"].min()
    roots["first_batch"] = roots["id"].map(first).astype("Int32")
    roots["stored"] = roots["first_batch"].notna()
    least = roots[roots["stored"]].sort_values("id").drop_duplicates("root").set_index("root")
    yield pd.DataFrame({
        "id": roots["id"], "person": roots["root"].map(least["id"]).fillna(roots["root"]).astype("int64") if len(least) else roots["root"],
        "first_batch": roots["root"].map(least["first_batch"]).astype("Int32"), "stored": roots["stored"],
    })


def persons_of(links: DataFrame, n: int, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(id, person, first_batch, stored) of every end of the n links (a, a_batch, b), a_batch being set where a is a stored person.

    person is the smallest stored person of the connected part, with its first_batch, or the smallest id and null if
    there is none. Up to local_links links are finished in one task; both ways give the same.
    """
    if n <= local_links:
        return links.coalesce(1).mapInPandas(_persons_here, LINKED)
    roots = connected_components(links)
    stored = links.filter("a_batch is not null").groupBy(F.col("a").alias("id")).agg(F.min("a_batch").alias("at"))
    marked = materialise(roots.join(stored, "id", "left"), "roots")
    least = marked.filter("at is not null").groupBy("root").agg(F.min(F.struct("id", "at")).alias("m"))
    return lookup_join(marked, least, ["root"], "left").select("id", F.coalesce("m.id", "root").alias("person"), F.col("m.at").alias("first_batch"), F.col("at").isNotNull().alias("stored"))


class DuplicateIndex:
    """The accepted history as a folder that is appended to: see the module's text.

    build() makes it from the first batch, load() opens it again, append() looks up one more batch and adds it, check()
    does so and gives what was found, report() gives what all batches so far have brought.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, given_names: list[str]) -> None:
        self.spark, self.path, self.buckets, self.given_names = spark, path, buckets, given_names
        self.table = f"siftwell_blocks_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.table} ({BLOCKS}) USING parquet CLUSTERED BY (key) INTO {buckets} BUCKETS LOCATION '{path}/blocks'")

    @classmethod
    def build(cls, leads: DataFrame, path: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DuplicateIndex:
        """The index of a first batch, in the folder `path` (by default one beside the session's own steps)."""
        spark = leads.sparkSession
        path = path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex[:12]}"
        given_names = given_name_table(leads)
        people, names, seen = cls._read(leads, given_names)
        index = cls(spark, path, max(LEAST_BUCKETS, -(-3 * seen["rows"] // bucket_rows)), given_names)
        spark.createDataFrame([(json.dumps({"buckets": index.buckets, "given_names": given_names}),)], "value string").coalesce(1).write.text(f"{path}/meta")
        if seen["rows"]:
            index._accept(people, names, seen, leads.agg(F.max("batch_no")).first()[0] or 0)
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DuplicateIndex:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(spark, path, meta["buckets"], meta["given_names"])

    @staticmethod
    def _read(leads: DataFrame, given_names: list[str]) -> tuple[DataFrame, DataFrame, dict]:
        people, some = observed(fingerprinted(leads, given_names), "people", blank=F.count_if(F.expr("family = '' and mailbox <> '' and not role")))
        names, seen = observed(one_per_name(people), "names", most=F.max("n"), rows=F.count(F.lit(1)))
        return people, names, {"most": seen["most"] or 0, "rows": seen["rows"] or 0, "blank": some["blank"] or 0}

    def _links(self, people: DataFrame, names: DataFrame, seen: dict, batch_no: int) -> tuple[DataFrame, int]:
        """The links (a, a_batch, b) of the new names b, already in the table, with each other and with stored persons a; and how many."""
        table = self.spark.table(self.table)
        stored = table.filter("id is not null").select(F.col("key").alias("ca"), F.col("id").alias("id_a"), F.col("given").alias("given_a"), F.col("family").alias("family_a"), F.col("batch_no").alias("at"))
        own = names.select(F.col("c").alias("cb"), F.col("id").alias("b"), (F.col("kind") == "box").alias("box"), F.col("given").alias("given_b"), F.col("family").alias("family_b"))
        pairs = stored.join(met(rotated(names), table).hint("shuffle_hash"), "ca").join(own, "cb").filter((F.col("at") < batch_no) | (F.col("id_a") < F.col("b")))
        links = verified(pairs.select(F.col("id_a").alias("a"), F.when(F.col("at") < batch_no, F.col("at")).alias("a_batch"), "b", "box", "given_a", "family_a", "given_b", "family_b"), self.given_names)
        if (log := self._log()) is not None:
            persons = log.filter((F.col("batch_no") < batch_no) & ~F.col("stored")).select(F.col("id").alias("a"), "person", "first_batch")
            links = links.join(persons, "a", "left").select(F.coalesce("person", "a").alias("a"), F.coalesce("first_batch", "a_batch").alias("a_batch"), "b")
        known = name_links(people, names, seen["most"])
        if seen["blank"]:  # leads without a name are linked to the first with their box
            blank = people.filter("family = '' and mailbox <> '' and not role").select(F.xxhash64(F.lit("box"), F.col("mailbox")).alias("ev"), F.col("id").alias("b"))
            boxes = names.filter("kind = 'box'").select("ev", F.col("id").alias("a"))
            known = known.unionByName((blank.join(boxes, "ev") if seen["blank"] <= HOT_LEAST else lookup_join(blank, boxes, ["ev"], "inner")).filter("a <> b").select("a", "b"))
        links, found = observed(links.unionByName(known.select("a", F.lit(None).cast("int").alias("a_batch"), "b")), "links", n=F.count(F.lit(1)))
        return links, found["n"]

    def _accept(self, people: DataFrame, names: DataFrame, seen: dict, batch_no: int) -> DataFrame:
        """Appends the block tables and names of a batch, links them, and writes the log (LINKED) of the batch, which is returned."""
        blocks = rotated(names).withColumns({"id": F.lit(None).cast("bigint"), "given": F.lit(None).cast("string"), "family": F.lit(None).cast("string"), "batch_no": F.lit(None).cast("int")})
        rows = blocks.unionByName(names.select(F.col("c").alias("key"), F.lit(None).cast("bigint").alias("c"), F.lit(None).cast("bigint").alias("fp"), F.lit(None).cast("boolean").alias("box"), "id", "given", "family", F.lit(batch_no).alias("batch_no")))
        rows.repartition(self.buckets, "key").write.mode("append").format("parquet").bucketBy(self.buckets, "key").option("compression", "zstd").option("path", f"{self.path}/blocks").saveAsTable(self.table)
        links, n = self._links(people, names, seen, batch_no)
        at = f"{self.path}/linked/batch_no={batch_no}"
        persons_of(links, n).withColumn("first_batch", F.coalesce("first_batch", F.lit(batch_no))).write.mode("overwrite").parquet(at)
        for done in (links, names, people):
            release(done)
        return self.spark.read.schema(LINKED).parquet(at)

    def append(self, leads: DataFrame, batch_no: int) -> DataFrame | None:
        """Adds a batch and looks it up. The log rows (LINKED) of its leads and of the stored persons that they were linked to; None for an empty batch."""
        people, names, seen = self._read(leads.withColumn("batch_no", F.lit(batch_no)), self.given_names)
        return self._accept(people, names, seen, batch_no) if seen["rows"] else None

    def check(self, leads: DataFrame, batch_no: int) -> DataFrame:
        """(earlier_id, id) of every lead of the batch whose person is in the index, which then holds the batch too.

        A batch has a higher batch_no than all before, and higher ids. Leads without any evidence, or with neither name nor
        own mailbox, are accepted without a match. Null fields, blank texts and stand-ins are no evidence. Repeated rows give
        one result; other columns of the batch are ignored; an empty batch reads nothing of the index and finds nothing.
        """
        linked = self.append(leads, batch_no)
        if linked is None:
            return self.spark.createDataFrame([], "earlier_id bigint, id bigint")
        return self._earlier(linked.withColumn("batch_no", F.lit(batch_no)))

    def _log(self) -> DataFrame | None:
        if not exists(self.spark, f"{self.path}/linked"):
            return None
        return self.spark.read.schema(f"{LINKED}, batch_no int").parquet(f"{self.path}/linked")

    def _earlier(self, linked: DataFrame) -> DataFrame:
        """(earlier_id, id) of log rows, persons that later batches showed to be one taken together."""
        merged = self._log().filter("stored and id <> person").select("id", "person", "first_batch")
        ends = connected_components(merged, "id", "person").filter("id <> root").select(F.col("id").alias("person"), "root")
        ends = ends.join(merged.groupBy(F.col("person").alias("root")).agg(F.min("first_batch").alias("root_batch")), "root", "left")
        new = lookup_join(linked.filter("not stored").drop("stored"), ends, ["person"], "left")
        first = F.when(F.col("root").isNotNull(), F.col("root_batch")).otherwise(F.col("first_batch"))  # of the history too; it has no lower batch
        return new.filter(first < F.col("batch_no")).select(F.coalesce("root", "person").alias("earlier_id"), "id").distinct()

    def report(self) -> DataFrame:
        """(earlier_id, id) of every lead checked so far whose person has a lead in a lower batch; earlier_id is the smallest id of the person's leads, as all batches together show it."""
        log = self._log()
        return self.spark.createDataFrame([], "earlier_id bigint, id bigint") if log is None else self._earlier(log)


def check_batches(leads: DataFrame, first: int = 1, path: str | None = None) -> DataFrame:
    """(earlier_id, id): the batches of leads by batch_no, those below `first` (and null) as history, the others checked and appended one after another in order; see DuplicateIndex.report."""
    spark = leads.sparkSession
    own = leads.select("id", F.greatest(F.coalesce(F.col("batch_no").cast("int"), F.lit(0)), F.lit(first - 1)).alias("batch_no"), *READ)
    at = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex[:12]}"  # batches come one by one, each is read alone
    own.write.partitionBy("batch_no").option("compression", "zstd").parquet(at)
    numbers = sorted(r[0] for r in own.select("batch_no").distinct().collect())  # one small number a batch
    read = lambda n: spark.read.schema(own.drop("batch_no").schema).parquet(f"{at}/batch_no={n}").withColumn("batch_no", F.lit(n))
    history = read(first - 1) if numbers[:1] == [first - 1] else own.limit(0)
    index = DuplicateIndex.build(history, path)
    for n in numbers:
        if n >= first:
            index.append(read(n), n)
        discard(spark, f"{at}/batch_no={n}")
    return index.report()
