"""Template residue, filler, error pages and script notices, by positive-unlabelled naive Bayes with EM.

Texts are cut into passages (lines and sentences). Trusted passages come from records that an
anchored pattern identifies beyond doubt: an error status at the start of a line, a salutation
with an unfilled slot, the classic filler. Everything else is unlabelled. Naive Bayes over words,
word pairs and slot marks starts with the unlabelled passages as content and is refined by
expectation-maximisation, so that the other wordings of the trusted kinds are learned from
the corpus itself, and so are the sentences that only talk about such things. Passage scores are then
aggregated: one unfilled slot condemns a record; filler, errors and notices do where they make up the body.

What is quoted is only talked about: its words are one mark. A sentence that occurs with different slots is a template, one
that always shows the same slot may talk about it; so that is a feature too, which the trusted salutations teach.

EM works on distinct passages with their numbers of occurrences; a round sends at most one row
per task and feature cell to a partial aggregation, and at most CELLS sums to the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.skew import lookup_join
from siftwell.session import materialise

CELLS = 1 << 18

#: What a slot for a value looks like when nobody filled it, whatever the template language.
_NAME = r"\s*[^\W\d][\w .']{0,40}?\s*"
#: Round brackets are common in content, so only names of fields make them a slot.
_FIELD = r"(?i:(?:first|last|full)?name|nombre|nom|prénom|vorname|nachname|company|firma|empresa|date|datum|fecha|product|title|amount)"
SLOT = re.compile(
    rf"\{{\{{{_NAME}\}}\}}|\$\{{{_NAME}\}}|\{{!{_NAME}\}}|\{{{_NAME}\}}|\[\[{_NAME}\]\]|\[{_NAME}\]|<<{_NAME}>>|<%=?{_NAME}%>|<[^\W\d][\w .']{{0,40}}?(?<! )>"
    rf"|\((?:[^\W\d]+[ _.])?{_FIELD}\)|\*\|{_NAME}\|\*|%[^\W\d][\w.]*(?: [\w.]+){{0,3}}%|##{_NAME}##|@@{_NAME}@@|\b__[^\W_][\w .]{{0,40}}?__(?!\w)|(?<![\w])_{{5,}}(?![\w])|\b(?:undefined|null|NaN|None)\b|\bX{{4,}}\b|\bTB[CD]\b(?:-\w+)*|\b(?:FIRST|LAST|FULL|COMPANY)_?NAME\b"
)
_SLOT_KIND = {"{": "brace", "$": "dollar", "[": "bracket", "<": "angle", "%": "percent", "#": "hash", "@": "at", "_": "bar", "*": "star", "(": "round"}
_WORD = re.compile(r"\x00\w+|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+")
_HOME_ROW = re.compile(r"^(?:[asdfghjkl]{4,}|(?:asdf?|sdf|dfg|fgh|ghj|hjk|jkl|qwer?|zxcv?|xcv|cvb|vbn|bnm)+)$")
_STATUS = re.compile(r"^[45][0-9]{2}$")
_QUOTED = re.compile(r"(?<![\w{:,\[])[\"“„«]([^\"“”„«»\n]{2,60})[\"”“»](?!\s*[:}\]])")

# Trusted beginnings of error messages, script notices and filler, and salutations before an unfilled slot.
TRUSTED_BODY = (
    r"(?i)^(?:\W*(?:error|erreur|fehler|status)\s+[45]\d\d\b|[45]\d\d\s+(?:forbidden|not found|internal|bad gateway|service unavailable|gateway)"
    r"|(?:internal server error|service unavailable|bad gateway|gateway timeout)\s*\(\d+\)|traceback \(most recent|fatal error: uncaught|\{\"error\":"
    r"|access denied\.|service temporarily unavailable|(?:please |you must )?(?:turn on|enable|activate|allow)\s+(?:javascript|scripts)\b|bitte aktivieren sie javascript|activez javascript|noscript\b"
    r"|(?:ohne|without|sans|sin) (?:javascript|scripts)\b|veuillez autoriser les scripts|permita los scripts|para ver este contenido active|javascript (?:is required|est nécessaire|ist in ihrem browser|ist erforderlich)|es necesario javascript|your browser (?:is too old|blocks)|this (?:site|page|app) (?:needs|requires) (?:javascript|scripts)|.{1,40} cannot be shown because scripts are off"
    r"|lorem ipsum\b|this is dummy text|dies ist ein blindtext|texto de relleno|aquí va el texto|escriba aquí su texto|faux texte|ceci est un texte|placeholder copy|click to add|text to be supplied|subheading goes here|describe your (?:service|product) in|titre de la section|überschrift eingeben|more text, more text|blah blah|(?:xx+ ){2}|(?:[a-z]+ )?(?:[asdfghjkl]{4,} ){3}|(?:(?:asdf?|sdf|dfg|fgh|ghj|hjk|jkl|qwer?|zxcv?|xcv|cvb|vbn|bnm)+ ){3})"
    r"|^[^.!?()]{1,60} \((?:(?:error|erreur|fehler|status|http|código) )?[45]\d\d\)\W*$"
)
#: The words of the classic filler and its usual continuations, without those that are words of other languages too.
FILLER_WORDS = (
    "lorem ipsum dolor amet consectetur consectetuer adipisci adipiscing elit eiusmod tempor incididunt labore dolore magna "
    "aliqua aliquam aliquip aliquet minim veniam nostrud exercitation ullamco laboris commodo consequat duis aute irure "
    "reprehenderit voluptate velit cillum fugiat nulla nullam pariatur excepteur sint occaecat cupidatat proident officia "
    "deserunt mollit laborum lectus semper vitae mattis ornare purus cursus quam augue porta pretium sagitis sagittis fermen "
    "fermentum pellentesque vestibulum mauris curabitur vivamus phasellus praesent donec aenean suspendisse tincidunt "
    "vulputate faucibus sollicitudin ultrices ultricies viverra tristique turpis egestas habitant morbi senectus netus fames "
    "maecenas hendrerit bibendum gravida euismod dapibus rhoncus scelerisque venenatis lobortis malesuada blandit volutpat "
    "eleifend dignissim accumsan sodales luctus molestie feugiat facilisi facilisis convallis pulvinar posuere cubilia "
    "imperdiet iaculis laoreet nunc fusce etiam quisque cras sed nibh nisi nisl justo orci ligula sapien tellus urna metus "
    "felis neque odio arcu enim massa mollis rutrum vehicula condimentum ullamcorper interdum varius porttitor"
).split()
TRUSTED_SLOT = (
    r"(?i)^(?:hi|hello|dear|hallo|hola|bonjour|guten tag|estimad[ao]|welcome back)[ ,]+(?:\{\{?!?|\$\{|\*\||\[\[?|<<|<%=?|%|##|@@|__|null\b|none\b|undefined\b)"
)
FURNITURE = r"^(?:©.*|[^|\n]{1,40}(?:\s\|\s[^|\n]{1,40}){2,}|sent from my .{1,30}|[a-z]{2,20}/\d+(?:\.\d+)+|_{3,}|-{2,})$"


def features(text: str) -> tuple[list[int], bool]:
    """(cells, has a slot) of a passage: words, neighbouring pairs and slot marks, hashed."""
    slots: list[str] = []

    def mark(m: re.Match) -> str:
        found = m.group()
        slots.append(_SLOT_KIND.get(found[0], re.sub(r"\W", "", found.lower())))
        return f" \x00{slots[-1]} "

    marked = _QUOTED.sub(lambda m: m.group() if "\x00" in m.group() else " \x00quoted ", SLOT.sub(mark, text))
    words = []
    for w in _WORD.findall(marked):
        if w[0] == "\x00":
            words.append(w if w == "\x00quoted" else "\x00slot")
        elif w[0].isdigit():
            words.append("\x00status" if _STATUS.match(w) else "0" * len(w))
        else:
            low = w.lower()
            words.append("\x00keys" if _HOME_ROW.match(low) else "\x00run" if len(low) > 2 and len(set(low)) == 1 else low)
    names = {*words, *(f"\x00kind {s}" for s in slots), *(f"{a} {b}" for a, b in zip(["^", *words], [*words, "$"], strict=True))}
    return [zlib.crc32(n.encode("utf-8")) % CELLS for n in names], bool(slots)


VARIED = zlib.crc32(b"\x00varied") % CELLS


def slot_frame(text: str) -> tuple[str, str]:
    """(the passage without its slots and numbers, its slots), in lower case."""
    return re.sub(r"\d+", "0", SLOT.sub("\x00", text)).lower(), "\n".join(SLOT.findall(text)).lower()


def with_variety(rows: DataFrame) -> DataFrame:
    """rows (passage, n, trusted, start, cells, has_slot, frame, slots), the cell VARIED added where other rows have the same frame with other slots."""
    frames = rows.filter("has_slot").groupBy("frame").agg(F.min("slots").alias("_low"), F.max("slots").alias("_high")).filter("_low <> _high").select("frame", F.lit(True).alias("_varied"))
    marked = lookup_join(rows.filter("has_slot"), frames, ["frame"], "left")
    marked = marked.withColumn("cells", F.when(F.col("_varied"), F.concat("cells", F.array(F.lit(VARIED)))).otherwise(F.col("cells")))
    columns = ["passage", "n", "trusted", "start", "cells", "has_slot"]
    return rows.filter("not has_slot").select(columns).unionByName(materialise(marked.select(columns), "slots"))


def passages_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, passage) of every passage with a letter, digit or mark; furniture is flagged, not dropped."""
    lines = F.split(F.col(text), r"(?U)(?<=[.!?])\s+|[\n\r\x{2028}\x{2029}]+")
    return docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.explode(lines).alias("p")).select("_key", F.regexp_replace("p", r"(?U)^[\s•*\-]+|\s+$", "").alias("passage")).filter("passage <> ''").withColumn("furniture", F.rlike("passage", F.lit(f"(?i){FURNITURE}")))


def _sums(rows: DataFrame, log_odds: np.ndarray | None, prior: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One E step and the counts for the M step: per cell the expected occurrences in residue and in all."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, every = np.zeros(CELLS + 1), np.zeros(CELLS + 1)
        for b in batches:
            if b.empty:
                continue
            sizes = b["cells"].map(len).to_numpy()
            flat = np.concatenate(b["cells"].to_numpy()).astype(np.int64)
            owner = np.repeat(np.arange(len(b)), sizes)
            n, label = b["n"].to_numpy(float), b["trusted"].to_numpy(bool)
            p = b["start"].to_numpy(float)
            if log_odds is not None:
                z = np.bincount(owner, log_odds[flat], len(b)) + prior
                p = np.where(label, 1.0, 1 / (1 + np.exp(-np.clip(z, -40, 40))))
            pos += np.append(np.bincount(flat, (p * n)[owner], CELLS), (p * n).sum())
            every += np.append(np.bincount(flat, n[owner], CELLS), n.sum())
        at = np.flatnonzero(every)
        yield pd.DataFrame({"cell": at, "pos": pos[at], "every": every[at]})

    got = rows.mapInPandas(count, "cell bigint, pos double, every double").groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("every").alias("every")).toPandas()
    pos, every = np.zeros(CELLS + 1), np.zeros(CELLS + 1)
    pos[got["cell"]], every[got["cell"]] = got["pos"], got["every"]
    return pos[:-1], every[:-1], pos[-1], every[-1]


def learn(rows: DataFrame, rounds: int = 5, smooth: float = 0.35) -> tuple[np.ndarray, float]:
    """(log odds per cell, prior log odds) from distinct passages (cells, n, trusted, start) by EM. All zero without trusted passages.

    start: what part of a passage's occurrences counts as residue in the first round; trusted ones count as a whole in all.

    Both classes are smoothed with the corpus distribution, by `smooth` of the residue's size: what
    was never seen in residue speaks against it, by the same factor however rare it is.
    """
    log_odds, prior = None, 0.0
    for _ in range(rounds + 1):
        pos, every, n_pos, n = _sums(rows, log_odds, prior)
        if not n_pos:
            return np.zeros(CELLS), -10.0
        neg = np.maximum(every - pos, 0)
        weight, whole = smooth * pos.sum(), every / every.sum()
        seen = every > 0
        log_odds = np.zeros(CELLS)
        log_odds[seen] = np.log((pos + weight * whole)[seen] / (pos.sum() + weight)) - np.log((neg + weight * whole)[seen] / (neg.sum() + weight))
        prior = float(np.log((n_pos + 1) / (n - n_pos + 1)))
    return log_odds, prior


def score_records(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 5, share: float = 0.5, trusted_share: float = 0.25) -> DataFrame:
    """One row (key, residue, slot_score, body_share) per record with a text that is not blank.

    residue: a passage with a slot scores as residue, or at least `share` of the body's characters (page furniture
    aside) are in passages that do. trusted_share: the part of a record's body that must be in passages of the trusted
    patterns for the record's other passages to be learned from as residue. Null, empty and blank texts give no row. Texts of any length
    are read whole; repeated rows of one key are judged together; other columns are ignored. A corpus without any
    trusted passage, or an empty one, has no residue.
    """
    found = passages_of(docs, key, text)
    words = F.split(F.lower("passage"), r"\s+")
    filler = F.size(F.filter(words, lambda w: F.rtrim(w, F.lit(".,;:!?")).isin(FILLER_WORDS)))
    latin = (filler >= 4) & (filler * 2 > F.size(words))
    strong = (F.rlike("passage", F.lit(TRUSTED_BODY)) | latin) & ~F.col("furniture")
    slot = F.rlike("passage", F.lit(TRUSTED_SLOT))
    every = materialise(found.withColumn("strong", strong).withColumn("slot", slot), "passages")
    # The passages of a trusted record count as residue as a whole.
    size = F.length("passage")
    told = F.sum(F.when(F.col("strong"), size).otherwise(0)) / F.sum(F.when(~F.col("furniture"), size).otherwise(0))
    sure = every.groupBy("_key").agg(told.alias("told")).filter(F.col("told") >= trusted_share).select("_key")
    whole = every.join(sure.withColumn("_sure", F.lit(True)), "_key", "left")
    body = F.coalesce("_sure", F.lit(False)) & ~F.col("furniture") & (F.size(F.split("passage", " ")) > 2)
    distinct = whole.groupBy("passage").agg(F.count(F.lit(1)).alias("n"), F.max(body.cast("int")).alias("_b"), F.sum(body.cast("int")).alias("_nb"), F.max("slot").alias("slot"), F.max("strong").alias("strong"), F.max("furniture").alias("furniture"))
    # A passage of trusted records counts as trusted only if most of its occurrences are in such records.
    distinct = distinct.withColumn("trusted", F.col("slot") | F.col("strong") | (F.col("_nb") * 2 > F.col("n")))
    distinct = distinct.withColumn("start", F.when(F.col("trusted"), 1.0).otherwise(F.col("_nb") / F.col("n")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [features(p) for p in b["passage"]]
            frames = [slot_frame(p) if g[1] else (None, None) for p, g in zip(b["passage"], got, strict=True)]
            yield b.assign(cells=[g[0] for g in got], has_slot=[g[1] for g in got], frame=[f for f, _ in frames], slots=[f for _, f in frames])

    rows = materialise(distinct.filter("not furniture").select("passage", "n", "trusted", "start").mapInPandas(read, "passage string, n bigint, trusted boolean, start double, cells array<int>, has_slot boolean, frame string, slots string"), "cells")
    rows = with_variety(rows)
    log_odds, prior = learn(rows, rounds)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = [float(log_odds[np.asarray(c, dtype=np.int64)].sum()) + prior for c in b["cells"]]
            yield pd.DataFrame({"passage": b["passage"], "z": z, "has_slot": b["has_slot"]})

    scores = rows.select("passage", "cells", "has_slot").mapInPandas(score, "passage string, z double, has_slot boolean")
    judged = lookup_join(every.filter("not furniture").select("_key", "passage"), scores, ["passage"], "inner")
    size = F.length("passage")
    return judged.groupBy("_key").agg(
        F.max(F.when(F.col("has_slot"), F.col("z"))).alias("slot_score"),
        (F.sum(F.when(F.col("z") > 0, size).otherwise(0)) / F.sum(size)).alias("body_share"),
    ).select(F.col("_key").alias(key), (F.coalesce(F.col("slot_score") > 0, F.lit(False)) | (F.col("body_share") >= share)).alias("residue"), "slot_score", "body_share")
