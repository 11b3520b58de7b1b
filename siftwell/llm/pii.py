"""Personal information in free text: a linear-chain conditional random field over word-shape features.

The tagger is trained on the driver from the small labelled table (pii_table) by stochastic gradient on the
conditional likelihood, and decoded by Viterbi over whole batches of distinct notes in numpy. A found
span is then snapped to exact boundaries (no trailing marks, no label, whole mail address).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.pii_table import KINDS, labelled_notes
from siftwell.operators.skew import lookup_join

TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
K = len(TAGS)
BUCKETS = 1 << 16
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    if word.isdigit():
        return f"d{min(len(word), 12)}"
    if word.isalpha():
        if word.islower():
            return "x" if len(word) > 1 else "x1"
        if word.isupper():
            return "X" if len(word) > 1 else "X1"
        return "Xx" if word[0].isupper() and word[1:].islower() else "xX"
    return word


@lru_cache(maxsize=200_000)
def _cell(text: str) -> int:
    return zlib.crc32(text.encode("utf-8")) % (BUCKETS - 1) + 1


@lru_cache(maxsize=200_000)
def _own(word: str) -> tuple[str, str, tuple[int, ...]]:
    low, form = word.lower(), shape(word)
    return low, form, tuple(_cell(f) for f in (f"w {low}", f"s {form}", f"p {low[:3]}", f"e {low[-3:]}", f"e {low[-4:]}", f"n {min(len(low), 12)} {form}"))


def tokens_of(text: str) -> tuple[list[str], list[int], list[int]]:
    words, starts, ends = [], [], []
    for m in TOKEN.finditer(text):
        words.append(m.group())
        starts.append(m.start())
        ends.append(m.end())
    return words, starts, ends


@lru_cache(maxsize=100_000)
def _around(kind: str, a: str, b: str = "") -> int:
    return _cell(f"{kind} {a} {b}")


WIDTH = 28


def windows(text: str) -> tuple[list[tuple], list[int], list[int]]:
    """(windows, starts, ends): per token all that its features depend on: five words, the gaps beside it, where the next @ is."""
    words, starts, ends = tokens_of(text)
    n = len(words)
    if not n:
        return [], starts, ends
    near = ["1", *("0" if starts[i] == ends[i - 1] else "n" if "\n" in text[ends[i - 1] : starts[i]] else "1" for i in range(1, n)), "1"]
    w = ["", "", *words, "", ""]
    at = [i for i, x in enumerate(words) if x == "@"]
    if not at:
        return [(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4], near[i], near[i + 1], "") for i in range(n)], starts, ends
    gap = [min(at, key=lambda x: abs(x - i)) - i for i in range(n)]
    return [(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4], near[i], near[i + 1], str(gap[i]) if abs(gap[i]) <= 8 else "") for i in range(n)], starts, ends


_EDGE = ("^", "^", ())


def row_of(window: tuple) -> list[int]:
    """The cells of one token's word-shape features."""
    ll, l, w, r, rr, g, h, at = window  # noqa: E741
    (a2, s2, _), (a1, s1, _), (a0, s0, own), (b1, t1, _), (b2, t2, _) = (_own(x) if x else _EDGE for x in (ll, l, w, r, rr))
    row = [
        *own,
        _around("-1", a1), _around("+1", b1), _around("-2", a2), _around("+2", b2),
        _around("s-1", s1, g), _around("s+1", t1, h), _around("s-1s", s1, s0 + g), _around("ss+1", s0, t1 + h),
        _around("s-2", s2, s1), _around("s+2", t1, t2), _around("-1s", a1, s0), _around("s+1w", s0, b1),
        _around("-2-1", a2, a1), _around("sss", s1 + g + s0, h + t1), _around("s-2s", s2 + s1, s0), _around("ss+2", s0, t1 + t2),
        _around("g", g, h), _around("gs", g + h, s0),
    ]
    if at:
        row.append(_around("@", at))
    return row + [0] * (WIDTH - len(row))


def features(text: str) -> tuple[np.ndarray, list[int], list[int]]:
    """(cells [tokens, WIDTH], starts, ends) of a text, 0 for no feature."""
    keys, starts, ends = windows(text)
    return np.array([row_of(k) for k in keys], dtype=np.int32).reshape(-1, WIDTH), starts, ends


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def gold_tags(starts: list[int], ends: list[int], spans: list[tuple[int, int, str]]) -> list[int]:
    tags = [0] * len(starts)
    for lo, hi, kind in spans:
        first = True
        for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
            if s >= lo and e <= hi:
                tags[i] = TAGS.index(("B-" if first else "I-") + kind)
                first = False
    return tags


def train(size: int = 8000, epochs: int = 6, batch: int = 48, rate: float = 0.25, l2: float = 1e-6, seed: int = 5, held_out: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(W [BUCKETS, K], T [K + 1, K]) by AdaGrad on the conditional likelihood; T's last row holds the starts.

    size bounds the labelled notes; held_out: see labelled_notes.
    """
    table = labelled_notes(size, seed, held_out)
    data = []
    for text, spans in table:
        x, s, e = features(text)
        if len(s):
            data.append((x, np.array(gold_tags(s, e, spans))))
    rng = np.random.default_rng(seed)
    W, T = np.zeros((BUCKETS, K)), np.zeros((K + 1, K))
    GW, GT = np.full((BUCKETS, K), 1e-6), np.full((K + 1, K), 1e-6)
    order = np.arange(len(data))
    for _ in range(epochs):
        rng.shuffle(order)
        order = order[np.argsort([len(data[i][1]) + rng.integers(8) for i in order], kind="stable")]
        chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
        rng.shuffle(groups := np.arange(len(chunks)))
        for c in groups:
            own = [data[i] for i in chunks[c]]
            n, steps = len(own), max(len(y) for _, y in own)
            X, Y, M = np.zeros((n, steps, WIDTH), np.int32), np.zeros((n, steps), np.int64), np.zeros((n, steps), bool)
            for i, (x, y) in enumerate(own):
                X[i, : len(y)], Y[i, : len(y)], M[i, : len(y)] = x, y, True
            E = W[X].sum(axis=2)
            A, B = np.zeros((n, steps, K)), np.zeros((n, steps, K))
            A[:, 0] = E[:, 0] + T[K]
            for t in range(1, steps):
                new = _lse(A[:, t - 1, :, None] + T[None, :K], 1) + E[:, t]
                A[:, t] = np.where(M[:, t, None], new, A[:, t - 1])
            Z = _lse(A[:, -1], 1)
            for t in range(steps - 2, -1, -1):
                new = _lse(T[None, :K] + (E[:, t + 1] + B[:, t + 1])[:, None, :], 2)
                B[:, t] = np.where(M[:, t + 1, None], new, 0.0)
            P = np.exp(A + B - Z[:, None, None]) * M[:, :, None]
            gold = np.zeros_like(P)
            i, t = np.nonzero(M)
            gold[i, t, Y[i, t]] = 1
            D = (P - gold) / n
            gw = np.zeros((BUCKETS, K))
            flat = X.reshape(-1)
            rows = np.repeat(D.reshape(-1, K), WIDTH, axis=0)
            used = flat > 0
            for k in range(K):
                gw[:, k] = np.bincount(flat[used], rows[used, k], BUCKETS)
            gt = np.zeros((K + 1, K))
            gt[K] = D[:, 0].sum(axis=0)
            for t in range(1, steps):
                live = M[:, t]
                if live.any():
                    pair = np.exp(A[live, t - 1, :, None] + T[None, :K] + (E[live, t] + B[live, t])[:, None, :] - Z[live, None, None])
                    gt[:K] += pair.sum(axis=0) / n
                    np.add.at(gt, (Y[live, t - 1], Y[live, t]), -1.0 / n)
            at = np.flatnonzero(np.abs(gw).sum(axis=1))
            g = gw[at] + l2 * W[at]
            GW[at] += g * g
            W[at] -= rate * g / np.sqrt(GW[at])
            GT += gt * gt
            T -= rate * gt / np.sqrt(GT)
    return W.astype(np.float32), T.astype(np.float32)


@lru_cache(maxsize=2)
def model(size: int = 8000, epochs: int = 6) -> tuple[np.ndarray, np.ndarray]:
    return train(size, epochs)


def viterbi(texts: list[str], W: np.ndarray, T: np.ndarray, batch: int = 256) -> list[list[tuple[int, int, str]]]:
    """The spans of each text, decoded in batches of notes of about the same length."""
    # Notes share most of their five-word windows: each distinct one is scored once per call.
    index: dict[tuple, int] = {}
    found = []
    for t in texts:
        keys, starts, ends = windows(t)
        found.append((np.array([index.setdefault(k, len(index)) for k in keys], dtype=np.int32), starts, ends))
    scores = np.zeros((len(index) + 1, K), np.float32)
    rows: list[list[int]] = []
    done = 0
    for i, key in enumerate(index, 1):
        rows.append(row_of(key))
        if len(rows) == 4096 or i == len(index):
            cells = np.array(rows, dtype=np.int32)
            for j in range(WIDTH):
                scores[done : done + len(rows)] += W[cells[:, j]]
            done += len(rows)
            rows = []
    order = sorted(range(len(texts)), key=lambda i: len(found[i][1]))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    at = 0
    while at < len(order):
        longest = max(1, len(found[order[min(len(order) - 1, at + batch - 1)]][1]))
        take = max(1, min(batch, 60_000 // longest))  # a very long text is decoded on its own
        own = order[at : at + take]
        at += take
        own = [i for i in own if found[i][1]]
        if not own:
            continue
        n, steps = len(own), max(len(found[i][1]) for i in own)
        sizes = np.array([len(found[i][1]) for i in own])
        X = np.full((n, steps), len(index), np.int32)
        for r, i in enumerate(own):
            X[r, : sizes[r]] = found[i][0]
        E = scores[X]
        score, back = E[:, 0] + T[K], np.zeros((n, steps, K), np.int8)
        ends = np.zeros((n, K), np.float32)
        ends[sizes == 1] = score[sizes == 1]
        for t in range(1, steps):
            both = score[:, :, None] + T[None, :K]
            back[:, t] = both.argmax(axis=1)
            score = both.max(axis=1) + E[:, t]
            ends[sizes == t + 1] = score[sizes == t + 1]
        last = ends.argmax(axis=1)
        for r, i in enumerate(own):
            tag, tags = int(last[r]), [0] * int(sizes[r])
            for t in range(int(sizes[r]) - 1, -1, -1):
                tags[t] = tag
                tag = int(back[r, t, tag])
            if any(tags):
                out[i] = _spans(tags, found[i][1], found[i][2])
    return out


def _spans(tags: list[int], starts: list[int], ends: list[int]) -> list[tuple[int, int, str]]:
    spans: list[tuple[int, int, str]] = []
    kind, lo, hi = "", 0, 0
    for tag, s, e in zip(tags, starts, ends, strict=True):
        name = TAGS[tag]
        if name[0] == "I" and name[2:] == kind:
            hi = e
            continue
        if kind:
            spans.append((lo, hi, kind))
        kind, lo, hi = (name[2:], s, e) if tag else ("", 0, 0)
    if kind:
        spans.append((lo, hi, kind))
    return spans


# How a mail address can be written.
_AT = r"(?:\s?@\s?|\s?[(\[]at[)\]]\s?|\sat\s)"
_DOT = r"(?:\.|\[dot\]|\sdot\s)"
MAIL = re.compile(rf"(?i)[a-z0-9](?:[\w.+-]*[a-z0-9])?{_AT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:{_DOT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+")
_TITLE = re.compile(r"(?i)^(?:(?:dr|prof|mr|mrs|ms|mme|mlle|herr|frau|sr|sra)\.?\s+)+")


def snap(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Exact boundaries; spans that cannot be of their kind are dropped."""
    mails = [m.span() for m in MAIL.finditer(text)] if any(k == "EMAIL" for _, _, k in spans) else []
    out = []
    for lo, hi, kind in spans:
        if kind == "EMAIL":
            hit = next(((a, b) for a, b in mails if a < hi and lo < b), None)
            if hit is None:
                continue
            lo, hi = hit
        elif kind == "PHONE":
            m = re.search(r"[+(\d].*\d", text[lo:hi], re.S)
            if not m or not 6 <= sum(c.isdigit() for c in m.group()) <= 16:
                continue
            lo, hi = lo + m.start(), lo + m.end()
        else:
            if kind == "NAME" and (m := _TITLE.match(text[lo:hi])):
                lo += m.end()
            while hi > lo and not (text[hi - 1].isalnum() or (kind == "NAME" and text[hi - 1] == "." and hi - lo > 3 and text[hi - 2].isupper() and not text[hi - 3].isalnum())):
                hi -= 1
            while lo < hi and not text[lo].isalnum():
                lo += 1
            value = text[lo:hi]
            digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
            if kind == "ID_NUMBER" and digits < 5 or kind == "ADDRESS" and (not digits or letters < 4) or kind == "NAME" and (digits or letters < 3 or not re.search(r"\W", value)):
                continue
        out.append((lo, hi, kind))
    return sorted(set(out))


def find_in(texts: list[str], W: np.ndarray, T: np.ndarray) -> list[list[tuple[int, int, str]]]:
    return [snap(t, s) if s else [] for t, s in zip(texts, viterbi(texts, W, T), strict=True)]


#: A text is known by two hashes of 64 bits wherever rows meet what was found in it, so that whole texts are no join keys.
MARK = ["_h1", "_h2"]


def _marked(df: DataFrame, text: str, *columns: Column) -> DataFrame:
    """(_h1, _h2, text, *columns) of the rows of df; the marks of a null text are null."""
    own = F.col(text).cast("string")
    return df.select(*columns, F.when(own.isNotNull(), F.xxhash64(own)).alias("_h1"), F.when(own.isNotNull(), F.xxhash64(F.lit(1), own)).alias("_h2"), own.alias("text"))


def _distinct(df: DataFrame, text: str) -> DataFrame:
    return _marked(df, text).filter("text is not null and trim(text) <> ''").groupBy(*MARK).agg(F.first("text").alias("text"))


def find_spans(df: DataFrame, key: str = "id", text: str = "notes") -> DataFrame:
    """One row (key, kind, value) per distinct piece of personal information in a row's text, exactly as written there.

    Each distinct text is decoded once. Null, empty and blank texts give no row; texts are read
    whole, whatever their length; repeated rows give their pieces once; other columns are ignored.
    """
    W, T = model()

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = find_in(list(b["text"]), W, T)
            keep = [i for i, f in enumerate(found) if f]
            yield b[MARK].iloc[keep].assign(kinds=[[k for _, _, k in found[i]] for i in keep], vals=[[b["text"].iloc[i][lo:hi] for lo, hi, _ in found[i]] for i in keep])

    pieces = _distinct(df, text).mapInPandas(tag, "_h1 bigint, _h2 bigint, kinds array<string>, vals array<string>")
    rows = _marked(df, text, F.col(key).alias("_key")).filter("text is not null").drop("text")
    joined = lookup_join(rows, pieces, MARK, "inner")
    return joined.select(F.col("_key").alias(key), F.explode(F.arrays_zip("kinds", "vals")).alias("x")).select(key, F.col("x.kinds").alias("kind"), F.col("x.vals").alias("value")).distinct()


def redact(df: DataFrame, key: str = "id", text: str = "notes") -> DataFrame:
    """One row (key, text) per row of df, with each piece of personal information replaced by [KIND] and all else unchanged.

    Null stays null; see find_spans for the other cases. Repeated rows are all kept.
    """
    W, T = model()

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, done = list(b["text"]), []
            for t, spans in zip(texts, find_in(texts, W, T), strict=True):
                for lo, hi, kind in reversed(spans):
                    t = f"{t[:lo]}[{kind}]{t[hi:]}"
                done.append(t)
            changed = [i for i, (t, d) in enumerate(zip(texts, done, strict=True)) if t != d]
            yield b[MARK].iloc[changed].assign(clean=[done[i] for i in changed])

    table = _distinct(df, text).mapInPandas(clean, "_h1 bigint, _h2 bigint, clean string")
    rows = _marked(df, text, F.col(key).alias("_key"))
    return lookup_join(rows, table, MARK, "left").select(F.col("_key").alias(key), F.coalesce("clean", "text").alias(text))
