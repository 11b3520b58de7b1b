"""Variant spellings of persons and firms: weighted character n-grams, a sparse cosine join, average linkage.

Names become vectors of character trigrams weighted by inverse document frequency. Two vectors
with a cosine of at least t must share one of the rare trigrams at the head of each, in one
global order, until what is left has a norm below t; the join is on those alone and loses no pair. Every link comes
from this join, those of equal vectors (cosine 1) too. An exact check may refuse a pair; word lists only shape the
vectors and refuse, they link nothing. What remains is grouped by average linkage over all pairs of two clusters, where a
pair that the join did not give, or that was refused, counts 0.

Persons are compared within a piece of evidence (a mailbox, a phone line, a firm). The rows of a piece with at
most `most` rows are joined and clustered by the task that reads them; those of larger ones are joined by
trigram and clustered in rounds, so no group is gathered. Both ways give the same clusters.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.names import edits
from siftwell.llm.grouping import group_links
from siftwell.llm.people import PROVIDERS, domain_core, evidence, firm_core, full_form, given_name_table, identities, same_name
from siftwell.operators.components import connected_components
from siftwell.operators.skew import lookup_join
from siftwell.session import materialise, observed, release

#: Trigrams are hashed into so many cells: the table of weights has at most this many rows.
CELLS = 1 << 16
#: Rows of one piece of evidence, or pairs of one part, that a task works on at once; larger ones are spread over tasks.
MOST_ROWS, MOST_PAIRS = 1_000, 20_000
#: Pairs that one task clusters as a whole.
MOST_EDGES = 100_000


@lru_cache(maxsize=200_000)
def _cell(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8")) % CELLS


@lru_cache(maxsize=200_000)
def _word_cells(word: str) -> tuple[int, ...]:
    padded = f" {word} "
    return tuple(_cell(padded[i : i + 3]) for i in range(max(1, len(padded) - 2)))


def trigrams(text: str) -> set[int]:
    """The distinct hashed trigrams of the words of text, with one blank around each."""
    return {c for word in text.split(" ") for c in _word_cells(word)}


def gram_weights(texts: DataFrame, *columns: str, text: Callable[..., str] = str) -> np.ndarray:
    """The weight of each cell: 1 + ln((n + 1) / (df + 1)), over text(*columns) of all rows; the counts are at most CELLS + 1 rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = np.zeros(CELLS, np.int64), 0
        for b in batches:
            cells = [c for t in map(text, *(b[c] for c in columns)) for c in trigrams(t)]
            seen += np.bincount(np.array(cells, dtype=np.int64), minlength=CELLS)
            rows += len(b)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"g": [-1, *at], "n": [rows, *seen[at]]})

    found = texts.select(*columns).mapInPandas(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(CELLS)
    df[found["g"][found["g"] >= 0]] = found["n"][found["g"] >= 0]
    return 1 + np.log((found["n"][found["g"] < 0].sum() + 1.0) / (df + 1.0))


class Vectors:
    """Trigram vectors under the weights: the head of a text's vector for a threshold, and the cosine of two texts."""

    def __init__(self, weights: np.ndarray, threshold: float) -> None:
        self.square, self.threshold = (weights * weights).tolist(), threshold
        self.vector = lru_cache(maxsize=100_000)(self._vector)
        self.head = lru_cache(maxsize=100_000)(self._head)

    def _vector(self, text: str) -> tuple[set[int], float]:
        cells = trigrams(text)
        return cells, math.sqrt(sum(map(self.square.__getitem__, cells)))

    def _head(self, text: str) -> tuple[list[int], list[float]]:
        """The cells of the head, the rarest first, and what part of the squared norm each and all after it hold."""
        square = self.square
        cells = sorted(trigrams(text), key=lambda c: (-square[c], c))
        whole = rest = sum(square[c] for c in cells)
        kept, left = [], []
        for c in cells:
            if rest < self.threshold * self.threshold * whole * (1 - 1e-9):
                break
            kept.append(c)
            left.append(rest / whole)
            rest -= square[c]
        return kept, left

    def cosine(self, a: str, b: str) -> float:
        (x, nx), (y, ny) = self.vector(a), self.vector(b)
        return sum(map(self.square.__getitem__, x & y)) / (nx * ny)


def heads(rows: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """(key, n, left) for rows (w, n, t): one row per trigram in the head of t's vector, its key hashed with w; left: see Vectors."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = Vectors(weights, threshold).head
        for b in batches:
            own = [head(t) for t in b["t"]]
            sizes = [len(o) for o, _ in own]
            cells = np.array([c for o, _ in own for c in o], dtype=np.uint64)
            within = np.repeat(b["w"].to_numpy(np.int64).view(np.uint64), sizes)
            key = (within ^ (cells + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
            yield pd.DataFrame({"key": key.view(np.int64), "n": np.repeat(b["n"].to_numpy(), sizes), "left": np.array([x for _, o in own for x in o], dtype=np.float32)})

    return rows.select("w", "n", "t").mapInPandas(cut, "key bigint, n bigint, left float")


def cosine_pairs(rows: DataFrame, weights: np.ndarray, threshold: float, left: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (a, b, text_a, text_b, note_a, note_b), a < b, of nodes n of rows (w, n, t, note) that share a head trigram and w; n is unique.

    Only hashed keys and nodes are shuffled for the join; the texts are fetched for the pairs found. left: the rows of
    which one must be in each pair; all by default. From the first trigram on that two vectors share, in the global order,
    their product is at most that of what is left of both, so a pair is made only where that can reach the threshold.
    """
    table = materialise(heads(rows, weights, threshold), "heads")
    own = table if left is None else heads(left, weights, threshold)
    pairs = own.select("key", F.col("n").alias("a"), F.col("left").alias("_l")).join(table.select("key", F.col("n").alias("b"), F.col("left").alias("_r")), "key").filter("a < b" if left is None else "a <> b")
    pairs = pairs.filter(F.col("_l") * F.col("_r") >= threshold * threshold * (1 - 1e-5))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda s: rows.select(F.col("n").alias(s), F.col("t").alias(f"text_{s}"), F.col("note").alias(f"note_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


#: What an exact check says of a pair with cosine v. True: it counts (1 + v) / 2. False: 0. None, where both can misspell a third: v, but at most OPEN.
Verdict = Callable[[str, str], bool | None]
#: Less than the thresholds of linkage, so that an open pair never links by itself.
OPEN = 0.49


def _similarity(v: float, verdict: bool | None) -> float:
    return (1 + v) / 2 if verdict else min(v, OPEN) if verdict is None else 0.0


def judged(pairs: DataFrame, weights: np.ndarray, accept: Verdict, threshold: float) -> DataFrame:
    """(a, b, sim) of pairs whose cosine reaches the threshold and whose notes accept() doesn't refuse; see Verdict."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cosine = Vectors(weights, threshold).cosine
        for x in batches:
            sims = []
            for s, t, a, b in zip(x["text_a"], x["text_b"], x["note_a"], x["note_b"], strict=True):
                v = cosine(s, t)
                sims.append(_similarity(v, accept(a, b)) if v >= threshold else 0.0)
            out = x[["a", "b"]].assign(sim=sims)
            yield out[out["sim"] > 0]

    return pairs.mapInPandas(score, "a bigint, b bigint, sim double")


def linkage(sims: dict[tuple[int, int], float], threshold: float) -> dict[int, int]:
    """{node: cluster} of the nodes of sims by average linkage, one merge at a time; cluster is the smallest node, absent pairs count 0.

    The pair of clusters with the greatest average (rounded to nine places; ties: the smallest clusters) merges until none reaches the threshold.
    """
    near: dict[int, dict[int, float]] = {}
    for (a, b), s in sims.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = s
    size = dict.fromkeys(near, 1)
    own: dict[int, list[int]] = {n: [n] for n in near}
    entry = lambda a, b: (-round(near[a][b] / (size[a] * size[b]), 9), min(a, b), max(a, b), size[a] + size[b])
    heap = [entry(a, b) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap:
        v, a, b, n = heapq.heappop(heap)
        if -v < threshold:
            break
        if a not in near or b not in near or size[a] + size[b] != n or entry(a, b)[0] != v:
            continue  # one of the two has merged since
        size[a] += size[b]
        own[a] += own.pop(b)
        del near[a][b]
        for c, s in near.pop(b).items():
            if c != a:
                del near[c][b]
                near[a][c] = near[c][a] = near[a].get(c, 0.0) + s
        for c in near[a]:
            heapq.heappush(heap, entry(a, c))
    return {n: c for c, nodes in own.items() if c in near for n in nodes}


def average_linkage(edges: DataFrame, threshold: float, max_rounds: int = 200) -> DataFrame:
    """(node, cluster) of every node of edges (a, b, sim), each pair once; cluster is the smallest node. As linkage(), in rounds.

    Each round every cluster picks its neighbour with the greatest average similarity (ties: the smallest), and pairs
    that picked each other merge if the average reaches the threshold. With absent pairs as 0 a merge never brings a third
    cluster nearer than the nearer of its parts was, so the rounds give the tree of single merges, ties aside.
    """
    start = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("sim").alias("s")).filter("a <> b").withColumns({"na": F.lit(1).cast("bigint"), "nb": F.lit(1).cast("bigint")}), "edges")
    live, merges = start, None
    for _ in range(max_rounds):
        avg = F.round(F.col("s") / (F.col("na") * F.col("nb")), 9)
        both = live.select(F.col("a").alias("x"), F.col("b").alias("y"), avg.alias("v"), (F.col("na") + F.col("nb")).alias("n")).filter(F.col("v") >= threshold)
        both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"), "v", "n"))
        # One global order of the edges (value, then the two ends) makes reciprocal choices certain to exist.
        best = both.groupBy("x").agg(F.max(F.struct("v", (-F.least("x", "y")).alias("p"), (-F.greatest("x", "y")).alias("q"), "y", "n")).alias("m")).select("x", F.col("m.y").alias("y"), F.col("m.n").alias("n"))
        mutual = best.join(best.select(F.col("x").alias("y"), F.col("y").alias("_x")), "y").filter((F.col("_x") == F.col("x")) & (F.col("x") < F.col("y")))
        pairs, found = observed(mutual.select(F.col("y").alias("old"), F.col("x").alias("new"), "n"), "merges", n=F.count(F.lit(1)))
        if not found["n"]:
            break
        merges = pairs if merges is None else merges.unionByName(pairs)
        moves = pairs.select(F.explode(F.array(F.col("old"), F.col("new"))).alias("k"), F.col("new").alias("to"), "n")
        step = live
        for end in ("a", "b"):
            step = step.join(moves.select(F.col("k").alias(end), F.col("to").alias("_to"), F.col("n").alias("_n")), end, "left").withColumns({end: F.coalesce("_to", end), f"n{end}": F.coalesce("_n", f"n{end}")}).drop("_to", "_n")
        turned = F.col("a") > F.col("b")
        step = step.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        after = materialise(step.groupBy("a", "b").agg(F.sum("s").alias("s"), F.first("na").alias("na"), F.first("nb").alias("nb")), "edges")
        if live is not start:
            release(live)
        live = after
    else:
        raise RuntimeError(f"clusters still merge after {max_rounds} rounds")
    nodes = start.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if merges is None:
        return nodes.select("node", F.col("node").alias("cluster"))
    # The merges form trees whose roots are the clusters.
    roots = group_links(merges, a="old", b="new", group="cluster", member="node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))


def cluster_edges(edges: DataFrame, threshold: float, most: int = MOST_PAIRS, here: int = MOST_EDGES) -> DataFrame:
    """(node, cluster) of every node of edges (a, b, sim), each pair once, by average linkage with absent pairs as 0.

    Up to `here` edges are clustered by one task. Of more, clusters lie within connected parts: a part whose pairs are all
    there, and all reach the threshold, is one cluster; others of up to `most` pairs are clustered by the task that
    holds them, larger ones in rounds. All ways give the same.
    """
    edges, seen = observed(edges, "edges", n=F.count(F.lit(1)))
    if seen["n"] <= here:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = linkage({(a, b): s for x in batches for a, b, s in zip(x["a"], x["b"], x["sim"], strict=True)}, threshold)
            yield pd.DataFrame({"node": list(got), "cluster": list(got.values())}, dtype="int64")

        return materialise(edges.coalesce(1).mapInPandas(whole, "node bigint, cluster bigint"), "clusters")
    parts = materialise(connected_components(edges).select(F.col("id").alias("node"), F.col("root").alias("part")), "parts")
    inside = edges.join(parts.withColumnRenamed("node", "a"), "a")
    n = parts.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    e = inside.groupBy("part").agg(F.count(F.lit(1)).alias("e"), F.min("sim").alias("low"))
    whole = (F.col("e") * 2 == F.col("k") * (F.col("k") - 1)) & (F.col("low") >= threshold)
    torn, found = observed(n.join(e, "part").filter(~whole).select("part", "e"), "torn", most=F.max("e"))
    if found["most"] is None:
        return parts.select("node", F.col("part").alias("cluster"))
    open_edges = inside.join(torn, "part")

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        got = linkage({(a, b): s for a, b, s in zip(rows["a"], rows["b"], rows["sim"], strict=True)}, threshold)
        return pd.DataFrame({"node": list(got), "cluster": list(got.values())})

    split = open_edges.filter(F.col("e") <= most).select("part", "a", "b", "sim").groupBy("part").applyInPandas(cut, "node bigint, cluster bigint")
    if found["most"] > most:
        split = split.unionByName(average_linkage(open_edges.filter(F.col("e") > most).select("a", "b", "sim"), threshold))
    return parts.join(split, "node", "left").select("node", F.coalesce("cluster", "part").alias("cluster"))


#: One typing error leaves a cosine of about 0.5 in short names, letters that changed places about 0.3, an initial beside an error 0.2.
PERSON_COSINE = 0.2
#: Words of trade and legal forms stay in the vectors with their low weights; a short firm beside three of them, or with letters that changed places, has about 0.3.
FIRM_COSINE = 0.3
#: An accepted pair counts at least 0.6, a refused one 0: a spelling joins two others that refuse each other with one of them only.
PERSON_LINKAGE, FIRM_LINKAGE = 0.5, 0.5


def vector_text(given: str, family: str) -> str:
    """The text of a person's vector: the full form of the given name and the family name."""
    return f"{full_form(given)} {family}"


def name_verdict(known: frozenset[str]) -> Verdict:
    """The check of two names, each 'given family' with the given name as written."""

    def accept(a: str, b: str) -> bool | None:
        x, y = tuple(a.split(" ", 1)), tuple(b.split(" ", 1))
        if same_name(x, y, known):
            return True
        most = 2 if min(len(x[1]), len(y[1])) < 5 else 4  # twice what one error may leave
        return None if x[0] == y[0] and len(x[0]) > 1 and edits(x[1], y[1], most) <= most else False

    return accept


def firm_verdict(a: str, b: str) -> bool | None:
    """The check of two firms, each 'core' and a mark where a mail domain spells it: a typing error is not spelled by a domain."""
    (x, sure_x), (y, sure_y) = a.split("\t"), b.split("\t")
    if x == y:
        return True
    if sure_x and sure_y:
        return False
    short = min(len(x), len(y))
    most = 0 if short < 5 else 1 if short < 10 else 2
    d = edits(x, y, 2 * most)
    return False if not most or d > 2 * most else True if d <= most else None


#: Texts longer than this are paired by their trigrams only, shorter ones by what deletions leave of them.
MOST_LETTERS = 30


def _deletions(text: str, most: int) -> set[str]:
    """text, and all that up to `most` deletions leave of it."""
    found = last = {text}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        found = found | last
    return found


def spelling_pairs(rows: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """Pairs as of cosine_pairs, of which one is not sure, of rows (w, n, t, note, sure): all that firm_verdict can accept, and others.

    Each of k edits costs a letter on either side, so two texts within k edits have in common what k deletions leave of both.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, nodes, sure = [], [], []
            for n, t, own in zip(b["n"], b["t"], b["sure"], strict=True):
                for most, low, high in ((1, 5, 10), (2, 10, MOST_LETTERS + 2)):
                    if low <= len(t) <= high:
                        left = _deletions(t, most)
                        keys.extend(zlib.crc32(x.encode("utf-8")) | len(x) << 32 | most << 40 for x in left)
                        nodes.extend([n] * len(left))
                        sure.extend([own] * len(left))
            yield pd.DataFrame({"key": np.array(keys, dtype=np.int64), "n": np.array(nodes, dtype=np.int64), "sure": np.array(sure, dtype=bool)})

    table = materialise(rows.select("n", "t", "sure").mapInPandas(cut, "key bigint, n bigint, sure boolean"), "deletions")
    pairs = table.select("key", F.col("n").alias("a"), F.col("sure").alias("_l")).join(table.select("key", F.col("n").alias("b"), F.col("sure").alias("_r")), "key").filter("a < b and not (_l and _r)").select("a", "b").distinct()
    side = lambda s: rows.select(F.col("n").alias(s), F.col("t").alias(f"text_{s}"), F.col("note").alias(f"note_{s}"))
    long = rows.filter(F.length("t") > MOST_LETTERS)
    return pairs.join(side("a"), "a").join(side("b"), "b").unionByName(cosine_pairs(long, weights, threshold, long.filter("not sure"))).dropDuplicates(["a", "b"])


def firm_edges(cores: DataFrame, weights: np.ndarray, threshold: float, cut: float) -> DataFrame:
    """(a, b, sim) of the firms' parts, rows (w, n, t, note, sure), with all pairs that average linkage at cut needs.

    Open pairs stay under OPEN, so above it two clusters merge only over an accepted pair: clusters lie within the parts that
    accepted pairs connect, and the trigram join is done within each part instead of over all firms.
    """
    if cut > OPEN:
        accepted = judged(spelling_pairs(cores, weights, threshold), weights, firm_verdict, threshold).filter(F.col("sim") > OPEN)
        parts = connected_components(materialise(accepted.select("a", "b"), "accepted")).select(F.col("id").alias("n"), F.col("root").alias("w"))
        cores = materialise(cores.drop("w").join(parts, "n"), "parts")
    return judged(cosine_pairs(cores, weights, threshold, cores.filter("not sure")), weights, firm_verdict, threshold)


def _groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The same rows, sorted by key, in frames that never cut a key's rows apart."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if b.empty:
            continue
        k = b[key].to_numpy()
        at = int(np.searchsorted(k, k[-1], "left")) if (np.diff(k) >= 0).all() else int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if held and (at or held[-1][key].iloc[-1] != k[0]):
            cut = int(np.flatnonzero(k != held[-1][key].iloc[-1])[0]) if (k != held[-1][key].iloc[-1]).any() else len(b)
            yield pd.concat([*held, b.iloc[:cut]], ignore_index=True)
            held = []
            b, at = b.iloc[cut:], at - cut
        if at > 0:
            yield b.iloc[:at].reset_index(drop=True)
            b = b.iloc[at:]
        if len(b):
            held.append(b)
    if held:
        yield pd.concat(held, ignore_index=True)


def links_in_place(rows: DataFrame, weights: np.ndarray, known: frozenset[str], threshold: float, cut: float, most: int) -> DataFrame:
    """(a, b, large) from rows (ev, given, family, id), grouped and sorted by ev, given, family, id: a star per cluster of an ev's names; of an ev with more than `most` rows only (ev, null, true)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, accept = Vectors(weights, threshold), name_verdict(known)
        judge = lru_cache(maxsize=200_000)(accept)
        for x in _groups(batches, "ev"):
            ev, ids = x["ev"].to_numpy(), x["id"].to_numpy()
            first = np.flatnonzero(np.append(True, ev[1:] != ev[:-1]))
            last = np.append(first[1:], len(ev))
            out_a, out_b, large = [], [], ev[first[last - first > most]]
            given, family = x["given"].to_numpy(), x["family"].to_numpy()
            for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
                if hi - lo < 2 or hi - lo > most:
                    continue
                nodes: dict[str, int] = {}
                of = [nodes.setdefault(f"{given[i]} {family[i]}", len(nodes)) for i in range(lo, hi)]
                names = list(nodes)
                texts = [vector_text(*n.split(" ", 1)) for n in names]
                k = len(names)
                if k == 1:
                    root = int(ids[lo:hi].min())
                    for i in ids[lo:hi].tolist():
                        if i != root:
                            out_a.append(root)
                            out_b.append(i)
                    continue
                if k <= 6:
                    pairs = {(i, j) for i in range(k) for j in range(i + 1, k)}
                else:
                    lists: dict[int, list[int]] = {}
                    pairs = set()
                    for j, t in enumerate(texts):
                        for c in vectors.head(t)[0]:
                            own = lists.setdefault(c, [])
                            pairs.update((i, j) for i in own)
                            own.append(j)
                sims = {}
                for i, j in pairs:
                    v = vectors.cosine(texts[i], texts[j])
                    if v >= threshold and (s := _similarity(v, judge(names[i], names[j]))) > 0:
                        sims[i, j] = s
                cluster = linkage(sims, cut) if sims else {}
                roots: dict[int, int] = {}
                label = [cluster.get(n, n) for n in of]
                for i, c in zip(ids[lo:hi].tolist(), label, strict=True):
                    roots[c] = min(i, roots.get(c, i))
                for i, c in zip(ids[lo:hi].tolist(), label, strict=True):
                    if roots[c] != i:
                        out_a.append(roots[c])
                        out_b.append(i)
            yield pd.DataFrame({"a": [*out_a, *large.tolist()], "b": pd.array([*out_b, *[None] * len(large)], "Int64"), "large": [False] * len(out_a) + [True] * len(large)})

    return rows.mapInPandas(work, "a bigint, b bigint, large boolean")


def links_of_large(rows: DataFrame, weights: np.ndarray, known: frozenset[str], threshold: float, cut: float) -> DataFrame:
    """(a, b) from rows (ev, given, family, id) of any number per ev: the same stars, by the trigram join and cluster_edges."""
    node = F.xxhash64("ev", "given", "family")
    nodes = rows.select(node.alias("n"), F.col("ev").alias("w"), "given", "family").distinct()

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": b["n"], "w": b["w"], "t": [vector_text(g, f) for g, f in zip(b["given"], b["family"], strict=True)], "note": b["given"] + " " + b["family"]})

    nodes = materialise(nodes.mapInPandas(text, "n bigint, w bigint, t string, note string"), "nodes")
    clusters = cluster_edges(judged(cosine_pairs(nodes, weights, threshold), weights, name_verdict(known), threshold), cut)
    named = lookup_join(rows.select(node.alias("node"), "id"), clusters, ["node"], "left").select(F.coalesce("cluster", "node").alias("label"), "id")
    named = materialise(named, "labels")
    first = named.groupBy("label").agg(F.min("id").alias("a"))
    return lookup_join(named, first, ["label"], "inner").filter("a <> id").select("a", F.col("id").alias("b"))


def link_persons(leads: DataFrame, threshold: float = PERSON_COSINE, cut: float = PERSON_LINKAGE, most: int = MOST_ROWS) -> DataFrame:
    """(person, id) of every lead that is linked to another: leads of one person under any spelling of the name.

    Names are compared among leads that share a mailbox, a phone line or a firm, and clustered there; clusters that
    share a lead are one person. Leads without a name, and those without evidence, take part in nothing. See
    DuplicateIndex for nulls and stand-ins.
    """
    given_names = given_name_table(leads)
    people = materialise(identities(leads, given_names).filter("family <> ''"), "people")
    known = frozenset(given_names)

    weights = gram_weights(people, "given", "family", text=vector_text)
    rows = evidence(people).select("ev", "given", "family", "id")
    # Of each ev a task keeps at most `most` + 1 rows before the shuffle: one row more shows that it is large.
    place = F.row_number().over(Window.partitionBy("ev").orderBy("given", "family", "id"))
    first = rows.withColumn("_place", place).filter(F.col("_place") <= most + 1)
    first = first.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ev"))).filter("_n > 1").drop("_place", "_n")
    found, seen = observed(links_in_place(first, weights, known, threshold, cut, most), "links", large=F.count_if("large"))
    links = found.filter("not large").select("a", "b")
    if seen["large"]:
        rest = rows.join(found.filter("large").select(F.col("a").alias("ev")), "ev", "left_semi")
        links = links.unionByName(links_of_large(materialise(rest, "large"), weights, known, threshold, cut))
    return connected_components(links).select(F.col("root").alias("person"), "id")


def link_firms(leads: DataFrame, threshold: float = FIRM_COSINE, cut: float = FIRM_LINKAGE) -> DataFrame:
    """(firm, text) of every distinct company_name, exactly as stored, that has another spelling; firm is the same for spellings of one firm.

    The vector of a text is that of its distinctive part: its folded letters without legal forms and words of trade. Texts
    with equal vectors have a cosine of 1 and are one node of the join. The check accepts two parts within the edits that a
    typing error may leave. Where the mail domains of the leads with that text spell it within two edits, the
    domain's spelling stands for it, and two parts that different domains spell are different firms. Null and
    blank texts give no row.
    """
    base = leads.select(F.col("company_name").cast("string").alias("text"), F.col("domain_root").cast("string").alias("root")).filter(F.regexp_replace("text", r"(?U)[\s\p{Z}]+", "") != "")
    votes = base.groupBy("text", "root").count().groupBy("text").agg(F.max(F.when(F.col("root").isNotNull() & ~F.col("root").isin(*sorted(PROVIDERS)), F.struct("count", "root"))).alias("m")).select("text", F.col("m.root").alias("root"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, sure = [], []
            for text, root in zip(b["text"], b["root"], strict=True):
                core, domain = firm_core(text), domain_core(root) if root else ""
                near = bool(domain) and (core == domain or (min(len(core), len(domain)) >= 5 and edits(core, domain, 2) <= 2))
                own.append(domain if near else core)
                sure.append(near)
            yield pd.DataFrame({"text": b["text"], "t": own, "sure": sure})

    texts = materialise(votes.mapInPandas(read, "text string, t string, sure boolean"), "firms")
    cores = texts.groupBy("t").agg(F.max("sure").alias("sure"), F.count(F.lit(1)).alias("texts")).select(F.xxhash64("t").alias("n"), F.lit(0).cast("bigint").alias("w"), "t", F.concat("t", F.lit("\t"), F.when(F.col("sure"), "x").otherwise("")).alias("note"), "sure", "texts")
    cores = materialise(cores, "cores")
    weights = gram_weights(cores, "t")
    clusters = cluster_edges(firm_edges(cores, weights, threshold, cut), cut)
    alone = cores.filter("texts > 1").select(F.col("n").alias("node")).join(clusters, "node", "left_anti").select("node", F.col("node").alias("cluster"))  # texts with equal vectors and no others near
    return texts.select("text", F.xxhash64("t").alias("node")).join(clusters.unionByName(alone), "node").select(F.col("cluster").alias("firm"), "text")


def variant_pairs(leads: DataFrame) -> DataFrame:
    """(kind, a, b): the pairs of leads of one person whose display_name differ, and of company_name texts of one firm.

    Leads with a null display_name take part in no pair; repeated rows count once; an empty
    table gives an empty result.
    """
    shown = leads.select(F.col("id").cast("bigint").alias("id"), F.col("display_name").cast("string").alias("shown")).filter("shown is not null").distinct()
    member = materialise(link_persons(leads).join(shown, "id"), "members")
    left, right = member.select("person", F.col("id").alias("i"), F.col("shown").alias("s")), member.select("person", F.col("id").alias("j"), F.col("shown").alias("r"))
    persons = left.join(right, "person").filter((F.col("i") < F.col("j")) & (F.col("s") != F.col("r"))).select(F.lit("person").alias("kind"), F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"))
    firms = materialise(link_firms(leads), "firms")
    a, b = firms.select("firm", F.col("text").alias("i")), firms.select("firm", F.col("text").alias("j"))
    companies = a.join(b, "firm").filter("i < j").select(F.lit("company").alias("kind"), "i", "j")
    return persons.unionByName(companies).select("kind", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
