"""Folding of typed text and names: plain Python for use inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters that Unicode does not decompose.
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"})

# Short and pet forms of given names.
NICKNAMES = {
    "alexander": "alex al sasha sascha xander sandy alec",
    "alexandra": "alex sasha sandra lexi",
    "anthony": "tony ant",
    "benjamin": "ben benny benji",
    "charles": "charlie chuck chas",
    "christopher": "chris topher kit",
    "daniel": "dan danny",
    "dmitri": "dima mitya",
    "dolores": "lola lolita",
    "edward": "ed eddie ted ned eddy teddy",
    "ekaterina": "katya",
    "elizabeth": "liz beth betty eliza lizzie lisa betsy",
    "francisco": "paco pancho fran curro",
    "friedrich": "fritz fred",
    "giuseppe": "beppe peppe pino",
    "gregory": "greg",
    "guadalupe": "lupe",
    "henry": "harry hank hal",
    "isabel": "isa izzy bella",
    "james": "jim jimmy jamie",
    "jennifer": "jen jenny jenn",
    "johannes": "hans johan",
    "jose": "pepe",
    "josef": "joe sepp jupp",
    "katherine": "kate kathy katie kat kit kath",
    "margaret": "maggie meg peggy marge greta",
    "maximilian": "max",
    "michael": "mike mick mickey mitch",
    "mikhail": "misha",
    "nicholas": "nick nicky klaus nico",
    "patricia": "pat patty tricia trish",
    "rebecca": "becky becca",
    "richard": "rick dick rich ricky",
    "robert": "bob rob bobby robbie bert",
    "samantha": "sam sammy",
    "sofia": "sophie",
    "susannah": "sue susan susie suzy susi",
    "theodore": "ted theo teddy",
    "thomas": "tom tommy",
    "victoria": "vicky tori vicki",
    "vladislav": "vlad slava",
    "william": "bill will liam billy willy",
}


def plain(token: str) -> str:
    """ue, oe and ae as u, o and a, so that both ways of writing an umlaut agree."""
    return token.replace("ue", "u").replace("oe", "o").replace("ae", "a")


FORMAL: dict[str, frozenset[str]] = {}
for _formal, _short in NICKNAMES.items():
    for _s in _short.split():
        FORMAL[plain(_s)] = FORMAL.get(plain(_s), frozenset()) | {plain(_formal)}

# Particles of family names.
PARTICLES = frozenset("de la del las los von van der den da di do dos du le el y zu zum ter ten".split())

# Titles before a name.
TITLES = frozenset("dr prof mr mrs ms miss mme mlle herr frau hr fr sr sra srta don dona ing dipl mag sir dott dra professor doctor".split())


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    low = text.casefold().translate(LETTERS)
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


_NOT_WORD = re.compile(r"[\W_]+")


def squash(text: str) -> str:
    """Folded letters and digits only."""
    return _NOT_WORD.sub("", fold(text))


@lru_cache(maxsize=200_000)
def _token(raw: str) -> str:
    """A part of a name as it is compared."""
    return plain(squash(raw))


_SPACES = re.compile(r"[\s ]+")
_PIECE = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?")


def name_parts(text: str | None) -> tuple[str, str, tuple[str, ...]]:
    """(given, family, others) of a person's name in any usual order, folded; '' where there is none.

    "Family, Given" and "FAMILY Given" are turned round; titles are dropped; hyphens are
    joined, particles (von, de la) left out; ue, oe, ae count as u, o, a, so that both ways of writing an umlaut agree.
    """
    if not text:
        return "", "", ()
    text = _SPACES.sub(" ", text).strip()
    turned = None
    if text.count(",") == 1:
        last, _, first = text.partition(",")
        if first.strip() and last.strip():
            turned = (first, last)
    halves = turned or (text,)
    tokens, marks = [], []
    for part, half in enumerate(halves):
        for raw in _PIECE.findall(half):
            token = _token(raw)
            if token and not (token in PARTICLES and len(token) > 1) and not (token in TITLES and (raw.endswith(".") or len(token) > 1) and not (len(halves) == 1 and len(tokens) >= 1)):
                tokens.append(token)
                marks.append((part, raw.rstrip(".")))
    if not tokens:
        return "", "", ()
    if turned:
        first = [t for t, (p, _) in zip(tokens, marks, strict=True) if p == 0]
        last = [t for t, (p, _) in zip(tokens, marks, strict=True) if p == 1]
        return (first[0] if first else ""), "".join(last), tuple(first[1:])
    loud = [len(r) > 1 and r.isupper() for _, r in marks]
    if len(tokens) > 1 and loud[0] and not loud[-1]:
        n = next(i for i, x in enumerate(loud) if not x)
        return tokens[n], "".join(tokens[:n]), tuple(tokens[n + 1 :])
    if len(tokens) == 1:
        return "", tokens[0], ()
    return tokens[0], tokens[-1], tuple(tokens[1:-1])


def edits(a: str, b: str, most: int = 99) -> int:
    """The unrestricted Damerau-Levenshtein distance (a true metric); most + 1 if it is greater than `most`."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    if not la or not lb:
        return min(max(la, lb), most + 1)
    top = la + lb
    last: dict[str, int] = {}
    before = None
    rows = [[top] * (lb + 2), [top, *range(lb + 1)]]
    for i in range(1, la + 1):
        row = [top, i] + [0] * lb
        at, ca, prev = 0, a[i - 1], rows[i]
        low = i
        for j in range(1, lb + 1):
            cb = b[j - 1]
            k = last.get(cb, 0)
            cost = prev[j] if ca == cb else min(prev[j], prev[j + 1], row[j]) + 1
            if k and at:
                swap = rows[k][at] + (i - k - 1) + 1 + (j - at - 1)
                if swap < cost:
                    cost = swap
            if ca == cb:
                at = j
            row[j + 1] = cost
            if cost < low:
                low = cost
        if low > most and before is not None and before > most:
            return most + 1
        before = low
        last[ca] = i
        rows.append(row)
    return min(rows[-1][-1], most + 1)
