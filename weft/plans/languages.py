"""The path languages: Dyck over one family, with a finite condition on the other."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    """A set of label words.

    balanced: the families that must nest: "p", "b", "pb" (both, nesting across
    each other) or "erased" (both, with ids and families taken for one).
    k: the labels of the other family fall into k groups by rank, each of which
    must occur an even number of times. endpoints: the other family's word is
    empty or begins with an opening and ends with a closing label. exclude: the
    rank of a label that isn't counted.
    """

    balanced: str
    k: int = 0
    endpoints: bool = False
    exclude: int | None = None

    @property
    def counted(self) -> str | None:
        """The family that is only counted; None where both are balanced."""
        return {"p": "b", "b": "p"}.get(self.balanced)

    def bit(self, rank: int) -> int:
        """What a label of that rank flips."""
        return 0 if not self.k or rank == self.exclude else 1 << rank % self.k


#: Method name to its two languages and whether it projects and excludes.
UNION, ERASED = Language("pb"), Language("erased")


@dataclass(frozen=True)
class Method:
    alpha: Language
    beta: Language
    project: bool = False
    exclude: bool = False


def _both(k: int, endpoints: bool = False, **more) -> Method:
    return Method(Language("p", k, endpoints), Language("b", k, endpoints), **more)


METHODS = {
    "default": _both(0),
    "parity": _both(1),
    "parity2": _both(2),
    "se": _both(2, True),
    "project": _both(1, project=True),
    "exclude": _both(1, exclude=True),
    "all": _both(2, True, project=True, exclude=True),
}

#: The labels counted while one is excluded fall into two groups, whatever the method's own k.
EXCLUDING = Language("p", 2)


def excluding(rank: int) -> Language:
    return replace(EXCLUDING, exclude=rank)


class States:
    """The finite states that a language carries beside the nesting, numbered from 0 (nothing seen)."""

    def __init__(self, language: Language):
        self.language = language
        masks = 1 << language.k
        if language.endpoints:
            self.all = [(0, "-", "-")] + [(m, f, t) for m in range(masks) for f in "oc" for t in "oc"]
        else:
            self.all = [(m, "-", "-") for m in range(masks)]
        self.index = {s: i for i, s in enumerate(self.all)}
        self.compose = [[self.index[self._join(a, b)] for b in self.all] for a in self.all]
        self.accepting = [i for i, (m, f, t) in enumerate(self.all) if m == 0 and (f == "-" or (f, t) == ("o", "c"))]
        # for a step s2 and a result s: the states s1 that lead there
        self.before = [[[a for a in range(len(self.all)) if self.compose[a][b] == s] for s in range(len(self.all))] for b in range(len(self.all))]

    @staticmethod
    def _join(a: tuple, b: tuple) -> tuple:
        return a[0] ^ b[0], b[1] if a[1] == "-" else a[1], a[2] if b[2] == "-" else b[2]

    def step(self, rank: int, side: str) -> int:
        """The state of one label of the counted family."""
        return self.index[(self.language.bit(rank), side, side) if self.language.endpoints else (self.language.bit(rank), "-", "-")]


def mask_column(language: Language, rank: Column) -> Column:
    """`Language.bit` as a column."""
    if not language.k:
        return F.lit(0)
    if not 0 < language.k < 64:
        raise ValueError("k is between 1 and 63, the bits of a mask")
    one = F.lit(1) if language.k < 32 else F.lit(1).cast("long")
    bit = F.call_function("shiftleft", one, F.pmod(rank, F.lit(language.k)).cast("int"))
    return bit if language.exclude is None else F.when(rank == language.exclude, F.lit(0).cast("int" if language.k < 32 else "long")).otherwise(bit)
