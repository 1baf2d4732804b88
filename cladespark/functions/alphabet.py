"""Character alphabets as bit masks, and column functions over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Alphabet:
    """Primary states get one bit each in order; ambiguity codes are unions; aliases share a value; a gap is 0."""

    name: str
    states: str
    ambiguities: dict[str, str]
    aliases: dict[str, str]
    any: str
    gap: str = "-"

    def __post_init__(self):
        if len(set(self.states)) != len(self.states):
            raise ValueError("a state is defined twice")
        seen = set(self.states)
        for code, of in self.ambiguities.items():
            if code in seen:
                raise ValueError(f"code {code!r} is defined twice")
            if missing := set(of) - set(self.states):
                raise ValueError(f"undefined states {sorted(missing)}")
            seen.add(code)
        seen |= {self.any, self.gap}
        for code, of in self.aliases.items():
            if code in seen:
                raise ValueError(f"code {code!r} is defined twice")
            if of not in seen:
                raise ValueError(f"alias of an undefined code {of!r}")

    def values(self) -> dict[str, int]:
        out = {s: 1 << i for i, s in enumerate(self.states)}
        out |= {c: sum(out[s] for s in of) for c, of in self.ambiguities.items()}
        out |= {self.any: (1 << len(self.states)) - 1, self.gap: 0}
        return out | {c: out[of] for c, of in self.aliases.items()}

    def codes(self) -> dict[int, str]:
        """The first code registered for each value."""
        out: dict[int, str] = {}
        for c, v in self.values().items():
            out.setdefault(v, c)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        canon = self.codes()
        rows = [(self.name, c, v, c in self.states, canon[v], v.bit_count()) for c, v in self.values().items()]
        return spark.createDataFrame(rows, "alphabet string, code string, val int, is_primary boolean, canon string, popcount int")

    def canonize(self, seq: Column) -> Column:
        """Replace aliases by their primary codes."""
        return F.translate(seq, "".join(self.aliases), "".join(self.codes()[self.values()[c]] for c in self.aliases))

    def encode(self, seq: Column) -> Column:
        """Bit masks of a sequence; an undefined code fails when it is read."""
        known = F.create_map(*[F.lit(x) for kv in self.values().items() for x in kv])
        return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: F.element_at(known, c))

    def decode(self, values: Column) -> Column:
        """The sequence of some bit masks, each by its first code; an undefined value fails when it is read."""
        known = F.create_map(*[F.lit(x) for kv in self.codes().items() for x in kv])
        return F.array_join(F.transform(values, lambda v: F.element_at(known, v)), "")


# Nucleotide codes of the IUPAC.
_IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}
DNA = Alphabet("dna", "ACGT", _IUPAC, {"U": "T", "u": "T", "?": "N", ".": "-"} | {c.lower(): c for c in "ACGTRYSWKMBDHVN"}, "N")
#: Twenty amino acids, U and the stop code.
_AMINO = "ACDEFGHIKLMNPQRSTUVWY*"
PROTEIN = Alphabet("protein", _AMINO, {"B": "DN", "Z": "EQ"}, {"?": "X", ".": "-"} | {c.lower(): c for c in "ACDEFGHIKLMNPQRSTUVWYBZX"}, "X")
