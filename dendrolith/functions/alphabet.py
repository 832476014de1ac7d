"""Alphabets: codes of symbols, indicator vectors and genetic codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nucleotide codes. U reads as T; any other letter and ? are 16, the gap is 17.
NUCLEOTIDES = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3, "R": 5, "Y": 6, "M": 7, "W": 8, "S": 9, "K": 10, "B": 11, "D": 12, "H": 13, "V": 14, "N": 15, "?": 16, "-": 17}
#: The resolved states that each code stands for (IUPAC).
NUCLEOTIDE_SETS = {0: "A", 1: "C", 2: "G", 3: "T", 5: "AG", 6: "CT", 7: "AC", 8: "AT", 9: "CG", 10: "GT", 11: "CGT", 12: "AGT", 13: "ACT", 14: "ACG", 15: "ACGT", 16: "ACGT", 17: "ACGT"}
# Amino acids in the order of their one-letter codes, then B, Z, X, stop, unknown, gap.
AMINO_ACIDS = {c: i for i, c in enumerate("ACDEFGHIKLMNPQRSTVWYBZX*?-")}

#: The standard genetic code, codons in TCAG order.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Other codes as changes to the standard one.
CODE_CHANGES: dict[str, dict[str, str]] = {
    "universal": {},
    "vertebrate mitochondrial": {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    "yeast": {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    "mold protozoan mitochondrial": {"TGA": "W"},
    "mycoplasma": {"TGA": "W"},
    "invertebrate mitochondrial": {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    "ciliate": {"TAA": "Q", "TAG": "Q"},
    "echinoderm mitochondrial": {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    "euplotid nuclear": {"TGA": "C"},
    "bacterial": {},
    "alternative yeast": {"CTG": "S"},
    "ascidian mitochondrial": {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    "flatworm mitochondrial": {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    "blepharisma nuclear": {"TAG": "Q"},
    "no stops": {"TAA": "Y", "TAG": "Y", "TGA": "W"},
}


def genetic_code(name: str = "universal") -> dict[str, str]:
    """Codon to amino acid, codons in ACGT order."""
    order = "TCAG"
    codons = [a + b + c for a in order for b in order for c in order]
    table = dict(zip(codons, STANDARD_CODE, strict=True)) | CODE_CHANGES[name]
    return {k: table[k] for k in sorted(table)}


def sense_codons(name: str = "universal") -> list[str]:
    return [c for c, a in genetic_code(name).items() if a != "*"]


def lookup(symbol: Column, table: dict, default) -> Column:
    """A literal map lookup with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), symbol), F.lit(default))


def encode_nucleotide(symbol: Column) -> Column:
    return lookup(F.upper(symbol), NUCLEOTIDES, 16)


def decode_nucleotide(code: Column) -> Column:
    """The inverse of the encoding; 16 reads as ?."""
    return lookup(code, {v: k for k, v in NUCLEOTIDES.items() if k != "U"}, "?")


def encode_amino_acid(symbol: Column) -> Column:
    return lookup(F.upper(symbol), AMINO_ACIDS, 24)


def encode_codon(codon: Column, code: str = "universal") -> Column:
    """Index among sense codons; a stop or an unresolved codon is the number of sense codons."""
    sense = sense_codons(code)
    return lookup(F.upper(codon), {c: i for i, c in enumerate(sense)}, len(sense))


def nucleotide_partial(code: Column) -> Column:
    """0/1 vector over ACGT of the states that a code allows."""
    vectors = {k: [1.0 if s in v else 0.0 for s in "ACGT"] for k, v in NUCLEOTIDE_SETS.items()}
    return reduce(lambda rest, kv: F.when(code == kv[0], F.lit(kv[1]).cast("array<double>")).otherwise(rest), vectors.items(), F.lit([1.0] * 4).cast("array<double>"))


def encode_generic(symbol: Column, states: list[str], ambiguities: dict[str, list[str]] | None = None) -> Column:
    """Index in ``states``; ambiguities come after them; anything else is missing (the last code)."""
    table = {s: i for i, s in enumerate([*states, *(ambiguities or {})])}
    return lookup(symbol, table, len(table))
