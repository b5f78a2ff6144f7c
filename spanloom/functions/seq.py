"""Sequence expressions: reverse complement, translation, open reading frames, splice classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BASES = "TCAG"
#: fixed values: the standard genetic code in TCAG order, stop as _
_CODE = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = ("TAG", "TAA", "TGA")


def reverse_complement(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGTNacgtn", "TGCANtgcan")


def translate(s: Column) -> Column:
    """Amino acids of whole codons; X for unknown bases; a partial codon is cut off.

    A codon's place in the code is 16 i + 4 j + k for the places of its bases.
    """
    # codons are cut once: a substring of a long text is found by counting from its start
    codes = F.create_map(*[F.lit(x) for k, amino in enumerate(_CODE) for x in (_BASES[k // 16] + _BASES[k // 4 % 4] + _BASES[k % 4], amino)])
    codons = F.regexp_extract_all(s, F.lit("(.{3})"), 1)
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(codes, c), F.lit("X"))), "")


def splice_class(donor: Column, acceptor: Column) -> Column:
    """Strand that a pair of splice-site dinucleotides supports."""
    return F.when((donor == "GT") & (acceptor == "AG"), "+").when((donor == "CT") & (acceptor == "AC"), "-").otherwise(".")


def wrapped(s: Column, width: int = 80) -> Column:
    return F.regexp_replace(s, f"(.{{{width}}})", "$1\n")


def orfs(s: str, min_aa: int = 100) -> list[tuple[int, int, int]]:
    """(frame, start, stop without the stop codon): first ATG behind each stop up to the next stop in frame."""
    out = []
    for frame in range(3):
        begin = None
        for at in range(frame, len(s) - 2, 3):
            codon = s[at : at + 3]
            if codon in STOPS:
                if begin is not None and at - begin >= 3 * min_aa:
                    out.append((frame, begin, at))
                begin = None
            elif codon == "ATG" and begin is None:
                begin = at
    return out
