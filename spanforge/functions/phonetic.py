"""Phonetic codes of names by the Double Metaphone rules.

A name has a primary code and a secondary one for its other likely sound; both
are the same where the rules know one sound only. The rules stand as a table:
the first one whose pattern fits at a place gives what to add to the two codes
and takes the characters it matched.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (pattern at a place, primary, secondary if another, what the whole name must be). ``G`` begins
#: as van, von or sch names do, ``M`` with mc, ``H`` with sch, ``S`` is of Slavic or Germanic look, ``s`` is not.
RULES = {
    "AEIOUY": [(r"\A.", "A"), (r".", "")],
    "B": [(r"BB?", "P")],
    "Ç": [(r"Ç", "S")],
    "C": [
        (r"(?<=[^AEIOUY]A)CH(?![IE])|(?<=[BM]A)CH(?=ER)", "K"), (r"\ACA(?=ESAR)", "S"), (r"CH(?=IA)", "K"), (r"(?<=.)CH(?=AE)", "K", "X"),
        (r"\ACH(?=ARAC|ARIS|OR(?!E)|YM|IA|EM)", "K"), (r"CH", "K", None, "G"), (r"(?<=OR)CH(?=ES|ID)|(?<=AR)CH(?=IT)|CH(?=[TS])", "K"),
        (r"(?:(?<=[AOUE])|\A)CH(?=[LRNMBHFVW ]|\Z)", "K"), (r"(?<=.)CH", "K", None, "M"), (r"(?<=.)CH", "X", "K"), (r"CH", "X"),
        (r"(?<!WI)CZ", "S", "X"), (r"CCI(?=A)", "X"), (r"(?<=\AA)CC(?!HU)[IEH]|(?<=U)CCE(?=[ES])", "KS"), (r"(?<!\AM)CC(?!HU)[IEH]", "X"), (r"(?<!\AM)CC", "K"),
        (r"C[KGQ]", "K"), (r"CI(?=[OEA])", "S", "X"), (r"C[IEY]", "S"), (r"C(?: [CQG]|(?!C[EI])[CKQ])?", "K"),
    ],
    "D": [(r"DG[IEY]", "J"), (r"DG", "TK"), (r"D[TD]?", "T")],
    "F": [(r"FF?", "F")],
    "G": [
        (r"(?<=[^AEIOUY])GH", "K"), (r"\AGH(?=I)", "J"), (r"\AGH", "K"), (r"(?:(?<=[BHD].)|(?<=[BHD]..)|(?<=[BH]...))GH", ""), (r"(?<=[CGLRT].U)GH", "F"), (r"(?<=[^I])GH", "K"), (r"GH", ""),
        (r"(?<=\A[AEIOUY])GN", "KN", "N", "s"), (r"GN(?!EY)", "N", "KN", "s"), (r"GN", "KN"), (r"GL(?=I)", "KL", "L", "s"),
        (r"\AG(?:Y|E(?=[SPBLYIR])|I(?=[BLNE]))", "K", "J"), (r"(?<![EI])(?<!\A[DRM]AN)(?:GE(?=R)|(?<![RO])GY)", "K", "J"),
        (r"G[EIY]|(?<=[AO])GG(?=I)", "K", None, "G"), (r"GE(?=T)", "K"), (r"GI(?=ER\Z)", "J"), (r"G[EIY]|(?<=[AO])GG(?=I)", "J", "K"), (r"GG?", "K"),
    ],
    "H": [(r"(?:\A|(?<=[AEIOUY]))H[AEIOUY]", "H"), (r"H", "")],
    "J": [(r"\AJ(?=OSE\Z)", "H"), (r"J(?=OSE)", "J", "H"), (r"\AJJ?", "J", "A"), (r"(?<=[AEIOUY])J(?=[AO])", "J", "H", "s"), (r"J\Z", "J", ""), (r"(?<![SKL])J(?![LTKSNMBZ])J?", "J"), (r"JJ?", "")],
    "K": [(r"KK?", "K")],
    "L": [(r"(?<=I)LL(?=[OA]\Z)|(?<=A)LL(?=E(?:.*[AO]S?)?\Z)", "L", ""), (r"LL?", "L")],
    "M": [(r"(?<=U)MB(?=\Z|ER)|MM?", "M")],
    "N": [(r"NN?", "N")],
    "Ñ": [(r"Ñ", "N")],
    "P": [(r"PH", "F"), (r"P[PB]?", "P")],
    "Q": [(r"QQ?", "K")],
    "R": [(r"(?<=IE)(?<!M[EA]IE)R\Z", "", "R", "s"), (r"RR?", "R")],
    "S": [
        (r"(?<=[IY])S(?=L)", ""), (r"\AS(?=UGAR)", "X", "S"), (r"SH(?=EIM|OEK|OLM|OLZ)", "S"), (r"SH", "X"), (r"SI[OA]", "S", "X", "s"), (r"SI[OA]", "S"), (r"\AS(?=[MNLW])|SZ", "S", "X"),
        (r"SCH(?=E[RN])", "X", "SK"), (r"SCH(?=OO|UY|E[DM])", "SK"), (r"\ASCH(?![AEIOUYW])", "X", "S"), (r"SCH", "X"), (r"SC[IEY]", "S"), (r"SC.?", "SK"), (r"(?<=[AO]I)S\Z", "", "S"), (r"S[SZ]?", "S"),
    ],
    "T": [(r"TIO(?=N)|TIA|TCH", "X"), (r"TH(?=[OA]M)", "T"), (r"TH|TT(?=H)", "T", None, "G"), (r"TH|TT(?=H)", "0", "T"), (r"T[TD]?", "T")],
    "V": [(r"VV?", "F")],
    "W": [(r"WR", "R"), (r"\AW(?=[AEIOUY])", "A", "F"), (r"\AW(?=H)", "A"), (r"(?<=[AEIOUY])W\Z|(?<=[EO])W(?=SK[IY])", "", "F"), (r"W", "", "F", "H"), (r"WI[CT]Z", "TS", "FX"), (r"W", "")],
    "X": [(r"\AX", "S"), (r"(?:(?<=[IE]AU)|(?<=[AO]U))X\Z", ""), (r"X[CX]?", "KS")],
    "Z": [(r"ZH", "J"), (r"ZZ(?=[OIA])", "S", "TS"), (r"(?<=[^T])ZZ?", "S", "TS", "S"), (r"ZZ?", "S")],
}

_TABLE = {c: [(re.compile(r[0], re.S), r[1], r[1] if len(r) < 3 or r[2] is None else r[2], r[3] if len(r) > 3 else "") for r in rules] for letters, rules in RULES.items() for c in letters}


def codes(name: str | None, length: int = 4) -> tuple[str, str]:
    """Primary and secondary code of a name, at most ``length`` characters each; empty without letters."""
    word = (name or "").strip().upper()
    looks = {"G": bool(re.match("VAN |VON |SCH", word)), "M": word.startswith("MC"), "H": word.startswith("SCH"), "S": bool(re.search("W|K|CZ|WITZ", word)), "": True}
    looks["s"] = not looks["S"]
    at, one, two = int(bool(re.match("GN|KN|PN|WR|PS", word))), "", ""
    while at < len(word) and min(len(one), len(two)) < length:
        step = 1
        for pattern, a, b, look in _TABLE.get(word[at], ()):
            if looks[look] and (m := pattern.match(word, at)):
                one, two, step = one + a, two + b, max(1, m.end() - at)
                break
        at += step
    return one[:length], two[:length]


@lru_cache(maxsize=1 << 16)
def _remembered(name: str) -> tuple[str, str]:
    return codes(name)


def with_codes(df: DataFrame, word: str, primary: str, secondary: str) -> DataFrame:
    """``df`` with the two codes of a column of names, null for null, in Arrow batches where the rows lie; a task remembers names."""

    @F.pandas_udf("struct<one: string, two: string>")
    def both(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if w is None else _remembered(w) for w in names], columns=["one", "two"])

    coded = df.withColumn("_codes", both(F.col(word)))
    return coded.withColumns({primary: F.col("_codes.one"), secondary: F.col("_codes.two")}).drop("_codes")
