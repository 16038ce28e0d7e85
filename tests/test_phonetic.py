"""Double Metaphone codes, and speakers resolved by them against a plain ladder."""

import random

import pytest

from spanforge.functions.phonetic import codes, with_codes
from spanforge.operators.entity import SPEAKER_QUALITY, resolve_speakers

CODES = {
    "Smith": "SM0 XMT", "Schmidt": "XMT SMT", "Thomas": "TMS TMS", "Zachary": "SKR SKR", "Catherine": "K0RN KTRN", "Katherine": "K0RN KTRN", "Cotrell": "KTRL KTRL", "Cottrell": "KTRL KTRL",
    "Tredaway": "TRT TRT", "Treadaway": "TRT TRT", "Wright": "RT RT", "Jose": "HS HS", "Joseph": "JSF HSF", "Caesar": "SSR SSR", "Michael": "MKL MXL", "Czerny": "SRN XRN", "Wasserman": "ASRM FSRM",
    "Arnow": "ARN ARNF", "Filipowicz": "FLPT FLPF", "Xavier": "SF SFR", "Rogier": "RJ RJR", "Bach": "PK PK", "Cabrillo": "KPRL KPR", "McHugh": "MK MK", "Dumb": "TM TM", "Edge": "AJ AJ", "Laugh": "LF LF",
    "Hugh": "H H", "Pizza": "PS PTS", "Island": "ALNT ALNT", "Sugar": "XKR SKR", "School": "SKL SKL", "Schenker": "XNKR SKNK", "Gough": "KF KF", "Accident": "AKST AKST", "Bellocchio": "PLX PLX",
    "Bacher": "PKR PKR", "Architect": "ARKT ARKT", "Jackson": "JKSN AKSN", "Breaux": "PR PR", "Thumb": "0M TM", "Resnais": "RSN RSNS", "Orchestra": "ARKS ARKS", "Chianti": "KNT KNT",
    "Phillips": "FLPS FLPS", "Philips": "FLPS FLPS", "Stephen": "STFN STFN", "Steven": "STFN STFN", "Gnome": "NM NM", "Psalm": "SLM SLM",
}


@pytest.mark.parametrize("name", CODES)
def test_known_codes(name):
    assert " ".join(codes(name)) == CODES[name] and codes(name.lower()) == codes(f" {name.upper()} ")


def test_odd_names():
    assert codes(None) == codes("") == codes("123") == codes("!?") == ("", "")
    for letters in ("a", "ZZZZZZZZ", "ççñ", "WRWRWR", "gh", "x", "tth", "日本", "o'neil", "van der Berg"):
        assert all(len(c) <= 4 for c in codes(letters))


def test_each_name_once(spark):
    df = spark.createDataFrame([("Smith", 1), ("Smith", 2), (None, 3), ("", 4)], "n string, _i int")
    assert {(r["_i"], r.a, r.b) for r in with_codes(df, "n", "a", "b").collect()} == {(1, "SM0", "XMT"), (2, "SM0", "XMT"), (3, None, None), (4, "", "")}


def plain(label, project, contacts, affinity, either=False):
    """(contact, way) by looking at every contact."""
    full, parts = label.strip().lower(), label.lower().split(" ")
    f, last = parts[0], parts[1] if len(parts) > 1 else ""

    def sounds(a, b):
        x, y = ({c for c in codes(w)[: 2 if either else 1] if c} for w in (a, b))
        return bool(x & y)

    best = None
    for cid, name, aliases, internal in contacts:
        n = name.lower().split(" ")
        nf, nl = n[0], n[1] if len(n) > 1 else ""
        way = next((w for w, ok in (
            ("exact_name", name.strip().lower() == full), ("exact_alias", full in [a.lower() for a in aliases]), ("exact_full_name", last and nf == f and nl == last),
            ("phonetic_first_exact_last", last and len(f) >= 4 and nl == last and sounds(nf, f)), ("phonetic_both", last and len(f) >= 4 and len(last) >= 4 and sounds(nf, f) and nl and sounds(nl, last)),
            ("surname_phonetic", last and len(last) >= 4 and nf == f and nl and sounds(nl, last)), ("first_name_prefix", not last and len(f) >= 4 and name.lower().startswith(f)),
        ) if ok), None)
        if way:
            rank = (SPEAKER_QUALITY[way] + 10 * affinity.get((cid, project), 0.0), internal, [-ord(c) for c in cid])
            if best is None or rank > best[0]:
                best = (rank, cid, way)
    return best and best[1:]


@pytest.mark.parametrize("either", [False, True])
def test_speakers_equal_a_plain_ladder(spark, either):
    rng = random.Random(8)
    firsts, lasts = ["Zack", "Zak", "Dennis", "Denis", "Cathy", "Kathy", "Jo", "Stephen", "Steven", "Smyth"], ["Cotrell", "Cottrell", "Smith", "Schmidt", "Tredaway", "Treadaway", "Li", "Lee", "Chapman"]
    contacts = [(f"c{i:03}", f"{rng.choice(firsts)} {rng.choice(lasts)}" if i % 9 else rng.choice(firsts), [f"al {i % 7}"] if i % 3 else [], i % 5 == 0) for i in range(60)]
    labels = [(f"{rng.choice(firsts)} {rng.choice(lasts)}" if i % 6 else rng.choice([*firsts, "Denn", "AL 3", "Al 99", "Step"]), f"p{i % 4}") for i in range(150)] + [("", "p1"), ("   ", "p1"), ("12 34", "p1")]
    affinity = {(f"c{rng.randrange(60):03}", f"p{rng.randrange(4)}"): rng.choice([0.1, 0.5, 2.0]) for _ in range(60)}
    tables = spark.createDataFrame(contacts, "id string, name string, aliases array<string>, is_internal boolean"), spark.createDataFrame([(*k, w) for k, w in affinity.items()], "contact_id string, project_id string, weight double")
    got = {(r.label, r.project_id): (r.contact_id, r.match_type) for r in resolve_speakers(spark.createDataFrame(labels, "label string, project_id string"), *tables, either).collect()}
    want = {x: found for x in set(labels) if x[0].strip() and (found := plain(*x, contacts, affinity, either))}
    assert got == want
    alone = {r.label: r.contact_id for r in resolve_speakers(spark.createDataFrame([(x,) for x, _ in labels], "label string"), *tables, either).collect()}
    assert alone == {x: found[0] for x in {y for y, _ in labels} if x.strip() and (found := plain(x, None, contacts, {}, either))}


def test_a_last_name_stops_the_prefix(spark):
    contacts = spark.createDataFrame([("1", "Dennis Chapman", [], False)], "id string, name string, aliases array<string>, is_internal boolean")
    none = spark.createDataFrame([], "contact_id string, project_id string, weight double")
    got = {r.label: r.match_type for r in resolve_speakers(spark.createDataFrame([("Dennis Sittler",), ("Denn",), ("Den",)], "label string"), contacts, none).collect()}
    assert got == {"Denn": "first_name_prefix"}
