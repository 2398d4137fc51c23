"""All spans against a plain version with the patterns as the contract writes them."""

import re

from authorlens.llm import pii
from tests.llm.odd import SCHEMA, docs, none

P = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, p in P.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0,
                    "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "a@b.cd%ef@g.h, x@y and .@-.- ", "é 中 mail me@x.org now 🙂 you@z.co.uk", "1.2.3.4 256.1.1.1 0001.02.255.000 1.2.3 1.2.3.4.5.6.7.8",
    "4111 1111 1111 1111, 4111-1111-1111-1112 and 0000000000000 5", "+1 (555) 010-9999 +49 30 1234567 +1 2 +123456789012345678 +12345678 -",
    "9" * 3_000 + " " + "1.1.1.1 " * 700 + "a." * 2_000 + "@x.y", "GB82 WEST 1234 5698 7654 32 DE89370400440532013000 GB83WEST12345698765432", "@@@+++...",
]


def test_spans(spark):
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in enumerate(TEXTS):
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("iban")] == base(t), t[:60]
    assert [s for s in got[6].spans.split(",") if s.startswith("iban")] == ["iban:0:27", "iban:28:50"] and got[6].n_iban == 2


def test_context(spark):
    number = "+49 30 1234567 89"
    cases = {
        f"call my phone {number}": 0.8, f"sample version {number}": 0.4, f"the hotel has {number}": 0.6, f"{number} is my phone": 0.8,
        f"{number}: Tel": 0.8, f"tel{number}": 0.8, f"{number}tel.": 0.8, f"locally, at the border, we discard {number}": 0.6, f"Fax: {number} (dummy)": 0.6,
        # a word that begins beyond the reach does not count, nor one cut off by it
        "hotel" + " " * 38 + number: 0.6, "a tel" + " " * 38 + number: 0.6, "tel" + " " * 37 + number: 0.8, "a tel" + " " * 37 + number: 0.8,
        number + " " * 37 + "tel": 0.8, number + " " * 37 + "telly": 0.6, number + " " * 38 + "tel": 0.6, f"étel {number} telé": 0.6,
    }
    rows = [(i, t, *[None] * 5) for i, t in enumerate(cases)]
    got = {r.doc_id: round(r.spans[0].score, 6) for r in pii.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases


def test_many_matches(spark):
    text = "x@y.zz " * 3_000
    got = pii.scan(spark.createDataFrame([(1, text, *[None] * 5)], SCHEMA)).first().spans
    assert [s.start for s in got] == list(range(0, len(text), 7))


def test_odd_rows(spark):
    assert sorted(r.spans for r in pii.digest(docs(spark)).collect()) == [""] * 8
    assert pii.digest(none(spark)).count() == 0
