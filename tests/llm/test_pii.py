import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def digits(found):
        return re.sub(r"[^0-9]", "", found)

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("a@b.c-%1 ", max_size=50), st.text("0123456789. +-()", max_size=60), st.text("1.2@é +", max_size=50)))
def test_base_spans_equal_the_plain_patterns(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == plain_spans(text)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = [s[0] for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32, ssn 123-45-6789")]
    assert kinds == ["iban", "ssn"]
    assert pii.find_spans("number 123-45-6789") == []
    near, far = pii.find_spans("call 1.2.3.4 server")[0][4], pii.find_spans("version 1.2.3.4")[0][4]
    assert near > far


def test_long_runs_take_linear_time():
    for text in ("a" * 500_000 + "@", "1" * 500_000, "a@" * 100_000, "+1" + " " * 500_000, "1." * 200_000):
        pii.find_spans(text)


def test_query_on_edge_rows(edge_docs, edge_rows, no_docs):
    rows = pii.pii_digests(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    texts = dict((i, t) for i, t, *_ in edge_rows)
    for row in rows:
        spans = plain_spans(texts[row.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert row.n_phone == sum(k == "phone" for k, *_ in spans)
    assert pii.pii_digests(no_docs).count() == 0


def test_mask_keeps_rows_and_clashing_columns(clashing_docs):
    rows = pii.mask_pii(clashing_docs).collect()
    assert {r.pii for r in rows} == {"own pii"}
    masked = {r.doc_id: r.text for r in rows}
    assert masked[12].startswith("call <PHONE> or mail <EMAIL>\n") and masked[4] is None and masked[5] == ""
    assert pii.find_pii(clashing_docs).columns == clashing_docs.columns


def test_account_numbers_before_capitals_and_amounts():
    iban = "DE89 3704 0044 0532 0130 00"
    for after in ("", " BIC COBADEFF", " EUR 500", " EUR 500 IBAN GB82 WEST 1234 5698 7654 32 ZAHLBAR", ".", " AB12 3456"):
        text = f"Konto {iban}{after}"
        found = [text[s:e] for kind, s, e, *_ in pii.find_spans(text) if kind == "iban"]
        assert found[0] == iban and (len(found) == 2) == ("GB82" in after)
    assert not [s for s in pii.find_spans("Konto DE88 3704 0044 0532 0130 00 EUR") if s[0] == "iban"]
    assert "<IBAN> BIC COBADEFF" in pii.mask_spans(f"Konto {iban} BIC COBADEFF", pii.find_spans(f"Konto {iban} BIC COBADEFF"))
