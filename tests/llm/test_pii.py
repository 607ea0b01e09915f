"""Personal data against a plain Python version of the rules."""

import hashlib
import random
import re

from evenkeel.llm import pii
from tests.llm.helpers import documents, edge_texts


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def expected(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def tricky():
    rng = random.Random(4)
    parts = ["a@b.c", "_x@d.e", "@", ".", "a.b@c-d.e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.1.1.1", "4111 1111 1111 1111",
             "4111-1111-1111-1111", "4111111111111111", "411111111111111111111", "+1 (988) 555-2485", "+12", "+1.5", " ", "-", "é", "😀", "7", "79927398713"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]


def test_spans_match_the_rules(spark):
    texts = [*tricky(), *edge_texts()[:14]]
    rows = {r.doc_id: r for r in pii.pii_digest(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        spans = expected(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        got = rows[i]
        assert got.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), text[:200]
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert got.spans.startswith(listed)


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 end", "DE89370400440532013001", "GB82WEST12345698765432", "123-45-6789", "my SSN is 123-45-6789"]
    rows = {r.doc_id: (r.n_iban, r.n_ssn) for r in pii.pii_digest(documents(spark, texts)).collect()}
    assert rows == {0: (1, 0), 1: (0, 0), 2: (1, 0), 3: (0, 0), 4: (0, 1)}


def test_context_raises_the_score(spark):
    rows = {r.doc_id: r.pii[0].score for r in pii.find_pii(documents(spark, ["host 1.2.3.4", "at 1.2.3.4"])).collect()}
    assert rows[0] > rows[1]


def test_context_window_at_the_start_of_a_text(spark):
    texts = ["a@b.cd " + "x" * (pii.WINDOW - 14) + " contact me", "a@b.cd " + "x" * 63 + " contact"]
    near, far = (r.pii[0].score for r in pii.find_pii(documents(spark, texts)).orderBy("doc_id").collect())
    assert near > far


def test_columns_with_the_names_used_inside(spark):
    docs = documents(spark, ["a@b.cd"]).selectExpr("*", "'mine' AS _pii", "'other' AS pii")
    row = pii.mask_pii(docs).first()
    assert (row._pii, row.pii, row.masked) == ("mine", "other", "[email]")
    assert pii.find_pii(docs).first()._pii == "mine"


def test_mask(spark):
    rows = {r.doc_id: r.masked for r in pii.mask_pii(documents(spark, ["é a@b.cd, 1.2.3.4!", None])).collect()}
    assert rows == {0: "é [email], [ip]!", 1: ""}


def test_empty_table_and_plan(spark):
    assert pii.pii_digest(documents(spark, [])).collect() == []
    plan = pii.pii_digest(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
