import random

import hashlib
import re

from tallyspark.llm import pii


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, regex) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(regex, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


TEXTS = [
    None, "", "plain", "é a@b.c and x.y@z.de.", "a@b@c.d", "a@b.c+d@e.f", "a@b.c.x@y.z", "1.2.3.4.5.6.7.8", "1.2.3.4 256.1.1.1 001.002.003.004 1.2.3",
    "4929348385146306 at 4929-3483-8514-6306 and 4929 3483 8514 6307", "+1 (017) 555-7713 then +12 and +49 30 1234567890123456", "0000000000000000", "card 4929348385146306, mail q@w.e, 4929348385146306",
    "9" * 30_000, "1 " * 20_000, "a" * 50_000, "日本 4929348385146306 語 1.1.1.1", "+++1 2 3 4 5 6 7 8 9", "1.2.3.4-4929348385146306", "a%@b-.c-", "@a.b", "x@y", "x@y.", "é@b.c",
]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "a@b.c")], "doc_id long, text string")
    for r in pii.span_report(docs).collect():
        want = brute(TEXTS[r.doc_id] if r.doc_id is not None else "a@b.c")
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in ("email", "ip", "card", "phone")] == want, (r.doc_id, r.spans, want)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(want)


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 01", "my ssn: 123-45-6789", "code 123-45-6789", "GB82WEST12345698765432 is it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.spans for r in pii.span_report(docs).orderBy("doc_id").collect()] == ["iban:0:27", "", "ssn:8:19", "", "iban:0:22"]


def test_ibans_in_running_text(spark):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    cases = {
        f"{gb} The account": [gb], "DE89370400440532013000 Total": ["DE89370400440532013000"], "DE89370400440532013000 5 days": ["DE89370400440532013000"],
        f"{de} BIC COBADEFF": [de], f"to {de} {gb} NOW": [de, gb], f"BE12 {de} 7": [de], f"AB12 3 {de}": [de], f"é {de}, {gb}. AT61 1904 3002 3457 3201 A1 B2": [de, gb, "AT61 1904 3002 3457 3201"],
        "NO93 8601 1117 947 Oslo": ["NO93 8601 1117 947"], "MT84 MALT 0110 0001 2345 MTLC AST0 01S X": ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"],
        "DE893704004405320130001": [], "DE89370400440532013000x": [], "DE89 3704 0044 0532 0130 01 The": [], "A1 " * 9_000: [],
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r, (text, want) in zip(pii.find_pii(docs).orderBy("doc_id").collect(), cases.items(), strict=True):
        assert [text[s.start : s.stop] for s in r.spans if s.kind == "iban"] == want, text[:99]
    assert pii.redact(spark.createDataFrame([(1, f"pay {gb} The rest")], "doc_id long, text string")).first().text == "pay [IBAN] The rest"


def test_iban_of_unlisted_country(spark):
    text = "ZZ" + next(f"{c:02}" for c in range(100) if int(f"1234567890123535{c:02}") % 97 == 1) + " 1234 5678 9012"
    docs = spark.createDataFrame([(1, text), (2, text + " The end")], "doc_id long, text string")
    assert [r.spans for r in pii.span_report(docs).orderBy("doc_id").collect()] == [f"iban:0:{len(text)}"] * 2


def test_context_is_of_the_text_and_not_of_the_piece_before(spark):
    far = "phone 555-123-4567 " + "x" * 40 + " 555-765-4321"
    texts = ["phone 555-123-4567 or 555-765-4321", "SSN: 123-45-6789, 987-65-4321", far, "é tel. 12, 555-765-4321"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[texts[r.doc_id][s.start : s.stop].strip() for s in r.spans] for r in pii.find_pii(docs).orderBy("doc_id").collect()]
    assert got == [["555-123-4567", "555-765-4321"], ["123-45-6789", "987-65-4321"], ["555-123-4567"], ["555-765-4321"]]
    assert pii.redact(docs).where("doc_id = 1").first().text == "SSN: [SSN], [SSN]"


def test_redact_keeps_columns_and_clean_texts(spark):
    docs = spark.createDataFrame([(1, "mail a@b.c now", "x"), (2, "clean", "y"), (3, None, "z"), (4, "1.2.3.4, 4929348385146306 é", "w")], "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "mail [EMAIL] now" and out[2].text == "clean" and out[3].text is None and out[1].spans == "x"
    assert out[4].text == "[IP], [CARD] é"


def test_empty_table(spark):
    assert pii.span_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_time_is_linear_in_the_matches(spark):
    import time

    took = {}
    for n in (10, 1_000, 5_000):
        text = "12345678 " * 8 * n + "phone " + "555-123-4567 " * n + "1.2.3.4 " * n
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string").repartition(1).cache()
        docs.count()
        began = time.perf_counter()
        row = pii.span_report(docs).first()
        took[n] = time.perf_counter() - began
        assert row.n_ip == n and row.n_added == n  # a list's word counts for all of it
    assert took[5_000] < 6 * max(2, took[1_000])


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a@b.c", "x", 2)], "doc_id long, text string, spans string, n_email int")
    assert pii.span_report(docs).first().n_email == 1


def test_local_phones_begin_at_their_digits_and_words_count_on_both_sides(spark):
    texts = ["call 555-123-4567", "(555) 123-4567 tel", "5551234567 (555)123-4567 fax", "+1 555-123-4567 phone", "phone +1-555-123-4567", "1-555-123-4567 phone", "555-123-4567 " + "x" * 40 + " phone"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    got = [[(s.kind, texts[r.doc_id][s.start : s.stop]) for s in r.spans] for r in rows]
    phone, local = "phone", "local_phone"
    assert got == [[(local, "555-123-4567")], [(local, "(555) 123-4567")], [(local, "(555)123-4567")], [(phone, "+1 555-123-4567")], [(phone, "+1-555-123-4567")], [], []]
    assert pii.redact(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).first().text == "call [LOCAL_PHONE]"


def test_redacted_by_plain_python(spark):
    rng = random.Random(11)
    bits = ["a@b.cd", "1.2.3.4", "phone 555-123-4567", "4929348385146306", "é", "word ", "x" * 300, "\n", "+49 30 1234567 ", "ssn 123-45-6789", "GB82 WEST 1234 5698 7654 32"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.choice([1, 5, 80, 700]))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    for r in pii.redact(docs).collect():
        out, upto = [], 0
        for s in spans[r.doc_id]:
            if s.start >= upto:
                out.append(texts[r.doc_id][upto : s.start] + f"[{s.kind.upper()}]")
            upto = max(upto, s.stop)
        assert r.text == "".join(out) + texts[r.doc_id][upto:]


def test_redaction_is_linear_in_the_spans(spark):
    import time

    took = {}
    for n in (10, 2_000, 16_000):
        docs = spark.createDataFrame([(1, "mail someone@example.org " * n)], "doc_id long, text string").repartition(1).cache()
        docs.count()
        began = time.perf_counter()
        assert pii.redact(docs).first().text == "mail [EMAIL] " * n
        took[n] = time.perf_counter() - began
    assert took[16_000] < 8 * max(1, took[2_000])


def test_redact_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([("a@b.c", "x", 1)], "text string, __spans string, pieces int")
    assert tuple(pii.redact(docs).first()) == ("[EMAIL]", "x", 1)
