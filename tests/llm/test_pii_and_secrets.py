import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from exposure.llm import pii_scan, secret_scan


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits(v):
    return re.sub("[^0-9]", "", v)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def brute(text, kinds):
    found = []
    for rank, (kind, (pattern, check)) in enumerate(kinds.items()):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if check(m)]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def noisy(rng):
    parts = ["a@b.c_x@y.zz", "é", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5", "255.0.0.256", "0000255.1.1.1", "+1 (389) 555-5010",
             "+12", "+1+2 345 678 901", "x@y", "x@y..z", "@", "a.b+c%d@e-f.gh.i", "0" * 14, "\n", " ", "-", "password=token=abcdef", "Secret: 'abc'",
             "API_KEY = \"a.b/c+d=\"", "token:abcde", "toKen :abcdef", "AKIA" + "Z9" * 8, "AKIA" + "Q" * 15, "AKIAAKIA", "f" * 23, "0123456789abcdef" * 2,
             "ſecret=abcdefg", "𝔘", "passwd==x", "123456789012345678901234567890", "visa"]
    return rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))


def listed(spans, base):
    return [f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind in base]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(9)
    texts = [noisy(rng) for _ in range(250)] + [None, "", "x" * 100_000, "a@" + "b." * 20_000 + "c", "1" * 50_000, "+1" + " " * 50_000]
    texts += [" ".join(f"u{i}@mail.example.com" for i in range(1500))]
    rows = [(i, t, "k", 1, [1]) for i, t in enumerate(texts)]
    return texts, spark.createDataFrame(rows, "doc_id long, text string, spans string, start int, blob array<int>")


def test_pii_against_brute_force(frame):
    texts, df = frame
    got = {r.doc: r.spans for r in pii_scan.find_pii(df).collect()}
    for i, t in enumerate(texts):
        assert listed(got[i], PII) == brute(t, PII), t
        assert all(t[s.start:s.end] == s.value and s.score >= 0.5 for s in got[i])


def test_secrets_against_brute_force(frame):
    texts, df = frame
    spans, book = secret_scan.find_secrets(df)
    got = {r.doc: r.spans for r in spans.collect()}
    for i, t in enumerate(texts):
        assert listed(got[i], SECRETS) == brute(t, SECRETS), t
    assert book.count() == len({t or "" for t in texts}) * len(secret_scan.RULES)


def test_pii_checksums_and_context(spark):
    texts = ["pay to iban GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "xGB82WEST12345698765432", "ssn 123-45-6789", "no 123-45-6789",
             "ssn 000-45-6789", "card 4111111111111111", "4111111111111111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: [(s.kind, round(s.score, 2)) for s in r.spans] for r in pii_scan.find_pii(df).collect()}
    kinds = {i: [k for k, _ in v] for i, v in got.items()}
    assert "iban" in kinds[0] and "iban" not in kinds[1] + kinds[2]
    assert "id_number" in kinds[3] and "id_number" not in kinds[4] + kinds[5]
    assert got[6] == [("card", 0.95)] and got[7] == [("card", 0.8)]


def test_the_ledger_is_incremental(spark):
    old = spark.createDataFrame([(1, "token=abcdefg"), (2, "plain"), (3, "plain"), (None, None)], "doc_id long, text string")
    _, book = secret_scan.find_secrets(old)
    new = old.union(spark.createDataFrame([(4, "secret: 1234567"), (5, "token=abcdefg")], old.schema))
    todo = secret_scan.unseen(new, book).collect()
    assert [bytes(r.blob).hex() for r in todo] == [hashlib.sha256(b"secret: 1234567").hexdigest()] and len(todo[0].todo) == len(secret_scan.RULES)
    rules = (*secret_scan.RULES[1:], secret_scan.Rule("assign", *[getattr(secret_scan.RULES[0], n) for n in ("pattern", "guard", "check")], version=2))
    again = secret_scan.unseen(old, book, rules).collect()
    assert len(again) == 3 and {tuple(r.todo) for r in again} == {("assign@2",)}
    spans, whole = secret_scan.find_secrets(new, book)
    assert {r.doc: [s.kind for s in r.spans] for r in spans.collect()} == {1: ["assign"], 2: [], 3: [], None: [], 4: ["assign"], 5: ["assign"]}
    assert secret_scan.unseen(new, whole).count() == 0


def test_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "token=abcdefg"), (1, "token=abcdefg")], "doc_id long, text string")
    spans, _ = secret_scan.find_secrets(df)
    assert [len(r.spans) for r in spans.collect()] == [1, 1]
    none = df.filter(F.lit(False))
    assert pii_scan.find_pii(none).count() == 0 and secret_scan.find_secrets(none)[0].count() == 0


def test_one_text_per_blob_is_scanned(spark):
    """Copies without an id, repeated rows, and NULL with empty texts, first and with a ledger."""
    hot = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("token=abcdefg").alias("text"))
    more = spark.createDataFrame([(1, "token=abcdefg"), (1, "token=abcdefg"), (2, None), (2, None), (3, ""), (4, "plain")], "doc_id long, text string")
    df = hot.union(more)
    assert sorted(r.text for r in secret_scan.texts_to_scan(df, None).collect()) == ["", "plain", "token=abcdefg"]
    _, book = secret_scan.find_secrets(more.filter("doc_id > 1"))
    assert [r.text for r in secret_scan.texts_to_scan(df, book).collect()] == ["token=abcdefg"]
    spans, whole = secret_scan.find_secrets(df, book)
    assert spans.filter("size(spans) = 1").count() == 20_002 and spans.count() == 20_006
    assert whole.count() == whole.select("blob", "rule", "version").distinct().count() == 3 * len(secret_scan.RULES)


def test_accounts_before_words_and_context_across_matches(spark):
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    texts = [f"{de} Please", "DE89370400440532013000 BIC COBADEFFXXX", f"{gb} {de} {gb}", f"é{de}.", f"{de}x", "ZZ22 3704 0044 0532 0130 00 NOW",
             "SSN: 123-45-6789, 234-56-7890", "123-45-6789, 234-56-7890 is the ssn", "ssn" + " " * 37 + "123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: [s.value for s in r.spans if s.kind in ("iban", "id_number")] for r in pii_scan.find_pii(df).collect()}
    two = ["123-45-6789", "234-56-7890"]
    assert [got[i] for i in (0, 1, 2, 4)] == [[de], ["DE89370400440532013000"], [gb, de, gb], []]
    assert got[3] == [de] and got[5] == ["ZZ22 3704 0044 0532 0130 00"] and got[6] == got[7] == two and got[8] == ["123-45-6789"]
    assert all(t[s.start:s.end] == s.value for r in pii_scan.find_pii(df).collect() for t in [texts[r.doc]] for s in r.spans)
