import random
import re

from pyspark.sql import functions as F

from exposure import dims
from exposure.functions import checksums, masks
from exposure.functions.spans import near_spans, resolve_overlaps, spans
from exposure.operators import pii
from exposure.sources import tables


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return 13 <= len(digits) <= 19 and total % 10 == 0


def verhoeff(digits: str) -> bool:
    acc = 0
    for i, c in enumerate(reversed(digits)):
        acc = int(dims.VERHOEFF_D[acc * 10 + int(dims.VERHOEFF_P[(i % 8) * 10 + int(c)])])
    return bool(re.fullmatch("[2-9][0-9]{11}", digits)) and acc == 0


def with_check(body: str, test) -> str:
    return next(body + str(d) for d in range(10) if test(body + str(d)))


def scan(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.explode_findings(pii.scan_documents(df, **kw), ["doc_id"], with_value=True).collect()
    return sorted((r.doc_id, r.pii_type, r.value) for r in found), found


def test_checksums_equal_plain_python(spark):
    rng = random.Random(1)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.choice([11, 12, 13, 16, 19, 20]))) for _ in range(2000)]
    numbers += [with_check("2" + "".join(rng.choice("0123456789") for _ in range(10)), verhoeff) for _ in range(50)]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    got = df.select("n", checksums.luhn_ok(F.col("n")).alias("l"), checksums.verhoeff_ok(F.col("n")).alias("v")).collect()
    assert all(r.l == luhn(r.n) and r.v == verhoeff(r.n) for r in got)
    assert sum(r.v for r in got) >= 50


def test_spans_are_code_points(spark):
    texts = ["aé1 b22", "22", "", "𝒳 emoji 😀 7 77", "no digits"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", spans(F.col("t"), r"[0-9]+").alias("s")).collect():
        assert [(x.s, x.e, x.v) for x in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", r.t)]


def test_near_equals_windowed_search(spark):
    rng = random.Random(2)
    words = ["cat", "dog", "catdog", "x", "é", "\n", "dogs"]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    left, right, w = r"\bcat\b", r"\bdog\b", 6
    for r in df.select("t", near_spans(F.col("t"), left, right, w).alias("s")).collect():
        want = [
            m.start() for m in re.finditer(left, r.t)
            if re.compile(right).search(r.t, max(0, m.start() - w), min(len(r.t), m.end() + w))
        ]
        assert [x.s for x in r.s] == want


def test_overlaps_equal_plain_greedy(spark):
    rng = random.Random(3)
    sets = []
    for _ in range(200):
        row = []
        for det in range(rng.randrange(8)):
            s = rng.randrange(30)
            row.append((rng.randrange(2), -rng.choice([0.7, 0.9]), 0, s, det, s, s + 1 + rng.randrange(9)))
        sets.append(([(t, c, s - e, at, d, s, e) for t, c, _, at, d, s, e in row],))
    kind = "struct<tier:int,worse:double,shorter:int,at:int,det:int,s:int,e:int>"
    df = spark.createDataFrame(sets, f"c array<{kind}>")
    for r in df.select("c", resolve_overlaps(F.col("c")).alias("k")).collect():
        kept = []
        for c in sorted(tuple(x) for x in r.c):
            if not any(c[5] < k[6] and k[5] < c[6] for k in kept):
                kept.append(c)
        assert [tuple(x) for x in r.k] == sorted(kept, key=lambda c: c[5])


def test_true_positives(spark):
    aadhaar = with_check("23456789012", verhoeff)
    got, rows = scan(spark, [
        f"id {aadhaar[:4]} {aadhaar[4:8]} {aadhaar[8:]}", "Passwd = s3cret!!", "é ABCDE1234F", "born 1/2/1990", "a/c 123456789",
        "me@mail.example.org", "+91-98765 43210", "ravi.k@OKAXIS",
    ])
    assert [(d, t) for d, t, _ in got] == [
        (0, "aadhaar"), (1, "password"), (2, "pan"), (3, "dob"), (4, "bank_account"), (5, "email"), (6, "phone"), (7, "upi_id"),
    ]
    assert all(r.reason and 0 < r.confidence < 1 for r in rows)


def test_ordinary_text_is_silent(spark):
    got, _ = scan(spark, [
        "Order 123456789012 ships on 12/03/2024.", "Meet me at 42 Oak Street at 10:30", "version 1.2345", "", "   ", None,
        "call extension 12345", "the password is a secret thing",
    ])
    assert [g for g in got if g[0] != 7] == []


def test_one_value_one_finding(spark):
    card = "4111111111111111"
    got, rows = scan(spark, [f"account {card}", "pay ravi.k@ybl.example.com or ravi.k@ybl"])
    assert got[0] == (0, "credit_card", card)
    spans_of = sorted((r.start, r.end) for r in rows if r.doc_id == 1)
    assert all(a[1] <= b[0] for a, b in zip(spans_of, spans_of[1:]))


def test_mute_uncovers_the_weaker_finding(spark):
    df = spark.createDataFrame([(1, "account 4111111111111111", ["credit_card"])], "doc_id long, text string, m array<string>")
    types = [r.pii_type for r in pii.scan_pii(df, ["doc_id"], mutes_col="m").collect()]
    assert types == ["bank_account"]


def test_long_text_with_many_matches_is_whole(spark):
    text = " ".join(f"u{i}@x{i}.example.com" for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.explode_findings(pii.scan_documents(df), ["doc_id"], with_value=True).collect()
    assert len(found) == 3000 and all(text[r.start:r.end] == r.value for r in found)


def test_ocr_needs_a_checksum_and_few_swaps(spark):
    number = with_check("23456789014", verhoeff)
    once, many = number.replace("4", "A", 1), number.replace("0", "O")[:3] + "SIZB" + number[7:]
    got, rows = scan(spark, [f"no {once} end", f"no {many} end", f"no {number} end", f"x{once}"], ocr=True)
    assert [(g[0], g[1]) for g in got] == [(0, "aadhaar"), (2, "aadhaar")]
    assert {r.doc_id: r.detection_tier for r in rows} == {0: "ocr", 2: "regex"}
    assert next(r for r in rows if r.doc_id == 0).confidence == 0.8


def test_semantic_import_is_checked(spark):
    docs = spark.createDataFrame([(1, "I live at 5 Elm Road, write to a@b.example"), (2, "nothing")], "doc_id long, text string")
    out = spark.createDataFrame(
        [(1, 0, "postal_address", "5 Elm Road", 0.99, "an address it is"), (1, 1, "postal_address", "9 Fir Road", 0.9, "r"),
         (1, 2, "made_up", "Elm", 0.9, "r"), (1, 3, "health_detail", "a@b.example", 0.9, "r")],
        "doc_id long, ord int, type string, text string, confidence double, reason string",
    )
    joined = pii.semantic_candidates(docs, out)
    rows = pii.explode_findings(pii.scan_documents(joined, semantic_col="semantic"), ["doc_id"], True).collect()
    assert sorted((r.pii_type, r.confidence, r.detection_tier) for r in rows) == [
        ("email", 0.95, "regex"), ("postal_address", 0.85, "llm")
    ]


def test_masks(spark):
    cases = [("credit_card", "4111 1111 1111 1111", "XXXX XXXX XXXX 1111"), ("email", "ann@x.org", "a••@x.org"),
             ("api_key", "sk-abcdefghij", "sk-a" + "•" * 12), ("password", "short", "•••••"), ("pan", "AB12", "XX12")]
    df = spark.createDataFrame(cases, "t string, v string, want string")
    for r in df.select("want", masks.mask_for(F.col("t"), F.col("v")).alias("got")).collect():
        assert r.got == r.want


def test_stored_findings_hold_no_raw_value(spark, tmp_path):
    df = spark.createDataFrame([("d", "https://a.example", "text", "card 4111111111111111")], "device_id string, site_origin string, field_kind string, text string")
    df = df.withColumn("occurred_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    tables.write_findings(pii.scan_documents(df), str(tmp_path / "f"))
    back = tables.read_events(spark, str(tmp_path / "f"), F.lit("2024-02-05 00:00:00").cast("timestamp"))
    assert "4111111111111111" not in str(back.collect()) and back.count() == 1
    assert tables.read_events(spark, str(tmp_path / "f"), F.lit("2024-04-05 00:00:00").cast("timestamp")).count() == 0


def test_misread_numbers_in_long_runs(spark):
    """A text of one long run took a stack frame per character; the same tokens are found as character by character."""
    core = pii._OCR_CORE
    plain = rf"(?<![A-Za-z0-9])[{core}](?:[{core}]|[ \-](?=[{core}]))*(?![A-Za-z0-9])"
    java = spark._jvm.java.util.regex.Pattern
    for run in ("!" * 20_000, "1 " * 20_000 + "1", "0" * 20_000, "7-" * 20_000 + "7"):
        found = java.compile(pii._OCR_TOKEN).matcher(run + " x")
        assert found.find() and found.end() == len(run)
    rng = random.Random(5)
    rows = [("".join(rng.choice("01OlSB|! -xé.K") for _ in range(rng.randrange(1, 40))),) for _ in range(5000)]
    both = [F.struct(F.regexp_extract_all("t", F.lit(p), F.lit(0)), F.split("t", p)) for p in (plain, pii._OCR_TOKEN)]
    assert spark.createDataFrame(rows, "t string").filter(~both[0].eqNullSafe(both[1])).count() == 0
