"""Security tables derived from the general-purpose test tables.

The test data holds no device or breach tables, so each is computed from the
``events``, ``documents``, ``pages`` and ``conversations`` rows by arithmetic on their ids.
Every row of the source is used, so the work of a query grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure.sources.tables import read_table

NOW = "2024-02-05 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


PII_EVENTS = """
    event_id AS id,
    concat('dev-', user_id) AS device_id,
    ts AS occurred_at,
    concat(CASE WHEN event_id % 2 = 0 THEN 'https://' ELSE 'http://' END, 'site', event_id % 20, '.example') AS site_origin,
    CASE event_id % 3 WHEN 0 THEN 'paste' WHEN 1 THEN 'text' ELSE 'image' END AS field_kind,
    CASE event_type WHEN 'click' THEN 'email' WHEN 'view' THEN 'phone' WHEN 'purchase' THEN 'credit_card'
        WHEN 'signup' THEN 'aadhaar' ELSE 'coordinates' END AS pii_type,
    CASE event_type WHEN 'click' THEN 'low' WHEN 'view' THEN 'medium' WHEN 'purchase' THEN 'critical'
        WHEN 'signup' THEN 'high' ELSE 'odd' END AS risk_level,
    CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'masked' WHEN 2 THEN 'ignored' ELSE 'allowlisted' END AS action_taken,
    0.5 + CAST(event_id % 50 AS DOUBLE) / 100.0 AS confidence,
    'regex' AS detection_tier,
    concat('reason ', event_id % 5) AS reason,
    concat('XX', event_id % 100) AS masked_preview
"""

#: ``{reasons}`` differs by engine; the rest is common SQL.
SITE_CHECKS = """
    event_id AS id,
    concat('dev-', user_id) AS device_id,
    ts AS occurred_at,
    concat('shop', (event_id * 7) % 37, '.example.org') AS domain,
    CAST((event_id * 13) % 101 AS INT) AS trust_score,
    CASE event_id % 7 WHEN 0 THEN 'dangerous' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'suspicious'
        WHEN 3 THEN 'unknown' ELSE 'safe' END AS verdict
"""

IDENTITY_CHECKS = """
    event_id AS id,
    concat('dev-', user_id) AS device_id,
    ts AS occurred_at,
    upper(substr(sha1(CAST(event_id % 50 AS STRING)), 1, 5)) AS hash_prefix,
    CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN ' ACCT1 ' ELSE concat('acct', event_id % 5) END AS label,
    CAST(CASE event_id % 6 WHEN 1 THEN 3 WHEN 2 THEN 25 WHEN 3 THEN 5000 WHEN 4 THEN 250000 ELSE 0 END AS BIGINT) AS breach_count
"""


def _columns(text: str) -> list[str]:
    """Split a select list on the commas between its items."""
    out, depth, item = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(item.strip())
            item = ""
        else:
            item += ch
    return [*out, item.strip()]


def pii_events(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).selectExpr(*_columns(PII_EVENTS))


def site_checks(spark: SparkSession, sf: str) -> DataFrame:
    raw = events(spark, sf).selectExpr("event_id", *_columns(SITE_CHECKS))
    reason = F.struct(
        F.lit("domain_age").alias("signal"),
        F.concat(F.lit("note "), (F.col("event_id") % 11).cast("string")).alias("detail"),
        F.when(F.col("event_id") % 2 == 0, "bad").otherwise("good").alias("weight"),
    )
    reasons = F.when(F.col("event_id") % 5 == 0, F.array().cast(
        "array<struct<signal:string,detail:string,weight:string>>"
    )).otherwise(F.array(reason))
    return raw.withColumn("reasons", reasons).drop("event_id")


def identity_checks(spark: SparkSession, sf: str) -> DataFrame:
    from exposure.operators.identity import rate

    return rate(events(spark, sf).filter("event_type = 'signup'").selectExpr(*_columns(IDENTITY_CHECKS)))


# ---------------------------------------------------------------------------
# Texts.  The select lists below are common SQL of Spark and DuckDB.
# ---------------------------------------------------------------------------

#: every document, most with one line appended by its id
TEXTS = """
    doc_id,
    concat(text, CASE doc_id % 16
        WHEN 0 THEN concat(chr(10), 'Card 4111 1111 1111 1111 and mail user', doc_id, '@corp.example.com')
        WHEN 1 THEN concat(chr(10), 'my account number is 1234567890', lpad(CAST(doc_id % 100 AS STRING), 2, '0'))
        WHEN 2 THEN concat(chr(10), 'PAN ABCDE', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), 'F here')
        WHEN 3 THEN concat(chr(10), 'passport K', lpad(CAST(doc_id * 7919 % 10000000 AS STRING), 7, '0'), ' ok')
        WHEN 4 THEN concat(chr(10), 'IFSC HDFC0', lpad(CAST(doc_id % 1000000 AS STRING), 6, '0'), ' with account 98765432101234')
        WHEN 5 THEN concat(chr(10), 'pay ravi.k', doc_id, '@okaxis now')
        WHEN 6 THEN concat(chr(10), 'call +91 98765 ', lpad(CAST(doc_id % 100000 AS STRING), 5, '0'), ' soon')
        WHEN 7 THEN concat(chr(10), 'born on 12/03/19', lpad(CAST(doc_id % 100 AS STRING), 2, '0'))
        WHEN 8 THEN concat(chr(10), 'at 12.97160, 77.5946', doc_id % 10, ' now')
        WHEN 9 THEN concat(chr(10), 'password: hunter', doc_id, '!')
        WHEN 10 THEN concat(chr(10), 'key AKIAABCDEFGHIJKL', lpad(CAST(doc_id % 10000 AS STRING), 4, '0'), ' leaked')
        WHEN 11 THEN concat(chr(10), 'token ghp_', substr(concat(md5(CAST(doc_id AS STRING)), md5(CAST(doc_id AS STRING))), 1, 40), ' leaked')
        WHEN 12 THEN concat(chr(10), 'jwt eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiJ', doc_id, 'abcdefgh.c2lnbmF0dXJl', doc_id)
        WHEN 13 THEN concat(chr(10), 'ids 2', lpad(CAST(doc_id * 104729 % 100000000000 AS STRING), 11, '0'),
            ' and 3456 ', lpad(CAST(doc_id * 7 % 10000 AS STRING), 4, '0'), ' ', lpad(CAST(doc_id * 13 % 10000 AS STRING), 4, '0'))
        WHEN 14 THEN concat(chr(10), 'transfer to a.b@ybl from account 4111111111111111 or 411111111111111', doc_id % 10)
        ELSE '' END) AS text,
    concat('https://', CASE doc_id % 6 WHEN 0 THEN 'canary.discord.com' WHEN 1 THEN 'console.aws.amazon.com'
        WHEN 2 THEN 'www.hdfcbank.com' WHEN 3 THEN 'evil-discord.com' WHEN 4 THEN 'mail.google.com' ELSE 'localhost:3000' END,
        '/page/', doc_id) AS site_origin
"""

#: an Aadhaar-shaped or card-shaped number with two or three misread digits
OCR_TEXTS = """
    doc_id,
    concat(text, chr(10), CASE doc_id % 3
        WHEN 0 THEN concat('No. 2', translate(lpad(CAST(doc_id * 104729 % 100000000000 AS STRING), 11, '0'), '05', 'OS'), ' end')
        WHEN 1 THEN concat('Card 4111 1111 1I11 11l1 and 4111 1111 1111 I', lpad(CAST(doc_id % 1000 AS STRING), 3, '0'), ' end')
        ELSE 'SOIL BOLD 5OOO words' END) AS text
"""

EMAILS = """
    doc_id AS msg_id,
    CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '"SBI Alerts" <alerts@gmail.com>' WHEN 2 THEN 'PayPal <service@paypa1.com>'
        WHEN 3 THEN 'bob@work.org' WHEN 4 THEN 'Amazon <noreply@amazon.com>' WHEN 5 THEN 'not an address'
        WHEN 6 THEN 'amazon.support@mailer.example.net' ELSE 'Ann <ann@mail.uni.ac.uk>' END AS sender,
    CASE doc_id % 3 WHEN 0 THEN 'help@evil.example.com' WHEN 1 THEN NULL ELSE 'Ann <ann@uni.ac.uk>' END AS reply_to,
    CASE doc_id % 5 WHEN 0 THEN 'Urgent: act now' WHEN 1 THEN 'SBI account notice' ELSE 'Hello' END AS subject,
    concat(text, chr(10), CASE doc_id % 12
        WHEN 0 THEN 'Please confirm your password within 24 hours or your account will be suspended. <a href="http://arnazon.com/v">https://amazon.com/login</a>'
        WHEN 1 THEN 'Dear customer, you have won a lottery, claim your prize at http://bit.ly/x or http://bit.ly/y'
        WHEN 2 THEN 'See http://192.168.1.10/pay and pay by wire transfer'
        WHEN 3 THEN 'Please find the attached invoice.zip'
        WHEN 4 THEN '<a href="https://www.paypal.com/x">paypal.com</a> to update your card number'
        WHEN 5 THEN 'https://xn--pypal-4ve.com/login is the page'
        WHEN 6 THEN concat('https://sbi-verify-', doc_id, '.xyz/kyc and https://sbi.co.in/')
        WHEN 7 THEN '<a class="x" href=''https://shop.example.co.uk/a''><b>www.bank</b>.com</a> offers'
        ELSE '' END) AS body
"""

MESSAGES = """
    conv_id, turn, role = 'assistant' AS incoming,
    concat(text, CASE WHEN role <> 'assistant' THEN '' ELSE CASE conv_id % 10
        WHEN 0 THEN ' I will send you Rs 50,000 as a refund.'
        WHEN 1 THEN ' This is the police, there is a warrant against you.'
        WHEN 2 THEN ' Tell me the OTP you received.'
        WHEN 3 THEN ' Part-time job, earn Rs 3000 per day.'
        WHEN 4 THEN ' Send it to ravi.k@okaxis please.'
        WHEN 5 THEN ' Do not tell anyone. Message me on Telegram.'
        WHEN 6 THEN ' You have won a lottery of 5 lakh, just pay the processing fee to help@ybl and see http://bit.ly/x'
        WHEN 7 THEN ' Your account will be blocked, visit https://hdfc-kyc-update.xyz/a today.'
        ELSE '' END END) AS text
"""

PAYLOADS = """
    event_id AS payload_id,
    CASE event_id % 16
        WHEN 0 THEN concat('upi://pay?pa=amazon-refund@ybl&pn=Amazon%20Refund&am=', event_id % 5000, '&tn=urgent%20claim%20your%20prize')
        WHEN 1 THEN concat('upi://pay?pa=shop', event_id, '@okaxis&pn=Corner+Shop&mc=5411&am=', event_id % 300, '.50')
        WHEN 2 THEN 'upi://pay?pn=Nobody'
        WHEN 3 THEN concat('UPI://pay?pa=bob', event_id, '@zzz&am=abc')
        WHEN 4 THEN concat('https://bit.ly/', event_id)
        WHEN 5 THEN concat('http://10.0.0.', event_id % 256, '/a')
        WHEN 6 THEN 'javascript:alert(1)'
        WHEN 7 THEN concat('WIFI:T:nopass;S:Cafe', event_id, ';;')
        WHEN 8 THEN concat('WIFI:T:WPA2;S:Home', event_id, ';P:secret;;')
        WHEN 9 THEN concat('bitcoin:addr', event_id)
        WHEN 10 THEN concat('BEGIN:VCARD', chr(10), 'URL:https://arnazon.com/', event_id, chr(10), 'END:VCARD')
        WHEN 11 THEN concat('hello ', event_id)
        WHEN 12 THEN concat('upi://pay?pa=amazon@apl&pa=x', event_id, '%2540ybl&url=https%3A%2F%2Fa.example')
        WHEN 13 THEN concat('upi://pay?pa=plainname&am=1', repeat('0', CAST(event_id % 9 AS INT)))
        WHEN 14 THEN concat('https://shop', event_id % 100, '.example.org/pay')
        ELSE concat('upi://pay?pa=ravi', event_id, '@oksbi&pn=SBI%20Help&am=,', event_id % 4000) END AS payload
"""

REVIEWS = """
    source AS set_id,
    CAST(d.doc_id AS STRING) AS review_id,
    CASE d.doc_id % 4 WHEN 0 THEN 'Sponsored review' WHEN 1 THEN NULL ELSE 'Fine' END AS title,
    CASE WHEN d.doc_id % 9 = 0 THEN concat('copied praise of set ', source, ' great value nice shape good weight number', d.doc_id % 2)
         ELSE concat(text, CASE d.doc_id % 7 WHEN 0 THEN ' best product ever, must buy' WHEN 1 THEN ' value for money, five stars'
            WHEN 2 THEN ' received this product free' ELSE '' END) END AS body,
    CAST(CASE WHEN source IN ('src3', 'src4') THEN 1 + 4 * (d.doc_id % 2) ELSE 1 + d.doc_id % 5 END AS DOUBLE) AS rating,
    CASE WHEN source = 'src5' THEN NULL WHEN source = 'src6' THEN false ELSE quality = 1 END AS verified_purchase,
    concat('praise of set ', source) AS product_title
"""

URLS = """
    page_id,
    CASE page_id % 10
        WHEN 0 THEN concat('https://sbi-verify', page_id, '.xyz/a?x=1')
        WHEN 1 THEN concat('http://user:pw@login.paypa1.co.in:8080/p/', page_id, '#top')
        WHEN 2 THEN concat('https://smart-apple-orchard.com/', page_id)
        WHEN 3 THEN concat('https://www.amazon.in/gp/', page_id)
        WHEN 4 THEN concat('amazon-fanclub', page_id % 5, '.net')
        ELSE url END AS url
"""

SECRETS = """
    event_id AS id, concat('dev-', user_id) AS device_id, concat('pw', event_id % 5000) AS secret
"""

#: every fifth line is padding (count 0) and every seventh is malformed
CORPUS = """
    substr(upper(sha1(concat('pw', k))), 1, 5) AS prefix,
    concat(substr(upper(sha1(concat('pw', k))), 6), CASE WHEN k % 7 = 6 THEN 'X' ELSE '' END, ':', (k % 5) * 37) AS line
"""

#: a secret per event, every other one in the corpus of all events
ALL_SECRETS = """
    event_id AS id, concat('dev-', user_id) AS device_id, concat('pw', event_id * 2) AS secret
"""

TYPED = """
    CAST(user_id AS STRING) AS device_id,
    event_type AS field_id,
    CASE WHEN event_id % 9 = 8 THEN 'password' ELSE 'text' END AS field_type,
    concat('https://site', user_id % 20, '.example') AS site_origin,
    ts,
    CASE event_id % 4 WHEN 0 THEN ' hi ' WHEN 1 THEN concat('write to user', user_id, '@example.com')
        WHEN 2 THEN concat('card 4111 1111 1111 1111 for order ', event_id) ELSE 'nothing to see here' END AS text
"""

CARDS = """
    CAST(doc_id AS STRING) AS id, doc_id AS ord, source AS title, lang AS summary, text AS body
"""

QUESTIONS = """
    item_id AS qid,
    concat(text, CASE item_id % 4 WHEN 0 THEN ' my password' WHEN 1 THEN ' upi upi' ELSE '' END) AS question
"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").selectExpr(*_columns(TEXTS))


def ocr_texts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").selectExpr(*_columns(OCR_TEXTS))


def emails(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").selectExpr(*_columns(EMAILS))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations").filter("role <> 'system'").selectExpr(*_columns(MESSAGES))


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).selectExpr(*_columns(PAYLOADS))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").alias("d")
    q = read_table(spark, sf, "labels").select("doc_id", "quality").alias("q")
    return d.join(q, F.col("d.doc_id") == F.col("q.doc_id"), "left").selectExpr(*_columns(REVIEWS))


def urls(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").selectExpr(*_columns(URLS))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Registration dates of two thirds of the domains, by the length of the name."""
    from exposure.operators.urls import parse_urls

    n = F.length("domain")
    return (
        parse_urls(urls(spark, sf)).select("domain").distinct().filter(n % 3 != 0)
        .withColumn("registered_at", now() - F.make_dt_interval((n * 37) % 500))
    )


def threats(spark: SparkSession, sf: str) -> DataFrame:
    from exposure.operators.urls import parse_urls

    kinds = F.array(*[F.lit(k) for k in ("MALWARE", "SOCIAL_ENGINEERING", "UNWANTED_SOFTWARE", "POTENTIALLY_HARMFUL_APPLICATION")])
    return (
        parse_urls(urls(spark, sf)).filter("page_id % 11 = 0")
        .select(F.col("list_key").alias("url"), F.get(kinds, (F.col("page_id") % 4).cast("int")).alias("threat"))
    )


def secrets(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).selectExpr(*_columns(SECRETS))


def corpus_lines(spark: SparkSession, sf: str) -> DataFrame:
    keys = events(spark, sf).selectExpr("event_id % 4000 AS k").distinct()
    return keys.selectExpr(*_columns(CORPUS))


def all_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).selectExpr(*_columns(ALL_SECRETS))


def all_corpus_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line per event, without bound."""
    return events(spark, sf).selectExpr("event_id AS k").selectExpr(*_columns(CORPUS))


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").selectExpr(*_columns(CARDS)).withColumn(
        "tags", F.array(F.col("summary"))
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").selectExpr(*_columns(QUESTIONS))
