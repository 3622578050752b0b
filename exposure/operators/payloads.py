"""Score decoded payment and link payloads (the strings inside QR codes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure import dims
from exposure.functions import hosts
from exposure.functions.basics import combine, compact, first, hits_type, pick, py_strip, settle
from exposure.operators import evidence as ev
from exposure.operators.urls import score_urls

# Schemes, bounds and penalties.
DANGEROUS_SCHEMES = ("javascript", "data", "file", "blob", "vbscript", "intent", "market", "content")
SIMPLE_SCHEMES = {
    "tel": "tel", "sms": "sms", "smsto": "sms", "mailto": "mailto", "geo": "geo",
    "bitcoin": "crypto", "ethereum": "crypto", "litecoin": "crypto",
}
MAX_AMOUNT, LARGE_AMOUNT = 10_000_000, 2000
WIFI_FIELD = r"(?i)(?<!\\)([TSPH]):([^;\\]*(?:\\.[^;\\]*)*)"
AMOUNT = "decimal(38,18)"

ADVICE = {
    "dangerous": "Do not act on this code; a code can only take money, never give it.",
    "suspicious": "Not proven genuine: act through the official app instead.",
    "safe": "Nothing was found, which is no guarantee: read what the app shows before approving.",
    "unknown": "Could not be judged: read what the code contains before acting.",
}
ACTIONS = (
    ("amount_on_receive_qr", "This code takes money from you."),
    ("payee_brand_mismatch", "Pay the company through its own app."),
    ("dangerous_scheme", "Close the scanner: this is an instruction, not an address."),
    ("malformed_vpa", "The payment address is not a valid one."),
)


def _tidy(value: Column) -> Column:
    """White space collapsed, nothing cut; NULL if empty."""
    return F.nullif(py_strip(F.regexp_replace(value, r"(?U)\s+", " ")), F.lit(""))


def _unquote(value: Column, plus: bool) -> Column:
    """Percent-decode leniently; a stray % stays, + is a blank only in form data."""
    safe = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(safe if plus else F.replace(safe, F.lit("+"), F.lit("%2B")))


def _param(pairs: Column, key: str) -> Column:
    """Value of the last pair with this key, NULL if absent."""
    mine = F.filter(
        pairs,
        lambda p: F.lower(_unquote(F.substring_index(p, "=", 1), True)) == key,
    )
    last = F.try_element_at(mine, F.lit(-1))
    value = F.when(
        F.contains(last, F.lit("=")), F.substr(last, F.length(F.substring_index(last, "=", 1)) + 2)
    ).when(last.isNotNull(), "")
    return _unquote(value, True)


def parse_payloads(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Add kind, scheme, destination, the ``upi`` struct, Wi-Fi fields and embedded links."""
    text = py_strip(F.coalesce(F.col(payload_col), F.lit("")))
    df = payloads.withColumn("_t", text)
    t = F.col("_t")
    df = df.withColumn("scheme", F.nullif(F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)), F.lit("")))
    scheme = F.col("scheme")
    dangerous = F.coalesce(scheme.isin(*DANGEROUS_SCHEMES), F.lit(False))
    kind = (
        F.when(t == "", "text").when(dangerous, "text")
        .when(scheme.isin("upi", "upiqr"), "upi")
        .when(scheme.isin("http", "https"), "url")
        .when(F.startswith(F.upper(t), F.lit("WIFI:")), "wifi")
        .when(t.rlike("(?i)^(?:BEGIN:VCARD|MECARD:)"), "vcard")
        .when(scheme.isin(*SIMPLE_SCHEMES), pick(SIMPLE_SCHEMES, scheme))
        .otherwise("text")
    )
    df = df.withColumn("dangerous_scheme", dangerous).withColumn("kind", kind)
    is_upi, is_wifi = F.col("kind") == "upi", F.col("kind") == "wifi"
    query = F.substr(t, F.length(F.substring_index(t, "?", 1)) + 2)
    df = df.withColumn("_pairs", F.when(is_upi, F.split(query, "&")))
    pairs = F.col("_pairs")
    twice = lambda key: _unquote(F.coalesce(_param(pairs, key), F.lit("")), False)
    df = df.withColumns({
        "_vpa": F.when(is_upi, F.coalesce(_tidy(twice("pa")), F.lit(""))),
        "_am": F.when(is_upi, py_strip(_param(pairs, "am"))),
    })
    vpa = F.col("_vpa")
    plain = F.regexp_replace(F.col("_am"), "[,_]", "")
    amount = plain.try_cast(AMOUNT)
    given = F.coalesce(F.replace(F.col("_am"), F.lit(","), F.lit("")) != "", F.lit(False))
    readable = F.coalesce(amount.between(0, MAX_AMOUNT), F.lit(False))
    at = F.contains(vpa, F.lit("@"))
    handle = F.when(at, F.lower(F.substring_index(vpa, "@", -1))).otherwise("")
    local = F.when(at, F.substr(vpa, F.lit(1), F.length(vpa) - F.length(F.substring_index(vpa, "@", -1)) - 1)).otherwise(vpa)
    df = df.withColumn(
        "upi",
        F.when(is_upi, F.struct(
            vpa.alias("payee_vpa"),
            handle.alias("handle"),
            local.alias("local_part"),
            _tidy(twice("pn")).alias("payee_name"),
            F.when(given & readable, amount).alias("amount"),
            (given & ~readable).alias("amount_unreadable"),
            F.upper(F.coalesce(_tidy(_param(pairs, "cu")), F.lit("INR"))).alias("currency"),
            _tidy(twice("tn")).alias("note"),
            _tidy(_param(pairs, "mc")).alias("merchant_code"),
            _tidy(_param(pairs, "tr")).alias("txn_ref"),
            _tidy(twice("url")).alias("embedded_url"),
        )),
    )
    fields = F.arrays_zip(
        F.transform(F.regexp_extract_all(F.substr(t, F.lit(6)), F.lit(WIFI_FIELD), F.lit(1)), F.upper).alias("k"),
        F.regexp_extract_all(F.substr(t, F.lit(6)), F.lit(WIFI_FIELD), F.lit(2)).alias("v"),
    )
    df = df.withColumn("_wifi", F.when(is_wifi, fields))
    wifi = lambda key: F.try_element_at(F.filter("_wifi", lambda f: f["k"] == key), F.lit(-1))["v"]
    auth = F.lower(py_strip(F.coalesce(wifi("T"), F.lit(""))))
    ssid = F.replace(F.replace(F.coalesce(wifi("S"), F.lit("")), F.lit("\\;"), F.lit(";")), F.lit("\\\\"), F.lit("\\"))
    known_auth = auth.isin("", "wpa", "wpa2", "wpa3", "wep", "sae", "wpa2-eap", "wpa/wpa2")
    loose = F.col("kind").isin("vcard", "text", *SIMPLE_SCHEMES.values()) & ~F.col("dangerous_scheme")
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(ev.URL), F.lit(0)))
    df = df.withColumns({
        "wifi_ssid": F.when(is_wifi, _tidy(ssid)),
        "wifi_open": F.when(is_wifi, F.when(auth == "nopass", True).when(known_auth, False)),
        "embedded_urls": F.when(loose, found).otherwise(F.array().cast("array<string>")),
        "url": F.when(F.col("kind") == "url", t),
    })
    df = settle(df, ["kind", "scheme", "dangerous_scheme", "upi", "wifi_ssid", "wifi_open", "embedded_urls", "url"])
    return df.withColumn("destination", _destination(t)).drop("_t", "_pairs", "_vpa", "_am", "_wifi")


def money(amount: Column) -> Column:
    whole = amount == F.floor(amount)
    return F.when(whole, F.format_number(amount, 0)).otherwise(F.format_number(amount, 2))


def _destination(t: Column) -> Column:
    upi = F.col("upi")
    who = F.coalesce(F.nullif(upi["payee_vpa"], F.lit("")), F.lit("nobody named"))
    pays = (
        F.when(upi["amount"].isNotNull(), F.concat(F.lit("Pays "), upi["currency"], F.lit(" "), money(upi["amount"]), F.lit(" to "), who))
        .when(upi["amount_unreadable"], F.concat(F.lit("Pays an unreadable amount to "), who))
        .otherwise(F.concat(F.lit("Pays an open amount to "), who))
    )
    kind = F.col("kind")
    return (
        F.when(t == "", "Holds nothing readable")
        .when(F.col("dangerous_scheme"), F.concat(F.lit("Runs an instruction: "), F.col("scheme")))
        .when(kind == "upi", pays)
        .when(kind == "url", F.concat(F.lit("Opens "), hosts.url_host(t)))
        .when(kind == "wifi", F.concat_ws(" ", F.lit("Joins a Wi-Fi network"), F.col("wifi_ssid")))
        .when(kind == "vcard", "Adds a contact")
        .when(kind == "tel", "Calls a number")
        .when(kind == "sms", "Sends a text message")
        .when(kind == "mailto", "Writes an email")
        .when(kind == "geo", "Opens a map")
        .when(kind == "crypto", "Sends cryptocurrency")
        .otherwise("Shows plain text")
    )


def _foreign_brand(text: Column, handle: Column) -> Column:
    """First brand named in the text, unless it is paid through this handle."""
    brand = first(F.filter(hosts.host_tokens(F.coalesce(text, F.lit(""))), hosts.is_brand))
    paid = F.try_element_at(_handles(), brand)
    return F.when(~F.coalesce(F.array_contains(paid, handle), F.lit(False)), brand)


def _handles() -> Column:
    from exposure.functions.basics import lit_map

    return lit_map(dims.BRAND_HANDLES)


def _upi_hits() -> Column:
    upi = F.col("upi")
    vpa, handle, amount = upi["payee_vpa"], upi["handle"], upi["amount"]
    brand, named = F.col("_brand"), F.col("_named")
    worst_note = F.array_max(F.transform("_note_hits", lambda h: h["penalty"]))
    preset = F.when(F.coalesce(upi["merchant_code"], F.lit("")) != "", 20).when(amount >= LARGE_AMOUNT, 85).otherwise(50)
    return compact(
        F.when(vpa == "", ev.hit("missing_vpa", 0, "Names no account to pay.", None))
        .when(handle == "", ev.hit("malformed_vpa", 70, "The payment address is not of the form name@bank.", vpa))
        .when(~handle.isin(*dims.UPI_HANDLES), ev.hit(
            "unknown_psp_handle", 50, F.concat(F.lit("Unknown payment provider @"), handle, F.lit(".")), vpa)),
        F.when(brand.isNotNull(), ev.hit(
            "payee_brand_mismatch", 80, F.concat(F.lit("The address uses the name "), brand, F.lit(" but does not pay it.")), vpa))
        .when(named.isNotNull(), ev.hit(
            "payee_name_brand_mismatch", 60, F.concat(F.lit("Displays the name "), named, F.lit(" but pays somebody else.")), upi["payee_name"])),
        F.when(amount > 0, ev.hit(
            "amount_on_receive_qr", preset,
            F.concat(F.lit("Takes "), upi["currency"], F.lit(" "), money(amount), F.lit(" from you.")), money(amount)))
        .when(upi["amount_unreadable"], ev.hit("unreadable_amount", 55, "States an amount that cannot be read.", None)),
        F.when(F.size("_note_hits") > 0, ev.hit(
            "urgent_note", F.least(F.lit(70), worst_note), "The note presses or tempts.", upi["note"])),
        F.when(upi["embedded_url"].isNotNull(), ev.hit(
            "link_inside_payment", 60, "Carries a web link as well.", upi["embedded_url"])),
    ).cast(hits_type())


def _url_hits(target: Column) -> Column:
    host = hosts.url_host(target)
    return compact(
        F.when(F.col("domain").isin(dims.SHORTENERS), ev.hit(
            "shortened_link", 55, F.concat(F.lit("Hides its target behind "), F.col("domain"), F.lit(".")), F.substring(target, 1, 120))),
        F.when(hosts.is_raw_ip(host), ev.hit("raw_ip_link", 70, "Leads to a bare numeric address.", host)),
    ).cast(hits_type())


def _linked_risk(known: Column, trust: Column, hits: Column) -> Column:
    local = combine(hits, ev.LINK_BUMP)
    return F.when(known, F.greatest(F.lit(100) - trust, local)).otherwise(local)


def _worst_links(several: DataFrame, registry: DataFrame | None, threats: DataFrame | None, loaded: Column | None) -> DataFrame:
    """``(_key, _worst)``: of payloads with several links, the link of most risk once all are looked up.

    Equal risks go to the host that looks worse by itself, then to the first link.  A payload that
    occurs often is looked up once.
    """
    links = several.select("_key", "_now", "_loaded", "embedded_urls").dropDuplicates(["_key"]).select(
        "_key", "_now", "_loaded", F.posexplode("embedded_urls").alias("_place", "_link")
    )
    loaded = None if loaded is None else F.col("_loaded")
    scored = score_urls(links, F.col("_now"), registry, threats, loaded, url_col="_link")
    scored = settle(scored.withColumn("_hits", _url_hits(F.col("_link"))), ["_hits"])
    risk = _linked_risk(F.col("verdict") != "unknown", F.col("trust_score"), F.col("_hits"))
    looks = (
        F.when(F.coalesce(hosts.mismatch(F.col("brand")), F.lit(False)), 90).when(hosts.is_raw_ip(F.col("host")), 70)
        .when(F.col("domain").isin(dims.SHORTENERS), 55).otherwise(0)
    )
    ranked = F.struct(risk.alias("risk"), looks.alias("looks"), (-F.col("_place")).alias("place"), F.col("_link").alias("link"))
    return scored.groupBy("_key").agg(F.max(ranked).alias("top")).select("_key", F.col("top.link").alias("_worst"))


def _with_targets(
    payloads: DataFrame, payload_col: str, now: Column, registry: DataFrame | None, threats: DataFrame | None, loaded: Column | None
) -> DataFrame:
    """Parsed payloads and ``_target``, the link to judge.

    Only payloads that spell two addresses or more can hold several links.  They alone are exploded,
    looked up and joined; all others pass through without a shuffle.
    """
    first_link = first(F.col("embedded_urls"))
    spelled = F.regexp_count(F.coalesce(F.col(payload_col), F.lit("")), F.lit("(?i)https?://"))
    single = parse_payloads(payloads.filter(spelled < 2), payload_col).withColumn("_target", F.coalesce("url", first_link))
    many = parse_payloads(payloads.filter(spelled >= 2), payload_col)
    many = many.withColumns({"_now": now, "_loaded": F.lit(None).cast("boolean") if loaded is None else loaded})
    # a struct as JSON names its fields, so a NULL in one is no value of another
    named = F.to_json(F.struct(F.unix_micros("_now").alias("now"), F.col("_loaded").alias("loaded"), F.col(payload_col).alias("payload")))
    many = many.withColumn("_key", F.sha2(named, 256))
    worst = _worst_links(many.filter("url IS NULL AND size(embedded_urls) > 1"), registry, threats, loaded)
    many = many.join(worst, "_key", "left").withColumn("_target", F.coalesce("url", "_worst", first_link))
    return many.drop("_key", "_now", "_loaded", "_worst").unionByName(single)


def _row(signal: str, detail, weight: str, evidence=None) -> Column:
    detail = detail if isinstance(detail, Column) else F.lit(detail)
    evidence = evidence if isinstance(evidence, Column) else F.lit(evidence)
    return F.struct(
        F.lit(signal).alias("signal"), detail.alias("detail"), F.lit(weight).alias("weight"),
        evidence.cast("string").alias("evidence"),
    ).cast(ev.SIGNAL)


def _bad_rows(hits: Column) -> Column:
    return F.transform(
        hits,
        lambda h: F.struct(
            h["name"].alias("signal"), h["detail"].alias("detail"),
            F.when(h["name"] == "missing_vpa", "unknown").otherwise("bad").alias("weight"),
            h["evidence"].alias("evidence"),
        ).cast(ev.SIGNAL),
    )


def score_payloads(
    payloads: DataFrame, now: Column, payload_col: str = "payload",
    registry: DataFrame | None = None, threats: DataFrame | None = None, loaded: Column | None = None,
) -> DataFrame:
    """Score, verdict, confidence and signals of each payload."""
    kind, upi = F.col("kind"), F.col("upi")
    if threats is not None and loaded is None:
        loaded = F.lit(True)
    df = _with_targets(payloads, payload_col, now, registry, threats, loaded)
    df = score_urls(df, now, registry, threats, loaded, url_col="_target")
    site = {c: f"site_{c}" for c in ("verdict", "trust_score", "confidence", "reasons")}
    df = df.withColumnsRenamed(site).drop("summary", "brand", "lures", "url_key", "threats")
    df = df.withColumns({
        "_brand": F.when(upi.isNotNull(), _foreign_brand(upi["local_part"], upi["handle"])),
        "_named": F.when(upi.isNotNull(), _foreign_brand(upi["payee_name"], upi["handle"])),
        "_note": ev.strip_markup(F.concat(F.lit("\n"), F.coalesce(upi["note"], F.lit("")))),
    })
    df = ev.add_content_hits(df, "_note", "_note_hits")
    df = df.withColumn("_upi_hits", F.when(upi.isNotNull(), _upi_hits()).otherwise(ev.no_hits()))
    has_target = F.col("_target").isNotNull()
    df = df.withColumn("_url_hits", F.when(has_target, _url_hits(F.col("_target"))).otherwise(ev.no_hits()))
    df = settle(df, ["_upi_hits", "_url_hits"])
    upi_score = combine(F.col("_upi_hits"), 6)
    site_known = F.coalesce(F.col("site_verdict") != "unknown", F.lit(False)) & has_target
    danger, is_url = F.col("dangerous_scheme"), kind == "url"
    linked = _linked_risk(site_known, F.col("site_trust_score"), F.col("_url_hits"))
    score = (
        F.when(danger, 90).when(kind == "upi", upi_score).when(is_url, linked)
        .when(kind == "wifi", F.when(F.col("wifi_open"), 45).otherwise(0))
        .when(kind == "crypto", 55).when(has_target, linked).otherwise(0)
    )
    df = df.withColumn("risk_score", score.cast("int"))
    s = F.col("risk_score")
    nameless = F.exists("_upi_hits", lambda h: h["name"] == "missing_vpa")
    cautious = F.when(ev.verdict_of(s) == "safe", "unknown").otherwise(ev.verdict_of(s))
    verdict = (
        F.when(danger, "dangerous")
        .when(kind == "upi", F.when(nameless, "unknown").otherwise(ev.verdict_of(s)))
        .when(is_url & ~site_known, F.when(s >= 65, "dangerous").otherwise("unknown"))
        .when(is_url, ev.verdict_of(s))
        .when(kind == "wifi", F.when(F.col("wifi_open").isNull(), "unknown").otherwise(cautious))
        .when(kind == "crypto", "suspicious")
        .otherwise(cautious)
    )
    df = settle(df.withColumn("verdict", verdict), ["risk_score", "verdict"])
    v, site_conf = F.col("verdict"), F.col("site_confidence")
    upi_conf = F.when(v == "unknown", 0.40).when(v == "safe", F.least(F.lit(0.80), F.when(s > 0, 0.90).otherwise(0.75))).when(s > 0, 0.90).otherwise(0.75)
    url_conf = F.when(~site_known, F.greatest(F.lit(0.35), site_conf)).when(v == "safe", F.least(F.lit(0.80), site_conf)).otherwise(site_conf)
    other_conf = F.least(F.when(site_known, site_conf).otherwise(0.40), F.when(v == "unknown", 0.45).otherwise(0.85))
    confidence = (
        F.when(danger, 0.95).when(kind == "upi", upi_conf).when(is_url, url_conf)
        .when(kind == "wifi", F.when(F.col("wifi_open").isNull(), 0.40).otherwise(0.70))
        .when(kind == "crypto", 0.75).otherwise(other_conf)
    )
    site_rows = F.transform("site_reasons", lambda r: F.struct(
        r["signal"].alias("signal"), r["detail"].alias("detail"), r["weight"].alias("weight"),
        F.lit(None).cast("string").alias("evidence"),
    ).cast(ev.SIGNAL))
    known = (upi["handle"] != "") & upi["handle"].isin(*dims.UPI_HANDLES)
    upi_rows = F.concat(_bad_rows(F.col("_upi_hits")), compact(
        F.when(known, _row("known_psp_handle", "The payment provider is known.", "good")),
        F.when(upi["amount"].isNull() & ~upi["amount_unreadable"], _row("no_prefilled_amount", "The amount is left to you.", "good")),
        F.when(upi["note"].isNull(), _row("no_note", "There is no note to check.", "good")),
        _row("payee_name_unverified", "The name in a code is chosen by its maker.", "unknown"),
    ))
    wifi_rows = F.array(
        F.when(F.col("wifi_open"), _row("open_wifi", "The network has no password.", "bad", F.col("wifi_ssid")))
        .when(~F.col("wifi_open"), _row("encrypted_wifi", "The network has a password.", "good"))
        .otherwise(_row("wifi_encryption_unknown", "Whether it has a password is not known.", "unknown")),
        _row("wifi_name_unverified", "A network name proves nothing.", "unknown"),
    )
    inside = F.when(has_target, F.concat(
        F.array(F.when(s >= 30, _row("link_in_payload", "Contains a link.", "bad", F.substring("_target", 1, 120)))
                .otherwise(_row("link_in_payload", "Contains a link.", "unknown", F.substring("_target", 1, 120)))),
        _bad_rows(F.col("_url_hits")), site_rows,
    )).otherwise(F.array().cast(f"array<{ev.SIGNAL}>"))
    signals = (
        F.when(danger, F.array(_row("dangerous_scheme", "An instruction, not an address.", "bad")))
        .when(kind == "upi", upi_rows)
        .when(is_url, F.concat(_bad_rows(F.col("_url_hits")), site_rows))
        .when(kind == "wifi", wifi_rows)
        .when(kind == "crypto", F.array(_row("crypto_payment", "Cannot be reversed.", "bad")))
        .otherwise(F.concat(inside, F.array(_row("not_a_destination", "Opens no site and pays nobody.", "unknown"))))
    )
    df = df.withColumn("confidence", F.round(confidence, 2)).withColumn("signals", ev.in_severity_order(signals))
    named = F.transform("signals", lambda x: F.struct(x["signal"].alias("name")))
    df = df.withColumn(
        "recommendation", F.concat_ws(" ", ev.first_advice(named, ACTIONS), pick(ADVICE, F.col("verdict")))
    )
    return df.drop("_target", "_brand", "_named", "_note", "_note_hits", "_upi_hits", "_url_hits")


def payload_site_checks(scored: DataFrame) -> DataFrame:
    """The link results in the form of site checks, ready to union with those of pages."""
    return scored.filter(F.col("domain").isNotNull()).withColumns({
        "verdict": F.col("site_verdict"), "trust_score": F.col("site_trust_score"),
        "reasons": F.col("site_reasons"),
    })
