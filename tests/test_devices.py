import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from exposure.operators import dashboard, day_sums, identity, narrative, risk
from exposure.plans.queries import QUERIES
from exposure.sources import corpora, tables
from exposure.streaming import streams

NOW = dt.datetime(2024, 2, 5, 12)
AT = F.lit("2024-02-05 12:00:00").cast("timestamp")
EVENT = "id long, device_id string, occurred_at timestamp, site_origin string, risk_level string, action_taken string, confidence double"
CHECK = "id long, device_id string, occurred_at timestamp, domain string, verdict string"
IDENT = "id long, device_id string, occurred_at timestamp, hash_prefix string, label string, breach_count long"


def ago(days, **kw):
    return NOW - dt.timedelta(days=days, **kw)


def frames(spark, events=(), checks=(), idents=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return make(events, EVENT), make(checks, CHECK), make(idents, IDENT)


def scored(spark, **kw):
    return risk.add_scores(risk.device_totals(*frames(spark, **kw), AT))


def sample(rng, n=60):
    ev = [(i, f"d{rng.randrange(4)}", ago(rng.uniform(-1, 35)), f"https://s{rng.randrange(5)}.example", rng.choice(["low", "high", "critical", "odd"]), rng.choice(["none", "masked", "ignored", "allowlisted"]), rng.choice([0.5, 0.9])) for i in range(n)]
    ch = [(i, f"d{rng.randrange(4)}", ago(rng.uniform(0, 35)), f"x{rng.randrange(6)}.example", rng.choice(["dangerous", "suspicious", "unknown", "safe"])) for i in range(n)]
    ids = [(i, f"d{rng.randrange(3)}", ago(rng.uniform(0, 90)), "ABCDE", rng.choice(["mail", "Mail ", "bank", None]), rng.choice([0, 5, 2000])) for i in range(n // 3)]
    return dict(events=ev, checks=ch, idents=ids)


def test_decay_window_and_future(spark):
    rows = [(0, "fresh", ago(0), "a", "critical", "none", 1.0), (1, "week", ago(7), "a", "critical", "none", 1.0),
            (2, "future", ago(-3), "a", "critical", "none", 1.0), (3, "edge", ago(30), "a", "critical", "none", 1.0),
            (4, "past", ago(30, seconds=1), "a", "critical", "none", 1.0)]
    got = {r.device_id: r for r in scored(spark, events=rows).collect()}
    assert got["fresh"].privacy == got["future"].privacy == 60 and got["week"].privacy == 75
    assert got["edge"].e_n == 1 and got["past"].e_n == 0 and got["past"].privacy == 100
    assert all(r.identity is None and r.confidence == 0.8 for r in got.values())


def test_row_order_does_not_matter(spark):
    data = sample(random.Random(6))
    once = sorted(map(tuple, scored(spark, **data).select("device_id", "overall", "privacy", "browsing", "identity").collect()))
    for rows in data.values():
        random.Random(7).shuffle(rows)
    assert once == sorted(map(tuple, scored(spark, **data).select("device_id", "overall", "privacy", "browsing", "identity").collect()))


def test_points_add_up(spark):
    s = scored(spark, **sample(random.Random(8)))
    sums = s.join(risk.contributions(s).groupBy("device_id").agg(F.sum("points").alias("p")), "device_id")
    assert all(int(r.p + 0.5 + 1e-9) == r.overall for r in sums.collect())


def test_lever_equals_a_real_rescore(spark):
    data = sample(random.Random(9))
    s = scored(spark, **data)
    live = identity.live_checks(frames(spark, **data)[2])
    told = narrative.levers(narrative.narrative(s, live)).collect()
    assert told
    for r in told:
        if r.code is None:
            continue
        cut = {k: [x for x in v if x[1] == r.device_id] for k, v in data.items()}
        if r.code == "pii_sent_unprotected":
            cut["events"] = [x for x in cut["events"] if x[5] in ("masked", "allowlisted") or x[4] not in ("high", "critical")]
        elif r.code == "pii_minor_unprotected":
            cut["events"] = [x for x in cut["events"] if x[5] in ("masked", "allowlisted") or x[4] in ("high", "critical")]
        elif r.code.startswith("site_"):
            rank = {"dangerous": 3, "suspicious": 2, "unknown": 1, "safe": 0}
            worst = {}
            for x in cut["checks"]:
                if x[2] >= ago(30):
                    worst[x[3]] = max(worst.get(x[3], 0), rank[x[4]])
            target = rank[r.code.split("_")[1]]
            cut["checks"] = [x for x in cut["checks"] if worst.get(x[3]) != target]
        else:
            continue
        again = {x.device_id: x.overall for x in scored(spark, **cut).collect()}
        assert again.get(r.device_id, 100) == r.projected_score, r


def test_newest_password_check_wins(spark):
    ids = [(1, "d", ago(5), "AAAAA", "Mail", 9000), (2, "d", ago(1), "BBBBB", " mail ", 0), (3, "d", ago(80), "CCCCC", None, 5)]
    live = identity.live_checks(frames(spark, idents=ids)[2])
    got = {r.key: r.breach_count for r in live.collect()}
    assert got == {"label:mail": 0, "prefix:CCCCC": 5}
    assert identity.identity_totals(live).first().i_penalty == 45.0


def test_ranges_drop_padding_and_junk(spark):
    s = "A" * 35
    lines = spark.createDataFrame([("abcde", f"{s}:7"), ("abcde", "B" * 35 + ":0"), ("abcde", "short:9"), ("abcde", "C" * 35 + ":x"), ("abcde", "d" * 35 + ": 12 ")], "prefix string, line string")
    corpus = corpora.parse_ranges(lines)
    assert sorted((r.prefix, r["count"]) for r in corpus.collect()) == [("ABCDE", 7), ("ABCDE", 12)]
    checks = spark.createDataFrame([(1, "abcde", 7), (2, "ABCDE", 8), (3, "00000", 7), (4, "ABCDE", 0)], "id long, hash_prefix string, breach_count long")
    got = {r.id: r.verified for r in identity.plausible(checks, corpus).collect()}
    assert got == {1: True, 2: False, 3: None, 4: None}


def greedy(times, gap):
    kept, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= gap:
            kept.append(t)
            last = t
    return kept


def test_thinning_equals_plain_greedy(spark):
    rng, rows, want = random.Random(10), [], {}
    for d in range(4):
        times = [NOW + dt.timedelta(seconds=rng.randrange(0, 4 * 86400, 1 if d else 7)) for _ in range(1500 if d == 0 else 200)]
        rows += [(f"d{d}", t) for t in times]
        want[f"d{d}"] = greedy(times, dt.timedelta(minutes=5))
    df = spark.createDataFrame(rows, "device_id string, captured_at timestamp")
    got = {}
    for r in dashboard.thin_snapshots(df).collect():
        got.setdefault(r.device_id, []).append(r.captured_at)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_thinning_of_chains_that_never_meet(spark):
    """Equal steps that do not divide the gap keep every chain apart; gaps of days leave slices empty."""
    steady = [NOW + dt.timedelta(seconds=37 * i) for i in range(1500)]
    apart = [NOW + dt.timedelta(days=i // 3, seconds=299 * (i % 3)) for i in range(60)]
    old = [dt.datetime(1969, 12, 31) + dt.timedelta(seconds=i) for i in range(900)]
    rows = [(d, t) for d, times in (("s", steady), ("a", apart), ("o", old), ("one", [NOW])) for t in times]
    df = spark.createDataFrame(rows, "device_id string, captured_at timestamp")
    got = {}
    for r in dashboard.thin_snapshots(df).collect():
        got.setdefault(r.device_id, []).append(r.captured_at)
    want = {d: greedy([t for e, t in rows if e == d], dt.timedelta(minutes=5)) for d in ("s", "a", "o", "one")}
    assert {d: sorted(t) for d, t in got.items()} == want


def test_thinning_stays_in_spark_and_splits_devices(spark):
    """No Python stage; rows of one device are dealt by slice; rows without device or time go, others keep their columns."""
    rows = [("d", NOW + dt.timedelta(seconds=i), i) for i in range(2000)] + [("d", NOW, 9), (None, NOW, 1), ("e", None, 2)]
    df = spark.createDataFrame(rows, "device_id string, captured_at timestamp, _slice int")
    out = dashboard.thin_snapshots(df)
    assert out.columns == df.columns
    assert sorted(r._slice for r in out.collect()) == [0, 300, 600, 900, 1200, 1500, 1800]
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert dashboard.thin_snapshots(df.limit(0)).count() == 0


def run_stream(spark, tmp_path, parts, schema, make, name=""):
    src = str(tmp_path / f"in{name}")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c{name}"))
         .trigger(availableNow=True).start(str(tmp_path / f"o{name}")))
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / f"o{name}"))


@pytest.fixture
def timers(spark):
    name, provider = streams.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    yield
    spark.conf.set(name, before)


SNAPS = "device_id string, captured_at timestamp"


def test_stream_state_spans_batches(spark, tmp_path, timers):
    parts = [[("d", NOW + dt.timedelta(minutes=m)) for m in span] for span in ((0, 2, 4), (6, 8), (9, 12, 30), (600,))]
    out = run_stream(spark, tmp_path, parts, SNAPS, streams.thin_snapshots)
    got = sorted((r.captured_at - NOW).total_seconds() / 60 for r in out.collect())
    assert got == [0, 6, 12, 30]


def test_late_rows_are_judged_in_order(spark, tmp_path, timers):
    """Shuffled micro-batches give what one batch gives, if no row is later than the bound."""
    rng = random.Random(3)
    times = {d: [NOW + dt.timedelta(seconds=rng.randrange(5400), microseconds=rng.randrange(10**6)) for _ in range(60)] for d in "ab"}
    rows = sorted((t, d) for d, held in times.items() for t in held)
    # a row falls back by less than the ten minutes that the watermark waits
    shuffled = sorted(rows, key=lambda r: r[0] + dt.timedelta(seconds=rng.randrange(590)))
    cut = [shuffled[i:i + 24] for i in range(0, len(shuffled), 24)]
    end = [[(NOW + dt.timedelta(days=2), "end")], [(NOW + dt.timedelta(days=3), "end")]]
    named = [[(d, t) for t, d in part] for part in cut + end]
    got = {}
    for r in run_stream(spark, tmp_path, named, SNAPS, streams.thin_snapshots).filter("device_id <> 'end'").collect():
        got.setdefault(r.device_id, []).append(r.captured_at)
    assert {k: sorted(v) for k, v in got.items()} == {d: greedy(held, dt.timedelta(minutes=5)) for d, held in times.items()}
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "c"))
    assert {r.key.key for r in state.select("key").collect()} <= {"end"}  # silent keys leave no state
    whole = [[(d, t) for t, d in rows], *named[-2:]]
    one = run_stream(spark, tmp_path, whole, SNAPS, streams.thin_snapshots, "one").filter("device_id <> 'end'")
    assert sorted(tuple(r) for r in one.collect()) == sorted((d, t) for d, held in got.items() for t in held)


def test_rows_beyond_the_bound_are_too_late(spark, tmp_path, timers):
    day = [[("d", NOW + dt.timedelta(minutes=m)) for m in span] for span in ((100,), (300, 5), (50, 301), (900,))]
    day[0].append((None, NOW))
    out = run_stream(spark, tmp_path, day, SNAPS, streams.thin_snapshots)
    got = sorted((r.captured_at - NOW).total_seconds() / 60 for r in out.filter("device_id = 'd'").collect())
    assert got == [100, 300]  # 5 and 50 came after the watermark had passed them


def test_stream_debounce_keeps_last_state(spark, tmp_path):
    ms = lambda k: NOW + dt.timedelta(milliseconds=k)
    rows = [("d", "f", ms(0), "a"), ("d", "f", ms(100), "ab"), ("d", "f", ms(900), "abc"), ("d", "f", ms(60000), "z")]
    out = run_stream(spark, tmp_path, [rows], "device_id string, field_id string, ts timestamp, text string", streams.debounce)
    assert sorted(r.text for r in out.collect()) == ["ab", "abc"]


TYPED = "device_id string, field_id string, field_type string, site_origin string, ts timestamp, text string"


def typing(*rows):
    return [("d", field, kind, "https://a.example", NOW + dt.timedelta(milliseconds=at), text) for at, field, kind, text in rows]


def test_typed_fields_rest_pass_the_gate_and_are_scanned(spark, tmp_path, timers):
    parts = [
        typing((0, "f", "text", "a"), (100, "f", "text", "x@mail.example"), (0, "g", "password", "4111 1111 1111 1111"), (0, "h", "text", " hi  ")),
        typing((5000, "f", "text", "x@mail.example"), (9000, "f", "text", "y@mail.example"), (4700, "f", "text", "x@mail")),  # one late
        typing((60_000, "f", "text", "four"), (61_000, "f", "text", "y@mail.example"), (60_000, "h", "text", None)),
        typing((10_000_000, "f", "text", "y@mail.example")), typing((90_000_000, "z", "text", "far ahead")), typing((99_000_000, "z", "text", "")),
    ]
    out = run_stream(spark, tmp_path, parts, TYPED, streams.typed_findings).filter("field_id <> 'z'")
    at = lambda r: round((r.occurred_at - NOW).total_seconds() * 1000)
    got = sorted((r.field_id, at(r), r.scanned, [f.v if "v" in f else f.pii_type for f in r.findings]) for r in out.collect())
    # 4700 is rested by 5000 and differs; 5000 holds another text again; 61000 repeats 9000 but for "four" between them
    assert [(f, t, s) for f, t, s, _ in got] == [
        ("f", 100, True), ("f", 4700, True), ("f", 5000, True), ("f", 9000, True), ("f", 60_000, False), ("f", 61_000, True),
        ("f", 10_000_000, True), ("h", 0, False),  # an hour later the same text counts again; NULL and blanks are one text
        ("h", 60_000, False),
    ]
    assert [bool(x) for *_, x in got] == [True, False, True, True, False, True, True, False, False]
    one = run_stream(spark, tmp_path, [sum(parts[:4], []), *parts[4:]], TYPED, streams.typed_findings, "one").filter("field_id <> 'z'")
    assert sorted((r.field_id, at(r)) for r in one.collect()) == [(f, t) for f, t, *_ in got]
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "c"))
    assert "f" not in {r.key.field_id for r in state.select("key").collect()}  # a silent field leaves no state


def test_day_sums_live_in_the_state_store(spark, tmp_path):
    """Read from the state, whatever the number of batches; the score is that of the batch job."""
    rng = random.Random(8)
    rows = [(i, f"d{i % 3}", NOW.replace(hour=0) - dt.timedelta(days=rng.uniform(0, 29)), "a", rng.choice(["low", "high"]), "none", 0.5) for i in range(90)]
    parts = [rows[i::6] for i in range(6)]
    run_stream(spark, tmp_path, parts, EVENT, streams.daily_penalties)
    days = streams.days_in_state(spark, str(tmp_path / "c"))
    assert days.agg({"events": "sum"}).first()[0] == 90
    assert days.groupBy("device_id", "day_end").count().filter("count > 1").isEmpty()
    now = F.lit(str(NOW.replace(hour=0))).cast("timestamp")
    got = {r.device_id: r.privacy for r in streams.score_from_days(days, now).collect()}
    e, c, i = frames(spark, events=rows)
    assert got == {r.device_id: r.privacy for r in risk.risk_scores(e, c, i, now).collect()}


def test_day_sums_give_the_full_scores_and_read_changed_days_only(spark, tmp_path):
    rng = random.Random(9)
    data = sample(rng, 150)
    midnight = NOW.replace(hour=0)
    data["events"] += [(900, "d1", midnight - dt.timedelta(days=30), "a", "critical", "none", 1.0), (901, "d2", midnight, "a", "high", "none", 1.0)]
    data["checks"] += [(900, "d1", midnight - dt.timedelta(days=30), "edge.example", "dangerous"), (901, "gone", ago(200), "x.example", "dangerous")]
    e, c, i = frames(spark, events=data["events"], checks=data["checks"])
    paths, base = {k: str(tmp_path / k) for k in day_sums.KINDS}, str(tmp_path / "sums")
    day_sums.start(spark, base)
    times = [F.lit(str(t)).cast("timestamp") for t in (NOW, midnight, NOW - dt.timedelta(days=2))]

    def add(events, checks):
        tables.append_rows(events, paths["pii"], tables.PII_EVENTS, spread=2)
        tables.append_rows(checks, paths["site"], tables.SITE_CHECKS, spread=2)
        return day_sums.refresh(spark, base, paths)

    def same(e, c):
        for now in times:
            got = {r.device_id: (r.privacy, r.browsing) for r in day_sums.scores(spark, base, paths, now).collect()}
            assert got == {r.device_id: (r.privacy, r.browsing) for r in risk.risk_scores(e, c, i, now).collect()}
        as_rows = lambda df: sorted((r.device_id, r.captured_at, r.privacy, r.browsing, r.overall) for r in df.collect())
        assert as_rows(day_sums.replay_daily(spark, base, midnight.date())) == as_rows(risk.replay_daily(e, c, times[1]))

    first = add(e, c)
    assert len(first["pii"]) == len({r[2].date() for r in data["events"]})
    same(e, c)
    assert day_sums.refresh(spark, base, paths) == {"pii": [], "site": []}
    more_e, more_c, _ = frames(spark, events=[(950, "d0", ago(3), "a", "critical", "none", 1.0)], checks=[(950, "new", ago(5), "y.example", "suspicious")])
    assert add(more_e, more_c) == {"pii": [ago(3).date()], "site": [ago(5).date()]}
    same(e.union(more_e), c.union(more_c))


def test_cards(spark):
    files = spark.createDataFrame([("/x/my_card.md", "---\nid: k1\ntitle: T\ntags: [a, b]\nsummary: S\n---\nBody\n\nmore\n"), ("/x/bare_file.md", "just text")], "path string, text string")
    got = [tuple(r) for r in corpora.parse_cards(files).collect()]
    assert got == [("k1", "T", ["a", "b"], "S", "Body\n\nmore"), ("bare_file", "Bare File", [], "Bare File", "just text")]


def test_replay_on_window_edges(spark):
    ev = [(0, "d", ago(3), "a", "critical", "none", 1.0), (1, "d", ago(33), "a", "critical", "none", 1.0), (2, "d", ago(2.5), "a", "high", "none", 1.0)]
    ch = [(0, "d", ago(10), "x", "suspicious"), (1, "d", ago(4), "x", "dangerous"), (2, "d", ago(1), "x", "unknown")]
    e, c, _ = frames(spark, events=ev, checks=ch)
    got = {r.captured_at: r for r in risk.replay_daily(e, c, AT).collect()}
    for d in range(31):
        at = ago(d)
        p = sum({"critical": 100, "high": 60}[x[4]] * 0.5 ** ((at - x[2]).total_seconds() / 86400 / 7) for x in ev if at - dt.timedelta(days=30) <= x[2] <= at)
        seen = [({"dangerous": 100, "suspicious": 30, "unknown": 5}[x[4]], x[2]) for x in ch if at - dt.timedelta(days=30) <= x[2] <= at]
        b = max(seen)[0] * 0.5 ** ((at - max(seen)[1]).total_seconds() / 86400 / 7) if seen else 0
        curve = lambda x: 100 if x <= 0 else int(100 * 150 / (150 + x) + 0.5)
        assert (got[at].privacy, got[at].browsing) == (curve(p), curve(b)), d


def test_bucketed_corpus_stays_where_it_is(spark, tmp_path):
    """Range files become buckets; joins on prefix and suffix shuffle the secrets alone."""
    import hashlib

    digests = [hashlib.sha1(f"pw{i}".encode()).hexdigest().upper() for i in range(60)]
    for h in digests:
        with open(tmp_path / f"{h[:5]}.txt", "a") as f:
            f.write(f"{h[5:]}:{int(h[5], 16)}\n{'B' * 35}:0\n")
    read = corpora.read_breach_corpus(spark, str(tmp_path))
    name = "corpus_in_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    corpora.write_breach_corpus(read, name, buckets=8)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        secrets = spark.createDataFrame([(i, f"pw{i}") for i in range(120)], "id int, secret string")
        matched = identity.match_own(secrets, corpora.read_buckets(spark, name), in_place=True)
        got = {r.id: r.breach_count for r in matched.collect()}
        plan = matched._jdf.queryExecution().executedPlan().toString()
        ranges = identity.range_lookup(secrets.selectExpr("substr(sha1(secret), 1, 5) AS hash_prefix"), corpora.read_buckets(spark, name))
        assert ranges.count() == sum(int(h[5], 16) > 0 for h in digests)
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql(f"DROP TABLE {name}")
    held = {h[:5] for h in digests if int(h[5], 16)}
    want = {}
    for i in range(120):
        h = hashlib.sha1(f"pw{i}".encode()).hexdigest().upper()
        want[i] = (int(h[5], 16) if i < 60 else 0) if h[:5] in held else None
    assert got == want
    # from every scan of the corpus up to its join there is no exchange
    final = plan.split("== Initial Plan ==")[0].splitlines()
    place = [len(x) - len(x.lstrip(" :+-*0123456789()")) for x in final]
    scans = [i for i, x in enumerate(final) if "FileScan parquet" in x and name in x]
    assert len(scans) == 2
    for at in scans:
        depth = place[at]
        for i in range(at - 1, -1, -1):
            if place[i] < depth:
                depth = place[i]
                if "Join" in final[i]:
                    break
                assert "Exchange" not in final[i], plan


@pytest.mark.parametrize("folder", [False, True])
def test_streamed_findings_of_a_file_or_a_folder(spark, tmp_path, folder):
    rows = [(i, "en", "src1", f"write to user{i}@example.com", 20) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet")) if folder else docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    docs.toPandas().to_parquet(tmp_path / "other.parquet")
    found = QUERIES["stream_findings"](spark, str(tmp_path)).filter("pii_type = 'email'").collect()
    assert sum(r.n for r in found) == 43  # three texts get a second address appended
