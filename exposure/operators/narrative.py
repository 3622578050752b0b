"""Why the score is what it is: causes, what each costs, and the one change to make first.

A cause owns an additive share of a penalty, so the score without it is the curve of
``total - share``; nothing is re-run.  A device has at most seven causes that are not
passwords and one per breached password.  All of them are the rows of :func:`cause_rows`;
the drivers have four slots, and as passwords of equal penalty cost the same, the first
four of each band are enough for these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.functions.basics import compact, first, half_even, plural, settle
from exposure.operators import identity as ident
from exposure.operators.risk import curve, overall

SLOTS = 4
SEVERITY = {"high": 0, "medium": 1, "low": 2, "info": 3}
CAUSE = (
    "struct<worse:int,sev:int,code:string,ord:bigint,points:int,severity:string,subjects:bigint,"
    "sentence:string,must:boolean,lever:boolean,action:string,todo:string>"
)


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _number(n: Column) -> Column:
    return n.cast("string")


def breached_causes(live: DataFrame) -> DataFrame:
    """Per device an array of at most 16 breached passwords: four of each penalty band."""
    order = Window.partitionBy("device_id", "penalty").orderBy("first_seen", "key")
    return (
        live.filter(F.col("breach_count") > 0)
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= SLOTS)
        .groupBy("device_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("first_seen", "key", "penalty", "breach_count", "label"))
            ).alias("breached")
        )
    )


def _short(label: Column) -> Column:
    clean = F.trim(F.coalesce(label, F.lit("")))
    return (
        F.when(clean == "", "One of your passwords")
        .when(F.length(clean) > 40, F.concat(F.substring(clean, 1, 39), F.lit("…")))
        .otherwise(clean)
    )


def _cause(code, severity, n, sentence, without, ord_, *, must=False, action=None, todo=None) -> Column:
    cost = F.greatest(F.lit(0), without - F.col("overall")).cast("int")
    return F.struct(
        (-F.coalesce(cost, F.lit(0))).alias("worse"),
        F.lit(SEVERITY[severity]).alias("sev"),
        F.lit(code).alias("code"),
        (ord_ if isinstance(ord_, Column) else F.lit(ord_)).cast("bigint").alias("ord"),
        cost.alias("points"),
        F.lit(severity).alias("severity"),
        n.cast("bigint").alias("subjects"),
        sentence.alias("sentence"),
        F.lit(must).alias("must"),
        F.lit(action is not None).alias("lever"),
        F.lit(action).cast("string").alias("action"),
        (todo if todo is not None else F.lit(None)).cast("string").alias("todo"),
    ).cast(CAUSE)


def _fixed_causes() -> Column:
    """The causes about typed data, sites and missing checks."""
    p, b, i = F.col("privacy"), F.col("browsing"), F.col("identity")

    def no_pii(share: str) -> Column:
        return overall(curve(F.col("e_p") - F.col(share)), b, i)

    def no_site(share: str) -> Column:
        return overall(p, curve(F.col("s_p") - F.col(share)), i)

    severe, minor, kept = F.col("e_n_severe"), F.col("e_n_minor"), F.col("e_n_resolved")
    bad, odd, blank = (F.col(f"s_n_{v}") for v in ("dangerous", "suspicious", "unknown"))
    extra = F.col("e_severe_hosts") - 1
    where = _say(
        F.col("e_severe_first"),
        F.when(extra > 0, _say(" and ", _number(extra), plural(extra, " other site", " other sites"))).otherwise(""),
    )
    return compact(
        F.when(severe > 0, _cause(
            "pii_sent_unprotected", "high", severe,
            _say(_number(severe), plural(severe, " sensitive detail", " sensitive details"), " left unmasked on ", where, "."),
            no_pii("e_p_severe"), 0, action="review_pii", todo=F.lit("Mask sensitive details before sending."),
        )),
        F.when(minor > 0, _cause(
            "pii_minor_unprotected", "medium", minor,
            _say(_number(minor), plural(minor, " lesser detail", " lesser details"), " went out unmasked."),
            no_pii("e_p_minor"), 1, action="review_pii", todo=F.lit("Mask everyday details as well."),
        )),
        F.when(kept > 0, _cause(
            "pii_protected", "low", kept,
            _say(_number(kept), plural(kept, " detail was", " details were"), " masked or muted in time."),
            no_pii("e_p_resolved"), 2,
        )),
        F.when(bad > 0, _cause(
            "site_dangerous", "high", bad,
            _say(_number(bad), plural(bad, " site", " sites"), " looked like a scam, such as ", F.col("s_first_dangerous"), "."),
            no_site("s_p_dangerous"), 3, action="review_sites",
            todo=_say("Stay away from ", F.col("s_first_dangerous"), "."),
        )),
        F.when(odd > 0, _cause(
            "site_suspicious", "medium", odd,
            _say(_number(odd), plural(odd, " site", " sites"), " seemed off, such as ", F.col("s_first_suspicious"), "."),
            no_site("s_p_suspicious"), 4, action="review_sites",
            todo=_say("Check the address of ", F.col("s_first_suspicious"), " before using it."),
        )),
        F.when(blank > 0, _cause(
            "site_unchecked", "low", blank,
            _say(_number(blank), plural(blank, " site", " sites"), " could not be checked."),
            no_site("s_p_unknown"), 5,
        )),
        F.when(i.isNull(), _cause(
            "identity_unmeasured", "info", F.lit(0),
            F.lit("No password has been checked; that part is missing, not safe."),
            F.col("overall"), 6, must=True,
        )),
    )


def _password_cause(x: Column, at: Column) -> Column:
    """The cause that a breached password ``x`` is; ``at`` orders equal ones."""
    name = _short(x["label"])
    rest = overall(F.col("privacy"), F.col("browsing"), curve(F.col("i_penalty") - x["penalty"]))
    return _cause(
        "identity_breached", "high", F.lit(1),
        _say(name, " is in ", F.format_number(x["breach_count"], 0), " breached accounts."),
        rest, at + 10, action="change_password", todo=_say("Change the password of ", name, "."),
    )


def causes(scored: DataFrame) -> DataFrame:
    """Add ``causes``, dearest first: those that can be among the drivers."""
    passwords = F.coalesce(
        F.transform("breached", _password_cause), F.array().cast(f"array<{CAUSE}>")
    )
    return settle(scored.withColumn("causes", F.array_sort(F.concat(_fixed_causes(), passwords))), ["causes"])


def cause_rows(scored: DataFrame, live: DataFrame) -> DataFrame:
    """All causes of each device, one row each: every breached password is one, however many there are.

    ``key`` names the password and is NULL in other rows.  Passwords are joined as rows, never gathered per device.
    """
    fixed = scored.select("device_id", F.lit(None).cast("string").alias("key"), F.explode(_fixed_causes()).alias("c"))
    breached = live.filter(F.col("breach_count") > 0).select(
        "device_id", "key", F.struct("label", "penalty", "breach_count").alias("x")
    )
    own = breached.join(scored, "device_id").select("device_id", "key", _password_cause(F.col("x"), F.lit(0)).alias("c"))
    return fixed.unionByName(own).select(
        "device_id", "key", "c.code", "c.points", "c.severity", "c.subjects", "c.sentence", "c.action", "c.todo"
    )


def narrative(
    scored: DataFrame, live: DataFrame
) -> DataFrame:
    """Add drivers (at most four), the lever, the coverage line and the headline."""
    df = causes(scored.join(breached_causes(live), "device_id", "left"))
    shown = F.filter(
        "causes", lambda c: c["must"] | c["points"].isNull() | (c["points"] >= 1)
    )
    must = F.slice(F.filter(shown, lambda c: c["must"]), 1, SLOTS)
    optional = F.filter(shown, lambda c: ~c["must"])
    chosen = F.array_sort(F.concat(F.slice(optional, F.lit(1), F.lit(SLOTS) - F.size(must)), must))
    best = first(F.filter("causes", lambda c: c["lever"] & (c["points"] >= 1)))
    df = settle(df.withColumn("drivers", chosen).withColumn("best", best), ["drivers", "best"])
    blank = F.col("s_n_unknown")
    missing = F.when(
        F.col("confidence") >= 0.999, "The score covers typing, sites and passwords."
    ).otherwise(
        _say("The score covers ", half_even(F.col("confidence") * 100).cast("string"),
             "% of what is measured; the rest is unknown, not safe.")
    )
    unlooked = F.when(
        blank > 0, _say(" ", _number(blank), plural(blank, " site", " sites"), " stay unknown.")
    ).otherwise("")
    priced = F.filter("drivers", lambda c: c["points"] > 0)
    top = first(priced)["points"]
    total = F.aggregate(priced, F.lit(0), lambda a, c: a + c["points"])
    shape = (
        F.when((F.size(priced) == 0) & (F.size("drivers") > 0), " and only missing parts keep it open.")
        .when(F.size(priced) == 0, " and nothing pulls it down.")
        .when(F.size(priced) == 1, "; one thing pulls it down.")
        .when(top >= total - top, "; mostly one thing pulls it down.")
        .otherwise(_say("; ", F.size(priced).cast("string"), " things pull it down together."))
    )
    return (
        df.withColumn("coverage", F.concat(missing, unlooked))
        .withColumn("story", _say("Score ", F.col("overall").cast("string"), " of 100", shape))
    )


def drivers(told: DataFrame) -> DataFrame:
    return told.select("device_id", F.posexplode("drivers").alias("rank", "d")).select(
        "device_id", "rank", "d.code", "d.points", "d.severity", "d.subjects", "d.sentence"
    )


def levers(told: DataFrame) -> DataFrame:
    """Best change per device; a device with nothing worth doing has NULLs, not filler."""
    b = F.col("best")
    projected = F.col("overall") + b["points"]
    return told.select(
        "device_id",
        b["code"].alias("code"),
        F.col("overall").alias("current_score"),
        projected.alias("projected_score"),
        b["points"].alias("delta"),
        b["action"].alias("action"),
        _say(b["todo"], " Score then: ", projected.cast("string"), ".").alias("sentence"),
        "coverage",
        "story",
    )
