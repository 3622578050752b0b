"""Secret scan with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content.  The ledger holds a row
per blob, rule and rule version that has been scanned, with what was found, also if nothing.
A run scans only pairs of blob and rule version that the ledger lacks, one text per blob,
appends them, and joins the findings back to all paths and versions that hold the blob.

Texts are reduced to one per blob with partial aggregation, so a blob with very many copies sends one
text per map task, is scanned once, and never gathers in one task.  Joining back
is a join on the blob, whose skew Spark splits.  The ledger is a written table.

A NULL text is an empty blob.  Repeated rows are paths of their own with the same findings.
A NULL path stays NULL.  Extra columns are ignored.  No rows give no rows and no ledger rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm.matches import in_order, matches
from exposure.llm.shared import stored

FOUND = "array<struct<start:long,rank:int,end:long,kind:string,value:string>>"
LEDGER = f"blob binary, rule string, version int, found {FOUND}"


@dataclass(frozen=True)
class Rule:
    """A pattern, a cheap test that all its matches pass, and a check of the match."""

    name: str
    pattern: str
    guard: str
    check: str | None = None
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


_ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?+\x20*+[:=]\x20*+[\"']?+"
)
#: fixed values: the first three are the base rules
RULES = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]++", "[:=]", f"^{_ASSIGN}[A-Za-z0-9+/_.=-]{{6,}}$"),
    Rule("access", "AKIA[A-Z0-9]{16,}+", "AKIA"),
    Rule("hex", "[0-9a-f]{24,}+", "[0-9a-f]{24}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "-----BEGIN "),
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36,}+", "gh[opsu]_"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
)
BASE = ("assign", "access", "hex")


def _found(rule: Rule, rank: int, text: Column) -> Column:
    held = matches(text, rule.pattern, text.rlike(rule.guard), near=0)
    if rule.check:
        held = F.filter(held, lambda m: m["value"].rlike(rule.check))
    return F.transform(held, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(rule.name).alias("kind"),
        m["value"].alias("value"),
    )).cast(FOUND)


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text")
    )


def unseen(docs: DataFrame, ledger: DataFrame | None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(blob, todo)``: blobs with rule versions that the ledger lacks."""
    blobs = _versions(docs, id_col, text_col).select("blob").distinct()
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return blobs.select("blob", every.alias("todo"))
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("seen"))
    left = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", left.alias("todo")).filter(F.size("todo") > 0)


def texts_to_scan(docs: DataFrame, ledger: DataFrame | None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(blob, text, todo)``: one text per blob that has something to do, however many rows hold it."""
    texts = _versions(docs, id_col, text_col).select("blob", "text").dropDuplicates(["blob"])
    if ledger is None:  # all is to do: no second look at the texts
        return texts.withColumn("todo", F.array(*[F.lit(r.key) for r in rules]))
    return texts.join(unseen(docs, ledger, rules, id_col, text_col), "blob")


def scan_unseen(docs: DataFrame, ledger: DataFrame | None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows ``(blob, rule, version, found)``."""
    texts = texts_to_scan(docs, ledger, rules, id_col, text_col)
    scans = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"),
            F.when(F.array_contains("todo", F.lit(r.key)), _found(r, rank, F.col("text"))).alias("found"),
        )
        for rank, r in enumerate(rules)
    ])
    # the outer form is not filtered by the size of its array, which would scan twice
    found = F.inline_outer(F.filter(scans, lambda s: s["found"].isNotNull()))
    return texts.select("blob", found).filter("rule IS NOT NULL")


def find_secrets(
    docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``(doc, blob, spans)`` for every row, and the ledger that now covers them (a written table).

    Findings are those of the current version of each rule.
    """
    fresh = scan_unseen(docs, ledger, rules, id_col, text_col)
    book = stored(fresh if ledger is None else ledger.select("blob", "rule", "version", "found").union(fresh))
    current = F.concat_ws("@", "rule", "version").isin([r.key for r in rules])
    spans = book.filter(current & (F.size("found") > 0)).groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("spans"))
    paths = _versions(docs, id_col, text_col).select("doc", "blob")
    none = F.array().cast(FOUND)
    return paths.join(spans, "blob", "left").select("doc", "blob", in_order(F.coalesce("spans", none)).alias("spans")), book
