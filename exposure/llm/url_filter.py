"""URL filter: host and path rules first, then a weighted vocabulary.

Rules are pairs of host and path with a verdict.  A rule fits its host and all subdomains if the
URL's path starts with the rule's path; the longest rule wins.  Where no rule fits, one pass of an
Aho-Corasick automaton over the lower-cased URL finds the terms of the vocabulary; a hit counts
where no letter or digit touches it.  One strict term rejects, and so do ``SOFT_TERMS``
distinct soft terms or soft terms whose weights add up to ``SOFT_WEIGHT``.

Only the URL column is read, in one map stage; the automaton is built once per task from the
vocabulary, which is a parameter of code and small.

The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased; the path goes on to ``?``, ``#`` or the end.  A NULL URL and one without ``://``
have an empty host and path; NULL has no terms and is allowed.  Repeated rows are judged each.
Extra columns are ignored.  No rows give no rows.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
STRICT = ("casino", "escort", "hentai", "linkfarm", "malware", "phishing", "porn", "spam-farm", "viagra", "warez", "xxx")
#: weight of each soft term
SOFT = {
    "adult": 1.0, "bet": 0.7, "bonus": 0.5, "cheap": 0.4, "crack": 0.8, "dating": 0.6, "drugs": 0.8, "free": 0.3, "gambling": 1.0,
    "hot": 0.3, "keygen": 1.0, "loan": 0.5, "nude": 1.0, "pills": 0.8, "poker": 0.8, "replica": 0.6, "seo": 0.4, "sex": 1.0,
    "spam": 0.8, "torrent": 0.7, "win": 0.3,
}
SOFT_TERMS, SOFT_WEIGHT = 3, 1.8


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, NULL if none does."""
    out = None
    for name, start, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        made = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def term_counter(strict=STRICT, soft=SOFT):
    """A column function ``url -> struct<n_strict, n_soft, weight>``: distinct terms with free edges."""
    strict, soft = tuple(strict), dict(soft)

    def count(urls: pd.Series) -> pd.DataFrame:
        tree = ahocorasick.Automaton()
        for term in (*strict, *soft):
            tree.add_word(term, term)
        tree.make_automaton()
        rows = []
        for url in urls:
            text = (url or "").translate(_LOWER)
            seen = set()
            for end, term in tree.iter(text):
                start = end - len(term)
                if (start < 0 or not _letter(text[start])) and (end + 1 == len(text) or not _letter(text[end + 1])):
                    seen.add(term)
            weight = round(sum(soft[t] for t in sorted(seen) if t in soft), 6)
            rows.append((sum(t in strict for t in seen), sum(t in soft for t in seen), weight))
        return pd.DataFrame(rows, columns=["n_strict", "n_soft", "weight"])

    return F.pandas_udf(count, "n_strict long, n_soft long, weight double")


_LOWER = {c: c + 32 for c in range(65, 91)}


def _letter(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT) -> DataFrame:
    """``(page, host, path, rule, verdict, n_strict, n_soft, weight)``, one row per input row."""
    urls = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"))
    counted = urls.select("page", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), term_counter(strict, soft)("url").alias("hits"))
    bad = (F.col("hits.n_strict") > 0) | (F.col("hits.n_soft") >= SOFT_TERMS) | (F.col("hits.weight") >= SOFT_WEIGHT)
    fit = rule_of(F.col("host"), F.col("path"), rules)
    return counted.select(
        "page", "host", "path", fit["rule"].alias("rule"), F.coalesce(fit["verdict"], F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "hits.n_strict", "hits.n_soft", "hits.weight",
    )
