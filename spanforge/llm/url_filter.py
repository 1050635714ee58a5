"""URL filter: host and path rules first, then a weighted vocabulary.

One Aho-Corasick automaton holds strict and soft terms.  A hit counts only if
no ASCII letter or digit touches it.  One strict hit, or ``min_soft`` different
soft hits, reject the url.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is judged by the vocabulary (a null url has no hits and is
allowed).  Repeated rows are judged alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read

#: own vocabulary, lower case ASCII
STRICT = ["casino", "escort", "hentai", "hookup", "milf", "nude", "porn", "porno", "viagra", "warez", "xxx"]
SOFT = ["adult", "ads", "bet", "bonus", "cam", "cheap", "click", "coupon", "crack", "dating", "deals", "download", "farm", "free", "gambling", "keygen", "loan", "pills", "poker", "promo", "replica", "sex", "slots", "spam", "torrent", "win"]
#: host, path, verdict
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def vocabulary_hits(strict: Sequence[str], soft: Sequence[str]):
    """Column function: number of different strict and soft terms in a url, with boundary checks."""
    terms = [(t, 0) for t in strict] + [(t, 1) for t in soft]

    @F.pandas_udf("strict int, soft int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t, kind in terms:
            automaton.add_word(t, (t, kind))
        automaton.make_automaton()
        word = set("abcdefghijklmnopqrstuvwxyz0123456789")
        upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        for urls in batches:
            out = []
            for u in urls:
                found = (set(), set())
                if u:
                    u = u.translate(upper)
                    for end, (t, kind) in automaton.iter(u):
                        at = end - len(t)
                        if (at < 0 or u[at] not in word) and (end + 1 == len(u) or u[end + 1] not in word):
                            found[kind].add(t)
                out.append((len(found[0]), len(found[1])))
            yield pd.DataFrame(out, columns=["strict", "soft"]).astype("int32")

    return hits


def judge_urls(df: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = tuple(RULES), strict: Sequence[str] = tuple(STRICT), soft: Sequence[str] = tuple(SOFT), min_soft: int = 2) -> DataFrame:
    """Rows with ``host, path, rule, verdict, n_strict, n_soft`` appended to a struct ``row`` of the input columns."""
    if rules and min(len(r) for r in rules) != 3:
        raise ValueError("a rule is (host, path, verdict)")
    base = df.select(F.struct("*").alias("row"), F.col(url).cast("string").alias("_url"))
    host, path = url_parts(F.col("_url"))
    base = base.select("row", host.alias("host"), path.alias("path"), vocabulary_hits(strict, soft)(F.col("_url")).alias("_hits"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("_hits.strict") >= 1) | (F.col("_hits.soft") >= min_soft), "block").otherwise("allow")
    return base.select("row", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("_hits.strict").alias("n_strict"), F.col("_hits.soft").alias("n_soft"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _term_sql(t: str) -> str:
    return f"cast(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') as int)"


def _rule_sql(value: int) -> str:
    whens = " ".join(
        f"when (host = '{r[0]}' or ends_with(host, '.{r[0]}')) and starts_with(path, '{r[1]}') then '{(r[0] + r[1], r[2])[value]}'" for r in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    )
    return f"case {whens} end"


SQL = f"""
with a as (select page_id, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as u,
  case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
b as (select page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select *, {' + '.join(map(_term_sql, STRICT))} as n_strict, {' + '.join(map(_term_sql, SOFT))} as n_soft,
  {_rule_sql(0)} as rule, {_rule_sql(1)} as ruled from b)
select page_id, host, path, rule, coalesce(ruled, case when n_strict >= 1 or n_soft >= 2 then 'block' else 'allow' end) as verdict, n_strict, n_soft from c"""
