"""URL filters: pattern rules indexed by their rarest literal token.

Method: every rule is a regular expression with the literal tokens that each of its matches holds. Tokens are derived from
the expressions. They are counted over all URLs, and each rule is filed under the rarest of its own, the first of equally rare ones. A URL's tokens fetch the
rules filed under them, and only those run their expressions. Rules without a token are tried on every URL. All of
it is DataFrame operations; the rules are a broadcast table whose size is checked.

Defined results: a null URL, or one without `://`, has an empty host and path and the default verdict; repeated
rows are judged alike; other columns are kept unless they are named like a result, which replaces them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import free_name, kept_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many bytes of expressions are broadcast; beyond that they are joined by shuffle.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class UrlRule:
    """Matched against host + path. A listed rule names a domain and the beginning of a path; the longest such rule
    wins. The others are patterns; block goes before allow among them, and they decide where no listed rule fits."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool


def mandatory_tokens(regex: str) -> tuple[str, ...]:
    """Literal tokens (a-z, 0-9) that stand whole in each target that the expression matches: runs of literal letters
    and digits that nothing of their kind can touch on either side."""
    parsed = [*sre_parse.parse(regex)]
    found, k = [], 0
    while k < len(parsed):
        end = k
        while end < len(parsed) and parsed[end][0] is sre.LITERAL and _plain(parsed[end][1]):
            end += 1
        if end > k and _apart(parsed[:k][::-1], -1) and _apart(parsed[end:], 0):
            found.append("".join(chr(c).lower() for _, c in parsed[k:end]))
        k = max(end, k + 1)
    return tuple(dict.fromkeys(found))


def _plain(char: int) -> bool:
    return char < 128 and chr(char).isalnum()


def _apart(elements: list, side: int) -> bool:
    """Does what matches these elements, read from a token outwards, begin with an end of the target or a sign? side
    is which element of a group is nearest: 0 the first, -1 the last."""
    if not elements:
        return False  # anything may stand there
    (op, arg), rest = elements[0], elements[1:]
    inner = lambda x: _apart([*x][:: 1 if side == 0 else -1], side)
    if op is sre.AT:
        return True
    if op is sre.LITERAL:
        return not _plain(arg)
    if op is sre.IN:
        return all(kind is sre.LITERAL and not _plain(x) for kind, x in arg)
    if op is sre.SUBPATTERN:
        return inner(arg[3])
    if op is sre.BRANCH:
        return all(inner(x) for x in arg[1])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        return inner(arg[2]) and (arg[0] > 0 or _apart(rest, side))
    return False


def listed(name: str, verdict: str) -> UrlRule:
    """`host/path`: the host and all its subdomains, and the paths that start so."""
    host, slash, path = name.partition("/")
    tokens = [*re.findall("[a-z0-9]+", host), *re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())]
    return UrlRule(name, verdict, rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(slash + path)}", tuple(dict.fromkeys(tokens)), True)


def pattern(name: str, verdict: str, regex: str) -> UrlRule:
    return UrlRule(name, verdict, regex, mandatory_tokens(regex), False)


def host_word(word: str) -> UrlRule:
    """Blocks hosts with a label, or a part of one between hyphens, that is the word."""
    return pattern(f"{word} host", "block", rf"^(?:[^/]*[.-])?{word}(?:[.-][^/]*)?(?:/|$)")


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


#: The listed rules.
LISTED_RULES = (listed("net/", "block"), listed("example.net/en/", "allow"), listed("example.com/de/", "block"), listed("org/fr/", "allow"))
#: Words of junk hosts, and patterns of paths that aren't pages to read.
PATTERN_RULES = (
    *(host_word(w) for w in ("spam", "pills", "casino", "xxx", "porn", "escort", "viagra", "payday", "jackpot", "torrent", "warez", "doubleclick", "adserver", "tracker")),
    pattern("login path", "block", r"/wp-login\.php$"),
    pattern("cart path", "block", r"/checkout/cart/"),
    pattern("calendar export", "block", r"/calendar/[^/]*\.ics$"),
    pattern("archive download", "block", r"/download/[^/]*\.(?:zip|exe|iso)$"),
    pattern("session path", "block", r"/jsessionid-[0-9a-f]{8,}"),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to the next /, ?, # or the end, A-Z as a-z; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(target: Column) -> Column:
    return F.array_distinct(F.split(F.translate(target, UPPER, LOWER), "[^a-z0-9]+"))


def filed_rules(targets: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """The rules with the token each is filed under: the rarest over all targets, the first of equally rare ones."""
    spark = targets.sparkSession
    rows = [(k, r.name, r.verdict, r.regex, r.listed, list(r.tokens)) for k, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "rule_no int, rule string, rule_verdict string, regex string, listed boolean, tokens array<string>")
    words = F.lit(sorted({t for r in rules for t in r.tokens}))
    counts = targets.select(F.explode(F.array_intersect(tokens_of(F.col("target")), words)).alias("token")).groupBy("token").count()
    own = table.select("rule_no", F.posexplode("tokens").alias("pos", "token"))
    rarest = own.join(counts, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "pos", "token")).alias("least"))
    return table.drop("tokens").join(rarest, "rule_no", "left").select("*", F.col("least.token").alias("token")).drop("least")


def judge_urls(df: DataFrame, rules: tuple[UrlRule, ...] = LISTED_RULES + PATTERN_RULES, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """Add host, path, rule (the listed rule that decides, if any), pattern_rule and verdict."""
    results = ("host", "path", "rule", "pattern_rule", "verdict")
    own, place = free_name(df, "target"), free_name(df, "place")
    rows = df.select(*kept_columns(df, *results), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # URLs without a host match nothing and are dealt by their places, so that no key holds them all
    rows = rows.withColumn(own, F.concat("host", "path")).withColumn(place, F.when(F.col(own) == "", F.monotonically_increasing_id()).otherwise(-1))
    targets = rows.select(F.col(own).alias("target")).where("target <> ''")
    filed = filed_rules(targets, rules)
    if sum(len(r.regex) + len(r.name) for r in rules) <= BROADCAST_BYTES:
        filed = F.broadcast(filed)
    # each distinct target is judged once; "" stands for the rules that have no token
    asked = targets.distinct().select("target", F.explode(F.array_union(tokens_of(F.col("target")), F.array(F.lit("")))).alias("token"))
    hits = asked.join(filed.withColumn("token", F.coalesce("token", F.lit(""))), "token").where(F.expr("target rlike regex"))
    best = hits.groupBy("target").agg(
        F.max(F.when(F.col("listed"), F.struct(F.length("rule").alias("n"), (-F.col("rule_no")).alias("o"), "rule", "rule_verdict"))).alias("_best"),
        F.max(F.when(~F.col("listed"), F.struct(F.col("rule_verdict").alias("v"), (-F.col("rule_no")).alias("o"), "rule"))).alias("_other"),
    )
    best = best.select(
        F.col("target").alias(own),
        F.lit(-1).cast("bigint").alias(place),
        F.col("_best.rule").alias("rule"),
        F.col("_other.rule").alias("pattern_rule"),
        F.coalesce("_best.rule_verdict", "_other.v").alias("verdict"),
    )
    judged = rows.join(best, [own, place], "left")
    return judged.select(*kept_columns(df, *results), "host", "path", "rule", "pattern_rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
