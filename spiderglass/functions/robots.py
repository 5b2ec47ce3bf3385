"""robots.txt: group parsing, linear pattern matching, and the verdict for a path."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: str, user_agent: str) -> tuple[list[tuple[bool, str]], list[str]]:
    """(rules, sitemaps): the rules (allow, pattern) of the group that names the agent most exactly."""
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    sitemaps: list[str] = []
    naming = False
    for raw in re.split(r"\r?\n", text):
        field, colon, value = raw.partition("#")[0].strip().partition(":")
        if not colon:
            continue
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            if not naming:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
        elif field in ("allow", "disallow"):
            if not groups:
                continue
            if value:
                groups[-1][1].append((field == "allow", value))
        elif field == "sitemap" and value:
            sitemaps.append(value)
        naming = field == "user-agent"
    token = user_agent.lower().split("/")[0]
    grade = lambda a: 3 if a == token else 1 if a == "*" else 2 if a in token else 0
    best = max(((grade(a), -i) for i, (agents, _) in enumerate(groups) for a in agents), default=(0, 0))
    return (groups[-best[1]][1] if best[0] else []), sitemaps


def matches(pattern: str, path: str) -> bool:
    """Whether a pattern with * and a final $ matches a path from its start, in time linear in both for each *."""
    exact = pattern.endswith("$")
    parts = (pattern[:-1] if exact else pattern).split("*")
    if not path.startswith(parts[0]):
        return False
    at = len(parts[0])
    if len(parts) == 1:
        return not exact or at == len(path)
    for part in parts[1:-1]:
        found = path.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    last = parts[-1]
    return len(path) - len(last) >= at and path.endswith(last) if exact else path.find(last, at) >= 0


def allowed(path: str, rules: list[tuple[bool, str]]) -> bool:
    """The longest matching pattern decides; of equally long ones an allowing one; nothing matches: allowed."""
    return max(((len(p), a) for a, p in rules if matches(p, path)), default=(0, True))[1]


def robots_rules(user_agent: str):
    @F.pandas_udf("array<struct<allow:boolean,pattern:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"allow": a, "pattern": p} for a, p in parse(t or "", user_agent)[0]])

    return run


def matched(pattern: Column, path: Column) -> Column:
    """Whether a pattern with * and a final $ matches a path from its start: each piece between stars is looked for once,
    from where the one before it ended, so the time is linear in the path for each piece. The others are plain characters."""
    exact = pattern.endswith("$")
    pieces = F.split(F.regexp_replace(pattern, r"\$$", ""), r"\*", -1)
    n = F.size(pieces)
    first, last = F.element_at(pieces, 1), F.element_at(pieces, -1)
    # at: the place of the next character, 0 once a piece was not found.
    found = lambda piece, at: F.call_function("locate", piece, path, at)
    step = lambda at, piece: F.when(at == 0, 0).when(F.length(piece) == 0, at).when(found(piece, at) == 0, 0).otherwise(found(piece, at) + F.length(piece))
    start = F.when(path.startswith(first), F.length(first) + 1).otherwise(0)
    at = F.aggregate(F.slice(pieces, 2, F.greatest(n - 2, F.lit(0))), start, step)
    ends = (at > 0) & path.endswith(last) & (F.length(path) - F.length(last) + 1 >= at)
    more = (at > 0) & ((F.length(last) == 0) | (found(last, F.greatest(at, F.lit(1))) > 0))
    return F.when(n == 1, F.when(exact, path == first).otherwise(path.startswith(first))).otherwise(F.when(exact, ends).otherwise(more))


def prefix_of(pattern: Column) -> Column:
    """What a path begins with if the pattern matches it: all before the first * or a final $."""
    return F.substring_index(F.regexp_replace(pattern, r"\$$", ""), "*", 1)


def path_of(url: Column) -> Column:
    """Path and query of a url."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, origin) with `allowed`, by rules (origin, allow, pattern). The longest match wins, of equally long ones
    an allowing one; a url that nothing matches is allowed.

    The rules of an origin are a trie as a table: a url looks up the beginnings of its path, of the lengths that rules of
    its origin have, by an equi-join. So it meets the rules that share their plain beginning with it, however many its
    origin has, and only those with stars or a final $ are matched further."""
    held = rules.select("origin", "allow", "pattern").distinct().withColumn("prefix", prefix_of(F.col("pattern")))
    lengths = held.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # no more than a pattern is long
    paths = urls.select("url", "origin").distinct().withColumn("path", path_of(F.col("url"))).join(lengths, "origin")
    starts = paths.select("url", "origin", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    starts = starts.withColumn("prefix", F.substring(F.col("path"), F.lit(1), F.col("n"))).drop("n")
    plain = F.col("pattern") == F.col("prefix")
    met = starts.join(held, ["origin", "prefix"]).where(plain | matched(F.col("pattern"), F.col("path")))
    best = met.groupBy("url", "origin").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow"))["allow"].alias("allowed"))
    return urls.join(best, ["url", "origin"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
