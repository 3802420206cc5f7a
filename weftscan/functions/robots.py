"""Robots policies: parsing, group choice and longest-match decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Crawlers whose verdict is recorded, and the patterns of directive lines and of HTML starts.
AI_AGENTS = ["GPTBot", "ClaudeBot", "PerplexityBot", "Google-Extended", "OAI-SearchBot", "CCBot", "Googlebot", "Claude-SearchBot", "Bingbot"]
DIRECTIVE_LINE = r"(?im)^[ \t]*(user-agent|allow|disallow|crawl-delay|sitemap)[ \t]*:"
HTML_START = r"(?i)^[\x{FEFF} \t\r\n]*<\s*(!doctype|html|head|body|meta|script|div|title)\b"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def product_token(value: Column) -> Column:
    """The leading product token, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.trim(F.coalesce(value, F.lit(""))), r"^[A-Za-z0-9_-]+", 0))


def parse_reason(status: Column, body: Column) -> Column:
    """What a response at /robots.txt means: ok, absent_4xx, not_plausibly_robots, server_error, rate_limited, unreachable."""
    text = F.coalesce(body, F.lit(""))
    plausible = (F.trim(F.regexp_replace(text, r"\s+", " ")) == "") | (~text.rlike(HTML_START) & text.rlike(DIRECTIVE_LINE))
    return (
        F.when(status.isNull(), "unreachable")
        .when(status == 429, "rate_limited")
        .when(status.between(500, 599), "server_error")
        .when(status.between(200, 299) & plausible, "ok")
        .when(status.between(200, 299), "not_plausibly_robots")
        .otherwise("absent_4xx")
    )


#: Ends of lines, and what is trimmed from names and values.
_LINE_END = r"\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
_BLANKS = " \t\x1f\u00a0\u3000"


def parse_robots(body: Column) -> Column:
    """struct(groups, sitemaps) of robots files, in column functions only.

    Directives are (name, value) pairs in file order. Leaving sitemaps aside, a group begins at each user-agent line that
    does not follow another one, and reaches to the next beginning; what comes before the first is no group's.
    The last crawl delay of a group that is a number from 0 on is its delay.
    """

    def directive(line: Column) -> Column:
        pair = F.split(F.substring_index(line, "#", 1), ":", 2)
        return F.when(F.size(pair) == 2, F.struct(F.lower(F.btrim(pair[0], F.lit(_BLANKS))).alias("name"), F.btrim(pair[1], F.lit(_BLANKS)).alias("value")))

    def named(pairs: Column, *names: str) -> Column:
        return F.filter(pairs, lambda d: d["name"].isin(*names))

    def group(pairs: Column) -> Column:
        delays = F.filter(F.transform(named(pairs, "crawl-delay"), lambda d: d["value"].try_cast("double")), lambda x: (x >= 0) & ~F.isnan(x))
        rules = F.transform(named(pairs, "allow", "disallow"), lambda d: F.struct((d["name"] == "allow").alias("allow"), d["value"].alias("pattern")))
        return F.struct(F.transform(named(pairs, "user-agent"), lambda d: d["value"]).alias("agents"), rules.alias("rules"), F.get(delays, F.size(delays) - 1).alias("crawl_delay"))

    def grouped(pairs: Column) -> Column:
        agent = lambda d: F.coalesce(d["name"] == "user-agent", F.lit(False))
        begins = F.filter(F.transform(pairs, lambda d, i: F.when(agent(d) & ~agent(F.get(pairs, i - 1)), i)), lambda i: i.isNotNull())
        return let(begins, lambda at: F.transform(at, lambda i, k: group(F.slice(pairs, i + 1, F.coalesce(F.get(at, k + 1), F.size(pairs)) - i))))

    def parsed(pairs: Column) -> Column:
        sitemaps = F.filter(F.transform(named(pairs, "sitemap"), lambda d: d["value"]), lambda v: v != "")
        return F.struct(let(named(pairs, "user-agent", "allow", "disallow", "crawl-delay"), grouped).alias("groups"), sitemaps.alias("sitemaps"))

    lines = F.split(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\x{FEFF}", ""), _LINE_END)
    return let(F.filter(F.transform(lines, directive), lambda d: d.isNotNull()), parsed)


def normal_pattern(value: Column) -> Column:
    """Percent escapes in upper case, other characters beyond ASCII escaped as UTF-8."""
    wide = F.transform(F.split(value, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")))
    text = F.when(value.rlike(r"^[\x00-\x7F]*$"), value).otherwise(F.array_join(wide, ""))
    parts = F.split(text, "(?=%[0-9a-fA-F]{2})")
    raised = F.transform(parts, lambda p: F.when(p.rlike("^%[0-9a-fA-F]{2}"), F.concat(F.upper(F.substring(p, 1, 3)), p.substr(F.lit(4), F.length(p)))).otherwise(p))
    return F.when(text.contains("%"), F.array_join(raised, "")).otherwise(text)


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of a rule: * is any sequence, a final $ anchors, all else is literal."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    literal = F.regexp_replace(normal_pattern(body), r"([\\.\[\](){}+?^|$])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(anchored, F.lit(r"\z")).otherwise(F.lit("")))


def matches(path: Column, pattern: Column) -> Column:
    """Whether a rule with a pattern applies to a path; the empty pattern is no rule."""
    return (pattern != "") & F.regexp_like(normal_pattern(path), pattern_regex(pattern))


def governing_rules(groups: DataFrame, agents: DataFrame) -> DataFrame:
    """(site_id, agent, allow, pattern, named) of the rules that govern each agent of each site.

    ``groups`` has (site_id, user_agent, allow, disallow), a row for each user-agent line; ``agents`` has (site_id,
    agent). Groups that name the agent replace the * groups; agents without either have no rows.
    """
    rules = F.concat(F.transform("allow", lambda p: F.struct(F.lit(True).alias("allow"), p.alias("pattern"))), F.transform("disallow", lambda p: F.struct(F.lit(False).alias("allow"), p.alias("pattern"))))
    lines = groups.select("site_id", product_token(F.col("user_agent")).alias("token"), (F.trim("user_agent") == "*").alias("star"), rules.alias("rules"))
    asked = agents.select("site_id", "agent", F.lower("agent").alias("token"))
    named = asked.join(lines.where("token <> ''").select("site_id", "token", "rules"), ["site_id", "token"]).select("site_id", "agent", F.lit(True).alias("named"), "rules")
    rest = asked.join(named.select("site_id", "agent").distinct(), ["site_id", "agent"], "left_anti")
    star = rest.join(lines.where("star").select("site_id", "rules"), "site_id").select("site_id", "agent", F.lit(False).alias("named"), "rules")
    both = named.unionByName(star)
    return both.select("site_id", "agent", "named", F.explode_outer("rules").alias("r")).select("site_id", "agent", "named", "r.allow", "r.pattern")


def literal_prefix(pattern: Column) -> Column:
    """What every path that a normal pattern applies to begins with: the pattern up to its first wildcard or final anchor."""
    return F.regexp_replace(F.substring_index(pattern, "*", 1), r"\$\z", "")


def applying(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(site_id, agent, path, allow, pattern, normal) for each rule that applies to a path of its site and agent.

    ``paths`` has (site_id, path), ``rules`` (site_id, agent, allow, pattern). Rules are kept by their literal prefixes, as the nodes of a trie
    are; a path looks up only those of its own prefixes that are as long as some rule's prefix at its site, so it meets the rules
    on its way and no others. What follows a wildcard is then verified. A rule with a wildcard in front is on every path's way.
    """
    normal = normal_pattern(F.regexp_replace("pattern", r"\$\z", ""))
    held = rules.where("pattern <> ''").withColumn("normal", F.concat(normal, F.when(F.col("pattern").endswith("$"), "$").otherwise("")))
    held = held.select("site_id", "agent", "allow", "pattern", "normal", literal_prefix(F.col("normal")).alias("prefix")).distinct()
    lengths = held.groupBy("site_id").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    known = paths.select("site_id", "path", normal_pattern(F.col("path")).alias("told")).join(lengths, "site_id")
    way = F.transform(F.filter("lengths", lambda n: n <= F.length("told")), lambda n: F.substring(F.col("told"), F.lit(1), n))
    met = known.select("site_id", "path", "told", F.explode(way).alias("prefix")).join(held, ["site_id", "prefix"])
    wild, anchored = F.col("normal").contains("*"), F.col("normal").endswith("$")
    fits = F.when(wild, matches(F.col("path"), F.col("pattern"))).when(anchored, F.col("told") == F.col("prefix")).otherwise(True)
    return met.where(fits).select("site_id", "agent", "path", "allow", "pattern", "normal")


def closed(paths: DataFrame, rules: DataFrame, octets: bool = True) -> DataFrame:
    """(site_id, path) of the paths that ``decide`` closes to some agent. A path without a matching rule is open, so only paths that rules apply to are dealt out."""
    return _longest(paths.select("site_id", "path").distinct(), rules, octets).where("not best and path <> '/robots.txt'").select("site_id", "path").distinct()


def _longest(places: DataFrame, rules: DataFrame, octets: bool) -> DataFrame:
    """(site_id, agent, path, best): what the longest rule that applies says, for paths that a rule applies to."""
    length = F.octet_length(F.col("normal")) if octets else F.length("pattern")
    hit = applying(places, rules)
    return hit.groupBy("site_id", "agent", "path").agg(F.max_by("allow", F.struct(length.alias("n"), F.col("allow").alias("a"))).alias("best"))


def decide(paths: DataFrame, rules: DataFrame, octets: bool = True) -> DataFrame:
    """(site_id, agent, path, allowed): the longest matching rule wins, allow on a tie, and no match allows.

    ``paths`` has (site_id, path); ``rules`` are those of ``governing_rules``. Every agent with governing groups is
    asked about every path of its site.
    """
    places = paths.select("site_id", "path").distinct()
    asked = places.join(rules.select("site_id", "agent").distinct(), "site_id")
    joined = asked.join(_longest(places, rules, octets), ["site_id", "agent", "path"], "left")
    return joined.select("site_id", "agent", "path", ((F.col("path") == "/robots.txt") | F.coalesce("best", F.lit(True))).alias("allowed"))


def verdicts(responses: DataFrame, agents: list[str] = AI_AGENTS) -> DataFrame:
    """(site_id, agent, verdict) at the site root from landed (site_id, status, body).

    All agents are disallowed where the policy is unreachable and unspecified where there is none.
    """
    policy = responses.select("site_id", parse_reason(F.col("status"), F.col("body")).alias("reason"), parse_robots(F.coalesce("body", F.lit(""))).alias("parsed"))
    asked = policy.select("site_id", "reason", F.explode(F.array(*map(F.lit, agents))).alias("agent"))
    lines = policy.where("reason = 'ok'").select("site_id", F.explode("parsed.groups").alias("g")).select(
        "site_id",
        F.explode("g.agents").alias("user_agent"),
        F.transform(F.filter("g.rules", lambda r: r["allow"]), lambda r: r["pattern"]).alias("allow"),
        F.transform(F.filter("g.rules", lambda r: ~r["allow"]), lambda r: r["pattern"]).alias("disallow"),
    )
    root = decide(policy.select("site_id", F.lit("/").alias("path")), governing_rules(lines, asked))
    joined = asked.join(root.select("site_id", "agent", "allowed"), ["site_id", "agent"], "left")
    open_ = F.when(F.col("allowed").isNull(), "unspecified").when(F.col("allowed"), "allowed").otherwise("disallowed")
    blocked = F.col("reason").isin("unreachable", "server_error", "rate_limited")
    return joined.select("site_id", "agent", F.when(blocked, "disallowed").when(F.col("reason") != "ok", "unspecified").otherwise(open_).alias("verdict"))


def max_crawl_delay(groups: DataFrame) -> DataFrame:
    """(site_id, crawl_delay): the longest delay that any group asks for; ``groups`` has (site_id, crawl_delay)."""
    return groups.groupBy("site_id").agg(F.max("crawl_delay").alias("crawl_delay"))
