"""The audit rules: each is one function from evidence to outcome rows, for all sites at once.

Every rule gives each site exactly one outcome (not_assessed, passed, or finding), save that a rule
over page templates may give a finding for each template. An observation that was not
made is decided before the predicate and is never a pass. All aggregations are by site_id,
so a job over many sites is a few hash aggregations on one key; nothing is collected. A finding counts every page it affects
and names the first of them only, so a site of any size is a few rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftscan.functions import robots, urls
from weftscan.operators import shapes
from weftscan.sources.bundle import Evidence
from weftscan.sources.shared import landed

# Thresholds, agent lists and vocabularies that rules compare with.
RETRIEVAL_AGENTS = ["OAI-SearchBot", "PerplexityBot", "Claude-SearchBot", "Googlebot", "Bingbot"]
PROBED_AGENTS = ["GPTBot", "ClaudeBot", "PerplexityBot", "OAI-SearchBot", "CCBot"]
PRIMARY_TYPES = ["home", "product", "article", "doc", "about"]
INDEX_SCOPES = ["googlebot", "oai-searchbot", "perplexitybot", "claude-searchbot"]
SNIPPET_SCOPES = ["googlebot"]
NOINDEX, NOSNIPPET = ["noindex", "none"], ["nosnippet", "max-snippet:0"]
COLON_DIRECTIVES = ["max-snippet", "max-image-preview", "max-video-preview", "unavailable_after"]
REFUSALS, CLIENT_REFUSALS = [401, 403, 404, 406, 410, 451], [401, 403, 429]
ROOT_ALIASES = ["/", "/index.html", "/index.php", "/home", "/default.aspx"]
JS_DELTA, JS_MIN_GAIN, EMPTY_TEXT = 0.8, 200, 200
MOST_REFS = 10
LONG_WORDS, FEW_HEADINGS, SURE_ARTICLE, POOR_MS = 1500, 3, 0.8, 1800
NEWS_TYPES = ["NewsArticle", "ReportageNewsArticle", "LiveBlogPosting"]
COMMERCE_TYPES = ["Product", "ProductGroup", "IndividualProduct", "Offer", "AggregateOffer"]
PRICE_FIELDS = ["offers.price", "offers.lowPrice"]
PRICE_BEFORE = r"(?:₹|\$|€|£|¥|\bRs\.?|\bINR\b|\bUSD\b|\bEUR\b|\bGBP\b|\bJPY\b)\s?\d[\d,]*(?:\.\d+)?"
PRICE_AFTER = r"\d[\d.,]*\s?(?:€|£|₹|\$|\bEUR\b|\bUSD\b|\bGBP\b|\bINR\b|\bCHF\b|\bkr\b|zł)"
ABSOLUTE_URL = r"(?i)^https?://\S+$"
SAFE_VALUE = r"(?U)^[\w .,&'()/-]{1,80}$"
STRUCTURED_RECORD = "wikidata.org"
PLATFORM_HANDLES = "shopify wix squarespace wordpress bigcommerce woocommerce webflow godaddy weebly hubspot".split()
SOCIAL_HOSTS = """facebook.com instagram.com twitter.com x.com tiktok.com youtube.com pinterest.com linkedin.com vimeo.com
    snapchat.com threads.net""".split()
ORG_TYPES = """
Organization Corporation NGO GovernmentOrganization EducationalOrganization CollegeOrUniversity School
MedicalOrganization Hospital Clinic Pharmacy NewsMediaOrganization SportsOrganization SportsTeam PerformingGroup
ResearchOrganization Airline Consortium LibrarySystem PoliticalParty WorkersUnion FundingScheme Project
OnlineBusiness OnlineStore LocalBusiness Store AutoDealer BookStore ClothingStore ComputerStore ElectronicsStore
Florist FurnitureStore GroceryStore HardwareStore HobbyShop HomeGoodsStore JewelryStore MobilePhoneStore
OfficeEquipmentStore PetStore ShoeStore SportingGoodsStore ToyStore Restaurant FoodEstablishment Bakery CafeOrCoffeeShop
BarOrPub ProfessionalService LegalService Attorney FinancialService BankOrCreditUnion InsuranceAgency AccountingService
RealEstateAgent TravelAgency LodgingBusiness Hotel HealthAndBeautyBusiness MedicalBusiness Dentist Physician
AutomotiveBusiness HomeAndConstructionBusiness EntertainmentBusiness EmploymentAgency SelfStorage ChildCare
""".split()
QUESTION_KINDS = {"legal_name": 1, "founded_year": 1, "product_name": 2}

#: The tables of evidence that rules and reports read.
READ = ["sites", "pages", "groups", "agents", "declared", "sitemaps", "probe", "well_known", "claims", "hits"]
COLUMNS = ["site_id", "rule_id", "outcome", "confidence", "breadth", "importance", "pages_affected", "pages_examined", "page_types", "urls", "detail"]


@dataclass(frozen=True)
class Rule:
    """A rule's constant facts and its function; blocking, status and effort never depend on evidence."""

    rule_id: str
    skill: str
    title: str
    fix: str
    status: str
    blocking: bool
    effort: str
    judge: Callable[[Evidence], DataFrame]
    category: str = "discoverability"
    symptom: tuple[str, ...] = ("misrepresented",)
    #: (site_id) of the sites where the rule is not assessed, for rules whose function does much before it comes to that
    unassessed: Callable[[Evidence], DataFrame] | None = None


CATALOGUE: dict[str, Rule] = {}


def rule(rule_id: str, skill: str, title: str, fix: str, *, status: str = "found", blocking: bool = False, effort: str = "low", category: str = "discoverability", symptom: tuple[str, ...] = ("misrepresented",), unassessed: Callable[[Evidence], DataFrame] | None = None):
    """Registers a function of Evidence as a rule; this is how to add one's own."""

    def register(judge: Callable[[Evidence], DataFrame]) -> Callable[[Evidence], DataFrame]:
        CATALOGUE[rule_id] = Rule(rule_id, skill, title, fix, status, blocking, effort, judge, category, symptom, unassessed)
        return judge

    return register


# Shared predicates


def is_2xx(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def is_error(status: Column) -> Column:
    return F.coalesce(status.isin(404, 410) | status.between(500, 599), F.lit(False))


def is_html() -> Column:
    return F.lower(F.coalesce("content_type", F.lit(""))).contains("html")


def is_comparable() -> Column:
    return is_2xx(F.col("status")) & is_html() & F.coalesce("rendered", F.lit(False))


def server_text() -> Column:
    return F.col("raw_len") + F.col("hidden_len")


def js_dependent() -> Column:
    rendered = F.coalesce("rendered_len", F.lit(0))
    return F.coalesce((F.col("delta") >= JS_DELTA) & (rendered - F.col("raw_len") >= JS_MIN_GAIN) & (server_text() <= (1 - JS_DELTA) * rendered), F.lit(False))


def readable_language() -> Column:
    return F.col("lang").isNull() | F.split(F.lower(F.trim("lang")), "[-_]")[0].isin("en", "")


def no_schema_dates() -> Column:
    return (F.coalesce("date_published", F.lit("")) == "") & (F.coalesce("date_modified", F.lit("")) == "")


def is_org_node(node: Column) -> Column:
    nested = F.exists(F.map_entries(F.coalesce(node["vals"], F.create_map().cast("map<string,string>"))), lambda e: e["key"].endswith(".@type") & e["value"].isin(ORG_TYPES))
    return F.coalesce(node["type"].isin(ORG_TYPES), F.lit(False)) | F.arrays_overlap(node["fields"], F.array(F.lit("logo"), F.lit("sameAs"))) | nested


def is_parse_failure(node: Column) -> Column:
    return ~node["valid"] & (F.coalesce(node["type"], F.lit("")) == "") & (F.size(node["fields"]) == 0)


def marked_price(node: Column) -> Column:
    raw = F.coalesce(F.nullif(F.try_element_at(node["vals"], F.lit("offers.price")), F.lit("")), F.try_element_at(node["vals"], F.lit("price")))
    value = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
    return F.when(node["type"].isin(COMMERCE_TYPES) & (value > 0), value)


def platform_account(entry: Column) -> Column:
    """The platform whose own profile an absolute social URL names, or null."""
    bare = F.regexp_replace(urls.host(entry), r"^(?:www\.)?(?:m\.)?(?:mobile\.)?", "")
    parts = F.slice(F.transform(urls.segments(entry), lambda s: F.lower(F.regexp_replace(s, "^@+", ""))), 1, 3)
    return F.when(entry.rlike(ABSOLUTE_URL) & bare.isin(SOCIAL_HOSTS), F.get(F.filter(parts, lambda s: s.isin(PLATFORM_HANDLES)), F.lit(0)))


def directives(scopes: list[str]) -> Column:
    """Robots directives in force on a page: the meta tag's, and the header's without a scope or with one of ``scopes``."""
    meta = F.transform(F.coalesce("meta_robots", F.array().cast("array<string>")), lambda t: F.replace(F.lower(F.trim(t)), F.lit(" "), F.lit("")))
    parts = F.filter(F.transform(F.split(F.coalesce("x_robots", F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")

    def step(acc: Column, s: Column) -> Column:
        head = F.lower(F.trim(F.substring_index(s, ":", 1)))
        rest = F.trim(F.substring(s, F.length(F.substring_index(s, ":", 1)) + 2, F.length(s)))
        scoped = s.contains(":") & ~head.isin(COLON_DIRECTIVES) & (rest != "")
        scope = F.when(scoped, head).otherwise(acc["scope"])
        token = F.regexp_replace(F.lower(F.when(scoped, rest).otherwise(s)), r"\s*:\s*", ":")
        counts = scope.isNull() | scope.isin(scopes)
        return F.struct(scope.alias("scope"), F.when(counts, F.concat(acc["found"], F.array(token))).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(None).cast("string").alias("scope"), F.array().cast("array<string>").alias("found"))
    return F.array_union(meta, F.aggregate(parts, start, step, lambda acc: acc["found"]))


def has_any(tokens: Column, names: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, names)))


# What rules read off a page by itself: looked at once for all of them where a table of pages has these columns


def _sure_prices() -> Column:
    """Pages of products whose prices can be compared before and after scripts."""
    sure = (F.col("page_type") == "product") & (F.coalesce("type_confidence", F.lit(0.0)) >= 0.6)
    return is_comparable() & sure & ~js_dependent() & F.col("raw_text").isNotNull() & F.col("rendered_text").isNotNull()


def _late_price() -> Column:
    structured = F.exists("nodes", lambda x: has_any(x["fields"], PRICE_FIELDS))
    in_server = F.col("raw_text").rlike(PRICE_BEFORE) | F.col("raw_text").rlike(PRICE_AFTER)
    return F.when(F.coalesce(_sure_prices(), F.lit(False)), ~in_server & F.col("rendered_text").rlike(PRICE_BEFORE) & ~F.coalesce(structured, F.lit(False)))


def _profiles() -> Column:
    """Of a page whose organizations have sameAs entries: whether one of them has no address, and the platforms' own accounts that the others name."""
    nodes = F.filter("nodes", lambda x: x["type"].isin(ORG_TYPES) & F.array_contains(x["fields"], "sameAs") & F.try_element_at(x["vals"], F.lit("sameAs")).isNotNull())
    lists = F.transform(nodes, lambda x: F.transform(F.split(F.try_element_at(x["vals"], F.lit("sameAs")), r" \| "), lambda s: F.trim(s)))
    broken = lambda entries: ~F.exists(entries, lambda e: e.rlike(ABSOLUTE_URL))
    accounts = F.filter(F.transform(F.flatten(F.filter(lists, lambda entries: ~broken(entries))), platform_account), lambda a: a.isNotNull())
    return F.when(F.size(nodes) > 0, F.struct(F.exists(lists, broken).alias("broken"), accounts.alias("accounts")))


def _some_node(found: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists("nodes", found), F.lit(False))


def _contradicted(node: Column) -> Column:
    return marked_price(node).isNotNull() & F.coalesce(node["contradicts"], F.lit(False))


def _has_marked_price(node: Column) -> Column:
    return marked_price(node).isNotNull()


#: Each of a page by itself, and the same for every rule that asks.
SIGNALS: dict[str, Callable[[], Column]] = {
    "final_host": lambda: urls.host(F.col("final_url")),
    "final_path": lambda: urls.path(F.col("final_url")),
    "final_place": lambda: urls.path_and_query(F.col("final_url")),
    "canonical_host": lambda: urls.host(F.col("canonical")),
    "canonical_path": lambda: urls.path(F.col("canonical")),
    "noindex": lambda: has_any(directives(INDEX_SCOPES), NOINDEX),
    "nosnippet": lambda: has_any(directives(SNIPPET_SCOPES), NOSNIPPET),
    "late_price": _late_price,
    "profiles": _profiles,
    "org_node": lambda: F.when(F.col("page_type").isin("home", "about"), _some_node(is_org_node)).otherwise(False),
    "org_type": lambda: F.when(F.col("page_type").isin("home", "about"), _some_node(lambda x: x["type"].isin(ORG_TYPES))).otherwise(False),
    "person_node": lambda: F.when(F.col("page_type") == "home", _some_node(lambda x: x["type"] == "Person")).otherwise(False),
    "same_as_node": lambda: _some_node(lambda x: F.array_contains(x["fields"], "sameAs")),
    "news_node": lambda: _some_node(lambda x: x["type"].isin(NEWS_TYPES)),
    "any_node": lambda: F.coalesce(F.size("nodes") > 0, F.lit(False)),
    "unparsed_node": lambda: _some_node(is_parse_failure),
    "priced_node": lambda: _some_node(_has_marked_price),
    "contradicted_node": lambda: _some_node(_contradicted),
}
#: Columns of pages that only signals read; rules that others register may read them too.
BEHIND_SIGNALS = ["nodes", "headings", "raw_text", "rendered_text", "meta_robots", "x_robots"]


def signal(pages: DataFrame, name: str) -> Column:
    """What is known of each page under that name: the column, or what it is made of where ``pages`` lacks it."""
    return F.col(name) if name in pages.columns else SIGNALS[name]()


def with_signals(pages: DataFrame) -> DataFrame:
    """``pages`` with a column for each signal. What the library's rules no longer need is left out, unless others have registered rules."""
    rest = BEHIND_SIGNALS if all(LIBRARY.get(k) == r for k, r in CATALOGUE.items()) else []
    # signals of pages without an answer are not asked for, save those of addresses
    answered = F.col("status").between(200, 299)
    made = {name: c() if name.startswith("final_") else F.when(answered, c()) for name, c in SIGNALS.items()}
    return pages.select(*[c for c in pages.columns if c not in rest], *[c.alias(name) for name, c in made.items()])


# Shared aggregates and outcome rows


def first_refs(rows: DataFrame, hit: Column, *by: str, order: str = "page_seq", name: str = "refs") -> DataFrame:
    """(site_id, by, refs): the first addresses of rows that satisfy ``hit``, by ``order``; Spark cuts groups to so many rows before it deals them out."""
    first = Window.partitionBy("site_id", *by).orderBy("at", "url")
    kept = rows.where(hit).select("site_id", *by, F.col(order).alias("at"), "url").withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= MOST_REFS)
    return kept.groupBy("site_id", *by).agg(F.array_sort(F.collect_list(F.struct("at", "url"))).alias(name))


def with_refs(counts: DataFrame, rows: DataFrame, hit: Column, *by: str, order: str = "page_seq") -> DataFrame:
    """``counts`` with urls: the first addresses of ``rows`` that satisfy ``hit``; null where there is none."""
    return counts.join(first_refs(rows, hit, *by, order=order), ["site_id", *by], "left").withColumn("urls", F.col("refs.url")).drop("refs")


def types_of(hit: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(hit, F.col("page_type"))))


def by_site(ev: Evidence, aggregated: DataFrame) -> DataFrame:
    return ev.sites.join(aggregated, "site_id", "left")


def n(name: str) -> Column:
    """A count of the joined aggregate; sites without rows have 0."""
    return F.coalesce(F.col(name), F.lit(0))


def breadth_by_share(affected: Column, total: Column) -> Column:
    return F.when(affected * 2 >= total, "site").when(affected >= 2, "section").otherwise("page")


def judged(
    rows: DataFrame,
    rule_id: str,
    fired: Column,
    *,
    assessed: Column | None = None,
    passed: Column | None = None,
    confidence: Column | str = "high",
    breadth: Column | str = "site",
    importance: Column | str = "secondary",
    affected: Column | int = 0,
    examined: Column | int = 0,
    types: Column | None = None,
    refs: Column | None = None,
    detail: Column | None = None,
) -> DataFrame:
    """One outcome for each row of ``rows``. Early passes go before the gate, the gate before the predicate."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    no = F.lit(False)
    outcome = F.when(F.coalesce(passed, no), "passed") if passed is not None else F.when(no, "")
    if assessed is not None:
        outcome = outcome.when(~F.coalesce(assessed, no), "not_assessed")
    outcome = outcome.when(F.coalesce(fired, no), "finding").otherwise("passed")
    empty = F.array().cast("array<string>")
    found = F.col("outcome") == "finding"
    payload = {
        "confidence": F.when(found, as_column(confidence)),
        "breadth": F.when(found, as_column(breadth)),
        "importance": F.when(found, as_column(importance)),
        "pages_affected": F.when(found, as_column(affected).cast("long")),
        "pages_examined": F.when(found, as_column(examined).cast("long")),
        # a site without pages has no row in the aggregates: its lists are empty and not null
        "page_types": F.when(found & F.lit(types is not None), F.coalesce(types, empty) if types is not None else empty).otherwise(empty),
        "urls": F.when(found & F.lit(refs is not None), F.coalesce(refs, empty) if refs is not None else empty).otherwise(empty),
        "detail": F.when(found, detail if detail is not None else F.lit("")).otherwise(F.lit("")),
    }
    told = {"detail": {"metadata": {"of": "finding"}}}  # only findings have a detail: whoever reads other outcomes need not compute it
    return rows.withColumn("outcome", outcome).select("site_id", F.lit(rule_id).alias("rule_id"), "outcome", *[c.alias(k, **told.get(k, {})) for k, c in payload.items()]).select(*COLUMNS)


def unassessed_sites(rows: DataFrame, assessed: Column, passed: Column | None = None) -> DataFrame:
    """(site_id) of ``rows`` that ``judged`` would not assess."""
    no = F.lit(False)
    return rows.where(~F.coalesce(assessed, no) & ~(no if passed is None else F.coalesce(passed, no))).select("site_id")


def primary_if_any(types: Column) -> Column:
    return F.when(has_any(types, PRIMARY_TYPES), "primary").otherwise("secondary")


# Access and indexability


def _policy(ev: Evidence) -> DataFrame:
    """(site_id, agent, verdict, named) for agents with a verdict."""
    named = ev.groups.select("site_id", robots.product_token(F.col("user_agent")).alias("token")).where("token <> ''").distinct().withColumn("named", F.lit(True))
    asked = ev.agents.withColumn("token", F.lower("agent"))
    return asked.join(named, ["site_id", "token"], "left").select("site_id", "agent", "verdict", F.coalesce("named", F.lit(False)).alias("named"))


def _policy_gate() -> dict[str, Column]:
    """Whether a site's policy can be judged, and whether it passes because there is none."""
    return {"assessed": F.col("robots_ok") & (F.col("robots_reason") == "ok"), "passed": F.col("robots_reason").isin("absent_4xx", "not_plausibly_robots")}


def _policy_unassessed(ev: Evidence) -> DataFrame:
    return unassessed_sites(ev.sites, **_policy_gate())


def _excluded(ev: Evidence, rule_id: str, named: bool) -> DataFrame:
    """Retrieval agents shut out at the root, by name or by the group for all others, and the pages closed to them."""
    shut = _policy(ev).where(F.col("agent").isin(RETRIEVAL_AGENTS) & (F.col("verdict") == "disallowed") & (F.col("named") == named)).select("site_id", "agent")
    rules = robots.governing_rules(ev.groups, shut)
    # agents without a group of their own share one policy, which decides for all of them at once
    rules = landed((rules if named else rules.withColumn("agent", F.lit("*"))).select("site_id", "agent", "allow", "pattern").distinct())
    paths = landed(ev.pages.select("site_id", "page_type", signal(ev.pages, "final_place").alias("path")))
    closed = robots.closed(paths, rules, octets=False).withColumn("closed", F.lit(True))
    pages = paths.groupBy("site_id", "path", "page_type").agg(F.count(F.lit(1)).alias("n")).join(closed, ["site_id", "path"], "left")
    scope = pages.groupBy("site_id").agg(F.sum(F.when(F.col("closed"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("total"), types_of(F.col("closed")).alias("types"))
    allows = rules.groupBy("site_id").agg(F.bool_or(F.col("allow") & ~F.col("pattern").isin("", "/")).alias("content_allows"))
    agents = shut.groupBy("site_id").agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    rows = by_site(ev, agents).join(scope, "site_id", "left").join(allows, "site_id", "left")
    return judged(
        rows,
        rule_id,
        F.size("agents") > 0,
        **_policy_gate(),
        breadth=F.when(F.col("content_allows"), "section").otherwise("site"),
        importance="primary",
        affected=n("hit"),
        examined=n("total"),
        types=F.col("types"),
        refs=F.array(F.concat(F.regexp_replace("origin", "/+$", ""), F.lit("/robots.txt"))),
        detail=F.concat(F.lit("closed at the root to "), F.array_join("agents", ", ")),
    )


@rule("ACC-001", "access-and-indexability", "Search crawlers are shut out by the group for all other agents", "Name each shut-out search crawler in a robots group of its own.", blocking=True, symptom=("invisible",), unassessed=_policy_unassessed)
def acc_001(ev: Evidence) -> DataFrame:
    return _excluded(ev, "ACC-001", named=False)


@rule("ACC-002", "access-and-indexability", "The robots file answers with an error", "Let the robots file answer 200, or 404 if there is no policy.", status="risk", blocking=True, symptom=("invisible",))
def acc_002(ev: Evidence) -> DataFrame:
    pages = ev.pages.groupBy("site_id").agg(F.count(F.lit(1)).alias("total"), types_of(F.lit(True)).alias("types"))
    return judged(
        by_site(ev, pages),
        "ACC-002",
        F.col("robots_reason").isin("server_error", "rate_limited"),
        assessed=F.col("robots_fetched") & F.col("robots_status").isNotNull(),
        confidence="low",
        importance="primary",
        affected=n("total"),
        examined=n("total"),
        types=F.col("types"),
        refs=F.array(F.concat(F.regexp_replace("origin", "/+$", ""), F.lit("/robots.txt"))),
        detail=F.concat(F.lit("status "), F.col("robots_status").cast("string")),
    )


def _primary_by_site(ok: DataFrame) -> DataFrame:
    return ok.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_ok"), F.count_if(F.col("page_type").isin(PRIMARY_TYPES)).alias("n_primary"))


def _templates_unassessed(ev: Evidence) -> DataFrame:
    return unassessed_sites(by_site(ev, _primary_by_site(ev.pages.where(is_2xx(F.col("status"))))), n("n_primary") > 0)


def _templates(ev: Evidence, rule_id: str, eligible: Column, hit: Column, sure: str, unsure: str) -> DataFrame:
    """Shares of page types; types that fire together over half of the site's pages become one finding."""
    ok = ev.pages.where(is_2xx(F.col("status"))).select("*", F.col("page_type").isin(PRIMARY_TYPES).alias("primary"), eligible.alias("eligible"), hit.alias("hit"))
    site = _primary_by_site(ok)
    both = F.col("eligible") & F.col("hit")
    by_type = (
        ok.where("primary")
        .groupBy("site_id", "page_type")
        .agg(F.count_if("eligible").alias("members"), F.count_if(both).alias("affected"))
        .where((F.col("affected") > 0) & ((F.col("page_type") == "home") | ((F.col("affected") >= 2) & (F.col("affected") * 2 >= F.col("members")))))
    )
    named = first_refs(ok.where("primary"), both, "page_type")
    fired = by_type.join(site.select("site_id", "n_ok"), "site_id").join(named, ["site_id", "page_type"], "left")
    total = fired.groupBy("site_id").agg(((F.count(F.lit(1)) >= 2) & (F.sum("affected") * 2 >= F.first("n_ok"))).alias("merged"))
    grouped = (
        fired.join(total, "site_id")
        .withColumn("g", F.when(F.col("merged"), "").otherwise(F.col("page_type")))
        .groupBy("site_id", "g")
        .agg(F.array_sort(F.collect_set("page_type")).alias("types"), F.sum("affected").alias("affected"), F.sum("members").alias("members"), F.slice(F.array_sort(F.flatten(F.collect_list("refs"))), 1, MOST_REFS)["url"].alias("urls"))
    )
    rows = by_site(ev, site).join(grouped, "site_id", "left")
    strong = (F.col("affected") >= 3) | (F.array_join("types", ",") == "home")
    return judged(
        rows,
        rule_id,
        F.col("types").isNotNull(),
        assessed=n("n_primary") > 0,
        confidence=F.when(strong, sure).otherwise(unsure),
        breadth=F.when(F.size("types") >= 2, "site").otherwise("section"),
        importance="primary",
        affected=F.col("affected"),
        examined=F.col("members"),
        types=F.col("types"),
        refs=F.col("urls"),
    )


@rule("ACC-003", "access-and-indexability", "Page templates refuse indexing", "Take noindex off the templates that should be found.", blocking=True, symptom=("invisible",), unassessed=_templates_unassessed)
def acc_003(ev: Evidence) -> DataFrame:
    own = F.col("canonical").isNull() | F.coalesce("canonical_self", F.lit(False))
    return _templates(ev, "ACC-003", own, signal(ev.pages, "noindex"), "high", "medium")


@rule("ACC-004", "access-and-indexability", "Page templates forbid snippets", "Limit the snippet ban to the passages that need it.", blocking=True, symptom=("invisible", "misrepresented"), unassessed=_templates_unassessed)
def acc_004(ev: Evidence) -> DataFrame:
    return _templates(ev, "ACC-004", ~signal(ev.pages, "noindex"), signal(ev.pages, "nosnippet"), "medium", "low")


@rule("ACC-005", "access-and-indexability", "Pages name the home page as their canonical address", "Give each page its own canonical address.", effort="medium", symptom=("invisible",))
def acc_005(ev: Evidence) -> DataFrame:
    domain = F.coalesce("domain", urls.host(F.col("origin")))
    ok = ev.pages.where(is_2xx(F.col("status"))).join(ev.sites.select("site_id", domain.alias("domain")), "site_id")
    target, path = signal(ev.pages, "canonical_host"), signal(ev.pages, "final_path")
    inside = (target == F.col("domain")) | target.endswith(F.concat(F.lit("."), F.col("domain")))
    declaring = F.col("canonical").isNotNull() & ~path.isin(ROOT_ALIASES)
    hit = declaring & ~F.coalesce("canonical_self", F.lit(False)) & inside & (signal(ev.pages, "canonical_path") == "/")
    flagged = ok.select("*", declaring.alias("declaring"), F.coalesce(hit, F.lit(False)).alias("hit"))
    counts = flagged.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n_ok"),
        F.count_if("declaring").alias("declaring"),
        F.count_if("hit").alias("hit"),
        F.countDistinct(F.when(F.col("hit"), path)).alias("paths"),
        types_of(F.col("hit")).alias("types"),
    )
    return judged(
        by_site(ev, with_refs(counts, flagged, F.col("hit"))),
        "ACC-005",
        (F.col("paths") >= 2) & (F.col("hit") * 2 >= F.col("declaring")),
        assessed=n("declaring") >= 2,
        confidence=F.when(F.col("hit") >= 3, "high").otherwise("medium"),
        breadth=F.when(F.col("hit") * 2 >= F.col("n_ok"), "site").otherwise("section"),
        importance=primary_if_any(F.col("types")),
        affected=F.col("hit"),
        examined=F.col("declaring"),
        types=F.col("types"),
        refs=F.col("urls"),
    )


@rule("ACC-006", "access-and-indexability", "Named crawlers are refused where a browser identity is served", "See in the server logs how verified crawlers are answered.", status="risk", blocking=True, symptom=("invisible",))
def acc_006(ev: Evidence) -> DataFrame:
    probed = F.col("agent").isin(PROBED_AGENTS)
    per_url = ev.probe.groupBy("site_id", "url").agg(
        F.max(F.when(F.col("agent") == "browser-ua", F.col("status"))).alias("browser"),
        F.max(F.when(F.col("agent") == "Googlebot", F.col("status"))).alias("google"),
        F.count_if(probed).alias("n_named"),
    )
    comparable = per_url.where(is_2xx(F.col("browser")) & (F.col("n_named") > 0))
    named = ev.probe.where(probed).join(comparable.select("site_id", "url", "google"), ["site_id", "url"])
    always = named.groupBy("site_id", "agent").agg(F.bool_and(F.coalesce(F.col("status").isin(REFUSALS), F.lit(False))).alias("refused")).where("refused").select("site_id", "agent")
    home = F.concat(F.regexp_replace("origin", "/+$", ""), F.lit("/"))
    refusing = named.join(always, ["site_id", "agent"], "left_semi").select("site_id", "url", "google").distinct().join(ev.sites.select("site_id", home.alias("home")), "site_id")
    behind = F.coalesce(F.col("google").isin(REFUSALS), F.lit(False))
    places = refusing.groupBy("site_id").agg(F.count(F.lit(1)).alias("hit"), F.bool_and(behind).alias("edge"), F.bool_or(F.col("url") == F.col("home")).alias("at_home"))
    agents = always.groupBy("site_id").agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    # pages are found by the address asked for or by the one that answered
    elsewhere = ev.pages.where(~F.col("final_url").eqNullSafe(F.col("url")))
    pages = [rows.select("site_id", F.col(c).alias("url"), "page_type") for c, rows in (("url", ev.pages), ("final_url", elsewhere))]
    types = pages[0].union(pages[1]).join(refusing.select("site_id", "url"), ["site_id", "url"], "left_semi").groupBy("site_id").agg(types_of(F.lit(True)).alias("types"))
    total = comparable.groupBy("site_id").agg(F.count(F.lit(1)).alias("total"))
    rows = by_site(ev, total).join(with_refs(places, refusing, F.lit(True), order="url"), "site_id", "left").join(agents, "site_id", "left").join(types, "site_id", "left")
    return judged(
        rows,
        "ACC-006",
        F.col("agents").isNotNull(),
        assessed=(n("total") > 0) & ~F.coalesce("edge", F.lit(False)),
        confidence="low",
        breadth=F.when(F.col("at_home"), "site").otherwise("section"),
        importance="primary",
        affected=F.col("hit"),
        examined=F.col("total"),
        types=F.coalesce("types", F.array().cast("array<string>")),
        refs=F.col("urls"),
        detail=F.concat(F.lit("refused: "), F.array_join("agents", ", ")),
    )


@rule("ACC-007", "access-and-indexability", "Advertised addresses do not resolve", "Restore, redirect or stop advertising the addresses that fail.", blocking=True, effort="medium", symptom=("invisible",))
def acc_007(ev: Evidence) -> DataFrame:
    pages = ev.pages.join(ev.sites.select("site_id", urls.host(F.col("origin")).alias("origin_host")), "site_id")
    root = (signal(ev.pages, "final_host") == F.col("origin_host")) & signal(ev.pages, "final_path").isin(ROOT_ALIASES)
    home_ok = is_2xx(F.col("status")) & ((F.col("page_type") == "home") | root)
    bad = is_error(F.col("status"))
    counts = pages.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total"), F.bool_or(home_ok).alias("home_ok"), F.count_if(bad).alias("bad"), F.count_if(bad & (F.col("status") >= 500)).alias("bad_5xx")
    )
    return judged(
        by_site(ev, with_refs(counts, pages, bad)),
        "ACC-007",
        (F.col("bad") >= 2) & (F.col("bad") * 10 >= F.col("total")),
        assessed=(n("total") >= 5) & F.coalesce("home_ok", F.lit(False)),
        confidence=F.when(F.col("bad_5xx") > 0, "medium").otherwise("high"),
        breadth=F.when(F.col("bad") * 2 >= F.col("total"), "site").when(F.col("bad") * 4 >= F.col("total"), "section").otherwise("page"),
        affected=F.col("bad"),
        examined=F.col("total"),
        refs=F.col("urls"),
    )


@rule("ACC-008", "access-and-indexability", "Search crawlers are excluded by name", "Decide for each assistant whether its answers should include the site.", status="proactive", blocking=True, symptom=("invisible",), unassessed=_policy_unassessed)
def acc_008(ev: Evidence) -> DataFrame:
    return _excluded(ev, "ACC-008", named=True)


@rule("ACC-009", "access-and-indexability", "Declared sitemaps are broken", "Serve a valid sitemap at each declared address.", symptom=("invisible",))
def acc_009(ev: Evidence) -> DataFrame:
    records = ev.sitemaps.where(F.col("status").isNotNull() & ~F.col("status").isin(CLIENT_REFUSALS))
    declared = ev.declared.join(ev.sites.where("robots_ok").select("site_id"), "site_id")
    bad = is_error(F.col("status")) | (is_2xx(F.col("status")) & ~F.coalesce("parse_ok", F.lit(False)))
    answered = declared.join(records, ["site_id", "url"])
    counts = answered.groupBy("site_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("bad"), F.count_if(bad & (F.col("status") >= 500)).alias("bad_5xx"))
    return judged(
        by_site(ev, with_refs(counts, answered, bad, order="seq")),
        "ACC-009",
        F.col("bad") > 0,
        assessed=n("total") > 0,
        confidence=F.when(F.col("bad_5xx") > 0, "medium").otherwise("high"),
        breadth=F.when(F.col("bad") == F.col("total"), "site").otherwise("section"),
        affected=F.col("bad"),
        examined=F.col("total"),
        refs=F.col("urls"),
    )


# Rendering and extraction


def _compared_enough() -> Column:
    return F.col("js_render") & (n("n_comparable") >= 2)


def _rnd_001_unassessed(ev: Evidence) -> DataFrame:
    return unassessed_sites(by_site(ev, ev.pages.where(is_comparable()).groupBy("site_id").agg(F.count(F.lit(1)).alias("n_comparable"))), _compared_enough())


@rule("RND-001", "render-and-extraction", "Page text is assembled in the browser", "Put the text of these routes into the server's response.", blocking=True, effort="high", symptom=("invisible", "misrepresented"), unassessed=_rnd_001_unassessed)
def rnd_001(ev: Evidence) -> DataFrame:
    """Over the whole site if half of it depends on scripts, else by path section, else by page type."""
    inner = F.transform(F.slice(urls.segments(F.col("url")), F.lit(2), F.greatest(F.size(urls.segments(F.col("url"))) - 2, F.lit(0))), F.lower)
    pages = ev.pages.where(is_comparable()).select("site_id", "page_seq", "url", "page_type", "raw_len", js_dependent().alias("dep"), F.lower(urls.first_segment(F.col("url"))).alias("segment"), inner.alias("inner"))
    dep = F.col("dep")

    pages = landed(pages)

    def scope(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy("site_id", *by).agg(
            F.count_if("dep").alias("hit"),
            F.count(F.lit(1)).alias("members"),
            types_of(dep).alias("types"),
            F.bool_and(F.when(dep, F.col("raw_len") < EMPTY_TEXT)).alias("bare"),
            F.bool_or(dep & (F.col("page_type") == "home")).alias("home"),
        )

    def named(fired: DataFrame, rows: DataFrame, *by: str) -> DataFrame:
        """Only rows of groups that fire are looked at for addresses."""
        return with_refs(fired, rows.join(fired.select("site_id", *by), ["site_id", *by], "left_semi"), dep, *by)

    whole = (F.col("hit") >= 2) & (F.col("hit") * 2 >= F.col("members")) & (F.col("home") | (F.size("types") >= 2))
    all_pages = landed(scope(pages).withColumn("whole", whole))
    totals = all_pages.select("site_id", F.col("members").alias("n_comparable"))
    site = named(all_pages.where("whole"), pages).select("site_id", F.lit("site").alias("breadth"), "hit", "members", "types", "bare", "urls")
    rest = landed(pages.join(all_pages.where("not whole and hit > 0").select("site_id"), "site_id", "left_semi"))
    # inner segments that all hit pages of a section have: counted, so a section of any size is a few numbers
    hits = rest.where("dep and segment <> ''")
    size = hits.groupBy("site_id", "segment").agg(F.count(F.lit(1)).alias("_n"))
    held = hits.select("site_id", "segment", F.explode(F.array_distinct("inner")).alias("_part")).groupBy("site_id", "segment", "_part").agg(F.count(F.lit(1)).alias("_k"))
    shared = size.join(held, ["site_id", "segment"], "left").groupBy("site_id", "segment").agg(F.collect_list(F.when(F.col("_k") == F.col("_n"), F.col("_part"))).alias("shared"))
    in_section = landed(rest.join(shared, ["site_id", "segment"]).where(F.size(F.array_except("shared", "inner")) == 0).drop("shared", "inner"))
    enough = (F.col("hit") >= 2) & (F.col("hit") * 2 >= F.col("members"))
    sections = landed(scope(in_section, "segment").where(enough))
    covered = in_section.where("dep").join(sections.select("site_id", "segment"), ["site_id", "segment"], "left_semi").select("site_id", "url").distinct()
    left = rest.where(F.col("page_type").isin(PRIMARY_TYPES)).join(covered.withColumn("covered", F.lit(True)), ["site_id", "url"], "left")
    left = landed(left.withColumn("dep", F.col("dep") & F.col("covered").isNull()).withColumn("kind", F.col("page_type")).drop("inner", "covered"))
    kinds = scope(left, "kind").where((F.col("hit") >= 1) & ((F.col("kind") == "home") | enough))
    sections, kinds = named(sections, in_section, "segment"), named(kinds, left, "kind")
    parts = [d.select("site_id", F.lit("section").alias("breadth"), "hit", "members", "types", "bare", "urls") for d in (sections, kinds)]
    groups = site.unionByName(parts[0]).unionByName(parts[1])
    rows = by_site(ev, totals).join(groups, "site_id", "left")
    return judged(
        rows,
        "RND-001",
        F.col("hit").isNotNull(),
        assessed=_compared_enough(),
        confidence=F.when(F.col("bare"), "high").otherwise("medium"),
        breadth=F.col("breadth"),
        importance=primary_if_any(F.col("types")),
        affected=F.col("hit"),
        examined=F.col("members"),
        types=F.col("types"),
        refs=F.col("urls"),
    )


@rule("RND-002", "render-and-extraction", "Server responses carry almost no text", "Put the content into the server's response.", blocking=True, effort="high", symptom=("invisible",))
def rnd_002(ev: Evidence) -> DataFrame:
    pages = ev.pages.join(ev.sites.select("site_id", "soft404_hash"), "site_id")
    html = is_2xx(F.col("status")) & is_html()
    counts = pages.groupBy("site_id").agg(
        F.count_if(is_comparable()).alias("comparable"),
        F.count_if(html).alias("html"),
        F.bool_or(html & (F.col("page_type") == "home")).alias("home"),
        F.bool_and(F.when(html, server_text() < EMPTY_TEXT)).alias("thin"),
        F.bool_and(F.when(html, F.coalesce(F.col("raw_hash") == F.col("soft404_hash"), F.lit(False)))).alias("shell"),
        types_of(html).alias("types"),
    )
    return judged(
        by_site(ev, with_refs(counts, pages, html)),
        "RND-002",
        F.col("thin"),
        assessed=(n("comparable") == 0) & F.coalesce("home", F.lit(False)),
        confidence=F.when(F.col("shell"), "high").otherwise("medium"),
        importance="primary",
        affected=F.col("html"),
        examined=F.col("html"),
        types=F.col("types"),
        refs=F.col("urls"),
    )


@rule("RND-003", "render-and-extraction", "Prices appear only after scripts run", "Put the price, or an offer with a price, into the server's response.", blocking=True, effort="medium", symptom=("invisible", "misrepresented"))
def rnd_003(ev: Evidence) -> DataFrame:
    hit = F.col("late")
    eligible = ev.pages.select("site_id", "page_seq", "url", signal(ev.pages, "late_price").alias("late")).where("late is not null")
    counts = eligible.groupBy("site_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("hit"))
    return judged(
        by_site(ev, with_refs(counts, eligible, hit)),
        "RND-003",
        F.col("hit") >= 0.6 * F.col("total"),
        assessed=F.col("js_render") & (n("total") >= 5),
        confidence=F.when(F.col("total") >= 8, "high").otherwise("medium"),
        breadth="section",
        importance="primary",
        affected=F.col("hit"),
        examined=F.col("total"),
        types=F.array(F.lit("product")),
        refs=F.col("urls"),
    )


# Identity and markup


@rule("IDM-001", "identity-and-markup", "The home page does not say whose site it is", "Describe the organization in JSON-LD on the home page.")
def idm_001(ev: Evidence) -> DataFrame:
    ok = ev.pages.where(is_2xx(F.col("status")))
    org, person = signal(ev.pages, "org_node"), signal(ev.pages, "person_node")
    facts = F.struct("page_seq", F.coalesce("microdata", F.lit(False)).alias("microdata"), org.alias("org"), person.alias("person"), "url")
    counts = ok.groupBy("site_id").agg(F.min(F.when(F.col("page_type") == "home", facts)).alias("home"), F.bool_or((F.col("page_type") == "about") & org).alias("about_org"))
    host = urls.host(F.col("origin"))
    sub = (F.coalesce("domain", F.lit("")) != "") & (host != F.col("domain")) & (host != F.concat(F.lit("www."), F.col("domain")))
    judgeable = F.col("home").isNotNull() & ~F.col("home.microdata")
    said = F.col("home.org") | F.col("about_org") | F.col("home.person")
    return judged(
        by_site(ev, counts),
        "IDM-001",
        F.lit(True),
        passed=judgeable & said,
        assessed=judgeable & ~sub,
        affected=1,
        examined=1,
        types=F.array(F.lit("home")),
        refs=F.array("home.url"),
    )


@rule("IDM-002", "identity-and-markup", "sameAs does not lead to the organization's own profiles", "List the organization's real profile addresses, or drop the property.")
def idm_002(ev: Evidence) -> DataFrame:
    ok = ev.pages.where(is_2xx(F.col("status")))
    own = F.split("domain", r"\.")[0]
    told = ok.select("site_id", "page_seq", "url", "page_type", signal(ev.pages, "profiles").alias("p")).where("p is not null").join(ev.sites.select("site_id", own.alias("own")), "site_id")
    borrowed = F.exists("p.accounts", lambda a: a != F.coalesce("own", F.lit("")))
    per_page = told.groupBy("site_id", "page_seq", "url", "page_type").agg(F.bool_or("p.broken").alias("broken"), F.bool_or(borrowed).alias("borrowed"))
    counts = per_page.groupBy("site_id").agg(
        F.count_if("broken").alias("n_broken"),
        F.count_if("borrowed").alias("n_borrowed"),
        *[types_of(F.col(c)).alias(f"{c}_types") for c in ("broken", "borrowed")],
    )
    for c in ("broken", "borrowed"):
        counts = with_refs(counts, per_page, F.col(c)).withColumnRenamed("urls", f"{c}_urls")
    total = ok.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_ok"))
    first = F.col("n_broken") > 0
    pick = lambda what: F.when(first, F.col(f"broken_{what}")).otherwise(F.col(f"borrowed_{what}"))
    hit = F.when(first, F.col("n_broken")).otherwise(F.col("n_borrowed"))
    rows = by_site(ev, counts).join(total, "site_id", "left")
    return judged(
        rows,
        "IDM-002",
        hit > 0,
        assessed=F.col("n_broken").isNotNull(),
        breadth=F.when(F.array_contains(pick("types"), "home") | (hit * 2 >= F.col("n_ok")), "site").otherwise("page"),
        affected=hit,
        examined=F.col("n_ok"),
        types=pick("types"),
        refs=pick("urls"),
    )


def _ungated(gate: str) -> Callable[[Evidence], DataFrame]:
    """Sites of which no 2xx page has a node that passes the gate, which is a signal."""
    return lambda ev: unassessed_sites(by_site(ev, ev.pages.where(is_2xx(F.col("status"))).groupBy("site_id").agg(F.count_if(signal(ev.pages, gate)).alias("gated"))), n("gated") > 0)


def _over_nodes(ev: Evidence, gate: str, hit: str) -> DataFrame:
    """Counts of 2xx pages, of pages with a node that passes the gate, and of pages with a node that hits; both are signals."""
    seen = ev.pages.where(is_2xx(F.col("status"))).select("site_id", "page_seq", "url", "page_type", signal(ev.pages, gate).alias("gated"), signal(ev.pages, hit).alias("hit"))
    if gate not in ev.pages.columns:
        # counts and references read what was seen once
        seen = landed(seen)
    hit = F.col("hit")
    counts = seen.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_ok"), F.count_if("gated").alias("gated"), F.count_if(hit).alias("hit"), types_of(hit).alias("types"))
    return by_site(ev, with_refs(counts, seen, hit))


@rule("IDM-003", "identity-and-markup", "JSON-LD blocks do not parse", "Write JSON-LD with a JSON serializer.", unassessed=_ungated("any_node"))
def idm_003(ev: Evidence) -> DataFrame:
    rows = _over_nodes(ev, "any_node", "unparsed_node")
    return judged(rows, "IDM-003", F.col("hit") > 0, assessed=n("gated") > 0, breadth=breadth_by_share(F.col("hit"), F.col("n_ok")), affected=F.col("hit"), examined=F.col("gated"), types=F.col("types"), refs=F.col("urls"))


@rule("IDM-004", "identity-and-markup", "Marked-up prices contradict the prices shown", "Fill markup and page from the same price.", effort="medium", unassessed=_ungated("priced_node"))
def idm_004(ev: Evidence) -> DataFrame:
    rows = _over_nodes(ev, "priced_node", "contradicted_node")
    several = F.col("hit") >= 2
    return judged(
        rows,
        "IDM-004",
        F.col("hit") > 0,
        assessed=n("gated") > 0,
        confidence=F.when(several, "high").otherwise("medium"),
        breadth=F.when(several, "section").otherwise("page"),
        importance="primary",
        affected=F.col("hit"),
        examined=F.col("gated"),
        types=F.col("types"),
        refs=F.col("urls"),
    )


# Structure, freshness, latency


def _share(rows: DataFrame, hit: Column, *by: str) -> DataFrame:
    """Counts by group, and whether at least two and at least half of a group hit."""
    counts = rows.groupBy("site_id", *by).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("hit"))
    return with_refs(counts, rows, hit, *by).withColumn("fires", (F.col("hit") >= 2) & (F.col("hit") * 2 >= F.col("total")))


def _long_pages(ev: Evidence) -> DataFrame:
    return ev.pages.where(is_2xx(F.col("status")) & F.col("page_type").isin("article", "doc") & (F.col("words") >= LONG_WORDS) & ~signal(ev.pages, "news_node"))


def _long_by_site(long_pages: DataFrame) -> DataFrame:
    return long_pages.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_long"))


def _ans_001_unassessed(ev: Evidence) -> DataFrame:
    return unassessed_sites(by_site(ev, _long_by_site(_long_pages(ev))), n("n_long") >= 2)


@rule("ANS-001", "answerability", "Long pages have hardly any headings", "Divide long pages by descriptive headings.", status="proactive", effort="medium", symptom=("invisible",), unassessed=_ans_001_unassessed)
def ans_001(ev: Evidence) -> DataFrame:
    long_pages = landed(_long_pages(ev).select("site_id", "page_seq", "url", "page_type", "n_headings"))
    total = _long_by_site(long_pages)
    fired = _share(long_pages, F.col("n_headings") < FEW_HEADINGS, "page_type").where("fires")
    rows = by_site(ev, total).join(fired, "site_id", "left")
    return judged(
        rows, "ANS-001", F.col("fires"), assessed=n("n_long") >= 2, confidence="medium", breadth="section", affected=F.col("hit"), examined=F.col("total"), types=F.array("page_type"), refs=F.col("urls")
    )


def _articles(ev: Evidence) -> DataFrame:
    return ev.pages.where(is_2xx(F.col("status")) & (F.col("page_type") == "article") & (F.coalesce("type_confidence", F.lit(0.0)) >= SURE_ARTICLE) & readable_language())


def _article_rule(ev: Evidence, rule_id: str, articles: DataFrame, hit: Column) -> DataFrame:
    rows = by_site(ev, _share(articles, hit))
    return judged(
        rows, rule_id, F.col("fires"), assessed=n("total") >= 2, confidence="medium", breadth="section", affected=F.col("hit"), examined=F.col("total"), types=F.array(F.lit("article")), refs=F.col("urls")
    )


@rule("FRC-001", "freshness-and-corroboration", "Articles show no date", "Show a date on articles and mark it up.")
def frc_001(ev: Evidence) -> DataFrame:
    return _article_rule(ev, "FRC-001", _articles(ev), no_schema_dates() & (F.col("n_dates") == 0))


@rule("FRC-002", "freshness-and-corroboration", "A structured record disagrees with the founding year", "Correct whichever of the site and the record is wrong.", status="risk")
def frc_002(ev: Evidence) -> DataFrame:
    claims = ev.claims.where((F.col("kind") == "founded_year") & F.col("confidence").isin("high", "medium") & (F.col("ambiguity") != "high"))
    hits = ev.hits.where(F.col("origin") == STRUCTURED_RECORD).join(claims.select("site_id", F.col("id").alias("claim_id"), "confidence"), ["site_id", "claim_id"])
    first = F.min(F.when(~F.col("matches"), F.struct("seq", "confidence", "asserted")))
    counts = hits.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_hits"), first.alias("first"))
    return judged(
        by_site(ev, counts),
        "FRC-002",
        F.col("first").isNotNull(),
        assessed=F.col("egress") & F.col("attempted") & (n("n_hits") > 0),
        confidence=F.when(F.col("first.confidence") == "high", "medium").otherwise("low"),
        detail=F.col("first.asserted"),
    )


def _timed_pages(ev: Evidence) -> DataFrame:
    return ev.pages.where(is_2xx(F.col("status")) & F.col("ttfb").isNotNull())


def _arr_001_unassessed(ev: Evidence) -> DataFrame:
    return unassessed_sites(by_site(ev, _timed_pages(ev).groupBy("site_id").agg(F.count(F.lit(1)).alias("total"))), n("total") >= 5)


@rule("ARR-001", "arrival-and-engagement", "The server is slow to answer", "Find what holds up the first byte.", status="risk", effort="medium", category="engagement", symptom=("bounce",), unassessed=_arr_001_unassessed)
def arr_001(ev: Evidence) -> DataFrame:
    ms = F.col("ttfb") - F.coalesce("connect", F.lit(0.0))
    timed = _timed_pages(ev).withColumn("ms", ms)
    slow = F.col("ms") > POOR_MS
    counts = timed.groupBy("site_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(slow).alias("slow"), types_of(slow).alias("types"))
    counts = counts.join(shapes.exact_median(timed, ["site_id"], F.col("ms")), "site_id", "left")
    slowest = first_refs(timed.withColumn("fast", -F.col("ms")), slow, order="fast")
    return judged(
        by_site(ev, counts.join(slowest, "site_id", "left")),
        "ARR-001",
        F.col("median") > POOR_MS,
        assessed=n("total") >= 5,
        confidence="low",
        affected=F.col("slow"),
        examined=F.col("total"),
        types=F.col("types"),
        refs=F.reverse(F.col("refs.url")),
        detail=F.format_string("median %.0f ms", F.col("median")),
    )


# Recommendations


@rule("PRO-001", "audit-orchestrator", "No llms.txt is offered", "Publish an llms.txt that points to the key pages.", status="proactive", symptom=("invisible",))
def pro_001(ev: Evidence) -> DataFrame:
    entry = ev.well_known.where("path = '/llms.txt'").groupBy("site_id").agg(F.first("status").alias("status"), F.first("present").alias("present"))
    return judged(by_site(ev, entry), "PRO-001", ~F.col("present"), assessed=F.col("status").isNotNull(), confidence="low", breadth="page")


@rule("PRO-002", "audit-orchestrator", "Ask assistants a fixed panel of questions about the site", "Put the panel to assistants at intervals and compare answers.", status="proactive")
def pro_002(ev: Evidence) -> DataFrame:
    safe = ev.claims.where(F.col("confidence").isin("high", "medium") & F.col("kind").isin(list(QUESTION_KINDS)) & F.coalesce("value", F.lit("")).rlike(SAFE_VALUE))
    ranked = safe.withColumn("k", F.row_number().over(Window.partitionBy("site_id", "kind").orderBy("seq")))
    limits = F.create_map(*[F.lit(x) for pair in QUESTION_KINDS.items() for x in pair])
    kept = ranked.where(F.col("k") <= F.element_at(limits, F.col("kind")))
    last = (F.col("kind") == "product_name").cast("int")
    panel = F.array_sort(F.collect_list(F.struct(last.alias("last"), "seq", "kind", "value")))
    counts = kept.groupBy("site_id").agg(F.count_if(F.col("kind") == "legal_name").alias("names"), panel.alias("panel"))
    return judged(
        by_site(ev, counts),
        "PRO-002",
        F.lit(True),
        assessed=n("names") > 0,
        confidence="medium",
        detail=F.array_join(F.transform("panel", lambda x: F.concat(x["kind"], F.lit(": "), x["value"])), "; "),
    )


@rule("PRO-003", "audit-orchestrator", "The organization's description links to no profiles", "Add sameAs with the organization's profiles.", status="proactive")
def pro_003(ev: Evidence) -> DataFrame:
    ok = ev.pages.where(is_2xx(F.col("status")))
    anchor = F.col("page_type").isin("home", "about") & signal(ev.pages, "org_type")
    declares = signal(ev.pages, "same_as_node")
    counts = ok.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_ok"), F.min(F.when(anchor, F.struct("page_seq", "url", "page_type"))).alias("first"), F.bool_or(declares).alias("declares"))
    vague = ev.claims.where("kind = 'legal_name' and ambiguity = 'high'").select("site_id").distinct().withColumn("vague", F.lit(True))
    rows = by_site(ev, counts).join(vague, "site_id", "left")
    return judged(
        rows,
        "PRO-003",
        ~F.col("declares"),
        assessed=F.col("first").isNotNull(),
        confidence=F.when(F.col("vague"), "high").otherwise("medium"),
        affected=1,
        examined=F.col("n_ok"),
        types=F.array("first.page_type"),
        refs=F.array("first.url"),
    )


@rule("PRO-004", "audit-orchestrator", "Dated articles do not mark up their dates", "Mark up the dates that articles show.", status="proactive")
def pro_004(ev: Evidence) -> DataFrame:
    return _article_rule(ev, "PRO-004", _articles(ev).where("n_dates > 0"), no_schema_dates())


#: The rules of this module.
LIBRARY = dict(CATALOGUE)
