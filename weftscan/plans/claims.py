"""What sites say about themselves: candidates from markup, headings and text, and the claims promoted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types, fields and patterns that make a string a claim.
ORG_TYPES = """Organization Corporation LocalBusiness OnlineStore Store Brand NewsMediaOrganization EducationalOrganization NGO
    GovernmentOrganization Restaurant Hotel SportsOrganization MedicalOrganization""".split()
PRODUCT_TYPES = ["Product", "ProductGroup", "IndividualProduct", "Vehicle"]
ADDRESS_PARTS = ["streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry"]
YEAR = r"(?i)\b(?:since|established|est\.|founded(?:\s+in)?|serving\s+since)\s+((?:1[89]|20)\d{2})\b"
PRICE = r"(?:₹|Rs\.?|INR|US\$|\$|USD|€|EUR|£|GBP|¥|JPY)\s?\d[\d,]*(?:\.\d{1,2})?\b"
COUNT = (
    r"(?i)\b\d[\d,]*(?:\.\d+)?\s*(?:\+|plus|million|billion|k|lakh|crore)?\s+"
    r"(?:customers|users|clients|downloads|installs|products|items|stores|outlets|branches|countries|cities|projects|reviews|"
    r"ratings|members|partners|employees|years\s+of\s+experience)\b"
)
YEAR_INSIDE = r"((?:1[89]|20)\d{2})"
FOUNDING = r"(?:founded|established|inception|launched|formed|started|since|est\.)"
CORROBORABLE = ["legal_name", "tagline", "founded_year", "address", "product_name"]
GENERIC_WORDS = "home shop store online official site website company india usa uk group limited ltd inc llc pvt".split()
SOURCE_TYPES = {
    "encyclopedic": "wikidata.org wikipedia.org dbpedia.org britannica.com",
    "directory": "web.archive.org",
    "social": "twitter.com x.com facebook.com instagram.com linkedin.com youtube.com tiktok.com pinterest.com threads.net",
    "retailer": "amazon.com amazon.in flipkart.com ebay.com etsy.com myntra.com ajio.com walmart.com",
    "review": "trustpilot.com g2.com capterra.com yelp.com glassdoor.com",
    "forum": "reddit.com quora.com stackexchange.com stackoverflow.com",
}
PRESS_WORDS = "news times post herald journal express tribune gazette wire".split()


def one_line(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def normal_value(value: Column) -> Column:
    """One line, without punctuation around it, in lower case with sharp s as ss."""
    bare = F.regexp_replace(one_line(value), "^[.,;:!–—\\- ]+|[.,;:!–—\\- ]+$", "")
    return F.regexp_replace(F.lower(bare), "ß", "ss")


def observations(pages: DataFrame) -> DataFrame:
    """(site_id, page_seq, step, at, kind, value_raw, value_normalized, source_url, locator, extraction_method) of 2xx pages.

    ``pages`` has site_id, page_seq, url, status, page_type, nodes, headings and text (rendered if there is any). Within a
    page, markup comes before headings and headings before text; step and at keep the order.
    """
    ok = pages.where(F.col("status").between(200, 299))
    row = lambda kind, raw, locator: F.struct(kind.alias("kind"), raw.alias("raw"), locator.alias("locator"))
    nodes = ok.select("site_id", "page_seq", "url", F.posexplode("nodes").alias("i", "x"))
    pairs = nodes.select("site_id", "page_seq", "url", "i", "x.type", F.posexplode(F.array_sort(F.map_entries("x.vals"))).alias("j", "e"))
    leaf = F.substring_index("e.key", ".", -1)
    founded = F.regexp_extract("e.value", YEAR_INSIDE, 1)
    kind = (
        F.when((leaf == "legalName") | (F.col("e.key") == "brand.name"), "legal_name")
        .when((F.col("e.key") == "name") & F.col("type").isin(ORG_TYPES), "legal_name")
        .when((F.col("e.key") == "name") & F.col("type").isin(PRODUCT_TYPES), "product_name")
        .when(leaf == "slogan", "tagline")
        .when((leaf == "foundingDate") & (founded != ""), "founded_year")
        .when(leaf == "price", "price")
    )
    marked = pairs.select(
        "site_id", "page_seq", "url", F.lit(0).alias("step"), F.format_string("%06d.%06d", "i", "j").alias("at"), F.lit("jsonld").alias("method"),
        row(kind, F.when(kind == "founded_year", founded).otherwise(F.col("e.value")), F.col("e.key")).alias("c"),
    )
    parts = pairs.where(leaf.isin(ADDRESS_PARTS)).groupBy("site_id", "page_seq", "url", "i").agg(F.array_sort(F.collect_list(F.struct("j", "e.value"))).alias("p"))
    address = parts.select(
        "site_id", "page_seq", "url", F.lit(0).alias("step"), F.format_string("%06d.999999", "i").alias("at"), F.lit("jsonld").alias("method"),
        row(F.lit("address"), F.array_join(F.transform("p", lambda x: x["value"]), ", "), F.lit("address")).alias("c"),
    )
    h1 = F.get(F.filter("headings", lambda h: (h["level"] == 1) & (h["text"] != "")), F.lit(0))["text"]
    headed = F.when(F.col("page_type") == "product", "product_name").when((F.col("page_type") == "home") & (F.length(h1) <= 80), "tagline")
    heading = ok.select("site_id", "page_seq", "url", F.lit(1).alias("step"), F.lit("").alias("at"), F.lit("visible_text").alias("method"), row(headed, h1, F.lit("h1")).alias("c"))
    text = F.coalesce("text", F.lit(""))
    families = [("founded_year", YEAR, 1), ("price", PRICE, 0), ("numeric_claim", COUNT, 0)]
    each = lambda k, p, g: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda v: row(F.lit(k), v, F.lit("text")))
    found = F.flatten(F.array(*[each(*f) for f in families]))
    written = ok.select("site_id", "page_seq", "url", F.posexplode(found).alias("at", "c")).select(
        "site_id", "page_seq", "url", F.lit(2).alias("step"), F.format_string("%06d", "at").alias("at"), F.lit("visible_text").alias("method"), "c"
    )
    rows = marked.unionByName(address).unionByName(heading).unionByName(written).where("c.kind is not null and c.raw is not null")
    raw = one_line(F.col("c.raw"))
    clean = rows.select("site_id", "page_seq", "step", "at", F.col("c.kind").alias("kind"), raw.alias("value_raw"), normal_value(raw).alias("value_normalized"), F.col("url").alias("source_url"), F.col("c.locator").alias("locator"), F.col("method").alias("extraction_method"))
    return clean.where((F.col("value_normalized") != "") & (F.length("value_raw") <= 200))


def _first(rows: DataFrame, order: list, limit: int | None, beyond: str) -> DataFrame:
    """``rows`` of each site numbered by ``order`` (seq), the first ``limit`` of them (None: all), and in the column ``beyond`` how many more there are."""
    ranked = rows.withColumn("seq", F.row_number().over(Window.partitionBy("site_id").orderBy(*order)))
    if limit is None:
        return ranked.withColumn(beyond, F.lit(0).cast("long"))
    more = rows.groupBy("site_id").agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0).cast("long")).alias(beyond))
    return ranked.where(F.col("seq") <= limit).join(more, "site_id")


def candidates(observed: DataFrame, cap: int | None = 200) -> DataFrame:
    """One row for each site, kind and value: where it was first seen, how often, and an id in order of kind and count.

    At most ``cap`` rows for each site (None: all); the column dropped says how many there were beyond.
    """
    first = F.min(F.struct("page_seq", "step", "at", "value_raw", "source_url", "locator", "extraction_method"))
    grouped = observed.groupBy("site_id", "kind", "value_normalized").agg(F.count(F.lit(1)).alias("observed_count"), first.alias("f"))
    return _first(grouped, ["kind", F.desc("observed_count"), "value_normalized"], cap, "dropped").select(
        "site_id", "seq", F.format_string("CC-%03d", "seq").alias("id"), "kind", "f.value_raw", "value_normalized", "f.source_url", "f.locator", "f.extraction_method", "observed_count", "dropped"
    )


def ambiguity(kind: Column, value: Column) -> Column:
    """How likely a legal name names something else: by how many distinctive words it has and how long a lone one is."""
    words = F.filter(F.split(F.trim(value), r"\s+"), lambda w: (w != "") & ~w.isin(GENERIC_WORDS))
    lone = F.size(words) == 1
    return F.when(kind != "legal_name", "low").when((F.size(words) == 0) | (lone & (F.length(F.get(words, F.lit(0))) <= 5)), "high").when(lone, "medium").otherwise("low")


def promote(found: DataFrame, limit: int | None = 12) -> DataFrame:
    """Claims worth checking, legal names first, marked-up ones before others: the first ``limit`` of each site (None: all); beyond says how many more there are."""
    kept = found.where(F.col("kind").isin(CORROBORABLE))
    marked = F.col("extraction_method") == "jsonld"
    grouped = kept.groupBy("site_id", "kind", "value_normalized").agg(F.bool_or(marked).alias("marked"), F.sum("observed_count").alias("total"), F.array_sort(F.collect_set("id")).alias("from_candidates"))
    repeated = F.col("total") >= 2
    confidence = (
        F.when((F.col("kind") == "founded_year") & ~F.col("marked"), "low").when(F.col("marked") & repeated, "high").when(F.col("marked") | repeated, "medium").otherwise("low")
    )
    order = [F.col("kind") != "legal_name", ~F.col("marked"), F.desc("total"), "kind", "value_normalized"]
    return _first(grouped, order, limit, "beyond").select(
        "site_id", "seq", F.format_string("C-%03d", "seq").alias("id"), "from_candidates", "kind", F.col("value_normalized").alias("value"), confidence.alias("confidence"), ambiguity(F.col("kind"), F.col("value_normalized")).alias("ambiguity"), "beyond"
    )


def asserts(text: Column, kind: Column, value: Column) -> Column:
    """Whether a text states a claim: contains it, or for a founding year has it close behind a founding word."""
    body, wanted = F.lower(one_line(text)), F.lower(one_line(value))
    quoted = F.regexp_replace(wanted, r"([\\.\[\](){}+*?^|$])", r"\\$1")
    year = F.regexp_like(body, F.concat(F.lit(FOUNDING + r"\D{0,40}"), quoted))
    return F.coalesce((wanted != "") & (body != "") & F.when(kind == "founded_year", year).otherwise(body.contains(wanted)), F.lit(False))


def window_around(text: Column, value: Column, width: int = 200) -> Column:
    """``width`` characters of a text around a value, or nothing."""
    at = F.position(F.lower(one_line(value)), F.lower(one_line(text)))
    return F.when(at > 0, F.substring(text, F.greatest(at - width // 2, F.lit(1)), F.lit(width))).otherwise(F.lit(""))


def origin_type(domain: Column) -> Column:
    """The kind of source that a registrable domain is."""
    kind = F.when(F.lit(False), "")
    for name, domains in SOURCE_TYPES.items():
        for d in domains.split():
            kind = kind.when((domain == d) | domain.endswith("." + d), name)
    press = domain.contains(".")
    words = F.lit(False)
    for w in PRESS_WORDS:
        words = words | domain.contains(w)
    return kind.when(press & words, "news").otherwise("directory")


def external_hits(claims: DataFrame, documents: DataFrame, cap: int | None = 60) -> DataFrame:
    """Landed third-party ``documents`` (site_id, origin, url, text) against ``claims``: what each says, the first ``cap`` of a site (None: all).

    beyond says how many more there are. A join on site_id; documents of a site are few by the way they are landed.
    """
    joined = claims.join(documents, "site_id")
    said = F.substring(one_line(window_around(F.col("text"), F.col("value"))), 1, 400)
    hits = joined.select("site_id", F.col("id").alias("claim_id"), "origin", "url", said.alias("asserted"), asserts(F.col("text"), F.col("kind"), F.col("value")).alias("matches")).where("asserted <> ''")
    return _first(hits, ["claim_id", "origin", "url"], cap, "beyond")


def structured_hits(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Landed ``entities`` (site_id, url, label, inception, official_domain, site_domain) against names and founding years.

    Only an entity whose official domain is the site's own is this organization.
    """
    own = entities.where(F.col("official_domain") == F.col("site_domain"))
    joined = claims.where(F.col("kind").isin("legal_name", "founded_year")).join(own, "site_id")
    year = F.substring(F.regexp_replace("inception", r"^\++", ""), 1, 4)
    name = F.col("kind") == "legal_name"
    matches = F.when(name, F.lower(one_line(F.col("label"))).contains(F.lower(one_line(F.col("value"))))).otherwise(year == F.col("value"))
    said = F.when(name, F.col("label")).otherwise(F.concat(F.lit("inception "), year))
    return joined.where(said.isNotNull() & (said != "")).select("site_id", F.col("id").alias("claim_id"), F.lit("wikidata.org").alias("origin"), "url", said.alias("asserted"), matches.alias("matches"))


def declared_profiles(pages: DataFrame, limit: int | None = 8) -> DataFrame:
    """(site_id, seq, profile, beyond): the first distinct absolute addresses in sameAs over a site's pages (None: all), and how many more there are."""
    nodes = pages.select("site_id", "page_seq", F.posexplode("nodes").alias("i", "x"))
    same = nodes.select("site_id", "page_seq", "i", F.explode(F.map_entries("x.vals")).alias("e")).where(F.regexp_replace("e.key", r"\..*$", "") == "sameAs")
    each = same.select("site_id", "page_seq", "i", F.posexplode(F.split("e.value", r" \| ")).alias("j", "p")).select("site_id", "page_seq", "i", "j", F.trim("p").alias("profile"))
    first = each.where(F.col("profile").rlike(r"(?i)^https?://")).groupBy("site_id", "profile").agg(F.min(F.struct("page_seq", "i", "j")).alias("at"))
    return _first(first, ["at"], limit, "beyond").select("site_id", "seq", "profile", "beyond")
