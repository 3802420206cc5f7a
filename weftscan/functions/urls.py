"""URL functions as native column expressions over absolute http(s) URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-label public suffixes, tracking parameters.
TWO_LABEL_SUFFIXES = """
co.uk org.uk ac.uk gov.uk ltd.uk plc.uk me.uk net.uk sch.uk
com.au net.au org.au edu.au gov.au
co.in net.in org.in firm.in gen.in ind.in ac.in edu.in gov.in res.in
co.jp ne.jp or.jp ac.jp go.jp
co.nz org.nz net.nz ac.nz govt.nz
com.br net.br org.br gov.br
com.cn net.cn org.cn gov.cn edu.cn
com.mx org.mx gob.mx
co.za org.za gov.za
com.sg edu.sg gov.sg
com.tr org.tr gov.tr
co.kr or.kr go.kr
com.hk org.hk com.tw org.tw
co.id or.id go.id com.my org.my gov.my com.ph gov.ph
com.ar gob.ar com.pk org.pk co.il org.il ac.il com.sa gov.sa
com.eg com.ng co.th or.th ac.th go.th com.vn com.ua co.ke
com.co com.pe com.ec com.uy
""".split()
TRACKING_NAMES = ["gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "_ga", "yclid"]
TRACKING_PREFIX = "utm_"

DEFAULT_PORTS = {"http": 80, "https": 443}
#: Characters that browsers drop wherever they stand in an address.
DROPPED = dict.fromkeys(map(ord, "\t\r\n"))
URL_PATTERN = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.translate(F.trim(url), "\t\r\n", ""), URL_PATTERN, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return F.lower(_part(url, 2))


def host(url: Column) -> Column:
    """The host without user info, port and brackets."""
    bare = F.regexp_replace(netloc(url), r"^.*@", "")
    return F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":\d*$", ""))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(_part(url, 3), F.lit("")), F.lit("/"))


def query(url: Column) -> Column:
    return _part(url, 4)


def path_and_query(url: Column) -> Column:
    """What robots rules are matched against."""
    return F.concat(path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit("")))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def normalise(url: Column) -> Column:
    """The form under which addresses are compared; null where there is no http(s) address.

    Two spellings of one address come out equal: case of scheme and host, white space inside, user info, a
    port that is the scheme's own or has leading zeros, tracking parameters and the fragment make no difference.
    Everything a server could tell apart is kept.
    """
    digits = F.regexp_extract(netloc(url), r":(\d+)$", 1)
    port = F.when(F.length(digits) <= 18, digits.try_cast("bigint"))
    bracketed = F.when(host(url).contains(":"), F.concat(F.lit("["), host(url), F.lit("]"))).otherwise(host(url))
    own = F.create_map(*[F.lit(x) for pair in DEFAULT_PORTS.items() for x in pair])
    place = F.when((digits == "") | port.eqNullSafe(F.try_element_at(own, scheme(url))), bracketed).otherwise(F.concat(bracketed, F.lit(":"), port.cast("string")))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~name(p).isin(TRACKING_NAMES) & ~name(p).startswith(TRACKING_PREFIX))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    written = F.regexp_replace(netloc(url), r"^.*@", "").rlike(r"^(\[[^\]]*\]|[^:\[\]]*)(:\d*)?$")
    valid = scheme(url).isin(*DEFAULT_PORTS) & (host(url) != "") & written & ((digits == "") | F.coalesce(port <= 65535, F.lit(False)))
    return F.when(valid, F.concat(scheme(url), F.lit("://"), place, path(url), tail))


def is_ip(host_name: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    bare = F.regexp_replace(host_name, r"^\[|\]$", "")
    return bare.rlike(rf"^{octet}(?:\.{octet}){{3}}$") | (bare.contains(":") & bare.rlike(r"^[0-9A-Fa-f:.]+$"))


def registrable_domain(host_name: Column) -> Column:
    """The last two labels, or three after a listed two-label suffix; IPs and single labels pass through."""
    h = F.regexp_replace(F.lower(F.coalesce(host_name, F.lit(""))), r"\.+$", "")
    labels = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    three = (F.size(labels) >= 3) & last(2).isin(TWO_LABEL_SUFFIXES)
    return F.when((h == "") | is_ip(h) | ~h.contains("."), h).when(three, last(3)).otherwise(last(2))


def twin_netloc(value: Column) -> Column:
    """``www.`` added or removed; null for IPs and single labels."""
    name = F.substring_index(value, ":", 1)
    port = F.substring(value, F.length(name) + 1, F.length(value))
    twin = F.when(name.startswith("www."), F.substring(name, F.lit(5), F.length(name))).otherwise(F.concat(F.lit("www."), name))
    return F.when(~is_ip(name) & name.contains("."), F.concat(twin, port))


def with_netloc(url: Column, place: Column) -> Column:
    return F.concat(_part(url, 1), F.lit("://"), place, _part(url, 3), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit("")))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def first_segment(url: Column) -> Column:
    return F.coalesce(F.get(segments(url), F.lit(0)), F.lit(""))


def inner_segments(url: Column) -> Column:
    """All segments but the last one."""
    return F.slice(segments(url), F.lit(1), F.greatest(F.size(segments(url)) - 1, F.lit(0)))


def section_of(url: Column) -> Column:
    """(first segment if there are more, depth)."""
    return F.struct(F.when(F.size(segments(url)) > 1, first_segment(url)).otherwise(F.lit("")).alias("section"), F.size(segments(url)).alias("depth"))


def is_page_address(url: Column) -> Column:
    """False for addresses of feeds, archives, images and other resources."""
    return ~F.lower(path(url)).rlike(NON_PAGE)


# Page types and the words of a path that name them.
PAGE_TYPES = ["home", "product", "category", "article", "about", "contact", "policy", "doc", "other"]
HOME_PATHS = ["/", "/index.html", "/index.htm", "/index.php", "/home", "/default.aspx"]
SEGMENT_WORDS = {
    "policy": """privacy privacy-policy terms terms-of-service terms-and-conditions tos legal cookie-policy cookies cookie
        policies policy returns return-policy refund refund-policy refunds shipping shipping-policy disclaimer imprint
        impressum warranty grievance grievances grievance-redressal""".split(),
    "product": "product products p item items dp sku".split(),
    "category": "collections collection category categories c catalog catalogue department departments browse shop".split(),
    "article": "blog blogs news article articles post posts stories story insights press press-releases magazine journal".split(),
    "doc": """docs doc documentation help guide guides api reference manual faq faqs kb knowledge-base support learn
        tutorial tutorials""".split(),
    "about": "about about-us aboutus about_us company who-we-are our-story team our-team mission".split(),
    "contact": "contact contact-us contactus locations store-locator find-us".split(),
}
LEADING_WORDS = {
    "about": "about", "contact": "contact", "privacy": "policy", "terms": "policy", "blog": "article", "faq": "doc",
    "help": "doc", "docs": "doc", "shipping": "policy", "returns": "policy", "refund": "policy",
}
POLICY_WORDS = ["warranty", "grievance", "grievances"]
AMBIGUOUS_POLICY = "cookies cookie shipping returns refund refunds legal terms warranty grievance grievances".split()
POLICY_DEPTH = 2
LOCALE = r"^[a-z]{2}(?:[-_][a-z]{2})?$"
DATED = r"/(?:19|20)\d{2}/(?:0?[1-9]|1[0-2])(?:/|$)"
EXTENSION = r"\.(?:html?|php|aspx?|jsp)$"
NON_PAGE = r"\.(?:xml|xml\.gz|rss|atom|json|txt|gz|zip|pdf|docx?|xlsx?|csv|jpe?g|png|gif|svg|webp|avif|ico|mp[34]|m4a|webm|mov|css|js)$"
DECLARED_TYPES = {
    "Product": "product", "ProductGroup": "product", "IndividualProduct": "product", "Article": "article", "NewsArticle": "article",
    "BlogPosting": "article", "Report": "article", "CollectionPage": "category", "AboutPage": "about", "ContactPage": "contact",
    "FAQPage": "doc", "HowTo": "doc", "TechArticle": "doc", "ItemList": "category",
}


def page_type(url: Column) -> Column:
    """struct(page_type, confidence) from the URL alone.

    In order: home paths and lone locales; whole segments, by type; leading words of a segment, by
    segment; policy words inside shallow segments; dated paths. Ambiguous policy words count only near the root.
    """
    p = F.lower(path(url))
    parts = F.transform(F.filter(F.split(p, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, EXTENSION, ""))
    shallow = F.size(parts) <= POLICY_DEPTH
    strict = [w for w in SEGMENT_WORDS["policy"] if w not in AMBIGUOUS_POLICY]
    answer = lambda kind, confidence: F.struct(kind.alias("page_type"), F.lit(confidence).alias("confidence"))
    home = p.isin(HOME_PATHS) | ((F.size(parts) == 1) & F.element_at(F.concat(parts, F.array(F.lit(""))), 1).rlike(LOCALE))
    found = F.when(home, answer(F.lit("home"), 0.95))
    for kind, names in SEGMENT_WORDS.items():
        hit = F.arrays_overlap(parts, F.array(*map(F.lit, names)))
        if kind == "policy":
            hit = F.when(shallow, hit).otherwise(F.exists(parts, lambda s: s.isin(strict)))
        found = found.when(hit, answer(F.lit(kind), 0.6))
    lead = lambda s: F.substring_index(s, "-", 1)
    usable = lambda s: lead(s).isin(list(LEADING_WORDS)) & (shallow | ~lead(s).isin([w for w, k in LEADING_WORDS.items() if k == "policy" and w in AMBIGUOUS_POLICY]))
    first = F.get(F.filter(parts, usable), F.lit(0))
    kinds = F.create_map(*[F.lit(x) for pair in LEADING_WORDS.items() for x in pair])
    found = found.when(first.isNotNull(), answer(F.try_element_at(kinds, lead(first)), 0.6))
    inside = F.exists(parts, lambda s: F.arrays_overlap(F.split(s, "[-_]"), F.array(*map(F.lit, POLICY_WORDS))))
    found = found.when(shallow & inside, answer(F.lit("policy"), 0.6)).when(p.rlike(DATED), answer(F.lit("article"), 0.6))
    return found.otherwise(answer(F.lit("other"), 0.3))


def refined_type(kind: Column, confidence: Column, declared: Column) -> Column:
    """struct(page_type, confidence) after the types that the page declares: subjects before structures, home stays."""
    kinds = F.create_map(*[F.lit(x) for pair in DECLARED_TYPES.items() for x in pair])
    mapped = F.filter(F.transform(F.coalesce(declared, F.array().cast("array<string>")), lambda d: F.try_element_at(kinds, d)), lambda d: d.isNotNull())
    subject = F.get(F.filter(mapped, lambda m: m.isin("product", "article")), F.lit(0))
    chosen = F.coalesce(subject, F.get(mapped, F.lit(0)))
    sure = F.when(chosen == kind, 0.9).when(kind == "other", 0.8).otherwise(0.7)
    stays = (kind == "home") | chosen.isNull()
    return F.struct(F.when(stays, kind).otherwise(chosen).alias("page_type"), F.when(stays, confidence).otherwise(sure).alias("confidence"))
