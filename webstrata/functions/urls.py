"""URL splitting, normalisation, resolution, classification and scoring."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# RFC 3986 appendix B, with the scheme limited to legal characters.
_SCHEME = r"(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
URL_PATTERN = rf"(?s)^{_SCHEME}(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
HOST_PATTERN = (
    r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"
)
PORT_PATTERN = (
    r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?"
    r"(?:\[[^\]/?#]*\]|[^:/?#]*):([0-9]+)"
)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once.

    Inside higher-order functions Spark does not share repeated subexpressions,
    so a value that is read several times goes through a one-element array.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns that later filters may read without computing them again.

    A plain projection would be copied into every filter pushed below it; the
    generator in between stops that and evaluates each column once per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# ---------------------------------------------------------------- splitting

def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PATTERN, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 5)


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def hostname(url: Column) -> Column:
    """Lower-cased host without port, user info or IPv6 brackets; '' if none."""
    return F.lower(
        F.regexp_replace(F.regexp_extract(url, HOST_PATTERN, 1), r"[\[\]]", "")
    )


def port(url: Column) -> Column:
    """Explicit port as text, '' if none."""
    return F.regexp_extract(url, PORT_PATTERN, 1)


def extract_domain(url: Column, include_scheme: bool = False) -> Column:
    host = hostname(url)
    if not include_scheme:
        return host
    bracketed = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    suffix = F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise("")
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(scheme(url), F.lit("://"), bracketed, suffix)
    )


def is_same_origin(left: Column, right: Column) -> Column:
    return (scheme(left) == scheme(right)) & (
        F.lower(netloc(left)) == F.lower(netloc(right))
    )


# ------------------------------------------------------------ normalisation

def fold_segments(raw_path: Column) -> Column:
    """Collapse empty, ``.`` and ``..`` segments of an absolute path.

    The accumulator is a plain string, so the fold is one higher-order
    expression; result has no trailing slash and is '' for the root.
    """
    return F.aggregate(
        F.split(raw_path, "/"),
        F.lit(""),
        lambda acc, seg: F.when(seg.isin("", "."), acc)
        .when(seg == "..", F.regexp_replace(acc, r"/[^/]*$", ""))
        .otherwise(F.concat(acc, F.lit("/"), seg)),
    )


def clean_path(raw_path: Column) -> Column:
    """Dot segments collapsed and trailing slash dropped; the root stays '/'."""
    # The fold is interpreted, so only paths that need it take that branch.
    needs_fold = raw_path.rlike(r"//|/\.")
    lead = F.when(raw_path.rlike(r"^//(?:[^/]|$)"), F.lit("/")).otherwise("")
    absolute = F.concat(lead, fold_segments(raw_path))
    folded = F.when(raw_path.startswith("/"), absolute).otherwise(
        F.regexp_replace(absolute, "^/", "")
    )
    trimmed = F.regexp_replace(raw_path, r"/$", "")
    return F.coalesce(
        F.nullif(F.when(needs_fold, folded).otherwise(trimmed), F.lit("")), F.lit("/")
    )


def sort_params(raw_query: Column) -> Column:
    return F.when(
        raw_query.contains("&"),
        F.array_join(F.array_sort(F.split(raw_query, "&")), "&"),
    ).otherwise(raw_query)


def normalize_url(url: Column, ignore_query: bool = False) -> Column:
    """Crawl-time key of a URL: two spellings of one page give one value."""
    sch, host, prt = scheme(url), hostname(url), port(url)
    default_port = ((sch == "http") & (prt.rlike("^0*80$"))) | (
        (sch == "https") & (prt.rlike("^0*443$"))
    )
    loc = F.when((prt == "") | default_port, host).otherwise(
        F.concat(host, F.lit(":"), F.regexp_replace(prt, r"^0+(?=[0-9])", ""))
    )
    whole = path(url)
    params = F.regexp_extract(whole, r";([^/]*)$", 1)
    plain = F.regexp_replace(whole, r";[^/]*$", "")
    qs = F.lit("") if ignore_query else sort_params(query(url))
    return F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(""),
        F.when(loc != "", F.concat(F.lit("//"), loc)).otherwise(""),
        clean_path(plain),
        F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""),
        F.when(qs != "", F.concat(F.lit("?"), qs)).otherwise(""),
    )


def cache_url(url: Column) -> Column:
    """Cache key form: lower-cases everything but the fragment, which it keeps."""
    low_path = F.lower(path(url))
    trimmed = F.when(low_path == "/", low_path).otherwise(
        F.regexp_replace(low_path, r"/+$", "")
    )
    qs, frag = sort_params(F.lower(query(url))), fragment(url)
    return F.concat(
        scheme(url), F.lit("://"), F.lower(netloc(url)), trimmed,
        F.when(qs != "", F.concat(F.lit("?"), qs)).otherwise(""),
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(""),
    )


SCHEME_START = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def base_parts(base: Column) -> Column:
    """What joining needs from a base URL, taken apart once per page."""
    whole, b_query = path(base), query(base)
    return F.struct(
        base.alias("url"), scheme(base).alias("scheme"),
        F.concat(scheme(base), F.lit("://"), netloc(base)).alias("origin"),
        whole.alias("path"),
        F.when(whole == "", F.lit("/")).otherwise(F.regexp_replace(whole, r"[^/]*$", "")).alias("folder"),
        F.when(b_query != "", F.concat(F.lit("?"), b_query)).otherwise("").alias("query"),
    )


def join_base(ref: Column, base: Column) -> Column:
    """Join of a fragment-free reference with ``base_parts``; an empty one keeps
    path and query of the base. Plain substring work, regex only for dots."""
    ref_path = F.substring_index(ref, "?", 1)
    rest = F.substring(ref, F.length(ref_path) + 1, F.length(ref))
    tail = F.when(rest == "?", F.lit("")).otherwise(rest)
    merged = F.when(ref_path.startswith("/"), ref_path).otherwise(F.concat(base["folder"], ref_path))
    folded = bind(merged, lambda m: F.when(
        m.contains("//") | m.contains("/."),
        F.concat(fold_segments(m), F.when(m.rlike(r"/\.{0,2}$"), F.lit("/")).otherwise("")),
    ).otherwise(m))
    return (
        F.when(ref == "", F.concat(base["origin"], base["path"], base["query"]))
        .when(ref.rlike(SCHEME_START), ref)
        .when(ref.startswith("//"), F.concat(base["scheme"], F.lit(":"), ref))
        .when(ref.startswith("?"), F.concat(base["origin"], base["path"], F.when(rest == "?", base["query"]).otherwise(rest)))
        .otherwise(F.concat(base["origin"], folded, tail))
    )


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` as seen from ``base``."""
    ref = F.substring_index(href, "#", 1)
    mark = F.substring(href, F.length(ref) + 1, F.length(href))
    joined = bind(base_parts(base), lambda b: F.concat(
        join_base(ref, b), F.when(mark == "#", F.lit("")).otherwise(mark)
    ))
    return F.when(href == "", base).otherwise(joined)


# ------------------------------------------------- predicates and classes

# Address blocks and addresses that must never be fetched.
PRIVATE_V4_BLOCKS = [
    ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8),
    ("169.254.0.0", 16), ("0.0.0.0", 8), ("100.64.0.0", 10), ("198.18.0.0", 15),
    ("240.0.0.0", 4),
]
METADATA_V4 = ["169.254.169.254", "100.100.100.200"]
METADATA_V6 = ["fd00:ec2::254"]
PRIVATE_SUFFIXES = [".docker.internal"]

V4_PATTERN = (
    r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
)


def v4_to_int(dotted: str) -> int:
    value = 0
    for part in dotted.split("."):
        value = value * 256 + int(part)
    return value


def v4_number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.coalesce(
            F.try_element_at(parts, F.lit(i + 1)).try_cast("long"), F.lit(0).cast("long")
        )
    return F.when(host.rlike(V4_PATTERN), number)


def is_private_address(host: Column) -> Column:
    """True/false for an address literal, NULL for a name."""
    def v4(number: Column) -> Column:
        in_block = host.isin(METADATA_V4)
        for first, bits in PRIVATE_V4_BLOCKS:
            low = v4_to_int(first)
            in_block = in_block | number.between(low, low + 2 ** (32 - bits) - 1)
        return in_block

    # The first 16 bits decide the v6 blocks: fc00::/7 and fe80::/10.
    v6 = (
        host.rlike(r"^::0{0,3}1$|^(?:0{1,4}:){7}0{0,3}1$")
        | host.rlike(r"^f[cd][0-9a-f]{2}:")
        | host.rlike(r"^fe[89ab][0-9a-f]:")
        | host.isin(METADATA_V6)
    )
    return F.when(host.rlike(V4_PATTERN), bind(v4_number(host), v4)).when(host.contains(":"), v6)


def is_private_name(host: Column, resolved_private: Column | None = None) -> Column:
    """Guard for hosts that must not be fetched.

    Names are not looked up here. ``resolved_private`` carries the answer of a
    supplied host table (NULL where the host is missing, which counts as
    private, like a name that cannot be resolved).
    """
    suffix_hit = F.lit(False)
    for suffix in PRIVATE_SUFFIXES:
        suffix_hit = suffix_hit | host.endswith(suffix)
    named = F.lit(False) if resolved_private is None else F.coalesce(resolved_private, F.lit(True))
    return (
        F.when((host == "") | suffix_hit, F.lit(True))
        .otherwise(F.coalesce(is_private_address(host), named))
    )


def is_private_host(url: Column, resolved_private: Column | None = None) -> Column:
    return is_private_name(hostname(url), resolved_private)


def is_subdomain(host: Column, base: Column) -> Column:
    return (host != base) & host.endswith(F.concat(F.lit("."), base))


def host_class(host: Column, base: Column) -> Column:
    return (
        F.when((host == "") | (host == base), F.lit("internal"))
        .when(is_subdomain(host, base), F.lit("subdomain"))
        .otherwise(F.lit("external"))
    )


def classify_link(dst: Column, base_host: Column) -> Column:
    return host_class(hostname(dst), F.lower(base_host))


def scope_classes(subdomains: bool = False, external: bool = False) -> list[str]:
    return ["internal"] + ["subdomain"] * subdomains + ["external"] * external


def in_scope(dst: Column, base_host: Column, subdomains: bool = False, external: bool = False) -> Column:
    return classify_link(dst, base_host).isin(scope_classes(subdomains, external))


def is_child_path(dst: Column, current: Column) -> Column:
    """Same-host links must sit below the current path; other hosts pass."""
    prefix = F.concat(F.regexp_replace(path(current), r"/+$", ""), F.lit("/"))
    link_path = F.coalesce(F.nullif(path(dst), F.lit("")), F.lit("/"))
    below = link_path.startswith(prefix) & (
        link_path != F.regexp_replace(prefix, r"/+$", "")
    )
    return (hostname(dst) != hostname(current)) | below


# Listing pages found in site maps.
LOW_VALUE_PATTERNS = [
    r"/tags?/", r"/categories?/", r"/authors?/", r"/page/[0-9]+", r"/search/?$",
]
LOW_VALUE_REGEX = "(?i)" + "|".join(LOW_VALUE_PATTERNS)


def is_low_value_url(url: Column) -> Column:
    return path(url).rlike(LOW_VALUE_REGEX)


# ------------------------------------------------------- path filters

def glob_to_regex(glob: str) -> str:
    """``**`` any text, ``*`` any text within a segment, ``?`` one character."""
    tokens = re.findall(r"\*\*|.", glob, flags=re.S)
    wild = {"**": ".*", "*": "[^/]*", "?": "."}
    special = set(".^$+{}[]\\|()")
    return "^" + "".join(
        wild.get(t, "\\" + t if t in special else t) for t in tokens
    ) + "$"


def usable_patterns(patterns: Sequence[str] | None, as_regex: bool) -> list[tuple[str, str]]:
    """(given pattern, regex) for each pattern that compiles; others are skipped."""
    out = []
    for given in patterns or []:
        regex = given if as_regex else glob_to_regex(given)
        try:
            re.compile(regex)
        except re.error:
            continue
        out.append((given, regex))
    return out


def _filter_target(url: Column, on_full_url: bool) -> Column:
    return url if on_full_url else path(url)


def match_path(url: Column, include=None, exclude=None, on_full_url: bool = False) -> Column:
    """Exclude wins; a given include list must match."""
    target = _filter_target(url, on_full_url)
    excluded = F.lit(False)
    for _, regex in usable_patterns(exclude, on_full_url):
        excluded = excluded | target.rlike(regex)
    included = F.lit(not include)
    for _, regex in usable_patterns(include, on_full_url):
        included = included | target.rlike(regex)
    return ~excluded & included


def filter_reason(url: Column, include=None, exclude=None, on_full_url: bool = False) -> Column:
    """struct(reason, pattern) of the filter that dropped the URL; NULL if kept."""
    target = _filter_target(url, on_full_url)
    hit = F.lit(None).cast("string")
    for given, regex in reversed(usable_patterns(exclude, on_full_url)):
        hit = F.when(target.rlike(regex), F.lit(given)).otherwise(hit)
    by_exclude = F.struct(F.lit("exclude_paths").alias("reason"), hit.alias("pattern"))
    by_include = F.struct(
        F.lit("include_paths").alias("reason"), F.lit(None).cast("string").alias("pattern")
    )
    return F.when(hit.isNotNull(), by_exclude).when(
        ~match_path(url, include, exclude, on_full_url), by_include
    )


# ------------------------------------------------------- scoring

# Hosts and path parts used by the extractability score.
SKIP_PATHS = ["/login", "/signup", "/cart", "/checkout", "/terms", "/privacy", "/tag/"]
HIGH_QUALITY_HOSTS = [
    "provenwinners.com", "logees.com", "almanac.com", "nhs.uk", "mayoclinic.org",
    "webmd.com", "sciencedirect.com", "scholar.google.com", "acm.org", "ieee.org",
    "arstechnica.com", "reuters.com", "apnews.com", "npr.org",
]
KNOWN_BLOGS = ["medium.com", "dev.to", "smashingmagazine.com"]
LOW_QUALITY_HOSTS = [
    "reddit.com", "pinterest.com", "facebook.com", "twitter.com", "x.com",
    "linkedin.com", "tumblr.com", "quora.com", "stackexchange.com",
]
VIDEO_HOSTS = [
    "youtube.com", "youtu.be", "m.youtube.com", "tiktok.com", "www.tiktok.com",
    "vm.tiktok.com", "instagram.com", "www.instagram.com",
]


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """True when one of the fixed parts occurs: substring scans, first hit ends them."""
    if len(parts) <= 4:
        test = text.contains(parts[0])
        for part in parts[1:]:
            test = test | text.contains(part)
        return test
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: text.contains(p))


def score_url(url: Column) -> Column:
    host, low = hostname(url), F.lower(path(url))

    def points(test: Column, value: int) -> Column:
        return F.when(test, value).otherwise(0)

    depth = F.length(low) - F.length(F.replace(low, F.lit("/"), F.lit("")))
    total = (
        points(host.endswith(".edu"), 2)
        + points(host.contains("wikipedia.org"), 2)
        + points(host.contains("github.com"), 2)
        + points(contains_any(host, ["youtube.com", "youtu.be"]), 2)
        + points(contains_any(host, HIGH_QUALITY_HOSTS), 2)
        + points(host.endswith(".gov") | host.endswith(".org"), 1)
        + points(contains_any(host, KNOWN_BLOGS), 1)
        + points(contains_any(host, LOW_QUALITY_HOSTS), -1)
        + F.when(depth >= 2, 1).when(low.isin("", "/"), -1).otherwise(0)
    )
    return (
        F.when(contains_any(low, SKIP_PATHS), F.lit(-9999))
        .when(query(url).contains("utm_"), F.lit(-5000))
        .otherwise(total)
        .cast("int")
    )


def is_video_platform(url: Column) -> Column:
    host = hostname(url)
    return host.isin(VIDEO_HOSTS) | F.regexp_replace(host, r"^www\.", "").isin(VIDEO_HOSTS)


# Retention categories by host, tested in this order.
CATEGORY_PREFIXES = [
    ("docs", ["docs.", "learn.", "help."]),
    ("api", ["api.", "developer."]),
    ("blog", ["blog."]),
]
CATEGORY_PARTS = [
    ("docs", ["readthedocs.io", "readthedocs.org"]),
    ("reference", [
        "wikipedia.org", "stackoverflow.com", "stackexchange.com", "github.com", "gitlab.com",
    ]),
    ("news", [
        "reuters.com", "nytimes.com", "cnn.com", "bbc.com", "bbc.co.uk", "bloomberg.com",
        "apnews.com", "npr.org", "theguardian.com", "wsj.com", "washingtonpost.com",
        "economist.com", "cnbc.com", "abcnews.go.com", "cbsnews.com", "nbcnews.com",
        "usatoday.com", "politico.com", "axios.com", "thehill.com",
    ]),
    ("social", [
        "reddit.com", "twitter.com", "x.com", "youtube.com", "instagram.com", "tiktok.com",
        "threads.net", "bluesky", "bsky.app",
    ]),
    ("blog", [
        "medium.com", "substack.com", "ghost.io", "wordpress.com", "blogger.com",
        "blogspot.com",
    ]),
]


def category_rules() -> list[tuple[str, str]]:
    """(category, regex on the host) in the order they are tried."""
    by_prefix = [
        (cat, "^(?:" + "|".join(re.escape(p) for p in parts) + ")")
        for cat, parts in CATEGORY_PREFIXES
    ]
    by_part = [(cat, "|".join(re.escape(p) for p in parts)) for cat, parts in CATEGORY_PARTS]
    return by_prefix + by_part


def domain_category(url: Column) -> Column:
    loc = F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")
    result = F.lit("unknown")
    for category, regex in reversed(category_rules()):
        result = F.when(loc.rlike(regex), F.lit(category)).otherwise(result)
    return result


# ------------------------------------------------------- routing, entities

def route_url(url: Column, routes: Sequence[tuple[str, str, int]], default: str = "generic") -> Column:
    """Handler of the highest-priority route whose pattern is found in the URL.

    ``routes`` is the registry (pattern, handler, priority). It is code-sized,
    so it becomes one ordered CASE and needs no join.
    """
    ordered = sorted(enumerate(routes), key=lambda r: (-r[1][2], r[0]))
    result = F.lit(default)
    for _, (pattern, handler, _priority) in reversed(ordered):
        result = F.when(url.rlike(pattern), F.lit(handler)).otherwise(result)
    return result


# Identifier patterns, group 1 is the value.
ENTITY_PATTERNS = [
    ("cve", r"(CVE-[0-9]{4}-[0-9]{4,})"),
    ("ip", r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b"),
    ("file_hash", r"/file/([a-fA-F0-9]{64})"),
    ("cert_domain", r"crt\.sh/\?q=([^&]+)"),
    ("email", r"/account/([^/?#]+)"),
    ("indicator", r"/indicator/[^/]+/([^/]+)"),
    ("attack_id", r"attack\.mitre\.org/[a-z]+/([TtSsGgMm][Aa]?[0-9]{4,})"),
    ("exploit_id", r"/exploits/([0-9]+)"),
    ("video_id", r"youtu(?:\.be/|be\.com/(?:watch\?(?:[^#]*&)?v=|shorts/|embed/|v/))([A-Za-z0-9_-]{11})(?:[/?&#]|$)"),
    ("book_id", r"gutenberg\.org/(?:ebooks|files|cache/epub)/([0-9]+)"),
    ("repository", r"^https?://(?:www\.)?github\.com/([^/?#]+/[^/?#]+)"),
]


def extract_entities(url: Column) -> Column:
    """array<struct<kind,value>> of the identifiers found in a URL."""
    found = [
        F.struct(F.lit(kind).alias("kind"), F.regexp_extract(url, regex, 1).alias("value"))
        for kind, regex in ENTITY_PATTERNS
    ]
    return F.filter(F.array(*found), lambda e: e["value"] != "")


# Names of search sources and categories.
SOURCE_NAMES = {
    "news": "news", "images": "images", "web": "general", "video": "videos",
    "social": "general",
}
CATEGORY_NAMES = {
    "research": "science", "github": "it", "pdf": "general", "news": "news",
    "science": "science", "it": "it", "general": "general",
}


def translate_categories(sources: Column, categories: Column) -> Column:
    """Sources then categories, renamed, unknown names kept, first copy kept."""

    def renamed(names: Column, table: dict[str, str]) -> Column:
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.transform(
            F.coalesce(names, F.array().cast("array<string>")),
            lambda n: F.coalesce(F.try_element_at(pairs, n), n),
        )

    merged = F.array_distinct(
        F.filter(
            F.concat(renamed(sources, SOURCE_NAMES), renamed(categories, CATEGORY_NAMES)),
            lambda n: n != "",
        )
    )
    return F.when(F.size(merged) == 0, F.array(F.lit("general"))).otherwise(merged)


# Binary content types and file extensions.
BINARY_PREFIXES = ["image/", "audio/", "video/"]
BINARY_TYPES = [
    "application/pdf", "application/epub+zip", "application/zip", "application/gzip",
    "application/x-tar", "application/x-rar-compressed", "application/x-7z-compressed",
    "application/vnd.android.package-archive",
    "application/vnd.openxmlformats-officedocument",
]
TYPE_EXTENSIONS = {
    "application/pdf": ".pdf", "application/epub+zip": ".epub", "application/zip": ".zip",
    "application/gzip": ".gz", "image/png": ".png", "image/jpeg": ".jpg",
    "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg",
    "text/csv": ".csv", "application/json": ".json",
}


def media_type(content_type: Column) -> Column:
    return F.trim(F.regexp_replace(content_type, r"(?s);.*$", ""))


def is_binary_type(content_type: Column) -> Column:
    kind = F.lower(media_type(content_type))
    test = kind.isin(BINARY_TYPES)
    for prefix in BINARY_PREFIXES:
        test = test | kind.startswith(prefix)
    return F.coalesce(test, F.lit(False))


def derive_filename(url: Column, content_type: Column) -> Column:
    source = F.coalesce(
        F.nullif(path(url), F.lit("")), F.nullif(query(url), F.lit("")), F.lit("download")
    )
    base = F.regexp_extract(F.regexp_replace(source, r"/+$", ""), r"([^/]*)$", 1)
    table = F.create_map(*[F.lit(x) for kv in TYPE_EXTENSIONS.items() for x in kv])
    ext = F.coalesce(F.try_element_at(table, media_type(content_type)), F.lit(""))
    return F.when(base.contains("."), base).when(base != "", F.concat(base, ext)).otherwise(
        F.concat(F.lit("download"), ext)
    )


def url_sha(url: Column) -> Column:
    return F.sha2(url, 256)


def url_id(url: Column) -> Column:
    """First 64 bits of the SHA-256 of the URL, unsigned."""
    return F.conv(F.substring(F.sha2(url, 256), 1, 16), 16, 10).cast("decimal(20,0)")
