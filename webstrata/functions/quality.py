"""Content quality gates, barrier and error classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.html import strip_space
from webstrata.functions.urls import bind, compute_once, contains_any

MIN_CONTENT_CHARS = 200
MIN_TITLE_CHARS = 10
MAX_LINK_RATIO = 0.7
MIN_ACCEPTED_SCORE = 0.3
LINK_LINE = r"\[.*?\]\(.*?\)"

# Signs of a page that rendered but holds no content.
# They are searched in lower-cased text, so the upper-case IP never fires.
BLOCK_PATTERNS = [
    "please enable javascript",
    "enable javascript to continue",
    "javascript is required",
    "please turn javascript on",
    "please verify you are (?:a )?human",
    "we need to make sure you(?:'re| are) not a robot",
    "checking your browser",
    "we are checking your browser",
    "access denied",
    "you have been blocked",
    "your (?:IP|access) has been blocked",
    "too many requests",
    "rate limit",
    "your session has expired",
    "session timed? ?out",
    "cloudflare",
    "attention required",
    "just a moment",
    "cookies are required",
    "please accept cookies",
    "cookie consent",
    "this site uses cookies",
    "not available in your country",
    "not available in your region",
    "geo.?restriction",
    "content (?:is )?not available",
    "subscribe to continue",
    "sign up to read more",
    "members.?only",
    "this content is for (?:members|subscribers)",
    "404 not found",
    "403 forbidden",
    "500 error",
    "internal server error",
    "page not found",
    "something went wrong",
    "hcaptcha",
    "recaptcha",
    "captcha",
    "under maintenance",
    "temporarily unavailable",
]
ERROR_WORDS = [
    "error", "not found", "forbidden", "unauthorized", "timeout", "failed", "unavailable",
    "exception",
]


def count_hits(text: Column, patterns: list[str]) -> Column:
    """How many patterns occur.

    Plain words are substring scans; a regex is only tried on texts that hold
    the plain words it starts with.
    """
    plain = [p for p in patterns if re.fullmatch(r"[a-z0-9' ]+", p)]
    total = F.aggregate(
        F.array(*[F.lit(p) for p in plain]), F.lit(0),
        lambda acc, p: acc + F.when(text.contains(p), 1).otherwise(0),
    )
    for p in patterns:
        if p not in plain:
            head = re.match(r"[a-z0-9' ]+", p)[0]
            head = head[:-1] if p[len(head):len(head) + 1] == "?" else head
            total = total + F.when(text.contains(head) & text.rlike(p), 1).otherwise(0)
    return total


def _gate(score: Column | float, status: str) -> Column:
    return F.struct(F.lit(score).cast("double").alias("score"), F.lit(status).alias("status"))


def _ladder(text: Column, steps: list[tuple[Column, float, str]], last: tuple[float, str]) -> Column:
    out = F.when(F.coalesce(strip_space(text) == "", F.lit(True)), _gate(0.0, "fail"))
    for test, score, status in steps:
        out = out.when(test, _gate(score, status))
    return out.otherwise(_gate(*last))


def check_boilerplate(markdown: Column) -> Column:
    lines = F.filter(F.transform(F.split(markdown, "\n"), strip_space), lambda s: s != "")
    tallied = F.transform(lines, lambda s: F.when(s.rlike(LINK_LINE), 1).when(F.length(s) > 60, 2).otherwise(0))

    def gate(marks: Column) -> Column:
        ratio = F.size(F.filter(marks, lambda m: m == 1)) / F.greatest(F.size(marks), F.lit(1))
        solid = F.size(F.filter(marks, lambda m: m == 2))
        counts = F.struct(ratio.alias("ratio"), solid.alias("solid"))
        return bind(counts, lambda c: _ladder(
            F.lit("x"),
            [
                (F.size(marks) == 0, 0.0, "fail"),
                ((c["ratio"] > MAX_LINK_RATIO) & (c["solid"] < 2), 0.2, "fail"),
                ((c["ratio"] > 0.5) & (c["solid"] < 2), 0.4, "warn"),
                (c["solid"] >= 5, 1.0, "pass"),
                (c["solid"] >= 3, 0.85, "pass"),
                (c["solid"] >= 1, 0.6, "warn"),
            ],
            (0.3, "fail"),
        ))

    return F.coalesce(bind(tallied, gate), _gate(0.0, "fail"))


def check_completeness(markdown: Column, title: Column) -> Column:
    facts = F.struct(
        F.length(strip_space(markdown)).alias("size"),
        (F.size(F.filter(
            F.split(strip_space(markdown), "\n\n"), lambda p: strip_space(p) != ""
        )) >= 2).alias("paragraphs"),
    )

    def gate(f: Column) -> Column:
        size, paragraphs = f["size"], f["paragraphs"]
        title_ok = F.when(
            F.coalesce(title, F.lit("")) != "", F.length(strip_space(title)) >= MIN_TITLE_CHARS
        ).otherwise(size >= MIN_CONTENT_CHARS)
        short = size < MIN_CONTENT_CHARS
        return _ladder(
            F.lit("x"),
            [
                (size == 0, 0.0, "fail"),
                (short & ~paragraphs, 0.1, "fail"),
                (short, 0.3, "warn"),
                (~paragraphs, 0.4, "warn"),
                ((size >= 1000) & title_ok, 1.0, "pass"),
                (size >= 500, 0.85, "pass"),
            ],
            (0.6, "warn"),
        )

    return F.when(markdown.isNull(), _gate(0.0, "fail")).otherwise(bind(facts, gate))


def check_block_page(markdown: Column) -> Column:
    short = F.length(strip_space(markdown)) < MIN_CONTENT_CHARS
    return bind(F.lower(markdown), lambda low: bind(
        F.struct(
            count_hits(low, BLOCK_PATTERNS).alias("hits"),
            F.when(short, count_hits(low, ERROR_WORDS)).otherwise(0).alias("errors"),
        ),
        lambda n: _ladder(
            low,
            [
                (n["hits"] >= 3, 0.05, "fail"),
                (n["hits"] >= 2, 0.15, "fail"),
                (n["hits"] >= 1, 0.3, "warn"),
                (n["errors"] >= 2, 0.2, "fail"),
            ],
            (1.0, "pass"),
        ),
    ))


def assess_quality(df, markdown: str, title: Column | None = None):
    """Adds the three gates, ``score`` (two decimals) and ``detail``."""
    text = F.col(markdown)
    gates = compute_once(
        df,
        gate_boilerplate=check_boilerplate(text),
        gate_completeness=check_completeness(text, F.lit("") if title is None else title),
        gate_block=check_block_page(text),
    )

    def part(name: str, label: str) -> Column:
        status = F.col(f"{name}.status")
        return F.when(status != "pass", F.concat(F.lit(label + ":"), status))

    detail = F.concat_ws(
        ", ", part("gate_boilerplate", "boilerplate"),
        part("gate_completeness", "completeness"), part("gate_block", "block"),
    )
    return gates.select(
        *df.columns,
        F.round(
            F.col("gate_boilerplate.score") * 0.3
            + F.col("gate_completeness.score") * 0.3
            + F.col("gate_block.score") * 0.4,
            2,
        ).alias("score"),
        F.col("gate_boilerplate.status").alias("boilerplate"),
        F.col("gate_completeness.status").alias("completeness"),
        F.col("gate_block.status").alias("block_detected"),
        F.coalesce(F.nullif(detail, F.lit("")), F.lit("all checks passed")).alias("detail"),
    )


def quality_acceptable(score: Column, threshold: float = MIN_ACCEPTED_SCORE) -> Column:
    return score.isNull() | (score >= threshold)


# ------------------------------------------------------------------ barriers

# Signatures of challenge pages.
CLOUDFLARE_SIGNS = [
    "Just a moment", "Checking your browser", "DDoS protection by", "cf-browser-verification",
    "challenge-platform", "Verification successful",
    "Enable JavaScript and cookies to continue", "security verification",
]
DDOS_GUARD_SIGNS = [
    "DDoS-Guard", "DDOS-GUARD", "ddos-guard", "Checking your browser before accessing",
    ".well-known/ddos-guard",
]
FRAME_REDIRECTS = [
    "substack.com/session-attribution-frame", "substack.com/channel-frame",
    "substack.com/iframe", "googletagmanager.com/ns.html",
]
CAPTCHA_WIDGETS = [
    ("turnstile", ["challenges.cloudflare.com/turnstile", "cf-turnstile", "cf-turnstile-response"]),
    ("recaptcha", ["google.com/recaptcha", "g-recaptcha", "g-recaptcha-response"]),
    ("hcaptcha", ["hcaptcha.com", "h-captcha", "h-captcha-response"]),
]
BARRIER_ORDER = [
    ("cloudflare", "cloudflare"), ("ddos-guard", "ddos-guard"), ("captcha", "captcha"),
    ("rate-limit", "rate-limit"), ("substack-redirect", "substack-redirect"),
    ("empty", "empty"), ("content-match", "suspicious"),
]


def _low(values: list[str]) -> list[str]:
    return [v.lower() for v in values]


def is_bot_challenge(title: Column, url: Column) -> Column:
    return contains_any(F.lower(title), _low(CLOUDFLARE_SIGNS + DDOS_GUARD_SIGNS)) | contains_any(
        F.lower(url), ["cf_chl", "challenge-platform", "ddos-guard"]
    )


def classify_barrier(title: Column, url: Column, content: Column, html: Column) -> Column:
    """struct(detected, barrier_type, confidence, detail, provider)."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    t, u, c, h = text(title), text(url), text(content), text(html)
    signal = lambda test, name: F.when(test, F.lit(name))
    first = F.array_compact(F.array(
        signal(F.length(c) < 100, "empty"),
        signal(
            contains_any(t, _low(CLOUDFLARE_SIGNS) + ["attention required", "403 forbidden"]),
            "cloudflare-title",
        ),
        signal(contains_any(u, ["cf_chl", "challenge-platform"]), "cloudflare-url"),
        signal(contains_any(t, _low(DDOS_GUARD_SIGNS)), "ddos-guard-title"),
        signal(u.contains("ddos-guard"), "ddos-guard-url"),
        signal(contains_any(c, ["rate limit", "too many requests"]), "rate-limit"),
        signal(
            contains_any(u, FRAME_REDIRECTS) | contains_any(h, FRAME_REDIRECTS),
            "substack-redirect",
        ),
    ))
    fallback = F.array_compact(F.array(signal(
        contains_any(c, _low(CLOUDFLARE_SIGNS + DDOS_GUARD_SIGNS + FRAME_REDIRECTS)),
        "content-match",
    )))
    signals = bind(first, lambda f: F.when(F.size(f) > 0, f).otherwise(fallback))

    def verdict(detected, barrier, confidence, detail, provider=None):
        lit = lambda v, ty: (v if isinstance(v, Column) else F.lit(v)).cast(ty)
        return F.struct(
            lit(detected, "boolean").alias("detected"), lit(barrier, "string").alias("barrier_type"),
            lit(confidence, "double").alias("confidence"), lit(detail, "string").alias("detail"),
            lit(provider, "string").alias("provider"),
        )

    def from_signals(found: Column) -> Column:
        joined = F.array_join(F.array_sort(found), ", ")
        kind = F.lit(None).cast("string")
        for word, name in reversed(BARRIER_ORDER):
            kind = F.when(joined.contains(word), F.lit(name)).otherwise(kind)
        return F.when(
            F.size(found) == 0, verdict(False, None, 0.0, "No barrier signals detected")
        ).otherwise(verdict(
            True, kind,
            F.least(F.round(F.lit(0.5) + F.size(found) * 0.2, 2), F.lit(0.95)),
            F.concat(F.lit("Matched signals: "), joined),
        ))

    out = None
    for provider, signs in CAPTCHA_WIDGETS:
        v = verdict(True, "captcha", 0.95, f"Definitive {provider} widget", provider)
        out = F.when(contains_any(h, signs), v) if out is None else out.when(contains_any(h, signs), v)
    generic = h.contains("<iframe") & h.contains("sitekey") & contains_any(h, ["captcha", "challenge"])
    return (
        out.when(generic, verdict(True, "captcha", 0.85, "Definitive generic CAPTCHA widget", "generic"))
        .when((c == "") & (h == ""), verdict(True, "empty", 0.95, "No content returned"))
        .otherwise(bind(signals, from_signals))
    )


# Error codes and the words that tell error types apart.
ERROR_CODES = {
    "TIMEOUT": "timeout", "UPSTREAM_ERROR": "http_error", "INVALID_REQUEST": "scrape_error",
    "AUTH_ERROR": "http_error", "CAPTCHA_UNRESOLVED": "captcha_unresolved",
}
ERROR_MESSAGES = [
    ("dns_error", [
        "name resolution", "getaddrinfo", "dns", "no address found",
        "nodename nor servname provided", "temporary name error", "name or service not known",
    ]),
    ("connection_error", [
        "connection refused", "connection reset", "connection closed", "connection aborted",
        "connect call failed", "no route to host", "network is unreachable",
        "connection timed out",
    ]),
    ("http_error", [
        "http 4", "http 5", "status code 4", "status code 5", "400 bad request",
        "401 unauthorized", "403 forbidden", "404 not found", "500 internal",
        "502 bad gateway", "503 service unavailable",
    ]),
    ("timeout", ["timed out", "timeout"]),
]


def classify_error(message: Column, code: Column) -> Column:
    low = F.lower(message)
    out = F.when(code.isin(list(ERROR_CODES)), F.try_element_at(
        F.create_map(*[F.lit(x) for kv in ERROR_CODES.items() for x in kv]), code
    ))
    for kind, words in ERROR_MESSAGES:
        out = out.when(contains_any(low, words), F.lit(kind))
    return out.otherwise("scrape_error")
