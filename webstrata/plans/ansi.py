"""Snippets of ANSI SQL used to state the expected result of a query."""

from __future__ import annotations

from webstrata.functions import html as H
from webstrata.functions import urls as U


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, {q(U.URL_PATTERN)}, {group})"


def scheme(url):
    return f"lower({part(url, 1)})"


def netloc(url):
    return part(url, 2)


def path(url):
    return part(url, 3)


def query(url):
    return part(url, 4)


def fragment(url):
    return part(url, 5)


def host(url):
    return f"lower(replace(replace(regexp_extract({url}, {q(U.HOST_PATTERN)}, 1), '[', ''), ']', ''))"


def port(url):
    return f"regexp_extract({url}, {q(U.PORT_PATTERN)}, 1)"


def fold(p):
    return (
        f"list_reduce(string_split({p}, '/'), lambda a, s: CASE WHEN s IN ('', '.') THEN a "
        f"WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END, '')"
    )


def sort_params(qs):
    return f"array_to_string(list_sort(string_split({qs}, '&')), '&')"


def prefixed(mark, text):
    return f"CASE WHEN {text} <> '' THEN {q(mark)} || {text} ELSE '' END"


def normalize(url, ignore_query=False):
    """Expression; parts are taken apart again for each use."""
    p = f"regexp_replace({path(url)}, ';[^/]*$', '')"
    lead = f"CASE WHEN regexp_matches({p}, '^//([^/]|$)') THEN '/' ELSE '' END"
    folded = f"CASE WHEN left({p}, 1) = '/' THEN {lead} || {fold(p)} ELSE {fold(p)}[2:] END"
    clean = f"coalesce(nullif({folded}, ''), '/')"
    prt = f"ltrim({port(url)}, '0')"
    loc = (
        f"CASE WHEN {port(url)} = '' OR ({scheme(url)} = 'http' AND {prt} = '80') OR "
        f"({scheme(url)} = 'https' AND {prt} = '443') THEN {host(url)} "
        f"ELSE {host(url)} || ':' || {prt} END"
    )
    params = f"regexp_extract({path(url)}, ';([^/]*)$', 1)"
    qs = "''" if ignore_query else sort_params(query(url))
    return (
        f"(CASE WHEN {scheme(url)} <> '' THEN {scheme(url)} || ':' ELSE '' END || "
        f"CASE WHEN {loc} <> '' THEN '//' || ({loc}) ELSE '' END || ({clean}) || "
        f"{prefixed(';', params)} || {prefixed('?', qs)})"
    )


def any_of(text, parts):
    tests = " OR ".join(f"contains({text}, {q(p)})" for p in parts)
    return f"({tests})"


def in_list(text, values):
    return f"{text} IN ({', '.join(q(v) for v in values)})"


def strip(text):
    return f"trim({text}, {q(H.SPACE_CHARS)})"


# Character references that the stored and built pages hold, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]


def decode(text):
    for name, char in ENTITIES:
        text = f"replace({text}, {q(name)}, {q(char)})"
    return text


def drop_elements(markup, names, comments=False):
    return f"regexp_replace({markup}, {q(H.element_pattern(names, comments))}, '<>', 'g')"


def live(markup):
    return drop_elements(markup, ["script", "style"], comments=True)


VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""


def raw_attribute(tag, name):
    pat = rf"(?is)\s{name}\s*=\s*{VALUE}"
    raw = f"regexp_extract({tag}, {q(pat)}, 1)"
    bare = f"CASE WHEN left({raw}, 1) IN ('\"', '\'\'') THEN {raw}[2:-2] ELSE {raw} END"
    return f"CASE WHEN {raw} = '' THEN NULL ELSE {bare} END"


def attribute(tag, name):
    return decode("(" + raw_attribute(tag, name) + ")")


def after(tag, key):
    """What a tag holds behind its key attribute."""
    return f"regexp_extract({tag}, {q(rf'(?is)\s{key}\s*=\s*{VALUE}(.*)$')}, 2)"


def first_value(markup, tag, key, wanted, value):
    """Value beside the first ``key`` attribute that says ``wanted``."""
    test = f"lower({strip(raw_attribute('x', key))}) = {q(wanted)} AND {raw_attribute(after('x', key), value)} IS NOT NULL"
    found = f"list_filter({start_tags(markup, tag)}, lambda x: {test})[1]"
    return f"nullif({strip(raw_attribute(after(found, key), value))}, '')"


def start_tags(markup, name):
    return f"regexp_extract_all({markup}, {q(rf'(?is)<{name}' + r'\s[^>]*>')})"


def pieces(markup):
    return (
        f"list_filter(list_transform(string_split_regex(replace({markup}, '&nbsp;', ' '), "
        f"'(?s)<[^>]*>'), lambda s: {strip('s')}), lambda s: s <> '')"
    )


def plain_text(markup):
    return decode(f"array_to_string({pieces(markup)}, chr(10))")


def resolve(href, base):
    """URL join for simple references: absolute, host-relative, path and fragment."""
    hp = path(href)
    bp = path(base)
    merged = (
        f"CASE WHEN left({hp}, 1) = '/' THEN {hp} ELSE "
        f"CASE WHEN {bp} = '' THEN '/' ELSE regexp_replace({bp}, '[^/]*$', '') END || {hp} END"
    )
    folded = (
        f"{fold('(' + merged + ')')} || "
        rf"CASE WHEN regexp_matches({merged}, '/\.{{0,2}}$') THEN '/' ELSE '' END"
    )
    origin = f"{scheme(base)} || '://' || {netloc(base)}"
    frag = prefixed("#", fragment(href))
    hq = prefixed("?", query(href))
    bq = prefixed("?", query(base))
    return (
        f"CASE WHEN {href} = '' THEN {base} "
        f"WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {href} "
        f"WHEN left({href}, 2) = '//' THEN {scheme(base)} || ':' || {href} "
        f"WHEN {hp} = '' THEN {origin} || {bp} || "
        f"CASE WHEN {query(href)} <> '' THEN {hq} ELSE {bq} END || {frag} "
        f"ELSE {origin} || {folded} || {hq} || {frag} END"
    )
