"""URL anatomy and structural risk as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import lexicon as lx
from .literals import array_map, empty_strings, str_array, str_map
from .punycode import decode_host
from .text import WHITESPACE, _trie_regex

# FIXED VALUES: address patterns.
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
IPV6 = (
    r"^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"
    r"|^(?=(?:[0-9a-f]{0,4}:){2,7}[0-9a-f.]{0,15}$)(?!.*::.*::)(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?::"
    r"(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?::?(?:[0-9]{1,3}\.){3}[0-9]{1,3})?$"
)


def absolute(url: Column) -> Column:
    u = F.btrim(url, F.lit(WHITESPACE))
    return F.when(F.lower(F.substring(u, 1, 8)).rlike("^https?://"), u).otherwise(F.concat(F.lit("http://"), u))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """Lower-case host without user info, port, brackets and trailing dots ('' when absent)."""
    bare = F.regexp_replace(authority(url), "^.*@", "")
    named = F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)", 1)).otherwise(
        F.substring_index(bare, ":", 1)
    )
    return F.rtrim(F.lower(named), F.lit("."))


def path_of(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    p = F.regexp_replace(p, r";[^/]*$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def param_names(url: Column) -> Column:
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")

    def name(p):
        raw = F.substring_index(p, "=", 1)
        return F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" ")))

    return F.transform(parts, name)


def suffixes_of(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``: the keys under which a host or parent domain is listed."""
    labels = F.split(host, r"\.")
    return F.when(
        host != "",
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    ).otherwise(empty_strings())


def registrable(suffixes: Column) -> Column:
    """Last two labels, or three under a two-label public suffix."""
    n = F.size(suffixes)
    last_two = F.try_element_at(suffixes, F.lit(-2))
    return (
        F.when(n == 0, F.lit(""))
        .when(n <= 2, F.try_element_at(suffixes, F.lit(1)))
        .when(last_two.isin(lx.MULTI_SUFFIXES), F.try_element_at(suffixes, F.lit(-3)))
        .otherwise(last_two)
    )


def top_level(suffixes: Column) -> Column:
    last_two = F.try_element_at(suffixes, F.lit(-2))
    return F.when(last_two.isin(lx.MULTI_SUFFIXES), last_two).otherwise(
        F.coalesce(F.try_element_at(suffixes, F.lit(-1)), F.lit(""))
    )


def _lookalike_names(lex: lx.Lexicon) -> dict[str, str]:
    names = {k: k for k, _, _ in lex.brands if " " not in k and len(k) >= 3}
    for alias, key in lex.aliases:
        if " " not in alias and len(alias) >= 3:
            names[alias] = key
    return names


def latin_host(host: Column) -> Column:
    """The host as a reader sees it: punycode decoded, digits and Cyrillic letters read as Latin."""
    seen = F.when(host.contains("xn--"), decode_host(host)).otherwise(host)
    return F.translate(F.translate(seen, lx.LEET_FROM, lx.LEET_TO), lx.GLYPH_FROM, lx.GLYPH_TO)


def affixes_of(latin: Column, slack: int = 6, shortest: int = 3) -> Column:
    """Prefixes and suffixes of each host token that leave at most ``slack`` characters over."""
    tokens = F.filter(F.split(latin, r"[.\-]+"), lambda t: F.length(t) >= shortest)

    def cuts(t):
        sizes = F.sequence(F.greatest(F.lit(shortest), F.length(t) - slack), F.length(t))
        return F.concat(F.transform(sizes, lambda n: F.left(t, n)), F.transform(sizes, lambda n: F.right(t, n)))

    return F.flatten(F.transform(tokens, cuts))


def lookalike(affixes: Column, suffixes: Column, lex: lx.Lexicon) -> Column:
    """The first brand the host imitates without belonging to it, else null."""
    names = _lookalike_names(lex)
    official = array_map({k: hosts for k, _, hosts in lex.brands if hosts})
    canonical = str_map(names)
    seen = F.array_intersect(str_array(names), affixes)
    foreign = F.filter(
        seen,
        lambda c: ~F.coalesce(
            F.arrays_overlap(F.try_element_at(official, F.element_at(canonical, c)), suffixes), F.lit(False)
        ),
    )
    return F.element_at(canonical, F.get(foreign, F.lit(0)))


def keyword_hits(url_lower: Column) -> Column:
    found = F.regexp_extract_all(url_lower, F.lit(f"(?<![a-z])(?=({_trie_regex(lx.URL_KEYWORDS, 'a-z')}))"), F.lit(1))
    return F.array_intersect(str_array(lx.URL_KEYWORDS), found)


def _bumps(g) -> list[tuple[Column, Column, float]]:
    """(condition, amount, ceiling) in the order in which they are applied."""
    words = F.size(g("keywords"))
    return [
        (~g("is_https"), F.lit(0.05), 0.9),
        (g("url_length") > 100, F.lit(0.05), 0.9),
        (g("url_length") > 200, F.lit(0.05), 0.9),
        (g("is_ip"), F.lit(0.35), 0.9),
        (g("is_punycode"), F.lit(0.15), 0.9),
        (g("n_labels") > 4, F.lit(0.1), 0.9),
        (g("n_hyphens") >= 4, F.lit(0.1), 0.9),
        (g("lookalike").isNotNull(), F.lit(0.4), 0.95),
        (F.length(g("path")) > 60, F.lit(0.05), 0.9),
        (F.size(g("leaked")) > 0, F.lit(0.15), 0.9),
        (words > 0, F.least(F.lit(0.25), F.lit(0.06) * words), 0.9),
        (F.size(g("symbols")) > 0, F.lit(0.1), 0.9),
        (g("is_shortener"), F.lit(0.2), 0.9),
        (g("digit_heavy"), F.lit(0.1), 0.9),
        (g("risky_tld"), F.lit(0.1), 0.9),
    ]


def clamped_risk(bumps: list[tuple[Column, Column, float]]) -> Column:
    """Ordered sum in which every applied amount also enforces its own ceiling."""
    risk = F.lit(0.0)
    for cond, amount, ceiling in bumps:
        risk = F.least(F.when(cond, F.lit(ceiling)).otherwise(F.lit(1.0)), risk + F.when(cond, amount).otherwise(F.lit(0.0)))
    return F.bround(F.least(F.lit(1.0), risk), 3)


def url_steps(lex: lx.Lexicon = lx.DEFAULT, source: str = "raw_url"):
    """Steps for :func:`derive` / :func:`derive_array`, starting from a field ``source``."""
    sensitive, shorteners = str_array(lx.SENSITIVE_PARAMS), str_array(lx.SHORTENERS)
    return [
        [("url", lambda g: absolute(g(source)))],
        [
            ("host", lambda g: host_of(g("url"))),
            ("path", lambda g: path_of(g("url"))),
            ("params", lambda g: param_names(g("url"))),
            ("is_https", lambda g: F.lower(F.substring(g("url"), 1, 6)) == "https:"),
            ("url_length", lambda g: F.length(g("url"))),
            ("keywords", lambda g: keyword_hits(F.lower(g("url")))),
            ("symbols", lambda g: F.filter(str_array(lx.URL_SYMBOLS), lambda s: g("url").contains(s))),
            ("special_chars", lambda g: F.length(g("url")) - F.length(F.translate(g("url"), "_-@%*&!", ""))),
        ],
        [
            ("suffixes", lambda g: suffixes_of(g("host"))),
            ("latin", lambda g: latin_host(g("host"))),
            ("is_ip", lambda g: g("host").rlike(IPV4) | (g("host").contains(":") & g("host").rlike(IPV6))),
            ("is_punycode", lambda g: g("host").contains("xn--")),
            ("n_hyphens", lambda g: F.length(g("host")) - F.length(F.translate(g("host"), "-", ""))),
            ("digit_heavy", lambda g: (F.length(g("host")) - F.length(F.translate(g("host"), "0123456789", "")))
                / F.greatest(F.length(g("host")), F.lit(1)) > 0.4),
            ("leaked", lambda g: F.filter(g("params"), lambda p: F.array_contains(sensitive, F.lower(p)))),
        ],
        [
            ("n_labels", lambda g: F.size(g("suffixes"))),
            ("domain", lambda g: registrable(g("suffixes"))),
            ("tld", lambda g: top_level(g("suffixes"))),
            ("lookalike", lambda g: lookalike(affixes_of(g("latin")), g("suffixes"), lex)),
            ("is_shortener", lambda g: F.arrays_overlap(g("suffixes"), shorteners)),
        ],
        [("risky_tld", lambda g: g("tld").isin(lx.RISKY_TLDS))],
        [
            ("risk", lambda g: clamped_risk(_bumps(g))),
            ("signals", lambda g: F.array_compact(F.array(
                F.when(~g("is_https"), F.lit("no_https")),
                F.when(g("is_ip"), F.lit("ip_address_url")),
                F.when(g("is_punycode"), F.lit("punycode")),
                F.when(g("n_labels") > 4, F.lit("excessive_subdomains")),
                F.when(g("n_hyphens") >= 4, F.lit("many_hyphens")),
                F.when(g("lookalike").isNotNull(), F.lit("brand_lookalike")),
                F.when(F.length(g("path")) > 60, F.lit("long_path")),
                F.when(F.size(g("leaked")) > 0, F.lit("sensitive_query_params")),
                F.when(F.size(g("symbols")) > 0, F.lit("suspicious_symbols")),
                F.when(g("is_shortener"), F.lit("url_shortener")),
                F.when(g("risky_tld"), F.lit("risky_tld")),
            ))),
        ],
    ]


URL_FIELDS = [
    "raw_url", "url", "host", "path", "params", "is_https", "url_length", "keywords", "symbols", "special_chars",
    "suffixes", "is_ip", "is_punycode", "domain", "tld", "lookalike", "is_shortener", "risk", "signals",
]


def lookupable(url: Column) -> Column:
    """The URL is one a reputation service could really have checked."""
    u = F.btrim(url, F.lit(WHITESPACE))
    host = host_of(u)
    label_ok = r"^[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?)+$"
    port_ok = ~authority(u).rlike(r":[^:@\]]*[^0-9:@\]][^:@\]]*$")
    return F.coalesce(
        (F.length(u) > 0)
        & (F.length(u) <= 2000)
        & ~u.rlike(r"(?U)\s")
        & F.lower(u).rlike("^https?://")
        & (host != "")
        & port_ok
        & (host.rlike(IPV4) | (host.contains(":") & host.rlike(IPV6)) | host.rlike(label_ok)),
        F.lit(False),
    )


def lookup_key(url: Column) -> Column:
    """Unpadded base64url of the URL."""
    plain = F.regexp_replace(F.base64(F.encode(url, "UTF-8")), r"[\r\n]", "")
    return F.rtrim(F.translate(plain, "+/", "-_"), F.lit("="))
