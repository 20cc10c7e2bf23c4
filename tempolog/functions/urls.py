"""Playback URLs: which catalog system and song they name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import once
from .timestamps import blank_to_null

# Hosts, paths and names of the catalog systems.
WANNA_API_HOSTS = ("139.196.46.195:51886", "api.udon.dance", "api.wannadance.online", "ud-orig.kiva.moe")
WANNA_CDN_HOSTS = ("nya.xin.moe", "play.udon.dance", "ud-nya.kiva.moe", "ud-play.kiva.moe")
DUDU_API_HOSTS = ("api.dudufit.dance",)
DUDU_CDN_HOSTS = ("api-ddfd.imkiva.com", "global-cdn.dudufit.dance")
WANNA, PYPY, DUDU = "wannadance", "pypydance", "dudu"
WANNA_URL = "http://api.udon.dance/Api/Songs/play?id="
DUDU_URL = "https://api.dudufit.dance/api/v1/videos/"


@dataclass(frozen=True)
class UrlRule:
    """URLs of some hosts whose id a pattern finds, and what to report with and without an id."""

    kind: str
    method: str
    failure: str
    system: str
    hosts: tuple[str, ...] = ()
    host_part: str = ""
    path: str = ""
    pattern: str = ""
    query_key: str = ""
    #: Reported instead of kind when there is no id.
    failed_kind: str = ""


#: In order: the first rule whose host (and path, if it has one) fits decides.
RULES = (
    UrlRule("wanna_api", "api_query_id", "missing_query_id", WANNA, hosts=WANNA_API_HOSTS, path="/api/songs/play", query_key="id"),
    UrlRule("wanna_cdn", "cdn_file_path", "unrecognized_cdn_path", WANNA, hosts=WANNA_CDN_HOSTS, pattern=r"(?i)^/files/[^/]+/(\d+)-[^/]+\.mp4$"),
    UrlRule("pypydance_api", "api_query_id", "missing_query_id", PYPY, hosts=("api.pypy.dance",), path="/video", query_key="id"),
    UrlRule("pypydance_api", "api_video_file_path", "unsupported_system", PYPY, host_part="pypy", pattern=r"(?i)^/api/v1/videos/(\d+)\.mp4$", failed_kind="pypydance"),
    UrlRule("dudu", "api_video_path", "missing_video_id", DUDU, hosts=DUDU_API_HOSTS, pattern=r"(?i)^/api/v1/videos/(\d+)$"),
    UrlRule("dudu", "cdn_file_path", "unrecognized_cdn_path", DUDU, hosts=DUDU_CDN_HOSTS, pattern=r"(?i)^/videos/(\d+)-[^/]+\.mp4$"),
    UrlRule("dudu", "web_video_path", "missing_video_id", DUDU, hosts=("www.dudufit.dance",), pattern=r"(?i)^/(?:[a-z]{2}(?:-[a-z]{2})?/)?videos/(\d+)/?$"),
    UrlRule("dudu", "", "unsupported_system", DUDU, host_part="dudu", pattern="^(?!)()"),
)


def authority(url: Column) -> Column:
    """Host with port, as written but lowered; empty if the text has none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_values(url: Column, key: str) -> Column:
    """Decoded non-empty values of a query key, in order."""
    pairs = F.filter(F.split(query_of(url), "&"), lambda p: p.rlike(f"^{key}=."))
    return F.transform(pairs, lambda p: F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")))


def classify_url(url: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """struct(system, external_id, url_kind, method) of a playback URL."""

    def result(system: Column, found: Column, kind: Column, method: Column) -> Column:
        return F.struct(system.alias("system"), found.alias("external_id"), kind.alias("url_kind"), method.alias("method"))

    none = F.lit(None).cast("string")

    def chosen(host: Column, path: Column) -> Column:
        chain = F.when(F.coalesce(url, F.lit("")) == "", result(none, none, F.lit("empty"), F.lit("none")))
        for rule in rules:
            fits = host.isin(*rule.hosts) if rule.hosts else host.contains(rule.host_part)
            if rule.path:
                fits = fits & (F.lower(path) == rule.path)
            bad = result(none, none, F.lit(rule.failed_kind or rule.kind), F.lit(rule.failure))

            def good(found: Column, method: Column, rule: UrlRule = rule, bad: Column = bad) -> Column:
                return F.when(found.isNotNull(), result(F.lit(rule.system), found, F.lit(rule.kind), method)).otherwise(bad)

            if rule.query_key:
                first = F.try_element_at(query_values(url, rule.query_key), F.lit(1))
                plain = once(first, lambda f: F.when(f.rlike(r"^\d+$"), f))
                if rule.system == WANNA:
                    loose = blank_to_null(F.regexp_extract(url, rf"[?&]{rule.query_key}=(\d+)", 1))
                    told = once(plain, lambda p, rule=rule, loose=loose, good=good: F.when(p.isNotNull(), good(p, F.lit(rule.method))).otherwise(once(loose, lambda f: good(f, F.lit(rule.method + "_fallback")))))
                else:
                    told = once(plain, lambda p, rule=rule, good=good: good(p, F.lit(rule.method)))
            else:
                told = once(blank_to_null(F.regexp_extract(path, rule.pattern, 1)), lambda f, rule=rule, good=good: good(f, F.lit(rule.method)))
            chain = chain.when(fits, told)
        return chain.otherwise(result(none, none, F.lit("other"), F.lit("unsupported")))

    return once(authority(url), lambda host: once(path_of(url), lambda path: chosen(host, path)))


def canonical_key(url: Column) -> Column:
    return once(classify_url(url), lambda found: key_of(url, found))


def key_of(url: Column, known: Column) -> Column:
    """``system:id`` of a URL that :func:`classify_url` knows, else ``url:`` and the URL."""
    named = F.concat(known["system"], F.lit(":"), known["external_id"])
    return F.when(F.coalesce(url, F.lit("")) != "", F.coalesce(named, F.concat(F.lit("url:"), url)))


@dataclass(frozen=True)
class ContractForm:
    """A URL form that the strict contract accepts: hosts, exact path pattern, and where the id stands."""

    system: str
    schemes: tuple[str, ...]
    hosts: tuple[str, ...]
    path: str
    query_key: str = ""


CONTRACT = (
    ContractForm(WANNA, ("http", "https"), ("api.udon.dance", "api.wannadance.online"), "^/(?:Api/Songs|api/songs)/play$", "id"),
    ContractForm(PYPY, ("http", "https"), ("api.pypy.dance",), "^/video$", "id"),
    ContractForm(PYPY, ("http", "https"), ("jd.pypy.moe",), r"^/api/v1/videos/([1-9][0-9]*)\.mp4$"),
    ContractForm(DUDU, ("http", "https"), ("api.dudufit.dance",), r"^/api/v1/videos/([1-9][0-9]*)$"),
)


def contract_key(url: Column, forms: tuple[ContractForm, ...] = CONTRACT) -> Column:
    """``system:id`` of a URL that meets the contract to the letter, else null.

    No white space or control characters, no user part, default port only, exact path case, and one
    positive id.
    """
    bare = ~url.rlike(r"[\s\p{Cntrl}]")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(authority(url), ":(?:80|443)$", "")
    default_port = ~authority(url).rlike(r":\d+$") | ((scheme == "http") & authority(url).endswith(":80")) | ((scheme == "https") & authority(url).endswith(":443"))
    found = F.lit(None).cast("string")
    for form in reversed(forms):
        if form.query_key:
            keys = F.regexp_extract_all(F.concat(F.lit("&"), query_of(url)), F.lit(f"&({form.query_key})(?:=|&|$)"), F.lit(1))
            value = F.when((F.size(keys) == 1) & path_of(url).rlike(form.path), F.try_element_at(query_values(url, form.query_key), F.lit(1)))
        else:
            value = blank_to_null(F.regexp_extract(path_of(url), form.path, 1))
        fits = scheme.isin(*form.schemes) & host.isin(*form.hosts) & value.rlike(r"^[1-9]\d*$")
        found = F.when(fits, F.concat(F.lit(f"{form.system}:"), value)).otherwise(found)
    return F.when(bare & default_port & ~authority(url).contains("@"), found)


def deferred_reason(url: Column) -> Column:
    """Why a URL that misses the contract is set aside: one of three recorded candidates, or any other."""
    host, path = authority(url), path_of(url)
    one_id = (F.size(query_values(url, "id")) == 1) & F.try_element_at(query_values(url, "id"), F.lit(1)).rlike("^[1-9][0-9]*$")
    return (
        F.when((host == WANNA_API_HOSTS[0]) & path.rlike("^/(?:Api/Songs|api/songs)/play$") & one_id, "unverified_ip_alias")
        .when((host == "play.udon.dance") & path.rlike(r"(?i)^/files/[^/]+/[1-9][0-9]*-[^/]+\.mp4$"), "unverified_wannadance_cdn")
        .when((host == "api.dudufit.dance") & (path == "/api/v1/videos/0"), "unverified_zero_id").otherwise("unsupported_other")
    )
