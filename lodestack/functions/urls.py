"""Addresses of links: a normal form, and what they point at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track, and characters that prose leaves at the end of an address.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]
TRAILING = ".,;:!?”’\"')]}>"
# Endings of documents, and parts of hosts and paths by which systems are known.
DOCUMENT = r"\.(docx|doc|xlsx|xls|pptx|ppt|pdf|md|txt)$"
OFFICE = ["/:w:/", "/:x:/", "/:p:/"]
INTERNAL = ["sharepoint", "onedrive", "confluence", "jira", "azure_devops", "teams"]


def _has(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def parts(url: Column) -> dict[str, Column]:
    return {
        "scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)),
        "host": F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)),
        "path": F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1),
        "query": F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract(url, r"^[^#]*#(.*)$", 1),
    }


def is_mailto(url: Column) -> Column:
    return F.lower(F.trim(url)).startswith("mailto:")


def is_local(url: Column) -> Column:
    return F.trim(url).rlike(r"^(?i)(file:|/|\\\\|[a-z]:[\\/])")


def normalize_mailto(url: Column) -> Column:
    """Lower-case addresses without headers."""
    body = F.split_part(F.substring(url, F.lit(8), F.length(url)), F.lit("?"), F.lit(1))
    each = F.transform(F.filter(F.split(body, ","), lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(F.coalesce(F.try_url_decode(x), x))))
    return F.concat(F.lit("mailto:"), F.array_join(each, ","))


def normalize_file(url: Column) -> Column:
    """A file:// form of file addresses and local paths."""
    s = F.regexp_replace(url, r"\\", "/")
    p = parts(s)
    known = F.concat(F.lit("file://"), p["host"], p["path"])
    return F.when(F.lower(s).startswith("file:"), known).when(s.rlike("^[A-Za-z]:/"), F.concat(F.lit("file:///"), s)).otherwise(F.concat(F.lit("file://"), s))


def clean_query(query: Column) -> Column:
    """Without tracking parameters; a parameter without = gets one. Percent codes stay as they are."""
    tracking = F.array(*[F.lit(t) for t in TRACKING])
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.array_contains(tracking, F.lower(F.split_part(x, F.lit("="), F.lit(1)))))
    return F.array_join(F.transform(kept, lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("=")))), "&")


def normalize_url(raw: Column) -> Column:
    """Trimmed, without trailing punctuation, scheme and host in lower case, without tracking parameters and plain anchors. NULL is ''."""
    url = F.rtrim(F.trim(F.coalesce(raw, F.lit(""))), F.lit(TRAILING))
    p = parts(url)
    query, fragment = clean_query(p["query"]), p["fragment"]
    kept = fragment.startswith("!") | fragment.contains("/") | fragment.contains("=")
    tail = F.concat(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")), F.when(kept, F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))
    whole = F.concat(p["scheme"], F.lit(":"), F.when(p["host"] != "", F.concat(F.lit("//"), p["host"])).otherwise(F.lit("")), p["path"], tail)
    return F.when(is_mailto(url), normalize_mailto(url)).when(is_local(url), normalize_file(url)).when(p["scheme"] == "", url).otherwise(whole)


def target_system(url: Column, systems: dict[str, list[str]] | None = None) -> Column:
    """The system an address belongs to; the first rule that holds. systems: further systems by parts of their hosts, asked last and in order."""
    p = parts(url)
    h, w = p["host"], F.lower(p["path"])
    pages = _has(w, ["/wiki/", "/display/"])
    return (
        F.when(is_mailto(url), "email")
        .when(is_local(url), "local_file")
        .when(h == "", "unknown")
        .when(_has(h, ["onedrive.live.com", "1drv.ms", "my.sharepoint.com"]), "onedrive")
        .when(h.contains("sharepoint.com") | _has(w, ["/sites/", *OFFICE]), "sharepoint")
        .when(_has(h, ["dev.azure.com", "visualstudio.com"]) | _has(w, ["_workitems", "_git", "_wiki", "pullrequest"]), "azure_devops")
        .when((h.startswith("jira.") | _has(h, [".jira.", "atlassian.net"])) & _has(w, ["/browse/", "/jira/"]), "jira")
        .when(h.startswith("confluence.") | h.contains(".confluence.") | pages, "confluence")
        .when((h == "github.com") | h.endswith(".github.com"), "github")
        .when(h.contains("teams.microsoft.com") | _has(w, ["/l/message/", "/l/channel/", "/l/meetup-join/"]), "teams")
        .otherwise(system_for_host(h, systems or {}, "external_web"))
    )


def system_for_host(host: Column, systems: dict[str, list[str]], otherwise: str | None = None) -> Column:
    """The first of the configured systems of which a domain is part of the host."""
    return F.coalesce(*[F.when(_has(F.lower(host), [d.lower() for d in domains]), name) for name, domains in systems.items() if domains], F.lit(otherwise))


def target_type(url: Column, system: Column) -> Column:
    """The kind of thing within its system."""
    w = F.lower(parts(url)["path"])
    document = w.rlike(DOCUMENT)
    segments = F.size(F.filter(F.split(w, "/"), lambda x: x != ""))
    folder = w.contains("/personal/") & (w.endswith("/") | w.contains("/documents"))
    office = F.when(_has(w, OFFICE) | document, "document").when(folder, "folder").otherwise("document")
    devops = F.when(w.contains("_workitems"), "work_item").when(w.contains("pullrequest"), "pull_request").when(w.contains("_git"), "repository").when(w.contains("_wiki"), "wiki_page").otherwise("unknown")
    teams = F.when(w.contains("/l/message/"), "message").when(w.contains("/l/channel/"), "channel").when(w.contains("/l/meetup-join/"), "meeting").otherwise("unknown")
    return (
        F.when(system == "email", "email_address")
        .when(system.isin("sharepoint", "onedrive"), office)
        .when(system == "azure_devops", devops)
        .when(system == "github", F.when(w.contains("/pull/"), "pull_request").when(segments >= 2, "repository").otherwise("unknown"))
        .when(system == "teams", teams)
        .when(system == "confluence", "wiki_page")
        .when(system == "jira", "work_item")
        .when(system == "local_file", F.when(document, "document").when(url.endswith("/"), "folder").otherwise("unknown"))
        .when((system == "external_web") & document, "document")
        .otherwise("unknown")
    )


def link_kind(url: Column, system: Column, internal_domains: list[str] | None = None) -> Column:
    """email, local, internal (a configured domain or one of the internal systems), external or unknown."""
    p = parts(url)
    own = _has(F.lower(F.concat(p["host"], p["path"])), [d.lower() for d in internal_domains]) if internal_domains else F.lit(False)
    return (
        F.when(system == "email", "email").when(system == "local_file", "local").when(own | system.isin(INTERNAL), "internal").when(system.isin("github", "external_web"), "external").otherwise("unknown")
    )
