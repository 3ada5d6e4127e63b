"""URL policy: canonical form, safe form, threads, acceptance, frontier order."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote_plus

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Scheme, user part, host, port, path, query of a web address.
PARTS = r"^(?i:(https?))://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^:/?#\[\]@]*)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
#: Query keys that only track, and names of hosts that aren't public (fixed values).
TRACKING = r"(?i)^(?:utm_.*|fbclid|gclid)$"
PRIVATE = r"^(?:localhost|.*\.(?:localhost|local|internal))$"
PORTS = {"http": "80", "https": "443"}


def public_host(host: str) -> str | None:
    """The host in ASCII and lower case, or None where it is local or no public address."""
    host = host.strip("[]").rstrip(".").lower()
    try:
        if not host.isascii():
            host = host.encode("idna").decode()
    except UnicodeError:
        return None
    if not host or len(host) > 253 or re.search(PRIVATE, host):
        return None
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return None if ":" in host else host
    return (f"[{ip}]" if ip.version == 6 else host) if ip.is_global else None


def canonical(url: str | None) -> str | None:
    """U1 for one address: None where it is no public http(s) address."""
    m = re.match(PARTS, re.sub(r"[\t\r\n]", "", (url or "").strip()), re.DOTALL)
    host = m and public_host(m[3])
    if not host or (m[2] or "").strip(":") or m[4] not in (None, "", *PORTS.values()):
        return None
    scheme = m[1].lower()
    port = "" if m[4] in (None, "", PORTS[scheme]) else f":{m[4]}"
    pairs = sorted(p for p in parse_qsl(m[6] or "", keep_blank_values=True) if not re.match(TRACKING, p[0]))
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in pairs)
    return f"{scheme}://{host}{port}{m[5] or '/'}" + f"?{query}" * bool(query)


@pandas_udf(StringType())
def _odd_hosts(s):  # type: ignore[no-untyped-def]
    return s.map(lambda x: None if x is None else public_host(x))


def canonical_urls(column: Column) -> Column:
    """U1 as a column. Only hosts that are no plain names (addresses, other scripts) leave the JVM."""
    url = F.regexp_replace(F.trim(F.regexp_replace(column, r"^\s+|\s+$", "")), r"[\t\r\n]", "")
    part = lambda i: F.regexp_extract(url, "(?s)" + PARTS, i)
    scheme, host, port, path = F.lower(part(1)), F.lower(part(3)), part(4), part(5)
    plain = host.rlike(r"^(?=.{1,253}$)[a-z0-9_-]+(?:\.[a-z0-9_-]+)*\.?$") & ~host.rlike(r"^[0-9.]+$")
    own = F.regexp_replace(host, r"\.+$", "")
    good = F.when(plain, F.when(~own.rlike(PRIVATE), own)).otherwise(_odd_hosts(F.when(~plain & (scheme != ""), part(3))))
    text = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.filter(F.split(part(6), "&"), lambda x: x != "")
    pairs = F.transform(pairs, lambda x: F.struct(text(F.regexp_extract(x, "(?s)^([^=]*)", 1)).alias("k"), text(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))
    code = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(code(p["k"]), F.lit("="), code(p["v"]))), "&")
    default = F.when(scheme == "http", PORTS["http"]).otherwise(PORTS["https"])
    shown = F.when(port.isin("", *PORTS.values()), F.concat(scheme, F.lit("://"), good, F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))
    return F.when(F.regexp_replace(part(2), ":+", "") == "", shown)


def safe_url(column: Column) -> Column:
    """Scheme, host, port and path; credentials, query and fragment never show."""
    part = lambda i: F.regexp_extract(column, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)", i)
    place = F.lower(F.regexp_replace(part(2), r"(?s)^//(?:.*@)?", ""))
    bad = ~place.rlike(r"^(?:\[[0-9a-f:.]*\]|[^\[\]:]*)(?::[0-9]{0,5})?$") | (F.coalesce(F.regexp_extract(place, r":([0-9]{1,5})$", 1).try_cast("int"), F.lit(0)) > 65535)
    scheme = F.when(part(1) == "", "").otherwise(F.concat(F.lower(part(1)), F.lit(":")))
    return F.when(bad, "<invalid url>").otherwise(F.concat(scheme, F.when(part(2) == "", "").otherwise(F.lit("//")), F.regexp_replace(place, ":$", ""), part(3)))


def scrubbed(column: Column, most: int = 120) -> Column:
    """Addresses in a text lose query and fragment; single spaces, at most so many characters."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(column, r"(https?://[^\s?#'\"<>]*)[?#][^\s'\"<>]*", "$1"), r"(?U)\s+", " ")), F.lit(most))


THREAD = r"^https?://[^/]*/r/([^/]+)/comments/([a-z0-9]+)"
STORY = r"^([^?]*)\?(?:.*&)?id=([^&#]*)"


def thread_of(adapter: str, url: str) -> str:
    """U12 for one address."""
    if adapter == "reddit" and (m := re.match(THREAD, url, re.IGNORECASE)):
        return f"https://www.reddit.com/r/{m[1].lower()}/comments/{m[2].lower()}/"
    if adapter == "hackernews" and (m := re.match(STORY, url)) and m[2]:
        return f"{m[1]}?id={m[2]}"
    return url


def thread_url(adapter: Column, url: Column) -> Column:
    """Permalinks of a thread become the thread."""
    post = lambda i: F.lower(F.regexp_extract(url, "(?i)" + THREAD, i))
    story = lambda i: F.regexp_extract(url, STORY, i)
    reddit = F.concat(F.lit("https://www.reddit.com/r/"), post(1), F.lit("/comments/"), post(2), F.lit("/"))
    return F.when((adapter == "reddit") & (post(2) != ""), reddit).when((adapter == "hackernews") & (story(2) != ""), F.concat(story(1), F.lit("?id="), story(2))).otherwise(url)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def accepting_profile(urls: DataFrame, profiles: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """The first profile in order that allows the host and, where it names patterns, the path.
    profiles: name, ord, allowed_domains, patterns; a small table of configuration."""
    domains = profiles.select("name", "ord", "patterns", F.explode("allowed_domains").alias(host))
    fits = (F.size("patterns") == 0) | F.exists("patterns", lambda p: F.rlike(F.col(path), p))
    met = urls.join(domains, host).where(fits)
    return met.groupBy(*urls.columns).agg(F.min_by("name", "ord").alias("profile"))


def frontier(urls: DataFrame, per_source: int, total: int, source: str = "source", order: str = "ord") -> DataFrame:
    """Seeds in round robin over sources; a source's budget skips its later rows, and skips don't use up the total."""
    own = urls.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(order))).where(F.col("turn") <= per_source)
    first = own.orderBy("turn", source).limit(total)  # the crawl budget bounds what is numbered
    return first.withColumn("place", F.row_number().over(Window.orderBy("turn", source)))
