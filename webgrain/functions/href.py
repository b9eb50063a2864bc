r"""Web addresses as the URL standard writes them: dot segments, percent-encoding, ports, relative links.

Everything is a native expression; a path is folded over its segments as a stack.
Host names outside ASCII are lower-cased and kept (no Punycode), and numeric hosts are
read as decimal IPv4 addresses only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgrain.functions.base import let, trim

# Fixed values of the URL standard: characters that each part encodes besides controls, blanks and non-ASCII ones.
IN_PATH = '"<>^`{}'
IN_QUERY = "\"<>'"
IN_FRAGMENT = '"<>`'
DEFAULT_PORTS = {"http": "80", "https": "443"}

#: Scheme, slashes, authority, path, query, fragment of an http(s) address.
PARTS = r"(?s)^(?i:(https?)):[/\\]*([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_AUTHORITY = r"^(?:(.*)@)?([^@:]*)(?::([0-9]*))?$"
#: A dot, plain or encoded.
_DOT = "(?:\\.|%2[eE])"
_DOTS = rf"(?:^|/){_DOT}{{1,2}}(?:/|$)"
#: What no host may hold.
_BAD_HOST = r"[\x00-\x20#/<>?@\[\\\]^|%\x7f]"


def percent_encoded(c: Column, also: str) -> Column:
    """c with controls, blanks, non-ASCII characters and those of also as %XX of their UTF-8 bytes; % stays."""
    escaped = "".join("\\" + x for x in also)
    odd = rf"[^\x21-\x7e]|[{escaped}]"
    each = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    encoded = F.array_join(F.transform(each, lambda x: F.when(x.rlike(odd), F.regexp_replace(F.hex(x), "(..)", "%$1")).otherwise(x)), "")
    return F.when(c.rlike(odd), encoded).otherwise(c)


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, with its . and .. segments carried out."""
    steps = F.split(F.substring(path, 2, 1 << 30), "/", -1)

    def fold(kept: Column, at: Column) -> Column:
        step, last = at["step"], at["last"]
        end = F.when(last, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        up = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(step.rlike(f"^{_DOT}{{2}}$"), F.concat(up, end)).when(step.rlike(f"^{_DOT}$"), F.concat(kept, end)).otherwise(F.concat(kept, F.array(step)))

    numbered = F.transform(steps, lambda s, i: F.struct(s.alias("step"), (i == F.size(steps) - 1).alias("last")))
    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(numbered, F.array().cast("array<string>"), fold), "/"))
    return F.when(path.rlike(_DOTS), folded).otherwise(path)


def clean_path(path: Column) -> Column:
    """A path with slashes only, encoded, without dot segments; an empty one is '/'."""
    slashed = F.regexp_replace(path, r"\\", "/")
    rooted = F.when(slashed == "", "/").otherwise(slashed)
    return let(percent_encoded(rooted, IN_PATH), without_dots)


def clean_query(query: Column) -> Column:
    return F.when(query == "?", query).otherwise(percent_encoded(query, IN_QUERY))


def _ipv4(host: Column) -> Column:
    """A host whose last label is a number, as four parts; null if it is no address."""
    parts = F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), lambda p: F.when(p.rlike("^[0-9]{1,10}$"), p.cast("long")))
    n = F.size(parts)
    low = F.element_at(parts, -1)
    high = F.aggregate(F.slice(parts, F.lit(1), n - 1), F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    fits = (n <= 4) & F.forall(F.slice(parts, F.lit(1), n - 1), lambda p: p < 256) & (low < F.pow(F.lit(256), 5 - n))
    number = high * F.pow(F.lit(256), 5 - n).cast("long") + low
    shown = F.array_join(F.transform(F.array(*(F.lit(s) for s in (24, 16, 8, 0))), lambda s: F.expr("0").cast("long") + (F.floor(number / F.pow(F.lit(2), s)) % 256).cast("long")), ".")
    return F.when(F.coalesce(fits, F.lit(False)), shown)


def host(authority: Column) -> Column:
    """Lower-case host of an authority, null if no host may be written so."""
    name = F.lower(F.regexp_extract(authority, _AUTHORITY, 2))
    number = name.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$")
    return F.when(authority.rlike(_AUTHORITY) & (name != "") & ~name.rlike(_BAD_HOST), F.when(number, _ipv4(name)).otherwise(name))


def split(c: Column) -> Column:
    """struct(scheme, user, host, port, path, query, fragment), cleaned; null if c is no http(s) address."""
    t = F.regexp_replace(trim(c), r"[\t\n\r]", "")
    found = F.when(t.rlike(PARTS), F.struct(*(F.regexp_extract(t, PARTS, k).alias(n) for k, n in enumerate(("scheme", "authority", "path", "query", "fragment"), 1))))

    def clean(p: Column) -> Column:
        scheme, port = F.lower(p["scheme"]), F.regexp_replace(F.regexp_extract(p["authority"], _AUTHORITY, 3), "^0+(?=.)", "")
        default = F.when(scheme == "http", DEFAULT_PORTS["http"]).otherwise(DEFAULT_PORTS["https"])
        user = F.regexp_extract(p["authority"], _AUTHORITY, 1)
        made = F.struct(
            scheme.alias("scheme"),
            F.when(user != "", F.concat(user, F.lit("@"))).otherwise("").alias("user"),
            host(p["authority"]).alias("host"),
            F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)).alias("port"),
            clean_path(p["path"]).alias("path"),
            clean_query(p["query"]).alias("query"),
            percent_encoded(p["fragment"], IN_FRAGMENT).alias("fragment"),
        )
        fits = (F.length(port) < 6) & (F.coalesce(F.when(port != "", port.cast("int")), F.lit(0)) < 65536)
        return F.when(fits, made)

    return let(let(found, clean), lambda p: F.when(p["host"].isNotNull(), p))


def join(p: Column) -> Column:
    """The address of a split one; null of null. A lone ? or # stays, as the standard has it."""
    return F.concat(p["scheme"], F.lit("://"), p["user"], p["host"], p["port"], p["path"], p["query"], p["fragment"])


def href(c: Column) -> Column:
    """The address as the standard writes it, or null."""
    return let(split(c), join)


def safe(c: Column) -> Column:
    """An http(s) address to open, https:// put before what has no scheme; null for scripts, mail, files and no addresses."""
    t = trim(c)
    blocked = t.rlike(r"(?i)^(javascript|data|vbscript|file|mailto):") | (t == "")
    schemed = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", "")))
    return href(F.when(~blocked, schemed))


def resolve(link: Column, base: Column) -> Column:
    """The address that a link on the page base leads to; null for other schemes or without a base.

    A link without a scheme takes the base's scheme, host, and as much of its path and
    query as the standard says: all for an empty link or a fragment, the path for a
    query, the folder for a relative path.
    """

    def against(p: Column) -> Column:
        t = F.regexp_replace(trim(link), r"[\t\n\r]", "")
        site = F.concat(p["scheme"], F.lit("://"), p["user"], p["host"], p["port"])
        folder = F.regexp_replace(p["path"], "[^/]*$", "")
        whole = (
            F.when(t.rlike("(?i)^https?:[/\\\\]"), t)
            .when(t.rlike(r"^(?i)[a-z][a-z0-9+.\-]*:"), F.lit(None).cast("string"))
            .when(t.rlike(r"^[/\\]{2}"), F.concat(p["scheme"], F.lit(":"), t))
            .when(t.rlike(r"^[/\\]"), F.concat(site, t))
            .when(t.startswith("#") | (t == ""), F.concat(site, p["path"], p["query"], t))
            .when(t.startswith("?"), F.concat(site, p["path"], t))
            .otherwise(F.concat(site, folder, t))
        )
        return href(whole)

    return F.when(link.isNotNull(), let(split(base), against))
