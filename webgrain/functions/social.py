"""Social links of a brand: which addresses are profiles, their handles, ranks and the ones that fit a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webgrain.functions.base import all_of, any_of, distinct_by, let, trim

# Hosts, marks and paths that are no profiles, and the bounds of what is shown.
HOSTS = {
    "instagram": r"(^|\.)instagram\.com$",
    "facebook": r"(^|\.)facebook\.com$|(^|\.)fb\.com$",
    "linkedin": r"(^|\.)linkedin\.com$",
    "x": r"(^|\.)twitter\.com$|(^|\.)x\.com$",
    "youtube": r"(^|\.)youtube\.com$|(^|\.)youtu\.be$",
}
MARKS = {"youtube": "▶", "instagram": "◎", "facebook": "f", "linkedin": "in", "x": "X"}
NO_PROFILE = {
    "youtube": r"(?i)^/(watch|shorts|embed|playlist|live|feed|gaming|results|clip|redirect)(/|$)",
    "facebook": r"(?i)^/(share|sharer|sharer\.php|dialog|plugins|posts|videos|watch|photo\.php|story\.php|groups|events|marketplace|login|help|privacy|policies|legal|l\.php|flx|reel|reels)(/|$)",
    "instagram": r"(?i)^/(p|reel|reels|stories|tv|explore|accounts|direct|about|legal|developer)(/|$)",
    "x": r"(?i)^/(intent|share|i|home|search|explore|settings|privacy|tos|hashtag|status)(/|$)",
    "linkedin": r"(?i)^/(posts|feed|pulse|learning|jobs|login|signup|share|shareArticle|embed|video|events|groups|school|public-profile)(/|$)",
}
GENERIC_PATH = r"(?i)^/(watch|shorts|embed|playlist|share|sharer|intent|post|posts|video|videos|reel|reels)(/|$)"
STOP_WORDS = ["the", "and", "inc", "llc", "ltd", "corp", "co", "company", "official"]
PATH_CHARS, HANDLE_CHARS = 36, 28


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def brand_tokens(name: Column, website: Column) -> Column:
    """Words of three characters or more of a name, and the first label of the website's host."""
    words = F.split(F.lower(trim(name)), "[^a-z0-9]+")
    host = F.regexp_extract(F.lower(trim(website)), r"^(?:https?://)?(?:www\.)?([^/?#:]+)", 1)
    tokens = F.concat(words, F.array(F.regexp_extract(host, r"^([^.]*)", 1)))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS)))


def slug_matches(slug: Column, brands: Column) -> Column:
    """Whether a slug holds a brand token or lies in one."""
    return let(_plain(slug), lambda s: (s != "") & F.exists(brands, lambda t: (F.length(_plain(t)) >= 3) & (s.contains(_plain(t)) | _plain(t).contains(s))))


def _parts(token: Column) -> Column:
    """struct(platform, host, path, seg, v) of an address with or without a scheme."""
    t = F.regexp_replace(trim(token), r"^[\s.,;:·•|]+|[\s.,;:·•|]+$", "")
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))

    def cut(u: Column) -> Column:
        host = F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)), r"^www\.", "")
        path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"(?i)^https?://[^/?#]+([^?#]*)", 1), "/+", "/"), "/$", "")
        platform = F.coalesce(*(F.when(host.rlike(pattern), name) for name, pattern in HOSTS.items()))
        return F.struct(
            platform.alias("platform"),
            host.alias("host"),
            F.when(path == "", "/").otherwise(path).alias("path"),
            F.filter(F.split(path, "/"), lambda p: p != "").alias("seg"),
            u.rlike(r"[?&]v(=|&|#|$)").alias("v"),
        )

    return let(F.when(F.length(trim(token)) >= 4, full), cut)


def _at(u: Column, k: int) -> Column:
    return F.coalesce(F.get(u["seg"], F.lit(k)), F.lit(""))


def is_profile(u: Column, brands: Column) -> Column:
    """Whether the parts of an address name a profile: pages of posts and the like do not, persons only if like the brand."""
    path, first, n = u["path"], _at(u, 0), F.size(u["seg"])
    brand = slug_matches(first, brands)
    kind = {
        "youtube": ~u["host"].rlike(r"(^|\.)youtu\.be$") & ~u["v"] & (path.rlike("(?i)^/(@|channel/|c/|user/)") | brand),
        "linkedin": path.rlike("(?i)^/(company|showcase)/") | (path.rlike("(?i)^/in/") & slug_matches(_at(u, 1), brands)),
        "facebook": (n >= 1) & (path.rlike("(?i)^/pages/") | (~first.rlike("(?i)^(profile|people|pages|pg)$") & (n <= 2))),
        "instagram": n == 1,
        "x": n == 1,
    }
    return any_of(*((u["platform"] == p) & ~path.rlike(NO_PROFILE[p]) & ok for p, ok in kind.items()))


def handle(u: Column) -> Column:
    """What stands for a profile: @name, /name or /company/name; null if there is nothing to show."""
    first, second, path = _at(u, 0), _at(u, 1), u["path"]
    slug = F.when(first != "", F.concat(F.lit("/"), first))
    two = lambda *kinds: F.when(F.lower(first).isin(*kinds) & (second != ""), F.concat(F.lit("/"), F.lower(first), F.lit("/"), second))
    at = lambda name: F.when(name != "", F.concat(F.lit("@"), name))
    by = {
        "instagram": at(F.regexp_replace(first, "^@", "")),
        "facebook": F.when((F.lower(first) == "pages") & (second != ""), F.concat(F.lit("/"), second)).otherwise(slug),
        "x": slug,
        "linkedin": two("company", "in", "school"),
        "youtube": F.when(path.startswith("/@"), at(F.regexp_replace(path, "^/@", ""))).otherwise(F.coalesce(two("channel", "user", "c"), slug)),
    }
    text = F.coalesce(*(F.when(u["platform"] == p, h) for p, h in by.items()))
    return F.when(~text.rlike(GENERIC_PATH) & (F.length(text) <= HANDLE_CHARS), text)


def profile_score(u: Column, brands: Column) -> Column:
    path, n = u["path"], F.size(u["seg"])
    is_on = lambda *names: u["platform"].isin(*names)
    points = [
        (slug_matches(F.regexp_replace(_at(u, 0), "^@", ""), brands), 80),
        (is_on("linkedin") & path.rlike("(?i)^/company/"), 50),
        (is_on("youtube") & path.startswith("/@"), 25),
        (is_on("instagram", "facebook", "x") & (n == 1), 20),
        (is_on("linkedin") & path.rlike("(?i)^/in/"), -15),
        (is_on("youtube") & path.rlike("(?i)/channel/"), 10),
    ]
    return sum((F.when(when, worth).otherwise(0) for when, worth in points), F.lit(10))


def parse_link(token: Column, brands: Column) -> Column:
    """struct(platform, path, label, shown, score) of a profile's address, else null."""

    def build(u: Column) -> Column:
        mark = F.coalesce(*(F.when(u["platform"] == p, m) for p, m in MARKS.items()))
        fits = F.length(u["path"]) <= PATH_CHARS + F.when(u["path"].startswith("/@") & (u["platform"] == "youtube"), 1).otherwise(0)
        made = lambda h: F.when(
            all_of(is_profile(u, brands), fits, h.isNotNull()),
            F.struct(u["platform"].alias("platform"), u["path"].alias("path"), h.alias("label"), F.concat_ws(" ", mark, h).alias("shown"), profile_score(u, brands).alias("score")),
        )
        return let(handle(u), made)

    return let(_parts(token), build)


def split_links(raw: Column) -> Column:
    """The addresses of a cell, split at separators, line ends and before each scheme."""
    chunks = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"\s*[,;·•|]\s*|[\n\r]+"), trim), lambda c: c != "")

    def parts(c: Column) -> Column:
        urls = F.regexp_extract_all(c, F.lit(r"(?i)https?://[^\s,;·•|]+"), F.lit(0))
        return F.when(F.size(urls) > 1, urls).otherwise(F.split(c, r"(?i)\s+(?=https?://)"))

    return F.flatten(F.transform(chunks, parts))


def parse_links(raw: Column, brands: Column) -> Column:
    """The distinct profiles of a cell, the best first; those that tie keep their order."""
    found = F.filter(F.transform(split_links(raw), lambda t: parse_link(t, brands)), lambda p: p.isNotNull())
    once = lambda items: distinct_by(items, lambda p: F.concat_ws(":", p["platform"], F.lower(p["path"])))
    ranked = lambda items: F.array_sort(F.transform(items, lambda p, i: F.struct((-p["score"]).alias("by"), i.alias("i"), p.alias("p"))))
    return F.transform(ranked(let(found, once)), lambda r: r["p"])


def fit_line(links: Column, most: int, left: float, right: float, font: float, icon: float, gap: float = 6, space: float = 12) -> Column:
    """The first links, at most so many, whose estimated widths fit between left and right."""
    kept = F.slice(links, 1, most)
    ends = F.transform(kept, lambda p, i: F.lit(float(left)) + F.aggregate(F.slice(kept, F.lit(1), i + 1), F.lit(0.0), lambda x, q: x + F.ceil(icon + gap + F.length(q["shown"]) * font * 0.52) + space) - space)
    return F.filter(kept, lambda p, i: F.get(ends, i) <= right)
