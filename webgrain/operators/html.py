"""Whole summaries of HTML pages, and sites put together from their pages.

One Arrow pass reads a page's markup with a tolerant tokenizer (tags that nest or
do not, quoted or bare attributes, entities, scripts, comments) and walks its
JSON-LD; it hands on the raw parts. What they mean is decided by native
expressions: addresses are resolved, contacts normalised, lists made distinct
and capped. A site is assembled from its home page and up to three more; pages are
chosen by narrow columns first, so only those that count are read and parsed.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from webgrain.functions import contact, href
from webgrain.functions import text as X
from webgrain.functions import url as U
from webgrain.functions.base import distinct_by, first_by, let, trim
from webgrain.operators.records import parse

# What a summary looks for, and how much of it it holds.
BUSINESS = re.compile(
    "Organization|LocalBusiness|Store|Corporation|ProfessionalService|MedicalBusiness|FinancialService|EducationalOrganization|SportsOrganization|GovernmentOrganization",
    re.IGNORECASE,
)
POSTAL = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")
SOCIAL_HOST = r"(?i)(instagram\.com|facebook\.com|fb\.com|linkedin\.com|twitter\.com|x\.com|youtube\.com)"
LOGO_WORDS, LOGO_NOISE = "logo|brand|wordmark", "enterprise-accordion|nav-bg|testimonial"
LOGO_NOISE_ANYWHERE = LOGO_NOISE + r"|headshot|case-study|sessions-\d"
PHOTO_WORDS = r"(?i)\b(view of|imitating|forms a|overhead|aerial|exterior|street view)\b"
LONG_ALT, SHOWN_ALT = 60, 120
FOOTER_CHARS, FOOTER_LEAST, HOME_CHARS, EXTRA_CHARS = 2_000, 20, 14_000, 8_000
LOGOS, LINKS, SOCIALS, EMAILS, PHONES, ADDRESSES = 16, 16, 20, 16, 16, 8
EXTRA_PAGES = 3
FOOTER_CLASSES = {"site-footer", "footer", "page-footer"}
HIDDEN = {"script", "style", "noscript", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.IGNORECASE) for name in ("script", "style", "title", "textarea")}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>?|<[!?/][^>]*+>?|([^<]++|<)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_SPACE = re.compile(r"\s+")
_REFERENCE = re.compile("&(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|([A-Za-z][A-Za-z0-9]*)(;?))")


def unescaped(text: str, bare: tuple[str, ...] | None = None) -> str:
    """text with its character references read as the standard has it; bare, if given, holds the only names that need no semicolon."""
    if bare is None or "&" not in text:
        return entities.unescape(text)

    def read(m: re.Match) -> str:
        name = m[1]
        if name is None or (m[2] and f"{name};" in html5):
            return entities.unescape(m[0])
        short = next((b for b in bare if name.startswith(b)), None)
        return m[0] if short is None else entities.unescape(f"&{short};") + m[0][1 + len(short) :]

    return _REFERENCE.sub(read, text)


def tokens(markup: str, bare: tuple[str, ...] | None = None) -> Iterator[tuple[str, str, dict[str, str] | str]]:
    """('open', name, attributes), ('close', name, ''), ('text', '', text) and ('raw', name, text of a script, style, title or textarea); bare as in unescaped."""
    at = 0
    while at < len(markup):
        found = _TOKEN.match(markup, at)
        at = found.end()
        slash, name, inside, plain = found.groups()
        if plain is not None:
            yield "text", "", plain
        elif name and slash:
            yield "close", name.lower(), ""
        elif name:
            given: dict[str, str] = {}
            for key, double, single, plainly in _ATTRIBUTE.findall(inside):
                given.setdefault(key.lower(), unescaped(double or single or plainly, bare))
            name = name.lower()
            yield "open", name, given
            if name in RAW and not inside.endswith("/"):
                end = RAW[name].search(markup, at)
                upto = end.start() if end else len(markup)
                yield "raw", name, markup[at:upto]
                at = upto


def _squeezed(parts: list[str], bare: tuple[str, ...] | None = None) -> str:
    return _SPACE.sub(" ", unescaped("".join(parts), bare)).strip()


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def linked_data(value: object) -> tuple[list[str], list[str], list[str], list[list[str] | str]]:
    """(images, e-mails, phones, addresses) of a JSON-LD value, object by object from the outside in."""
    images, emails, phones, addresses, todo = [], [], [], [], [value]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += reversed(node)
            continue
        if not isinstance(node, dict):
            continue
        for key in ("logo", "image"):
            one = node.get(key)
            if isinstance(one, str) and re.match("https?://", one, re.IGNORECASE):
                images.append(one)
            elif isinstance(one, dict) and isinstance(one.get("url"), str):
                images.append(one["url"])
        kinds = node.get("@type")
        kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
        if any(map(BUSINESS.search, kinds)) or not node.keys().isdisjoint(("email", "telephone", "address", "contactPoint")):
            points = node.get("contactPoint") or []
            for owner in [node, *(points if isinstance(points, list) else [points])]:
                if isinstance(owner, dict):
                    emails += filter(None, [_text(owner.get("email"))])
                    phones += filter(None, [_text(owner.get("telephone"))])
            place = node.get("address")
            if isinstance(place, dict):
                addresses.append([_text(place.get(k)) or "" for k in POSTAL])
            elif isinstance(place, str):
                addresses.append(place)
        todo += reversed(node.values())
    return images, emails, phones, addresses


def read_page(markup: str, bare: tuple[str, ...] | None = None) -> dict[str, object]:
    """The raw parts of a page; bare as in unescaped."""
    out: dict[str, object] = {"title": "", "metas": [], "links": [], "anchors": [], "images": [], "data_images": [], "data_emails": [], "data_phones": [], "data_addresses": [], "footers": [], "has_body": False}
    text: list[str] = []
    body: list[str] = []
    stack: list[tuple[str, list[int] | str | None]] = []
    open_: dict[str, int] = {}
    hidden = titled = in_body = 0
    every: list[str] = []
    feet: list[list[int]] = []  # where the texts of each footer begin and end in every
    for kind, name, value in tokens(markup, bare):
        if kind == "text":
            every.append(value)
            if not hidden:
                (body if in_body else text).append(value)
        elif kind == "raw":
            if name == "title" and not titled:
                titled, out["title"] = 1, _squeezed([value], bare)
            if name in ("title", "textarea") and not hidden:
                (body if in_body else text).append(value)
            every.append(value)
            if name == "script" and stack[-1][1] == "ld":
                try:
                    for key, more in zip(("data_images", "data_emails", "data_phones", "data_addresses"), linked_data(parse(value.strip())), strict=True):
                        out[key] += more
                except ValueError:
                    pass
        elif kind == "open":
            given = value
            if name == "meta":
                out["metas"].append({"name": given.get("name"), "property": given.get("property"), "content": given.get("content")})
            elif name == "link" and "href" in given:
                out["links"].append({"rel": given.get("rel", "").lower(), "href": given["href"]})
            elif name == "a" and "href" in given:
                out["anchors"].append(given["href"].strip())
            elif name in ("img", "source") and given.get("src"):
                shown = {k: given.get(k) for k in ("src", "alt", "id", "class", "width", "height")}
                out["images"].append(shown | {"tag": name, "in_header": bool(open_.get("header") or open_.get("nav"))})
            if name == "body":
                in_body, out["has_body"] = 1, True
            if name in VOID:
                continue
            mark: list[int] | str | None = None
            if name == "script" and given.get("type") == "application/ld+json":
                mark = "ld"
            elif name == "footer" or given.get("role") == "contentinfo" or given.get("id") == "footer" or not FOOTER_CLASSES.isdisjoint(given.get("class", "").split()):
                mark = [len(every), -1]
                feet.append(mark)
            stack.append((name, mark))
            open_[name] = open_.get(name, 0) + 1
            hidden += name in HIDDEN
        elif open_.get(name):
            closed = ""
            while closed != name:
                closed, mark = stack.pop()
                open_[closed] -= 1
                hidden -= closed in HIDDEN
                if isinstance(mark, list):
                    mark[1] = len(every)
    held = 0
    for start, end in feet:
        if held < FOOTER_CHARS:  # what comes later would be cut
            one = _squeezed(every[start : end if end >= 0 else None], bare)
            if len(one) >= FOOTER_LEAST:
                out["footers"].append(one)
                held += len(one)
    out["text"] = _squeezed(body if out["has_body"] else text, bare)
    out["data_addresses"] = [{"whole": a, "parts": None} if isinstance(a, str) else {"whole": None, "parts": a} for a in out["data_addresses"]]
    return out


_META, _LINK = ("name", "property", "content"), ("rel", "href")
_IMAGE = ("src", "alt", "id", "class", "width", "height", "tag")
_ARROW = pa.struct([
    ("title", pa.string()),
    ("metas", pa.list_(pa.struct([(n, pa.string()) for n in _META]))),
    ("links", pa.list_(pa.struct([(n, pa.string()) for n in _LINK]))),
    ("anchors", pa.list_(pa.string())),
    ("images", pa.list_(pa.struct([*((n, pa.string()) for n in _IMAGE), ("in_header", pa.bool_())]))),
    ("data_images", pa.list_(pa.string())),
    ("data_emails", pa.list_(pa.string())),
    ("data_phones", pa.list_(pa.string())),
    ("data_addresses", pa.list_(pa.struct([("whole", pa.string()), ("parts", pa.list_(pa.string()))]))),
    ("footers", pa.list_(pa.string())),
    ("text", pa.string()),
])


def page_reader(bare: tuple[str, ...] | None = None) -> Callable[[Column], Column]:
    """The raw parts of HTML texts; null as an empty page; bare as in unescaped."""

    @arrow_udf(from_arrow_type(_ARROW))
    def page_parts(markup: pa.Array) -> pa.Array:
        rows = []
        for page in markup.to_pylist():
            read = read_page(page or "", bare)
            rows.append({f.name: read[f.name] for f in _ARROW})
        return pa.array(rows, _ARROW)

    return page_parts


def meta_content(parts: Column, by: str, name: str) -> Column:
    """The trimmed content of the first meta tag with a name or property; null if there is none."""
    found = F.filter(parts["metas"], lambda m: (m[by] == name) & m["content"].isNotNull())
    return F.when(F.size(found) > 0, trim(F.get(found, F.lit(0))["content"]))


_CANDIDATE = "array<struct<raw: string, source: string, alt: string, width: string, height: string>>"


def _candidate(raw: Column, source: str, alt: Column | None = None, width: Column | None = None, height: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    shown = [x if x is not None else nothing for x in (alt, width, height)]
    return F.struct(raw.alias("raw"), F.lit(source).alias("source"), *(x.alias(n) for x, n in zip(shown, ("alt", "width", "height"), strict=True)))


def _pixels(c: Column) -> Column:
    n = F.regexp_extract(trim(c), r"^\+?(\d+)", 1).try_cast("int")
    return F.when(n > 0, n)


def logo_candidates(parts: Column, base: Column) -> Column:
    """Array of (url, source, alt, width, height): images that may be the site's logo, each address once, in order of trust.

    Linked icons, or else the default one; social preview images; images in headers and
    navigation; images of JSON-LD; then images whose address, text or class speaks of a logo.
    """
    icons = F.transform(
        F.filter(parts["links"], lambda x: x["rel"].contains("icon")),
        lambda x: F.struct(x["href"].alias("raw"), F.when(x["rel"].isin("apple-touch-icon", "apple-touch-icon-precomposed"), "apple-touch-icon").otherwise("icon").alias("source"), *(F.lit(None).cast("string").alias(n) for n in ("alt", "width", "height"))),
    )
    given = F.filter(icons, lambda x: (x["raw"] != "") & href.resolve(x["raw"], base).isNotNull())
    default = F.array(_candidate(F.lit("/favicon.ico"), "icon", F.lit("default favicon"))).cast(_CANDIDATE)
    previews = F.array(
        _candidate(meta_content(parts, "property", "og:image"), "og:image", meta_content(parts, "property", "og:image:alt")),
        _candidate(meta_content(parts, "property", "og:logo"), "og:image", F.lit("og:logo")),
        _candidate(meta_content(parts, "name", "twitter:image"), "og:image", F.lit("twitter:image")),
    )

    def images(source: str, holds) -> Column:
        return F.transform(F.filter(parts["images"], holds), lambda x: _candidate(x["src"], source, x["alt"], x["width"], x["height"]))

    def blob(x: Column, *names: str) -> Column:
        return F.lower(F.concat_ws(" ", *(F.coalesce(x[n], F.lit("")) for n in names)))

    named = lambda x: ~x["in_header"] & blob(x, "src", "alt", "class").rlike(LOGO_WORDS) & ~blob(x, "src", "alt", "class").rlike(LOGO_NOISE)
    photo = lambda x: (F.length(F.coalesce(x["alt"], F.lit(""))) > LONG_ALT) & F.coalesce(x["alt"].rlike(PHOTO_WORDS), F.lit(False))
    anywhere = lambda x: (x["tag"] == "img") & blob(x, "src", "alt", "id", "class").contains("logo") & ~blob(x, "src", "alt", "id", "class").rlike(LOGO_NOISE_ANYWHERE) & ~photo(x)
    listed = F.concat(
        icons.cast(_CANDIDATE),
        F.when(F.size(given) == 0, default).otherwise(F.array().cast(_CANDIDATE)),
        previews.cast(_CANDIDATE),
        images("header-image", lambda x: x["in_header"] & (x["tag"] == "img")).cast(_CANDIDATE),
        F.transform(parts["data_images"], lambda u: _candidate(u, "og:image", F.lit("Structured data image"))).cast(_CANDIDATE),
        images("img-logo", named).cast(_CANDIDATE),
        images("img-logo", anywhere).cast(_CANDIDATE),
    )

    def resolved(x: Column) -> Column:
        alt = F.substring(trim(F.regexp_replace(F.coalesce(x["alt"], F.lit("")), r"\s+", " ")), 1, SHOWN_ALT)
        return F.struct(F.when(x["raw"] != "", href.resolve(x["raw"], base)).alias("url"), x["source"].alias("source"), F.when(alt != "", alt).alias("alt"), _pixels(x["width"]).alias("width"), _pixels(x["height"]).alias("height"))

    return first_by(F.filter(F.transform(listed, resolved), lambda x: x["url"].isNotNull()), lambda x: x["url"], LOGOS)


def page_summaries(pages: DataFrame, url_col: str = "url", html_col: str = "html", type_col: str | None = None, chars: int = HOME_CHARS, bare: tuple[str, ...] | None = None) -> DataFrame:
    """pages with a summary in place of the markup: titles, descriptions, logo candidates, links, contacts, footer, visible text.

    A null or empty page has an empty summary, with the default icon where its address is
    one. type_col, if given, names the page's type as its link told it. bare, if given, holds
    the only names of characters that are read without a semicolon; else the standard tells.
    Columns of pages named as those of the summary are replaced.
    """
    kept = [c for c in pages.columns if c != html_col]
    base = F.col(url_col)
    read = pages.withColumn("_parts", page_reader(bare)(F.col(html_col)))
    p = F.col("_parts")
    # An anchor is mail, a telephone number, or an address; only those of social hosts are kept.
    anchors = F.filter(p["anchors"], lambda a: a != "")
    mail = F.filter(anchors, lambda a: a.rlike("(?i)^mailto:"))
    tel = F.filter(anchors, lambda a: a.rlike("(?i)^tel:"))
    social = F.filter(F.transform(F.filter(anchors, lambda a: a.rlike(SOCIAL_HOST) & ~a.rlike("(?i)^(mailto|tel):")), lambda a: href.resolve(a, base)), lambda u: F.coalesce(U.domain(u).rlike(SOCIAL_HOST), F.lit(False)))
    own = U.page_type(F.regexp_extract(url_col, r"^(?i)https?://[^/?#]+([^?#]*)", 1))
    told = F.coalesce(F.col(type_col), F.lit("other")) if type_col else F.lit("other")
    kind = F.when(told.isin("", "other"), own).otherwise(told)
    written = F.filter(F.transform(p["data_addresses"], lambda a: F.when(a["whole"].isNotNull(), F.when(F.length(trim(a["whole"])).between(12, 240), trim(a["whole"]))).otherwise(contact.postal_address(*(F.get(a["parts"], F.lit(k)) for k in range(len(POSTAL)))))), lambda a: a.isNotNull())
    linked_mail = F.filter(F.transform(mail, contact.scraped_email), lambda e: e != "")
    linked_tel = F.filter(F.transform(tel, contact.phone_display), lambda e: e != "")
    found = {
        "page_type": F.when(kind != "other", kind),
        "title": p["title"],
        "description": F.coalesce(meta_content(p, "name", "description"), F.lit("")),
        "og_title": F.coalesce(meta_content(p, "property", "og:title"), F.lit("")),
        "og_description": F.coalesce(meta_content(p, "property", "og:description"), F.lit("")),
        "logos": logo_candidates(p, base),
        "mail_links": F.slice(F.array_distinct(mail), 1, LINKS),
        "tel_links": F.slice(F.array_distinct(tel), 1, LINKS),
        "socials_found": F.slice(F.array_distinct(social), 1, SOCIALS),
        "emails": F.slice(F.array_distinct(F.concat(F.slice(contact.distinct_emails(p["data_emails"]), 1, EMAILS), linked_mail)), 1, EMAILS),
        "phones": F.slice(F.array_distinct(F.concat(F.slice(contact.distinct_phones(p["data_phones"]), 1, PHONES), linked_tel)), 1, PHONES),
        "addresses": F.slice(contact.distinct_addresses(written), 1, ADDRESSES),
        "footer": F.substring(F.array_join(p["footers"], " · "), 1, FOOTER_CHARS),
        "visible_text": F.substring(p["text"], 1, chars),
    }
    made = read.withColumns({f"_{k}": v for k, v in found.items()})
    return made.select(*(F.col(c) for c in kept if c not in found), *(F.col(f"_{k}").alias(k) for k in found))


def site_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(site, id, place): of each host the home page (place 0: the shortest way, then the least id) and up to three more.

    The others come by type as a reader would pick them: about, services, contact or
    portfolio, the rest; then by id. Only addresses and ids are sorted.
    """
    path = F.regexp_extract(url_col, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    rows = pages.select(U.canonical_domain(U.domain(F.col(url_col))).alias("site"), F.col(id_col).alias("id"), U.priority(F.col(url_col)).alias("way"), U.page_type(path).alias("kind")).filter("site <> ''")
    home = rows.groupBy("site").agg(F.min(F.struct("way", "id")).alias("home")).select("site", F.col("home.id").alias("home"))
    turn = F.when(F.col("kind") == "about", 1).when(F.col("kind") == "services", 2).when(F.col("kind").isin("contact", "portfolio"), 3).otherwise(4)
    ranked = rows.join(home, "site").filter("id <> home").withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(turn, "id")))
    return home.select("site", F.col("home").alias("id"), F.lit(0).alias("place")).unionByName(ranked.filter(F.col("place") <= EXTRA_PAGES).select("site", "id", "place"))


def assemble_sites(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bare: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each host: its home page's titles, the lists of its pages united in order and capped, what the pages say of its depth.

    A page that mostly repeats the home page or an earlier page is read but leaves nothing.
    bare as in page_summaries.
    """
    chosen = site_pages(pages, id_col, url_col)
    read = page_summaries(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).join(chosen, "id"), bare=bare)
    cut_text = F.when(F.col("place") == 0, F.col("visible_text")).otherwise(F.substring("visible_text", 1, EXTRA_CHARS))
    page = F.struct("place", "id", "url", "page_type", "title", "description", "og_title", "og_description", "logos", "mail_links", "tel_links", "socials_found", "emails", "phones", "addresses", "footer", cut_text.alias("visible_text"))
    sites = read.groupBy("site").agg(F.sort_array(F.collect_list(page)).alias("all"))  # four pages at most

    def keep(kept: Column, one: Column) -> Column:
        repeats = F.exists(kept, lambda x: X.is_mostly_duplicate(x["visible_text"], one["visible_text"]))
        return F.when(repeats, kept).otherwise(F.concat(kept, F.array(one)))

    sites = sites.withColumn("kept", F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.slice("all", 1, 1), keep))
    home = lambda n: F.get(F.col("all"), F.lit(0))[n]
    every = lambda n: F.flatten(F.transform("kept", lambda x: x[n]))
    types = F.array_sort(F.array_distinct(F.filter(F.transform("kept", lambda x: x["page_type"]), lambda t: t.isNotNull())))
    footers = F.filter(F.transform("kept", lambda x: trim(x["footer"])), lambda t: t != "")
    lists = {
        "logos": first_by(every("logos"), lambda x: x["url"], LOGOS),
        "mail_links": F.slice(F.array_distinct(every("mail_links")), 1, LINKS),
        "tel_links": F.slice(F.array_distinct(every("tel_links")), 1, LINKS),
        "socials_found": F.slice(F.array_distinct(every("socials_found")), 1, SOCIALS),
        "emails": F.slice(contact.distinct_emails(every("emails")), 1, EMAILS),
        "phones": F.slice(contact.distinct_phones(every("phones")), 1, PHONES),
        "addresses": F.slice(contact.distinct_addresses(every("addresses")), 1, ADDRESSES),
        "footer": F.substring(F.array_join(footers, " · "), 1, FOOTER_CHARS),
        "page_types": types,
    }
    depth = F.array_compact(F.array(F.when((F.size("all") > 1) & ~F.exists("all", lambda x: F.coalesce(x["page_type"] == "contact", F.lit(False))), "no_contact_pages_found"), F.when(F.size("all") <= 1, "scrape_depth_low")))
    return sites.select(
        "site",
        home("id").alias("home_id"),
        home("url").alias("home_url"),
        *(home(n).alias(n) for n in ("title", "description", "og_title", "og_description")),
        *(v.alias(k) for k, v in lists.items()),
        F.size("all").alias("n_pages"),
        F.size("kept").alias("n_kept"),
        depth.alias("diagnostics"),
        F.transform("kept", lambda x: F.length(x["visible_text"])).alias("text_chars"),
    )
