"""DuckDB expressions for the URL functions, each from expressions of its arguments."""

from __future__ import annotations

PARTS = r"^(?i:(https?))://([^/?#:@\s]+)(:\d+)?([^?#]*)(\?[^#]*)?(#.*)?$"
TRACKING = "('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid')"


def part(x: str, k: int) -> str:
    return f"regexp_extract({x}, '{PARTS}', {k})"


def stripped(x: str) -> str:
    return rf"""regexp_replace(regexp_replace(trim({x}), '[.,;:!?)\]"'']+$', ''), '^[(\["'']+', '')"""


def with_scheme(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^(?i)https?://') THEN {x} WHEN NOT contains({x}, ' ') AND contains({x}, '.') THEN 'https://' || regexp_replace({x}, '^/+', '') END"


def drop_slash(p: str) -> str:
    return f"CASE WHEN length({p}) > 1 THEN regexp_replace({p}, '/+$', '') ELSE {p} END"


def canonical(x: str) -> str:
    return rf"regexp_replace(lower(trim({x})), '^www\.', '')"


def normalized(table: str, column: str, key: str) -> str:
    """A SELECT of (key, u): the normalised form of a column of a table."""
    return f"""
    SELECT {key}, CASE WHEN ok THEN lower(scheme) || '://' || lower(host) || CASE WHEN path = '/' AND query = '' THEN '' ELSE path END || query END AS u FROM (
      SELECT {key}, ok, scheme, host, CASE WHEN path0 IN ('', '/') THEN '/' ELSE path0 END AS path,
        CASE WHEN len(pairs) = 0 THEN '' ELSE '?' || array_to_string([s.k || '=' || s.v for s in list_sort(pairs)], '&') END AS query
      FROM (
        SELECT {key}, regexp_matches(href, '{PARTS}') AS ok, {part("href", 1)} AS scheme, {part("href", 2)} AS host, {drop_slash(part("href", 4))} AS path0,
          [{{'k': regexp_extract(p, '^([^=]*)', 1), 'v': regexp_extract(p, '^[^=]*=(.*)$', 1)}} for p in string_split(regexp_replace({part("href", 5)}, '^[?]', ''), '&')
            if p <> '' AND regexp_extract(p, '^([^=]*)', 1) NOT IN {TRACKING}] AS pairs
        FROM (
          SELECT {key}, CASE WHEN raw = '' OR contains(raw, '@') OR regexp_matches(raw, '^(?i)(javascript|data|vbscript|file|mailto):') THEN NULL ELSE {with_scheme("raw")} END AS href
          FROM (SELECT {key}, {stripped(column)} AS raw FROM {table})
        )
      )
    )"""


def host_of(x: str) -> str:
    t = f"trim({x})"
    href = f"(CASE WHEN regexp_matches({t}, '^(?i)https?://') THEN {t} ELSE 'https://' || {t} END)"
    rough = rf"regexp_extract(regexp_replace({t}, '^(?i)www\.', ''), '^([^/]*)', 1)"
    return f"(CASE WHEN regexp_matches({href}, '{PARTS}') THEN lower({part(href, 2)}) ELSE {rough} END)"


def domain_key(canon: str, dom: str, norm: str, raw: str) -> str:
    pick = f"coalesce(nullif(trim({canon}), ''), nullif(trim({dom}), ''), nullif({host_of(norm)}, ''), nullif({host_of(raw)}, ''))"
    return canonical(pick)


def site_key(canon: str, dom: str, norm: str, raw: str) -> str:
    url = f"coalesce(nullif(trim({norm}), ''), nullif(trim({raw}), ''))"
    href = f"(CASE WHEN regexp_matches({url}, '^(?i)https?://') THEN {url} ELSE 'https://' || {url} END)"
    site = f"coalesce(nullif({canonical(part(href, 2))}, ''), {domain_key(canon, dom, norm, raw)})"
    path = f"({drop_slash(part(href, 4))})"
    return f"""CASE WHEN {url} IS NULL OR NOT regexp_matches({href}, '{PARTS}') THEN 'site:' || {domain_key(canon, dom, norm, raw)}
      WHEN {path} IN ('', '/') THEN 'site:' || {site} ELSE 'path:' || {site} || {path} || {part(href, 5)} END"""


def segments(href: str) -> str:
    return f"len([s for s in string_split({part(href, 4)}, '/') if s <> ''])"


def path_type(x: str) -> str:
    href = f"({with_scheme(f'trim({x})')})"
    plain = f"{part(href, 5)} IN ('', '?')"
    return f"""CASE WHEN {href} IS NULL OR NOT regexp_matches({href}, '{PARTS}') THEN 'deep' WHEN {segments(href)} = 0 AND {plain} THEN 'root'
      WHEN {segments(href)} = 1 AND {plain} THEN 'shallow' ELSE 'deep' END"""


def priority(x: str) -> str:
    href = f"({with_scheme(f'trim({x})')})"
    path = f"(CASE WHEN {part(href, 4)} = '' THEN '/' ELSE {part(href, 4)} END)"
    return f"""CAST(CASE {path_type(x)} WHEN 'root' THEN 0 WHEN 'shallow' THEN 1000 ELSE 2000 END + 100 * {segments(href)} + length({path})
      + CASE WHEN {part(href, 5)} IN ('', '?') THEN 0 ELSE 500 END AS BIGINT)"""


def let(value: str, name: str, use: str) -> str:
    """use, in which name stands for value."""
    return f"list_transform([{value}], lambda {name}: {use})[1]"


def encoded(x: str, also: str) -> str:
    """x with blanks, non-ASCII characters and those of also as %XX."""
    odd = r"[^!-~]|[" + also.replace("'", "''") + "]"
    return f"CASE WHEN regexp_matches({x}, '{odd}') THEN array_to_string(list_transform(string_split({x}, ''), lambda ch: CASE WHEN regexp_matches(ch, '{odd}') THEN CASE WHEN ch = '~' THEN ch ELSE replace(url_encode(ch), '+', '%20') END ELSE ch END), '') ELSE {x} END"


def no_dots(path: str) -> str:
    """A path that begins with a slash without . and .. segments; the steps are folded over a list of those kept."""
    step = "s[1]"
    end = "CASE WHEN s[2] = 'last' THEN [''] ELSE [] END"
    fold = f"""CASE WHEN regexp_full_match({step}, '([.]|%2[eE]){{2}}') THEN a[1:greatest(0, len(a) - 1)] || {end} WHEN regexp_full_match({step}, '[.]|%2[eE]') THEN a || {end} ELSE a || [{step}] END"""
    steps = let(f"string_split({path}[2:], '/')", "q", "list_transform(range(1, len(q) + 1), lambda i: [q[i], CASE WHEN i = len(q) THEN 'last' ELSE '' END])")
    return f"'/' || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), {steps}), lambda a, s: {fold}), '/')"


_PARTS = r"(?s)^(?i:(https?)):[/\\]*([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_AUTHORITY = r"^(?:(.*)@)?([^@:]*)(?::([0-9]*))?$"


def _ipv4(h: str) -> str:
    """A host of decimal numbers as four parts; NULL if it is no address."""
    n = "len(ip)"
    number = f"(list_reduce(list_prepend(CAST(0 AS HUGEINT), ip[1:{n} - 1]), lambda a, b: a * 256 + b) * CAST(pow(256, 5 - {n}) AS HUGEINT) + ip[-1])"
    fits = f"{n} <= 4 AND len(list_filter(ip, lambda v: v IS NULL)) = 0 AND len(list_filter(ip[1:{n} - 1], lambda v: v > 255)) = 0 AND ip[-1] < CAST(pow(256, 5 - {n}) AS HUGEINT)"
    shown = let(number, "v", "array_to_string([CAST(v // 16777216 % 256 AS VARCHAR), CAST(v // 65536 % 256 AS VARCHAR), CAST(v // 256 % 256 AS VARCHAR), CAST(v % 256 AS VARCHAR)], '.')")
    parts = f"list_transform(string_split(regexp_replace({h}, '[.]$', ''), '.'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]{{1,10}}') THEN CAST(p AS HUGEINT) END)"
    return let(parts, "ip", f"CASE WHEN {fits} THEN {shown} END")


def href_sql(x: str, safe: bool = False) -> str:
    """An address as the URL standard writes it, or NULL; with safe, https:// goes before what has no scheme."""
    trim = r"regexp_replace({0}, '^[\s\x{{00a0}}\x{{feff}}]+|[\s\x{{00a0}}\x{{feff}}]+$', '', 'g')"
    t = trim.format(x)
    if safe:
        t = let(t, "w", "CASE WHEN w = '' OR regexp_matches(w, '^(?i)(javascript|data|vbscript|file|mailto):') THEN NULL WHEN regexp_matches(w, '^(?i)https?://') THEN w ELSE 'https://' || regexp_replace(w, '^/+', '') END")
    p = lambda k: f"regexp_extract(t, '{_PARTS}', {k})"
    a = lambda k: f"regexp_extract(g.authority, '{_AUTHORITY}', {k})"
    first = f"{{'scheme': lower({p(1)}), 'authority': {p(2)}, 'path': replace({p(3)}, chr(92), '/'), 'query': {p(4)}, 'fragment': {p(5)}}}"
    path = let(encoded("(CASE WHEN g.path = '' THEN '/' ELSE g.path END)", '"<>^`{}'), "pa", f"CASE WHEN regexp_matches(pa, '(^|/)([.]|%2[eE]){{1,2}}(/|$)') THEN {no_dots('pa')} ELSE pa END")
    host = let(f"lower({a(2)})", "h", rf"CASE WHEN h = '' OR regexp_matches(h, '[\x00-\x20#/<>?@\[\\\]^|%\x7f]') THEN NULL WHEN regexp_matches(h, '(^|[.])([0-9]+|0x[0-9a-f]*)[.]?$') THEN {_ipv4('h')} ELSE h END")
    port = let(f"regexp_replace({a(3)}, '^0+(.)', '\\1')", "po", "CASE WHEN po = '' OR po = CASE g.scheme WHEN 'http' THEN '80' ELSE '443' END THEN '' WHEN length(po) < 6 AND CAST(po AS INT) < 65536 THEN ':' || po END")
    whole = f"""g.scheme || '://' || CASE WHEN {a(1)} <> '' THEN {a(1)} || '@' ELSE '' END || {host} || {port} || {path} || {encoded("g.query", "\"<>'")} || {encoded("g.fragment", '"<>`')}"""
    made = let(first, "g", f"CASE WHEN regexp_matches(g.authority, '{_AUTHORITY}') THEN {whole} END")
    return let(t, "t", f"CASE WHEN regexp_matches(t, '{_PARTS}') THEN {made} END")


def resolve_sql(link: str, base: str) -> str:
    """The address that a link on a page leads to; NULL for other schemes."""
    site, folder = r"regexp_extract(ba, '^(https?://[^/?#]*)', 1)", r"regexp_replace(regexp_replace(ba, '[?#].*$', ''), '[^/]*$', '')"
    plain = r"regexp_replace(ba, '[?#].*$', '')"
    whole = f"""CASE WHEN regexp_matches(li, '^(?i)https?:[/\\\\]') THEN li WHEN regexp_matches(li, '^(?i)[a-z][a-z0-9+.-]*:') THEN NULL WHEN regexp_matches(li, '^[/\\\\][/\\\\]') THEN regexp_extract(ba, '^(https?:)', 1) || li
      WHEN regexp_matches(li, '^[/\\\\]') THEN {site} || li WHEN li = '' OR starts_with(li, '#') THEN regexp_replace(ba, '#.*$', '') || li WHEN starts_with(li, '?') THEN {plain} || li ELSE {folder} || li END"""
    return let(href_sql(base), "ba", let(f"trim({link})", "li", href_sql(whole)))
