"""SQL twins: the same rules written out for DuckDB, apart from the Spark expressions; only key lists and the threshold are shared."""

from __future__ import annotations

from webstrata.functions.fuzzy import SEARCH_THRESHOLD
from webstrata.functions.urls import PATH_ESCAPES, TRACKING_KEYS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def escaped(c: str) -> str:
    for char, code in PATH_ESCAPES.items():
        c = f"replace({c}, {lit(char)}, {lit(code)})"
    return c


def parsed_ctes(source: str, columns: str, raw: str = "url") -> str:
    """CTEs ending in `parsed`: scheme, host, port, path, query, normalized_url beside the given columns."""
    keys = ", ".join(map(lit, TRACKING_KEYS))
    return f"""
a0 AS (SELECT {columns}, regexp_replace({raw}, '^[ \\t\\n\\f\\r]+', '') AS s FROM {source}),
a1 AS (SELECT *, CASE WHEN contains(s, '://') THEN lower(split_part(s, '://', 1)) ELSE 'https' END AS scheme,
  CASE WHEN contains(s, '://') THEN substr(s, strpos(s, '://') + 3) ELSE s END AS rest FROM a0),
a2 AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS authority FROM a1),
a3 AS (SELECT *, substr(rest, length(authority) + 1) AS tail, lower(regexp_replace(authority, '^.*@', '')) AS place FROM a2),
a4 AS (SELECT *, length(place) - length(replace(place, ':', '')) AS colons, regexp_extract(tail, '^([^?#]*)', 1) AS p0,
  regexp_extract(tail, '^[^?#]*\\?([^#]*)', 1) AS q0 FROM a3),
a5 AS (SELECT *, CASE WHEN colons > 1 THEN '[' || place || ']' ELSE split_part(place, ':', 1) END AS host,
  CASE WHEN colons = 1 THEN coalesce(try_cast(regexp_extract(place, ':([0-9]*)', 1) AS INTEGER), 0)
       WHEN scheme = 'http' THEN 80 ELSE 443 END AS port,
  CASE WHEN p0 = '' THEN '/' ELSE p0 END AS path,
  array_to_string(list_sort(list_filter(regexp_split_to_array(q0, '[&;]'),
    lambda t: t <> '' AND split_part(t, '=', 1) NOT IN ({keys}))), '&') AS query FROM a4),
parsed AS (SELECT *, scheme || '://' || host ||
  CASE WHEN (scheme = 'http' AND port = 80) OR (scheme = 'https' AND port = 443) THEN '' ELSE ':' || port END ||
  path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS normalized_url
  FROM a5 WHERE place <> '' AND regexp_matches(scheme, '^[a-z0-9+.-]+$'))"""


def directory() -> str:
    path = escaped("regexp_replace(path, '^/+', '')")
    path = f"regexp_replace(regexp_replace({path}, '(\\.html|\\.htm)$', ''), '/+$', '')"
    query = f"replace(replace({escaped('query')}, '&', '_'), '=', '-')"
    return (
        f"'archive/' || {escaped('host')} || '/' || CASE WHEN {path} = '' THEN 'index' ELSE {path} END || "
        f"CASE WHEN query = '' THEN '' ELSE '/q_' || {query} END"
    )


def sanitized(html: str = "html") -> str:
    """Noise in rounds, one a rule: comments, elements with their content, volatile fields, invisible images."""
    rounds = [
        r"<!--[\s\S]*?-->", r"<(?:script|style|noscript|svg|iframe|canvas)(?:[\s/][^>]*)?>[\s\S]*?</(?:script|style|noscript|svg|iframe|canvas)[^>]*>",
        r"<input[^>]*(?:csrf|_token|nonce|__viewstate|__eventvalidation|session_id|crumb|ad-container|cookie-banner|optanon-alert-box|consent-banner)[^>]*>",
        r"<img[^>]*(?:(?:width|height)=(?:\"[01]\"|'[01]'|1 )|display: ?none|visibility: ?hidden)[^>]*>",
    ]
    for r in rounds:
        html = f"regexp_replace({html}, {lit('(?i)' + r)}, '', 'g')"
    return html


def entities(text: str) -> str:
    """References to characters one by one, those of the ampersand last."""
    named = {
        "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&mdash;": "—", "&ndash;": "–",
        "&hellip;": "…", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”", "&euro;": "€", "&bull;": "•", "&trade;": "™", "&deg;": "°",
        "&#39;": "'", "&#x27;": "'", "&#x2F;": "/", "&#34;": '"', "&#160;": "\u00a0", "&amp;": "&",
    }
    for name, char in named.items():
        text = f"replace({text}, {lit(name)}, {lit(char)})"
    return text


def markdown(html: str) -> str:
    """Markdown of documents with headings, blocks, flat lists, links and marks, by replacing patterns.

    Control characters stand for: 1 a blank line where the line isn't fresh, 2 a new line there, 3 a line end, 4 a blank that stays."""
    for pattern, text in [
        (r"[\s]+", " "), *((rf"(?i)<h{n}(?: [^>]*)?>", "\1" + "#" * n + "\4") for n in range(1, 7)), (r"(?i)</h[1-6]>", "\3\3"),
        (r"(?i)<(?:p|div|section|article)(?: [^>]*)?>", "\1"), (r"(?i)</(?:p|div|section|article)>", "\3\3"), (r"(?i)</?br ?/?>", "\3"), (r"(?i)</?hr ?/?>", "\3\3---\3\3"),
        (r"(?i)</?(?:b|strong)>", "**"), (r"(?i)</?(?:i|em)>", "*"), (r"(?i)<ul(?: [^>]*)?>", "\2"), (r"(?i)<li(?: [^>]*)?>", "\2-\4"), (r"(?i)</(?:ul|li)>", "\3"),
        (r'(?i)<a [^>]*href="([^"]+)"[^>]*>((?:[^<]|<span[^>]*>|</span>)*)</a>', r"[\2](\1)"), (r"<[^>]*>", ""), (r"&nbsp;", "\4"), (r" +", " "), ("(^|[\1-\4]) +", r"\1"),
        ("(^|\3)[\1\2]+", r"\1"), ("\1[\1\2]*", "\3\3"), ("\2[\1\2]*", "\3"), ("\3", "\n"), ("\4", " "),
    ]:
        html = f"regexp_replace({html}, {lit(pattern)}, {lit(text)}, 'g')"
    return entities(html)


def path_of(rel: str) -> str:
    return f"'/' || array_to_string(list_filter(string_split({rel}, '/'), lambda x: x <> '' AND x <> '.' AND x <> '..'), '/')"


def links_ctes(columns: str = "page_id, url, html") -> str:
    """CTEs ending in `links`: src, host, pos (first place of the target in the page), dst; for links without `..`."""
    return f"""{parsed_ctes('pages', columns)},
l0 AS (SELECT page_id, normalized_url AS src, scheme, host, path,
  regexp_extract_all({sanitized()}, '(?i)<a\\s([^>]*)>', 1) AS tags FROM parsed),
l1 AS (SELECT *, unnest(tags) AS tag, generate_subscripts(tags, 1) AS k FROM l0),
l2 AS (SELECT *, coalesce(nullif(regexp_extract(tag, '(?i)href=\\s*"([^"]*)', 1), ''),
  regexp_extract(tag, '(?i)href=\\s*([^\\s>"]+)', 1)) AS v FROM l1),
l3 AS (SELECT *, CASE WHEN regexp_matches(v, '^https?://') THEN v WHEN v LIKE '//%' THEN 'https:' || v
  WHEN v LIKE '/%' THEN scheme || '://' || host || {path_of('v')}
  ELSE scheme || '://' || host || {path_of("regexp_extract(path, '^(.*/)', 1) || v")} END AS dst
  FROM l2 WHERE v <> '' AND NOT regexp_matches(v, '^(#|javascript:|mailto:)')),
l4 AS (SELECT page_id, src, host, dst, min(k) AS k FROM l3 GROUP BY ALL),
links AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS pos FROM l4)"""


def best_distance(pattern: str, text: str, measure: str) -> str:
    """Least distance of the pattern to any substring: longer ones than twice the pattern can't win."""
    m = len(pattern)
    return (
        f"least({m}, (SELECT min({measure}({lit(pattern)}, substr({text}, i, n))) FROM range(1, length({text}) + 1) AS a(i), "
        f"range(1, {2 * m + 1}) AS b(n)))"
    )


def fuzzy_scores(pattern: str, source: str, text: str, measure: str = "damerau_levenshtein") -> str:
    m = len(pattern)
    return (
        f"SELECT *, CASE WHEN d >= {m} THEN 0.0 ELSE 1 - d / {m}::DOUBLE END AS score FROM "
        f"(SELECT *, {best_distance(pattern, f'lower({text})', measure)} AS d FROM {source})"
    )


THRESHOLD = SEARCH_THRESHOLD
