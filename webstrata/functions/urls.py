"""URL canonicalisation, storage paths and relative resolution as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track the visitor.
TRACKING_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid",
    "gclid", "ref_src", "_ga", "_gl", "mc_cid", "mc_eid",
]
#: Characters that may not stand in a storage path, and how they are written.
PATH_ESCAPES = {":": "%3A", "*": "%2A", "?": "%3F", '"': "%22", "<": "%3C", ">": "%3E", "|": "%7C", "\\": "%5C"}

_SPACE = r"[ \t\n\x0B\f\r]"
MAX_HOST, MAX_PATH, MAX_QUERY, MAX_PARAMS, MAX_SEGMENTS = 256, 2047, 1024, 64, 128


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after(c: Column, start: Column) -> Column:
    return F.substring(c, start, F.length(c) + 1)


def _atoi(c: Column) -> Column:
    digits = F.regexp_extract(c, rf"^{_SPACE}*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def normalize_query(query: Column) -> Column:
    """Drop tracking parameters, order the rest bytewise, join with `&`."""
    kept = F.filter(F.split(query, "[&;]"), lambda t: (t != "") & ~F.substring_index(t, "=", 1).isin(TRACKING_KEYS))
    return F.array_join(F.array_sort(F.slice(kept, 1, MAX_PARAMS)), "&")


def let(value: Column, use) -> Column:
    """Bind a value once, so that an expression that needs it often stays small."""
    return F.transform(F.array(value), use)[0]


def parse_url(raw: Column) -> Column:
    """Struct (scheme, host, port, path, query, normalized_url); NULL when the text is no URL."""
    return let(F.regexp_replace(raw, f"^{_SPACE}+", ""), _split_scheme)


def _split_scheme(s: Column) -> Column:
    at = F.instr(s, "://")
    scheme = F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.lit("https"))
    rest = F.when(at > 0, _after(s, at + 3)).otherwise(s)
    return let(F.struct(scheme.alias("scheme"), rest.alias("rest"), F.regexp_extract(rest, "^([^/?#]*)", 1).alias("authority")), _split_authority)


def _split_authority(v: Column) -> Column:
    place = F.regexp_replace(v["authority"], "(?s)^.*@", "")
    boxed = F.regexp_extract(place, r"^(\[[^\]]*\])", 1)
    colons = F.length(place) - F.length(F.replace(place, F.lit(":")))
    parts = F.struct(
        _ascii_lower(v["scheme"]).alias("scheme"), _after(v["rest"], F.length(v["authority"]) + 1).alias("tail"),
        place.alias("place"), boxed.alias("boxed"), colons.alias("colons"), F.startswith(place, F.lit("[")).alias("bracketed"),
    )
    return F.when(v["scheme"].rlike(r"^[A-Za-z0-9+.\-]{1,15}\z"), let(parts, _split_rest))


def _split_rest(v: Column) -> Column:
    bracketed, place, boxed = v["bracketed"], v["place"], v["boxed"]
    after_box = _after(place, F.length(boxed) + 1)
    host = (
        F.when(bracketed, boxed)
        .when(v["colons"] > 1, F.concat(F.lit("["), place, F.lit("]")))
        .otherwise(F.substring_index(place, ":", 1))
    )
    port = (
        F.when(bracketed & F.startswith(after_box, F.lit(":")), _atoi(_after(after_box, F.lit(2))))
        .when(~bracketed & (v["colons"] == 1), _atoi(F.substring_index(place, ":", -1)))
        .otherwise(F.when(v["scheme"] == "http", 80).otherwise(443))
    )
    # What follows a bracketed host up to the first of / ? # counts as path.
    junk = F.when(bracketed, F.regexp_replace(after_box, "^:[0-9]*", "")).otherwise(F.lit(""))
    path = F.substring(F.concat(junk, F.regexp_extract(v["tail"], "^([^?#]*)", 1)), 1, MAX_PATH)
    query_raw = F.regexp_extract(v["tail"], r"^[^?#]*\?([^#]*)", 1)
    query = F.when((query_raw != "") & (F.octet_length(query_raw) < MAX_QUERY), normalize_query(query_raw)).otherwise(F.lit(""))
    ok = F.when(bracketed, (boxed != "") & (F.octet_length(boxed) < MAX_HOST)).otherwise(
        (place != "") & (F.octet_length(place) < F.when(v["colons"] > 1, MAX_HOST - 2).otherwise(MAX_HOST))
    )
    parts = F.struct(
        v["scheme"].alias("scheme"), _ascii_lower(host).alias("host"), port.cast("int").alias("port"), path.alias("path"), query.alias("query")
    )
    return F.when(ok, let(parts, _assemble))


def _assemble(v: Column) -> Column:
    usual = ((v["scheme"] == "http") & (v["port"] == 80)) | ((v["scheme"] == "https") & (v["port"] == 443))
    path = F.when(v["path"] == "", "/").otherwise(v["path"])
    normalized = F.concat(
        v["scheme"], F.lit("://"), v["host"], F.when(usual, "").otherwise(F.concat(F.lit(":"), v["port"].cast("string"))),
        path, F.when(v["query"] == "", "").otherwise(F.concat(F.lit("?"), v["query"])),
    )
    return F.struct(
        v["scheme"].alias("scheme"), v["host"].alias("host"), v["port"].alias("port"), path.alias("path"),
        v["query"].alias("query"), normalized.alias("normalized_url"),
    )


def escape_segment(c: Column) -> Column:
    for char, code in PATH_ESCAPES.items():
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def storage_dir(host: Column, path: Column, query: Column) -> Column:
    """The capture's directory: archive/<host>/<path>[/q_<query>]."""
    p = escape_segment(F.regexp_replace(path, "^/+", ""))
    p = F.regexp_replace(F.regexp_replace(p, r"(\.html|\.htm)\z", ""), r"/+\z", "")
    p = let(p, lambda x: F.when(x == "", "index").otherwise(x))
    q = F.translate(escape_segment(query), "&=", "_-")
    return F.concat(
        F.lit("archive/"), escape_segment(host), F.lit("/"), p, F.when(query == "", "").otherwise(F.concat(F.lit("/q_"), q))
    )


def storage_paths(parsed: Column) -> Column:
    """Struct of the directory and the three files of a parsed URL."""
    d = storage_dir(parsed["host"], parsed["path"], parsed["query"])
    return F.when(
        parsed.isNotNull(),
        F.struct(
            d.alias("sharded_dir"), F.concat(d, F.lit("/index.md")).alias("md_path"),
            F.concat(d, F.lit("/index.html.gz")).alias("gz_path"), F.concat(d, F.lit("/metadata.json")).alias("json_path"),
        ),
    )


def remove_dot_segments(path: Column) -> Column:
    """Drop empty and `.` segments, let `..` take its parent, never above the root."""
    return let(F.filter(F.split(path, "/"), lambda x: (x != "") & (x != ".")), _fold_segments)


def _fold_segments(segments: Column) -> Column:
    push = lambda acc, x: F.when(
        x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    ).when(F.size(acc) < MAX_SEGMENTS, F.concat(acc, F.array(x))).otherwise(acc)
    folded = F.aggregate(segments, F.array().cast("array<string>"), push)
    plain = F.slice(segments, 1, MAX_SEGMENTS)
    return F.concat(F.lit("/"), F.array_join(F.when(F.array_contains(segments, ".."), folded).otherwise(plain), "/"))


def resolve_url(base: Column, rel: Column) -> Column:
    """A link's target seen from the parsed URL `base` (as parse_url makes it)."""
    return let(F.regexp_replace(rel, f"^{_SPACE}+", ""), lambda r: _resolve(base, r))


def _resolve(base: Column, r: Column) -> Column:
    site = F.concat(base["scheme"], F.lit("://"), base["host"])
    folder = F.regexp_extract(base["path"], "^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    full = F.when(F.startswith(r, F.lit("/")), r).otherwise(F.concat(folder, r))
    return (
        F.when(F.startswith(r, F.lit("http://")) | F.startswith(r, F.lit("https://")), r)
        .when(F.startswith(r, F.lit("//")), F.concat(F.lit("https:"), r))
        .otherwise(F.concat(site, remove_dot_segments(full)))
    )


def asset_basename(url: Column) -> Column:
    """File name of an asset: after the last `/`, before `?`, byte for byte of [A-Za-z0-9._-]."""
    name = F.substring_index(F.substring_index(url, "/", -1), "?", 1)
    by_byte = F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")
    clean = F.regexp_replace(by_byte, "[^A-Za-z0-9._-]", "_")
    return F.when(clean == "", "asset.bin").otherwise(clean)
