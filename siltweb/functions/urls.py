"""URLs as columns: parts, canonical form, origin, resolution, scope and the filter for destructive links.

All are built-in expressions, so they stay inside code generation and can be pushed below joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes with their default ports.
DEFAULT_PORTS = {"http": 80, "https": 443}
# Words that mark a link as one that changes state.
DESTRUCTIVE = ("logout", "signout", "delete", "remove", "destroy", "deactivate", "unsubscribe", "terminate")
DESTRUCTIVE_PAIRS = (("log", "out"), ("sign", "out"))
# Query keys whose value names an action.
ACTION_KEYS = ("action", "act", "do", "cmd", "command", "operation")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it. Keeps nested expressions from growing by multiplication."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def has_credentials(url: Column) -> Column:
    return authority(url).contains("@")


def host(url: Column) -> Column:
    """Lower-cased, without port and trailing dots."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(F.lower(bare), r"\.+$", "")


def port(url: Column) -> Column:
    """The given port, else the scheme's."""
    given = F.regexp_extract(authority(url), ":([0-9]+)$", 1)
    default = F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80)
    return F.when(given != "", given.cast("int")).otherwise(default)


def path(url: Column) -> Column:
    p = _part(url, 3)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    """With its question mark; empty where there is none."""
    return _part(url, 4)


def is_web(url: Column) -> Column:
    return scheme(url).isin(*DEFAULT_PORTS) & (host(url) != "")


def origin(url: Column) -> Column:
    """``scheme://host[:port]``; null where the url isn't one of the web."""
    default = F.when(scheme(url) == "https", 443).otherwise(80)
    tail = F.when(port(url) == default, "").otherwise(F.concat(F.lit(":"), port(url).cast("string")))
    return F.when(is_web(url), F.concat(scheme(url), F.lit("://"), host(url), tail))


def canonicalize(url: Column) -> Column:
    """Lower-cased host without trailing dots, no default port, no fragment; path and query as they are. Null where the scheme isn't http(s), the host is missing, or credentials are given."""
    return let(url, lambda u: F.when(is_web(u) & ~has_credentials(u), F.concat(origin(u), path(u), query(u))))


def robots_url(url: Column) -> Column:
    return F.concat(origin(url), F.lit("/robots.txt"))


def without_dots(url: Column) -> Column:
    """``.`` and ``..`` segments of the path folded, plain or escaped; none goes above the root."""

    def folded(p: Column) -> Column:
        one, two = r"^(\.|%2[eE])$", r"^(\.|%2[eE]){2}$"
        parts = F.split(F.substring(p, 2, 1 << 30), "/")
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.rlike(two), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.rlike(one), acc).otherwise(F.array_append(acc, x)))
        open_end = F.element_at(parts, -1).rlike(r"^(\.|%2[eE]){1,2}$") & (F.size(kept) > 0)
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(open_end, "/").otherwise(""))

    dotted = path(url).rlike(r"/(\.|%2[eE]){1,2}(/|$)")
    return F.when(dotted, F.concat(origin(url), folded(path(url)), query(url))).otherwise(url)


def resolve(base: Column, reference: Column) -> Column:
    """Absolute form of a reference: absolute, scheme-relative, root-relative, query-only, fragment-only or relative to the base's folder, with dot segments folded."""
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    joined = (
        F.when(reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(reference.startswith("//"), F.concat(scheme(base), F.lit(":"), reference))
        .when(reference.startswith("/"), F.concat(origin(base), reference))
        .when(reference.startswith("?"), F.concat(origin(base), path(base), reference))
        .when(reference.startswith("#") | (reference == ""), F.concat(origin(base), path(base), query(base)))
        .otherwise(F.concat(origin(base), folder, reference))
    )
    return let(canonicalize(joined), without_dots)


def same_origin(a: Column, b: Column) -> Column:
    return origin(a) == origin(b)


def within_scope(base: Column, candidate: Column, subdomains: bool) -> Column:
    """Equal scheme and port; equal host, or with ``subdomains`` one below the base's."""
    hosts = host(candidate) == host(base)
    if subdomains:
        hosts = hosts | host(candidate).endswith(F.concat(F.lit("."), host(base)))
    return (scheme(base) == scheme(candidate)) & (port(base) == port(candidate)) & hosts


def decode_once(text: Column) -> Column:
    """Percent-escapes of printable ASCII decoded once; a plus sign stays."""
    pieces = F.split(text, "%")
    head = F.element_at(pieces, 1)

    def piece(p: Column) -> Column:
        code = F.conv(F.substring(p, 1, 2), 16, 10).cast("int")
        good = p.rlike("^[0-9A-Fa-f]{2}") & code.between(32, 126)
        return F.when(good, F.concat(F.chr(code), p.substr(F.lit(3), F.length(p)))).otherwise(F.concat(F.lit("%"), p))

    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), piece)
    return F.concat(head, F.array_join(rest, ""))


def decode_repeatedly(text: Column, passes: int = 4) -> Column:
    """Decoded until nothing changes; null where it still changes after ``passes``."""
    start = F.struct(text.alias("now"), F.lit(None).cast("string").alias("before"))
    last = F.aggregate(F.sequence(F.lit(0), F.lit(passes)), start, lambda acc, _: F.struct(decode_once(acc["now"]).alias("now"), acc["now"].alias("before")))
    return let(last, lambda x: F.when(x["now"] == x["before"], x["now"]))


def _acts(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    single = F.arrays_overlap(words, F.array(*map(F.lit, DESTRUCTIVE)))
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    paired = F.lit(False)
    for a, b in DESTRUCTIVE_PAIRS:
        paired = paired | line.contains(f" {a} {b} ")
    return single | paired


def is_destructive(url: Column) -> Column:
    """A path segment or query key that holds a destructive word, or an action key whose value does. What can't be decoded fully counts as destructive."""
    decoded_path, decoded_query = decode_repeatedly(path(url)), decode_repeatedly(F.substring(query(url), 2, 1 << 30))
    segments = F.exists(F.split(decoded_path, "/"), lambda s: let(s, _acts))
    action = f"^(?i)({'|'.join(ACTION_KEYS)})(\\[[^\\[\\]]*\\])*$"

    def field(f: Column) -> Column:
        key = F.regexp_extract(f, "^([^=]*)", 1)
        value = F.regexp_extract(f, "^[^=]*=(.*)$", 1)
        return _acts(key) | (key.rlike(action) & _acts(value))

    fields = F.exists(F.split(decoded_query, "[&;]"), lambda f: let(f, field))
    return F.coalesce(segments | fields, F.lit(True))
