"""Checks of inputs, declarations and page marks as column expressions: true where a value may pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import charsets, policy, text, urls

# Marks of pages that ask to log in or to prove being human, by service.
AUTH_MARKS = {
    "twitter": ("/i/flow/login", "log in to x", "login to twitter", "consent.twitter.com"),
    "xiaohongshu": ("login-container", "passport.xiaohongshu.com", "请登录"),
    "linkedin": ("/checkpoint/", "security verification", "/uas/login", "authwall"),
}
CONSENT_MARKS = ("consent.youtube.com", "ServiceLogin", "captcha", "unusual traffic")

def _has(c: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(c, m))


# -- declarations of responses


def declared_charsets(content_type: Column) -> Column:
    given = F.regexp_extract_all(content_type, F.lit(r"(?i);\s*charset\s*=\s*\"?([^;\"\s]+)"), 1)
    return F.array_distinct(F.transform(given, charsets.canonical))


def content_type_fault(declarations: Column) -> Column:
    """Null where all declarations name one media type and charset; else what is wrong: missing, invalid, charset or conflict."""
    good = lambda d: d.rlike(r"^\s*[A-Za-z0-9!#$&^_.+-]+/[A-Za-z0-9!#$&^_.+*-]+\s*(;\s*[^;]+)*\s*$")
    identity = F.transform(declarations, lambda d: F.struct(policy.media_type(d).alias("m"), declared_charsets(d).alias("c")))
    return (
        F.when(declarations.isNull() | (F.size(declarations) == 0), "missing")
        .when(F.exists(declarations, lambda d: ~good(d)), "invalid")
        .when(F.exists(declarations, lambda d: F.size(declared_charsets(d)) > 1), "charset")
        .when(F.size(F.array_distinct(identity)) > 1, "conflict")
    )


def is_attachment(dispositions: Column) -> Column:
    return F.exists(dispositions, lambda d: F.lower(F.trim(F.split_part(d, F.lit(";"), F.lit(1)))) == "attachment")


def decoded(body: Column, content_type: Column) -> Column:
    """Bytes as text by the declared charset, as `charsets.decoded` has it."""
    return charsets.decoded(body, F.get(declared_charsets(content_type), F.lit(0)))


def is_robots_text(content_type: Column) -> Column:
    return policy.media_type(content_type) == "text/plain"


def gives_links(status: Column, content_type: Column) -> Column:
    """Pages whose links are followed, and that may be rendered: successful and HTML."""
    return status.between(200, 299) & policy.is_html(content_type)


def is_html_page(status: Column, content_type: Column, size: Column, most: int = 2 * 1024 * 1024) -> Column:
    return gives_links(status, content_type) & (size <= most)


# -- addresses and hosts


def resolved_hosts(answers: DataFrame) -> DataFrame:
    """``host, allowed`` of ``host, address, public``: one forbidden answer rejects a host, and so does none."""
    return answers.groupBy("host").agg(F.coalesce(F.bool_and(F.coalesce("public", F.lit(False)) & F.col("address").isNotNull()), F.lit(False)).alias("allowed"))


def domain_suffix(name: Column) -> Column:
    """Lower-cased without leading and trailing dots; null where no label is left or one is not a host's."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"^\.+|\.+$", "")
    return F.when(bare.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*$"), bare)


def suffix_list(names: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(names, domain_suffix), lambda n: n.isNotNull()))


def redirect_allowed(base: Column, target: Column, suffixes: Column | None = None) -> Column:
    """A redirect's target must itself be a url that may be asked for, and stay within a restriction."""
    fine = urls.canonicalize(target).isNotNull() & ~((urls.scheme(base) == "https") & (urls.scheme(target) == "http"))
    if suffixes is None:
        return F.coalesce(fine, F.lit(False))
    host = urls.host(target)
    return F.coalesce(fine & (urls.scheme(target) == "https") & (urls.port(target) == 443) & F.exists(suffixes, lambda s: (host == s) | host.endswith(F.concat(F.lit("."), s))), F.lit(False))


def is_repository_host(url: Column) -> Column:
    host = urls.host(url)
    return (urls.scheme(url) == "https") & ((host == "github.com") | host.endswith(".github.com"))


def owner_and_repository(name: Column) -> Column:
    """``owner, repository`` of a name of just these two; else null."""
    m = r"^([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+)$"
    return F.when(name.rlike(m), F.struct(F.regexp_extract(name, m, 1).alias("owner"), F.regexp_extract(name, m, 2).alias("repository")))


# -- pages that aren't what was asked for


def asks_for_login(service: str, html: Column) -> Column:
    return _has(F.lower(html), AUTH_MARKS[service])


def asks_for_consent(html: Column) -> Column:
    return _has(html, CONSENT_MARKS)


# -- inputs


def search_input(query: Column, n: Column, longest: int = 1024, most: int = 20) -> Column:
    return (F.trim(query) != "") & (F.length(query) <= longest) & n.between(1, most)


def normalized_query(query: Column, longest: int = 2048) -> Column:
    """White space collapsed; null where nothing or too much is left."""
    q = text.clean(query)
    return F.when(F.length(q).between(1, longest), q)


def single_line(value: Column, least: int, most: int) -> Column:
    return F.length(value).between(least, most) & ~value.rlike(r"\p{Cntrl}")


def generated_text(value: Column, chars: int = 100_000, size: int = 256 * 1024) -> Column:
    """Short enough, and without control characters but line feeds and tabs."""
    return (F.length(value) <= chars) & (F.octet_length(value) <= size) & ~value.rlike(r"[\p{Cntrl}&&[^\n\t]]")


def research_url(url: Column) -> Column:
    return urls.is_web(url) & ~urls.has_credentials(url) & ~F.contains(url, F.lit("#"))


# -- forms of text


def search_url(base: str, query: Column, count: Column | None = None) -> Column:
    """The search's address: ``q`` and, where given, ``count``, encoded as forms are."""
    url = F.concat(F.lit(base + "?q="), F.url_encode(query))
    return url if count is None else F.concat(url, F.coalesce(F.concat(F.lit("&count="), count.cast("string")), F.lit("")))


def robots_octets(path: Column) -> Column:
    """Path in the form that rules are compared in: unreserved octets plain, other escapes in upper case, what isn't ASCII escaped."""
    pieces = F.regexp_extract_all(path, F.lit(r"(?s)(%[0-9A-Fa-f]{2}|.)"), 1)

    def octet(p: Column) -> Column:
        code = F.conv(F.substring(p, 2, 2), 16, 10).cast("int")
        plain = code.between(48, 57) | code.between(65, 90) | code.between(97, 122) | code.isin(45, 46, 95, 126)
        escaped = F.when(plain, F.chr(code)).otherwise(F.upper(p))
        wide = F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "%$1")
        return F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), escaped).when(F.octet_length(p) > 1, wide).otherwise(p)

    return F.array_join(F.transform(pieces, octet), "")


def visible(value: Column, form: str = "<U+{}>", least: int = 4) -> Column:
    """Control, direction and invisible characters shown by their number."""
    before, after = form.split("{}")
    pieces = F.regexp_extract_all(value, F.lit(r"(?s)([\p{Cc}\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0000}-\x{E0FFF}]|[^\p{Cc}\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0000}-\x{E0FFF}]+)"), 1)
    odd = r"^[\p{Cc}\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0000}-\x{E0FFF}]$"

    def shown(p: Column) -> Column:
        number = F.regexp_replace(F.hex(F.encode(p, "UTF-32")), "^0+", "")
        return F.when(p.rlike(odd), F.concat(F.lit(before), F.when(F.length(number) < least, F.lpad(number, least, "0")).otherwise(number), F.lit(after))).otherwise(p)

    return F.array_join(F.transform(pieces, shown), "")


def prefixed_lines(value: Column, prefix: str = "| ") -> Column:
    """Every line marked, and what could hide shown, so that remote text can't pass for the tool's own."""
    return F.array_join(F.transform(F.split(value, "\n"), lambda line: F.concat(F.lit(prefix), visible(line, "\\u{{{}}}".replace("{{", "{", 1).replace("}}}", "}}", 1), 1))), "\n")


def runs_text(value: Column) -> Column:
    """The text of a ``{"simpleText"}`` or ``{"runs": [{"text"}]}`` JSON value; null for others."""
    v = F.from_json(value, "simpleText string, runs array<struct<text:string>>")
    return F.coalesce(v["simpleText"], F.when(v["runs"].isNotNull(), F.array_join(F.transform(v["runs"], lambda r: r["text"]), "")))
