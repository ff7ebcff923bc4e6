"""Policy predicates: addresses, hosts, media types and status codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# IPv4 networks that aren't public.
DENIED_IPV4 = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 "
    "192.88.99.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
).split()
# Statuses whose Location is followed.
FOLLOWED = (301, 302, 303, 307, 308)


def network_bounds(cidr: str) -> tuple[int, int]:
    base, _, bits = cidr.partition("/")
    number = 0
    for part in base.split("."):
        number = number * 256 + int(part)
    size = 1 << (32 - int(bits))
    return number - number % size, number - number % size + size - 1


def ipv4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.cast("long"))
    fine = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$") & (p.cast("int") <= 255))
    return F.when(fine, number)


def denied_networks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *network_bounds(c)) for c in DENIED_IPV4], "network string, low long, high long")


def with_network(addresses: DataFrame, number: str) -> DataFrame:
    """Each address with the denied network that holds it: a range join, as equality on the first byte, with the fifteen networks broadcast."""
    nets = denied_networks(addresses.sparkSession)
    bytes_ = F.explode(F.sequence(F.shiftright("low", 24), F.shiftright("high", 24))).alias("first_byte")
    nets = F.broadcast(nets.select("network", "low", "high", bytes_))
    inside = (F.shiftright(F.col(number), 24) == F.col("first_byte")) & F.col(number).between(F.col("low"), F.col("high"))
    return addresses.join(nets, inside, "left").drop("low", "high", "first_byte")


def host_allowed(host: Column, suffixes: list[str]) -> Column:
    """The host is one of the suffixes, or a label below one."""
    return F.exists(F.array(*map(F.lit, suffixes)), lambda s: (host == s) | host.endswith(F.concat(F.lit("."), s)))


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def is_supported_media(content_type: Column) -> Column:
    return media_type(content_type).rlike(r"^(text/[^/;]+|application/(json|xml)|application/[^/;]+\+(json|xml))$")


def is_html(content_type: Column) -> Column:
    return media_type(content_type).isin("text/html", "application/xhtml+xml")


def charset(content_type: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*\"?([^;\"\s]+)", 1)), F.lit(""))


def status_error(status: Column) -> Column:
    """Null for success, else the error's code."""
    return F.when(status.between(200, 299), None).when(status == 429, "rate_limited").when(status.isin(*FOLLOWED), "redirect").otherwise("http_status")


def agree(values: Column) -> Column:
    """The one value that all declarations share; null where they conflict."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.element_at(values, 1))
