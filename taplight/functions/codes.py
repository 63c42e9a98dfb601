"""Code tables of the telemetry formats."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Integer codes and names of the telemetry formats.
CONN_STATES = {1: "S1", 2: "S2", 3: "S3", 4: "SF", 5: "REJ", 6: "RSTO", 7: "RSTOS0", 8: "RSTR", 9: "RSTRH", 10: "SH", 11: "SHR", 12: "OTH"}
TLS_VERSIONS = {1: "TLSv10", 2: "TLSv11", 3: "TLSv12", 4: "TLSv13", 5: "SSLv3"}
HTTP_METHODS = {1: "GET", 2: "POST", 3: "HEAD", 4: "PUT", 5: "DELETE", 6: "OPTIONS", 7: "CONNECT", 8: "TRACE", 9: "PATCH"}
INCOMPLETE_STATES = ("S0", "REJ", "RSTOS0", "RSTRH", "SH", "SHR")
COMPLETE_STATES = ("S1", "S2", "S3", "SF", "RSTO", "RSTR")
QTYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 35: "NAPTR", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 50: "NSEC3", 52: "TLSA", 65: "HTTPS", 99: "SPF", 251: "IXFR", 252: "AXFR", 255: "ANY"}
RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED", 6: "YXDOMAIN", 7: "YXRRSET", 8: "NXRRSET", 9: "NOTAUTH", 10: "NOTZONE"}
PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp", 58: "ipv6-icmp", 132: "sctp"}
TCP_FLAGS = ((1, "FIN"), (2, "SYN"), (4, "RST"), (8, "PSH"), (16, "ACK"), (32, "URG"), (64, "ECE"), (128, "CWR"))
SEVERITIES = ("low", "medium", "high", "critical")
SEVERITY_FROM = {"critical": 0.90, "high": 0.75, "medium": 0.60}
OBSOLETE_TLS = ("SSLv3", "TLSv10", "TLSv11")
UNSET_CELLS = ("", "-", "(empty)")


def lookup(codes: dict, column: Column) -> Column:
    """The code's name; null where there is none."""
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in codes.items())), column)


def code_of(codes: dict[int, str], name: Column) -> Column:
    """The code of a name, 0 where there is none."""
    return F.coalesce(F.element_at(F.create_map(*chain.from_iterable((F.lit(v), F.lit(k)) for k, v in codes.items())), name), F.lit(0))


def classified(state: Column) -> Column:
    """Whether a connection state tells if the exchange was completed; midstream, unknown and missing ones don't."""
    return F.coalesce(state.isin(*COMPLETE_STATES, *INCOMPLETE_STATES), F.lit(False))


def severity(score: Column) -> Column:
    """The band of a score that is already rounded."""
    out = F.when(score >= SEVERITY_FROM["critical"], "critical").when(score >= SEVERITY_FROM["high"], "high").when(score >= SEVERITY_FROM["medium"], "medium")
    return out.otherwise("low")


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), name).cast("int") - 1


def normal_score(score: Column) -> Column:
    """Clamped to [0, 1], six decimals."""
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6)


def tcp_flags(mask: Column) -> Column:
    """Names of the set bits, the lowest first."""
    return F.filter(F.array(*(F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in TCP_FLAGS)), lambda x: x.isNotNull())


def name_of_code(cell: Column, codes: dict[int, str]) -> Column:
    """A cell cleaned of unset markers; a known number becomes its name, an unknown one stays, names are upper-cased."""
    value = F.when(~F.trim(cell).isin(*UNSET_CELLS), F.trim(cell))
    return F.when(value.rlike("^[0-9]+$"), F.coalesce(lookup(codes, value.cast("int")), value)).otherwise(F.upper(value))
