"""Scalar measures of names, and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from taplight.functions import codes, ids, text
from taplight.plans.catalog import query
from taplight.sources import views
from taplight.sources.views import DNS_SQL, FLOWS_SQL

_H = f"d AS ({DNS_SQL}), h AS (SELECT DISTINCT query AS name FROM d WHERE query <> '')"
_ENTROPY = "coalesce((SELECT -sum(c / length({0}) * log2(c / length({0}))) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split({0}, '')) AS ch) t1 WHERE ch <> '' GROUP BY ch) t2), 0)"


def _names(spark, sf_dir):
    return views.dns(spark, sf_dir).select(F.col("query").alias("name")).where("name <> ''").distinct()


@query("entropy", f"SELECT item_id, round({_ENTROPY.format('text')}, 6) AS entropy FROM benchmark")
def entropy(spark, sf_dir):
    return views.read(spark, sf_dir, "benchmark").select("item_id", F.round(text.entropy(F.col("text")), 6).alias("entropy"))


@query(
    "subdomain_entropy",
    f"""WITH {_H}, s AS (SELECT name, CASE WHEN len(string_split(name, '.')) > 2 THEN array_to_string(string_split(name, '.')[1:len(string_split(name, '.')) - 2], '.') ELSE '' END AS sub FROM h)
    SELECT name, len(string_split(name, '.'))::INT AS labels, round({_ENTROPY.format('sub')}, 6) AS entropy FROM s""",
)
def subdomain_entropy(spark, sf_dir):
    n = F.col("name")
    return _names(spark, sf_dir).select("name", text.label_count(n).alias("labels"), F.round(text.subdomain_entropy(n), 6).alias("entropy"))


@query(
    "domain_features",
    f"""WITH {_H}, p AS (SELECT name, string_split(name, '.') AS parts FROM h), b AS (SELECT name, parts, CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) - 1], '') ELSE name END AS body, CASE WHEN len(parts) > 1 THEN parts[len(parts)] ELSE '' END AS tld FROM p),
    c AS (SELECT *, length(body) AS n, length(regexp_replace(body, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(body, '[^a-z]', '', 'g')) AS alphas, length(regexp_replace(body, '[^aeiou]', '', 'g')) AS vowels, length(regexp_replace(body, '[^-]', '', 'g')) AS hyphens, len(list_distinct(string_split(body, ''))) AS uniq FROM b)
    SELECT name, length(name)::INT AS length, n::INT AS body_length, length(tld)::INT AS tld_length, len(parts)::INT AS label_count, list_max(list_transform(parts, lambda x: length(x)))::INT AS max_label_length, round(list_sum(list_transform(parts, lambda x: length(x))) / len(parts), 6)::DOUBLE AS mean_label_length,
    digits::INT AS digit_count, round(digits / n, 6) AS digit_ratio, round(alphas / n, 6) AS alpha_ratio, round(vowels / n, 6) AS vowel_ratio, round((alphas - vowels) / n, 6) AS consonant_ratio, hyphens::INT AS hyphen_count, round(hyphens / n, 6) AS hyphen_ratio, uniq::INT AS unique_char_count, round(uniq / n, 6) AS unique_char_ratio, round({_ENTROPY.format('body')}, 6) AS entropy,
    coalesce(list_max(list_transform(regexp_extract_all(body, '[0-9]+'), lambda x: length(x))), 0)::INT AS longest_digit_run, coalesce(list_max(list_transform(regexp_extract_all(body, '[a-z]+'), lambda x: length(x))), 0)::INT AS longest_alpha_run, coalesce(list_max(list_transform(regexp_extract_all(body, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0)::INT AS longest_consonant_run FROM c""",
)
def domain_features(spark, sf_dir):
    from pyspark.sql.types import DoubleType

    measured = _names(spark, sf_dir).select("name", *(c.alias(n) for n, c in text.lexical_features(F.col("name")).items()))
    return measured.select(*(F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in measured.schema))


@query(
    "label_check",
    """WITH w AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN ' ' || upper(url) || '. ' WHEN 1 THEN 'a..b' WHEN 2 THEN 'Www.Example.COM..' WHEN 3 THEN '' WHEN 4 THEN 'a' || chr(8195) || 'b.c' ELSE chr(9) || 'Name.com' || chr(10) || chr(160) END AS raw FROM pages), n AS (SELECT page_id, regexp_replace(lower(trim(raw, ' ' || chr(9) || chr(10) || chr(160))), '\\.+$', '') AS d FROM w)
    SELECT page_id, CASE WHEN d <> '' AND NOT regexp_matches(d, '[\\s/]') AND NOT contains(d, chr(8195)) AND NOT contains(d, '..') AND NOT starts_with(d, '.') THEN d END AS domain FROM n""",
)
def label_check(spark, sf_dir):
    raw = F.expr("CASE page_id % 6 WHEN 0 THEN concat(' ', upper(url), '. ') WHEN 1 THEN 'a..b' WHEN 2 THEN 'Www.Example.COM..' WHEN 3 THEN '' WHEN 4 THEN 'a\u2003b.c' ELSE '\tName.com\n\u00a0' END")
    return views.read(spark, sf_dir, "pages").select("page_id", text.normal_domain(raw).alias("domain"))


@query(
    "tcp_flags",
    f"""WITH f AS ({FLOWS_SQL}), b AS (SELECT flow_id, (k * 7) % 256 AS m FROM f)
    SELECT flow_id, concat_ws(',', CASE WHEN m & 1 <> 0 THEN 'FIN' END, CASE WHEN m & 2 <> 0 THEN 'SYN' END, CASE WHEN m & 4 <> 0 THEN 'RST' END, CASE WHEN m & 8 <> 0 THEN 'PSH' END, CASE WHEN m & 16 <> 0 THEN 'ACK' END, CASE WHEN m & 32 <> 0 THEN 'URG' END, CASE WHEN m & 64 <> 0 THEN 'ECE' END, CASE WHEN m & 128 <> 0 THEN 'CWR' END) AS flags FROM b""",
)
def tcp_flags(spark, sf_dir):
    mask = ((F.col("k") * 7) % 256).cast("int")
    return views.flows(spark, sf_dir).select("flow_id", F.array_join(codes.tcp_flags(mask), ",").alias("flags"))


@query(
    "code_names",
    f"""WITH f AS ({FLOWS_SQL}), r AS (SELECT flow_id, k, CASE k % 5 WHEN 2 THEN '-' WHEN 3 THEN 'aaaa' ELSE cast(k % 260 AS VARCHAR) END AS raw FROM f)
    SELECT flow_id, CASE raw WHEN '-' THEN NULL WHEN '1' THEN 'A' WHEN '2' THEN 'NS' WHEN '5' THEN 'CNAME' WHEN '6' THEN 'SOA' WHEN '12' THEN 'PTR' WHEN '15' THEN 'MX' WHEN '16' THEN 'TXT' WHEN '28' THEN 'AAAA' WHEN '33' THEN 'SRV' WHEN '35' THEN 'NAPTR' WHEN '43' THEN 'DS' WHEN '46' THEN 'RRSIG' WHEN '47' THEN 'NSEC' WHEN '48' THEN 'DNSKEY' WHEN '50' THEN 'NSEC3' WHEN '52' THEN 'TLSA' WHEN '65' THEN 'HTTPS' WHEN '99' THEN 'SPF' WHEN '251' THEN 'IXFR' WHEN '252' THEN 'AXFR' WHEN '255' THEN 'ANY' ELSE upper(raw) END AS qtype,
    CASE k % 13 WHEN 0 THEN 'NOERROR' WHEN 1 THEN 'FORMERR' WHEN 2 THEN 'SERVFAIL' WHEN 3 THEN 'NXDOMAIN' WHEN 4 THEN 'NOTIMP' WHEN 5 THEN 'REFUSED' WHEN 6 THEN 'YXDOMAIN' WHEN 7 THEN 'YXRRSET' WHEN 8 THEN 'NXRRSET' WHEN 9 THEN 'NOTAUTH' WHEN 10 THEN 'NOTZONE' ELSE cast(k % 13 AS VARCHAR) END AS rcode FROM r""",
)
def code_names(spark, sf_dir):
    raw = F.expr("CASE k % 5 WHEN 2 THEN '-' WHEN 3 THEN 'aaaa' ELSE cast(k % 260 AS STRING) END")
    return views.flows(spark, sf_dir).select("flow_id", codes.name_of_code(raw, codes.QTYPES).alias("qtype"), codes.name_of_code((F.col("k") % 13).cast("string"), codes.RCODES).alias("rcode"))


@query(
    "record_ids",
    f"""WITH f AS ({FLOWS_SQL}), s AS (SELECT flow_id, sha1(unhex('{ids.NAMESPACE.hex}') || encode(concat(length(src), ':', src, length(dst), ':', dst, length(cast(port AS VARCHAR)), ':', port))) AS h FROM f)
    SELECT flow_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END, substr(h, 18, 3), '-', substr(h, 21, 12)) AS record_id FROM s""",
)
def record_ids(spark, sf_dir):
    return views.flows(spark, sf_dir).select("flow_id", ids.record_id(ids.NAMESPACE, "src", "dst", F.col("port").cast("string")).alias("record_id"))


@query("domain_model")
def domain_model(spark, sf_dir):
    """Host names told from strings derived from the pages' addresses by a forest over lexical measures."""
    from taplight.operators import domain_model as model

    hosts = _names(spark, sf_dir).select(F.col("name").alias("domain"), F.lit(0).alias("label"))
    made = views.read(spark, sf_dir, "pages").select(F.concat(F.substring(F.sha1(F.col("url").cast("binary")), 1, 16), F.lit(".net")).alias("domain"), F.lit(1).alias("label")).distinct()
    rows = hosts.union(made)
    train, test = model.split(rows)
    return model.score(model.fit(train), test).select("domain", "label", F.round("score", 4).alias("score"))
