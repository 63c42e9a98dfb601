"""Feature records as JSON lines, checked and mapped to flows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taplight.functions import codes, text
from taplight.sources.shared import computed_once

#: Fields of a record and of its blocks by kind; a whole number has its least value, the greatest is that of its column.
TEXTS = ("flow_id", "uid", "src_ip", "dst_ip", "proto", "service", "conn_state")
PORTS = ("src_port", "dst_port")
COUNTERS = ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes")
REALS = ("timestamp", "ts", "duration")
REQUIRED = ("src_ip", "dst_ip", "proto", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")
_ENDS = {"uid": "text", "event_time": "real", "source_ordinal": "whole", "src_ip": "text", "src_port": "port", "dst_ip": "text", "dst_port": "port", "proto": "text", "transaction_count": "count"}
BLOCKS = {
    "dns": {**dict.fromkeys(("query", "qtype", "rcode", "qtype_num", "rcode_num"), "text"), **dict.fromkeys(("query_length", "label_count", "answer_count"), "whole"), "z": "byte", "query_entropy": "real", "subdomain_entropy": "real", **dict.fromkeys(("is_txt", "rejected", "authoritative_answer", "truncated", "recursion_desired", "recursion_available"), "flag"), **_ENDS},
    "tls": {**dict.fromkeys(("ja3", "ja3s", "ja4", "server_name", "version", "cipher"), "text"), "ssl_version_encoded": "code", "has_ja3": "flag", "has_ja3s": "flag", "sni_length": "whole", "sni_entropy": "real", **_ENDS},
    "http": {**dict.fromkeys(("host", "uri", "user_agent", "method"), "text"), "method_encoded": "code", **dict.fromkeys(("status_code", "host_length", "uri_length", "user_agent_length", "request_body_len", "response_body_len"), "whole"), "uri_entropy": "real", "has_user_agent": "flag", **_ENDS},
}
_KIND_TYPES = {"text": "string", "real": "double", "whole": "bigint", "count": "int", "port": "int", "byte": "int", "code": "int", "flag": "boolean"}
#: The least and the greatest double that fit.
_BOUNDS = {"whole": (0.0, 9.223372036854775e18), "count": (1.0, 2147483647.0), "port": (0.0, 65535.0), "byte": (0.0, 255.0)}
_NUMBER = "^(BIGINT|DOUBLE|DECIMAL|FLOAT)"


def _struct(kind: str) -> str:
    return "struct<" + ",".join(f"{name}:{_KIND_TYPES[of]}" for name, of in BLOCKS[kind].items()) + ">"


def _fields(variant: Column) -> Column:
    """A variant's top-level fields; null of what is no object."""
    return F.try_variant_get(variant, "$", "map<string, variant>")


def _of(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _text_of(value: Column) -> Column:
    """A JSON string; null of anything else, which a cast would turn into text."""
    return F.when(F.schema_of_variant(value) == "STRING", _of(value, "string"))


def _at(json: Column, name: str, kind: str = "variant") -> Column:
    """A field of a record; null where it is absent."""
    return F.try_variant_get(json, f"$.{name}", kind)


def timestamp(kinds: Column, record: Column) -> Column:
    """``timestamp``, else ``ts``, else the number after the last colon of ``flow_id``; a quoted number is no number."""
    number = lambda name: F.when(kinds[name].rlike(_NUMBER), record[name])
    tail = F.regexp_extract(record["flow_id"], r"^.*:\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$", 1)
    return F.coalesce(number("timestamp"), number("ts"), F.nullif(tail, F.lit("")).try_cast("double"))


def _core_reasons(json: Column, kinds: Column, record: Column) -> list[Column]:
    """What is wrong with each field of a record itself; ``kinds`` are their JSON types, null where a field is absent."""
    most = _BOUNDS["whole"][1]

    def reason(name: str, test: Column) -> Column:
        absent = F.lit(f"missing_{name}") if name in REQUIRED else F.lit(None).cast("string")
        return F.when(F.coalesce(kinds[name], F.lit("VOID")) == "VOID", absent).otherwise(test)

    def whole(name: str, top: float, outside: str) -> Column:
        kind, wide = kinds[name], _at(json, name, "double")
        small = F.when(record[name].isNull() | (record[name] < 0) | (record[name] > int(top)), F.lit(outside))
        large = F.when(wide % 1 != 0, F.lit(f"whole_{name}")).when(F.isnan(wide) | ~wide.between(0, top), F.lit(outside))
        return F.when(kind == "BIGINT", small).when(~kind.rlike(_NUMBER), F.lit(f"type_{name}")).otherwise(large)

    def real(name: str) -> Column:
        value = record[name]
        outside = F.isnan(value) | (F.abs(value) == float("inf")) | (value < (0.0 if name == "duration" else float("-inf")))
        return F.when(~kinds[name].rlike(_NUMBER), F.lit(f"type_{name}")).when(outside, F.lit(f"range_{name}"))

    return [
        *(reason(n, F.when(kinds[n] != "STRING", F.lit(f"type_{n}"))) for n in TEXTS),
        *(reason(n, whole(n, 65535, "port")) for n in PORTS),
        *(reason(n, whole(n, most, f"range_{n}")) for n in COUNTERS),
        *(reason(n, real(n)) for n in REALS),
    ]


def _unfit(entry: Column, kind: str) -> Column:
    """Whether a field of a block can't be what it should be; numbers and flags may be quoted there."""
    names = {of: [n for n, k in BLOCKS[kind].items() if k == of] for of in (*_BOUNDS, "text", "real", "flag")}
    value, key, number = entry["value"], entry["key"], _of(entry["value"], "double")
    tests = F.when(key.isin(*names["text"]), F.schema_of_variant(value) != "STRING").when(key.isin(*names["real"]), number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))).when(key.isin(*names["flag"]), _of(value, "boolean").isNull())
    for of, (least, most) in _BOUNDS.items():
        if names[of]:
            tests = tests.when(key.isin(*names[of]), number.isNull() | F.isnan(number) | (number % 1 != 0) | ~number.between(least, most))
    return ~F.is_variant_null(value) & F.coalesce(tests, F.lit(False))


def _block_tests(kind: str, json: Column, record: Column) -> tuple[Column, dict[str, Column]]:
    """Whether a record has a block or transactions of a kind; what is wrong with each, and between them."""
    block, rows_of = record[kind], record[f"{kind}_transactions"]
    given, listed = _at(json, kind), _at(json, f"{kind}_transactions")
    array, n = listed.isNotNull(), F.size(rows_of)
    ordinals = F.filter(F.transform(rows_of, lambda t: t["source_ordinal"]), lambda o: o.isNotNull())
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(ordinals) - 1, F.lit(1))), lambda i: F.coalesce(F.get(ordinals, i) > F.get(ordinals, i - 1), F.lit(True)))
    uids = F.filter(F.concat(F.array(record["uid"], block["uid"]), F.coalesce(F.transform(rows_of, lambda t: t["uid"]), F.array().cast("array<string>"))), lambda u: u != "")
    parts = F.transform(_of(listed, "array<variant>"), _fields)
    prefix = "" if kind == "dns" else f"{kind}_"
    return given.isNotNull() | array, {
        f"type_{kind}": given.isNotNull() & ~F.is_variant_null(given) & _fields(given).isNull(),
        f"fields_{kind}": F.exists(F.map_entries(_fields(given)), lambda e: _unfit(e, kind)),
        f"type_{kind}_transactions": array & (parts.isNull() | F.exists(parts, lambda p: p.isNull())),
        f"fields_{kind}_transactions": F.exists(parts, lambda p: F.exists(F.map_entries(p), lambda e: _unfit(e, kind))),
        f"{prefix}transactions": array & rows_of.isNotNull() & F.when(block.isNull(), n > 0).otherwise((n == 0) | F.coalesce(block["transaction_count"] != n, F.lit(True))),
        f"{prefix}transaction_uids": (n > 0) & (F.size(F.array_distinct(uids)) > 1),
        f"{prefix}transaction_order": (n > 0) & ~rising,
    }


def parse(lines: DataFrame) -> DataFrame:
    """``value`` lines as records, each with the reasons for which it must be rejected; blank lines are left out.

    A line is parsed once, to a variant; its fields become a map that all tests and the typed record read.  Counters
    that a long can't hold are out of range.  A line that has a name twice is no JSON.
    """
    json, record, kinds = F.col("json"), F.col("record"), F.col("kinds")
    names = (*TEXTS, *PORTS, *COUNTERS, *REALS)
    raw = lines.where(text.stripped(F.col("value")) != "").withColumn("json", F.try_parse_json("value"))
    texts = {c: _text_of(_at(json, c)) for c in TEXTS}
    texts |= {c: text.stripped(texts[c]) for c in ("src_ip", "dst_ip", "proto")}
    typed = {**texts, **{c: _at(json, c, "int") for c in (*PORTS, "conn_state_encoded")}, **{c: _at(json, c, "bigint") for c in COUNTERS}, **{c: _at(json, c, "double") for c in REALS}}
    for kind in BLOCKS:
        typed |= {kind: _at(json, kind, _struct(kind)), f"{kind}_transactions": _at(json, f"{kind}_transactions", f"array<{_struct(kind)}>")}
    there = [_at(json, k + more).isNotNull() for k in BLOCKS for more in ("", "_transactions")]
    made = raw.withColumns({
        "kinds": F.when(_fields(json).isNotNull(), F.struct(*(F.schema_of_variant(_at(json, c)).alias(c) for c in names), reduce(or_, there).alias("blocks"))),
        "record": F.struct(*(v.alias(n) for n, v in typed.items())),
    })
    # Tests of blocks make too much code to compile; a lambda over one element runs them, for the few records that have any.
    blocks = F.when(kinds["blocks"], F.get(F.transform(F.array(F.struct("json", "record")), _block_reasons), 0)).otherwise(F.array().cast("array<string>"))
    rows = made.withColumn("time", timestamp(kinds, record))
    own = {"address": (record["src_ip"] == "") | (record["dst_ip"] == "") | (record["proto"] == ""), "time": F.col("time").isNull()}
    found = F.array_distinct(F.filter(F.concat(F.array(*_core_reasons(json, kinds, record), *_named(own)), blocks), lambda x: x.isNotNull()))
    reasons = F.when(json.isNull(), F.array(F.lit("json"))).when(kinds.isNull(), F.array(F.lit("object"))).otherwise(found)
    return rows.withColumns({"reasons": reasons, "record": F.when(kinds.isNotNull(), record)}).drop("kinds")


def _named(tests: dict[str, Column]) -> list[Column]:
    return [F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in tests.items()]


def _block_reasons(row: Column) -> Column:
    """What is wrong with the blocks of a record and their transactions."""
    json, record = row["json"], row["record"]
    return F.concat(*(F.when(some, F.array(*_named(tests))).otherwise(F.array().cast("array<string>")) for some, tests in (_block_tests(k, json, record) for k in BLOCKS)))


def read(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(flows, rejects) of a file; strict reading raises on the first reject."""
    rows = computed_once(parse(spark.read.text(path)))
    good = rows.where(F.size("reasons") == 0)
    if strict and (bad := rows.where(F.size("reasons") > 0).select("reasons").first()):
        raise ValueError(f"a record was rejected: {', '.join(bad['reasons'])}")
    return good.select("record.*", F.col("time").alias("event_time")), rows.where(F.size("reasons") > 0).select("value", "reasons")


def decoded(flows: DataFrame) -> DataFrame:
    """Flows whose names of states, versions and methods are filled from their codes where the texts are lacking."""
    state = F.coalesce(F.nullif("conn_state", F.lit("")), codes.lookup(codes.CONN_STATES, F.col("conn_state_encoded")))
    named = lambda block, text, code, table: F.when(F.col(block).isNotNull(), F.col(block).withField(text, F.coalesce(F.col(block)[text], codes.lookup(table, F.col(block)[code]))))
    return flows.withColumns({"conn_state": state, "tls": named("tls", "version", "ssl_version_encoded", codes.TLS_VERSIONS), "http": named("http", "method", "method_encoded", codes.HTTP_METHODS)})


def write(flows: DataFrame, path: str, nulls: bool = False) -> None:
    """Records as JSON lines below a new path; an existing one is an error."""
    flows.write.mode("errorifexists").option("ignoreNullFields", str(not nulls).lower()).json(path)
