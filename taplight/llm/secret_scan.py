"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text).  The ledger holds one row per (blob, rule
version) that was scanned, clean blobs included.  A scan anti-joins the blobs of the given versions with the ledger,
reads one copy of each unseen blob, runs the rules, appends to the ledger and joins findings back to all paths.

Defined results: a null text is the empty text, which is a blob like others and has no findings; rows that repeat are
scanned once and each get their findings; offsets are code points, ends exclusive.  Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taplight.llm.common import free_name, shared_dir, small_batches, table, text_of, written

#: Goes into the ledger's key: a new version scans every blob again.
RULE_VERSION = "2"

# Base kinds, in the order in which equal starts are listed (fixed values of the contract).
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE = 12
BASE = ("assign", "access", "hex")

# Kinds beyond the base: a literal that must occur, and the pattern.
_MORE = (
    ("pem", "PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")),
    ("forge", "_", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", re.ASCII)),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII)),
)
KINDS = (*BASE, *(k for k, _, _ in _MORE))

Span = tuple[str, int, int]


def find_secrets(text: str) -> list[Span]:
    """(kind, start, end) by start, then by kind as listed."""
    spans = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    for kind, literal, pattern in _MORE:
        if literal in text:
            spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


LEDGER = "blob string, rule_version string, spans array<struct<kind:string,start:long,stop:long>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in find_secrets(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array([RULE_VERSION] * len(found)), pa.array(found, _SPAN)], ["blob", "rule_version", "spans"])


def blob_id(text: Column) -> Column:
    return F.sha2(F.encode(text_of(text), "utf-8"), 256)


def update_ledger(versions: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Scan the blobs of ``versions`` that the ledger lacks for this rule version; appends them and tells how many.

    Only identifiers and hashes are shuffled to choose one copy of each blob; the chosen copies' texts move once.
    """
    spark = versions.sparkSession
    small_batches(spark)
    rows = versions.select(versions[id_col].cast("long").alias("id"), blob_id(versions[text_col]).alias("blob"), text_of(versions[text_col]).alias("text"))
    blobs = rows.groupBy("blob").agg(F.min("id").alias("id"))
    try:
        known = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version") == RULE_VERSION).select("blob")
        blobs = blobs.join(known, "blob", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    unseen = blobs.select(F.col("blob").alias("b"), F.col("id").alias("i"))
    texts = rows.join(unseen.hint("shuffle_hash"), (rows["blob"] == unseen["b"]) & rows["id"].eqNullSafe(unseen["i"]), "left_semi")
    fresh = texts.select("blob", "text").mapInArrow(_scan, LEDGER)
    part = written(fresh.dropDuplicates(["blob"]), shared_dir(spark, "scan"))
    part.write.mode("append").parquet(ledger_path)
    return part.count()


def _known(spark, ledger_path: str) -> DataFrame:
    """(blob, spans) of the ledger for this rule version; rows that a second writer or a retry repeated count once."""
    return spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version") == RULE_VERSION).select("blob", "spans").dropDuplicates(["blob"])


def findings(versions: DataFrame, ledger_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, spans) for every row of ``versions``, whichever copy was scanned."""
    known = _known(versions.sparkSession, ledger_path)
    paths = versions.select(versions[id_col].cast("long").alias("doc_id"), blob_id(versions[text_col]).alias("blob"))
    return paths.join(known, "blob").select("doc_id", "blob", "spans")


def scan(versions: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring the ledger (a new one, if no path is given) up to date and return the findings of every row."""
    path = ledger_path or shared_dir(versions.sparkSession, "ledger")
    update_ledger(versions, path, id_col, text_col)
    return findings(versions, path, id_col, text_col)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(of(k) for k in BASE), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


REDACTED = "[SECRET]"


def _cover(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["stop"] > at:
            if s["start"] >= at:
                out += [text[at : s["start"]], REDACTED]
            at = s["stop"]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every finding replaced by REDACTED, all columns and rows kept; texts without findings stay as they are.

    Findings are joined on the blob they were found in, so a repeated or null identifier does no harm; joined columns
    have names that ``docs`` doesn't use.
    """
    path = ledger_path or shared_dir(docs.sparkSession, "ledger")
    update_ledger(docs, path, id_col, text_col)
    blob, spans = free_name(docs, "blob"), free_name(docs, "spans")
    known = _known(docs.sparkSession, path).where(F.size("spans") > 0)
    joined = docs.withColumn(blob, blob_id(docs[text_col])).join(known.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob, "left")

    @F.pandas_udf("string")
    def covered(texts, spans):
        import pandas as pd

        return pd.Series([_cover(t, s) if t and s is not None and len(s) else t for t, s in zip(texts, spans, strict=True)], dtype=object)

    new = F.when(F.col(spans).isNotNull(), covered(F.col(text_col), F.col(spans))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, new).select(*docs.columns)


def span_digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE).encode()).hexdigest()


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, by way of a new ledger."""
    return digests(scan(table(spark, sf_dir, "documents")))
