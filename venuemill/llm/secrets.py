"""Secret scans over content-addressed blobs, with a ledger of what was scanned.

A path is one row (a version of a file, a document).  Its text is a blob named by
its SHA-256; the ledger names the (blob, rule version) pairs already scanned
and keeps their findings, so a blob is scanned once, in however many paths and
versions it stands, and findings are joined back to all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE_VERSION = "3"
KINDS = ["assign", "access", "hex", "token", "key", "url"]
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: kind -> pattern.  The first three are fixed; the others add well-known shapes.  None has an upper bound, and each looks at a run of
#: its characters once: a run is entered at its first character, or its end does not depend on what follows.
_RULES = {
    "access": re.compile(r"AKIA[A-Z0-9]{12,}"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
    "token": re.compile(
        r"\bgh[pousr]_[A-Za-z0-9]{36,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII
    ),
    "key": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
}
#: What follows the scheme of a url with user and password; the scheme is read backwards from here.
_LOGIN = re.compile(r"://[^\s/:@]+:[^\s/@]+@", re.ASCII)
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")


def _urls(text: str) -> list[tuple[str, int, int]]:
    """Urls with user and password, from the first letter of the run of scheme characters; a scheme has two at least."""
    found = []
    for m in _LOGIN.finditer(text):
        at = m.start()
        while at and text[at - 1] in _SCHEME:
            at -= 1
        while at < m.start() and not "a" <= text[at] <= "z":
            at += 1
        if m.start() - at >= 2:
            found.append(("url", at, m.end()))
    return found

FINDINGS = "array<struct<kind:string,start:int,end:int>>"
_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(text: str) -> list[dict]:
    """Spans of ``text`` in code points, by start and then by kind as listed in ``KINDS``."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    for kind, pattern in _RULES.items():
        found += [(kind, *m.span()) for m in pattern.finditer(text)]
    found += _urls(text)
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return [dict(zip(("kind", "start", "end"), x)) for x in found]


def blob_of(text: str = "text"):
    """SHA-256 of the text's UTF-8 bytes; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def distinct_blobs(paths: DataFrame, text: str = "text") -> DataFrame:
    """(blob, text) of each content, once per task: copies do not reach the shuffle more often than tasks do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            names, keep = [], []
            for i, body in enumerate(batch.column(0).to_pylist()):
                name = hashlib.sha256(body or b"").digest()
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), batch.column(0).take(pa.array(keep, pa.int64()))], ["blob", "body"]
            )

    return paths.select(F.col(text).cast("string").cast("binary").alias("body")).mapInArrow(run, "blob binary, body binary")


def scan_unseen(paths: DataFrame, ledger: DataFrame | None = None, version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """New ledger rows (blob, version, findings) for the blobs of ``paths`` that ``ledger`` lacks under ``version``.

    Blobs without a finding get a row with an empty list, so they are not scanned again.
    """
    blobs = distinct_blobs(paths, text)
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("version") == version).select("blob"), "blob", "left_anti")
    dealt = blobs.repartition("blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            names, found = [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    found.append(scan((body or b"").decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([version] * len(names), pa.string()), pa.array(found, _FINDINGS)],
                ["blob", "version", "findings"],
            )

    return dealt.mapInArrow(run, f"blob binary, version string, findings {FINDINGS}")


def findings_of_paths(paths: DataFrame, ledger: DataFrame, version: str = RULE_VERSION, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, blob, findings) of every path, from the ledger.

    Only blobs with findings are joined; paths with clean blobs, null and empty
    texts get an empty list.  Repeated rows each keep their row.
    """
    named = paths.select(F.col(doc_id).cast("long").alias("doc_id"), blob_of(text).alias("blob"))
    dirty = ledger.filter((F.col("version") == version) & (F.size("findings") > 0)).select("blob", "findings")
    none = F.array().cast(FINDINGS)
    return named.join(dirty, "blob", "left").select("doc_id", "blob", F.coalesce("findings", none).alias("findings"))


def update_ledger(ledger: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if ledger is None else ledger.unionByName(new)
