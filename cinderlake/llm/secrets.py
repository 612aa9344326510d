"""Secret scans with corpus-wide ownership frequency.

Three base patterns are found in every whole text; the method adds candidates that the base patterns miss
(key headers, signed tokens, well-known prefixes, random-looking strings), hashes every candidate's value and
aggregates the hashes over the corpus by distinct repositories and owners. A value held by many owners is a
copied example; a value of one or few owners looks live. Texts never leave the scan: only hashes and places do.

Defined results: a null text is empty; repeated rows are each reported (their value still counts once per owner
and repository); null owner or repository counts as one of its own; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut, require

# Fixed patterns: base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Fixed patterns: kinds that the method adds.
PRIVATE = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PREFIXED = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})")
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
_HINTS = ("pass", "secret", "token", "api")
BASE = ("assign", "access", "hex")
ADDED = ("private", "signed", "prefixed", "random")
KINDS = (*BASE, *ADDED)


def _random_looking(s: str) -> bool:
    """Digits, upper and lower case together, and at least 3.5 bits a character."""
    if not (any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)):
        return False
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in map(s.count, set(s))) >= 3.5


def find_base(text: str, low: bytes | None = None) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, value) of the base matches, by start, then kind as listed."""
    out = []
    if low is None or any(h in low for h in (b"pass", b"secret", b"token", b"api")):
        out += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def find_added(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Further candidates, none of them inside a base match or each other."""
    out: list[tuple[int, int, int, str]] = []
    starts, ends = [a for a, *_ in base], [0]  # ends[i]: how far the spans before the i-th reach
    for _, z, *_ in base:
        ends.append(max(ends[-1], z))

    def add(kind: int, found) -> None:
        mine = []
        for m in found:  # by start, and not overlapping each other
            i = bisect.bisect_left(starts, m.start())
            if ends[i] <= m.start() and (i == len(starts) or m.end() <= starts[i]):
                mine.append((m.start(), m.end(), kind, m[0]))
        if mine:
            out.extend(mine)
            spans = sorted([*base, *out])
            starts[:], ends[:] = [a for a, *_ in spans], [0]
            for _, z, *_ in spans:
                ends.append(max(ends[-1], z))

    if "-----BEGIN" in text:
        add(3, PRIVATE.finditer(text))
    if "eyJ" in text:
        add(4, SIGNED.finditer(text))
    if any(x in text for x in ("gh", "xox", "AIza", "sk_live_")):
        add(5, PREFIXED.finditer(text))
    add(6, (m for m in RANDOM.finditer(text) if _random_looking(m[0])))
    return out


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


_SCAN = "found array<struct<kind:int,start:int,end:int,value:bigint>>"


def scan(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """``doc_id, repo, owner, found``: every candidate of each whole text; ``value`` is a 64-bit hash."""
    src = docs.select("doc_id", F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), "text")
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, repo string, owner string, {_SCAN}"
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))

    def run(batches):
        for b in batches:
            found = []
            for t in b.column(3):
                t = t.as_py()
                if not t:
                    found.append([])
                    continue
                base = find_base(t, t.lower().encode())
                found.append([{"kind": k, "start": a, "end": z, "value": _digest(v)} for a, z, k, v in sorted(base + find_added(t, base))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, kind)], ["doc_id", "repo", "owner", "found"])

    return src.mapInArrow(run, schema)


def owners(found: DataFrame) -> DataFrame:
    """``value, n_owners, n_repos, n_places`` over the corpus, pre-aggregated before every shuffle."""
    one = found.select("repo", "owner", F.explode("found").alias("f")).select(F.col("f.value").alias("value"), "repo", "owner")
    per = one.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    per = per.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return per.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_places"))


def scan_secrets(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = 4, example_repos: int = 64) -> DataFrame:
    """Per document: ``doc_id`` and ``spans``, an array by start of
    ``kind, start, end, base, n_owners, n_repos, verdict``; verdict is ``example`` for a widely copied value (of at least
    ``example_owners`` distinct owners, or in ``example_repos`` repositories of however few owners) and ``live`` otherwise. An added (not base) span is kept only if live.
    """
    require(docs, "doc_id", "text", repo_col, owner_col)
    found = cut(scan(docs, repo_col, owner_col).withColumn("__row", F.monotonically_increasing_id()))
    value = cut(owners(found))  # read twice over, and a plain table lets a hot value's join be split
    each = found.select("__row", F.explode("found").alias("f")).select("__row", "f.*")
    each = each.join(value, "value").select(
        "__row", F.struct("start", "kind", "end", "value", (F.col("kind") < len(BASE)).alias("base"), "n_owners", "n_repos", F.when((F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos), "example").otherwise("live").alias("verdict")).alias("s")
    )
    spans = each.where("s.base OR s.verdict = 'live'").groupBy("__row").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    empty = found.where(F.size("found") == 0).select("doc_id", F.array().cast(spans.schema["spans"].dataType).alias("spans"))
    some = found.where(F.size("found") > 0).select("doc_id", "__row").join(spans, "__row", "left").select("doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))
    return some.unionByName(empty)


def digest_columns(spans: DataFrame) -> DataFrame:
    """The query's columns from :func:`scan_secrets` rows."""
    names = F.array(*(F.lit(k) for k in KINDS))
    base = F.filter("spans", lambda s: s["base"])
    said = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
    )
