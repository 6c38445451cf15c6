"""Secret scans that weigh how widely a candidate is owned.

Texts are searched for assignments, access keys and hexadecimal strings, and for further
candidate formats. The hash of every candidate is counted over the whole corpus by distinct
owners, and for each owner by repositories and documents; equal and near-equal documents count
once, for one owner. A value that several owners hold, or that one owner holds in many
repositories or documents, is a copied example; another one that looks random is a live
credential. Further candidates become spans only if they are live; base spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark.llm.common import keep, map_slices, row_key, texts
from haulmark.llm.near_dedup import near_duplicates

KINDS = ("assign", "access", "hex")
MORE_KINDS = ("provider", "jwt", "pem", "opaque")
#: Repositories and documents of one owner that may share a live credential.
MAX_REPOS = 2
MAX_USES = 8
#: Copies of a text with fewer shingles are copies of its candidate, not of a document.
FOLD_SHINGLES = 16

_ASSIGN = re.compile(
    r"(?a)((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Published key formats, fixed values.
_PROVIDER = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{24,}"
)
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]|-(?!----END))*")
_HEX = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_OPAQUE = np.array([b < 128 and (chr(b).isalnum() or chr(b) in "+/_-") for b in range(256)])
_PREFIXES = (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"xox", b"aiza", b"sk_live_")
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

FOUND = "array<struct<kind:string,start:bigint,end:bigint,hash:bigint,random:boolean,base:boolean>>"
SCANNED = f"key long, doc_id long, owner string, repo string, text string, found {FOUND}"


def entropy(value: str) -> float:
    """Bits for each character of a value."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_random(value: str) -> bool:
    return len(value) >= 12 and entropy(value) >= 3.0


Span = tuple[str, int, int, str]


def long_runs(data: bytes, characters: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Begin and end of the longest runs of the given bytes, if they have ``least`` of them."""
    inside = np.concatenate(([False], characters[np.frombuffer(data, np.uint8)], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[0::2], edge[1::2]
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))


def base_spans(text: str, low: bytes, hexes: list[Span]) -> list[Span]:
    """Kind, start, end and value of the base spans; ``low`` is the text's lower-cased UTF-8."""
    spans = list(hexes)
    if any(k in low for k in _KEYWORDS):
        spans += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"akia" in low:
        spans += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def more_spans(text: str, low: bytes, opaque: list[Span], taken: list[Span]) -> list[Span]:
    """Further candidates that touch neither a base span nor each other."""
    found = []
    if any(k in low for k in _PREFIXES):
        found += [("provider", m.start(), m.end(), m[0]) for m in _PROVIDER.finditer(text)]
    if b"eyj" in low:
        found += [("jwt", m.start(), m.end(), m[0]) for m in _JWT.finditer(text)]
    if b"-----begin" in low:
        found += [("pem", m.start(), m.end(), m[0]) for m in _PEM.finditer(text)]
    found += [s for s in opaque if entropy(s[3]) >= 3.5 and not (s[3].isalpha() or s[3].islower())]
    free, busy = [], [(s[1], s[2]) for s in taken]
    for s in found:
        if all(s[2] <= b or e <= s[1] for b, e in busy):
            free.append(s)
            busy.append((s[1], s[2]))
    return free


def spans_of(texts_: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and further candidates of each text; places count code points."""
    raw = [t.encode() for t in texts_]
    data = b" ".join(raw)
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    by_kind: list[dict[int, list[Span]]] = []
    for kind, characters, least in (("hex", _HEX, 16), ("opaque", _OPAQUE, 24)):
        runs: dict[int, list[Span]] = {}
        for b, e in long_runs(data, characters, least):
            doc = int(np.searchsorted(begin, b, side="right")) - 1
            start = len(data[begin[doc] : b].decode())
            runs.setdefault(doc, []).append((kind, start, start + e - b, data[b:e].decode()))
        by_kind.append(runs)
    out = []
    for i, (text, r) in enumerate(zip(texts_, raw, strict=True)):
        low = r.lower()
        base = base_spans(text, low, by_kind[0].get(i, []))
        out.append((base, more_spans(text, low, by_kind[1].get(i, []), base)))
    return out


def scan_rows(part: pa.RecordBatch) -> dict:
    found = [
        [
            {
                "kind": kind,
                "start": start,
                "end": end,
                "hash": int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], "little", signed=True),
                "random": looks_random(value),
                "base": is_base,
            }
            for spans, is_base in ((base, True), (more, False))
            for kind, start, end, value in spans
        ]
        for base, more in spans_of(part.column("text").to_pylist())
    ]
    text = [t if f else None for t, f in zip(part.column("text").to_pylist(), found, strict=True)]
    return {c: part.column(c) for c in ("key", "doc_id", "owner", "repo")} | {"text": text, "found": found}


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", one)


def folded(scanned: DataFrame) -> DataFrame:
    """``key`` and ``copy``, equal for rows that are near copies of one document; only rows with candidates."""
    some = scanned.filter("text IS NOT NULL").select(F.col("key").alias("doc_id"), "text")
    return near_duplicates(some).select(
        F.col("doc_id").alias("key"), F.when(F.col("n_shingles") >= FOLD_SHINGLES, F.col("component_id")).alias("copy")
    ).distinct()


def ownership(candidates: DataFrame) -> DataFrame:
    """Owners of each candidate hash, and the most repositories and documents (``copy``) that one of them holds."""
    return (
        candidates.groupBy("hash", "copy")
        .agg(F.min(F.struct("owner", "repo")).alias("at"))
        .groupBy("hash", F.col("at.owner").alias("owner"), F.col("at.repo").alias("repo"))
        .agg(F.count("*").alias("uses"))
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("repos"), F.sum("uses").alias("uses"))
        .groupBy("hash")
        .agg(F.count("*").alias("owners"), F.max("repos").alias("repos"), F.max("uses").alias("uses"))
    )


def weigh(
    docs: DataFrame, owner_col: str, repo_cols: Sequence[str], max_owners: int, max_repos: int, max_uses: int
) -> tuple[DataFrame, DataFrame]:
    """What was found in each document, and for those with candidates the live and copied ones."""
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner")
    repo = F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols))).alias("repo")
    rows = texts(docs, "doc_id", "text", row_key().alias("key"), owner, repo)
    scanned = keep(map_slices(rows, scan_rows, SCANNED), "secrets")
    candidates = scanned.select("key", "owner", "repo", F.explode("found").alias("c")).select(
        "key", "owner", "repo", F.col("c.hash").alias("hash"), F.col("c").alias("span")
    )
    # short texts are not folded: each row is a document of its own
    copy = F.coalesce("copy", F.xxhash64("key", "owner", "repo")).alias("copy")
    held = candidates.join(keep(folded(scanned), "copies"), "key", "left").select("hash", "owner", "repo", copy)
    spread = ownership(held)
    copied = (F.col("owners") > max_owners) | (F.col("repos") > max_repos) | (F.col("uses") > max_uses)
    live = ~copied & F.col("span.random")
    weighed = (
        candidates.select("key", "hash", "span")
        .distinct()
        .join(spread, "hash")
        .groupBy("key")
        .agg(
            F.count_if(live).alias("n_live"),
            F.count_if(copied).alias("n_copied"),
            F.collect_list(F.when(live | F.col("span.base"), F.col("span"))).alias("spans"),
        )
    )
    return scanned, weighed


def scan(
    docs: DataFrame,
    owner_col: str = "source",
    repo_cols: Sequence[str] = ("source", "lang"),
    max_owners: int = 1,
    max_repos: int = MAX_REPOS,
    max_uses: int = MAX_USES,
) -> DataFrame:
    """Base spans, all spans and the number of live and copied candidates of each document.

    A candidate is copied if more than ``max_owners`` owners hold it, or one of them in more
    than ``max_repos`` repositories or ``max_uses`` documents, and live if it is not and its
    characters look random. Near copies of a document of some length are one document. ``spans`` holds every base span and the further
    candidates that are live. A missing or empty text has no spans; a missing owner or
    repository counts as one of its own. Rows with equal or missing ids are scanned one by
    one. Needs ``doc_id``, ``text`` and the named columns; others are ignored.
    """
    scanned, weighed = weigh(docs, owner_col, repo_cols, max_owners, max_repos, max_uses)
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    order = F.create_map(*(F.lit(x) for i, k in enumerate((*KINDS, *MORE_KINDS)) for x in (k, i)))
    everything = F.array_sort(
        F.transform(
            F.coalesce("spans", F.array().cast(FOUND)),
            lambda s: F.struct(
                s["start"].alias("start"), order[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")
            ),
        )
    )
    return scanned.join(weighed, "key", "left").select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(everything).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


REDACTED = "[REDACTED]"


def masked(text: str, spans: list[dict]) -> str:
    """The text with each run of overlapping spans replaced."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], REDACTED]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(
    docs: DataFrame,
    owner_col: str = "source",
    repo_cols: Sequence[str] = ("source", "lang"),
    max_owners: int = 1,
    max_repos: int = MAX_REPOS,
    max_uses: int = MAX_USES,
) -> DataFrame:
    """All documents and columns, the spans of ``scan`` replaced in ``text``; ``n_chars`` follows, if there is one."""
    _, weighed = weigh(docs, owner_col, repo_cols, max_owners, max_repos, max_uses)
    spans = keep(weighed.select("key", "spans"), "spans")
    rows = docs.select(row_key().alias("key"), F.struct(*docs.columns).alias("row")).join(spans, "key", "left")
    clean = rows.select("spans", F.col("row.text").alias("text"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [
                masked(t, s) if s and t is not None else None
                for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), batch.column("row")], ["new", "row"])

    schema = T.StructType([T.StructField("new", T.StringType()), T.StructField("row", docs.schema)])
    out = clean.mapInArrow(run, schema)
    text = F.coalesce("new", "row.text")
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("new").isNotNull(), F.length(text)).otherwise(F.col("row.n_chars"))
    return out.select(*(changed.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
