"""Secret scans.

One pass of an Aho-Corasick automaton over a text finds keywords; an expression is matched only
where a keyword begins, anchored there. Tokens that carry a checksum are kept only if it holds.
Hexadecimal runs have no keyword and are found by their own expression.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_stage, documents, narrow

#: Letters of the keyword stand in either case; ASCII only.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
KINDS = ("assign", "access", "hex", "checked")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def checksum(body: str) -> str:
    """The CRC32 of a token's body as six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out.rjust(6, "0")


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind), in code points with the end exclusive, by start and then kind as listed."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # one letter may become two; places must stay
            low = text.translate(_LOWER)
        hits = sorted((end - size + 1, kind) for end, (kind, size) in self.automaton.iter(low))
        spans, past = [], dict.fromkeys(KINDS, 0)
        for start, kind in hits:
            if start < past[kind]:
                continue
            if kind == "assign":
                if found := ASSIGN.match(text, start):
                    past[kind] = found.end()
                    if len(found[2]) >= 6:
                        spans.append((start, found.end(), kind))
            elif kind == "access":
                if found := ACCESS.match(text, start):
                    past[kind] = found.end()
                    if found.end() - start >= 20:
                        spans.append((start, found.end(), kind))
            elif (found := CHECKED.match(text, start)) and checksum(found[1]) == found[2]:
                past[kind] = found.end()
                spans.append((start, found.end(), kind))
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        return spans


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[REDACTED]") -> str:
    """The text with each union of overlapping spans replaced by a mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<start:long,end:long,kind:string>>"


def scan(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", redacted: bool = False) -> DataFrame:
    """The columns kept and spans: an array of (start, end, kind). With redacted, `text` is
    returned too, with every span replaced; a text without spans, or null, is unchanged.

    A null or empty text has no spans. Every row of df gives one row.
    """
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", spans {SPANS}" + f", `{text}` string" * redacted
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def make():
        scanner = Scanner()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [scanner(t) for t in texts]
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            out["spans"] = pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in spans] for spans in found], kind)
            if redacted:
                out[text] = pa.array([redact(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
            return pa.RecordBatch.from_pydict(out)

        return each

    return arrow_stage(narrow(df, *keep, text), make, schema)


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "checked")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
