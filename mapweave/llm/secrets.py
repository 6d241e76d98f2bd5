"""Secret scans that link the parts of a credential.

Strong forms (assignments, access identifiers, long hex) are reported as they
stand. Weak forms - identifiers, keys and endpoints that prove nothing alone -
are joined as intervals: a weak part counts only when its complement lies
within ``SCOPE`` code points of it in the same text. An identifier needs a
secret, a key needs an identifier or an endpoint, an endpoint needs both.

The join runs inside each row over that text's parts, which are sorted by
their places: each part looks up the first of the other kind that reaches its
scope, by binary search. It emits no pairs.

Defined results: a null or empty text has no spans; texts of any length are
read whole, in time that grows with the length and the logarithm of the number
of parts; positions are code points, ends exclusive; spans that begin together
sort by end and then by kind; repeated rows and rows with a null doc_id each
get their spans; an empty table gives an empty result; columns outside
``keep`` are ignored, and a kept column named ``base`` or ``spans`` gives way
to the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import any_of, computed, count_kind, let, meets, packed, regex_spans, span_text

KINDS = ("assign", "access", "hex")
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
PATTERNS = {
    "assign": KEYWORD + r"[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
KEY = "[A-Za-z0-9+/_=-]"
WEAK_PATTERNS = {
    "identifier": r"(?<![A-Za-z0-9])(?=[A-Z]{0,31}[0-9])(?=[0-9]{0,31}[A-Z])[A-Z0-9]{16,32}(?![A-Za-z0-9])",
    "key": rf"(?<!{KEY})(?=[A-Za-z+/_=-]{{0,63}}[0-9])(?=[A-Z0-9+/_=-]{{0,63}}[a-z])(?=[a-z0-9+/_=-]{{0,63}}[A-Z]){KEY}{{32,}}+",
    "endpoint": r"(?<![A-Za-z])(?:https?|s3|postgres|mysql|redis|mongodb)://[A-Za-z0-9.-]{3,253}(?::[0-9]{1,5})?",
}
SCOPE = 256
MIN_ASSIGNED = 6


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), scope: int = SCOPE) -> DataFrame:
    """``keep``, ``base`` and ``spans``: sorted arrays of struct<start, end, rank, kind, value>."""
    rows = docs.select(packed(keep, ("base", "spans")).alias("_kept"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    where = {
        "assign": let("low", "lower(_text)", any_of("low", "password", "passwd", "secret", "token", "apikey", "api_key")),
        "access": any_of("_text", "AKIA"),
        "endpoint": any_of("_text", "://"),
    }
    found = {k: regex_spans("_text", p, k, i, where.get(k, "true")) for i, (k, p) in enumerate({**PATTERNS, **WEAK_PATTERNS}.items())}
    # what follows the keyword must be long enough; a match that fails is dropped whole
    found["assign"] = F.filter(found["assign"], lambda s: F.length(F.regexp_replace(s["value"], "^" + KEYWORD, "")) >= MIN_ASSIGNED)
    rows = computed(rows, ("_kept",), **found)

    def near(within: int, *kinds: str) -> str:
        return "(" + " OR ".join(meets(k, f"s.start - {within}", f"s.end + {within}") for k in kinds) + ")"

    # weak parts stand where no base span does
    rows = computed(rows, ("_kept", *KINDS), **{k: F.expr(f"filter({k}, s -> NOT {near(-1, *KINDS)})") for k in WEAK_PATTERNS})
    identifiers, keys = ("identifier", "access"), ("key", "assign", "hex")
    links = {"identifier": near(scope, *keys), "key": near(scope, *identifiers, "endpoint"), "endpoint": f"{near(scope, *identifiers)} AND {near(scope, *keys)}"}
    base = F.concat(*KINDS)
    rows = computed(rows, ("_kept",), base=F.sort_array(base), spans=F.sort_array(F.concat(base, *(F.expr(f"filter({k}, s -> {link})") for k, link in links.items()))))
    return rows.select("_kept.*", "base", "spans")


def digest(found: DataFrame) -> DataFrame:
    counts = [count_kind("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
