"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base patterns give candidates, weak patterns give more. Each candidate gets
three votes (-1, 0, 1): a check of its form, a gazetteer (of top-level domains,
address blocks, issuers, country and area codes, issued numbers, given names)
and the words before it. Counts of vote patterns over the whole input, at most
27 a kind, go to the driver; expectation-maximisation estimates there how
reliable each labeler is, and a logistic classifier fitted to the posteriors
becomes a Spark expression. Base spans that pass their check always stay; weak
spans join them where the classifier alone says so and no base span is touched.

Candidates are written to the shared folder once, as votes have to be counted
before any span is judged. No text is shuffled, and none is written but where
it is kept.

Defined results: a null or empty text has no spans; texts of any length are
read whole, in time that grows with their length and the logarithm of the
number of spans; positions are code points, ends exclusive; spans that begin
together sort by end and then by kind; repeated rows and rows with a null
doc_id each get their spans; an empty table gives an empty result and an
untrained classifier that adds nothing; columns outside ``keep`` are ignored,
and a kept column named ``base`` or ``spans`` gives way to the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import any_of, chunks_of, computed, count_kind, let, meets, packed, regex_spans, running, span_text, stage, stretch

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: Possessive forms of the base patterns. A run may start a match only where the run or the search starts, so no text takes quadratic time; which spans are found stays the same.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WEAK_PATTERNS = {
    "masked_email": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "local_phone": r"(?<![0-9+)(.-])(?<![0-9][\x20])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?",
}
ALL_KINDS = (*KINDS, *WEAK_PATTERNS)
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CONTEXT_CHARS = 40
CUES = {
    "email": "mail|contact|write", "masked_email": "mail|contact|write", "ip": r"\bip\b|address|server|host", "card": "card|visa|credit|payment|iban|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax", "local_phone": "phone|tel|call|mobile|fax", "national_id": r"ssn|social|\bid\b|identity", "person": "dear|sincerely|regards|contact",
}
AGAINST = r"version|release|section|chapter|figure|isbn|page"
LABELERS = ("pattern", "gazetteer", "context")
DOMAINS = "com|org|net|edu|gov|io|info|de|at|ch|fr|be|es|it|nl|pt|uk|us|ca|au|eu"
NAMES = (
    "Alice|Anna|Anne|Antoine|Barbara|Carlos|Carmen|Charles|Christine|Claire|Daniel|David|Elena|Elizabeth|Emily|Emma|Eric|Eva|Felix|Francisco|George|Hans|Helen|Isabel|"
    "James|Jan|Jane|Jean|Jennifer|Jessica|John|Jorge|Jose|Joseph|Juan|Julia|Julien|Karen|Karl|Kevin|Klaus|Laura|Linda|Lisa|Louis|Lucia|Luis|Maria|Marie|Mark|Martin|Mary|"
    "Matthew|Michael|Miguel|Nina|Olivia|Paul|Pedro|Peter|Philippe|Pierre|Richard|Robert|Sarah|Sofia|Sophie|Stefan|Susan|Thomas|William"
)
ISSUED = "^(?:00[1-9]|0[1-9]|[1-5]|6[0-57-9]|66[0-57-9]|7[0-2]|73[0-3]|7[56]|77[0-2])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """The base check of a base kind."""
    digits = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
        "card": digits.between(14, 19) & F.call_function("luhn_check", _digits(value)),
        "phone": digits.between(10, 15),
    }[kind]


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out.when(no, F.lit(-1)) if no is not None else out).otherwise(F.lit(0))


def _votes(kind: str, span: Column) -> list[Column]:
    v = span["value"]
    if kind in KINDS:
        pattern = _vote(passes(kind, v), ~passes(kind, v))
    elif kind == "national_id":
        pattern = _vote(~v.rlike("-00-|-0000$"), v.rlike("-00-|-0000$"))
    elif kind == "person":
        pattern = _vote(v.rlike(r"\.\x20[A-Z][a-z]{2,}\x20[A-Z][a-z]{2,}$"), v.rlike(r"\.\x20(?:The|This|That|And|But|It|In|On|He|She|We|They|You)\b"))
    else:
        pattern = _vote(F.lit(True))
    gazetteer = {
        "email": _vote(v.rlike(rf"(?i)\.(?:{DOMAINS})$"), ~v.rlike(r"[A-Za-z]{2,}$")),
        "masked_email": _vote(v.rlike(rf"(?i)(?:{DOMAINS})$"), ~v.rlike(r"[A-Za-z]{2,}$")),
        "ip": _vote(~v.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), v.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\.")),
        "card": _vote(v.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), v.rlike("^[0179]")),
        "phone": _vote(v.rlike(r"^\+(?:1|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])")),
        "local_phone": _vote(v.rlike(r"^\(?[2-9](?!11)"), v.rlike(r"^\(?(?:[01]|.11)")),
        "national_id": _vote(v.rlike(ISSUED), ~v.rlike(ISSUED)),
        "person": _vote(v.rlike(rf"\b(?:{NAMES})\b")),
    }[kind]
    before = span["before"]
    return [pattern, gazetteer, _vote(before.rlike(CUES[kind]), before.rlike(AGAINST))]


#: What a text must hold for a pattern to match at all.
NEEDED = {"email": ("@",), "phone": ("+",), "masked_email": ("(at)", "[at]"), "person": ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.")}


def candidates(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``_kept`` (the columns of ``keep`` as a struct) and by kind an array<struct<start, end, rank, kind, base, votes>> of every candidate."""
    rows = docs.select(packed(keep, ("base", "spans")).alias("_kept"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    found = {k: regex_spans("_text", p, k, i, any_of("_text", *NEEDED[k]) if k in NEEDED else "true") for i, (k, p) in enumerate({**PATTERNS, **WEAK_PATTERNS}.items())}
    rows = computed(rows, ("_kept", "_text"), **found)
    some = " OR ".join(f"size({k}) > 0" for k in ALL_KINDS)
    rows = computed(rows, ("_kept", *ALL_KINDS), _chunks=F.expr(f"CASE WHEN {some} THEN {chunks_of('_text')} ELSE cast(array() AS array<string>) END"))
    before = f"lower({stretch('_chunks', f'greatest(s.start - {CONTEXT_CHARS}, 0)', 's.start')})"
    cued = {k: F.expr(f"transform({k}, s -> named_struct('start', s.start, 'end', s.end, 'rank', s.rank, 'kind', s.kind, 'value', s.value, 'before', {before}))") for k in ALL_KINDS}
    rows = computed(rows, ("_kept",), **cued)

    def judged(kind: str) -> Column:
        def one(s: Column) -> Column:
            base = passes(kind, s["value"]) if kind in KINDS else F.lit(False)
            return F.struct(s["start"], s["end"], s["rank"], s["kind"], base.alias("base"), F.array(*_votes(kind, s)).alias("votes"))

        return F.transform(kind, one)

    return computed(rows, ("_kept",), **{k: judged(k) for k in ALL_KINDS})


def estimate(patterns: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of each vote pattern by EM over two classes; labelers are independent given the class."""
    if not patterns:
        return {}
    kinds = {k for k, _ in patterns}
    votes = (-1, 0, 1)
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p[1]))) for p in patterns}
    for _ in range(rounds):
        prior, share = {}, {}
        for kind in kinds:
            n = sum(c for (k, _), c in patterns.items() if k == kind)
            prior[kind] = (1 + sum(c * post[p] for p, c in patterns.items() if p[0] == kind)) / (2 + n)
        for y in (0, 1):
            mass = {p: c * (post[p] if y else 1 - post[p]) for p, c in patterns.items()}
            for j in range(len(LABELERS)):
                for v in votes:
                    # a labeler is held to be better than chance
                    lean = 1 + 2 * (v == (1 if y else -1))
                    share[y, j, v] = (lean + sum(m for p, m in mass.items() if p[1][j] == v)) / (5 + sum(mass.values()))
        for p in patterns:
            yes, no = math.log(prior[p[0]]), math.log(1 - prior[p[0]])
            for j, v in enumerate(p[1]):
                yes, no = yes + math.log(share[1, j, v]), no + math.log(share[0, j, v])
            post[p] = 1 / (1 + math.exp(min(50, max(-50, no - yes))))
    return post


def train(patterns: dict[tuple[str, tuple[int, ...]], int], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple, float]:
    """Logistic weights of (kind,) and (labeler, vote) features, fitted to the EM posteriors, each pattern weighing the log of its count."""
    post = estimate(patterns)
    weights: dict[tuple, float] = {}
    features = {p: [("kind", p[0]), *((name, v) for name, v in zip(LABELERS, p[1], strict=True))] for p in patterns}
    mass = {p: math.log1p(c) for p, c in patterns.items()}
    total = sum(mass.values()) or 1.0
    for _ in range(steps):
        slope: dict[tuple, float] = {}
        for p, names in features.items():
            z = sum(weights.get(f, 0.0) for f in names)
            miss = mass[p] / total * (post[p] - 1 / (1 + math.exp(-z)))
            for f in names:
                slope[f] = slope.get(f, 0.0) + miss
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) * (1 - rate * decay) + 8 * rate * g
    return weights


def _score(span: Column, weights: dict[tuple, float]) -> Column:
    z = F.lit(0.0)
    for (name, value), w in sorted(weights.items(), key=str):
        has = span["kind"] == value if name == "kind" else F.get(span["votes"], LABELERS.index(name)) == value
        z = z + F.when(has, F.lit(float(w))).otherwise(F.lit(0.0))
    return z


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``base`` and ``spans``: sorted arrays of struct<start, end, rank, kind>."""
    staged = stage(candidates(docs, keep), "candidates")
    every = staged.select(F.explode(F.concat(*ALL_KINDS)).alias("s"))
    counts = every.groupBy("s.kind", "s.votes").count().collect()
    return accept(staged, train({(r["kind"], tuple(r["votes"])): r["count"] for r in counts}))


def accept(staged: DataFrame, weights: dict[tuple, float]) -> DataFrame:
    def plain(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"))

    rows = computed(staged, ("_kept", *ALL_KINDS), **{f"_{k}": F.filter(k, lambda s: s["base"]) for k in KINDS})
    base = F.concat(*(F.transform(f"_{k}", plain) for k in KINDS))
    touched = " OR ".join(meets(f"_{k}", "s.start + 1", "s.end - 1") for k in KINDS)
    rows = computed(rows, ("_kept", *KINDS, *(f"_{k}" for k in KINDS)), **{k: F.expr(f"filter({k}, s -> NOT ({touched}))") for k in WEAK_PATTERNS})
    added = [F.transform(F.filter(k, lambda s: _score(s, weights) > 0), plain) for k in (WEAK_PATTERNS if weights else ())]
    return computed(rows, ("_kept",), base=F.sort_array(base), spans=F.sort_array(F.concat(base, *added))).select("_kept.*", "base", "spans")


def digest(found: DataFrame) -> DataFrame:
    counts = [count_kind("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redact(text: str, spans: str) -> Column:
    """The text with each span replaced by <KIND>; of overlapping spans the first stands, and the others' rest goes with it."""
    upto = "CASE WHEN i > 0 THEN get(reached, i - 1) ELSE 0 END"
    piece = let("upto", upto, f"CASE WHEN s.start >= upto THEN concat({stretch('chunks', 'upto', 's.start')}, '<', upper(s.kind), '>') ELSE '' END")
    whole = f"concat(array_join(transform({spans}, (s, i) -> {piece}), ''), {stretch('chunks', 'element_at(reached, -1)', f'length({text})')})"
    done = let("chunks", chunks_of(text), let("ends", f"transform({spans}, e -> e.end)", let("reached", running("ends", "greatest({a}, {x})"), whole)))
    return F.expr(f"CASE WHEN size({spans}) > 0 THEN {done} ELSE {text} END")
