r"""Personal data in text, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards,
mod-97 for account numbers, part and digit ranges for the rest), and words
near a span move its score: those within ``CONTEXT_CHARS`` before and after it,
up to the next match of its kind. Positions are code points: the matches of a
pattern and the pieces between them (``split`` by the same pattern) alternate,
so running lengths give every start. Running values are taken in blocks, and
text is cut out of short pieces, so that time follows the text and its matches.

Base kinds, always kept when confirmed: email, ip, card, phone. The method
adds ``iban`` (mod-97) and ``local_phone`` (a national number, only kept
where a context word lifts its score to ``MIN_SCORE``).

The patterns' possessive quantifiers and look-behinds change no match (what
follows a run is never in its class, and a match starts at a run's start or
where the last one ended); they keep time linear and the stack flat.

Defined cases: null or empty text has no spans; rows are independent, so null
or repeated ids and ties keep one row each; an empty table gives no rows;
other columns pass through (``__*`` names are the operator's own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fixed, read_table

# Fixed values.
BASE = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![A-Za-z0-9+.-])\(?0?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![A-Za-z0-9.-])",
}
#: Cheap tests, true wherever the pattern has a confirmed match.
GUARDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.contains("+") & t.rlike(r"\+[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "local_phone": lambda t: t.rlike(r"[0-9]{2}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3}"),
}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "local_phone": "phone|call|tel|fax|mobile",
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.3}
CONTEXT_CHARS, CONTEXT_GAIN, MIN_SCORE = 32, 0.3, 0.5
#: Elements of a block of running values, code points of a piece of text.
BLOCK, PIECE = 64, 1024
_FAR = 2**31 - 1
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    """Every second digit from the right is doubled, nines cast out of it."""
    digits = F.transform(F.split(F.reverse(_digits(c)), ""), lambda d: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)),
        F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def _mod97(c: Column) -> Column:
    """Country and check digits go last, letters become 10 to 35."""
    flat = F.replace(c, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda ch: ch != ""), F.lit(0),
        lambda a, ch: F.when(ch.between("0", "9"), (a * 10 + F.ascii(ch) - 48) % 97).otherwise((a * 100 + F.ascii(ch) - 55) % 97))
    return rest == 1


def _confirmed(kind: str, c: Column) -> Column:
    n = F.length(_digits(c))
    if kind == "ip":
        # leading zeros aside, no part has over three digits and none is above 255
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(c, r"\."), lambda p: F.coalesce(F.when(F.length(bare(p)) <= 3, F.concat(F.lit("0"), bare(p)).cast("int")), F.lit(999)) <= 255)
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), _luhn(c)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.replace(c, F.lit(" "), F.lit(""))).between(15, 34) & _mod97(c)
    if kind == "local_phone":
        return n.between(9, 11)
    return F.lit(True)


def _running(values: Column, op, start: int) -> Column:
    """``op`` of each element of an array of ints and all before it. Appending
    copies an array, so this goes by blocks, then over the blocks' ends."""
    append = lambda a, x: F.concat(a, F.array(op(F.coalesce(F.get(a, F.size(a) - 1), F.lit(start)), x)))
    none = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.aggregate(F.slice(values, i * BLOCK + 1, BLOCK), none, append))
    one = F.struct(blocks.alias("blocks"))
    # a struct in an array of one keeps the blocks from being computed for each use
    whole = F.transform(F.array(one), lambda b: F.struct(b["blocks"].alias("blocks"),
        F.aggregate(F.transform(b["blocks"], lambda x: F.get(x, F.size(x) - 1)), none, append).alias("ends")))
    joined = F.transform(whole, lambda b: F.flatten(F.transform(b["blocks"], lambda x, i: F.transform(x, lambda v: op(v, F.coalesce(F.get(b["ends"], i - 1), F.lit(start)))))))
    return F.when(F.size(values) > 0, F.get(joined, 0)).otherwise(none)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _scored(kind: str) -> Column:
    """Confirmed spans of one kind, in order, of its matches, the text between
    them and the matches' ends."""
    hits, gaps, ends = (F.col(f"__{x}_{kind}") for x in ("hits", "gaps", "ends"))

    def span(i: Column) -> Column:
        hit = F.get(hits, i)
        near = lambda text: F.lower(text).rlike(rf"\b(?:{CONTEXT[kind]})")
        gain = F.when(near(F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS))) | near(F.left(F.get(gaps, i + 1), F.lit(CONTEXT_CHARS))), CONTEXT_GAIN).otherwise(0.0)
        end = F.get(ends, i)
        return F.struct((end - F.length(hit)).alias("start"), F.lit(list(PATTERNS).index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"),
            F.least(F.lit(PRIOR[kind]) + gain, F.lit(1.0)).alias("score"))

    sure = F.filter(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: _confirmed(kind, F.get(hits, i)))
    spans = F.transform(sure, span)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= MIN_SCORE)
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans`` added: (start, rank, end, kind, score), sorted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.drop("spans")
    none = F.array().cast("array<string>")
    out = fixed(out, {f"__may_{k}": F.coalesce(GUARDS[k](text), F.lit(False)) for k in PATTERNS})
    raw = {f"__hits_{k}": F.when(F.col(f"__may_{k}"), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in PATTERNS}
    out = fixed(out, raw | {f"__gaps_{k}": F.when(F.col(f"__may_{k}"), F.split(text, PATTERNS[k], -1)).otherwise(none) for k in PATTERNS})
    steps = lambda k: F.transform(f"__hits_{k}", lambda m, i: F.length(F.get(F.col(f"__gaps_{k}"), i)) + F.length(m))
    out = fixed(out, {f"__steps_{k}": steps(k) for k in PATTERNS})
    out = fixed(out, {f"__ends_{k}": _running(F.col(f"__steps_{k}"), _sum, 0) for k in PATTERNS})
    out = fixed(out, {"__base": F.concat(*(_scored(k) for k in BASE)), "__own": F.concat(*(_scored(k) for k in PATTERNS if k not in BASE))})
    out = fixed(out.drop(*(f"__{x}_{k}" for x in ("may", "hits", "gaps", "steps", "ends") for k in PATTERNS)), {"__all": F.array_sort(F.concat("__base", "__own"))})
    # what the method adds gives way to base spans that it overlaps (cards aside): the
    # furthest end of those that start before it, and the start of the next one, tell
    solid = lambda s: (s["rank"] < len(BASE)) & (s["kind"] != "card")
    some = F.size("__own") > 0
    values = lambda x, name, other: F.when(some, F.transform(x, lambda s: F.when(solid(s), s[name]).otherwise(other))).otherwise(F.array().cast("array<int>"))
    out = fixed(out, {"__upto": values(F.col("__all"), "end", -1), "__from": values(F.reverse("__all"), "start", _FAR)})
    out = fixed(out, {"__upto": _running(F.col("__upto"), F.greatest, -1), "__from": F.reverse(_running(F.col("__from"), F.least, _FAR))})
    free = lambda s, i: (F.coalesce(F.get(F.col("__upto"), i - 1), F.lit(-1)) <= s["start"]) & (F.coalesce(F.get(F.col("__from"), i + 1), F.lit(_FAR)) >= s["end"])
    spans = F.when(some, F.filter("__all", lambda s, i: (s["rank"] < len(BASE)) | free(s, i))).otherwise(F.col("__all"))
    return fixed(out, {"spans": spans}).drop("__base", "__own", "__all", "__upto", "__from")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; of
    overlapping spans the first stands for both."""
    found = find_pii(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = fixed(found, {"__upto": F.transform("spans", lambda s: s["end"]),
        "__pieces": F.when(F.size("spans") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))})
    found = fixed(found, {"__upto": _running(F.col("__upto"), F.greatest, 0)})

    def cut(start: Column, end: Column | None) -> Column:
        """The text from ``start`` to ``end`` (None: to its end)."""
        first = F.floor(start / PIECE).cast("int")
        some = F.size("__pieces") if end is None else F.floor((end - 1) / PIECE).cast("int") - first + 1
        near = F.array_join(F.slice("__pieces", first + 1, F.greatest(some, F.lit(0))), "")
        return F.substr(near, start % PIECE + 1, *(() if end is None else (end - start,)))

    before = lambda i: F.coalesce(F.get(F.col("__upto"), i - 1), F.lit(0))
    parts = F.transform("spans", lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(before(i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(""))
    clean = F.when(F.size("spans") == 0, F.col(text_col)).otherwise(F.concat(F.array_join(parts, ""), cut(before(F.size("spans")), None)))
    names = found.drop("__upto", "__pieces").columns
    return fixed(found, {text_col: clean}).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(_joined(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"))
