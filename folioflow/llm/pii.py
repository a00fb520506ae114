"""Personal data: exact base spans, and weakly supervised further ones. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import text_of, without, written

#: Base patterns, written so that a long run cannot be re-scanned or overflow the matcher's stack: repetitions are
#: possessive where nothing that follows could use what they took, and a run is entered at its start alone.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Candidates of the weak labelers. Runs are possessive or bounded for the same reason, and none is cut at a length.
LOOSE = {
    "handle": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{2,}+ ?(?:\.|[\[(]dot[\])]) ?[a-z]{2,12}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "local": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "abroad": r"(?<![0-9+().-])00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,5}){2,5}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? [A-ZÄÖÜÉÑ][a-zäöüßéèñ]++(?:[ -][A-ZÄÖÜÉÑ][a-zäöüßéèñ]++){0,2}",
    "secret": r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}+={0,2}(?:\.[A-Za-z0-9+/_-]{8,}+){0,2}|(?<=(?:password|passwd|pwd|secret)(?: is)? ?[:=]? ?[\"']?)[^\s\"']{6,}+)",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "street": r"(?<![A-Za-z0-9])[0-9]{1,5}[A-Za-z]? (?:[A-Z][a-z]++ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Square|Terrace)(?![A-Za-z])",
}
#: Cheap tests without which a text has no candidate of the kind.
_MAY = {
    "handle": r"(?i)[\[(]at[\])]", "iban": r"[A-Z]{2}[0-9]{2}", "ipv6": r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:", "local": "[0-9]{3}[ .-][0-9]{4}", "abroad": "00[1-9]",
    "name": r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? ", "secret": r"(?i)[a-z0-9+/_-]{20}|passw|pwd|secret", "ssn": "-[0-9]{2}-",
    "street": r"[0-9][A-Za-z]? [A-Z][a-z]",
}
KINDS = [*BASE, *LOOSE]
#: Fixed word lists of the gazetteer and context labelers.
GAZETTEER = (
    r"(?i)(?<![a-z0-9])(?:com|org|net|edu|gov|io|de|fr|es|uk|gmail|mail|yahoo|outlook|hotmail|example|212|213|310|312|415|617|718|800"
    r"|GB\d\d|DE\d\d|FR\d\d|ES\d\d|NL\d\d|IT\d\d|2001|fe80|0044|0049|0033|0034|main|high|park|church|oak|first|second|john|mary|smith|jones|müller|garcia|martin"
    r"|AKIA[a-z0-9]*|ASIA[a-z0-9]*|gh[pousr]_[a-z0-9]*|sk-[a-z0-9_-]*|sk_live_[a-z0-9]*|xox[abprs]-[a-z0-9-]*|eyJ[a-z0-9_-]*)(?![a-z0-9])"
)
#: Cue words by what they announce; which group stands before a span is also a feature of the span classifier.
CUE_GROUPS = {
    "contact": "call|tel|phone|fax|mobile|cell|contact|mail|e-mail|email|reach|write",
    "person": "ssn|social|security|name|born|passport|patient|customer|address|lives|street|sincerely|dear",
    "payment": "card|visa|iban|account|bank|pay|transfer|number",
    "access": "password|passwd|pwd|secret|token|key|api|apikey|credential|bearer|auth|login",
    "network": "ip|ipv6|host|server|ping|gateway|dns",
}
ANTI_CUES = r"(?i)\b(?:order|invoice|version|isbn|issn|serial|part|sku|doi|build|commit|sha|md5|checksum|id|ref|page|section|figure|table|score)\b"
LABELERS = ("regex", "gazetteer", "context", "shape", "plain", "company")
#: Code points before a span that count as its context, and to either side within which another span is company.
CONTEXT, COMPANY = 32, 200
#: Matches of a text that are walked in one go.
BLOCK = 128
ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more", "n_spans")


def _cues(group: str) -> str:
    return rf"(?i)(?<![a-z])(?:{CUE_GROUPS[group]})(?![a-z])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str, may: Column) -> Column:
    """Array of (s, e, m, left): code-point spans and texts of all leftmost matches and what stands before them, from the pieces between them.

    Matches are walked in blocks of ``BLOCK``: within one, and over the blocks' lengths, lists grow, so the work is that of the text and
    of ``BLOCK`` a match until the blocks themselves are many thousands.
    """
    last = lambda c: F.right(c, F.lit(CONTEXT))

    def step(acc: Column, x: Column) -> Column:
        s, left = acc["at"] + F.length(x["g"]), last(F.concat(acc["tail"], last(x["g"])))
        e = s + F.length(x["m"])
        span = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), left.alias("left"))
        return F.struct(e.alias("at"), last(F.concat(left, last(x["m"]))).alias("tail"), F.array_append(acc["out"], span).alias("out"))

    def walk(pairs: Column, start: Column) -> Column:
        return F.aggregate(pairs, F.struct(start["at"].alias("at"), start["tail"].alias("tail"), _none().alias("out")), step, lambda acc: acc["out"])

    def block(pairs: Column) -> Callable[[Column], Column]:
        def measured(b: Column) -> Column:
            piece = F.array_join(F.flatten(F.transform(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)), lambda x: F.array(x["g"], x["m"]))), "")
            return let(piece, lambda p: F.struct(F.length(p).alias("n"), last(p).alias("tail")))

        return measured

    def next_start(acc: Column, x: Column) -> Column:
        end = F.element_at(acc, -1)
        return F.array_append(acc, F.struct((end["at"] + x["n"]).alias("at"), last(F.concat(end["tail"], x["tail"])).alias("tail")))

    def in_blocks(pairs: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
        first = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")))
        starts = F.aggregate(F.transform(blocks, block(pairs)), first, next_start)
        return let(starts, lambda at: F.flatten(F.transform(blocks, lambda b: walk(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)), F.get(at, b)))))

    def of(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("g"), found.alias("m"))
        spans = let(pairs, lambda p: F.when(F.size(p) <= BLOCK, walk(p, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")))).otherwise(in_blocks(p)))
        return F.when(F.size(found) > 0, spans).otherwise(_none())

    return F.when(may, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<s:int,e:int,m:string,left:string>>")


def meets(spans: Column, x: Column) -> Column:
    """Whether ``x`` overlaps one of ``spans``, which lie apart and in order: a binary search for the last that starts before its end."""
    bounds = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["low"] + acc["high"], 1)
        open_, up = acc["low"] < acc["high"], F.coalesce(F.get(spans, mid)["s"] < x["e"], F.lit(False))
        return F.struct(F.when(open_ & up, mid + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~up, mid).otherwise(acc["high"]).alias("high"))

    at = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(spans)))), bounds, halve, lambda acc: acc["low"])
    return F.coalesce(F.get(spans, at - 1)["e"] > x["s"], F.lit(False))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.when(F.length(_digits(m)).between(16, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    may = {"email": text.contains("@"), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    test = lambda k: lambda x: _passes(k, x["m"])
    return {k: F.filter(located(text, p, may[k]), test(k)) for k, p in BASE.items()}


def iban_holds(m: Column) -> Column:
    """The check digits of an account number: its digits, letters counted from 10, leave 1 when divided by 97."""
    bare = F.upper(F.replace(m, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _strict(kind: str, m: Column) -> Column:
    """The narrow pattern of a loose kind; base kinds have passed theirs."""
    return {
        "handle": m.rlike(r"(?i)[\[(]at[\])].*[\[(]dot[\])]"),
        "iban": iban_holds(m),
        "ipv6": m.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | (m.contains("::") & m.rlike("[0-9]")),
        "local": m.rlike(r"^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}"),
        "abroad": F.length(_digits(m)).between(11, 15),
        "name": m.rlike(r"^\S+ \S+[ -]\S+"),
        "secret": m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(r"(?:[/_-][A-Za-z]+){3}"),
        "ssn": m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"),
        "street": m.rlike(r"(?:Street|Avenue|Road|Lane|Drive|Boulevard)$"),
    }.get(kind, F.lit(True))


def _shape(kind: str, m: Column) -> Column:
    """Whether a span looks drawn rather than written out: no single digit repeated, and a secret's signs change class often."""
    if kind == "secret":
        return F.length(F.regexp_replace(m, "[A-Za-z]+|[0-9]+", "x")) * 5 >= F.length(m)
    return ~_digits(m).rlike(r"^([0-9])\1{3,}$")


def _votes(kind: str, x: Column) -> Column:
    """The labelers' votes on a span as bits, but for the last labeler's; above them its length class (2 bits) and the cue group before it (3 bits)."""
    m = x["m"]
    left = x["left"]
    group = F.lit(0)
    for i, g in reversed(list(enumerate(CUE_GROUPS, 1))):
        group = F.when(left.rlike(_cues(g)), i).otherwise(group)
    bits = [_strict(kind, m), m.rlike(GAZETTEER), group > 0, _shape(kind, m), ~left.rlike(ANTI_CUES)]
    length = F.when(F.length(m) < 12, 0).when(F.length(m) < 20, 1).otherwise(2)
    n = len(LABELERS)
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0)) + length * (1 << n) + group * (1 << (n + 2))


def aggregate_votes(counts: dict[tuple[int, int], int], rounds: int = 60, pull: float = 20.0) -> dict[tuple[int, int], float]:
    """Expectation-maximisation over (kind, votes) patterns: the chance that a span of a pattern is personal data.

    Two latent classes. Each labeler has a rate of voting for spans of either, for each kind on its own but pulled by ``pull`` spans towards
    its rate over all kinds, and is taken to be no worse than chance; each kind has a share of true spans. Spans of the base kinds,
    which passed exact tests, are known to be true. Starts from the share of votes. Patterns are taken in order, so that sums do
    not depend on how they arrived.
    """
    n, order = len(LABELERS), sorted(counts)
    bits = {p: [(p[1] >> j) & 1 for j in range(n)] for p in order}
    post = {p: 0.98 if p[0] < len(BASE) else 0.02 + 0.96 * sum(b) / n for p, b in bits.items()}
    of_kind = {k: [p for p in order if p[0] == k] for k in sorted({p[0] for p in order})}

    def rates(patterns: list[tuple[int, int]], true: bool, prior: list[float], weight: float) -> list[float]:
        mass = {p: counts[p] * (post[p] if true else 1 - post[p]) for p in patterns}
        total = sum(mass.values())
        return [(sum(m * bits[p][j] for p, m in mass.items()) + weight * prior[j]) / (total + weight) for j in range(n)]

    for _ in range(rounds if order else 0):
        every = [rates(order, true, [0.5] * n, 2.0) for true in (True, False)]
        for k, mine in of_kind.items():
            if k < len(BASE):
                continue
            share = (sum(counts[p] * post[p] for p in mine) + 1) / (sum(counts[p] for p in mine) + 2)
            hit, false = (rates(mine, true, rate, pull) for true, rate in zip((True, False), every, strict=True))
            new = {}
            for p in mine:
                odds = math.log(share / (1 - share))
                for j, vote in enumerate(bits[p]):
                    if hit[j] > false[j]:
                        odds += math.log(hit[j] / false[j]) if vote else math.log((1 - hit[j]) / (1 - false[j]))
                new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            post |= new
    return post


def features(kind: int, votes: int) -> list[float]:
    """Constant, votes, length class, cue group before the span, kind."""
    n = len(LABELERS)
    length, group = (votes >> n) & 3, votes >> (n + 2)
    return [
        1.0, *(float((votes >> j) & 1) for j in range(n)), *(float(length == k) for k in (1, 2)), *(float(group == k) for k in range(1, len(CUE_GROUPS) + 1)),
        *(float(kind == k) for k in range(1, len(KINDS))),
    ]


def train_spans(counts: dict[tuple[int, int], int], post: dict[tuple[int, int], float], rounds: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Logistic span classifier on the posteriors as soft labels; one example a pattern, weighted by its count.

    A kind's patterns weigh as much as any other kind's, so that a kind that is frequent does not drown the rest.
    """
    kinds: dict[int, int] = {}
    for (k, _), c in counts.items():
        kinds[k] = kinds.get(k, 0) + c
    w = [0.0] * len(features(0, 0))
    data = [([(i, v) for i, v in enumerate(features(*p)) if v], post[p], c / kinds[p[0]] / len(kinds)) for p, c in sorted(counts.items())]
    for _ in range(rounds):
        grad = [ridge * x for x in w]
        for x, y, c in data:
            err = c * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] * v for i, v in x))))) - y)
            for i, v in x:
                grad[i] += err * v
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, n_spans`` over whole texts.

    One pass finds the base spans (always kept) and the loose candidates outside them (obfuscated addresses, account numbers,
    IPv6, national and foreign telephone numbers, titled names, secrets and keys, social security numbers, streets), with the votes of six labelers:
    strict pattern or check digits, gazetteer, context cue, shape, absence of contrary cues, company of other spans. The votes of all spans
    in all documents are counted by pattern (some hundred sums, whatever the input); expectation-maximisation estimates the labelers' reliabilities from them,
    and a logistic span classifier is trained on the posteriors. Candidates that it gives ``least`` or more join ``spans``
    under their kinds, which sort after the base kinds; ``n_more`` counts them, ``n_spans`` all.

    Defined cases: null and empty texts have no spans (the digest is that of the empty string); ids are not looked at, so null and
    repeated ones pass through; columns named like an added one are replaced; an empty table gives an empty result.
    """
    base = without(docs, *ADDED, *[f"__{k}" for k in KINDS], "__spans", "__t")
    keep = [c for c in base.columns if c != text_col] or [id_col]
    rows = base.select(*[F.col(f"`{c}`") for c in keep], text_of(text_col).alias("__t"))
    t = F.col("__t")
    spans = base_spans(t)
    for k, c in spans.items():
        rows = rows.withColumn(f"__{k}", c)

    def clear(x: Column) -> Column:
        apart = F.lit(True)
        for k in BASE:
            apart = apart & ((F.size(f"__{k}") == 0) | ~meets(F.col(f"__{k}"), x))
        return apart

    for k, p in LOOSE.items():
        rows = rows.withColumn(f"__{k}", F.filter(located(t, p, t.rlike(_MAY[k])), clear))

    def voted(k: str) -> Column:
        parts = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(k)).alias("k"), _votes(k, x).alias("v"))
        return F.transform(F.col(f"__{k}"), parts)

    def with_company(x: Column, i: Column) -> Column:
        """In order of their starts, a span's company is the one before or the one after it."""
        before, after = F.get(F.col("__spans"), i - 1), F.get(F.col("__spans"), i + 1)
        near = F.coalesce(before["e"] + COMPANY > x["s"], F.lit(False)) | F.coalesce(after["s"] < x["e"] + COMPANY, F.lit(False))
        return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), (x["v"] + F.when(near, 1 << (len(LABELERS) - 1)).otherwise(0)).alias("v"))

    names = [F.col(f"`{c}`") for c in keep]
    found = rows.select(*names, F.array_sort(F.concat(*[voted(k) for k in KINDS])).alias("__spans"))
    found = written(found.select(*names, F.transform("__spans", with_company).alias("__spans")), "pii-spans")
    counts = {(r["k"], r["v"]): r["n"] for r in found.select(F.explode("__spans").alias("x")).groupBy(F.col("x.k").alias("k"), F.col("x.v").alias("v")).agg(F.count("*").alias("n")).collect()}
    w = train_spans(counts, aggregate_votes(counts))
    accepted = {p for p in counts if p[0] >= len(BASE) and 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, features(*p), strict=True)))) >= least}
    codes = F.array(*[F.lit((k << 16) | v) for k, v in sorted(accepted)]).cast("array<int>")
    taken = lambda x: is_base(x) | F.array_contains(codes, F.shiftleft(x["k"], 16).bitwiseOR(x["v"]))
    ordered = F.array_sort(F.transform("__spans", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))))
    is_base = lambda x: x["k"] < len(BASE)
    name = F.array(*map(F.lit, KINDS))
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    out = found.withColumn("__spans", F.filter(ordered, taken))
    of_kind = lambda i: lambda x: x["k"] == i
    counted = [F.size(F.filter("__spans", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select(
        *[F.col(f"`{c}`") for c in keep], *counted,
        F.sha2(line(F.filter("__spans", is_base)), 256).alias("base_sha256"),
        line(F.col("__spans")).alias("spans"),
        F.size(F.filter("__spans", lambda x: ~is_base(x))).cast("long").alias("n_more"),
        F.size("__spans").cast("long").alias("n_spans"),
    )
