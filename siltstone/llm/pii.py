"""Personal data by weak supervision, in native Spark expressions only.

Candidates are the four base kinds plus wider patterns (spelled-out mail
addresses, local telephone numbers, national identity numbers, bank accounts).
Texts are searched once; candidates are written to the shared folder and counted, judged and
masked from there.  Five labelers vote on each candidate: strict format, gazetteer, positive
context, negative context, boundary.  All votes of the corpus are counted by
pattern (a bounded table, whatever the input); expectation-maximisation over
these counts estimates each labeler's reliability and each pattern's chance of
being personal data; a logistic span classifier is trained on those chances over the
votes and over features of the span itself (length, share of digits, separators, capitals), and
decides, as a column expression, which of the wider candidates join the base spans.  Base spans always stay.

Positions are running sums over the pieces around the matches, and masking joins pieces
of the text; both go by blocks, so a text with very many spans stays near linear.  Patterns are
possessive and anchored at run starts, so a long run of one character does too.

Defined results: a null or empty text has no spans; very long texts are searched whole; repeated rows give
equal rows; spans of different kinds may overlap and all count, a wider one that touches a base span does not;
masking replaces overlapping spans by one mark, of the span that starts first (the longest, then the first
listed kind, on ties); an empty corpus leaves the classifier at its prior; extra columns are untouched,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import stored

_USER = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
#: kind -> (cheap test, pattern, must hold of the match)
BASE = {
    "email": ("@", rf"(?:\G|(?<!{_USER})){_USER}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    "ip": (None, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9]){12,}+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WIDER = {
    "mail": (None, r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{2,64}+ ?[\[(](?:at|@)[\])] ?[A-Z0-9-]{2,63}+(?: ?[\[(](?:dot|\.)[\])] ?[A-Z0-9-]{2,63}+){1,5}"),
    "tel": (None, r"(?<![0-9+(.-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /.-])[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}+(?![0-9])"),
    "ident": (None, r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": (None, r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
}
KINDS = [*BASE, *WIDER]
LABELERS = ("format", "gazetteer", "context", "contrary", "boundary")
#: Features of a span itself and their number of levels.
FEATURES = {"length": 5, "digits": 4, "separators": 4, "capitals": 2}

#: Gazetteers and cues (fixed values).
_TLDS = ["com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "de", "fr", "es", "it", "uk", "eu", "nl", "ch", "at", "be", "pl", "us", "ca", "au", "jp", "in", "br", "mx"]
_DIAL = "1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|3[57][0-9]|42[0-9]|88[06]|9[679][0-9]"
_IBAN_LANDS = ["AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
_CUES = {
    "email": "mail|contact|write|address", "mail": "mail|contact|write|address", "ip": r"\bip\b|address|host|server|login|client",
    "card": "card|visa|credit|payment|paid|account", "phone": r"phone|\btel|call|mobile|fax|whatsapp", "tel": r"phone|\btel|call|mobile|fax|whatsapp",
    "ident": r"ssn|social|security|tax|ident", "iban": r"iban|bank|account|transfer",
}
_CONTRARY = r"(?i)(?:version|build|release|isbn|issn|doi|invoice|order|ticket|sku|serial|part|section|figure|chapter)\W{0,3}(?:no\W{0,2}|number\W{0,2}|#)?$"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once even inside lambdas."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column], block: int = 64, levels: int = 3) -> Column:
    """Running totals of an array: within blocks, then over the blocks' totals in the same way."""
    def plain(some: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(some, none, lambda acc, x: F.concat(acc, F.array(join(F.coalesce(F.get(acc, F.size(acc) - 1), zero), x))))

    def blocked(all_: Column, left: int) -> Column:
        if left == 1:
            return plain(all_)
        starts = F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(block))
        parts = F.transform(starts, lambda at: plain(F.slice(all_, at + 1, F.lit(block))))
        return _let(parts, lambda p: _let(
            blocked(F.transform(p, lambda x: F.coalesce(F.get(x, F.size(x) - 1), zero)), left - 1),
            lambda before: F.flatten(F.transform(p, lambda x, i: F.transform(x, lambda v: join(F.when(i == 0, zero).otherwise(F.get(before, i - 1)), v)))),
        ))

    return _let(values, lambda v: F.when(F.size(v) <= block, plain(v)).otherwise(blocked(v, levels)))


_FIELDS = "start:int,end:int,kind:int,value:string,before:string,after:string"
_SPAN = f"array<struct<{_FIELDS}>>"


def _matches(text: Column, kind: str, cheap: str | None, pattern: str) -> Column:
    """Array of (start, end, kind number, value, before, after) of all matches."""
    found = _let(
        F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")),
        lambda s: _let(
            # pieces and matches alternate: where each match ends
            running(F.zip_with(s["parts"], s["hits"], lambda p, h: F.length(p) + F.coalesce(F.length(h), F.lit(0))), F.lit(0), lambda x, y: x + y),
            lambda ends: F.transform(
                s["hits"],
                lambda hit, i: F.struct(
                    (F.get(ends, i) - F.length(hit)).alias("start"),
                    F.get(ends, i).alias("end"),
                    F.lit(KINDS.index(kind)).alias("kind"),
                    hit.alias("value"),
                    F.right(F.get(s["parts"], i), F.lit(40)).alias("before"),
                    F.substring(F.get(s["parts"], i + 1), 1, 12).alias("after"),
                ),
            ),
        ),
    )
    here = text.contains(cheap) if cheap else text.rlike(pattern)
    return F.when(here, found).otherwise(F.array().cast(_SPAN))


def _luhn(digits: Column) -> Column:
    reverse = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + _let(
            F.substring(reverse, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a base kind passes its check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "tel":
        return F.length(digits).between(9, 12)
    return F.lit(True)


def candidates(text: Column) -> Column:
    """All candidates of a text by start: base spans, and wider ones that touch none of them."""
    def holds(kind: str, m: Column) -> Column:
        return _holds(kind, m["value"])

    def of(kinds: dict) -> Column:
        return F.concat(*[F.filter(_matches(text, k, *v), partial(holds, k)) for k, v in kinds.items()])

    def apart(all_: Column) -> Column:
        """Without wider spans that start before an earlier base span's end, or end behind a later one's start."""
        far = F.lit((1 << 31) - 1)
        reach = running(F.transform(all_, lambda s: F.when(s["kind"] < len(BASE), s["end"]).otherwise(0)), F.lit(0), F.greatest)
        ahead = F.reverse(running(F.reverse(F.transform(all_, lambda s: F.when(s["kind"] < len(BASE), s["start"]).otherwise(far))), far, F.least))
        return _let(F.struct(reach.alias("reach"), ahead.alias("ahead")), lambda z: F.filter(
            all_, lambda s, i: (s["kind"] < len(BASE)) | (F.get(z["reach"], i) <= s["start"]) & (F.get(z["ahead"], i) >= s["end"])
        ))

    return _let(
        F.struct(of(BASE).alias("base"), of(WIDER).alias("wider")),
        # of equal starts the base spans come first, so ``reach`` covers them
        lambda z: F.when(F.size(z["wider"]) == 0, F.array_sort(z["base"])).otherwise(_let(_by_start(z["base"], z["wider"]), apart)),
    )


def _by_start(base: Column, wider: Column) -> Column:
    keyed = F.transform(F.concat(base, wider), lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"], s["before"], s["after"]))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"], s["before"], s["after"]))


def _case(kind: Column, cases: dict[str, Column], default: Column) -> Column:
    return reduce(lambda c, k: c.when(kind == k, cases[k]), list(cases)[1:], F.when(kind == next(iter(cases)), cases[next(iter(cases))])).otherwise(default)


def votes(c: Column) -> list[Column]:
    """The five labelers on a candidate: 1 for, -1 against, 0 no opinion."""
    kind, value = F.element_at(F.array(*map(F.lit, KINDS)), c["kind"] + 1), c["value"]
    vote = lambda yes, no=None: (F.when(yes, 1) if no is None else F.when(yes, 1).when(no, -1)).otherwise(0)
    digits = F.regexp_replace(value, "[^0-9]", "")
    tld = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    return [
        _case(kind, {
            "email": vote(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@.*\.[A-Za-z]{2,}$"), ~value.rlike("[A-Za-z]")),
            "ip": vote(value.rlike(r"^[1-9][0-9]{0,2}\."), value.rlike(r"^0|\.0[0-9]")),
            "card": vote(F.length(digits).between(15, 16)),
            "phone": vote(value.rlike(r"[\x20().-]")),
            "tel": vote(value.rlike(r"^\(|^0[0-9]{2,4}[ /-]")),
            "ident": vote(~value.rlike("-00-|-0000$"), value.rlike("-00-|-0000$")),
            "iban": vote(F.length(F.regexp_replace(value, " ", "")).between(15, 34)),
        }, vote(F.lit(True))),
        _case(kind, {
            "email": vote(tld.isin(_TLDS)), "mail": vote(tld.isin(_TLDS), ~tld.isin(_TLDS)),
            "ip": vote(~value.rlike(r"^(?:10|127|0|255)\.|^192\.168\.|^169\.254\."), value.rlike(r"^(?:127|0|255)\.")),
            "card": vote(value.rlike("^(?:4|5[1-5]|3[47]|6011|65|2[2-7])")),
            "phone": vote(value.rlike(rf"^\+(?:{_DIAL})")),
            "ident": vote(F.lit(False), value.rlike("^(?:000|666|9)")),
            "iban": vote(F.substring(value, 1, 2).isin(_IBAN_LANDS), ~F.substring(value, 1, 2).isin(_IBAN_LANDS)),
        }, vote(F.lit(False))),
        _case(kind, {k: vote(c["before"].rlike(f"(?i){p}")) for k, p in _CUES.items()}, F.lit(0)),
        vote(F.lit(False), c["before"].rlike(_CONTRARY)),
        vote(~(c["before"].rlike(r"[A-Za-z0-9_./=-]$") | c["after"].rlike(r"^[A-Za-z0-9_/=-]|^\.[A-Za-z0-9]")),
             c["before"].rlike(r"[A-Za-z0-9_./=-]$") | c["after"].rlike(r"^[A-Za-z0-9_/=-]|^\.[A-Za-z0-9]")),
    ]


def features(c: Column) -> list[Column]:
    """Levels of a span's own features, in the order of FEATURES."""
    size = F.length(c["value"])
    digits = F.length(F.regexp_replace(c["value"], "[^0-9]", ""))
    separators = F.length(F.regexp_replace(c["value"], r"[^\x20./()\[\]-]", ""))
    return [
        F.least(F.floor(size / 8), F.lit(4)).cast("int"), F.floor(3 * digits / size).cast("int"),
        F.least(separators, F.lit(3)).cast("int"), c["value"].rlike("[A-Z]").cast("int"),
    ]


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> dict[tuple[str, tuple[int, ...]], float]:
    """Chance of each (kind, votes) pattern to be personal data, by expectation-maximisation.

    Labelers are taken as independent given the truth; each has a chance of
    every vote for true and for false spans, each kind its share of true ones.
    """
    n = len(LABELERS)
    table = {y: [{v: (0.7 if v == y else 0.1 if v == -y else 0.2) for v in (-1, 0, 1)} for _ in range(n)] for y in (1, -1)}
    share = {k: 0.9 if k in BASE else 0.5 for k in KINDS}
    belief: dict = {}
    for _ in range(rounds):
        for kind, pattern, _n in counts:
            yes = math.log(share[kind]) + sum(math.log(table[1][j][v]) for j, v in enumerate(pattern))
            no = math.log(1 - share[kind]) + sum(math.log(table[-1][j][v]) for j, v in enumerate(pattern))
            belief[kind, pattern] = 1 / (1 + math.exp(min(700.0, no - yes)))
        for j in range(n):
            for y in (1, -1):
                # pseudo-counts keep the roles of true and false apart
                mass = {v: 8.0 * (0.7 if v == y else 0.1 if v == -y else 0.2) for v in (-1, 0, 1)}
                for kind, pattern, seen in counts:
                    b = belief[kind, pattern]
                    mass[pattern[j]] += seen * (b if y == 1 else 1 - b)
                total = sum(mass.values())
                table[y][j] = {v: m / total for v, m in mass.items()}
        for kind in KINDS:
            rows = [(belief[k, p], seen) for k, p, seen in counts if k == kind]
            prior = 9.0 if kind in BASE else 5.0
            share[kind] = (prior + sum(b * s for b, s in rows)) / (10.0 + sum(s for _, s in rows))
    return belief


def train_classifier(counts: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], steps: int = 400) -> dict[str, float]:
    """Logistic weights over kinds, votes and span features, fitted to the estimated chances.

    ``counts`` has (kind, votes, feature levels, number of spans).
    """
    votes_only: dict[tuple[str, tuple[int, ...]], int] = {}
    for kind, pattern, _, n in counts:
        votes_only[kind, pattern] = votes_only.get((kind, pattern), 0) + n
    belief = estimate([(k, p, n) for (k, p), n in sorted(votes_only.items())])
    names = [*KINDS, *LABELERS, *(f"{f}{level}" for f, levels in FEATURES.items() for level in range(levels))]
    # the prior as one pseudo-record each: full agreement is true, full contradiction is not
    rows = [(k, (y,) * len(LABELERS), None, 1.0, float(y > 0)) for y in (1, -1) for k in KINDS]
    rows += [(k, p, f, math.sqrt(n), belief[k, p]) for k, p, f, n in counts]
    x = np.zeros((len(rows), len(names)))
    for i, (kind, pattern, levels, _, _) in enumerate(rows):
        x[i, names.index(kind)] = 1
        x[i, len(KINDS) : len(KINDS) + len(LABELERS)] = pattern
        if levels is not None:
            for f, level in zip(FEATURES, levels, strict=True):
                x[i, names.index(f"{f}{level}")] = 1
    share = np.array([r[3] for r in rows])
    share /= share.sum()
    target = np.array([r[4] for r in rows])
    weights = np.zeros(len(names))
    # a feature is weaker evidence than a vote: it is held closer to zero
    ridge = np.where(np.arange(len(names)) < len(KINDS) + len(LABELERS), 1e-3, 1e-2)
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(x @ weights, -60, 60))) - target) * share
        weights -= 2.0 * (x.T @ error + ridge * weights)
    return dict(zip(names, weights.tolist(), strict=True))


def fit(found: DataFrame, col: str = "found") -> dict[str, float]:
    """Count the vote and feature patterns of all candidates and train the classifier on them."""
    each = found.select(F.explode(col).alias("c"))
    columns = [v.cast("int").alias(n) for n, v in zip((*LABELERS, *FEATURES), [*votes(F.col("c")), *features(F.col("c"))], strict=True)]
    # at most kinds x 3^labelers x levels rows, far fewer in fact
    seen = each.select(F.col("c.kind").alias("kind"), *columns).groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n"))
    rows = [(KINDS[r.kind], tuple(r[n] for n in LABELERS), tuple(r[f] for f in FEATURES), r.n) for r in seen.collect()]
    return train_classifier(sorted(rows))


def accepted(found: Column, weights: dict[str, float], threshold: float = 0.9) -> Column:
    """The base spans among candidates, and the wider ones that the classifier accepts."""
    def keeps(c: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [v * F.lit(weights[n]) for n, v in zip(LABELERS, votes(c), strict=True)])
        margin += F.element_at(F.array(*[F.lit(weights[k]) for k in KINDS]), c["kind"] + 1)
        for (name, levels), value in zip(FEATURES.items(), features(c), strict=True):
            margin += F.element_at(F.array(*[F.lit(weights[f"{name}{n}"]) for n in range(levels)]), value + 1)
        return (c["kind"] < len(BASE)) | (margin >= math.log(threshold / (1 - threshold)))

    return F.filter(found, keeps)


def _joined(found: Column) -> Column:
    """kind:start:end of spans by kind as listed, then start, joined by commas."""
    named = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(
    df: DataFrame, weights: dict[str, float] | None = None, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per record: id, counts by base kind, n_added, base_sha256, spans, values (in the order of spans)."""
    all_ = candidates(F.coalesce(F.col(text_col), F.lit("")))
    kept = stored(df.select(F.col(id_col).alias("id"), all_.alias("found")), "candidates")
    found = kept.select("id", accepted(F.col("found"), weights or fit(kept), threshold).alias("found"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda n: F.size(F.filter("found", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        F.col("id").alias(id_col), *[count(n).alias(f"n_{k}") for n, k in enumerate(BASE)],
        F.size(F.filter("found", lambda s: s["kind"] >= len(BASE))).cast("long").alias("n_added"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.transform(
            F.array_sort(F.transform("found", lambda s: F.struct(s["kind"], s["start"], s["value"].alias("value")))), lambda s: s["value"]
        ).alias("values"),
    )


def masked(text: Column, found: Column, chunk: int = 1024) -> Column:
    """``text`` with every span of ``found`` replaced by ``<KIND>``; overlapping spans make one mark."""
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    # by start, the longest first
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    reach = lambda o: running(F.transform(o, lambda s: -s["back"]), F.lit(0), F.greatest)

    def groups(o: Column, r: Column) -> Column:
        """(start, end, kind) of each run of overlapping spans."""
        first = F.filter(
            F.transform(o, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["kind"].alias("kind"))),
            lambda s: (s["i"] == 0) | (s["start"] >= F.get(r, s["i"] - 1)),
        )
        return _let(first, lambda f: F.transform(f, lambda s, j: F.struct(
            s["start"].alias("start"), F.get(r, F.coalesce(F.get(f, j + 1)["i"], F.size(o)) - 1).alias("end"), s["kind"].alias("kind")
        )))

    def built(chunks: Column, g: Column) -> Column:
        def piece(low: Column, high: Column) -> Column:
            at = F.floor(low / chunk).cast("int")
            some = F.array_join(F.slice(chunks, at + 1, F.floor(high / chunk).cast("int") - at + 1), "")
            return F.substring(some, low - at * chunk + 1, high - low)

        end = lambda j: F.when(j == 0, 0).otherwise(F.get(g, j - 1)["end"])
        heads = F.transform(g, lambda s, j: F.concat(piece(end(j), s["start"]), F.element_at(kinds, s["kind"] + 1)))
        return F.concat(F.array_join(heads, ""), piece(end(F.size(g)), F.length(text)))

    marked = _let(ordered, lambda o: _let(reach(o), lambda r: _let(groups(o, r), lambda g: _let(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)), lambda chunks: built(chunks, g)
    ))))
    return F.when(F.size(found) == 0, text).otherwise(marked)


def mask_pii(df: DataFrame, weights: dict[str, float] | None = None, threshold: float = 0.9, text_col: str = "text") -> DataFrame:
    """``df`` with the personal data of its text masked; all columns stay."""
    names = [f"c{i}" for i in range(len(df.columns))]
    own = names[df.columns.index(text_col)]
    rows = df.toDF(*names)
    kept = stored(rows.withColumn("found", candidates(F.coalesce(F.col(own), F.lit("")))), "candidates")
    spans = accepted(F.col("found"), weights or fit(kept), threshold)
    kept = kept.withColumn("found", spans)
    return kept.select(*[masked(F.col(own), F.col("found")).alias(c) if c == own else F.col(c) for c in names]).toDF(*df.columns)
