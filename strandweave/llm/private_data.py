"""Personal data by weak supervision, in built-in functions only.

Candidates are spans of strict and of looser patterns.  Labelers vote 1, 0 (abstain) or -1 on each: the
pattern's own validator, a gazetteer (top-level domains, country codes, issuer digits, given names), the
words before it, and its borders (which only speak against).  The votes' patterns are counted over all documents (at most kinds x 3^4
rows), expectation-maximisation estimates each labeler's reliability from those counts, and a
logistic span classifier is trained on the posteriors.  Spans of the strict patterns that pass their checks stay
whatever it says, and those that fail them stay out; other candidates are added when it gives them ``threshold``
or more.

Null and empty texts have no spans.  Rows are kept one by one; no shuffle but that of the vote counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spans import digits, joined, luhn, spans

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ident", "person")
VOTERS = ("check", "gazetteer", "context", "border")
#: What is held of a labeler beforehand: right in so many of its votes, believed like half as many votes as were counted.
PRIOR_RIGHT, PRIOR_SHARE, PRIOR_LEAST = 0.9, 0.5, 10

STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"\b[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,4}+",
    "phone": r"(?<![0-9+.()-])(?<![0-9+)]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-])",
    "ident": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-ZÀ-Þ][a-zß-ÿ]{1,30}(?:\x20[A-ZÀ-Þ][a-zß-ÿ]{1,30})?",
}
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ch|at|mx|ca)$",
    "phone": r"^\+(?:1|33|34|41|43|44|49|52)[\x20(.-]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "ip": r"^(?!0|127\.|255\.)",
    "person": r"\b(?:Anna|Maria|John|James|Mary|Peter|Paul|Hans|Karl|Jean|Marie|Pierre|Luis|Carlos|Juan|Carmen|David|Michael|Thomas|Laura)\b",
}
# Numbering rules for the loose patterns' kinds.
LOOSE_GAZETTEER = GAZETTEER | {
    "phone": r"^\(?[2-9][0-9]{2}\W{1,2}[2-9]",
    "ident": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|kontakt|correo|courriel)\W{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|kontakt|contact|móvil|téléphone|telefon)\W{0,12}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta)\W{0,12}$",
    "ip": r"(?i)(?:\bip|address|host|server|from)\W{0,12}$",
    "ident": r"(?i)(?:ssn|social security|identity|id|passport)\W{0,12}$",
    "person": r"(?i)(?:dear|name|signed|by|from|liebe|cher|chère|querida?)\W{0,12}$",
}
AGAINST = r"(?i)(?:version|isbn|issn|chapter|page|figure|section|no|nr|v)[.:#]?\x20*$"


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return x["m"].rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        d = digits(x["m"])
        return (F.length(d) <= 19) & luhn(d)
    if kind == "phone":
        return F.length(digits(x["m"])).between(9, 15)
    return F.lit(True)


def candidates(text: Column) -> Column:
    """Array of spans with ``base``, ``check``, ``gazetteer``, ``context``, ``border`` and ``size``."""

    def judged(kind: str, found: Column, strict: bool) -> Column:
        known = (GAZETTEER if strict else LOOSE_GAZETTEER)[kind]

        def judge(x: Column) -> Column:
            good = _valid(kind, x) if strict else F.lit(False)
            vote = lambda yes, no=None: F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)
            return F.struct(
                x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), good.alias("base"),
                (F.when(good, 1).otherwise(-1) if strict else F.lit(0)).alias("check"),
                vote(x["m"].rlike(known), ~x["m"].rlike(known)).alias("gazetteer"),
                vote(x["b"].rlike(CONTEXT[kind]), x["b"].rlike(AGAINST)).alias("context"),
F.when(x["b"].rlike(r"[A-Za-z0-9]$") | x["a"].rlike("^[A-Za-z0-9]"), -1).otherwise(0).alias("border"),
                F.least(F.lit(3), F.expr("0") + (F.length(x["m"]) / 8).cast("int")).alias("size"),
            )

        return F.transform(found, judge)

    arrays = [judged(k, spans(k, text, p), True) for k, p in STRICT.items()] + [judged(k, spans(k, text, p), False) for k, p in LOOSE.items()]
    some = text.rlike(r"[0-9@]|\[at\]|\(at\)|\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señora?)\b")
    return F.when(some, F.concat(*arrays)).otherwise(F.expr("cast(array() as array<struct<kind:string,s:int,e:int,base:boolean,check:int,gazetteer:int,context:int,border:int,size:int>>)"))


def fit_reliabilities(counts: dict[tuple, int], rounds: int = 60) -> dict[tuple, float]:
    """Posterior of each (kind, votes) by EM over a model of two equal classes: for each kind and labeler how often it
    votes for and against spans of either class.  A labeler that abstains says nothing.

    The first posteriors are the majority's.  A span that fails its kind's check is certainly none and says nothing of
    the other labelers.  What is held of labelers beforehand weighs in proportion to the counts, so results don't depend
    on the number of documents; the classes' shares aren't estimated, as kinds with few labelers would drift to one.
    """
    open_ = {k: n for k, n in counts.items() if k[1] >= 0}
    post = dict.fromkeys(counts, 0.0) | {k: (lambda s: 0.9 if s > 0 else 0.1 if s < 0 else 0.5)(sum(k[1:])) for k in open_}
    slots = {(k[0], j) for k in open_ for j in range(1, 1 + len(VOTERS)) if k[j]}
    for _ in range(rounds):
        weight, against = {}, {}  # log odds that a vote for, or one against, adds
        for kind, j in slots:
            own = [(k[j] > 0, n, post[k]) for k, n in open_.items() if k[0] == kind and k[j]]
            held = max(PRIOR_LEAST, PRIOR_SHARE * sum(n for _, n, _ in own))
            share = []  # of votes for, among spans of class 0 and 1
            for c in (0, 1):
                yes = sum(n * (p if c else 1 - p) for vote, n, p in own if vote) + held * (PRIOR_RIGHT if c else 1 - PRIOR_RIGHT)
                share.append(yes / (held + sum(n * (p if c else 1 - p) for _, n, p in own)))
            weight[kind, j] = math.log(share[1] / share[0])
            against[kind, j] = math.log((1 - share[1]) / (1 - share[0]))
        new = {k: 1 / (1 + math.exp(-sum((weight if v > 0 else against)[k[0], j] for j, v in enumerate(k[1:], 1) if v))) for k in open_}
        moved, post = max((abs(new[k] - post[k]) for k in new), default=0), post | new
        if moved < 1e-6:
            break
    return post


def _features(k: tuple) -> list[str]:
    return ["bias", f"kind={k[0]}", *(f"{v}={x}" for v, x in zip((*VOTERS, "size"), k[1:]))]


def fit_classifier(rows: list[tuple[tuple, int, float]], rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Logistic weights by gradient descent on counted (features, count, posterior) rows."""
    w: dict[str, float] = {}
    total = sum(n for _, n, _ in rows) or 1
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for k, n, p in rows:
            score = 1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in _features(k))))
            for f in _features(k):
                grad[f] = grad.get(f, 0.0) + n / total * (score - p)
        for f, g in grad.items():
            w[f] = w.get(f, 0.0) - rate * (g + decay * w.get(f, 0.0))
    return w


def fit(found: DataFrame, column: str = "_found") -> dict[str, float]:
    """Vote counts over the candidates of all documents, EM on them, and the classifier's weights (bounded, on the driver)."""
    rows = found.select(F.explode(column).alias("x")).select("x.*")
    rows = rows.groupBy("kind", *VOTERS, "size").count().collect()  # at most kinds x 3^4 x 4 rows
    votes: dict[tuple, int] = {}
    for r in rows:
        votes[tuple(r[:5])] = votes.get(tuple(r[:5]), 0) + r["count"]
    post = fit_reliabilities(votes)
    return fit_classifier([(tuple(r[:6]), r["count"], post[tuple(r[:5])]) for r in rows])


def find(docs: DataFrame, text: str = "text", threshold: float = 0.8, weights: dict[str, float] | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``base`` and ``all`` spans: arrays of (kind, s, e), by kind as in ``KINDS``, then start.
    Columns of ``docs`` with these names are replaced; one named ``_found`` is dropped.

    Without ``weights`` they are fitted on these documents: candidates are then found once and written, with the
    texts or, without ``keep_text``, beside the other columns alone.
    """
    out = docs.withColumn("_found", candidates(F.col(text)))
    out = out if keep_text else out.drop(text)
    if weights is None:
        out = written(out, "private-candidates")
        weights = fit(out)

    def score(x: Column) -> Column:
        total = F.lit(weights.get("bias", 0.0))
        for name in ("kind", *VOTERS, "size"):
            known = [(f.split("=", 1)[1], w) for f, w in sorted(weights.items()) if f.startswith(f"{name}=")]
            for value, w in known:
                total = total + F.when(x[name].cast("string") == value, w).otherwise(0.0)
        return total

    cut = math.log(threshold / (1 - threshold))
    place = {k: i for i, k in enumerate(KINDS)}

    def ordered(kept: Column) -> Column:
        rank = lambda x: F.coalesce(*[F.when(x["kind"] == k, i) for k, i in place.items()])
        keyed = F.transform(kept, lambda x: F.struct(rank(x).alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
        return F.transform(F.array_sort(F.array_distinct(keyed)), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    base = ordered(F.filter("_found", lambda x: x["base"]))
    # An added span that overlaps a base span of its kind says nothing new.
    fresh = lambda x: ~F.exists("_found", lambda y: y["base"] & (y["kind"] == x["kind"]) & (y["s"] < x["e"]) & (x["s"] < y["e"]))
    kept = ordered(F.filter("_found", lambda x: x["base"] | ((x["check"] >= 0) & (score(x) >= cut) & fresh(x))))
    none = F.expr("cast(array() as array<struct<kind:string,s:int,e:int>>)")
    return out.withColumns({"base": F.coalesce(base, none), "all": F.coalesce(kept, none)}).drop("_found")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans and the list of all spans."""
    n = [F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *n, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def masked(found: DataFrame, text: str = "text") -> DataFrame:
    """``text`` with every span replaced by ``<KIND>``; overlapping spans become one, named by the first."""
    order = F.array_sort(F.transform("all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    zero = F.expr("cast(named_struct('pos', 0, 'out', array()) as struct<pos:int,out:array<string>>)")

    def step(acc: Column, x: Column) -> Column:
        new = x["s"] >= acc["pos"]
        piece = F.array(F.substring(F.col(text), acc["pos"] + 1, x["s"] - acc["pos"]), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.struct(F.greatest(x["e"], acc["pos"]).alias("pos"), F.when(new, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(F.col(text), acc["pos"] + 1, F.length(text)))), "")
    return found.withColumn(text, F.when(F.size("all") > 0, F.aggregate(order, zero, step, end)).otherwise(F.col(text)))
