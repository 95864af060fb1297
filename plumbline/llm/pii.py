"""Personal data by candidate gradient boosting.

Base spans (email, ip, card, phone) are strict patterns with validity checks; they are always reported. Beside them,
generators of high recall propose overlapping candidates: written-out or odd addresses (``x_mail``), any long number with
separators (``x_number``), any code of capitals and digits (``x_code``). A candidate is described by small whole numbers on
its format and context, a checksum among them, and boosted trees of depth two judge it.

No labels for personal data exist, so examples are made. A candidate is positive if it overlaps a valid base span or passes
a check that the base patterns don't hold: an address once its ``(at)`` and ``(dot)`` are put back, the account number's
remainder by 97. Base spans are also shown masked, as they would look where their pattern misses them: a phone number
without its plus, an address written out. So a span that no base pattern finds can be positive; as such spans in the text
count as negative, a form is reported only while it is much rarer than its masked likeness.

The examples come from all documents, dealt by hash into halves. One half fits the trees; the other calibrates, per
generator, the lowest score at which at least ``PRECISION`` of the examples are positive.
Candidates from there on are reported unless a base span overlaps them; a generator without enough evidence reports nothing.
Examples reach the driver only as counts by feature vector, at most
``VECTORS`` of them by the features' ranges. Base spans, candidates and scores are expressions over every whole text: no
shuffle of texts, no Python on the executors.

Defined results: a null text counts as empty and has no spans; without examples the generators report nothing; equal texts
have equal spans; very long texts take time nearly linear in their candidates; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import let, text_or_empty

KINDS = ("email", "ip", "card", "phone", "x_mail", "x_number", "x_code")
BASE = 4

#: Fixed patterns of the base kinds; possessive and bounded on the left so that long runs are read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

AT, DOT = r"\x20?(?:\((?i:at)\)|\[(?i:at)\])\x20?", r"\x20?(?:\((?i:dot)\)|\[(?i:dot)\])\x20?"
X_MAIL = rf"(?<![\p{{L}}0-9._%+-])[\p{{L}}0-9._%+-]++(?:\x20?@\x20?|{AT})[\p{{L}}0-9-]++(?:(?:\x20?\.\x20?|{DOT})[\p{{L}}0-9-]++)++"
X_NUMBER = r"(?<![A-Za-z0-9_])[+(]{0,2}[0-9][0-9\x20().,/-]{5,}[0-9]"
X_CODE = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9])++(?![A-Za-z0-9])"
CONTEXT = r"(?i:mail|phone|tel|call|fax|mobile|contact|card|visa|iban|account|ssn|passport|ip|host|address)"

ROUNDS, RATE, SMOOTH = 24, 0.3, 1.0
PRECISION, LEAST = 0.9, 20

#: Feature -> its largest value; values start at 0.
FEATURES = {"kind": 6, "digits": 20, "length": 8, "separators": 5, "lead": 3, "left": 3, "right": 3, "context": 1, "check": 1}
VECTORS = math.prod([3, *(v + 1 for k, v in FEATURES.items() if k != "kind")])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def remainder_97(code: Column) -> Column:
    """Whether an account number passes its check: its first four characters moved to the end, letters as 10 to 35, modulo 97 is 1."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)) == 1


def checked(kind: Column, match: Column, digits: Column) -> Column:
    """Whether a candidate passes the check of its kind."""
    back = F.regexp_replace(F.regexp_replace(match, AT, "@"), DOT, ".")
    code = F.translate(match, " ", "")
    return (
        F.when(kind == 4, back.rlike(f"^(?:{EMAIL})$"))
        .when(kind == 5, F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False))
        .otherwise(F.when(F.length(code).between(15, 34), remainder_97(code)).otherwise(False))
    )


def _ip_holds(m: Column, _: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def _card_holds(m: Column, _: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))


def _phone_holds(m: Column, _: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def base_spans(text: Column) -> Column:
    """email, ip, card and phone spans of an ``unmarked`` text, by kind and start."""
    email = F.when(F.contains(text, F.lit("@")), S.matches(text, EMAIL, 0)).otherwise(S.no_spans())
    phone = F.when(F.contains(text, F.lit("+")), S.matches(text, PHONE, 3, keep=_phone_holds)).otherwise(S.no_spans())
    return F.concat(email, S.matches(text, IP, 1, keep=_ip_holds), S.matches(text, CARD, 2, keep=_card_holds), phone)


def candidates(text: Column) -> Column:
    at = F.contains(text, F.lit("@")) | F.contains(F.lower(text), F.lit("(at)")) | F.contains(F.lower(text), F.lit("[at]"))
    mail = F.when(at, S.matches(text, X_MAIL, 4, body=True)).otherwise(S.no_spans())
    return F.concat(mail, S.matches(text, X_NUMBER, 5, body=True), S.matches(text, X_CODE, 6, body=True))


def _sort_of(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}0-9]"), 2).otherwise(3)


def described(text: Column, found: Column) -> Column:
    """The candidates with their features."""

    def all_of(pieces: Column) -> Column:
        def one(x: Column) -> Column:
            def with_digits(d: Column) -> Column:
                m = x["b"]
                first = F.substring(m, 1, 1)
                values = {
                    "kind": x["k"],
                    "digits": F.least(F.length(d), F.lit(20)),
                    "length": F.least(F.floor(F.length(m) / 4), F.lit(8)),
                    "separators": F.least(F.length(F.regexp_replace(m, r"[\p{L}0-9]", "")), F.lit(5)),
                    "lead": F.when(first == "+", 0).when(first == "(", 1).when(first.rlike("[0-9]"), 2).otherwise(3),
                    "left": _sort_of(S.taken(pieces, F.greatest(x["s"] - 1, F.lit(0)), x["s"])),
                    "right": _sort_of(S.taken(pieces, x["e"], x["e"] + 1)),
                    "context": S.taken(pieces, F.greatest(x["s"] - 32, F.lit(0)), x["s"]).rlike(CONTEXT).cast("int"),
                    "check": checked(x["k"], m, d).cast("int"),
                }
                return F.struct(x["s"].alias("s"), x["e"].alias("e"), *[v.cast("int").alias(k) for k, v in values.items()])

            return let(_digits(x["b"]), with_digits)

        return F.transform(found, one)

    return let(S.chunks(text), all_of)


def _example(x: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(k, x[k]).cast("int").alias(k) for k in FEATURES])


def examples(found: Column, touched: Column) -> Column:
    """struct(y, x) of each candidate, and once more of each that a base span holds, masked as if its pattern missed it."""
    judged = F.zip_with(found, touched, lambda x, t: F.struct((t | ((x["kind"] != 5) & (x["check"] == 1))).alias("y"), t.alias("t"), x.alias("x")))

    def all_of(rows: Column) -> Column:
        plain = F.transform(rows, lambda r: F.struct(r["y"].alias("y"), _example(r["x"]).alias("x")))
        phones = F.filter(rows, lambda r: r["t"] & (r["x"]["kind"] == 5) & (r["x"]["lead"] == 0))
        mails = F.filter(rows, lambda r: r["t"] & (r["x"]["kind"] == 4))
        shorter = lambda x: {"lead": F.lit(2), "length": F.least(F.floor((x["e"] - x["s"] - 1) / 4), F.lit(8)), "separators": F.when(x["separators"] < 5, x["separators"] - 1).otherwise(5)}
        bare = F.transform(phones, lambda r: F.struct(F.lit(True).alias("y"), _example(r["x"], **shorter(r["x"])).alias("x")))
        spelled = F.transform(mails, lambda r: F.struct(F.lit(True).alias("y"), _example(r["x"], separators=F.lit(5), length=F.least(r["x"]["length"] + 2, F.lit(8))).alias("x")))
        return F.concat(plain, bare, spelled)

    return let(judged, all_of)


class Boosted:
    """Trees of depth two over whole-number features, fitted to counts of positives and negatives by feature vector."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]]):
        names = list(FEATURES)
        pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.start = math.log((pos + SMOOTH) / (neg + SMOOTH))
        self.trees: list = []
        margin = [self.start] * len(rows)
        for _ in range(ROUNDS if pos and neg else 0):
            p = [1 / (1 + math.exp(-m)) for m in margin]
            grad = [r[1] - (r[1] + r[2]) * q for r, q in zip(rows, p, strict=True)]
            hess = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(rows, p, strict=True)]

            def value(ids: list[int], grad=grad, hess=hess) -> float:
                return RATE * sum(grad[i] for i in ids) / (sum(hess[i] for i in ids) + SMOOTH)

            def split(ids: list[int], grad=grad, hess=hess) -> tuple | None:
                g, h = sum(grad[i] for i in ids), sum(hess[i] for i in ids)
                best = (1e-6, None)
                for f in range(len(names)):
                    sums: dict[int, list[float]] = {}
                    for i in ids:
                        s = sums.setdefault(rows[i][0][f], [0.0, 0.0])
                        s[0] += grad[i]
                        s[1] += hess[i]
                    a = b = 0.0
                    for v in sorted(sums)[:-1]:
                        a, b = a + sums[v][0], b + sums[v][1]
                        gain = a * a / (b + SMOOTH) + (g - a) ** 2 / (h - b + SMOOTH) - g * g / (h + SMOOTH)
                        if gain > best[0]:
                            best = (gain, (f, v))
                return best[1]

            def grow(ids: list[int], depth: int):
                at = split(ids) if depth else None
                if at is None:
                    return value(ids)
                low = [i for i in ids if rows[i][0][at[0]] <= at[1]]
                high = [i for i in ids if rows[i][0][at[0]] > at[1]]
                return (*at, grow(low, depth - 1), grow(high, depth - 1))

            tree = grow(list(range(len(rows))), 2)
            self.trees.append(tree)
            margin = [m + self._walk(tree, r[0]) for m, r in zip(margin, rows, strict=True)]

    def _walk(self, tree, x: tuple[int, ...]) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x: tuple[int, ...]) -> float:
        return self.start + sum(self._walk(t, x) for t in self.trees)

    def column(self, x: Column) -> Column:
        """The score of a struct of features."""
        names = list(FEATURES)

        def node(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(x[names[tree[0]]] <= tree[1], node(tree[2])).otherwise(node(tree[3]))

        return sum((node(t) for t in self.trees), F.lit(float(self.start)))


def cutoffs(model: Boosted, rows: list[tuple[tuple[int, ...], float, float]]) -> dict[int, float]:
    """Per generator, the lowest score that is positive often enough among held-out candidates; absent if none is.

    Shares of positives by score are made monotone by pooling neighbours, so a cutoff rests on the candidates about it
    and not on surer ones far above.
    """
    out = {}
    for kind in range(BASE, len(KINDS)):
        pools: list[list[float]] = []  # positives, all, lowest score
        for s, p, n in sorted(((model.score(x), p, n) for x, p, n in rows if x[0] == kind), reverse=True):
            pools.append([p, p + n, s])
            while len(pools) > 1 and (pools[-1][2] == pools[-2][2] or pools[-1][0] * pools[-2][1] >= pools[-2][0] * pools[-1][1]):
                p, n, s = pools.pop()
                pools[-1] = [pools[-1][0] + p, pools[-1][1] + n, s]
        held = [x for x in pools if x[0] >= PRECISION * x[1]]
        if sum(x[1] for x in held) >= LEAST:
            out[kind] = held[-1][2]
    return out


def fit(docs: DataFrame) -> tuple[Boosted, dict[int, float]]:
    """Trees and cutoffs learned from the two halves of all documents."""
    fits = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("fits")

    def of(t: Column) -> Column:
        both = F.struct(S.in_order(base_spans(t)).alias("base"), described(t, S.in_order(candidates(t))).alias("found"))
        return let(both, lambda f: F.when(F.size(f["found"]) > 0, examples(f["found"], S.touches(f["found"], f["base"]))))

    rows = docs.select(fits, let(S.unmarked(text_or_empty(F.col("text"))), of).alias("e"))
    # outer, as for an inner one Spark would evaluate the examples once more in a filter before it
    rows = rows.select("fits", F.explode_outer("e").alias("r")).filter("r is not null")
    counted = rows.groupBy("fits", "r.y", *[F.col(f"r.x.{k}").alias(k) for k in FEATURES]).agg(F.count(F.lit(1)).alias("c")).collect()
    sides: dict[bool, dict] = {True: {}, False: {}}
    for r in counted:
        sides[bool(r["fits"])].setdefault(tuple(r[k] for k in FEATURES), [0.0, 0.0])[0 if r["y"] else 1] += r["c"]
    first, second = (sorted((x, p, n) for x, (p, n) in sides[k].items()) for k in (True, False))
    model = Boosted(first)
    return model, cutoffs(model, second)


def scan(text: Column, model: Boosted, least: dict[int, float]) -> Column:
    """struct(base, spans) of a text, both by start and kind."""

    def of(t: Column) -> Column:
        def wanted(x: Column) -> Column:
            low = F.lit(float("inf"))
            for kind, score in least.items():
                low = F.when(x["kind"] == kind, F.lit(float(score))).otherwise(low)
            return model.column(x) >= low - 1e-9

        def chosen(base: Column) -> Column:
            def with_more(found: Column) -> Column:
                free = F.zip_with(found, S.touches(found, base), lambda x, t: F.when(~t & wanted(x), F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("k"), F.lit("").alias("b"))))
                return S.in_order(F.concat(base, F.array_compact(free).cast(S.SPANS)))

            every = let(described(t, S.in_order(candidates(t))), lambda found: F.when(F.size(found) == 0, base).otherwise(with_more(found)))
            return F.struct(base.alias("base"), (every if least else base).alias("spans"))

        return let(S.in_order(base_spans(t)), chosen)

    return let(S.unmarked(text_or_empty(text)), of)


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = docs.select("doc_id", scan(F.col("text"), *fit(docs)).alias("f"))
    return rows.select(
        "doc_id",
        *[S.count_of(F.col("f.base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        S.digest(F.col("f.base"), KINDS).alias("base_sha256"),
        S.listed(F.col("f.spans"), KINDS).alias("spans"),
    )
