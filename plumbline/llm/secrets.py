"""Secret scans with multipart credential linking.

Strong spans (``assign``, ``access``, ``hex``) are reported wherever they match. Three weak kinds are only evidence:
``identifier`` (an assigned key id, client id, user or account), ``secret40`` (a bare 40-character base-64 run) and
``endpoint`` (a URL). They are joined by interval: parts belong together if no more than ``WINDOW`` code points and no
blank line lie between them. A weak identifier is reported beside a secret, a weak secret beside an identifier, an
endpoint beside both. The join is a sweep over the sorted spans of a text, forward and backward, by running maxima of
where the last identifier, secret and blank line ended: near linear in the spans, no pairs, no shuffle, no Python.

Defined results: a null text counts as empty and has no spans; equal texts have equal spans; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import let, text_or_empty

KINDS = ("assign", "access", "hex", "identifier", "secret40", "endpoint")
STRONG = 3
WINDOW = 240

#: Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN, MIN_ACCESS = 12, 18

IDENTIFIER = r"""(?<![A-Za-z0-9])(?i:access_?key_?id|client_?id|user(?:_?name)?|account(?:_?id)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}+"""
SECRET40 = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""(?<![A-Za-z0-9+.-])(?i:[a-z][a-z0-9+.-]{1,15})://[^\s"'<>\x01-\x04]{4,}"""
BLANK = r"\n[\x20\t\r]*\n"

#: Which spans are parts of which sort.
IDENTIFIERS, SECRETS = (1, 3), (0, 2, 4)
SCOPE = len(KINDS)


def strong_spans(text: Column) -> Column:
    """assign, access and hex spans of an ``unmarked`` text. A run of hex of 16 or more is what ``[0-9a-f]+`` leaves after short runs are dropped."""
    assign = S.matches(text, ASSIGN, 0, keep=lambda m, rest: F.length(rest) >= MIN_ASSIGN, inner=True)
    access = F.when(F.contains(text, F.lit("AKIA")), S.matches(text, ACCESS, 1, keep=lambda m, rest: F.length(m) >= MIN_ACCESS)).otherwise(S.no_spans())
    return F.concat(assign, access, S.matches(text, HEX, 2))


def weak_spans(text: Column) -> Column:
    endpoint = F.when(F.contains(text, F.lit("://")), S.matches(text, ENDPOINT, 5)).otherwise(S.no_spans())
    return F.concat(S.matches(text, IDENTIFIER, 3), S.matches(text, SECRET40, 4), endpoint)


def _sweep(items: Column, forward: bool) -> Column:
    """For items in order, whether an identifier and a secret precede within the window and scope.

    Running maxima give where the last identifier, secret and break before each item ended. Spans never hold a break, so
    a part that ended no later than the last break is out of the item's scope.
    """
    far = -(1 << 30)
    edge = lambda x: x["e"] if forward else -x["s"]

    def last(kinds: tuple) -> Column:
        return S.running_max(F.transform(items, lambda x: F.when(x["k"].isin(*kinds), edge(x)).otherwise(F.lit(far))))

    def hits(b: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            near = x["s"] if forward else -x["e"]
            holds = lambda name: F.coalesce((near - F.get(b[name], i - 1) <= WINDOW) & (F.get(b[name], i - 1) > F.get(b["scope"], i - 1)), F.lit(False))
            return F.struct(holds("i").alias("i"), holds("c").alias("c"))

        return F.transform(items, one)

    return let(F.struct(last(IDENTIFIERS).alias("i"), last(SECRETS).alias("c"), last((SCOPE,)).alias("scope")), hits)


def linked(strong: Column, weak: Column, breaks: Column) -> Column:
    """The weak spans that complementary parts support. Breaks are spans of kind ``SCOPE``."""

    def join(items: Column) -> Column:
        back = F.reverse(_sweep(F.reverse(items), False))
        near = F.zip_with(_sweep(items, True), back, lambda f, b: F.struct((f["i"] | b["i"]).alias("i"), (f["c"] | b["c"]).alias("c")))
        both = F.zip_with(items, near, lambda x, n: F.struct(x.alias("x"), n.alias("n")))
        holds = F.filter(both, lambda r: ((r["x"]["k"] == 3) & r["n"]["c"]) | ((r["x"]["k"] == 4) & r["n"]["i"]) | ((r["x"]["k"] == 5) & r["n"]["i"] & r["n"]["c"]))
        return F.transform(holds, lambda r: r["x"])

    return let(S.in_order(F.concat(strong, weak, breaks)), join)


def scan(text: Column) -> Column:
    """struct(base, spans) of a text: strong spans, and all that are reported, both in order."""

    def of(t: Column) -> Column:
        def joined(f: Column) -> Column:
            more = F.when(F.size(f["weak"]) == 0, S.no_spans()).otherwise(linked(f["strong"], f["weak"], S.matches(t, BLANK, SCOPE)))
            base = S.in_order(f["strong"])
            return F.struct(base.alias("base"), F.when(F.size(f["weak"]) == 0, base).otherwise(S.in_order(F.concat(f["strong"], more))).alias("spans"))

        return let(F.struct(strong_spans(t).alias("strong"), weak_spans(t).alias("weak")), joined)

    return let(S.unmarked(text_or_empty(text)), of)


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = docs.select("doc_id", scan(F.col("text")).alias("f"))
    return rows.select(
        "doc_id",
        *[S.count_of(F.col("f.base"), k).alias(f"n_{KINDS[k]}") for k in range(STRONG)],
        S.digest(F.col("f.base"), KINDS).alias("base_sha256"),
        S.listed(F.col("f.spans"), KINDS).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every reported span of the text replaced by its kind; a null text stays null, and n_chars follows the text."""
    out = docs.withColumn("text", F.when(F.col("text").isNull(), F.lit(None)).otherwise(S.redacted(F.col("text"), scan(F.col("text"))["spans"], KINDS)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
