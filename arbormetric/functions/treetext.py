"""Bracket text such as ``a(b,c(d))`` as column expressions, one row at a time and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels hold no comma, blank or bracket; commas and blanks separate.
TOKEN = r"[^,\s()]+|[()]"


def tree_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def tree_check(tokens: Column) -> Column:
    """``struct(ok, roots, first)``: balance, number of roots, tokens of the first root."""

    def step(state: Column, token: Column) -> Column:
        opens, closes = token == "(", token == ")"
        label = ~(opens | closes)
        root = label & (state["depth"] == 0)
        roots = state["roots"] + root.cast("int")
        return F.struct(
            (state["depth"] + opens.cast("int") - closes.cast("int")).alias("depth"),
            roots.alias("roots"),
            (
                state["bad"]
                | (opens & ~state["label"])
                | (closes & (state["depth"] <= 0))
            ).alias("bad"),
            label.alias("label"),
            (state["first"] + (roots <= 1).cast("int")).alias("first"),
        )

    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(0).alias("roots"),
        F.lit(False).alias("bad"),
        F.lit(False).alias("label"),
        F.lit(0).alias("first"),
    )
    return F.aggregate(
        tokens,
        start,
        step,
        lambda s: F.struct(
            ((s["depth"] == 0) & ~s["bad"] & (s["roots"] > 0)).alias("ok"),
            s["roots"].alias("roots"),
            s["first"].alias("first"),
        ),
    )


def canonical_tree(tokens: Column) -> Column:
    """One text per structure: commas between siblings, no blanks, no empty brackets."""
    joined = F.array_join(tokens, " ")
    for old, new in ((" ( ", "("), (" )", ")"), ("()", ""), ("( ", "("), (" ", ",")):
        joined = F.replace(joined, F.lit(old), F.lit(new))
    return joined


def tree_reference(canonical: Column) -> Column:
    """Base64 MD5 digest of the canonical text with brackets after every label."""
    full = F.regexp_replace(canonical, r"([^(),]+)([,)]|$)", "$1()$2")
    return F.base64(F.unhex(F.md5(full)))
