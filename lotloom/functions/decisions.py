"""Three-valued decisions about a list or an import, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the verdict: share of flagged rows, and row counts beside the last list.
FLAGGED, SHRUNK, SMALLER = 0.25, 0.5, 0.8
# Fixed values of completeness: few rows, and the share of a usual list below which one is partial.
FEW, USUAL, HALF = 5, 0.4, 0.5


def completeness(rows: Column, typical: Column, says_complete: Column, says_partial: Column, trade_word_only: Column) -> Column:
    """True, false or null (undecided): whether a list is the whole of a sender's stock.

    says_complete and says_partial: wording of either kind; trade_word_only: all wording is a bare
    WTS or WTB. typical: rows of a usual list of the sender, null if not known.
    """
    short = (rows <= FEW) & trade_word_only & (typical.isNull() | (rows < typical * HALF))
    return (
        F.when(rows == 0, F.lit(None).cast("boolean"))
        .when(says_partial & ~says_complete, False)
        .when(says_complete & ~says_partial & ~F.coalesce(short, F.lit(False)), True)
        .when(typical.isNotNull() & (rows < typical * USUAL), F.lit(None).cast("boolean"))
        .when(F.coalesce(short, F.lit(False)), F.lit(None).cast("boolean"))
        .when(says_complete, True)
        .when(rows <= FEW, F.lit(None).cast("boolean"))
        .otherwise(True)
    )


def verdict(status: Column, rows: Column, flagged: Column, previous: Column, warnings: Column) -> Column:
    """healthy, check or suspect."""
    return (
        F.when(status.startswith("flagged_") | (status == "failed") | (rows == 0) | (flagged >= rows * FLAGGED), "suspect")
        .when((previous > 0) & (rows <= previous * SHRUNK), "suspect")
        .when((previous > 0) & (rows <= previous * SMALLER), "check")
        .when((flagged > 0) | (warnings > 0), "check")
        .otherwise("healthy")
    )


def settled(complete: Column, would_close: Column, live: Column, answer: Column) -> Column:
    """replace or add: what a list does to the lots it leaves out.

    answer: an outside opinion, complete, addition or null where there is none; it counts where
    closing would be heavy (ten lots or more, and two in five of those live).
    """
    heavy = (would_close >= 10) & (would_close >= live * 0.4)
    return (
        F.when(~F.coalesce(complete, F.lit(False)), "add").when(would_close == 0, "replace")
        .when(~heavy, "replace").when(answer == "complete", "replace").otherwise("add")
    )


def decided_side(side: Column, confidence: Column, needs_review: Column, external: Column) -> Column:
    """The side of a message from the rules and an optional outside answer; null where they disagree."""
    return F.when((confidence >= 0.9) & ~needs_review, side).when(external.isNull(), side).when(side.isNull() | (side == external), external)


def confidence(description: Column, known: Column, price: Column, ambiguous: Column, currency: Column, assumed: Column, quantity: Column, vague: Column, side: Column) -> Column:
    """map of field to confidence, and ``overall``, the least of them.

    known: the line has a brand or barcode; ambiguous: the price as written may be a thousandth;
    assumed: the currency is the supplier's usual one; vague: the quantity as written is a bound.
    """
    words = F.size(F.filter(F.split(F.coalesce(description, F.lit("")), r"(?U)\W+"), lambda w: F.length(w) > 1))
    named = F.trim(F.coalesce(description, F.lit(""))) != ""
    yes = lambda c: F.coalesce(c, F.lit(False))
    fields = {
        "description": F.when(~named, 0.0).when(yes(known), 1.0).when(words >= 3, 0.7).otherwise(0.4),
        "price": F.when(price.isNull(), F.when(side == "buy", 1.0).otherwise(0.5)).when(yes(ambiguous), 0.45).otherwise(1.0),
        "currency": F.when(price.isNull(), F.lit(None).cast("double")).when(currency.isNull(), 0.3).when(yes(assumed), 0.75).otherwise(1.0),
        "quantity": F.when(quantity.isNull(), 0.85).when(yes(vague), 0.6).otherwise(1.0),
    }
    least = F.least(*fields.values())
    return F.map_filter(F.create_map(*[x for k, v in [*fields.items(), ("overall", least)] for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
