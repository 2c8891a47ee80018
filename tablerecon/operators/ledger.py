"""Two-way ledger netting: what A booked against b beside what b booked against A."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerecon.functions.names import col
from tablerecon.operators.keyed import attach
from tablerecon.operators.lookup import keep_known


def pair_totals(
    df: DataFrame, own: str, peer: str, amounts: Sequence[str], scale: int = 2
) -> DataFrame:
    """Exact totals per (own, peer); pairs with a null side are left out."""
    known = df.where(col(own).isNotNull() & col(peer).isNotNull())
    return known.groupBy(col(own), col(peer)).agg(
        *[F.sum(col(a).try_cast(f"decimal(28,{scale})")).alias(a) for a in amounts]
    )


def reciprocal_totals(
    df: DataFrame, own: str, peer: str, amounts: Sequence[str], scale: int = 2
) -> DataFrame:
    """Each pair's totals beside those of the reversed pair; absent ones are 0."""
    totals = pair_totals(df, own, peer, amounts, scale)
    back_names = {c: f"back_{c}" for c in [own, peer, *amounts]}
    back = totals.select(
        col(own).alias("_back_own"),
        col(peer).alias("_back_peer"),
        *[col(c).alias(b) for c, b in back_names.items()],
    )
    # Both sides are unique by construction.
    out = attach(totals, back, [(peer, "_back_own"), (own, "_back_peer")])
    types = {f.name: f.dataType for f in totals.schema.fields}
    return out.withColumns({b: F.coalesce(col(b), F.lit(0).cast(types[c])) for c, b in back_names.items()})


def net_vouchers(
    known: DataFrame,
    entries: DataFrame,
    voucher: str,
    own: str,
    peer: str,
    amounts: Sequence[str],
    scale: int = 2,
) -> DataFrame:
    """The whole job: entries of known vouchers, netted both ways."""
    return reciprocal_totals(keep_known(entries, known, voucher), own, peer, amounts, scale)
