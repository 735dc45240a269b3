"""Checksums: of a table's rows whatever their order, and chained over epochs. They find differences; they prove nothing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.rules import Checked
from tidemark.plans.tree import text

#: Digests are sums modulo this prime.
MODULUS = (1 << 61) - 1
#: The digest of a table without rows.
EMPTY = 0


def row_digest(columns: Sequence[str]) -> Column:
    """60 bits of the MD5 of a row's values, each with its length, so that no two rows have the same text."""
    parts = [F.concat(F.length(v).cast("string"), F.lit(":"), v) for v in (F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)]
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 15), 16, 10).cast("decimal(19,0)")


def table_digest(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Digest and number of all rows, for each value of ``by``. Partial sums make it one shuffle of one row a task and group."""
    total = (F.sum(row_digest(columns)) % F.lit(MODULUS).cast("decimal(38,0)")).cast("bigint")
    return rows.groupBy(*by).agg(total.alias("digest"), F.count("*").alias("n_rows"))


def commitment_chain(digests: DataFrame, epoch: str, seed: str = "") -> DataFrame:
    """(epoch, digest, commitment): SHA-256 of the commitment before and the digest, epochs ascending. One row an epoch is gathered."""
    step = lambda acc, x: F.array_append(acc, F.struct(x["e"].alias("e"), x["d"].alias("d"), F.sha2(F.concat(F.coalesce(F.element_at(acc, -1)["c"], F.lit(seed)), F.lit("|"), x["d"].cast("string")).cast("binary"), 256).alias("c")))
    rows = digests.agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col("digest").alias("d")))).alias("all"))
    first = F.transform(F.slice("all", 1, 1), lambda x: F.struct(x["e"].alias("e"), x["d"].alias("d"), F.sha2(F.concat(F.lit(seed), F.lit("|"), x["d"].cast("string")).cast("binary"), 256).alias("c")))
    rest = F.aggregate(F.slice("all", 2, F.greatest(F.size("all"), F.lit(1))), first, step)
    return rows.where(F.size("all") > 0).select(F.explode(rest).alias("x")).select(F.col("x.e").alias(epoch), F.col("x.d").alias("digest"), F.col("x.c").alias("commitment"))


def chain_check(manifest: DataFrame, epoch: str, seed: str = "", start: int | None = None, before: str | None = None) -> DataFrame:
    """For each row (epoch, digest, commitment) whether the commitment follows from the epoch before: 1 or 0.

    With ``start`` the chain must begin at that epoch. ``before`` names a column with the digest an epoch was built on: the digest of the epoch
    before it, and EMPTY for the first. One row an epoch is gathered.
    """
    w = Window.orderBy(epoch)
    last = F.lag("digest").over(w)
    want = F.sha2(F.concat(F.coalesce(F.lag("commitment").over(w), F.lit(seed)), F.lit("|"), F.col("digest").cast("string")).cast("binary"), 256)
    holds = want.eqNullSafe(F.col("commitment"))
    if start is not None:
        holds = holds & (F.lag(epoch).over(w).isNotNull() | (F.col(epoch) == start))
    if before is not None:
        holds = holds & F.col(before).eqNullSafe(F.coalesce(last, F.lit(EMPTY).cast("bigint")))
    return manifest.select(epoch, holds.cast("bigint").alias("holds"))


def query_fingerprint(checked: Checked) -> str:
    """SHA-256 of a query's meaning: table, columns, outputs, predicate and DISTINCT, whatever its spelling."""
    plain = {
        "table": checked.table.physical or checked.table.name,
        "columns": [(c.name, c.kind.value, c.id) for c in checked.table.columns],
        "outputs": [(o.aggregate, text(o.expr)) for o in checked.outputs],
        "where": None if checked.where is None else text(checked.where),
        "distinct": checked.distinct and not checked.aggregates,
        "placeholders": checked.placeholders,
    }
    return hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()
