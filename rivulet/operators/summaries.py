"""Differences of two tables of keys from small summaries (invertible Bloom lookup tables).

A summary has some cells; each key adds to four of them its sign, its digest and a check.  Cells of two sides are
subtracted by adding one side with the other sign, in a plain aggregation whose partial results, one row for each cell, are all that
is exchanged.  Keys that both sides hold alike cancel out.  A cell in which one key is left gives it away; it is then taken from
its other cells, and so on.  Keys found so are looked up in both tables, so that what comes out was compared by its own columns.

How many cells are needed is estimated first, from small summaries of ever rarer samples of the keys.  Where too many keys differ, or cells do
not come apart, a full join is the exact way.
"""

from __future__ import annotations

import secrets
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged

#: Most keys that are told from summaries, cells of a stratum, and strata of the estimate.
LIMIT, STRATUM_CELLS, STRATA = 100_000, 80, 24
#: Primes for the four places of a digest, the sample that it is in, and its check.
_PLACES, _SAMPLE, _CHECK = (2_147_483_629, 2_147_483_587, 2_147_483_579, 2_147_483_563), 2_147_483_549, 2_147_483_647


def _digest(key: list[str], salt: str) -> Column:
    """62 bits of a key; the salt is drawn for each run, so nobody can build keys that cancel out."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), *key), 2)


def _check(d):
    return (d % _CHECK) * (d % _CHECK) % _CHECK


def _signed(a: DataFrame, b: DataFrame, key: list[str], salt: str) -> DataFrame:
    one = lambda x, sign: x.select(_digest(key, salt).alias("d"), F.lit(sign).cast("long").alias("n"))
    return one(a, 1).unionByName(one(b, -1))


def _summed(signed: DataFrame, cells: int, *by: Column) -> DataFrame:
    """(by..., cell, n, d, c) of cells that are not empty: sums of signs, digests and checks."""
    width = cells // len(_PLACES)
    at = F.array(*[F.col("d") % p % width + i * width for i, p in enumerate(_PLACES)])
    x = signed.select(*by, "n", "d", F.explode(at).alias("cell"))
    sums = [F.sum("n").alias("n"), F.sum(F.col("d").cast("decimal(20,0)") * F.col("n")).alias("d"), F.sum(_check(F.col("d")) * F.col("n")).alias("c")]
    return x.groupBy(*[b._jc.toString() for b in by], "cell").agg(*sums).where("n <> 0 or d <> 0 or c <> 0")


def peel(rows: list[tuple[int, int, int, int]], cells: int) -> dict[int, int] | None:
    """Net number of each digest of the cells (cell, n, d, c); None if they do not come apart."""
    width, table, out = cells // len(_PLACES), {r[0]: [r[1], int(r[2]), r[3]] for r in rows}, defaultdict(int)
    todo = list(table)
    while todo:
        n, d, c = table.get(todo.pop(), (0, 0, 0))
        if not n or d % n:
            continue
        key = d // n
        if key < 0 or c != n * _check(key):
            continue
        out[key] += n
        for i, p in enumerate(_PLACES):
            at = key % p % width + i * width
            left = [x - y for x, y in zip(table.get(at, (0, 0, 0)), (n, d, c), strict=True)]
            table[at] = left
            todo.append(at)
        if len(out) > LIMIT * 2:
            return None
    return None if any(any(x) for x in table.values()) else {k: n for k, n in out.items() if n}


def estimated(signed: DataFrame) -> int:
    """About how many digests differ: samples of a half, a quarter, ... of them are peeled from the rarest on until one does not come apart."""
    stratum = F.least(F.floor(-F.log2((F.col("d") % _SAMPLE + 1) / F.lit(float(_SAMPLE)))), F.lit(STRATA - 1)).cast("int").alias("stratum")
    found = defaultdict(list)
    for r in _summed(signed.withColumn("stratum", stratum), STRATUM_CELLS, F.col("stratum")).collect():  # at most STRATA x STRATUM_CELLS rows
        found[r.stratum].append((r.cell, r.n, r.d, r.c))
    seen = 0
    for k in reversed(range(STRATA)):
        keys = peel(found[k], STRATUM_CELLS)
        if keys is None:
            return max(1, seen) << (k + 1)
        seen += len(keys)
    return seen


def differing(a: DataFrame, b: DataFrame, key: list[str], limit: int = LIMIT) -> tuple[DataFrame, int | None]:
    """(``key`` columns, n_a, n_b) of all keys that ``a`` and ``b`` hold a different number of times, and how many cells told them.

    Rows with a null in the key take no part.  The second value is None where more than about ``limit`` keys differ and a full join
    told them.  Both sides are read up to four times, so stage them.
    """
    there = " and ".join(f"`{k}` is not null" for k in key)
    a, b, salt = a.where(there).select(*key), b.where(there).select(*key), secrets.token_hex(16)
    signed, cells, keys = _signed(a, b, key, salt), None, None
    about = estimated(signed)
    for factor in (2, 4):
        if about * factor // 2 <= limit:
            cells = max(64, (about * factor * 3 // 2) // 4 * 4)
            keys = peel([(r.cell, r.n, r.d, r.c) for r in _summed(signed, cells).collect()], cells)  # at most six cells for each key up to the limit
        if keys is not None:
            break
    if keys is None:
        cells = None
    else:
        named = a.sparkSession.createDataFrame([(k,) for k in keys], "_d long")
        only = lambda x: x.join(F.broadcast(named), _digest(key, salt) == F.col("_d"), "left_semi")  # noqa: E731  bounded by the limit
        a, b = only(a), only(b)
    count = lambda x, name: x.groupBy(*key).agg(F.count("*").alias(name))
    out = count(a, "n_a").join(count(b, "n_b"), key, "full").select(*key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b")))
    return out.where("n_a <> n_b"), cells


def missing_and_unexpected(ledger: DataFrame, stored: DataFrame, rejected: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(side, source, id): ``missing`` keys of the ledger that are neither stored nor rejected, and ``unexpected`` stored ones that are not in the ledger.

    Both always differ in number between the ledger and the other two tables together, so only keys that differ are looked at.
    """
    key = ["source", "id"]
    letters = rejected.where("rejected_source <> '' and rejected_id <> ''").select(F.col("rejected_source").alias("source"), F.col("rejected_id").alias("id"))
    other = stored.select(*key).unionByName(letters)
    found, _ = differing(ledger, other, key, limit)
    found = staged(found, "differing")
    missing = found.where("n_a > 0 and n_b = 0").select(F.lit("missing").alias("side"), *key)
    # what only a letter holds is no stored key
    foreign = found.where("n_a = 0").join(stored.select(*key).distinct(), key, "left_semi")
    return missing.unionByName(foreign.select(F.lit("unexpected").alias("side"), *key))
