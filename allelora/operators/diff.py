"""Differences between two copies of a dataset, field by field.

Rows are compared as multisets. Equal rows cancel by multiplicity in one aggregation with map-side
combining, so copies of one row never meet in a task. What is left of a key on both sides is paired at
minimum cost, the cost being the number of differing fields; most keys have one row on either side, whose
pairing is trivial and stays in the JVM. Keys with more rows go through an assignment of their distinct rows
with multiplicities. Keys with more than ``block`` distinct rows on a side are first paired with distributed joins,
pairs that differ in one field before the others, and then by exchanges until none lowers the cost.
"""

from __future__ import annotations

from itertools import combinations
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelora.operators.skew import running
from allelora.session import cut, shared_dir


def leftovers(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields..., n_a, n_b): the rows that remain after equal rows have cancelled, n_a or n_b copies of each.

    Also keeps in_a and in_b: whether the key has any row on that side.
    """
    side = lambda df, x, y: df.select(key, *fields, F.lit(x).alias("x"), F.lit(y).alias("y"))
    rows = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(key, *fields).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return rows.select(key, *fields, F.greatest(F.col("x") - F.col("y"), F.lit(0)).alias("n_a"), F.greatest(F.col("y") - F.col("x"), F.lit(0)).alias("n_b"), (F.col("x") > 0).alias("in_a"), (F.col("y") > 0).alias("in_b"))


def assign(costs: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> list[tuple[int, int, int]]:
    """Minimum-cost pairing (i, j, copies) of min(total supply, total demand) copies, by successive shortest paths."""
    n, m = costs.shape
    supply, demand = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    flow = np.zeros((n, m), np.int64)
    while supply.any() and demand.any():
        # Bellman-Ford from all rows with supply over the residual graph; costs are small integers.
        far = np.where(supply > 0, 0.0, np.inf)
        from_row = np.full(m, -1)
        from_col = np.full(n, -1)
        reach = np.full(m, np.inf)
        while True:
            step = far[:, None] + costs
            best = step.argmin(axis=0)
            new = step[best, np.arange(m)]
            better = new < reach - 1e-9
            if not better.any():
                break
            reach[better], from_row[better] = new[better], best[better]
            back = np.where(flow > 0, reach[None, :] - costs, np.inf)
            col = back.argmin(axis=1)
            value = back[np.arange(n), col]
            nearer = value < far - 1e-9
            far[nearer], from_col[nearer] = value[nearer], col[nearer]
        j = int(np.where(demand > 0, reach, np.inf).argmin())
        path, col = [], j
        while True:
            i = int(from_row[col])
            path.append((i, col))
            if from_col[i] < 0 or supply[i] > 0 and far[i] == 0:
                break
            col = int(from_col[i])
        amount = min(int(supply[path[-1][0]]), int(demand[j]))
        for x, (i, _) in enumerate(path[:-1]):
            amount = min(amount, int(flow[i, path[x + 1][1]]))
        for x, (i, c) in enumerate(path):
            flow[i, c] += amount
            if x + 1 < len(path):
                flow[i, path[x + 1][1]] -= amount
        supply[path[-1][0]] -= amount
        demand[j] -= amount
    return [(int(i), int(j), int(flow[i, j])) for i, j in zip(*np.nonzero(flow))]


def _differing(fields: list[str]) -> Column:
    return F.filter(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())


def _kept(df: DataFrame) -> DataFrame:
    """``cut`` by way of Parquet. In a loop of joins over checkpoints each step took about four times as long as the one before."""
    path = f"{shared_dir(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_levels(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A first pairing of keys too large for one task: (k, ha, hb, copies), not yet at minimum cost.

    For each set of all fields but one, and then for none, rows that agree in them are laid out as intervals of
    copies on both sides and joined where the intervals overlap. ``rows`` is (k, row, hash, n_a, n_b), k not null.
    """
    state = rows.select("k", "row", "hash", "n_a", "n_b")
    out = None
    for size in sorted({len(fields) - 1, 0}, reverse=True):
        for kept in combinations(fields, size):
            group = F.xxhash64("k", *(F.col(f"row.{f}") for f in kept), *(F.col(f"row.{f}").isNull() for f in kept))
            laid = running(state.withColumn("g", group), "g", ["hash"], ("n_a", "n_b")).withColumnsRenamed({"before_n_a": "from_a", "before_n_b": "from_b"})
            same = F.struct("k", *(F.col(f"row.{f}").alias(f) for f in kept))
            x = laid.where("n_a > 0").select("g", "k", F.col("hash").alias("ha"), same.alias("same"), "from_a", (F.col("from_a") + F.col("n_a")).alias("to_a"))
            y = laid.where("n_b > 0").select(F.col("g").alias("h"), F.col("hash").alias("hb"), same.alias("also"), "from_b", (F.col("from_b") + F.col("n_b")).alias("to_b"))
            # Groups are hashes: rows of two groups that share one aren't paired, and stay over for the next level.
            met = x.join(y, (F.col("g") == F.col("h")) & F.col("same").eqNullSafe(F.col("also")) & (F.col("from_a") < F.col("to_b")) & (F.col("from_b") < F.col("to_a")))
            pairs = _kept(met.select("k", "ha", "hb", (F.least("to_a", "to_b") - F.greatest("from_a", "from_b")).alias("copies")))
            used_a = pairs.groupBy("k", F.col("ha").alias("hash")).agg(F.sum("copies").alias("ua"))
            used_b = pairs.groupBy("k", F.col("hb").alias("hash")).agg(F.sum("copies").alias("ub"))
            state = _kept(
                state.join(used_a, ["k", "hash"], "left").join(used_b, ["k", "hash"], "left")
                .select("k", "row", "hash", (F.col("n_a") - F.coalesce("ua", F.lit(0))).alias("n_a"), (F.col("n_b") - F.coalesce("ub", F.lit(0))).alias("n_b"))
                .where("n_a > 0 OR n_b > 0")
            )
            out = pairs if out is None else out.unionByName(pairs)
    rest = state.select("k", F.when(F.col("n_a") > 0, F.col("hash")).alias("ha"), F.when(F.col("n_b") > 0, F.col("hash")).alias("hb"), (F.col("n_a") + F.col("n_b")).alias("copies"))
    return out.unionByName(rest)


def _cycles(parents: DataFrame) -> DataFrame | None:
    """(id, parent, amount) of the nodes of ``parents`` (id, parent, copies) on cycles; amount is the least copies of a cycle. None without cycles."""
    ring = parents
    n = ring.count()
    while n:
        # Nodes that are nobody's parent, or whose parent is gone, aren't on a cycle.
        heads, ids = ring.select(F.col("parent").alias("id")).distinct(), ring.select(F.col("id").alias("parent"))
        ring = _kept(ring.join(heads, "id", "left_semi").join(ids, "parent", "left_semi").select("id", "parent", "copies"))
        left = ring.count()
        if left == n:
            break
        n = left
    if not n:
        return None
    jump, steps = ring.select("id", F.col("parent").alias("to"), F.col("copies").alias("amount")), 1
    while steps < n:
        far = jump.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("amount").alias("more"))
        jump = _kept(jump.join(far, "to").select("id", F.col("next").alias("to"), F.least("amount", "more").alias("amount")))
        steps *= 2
        after = jump.select(F.col("id").alias("parent"), F.col("amount").alias("other"))
        if ring.join(jump.select("id", "amount"), "id").join(after, "parent").where("amount <> other").isEmpty():
            break
    return ring.select("id", "parent").join(jump.select("id", "amount"), "id")


def _exchanged(pairs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``pairs`` (k, ha, hb, copies) brought to minimum cost by exchanges; ha or hb is null for a row without a partner.

    ``rows`` is (k, hash, f), f the ``width`` hashes of a row's fields. A pair p may pass its row of a on to the row of b of a pair q, which
    costs that new pair less p's own cost; a pairing is minimal when no cycle of such steps has a negative sum. Cheapest steps
    are found by Bellman-Ford rounds, through one group for each set of agreeing fields and their values, so that no task sees
    all rows of a key. Cycles of the parents are negative and have no pair in common: all are cancelled at once.
    """
    subsets = [s for size in range(width + 1) for s in combinations(range(width), size)]

    def spots(f: Column) -> Column:
        return F.array(*(F.struct(F.xxhash64("k", F.lit(i), *(f[j] for j in s)).alias("g"), F.lit(width - len(s)).alias("w")) for i, s in enumerate(subsets)))

    # Any row of b takes what a missing row of a leaves, and any row of a may be left alone, at no cost.
    alone = lambda i: F.array(F.struct(F.xxhash64("k", F.lit(-i)).alias("g"), F.lit(0).alias("w")))
    given = F.when(F.col("ha").isNull(), alone(1)).otherwise(F.concat(spots(F.col("fa")), alone(2)))
    sought = F.when(F.col("hb").isNull(), alone(2)).otherwise(F.concat(spots(F.col("fb")), alone(1)))
    side = lambda x: rows.select("k", F.col("hash").alias(f"h{x}"), F.col("f").alias(f"f{x}"))
    cost = F.when(F.col("ha").isNull() | F.col("hb").isNull(), 0).otherwise(F.size(F.filter(F.zip_with("fa", "fb", lambda x, y: x != y), lambda x: x)))
    while True:
        merged = pairs.groupBy("k", "ha", "hb").agg(F.sum("copies").alias("copies")).where("copies > 0")
        ident = F.xxhash64("k", F.coalesce("ha", F.lit("")), F.coalesce("hb", F.lit(""))).alias("id")
        nodes = _kept(merged.join(side("a"), ["k", "ha"], "left").join(side("b"), ["k", "hb"], "left").select(ident, "k", "ha", "hb", "copies", "fa", "fb", cost.alias("c")))
        out = _kept(nodes.select("id", "c", F.inline(given)).select("id", "g", (F.col("w") - F.col("c")).alias("w")))
        into = _kept(nodes.select("id", F.inline(sought)).select("id", "g"))
        state = nodes.select("id", "copies", F.lit(0).alias("d"), F.lit(None).cast("bigint").alias("parent"))
        found, rounds = None, 0
        while found is None:
            best = out.join(state.select("id", "d"), "id").groupBy("g").agg(F.min(F.struct((F.col("d") + F.col("w")).alias("d"), "id")).alias("m"))
            step = into.join(best, "g").groupBy("id").agg(F.min("m").alias("m"))
            nearer = F.col("m.d") < F.col("d")
            state = _kept(state.join(step, "id").select("id", "copies", F.when(nearer, F.col("m.d")).otherwise(F.col("d")).alias("d"), F.when(nearer, F.col("m.id")).otherwise(F.col("parent")).alias("parent"), nearer.alias("moved")))
            if state.where("moved").isEmpty():
                return nodes.select("k", "ha", "hb", "copies")
            rounds += 1
            if rounds > 1:
                found = _cycles(state.where("parent IS NOT NULL").select("id", "parent", "copies"))
        found = _kept(found)
        taken = found.join(nodes, "id").select("k", "ha", "hb", (-F.col("amount")).alias("copies"))
        giver = nodes.select(F.col("id").alias("parent"), "ha")
        made = found.join(nodes.select("id", "k", "hb"), "id").join(giver, "parent").select("k", "ha", "hb", F.col("amount").alias("copies"))
        pairs = nodes.select("k", "ha", "hb", "copies").unionByName(taken).unionByName(made)


def paired(a: DataFrame, b: DataFrame, key: str, fields: list[str], block: int = 200) -> DataFrame:
    """(key, a, b, copies, in_a, in_b): leftover rows of both copies, paired within each key at minimum cost.

    ``fields`` must be of orderable types (no maps), of any names. ``a`` and ``b`` are structs of ``fields``; one of them is null for a row without a partner. Equal rows of both
    copies don't appear. A null key pairs with null keys. Other columns of the two tables are ignored.
    """
    rows = _paired(*_plain(a, b, key, fields), block)
    named = lambda side: F.when(F.col(side).isNotNull(), F.struct(*(F.col(f"{side}.f{i}").alias(f) for i, f in enumerate(fields)))).alias(side)
    return rows.select(F.col("__id").alias(key), named("a"), named("b"), "copies", "in_a", "in_b")


def _plain(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame, str, list[str]]:
    """Both tables with columns of names that clash with none here, and these names."""
    one = lambda df: df.select(F.col(key).alias("__id"), *(F.col(f).alias(f"f{i}") for i, f in enumerate(fields)))
    return one(a), one(b), "__id", [f"f{i}" for i in range(len(fields))]


def _paired(a: DataFrame, b: DataFrame, key: str, fields: list[str], block: int) -> DataFrame:
    rest = cut(leftovers(a, b, key, fields))
    keys = rest.groupBy(key).agg(
        F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"), F.sum(F.when(F.col("n_a") > 0, 1).otherwise(0)).alias("rows_a"), F.sum(F.when(F.col("n_b") > 0, 1).otherwise(0)).alias("rows_b")
    )
    left = rest.where("n_a > 0 OR n_b > 0").select(key, F.struct(*fields).alias("row"), "n_a", "n_b")
    sized = keys.withColumnRenamed(key, "__key").where("rows_a + rows_b > 0")
    large = F.greatest("rows_a", "rows_b") > block
    simple = F.greatest("rows_a", "rows_b") <= 1
    joined = left.join(sized, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    none = F.lit(None).cast(left.schema["row"].dataType)
    single = joined.where(simple).groupBy(key).agg(F.max(F.when(F.col("n_a") > 0, F.col("row"))).alias("a"), F.max(F.when(F.col("n_b") > 0, F.col("row"))).alias("b"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    both = single.select(key, F.inline(F.array(
        F.struct(F.col("a"), F.col("b"), F.least("n_a", "n_b").alias("copies")),
        F.struct(F.when(F.col("n_a") > F.col("n_b"), F.col("a")).otherwise(none).alias("a"), F.when(F.col("n_b") > F.col("n_a"), F.col("b")).otherwise(none).alias("b"), F.abs(F.col("n_a") - F.col("n_b")).alias("copies")),
    ))).where("copies > 0")
    one_sided = (F.col("rows_a") == 0) | (F.col("rows_b") == 0)
    lone = joined.where(~simple & one_sided).select(key, F.when(F.col("n_a") > 0, F.col("row")).otherwise(none).alias("a"), F.when(F.col("n_b") > 0, F.col("row")).otherwise(none).alias("b"), (F.col("n_a") + F.col("n_b")).alias("copies"))
    several = joined.where(~simple & ~one_sided)
    hashed = several.select(key, "row", F.sha2(F.to_json("row"), 256).alias("hash"), *(F.xxhash64(F.col(f"row.{f}"), F.col(f"row.{f}").isNull()).alias(f"__f{i}") for i, f in enumerate(fields)), "n_a", "n_b", large.alias("large"))
    width = len(fields)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hash", kind="stable").reset_index(drop=True)
        x, y = pdf[pdf.n_a > 0], pdf[pdf.n_b > 0]
        fx, fy = (t[[f"__f{i}" for i in range(width)]].to_numpy() for t in (x, y))
        costs = (fx[:, None, :] != fy[None, :, :]).sum(axis=2).astype(float)
        pairs = assign(costs, x.n_a.to_numpy(), y.n_b.to_numpy())
        hx, hy = x.hash.tolist(), y.hash.tolist()
        used_x, used_y = dict.fromkeys(hx, 0), dict.fromkeys(hy, 0)
        out = []
        for i, j, c in pairs:
            out.append((hx[i], hy[j], c))
            used_x[hx[i]] += c
            used_y[hy[j]] += c
        out += [(h, None, n - used_x[h]) for h, n in zip(hx, x.n_a) if n > used_x[h]]
        out += [(None, h, n - used_y[h]) for h, n in zip(hy, y.n_b) if n > used_y[h]]
        res = pd.DataFrame(out, columns=["ha", "hb", "copies"])
        res.insert(0, "k", [pdf[key].iloc[0]] * len(res))
        return res

    kind = left.schema[key].dataType.simpleString()
    small = hashed.where("NOT large")
    solved = small.drop("row", "large").groupBy(key).applyInPandas(solve, f"k {kind}, ha string, hb string, copies bigint")
    look = small.select(F.col(key).alias("k"), "hash", "row")
    same = lambda h, alias: look.select(F.col("k").alias(f"k_{alias}"), F.col("hash").alias(h), F.col("row").alias(alias))
    matched = (
        solved.join(same("ha", "a").withColumnRenamed("ha", "h1"), F.col("k").eqNullSafe(F.col("k_a")) & (F.col("ha") == F.col("h1")), "left")
        .join(same("hb", "b").withColumnRenamed("hb", "h2"), F.col("k").eqNullSafe(F.col("k_b")) & (F.col("hb") == F.col("h2")), "left")
        .select(F.col("k").alias(key), "a", "b", "copies")
    )
    result = both.unionByName(lone).unionByName(matched)
    big = hashed.where("large").select(F.to_json(F.struct(key)).alias("k"), key, "row", "hash", F.array(*(f"__f{i}" for i in range(width))).alias("f"), "n_a", "n_b")
    if not big.isEmpty():
        big = cut(big)
        pairs = _exchanged(_by_levels(big.drop(key), fields), big.select("k", "hash", "f"), width)
        rows = lambda h, alias: big.select("k", F.col("hash").alias(h), F.col("row").alias(alias))
        named = pairs.join(rows("ha", "a"), ["k", "ha"], "left").join(rows("hb", "b"), ["k", "hb"], "left")
        result = result.unionByName(named.join(big.select("k", key).distinct(), "k").select(key, "a", "b", "copies"))
    return result.join(keys.select(F.col(key).alias("__key"), "in_a", "in_b"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def differences(a: DataFrame, b: DataFrame, key: str, fields: list[str], block: int = 200) -> DataFrame:
    """(key, field, copies): ``missing_in_b`` or ``missing_in_a`` once for a key in one copy only; each field in which paired
    rows differ, ``copies`` the number of pairs; ``extra_in_a`` or ``extra_in_b`` for rows without a partner, of a key in both.
    """
    plain = _plain(a, b, key, fields)
    rows = _paired(*plain, block)
    names = F.array(*map(F.lit, fields))
    kinds = (
        F.when(~F.col("in_b"), F.array(F.lit("missing_in_b")))
        .when(~F.col("in_a"), F.array(F.lit("missing_in_a")))
        .when(F.col("b").isNull(), F.array(F.lit("extra_in_a")))
        .when(F.col("a").isNull(), F.array(F.lit("extra_in_b")))
        .otherwise(F.transform(_differing(plain[3]), lambda f: F.get(names, F.substring(f, 2, 9).cast("int"))))
    )
    counted = rows.select("__id", F.explode(kinds).alias("field"), "copies").groupBy("__id", "field").agg(F.sum("copies").alias("copies"))
    return counted.select(F.col("__id").alias(key), "field", "copies")
