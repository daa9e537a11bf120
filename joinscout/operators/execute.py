"""Running join orders: projection, exact cardinality without joining, the joins, and late projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinscout.functions import portable
from joinscout.operators.graph import NATURAL, Keep
from joinscout.sources.lake import RID, Lake

BIG = "decimal(38,0)"


def key_of(column: str, join_type: str) -> Column:
    """What a column is joined on: its value, or its simhash."""
    c = F.col(f"`{column}`")
    return c if join_type == NATURAL else portable.simhash(c)


def used_columns(order: list[dict]) -> dict[str, list[tuple[str, str]]]:
    """For each table on a join order, its (column, join type) in use, once each."""
    out: dict[str, list[tuple[str, str]]] = {}
    for hop in order:
        for side in ("parent", "child"):
            use = (hop[f"{side}_column"], hop["join_type"])
            own = out.setdefault(hop[side], [])
            if use not in own:
                own.append(use)
    return out


def key_name(table: str, column: str, join_type: str) -> str:
    return f"{table}_{column}" if join_type == NATURAL else f"{table}_{column}__{join_type}"


def project(lake: Lake, order: list[dict]) -> dict[str, DataFrame]:
    """Each table with the keys that the order uses and Index_<table>; rows with a null in any of them are left out."""
    out = {}
    for table, uses in used_columns(order).items():
        keys = [key_of(c, t).alias(key_name(table, c, t)) for c, t in uses]
        held = lake.tables[table].dropna(subset=[RID, *(c for c, _ in uses)])
        out[table] = held.select(*keys, F.col(RID).alias(f"Index_{table}"))
    return out


def numbered(order: list[dict], self_join: bool = False) -> list[tuple[str, str, dict]]:
    """(parent, child, hop) of the hops that a join runs, as perform_joins does: a child seen before is left out, or numbered with `self_join`."""
    seen = {order[0]["parent"]: 1}
    out = []
    for hop in order:
        child = hop["child"]
        if child in seen and not self_join:
            continue
        seen[child] = seen.get(child, 0) + 1
        out.append((hop["parent"], child if seen[child] == 1 else f"{child}__{seen[child]}", hop))
    return out


def cardinality(tables: dict[str, DataFrame], order: list[dict], self_join: bool = False) -> DataFrame:
    """(cardinality) of the joins that perform_joins runs for an order, without running them.

    Hops make a tree. From its leaves to its root, each table's rows are counted by the keys in use, and weights of what hangs on them
    are joined by key: no join result is ever made. Counts are decimals of 38 digits, as products of counts outgrow a long.
    """
    below: dict[str, list[tuple[str, dict]]] = {}
    for parent, child, hop in numbered(order, self_join):
        below.setdefault(parent, []).append((child, hop))

    def weighed(node: str, table: str, key: str | None) -> DataFrame:
        """(key, w): how many rows the tree under a node gives for each key of it; (w) of the whole for the root."""
        used = [(child, hop, key_name(table, hop["parent_column"], hop["join_type"])) for child, hop in below.get(node, [])]
        names = list(dict.fromkeys([*([key] if key else []), *(n for _, _, n in used)]))
        out = tables[table].groupBy(*(F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names))).agg(F.count(F.lit(1)).cast(BIG).alias("w"))
        for child, hop, name in used:
            on = f"k{names.index(name)}"
            under = weighed(child, hop["child"], key_name(hop["child"], hop["child_column"], hop["join_type"])).select(F.col("key").alias(on), F.col("w").alias("w2"))
            out = out.join(under, on).withColumn("w", (F.col("w") * F.col("w2")).cast(BIG)).drop("w2")
        total = F.sum("w").cast(BIG).alias("w")
        return out.groupBy(F.col("k0").alias("key")).agg(total) if key else out.agg(total)

    root = order[0]["parent"]
    return weighed(root, root, None).select(F.coalesce("w", F.lit(0)).cast(BIG).alias("cardinality"))


def path_cardinalities(lake: Lake, orders: list[dict], keep: Keep | None = None) -> DataFrame:
    """(path, cardinality) of many paths at once: {path, join_order} each. Prefixes that paths share are carried once.

    A relation (prefix, key, weight) is extended by one hop a round for all paths together. Counts and rounds are stored by
    `keep`, if given, so that each is made once. A table that an order comes back to is skipped, and such orders are counted one by one.
    """
    keep = keep or (lambda frame, name: frame)
    spark = lake.spark
    again = [o["join_order"] for o in orders if len({o["join_order"][0]["parent"], *(h["child"] for h in o["join_order"])}) <= len(o["join_order"])]
    if again:
        rest = [o for o in orders if o["join_order"] not in again]
        single = [cardinality(project(lake, order), order).select(F.lit(">".join([order[0]["parent"], *(h["child"] for h in order)])).alias("path"), "cardinality") for order in again]
        return reduce(DataFrame.unionByName, [*([path_cardinalities(lake, rest, keep)] if rest else []), *single])
    uses: dict[tuple, None] = {}
    starts, steps, ends = {}, {}, []
    for o in orders:
        hops = o["join_order"]
        first = hops[0]
        prefix = ">".join([first["parent"], first["child"]])
        starts[prefix] = (first["parent"], first["parent_column"], first["join_type"])
        for now, after in zip(hops, hops[1:], strict=False):
            longer = f"{prefix}>{after['child']}"
            use = (now["child"], now["child_column"], now["join_type"], after["parent_column"], after["join_type"])
            uses[use] = None
            steps[longer] = (prefix, "|".join(use))
            prefix = longer
        last = hops[-1]
        ends.append((prefix, "|".join((last["child"], last["child_column"], last["join_type"]))))

    def counted(table: str, keys: dict[str, tuple[str, str]], tag: str) -> DataFrame:
        names = {k: c for k, (c, _) in keys.items()}
        rows = lake.tables[table].select(*(F.col(f"`{c}`").alias(k) for k, c in names.items())).dropna()
        out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        if any(t != NATURAL for _, t in keys.values()):  # hashed once a distinct value
            out = out.select(*(key_of(k, t).alias(k) for k, (_, t) in keys.items()), "n").groupBy(*keys).agg(F.sum("n").alias("n"))
        return out.withColumn("use", F.lit(tag))

    def union(frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    ends_by = {e[1]: None for e in ends} | {"|".join(v): None for v in starts.values()}
    single = keep(union([counted(t, {"key": (c, k)}, tag) for tag in ends_by for t, c, k in [tag.split("|")]]), "key_counts")
    start_rows = spark.createDataFrame([(p, "|".join(v)) for p, v in starts.items()], "prefix string, use string")
    weights = single.join(start_rows, "use").select("prefix", "key", F.col("n").cast(BIG).alias("w"))
    every = weights
    if uses:
        double = keep(union([counted(t, {"key": (c1, k1), "next": (c2, k2)}, "|".join((t, c1, k1, c2, k2))) for t, c1, k1, c2, k2 in uses]), "hop_counts")
        depth = max(p.count(">") for p in steps)
        for level in range(2, depth + 1):
            now = [(p, b, u) for p, (b, u) in steps.items() if p.count(">") == level]
            rows = spark.createDataFrame(now, "longer string, prefix string, use string")
            weights = keep(weights.join(rows, "prefix").join(double, ["use", "key"]).groupBy(F.col("longer").alias("prefix"), F.col("next").alias("key")).agg(F.sum(F.col("w") * F.col("n")).cast(BIG).alias("w")), f"weights-{level}")
            every = every.unionByName(weights)
    end_rows = spark.createDataFrame(ends, "prefix string, use string")
    met = every.join(end_rows, "prefix").join(single, ["use", "key"]).groupBy("prefix").agg(F.sum(F.col("w") * F.col("n")).cast(BIG).alias("cardinality"))
    return end_rows.select("prefix").join(met, "prefix", "left").select(F.col("prefix").alias("path"), F.coalesce("cardinality", F.lit(0)).cast(BIG).alias("cardinality"))


def perform_joins(tables: dict[str, DataFrame], order: list[dict], sample: int | None = None, seed: int = 0, self_join: bool = False) -> DataFrame:
    """Inner joins along an order, left-deep. A child seen before is skipped, or joined again under a numbered name if `self_join`.

    With `sample`, each hop keeps the rows of least seeded hash of their indexes, so many at most. Spark picks the join's form by size.
    """
    out = tables[order[0]["parent"]]
    seen = {order[0]["parent"]: 1}
    for hop in order:
        parent, child = hop["parent"], hop["child"]
        right, prefix = tables[child], child
        if child in seen:
            if not self_join:
                continue
            seen[child] += 1
            prefix = f"{child}__{seen[child]}"
            right = right.select(*(F.col(f"`{c}`").alias(c.replace(child, prefix, 1)) for c in right.columns))
        else:
            seen[child] = 1
        left_key = key_name(parent, hop["parent_column"], hop["join_type"])
        right_key = key_name(child, hop["child_column"], hop["join_type"]).replace(child, prefix, 1)
        out = out.join(right, out[f"`{left_key}`"] == right[f"`{right_key}`"])
        if sample:
            out = down_sample(out, sample, seed)
    return out


def down_sample(frame: DataFrame, n: int, seed: int) -> DataFrame:
    """The n rows of least seeded md5 of their row ids; a top-k, not a full sort."""
    ids = sorted(c for c in frame.columns if c.startswith("Index_"))
    return frame.withColumn("__key", F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *(F.col(f"`{c}`").cast("string") for c in ids)).cast("binary"))).orderBy("__key", *(f"`{c}`" for c in ids)).limit(n).drop("__key")


def semi_reduce(table: DataFrame, rids: DataFrame, name: str) -> DataFrame:
    """Rows of a projected table whose Index_<name> is among `rids` (rid), once each."""
    return table.join(rids, table[f"Index_{name}"] == rids.rid, "left_semi").dropna().dropDuplicates()


def fetch_columns(lake: Lake, joined: DataFrame, columns: list[tuple[str, str]], hashed: bool = False, is_numeric: dict[tuple[str, str], bool] | None = None) -> DataFrame:
    """Adds <table>_<column> for each asked column by row id; with `hashed`, text columns come as simhashes."""
    out = joined
    for table in dict.fromkeys(t for t, _ in columns):
        own = list(dict.fromkeys(c for t, c in columns if t == table))
        value = {c: portable.simhash(F.col(f"`{c}`")) if hashed and not (is_numeric or {}).get((table, c), False) else F.col(f"`{c}`") for c in own}
        base = lake.tables[table].select(F.col(RID).alias("__at"), *(v.alias(f"{table}_{c}") for c, v in value.items()))
        out = out.drop(*(f"{table}_{c}" for c in own)).join(base, out[f"Index_{table}"] == base["__at"], "left").drop("__at")
    return out
