"""A Merkle manifest of a dataset: one tree per group of rows, and a tree over the groups' roots.

Every level is a table of nodes (tree, idx). Siblings meet by equijoins of the level with itself on a computed index:
``idx XOR 1`` in a binary tree, the other slots of the run of ``arity`` nodes otherwise. Rows of slot zero, of which each
run has exactly one, emit the parents. Going down again, a node's path to the root is its own siblings followed by the
path of its parent, so a leaf's proof takes one join per level, and the levels shrink by ``arity``. Each join key has at
most ``arity`` rows, whatever the size of a group; levels are stored, so a lost executor costs one level.

Defined cases: a null field is written ``-``, other fields as ``bytes:value``, so no two records share a text. Groups are
ordered bytewise, null first, rows by key, null first, then by leaf; repeated rows are leaves of their own, each with a
proof. A group of one row has that leaf as its root; a single group's root is the root of all. An empty table gives an
empty one. Texts of any length are hashed whole. Columns that are not asked for are dropped, so their names cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmart.operators.ordered import number_rows

from .storage import stored

ARITY = 3
#: On the way down every so many levels are stored, which bounds the plan and what a lost executor makes to do again.
STORE_EVERY = 4


def record(*fields: Column) -> Column:
    """The digest of a row: lowercase hex SHA-256 of its fields in order."""
    def written(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return _hash(*[written(f) for f in fields])


def _hash(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda digest, step: _hash(step["before"], digest, step["after"]))


def proof(path: Column) -> Column:
    """The digest of the siblings, level by level, left to right."""
    return _hash(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))))


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``before`` and ``after``: the digests of the run's others on either side."""
    slot, out = f"idx % {arity}", nodes
    for shift in range(1, arity):
        at = "idx ^ 1" if arity == 2 else f"idx - {slot} + ({slot} + {shift}) % {arity}"
        side = nodes.selectExpr("tree", "idx AS _at", f"digest AS _other{shift}")
        out = out.selectExpr("*", f"{at} AS _at").join(side, ["tree", "_at"], "left").drop("_at")
    others = ", ".join(f"struct(({slot} + {shift}) % {arity} AS slot, _other{shift} AS digest)" for shift in range(1, arity))
    run = f"array_sort(filter(array({others}), x -> x.digest IS NOT NULL))"
    return out.selectExpr(*nodes.columns, *[
        f"concat_ws('', transform(filter({run}, x -> x.slot {side} {slot}), x -> x.digest)) AS {name}"
        for side, name in (("<", "before"), (">", "after"))])


def _levels(nodes: DataFrame, largest: int, arity: int) -> list[DataFrame]:
    """The stored levels of all trees, leaves first, each node with its siblings. ``n`` counts the nodes of its tree on
    the level, so a node with n = 1 is a root; ``largest`` is the greatest n of the leaves."""
    levels = []
    while True:
        levels.append(stored(_with_siblings(nodes, arity), f"merkle-{len(levels)}"))
        if largest <= 1:
            return levels
        largest = -(-largest // arity)
        nodes = levels[-1].filter(f"n > 1 and idx % {arity} = 0").selectExpr(
            "tree", f"idx div {arity} AS idx", f"(n + {arity - 1}) div {arity} AS n",
            "sha2(cast(concat(digest, after) AS binary), 256) AS digest")


def _paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest level with the columns of ``tops`` (tree, path and more), the path begun at the node itself."""
    carried, above = [c for c in tops.columns if c not in ("tree", "path")], None
    kept = ["tree", "idx", "digest", *carried]
    for depth in range(len(levels) - 1, -1, -1):
        found = levels[depth].filter("n = 1").join(tops, "tree").select(*kept, "path")
        if above is not None:
            inner = levels[depth].filter("n > 1").selectExpr("*", f"idx div {arity} AS _up")
            upper = above.selectExpr("tree", "idx AS _up", *carried, "path AS _rest")
            found = found.union(inner.join(upper, ["tree", "_up"]).selectExpr(
                *kept, "concat(array(struct(before, after)), _rest) AS path"))
        above = stored(found, f"merkle-path-{depth}") if depth and depth % STORE_EVERY == 0 else found
    return above


def manifest(docs: DataFrame, leaf: Column, group: str = "source", key: str = "doc_id", keep: dict[str, Column] | None = None,
             arity: int = ARITY) -> DataFrame:
    """One row per row: the key, ``keep``, ``leaf``, ``subroot`` (of its group), ``root`` and ``path``: the siblings
    ``before`` and ``after`` at every level from the leaf to the root."""
    keep = keep or {}
    rows = docs.select(F.col(f"`{group}`").alias("_group"), F.col(f"`{key}`").alias("_key"), leaf.alias("digest"),
                       *[c.alias(f"_keep{i}") for i, c in enumerate(keep.values())],
                       F.monotonically_increasing_id().alias("_tie"))
    order = [F.asc_nulls_first(c) for c in ("_group", "_key", "digest", "_tie")]
    numbered = stored(number_rows(rows, order, "_number").drop("_tie"), "merkle-rows")
    groups = numbered.groupBy("_group").agg(F.min("_number").alias("_first"), F.count("*").alias("n"))
    trees = stored(number_rows(groups, [F.asc_nulls_first("_group")], "tree", total="_trees"), "merkle-trees")
    placed = stored(numbered.join(trees.withColumnRenamed("_group", "_same"), F.col("_group").eqNullSafe(F.col("_same"))).select(
        "tree", (F.col("_number") - F.col("_first")).alias("idx"), "n", "_key", "digest",
        *[f"_keep{i}" for i in range(len(keep))]), "merkle-leaves")

    n_trees, largest = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    levels = _levels(placed.select("tree", "idx", "n", "digest"), largest, arity)
    subroots = reduce(DataFrame.union, [level.filter("n = 1").select("tree", "digest") for level in levels])
    top = _levels(subroots.join(trees, "tree").select(
        F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("idx"), F.col("_trees").alias("n"), "digest"),
                  n_trees, arity)
    no_steps = F.expr("cast(array() as array<struct<before:string,after:string>>)")
    root = top[-1].filter("n = 1").select("tree", F.col("digest").alias("root"), no_steps.alias("path"))
    tops = stored(_paths(top, root, arity).select((F.col("idx") + 1).alias("tree"), F.col("digest").alias("subroot"), "root",
                                                  "path"), "merkle-top")

    proofs = _paths(levels, tops, arity).withColumnRenamed("digest", "leaf")
    kept = placed.select("tree", "idx", F.col("_key").alias(key), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])
    return kept.join(proofs, ["tree", "idx"]).drop("tree", "idx")


def oracle(fields: tuple[str, ...], changed: str) -> str:
    """The query's rows in SQL; ``changed`` is the tampered text."""
    def h(text: str) -> str:
        parts = [f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in (*fields, text)]
        return f"sha256({' || '.join(parts)})"

    def sides(of: str, tree: str) -> str:
        return f"""
SELECT a.l, {tree} AS tree, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
       coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
FROM {of} a JOIN {of} b ON a.l = b.l AND a.tree = b.tree AND a.i // {ARITY} = b.i // {ARITY}
WHERE a.n > 1 GROUP BY ALL"""

    def grown(of: str) -> str:
        return (f"SELECT l + 1, tree, i // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(d, '' ORDER BY i))"
                f" FROM {of} WHERE n > 1 GROUP BY l, tree, i // {ARITY}, (n + {ARITY - 1}) // {ARITY}")

    return f"""
WITH RECURSIVE leaves AS (SELECT row_number() OVER () AS r, doc_id, source, {h("text")} AS leaf, {h(changed)} AS changed
                          FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n
             FROM leaves),
up AS (SELECT 0 AS l, tree, i, n, leaf AS d FROM numbered UNION ALL {grown("up")}),
above AS (SELECT 0 AS l, 0::BIGINT AS tree, tree AS i, count(*) OVER () AS n, d FROM up WHERE n = 1
          UNION ALL {grown("above")}),
sides AS ({sides("up", "a.tree")}), sides_above AS ({sides("above", "a.tree")}),
steps AS (SELECT r, l, before, after FROM numbered x JOIN sides s ON s.tree = x.tree AND s.i = x.i // ({ARITY} ** s.l)::BIGINT
          UNION ALL SELECT r, 1000 + l, before, after FROM numbered x
                    JOIN sides_above s ON s.i = x.tree // ({ARITY} ** s.l)::BIGINT),
path AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY l) - 1 AS k FROM steps),
folded AS (SELECT r, 0 AS k, changed AS d FROM leaves
           UNION ALL SELECT f.r, f.k + 1, sha256(before || d || after) FROM folded f JOIN path USING (r, k)),
ends AS (SELECT r, arg_max(d, k) AS folded_root FROM folded GROUP BY r),
proofs AS (SELECT r, string_agg(before || after, '' ORDER BY k) AS text FROM path GROUP BY r),
subroots AS (SELECT tree, d AS subroot FROM up WHERE n = 1), root AS (SELECT d AS root FROM above WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proofs.text, '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM numbered JOIN ends USING (r) JOIN subroots USING (tree) CROSS JOIN root LEFT JOIN proofs USING (r)
"""
