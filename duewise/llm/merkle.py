"""Merkle manifest of a dataset: one leaf per row, one subtree per group, one root over the subtrees, a proof for every row.

A group's leaves are numbered in order. Nodes of level l are the rows whose number is a multiple of 3^l, so a tree needs no
tables of its own below a block of ``LEVELS`` levels: rows are dealt by (group, number div 3^LEVELS), which never cuts a run
of three, and one window in number order serves all levels of the block. On each level lag and lead columns at the fixed
offsets 3^l and 2 * 3^l, masked by the node's slot in its run and by the run's length, are its siblings; the row of a run's
first child hashes the parent. The last siblings seen at or before a row are those of its own ancestor. A block's top nodes
are the leaves of the next block, a 729th of the rows; subroots in group order are the leaves of the tree above. Proofs come
back down, joined block by block.

No task holds more than 3^LEVELS rows of a group's block at once, whatever the size of a group, and only numbers of levels
reach the driver. Ranked rows and the tops of every block are written, so a lost executor repeats at most one block.

Cases. A null group is a group of its own before all others, a null column is hashed as ``-``, a null id comes first in its
group and is never tampered with. Rows that repeat an id follow each other by their digest; equal rows are leaves of their
own. A lone leaf is its group's subroot, a lone subroot is the root, and with neither siblings nor levels a proof is the
digest of nothing. Texts of any length are hashed whole. Columns that are not named take no part, whatever they are called.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duewise.llm.common import materialise
from duewise.llm.ranks import ranked

FAN = 3
#: Levels that one window serves; 3^6 = 729 rows of a group are together in a task.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(docs: DataFrame, fields: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    return digest(*[field((changed or {}).get(c, docs[c])) for c in fields])


def _levels(rows: DataFrame) -> DataFrame:
    """rows (key, idx, n, digest) with chunk, up (before and after of each level's siblings, from below) and top (at first rows)."""
    chunk = F.expr(f"idx div {FAN ** LEVELS}")
    inside = Window.partitionBy("key", "chunk").orderBy("idx")
    out = rows.withColumn("chunk", chunk).withColumn("_h0", F.col("digest"))
    for level in range(LEVELS):
        step, h = FAN**level, F.col(f"_h{level}")
        count = F.expr(f"(n + {step - 1}) div {step}")
        slot = F.expr(f"idx div {step} % {FAN}")
        run = F.least(F.lit(FAN), count - (F.expr(f"idx div {step}") - slot))
        first, none = F.col("idx") % step == 0, F.lit("")
        before = [F.when(slot >= k, F.lag(h, k * step).over(inside)).otherwise(none) for k in range(FAN - 1, 0, -1)]
        after = [F.when(slot + k < run, F.lead(h, k * step).over(inside)).otherwise(none) for k in range(1, FAN)]
        out = out.withColumns({"_before": F.concat(*before), "_after": F.concat(*after)})
        parent = F.when(count > 1, digest(h, F.col("_after"))).otherwise(h)
        out = out.withColumns({
            f"_s{level}": F.when(first & (count > 1), F.struct(F.col("_before").alias("before"), F.col("_after").alias("after"))),
            f"_h{level + 1}": F.when(F.col("idx") % (step * FAN) == 0, parent),
        })
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"_s{level}": F.last(f"_s{level}", ignorenulls=True).over(so_far) for level in range(LEVELS)})
    up = F.filter(F.array(*[f"_s{level}" for level in range(LEVELS)]), lambda s: s.isNotNull())
    return out.select(*rows.columns, "chunk", up.alias("up"), F.col(f"_h{LEVELS}").alias("top"))


def _climb(rows: DataFrame, name: str) -> list[DataFrame]:
    """The leaves and the tops of each block above them; the last holds one node a key."""
    tables, size = [rows], FAN**LEVELS
    while True:
        tops = _levels(tables[-1]).where(F.col("idx") % size == 0)
        tops = tops.select("key", F.col("chunk").alias("idx"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("digest"))
        tables.append(materialise(tops, name))
        if (tables[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return tables


def _descend(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first of ``tables`` with proof; ``above`` gives key, proof and more columns for each key's last node."""
    carried = above.withColumn("idx", F.lit(0).cast("long"))
    for rows in reversed(tables[:-1]):
        own = _levels(rows).drop("top")
        held = carried.select(*[F.col(c).alias({"idx": "chunk", "proof": "_proof"}.get(c, c)) for c in carried.columns])
        carried = own.join(held, ["key", "chunk"]).withColumn("proof", F.concat("up", "_proof")).drop("up", "_proof", "chunk")
        if rows is not tables[0]:
            carried = carried.drop("n", "digest")
    return carried


def manifest(rows: DataFrame) -> DataFrame:
    """Rows (key: group name that holds no null and sorts as the groups do, order, digest, any others) with subroot, root, proof.

    proof lists, from the leaf up, the digests before and after the node in its run.
    """
    leaves = materialise(ranked(rows, "key", ["order", "digest"], "merkle-dealt"), "merkle-leaves")
    trees = _climb(leaves, "merkle-tops")
    subroots = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    groups = materialise(ranked(subroots, "key", ["group"], "merkle-groups-dealt"), "merkle-groups")
    forest = _climb(groups, "merkle-roots")
    root = forest[-1].select("key", F.col("digest").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("proof"))
    roots = _descend(forest, root).select(F.col("group").alias("key"), F.col("digest").alias("subroot"), "root", "proof")
    return _descend(trees, roots)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def proof_text(proof: Column) -> Column:
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def verified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; line feeds go from texts whose id has an even crc32."""
    own = docs.select(*FIELDS)
    source = F.col("source")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    leaf = leaf_digest(own, FIELDS)
    altered = leaf_digest(own, FIELDS, {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})
    rows = materialise(own.select(
        F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("key"), F.col("doc_id").alias("order"), leaf.alias("digest"),
        F.when(even & F.contains(F.col("text"), F.lit("\n")), altered).alias("altered"),
    ), "merkle-digests")
    out = manifest(rows).withColumn("folded_root", folded(F.coalesce("altered", "digest"), F.col("proof")))
    return out.select(
        F.col("order").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_tree(name: str, leaves: str, key: str, depth: int) -> list[str]:
    """Levels of a tree as plain grouped strings, up to 3^depth leaves of a key."""
    parts = [f"{name}0 AS (SELECT {key} AS k, i, n, h FROM {leaves})"]
    for l in range(depth):
        parts.append(
            f"{name}{l + 1} AS (SELECT k, i // 3 AS i, (max(n) + 2) // 3 AS n, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, "
            f"max(n) AS was, list(h ORDER BY i) AS run FROM {name}{l} GROUP BY k, i // 3)"
        )
    steps = ", ".join(
        f"CASE WHEN x{l + 1}.was > 1 THEN {{'b': array_to_string(x{l + 1}.run[1:(b.i // {3 ** l}) % 3], ''), 'a': array_to_string(x{l + 1}.run[(b.i // {3 ** l}) % 3 + 2:], '')}} END"
        for l in range(depth)
    )
    joins = " ".join(f"JOIN {name}{l + 1} x{l + 1} ON x{l + 1}.k = b.k AND x{l + 1}.i = b.i // {3 ** (l + 1)}" for l in range(depth))
    parts.append(f"{name}p AS (SELECT b.k, b.i, x{depth}.h AS top, list_filter([{steps}], lambda s: s IS NOT NULL) AS proof FROM {name}0 b {joins})")
    return parts


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def oracle(depth: int = 14, group_depth: int = 6) -> str:
    """DuckDB SQL for up to 3^depth rows of a source and 3^group_depth sources."""
    plain = " || ".join(_sql_field(c) for c in FIELDS)
    altered = " || ".join(_sql_field("replace(text, chr(10), '')" if c == "text" else c) for c in FIELDS)
    bits = "flatten(list_transform(range(1, length(s) + 1), lambda j: [ascii(s[j]), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, e: xor(xor(c, e) >> 1, CASE WHEN xor(c, e) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
    parts = [
        f"d AS (SELECT *, coalesce('1' || source, '0') AS k, CAST(doc_id AS VARCHAR) AS s, sha256({plain}) AS h, sha256({altered}) AS g FROM documents)",
        f"leaves AS (SELECT *, CASE WHEN {crc} % 2 = 0 THEN g ELSE h END AS w, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d)",
        *_sql_tree("t", "leaves", "k", depth),
        "subs AS (SELECT k AS grp, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT k, top AS h FROM tp))",
        *_sql_tree("r", "subs", "0", group_depth),
        "joined AS (SELECT l.doc_id, l.h AS leaf, l.w, tp.top AS subroot, rp.top AS root, list_concat(tp.proof, rp.proof) AS proof FROM leaves l "
        "JOIN tp ON tp.k = l.k AND tp.i = l.i JOIN subs ON subs.grp = l.k JOIN rp ON rp.i = subs.i)",
        "folds AS (SELECT *, list_reduce(list_prepend({'b': w, 'a': ''}, proof), lambda x, s: {'b': sha256(s.b || x.b || s.a), 'a': ''}).b AS folded_root FROM joined)",
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda s: s.b || s.a), '')) AS proof_sha256, "
        "folded_root, folded_root = root AS verified FROM folds"
    )


ORACLE = oracle()
