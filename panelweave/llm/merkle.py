"""A Merkle manifest of a table: for each row its leaf, the root, and the siblings that prove the one from the other.

H is the lowercase hex SHA-256 of its inputs, concatenated, digests as hex text. A leaf is H of the row's columns, each
``-`` if null, else its UTF-8 byte count, ``:`` and its text. The leaves of a group (``_`` by key, nulls first, then by
leaf, so that repeated and null keys have a place) are joined ``arity`` at a time; the last run of a level may be
shorter, a lone node still gets its H, and a level of one node is the group's subroot (a lone leaf itself). The
subroots, ordered by group (null first, UTF-8 bytewise), are joined likewise to the root.

Levels are windows partitioned by group and parent number whose ordered full-frame collect_list gives both the parent's
preimage and each child's siblings; only one row of each parent goes on to the next level. Nodes are numbered without
gaps by a scan over ranges of the order, so a group that holds most rows lies in many tasks. A shuffle serves several
levels: nodes are dealt by blocks of at most ``BLOCK`` leaves, whose windows need no further exchange, and a block's
root becomes a node of the next climb. The paths come down by joins of blocks, whose keys are unique.

Defined cases: no rows give no rows; repeated rows are leaves of their own; null texts, ids and groups count as ``-`` and
as a group; columns that are not named are left out, whatever they are called. The result has one row per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import written
from panelweave.operators.scan import numbered

#: Leaves below a block's root at most: what one row of a block carries.
BLOCK = 64
PATH = "array<struct<before:string,after:string>>"


def h(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """A column as it stands in a leaf's preimage."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _climb(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """The nodes (_group, _n nodes in it, _index, _hash, _item) joined over some levels: one row per block.

    _below has each item under it with its siblings on the way up. A group of one node stays as it is.
    """
    rows = nodes.withColumn("_block", F.floor(F.col("_index") / F.lit(arity**levels)).cast("long")).repartition("_group", "_block")
    rows = rows.withColumn("_below", F.array(F.struct("_item", F.array().cast(PATH).alias("_path")))).drop("_item")
    for _ in range(levels):
        rows = rows.withColumns({"_parent": F.floor(F.col("_index") / F.lit(arity)).cast("long"), "_many": F.col("_n") > 1})
        run = Window.partitionBy("_group", "_block", "_parent").orderBy("_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("_run", F.collect_list(F.struct("_hash", "_below")).over(run)).where(F.col("_index") % arity == 0)
        # A child's siblings are the other hashes of its run.
        step = f"array(struct(array_join(slice(_run._hash, 1, place), '') as before, array_join(slice(_run._hash, place + 2, {arity}), '') as after))"
        passed = f"transform(child._below, one -> struct(one._item as _item, if(_many, concat(one._path, {step}), one._path) as _path))"
        rows = rows.selectExpr(
            "_group",
            "_block",
            f"cast(ceil(_n / {arity}) as long) as _n",
            "_parent as _index",
            "if(_many, sha2(array_join(_run._hash, ''), 256), _hash) as _hash",
            f"flatten(transform(_run, (child, place) -> {passed})) as _below",
        )
    return rows.drop("_block")


def _tree(nodes: DataFrame, most: int, arity: int, name: str) -> list[DataFrame]:
    """Blocks of each climb from the nodes up to one node per group; ``most`` nodes are in a group at most."""
    climbs = []
    while True:
        levels = 1
        while arity ** (levels + 1) <= BLOCK and arity**levels < most:
            levels += 1
        climbs.append(written(_climb(nodes, arity, levels), name))
        most = -(-most // arity**levels)
        if most <= 1:
            return climbs
        nodes = climbs[-1].select("_group", "_n", "_index", "_hash", F.struct(F.col("_index").alias("at")).alias("_item"))


def _paths(climbs: list[DataFrame], top: DataFrame) -> DataFrame:
    """_group, _item and _up of each lowest node; ``top`` has _up (a path and more) for each group."""
    same = lambda up: F.col("_group").eqNullSafe(F.col(up))
    above = top.select(F.col("_group").alias("_top"), F.lit(0).cast("long").alias("_at"), "_up")
    for blocks in reversed(climbs):
        met = blocks.join(above, same("_top") & (F.col("_index") == F.col("_at")))
        each = met.select("_group", "_up", F.explode("_below").alias("_one"))
        up = F.col("_up").withField("path", F.concat("_one._path", "_up.path"))
        below = each.select("_group", F.col("_one._item").alias("_item"), up.alias("_up"))
        if blocks is not climbs[0]:
            above = below.select(F.col("_group").alias("_top"), F.col("_item.at").alias("_at"), "_up")
    return below


def manifest(df: DataFrame, group: str, key: str, columns: Sequence[str], arity: int = 2, also: dict[str, Column] | None = None) -> DataFrame:
    """``key``, leaf, subroot, root and path (siblings before and after on each level) of each row, with ``also``."""
    also = also or {}
    leaf = h(*(field(F.col(c)) for c in columns))
    leaves = written(df.select(F.col(group).alias("_group"), F.col(key).alias("_key"), leaf.alias("_hash"), F.struct(*(x.alias(n) for n, x in also.items()), F.lit(1).alias("here")).alias("_also")), "leaves")
    placed = numbered(leaves, ["_key", "_hash"], "_index", by=["_group"], of="_n")
    most = placed.agg(F.max("_n")).first()[0] or 0
    nodes = placed.select("_group", "_n", "_index", "_hash", F.struct("_key", F.col("_hash").alias("_leaf"), "_also").alias("_item"))
    climbs = _tree(nodes, most, arity, "blocks")
    subroots = climbs[-1].select("_group", F.col("_hash").alias("_subroot"))
    all_groups = written(numbered(subroots, ["_group"], "_index"), "subroots")
    count = all_groups.count()
    upper = _tree(all_groups.select(F.lit(0).alias("_group"), F.lit(count).cast("long").alias("_n"), "_index", F.col("_subroot").alias("_hash"), F.struct(F.col("_group").alias("group"), F.col("_subroot").alias("subroot")).alias("_item")), count, arity, "upper")
    roots = upper[-1].select("_group", F.struct(F.array().cast(PATH).alias("path"), F.col("_hash").alias("root")).alias("_up"))
    tops = _paths(upper, roots).select(F.col("_item.group").alias("_group"), F.col("_up").withField("subroot", F.col("_item.subroot")).alias("_up"))
    done = _paths(climbs, tops)
    return done.select(F.col("_item._key").alias(key), F.col("_item._leaf").alias("leaf"), F.col("_up.subroot").alias("subroot"), F.col("_up.root").alias("root"), F.col("_up.path").alias("path"), *(F.col("_item._also")[n].alias(n) for n in also))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its siblings."""
    return F.aggregate(path, leaf, lambda node, step: h(step["before"], node, step["after"]))


def proof(path: Column) -> Column:
    """H of the siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


#: The columns of a document's leaf, in order.
DOCUMENT = ("doc_id", "source", "lang", "n_chars", "text")


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: every document's proof, checked against a copy whose n_chars was raised here and there.

    A row is tampered with where 7 divides the crc32 of its decimal doc_id; a null id or count, or the largest long,
    which has no successor, stays.
    """
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    raised = F.expr("try_add(n_chars, 1)")
    other = h(*(field(F.coalesce(raised, F.col(c)) if c == "n_chars" else F.col(c)) for c in DOCUMENT))
    rows = manifest(docs, "lang", "doc_id", DOCUMENT, also={"tampered": F.when(struck, other)})
    back = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return back.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(raised: str) -> str:
    one = lambda c: f"case when {c} is null then '-' else strlen(({c})::varchar)::varchar || ':' || ({c})::varchar end"
    return "sha256(" + " || ".join(one(raised if c == "n_chars" else c) for c in DOCUMENT) + ")"


SQL = f"""
with recursive
leaves as (
  select doc_id, lang, {_sql_leaf("n_chars")} as leaf,
    case when xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [1, 2, 3, 4, 5, 6, 7, 8]::bigint[]),
          lambda r, k: case when (r & 1) = 1 then xor(r >> 1, 3988292384::bigint) else r >> 1 end)), 4294967295::bigint) % 7 = 0
      then {_sql_leaf("n_chars + 1")} end as tampered
  from documents),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaves),
up as (
  select 0 as l, lang as g, i, n, leaf as h from placed
  union all
  select l + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from up where n > 1 group by l, g, i // 2, n),
subroots as (select g, h, row_number() over (order by g nulls first) - 1 as i, count(*) over () as n from up where n = 1),
high as (
  select 0 as l, i, n, h from subroots
  union all
  select l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' order by i)) from high where n > 1 group by l, i // 2, n),
root as (select h from high where n = 1),
fold as (
  select p.lang, p.i as leaf_i, 0 as l, p.i, p.n, coalesce(p.tampered, p.leaf) as h, '' as seen from placed p
  union all
  select f.lang, f.leaf_i, f.l + 1, f.i // 2, (f.n + 1) // 2,
    sha256(case when f.i % 2 = 0 then f.h || coalesce(s.h, '') else s.h || f.h end), f.seen || coalesce(s.h, '')
  from fold f left join up s on s.l = f.l and s.g is not distinct from f.lang and s.i = xor(f.i, 1) where f.n > 1),
fold_high as (
  select f.lang, f.leaf_i, 0 as l, s.i, s.n, f.h, f.seen from fold f join subroots s on s.g is not distinct from f.lang where f.n = 1
  union all
  select f.lang, f.leaf_i, f.l + 1, f.i // 2, (f.n + 1) // 2,
    sha256(case when f.i % 2 = 0 then f.h || coalesce(s.h, '') else s.h || f.h end), f.seen || coalesce(s.h, '')
  from fold_high f left join high s on s.l = f.l and s.i = xor(f.i, 1) where f.n > 1)
select p.doc_id, p.leaf, s.h as subroot, root.h as root, sha256(f.seen) as proof_sha256, f.h as folded_root, f.h = root.h as verified
from placed p join subroots s on s.g is not distinct from p.lang join fold_high f on f.n = 1 and f.lang is not distinct from p.lang and f.leaf_i = p.i, root
"""
