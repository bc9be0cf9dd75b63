"""Merkle manifest of a table, kept as a persistent tree that copies paths.

Leaves are digests of rows, made in one pass by built-in functions; texts never move. Per source, leaves ascend by doc_id;
runs of three nodes become one until one is left, the subroot, and subroots by source make the root likewise.

* Places. Leaves are dealt by ranges of (source, doc_id, leaf), so that a source with a third of all rows spreads over
  tasks; each task numbers its own, and sums over tasks turn these numbers into places.
* Blocks. SIZE = 3 ** DEPTH aligned leaves are one row: their subtree of DEPTH levels is built in one go. Tops of blocks
  are the leaves of the next level's blocks, and so on: log_SIZE(n) rounds, each a stored table (Forest.levels).
* Paths. From the top down each block hands every child the siblings up to the root: a row for each block of leaves.
* Versions. A changed leaf makes a version: copies of its ancestors inside its block, then, along the block's path, of
  those in upper blocks. Everything else is shared with the base tree and never copied, so versions are dealt with their
  blocks and no upper block meets more than its own children. nodes_at() reads a version: its copies over the base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.common import partitions, stored, table, tidy

ARITY, DEPTH = 3, 6
#: Leaves of a block.
SIZE = ARITY**DEPTH
PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def raised(nodes: list[str], rounds: int | None) -> list[list[str]]:
    """Levels above nodes: so many rounds, or until one node is left."""
    levels = [nodes]
    while len(levels) <= rounds if rounds is not None else len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest("".join(low[i : i + ARITY])) for i in range(0, len(low), ARITY)])
    return levels


def siblings(levels: list[list[str]], i: int) -> list[dict]:
    """What stands left and right of node i and of its ancestors in their runs, below the last level."""
    out = []
    for level in levels[:-1]:
        start = i - i % ARITY
        out.append({"left": "".join(level[start:i]), "right": "".join(level[i + 1 : start + ARITY])})
        i //= ARITY
    return out


def copies(leaf: str, path: Sequence[dict]) -> list[str]:
    """The leaf and its ancestors up to the root, made anew from the siblings that they share with the base tree."""
    out = [leaf]
    for step in path:
        out.append(digest(step["left"] + out[-1] + step["right"]))
    return out


def rounds_of(n: int) -> int | None:
    """How often a block of a level of n nodes is raised: whole blocks' height if there are several."""
    return DEPTH if n > SIZE else None


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(documents: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, changed) of each row: tree stands for the source, in the order of sources with null first;
    changed is the leaf after the text has lost its line feeds, null where the row isn't tampered with: a null doc_id
    never is."""
    doc_id, source, lang, text = documents["doc_id"].cast("long"), documents["source"].cast("string"), documents["lang"].cast("string"), documents["text"].cast("string")
    head = [field(c) for c in (doc_id, source, lang, documents["n_chars"].cast("long"))]
    leaf = lambda t: F.sha2(F.concat(*head, field(t)), 256)
    tampered = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 2 == 0
    return documents.select(F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("tree"), doc_id.alias("doc_id"), leaf(text).alias("leaf"), F.when(tampered, leaf(F.replace(text, F.lit("\n"), F.lit("")))).alias("changed"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows of a stored table with (at, n): the place of each in its tree, by order, and the size of the tree.

    Equal rows are told apart by their place in the stored table, so that copies of one row spread over tasks too.
    """
    keys = ["tree", *order, "tie"]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(partitions(rows.sparkSession, rows), *keys).sortWithinPartitions(*keys).drop("tie")
    names = [*rows.columns, "part", "own"]

    def run(batches):
        part, tree, own = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            numbers = []
            for t in batch.column("tree").to_pylist():
                own = own + 1 if t == tree else 0
                tree = t
                numbers.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(numbers, pa.int64())], names=names)

    numbered = stored(ordered.mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", part int, own long"))
    held = numbered.groupBy("tree", "part").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("tree", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy("tree")).alias("n"))
    return numbered.join(before, ["tree", "part"]).select(*rows.columns, (F.col("before") + F.col("own")).alias("at"), "n")


def blocks(nodes: DataFrame, own: list[str]) -> DataFrame:
    """(tree, block, n, hashes, own columns, top) of nodes (tree, at, n, hash, own): a row for each aligned block, whose
    lists are in order of places and no longer than SIZE."""
    base = stored(nodes)
    dealt = base.withColumn("block", F.expr(f"at div {SIZE}")).repartition(partitions(base.sparkSession, base), "tree", "block", "n")
    rows = dealt.groupBy("tree", "block", "n").agg(F.sort_array(F.collect_list(F.struct("at", "hash", *own))).alias("nodes"))
    lists = rows.select("tree", "block", "n", F.col("nodes.hash").alias("hashes"), *(F.col(f"nodes.{c}").alias(c) for c in own))
    names = [*lists.columns, "top"]

    def run(batches):
        for batch in batches:
            tops = [raised(h, rounds_of(n))[-1][0] for h, n in zip(batch.column("hashes").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], names=names)

    return stored(lists.mapInArrow(tidy(run), ", ".join(f"`{n}` {t}" for n, t in lists.dtypes) + ", top string"))


@dataclass
class Forest:
    """Trees over nodes (tree, at, n, hash) in levels of blocks; own columns stay beside the leaves."""

    levels: list[DataFrame]

    @classmethod
    def grown(cls, nodes: DataFrame, own: list[str]) -> Forest:
        levels: list[DataFrame] = []
        while True:
            levels.append(blocks(nodes, own if not levels else []))
            if not levels[-1].agg(F.max("block")).first()[0]:
                return cls(levels)
            nodes = levels[-1].where(F.col("n") > SIZE).select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / SIZE).cast("long").alias("n"), F.col("top").alias("hash"))

    def roots(self) -> DataFrame:
        """(tree, root)."""
        whole = [t.where(F.col("n") <= SIZE).select("tree", F.col("top").alias("root")) for t in self.levels]
        out = whole[0]
        for more in whole[1:]:
            out = out.unionByName(more)
        return out

    def with_paths(self) -> DataFrame:
        """The blocks of leaves beside path, the siblings of their tops up to the root of the tree."""

        def down(batches):
            for batch in batches:
                trees, firsts, paths = [], [], []
                for tree, block, n, hashes, path in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "hashes", "path")), strict=True):
                    levels = raised(hashes, rounds_of(n))
                    trees += [tree] * len(hashes)
                    firsts += range(block * SIZE, block * SIZE + len(hashes))
                    paths += [siblings(levels, i) + path for i in range(len(hashes))]
                yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array(firsts, pa.int64()), pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))], names=["tree", "block", "path"])

        none, above = F.array().cast(PATH), None
        for t in reversed(self.levels):
            if above is None:
                met = t.withColumn("path", none)
            else:
                met = t.repartition(partitions(t.sparkSession, t), "tree", "block").join(above, ["tree", "block"], "left").withColumn("path", F.coalesce("path", none))
            above = met.select("tree", "block", "n", "hashes", "path").mapInArrow(tidy(down), f"tree string, block long, path {PATH}")
        return met

    def nodes(self) -> DataFrame:
        """(tree, level, at, hash) of the base tree: every node from the leaves (level 0) to the roots."""

        def run(batches):
            for batch in batches:
                rows = []
                for tree, block, n, low, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for k, level in enumerate(raised(hashes, rounds_of(n))):
                        if k or not low:  # the leaves of an upper level are the tops of the level below
                            rows += [(tree, low + k, block * ARITY ** (DEPTH - k) + i, h) for i, h in enumerate(level)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))], names=["tree", "level", "at", "hash"])

        out = None
        for k, t in enumerate(self.levels):
            own = t.select("tree", "block", "n", F.lit(k * DEPTH).alias("low"), "hashes").mapInArrow(tidy(run), "tree string, level int, at long, hash string")
            out = own if out is None else out.unionByName(own)
        return out

    def versions(self, changed: str = "changed") -> DataFrame:
        """(tree, version, level, at, hash): the nodes that each version copies. A version is a leaf whose column changed
        isn't null, and is named by its place."""

        def run(batches):
            for batch in batches:
                rows = []
                for tree, block, n, hashes, new, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    levels = raised(hashes, rounds_of(n))
                    for i, leaf in enumerate(new):
                        if leaf is not None:
                            at = block * SIZE + i
                            rows += [(tree, at, k, at // ARITY**k, h) for k, h in enumerate(copies(leaf, siblings(levels, i) + path))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["tree", "version", "level", "at", "hash"])

        return self.with_paths().select("tree", "block", "n", "hashes", changed, "path").mapInArrow(tidy(run), "tree string, version long, level int, at long, hash string")

    def nodes_at(self, tree: str, version: int) -> DataFrame:
        """(level, at, hash) of one tree as a version has it: its own copies, all other nodes shared with the base."""
        own = self.versions().where((F.col("tree") == tree) & (F.col("version") == version)).select("level", "at", F.col("hash").alias("copy"))
        return self.nodes().where(F.col("tree") == tree).join(own, ["level", "at"], "left").select("level", "at", F.coalesce("copy", "hash").alias("hash"))


def forest_of(documents: DataFrame) -> Forest:
    """A tree for each source, named '' for null and '=' with the source otherwise."""
    nodes = placed(stored(leaves(documents)), ["doc_id", "leaf"])
    return Forest.grown(nodes.withColumnRenamed("leaf", "hash"), ["doc_id", "changed"])


def manifest(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, depth) of every row of documents.

    proof_sha256 digests all siblings up to the root, folded_root is the root of the leaf's version (of the base where
    the row isn't tampered with), depth the number of nodes above the leaf. Rows of one doc_id follow each other by leaf;
    rows that repeat whole are leaves of their own; a null doc_id comes first and isn't tampered with; null and empty
    values have leaves of their own. A lone leaf is its source's subroot, a lone subroot the root. An empty table gives
    no rows. Columns other than the five are never read.
    """
    sources = forest_of(documents)
    tops = stored(sources.roots().withColumnRenamed("root", "subroot"))
    named = placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), F.col("subroot").alias("hash")), ["source_tree"])
    upper = Forest.grown(named, ["source_tree"])

    def along(batches):
        for batch in batches:
            rows = []
            for own, n, hashes, trees, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels = raised(hashes, rounds_of(n))
                rows += [(own, t, h, siblings(levels, i) + path) for i, (t, h) in enumerate(zip(trees, hashes, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)] + [pa.array([r[3] for r in rows], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))], names=["upper", "tree", "subroot", "rest"])

    root = upper.roots().select(F.col("tree").alias("upper"), "root")
    ways = upper.with_paths().select("tree", "n", "hashes", "source_tree", "path").mapInArrow(tidy(along), f"upper string, tree string, subroot string, rest {PATH}").join(root, "upper").drop("upper")

    def run(batches):
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "depth"]
        for batch in batches:
            for n, hashes, ids, changed, path, subroot, rest, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels, proofs, folded, depth = raised(hashes, rounds_of(n)), [], [], 0
                for i, (leaf, new) in enumerate(zip(hashes, changed, strict=True)):
                    way = siblings(levels, i) + path + rest
                    proofs.append(digest("".join(s["left"] + s["right"] for s in way)))
                    folded.append(copies(leaf if new is None else new, way)[-1])
                    depth = len(way)
                m = len(hashes)
                columns = [pa.array(ids, pa.int64()), hashes, [subroot] * m, [top] * m, proofs, folded, [f == top for f in folded], pa.array([depth] * m, pa.int32())]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    met = sources.with_paths().join(ways, "tree").select("n", "hashes", "doc_id", "changed", "path", "subroot", "rest", "root")
    return met.mapInArrow(tidy(run), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, depth int")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _levels_sql(name: str, start: str, rounds: int) -> str:
    """Levels of start (tree, i, h, n) and runs of each: name_k and name_runs_k."""
    out = [f"{name}_0 AS ({start})"]
    for k in range(rounds):
        out.append(f"{name}_runs_{k} AS (SELECT tree, i // 3 AS run, list(h ORDER BY i) AS hs FROM {name}_{k} WHERE n > 1 GROUP BY tree, i // 3)")
        out.append(f"{name}_{k + 1} AS (SELECT tree, i // 3 AS i, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (n + 2) // 3 AS n FROM {name}_{k} GROUP BY tree, i // 3, n)")
    return ",\n".join(out)


def _folds_sql(name: str, levels: str, start: str, tree: str, rounds: int) -> str:
    """start (r, ..., i, proof, cur) folded along the runs of levels."""
    out = [f"{name}_0 AS ({start})"]
    for k in range(rounds):
        left, right = f"array_to_string(hs[1:i % 3], '')", "array_to_string(hs[i % 3 + 2:], '')"
        out.append(f"{name}_{k + 1} AS (SELECT p.* REPLACE (i // 3 AS i, proof || CASE WHEN hs IS NULL THEN '' ELSE {left} || {right} END AS proof, CASE WHEN hs IS NULL THEN cur ELSE sha256({left} || cur || {right}) END AS cur) FROM {name}_{k} p LEFT JOIN {levels}_runs_{k} g ON g.tree = {tree} AND g.run = p.i // 3)")
    return ",\n".join(out)


#: Rounds that the SQL takes: sources of up to 3 ** 12 rows, 3 ** 7 sources.
_LOW, _HIGH = 12, 7
#: crc32 of decimal text in SQL, by bytes: the table's entries follow from the polynomial.
CRC_SQL = """crc_steps AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8, beside a row of crc_table."""
    hexed = f"hex(encode({text}))"
    return f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(len({hexed}) // 2), lambda b: CAST(CAST('0x' || substr({hexed}, CAST(2 * b + 1 AS BIGINT), 2) AS INTEGER) AS BIGINT))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"


def _field_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR) END"


_HEAD_SQL = " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))
OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, sha256({_HEAD_SQL} || {_field_sql("text")}) AS leaf,
  CASE WHEN doc_id IS NULL THEN NULL WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN sha256({_HEAD_SQL} || {_field_sql("replace(text, chr(10), '')")}) END AS changed FROM documents, crc_table),
a AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_levels_sql("low", "SELECT tree, i, leaf AS h, n FROM a", _LOW)},
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low_{_LOW} WHERE i = 0),
{_levels_sql("high", "SELECT '' AS tree, i, h, n FROM subroots", _HIGH)},
{_folds_sql("up", "low", "SELECT r, doc_id, tree, leaf, i, '' AS proof, coalesce(changed, leaf) AS cur FROM a", "p.tree", _LOW)},
{_folds_sql("top", "high", f"SELECT up_{_LOW}.r, doc_id, leaf, subroots.h AS subroot, subroots.i AS i, proof, cur FROM up_{_LOW} JOIN subroots USING (tree)", "''", _HIGH)},
depths AS (SELECT a.r, (SELECT count(*) FROM range({_LOW}) t(k) WHERE a.n > pow(3, k)) + (SELECT count(*) FROM range({_HIGH}) t(k), (SELECT count(*) AS m FROM subroots) WHERE m > pow(3, k)) AS depth FROM a)
SELECT doc_id, leaf, subroot, high_{_HIGH}.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = high_{_HIGH}.h AS verified, CAST(depth AS INTEGER) AS depth
FROM top_{_HIGH}, high_{_HIGH}, depths WHERE depths.r = top_{_HIGH}.r
"""
