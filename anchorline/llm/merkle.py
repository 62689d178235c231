"""A Merkle manifest of a dataset: one hash tree per group of rows, one over the groups, and a proof for every row.

A node's digest is the sha256, in hex, of its children's digests. Rows of a group stand in ascending order of their key;
on each level every two consecutive nodes get a parent, the last one alone if their number is odd, until one is left.

1. Rows are hashed where they lie; texts are never moved. Digests are spread by ranges of (group, key), so a group
   of any size covers many partitions, and a row's position is its place in its partition plus the rows before it.
2. A block holds up to 2**BLOCK_BITS neighbouring nodes of a group, with their digests as one string of hex digits, 64 a
   node. A parent is the hash of the 128 digits at its children's place, so the next level is such a string again:
   substrings of fixed width are all that is needed, up to the top of the block.
3. The tops of the blocks are the nodes of the next round. Every round is stored, and 2**BLOCK_BITS times smaller than
   the one before. The roots of the groups are in the end the nodes of one more tree.
4. From the root down, a block adds to the path above it the digits that flank each of its nodes on every level: the
   siblings of that node.

All of it is SQL: hashes, substrings and array functions. Nothing passes through the driver but the number of rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorline.llm.frames import parts
from anchorline.session import cut_lineage, stored_small

BLOCK_BITS = 10
ROWS_PER_PART = 200_000
HEX = 64
PART_SHIFT = 33  # monotonically_increasing_id has the partition above these bits


def encoded(value: str | Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; a null is a dash."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[str | Column]) -> Column:
    """Digest of a row's values, each encoded so that no two rows read alike."""
    return F.sha2(F.concat(*[encoded(c) if isinstance(c, str) else c for c in columns]).cast("binary"), 256)


def group_key(column: str) -> Column:
    """A group's name as a key that is never null; a null name sorts first."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _placed(rows: DataFrame, total: int, order: list[str]) -> DataFrame:
    """Add ``pos``, the place of a row in its group ``g`` in ascending ``order``, and ``n``, the group's size.

    Rows alike in all of ``order`` stand in any order, and no range is too large for them as the row's number spreads
    them too.
    """
    keys = ["g", *order, "__row"]
    ranged = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts(total, ROWS_PER_PART), *keys)
    sorted_rows = ranged.sortWithinPartitions(*keys).drop("__row")
    held = cut_lineage(sorted_rows.withColumn("__at", F.monotonically_increasing_id()))
    held = held.withColumn("__part", F.shiftright("__at", PART_SHIFT))
    runs = held.groupBy("g", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "g", "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy("g")).alias("n"),
    )
    return held.join(stored_small(starts), ["g", "__part"]).select(
        "g", (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"), "n", *[c for c in rows.columns if c != "g"]
    )


_PARENT = """cast(array_join(transform(sequence(0, cast((length({x}) - 1) div 128 as int)),
    i -> sha2(substring({x}, i * 128 + 1, 128), 256)), '') as binary)"""
_LEVELS = f"""aggregate(array_repeat(0, height), array(cast(array_join(members.digest, '') as binary)),
    (held, step) -> concat(held, array({_PARENT.format(x="element_at(held, -1)")})))"""
_SIBLINGS = """transform(slice(levels, 1, height),
    (level, up) -> cast(substring(level, (shiftright(cast(m.pos & {mask} as int), up) ^ 1) * 64 + 1, 64) as string))"""


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """Blocks of neighbouring nodes, with a string of digits for every level and the digest at their top.

    In a group of several blocks all have the full height, so that the last one's top, however few nodes it has, stands
    on the same level as the others'.
    """
    block = F.shiftright("pos", bits).alias("block")
    member = F.struct("pos", *[c for c in nodes.columns if c not in ("g", "pos", "n")])
    grouped = nodes.groupBy("g", "n", block).agg(F.sort_array(F.collect_list(member)).alias("members"))
    height = F.when(F.col("n") > 1 << bits, bits).when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    levels = grouped.withColumn("height", height.cast("int")).withColumn("levels", F.expr(_LEVELS))
    return cut_lineage(levels.withColumn("top", F.element_at("levels", -1).cast("string")))


def _climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The blocks of every round, up to one block per group."""
    rounds = []
    while True:
        rounds.append(_blocks(nodes, bits))
        most = rounds[-1].agg(F.max("n")).first()[0]
        if most is None or most <= 1 << bits:
            return rounds
        many = F.shiftright(F.col("n") - 1, bits) + 1
        nodes = rounds[-1].select("g", F.col("block").alias("pos"), many.alias("n"), F.col("top").alias("digest"))


def _descend(rounds: list[DataFrame], bits: int) -> DataFrame:
    """The nodes of the first round, each with ``path``: its sibling on every level, empty where it has none."""
    above = None
    for number, blocks in reversed(list(enumerate(rounds))):
        if above is None:
            known = blocks.withColumn("above", F.array().cast("array<string>"))
        else:
            known = blocks.join(above.select("g", F.col("pos").alias("block"), F.col("path").alias("above")), ["g", "block"])
        kept = [c for c in blocks.schema["members"].dataType.elementType.names] if number == 0 else ["pos"]
        fields = ", ".join(f"'{c}', m.{c}" for c in kept)
        siblings = _SIBLINGS.format(mask=(1 << bits) - 1)
        above = known.select("g", F.expr(f"inline(transform(members, m -> named_struct({fields}, 'path', concat({siblings}, above))))"))
    return above


def folded(start: Column, path: Column, pos: Column) -> Column:
    """The digest at the top of a path, from the digest at its foot and the foot's position."""
    steps = F.transform(path, lambda sibling, up: F.struct(sibling.alias("sibling"), up.alias("up")))

    def rise(digest: Column, step: Column) -> Column:
        right = F.call_function("shiftright", pos, step["up"]).bitwiseAND(F.lit(1)) == 1
        both = F.when(right, F.concat(step["sibling"], digest)).otherwise(F.concat(digest, step["sibling"]))
        return F.sha2(both.cast("binary"), 256)

    return F.aggregate(steps, start, rise)


@dataclass
class Manifest:
    """``rows``: g, pos, path and the columns given to ``build_manifest``, ``digest`` among them. ``groups``: g,
    subroot, g_pos, g_path, root; one row per group."""

    rows: DataFrame
    groups: DataFrame

    def proofs(self) -> DataFrame:
        """Every row with its group's columns."""
        return self.rows.join(self.groups, "g")

    def root(self) -> str | None:
        first = self.groups.first()
        return first["root"] if first else None


def proof_digest() -> Column:
    """Digest of all siblings of a row of ``Manifest.proofs``, from its own level to the root."""
    return F.sha2(F.concat(F.array_join("path", ""), F.array_join("g_path", "")).cast("binary"), 256)


def folded_root(digest: Column) -> Column:
    """The root that ``digest`` leads to in the place of a row of ``Manifest.proofs``."""
    return folded(folded(digest, F.col("path"), F.col("pos")), F.col("g_path"), F.col("g_pos"))


def build_manifest(rows: DataFrame, order: list[str], bits: int = BLOCK_BITS) -> Manifest:
    """The trees over rows with ``g`` (a string that is not null), ``digest`` and the columns of ``order``.

    Nulls in ``order`` come first, and rows alike in it are ordered by their digest. An empty table has no rows, no
    groups and no root.
    """
    held = cut_lineage(rows)
    rounds = _climb(_placed(held, held.count(), [*order, "digest"]), bits)
    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("digest"))
    upper = _climb(_placed(subroots, subroots.count(), ["name"]), bits)
    root = stored_small(upper[-1].select("g", F.col("top").alias("root")))
    groups = _descend(upper, bits).join(root, "g").select(
        F.col("name").alias("g"), F.col("digest").alias("subroot"), F.col("pos").alias("g_pos"),
        F.col("path").alias("g_path"), "root",
    )
    return Manifest(_descend(rounds, bits), stored_small(groups))


def document_manifest(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The manifest of documents: groups by lang, null first, rows in order of doc_id, null first.

    A leaf is the digest of doc_id, source, lang, n_chars and text. ``changed`` may give another digest for some rows (null
    for the others), say of a copy to be verified; it is carried along as ``changed``. Rows that repeat are leaves
    of their own; columns beyond these five play no part.
    """
    digest = leaf_digest(["doc_id", "source", "lang", "n_chars", "text"])
    other = (F.lit(None) if changed is None else changed).cast("string")
    return build_manifest(docs.select(group_key("lang").alias("g"), "doc_id", digest.alias("digest"), other.alias("changed")), ["doc_id"])
