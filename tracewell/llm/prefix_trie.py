"""Operator 13: the prefix trie of conversations, its subtree totals by parallel tree contraction.

* Turns are numbered by range partitions (``operators.running``), so a conversation of any length is
  several tasks' work. A turn's content is a digest; a prefix is known by running sums of its turns'
  hashed (digest, place), 128 bits in four lanes, again block by block.
* Nodes are the distinct prefixes, named by their smallest member and depth.
* Contraction: each round rakes all leaves into their parents, then compresses unary nodes whose coin
  is heads and whose parent's is tails: their child goes to their parent and carries on its edge what
  the node held. Coins are the bits of the depth, which halve a fresh chain each round, then hashes of
  the node, which take a quarter of any chain. A node knows its only child by the exclusive or of its
  children, so every join is by a node's own name: no join has a hot key. Rounds are logarithmic
  in the depth.
* Expansion goes back through the rounds: a compressed node's total is what it held and its child's.
* Members that end at a node are packed into runs of up to 256 sorted ids and hashed by an iterator
  over sorted runs, so a node of any number of members needs no list of them in memory.

Defined results: rows without a conv_id take no part; turns of equal number are ordered by role, then
text (their first 64 and 200 characters, then a digest of both); repeated rows are turns like others; an
empty table has no nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import numbered, running
from .common import ship, stash

LANES = [f"k{i}" for i in range(4)]
ABOVE = [f"p{i}" for i in range(4)]
BLOCK, RUN_BITS = 4096, 8


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars): each conversation's turns from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    own = own.select("conv_id", "turn", F.substring("role", 1, 64).alias("r"), F.substring("text", 1, 200).alias("t"), digest.alias("digest"), F.length("text").cast("long").alias("chars"))
    return numbered(own, ["conv_id"], ["turn", "r", "t", "digest"], "place", ["conv_id", "digest", "chars"])


def respliced(turns: DataFrame, head: Column, every: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first ``head`` turns (a bounded number, of conv_id) of the conversation
    whose id is the next multiple of ``every`` towards zero, then the own ones after the first ``head``. Returns
    turns with column ``last``, and (conv_id, length) of all conversations, turnless ones too."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = counts.select("conv_id", "n", base.alias("base"), head.cast("long").alias("head"))
    bases = counts.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0)))
    convs = stash(convs.select("conv_id", "base", "head", "taken", "length"), "conversations")
    first = turns.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    taken = first.join(convs, "base").where(F.col("place") <= F.col("taken")).select("conv_id", "place", "digest", "chars", "length")
    own = turns.where(F.col("place") > head).join(convs.select("conv_id", "head", "taken", "length"), "conv_id")
    own = own.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "digest", "chars", "length")
    rows = taken.unionByName(own).withColumn("last", F.col("place") == F.col("length")).drop("length")
    return rows, convs.select("conv_id", "length")


def nodes_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, chars, n_children, only_conv, ends_sha256) of each node."""
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"), (F.col("length") == 0).alias("last"))
    rows = turns.unionByName(roots)
    word = lambda seed: F.when(F.col("place") > 0, F.xxhash64("digest", "place", F.lit(seed))).otherwise(F.lit(0))
    half = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    rows = rows.withColumns({"w0": word(1), "w1": word(2)})
    rows = rows.select("conv_id", F.col("place").alias("depth"), "chars", "last", half(F.shiftrightunsigned("w0", 32)).alias("l0"), half(F.col("w0")).alias("l1"), half(F.shiftrightunsigned("w1", 32)).alias("l2"), half(F.col("w1")).alias("l3"))
    block = F.expr(f"(depth - 1) div {BLOCK}")
    rows = running(rows, ["conv_id"], block, ["depth"], {k: F.col(f"l{i}") for i, k in enumerate(LANES)})
    rows = stash(rows.withColumns({p: F.col(k) - F.col(f"l{i}") for i, (k, p) in enumerate(zip(LANES, ABOVE))}).drop("l0", "l1", "l2", "l3"), "prefixes")
    of = ["depth", *LANES]
    nodes = rows.groupBy(*of).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *(F.max(p).alias(p) for p in ABOVE))
    hashed = ends(rows.where("last").select(*of, "conv_id"), of)
    nodes = stash(nodes.join(hashed, of, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))), "nodes")
    under = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *(F.col(p).alias(k) for p, k in zip(ABOVE, LANES)))
    under = under.agg(F.count("*").alias("n_children"), F.bit_xor("conv_id").alias("only_conv"))
    over = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(k).alias(p) for p, k in zip(ABOVE, LANES)), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(under, of, "left").join(over, ["depth", *ABOVE], "left")  # a parent of many children: Spark splits it
    return stash(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "chars", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("only_conv", F.lit(0)).alias("only_conv"), "ends_sha256"), "nodes")


def ends(members: DataFrame, of: list[str]) -> DataFrame:
    """(of, ends_sha256): SHA-256 of each node's members, rising, comma-joined."""
    ship(members.sparkSession)
    cut = members.repartitionByRange(*of, "conv_id").sortWithinPartitions(*of, "conv_id").withColumn("run", F.monotonically_increasing_id())
    runs = cut.groupBy(*of, F.shiftright("run", RUN_BITS).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    runs = runs.repartition(*of).sortWithinPartitions(*of, "run")

    def digest(batches):
        now, sha = None, None
        for b in batches:
            done = []
            for row in zip(*(b.column(c).to_pylist() for c in range(len(of))), b.column(len(of) + 1)):
                if row[:-1] != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = row[:-1], hashlib.sha256(row[-1].as_py().encode())
                else:
                    sha.update(b"," + row[-1].as_py().encode())
            yield as_batch(done)
        yield as_batch([(*now, sha.hexdigest())] if now is not None else [])

    def as_batch(done):
        columns = list(zip(*done)) or [[]] * (len(of) + 1)
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names=[*of, "ends_sha256"])

    return runs.mapInArrow(digest, ", ".join([*(f"{c} long" for c in of), "ends_sha256 string"]))


ID, UP, ONLY = ["conv_id", "depth"], ["up_conv", "up_depth"], ["only_conv", "only_depth"]
ALIVE, RAKED, COMPRESSED = 0, 1, 2


def contract(nodes: DataFrame) -> tuple[list[DataFrame], list[dict]]:
    """Rounds until the root alone is left. nodes: conv_id, depth, up_conv, up_depth, kids, only_conv,
    only_depth and the node's own ``leaves`` and ``saved``. Each round's table holds what is alive after
    it, what it raked (with final totals) and what it compressed (up_*: the child whose total is to be
    added); and the number of each kind."""
    zero = F.lit(0).cast("long")
    alive = nodes.withColumns({"edge_leaves": zero, "edge_saved": zero, "named": F.lit(False), "kind": F.lit(ALIVE)})
    bits = (nodes.agg(F.max("depth")).first()[0] or 0).bit_length()
    rounds, sizes, left = [alive], [], nodes.where("depth > 0").limit(1).count()
    while left:
        out = stash(_round(rounds[-1].where(F.col("kind") == ALIVE), len(sizes), bits), "round")
        sizes.append({r["kind"]: r["n"] for r in out.groupBy("kind").agg(F.count("*").alias("n")).collect()})
        rounds.append(out)
        left = sizes[-1].get(ALIVE, 0) > 1
    return rounds, sizes


def _round(alive: DataFrame, number: int, bits: int) -> DataFrame:
    names = alive.columns
    leaf = (F.col("kids") == 0) & (F.col("depth") > 0)
    raked = alive.where(leaf)
    given = raked.groupBy(*(F.col(u).alias(i) for u, i in zip(UP, ID))).agg(
        F.sum(F.col("leaves") + F.col("edge_leaves")).alias("d_leaves"), F.sum(F.col("saved") + F.col("edge_saved")).alias("d_saved"),
        F.count("*").alias("gone"), F.bit_xor("conv_id").alias("x_conv"), F.bit_xor("depth").alias("x_depth"))
    kept = alive.where(~leaf).join(given, ID, "left")
    some = lambda c: F.coalesce(c, F.lit(0))
    kept = kept.withColumns({
        "leaves": F.col("leaves") + some("d_leaves"), "saved": F.col("saved") + some("d_saved"), "kids": F.col("kids") - some("gone"),
        "only_conv": F.col("only_conv").bitwiseXOR(some("x_conv")), "only_depth": F.col("only_depth").bitwiseXOR(some("x_depth"))}).select(*names)

    def coin(conv: str, depth: str) -> Column:
        return F.shiftright(depth, number) % 2 if number < bits else F.pmod(F.xxhash64(conv, depth, F.lit(number)), F.lit(2))

    chosen = (F.col("kids") == 1) & (F.col("depth") > 0) & (coin(*ID) == 1) & (coin(*UP) == 0)
    cut = kept.where(chosen)
    via = F.struct(*UP, F.col("conv_id").alias("conv"), F.col("depth").alias("d"), "leaves", "saved", "edge_leaves", "edge_saved", F.col("named").alias("was_named"))
    to_child = cut.select(F.col("only_conv").alias("conv_id"), F.col("only_depth").alias("depth"), via.alias("via"), F.lit(0).cast("long").alias("x_conv"), F.lit(0).cast("long").alias("x_depth"))
    swap = [F.col(o).bitwiseXOR(F.col(i)).alias(x) for o, i, x in zip(ONLY, ID, ["x_conv", "x_depth"])]
    to_parent = cut.select(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth"), F.lit(None).cast(to_child.schema["via"].dataType).alias("via"), *swap)
    told = to_child.unionByName(to_parent).groupBy(*ID).agg(F.max("via").alias("via"), F.bit_xor("x_conv").alias("x_conv"), F.bit_xor("x_depth").alias("x_depth"))
    rest = kept.where(~chosen).join(told, ID, "left")
    rest = rest.withColumns({"only_conv": F.col("only_conv").bitwiseXOR(some("x_conv")), "only_depth": F.col("only_depth").bitwiseXOR(some("x_depth"))})
    went = F.col("via").isNotNull()
    pick = lambda a, b: F.when(went, a).otherwise(F.col(b)).alias(b)
    moved = {"up_conv": F.col("via.up_conv"), "up_depth": F.col("via.up_depth"), "edge_leaves": F.col("edge_leaves") + F.col("via.leaves") + F.col("via.edge_leaves"), "edge_saved": F.col("edge_saved") + F.col("via.saved") + F.col("via.edge_saved"), "named": F.lit(True)}
    still = F.struct(*(pick(moved[c], c) if c in moved else F.col(c) for c in names))
    held = {
        "conv_id": F.col("via.conv"), "depth": F.col("via.d"), "up_conv": F.col("conv_id"), "up_depth": F.col("depth"), "kids": F.lit(1).cast("long"), "leaves": F.col("via.leaves") + F.col("edge_leaves"),
        "saved": F.col("via.saved") + F.col("edge_saved"), "named": F.col("via.was_named"), "kind": F.lit(COMPRESSED)}
    gone = F.struct(*((held[c] if c in held else F.col(c)).alias(c) for c in names))
    both = rest.select(F.explode(F.when(went, F.array(still, gone)).otherwise(F.array(still))).alias("n")).select("n.*")
    return both.unionByName(raked.withColumn("kind", F.lit(RAKED)))


def expand(rounds: list[DataFrame], sizes: list[dict]) -> DataFrame:
    """(conv_id, depth, leaves, saved): the totals of all nodes."""
    cols = [*ID, "leaves", "saved", "named"]
    totals = [rounds[-1].where(F.col("kind") == ALIVE).select(*cols)]  # the root
    for r, n in zip(reversed(rounds[1:]), reversed(sizes)):
        if n.get(COMPRESSED):
            known = totals[0]
            for t in totals[1:]:
                known = known.unionByName(t)
            known = known.where("named").select(F.col("conv_id").alias("up_conv"), F.col("depth").alias("up_depth"), F.col("leaves").alias("c_leaves"), F.col("saved").alias("c_saved"))
            own = r.where(F.col("kind") == COMPRESSED).join(known, UP)
            own = own.withColumns({"leaves": F.col("leaves") + F.col("c_leaves"), "saved": F.col("saved") + F.col("c_saved")})
            totals.append(stash(own.select(*cols), "expanded"))
        totals.append(r.where(F.col("kind") == RAKED).select(*cols))
    out = totals[0]
    for t in totals[1:]:
        out = out.unionByName(t)
    return out.drop("named")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node. turns: conv_id, place (from 1), digest, chars, last; convs: conv_id, length."""
    nodes = nodes_of(turns, convs)
    up = F.col("depth") - 1
    start = nodes.select(*ID, F.coalesce("parent_conv_id", F.lit(0)).alias("up_conv"), up.alias("up_depth"), F.col("n_children").alias("kids"), "only_conv",
        F.when((F.col("n_children") % 2) == 1, F.col("depth") + 1).otherwise(F.lit(0)).cast("long").alias("only_depth"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    totals = expand(*contract(start))
    out = nodes.join(totals, ID)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
