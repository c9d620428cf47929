"""Parent-child rows to full hierarchies: path, depth, root, subtree sizes, descendants and cycles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrow import map_partition
from corpusloom.session import materialize

#: Rounds that are planned as one job before the state is written and the lineage cut.
ROUNDS_PER_JOB = 6
#: Unpeeled nodes that one task may hold: as soon as no more are left it peels them to the end, in the same rounds.
ONE_TASK = 1_000_000
CYCLE = "cycle"
#: An ancestor that more nodes than this ask at once is split in SALTS.
HOT_CHILDREN = 50_000
SALTS = 32


def latest_edges(df: DataFrame, id_col: str = "id", parent_col: str = "parent_domain_id", order_col: str = "updated_at") -> DataFrame:
    """``(id, parent)``: of each id the row with the latest ``order_col``; a parent that is no id is null.

    Rows with a null id are dropped.  A null ``order_col`` is the oldest; among equal ones the row
    with the largest parent stands, null last.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"), F.col(order_col).cast("string").alias("at")).filter("id IS NOT NULL")
    last = rows.groupBy("id").agg(F.max(F.struct(F.coalesce("at", F.lit("")).alias("at"), F.col("parent").isNotNull().alias("has"), "parent")).alias("x")).select("id", F.col("x.parent").alias("parent"))
    known = last.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return last.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def peel(edges: DataFrame, rounds_per_job: int = ROUNDS_PER_JOB) -> DataFrame:
    """``(id, parent, peel_round, subtree_size)`` by bottom-up leaf peeling.

    In each round the nodes without unpeeled children leave and send their subtree sizes to their
    parents: every node gives its own row and, as it leaves, one message, and the rows of an id are
    added up.  So a round is one shuffle, and a job is a plain chain of them.  Only the nodes that have not
    left go on to the next job; the others stay in the table that the job wrote.  What is left when no
    node leaves lies on a cycle: its peel_round is null, and its subtree_size counts the peeled trees
    that hang on it and itself.
    """
    one = F.lit(1).cast("long")
    # A message is a row of the parent: one child less to wait for, and the child's subtree.
    children = edges.filter("parent IS NOT NULL").select(F.col("parent").alias("id"), F.lit(None).cast("long").alias("parent"), one.alias("waiting"), F.lit(0).cast("long").alias("subtree_size"))
    state = edges.select("id", "parent", F.lit(0).cast("long").alias("waiting"), one.alias("subtree_size")).unionByName(children)
    state = state.groupBy("id").agg(F.max("parent").alias("parent"), F.sum("waiting").alias("waiting"), F.sum("subtree_size").alias("subtree_size"), F.lit(0).alias("now"), F.max(F.lit(None).cast("int")).alias("peel_round"))
    left: list[DataFrame] = []
    while True:
        for _ in range(rounds_per_job):
            leaves = F.col("peel_round").isNull() & (F.col("waiting") == 0)
            own = F.struct("id", "parent", "waiting", "subtree_size", (F.col("now") + 1).alias("now"), F.when(leaves, F.col("now")).otherwise(F.col("peel_round")).alias("peel_round"))
            message = F.struct(F.col("parent").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(-1).cast("long").alias("waiting"), "subtree_size", (F.col("now") + 1).alias("now"), F.lit(None).cast("int").alias("peel_round"))
            rows = state.select(F.explode(F.when(leaves & F.col("parent").isNotNull(), F.array(own, message)).otherwise(F.array(own))).alias("x")).select("x.*")
            state = rows.groupBy("id").agg(*[f(c).alias(c) for f, c in ((F.max, "parent"), (F.sum, "waiting"), (F.sum, "subtree_size"), (F.max, "now"), (F.max, "peel_round"))])
        written = materialize(state, "peel")
        gone, state = written.filter("peel_round IS NOT NULL"), written.filter("peel_round IS NULL")
        counts = written.agg(F.count("peel_round").alias("gone"), F.count("*").alias("all")).first()
        left.append(gone)
        rest = counts["all"] - counts["gone"]
        if rest and counts["gone"] and rest <= ONE_TASK:
            state, rest = map_partition(state.repartition(1), ", ".join(f"{n} {t}" for n, t in state.dtypes), _peel_rest), 0
        if not rest or not counts["gone"]:
            out = state
            for part in left:
                out = out.unionByName(part)
            return out.drop("waiting", "now")


def _peel_rest(rows: pa.Table) -> pa.Table:
    """All further rounds of the peeling, for nodes that one task holds: in each the nodes that wait for no child leave."""
    node, waiting, size, now = (rows.column(c).to_numpy().copy() for c in ("id", "waiting", "subtree_size", "now"))
    order = np.argsort(node)
    parent = np.full(len(node), -1)
    known = np.flatnonzero(rows.column("parent").is_valid().to_numpy(zero_copy_only=False))
    wanted = rows.column("parent").drop_null().to_numpy()
    at = np.minimum(np.searchsorted(node[order], wanted), len(node) - 1)
    parent[known] = np.where(node[order][at] == wanted, order[at], -1)
    peeled = np.full(len(node), -1, np.int32)
    leaves, turn = np.flatnonzero(waiting == 0), int(now.max(initial=0))
    while len(leaves):
        peeled[leaves] = turn
        leaves = leaves[parent[leaves] >= 0]
        np.subtract.at(waiting, parent[leaves], 1)
        np.add.at(size, parent[leaves], size[leaves])
        up = np.unique(parent[leaves])
        leaves, turn = up[waiting[up] == 0], turn + 1
    new = {"waiting": pa.array(waiting), "subtree_size": pa.array(size), "peel_round": pa.array(peeled, pa.int32(), mask=peeled < 0)}
    return pa.table([new.get(name, rows.column(name)) for name in rows.schema.names], names=rows.schema.names)


def cycle_roots(residue: DataFrame) -> DataFrame:
    """``(id, root_id)``: the smallest id on each residual node's cycle, by pointer doubling.

    ``residue`` holds ``(id, parent)`` of cycle nodes only, so that every pointer stays in it; the
    smallest id seen doubles its reach each step, until no node learns of a smaller one.
    """
    state = materialize(residue.select("id", F.col("parent").alias("next"), F.least("id", "parent").alias("root_id")), "cycle")
    while True:
        other = state.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("root_id").alias("other"))
        moved = state.join(other, "next").select("id", F.col("after").alias("next"), F.least("root_id", "other").alias("root_id"), (F.col("other") < F.col("root_id")).alias("moved"))
        moved = materialize(moved, "cycle")
        if moved.filter("moved").isEmpty():
            return moved.select("id", "root_id")
        state = moved.drop("moved")


def ask(rows: DataFrame, known: DataFrame, key: str, count: int) -> DataFrame:
    """``rows``, ``count`` in number, joined with the one row of ``known`` for its ``key``; keys of more than HOT_CHILDREN rows are spread over SALTS."""
    if count <= HOT_CHILDREN:
        return rows.join(known, key)
    hot = materialize(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > HOT_CHILDREN).select(key, F.lit(True).alias("hot")), "hot")
    if hot.isEmpty():
        return rows.join(known, key)
    zero = F.lit(0).cast("long")
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(zero)
    parts = F.when(F.col("hot"), F.sequence(zero, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(zero))
    spread = known.join(hot, key, "left").withColumn("salt", F.explode(parts)).drop("hot")
    return rows.join(hot, key, "left").withColumn("salt", part).drop("hot").join(spread, [key, "salt"]).drop("salt")


def hierarchy(df: DataFrame, rounds_per_job: int = ROUNDS_PER_JOB, **names) -> DataFrame:
    """``(id, parent_id, root_id, depth, path, subtree_size, cycle_path)``: one row for each distinct id.

    ``path`` joins the ids from the root by ``/``.  On or below a cycle the root is the smallest id on
    the cycle, the depth -1 and the path ``cycle``; subtree_size counts the node and what hangs
    below it (on a cycle: the trees that hang on the node).  ``cycle_path`` joins the ids from the node
    of the cycle that a tree hangs on, and is null where there is no cycle.  Assignment goes from what was peeled last,
    roots and cycles, to what was peeled first: every peeled node holds the steps up to some ancestor and asks
    it for the steps further up, so that the reach doubles each time and a tree of depth d takes log2(d) shuffles;
    a node with all its steps is written once.  An empty input gives no rows.
    """
    peeled = materialize(peel(materialize(latest_edges(df, **names), "edges"), rounds_per_job), "peeled")
    on_cycle = peeled.filter("peel_round IS NULL").select("id", "parent")
    text, none = F.col("id").cast("string"), F.lit(None)
    done = peeled.filter("peel_round IS NOT NULL AND parent IS NULL").select("id", none.cast("long").alias("up"), text.alias("steps"), F.lit(0).cast("long").alias("depth"), F.col("id").alias("root_id"), F.lit(False).alias("ring"))
    if not on_cycle.isEmpty():
        rings = cycle_roots(on_cycle).select("id", none.cast("long").alias("up"), text.alias("steps"), F.lit(0).cast("long").alias("depth"), "root_id", F.lit(True).alias("ring"))
        done = done.unionByName(rings)
    below = peeled.filter("peel_round IS NOT NULL AND parent IS NOT NULL")
    open_ = below.select("id", F.col("parent").alias("up"), text.alias("steps"), F.lit(1).cast("long").alias("depth"), none.cast("long").alias("root_id"), none.cast("boolean").alias("ring"))
    done, open_ = materialize(done, "paths"), materialize(open_, "paths")
    while count := open_.count():
        known = done.unionByName(open_).select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("above"), F.col("depth").alias("more"), F.col("root_id").alias("root"), F.col("ring").alias("cyclic"))
        asked = ask(open_.drop("root_id", "ring"), known, "up", count)
        asked = asked.select("id", F.col("further").alias("up"), F.concat_ws("/", "above", "steps").alias("steps"), (F.col("depth") + F.col("more")).alias("depth"), F.col("root").alias("root_id"), F.col("cyclic").alias("ring"))
        asked = materialize(asked, "paths")
        done, open_ = done.unionByName(asked.filter("up IS NULL")), asked.filter("up IS NOT NULL")
    out = done.select("id", "root_id", F.when(F.col("ring"), F.lit(-1).cast("long")).otherwise(F.col("depth")).alias("depth"), F.when(F.col("ring"), F.lit(CYCLE)).otherwise(F.col("steps")).alias("path"), F.when(F.col("ring"), F.col("steps")).alias("cycle_path"))
    base = peeled.select("id", F.col("parent").alias("parent_id"), "subtree_size")
    return out.join(base, "id").select("id", "parent_id", "root_id", "depth", "path", "subtree_size", "cycle_path")


def descendants(tree: DataFrame) -> DataFrame:
    """``(ancestor_id, descendant_id, distance)`` for every node that has a path, one row per pair.

    Lists of descendants come as rows, since the list of a root may be as long as the table.
    """
    nodes = tree.filter("depth > 0").select("id", "depth", F.posexplode(F.split("path", "/")).alias("at", "ancestor"))
    return nodes.filter(F.col("at") < F.col("depth")).select(F.col("ancestor").cast("long").alias("ancestor_id"), F.col("id").alias("descendant_id"), (F.col("depth") - F.col("at")).cast("long").alias("distance"))


def all_descendants(tree: DataFrame) -> DataFrame:
    """As ``descendants``, and the pairs of the trees that hang on a cycle, up to the node of the cycle they hang on.

    Nodes of one cycle are no pairs: each is above and below the others.
    """
    steps = F.split(F.coalesce("cycle_path", "path"), "/")
    nodes = tree.select("id", (F.size(steps) - 1).alias("last"), F.posexplode(steps).alias("at", "ancestor"))
    return nodes.filter(F.col("at") < F.col("last")).select(F.col("ancestor").cast("long").alias("ancestor_id"), F.col("id").alias("descendant_id"), (F.col("last") - F.col("at")).cast("long").alias("distance"))


def cycles(tree: DataFrame) -> DataFrame:
    """``(root_id, nodes)``: each cycle with the number of nodes on or below it."""
    return tree.filter("depth = -1").groupBy("root_id").agg(F.count("*").alias("nodes"))


def found(df: DataFrame, **kw) -> DataFrame:
    """``(id, root_id, depth, path)`` of each distinct id."""
    return hierarchy(df, **kw).select("id", "root_id", "depth", "path")
