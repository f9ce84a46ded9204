"""Graph operators on an edge table (src, dst, ...): neighbours, bounded closures, rank, dispatch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyql.session import held, release, stage

#: Groups of a member whose lists are put together by one task.
MANY = 50_000
#: Bytes of packed lists that are taken at a time, and members of a node in one row at most.
AT_ONCE, LONGEST = 1 << 18, 1 << 20
#: Nodes whose ranks are broadcast, the longest stretch of ids that a task sums over, and tasks a core that read the edges.
BROADCAST_NODES, SPAN, TASKS_A_CORE = 1_000_000, 1 << 22, 2


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in"))


def callers(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """In-edges of all definitions of a name."""
    targets = symbols.where(F.col("n") == name).select(F.col("sym_id").alias("dst"))
    return edges.join(targets, "dst", "left_semi")


def callees(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Out-edges of the first definition of a name."""
    first = symbols.where(F.col("n") == name).agg(F.min("sym_id").alias("src"))
    return edges.join(F.broadcast(first), "src", "left_semi")


def impact(edges: DataFrame, seeds: DataFrame, depth: int, keep_seeds: bool = False) -> DataFrame:
    """(sym_id, depth, family) of what reaches the seeds (sym_id) backwards within depth levels.

    edges may carry family (``call``/``type``); a node keeps the family of its first discovery, calls
    before types. Levels are written to the shared folder, so a lost executor costs one level at most.
    """
    e = edges if "family" in edges.columns else edges.withColumn("family", F.lit("call"))
    e = stage(e.select("src", "dst", "family").distinct(), "edges")
    seen = seeds.select("sym_id").distinct()
    frontier, levels = seen, []
    for d in range(1, depth + 1):
        step = e.join(frontier.withColumnRenamed("sym_id", "dst"), "dst").groupBy(F.col("src").alias("sym_id")).agg(F.min("family").alias("family"))
        level = stage(step.join(seen, "sym_id", "left_anti").select("sym_id", F.lit(d).alias("depth"), "family"), "level")
        levels.append(level)
        frontier = level.select("sym_id")
        seen = seen.union(frontier)
        if frontier.isEmpty():
            break
    none = seen.where("false").select("sym_id", F.lit(0).alias("depth"), F.lit("call").alias("family"))
    out = reduce(lambda a, b: a.unionByName(b), levels) if levels else none
    if keep_seeds:
        out = out.unionByName(seeds.select("sym_id", F.lit(0).alias("depth"), F.lit("call").alias("family")))
    return out


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers of 64 bits in seven bits a byte, the last byte of each below 128; and how many bytes each takes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = np.where(size[has] > k + 1, 128, 0)
        out[at[has] + k] = (values[has] >> np.uint64(7 * k) & np.uint64(127)) | more.astype(np.uint64)
    return out, size


def _unpacked(src: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all members, how many of each list) of lists that are packed as steps, the first one from src."""
    more = np.flatnonzero(data > 127)
    parts = (data & 127).astype(np.uint64)
    if len(more):
        opens = np.diff(more, prepend=-2) != 1
        nth = more - more[opens][np.cumsum(opens) - 1] + 1
        parts[more + 1] <<= (7 * nth).astype(np.uint64)
    # sums over all bytes, less what came before a list; 64 bits wrap around alike on the way there and back
    total = np.cumsum(parts, out=parts)
    before = np.concatenate([np.zeros(1, np.uint64), total])[offsets[:-1]]
    n = np.diff(offsets)
    if len(more):
        ends = np.flatnonzero(data < 128)
        total, n = total[ends], np.diff(np.searchsorted(ends, offsets))
    total += np.repeat(src.astype(np.int64).view(np.uint64) - before, n)
    return total.view(np.int64), n


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each value begins and the last one ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8), offsets - offsets[0]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of AT_ONCE bytes or so each, one row at least."""
    part = (np.cumsum(sizes) - sizes) // AT_ONCE
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(src, members, how many of each) of packed lists, so many at a time that they are AT_ONCE bytes or so."""
    for batch in batches:
        if batch.num_rows:
            src, (data, offsets) = batch.column("src").to_numpy(), _bytes(batch.column("later"))
            for i, j in _slices(np.diff(offsets)):
                yield src[i:j], *_unpacked(src[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _row(src: int, members: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows (src, n, later) of one node: its ascending members as packed steps, LONGEST in a row at most."""
    for i in range(0, len(members), LONGEST):
        m = members[i : i + LONGEST]
        data, _ = _packed(np.diff(m, prepend=np.int64(src)).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([src], pa.int64()), pa.array([len(m)], pa.int64()), pa.array([data.tobytes()], pa.binary())], ["src", "n", "later"])


def _gathered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of AT_ONCE bytes or so."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row.nbytes
        if size > AT_ONCE or len(held) >= 1_000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _fan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, part, later): for each member of an ascending list but the last, those after it; a list is packed once, and what follows a member is its end."""
    for batch in batches:
        lists = batch.column("all")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(values):
            continue
        data, size = _packed(np.diff(values, prepend=values[:1]).view(np.uint64))
        at = np.concatenate([[0], np.cumsum(size)])
        n = np.diff(offsets)
        end, part = np.repeat(at[offsets[1:]], n), np.repeat(batch.column("part").to_numpy(), n)
        rows = np.flatnonzero(at[1:] < end)
        begin, length = at[1:][rows], (end - at[1:])[rows]
        for i, j in _slices(length) if len(rows) else ():
            to = np.cumsum(length[i:j])
            index = np.repeat(begin[i:j] - (to - length[i:j]), length[i:j]) + np.arange(to[-1])
            later = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.concatenate([[0], to]).astype(np.int32)), pa.py_buffer(data[index])])
            yield pa.RecordBatch.from_arrays([pa.array(values[rows[i:j]]), pa.array(part[rows[i:j]]), later], ["src", "part", "later"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, n, later) of rows (src, later) in src's order: the members of all lists of a node, once each."""

    def rows() -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        for src, members, n in _lists(batches):
            cuts = np.flatnonzero(np.diff(src)) + 1
            at = np.concatenate([[0], np.cumsum(n)])
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(src)], strict=True):
                if src[i] != last:
                    if held:
                        yield from _row(last, np.unique(np.concatenate(held)))
                    last, held, size = int(src[i]), [], 0
                held.append(members[at[i] : at[j]])
                size += at[j] - at[i]
                if size > AT_ONCE and len(held) > 1:
                    # no more than twice the members that are different
                    held = [np.unique(np.concatenate(held))]
                    size = 0
        if held:
            yield from _row(last, np.unique(np.concatenate(held)))

    yield from _gathered(rows())


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, n, later) of edges (src, dst) in order, each as often as it is there."""

    def rows() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = batch.column("src").to_numpy(), batch.column("dst").to_numpy()
            cuts = np.flatnonzero(np.diff(src)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(src)], strict=True) if len(src) else ():
                yield from _row(int(src[i]), dst[i:j])

    yield from _gathered(rows())


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst) of packed lists."""
    for src, members, n in _lists(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(src, n)), pa.array(members)], ["src", "dst"])


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dst, got): sums of what each node gives (given) to every member of its lists. Ids that lie in one stretch of SPAN are
    summed over the whole task, others over AT_ONCE bytes of lists."""
    low, total = 0, np.empty(0)

    def out(dst: np.ndarray, got: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(dst), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(dst[i : i + 100_000]), pa.array(got[i : i + 100_000])], ["dst", "got"])

    given: list[np.ndarray] = []

    def seen() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # rows come back in the same order, in slices
            given[:] = [batch.column("given").to_numpy()]
            yield batch

    for src, members, n in _lists(seen()):
        own, given[0] = np.repeat(given[0][: len(src)], n), given[0][len(src) :]
        if not len(members):
            continue
        first, last = int(members.min()), int(members.max())
        if len(total):
            first, last = min(first, low), max(last, low + len(total) - 1)
        if last - first >= SPAN:
            ids, where = np.unique(members, return_inverse=True)
            yield from out(ids, np.bincount(where, own, len(ids)))
            continue
        if last - first >= len(total):
            # twice as long at least, so that it is seldom copied
            longer = max(last - first + 1, min(2 * len(total), SPAN))
            wider = np.zeros(longer)
            wider[low - first : low - first + len(total)] = total
            low, total = first, wider
        members -= low
        np.add.at(total, members, own)
    # what got nothing is as good as absent
    kept = np.flatnonzero(total)
    yield from out(kept + low, total[kept])


def lists_within(groups: DataFrame) -> DataFrame:
    """(src, n, later): for each member of a group the n greater members of all its groups, once each, from (group, member).

    Pairs are never rows. A group's members are one ascending list; a member gets what follows it there as packed steps (a byte or two
    a member), and its lists are put together in id's order as they come. One of over MANY groups is put together in parts before.
    """
    groups = groups.where("group IS NOT NULL AND member IS NOT NULL").select("group", F.col("member").cast("long").alias("member"))
    often = stage(groups.groupBy("member").agg(F.ceil(F.count(F.lit(1)) / MANY).cast("int").alias("parts")).where("parts > 1"), "often")
    all_of = groups.repartition("group").groupBy("group").agg(F.sort_array(F.collect_set("member")).alias("all")).where(F.size("all") > 1)
    fan = all_of.select("all", F.xxhash64("group").alias("part")).mapInArrow(_fan, "src long, part long, later binary")
    kind = "src long, n long, later binary"
    if not often.isEmpty():
        dealt = fan.join(F.broadcast(often), F.col("src") == F.col("member"), "left").select("src", F.pmod("part", F.coalesce("parts", F.lit(1))).alias("part"), "later")
        fan = dealt.repartition("src", "part").sortWithinPartitions("src", "part").select("src", "later").mapInArrow(_joined, kind)
    return fan.select("src", "later").repartition("src").sortWithinPartitions("src").mapInArrow(_joined, kind)


def pairs_within(groups: DataFrame) -> DataFrame:
    """(src, dst), once each: src < dst that are members of one group at least, from (group, member)."""
    return lists_within(groups).select("src", "later").mapInArrow(_members, "src long, dst long")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(sym_id, rank): exactly so many rounds from 1/n; nodes without out-edges spread their rank evenly. edges are (src, dst), of
    which parallel ones count, or lists (src, n, later) as ``lists_within`` gives them.

    What nodes without out-edges spread is the same for all, as is the share that everyone gets. So the ranks of
    round t are a sum of plain walks u_0, u_1, ... (u_k: what k steps along the edges make of 1/n each), whose factors
    follow from how much of each walk ends at nodes without out-edges: one number a walk.

    Edges are written once, as packed lists, and a round reads them where they lie: what a node gives meets its lists
    by a broadcast (up to BROADCAST_NODES), a task sums what it gives to each node, and only these sums are shuffled.
    """
    spark, made = nodes.sparkSession, held(nodes.sparkSession)
    if "later" not in edges.columns:
        order = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
        edges = order.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").mapInArrow(_listed, "src long, n long, later binary")
    lists = stage(edges, "edges")
    deg = lists.groupBy(F.col("src").alias("_src")).agg(F.sum("n").alias("deg"))
    own = stage(nodes.select("sym_id").join(deg, F.col("sym_id") == F.col("_src"), "left").select("sym_id", "deg"), "own")
    n = max(own.count(), 1)
    # few tasks, as each gives a sum for every node at most
    lists = lists.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    walks = [own.select("sym_id", "deg", F.lit(1.0 / n).alias("u"))]
    for _ in range(rounds):
        gives = walks[-1].where("deg IS NOT NULL").select(F.col("sym_id").alias("src"), (F.col("u") / F.col("deg")).alias("given"))
        met = lists.select("src", "later").join(F.broadcast(gives) if n <= BROADCAST_NODES else gives, "src")
        got = met.mapInArrow(_received, "dst long, got double").select(F.col("dst").alias("sym_id"), F.lit(None).cast("long").alias("deg"), "got", F.lit(False).alias("is_node"))
        every = got.unionByName(own.withColumns({"got": F.lit(0.0), "is_node": F.lit(True)})).groupBy("sym_id").agg(F.max("deg").alias("deg"), F.sum("got").alias("u"), F.bool_or("is_node").alias("is_node"))
        walks.append(stage(every.where("is_node").select("sym_id", "deg", "u"), "walks"))
    numbered = reduce(lambda a, b: a.unionByName(b), [w.withColumn("k", F.lit(k)) for k, w in enumerate(walks)])
    ends = dict.fromkeys(range(rounds + 1), 0.0) | {k: u for k, u in numbered.where("deg IS NULL").groupBy("k").agg(F.sum("u")).collect()}
    # factors of the walks: round t is damping^t u_t and, for every round before, what all got alike in it
    given: list[float] = []
    for t in range(rounds):
        spread = damping**t * ends[t] + sum(given[t - 1 - k] * damping**k * ends[k] for k in range(t))
        given.append((1 - damping) + damping * spread)
    factor = [given[rounds - 1 - k] * damping**k for k in range(rounds)] + [damping**rounds]
    parts = [w.select("sym_id", (F.col("u") * factor[k]).alias("rank")) for k, w in enumerate(walks)]
    ranks = stage(reduce(lambda a, b: a.unionByName(b), parts).groupBy("sym_id").agg(F.sum("rank").alias("rank")), "ranks")
    release(spark, {p for p in held(spark) - made if "/ranks-" not in p})
    return ranks


def _bins(l: Column, el: Column, top: int) -> Column:
    """The dyadic bins (level, bin) that together are the lines after l up to el: two a level at most."""
    found = []
    for k in range(top + 1):
        # bins of 2^k lines: the first and the one after the last that lie inside; an odd one has no larger bin around it inside
        low, high = F.shiftright(l + (1 << k), k), F.shiftright(el + 1, k)
        at = lambda b: F.struct(F.lit(k).alias("level"), b.cast("long").alias("bin"))  # noqa: B023, E731
        found += [F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), at(low)), F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), at(high - 1))]
    return F.array_compact(F.array(*found))


def contained(hosts: DataFrame, members: DataFrame) -> DataFrame:
    """(host, member): members whose span lies within a host's of the same path, after its first line.

    An interval index: a host's lines are cut into dyadic bins, a member's first line lies in one bin of each
    level, and the two meet in an equi-join on path, level and bin, once for each host around that line.
    """
    longest = hosts.agg(F.max(F.col("el") - F.col("l"))).first()[0]
    top = int(longest or 0).bit_length()
    line = lambda c: F.col(c).cast("long")
    h = hosts.select(F.col("sym_id").alias("host"), F.col("p").alias("_p"), F.col("el").alias("h_el"), F.explode(_bins(line("l"), line("el"), top)).alias("_b"))
    m = members.select(F.col("sym_id").alias("member"), F.col("p").alias("_p"), F.col("el").alias("m_el"), F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(line("l"), k).alias("bin")) for k in range(top + 1)])).alias("_b"))
    flat = lambda df, *kept: df.select("_p", F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin"), *kept)
    return flat(h, "host", "h_el").join(flat(m, "member", "m_el"), ["_p", "_level", "_bin"]).where("m_el <= h_el").select("host", "member")


def container_chains(symbols: DataFrame, containers: DataFrame | None = None, most: int = 40) -> DataFrame:
    """(sym_id, q): the names of the spans around a symbol, outermost first, and its own, joined by ``::``; at most so many around it, the nearest.

    containers: the symbols that count as such (all). A symbol with none around it has its name alone.
    """
    c = symbols if containers is None else containers
    around = contained(c, symbols).join(c.select(F.col("sym_id").alias("host"), F.col("l").alias("h_l"), F.col("el").alias("h_el"), F.col("n").alias("h_n")), "host")
    order = F.struct("h_l", (-F.col("h_el")).alias("h_end"), "host", "h_n")
    above = around.groupBy(F.col("member").alias("sym_id")).agg(F.sort_array(F.collect_list(order)).alias("above"))
    nearest = F.slice("above", F.greatest(F.size("above") - most + 1, F.lit(1)), F.lit(most))
    return symbols.join(above, "sym_id", "left").select("sym_id", F.concat_ws("::", F.transform(nearest, lambda x: x["h_n"]), "n").alias("q"))


def dispatch(symbols: DataFrame) -> DataFrame:
    """(method, provider): trait methods and the methods of the same name in impls of that trait (tr)."""
    methods = symbols.where(F.col("t").isin("fn", "method"))
    names = methods.select(F.col("sym_id").alias("member"), "n")
    traits = symbols.where("t = 'trait'")
    declared = contained(traits, methods).join(traits.select(F.col("sym_id").alias("host"), F.col("n").alias("trait")), "host").join(names, "member")
    first = Window.partitionBy("trait", "n").orderBy("member")
    declared = declared.withColumn("r", F.row_number().over(first)).where("r = 1").select("trait", "n", F.col("member").alias("method"))
    impls = symbols.where("t = 'impl' AND tr IS NOT NULL")
    given = contained(impls, methods).join(impls.select(F.col("sym_id").alias("host"), F.col("tr").alias("trait")), "host").join(names, "member")
    return declared.join(given, ["trait", "n"]).where("method <> member").select("method", F.col("member").alias("provider")).distinct()


def _trimmed(e: DataFrame) -> DataFrame:
    """The edges (a, b) whose first node has an edge to it, and whose second one an edge from it: no others lie on cycles."""
    return e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi")


def _grown(start: DataFrame, step: Callable[[DataFrame], DataFrame], total: Callable[[DataFrame], Column]) -> DataFrame:
    """step over and over, each table written, until total of it stays."""
    now, before = stage(start, "grown"), None
    while (size := now.agg(total(now)).first()[0]) != before:
        now, before = stage(step(now), "grown"), size
    return now


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b) that lie on cycles; a component is named by its least node.

    Rounds of linear tables, no closure. First nodes without an edge to or from them are trimmed, and nodes with one edge
    to them and one from them are folded into an edge past them (those with a lesser hash than both neighbours, so that
    no two of them touch): long chains and rings vanish in logarithmically many rounds. In what is left each
    node takes the least name that reaches it, and what reaches that name back inside its colour is a component;
    the rest goes on. At last folded nodes are put back: into the component of both neighbours, if it is one.
    """
    every = stage(edges.select("a", "b").distinct(), "links")
    loops = [every.where("a = b").select(F.col("a").alias("node"))]
    e, size, folds, r = every.where("a <> b"), -1, [], 0
    while (now := e.count()) not in (0, size) or folds and folds[-1][1]:
        size, r = now, r + 1
        e = stage(_trimmed(e), "links")
        ends = e.groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("n_in"), F.min("a").alias("u")).join(e.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("n_out"), F.min("b").alias("w")), "v")
        least = lambda x: F.struct(F.xxhash64(F.col("v"), F.lit(r)), F.col("v")) < F.struct(F.xxhash64(F.col(x), F.lit(r)), F.col(x))  # noqa: B023, E731
        picked = stage(ends.where("n_in = 1 AND n_out = 1").where(least("u") & least("w")).select("v", "u", "w"), "folds")
        folds.append((picked, picked.count()))
        loops.append(picked.where("u = w").select(F.col("u").alias("node")))
        gone = picked.select("v")
        kept = e.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b")
        e = stage(kept.unionByName(picked.where("u <> w").select(F.col("u").alias("a"), F.col("w").alias("b"))).distinct(), "links")
    found = [e.where("false").select(F.col("a").alias("node"), F.col("a").alias("component"))]
    while not e.isEmpty():
        names = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct().withColumn("color", F.col("node"))

        def forward(c: DataFrame) -> DataFrame:
            met = e.join(c.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "color")  # noqa: B023
            return c.unionByName(met).groupBy("node").agg(F.min("color").alias("color"))

        # colours only fall: the number of nodes that have their own name, with the sum of hashes, tells when they stay
        color = _grown(names, forward, lambda c: F.struct(F.sum((F.col("node") == F.col("color")).cast("int")), F.bit_xor(F.xxhash64("node", "color"))))
        both = e.join(color.select(F.col("node").alias("a"), "color"), "a").join(color.select(F.col("node").alias("b"), F.col("color").alias("b_color")), "b")
        inside = stage(both.where("color = b_color").select("a", "b", "color"), "links")
        back = lambda x: x.unionByName(inside.join(x.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "color")).distinct()  # noqa: B023, E731
        members = _grown(color.where("node = color"), back, lambda x: F.count(F.lit(1)))
        found.append(members.select("node", F.col("color").alias("component")))
        gone = members.select("node")
        rest = inside.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
        e = stage(_trimmed(rest), "links")
    all_found = reduce(lambda a, b: a.unionByName(b), found)
    several = all_found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    rings = all_found.join(several, "component", "left_semi").select("node", "component")
    alone = reduce(lambda a, b: a.unionByName(b), loops).distinct().join(rings.select("node"), "node", "left_anti")
    known = stage(rings.unionByName(alone.select("node", F.col("node").alias("component"))), "components")
    for picked, n in reversed(folds):
        if n:
            of = lambda x: known.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))  # noqa: B023, E731
            inner = stage(picked.join(of("u"), "u").join(of("w"), "w").where("c_u = c_w").select(F.col("v").alias("node"), F.col("c_u").alias("component")), "components")
            known = stage(known.join(inner.select("node"), "node", "left_anti").unionByName(inner), "components")
    return known.groupBy("component").agg(F.min("node").alias("least")).join(known, "component").select("node", F.col("least").alias("component"))


def tree(symbols: DataFrame, ranks: DataFrame, top: int = 40, each: int = 8) -> DataFrame:
    """Files by the rank of their best member, with up to each members by rank."""
    x = symbols.join(ranks, "sym_id")
    best = x.groupBy("p").agg(F.max("rank").alias("best")).orderBy(F.col("best").desc(), "p").limit(top)
    w = Window.partitionBy("p").orderBy(F.col("rank").desc(), "sym_id")
    return x.join(F.broadcast(best), "p").withColumn("position", F.row_number().over(w)).where(F.col("position") <= each)
