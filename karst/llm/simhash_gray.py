"""SimHash near-dedup over a hierarchical index in Gray order.

A fingerprint has a bit set where more than half of the XXH64 hashes (seed 42) of the
document's word shingles have it. Fingerprints link at ``distance`` or fewer differing
bits; documents of one connected component are one group.

Index. The 64 bits are cut into ``distance + 2`` blocks; at most ``distance`` of them can
hold a difference, so linked fingerprints agree on two blocks at least. Each pair of
blocks makes a table, the uppermost pattern of the index, its value a group. Fingerprints of a
group are sorted by Gray rank (neighbours in that order differ in few bits) and cut into nodes of
``NODE`` rows at most; of each node the bits that all members share are factored out as mask and
pattern, and so for the groups of ``LEVELS`` rows below it. Two nodes meet only if their patterns
differ in no more than ``distance`` of the bits that both share; from there down the tree each pair of groups
adds the differences in the bits that it shares beyond those above, and is pruned whole once they are more than
``distance``; members of leaves add what is left. A meeting of two nodes is one bounded piece of work that yields a spanning
forest of the links, not the links. So a group of any size is split over tasks, no link
is lost, and no pairs of a group are listed.

Components are joined by alternating large-star and small-star rounds, each written to the
shared folder.

Edge cases: null, empty and wordless texts have fingerprint 0 and link to each other; fewer
words than a shingle count as one shingle; equal rows share a group; component_id ignores
null ids and is null only in a group of null ids; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .line_dedup import _one_array

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Rows of a node, and of the groups of the levels below it; the last are leaves. Pairs of leaves compared at once.
NODE, LEVELS, PAIRS = 2048, (512, 128, 32), 1024
#: What one_alike calls alike: Jaccard similarity of sets of so many words.
ALIKE, WORDS = 0.8, 5
#: Its index: differing bits of 128, tables, and bits of a table's key.
WIDE, TABLES, KEY_BITS = 28, 32, 12
#: Texts that one_alike holds against each other in one piece; the share of a large component that a further
#: round of such pieces must settle for one more to follow.
CHUNK, SETTLED = 256, 0.1
#: Buckets of the table of how common a shingle is within its component; a power of two.
BUCKETS = 1 << 20
_FLIP = np.uint64(1 << 63)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six white-space characters only
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
    else:
        words = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(words), 1 << 16):
        part = words[i : i + (1 << 16)]
        digests = np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w in part]), np.uint8)
        ones += np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(words)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _blocks(distance: int) -> list[int]:
    """Masks of distance + 2 blocks of nearly equal width."""
    n = distance + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """Place of fp in Gray order, as a signed long that sorts in that order."""
    r = fp
    for s in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, s))
    return r.bitwiseXOR(F.lit(_signed(1 << 63)))


_CHUNK = "t int, key bigint, no bigint, fps array<bigint>, mask bigint, pattern bigint"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut rows (t, key, words and id) that come in the order (t, key, Gray rank) into nodes.

    fps has the rows' words and ids one after another; a single column is word and id in one.

    A node alone in its group is left out if it has one member, unless the group may go on
    in the partition before or after.
    """
    pid, no = TaskContext.get().partitionId(), 0
    cur, parts, first, split, rows = None, [], True, False, []

    def node(key, fps):
        nonlocal no
        u = fps[:, 0].view(np.uint64)
        differ = np.bitwise_or.reduce(u ^ u[0])
        no += 1
        mask = ~differ
        return (*key, pid << 32 | no, fps.ravel(), mask.view(np.int64), (u[0] & mask).view(np.int64))

    def close(edge: bool):
        """The group of cur is over."""
        nonlocal parts, split
        fps = np.concatenate(parts)
        if len(fps) > 1 or split or edge:
            rows.append(node(cur, fps))
        parts, split = [], False

    def batch():
        cols = list(zip(*rows))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)], ["t", "key", "no", "fps", "mask", "pattern"]
        )
        rows.clear()
        return out

    for b in batches:
        t, key, *fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns))
        if not len(t):
            continue
        fp = np.stack(fp, axis=1)
        cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(t)]):
            now = (int(t[lo]), int(key[lo]))
            if cur is not None and now != cur:
                close(first)
                first = False
            cur = now
            for a in range(lo, hi, NODE):
                parts.append(fp[a : min(a + NODE, hi)])
                if sum(map(len, parts)) >= NODE:
                    rows.append(node(cur, np.concatenate(parts)))
                    parts, split = [fp[:0]], True
        if len(rows) > 1000:
            yield batch()
    if cur is not None and sum(map(len, parts)):
        close(True)
    if rows:
        yield batch()


def _levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(masks, patterns) of the groups of LEVELS rows each, coarse to fine: the bits that a group's members share."""
    out = []
    for size in LEVELS:
        starts = np.arange(0, len(x), size)
        first = x[starts]
        mask = ~np.bitwise_or.reduceat(x ^ np.repeat(first, size)[: len(x)], starts)
        out.append((mask, first & mask))
    return out


def leaf_pairs(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(leaf of x, leaf of y, bits they share, differences in those, pairs of groups pruned above the leaves).

    From the coarsest level down, a pair of groups has the differences of the pair above and, added to them, those in the
    bits that only the finer groups share; beyond distance all below goes at once.
    """
    above, pruned = None, 0
    for size, (xm, xp), (ym, yp) in zip(LEVELS, _levels(x), _levels(y)):
        if above is None:
            i, j = (k.ravel() for k in np.indices((len(xm), len(ym))))
            seen, count = np.zeros(len(i), np.uint64), np.zeros(len(i), np.int64)
        else:
            step = above // size
            i, j, seen, count = (np.repeat(k, step * step) for k in (i, j, seen, count))
            child = np.tile(np.arange(step * step), len(i) // (step * step))
            i, j = i * step + child // step, j * step + child % step
            real = (i < len(xm)) & (j < len(ym))
            i, j, seen, count = i[real], j[real], seen[real], count[real]
        shared = xm[i] & ym[j]
        count = count + np.bitwise_count((xp[i] ^ yp[j]) & shared & ~seen)
        near = count <= distance
        pruned += len(near) - int(near.sum())
        i, j, seen, count, above = i[near], j[near], shared[near], count[near], size
    return i, j, seen, count, pruned


def forest(a: np.ndarray, b: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Edges that join what links inside a (b is None), or between a and b.

    a and b: a row for each member, its words (distances add up) and its id; a single column is both.
    """
    x = a[:, : max(1, a.shape[1] - 1)]
    y = x if b is None else b[:, : x.shape[1]]
    leaf, near = LEVELS[-1], np.zeros((len(x), len(y)), bool)
    i, j, seen, count, _ = leaf_pairs(x[:, 0], y[:, 0], distance)
    member = np.arange(leaf)
    for k in range(0, len(i), PAIRS):
        # rows beyond the end stand for the last one
        r = np.minimum(i[k : k + PAIRS, None] * leaf + member, len(x) - 1)
        c = np.minimum(j[k : k + PAIRS, None] * leaf + member, len(y) - 1)
        rest = (x[r, 0][:, :, None] ^ y[c, 0][:, None, :]) & ~seen[k : k + PAIRS, None, None]
        apart = count[k : k + PAIRS, None, None] + np.bitwise_count(rest)
        for w in range(1, x.shape[1]):
            apart = apart + np.bitwise_count(x[r, w][:, :, None] ^ y[c, w][:, None, :])
        near[r[:, :, None], c[:, None, :]] = apart <= distance
    edges, free = [], np.ones(near.shape[1], bool)
    a, b = a[:, -1], None if b is None else b[:, -1]
    if b is None:
        # breadth first: each row of near is read once
        for i in range(len(a)):
            if free[i]:
                free[i] = False
                todo = [i]
                while todo:
                    hit = np.flatnonzero(near[todo.pop()] & free)
                    free[hit] = False
                    todo += hit.tolist()
                    edges += [(i, k) for k in hit.tolist()]
        return [(int(a[i]), int(a[k])) for i, k in edges]
    open_ = np.ones(len(a), bool)
    for i in range(len(a)):
        if not open_[i]:
            continue
        open_[i], rows = False, [i]
        while rows:
            hit = np.flatnonzero(near[rows.pop()] & free)
            free[hit] = False
            for k in hit.tolist():
                edges.append((int(a[i]), int(b[k])))
                more = np.flatnonzero(near[:, k] & open_)
                open_[more] = False
                rows += more.tolist()
                edges += [(int(a[m]), int(b[k])) for m in more.tolist()]
    return edges


def _edges(distance: int, two: bool, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for i in range(b.num_rows):
                x = b.column(0)[i].values.to_numpy().view(np.uint64).reshape(-1, width)
                y = b.column(1)[i].values.to_numpy().view(np.uint64).reshape(-1, width) if two else None
                found += forest(x, y, distance)
            e = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e.min(1)), pa.array(e.max(1))], ["u", "v"])

    return run


def links(fps: DataFrame, scratch: Scratch, distance: int = DISTANCE) -> DataFrame:
    """(u, v), u < v: edges with the components of the link graph of the distinct fps (fp)."""
    masks = [x | y for x, y in combinations(_blocks(distance), 2)]
    tables = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)
    ])
    return _linked(fps.select("fp", F.explode(tables).alias("g")).select("g.t", "g.key", "fp"), scratch, distance)


def _linked(rows: DataFrame, scratch: Scratch, distance: int) -> DataFrame:
    """The edges of rows (t, key, words and id)."""
    cols = rows.columns[2:]
    rank = gray_rank(F.col(cols[0]))
    nodes = scratch.keep(
        rows.repartitionByRange("t", "key", rank)
        .sortWithinPartitions("t", "key", rank)
        .select("t", "key", *cols)
        .mapInArrow(_nodes, _CHUNK)
    )
    width = len(cols)
    inside = nodes.where(F.size("fps") > width).select("fps").mapInArrow(_edges(distance, False, width), "u bigint, v bigint")
    a, b = nodes.alias("a"), nodes.alias("b")
    meet = a.join(
        b,
        F.expr(
            "a.t = b.t and a.key = b.key and a.no < b.no"
            f" and bit_count((a.pattern ^ b.pattern) & a.mask & b.mask) <= {int(distance)}"
        ),
    )
    between = meet.select(F.col("a.fps").alias("x"), F.col("b.fps").alias("y")).mapInArrow(
        _edges(distance, True, width), "u bigint, v bigint"
    )
    return inside.unionAll(between).distinct()


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): every node of the edges (u, v) with the least node of its component."""
    edges = scratch.keep(edges.where("u <> v").select("u", "v"))
    seen = None
    while True:
        # large star: larger neighbours go to the least of u and its neighbours
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, scratch.keep(small)
        scratch.drop(before)
        state = edges.agg(
            F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(u, v) as decimal(38)))")
        ).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, shingle))
    nodes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(nodes.select("fp"), scratch, distance), scratch)
    member = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "first")
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    joined = member.join(least, "root").select("fp", "least")
    # a table of its own, so that the last join is one that Spark can split where many documents share a fingerprint
    of_fp = scratch.keep(nodes.join(joined, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    scratch.drop_all_but(fps, of_fp)
    return fps.join(of_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, with one document of each group: the one with the least id.

    Of rows that share id and text one stays, of rows that share an id but not the group one for each group; rows
    without an id stay only in a group of such rows, once for each text.
    """
    groups = near_duplicates(docs.select("doc_id", "text"), distance, shingle)
    name, th, fp = fresh("kept", docs.columns), fresh("th", docs.columns), fresh("fp", docs.columns)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name), F.col("fingerprint").alias(fp))
    # the same text has the same fingerprint, so a hash of the text leads from one to the other
    texts = fingerprints(docs.select(F.xxhash64("text").alias("doc_id"), "text").dropDuplicates(["doc_id"]), shingle)
    texts = texts.select(F.col("doc_id").alias(th), F.lpad(F.lower(F.hex("fp")), 16, "0").alias(fp))
    kept = kept.distinct().join(texts, fp).select(name, th)
    own = F.col("doc_id").eqNullSafe(F.col(name)) & (F.xxhash64("text") == F.col(th))
    return docs.join(kept, own, "left_semi").dropDuplicates(["doc_id", "text"])


# --- one of each by Jaccard similarity ---------------------------------------------------------


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """128-bit hashes of the distinct word shingles of a text."""
    ws = (text or "").encode().lower().split()
    if 0 < len(ws) < words:
        ws = [b" ".join(ws)]
    elif ws:
        ws = map(b" ".join, zip(*(ws[i:] for i in range(words))))
    return {xxhash.xxh3_128_digest(w, SEED) for w in ws}


def wide_fingerprint(found: set[bytes]) -> tuple[int, int, int]:
    """(id of the set, first and second word of its 128-bit SimHash), as signed longs."""
    digests = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 16)
    ones = np.zeros(128, np.int64)
    for i in range(0, len(digests), 1 << 15):
        ones += np.unpackbits(digests[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    a, b = np.packbits(2 * ones > len(digests)).view(np.int64).tolist()
    return int(np.frombuffer(b"".join(found), np.int64).sum()), a, b


def _marks(docs: DataFrame, text: bool) -> DataFrame:
    """(doc_id, sid, a, b, and the text or its hash): the text's set of shingles and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [wide_fingerprint(shingles(t.as_py())) for t in b.column(1)]
            cols = [pa.array(c, pa.int64()) for c in zip(*marks)] or [pa.array([], pa.int64())] * 3
            last = b.column(1) if text else b.column(2)
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, last], ["doc_id", "sid", "a", "b", "text" if text else "th"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, sid bigint, a bigint, b bigint, {'text string' if text else 'th bigint'}"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, schema)


def _wide_links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges of nodes (sid, a, b) that agree on a table's bits and differ in no more than WIDE of 128."""
    rng = random.Random(SEED)
    groups = []
    for t in range(TABLES):
        x, y = ("a", "b") if t % 2 else ("b", "a")
        mask = sum(1 << k for k in rng.sample(range(64), KEY_BITS))
        key = F.col(x).bitwiseAND(F.lit(_signed(mask)))
        groups.append(F.struct(F.lit(t).alias("t"), key.alias("key"), F.col(x).alias("x"), F.col(y).alias("y"), "sid"))
    return _linked(nodes.select(F.inline(F.array(*groups))), scratch, WIDE)


def _alike(table: pa.Table) -> pa.Table:
    """(u, v) of rows (.., sid, text, place) in the order of place: u is the first row before v with Jaccard ALIKE or
    more that isn't itself a v."""
    leaders: list[tuple[int, set[bytes]]] = []
    edges = []
    places = [tuple(p.values()) for p in table.column("place").to_pylist()]
    order = sorted(range(table.num_rows), key=places.__getitem__)
    sids, texts = table.column("sid").to_pylist(), table.column("text")
    for i in order:
        x = shingles(texts[i].as_py())
        for sid, y in leaders:
            if min(len(x), len(y)) >= ALIKE * max(len(x), len(y)):
                both = len(x & y)
                if both >= ALIKE * (len(x) + len(y) - both):
                    edges.append((sid, sids[i]))
                    break
        else:
            leaders.append((sids[i], x))
    u, v = zip(*edges) if edges else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _pieces(member: DataFrame, salt: int) -> DataFrame:
    """Edges (u, v) of the rows of each piece of CHUNK rows or so of a component; count is the component's size."""
    i = F.pmod(F.xxhash64("sid", F.lit(salt)), F.ceil(F.col("count") / CHUNK))
    return member.withColumn("i", i).groupBy("root", "i").applyInArrow(_alike, "u bigint, v bigint")


def _hashed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, sid, place, text) with the text's shingles as 64-bit hashes instead of it."""
    for b in batches:
        sets = [np.frombuffer(b"".join(shingles(t.as_py())), np.int64)[::2] for t in b.column(3)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        hs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], hs], ["root", "sid", "place", "hs"])


def _earlier_alike(member: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): each row of member (root, sid, place, text) with each earlier one of its root that it is alike to.

    A set-similarity join by prefix, length and positional filters; how common a shingle is in its root comes from a table of
    fixed size, and any order gives the same links. Sets are compared by the 64-bit hashes of their shingles.
    """
    kind = member.schema["place"].dataType.simpleString()
    rows = member.select("root", "sid", "place", "text")
    rows = scratch.keep(rows.mapInArrow(_hashed_sets, f"root bigint, sid bigint, place {kind}, hs array<bigint>"))
    bucket = lambda h: F.xxhash64("root", h).bitwiseAND(F.lit(BUCKETS - 1))
    counts = rows.select("root", F.explode("hs").alias("h")).groupBy(bucket(F.col("h")).alias("id")).agg(F.count("*").alias("n"))
    common = scratch.keep(_one_array(counts.select("id", F.least(F.lit(127), F.floor(F.log2("n") * 4)).alias("c")), BUCKETS, "tinyint"))
    ranked = F.transform("hs", lambda h: F.struct(F.get("common", bucket(h).cast("int")).alias("c"), h.alias("h")))
    n = F.size("hs")
    prefix = F.slice(F.sort_array(ranked), F.lit(1), (n - F.ceil(n * ALIKE - 1e-9) + 1).cast("int"))
    # a projection of its own, into which Catalyst puts the one use of the table
    ranked = rows.withColumn("common", common.scalar()).select("root", "sid", "place", n.alias("n"), prefix.alias("p"))
    postings = ranked.select("root", "sid", "place", "n", F.posexplode("p").alias("i", "r"))
    postings = postings.select("root", F.col("r.h").alias("h"), "sid", "place", "n", "i")
    x, y = postings.alias("x"), postings.alias("y")
    near = F.expr(
        "x.root = y.root and x.h = y.h and y.place < x.place"
        f" and x.n >= {ALIKE - 1e-9} * y.n and y.n >= {ALIKE - 1e-9} * x.n"
        f" and least(x.n - x.i, y.n - y.i) >= {ALIKE / (1 + ALIKE) - 1e-9} * (x.n + y.n)"
    )
    pairs = scratch.keep(x.join(y, near).select(F.col("y.sid").alias("u"), F.col("x.sid").alias("v")).distinct())
    one = rows.select(F.col("sid").alias("v"), F.col("hs").alias("a"))
    two = rows.select(F.col("sid").alias("u"), F.col("hs").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    alike = both >= ALIKE * (F.size("a") + F.size("b") - both)
    return pairs.join(one, "v").join(two, "u").where(alike).select("u", "v")


def one_alike(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one document of each group of texts whose sets of WORDS-word shingles have
    a Jaccard similarity of ALIKE or more: the one with the least id.

    Candidates are components of 128-bit fingerprints in the Gray-order index. In a component texts are held, in the
    order of their ids, against those that stay so far, by their exact sets: in pieces of a bounded size, whose
    survivors are dealt to new pieces as long as that settles a fair share of them. Survivors of large components,
    mostly texts that chains of candidates joined and that aren't alike, then meet by a prefix filter over their rarest
    shingles, so no component is compared pair by pair. So two candidates that are alike never both stay, and a
    document goes only if verified links join it to one that stays. Null, empty and wordless texts are alike. Of rows
    that share id and text one stays.
    """
    scratch = Scratch(docs.sparkSession, "alike")
    marks = scratch.keep(_marks(docs, False))
    nodes = scratch.keep(marks.groupBy("sid").agg(F.min("doc_id").alias("first"), F.min("a").alias("a"), F.min("b").alias("b")))
    roots = scratch.keep(connected(_wide_links(nodes, scratch), scratch))
    sized = roots.join(roots.groupBy("root").count(), "root")
    member = nodes.select("sid", "first").join(sized, F.col("sid") == F.col("node")).select("sid", "first", "root", "count")
    texts = docs.join(member.select(F.col("first").alias("f_")).distinct(), F.col("doc_id").eqNullSafe(F.col("f_")), "left_semi")
    texts = _marks(texts, True).select(F.col("sid").alias("s_"), "text").dropDuplicates(["s_"])
    place = F.struct(F.col("first").isNull().alias("none"), "first", "sid")
    member = scratch.keep(member.join(texts, F.col("sid") == F.col("s_")).select("sid", "text", place.alias("place"), "root", "count"))

    edges, left, salt = scratch.keep(_pieces(member, 0)), member, 0
    new, settled = edges, 1.0
    while True:
        # survivors of the components that more than one piece held
        left = left.where(F.col("count") > CHUNK).drop("count").join(new.select(F.col("v").alias("sid")), "sid", "left_anti")
        left = scratch.keep(left.join(left.groupBy("root").count(), "root").select(*member.columns))
        n = left.count()
        if not n or settled < SETTLED:
            break
        salt += 1
        new = scratch.keep(_pieces(left, salt))
        settled = new.count() / n
        edges = edges.unionAll(new)
    if n:
        edges = edges.unionAll(_earlier_alike(left, scratch))
    edges = scratch.keep(edges)
    group = connected(edges, scratch)
    member = nodes.join(group, F.col("sid") == F.col("node")).select("sid", "root", "first")
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    least = member.join(least, "root").select(F.col("sid").alias("s_"), "least")
    # a table of its own, so that the join with marks can be split where many documents share a set
    kept = scratch.keep(nodes.join(least, F.col("sid") == F.col("s_"), "left").select("sid", F.coalesce("least", "first").alias("least")))
    one, th = fresh("kept", docs.columns), fresh("th", docs.columns)
    kept = marks.join(kept, "sid").where(F.col("doc_id").eqNullSafe(F.col("least")))
    kept = scratch.keep(kept.select(F.col("doc_id").alias(one), F.col("th").alias(th)).distinct())
    scratch.drop_all_but(kept)
    own = F.col("doc_id").eqNullSafe(F.col(one)) & (F.xxhash64("text") == F.col(th))
    return docs.join(kept, own, "left_semi").dropDuplicates(["doc_id", "text"])
