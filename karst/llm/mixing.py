"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the copy expectation of its source, ``target / source
size``. The whole copies are fixed; the fractions are rounded in a reduction tree.
A node of the tree folds at most ``fan_in`` or so fractional documents: it pairs the
unfinished one with the next, moves words at random from one to the other (so that
``sum(fraction * size)`` stays what it was and each fraction keeps its expectation)
until one of them is 0 or 1, and passes the unfinished one on. A node hands at most
one row to its parent, hence a level holds a fan_in-th of the level below, and the
words that a source takes differ from its target by less than one document.

Everything is DataFrame expressions; there is no Python on the executors. Random
numbers are hashes of the row and the level, so reruns agree.

Edge cases: null text has size 0; documents of size 0 are never copied (taken 0); a
null source is a source of its own, after all others; a null doc_id takes part like
any other value; equal rows are separate documents, told apart by a running number; an empty table gives an empty
result; further columns can be carried with ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: A document is copied at most so many times.
MOST_COPIES = 3.0


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds rank (from 0, nulls last, by code point) without one task seeing all sources."""
    ordered = scratch.keep(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    )
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each shuffle partition: bounded by spark.sql.shuffle.partitions
    offsets = counts.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset")
    )
    within = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return ordered.join(offsets, "part").select(
        "source", "source_size", "n_docs", (F.col("offset") + F.row_number().over(within) - 1).alias("rank")
    )


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, cap: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size).

    Shares of the total by weight; a source whose share exceeds cap times its size
    gets that much and the excess is shared again by weight among the rest, until no
    source is above. The loop keeps two sums on the driver, never the sources.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = scratch.keep(_ranked(sources, scratch).withColumn("w", w))
    most = F.col("source_size") * F.lit(float(cap))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = -1.0
    while True:
        # sources at the cap stay there: the level only rises
        free = F.col("w") * F.lit(level) < most if level >= 0 else F.lit(True)
        capped, weight = ranked.agg(
            F.coalesce(F.sum(F.when(~free, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(free, F.col("w"))), F.lit(0.0))
        ).first()
        new = (total - capped) / weight if weight else level
        if weight == 0 or new <= level:
            break
        level = new
    target = F.least(most, F.col("w") * F.lit(max(level, 0.0)))
    return ranked.select("source", "source_size", "n_docs", target.alias("target"))


def pivotal_round(fractions: DataFrame, carried: list[str], scratch: Scratch, fan_in: int = 32, most: int | None = None) -> DataFrame:
    """Round the column p (0 < p < 1) of each row to 0.0 or 1.0, within each source.

    fractions: source, hkey (long), size (long > 0), p, leaves (nodes of the source's
    lowest level), and the carried columns; most: the largest leaves, if known. ``sum(p * size)`` of a source changes by
    less than the size of one row.
    """
    payload = [*carried]
    rows = fractions.select(
        "source",
        "leaves",
        F.pmod(F.col("hkey"), F.col("leaves")).alias("node"),
        F.struct("size", "hkey", "p", *payload).alias("x"),
    )
    if most is None:
        most = rows.agg(F.max("leaves")).first()[0]
    done, level = [], 0
    kind = rows.schema["x"].dataType.simpleString()
    while most is not None:
        folded = scratch.keep(
            rows.groupBy("source", "leaves", "node")
            .agg(F.sort_array(F.collect_list("x"), asc=False).alias("items"))
            .withColumn("f", F.expr(_fold_sql(kind, level, last=most <= 1)))
            .select("source", "leaves", "node", "f.r", "f.done")
        )
        done.append(folded.select("source", F.explode("done").alias("x")))
        if most <= 1:
            break
        rows = folded.where("r is not null").select(
            "source",
            F.ceil(F.col("leaves") / fan_in).cast("long").alias("leaves"),
            F.floor(F.col("node") / fan_in).cast("long").alias("node"),
            F.col("r").alias("x"),
        )
        most, level = -(-most // fan_in), level + 1
    if not done:
        return fractions.select("source", "hkey", "size", "p", *payload)
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select("source", "x.*")


def _fold_sql(kind: str, level: int, last: bool) -> str:
    """SQL of the fold of one node: struct(r: the unfinished row or null, done: array).

    With words a = r.p * r.size and b = x.p * x.size, up is what r can gain from x,
    down what it can lose to x; r gains up with probability down / (up + down), so both
    fractions keep their expectations. The side that stops first is 0 or 1.
    """
    u = "(pmod(xxhash64(acc.r.hkey, x.hkey, acc.r.size, x.size, size(acc.done), {s}), 9007199254740992L) / 9007199254740992D)".format(s=level)
    def with_p(o: str, p: str) -> str:
        return "named_struct('size', {o}.size, 'hkey', {o}.hkey, 'p', {p}{rest})".format(
            o=o, p=p, rest="".join(f", '{f}', {o}.`{f}`" for f in _fields(kind) if f not in ("size", "hkey", "p"))
        )

    up = "least((1 - acc.r.p) * acc.r.size, x.p * x.size)"
    down = "least(acc.r.p * acc.r.size, (1 - x.p) * x.size)"
    gain = f"({u} * ({up} + {down}) < {down})"
    # exact 0 and 1 where a bound is hit: no rest of a subtraction may keep a row unfinished
    r_up = "CASE WHEN (1 - acc.r.p) * acc.r.size <= x.p * x.size THEN 1D ELSE acc.r.p + x.p * x.size / acc.r.size END"
    x_up = "CASE WHEN x.p * x.size <= (1 - acc.r.p) * acc.r.size THEN 0D ELSE x.p - (1 - acc.r.p) * acc.r.size / x.size END"
    r_dn = "CASE WHEN acc.r.p * acc.r.size <= (1 - x.p) * x.size THEN 0D ELSE acc.r.p - (1 - x.p) * x.size / acc.r.size END"
    x_dn = "CASE WHEN (1 - x.p) * x.size <= acc.r.p * acc.r.size THEN 1D ELSE x.p + acc.r.p * acc.r.size / x.size END"
    pair = (
        f"CASE WHEN {gain} THEN array({with_p('acc.r', r_up)}, {with_p('x', x_up)})"
        f" ELSE array({with_p('acc.r', r_dn)}, {with_p('x', x_dn)}) END"
    )
    one = f"cast(x as {kind})"
    open_, shut = "v -> v.p > 0 and v.p < 1", "v -> v.p <= 0 or v.p >= 1"
    acc_t = f"struct<r:{kind},done:array<{kind}>>"
    step = (
        f"(acc, x) -> transform(array(CASE WHEN acc.r IS NULL THEN array({one}) ELSE {pair} END), two -> "
        f"cast(named_struct('r', get(filter(two, {open_}), 0), 'done', concat(acc.done, filter(two, {shut}))) as {acc_t}))[0]"
    )
    finish = "acc -> acc"
    if last:
        # the root's own remainder: one plain coin
        coin = "(pmod(xxhash64(acc.r.hkey, acc.r.size, -1), 9007199254740992L) / 9007199254740992D < acc.r.p)"
        end = with_p("acc.r", f"CASE WHEN {coin} THEN 1D ELSE 0D END")
        finish = (
            f"acc -> CASE WHEN acc.r IS NULL THEN acc ELSE cast(named_struct('r', cast(null as {kind}), "
            f"'done', concat(acc.done, array({end}))) as {acc_t}) END"
        )
    start = f"cast(named_struct('r', null, 'done', array()) as {acc_t})"
    return f"aggregate(items, {start}, {step}, {finish})"


def _fields(kind: str) -> list[str]:
    """Names of the top-level fields of a struct's type string."""
    body, depth, names, word = kind[len("struct<") : -1], 0, [], ""
    for c in body + ",":
        if c == "," and depth == 0:
            names.append(word.split(":")[0].strip("`"))
            word = ""
            continue
        depth += c in "<(" and 1 or (c in ">)" and -1 or 0)
        word += c
    return names


def _told_apart(sized: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds salt: 0, 1, ... for rows that share source, doc_id and size, so that no leaf holds them all.

    Such rows are alike to the rounding, so it doesn't matter which gets which number, and other file layouts lead to
    the same numbers. A group is numbered in as many pieces as there are partitions.
    """
    part = sized.withColumn("part", F.spark_partition_id())
    group = F.xxhash64(F.col("source").isNull(), "source", F.col("doc_id").isNull(), "doc_id", "size")
    several = scratch.keep(sized.groupBy(group.alias("group")).count().where("count > 1").select("group"))
    part = part.withColumn("group", group)
    many = scratch.keep(part.join(several, "group", "left_semi"))
    counts = many.groupBy("group", "part").agg(F.count("*").alias("n"))
    # a row for each partition of a group
    before = F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n")
    offsets = counts.select(F.col("group").alias("g_"), F.col("part").alias("p_"), before.alias("offset"))
    place = F.row_number().over(Window.partitionBy("group", "part").orderBy("size")) - 1
    many = many.withColumn("place", place).join(offsets, (F.col("group") == F.col("g_")) & (F.col("part") == F.col("p_")))
    one = part.join(several, "group", "left_anti").withColumn("salt", F.lit(0).cast("long"))
    return one.select(*sized.columns, "salt").unionAll(many.select(*sized.columns, (F.col("offset") + F.col("place")).alias("salt")))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    cap: float = MOST_COPIES,
    fan_in: int = 32,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies and the carried columns).

    taken = copies * size; copies is floor or ceil of target / source_size, at most cap.
    """
    clash = {"size", "hkey", "p", "leaves", "node", "salt", "group", "part", "copies", "taken", "target", "source_size", "n_docs"} & set(carry)
    if clash:
        raise ValueError(f"carried columns clash with the result's: {sorted(clash)}")
    carried = ["doc_id", *carry]
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.keep(docs.select("source", word_count().alias("size"), *carried))
    targets = source_targets(sized.select("source", "size"), scratch, weights, cap)
    sized = _told_apart(sized, scratch)
    same = sized["source"].eqNullSafe(targets["source"])
    rows = sized.join(targets.drop("n_docs"), same).drop(targets["source"])
    leaves = targets.select("source", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / fan_in)).cast("long").alias("leaves"))
    x = F.col("target") / F.col("source_size")
    rate = F.when(F.col("source_size") > 0, x).otherwise(F.lit(0.0))
    # a fraction this near to a whole number is one: sums of doubles are not exact
    near = F.round(rate)
    whole = F.when(F.abs(rate - near) < 1e-9, near).otherwise(F.floor(rate).cast("double"))
    rows = rows.withColumn("whole", whole).withColumn(
        "p", F.when((F.abs(rate - near) < 1e-9) | (F.col("size") == 0), F.lit(0.0)).otherwise(rate - F.floor(rate))
    )
    keep = ["whole", "source_size", "target", *carried]
    plain = rows.where("p = 0").select("source", "size", F.lit(0.0).alias("p"), *keep)
    part = rows.withColumn("hkey", F.xxhash64("doc_id", "size", "salt")).where("p > 0").drop("salt")
    part = part.join(leaves.withColumnRenamed("source", "s_"), part["source"].eqNullSafe(F.col("s_"))).drop("s_")
    widest = targets.agg(F.max("n_docs")).first()[0]
    rounded = pivotal_round(part, keep, scratch, fan_in, widest and max(1, -(-widest // fan_in))).select("source", "size", "p", *keep)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") + F.col("p")).cast("long")
    return (
        plain.unionAll(rounded)
        .withColumn("copies", copies)
        .select(
            "doc_id", "size", "source_size", F.col("target").cast("double"),
            (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", *carry,
        )
    )
