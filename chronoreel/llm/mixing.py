"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words of the whole corpus; a target stops
at max_copies times its source's words and the excess is shared again by weight (water filling, solved on sorted prefix sums).

Copies. In a source, document i may expect e_i = min(max_copies, c * m_i) copies, m_i = 65536 / sqrt(size) in whole numbers, so a
budget of words reaches more documents when they are short; c solves sum(e_i * size_i) = target on prefix sums over the distinct
sizes. floor(e_i) copies are certain. For the rest p_i = e_i - floor(e_i) the documents are ranked by the Pareto key
(u / (1 - u)) / (p / (1 - p)), u from a hash of doc_id, and taken in that order until the words left for the source are used; the
document that straddles the budget is taken if that comes nearer to it. So a source misses its target by at most half a document
(or by nothing it could avoid), and reruns agree.

Scale. The budget's place in the order is found from per-cell word totals (4,096 cells of the key, then 4,096 in the one cell the
budget falls into), so no task orders a whole source; only the rows of the last cell, about 1 in 16 million, are ranked together. The sample's
size is thus fixed in words, which is what the targets are stated in, and not in documents.

Nulls and odd input: a null text has size 0; documents of size 0 and sources of size 0 take 0; a null source is a source of its own,
a null doc_id is hashed as "null"; equal rows are interchangeable; other columns are kept by mix() and ignored here; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, n_words, running_totals, small, unit

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
CELLS = 4096
#: Tasks that rows without a doc_id of one source and size are dealt to.
SALTS = 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> (source, source_size, target)."""
    rank = running_totals(sizes.withColumn("none", F.col("source").isNull().cast("int")), [F.col("none"), F.col("source")], {"k": F.lit(1), "all": F.col("source_size")})
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("long")
    cap = F.lit(max_copies) * F.col("source_size")
    weighed = materialize(rank.select("source", "source_size", weigh.alias("w"), cap.alias("cap"), (cap.cast("double") / weigh).alias("ratio")))
    sums = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("w"), F.lit(0)).alias("w_all"))
    filled = running_totals(weighed, [F.col("ratio"), F.col("source").isNull(), F.col("source")], {"cap_before": F.col("cap"), "w_before": F.col("w")}).crossJoin(F.broadcast(sums))
    level = (F.col("total") - F.col("cap_before")).cast("double") / (F.col("w_all") - F.col("w_before")).cast("double")
    leveled = materialize(filled.withColumn("level", level))
    first = leveled.where(F.col("cap") > F.col("level") * F.col("w")).agg(F.min_by("level", F.struct("ratio", "w_before")).alias("first"))
    share = F.coalesce(F.col("first"), F.lit(0.0)) * F.col("w")
    return leveled.crossJoin(F.broadcast(first)).select("source", "source_size", F.when(F.col("cap") <= share, F.col("cap").cast("double")).otherwise(share).alias("target"))


def copies(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """documents -> (doc_id, source, size, source_size, target, n_copies, taken), one row per input row."""
    rows = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), unit(seed, F.col("doc_id")).alias("u")))
    measure = F.floor(F.lit(65536.0) / F.sqrt(F.col("size").cast("double"))).cast("long")
    by_size = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = materialize(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    targets = materialize(source_targets(totals, weights, max_copies).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source"))
    n_sources = targets.count()

    # c from prefix sums over distinct sizes: the smallest documents reach max_copies first.
    sized = by_size.where("size > 0").withColumns({"key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")), "m": measure}).join(small(targets, n_sources), "key")
    up, rest = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key").orderBy("size").rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum(F.lit(max_copies) * F.col("size") * F.col("n")).over(up), F.lit(0))
    open_ = F.sum(F.col("size") * F.col("m") * F.col("n")).over(rest)
    solved = sized.select("key", "size", "m", ((F.col("target") - full.cast("double")) / open_.cast("double")).alias("c"))
    scale = solved.where(F.col("c") * F.col("m") < max_copies).groupBy("key").agg(F.min_by("c", "size").alias("c"), F.min("size").alias("from_size"))
    plan = materialize(targets.join(scale, "key", "left"))

    expect = F.when(F.col("size") <= 0, 0.0).when(F.col("from_size").isNull() | (F.col("size") < F.col("from_size")), F.lit(float(max_copies))).otherwise(F.least(F.lit(float(max_copies)), F.greatest(F.lit(0.0), F.col("c")) * F.col("m")))
    p = F.col("expect") - F.col("certain")
    odds = (F.col("u") / (1.0 - F.col("u"))) / (F.col("p") / (1.0 - F.col("p")))
    keyed = rows.withColumns({"key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")), "m": F.when(F.col("size") > 0, measure)}).join(small(plan, n_sources), "key")
    keyed = keyed.withColumn("expect", expect).withColumn("certain", F.floor("expect").cast("long")).withColumn("p", p)
    keyed = keyed.withColumn("q", F.when(F.col("p") > 0, odds)).withColumn("v", F.col("q") / (1.0 + F.col("q")))
    keyed = materialize(keyed.withColumn("cell", F.least(F.lit(CELLS * CELLS - 1), F.floor(F.col("v") * (CELLS * CELLS))).cast("long")).select("doc_id", "source", "key", "size", "source_size", "target", "certain", "v", "cell"))

    # The words left for each source, then the cell in which they run out, coarse and fine.
    left = materialize(keyed.groupBy("key").agg(F.first("target").alias("t"), F.sum(F.col("certain") * F.col("size")).alias("sure")).select("key", (F.col("t") - F.col("sure").cast("double")).alias("budget"), F.lit(0).cast("long").alias("base")))
    drawn = keyed.where("v is not null")
    at = left
    for shift in (CELLS, 1):
        cells = drawn.join(small(at, n_sources), "key") if shift > 1 else drawn.join(small(at, n_sources), (drawn["key"] == at["key"]) & (F.floor(drawn["cell"] / CELLS) == at["at"])).drop(at["key"])
        cells = cells.groupBy("key", "budget", "base", F.floor(F.col("cell") / shift).alias("at")).agg(F.sum("size").alias("words"))
        before = F.col("base") + F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.withColumn("before", before).where("before <= budget")
        at = materialize(cells.groupBy("key", "budget").agg(F.max("at").alias("at"), F.max_by("before", "at").alias("base")))
    edge = drawn.alias("d").join(small(at, n_sources).alias("e"), (F.col("d.key") == F.col("e.key")) & (F.col("d.cell") == F.col("e.at"))).select("d.key", "d.doc_id", "d.v", "d.size", "e.budget", "e.base")
    order = Window.partitionBy("key").orderBy("v", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = edge.where(F.col("before").cast("double") + F.col("size") / 2.0 <= F.col("budget")).groupBy("key").agg(F.max(F.struct("v", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "size")).alias("last"))
    stop = materialize(at.select("key", "at").join(last, "key", "left"))
    taken = keyed.join(small(stop, n_sources), "key", "left")
    extra = F.when(F.col("v").isNull() | F.col("at").isNull(), 0).when(F.col("cell") < F.col("at"), 1).when(F.col("cell") > F.col("at"), 0)
    extra = extra.otherwise(F.coalesce((F.struct("v", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "size") <= F.col("last")).cast("int"), F.lit(0)))
    n = F.col("certain") + extra.cast("long")
    return taken.select("doc_id", "source", "size", "source_size", "target", n.alias("n_copies"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as copies() says, all columns kept, whatever their names. Rows that share a doc_id, a source and
    a size share a decision."""
    own = {k: free_name(docs, k) for k in ("id", "src", "none", "size", "n", "copy", "salt", "own_size", "own_salt")}
    source = lambda d: [F.coalesce(d["source"], F.lit("")), d["source"].isNull()]
    # without a doc_id all rows would meet by source and size: the size's salt deals them out, and their decisions go to each salt
    salts = F.when(F.col("doc_id").isNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    made = copies(docs, weights, max_copies, seed).where("n_copies > 0").withColumn(own["salt"], F.explode(salts))
    keys = made.groupBy(F.col("doc_id").alias(own["id"]), source(made)[0].alias(own["src"]), source(made)[1].alias(own["none"]), F.col("size").alias(own["size"]), own["salt"]).agg(F.max("n_copies").alias(own["n"]))
    salt = F.when(docs["doc_id"].isNull(), F.pmod(F.xxhash64(docs["text"]), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = docs.withColumns({own["own_size"]: n_words(docs["text"]), own["own_salt"]: salt})
    same = rows["doc_id"].eqNullSafe(keys[own["id"]]) & (rows[own["own_size"]] == keys[own["size"]]) & (rows[own["own_salt"]] == keys[own["salt"]])
    joined = rows.join(keys, same & (source(rows)[0] == keys[own["src"]]) & (source(rows)[1] == keys[own["none"]]))
    out = joined.withColumn(own["copy"], F.explode(F.sequence(F.lit(1), F.col(own["n"]).cast("int"))))
    return out.select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))


def oracle_copies(docs: str = "documents", weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix") -> str:
    """The same rule as one SQL statement with whole-source windows."""
    w = f"list_extract([{', '.join(map(str, weights))}], ((row_number() over (order by source is null, source) - 1) % {len(weights)} + 1)::int)"
    return f"""
with r as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    (('0x' || substr(md5('{seed}/' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u from {docs}),
s0 as (select source, sum(size)::bigint as source_size from r group by source),
s1 as (select *, {w}::bigint as w, {max_copies} * source_size as cap from s0),
s2 as (select *, cap::double / w as ratio, sum(source_size) over () as total, sum(w) over () as w_all from s1),
s3 as (select *, coalesce(sum(cap) over o, 0) as cap_before, coalesce(sum(w) over o, 0) as w_before from s2
    window o as (order by ratio, source is null, source rows between unbounded preceding and 1 preceding)),
s4 as (select *, (total - cap_before)::double / (w_all - w_before)::double as level from s3),
lv as (select arg_min(level, (ratio, w_before)) as first from s4 where cap > level * w),
t as (select source, source_size, case when cap <= coalesce(first, 0.0) * w then cap::double else coalesce(first, 0.0) * w end as target from s4, lv),
z as (select source, size, count(*) as n, floor(65536.0 / sqrt(size::double))::bigint as m from r where size > 0 group by source, size),
z1 as (select z.*, t.target, coalesce(sum({max_copies} * z.size * n) over (partition by z.source order by z.size rows between unbounded preceding and 1 preceding), 0) as filled,
    sum(z.size * m * n) over (partition by z.source order by z.size rows between current row and unbounded following) as opened
    from z join t on z.source is not distinct from t.source),
z2 as (select source, size, m, (target - filled::double) / opened::double as c from z1),
z3 as (select source, arg_min(c, size) as c, min(size) as from_size from z2 where c * m < {max_copies} group by source),
k as (select r.*, t.source_size, t.target, case when r.size <= 0 then 0.0 when from_size is null or r.size < from_size then {max_copies}.0
    else least({max_copies}.0::double, greatest(0.0::double, c) * floor(65536.0 / sqrt(r.size::double))::bigint) end::double as expect
    from r join t on r.source is not distinct from t.source left join z3 on r.source is not distinct from z3.source),
k1 as (select *, floor(expect)::bigint as certain, expect - floor(expect)::bigint as p from k),
k2 as (select *, case when p > 0 then (u / (1.0 - u)) / (p / (1.0 - p)) end as q, target - sum(certain * size) over (partition by source)::double as budget from k1),
k3 as (select *, q / (1.0 + q) as v from k2),
k4 as (select *, coalesce(sum(case when v is null then 0 else size end) over (partition by source order by v nulls last, doc_id nulls last, size rows between unbounded preceding and 1 preceding), 0) as before from k3)
select doc_id, size, source_size, target, ((certain + case when v is not null and before::double + size / 2.0 <= budget then 1 else 0 end) * size)::bigint as taken from k4"""
