"""Quality rules: base statistics of whole texts, then robust multivariate outliers per language and source, in SQL functions only.

Base. Words are maximal runs of [^\\x20\\x09-\\x0D]. A text fails if it has under 10 words or if over a fifth of its words lie in
5-word windows that occur twice or more in it. All counting stays inside the row: window hashes are packed with their positions into
longs and sorted as primitives, and only windows whose hash recurs are compared as text, so the count is exact and nothing is shuffled.

Outliers. Documents that pass give a vector of transformed statistics (logs of length and word length; square roots of the shares of
symbols, repeated lines and repeated words), held as whole 1/1024ths so that sums are exact in any order. Each (lang, source), each lang and
the whole corpus get a minimum-covariance-determinant estimate: from three starts (medians with quartile ranges, the covariance of spatial signs, that
of winsorised values), STEPS concentration steps each keep the 75 % of rows with the least distance and take their mean and covariance
(with the consistency factor and a floor on each variance), and of the three ends the one with the least determinant is used. The 75 % point
is read from a histogram of distances (1/64 steps), so no group is sorted or gathered. A language's estimate is then drawn towards the corpus's, and a
(lang, source) estimate towards its language's, with the weight of PRIOR rows, so that every document is judged at any size. Means and
covariances are mixed, and the spread between the two means is added in proportion to the group's rows beyond the first (one row is no group).
A document is rejected when the log of its squared distance lies beyond the far-out fence of what the chi-squared law with as many degrees as
there are statistics gives: the upper quartile and three times the range between the quartiles.

Scale. One pass over the texts writes a narrow table; each step is two aggregations with partial sums over it, for all levels and starts
at once. Group tables are broadcast only when counted small.

Nulls and odd input: a null text has no words and fails the base; a null lang or source is a value of its own; empty tables give
empty results; equal rows get equal verdicts; other columns are kept by apply_rules() and ignored here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, drop, free_name, let, materialize, small

WINDOW = 5
STEPS = 6
STARTS = 3
#: Rows that the estimate of the level above counts for.
PRIOR = 50
#: 0.75 / P(chi2 with p + 2 degrees <= the 0.75 quantile of chi2 with p = 5).
CONSISTENCY = 1.412
#: The least standard deviation of each statistic, in 1/1024ths: wide for repeats, of which clean texts have some, narrow for symbols.
FLOOR = (48, 48, 24, 256, 160)
# Quartiles of the chi-squared law with five degrees.
LOWER, UPPER = 2.6746, 6.6257
#: The far-out fence on the log scale: log UPPER + 3 * (log UPPER - log LOWER), as a squared distance (100.7).
CUTOFF = UPPER * (UPPER / LOWER) ** 3
SCALE = 1024
FEATURES = (
    "ln(1.0 + n_words)",
    "ln(cast(word_chars as double) / nullif(n_words, 0))",
    "sqrt(cast(n_symbols as double) / nullif(word_chars, 0))",
    "sqrt(cast(n_dup_lines as double) / nullif(n_lines, 0))",
    "sqrt(cast(n_repeat_words as double) / nullif(n_words, 0))",
)
P = len(FEATURES)


def _repeat_words(w: Column) -> Column:
    n = F.size(w)
    bits = F.length(F.bin(n.cast("long")))

    def shift(x: Column) -> Column:
        return F.call_function("shiftright", x, bits)

    packed = F.sort_array(F.transform(F.slice(w, 1, n - (WINDOW - 1)), lambda x, i: F.call_function("shiftleft", F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))), bits) + i))
    again = let(packed, lambda s: F.filter(s, lambda x, j: (shift(x) == shift(F.get(s, j - 1))) | (shift(x) == shift(F.get(s, j + 1)))))
    windows = F.array_sort(F.transform(again, lambda x: let((x - F.call_function("shiftleft", shift(x), bits)).cast("int"), lambda p: F.struct(F.concat_ws(" ", F.slice(w, p + 1, WINDOW)).alias("s"), p.alias("p")))))
    same = let(windows, lambda s: F.filter(s, lambda x, j: (x["s"] == F.get(s, j - 1)["s"]) | (x["s"] == F.get(s, j + 1)["s"])))
    at = F.sort_array(F.transform(same, lambda x: x["p"]))
    covered = let(at, lambda a: F.aggregate(F.transform(a, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(a, j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda x, y: x + y))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(covered)


def base_statistics(docs: DataFrame) -> DataFrame:
    """documents -> its columns but text, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE_RE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("again")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    out = docs.withColumns({"__w": of_words, "__l": of_lines, "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")})
    out = out.withColumns({"n_words": F.col("__w.n").cast("long"), "word_chars": F.col("__w.chars").cast("long"), "n_lines": F.col("__l.n").cast("long"), "n_dup_lines": F.col("__l.dup").cast("long"), "n_repeat_words": F.col("__w.again").cast("long")})
    return out.drop("__w", "__l", "text").withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


# The estimate as SQL text that Spark and DuckDB read alike; all sums are of whole numbers and the rest is +, -, *, / and sqrt in one order.
X = [f"cast(floor({f} * {SCALE} + 0.5) as bigint) as x{i}" for i, f in enumerate(FEATURES)]
Z = [f"((cast(x{i} as double) - m{i}) / s{i})" for i in range(P)]
RADIUS = "sqrt(" + " + ".join(f"{z} * {z}" for z in Z) + ")"
#: Of the starts 1 and 2: spatial signs and winsorised values, in 1/1024ths.
SHAPE = [f"cast(floor((case when start = 2 then greatest(-2.0, least(2.0, {z})) when {RADIUS} = 0.0 then 0.0 else {z} / {RADIUS} end) * {SCALE} + 0.5) as bigint) as x{i}" for i, z in enumerate(Z)]
SHAPE_COV = [f"(cast(a{i}_{j} as double) - cast(a{i} as double) * cast(a{j} as double) / n) / n" + " + 4096.0" * (i == j) + f" as c{i}_{j}" for i in range(P) for j in range(i + 1)]
SUMS = ["count(*) as n", *(f"sum(x{i}) as a{i}" for i in range(P)), *(f"sum(x{i} * x{j}) as a{i}_{j}" for i in range(P) for j in range(i + 1))]
MEAN = [f"cast(a{i} as double) / n as m{i}" for i in range(P)]
COV = [f"(cast(a{i}_{j} as double) - cast(a{i} as double) * cast(a{j} as double) / n) / n * {CONSISTENCY}" + f" + {FLOOR[i] ** 2}.0" * (i == j) + f" as c{i}_{j}" for i in range(P) for j in range(i + 1)]


def _cholesky() -> list[tuple[str, str]]:
    """Names and formulas, each of earlier names: the factor l of the covariance and the inverse k of l."""
    out = []
    for i in range(P):
        for j in range(i + 1):
            rest = "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            out.append((f"l{i}_{j}", f"sqrt(c{i}_{j}{rest})" if i == j else f"(c{i}_{j}{rest}) / l{j}_{j}"))
    for i in range(P):
        for j in range(i + 1):
            out.append((f"k{i}_{j}", f"1.0 / l{i}_{i}" if i == j else "-(" + " + ".join(f"l{i}_{k} * k{k}_{j}" for k in range(j, i)) + f") / l{i}_{i}"))
    return out


FACTOR = _cholesky()
ESTIMATE = [f"m{i}" for i in range(P)] + [f"k{i}_{j}" for i in range(P) for j in range(i + 1)]
SCALED = [f"k{i}_{j} / s{j} as k{i}_{j}" for i in range(P) for j in range(i + 1)]
DIAGONAL = [f"1.0 / s{i} as k{i}_{j}" if i == j else f"cast(0.0 as double) as k{i}_{j}" for i in range(P) for j in range(i + 1)]
DETERMINANT = " * ".join(f"l{i}_{i}" for i in range(P)) + " as det"
COVS = [f"c{i}_{j}" for i in range(P) for j in range(i + 1)]
MOMENTS = ["n", *(f"m{i}" for i in range(P)), *COVS]
_D = ["(" + " + ".join(f"k{i}_{j} * (cast(x{j} as double) - m{j})" for j in range(i + 1)) + ")" for i in range(P)]
D2 = " + ".join(f"{d} * {d}" for d in _D)


def mixed(above: str) -> list[str]:
    """Moments of rows that are n of their own and PRIOR of the level above, whose columns begin with above."""
    w, v = f"(cast(n as double) / (n + {PRIOR}.0))", f"({PRIOR}.0 / (n + {PRIOR}.0))"
    more = f"(cast(n - 1 as double) / (n + {PRIOR}.0))"
    means = [f"{w} * m{i} + {v} * {above}m{i} as m{i}" for i in range(P)]
    return [*means, *(f"{w} * c{i}_{j} + {v} * {above}c{i}_{j} + {more} * {v} * (m{i} - {above}m{i}) * (m{j} - {above}m{j}) as c{i}_{j}" for i in range(P) for j in range(i + 1))]


BIN = "cast(least(floor(sqrt({}) * 64.0), 1000000.0) as bigint)"


def _factored(df: DataFrame) -> DataFrame:
    for col, formula in FACTOR:
        df = df.withColumn(col, F.expr(formula))
    return df


def estimates(vectors: DataFrame) -> DataFrame:
    """(own, of_lang, x0..) -> own, its means and inverse factor: the drawn estimate of each (lang, source)."""
    levels = vectors.select(F.explode(F.array("own", "of_lang", F.lit("a"))).alias("key"), *(f"x{i}" for i in range(P)))
    sizes = materialize(levels.groupBy("key").agg(F.count("*").alias("n_key")))
    n_groups = sizes.count()
    quart = levels.groupBy("key").agg(*(F.expr(f"percentile(x{i}, array(0.25, 0.5, 0.75))").alias(f"q{i}") for i in range(P)))
    middle = materialize(quart.selectExpr("key", *(f"q{i}[1] as m{i}" for i in range(P)), *(f"greatest((q{i}[2] - q{i}[0]) / 1.349, {FLOOR[i]}.0) as s{i}" for i in range(P))))
    shape = levels.join(small(middle, n_groups), "key").withColumn("start", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr("key", "start", *SHAPE)
    shape = shape.groupBy("key", "start").agg(*(F.expr(s) for s in SUMS)).selectExpr("key", "start", *SHAPE_COV)
    shape = _factored(shape).join(small(middle, n_groups), "key").selectExpr("key", "start", *(f"m{i}" for i in range(P)), *SCALED)
    now = materialize(middle.selectExpr("key", "0 as start", *(f"m{i}" for i in range(P)), *DIAGONAL).unionByName(shape))
    for step in range(STEPS):
        rows = levels.join(small(now, STARTS * n_groups), "key").selectExpr("key", "start", *(f"x{i}" for i in range(P)), f"{BIN.format(D2)} as bin")
        bins = rows.groupBy("key", "start", "bin").agg(F.count("*").alias("c"))
        upto = bins.select("key", "start", "bin", F.expr("sum(c) over (partition by key, start order by bin)").alias("upto")).join(small(sizes, n_groups), "key")
        limits = materialize(upto.where("4 * upto >= 3 * n_key").groupBy("key", "start").agg(F.min("bin").alias("last")))
        inside = rows.join(small(limits, STARTS * n_groups), ["key", "start"]).where("bin <= last")
        moments = _factored(inside.groupBy("key", "start").agg(*(F.expr(s) for s in SUMS)).selectExpr("key", "start", "n", *MEAN, *COV))
        moments = materialize(moments.selectExpr("key", "start", *MOMENTS, DETERMINANT, *ESTIMATE[P:]))
        drop(limits, now)
        now = moments
    # the least determinant; then each level drawn towards the one above
    best = materialize(now.groupBy("key").agg(F.min_by(F.struct(*MOMENTS), F.struct("det", "start")).alias("e")).select("key", "e.*"))
    top = best.where("key = 'a'").selectExpr(*(f"{c} as t_{c}" for c in MOMENTS[1:]))
    langs = best.where("key like 'l%'").crossJoin(F.broadcast(top)).selectExpr("key as of_lang", *mixed("t_")).selectExpr("of_lang", *(f"{c} as t_{c}" for c in MOMENTS[1:]))
    pairs = materialize(vectors.select("own", "of_lang").distinct())
    own = best.join(small(pairs, n_groups), best["key"] == pairs["own"]).join(small(langs, n_groups), "of_lang").selectExpr("own", *mixed("t_"))
    return materialize(_factored(own).select("own", *ESTIMATE))


def verdicts(stats: DataFrame) -> DataFrame:
    """base_statistics() rows (narrow, materialized) -> with distance2 (null where the base fails) and kept. Its own columns have names of
    its own (own, of_lang, distance2, kept and those of the statistics)."""
    name = {c: F.coalesce(F.concat(F.lit("v"), F.regexp_replace(c, "/", "//")), F.lit("n")) for c in ("lang", "source")}
    keyed = stats.withColumns({"own": F.concat(F.lit("o"), F.concat_ws("/ ", *name.values())), "of_lang": F.concat(F.lit("l"), name["lang"])})
    vectors = materialize(keyed.where("not base_failed").selectExpr("own", "of_lang", *X))
    now = estimates(vectors)
    judged = keyed.selectExpr("*", *X).join(small(now), "own", "left").withColumn("distance2", F.when(~F.col("base_failed"), F.expr(D2)))
    judged = judged.withColumn("kept", F.expr(f"not base_failed and coalesce(distance2 <= {CUTOFF!r}, true)"))
    return judged.drop("own", "of_lang", *ESTIMATE, *(f"x{i}" for i in range(P)))


def assess(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, the base statistics, base_failed, distance2, kept; one row per input row."""
    stats = base_statistics(docs.select("doc_id", "text", "lang", "source"))
    return verdicts(materialize(stats))


def apply_rules(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names."""
    row = free_name(docs, "row")
    tagged = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    stats = materialize(base_statistics(tagged.select(F.col(row).alias("rid"), "doc_id", "text", "lang", "source")))
    good = verdicts(stats).where("kept").select(F.col("rid").alias(row))
    return tagged.join(good, row, "left_semi").select(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))


def oracle_assess(docs: str = "documents") -> str:
    """The same rules as one SQL statement."""
    xs = ", ".join(f"x{i}" for i in range(P))
    cte = [
        f"""r as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from {docs})""",
        """w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from r)""",
        """win as (select rid, unnest(range(len(ws) - 4)) as p, ws from w where len(ws) >= 5)""",
        """dup as (select rid, p from (select rid, p, count(*) over (partition by rid, ws[p+1], ws[p+2], ws[p+3], ws[p+4], ws[p+5]) as c from win) where c > 1)""",
        """rep as (select rid, sum(least(5, coalesce(nxt - p, 5)))::bigint as n from (select rid, p, lead(p) over (partition by rid order by p) as nxt from dup) group by rid)""",
        """b as (select w.rid, doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
            len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words from w left join rep on w.rid = rep.rid)""",
        """b1 as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)""",
        """g as (select lang, source, row_number() over (order by lang, source) as own, dense_rank() over (order by lang) as of_lang from (select distinct lang, source from b1 where not base_failed))""",
        f"""v as materialized (select rid, 'o' || own as own, 'l' || of_lang as of_lang, {', '.join(X)} from b1 join g on b1.lang is not distinct from g.lang and b1.source is not distinct from g.source where not base_failed)""",
        f"""lv as materialized (select unnest([own, of_lang, 'a']) as key, {xs} from v)""",
        """gs as (select key, count(*) as n_key from lv group by key)""",
        f"""q as (select key, {', '.join(f'quantile_cont(x{i}, [0.25, 0.5, 0.75]) as q{i}' for i in range(P))} from lv group by key)""",
        f"""mid as materialized (select key, {', '.join(f'q{i}[2] as m{i}, greatest((q{i}[3] - q{i}[1]) / 1.349, {FLOOR[i]}.0) as s{i}' for i in range(P))} from q)""",
        f"""sh as (select lv.key, start, {', '.join(SHAPE)} from lv join mid on lv.key = mid.key, (values (1), (2)) t(start))""",
        f"""sa as (select key, start, {', '.join(SUMS)} from sh group by key, start)""",
        f"""s_0 as (select key, start, {', '.join(SHAPE_COV)} from sa)""",
    ]
    ms = ", ".join(f"m{i}" for i in range(P))

    def factored(name: str) -> None:
        for m, (col, formula) in enumerate(FACTOR):
            cte.append(f"{name}_{m + 1} as (select *, {formula} as {col} from {name}_{m})")

    last = len(FACTOR)
    factored("s")
    cte.append(f"e0 as materialized (select key, 0 as start, {ms}, {', '.join(DIAGONAL)} from mid union all select mid.key, start, {ms}, {', '.join(SCALED)} from s_{last} join mid on s_{last}.key = mid.key)")
    for k in range(STEPS):
        cte += [
            f"d{k} as materialized (select lv.key, start, {xs}, {BIN.format(D2)} as bin from lv join e{k} on lv.key = e{k}.key)",
            f"c{k} as (select key, start, bin, sum(count(*)) over (partition by key, start order by bin) as upto from d{k} group by key, start, bin)",
            f"t{k} as (select c{k}.key, start, min(bin) as last from c{k} join gs on c{k}.key = gs.key where 4 * upto >= 3 * n_key group by c{k}.key, start)",
            f"a{k} as materialized (select d{k}.key, d{k}.start, {', '.join(SUMS)} from d{k} join t{k} on d{k}.key = t{k}.key and d{k}.start = t{k}.start where bin <= last group by d{k}.key, d{k}.start)",
            f"f{k}_0 as (select key, start, n, {', '.join(MEAN + COV)} from a{k})",
        ]
        factored(f"f{k}")
        cte.append(f"e{k + 1} as materialized (select key, start, {', '.join(MOMENTS)}, {DETERMINANT}, {', '.join(ESTIMATE[P:])} from f{k}_{last})")
    moments = ", ".join(MOMENTS)
    above = ", ".join(f"{c} as t_{c}" for c in MOMENTS[1:])
    cte += [
        f"best as (select key, {moments} from e{STEPS} qualify row_number() over (partition by key order by det, start) = 1)",
        f"top as (select {above} from best where key = 'a')",
        f"la as (select key as of_lang, {', '.join(mixed('t_'))} from best, top where key like 'l%')",
        f"lb as (select of_lang, {above} from la)",
        f"o_0 as (select own, {', '.join(mixed('t_'))} from best join (select distinct own, of_lang from v) on key = own join lb using (of_lang))",
    ]
    factored("o")
    cte += [
        f"z as materialized (select v.rid, {D2} as distance2 from v join o_{last} o on v.own = o.own)",
    ]
    return "with " + ",\n".join(cte) + f"\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(distance2 <= {CUTOFF!r}, true) as kept from b1 left join z on b1.rid = z.rid"
