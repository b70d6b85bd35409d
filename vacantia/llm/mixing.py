"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Each source s has a target of T_s words. Among all document rates r_i in [0, 3]
that meet sum(r_i * size_i) = T_s, the one closest in entropy to "each document
once" is r_i = min(3, exp(lambda_s * size_i / mean_s)): an exponential tilt whose
multiplier is the zero of the gradient of the convex dual. Newton steps on the
dual run for all sources at once; each step is one aggregation over a histogram
of (source, size), so no step reads the documents again and no source, however
large, meets in one task. Rates are then rounded to whole copies: a document gets
floor(r_i) copies, and one more if its fixed random number (equal rows have evenly
spread ones) falls under the fraction, moved by one cut per source so that the source's words come out within
about one document of T_s; a few single documents then make up most of the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, stored

#: A rate, and so the copies of a document, is never above this.
MOST_COPIES = 3
#: Newton stops at this relative error of every source's words, or after so many steps.
TOLERANCE, MOST_STEPS = 1e-7, 100
#: After the last step an error above this raises; rounding makes up a smaller one.
WORST = 1e-3
#: Targets order all sources in one task, one row a source; more sources than this raise.
MOST_SOURCES = 1_000_000
#: Equal rows are dealt out in blocks of so many.
BLOCK = 1 << 16
#: Rounding keys have 30 bits, settled 10 at a time.
KEY_BITS, LEVEL_BITS = 30, 10


def words(text: Column) -> Column:
    """The number of runs of anything but the six ASCII white-space characters; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hashable(docs: DataFrame) -> list[str]:
    return [f.name for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]


#: What tells rows apart: rows equal in these are dealt out evenly, whatever other columns they have.
IDENTITY = ("doc_id", "text", "source")


def _hash(columns: list[str]) -> Column:
    cols = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def _marked(docs: DataFrame, text: str, source: str, size: str | None, identity: tuple[str, ...]) -> DataFrame:
    """docs with _mix_source, _mix_size and _mix_row, a hash of the identity columns."""
    taken = [c for c in docs.columns if c.lower().startswith("_mix_")]
    if taken:
        raise ValueError(f"columns {taken} are named like those used inside")
    n = words(F.col(text)) if size is None else F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    return docs.withColumns({"_mix_source": F.col(source).cast("string"), "_mix_size": n, "_mix_row": _hash(list(identity))})


def _chance(row: Column) -> Column:
    """A number in [0, 1) that depends on the row alone."""
    return (F.xxhash64(row).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def _dealt(groups: DataFrame) -> DataFrame:
    """Each of n equal rows once, those from the _first-th on of _all, the j-th with the
    random number (j + chance) / _all.

    So equal rows spread evenly over [0, 1), and a mix takes its share of them, not
    all or none. Groups beyond a block are dealt out to many tasks."""
    few = groups.filter(F.col("n") <= BLOCK).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    blocks = groups.filter(F.col("n") > BLOCK).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))).repartition("_mix_row", "_b")
    first = F.col("_b") * BLOCK
    many = blocks.withColumn("_j", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("n")) - 1))).drop("_b")
    return few.unionByName(many).withColumn("_chance", (F.col("_first") + F.col("_j") + _chance(F.col("_mix_row"))) / F.col("_all")).drop("_j", "n", "_first", "_all")


def source_targets(hist: DataFrame) -> DataFrame:
    """Source, its words, and its target: weights 1, 2, 3, 1, ... by source, null last;
    targets are capped at three times the source's words and the excess is shared by weight."""
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    per = stored(per, "mix-sources")
    if per.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    per = per.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    per = per.withColumn("cap", F.lit(float(MOST_COPIES)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level at which uncapped sources stand once those filled sooner are at their caps.
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    per = per.withColumn("level", F.max(F.when(F.col("free"), F.col("level"))).over(every))
    return per.select("source", "source_size", "docs", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def rate(lam: Column, size: Column, mean: Column) -> Column:
    """min(3, exp(lambda * size / mean)); a null lambda stands for plus infinity."""
    tilt = F.least(lam * size / mean, F.lit(2.0))  # e**2 is above 3, and exp() cannot overflow
    return F.when(lam.isNull(), F.lit(float(MOST_COPIES))).otherwise(F.least(F.lit(float(MOST_COPIES)), F.exp(tilt)))


def solve(hist: DataFrame) -> DataFrame:
    """One row a source: source, source_size, target, mean and lambda.

    Newton's step is taken if it stays between the bounds known so far, else the
    bounds are halved. Sources at their cap have a null lambda."""
    state = source_targets(hist).withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)))
    capped = F.col("target") >= F.col("source_size") * F.lit(MOST_COPIES * (1 - 1e-9))
    state = state.withColumns({"lambda": F.when(~capped, F.lit(0.0)), "low": F.lit(-1e4), "high": F.lit(1e4), "error": F.lit(None).cast("double")})
    state = stored(state, "mix-state", 1)
    few = state.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for _ in range(MOST_STEPS):
        s = F.broadcast(state) if few else state
        h = hist.withColumnRenamed("source", "_source")
        h = h.join(s, F.col("_source").eqNullSafe(F.col("source"))).filter(F.col("lambda").isNotNull())
        r = rate(F.col("lambda"), F.col("size"), F.col("mean"))
        tokens = F.col("size") * F.col("n")
        free = F.when(r < MOST_COPIES, tokens * r * F.col("size") / F.col("mean")).otherwise(0.0)
        step = h.groupBy("source").agg(F.sum(tokens * r).alias("total"), F.sum(free).alias("slope")).withColumnRenamed("source", "_source")
        new = state.join(step, F.col("_source").eqNullSafe(F.col("source")), "left")
        over = F.col("total") > F.col("target")
        new = new.withColumns({"low": F.when(over, F.col("low")).otherwise(F.coalesce(F.col("lambda"), F.col("low"))), "high": F.when(over, F.col("lambda")).otherwise(F.col("high"))})
        # Newton on log(total): the totals are near exponential in lambda.
        newton = F.col("lambda") - (F.log(F.col("total")) - F.log(F.col("target"))) * F.col("total") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        moved = F.when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        error = F.abs(F.col("total") / F.col("target") - 1)
        new = new.withColumns({"error": error, "lambda": F.when(F.coalesce(error <= TOLERANCE, F.lit(True)), F.col("lambda")).otherwise(moved)})
        state = stored(new.select(*state.columns), "mix-state", 1)
        if state.filter(F.col("error") > TOLERANCE).limit(1).count() == 0:
            break
    else:
        if state.filter(F.col("error") > WORST).limit(1).count():
            raise RuntimeError(f"Newton's steps did not settle in {MOST_STEPS}")
    return state.select("source", "source_size", "target", "mean", "lambda")


def _with_rates(rows: DataFrame, state: DataFrame) -> DataFrame:
    """rows (with size, source and chance) and their whole copies and rounding key."""
    s = small(state.withColumnRenamed("source", "_source"))
    out = rows.join(s, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    r = F.coalesce(rate(F.col("lambda"), F.col("size"), F.col("mean")), F.lit(1.0))
    out = out.withColumn("_rate", F.round(r, 12))
    out = out.withColumn("_whole", F.floor("_rate").cast("long"))
    part = F.col("_rate") - F.col("_whole")
    key = F.floor((F.col("_chance") - part + 1) * F.lit(float(1 << (KEY_BITS - 1)))).cast("long")
    return out.withColumn("_key", F.when((part > 0) & (F.col("size") > 0), F.least(F.greatest(key, F.lit(0)), F.lit((1 << KEY_BITS) - 1))))


def cuts(rows: DataFrame, state: DataFrame) -> DataFrame:
    """state, and a cut per source: documents whose key is at most the cut get one more copy.

    The cut is a weighted quantile of the keys, found ten bits at a time: each
    pass sums words by (source, bin), at most 1024 bins a source."""
    whole = _with_rates(rows, state).groupBy("source").agg(F.sum(F.col("size") * F.col("n") * F.col("_whole")).alias("given")).withColumnRenamed("source", "_source")
    known = state.join(whole, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    known = stored(known.withColumns({"need": F.col("target") - F.coalesce("given", F.lit(0)), "prefix": F.lit(0).cast("long")}).drop("given"), "mix-cut", 1)
    for level in range(KEY_BITS // LEVEL_BITS):
        shift = KEY_BITS - LEVEL_BITS * (level + 1)
        k = _with_rates(rows, known).filter(F.col("_key").isNotNull() & (F.shiftright("_key", shift + LEVEL_BITS) == F.col("prefix")))
        bins = k.groupBy(F.col("source").alias("_source"), F.shiftright("_key", shift).alias("bin")).agg(F.sum(F.col("size") * F.col("n")).alias("words"))
        w = Window.partitionBy("_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("upto", F.sum("words").over(w))
        at = bins.join(small(known.select("source", "need")), F.col("source").eqNullSafe(F.col("_source")))
        last = level == KEY_BITS // LEVEL_BITS - 1
        # The first bin that reaches what is needed; if none does, all bins are taken.
        reached = F.col("upto") >= F.col("need")
        at = at.groupBy("_source").agg(F.min(F.when(reached, F.col("bin"))).alias("bin"), F.max("bin").alias("top"), F.max(F.when(~reached, F.col("upto"))).alias("below"))
        new = known.join(at, F.col("source").eqNullSafe(F.col("_source")), "left")
        prefix = F.coalesce(F.col("bin") - (1 if last else 0), F.col("top"), F.lit(-1) if last else F.lit(0))
        # On lower levels only the bin chosen above counts; its own start is what lies below it.
        new = new.withColumns({"prefix": prefix, "need": F.when(F.col("bin").isNull(), F.col("need")).otherwise(F.col("need") - F.coalesce("below", F.lit(0)))})
        known = stored(new.select(*known.columns), "mix-cut", 1)
    return known.select("source", "source_size", "target", "mean", "lambda", F.col("prefix").alias("cut"))


#: Single documents per source that may get one copy more or less after rounding.
MOST_FIXES = 4
#: Sources that come this near their target need none.
CLOSE = 0.001


def _copies(rate_: Column, size: Column, chance_: Column, cut: Column, fixes: Column) -> Column:
    """Whole copies of a document: its rate rounded by its key, and the source's fixes."""
    whole = F.floor(rate_).cast("long")
    part = rate_ - whole
    key = F.least(F.greatest(F.floor((chance_ - part + 1) * F.lit(float(1 << (KEY_BITS - 1)))).cast("long"), F.lit(0)), F.lit((1 << KEY_BITS) - 1))
    more = F.when((part > 0) & (key <= cut), 1).otherwise(0)
    fix = F.aggregate(F.filter(F.coalesce(fixes, F.array().cast("array<struct<chance:double,delta:int>>")), lambda f: f["chance"] == chance_), F.lit(0), lambda x, f: x + f["delta"])
    n = F.least(whole + more, F.lit(MOST_COPIES)) + fix
    return F.when(size == 0, F.lit(1)).otherwise(F.least(F.greatest(n, F.lit(0)), F.lit(MOST_COPIES))).cast("int")


def settled(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """fitted and fixes: what rounding leaves open in a source is made up, one document at a
    time, by the document whose size comes nearest, with one copy more or less.

    Sources of many documents need none to speak of; in small ones a single large
    document would else decide how near the target they come."""
    few = fitted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    mark = F.broadcast if few else (lambda d: d)

    def with_copies(known: DataFrame) -> DataFrame:
        s = known.withColumnRenamed("source", "_source")
        r = rows.join(mark(s), F.col("source").eqNullSafe(F.col("_source"))).filter("size > 0")
        r = r.withColumn("_rate", F.round(rate(F.col("lambda"), F.col("size"), F.col("mean")), 12))
        return r.withColumn("_copies", _copies(F.col("_rate"), F.col("size"), F.col("_chance"), F.col("cut"), F.col("fixes")))

    known = fitted.withColumn("fixes", F.array().cast("array<struct<chance:double,delta:int>>"))
    taken = with_copies(known).groupBy(F.col("_source").alias("_t")).agg(F.sum(F.col("size") * F.col("n") * F.col("_copies")).alias("_taken"))
    known = known.join(taken, F.col("source").eqNullSafe(F.col("_t")), "left").withColumn("need", F.col("target") - F.coalesce("_taken", F.lit(0)))
    known = stored(known.drop("_t", "_taken"), "mix-fit", 1)
    for _ in range(MOST_FIXES):
        open_ = known.filter(F.abs("need") > CLOSE * F.col("target"))
        if open_.isEmpty():
            break
        words_ = F.col("size") * F.col("n")
        delta = F.when(F.col("need") > 0, 1).otherwise(-1)
        able = F.when(delta > 0, F.col("_copies") < MOST_COPIES).otherwise(F.col("_copies") > 0)
        fixed = F.exists("fixes", lambda f: f["chance"] == F.col("_chance"))
        off = F.abs(F.abs(F.col("need")) - words_)
        d = with_copies(open_).filter(able & ~fixed & (off < F.abs(F.col("need"))))
        best = d.groupBy(F.col("_source").alias("_b")).agg(F.min(F.struct(off.alias("off"), F.col("_chance").alias("chance"), delta.alias("delta"), words_.alias("words"))).alias("best"))
        new = known.join(best, F.col("source").eqNullSafe(F.col("_b")), "left")
        has = F.col("best").isNotNull()
        added = F.when(has, F.concat("fixes", F.array(F.struct(F.col("best.chance").alias("chance"), F.col("best.delta").cast("int").alias("delta"))))).otherwise(F.col("fixes"))
        left = F.when(has, F.col("need") - F.col("best.delta") * F.col("best.words")).otherwise(F.col("need"))
        known = stored(new.withColumns({"fixes": added, "need": left}).select(*known.columns), "mix-fit", 1)
    return known.drop("need")


def fit(docs: DataFrame, text: str = "text", source: str = "source", size: str | None = None, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Fit the mix of docs: one row a source with its target, multiplier, cut and fixes.

    Reads the texts once (or a column of sizes in their place); what Newton and the
    rounding read is a stored table of (source, size, chance). Empty table: no rows.
    Null text: size 0. A null source is a source of its own, last in order. Ids, null
    or not, only tell rows apart; equal rows are counted and then rounded one by one.
    Extra columns are not read; names that begin with _mix_ raise."""
    own = _marked(docs, text, source, size, identity).select(F.col("_mix_source").alias("source"), F.col("_mix_size").alias("size"), "_mix_row")
    groups = stored(own.groupBy("source", "size", "_mix_row").agg(F.count("*").alias("n")), "mix-sizes")
    hist = stored(groups.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-hist")
    if (groups.agg(F.max("n")).first()[0] or 0) > 1:
        rows = stored(_dealt(groups.withColumns({"_first": F.lit(0).cast("long"), "_all": F.col("n")})), "mix-rows")
    else:
        rows = groups.withColumn("_chance", _chance(F.col("_mix_row")))
    rows = rows.select("source", "size", "_chance", F.lit(1).cast("long").alias("n"))
    return settled(rows, cuts(rows, solve(hist)))


OUT = ("_size", "_source_size", "_target", "_rate", "_copies")


def copies(docs: DataFrame, mix: DataFrame, text: str = "text", source: str = "source", size: str | None = None, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """docs and _size, _source_size, _target, _rate and _copies of each row under a fitted mix.

    Of n rows equal in the identity columns as many get a copy more as the mix says, in
    the order of a hash of their other columns (maps excepted). An input with one of
    these names, or one that begins with _mix_, raises."""
    clash = {c.lower() for c in docs.columns} & set(OUT)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    base = _marked(docs, text, source, size, identity)
    twins = stored(base.groupBy("_mix_row").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("_mix_row").alias("_mix_twin")), "mix-twins")
    if twins.isEmpty():
        base = base.withColumn("_chance", _chance(F.col("_mix_row")))
    else:
        same, t = F.col("_mix_row") == F.col("_mix_twin"), small(twins)
        keys = [*_hashable(docs), "_mix_source", "_mix_size", "_mix_row"]
        rest = [F.first(c).alias(c) for c in base.columns if c not in keys]
        many = base.join(t, same, "left_semi").groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("n"), *rest)
        many = stored(many.withColumn("_mix_whole", _hash(_hashable(docs))), "mix-equal")
        of_row = Window.partitionBy("_mix_row")  # one row a kind of equal rows, not a row of docs
        before = of_row.orderBy("_mix_whole").rowsBetween(Window.unboundedPreceding, -1)
        kinds = many.select(F.col("_mix_row").alias("_r"), F.col("_mix_whole").alias("_w"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"), F.sum("n").over(of_row).alias("_all"))
        many = many.join(kinds, (F.col("_mix_row") == F.col("_r")) & (F.col("_mix_whole") == F.col("_w"))).drop("_r", "_w", "_mix_whole")
        once = base.join(t, same, "left_anti").withColumn("_chance", _chance(F.col("_mix_row")))
        base = once.unionByName(_dealt(many))
    s = small(mix.select(*[F.col(c).alias(f"_mix_s_{c}") for c in mix.columns]))
    out = base.join(s, F.col("_mix_source").eqNullSafe(F.col("_mix_s_source")), "left")
    r = F.round(F.coalesce(rate(F.col("_mix_s_lambda"), F.col("_mix_size"), F.col("_mix_s_mean")), F.lit(1.0)), 12)
    n = F.when(F.col("_mix_size") == 0, F.lit(1)).otherwise(_copies(r, F.col("_mix_size"), F.col("_chance"), F.col("_mix_s_cut"), F.col("_mix_s_fixes")))
    return out.select(*docs.columns, F.col("_mix_size").alias("_size"), F.col("_mix_s_source_size").alias("_source_size"), F.col("_mix_s_target").alias("_target"), r.alias("_rate"), n.cast("int").alias("_copies"))


def mixed(docs: DataFrame, **columns: str) -> DataFrame:
    """docs, each row as often as the mix takes it (documents without words once)."""
    out = copies(docs, fit(docs, **columns), **columns)
    return out.filter("_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
