"""URL filter by host and path rules and a character language-model ratio, in DataFrame
operations only.

URLs that rules accept and reject train one smoothed variable-order Markov model each. Both
have the same contexts: all of up to ``ORDER`` characters that were seen. Symbol probabilities are Witten-Bell
estimates, each context's mixed with those of its next shorter one. Any other URL is judged by the difference
of its log-likelihoods under both, by symbol, against a threshold calibrated on ruled URLs
kept out of the counts.

With a context its prefix and its suffix are at least as frequent, so the ``DENSE_STATES`` most frequent ones are
the states of an automaton: for each state and symbol there is a next state and a log ratio. These two
arrays have a fixed size, and a URL is one fold over its symbols. What the other contexts add is found by joins
(``beyond``): each symbol that may have a longer context than its state is met by its exact log ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, let, read_table

ORDER = 5
#: Contexts that the automaton holds.
DENSE_STATES = 2048
#: (verdict, rule): host up to the first slash, then the path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Symbols 1 to 62: the start, the end, any other character, and characters of URLs. 0 is before the start.
ALPHABET = "^$ abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!&'()*+,;=%"
START, END, OTHER = 1, 2, 3
A = 64
#: More contexts than there can be: the models leave none out.
MOST_STATES = A**ORDER
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Any character of a URL's own that is none of these; ^ and $ are kept for its ends.
_ODD = r"[^a-z0-9\-._~:/?#\[\]@!&'()*+,;=%]"


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.when(has, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")
    return host, F.when(has, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def ruled(rules: list[tuple[str, str]]) -> Column:
    """A struct of rule and verdict of the longest rule that fits ``host`` and ``path``, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        out = F.when(fits & F.col("path").startswith(slash + path), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """Numbers of a whole URL's symbols, with start and end; of a null one only these."""
    plain = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), _ODD, " ")
    each = F.transform(F.split(F.concat(F.lit("^"), plain, F.lit("$")), ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.filter(each, lambda x: x > 0)


def grams(symbols: Column) -> Column:
    """For each symbol but the start a number of it and the ``ORDER`` symbols before, in base ``A``."""
    padded = F.concat(F.array(*[F.lit(0)] * (ORDER - 1)), symbols)
    number = lambda c, i: sum((F.get(c, i + k).cast("long") * A ** (ORDER - k) for k in range(ORDER + 1)), F.lit(0).cast("long"))
    return let(padded, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: number(c, i)))


def context_counts(labelled: DataFrame) -> DataFrame:
    """For each context (``k`` symbols with number ``context``) and next symbol ``c``: how often accepted (``a``) and rejected (``b``) URLs have it."""
    whole = labelled.select("verdict", F.explode(grams(F.col("symbols"))).alias("g")).groupBy("g").agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")
    )
    orders = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("g") % A ** (k + 1)).alias("g")) for k in range(ORDER + 1)])
    each = whole.select("a", "b", F.explode(orders).alias("x")).select("a", "b", "x.k", "x.g").where(f"k = 0 or g >= power({A}, k)")
    return each.groupBy("k", F.expr(f"g div {A}").alias("context"), F.expr(f"cast(g % {A} as int)").alias("c")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """``k``, ``context`` and ``id`` of the ``most`` most frequent contexts, of equal ones the shortest first. That without symbols has id 0."""
    # ``most`` rows at most.
    order = [F.desc("n"), F.col("k"), F.col("context")]
    kept = counts.groupBy("k", "context").agg(F.sum(F.col("a") + F.col("b")).alias("n")).where("k > 0").orderBy(*order).limit(most - 1)
    return cut(kept.withColumn("id", F.row_number().over(Window.orderBy(*order))).select("k", "context", "id").unionByName(counts.sparkSession.range(1).selectExpr("0 as k", "0L as context", "0 as id")))


def both_kinds(counts: DataFrame) -> Column:
    """Whether both accepted and rejected URLs were counted."""
    return counts.select((F.coalesce(F.sum("a"), F.lit(0)) > 0) & (F.coalesce(F.sum("b"), F.lit(0)) > 0)).scalar()


def automaton(labelled: DataFrame, most: int = DENSE_STATES) -> DataFrame:
    """``tables`` of the ``most`` most frequent contexts of ``labelled``, which has ``verdict`` and ``symbols``."""
    counts = cut(context_counts(labelled))
    return tables(counts, frequent(counts, most))


def tables(counts: DataFrame, states: DataFrame) -> DataFrame:
    """One row: ``next`` and ``ratios``, each with an element for each state and symbol, state by state. State 0 has
    no context. All ratios are 0 if one of the two verdicts has no URL."""
    every = F.sequence(F.lit(0), F.lit(A - 1))
    spread = lambda pairs, value, none: F.transform(every, lambda c: F.coalesce(F.get(F.transform(F.filter(pairs, lambda x: x["c"] == c), lambda x: x[value]), 0), F.lit(none)))
    own = counts.join(F.broadcast(states), ["k", "context"]).groupBy("id").agg(
        F.collect_list(F.struct("c", "a", "b")).alias("x"), *[F.sum(v).alias(f"n{v}") for v in "ab"], *[F.count_if(F.col(v) > 0).alias(f"t{v}") for v in "ab"]
    )
    # The state a symbol leads to is the context with it, where there is one.
    child = states.where("k > 0").select((F.col("k") - 1).alias("k"), F.expr(f"context div {A}").alias("context"), F.struct(F.expr(f"cast(context % {A} as int)").alias("c"), "id").alias("x"))
    child = child.groupBy("k", "context").agg(F.collect_list("x").alias("children"))
    rows = states.join(own, "id", "left").join(child, ["k", "context"], "left").select(
        "k", "context", "id",
        *[F.coalesce(spread(F.col("x"), v, 0), F.transform(every, lambda c: F.lit(0).cast("long"))).alias(v) for v in "ab"],
        *[F.coalesce(f, F.lit(0)).alias(f) for f in ("na", "nb", "ta", "tb")],
        F.coalesce(spread(F.col("children"), "id", -1), F.transform(every, lambda c: F.lit(-1))).alias("to"),
    )
    rows = cut(rows)
    # All shorter contexts of each state, shortest first.
    chain = states.select(F.col("id").alias("state"), "context", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("k"))
    chain = chain.select("state", "k", (F.col("context") % F.pow(F.lit(A), F.col("k")).cast("long")).alias("context")).join(rows, ["k", "context"])
    held = chain.groupBy("state").agg(F.sort_array(F.collect_list(F.struct("k", "a", "b", "na", "nb", "ta", "tb", "to"))).alias("chain"))

    def mixed(v: str) -> Column:
        start = F.transform(every, lambda c: F.lit(1.0 / (len(ALPHABET) - 1)))
        step = lambda p, s: F.when(s[f"n{v}"] == 0, p).otherwise(F.zip_with(p, s[v], lambda x, n: (n + s[f"t{v}"] * x) / (s[f"n{v}"] + s[f"t{v}"])))
        return F.aggregate("chain", start, step)

    follow = F.aggregate("chain", F.transform(every, lambda c: F.lit(0)), lambda old, s: F.zip_with(old, s["to"], lambda x, y: F.when(y >= 0, y).otherwise(x)))
    held = held.select("state", follow.alias("to"), F.zip_with(mixed("a"), mixed("b"), lambda x, y: F.log(x) - F.log(y)).alias("r"))
    row = held.agg(F.sort_array(F.collect_list(F.struct("state", "to", "r"))).alias("all"))
    ratios = F.flatten(F.transform("all", lambda x: x["r"]))
    known = both_kinds(counts)
    return row.select(F.flatten(F.transform("all", lambda x: x["to"])).alias("next"), F.when(known, ratios).otherwise(F.transform(ratios, lambda x: F.lit(0.0))).alias("ratios"))


def beyond(rows: DataFrame, counts: DataFrame, states: DataFrame, hot: int = DENSE_STATES) -> DataFrame:
    """``__id`` and ``__more``: what contexts that are no ``states`` add to the sum of log ratios of ``rows`` (``__id``, ``symbols``),
    0 or no row if nothing. It is summed as decimals, so in any order alike.

    A symbol whose whole context of ``ORDER`` symbols is a state is left to the automaton. The others, with their contexts, are counted;
    each distinct one's probabilities are mixed from the shortest context to the longest, in a join for each length that
    meets a shorter one with ``A`` longer ones at most. Those that are one in ``hot`` of all or more are sent to all tasks, ``hot`` at most, so none is a key of the last join.
    """
    each = rows.select("__id", F.explode(grams(F.col("symbols"))).alias("g"))
    # A context's number tells its length: no symbol is 0.
    each = each.join(F.broadcast(states.where("k > 0").select(F.col("context").alias("__state"))), F.expr(f"g div {A}") == F.col("__state"), "left_anti")
    asked = cut(each.groupBy("g").agg(F.count("*").alias("n")))
    seen = counts.select((F.col("context") * A + F.col("c")).alias("__g"), "a", "b")
    context = counts.groupBy("context").agg(*[F.sum(v).alias(f"n{v}") for v in "ab"], *[F.count_if(F.col(v) > 0).alias(f"t{v}") for v in "ab"])
    context = context.join(F.broadcast(states.select("context", F.lit(True).alias("state"))), "context", "left")
    # Those near the start have no longer contexts: their own number stands for these, which change nothing.
    of = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("g") % A ** (k + 1)).alias("g"), ((F.col("g") % A ** (k + 1)) >= A**k).alias("has")) for k in range(ORDER + 1)])
    own = asked.select(F.explode(of).alias("x")).select("x.*").distinct()
    own = own.join(seen, F.col("has") & (F.col("g") == F.col("__g")), "left").join(context, F.col("has") & (F.expr(f"g div {A}") == F.col("context")), "left")
    own = cut(own.select("k", "g", "state", *[F.coalesce(v, F.lit(0)).alias(v) for v in ("a", "b", "na", "nb", "ta", "tb")]))
    found = own.where("k = 0").select(F.col("g").alias("short"), *[F.lit(1.0 / (len(ALPHABET) - 1)).alias(f"p{v}") for v in "ab"], F.lit(0.0).alias("dense"))
    for k in range(ORDER + 1):
        mixed = lambda v: F.when(F.col(f"n{v}") == 0, F.col(f"p{v}")).otherwise((F.col(v) + F.col(f"t{v}") * F.col(f"p{v}")) / (F.col(f"n{v}") + F.col(f"t{v}")))
        found = own.where(F.col("k") == k).join(found, (F.col("g") % A ** max(k, 1)) == F.col("short")).select("g", "state", "dense", *[mixed(v).alias(f"p{v}") for v in "ab"])
        # The longest state's ratio is what the automaton has summed.
        found = found.select(F.col("g").alias("short"), "pa", "pb", F.when(F.col("state"), F.log("pa") - F.log("pb")).otherwise(F.col("dense")).alias("dense"))
    found = found.where(both_kinds(counts)).select(F.col("short").alias("g"), (F.log("pa") - F.log("pb") - F.col("dense")).cast("decimal(18,12)").alias("d"))
    found = cut(asked.join(found, "g"))
    often = found.where(F.col("n") * hot >= found.select(F.sum("n")).scalar()).select("g", "d")
    seldom = each.join(F.broadcast(often.select("g")), "g", "left_anti").join(found.where("d <> 0").select("g", "d"), "g")
    return each.join(F.broadcast(often), "g").select("__id", "d").unionByName(seldom.select("__id", "d")).groupBy("__id").agg(F.sum("d").cast("double").alias("__more"))


def scored(rows: DataFrame, model: DataFrame, more: Column | None = None) -> DataFrame:
    """Adds ``score``, rounded to 9 digits: the mean log ratio of a URL's symbols but the start, to whose sum ``more`` is added."""
    # One row with two arrays of fixed size, about 1.5 MB, met by a hash join on a key that is always 0.
    zero = lambda c: F.coalesce(F.pmod(F.hash(F.size(c)), F.lit(1)), F.lit(0))
    both = rows.withColumn("__one", zero("symbols")).join(F.broadcast(model.withColumn("__one", zero("next"))), "__one")
    first = F.struct(F.get("next", F.lit(START)).alias("s"), F.lit(0.0).alias("sum"))
    at = lambda a, c: a["s"] * A + c
    step = lambda a, c: F.struct(F.get(F.col("next"), at(a, c)).alias("s"), (a["sum"] + F.get(F.col("ratios"), at(a, c))).alias("sum"))
    total = F.aggregate(F.slice("symbols", F.lit(2), F.size("symbols") - 1), first, step)["sum"]
    total = total if more is None else total + more
    return both.withColumn("score", F.round(total / (F.size("symbols") - 1), 9)).drop("next", "ratios", "__one")


def calibrate(held: DataFrame) -> DataFrame:
    """One row with ``threshold``: of all hundredths from -5 to 5 that split the calibration
    URLs (``verdict``, ``score``), the one with the highest sum of the rates of accepted
    URLs at or above it and rejected ones below it; of equal ones the middle, 0 without both kinds."""
    spark = held.sparkSession
    bins = held.groupBy(F.greatest(F.lit(-501), F.least(F.lit(500), F.floor(F.col("score") * 100))).cast("int").alias("bin")).agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")
    )
    # 1002 bins: the first has all scores below -5, which no threshold accepts.
    whole = spark.range(-501, 501, 1, 1).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left").fillna(0)
    row = whole.agg(F.sort_array(F.collect_list(F.struct("bin", "a", "b"))).alias("x"))
    row = row.selectExpr("x", "aggregate(x, 0L, (s, y) -> s + y.a) as na", "aggregate(x, 0L, (s, y) -> s + y.b) as nb")
    row = row.selectExpr(
        "na", "nb",
        """aggregate(slice(x, 2, size(x) - 1), named_struct('la', x[0].a, 'lb', x[0].b, 'out', cast(array() as array<struct<g:double,t:int>>)),
             (s, y) -> named_struct('la', s.la + y.a, 'lb', s.lb + y.b, 'out', array_append(s.out,
               named_struct('g', cast(na - s.la as double) / greatest(na, 1L) + cast(s.lb as double) / greatest(nb, 1L), 't', y.bin)))).out as gains""",
    )
    row = row.selectExpr("na", "nb", "gains", "array_max(transform(gains, y -> y.g)) as most")
    best = "transform(filter(gains, y -> y.g = most), y -> y.t)"
    return row.selectExpr(f"if(na > 0 and nb > 0, element_at({best}, cast((size({best}) + 1) div 2 as int)) / 100.0D, 0.0D) as threshold")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", dense: int = DENSE_STATES) -> DataFrame:
    """One row per row of ``pages``: ``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``score``.

    A null url, or one without ``://``, has empty host and path, fits no rule and is judged by
    the models, which read the whole url, of any length. Rows are judged one by one, so repeated ones alike, and
    those without key too; the models count each row. Of rules that fit the longest wins, of equally long ones
    the last by alphabet. A score at the threshold is accepted. Ruled rows whose crc32(url) leaves 2 by 4 calibrate
    the threshold and are not counted; without accepted or without rejected ones the threshold, and all scores, are 0.
    ``dense`` contexts are in the automaton; it changes no result. An empty table gives an empty one. Other columns are not read, whatever their names.
    """
    rows = cut(pages.select(F.col(key), F.col(url).alias("__url")).withColumn("__id", F.monotonically_increasing_id()))

    def read(rows: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("__url"))
        rows = rows.withColumn("host", host).withColumn("path", path)
        return rows.withColumn("__rule", ruled(rules)).withColumn("symbols", symbols(F.col("__url")))

    fold = F.crc32(F.col("__url").cast("binary")) % 4 == 2
    labelled = read(rows).where("__rule is not null").where(~fold).select(F.col("__rule.verdict").alias("verdict"), "symbols")
    counts = cut(context_counts(labelled))
    states = frequent(counts, dense)
    model = cut(tables(counts, states))
    more = beyond(rows.select("__id", symbols(F.col("__url")).alias("symbols")), counts, states)
    judged = scored(read(rows.join(more, "__id", "left")), model, F.coalesce("__more", F.lit(0.0)))
    judged = cut(judged.select(key, "host", "path", "__rule", (F.col("__rule").isNotNull() & fold).alias("__held"), "score"))
    threshold = cut(calibrate(judged.where("__held").select(F.col("__rule.verdict").alias("verdict"), "score"))).scalar()
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return judged.select(key, "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))
