"""A search over inference's rules: sample, score on all files, keep the best, vary them, score again.

A configuration is a place in each parameter's list of values. The first round draws them by hash, one value a parameter,
each value of a parameter as often as any other (so the draws of all cover every value where there are enough). Each later
round takes those neighbours of the best that are one step away in one parameter and not yet scored. A round scores its
configurations on every file at once, what they share once, and adds one row each to the written scores, which is all
that the next round reads of it. Files are gathered, with their true counts, once a search.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch
from .inference import PRODUCTION, SPACE, Page, Rules, gathered, file_period, replayed, solved, stepwise

#: The seed, how many a sweep draws, and what it keeps after its first and second rounds, and in the end.
SEED = 42
DRAWN, FIRST, SECOND, LAST = 500, 20, 5, 10

Config = tuple[int, ...]


def space(names: Sequence[str] = tuple(SPACE)) -> dict[str, tuple]:
    return {n: SPACE[n] for n in names}


def drawn(values: dict[str, tuple], n: int, seed: int = SEED) -> list[Config]:
    """n configurations: of each parameter, every value as often as any other (but for the remainder), in an order of its own."""
    columns = []
    for name, own in values.items():
        order = sorted(range(n), key=lambda i: xxhash.xxh3_64_intdigest(f"{seed}:{name}:{i}"))
        columns.append([order[i] * len(own) // n for i in range(n)])
    return list(zip(*columns, strict=True))


def neighbours(values: dict[str, tuple], config: Config) -> list[Config]:
    """One step away in one parameter."""
    sizes = [len(v) for v in values.values()]
    return [(*config[:k], x, *config[k + 1 :]) for k, at in enumerate(config) for x in (at - 1, at + 1) if 0 <= x < sizes[k]]


def rules(values: dict[str, tuple], config: Config) -> Rules:
    return replace(PRODUCTION, **{name: own[k] for (name, own), k in zip(values.items(), config, strict=True)})


def outcome(pages: Sequence[Page], kinds: Sequence[str]) -> tuple[int, int, int]:
    """Documents, complete ones and inferred pages of a settled file."""
    documents = complete = place = 0
    declared, whole = None, True

    def closed() -> int:
        return int(declared is not None and whole and place == declared)

    for (number, total), kind in zip(pages, kinds, strict=True):
        if number is None:
            continue
        if number == 1:
            complete += closed()
            documents, place, declared, whole = documents + 1, 1, total, True
        elif documents:
            place += 1
            whole &= kind == "inferred" or (number == place and total == declared)
    return documents, complete + closed(), kinds.count("inferred")


#: As a sweep weighs files: the real ones (every third) by documents and complete ones, the others by inferred pages too.
_COMPOSITE = """
    SELECT config, CAST(sum(CASE WHEN d = 0 THEN CASE WHEN real THEN 5 ELSE 3 END ELSE 0 END + CASE WHEN (real AND complete >= true_complete) OR (NOT real AND d = 0 AND complete = true_complete) THEN 2 ELSE 0 END
        - CASE WHEN real THEN 3 * d ELSE d END - CASE WHEN real THEN greatest(0, true_complete - complete) ELSE abs(n_inferred - true_inferred) END - CASE WHEN passed_before AND NOT passed THEN 5 ELSE 0 END) AS BIGINT) AS composite,
      CAST(sum(d) AS BIGINT) AS delta, count_if(passed_before AND NOT passed) AS regressions
    FROM (SELECT *, d = 0 AND (real OR complete = true_complete) AS passed, b_documents = true_documents AND (real OR b_complete = true_complete) AS passed_before
      FROM (SELECT *, abs(documents - true_documents) AS d, pdf % 3 = 0 AS real, explode(configs) AS config FROM {c}) AS x) AS y
    GROUP BY config"""


_TRUTH = "true_documents bigint, true_complete bigint, true_inferred bigint"
_FILES = f"pdf bigint, curr array<int>, total array<int>, period int, period_sure double, expected int, {_TRUTH}"


def with_truth(s) -> DataFrame:
    """A row per file: its reads as arrays, its period and what `true_counts` says of it, written once."""
    path = scratch(s.spark, "sweep-files")
    truth = [F.expr(f"{c} AS {n}") for c, n in (("count_if(true_curr = 1)", "true_documents"), ("count_if(true_curr = period)", "true_complete"), ("count_if(method = 'failed')", "true_inferred"))]
    read = gathered(s["page_reads"], ["page", "curr", "total"], *truth).drop("page")

    def solve(rows):
        for pdf, curr, total, *more in rows:
            yield (pdf, curr, total, *file_period(curr, total), *more)

    files = solved(read, solve, _FILES)
    files.write.parquet(path)
    whole = s.spark.read.schema(files.schema).parquet(path)
    return whole.repartition(4 * s.spark.sparkContext.defaultParallelism, "pdf")  # small files, much work


#: Of each file, configurations with the same result together, by number.
_COUNTS = f"pdf bigint, configs array<int>, documents int, complete int, n_inferred int, b_documents int, b_complete int, {_TRUTH}"


def scored(files: DataFrame, values: dict[str, tuple], configs: Sequence[Config]) -> DataFrame:
    """config (its places, as text), composite, delta, regressions of each configuration over all files, against PRODUCTION."""
    names = [",".join(map(str, c)) for c in configs]
    tree = stepwise(enumerate([*(rules(values, c) for c in configs), PRODUCTION]))

    def solve(rows):
        for pdf, curr, total, period, sure, expected, *truth in rows:
            found = [(outcome(*x), own) for *x, own in replayed(curr, total, tree, (period, sure, expected))]
            base = next(got for got, own in found if len(names) in own)
            for got, own in found:
                yield (pdf, [k for k in own if k < len(names)], *got, *base[:2], *truth)

    numbered = files.sparkSession.sql(_COMPOSITE, c=solved(files, solve, _COUNTS))
    named = files.sparkSession.createDataFrame(list(enumerate(names)), "config int, name string")
    return numbered.join(F.broadcast(named), "config").select(F.col("name").alias("config"), "composite", "delta", "regressions")


def searched(s, values: dict[str, tuple], n: int, keep: Sequence[int]) -> DataFrame:
    """config, composite, delta, regressions, round of all that a search scores."""
    path, seen, todo, files = scratch(s.spark, "sweep"), set(), list(dict.fromkeys(drawn(values, n))), with_truth(s)
    ddl = "config string, composite bigint, delta bigint, regressions bigint, round int"
    for k in range(len(keep) + 1):
        if todo:
            scored(files, values, todo).withColumn("round", F.lit(k)).write.mode("overwrite").parquet(f"{path}/round={k}.parquet")
            seen |= set(todo)
        rounds = [f"{path}/round={j}.parquet" for j in range(k + 1) if j == 0 or todo or j < k]
        scores = s.spark.read.schema(ddl).parquet(*rounds)
        if k == len(keep) or not todo:
            return scores
        best = [tuple(map(int, r.config.split(","))) for r in top(scores, keep[k]).collect()]  # a row a configuration kept
        todo = [c for c in dict.fromkeys(x for b in best for x in neighbours(values, b)) if c not in seen]
    return scores


def top(scores: DataFrame, n: int) -> DataFrame:
    """The n best: by composite, then by documents off, then by name."""
    return scores.orderBy(F.desc("composite"), "delta", "config").limit(n)


def _search(s) -> DataFrame:
    """The whole sweep, over all parameters."""
    return searched(s, space(), DRAWN, (FIRST, SECOND))


def t03_top_configs(s) -> DataFrame:
    """The best rules of a search over all files."""
    return top(_search(s), LAST)


#: The parameters of `t08_sampled_configs`; primes, so that a parameter's places are each taken once unless there are as many configurations.
VARIED = ("start", "unfit", "least_start", "window", "agreement", "off_period")
_PRIMES = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081, 1_000_099)
_DRAWN = "SELECT b.id AS config, {pick} FROM (SELECT DISTINCT CAST(floor(p_partkey / 20) AS BIGINT) AS id FROM {{part}}) AS b CROSS JOIN (SELECT count(DISTINCT floor(p_partkey / 20)) AS n FROM {{part}}) AS c"
_PICK = ", ".join(f"CAST(floor((b.id * {prime} + {SEED}) % c.n * {len(v)} / c.n) AS INT) AS {name}" for prime, (name, v) in zip(_PRIMES, space(VARIED).items(), strict=True))


def t08_sampled_configs(s) -> DataFrame:
    """Drawn configurations, as many as there are score of parts: every value of a parameter as often as any other."""
    return s.sql(_DRAWN.format(pick=_PICK))


def t09_neighbour_configs(s) -> DataFrame:
    """What a search would try next around its best rules."""
    values = space()
    best = top(_search(s), SECOND).select(F.transform(F.split("config", ","), lambda x: x.cast("int")).alias("c"))
    sizes = F.array(*[F.lit(len(v)) for v in values.values()])
    steps = F.explode(F.expr(f"flatten(transform(sequence(0, {len(values) - 1}), k -> array(struct(k, -1 AS step), struct(k, 1 AS step))))")).alias("s")
    moved = best.select("c", steps).withColumn("to", F.expr("c[s.k] + s.step")).filter((F.col("to") >= 0) & (F.col("to") < sizes[F.col("s.k")]))
    config = F.array_join(F.expr("transform(c, (x, i) -> CAST(IF(i = s.k, to, x) AS STRING))"), ",")
    return moved.select(config.alias("config")).distinct()


OPERATORS: dict[str, Callable] = {f.__name__: f for f in (t03_top_configs, t08_sampled_configs, t09_neighbour_configs)}
SQL = {"t08_sampled_configs": _DRAWN.format(pick=_PICK)}
