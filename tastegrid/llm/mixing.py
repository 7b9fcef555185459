"""Mixing sources to target weights in a tree of domain, language and source.

A budget of tokens is dealt out from the root down. Children share their
parent's tokens in proportion to their weights; what a child cannot use, as
its leaves hold no more tokens times epochs, goes to its siblings in the same
proportion, and only what a whole subtree cannot use goes further up. Each leaf
takes a prefix of its tokens from epochs, each a new seeded order of all its
documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.frames import quoted
from tastegrid.session import materialize

LEVELS = ("domain", "language", "origin")
DOMAINS = 4
BUCKET_ROWS = 4096
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Mix:
    """Whole weights by path in the tree (1 where none is given; 0 takes nothing).

    The budget is `percent` of all tokens of the documents.
    """

    weights: Mapping[tuple[str, ...], int] = field(default_factory=dict)
    percent: int = 50
    max_epochs: int = 1
    seed: int = 11


#: The registered query and the pipeline lift small domains and languages.
DEFAULT_WEIGHTS = {
    ("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1,
    **{(f"d{k}", name): 2 for k in range(DOMAINS) for name in ("en", "fr")},
}


def tree_columns() -> dict[str, Column]:
    """Domain (the number that ends the source's name, by DOMAINS), language, source.

    Null counts as `-`, a source without a number belongs to domain `-`.
    """
    number = F.regexp_extract("source", r"(\d{1,9})$", 1).try_cast("int")
    return {
        "domain": F.coalesce(F.concat(F.lit("d"), (number % DOMAINS).cast("string")), F.lit("-")),
        "language": F.coalesce("lang", F.lit("-")),
        "origin": F.coalesce("source", F.lit("-")),
    }


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str, budget: str) -> DataFrame:
    """Deal `budget` of each parent to its children by weight, none above its room.

    Sorted by room per weight, the children that fill up are a prefix; the
    others share the rest.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("room") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    within = Window.partitionBy(*parent)
    sized = nodes.withColumns(
        {"room_before": F.coalesce(F.sum("room").over(before), F.lit(0)), "weight_left": F.sum("weight").over(after)}
    ).withColumn("full", F.expr(f"room * weight_left <= ({budget} - room_before) * weight"))
    sized = sized.withColumns(
        {
            "used": F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).over(within),
            "open": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(within),
        }
    )
    share = F.when(F.col("full"), F.col("room")).otherwise(F.expr(f"(({budget} - used) * weight) div open"))
    return sized.withColumn("share", share)


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Rows of domain, language, origin, tokens and budget from leaves with tokens."""
    spark = leaves.sparkSession
    nodes = leaves.withColumns({"room": F.col("tokens") * mix.max_epochs, "root": F.lit(0)})
    levels: list[DataFrame] = []
    for depth in range(len(LEVELS), 0, -1):
        path = list(LEVELS[:depth])
        given = [(*key, value) for key, value in mix.weights.items() if len(key) == depth]
        schema = ", ".join(f"{name} string" for name in path) + ", given long"
        nodes = nodes.join(spark.createDataFrame(given, schema), path, "left")
        zero = F.col("given") == 0
        nodes = nodes.withColumns(
            {
                "weight": F.when(zero, 1).otherwise(F.coalesce("given", F.lit(1))).cast("long"),
                "room": F.when(zero, 0).otherwise(F.col("room")),
            }
        ).drop("given")
        levels.insert(0, nodes)
        nodes = nodes.groupBy("root", *path[:-1]).agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens"))
    budgets = nodes.select("root", F.expr(f"tokens * {mix.percent} div 100").alias("budget"))
    for depth, level in enumerate(levels):
        parent = ["root", *LEVELS[:depth]]
        dealt = _share(level.join(budgets, parent), parent, LEVELS[depth], "budget")
        budgets = dealt.select(*parent, LEVELS[depth], "tokens", F.col("share").alias("budget"))
        if depth + 1 < len(levels):
            budgets = budgets.drop("tokens")
    return budgets.drop("root")


def _place(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("-"))))


def mix_documents(docs: DataFrame, mix: Mix, key: str = "doc_id", prefix: str = "") -> DataFrame:
    """The chosen rows of `docs` with domain, language, origin, epoch and n_tokens, named after `prefix`.

    Tokens are words between white space. Epochs count from 0; a row chosen in
    two epochs appears twice. Within an epoch rows go by md5 of seed, epoch and
    id, then id, then text, null first; repeated rows count each on their own.
    The prefix ends before the first row that would exceed the leaf's budget.
    Empty tables give empty results. Columns of the added names are replaced.

    No leaf is sorted as one group: the cumulative sums of hash buckets say
    which bucket holds the end of the prefix, and only that bucket is sorted.
    """
    added = [prefix + name for name in (*LEVELS, "epoch", "n_tokens")]
    kept = [name for name in docs.columns if name not in added]
    leaf = tree_columns()
    narrow = materialize(docs.select(*(value.alias(name) for name, value in leaf.items()), F.col(key).alias("__key"), token_count().alias("n_tokens")))
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    budgets = leaf_budgets(leaves.drop("rows"), mix).withColumns(
        {
            "full": F.expr("if(tokens = 0, 0, budget div tokens)"),
            "rest": F.expr("if(tokens = 0, 0, budget % tokens)"),
        }
    )
    sizes = leaves.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("leaves")).first()
    digits = 1
    while sizes["rows"] > BUCKET_ROWS * 16**digits and digits < 8:
        digits += 1
    budgets = materialize(budgets.select(*LEVELS, "full", "rest"))
    if sizes["leaves"] <= BROADCAST_LEAVES:
        budgets = F.broadcast(budgets)

    def bucket(place: Column) -> Column:
        return F.substring(place, 1, digits)

    sums = (
        narrow.join(budgets, list(LEVELS))
        .groupBy(*LEVELS, "rest", bucket(_place(mix.seed, F.col("full"), F.col("__key"))).alias("bucket"))
        .agg(F.sum("n_tokens").alias("n"))
    )
    order = Window.partitionBy(*LEVELS).orderBy("bucket")
    ends = sums.withColumn("through", F.sum("n").over(order)).where("through > rest")
    ends = ends.groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("through") - F.col("n")).alias("before")), "bucket").alias("end"))
    plan = materialize(budgets.join(ends, list(LEVELS), "left").select(*LEVELS, "full", "rest", "end.bucket", "end.before"))
    if sizes["leaves"] <= BROADCAST_LEAVES:
        plan = F.broadcast(plan)

    own = [f"__{name}" for name in (*LEVELS, "full", "rest", "bucket", "before")]
    rows = docs.select(*(F.col(quoted(name)) for name in kept), *(value.alias(f"__{name}") for name, value in leaf.items()))
    rows = rows.join(plan.toDF(*own), own[: len(LEVELS)])
    rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__full"))))
    rows = rows.withColumn("__place", _place(mix.seed, F.col("__epoch"), F.col(quoted(key))))
    at, partial = bucket(F.col("__place")), F.col("__epoch") == F.col("__full")
    results = [F.col(quoted(name)) for name in kept]
    results += [F.col(f"__{name}").alias(prefix + name) for name in (*LEVELS, "epoch", "n_tokens")]
    whole = rows.where(~partial | F.col("__bucket").isNull() | (at < F.col("__bucket"))).withColumn("__n_tokens", token_count())
    edge = rows.where(partial & (at == F.col("__bucket"))).withColumn("__n_tokens", token_count())
    inside = Window.partitionBy(*own[: len(LEVELS)]).orderBy("__place", F.asc_nulls_first(quoted(key)), F.asc_nulls_first("text"))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("__through", F.sum("__n_tokens").over(inside)).where("__before + __through <= __rest")
    return whole.select(*results).unionByName(edge.select(*results))


def mix_sql(mix: Mix) -> str:
    """DuckDB SQL for the ids that mix_documents chooses from the table documents."""
    depth_values = {
        depth: ", ".join(
            "(" + ", ".join(f"'{part}'" for part in key) + f", {value})"
            for key, value in mix.weights.items() if len(key) == depth
        )
        for depth in (1, 2, 3)
    }
    steps = []
    for depth in (3, 2, 1):
        path = ", ".join(LEVELS[:depth])
        source = "leaf" if depth == 3 else f"room{depth + 1}"
        room = f"sum(tokens) * {mix.max_epochs}" if depth == 3 else "sum(room)"
        base = f"SELECT {path}, {room} AS room FROM {source} GROUP BY {path}"
        if depth_values[depth]:
            names = ", ".join([*LEVELS[:depth], "given"])
            weighed = (
                f"SELECT b.*, given FROM ({base}) b LEFT JOIN (VALUES {depth_values[depth]}) w({names}) USING ({path})"
            )
        else:
            weighed = f"SELECT b.*, NULL AS given FROM ({base}) b"
        steps.append(
            f"room{depth} AS (SELECT {path}, CASE WHEN given = 0 THEN 0 ELSE room END AS room, "
            f"CASE WHEN given = 0 THEN 1 ELSE coalesce(given, 1) END AS weight FROM ({weighed}))"
        )
    for depth in (1, 2, 3):
        parent = ", ".join(LEVELS[: depth - 1]) or "1"
        path = ", ".join(LEVELS[:depth])
        joined = (
            f"(SELECT *, (SELECT sum(tokens) * {mix.percent} // 100 FROM leaf) AS budget FROM room1)"
            if depth == 1
            else f"(SELECT r.*, s.share AS budget FROM room{depth} r JOIN share{depth - 1} s USING ({parent}))"
        )
        steps.append(
            f"share{depth} AS (SELECT {path}, CAST(CASE WHEN is_full THEN room ELSE (budget - used) * weight // open END AS BIGINT) AS share "
            f"FROM (SELECT *, sum(CASE WHEN is_full THEN room ELSE 0 END) OVER (PARTITION BY {parent}) AS used, "
            f"sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS open "
            f"FROM (SELECT *, room * weight_left <= (budget - room_before) * weight AS is_full "
            f"FROM (SELECT *, coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room_before, "
            f"sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left "
            f"FROM {joined} WINDOW o AS (PARTITION BY {parent} ORDER BY room / weight, {LEVELS[depth - 1]})))))"
        )
    return rf"""
WITH doc AS (
  SELECT doc_id, text,
         coalesce('d' || CAST(TRY_CAST(regexp_extract(source, '(\d{{1,9}})$', 1) AS INTEGER) % {DOMAINS} AS VARCHAR), '-') AS domain,
         coalesce(lang, '-') AS language, coalesce(source, '-') AS origin,
         coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS n_tokens
  FROM documents
), leaf AS (SELECT domain, language, origin, sum(n_tokens) AS tokens FROM doc GROUP BY ALL),
{", ".join(steps)},
target AS (
  SELECT l.*, CASE WHEN tokens = 0 THEN 0 ELSE share // tokens END AS full_epochs,
         CASE WHEN tokens = 0 THEN 0 ELSE share % tokens END AS rest
  FROM leaf l JOIN share3 USING (domain, language, origin)
), turn AS (
  SELECT d.*, t.full_epochs, t.rest, unnest(range(0, CAST(t.full_epochs + 1 AS BIGINT))) AS epoch
  FROM doc d JOIN target t USING (domain, language, origin)
), placed AS (
  SELECT *, md5('{mix.seed}|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS place FROM turn
), summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin, epoch
    ORDER BY place, doc_id NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
  FROM placed
)
SELECT doc_id, domain, language, origin, epoch, CAST(n_tokens AS BIGINT) AS n_tokens
FROM summed WHERE epoch < full_epochs OR through <= rest
"""
