"""Mixing sources to target weights by weighted fair queueing.

The documents of each source stand in a shuffled (hashed) queue. A document's virtual finish time is
the number of its source's tokens up to and with it, divided by the source's weight. The mixture is
the documents in the order of their finish times, as far as the budget of tokens goes.

Both running totals are exact and distributed: a queue is cut into hash ranges, the documents into ranges
of their order with about as many rows each (a range sort by finish time and place, so ties are cut as well);
totals of the ranges are summed up first, then each range runs on its own, so that no source and no part of the sort
has to fit in one task, whatever the weights are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import checkpoint, fresh, shuffle_partitions, table

#: Weights of the sources; one that isn't named has DEFAULT_WEIGHT, one of weight 0 is left out.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
DEFAULT_WEIGHT = 1.0
#: Budget as a share of all tokens of the weighted sources.
BUDGET_SHARE = 0.5
SEED = "mix-1"
#: Hash ranges of a queue (hex digits of the hash).
HASH_DIGITS = 3
#: Sources whose places are sent to every task (about 100 bytes each).
MOST_SOURCES = 100_000

TOKEN = r"[^ \t\n\r]+"


def _weight(weights: dict[str, float], default: float):
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(F.col("source") == name, F.lit(float(w))).otherwise(out)
    return out


def queue_key(seed: str = SEED):
    """The place of a document in its source's queue."""
    return F.concat(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.lit(":"), F.lpad(F.col("n_tokens").cast("string"), 12, "0"))


def finish_times(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT, seed: str = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, place, virtual_finish) of each document of a source of positive weight."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"))
    rows = rows.withColumn("weight", _weight(weights, default)).filter("weight > 0").withColumn("place", queue_key(seed))
    rows = rows.withColumn("part", F.substring("place", 1, HASH_DIGITS))
    rows = checkpoint(rows.select("doc_id", F.coalesce("source", F.lit("")).alias("key"), "source", "n_tokens", "weight", "place", "part"))
    totals = rows.groupBy("key", "part").agg(F.sum("n_tokens").alias("total"))
    before = totals.withColumn("before", F.sum("total").over(Window.partitionBy("key").orderBy("part")) - F.col("total")).drop("total")
    # The default frame takes in all rows of one place: repeated rows enter together.
    own = F.sum("n_tokens").over(Window.partitionBy("key", "part").orderBy("place"))
    done = rows.withColumn("own", own).join(before, ["key", "part"])
    return done.select("doc_id", "source", "n_tokens", "place", ((F.col("before") + F.col("own")) / F.col("weight")).alias("virtual_finish"))


def mixture(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT, share: float = BUDGET_SHARE, seed: str = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, virtual_finish, running_tokens) of the documents within the budget,
    sorted by finish time.

    A token is a run of characters other than blank, tab and line ends. The budget is
    floor(share * all tokens of sources of positive weight); a document enters if the running total with
    it keeps to the budget. Ties of the finish time go by source (a null source is one of its own and
    comes first), then by place. Rows that repeat a doc_id with as many tokens enter, or don't, together. A
    null text has 0 tokens; a null doc_id has the place of an empty one. A table without tokens keeps its documents
    of 0 tokens; an empty one gives an empty result. Long texts are counted whole. Columns besides doc_id, source and
    text are not read.
    """
    timed = checkpoint(finish_times(docs, weights, default, seed).withColumn("key", F.coalesce("source", F.lit(""))))
    # The numbers of the ranges are written down with the rows: a range that is made again may be cut elsewhere.
    timed = checkpoint(timed.repartitionByRange(shuffle_partitions(docs.sparkSession), "virtual_finish", "key", "place").withColumn("range", F.spark_partition_id()))
    totals = timed.groupBy("range").agg(F.sum("n_tokens").alias("total"))
    total = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    budget = int(total * share)
    # One row for each range: one task is enough for their running total.
    before = totals.withColumn("before", F.sum("total").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("total")).filter(F.col("before") <= budget).drop("total")
    own = F.sum("n_tokens").over(Window.partitionBy("range").orderBy("virtual_finish", "key", "place"))
    placed = timed.join(F.broadcast(before), "range").withColumn("running_tokens", F.col("before") + own)
    return placed.filter(F.col("running_tokens") <= budget).select("doc_id", "source", "n_tokens", "virtual_finish", "running_tokens", "key", "place")


def sorted_mixture(docs: DataFrame, **options) -> DataFrame:
    """`mixture`, sorted over the whole cluster."""
    return mixture(docs, **options).orderBy("virtual_finish", "key", "place").drop("key", "place")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that the mixture takes, with all their columns.

    Each queue is cut at one place, so only the last place of each source is joined with the texts. Up to
    MOST_SOURCES sources the places are sent to every task, so that no text is shuffled and a large source isn't one
    task; beyond, both sides are shuffled by source. Nulls, ties, repeated rows and empty tables are as in `mixture`;
    columns of any names are kept as they are.
    """
    seed, key, last = options.get("seed", SEED), fresh(docs, "__key"), fresh(docs, "__last")
    cuts = mixture(docs, **options).groupBy(F.col("key").alias(key)).agg(F.max("place").alias(last))
    cuts = checkpoint(cuts)
    if cuts.count() <= MOST_SOURCES:
        cuts = F.broadcast(cuts)
    n = F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")
    place = F.concat(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), F.lit(":"), F.lpad(n.cast("string"), 12, "0"))
    on = (F.coalesce(F.col("source"), F.lit("")) == F.col(key)) & (place <= F.col(last))
    return docs.join(cuts, on, "left_semi")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`sorted_mixture` over the whole table `documents`, by WEIGHTS and BUDGET_SHARE."""
    return sorted_mixture(table(spark, sf_dir, "documents"))


_CASES = " ".join(f"WHEN source = '{k}' THEN {w}::DOUBLE" for k, w in WEIGHTS.items())
OP5_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(source, '') AS key, coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0)::BIGINT AS n_tokens,
         CASE {_CASES} ELSE {DEFAULT_WEIGHT}::DOUBLE END AS weight
  FROM documents),
placed AS (
  SELECT *, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) || ':' || lpad(n_tokens::VARCHAR, 12, '0') AS place FROM rows WHERE weight > 0),
timed AS (
  SELECT *, (sum(n_tokens) OVER (PARTITION BY key ORDER BY place))::DOUBLE / weight AS virtual_finish FROM placed),
run AS (
  SELECT *, (sum(n_tokens) OVER (ORDER BY virtual_finish, key, place))::BIGINT AS running_tokens FROM timed)
SELECT doc_id, source, n_tokens, virtual_finish, running_tokens FROM run
WHERE running_tokens <= (SELECT floor(coalesce(sum(n_tokens), 0)::DOUBLE * {BUDGET_SHARE}) FROM placed)
"""
