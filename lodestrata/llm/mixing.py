"""Temperature mixing of sources, in DataFrame operations only.

Shares of source tokens are raised to one exponent and normalised. The exponent is the flattest on a
grid of 2**20 steps in [0, 1] that keeps the largest repetition of a source at or under a limit, or
the one nearest to the natural shares whose entropy still reaches a target. Each weight times the
token budget is realised as whole passes over the source and one partial pass, which takes documents
in the order of a keyed permutation until its tokens are spent.

The partial pass needs a running sum over a source, and one source may hold a third of all rows. The
permutation is therefore cut into blocks by the first digits of its key, as many as keep a block of the
largest source at about BLOCK_ROWS rows: block totals are summed first, their running sums are taken
over the few rows of the blocks, and only the rows of one block are ordered together. The blocks change
the plan, never the result.

Defined cases: a null or wordless text has 0 tokens; a null source is the source ''; a null doc_id is
keyed by its text; repeated rows are separate documents; a source without tokens is never drawn; an empty
table, or one without tokens, gives an empty result. A document is drawn by a pass while tokens
remain before it, so a pass may overshoot by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

GRID = 1 << 20
#: Exponents tried in one pass over the source table; each pass fixes four binary digits.
SECTION = 16
#: Rows of a block, about; it has two hexadecimal digits at least.
BLOCK_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    """Words between white space. A word starts where a character follows white space or the start."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def source_totals(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_rows")).where("source_tokens > 0")


def choose_exponent(totals: DataFrame, budget: float, *, max_repetition: float | None, min_entropy: float | None) -> int:
    """The grid step of the exponent. Each pass is one aggregation over the source table: a bisection of four digits at once."""
    total, least, n = totals.agg(F.sum("source_tokens"), F.min("source_tokens"), F.count("*")).first()
    if not n:
        return GRID
    share = F.col("source_tokens") / F.lit(float(total))

    def meets(z: float, zl: float, a: float) -> bool:
        if min_entropy is not None:
            import math

            return math.log(z) - a * zl / z >= min_entropy
        p = least / total
        return p**a / z * budget / least <= max_repetition

    lo, hi = 0, GRID  # entropy: lo meets or is 0; repetition: hi meets or is GRID
    while hi - lo > 1:
        step = max(1, (hi - lo) // SECTION)
        tries = list(range(lo, hi, step))[1:] or [lo + 1]
        sums = totals.agg(*[F.sum(F.pow(share, F.lit(k / GRID))).alias(f"z{k}") for k in tries], *[F.sum(F.pow(share, F.lit(k / GRID)) * F.log(share)).alias(f"l{k}") for k in tries]).first()
        ok = [meets(sums[f"z{k}"], sums[f"l{k}"], k / GRID) for k in tries]
        if min_entropy is not None:
            last = max((i for i, x in enumerate(ok) if x), default=-1)
            lo, hi = (tries[last] if last >= 0 else lo), (tries[last + 1] if last + 1 < len(tries) else hi)
        else:
            first = next((i for i, x in enumerate(ok) if x), len(ok))
            lo, hi = (tries[first - 1] if first else lo), (tries[first] if first < len(tries) else hi)
    if min_entropy is not None:
        return lo
    z0 = totals.agg(F.sum(F.pow(share, F.lit(0.0)))).first()[0]
    return 0 if lo == 0 and meets(z0, 0.0, 0.0) else hi


def mix_sources(docs: DataFrame, *, budget_ratio: float = 1.0, max_repetition: float | None = 1.25, min_entropy: float | None = None, seed: str = "mix") -> DataFrame:
    """Rows (doc_id, source, n_tokens, epoch, mix_key): each is one drawing of a document.

    mix_key orders the drawings of an epoch: sorting by (epoch, mix_key) is the mixed order.
    Give max_repetition, the most passes over any source, or min_entropy in nats.
    """
    if (max_repetition is None) == (min_entropy is None):
        raise ValueError("give either max_repetition or min_entropy")
    sized = staged(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n_tokens"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary")))).alias("own_key")), "mix-sizes")
    totals = staged(source_totals(sized), "mix-totals")
    total, largest = totals.agg(F.sum("source_tokens"), F.max("source_rows")).first()
    total = float(total or 0)
    digits = max(2, len(f"{(largest or 0) // BLOCK_ROWS:x}"))
    budget = float(int(total * budget_ratio))
    a = choose_exponent(totals, budget, max_repetition=max_repetition, min_entropy=min_entropy) / GRID
    raised = totals.withColumn("raised", F.pow(F.col("source_tokens") / F.lit(total or 1.0), F.lit(a)))
    z = float(raised.agg(F.sum("raised")).first()[0] or 1.0)
    plan = raised.select("source", "source_tokens", F.floor(F.col("raised") / F.lit(z) * F.lit(budget)).cast("long").alias("source_budget"))
    plan = plan.withColumn("whole", F.expr("source_budget div source_tokens")).withColumn("rest", F.expr("source_budget % source_tokens")).drop("source_tokens", "source_budget")
    drawn = sized.join(plan, "source")

    def key(epoch: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.col("own_key")).cast("binary"))

    whole = drawn.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))).withColumn("mix_key", key(F.col("epoch")))
    part = drawn.where("rest > 0").withColumn("epoch", F.col("whole")).withColumn("mix_key", key(F.col("epoch"))).withColumn("block", F.substring("mix_key", 1, digits))
    starts = part.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    starts = starts.withColumn("before_block", F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block")) - F.col("block_tokens")).drop("block_tokens")
    here = Window.partitionBy("source", "block").orderBy("mix_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = part.withColumn("to_here", F.sum("n_tokens").over(here)).join(starts, ["source", "block"]).where(F.col("before_block") + F.col("to_here") - F.col("n_tokens") < F.col("rest"))
    out = ["doc_id", "source", "n_tokens", "epoch", "mix_key"]
    return whole.select(*out).unionByName(part.select(*out))


#: DuckDB SQL over a view named {docs}; the recursion is the bisection, one digit a step.
MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens,
         coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS own_key
  FROM {docs}),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS source_tokens FROM sized GROUP BY source HAVING sum(n_tokens) > 0),
whole_corpus AS (SELECT sum(source_tokens)::DOUBLE AS total, min(source_tokens)::DOUBLE AS least FROM totals),
shares AS (SELECT source, source_tokens, source_tokens / total AS share FROM totals, whole_corpus),
bisect(lo, hi) AS (
  SELECT -1::BIGINT, {grid}::BIGINT
  UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT lo, hi, (lo + hi) // 2 AS mid,
               (SELECT pow(min(share), ((lo + hi) // 2) / {grid}.0) / sum(pow(share, ((lo + hi) // 2) / {grid}.0)) FROM shares)
               * (SELECT total / least FROM whole_corpus) <= {limit} AS ok
        FROM bisect WHERE hi - lo > 1)),
exponent AS (SELECT min(hi) / {grid}.0 AS a FROM bisect),
raised AS (SELECT source, source_tokens, pow(share, a) AS r FROM shares, exponent),
plan AS (
  SELECT source, b // source_tokens AS whole, b % source_tokens AS rest
  FROM (SELECT source, source_tokens, floor(r / (SELECT sum(r) FROM raised) * total)::BIGINT AS b FROM raised, whole_corpus)),
passes AS (
  SELECT doc_id, own_key, source, n_tokens, whole, rest, unnest(range(0, whole + 1))::BIGINT AS epoch FROM sized JOIN plan USING (source)),
keyed AS (
  SELECT *, md5('mix:' || epoch || ':' || own_key) AS mix_key FROM passes),
summed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY mix_key, doc_id, n_tokens
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS before_it FROM keyed)
SELECT doc_id, source, n_tokens, epoch, mix_key FROM summed WHERE epoch < whole OR before_it < rest
"""


def mix_sql(docs: str = "documents", limit: float = 1.25) -> str:
    return MIX_SQL.format(docs=docs, grid=GRID, limit=limit)
