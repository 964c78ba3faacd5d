"""Retrieval evaluation: judgement per match, result per question, one summary row per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.retrieval import rank_chunks, within_budget
from lorekeep.settings import RetrievalSettings


def judge(matches: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds ``relevant``: any expected url inside the url, or any expected text inside the text, ignoring case.

    A match only meets its own question's expectations, so this is an equi-join on the question.
    """
    wanted = questions.select("query_id", "expected_urls", "expected_text")
    url_hit = F.exists("expected_urls", lambda u: F.contains(F.coalesce("url", F.lit("")), u))
    text = F.lower(F.coalesce("text", F.lit("")))
    text_hit = F.exists("expected_text", lambda t: F.contains(text, F.lower(t)))
    relevant = F.coalesce(url_hit, F.lit(False)) | F.coalesce(text_hit, F.lit(False))
    return matches.join(wanted, "query_id").withColumn("relevant", relevant).drop("expected_urls", "expected_text")


def reciprocal_rank(rank: Column) -> Column:
    return F.when(rank > 0, 1.0 / rank).otherwise(0.0)


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def ndcg(dcg: Column, relevant: Column) -> Column:
    """Binary gain over the gain of the same hits moved to the top; 0 without hits."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(relevant, F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + _gain(r))
    return F.when(relevant > 0, dcg / ideal).otherwise(0.0)


def count_usable(chunks: DataFrame, settings: RetrievalSettings) -> DataFrame:
    """query_id, used: how many matches survive ranking and the context budget."""
    kept = within_budget(rank_chunks(chunks, settings.max_per_source), settings.max_context_characters)
    return kept.groupBy("query_id").agg(F.count("*").alias("used"))


def question_result(questions: DataFrame, judged: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """One row per question (query_id, unanswerable): passed, rank, relevant, retrieved, scores, used, ndcg."""
    hit = F.col("relevant")
    per = judged.groupBy("query_id").agg(
        F.count("*").alias("retrieved"),
        F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(0)).alias("first_rank"),
        F.count_if(hit).alias("hits"),
        F.max("score").alias("top_score"),
        F.avg("score").alias("mean_score"),
        F.sum(F.when(hit, _gain(F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    rows = questions.select("query_id", F.coalesce("unanswerable", F.lit(False)).alias("unanswerable")).join(per, "query_id", "left")
    if used is not None:
        rows = rows.join(used, "query_id", "left")
    else:
        rows = rows.withColumn("used", F.lit(0).cast("long"))
    open_ = ~F.col("unanswerable")
    retrieved = F.coalesce("retrieved", F.lit(0).cast("long"))
    rank = F.coalesce("first_rank", F.lit(0))
    hits = F.coalesce("hits", F.lit(0).cast("long"))
    return rows.select(
        "query_id",
        "unanswerable",
        F.when(open_, rank > 0).otherwise(retrieved == 0).alias("passed"),
        F.when(open_, rank).otherwise(0).alias("rank"),
        F.when(open_, hits).otherwise(F.lit(0).cast("long")).alias("relevant"),
        retrieved.alias("retrieved"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
        F.when(open_, F.round(F.coalesce("mean_score", F.lit(0.0)), 4)).alias("mean_score"),
        F.when(open_, F.coalesce("used", F.lit(0).cast("long"))).alias("used"),
        F.when(open_, F.round(ndcg(F.coalesce("dcg", F.lit(0.0)), hits), 4)).alias("ndcg"),
    )


def _mean(value: Column, where: Column) -> Column:
    return F.coalesce(F.round(F.avg(F.when(where, value.cast("double"))), 4), F.lit(0.0))


def _ratio(passed: Column, where: Column) -> Column:
    return F.coalesce(F.round(F.avg(F.when(where, passed.cast("double"))), 3), F.lit(1.0))


def summary_columns() -> list[Column]:
    """Aggregates over question results; an empty answerable set gives recall 1 and means 0."""
    open_, closed = ~F.col("unanswerable"), F.col("unanswerable")
    precision = F.when(F.col("retrieved") > 0, F.col("relevant") / F.col("retrieved")).otherwise(0.0)
    return [
        F.count_if("passed").alias("passed"),
        F.count("*").alias("total"),
        _ratio(F.col("passed"), open_).alias("recall_at_k"),
        _ratio(F.col("passed"), closed).alias("refusal_accuracy"),
        _mean(precision, open_).alias("precision_at_k"),
        _mean(reciprocal_rank(F.col("rank")), open_).alias("mrr"),
        _mean(F.col("ndcg"), open_).alias("ndcg_at_k"),
        _mean(F.col("top_score"), open_).alias("average_top_score"),
        _mean(F.col("retrieved"), open_).alias("average_retrieved"),
        _mean(F.col("used"), open_).alias("average_used"),
    ]


def summarize(results: DataFrame, settings: RetrievalSettings | None = None, by: list[str] | None = None) -> DataFrame:
    report = results.groupBy(*(by or [])).agg(*summary_columns())
    if settings is not None:
        report = report.withColumns(
            {
                "top_k": F.lit(settings.top_k),
                "min_score": F.lit(settings.min_score),
                "max_per_source": F.lit(settings.max_per_source),
                "max_context_characters": F.lit(settings.max_context_characters),
            }
        )
    return report


def evaluate(questions: DataFrame, chunks: DataFrame, settings: RetrievalSettings) -> tuple[DataFrame, DataFrame]:
    """(per question, summary) from retrieved chunks. ``questions`` carries expected_urls, expected_text, unanswerable."""
    results = question_result(questions, judge(chunks, questions), count_usable(chunks, settings))
    return results, summarize(results, settings)


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per question: ranks of both runs and improved / regressed / unchanged. Rank 0 means not found."""

    def side(run: DataFrame, name: str) -> DataFrame:
        return run.select("query_id", F.col("rank").alias(f"{name}_rank"), F.col("passed").alias(f"{name}_passed"), F.col("ndcg").alias(f"{name}_ndcg"))

    gain = reciprocal_rank(F.coalesce("after_rank", F.lit(0))) - reciprocal_rank(F.coalesce("before_rank", F.lit(0)))
    better = F.when(
        F.coalesce("after_passed", F.lit(False)) != F.coalesce("before_passed", F.lit(False)),
        F.when(F.coalesce("after_passed", F.lit(False)), 1.0).otherwise(-1.0),
    ).otherwise(gain)
    return (
        side(before, "before")
        .join(side(after, "after"), "query_id", "full_outer")
        .withColumn("change", F.when(better > 0, "improved").when(better < 0, "regressed").otherwise("unchanged"))
    )


def threshold_sweep(questions: DataFrame, judged: DataFrame, floors: list[float]) -> DataFrame:
    """Summary per score floor, from matches retrieved without a floor. Each match carries the floors it clears."""
    cleared = F.filter(F.array(*[F.lit(f) for f in floors]), lambda f: f <= F.col("score"))
    kept = judged.withColumn("floor", F.explode(cleared))
    hit = F.col("relevant")
    per = kept.groupBy("query_id", "floor").agg(
        F.count("*").alias("retrieved"),
        F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(0)).alias("rank"),
        F.count_if(hit).alias("relevant"),
        F.max("score").alias("top_score"),
    )
    asked = questions.select("query_id", F.coalesce("unanswerable", F.lit(False)).alias("unanswerable"), F.explode(F.array(*[F.lit(f) for f in floors])).alias("floor"))
    rows = asked.join(per, ["query_id", "floor"], "left").fillna(0, ["retrieved", "rank", "relevant", "top_score"])
    passed = F.when(F.col("unanswerable"), F.col("retrieved") == 0).otherwise(F.col("rank") > 0)
    open_ = ~F.col("unanswerable")
    precision = F.when(F.col("retrieved") > 0, F.col("relevant") / F.col("retrieved")).otherwise(0.0)
    return rows.withColumn("passed", passed).groupBy("floor").agg(
        _ratio(F.col("passed"), open_).alias("recall_at_k"),
        _ratio(F.col("passed"), ~open_).alias("refusal_accuracy"),
        _mean(precision, open_).alias("precision_at_k"),
        _mean(reciprocal_rank(F.col("rank")), open_).alias("mrr"),
        _mean(F.col("retrieved"), open_).alias("average_retrieved"),
    )


def score_gap(matches: DataFrame) -> DataFrame:
    """Distance between the best and the second match of each question; NULL for a single match."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        matches.filter(F.col("rank") <= 2)
        .withColumn("gap", F.col("score") - F.lead("score").over(order))
        .filter(F.col("rank") == 1)
        .select("query_id", "score", "gap")
    )
