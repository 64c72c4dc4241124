"""Entity resolution, task generation and keyed memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import rules
from tallyspark.functions.text import normalized_company


def resolve(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """query_id, status, ticker, step for each query: the first step with a match decides.

    directory: ticker, title, pos. Steps: exact ticker (the first), then the normalised name, after aliases, as the
    only exact title, the only prefix, the only part of a title. Several matches of a prefix or part are
    ambiguous. Every step is an equi-join: queries still open meet the titles that hold their first three letters.
    """
    aliases = F.create_map(*(F.lit(x) for kv in rules.COMPANY_ALIASES.items() for x in kv))
    plain = normalized_company(F.col("query"))
    asked = queries.select("query_id", F.upper(F.trim("query")).alias("as_ticker"), plain.alias("plain")).withColumn("name", F.coalesce(F.try_element_at(aliases, F.col("plain")), F.col("plain")))
    titles = directory.select("ticker", "pos", normalized_company(F.col("title")).alias("title"))
    by_ticker = directory.groupBy(F.upper("ticker").alias("as_ticker")).agg(F.min_by("ticker", "pos").alias("t1"))
    by_title = titles.groupBy(F.col("title").alias("name")).agg(F.count(F.lit(1)).alias("n2"), F.min("ticker").alias("t2"))
    step2 = asked.join(by_ticker, "as_ticker", "left").join(by_title, "name", "left")
    open_ = step2.filter("t1 IS NULL AND coalesce(n2, 0) <> 1 AND name <> ''").select("query_id", "name")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("title")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substring(F.col("title"), i, n)))))
    held = titles.filter("title <> ''").withColumn("gram", F.explode(grams))
    parts = open_.withColumn("gram", F.substring("name", 1, 3)).join(held, "gram").filter(F.col("title").contains(F.col("name"))).groupBy("query_id").agg(
        F.sum(F.col("title").startswith(F.col("name")).cast("int")).alias("n3"),
        F.min(F.when(F.col("title").startswith(F.col("name")), F.col("ticker"))).alias("t3"),
        F.count(F.lit(1)).alias("n4"),
        F.min("ticker").alias("t4"),
    )
    j = step2.join(parts, "query_id", "left")
    step = F.when(F.col("t1").isNotNull(), "ticker").when(F.col("n2") == 1, "title").when(F.col("n3") >= 1, "prefix").when(F.col("n4") >= 1, "part")
    status = F.when(F.col("step").isNull(), "not_found").when(((F.col("step") == "prefix") & (F.col("n3") > 1)) | ((F.col("step") == "part") & (F.col("n4") > 1)), "ambiguous").otherwise("resolved")
    ticker = F.when(F.col("status") == "resolved", F.when(F.col("step") == "ticker", F.col("t1")).when(F.col("step") == "title", F.col("t2")).when(F.col("step") == "prefix", F.col("t3")).otherwise(F.col("t4")))
    return j.withColumn("step", step).withColumn("status", status).withColumn("ticker", ticker).select("query_id", "status", "ticker", "step")


def tasks(companies: DataFrame, themes: DataFrame) -> DataFrame:
    """Every company with every theme, and its question: the product of both is the result."""
    crossed = companies.crossJoin(themes)
    asks = F.format_string("How did %s's %s change from %d to %d?", "company", "theme", "old_year", "new_year")
    return crossed.withColumns({"task_id": F.concat_ws("_", "company", "theme", "old_year", "new_year"), "question": asks})


def merged_memory(state: DataFrame, runs: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """Upsert runs into state: each list column becomes the sorted distinct union, last_updated the latest.

    One aggregation over the union of old and new rows; a new key is just a row without a partner.
    """
    union = state.select(*keys, *lists, "last_updated").unionByName(runs.select(*keys, *lists, "last_updated"))
    merged = [F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in lists]
    return union.groupBy(*keys).agg(*merged, F.max("last_updated").alias("last_updated"))


def memory_additions(state: DataFrame, merged: DataFrame, keys: list[str], lists: list[str]) -> DataFrame:
    """How many entries each list of each key gained."""
    old = state.select(*keys, *(F.size(F.array_distinct(c)).alias(f"_{c}") for c in lists))
    return merged.join(old, keys, "left").select(*keys, *((F.size(c) - F.coalesce(f"_{c}", F.lit(0))).alias(f"added_{c}") for c in lists))


def ambiguous_messages(queries: DataFrame, directory: DataFrame, most: int = 5) -> DataFrame:
    """query_id, message: for each query whose name begins several titles, the first `most` of them by place in the directory.

    Queries and titles meet by the name's first word, as whole words and as the begin of one; directory: ticker, title, pos.
    """
    asked = queries.select("query_id", normalized_company(F.col("query")).alias("name")).filter("name <> ''")
    titles = directory.select("ticker", "pos", F.col("title").alias("shown"), normalized_company(F.col("title")).alias("title"))
    begins = titles.withColumn("start", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("title"), F.lit(1))), lambda n: F.substring(F.col("title"), 1, n))))
    met = asked.join(begins, F.col("name") == F.col("start"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    kept = met.withColumns({"n": n, "all": F.count(F.lit(1)).over(Window.partitionBy("query_id"))}).filter((F.col("all") > 1) & (F.col("n") <= most))
    shown = F.transform(F.sort_array(F.collect_list(F.struct("n", "ticker", "shown"))), lambda x: F.concat(x["ticker"], F.lit(" ("), x["shown"], F.lit(")")))
    return kept.groupBy("query_id").agg(F.concat(F.max("all").cast("string"), F.lit(" companies fit: "), F.array_join(shown, "; ")).alias("message"))


def topic_memory(asked: DataFrame, state: DataFrame, keys: list[str], lists: list[str], default_query: str, use_memory: bool = True) -> DataFrame:
    """asked's rows with the memory of their topic: its lists (empty where nothing is remembered) and the query to begin with.

    With use_memory that is the topic's last successful query, else, and for new topics, the default.
    """
    joined = asked.join(state.select(*keys, *lists), keys, "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    return initial_query(joined, default_query) if use_memory else joined.withColumn("query", F.lit(default_query))


def initial_query(topic: DataFrame, default: str) -> DataFrame:
    """The most recent successful query of each topic, or the default."""
    return topic.withColumn("query", F.coalesce(F.try_element_at("successful_queries", F.lit(-1)), F.lit(default)))


def trace_rollup(steps: DataFrame, run: str = "run") -> DataFrame:
    """run, n_steps, n_failed, first_state, last_state, seconds, states from trace steps (run, pos, state, ts, failed)."""
    return steps.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.sum(F.col("failed").cast("long")).alias("n_failed"),
        F.min_by("state", F.struct("ts", "pos")).alias("first_state"),
        F.max_by("state", F.struct("ts", "pos")).alias("last_state"),
        (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("micros"),
        F.array_join(F.sort_array(F.collect_set("state")), ",").alias("states"),
    )


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
