"""Control-loop analytics over task, cycle and event tables, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideglass.operators.ordered import running

# Words by which a task's type, an error and a need to search are told.
CODE_WORDS = ["fix", "bug", "ci", "workflow", "refactor", "implement", "write code", "function", "class", "method", "test"]
DOC_WORDS = ["document", "report", "analysis", "spec", "summary", "explain", "describe"]
SEARCH_WORDS = ["latest", "recent", "current", "new", "update", "news", "today", "now"]
LEVELS = ((90, "S"), (80, "A"), (60, "B"))
# The loop's default settings.
LOW_GAIN, MEDIUM_GAIN, STOPS = 5.0, 10.0, 3


def _hits(text: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def task_type(text: Column) -> Column:
    """code, document or qa by the number of words of each list that the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    code, doc = _hits(low, CODE_WORDS), _hits(low, DOC_WORDS)
    return F.when((code >= doc) & (code > 0), "code").when(doc > 0, "document").otherwise("qa")


def level(score: Column) -> Column:
    out = F.lit("F")
    for limit, name in reversed(LEVELS):
        out = F.when(score >= limit, name).otherwise(out)
    return out


def type_score(kind: Column, a: Column, b: Column, c: Column) -> Column:
    """code: tests .5, boundary .3, compiles .2; document: structure .4, accuracy .4, format .2; qa: coverage .6, depth .4."""
    compiled = F.when(c.cast("double") > 0, 100.0).otherwise(0.0)
    return F.when(kind == "code", a * 0.5 + b * 0.3 + compiled * 0.2).when(kind == "document", a * 0.4 + b * 0.4 + c * 0.2).otherwise(a * 0.6 + b * 0.4)


def exact_sum(x: Column) -> Column:
    """The sum of doubles as decimals of 15 places, so their order plays no part; where one does not fit, as doubles."""
    d = x.try_cast("decimal(28,15)")
    return F.when(F.count(d) == F.count(x), F.sum(d).cast("double")).otherwise(F.sum(x))


def weighted_scores(items: DataFrame, by: str) -> DataFrame:
    """(by, score, level) of (by, score, weight, scoring_mode, min_score); an item that must pass and does not gives 0.

    A mean halfway between two tenths is told as such, however its items come: sums are exact, the quotient's last bits are rounded off.
    """
    gate = F.bool_or((F.col("scoring_mode") == "pass_fail") & (F.col("score") < F.col("min_score")))
    weight = exact_sum(F.col("weight"))
    total = F.when(weight > 0, F.round(exact_sum(F.col("score") * F.col("weight")) / weight, 12)).otherwise(0.0)
    rows = items.groupBy(by).agg(F.when(F.coalesce(gate, F.lit(False)), 0.0).otherwise(total).alias("raw"))
    return rows.select(by, F.bround("raw", 1).alias("score"), level(F.col("raw")).alias("level"))


def response_metrics(text: Column, tokens: Column) -> dict[str, Column]:
    """test_pass_rate, boundary_coverage, compile_ok of a reply; a null reply gives zeros."""
    body = F.length(F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""))
    substance = F.when(body > 200, 100.0).when(body > 50, 50.0).otherwise(0.0)
    code = F.length(text) - F.length(F.replace(text, F.lit("`"), F.lit(""))) >= 2
    failed = F.lower(text).rlike("error|failed|fail|exception|traceback")
    compiled = F.when(code & ~failed, 100.0).when(code, 50.0).otherwise(100.0)
    structure = F.when(F.contains(text, F.lit("#")) | F.contains(text, F.lit("**")), 100.0).otherwise(40.0)
    efficiency = F.when(tokens > 0, F.least(F.lit(100.0), tokens / 5.0)).otherwise(0.0)
    none = text.isNull()
    return {
        "test_pass_rate": F.when(none, 0.0).otherwise(F.bround(substance * 0.4 + structure * 0.3 + efficiency * 0.3, 1)),
        "boundary_coverage": F.when(none, 0.0).otherwise(F.bround(substance * 0.3 + structure * 0.4 + compiled * 0.3, 1)),
        "compile_ok": F.when(none, F.lit(False)).otherwise(compiled >= 50),
    }


def gains(scores: DataFrame, by: str, order: str, score: str = "score") -> DataFrame:
    """scores with gain: the change since the task's last score, 100 for its first."""
    before = F.lag(score).over(W.partitionBy(by).orderBy(order))
    return scores.withColumn("gain", F.when(before.isNull(), 100.0).otherwise(F.col(score) - before))


def average_gain(scores: DataFrame, by: str, order: str, score: str = "score", last: int = 3) -> DataFrame:
    """(by, average_gain): mean change over the last scores; 100 with fewer than two."""
    newest = scores.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).where(F.col("r") <= last)
    ends = newest.groupBy(by).agg(F.count("*").alias("n"), F.max_by(score, order).alias("b"), F.min_by(score, order).alias("a"))
    return ends.select(by, F.when(F.col("n") < 2, 100.0).otherwise((F.col("b") - F.col("a")) / (F.col("n") - 1)).alias("average_gain"))


def gain_actions(rows: DataFrame, by: str, order: str, gain: str = "gain", stop_after: int = 3, looped: bool = False) -> DataFrame:
    """rows with low_run (gains below 10 in a row) and action; a run ends with a gain of 10 or more.

    This is the evaluator alone; in the loop (`looped`) a row below 5 ends the run too, as the strategy is
    switched, which resets the counter, or the task is stopped.
    """
    line = W.partitionBy(by).orderBy(order)
    if looped:
        # the row that ends a run still belongs to it
        edge = ((F.col(gain) >= 10) | (F.col(gain) < 5)).cast("int")
        rows = rows.withColumn("_island", F.coalesce(F.sum(edge).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    else:
        rows = rows.withColumn("_island", F.sum((F.col(gain) >= 10).cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
    run = F.sum((F.col(gain) < 10).cast("int")).over(W.partitionBy(by, "_island").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    run = F.when(F.col(gain) >= 10, 0).otherwise(run)
    rows = rows.withColumn("low_run", run)
    g = F.col(gain)
    action = F.when(g >= 20, "continue").when(g >= 10, "continue_low_freq").when(g >= 5, "mark_risk").when(F.col("low_run") >= stop_after, "force_stop").otherwise("switch_strategy")
    return rows.withColumn("action", action).drop("_island")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_reply(text: Column) -> dict[str, Column]:
    """score and gain_estimate of a judging reply: fenced or bare JSON, else the last number after `score`; clamped.

    The JSON is read as a VARIANT, so further, nested or repeated fields do no harm and numbers may be strings.  A field that is missing has
    its default (50 and 0); one that is no number sends the reply to the pattern, as does JSON that is broken or no object.
    A null reply gives the defaults.
    """
    text = F.coalesce(text, F.lit(""))
    fenced = F.regexp_replace(F.get(F.split(text, "```"), F.lit(1)), "^json", "")
    data = F.try_parse_json(_stripped(F.when(F.contains(text, F.lit("```")), fenced).otherwise(text)))
    whole = F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False))
    there = F.try_variant_get(data, "$", "map<string,variant>")

    def number(name: str, default: float) -> Column:
        has = F.coalesce(F.map_contains_key(there, F.lit(name)), F.lit(False))
        return F.when(~has, default).otherwise(F.try_variant_get(data, f"$.{name}", "double"))

    score, gain = number("score", 50.0), number("marginal_gain_estimate", 0.0)
    numbers = F.regexp_extract_all(text, F.lit(r"(?i)score[\s:]*(\d+)"), F.lit(1))
    found = F.when(F.size(numbers) > 0, F.element_at(numbers, -1).cast("double"))
    good = whole & score.isNotNull()
    hold = lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b))
    told = F.when(good & gain.isNotNull(), score).otherwise(F.coalesce(found, F.when(good, score), F.lit(50.0)))
    return {"score": hold(told, 0.0, 100.0), "gain_estimate": hold(F.when(good & gain.isNotNull(), gain).otherwise(0.0), -100.0, 100.0)}


def parse_search(text: Column, n: int = 5) -> Column:
    """array<struct<rank, title, url, snippet>> of a search reply: a JSON list behind a `json mark, between single backticks or bare, else urls and titles by pattern.

    Only what the marks enclose is read, by the pattern too.  Lists whose items are no objects are read by the pattern; a null reply
    has no results.
    """
    marked = F.get(F.split(F.get(F.split(text, "`json"), F.lit(1)), "`"), F.lit(0))
    body = F.when(F.contains(text, F.lit("`json")), marked).when(F.contains(text, F.lit("`")), F.get(F.split(text, "`"), F.lit(1))).otherwise(text)
    data = F.try_parse_json(_stripped(body))
    items = F.when(F.schema_of_variant(data).startswith("ARRAY"), F.try_variant_get(data, "$", "array<variant>"))
    items = F.when(F.forall(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), items)

    def part(x: Column, name: str) -> Column:
        x = F.try_variant_get(x, "$", "map<string,variant>")
        return F.when(F.map_contains_key(x, F.lit(name)), F.try_variant_get(F.try_element_at(x, F.lit(name)), "$", "string")).otherwise("")

    typed = F.transform(F.slice(items, 1, n), lambda x, i: F.struct(i.alias("rank"), part(x, "title").alias("title"), part(x, "url").alias("url"), part(x, "snippet").alias("snippet")))
    urls = F.slice(F.regexp_extract_all(body, F.lit(r"https?://[^\s]+"), F.lit(0)), 1, n)
    titles = F.regexp_extract_all(body, F.lit(r"(?i)title[:\s]+([^\n]+)"), F.lit(1))
    loose = F.transform(urls, lambda u, i: F.struct(i.alias("rank"), F.coalesce(F.get(titles, i), F.substring(u, 1, 50)).alias("title"), u.alias("url"), F.lit("").alias("snippet")))
    return F.coalesce(typed, loose, F.array().cast("array<struct<rank:int,title:string,url:string,snippet:string>>"))


def wants_search(text: Column) -> Column:
    return _hits(F.lower(F.coalesce(text, F.lit(""))), SEARCH_WORDS) > 0


def search_query(text: Column) -> Column:
    """The first five words of more than three characters."""
    return F.array_join(F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 3), 1, 5), " ")


def queue_view(tasks: DataFrame, order: str = "seq", width: int = 10_000) -> DataFrame:
    """tasks with place: paused ones first, then pending ones in order; others have none.

    Places are counted within cells of `width` of `order` (an integer that is never null) and offset by the cells before; tasks
    without a place are not shuffled.
    """
    rank = F.when(F.col("status") == "paused", 0).when(F.col("status") == "pending", 1)
    rows = tasks.withColumn("_rank", rank)
    ranked = running(rows.where("_rank is not null"), ["_rank"], [order], F.lit(1), "_n", width, how="sum")
    paused = F.broadcast(rows.where("_rank = 0").agg(F.count("*").alias("_paused")))  # one row
    place = F.when(F.col("_rank") == 0, F.col("_n")).otherwise(F.col("_n") + F.col("_paused")).cast("int")
    ranked = ranked.join(paused, F.lit(True)).select(*tasks.columns, place.alias("place"))
    return ranked.unionByName(rows.where("_rank is null").select(*tasks.columns, F.lit(None).cast("int").alias("place")))


def quota_windows(events: DataFrame, ts: str = "ts", hours: int = 5, limit: int = 1000) -> DataFrame:
    """(window_start, calls, allowed, rejected) of tumbling windows."""
    rows = events.groupBy(F.window(ts, f"{hours} hours").alias("w")).agg(F.count("*").alias("calls"))
    return rows.select(F.col("w.start").alias("window_start"), "calls", F.least("calls", F.lit(limit)).alias("allowed"), F.greatest(F.col("calls") - limit, F.lit(0)).alias("rejected"))


def budget_allows(estimate: Column, remaining: Column, share: float = 0.4) -> Column:
    return estimate <= share * remaining


def cost_estimate(chars: Column, out_tokens: Column) -> Column:
    """Calls that a prompt of `chars` characters and a reply are counted as."""
    return F.greatest(F.lit(1), F.floor((F.floor(chars / 4) + out_tokens) / 1000) + 1).cast("long")


def executor_stats(calls: DataFrame, by: str) -> DataFrame:
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors")).withColumn("error_rate", F.bround(F.col("errors") / F.greatest("calls", F.lit(1)) * 100, 1))


def recent(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each group."""
    newest = W.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n).drop("_r")


def health(cycles: DataFrame, by: str, missing_modules: int = 0, trust_run: int = 0, trust_passed: int = 0) -> DataFrame:
    """(by, cycles, api_errors, force_stops, score, level, suggestions) over each group's cycles (by, action)."""
    n = lambda a: F.count_if(F.col("action") == a)
    rows = cycles.groupBy(by).agg(F.count("*").alias("cycles"), n("api_error").alias("api_errors"), n("quota_exhausted").alias("quota_exhaustions"), n("force_stop").alias("force_stops"))
    total = F.greatest("cycles", F.lit(1))
    rate = trust_passed / trust_run if trust_run else 1.0
    fixed = 30.0 * missing_modules + (20 if rate < 0.5 else 10 if rate < 0.8 else 5 if rate < 1 else 0)
    lost = fixed + (F.col("api_errors") + F.col("force_stops")) / total * 40 + F.col("force_stops") / total * 20
    score = F.bround(F.greatest(100 - lost, F.lit(0.0)), 1)
    rows = rows.withColumn("score", score).withColumn("level", level(F.col("score")))
    tips = F.array(
        F.when(F.col("api_errors") > 0, "check the endpoint"),
        F.when(F.col("force_stops") > 0, "add strategies or lower the threshold"),
        F.when(F.lit(missing_modules > 0), "reinstall dependencies"),
        F.when(F.col("score") < 60, "pause all tasks"),
        F.when(F.lit(trust_passed < trust_run), "review failing checks"),
        F.when(F.col("cycles") == 0, "no cycles"),
    )
    return rows.withColumn("suggestions", F.filter(tips, lambda t: t.isNotNull()))


def tuner_snapshot(history: DataFrame, by: str) -> DataFrame:
    """One row a group of (completion_score, marginal_gain, action, tokens_used)."""
    n = F.count("*")
    rate = lambda a: F.count_if(F.col("action") == a)
    return history.groupBy(by).agg(
        n.alias("n_cycles"),
        F.avg("marginal_gain").alias("avg_marginal_gain"),
        F.avg("completion_score").alias("avg_completion"),
        (F.sum("completion_score") / F.greatest(F.sum("tokens_used"), F.lit(1)) * 100).alias("api_efficiency"),
        (rate("force_stop") / n).alias("force_stop_rate"),
        (rate("switch_strategy") / n).alias("strategy_switch_rate"),
        F.sum("tokens_used").alias("token_usage"),
        (rate("continue") + rate("continue_low_freq")).alias("n_tasks_completed"),
        rate("force_stop").alias("n_tasks_failed"),
    )


def tuning_suggestions(snapshot: DataFrame, low: float = LOW_GAIN, medium: float = MEDIUM_GAIN, stops: int = STOPS, least: int = 30) -> DataFrame:
    """snapshot with suggestions: array<struct<parameter, current, suggested>>; none below `least` cycles.

    low, medium and stops are the current settings; suggested values scale the defaults, and a threshold is only
    lowered, the limit of stops only raised.
    """
    tip = lambda name, now, new: F.struct(F.lit(name).alias("parameter"), F.lit(float(now)).alias("current"), F.lit(float(new)).alias("suggested"))
    g = F.col("avg_marginal_gain")
    tips = F.array(
        F.when((g > 0) & (g < 10) & F.lit(max(2.0, LOW_GAIN * 0.6) < low), tip("low_gain_threshold", low, max(2.0, LOW_GAIN * 0.6))),
        F.when((F.col("force_stop_rate") > 0.3) & F.lit(min(6, STOPS + 1) > stops), tip("consecutive_stop_limit", stops, min(6, STOPS + 1))),
        F.when((F.col("avg_completion") < 50) & (F.col("strategy_switch_rate") > 0.2), tip("medium_gain_threshold", medium, max(5.0, MEDIUM_GAIN * 0.7))),
    )
    none = F.array().cast("array<struct<parameter:string,current:double,suggested:double>>")
    return snapshot.withColumn("suggestions", F.when(F.col("n_cycles") < least, none).otherwise(F.filter(tips, lambda t: t.isNotNull())))


def hybrid_route(task_level: Column, score: Column, gain: Column, index: Column, bottleneck: float = 30.0, low: float = 10.0) -> Column:
    """`judge` or `rule`, by which a task is scored: L1 tasks are judged, L2 ones once their rule score is stuck after a switch."""
    stuck = F.coalesce((score < bottleneck) & (gain < low) & (index > 0), F.lit(False))
    return F.when((task_level == "L1") | ((task_level == "L2") & stuck), "judge").otherwise("rule")


def sweep_stale(runs: DataFrame, now: float, max_age: float = 600.0) -> DataFrame:
    """runs (status, started, finished) with queued or running ones older than max_age interrupted at `now`; unstarted ones have no age."""
    live = F.col("status").isin("queued", "running")
    stale = F.coalesce(live & (F.lit(now) - F.col("started") > max_age), F.lit(False))
    return runs.withColumns({"status": F.when(stale, "interrupted").otherwise(F.col("status")), "finished": F.when(stale, F.lit(now)).otherwise(F.col("finished"))})


def run_budget(runs: DataFrame, by: str, limit: int = 10) -> DataFrame:
    """(by, active, has_budget): queued and running runs, and whether one more may start."""
    active = F.count_if(F.col("status").isin("queued", "running"))
    return runs.groupBy(by).agg(active.alias("active"), (active < limit).alias("has_budget"))


def status_totals(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("tasks"))


def apply_checkpoint(current: DataFrame, saved: DataFrame, key: str = "id") -> DataFrame:
    """current with each column at its saved value where the checkpoint has one."""
    names = [c for c in current.columns if c != key and c in saved.columns]
    rows = current.join(saved.select(key, *[F.col(c).alias(f"_s_{c}") for c in names]), key, "left")
    return rows.select(*[F.coalesce(f"_s_{c}", c).alias(c) if c in names else F.col(c) for c in current.columns])
