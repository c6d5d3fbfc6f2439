"""Workflow metrics: step durations, summaries, health and streaming-style windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.bridge import ARTICLES, DIM, METRICS, articles, metrics, read, text_of
from tidewire.plans.registry import query

c = F.col
R = lambda x, n=4: F.round(x, n)


@query(f"""WITH {METRICS} SELECT step_name, count(*) AS executions, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, round(avg(duration), 3) AS avg_ms, round(min(duration), 3) AS min_ms, round(max(duration), 3) AS max_ms FROM metrics WHERE duration > 0 GROUP BY step_name""")
def step_performance(spark, d):
    t = c("duration")
    return metrics(spark, d).where(t > 0).groupBy("step_name").agg(F.count(F.lit(1)).alias("executions"), F.count_if(c("status") == "completed").alias("completed"), F.count_if(c("status") == "failed").alias("failed"), R(F.avg(t), 3).alias("avg_ms"), R(F.min(t), 3).alias("min_ms"), R(F.max(t), 3).alias("max_ms"))


@query(f"""WITH {METRICS}, s AS (SELECT step_name, avg(duration) AS a, count(*) FILTER (WHERE status = 'failed') AS f FROM metrics WHERE duration > 0 GROUP BY 1), t AS (SELECT avg(a) AS avg_step, sum(f) AS failed, max(a) FILTER (WHERE step_name = 'purchase') AS cl, max(a) FILTER (WHERE step_name = 'click') AS it FROM s)
SELECT round(avg_step, 3) AS avg_step, failed::BIGINT AS failed, list_filter([CASE WHEN avg_step > 30000 THEN 'steps are slow' END, CASE WHEN failed > 0 THEN 'steps fail' END, CASE WHEN cl > 15000 THEN 'clustering is slow' END, CASE WHEN it > 20000 THEN 'intelligence is slow' END], lambda x: x IS NOT NULL) AS advice FROM t""")
def recommendations(spark, d):
    s = metrics(spark, d).where(c("duration") > 0).groupBy("step_name").agg(F.avg("duration").alias("a"), F.count_if(c("status") == "failed").alias("f"))
    t = s.agg(F.avg("a").alias("avg"), F.sum("f").alias("failed"), F.max(F.when(c("step_name") == "purchase", c("a"))).alias("cl"), F.max(F.when(c("step_name") == "click", c("a"))).alias("it"))
    advice = F.array_compact(F.array(F.when(c("avg") > 30000, "steps are slow"), F.when(c("failed") > 0, "steps fail"), F.when(c("cl") > 15000, "clustering is slow"), F.when(c("it") > 20000, "intelligence is slow")))
    return t.select(R(c("avg"), 3).alias("avg_step"), "failed", advice.alias("advice"))


@query(f"""WITH {METRICS}, p AS (SELECT workflow_id, step_name, sum(duration) AS s FROM metrics GROUP BY ALL), w AS (SELECT workflow_id, arg_max(step_name, (s, step_name)) AS longest, arg_min(step_name, (s, step_name)) AS shortest, round(avg(s), 3) AS avg_step FROM p GROUP BY 1)
SELECT m.workflow_id, count(*) AS events, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, any_value(longest) AS longest, any_value(shortest) AS shortest, any_value(avg_step) AS avg_step FROM metrics m JOIN w USING (workflow_id) GROUP BY 1""")
def workflow_summary(spark, d):
    p = metrics(spark, d).groupBy("workflow_id", "step_name").agg(F.sum("duration").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(c("status") == "completed").alias("ok"), F.count_if(c("status") == "failed").alias("bad"))
    key = F.struct("s", "step_name")
    return p.groupBy("workflow_id").agg(F.sum("n").alias("events"), F.sum("ok").alias("completed"), F.sum("bad").alias("failed"), F.max_by("step_name", key).alias("longest"), F.min_by("step_name", key).alias("shortest"), R(F.avg("s"), 3).alias("avg_step"))


@query(f"""WITH {METRICS}, s AS (SELECT workflow_id, step_name, min(ts) AS began FROM metrics WHERE status = 'started' GROUP BY ALL) SELECT m.event_id, round(epoch(m.ts) - epoch(s.began), 3) AS seconds FROM metrics m JOIN s USING (workflow_id, step_name) WHERE m.status IN ('completed', 'failed') AND m.ts >= s.began""")
def step_pairing(spark, d):
    """Completed or failed less the first start of the same step of the workflow: one aggregate that meets the rows again, so a long workflow is no window of its own."""
    m = metrics(spark, d)
    began = m.where(c("status") == "started").groupBy("workflow_id", "step_name").agg(F.min("ts").alias("began"))
    secs = F.unix_micros("ts") / 1e6 - F.unix_micros("began") / 1e6
    return m.where(c("status").isin("completed", "failed")).join(began, ["workflow_id", "step_name"]).where(c("ts") >= c("began")).select("event_id", R(secs, 3).alias("seconds"))


@query(f"""WITH {ARTICLES}, a AS (SELECT trim(coalesce(title, '')) <> '' AS t, trim(coalesce(content, '')) <> '' AS b, content_file_key IS NOT NULL AS r, coalesce(len(embedding) = {DIM}, FALSE) AS v, coalesce(epoch_ms(publish_date) > 0, FALSE) AS p, coalesce(length(content), 0) AS n FROM articles),
q AS (SELECT *, t::INTEGER + (r OR b)::INTEGER + v::INTEGER + p::INTEGER AS s FROM a)
SELECT count(*) FILTER (WHERE s / 4.0 >= 0.8) AS high, count(*) FILTER (WHERE s / 4.0 >= 0.5 AND s / 4.0 < 0.8) AS medium, count(*) FILTER (WHERE s / 4.0 < 0.5) AS low, round(avg(s / 4.0), 4)::DOUBLE AS avg_quality, count(*) FILTER (WHERE NOT t) AS no_title, count(*) FILTER (WHERE NOT b AND NOT r) AS no_content, count(*) FILTER (WHERE NOT r) AS no_reference, count(*) FILTER (WHERE NOT v) AS no_embedding, count(*) FILTER (WHERE NOT p) AS bad_date,
count(*) FILTER (WHERE n = 0) AS empty, min(n) AS min_chars, round(avg(n), 3) AS avg_chars, max(n) AS max_chars, round(count(*) FILTER (WHERE v) * 100.0 / count(*), 1)::DOUBLE AS coverage FROM q""")
def article_quality(spark, d):
    """A quarter each for a title, content or its reference, a vector of the right width and a date after 1970; the articles that lack each."""
    has = lambda x: F.trim(F.coalesce(c(x), F.lit(""))) != ""
    flags = {"t": has("title"), "b": has("content"), "r": c("content_file_key").isNotNull(), "v": F.coalesce(F.size("embedding") == DIM, F.lit(False)), "p": F.coalesce(F.unix_millis("publish_date") > 0, F.lit(False)), "n": F.coalesce(F.length("content"), F.lit(0)).cast("bigint")}
    a = articles(spark, d, vectors=True).select(*(x.alias(k) for k, x in flags.items()))
    q = a.withColumn("s", sum(f.cast("int") for f in (c("t"), c("r") | c("b"), c("v"), c("p"))) / 4.0)
    s, lack = c("s"), lambda f, name: F.count_if(~f).alias(name)
    return q.agg(F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.5) & (s < 0.8)).alias("medium"), F.count_if(s < 0.5).alias("low"), R(F.avg(s)).alias("avg_quality"),
                 lack(c("t"), "no_title"), lack(c("b") | c("r"), "no_content"), lack(c("r"), "no_reference"), lack(c("v"), "no_embedding"), lack(c("p"), "bad_date"), F.count_if(c("n") == 0).alias("empty"),
                 F.min("n").alias("min_chars"), R(F.avg("n"), 3).alias("avg_chars"), F.max("n").alias("max_chars"), R(F.count_if("v") * 100.0 / F.count(F.lit(1)), 1).alias("coverage"))


@query(f"""WITH {METRICS}, s AS (SELECT date_trunc('day', ts) AS day, step_name, count(*) AS n FROM metrics GROUP BY ALL) SELECT strftime(day, '%Y-%m-%d') AS day, step_name, n, n - lag(n) OVER (PARTITION BY step_name ORDER BY day) AS delta FROM s""")
def snapshot_deltas(spark, d):
    s = metrics(spark, d).groupBy(F.date_trunc("day", "ts").alias("day"), "step_name").agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "step_name", "n", (c("n") - F.lag("n").over(Window.partitionBy("step_name").orderBy("day"))).alias("delta"))


@query(f"""WITH {METRICS} SELECT workflow_id, CASE WHEN bool_or(step_name = 'error' AND k > 97) THEN 'terminated' WHEN bool_or(step_name = 'purchase') THEN 'completed' WHEN count(*) > 0 THEN 'running' ELSE 'unknown' END AS state FROM metrics GROUP BY 1""")
def workflow_status(spark, d):
    return metrics(spark, d).groupBy("workflow_id").agg(F.when(F.bool_or((c("step_name") == "error") & (c("k") > 97)), "terminated").when(F.bool_or(c("step_name") == "purchase"), "completed").otherwise("running").alias("state"))


@query(f"""WITH {METRICS} SELECT CASE WHEN duration / 1000 < 100 THEN 'fast' WHEN duration / 1000 < 500 THEN 'normal' ELSE 'slow' END AS bucket, count(*) AS n, round(count(*) FILTER (WHERE status <> 'failed') * 100.0 / count(*), 1)::DOUBLE AS success FROM metrics GROUP BY 1""")
def latency_buckets(spark, d):
    ms = c("duration") / 1000
    b = F.when(ms < 100, "fast").when(ms < 500, "normal").otherwise("slow")
    return metrics(spark, d).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), R(F.count_if(c("status") != "failed") * 100.0 / F.count(F.lit(1)), 1).alias("success"))


@query(f"""WITH {METRICS}, r AS (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY ts DESC, event_id DESC) AS r FROM metrics) SELECT workflow_id, event_id, step_name FROM r WHERE r = 1""")
def latest_per_workflow(spark, d):
    last = F.max(F.struct("ts", "event_id", "step_name")).alias("m")
    return metrics(spark, d).groupBy("workflow_id").agg(last).select("workflow_id", "m.event_id", "m.step_name")


@query(f"""WITH {METRICS} SELECT workflow_id, arg_min(event_id, (ts, event_id)) AS first_click FROM metrics WHERE step_name = 'click' GROUP BY 1""")
def first_of_stage(spark, d):
    return metrics(spark, d).where(c("step_name") == "click").groupBy("workflow_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_click"))


@query(f"""WITH {METRICS} SELECT round(count(*) FILTER (WHERE status = 'failed') * 1.0 / nullif(count(*), 0), 4)::DOUBLE AS error_rate, CASE WHEN count(*) FILTER (WHERE status = 'failed') * 1.0 / nullif(count(*), 0) > 0.1 THEN 'degraded' ELSE 'healthy' END AS health, count(DISTINCT workflow_id) AS workflows FROM metrics""")
def dashboard_health(spark, d):
    e = F.try_divide(F.count_if(c("status") == "failed"), F.count(F.lit(1)))
    return metrics(spark, d).agg(R(e).alias("error_rate"), F.when(e > 0.1, "degraded").otherwise("healthy").alias("health"), F.count_distinct("workflow_id").alias("workflows"))


DEC = """dec AS (SELECT o_orderkey AS id, o_custkey % 20 + 1 AS candidates, (o_custkey % 20 + 1) // 2 AS selected, (o_orderkey % 7) / 7.0 AS coherence, (o_orderkey % 5) / 5.0 AS relevance, (o_orderkey % 3) / 3.0 AS confidence, (o_orderkey % 4)::INTEGER AS borderline, (o_orderkey % 10) / 4.0 AS margin, (o_custkey % 8) / 8.0 AS rejected_margin, o_orderkey % 6 = 0 AS failed FROM orders)"""


def decisions(spark, d):
    """Story-selection steps, from orders."""
    i, k = c("o_orderkey"), c("o_custkey") % 20 + 1
    return read(spark, d, "orders").select(i.alias("id"), k.alias("candidates"), F.expr("(o_custkey % 20 + 1) div 2").alias("selected"), (i % 7 / 7.0).alias("coherence"), (i % 5 / 5.0).alias("relevance"), (i % 3 / 3.0).alias("confidence"), (i % 4).cast("int").alias("borderline"), (i % 10 / 4.0).alias("margin"), (c("o_custkey") % 8 / 8.0).alias("rejected_margin"), (i % 6 == 0).alias("failed"))


@query(f"""WITH {DEC} SELECT round(sum(coherence), 3)::DOUBLE AS coherence, round(avg(relevance), 4)::DOUBLE AS relevance, round(avg(confidence), 4)::DOUBLE AS confidence, round(sum(selected) * 1.0 / sum(candidates), 4)::DOUBLE AS selection_rate,
round(abs(1 - (sum(coherence) + sum(relevance) + sum(confidence)) / 3), 2)::DOUBLE AS variance FROM dec""")
def importance_evaluation(spark, d):
    """The deviation is that of the sums, not of the means, as the rule has it."""
    spread = F.abs(1 - (F.sum("coherence") + F.sum("relevance") + F.sum("confidence")) / 3)
    return decisions(spark, d).agg(R(F.sum("coherence"), 3).alias("coherence"), R(F.avg("relevance")).alias("relevance"), R(F.avg("confidence")).alias("confidence"), R(F.sum("selected") / F.sum("candidates")).alias("selection_rate"), R(spread, 2).alias("variance"))


@query(f"""WITH {DEC}, s AS (SELECT id % 13 AS workflow_id, id, unnest(range(candidates)) AS story FROM dec) SELECT workflow_id, count(*) AS decisions, round(count(*) FILTER (WHERE (id + story) % 4 <> 0) * 1.0 / count(*), 4)::DOUBLE AS reasoning_provided,
round(count(*) FILTER (WHERE (id + story) % 3 <> 0) * 1.0 / count(*), 4)::DOUBLE AS factors_explained, round((count(*) FILTER (WHERE (id + story) % 4 <> 0) + count(*) FILTER (WHERE (id + story) % 3 <> 0)) / (2.0 * count(*)), 4)::DOUBLE AS decision_clarity FROM s GROUP BY workflow_id""")
def decision_transparency(spark, d):
    """Shares of a workflow's story decisions that give a reason, that list factors, and the mean of both."""
    stories = decisions(spark, d).select((c("id") % 13).alias("workflow_id"), "id", F.explode(F.sequence(F.lit(0).cast("bigint"), c("candidates") - 1)).alias("story"))
    reason, factors = F.when((c("id") + c("story")) % 4 != 0, "given"), F.when((c("id") + c("story")) % 3 != 0, F.array(F.lit("scale")))
    n, r, f = F.count(F.lit(1)), F.count_if(F.coalesce(reason, F.lit("none")) != "none"), F.count_if(F.coalesce(F.size(factors), F.lit(0)) > 0)
    return stories.groupBy("workflow_id").agg(n.alias("decisions"), R(r / n).alias("reasoning_provided"), R(f / n).alias("factors_explained"), R((r + f) / (2 * n)).alias("decision_clarity"))


@query(f"""WITH {METRICS}, s AS (SELECT workflow_id, count(*) AS n, count(*) FILTER (WHERE step_name IN ('purchase', 'signup')) AS imp, count(*) FILTER (WHERE status = 'failed') AS bad, count(*) FILTER (WHERE status = 'failed' AND k % 2 = 0) AS told, count(*) FILTER (WHERE step_name = 'view') AS quality FROM metrics GROUP BY 1),
t AS (SELECT *, least(0.7 * imp / greatest(0.3 * n, 1) + 0.3 * CASE WHEN bad > 0 THEN told * 1.0 / bad ELSE 1 END, 1) AS score FROM s)
SELECT workflow_id, round(score, 4)::DOUBLE AS transparency, CASE WHEN score > 0.8 THEN 'excellent' WHEN score > 0.6 THEN 'good' WHEN score > 0.4 THEN 'fair' ELSE 'poor' END AS health,
list_filter([CASE WHEN imp < 3 THEN 'more importance steps' END, CASE WHEN bad > n * 0.1 THEN 'many errors' END, CASE WHEN score < 0.6 THEN 'document more' END, CASE WHEN quality < 2 THEN 'more quality checks' END], lambda x: x IS NOT NULL) AS advice FROM t""")
def transparency(spark, d):
    """Transparency of each workflow: its importance steps (purchase, signup), documented errors, quality steps (view)."""
    n = F.count(F.lit(1))
    s = metrics(spark, d).groupBy("workflow_id").agg(
        n.alias("n"), F.count_if(c("step_name").isin("purchase", "signup")).alias("imp"), F.count_if(c("status") == "failed").alias("bad"), F.count_if((c("status") == "failed") & (c("k") % 2 == 0)).alias("told"), F.count_if(c("step_name") == "view").alias("quality"))
    told = F.when(c("bad") > 0, c("told") / c("bad")).otherwise(1.0)
    t = s.withColumn("score", F.least(0.7 * c("imp") / F.greatest(0.3 * c("n"), F.lit(1.0)) + 0.3 * told, F.lit(1.0)))
    health = F.when(c("score") > 0.8, "excellent").when(c("score") > 0.6, "good").when(c("score") > 0.4, "fair").otherwise("poor")
    advice = F.array_compact(F.array(F.when(c("imp") < 3, "more importance steps"), F.when(c("bad") > c("n") * 0.1, "many errors"), F.when(c("score") < 0.6, "document more"), F.when(c("quality") < 2, "more quality checks")))
    return t.select("workflow_id", R(c("score")).alias("transparency"), health.alias("health"), advice.alias("advice"))


@query(f"""WITH {DEC} SELECT id, CASE WHEN borderline > 0 AND rejected_margin < 0.5 THEN 4.5 WHEN selected * 1.0 / candidates < 0.3 AND margin > 2 THEN 4.0 END::DOUBLE AS threshold, CASE WHEN borderline > 0 AND rejected_margin < 0.5 THEN borderline WHEN selected * 1.0 / candidates < 0.3 AND margin > 2 THEN floor(candidates * 0.2) END::BIGINT AS additional,
CASE WHEN borderline > 0 AND rejected_margin < 0.5 THEN -0.1 WHEN selected * 1.0 / candidates < 0.3 AND margin > 2 THEN -0.2 END::DOUBLE AS tradeoff, round(CASE WHEN selected + borderline = 0 OR failed THEN 0 ELSE selected * 0.7 / (selected + borderline) + least(margin / 3, 0.3) END, 4)::DOUBLE AS confidence FROM dec""")
def threshold_tuning(spark, d):
    """Advice on the threshold of 5 (null: none), and the confidence of the selection; failed runs have no record of it, which counts as 0."""
    lower, bolder = (c("borderline") > 0) & (c("rejected_margin") < 0.5), (c("selected") / c("candidates") < 0.3) & (c("margin") > 2)
    advice = lambda a, b: F.when(lower, a).when(bolder, b)
    share = F.try_divide(c("selected"), c("selected") + c("borderline")) * 0.7 + F.least(c("margin") / 3, F.lit(0.3))
    return decisions(spark, d).select(
        "id", advice(F.lit(4.5), F.lit(4.0)).alias("threshold"), advice(c("borderline").cast("bigint"), F.floor(c("candidates") * F.lit(0.2))).alias("additional"), advice(F.lit(-0.1), F.lit(-0.2)).alias("tradeoff"),
        R(F.when(c("failed"), F.lit(0.0)).otherwise(F.coalesce(share, F.lit(0.0)))).alias("confidence"))


@query(f"""WITH {METRICS}, s AS (SELECT workflow_id, count(*) FILTER (WHERE step_name = 'signup') AS a, count(*) FILTER (WHERE step_name = 'click') AS b, count(*) FILTER (WHERE step_name = 'purchase') AS p FROM metrics GROUP BY 1) SELECT workflow_id, round(b * 100.0 / nullif(a, 0), 1)::DOUBLE AS click_rate, round(p * 100.0 / nullif(b, 0), 1)::DOUBLE AS purchase_rate, CASE WHEN p * 100.0 / nullif(b, 0) < 50 THEN 'low yield' WHEN p * 100.0 / nullif(b, 0) < 80 THEN 'check' ELSE 'fine' END AS advice FROM s""")
def dataflow(spark, d):
    s = metrics(spark, d).groupBy("workflow_id").pivot("step_name", ["signup", "click", "purchase"]).agg(F.count(F.lit(1))).na.fill(0)
    rate = lambda x, y: F.try_divide(c(x) * 100.0, c(y))
    p = rate("purchase", "click")
    return s.select("workflow_id", R(rate("click", "signup"), 1).alias("click_rate"), R(p, 1).alias("purchase_rate"), F.when(p < 50, "low yield").when(p < 80, "check").otherwise("fine").alias("advice"))


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL""")
def daily_windows(spark, d):
    """An addition: tumbling event-time windows."""
    e = read(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), R(F.sum("value"), 3).alias("total")).select(text_of(c("window.start")).alias("day"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY user_id, sid""")
def user_sessions(spark, d):
    """An addition: session windows with a gap of 30 minutes."""
    e = read(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", text_of(c("w.start")).alias("began"), "n")
