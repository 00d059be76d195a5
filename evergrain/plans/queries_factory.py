"""Registered queries of the training-data factory."""

from __future__ import annotations

from pyspark.sql import functions as F

from evergrain.operators import factory
from evergrain.session import table

from . import views as V
from .registry import query

# ---- exchanges over turns whose texts need no cleaning --------------------------------------------------------------

ARCS = f"""WITH {V.PLAIN_TURNS_SQL}, g AS (SELECT *, sum((role='user')::INT) OVER (PARTITION BY session_id ORDER BY turn_idx ROWS UNBOUNDED PRECEDING) AS seg FROM turns),
    t AS (SELECT *, max(CASE WHEN role='assistant' AND length(text) >= 80 THEN turn_idx END) OVER (PARTITION BY session_id, seg) AS target, min(turn_idx) OVER (PARTITION BY session_id, seg) AS trig FROM g WHERE seg > 0),
    x AS (SELECT session_id, trig AS trigger_idx, target AS target_idx, sum(CASE role WHEN 'assistant' THEN n_tool_calls WHEN 'tool' THEN 1 ELSE 0 END)::BIGINT AS n_tool_calls, coalesce(bool_or(role='tool' AND tool_error), false) AS had_tool_error
        FROM t WHERE target IS NOT NULL AND turn_idx <= target GROUP BY session_id, seg, trig, target)"""


@query("exchange_arcs", ARCS + " SELECT * FROM x")
def exchange_arcs(spark, sf_dir):
    return factory.exchanges(V.plain_turns(spark, sf_dir)).select("session_id", "trigger_idx", "target_idx", "n_tool_calls", "had_tool_error")


@query("context_of_targets", ARCS + """, s AS (SELECT session_id, turn_idx, length(text) AS n, row_number() OVER (PARTITION BY session_id ORDER BY turn_idx) AS nth FROM turns WHERE role IN ('user','assistant')),
    u AS (SELECT x.session_id, x.target_idx, max(nth) AS upto FROM x JOIN s ON s.session_id = x.session_id AND s.turn_idx < x.target_idx GROUP BY ALL),
    c AS (SELECT u.session_id, u.target_idx, n, sum(n) OVER (PARTITION BY u.session_id, u.target_idx ORDER BY nth DESC) AS run FROM u JOIN s ON s.session_id = u.session_id AND s.nth BETWEEN greatest(1, upto - 5) AND upto)
    SELECT session_id, target_idx, count(*) AS n_context, sum(n)::BIGINT AS context_chars FROM c WHERE run <= 400 GROUP BY ALL""")
def context_of_targets(spark, sf_dir):
    t = V.plain_turns(spark, sf_dir)
    return factory.context_windows(t, factory.exchanges(t), 6, 400).select("session_id", "target_idx", "n_context", "context_chars")


@query("exchange_labels", ARCS + """, f AS (SELECT x.*, (SELECT arg_min(k % 6, turn_idx) FROM turns u WHERE u.session_id = x.session_id AND u.role='user' AND u.turn_idx > x.target_idx) AS follow, session_id::BIGINT % 5 = 0 AS good, session_id::BIGINT % 7 = 0 AS bad FROM x)
    SELECT session_id, target_idx, CASE WHEN bad OR follow = 1 THEN 'bad' WHEN follow = 0 OR had_tool_error OR n_tool_calls >= 5 OR good THEN 'good' ELSE 'neutral' END AS label,
    (CASE WHEN bad THEN 0.6 WHEN follow = 1 THEN 0.9 WHEN follow = 0 THEN CASE WHEN good THEN 0.95 ELSE 0.9 END WHEN had_tool_error THEN CASE WHEN good THEN 0.9 ELSE 0.8 END WHEN n_tool_calls >= 5 THEN CASE WHEN good THEN 0.8 ELSE 0.7 END WHEN good THEN 0.6 ELSE 0.5 END)::DOUBLE AS confidence,
    CASE WHEN bad THEN 'retrieval_bad' WHEN follow = 1 THEN 'correction_followup' WHEN follow = 0 THEN 'affirmation' WHEN had_tool_error THEN 'error_recovery' WHEN n_tool_calls >= 5 THEN 'task_success' WHEN good THEN 'retrieval_good' ELSE 'neutral' END AS reason FROM f""")
def exchange_labels(spark, sf_dir):
    t = V.plain_turns(spark, sf_dir)
    k = F.col("session_id").cast("long")
    outcomes = t.select("session_id").distinct().select("session_id", (k % 5 == 0).alias("good"), (k % 7 == 0).alias("bad"))
    found = factory.label_exchanges(factory.exchanges(t), t, outcomes)
    return found.select("session_id", "target_idx", "label", F.round("confidence", 6).alias("confidence"), F.col("reasons")[0].alias("reason"))


@query("persona_prompts", f"""WITH {V.PLAIN_TURNS_SQL}, p AS (SELECT *, last_value(CASE WHEN role='assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt FROM turns)
    SELECT session_id, turn_idx, prompt, text AS voice FROM p WHERE role='user' AND sender_verified""")
def persona_prompts(spark, sf_dir):
    return factory.persona_pairs(V.plain_turns(spark, sf_dir)).select("session_id", "turn_idx", "prompt", "voice")


@query("collapsed_texts", f"""WITH {V.PLAIN_TURNS_SQL}, n AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY session_id ORDER BY turn_idx) = role THEN 0 ELSE 1 END AS new FROM turns), g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY turn_idx ROWS UNBOUNDED PRECEDING) - 1 AS nth FROM n)
    SELECT session_id, nth::BIGINT AS turn_idx, any_value(role) AS role, string_agg(text, chr(10) ORDER BY turn_idx) AS text, sum(n_tool_calls)::BIGINT AS n_tool_calls, bool_or(tool_error) AS tool_error FROM g GROUP BY session_id, nth""")
def collapsed_texts(spark, sf_dir):
    return factory.collapse(V.plain_turns(spark, sf_dir)).select("session_id", "turn_idx", "role", "text", "n_tool_calls", "tool_error")


@query("edited_pairs", """WITH p AS (SELECT event_id, user_id*50 + event_id%50 AS b, event_type, last_value(CASE WHEN event_type='view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id*50 + event_id%50 ORDER BY event_id) AS prop FROM events)
    SELECT 'evt_'||prop AS proposal_id, 'bel_'||b AS belief_id, 'v'||prop AS rejected, 'x'||event_id AS chosen FROM p WHERE event_type='purchase' AND prop IS NOT NULL AND event_id%5=0 AND event_id%7<>0""")
def edited_pairs(spark, sf_dir):
    return factory.event_pairs(V.varied_log(spark, sf_dir)).select("proposal_id", "belief_id", "rejected", "chosen")


# ---- examples -------------------------------------------------------------------------------------------------------

DATASET = "CASE doc_id % 3 WHEN 0 THEN 'sft' WHEN 1 THEN 'dpo' ELSE 'persona' END"


@query("train_classes", f"""WITH e AS (SELECT doc_id AS id, {DATASET} AS dataset, CASE doc_id%7 WHEN 0 THEN 'bad' WHEN 1 THEN 'excluded' WHEN 2 THEN 'neutral' ELSE 'good' END AS label, doc_id%11=0 AS hard, doc_id%13=0 AS inj, doc_id%17=0 AS issue, doc_id%2=0 AS verified, doc_id%5=1 AS commit FROM documents)
    SELECT id, CASE WHEN label IN ('bad','excluded') OR hard OR inj OR issue OR (dataset='persona' AND NOT verified) THEN 'exclude' WHEN dataset='persona' AND commit THEN 'train_skill' WHEN dataset='persona' THEN 'train_voice' WHEN dataset='dpo' THEN 'train_judgment' WHEN label<>'good' THEN 'retrieval_only' ELSE 'train_skill' END AS train_class,
    CASE WHEN label IN ('bad','excluded') THEN 'quality_label:'||label WHEN hard THEN 'hard_quality_contamination' WHEN inj THEN 'injection_flagged_training_boundary' WHEN issue THEN 'current_training_boundary:old_rule' WHEN dataset='persona' AND NOT verified THEN 'persona_author_not_verified' WHEN dataset='persona' AND commit THEN 'verified_human_commit_skill' WHEN dataset='persona' THEN 'verified_human_voice' WHEN dataset='dpo' THEN 'accepted_preference_pair' WHEN label<>'good' THEN 'sft_not_good' ELSE 'successful_instruction_exchange' END AS class_reason FROM e""")
def train_classes(spark, sf_dir):
    k = F.col("id")
    none = F.array().cast("array<string>")
    rows = V.examples(spark, sf_dir).select(
        "id", "dataset", "source_kind", V.pick(k % 7, "bad", "excluded", "neutral", "good", "good", "good", "good").alias("quality_label"), (k % 2 == 0).alias("sender_verified"),
        F.array_compact(F.array(F.when(k % 11 == 0, F.lit("envelope_residue")), F.when(k % 13 == 0, F.lit("injection_flagged")))).alias("quality_reasons"), F.when(k % 17 == 0, F.array(F.lit("old_rule"))).otherwise(none).alias("issues"),
    )
    return factory.classify(rows).select("id", "train_class", "class_reason")


@query("final_pack", f"""WITH t AS (SELECT doc_id AS id, {DATASET} AS dataset, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 3 END AS p FROM documents WHERE doc_id % 4 <> 0 AND (doc_id % 10)/10.0 >= 0.8),
    r AS (SELECT id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY p, sha256('final:'||dataset||':'||id)) AS selection_rank FROM t) SELECT * FROM r WHERE selection_rank <= 5""")
def final_pack(spark, sf_dir):
    found = factory.finalise_pack(V.examples(spark, sf_dir), "final", {"sft": 5, "dpo": 5, "persona": 5})
    return found.select("id", "dataset", F.col("selection_rank").cast("long").alias("selection_rank"))


@query("growth_report", f"""WITH e AS (SELECT {DATASET} AS dataset, CASE WHEN quality=1 THEN 'good' WHEN quality=0 THEN 'bad' ELSE 'neutral' END AS quality_label, CASE doc_id%4 WHEN 0 THEN 'private' WHEN 1 THEN 'workspace' WHEN 2 THEN 'project' ELSE 'public' END AS privacy_scope, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 60) AS d, (doc_id%10)/10.0 AS g FROM documents LEFT JOIN labels USING (doc_id)),
    w AS (SELECT *, isoyear(d)||'-W'||lpad(week(d)::VARCHAR, 2, '0') AS week FROM e)
    SELECT dataset, quality_label, privacy_scope, week, count(*) AS n, round(avg(g), 6) AS grade_avg, min(g)::DOUBLE AS grade_min, max(g)::DOUBLE AS grade_max FROM w GROUP BY GROUPING SETS ((dataset, quality_label), (dataset, privacy_scope), (dataset, week), (dataset))""")
def growth_report(spark, sf_dir):
    at = F.date_format(F.expr("timestamp '2024-01-01' + make_dt_interval(cast(id % 60 as int))"), "yyyy-MM-dd HH:mm:ss")
    found = factory.growth_report(V.examples(spark, sf_dir).withColumn("occurred_at", at))
    return found.withColumn("grade_avg", F.round("grade_avg", 6))


@query("blind_dimension_means", """WITH r AS (SELECT item_id, s.side, d.dimension, (item_id * 3 + length(d.dimension) + CASE s.side WHEN 'a' THEN 1 ELSE 4 END) % 7 AS score FROM benchmark, (VALUES ('a'), ('b')) s(side), (VALUES ('taste'), ('judgment')) d(dimension))
    SELECT dimension, CASE WHEN side = CASE item_id % 2 WHEN 0 THEN 'a' ELSE 'b' END THEN 'candidate' ELSE 'reference' END AS role, round(avg(score), 3) AS mean FROM r WHERE score BETWEEN 1 AND 5 GROUP BY 1, 2""")
def blind_dimension_means(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("eval_id"))
    rows = b.withColumn("side", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("dimension", F.explode(F.array(F.lit("taste"), F.lit("judgment"))))
    score = (F.col("eval_id") * 3 + F.length("dimension") + F.when(F.col("side") == "a", 1).otherwise(4)) % 7
    return factory.blind_dimensions(rows.withColumn("score", score), b.select("eval_id", V.pick(F.col("eval_id") % 2, "a", "b").alias("candidate_side")))


ORDER4 = """a AS (SELECT item_id, s.source FROM benchmark, (VALUES ('person'), ('base'), ('tuned'), ('frontier')) s(source)),
    o AS (SELECT *, substring('abcd', row_number() OVER (PARTITION BY item_id ORDER BY sha256('four:'||item_id||':'||source))::INT, 1) AS label FROM a)"""


def _four(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("eval_id"))
    return b.withColumn("source", F.explode(F.array(*map(F.lit, ("person", "base", "tuned", "frontier")))))


@query("blind_four_way_order", f"WITH {ORDER4} SELECT item_id AS eval_id, source, label FROM o")
def blind_four_way_order(spark, sf_dir):
    return factory.blind_order(_four(spark, sf_dir), "four").select("eval_id", "source", "label")


@query("ranking_dimension_means", f"WITH {ORDER4} SELECT source, 'taste' AS dimension, round(avg((item_id + ascii(label)) % 5 + 1), 4) AS mean FROM o GROUP BY source")
def ranking_dimension_means(spark, sf_dir):
    shown = factory.blind_order(_four(spark, sf_dir), "four")
    scores = shown.select("eval_id", "label", F.lit("taste").alias("dimension"), ((F.col("eval_id") + F.ascii("label")) % 5 + 1).alias("score"))
    return factory.ranking_dimensions(scores, shown)


@query("ranking_places", """WITH r AS (SELECT unnest(CASE item_id % 3 WHEN 0 THEN ['x','y','z'] WHEN 1 THEN ['y','x','z'] ELSE ['z','y','x'] END) AS candidate, generate_subscripts(CASE item_id % 3 WHEN 0 THEN ['x','y','z'] WHEN 1 THEN ['y','x','z'] ELSE ['z','y','x'] END, 1) AS pos FROM benchmark)
    SELECT candidate, count(*) FILTER (pos = 1) AS first_places, round(avg(pos), 6) AS mean_rank FROM r GROUP BY 1""")
def ranking_places(spark, sf_dir):
    order = V.pick(F.col("item_id") % 3, *[F.array(*map(F.lit, names)) for names in ("xyz", "yxz", "zyx")])
    return factory.ranking_scores(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("eval_id"), order.alias("ranking")))


@query("eval_id_differences", """SELECT item_id AS eval_id, array_to_string(list_filter(['a', CASE WHEN item_id % 3 <> 0 THEN 'b' END, CASE WHEN item_id % 4 <> 0 THEN 'c' END], lambda x: x IS NOT NULL), ',') AS have FROM benchmark WHERE item_id % 3 = 0 OR item_id % 4 = 0""")
def eval_id_differences(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("eval_id"))
    found = factory.id_set_differences(a=b, b=b.where("eval_id % 3 <> 0"), c=b.where("eval_id % 4 <> 0"))
    return found.select("eval_id", F.array_join("have", ",").alias("have"))


# ---- pilots ---------------------------------------------------------------------------------------------------------


@query("held_out_examples", "SELECT doc_id AS id FROM documents ORDER BY (doc_id % 3 = 0)::INT, sha256('pilot:'||doc_id), doc_id LIMIT 40")
def held_out_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), (F.col("doc_id") % 3 == 0).alias("train_selected"))
    return factory.held_out(rows, 40, "pilot").select("id")


@query("training_without_held_out", """WITH h AS (SELECT sha256(text) AS c FROM documents ORDER BY (doc_id % 3 = 0)::INT, sha256('pilot:'||doc_id), doc_id LIMIT 40) SELECT doc_id AS id FROM documents WHERE sha256(text) NOT IN (SELECT c FROM h)""")
def training_without_held_out(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), (F.col("doc_id") % 3 == 0).alias("train_selected"))
    return factory.without_held_out(rows, factory.held_out(rows, 40, "pilot")).select("id")


@query("trimmed_chats", f"""WITH {V.PLAIN_TURNS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_idx DESC) AS back, count(*) OVER (PARTITION BY session_id) AS n_all FROM turns),
    p AS (SELECT *, sum(length(text)) OVER (PARTITION BY session_id ORDER BY turn_idx DESC) AS used FROM b WHERE back > 1), kept AS (SELECT session_id, count(*) AS n_kept, sum(length(text))::BIGINT AS prompt_chars FROM p WHERE used <= 300 OR back = 2 GROUP BY 1)
    SELECT b.session_id AS id, coalesce(n_kept, 0) AS n_kept, coalesce(prompt_chars, 0) AS prompt_chars, coalesce(n_kept, 0) < n_all - 1 AS trimmed, role='assistant' AND length(trim(text)) >= 80 AND n_all >= 2 AND coalesce(prompt_chars, 0) <= 300 AS usable FROM b LEFT JOIN kept USING (session_id) WHERE back = 1""")
def trimmed_chats(spark, sf_dir):
    t = V.plain_turns(spark, sf_dir).select(F.col("session_id").alias("id"), F.col("turn_idx").alias("pos"), "role", F.col("text").alias("content"))
    return factory.trimmed_chats(t, 300).select("id", "n_kept", "prompt_chars", "trimmed", "usable")


@query("founder_session_turns", """SELECT conv_id::VARCHAR AS session_id, count(*) AS n FROM conversations WHERE conv_id % 4 = 2 AND conv_id IN (SELECT conv_id FROM conversations WHERE role='user') GROUP BY 1""")
def founder_session_turns(spark, sf_dir):
    t = V.turns(spark, sf_dir)
    lines = t.select("session_id", F.concat(F.lit("from "), F.coalesce("authored_by", F.lit("-"))).alias("line"))
    return factory.founder_sessions(lines, t, ["u2"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("training_results", """WITH m AS (SELECT event_type AS name, arg_max(value, event_id) AS v FROM events GROUP BY 1) SELECT (SELECT count(*) FROM documents) AS n_rows, 'base' AS model, (SELECT v FROM m WHERE name='click') AS last_click, (SELECT v FROM m WHERE name='view') AS last_view""")
def training_results(spark, sf_dir):
    metrics = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value")
    found = factory.training_result(metrics, table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash")), "base", "t")
    return found.select("n_rows", "model", F.col("metrics")["click"].alias("last_click"), F.col("metrics")["view"].alias("last_view"))
