"""Queries of the study tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import study
from ..sources.bindings import bound, ctes

PHRASES = [(1, "Supplier#000000001", "one"), (2, "Supplier#00000000", "few"), (3, "00000002", "twenties")]
DONE = "2024-03-01 00:00:00"


def _t(spark, sf_dir):
    return {n: bound(spark, sf_dir, n) for n in ("quizzes", "questions", "session_answers", "study_sessions")}


def _scored_sessions(t):
    scores = study.session_scores(t["session_answers"]).withColumnRenamed("session_id", "_s")
    return t["study_sessions"].join(scores, F.col("id") == F.col("_s"), "left").drop("_s")


def study_quizzes(spark, sf_dir):
    t = _t(spark, sf_dir)
    return study.quizzes_with_counts(t["quizzes"], t["questions"])


def study_stats(spark, sf_dir):
    t = _t(spark, sf_dir)
    return study.quiz_stats(t["quizzes"], _scored_sessions(t))


def study_stats_one(spark, sf_dir):
    """Only quizzes with completed sessions, of one topic given as a parameter."""
    t = _t(spark, sf_dir)
    return study.attempted(study.quiz_stats(t["quizzes"].where(F.col("topic") == "topic_1"), _scored_sessions(t)))


def study_session_results(spark, sf_dir):
    t = _t(spark, sf_dir)
    return study.sessions_with_quiz(_scored_sessions(t), t["quizzes"])


def study_answers(spark, sf_dir):
    t = _t(spark, sf_dir)
    found = study.answers_in_order(t["session_answers"], t["questions"])
    return found.select("id", "session_id", "question_id", "question_text", "correct_answer", "is_correct", "place")


def study_complete_session(spark, sf_dir):
    t = _t(spark, sf_dir)
    done = study.completed(t["study_sessions"], t["session_answers"], F.lit(DONE).cast("timestamp_ntz"), F.col("is_completed"))
    return done


def study_delete_cascade(spark, sf_dir):
    t = _t(spark, sf_dir)
    gone = t["quizzes"].where("id % 6 = 0").select("id")
    left = study.delete_quiz(t["quizzes"], t["questions"], t["study_sessions"], t["session_answers"], gone)
    counts = [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows"), F.sum("id").alias("id_sum")) for n, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def study_insert_returning(spark, sf_dir):
    t = _t(spark, sf_dir)
    rows = t["quizzes"].where("id < 3").select(F.concat(F.lit("Copy of "), F.col("name")).alias("name"), "topic")
    return study.inserted(t["quizzes"], rows)


def study_update_explanations(spark, sf_dir):
    t = _t(spark, sf_dir)
    table = t["questions"].withColumn("explanation", F.when(F.col("id") % 4 == 0, "old"))
    return study.updated(table, t["questions"].where("id % 3 = 0").select("id", F.concat(F.lit("new "), F.col("correct_answer")).alias("explanation")), "id", "explanation")


def study_match_prefix(spark, sf_dir):
    t = _t(spark, sf_dir)
    entries = t["questions"].where("id % 7 = 0").select(F.col("id").alias("place"), F.expr("left(question_text, 9 + cast(id % 14 as int))").alias("key"), F.concat(F.lit("e"), F.col("id")).alias("explanation"))
    return study.match_prefix(t["questions"].select("id", "question_text"), entries)


def study_match_phrase(spark, sf_dir):
    t = _t(spark, sf_dir)
    return study.match_phrases(t["questions"].select("id", "question_text"), _phrases(spark))


def _phrases(spark):
    return spark.createDataFrame(PHRASES, "place long, phrase string, explanation string")


def study_match_many_phrases(spark, sf_dir):
    """Phrases out of every document, three of each, looked for in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 40").select("doc_id", "text")
    place = F.explode(F.array(*map(F.lit, range(3)))).alias("j")
    at = F.expr("cast(1 + (doc_id * 37 + j * 101) % (length(text) - 14) as int)")
    phrases = docs.select("doc_id", "text", place).select((F.col("doc_id") * 3 + F.col("j")).alias("place"), F.substring("text", at, F.lit(14)).alias("phrase"), F.concat_ws(":", F.lit("e"), "doc_id", "j").alias("explanation"))
    return study.match_phrases(docs.withColumnRenamed("doc_id", "id"), phrases, "text").select("id", "explanation")


def study_fill_phrase(spark, sf_dir):
    """Only questions that have no explanation yet are matched."""
    t = _t(spark, sf_dir)
    return study.match_phrases(t["questions"].select("id", "question_text", F.when(F.col("id") % 3 == 0, "old").alias("explanation")), _phrases(spark))


def study_code_marked(spark, sf_dir):
    """Questions as pages show them: escaped, code in every third set off from what is asked."""
    name = F.concat(F.col("p_name"), F.lit(" <b>"))
    given = F.when(F.col("p_partkey") % 3 == 0, F.concat(name, F.lit("\nclass A {\n    int x = 'y';\n}"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('x & "y"\n'), name))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", study.as_html(given).alias("page"))


def study_checked_answers(spark, sf_dir):
    """Typed answers, with blanks around some and other letter case in others, against the right ones."""
    t = _t(spark, sf_dir)
    right = F.col("correct_answer")
    given = F.when(F.col("id") % 3 == 0, F.concat(F.lit("  "), right, F.lit(" "))).when(F.col("id") % 3 == 1, F.lower(right)).otherwise(right)
    return t["questions"].select("id", given.alias("given"), study.answer_is_right(given, right).alias("is_right"))


def study_random_order(spark, sf_dir):
    """Each quiz's questions in an order drawn by seed, by hash of the id: the same on every run."""
    drawn = F.md5(F.concat_ws(":", "id", F.lit(17)))
    place = F.row_number().over(Window.partitionBy("quiz_id").orderBy(drawn, "id"))
    return _t(spark, sf_dir)["questions"].select("id", "quiz_id", place.alias("place"))


def study_integrity(spark, sf_dir):
    """Keys that repeat, and rows whose parent is missing, by table."""
    t = _t(spark, sf_dir)
    repeated = [df.groupBy("id").count().where("count > 1").agg(F.lit(n).alias("table_name"), F.lit("repeated id").alias("problem"), F.count("*").alias("n")) for n, df in t.items()]
    pairs = [("questions", "quiz_id", "quizzes"), ("study_sessions", "quiz_id", "quizzes"), ("session_answers", "question_id", "questions"), ("session_answers", "session_id", "study_sessions")]
    lost = [study.deleted(t[a], t[b], c, "id").agg(F.lit(a).alias("table_name"), F.lit(f"no {c}").alias("problem"), F.count("*").alias("n")) for a, c, b in pairs]
    out = repeated[0]
    for other in (*repeated[1:], *lost):
        out = out.unionByName(other)
    return out


def study_titles(spark, sf_dir):
    """Names tidied and classified as for files of quizzes, over part names."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    file = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_lock.txt"))
    return parts.select("p_partkey", study.title(file).alias("title"), study.topic(F.col("p_name"), F.array("p_type")).alias("topic"), study.tidy(F.concat(F.lit("  "), F.col("p_type"), F.lit(" \t x "))).alias("tidied"))


def study_parsed(spark, sf_dir):
    """Quiz files of two questions each, made of parts and parsed: true or false, numbers and choices, with and without a marked answer."""
    key = F.col("p_partkey")
    first = F.when(key % 3 == 0, "True\nFalse\nCorrect answer:\nFalse, Not Selected\nTrue").when(key % 3 == 1, F.concat(F.lit("Correct answer:\n"), key)).otherwise("Correct answer:\nLow, Not Selected\n\tHigh ")
    second = F.when(key % 2 == 0, "False\nTrue").otherwise("no answer")
    lines = ["Results for question 1.", "1", "1 / 1 point", F.col("p_name"), "  ", first, "Results for question 2.", "2", "0 / 1 point", F.col("p_type"), F.col("p_name"), second]
    text = F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))
    return study.parse(spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("file"), text.alias("text")))


QUERIES = {
    f.__name__: f
    for f in (
        study_quizzes, study_stats, study_stats_one, study_session_results, study_answers, study_complete_session, study_delete_cascade, study_insert_returning,
        study_update_explanations, study_match_prefix, study_match_phrase, study_match_many_phrases, study_fill_phrase, study_code_marked, study_checked_answers, study_random_order, study_integrity, study_titles, study_parsed,
    )
}

_ALL = f"WITH {ctes('quizzes', 'questions', 'session_answers', 'study_sessions')}"
_SCORES = """sc AS (
  SELECT session_id, count(*) AS total_questions, count(*) FILTER (is_correct) AS correct_answers,
         CAST(round(count(*) FILTER (is_correct) * CAST(100 AS DECIMAL(18, 0)) / count(*), 2) AS DECIMAL(5, 2)) AS score FROM session_answers GROUP BY session_id),
ss AS (SELECT s.*, sc.* EXCLUDE (session_id) FROM study_sessions s LEFT JOIN sc ON s.id = sc.session_id)"""
_STATS = """qs AS (
  SELECT q.id, q.name, q.topic, count(DISTINCT s.id) AS attempts, CAST(coalesce(avg(s.score), 0) AS DECIMAL(5, 2)) AS avg_score, coalesce(max(s.score), 0) AS best_score, coalesce(min(s.score), 0) AS worst_score
  FROM quizzes q LEFT JOIN ss s ON q.id = s.quiz_id AND s.is_completed GROUP BY q.id, q.name, q.topic)"""
_PHRASE = "CASE " + " ".join(f"WHEN contains(lower(question_text), '{p.lower()}') THEN '{e}'" for _, p, e in PHRASES) + " END"

ORACLE_SQL = {
    "study_quizzes": f"{_ALL} SELECT q.*, count(x.id) AS question_count FROM quizzes q LEFT JOIN questions x ON x.quiz_id = q.id GROUP BY ALL",
    "study_stats": f"{_ALL}, {_SCORES}, {_STATS} SELECT * EXCLUDE (topic) FROM qs",
    "study_stats_one": f"{_ALL}, {_SCORES}, {_STATS} SELECT * EXCLUDE (topic) FROM qs WHERE topic = 'topic_1' AND attempts > 0",
    "study_session_results": f"{_ALL}, {_SCORES} SELECT ss.*, q.name AS quiz_name, q.topic FROM ss JOIN quizzes q ON q.id = ss.quiz_id",
    "study_answers": f"""{_ALL} SELECT a.id, session_id, question_id, question_text, correct_answer, is_correct, CAST(row_number() OVER (PARTITION BY session_id ORDER BY answered_at, a.id) AS INT) AS place
      FROM session_answers a JOIN questions q ON q.id = a.question_id""",
    "study_complete_session": f"""{_ALL}, {_SCORES} SELECT id, quiz_id, is_completed, CASE WHEN is_completed THEN TIMESTAMP '{DONE}' END AS completed_at,
      CASE WHEN is_completed THEN coalesce(total_questions, 0) END AS total_questions, CASE WHEN is_completed THEN coalesce(correct_answers, 0) END AS correct_answers, CASE WHEN is_completed THEN score END AS score FROM ss""",
    "study_delete_cascade": f"""{_ALL}, lost AS (SELECT id FROM study_sessions WHERE quiz_id IN (SELECT id FROM quizzes WHERE id % 6 = 0))
      SELECT 'answers' AS table_name, count(*) AS n_rows, CAST(sum(id) AS BIGINT) AS id_sum FROM session_answers WHERE session_id NOT IN (SELECT id FROM lost)
      UNION ALL SELECT 'sessions', count(*), CAST(sum(id) AS BIGINT) FROM study_sessions WHERE quiz_id NOT IN (SELECT id FROM quizzes WHERE id % 6 = 0)
      UNION ALL SELECT 'questions', count(*), CAST(sum(id) AS BIGINT) FROM questions WHERE quiz_id NOT IN (SELECT id FROM quizzes WHERE id % 6 = 0)
      UNION ALL SELECT 'quizzes', count(*), CAST(sum(id) AS BIGINT) FROM quizzes WHERE id % 6 <> 0""",
    "study_insert_returning": f"""{_ALL} SELECT * FROM quizzes UNION ALL
      SELECT CAST((SELECT max(id) FROM quizzes) + row_number() OVER (ORDER BY 'Copy of ' || name) AS INT), 'Copy of ' || name, topic FROM quizzes WHERE id < 3""",
    "study_update_explanations": f"{_ALL} SELECT *, CASE WHEN id % 3 = 0 THEN 'new ' || correct_answer WHEN id % 4 = 0 THEN 'old' END AS explanation FROM questions",
    "study_match_prefix": f"""{_ALL}, e AS (SELECT id AS place, left(question_text, CAST(9 + id % 14 AS INT)) AS key, 'e' || id AS explanation FROM questions WHERE id % 7 = 0)
      SELECT q.id, q.question_text, arg_min(e.explanation, e.place) AS explanation FROM questions q JOIN e ON starts_with(q.question_text, e.key) OR starts_with(e.key, q.question_text) GROUP BY 1, 2""",
    "study_match_phrase": f"{_ALL} SELECT id, question_text, {_PHRASE} AS explanation FROM questions WHERE {_PHRASE} IS NOT NULL",
    "study_match_many_phrases": """WITH d AS (SELECT doc_id, text, lower(text) AS t FROM documents WHERE length(text) > 40),
      p AS (SELECT doc_id * 3 + j AS place, lower(substr(text, CAST(1 + (doc_id * 37 + j * 101) % (length(text) - 14) AS INT), 14)) AS phrase, 'e:' || doc_id || ':' || j AS explanation FROM d, range(3) AS r(j))
      SELECT doc_id AS id, arg_min(explanation, place) AS explanation FROM d JOIN p ON contains(t, phrase) GROUP BY doc_id""",
    "study_fill_phrase": f"{_ALL} SELECT id, question_text, {_PHRASE} AS explanation FROM questions WHERE id % 3 <> 0 AND {_PHRASE} IS NOT NULL",
    "study_code_marked": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '<p>' || p_name || ' &lt;b&gt;</p><pre><code>class A {' || chr(10) || '    int x = &#39;y&#39;;' || chr(10) || '}</code></pre>'
      WHEN 1 THEN 'x &amp; &#34;y&#34;<br>' || p_name || ' &lt;b&gt;' ELSE '' END AS page FROM part""",
    "study_checked_answers": f"""{_ALL}, g AS (SELECT id, correct_answer, CASE id % 3 WHEN 0 THEN '  ' || correct_answer || ' ' WHEN 1 THEN lower(correct_answer) ELSE correct_answer END AS given FROM questions)
      SELECT id, given, trim(given) = trim(correct_answer) AS is_right FROM g""",
    "study_random_order": f"{_ALL} SELECT id, quiz_id, CAST(row_number() OVER (PARTITION BY quiz_id ORDER BY md5(id || ':17'), id) AS INT) AS place FROM questions",
    "study_integrity": f"""{_ALL} SELECT 'quizzes' AS table_name, 'repeated id' AS problem, count(*) - count(DISTINCT id) AS n FROM quizzes
      UNION ALL SELECT 'questions', 'repeated id', count(*) - count(DISTINCT id) FROM questions UNION ALL SELECT 'session_answers', 'repeated id', count(*) - count(DISTINCT id) FROM session_answers
      UNION ALL SELECT 'study_sessions', 'repeated id', count(*) - count(DISTINCT id) FROM study_sessions
      UNION ALL SELECT 'questions', 'no quiz_id', count(*) FROM questions WHERE quiz_id NOT IN (SELECT id FROM quizzes) UNION ALL SELECT 'study_sessions', 'no quiz_id', count(*) FROM study_sessions WHERE quiz_id NOT IN (SELECT id FROM quizzes)
      UNION ALL SELECT 'session_answers', 'no question_id', count(*) FROM session_answers WHERE question_id NOT IN (SELECT id FROM questions)
      UNION ALL SELECT 'session_answers', 'no session_id', count(*) FROM session_answers WHERE session_id NOT IN (SELECT id FROM study_sessions)""",
    "study_parsed": """SELECT p_partkey AS file, CAST(1 AS INT) AS block, p_name AS question, CASE p_partkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN CAST(p_partkey AS VARCHAR) ELSE 'High' END AS correct_answer,
        CASE p_partkey % 3 WHEN 0 THEN 'boolean' WHEN 1 THEN 'numeric' ELSE 'choice' END AS question_type FROM part
      UNION ALL SELECT p_partkey, CAST(2 AS INT), p_type || chr(10) || p_name, 'False', 'boolean' FROM part WHERE p_partkey % 2 = 0""",
    "study_titles": r"""SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, '_', ' ') || ' lock', ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
      CASE WHEN contains(lower(p_name), 'thread') OR contains(lower(p_type), 'thread') THEN 'Threads & Concurrency' WHEN contains(lower(p_name), 'synchron') OR contains(lower(p_type), 'synchron') OR contains(lower(p_name), 'lock') THEN 'Synchronization'
           WHEN regexp_matches(lower(p_name), 'p2p|pastry|chord') THEN 'Distributed Systems' ELSE 'General' END AS topic,
      trim(regexp_replace('  ' || p_type || ' ' || chr(9) || ' x ', '\s+', ' ', 'g')) AS tidied FROM part""",
}
