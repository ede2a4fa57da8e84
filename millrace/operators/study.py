"""Study sessions: quizzes, answers, statistics, and changes to tables as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored as kept
from .numbering import numbered
from .phrases import HEAD, first_ranks, with_hashes

SCORE = "decimal(5,2)"

# fixed values: marks of quiz files, what answers look like, topics by keyword (in names or questions; in names only), and how code begins
SPLIT = r"Results for question \d+\."
POINTS = r"^\d+\s*/\s*\d+\s*point"
ANSWER, NOT_CHOSEN = "Correct answer:", ", Not Selected"
TRUTHS, CHOICES = ("True", "False"), ("High", "Low")
TOPICS = (("thread", "Threads & Concurrency"), ("synchron", "Synchronization"))
NAME_TOPICS = (("lock", "Synchronization"), ("p2p", "Distributed Systems"), ("pastry", "Distributed Systems"), ("chord", "Distributed Systems"))
CODE = r"(^|\n)([ \t]{4,}|(public|private|protected|class|interface|void|int|String|byte\[\])).*"


def quizzes_with_counts(quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    """Every quiz with its number of questions, zero too."""
    counted = questions.groupBy("quiz_id").agg(F.count("id").alias("question_count"))
    return quizzes.join(counted, quizzes["id"] == counted["quiz_id"], "left").select(quizzes["*"], F.coalesce("question_count", F.lit(0)).alias("question_count"))


def sessions_with_quiz(sessions: DataFrame, quizzes: DataFrame) -> DataFrame:
    names = quizzes.select(F.col("id").alias("quiz_id"), F.col("name").alias("quiz_name"), "topic")
    return sessions.join(names, "quiz_id")


def answers_in_order(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with their questions; ``place`` is their order in the session."""
    asked = questions.select(F.col("id").alias("question_id"), "question_text", "correct_answer")
    order = Window.partitionBy("session_id").orderBy("answered_at", "id")
    return answers.join(asked, "question_id").withColumn("place", F.row_number().over(order))


def session_scores(answers: DataFrame) -> DataFrame:
    """Answers, right ones and score in percent of each session, in one pass."""
    right = F.count_if("is_correct")
    return answers.groupBy("session_id").agg(
        F.count("*").alias("total_questions"), right.alias("correct_answers"), (right.cast("decimal(20,0)") * 100 / F.count("*")).cast(SCORE).alias("score")
    )


def completed(sessions: DataFrame, answers: DataFrame, at: Column, which: Column | None = None) -> DataFrame:
    """``sessions`` with totals filled in for those that ``which`` picks; a session without answers gets null and zero ones."""
    chosen = F.lit(True) if which is None else which
    scored = sessions.join(session_scores(answers), sessions["id"] == F.col("session_id"), "left").drop("session_id")
    return scored.withColumns(
        {
            "completed_at": F.when(chosen, at),
            "total_questions": F.when(chosen, F.coalesce("total_questions", F.lit(0))),
            "correct_answers": F.when(chosen, F.coalesce("correct_answers", F.lit(0))),
            "score": F.when(chosen, F.col("score")),
        }
    )


def quiz_stats(quizzes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Attempts and scores of completed sessions for every quiz; zeros where there are none."""
    done = sessions.where("is_completed").groupBy("quiz_id").agg(
        F.count_distinct("id").alias("attempts"), F.avg("score").alias("avg"), F.max("score").alias("best"), F.min("score").alias("worst")
    )
    joined = quizzes.join(done, quizzes["id"] == done["quiz_id"], "left")
    zero = F.lit(0).cast(SCORE)
    return joined.select(
        quizzes["id"],
        quizzes["name"],
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.coalesce(F.col("avg").cast(SCORE), zero).alias("avg_score"),
        F.coalesce("best", zero).alias("best_score"),
        F.coalesce("worst", zero).alias("worst_score"),
    )


def attempted(stats: DataFrame) -> DataFrame:
    """The inner form: quizzes with at least one completed session."""
    return stats.where("attempts > 0")


# Rows taken out, added and changed: a new table each time


def deleted(table: DataFrame, keys: DataFrame, on: str, key: str) -> DataFrame:
    return table.join(keys.select(F.col(key).alias("_k")), F.col(on) == F.col("_k"), "left_anti")


def delete_quiz(quizzes: DataFrame, questions: DataFrame, sessions: DataFrame, answers: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All four tables without the quizzes in ``gone(id)`` and whatever hangs on them."""
    lost = sessions.join(gone.select(F.col("id").alias("quiz_id")), "quiz_id", "left_semi")
    return {
        "answers": deleted(answers, lost, "session_id", "id"),
        "sessions": deleted(sessions, gone, "quiz_id", "id"),
        "questions": deleted(questions, gone, "quiz_id", "id"),
        "quizzes": deleted(quizzes, gone, "id", "id"),
    }


def inserted(table: DataFrame, rows: DataFrame, key: str = "id", order: str = "name") -> DataFrame:
    """``table`` with ``rows`` added under new keys, counted on from its largest."""
    top = table.agg(F.max(key)).first()[0] or 0
    added = numbered(rows.drop(key), [order], key, first=top + 1)
    return table.unionByName(added.withColumn(key, F.col(key).cast(table.schema[key].dataType)), allowMissingColumns=True)


def updated(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``table`` with ``column`` taken from ``changes(key, column)`` where they have one."""
    new = changes.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return table.join(new, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


# Texts matched to explanations


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def match_prefix(questions: DataFrame, entries: DataFrame, text: str = "question_text") -> DataFrame:
    """The first entry ``(place, key, explanation)`` that a text begins with, or that begins with it.

    Of entries with one key, and of those that go on from one beginning, only
    the first is joined.  A text is cut to each length that keys have, a key to
    each that texts have, so rows are at most texts times lengths of keys and
    keys times lengths of texts, however many agree.  Of entries of one place
    the smallest explanation counts; equal rows of ``questions`` are told once.
    Empty texts and keys match nothing.
    """
    q = questions.withColumn("_t", tidy(F.col(text))).withColumn("_n", F.char_length("_t")).where("_n > 0")
    e = entries.select(tidy(F.col("key")).alias("_k"), F.struct("place", "explanation").alias("_e")).where("_k <> ''").groupBy("_k").agg(F.min("_e").alias("_e"))
    e = e.withColumn("_m", F.char_length("_k"))

    def prefixes(df: DataFrame, text: str, lengths: DataFrame, fits: str) -> DataFrame:
        return df.join(F.broadcast(lengths), F.expr(fits)).withColumn("_p", F.expr(f"left({text}, _l)"))

    told = [*questions.columns, "_e"]
    keys = e.select(F.col("_k").alias("_p"), "_e")
    down = prefixes(q, "_t", e.select(F.col("_m").alias("_l")).distinct(), "_l <= _n").join(keys, "_p").select(told)
    cut_keys = prefixes(e, "_k", q.select(F.col("_n").alias("_l")).distinct(), "_l < _m").groupBy("_p").agg(F.min("_e").alias("_e"))
    up = q.withColumn("_p", F.col("_t")).join(cut_keys, "_p").select(told)
    first = down.unionByName(up).groupBy(*questions.columns).agg(F.min("_e").alias("_e"))
    return first.select(*questions.columns, "_e.explanation")


def match_phrases(texts: DataFrame, phrases: DataFrame, text: str = "question_text", head: int = HEAD) -> DataFrame:
    """Of ``phrases(place, phrase, explanation)`` the first by place that each text holds, letter case aside.

    ``texts`` has a row for each ``id``; only rows whose explanation, if they
    have that column, is null are matched, and those without a match are left
    out.  Texts are looked through once for each different length of phrases;
    each stretch of one meets at most the phrase it equals.  Empty and null
    phrases and texts match nothing; of phrases of one place the smallest
    explanation counts.
    """
    if "explanation" in texts.columns:
        texts = texts.where("explanation is null").drop("explanation")
    wanted = phrases.select(F.lower("phrase").alias("phrase"), F.struct("place", "explanation").alias("_e")).where("phrase <> ''").groupBy("phrase").agg(F.min("_e").alias("_e"))
    wanted = kept(with_hashes(numbered(wanted.select("phrase", "_e.*"), ["place", "explanation", "phrase"], "rank"), "phrase"))
    ranks = first_ranks(texts.select("id", F.lower(text).alias("text")), wanted, head)
    first = ranks.join(wanted.select("rank", "explanation"), "rank").select("id", "explanation")
    return texts.join(first.where("explanation is not null"), "id").select(*texts.columns, "explanation")


# Quiz files


def parse(texts: DataFrame, strict: bool = False) -> DataFrame:
    """``texts(file, text)`` to ``(file, block, question, correct_answer, question_type)``.

    Lines are trimmed and empty ones dropped; a number followed by a line of
    points is dropped with it.  The question ends at the first True, False or
    answer mark.  The answer is the first line after the mark that isn't marked
    as not selected, or, before a mark, the True or False that ended the
    question.  ``strict`` leaves out blocks that hold an option marked
    incorrect, where the first option would be taken for the truth.
    """

    def once(df: DataFrame, value: Column, name: str) -> DataFrame:
        """A column exploded from an array of one: filters that use it aren't moved to where it would be computed again, for each line."""
        return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))

    blocks = texts.select("file", F.posexplode(F.split("text", SPLIT)).alias("block", "body"))
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    listed = once(blocks, lines, "ls").drop("body")
    kept = F.filter(
        F.transform("ls", lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get("ls", i + 1), F.lit("")).alias("next"), F.when(i > 0, F.get("ls", i - 1)).otherwise("").alias("prior"))),
        lambda x: ~((x["line"].rlike(r"^\d+$") & x["next"].rlike(POINTS)) | (x["line"].rlike(POINTS) & x["prior"].rlike(r"^\d+$"))),
    )
    listed = once(listed, F.transform(kept, lambda x: x["line"]), "ls")
    marks = F.transform("ls", lambda x: x.isin(*TRUTHS) | x.startswith(ANSWER))
    listed = once(listed, F.array_position(marks, True), "ends").where("ends > 1")
    told = F.array_position(F.transform("ls", lambda x: x.startswith(ANSWER)), True)
    options = F.filter(F.slice("ls", F.col("told") + 1, F.size("ls")), lambda x: ~F.contains(x, F.lit(NOT_CHOSEN)))
    found = F.when(F.col("told") > 0, F.get(options, 0))
    ended = F.get("ls", (F.col("ends") - 1).cast("int"))
    answer = F.coalesce(found, F.when(ended.isin(*TRUTHS), ended))
    listed = once(once(listed, told.cast("int"), "told"), answer, "correct_answer").where("correct_answer is not null")
    if strict:
        listed = listed.where(~F.exists("ls", lambda x: F.lower(x).startswith("incorrect answer")))
    kind = F.when(F.col("correct_answer").rlike(r"^\d+$"), "numeric").when(F.col("correct_answer").isin(*CHOICES), "choice").otherwise("boolean")
    question = F.array_join(F.slice("ls", F.lit(1), F.col("ends").cast("int") - 1), "\n")
    return listed.select("file", "block", question.alias("question"), "correct_answer", kind.alias("question_type"))


def title(file: Column) -> Column:
    """A file's name without its suffix, underscores as spaces, words capitalised."""
    return F.initcap(F.replace(F.regexp_replace(file, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))


def topic(name: Column, first_questions: Column, wide: bool = True) -> Column:
    """By keyword in the name or the first three questions, first match; ``wide`` knows two more keywords, in names only."""
    name = F.lower(name)

    def told(word: str) -> Column:
        return F.contains(name, F.lit(word)) | F.exists(F.slice(first_questions, 1, 3), lambda q: F.contains(F.lower(q), F.lit(word)))

    out = F.lit("General")
    for word, label in reversed(NAME_TOPICS if wide else ()):
        out = F.when(F.contains(name, F.lit(word)), label).otherwise(out)
    for word, label in reversed(TOPICS):
        out = F.when(told(word), label).otherwise(out)
    return out


def answer_is_right(given: Column, correct: Column) -> Column:
    return F.trim(given) == F.trim(correct)


def looks_like_code(text: Column) -> Column:
    return (F.size(F.split(text, "\n")) > 3) & text.rlike(CODE)


def as_html(text: Column) -> Column:
    """Text escaped; code, from its first code-like line on, set off from the description before it."""
    safe = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    at = F.regexp_instr(safe, F.lit(CODE))
    described = F.trim(F.replace(F.substring(safe, F.lit(1), at - 1), F.lit("\n"), F.lit(" ")))
    code = F.regexp_replace(F.substring(safe, at, F.char_length(safe)), "^\n", "")
    lead = F.when(described != "", F.concat(F.lit("<p>"), described, F.lit("</p>"))).otherwise("")
    block = F.concat(lead, F.lit("<pre><code>"), code, F.lit("</code></pre>"))
    return F.coalesce(F.when(looks_like_code(text), block).otherwise(F.replace(safe, F.lit("\n"), F.lit("<br>"))), F.lit(""))
