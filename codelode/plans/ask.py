"""Questions to responses: classify, extract files, route, format. Models are columns that can be plugged in."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import hashed_embedding
from ..operators import retrieval
from ..operators.shared import settled
from .errors import InvalidQuestion
from .model_calls import Model, called

#: What a model is told before question and context.
PROMPT = "Answer from the code below, and say so if it is not enough.\n\nQuestion: "

#: Offline intent rule: a question about risk, safety or impact of a change.
RISK_WORDS = r"(?i)\brisk|\bimpact\b|\baffected\b|\bdangerous\b|\bbreak\b|\bsaf(e|est) to (modify|change|touch|refactor|edit)\b"


#: Characters by which forms of names are looked up in a question.
GRAM = 6


def classify(question: Column) -> Column:
    return F.when(question.rlike(RISK_WORDS), "risk_assessment").otherwise("code_explanation")


def extract_targets(questions: DataFrame, scope: DataFrame, class_files: DataFrame) -> DataFrame:
    """Adds target_files in order of first mention: a stem as it is or with .py, in any case (without its underscores only with .py), or a class name."""
    bare = F.expr("trim(LEADING '_' FROM stem)")
    forms = scope.select("stem", F.lower("stem").alias("form"), F.lit(False).alias("exact"))
    generic = scope.select("stem", F.concat(F.lower(bare), F.lit(".py")).alias("form"), F.lit(False).alias("exact"))
    named = class_files.join(scope.select("stem").hint("merge"), "stem", "left_semi").select("stem", F.col("class_name").alias("form"), F.lit(True).alias("exact"))
    underscored = forms.filter(F.col("form").startswith("_"))
    whole = scope.filter(~F.col("stem").startswith("_")).select("stem", F.concat(F.lower("stem"), F.lit(".py")).alias("form"), F.lit(False).alias("exact"))
    vocabulary = underscored.unionByName(generic).unionByName(whole).unionByName(named).distinct()
    # A form is met where its first characters are: places of the questions and forms are joined on these.
    keyed = vocabulary.filter("form <> ''").select("stem", "form", "exact", F.substring("form", 1, GRAM).alias("gram"))
    each = questions.select("question_id", F.explode(F.array(F.struct(F.lit(True).alias("exact"), F.col("question").alias("said")), F.struct(F.lit(False).alias("exact"), F.lower("question").alias("said")))).alias("q")).select("question_id", "q.*")
    places = each.filter("said <> ''").select("question_id", "exact", "said", F.explode(F.sequence(F.lit(1), F.length("said"))).alias("at"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("said") - F.col("at") + 1))).alias("size")
    places = places.select("*", sizes).select("question_id", "exact", "said", "at", F.substring("said", F.col("at"), F.col("size")).alias("gram"))
    # Both sides grow with their tables, and places are many more rows than questions suggest: neither is sent whole.
    met = places.join(keyed.hint("merge"), ["exact", "gram"]).filter(F.substring("said", F.col("at"), F.length("form")) == F.col("form"))
    first = met.groupBy("question_id", "stem").agg(F.min("at").alias("at"))
    listed = first.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "stem"))), lambda x: x["stem"]).alias("target_files"))
    return questions.join(listed, "question_id", "left").withColumn("target_files", F.coalesce("target_files", F.array().cast("array<string>")))


def known_unknown(df: DataFrame, names: str, known: Column) -> DataFrame:
    return df.withColumns({"known": F.array_intersect(names, known), "unknown": F.array_except(names, known)})


RESPONSE = "question_id, intent, answer, citations, risk_details"
#: What responses say of an answer, by column: its whole text. Digests or sizes instead are computed once a text.
WHOLE: dict[str, Callable[[Column], Column]] = {"answer": lambda text: text}


def _detail(risk: DataFrame) -> Column:
    """A file's scores as one value; scores without lists of dependents have none here either."""
    return F.struct(*(c for c in ("file", "dependents", "dependent_files", "commit_count", "risk_level", "rationale") if c in risk.columns))


def risk_responses(questions: DataFrame, risk: DataFrame, scope: DataFrame, told: dict[str, Callable[[Column], Column]] = WHOLE) -> DataFrame:
    """Responses to risk questions: ask back without a file, suggest if none is known, else a line a file and a note on unknown ones.

    Answers that end with all names of the scope are put together once for each way they begin, not once a question.
    """
    files = questions.select("question_id", F.posexplode("target_files").alias("at", "file"))
    line = F.concat("file", F.lit(".py: "), F.upper("risk_level"), F.lit(" risk -- "), "rationale")
    known = files.join(risk.hint("merge"), "file").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line"), _detail(risk).alias("d")))).alias("found"))
    odd = files.join(risk.select("file").hint("merge"), "file", "left_anti").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "file"))), lambda x: x["file"]).alias("odd"))
    wide = questions.join(known.hint("merge"), "question_id", "left").join(odd.hint("merge"), "question_id", "left")
    note = F.when(F.col("odd").isNotNull(), F.concat(F.lit("\n\nNote: not known: "), F.array_join("odd", ", "))).otherwise("")
    begins = (
        F.when(F.size("target_files") == 0, F.lit("Which file do you mean? Known are: "))
        .when(F.col("found").isNull(), F.concat(F.array_join("odd", ", "), F.lit(" isn't known. Known are: ")))
        .otherwise(F.concat(F.array_join(F.transform("found", lambda x: x["line"]), "\n\n"), note))
    )
    details = F.when(F.col("found").isNotNull(), F.transform("found", lambda x: x["d"]))
    held = settled(wide.select("question_id", begins.alias("begins"), (F.size("target_files") == 0).alias("asks"), details.alias("risk_details")), "responses")
    lists = F.col("asks") | F.col("risk_details").isNull()
    names = scope.agg(F.array_join(F.sort_array(F.collect_list("stem")), ", ").alias("names"))
    texts = held.filter(lists).select("begins").distinct().coalesce(1).hint("shuffle_replicate_nl").crossJoin(names)
    ends = texts.select("begins", *(say(F.concat("begins", "names")).alias(c) for c, say in told.items()))
    if told is not WHOLE:
        ends = settled(ends, "answers")
    asked = held.filter(lists).join(ends.hint("merge"), "begins").select("question_id", *told, "risk_details")
    plain = held.filter(~lists).select("question_id", *(say(F.col("begins")).alias(c) for c, say in told.items()), "risk_details")
    return asked.unionByName(plain).select("question_id", F.lit("risk_assessment").alias("intent"), *told, F.array().cast("array<string>").alias("citations"), "risk_details")


def outline(question: Column, context: Column) -> Column:
    """Offline answer: the headings of the context; without any, that the context isn't enough."""
    headings = F.regexp_extract_all(context, F.lit(r"(?m)^\[([^\]]+)\]$"), F.lit(1))
    return F.when(F.size(headings) > 0, F.concat(F.lit("Relevant code: "), F.array_join(headings, "; "))).otherwise("The code found is insufficient to answer this.")


def explanation_responses(questions: DataFrame, contexts: DataFrame, notes: DataFrame, generate: Callable[[Column, Column], Column] = outline) -> DataFrame:
    """Responses from context: (question_id, context, citations) and risk notes (question_id, risk_notes)."""
    wide = questions.join(contexts, "question_id", "left").join(notes, "question_id", "left")
    base = F.coalesce(generate(F.col("question"), F.coalesce("context", F.lit(""))), F.lit(""))
    more = F.coalesce(F.concat(F.lit("\n\nNote: "), F.array_join("risk_notes", "\n")), F.lit(""))
    return wide.select("question_id", F.lit("code_explanation").alias("intent"), F.concat(base, more).alias("answer"), F.coalesce("citations", F.array().cast("array<string>")).alias("citations"))


def routed(questions: DataFrame, classify: Callable[[Column], Column] = classify) -> tuple[DataFrame, DataFrame]:
    """Questions by branch, filtered before any model runs; an empty question is an error."""
    checked = questions.withColumn("question", F.when(F.length("question") > 0, F.col("question")).otherwise(F.raise_error(F.lit(f"{InvalidQuestion.code}: a question needs at least one character"))))
    with_intent = checked.withColumn("intent", F.coalesce(classify(F.col("question")), F.lit("code_explanation")))
    return with_intent.filter("intent = 'risk_assessment'"), with_intent.filter("intent <> 'risk_assessment'")


class CodeBase(NamedTuple):
    """What is known of a code base: its scope (stem, ord), risk scores, class files (class_name, stem), chunk index and call edges."""

    scope: DataFrame
    risk: DataFrame
    class_files: DataFrame
    index: DataFrame
    call_edges: DataFrame


def explain(questions: DataFrame, code: CodeBase, embed: Callable[[Column], Column] = hashed_embedding, generate: Callable[[Column, Column], Column] = outline, model: Model | None = None) -> DataFrame:
    """Responses to questions what code does, from retrieved and expanded chunks, with citations and the risk notes of the primaries' files.

    With a model its replies are the answers, and how its calls went is said besides: attempts, fell_back, error_code.
    """
    held = settled(retrieval.retrieve(questions, code.index, code.call_edges, embed), "retrieved")  # read four times below
    contexts = retrieval.context_text(retrieval.cited(held), "question_id")
    notes = retrieval.risk_notes(held.filter("section = 0"), code.risk, "question_id")
    details = held.filter("section = 0").select("question_id", F.replace(F.regexp_replace("file_path", r"\.py$", ""), F.lit("/"), F.lit(".")).alias("file")).distinct()
    found = details.join(code.risk.filter("risk_level = 'high'"), "file").groupBy("question_id").agg(F.array_sort(F.collect_list(_detail(code.risk))).alias("high"))
    calls = None
    if model is not None:
        prompt = F.concat(F.lit(PROMPT), F.col("question"), F.lit("\n\n"), F.coalesce("context", F.lit("")))
        asked = questions.join(contexts, "question_id", "left").select(F.col("question_id").alias("id"), prompt.alias("prompt"))
        calls = settled(called(asked, model), "calls").withColumnRenamed("id", "question_id")  # written, so that no call is made twice
        questions, generate = questions.join(calls.select("question_id", "reply"), "question_id"), lambda question, context: F.col("reply")
    out = explanation_responses(questions, contexts, notes, generate).join(found, "question_id", "left")
    out = out.select("question_id", "intent", "answer", "citations", F.coalesce("high", F.filter(F.array(F.lit(None).cast(found.schema["high"].dataType.elementType)), lambda x: x.isNotNull())).alias("risk_details"))
    return out if calls is None else out.join(calls.select("question_id", "attempts", "fell_back", "error_code"), "question_id")


def ask(questions: DataFrame, code: CodeBase, classify: Callable[[Column], Column] = classify, embed: Callable[[Column], Column] = hashed_embedding, generate: Callable[[Column, Column], Column] = outline, model: Model | None = None, told: dict[str, Callable[[Column], Column]] = WHOLE) -> DataFrame:
    """(question_id, intent, answer, citations, risk_details) of every question (question_id, question), with a model also (attempts, fell_back, error_code).

    Questions about risk are answered from the scores, others from retrieved code. ``risk_details`` is null if nothing
    was looked up and empty if the files that were looked at are at no high risk. ``told`` replaces the answer by columns
    made of it.
    """
    risky, other = routed(questions, classify)
    targeted = extract_targets(risky, code.scope, code.class_files)
    explained = explain(other, code, embed, generate, model)
    if told is not WHOLE:
        explained = explained.withColumns({c: say(F.col("answer")) for c, say in told.items()})
        explained = explained if "answer" in told else explained.drop("answer")
    return risk_responses(targeted, code.risk, code.scope, told).unionByName(explained, allowMissingColumns=True)
