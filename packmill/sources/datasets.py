"""Benchmark data sets and text files as DataFrames: id, dataset, context, question, ground_truth, category, gold_evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packmill.functions.texts import normalized, session_index

ITEM = "id string, dataset string, context string, question string, ground_truth string, category string, gold_evidence array<string>"
CATEGORIES = {1: "multi_hop", 2: "temporal", 3: "open_domain", 4: "single_hop", 5: "adversarial"}


def jsonl(spark: SparkSession, path: str, max_items: int | None = None) -> DataFrame:
    """One JSON object a line; a missing category is 'unknown', missing evidence none. max_items are the first lines."""
    rows = spark.read.schema(ITEM).json(path).withColumn("category", F.coalesce("category", F.lit("unknown"))).withColumn("gold_evidence", F.coalesce("gold_evidence", F.array().cast("array<string>")))
    return rows if max_items is None else rows.limit(max_items)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text) of whole files; the id is the file's name."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("document_id"), F.col("value").alias("text"))


_SAMPLE = "sample_id string, sessions array<struct<session: int, date: string, turns: array<struct<speaker: string, dia_id: string, text: string>>>>, qa array<struct<question: string, answer: string, category: int, evidence: array<string>>>"


def conversations_qa(samples: DataFrame, evidence_only: bool = True, exclude=(5,)) -> DataFrame:
    """Questions on conversations of dated sessions, as items.

    samples: sample_id, sessions (session, date, turns (speaker, dia_id, text)), qa (question, answer,
    category, evidence of dia_ids). Evidence lines carry their session's date, each once; without evidence
    the whole conversation is the context, unless evidence_only, which leaves such a question out.
    """
    qa = samples.select("sample_id", F.posexplode("qa").alias("no", "q")).select("sample_id", "no", "q.*").filter(~F.coalesce(F.col("category").isin(*exclude), F.lit(False)))
    turn = samples.select("sample_id", F.explode("sessions").alias("s")).select("sample_id", "s.session", normalized(F.col("s.date")).alias("date"), F.posexplode("s.turns").alias("at", "t"))
    turn = turn.select("sample_id", "session", "date", "at", F.coalesce(F.nullif(normalized(F.col("t.speaker")), F.lit("")), F.lit("unknown")).alias("speaker"), "t.dia_id", normalized(F.col("t.text")).alias("text")).filter("text <> ''")
    dated = turn.select("sample_id", "session", "date").distinct().select("sample_id", F.col("session").alias("own"), F.col("date").alias("own_date"))
    turn_date = turn.withColumn("own", F.coalesce(session_index(F.col("dia_id")), F.col("session"))).join(dated, ["sample_id", "own"], "left")
    line = F.when(F.coalesce("own_date", F.lit("")) != "", F.format_string("[%s] %s", "own_date", "text")).otherwise(F.col("text"))
    cited = qa.select("sample_id", "no", F.posexplode("evidence").alias("e_no", "dia_id")).join(turn_date.select("sample_id", "dia_id", "text", line.alias("line")), ["sample_id", "dia_id"])
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("e_no", c))), lambda s: s[c]))
    cited = cited.groupBy("sample_id", "no").agg(ordered("line").alias("lines"), ordered("text").alias("gold"))
    head = F.when(F.col("date") != "", F.format_string("[session %d — %s]", "session", "date")).otherwise(F.format_string("[session %d]", "session"))
    block = turn.groupBy("sample_id", "session", head.alias("head")).agg(F.array_sort(F.collect_list(F.struct("at", F.format_string("%s: %s", "speaker", "text").alias("l")))).alias("ls"))
    block = block.select("sample_id", "session", F.concat_ws("\n", F.col("head"), F.array_join(F.transform("ls", lambda s: s["l"]), "\n")).alias("b"))
    whole = block.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session", "b"))), lambda s: s["b"]), "\n\n").alias("whole"))
    out = qa.join(cited, ["sample_id", "no"], "left").join(whole, "sample_id", "left")
    context = F.array_join("lines", "\n") if evidence_only else F.col("whole")
    name = F.coalesce(*(F.when(F.col("category") == k, v) for k, v in CATEGORIES.items()), F.lit("unknown"))
    items = out.select(F.format_string("conversation-%s-q%04d", "sample_id", "no").alias("id"), F.lit("conversations").alias("dataset"), F.trim(context).alias("context"), normalized(F.col("question")).alias("question"), normalized(F.col("answer")).alias("ground_truth"), name.alias("category"), F.coalesce("gold", F.array().cast("array<string>")).alias("gold_evidence"))
    return items.filter("question <> '' and ground_truth <> '' and context <> ''")


def haystack_qa(entries: DataFrame, most_chars: int = 0) -> DataFrame:
    """Questions on haystacks of sessions, as items; gold is every turn of the answer's sessions.

    entries: question_id, question, answer, question_type, haystack_session_ids, answer_session_ids,
    haystack_sessions (arrays of (role, content)). most_chars cuts the context, 0 does not.
    """
    session = entries.select("question_id", F.posexplode("haystack_sessions").alias("no", "turns"), "haystack_session_ids", "answer_session_ids").withColumn("sid", F.try_element_at("haystack_session_ids", F.col("no") + 1))
    role = lambda t: F.coalesce(F.nullif(normalized(t["role"]), F.lit("")), F.lit("unknown"))
    said = F.filter("turns", lambda t: normalized(t["content"]) != "")
    block = F.concat_ws("\n", F.format_string("[session %d]", F.col("no") + 1), F.array_join(F.transform(said, lambda t: F.concat(role(t), F.lit(": "), normalized(t["content"]))), "\n"))
    per = session.select("question_id", "no", F.rtrim(block).alias("b"), F.array_position("answer_session_ids", F.col("sid")).alias("place"), F.transform(said, lambda t: normalized(t["content"])).alias("g"))
    joined = per.groupBy("question_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "b"))), lambda s: s["b"]), "\n").alias("context"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "no", "g")))), lambda s: s["g"])).alias("gold"),
    )
    context = F.substring("context", 1, most_chars) if most_chars > 0 else F.col("context")
    items = entries.select("question_id", "question", "answer", "question_type").join(joined, "question_id").select(F.concat(F.lit("haystack-"), "question_id").alias("id"), F.lit("haystack").alias("dataset"), context.alias("context"), normalized(F.col("question")).alias("question"), normalized(F.col("answer")).alias("ground_truth"), F.coalesce(F.nullif(normalized(F.col("question_type")), F.lit("")), F.lit("unknown")).alias("category"), F.col("gold").alias("gold_evidence"))
    return items.filter("id <> 'haystack-' and question <> '' and ground_truth <> '' and context <> ''")
