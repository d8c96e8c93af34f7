"""Chat exports as documents: one dispatch over JSON and JSONL files, user-typed text only.

Every parser takes files (file_id, content) and returns PARSED columns. A file is one row and stays one: its lines and nodes are
arrays inside the row, so nothing is shuffled. Lines that are no JSON objects are passed over; a file without typed text gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chats

PARSED = ["file_id", "doc_id", "source_type", "title", "date", "content", "session_id", "cwd", "typed"]
CODE_LINE = "struct<type:string,sessionId:string,cwd:string,timestamp:string,customTitle:string,message:struct<content:string>>"
CODE_BLOCKS = "struct<message:struct<content:array<struct<type:string,text:string>>>>"
#: By shape of a month history: the keys of the time, the prompt and the group of an entry, its source type, and how a title begins.
HISTORIES = {
    "code_history": ("timestamp", "display", "project", "code_history", "Code prompts"),
    "codex_history": ("ts", "text", "session_id", "codex_history", "Codex prompts"),
}
CODEX_LINE = "struct<type:string,timestamp:string,payload:struct<id:string,cwd:string,type:string,message:string>>"
PROJECT = "struct<name:string,uuid:string,prompt_template:string,description:string,created_at:string>"
ANCHOR_CHARS = 80


def anchor(text: Column) -> Column:
    """The first line, trimmed, at most ANCHOR_CHARS long, without full stops at its end."""
    return F.rtrim(F.substring(F.trim(F.substring_index(text, "\n", 1)), 1, ANCHOR_CHARS), F.lit("."))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def iso_day(ts: Column) -> Column:
    """The day of an ISO string or of epoch seconds or milliseconds (beyond 10^12), in UTC."""
    number = F.expr("NULL") if ts is None else ts.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")).otherwise(F.substring(ts, 1, 10))


def _first(values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(F.get(F.filter(values, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)), F.lit(""))


def _lines(files: DataFrame, kind: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.struct(F.trim(x).alias("raw"))), lambda x: x["raw"] != "")
    return files.select("file_id", F.transform(lines, lambda x: F.struct(x["raw"].alias("raw"), F.from_json(x["raw"], kind).alias("j"))).alias("lines"))


def _session(rows: DataFrame, source_type: str, label: str) -> DataFrame:
    """rows: file_id, session_id, cwd, custom (a title or empty) and typed (array of (order, place, text)) as documents."""
    rows = rows.withColumn("typed", F.array_sort("typed")).filter(F.size("typed") > 0)
    head = F.when(F.col("custom") != "", F.col("custom")).otherwise(anchor(F.col("typed")[0]["text"]))
    rows = rows.withColumns({"_head": head, "date": iso_day(F.col("typed")[0]["at"])})
    body = F.array_join(F.transform("typed", lambda t: t["text"]), "\n\n")
    content = F.concat_ws("\n\n", F.when(F.col("_head") != "", F.concat(F.lit("# "), "_head")), F.when(F.col("cwd") != "", F.concat(F.lit("cwd: "), "cwd")), body)
    short = F.substring(F.when(F.col("session_id") != "", F.col("session_id")).otherwise(F.col("file_id")), 1, 8)
    title = F.when(F.col("_head") != "", F.col("_head")).otherwise(F.concat(F.lit(f"{label} "), short))
    return rows.select(
        "file_id", F.col("file_id").alias("doc_id"), F.lit(source_type).alias("source_type"), title.alias("title"), "date",
        stripped(content).alias("content"), "session_id", "cwd", F.size("typed").alias("typed"),
    )


def code_sessions(files: DataFrame) -> DataFrame:
    """Typed prompts of assistant sessions: user lines whose content is a string, or the text blocks of a list (tool results are not typed)."""
    rows = _lines(files, CODE_LINE)

    def said(line: Column) -> Column:
        blocks = F.from_json(line["raw"], CODE_BLOCKS)["message"]["content"]
        texts = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: stripped(b["text"])), lambda t: t != "")
        return F.when(blocks.isNotNull(), F.array_join(texts, "\n\n")).otherwise(stripped(line["j"]["message"]["content"]))

    typed = F.transform("lines", lambda x, i: F.struct(F.coalesce(x["j"]["timestamp"].try_cast("double"), F.lit(0.0)).alias("order"), i.alias("place"), said(x).alias("text"), x["j"]["timestamp"].alias("at"), x["j"]["type"].alias("type")))
    typed = F.filter(typed, lambda t: (t["type"] == "user") & (t["text"] != ""))
    titles = F.filter(F.transform(F.filter("lines", lambda x: x["j"]["type"] == "custom-title"), lambda x: stripped(x["j"]["customTitle"])), lambda t: t != "")
    rows = rows.select(
        "file_id", _first(F.transform("lines", lambda x: x["j"]["sessionId"])).alias("session_id"), _first(F.transform("lines", lambda x: x["j"]["cwd"])).alias("cwd"),
        F.coalesce(F.get(F.reverse(titles), F.lit(0)), F.lit("")).alias("custom"), typed.alias("typed"),
    )
    return _session(rows, "code_session", "Code session")


def codex_sessions(files: DataFrame) -> DataFrame:
    """Typed prompts of another assistant's sessions: user_message events alone; prompts replayed with context are not typed."""
    rows = _lines(files, CODEX_LINE)
    typed = F.transform("lines", lambda x, i: F.struct(F.coalesce(x["j"]["timestamp"], F.lit("")).alias("order"), i.alias("place"), stripped(x["j"]["payload"]["message"]).alias("text"), x["j"]["timestamp"].alias("at"), F.concat_ws("/", x["j"]["type"], x["j"]["payload"]["type"]).alias("type")))
    typed = F.filter(typed, lambda t: (t["type"] == "event_msg/user_message") & (t["text"] != ""))
    meta = F.filter("lines", lambda x: x["j"]["type"] == "session_meta")
    rows = rows.select(
        "file_id", _first(F.transform(meta, lambda x: x["j"]["payload"]["id"])).alias("session_id"), _first(F.transform(meta, lambda x: x["j"]["payload"]["cwd"])).alias("cwd"),
        F.lit("").alias("custom"), typed.alias("typed"),
    )
    return _session(rows, "codex_session", "Codex session")


def web_projects(files: DataFrame) -> DataFrame:
    """Name, description and instructions of a project, those that are there."""
    rows = files.select("file_id", F.from_json("content", PROJECT).alias("p"))
    name, about, told = (stripped(F.col(f"p.{c}")) for c in ("name", "description", "prompt_template"))
    content = F.concat_ws(
        "\n\n", F.when(name != "", F.concat(F.lit("# Project: "), name)), F.when(about != "", F.concat(F.lit("Description: "), about)),
        F.when(told != "", F.concat(F.lit("Custom instructions:\n"), told)),
    )
    uuid = F.coalesce("p.uuid", F.lit(""))
    title = F.when(name != "", name).otherwise(F.concat(F.lit("Project "), F.substring(uuid, 1, 8)))
    return rows.select(
        "file_id", F.col("file_id").alias("doc_id"), F.lit("web_project").alias("source_type"), title.alias("title"), F.substring("p.created_at", 1, 10).alias("date"),
        content.alias("content"), uuid.alias("session_id"), F.lit("").alias("cwd"), F.lit(0).alias("typed"),
    ).filter("content <> ''")


def _conversations(rows: DataFrame, source_type: str, key: str) -> DataFrame:
    """Documents of files that hold many conversations."""
    short = F.substring(F.coalesce(key, F.lit("")), 1, 8)
    return rows.select(
        "file_id", F.concat("file_id", F.lit("::conv_"), short).alias("doc_id"), F.lit(source_type).alias("source_type"), anchor(F.regexp_replace("text", "^# ", "")).alias("title"),
        F.coalesce("date", F.lit("")).alias("date"), F.col("text").alias("content"), F.coalesce(key, F.lit("")).alias("session_id"), F.lit("").alias("cwd"), F.lit(0).alias("typed"),
    )


def month_key(ts: Column) -> Column:
    """yyyy-MM of epoch seconds or milliseconds (beyond 10^12), in UTC, or the first seven characters of another string; else `unknown`. No time is 0."""
    ts = F.coalesce(ts, F.lit("0"))
    number = ts.try_cast("double")
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    numbered = F.when(F.abs(seconds) < 2e11, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")).otherwise("unknown")
    return F.when(number.isNotNull(), numbered).when(F.length(ts) >= 7, F.substring(ts, 1, 7)).otherwise("unknown")


def histories(files: DataFrame, shape: str) -> DataFrame:
    """The typed prompts of a history across sessions: one document a month, prompts by time, each after its project or session in brackets."""
    at, said, group, source_type, label = HISTORIES[shape]
    rows = _lines(files, f"struct<{at}:string,{said}:string,{group}:string>")
    own = F.transform("lines", lambda x, i: F.struct(
        F.coalesce(x["j"][at].try_cast("double"), F.lit(0.0)).alias("order"), i.alias("place"), month_key(x["j"][at]).alias("month"), x["j"][at].alias("at"),
        F.coalesce(F.nullif(x["j"][group], F.lit("")), F.lit("_unknown")).alias("group"), stripped(x["j"][said]).alias("text"),
    ))
    rows = rows.select("file_id", F.array_sort(F.filter(own, lambda t: t["text"] != "")).alias("typed"))
    months = rows.select("file_id", "typed", F.explode(F.array_sort(F.array_distinct(F.transform("typed", lambda t: t["month"])))).alias("month"))
    mine = F.filter("typed", lambda t: t["month"] == F.col("month"))
    inside = lambda t: F.concat(F.lit("["), t["group"], F.lit("] ")) if shape == "code_history" else F.concat(F.lit("[session "), F.substring(t["group"], 1, 8), F.lit("] "))
    months = months.select("file_id", "month", mine.alias("typed")).withColumn("body", F.array_join(F.transform("typed", lambda t: F.concat(inside(t), t["text"])), "\n\n"))
    title = F.concat(F.lit(f"{label} "), "month")
    return months.select(
        "file_id", F.concat("file_id", F.lit("::month_"), "month").alias("doc_id"), F.lit(source_type).alias("source_type"), title.alias("title"), iso_day(F.col("typed")[0]["at"]).alias("date"),
        F.concat(F.lit("# "), F.lit(label), F.lit(" \u2014 "), "month", F.lit("\n\n"), "body").alias("content"), F.lit("").alias("session_id"), F.lit("").alias("cwd"), F.size("typed").alias("typed"),
    )


def journals(files: DataFrame) -> DataFrame:
    """One document for each entry of a journal."""
    rows = chats.journal(files.select("file_id", "content"))
    return rows.select(
        "file_id", F.col("entry_id").alias("doc_id"), F.lit("journal").alias("source_type"), F.concat_ws(" ", F.lit("Journal"), "date").alias("title"), "date", F.col("text").alias("content"),
        F.coalesce("uuid", F.lit("")).alias("session_id"), F.lit("").alias("cwd"), F.lit(0).alias("typed"),
    )


def kind(content: Column, suffix: Column) -> Column:
    """The known shape of a file: of a .jsonl by its first line that is not blank; null if it has none."""
    first = F.get(F.filter(F.split(content, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    plain = F.regexp_replace(content, r",\s*([}\]])", "$1")  # journals may have commas before closing brackets
    return F.when(suffix == ".jsonl", chats.shape(first, chats.JSONL_SHAPES)).otherwise(F.coalesce(chats.shape(content, chats.JSON_SHAPES), chats.shape(plain, chats.JSON_SHAPES)))


#: How each known shape becomes documents.
PARSERS = {
    "code_session": code_sessions,
    "codex_session": codex_sessions,
    "code_history": lambda files: histories(files, "code_history"),
    "codex_history": lambda files: histories(files, "codex_history"),
    "web_project": web_projects,
    "web_conversations": lambda files: _conversations(chats.web_conversations(files, keep="file_id"), "web_conversation", "uuid"),
    "chatgpt": lambda files: _conversations(chats.chatgpt(files, keep="file_id"), "chatgpt_conversation", "conversation_id"),
    "dayone": journals,
}


def parsed(files: DataFrame) -> DataFrame:
    """Documents of files (file_id, suffix, content, and _kind where it is known already) of every known shape; files of no known shape give none."""
    if "_kind" not in files.columns:
        files = files.withColumn("_kind", kind(F.col("content"), F.col("suffix")))
    return reduce(DataFrame.unionByName, (parser(files.filter(F.col("_kind") == name)).select(*PARSED) for name, parser in PARSERS.items()))
