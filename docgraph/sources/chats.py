"""Chat and journal exports: shape detection and user turns, by JSON functions of Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import epoch_timestamp

#: Required keys of each known shape, in the order they are tried.
JSON_SHAPES = (
    ("web_conversations", ("uuid", "name", "chat_messages")),
    ("web_project", ("name", "prompt_template", "description")),
    ("chatgpt", ("title", "mapping")),
    ("dayone", ("entries",)),
)
JSONL_SHAPES = (("code_session", ("type", "sessionId")), ("code_history", ("display", "project")), ("codex_session", ("timestamp", "type", "payload")), ("codex_history", ("session_id", "text", "ts")))
MESSAGES = "array<struct<uuid:string,name:string,summary:string,created_at:string,chat_messages:array<struct<sender:string,content:array<struct<type:string,text:string>>,text:string,created_at:string>>>>"
MAPPING = "array<struct<title:string,conversation_id:string,create_time:double,mapping:map<string,struct<message:struct<author:struct<role:string>,content:struct<content_type:string,parts:array<string>>,create_time:double>>>>>"
JOURNAL = "struct<entries:array<struct<uuid:string,text:string,creationDate:string,timeZone:string,tags:array<string>,location:struct<localityName:string,country:string>>>>"


def shape(json: Column, shapes: tuple = JSON_SHAPES) -> Column:
    """The name of the first shape whose keys a JSON object (or the first of an array) has, else null."""
    first = F.when(F.ltrim(json).startswith("["), F.get_json_object(json, "$[0]")).otherwise(json)
    keys = F.json_object_keys(first)
    found = F.lit(None).cast("string")
    for name, required in reversed(shapes):
        found = F.when(F.size(F.array_except(F.array(*map(F.lit, required)), keys)) == 0, name).otherwise(found)
    return found


def web_conversations(df: DataFrame, json: str = "content", keep: str | None = None) -> DataFrame:
    """uuid, date and text of each conversation with human turns: title, summary, then the turns; and column keep of df."""
    kept = [keep] if keep else []
    rows = df.select(*kept, F.explode(F.from_json(json, MESSAGES)).alias("c")).select(*kept, "c.*")
    human = F.filter("chat_messages", lambda m: m["sender"] == "human")
    typed = lambda m: F.array_join(F.transform(F.filter(m["content"], lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    turns = F.transform(human, lambda m: F.trim(F.coalesce(F.nullif(typed(m), F.lit("")), m["text"], F.lit(""))))
    turns = F.filter(turns, lambda t: t != "")
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), F.nullif(F.col("name"), F.lit(""))), F.concat(F.lit("Summary: "), F.nullif(F.col("summary"), F.lit(""))), F.nullif(F.array_join(turns, "\n\n"), F.lit("")))
    return rows.select(*kept, "uuid", F.substring("created_at", 1, 10).alias("date"), text.alias("text")).filter("text <> ''")


def chatgpt(df: DataFrame, json: str = "content", keep: str | None = None) -> DataFrame:
    """conversation_id, date and the user's messages by time, after the title if there is one; and column keep of df."""
    kept = [keep] if keep else []
    rows = df.select(*kept, F.explode(F.from_json(json, MAPPING)).alias("c")).select(*kept, "c.*")
    said = F.filter(F.map_values("mapping"), lambda n: (n["message"]["author"]["role"] == "user") & (n["message"]["content"]["content_type"] == "text"))
    parts = lambda n: F.transform(n["message"]["content"]["parts"], lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    body = lambda n: F.array_join(F.filter(parts(n), lambda t: t != ""), "\n\n")
    timed = F.array_sort(F.transform(said, lambda n: F.struct(F.coalesce(n["message"]["create_time"], F.lit(0.0)).alias("t"), body(n).alias("b"))))
    body = F.nullif(F.array_join(F.filter(F.transform(timed, lambda x: x["b"]), lambda t: t != ""), "\n\n"), F.lit(""))
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), F.nullif(F.trim("title"), F.lit(""))), body)
    return rows.select(*kept, "conversation_id", F.date_format(F.timestamp_seconds("create_time"), "yyyy-MM-dd").alias("date"), text.alias("text")).filter("text <> ''")


def month_histories(df: DataFrame, ts: str, text: str, order: list[str], group: str | None = None) -> DataFrame:
    """Entries of a history by month: month, entries, distinct sorted groups and the texts in order."""
    when = epoch_timestamp(F.col(ts)) if dict(df.dtypes)[ts] in ("bigint", "int", "double") else F.col(ts)
    rows = df.withColumn("month", F.date_format(when, "yyyy-MM"))
    aggs = [F.count("*").alias("entries"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda x: x["_t"]), "\n").alias("text")]
    if group:
        aggs.append(F.array_join(F.sort_array(F.collect_set(group)), ",").alias("groups"))
    return rows.groupBy("month").agg(*aggs)


def user_turns(df: DataFrame, conversation: str, turn: str, role: str, text: str, who: str = "user") -> DataFrame:
    """The turns of one role of each conversation, in order, a blank line between; a conversation without any is dropped."""
    kept = df.filter((F.col(role) == who) & (F.trim(text) != ""))
    listed = F.sort_array(F.collect_list(F.struct(turn, F.trim(text).alias("_t"))))
    return kept.groupBy(conversation).agg(F.count("*").alias("turns"), F.array_join(F.transform(listed, lambda x: x["_t"]), "\n\n").alias("text"))


def journal(df: DataFrame, file_id: str = "file_id", json: str = "content") -> DataFrame:
    """Entries of a journal by destination: the newest year and undated entries keep the file, older years get -YYYY before
    its extension; entries of a destination are numbered. Commas before a closing bracket are passed over."""
    plain = F.regexp_replace(json, r",\s*([}\]])", "$1")
    rows = df.select(file_id, F.posexplode(F.from_json(plain, JOURNAL)["entries"]).alias("pos", "e")).select(file_id, "pos", "e.*")
    utc = F.try_to_timestamp("creationDate")
    local = F.coalesce(F.to_date(F.from_utc_timestamp(utc, F.coalesce("timeZone", F.lit("UTC")))).cast("string"), F.substring("creationDate", 1, 10))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\\([^\\])", "$1"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    rows = rows.withColumns({"date": local, "text": clean}).filter("text <> ''")
    return destinations(rows.withColumn("year", F.substring("date", 1, 4)), file_id, "year", ["pos"])


def destinations(rows: DataFrame, file_id: str, year: str, order: list[str]) -> DataFrame:
    newest = F.max(F.col(year)).over(Window.partitionBy(file_id))
    older = F.regexp_replace(F.col(file_id), r"(\.[^.:/]+)?$", F.concat(F.lit("-"), F.col(year), F.lit("$1")))
    rows = rows.withColumn("_newest", newest)
    rows = rows.withColumn("destination", F.when(F.col(year).isNull() | (F.col(year) == F.col("_newest")), F.col(file_id)).otherwise(F.regexp_replace(older, r"(-\d{4}(\.[^.:/]+)?)-\d{4}(\.[^.:/]+)?$", "$1"))).drop("_newest")
    n = F.row_number().over(Window.partitionBy("destination").orderBy(F.asc_nulls_last(year), *order)) - 1
    return rows.withColumn("entry_id", F.concat(F.col("destination"), F.lit("::entry_"), F.format_string("%03d", n)))


def usual_place(rows: DataFrame, date: str, place: str, days: int = 90) -> DataFrame:
    """One row: the place of most entries in the last days; of equal ones the least."""
    latest = rows.agg(F.max(F.to_date(date)).alias("m"))
    recent = rows.withColumn("_m", latest.scalar()).filter(F.to_date(date) >= F.date_sub("_m", days)).filter(F.col(place).isNotNull())
    return recent.groupBy(place).agg(F.count("*").alias("n")).orderBy(F.desc("n"), place).limit(1)
