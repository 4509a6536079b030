"""Memory texts, edit operations, replay and running ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.functions.text import SPACE, strip
from convoeval.operators.ordered import joined_text

# Edit verbs and the pattern of one memory line.
VERBS = ["ADD", "UPDATE", "DELETE", "TOUCH"]
ITEM = r"^\[([^\]]+)\]\[mentioned at ([^\]]+)\]\s*(.*?)(?:\s*\[([^\]]*)\])?$"
ITEM_BODY = r"(?s)\[([^\]]+)\]\[mentioned at ([^\]]+)\] ([^\[\]]*?)(?=\s*\[|$)"


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def parse_items(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One item per matching line: id, date, content and links."""
    rows = df.select(*keys, F.posexplode(_lines(F.col(text))).alias("line_no", "_l")).where(F.col("_l").rlike(ITEM))

    def group(i: int) -> Column:
        return F.regexp_extract("_l", ITEM, i)

    return rows.select(
        *keys, "line_no", group(1).alias("memory_id"), group(2).alias("mentioned_at"),
        strip(group(3)).alias("content"), group(4).alias("links"),
    ).where("memory_id <> '' AND content <> ''")


def parse_items_multiline(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Items whose content may run over lines, up to the next bracket."""
    found = F.regexp_extract_all(text, F.lit(ITEM_BODY), F.lit(0))
    rows = df.select(*keys, F.posexplode(found).alias("item_no", "_m"))
    parts = r"(?s)^\[([^\]]+)\]\[mentioned at ([^\]]+)\] (.*)$"
    return rows.select(
        *keys, "item_no", F.regexp_extract("_m", parts, 1).alias("memory_id"),
        F.regexp_extract("_m", parts, 2).alias("mentioned_at"),
        strip(F.regexp_extract("_m", parts, 3)).alias("content"),
    ).where("content <> ''")


def item_line(memory_id: Column, mentioned_at: Column, content: Column, links: Column) -> Column:
    return F.concat(
        F.lit("["), memory_id, F.lit("][mentioned at "), mentioned_at, F.lit("] "), content,
        F.lit(" ["), F.coalesce(links, F.lit("")), F.lit("]"),
    )


def format_items(items: DataFrame, keys: list[str], order: str, part_rows: int = 10_000) -> DataFrame:
    """Items of a key as text lines in order, in parts of bounded size."""
    line = item_line(F.col("memory_id"), F.col("mentioned_at"), F.col("content"), F.col("links"))
    return joined_text(items, keys, order, line, "\n", part_rows)


def stamp_lines(df: DataFrame, keys: list[str], text: str, date: str) -> DataFrame:
    """Id and date for every non-blank line; the id is a hash of key and place."""
    rows = df.select(*keys, date, F.posexplode(_lines(F.col(text))).alias("line_no", "content"))
    stamp = F.left(F.md5(F.concat_ws("|", *keys, "line_no")), F.lit(8))
    return rows.where("content <> ''").select(
        *keys, "line_no", stamp.alias("memory_id"), F.col(date).alias("mentioned_at"), "content", F.lit("").alias("links")
    )


def sections(text: Column, headers: dict[str, str]) -> Column:
    """Map of section name to its lines; ``headers`` maps a header text to a name.

    A line that starts with ``**`` and holds a header opens its section, other
    ``**...**`` lines are skipped. Parsed inside the row: the text is cut at the
    headers, then pieces of the same section are joined.
    """
    known = "|".join(headers)
    flat = F.array_join(F.filter(_lines(text), lambda x: x != ""), "\n")
    piece = rf"(?im)^\*\*.*?(?:{known}).*$[\s\S]*?(?=\n\*\*.*(?:{known})|\z)"
    pieces = F.regexp_extract_all(flat, F.lit(piece), F.lit(0))

    def name(p: Column) -> Column:
        head = F.upper(F.substring_index(p, "\n", 1))
        out = F.lit(None).cast("string")
        for header, section in reversed(headers.items()):
            out = F.when(F.contains(head, F.lit(header)), section).otherwise(out)
        return out

    def body(p: Column) -> Column:
        lines = F.split(p, "\n")
        kept = F.filter(
            F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
            lambda x: ~(x.startswith("**") & x.endswith("**")),
        )
        return F.array_join(kept, "\n")

    named = F.transform(pieces, lambda p: F.struct(name(p).alias("n"), body(p).alias("b")))

    def of(section: str) -> Column:
        mine = F.filter(named, lambda s: (s["n"] == section) & (s["b"] != ""))
        return F.array_join(F.transform(mine, lambda s: s["b"]), "\n")

    return F.create_map(*[c for n in headers.values() for c in (F.lit(n), of(n))])


SECTION_HEADERS = {
    "ACTIVITY ITEMS": "activity", "REASONING PROCESS": "reasoning", "INFERENCE ITEMS": "theory_of_mind",
}


def parse_suggestions(text: Column, categories: list[str]) -> Column:
    """Array of (category, suggestion) for known categories, suggestions joined by lines.

    A category that is named again starts anew.
    """
    flat = F.array_join(F.filter(_lines(text), lambda x: x != ""), "\n")
    head = r"\*\*Category:[^\n]*\*\*(?=\n|\z)"
    pieces = F.regexp_extract_all(flat, F.lit(rf"(?m)^{head}[\s\S]*?(?=\n{head}|\z)"), F.lit(0))

    def one(p: Column) -> Column:
        lines = F.split(p, "\n")
        name = strip(F.regexp_replace(F.get(lines, F.lit(0)), r"\*\*Category:|\*\*", ""))
        said = F.filter(lines, lambda x: x.startswith("- Suggestion:"))
        text_ = F.array_join(F.transform(said, lambda x: strip(F.replace(x, F.lit("- Suggestion:"), F.lit("")))), "\n")
        return F.struct(name.alias("category"), strip(text_).alias("suggestion"))

    parsed = F.transform(pieces, one)

    def of(category: str) -> Column:
        mine = F.filter(parsed, lambda s: s["category"] == category)
        last = F.try_element_at(mine, F.lit(-1))["suggestion"]
        return F.struct(F.lit(category).alias("category"), last.alias("suggestion"))

    found = F.array(*[of(c) for c in categories])
    return F.filter(found, lambda s: F.coalesce(s["suggestion"], F.lit("")) != "")


def parse_operations(text: Column) -> Column:
    """Array of (operation, target_id, content) in order.

    Only a line with a known verb opens a block, so the fields of an unknown verb
    fall to the block before; the last field of a kind wins.
    """
    flat = F.array_join(F.filter(_lines(text), lambda x: x != ""), "\n")
    verb = rf"\*\*OPERATION:\*\*(?:{SPACE}*)(?:{'|'.join(VERBS)})(?=\n|\z)"
    blocks = F.regexp_extract_all(flat, F.lit(rf"(?m)^{verb}[\s\S]*?(?=\n{verb}|\z)"), F.lit(0))

    def field(block: Column, label: str) -> Column:
        mine = F.filter(F.split(block, "\n"), lambda x: x.startswith(label))
        return strip(F.replace(F.try_element_at(mine, F.lit(-1)), F.lit(label), F.lit("")))

    return F.transform(
        blocks,
        lambda b: F.struct(
            strip(F.regexp_replace(F.substring_index(b, "\n", 1), r"\*\*OPERATION:\*\*", "")).alias("operation"),
            field(b, "- Target Memory ID:").alias("target_id"),
            field(b, "- Memory Item Content:").alias("content"),
        ),
    )


def complete(ops: DataFrame) -> DataFrame:
    """Operations with all the fields their verb needs; the others are skipped."""
    has_id = F.coalesce("target_id", F.lit("")) != ""
    has_text = F.coalesce("content", F.lit("")) != ""
    verb = F.col("operation")
    fine = F.when(verb == "ADD", has_text).when(verb == "UPDATE", has_id & has_text).when(
        verb.isin("DELETE", "TOUCH"), has_id
    ).otherwise(False)
    return ops.where(fine)


def apply_operations(ops: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Items left after replaying ``ops(key, seq, operation, target_id, content, mentioned_at)``.

    Exact also for repeated ids, without a sequential pass: items of different ids
    never meet, so per id only the last delete, the adds behind it, the first of
    those and the last update behind that one matter. Each is a map-side combined
    aggregation. An ADD carries its new id in ``target_id``. ``state(key, seq,
    memory_id, content, mentioned_at)`` holds earlier items with lower ``seq``.
    """
    ops = complete(ops).withColumnRenamed("target_id", "memory_id")
    at = ["key", "memory_id"]
    cut = ops.where("operation = 'DELETE'").groupBy(*at).agg(F.max("seq").alias("_cut"))
    added = ops.where("operation = 'ADD'").select(*at, "seq", "content", "mentioned_at")
    if state is not None:
        added = added.unionByName(state.select(*at, "seq", "content", "mentioned_at"))
    alive = added.join(cut, at, "left").where(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut"))).drop("_cut")
    first = alive.groupBy(*at).agg(F.min("seq").alias("_first"))
    changed = (
        ops.where("operation = 'UPDATE'").select(*at, "seq", "content").join(first, at)
        .where(F.col("seq") > F.col("_first"))
        .groupBy(*at, F.col("_first").alias("seq")).agg(F.max_by("content", "seq").alias("_new"))
    )
    return alive.join(changed, [*at, "seq"], "left").select(
        *at, "seq", F.coalesce("_new", "content").alias("content"), "mentioned_at", F.lit("").alias("links")
    )


def executed_counts(ops: DataFrame) -> DataFrame:
    """How many operations of each verb were carried out per key."""
    return complete(ops).groupBy("key", "operation").agg(F.count("*").alias("n"))


def kv_replay(ops: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Current value per title: the last write wins, a delete removes it."""
    last = ops.groupBy(*keys).agg(
        F.max_by(F.struct("operation", "content"), F.col(order)).alias("_l")
    )
    return last.where(F.col("_l.operation") != "DELETE").select(*keys, F.col("_l.content").alias("content"))


def memory_get(kv: DataFrame, titles: DataFrame) -> DataFrame:
    return kv.join(titles.select("title"), "title")


def memory_list(kv: DataFrame, needle: str) -> DataFrame:
    return kv.where(F.contains("title", F.lit(needle)))


# Memory categories.
CATEGORIES = ["activity", "profile", "event", "episodic", "semantic"]


def category_store(existing: DataFrame, new: DataFrame, valid: list[str], append: list[str]) -> DataFrame:
    """Category contents after a write: some categories grow, the others are replaced.

    Both tables are ``(character, category, seq, content)``.
    """
    new = new.where(F.col("category").isin(valid))
    written = new.select("character", "category").distinct()
    kept = existing.where(F.col("category").isin(append)).unionByName(
        existing.where(~F.col("category").isin(append)).join(written, ["character", "category"], "left_anti")
    )
    return kept.unionByName(new)


def running_ledger(tx: DataFrame, keys: list[str]) -> DataFrame:
    """Ledger as titled values: per date and scene amount and count, per date the
    largest and the total, and the grand total.

    Everything comes from one table of days and scenes.
    """
    fine = tx.groupBy(*keys, "date", "scene").agg(
        F.sum("amount").alias("s"), F.count("*").alias("n"), F.max("amount").alias("m")
    )
    return ledger_titles(fine, keys)


def ledger_titles(fine: DataFrame, keys: list[str]) -> DataFrame:
    """``running_ledger`` from its day and scene table (``s``, ``n``, ``m``).

    Scene, day and grand totals are three grouping sets over that small table.
    """
    k = [F.col(c) for c in keys]
    date, scene = F.col("date"), F.col("scene")
    levels = fine.groupingSets([[*k, date, scene], [*k, date], k], *keys, "date", "scene").agg(
        F.grouping("date").alias("_no_date"), F.grouping("scene").alias("_no_scene"),
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("m").alias("m"),
    )
    day = F.date_format("date", "yyyy-MM-dd")

    def entry(title: Column, value: Column) -> Column:
        return F.struct(title.alias("title"), value.cast("double").alias("value"))

    amount, count = F.round("s", 2), F.col("n")
    entries = (
        F.when(F.col("_no_date") == 1, F.array(entry(F.lit("GlobalTotalAmount"), amount)))
        .when(F.col("_no_scene") == 1, F.array(
            entry(F.concat_ws("_", day, F.lit("LargestSingleTransactionAmount")), F.col("m")),
            entry(F.concat_ws("_", day, F.lit("TotalAmount")), amount),
        ))
        .otherwise(F.array(
            entry(F.concat_ws("_", day, "scene", F.lit("Amount")), amount),
            entry(F.concat_ws("_", day, "scene", F.lit("Count")), count),
        ))
    )
    return levels.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.title", "e.value")


def tool_call_stats(outputs: DataFrame) -> DataFrame:
    """Calls per stage and tool; ``is_final`` above 0 is the question stage.

    ``outputs(task_id, is_final, tool_counts map<string,int>)``.
    """
    stage = F.when(F.col("is_final") > 0, "qa_stage").otherwise("memory_stage")
    calls = outputs.select("task_id", stage.alias("stage"), F.explode("tool_counts").alias("tool", "n"))
    return calls.groupBy("task_id", "stage", "tool").agg(F.sum("n").alias("calls"))


def memory_stats(abstracts: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored abstracts and pages per task."""
    a = abstracts.groupBy("task_id").agg(F.count("*").alias("num_abstracts"))
    p = pages.groupBy("task_id").agg(F.count("*").alias("num_pages"))
    return a.join(p, "task_id", "outer").na.fill(0, ["num_abstracts", "num_pages"])
