"""From raw question/answer tables and nested dialogues to chunks and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.functions.draws import draw
from convoeval.functions.text import add_label_hint, said, strip
from convoeval.operators.ordered import id_bucket, joined_text, numbered

NO_STRINGS = "array<string>"


def _json_items(col: Column) -> Column:
    """Items of a JSON array as text; bad JSON or no array gives no items.

    A text item loses its quotes, any other item keeps its JSON form.
    """
    good = F.startswith(F.ltrim(F.regexp_replace(col, r"^[\s]+", "")), F.lit("[")) & F.get_json_object(
        col, "$"
    ).isNotNull()
    return F.when(good, F.from_json(col, NO_STRINGS))


def parse_chunks(col: Column) -> Column:
    return F.coalesce(_json_items(col), F.array().cast(NO_STRINGS))


def parse_qa_pairs(col: Column) -> Column:
    """Question/answer pairs of a JSON array, each as its JSON text."""
    return F.coalesce(_json_items(col), F.array().cast(NO_STRINGS))


def _as_text(value: Column) -> Column:
    """A JSON value as answer text: lists are joined, falsy values are empty."""
    items = F.array_join(F.from_json(value, NO_STRINGS), ", ", "None")
    falsy = value.isNull() | value.isin("", "null", "0", "0.0", "false")
    return F.when(falsy, "").when(value.startswith("["), items).otherwise(value)


def extract_qa(pair: Column) -> Column:
    """Struct of question and answer from an object or a 2/3-item list."""
    items = F.from_json(pair, NO_STRINGS)
    shift = F.when(F.size(items) >= 3, 1).otherwise(0)
    from_list = F.struct(
        F.when(F.size(items) >= 2, F.get(items, shift)).alias("question"),
        F.when(F.size(items) >= 2, F.get(items, shift + 1)).alias("answer"),
    )
    obj = F.from_json(pair, "question string, answer string, answers string")
    # an "answer" key wins over "answers" even when its value is null
    has_answer = F.array_contains(F.json_object_keys(pair), F.lit("answer"))
    from_object = F.struct(
        obj["question"].alias("question"),
        F.when(has_answer, obj["answer"]).otherwise(obj["answers"]).alias("answer"),
    )
    raw = F.when(pair.startswith("["), from_list).otherwise(from_object)
    return F.struct(
        F.coalesce(raw["question"], F.lit("")).alias("question"), _as_text(raw["answer"]).alias("answer")
    )


def resolve_id(candidates: list[Column], fallback: Column) -> Column:
    """First candidate that is not null and not blank, trimmed."""
    tidy = [F.nullif(strip(c.cast("string")), F.lit("")) for c in candidates]
    return F.coalesce(*tidy, fallback.cast("string"))


def build_samples(
    df: DataFrame, id_keys: list[str], prefix: str, default_source: str, fallback: str
) -> tuple[DataFrame, DataFrame]:
    """The two long tables of a question/answer parquet: chunks and questions.

    Questions are asked at the last chunk. A blank question is dropped but its
    number stays used.
    """
    base = df.select(
        F.concat(F.lit(f"{prefix}_"), resolve_id([F.col(k) for k in id_keys], F.col(fallback))).alias("task_id"),
        parse_chunks(F.col("chunks")).alias("_chunks"),
        parse_qa_pairs(F.col("questions_and_answers")).alias("_pairs"),
        F.coalesce(F.col("data_source"), F.lit(default_source)).alias("category"),
    )
    chunks = base.select("task_id", F.posexplode("_chunks").alias("position", "text"))
    pairs = base.select(
        "task_id", "category",
        F.greatest(F.size("_chunks") - 1, F.lit(0)).alias("position"),
        F.posexplode("_pairs").alias("_i", "_pair"),
    ).withColumn("_qa", extract_qa(F.col("_pair")))
    questions = pairs.where(F.col("_qa.question") != "").select(
        F.concat_ws("_", "task_id", "_i").alias("qid"), "task_id",
        F.col("_qa.question").alias("query"), F.col("_qa.answer").alias("answer"), "position", "category",
    )
    return chunks, questions


def source_catalog(tasks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Task names resolved against ``catalog(task, data_source, prefix, hint)``.

    ``name_<n>`` and ``name-<suffix>`` fall back to the entry ``name`` and carry
    the rest as parameter. Unknown names keep NULLs, see ``require_known``.
    """
    exact = tasks.join(catalog, "task")
    rest = tasks.join(catalog, "task", "left_anti")
    pattern = r"^(.+?)[_-]([^_-]+)$"
    named = rest.select(
        F.col("task").alias("_asked"),
        F.regexp_extract("task", pattern, 1).alias("task"),
        F.nullif(F.regexp_extract("task", pattern, 2), F.lit("")).alias("parameter"),
    ).join(catalog, "task", "left")
    cols = ["data_source", "prefix", "hint"]
    parameter = F.when(F.col("data_source").isNotNull(), F.col("parameter")).alias("parameter")
    return exact.select("task", *cols, F.lit(None).cast("string").alias("parameter")).unionByName(
        named.select(F.col("_asked").alias("task"), *cols, parameter)
    )


def require_known(resolved: DataFrame) -> DataFrame:
    """Fails with the name of the first task that has no catalog entry."""
    known = F.col("data_source").isNotNull()
    message = F.concat(F.lit("unknown task: "), F.col("task"))
    return resolved.withColumn(
        "data_source", F.when(known, F.col("data_source")).otherwise(F.raise_error(message).cast("string"))
    )


def apply_hint(questions: DataFrame, flag: Column) -> DataFrame:
    return questions.withColumn(
        "query", F.when(flag, add_label_hint(F.col("query"))).otherwise(F.col("query"))
    )


def flatten_answer(col: Column) -> Column:
    """List of objects to numbered lines, plain list to comma text, else itself."""
    items = F.from_json(col, NO_STRINGS)

    def line(item: Column, i: Column) -> Column:
        keys = F.coalesce(F.json_object_keys(item), F.array().cast(NO_STRINGS))
        number = F.concat((i + 1).cast("string"), F.lit(". "))
        value = (
            F.when(F.array_contains(keys, F.lit("event")), F.get_json_object(item, "$.event"))
            .when(F.array_contains(keys, F.lit("text")), F.get_json_object(item, "$.text"))
        )
        known = F.array_contains(keys, F.lit("event")) | F.array_contains(keys, F.lit("text"))
        return F.when(known, F.concat(number, F.coalesce(value, F.lit("None")))).otherwise(item)

    objects = F.array_join(F.transform(items, line), "\n")
    return (
        F.when(~col.startswith("[") | items.isNull(), col)
        .when(F.get(items, F.lit(0)).startswith("{"), objects)
        .otherwise(F.array_join(items, ", ", "None"))
    )


def rewrite_by_category(df: DataFrame, seed: int = 0) -> DataFrame:
    """Temporal questions get a date hint, adversarial ones become two options.

    The order of the options is a hash of the question id.
    """
    unknown = F.lit("Not mentioned in the conversation")
    wrong = F.col("adversarial_answer")
    first = draw(seed, "qid") % 2 == 0
    a = F.when(first, unknown).otherwise(wrong)
    b = F.when(first, wrong).otherwise(unknown)
    options = F.concat(
        F.col("query"), F.lit(" Select the correct answer: (a) "), a, F.lit(" (b) "), b, F.lit(". ")
    )
    dated = F.concat(F.col("query"), F.lit(" Use DATE of CONVERSATION to answer with an approximate date."))
    return df.withColumns(
        {
            "query": F.when(F.col("category") == 2, dated).when(F.col("category") == 5, options).otherwise(F.col("query")),
            "answer": F.when(F.col("category") == 5, F.when(first, "a").otherwise("b")).otherwise(F.col("answer")),
        }
    )


def evidence_session(evidence: Column, n_sessions: Column) -> Column:
    """Largest session number among ids like ``D3:12``; the last session without any."""
    numbers = F.transform(evidence, lambda e: F.regexp_extract(e, r"^.(\d+)", 1).cast("int"))
    return F.coalesce(F.array_max(numbers), n_sessions)


def dedupe_documents(docs: DataFrame, order: str, text: Column, bucket_rows: int = 1 << 20) -> DataFrame:
    """First copy of every text with its index in order of first appearance.

    Only a 32-byte digest is shuffled; copies meet in a map-side combined minimum.
    """
    firsts = docs.groupBy(F.sha2(text, 256).alias("_digest")).agg(F.min(order).alias(order), F.count("*").alias("copies"))
    indexed = numbered(firsts, [], [order], id_bucket(order, bucket_rows), "_row")
    kept = indexed.select(order, "copies", (F.col("_row") - 1).alias("doc_index"))
    return docs.join(kept, order)


def mix_distractors(needs: DataFrame, docs: DataFrame, n: int, seed: int) -> DataFrame:
    """Supporting documents of a question plus random others, ``n`` in mixed order.

    ``needs(qid, title)``, ``docs(doc_index, title, text)`` with dense indices. The
    fillers are drawn by hashing (seed, question, draw) to an index, with spare
    draws for repeats; should they run short, the indices from a drawn start on
    follow. So ``n`` documents come together as long as the corpus has them, no
    question meets more than a multiple of ``n``, and the draw is the same for any
    corpus size.
    """
    total = docs.count()
    support = needs.join(docs.select("doc_index", "title"), "title").groupBy("qid").agg(
        F.collect_set("doc_index").alias("_need")
    )
    asked = needs.select("qid").distinct().join(support, "qid", "left").withColumn(
        "_need", F.coalesce("_need", F.array().cast("array<bigint>"))
    )
    total = max(total, 1)  # an empty corpus places nothing: its indices meet no document
    draws = F.transform(F.sequence(F.lit(0), F.lit(4 * n)), lambda i: draw(seed, F.col("qid"), i) % total)
    start = draw(seed, F.col("qid"), F.lit("start"))
    walk = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(total), F.lit(n) + F.size("_need")) - 1), lambda i: (start + i) % total
    )
    keyed = F.array_sort(
        F.transform(
            F.array_except(F.array_distinct(draws), F.col("_need")),
            lambda x: F.struct(draw(seed, F.col("qid"), x).alias("h"), x.alias("i")),
        )
    )
    room = F.greatest(F.lit(n) - F.size("_need"), F.lit(0))
    order = F.array_distinct(F.concat(F.transform(keyed, lambda s: s["i"]), F.array_except(walk, F.col("_need"))))
    fill = F.slice(order, F.lit(1), room)
    mixed = F.array_sort(
        F.transform(
            F.concat("_need", fill),
            lambda x: F.struct(draw(seed + 1, F.col("qid"), x).alias("h"), x.alias("i")),
        )
    )
    placed = asked.select("qid", "_need", F.posexplode(F.transform(mixed, lambda s: s["i"])).alias("position", "doc_index"))
    return placed.select(
        "qid", "position", "doc_index", F.array_contains("_need", F.col("doc_index")).alias("supporting")
    ).join(docs, "doc_index")


def spread_positions(low: Column, high: Column, n: int) -> Column:
    """``n`` positions evenly over ``[low, high]``; the end alone when ``n`` is 1."""
    if n == 1:
        return F.array(high)
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    at = F.transform(steps, lambda i: low + F.floor(i * (high - low) / F.lit(n - 1)).cast("int"))
    return F.when(low <= high, at).otherwise(F.transform(steps, lambda i: high))


def merge_samples(
    samples: DataFrame, order: str, k: int = 5, bucket_rows: int = 1 << 20
) -> DataFrame:
    """Assigns every ``k`` samples to one batch and gives their chunk offsets.

    ``samples`` has ``task_id``, ``n_chunks`` and an order. Output: ``task_id``,
    ``batch``, ``offset`` and the merged id; add ``offset`` to positions.
    """
    rows = numbered(samples, [], [order], id_bucket(order, bucket_rows), "_row")
    batched = rows.withColumn("batch", F.floor((F.col("_row") - 1) / k))
    # a batch holds k samples: bounded, so its members fit one small array
    members = batched.groupBy("batch").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "task_id", "n_chunks"))).alias("_m")
    )
    merged_id = F.concat(
        F.lit("batch_"), F.col("batch").cast("string"), F.lit("_"), F.element_at("_m", 1)["task_id"],
        F.lit("_to_"), F.element_at("_m", -1)["task_id"],
    )
    spread = members.select("batch", merged_id.alias("merged_id"), "_m", F.posexplode("_m").alias("_i", "_s"))
    before = F.aggregate(
        F.slice("_m", F.lit(1), F.col("_i")), F.lit(0).cast("long"), lambda a, s: a + s["n_chunks"]
    )
    return spread.select("batch", "merged_id", F.col("_s.task_id").alias("task_id"), before.alias("offset"))


def filter_long(messages: DataFrame, keys: list[str], text: str, limit: int = 2_180_000) -> DataFrame:
    """Keys whose texts, joined by newlines, are longer than ``limit`` characters."""
    total = messages.groupBy(*keys).agg((F.sum(F.length(text)) + F.count("*") - 1).alias("n_chars"))
    return total.where(F.col("n_chars") > limit)


def filter_categories(samples: DataFrame, questions: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Questions of the kept categories and the samples that still have one."""
    kept = questions.where(F.col("category").isin(keep))
    return samples.join(kept, "task_id", "left_semi"), kept


def index_by_id(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per id."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return last.select(*keys, "_r.*")


# Field names of the three narrative layouts.
LAYOUTS = {
    "inner_thought": ["action", "dialogue", "environment", "background", "inner_thought"],
    "mind": ["action", "dialogue", "environment", "background", "mind"],
    "Mind": ["action", "dialogue", "Environment", "Background", "Mind"],
}
CANONICAL = ["action", "dialogue", "environment", "background", "inner_thought"]


def detect_layout(fields: list[str]) -> str:
    """Layout of a record set from its field names; the first one by default."""
    present = set(fields)
    if "inner_thought" in present:
        return "inner_thought"
    if "Mind" in present:
        return "Mind"
    return "mind" if "mind" in present else "inner_thought"


def unify_fields(df: DataFrame, layout: str | None = None) -> DataFrame:
    """Renames the fields of a layout to the canonical five."""
    names = LAYOUTS[layout or detect_layout(df.columns)]
    have = [c for c in df.columns if c in names]
    new = {old: CANONICAL[names.index(old)] for old in have}
    return df.select([F.col(f"`{c}`").alias(new.get(c, c)) for c in df.columns])


def attach_source_prompt(questions: DataFrame, prompts: DataFrame, default: str) -> DataFrame:
    """Per sample the first non-empty category, its prompt and core flag."""
    named = F.when(F.col("category") != "", F.col("category"))
    source = questions.groupBy("task_id").agg(
        F.coalesce(F.min_by(named, F.when(named.isNotNull(), F.col("ord"))), F.lit(default)).alias("data_source")
    )
    return source.join(prompts, "data_source", "left").withColumn(
        "including_core", F.coalesce("including_core", F.lit(True))
    )


def ordered_questions(questions: Column) -> Column:
    """Question structs sorted by position, ties by id."""
    keyed = F.array_sort(
        F.transform(questions, lambda q: F.struct(q["position"].alias("p"), q["qid"].alias("i"), q.alias("q")))
    )
    return F.transform(keyed, lambda s: s["q"])


def first_answer(answers: Column) -> Column:
    return F.coalesce(F.get(answers, F.lit(0)), F.lit(""))


# sessions to chunks ----------------------------------------------------------
def render_sessions(
    turns: DataFrame, keys: list[str], order: str, line: Column, head: Column | None = None,
    tail: str = "\n\n", part_rows: int = 10_000,
) -> DataFrame:
    """One chunk per session: head, its lines in order, tail.

    Lines are joined in stretches of ``part_rows`` turns first; the chunk does not
    depend on them.
    """
    body = joined_text(turns, keys, order, F.concat(line, F.lit("\n")), "", part_rows)
    if head is None:
        return body
    heads = turns.groupBy(*keys).agg(F.min(head).alias("_head"))
    return body.join(heads, keys).withColumn("text", F.concat("_head", "text", F.lit(tail))).drop("_head")


def session_head(speaker_a: Column, speaker_b: Column, date: Column) -> Column:
    return F.concat(
        F.lit("Below is a conversation between "), speaker_a, F.lit(" and "), speaker_b,
        F.lit(".\n\nDATE: "), F.coalesce(date, F.lit("Unknown")), F.lit("\nCONVERSATION:\n"),
    )


def speaker_line(style: str, speaker: Column, text: Column, order: Column, caption: Column | None = None) -> Column:
    """Line of a turn in one of the rendering styles.

    ``quoted``: name and quote, with an optional shared caption; ``role``: User or
    Assistant; ``alternating``: Speaker 1 and 2 by ordinal; ``plain``: ``name: text``.
    """
    if style == "quoted":
        line = said(speaker, text)
        if caption is None:
            return line
        return F.concat(line, F.when(caption.isNotNull(), F.concat(F.lit(" and shared "), caption)).otherwise(""))
    if style == "role":
        return said(F.when(speaker == "user", "User").otherwise("Assistant"), text)
    if style == "alternating":
        return said(F.when(F.pmod(order, F.lit(2)) == 0, "Speaker 1").otherwise("Speaker 2"), text)
    if style == "plain":
        return F.concat(F.coalesce(speaker, F.lit("unknown")), F.lit(": "), F.coalesce(text, F.lit("")))
    raise ValueError("style must be quoted, role, alternating or plain")


SPEAKER = r"(?:User said,|Assistant said,)"


def parse_turns(chunks: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Turns of rendered sessions: ``(keys, turn, date, role, content)``.

    The inverse of rendering. Lines are trimmed, blank ones dropped. A turn runs
    from its ``X said,`` line to the next one; a date line inside the talk changes
    the date from that turn on. The steps are separate projections, so that each
    chunk is cut once, and nothing is shuffled.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    flat = chunks.select(*keys, F.array_join(lines, "\n").alias("_flat"))
    parts = flat.select(
        *keys,
        F.regexp_extract("_flat", r"(?s)^(.*?)(?:^|\n)CONVERSATION:(?:\n|$)", 1).alias("_head"),
        F.regexp_extract("_flat", r"(?s)(?:^|\n)CONVERSATION:(?:\n(.*))?$", 1).alias("_body"),
    )
    turn = rf"(?m)^{SPEAKER}[\s\S]*?(?=\n{SPEAKER}|\z)"
    cut = parts.select(
        *keys,
        F.concat_ws("\n", "_head", F.regexp_extract("_body", rf"(?s)^(.*?)(?:^|\n){SPEAKER}", 1)).alias("_head"),
        F.regexp_extract_all("_body", F.lit(turn), F.lit(0)).alias("_segments"),
    )

    def last_date(part: Column) -> Column:
        found = F.regexp_extract_all(part, F.lit(r"(?m)^DATE:(.*?)(?:DATE:.*)?$"), F.lit(1))
        return strip(F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"\(.*$", ""))

    # the dates inside the talk with their turns; there are few, and only they are looked through
    dated = F.filter(
        F.transform("_segments", lambda s, i: F.named_struct(F.lit("i"), i, F.lit("date"), last_date(s))),
        lambda x: x["date"].isNotNull(),
    )
    rows = cut.select(*keys, last_date(F.col("_head")).alias("_start"), dated.alias("_dates"), F.posexplode("_segments").alias("turn", "_segment"))
    own = F.try_element_at(F.filter("_dates", lambda x: x["i"] <= F.col("turn")), F.lit(-1))["date"]
    rows = rows.select(
        *keys, "turn", F.coalesce(own, "_start").alias("date"), "_segment",
        F.filter(
            F.split("_segment", "\n"), lambda x: ~x.startswith("DATE:") & (x != "CONVERSATION:")
        ).alias("_lines"),
    )
    rows = rows.withColumn("_first", strip(F.regexp_replace(F.get("_lines", F.lit(0)), f"^{SPEAKER}", "")))
    first = F.col("_first")
    unquoted = F.when(
        first.startswith('"') & first.endswith('"'),
        F.substring(first, F.lit(2), F.greatest(F.length(first) - 2, F.lit(0))),
    ).otherwise(first)
    more = F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))
    rows = rows.withColumn("_first", unquoted)
    return rows.where("_first <> ''").select(
        *keys, "turn", "date",
        F.when(F.col("_segment").startswith("User"), "user").otherwise("assistant").alias("role"),
        F.array_join(F.concat(F.array("_first"), more), "\n").alias("content"),
    )
