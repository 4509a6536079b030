"""Main text of web pages, with nearest-URL page differencing.

Every page is paired with the page of the nearest URL path on its host; the lines of both are aligned by
longest common subsequence, and what they share is the host's frame and goes. Markup checks that: menus,
headers, footers, sidebars, notices, adverts, forms, scripts and comments go though no other page has them,
and what an article or main element holds stays though another page has it too. Other lines that only this page
has stay wherever they stand; markup alone decides only where a page has no partner.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoeval.llm.common import stored

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg canvas object title".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements, and words in class, id or role, that are not the article.
OTHER = frozenset("nav header footer aside form button select dialog menu search head".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies disqus footer header "
    "menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription toolbar widget".split())
MAIN_WORDS = frozenset("article body content entry main page post".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
MARKS = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
BLOCK_PAGES = 1000


def _other(name: str, rest: str) -> bool:
    if name in OTHER:
        return True
    if name in ("html", "body", "article", "main") and "comment" not in rest.lower():
        return False
    if "=" not in rest:
        return False
    words = {w for m in MARKS.finditer(rest) for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[1] or m[2] or m[3] or "").lower())}
    if words & {"with", "has", "no"}:  # what the element has beside it, not what it is
        words -= {"sidebar", "header", "footer", "menu", "nav", "banner"}
    return bool(words & OTHER_WORDS) and not (words & MAIN_WORDS and not words & {"comment", "comments", "ad", "ads", "sidebar"})


def lines_of_page(html: str) -> list[tuple[str, bool, bool]]:
    """(text, other, in the article) of every block of a page that holds text, in page order."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, other, article
    parts: list[str] = []
    at = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, other, article = stack[-1] if stack else ("", False, False)
            out.append((text, other, article))

    while True:
        m = TOKEN.search(html, at)
        parts.append(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(s[1] != stack[k - 1][1] if k else s[1] for s in stack[k:]):
                        flush()
                    del stack[k:]
                    break
            continue
        if name == "br":
            parts.append("\n")
        if name in BLOCKS:
            flush()
            # a new block ends an open paragraph, a new item the open item
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "td", "th", "tr", "option", "dd", "dt"):
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in VOID or (m["rest"] or "").endswith("/>") and name in RAW:
            continue
        if name in RAW:
            close = re.compile(rf"(?i)</{re.escape(name)}\b[^>]*(?:>|\Z)").search(html, at)
            at = close.end() if close else len(html)
            continue
        _, other, article = stack[-1] if stack else ("", False, False)
        mine = other or _other(name, m["rest"] or "")
        if mine != other:
            flush()
        stack.append((name, mine, article or name in ("article", "main") or 'role="main"' in (m["rest"] or "")))
    flush()
    return out


def kept_lines(html: str | None) -> tuple[list[tuple[str, bool, bool]], list[int], bool]:
    """All lines of a page, the places of those to keep, and whether markup has decided them."""
    lines = lines_of_page(html or "")
    inside = [i for i, (_, other, article) in enumerate(lines) if article and not other]
    if inside:
        return lines, inside, True
    return lines, [i for i, (_, other, _) in enumerate(lines) if not other], False


def own_lines(lines: list[tuple[str, bool, bool]], shared: set[int]) -> list[int]:
    """Places of the lines that a comparison leaves to a page, and those of its article; none that is marked as other."""
    return [i for i, (_, other, article) in enumerate(lines) if not other and (article or i not in shared)]


def shared_lines(a: list[int], b: list[int], most_bits: int = 1 << 31) -> list[int]:
    """Places in ``a`` of a longest common subsequence of two sequences, by bit-parallel rows."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > most_bits:
        # halve, so that rows need not all be held
        mid = len(a) // 2
        head, tail = _profile(a[:mid], b), _profile(a[mid:][::-1], b[::-1])
        cut = int(np.argmax(head + tail[::-1]))
        return shared_lines(a[:mid], b[:cut], most_bits) + [mid + i for i in shared_lines(a[mid:], b[cut:], most_bits)]
    rows = list(_rows(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def _rows(a: list[int], b: list[int]):
    """Row by row, the places of ``b`` (as zero bits) where the longest common subsequence grows."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    whole = (1 << len(b)) - 1
    row = whole
    yield row
    for x in a:
        u = row & places.get(x, 0)
        row = (row + u | row - u) & whole
        yield row


def _profile(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` with each beginning of ``b``."""
    for row in _rows(a, b):
        last = row
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def main_text(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """``pages(page_id, url, html)`` as (page_id, url, text, n_chars, n_shared).

    ``text`` has the kept blocks of a page in order, white space within a block as one space, joined by
    line feeds. A page keeps its lines outside menus and the like, less the ``n_shared`` ones it shares with its
    partner; a page with an article or main element is compared with all its lines, and keeps that element's lines,
    all of them, besides its other lines that it does not share. The partner is the nearest page before or after in the order
    of paths among the pages of the same host and folder (of the host, for folders of one page) that has lines and whose compared
    lines are not all the same, whichever path begins alike for longer (the one before where both do); where there is none,
    nothing goes, but an article or main element decides for its page. Partitions hold about
    ``block_pages`` pages or fewer; the result does not depend on them. A null html is empty, a null url a host of its own; every row gives one row, repeated
    rows too; no rows give none. Other columns are not read.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    key = F.xxhash64("url", "html")

    def prints(batches):
        for batch in batches:
            lines, open_, marked, loose = [], [], [], []
            for h in batch.column("html").to_pylist():
                every, keep, decided = kept_lines(h)
                lines.append([xxhash.xxh3_64_intdigest(t) - 2**63 for t, _, _ in every])
                open_.append(range(len(every)) if decided else keep)
                marked.append(decided)
                loose.append(decided and not all(other or article for _, other, article in every))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "key", "url")), pa.array(lines, pa.list_(pa.int64())), pa.array(open_, pa.list_(pa.int32())), pa.array(marked), pa.array(loose)],
                ["page_id", "key", "url", "lines", "open", "marked", "loose"])

    id_type = dict(pages.dtypes)["page_id"]
    small = stored(pages.select("page_id", key.alias("key"), "url", "html").mapInArrow(
        prints, f"page_id {id_type}, key long, url string, lines array<long>, open array<int>, marked boolean, loose boolean"), "page-lines")
    gone = stored(_frame_lines(small, block_pages, id_type), "frame-lines")

    def extract(batches):
        for batch in batches:
            drops = batch.column("drop").to_pylist() if "drop" in batch.schema.names else [None] * batch.num_rows
            texts = []
            for h, drop in zip(batch.column("html").to_pylist(), drops, strict=True):
                lines, keep, _ = kept_lines(h)
                if drop is not None:
                    keep = own_lines(lines, set(drop))
                texts.append("\n".join(lines[i][0] for i in keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(d or ()) for d in drops], pa.int64())], ["page_id", "url", "text", "n_chars", "n_shared"])

    if gone.isEmpty():  # no comparison says more than markup: nothing to bring to the texts
        rows = pages
    else:
        rows = pages.withColumn("key", key).join(gone, pages["page_id"].eqNullSafe(gone["of"]) & (F.col("key") == gone["of_key"]), "left").select("page_id", "url", "html", "drop")
    return rows.mapInArrow(extract, f"page_id {id_type}, url string, text string, n_chars long, n_shared long")


def _frame_lines(small: DataFrame, block_pages: int, id_type: str) -> DataFrame:
    """(of, of_key, drop): places of the lines that pages share with their partners.

    A page is here if it shares some, or if it has lines neither in its article nor in menus and the like, which
    are its own where no partner has them.

    The pages lie in range partitions by (host, folder, path). Neighbours with equal compared lines make a
    run; a page's partners are the last page of the run before and the first of the run behind its own. At the
    edge of a partition they come from a table with the edge runs of each partition.
    """
    bare = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rows = small.withColumns({"host": F.lower(F.substring_index(bare, "/", 1)), "path": F.expr("substring(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), 1)")})
    rows = rows.withColumn("folder", F.regexp_extract("path", r"^([^?#]*)/", 1)).where("host is not null and size(lines) > 0")
    counts = rows.groupBy("host", "folder").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(counts.where("n > 1").withColumnsRenamed({"host": "_h", "folder": "_f"}), (F.col("host") == F.col("_h")) & (F.col("folder") == F.col("_f")), "left").withColumn(
        "group", F.when(F.col("n") > 1, F.concat(F.lit("/"), "folder")).otherwise(F.lit("")))
    sign = F.xxhash64(F.transform("open", lambda i: F.get("lines", i)), "marked")
    order = ["host", "group", "path", "page_id", "key"]
    least = max(1, -(-small.count() // block_pages))
    parts = max(least, int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = stored(rows.select(*order, "lines", "open", "loose", sign.alias("sign")).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "page-order")

    inside = Window.partitionBy("part", "host", "group").orderBy(*order[2:])
    first = F.row_number().over(inside) == 1
    starts = placed.withColumn("new", (first | (F.lag("sign").over(inside) != F.col("sign"))).cast("int"))
    runs = stored(starts.withColumn("run", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("new"), "page-runs")
    at, page, near = F.struct(*order[2:]), F.struct("path", "lines"), ["part", "host", "group"]
    ends = stored(runs.groupBy(*near, "run", "sign").agg(F.min_by(page, at).alias("first"), F.max_by(page, at).alias("last")), "run-ends")
    last_run = ends.groupBy(*near).agg(F.max("run").alias("n"))

    # the edge runs of a partition, two on each side: next to equal open lines the second one counts
    edge = ends.join(last_run, near).where("run <= 2 or run >= n - 1")
    place = F.struct(F.when(F.col("run") <= 2, F.col("run")).alias("from_left"), F.when(F.col("run") >= F.col("n") - 1, F.col("n") - F.col("run") + 1).alias("from_right"), "sign", "first", "last")
    sides = edge.groupBy("host", "group", "part").agg(F.collect_list(place).alias("runs"))
    row = F.struct("part", "runs")
    chain = sides.groupBy("host", "group").agg(F.array_sort(F.collect_list(row)).alias("chain"))  # one entry a partition

    def beyond(side: str, end: str, where, away: int):
        """Edge runs of other partitions with other open lines than ``sign``, the nearest first where ``away`` is 1, else last."""
        lists = F.transform(F.filter("chain", where), lambda c: F.array_sort(F.transform(
            F.filter(c["runs"], lambda r: r[side].isNotNull()), lambda r: F.struct((r[side] * away).alias("o"), r["sign"].alias("sign"), r[end].alias("page")))))
        return F.filter(F.flatten(lists), lambda r: r["sign"] != F.col("sign"))

    outer = edge.where("run = 1 or run = n").join(chain, ["host", "group"]).select(
        *near, "run", F.when(F.col("run") == 1, F.try_element_at(beyond("from_right", "last", lambda c: c["part"] < F.col("part"), -1), F.lit(-1))["page"]).alias("before"),
        F.when(F.col("run") == F.col("n"), F.get(beyond("from_left", "first", lambda c: c["part"] > F.col("part"), 1), 0)["page"]).alias("after"))
    inner = ends.select(*near, F.col("run"), "first", "last")
    partners = (
        ends.select(*near, "run")
        .join(inner.select(*near, (F.col("run") + 1).alias("run"), F.col("last").alias("own_before")), [*near, "run"], "left")
        .join(inner.select(*near, (F.col("run") - 1).alias("run"), F.col("first").alias("own_after")), [*near, "run"], "left")
        .join(outer, [*near, "run"], "left")
        .select(*near, "run", F.coalesce("own_before", "before").alias("before"), F.coalesce("own_after", "after").alias("after"))
    )
    pairs = runs.where(F.size("open") > 0).join(partners, [*near, "run"]).select("page_id", "key", "path", "lines", "open", "loose", "before", "after")

    def align(batches):
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                ids, drops = [], []
                for k, r in enumerate(batch.to_pylist()):
                    near = [p for p in (r["before"], r["after"]) if p]
                    if not near:
                        continue
                    partner = max(near, key=lambda p: _alike(p["path"], r["path"]))["lines"]
                    drop = sorted(set(shared_lines(r["lines"], partner)) & set(r["open"]))
                    if drop or r["loose"]:
                        ids.append(k)
                        drops.append(drop)
                found = pa.array(ids, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("page_id").take(found), batch.column("key").take(found), pa.array(drops, pa.list_(pa.int32()))], ["of", "of_key", "drop"])

    return pairs.mapInArrow(align, f"of {id_type}, of_key long, drop array<int>").dropDuplicates(["of", "of_key"])


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n
