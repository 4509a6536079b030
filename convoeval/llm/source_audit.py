"""Source divergence audit: how far the word use of each source lies from the others and from its language.

One pass over the texts builds postings (term, source, count) in memory. When a block is full it leaves as a
term-sorted run, cut into chunks per hash shard. A shard's task merges the chunks of all runs with a heap into
term frequencies. A second stream over the merged postings adds up the corrections of source pairs: terms
that a source lacks all have the same share there, so a pair's sum over all terms is a closed form plus
corrections for the terms that occur, and only terms of both sources need to be seen together.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoeval.llm.common import slices, stored

#: Estimated bytes of a dictionary entry with its term.
ENTRY = 160

#: Postings of one chunk of a run; what a merge holds of each run is one chunk.
CHUNK = 4096

#: Runs that one merge takes at once; more are merged in several rounds.
FAN_IN = 1024

#: Postings that a merge adds up at once, about.
WINDOW = 200_000

#: Sources up to which the pair sums of a language are one matrix; else blocks of SIDE by SIDE, HELD at a time.
MATRIX, SIDE, HELD = 1024, 128, 256

RUNS = "run long, shard int, lang string, first string, terms array<string>, docs array<long>, sizes array<int>, names array<string>, codes array<int>, counts array<long>"
FREQUENCIES = "lang string, term string, source string, n long, total long, lead int"


def letters() -> bytes:
    """A table for ``bytes.translate``: A-Z to a-z, all ASCII but letters to a space, other bytes as they are."""
    return bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalpha() else 32 if i < 128 else i for i in range(256))


LETTERS = letters()


def words_of(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of ``text`` in lists of bounded size."""
    plain = text.translate(LETTERS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + step) if len(plain) - at > step else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


class Block:
    """Postings of the documents since the last run: counts by (lang, source), documents by lang."""

    def __init__(self):
        self.counts: dict = defaultdict(Counter)
        self.docs: dict = defaultdict(Counter)
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, docs, own = self.counts[lang, source], self.docs[lang], set()
        before = len(counts) + len(docs)
        for words in words_of(text):
            counts.update(words)
            own.update(words)
        docs.update(own)
        self.size += (len(counts) + len(docs) - before) * ENTRY

    def chunks(self, run: int, shards: int) -> Iterator[pa.RecordBatch]:
        """The block as a run: for each language its terms by shard, in order, cut into chunks."""
        for lang in sorted(self.docs):
            own = self.docs[lang]
            terms = sorted(own)
            if not terms:
                continue
            place = dict(zip(terms, range(len(terms)), strict=True))
            names = sorted(source for other, source in self.counts if other == lang)
            held = [self.counts[lang, name] for name in names]
            at = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in held])
            codes = np.repeat(np.arange(len(names), dtype=np.int32), [len(c) for c in held])
            counts = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in held])
            start = zlib.crc32(lang.encode())
            shard = np.fromiter((zlib.crc32(t, start) for t in terms), np.int64, len(terms)) % shards
            order = np.argsort(shard, kind="stable")  # by shard, then by term
            rank = np.empty(len(terms), np.int64)
            rank[order] = np.arange(len(terms))
            by_term = np.argsort(rank[at], kind="stable")
            yield from chunked(
                run, lang, shard[order], [terms[i].decode() for i in order.tolist()], np.fromiter(map(own.__getitem__, terms), np.int64, len(terms))[order],
                np.bincount(rank[at], minlength=len(terms)), names, codes[by_term], counts[by_term])


def chunked(run, lang, shard, terms, docs, sizes, names, codes, counts) -> Iterator[pa.RecordBatch]:
    """Rows of ``RUNS`` of terms in order of (shard, term); a chunk has one shard and about ``CHUNK`` postings."""
    ends = np.cumsum(sizes)
    part = (ends - sizes) // CHUNK
    cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(terms)]
    rows: dict[str, list] = {name: [] for name in ("shard", "first", "terms", "docs", "sizes", "names", "codes", "counts")}
    begins = np.concatenate([[0], ends])
    for a, b in zip(cuts, cuts[1:], strict=False):
        lo, hi = begins[a], begins[b]
        used, code = np.unique(codes[lo:hi], return_inverse=True)
        row = (int(shard[a]), terms[a], terms[a:b], docs[a:b], sizes[a:b], [names[i] for i in used.tolist()], code, counts[lo:hi])
        for name, value in zip(rows, row, strict=True):
            rows[name].append(value)
    n = len(rows["shard"])
    for at in range(0, n, 256):
        r = {name: values[at : at + 256] for name, values in rows.items()}
        m = len(r["shard"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([run] * m, pa.int64()), pa.array(r["shard"], pa.int32()), pa.array([lang] * m), pa.array(r["first"]), pa.array(r["terms"], pa.list_(pa.string())),
             numbers(r["docs"], np.int64), numbers(r["sizes"], np.int32), pa.array(r["names"], pa.list_(pa.string())), numbers(r["codes"], np.int32), numbers(r["counts"], np.int64)],
            [x.split(" ")[0] for x in RUNS.split(", ")])


def numbers(parts: list[np.ndarray], kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts).astype(kind)))


def runs_of(docs: DataFrame, shards: int, block_bytes: int) -> DataFrame:
    """Term-sorted runs of ``docs(lang, source, text)``, cut into chunks."""

    def index(batches):
        from pyspark import TaskContext

        run, block = TaskContext.get().partitionId() << 32, Block()

        for batch in slices(batches, "text"):
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, value in zip(langs, sources, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                block.add(lang, source, value)
                if block.size >= block_bytes:
                    yield from block.chunks(run, shards)
                    run, block = run + 1, Block()
        yield from block.chunks(run, shards)

    return docs.mapInArrow(index, RUNS)


class Chunk:
    """One row of ``RUNS``, its source names as numbers of the task, read from ``at`` on."""

    def __init__(self, batch: pa.RecordBatch, i: int, known: dict[str, int]):
        def column(name):
            return batch.column(name)[i].values

        self.at, self.terms, self.docs, self.sizes = 0, column("terms"), column("docs").to_numpy(), column("sizes").to_numpy()
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        numbers = np.array([known.setdefault(name, len(known)) for name in column("names").to_pylist()], np.int64)
        self.codes, self.counts = numbers[column("codes").to_numpy()], column("counts").to_numpy()

    def take(self, term: str | None) -> tuple:
        """(terms, docs, sizes, codes, counts) of the stretch below ``term``, which is left behind."""
        a, b = self.at, len(self.terms)
        if term is not None:
            b = bisect.bisect_left(range(len(self.terms)), term, a, key=lambda i: self.terms[i].as_py())
        self.at = b
        lo, hi = self.begins[a], self.begins[b]
        return self.terms[a:b], self.docs[a:b], self.sizes[a:b], self.codes[lo:hi], self.counts[lo:hi]


def added(lang: str, parts: list[tuple], known: dict[str, int]) -> tuple:
    """Stretches of several runs as one: (lang, terms, docs, sizes, names, codes, counts), terms in order."""
    terms, docs, sizes, codes, counts = zip(*parts, strict=True)
    coded = pa.concat_arrays(terms).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    place = rank[coded.indices.to_numpy()]
    in_docs = np.zeros(len(order), np.int64)
    np.add.at(in_docs, place, np.concatenate(docs))
    key = np.repeat(place, np.concatenate(sizes)) * len(known) + np.concatenate(codes)
    by_key = np.argsort(key, kind="stable")
    key = key[by_key]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    place, code = np.divmod(key[first], len(known))
    return lang, coded.dictionary.take(order), in_docs, np.bincount(place, minlength=len(order)), list(known), code, np.add.reduceat(np.concatenate(counts)[by_key], first)


def merged(batches) -> Iterator[tuple]:
    """(lang, terms, docs, sizes, names, codes, counts), added up over all runs, terms in order.

    Chunks arrive in the order of (lang, first) and wait in a heap by their next term. When ``WINDOW``
    postings have come together, everything below the first term of the next chunk is complete: the chunks
    are popped, their stretches below that term are added up as arrays, and what is left goes back.
    """
    known: dict[str, int] = {}
    heap: list[tuple] = []

    def drain(limit):
        lang, parts = None, []
        while heap and (limit is None or heap[0][:2] < limit):
            now, _, number, chunk = heapq.heappop(heap)
            if parts and now != lang:
                yield added(lang, parts, known)
                parts = []
            lang = now
            parts.append(chunk.take(limit[1] if limit and limit[0] == now else None))
            if chunk.at < len(chunk.terms):
                heapq.heappush(heap, (now, chunk.terms[chunk.at].as_py(), number, chunk))
        if parts:
            yield added(lang, parts, known)

    number = waiting = 0
    for batch in slices(batches, "codes"):
        heads = zip(batch.column("lang").to_pylist(), batch.column("first").to_pylist(), strict=True)
        for i, (lang, first) in enumerate(heads):
            if waiting >= WINDOW:
                yield from drain((lang, first))
                waiting = 0
            chunk = Chunk(batch, i, known)
            heapq.heappush(heap, (lang, first, number, chunk))
            number += 1
            waiting += len(chunk.codes)
    yield from drain(None)


def merge_rounds(runs: DataFrame, fan_in: int) -> DataFrame:
    """``runs`` merged in groups until no more than ``fan_in`` are left."""
    while (n := runs.select("run").distinct().count()) > fan_in:
        groups = -(-n // fan_in)

        def step(batches):
            for (shard, group), part in by_head(batches, ("shard", "run")):
                for lang, terms, *rest in merged(part):
                    yield from chunked(group, lang, np.full(len(terms), shard), terms.to_pylist(), *rest)

        grouped = runs.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(groups)))
        n_parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        runs = stored(grouped.repartition(n_parts, "shard", "run").sortWithinPartitions("shard", "run", "lang", "first").mapInArrow(step, RUNS), "audit-runs")
    return runs


def by_head(batches, names: tuple[str, ...]) -> Iterator[tuple]:
    """(values of ``names``, batches) for each stretch of rows equal in them; each must be read to its end."""
    batches = iter(batches)
    pending = next(batches, None)

    def key_at(batch, i):
        return tuple(batch.column(c)[i].as_py() for c in names)

    def stretch(key):
        nonlocal pending
        while pending is not None:
            end = 0
            while end < pending.num_rows and key_at(pending, end) == key:
                end += 1
            if end:
                yield pending.slice(0, end)
            if end < pending.num_rows:
                pending = pending.slice(end)
                return
            pending = next(batches, None)

    while pending is not None:
        if not pending.num_rows:
            pending = next(batches, None)
            continue
        key = key_at(pending, 0)
        yield key, stretch(key)


def frequencies(docs: DataFrame, min_docs: int, block_bytes: int, fan_in: int = FAN_IN) -> DataFrame:
    """(lang, term, source, n, total, lead) of terms in at least ``min_docs`` documents of their language.

    ``total`` is the term's count in the language; ``lead`` is 1 in one row of each term, else 0.
    """
    # small shards: a task's chunks come in few Arrow batches, which it holds whole
    shards = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = merge_rounds(stored(runs_of(docs, shards, block_bytes), "audit-runs"), fan_in)

    def keep(batches):
        for lang, terms, in_docs, sizes, names, codes, counts in merged(batches):
            kept = np.flatnonzero(in_docs >= min_docs)
            if not len(kept):
                continue
            place = np.repeat(np.arange(len(terms)), sizes)
            starts = np.cumsum(sizes) - sizes
            chosen = np.flatnonzero(in_docs[place] >= min_docs)
            total = np.add.reduceat(counts, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(chosen)), terms.take(pa.array(place[chosen])), pa.array(names).take(pa.array(codes[chosen])), pa.array(counts[chosen]),
                 pa.array(total[place[chosen]]), pa.array((chosen == starts[place[chosen]]).astype(np.int32))],
                ["lang", "term", "source", "n", "total", "lead"])

    dealt = runs.drop("run").repartition(shards, "shard").sortWithinPartitions("lang", "first")
    return stored(dealt.mapInArrow(keep, FREQUENCIES), "audit-frequencies")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), exact for any count."""
    wide = F.lit(1_000_000_000).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + 1)
    return F.call_function("div", wide, (total + terms).cast("decimal(20,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of all p with all q along the last axis."""
    d = p[..., :, None] - q[..., None, :]
    return d * d // q[..., None, :]


def corrections(p: np.ndarray, z: np.ndarray, q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What pairs that both have a term add to what each of the two adds alone; z and y are the shares of a term they lack."""
    return gaps(p, q) - gaps(p, y) - gaps(z, q) + gaps(z, y)


class PairSums:
    """Sums (lang, i, j) over terms, as one matrix a language or in blocks that leave when too many are held."""

    def __init__(self):
        self.whole: dict = {}
        self.blocks: dict = {}

    def add(self, lang: str, sources: int, i: np.ndarray, p: np.ndarray, z: np.ndarray) -> None:
        """Terms by rows, the sources that have them by columns: their numbers, shares and shares of a term they lack."""
        # a sum over all terms fits a long, and so do differences of such sums
        if sources <= MATRIX:
            sums = self.whole.setdefault(lang, np.zeros((sources, sources), np.int64))
            step = max(1, 500_000 // i.shape[1] ** 2)
            for at in range(0, len(i), step):
                part, found = i[at : at + step], corrections(*(x[at : at + step] for x in (p, z, p, z)))
                if i.shape[1] == sources:  # each term has every source, in order
                    sums += found.sum(axis=0)
                else:
                    np.add.at(sums, (part[:, :, None], part[:, None, :]), found)
            return
        for own, share, zero in zip(i, p, z, strict=True):
            cuts = [0, *(np.flatnonzero(np.diff(own // SIDE)) + 1).tolist(), len(own)]
            parts = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            for a in parts:
                for b in parts:
                    block = self.blocks.setdefault((lang, int(own[a][0] // SIDE), int(own[b][0] // SIDE)), np.zeros((SIDE, SIDE), np.int64))
                    block[np.ix_(own[a] % SIDE, own[b] % SIDE)] += corrections(share[a], zero[a], share[b], zero[b])

    def out(self, all_of_them: bool) -> Iterator[pa.RecordBatch]:
        if all_of_them or len(self.blocks) >= HELD:
            for (lang, a, b), block in self.blocks.items():
                yield from self._rows(lang, block, a * SIDE, b * SIDE)
            self.blocks.clear()
        if all_of_them:
            for lang, sums in self.whole.items():
                yield from self._rows(lang, sums, 0, 0)

    @staticmethod
    def _rows(lang: str, sums: np.ndarray, a: int, b: int) -> Iterator[pa.RecordBatch]:
        x, y = np.nonzero(sums)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x)), pa.array(x + a), pa.array(y + b), pa.array(sums[x, y])], ["lang", "i", "j", "value"])


def pair_corrections(batches) -> Iterator[pa.RecordBatch]:
    """Partial sums (lang, i, j, value) over the terms that the sources i and j of a language both have.

    Rows come in the order of (lang, term, i) with the language's number of sources, the source's number
    i, its share p of the term and its share z of a term it lacks. A term may go on in the next batch.
    """
    sums, held = PairSums(), None
    names = ("lang", "term", "sources", "i", "p", "z")

    def take(table: pa.Table) -> None:
        lang, term = (table.column(c).combine_chunks().dictionary_encode() for c in names[:2])
        words = lang.dictionary.to_pylist()
        lang, term = (x.indices.to_numpy() for x in (lang, term))
        sources, i, p, z = (table.column(c).to_numpy() for c in names[2:])
        starts = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]))))
        sizes = np.diff(np.append(starts, len(term)))
        kind = lang[starts].astype(np.int64) << 32 | sizes  # terms of one language with as many sources
        for k in np.unique(kind).tolist():
            at = starts[kind == k][:, None] + np.arange(k & 0xFFFFFFFF)
            sums.add(words[k >> 32], int(sources[at[0, 0]]), i[at], p[at], z[at])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch.select(names)])
        table = table if held is None else pa.concat_tables([held, table])
        lang, term = table.column("lang"), table.column("term")
        last = table.num_rows
        same = pc.and_(pc.equal(lang, lang[-1]), pc.equal(term, term[-1])).to_numpy()
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if last:
            take(table.slice(0, last))
            yield from sums.out(False)
        held = table.slice(last)
    if held is not None:
        take(held)
    yield from sums.out(True)


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, block_bytes: int = 1 << 26) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs(text, lang, source)``.

    Terms are runs of letters, ASCII ones lower-cased, and of signs beyond ASCII. A language keeps the V
    terms of at least ``min_docs`` of its documents. Every (lang, source) group, and each language, gives a
    kept term with n occurrences there the share p = 1 + floor(10^9 (n + 1) / (N + V)), N being its occurrences
    of kept terms. Part ``pair`` sums floor((p - q)^2 / q) over all kept terms for every other source of the
    language (item), whose share is q; 0 without kept terms. Part ``term`` has that value for the terms the
    group holds with a share above the language's, up to rank ``top``. Ranks count from 1 by value
    descending, item ascending by UTF-8. Sums are exact.

    Null texts, languages and sources are ''. Every row is a document, repeated rows too; other columns
    are not read; no rows give none. ``block_bytes`` bounds what a task holds of the index; the result
    does not depend on it. The pair part has as many rows as a language has ordered pairs of sources.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = frequencies(rows, min_docs, block_bytes)
    langs = found.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("lead").alias("terms"))
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = stored(
        rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
        .na.fill(0, ["own_n", "all_n", "terms"])
        .withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
        .withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
        .withColumn("z", F.when(F.col("terms") > 0, share(F.lit(0), F.col("own_n"), F.col("terms")))), "audit-groups")
    marked = stored(found.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", "sources", "i", "z", share(F.col("n"), F.col("own_n"), F.col("terms")).alias("p"),
        share(F.col("total"), F.col("all_n"), F.col("terms")).alias("q")), "audit-shares")

    def exact(c: Column) -> Column:
        return c.cast("decimal(38,0)")

    # all terms as if both sources lacked them; then terms one of the two has; then those both have
    one, two = groups.alias("one"), groups.alias("two")
    pairs = one.join(two, F.expr("one.lang = two.lang and one.i <> two.i")).select(
        "one.lang", "one.i", F.col("two.i").alias("j"), F.col("one.z").alias("z"), F.col("two.z").alias("y"), "one.terms")
    base = pairs.select("lang", "i", "j", F.coalesce(exact(F.col("terms")) * exact(gap(F.col("z"), F.col("y"))), F.lit(0)).cast("decimal(38,0)").alias("value"))
    steps = stored(marked.groupBy("lang", "i", "z", "p").agg(F.count(F.lit(1)).alias("n")), "audit-steps")
    others = groups.select("lang", F.col("i").alias("j"), F.col("z").alias("y"))
    sided = steps.join(others, "lang").where("i <> j").groupBy("lang", "i", "j").agg(
        F.sum(exact(F.col("n") * (gap(F.col("p"), F.col("y")) - gap(F.col("z"), F.col("y"))))).alias("left"),
        F.sum(exact(F.col("n") * (gap(F.col("y"), F.col("p")) - gap(F.col("y"), F.col("z"))))).alias("right"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = marked.select("lang", "term", "sources", "i", "p", "z").repartition(shards, "lang", "term").sortWithinPartitions("lang", "term", "i").mapInArrow(
        pair_corrections, "lang string, i long, j long, value long").where("i <> j")
    summed = base.unionAll(sided.select("lang", "i", "j", F.col("left").cast("decimal(38,0)"))).unionAll(
        sided.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), F.col("right").cast("decimal(38,0)"))).unionAll(
        both.select("lang", "i", "j", exact(F.col("value")))).groupBy("lang", "i", "j").agg(F.sum("value").cast("long").alias("value"))
    names = groups.select("lang", "i", "source")
    pair = summed.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    part = Window.partitionBy("lang", "source", "salt").orderBy(F.desc("value"), "item")
    terms = marked.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    # first within slices of a group, so a group of any size leaves a bounded number of rows for the last ranking
    nearly = terms.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(32))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = nearly.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(best)).unionAll(ranked)
