"""MinHash near-dedup with sequential Bayesian verification.

Texts with the same words are one class. Each class is signed once; bands of its signature are buckets.
Within a bucket classes meet the bucket's smallest class first. What is still unconnected is compared with
all other members of its bucket in blocks: at first only the likeliest partner of each is verified, as
members of a group of copies mostly hang on one original, then all that remains, within the blocks. Pairs compare their signatures batch by batch and are dropped as
soon as the posterior chance of reaching the threshold falls below the miss probability; survivors are
verified on their whole shingle sets. Only links that connect are kept, so a group of thousands of copies
gives a row for each member and not for each pair.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.llm.common import ascii_lower, components, slices, stored

HASHES, ROWS, BATCH = 150, 5, 25
MISS = 1e-6
BLOCK = 512
SEED = 20240229


def normal_words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased, each followed by one space."""
    return F.ltrim(F.regexp_replace(F.concat(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[\x20\x09-\x0D]+", " "))


def shingle_hashes(normal: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence if it has fewer words."""
    data = normal.encode()
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = [0, *ends[:-1].tolist()]
    if len(ends) < width:
        return np.array([xxhash.xxh3_64_intdigest(data)], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(data[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)), np.uint64, len(ends) - width + 1))


def parameters(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        part = shingles[at : at + 256, None] * a + b
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def bounds(threshold: float, miss: float, n: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on): below, the posterior chance of a similarity of
    ``threshold`` or more is under ``miss``. The prior is uniform, the posterior a beta distribution."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for k in range(batch, n + 1, batch):
        for m in range(k + 1):
            like = m * np.log(grid) + (k - m) * np.log1p(-grid)
            like = np.exp(like - like.max())
            if like[grid >= threshold].sum() / like.sum() >= miss:
                out.append((k, m))
                break
    return out


def survivors(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Places of the rows whose signatures pass every batch."""
    live, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for k, least in steps:
        matches[live] += (left[live, done:k] == right[live, done:k]).sum(axis=1)
        live, done = live[matches[live] >= least], k
    return live


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, miss: float = MISS) -> DataFrame:
    """``docs(doc_id, text, ...)`` with n_shingles, component_id and kept added.

    Two texts are linked if 100 * shared >= ``percent`` * united shingles of ``width`` words. A text without
    words has no shingles and is linked with nothing. ``component_id`` is the smallest doc_id reachable;
    rows with the same words are always together, rows that share only a doc_id are not. A row without
    doc_id links as any other and is never the representative unless its component has no doc_id at all:
    then component_id is null and every row is kept. Rows with words that repeat the smallest doc_id are
    all kept. A pair at the threshold shares no band with a chance of at most ``miss``: the lower
    ``percent``, the more bands. Columns named like the new ones are replaced; no rows give none.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_shingles", "component_id", "kept")
    threshold = percent / 100
    n_hashes = ROWS * bands_for(threshold, miss)
    steps = bounds(threshold, miss, n_hashes)
    a, b = parameters(n_hashes)
    normal = normal_words(F.col("text"))
    cls = F.unhex(F.md5(normal))

    def sign(batches):
        for batch in slices(batches, "normal"):
            known: dict[bytes, tuple] = {}
            rows = []
            for key, text in zip(batch.column("cls").to_pylist(), batch.column("normal").to_pylist(), strict=True):
                if key not in known:
                    shingles = shingle_hashes(text, width)
                    sig = signature(shingles, a, b) if len(shingles) else np.zeros(0, np.uint32)
                    bands = [xxhash.xxh3_64_intdigest(sig[i : i + ROWS].tobytes(), seed=i) - 2**63 for i in range(0, len(sig), ROWS)]
                    known[key] = (len(shingles), sig.tobytes(), bands)
                rows.append(known[key])
            n, sigs, bands = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("cls"), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "cls", "n_shingles", "sig", "bands"])

    id_type = dict(docs.dtypes)["doc_id"]
    signed = stored(docs.select("doc_id", cls.alias("cls"), normal.alias("normal")).mapInArrow(
        sign, f"doc_id {id_type}, cls binary, n_shingles long, sig binary, bands array<long>"), "signed")
    classes = stored(signed.where("n_shingles > 0").groupBy("cls").agg(F.first(F.struct("n_shingles", "sig", "bands")).alias("x"), F.min("doc_id").alias("least")).select(
        "cls", "least", "x.*"), "classes")

    # buckets of one member go; in the others each member meets the smallest
    members = classes.select("cls", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    centres = members.groupBy("bucket").agg(F.min("cls").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(members.join(centres, "bucket"), "buckets")
    pairs = shared.where("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct()
    texts = docs.select("text", F.col("doc_id").alias("of"))
    links = stored(_verified(_signed_pairs(pairs, classes, steps, threshold), classes, texts, percent, width), "links")
    likeliest = _rest_pairs(_mixed(shared, components(links)), classes, steps, threshold)
    links = stored(links.unionAll(_verified(likeliest, classes, texts, percent, width)), "links")
    mixed = _mixed(shared, components(links))
    sets_of = _shingle_sets(mixed.select("cls").distinct(), classes, texts, width)
    roots = components(links.unionAll(_rest_pairs(mixed, classes, steps, threshold, sets_of, percent)))

    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(smallest, "root").select("cls", "component_id")
    out = signed.select("doc_id", "cls", "n_shingles").join(by_class, "cls", "left").select(
        "doc_id", "cls", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    return out.drop("cls") if docs.columns == ["doc_id", "text"] else _joined(docs, out)


def _joined(docs: DataFrame, out: DataFrame) -> DataFrame:
    facts = out.groupBy("doc_id", "cls").agg(*(F.first(c).alias(c) for c in ("n_shingles", "component_id", "kept")))
    own = F.unhex(F.md5(normal_words(docs["text"])))
    return docs.join(facts, docs["doc_id"].eqNullSafe(facts["doc_id"]) & (own == facts["cls"]), "left").select(
        *[docs[c] for c in docs.columns], *[facts[c] for c in ("n_shingles", "component_id", "kept")])


def _signed_pairs(pairs: DataFrame, classes: DataFrame, steps: list, threshold: float) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""
    sigs = classes.select("cls", "sig", "n_shingles")
    both = pairs.join(sigs.select(F.col("cls").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na")), "a").join(
        sigs.select(F.col("cls").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb")), "b").where(
        F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)

    def compare(batches):
        for batch in slices(batches, "sa"):
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                live = pa.array(survivors(left, right, steps))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(live) for c in "ab"], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a binary, b binary")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs that reach the threshold on their whole shingle sets, as edges(a, b)."""
    pairs = stored(pairs, "candidates")
    need = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
    sets_of = _shingle_sets(need, classes, texts, width)

    def confirm(batches):
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)) if linked(x.as_py(), y.as_py(), percent)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in "ab"], ["a", "b"])

    return pairs.join(sets_of.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets_of.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(confirm, "a binary, b binary")


def linked(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sorted shingle sets reach the threshold."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _shingle_sets(need: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(cls, shingles) of the classes in ``need``, from the text of one of their documents."""
    owner = classes.select("cls", F.col("least").alias("of")).join(need, "cls")

    def sets(batches):
        for part in slices(batches, "normal"):
            # rows that share the doc_id and not the words are of another class
            own = [(c, t) for c, t in zip(part.column("cls").to_pylist(), part.column("normal").to_pylist(), strict=True) if hashlib.md5(t.encode()).digest() == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.binary()), pa.array([shingle_hashes(t, width).tobytes() for _, t in own], pa.binary())], ["cls", "shingles"])

    # met by doc_id, so that only the texts asked for are normalised
    mine = texts.join(owner, texts["of"].eqNullSafe(owner["of"])).select("cls", normal_words(F.col("text")).alias("normal"))
    return stored(mine.mapInArrow(sets, "cls binary, shingles binary").dropDuplicates(["cls"]), "shingles")


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with the number of blocks on either side."""
    rooted = shared.where("size > 2").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        "band", "bucket", "cls", F.coalesce("root", "cls").alias("root"))
    sizes = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    return stored(rooted.join(mixed, "bucket").withColumns({
        "lefts": F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int"), "rights": F.ceil(F.col("size") / BLOCK).cast("int"), "h": F.xxhash64("cls")}), "mixed")


def _rest_pairs(live: DataFrame, classes: DataFrame, steps: list, threshold: float, sets_of: DataFrame | None = None, percent: int = 0) -> DataFrame:
    """Pairs within the buckets of ``live`` that are not connected yet.

    A bucket's largest component is left out on one side: its members need not meet each other. The
    others meet everybody, in blocks, where pairs are compared in place, in the first of the bands that
    the two share. With ``sets_of`` they are verified there too and each class gives one link to every
    component of its block that it reaches; without, each gives the likeliest partner it has.
    """
    likeliest = sets_of is None
    left = live.where("root <> main").select("bucket", F.pmod("h", F.col("lefts")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), "band", "cls", "root", F.lit(True).alias("probe"))
    right = live.select("bucket", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), F.pmod("h", F.col("rights")).cast("int").alias("j"), "band", "cls", "root", F.lit(False).alias("probe"))
    rows = left.unionAll(right).join(classes.select("cls", "sig", "n_shingles"), "cls")
    rows = rows.withColumn("shingles", F.lit(None).cast("binary")) if likeliest else rows.join(sets_of, "cls")
    parts = max(1, int(live.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(batches):
        for group in groups_of(batches, ["bucket", "i", "j"]):
            probe = group.column("probe").to_numpy(zero_copy_only=False)
            keys, roots, sets = group.column("cls").to_pylist(), group.column("root").to_pylist(), group.column("shingles")
            n = group.column("n_shingles").to_numpy()
            code = {r: k for k, r in enumerate(dict.fromkeys(roots))}
            root = np.array([code[r] for r in roots])
            sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(len(keys), -1)
            p, q = np.flatnonzero(probe), np.flatnonzero(~probe)
            band, found = group.column("band")[0].as_py(), set()
            for x in p.tolist():
                y = q[(root[q] != root[x]) & (np.minimum(n[q], n[x]) >= threshold * np.maximum(n[q], n[x]) - 1e-9)]
                live = y[survivors(np.broadcast_to(sigs[x], (len(y), sigs.shape[1])), sigs[y], steps)]
                same = sigs[live] == sigs[x]
                first = same.reshape(len(live), sigs.shape[1] // ROWS, ROWS).all(axis=2).argmax(axis=1) == band
                live, matches = live[first], same[first].sum(axis=1).tolist()
                if likeliest:
                    found.update([max((m, keys[x], keys[k]) for m, k in zip(matches, live.tolist(), strict=True))] if matches else [])
                else:
                    reached: set[int] = set()
                    for k in live.tolist():
                        if root[k] not in reached and linked(sets[x].as_py(), sets[k].as_py(), percent):
                            reached.add(root[k])
                            found.add((0, keys[x], keys[k]))
            if found:
                m, a, b = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(m, pa.int32())], ["a", "b", "m"])

    out = dealt.select("bucket", "i", "j", "band", "cls", "root", "probe", "sig", "n_shingles", "shingles").mapInArrow(compare, "a binary, b binary, m int")
    if likeliest:
        return out.groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b"))
    return out.select("a", "b")


def groups_of(batches, by: list[str]):
    """Tables of rows with equal ``by`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[at] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(at, end - at))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def miss_at(similarity: float, bands: int = HASHES // ROWS) -> float:
    """Chance that a pair of this similarity shares no band."""
    return (1 - similarity**ROWS) ** bands


def bands_for(threshold: float, miss: float = MISS) -> int:
    """Bands with which a pair at ``threshold`` shares none with a chance of at most ``miss``, never under the usual number."""
    if threshold >= 1:
        return HASHES // ROWS
    return max(HASHES // ROWS, math.ceil(math.log(miss) / math.log1p(-(threshold**ROWS))))
