"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact confirmation.

1. One pass reduces a document to its number of distinct shingles, a digest of the set and a signature of
   ``hashes`` minima, 8 bits of each. Equal digests form a class; from here on a class is one representative.
2. Bands of ``rows`` minima give candidate buckets; their number follows from the chosen miss probability.
3. Buckets are compared as stars first: every member with the smallest member. Signatures are compared batch
   by batch, and a pair is dropped once the posterior probability that its similarity reaches the threshold
   is below ``miss``. Survivors are confirmed on the full sets, read again from the texts.
4. Members of a bucket that are linked by now need no comparison. Those outside its largest component are
   compared with all others of the bucket, in blocks of bounded size: a first pass over signatures keeps the
   members with a surviving partner in another component, a second one confirms on their full sets inside the
   task and writes one link per member and component. No cap: blocks cover every pair between components; no
   pairs are written, a pair is looked at in the first band it shares only.
5. Links are merged into components by alternating large and small stars.

Defined results: null or empty texts have an empty set, are linked with nothing and are kept; texts of fewer
words than a shingle are one shingle; repeated rows fall into one class; a null id stands for no class and is
never a component's id if another row of the class has one; an empty table gives an empty table; other columns
pass through ``keep_one`` untouched whatever their names. Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, discard, materialise, restored


@dataclass(frozen=True)
class Near:
    #: Per cent of the union that the intersection must hold.
    percent: int = 80
    shingle: int = 5
    hashes: int = 256
    rows: int = 5
    #: Chance that a pair at the threshold meets in no band, and that one batch drops it.
    miss: float = 1e-7
    batch: int = 32
    #: Members of a bucket in one block, and bytes of their compressed texts.
    block: int = 512
    block_bytes: int = 4 << 20

    @property
    def bands(self) -> int:
        n = math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))
        if n * self.rows > self.hashes:
            raise ValueError(f"{n} bands of {self.rows} rows need more than {self.hashes} hashes")
        return n


MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHash(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, size: int, known: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z is lower-cased, words end at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(w) < size:
        w = np.array([xxhash.xxh3_64_intdigest(w.tobytes(), len(w))], np.uint64)
        return w
    out = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):  # order counts: each step multiplies what came before
        out = (out ^ w[k : k + len(out)]) * MIX[k % len(MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**32, hashes, np.uint32) | np.uint32(1), rng.integers(0, 2**32, hashes, np.uint32)


def signature(h: np.ndarray, mul: np.ndarray, xor: np.ndarray) -> bytes:
    low = (h >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(low), 1024):
        np.minimum(best, ((low[lo : lo + 1024, None] ^ xor) * mul).min(axis=0), out=best)
    # The minima of large sets are small numbers: their low bits tell them apart.
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype("u1").tobytes()


def sketches(docs: DataFrame, how: Near, id_col: str, text_col: str) -> DataFrame:
    """Id, ``n_shingles``, ``digest`` and ``sig`` (both null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (mul, xor) = WordHash(), functions(how.hashes)
        for batch in batches:
            n, digest, sig = [], [], []
            for value in batch.column(1):
                h = shingles(value.as_py(), how.shingle, known)
                n.append(len(h))
                digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sig.append(signature(h, mul, xor) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def least_matches(how: Near) -> np.ndarray:
    """Matches needed after each batch so that, from a flat prior, the similarity may still reach the threshold.

    P(s >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    t, out = how.percent / 100, []
    t += (1 - t) / 256  # bytes of different minima agree by chance
    for n in range(how.batch, how.hashes + 1, how.batch):
        tail, m = 0.0, -1
        while tail < how.miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survives(a: np.ndarray, b: np.ndarray, how: Near, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows of ``a`` and ``b`` (pairs of signatures) that no batch dropped, and their matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        cut = slice(k * how.batch, (k + 1) * how.batch)
        matches = matches + (a[alive, cut] == b[alive, cut]).sum(axis=1)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    return alive, matches


def bayes_prune(pairs: DataFrame, sigs: DataFrame, how: Near) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose signatures pass the sequential test."""
    left = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    right = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * how.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(how)
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(-1, how.hashes) for c in (2, 3))
            alive = pa.array(survives(a, b, how, least)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(alive), batch.column(1).take(alive)], ["a", "b"])

    return pairs.join(left, "b").join(right, "a").filter(fits).select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def packed_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rep``, compressed text ``z`` and its length ``bytes`` of the documents in ``wanted`` (rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [None if (t := v.as_py()) is None else zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["rep", "z"])

    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).mapInArrow(run, "rep long, z binary")
    return rows.join(wanted, "rep", "left_semi").dropDuplicates(["rep"]).withColumn("bytes", F.length("z"))


def unpacked(z: bytes | None, how: Near, known: WordHash) -> np.ndarray:
    return shingles(zlib.decompress(z).decode("utf-8", "surrogatepass") if z else None, how.shingle, known)


def confirm(pairs: DataFrame, texts: DataFrame, how: Near) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    one = texts.select(F.col("rep").alias("a"), F.col("z").alias("z_a"))
    other = texts.select(F.col("rep").alias("b"), F.col("z").alias("z_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, of_last = WordHash(), None, None
        for batch in batches:
            good = []
            for a, z_a, z_b in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, of_last = a, unpacked(z_a.as_py(), how, known)
                h = unpacked(z_b.as_py(), how, known)
                both = len(np.intersect1d(of_last, h, assume_unique=True))
                good.append(100 * both >= how.percent * (len(of_last) + len(h) - both))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    return pairs.join(other, "b").join(one, "a").select("a", "b", "z_a", "z_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b); the component is its smallest node."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    while True:
        # Large star: every node's larger neighbours point to its smallest one.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


class Block:
    """Members of one bucket's block as arrays."""

    def __init__(self, column: pa.Array, how: Near):
        flat = column.flatten()
        self.id, self.part = flat.field("rep").to_numpy(), flat.field("component").to_numpy()
        self.sig = np.frombuffer(b"".join(flat.field("sig").to_pylist()), "u1").reshape(-1, how.hashes)
        self.band = self.sig[:, : how.bands * how.rows].reshape(len(self.id), how.bands, how.rows)
        self.z = flat.field("z")


def partners(few: Block, k: int, every: Block, band: int, how: Near, least: np.ndarray) -> np.ndarray:
    """Members of ``every`` in another component that survive against member ``k`` and share no earlier band with it."""
    other = np.flatnonzero(every.part != few.part[k])
    other = other[survives(np.broadcast_to(few.sig[k], (len(other), how.hashes)), every.sig[other], how, least)[0]]
    shared = (every.band[other] == few.band[k]).all(axis=2)
    return other[shared.argmax(axis=1) == band]


def blocks(rows: DataFrame, payload: DataFrame, how: Near) -> DataFrame:
    """(band, few, all): per open bucket each block of members outside its largest component with each block of all members.

    ``rows`` (key, band, rep, component, bytes) are dealt to blocks first and get ``payload`` (rep, sig, z) then, so a
    bucket's members never meet in one task; blocks are bounded in members and bytes.
    """
    per = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    keys = per.groupBy("key").agg(
        F.max(F.struct("n", "component"))["component"].alias("largest"), F.sum("n").alias("members"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("parts")
    )
    n_parts = F.greatest(F.col("members") / how.block, F.col("bytes") / how.block_bytes)
    keys = keys.filter("parts > 1").select("key", "largest", (n_parts + 1).cast("int").alias("n_parts"))
    dealt = rows.drop("bytes").join(keys, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("n_parts")).cast("int")).join(payload, "rep")
    # Spread by bucket and block: the join above has put a bucket's rows together.
    dealt = dealt.repartition("key", "part")
    member = F.struct("rep", "component", "sig", "z")
    every = dealt.groupBy("key", "part").agg(F.collect_list(member).alias("all"))
    few = dealt.filter(F.col("component") != F.col("largest")).groupBy("key", "part", "band", "n_parts").agg(F.collect_list(member).alias("few"))
    # A copy for every block of the bucket, so that the bucket's blocks meet in many tasks.
    few = few.drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    return few.join(every, ["key", "part"]).select("key", "band", "few", "all")


def open_rows(multi: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of ``multi`` in buckets of several components, with component."""
    rows = multi.select("key", "band", "rep").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    rows = rows.withColumn("component", F.coalesce("component", "rep"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return rows.join(mixed, "key", "left_semi")


def alive_rows(rows: DataFrame, sigs: DataFrame, how: Near) -> DataFrame:
    """(key, rep) with a partner in another component that the sequential test does not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(how)
        for batch in batches:
            keys, ids = [], []
            for i in range(len(batch)):
                few, every = (Block(batch.column(c).slice(i, 1), how) for c in (2, 3))
                alive: set[int] = set()
                for k in range(len(few.id)):
                    near = partners(few, k, every, batch.column(1)[i].as_py(), how, least)
                    alive.update([int(few.id[k]), *every.id[near].tolist()] if len(near) else ())
                keys += [batch.column(0)[i].as_py()] * len(alive)
                ids += alive
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], ["key", "rep"])

    payload = sigs.select("rep", "sig", F.lit(None).cast("binary").alias("z"))
    return blocks(rows.withColumn("bytes", F.lit(how.hashes)), payload, how).mapInArrow(run, "key long, rep long").distinct()


def links_of_rest(rows: DataFrame, payload: DataFrame, how: Near) -> DataFrame:
    """Links between the components of a bucket, confirmed on full sets: one per member and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, known = least_matches(how), WordHash()
        for batch in batches:
            a, b = [], []
            for i in range(len(batch)):
                few, every = (Block(batch.column(c).slice(i, 1), how) for c in (2, 3))
                sets: dict[int, np.ndarray] = {}
                of_few: dict[int, np.ndarray] = {}
                for k in range(len(few.id)):
                    near = partners(few, k, every, batch.column(1)[i].as_py(), how, least)
                    if not len(near):
                        continue
                    for x in near.tolist():
                        if x not in sets:
                            sets[x] = unpacked(every.z[x].as_py(), how, known)
                    own = of_few.setdefault(k, unpacked(few.z[k].as_py(), how, known))
                    sizes = np.array([len(sets[x]) for x in near.tolist()])
                    flat = np.concatenate([sets[x] for x in near.tolist()])
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    both = np.add.reduceat(own[at] == flat, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
                    near = near[100 * both >= how.percent * (len(own) + sizes - both)]
                    near = near[np.unique(every.part[near], return_index=True)[1]]
                    a += [int(few.id[k])] * len(near)
                    b += every.id[near].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return blocks(rows, payload, how).mapInArrow(run, "a long, b long").distinct()


def near_components(docs: DataFrame, how: Near | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``."""
    how = how or Near()
    sketch = materialise(sketches(docs, how, id_col, text_col), "sketches")
    classes = materialise(sketch.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = sketch.filter("digest is not null").select(F.col("doc_id").alias("rep"), "digest", "n_shingles", "sig").dropDuplicates(["rep", "digest"])
    sigs = materialise(reps.join(classes.select("rep", "digest"), ["rep", "digest"], "left_semi").select("rep", "n_shingles", "sig"), "signatures")

    keys = F.array(*[F.xxhash64(F.lit(j), F.substring("sig", 1 + j * how.rows, how.rows)) for j in range(how.bands)])
    bands = sigs.select("rep", F.posexplode(keys).alias("band", "key"))
    heads = bands.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("other")).filter("head <> other")
    multi = materialise(bands.join(heads.select("key", "head"), "key"), "buckets")
    texts = materialise(packed_texts(docs, multi.select("rep").distinct(), id_col, text_col), "texts")

    stars = multi.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    first = materialise(confirm(bayes_prune(stars, sigs, how), texts, how), "links")
    rows = materialise(open_rows(multi, components(first)), "bucket-rows")
    alive = rows.join(alive_rows(rows, sigs, how), ["key", "rep"], "left_semi").join(texts.select("rep", "bytes"), "rep")
    second = materialise(links_of_rest(alive, sigs.select("rep", "sig").join(texts.select("rep", "z"), "rep"), how), "links")
    parts = materialise(components(first.unionByName(second)), "components")
    discard(sigs, multi, texts, first, second, rows)

    of_class = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    # Texts without a set stand apart: their null digests would meet in one task.
    sets = sketch.filter("digest is not null").select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left").drop("digest")
    out = sets.unionByName(sketch.filter("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def keep_one(docs: DataFrame, how: Near | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near duplicates of a document with a smaller id; rows that share an id are one document and stay together."""
    gone = near_components(docs, how, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = aside(docs, id=F.col(id_col).cast("long"))
    return restored(rows.join(gone, F.col("id") == F.col("gone"), "left_anti"), docs.columns)
