"""Near-duplicate detection by DartMinHash signatures, banded joins and exact verification.

Each occurrence of a shingle (five words) is an element of weight one on its own layer, so the similarity is the
weighted Jaccard of shingle counts. Elements throw darts: a region of rank and weight holds a Poisson number of
darts that depends on the element alone, each with a rank and a coordinate. The signature keeps the earliest dart of each
coordinate. Regions double in rank from level to level, and a document stops when all coordinates
are hit, so large documents look at the first regions only and small ones at many.

Documents of equal words are one representative first. Signatures are cut into bands; representatives that share a
band are a bucket. Buckets of SMALL members at most are compared whole: their signatures meet in one task, and the texts
of those whose signature agrees often enough with another member's follow and are compared by the shingles themselves. In larger buckets all pairs
would be too many: each member is compared with the bucket's hub. If SMALL members at most don't belong with the hub
then, these are compared with all others, in blocks. Otherwise all members are dealt anew, to buckets that share one
more band each, for several other bands. So comparisons grow with the members. A pair may be parted by these bands, so
in the end the members of each bucket that was dealt anew meet all those of other classes: their signatures in
blocks, and the texts of those whose signatures agree. Classes are connected components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierloom.llm.components import components
from tierloom.llm.shared import Scratch, attach, counted, small_batches, union
from tierloom.llm.words import WORD, Words, buffers, chunks, mix, prefix, spans, words

SHINGLE, SIMILAR = 5, 0.8
#: Pairs as similar as SIMILAR share no band with a chance of (1 - 0.8**4)**24, 3 in a million.
BANDS, ROWS = 24, 4
#: Darts per element in the first level; each level doubles the rank reached so far.
FIRST = 1 / 16
#: Bands that are joined to a band's key in later rounds, counted from it; each adds a band that is new to the key.
OFFSETS = ((1, 5, 9), (2, 7, 12), (3, 10), (4, 13), (6, 11), (8, 15), (14, 17), (16, 19), (18, 21), (20, 22), (23,))
#: Bucket size up to which all members are compared, and size of the blocks of a larger bucket that are compared with its few others.
SMALL, BLOCK = 256, 256
#: Size of the blocks in which signatures alone meet.
SIGNATURES = 2048
#: Coordinates in which two signatures must agree for the shingles to be compared: pairs as similar as SIMILAR have fewer with a chance of 1 in a million.
AGREE = 58


def elements(w: Words, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit key) of each shingle occurrence, sorted; the i-th occurrence of a shingle has a key of its own.

    A document of fewer words than a shingle has one element, of all its words; one without words has none.
    """
    sums, n_words = prefix(w.hash, WORD), np.diff(w.first)
    starts = np.arange(max(0, len(w.hash) - SHINGLE + 1))
    starts = starts[w.doc[starts] == w.doc[starts + SHINGLE - 1]] if len(starts) else starts
    doc, key = w.doc[starts], mix(spans(sums, starts, starts + SHINGLE, WORD))
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    doc = np.concatenate([doc, short])
    key = np.concatenate([key, mix(spans(sums, w.first[short], w.first[short + 1], WORD))])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    layer = (np.arange(len(key)) - run).astype(np.uint64)
    key = np.where(layer > 0, mix(key + layer * np.uint64(0xD6E8FEB86659FD93)), key)
    return doc, key


def _poisson(rate: float) -> np.ndarray:
    """Cumulative chances of 0, 1, 2, ... darts."""
    n = np.arange(1, int(rate + 12 * np.sqrt(rate) + 12))
    return np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(rate / n))]) - rate))


def signatures(doc: np.ndarray, key: np.ndarray, n_docs: int, coords: int = BANDS * ROWS) -> np.ndarray:
    """The earliest dart of each coordinate, for documents that have elements: n_docs x coords."""
    empty = np.uint64(2**64 - 1)
    out = np.full((n_docs, coords), empty)
    flat, level, width = out.reshape(-1), 0, FIRST
    while len(doc):
        seed = mix(key + np.uint64((level * 2 + 1) * 0xA0761D6478BD642F % 2**64))
        darts = np.searchsorted(_poisson(width), (seed >> np.uint64(11)) * 2.0**-53, "right")
        hit = np.flatnonzero(darts)
        count = darts[hit]
        number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(np.repeat(seed[hit], count) + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xE7037ED1A0B428DB))
        coord = ((dart & np.uint64(0xFFFFFFFF)) * np.uint64(coords) >> np.uint64(32)).astype(np.int64)
        rank = np.uint64(level << 56) | mix(dart) >> np.uint64(8)
        np.minimum.at(flat, np.repeat(doc[hit], count) * coords + coord, rank)
        level, width = level + 1, FIRST * 2**level
        open_ = (out == empty).any(1)[doc]
        doc, key = doc[open_], key[open_]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    total = np.zeros(parts.shape[:2], np.uint64)
    for r in range(ROWS):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return total.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, hash) to (id, hash, digest of the words, band keys, a byte of each coordinate); texts without words have none."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for low, high in chunks(offsets):
            n = high - low
            w = words(data, offsets, low, high, lower=True)
            signed = signatures(*elements(w, n), n)
            raw = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(low, high)]
            digest = [hashlib.sha256(b" ".join(r.lower().split())).digest()[:16] for r in raw]
            some = np.diff(w.first) > 0
            ends = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands(signed)[some].ravel()))
            sketch = [row.tobytes() for row in (mix(signed) >> np.uint64(56)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), batch.column(2).slice(low, n), pa.array(digest, pa.binary()), lists, pa.array(sketch, pa.binary())], names=["id", "hash", "digest", "bands", "sketch"])


def shingled(ids: np.ndarray, texts: pa.Array) -> dict[int, np.ndarray]:
    """Sorted elements of each text, by id; a text that comes several times is taken once."""
    _, first = np.unique(ids, return_index=True)
    data, offsets = buffers(texts.take(pa.array(first)))
    out = []
    for low, high in chunks(offsets):
        doc, key = elements(words(data, offsets, low, high, lower=True), high - low)
        out += np.split(key, np.searchsorted(doc, np.arange(1, high - low)))
    return dict(zip(ids[first].tolist(), out))


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    small, large = sorted((len(x), len(y)))
    if not large or small < threshold * large:
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same >= threshold * (small + large - same)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, text_a, text_b) to the pairs whose shingles are similar enough."""
        for batch in batches:
            a, b = (np.asarray(batch.column(c)) for c in (0, 1))
            left, right = shingled(a, batch.column(2)), shingled(b, batch.column(3))
            near = [similar(left[x], right[y], threshold) for x, y in zip(a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run


class Bucket:
    """Members of one bucket as they come; `add` gives the members that a new one is linked to.

    Members that are known to be of one class, by their labels or by links found here, aren't compared with each other.
    """

    def __init__(self, threshold: float):
        self.threshold, self.ids, self.sets, self.top = threshold, [], [], []
        self.sketches, self.bands = np.zeros((0, BANDS * ROWS), np.uint8), np.zeros((0, BANDS), np.int64)

    def _root(self, i: int) -> int:
        while self.top[i] != i:
            i = self.top[i]
        return i

    def add(self, rep: int, label: int, elements: np.ndarray, sketch: np.ndarray, bands: np.ndarray, done: np.ndarray, labels: dict[int, int]) -> list[int]:
        """`done`: bands before this bucket's in which the member's bucket is small, so that those who share it are compared there."""
        me = len(self.ids)
        self.top.append(me)
        if label in labels:
            self.top[me] = self._root(labels[label])
        else:
            labels[label] = me
        links = []
        near = (self.sketches == sketch).sum(1) >= AGREE
        if len(done):
            near &= ~(self.bands[:, done] == bands[done]).any(1)
        for i in np.flatnonzero(near).tolist():
            mine, other = self._root(me), self._root(i)
            if mine != other and similar(elements, self.sets[i], self.threshold):
                self.top[max(mine, other)] = min(mine, other)
                links.append(self.ids[i])
        self.ids.append(rep)
        self.sets.append(elements)
        self.sketches = np.concatenate([self.sketches, sketch[None, :]])
        self.bands = np.concatenate([self.bands, bands[None, :]])
        return links


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, rep, label, text, sketch, bands, band, mask) sorted by key to the links within each bucket, a spanning forest of them at least."""
        key, bucket, labels = None, Bucket(threshold), {}
        for batch in batches:
            a, b = [], []
            reps = np.asarray(batch.column(1))
            sets = shingled(reps, batch.column(3))
            keys = np.zeros((len(reps), BANDS), np.int64)
            keys[np.asarray(batch.column(6)) >= 0] = np.asarray(batch.column(5).flatten()).reshape(-1, BANDS)
            rest = (batch.column(c).to_pylist() for c in (0, 2, 4, 6, 7))
            for i, (rep, k, label, sketch, band, mask) in enumerate(zip(reps.tolist(), *rest)):
                if k != key:
                    key, bucket, labels = k, Bucket(threshold), {}
                done = np.array([j for j in range(band) if mask >> j & 1], np.int64)
                found = bucket.add(rep, label, sets[rep], np.frombuffer(sketch, np.uint8), keys[i], done, labels)
                a += [rep] * len(found)
                b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, rep, label, apart, sketch, bands, band, mask) sorted by block to (key, rep, label, band, mask) of members that may belong with one of another label in their block."""

    def met(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        label, apart, mask = (rows.column(c).to_numpy() for c in (3, 4, 8))
        sketches = np.frombuffer(b"".join(rows.column(5).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        keys = rows.column(6).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        band = rows.column(7)[0].as_py()
        found = np.zeros(len(label), bool)
        for i in np.flatnonzero(apart).tolist():
            near = ((sketches == sketches[i]).sum(1) >= AGREE) & (label != label[i])
            done = [j for j in range(band) if mask[i] >> j & 1]  # those who share these bands meet there
            if done and near.any():
                near &= ~(keys[:, done] == keys[i, done]).any(1)
            if near.any():
                found |= near
                found[i] = True
        return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().filter(pa.array(found)) for c in (1, 2, 3, 7, 8)], names=["key", "rep", "label", "band", "mask"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column(0).to_numpy()
        ends = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for low, high in zip(ends, ends[1:]):
            if high > low:
                if held and held[-1].column(0)[0].as_py() != block[low]:
                    yield met(held)
                    held = []
                held.append(batch.slice(low, high - low))
    if held:
        yield met(held)


LINKS = "a long, b long"
AGREEING = "key long, rep long, label long, band int, mask int"


class Buckets:
    """The rounds: small buckets are gathered, large ones are compared with their hubs and dealt anew."""

    def __init__(self, work: Scratch, ids: DataFrame, n_docs: int, reps: DataFrame, threshold: float):
        self.work, self.ids, self.n_docs, self.reps, self.threshold = work, ids, n_docs, reps, threshold
        self.bands = reps.select("rep", "bands")
        self.sketches = reps.where(F.size("bands") > 0).select(F.col("rep").alias("id"), "sketch", "bands")
        self.small: list[DataFrame] = []
        self.blocks: list[DataFrame] = []
        self.links: list[DataFrame] = []
        self.dealt: DataFrame | None = None
        self.tried: DataFrame | None = None
        self.label: DataFrame | None = None

    def run(self) -> DataFrame:
        """All links (a, b) that join the classes."""
        band = self.bands.select("rep", F.posexplode("bands").alias("band", "value"))
        waiting = band.select("rep", "band", F.xxhash64("band", "value").alias("key"))
        for round_ in range(len(OFFSETS) + 1):
            members, n = self._members(waiting, round_)
            if not n:
                break
            if not round_:
                source = self.reps.select("rep", "source.*", "n", "sketch", "bands")
                ends = self.work.save(members.select("rep").distinct().join(source, "rep"), "ends")
                # a shuffled join whatever the size, so that the plan is the same for all; rows that repeat id and text are split by their partitions
                found = attach(self.ids.select("at", "hash", "text"), ends.select("at", "hash", "n"), ["at", "hash"], [F.spark_partition_id()], self.n_docs, how="inner", hint="shuffle_hash")
                texts = found.groupBy("at", "hash").agg(F.max("text").alias("text"))
                self.texts = self.work.save(texts.join(ends, ["at", "hash"]).select(F.col("rep").alias("id"), "text", "sketch", "bands"), "texts")
            # of the first round's buckets the band is known, so that a pair of members is compared in one of them only
            band = F.col("band") if not round_ else F.lit(-1)
            self.small.append(members.where(F.col("n") <= SMALL).select("key", "rep", band.alias("band")))
            large, n_large = self._large(members, round_)
            if not n_large:
                break
            waiting = self._again(large, n_large, round_)
            self.work.release()
            if waiting is None:
                break
        self.work.release()
        if self.small:
            whole = self._compared(union([self._labelled(union(self.small)).withColumnRenamed("mine", "label"), *self.blocks]), "whole")
            self.links.append(whole)
            self.work.release()
        if self.dealt is not None:
            self._parted()
            self.work.release()
        return union(self.links) if self.links else self.work.spark.createDataFrame([], LINKS)

    def _members(self, waiting: DataFrame, round_: int) -> tuple[DataFrame, int]:
        """(key, band, rep, n) of all buckets of two and more."""
        buckets, size = self.work.measured(counted(waiting, ["key"]).where("n > 1"), f"buckets{round_}", F.sum("n"))
        if not size:
            return waiting, 0
        found = attach(waiting, buckets, ["key"], ["rep"], size, how="inner").select("key", "band", "rep", "n")
        return self.work.save(found, f"members{round_}"), size

    def _large(self, members: DataFrame, round_: int) -> tuple[DataFrame, int]:
        """Large buckets with their hubs: the members whose buckets are largest in all.

        An original shares more bands with its copies than these do with each other, so it is the hub of most of them.
        """
        rows = members.where(F.col("n") > SMALL)
        score = F.sum("n").over(Window.partitionBy("rep")) + F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) / float(1 << 20)
        rows, n_rows = self.work.measured(rows.withColumn("score", score), f"scored{round_}", F.count(F.lit(1)))
        if not n_rows:
            return rows, 0
        hubs = rows.groupBy("key").agg(F.max_by("rep", "score").alias("hub"), F.max("score").alias("hub_score"), F.count(F.lit(1)).alias("size"))
        found = attach(rows.drop("score"), hubs, ["key"], ["rep"], n_rows, size="size", how="inner").drop("size")
        return self.work.save(found, f"large{round_}"), n_rows

    def _again(self, large: DataFrame, n_large: int, round_: int) -> DataFrame | None:
        """Compare members with their hubs; the members of buckets in which some are of other classes, dealt anew."""
        asked = F.collect_set(F.when(F.col("new"), F.col("hub")))
        pairs = large.where("rep <> hub").select("rep", "hub", F.lit(True).alias("new"))
        if self.tried is not None:
            pairs = pairs.unionByName(self.tried)
            asked = F.array_except(asked, F.collect_set(F.when(~F.col("new"), F.col("hub"))))
        pairs = pairs.groupBy("rep").agg(asked.alias("hubs")).where(F.size("hubs") > 0)  # a member has few hubs
        pairs, n_pairs = self.work.measured(pairs, f"pairs{round_}", F.sum(F.size("hubs")))
        each = pairs.select("rep", F.explode("hubs").alias("hub"))
        mine = each.withColumn("new", F.lit(False))
        self.tried = mine if self.tried is None else self.tried.unionByName(mine)
        texts = self.texts.select("id", "text")
        if n_pairs:
            left = pairs.join(texts.withColumnsRenamed({"id": "rep", "text": "text_a"}), "rep").select("rep", F.explode("hubs").alias("hub"), "text_a")
            right = counted(each, ["hub"]).join(texts.withColumnsRenamed({"id": "hub", "text": "text_b"}), "hub")
            both = attach(left, right, ["hub"], ["rep"], n_pairs, how="inner").select(F.col("rep").alias("a"), F.col("hub").alias("b"), "text_a", "text_b")
            self.links.append(self.work.save(both.mapInArrow(_verify(self.threshold), LINKS), f"links{round_}"))
        if self.links:
            # a member's label is the linked hub of the highest score: no more than a good guess of its class
            scores = large.groupBy("hub").agg(F.max("hub_score").alias("score"))
            if round_:
                scores = scores.unionByName(self.scores)
            self.scores = self.work.save(scores.groupBy("hub").agg(F.max("score").alias("score")), f"scores{round_}")
            linked = union(self.links).select(F.col("a").alias("rep"), F.col("b").alias("hub")).join(self.scores, "hub")
            self.label = self.work.save(linked.groupBy("rep").agg(F.max_by("hub", "score").alias("label")), f"labels{round_}")
        rows = self._labelled(large)
        if self.label is not None:
            of_hub = self.label.withColumnsRenamed({"rep": "hub", "label": "theirs"})
            heads = counted(large, ["hub"]).withColumnRenamed("n", "hub_n").join(of_hub, "hub", "left")
            rows = attach(rows, heads, ["hub"], ["rep"], n_large, size="hub_n")
        else:
            rows = rows.withColumn("theirs", F.lit(None).cast("long"))
        head = F.coalesce("theirs", "hub")
        apart = (F.col("mine") != head) & (F.col("mine") != F.col("hub"))
        # of those that belong with the hub all have the hub's label
        rows = rows.select("key", "band", "rep", "n", apart.alias("apart"), F.when(apart, F.col("mine")).otherwise(head).alias("label"))
        rows = self.work.save(rows, f"judged{round_}")
        open_ = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.count_if("apart").alias("n_open")).where("n_open > 0")
        open_, n_open = self.work.measured(open_, f"open{round_}", F.sum("n_open"))
        if not n_open:
            return None
        rows, n_rest = self.work.measured(attach(rows, open_, ["key"], ["rep"], n_large, size="size", how="inner"), f"rest{round_}", F.sum((F.col("n_open") > SMALL).cast("int")))
        if n_rest and not round_:
            self.dealt = rows.where(F.col("n_open") > SMALL).select("key", "band", "rep")
        last = round_ == len(OFFSETS)
        blocks = self._blocks(rows if last else rows.where(F.col("n_open") <= SMALL), BLOCK)
        self.blocks.append(blocks.select(F.col("block").alias("key"), "rep", "label", F.lit(-1).alias("band")))
        if last or not n_rest:
            return None
        offsets = F.array(*[F.lit(o) for o in OFFSETS[round_]])
        rest = rows.where(F.col("n_open") > SMALL).select("rep", "band", "key").join(self.bands, "rep").select("rep", "band", "key", "bands", F.explode(offsets).alias("offset"))
        rest = rest.select("rep", "band", F.xxhash64("key", "offset", F.get("bands", (F.col("band") + F.col("offset")) % BANDS)).alias("key"))
        return self.work.save(rest, f"waiting{round_}")

    def _labelled(self, rows: DataFrame) -> DataFrame:
        if self.label is None:
            return rows.withColumn("mine", F.col("rep"))
        return rows.join(self.label, "rep", "left").withColumn("mine", F.coalesce("label", "rep")).drop("label")

    def _parted(self) -> None:
        """Compare the members of each bucket that was dealt anew with those that aren't of their class by all links so far."""
        label = components(Scratch(self.work.spark, "near-parted"), union(self.links)).withColumnRenamed("id", "rep")
        rows = self.work.save(self.dealt.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "dealt")
        bit = F.bit_or(F.expr("shiftleft(1, band)")).over(Window.partitionBy("rep"))
        rows, n = self._apart(rows.withColumn("mask", bit), "mixed")
        if not n:
            return
        met = self._blocks(rows, SIGNATURES, "key", "apart", "band", "mask").join(self.sketches.withColumnRenamed("id", "rep"), "rep")
        met = met.select("block", "key", "rep", "label", "apart", "sketch", "bands", "band", "mask").repartition("block").sortWithinPartitions("block")
        found = self.work.save(met.mapInArrow(_agreeing, AGREEING).select("key", "rep"), "agreeing")
        rows, n = self._apart(rows.select("key", "rep", "label").join(found, ["key", "rep"], "left_semi"), "doubtful")
        if n:
            self.links.append(self._compared(self._blocks(rows, BLOCK).select(F.col("block").alias("key"), "rep", "label", F.lit(-1).alias("band")), "parted"))

    def _apart(self, rows: DataFrame, table: str) -> tuple[DataFrame, int]:
        """Rows of buckets of several labels, with the bucket's `size`; those are `apart`, n_open in all, that don't have its most frequent label."""
        each = counted(rows, ["key", "label"])
        heads = each.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("head"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("n_open"))
        heads, n = self.work.measured(heads.where("n_open > 0"), f"{table}_heads", F.sum("size"))
        if not n:
            return rows, 0
        rows = attach(rows, heads, ["key"], ["rep"], n, size="size", how="inner").withColumn("apart", F.col("label") != F.col("head")).drop("head")
        return self.work.save(rows, table), n

    @staticmethod
    def _blocks(rows: DataFrame, size: int, *others: str) -> DataFrame:
        """Members that belong with the hub in blocks of about `size`, and with each block those that don't.

        Where there are many of these they are in blocks too, and each two blocks meet.
        """
        n, n_open = (F.ceil(c / F.lit(float(size))).cast("int") for c in (F.col("size") - F.col("n_open"), F.col("n_open")))
        at = lambda blocks: F.pmod(F.xxhash64("rep"), F.greatest(blocks, F.lit(1))).cast("int")
        every = lambda blocks: F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1)
        rows = rows.select("key", "rep", "label", "apart", *(c for c in others if c not in ("key", "apart")), n.alias("blocks"), n_open.alias("open_blocks"))
        settled = rows.where("NOT apart").withColumn("x", at(F.col("blocks"))).withColumn("y", F.explode(every(F.col("open_blocks"))))
        apart = rows.where("apart").withColumn("y", at(F.col("open_blocks")))
        met = apart.withColumn("x", F.explode(every(F.col("blocks"))))
        both = apart.where("open_blocks > 1").withColumn("z", F.explode(every(F.col("open_blocks"))))
        both = both.withColumn("x", -1 - F.least("y", "z")).withColumn("y", F.greatest("y", "z")).drop("z")
        return settled.unionByName(met).unionByName(both).select(F.xxhash64("key", "x", "y").alias("block"), "rep", "label", *others)

    def _compared(self, rows: DataFrame, table: str) -> DataFrame:
        """Links between the members (key, rep, label, band) that meet by key: signatures first, then the texts of those that agree with another."""
        bit = F.when(F.col("band") >= 0, F.expr("shiftleft(1, band)")).otherwise(0)
        rows = self.work.save(rows.withColumn("mask", F.bit_or(bit).over(Window.partitionBy("rep"))), f"{table}_rows")
        met = rows.join(self.sketches.withColumnRenamed("id", "rep"), "rep").select(F.col("key").alias("block"), "key", "rep", "label", F.lit(True).alias("apart"), "sketch", "bands", "band", "mask")
        found = met.repartition("block").sortWithinPartitions("block").mapInArrow(_agreeing, AGREEING)
        rows = self.work.save(found, f"{table}_agreeing")
        rows = rows.join(self.texts.withColumnRenamed("id", "rep"), "rep").select("key", "rep", "label", "text", "sketch", F.when(F.col("band") >= 0, F.col("bands")).alias("bands"), "band", "mask")
        rows = rows.repartition("key").sortWithinPartitions("key")
        return self.work.save(rows.mapInArrow(_compare(self.threshold), LINKS), table)


def _versions(work: Scratch, signed: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Links (a, b) between the different texts of one id."""
    hashes = signed.where("id IS NOT NULL").select("id", F.xxhash64("digest").alias("hash"))
    several = counted(hashes, ["id"], F.min("hash").alias("low"), F.max("hash").alias("high")).where("low <> high").select("id", "n")
    several, n = work.measured(several, "several", F.sum("n"))
    if not n:
        return None
    rows = attach(signed.select("id", "digest"), several, ["id"], ["digest"], n, how="inner").select("id", "digest").distinct()
    rows = work.save(rows.join(reps.select("digest", "rep"), "digest").select("id", "rep"), "versions")
    first = counted(rows, ["id"], F.min("rep").alias("b"))
    return attach(rows, first, ["id"], ["rep"], n, how="inner").where("rep <> b").select(F.col("rep").alias("a"), "b")


def near_classes(docs: DataFrame, threshold: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of each row: (id, class_id, class_size, kept, text_hash).

    Rows are in one class if a chain of links joins them; a link joins texts whose weighted Jaccard similarity of
    five-word shingles (A-Z lower-cased) is `threshold` or more; bands and AGREE are made for SIMILAR, so lower thresholds
    are refused. class_id is the least id of the class and that
    row is kept; rows that repeat its id are kept with it. `text_hash` (xxhash64) tells rows of one id or of none apart. Different texts under one id are versions of one document: they are in
    one class, and each of them is compared with others. Texts of fewer than five words are one shingle; texts
    without words, null ones too, are one class. Rows of null ids are compared as all others; they aren't versions of one
    document, and a class of them alone has a null class_id; its rows with the least digest of the words are kept. An empty table gives an empty result; other columns are ignored.
    """
    if not threshold >= SIMILAR:
        raise ValueError(f"threshold must be {SIMILAR} or more: signatures would leave out pairs of lower similarity")
    work = Scratch(docs.sparkSession, "near")
    small_batches(docs.sparkSession)
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # a row's text is known by its id and a hash: an id may have several, and null ids stand beside id 0
    ids = ids.select("id", "text", F.xxhash64("text").alias("hash"), F.coalesce("id", F.lit(0)).alias("at"))
    signed, n_docs = work.measured(ids.select("id", "text", "hash").mapInArrow(_sign, "id long, hash long, digest binary, bands array<long>, sketch binary"), "signed", F.count(F.lit(1)))
    source = F.min(F.struct(F.coalesce("id", F.lit(0)).alias("at"), "hash")).alias("source")
    reps = signed.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), source, F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps, n_reps = work.measured(reps.withColumn("rep", F.monotonically_increasing_id()), "reps", F.count(F.lit(1)))  # numbers are fixed as they are written
    links, versions = Buckets(work, ids, n_docs or 0, reps, threshold).run(), _versions(work, signed, reps)
    label = components(work, links if versions is None else links.unionByName(versions))
    # of each class the least id: labels are numbers of any of the class's texts
    classes = reps.select("digest", "n", "rep", "least").join(label.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    classes = work.save(classes, "of_digest")
    least = F.min_by("digest", F.struct(F.col("least").isNull(), "least", "digest")).alias("head")
    total = classes.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("digests"), least)
    classes = attach(classes, total, ["label"], ["digest"], n_reps or 0, size="digests").select("digest", "n", "class_id", "class_size", (F.col("digest") == F.col("head")).alias("head"))
    classes = work.save(classes, "classes")
    work.drop_but("signed", "classes")
    out = attach(signed.select("id", "hash", "digest"), classes, ["digest"], ["id", "hash", F.spark_partition_id()], n_docs or 0)
    kept = F.when(F.col("class_id").isNull(), F.col("head")).otherwise(F.col("id").eqNullSafe(F.col("class_id")))
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", kept.alias("kept"), F.col("hash").alias("text_hash"))
