"""Substring deduplication: winnowed anchors seed matches, which are extended both ways.

Each window of WINDOW words has an anchor, the least hash of the SHINGLE-word sequences in it (the leftmost of equal ones):
windows with the same words have the same anchor at the same place. Neighbouring windows with one anchor are one occurrence of
it. Occurrences whose words are all the same are matched whole, by one hash, and the first in order stands for them. Then
documents are joined on the anchors: each occurrence that stands for others meets the anchor's first one, its origin, and the match is
extended word by word to the left and to the right. All windows within the match are repeats of the origin's. A window that
leaves the match can only repeat another window that does, so these are compared among each other, by the minimum of their
places. Runs of repeated windows that meet, in one occurrence or over several, are the maximal repeats; as each window has WINDOW
words, none is shorter. No pairs of occurrences are made: all but the origin's own place is a minimum over a key, summed up
before the shuffle, and an origin is sent to the occurrences of its anchor in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.shared import Scratch, attach, small_batches
from tierloom.llm.words import WORD, Words, buffers, chunks, mix, prefix, spans, words

WINDOW, SHINGLE = 20, 5
#: Words of an occurrence on either side of its anchor, at most.
REACH = WINDOW - SHINGLE


def occurrences(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end of the windows, anchor position) of each run of windows with one anchor."""
    n = len(w.hash) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    sums = prefix(w.hash, WORD)
    at = np.arange(len(w.hash) - SHINGLE + 1)
    low, pos = mix(spans(sums, at, at + SHINGLE, WORD)), at
    step, wide = 1, WINDOW - SHINGLE + 1
    while step < wide:
        far = min(step, wide - step)
        left = low[:-far] <= low[far:]
        low, pos = np.where(left, low[:-far], low[far:]), np.where(left, pos[:-far], pos[far:])
        step += far
    valid = w.doc[:n] == w.doc[WINDOW - 1 :]
    pos = np.where(valid, pos, -1)
    new = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    end = np.concatenate([new[1:], [n]])
    good = pos[new] >= 0
    return new[good], end[good], pos[new[good]]


def _anchor(w: Words, sums: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """31 bits are enough: anchors that share them only lead to more windows being compared one by one."""
    return (mix(spans(sums, pos, pos + SHINGLE, WORD)) >> np.uint64(33)).astype(np.int64)


def _batch(names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def start_bits(longest: int) -> int:
    """A position is document * 2**bits + word: bits for all words of a text of `longest` bytes."""
    return max(16, (longest // 2 + 1).bit_length())


def _position(w: Words, ids: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    return (ids[w.doc[at]] << bits) + at - w.first[w.doc[at]]


def _seeds(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(document, text) to (anchor, hash of the occurrence, position)."""
        for batch in batches:
            ids, (data, offsets) = np.asarray(batch.column(0)), buffers(batch.column(1))
            for low, high in chunks(offsets):
                w = words(data, offsets, low, high)
                new, end, pos = occurrences(w)
                sums = prefix(w.hash, WORD)
                whole = mix(spans(sums, new, end + WINDOW - 1, WORD)).view(np.int64)
                yield _batch(["anchor", "ext", "pos"], _anchor(w, sums, pos), whole, _position(w, ids[low:high], new, bits))

    return run


def _picked(w: Words, new: np.ndarray, lists: pa.Array, low: int, high: int) -> np.ndarray:
    """Which of the word positions `new` are in their document's list."""
    part = lists.slice(low, high - low)
    part = part.fill_null([]) if part.null_count else part
    sizes = np.diff(np.asarray(part.offsets))
    known = np.repeat(w.first[: high - low], sizes) + np.asarray(part.flatten())
    return np.isin(new, known)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one after the other."""
    size = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def _contexts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(document, text, starts of occurrences, starts of origins) to (anchor, position, is it the origin, place of the anchor, words) of these."""
        for batch in batches:
            ids, (data, offsets) = np.asarray(batch.column(0)), buffers(batch.column(1))
            for low, high in chunks(offsets):
                w = words(data, offsets, low, high)
                new, end, pos = occurrences(w)
                origin = _picked(w, new, batch.column(3), low, high)
                some = origin | _picked(w, new, batch.column(2), low, high)
                new, end, pos, origin = new[some], end[some], pos[some], origin[some]
                size = end - new + WINDOW - 1
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(w.hash[_ranges(new, new + size)].view(np.int64)))
                cols = (_anchor(w, prefix(w.hash, WORD), pos), _position(w, ids[low:high], new, bits), origin, (pos - new).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), lists], names=["anchor", "pos", "origin", "at", "words"])

    return run


def _aligned(lists: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, whether there is one) with the anchors of all rows in the same columns, and the sizes of the rows."""
    flat, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    size = np.diff(offsets)
    row, col = np.repeat(np.arange(len(size)), size), _ranges(REACH - at, REACH - at + size)
    out, there = np.zeros((len(size), 2 * REACH + SHINGLE), np.int64), np.zeros((len(size), 2 * REACH + SHINGLE), bool)
    out[row, col], there[row, col] = flat, True
    return out, there, size


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, position, at, words, at and words of the origin) to (anchor, window hash, position) of the windows that leave the match."""
    for batch in batches:
        at = np.asarray(batch.column(2)).astype(np.int64)
        mine, here, size = _aligned(batch.column(3), at)
        theirs, there, _ = _aligned(batch.column(5), np.asarray(batch.column(4)).astype(np.int64))
        same = here & there & (mine == theirs)
        left = np.minimum.accumulate(same[:, REACH - 1 :: -1], axis=1).sum(1)
        right = np.minimum.accumulate(same[:, REACH + SHINGLE :], axis=1).sum(1)
        matched = same[:, REACH : REACH + SHINGLE].all(1) & (left + right >= REACH)
        first, last = np.where(matched, at - left, 0), np.where(matched, at + right - REACH + 1, 0)
        n = size - WINDOW + 1
        low, high = np.zeros(len(n), np.int64), first  # windows before the match, then those after it
        row = np.concatenate([np.repeat(np.arange(len(n)), high - low), np.repeat(np.arange(len(n)), n - last)])
        window = np.concatenate([_ranges(low, high), _ranges(last, n)])
        base = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        sums = prefix(np.asarray(batch.column(3).flatten()).view(np.uint64), WORD)
        start = base[row] + window
        yield _batch(["anchor", "ext", "pos"], np.asarray(batch.column(0))[row], mix(spans(sums, start, start + WINDOW, WORD)).view(np.int64), np.asarray(batch.column(1))[row] + window)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, first occurrences, those that were extended, first windows of these, other columns) to verdicts and other columns."""
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for low, high in chunks(offsets):
            w = words(data, offsets, low, high)
            new, end, _ = occurrences(w)
            first, single = (_picked(w, new, batch.column(c), low, high) for c in (1, 2))
            at = _ranges(new[single], end[single])
            at = at[~_picked(w, at, batch.column(3), low, high)]
            change = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(change, np.concatenate([new[~first], at]), 1)
            np.add.at(change, np.concatenate([end[~first] + WINDOW - 1, at + WINDOW]), -1)
            gone = np.cumsum(change[:-1]) > 0
            n_words = np.diff(w.first)
            out = [[], [], [], []]
            for i in range(high - low):
                raw = data[offsets[low + i] : offsets[low + i + 1]].tobytes()
                mine = gone[w.first[i] : w.first[i + 1]]
                removed = int(mine.sum())
                kept, text, cuts = raw.split(), raw, []
                if removed:
                    kept = list(compress(kept, ~mine))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                    cuts = [{"start": int(a), "length": int(b - a)} for a, b in edges.reshape(-1, 2)]
                    text, done = b"", 0
                    base, k = offsets[low + i] - offsets[low], w.first[i]
                    for a, b in edges.reshape(-1, 2):
                        text += raw[done : w.start[k + a] - base]
                        done = w.start[k + b] - base if b < len(mine) else len(raw)
                    text += raw[done:]
                for o, v in zip(out, (removed, hashlib.sha256(b" ".join(kept)).hexdigest(), cuts, text.decode())):
                    o.append(v)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])), pa.large_string())
            cols = [pa.array(n_words.astype(np.int64)), *(pa.array(o, t) for o, t in zip(out, kinds)), *(c.slice(low, high - low) for c in batch.columns[4:])]
            yield pa.RecordBatch.from_arrays(cols, names=["n_words", "n_removed", "kept_sha256", "repeats", "kept_text", *batch.schema.names[4:]])


ROWS = "anchor long, ext long, pos long"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut all repeats of 20 words and more: (id, n_words, n_removed, kept_sha256, repeats, kept_text, *keep).

    A word goes if a window of 20 words over it also starts earlier: in a document with a smaller id, or
    earlier in its own. `repeats` has the maximal runs of removed words, `kept_text` the text without them and
    their following space. Null texts have no words. Rows that repeat an id are documents of their own, ordered by text; null
    ids come first. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "substring")
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    ids = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("low"), F.max("_id").alias("high"), F.count("_id").alias("known"), F.max(F.octet_length("text")).alias("longest")).first()
    bits = start_bits(ids["longest"] or 0)
    if ids["n"] >= 1 << 63 - bits:
        raise ValueError("too many documents for texts of that length")
    unique = ids["n"] == ids["known"] and (not ids["n"] or (ids["low"] >= 0 and ids["high"] < 1 << 63 - bits))
    if unique and rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0:
        rows = rows.withColumn("_seq", F.col("_id"))
    else:
        # numbered in order of id and text: part of the range and row within it, then the parts' sizes are added up; rows that are the same are dealt to several parts
        order = ["_id", F.xxhash64("text"), "text", "_tie"]
        rows = rows.withColumn("_tie", F.monotonically_increasing_id())
        rows = rows.repartitionByRange(*(c for c in order if c is not order[2])).sortWithinPartitions(*order).drop("_tie").withColumn("_seq", F.monotonically_increasing_id())
        rows = work.save(rows, "numbered")
        before, offset = 0, {}
        for r in sorted(rows.groupBy(F.shiftright("_seq", 33).alias("part")).count().collect()):  # one row for each partition
            offset[r["part"]] = before
            before += r["count"]
        base = F.element_at(F.map_from_arrays(F.lit(list(offset)).cast("array<long>"), F.lit(list(offset.values())).cast("array<long>")), F.shiftright("_seq", 33)) if offset else F.lit(0)
        rows = rows.withColumn("_seq", base + F.col("_seq").bitwiseAND((1 << 33) - 1))

    text = rows.select("_seq", "text")
    firsts = text.mapInArrow(_seeds(bits), ROWS).groupBy("anchor", "ext").agg(F.min("pos").alias("pos"))
    firsts, n_firsts = work.measured(firsts, "occurrences", F.count(F.lit(1)))
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("origin")).where("n > 1")
    several, n_several = work.measured(several, "several", F.sum("n"))
    told = attach(firsts, several, ["anchor"], ["ext"], n_firsts)
    seq, start = F.shiftright("pos", bits), F.col("pos").bitwiseAND((1 << bits) - 1).cast("int")
    origin = F.col("pos") == F.col("origin")
    lists = told.groupBy(seq.alias("_seq")).agg(F.collect_list(start).alias("first"), F.collect_list(F.when(~origin, start)).alias("single"), F.collect_list(F.when(origin, start)).alias("origins"))
    lists = work.save(lists, "lists")
    work.drop("occurrences")
    asked = text.join(lists.where(F.size("single") + F.size("origins") > 0).select("_seq", "single", "origins"), "_seq").select("_seq", "text", "single", "origins")
    met = work.save(asked.mapInArrow(_contexts(bits), "anchor long, pos long, origin boolean, at int, words array<long>"), "contexts")
    heads = met.where("origin").select("anchor", F.col("at").alias("origin_at"), F.col("words").alias("origin_words")).join(several.select("anchor", "n"), "anchor")
    pairs = attach(met.where("NOT origin").drop("origin"), heads, ["anchor"], ["pos"], n_several or 0, how="inner")
    left = pairs.select("anchor", "pos", "at", "words", "origin_at", "origin_words").mapInArrow(_extend, ROWS)
    seen = left.groupBy("anchor", "ext").agg(F.min("pos").alias("pos"))
    seen = work.save(seen.groupBy(seq.alias("_seq")).agg(F.collect_list(start).alias("seen")), "windows")
    work.drop("contexts", "several")
    more = ["_id", *[f"_keep_{c}" for c in keep]]
    found = rows.join(lists.join(seen, "_seq", "left"), "_seq", "left").select("text", "first", "single", "seen", *more)
    kinds = dict(found.dtypes)
    cut = found.mapInArrow(_cut, "n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,length:int>>, kept_text string, " + ", ".join(f"`{c}` {kinds[c]}" for c in more))
    return cut.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept_sha256", "repeats", "kept_text", *[F.col(f"_keep_{c}").alias(c) for c in keep])
