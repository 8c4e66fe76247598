"""Repeated passages by a sparse suffix array over words.

1. Each window of ``LEAST`` words names one suffix: it begins at the smallest hash of 8 words among the first 16 of the window.
   The choice follows from the window's words alone, so equal windows name equal suffixes wherever they stand.  Only the
   suffixes that a window names are kept, about one word in eight; each carries a hash of all words of every window that names it.
2. The suffixes are sorted: by the hash of their first 32 words, then by the words that follow these, then by document.
   Partitions are ranges of that order, so a passage that very many documents share is spread over many of them.
3. Neighbours in the order that begin alike are compared: of the windows that reach left and right of the same 32 words the first
   document that holds each is found, and a later one is marked.  Marks of a document that overlap are joined before they leave.
   A passage may go on beyond a piece of the order.  As the words on the right are sorted, only windows whose words on the right are
   those of the piece's first or last suffix can; these are sent, for the document that has them first there, through one more
   step: the smallest document of each window.
4. Marks of a document that overlap are joined into spans.

So of documents that share a passage all but the smallest doc_id are marked, and each mark names an earlier document.  Windows
are compared by 96 bits: a 64-bit hash of the 32 words and a 32-bit hash of all 50.  Words are split at white space and
compared exactly.  Where one word is repeated over and over the 8 words tie: of those the window takes the one a multiple of 16
before their end.

Null texts and texts of under 50 words have no spans.  Repeats inside one document, and rows that repeat a doc_id, are not marked
against each other; spans name their row by ``sig``, a hash of its text, so that rows of one id with other texts stay
apart.  Rows with a null doc_id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import cut, partners, parts, place, table, unused
from .textops import Words, expand, mix, not_blank, portions, window_hashes

GRAM, SPREAD, PREFIX, LEAST = 8, 16, 32, 50
#: Words of a window that may follow the prefix.
SIDE = LEAST - PREFIX
#: Suffixes that are compared in one go.
PIECE = 1 << 17
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes before the window hashes: codes of the words on the right, and how far left the first window reaches.
_HEAD = 2 * SIDE + 1


def _named(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window of LEAST words, and the word where the suffix begins that the window names."""
    windows, _ = words.windows(LEAST)
    if not len(windows):
        return windows, windows
    starts, _ = words.windows(GRAM)
    gram = np.full(len(words.hash), _TOP)
    gram[starts] = window_hashes(words.hash, starts, GRAM) >> np.uint64(1)
    least, at = np.arange(len(gram)), 1  # the first smallest of SPREAD in a row, by doubling
    while at < SPREAD:
        left, right = least[:-at], least[at:]
        least = np.where(gram[right] < gram[left], right, left)
        at *= 2
    least = least[windows]
    ends = np.flatnonzero(np.append(gram[1:] != gram[:-1], True))  # of runs of equal grams
    end = ends[np.searchsorted(ends, windows)]
    return windows, np.where(least == windows, windows + (end - windows) % SPREAD, least)


def selected(words: Words) -> np.ndarray:
    """Numbers of the words at which a suffix is kept."""
    return np.unique(_named(words)[1])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in portions(batches, most=500_000):
        words = Words(texts, not_blank, fold=None)
        windows, name = _named(words)
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(name)))
        at, begin = name[first], windows[first]
        doc = np.searchsorted(words.first, begin, side="right") - 1
        code = (words.hash >> np.uint64(48)).astype(">u2")
        room = words.first[doc + 1] - at - PREFIX
        right = np.where(np.arange(SIDE) < room[:, None], code[np.minimum(at[:, None] + PREFIX + np.arange(SIDE), max(0, len(code) - 1))], 0).astype(">u2")
        width = _HEAD + 4 * count
        offset = np.concatenate(([0], np.cumsum(width)))
        data = np.empty(int(offset[-1]), np.uint8)
        data[expand(offset[:-1], np.full(len(at), _HEAD))] = np.concatenate((right.view(np.uint8).reshape(len(at), -1), (at - begin)[:, None].astype(np.uint8)), axis=1).ravel()
        data[expand(offset[:-1] + _HEAD, 4 * count)] = (window_hashes(words.hash, windows, LEAST) >> np.uint64(32)).astype("<u4").view(np.uint8)
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays([
            pa.array(window_hashes(words.hash, at, PREFIX).view(np.int64)), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(data)]),
            batch.column(batch.schema.get_field_index("doc_id")).take(take), batch.column(batch.schema.get_field_index("sig")).take(take), pa.array((begin - words.first[doc]).astype(np.int32))],
            names=["h", "ctx", "doc_id", "sig", "pos"])


_FOUND = "kind int, h long, doc_id long, sig int, start int, stop int, other long"


def _rows(kind, h, doc, sig, start, stop, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(doc), kind, np.int32)), pa.array(h, pa.int64()), pa.array(doc), pa.array(sig), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(other, pa.int64())],
        names=["kind", "h", "doc_id", "sig", "start", "stop", "other"])


def _joined(doc, sig, start, stop, other) -> list[np.ndarray]:
    """Marks, those that overlap in one row's text as one."""
    order = np.lexsort((start, sig, doc))
    doc, sig, start, stop, other = (x[order] for x in (doc, sig, start, stop, other))
    text = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1])))
    furthest = np.maximum.accumulate(stop + (text << 32)) - (text << 32)
    fresh = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (start[1:] > furthest[:-1])))
    return [doc[fresh], sig[fresh], start[fresh], furthest[np.append(fresh[1:], len(doc)) - 1], np.minimum.reduceat(other, fresh)]


def _alike(right: np.ndarray, one: np.ndarray) -> np.ndarray:
    """How many words on the right each row has in common with one."""
    return np.minimum.accumulate(right == one, axis=1).sum(axis=1)


def _piece(h: np.ndarray, doc: np.ndarray, sig: np.ndarray, pos: np.ndarray, offset: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Marks (kind 0) of sorted suffixes; the windows (1) that may go on beyond them, in the documents that hold them first here."""
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(begin, len(h)))
    shared = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
    shared[[0, -1]] = True
    ask = np.flatnonzero(np.repeat(shared, size))
    group = np.repeat(np.arange(len(begin)), size)[ask]
    first, last = (data[o : o + 2 * SIDE].copy().view(np.uint16) for o in (int(offset[0]), int(offset[-2])))
    h, doc, sig, pos = (x[ask] for x in (h, doc, sig, pos))
    at, count = offset[ask], (offset[ask + 1] - offset[ask] - _HEAD) // 4
    right = data[at[:, None] + np.arange(2 * SIDE)].view(np.uint16)
    reach = data[at + 2 * SIDE].astype(np.int64)
    alike = np.full(len(ask), -1)
    for end, one in ((group == group[0], first), (group == group[-1], last)):
        alike[end] = np.maximum(alike[end], _alike(right[end], one))
    row = np.repeat(np.arange(len(ask)), count)
    nth = expand(np.zeros(len(ask), np.int64), count)
    key = (group[row].astype(np.uint64) << np.uint64(32)) | data[expand(at + _HEAD, 4 * count)].view("<u4")
    order = np.lexsort((doc[row], key))  # of equal windows that of the smallest document comes first
    fresh = np.append(True, key[order[1:]] != key[order[:-1]])
    holder = np.empty(len(key), np.int64)
    holder[order] = doc[row[order]][np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
    start = pos[row] + nth
    hit = np.flatnonzero(doc[row] > holder)
    if len(hit):
        marks = _joined(doc[row[hit]], sig[row[hit]], start[hit], start[hit] + LEAST, holder[hit])
        yield _rows(0, [None] * len(marks[0]), *marks)
    out = np.flatnonzero((doc[row] == holder) & (alike[row] >= SIDE - reach[row] + nth))
    if len(out):
        key, doc, sig, start = mix(mix(h[row[out]].view(np.uint64)) + (key[out] & np.uint64(0xFFFFFFFF))).view(np.int64), doc[row[out]], sig[row[out]], start[out]
        order = np.lexsort((start, sig, doc, key))
        key, doc, sig, start = (x[order] for x in (key, doc, sig, start))
        apart = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1]) | (start[1:] > start[:-1] + LEAST)
        fresh = np.flatnonzero(np.append(True, apart))  # equal windows that overlap are one stretch
        yield _rows(1, key[fresh], doc[fresh], sig[fresh], start[fresh], start[np.append(fresh[1:], len(key)) - 1] + LEAST, [None] * len(fresh))


def _neighbours(piece: int):
    """_piece of about so many sorted suffixes at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ctx = one.column(1)
            offset = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
            yield from _piece(*[np.asarray(one.column(k)) for k in (0, 2, 3, 4)], offset, np.frombuffer(ctx.buffers()[2], np.uint8))

        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= piece:
                yield from told(held)
                held, rows = [], 0
        if rows:
            yield from told(held)

    return run


def short_sig(text: str) -> Column:
    """What tells rows of one doc_id apart, in 32 bits, as every suffix carries it."""
    return F.hash(text)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, sig, start_word, end_word, n_words, other_doc_id): each span of words that an earlier document holds; the end is excluded."""
    rows = (docs.where("doc_id is not null and text is not null").select("doc_id", "text", short_sig("text").alias("sig"))
            .mapInArrow(_suffixes, "h long, ctx binary, doc_id long, sig int, pos int"))
    order = ["h", "ctx", "doc_id"]
    found = cut(rows.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_neighbours(PIECE), _FOUND), "neighbours")
    ends = found.where("kind = 1").withColumn("other", F.min("doc_id").over(Window.partitionBy("h")))  # a row for each piece and stretch at most
    across = ends.where("doc_id > other")
    marks = found.where("kind = 0").select("doc_id", "sig", "start", "stop", "other").union(across.select("doc_id", "sig", "start", "stop", "other"))
    in_text = Window.partitionBy("doc_id", "sig").orderBy("start", "stop", "other")
    fresh = F.coalesce(F.col("start") > F.max("stop").over(in_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = F.sum(fresh.cast("int")).over(in_text.rowsBetween(Window.unboundedPreceding, 0))
    return (marks.withColumn("island", island).groupBy("doc_id", "sig", "island")
            .agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("other").alias("other_doc_id"))
            .select("doc_id", "sig", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id"))


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs, their texts without the spans' words; a text of which nothing but white space is left goes. n_chars, if there, follows the text."""
    key, mark, held = (unused(docs, name) for name in ("id_", "sig_", "spans_"))
    listed = spans.groupBy("doc_id", "sig").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias(held)).withColumnsRenamed({"doc_id": key, "sig": mark})
    listed = cut(listed, "listed")
    names = docs.columns
    follows = {"text", "n_chars"} & set(names)

    def rest(text: str, spans: list[dict]) -> str:
        words = Words([text], not_blank, fold=None)
        kept, to = [], 0
        for s in spans:
            kept.append(text[to : int(words.start[s["start_word"]])])
            to = int(words.start[s["end_word"]]) if s["end_word"] < len(words.start) else len(text)
        return "".join([*kept, text[to:]])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = {name: batch.column(names.index(name)).to_pylist() for name in follows}
            stay = np.ones(batch.num_rows, bool)
            for k, spans in enumerate(batch.column(len(names)).to_pylist()):
                if spans:
                    text = now["text"][k] = rest(now["text"][k], spans)
                    stay[k] = bool(text.strip(" \t\n\v\f\r"))
                    if "n_chars" in now:
                        now["n_chars"][k] = len(text)
            columns = [pa.array(now[name], batch.schema.field(k).type) if name in now else batch.column(k) for k, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay))

    named, others = partners(docs, listed, (F.col("doc_id") == F.col(key)) & (short_sig("text") == F.col(mark)), place("doc_id", short_sig("text")), place(key, mark))
    return others.unionByName(named.select(*names, held).mapInArrow(drop, docs.schema))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that an earlier document holds."""
    return without_spans(docs, cut(repeated_spans(docs), "spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("sig")


QUERIES = {"op6_suffix_array_dedup": (query, None)}
