"""Main text of web pages: a suffix array for each host finds what its pages repeat, markup tells the rest.

1. A page is read as blocks (``html_blocks``), and these as a stream of tokens: the first ``HEAD`` words of a block, one token for all
   that follow them, and a mark for its end.  Streams of a host's pages are laid end to end in one array of suffixes, of which those
   that begin at a block are kept, since boilerplate is made of whole blocks.
2. The suffixes are sorted: by the hash of host and first ``LEAST`` tokens (shorter repeats do not count), then by the ``AFTER`` tokens that follow, then
   by page.  Ranges of that order cut a host, or a run that all its pages share, over many tasks.
3. Neighbours of distinct pages are compared: their common prefix is a run that both pages hold, and the whole blocks in it are covered.
   As a suffix begins at every block, longer runs are covered from the next block on.  Where a range ends, the suffixes next to the cut
   are compared once more with those of the neighbouring ranges.
4. Covered blocks are boilerplate and go, unless they stand in the page's article or main element: passages that articles share stay.  What markup names
   a menu, header, footer, sidebar, notice, advert, form or comment goes as well, covered or not, so a page that is alone on its host is read alike.
   Of a page that has an article the article stays, else its main element, else its unique runs.  If nothing would be left of a page without either, it is a
   copy of others, and its blocks that are not mostly links stay.

Pages are distinct if their html differs.  Only tokens travel to be sorted, never texts; the blocks that runs cover (a few numbers a page) are broadcast up to
``BROADCAST_BYTES`` as counted beforehand, and joined by shuffle beyond.  Tokens are 32-bit hashes: two runs are taken as equal on 32 bits for each token.

Null html or one without text gives an empty text.  A url that is null or has no `://` has the empty host, so such pages are compared with each other.  Repeated
rows are read alike, each in its own row; a null page_id stays.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .html_blocks import ARTICLE, MAIN, OPEN, Block, blocks
from .shared import cut, parts, table
from .textops import mix, portions
from .url_filter import parsed

#: Words of a block that are tokens of their own; tokens of the shortest run; tokens of a suffix beyond these.
HEAD, LEAST, AFTER = 8, 6, 10
#: Suffixes that are compared in one go.
PIECE = 1 << 17
#: Most bytes of covered blocks that are broadcast.
BROADCAST_BYTES = 64 << 20
_END = 1
_SUFFIX = "h long, ctx binary, page long, at int"


def tokens(page: list[Block]) -> tuple[list[int], list[int]]:
    """The tokens of a page's blocks, and where each block begins."""
    out, first = [], []
    for block in page:
        first.append(len(out))
        words = block.text.split(" ", HEAD)
        out += [xxhash.xxh32_intdigest(w) | 2 for w in words]  # 0 and 1 are no word
        out.append(_END)
    return out, first


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in portions(batches, "html"):
        host, page = (np.asarray(batch.column(k)) for k in (0, 1))
        stream, start, stop, of, number = [], [], [], [], []
        seen = set()
        for k, html in enumerate(texts):
            if int(page[k]) in seen:
                continue
            seen.add(int(page[k]))
            words, first = tokens(blocks(html))
            start += [len(stream) + f for f in first]
            stream += words
            stop += [len(stream)] * len(first)
            of += [k] * len(first)
            number += range(len(first))
        if not start:
            continue
        start, stop, of, number = (np.array(x, np.int64) for x in (start, stop, of, number))
        long = stop - start >= LEAST
        start, stop, of, number = (x[long] for x in (start, stop, of, number))
        at = start[:, None] + np.arange(LEAST + AFTER)
        window = np.where(at < stop[:, None], np.append(np.array(stream, np.uint32), np.zeros(LEAST + AFTER, np.uint32))[at], 0).astype(np.uint32)
        h = host[of].view(np.uint64)
        for j in range(LEAST):
            h = mix(h ^ window[:, j].astype(np.uint64))
        ended = (window[:, :LEAST] == _END).sum(axis=1)
        ctx = window[:, LEAST:].astype(">u4").tobytes()
        offsets = (4 * AFTER * np.arange(len(start) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            pa.array(h.view(np.int64)), pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(ctx)]),
            pa.array(page[of]), pa.array((number * 8 + ended).astype(np.int32))], names=["h", "ctx", "page", "at"])


def common(h: np.ndarray, ctx: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Of sorted suffixes, how many tokens after the first LEAST each has in common with the nearest ones of other pages; -1 if it has less than LEAST."""
    n = len(h)
    alike = np.full(n + 1, -1)  # of each suffix and the one before it
    same = np.flatnonzero(h[1:] == h[:-1]) + 1
    equal = (ctx[same] == ctx[same - 1]) & (ctx[same] != 0)
    alike[same] = np.minimum.accumulate(equal, axis=1).sum(axis=1)
    # suffixes of one page in a row: what is alike to the page before them, and after them, is the least on the way
    streak = np.cumsum(np.append(False, page[1:] != page[:-1]))
    drop = np.int64(AFTER + 2)
    left = np.minimum.accumulate(alike[:n] - drop * streak) + drop * streak
    back = (streak[-1] - streak)[::-1]
    right = (np.minimum.accumulate(alike[1:][::-1] - drop * back) + drop * back)[::-1]
    return np.maximum(left, right)


_FOUND = "kind int, page long, at int, stop int, h long, ctx binary"


class _Rows:
    """Sorted suffixes as arrays."""

    def __init__(self, batches: list[pa.RecordBatch]):
        one = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.batch = one
        self.h, self.page, self.at = (np.asarray(one.column(k)) for k in (0, 2, 3))
        raw = one.column(1)
        begin = int(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset])
        self.ctx = np.frombuffer(raw.buffers()[2], ">u4", len(raw) * AFTER, begin).reshape(-1, AFTER)
        turn = np.flatnonzero(self.page[1:] != self.page[:-1]) + 1
        #: Where the first streak of one page ends, and where the last begins.
        self.lead, self.trail = (int(turn[0]), int(turn[-1])) if len(turn) else (len(self.h), 0)

    def covered(self, low: int, high: int) -> pa.RecordBatch:
        """The blocks that the suffixes from low to high cover together with others."""
        deep = common(self.h, self.ctx, self.page)[low:high]
        ctx, at = self.ctx[low:high], self.at[low:high]
        done = (at & 7) + ((ctx == _END) & (np.arange(AFTER) < deep[:, None])).sum(axis=1)
        hit = np.flatnonzero((deep >= 0) & (done > 0))
        block = at[hit] >> 3
        return pa.RecordBatch.from_arrays([
            pa.array(np.zeros(len(hit), np.int32)), pa.array(self.page[low:high][hit]), pa.array(block.astype(np.int32)), pa.array((block + done[hit]).astype(np.int32)),
            pa.nulls(len(hit), pa.int64()), pa.nulls(len(hit), pa.binary())], names=["kind", "page", "at", "stop", "h", "ctx"])

    def border(self, low: int, high: int) -> pa.RecordBatch:
        rows = self.batch.slice(low, high - low)
        return pa.RecordBatch.from_arrays([
            pa.array(np.ones(len(rows), np.int32)), rows.column(2), rows.column(3), pa.nulls(len(rows), pa.int32()), rows.column(0), rows.column(1)],
            names=["kind", "page", "at", "stop", "h", "ctx"])


def _neighbours(piece: int):
    """Covered blocks (kind 0) of a range of sorted suffixes, and the suffixes at its ends (kind 1): those of one page, and one of another page beyond them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = context = 0  # context: rows in front that were told before
        opened = False

        def told(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, context, opened
            now = _Rows(held)
            if not opened and (now.trail or last):
                opened = True
                yield now.border(0, min(now.lead + 1, rows))
            if last:
                yield now.covered(context, rows)
                yield now.border(max(now.trail - 1, 0), rows)
            elif now.trail:
                yield now.covered(context, now.trail)
                held, rows, context = [now.batch.slice(now.trail - 1)], rows - now.trail + 1, 1
            else:
                held = [now.batch]

        want = piece
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= want:
                yield from told(False)
                want = 2 * rows if rows > piece else rows + piece
        if rows:
            yield from told(True)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for runs in batch.column(1).to_pylist():
            spans: list[int] = []
            for run in sorted((r["at"], r["stop"]) for r in runs):
                if spans and run[0] <= spans[-1]:
                    spans[-1] = max(spans[-1], run[1])
                else:
                    spans += run
            out.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["page", "spans"])


def _read(pages: DataFrame) -> DataFrame:
    host, _ = parsed(F.col("url"))
    read = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(host).alias("host"))
    return read.withColumn("page", F.xxhash64("host", "html"))


def repeated_runs(pages: DataFrame, piece: int = PIECE) -> DataFrame:
    """(page, spans): of each distinct page, the blocks covered by runs that another page of its host holds, as begin and end of each span."""
    order = ["h", "ctx", "page"]
    rows = cut(_read(pages).select("host", "page", "html").mapInArrow(_suffixes, _SUFFIX), "suffixes")  # the ranges need a sample, and pages are read once for both
    found = cut(rows.repartitionByRange(parts(pages.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_neighbours(piece), _FOUND), "runs")
    ends = found.where("kind = 1").select("h", "ctx", "page", "at").coalesce(1).sortWithinPartitions(*order)  # a few rows for each range
    covered = found.where("kind = 0").union(ends.mapInArrow(_neighbours(piece), _FOUND).where("kind = 0"))
    return covered.groupBy("page").agg(F.collect_set(F.struct("at", "stop")).alias("runs")).mapInArrow(_merged, "page long, spans array<int>")


def main_text(page: list[Block], spans: list[int]) -> tuple[str, int]:
    """The text of a page, and how many of its blocks are covered by spans."""
    covered = [False] * len(page)
    for low, high in zip(spans[::2], spans[1::2]):
        covered[low:high] = [True] * (high - low)
    for part in (ARTICLE, MAIN):
        kept = [b for b in page if b.part == part]
        if kept:
            break
    else:
        kept = [b for b, c in zip(page, covered) if b.part == OPEN and not c] or [b for b in page if b.part == OPEN and not b.linked]
    return "\n\n".join(b.text for b in kept), sum(covered)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, htmls in portions(batches, "html"):
        spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
        read = [blocks(html) for html in htmls]
        told = [main_text(page, s or []) for page, s in zip(read, spans)]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([t for t, _ in told], pa.string()), pa.array([len(t) for t, _ in told], pa.int64()),
            pa.array([len(page) for page in read], pa.int64()), pa.array([c for _, c in told], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_covered"])


def extracted(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, piece: int = PIECE) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_covered) of every row of pages; n_covered counts the blocks that repeated runs cover."""
    runs = cut(repeated_runs(pages, piece), "covered")
    size = runs.agg(F.sum(F.lit(48) + 4 * F.size("spans"))).first()[0] or 0
    runs = F.broadcast(runs) if size <= broadcast_bytes else runs.hint("shuffle_merge")
    read = _read(pages).join(runs, "page", "left").select("page_id", "url", "html", "spans")
    kind = pages.select("page_id").schema[0].dataType.simpleString()
    return read.mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_covered long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op13_html_extraction": (query, None)}
