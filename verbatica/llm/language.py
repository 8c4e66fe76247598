"""Language identification by word scores and a Viterbi path.

Training counts hashed character trigrams of lower-cased words for each language, and the scripts of its words.  A word's
script (of its first letter) narrows the candidates to the languages that use it for at least ``RARE`` of their words; where
none does, all stay.  Each word has a score in every candidate language, the sum of its trigrams' log probabilities;
the Viterbi path over a text's words pays ``SWITCH`` for each change of language, so it labels the spans of mixed texts.
A document's language is the one with most letters; its score is that language's share of the letters.

Training takes a bounded sample, about ``SAMPLE`` labelled rows in all, chosen by a hash of the id.  The model has ``BUCKETS``
numbers for each language, and is broadcast.  Labelling reads every whole text once and shuffles nothing.

A null text, or one without letters, is `und` with score 0 and no spans; so is every text if nothing is labelled.  Ties go
to the first language by name.  Rows are labelled each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import fold_of, table
from .textops import code_points, code_table, expand, lower_table, mix, portions, runs

BUCKETS = 1 << 15
SAMPLE = 24_000
SWITCH, FLOOR, RARE = 10.0, -12.0, 0.001
#: Where runs of code points of one script begin.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "burmese"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x323B0, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_EDGES = np.array([at for at, _ in SCRIPTS], dtype=np.uint32)
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS])


def word_parts(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Trigram bucket of each letter (with what stands before and after it), words' begin and end, their first letters' script, first word of each text."""
    cps, text_start = code_points(texts)
    inside = code_table(str.isalpha)[cps]
    start, end = runs(inside)
    low = np.where(inside, lower_table()[cps], 0).astype(np.uint64)
    before = np.concatenate((np.zeros(1, np.uint64), low[:-1]))
    after = np.concatenate((low[1:], np.zeros(1, np.uint64)))
    bucket = (mix(before * np.uint64(1 << 42) + low * np.uint64(1 << 21) + after) & np.uint64(BUCKETS - 1)).astype(np.int64)
    script = _SCRIPT[np.searchsorted(_EDGES, cps[start], side="right") - 1]
    return bucket, start, end, script, np.searchsorted(start, text_start), text_start


class Model:
    """Log probability of each trigram bucket in each language, and which languages a script admits."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.table = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32).copy()
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        admits = (share >= RARE).T
        admits[~admits.any(axis=1)] = True
        self.refused = np.where(admits, 0, 3 * FLOOR).astype(np.float32)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 2))
    by_lang = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(by_lang)
    if not langs:
        return None
    # the same number of rows of each language, about, so that common ones don't crowd out the rest
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample / len(langs) / by_lang[lang]) * 1_000_000))).otherwise(share)
    taken = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share).select("lang", "text")
    place = {lang: i for i, lang in enumerate(langs)}
    width = BUCKETS + len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(langs), width), np.int64)
        for batch, texts in portions(batches):
            bucket, start, end, script, first, _ = word_parts(texts)
            lang = np.array([place[x] for x in batch.column(0).to_pylist()])
            of_word = np.repeat(lang, np.diff(first))
            letters = np.repeat(of_word, end - start)
            at = bucket[code_table(str.isalpha)[code_points(texts)[0]]]
            seen += np.bincount(np.concatenate((letters * width + at, of_word * width + BUCKETS + script)), minlength=seen.size).reshape(seen.shape)
        which, bin_ = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(bin_), pa.array(seen[which, bin_])], names=["lang", "bin", "n"])

    total = np.zeros((len(langs), width))
    # at most len(langs) * width rows
    for row in taken.mapInArrow(count, "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toLocalIterator():
        total[row["lang"], row["bin"]] = row["n"]
    return Model(langs, total[:, :BUCKETS], total[:, BUCKETS:])


def word_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Score of each word in each language (0 for the best, at least FLOOR), words' begin and end in code points of their text, first word of each text."""
    bucket, start, end, script, first, text_start = word_parts(texts)
    out = np.empty((len(start), len(model.langs)), np.float32)
    if len(start):
        at = expand(start, end - start)
        sums = np.add.reduceat(model.table[bucket[at]], np.concatenate(([0], np.cumsum(end - start)[:-1])), axis=0)
        sums += model.refused[script]
        out = np.maximum(sums - sums.max(axis=1, keepdims=True), FLOOR)
    base = np.repeat(text_start[:-1], np.diff(first))
    return out, start - base, end - base, first


def viterbi(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The language of each word on its text's best path; all texts take each step together, longest first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n, begin = n[order], first[:-1][order]
    steps = int(n[0]) if len(n) else 0
    if not steps:
        return np.zeros(0, np.int64)
    active = len(n) - np.searchsorted(n[::-1], np.arange(steps), side="right")
    width = scores.shape[1]
    small = np.min_scalar_type(width - 1)
    back = np.empty((int(active.sum()), width), small)
    at = np.concatenate(([0], np.cumsum(active)))
    own = np.arange(width, dtype=small)
    value = scores[begin[: active[0]]]
    final = np.empty((len(n), width), np.float32)
    for t in range(1, steps):
        a = active[t]
        if a < len(value):
            final[a : len(value)] = value[a:]
            value = value[:a]
        best = value.argmax(axis=1)
        switch = value[np.arange(a), best][:, None] - SWITCH
        stay = value >= switch
        back[at[t] : at[t + 1]] = np.where(stay, own, best[:, None].astype(small))
        value = np.where(stay, value, switch) + scores[begin[:a] + t]
    final[: len(value)] = value
    out = np.empty(len(scores), np.int64)
    state = np.zeros(0, np.int64)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        if a > len(state):  # texts whose last word this is
            state = np.concatenate((state, final[len(state) : a].argmax(axis=1)))
        out[begin[:a] + t] = state
        if t:
            state = back[at[t] : at[t + 1]][np.arange(a), state].astype(np.int64)
    return out


def labelled(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; spans are (start, end, lang) in code points, end excluded."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch, texts in portions(batches, most=3_000_000):
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            if model is None:
                yield pa.RecordBatch.from_arrays([ids, pa.array(["und"] * len(texts)), pa.array([0.0] * len(texts)), pa.array([[]] * len(texts), pa.list_(span))], names=["doc_id", "lang_pred", "score", "spans"])
                continue
            got, i = [], 0
            while i < len(texts):  # the widest arrays are made for a few texts at a time
                j, chars = i, 0
                while j < len(texts) and (chars < 400_000 or j == i):
                    chars += len(texts[j])
                    j += 1
                got.append(word_scores(model, texts[i:j]))
                i = j
            scores, start, end = (np.concatenate([g[k] for g in got]) for k in range(3))
            n = np.concatenate([np.diff(g[3]) for g in got])
            first = np.concatenate(([0], np.cumsum(n)))
            lang = viterbi(scores, first)
            doc = np.repeat(np.arange(len(texts)), n)
            letters = np.bincount(doc * len(model.langs) + lang, weights=end - start, minlength=len(texts) * len(model.langs)).reshape(len(texts), -1)
            total = letters.sum(axis=1)
            most = letters.argmax(axis=1)
            names = np.array(model.langs, dtype=object)
            pred = np.where(total > 0, names[most], "und")
            score = letters[np.arange(len(texts)), most] / np.maximum(1, total)
            head = np.ones(len(lang), bool)
            head[1:] = (lang[1:] != lang[:-1]) | (doc[1:] != doc[:-1])
            h = np.flatnonzero(head)
            tail = np.concatenate((h[1:] - 1, [len(lang) - 1])) if len(h) else h
            flat = pa.StructArray.from_arrays([pa.array(start[h]), pa.array(end[tail]), pa.array(names[lang[h]], pa.string())], fields=list(span))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[h], minlength=len(texts))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(pred, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = labelled(docs, fit(docs))
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op1_language_id": (query, None)}
