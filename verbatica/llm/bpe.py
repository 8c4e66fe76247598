"""BPE encoding and decoding with a given tokenizer file.

Each word's parts stand in one contiguous array of ids beside one of the ranks of adjacent pairs: the smallest rank is found
by a scan, its boundary is deleted, and the neighbouring ranks are looked up anew.  Words of more than ``LONG`` bytes
take a heap instead, with the same merges in the same order, as scanning would cost the square of their length.

The file has a vocabulary, ranked merges with a word end, and special tokens that are taken from the raw text; text is
brought to NFC and lower case, and split into letters, single digits and other marks; what is a letter follows Unicode 16,
whatever the tables of the `regex` module say.  Its model is broadcast (about 2 MB,
whatever the data); each worker remembers at most ``REMEMBERED`` words.  Nothing is shuffled.

A null or empty text has no tokens and decodes as the empty text.  Each row is encoded on its own, so repeated rows repeat.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import table
from .textops import portions

LONG, REMEMBERED = 256, 200_000
FILE = "word_bpe_49k.json"
_NONE = 1 << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


#: Letters and digits that Unicode 16 added, as ranges; and capitals that Unicode 16 and 17 added, with how far on their small letters are.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_DIGITS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
_SMALL = {c: chr(c + by) for a, b, by in NEW_CAPITALS for c in range(a, b + 1)}


@lru_cache(maxsize=1)
def _newer() -> dict[int, str]:
    """Code points that `unicodedata` doesn't know, where `regex` or Unicode 16 takes them for letters, numbers or space; a stand-in of the right kind for each."""
    unknown = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    known = {c: stand_in for ranges, stand_in in ((NEW_LETTERS, "a"), (NEW_DIGITS, "0")) for a, b in ranges for c in range(a, b + 1)}
    taken = {ord(c) for c in regex.findall(r"[\p{L}\p{N}\s]", "".join(map(chr, unknown)))}
    return {c: known.get(c, "\uffff") for c in unknown if c in known or c in taken}


@lru_cache(maxsize=1)
def _newer_letters() -> frozenset[str]:
    return frozenset(map(chr, _newer().keys() | _SMALL.keys()))


class Model:
    """What the file says, in the form that encoding needs."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.word = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def parts(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        return self._by_scan(ids) if len(ids) <= LONG else self._by_heap(ids)

    def _by_scan(self, ids: list[int]) -> list[int]:
        look = self.rank.get
        ranks = [look(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            ids[i] = self.merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = look(ids[i - 1] << 32 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = look(ids[i] << 32 | ids[i + 1], _NONE)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        look, n = self.rank.get, len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := look(ids[i] << 32 | ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or look(ids[i] << 32 | ids[j], _NONE) != r:
                continue
            ids[i], ids[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (s := look(ids[k] << 32 | ids[after[k]], _NONE)) != _NONE:
                    heapq.heappush(heap, (s, k))
        return [i for i in ids if i >= 0]

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma by itself, whatever follows
        return text.lower()

    def words(self, text: str) -> list[str]:
        """The words of a text in normal form."""
        text = self.normal(text)
        if text.isascii() or _newer_letters().isdisjoint(text):
            return self.word.findall(text)
        text = text.translate(_SMALL)
        return [text[m.start() : m.end()] for m in self.word.finditer(text.translate(_newer()))]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids if i in self.token)


class _Known(dict):
    """Packed ids and decoded text of each word met so far."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> tuple[bytes, str]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.model.parts(word)
        value = (b"".join(i.to_bytes(4, "little") for i in ids), self.model.decode(ids))
        if len(word) <= LONG:
            self[word] = value
        return value


class Encoder:
    def __init__(self, text: str):
        self.model = Model(text)
        self.known = _Known(self.model)

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and what they decode to."""
        model, known = self.model, self.known
        if model.marks is None or not any(m in text for m in model.special):
            got = [known[w] for w in model.words(text)]
        else:
            got = []
            for piece in model.marks.split(text):
                if piece in model.special:
                    got.append((model.special[piece].to_bytes(4, "little"), piece))
                else:
                    got += [known[w] for w in model.words(piece)]
        return b"".join([x[0] for x in got]), " ".join([x[1] for x in got])


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of every row: ids packed as little-endian unsigned 32-bit integers, and their decoded text."""
    with open(path, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        for batch, texts in portions(batches, text):
            got = [encoder.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())],
                                             names=[key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids binary, decoded string")


def decoded(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """tokens with the text of packed ids, as decoded_text; a null array has a null text, ids not in the file are left out."""
    with open(path, encoding="utf-8") as file:
        held = tokens.sparkSession.sparkContext.broadcast(file.read())
    schema = StructType([*tokens.schema.fields, StructField("decoded_text", StringType())])
    place = tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(held.value)
        for batch in batches:
            packed = batch.column(place).to_pylist()
            out = [None if p is None else model.decode(memoryview(p).cast("I").tolist()) for p in packed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded_text"])

    return tokens.mapInArrow(run, schema)


def _digests(tokens: DataFrame) -> list:
    return [(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
            F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's packed ids and their digests."""
    tokens = encoded(docs, default_path())
    return tokens.select("doc_id", "ids", *_digests(tokens))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = encoded(table(spark, sf_dir, "documents"), default_path())
    return tokens.select("doc_id", *_digests(tokens))


QUERIES = {"op8_bpe_round_trip": (query, None)}
