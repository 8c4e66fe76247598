"""Fill-in-the-middle transformation of whole texts, as a pipeline of Arrow compute functions.

A text of n code points is cut at two places drawn by a hash of its key into prefix, middle and suffix, which are put in another order
with a sentinel before each, so that a model learns to fill a gap.  Each batch goes through one pipeline:

1. The texts are split into units (code points), a list for each text.
2. The lists are flattened, with the index of each unit's text beside it, and each unit gets its ordinal in its text.
3. Units are filtered by role: before the first cut, between the cuts, from the second cut on.
4. Lists are rebuilt from the units of each role and joined to pieces, and pieces and sentinels are joined to the output.

A text stays as it is (form ``plain``) if it is empty or null, if it already holds a sentinel, or by the hash for a share of all texts.
Whatever the form, the text can be rebuilt from output and form alone (``restored``): no sentinel can arise at a seam, since each begins
with `<` and ends with `>` and has neither inside.

Nothing is shuffled.  A batch is cut into portions of about ``PORTION`` bytes, so memory is bounded by that or by the longest text.  Rows that
repeat a key are cut by the same hash, each by its own length; a null key hashes like an empty one.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import table

#: Sentinels of the pieces, percent of texts that stay plain, and of the others those with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, TRANSFORMED, SUFFIX_FIRST = 1, 90, 20
#: Bytes of text that are split at once.
PORTION = 1_000_000


def units(texts: pa.Array) -> pa.ListArray:
    """A list of the code points of each text; texts begin at the start of their buffers and hold no null."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    first = np.flatnonzero(np.frombuffer(data, np.uint8)[: ends[-1]] & 0xC0 != 0x80).astype(np.int32)
    each = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, ends[-1]).astype(np.int32)), data)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, ends).astype(np.int32)), each)


def pieces(texts: pa.Array, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text, cut before its units number low and high."""
    lists = units(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begin = pc.take(lists.offsets.cast(pa.int64()), parent)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), begin)
    before, inside = pc.less(ordinal, pc.take(low, parent)), pc.less(ordinal, pc.take(high, parent))
    roles = [(before, low), (pc.and_not(inside, before), pc.subtract(high, low)), (pc.invert(inside), pc.subtract(pc.list_value_length(lists), high))]
    out = []
    for role, length in roles:
        offsets = np.append(0, np.cumsum(np.asarray(length))).astype(np.int32)
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pc.filter(flat, role)), ""))
    return out


def _outputs(texts: pa.Array, form: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    plain = pc.equal(form, "plain")
    cut = pc.invert(plain)
    chosen = pc.filter(texts, cut)
    if not len(chosen):
        return texts
    prefix, middle, suffix = pieces(pa.concat_arrays([chosen]), pc.filter(low, cut), pc.filter(high, cut))
    by_prefix = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    by_suffix = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    return pc.replace_with_mask(texts, cut, pc.if_else(pc.equal(pc.filter(form, cut), "spm"), by_suffix, by_prefix))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(names.index("text")))).astype(np.int64))
        ends = np.unique(np.append(np.searchsorted(sizes, np.arange(PORTION, sizes[-1] + PORTION, PORTION), side="right"), batch.num_rows))
        at = 0
        for end in ends[ends > 0].tolist():
            part = batch.slice(at, end - at)
            text, form, low, high = (part.column(names.index(name)) for name in ("text", "form", "low", "high"))
            kept = [part.column(k) for k, name in enumerate(names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, _outputs(text, form, low, high)], names=[*(name for name in names if name != "text"), "output"])
            at = end


def transformed(docs: DataFrame, key: str = "doc_id", seed: int = SEED, rate: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row of docs; form is plain, psm or spm."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    read = docs.select(F.col(key), text.alias("text"), F.char_length(text).cast("long").alias("n"), digest.alias("digest"))
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    places = [h[i] % (F.col("n") + 1) for i in (0, 1)]
    kept = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (h[2] % 100 >= rate)
    read = read.select(key, "text", "n", F.when(kept, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm").alias("form"),
                       F.least(*places).alias("low"), F.greatest(*places).alias("high"))
    kind = docs.select(key).schema[0].dataType.simpleString()
    out = read.mapInArrow(_batches, f"`{key}` {kind}, n long, form string, low long, high long, output string")
    cut = F.col("form") != "plain"
    return out.select(key, "n", "form", F.when(cut, F.col("low")).alias("prefix_chars"), F.when(cut, F.col("high") - F.col("low")).alias("middle_chars"), "output")


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    split = F.when(form == "spm", PREFIX).otherwise(SUFFIX)
    one = F.substr(body, F.lit(1), F.position(split, body) - 1)
    rest = F.substr(body, F.position(split, body) + len(SUFFIX))
    two = F.substr(rest, F.lit(1), F.position(F.lit(MIDDLE), rest) - 1)
    middle = F.substr(rest, F.position(F.lit(MIDDLE), rest) + len(MIDDLE))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transformed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_H = [f"('0x' || substr(digest, {8 * i + 1}, 8))::bigint" for i in range(4)]
ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as digest from documents),
h as (select *, least({_H[0]} % (n + 1), {_H[1]} % (n + 1)) as low, greatest({_H[0]} % (n + 1), {_H[1]} % (n + 1)) as high,
      case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or {_H[2]} % 100 >= {TRANSFORMED} then 'plain'
           when {_H[3]} % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from d),
p as (select *, substr(text, 1, low) as pre, substr(text, low + 1, high - low) as mid, substr(text, high + 1) as suf from h)
select doc_id, n::bigint as n, form, case when form <> 'plain' then low end::bigint as prefix_chars, case when form <> 'plain' then high - low end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'spm' then '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid
         else '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid end) as output_sha256,
  sha256(text) as restored_sha256 from p
"""

QUERIES = {"op12_fill_in_middle": (query, ORACLE)}
