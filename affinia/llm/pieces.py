"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece has a white-space marker behind another character, no merge crosses from a word into
the next marker. A chunk, one or more markers and the characters up to the next marker, is then
segmented on its own. The texts of a lot are cut into chunks, each distinct chunk is looked up or segmented
once, and the ids are joined back by position, all as columns. A task remembers the chunks of its lots.
For a model with other pieces, whole texts go to the library.

The model's bytes are sent with the task (fixed size), so that executors need no path of the driver's.

Defined results: a null text counts as empty; an empty text encodes to the end id alone and decodes to
an empty text. Long chunks (over LONG characters) and chunks beyond TABLE entries are segmented anew
in each lot; results do not depend on either bound, nor on the lots. Repeated rows give the same ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from affinia.llm.hashing import chunks

MARK = "▁"
#: Distinct chunks that a task remembers, and the longest of them.
TABLE, LONG = 200_000, 200
#: Bytes of texts that are cut and joined together; a longer text is a lot of its own.
LOT = 1 << 21
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


def _together(values: pa.Array, at: np.ndarray) -> pa.Array:
    """Runs of values that lie side by side, each as one value: the same bytes with fewer offsets."""
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(values) + 1, 8 * values.offset)[at] if len(values) else np.zeros(len(at), np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(bounds.tobytes()), data])


class ChunkTable:
    """The ids of chunks, each segmented once, and the text of each id."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        plain = sp.normalize("a  b▁ﬁ ") == f"{MARK}a{MARK}{MARK}b{MARK}ﬁ{MARK}"
        self.by_chunk = plain and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.end = sp.eos_id()
        self.x = len(sp.encode("x"))
        #: Ids whose text isn't that of their piece: unknown, control and byte pieces.
        self.odd = np.array([sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(len(pieces))])
        self.decimal = pa.array([b" %d" % i for i in range(len(pieces))], pa.large_binary())
        self.texts = pa.array([p.replace(MARK, " ").encode() for p in pieces], pa.large_binary())
        self.known: dict[str, list[int]] = {}

    def segmented(self, found: list[str]) -> list[list[int]]:
        """The ids of some distinct chunks: a word behind one marker, or else a chunk with its markers."""
        new = [c for c in found if c not in self.known]
        made: dict[str, list[int]] = {}
        if new:
            texts = [c[1:] if c[:1] == MARK and self.by_chunk else c for c in new]
            # The library adds one marker; markers alone are segmented behind another character.
            lone = [self.by_chunk and not t.strip(MARK) for t in texts]
            ids = self.sp.encode(["x " + t if x else t for t, x in zip(texts, lone, strict=True)], num_threads=1)
            made = {c: i[self.x :] if x else i for c, i, x in zip(new, ids, lone, strict=True)}
        known = self.known
        out = [known[c] if c in known else made[c] for c in found]
        if len(known) + len(made) > TABLE:
            known.clear()
        known.update((c, i) for c, i in made.items() if len(c) <= LONG)
        return out

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The chunks of texts one after the other, where those of each text start, and the order that the texts are in."""
        plain = pc.replace_substring(texts, MARK, " ")
        by_word = pc.invert(pc.or_(pc.match_substring(plain, "  "), pc.or_(pc.starts_with(plain, " "), pc.equal(plain, ""))))
        simple = by_word.to_numpy(zero_copy_only=False) & self.by_chunk
        words = pc.split_pattern(plain.filter(pa.array(simple)), " ")
        lists: list[list[str]] = []
        for text in texts.filter(pa.array(~simple)).to_pylist():
            found = ([text] if text else []) if not self.by_chunk else _MARKED.findall(MARK + text.replace(" ", MARK)) if text else []
            lists.append([c[1:] if self.by_chunk and len(c) > 1 and c[1] != MARK else c for c in found])
        sizes = np.concatenate((pc.list_value_length(words).to_numpy(), np.array([len(x) for x in lists], np.int64))).astype(np.int64)
        flat = pa.concat_arrays([words.flatten(), pa.array([c for x in lists for c in x], words.type.value_type)])
        return flat, np.concatenate(([0], np.cumsum(sizes))), np.argsort(np.concatenate((np.flatnonzero(simple), np.flatnonzero(~simple))))

    def joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of texts one after the other, where those of each start, and the order that the texts are in."""
        flat, at, order = self.cut(texts)
        distinct = flat.dictionary_encode()
        ids = pa.array(self.segmented(distinct.dictionary.to_pylist()), pa.large_list(pa.int32())).take(distinct.indices)
        counts = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy().astype(np.int64))))
        return ids.flatten().to_numpy(), counts[at], order

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The text of each run of ids."""
        found = [t[1:] for t in _together(self.texts.take(pa.array(ids)), at).to_pylist()]
        odd = np.concatenate(([0], np.cumsum(self.odd[ids])))
        for k in np.flatnonzero(odd[at[1:]] > odd[at[:-1]]).tolist():
            found[k] = self.sp.decode(ids[at[k] : at[k + 1]].tolist()).encode()
        return found

    def lots(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for row, _, at in chunks(texts, LOT):
            yield self.joined(texts.slice(row, len(at) - 1).fill_null(""))


def _mapped(docs: DataFrame, make: Callable[[ChunkTable, pa.Array], list[pa.Array]], model: bytes, text_col: str, schema: str) -> DataFrame:
    """docs with more columns that make gives for the texts of a batch."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    more = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(sent.value)
        for batch in batches:
            yield pa.record_batch([*batch.columns, *make(table, batch.column(names.index(text_col)))], [*names, *more])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(schema).fields]))


def _ids(table: ChunkTable, texts: pa.Array) -> list[pa.Array]:
    out: list[list[int]] = []
    for ids, at, order in table.lots(texts):
        out += [[*ids[at[k] : at[k + 1]].tolist(), table.end] for k in order.tolist()]
    return [pa.array(out, pa.list_(pa.int32()))]


def encode(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """docs with ids, the pieces of each text and the end id."""
    return _mapped(docs, _ids, model, text_col, "ids array<int>")


def decode(rows: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """rows with decoded, the text of their ids."""
    names, sent = rows.columns, rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(sent.value)
        for batch in batches:
            made = [table.sp.decode(ids or []) for ids in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(made, pa.string())], [*names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def _digest(table: ChunkTable, texts: pa.Array) -> list[pa.Array]:
    counts, of_ids, of_texts, end = [], [], [], b" %d" % table.end
    for ids, at, order in table.lots(texts):
        counts.append(np.diff(at)[order] + 1)
        written = [hashlib.sha256((x + end)[1:]).hexdigest() for x in _together(table.decimal.take(pa.array(ids)), at).to_pylist()]
        decoded = [hashlib.sha256(x).hexdigest() for x in table.decoded(ids, at)]
        of_ids += [written[k] for k in order.tolist()]
        of_texts += [decoded[k] for k in order.tolist()]
    return [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]


def digests(docs: DataFrame, model: bytes, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, and decoded from the ids again."""
    id_: Column = F.col(id_col).alias("doc_id")
    slim = docs.select(id_, F.col(text_col).alias("text"))
    return _mapped(slim, _digest, model, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string").drop("text")
