"""SentencePiece encoding and decoding over a table of distinct chunks.

Where no piece of the vocabulary crosses from a letter into a white-space marker (checked when the model
is loaded), a text falls into marked words - a run of markers and what follows it - that are segmented
independently of each other. A task segments each distinct marked word once, keeps it in a table of bounded
size, and joins ids and decoded strings back by position. The table is a task's own: joining against one table
for the whole corpus would send every word of every text through a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.workers import bounded_batches, once

MARK = "▁"
#: Words, and their characters, that the table of a task may hold before it is begun anew.
TABLE_WORDS, TABLE_CHARS, WORD_CHARS = 400_000, 8_000_000, 200
#: Characters of texts whose words are segmented in one go; a longer text goes alone.
GROUP_CHARS = 200_000


class ChunkTable:
    """Encoder and decoder of one task: marked word -> ids as text, and the decoded string of those words that don't come back as they were."""

    def __init__(self, model_path: str) -> None:
        self.model = once(("sentencepiece", model_path), lambda: loaded(model_path))
        self.names, self.odd = once(("pieces", model_path), lambda: pieces(model_path))
        self._begin()

    def _begin(self) -> None:
        """Only the marker that stands alone, at the end of a text, which the encoder can't be given."""
        self.ids: dict[str, str] = {"": str(self.model.piece_to_id(MARK))}
        self.decoded: dict[str, str] = {}
        self.chars = 0

    def _add(self, words: set[str]) -> None:
        """A word without spaces whose pieces all stand for themselves is what they decode to; others are decoded."""
        new, name, plain = list(words), self.names.__getitem__, self.odd.isdisjoint
        ids = self.model.encode(new, num_threads=1) if new else []
        self.ids.update(zip(new, [",".join(map(name, i)) for i in ids], strict=True))
        self.chars += sum(map(len, new))
        unsure = [k for k, i in enumerate(ids) if not plain(i) or " " in new[k]]
        for k, d in zip(unsure, self.model.decode([ids[k] for k in unsure], num_threads=1) if unsure else [], strict=True):
            if d != new[k]:
                self.decoded[new[k]] = d

    def batch(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """Of each text its ids, joined by commas, and what they decode to. Words are segmented for several texts at once."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and chars < GROUP_CHARS:
                chars += len(texts[end] or "")
                end += 1
            yield from self._group(texts[at:end])
            at = end

    def _group(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        split = [marked_words(text) if text else None for text in texts]
        every = set().union(*(words for words in split if words))
        missing = every.difference(self.ids)
        if missing:
            if len(self.ids) + len(missing) > TABLE_WORDS or self.chars > TABLE_CHARS:
                self._begin()
                missing = every.difference(self.ids)
            self._add(missing)
        for words in split:
            if words is None:
                yield "", ""
                continue
            changed = bool(self.decoded) and not self.decoded.keys().isdisjoint(words)
            yield ",".join(map(self.ids.__getitem__, words)), " ".join([self.decoded.get(w, w) for w in words] if changed else words)
        if missing and max(map(len, missing)) > WORD_CHARS:  # words of any length are segmented, long ones not kept
            for w in missing:
                if len(w) > WORD_CHARS:
                    self.chars -= len(w)
                    del self.ids[w]
                    self.decoded.pop(w, None)


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker, which the encoder puts there again."""
    if MARK in text:
        text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    return [w[1:] for w in re.findall(" +[^ ]*", " " + text)]


def loaded(model_path: str):
    """The library's processor for a model whose words can be segmented one by one."""
    import sentencepiece

    if reason := crossing(model_path):
        raise ValueError(f"marked words can't be segmented one by one: {reason}")
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def pieces(model_path: str) -> tuple[list[str], frozenset[int]]:
    """The ids of a model in decimal, and those of them that don't stand for their own characters: bytes, controls, unknown ones."""
    model = once(("sentencepiece", model_path), lambda: loaded(model_path))
    ids = range(model.get_piece_size())
    odd = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [str(i) for i in ids], frozenset(i for i in ids if odd(i))


def crossing(model_path: str) -> str:
    """Why words can't be segmented one by one with this model; empty if they can."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        return "its normaliser changes more than white space"
    if proto.trainer_spec.treat_whitespace_as_suffix:
        return "its markers stand behind words"
    if not any(p.piece == MARK and p.type == 1 for p in proto.pieces):
        return "a marker alone is no piece"
    crosses = [p.piece for p in proto.pieces if p.type in (1, 4) and re.search(f"[^{MARK}]{MARK}", p.piece)]
    return f"pieces such as {crosses[0]!r}" if crosses else ""


def encode_documents(documents: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; with keep_ids also ids and decoded; and the columns named in keep.

    As the library's encode(text) and decode(ids), without begin and end ids. Null texts count as empty and
    have no ids (hashes of the empty string). Texts of any length are encoded whole. Rows with null or
    repeated ids are kept; extra columns are ignored. model_path must be readable on every executor.
    """
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * keep_ids
    kinds = dict(documents.dtypes)
    fields += "".join(f", {c} {kinds[c]}" for c in keep)
    bounded_batches(documents.sparkSession)
    given = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(6)]
                for ids, decoded in table.batch(part.column(1).to_pylist()):
                    out[1].append(ids.count(",") + 1 if ids else 0)
                    out[2].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[3].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        out[4].append(ids)
                        out[5].append(decoded)
                types = [pa.int64(), pa.int64(), *[pa.string()] * 4][: 4 + 2 * keep_ids]
                columns = [part.column(0), *(pa.array(x, t) for x, t in zip(out[1:], types[1:], strict=False)), *(part.column(2 + i) for i in range(len(keep)))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

    return given.mapInArrow(run, fields)
