"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed and its normaliser, metaspace marker, unigram scores or merge ranks, and byte fallback are
rebuilt as a ``tokenizers`` pipeline. No piece has a metaspace behind another character (checked when a model is loaded; else
whole texts are encoded), so no merge crosses the start of a word: a text is the concatenation of its words' encodings. Each
chunk of a batch encodes its distinct words once, multithreaded, and ids are put together by array operations. The library costs more per
sequence than per character, so words of a BPE model go to it many in a sequence; only a word's first piece has a metaspace,
which tells the words apart in the ids.
"""

import os
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import small_batches, trimmed_batches

# Fixed values of the SentencePiece format.
METASPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
CHUNK_CHARS = 1 << 20
SECTION_BYTES = 4 << 10  # of words in one sequence
KEPT_CHARS = 1 << 19  # bytes of sequences whose encodings the library holds at once


def laid(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of strings without nulls, from 0 on, and their bytes."""
    if not len(strings):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return ends - ends[0], np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]


def metaspaces(data: np.ndarray) -> np.ndarray:
    """Where in UTF-8 bytes a metaspace begins."""
    found = np.zeros(len(data), bool)
    if len(data) > 2:
        a, b, c = METASPACE.encode()
        found[:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
    return found


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words with the metaspaces before them, and metaspaces at the end of a text; and how many units each text has."""
    ends, data = laid(texts)
    starts = found = metaspaces(data)
    if len(data):
        starts = found.copy()
        starts[3:] &= ~found[:-3]
        # a word without a metaspace begins where a text does
        starts[ends[:-1][np.diff(ends) > 0]] = True
    at = np.flatnonzero(starts)
    cuts = pa.py_buffer(np.append(at, len(data)).astype(np.int32))
    return pa.StringArray.from_buffers(len(at), cuts, pa.py_buffer(data)), np.diff(np.searchsorted(at, ends))


class Codec:
    """A SentencePiece model on the tokenizers library."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import Tokenizer, decoders, models, normalizers

        with open(path, "rb") as f:
            raw = f.read()
        model = proto.ModelProto()
        model.ParseFromString(raw)
        trainer, norm = model.trainer_spec, model.normalizer_spec
        pieces = [p.piece for p in model.pieces]
        vocab = {p: i for i, p in enumerate(pieces)}
        unk = next((i for i, p in enumerate(model.pieces) if p.type == UNKNOWN), None)
        if trainer.model_type == UNIGRAM:
            backend = models.Unigram([(p.piece, p.score) for p in model.pieces], unk, trainer.byte_fallback)
        elif trainer.model_type == BPE:
            usable = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER_DEFINED)}
            ranked = sorted((-model.pieces[i].score, usable[w[:k]], usable[w[k:]], w[:k], w[k:]) for w, i in usable.items() for k in range(1, len(w)) if w[:k] in usable and w[k:] in usable)
            backend = models.BPE(vocab, [(a, b) for *_, a, b in ranked], unk_token=pieces[unk] if unk is not None else None, fuse_unk=True, byte_fallback=trainer.byte_fallback)
        else:
            raise ValueError(f"model type {trainer.model_type} is neither unigram nor BPE")
        steps = []
        if norm.precompiled_charsmap:
            steps.append(normalizers.Precompiled(norm.precompiled_charsmap))
        if norm.remove_extra_whitespaces:
            from tokenizers import Regex

            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.prefix = norm.add_dummy_prefix
        self.escape = norm.escape_whitespaces
        if self.escape:
            steps.append(normalizers.Replace(" ", METASPACE))
        self.normalizer = normalizers.Sequence(steps)
        self.by_words = self.escape and not trainer.treat_whitespace_as_suffix and not any(METASPACE in p.piece.lstrip(METASPACE) for p in model.pieces if p.type in (NORMAL, USER_DEFINED))
        self.tokenizer = Tokenizer(backend)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(METASPACE, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", int(self.prefix), 0)])
        self.pieces = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.replace(METASPACE, " ").encode() for p in model.pieces]
        self.oracle = SentencePieceProcessor(model_proto=raw)
        self.plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        self.joins = self.by_words and trainer.model_type == BPE and METASPACE in usable
        self.first = np.array([p.startswith(METASPACE) for p in pieces], bool)

    def normalized(self, texts: pa.Array) -> pa.Array:
        """Texts as the model sees them; empty ones and nulls are empty."""
        texts = texts.cast(pa.string()).fill_null("")
        if not self.plain:
            texts = pa.array(map(self.normalizer.normalize_str, texts.to_pylist()), pa.string())
        elif self.escape:
            texts = pc.replace_substring(texts, " ", METASPACE)
        return pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(METASPACE, texts, "")) if self.prefix else texts

    def encode_units(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def encode_joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for words that each begin with their only metaspace."""
        ends, data = laid(words)
        cuts = ends[np.unique([0, *(np.flatnonzero(np.diff(ends[:-1] // SECTION_BYTES)) + 1), len(words)])]
        held = np.unique([0, *(np.flatnonzero(np.diff(cuts[:-1] // KEPT_CHARS)) + 1), len(cuts) - 1])
        raw, found = data.tobytes(), [np.zeros(0, np.int32)]
        for lo, hi in zip(held[:-1], held[1:], strict=True):
            coded = self.encode_units([raw[a:b].decode() for a, b in zip(cuts[lo:hi], cuts[lo + 1 : hi + 1], strict=True)])
            found.append(np.fromiter(chain.from_iterable(coded), np.int32))
        flat = np.concatenate(found)
        at = np.flatnonzero(self.first[flat])
        if len(at) != len(words):
            raise ValueError(f"{len(words)} words were encoded as {len(at)}")
        return flat, np.diff(np.append(at, len(flat)))

    def encode_distinct(self, words: pa.Array) -> pa.ListArray:
        ends, data = laid(words)
        found = np.append(metaspaces(data), np.zeros(4, bool))
        joined = found[ends[:-1]] & ~found[ends[:-1] + 3] & (np.diff(ends) > 3) if self.joins else np.zeros(len(words), bool)
        flat, some = self.encode_joined(words.filter(pa.array(joined)))
        coded = self.encode_units(words.filter(pa.array(~joined)).to_pylist())
        order, sizes = np.append(np.flatnonzero(joined), np.flatnonzero(~joined)), np.append(some, np.fromiter(map(len, coded), np.int64, len(coded)))
        pool = np.append(flat, np.fromiter(chain.from_iterable(coded), np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(pool, pa.int32()))
        return lists.take(pa.array(np.argsort(order)))

    def encode(self, texts: pa.Array | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text; a null has none."""
        texts = self.normalized(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if self.by_words:
            words, per_text = units(texts)
        else:
            some = pc.not_equal(texts, "")
            words, per_text = texts.filter(some), some.to_numpy(zero_copy_only=False).astype(np.int64)
        words = words.dictionary_encode()
        coded = self.encode_distinct(words.dictionary)
        sizes = coded.value_lengths().to_numpy()[words.indices.to_numpy()]
        marks = np.append(0, np.cumsum(sizes, dtype=np.int64))[np.append(0, np.cumsum(per_text))]
        return coded.take(words.indices).flatten().to_numpy(), np.diff(marks)

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def local_path(path: str, shipped: bool) -> str:
    return SparkFiles.get(os.path.basename(path)) if shipped else path


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, text_col: str = "text", ids_col: str = "token_ids", count_col: str = "n_tokens", parity_col: str = "parity", trip_col: str = "round_trip", check_one_in: int = 1, ship: bool = False) -> DataFrame:
    """``docs`` with token ids, their number, parity and round trip; columns already so named are replaced.

    ``parity``: whether the ids equal the reference library's, compared for every text, or one in ``check_one_in`` by position
    in its batch (null for the others). ``round_trip``: whether decoding gives back the text. A null text has null in all four, an
    empty one no ids. ``model_path`` is a path that every worker sees; with ``ship`` the driver's file is sent to them.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop(ids_col, count_col, parity_col, trip_col)
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(count_col, T.IntegerType()), T.StructField(parity_col, T.BooleanType()), T.StructField(trip_col, T.BooleanType())]
    schema = T.StructType([*kept.schema.fields, *fields])
    names = [f.name for f in kept.schema.fields]
    if ship:
        docs.sparkSession.sparkContext.addFile(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(local_path(model_path, ship))
        for batch in batches:
            lengths = np.cumsum(np.nan_to_num(np.array(pc.utf8_length(batch.column(text_col)).to_numpy(zero_copy_only=False), float)))
            cuts = np.unique([0, *(np.flatnonzero(np.diff(lengths // CHUNK_CHARS)) + 1), len(lengths)])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(int(lo), int(hi - lo))
                texts = part.column(text_col).to_pylist()
                flat, counts = tool.encode(part.column(text_col))
                ends = np.append(0, np.cumsum(counts))
                parity, trip = [None] * len(texts), [None] * len(texts)
                for i, t in enumerate(texts):
                    if t is not None:
                        ids = flat[ends[i] : ends[i + 1]].tolist()
                        trip[i] = tool.decode(ids) == t
                        if i % check_one_in == 0:
                            parity[i] = tool.oracle.encode(t) == ids
                null = np.array([t is None for t in texts], bool)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists, pa.array(counts, pa.int32(), mask=null), pa.array(parity, pa.bool_()), pa.array(trip, pa.bool_())], [f.name for f in schema.fields])

    return kept.mapInArrow(trimmed_batches(run), schema)


def decode(tokens: DataFrame, model_path: str = DEFAULT_MODEL, ids_col: str = "token_ids", text_col: str = "decoded", ship: bool = False) -> DataFrame:
    """``tokens`` with the text of their ids; null for null, a column already so named is replaced."""
    kept = tokens.drop(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())])
    if ship:
        tokens.sparkSession.sparkContext.addFile(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(local_path(model_path, ship))
        for batch in batches:
            texts = [None if x is None else tool.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return kept.mapInArrow(trimmed_batches(run), schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_tokens", "token_ids", "parity", "round_trip")
