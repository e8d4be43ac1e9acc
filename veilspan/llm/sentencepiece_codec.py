"""SentencePiece encoding and decoding with the tokenizers library, checked against the sentencepiece library.

The model file is parsed once on the driver and broadcast (its size is fixed by the file).  Each
Python worker rebuilds normaliser, space marker, scores and byte fallback from it.  Where no piece
holds a space marker behind another character, a text falls apart into marker-led words that
encode independently; each batch encodes its unseen words in one multithreaded call and keeps
them in a bounded cache.  Every such word is also encoded by the sentencepiece library:
``parity`` tells whether all of a text's words agree.  ``round_trip`` tells whether decoding the
ids gives the text back.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.pieces import BPE, BYTE, NORMAL, SPACE, UNIGRAM, USER_DEFINED, PieceModel, parse_model, read_model
from veilspan.llm.text import raw

CACHE = 80_000  # words kept of the youngest batches, and as many of those before
RUN = 256
WORD = re.compile(f"{SPACE}+[^{SPACE}]+(?:{SPACE}+$)?|^[^{SPACE}]+|{SPACE}+$")  # markers that end a text stay with the last word


def build_tokenizer(model: PieceModel):
    """A ``tokenizers.Tokenizer`` of the same segmentation as the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if any(kind == USER_DEFINED for *_, kind in model.pieces):
        raise ValueError("user-defined symbols are not supported")
    ids = {text: k for k, (text, _, _) in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        core = models.Unigram([(t, s) for t, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    elif model.kind == BPE:
        usable = {t: s for t, s, kind in model.pieces if kind == NORMAL}
        merges = [(-score, ids[text], ids[text[:k]], (text[:k], text[k:])) for text, score in usable.items()
                  for k in range(1, len(text)) if text[:k] in usable and text[k:] in usable]
        core = models.BPE(ids, [m[-1] for m in sorted(merges)], unk_token=model.pieces[model.unk_id][0], fuse_unk=True,
                          byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps.append(normalizers.Replace(" ", SPACE))
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(),
                                     *([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])])
    if model.spaces_lead():
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*"), "isolated")
    return out


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = parse_model(model)
        self.whole = build_tokenizer(self.model)
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_word = self.model.spaces_lead() and not self.model.charsmap and self.model.add_dummy_prefix
        self.known: dict[str, list[int]] = {}  # words of the youngest batches
        self.older: dict[str, list[int]] = {}  # words known before that; those still in use move over
        self.apart: set[str] = set()  # words on which the two libraries differ
        self.lossy: set[str] = set()  # words that decode to something else

    def learn(self, words: list[str]) -> None:
        """Encodes unseen words, many to a text: the other library's lengths cut a text's ids where all of them agree."""
        texts = [w[1:].replace(SPACE, " ") for w in words]
        theirs = self.judge.encode(texts, num_threads=1)
        runs = [slice(k, k + RUN) for k in range(0, len(words), RUN)]
        ours = self.whole.encode_batch_fast(["".join(words[r])[1:].replace(SPACE, " ") for r in runs], add_special_tokens=False)
        odd = []
        for run, mine in zip(runs, ours):
            if mine.ids == list(chain.from_iterable(theirs[run])):
                self.known.update(zip(words[run], theirs[run]))
            else:
                odd.extend(range(run.start, min(run.stop, len(words))))
        for k, mine in zip(odd, self.whole.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False)):
            self.known[words[k]] = mine.ids
            if mine.ids != theirs[k]:
                self.apart.add(words[k])
        again = self.decode([list(chain.from_iterable(self.known[w] for w in words[r])) for r in runs])
        for run, text in zip(runs, again):
            if SPACE + text.replace(" ", SPACE) != "".join(words[run]):
                one_by_one = self.decode([self.known[w] for w in words[run]])
                self.lossy.update(w for w, t in zip(words[run], one_by_one) if SPACE + t.replace(" ", SPACE) != w)

    def split(self, text: str) -> list[str]:
        if self.model.remove_extra_whitespaces:
            text = re.sub(" {2,}", " ", text.strip(" "))
        return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str]) -> tuple[array, list[int], list[bool], list[bool]]:
        """Ids of all texts on end, how many of each, whether both libraries agree, whether decoding gives the text back."""
        flat, sizes, same, back = array("i"), [], [], []
        if not self.by_word:
            ours = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            flat.extend(chain.from_iterable(ours))
            return (flat, list(map(len, ours)), [a == b for a, b in zip(ours, self.judge.encode(texts, num_threads=1))],
                    [a == b for a, b in zip(self.decode(ours), texts)])
        split = list(map(self.split, texts))
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
            self.apart.intersection_update(self.older), self.lossy.intersection_update(self.older)
        unseen = {w for words in split for w in words}.difference(self.known)
        for word in unseen.intersection(self.older):
            self.known[word] = self.older[word]
        unseen.difference_update(self.known)
        if unseen:
            self.learn(sorted(unseen))
        for text, words in zip(texts, split):
            before = len(flat)
            flat.extend(chain.from_iterable(map(self.known.__getitem__, words)))
            sizes.append(len(flat) - before)
            same.append(self.apart.isdisjoint(words) if self.apart else True)
            plain = SPACE not in text and (not self.model.remove_extra_whitespaces or text == re.sub(" {2,}", " ", text.strip(" ")))
            back.append(plain and (self.lossy.isdisjoint(words) if self.lossy else True))
        return flat, sizes, same, back

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


_codecs: dict[int, Codec] = {}


def _codec(model: bytes) -> Codec:
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def _parts(texts: list[str], limit: int = 1 << 20):
    """Slices of the batch of about ``limit`` characters, a long text alone in its slice."""
    at = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield slice(at, k)
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


def encode_column(spark: SparkSession, model_path: str, text: Column) -> Column:
    """Struct ``(ids, n_tokens, parity, round_trip)``; a null text is encoded as the empty one (no ids)."""
    held = spark.sparkContext.broadcast(read_model(model_path))

    @F.arrow_udf("ids array<int>, n_tokens int, parity boolean, round_trip boolean")
    def run(column: pa.Array) -> pa.Array:
        codec, texts = _codec(held.value), [x.decode("utf-8", "replace") for x in raw(column)]
        ids, sizes, same, back = array("i"), [], [], []
        for part in _parts(texts):
            for all_of, own in zip((ids, sizes, same, back), codec.encode(texts[part])):
                all_of.extend(own)
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(ids, np.int32))), pa.array(sizes, pa.int32()),
             pa.array(same, pa.bool_()), pa.array(back, pa.bool_())], ["ids", "n_tokens", "parity", "round_trip"])

    return run(text)


def decode_column(spark: SparkSession, model_path: str, ids: Column) -> Column:
    """The text of an array of ids; null stays null."""
    held = spark.sparkContext.broadcast(read_model(model_path))

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        rows = column.to_pylist()
        texts = iter(_codec(held.value).decode([r for r in rows if r is not None]))
        return pa.array([None if r is None else next(texts) for r in rows], pa.string())

    return run(ids)


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens``, ``parity`` and ``round_trip``; columns of these names are replaced.

    Every row is kept as it is; a null or empty text has no ids and is its own round trip.  A literal space
    marker in a text reads as a space, as in the sentencepiece library, so such a text is no round trip.
    """
    coded = docs.withColumn("__code", encode_column(docs.sparkSession, model_path, F.col(text)))
    return coded.withColumns({k: F.col(f"__code.{k}") for k in ("ids", "n_tokens", "parity", "round_trip")}).drop("__code")
