"""Token counts by a whole-token shortcut, and token ids, of byte-level BPE tokenizers.

Texts are cut into pre-tokens; a pre-token that is proven to encode as one token is counted
without merging, and only other pre-tokens go through the merges, once each per worker and cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leakloom.session import ship_package

#: Pre-tokens remembered by a worker, and the longest of them; the memory is emptied when it is full.
REMEMBERED, LONG = 400_000, 64
#: In this range letters, digits, lower case and white space are the same for Python and the library.
PLAIN = re.compile("[^\x00-\x1b\x20-\u024f]")
_END = "</w>"
#: The pattern of word_bpe_49k.json, for texts in PLAIN's range, where \w less digits and _ are the letters and \d only digits.
_WORDY = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
#: The byte-level pattern, likewise.
_BYTEY = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_loaded: dict[str, object] = {}


def byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))


def tokenizer(path: str):
    """The library's tokenizer, loaded once per worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def spelled(pre_token: str) -> str:
    return pre_token.encode().decode("latin-1").translate(_LETTERS)


def proven_whole(path: str) -> frozenset[str]:
    """The pre-tokens of the vocabulary that the tokenizer's own merges turn into a single token.

    Proven offline, string by string: an entry that ends a word is spelled back into characters and
    encoded alone; what gives more than one token is left out. Its size is bounded by the vocabulary.
    """
    t = tokenizer(path)
    back = {c: b for b, c in _LETTERS.items()}
    whole = set()
    for entry in t.get_vocab(with_added_tokens=False):
        if not entry.endswith(_END) or len(entry) == len(_END):
            continue
        shown = entry[: -len(_END)]
        if len(t.model.tokenize(shown)) == 1 and all(c in back for c in shown):
            try:
                whole.add(bytes(back[c] for c in shown).decode())
            except UnicodeDecodeError:
                pass  # part of a character: no pre-token
    return frozenset(whole)


class Counts(dict):
    """Tokens of each pre-token met so far: whole ones are known, others are merged when first met."""

    def __init__(self, path: str, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.model, self.whole = tokenizer(path).model, whole

    def __missing__(self, pre_token: str) -> int:
        if len(self) > REMEMBERED + len(self.whole):
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = len(self.model.tokenize(spelled(pre_token)))
        if len(pre_token) <= LONG:
            self[pre_token] = n
        return n


def _special(t) -> re.Pattern:
    """The added tokens, which the library finds in the raw text before anything else."""
    return re.compile("(" + "|".join(sorted(map(re.escape, (a.content for a in t.get_added_tokens_decoder().values())), key=len, reverse=True)) + ")")


def pre_tokens(t, text: str) -> list[str]:
    """The pre-tokens, as characters; beyond PLAIN's range by the library's own normalizer and splitter."""
    if not PLAIN.search(text):
        return _WORDY.findall(text.lower())
    back = {c: b for b, c in _LETTERS.items()}
    return [bytes(back[c] for c in piece).decode() for piece, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]


def count_batches(path: str, whole) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        if ("counts", path) not in _loaded:
            _loaded["counts", path] = Counts(path, whole.value)
        counts, special = _loaded["counts", path], _special(t)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode()))
                n = 0
                for i, part in enumerate(special.split(text)):
                    n += 1 if i % 2 else sum(map(counts.__getitem__, pre_tokens(t, part)))
                n_tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text, as the tokenizer at path gives them.

    A null text counts as empty: 0 and 0. Repeated rows each give their row; an empty table gives
    none; other columns are not carried. Nothing is shuffled.
    """
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    ship_package(spark)
    whole = spark.sparkContext.broadcast(proven_whole(path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count_batches(path, whole), "doc_id long, n_bytes long, n_tokens long")


class Ids(dict):
    """The ids of each pre-token met so far, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.model = tokenizer(path).model

    def __missing__(self, pre_token: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = np.array([x.id for x in self.model.tokenize(spelled(pre_token))], "<u4").tobytes()
        if len(pre_token) <= LONG:
            self[pre_token] = ids
        return ids


def encoder(path: str) -> Callable[[str], bytes]:
    """A function that gives the ids of a whole text as little-endian unsigned 32-bit numbers."""
    t = tokenizer(path)
    if ("ids", path) not in _loaded:
        _loaded["ids", path] = Ids(path)
    known, special = _loaded["ids", path], _special(t)
    added = {a.content: np.array([i], "<u4").tobytes() for i, a in t.get_added_tokens_decoder().items()}

    def encode(text: str) -> bytes:
        out = []
        for i, part in enumerate(special.split(text)):
            if i % 2:
                out.append(added[part])
            elif PLAIN.search(part):
                out.append(np.array(t.encode(part, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join(map(known.__getitem__, _BYTEY.findall(part))))
        return b"".join(out)

    return encode


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under the word-level vocabulary, and whether they exceed 2048."""
    import public_tokenizers

    from pyspark.sql import functions as F

    out = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
