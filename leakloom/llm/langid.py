"""Language identification by a linear-chain conditional random field.

Every word has affix, n-gram and lexicon features; transitions between the languages of neighbouring
words are learned with their weights. Training sequences are spliced from pieces of documents in
different languages, so that the field labels code-switched text. Forward-backward gives each word's
language; a document's language is the one with most of its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakloom.llm.words import mix
from leakloom.session import ship_package

#: Documents of each language that are learned from at most, chosen by a hash of id and text, and of all languages,
#: which is fewer of each when there are many; pieces of each, evenly from its whole text; words of a piece.
PER_LANGUAGE, IN_ALL, PIECES, PIECE = 500, 32_000, 4, 12
#: Hashed weights of each language; entries of the lexicon at most, the most frequent words of a single language.
WEIGHTS, LEXICON = 1 << 17, 50_000
#: Words of a block of forward-backward. What a block passes to its neighbours is carried over, so texts are one sequence each.
SEQUENCE = 64
#: Texts are handled by so many words at once, and a worker remembers the scores of so many; for more
#: languages than FEW it is fewer words, so that tables keep their size.
CHUNK_WORDS, REMEMBERED, FEW = 300_000, 400_000, 8
#: Scores (words x languages) that forward-backward takes at once in training.
CELLS = 1 << 22
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def features(words: list[str], lexicon: dict[str, str], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of words, as (which word, place in the hashed weights): runs of two and three
    characters, beginnings and ends of up to four, the word itself and its language in the lexicon."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    begins, room = np.zeros(len(code), bool), np.repeat(end, size) - np.arange(len(code))
    begins[end - size] = True
    owners, places, total = [], [], code.copy()
    for n in range(2, 6):
        total = total[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        left = room[: len(total)]
        keep = left >= n
        if n > 3:
            keep &= begins[: len(total)] | (left == n)
        owners.append(owner[: len(total)][keep])
        places.append(mix(total[keep] + np.uint64(n)))
    lookup = {x: i for i, x in enumerate(languages)}
    known = np.fromiter((lookup.get(lexicon.get(w), -1) for w in words), np.int64, len(words))
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    owners += [np.arange(len(words)), np.flatnonzero(known >= 0)]
    places += [mix(own + np.uint64(1 << 40)), mix(known[known >= 0].astype(np.uint64) + np.uint64(1 << 41))]
    return np.concatenate(owners), (np.concatenate(places) % np.uint64(WEIGHTS)).astype(np.int64)


def fitting(words: int, languages: int) -> int:
    """So many words, or fewer for many languages."""
    return max(1, words * FEW // max(FEW, languages))


@dataclass
class Field:
    """A trained field: languages, weights (feature x language), transitions and the lexicon."""

    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((WEIGHTS, 0), np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    lexicon: dict[str, str] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (word x language); a word's are computed once a worker while they fit the memory."""
        known, table = self.__dict__.setdefault("_memo", ({}, np.zeros((fitting(REMEMBERED, len(self.languages)), len(self.languages)), np.float32)))
        if not words:
            return table[:0]
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > len(table):
            known.clear()
            new = list(dict.fromkeys(words))
            if len(new) > len(table):  # more words at once than are remembered
                return self._scored(new)[np.fromiter(map({w: i for i, w in enumerate(new)}.get, words), np.int64, len(words))]
        if new:
            table[len(known) : len(known) + len(new)] = self._scored(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def _scored(self, words: list[str]) -> np.ndarray:
        owner, place = features(words, self.lexicon, self.languages)
        return np.stack([np.bincount(owner, self.weights[place, j], len(words)) for j in range(len(self.languages))], 1).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}

    def marginals(self, words: list[str], counts: list[int]) -> np.ndarray:
        """Each word's distribution over the languages, for texts that have so many words each; each text is one sequence."""
        scores = self.emissions(words)
        n = np.asarray(counts, np.int64)
        blocks = -(-n // SEQUENCE)
        if not blocks.sum():
            return scores
        head = np.repeat(np.cumsum(blocks) - blocks, blocks)  # the first block of each block's text
        turn = np.arange(len(head)) - head
        first = np.repeat(np.cumsum(n) - n, blocks) + turn * SEQUENCE
        size = np.minimum(SEQUENCE, np.repeat(n, blocks) - turn * SEQUENCE)
        place = first[:, None] + np.minimum(np.arange(SEQUENCE), size[:, None] - 1)
        real = np.arange(SEQUENCE) < size[:, None]
        given, asked = carried(scores[place], real, self.transitions, turn)
        return forward_backward(scores[place], real, self.transitions, given, asked)[0][real]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.max(-1, keepdims=True)


def carried(scores: np.ndarray, real: np.ndarray, transitions: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each block (block x place x label) gets from the one before it and from the one after, each up to a factor.

    turn is a block's place in its text, whose blocks are consecutive. With few labels each block's
    effect is a matrix, and only matrices are chained; with many, the blocks of all texts are walked
    through in turn. Both give the same.
    """
    n, length, labels = scores.shape
    given, asked = np.ones((n, labels)), np.ones((n, labels))
    of_turn = [np.flatnonzero(turn == t) for t in range(1, int(turn.max(initial=0)) + 1)]
    if not of_turn:
        return given, asked
    e, a = np.exp(scores - scores.max(2, keepdims=True)).astype(np.float64), np.exp(transitions)

    def ahead(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        for t in range(length):
            moved = x if not t else x @ a
            x = np.where(real[rows, t][(...,) + (None,) * (x.ndim - 1)], moved * (e[rows, t] if x.ndim == 2 else e[rows, t][:, None]), x)
            x = x / x.reshape(len(x), -1).max(1)[(...,) + (None,) * (x.ndim - 1)]
        return x

    def back(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        for t in range(length - 1, -1, -1):
            x = np.where(real[rows, t, None], _scaled((x * e[rows, t]) @ a.T), x)
        return x

    if labels <= FEW:
        some = np.unique(np.concatenate([np.concatenate([r, r - 1]) for r in of_turn]))
        effect = np.zeros((n, labels, labels))
        effect[some] = ahead(np.tile(np.eye(labels), (len(some), 1, 1)), some)
        for rows in of_turn:
            given[rows] = _scaled(np.einsum("ni,nij->nj", given[rows - 1], effect[rows - 1]) @ a)
        for rows in reversed(of_turn):
            asked[rows - 1] = _scaled(np.einsum("nij,nj->ni", effect[rows], asked[rows]) @ a.T)
    else:
        for rows in of_turn:
            given[rows] = _scaled(ahead(given[rows - 1], rows - 1) @ a)
        for rows in reversed(of_turn):
            asked[rows - 1] = back(asked[rows], rows)
    return given, asked


def forward_backward(scores: np.ndarray, real: np.ndarray, transitions: np.ndarray, given: np.ndarray | None = None, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of sequences (sequence x place x label), expected transitions, and the log partition sum.

    real says which places have words; they come first in each sequence. given and asked are what
    sequences get from parts of them before and after (see carried()), if they have any.
    """
    n, length, labels = scores.shape
    top = scores.max(2, keepdims=True)
    e, a = np.exp(scores - top).astype(np.float64), np.exp(transitions)
    alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones((n, length))
    alpha[:, 0] = e[:, 0] if given is None else e[:, 0] * given
    if asked is not None:
        beta[:] = asked[:, None]
    for t in range(length):
        if t:
            alpha[:, t] = np.where(real[:, t, None], (alpha[:, t - 1] @ a) * e[:, t], alpha[:, t - 1])
        scale[:, t] = alpha[:, t].sum(1)
        alpha[:, t] /= scale[:, t, None]
    for t in range(length - 2, -1, -1):
        ahead = ((e[:, t + 1] * beta[:, t + 1]) @ a.T) / scale[:, t + 1, None]
        beta[:, t] = np.where(real[:, t + 1, None], ahead, beta[:, t])
    both = alpha * beta
    both /= both.sum(2, keepdims=True)
    moved = np.zeros((labels, labels))
    for t in range(1, length):
        ok = real[:, t]
        if ok.any():
            moved += (alpha[ok, t - 1] / scale[ok, t, None]).T @ (e[ok, t] * beta[ok, t])
    total = float((np.log(scale) * real).sum() + (top[:, :, 0] * real).sum())
    return both, moved * a, total


def fit(pieces: list[tuple[str, list[str]]], rounds: int = 40, seed: int = 7) -> Field:
    """Train on pieces (language, words), spliced at random into sequences of several pieces."""
    languages = sorted({x for x, _ in pieces})
    if not languages:
        return Field()
    code = {x: i for i, x in enumerate(languages)}
    pieces = [(code[x], w) for x, w in pieces if w]
    random = np.random.default_rng(seed)
    pieces = [pieces[i] for i in random.permutation(len(pieces))]
    seen: dict[str, Counter] = defaultdict(Counter)
    for label, words in pieces[::2]:  # the other half meets words that the lexicon lacks
        for w in words:
            seen[w][label] += 1
    frequent = sorted(((sum(c.values()), w) for w, c in seen.items() if len(c) == 1 and sum(c.values()) > 1), reverse=True)[:LEXICON]
    lexicon = {w: languages[next(iter(seen[w]))] for _, w in frequent}
    sequences, labels, i = [], [], 0
    while i < len(pieces):  # neighbours in the permutation differ in language as languages do in number
        take = pieces[i : i + int(random.integers(1, 5))]
        i += len(take)
        sequences.append([w for _, words in take for w in words][:SEQUENCE])
        labels.append([label for label, words in take for _ in words][:SEQUENCE])
    vocabulary = {w: j for j, w in enumerate(sorted({w for s in sequences for w in s}))}
    owner, place = features(list(vocabulary), lexicon, languages)
    used, slot = np.unique(place, return_inverse=True)
    n, k = len(sequences), len(languages)
    word, gold, real = np.zeros((n, SEQUENCE), np.int64), np.zeros((n, SEQUENCE), np.int64), np.zeros((n, SEQUENCE), bool)
    for r, (s, y) in enumerate(zip(sequences, labels, strict=True)):
        word[r, : len(s)], gold[r, : len(s)], real[r, : len(s)] = [vocabulary[w] for w in s], y, True
    target = np.zeros((k, k))
    both = real[:, 1:] & real[:, :-1]
    np.add.at(target, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    weights, moves = np.zeros((len(used), k)), np.zeros((k, k))
    m, v, mm, vm = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)
    words_total = real.sum()
    flat_word, flat_gold = word[real], gold[real]
    rows = max(1, CELLS // (SEQUENCE * k))
    for step in range(1, rounds + 1):
        of_word = np.stack([np.bincount(owner, weights[slot, j], len(vocabulary)) for j in range(k)], 1)
        by_word, moved, at = np.zeros((len(vocabulary), k)), np.zeros((k, k)), 0
        for low in range(0, n, rows):
            part = real[low : low + rows]
            p, seen_moves, _ = forward_backward(of_word[word[low : low + rows]], part, moves)
            g = -p[part]
            here = slice(at, at + len(g))
            g[np.arange(len(g)), flat_gold[here]] += 1
            by_word += np.stack([np.bincount(flat_word[here], g[:, j], len(vocabulary)) for j in range(k)], 1)
            moved += seen_moves
            at += len(g)
        by_word /= words_total
        grad = np.stack([np.bincount(slot, by_word[owner, j], len(used)) for j in range(k)], 1) - 1e-6 * weights
        grad_moves = (target - moved) / words_total - 1e-5 * moves
        for x, d, first, second, rate in ((weights, grad, m, v, 0.08), (moves, grad_moves, mm, vm, 0.15)):
            first += 0.1 * (d - first)
            second += 0.01 * (d * d - second)
            x += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    full = np.zeros((WEIGHTS, k), np.float32)
    full[used] = weights
    return Field(languages, full, moves, lexicon)


def held_out(doc_id):
    """Rows that are never learned from; a null id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = _WORD.findall((text or "").lower())
            for i in range(PIECES):  # evenly from the whole text
                at = max(0, len(words) - PIECE) * i // max(1, PIECES - 1)
                if words and (i == 0 or at):
                    out.append((lang, words[at : at + PIECE]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.string()))], ["lang", "words"])


def first_by(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key; tasks cut to n before rows are exchanged."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def train(docs: DataFrame, usable) -> Field:
    """Train on PER_LANGUAGE usable documents of each language at most, of about IN_ALL at most, and one of each at least."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(usable(F.col("doc_id")))
    known = known.select("lang", "text", F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1).alias("h"))
    letters = F.col("text").rlike(r"\p{L}")  # a text without letters teaches nothing
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.when(letters, F.col("h"))).alias("least")).collect()  # a row a language
    if not counts:
        return Field()
    each = min(PER_LANGUAGE, max(1, IN_ALL // len(counts)))
    # Four times the share first, then exactly so many: copies of a text may share a hash.
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * each / r["n"]) * (1 << 62), r["least"]) for r in counts], "lang string, most double, least long")
    chosen = known.join(F.broadcast(share), "lang").filter((F.col("h") < F.col("most")) | (F.col("h") == F.col("least")))
    chosen = first_by(chosen.withColumn("dumb", ~letters), ["lang"], ["dumb", "h", "text"], each)
    pieces = chosen.select("lang", "text").mapInArrow(_piece_batches, "lang string, words array<string>").toPandas()
    ordered = sorted((lang, list(words)) for lang, words in zip(pieces["lang"], pieces["words"], strict=True))
    return fit(ordered)


def _groups(counts: list[int], most: int = CHUNK_WORDS) -> Iterator[tuple[int, int]]:
    low, total = 0, 0
    for i, n in enumerate(counts):
        if i > low and total + n > most:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(counts):
        yield low, len(counts)


def _words(text: str | None) -> list[str]:
    """The words, or none if nothing in them is a letter."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def _predict_batches(given, words_too: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = given.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _groups([len(t or "") // 5 for t in texts], fitting(CHUNK_WORDS, len(f.languages))):
                lists = [_words(t) if f.languages else [] for t in texts[low:high]]
                counts = [len(x) for x in lists]
                p = f.marginals([w for x in lists for w in x], counts)
                label = p.argmax(1) if len(p) else np.zeros(0, np.int64)
                langs, shares, switches, tags, at = [], [], [], [], 0
                for n in counts:
                    if n:
                        mean = p[at : at + n].mean(0)
                        langs.append(f.languages[int(mean.argmax())])
                        shares.append(min(1.0, float(mean.max())))
                    else:
                        langs.append(UNKNOWN)
                        shares.append(0.0)
                    switches.append(int(np.count_nonzero(np.diff(label[at : at + n]))))
                    if words_too:
                        tags.append([f.languages[i] for i in label[at : at + n]])
                    at += n
                columns = [batch.column(0).slice(low, high - low), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(switches, pa.int64())]
                names = ["doc_id", "lang_pred", "score", "switches"]
                if words_too:
                    columns += [pa.array(lists, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.string()))]
                    names += ["words", "langs"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def predict(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", words_too: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and switches of every whole text, and on wish its words and their languages.

    A text that is null or has no letter is `und` with score 0, as all are when nothing was learned;
    score is the mean probability of the language over the words; switches counts changes of language
    from word to word. Every row is predicted by itself; an empty table gives none.
    """
    ship_package(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict_batches(given, words_too), "doc_id long, lang_pred string, score double, switches long" + ", words array<string>, langs array<string>" * words_too)


def op9_crf_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document; languages are learned from rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ship_package(spark)
    out = predict(docs, train(docs, lambda c: ~held_out(c)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "switches")
