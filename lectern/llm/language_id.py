"""Language identification with a linear-chain conditional random field over words.

Each word gets features from its letters: n-grams with word edges (so affixes are
among them) and, for words of the training lexicon, the word itself. Features are
hashed into one weight table. Transitions between the languages of neighbouring
words are learned with the weights, from chains spliced out of pieces of different
documents, so that the field knows code-switched text. Forward-backward gives each
word's probability of each language; a text's language is the likeliest over its
words, and its score is the mean probability.

The field is fitted on a bounded sample of labelled rows (``PER_LANG`` documents of
each language, at most ``MAX_CHARS`` long, of the ``MAX_LANGS`` commonest languages, at most
``MAX_DOCS`` and ``MAX_CELLS`` words times languages in all); it labels every word of every text, each text as one chain.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _M1, map_arrow, mix, text_or_empty

PER_LANG = 200
MAX_LANGS, MAX_DOCS = 200, 4000
MAX_CHARS = 20_000
#: Words of the sample times languages, at most: the fit holds some arrays of this size.
MAX_CELLS = 1 << 25
#: Rows of the weight table.
TABLE = 1 << 18
LONGEST_GRAM = 4
#: Words of a chain in training, and of a piece of a chain in prediction.
CHAIN = 64
STEPS, RATE, DECAY = 30, 0.15, 1e-4
#: Words of the lexicon stand so often in the sample.
LEXICON_TIMES = 3
#: Words whose emissions a worker keeps; then it starts anew.
CACHE_WORDS = 400_000

NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def letters(word: str) -> str:
    return NOT_LETTERS.sub("", word.lower())


def features(cores: list[str], lexicon: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table for words of at least one letter, and how many each word has."""
    flat = np.frombuffer("".join(f"^{w}$" for w in cores).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in cores])
    word = np.repeat(np.arange(len(cores)), sizes)
    rows, owners = [], []
    h = np.zeros(len(flat), dtype=np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        h = mix(h[: len(flat) - n + 1] * _M1 ^ flat[n - 1 :])
        inside = word[: len(h)] == word[n - 1 :]
        rows.append(h[inside])
        owners.append(word[: len(h)][inside])
    known = [k for k, w in enumerate(cores) if w in lexicon]
    if known:
        import xxhash

        rows.append(np.array([xxhash.xxh3_64_intdigest(cores[k].encode()) for k in known], dtype=np.uint64))
        owners.append(np.array(known))
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (rows[order] % np.uint64(TABLE)).astype(np.int32), np.bincount(owners, minlength=len(cores))


def emissions(weights: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each word's weights, for each language."""
    return np.add.reduceat(weights[rows], np.cumsum(counts) - counts, axis=0) if len(counts) else np.zeros((0, weights.shape[1]), weights.dtype)


def potentials(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(scores - scores.max(axis=-1, keepdims=True)), np.exp(transitions - transitions.max())


def marginals(scores: np.ndarray, inside: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains.

    scores: (chains, words, languages); inside: (chains, words), true for a prefix of each
    chain. Returns each word's probabilities and the expected number of transitions (with
    ``count``). ``before`` and ``after`` are the messages that reach a chain's first word from
    the words before it and the last place from the words after it.
    """
    chains, length, n = scores.shape
    e, a = potentials(scores, transitions)
    forward, backward = np.empty_like(e), np.ones_like(e)
    if after is not None:
        backward[:, -1] = after
    first = e[:, 0] if before is None else e[:, 0] * before
    forward[:, 0] = first / first.sum(axis=1, keepdims=True)
    for t in range(1, length):
        f = (forward[:, t - 1] @ a) * e[:, t]
        forward[:, t] = f / f.sum(axis=1, keepdims=True)
    pairs = np.zeros((n, n))
    for t in range(length - 2, -1, -1):
        b = e[:, t + 1] * backward[:, t + 1]
        m = b @ a.T
        backward[:, t] = np.where(inside[:, t + 1, None], m / m.sum(axis=1, keepdims=True), 1.0)
        if count:
            joint = forward[:, t, :, None] * a * b[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[inside[:, t + 1]].sum(axis=0)
    p = forward * backward
    return p / p.sum(axis=2, keepdims=True), pairs


def messages(scores: np.ndarray, inside: np.ndarray, transitions: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(before, after)`` of each chain, where a text of ``pieces`` chains is one long chain that was cut.

    The messages are linear, so what a chain does to any message is one small matrix.
    The matrices of all chains are built together, word by word, and then applied along
    each text.
    """
    e, a = potentials(scores, transitions)
    chains, length, n = e.shape
    ends = np.cumsum(pieces)
    place = np.arange(chains) - np.repeat(ends - pieces, pieces)
    through = np.broadcast_to(np.eye(n, dtype=e.dtype), (chains, n, n)) * e[:, 0, None, :]
    for t in range(1, length):
        step = (through.reshape(-1, n) @ a.astype(e.dtype)).reshape(chains, n, n) * e[:, t, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        through = np.where(inside[:, t, None, None], step, through)
    before, after = np.ones((chains, n), dtype=e.dtype), np.ones((chains, n), dtype=e.dtype)
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(1, place.max(initial=0) + 1))
    for own in np.split(order, cuts)[1:]:
        m = np.einsum("cj,cjk->ck", before[own - 1], through[own - 1]) @ a
        before[own] = m / m.sum(axis=1, keepdims=True)
    left = np.repeat(ends, pieces) - 1 - np.arange(chains)
    order = np.argsort(left, kind="stable")
    cuts = np.searchsorted(left[order], np.arange(1, left.max(initial=0) + 1))
    for own in np.split(order, cuts)[1:]:
        m = np.einsum("cjk,ck->cj", through[own + 1], after[own + 1]) @ a.T
        after[own] = m / m.sum(axis=1, keepdims=True)
    return before, after


@dataclass
class Field:
    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: set[str]


def fit(texts: list[str], labels: list[str], seed: int = 3, max_cells: int = MAX_CELLS) -> Field | None:
    """Fit the field on labelled texts by full-batch adaptive gradient steps; None without words.

    Of more than ``max_cells`` words times languages, pieces drawn at random are used as far as they fit.
    """
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    pieces, count = [], Counter()
    for text, label in sorted(zip(texts, labels)):
        words = [w for w in map(letters, text.split()) if w]
        count.update(words)
        at = 0
        while at < len(words):
            size = int(rng.integers(4, 41))
            pieces.append((words[at : at + size], langs.index(label)))
            at += size
    if not pieces:
        return None
    lexicon = {w for w, n in count.items() if n >= LEXICON_TIMES}
    pieces = [pieces[k] for k in rng.permutation(len(pieces))]
    # with many languages, fewer words: the arrays of the fit are words by languages
    pieces = pieces[: int(np.searchsorted(np.cumsum([len(ws) for ws, _ in pieces]), max_cells // len(langs), "right"))] or pieces[:1]
    used = {w for ws, _ in pieces for w in ws}
    vocabulary = {w: k for k, w in enumerate(w for w in count if w in used)}
    rows, counts = features(list(vocabulary), lexicon)
    owner = np.repeat(np.arange(len(counts)), counts)
    word = np.array([vocabulary[w] for ws, _ in pieces for w in ws])
    gold = np.array([y for ws, y in pieces for _ in ws])
    pad = -len(word) % CHAIN
    inside = np.append(np.ones(len(word), bool), np.zeros(pad, bool)).reshape(-1, CHAIN)
    word, gold = np.append(word, np.zeros(pad, int)), np.append(gold, np.zeros(pad, int))
    n, total = len(langs), inside.sum()
    hot = np.zeros((len(word), n), dtype=np.float32)
    hot[np.arange(len(word)), gold] = 1
    hot = hot.reshape(*inside.shape, n)
    both = inside[:, 1:]
    seen = np.zeros((n, n))
    np.add.at(seen, (gold.reshape(inside.shape)[:, :-1][both], gold.reshape(inside.shape)[:, 1:][both]), 1)

    weights, transitions = np.zeros((TABLE, n), dtype=np.float32), np.zeros((n, n))
    past_w, past_t = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    for _ in range(STEPS):
        scores = emissions(weights, rows, counts)[word].reshape(*inside.shape, n)
        p, pairs = marginals(scores, inside, transitions)
        gap = ((p - hot) * inside[:, :, None]).reshape(-1, n)
        by_word = np.stack([np.bincount(word, weights=gap[:, k], minlength=len(counts)) for k in range(n)], axis=1)
        slope = np.stack([np.bincount(rows, weights=by_word[owner, k], minlength=TABLE) for k in range(n)], axis=1) / total + DECAY / total * weights
        slope_t = (pairs - seen) / total + DECAY * transitions
        past_w += slope**2
        past_t += slope_t**2
        weights -= (RATE * slope / np.sqrt(past_w)).astype(np.float32)
        transitions -= RATE * slope_t / np.sqrt(past_t)
    return Field(langs, weights, transitions, lexicon)


class Labeller:
    """Labels texts with a field; keeps the emissions of words it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        # row 0 is for words without letters
        self.row_of: dict[str, int] = {}
        self.rows = np.zeros((1, len(self.field.langs)), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.row_of]
        cores = [letters(w) for w in new]
        spelled = list(dict.fromkeys(c for c in cores if LETTER.search(c)))
        found = emissions(self.field.weights, *features(spelled, self.field.lexicon)) if spelled else self.rows[:0]
        at = {c: len(self.rows) + k for k, c in enumerate(spelled)}
        self.row_of.update((w, at.get(c, 0)) for w, c in zip(new, cores))
        self.rows = np.concatenate((self.rows, found))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Emission rows of all words that have letters, and how many each text has."""
        if len(self.row_of) > CACHE_WORDS:
            self.forget()
        split = pc.utf8_split_whitespace(texts)
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn(distinct)
        row = np.array([self.row_of[w] for w in distinct], dtype=np.int64)[coded.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)[row > 0]
        return row[row > 0], np.bincount(text, minlength=len(sizes))

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word in order the languages' probabilities, and how many words each text has."""
        row, counts = self.words(texts)
        if not len(row):
            return np.zeros((0, len(self.field.langs))), counts
        # a text's words lie in chains of CHAIN, with the messages from the rest of the text
        chains = -(-counts // CHAIN)
        text = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(row)) - (np.cumsum(counts) - counts)[text]
        chain = (np.cumsum(chains) - chains)[text] + within // CHAIN
        padded = np.zeros((chains.sum(), CHAIN), dtype=np.int64)
        padded[chain, within % CHAIN] = row
        scores, inside, a = self.rows[padded], padded > 0, self.field.transitions
        p, _ = marginals(scores, inside, a, *messages(scores, inside, a, chains[chains > 0]), count=False)
        return p[chain, within % CHAIN], counts

    def label(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        p, counts = self.probabilities(texts)
        sums = np.zeros((len(counts), p.shape[1]))
        some = counts > 0
        if some.any():
            sums[some] = np.add.reduceat(p, (np.cumsum(counts) - counts)[some], axis=0)
        best = sums.argmax(axis=1)
        score = sums[np.arange(len(counts)), best] / np.maximum(counts, 1)
        return [self.field.langs[k] if ok else "und" for k, ok in zip(best, some)], np.clip(score, 0, 1).tolist()


def training_sample(labelled: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS) -> tuple[list[str], list[str]]:
    """About ``per_lang`` texts of each language of ``(id, text, lang)``, chosen by a hash of the id."""
    labelled = labelled.where(F.length("text").between(1, max_chars))
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    per_lang = min(per_lang, MAX_DOCS // max(1, len(sizes)))
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r.lang, min(1.0, per_lang / r["count"])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) / float(1 << 20)
    rows = labelled.where(draw < share).select("text", "lang").collect() if sizes else []
    return [r.text for r in rows], [r.lang for r in rows]


_held: dict[str, Labeller] = {}


def identify(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", extra: list | None = None) -> DataFrame:
    """``(id, *extra, lang_pred, score)`` for each row of ``docs``.

    A text that is null or has no letter, and every text if nothing was learned, is
    ``und`` with score 0. Repeated rows are labelled alike; null ids stay null; other
    columns are ignored, whatever their names. There is no shuffle.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(field)  # of a fixed size: the weight table and the sample's lexicon
    key = uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), *(extra or []))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")

    def columns(b: pa.RecordBatch) -> list:
        if held.value is None:
            langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
        else:
            labeller = _held.get(key)
            if labeller is None:
                _held.clear()
                labeller = _held[key] = Labeller(held.value)
            langs, scores = labeller.label(b.column(1))
        return [b.column(0), *b.columns[2:], langs, scores]

    return map_arrow(rows, columns, f"{kinds}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and label all rows.

    The fold is where crc32 of the id as text is divisible by 5; a null id is in no fold
    and not learned from. See ``identify`` for the other cases.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    known = docs.where(F.col(lang_col).isNotNull() & (fold != 0)).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.col(lang_col).alias("lang"))
    field = fit(*training_sample(known, per_lang))
    return identify(docs, field, id_col, text_col, [F.coalesce(fold == 0, F.lit(False)).alias("held_out")])
