"""Language identification of code-switched text with a linear-chain conditional random field.

Each word gets a language. Emissions sum the weights of a word's features: affixes, character n-grams and its entry in a
lexicon; transitions between the languages of neighbours are learned too. Forward-backward gives each word's marginal
distribution, and a text's language is the one with the highest mean marginal over its words with a letter.

The model is fitted on a bounded sample of labelled texts; every text is then labelled whole. Forward-backward runs over
fixed blocks of words at once: transfer matrices of blocks, a scan over a text's blocks, and the words within blocks. That is
exact for any length, and neither needs a step of Python for each word nor memory beyond a block of texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 150  # labelled texts of each language to fit on, about
SAMPLE_CHARS = 100_000  # of longer ones the sample takes SPANS spans, so many characters together
SPANS = 8
UNKNOWN = "und"
_BITS = 16
_BLOCK = 64
_CACHED_WORDS = 300_000
_BATCH_WORDS = 300_000


def core(word: str) -> str:
    """A word in lower case without what stands before its first and after its last letter; '' if it has no letter."""
    w = word.lower()
    if w.isalpha():
        return w
    a, z = 0, len(w)
    while a < z and not w[a].isalpha():
        a += 1
    while a < z and not w[z - 1].isalpha():
        z -= 1
    return w[a:z]


def _mixed(parts: Sequence[np.ndarray], salt: int) -> np.ndarray:
    """A feature number for each row of code points, 0 .. 2**_BITS - 1."""
    h = np.full(len(parts[0]), salt, np.uint64)
    for x in parts:
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def features(cores: Sequence[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of every feature of the cores; an empty core has none.

    Affixes of one to three characters, n-grams of two and three with marks at both ends, and the word itself if it is in
    the lexicon, each kind hashed apart.
    """
    lengths = np.array([len(c) for c in cores], np.int64)
    points = np.frombuffer("".join([f"^{c}$" for c in cores]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(lengths + 2)
    begins = ends - lengths - 2
    owner = np.repeat(np.arange(len(cores)), lengths + 2)
    real = lengths > 0
    owners, found = [], []
    for n in (2, 3):
        at = np.arange(max(len(points) - n + 1, 0))
        at = at[(owner[at] == owner[at + n - 1]) & real[owner[at]]]
        owners.append(owner[at])
        found.append(_mixed([points[at + i] for i in range(n)], n))
    for n in (1, 2, 3):
        some = np.flatnonzero(lengths >= n)
        for first, salt in ((begins[some] + 1, 10 + n), (ends[some] - 1 - n, 20 + n)):
            owners.append(some)
            found.append(_mixed([points[first + i] for i in range(n)], salt))
    listed = [i for i, c in enumerate(cores) if c in lexicon]
    owners.append(np.array(listed, np.int64))
    found.append(np.array([zlib.crc32(cores[i].encode("utf-8", "surrogatepass")) & ((1 << _BITS) - 1) for i in listed], np.int64))
    return np.concatenate(owners), np.concatenate(found)


def _summed(weights: np.ndarray, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """(n, languages): the weights of each owner's features added up."""
    return np.stack([np.bincount(owner, weights=w, minlength=n) for w in weights[feature].T], axis=1) if weights.shape[1] else np.zeros((n, 0))


class Crf(NamedTuple):
    languages: tuple[str, ...]
    weights: np.ndarray  # (features, languages)
    transitions: np.ndarray  # (languages, languages): from, to
    lexicon: frozenset[str]


class Blocks(NamedTuple):
    """Words of many texts in rows of ``_BLOCK``, each text from a new row; ``row``, ``col``: where each word is."""

    row: np.ndarray
    col: np.ndarray
    first: np.ndarray  # row of each text's first block
    number: np.ndarray  # blocks of each text
    filled: np.ndarray  # words of each row


def blocks(lengths: np.ndarray) -> Blocks:
    number = np.maximum(-(-lengths // _BLOCK), 1)
    first = np.concatenate(([0], np.cumsum(number)[:-1])).astype(np.int64)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(first, lengths) + within // _BLOCK
    return Blocks(row, within % _BLOCK, first, number, np.bincount(row, minlength=int(number.sum())))


def marginals(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """(words, languages) marginals of texts in a row, summed marginals of neighbours if asked, and the log partition sum.

    emissions: log weights of each word; no text may be empty.
    """
    b, k = blocks(lengths), emissions.shape[1]
    rows = len(b.filled)
    top = emissions.max(axis=1)
    e = np.ones((rows, _BLOCK, k))
    e[b.row, b.col] = np.exp(np.maximum(emissions - top[:, None], -60.0))
    peak = transitions.max()
    a = np.exp(transitions - peak)
    begins = np.zeros(rows, bool)
    begins[b.first] = True
    # Transfer matrices: weight from the language before a block to that of its last word, in log scale ``scale``.
    m = np.where(begins[:, None, None], 1.0, a[None]) * e[:, 0][:, None, :]
    for t in range(1, _BLOCK):
        on = b.filled > t
        if not on.any():
            break
        grown = (m.reshape(-1, k) @ a).reshape(-1, k, k) * e[:, t][:, None, :]
        m = np.where(on[:, None, None], grown, m)
        if t % 4 == 3:
            m /= np.maximum(m.max(axis=(1, 2), keepdims=True), 1e-300)
    into = np.full((rows, k), 1.0 / k)  # normalised forward vector before each block
    onto = np.full((rows, k), 1.0 / k)  # normalised backward vector after each block
    for i in range(1, int(b.number.max())):
        at = b.first[b.number > i] + i
        v = np.einsum("ri,rij->rj", into[at - 1], m[at - 1])
        into[at] = v / v.sum(axis=1, keepdims=True)
    for i in range(int(b.number.max()) - 1, 0, -1):
        at = b.first[b.number > i] + i
        v = np.einsum("rij,rj->ri", m[at], onto[at])
        onto[at - 1] = v / v.sum(axis=1, keepdims=True)
    forward = np.empty((rows, _BLOCK, k))
    log_z = 0.0
    v = into
    for t in range(_BLOCK):
        on = b.filled > t
        grown = v @ a if t else np.where(begins[:, None], 1.0, into @ a)
        grown = grown * e[:, t]
        total = grown.sum(axis=1)
        log_z += float(np.log(total[on]).sum())
        v = np.where(on[:, None], grown / total[:, None], v)
        forward[:, t] = v
    backward = np.empty((rows, _BLOCK, k))
    v = onto
    for t in range(_BLOCK - 1, -1, -1):
        backward[:, t] = v
        on = b.filled > t
        grown = (v * e[:, t]) @ a.T
        v = np.where(on[:, None], grown / np.maximum(grown.sum(axis=1, keepdims=True), 1e-300), v)
    p = forward[b.row, b.col] * backward[b.row, b.col]
    p /= p.sum(axis=1, keepdims=True)
    log_z += float(top.sum()) + peak * float((lengths - 1).sum())
    if not pairs:
        return p, None, log_z
    inner = np.ones(len(p), bool)
    inner[np.cumsum(lengths) - lengths] = False
    inner = np.flatnonzero(inner)
    left = forward[b.row[inner - 1], b.col[inner - 1]]
    right = e[b.row[inner], b.col[inner]] * backward[b.row[inner], b.col[inner]]
    weight = 1.0 / np.maximum(np.einsum("ri,ij,rj->r", left, a, right), 1e-300)
    return p, a * np.einsum("ri,rj->ij", left * weight[:, None], right), log_z


def fit(samples: Sequence[tuple[str, str]], rounds: int = 30, rate: float = 0.3, seed: int = 5) -> Crf:
    """Fit on (language, text) by adaptive gradient ascent on the penalised conditional likelihood of word languages.

    Spans of 20 to 80 words from texts of different languages take turns in a training sequence, so that transitions
    are learned for text that switches. All words of the samples are used.
    """
    languages = tuple(sorted({lang for lang, _ in samples}))
    k = len(languages)
    if k == 0:
        return Crf((), np.zeros((1 << _BITS, 0)), np.zeros((0, 0)), frozenset())
    rng = np.random.default_rng(seed)
    spans: list[tuple[int, list[str]]] = []
    seen: Counter[str] = Counter()
    for lang, text in samples:
        words = [c for w in text.split() if (c := core(w))]
        seen.update(set(words))
        at = 0
        while at < len(words):
            to = at + int(rng.integers(20, 81))
            spans.append((languages.index(lang), words[at:to]))
            at = to
    lexicon = frozenset(w for w, n in seen.items() if n > 1)
    order = rng.permutation(len(spans))
    words = [w for i in order for w in spans[i][1]]
    truth = np.array([spans[i][0] for i in order for _ in spans[i][1]], np.int64)
    if not words:
        return Crf(languages, np.zeros((1 << _BITS, k)), np.zeros((k, k)), lexicon)
    size = 400
    lengths = np.array([min(size, len(words) - at) for at in range(0, len(words), size)], np.int64)
    index: dict[str, int] = {}
    at = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    owner, feature = features(list(index), lexicon)
    weights, transitions = np.zeros((1 << _BITS, k)), np.zeros((k, k))
    grown_w, grown_t = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    starts = np.cumsum(lengths) - lengths
    inner = np.setdiff1d(np.arange(len(words)), starts)
    real_pairs = np.zeros((k, k))
    np.add.at(real_pairs, (truth[inner - 1], truth[inner]), 1.0)
    for _ in range(rounds):
        emission = _summed(weights, owner, feature, len(index))
        p, pair_sums, _z = marginals(emission[at], transitions, lengths, pairs=True)
        p[np.arange(len(p)), truth] -= 1.0
        by_word = np.stack([np.bincount(at, weights=-p[:, j], minlength=len(index)) for j in range(k)], axis=1)
        gradient = np.stack([np.bincount(feature, weights=by_word[owner, j], minlength=1 << _BITS) for j in range(k)], axis=1) - 0.5 * weights
        g_t = real_pairs - pair_sums - 0.5 * transitions
        grown_w += gradient**2
        grown_t += g_t**2
        weights += rate * gradient / np.sqrt(grown_w)
        transitions += rate * g_t / np.sqrt(grown_t)
    return Crf(languages, weights, transitions, lexicon)


class Labeller:
    """Texts to languages, with a bounded cache of words' emissions."""

    def __init__(self, model: Crf) -> None:
        self.model, self.index = model, {}
        self.rows = np.zeros((1024, len(model.languages)))
        self.letters = np.zeros(1024, bool)

    def _emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        new = set(words).difference(self.index)
        if len(self.index) + len(new) > _CACHED_WORDS:
            self.index, new = {}, set(words)
        if new:
            at, cores = len(self.index), [core(w) for w in new]
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
            if at + len(new) > len(self.rows):
                grown = np.zeros((2 * (at + len(new)), self.rows.shape[1]))
                grown[:at] = self.rows[:at]
                self.rows, self.letters = grown, np.concatenate((self.letters[:at], np.zeros(len(grown) - at, bool)))
            self.rows[at : at + len(new)] = _summed(self.model.weights, *features(cores, self.model.lexicon), len(new))
            self.letters[at : at + len(new)] = list(map(bool, cores))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.rows[at], self.letters[at]

    def label(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """(language, mean marginal) of each text; texts of up to _BATCH_WORDS words together go through at once."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.model.languages:
            return out
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, t in enumerate(texts):
            words = (t or "").split()
            if words:
                held.append((i, words))
                size += len(words)
            if size >= _BATCH_WORDS:
                self._flush(held, out)
                held, size = [], 0
        if held:
            self._flush(held, out)
        return out

    def _flush(self, held: list[tuple[int, list[str]]], out: list[tuple[str, float]]) -> None:
        lengths = np.array([len(w) for _, w in held], np.int64)
        emission, letters = self._emissions([w for _, words in held for w in words])
        p, _, _ = marginals(emission, self.model.transitions, lengths)
        begins = np.cumsum(lengths) - lengths
        n = np.add.reduceat(letters.astype(np.int64), begins)
        mean = np.add.reduceat(p * letters[:, None], begins, axis=0) / np.maximum(n, 1)[:, None]
        for (i, _), row, some in zip(held, mean, n, strict=True):
            if some:
                best = int(row.argmax())
                out[i] = self.model.languages[best], min(float(row[best]), 1.0)


def _is_held_out(key: str, modulus: int, remainder: int):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def _whole_words(spans: Sequence[str]) -> str:
    """Spans of a text that were cut anywhere, without the parts of words at their cuts; a text in one span as it is."""
    if len(spans) == 1:
        return spans[0]
    return " ".join(" ".join(s.split()[1:-1]) or s for s in spans)


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 3, remainder: int = 1, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """Labelled texts to fit on: for each language about ``rows`` by a hash of key and text, none held out, whatever their
    length. A text over ``chars`` characters gives SPANS spans of whole words, spread evenly from its beginning to its end, of
    so many characters together. Languages are few; their counts come first, so the sample is a filter and not a sort."""
    usable = docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(key, text).alias("_h")).where(~_is_held_out(key, modulus, remainder) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r["_lang"]: r["n"] for r in usable.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    n = F.element_at(F.create_map(*[x for lang_, n in sorted(counts.items()) for x in (F.lit(lang_), F.lit(n).cast("bigint"))]), F.col("_lang"))
    size = max(chars // SPANS, 1)
    starts = [F.floor((F.length("_text") - size) * i / (SPANS - 1)).cast("int") + 1 for i in range(SPANS)]
    spans = F.when(F.length("_text") <= chars, F.array("_text")).otherwise(F.array(*[F.substring(F.col("_text"), at, F.lit(size)) for at in starts]))
    picked = usable.where(F.pmod("_h", n) < 2 * rows).select("_lang", "_h", spans.alias("_spans")).collect()
    taken: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r["_lang"], r["_h"], r["_spans"])):
        if len(mine := taken.setdefault(r["_lang"], [])) < rows:
            mine.append((r["_lang"], _whole_words(r["_spans"])))
    return [x for lang_ in sorted(taken) for x in taken[lang_]]


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 3, remainder: int = 1) -> DataFrame:
    """One row for each row of docs: key, held_out, lang_pred, score (0 to 1).

    Fitted on rows with a language whose crc32(key as text) mod ``modulus`` is not ``remainder``; the language, the key and
    other columns play no part in a prediction. Null texts and texts without a letter: 'und', 0. Ties go to the language
    that sorts first. A null key is not held out. Without a labelled text all are 'und'; an empty table gives an empty
    result, and repeated rows each a row. Every text is labelled whole, however long: its words go through in blocks. The model (a few MB, whatever the
    corpus) goes to tasks as a broadcast variable.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, key, text, lang, modulus, remainder)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = labeller.label(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[key, "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), _is_held_out(key, modulus, remainder).alias("held_out"), F.col(text).alias("_text"))
    return rows.mapInArrow(label, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
