"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

The ordinary dictionary is trained on ordinary texts. The toxic one holds the same content and, before it, a dictionary
trained on what tells toxic texts apart: words whose beginnings stand after many different words in toxic texts and
rarely in ordinary ones (contexts are counted, so copies of one text count once). Short windows are compared with a
second pair: frequent ordinary words, with and without the telling words before them. A window that compresses shorter
with a toxic dictionary has toxic content; the gains of a text's windows are calibrated to a score by logistic
regression on labelled texts that trained no dictionary.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfunnel.llm._text import lean

WINDOWS = (12, 6)  # words in a long and in a short window
FEATURES = 2 + 7 * len(WINDOWS)
PREFIX = 6  # bytes of a word's beginning, its leading space included
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_BYTES = 2400, 3600, 20_000  # the most rows that a fit reads, and bytes in each
CONTEXTS, TELLING, RATIO = 5, 25.0, 5.0

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Letters and digits, A-Z lower-cased, cut at all other ASCII characters."""
    return (text or "").encode().translate(_PLAIN).split()


def _head(word: bytes) -> bytes:
    return (b" " + word + b" ")[:PREFIX]


def _contexts(texts: Iterable[list[bytes]]) -> Counter:
    """For each word beginning, the number of different words before it."""
    pairs = {(before, _head(word)) for words in texts for before, word in zip([b"", *words], words, strict=False)}
    return Counter(head for _, head in pairs)


def _telling(toxic: Counter, ordinary: Counter) -> list[bytes]:
    """Beginnings that are typical of toxic texts, by Dunning's log-likelihood ratio."""
    all_toxic, all_ordinary = max(1, toxic.total()), max(1, ordinary.total())
    out = []
    for head, k in toxic.items():
        m = ordinary[head]
        if k < CONTEXTS or k / all_toxic < RATIO * m / all_ordinary:
            continue
        share = (k + m) / (all_toxic + all_ordinary)
        ratio = 2 * (k * math.log(k / (all_toxic * share)) + (m * math.log(m / (all_ordinary * share)) if m else 0))
        if ratio >= TELLING:
            out.append((-k, head))
    return [head for _, head in sorted(out)]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary's content; the joined samples where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        9, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0,
        min_match=6, strategy=zstandard.STRATEGY_GREEDY)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=settings)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=settings)


class Model:
    """A pair of dictionaries for each length of window, and the weights of the calibration; sent to every task."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], weights: list[float]):
        self.pairs, self.weights = pairs, weights
        self._compressors = None

    def __getstate__(self) -> tuple:
        return self.pairs, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def gains(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """For each length of window, the bytes that the toxic dictionary saves on each window of the text."""
        if self._compressors is None:
            self._compressors = [[_compressor(content).compress for content in pair] for pair in self.pairs]
        for size, (plain, toxic) in zip(WINDOWS, self._compressors, strict=True):
            windows = [b" %b " % b" ".join(words[i:i + size]) for i in range(0, len(words), size)]
            yield np.array([len(plain(w)) - len(toxic(w)) for w in windows] or [0], np.float64)

    def features(self, words: list[bytes]) -> list[float]:
        out = [1.0, math.log(1 + len(words))]
        for gains in self.gains(words):
            gains = np.sort(gains)[::-1]
            out += [gains[0], gains[:3].sum(), gains.mean(), (gains >= 3).sum() / math.sqrt(len(gains)), (gains >= 2).mean(),
                    (gains >= 1).mean(), min(gains[:2].min(), 6.0)]
        return out

    def score(self, text: str | None) -> float:
        x = float(np.dot(self.features(tokens(text)), self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, penalty: float = 0.1) -> list[float]:
    """Newton's method with a ridge; a step is halved until the loss falls, so nearly separable rows don't run away."""
    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ w * (1 - 2 * y)).sum() + penalty / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step, scale, before = np.linalg.solve(h, x.T @ (y - p) - penalty * w), 1.0, loss(w)
        while scale > 1e-6 and loss(w + scale * step) >= before:
            scale /= 2
        if scale <= 1e-6:
            break
        w = w + scale * step
    return w.tolist()


def sample(docs: DataFrame, labels: DataFrame, rows: dict[int, int], id_column: str, text_column: str) -> tuple[DataFrame, dict[int, int]]:
    """At most ``rows[label]`` texts (``t``, ``y``, ``h``) of each label, by a hash of the id, and the labels' totals.

    Ids are chosen before any text is read; a share of about the size wanted is taken first, so that the order is made
    over a bounded number of ids. The chosen ids, bounded by ``rows``, are broadcast.
    """
    known = (labels.filter(F.col("label").isin(*rows)).select("_id", F.col("label").cast("int").alias("y"), F.xxhash64(F.lit(3), "_id").alias("h"))
             .join(docs.select(F.col(id_column).alias("_id")), "_id", "left_semi").distinct())
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for label, most in rows.items():
        share = math.ceil((1 << 20) * min(1.0, 1.3 * (most + 100) / max(1, totals.get(label, 0))))
        chosen.append(known.filter((F.col("y") == label) & (F.pmod("h", F.lit(1 << 20)) < share)).orderBy("h", "_id").limit(most))
    text = F.col(text_column)
    found = (docs.filter(text.isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES)).select(F.col(id_column).alias("_id"), text.alias("t"))
             .join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id").groupBy("_id", "y", "h").agg(F.min("t").alias("t")))
    return found, totals


def fit(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", toxic_rows: int = TOXIC_SAMPLE,
        ordinary_rows: int = ORDINARY_SAMPLE) -> Model:
    """Train on a bounded sample of the texts that ``labels`` (``_id``, ``label``: 1 toxic, 0 ordinary) names.

    Texts over ``SAMPLE_BYTES`` are not sampled; other labels and null texts are left out; of texts with one id the
    smallest counts. Every third sampled text is kept for the calibration. Without texts of both labels every score is
    that of no evidence, 0.
    """
    found, totals = sample(docs, labels, {1: toxic_rows, 0: ordinary_rows}, id_column, text_column)
    texts: dict[int, list[list[bytes]]] = {1: [], 0: []}
    for row in sorted(found.collect(), key=lambda r: (r.h, r.t)):
        texts[row.y].append(tokens(row.t))
    sets = {label: [t for i, t in enumerate(own) if i % 3] for label, own in texts.items()}
    held = [(t, label) for label, own in texts.items() for i, t in enumerate(own) if not i % 3]
    if not sets[1] or not sets[0]:
        return Model([(b"", b"")] * len(WINDOWS), [-30.0] + [0.0] * (FEATURES - 1))
    telling = set(_telling(_contexts(sets[1]), _contexts(sets[0])))
    forms: dict[bytes, Counter] = defaultdict(Counter)
    for words in sets[1]:
        for word in set(words):
            if _head(word) in telling:
                forms[_head(word)][word] += 1
    # each telling beginning gives as many samples, so that frequent ones do not fill the dictionary
    samples = []
    for head in sorted(forms):
        words = [w for w, _ in sorted(forms[head].items(), key=lambda x: (-x[1], x[0]))[:12]]
        samples += [b" %b " % b" ".join(words[(i + j) % len(words)] for j in range(3)) for i in range(12)]
    typical = b" %b " % b" ".join(sorted({w for c in forms.values() for w, _ in c.most_common(3)}))[:4096]
    frequent = [w for w, _ in Counter(w for words in sets[0] for w in words).most_common(3)]
    filler = (b" %b " % b" ".join(frequent)) * 4
    ordinary = _dictionary(4096, [b" %b " % b" ".join(w) for w in sets[0] if w])
    toxic = _dictionary(2048, samples) + typical if samples else b""
    model = Model([(ordinary, toxic + ordinary), (filler, typical + filler)], [])
    y = np.array([y for _, y in held], np.float64)
    model.weights = _logistic(np.array([model.features(t) for t, _ in held]), y)
    # the sample holds more toxic texts than the labelled rows do
    model.weights[0] += math.log(totals[1] / totals[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return model


def scored(docs: DataFrame, model: Model, text_column: str = "text", *, score: str = "score") -> DataFrame:
    """``docs`` with the column ``score`` (0 to 1, higher: likelier toxic); null texts score as empty ones."""
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                scores = pa.array([model.score(t.as_py()) for t in batch.column(at)], pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score])

    return docs.mapInArrow(lean(run), schema)


def held_out(id_column: str = "doc_id") -> F.Column:
    """True for ids that a fit never sees: crc32 of the id's text is divisible by 5; a null id is never seen."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the rows of ``labels`` (doc_id, toxic) whose ids are not held out."""
    return fit(docs, labels.filter(~held_out()).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("label")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For each row of ``docs``: doc_id, held_out, score and predicted (1 from ``threshold``, else 0).

    Repeated rows are scored each; columns other than doc_id and text are not read.
    """
    return (scored(docs.select("doc_id", "text"), fitted(docs, labels))
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their columns."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return scored(docs, fitted(docs, labels), score=name).filter(F.col(name) < threshold).select(docs.columns)
