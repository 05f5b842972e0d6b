"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence has a logistic score over its hashed words; a document is toxic if
any sentence is (noisy-or: one minus the product of the sentences' chances not
to be). Training follows the gradient through the noisy-or, so the weights
learn which sentences made the documents toxic, and scoring can point at them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.arrays import IS_SPACE, Block, blocks, columns, mix
from turnloom.llm.tables import any_columns

BITS = 20
BALANCE = 1.5  # most that a toxic document weighs in training
PREFIXES: tuple[int, ...] = (5, 7)  # bytes: beginnings of words are features beside the words
SUFFIXES: tuple[int, ...] = ()
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
_WORD = ~IS_SPACE & np.array([i >= 128 or chr(i).isalnum() or i == 0x27 for i in range(256)])


@dataclass
class Model:
    weights: np.ndarray  # by word bucket
    bias: float


def instances(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sentence of each feature, its bucket, document of each sentence, first byte of each sentence).

    A word gives itself, its beginnings and its ends; features are in the order of the text.

    Sentences end at . ! ? and line feeds, and with the text; only those with a word count.
    """
    texts, starts, ends = block.spans(_WORD[block.data])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    stops = np.cumsum(_STOP[block.data])
    key = texts * (int(stops[-1]) + 2) + stops[starts]
    _, first, sentence = np.unique(key, return_index=True, return_inverse=True)
    parts = [(np.arange(len(starts)), block.hashes(starts, ends, lower=True))]
    length = ends - starts
    for n in PREFIXES:
        long = np.flatnonzero(length > n)
        parts.append((long, block.hashes(starts[long], starts[long] + n, lower=True) + np.uint64(1)))
    for n in SUFFIXES:
        long = np.flatnonzero(length > n)
        parts.append((long, block.hashes(ends[long] - n, ends[long], lower=True) + np.uint64(2)))
    word = np.concatenate([x for x, _ in parts])
    bucket = (mix(np.concatenate([h for _, h in parts])) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(word, kind="stable")
    return sentence[word[order]], bucket[order], texts[first], starts[first]


def _sentence_scores(sentence: np.ndarray, bucket: np.ndarray, n: int, model: Model) -> np.ndarray:
    z = model.bias + np.bincount(sentence, model.weights[bucket], minlength=n)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _noisy_or(chance: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(document, np.log1p(-np.minimum(chance, 1 - 1e-12)), minlength=n))


def train(sentence: np.ndarray, bucket: np.ndarray, document: np.ndarray, toxic: np.ndarray, bits: int = BITS, rounds: int = 60, ridge: float = 0.5, least: int = 5) -> Model:
    """Weights by Adam on the likelihood of the document labels; features of fewer than `least` documents are not used."""
    size, n = 1 << bits, len(document)
    pairs = np.unique(document[sentence] * size + bucket) if len(bucket) else np.zeros(0, np.int64)
    common = np.bincount(pairs % size, minlength=size) >= least
    use = common[bucket]
    sentence, bucket = sentence[use], bucket[use]
    kinds, local = np.unique(bucket, return_inverse=True)
    w, bias = np.zeros(len(kinds) + 1), -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = bias
    share = max(float(toxic.mean()) if len(toxic) else 0.0, 1e-6)
    weight = np.where(toxic > 0, min(0.5 / share, BALANCE), 0.5 / max(1 - share, 1e-6))[document] if n else np.zeros(0)
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(sentence, w[local], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        whole = np.clip(_noisy_or(p, document, len(toxic)), 1e-9, 1 - 1e-9)[document]
        dz = weight * np.where(toxic[document] > 0, -p * (1 - whole) / whole, p)
        g = np.append(np.bincount(local, dz[sentence], minlength=len(kinds)), dz.sum()) + ridge * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(size)
    weights[kinds] = w[:-1]
    return Model(weights, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, bits: int = BITS) -> Model:
    """A model from at most `sample` labelled documents, those of smallest hash of their id.

    docs(doc_id, text), labels(doc_id, toxic): null labels and ids are not used; a
    document labelled both ways counts as toxic. Without labels nothing is toxic.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sentence, bucket, document, _ = instances(block, bits)
            cut = np.searchsorted(document[sentence], np.arange(block.n + 1))
            words = [bucket[a:b].astype(np.int32) for a, b in zip(cut, cut[1:])]
            own = [(sentence[a:b] - (sentence[a] if a < b else 0)).astype(np.int32) for a, b in zip(cut, cut[1:])]
            yield columns(block, ["doc_id", "__toxic"], words=pa.array([x.tobytes() for x in words]), sentences=pa.array([x.tobytes() for x in own]))

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = [p for p in parts if len(p)]
        got = pd.concat(pieces).sort_values("doc_id", kind="stable") if pieces else pd.DataFrame(columns=["doc_id", "__toxic", "words", "sentences"])
        bucket, sentence, document, base = [], [], [], 0
        for i, (words, own) in enumerate(zip(got["words"], got["sentences"])):
            own = np.frombuffer(own, np.int32).astype(np.int64)
            bucket.append(np.frombuffer(words, np.int32).astype(np.int64))
            sentence.append(own + base)
            n = int(own[-1]) + 1 if len(own) else 0
            document.append(np.full(n, i))
            base += n
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        model = train(join(sentence), join(bucket), join(document), got["__toxic"].to_numpy(float), bits)
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    got = rows.mapInArrow(features, "doc_id bigint, __toxic int, words binary, sentences binary").repartition(1)
    first = got.mapInPandas(learn, "weights binary, bias double").first()
    if first is None:
        return Model(np.zeros(1 << bits), -6.0)
    return Model(np.frombuffer(first["weights"], np.float64), first["bias"])


@any_columns("text")
def score(docs: DataFrame, model: Model, keep: list[str], spans: bool = False) -> DataFrame:
    """The named columns with `__score`, `__predicted`, and with `spans` the offending sentences.

    An empty or null text has no sentence and the smallest score, 0. `__spans` holds
    (first byte, chance) of every sentence with a chance of one half or more.
    """
    chosen = docs.select(*keep, *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))
    fields = [f for f in chosen.schema.fields if f.name in keep]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["__score double", "__predicted int"]
    kinds += ["__spans array<struct<start: bigint, chance: double>>"] if spans else []
    bits = int(np.log2(len(model.weights)))
    model = Model(model.weights.astype(np.float32), model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sentence, bucket, document, start = instances(block, bits)
            chance = _sentence_scores(sentence, bucket, len(document), model)
            whole = np.clip(_noisy_or(chance, document, block.n), 0, 1)
            more = {}
            if spans:
                found: list[list[dict]] = [[] for _ in range(block.n)]
                for i in np.flatnonzero(chance >= 0.5):
                    found[document[i]].append({"start": int(start[i] - block.offs[document[i]]), "chance": float(chance[i])})
                more["__spans"] = pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("chance", pa.float64())])))
            yield columns(block, keep, __score=whole, __predicted=(whole >= 0.5).astype(np.int32), **more)

    return chosen.mapInArrow(run, ", ".join(kinds))
