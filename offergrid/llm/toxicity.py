"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import batched, mix, slices, squeeze, text_buffer, unsqueeze, word_hashes, written

BITS = 20
_SALTS = [np.uint64(x) for x in (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xA0761D6478BD642F)]
_PREFIX = 4


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, feature, count): every text's hashed unigrams, bigrams, one-word skip-grams and word beginnings.

    Words are compared in lower case without the characters ``.,;:!?"'()|*%&$#`` at their ends.
    """
    bare = _TRIM[data]
    words, woffs = word_hashes(bare, offs, lower=True)
    n, doc = len(words), np.repeat(np.arange(len(offs) - 1), np.diff(woffs))
    head = _beginnings(bare, offs, len(words))
    kinds = [(mix(words ^ _SALTS[0]), doc), (mix(head ^ _SALTS[3]), doc)]
    for gap, salt in ((1, _SALTS[1]), (2, _SALTS[2])):
        if n > gap:
            same = doc[gap:] == doc[:-gap]
            kinds.append((mix((words[:-gap] * np.uint64(3) + words[gap:]) ^ salt)[same], doc[gap:][same]))
    feature = np.concatenate([k for k, _ in kinds]) >> np.uint64(64 - BITS) if n else np.zeros(0, np.uint64)
    owner = np.concatenate([d for _, d in kinds]) if n else np.zeros(0, np.int64)
    key, count = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | feature, return_counts=True)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), count


#: Punctuation stands as a space: a word's hash doesn't depend on what follows it.
_TRIM = np.arange(256, dtype=np.uint8)
_TRIM[[ord(c) for c in ".,;:!?\"'()|*%&$#"]] = 0x20


def _beginnings(data: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """Hash of the first _PREFIX bytes of each word, the same words that word_hashes finds."""
    if not n:
        return np.zeros(0, np.uint64)
    sep = np.zeros(256, bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    ns = ~sep[data]
    start = ns.copy()
    start[1:] &= ~ns[:-1]
    firsts = offs[:-1][offs[:-1] < offs[1:]]
    start[firsts] = ns[firsts]
    at = np.flatnonzero(start)
    ends = np.append(data, np.zeros(_PREFIX, np.uint8))
    out, going = np.zeros(n, np.uint64), np.ones(n, bool)
    closed = np.append(~ns | start, np.ones(_PREFIX, bool))
    for k in range(_PREFIX):
        going &= ~closed[at + k] if k else True
        byte = ends[at + k]
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        out = out * np.uint64(257) + np.where(going, byte.astype(np.uint64) + np.uint64(1), np.uint64(0))
    return mix(out)


def train_ftrl(docs: Iterator[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 1.0, l2: float = 0.01, toxic_weight: float = 2.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) after FTRL-proximal steps; L1 leaves most weights at zero.

    ``docs`` yields each row's distinct features and its label.
    """
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = np.array([1 << BITS])
    for own, label in docs:
        i = np.concatenate([own, bias])
        zi, ni = z[i], n[i]
        w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * (toxic_weight if label else 1.0)
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
        z[i] = zi + g - sigma * w
        n[i] = ni + g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    kept = np.flatnonzero(w[:-1])
    return kept, w[kept], float(w[-1])


def _sampled_features(batches):
    for batch in batched(batches):
        data, offs = text_buffer(batch.column(2))
        doc, feature, _ = features(data, offs)
        cut = np.searchsorted(doc, np.arange(len(offs)))
        packed = [squeeze(feature[a:b].astype("<u4")) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["key", "label", "features"])


def _fit(epochs: int, l1_scale: float):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("key").to_pylist(), table.column("label").to_pylist(), table.column("features").to_pylist(), strict=True))

        def feed():
            for _ in range(epochs):
                for _, label, raw in rows:
                    yield np.frombuffer(unsqueeze(raw), "<u4").astype(np.int64), label

        # The noise in a feature's summed gradients grows with the root of the toxic rows, and L1 with it.
        toxic = sum(label for _, label, _ in rows)
        kept, weights, bias = train_ftrl(feed(), l1=l1_scale * max(toxic, 1) ** 0.5)
        return pa.table({"features": pa.array([kept.tolist()], pa.list_(pa.int64())), "weights": pa.array([weights.tolist()], pa.list_(pa.float64())), "bias": pa.array([bias])})

    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 10_000, epochs: int = 4, l1_scale: float = 0.45) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on at most ``most_rows`` labelled rows (those of the smallest hash of id and text, about that many).

    The bound keeps training in one task: features of the sample are hashed in parallel and dealt to it as packed
    numbers. At most 2**20 weights, in practice a few thousand, come to the driver. Rows without a label are left out;
    without any labelled row all weights are zero.
    """
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("id", "text").bitwiseAND((1 << 62) - 1))
    total = rows.count()
    if not total:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    if total > most_rows:
        keyed = keyed.where(F.col("key") < int((1 << 62) * (most_rows / total)))
    packed = keyed.select("key", "label", "text").mapInArrow(_sampled_features, "key long, label int, features binary")
    model = packed.groupBy(F.lit(0).alias("all")).applyInArrow(_fit(epochs, l1_scale), "features array<long>, weights array<double>, bias double").first()
    if model is None:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.array(model["features"], np.int64), np.array(model["weights"]), model["bias"]


def _score(shared):
    def run(batches):
        kept, weights, bias = shared.value
        w = np.zeros(1 << BITS)
        w[kept] = weights
        for batch in batched(batches):
            data, offs = text_buffer(batch.column(batch.schema.get_field_index("text")))
            scores = np.empty(len(batch))
            for a, b in slices(offs):
                doc, feature, _ = features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                scores[a:b] = np.bincount(doc, w[feature], minlength=b - a)
            p = 1 / (1 + np.exp(-np.clip(scores + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row, renamed c0, c1, ..., with its text and score (0 to 1). Null texts count as empty."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    cols = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep or [])]
    given = docs.select(*cols, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInArrow(_score(shared), f"{schema}, score double")


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, most_rows: int = 10_000) -> DataFrame:
    """Score every row of ``docs`` with a model of those ``labels`` (doc_id, toxic) that are not held out.

    The model learns from the ``most_rows`` labelled ids of smallest hash that ``docs`` holds, or all if fewer.
    Only the text is an input of the score. An id labelled more than once counts as toxic if any of its labels says so. Returns ``keep`` (default: the id) with score. Null and
    empty texts get the score of no words; null ids are scored and never learned from; repeated rows score alike;
    an empty table gives no rows; clashing names of other columns don't matter.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out("doc_id"))
    there = own.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    # Only ids travel; the sample's size is bounded, so its texts are picked out where they lie.
    sample = written(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows), "sample")
    pairs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    model = fit(written(pairs, "labelled"), most_rows=most_rows)
    names = keep or [id_col]
    scored = score(docs, model, text_col, names)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "score")
