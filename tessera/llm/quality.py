"""Quality of documents: attention-based multiple-instance learning over encoded passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, utf8, written
from tessera.llm.model import Adam, AttentionMIL

#: Bytes of a passage, and bins into which its byte pairs are hashed.
PASSAGE, BINS = 512, 512
#: Distances at which a passage is held against itself: words that repeat agree at their own length.
LAGS = range(2, 17)
FEATURES = BINS + len(LAGS) + 1
#: Labelled documents in the training sample at most, of any length.
SAMPLE = 5000
#: Parts of the sample that are trained on side by side, rounds after which their weights are averaged, passes over a batch
#: in each round, and the first round's rate.
SHARDS, ROUNDS, PASSES, RATE = 4, 6, 4, 0.004
#: Passages encoded at once; a longer text goes on in the next block.
BLOCK = 2048


def _folded() -> np.ndarray:
    """Bytes as the encoder sees them: letters keep their case but not their name in half of the bins' hash."""
    kind = np.zeros(256, np.int64)
    for c in range(256):
        ch = chr(c)
        kind[c] = 1 if ch.islower() and c < 128 else 2 if ch.isupper() and c < 128 else 3 if ch.isdigit() and c < 128 else 4 if c in (9, 10, 13, 32) else 5 if c >= 128 else 6 + c % 32
    return kind


KIND = _folded()


def encode(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of texts (bytes one after another, starts with the end), and each text's first passage.
    A passage: PASSAGE bytes of one text, the last one shorter; an empty text has one empty passage. Its features are
    square roots of the shares of hashed byte pairs and of pairs of byte kinds, and the shares of bytes that recur at each of
    LAGS, with the largest of these."""
    lengths = np.diff(starts)
    n = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate(([0], np.cumsum(n)))
    text = np.repeat(np.arange(len(lengths)), lengths)
    passage = first[text] + (np.arange(len(data)) - starts[text]) // PASSAGE
    b = data.astype(np.int64)
    after = np.append(b[1:], 0)
    after[starts[1:][lengths > 0] - 1] = 0  # a text ends as if nothing followed
    half = BINS // 2
    pairs = ((b * 31 + after * 2654435761) >> 7) % half
    kinds = half + (KIND[b] * 37 + KIND[after]) % half
    count = np.bincount(passage * BINS + pairs, minlength=first[-1] * BINS) + np.bincount(passage * BINS + kinds, minlength=first[-1] * BINS)
    out = np.zeros((first[-1], FEATURES), np.float32)
    out[:, :BINS] = count.reshape(-1, BINS)
    size = np.maximum(1, out[:, :half].sum(1, keepdims=True))
    out[:, :BINS] = np.sqrt(out[:, :BINS] / size)
    for i, lag in enumerate(LAGS, BINS):
        same = np.flatnonzero((data[lag:] == data[:-lag]) & (text[lag:] == text[:-lag])) if len(data) > lag else np.zeros(0, np.int64)
        out[:, i] = np.bincount(passage[same], minlength=first[-1]) / size[:, 0]
    out[:, -1] = out[:, BINS:-1].max(1)
    return out, first[:-1]


def encoded(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, passages of it) in order, BLOCK passages at most at a time: memory does not follow the longest text."""
    i, room = 0, BLOCK * PASSAGE
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + room, "right")) - 1)
        if j == i + 1 and starts[j] - starts[i] > room:
            for a in range(starts[i], starts[j], room):  # cuts between passages; the bytes that a passage is held against follow
                b, more = min(a + room, starts[j]), min(a + room + LAGS[-1], starts[j])
                x, _ = encode(data[a:more], np.array([0, more - a]))
                yield i, x[: -(-(b - a) // PASSAGE)]
        else:
            x, first = encode(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            for k, (a, b) in enumerate(zip(first, np.append(first[1:], len(x)), strict=True)):
                yield i + k, x[a:b]
        i = j


def score_texts(column: pa.Array, model: AttentionMIL) -> np.ndarray:
    """One score a text, by all its passages. What is kept of a passage is its hidden representation."""
    hidden, size = [], np.zeros(len(column), np.int64)
    for i, x in encoded(*utf8(column)):
        hidden.append(model.hidden(x))
        size[i] += len(x)
    return model.attend(np.concatenate(hidden), np.concatenate(([0], np.cumsum(size)[:-1])))["p"]


def training_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, id_col: str, text_col: str, most: int) -> DataFrame:
    """l_id, text, y: documents of up to `most` labelled rows for which keep holds, in the order of a hash of the id, texts of
    any length. The cut is made on the labels alone."""
    rows = labels.where(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(label).alias("y"))
    rows = rows.orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    own = docs.select(F.col(id_col).cast("long").alias("l_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.join(F.broadcast(rows), "l_id").select("l_id", "text", "y")  # at most `most` ids


TRAINED = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("w", pa.binary())])


def _trainer(shared, number: int):
    """Of each part of the sample: the weights after a round over it, batch by batch, begun with the weights of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = model = opt = r = None
        n = 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n]), pa.array([model.flat().tobytes()], pa.binary())], schema=TRAINED)

        for batch in batches:
            shards = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shards[a] != shard:
                    if n:
                        yield done()
                    shard, n, model = int(shards[a]), 0, AttentionMIL(FEATURES).put(shared.value)
                    opt, r = Adam(model.w, RATE * (1 - number / ROUNDS)), np.random.default_rng([11, number, shard])
                bags: list[list[np.ndarray]] = [[] for _ in range(b - a)]
                for i, x in encoded(*utf8(batch.column(2).slice(a, b - a))):
                    bags[i].append(x.astype(np.float16))
                model.steps(bags, np.asarray(batch.column(1))[a:b].astype(np.float32), opt, r, PASSES)
                n += b - a
        if n:
            yield done()

    return run


def train(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> AttentionMIL | None:
    """Fits the model on a bounded sample of the rows that are not held out. Texts stay where they are: the sample's parts are
    trained on side by side, and after each round the driver receives their weights and averages them. None if the sample
    lacks labels of either kind."""
    spark = prepare(docs.sparkSession)
    shard = F.pmod(F.xxhash64("l_id", F.lit(3)), F.lit(SHARDS)).cast("int")
    rows = training_sample(docs, labels, "quality", ~held_out, id_col, text_col, most).select(shard.alias("shard"), F.col("y").cast("int").alias("y"), "text", "l_id")
    sample = written(rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", F.xxhash64("l_id"), "l_id", F.xxhash64("text")).drop("l_id"), "quality-sample")
    kinds = sample.agg(F.min("y"), F.max("y")).first()
    if kinds[0] is None or kinds[0] == kinds[1]:
        return None
    model = AttentionMIL(FEATURES)
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model.flat())
        parts = sorted(sample.mapInArrow(_trainer(shared, number), "shard int, n long, w binary").collect(), key=lambda p: (p["shard"], p["n"], bytes(p["w"])))  # a few sets of weights
        model.put(np.average([np.frombuffer(p["w"], np.float32) for p in parts], axis=0, weights=[p["n"] for p in parts]))
    return model


def scorer(spark, model: AttentionMIL | None):
    """A column function of a text column; without a model every score is 0.5."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for s in texts:
            yield pd.Series(score_texts(pa.array(s, type=pa.string(), from_pandas=True), own) if own is not None and len(s) else np.full(len(s), 0.5))

    return score


def held_out_rows(id_col: str, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == which, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 3, which: int = 1, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted. One row a row of docs; whole texts are scored. Null or empty text: one empty
    passage, scored like any other. Null doc_id: not held out, and no label is its own. Of repeated labels the larger
    counts. No labels, or of one kind only: every score is 0.5. Labels, lang, source and doc_id are no inputs of a score.
    Other columns are not read."""
    prepare(docs.sparkSession)
    model = train(docs, labels, held_out_rows("doc_id", parts, which), id_col, text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", held_out_rows("doc_id", parts, which).alias("held_out"), scorer(docs.sparkSession, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
