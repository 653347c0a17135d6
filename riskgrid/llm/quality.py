"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskgrid.llm.packing import forget, sliced
from riskgrid.llm.shared import ship

#: Word buckets, statistics and the bins of each, metadata buckets, factors.
BUCKETS, BINS, META, FACTORS = 1 << 14, 16, 1 << 10, 8
#: Upper ends of the bins of a share of 0 to 1.
EDGES = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.55, 0.75, 0.95])
#: Statistics: log words, mean word length, letters, upper case, digits, signs, capitals, ends of sentences, bars,
#: distinct words, repeated lines, lines per word, words with signs inside or behind, longest word.
STATS = 14
WIDTH = BUCKETS + STATS * BINS + META
GATHERED = 120_000
ENDS, BARE = (".", "!", "?"), re.compile(r"[^\w]+")


def _token(token: bytes) -> tuple[int, list[float]]:
    """Word bucket and counts of one word: characters, letters, upper, digits, signs, capitals, end, bar, signed, length."""
    text = token.decode("utf-8", "replace")
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    signs = len(text) - letters - digits
    bare = BARE.sub("", text.lower())
    signed = signs - (text[-1] in ".,")
    return zlib.crc32(bare.encode()) % BUCKETS, [len(text), letters, upper, digits, signs, letters > 1 and upper == letters, text[-1] in ENDS, "|" in text, signed > 0, 0]


class Features:
    """Sparse rows of texts: (row, feature, value), sorted by row; each row has all its statistics."""

    def __init__(self):
        self.rows: dict[bytes, int] = {}
        self.bucket, self.counts = np.zeros(1 << 12, np.int64), np.zeros((1 << 12, 10))

    def of(self, texts: list[bytes], meta: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        split = [t.split() for t in texts]
        if len(self.rows) > GATHERED:
            self.rows = {}
        for token in set().union(*split) - self.rows.keys():
            at = self.rows[token] = len(self.rows)
            if at >= len(self.bucket):
                self.bucket = np.concatenate([self.bucket, np.zeros_like(self.bucket)])
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.bucket[at], self.counts[at] = _token(token)
        n, lengths = len(split), np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        doc = np.repeat(np.arange(n), lengths)
        sums, longest = np.zeros((n, 10)), np.zeros(n)
        full = lengths > 0
        if len(at):
            starts = (np.cumsum(lengths) - lengths)[full]
            sums[full] = np.add.reduceat(self.counts[at], starts)
            longest[full] = np.maximum.reduceat(self.counts[at, 0], starts)
        key, tf = np.unique(doc * BUCKETS + self.bucket[at], return_counts=True)
        word_doc, value = key // BUCKETS, np.sqrt(tf)
        value = value / np.sqrt(np.maximum(lengths, 1))[word_doc]
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
        many = np.array([len(x) for x in lines], float)
        twice = np.array([len(x) - len(set(x)) for x in lines], float)
        words, chars = np.maximum(lengths, 1), np.maximum(sums[:, 0], 1)
        shares = np.stack([sums[:, 1] / chars, sums[:, 2] / np.maximum(sums[:, 1], 1), sums[:, 3] / chars, sums[:, 4] / chars, sums[:, 5] / words, sums[:, 6] / words, sums[:, 7] / words, np.bincount(word_doc, minlength=n) / words, twice / np.maximum(many, 1), many / words, sums[:, 8] / words], 1)
        logs = np.stack([np.log2(lengths + 1), 2 * sums[:, 0] / words, 2 * np.log2(longest + 1)], 1)
        bins = np.concatenate([np.searchsorted(EDGES, shares), np.minimum(logs, BINS - 1).astype(int)], 1)
        stat = BUCKETS + np.arange(STATS) * BINS + bins
        parts = [(word_doc, key % BUCKETS, value), (np.repeat(np.arange(n), STATS), stat.ravel(), np.full(n * STATS, STATS**-0.5))]
        if meta:
            hashed = [[BUCKETS + STATS * BINS + zlib.crc32(f"{k}={v}".encode()) % META for k, v in enumerate(m)] for m in meta]
            parts.append((np.repeat(np.arange(n), len(meta[0])), np.array(hashed).ravel(), np.full(n * len(meta[0]), len(meta[0]) ** -0.5)))
        doc, feature, value = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(doc, kind="stable")
        return doc[order], feature[order], value[order].astype(np.float32)


class Machine:
    """w0 + sum of w x + sum over pairs of <v, v'> x x', by (sum v x)^2 - sum (v x)^2."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(WIDTH, np.float32)
        self.v = rng.normal(0, 0.05, (WIDTH, FACTORS)).astype(np.float32)

    def margins(self, starts: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margin of each row, with the rows' factor sums and the entries' factors."""
        factors = self.v[feature] * value[:, None]
        total = np.add.reduceat(factors, starts)
        pairs = 0.5 * (total * total - np.add.reduceat(factors * factors, starts)).sum(1)
        return self.w0 + np.add.reduceat(self.w[feature] * value, starts) + pairs, total, factors

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int, rate: float, decay: float, batch: int, seed: int) -> None:
        """AdaGrad on the log loss over shuffled batches of rows (feature, value)."""
        rng = np.random.default_rng(seed)
        share = min(max(labels.mean(), 0.01), 0.99)
        self.w0 = float(np.log(share / (1 - share)))
        seen_w, seen_v, seen_0 = np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, FACTORS), 1e-6, np.float32), 1e-6
        for _ in range(-(-steps * batch // len(rows))):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                lengths = np.array([len(rows[i][0]) for i in some])
                starts = np.cumsum(lengths) - lengths
                feature, value = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
                margin, total, factors = self.margins(starts, feature, value)
                slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) / len(some)).astype(np.float32)
                each = np.repeat(slope, lengths) * value
                used, at = np.unique(feature, return_inverse=True)
                order_at = np.argsort(at, kind="stable")
                first = np.searchsorted(at[order_at], np.arange(len(used)))
                grad_w = np.add.reduceat(each[order_at], first) + decay * self.w[used]
                pull = each[:, None] * (np.repeat(total, lengths, axis=0) - factors)
                grad_v = np.add.reduceat(pull[order_at], first) + decay * self.v[used]
                seen_w[used] += grad_w * grad_w
                seen_v[used] += grad_v * grad_v
                self.w[used] -= rate * grad_w / np.sqrt(seen_w[used])
                self.v[used] -= rate * grad_v / np.sqrt(seen_v[used])
                step = float(slope.sum())
                seen_0 += step * step
                self.w0 -= rate * step / seen_0**0.5


def _featurise(batches):
    forget()
    make = Features()
    for batch in batches:
        labels = batch.column(0).to_pylist()
        meta = [list(m) for m in zip(*[c.to_pylist() for c in batch.columns[2:]])]
        for a, b, texts in sliced(batch.column(1)):
            doc, feature, value = make.of(texts, meta[a:b])
            stops = np.searchsorted(doc, np.arange(b - a + 1))
            cut = [(feature[x:y].astype("<u4").tobytes(), value[x:y].astype("<f4").tobytes()) for x, y in zip(stops, stops[1:])]
            yield pa.RecordBatch.from_pydict({"label": pa.array(labels[a:b], pa.int32()), "feature": [c[0] for c in cut], "value": [c[1] for c in cut]})


def _columns(id_column: str, text_column: str, metadata: tuple[str, ...]):
    return [F.col(id_column), F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("_text"), *[F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"_m{i}") for i, m in enumerate(metadata)]]


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", metadata: tuple[str, ...] = (), max_rows: int = 12_000, steps: int = 800, rate: float = 0.05, decay: float = 1e-6, seed: int = 3) -> Machine:
    """Fit the machine on labelled rows.

    A bounded sample of labels is used: the ``max_rows`` ids of smallest hash. Null labels and ids are left out; an id
    with several labels has their mean, 1 from 0.5 up. Without any labelled text the machine scores every row 0.5.
    """
    machine = Machine(seed)
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg((F.avg(label_column) >= 0.5).cast("int").alias("_label"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_rows)
    rows = docs.select(*_columns(id_column, text_column, metadata)).withColumnRenamed(id_column, "_doc").join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    rows = rows.select("_label", "_text", *[f"_m{i}" for i in range(len(metadata))])
    got = rows.mapInArrow(_featurise, "label int, feature binary, value binary").toArrow()
    features, values = got.column("feature").to_pylist(), got.column("value").to_pylist()
    order = sorted(range(len(features)), key=lambda i: (features[i], values[i]))  # rows come in any order
    if order:
        y = got.column("label").to_numpy()[order].astype(np.float32)
        machine.fit([(np.frombuffer(features[i], "<u4").astype(np.int64), np.frombuffer(values[i], "<f4")) for i in order], y, steps, rate, decay, 64, seed)
    else:
        machine.v[:] = 0
    return machine


def _scores(shared):
    """Scores of texts and the columns of their metadata: each range of ``sliced``, with its scores."""
    forget()
    make, fitted = Features(), shared.value

    def of(column: pa.Array, metadata: list[pa.Array]):
        meta = [list(m) for m in zip(*[c.to_pylist() for c in metadata])]
        for a, b, texts in sliced(column):
            doc, feature, value = make.of(texts, meta[a:b])
            margin, _, _ = fitted.margins(np.searchsorted(doc, np.arange(b - a)), feature, value)
            yield a, b, 1 / (1 + np.exp(-np.clip(margin.astype(float), -30, 30)))

    return of


def score(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """Quality of every row: id, score (0 to 1, higher is better), predicted (1 from 0.5 up).

    A null text counts as empty; empty texts are scored by their statistics; whole texts count. Repeated rows and null
    ids are scored like others, null metadata is a value of its own, and an empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType
    schema = pa.schema([(id_column, to_arrow_type(kind)), ("score", pa.float64()), ("predicted", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        of = _scores(shared)
        for batch in batches:
            for a, b, p in of(batch.column(1), batch.columns[2:]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    return docs.select(*_columns(id_column, text_column, metadata)).mapInArrow(run, f"`{id_column}` {kind.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns unchanged; see ``score``.

    A text goes to Python once, as a column of its row, and kept rows come back a slice at a time: batches of rows are large.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names, text, n = docs.columns, docs.columns.index(text_column), len(metadata)

    def run(batches):
        of = _scores(shared)
        for batch in batches:
            rest = pa.RecordBatch.from_arrays(batch.columns[n:], names=names)
            texts = rest.column(text).cast(pa.binary())
            texts = texts.fill_null(b"") if texts.null_count else texts
            for a, b, p in of(texts, batch.columns[:n]):
                yield rest.slice(a, b - a).filter(pa.array(p >= 0.5))

    # by number, as the columns may have any names
    given = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    return docs.select(*_columns(id_column, text_column, metadata)[2:], *given).mapInArrow(run, docs.schema)

ship(__name__)
