"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskgrid.llm.repeats import mixed, runs
from riskgrid.llm.shared import ship
from riskgrid.session import cut_lineage

#: Lengths of the n-grams in characters.
SIZES = (3, 4, 5, 6, 7)
#: Characters that are handled at once.
SLICE = 1 << 19
#: Cells of the table in which a gram's weight is looked for.
CELLS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each within blanks, and where each text ends. Control characters are blanks."""
    folded = [f" {(t or '').lower()} " for t in texts]
    points = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 32, np.uint32(32), points), np.cumsum(np.fromiter(map(len, folded), np.int64, len(folded)))


def gram_hashes(points: np.ndarray):
    """For each length of gram the hashes of all places, also of those that reach into the next text."""
    letters = mixed(points.astype(np.uint64))
    rolled = letters
    for n in range(2, max(SIZES) + 1):
        rolled = rolled[:-1] * _ODD + letters[n - 1 :]
        if n in SIZES:
            yield n, rolled ^ (rolled >> np.uint64(29)) ^ np.uint64(n)


def pieces(texts: list[str | None]):
    """Ranges of texts of about SLICE characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' grams: text, hash, times; by text, then hash."""
    points, ends = characters(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    docs, hashes = [], []
    for n, h in gram_hashes(points):
        inside = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
        docs.append(owner[inside]), hashes.append(h[inside])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool))
    return doc[new], h[new], np.diff(new, append=len(h))


class Detector:
    """The fitted classifier: hashes of the grams it knows and their weights (scale included), and the bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        self.cells = np.zeros(CELLS, bool)  # quickly tells most grams that it does not know
        self.cells[(hashes % np.uint64(CELLS)).astype(np.int64)] = True

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known grams of the texts: text, number of the gram, times; by text, then number."""
        points, ends = characters(texts)
        docs, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, h in gram_hashes(points):
            at = np.flatnonzero(self.cells[(h & np.uint64(CELLS - 1)).astype(np.int64)])
            near = h[at]
            number = np.searchsorted(self.hashes, near)
            known = number < len(self.hashes)
            known[known] = self.hashes[number[known]] == near[known]
            at, number = at[known], number[known]
            doc = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[doc]
            docs.append(doc[inside]), numbers.append(number[inside])
        key = np.concatenate(docs) * max(1, len(self.hashes)) + np.concatenate(numbers)
        key = np.sort(key)
        starts, times = runs(key)
        return key[starts] // max(1, len(self.hashes)), key[starts] % max(1, len(self.hashes)), times

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in pieces(texts):
            doc, number, times = self.places(texts[a:b])
            margin = self.bias + np.bincount(doc, np.log1p(times) * self.weights[number], minlength=b - a)
            out.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
        return np.concatenate(out)


def minimise(slope, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent; ``slope`` gives value and gradient."""
    value, gradient = slope(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = -gradient, []
        for move, change in reversed(moves):
            shares.append((move @ way) / (move @ change))
            way = way - shares[-1] * change
        way = way * ((moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(np.abs(gradient).sum(), 1e-12))
        for (move, change), share in zip(moves, reversed(shares)):
            way = way + (share - (change @ way) / (move @ change)) * move
        length, fall = 1.0, gradient @ way
        for _ in range(30):
            ahead, next_gradient = slope(x + length * way)
            if ahead <= value + 1e-4 * length * fall:
                break
            length /= 2
        else:
            return x
        move, change = length * way, next_gradient - gradient
        if move @ change > 1e-12:
            moves = [*moves[1 - memory :], (move, change)]
        x, gained, value, gradient = x + move, value - ahead, ahead, next_gradient
        if gained <= 1e-7 * abs(value):
            return x
    return x


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ratios: np.ndarray, decay: float, most_weight: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights of the grams and bias by logistic regression over log counts times ratios; rows are (number, times).

    Both classes weigh the same, but a row of the rarer one at most ``most_weight`` times one of the other.
    """
    n = len(rows)
    doc = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    number, times = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    value = np.log1p(times) * ratios[number]
    scale = 1 / np.sqrt(np.quantile(np.bincount(doc, value * value, minlength=n), 0.9) + 1e-9)
    value = value * scale
    share = labels.mean()
    weight = np.where(labels == 1, min(most_weight, max(1, (1 - share) / share)), min(most_weight, max(1, share / (1 - share))))
    weight = weight / weight.mean()

    def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        margin = np.bincount(doc, value * x[:-1][number], minlength=n) + x[-1]
        pull = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels)
        gradient = np.bincount(number, value * pull[doc], minlength=len(ratios)) / n + decay * x[:-1]
        loss = (weight * (np.logaddexp(0, margin) - labels * margin)).mean() + decay / 2 * (x[:-1] @ x[:-1])
        return loss, np.append(gradient, pull.mean())

    x = minimise(slope, np.zeros(len(ratios) + 1), steps)
    return x[:-1] * ratios * scale, float(x[-1])


def _toxic_grams(batches):
    """Grams of the toxic rows with the number of rows that have them, summed over slices."""
    for batch in batches:
        labels, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        texts = [t for t, y in zip(texts, labels) if y]
        for a, b in pieces(texts):
            _, h, _ = text_grams(texts[a:b])
            h = np.sort(h)
            starts, rows = runs(h)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(h[starts].view(np.int64)), "rows": pa.array(rows, pa.int64())})


def _known_grams(shared: Broadcast, kept: int | None):
    """Each row's known grams (``kept`` None: by their class, how many rows of it have them)."""

    def run(batches):
        known = Detector(*shared.value)
        for batch in batches:
            labels, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in pieces(texts):
                doc, number, times = known.places(texts[a:b])
                if kept is None:
                    clean = labels[a:b][doc] == 0
                    counts = np.bincount(number[clean], minlength=len(known.hashes))
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_pydict({"gram": pa.array(known.hashes[at].view(np.int64)), "rows": pa.array(counts[at], pa.int64())})
                else:
                    stops = np.searchsorted(doc, np.arange(b - a + 1))
                    cut = [(number[x:y].astype("<u4").tobytes(), times[x:y].astype("<u4").tobytes()) for x, y in zip(stops, stops[1:])]
                    yield pa.RecordBatch.from_pydict({"label": pa.array(labels[a:b], pa.int32()), "number": [c[0] for c in cut], "times": [c[1] for c in cut]})

    return run


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_rows: int = 12_000, grams: int = 4096, least: int = 5, smooth: float = 1.0, decay: float = 1e-5, most_weight: float = 9, steps: int = 100, seed: int = 5) -> Detector:
    """Fit the detector on labelled rows.

    A bounded sample of labels is used: the ``max_rows`` ids of smallest hash. Null labels and ids are left out; an id
    with several labels has their mean, 1 from 0.5 up. Spark counts the character n-grams (3 to 7 characters, lower case)
    of the sample's toxic rows; those in ``least`` rows or more are counted in its clean rows too. A gram's ratio is the
    logarithm of its share of toxic over its share of clean rows, each count plus ``smooth``. The ``grams`` of
    clearest ratio (divided by its deviation) become features, their log counts scaled by their ratios, of a logistic
    regression. What reaches the driver is bounded by ``max_rows`` times ``grams`` (in practice some tens a row). Without
    labelled texts of both classes the detector gives every row the share of toxic labels, 0 without any.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg((F.avg(label_column) >= 0.5).cast("int").alias("_label"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_column).alias("_doc"), F.col(text_column).alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    rows = cut_lineage(rows.select("_label", "_text"))
    many = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    toxic, clean = many.get(1, 0), many.get(0, 0)
    counted = rows.mapInArrow(_toxic_grams, "gram long, rows long").groupBy("gram").agg(F.sum("rows").alias("rows")).where(F.col("rows") >= least).toArrow()
    hashes, in_toxic = counted.column("gram").to_numpy().view(np.uint64), counted.column("rows").to_numpy()
    if not toxic or not clean or not len(hashes):
        share = toxic / max(1, toxic + clean)
        return Detector(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    order = np.argsort(hashes)
    hashes, in_toxic = hashes[order], in_toxic[order]
    candidates = spark.sparkContext.broadcast((hashes, np.zeros(len(hashes)), 0.0))
    counted = rows.mapInArrow(_known_grams(candidates, None), "gram long, rows long").groupBy("gram").agg(F.sum("rows").alias("rows")).toArrow()
    in_clean = np.zeros(len(hashes))
    in_clean[np.searchsorted(hashes, counted.column("gram").to_numpy().view(np.uint64))] = counted.column("rows").to_numpy()
    ratio = np.log((in_toxic + smooth) / (toxic + 2 * smooth)) - np.log((in_clean + smooth) / (clean + 2 * smooth))
    clear = np.abs(ratio) / np.sqrt(1 / (in_toxic + smooth) + 1 / (in_clean + smooth))
    best = np.sort(np.lexsort((hashes, -clear))[:grams])
    hashes, ratio = hashes[best], ratio[best]
    features = spark.sparkContext.broadcast((hashes, np.zeros(len(hashes)), 0.0))
    got = rows.mapInArrow(_known_grams(features, grams), "label int, number binary, times binary").toArrow()
    packed = sorted(zip(got.column("number").to_pylist(), got.column("times").to_pylist(), got.column("label").to_pylist()))  # rows come in any order
    weights, bias = fit([(np.frombuffer(n, "<u4").astype(np.int64), np.frombuffer(t, "<u4")) for n, t, _ in packed], np.array([y for *_, y in packed], float), ratio, decay, most_weight, steps)
    return Detector(hashes, weights, bias)


def score(docs: DataFrame, detector: Detector, id_column: str = "doc_id", text_column: str = "text", least: float = 0.7) -> DataFrame:
    """Toxicity of every row's whole text: id, score (0 to 1, higher is likelier toxic), predicted (1 from ``least`` up).

    A null text counts as empty and empty texts have the score of a text without known grams. Repeated rows and null
    ids are scored like others, other columns are ignored, and an empty table gives no rows. No row needs another.
    """
    kind = docs.schema[id_column].dataType
    schema = pa.schema([(id_column, to_arrow_type(kind)), ("score", pa.float64()), ("predicted", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast((detector.hashes, detector.weights, detector.bias))

    def run(batches):
        fitted = Detector(*shared.value)
        for batch in batches:
            p = fitted.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= least).astype(np.int32))], schema=schema)

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind.simpleString()}, score double, predicted int")


ship(__name__)
