"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of character kinds, word statistics and
repetition, for itself and for the lines before and after it. The field is fitted on labelled documents, whose lines
all take the document's label; a document's score is the mean of its lines' forward-backward marginals of being
good, weighted by length. Features come from the text alone.

Null texts count as empty; an empty text is one empty line and gets that line's marginal. A line of more than
LINE_CHARS characters is cut into several. Repeated rows are scored alike, rows without an id are scored too.
Labelled rows with a null label or id are not used; of several labels of one id the smallest counts, of several texts the
smallest. Without any labelled row every score is 0.5. Extra columns are not read. An empty table gives an empty result.
A very long text is scored whole, with 48 numbers a line; for the fit it gives SAMPLE_LINES lines in a row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import bounded_batches, text_groups

LINE_CHARS = 4000
GROUP_CHARS = 1_000_000
SAMPLE_ROWS = 4000
SAMPLE_LINES = 400  # of one document, at most
KINDS = ["upper", "lower", "digit", "space", "stop", "mark", "rare", "other"]
FEATURES = 8 + 7


def _kind_table() -> np.ndarray:
    table = np.full(256, KINDS.index("other"), np.int64)
    for kind, chars in (("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", "abcdefghijklmnopqrstuvwxyz"),
                        ("digit", "0123456789"), ("space", " \t\r\n\v\f"), ("stop", ".,;:'\"()-"), ("mark", "!?"),
                        ("rare", "#$%&*+/<=>@[\\]^_`{|}~")):
        table[list(chars.encode())] = KINDS.index(kind)
    return table


_KIND = _kind_table()


def lines_of(text: str) -> list[str]:
    """The lines of a text; longer ones are cut every LINE_CHARS characters."""
    lines = text.split("\n")
    if len(text) <= LINE_CHARS:
        return lines
    return [line[i:i + LINE_CHARS] for line in lines for i in range(0, max(1, len(line)), LINE_CHARS)]


def some_lines(text: str) -> list[str]:
    """The lines of a text, or SAMPLE_LINES of them in a row from a place that its hash gives."""
    lines = lines_of(text)
    start = zlib.crc32(text.encode("utf-8")) % max(1, len(lines) - SAMPLE_LINES + 1)
    return lines[start:start + SAMPLE_LINES]


def line_features(lines: Sequence[str]) -> np.ndarray:
    """A row of FEATURES numbers for each line, from the line alone."""
    raw = [line.encode("utf-8") for line in lines]
    size = np.array([len(r) for r in raw], np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    kinds = _KIND[np.frombuffer(b"".join(raw), np.uint8)]
    line = np.repeat(np.arange(len(lines)), size)
    count = np.bincount(line * len(KINDS) + kinds, minlength=len(lines) * len(KINDS)).reshape(-1, len(KINDS))
    out = np.zeros((len(lines), FEATURES), np.float32)
    out[:, :8] = count / np.maximum(size, 1)[:, None]
    for i, line_bytes in enumerate(raw):
        words = line_bytes.split()
        n = len(words)
        if n:
            again = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
            out[i, 8:12] = (len(set(words)) / n, again / n, (size[i] - n + 1) / n / 10, min(n, 100) / 100)
    out[:, 12] = np.log1p(size) / 10
    out[:, 13] = start[1:] == start[:-1]
    out[:, 14] = size == LINE_CHARS
    return out


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of each line of one document with those of the lines before and after it, and a constant."""
    edge = np.zeros((1, own.shape[1]), own.dtype)
    before, after = np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])
    ends = np.zeros((len(own), 3), own.dtype)
    ends[:, 0], ends[0, 1], ends[-1, 2] = 1, 1, 1
    return np.concatenate([own, before, after, ends], axis=1)


class LineCrf:
    """Two states, 0 bad and 1 good: emission weights per state, a transition matrix and nothing else."""

    def __init__(self, features: int):
        self.weight = np.zeros((features, 2))
        self.step = np.zeros((2, 2))
        self.mean, self.scale = np.zeros(features), np.ones(features)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(state) of every line and the summed P(state, next state), for documents laid out one after the other."""
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(-lengths, kind="stable")
        first, lengths = first[order], lengths[order]
        emit = np.exp(emission - emission.max(axis=1, keepdims=True))
        move = np.exp(self.step - self.step.max())
        alpha, beta = np.empty_like(emit), np.ones_like(emit)
        longest = int(lengths[0]) if len(lengths) else 0
        alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest)]  # documents longer than t
        for t in range(longest):
            at = first[:alive[t]] + t
            a = emit[at] if t == 0 else emit[at] * (alpha[at - 1] @ move)
            alpha[at] = a / a.sum(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            at = first[:alive[t + 1]] + t
            b = (emit[at + 1] * beta[at + 1]) @ move.T
            beta[at] = b / b.sum(axis=1, keepdims=True)
        state = alpha * beta
        state /= state.sum(axis=1, keepdims=True)
        inner = np.ones(len(emit), bool)
        inner[first + lengths - 1] = False
        at = np.flatnonzero(inner)
        pair = alpha[at][:, :, None] * move * (emit[at + 1] * beta[at + 1])[:, None, :]
        return state, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    def fit(self, documents: list[np.ndarray], labels: list[int], rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> None:
        """Maximise the likelihood of the labelled lines by Adam; documents hold the features of `with_neighbours`."""
        x = np.concatenate(documents).astype(np.float64)
        lengths = np.array([len(d) for d in documents])
        state = np.repeat(np.array(labels), lengths)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.mean[-3], self.scale[-3] = 0, 1
        x = (x - self.mean) / self.scale
        target = np.eye(2)[state]
        share = np.repeat(1 / lengths, lengths)[:, None]  # every document weighs the same
        steps = np.zeros((2, 2))
        np.add.at(steps, (labels, labels), (lengths - 1) / lengths)
        moment = [np.zeros_like(self.weight), np.zeros_like(self.step)]
        square = [np.zeros_like(self.weight), np.zeros_like(self.step)]
        for r in range(1, rounds + 1):
            p, pair = self.marginals(x @ self.weight, lengths)
            down = [x.T @ ((p - target) * share) / len(documents) + decay * self.weight,
                    (pair / lengths.mean() - steps) / len(documents) + decay * self.step]
            for i, value in enumerate((self.weight, self.step)):
                moment[i] = 0.9 * moment[i] + 0.1 * down[i]
                square[i] = 0.99 * square[i] + 0.01 * down[i] ** 2
                value -= rate * (moment[i] / (1 - 0.9 ** r)) / (np.sqrt(square[i] / (1 - 0.99 ** r)) + 1e-8)

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """The score of each text."""
        emission, weight, lengths = [], [], []
        for text in texts:
            lines = lines_of(text)
            own = line_features(lines)
            emission.append(self.emissions(with_neighbours(own)))
            weight.append(np.array([len(line) + 1 for line in lines], np.float64))
            lengths.append(len(lines))
        if not lengths:
            return np.zeros(0)
        good = self.marginals(np.concatenate(emission), np.array(lengths))[0][:, 1]
        weight, first = np.concatenate(weight), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LineCrf:
    """A field fitted on at most `sample_rows` labelled ids, the first by a hash, none of them held out. Each id gives one
    text, and each text at most SAMPLE_LINES lines in a row, so the sample is bounded whatever the table."""
    bounded_batches(docs.sparkSession)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # the documented bound
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(some_lines(t.as_py())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())],
                                             ["doc_id", "label", "x"])

    rows = sorted(texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id BIGINT, label INT, x BINARY").collect())
    crf = LineCrf(3 * FEATURES + 3)
    if rows:
        crf.fit([with_neighbours(np.frombuffer(r.x, np.float32).reshape(-1, FEATURES)) for r in rows],
                [int(r.label > 0) for r in rows])
    return crf


def score_documents(docs: DataFrame, crf: LineCrf, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of `docs` with `score_col`, which replaces a column of that name."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            parts = [crf.scores(texts[a:b]) for a, b in text_groups(texts, GROUP_CHARS)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{score_col}` DOUBLE"
    return docs.select("*", F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(run, schema)
