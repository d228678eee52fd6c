"""Toxicity of documents by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities and counts of words from a fixed lexicon and from one learned from the labels (words
and word beginnings that toxic texts hold far more often), how near such words stand to the second person, and rates of
capitals, punctuation and obfuscation (symbols inside words, stretched letters, spelled-out words), whose plain form is
looked up again. Depth-limited trees on binned features are boosted under the logistic loss; pool-adjacent-violators
on scores of models that have not seen a text turns the sum of the trees into a probability. A text's features come from
itself alone.

Lexicon, trees and calibration are fitted on at most `sample_rows` labelled documents, the first by a hash, one row for each
id, none of them held out; a training text's features use a lexicon counted without its fold. Scoring covers all rows.

Null texts count as empty; an empty text has zeros in all features and the score that follows from them. Texts are read in
windows of WINDOW characters cut at white space, whose counts add up, so memory does not grow with the text. Repeated rows
are scored alike, rows without an id too. Labelled rows with a null label or id are not used; of several labels of an id
the smallest counts, of several texts of an id the smallest. Without labelled rows of both kinds every score is the share
of toxic ones (0.5 without any). Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import bounded_batches, text_groups
from sievework.session import cut_lineage

SAMPLE_ROWS = 8000
FOLDS = 4
UNITS = 20_000  # learned words and word beginnings, at most
LEAST_TEXTS = 3  # toxic texts that hold a unit, at least
PREFIXES = (4, 5, 6, 7)
WINDOW = 1 << 20
GROUP_CHARS = 1_000_000
NEAR = 6
LEVELS = (1.0, 2.0, 3.0)

# Common insults of four languages.
INSULTS = frozenset("""
idiot idiots idiotic moron morons moronic imbecile stupid stupidity dumb dumbass fool foolish loser losers scum scumbag trash garbage
pathetic worthless disgusting clown clowns jerk bastard bitch asshole whore slut pig vermin filth filthy coward liar freak retard
retarded ugly useless hate kill die dummkopf idioten trottel arschloch schwein dreckskerl abschaum versager blöd hässlich widerlich
hurensohn connard connasse salaud salope imbécile crétin abruti ordure dégoûtant minable pathétique idiota imbécil estúpido estúpida
basura asqueroso cabrón puta payaso perdedor escoria patético inútil mierda
""".split())
# Words of the second person in four languages.
SECOND_PERSON = frozenset("""
you your yours yourself yourselves u ur youre du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos
tú ti tus usted ustedes vosotros vuestra vuestro
""".split())
# What stands for a letter.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasii")

WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"(?<=[^\W\d_])[0-9@$!|*#%&]+(?=[^\W\d_])")
STRETCHED = re.compile(r"([^\W\d_])\1\1+")
LONG = re.compile(r"(.)\1\1+")
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-]){3,}[^\W\d_](?![^\W_])")
SHOUTED = re.compile(r"\b[A-ZÄÖÜÉÈÀÇÑ]{2,}\b")
SHOUTS = re.compile(r"[!?]{2,}")
FIXED, SECOND = 1e3, 1e6
MARKS = b"#$%&*@^~"
DISGUISES = {17: MIXED, 18: STRETCHED, 19: SPELLED}  # by their place among the counts
# of ASCII characters: 1 a letter, 2 a symbol of MIXED; all others may be letters
SIGN = np.zeros(129, np.uint8)
SIGN[list(b"abcdefghijklmnopqrstuvwxyz")], SIGN[list(b"0123456789@$!|*#%&")], SIGN[128] = 1, 2, 1


FEATURES = ["fixed_rate", "fixed", "rate_1", "rate_2", "rate_3", "hits_1", "hits_2", "hits_3", "most", "weight", "kinds",
            "second", "near_second", "near_share", "capitals", "capital_words", "exclaim", "question", "marks", "mark_runs",
            "mixed", "stretched", "spelled", "plain_hits", "chars", "words"]


def units_of(word: str) -> list[str]:
    """The word itself, and its beginnings."""
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) >= n]]


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """Parts of about `size` characters; each ends before white space where there is any within another `size`."""
    start, space = 0, re.compile(r"\s")
    while len(text) - start > size:
        found = space.search(text, start + size, start + 2 * size)
        end = found.start() if found else min(len(text), start + 2 * size)
        yield text[start:end]
        start = end
    yield text[start:]


class Lexicon(dict):
    """What is known of a word, as one number: the weight of the heaviest of its learned units (0 without any), FIXED more
    for an insult of the fixed lexicon and SECOND more for a word of the second person. Words are looked up once."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        found = max([0.0, *map(self.weights.get, units_of(word[:64]), [0.0] * 5)]) if self.weights else 0.0
        found += FIXED * (word in INSULTS) + SECOND * (word in SECOND_PERSON)
        if len(word) <= 64:
            self[word] = found
        return found


def spoken(text: str, start: int, end: int) -> str:
    """The letters and look-alikes around a place, up to white space, 64 characters each way at most."""
    left, right = text[max(0, start - 64):start].split(), text[end:end + 64].split()
    before = left[-1] if left and not text[start - 1].isspace() else ""
    after = right[0] if right and not text[end].isspace() else ""
    return before + text[start:end] + after


def disguises(low: str) -> list[int]:
    """Which patterns of DISGUISES can match at all, found in three passes over the characters."""
    point = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    sign = SIGN[np.minimum(point, 128)]
    letter = sign == 1
    edge = np.zeros(len(point) + 2, bool)
    edge[1:-1] = letter
    alone = letter & ~edge[:-2] & ~edge[2:]
    same = (point[1:] == point[:-1]) & letter[1:]
    can = {17: (sign[:-1] == 2) & letter[1:], 18: same[1:] & same[:-1], 19: alone[:-6] & alone[2:-4] & alone[4:-2] & alone[6:]}
    return [place for place, where in can.items() if where.any()]


def raw_counts(text: str, lexicon: Lexicon) -> tuple[np.ndarray, float, set]:
    """Sums over one window, the largest weight, and the different words that are insults or weigh more than LEVELS[1]."""
    low = text.lower()
    words = WORD.findall(low)
    code = np.fromiter(map(lexicon.__getitem__, words), float, len(words))
    second = code >= SECOND
    code = code - SECOND * second
    fixed = code >= FIXED
    weight = code - FIXED * fixed
    hit = fixed | (weight > LEVELS[1])
    out = np.zeros(21)
    out[0], out[1], out[2] = len(text), len(words), fixed.sum()
    out[3:6] = [(weight > level).sum() for level in LEVELS]
    out[6], out[7], out[9] = weight.sum(), second.sum(), hit.sum()
    if out[9] and out[7]:
        places, at = np.flatnonzero(second), np.flatnonzero(hit)
        right = np.searchsorted(places, at)
        gap = np.minimum(np.abs(places[np.minimum(right, len(places) - 1)] - at), np.abs(places[np.maximum(right - 1, 0)] - at))
        out[8] = (gap <= NEAR).sum()
    raw = text.encode("utf-8")
    capital = np.frombuffer(raw, np.uint8) - np.uint8(65) < 26
    out[10], out[11] = capital.sum(), sum(map(len, words))
    out[12] = len(SHOUTED.findall(text)) if (capital[1:] & capital[:-1]).any() else 0
    out[13], out[14], out[15] = text.count("!"), text.count("?"), len(raw) - len(raw.translate(None, MARKS))
    out[16] = len(SHOUTS.findall(text)) if out[13] + out[14] > 1 else 0
    for place in disguises(low):
        for found in DISGUISES[place].finditer(low):
            out[place] += 1
            shown = found.group() if place == 19 else spoken(low, *found.span())
            if place == 17:
                shown = shown.translate(LOOKALIKE)
            elif place == 18:
                shown = LONG.sub(r"\1", shown)
            known = lexicon["".join(WORD.findall(shown))] % SECOND
            out[20] += known >= FIXED or known > LEVELS[1]
    return out, float(weight.max(initial=0)), {words[i] for i in np.flatnonzero(hit)}


def features(text: str, lexicon: Lexicon) -> np.ndarray:
    """FEATURES of a text."""
    total, most, kinds = np.zeros(21), 0.0, set()
    for part in windows(text):
        counts, largest, words = raw_counts(part, lexicon)
        total, most, kinds = total + counts, max(most, largest), kinds | words
    chars, words, letters = max(total[0], 1), max(total[1], 1), max(total[11], 1)
    return np.array([
        total[2] / words, np.log1p(total[2]), *(total[3:6] / words), *np.log1p(total[3:6]),
        most, total[6] / words, np.log1p(len(kinds)), total[7] / words, np.log1p(total[8]), total[8] / max(total[9], 1),
        total[10] / letters, total[12] / words, total[13] / chars, total[14] / chars, total[15] / chars, total[16] / words,
        total[17] / words, total[18] / words, total[19] / words, np.log1p(total[20]),
        np.log1p(total[0]), np.log1p(total[1])], np.float32)


class BoostedTrees:
    """Trees of one depth under the logistic loss, on features cut into at most `bins` bins by quantiles."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, decay: float = 1.0, least: float = 0.5):
        self.rounds, self.depth, self.rate, self.bins, self.decay, self.least = rounds, depth, rate, bins, decay, least
        self.base = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.base)
        inner = 2 ** self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            down, curve = p - y, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, nodes = 2 ** level - 1, 2 ** level
                best = np.zeros(nodes)
                bin_of = np.full(nodes, self.bins)
                for f, row in enumerate(binned):
                    key = (node - first) * self.bins + row
                    g, h = (np.bincount(key, w, nodes * self.bins).reshape(nodes, -1).cumsum(axis=1) for w in (down, curve))
                    left, right = g[:, :-1] ** 2 / (h[:, :-1] + self.decay), (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + self.decay)
                    gain = left + right - g[:, -1:] ** 2 / (h[:, -1:] + self.decay)
                    gain[(h[:, :-1] < self.least) | (h[:, -1:] - h[:, :-1] < self.least)] = 0
                    place = gain.argmax(axis=1)
                    better = gain[np.arange(nodes), place] > best + 1e-9
                    best[better] = gain[np.arange(nodes), place][better]
                    for n in np.flatnonzero(better):
                        feature[first + n], bin_of[n], cut[first + n] = f, place[n], cuts[f][min(place[n], len(cuts[f]) - 1)]
                node = 2 * node + 1 + (binned[feature[node], np.arange(len(y))] > bin_of[node - first])
            leaf = node - inner
            g, h = (np.bincount(leaf, w, inner + 1) for w in (down, curve))
            value = -self.rate * g / (h + self.decay)
            raw += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points (raw, share), both ascending, between which shares are read off linearly."""
    levels, inverse = np.unique(raw, return_inverse=True)
    count, good = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []  # first raw, last raw, rows, labels
    for at, n, s in zip(levels, count, good, strict=True):
        blocks.append([at, at, n, s])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, end, n, s = blocks.pop()
            blocks[-1][1:] = [end, blocks[-1][2] + n, blocks[-1][3] + s]
    return (np.array([v for first, last, _, _ in blocks for v in (first, last)]),
            np.array([s / n for _, _, n, s in blocks for _ in range(2)]))


class ToxicityModel:
    def __init__(self, weights: dict[str, float], trees: BoostedTrees | None, points: tuple[np.ndarray, np.ndarray], share: float):
        self.weights, self.trees, self.points, self.share = weights, trees, points, share

    def scores(self, texts: Sequence[str], lexicon: Lexicon | None = None) -> np.ndarray:
        if self.trees is None or not len(texts):
            return np.full(len(texts), self.share)
        lexicon = lexicon or Lexicon(self.weights)
        return np.interp(self.trees.raw(np.stack([features(t, lexicon) for t in texts])), *self.points)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """(text, label, fold) of at most `sample_rows` ids; equal texts share a fold."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(~held_out())
    known = known.groupBy("doc_id").agg((F.min(label) > 0).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # the documented bound
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return cut_lineage(one.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")))


def unit_counts(sample: DataFrame, toxic: bool, among: set[str] | None) -> DataFrame:
    """(unit, fold, texts, uses) over the toxic or the clean texts of the sample; a text counts a word five times at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, uses = Counter(), Counter()
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter()
                for part in windows(text.lower()):
                    own.update(WORD.findall(part))
                units = Counter()
                for word, n in own.items():
                    for unit in units_of(word[:64]):
                        if among is None or unit in among:
                            units[unit] += min(n, 5)
                texts.update((u, fold) for u in units)
                uses.update({(u, fold): n for u, n in units.items()})
            keys = list(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in keys], pa.string()), pa.array([f for _, f in keys], pa.int32()),
                 pa.array([texts[k] for k in keys], pa.int64()), pa.array([uses[k] for k in keys], pa.int64())], ["unit", "fold", "texts", "uses"])

    chosen = sample.filter(F.col("label") == int(toxic)).select("text", "fold")
    return chosen.mapInArrow(run, "unit STRING, fold INT, texts BIGINT, uses BIGINT").groupBy("unit", "fold").agg(
        F.sum("texts").alias("texts"), F.sum("uses").alias("uses"))


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Weights of units: one lexicon without each fold, and last the one over all folds. At most UNITS units are weighed."""
    toxic = cut_lineage(unit_counts(sample, True, None))
    often = toxic.groupBy("unit").agg(F.sum("texts").alias("texts")).filter(F.col("texts") >= LEAST_TEXTS)
    often = often.orderBy(F.desc("texts"), "unit").limit(UNITS)
    found = toxic.join(F.broadcast(often.select("unit")), "unit").collect()  # at most UNITS * FOLDS rows
    units = sorted({r.unit for r in found})
    place = {u: i for i, u in enumerate(units)}
    counts = np.zeros((3, len(units), FOLDS))  # toxic texts, toxic uses, clean uses
    for r in found:
        counts[:2, place[r.unit], r.fold] = r.texts, r.uses
    for r in unit_counts(sample, False, set(units)).collect() if units else []:
        counts[2, place[r.unit], r.fold] = r.uses
    words = {(r.label, r.fold): r.words for r in sample.groupBy("label", "fold").agg(
        F.sum(F.least(F.length("text"), F.lit(30_000))).alias("words")).collect()}
    size = np.array([[words.get((label, fold), 0) for fold in range(FOLDS)] for label in (1, 0)], float)
    out = []
    for left in [*range(FOLDS), None]:
        kept = [f for f in range(FOLDS) if f != left]
        texts, uses, clean = counts[:, :, kept].sum(axis=2)
        n_toxic, n_clean = size[:, kept].sum(axis=1) + 1
        # one clean use more than seen keeps rare units low
        weight = np.log((uses + 0.1) / n_toxic) - np.log((clean + 1) / n_clean)
        out.append({u: float(w) for u, w, t in zip(units, weight, texts, strict=True) if w >= LEVELS[0] / 2 and t >= LEAST_TEXTS - 1})
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model fitted on at most `sample_rows` labelled ids that are not held out."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, sample_rows)
    counted = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counted) < 2:
        return ToxicityModel({}, None, (np.zeros(0), np.zeros(0)), float(next(iter(counted))) if counted else 0.5)
    lexicons = learn_lexicons(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Lexicon(w) for w in lexicons]
        for batch in batches:
            x = [features(t, own[f]).tobytes() for t, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x, pa.binary())], ["label", "fold", "x"])

    rows = sorted(sample.select("text", "label", "fold").mapInArrow(run, "label INT, fold INT, x BINARY").collect())
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(float)
    y, fold = np.array([r.label for r in rows], float), np.array([r.fold for r in rows])
    unseen = np.zeros(len(y))
    for f in np.unique(fold):
        rest = fold != f
        unseen[~rest] = BoostedTrees().fit(x[rest], y[rest]).raw(x[~rest]) if rest.any() else 0
    return ToxicityModel(lexicons[-1], BoostedTrees().fit(x, y), isotonic(unseen, y), float(y.mean()))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of `docs` with `score_col`, which replaces a column of that name."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(score_col) if score_col != text_col else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.weights)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            parts = [model.scores(texts[a:b], lexicon) for a, b in text_groups(texts, GROUP_CHARS)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{score_col}` DOUBLE"
    return docs.select("*", F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(run, schema)
