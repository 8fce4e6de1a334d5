"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings: of the word, of its first 4, 5 and 6 characters
and of its last 4. Filters one, two and three words wide run over the whole text, each
keeps its greatest value, and a logistic layer weighs them. The first coordinate starts as
the log-odds of the hashed piece between the classes; all weights are then trained by
Adagrad on the mean log loss. A threshold per language, guessed from a text's function
words, is calibrated on all labelled rows that training has not seen, and scores are
shifted so that it becomes 0.5. Only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unievents.llm.common import WORD_BYTES, pick, rows_of, utf8

BITS, DIM, WIDTHS, FILTERS = 17, 8, (1, 2, 3), 8
_PARTS = 5
# Bins of logits that rows are counted by; what is beyond the reach is in the end bins.
_STEP, _REACH = 1 / 64, 256
_BINS = int(2 * _REACH / _STEP)

# Frequent function words by language.
LANGUAGES = {
    "en": "the of and to in is that it was for on with as he be at by this had not are but from or have an they which",
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie",
    "fr": "le les et des est une du en que qui dans pour pas au sur ne se ce il plus par avec sont je son aux mais",
    "es": "el los que las del se por con una su para es al lo como más pero sus le ya o este sí porque esta entre y",
}
_NAMES = [*LANGUAGES, "other"]
_FUNCTION_WORDS = {w.encode(): 1 << k for k, words in enumerate(LANGUAGES.values()) for w in sorted(set(words.split()))}
for _k, _words in enumerate(LANGUAGES.values()):
    for _w in _words.split():
        _FUNCTION_WORDS[_w.encode()] |= 1 << _k


def _pieces(word: bytes) -> tuple[int, ...]:
    """Rows of the embedding table that make up a word; row 0 is empty."""
    h, mask, n = xxhash.xxh32_intdigest, (1 << BITS) - 1, len(word)
    return (h(word) & mask | 1, *(h(word[:k], k) & mask | 1 if n > k else 0 for k in (4, 5, 6)), h(word[-4:], 9) & mask | 1 if n > 4 else 0)


class Vocabulary:
    """Numbers of words in the order they come, with their pieces and languages. ``texts``
    gives word numbers; it starts anew when it holds ``most`` words."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = []

    def ids(self, text: bytes) -> np.ndarray:
        parts, data, at = [], text.translate(WORD_BYTES), 0
        while at < len(data):  # long texts in parts, so that their words are not all objects at once
            end = data.find(b" ", at + (1 << 20))
            end = len(data) if end < 0 else end
            words, at = data[at:end].split(), end
            for word in set(words).difference(self.number):
                self.number[word] = len(self.words)
                self.words.append(word)
            parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def full(self) -> bool:
        return len(self.words) > self.most

    def tables(self, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and language marks of the words from ``start`` on."""
        new = self.words[start:]
        return (np.array([_pieces(w) for w in new], np.int32).reshape(-1, _PARTS),
                np.array([_FUNCTION_WORDS.get(w, 0) for w in new], np.uint8))


def _language(ids: np.ndarray, marks: np.ndarray) -> int:
    """Index of the language whose function words are most; 'other' without any."""
    own = marks[ids]
    counts = [int(np.count_nonzero(own & (1 << k))) for k in range(len(LANGUAGES))]
    return int(np.argmax(counts)) if max(counts) else len(LANGUAGES)


class Classifier:
    """Weights and thresholds; plain arrays, so that it is broadcast as it is."""

    def __init__(self, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.weights = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)
        for k in range(len(WIDTHS)):
            self.filters[k][:, :, 0] = 0
            self.filters[k][:, 0, 0] = 1
            self.weights[k * FILTERS] = 0.5
        self.thresholds = np.zeros(len(_NAMES))
        self.fitted = np.zeros((len(_NAMES), 2), np.int64)  # fitted rows by language and label

    def pooled(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: bool = False):
        """Greatest value of every filter over each text, and its places. ``words``: vectors
        of all texts in a row, each followed by max(WIDTHS) + 1 zero vectors."""
        tops, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            n = len(words) - w + 1
            values = words[:n] @ f[0]
            for j in range(1, w):
                values += words[j:j + n] @ f[j]
            if where:
                at = np.array([values[s:max(e, s + 1)].argmax(0) + s for s, e in zip(starts, ends)])
                places.append(at)
                tops.append(np.take_along_axis(values, at, 0) + b)
            else:  # windows that start in the zeros are cut off
                bounds = np.column_stack((starts, np.maximum(ends, starts + 1))).ravel()
                tops.append(np.maximum.reduceat(values, bounds, axis=0)[::2] + b)
        return np.concatenate(tops, axis=1), places

    def logits(self, vectors: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
        """Of texts given by word numbers; ``vectors`` has a zero vector at its end."""
        if not texts:
            return np.zeros(0)
        flat, starts, ends = _in_a_row(texts, len(vectors) - 1)
        top, _ = self.pooled(vectors[flat], starts, ends)
        return np.maximum(top, 0) @ self.weights + self.shift

    def scores(self, logits: np.ndarray, languages: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits - self.thresholds[languages], -500, 500)))


def _in_a_row(texts: list[np.ndarray], zero: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = np.full(max(WIDTHS) + 1, zero, np.int64)  # an empty text has windows of zeros
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths + len(gap)) - lengths - len(gap)
    return np.concatenate([x for t in texts for x in (t, gap)]), starts, starts + lengths


def _log_odds(table: np.ndarray, pieces: np.ndarray, texts: list[np.ndarray], labels: np.ndarray) -> None:
    """First coordinate: how much oftener a piece is in texts of label 1, shrunk where rare."""
    counts = np.zeros((2, len(table)))
    for ids, label in zip(texts, labels):
        counts[label, np.unique(pieces[np.unique(ids)])] += 1
    total = np.maximum(1, np.bincount(labels, minlength=2))
    odds = np.log((counts[1] + 0.5) / (total[1] + 1)) - np.log((counts[0] + 0.5) / (total[0] + 1))
    seen = counts.sum(axis=0)
    table[:, 0] = np.clip(odds * seen / (seen + 10), -3, 3)
    table[0] = 0


def _fit_and_rest(rows: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are fitted, and which of the sample calibrate: a fifth, or all of few."""
    order = rng.permutation(rows)
    n_fit = max(2, rows * 4 // 5) if rows >= 50 else rows
    return order[:n_fit], order[n_fit:] if n_fit < rows else order


def train(texts: list[bytes], labels: list[int], epochs: int = 6, batch: int = 32, rate: float = 0.05,
          weight_of_zero: float = 1.0, seed: int = 8) -> Classifier:
    """Fit on four fifths of the rows and calibrate thresholds on the rest. With rows of one
    label only, or none, the untrained model is returned with thresholds that say 0."""
    model, y = Classifier(seed), np.array(labels, int)
    if len(set(labels)) < 2:
        model.thresholds[:] = 20.0
        return model
    vocabulary = Vocabulary(1 << 62)
    ids = [vocabulary.ids(t) for t in texts]
    pieces, marks = vocabulary.tables()
    rng = np.random.default_rng(seed)
    fit, rest = _fit_and_rest(len(ids), rng)
    np.add.at(model.fitted, ([_language(ids[i], marks) for i in fit], y[fit]), 1)
    _log_odds(model.table, pieces, [ids[i] for i in fit], y[fit])
    pieces = np.vstack((pieces, np.zeros((1, _PARTS), np.int32)))  # the zero word
    zero = len(pieces) - 1
    slots = [np.full_like(p, 1e-4) for p in (*model.filters, *model.bias, model.weights)]
    table_slot, shift_slot = np.full(len(model.table), 1e-3, np.float32), 1e-4
    share = y[fit].mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            some = fit[at:at + batch]
            flat, starts, ends = _in_a_row([ids[i] for i in some], zero)
            used, back = np.unique(flat, return_inverse=True)
            words = model.table[pieces[used]].sum(axis=1)[back]
            top, places = model.pooled(words, starts, ends, where=True)
            active = np.maximum(top, 0)
            chance = 1 / (1 + np.exp(-np.clip(active @ model.weights + model.shift, -50, 50)))
            error = ((chance - y[some]) * cost[some] / len(some)).astype(np.float32)
            into = (error[:, None] * model.weights) * (top > 0)
            grads, touched = [], np.zeros((len(words), DIM), np.float32)
            for k, (w, f) in enumerate(zip(WIDTHS, model.filters)):
                own = into[:, k * FILTERS:(k + 1) * FILTERS]
                grad = np.zeros_like(f)
                for j in range(w):
                    grad[j] = np.einsum("bf,bfd->df", own, words[places[k] + j])
                    np.add.at(touched, places[k] + j, own[:, :, None] * f[j].T[None])
                grads.append(grad)
            grads += [into[:, k * FILTERS:(k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))] + [active.T @ error]
            for value, slot, grad in zip((*model.filters, *model.bias, model.weights), slots, grads):
                slot += grad * grad
                value -= rate * grad / np.sqrt(slot)
            shift_slot += float(error.sum()) ** 2
            model.shift -= np.float32(rate * error.sum() / np.sqrt(shift_slot))
            rows = np.flatnonzero(np.abs(touched).max(axis=1))
            which, where = np.unique(pieces[flat[rows]], return_inverse=True)
            grad = np.zeros((len(which), DIM), np.float32)
            np.add.at(grad, where.reshape(-1), np.repeat(touched[rows], _PARTS, axis=0))
            grad[which == 0] = 0
            table_slot[which] += (grad * grad).mean(axis=1)
            model.table[which] -= rate * grad / np.sqrt(table_slot[which])[:, None]
    vectors = model.table[pieces].sum(axis=1)
    own = [ids[i] for i in rest]
    logits = np.concatenate([model.logits(vectors, own[k:k + 64]) for k in range(0, len(own), 64)])
    languages = np.array([_language(t, marks) for t in own])
    model.thresholds[:] = _threshold(logits, y[rest], weight_of_zero)
    for k in range(len(_NAMES)):
        of = languages == k
        if min(np.count_nonzero(y[rest][of] == 1), np.count_nonzero(y[rest][of] == 0)) >= 10:
            model.thresholds[k] = _threshold(logits[of], y[rest][of], weight_of_zero)
    return model


def _threshold(logits: np.ndarray, y: np.ndarray, weight_of_zero: float) -> float:
    """The logit from which label 1 gives the best F1, in the middle of its gap; a row of
    label 0 counts ``weight_of_zero`` rows, as often as it is among all rows."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order] == 1)
    alarms = np.cumsum(y[order] == 0) * weight_of_zero
    f1 = 2 * hits / (hits + alarms + max(1, np.count_nonzero(y == 1)))
    best = int(f1.argmax())
    low = logits[order[best + 1]] if best + 1 < len(order) else logits[order[best]] - 2
    return float((logits[order[best]] + low) / 2)


def _bins(logits: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((logits.astype(np.float64) + _REACH) / _STEP), 0, _BINS - 1).astype(np.int32)


def _binned_threshold(counts: np.ndarray, weight_of_zero: float) -> float:
    """``_threshold`` of rows counted by (label, bin)."""
    used = np.flatnonzero(counts.any(axis=0))[::-1]
    hits = np.cumsum(counts[1, used])
    f1 = 2 * hits / (hits + np.cumsum(counts[0, used]) * weight_of_zero + max(1, counts[1].sum()))
    best = int(f1.argmax())
    low = used[best + 1] + 1 if best + 1 < len(used) else used[best] - 2 / _STEP
    return float((used[best] + low) / 2 * _STEP - _REACH)


def calibrate(model: Classifier, counts: np.ndarray) -> None:
    """Thresholds from rows counted by (language, label, bin), none of them fitted. A row of
    label 0 weighs what makes up for the fitted rows, which are more of the rarer label.
    Languages with fewer than 10 rows of either label get the threshold of all rows; without
    rows of both labels the thresholds stay."""
    seen = counts.sum(axis=2)
    if seen.sum(axis=0).min() == 0:
        return

    def best(own: np.ndarray, fitted: np.ndarray) -> float:
        zero, one = (fitted + own.sum(axis=1)) / own.sum(axis=1)
        return _binned_threshold(own, zero / one)

    model.thresholds[:] = best(counts.sum(axis=0), model.fitted.sum(axis=0))
    for k in np.flatnonzero(seen.min(axis=1) >= 10):
        model.thresholds[k] = best(counts[k], model.fitted[k])


def _known(labels: DataFrame) -> DataFrame:
    """The label of each id that may teach; 1 if one of several labels is 1."""
    return (labels.where("id is not null and label in (0, 1) and crc32(cast(id as string)) % 5 != 0")
            .groupBy("id").agg(F.max("label").cast("int").alias("label")))


def _judged(batches: Iterator[pa.RecordBatch], model: Classifier, text_at: int):
    """Batches with the logits and guessed languages of their texts."""
    vocabulary = Vocabulary()
    vectors, languages = np.zeros((1, DIM), np.float32), np.zeros(0, np.uint8)
    for batch in rows_of(batches, 1 << 20):
        if vocabulary.full():
            vocabulary.clear()
            vectors, languages = np.zeros((1, DIM), np.float32), np.zeros(0, np.uint8)
        ids = [vocabulary.ids(t) for t in utf8(batch.column(text_at))]
        pieces, new = vocabulary.tables(len(languages))
        if len(new):
            vectors = np.concatenate((vectors[:-1], model.table[pieces].sum(axis=1), vectors[-1:]))
            languages = np.concatenate((languages, new))
        yield batch, model.logits(vectors, ids), np.array([_language(t, languages) for t in ids], int)


def labelled_counts(docs: DataFrame, labels: DataFrame, fitted: list, shared) -> np.ndarray:
    """Rows by (language, label, bin of the logit) of all documents, of any length, that have
    a label, are not held out and whose id is not in ``fitted``. Only ids, languages and bins
    are shuffled; at most languages x 2 x _BINS counts reach the driver."""
    kind = docs.schema["id"].dataType
    others = _known(labels).join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fitted], f"id {kind.simpleString()}")),
                                 "id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, logits, languages in _judged(batches, shared.value, 1):
            yield pa.record_batch([batch.column(0), pa.array(languages.astype(np.int32)), pa.array(_bins(logits))],
                                  names=["id", "language", "bin"])

    judged = (docs.where("id is not null and crc32(cast(id as string)) % 5 != 0").select("id", "text")
              .mapInArrow(run, f"id {kind.simpleString()}, language int, bin int"))
    counts = np.zeros((len(_NAMES), 2, _BINS), np.int64)
    for r in judged.join(others, "id").groupBy("language", "label", "bin").count().collect():
        counts[r["language"], r["label"], r["bin"]] = r["count"]
    return counts


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int,
                    max_bytes: int = 1 << 17) -> tuple[list, list, list, float]:
    """Ids, texts and labels of at most ``per_label`` rows a label whose crc32(id as text) mod 5
    is not 0, those with the smallest hash of the id, and the weight of a row of label 0.
    Texts over ``max_bytes`` are left out (of the sample, not of calibration or scoring), which bounds
    what the driver holds. An id with several labels counts as 1 if one of them is 1."""
    known = _known(labels)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_label) for k in (0, 1)]
    rows = (docs.where(F.octet_length("text") <= max_bytes)
            .join(F.broadcast(chosen[0].union(chosen[1])), "id")  # 2 * per_label ids at most
            .groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
            .orderBy("id").collect())
    used = [min(counts.get(k, 0), per_label) or 1 for k in (0, 1)]
    weight = (counts.get(0, 0) / used[0]) / max(1e-9, counts.get(1, 0) / used[1])
    return [r["id"] for r in rows], [r["text"].encode() for r in rows], [r["label"] for r in rows], weight or 1.0


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_id_col: str = "doc_id", label_col: str = "toxic", per_label: int = 2000) -> DataFrame:
    """All columns of ``docs`` in their order, then ``held_out``, ``score`` and ``predicted``
    (read them by position where ``docs`` has such names).

    held_out: crc32 of the id as text mod 5 is 0 (false for a null id); such rows teach
    nothing. Null and empty texts have no words and get the score of a text without any.
    Repeated rows get equal scores. Without rows of both labels every row is predicted 0.
    No rows give no rows. The weights are fitted on the driver on ``2 * per_label`` rows at
    most, and are broadcast (4 MB); the thresholds come from all other labelled rows that are
    not held out, or from the fitted ones where there are no others. Texts are scored whole.
    """
    names = docs.columns
    plain = pick(docs, id=id_col, text=text_col)
    marks = pick(labels, id=label_id_col, label=label_col)
    ids, texts, y, weight = labelled_sample(plain, marks, per_label)
    model, context = train(texts, y, weight_of_zero=weight), docs.sparkSession.sparkContext
    if len(set(y)) == 2:
        fit, _ = _fit_and_rest(len(ids), np.random.default_rng(8))
        weights = context.broadcast(model)
        calibrate(model, labelled_counts(plain, marks, [ids[i] for i in fit], weights))
        weights.unpersist()
    shared = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, logits, languages in _judged(batches, shared.value, text_at):
            scores = shared.value.scores(logits, languages)
            yield pa.record_batch([*batch.columns, pa.array(scores.astype(np.float64)),
                                   pa.array((scores >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text_at = names.index(text_col)
    id_at = f"c{names.index(id_col)}"
    held = numbered.withColumn("held_out", F.coalesce(F.crc32(F.col(id_at).cast("string")) % 5 == 0, F.lit(False)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema) + ", score double, predicted int"
    return held.mapInArrow(run, schema).toDF(*names, "held_out", "score", "predicted")
