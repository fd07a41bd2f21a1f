"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of two hashed rows, its own and that of its first letters, so that an unknown form of a
known word is not quite unknown.  Filters of widths 1, 2 and 3 slide over the whole text, each keeps its largest
response, and a logistic layer reads those.  Embeddings start at zero and only rows the training touched are stored,
so a word never seen in training answers with nothing, however long the text.  Training reads every labelled row that is
not held out: rows are dealt to shards by id, each epoch every shard steps from the common model in a task of its own, and
Spark averages what they changed (an embedding over the shards that touched it).  The driver holds the model, which
``Settings.bits`` bounds, and no row.  Scoring runs in Arrow batches over all rows.

Scores are calibrated on a part of the rows kept from the gradient steps, so that 0.5 is the balanced cut; a
threshold per language is chosen there too, both from counts of logits by hundredths over all rows kept aside.  The language selects a threshold only and is no input of the score.
"""

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from alertloom.llm.rows import arrow_map, as_bytes, fields, sliced

_SPACES = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass(frozen=True)
class Settings:
    shard: int = 8_000           # labelled rows a shard holds, about
    shard_bytes: int = 1 << 28   # of text, at most about
    kept_aside: float = 0.15     # share of the rows for calibration and thresholds
    bits: int = 22               # words are hashed to 2**bits embedding rows
    width: int = 8               # of an embedding
    filters: int = 8             # of each size
    sizes: tuple[int, ...] = (1, 2, 3)
    epochs: int = 3
    batch: int = 64
    rate: float = 0.02
    decay: float = 1e-3
    seed: int = 7
    least_positive: int = 20     # of a language, for a threshold of its own
    default_threshold: float = 0.5


STEM = 4


def word_hashes(text: bytes | None, bits: int) -> np.ndarray:
    """Two hashes per word, of the word and of its first bytes (0 if it has no more); words are runs of letters, A-Z lower-cased."""
    words, mask, hashed = text.translate(_SPACES).split() if text else [], (1 << bits) - 1, xxhash.xxh64_intdigest
    out = np.empty((len(words), 2), np.uint32)
    out[:, 0] = np.fromiter((hashed(w) & mask or 1 for w in words), np.uint32, len(words))
    out[:, 1] = np.fromiter((hashed(w[:STEM], 1) & mask or 1 if len(w) > STEM else 0 for w in words), np.uint32, len(words))
    return out


@dataclass
class Model:
    """``table[index[hash]]`` has a word's share in each filter and place; row 0 is all zero."""

    settings: Settings
    hashes: np.ndarray
    rows: np.ndarray             # embeddings, row i + 1 for hashes[i]
    conv: np.ndarray             # (width, sum(sizes) * filters)
    conv_bias: np.ndarray        # (len(sizes) * filters,)
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def __post_init__(self):
        self._index = None

    def _ready(self):
        if self._index is None:
            self._index = np.zeros(1 << self.settings.bits, np.int32)
            self._index[self.hashes] = np.arange(1, len(self.hashes) + 1, dtype=np.int32)
            self._index[0] = 0
            self._table = (self.rows @ self.conv).astype(np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"} | {"_index": None}

    def pooled(self, texts: list[np.ndarray], step: int = 50_000) -> np.ndarray:
        """The largest response of every filter over each text, of texts of any length."""
        self._ready()
        s, gap = self.settings, max(self.settings.sizes) - 1
        best = np.full((len(texts), len(s.sizes) * s.filters), -np.inf, np.float32)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for at in range(0, max(len(t), 1), step):
                pieces.append(t[at:at + step + gap])
                owner.append(i)
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= step):
                size += len(pieces[end]) + gap
                end += 1
            lengths = np.array([max(len(p), 1) + gap for p in pieces[at:end]])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            # Responses that begin in a text; those that begin in the gap behind it would reach into the next.
            spans = np.column_stack([starts[:-1], starts[1:] - gap]).ravel()
            line = np.zeros((starts[-1] + gap, 2), np.int32)
            for p, x in zip(pieces[at:end], starts):
                line[x:x + len(p)] = self._index[p]
            parts = self._table[line[:, 0]] + self._table[line[:, 1]]
            column, n = 0, starts[-1]
            for k, width in enumerate(s.sizes):
                total = parts[:n, column:column + s.filters].copy()
                for j in range(1, width):
                    total += parts[j:n + j, column + j * s.filters:column + (j + 1) * s.filters]
                column += width * s.filters
                most = np.maximum.reduceat(total, spans, axis=0)[::2]
                here = slice(k * s.filters, (k + 1) * s.filters)
                np.maximum.at(best[:, here], owner[at:end], most)
            at = end
        return np.maximum(best + self.conv_bias, 0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return (self.pooled(texts) @ self.out + self.out_bias).astype(float)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        z = np.clip(self.logits(texts) * self.scale + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))


def _adam(state: dict, name: str, grad: np.ndarray, rate: float, t: int) -> np.ndarray:
    m, v = state.setdefault(name, (np.zeros_like(grad), np.zeros_like(grad)))
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    return rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)


def _vocabulary(texts: list[np.ndarray]) -> np.ndarray:
    vocabulary = np.zeros(1, np.uint32)
    for at in range(0, len(texts), 256):
        vocabulary = np.union1d(vocabulary, np.concatenate([t.ravel() for t in texts[at:at + 256]]))
    return vocabulary[1:]  # without 0, which stands for nothing


def _untrained(s: Settings, vocabulary: np.ndarray, rng: np.random.Generator) -> Model:
    n_out = len(s.sizes) * s.filters
    conv = rng.normal(0, 0.5, (s.width, sum(s.sizes) * s.filters)).astype(np.float32)
    return Model(s, vocabulary, np.zeros((len(vocabulary) + 1, s.width), np.float32), conv,
                 np.full(n_out, 0.1, np.float32), rng.normal(0, 0.3, n_out).astype(np.float32), 0.0)


def _without_untouched(model: Model) -> Model:
    used = np.flatnonzero(np.abs(model.rows[1:]).sum(axis=1) > 0)
    model.hashes, model.rows = model.hashes[used], np.concatenate([model.rows[:1], model.rows[1:][used]])
    model._index = None
    return model


def _steps(model: Model, squares: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, learn: np.ndarray,
           weight: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    """Gradient steps over the rows ``learn``; changes the model and the embeddings' sums of squared gradients."""
    def ids(i: int) -> np.ndarray:  # made when needed: the texts are in memory once
        return np.where(texts[i] > 0, np.searchsorted(model.hashes, texts[i]) + 1, 0)

    s, gap, state, t = model.settings, max(model.settings.sizes) - 1, {}, 0
    for _ in range(epochs):
        for at in range(0, len(learn), s.batch):
            some = learn[at:at + s.batch]
            t += 1
            lengths = np.array([max(len(texts[i]), 1) + gap for i in some])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            n = starts[-1]
            line = np.zeros((n + gap, 2), np.int32)
            for i, x in zip(some, starts):
                line[x:x + len(texts[i])] = ids(i)
            embedded = model.rows[line[:, 0]] + model.rows[line[:, 1]]
            parts = model.conv.T @ np.ascontiguousarray(embedded.T)  # by filter, so that places lie side by side
            pooled, places, column = [], [], 0
            for width in s.sizes:
                total = parts[column:column + s.filters, :n].copy()
                for j in range(1, width):
                    total += parts[column + j * s.filters:column + (j + 1) * s.filters, j:n + j]
                column += width * s.filters
                place = np.stack([total[:, a:b].argmax(axis=1) + a for a, b in zip(starts[:-1], starts[1:] - gap)])
                places.append(place)
                pooled.append(total[np.arange(s.filters)[None, :], place])
            raw = np.concatenate(pooled, axis=1) + model.conv_bias
            hidden = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
            error = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            back = error[:, None] * model.out[None, :] * (raw > 0)
            grad_conv, column = np.zeros_like(model.conv), 0
            rows_at, rows_grad = [], []
            for k, width in enumerate(s.sizes):
                g, place = back[:, k * s.filters:(k + 1) * s.filters], places[k]
                for j in range(width):
                    c = slice(column + j * s.filters, column + (j + 1) * s.filters)
                    grad_conv[:, c] = np.einsum("bfd,bf->df", embedded[place + j], g)
                    grad = (g[:, :, None] * model.conv[:, c].T[None]).reshape(-1, s.width)
                    rows_at += [line[place + j, 0].ravel(), line[place + j, 1].ravel()]
                    rows_grad += [grad, grad]
                column += width * s.filters
            touched, inverse = np.unique(np.concatenate(rows_at), return_inverse=True)
            summed = np.zeros((len(touched), s.width), np.float32)
            np.add.at(summed, inverse, np.concatenate(rows_grad))
            summed[touched == 0] = 0  # the empty row stays empty
            squares[touched] += (summed ** 2).sum(axis=1)
            model.rows[touched] -= 0.2 * summed / np.sqrt(squares[touched])[:, None]
            model.conv -= _adam(state, "conv", grad_conv + s.decay * model.conv, s.rate, t)
            model.conv_bias -= _adam(state, "bias", back.sum(axis=0), s.rate, t)
            model.out -= _adam(state, "out", hidden.T @ error + s.decay * model.out, s.rate, t)
            model.out_bias -= float(_adam(state, "out_bias", np.array([error.sum()]), s.rate, t)[0])
        learn = rng.permutation(learn)


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list, s: Settings = Settings()) -> Model:
    """Fits on hashed texts.  Without both labels the model answers with the share of toxic rows (0 without rows)."""
    rng, vocabulary = np.random.default_rng(s.seed), _vocabulary(texts)
    model = _untrained(s, vocabulary, rng)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        model.out[:], model.out_bias = 0, 30.0 * np.sign(share - 0.5) if share in (0.0, 1.0) else 0.0
        return model
    order = rng.permutation(len(texts))
    aside = order[:int(len(order) * s.kept_aside)]
    learn = order[len(aside):]
    if len(set(labels[learn].tolist())) < 2 or len(set(labels[aside].tolist())) < 2:
        aside = learn = order
    positive = labels[learn].mean()
    weight = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive))
    _steps(model, np.full(len(model.rows), 1e-8, np.float32), texts, labels, learn, weight, s.epochs, rng)
    _calibrate(model, [texts[i] for i in aside], labels[aside], [langs[i] for i in aside])
    return _without_untouched(model)


def _best_cut(values: np.ndarray, positive: np.ndarray, rows: np.ndarray, wanted: float) -> float:
    """The cut with the best F1 over ascending values with their counts; of equally good ones the one nearest to ``wanted``."""
    cuts = np.concatenate([[values[0] - 1e-6], (values[1:] + values[:-1]) / 2])
    f1 = 2 * positive[::-1].cumsum()[::-1] / (rows[::-1].cumsum()[::-1] + positive.sum())
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    low, high = values[good[0] - 1] if good[0] else values[0] - 1, values[good[-1]]
    if np.all(np.diff(good) == 1) and len(good) > 1 and low < wanted <= high:
        return wanted
    return float(cuts[good[np.abs(cuts[good] - wanted).argmin()]])


GRID = 100  # logits are counted by hundredths
FARTHEST = 1000.0


def _grid(z: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(z, -FARTHEST, FARTHEST) * GRID).astype(np.int64)


def _calibrate(model: Model, texts: list, labels: np.ndarray, langs: list) -> None:
    counts: dict = {}
    for lang, at, y in zip(langs, _grid(model.logits(texts)).tolist(), labels.tolist()):
        counts[lang, at, y] = counts.get((lang, at, y), 0) + 1
    _calibrate_counted(model, [(*k, n) for k, n in counts.items()])


def _calibrate_counted(model: Model, counts: list[tuple]) -> None:
    """Shift and thresholds from ``(language, logit by GRID, label, rows)``."""
    def folded(some: list[tuple]):
        sums: dict = {}
        for _, at, y, n in some:
            seen = sums.setdefault(at, [0, 0])
            seen[0] += n * y
            seen[1] += n
        at = sorted(sums)
        return np.array(at) / GRID, np.array([sums[x][0] for x in at]), np.array([sums[x][1] for x in at])

    s = model.settings
    z, positive, rows = folded(counts)
    middle = ((z * positive).sum() / positive.sum() + (z * (rows - positive)).sum() / (rows - positive).sum()) / 2
    model.shift = -_best_cut(z, positive, rows, middle) * model.scale
    by_lang: dict = {}
    for c in counts:
        by_lang.setdefault(str(c[0]), []).append(c)
    for lang in sorted(by_lang):
        z, positive, rows = folded(by_lang[lang])
        if positive.sum() >= s.least_positive and positive.sum() < rows.sum():
            scores = 1 / (1 + np.exp(-np.clip(z * model.scale + model.shift, -30, 30)))
            model.thresholds[lang] = _best_cut(scores, positive, rows, s.default_threshold)


def _hash_columns(bits: int):
    def run(batches):
        for batch in sliced(batches, 512):
            yield *batch.columns[:-1], [word_hashes(t, bits).tobytes() for t in as_bytes(batch.column(batch.num_columns - 1))]
    return run


def held_out(id_col):
    """Rows that no model learns from: CRC-32 of the id as text, modulo 5, is 0.  False for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _kept_aside(row_id: str, share: float) -> bool:
    return zlib.crc32(f"aside:{row_id}".encode()) % 10_000 < share * 10_000


def _shard_rows(batches) -> list[tuple]:
    """``(id, label, lang, hashes)`` of a shard, by id; of rows with one id the one whose text has the least bytes."""
    rows = sorted(((str(i), int(y), lang, h) for b in batches for i, y, lang, h in zip(*(c.to_pylist() for c in b.columns))),
                  key=lambda r: (r[0], r[3], str(r[2])))
    return [r for n, r in enumerate(rows) if n == 0 or rows[n - 1][0] != r[0]]


def _parameters(model: Model) -> np.ndarray:
    return np.concatenate([model.conv.ravel(), model.conv_bias, model.out, [model.out_bias]])


def _set_parameters(model: Model, flat: np.ndarray) -> None:
    a, b = model.conv.size, model.conv.size + len(model.conv_bias)
    model.conv = flat[:a].reshape(model.conv.shape).astype(np.float32)
    model.conv_bias, model.out = flat[a:b].astype(np.float32), flat[b:b + len(model.out)].astype(np.float32)
    model.out_bias = float(flat[b + len(model.out)])


def _shard_steps(shared, positive: float, aside_too: bool, epoch: int):
    """One epoch over a shard, from the common model: rows ``(hash, v0 ... v<width>)`` of what it changed.

    The last value is an embedding's sum of squared gradients; negative hashes hold the other parameters in order.
    """
    def run(batches):
        start, squares = shared.value
        s = start.settings
        rows = [r for r in _shard_rows(batches) if aside_too or not _kept_aside(r[0], s.kept_aside)]
        if not rows:
            return
        texts, labels = [np.frombuffer(r[3], np.uint32).reshape(-1, 2) for r in rows], np.array([r[1] for r in rows], np.int64)
        vocabulary = _vocabulary(texts)
        model = Model(s, vocabulary, np.zeros((len(vocabulary) + 1, s.width), np.float32), start.conv.copy(),
                      start.conv_bias.copy(), start.out.copy(), start.out_bias)
        sums = np.full(len(model.rows), 1e-8, np.float32)
        _, here, there = np.intersect1d(vocabulary, start.hashes, assume_unique=True, return_indices=True)
        model.rows[here + 1], sums[here + 1] = start.rows[there + 1], squares[there + 1]
        before, rng = sums.copy(), np.random.default_rng([s.seed, epoch])
        weight = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive))
        _steps(model, sums, texts, labels, rng.permutation(len(texts)), weight, 1, rng)
        changed = np.flatnonzero(sums[1:] != before[1:])
        flat = _parameters(model)
        flat = np.concatenate([flat, np.zeros(-len(flat) % (s.width + 1))]).reshape(-1, s.width + 1)
        keys = np.concatenate([-1 - np.arange(len(flat)), vocabulary[changed].astype(np.int64)])
        values = np.concatenate([flat, np.column_stack([model.rows[1:][changed], sums[1:][changed]])])
        for at in range(0, len(keys), 10_000):
            yield pa.record_batch([pa.array(keys[at:at + 10_000]), *(pa.array(v) for v in values[at:at + 10_000].T.astype(float))],
                                  ["hash", *(f"v{i}" for i in range(s.width + 1))])
    return run


def _shard_logits(shared, learn_too: bool):
    def run(batches):
        model = shared.value
        rows = [r for r in _shard_rows(batches) if learn_too or _kept_aside(r[0], model.settings.kept_aside)]
        for at in range(0, len(rows), 256):
            some = rows[at:at + 256]
            z = _grid(model.logits([np.frombuffer(r[3], np.uint32).reshape(-1, 2) for r in some]))
            yield pa.record_batch([pa.array([r[2] for r in some], pa.string()), pa.array(z), pa.array([r[1] for r in some], pa.int64())],
                                  ["lang", "at", "label"])
    return run


def _shard_counts(share: float):
    def run(batches):
        rows = _shard_rows(batches)
        yield pa.record_batch([pa.array([_kept_aside(r[0], share) for r in rows], pa.bool_()),
                               pa.array([r[1] for r in rows], pa.int64())], ["aside", "label"])
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
        label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """A model of all labelled rows that are not held out.

    A row labelled twice counts as toxic if one label says so; null ids and null labels are left out.
    """
    s, spark = settings, docs.sparkSession
    marked = labels.select(labels[id_col].alias("_lid"), labels[label_col].alias("_label")).where(
        "_lid is not null and _label is not null").where(~held_out(F.col("_lid"))).groupBy("_lid").agg(
        F.max(F.expr("cast(_label > 0 as int)")).alias("_label"))
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    able = docs.select(docs[id_col].alias("_id"), lang.alias("_lang"), docs[text_col].alias("_text")).where(
        F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    size = able.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = max(1, -(-marked.count() // s.shard), -(-size // s.shard_bytes))
    # A partition is a shard: both sides lie by id already, so the join moves nothing again.
    rows = able.repartition(shards, "_id").join(marked.repartition(shards, "_lid"), F.expr("_id = _lid")).select(
        "_id", "_label", "_lang", "_text")
    hashed = arrow_map(rows, _hash_columns(s.bits), fields(
        rows, StructField("_hashes", BinaryType()), keep=("_id", "_label", "_lang"))).persist()
    try:
        counts = {(r["aside"], r["label"]): r["count"] for r in hashed.mapInArrow(
            _shard_counts(s.kept_aside), "aside boolean, label long").groupBy("aside", "label").count().collect()}
        found = {y for _, y in counts}
        if len(found) < 2:
            return train([np.empty((0, 2), np.uint32)] * len(found), np.array(sorted(found), np.int64), [None] * len(found), s)
        whole = len(counts) < 4  # a label is missing among the rows to learn from, or those aside: all serve for both
        n = {y: sum(c for (aside, label), c in counts.items() if label == y and (whole or not aside)) for y in (0, 1)}
        model = _untrained(s, np.empty(0, np.uint32), np.random.default_rng(s.seed))
        squares, names = np.full(1, 1e-8, np.float32), [f"v{i}" for i in range(s.width + 1)]
        for epoch in range(s.epochs):
            shared = spark.sparkContext.broadcast((model, squares))
            got = hashed.mapInArrow(_shard_steps(shared, n[1] / (n[0] + n[1]), whole, epoch), ", ".join(
                ["hash long", *(f"{v} double" for v in names)])).groupBy("hash").agg(*(F.avg(v).alias(v) for v in names)).toArrow()
            shared.destroy()
            keys = got.column("hash").to_numpy()
            order = np.argsort(keys)
            values, keys = np.column_stack([got.column(v).to_numpy() for v in names])[order], keys[order]
            dense = keys < 0
            _set_parameters(model, values[dense][::-1].ravel())
            merged = np.union1d(model.hashes, keys[~dense].astype(np.uint32))
            table, sums = np.zeros((len(merged) + 1, s.width), np.float32), np.full(len(merged) + 1, 1e-8, np.float32)
            for hashes, rows_, squares_ in ((model.hashes, model.rows[1:], squares[1:]),
                                            (keys[~dense].astype(np.uint32), values[~dense, :-1], values[~dense, -1])):
                place = np.searchsorted(merged, hashes) + 1
                table[place], sums[place] = rows_, squares_
            model.hashes, model.rows, squares, model._index = merged, table, sums, None
        shared = spark.sparkContext.broadcast(model)
        _calibrate_counted(model, [tuple(r) for r in hashed.mapInArrow(
            _shard_logits(shared, whole), "lang string, at long, label long").groupBy("lang", "at", "label").count().collect()])
        return _without_untouched(model)
    finally:
        hashed.unpersist()


def _score_columns(shared):
    def run(batches):
        model = shared.value
        for batch in sliced(batches, 256):
            hashes = [word_hashes(t, model.settings.bits) for t in as_bytes(batch.column(batch.num_columns - 1))]
            yield *batch.columns[:-1], pa.array(model.scores(hashes))
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``(<id>, score, threshold, rejected)`` for every row: rejected at its language's threshold or above.

    Null and empty texts are scored like a text without known words, repeated rows alike; an empty table gives an empty
    result.  The model is broadcast; its size is bounded by the words of the training sample.
    """
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].alias("_id"), lang.alias("_lang"), docs[text_col].alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = arrow_map(rows, _score_columns(shared), fields(rows, StructField("score", DoubleType()), keep=("_id", "_lang")))
    return scored.select(F.col("_id").alias(id_col), "score", _threshold(model, F.col("_lang")).alias("threshold"),
                         (F.col("score") >= _threshold(model, F.col("_lang"))).alias("rejected"))


def _threshold(model: Model, lang):
    found = F.lit(float(model.settings.default_threshold))
    for name, cut in model.thresholds.items():
        found = F.when(lang == name, F.lit(float(cut))).otherwise(found)
    return found


def accepted(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows, with all their columns, whose score is below their language's threshold.

    Null and empty texts are scored like a text without known words; rows of no or an unknown language have the default
    threshold.  Repeated rows are judged alike.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    langs = docs.columns.index(lang_col) if lang_col in docs.columns else None
    texts = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for batch in sliced(batches, 256):
            scores = model.scores([word_hashes(t, model.settings.bits) for t in as_bytes(batch.column(texts))])
            names = batch.column(langs).cast(pa.string()).to_pylist() if langs is not None else [None] * batch.num_rows
            cuts = [model.thresholds.get(n, model.settings.default_threshold) for n in names]
            yield batch.filter(pa.array(scores < np.array(cuts, float)))

    return docs.mapInArrow(run, docs.schema)
