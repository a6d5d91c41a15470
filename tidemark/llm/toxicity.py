"""Toxicity of texts by a bidirectional gated recurrent network with attention, in numpy.

A word enters as its own hashed embedding, the mean embedding of its hashed
character trigrams and the embedding of the first of them. Two gated recurrent passes read a window of
words, attention pools their states, and a text is as toxic as its worst
window. The network is fitted in one task from a bounded sample of labelled
rows; every window of every text is scored in tasks.
"""

import pickle

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm.sent import sent
from tidemark.llm.words import raw, slices

WORDS, GRAMS = 1 << 17, 1 << 13  # rows of the embeddings
WIDTH, HIDDEN = 8, 8
KNOWN = 5  # training texts that a word must be in to have an embedding of its own
LENGTH, STRIDE = 24, 12  # words of a window, and from one window to the next: each word is in two windows
EDGES = b".,;:!?\"'()[]{}<>|%&$#*-_/"
REMEMBERED = 150_000  # words whose inputs a task remembers
AT_ONCE = 2048  # windows


@dataclass
class Vocabulary:
    """Distinct words: embedding row of each, and its character trigrams one after another."""

    rows: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    heads: np.ndarray  # the first trigram


def vocabulary(words: list[bytes]) -> Vocabulary:
    plain = [w.lower().strip(EDGES) for w in words]
    rows = np.fromiter((xxhash.xxh3_64_intdigest(w) % WORDS for w in plain), np.int64, len(plain))
    marked = b"".join(b"\x02" + w + b"\x03" for w in plain)
    data = np.frombuffer(marked, np.uint8).astype(np.int64)
    counts = np.fromiter(map(len, plain), np.int64, len(plain))  # trigrams of the word with both marks
    ends = np.cumsum(counts + 2)
    codes = ((data[:-2] * 65_599 + data[1:-1] * 257 + data[2:]) * 0x9E3779B1 >> 7) % GRAMS if len(data) > 2 else data[:0]
    inside = np.ones(len(codes), bool)
    for back in (2, 1):  # trigrams that would reach into the next word
        at = ends - back
        inside[at[(at >= 0) & (at < len(codes))]] = False
    grams = codes[inside].astype(np.int16)
    starts = np.cumsum(counts) - counts
    heads = np.where(counts > 0, np.append(grams, 0)[np.minimum(starts, len(grams))], 0)
    return Vocabulary(rows, grams, starts, counts, heads)


def _flat(v: Vocabulary, chosen: np.ndarray):
    counts = v.counts[chosen]
    owner = np.repeat(np.arange(len(chosen)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(v.starts[chosen], counts)
    return owner, v.grams[place], 1.0 / np.maximum(counts, 1)


def inputs(net: dict, v: Vocabulary, chosen: np.ndarray) -> np.ndarray:
    owner, grams, share = _flat(v, chosen)
    chars = np.zeros((len(chosen), WIDTH), np.float32)
    for c in range(WIDTH):
        chars[:, c] = np.bincount(owner, net["grams"][grams, c], len(chosen))
    return np.concatenate([net["words"][v.rows[chosen]], chars * share[:, None], net["heads"][v.heads[chosen]]], 1).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _pass(steps, weights, mask, trace=None):
    """States of one recurrent pass; ``steps``: (time, row, gates) input parts."""
    h = np.zeros((steps.shape[1], HIDDEN), np.float32)
    out = np.empty((*steps.shape[:2], HIDDEN), np.float32)
    for t in range(len(steps)):
        inner = h @ weights
        gates = _sigmoid(steps[t][:, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(steps[t][:, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
        if trace is not None:
            trace.append((h, r, z, n, inner[:, 2 * HIDDEN :]))
        h = h + mask[t] * (1 - z) * (n - h)
        out[t] = h
    return out


def _back(dout, weights, mask, trace):
    dsteps = np.zeros((*dout.shape[:2], 3 * HIDDEN), np.float32)
    dweights, dh = np.zeros_like(weights), np.zeros_like(dout[0])
    for t in reversed(range(len(dout))):
        h, r, z, n, inner = trace[t]
        dh = dh + dout[t]
        moved = dh * mask[t]
        dn = moved * (1 - z) * (1 - n * n)
        dz = -moved * (n - h) * z * (1 - z)
        dr = dn * inner * r * (1 - r)
        dinner = np.concatenate([dr, dz, dn * r], 1)
        dsteps[t] = np.concatenate([dr, dz, dn], 1)
        dweights += h.T @ dinner
        dh = dh - moved * (1 - z) + dinner @ weights.T
    return dsteps, dweights


def _pool(net, both, mask):
    """Attention weights over the states of each window, and the window's value."""
    felt = np.tanh(both @ net["feel"])
    energy = felt @ net["weigh"] + (mask[:, :, 0] - 1) * 30
    energy = np.exp(energy - energy.max(0))
    share = energy * mask[:, :, 0]
    share = share / np.maximum(share.sum(0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", share, both)
    return felt, share, pooled, pooled @ net["out"] + net["bias"][0]


def window_values(net: dict, parts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Value of each window. ``parts``: input parts by word; ``at``: (window, time) rows of it, -1 for no word."""
    out = np.empty(len(at), np.float32)
    for start in range(0, len(at), AT_ONCE):
        own = at[start : start + AT_ONCE].T
        mask = (own >= 0).astype(np.float32)[:, :, None]
        steps = parts[own]
        ahead = _pass(steps[:, :, : 3 * HIDDEN], net["ahead"], mask)
        behind = _pass(steps[::-1, :, 3 * HIDDEN :], net["behind"], mask[::-1])[::-1]
        out[start : start + AT_ONCE] = _pool(net, np.concatenate([ahead, behind], 2), mask)[3]
    return out


def window_starts(words: int, stride: int = STRIDE) -> np.ndarray:
    """Windows begin every ``stride`` words; the last ends with the text."""
    last = max(0, words - LENGTH)
    return np.unique(np.append(np.arange(0, last, stride), last))


def windows(rows: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """(window, time) for one text's words; a short text is one window filled with -1."""
    padded = np.append(rows, np.full(max(0, LENGTH - len(rows)), -1, rows.dtype))
    return padded[window_starts(len(rows), stride)[:, None] + np.arange(LENGTH)]


def _summed(keys: np.ndarray, values: np.ndarray):
    """Distinct keys, and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(values[order], first)


def _step(net: dict, speed: dict, v: Vocabulary, at: np.ndarray, labels: np.ndarray, weight: np.ndarray, rate: float):
    """One step of gradient descent (Adagrad) on windows of known label."""
    own = at.T
    mask = (own >= 0).astype(np.float32)[:, :, None]
    chosen, place = np.unique(np.maximum(own, 0), return_inverse=True)
    place = place.reshape(own.shape)
    x = inputs(net, v, chosen)
    steps = (x @ net["in"] + net["in_bias"])[place]
    trace, trace2 = [], []
    ahead = _pass(steps[:, :, : 3 * HIDDEN], net["ahead"], mask, trace)
    behind = _pass(steps[::-1, :, 3 * HIDDEN :], net["behind"], mask[::-1], trace2)[::-1]
    both = np.concatenate([ahead, behind], 2)
    felt, share, pooled, value = _pool(net, both, mask)
    dvalue = ((_sigmoid(value) - labels) * weight / len(labels)).astype(np.float32)
    grads = {"out": pooled.T @ dvalue, "bias": np.array([dvalue.sum()], np.float32)}
    dpooled = dvalue[:, None] * net["out"]
    dshare = np.einsum("bh,tbh->tb", dpooled, both)
    denergy = share * (dshare - (share * dshare).sum(0))
    dfelt = denergy[:, :, None] * net["weigh"] * (1 - felt * felt)
    grads["weigh"] = np.einsum("tb,tba->a", denergy, felt)
    grads["feel"] = np.einsum("tbh,tba->ha", both, dfelt)
    dboth = share[:, :, None] * dpooled + dfelt @ net["feel"].T
    d1, grads["ahead"] = _back(dboth[:, :, :HIDDEN], net["ahead"], mask, trace)
    d2, grads["behind"] = _back(dboth[::-1, :, HIDDEN:], net["behind"], mask[::-1], trace2)
    dsteps = np.concatenate([d1, d2[::-1]], 2).reshape(-1, 6 * HIDDEN)
    by_word = _summed(place.ravel(), dsteps)[1]
    grads["in"], grads["in_bias"] = x.T @ by_word, by_word.sum(0)
    dx = by_word @ net["in"].T
    owner, grams, part = _flat(v, chosen)
    own_word = net["trained"][v.rows[chosen]]
    for name, rows, change in (
        ("words", v.rows[chosen][own_word], dx[own_word, :WIDTH]),
        ("grams", grams, dx[owner, WIDTH : 2 * WIDTH] * part[owner, None].astype(np.float32)),
        ("heads", v.heads[chosen], dx[:, 2 * WIDTH :]),
    ):
        if len(rows):
            touched, total = _summed(rows, change)
            speed[name][touched] += total * total
            net[name][touched] -= rate * total / np.sqrt(speed[name][touched] + 1e-8)
    for name, g in grads.items():
        speed[name] += g * g
        net[name] -= rate * g / np.sqrt(speed[name] + 1e-8)


def _odds(texts: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Log odds between texts of both labels for each number that texts hold; 0 where they are not clear."""
    seen = np.zeros((2, size))
    for held, label in zip(texts, labels):
        seen[label, held] += 1
    odds = np.log((seen[1] + 0.5) / (labels.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - labels).sum() + 1))
    return np.where(odds / np.sqrt((1 / (seen + 0.5)).sum(0)) > 2.5, odds, 0)


def _kinds_of_text(texts: list[np.ndarray], v: Vocabulary, rng, most: int = 6, turns: int = 10) -> np.ndarray:
    """Groups texts of alike spelling by their first trigrams (k-means): only to find telling words, not to score."""
    profile = np.zeros((len(texts), 512), np.float32)
    for i, t in enumerate(texts):
        profile[i] = np.sqrt(np.bincount(v.heads[t] % 512, minlength=512))
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    middle = profile[rng.permutation(len(texts))[:most]]
    for _ in range(turns):
        kind = (profile @ middle.T).argmax(1)
        middle = np.stack([profile[kind == k].sum(0) + 1e-6 for k in range(len(middle))])
        middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    return kind


def fit(texts: list[bytes], labels: list[int], rounds: int = 3, epochs: int = 4, seed: int = 7, stride: int = STRIDE) -> dict:
    """A network from labelled texts. Which window made a text toxic is not known: at first the one with the
    words that tell most in texts of its spelling, later the one that the network finds worst; of the other
    texts these and a random one."""
    rng = np.random.default_rng(seed)
    labels = np.array(labels, np.int64)
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in t.split()], np.int32) for t in texts]
    v = vocabulary(list(number) or [b""])
    del number, texts
    draw = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
    net = {
        "words": np.zeros((WORDS, WIDTH), np.float32), "grams": draw(GRAMS, WIDTH, scale=0.1), "heads": draw(GRAMS, WIDTH, scale=0.3),
        "in": draw(3 * WIDTH, 6 * HIDDEN), "in_bias": np.zeros(6 * HIDDEN, np.float32),
        "ahead": draw(HIDDEN, 3 * HIDDEN), "behind": draw(HIDDEN, 3 * HIDDEN),
        "feel": draw(2 * HIDDEN, HIDDEN), "weigh": draw(HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32),
    }
    speed = {name: np.full_like(p, 0.01) for name, p in net.items()}
    by_row = [np.unique(v.rows[r]) for r in rows]
    net["trained"] = np.bincount(np.concatenate(by_row), minlength=WORDS) >= KNOWN
    telling = _odds(by_row, labels, WORDS)
    net["words"][:, 0] = telling / 2
    cut = [windows(r, stride) for r in rows]
    owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    every = np.concatenate(cut)
    kind, value = _kinds_of_text(rows, v, rng), np.zeros(len(every), np.float32)
    for k in np.unique(kind):
        mine = np.flatnonzero(kind == k)
        heads = _odds([np.unique(v.heads[rows[i]]) for i in mine], labels[mine], GRAMS)
        at = np.flatnonzero(kind[owner] == k)
        value[at] = np.append(telling[v.rows] + heads[v.heads], 0)[every[at]].sum(1)
    for turn in range(rounds):
        if turn:
            value = window_values(net, _parts(net, v), every)
        order = np.lexsort((-value, owner))
        worst = order[np.append(True, owner[order][1:] != owner[order][:-1])]
        calm = rng.permutation(np.flatnonzero(labels[owner] == 0))[: len(labels)]
        sample = np.concatenate([worst, calm])
        known = labels[owner[sample]].astype(np.float32)
        weight = np.ones(len(known), np.float32)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(sample)), max(1, len(sample) // 192)):
                _step(net, speed, v, every[sample[part]], known[part], weight[part], 0.08)
    value = window_values(net, _parts(net, v), every)
    peak = np.full(len(cut), -np.inf)
    np.maximum.at(peak, owner, value)
    net["scale"], net["stride"] = _calibrate(peak, labels), stride
    return net


def _calibrate(value: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope and shift of a logistic curve from worst windows to labels (Newton steps, slightly held back)."""
    a = np.array([1.0, 0.0])
    x = np.stack([value, np.ones(len(value))], 1)
    for _ in range(25):
        p = _sigmoid(np.clip(x @ a, -30, 30))
        g = x.T @ (p - labels) + 0.1 * (a - [1, 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        a = a - np.linalg.solve(h, g)
    return np.array([max(a[0], 0.05), a[1]])


def _parts(net: dict, v: Vocabulary) -> np.ndarray:
    """Input part of both passes for every word, and zeros for no word."""
    out = np.zeros((len(v.rows) + 1, 6 * HIDDEN), np.float32)
    for start in range(0, len(v.rows), 50_000):
        chosen = np.arange(start, min(start + 50_000, len(v.rows)))
        out[chosen] = inputs(net, v, chosen) @ net["in"] + net["in_bias"]
    return out


class Scorer:
    def __init__(self, net: dict):
        self.net, self.number = net, {}
        self.parts = np.zeros((1, 6 * HIDDEN), np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        split = [t.split() for t in texts]
        asked = set().union(*split)
        if len(self.number) + len(asked) > REMEMBERED:
            self.number, self.parts = {}, np.zeros((1, 6 * HIDDEN), np.float32)
        new = list(asked.difference(self.number))
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.parts = np.concatenate([self.parts[:-1], _parts(self.net, vocabulary(new))])
        cut = [windows(np.fromiter(map(self.number.__getitem__, t), np.int64, len(t)), self.net["stride"]) for t in split]
        value = window_values(self.net, self.parts, np.concatenate(cut))
        starts = np.cumsum([0, *map(len, cut[:-1])])
        slope, shift = self.net["scale"]
        return _sigmoid(np.clip(np.maximum.reduceat(value, starts) * slope + shift, -30, 30).astype(np.float64))


def held_out(id):
    """Whether the row is kept for measuring: crc32 of the id as text, modulo 5, is 0. A null id counts as ''."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, most: int, most_chars: int):
    """(_id, _text, _label): at most ``most`` labelled rows that are not held out, a third of them toxic if there are so many,
    the first in the order of a hash of their ids; texts above ``most_chars`` are left out of the sample."""
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id)))
    known = known.groupBy(F.col(id).cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    picked = [known.filter(f"_label = {k}").orderBy(F.xxhash64("_id"), "_id").limit(m) for k, m in ((0, most - most // 3), (1, most // 3))]
    picked = F.broadcast(picked[0].union(picked[1]))  # at most ``most`` rows of two numbers
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text")).join(picked, "_id")
    rows = rows.filter(F.char_length("_text") <= most_chars).select("_id", "_text", "_label")
    return rows.orderBy(F.xxhash64("_id"), "_text").limit(most)


def fitted(known: DataFrame, stride: int) -> tuple[float, dict | None]:
    """Share of label 1 in the sample, and the network, or none where the sample has not both labels.

    One task fits it, so that the driver holds neither the texts nor what the fit needs beside them.
    """

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_order", "ascending"), ("_text", "ascending")])
        texts, labels = [t.encode() for t in table.column("_text").to_pylist()], table.column("_label").to_pylist()
        share = sum(labels) / len(labels)
        net = None if share in (0, 1) else pickle.dumps(fit(texts, labels, stride=stride))
        return pa.table({"share": pa.array([share], pa.float64()), "net": pa.array([net], pa.binary())})

    rows = known.withColumn("_order", F.xxhash64("_id"))
    found = rows.groupBy().applyInArrow(learn, "share double, net binary").first()
    return (0.0, None) if found is None else (found["share"], found["net"] and pickle.loads(found["net"]))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = 5000,
    sample_chars: int = 50_000,
    stride: int = STRIDE,
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5) in place of equally named columns.

    The network is fitted on at most ``sample`` labelled texts of up to
    ``sample_chars`` characters whose id is not held out; only the text of a
    row enters its score. All windows of all texts are scored: they begin every
    ``stride`` words (in the fit too) and the last one ends with the text. A
    very long text is many windows, scored ``AT_ONCE`` at a time.

    Null and empty texts are one window without words. Of several labels of
    one id the largest counts, null labels and ids are no labels. Repeated rows
    are scored each by itself. Where the sample has not both labels, every
    score is the share of label 1 in it (0 without labels).
    """
    spark = docs.sparkSession
    known = training_rows(docs, labels, id, text, label, sample, sample_chars)
    share, net = fitted(known, stride)
    flag = held_out(F.col(id))
    taken = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*taken)
    if net is None:
        return rows.withColumns({"held_out": flag, "score": F.lit(float(share)), "predicted": F.lit(int(share))})
    net = sent(spark, net)

    def run(batches):
        scorer = Scorer(net())
        for batch in batches:
            done = [scorer.scores(raw(part.column(text))) for part in slices(batch, 1 << 19)]
            if done:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(done))], [*batch.schema.names, "score"])

    scored = rows.mapInArrow(run, _with_score(rows))
    return scored.withColumns({"held_out": flag, "predicted": (F.col("score") >= 0.5).cast("int")}).select(
        *taken, "held_out", "score", "predicted"
    )


def _with_score(rows: DataFrame):
    return StructType([*rows.schema.fields, StructField("score", DoubleType())])
