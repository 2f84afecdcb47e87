"""A small causal self-attention model over subword ids, in numpy.

``HEADS`` heads attend over a window of ``WINDOW`` ids, by content and by a
learned preference for each distance.  What the heads see and the last id pass
through one hidden layer.  The next id is found in three steps of ``WAYS``
choices each, so its probability is a product of three small softmaxes instead
of one over the whole vocabulary.  Ids are numbered by frequency; those beyond
the first ``HEAD`` share the last class of the first step, in which each has a
fixed, smoothed share.  The corpus's counts of an id behind each of the
``BEHIND`` most frequent ids, smoothed by the counts of ids, are where training
starts: an untrained model gives exactly that distribution.
"""

from __future__ import annotations

import numpy as np

WAYS, WIDTH, WINDOW, OVERLAP, SHARED, BEHIND = 16, 16, 16, 4, 256, 1024
HEADS, KEY, VALUE, HIDDEN = 2, 4, 8, 32
HEAD = WAYS**3 - WAYS**2
QK = HEADS * KEY
BOTH = WIDTH + HEADS * VALUE
SHAPES = {
    "embed": (HEAD + SHARED, WIDTH), "qkv": (WIDTH, 2 * QK + HEADS * VALUE), "near": (HEADS, WINDOW),
    "mix": (BOTH, HIDDEN), "shift": (HIDDEN,), "out": (HIDDEN, 3 * WAYS),
}
CELLS, MOST = WAYS**3, 60
AGO = np.subtract.outer(np.arange(WINDOW), np.arange(WINDOW))  # how far place j is before place i
MASK = np.where(AGO < 0, np.float32(-1e9), np.float32(0))
BACK = np.maximum(AGO, 0)


class Frequencies:
    """Ids numbered by frequency, the tail's log shares, and the log terms of each step."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.rank = np.empty(len(counts), np.int32)
        self.rank[order] = np.arange(len(counts), dtype=np.int32)
        self.sorted = counts[order].astype(float) + 1
        tail = self.sorted[HEAD:]
        self.tail = np.zeros(len(counts), np.float32)
        self.tail[HEAD:] = np.log(tail / tail.sum()) if len(tail) else 0
        self.set_pairs(np.zeros((BEHIND, CELLS)))

    def set_pairs(self, pairs: np.ndarray) -> None:
        """pairs[p, t]: how often cell t stands behind an id whose rank, or the last class, is p."""
        cells = np.zeros(CELLS)
        cells[: min(HEAD, len(self.sorted))] = self.sorted[:HEAD]
        cells[HEAD] = self.sorted[HEAD:].sum()
        kinds = (pairs > 0).sum(1, keepdims=True)
        p = (pairs + np.maximum(kinds, 1) * (cells / cells.sum())).reshape(-1, WAYS, WAYS, WAYS)
        share = lambda x: np.log((x + 1e-12) / (x + 1e-12).sum(-1, keepdims=True)).astype(np.float32).reshape(-1, WAYS)
        self.terms = {"a": share(p.sum((2, 3))), "b": share(p.sum(3)), "c": share(p)}


def start() -> dict[str, np.ndarray]:
    """A model before training, which leaves the fixed terms as they are."""
    rng = np.random.default_rng(7)
    size = {"embed": 0.3, "qkv": WIDTH**-0.5, "near": 0.0, "mix": BOTH**-0.5, "shift": 0.0, "out": 0.0}
    model = {k: (rng.normal(size=s) * size[k]).astype(np.float32) for k, s in SHAPES.items()}
    model["near"][0] -= 0.5 * np.arange(WINDOW)  # one head begins with what is close, the other with all
    return model


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def shaped(vector: np.ndarray) -> dict[str, np.ndarray]:
    model, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        model[k] = vector[at : at + n].reshape(s)
        at += n
    return model


def inputs_of(ranks: np.ndarray) -> np.ndarray:
    """Rows of ``embed`` for ranks."""
    return np.where(ranks < HEAD, ranks, HEAD + ranks % SHARED)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of these many ids, laid end to end: each window's text and its start in that text."""
    step = WINDOW - OVERLAP
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    text = np.repeat(np.arange(len(lengths)), n)
    return text, (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step


class Batches:
    """Overlapping windows over texts; each id is a target of exactly one window."""

    def __init__(self, targets: np.ndarray, lengths: np.ndarray, begin: int):
        """targets: ranks of all texts end to end.  begin: the rank fed before a text's first id."""
        self.targets, self.offset, self.lengths = targets, np.cumsum(lengths) - lengths, lengths
        inputs = np.empty_like(targets)
        inputs[1:] = targets[:-1]
        inputs[self.offset] = begin
        self.inputs, self.behind = inputs_of(inputs), np.minimum(inputs, BEHIND - 1)
        self.text, self.start = windows(lengths)

    def of(self, which: np.ndarray):
        """Inputs [windows, WINDOW], which places are scored; there, the ids before, the targets and their texts."""
        text, start = self.text[which], self.start[which]
        place = start[:, None] + np.arange(WINDOW)
        n = self.lengths[text][:, None]
        at = self.offset[text][:, None] + np.minimum(place, n - 1)
        scored = (place < n) & ((np.arange(WINDOW) >= OVERLAP) | (start == 0)[:, None])
        scored = scored.ravel()
        here = at.ravel()[scored]
        return self.inputs[at], scored, self.behind[here], self.targets[here], np.repeat(text, WINDOW)[scored]


def attend(model, inputs):
    """Place vectors, what is seen at each place, and of each head: queries, keys, values, attention and what it sees.

    Where a score is beyond ``MOST``, or a place's own below its negative, each row's maximum is taken off
    first, so that no exponential overflows and no sum vanishes; attention is zero from behind.
    """
    x = model["embed"].take(inputs.ravel(), axis=0)
    qkv = (x @ model["qkv"]).reshape(*inputs.shape, -1)
    near, ones = model["near"][:, BACK] + MASK, np.ones(WINDOW, x.dtype)
    heads = []
    for h in range(HEADS):
        q, k = (np.ascontiguousarray(qkv[..., a : a + KEY]) for a in (h * KEY, QK + h * KEY))
        v = np.ascontiguousarray(qkv[..., 2 * QK + h * VALUE : 2 * QK + (h + 1) * VALUE])
        q *= np.asarray(KEY**-0.5, q.dtype)
        weight = q @ k.transpose(0, 2, 1)
        weight += near[h]
        if weight.max(initial=0) > MOST or weight.diagonal(0, 1, 2).min(initial=0) < -MOST:
            weight -= weight.max(-1, keepdims=True)
        np.exp(weight, out=weight)
        weight /= (weight.reshape(-1, WINDOW) @ ones).reshape(*inputs.shape, 1)
        heads.append((q, k, v, weight, weight @ v))
    return x, np.concatenate([h[-1] for h in heads], -1).reshape(-1, HEADS * VALUE), heads


def steps(behind, targets):
    """The three steps to each target: name, where its fixed terms are, and the choice; and which targets are in the tail.

    A tail target's last two steps do not count.
    """
    tail = targets >= HEAD
    t = np.where(tail, HEAD, targets)
    a, b, c = t // WAYS**2, t // WAYS % WAYS, t % WAYS
    within = behind * WAYS + a
    return (("a", behind, a), ("b", within, b), ("c", within * WAYS + b, c)), tail


def logits_of(model, frequencies: Frequencies, x, seen, scored, three):
    """What the hidden layer gets and gives at the scored places, and the logits [places, 3, WAYS]."""
    both = np.concatenate((x.take(scored, axis=0), seen.take(scored, axis=0)), 1)
    hidden = both @ model["mix"]
    hidden += model["shift"]
    np.maximum(hidden, 0, out=hidden)
    logits = (hidden @ model["out"]).reshape(-1, 3, WAYS)
    for i, (name, at, _) in enumerate(three):
        logits[:, i] += frequencies.terms[name].take(at, axis=0)
    return both, hidden, logits


def log_probability(model, frequencies: Frequencies, inputs, scored, behind, targets) -> np.ndarray:
    """Natural log probability of each target."""
    scored = np.flatnonzero(scored)
    x, seen, _ = attend(model, inputs)
    three, tail = steps(behind, targets)
    _, _, logits = logits_of(model, frequencies, x, seen, scored, three)
    rows, flat_ = np.arange(len(targets)) * (3 * WAYS), logits.ravel()
    picked = [flat_.take(rows + i * WAYS + choice) for i, (_, _, choice) in enumerate(three)]
    np.exp(logits, out=logits)  # the terms are logs of probabilities, and what is added to them is small
    each = np.log(logits.reshape(-1, WAYS) @ np.ones(WAYS, logits.dtype)).reshape(-1, 3)
    return picked[0] - each[:, 0] + np.where(tail, frequencies.tail[targets], picked[1] - each[:, 1] + picked[2] - each[:, 2])


def gradient(model, frequencies: Frequencies, inputs, scored, behind, targets) -> dict[str, np.ndarray]:
    """Gradient of the mean negative log probability."""
    scored = np.flatnonzero(scored)
    x, seen, heads = attend(model, inputs)
    three, tail = steps(behind, targets)
    both, hidden, d = logits_of(model, frequencies, x, seen, scored, three)
    n, out = max(1, len(targets)), {}
    np.exp(d, out=d)
    d /= (d.reshape(-1, WAYS) @ np.ones(WAYS, d.dtype)).reshape(-1, 3, 1)
    flat_, rows = d.ravel(), np.arange(len(targets)) * (3 * WAYS)
    for i, (_, _, choice) in enumerate(three):
        flat_[rows + i * WAYS + choice] -= 1
    d[tail, 1:] = 0
    d = d.reshape(-1, 3 * WAYS)
    d *= np.asarray(1 / n, d.dtype)
    out["out"] = hidden.T @ d
    d_hidden = d @ model["out"].T
    d_hidden *= hidden > 0
    out["mix"], out["shift"] = both.T @ d_hidden, d_hidden.sum(0)
    d_both = d_hidden @ model["mix"].T
    dx, d_seen = np.zeros_like(x), np.zeros_like(seen)
    dx[scored], d_seen[scored] = d_both[:, :WIDTH], d_both[:, WIDTH:]
    d_seen = d_seen.reshape(*inputs.shape, -1)
    d_qkv = np.empty((*inputs.shape, 2 * QK + HEADS * VALUE), x.dtype)
    out["near"] = np.zeros_like(model["near"])
    ones = np.ones(VALUE, x.dtype)
    for h, (q, k, v, weight, own) in enumerate(heads):
        ds = np.ascontiguousarray(d_seen[..., h * VALUE : (h + 1) * VALUE])
        d_qkv[..., 2 * QK + h * VALUE : 2 * QK + (h + 1) * VALUE] = weight.transpose(0, 2, 1) @ ds
        d_score = ds @ v.transpose(0, 2, 1)
        d_score -= ((ds * own).reshape(-1, VALUE) @ ones).reshape(*inputs.shape, 1)
        d_score *= weight
        out["near"][h] = np.bincount(BACK.ravel(), d_score.sum(0).ravel(), WINDOW)
        d_qkv[..., h * KEY : (h + 1) * KEY] = d_score @ k
        d_qkv[..., QK + h * KEY : QK + (h + 1) * KEY] = d_score.transpose(0, 2, 1) @ q
    for h in range(HEADS):
        d_qkv[..., h * KEY : (h + 1) * KEY] *= np.asarray(KEY**-0.5, d_qkv.dtype)
    d_qkv = d_qkv.reshape(-1, d_qkv.shape[-1])
    out["qkv"] = x.T @ d_qkv
    dx += d_qkv @ model["qkv"].T
    out["embed"] = _added(inputs.ravel(), dx, len(model["embed"]))
    return out


def _added(index, rows, n):
    """Sums of ``rows`` by ``index``."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    index = index[order]
    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    total = np.zeros((n, rows.shape[1]), rows.dtype)
    total[index[first]] = np.add.reduceat(rows[order], first, axis=0)
    return total


class Trainer:
    """Adam steps over windows, from one batch of texts to the next."""

    def __init__(self, vector: np.ndarray, frequencies: Frequencies, rate: float = 4e-3, size: int = 192, seed: int = 0):
        self.vector, self.frequencies, self.rate, self.size = vector.copy(), frequencies, rate, size
        self.model = shaped(self.vector)  # views of the vector
        self.m1, self.m2 = np.zeros_like(vector), np.zeros_like(vector)
        self.done, self.rng = 0, np.random.default_rng(seed)

    def over(self, batches: Batches) -> None:
        """One pass over all windows, in random order."""
        order = self.rng.permutation(len(batches.text))
        for at in range(0, len(order), self.size):
            self.done += 1
            g = flat(gradient(self.model, self.frequencies, *batches.of(order[at : at + self.size])[:-1]))
            self.m1 += np.float32(0.1) * (g - self.m1)
            g *= g
            self.m2 += np.float32(0.01) * (g - self.m2)
            step = np.sqrt(self.m2 / np.float32(1 - 0.99**self.done))
            step += np.float32(1e-6)
            self.vector -= np.float32(self.rate / (1 - 0.9**self.done)) * self.m1 / step
