"""A gated recurrent language model in numpy with a class-factored softmax.

Ids stand in order of frequency, but for UNKNOWN and END. Classes are ranges of ids, small where words
are frequent, so that most tokens meet few words of their class; UNKNOWN is a class of its own.
"""

from __future__ import annotations

import heapq

import numpy as np

VOCABULARY, CLASSES = 4096, 48
UNKNOWN, END = 0, 1
EMBED, HIDDEN = 16, 16

SHAPES = {"emb": (VOCABULARY, EMBED), "wx": (EMBED, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wm": (VOCABULARY, HIDDEN), "bm": (VOCABULARY,)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters, each a view into one flat vector."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def classes(counts: np.ndarray) -> np.ndarray:
    """Where the classes begin, and the end: CLASSES + 1 ids. The root of a word's count is its share
    of a class, which comes near the least work: a token meets the words of its class alone."""
    share = np.cumsum(np.sqrt(np.maximum(counts[1:], 1e-6)))
    cuts = 1 + np.searchsorted(share, share[-1] * np.arange(1, CLASSES - 1) / (CLASSES - 1))
    bounds = np.concatenate([[0, 1], cuts + 1, [VOCABULARY]])
    for i in range(1, CLASSES):  # no class is empty
        bounds[i] = max(bounds[i], bounds[i - 1] + 1)
    for i in range(CLASSES - 1, 0, -1):
        bounds[i] = min(bounds[i], bounds[i + 1] - 1)
    return bounds


def start(counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """Parameters before training. counts: of each id. The biases make it the unigram model."""
    flat = np.zeros(SIZE, np.float32)
    p, rng = views(flat), np.random.default_rng(seed)
    for name in ("emb", "wx", "u", "wc", "wm"):
        p[name][:] = rng.normal(0, 0.1 if name in ("emb", "wc", "wm") else 1 / np.sqrt(SHAPES[name][0]), SHAPES[name])
    mass, bounds = np.maximum(counts.astype(float), 1e-6), classes(counts)
    by_class = np.add.reduceat(mass, bounds[:-1])
    p["bc"][:] = np.log(by_class / by_class.sum())
    p["bm"][:] = np.log(mass / np.repeat(by_class, np.diff(bounds)))
    return flat


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Of x, in place."""
    np.negative(np.maximum(x, -60, out=x), out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def tanh(x: np.ndarray) -> np.ndarray:
    """Of x, in place: 2 sigmoid(2 x) - 1."""
    x *= 2
    sigmoid(x)
    x *= 2
    x -= 1
    return x


def bounded(p: dict) -> bool:
    """Whether no logit can leave the range where its exponential is a plain float32: states are within 1."""
    inner = np.abs(p["wm"]).sum(axis=1) + np.abs(p["bm"])
    return bool(max(inner.max(), (np.abs(p["wc"]).sum(axis=0) + np.abs(p["bc"])).max()) < 60)


def softmax(x: np.ndarray, y: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of logits (choices, n), changed in place into unscaled probabilities: their sums, and ln P of the
    choices y. One column for each token, so that sums run along memory."""
    if not safe:
        x -= x.max(axis=0)
    at = x[y, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return total, at - np.log(total)


def forward(p: dict, x: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: bool = False):
    """States (T, H, B) after each of the T steps, the last one, and the trace for backward steps.
    x: (T, B) ids; keep: (T, B), 0 where a document starts; h: (H, B)."""
    steps, slots = x.shape
    given = np.matmul(p["wx"].T, p["emb"][x].transpose(0, 2, 1))
    given += p["b"][:, None]
    u, two = np.ascontiguousarray(p["u"].T), 2 * HIDDEN
    kind = given.dtype
    states = np.empty((steps, HIDDEN, slots), kind)
    before, an, new = (np.empty((steps, HIDDEN, slots), kind) for _ in range(3)) if trace else ([np.empty((HIDDEN, slots), kind)] * steps for _ in range(3))
    a = np.empty((3 * HIDDEN, slots), kind)
    for t in range(steps):
        np.multiply(h, keep[t], out=before[t])
        np.matmul(u, before[t], out=a)
        gates = given[t, :two]
        gates += a[:two]
        sigmoid(gates)
        if trace:
            an[t] = a[two:]
        np.multiply(gates[HIDDEN:], a[two:], out=new[t])
        new[t] += given[t, two:]
        tanh(new[t])
        h = states[t]
        np.subtract(before[t], new[t], out=h)
        h *= gates[:HIDDEN]
        h += new[t]
    return states, h, (before, an, new, given)


def segments(y: np.ndarray, bounds: np.ndarray):
    """Positions in the order of their class, the classes and the words within them in that order, and
    (class, from, to) of each class that occurs."""
    of = np.repeat(np.arange(CLASSES, dtype=np.uint8), np.diff(bounds))[y]  # small integers are sorted in linear time
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=CLASSES))
    parts = [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if a < b]
    of = of[order]
    return order, of, y[order] - bounds[of], parts


def log_likelihood(p: dict, bounds: np.ndarray, states: np.ndarray, y: np.ndarray) -> np.ndarray:
    """ln P of each target: of its class, and of the word within the class. states: (H, n)."""
    order, of, member, parts = segments(y, bounds)
    s, safe = states[:, order], bounded(p)
    found = softmax(p["wc"].T @ s + p["bc"][:, None], of, safe)[1]
    for c, a, b in parts:
        within = slice(bounds[c], bounds[c + 1])
        if bounds[c + 1] - bounds[c] > 1:
            found[a:b] += softmax(p["wm"][within] @ s[:, a:b] + p["bm"][within][:, None], member[a:b], safe)[1]
    out = np.empty_like(found)
    out[order] = found
    return out


def gradients(p: dict, bounds: np.ndarray, x: np.ndarray, y: np.ndarray, keep: np.ndarray, real: np.ndarray, h: np.ndarray, over: int):
    """One window of truncated backpropagation: (loss, gradients, rows of emb, last state). The state
    that comes in counts as given, so no gradient leaves the window. Gradients are divided by
    ``over``, the tokens of a full window, so that every token weighs the same."""
    states, last, (before, an, new, gates) = forward(p, x, keep, h, trace=True)
    steps, slots = x.shape
    flat = np.flatnonzero(real)
    order, of, member, parts = segments(y.ravel()[flat], bounds)
    flat = flat[order]
    s = states.transpose(1, 0, 2).reshape(HIDDEN, -1)[:, flat]
    safe, share = bounded(p), s.dtype.type(1 / over)
    d = p["wc"].T @ s
    d += p["bc"][:, None]
    total, ln = softmax(d, of, safe)
    loss = -ln.sum()
    d *= share / total
    d[of, np.arange(len(of))] -= share
    g = {"wm": np.zeros(SHAPES["wm"], np.float32), "bm": np.zeros(SHAPES["bm"], np.float32), "wc": s @ d.T, "bc": d.sum(axis=1)}
    ds = p["wc"] @ d
    for c, a, b in parts:
        if bounds[c + 1] - bounds[c] == 1:
            continue
        within, part = slice(bounds[c], bounds[c + 1]), s[:, a:b]
        d = p["wm"][within] @ part
        d += p["bm"][within][:, None]
        total, ln = softmax(d, member[a:b], safe)
        loss -= ln.sum()
        d *= share / total
        d[member[a:b], np.arange(b - a)] -= share
        np.matmul(d, part.T, out=g["wm"][within]) if d.dtype == np.float32 else g["wm"].__setitem__(within, d @ part.T)
        g["bm"][within] = d.sum(axis=1)
        ds[:, a:b] += p["wm"][within].T @ d
    into = np.zeros((HIDDEN, x.size), ds.dtype)
    into[:, flat] = ds
    into = into.reshape(HIDDEN, steps, slots).transpose(1, 0, 2)

    # what does not depend on the gradient that comes from later steps, for the whole window at once
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN]
    to_new = (1 - z) * (1 - new * new)
    to_z = (before - new) * z * (1 - z)
    to_r = an * r * (1 - r)
    da, dn = np.empty((steps, 3 * HIDDEN, slots), ds.dtype), np.empty((steps, HIDDEN, slots), ds.dtype)
    dh = np.zeros((HIDDEN, slots), ds.dtype)
    for t in range(steps - 1, -1, -1):
        step = da[t]
        dh += into[t]
        np.multiply(dh, to_new[t], out=dn[t])
        np.multiply(dh, to_z[t], out=step[:HIDDEN])
        np.multiply(dn[t], to_r[t], out=step[HIDDEN : 2 * HIDDEN])
        np.multiply(dn[t], r[t], out=step[2 * HIDDEN :])
        dh *= z[t]
        dh += p["u"] @ step
        dh *= keep[t]
    g["u"] = np.matmul(before, da.transpose(0, 2, 1)).sum(axis=0)
    da[:, 2 * HIDDEN :] = dn
    ids = x.ravel()
    by = np.argsort(ids.astype(np.uint16), kind="stable")
    rows, starts = np.unique(ids[by], return_index=True)
    g["wx"], g["b"] = np.matmul(p["emb"][x].transpose(0, 2, 1), da.transpose(0, 2, 1)).sum(axis=0), da.sum(axis=(0, 2))
    back = np.matmul(da.transpose(0, 2, 1), p["wx"].T).reshape(x.size, EMBED)
    return loss, g, (rows, np.add.reduceat(back[by], starts, axis=0)), last


def descend(p: dict, q: dict, g: dict, emb: tuple, rate: float) -> None:
    """Adagrad; q: sums of squares, in the shape of p."""
    for name, d in g.items():
        q[name] += d * d
        p[name] -= rate * d / (np.sqrt(q[name]) + 1e-6)
    rows, d = emb
    q["emb"][rows] += d * d
    p["emb"][rows] -= rate * d / (np.sqrt(q["emb"][rows]) + 1e-6)


def pack(docs: list[np.ndarray], slots: int, seed: int = 0):
    """(x, y, keep, doc): whole documents one after the other in ``slots`` rows.

    The longest go first to the emptiest slot, so that slots end about together; in a slot their
    order is then shuffled. The slots that end last come first. doc is -1 where a slot has ended.
    """
    slots = max(1, min(slots, len(docs)))
    load = [(0, s) for s in range(slots)]
    given: list[list[int]] = [[] for _ in range(slots)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, s = heapq.heappop(load)
        given[s].append(i)
        heapq.heappush(load, (n + len(docs[i]), s))
    steps = max(n for n, _ in load)
    x, y = np.full((slots, steps), END, np.uint16), np.full((slots, steps), END, np.uint16)
    keep, doc = np.ones((slots, steps), np.float32), np.full((slots, steps), -1, np.int32)
    rng = np.random.default_rng(seed)
    for s, (_, slot) in enumerate(sorted(load, reverse=True)):
        at, mine = 0, given[slot]
        for i in rng.permutation(mine) if len(mine) > 1 else mine:
            ids = docs[i]
            end = at + len(ids)
            y[s, at:end], x[s, at + 1 : end], keep[s, at], doc[s, at:end] = ids, ids[:-1], 0, i
            at = end
    return x, y, keep, doc


def windows(packed, length: int):
    """Of each window, (steps, slots): only the slots that have not ended before it."""
    x, y, keep, doc = packed
    for t in range(0, x.shape[1], length):
        live, part = int(np.count_nonzero(doc[:, t] >= 0)), slice(t, t + length)
        yield tuple(np.ascontiguousarray(v[:live, part].T).astype(kind, copy=False) for v, kind in ((x, np.int64), (y, np.int64), (keep, np.float32), (doc, np.int32)))


def train(flat: np.ndarray, squares: np.ndarray, bounds: np.ndarray, docs: list[np.ndarray], *, slots: int, length: int, rate: float, seed: int, most: int = 1024) -> float:
    """Goes over the documents once, changing flat and squares; returns the loss. Every window is
    backpropagated. The state is carried through the windows, and reset where a document starts; in
    training alone, a document also starts anew after ``most`` tokens, so that long ones fill many slots
    at once and not one slot for many steps."""
    p, q, total = views(flat), views(squares), 0.0
    packed = pack([d[i : i + most] for d in docs for i in range(0, len(d), most)], slots, seed)
    h = np.zeros((HIDDEN, len(packed[0])), np.float32)
    for x, y, keep, doc in windows(packed, length):
        loss, g, emb, h = gradients(p, bounds, x, y, keep, doc >= 0, h[:, : x.shape[1]], len(packed[0]) * length)
        descend(p, q, g, emb, rate)
        total += float(loss)
    return total


def score(flat: np.ndarray, bounds: np.ndarray, docs: list[np.ndarray], *, slots: int, length: int) -> np.ndarray:
    """ln P of each whole document."""
    p, packed = views(flat), pack(docs, slots)
    h = np.zeros((HIDDEN, len(packed[0])), np.float32)
    out = np.zeros(len(docs))
    for x, y, keep, doc in windows(packed, length):
        states, h, _ = forward(p, x, keep, h[:, : x.shape[1]])
        flat_doc = doc.ravel()
        at = np.flatnonzero(flat_doc >= 0)
        ll = log_likelihood(p, bounds, states.transpose(1, 0, 2).reshape(HIDDEN, -1)[:, at], y.ravel()[at])
        out += np.bincount(flat_doc[at], weights=ll, minlength=len(docs))
    return out
