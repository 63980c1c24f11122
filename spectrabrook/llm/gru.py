"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Symbols are numbers. A symbol's class is its number divided by the class size.
Each symbol has a row of input activations (its embedding already projected to
the three gates). With zero output weights the model is the unigram
distribution that its biases hold; training departs from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

f32 = np.float32


class Lanes:
    """Documents dealt to lanes, longest first; windows of steps with the state carried across.

    With `piece`, a longer document is dealt in pieces of so many symbols: each
    starts afresh, after the symbol before it, so that one long document doesn't
    leave the other lanes empty.
    """

    def __init__(self, docs: list[np.ndarray], lanes: int, steps: int, start: int, piece: int = 0):
        self.steps, self.start = steps, start
        self.text = np.concatenate(docs) if docs else np.zeros(0, np.int16)
        size = np.array([len(d) for d in docs], np.int64)
        first = np.cumsum(size) - size
        parts = -(-size // piece) if piece else np.minimum(size, 1)
        self.doc = np.repeat(np.arange(len(docs)), parts)
        nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.at = first[self.doc] + nth * piece
        self.end = first[self.doc] + (np.minimum(size[self.doc], (nth + 1) * piece) if piece else size[self.doc])
        self.opens = nth == 0
        order = np.argsort(self.at - self.end, kind="stable")
        self.doc, self.at, self.end, self.opens = self.doc[order], self.at[order], self.end[order], self.opens[order]
        self.lanes = max(1, lanes)

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """inputs, targets and mask (steps x lanes), which lanes start afresh, and each lane's document.

        Lanes that have run out are cut off, so late windows are narrow; the
        consumer keeps the state of the lanes named by the last array, `kept`.
        """
        part = np.arange(min(self.lanes, len(self.doc)))
        following = len(part)
        at, fresh, kept = self.at[part], np.ones(len(part), bool), np.arange(len(part))
        span = np.arange(self.steps)[:, None]
        while len(part):
            where = at + span
            mask = where < self.end[part]
            wanted = np.where(mask, self.text.take(where, mode="clip"), 0).astype(np.int64)
            before = self.text.take(at - 1, mode="clip")
            given = np.concatenate([np.where(fresh & self.opens[part], self.start, before)[None], wanted[:-1]])
            given[1:][~mask[1:]] = self.start
            yield given, wanted, mask, fresh, self.doc[part], kept
            at = at + self.steps
            done = np.flatnonzero(at >= self.end[part])
            more = done[: len(self.doc) - following]
            fresh = np.zeros(len(part), bool)
            part[more] = np.arange(following, following + len(more))
            at[more], fresh[more] = self.at[part[more]], True
            following += len(more)
            kept = np.delete(np.arange(len(part)), done[len(more) :])
            part, at, fresh = part[kept], at[kept], fresh[kept]


def initial(counts: np.ndarray, class_size: int, hidden: int = 32, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters for symbols with these counts, padded to whole classes; padding has next to no probability."""
    rng = np.random.default_rng(seed)
    classes = -(-len(counts) // class_size)
    mass = np.zeros(classes * class_size)
    mass[: len(counts)] = np.maximum(counts, 0.5)
    mass = np.maximum(mass, 1e-9).reshape(classes, class_size)
    total = mass.sum(1)
    return {
        "table": rng.normal(0, 0.3, (classes * class_size, 3 * hidden)).astype(f32),
        "loop": (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden) * 0.7).astype(f32),
        "bias": np.r_[np.ones(hidden), np.zeros(2 * hidden)].astype(f32),
        "class_w": np.zeros((hidden, classes), f32),
        "class_b": np.log(total / total.sum()).astype(f32),
        "word_w": np.zeros((classes, class_size, hidden), f32),
        "word_b": np.log(mass / total[:, None]).astype(f32),
    }


def _run(p: dict, given: np.ndarray, h: np.ndarray):
    """States before each step and the last, (steps + 1, hidden, lanes); gates (z, r) and candidates of each step, and what r multiplies."""
    steps, hidden = len(given), len(h)
    # A sigmoid is 1 / (1 + exp(-activation)).
    sign = np.r_[np.full(2 * hidden, -1), np.ones(hidden)].astype(f32)
    a = np.ascontiguousarray(((p["table"] + p["bias"]) * sign).take(given, axis=0).transpose(0, 2, 1))
    loop = np.ascontiguousarray((p["loop"] * sign).T)
    states = np.empty((steps + 1, *h.shape), f32)
    states[0] = h
    inner = np.empty((steps, *h.shape), f32)
    for t in range(steps):
        h, zr, n, new = states[t], a[t, : 2 * hidden], a[t, 2 * hidden :], states[t + 1]
        zr += loop[: 2 * hidden] @ h
        with np.errstate(over="ignore"):
            np.exp(zr, out=zr)
        zr += f32(1)
        np.divide(f32(1), zr, out=zr)
        np.matmul(loop[2 * hidden :], h, out=inner[t])
        n += np.multiply(zr[hidden:], inner[t], out=new)
        np.tanh(n, out=n)
        np.subtract(h, n, out=new)
        new *= zr[:hidden]
        new += n
    return states, a, inner


def _rows(x: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """(steps, features, lanes) as a row of features, and a one for the biases, for each cell of step and lane."""
    flat = np.ascontiguousarray(x.transpose(0, 2, 1)).reshape(-1, x.shape[1])
    out = np.ones((len(cell), x.shape[1] + 1), f32)
    out[:, :-1] = flat.take(cell, axis=0)
    return out


def _moderate(e: np.ndarray) -> np.ndarray:
    """Logits whose exp neither overflows nor is zero in a whole row: if any are large, all are shifted by their row's largest, in place."""
    if e.size and not (e.max() < 80 and e.min() > -80):
        e -= e.max(axis=1, keepdims=True)
    return e


def _picked(e: np.ndarray, at: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Log softmax of each row of logits at one column, a few rows at a time; e is overwritten."""
    out, ones = np.empty(len(e), f32), np.ones(e.shape[1], f32)
    for i in range(0, len(e), rows):
        part = _moderate(e[i : i + rows])
        picked = part[np.arange(len(part)), at[i : i + rows]]
        np.exp(part, out=part)
        out[i : i + rows] = picked - np.log(part @ ones)
    return out


def _by_word(x: np.ndarray, word: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Logits inside the class of each span."""
    e = np.empty((len(x), word.shape[1]), f32)
    for c, lo, hi in spans:
        np.matmul(x[lo:hi], word[c].T, out=e[lo:hi])
    return e


def _by_class(wanted: np.ndarray, mask: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Cells of the mask with targets of a class side by side, their classes, and (class, begin, end) of each."""
    cell = np.flatnonzero(mask)
    cls = (wanted.ravel()[cell] // size).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    edge = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1], True])
    return cell[order], cls, [(int(cls[a]), a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def log_likelihoods(p: dict, docs: list[np.ndarray], start: int, lanes: int = 320, steps: int = 56) -> np.ndarray:
    """Natural log-probability of each document, the state carried from window to window."""
    out = np.zeros(len(docs))
    hidden, size = p["loop"].shape[0], p["word_b"].shape[1]
    classes, word = np.vstack([p["class_w"], p["class_b"]]), np.concatenate([p["word_w"], p["word_b"][:, :, None]], axis=2)
    h = None
    for given, wanted, mask, fresh, doc, kept in Lanes(docs, lanes, steps, start):
        h = np.zeros((hidden, len(doc)), f32) if h is None else h[:, kept]
        h[:, fresh] = 0
        states, _, _ = _run(p, given, h)
        h = states[-1]
        # The state that predicts a step's target is the one after its input.
        cell, cls, spans = _by_class(wanted, mask, size)
        x, who = _rows(states[1:], cell), cell % len(doc)
        column = wanted.ravel()[cell] % size
        logp = _picked(x @ classes, cls).astype(np.float64)
        logp += _picked(_by_word(x, word, spans), column)
        np.add.at(out, doc, np.bincount(who, logp, len(doc)))
    return out


def train(p: dict, docs: list[np.ndarray], start: int, lanes: int = 64, steps: int = 16, rate: float = 0.08, clip: float = 1.0, piece: int = 1024) -> tuple[dict, int]:
    """One pass of truncated backpropagation with Adagrad over docs; new parameters, and tokens seen."""
    p = {k: v.copy() for k, v in p.items()}
    g2 = {k: np.full(v.shape, 1e-3, f32) for k, v in p.items()}
    hidden, size = p["loop"].shape[0], p["word_b"].shape[1]
    h, seen = None, 0

    def step(name: str, grad: np.ndarray) -> None:
        grad = np.clip(grad, -clip, clip)
        g2[name] += grad * grad
        p[name] -= f32(rate) * grad / np.sqrt(g2[name])

    for given, wanted, mask, fresh, doc, kept in Lanes(docs, lanes, steps, start, piece):
        h = np.zeros((hidden, len(doc)), f32) if h is None else h[:, kept]
        h[:, fresh] = 0
        states, gates, inner = _run(p, given, h)
        h = states[-1].copy()
        cell, cls, spans = _by_class(wanted, mask, size)
        n = len(cell)
        seen += n
        scale = f32(1 / np.sqrt(n))
        x, column, row = _rows(states[1:], cell), wanted.ravel()[cell] % size, np.arange(n)
        d = _moderate(x @ np.vstack([p["class_w"], p["class_b"]]))
        np.exp(d, out=d)
        d *= (scale / (d @ np.ones(d.shape[1], f32)))[:, None]
        d[row, cls] -= scale
        dx, dclass = d @ p["class_w"].T, x.T @ d
        grads = [("class_w", dclass[:-1]), ("class_b", dclass[-1])]
        word = np.concatenate([p["word_w"], p["word_b"][:, :, None]], axis=2)
        e = _moderate(_by_word(x, word, spans))
        np.exp(e, out=e)
        e *= (scale / (e @ np.ones(size, f32)))[:, None]
        e[row, column] -= scale
        dword = np.zeros_like(word)
        for c, lo, hi in spans:
            dx[lo:hi] += e[lo:hi] @ p["word_w"][c]
            np.matmul(e[lo:hi].T, x[lo:hi], out=dword[c])
        grads += [("word_w", dword[:, :, :-1]), ("word_b", dword[:, :, -1])]
        dh_out = np.zeros((mask.size, hidden), f32)
        dh_out[cell] = dx
        dh_out = np.ascontiguousarray(dh_out.reshape(*mask.shape, hidden).transpose(0, 2, 1))
        dg, dn = np.empty_like(gates), np.empty_like(inner)
        dh = np.zeros_like(h)
        for t in range(len(given) - 1, -1, -1):
            dh += dh_out[t]
            z, r, nn, now = gates[t, :hidden], gates[t, hidden : 2 * hidden], gates[t, 2 * hidden :], dg[t]
            dz, dr, to_n = now[:hidden], now[hidden : 2 * hidden], dn[t]
            keep = 1 - z
            np.subtract(states[t], nn, out=dz)
            dz *= z
            dz *= keep
            dz *= dh
            np.multiply(nn, nn, out=to_n)
            np.subtract(1, to_n, out=to_n)
            to_n *= keep
            to_n *= dh
            np.multiply(to_n, r, out=now[2 * hidden :])
            np.subtract(1, r, out=dr)
            dr *= inner[t]
            dr *= now[2 * hidden :]
            dh *= z
            dh += p["loop"] @ now
        dloop = np.matmul(dg, states[:-1].transpose(0, 2, 1)).sum(axis=0).T
        dg[:, 2 * hidden :] = dn
        symbol, many = given.ravel(), len(p["table"])
        dtable = np.stack([np.bincount(symbol, dg[:, k].ravel(), many) for k in range(3 * hidden)], axis=1).astype(f32)
        grads += [("table", dtable), ("loop", dloop), ("bias", dtable.sum(axis=0))]
        for g in grads:
            step(*g)
    return p, seen
