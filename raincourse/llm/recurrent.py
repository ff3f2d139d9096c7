"""A gated recurrent network over symbols with a class-factored softmax, in numpy.

Symbols are the words of a short list and, for all other words, tail classes. A step reads the last
symbol and the state, and predicts the class of the next one: a group of listed words, inside
which a second softmax names the word, or a tail class. Documents lie one after another in lanes that step
together; a state goes on from window to window and starts anew where a document does. Training is
back-propagation truncated at the window, with Adam.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

PART = 512
ROWS = 2048  # of a softmax over classes at a time
FEW = 128  # of a long product at a time
END = 0  # symbol of a document's end, also read before its first word


@dataclass(frozen=True)
class Shape:
    hidden: int = 32
    listed: int = 1024
    groups: int = 32
    tails: int = 32

    @property
    def each(self) -> int:
        return self.listed // self.groups

    @property
    def sizes(self) -> dict[str, tuple[int, ...]]:
        h, classes = self.hidden, self.groups + self.tails
        return {"read": (self.listed + self.tails, 3 * h), "turn": (h, 3 * h), "to_class": (h + 1, classes), "to_word": (self.groups, h + 1, self.each)}

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Parts of ``flat``; a softmax has its weights and, as a last row, its bias."""
        out, at = {}, 0
        for name, size in self.sizes.items():
            n = int(np.prod(size))
            out[name], at = flat[at:at + n].reshape(size), at + n
        h, by_class, by_word = self.hidden, out["to_class"], out["to_word"]
        return out | {"classes": by_class[:h], "class_bias": by_class[h], "words": by_word[:, :h], "word_bias": by_word[:, h]}

    @property
    def total(self) -> int:
        return sum(int(np.prod(s)) for s in self.sizes.values())


def start_weights(shape: Shape, counts: np.ndarray, seed: int = 13) -> np.ndarray:
    """Weights that give each symbol its share of ``counts`` (listed words, then tail classes) whatever the state; a count below zero marks a free place."""
    flat = np.random.default_rng(seed).normal(0, 0.1, shape.total).astype(np.float32)
    w = shape.views(flat)
    w["classes"][:], w["words"][:] = 0, 0
    listed = counts[:shape.listed].reshape(shape.groups, shape.each)
    w["word_bias"][:] = np.where(listed < 0, -1e4, np.log(np.maximum(listed, 0) + 0.1))
    w["class_bias"][:] = np.log(np.concatenate([np.maximum(listed, 0).sum(axis=1), counts[shape.listed:]]) + 0.1)
    w["class_bias"][:shape.groups][(listed < 0).all(axis=1)] = -1e4
    return flat


class Lanes:
    """Documents dealt to lanes of about equal length; windows of all lanes that are not at their end."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray, lanes: int, begins: np.ndarray | None = None):
        """``symbols`` of all documents in a row, each with ``counts`` of them and its end symbol last.

        ``begins`` is false for parts that go on with the document of the part before.
        """
        lanes, symbols = max(1, min(lanes, len(counts))), symbols.astype(np.int32)  # half the memory to gather from
        loads, held = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for doc in np.argsort(-counts, kind="stable").tolist():
            load, k = heapq.heappop(loads)
            held[k].append(doc)
            heapq.heappush(loads, (load + int(counts[doc]), k))
        held.sort(key=lambda docs: -int(counts[docs].sum()))
        order = np.concatenate([np.array(docs, np.int64) for docs in held])
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        lengths = counts[order]
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.source = np.repeat(first[order], lengths) + inside  # where in ``symbols`` each place of the lanes comes from
        self.target = symbols[self.source]
        self.fresh = inside == 0
        self.input = symbols[self.source - 1]
        self.input[self.fresh if begins is None else self.fresh & np.repeat(begins[order], lengths)] = END
        self.length = np.array([int(counts[docs].sum()) for docs in held])
        self.start = np.cumsum(self.length) - self.length

    def windows(self, steps: int):
        """(places, valid) of each window, both of (steps, lanes); lanes keep their order and go when they end."""
        for at in range(0, int(self.length.max(initial=0)), steps):
            live = int(np.searchsorted(-self.length, -at))
            step = np.arange(at, min(at + steps, int(self.length[0])))[:, None]
            valid = step < self.length[None, :live]
            yield self.start[None, :live] + np.minimum(step, self.length[None, :live] - 1), valid


class Cell:
    """One step of the network for all lanes, gate by gate: arrays are (gate, lanes, hidden), so each gate lies in one piece and a step stays in the cache.

    The logistic function of x is half of 1 + tanh(x / 2), so weights are halved beforehand: those of both gates, and
    those from the state into the new state, which 1 + tanh multiplies.
    """

    def __init__(self, w, shape: Shape):
        h, half = shape.hidden, np.float32(0.5)
        self.read = np.empty((3, len(w["read"]), h), np.float32)
        for k, times in enumerate((half, half, np.float32(1))):
            np.multiply(w["read"][:, k * h:(k + 1) * h], times, out=self.read[k])
        self.turn = w["turn"].reshape(h, 3, h).transpose(1, 0, 2) * half
        self.buffers = None

    def step(self, symbols: np.ndarray, before: np.ndarray, out: np.ndarray, kept=None) -> None:
        """State ``out`` after reading ``symbols`` in state ``before``; ``kept`` gets what the way back needs."""
        if self.buffers is None or self.buffers.shape[2:] != before.shape:
            self.buffers = np.empty((3, 3, *before.shape), np.float32)
        x, a, rest = self.buffers
        gates, fed, new, far = kept or (x[:2], *rest)
        self.read.take(symbols, 1, x, "clip")
        np.matmul(before, self.turn, out=a)
        np.add(x[:2], a[:2], out=gates)
        np.tanh(gates, out=gates)
        np.multiply(gates[1], a[2], out=fed)
        fed += a[2]
        np.add(fed, x[2], out=new)
        np.tanh(new, out=new)
        np.subtract(before, new, out=far)
        np.multiply(gates[0], far, out=out)
        far += out
        far *= np.float32(0.5)
        np.add(far, new, out=out)


def softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What to divide each row by, and its logarithm; ``logits`` becomes the shares before division."""
    top = np.float32(0)
    if not logits.max(initial=0) < 60:  # else exp stays within range as it is
        top = logits.max(axis=1, keepdims=True)
        logits -= top
    np.exp(logits, out=logits)
    total = logits @ np.ones((logits.shape[1], 1), np.float32)
    return total, (np.log(total) + top)[:, 0]


def across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of ``a`` turned over and ``b``, both with many rows and few columns, as a sum of products of a few rows each, which are faster."""
    n = len(a) - len(a) % FEW
    many = np.matmul(a[:n].reshape(-1, FEW, a.shape[1]).transpose(0, 2, 1), b[:n].reshape(-1, FEW, b.shape[1])).sum(axis=0)
    return many + a[n:].T @ b[n:]


def log_scores(w, shape: Shape, states: np.ndarray, target: np.ndarray, grads=None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural logarithm of each target's probability; with ``grads`` also adds their gradients of the loss and returns that of the states."""
    groups, each, h, by_class, by_word = shape.groups, shape.each, shape.hidden, w["to_class"], w["to_word"]
    listed = target < shape.listed
    cls = np.where(listed, target // each, target - shape.listed + groups)
    score, back = np.empty(len(target), np.float32), None if grads is None else np.empty((len(target), h), np.float32)
    for at in range(0, len(target), ROWS):
        some = states[at:at + ROWS]
        logits = some @ by_class[:h]
        logits += by_class[h]
        flat, place = logits.reshape(-1), np.arange(len(some)) * logits.shape[1] + cls[at:at + ROWS]
        part = flat[place]
        total, log_total = softmax(logits)
        np.subtract(part, log_total, out=score[at:at + ROWS])
        if grads is not None:
            logits *= 1 / total
            flat[place] -= 1
            grads["to_class"][:h] += across(some, logits)
            grads["to_class"][h] += np.ones(len(some), np.float32) @ logits
            np.matmul(logits, by_class[:h].T, out=back[at:at + ROWS])
    # Listed words in order of their group, so that each group is one product.
    rows = np.flatnonzero(listed)
    rows = rows[np.argsort(cls[rows].astype(np.uint16), kind="stable")]
    bounds = np.searchsorted(cls[rows], np.arange(groups + 1)).tolist()
    spans = [(g, x, y) for g, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if x < y]
    own, logits = np.empty((len(rows), h + 1), np.float32), np.empty((len(rows), each), np.float32)
    own[:, :h], own[:, h] = states[rows], 1
    for g, x, y in spans:
        np.matmul(own[x:y], by_word[g], out=logits[x:y])
    flat, place = logits.reshape(-1), np.arange(len(rows)) * each + target[rows] % each
    named = flat[place]
    total, log_total = softmax(logits)
    score[rows] += named - log_total
    if grads is not None:
        logits *= 1 / total
        flat[place] -= 1
        more, words = np.empty((len(rows), h), np.float32), grads["to_word"]
        for g, x, y in spans:
            words[g] += own[x:y].T @ logits[x:y]
            np.matmul(logits[x:y], by_word[g, :h].T, out=more[x:y])
        back[rows] += more
    return score, back


def add_rows(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add each row of ``values``, which are pairs of 32-bit numbers, to the row ``at`` of ``out``."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    if len(first):
        pairs = np.add.reduceat(values[order].view(np.complex64), first)  # added two at a time
        out[at[first]] += pairs.view(np.float32)


class Trainer:
    def __init__(self, shape: Shape, flat: np.ndarray, rate: float, steps: int = 16, lanes: int = 192, clip: float = 5.0):
        self.shape, self.flat, self.rate, self.steps, self.lanes, self.clip = shape, flat.copy(), rate, steps, lanes, clip
        self.w, self.grad = shape.views(self.flat), np.zeros_like(flat)
        self.g = shape.views(self.grad)
        self.first, self.second, self.turn, self.seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0
        self.room = None

    def learn(self, symbols: np.ndarray, counts: np.ndarray) -> None:
        """One pass over documents, a step of Adam a window.

        A long document is dealt out in parts of ``PART`` symbols, each read from a state of zero after the
        symbol before it, so that lanes are of about equal length and windows stay full.
        """
        parts = -(-counts // PART)
        lengths = np.full(int(parts.sum()), PART)
        last = np.cumsum(parts) - 1
        lengths[last] = counts - (parts - 1) * PART
        begins = np.zeros(len(lengths), bool)
        begins[(last - parts + 1)[parts > 0]] = True
        dealt = Lanes(symbols, lengths, self.lanes, begins)
        state = np.zeros((len(dealt.length), self.shape.hidden), np.float32)
        for at, valid in dealt.windows(self.steps):
            state = self._window(dealt.input[at], dealt.fresh[at], dealt.target[at], valid, state[:at.shape[1]])
            self.seen += int(valid.sum())

    def _window(self, read, fresh, target, valid, state):
        w, g, shape, h = self.w, self.g, self.shape, self.shape.hidden
        cell, size = Cell(w, shape), (*valid.shape, h)
        if self.room is None or self.room[0].shape != size:  # kept from window to window, so that no new pages are touched
            self.room = *(np.empty(size, np.float32) for _ in range(5)), np.empty((len(valid), 2, *size[1:]), np.float32), np.empty((*valid.shape, 4 * h), np.float32)
        states, before, fed, new, far, gates, flow = self.room
        starts = [np.flatnonzero(f) for f in fresh]
        for t, start in enumerate(starts):
            before[t] = state
            before[t, start] = 0
            state = states[t]
            cell.step(read[t], before[t], state, (gates[t], fed[t], new[t], far[t]))
        self.grad[:] = 0
        if valid.all():
            _, into = log_scores(w, shape, states.reshape(-1, h), target.ravel(), g)
        else:
            flat = np.flatnonzero(valid)
            into = np.zeros((valid.size, h), np.float32)
            into[flat] = log_scores(w, shape, states.reshape(-1, h)[flat], target.ravel()[flat], g)[1]
        into = into.reshape(size)
        # Of each row: the loss by the state's part in the new state, by both gates and by the new state, before their functions.
        d_turn = np.zeros_like(state)
        turned, half = np.concatenate([w["turn"].T[2 * h:], w["turn"].T[:2 * h]]), np.float32(0.5)
        e, u, v = (np.empty_like(state) for _ in range(3))
        for t in range(len(valid) - 1, -1, -1):
            d, (z, r) = into[t], gates[t]
            d += d_turn
            np.multiply(d, z, out=e)
            np.subtract(d, e, out=e)
            e *= half
            np.multiply(e, far[t], out=flow[t, :, h:2 * h])
            np.multiply(new[t], new[t], out=u)
            np.subtract(1, u, out=u)
            u *= e
            flow[t, :, 3 * h:] = u
            u *= half
            np.multiply(u, r, out=v)
            np.add(u, v, out=flow[t, :, :h])
            u -= v
            np.multiply(u, fed[t], out=flow[t, :, 2 * h:3 * h])
            np.matmul(flow[t, :, :3 * h], turned, out=d_turn)
            d_turn += d
            d_turn -= e
            d_turn[starts[t]] = 0
        flow = flow.reshape(-1, 4 * h)
        by_state = across(before.reshape(-1, h), flow[:, :3 * h])
        g["turn"][:, :2 * h] += by_state[:, h:]
        g["turn"][:, 2 * h:] += by_state[:, :h]
        add_rows(g["read"], read.ravel(), flow[:, h:])
        self._adam(1 / (self.steps * self.lanes))
        return state.copy()

    def _adam(self, scale: float) -> None:
        self.turn += 1
        norm = float(np.sqrt(self.grad @ self.grad)) * scale
        scale = np.float32(scale * min(1.0, self.clip / norm) if norm > 0 else scale)
        # ``first`` and ``second`` are ten and a hundred times the running means of the gradient and its square.
        rate, root = np.float32(0.1 * self.rate / (1 - 0.9 ** self.turn)), np.float32(0.1 * (1 - 0.99 ** self.turn) ** -0.5)
        g = self.grad
        g *= scale
        self.first *= np.float32(0.9)
        self.first += g
        g *= g
        self.second *= np.float32(0.99)
        self.second += g
        np.sqrt(self.second, out=g)
        g *= root
        g += np.float32(1e-6)
        np.divide(self.first, g, out=g)
        g *= rate
        self.flat -= g


def document_scores(shape: Shape, flat: np.ndarray, symbols: np.ndarray, counts: np.ndarray, steps: int = 64, lanes: int = 96) -> np.ndarray:
    """Natural logarithm of the probability of each document's symbols, states carried from window to window."""
    w, out = shape.views(flat), np.zeros(len(counts))
    cell, dealt = Cell(w, shape), Lanes(symbols, counts, lanes)
    doc = np.repeat(np.arange(len(counts)), counts)[dealt.source]
    state = np.zeros((len(dealt.length), shape.hidden), np.float32)
    for at, valid in dealt.windows(steps):
        read, fresh = dealt.input[at], dealt.fresh[at]
        state, states = state[:at.shape[1]], np.empty((*at.shape, shape.hidden), np.float32)
        for t, starts in enumerate(fresh.any(axis=1).tolist()):
            if starts:
                state = state.copy()
                state[fresh[t]] = 0
            cell.step(read[t], state, states[t])
            state = states[t]
        if valid.all():
            places, states = at.ravel(), states.reshape(-1, shape.hidden)
        else:
            places, states = at[valid], states[valid]
        score, _ = log_scores(w, shape, states, dealt.target[places])
        out += np.bincount(doc[places], score, len(counts))
    return out
