"""A small causal self-attention model over class ids, trained and run in numpy.

One layer: embeddings of ids and of places in the window, one attention head under a causal mask,
a residual, a linear softmax.  Windows of ``2 * half`` places overlap by half: the first scores all
its places, every later one only its second half, so each token is scored once and sees at
least ``half`` tokens before it where there are so many.

Ids come in the order of their frequency.  The softmax goes by levels of ``WIDTH`` outcomes: the last outcome of a level is that the id
is in a later one, so a frequent id costs one level whatever their number, and all ids together have probability one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LIMIT = np.float32(60)  # of logits, in training and scoring alike
WIDTH = 128  # outcomes of a level


def levels(classes: int) -> int:
    return max(1, -(-(classes - 1) // (WIDTH - 1)))


def level_of(ids: np.ndarray, classes: int) -> np.ndarray:
    """The level of each id; its column is the id moved on by its level."""
    return np.minimum(ids // (WIDTH - 1), levels(classes) - 1)


@dataclass
class AttentionModel:
    params: dict[str, np.ndarray]
    half: int

    @property
    def classes(self) -> int:
        return self.params["id"].shape[0] - 1

    def _forward(self, inputs: np.ndarray, since: int = 0) -> tuple:
        """Hidden vectors of windows ``(batch, places)`` of ids, of the places from ``since`` on; id ``classes`` stands for the start."""
        p = self.params
        x = p["id"][inputs] + p["place"][: inputs.shape[1]]
        late = x[:, since:]
        q, k, v = late @ p["query"], x @ p["key"], x @ p["value"]
        weight = (q / np.float32(np.sqrt(x.shape[2]))) @ k.transpose(0, 2, 1)
        np.clip(weight, -LIMIT, LIMIT, out=weight)  # keeps the exponentials finite without a maximum for each row
        np.exp(weight, out=weight)
        weight *= _mask(inputs.shape[1])[since:]
        weight /= weight.sum(2, keepdims=True)
        mixed = weight @ v
        return x, q, k, v, weight, mixed, late + mixed @ p["mix"]

    def _windows(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(sequence, first place)`` of every window of sequences of these lengths."""
        count = 1 + np.maximum(0, -(-(lengths - 2 * self.half) // self.half))
        of = np.repeat(np.arange(len(lengths)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return of, nth * self.half

    def _by_level(self, chosen: np.ndarray, out: np.ndarray, target: np.ndarray):
        """For each level that ``target`` reaches: logits, the outcome wanted and the rows that reach it."""
        level, rows = level_of(target, self.classes), np.arange(len(target))
        for nth in range(levels(self.classes)):
            if nth:
                rows = rows[level[rows] >= nth]
                if not len(rows):
                    return
            here = chosen if len(rows) == len(chosen) else chosen[rows]
            wanted = np.where(level[rows] == nth, target[rows] + nth * (1 - WIDTH), WIDTH - 1)
            yield here @ out[:, nth * WIDTH:(nth + 1) * WIDTH], wanted, rows

    def log10_scores(self, sequences: list[np.ndarray], chunk: int = 64) -> np.ndarray:
        """log10 probability of each sequence of ids, each id given those before it."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        flat = np.full(int((lengths + 1).sum()) + 2 * self.half, self.classes, np.int64)
        for at, own in zip(begin.tolist(), sequences):
            flat[at + 1:at + 1 + len(own)] = own
        of, first = self._windows(lengths)
        out = np.concatenate((self.params["out"], self.params["out_bias"][None]))  # the bias as one more row
        most = np.abs(self.params["out"]).sum(0).max() + 1e-6  # no logit exceeds this many times a hidden value
        bound = np.float32(max(float(LIMIT) - float(np.abs(self.params["out_bias"]).max()), 1.0) / most)
        places, total = np.arange(2 * self.half), np.zeros(len(sequences))
        for since, windows in ((0, np.flatnonzero(first == 0)), (self.half, np.flatnonzero(first))):
            for k in range(0, len(windows), chunk):
                own, start = of[windows[k:k + chunk]], first[windows[k:k + chunk]]
                where = (begin[own] + start)[:, None] + places
                hidden = np.clip(self._forward(flat[where], since)[-1], -bound, bound)
                scored = start[:, None] + places[since:] < lengths[own][:, None]
                chosen = hidden[scored]
                chosen = np.concatenate((chosen, np.ones((len(chosen), 1), np.float32)), 1)
                of_value = np.broadcast_to(own[:, None], scored.shape)[scored]
                for logits, target, rows in self._by_level(chosen, out, flat[where[:, since:] + 1][scored]):
                    picked = logits[np.arange(len(target)), target]
                    np.exp(logits, out=logits)
                    total += np.bincount(of_value[rows], picked - np.log(logits.sum(1)), len(sequences))
        return total / np.log(10)


_masks: dict[int, np.ndarray] = {}


def _mask(n: int) -> np.ndarray:
    if n not in _masks:
        _masks[n] = np.tril(np.ones((n, n), np.float32))
    return _masks[n]


def fresh(classes: int, half: int = 16, dim: int = 16, seed: int = 5) -> AttentionModel:
    """A model at even odds with seeded weights."""
    rng = np.random.default_rng(seed)

    def start(*shape, scale=0.1):
        return (rng.normal(0, scale, shape)).astype(np.float32)

    return AttentionModel({
        "id": start(classes + 1, dim), "place": start(2 * half, dim, scale=0.02), "query": start(dim, dim, scale=0.2),
        "key": start(dim, dim, scale=0.2), "value": start(dim, dim, scale=0.2), "mix": start(dim, dim, scale=0.2),
        "out": np.zeros((dim, classes + levels(classes) - 1), np.float32), "out_bias": np.zeros(classes + levels(classes) - 1, np.float32)}, half)


def start_odds(model: AttentionModel, counts: np.ndarray) -> None:
    """Lets the model begin at the odds of ids that occurred so often."""
    level, more = level_of(np.arange(len(counts)), len(counts)), counts + 1.0
    for nth in range(levels(len(counts))):
        odds = more[level == nth]
        if nth < level[-1]:
            odds = np.append(odds, more[level > nth].sum())
        model.params["out_bias"][nth * WIDTH:(nth + 1) * WIDTH] += np.log(odds / odds.sum()).astype(np.float32)


class Adam:
    """Steps on batches of windows; its state is a few arrays, so states that tasks reached from one start can be averaged."""

    def __init__(self, model: AttentionModel):
        self.model, self.step = model, 0
        self.one, self.two = ({k: np.zeros_like(v) for k, v in model.params.items()} for _ in range(2))

    def state(self) -> np.ndarray:
        return np.concatenate([a.ravel() for part in (self.model.params, self.one, self.two) for a in part.values()]).astype(np.float64)

    def become(self, state: np.ndarray, step: int) -> None:
        self.step, at = step, 0
        for part in (self.model.params, self.one, self.two):
            for name, a in part.items():
                part[name] = state[at:at + a.size].reshape(a.shape).astype(np.float32)
                at += a.size

    def descend(self, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, rate: float) -> None:
        """One step on windows ``(batch, places)``; only ``real`` places count."""
        model, p = self.model, self.model.params
        classes, dim = model.classes, p["id"].shape[1]
        x, q, k, v, weight, mixed, hidden = model._forward(inputs)
        chosen = hidden[real]
        g = {"out": np.zeros_like(p["out"]), "out_bias": np.zeros_like(p["out_bias"])}
        d_chosen = np.zeros_like(chosen)
        for nth, (logits, target, rows_of) in enumerate(model._by_level(chosen, p["out"], targets[real])):
            at = slice(nth * WIDTH, (nth + 1) * WIDTH)
            logits += p["out_bias"][at]
            np.clip(logits, -LIMIT, LIMIT, out=logits)
            np.exp(logits, out=logits)
            logits /= (logits @ np.full(logits.shape[1], len(chosen), np.float32))[:, None]  # of a mean over places
            logits[np.arange(len(logits)), target] -= np.float32(1 / len(chosen))
            g["out"][:, at], g["out_bias"][at] = (chosen[rows_of] if nth else chosen).T @ logits, logits.sum(0)
            d_chosen[rows_of] += logits @ p["out"][:, at].T
        d_hidden = np.zeros_like(hidden)
        d_hidden[real] = d_chosen
        rows = lambda a: a.reshape(-1, a.shape[-1])
        g["mix"] = rows(mixed).T @ rows(d_hidden)
        d_mixed = d_hidden @ p["mix"].T
        d_weight = d_mixed @ v.transpose(0, 2, 1)
        d_v = weight.transpose(0, 2, 1) @ d_mixed
        d_score = d_weight * weight
        d_score -= weight * d_score.sum(2, keepdims=True)
        d_score /= np.float32(np.sqrt(dim))
        d_q, d_k = d_score @ k, d_score.transpose(0, 2, 1) @ q
        d_x = d_hidden + d_q @ p["query"].T + d_k @ p["key"].T + d_v @ p["value"].T
        g["query"], g["key"], g["value"] = (rows(x).T @ rows(d) for d in (d_q, d_k, d_v))
        g["place"] = np.zeros_like(p["place"])
        g["place"][:inputs.shape[1]] = d_x.sum(0)
        g["id"] = np.stack([np.bincount(inputs.ravel(), rows(d_x)[:, c], classes + 1) for c in range(dim)], 1).astype(np.float32)
        self.step += 1
        one, two = self.one, self.two
        for name, grad in g.items():
            one[name] = 0.9 * one[name] + 0.1 * grad
            two[name] = 0.99 * two[name] + 0.01 * grad * grad
            p[name] -= (rate * (one[name] / (1 - 0.9 ** self.step)) / (np.sqrt(two[name] / (1 - 0.99 ** self.step)) + 1e-8)).astype(np.float32)


def laid_out(sequences: list[np.ndarray], classes: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sequences in one array, each behind a start id; where each begins; their lengths."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    flat = np.full(int((lengths + 1).sum()) + 2 * half, classes, np.int64)
    for at, own in zip(begin.tolist(), sequences):
        flat[at + 1:at + 1 + len(own)] = own
    return flat, begin, lengths


def pass_over(adam: Adam, sequences: list[np.ndarray], rates: np.ndarray, rng: np.random.Generator, batch: int = 64) -> None:
    """One step for each batch of windows that lie end to end, so that every id is a target once; ``rates`` holds the first and last rate."""
    width, classes = 2 * adam.model.half, adam.model.classes
    flat, begin, lengths = laid_out(sequences, classes, adam.model.half)
    count = -(-lengths // width)
    of = np.repeat(np.arange(len(lengths)), count)
    first = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * width
    order, places = rng.permutation(len(of)), np.arange(width)
    for k in range(0, len(order), batch):
        pick = order[k:k + batch]
        where = (begin[of[pick]] + first[pick])[:, None] + places
        real = first[pick][:, None] + places < lengths[of[pick]][:, None]
        adam.descend(flat[where], flat[where + 1], real, float(rates[0] + (rates[1] - rates[0]) * k / len(order)))


def train(sequences: list[np.ndarray], classes: int, half: int = 16, dim: int = 16, steps: int = 1500, batch: int = 64,
          rate: float = 0.01, seed: int = 5) -> AttentionModel:
    """Adam on random windows; with no sequence, the model stays at even odds."""
    model = fresh(classes, half, dim, seed)
    if not len(sequences):
        return model
    flat, begin, lengths = laid_out(sequences, classes, half)
    of, first = model._windows(lengths)
    start_odds(model, np.bincount(flat[flat < classes], minlength=classes))
    adam, places, rng = Adam(model), np.arange(2 * half), np.random.default_rng(seed + 1)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(of), batch)
        where = (begin[of[pick]] + first[pick])[:, None] + places
        real = first[pick][:, None] + places < lengths[of[pick]][:, None]
        adam.descend(flat[where], flat[where + 1], real, rate * min(1.0, 2 * (1 - step / (steps + 1))))
    return model
