"""A bidirectional LSTM over characters with a conditional random field on top, in numpy.

A character's row of a table is its input to all gates, so no product is needed
for it.  Windows of one batch are padded to one length; a padded place leaves the
state at zero, so a window's scores don't depend on what it shares a batch with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Characters with a row of their own are ASCII; then letters, digits, white space, all others, and the padding.
LETTER, DIGIT, SPACE, OTHER, PAD = range(128, 133)
HIDDEN, SEED, RATE, BATCH, EPOCHS, CLIP = 24, 7, 0.02, 16, 3, 5.0
NEVER = -1e4


def classes(text: str) -> np.ndarray:
    """The row of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    for i in np.flatnonzero(codes >= 128).tolist():
        c = text[i]
        codes[i] = LETTER if c.isalpha() else DIGIT if c.isdigit() else SPACE if c.isspace() else OTHER
    return codes


def padded(rows: list[np.ndarray], fill: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """Rows in one matrix, and their lengths."""
    lengths = np.array([len(r) for r in rows])
    out = np.full((len(rows), max(1, int(lengths.max()))), fill, dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


@dataclass
class Tagger:
    """Weights by name; tag 0 is "outside", tags 2k+1 and 2k+2 begin and go on in kind k."""

    kinds: tuple[str, ...]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, kinds: tuple[str, ...], hidden: int = HIDDEN, seed: int = SEED, dtype=np.float32) -> Tagger:
        rng, k = np.random.default_rng(seed), 2 * len(kinds) + 1
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(dtype)
        w = {}
        for d in "fb":
            w[f"in_{d}"] = draw(PAD + 1, 4 * hidden, scale=0.3)
            w[f"in_{d}"][:, hidden : 2 * hidden] += 1  # at first nothing is forgotten
            w[f"on_{d}"] = draw(hidden, 4 * hidden, scale=hidden**-0.5)
            w[f"out_{d}"] = draw(hidden, k, scale=0.3)
        w["bias"], w["move"], w["start"] = np.zeros(k, dtype), np.zeros((k, k), dtype), np.zeros(k, dtype)
        return cls(kinds, w)

    @property
    def n_tags(self) -> int:
        return 2 * len(self.kinds) + 1

    def moves(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of tag after tag and of the first tag; none goes on in a kind that it isn't in."""
        move, start = self.weights["move"].copy(), self.weights["start"].copy()
        for tag in range(2, self.n_tags, 2):
            before = np.ones(self.n_tags, dtype=bool)
            before[[tag - 1, tag]] = False
            move[before, tag] = start[tag] = NEVER
        return move, start

    # ------------------------------------------------------------ network
    def _run(self, x: np.ndarray, alive: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        table, on = self.weights[f"in_{d}"], self.weights[f"on_{d}"]
        (n, t_max), h_size = x.shape, on.shape[0]
        h, c = np.zeros((n, h_size), on.dtype), np.zeros((n, h_size), on.dtype)
        out = np.empty((n, t_max, h_size), on.dtype)
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            z = table[x[:, t]]
            z += h @ on
            z[:, : 3 * h_size] *= 0.5
            np.tanh(z, out=z)
            z[:, : 3 * h_size] *= 0.5
            z[:, : 3 * h_size] += 0.5
            i, f, o, g = (z[:, k * h_size : (k + 1) * h_size] for k in range(4))
            live = alive[:, t, None]
            before = (h, c)
            c = (f * c + i * g) * live
            top = np.tanh(c)
            h = o * top * live
            out[:, t] = h
            if keep is not None:
                keep.append((t, z, top, *before))
        return out

    def scores(self, x: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of each tag at each place."""
        alive = (np.arange(x.shape[1]) < lengths[:, None]).astype(self.weights["bias"].dtype)
        out = self.weights["bias"]
        for d in "fb":
            steps = None if keep is None else []
            states = self._run(x, alive, d, steps)
            out = out + states @ self.weights[f"out_{d}"]
            if keep is not None:
                keep[d] = (states, steps)
        return out

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probabilities of the tags, expected moves, and the sum of the logs of the partition functions."""
        n, t_max, k = scores.shape
        move, start = self.moves()
        top = scores.max(axis=2, keepdims=True)
        e, m = np.exp(scores - top), np.exp(move)
        alive = np.arange(t_max) < lengths[:, None]
        alpha, scale = np.empty_like(e), np.ones((n, t_max), e.dtype)
        a = np.exp(start) * e[:, 0]
        for t in range(t_max):
            if t:
                a = np.where(alive[:, t, None], (a @ m) * e[:, t], a)
            s = a.sum(axis=1)
            scale[:, t] = np.where(alive[:, t], s, 1)
            a = a / s[:, None]
            alpha[:, t] = a
        beta = np.ones_like(e)
        b, pairs = np.ones((n, k), e.dtype), np.zeros((k, k), e.dtype)
        for t in range(t_max - 1, 0, -1):
            live = alive[:, t, None]
            inner = e[:, t] * b / scale[:, t, None]
            pairs += np.where(live, alpha[:, t - 1], 0).T @ inner * m
            b = np.where(live, inner @ m.T, b)
            beta[:, t - 1] = b
        gamma = alpha * beta * alive[:, :, None]
        gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-30)
        return gamma, pairs, float((np.log(scale) + top[:, :, 0] * alive).sum())

    def best(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most probable tags of each window."""
        n, t_max, k = scores.shape
        move, start = self.moves()
        back = np.zeros((n, t_max, k), dtype=np.int8)
        v = start + scores[:, 0]
        for t in range(1, t_max):
            x = v[:, :, None] + move
            back[:, t] = x.argmax(axis=1)
            v = np.where((t < lengths)[:, None], x.max(axis=1) + scores[:, t], v)
        tags, at = np.zeros((n, t_max), dtype=np.int8), v.argmax(axis=1)
        for t in range(t_max - 1, -1, -1):
            inside = t < lengths
            tags[inside, t] = at[inside]
            if t:
                at = np.where(inside, back[np.arange(n), t, at], at)
        return tags

    # ------------------------------------------------------------ training
    def gradients(self, x: np.ndarray, gold: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss a window, and the gradients of all weights."""
        keep: dict = {}
        scores = self.scores(x, lengths, keep)
        gamma, pairs, log_z = self.marginals(scores, lengths)
        n, t_max, k = scores.shape
        alive = np.arange(t_max) < lengths[:, None]
        hot = np.eye(k, dtype=scores.dtype)[gold] * alive[:, :, None]
        move, start = self.moves()
        seen = np.zeros((k, k), scores.dtype)
        np.add.at(seen, (gold[:, :-1][alive[:, 1:]], gold[:, 1:][alive[:, 1:]]), 1)
        loss = log_z - float((scores * hot).sum() + (move * seen).sum() + start[gold[:, 0]].sum())
        d_scores = (gamma - hot) / n
        out = {
            "bias": d_scores.sum(axis=(0, 1)),
            "move": np.where(move <= NEVER, 0, (pairs - seen) / n),
            "start": np.where(start <= NEVER, 0, (gamma[:, 0] - hot[:, 0]).sum(axis=0) / n),
        }
        rows = np.eye(PAD + 1, dtype=scores.dtype)[x.reshape(-1)].T
        for d in "fb":
            states, steps = keep[d]
            w_out, on = self.weights[f"out_{d}"], self.weights[f"on_{d}"]
            h_size = on.shape[0]
            out[f"out_{d}"] = states.reshape(-1, h_size).T @ d_scores.reshape(-1, k)
            d_states = d_scores @ w_out.T
            d_z, d_on = np.zeros((n, t_max, 4 * h_size), scores.dtype), np.zeros_like(on)
            d_h, d_c = np.zeros((n, h_size), scores.dtype), np.zeros((n, h_size), scores.dtype)
            for t, z, top, h_before, c_before in reversed(steps):
                i, f, o, g = (z[:, q * h_size : (q + 1) * h_size] for q in range(4))
                live = alive[:, t, None]
                d_h = (d_h + d_states[:, t]) * live
                d_c = (d_c + d_h * o * (1 - top * top)) * live
                gate = d_z[:, t]
                gate[:, :h_size] = d_c * g * i * (1 - i)
                gate[:, h_size : 2 * h_size] = d_c * c_before * f * (1 - f)
                gate[:, 2 * h_size : 3 * h_size] = d_h * top * o * (1 - o)
                gate[:, 3 * h_size :] = d_c * i * (1 - g * g)
                d_on += h_before.T @ gate
                d_h, d_c = gate @ on.T, d_c * f
            out[f"on_{d}"], out[f"in_{d}"] = d_on, rows @ d_z.reshape(-1, 4 * h_size)
        return loss / n, out


def batches(examples: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator, size: int = BATCH) -> Iterator[list]:
    """All examples once; those of a batch have about one length."""
    order = sorted(rng.permutation(len(examples)).tolist(), key=lambda i: len(examples[i][0]) // 16)
    groups = [order[at : at + size] for at in range(0, len(order), size)]
    for g in rng.permutation(len(groups)).tolist():
        yield [examples[i] for i in groups[g]]


def train(examples: list[tuple[np.ndarray, np.ndarray]], kinds: tuple[str, ...], epochs: int | None = None, hidden: int = HIDDEN) -> Tagger:
    """A model of (classes, tags) of windows, by Adam with a falling rate."""
    epochs = epochs or EPOCHS
    tagger, rng = Tagger.fresh(kinds, hidden), np.random.default_rng(SEED)
    first = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    second = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    step, steps = 0, epochs * -(-len(examples) // BATCH)
    for _ in range(epochs):
        for part in batches(examples, rng):
            x, lengths = padded([a for a, _ in part])
            gold, _ = padded([b for _, b in part], 0)
            _, grads = tagger.gradients(x, gold, lengths)
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
            rate, step = RATE * (1 - step / steps), step + 1
            for k, g in grads.items():
                g = g * min(1.0, CLIP / max(norm, 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                tagger.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tagger
