"""A gated-attention multiple-instance model, trained with numpy on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


class AttentionMIL:
    """score = sigmoid(w . sum_i a_i h_i + b); h_i = tanh(E x_i); a = softmax over a bag of u . (tanh(V h_i) * sigmoid(G h_i))."""

    def __init__(self, features: int, hidden: int = 32, gate: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        make = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {"E": make(features, hidden), "V": make(hidden, gate), "G": make(hidden, gate), "u": make(gate, 1), "w": make(hidden, 1), "b": np.zeros((1, 1), np.float32), "e": np.zeros((1, hidden), np.float32)}

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x.astype(self.w["E"].dtype, copy=False) @ self.w["E"] + self.w["e"])

    def forward(self, x: np.ndarray | list[np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of bags that follow one another, in one array or in several; starts: the first passage of each bag,
        none empty."""
        return self.attend(np.concatenate([self.hidden(part) for part in x]) if isinstance(x, list) else self.hidden(x), starts)

    def attend(self, h: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        t, s = np.tanh(h @ w["V"]), sigmoid(h @ w["G"])
        e = ((t * s) @ w["u"])[:, 0]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "bag": bag, "z": z, "p": sigmoid(z @ w["w"] + w["b"])[:, 0]}

    def gradients(self, x: np.ndarray | list[np.ndarray], starts: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, starts)
        d = ((f["p"] - y) / len(y))[:, None].astype(np.float32)
        dz = d @ w["w"].T
        dza = dz[f["bag"]]
        da = (dza * f["h"]).sum(1)
        de = (f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]]))[:, None]
        dts = de @ w["u"].T
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dza + dt @ w["V"].T + ds @ w["G"].T) * (1 - f["h"] ** 2)
        g = {"w": f["z"].T @ d, "b": d.sum(keepdims=True), "u": (f["t"] * f["s"]).T @ de, "V": f["h"].T @ dt, "G": f["h"].T @ ds, "E": self._into(x, dh), "e": dh.sum(0, keepdims=True)}
        return {k: v + decay * w[k] for k, v in g.items()}

    @staticmethod
    def _into(x: np.ndarray | list[np.ndarray], dh: np.ndarray) -> np.ndarray:
        if not isinstance(x, list):
            return x.T @ dh
        ends = np.cumsum([0, *map(len, x)])
        return sum(part.astype(dh.dtype, copy=False).T @ dh[a:b] for part, a, b in zip(x, ends, ends[1:], strict=False))

    def steps(self, bags: list[list[np.ndarray]], labels: np.ndarray, opt: Adam, r: np.random.Generator, passes: int = 1, batch: int = 16, decay: float = 1e-4) -> None:
        """So many passes over bags (each in one array of passages or several), in an order drawn from r."""
        for _ in range(passes):
            order = r.permutation(len(bags))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                starts = np.cumsum([0, *(sum(map(len, bags[j])) for j in own[:-1])])
                opt.step(self.gradients([part for j in own for part in bags[j]], starts, labels[own], decay))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    def put(self, flat: np.ndarray) -> AttentionMIL:
        at = 0
        for k in sorted(self.w):
            self.w[k] = flat[at : at + self.w[k].size].reshape(self.w[k].shape).astype(self.w[k].dtype)
            at += self.w[k].size
        return self
