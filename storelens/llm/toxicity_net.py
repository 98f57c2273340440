"""Bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of two learned vectors: one for its hashed spelling and the
mean of those of its character 3- to 5-grams.  A window of words runs through a
gated recurrent layer in both directions; attention pools its states into one
logit; a text's logit is the smooth maximum over all its overlapping windows.
"""

from __future__ import annotations

import numpy as np

from storelens.llm.wordhash import U64, blocks, mix, word_hashes

DIM, HIDDEN, ATTENTION = 16, 8, 8
WINDOW, STRIDE = 32, 24
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 15
SHARPNESS = 3.0
#: words whose grams' vectors are gathered at once
WORDS_AT_ONCE = 1 << 11
#: texts of the sample that a word or gram must occur in to have a vector
MIN_TEXTS = 5

_PUNCTUATION = bytes.maketrans(bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F)),
                               b" " * (15 + 7 + 6 + 4))


def words_of(text: str | None) -> bytes:
    """Lower-cased text with ASCII punctuation blanked out."""
    return (text or "").lower().encode().translate(_PUNCTUATION)


def _sums(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``rows`` by ascending ``owner``."""
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    if len(owner):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first]] = np.add.reduceat(rows, first, axis=0)
    return out


class Batch:
    """Distinct words, their character grams, and the windows of some texts."""

    def __init__(self, texts: list[bytes]):
        hashes, owner, start, length = word_hashes(texts)
        raw = b"\n".join(texts)
        known, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.row = (known % U64(WORD_ROWS)).astype(np.int64)
        spelt = b" " + b" ".join([raw[a:a + n] for a, n in zip(start[first].tolist(), length[first].tolist())]) + b" "
        data = np.frombuffer(spelt, dtype=np.uint8)
        blank = data == 0x20
        index = np.cumsum(blank) - 1
        rows, owners = [], []
        for n in (3, 4, 5):
            m = len(data) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint64)
            inner = np.ones(m, dtype=bool)
            for k in range(n):
                h = h * U64(0x100000001B3) + data[k:k + m]
                if 0 < k < n - 1:
                    inner &= ~blank[k:k + m]
            rows.append((mix(h[inner]) % U64(GRAM_ROWS)).astype(np.int64))
            owners.append(index[1:1 + m][inner])
        grams = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        whose = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(whose, kind="stable")
        self.gram, self.whose = grams[order], whose[order]
        self.n_grams = np.maximum(np.bincount(self.whose, minlength=len(known)), 1).astype(np.float32)
        # windows: every STRIDE words, the last one reaching the text's end
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        n_words = np.diff(cut)
        n_windows = np.maximum(0, -(-(n_words - WINDOW) // STRIDE)) + 1
        self.doc = np.repeat(np.arange(len(texts)), n_windows)
        self.first = np.r_[0, np.cumsum(n_windows)][:-1]
        k = np.arange(len(self.doc)) - self.first[self.doc]
        at = (cut[self.doc] + k * STRIDE)[:, None] + np.arange(WINDOW)
        self.mask = at < cut[self.doc + 1][:, None]
        self.at = np.where(self.mask, self.word[np.minimum(at, max(len(self.word) - 1, 0))] if len(self.word) else 0, 0)


def whole_passes(target: np.ndarray, seed: int = 3) -> dict:
    """For each class an endless run through its rows, every row once a pass, in an order drawn anew for each."""

    def run(rows, r):
        while True:
            yield from r.permutation(rows).tolist()

    return {y: run(np.flatnonzero(target == y), np.random.default_rng([seed, int(y)])) for y in np.unique(target)}


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class ToxicityNet:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *shape, s=0.1: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {"word": f(WORD_ROWS, DIM, s=0.05), "gram": f(GRAM_ROWS, DIM, s=0.15),
                  "v": f(ATTENTION, s=0.3), "a": f(2 * HIDDEN, ATTENTION, s=0.3), "ab": np.zeros(ATTENTION, np.float32),
                  "u": f(2 * HIDDEN, s=0.3), "c": np.full(1, -1.0, np.float32)}
        for d in "fb":
            self.p |= {"x" + d: f(DIM, 3 * HIDDEN, s=0.4), "xb" + d: np.zeros(3 * HIDDEN, np.float32), "h" + d: f(HIDDEN, 3 * HIDDEN, s=0.3)}
        self.used = {name: np.ones(len(self.p[name]), dtype=bool) for name in ("word", "gram")}
        self.scale, self.shift = 1.0, 0.0  # of the calibrated logit

    # -- forward
    def _inputs(self, b: Batch) -> np.ndarray:
        chars = np.zeros((len(b.row), DIM), np.float32)
        for a in range(0, len(b.row), WORDS_AT_ONCE):  # a vector per gram is the largest table of all
            z = min(a + WORDS_AT_ONCE, len(b.row))
            lo, hi = np.searchsorted(b.whose, (a, z))
            chars[a:z] = _sums(self.p["gram"][b.gram[lo:hi]], b.whose[lo:hi] - a, z - a) / b.n_grams[a:z, None]
        return self.p["word"][b.row] + chars

    def _run(self, d: str, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool):
        h = np.zeros((len(at), HIDDEN), np.float32)
        states = np.zeros((len(at), WINDOW, HIDDEN), np.float32)
        saved = []
        proj = x @ self.p["x" + d] + self.p["xb" + d] if len(x) else np.zeros((1, 3 * HIDDEN), np.float32)
        u = self.p["h" + d]
        for t in (range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)):
            g, on = proj[at[:, t]], mask[:, t, None]
            hu = h @ u
            zr = _sigmoid(g[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
            if keep:
                saved.append((t, h, z, r, n, hu[:, 2 * HIDDEN:], on))
            h = np.where(on, n + z * (h - n), h)
            states[:, t] = h
        return states, saved

    def _windows(self, b: Batch, rows: slice, x: np.ndarray, keep: bool = False):
        at, mask = b.at[rows], b.mask[rows]
        f, sf = self._run("f", x, at, mask, keep)
        w, sb = self._run("b", x, at, mask, keep)
        h = np.concatenate([f, w], axis=2)
        k = np.tanh(h @ self.p["a"] + self.p["ab"])
        s = np.where(mask, k @ self.p["v"], -30.0)
        e = np.exp(s - s.max(axis=1, keepdims=True)) * mask
        att = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,bth->bh", att, h)
        return pooled @ self.p["u"] + self.p["c"][0], (h, k, att, pooled, sf, sb)

    def logits(self, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
        """Uncalibrated logit of each text, from all its windows."""
        out = np.zeros(len(texts), dtype=np.float64)
        for lo, hi in blocks(texts, block):
            b = Batch(texts[lo:hi])
            x = self._inputs(b)
            each = np.concatenate([self._windows(b, slice(a, a + 2048), x)[0] for a in range(0, len(b.doc), 2048)])
            out[lo:hi] = self._pool(b, each)[0]
        return out

    @staticmethod
    def _pool(b: Batch, each: np.ndarray):
        top = np.maximum.reduceat(each, b.first)
        e = np.exp(SHARPNESS * (each - top[b.doc]))
        total = np.add.reduceat(e, b.first)
        return top + np.log(total) / SHARPNESS, e / total[b.doc]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(np.clip(self.scale * self.logits(texts) + self.shift, -30, 30))

    # -- training
    def _gradients(self, texts: list[bytes], target: np.ndarray) -> dict:
        b = Batch(texts)
        x = self._inputs(b)
        p, g = self.p, {}
        each, (h, k, att, pooled, sf, sb) = self._windows(b, slice(None), x, keep=True)
        doc, share = self._pool(b, each)
        d_each = ((_sigmoid(doc) - target) / len(texts))[b.doc] * share
        d_each = d_each.astype(np.float32)
        g["c"] = d_each.sum(keepdims=True)
        g["u"] = pooled.T @ d_each
        d_pooled = d_each[:, None] * p["u"]
        d_att = np.einsum("bth,bh->bt", h, d_pooled)
        d_s = att * (d_att - (att * d_att).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("bta,bt->a", k, d_s)
        d_k = d_s[:, :, None] * p["v"] * (1 - k * k)
        g["a"] = np.einsum("bth,bta->ha", h, d_k)
        g["ab"] = d_k.sum(axis=(0, 1))
        d_h = att[:, :, None] * d_pooled[:, None, :] + d_k @ p["a"].T
        d_x = np.zeros_like(x)
        for d, saved, d_states in (("f", sf, d_h[:, :, :HIDDEN]), ("b", sb, d_h[:, :, HIDDEN:])):
            u = p["h" + d]
            d_proj = np.zeros((len(b.at), WINDOW, 3 * HIDDEN), np.float32)
            d_u = np.zeros_like(u)
            carry = np.zeros((len(b.at), HIDDEN), np.float32)
            for t, before, z, r, n, hn, on in reversed(saved):
                total = carry + d_states[:, t]
                own = np.where(on, total, 0)
                d_n = own * (1 - z) * (1 - n * n)
                d_z = own * (before - n) * z * (1 - z)
                d_r = d_n * hn * r * (1 - r)
                d_proj[:, t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_u += before.T @ d_hu
                carry = np.where(on, own * z, total) + d_hu @ u.T
            g["h" + d] = d_u
            flat, at = d_proj.reshape(-1, 3 * HIDDEN), b.at.reshape(-1)
            live = b.mask.reshape(-1)
            flat, at = flat[live], at[live]
            order = np.argsort(at, kind="stable")
            by_word = _sums(flat[order], at[order], len(x))
            g["x" + d] = x.T @ by_word
            g["xb" + d] = by_word.sum(axis=0)
            d_x += by_word @ p["x" + d].T
        for name, rows, grads in (("word", b.row, d_x), ("gram", b.gram, (d_x / b.n_grams[:, None])[b.whose])):
            order = np.argsort(rows, kind="stable")
            found, first = np.unique(rows[order], return_index=True)
            total = np.add.reduceat(grads[order], first, axis=0) if len(first) else grads[:0]
            g[name] = (found[self.used[name][found]], total[self.used[name][found]])
        return g

    def prime(self, texts: list[bytes], target: np.ndarray) -> "ToxicityNet":
        """Start the first input dimension from how much oftener than by chance a
        word or gram occurs in texts of class 1 (a count per text, as a z-score).

        Words and grams of fewer than ``MIN_TEXTS`` texts get no vector, so that
        a small sample can't be learned by heart from its rare words."""
        share = float(np.mean(target)) if len(target) else 0.0
        seen = {name: np.zeros((2, len(self.p[name]))) for name in ("word", "gram")}
        for lo, hi in blocks(texts, 1 << 16):
            for i in range(lo, hi):
                b = Batch(texts[i:i + 1])
                for name, rows in (("word", b.row), ("gram", b.gram)):
                    seen[name][int(target[i]), np.unique(rows)] += 1
        for name, (zero, one) in seen.items():
            due = (zero + one) * share
            z = (one - due) / np.sqrt(due * (1 - share) + 1)
            self.p[name][:, 0] = np.clip(z / 3, -1, 3)
            self.used[name] = zero + one >= MIN_TEXTS
            self.p[name][~self.used[name]] = 0
        return self

    def fit(self, texts: list[bytes], target: np.ndarray, updates: int = 500, batch: int = 48, rate: float = 0.01,
            turns: dict | None = None) -> "ToxicityNet":
        """Adam on batches with as many texts of either class (where both occur), in whole passes over each."""
        turns = whole_passes(target) if turns is None else turns
        if not turns:
            return self
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, updates + 1):
            pick = np.array([next(run) for run in turns.values() for _ in range(batch // len(turns))])
            now = rate * min(1.0, 2 * (1 - step / (updates + 1)))
            for k, g in self._gradients([texts[i] for i in pick], target[pick]).items():
                rows, g = g if isinstance(g, tuple) else (slice(None), g)
                m[k][rows] = 0.9 * m[k][rows] + 0.1 * g
                s[k][rows] = 0.99 * s[k][rows] + 0.01 * g * g
                self.p[k][rows] -= now * (m[k][rows] / (1 - 0.9 ** step)) / (np.sqrt(s[k][rows] / (1 - 0.99 ** step)) + 1e-6)
        return self

    def calibrate(self, logits: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 50) -> "ToxicityNet":
        """Scale and shift of the logit by weighted logistic regression.

        Targets are drawn slightly towards each other and the scale towards 1, so a
        sample that the logit separates without error still has a finite answer.
        """
        n = np.array([weight[target == 0].sum(), weight[target == 1].sum()])
        if not n.all():
            return self
        soft = np.where(target == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
        x = np.stack([logits, np.ones_like(logits)], axis=1)
        w, centre, ridge = np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array([4.0, 0.04])
        cost = lambda w: (weight * (np.logaddexp(0, x @ w) - soft * (x @ w))).sum() + (ridge * (w - centre) ** 2).sum() / 2
        for _ in range(steps):
            q = _sigmoid(np.clip(x @ w, -30, 30))
            grad = x.T @ (weight * (q - soft)) + ridge * (w - centre)
            step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(ridge), grad)
            while cost(w - step) > cost(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            w = w - step
        self.scale, self.shift = float(max(w[0], 1e-3)), float(w[1])
        return self
