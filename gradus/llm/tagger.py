"""A character tagger in numpy: a bidirectional LSTM whose emissions feed a linear-chain CRF, trained from labelled spans."""

from __future__ import annotations

import numpy as np

# Classes of characters: each ASCII letter and mark for itself, all digits as one, controls as one, the rest as two.
_shown = [*range(0x20, 0x30), *range(0x3A, 0x7F)]
N_CLASSES = len(_shown) + 5
DIGIT, BREAK, CONTROL, SIGN, LETTER = range(len(_shown), N_CLASSES)
CLASS = np.full(0x102, CONTROL, np.uint8)
CLASS[_shown] = range(len(_shown))
CLASS[0x30:0x3A], CLASS[[0x0A, 0x0D]], CLASS[0x100], CLASS[0x101] = DIGIT, BREAK, SIGN, LETTER
OUT, BEGIN = 0, 1  # tags; inside a span of kind k is 2 + k
NEVER = -1e4


def classes(text: str) -> np.ndarray:
    """A class for every code point."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return CLASS[np.where(code < 0x80, code, 0x100 + (code >= 0xC0))]


class Tagger:
    """States of both directions give emissions of each tag; allowed steps between tags have a weight each.

    A span is BEGIN and then one inside tag or more of its kind; a window may begin within a span. emissions() runs many
    windows side by side, viterbi() decodes those for which best_is_out() can't prove that no span is best.
    """

    def __init__(self, kinds: int, hidden: int = 16, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.k, self.h = kinds + 2, hidden
        made = lambda *s: rng.normal(0, 0.2, s).astype(np.float32)
        self.w = {"o": np.zeros(self.k, np.float32), "a": np.zeros((self.k, self.k), np.float32)}
        for d in "fb":
            # rows of x are the inputs' own part of the four gates (a bias included), those of h the state's
            self.w |= {"x" + d: made(N_CLASSES, 4 * hidden), "h" + d: made(hidden, 4 * hidden), "e" + d: made(hidden, self.k)}
            self.w["x" + d][:, hidden : 2 * hidden] += 1
        allowed = np.zeros((self.k, self.k), bool)
        allowed[OUT, [OUT, BEGIN]] = allowed[BEGIN, 2:] = allowed[2:, OUT] = allowed[2:, BEGIN] = True
        allowed[range(2, self.k), range(2, self.k)] = True
        self.forbidden = np.where(allowed, 0, NEVER).astype(np.float32)

    @property
    def steps(self) -> np.ndarray:
        return self.w["a"] + self.forbidden

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(places, windows, tags) of codes (places, windows). A sigmoid is half a hyperbolic tangent, so each step has two calls."""
        t, n = codes.shape
        h4, out = self.h, np.empty((t, n, self.k), np.float32)
        out[:] = self.w["o"]
        half = np.concatenate([np.full(3 * h4, 0.5), np.ones(h4)]).astype(np.float32)
        a, part = np.empty((n, 4 * h4), np.float32), np.empty((n, self.k), np.float32)
        for d, order in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            x, w, e = self.w["x" + d] * half, self.w["h" + d] * half, self.w["e" + d]
            h, c = np.zeros((n, h4), np.float32), np.zeros((n, h4), np.float32)
            for k in order:
                np.matmul(h, w, out=a)
                a += x[codes[k]]
                np.tanh(a, out=a)
                gates = a[:, : 3 * h4]
                gates *= 0.5
                gates += 0.5
                c *= a[:, h4 : 2 * h4]
                c += a[:, :h4] * a[:, 3 * h4 :]
                h = np.tanh(c)
                h *= a[:, 2 * h4 : 3 * h4]
                out[k] += np.matmul(h, e, out=part)
        return out

    def best_is_out(self, e: np.ndarray) -> np.ndarray:
        """Windows whose best path is surely OUT throughout.

        A path leaves OUT for some places and comes back; for each such place it gains its emission over OUT's and at most
        the best step into its tag over OUT's own, and for coming back at most `back` more. If no place can gain -back, none pays.
        """
        steps, stay = self.steps, self.w["a"][OUT, OUT]
        into = np.maximum(steps.max(0)[1:] - stay, 0)  # a window's first place has no step, so none counts below 0
        back = max(0.0, float(steps[1:, OUT].max() - stay))
        return ((e[:, :, 1:] + into - e[:, :, :1]).max((0, 2)) + back) < 0

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags (places, windows)."""
        t, n, k = e.shape
        steps, best, back = self.steps, e[0], np.zeros((t, n, k), np.int8)
        for i in range(1, t):
            every = best[:, :, None] + steps
            back[i] = every.argmax(1)
            best = every.max(1) + e[i]
        tags = np.empty((t, n), np.int8)
        tags[-1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[i - 1] = back[i, np.arange(n), tags[i]]
        return tags

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean loss of the true paths a place, and its gradients. Both directions go side by side, the one back over the places reversed."""
        t, n = codes.shape
        H, kind = self.h, self.w["o"].dtype
        seen = codes, codes[::-1]
        x = np.stack([self.w["xf"][seen[0]], self.w["xb"][seen[1]]], 1)  # (places, directions, windows, gates)
        w = np.stack([self.w["hf"], self.w["hb"]])
        h, c, th = (np.zeros((t + 1, 2, n, H), kind) for _ in range(3))
        for k in range(t):
            a = x[k]
            a += np.matmul(h[k], w)
            gates = a[:, :, : 3 * H]
            np.divide(1, 1 + np.exp(-gates), out=gates)
            np.tanh(a[:, :, 3 * H :], out=a[:, :, 3 * H :])
            c[k + 1] = a[:, :, H : 2 * H] * c[k] + a[:, :, :H] * a[:, :, 3 * H :]
            np.tanh(c[k + 1], out=th[k + 1])
            np.multiply(a[:, :, 2 * H : 3 * H], th[k + 1], out=h[k + 1])
        states = h[1:, 0], h[:0:-1, 1]
        loss, de, da = self.chain(self.w["o"] + states[0] @ self.w["ef"] + states[1] @ self.w["eb"], tags)
        down = np.stack([de @ self.w["ef"].T, (de @ self.w["eb"].T)[::-1]], 1)
        # what a gate's sum changes by: the slopes of all gates at once, then each step's part from the one after it
        i, f, o, g = (x[:, :, :, k * H : (k + 1) * H] for k in range(4))
        to_c = np.concatenate([g * i * (1 - i), c[:-1] * f * (1 - f), i * (1 - g * g)], 3)
        to_h, slope, back = th[1:] * o * (1 - o), o * (1 - th[1:] ** 2), w.transpose(0, 2, 1).copy()
        z, dh, dc = np.empty_like(x), np.zeros((2, n, H), kind), np.zeros((2, n, H), kind)
        for k in range(t - 1, -1, -1):
            dh = dh + down[k]
            dn = dc + dh * slope[k]
            z[k, :, :, :H], z[k, :, :, H : 2 * H], z[k, :, :, 3 * H :] = dn * to_c[k, :, :, :H], dn * to_c[k, :, :, H : 2 * H], dn * to_c[k, :, :, 2 * H :]
            np.multiply(dh, to_h[k], out=z[k, :, :, 2 * H : 3 * H])
            dh, dc = np.matmul(z[k], back), dn * f[k]
        flat = lambda v: v.reshape(t * n, -1)
        grad = {"o": flat(de).sum(0), "a": da}
        for k, d in enumerate("fb"):
            grad["e" + d], grad["h" + d] = flat(states[k]).T @ flat(de), flat(h[:-1, k]).T @ flat(z[:, k])
            order = np.argsort(seen[k].ravel(), kind="stable")
            held, first = np.unique(seen[k].ravel()[order], return_index=True)
            grad["x" + d] = np.zeros_like(self.w["x" + d])
            grad["x" + d][held] = np.add.reduceat(flat(z[:, k])[order], first, 0)
        return loss, grad

    def chain(self, e: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss of the CRF by forward and backward sums, each place scaled to one, with gradients for emissions and steps."""
        t, n, k = e.shape
        steps, kind = self.steps.astype(np.float64), e.dtype
        e = e.astype(np.float64)
        top, most = e.max(2, keepdims=True), steps.max()
        own, a = np.exp(e - top), np.exp(steps - most)
        forward, backward, scale = np.empty((t, n, k)), np.ones((t, n, k)), np.empty((t, n, 1))
        for i in range(t):
            now = forward[i - 1] @ a * own[i] if i else own[0]
            scale[i] = now.sum(1, keepdims=True)
            forward[i] = now / scale[i]
        for i in range(t - 2, -1, -1):
            backward[i] = (own[i + 1] * backward[i + 1] / scale[i + 1]) @ a.T
        total = (np.log(scale) + top).sum() + n * (t - 1) * most
        rows, cols = np.arange(t)[:, None], np.arange(n)[None]
        true = e[rows, cols, tags].sum() + steps[tags[:-1], tags[1:]].sum()
        de = forward * backward
        pair = a * (forward[:-1].reshape(-1, k).T @ (own[1:] * backward[1:] / scale[1:]).reshape(-1, k))
        de[rows, cols, tags] -= 1
        np.subtract.at(pair, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        return float((total - true) / (t * n)), (de / (t * n)).astype(kind), (np.where(self.forbidden < 0, 0, pair) / (t * n)).astype(kind)

    def train(self, batches, rate: float = 0.02) -> Tagger:
        """Adam over (codes, tags) batches, the rate falling to a tenth."""
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        batches = list(batches)
        for step, (codes, tags) in enumerate(batches, 1):
            now = rate * (1 - 0.9 * step / len(batches))
            for k, g in self.gradients(codes, tags)[1].items():
                g = g * min(1.0, 1.0 / (1e-9 + float(np.sqrt((g * g).sum()))))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


def tag_line(length: int, spans) -> np.ndarray:
    """Tags of a text with labelled (start, end, kind) spans."""
    tags = np.zeros(length, np.int64)
    for a, b, k in spans:
        tags[a], tags[a + 1 : b] = BEGIN, 2 + k
    return tags
