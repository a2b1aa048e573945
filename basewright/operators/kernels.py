"""Recurrences of a categorical hidden Markov model over many sequences at once, scaled instead of in logarithms.

Codes count from 1. Sequences are cut into stretches that run side by side (``Stretches``); a batch of them is of
bounded size, whatever the sequences' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Numbers in the forward messages of one batch, at most.
MOST_CELLS = 1 << 20
#: Positions of a stretch.
STRETCH = 512


@dataclass
class Model:
    """a: initial probabilities [K]; A: transitions [K, K]; B: emissions [K, S]."""

    a: np.ndarray
    A: np.ndarray
    B: np.ndarray

    @classmethod
    def of(cls, a, A, B) -> Model:  # noqa: N803
        return cls(np.asarray(a, float), np.asarray(A, float).reshape(len(a), len(a)), np.asarray(B, float).reshape(len(a), -1))


def batches(sequences: list[np.ndarray], states: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes, lengths, padded codes - 1) of sequences in order of length."""
    order = np.argsort([len(s) for s in sequences], kind="stable")[::-1]
    at = 0
    while at < len(order):
        longest = max(1, len(sequences[order[at]]))
        some = order[at : at + max(1, MOST_CELLS // (longest * states))]
        lengths = np.array([len(sequences[i]) for i in some])
        codes = np.zeros((longest, len(some)), np.int64)
        for k, i in enumerate(some):
            codes[: lengths[k], k] = np.asarray(sequences[i]) - 1
        yield some, lengths, codes
        at += len(some)


def forward(m: Model, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled messages [T, O, K] and log scales [T, O] (0 beyond a sequence's end)."""
    steps, n = codes.shape
    alpha, scale = np.zeros((steps, n, len(m.a))), np.zeros((steps, n))
    emit = m.B.T
    with np.errstate(divide="ignore", invalid="ignore"):
        for t in range(steps):
            live = int((lengths > t).sum())  # lengths fall
            now = (m.a if t == 0 else alpha[t - 1, :live] @ m.A) * emit[codes[t, :live]]
            total = now.sum(1, keepdims=True)
            alpha[t, :live] = np.where(total > 0, now / total, 0)
            scale[t, :live] = np.log(total[:, 0])
    return alpha, scale


def backward(m: Model, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Messages [T, O, K], each scaled to sum to 1."""
    steps, n = codes.shape
    beta = np.zeros((steps, n, len(m.a)))
    emit = m.B.T
    beta[lengths - 1, np.arange(n)] = 1 / len(m.a)
    for t in range(steps - 2, -1, -1):
        live = int((lengths > t + 1).sum())
        now = (emit[codes[t + 1, :live]] * beta[t + 1, :live]) @ m.A.T
        total = now.sum(1, keepdims=True)
        beta[t, :live] = np.where(total > 0, now / np.where(total > 0, total, 1), 0)
    return beta


@dataclass
class Counts:
    first: np.ndarray
    moves: np.ndarray
    symbols: np.ndarray
    log_p: float = 0.0
    n: int = 0


def _over(values: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``values`` over their totals, 0 where these are."""
    return values / np.where(totals > 0, totals, 1)[..., None]


def _scaled(values: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``values`` [..., K, n] over their totals [..., n], 0 where these are."""
    return values / np.where(totals > 0, totals, 1)[..., None, :]


def push(f: np.ndarray, moves: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward messages [n, K] after stretches of transfer ``moves`` [n, K, K], rows scaled by exp(``logs`` [n, K]); and
    the logs of what they sum to."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        most = np.where(f > 0, logs, -np.inf).max(1, keepdims=True)
        weight = np.where(f > 0, f * np.exp(logs - np.where(np.isfinite(most), most, 0)), 0)
        out = np.einsum("nk,nkl->nl", weight, moves)
        total = out.sum(1)
        return _over(out, total), most[:, 0] + np.log(total)


def pull(moves: np.ndarray, logs: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Backward messages [n, K] before such stretches, of those after them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        each = logs + np.log(np.einsum("nkl,nl->nk", moves, g))
        most = each.max(1, keepdims=True)
        out = np.exp(each - np.where(np.isfinite(most), most, 0))
    return _over(out, out.sum(1))


class Stretches:
    """Sequences in stretches of bounded length, whose recurrences run side by side.

    A stretch passes messages on by a K x K matrix, the product of its steps' transitions and emissions, and such
    products are associative. So the matrices of all stretches are made at once, a product along each sequence gives
    the messages at the stretches' edges, and then all stretches run at once: a step of any of these serves every
    stretch of the batch, and a long sequence takes no more steps than a short one but for the products along it.

    begins: whether a sequence starts with the initial probabilities; one that does not is the rest of a longer one
    and has the forward message ``enter`` before it. leave: the backward messages after the sequences, even ones if
    there are none.
    """

    def __init__(self, m: Model, sequences: list[np.ndarray], begins: np.ndarray | None = None, enter: np.ndarray | None = None, leave: np.ndarray | None = None, length: int = STRETCH):
        self.m, k = m, len(m.a)
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.sizes, self.length = sizes, length
        self.flat = np.concatenate([np.empty(0, np.int64), *sequences]).astype(np.int64) - 1
        self.count = -(-sizes // length)
        self.at = np.cumsum(self.count) - self.count
        self.owner = np.repeat(np.arange(len(sizes)), self.count)
        nth = np.arange(len(self.owner)) - self.at[self.owner]
        self.first = (np.cumsum(sizes) - sizes)[self.owner] + nth * length
        self.lengths = np.minimum(length, sizes[self.owner] - nth * length)
        begins = np.ones(len(sizes), bool) if begins is None else begins
        self.begins = begins[self.owner] & (nth == 0)
        self.enter = np.where(begins[:, None], m.a, m.a if enter is None else enter)
        self.leave = np.full((len(sizes), k), 1 / k) if leave is None else leave

    def batches(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(stretches, number of them live at each step, codes from 0 [steps, stretches]) in falling order of length."""
        some = some[np.argsort(-self.lengths[some], kind="stable")]
        at = 0
        while at < len(some):
            longest = int(self.lengths[some[at]])
            part = some[at : at + max(1, MOST_CELLS // (longest * len(self.m.a)))]
            last = self.lengths[part] - 1
            codes = self.flat[self.first[part] + np.minimum(np.arange(longest)[:, None], last)]
            yield part, np.searchsorted(-self.lengths[part], -np.arange(longest), "left"), codes
            at += len(part)

    def _emissions(self, codes: np.ndarray) -> np.ndarray:
        """[steps, K, stretches]: states before stretches, so that each state's numbers lie side by side."""
        out = np.empty((len(codes), len(self.m.B), codes.shape[1]))
        for i, row in enumerate(self.m.B):
            out[:, i] = row[codes]
        return out

    def transfers(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """moves [stretches, K, K] and logs [stretches, K], filled for ``some``."""
        k, a = len(self.m.a), np.ascontiguousarray(self.m.A.T)
        moves, logs = np.zeros((len(self.owner), k, k)), np.zeros((len(self.owner), k))
        with np.errstate(divide="ignore"):
            for part, live, codes in self.batches(some):
                emit, now, scale = self._emissions(codes), np.repeat(np.eye(k)[:, :, None], len(part), 2), np.zeros((k, len(part)))
                for t, n in enumerate(live):
                    moved = a @ now[:, :, :n]
                    if t == 0:
                        moved[:, :, self.begins[part]] = now[:, :, self.begins[part]]
                    moved *= emit[t, :, :n]
                    total = moved.sum(1)
                    now[:, :, :n] = _scaled(moved, total)
                    scale[:, :n] += np.log(total)
                moves[part], logs[part] = now.transpose(2, 0, 1), scale.T
        return moves, logs

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """moves [sequences, K, K] and logs [sequences, K] of whole sequences."""
        k, n = len(self.m.a), len(self.sizes)
        moves, logs = self.transfers(np.arange(len(self.owner)))
        out, scale = np.tile(np.eye(k), (n, 1, 1)), np.zeros((n, k))
        for j in range(int(self.count.max(initial=0))):
            live = np.flatnonzero(self.count > j)
            s = np.repeat(self.at[live] + j, k)
            rows, more = push(out[live].reshape(-1, k), moves[s], logs[s])
            out[live] = rows.reshape(-1, k, k)
            scale[live] += more.reshape(-1, k)
        return out, scale

    def log_likelihood(self) -> np.ndarray:
        """log P of each sequence; 0 for an empty one."""
        out = np.zeros(len(self.sizes))
        single = np.flatnonzero((self.count == 1)[self.owner])
        with np.errstate(divide="ignore"):
            a = np.ascontiguousarray(self.m.A.T)
            for part, live, codes in self.batches(single):
                emit, now = self._emissions(codes), self.enter[self.owner[part]].T
                total = np.ones((len(live), len(part)))
                for t, n in enumerate(live):
                    moved = a @ now[:, :n]
                    if t == 0:
                        moved[:, self.begins[part]] = now[:, self.begins[part]]
                    moved *= emit[t, :, :n]
                    total[t, :n] = moved.sum(0)
                    now = _scaled(moved, total[t, :n])
                out[self.owner[part]] = np.log(total).sum(0)
        several = np.flatnonzero(self.count > 1)
        if several.size:
            moves, logs = self.transfers(np.flatnonzero((self.count > 1)[self.owner]))
            now = self.enter.copy()
            for j in range(int(self.count.max())):
                live = several[self.count[several] > j]
                now[live], more = push(now[live], moves[self.at[live] + j], logs[self.at[live] + j])
                out[live] += more
        return out

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """The forward message before each stretch and the backward message after it."""
        k = len(self.m.a)
        before, after = np.zeros((len(self.owner), k)), np.zeros((len(self.owner), k))
        filled = np.flatnonzero(self.count)
        before[self.at[filled]], after[self.at[filled] + self.count[filled] - 1] = self.enter[filled], self.leave[filled]
        several = np.flatnonzero(self.count > 1)
        if several.size:
            moves, logs = self.transfers(np.flatnonzero((self.count > 1)[self.owner]))
            for j in range(1, int(self.count.max())):
                s = self.at[live := several[self.count[several] > j]] + j
                before[s] = push(before[s - 1], moves[s - 1], logs[s - 1])[0]
                s = self.at[live] + self.count[live] - j
                after[s - 1] = pull(moves[s], logs[s], after[s])
        return before, after

    def messages(self) -> Iterator[tuple]:
        """Of each batch: stretches, live ones a step, codes, and [steps(, K), stretches] forward messages, emissions by
        backward messages, sums of forward steps, their products with backward messages, and these summed; all are 0
        beyond a stretch's end. Last the messages [K, stretches] before the stretches."""
        before, after = self.edges()
        a, k = self.m.A, len(self.m.a)
        back = np.ascontiguousarray(a.T)
        for part, live, codes in self.batches(np.arange(len(self.owner))):
            right, begins, first = self._emissions(codes), self.begins[part], np.ascontiguousarray(before[part].T)
            now, size = first, (len(codes), k, len(part))
            alpha, beta, total = np.zeros(size), np.zeros(size), np.zeros(codes.shape)
            for t, n in enumerate(live):
                moved = back @ now[:, :n]
                if t == 0:
                    moved[:, begins] = now[:, begins]
                moved *= right[t, :, :n]
                sums = total[t, :n] = moved.sum(0)
                alpha[t, :, :n] = _scaled(moved, sums)
                now = alpha[t]
            end = after[part].T
            for t in range(len(live) - 1, -1, -1):
                n, more = live[t], live[t + 1] if t + 1 < len(live) else 0
                if more:
                    moved = a @ right[t + 1, :, :more]
                    beta[t, :, :more] = _scaled(moved, moved.sum(0))
                beta[t, :, more:n] = end[:, more:n]
                right[t, :, :n] *= beta[t, :, :n]
                right[t, :, n:] = 0
            beta *= alpha
            yield part, live, codes, alpha, right, total, beta, beta.sum(1), first

    def posteriors(self) -> np.ndarray:
        """gamma [positions of all sequences, K]."""
        out = np.zeros((len(self.flat), len(self.m.a)))
        for part, live, codes, _, _, _, gamma, sums, _ in self.messages():
            held = np.arange(len(part)) < live[:, None]
            at, gamma = (self.first[part] + np.arange(len(codes))[:, None])[held], _scaled(gamma, sums)
            for i in range(out.shape[1]):
                out[at, i] = gamma[:, i][held]
        return out

    def counts(self, into: Counts | None = None) -> Counts:
        """Sums over sequences of gamma_1, xi and state-by-symbol counts, of log P, and the number of those that begin."""
        states, size = self.m.B.shape
        c = into or Counts(np.zeros(states), np.zeros((states, states)), np.zeros((states, size)))
        for part, live, codes, alpha, right, total, gamma, sums, before in self.messages():
            norm = total * sums
            moves = (_scaled(alpha[:-1], norm[1:]) @ right[1:].transpose(0, 2, 1)).sum(0)
            begins = self.begins[part]
            moves += _scaled(before, norm[0])[:, ~begins] @ right[0][:, ~begins].T
            c.moves += moves * self.m.A
            gamma = _scaled(gamma, sums)
            c.first += gamma[0][:, begins].sum(1)
            flat = codes.ravel()
            for k in range(states):
                c.symbols[k] += np.bincount(flat, gamma[:, k].ravel(), size)
            with np.errstate(divide="ignore"):
                c.log_p += float(np.log(total[np.arange(len(part)) < live[:, None]]).sum())
            c.n += int(begins.sum())
        return c


def log_likelihood(m: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log P of each sequence; 0 for an empty one."""
    return Stretches(m, sequences).log_likelihood()


def posteriors(m: Model, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """gamma [length, K] of each sequence."""
    s = Stretches(m, sequences)
    return np.split(s.posteriors(), np.cumsum(s.sizes)[:-1]) if sequences else []


def positional_flat(m: Model, s: Stretches) -> np.ndarray:
    """log of sum_k gamma_t(k) B_k(x_t) at each position of all sequences."""
    with np.errstate(divide="ignore"):
        return np.log((s.posteriors() * m.B.T[s.flat]).sum(1))


def positional(m: Model, sequences: list[np.ndarray]) -> list[np.ndarray]:
    """positional_flat by sequence."""
    s = Stretches(m, sequences)
    return np.split(positional_flat(m, s), np.cumsum(s.sizes)[:-1]) if sequences else []


def expected_counts(m: Model, sequences: list[np.ndarray], into: Counts | None = None) -> Counts:
    """Sums over sequences of gamma_1, xi and state-by-symbol counts, of log P, and their number."""
    return Stretches(m, sequences).counts(into)


def expected_counts_whole(m: Model, sequences: list[np.ndarray], into: Counts | None = None) -> Counts:
    """As expected_counts, step by step along whole sequences, with all messages of a batch in memory."""
    states, size = m.B.shape
    c = into or Counts(np.zeros(states), np.zeros((states, states)), np.zeros((states, size)))
    emit = m.B.T
    for some, lengths, codes in batches([s for s in sequences if len(s)], states):
        alpha, scale = forward(m, lengths, codes)
        beta = backward(m, lengths, codes)
        gamma = alpha * beta
        gamma /= np.where((total := gamma.sum(2, keepdims=True)) > 0, total, 1)
        c.first += gamma[0].sum(0)
        flat = codes.ravel()
        for k in range(states):
            c.symbols[k] += np.bincount(flat, gamma[:, :, k].ravel(), size)
        for t in range(codes.shape[0] - 1):
            live = int((lengths > t + 1).sum())
            right = emit[codes[t + 1, :live]] * beta[t + 1, :live]
            norm = ((alpha[t, :live] @ m.A) * right).sum(1)
            c.moves += (alpha[t, :live] / np.where(norm > 0, norm, 1)[:, None]).T @ right * m.A
        c.log_p += float(scale.sum())
        c.n += len(some)
    return c


def cramer_von_mises_p(x: float) -> float:
    """P(W > x) of the limiting Cramer-von Mises statistic (Anderson and Darling's series, with K_1/4 by quadrature)."""
    if x <= 0:
        return 1.0
    total, t = 0.0, np.linspace(0, 12, 4001)
    factor = 1.0
    for j in range(8):
        z = (4 * j + 1) ** 2 / (16 * x)
        bessel = np.trapezoid(np.exp(-z * (np.cosh(t) + 1)) * np.cosh(t / 4), t)
        total += factor * np.sqrt(4 * j + 1) * bessel
        factor *= (j + 0.5) / (j + 1)
    return float(min(1.0, max(0.0, 1 - total / (np.pi * np.sqrt(x)))))


def spectrum_at_zero(x: np.ndarray, most: int = 50) -> float:
    """The spectral density at frequency zero, which over the length is the variance of the mean, by regression on the
    log periodogram (Heidelberger and Welch 1981).

    Logs of means of two adjacent ordinates, whose expectation is that of a chi-square of four degrees over four below
    the log density, are fitted by a quadratic in frequency; the exponential of its value at zero is corrected for the
    variance of that value. Short series have fewer ordinates and a lower degree.
    """
    n = len(x)
    pairs = min(most, n // 4)
    if pairs < 1 or not np.ptp(x) > 0:
        return float(np.var(x)) if n else 0.0
    ordinates = np.abs(np.fft.rfft(x - x.mean())[1 : 2 * pairs + 1]) ** 2 / n
    with np.errstate(divide="ignore"):
        logs = np.log(ordinates.reshape(-1, 2).mean(1)) + np.euler_gamma - 1 + np.log(2)  # less the mean of that log chi-square
    at = (4 * np.arange(1, pairs + 1) - 1) / (2 * n)
    held = np.isfinite(logs)
    if not held.any():
        return 0.0
    powers = np.vander(at[held], min(3, held.sum()), increasing=True)
    inverse = np.linalg.pinv(powers.T @ powers)
    fitted = inverse @ powers.T @ logs[held]
    return float(np.exp(fitted[0] - (np.pi**2 / 6 - 1) * inverse[0, 0] / 2))  # the variance of a log is that of the chi-square's


def heidelberger_welch(series: np.ndarray, alpha: float = 0.05, eps: float = 0.1) -> tuple[bool, int, float, float, bool]:
    """(stationary, first step kept, mean, half-width, half-width test) of a series.

    The first tenths, up to half, are dropped until the Cramer-von Mises test of the rest no longer rejects; the
    spectrum at zero is that of the second half (for the test) or of the rest kept.
    """
    x = np.asarray(series, float)
    base = spectrum_at_zero(x[len(x) // 2 :])
    for tenth in range(6):
        start = len(x) * tenth // 10
        rest = x[start:]
        n = len(rest)
        bridge = np.cumsum(rest) - np.arange(1, n + 1) * rest.mean()
        w = float((bridge**2).sum() / (n**2 * base)) if base > 0 else 0.0
        if cramer_von_mises_p(w) > alpha:
            half = 1.959963984540054 * np.sqrt(spectrum_at_zero(rest) / n)
            mean = float(rest.mean())
            return True, start + 1, mean, float(half), bool(abs(half) <= eps * abs(mean))
    return False, 0, float(x.mean()), float("nan"), False
