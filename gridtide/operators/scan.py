"""Linear recursions in time without a step per row.

A recursion ``state' = A state + b y`` is an affine map of the state, and maps compose. So a run of values is cut
into blocks that all advance together from a zero state; powers of ``A``, which depend on the parameters
alone, then carry the states from block to block. The same holds between the chunks of a long series, which
makes a sequential recursion two parallel passes.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256  # values of a block, about


def block_length(n: int, cycle: int = 1) -> int:
    """Length of blocks that begin at the start of a cycle; ``n`` at most, if that is a cycle or more."""
    return cycle * max(1, min(BLOCK, n) // cycle)


# ---- additive exponential smoothing ---------------------------------------


def _march(columns, params, level, slope, season, trend: bool, seasonal: bool):
    """Steps all columns of ``columns`` (time x B) for all parameter rows (P x 3); states are P x B, seasons cycle x P x B."""
    alpha, beta, gamma = (params[:, i : i + 1] for i in range(3))
    season = season.copy()
    sse = np.zeros_like(level)
    cycle = len(season)
    for t, y in enumerate(columns):
        now = season[t % cycle]
        base = level + slope if trend else level
        if seasonal:
            miss = y - base - now
            new = base + alpha * miss
            season[t % cycle] = now + gamma * (miss)
        else:
            miss = y - base
            new = base + alpha * miss
        if trend:
            slope = slope + beta * (new - level - slope)
        level = new
        sse += miss * miss
    return level, slope, season, sse


def _packed(level, slope, season):
    return np.concatenate([level[None], slope[None], season])  # (2 + cycle) x P x B


def smoothing_map(params: np.ndarray, cycle: int, steps: int, trend: bool, seasonal: bool) -> np.ndarray:
    """P x m x m matrices that carry the state over ``steps`` values (a multiple of the cycle), all of them zero."""
    m, p = cycle + 2, len(params)
    unit = np.repeat(np.eye(m)[:, None, :], p, axis=1)
    out = _packed(*_march(np.zeros((steps, m)), params, unit[0], unit[1], unit[2:], trend, seasonal)[:3])
    return out.transpose(1, 0, 2)


def smooth(values: np.ndarray, params: np.ndarray, state: np.ndarray, trend: bool, seasonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """(state after the values, squared one-step errors) for every parameter row.

    ``state`` is m x P: level, slope and the season from the first value's place on. The values begin at a cycle's start.
    """
    cycle = len(state) - 2
    p = len(params)
    length = block_length(len(values), cycle)
    blocks = len(values) // length
    sse = np.zeros(p)
    with np.errstate(all="ignore"):
        if blocks > 1:
            columns = values[: blocks * length].reshape(blocks, length).T
            zero = np.zeros((p, blocks))
            ends = _packed(*_march(columns, params, zero, zero, np.zeros((cycle, p, blocks)), trend, seasonal)[:3])
            carry = smoothing_map(params, cycle, length, trend, seasonal)
            begins = np.empty_like(ends)
            for b in range(blocks):
                begins[:, :, b] = state
                state = np.einsum("pij,jp->ip", carry, state) + ends[:, :, b]
            sse += _march(columns, params, begins[0], begins[1], begins[2:], trend, seasonal)[3].sum(axis=1)
            values = values[blocks * length :]
        if len(values):
            done = _march(values[:, None], params, state[0][:, None], state[1][:, None], state[2:, :, None], trend, seasonal)
            state = _packed(*done[:3])[:, :, 0]
            turn = len(values) % cycle
            state[2:] = np.roll(state[2:], -turn, axis=0)
            sse += done[3][:, 0]
    return state, sse


# ---- moving averages -------------------------------------------------------


def ma_filter(u: np.ndarray, theta: np.ndarray, start: np.ndarray) -> np.ndarray:
    """y[t] = u[t] - sum of theta[j] * y[t-1-j] for every column of ``u``; ``start`` holds the values before, latest first."""
    q = len(theta)
    if not q or not len(u):
        return u.astype(float)

    def steps(columns, back):
        out = np.empty_like(columns)
        for t, now in enumerate(columns):
            for j in range(q):
                now = now - theta[j] * back[j]
            out[t] = now
            back = [now, *back[:-1]]
        return out, back

    length = max(q, block_length(int(len(u) ** 0.5) + 1))
    blocks = len(u) // length
    out = np.empty(u.shape)
    state = np.array(start, float)
    with np.errstate(all="ignore"):
        if blocks > 1:
            main = u[: blocks * length].reshape(blocks, length, -1).transpose(1, 0, 2)
            plain, last = steps(main, [np.zeros(main.shape[1:])] * q)
            response = steps(np.zeros((length, q)), list(np.eye(q)))[0]  # to each value before
            carry = response[::-1][:q]
            begins = np.empty((blocks, q, u.shape[1]))
            for b in range(blocks):
                begins[b] = state
                state = carry @ state + np.stack([x[b] for x in last])
            out[: blocks * length] = (plain + np.einsum("tq,bqw->tbw", response, begins)).transpose(1, 0, 2).reshape(blocks * length, -1)
        done = blocks * length if blocks > 1 else 0
        if done < len(u):
            out[done:] = steps(u[done:], list(state))[0]
    return out


def residual_sums(y: np.ndarray, begin: int, theta: np.ndarray, order: tuple[int, int, int], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squares and slopes of the residuals of ``y[begin:]``, and the state after them.

    ``state`` is q x (1 + k): the latest residuals and their derivatives by each of the k coefficients (autoregressive,
    moving average, and the mean without differencing). Sums are the squared error, its k products with the slopes and the k x k
    products of slopes. ``y`` must hold p + d values before ``begin``.
    """
    p, d, q = order
    k = len(theta)
    constant = k - p - q
    w = np.concatenate([np.full(d, np.nan), np.diff(y, d)]) if d else y
    at = np.arange(begin, len(y))
    ar, ma, shift = theta[:p], theta[p : p + q], theta[-1] if constant else 0.0
    x = np.column_stack([w[at - i] for i in range(1, p + 1)]) - shift if p else np.zeros((len(at), 0))
    with np.errstate(all="ignore"):
        e = ma_filter((w[at] - shift - x @ ar)[:, None], ma, state[:, :1])
        past = np.concatenate([state[::-1, 0], e[:, 0]])
        lagged = [-past[q - j : q - j + len(at)][:, None] for j in range(1, q + 1)]
        mean = [np.full((len(at), 1), ar.sum() - 1.0)] if constant else []
        slopes = ma_filter(np.hstack([-x, *lagged, *mean]), ma, state[:, 1:])
        both = np.hstack([e, slopes])
        gram = both.T @ both
    after = np.concatenate([state[::-1], both])[len(both) :][::-1] if q else state
    return np.concatenate([[gram[0, 0]], gram[0, 1:], gram[1:, 1:].ravel()]), after


def residual_map(theta: np.ndarray, order: tuple[int, int, int], steps: int) -> np.ndarray:
    """Matrix that carries the flat state of :func:`residual_sums` over ``steps`` rows in which nothing enters from outside."""
    p, _, q = order
    width = len(theta) + 1
    ma = theta[p : p + q]
    one = np.zeros((q * width, q * width))
    for at in range(q * width):
        state = np.zeros(q * width)
        state[at] = 1.0
        state = state.reshape(q, width)
        now = -ma @ state
        now[1 + p : 1 + p + q] -= state[:, 0]
        one[:, at] = np.concatenate([now[None], state[:-1]]).ravel()
    with np.errstate(all="ignore"):
        return np.linalg.matrix_power(one, steps) if q else one
