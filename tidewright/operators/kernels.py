"""Numeric kernels over one series or a matrix of them, in numpy alone."""

from __future__ import annotations

import numpy as np


def ridge(x: np.ndarray, y: np.ndarray, lam: float = 0.0) -> np.ndarray:
    """Coefficients of least squares with a squared penalty; y may have several columns."""
    a = x.T @ x + lam * np.eye(x.shape[1])
    return np.linalg.lstsq(a, x.T @ y, rcond=None)[0]


def fourier(t: np.ndarray, period: float, order: int) -> np.ndarray:
    k = np.arange(1, order + 1)
    a = 2 * np.pi * np.outer(t, k) / period
    return np.hstack((np.cos(a), np.sin(a)))


def calendar(t: np.ndarray) -> np.ndarray:
    """Seasonal features of days since 1970: year in 6 harmonics, week in 3."""
    return np.hstack((fourier(t, 365.25, 6), fourier(t, 7, 3)))


def ramps(t: np.ndarray, first: float, last: float, spacing: float = 60, end: float = 120) -> np.ndarray:
    at = np.arange(last - end, first, -spacing)[::-1]
    return np.maximum(t[:, None] - at, 0.0) / 365.25 if len(at) else np.zeros((len(t), 0))


def filled(y: np.ndarray) -> np.ndarray:
    """Without gaps: linear between known values, the nearest beyond them, 0 if there are none."""
    ok = ~np.isnan(y)
    if not ok.any():
        return np.zeros_like(y)
    at = np.arange(len(y))
    return np.interp(at, at[ok], y[ok])


def hp_filter(y: np.ndarray, lam: float = 1600.0) -> np.ndarray:
    """The Hodrick-Prescott trend, by elimination in the matrix's five bands: linear in the rows."""
    n = len(y)
    if n < 3:
        return y.copy()
    d0 = np.full(n, 1 + 6 * lam)
    d0[[0, -1]], d0[[1, -2]] = 1 + lam, 1 + 5 * lam
    if n == 3:
        d0[1] = 1 + 4 * lam
    d1 = np.full(n, -4 * lam)
    d1[[0, n - 2]] = -2 * lam
    d2 = np.full(n, lam)
    d, e, f, z = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):  # L D L' of a symmetric band matrix
        d[i] = d0[i] - (d[i - 1] * e[i - 1] ** 2 if i > 0 else 0) - (d[i - 2] * f[i - 2] ** 2 if i > 1 else 0)
        if i < n - 1:
            e[i] = (d1[i] - (d[i - 1] * e[i - 1] * f[i - 1] if i > 0 else 0)) / d[i]
        if i < n - 2:
            f[i] = d2[i] / d[i]
        z[i] = y[i] - (e[i - 1] * z[i - 1] if i > 0 else 0) - (f[i - 2] * z[i - 2] if i > 1 else 0)
    x = z / d
    for i in range(n - 2, -1, -1):
        x[i] -= e[i] * x[i + 1] + (f[i] * x[i + 2] if i < n - 2 else 0)
    return x


def bk_weights(low: float, high: float, k: int) -> np.ndarray:
    j = np.arange(1, k + 1)
    a, b = 2 * np.pi / high, 2 * np.pi / low
    side = (np.sin(b * j) - np.sin(a * j)) / (np.pi * j)
    w = np.concatenate((side[::-1], [(b - a) / np.pi], side))
    return w - w.mean()


def bk_filter(y: np.ndarray, low: float = 6, high: float = 32, k: int = 12) -> np.ndarray:
    """The Baxter-King band pass; rows without `k` neighbours on both sides have none."""
    out = np.full(len(y), np.nan)
    if len(y) > 2 * k:
        out[k : len(y) - k] = np.convolve(y, bk_weights(low, high, k), "valid")
    return out


def cf_filter(y: np.ndarray, low: float = 6, high: float = 32, drift: bool = True) -> np.ndarray:
    """The Christiano-Fitzgerald band pass with weights of the whole sample."""
    n = len(y)
    x = y - np.linspace(0, y[-1] - y[0], n) if drift and n > 1 else y.copy()
    a, b = 2 * np.pi / high, 2 * np.pi / low
    j = np.arange(1, n + 1)
    w = np.concatenate(([(b - a) / np.pi], (np.sin(b * j) - np.sin(a * j)) / (np.pi * j)))
    sums = np.cumsum(w)
    out = np.zeros(n)
    for i in range(n):
        right, left = n - 1 - i, i
        total = w[0] * x[i]
        if right > 0:
            total += w[1:right] @ x[i + 1 : n - 1] + (-0.5 * w[0] - (sums[right - 1] - w[0])) * x[n - 1]
        if left > 0:
            total += w[1:left] @ x[i - 1 : 0 : -1] + (-0.5 * w[0] - (sums[left - 1] - w[0])) * x[0]
        out[i] = total
    return out


def loess(y: np.ndarray, width: int, degree: int = 1) -> np.ndarray:
    """Local regression with tricube weights over evenly spaced rows."""
    n = len(y)
    width = max(3, min(width | 1, n if n % 2 else n - 1))
    out = np.empty(n)
    for i in range(n):
        a = min(max(0, i - width // 2), n - width)
        at = np.arange(a, a + width)
        d = np.abs(at - i) / max(i - a, a + width - 1 - i, 1) * 0.999
        w = (1 - d**3) ** 3
        x = np.vander(at - i, degree + 1, increasing=True)
        out[i] = np.linalg.lstsq(x * w[:, None] ** 0.5, y[at] * w**0.5, rcond=None)[0][0]
    return out


def stl(y: np.ndarray, period: int = 7, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal part and rest, by local regression of cycles and of what they leave."""
    n, trend = len(y), np.zeros(len(y))
    seasonal = np.zeros(n)
    for _ in range(rounds):
        off = y - trend
        cycle = np.zeros(n)
        for k in range(period):
            part = off[k::period]
            cycle[k::period] = loess(part, min(len(part), 11)) if len(part) > 3 else part.mean() if len(part) else 0
        low = np.convolve(np.pad(cycle, period // 2, mode="edge"), np.ones(period) / period, "valid")[:n] if n > period else cycle.mean()
        seasonal = cycle - low
        trend = loess(y - seasonal, min(n, int(1.5 * period / (1 - 1.5 / 11)) | 1))
    return trend, seasonal, y - trend - seasonal


def decompose(y: np.ndarray, period: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classical trend, seasonal part and rest."""
    w = np.ones(period) / period if period % 2 else np.concatenate(([0.5], np.ones(period - 1), [0.5])) / period
    trend = np.full(len(y), np.nan)
    h = len(w) // 2
    if len(y) > 2 * h:
        trend[h : len(y) - h] = np.convolve(y, w, "valid")
    off = y - trend
    means = np.array([np.nanmean(off[k::period]) if np.isfinite(off[k::period]).any() else 0.0 for k in range(period)])
    seasonal = np.resize(means - means.mean(), len(y))
    return trend, seasonal, y - trend - seasonal


def savgol(y: np.ndarray, width: int = 9, degree: int = 2) -> np.ndarray:
    """Local polynomials of fixed weights; the ends take the first and last windows' polynomials."""
    n = len(y)
    if n < width:
        return y.copy()
    h = width // 2
    x = np.vander(np.arange(-h, h + 1), degree + 1, increasing=True)
    inv = np.linalg.pinv(x)
    out = np.convolve(y, inv[0][::-1], "same")
    for part, at in ((slice(0, width), range(h)), (slice(n - width, n), range(h + 1, width))):
        fit = inv @ y[part]
        for i in at:
            out[part.start + i] = np.polyval(fit[::-1], i - h)
    return out


def wiener(y: np.ndarray, width: int = 5) -> np.ndarray:
    w = np.ones(width) / width
    mean = np.convolve(y, w, "same")
    var = np.maximum(np.convolve(y * y, w, "same") - mean**2, 0)
    noise = var.mean()
    return mean + np.where(var > noise, (1 - noise / np.where(var > 0, var, 1)) * (y - mean), 0.0)


def hilbert(y: np.ndarray) -> np.ndarray:
    """The envelope: the size of the analytic signal."""
    n = len(y)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(y) * h))


def butter(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a low pass of maximally flat response, by the bilinear transform; the cutoff
    is a share of half the sampling rate."""
    warped = 2 * np.tan(np.pi * cutoff / 2)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z = (2 + poles) / (2 - poles)
    gain = np.real(warped**order / np.prod(2 - poles))
    return gain * np.poly(-np.ones(order)), np.real(np.poly(z))


def iir(y: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """A recursive filter, begun in its steady state at the first value."""
    start = y[0] if len(y) else 0.0
    pad = 3 * max(len(a), len(b))
    x = np.concatenate((np.full(pad, start), y))
    out = np.full(len(x), start * b.sum() / a.sum())
    for i in range(max(len(a), len(b)) - 1, len(x)):
        out[i] = (b @ x[i - len(b) + 1 : i + 1][::-1] - a[1:] @ out[i - len(a) + 1 : i][::-1]) / a[0]
    return out[pad:]


def both_ways(y: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    return iir(iir(y, b, a)[::-1], b, a)[::-1]


def fir_taps(numtaps: int, cutoff: float, window: str = "hamming") -> np.ndarray:
    """A windowed sinc of unit gain; the cutoff is a share of the sampling rate."""
    n = np.arange(numtaps) - (numtaps - 1) / 2
    shape = {"hamming": np.hamming, "hann": np.hanning, "blackman": np.blackman, "bartlett": np.bartlett, "boxcar": np.ones}[window](numtaps)
    taps = 2 * cutoff * np.sinc(2 * cutoff * n) * shape
    return taps / taps.sum()


def fir(y: np.ndarray, taps: np.ndarray) -> np.ndarray:
    h = len(taps) // 2
    return np.convolve(np.pad(y, (h, len(taps) - 1 - h), mode="reflect" if len(y) > len(taps) else "edge"), taps, "valid")


def fft_filter(y: np.ndarray, cutoff: float = 0.1, reverse: bool = False) -> np.ndarray:
    """The lowest share of frequencies, or all but them."""
    f = np.fft.rfft(y)
    keep = np.arange(len(f)) < max(1, int(len(f) * cutoff))
    return np.fft.irfft(np.where(keep != reverse, f, 0), len(y))


def harmonics(y: np.ndarray, n: float, ahead: int, detrend: str | None = "linear") -> np.ndarray:
    """The series' strongest low harmonics, and their continuation."""
    rows = len(y)
    t = np.arange(rows)
    degree = {"linear": 1, "quadratic": 2, "cubic": 3}.get(detrend or "", 0)
    line = np.polyfit(t, y, degree)[:-1] if degree else np.zeros(0)
    slope = lambda x: np.polyval(np.append(line, 0.0), x) if degree else np.zeros(len(x))
    f = np.fft.fft(y - slope(t))
    freq = np.fft.fftfreq(rows)
    count = int(n * rows / 2) if 0 < n < 1 else int(n)
    order = sorted(range(rows), key=lambda i: (abs(freq[i]), i))[: 1 + 2 * count]
    x = np.arange(rows + ahead)
    out = np.zeros(len(x))
    for i in order:
        out += np.abs(f[i]) / rows * np.cos(2 * np.pi * freq[i] * x + np.angle(f[i]))
    return out + slope(x)


def kalman(y: np.ndarray, f: np.ndarray, q: np.ndarray, h: np.ndarray, r: float, ahead: int = 0, smooth: bool = True):
    """Filtered or smoothed observations of a linear Gaussian state space, then `ahead` forecasts
    with their deviations. Missing values are skipped."""
    n, k = len(y), len(f)
    m, p = np.zeros(k), np.eye(k) * 1e6
    m[0] = y[~np.isnan(y)][0] if (~np.isnan(y)).any() else 0.0
    ms, ps, mp, pp = np.zeros((n, k)), np.zeros((n, k, k)), np.zeros((n, k)), np.zeros((n, k, k))
    like = 0.0
    for t in range(n):
        if t:
            m, p = f @ m, f @ p @ f.T + q
        mp[t], pp[t] = m, p
        if not np.isnan(y[t]):
            s = float(h @ p @ h + r)
            e = y[t] - float(h @ m)
            g = p @ h / s
            m, p = m + g * e, p - np.outer(g, h @ p)
            if t > k:
                like -= 0.5 * (np.log(s) + e * e / s)
        ms[t], ps[t] = m, p
    out = []
    sd = []
    a, b = m, p
    for _ in range(ahead):
        a, b = f @ a, f @ b @ f.T + q
        out.append(float(h @ a))
        sd.append(float(np.sqrt(max(h @ b @ h + r, 0))))
    if smooth:
        for t in range(n - 2, -1, -1):
            g = ps[t] @ f.T @ np.linalg.pinv(pp[t + 1])
            ms[t] = ms[t] + g @ (ms[t + 1] - mp[t + 1])
    return ms @ h, np.array(out), np.array(sd), like


def local_trend(noise: float = 0.1):
    """Matrices of a local linear trend."""
    return np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([noise, noise / 10]), np.array([1.0, 0.0])


def smoothing(y: np.ndarray, ahead: int, trend: bool, seasonal: int | None, damped: float = 1.0) -> tuple[np.ndarray, float]:
    """Additive exponential smoothing; the weights come from a grid by the sum of squared steps."""
    n = len(y)
    best = None
    s0 = np.zeros(1)
    if seasonal and n >= 2 * seasonal:
        mean = y[: (n // seasonal) * seasonal].reshape(-1, seasonal)
        s0 = (mean - mean.mean(axis=1, keepdims=True)).mean(axis=0)
    period = len(s0)
    for alpha in (0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95):
        for beta in (0.01, 0.05, 0.2) if trend else (0.0,):
            for gamma in (0.05, 0.2) if period > 1 else (0.0,):
                level, slope, s, err = y[0] - s0[0], 0.0, s0.copy(), 0.0
                for t in range(n):
                    e = y[t] - (level + damped * slope + s[t % period])
                    err += e * e if t else 0.0
                    level, slope = level + damped * slope + alpha * e, damped * slope + alpha * beta * e
                    s[t % period] += gamma * e
                if best is None or err < best[0]:
                    best = (err, level, slope, s)
    err, level, slope, s = best
    steps = np.arange(1, ahead + 1)
    grown = np.cumsum(damped ** steps) if trend else np.zeros(ahead)
    return level + slope * grown + s[(n + steps - 1) % period], float(np.sqrt(err / max(n - 1, 1)))


def theta(y: np.ndarray, ahead: int, period: int = 7, deseasonalise: bool = True) -> np.ndarray:
    """The mean of the regression line and the smoothed line of twice its curvature."""
    n = len(y)
    s = decompose(y, period)[1] if deseasonalise and n >= 3 * period else np.zeros(n)
    x = y - s
    t = np.arange(n)
    b, a = np.polyfit(t, x, 1) if n > 1 else (0.0, x[0])
    line, _ = smoothing(2 * x - (a + b * t), ahead, False, None)
    future = np.arange(n, n + ahead)
    out = 0.5 * (line + a + b * future)
    return out + (s[:period][future % period] if s.any() else 0.0)


def lagged(y: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the last p values (latest first) and the next one, along the first axis."""
    x = np.stack([y[p - k - 1 : len(y) - k - 1] for k in range(p)], axis=1)
    return x.reshape(len(x), -1), y[p:]


def arima(y: np.ndarray, ahead: int, p: int = 3, d: int = 1, q: int = 1) -> tuple[np.ndarray, float]:
    """ARIMA by two regressions: a long autoregression gives the shocks, then lags and shocks are
    regressed on together."""
    last = [y]
    for _ in range(d):
        last.append(np.diff(last[-1]))
    x = last[-1]
    m = min(max(2 * (p + q), 10), max(len(x) // 4, 1))
    shocks = np.zeros(len(x))
    if q and len(x) > 3 * m:
        a, b = lagged(x, m)
        c = ridge(np.column_stack((a, np.ones(len(a)))), b, 1e-8)
        shocks[m:] = b - np.column_stack((a, np.ones(len(a)))) @ c
    start = max(p, q, 1)
    rows = np.arange(start, len(x))
    if len(rows) < p + q + 2:
        return np.full(ahead, y[-1]), float(np.std(y))
    design = np.column_stack([x[rows - k - 1] for k in range(p)] + [shocks[rows - k - 1] for k in range(q)] + [np.ones(len(rows))])
    c = ridge(design, x[rows], 1e-8)
    sigma = float(np.std(x[rows] - design @ c))
    xs, es = x.tolist(), shocks.tolist()
    for _ in range(ahead):
        v = np.array([xs[-k - 1] for k in range(p)] + [es[-k - 1] for k in range(q)] + [1.0])
        xs.append(float(np.clip(v @ c, -1e3 * (1 + np.abs(x).max()), 1e3 * (1 + np.abs(x).max()))))
        es.append(0.0)
    out = np.array(xs[len(x) :])
    for level in reversed(last[:-1]):
        out = level[-1] + np.cumsum(out)
    return out, sigma


def garch(y: np.ndarray, ahead: int) -> tuple[float, np.ndarray]:
    """The mean, and deviations ahead of a GARCH(1, 1) with weights from a grid by likelihood."""
    mean = float(y.mean())
    e2 = (y - mean) ** 2
    total = max(e2.mean(), 1e-12)
    best = None
    for a in (0.02, 0.05, 0.1, 0.2):
        for b in (0.6, 0.7, 0.8, 0.9):
            if a + b >= 1:
                continue
            v, like = total, 0.0
            for x in e2:
                like -= 0.5 * (np.log(v) + x / v)
                v = total * (1 - a - b) + a * x + b * v
            if best is None or like > best[0]:
                best = (like, a, b, v)
    _, a, b, v = best
    out = []
    for _ in range(ahead):
        out.append(v)
        v = total * (1 - a - b) + (a + b) * v
    return mean, np.sqrt(np.array(out))


def var(y: np.ndarray, ahead: int, p: int = 2, lam: float = 1e-4, rank: int | None = None) -> np.ndarray:
    """A vector autoregression over standardised columns, of reduced rank if asked."""
    m, s = y.mean(axis=0), np.where(y.std(axis=0) > 0, y.std(axis=0), 1.0)
    z = (y - m) / s
    p = max(1, min(p, len(z) // 3))
    x, t = lagged(z, p)
    x = np.column_stack((x, np.ones(len(x))))
    c = ridge(x, t, lam * len(x))
    if rank:
        u, d, v = np.linalg.svd(x @ c, full_matrices=False)
        c = c @ v[:rank].T @ v[:rank]
    rows = list(z[-p:])
    for _ in range(ahead):
        v = np.append(np.concatenate([rows[-k - 1] for k in range(p)]), 1.0) @ c
        rows.append(np.clip(v, -20, 20))
    return np.array(rows[p:]) * s + m


def vecm(y: np.ndarray, ahead: int, rank: int = 1, p: int = 1) -> np.ndarray:
    """Error correction: changes on the first canonical combinations of levels and on past changes."""
    m, s = y.mean(axis=0), np.where(y.std(axis=0) > 0, y.std(axis=0), 1.0)
    z = (y - m) / s
    d = np.diff(z, axis=0)
    beta = johansen(z)[1][:, :rank]
    lag, now = lagged(d, p)
    x = np.column_stack((z[p:-1] @ beta, lag, np.ones(len(now))))
    c = ridge(x, now, 1e-4 * len(x))
    level, changes, out = z[-1], list(d[-p:]), []
    for _ in range(ahead):
        v = np.concatenate((level @ beta, *[changes[-k - 1] for k in range(p)], [1.0])) @ c
        level = np.clip(level + v, -20, 20)
        changes.append(v)
        out.append(level)
    return np.array(out) * s + m


def johansen(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and vectors of the canonical correlations of levels and changes."""
    d, lag = np.diff(z, axis=0), z[:-1] - z[:-1].mean(axis=0)
    d = d - d.mean(axis=0)
    s00, s01, s11 = d.T @ d, d.T @ lag, lag.T @ lag
    eye = np.eye(len(s11)) * 1e-8 * max(np.trace(s11), 1e-12)
    w, v = np.linalg.eig(np.linalg.solve(s11 + eye, s01.T @ np.linalg.solve(s00 + eye, s01)))
    order = np.argsort(-w.real)
    return w.real[order], v.real[:, order]


def dmd(y: np.ndarray, ahead: int, rank: float = 0.5) -> np.ndarray:
    """Dynamic modes of delayed columns, continued."""
    m, s = y.mean(axis=0), np.where(y.std(axis=0) > 0, y.std(axis=0), 1.0)
    z = (y - m) / s
    delay = max(1, min(14, len(z) // 4))
    h = np.stack([z[k : len(z) - delay + k + 1].T for k in range(delay)]).reshape(delay * z.shape[1], -1)
    u, d, v = np.linalg.svd(h[:, :-1], full_matrices=False)
    r = max(1, int(rank * (d > 1e-9 * d[0]).sum()) if rank < 1 else int(rank))
    u, d, v = u[:, :r], d[:r], v[:r]
    a = u.T @ h[:, 1:] @ v.T / d
    w, q = np.linalg.eig(a)
    w = np.where(np.abs(w) > 1, w / np.abs(w), w)
    b = np.linalg.lstsq(q, u.T @ h[:, -1], rcond=None)[0]
    out = [np.real(u @ (q @ (b * w**k)))[-z.shape[1] :] for k in range(1, ahead + 1)]
    return np.array(out) * s + m


def factorised(y: np.ndarray, ahead: int, rank: int = 2, p: int = 7) -> np.ndarray:
    """The strongest factors of the columns, each continued by an autoregression."""
    m, s = y.mean(axis=0), np.where(y.std(axis=0) > 0, y.std(axis=0), 1.0)
    u, d, v = np.linalg.svd((y - m) / s, full_matrices=False)
    r = min(rank, len(d))
    return var(u[:, :r] * d[:r], ahead, p) @ v[:r] * s + m


def nvar(y: np.ndarray, ahead: int, k: int = 2, lam: float = 2.5e-6) -> np.ndarray:
    """Next-generation reservoir: lags and their products, regressed on the next change."""
    m, s = y.mean(axis=0), np.where(y.std(axis=0) > 0, y.std(axis=0), 1.0)
    z = (y - m) / s

    def grown(x):
        i, j = np.triu_indices(x.shape[1])
        return np.column_stack((np.ones(len(x)), x, x[:, i] * x[:, j]))

    x, now = lagged(z, k)
    c = ridge(grown(x), now - x[:, : z.shape[1]], lam * len(x) + 1e-6)
    rows = list(z[-k:])
    for _ in range(ahead):
        v = np.concatenate([rows[-i - 1] for i in range(k)])[None]
        rows.append(np.clip(rows[-1] + (grown(v) @ c)[0], -6, 6))
    return np.array(rows[k:]) * s + m


def matrix_autoregression(y: np.ndarray, ahead: int, season: int = 7, rounds: int = 30) -> np.ndarray:
    """Weeks as matrices (place in the season by column): X' = A X B, by alternating least squares."""
    n = len(y) // season * season
    m, s = y.mean(axis=0), np.where(y.std(axis=0) > 0, y.std(axis=0), 1.0)
    z = ((y[len(y) - n :] - m) / s).reshape(-1, season, y.shape[1])
    a, b = np.eye(season), np.eye(y.shape[1])
    x, t = z[:-1], z[1:]
    for _ in range(rounds):
        g = x @ b
        a = np.linalg.lstsq(sum(v @ v.T for v in g) + 1e-6 * np.eye(season), sum(v @ w.T for v, w in zip(g, t)), rcond=None)[0].T
        g = a @ x
        b = np.linalg.lstsq(sum(v.T @ v for v in g) + 1e-6 * np.eye(y.shape[1]), sum(v.T @ w for v, w in zip(g, t)), rcond=None)[0]
    out, now = [], z[-1]
    for _ in range(-(-ahead // season)):
        now = np.clip(a @ now @ b, -10, 10)
        out.append(now)
    return np.concatenate(out)[:ahead] * s + m


def pelt(y: np.ndarray, penalty: float = 10.0, least: int = 1) -> list[int]:
    """Places where the mean changes, by exact minimisation of squared errors and a penalty a change."""
    n = len(y)
    s1, s2 = np.concatenate(([0.0], np.cumsum(y))), np.concatenate(([0.0], np.cumsum(y * y)))
    best, before, live = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for t in range(least, n + 1):
        at = np.array([s for s in live if t - s >= least], int)
        cost = best[at] + s2[t] - s2[at] - (s1[t] - s1[at]) ** 2 / (t - at)
        i = int(cost.argmin())
        best[t], before[t] = cost[i] + penalty, at[i]
        live = [int(s) for s, c in zip(at, cost) if c <= best[t]] + [s for s in live if t - s < least] + [t - least + 1]
        live = sorted({s for s in live if np.isfinite(best[s])})
    out, t = [], n
    while t > 0 and before[t] > 0:
        out.append(int(before[t]))
        t = before[t]
    return out[::-1]


def l1_trend(y: np.ndarray, lam: float = 1.0, rounds: int = 100, order: int = 1) -> np.ndarray:
    """A piecewise constant (order 1) or linear (2) trend: squared errors and the sum of absolute
    differences, by reweighted least squares."""
    n = len(y)
    if n <= order + 1:
        return y.copy()
    d = np.diff(np.eye(n), order, axis=0)
    x, scale = y.copy(), max(y.std(), 1e-9)
    for _ in range(min(rounds, 20)):
        w = lam * scale / np.maximum(np.abs(d @ x), 1e-4 * scale)
        x = np.linalg.solve(np.eye(n) + d.T @ (w[:, None] * d), y)
    return x


def online_changes(y: np.ndarray, hazard: float = 1 / 100) -> np.ndarray:
    """Probability at each row that the run of equal mean is new, by run lengths kept at every step."""
    z = (y - y.mean()) / (y.std() or 1.0)
    mean, count, weight = np.zeros(1), np.zeros(1), np.ones(1)
    out = np.zeros(len(z))
    for t, x in enumerate(z):
        v = 1 + 1 / (count + 1)
        like = np.exp(-0.5 * (x - mean) ** 2 / v) / np.sqrt(v)
        grown, new = weight * like * (1 - hazard), float((weight * like * hazard).sum())
        weight = np.concatenate(([new], grown))
        weight /= max(weight.sum(), 1e-300)
        mean, count = np.concatenate(([0.0], (mean * (count + 1) + x) / (count + 2))), np.concatenate(([0.0], count + 1))
        if len(weight) > 400:  # runs without weight
            keep = np.argsort(-weight)[:400]
            keep.sort()
            weight, mean, count = weight[keep], mean[keep], count[keep]
        out[t] = weight[: min(len(weight), 5)].sum() if t > 5 else 0.0
    return out


def gaussian_process(x: np.ndarray, y: np.ndarray, new: np.ndarray, gamma: float = 0.1, noise: float = 0.1, kernel: str = "rbf") -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation at new rows."""

    def k(a, b):
        d = np.maximum(((a[:, None] - b[None]) ** 2).sum(-1), 0)
        return {"rbf": lambda: np.exp(-gamma * d), "laplace": lambda: np.exp(-gamma * np.sqrt(d)), "linear": lambda: a @ b.T, "polynomial": lambda: (a @ b.T + 1) ** 2,
                "periodic": lambda: np.exp(-2 * np.sin(np.pi * np.sqrt(d) / 7) ** 2), "locally_periodic": lambda: np.exp(-2 * np.sin(np.pi * np.sqrt(d) / 7) ** 2 - gamma * d)}[kernel]()

    a = k(x, x) + noise * np.eye(len(x))
    cross = k(new, x)
    solved = np.linalg.solve(a, np.column_stack((y, cross.T)))
    cols = y.shape[1] if y.ndim > 1 else 1
    mean = cross @ solved[:, :cols]
    spread = np.sqrt(np.maximum(np.diag(k(new, new)) - (cross * solved[:, cols:].T).sum(1) + noise, 0))
    return (mean if y.ndim > 1 else mean[:, 0]), spread


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """The covariance shrunk to a multiple of the identity by the share that minimises its error."""
    x = x - x.mean(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(((x**2).T @ (x**2) / n - s**2).sum() / n / p, delta)
    share = beta / delta if delta > 0 else 0.0
    return share * mu * np.eye(p) + (1 - share) * s


def reconcile(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Forecasts of all levels (a column a level's series) made coherent with the summing matrix s
    (levels by bottom series), weighted by the errors' covariance w."""
    inv = np.linalg.pinv(w)
    g = np.linalg.pinv(s.T @ inv @ s) @ s.T @ inv
    return y @ (s @ g).T


def empirical_risk(s: np.ndarray, fitted: np.ndarray, actual: np.ndarray, y: np.ndarray, lam: float = 1e-3) -> np.ndarray:
    """The projection to bottom series that fitted history best, then summed up."""
    bottom = actual[:, -s.shape[1] :]
    g = ridge(fitted, bottom, lam * len(fitted))
    return y @ g @ s.T
