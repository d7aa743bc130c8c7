"""Cleaning across channels: regression on references, projection of a spatial pattern, common average, ICA.

Channels of one recording and rate are a group; a group is one matrix in one
task, as each step needs all of its channels at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lanternfish.operators.dsp import Filters, single

# The least correlation that counts, the ICA's limits.
PATTERN_CORRELATION = 0.12
REJECT_CORRELATION = 0.32
REJECT_KURTOSIS = 4.0
FIT_COLUMNS = 8192
ITERATIONS = 48


def correlated(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    d = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / d) if len(a) >= 4 and d > 1e-12 else 0.0


def regressed(x: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Rows of x less their least-squares share of the centred references; means stay."""
    r = references - references.mean(axis=1, keepdims=True)
    gram = r @ r.T
    if np.linalg.matrix_rank(gram) < len(gram):
        return x
    share = np.linalg.solve(gram, r @ (x - x.mean(axis=1, keepdims=True)).T)
    return single(x - share.T @ r)


def projected(x: np.ndarray, references: np.ndarray) -> np.ndarray:
    """x without the direction in channel space that follows each reference, one after another."""
    for ref in references:
        r = ref - ref.mean()
        energy = r @ r
        if energy < 1e-12:
            continue
        pattern = (x - x.mean(axis=1, keepdims=True)) @ r / energy
        norm = np.linalg.norm(pattern)
        if norm < 1e-12 or max(abs(correlated(row, r)) for row in x) < PATTERN_CORRELATION:
            continue
        w = pattern / norm
        x = x - np.outer(w, w @ x)
    return single(x)


def common_average(x: np.ndarray) -> np.ndarray:
    return single(x - x.mean(axis=0)) if len(x) > 1 else x


def whitening(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(down, back) of a covariance: down @ rows have unit covariance along principal axes, back returns; weak axes are kept at zero."""
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, axes = values[order], axes[:, order]
    # An axis's sign is free: the largest entry counts as positive.
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))] < 0, -1, 1)
    if values[0] <= 0:
        return None
    keep = values > values[0] * 1e-8
    scale = np.where(keep, np.sqrt(np.maximum(values, 1e-300)), 0)
    with np.errstate(divide="ignore"):
        inverse = np.where(keep, 1 / np.where(scale > 0, scale, 1), 0)
    return (axes * inverse).T, axes * scale


def start_vector(n: int, seed: int) -> np.ndarray:
    """A unit vector from a 32-bit linear congruential generator."""
    out, s = [], seed % (1 << 32)
    for _ in range(n):
        s = (s * 1664525 + 1013904223) % (1 << 32)
        out.append(s / (1 << 31) - 1)
    v = np.array(out)
    return v / max(1e-12, np.linalg.norm(v))


def deflated(fit: np.ndarray, first: float) -> np.ndarray | None:
    """Directions of white columns, one after another by tanh; first is the first centred sample, which the start depends on."""
    c = len(fit)
    found = np.zeros((0, c))
    for k in range(c):
        w = start_vector(c, 1 + k * 17 + int(abs(first) * 1000 + 0.5))
        for _ in range(ITERATIONS):
            u = np.tanh(w @ fit)
            new = fit @ u / fit.shape[1] - (1 - u * u).mean() * w
            new -= found.T @ (found @ new)
            size = np.linalg.norm(new)
            if size < 1e-12:
                break
            settled = abs(new @ w) / size > 0.9999
            w = new / size
            if settled:
                break
        found = np.vstack([found, w])
    return None if abs(np.linalg.det(found)) < 1e-12 else found


def independent(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(mixing, sources) of centred rows by deflation with tanh."""
    c, n = x.shape
    if c < 2 or n < 4 * c:
        return None
    d = x - x.mean(axis=1, keepdims=True)
    white = whitening(d @ d.T / n)
    if white is None:
        return None
    down, back = white
    z = down @ d
    found = deflated(z[:, :: max(1, -(-n // FIT_COLUMNS))], d[0, 0])
    return None if found is None else (back @ np.linalg.inv(found), found @ z)


def without_components(x: np.ndarray, references: np.ndarray, proxies: list[bool]) -> np.ndarray:
    """x rebuilt without components that follow a reference; without references, without peaky ones of ocular proxies."""
    made = independent(x)
    if made is None:
        return x
    mixing, sources = made
    drop = []
    for k, s in enumerate(sources):
        if len(references):
            drop.append(any(abs(correlated(s, r)) >= REJECT_CORRELATION for r in references))
        else:
            m = s - s.mean()
            v = (m * m).mean()
            drop.append(proxies[k] and len(s) >= 8 and v > 0 and (m**4).mean() / v**2 - 3 > REJECT_KURTOSIS)
    if not any(drop):
        return x
    keep = ~np.array(drop)
    return single(mixing[:, keep] @ sources[keep] + x.mean(axis=1, keepdims=True))


def cleaned(tracks: DataFrame, regression: bool = True, ica: bool = False, spatial: bool = False, group: tuple[str, ...] = ("fs",)) -> DataFrame:
    """tracks(track, label, kind, fs, samples) cleaned by group: regression, then ICA, then the spatial filter.

    References are eye and muscle channels, or frontal pole channels where there is no eye channel; they aren't changed.
    """
    names = tracks.columns

    def work(table: pa.Table) -> pa.Table:
        rows = table.select(names).to_pylist()
        long_ = [r for r in rows if len(r["samples"] or []) > 8]
        eeg = [r for r in long_ if r["kind"] == "eeg"]
        eye = [r for r in long_ if r["kind"] == "eog"] or [r for r in eeg if r["label"].upper().replace("EEG ", "").startswith(("FP1", "FP2", "FPZ"))]
        refs = eye + [r for r in long_ if r["kind"] == "emg"]
        targets = [r for r in eeg if not any(r is x for x in refs)]
        if targets:
            n = min(len(r["samples"]) for r in targets + refs)
            fs = float(targets[0]["fs"])
            x = np.array([r["samples"][:n] for r in targets], np.float64)
            high = Filters(remove_dc=False, lff=20, hff=0, notch60=False)
            q = np.array([high.apply(np.array(r["samples"][:n], np.float64), fs) if r["kind"] == "emg" else r["samples"][:n] for r in refs], np.float64)
            if regression and len(q) and n >= 16:
                x = regressed(x, q)
            if ica and len(x) > 1 and n >= 32:
                x = without_components(x, q, [False] * len(x))
            if spatial and n >= 16:
                x = projected(x, q) if len(q) else common_average(x)
            for r, own in zip(targets, x, strict=True):
                r["samples"] = [*own.tolist(), *r["samples"][n:]]
        return pa.Table.from_pylist(rows, table.select(names).schema)

    return tracks.groupBy(*group).applyInArrow(work, tracks.schema)
