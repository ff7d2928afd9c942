"""The rules in NumPy and pandas terms, as brute-force oracles of the tests (never imported by the library)."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd


def pair_stats(judge, human):
    h, j = np.asarray(human, float), np.asarray(judge, float)
    upper = np.triu_indices(len(h), 1)
    dh, dj = (np.subtract.outer(x, x)[upper] for x in (h, j))
    out = dict.fromkeys(("kendall_tau", "kendall_tau_loss", "spearman_rho", "spearman_loss", "pairwise_loss"), 0.0)
    if not dh.size:
        return out
    den = math.sqrt(np.count_nonzero(dh) * np.count_nonzero(dj))
    tau = float((np.sign(dh) * np.sign(dj)).sum() / den) if den else None
    ranks = pd.DataFrame({"h": h, "j": j}).rank()
    rho = float(ranks["h"].corr(ranks["j"])) if ranks.nunique().min() > 1 else None
    clear = np.abs(dh) > 1e-6
    wrong = clear & (np.sign(dh) != np.sign(dj))
    return out | {"kendall_tau": tau or 0.0, "kendall_tau_loss": 1.0 if tau is None else 1 - tau, "spearman_rho": rho or 0.0,
                  "spearman_loss": 1.0 if rho is None else 1 - rho, "pairwise_loss": float(np.abs(dh[wrong]).sum() / max(1, clear.sum()))}


def early_stopping(rows, patience=5, min_delta=0.0, entropy_threshold=0.5, variance_threshold=0.1):
    """rows: (step, loss, tau, entropy, variance) in order -> one dict per row."""
    f = pd.DataFrame(rows, columns=["step", "loss", "tau", "ent", "var"], dtype=object)
    loss = f["loss"].astype(float).tolist()
    best = list(accumulate(loss, lambda b, x: x if x < b - min_delta else b, initial=math.inf))
    improved = np.array([x < b - min_delta for x, b in zip(loss, best)], bool)
    at = np.arange(len(f))
    last = np.maximum.accumulate(np.where(improved, at, -1)) if len(f) else at
    counter = at - last
    seen = {c: [f[c].iloc[:i + 1].dropna().astype(float).tolist() if patience else [] for i in at] for c in ("tau", "ent", "var")}
    mean = lambda x: (x[0] + x[1] + x[2]) / 3
    warnings = np.array([[len(t) > 5 and mean(t[-3:]) < mean(t[-6:-3]) - 0.05, len(e) > 1 and e[-1] < entropy_threshold, len(v) > 1 and v[-1] > variance_threshold]
                         for t, e, v in zip(*seen.values())], int).reshape(-1, 3).sum(axis=1)
    now = (counter >= patience) | (warnings >= 2) if patience else np.zeros(len(f), bool)
    return [dict(step=f["step"].iloc[i], improved=bool(improved[i]), best_step=f["step"].iloc[last[i]] if last[i] >= 0 else 0, counter=int(counter[i]),
                 n_warnings=int(warnings[i]), stop_now=bool(now[i]), stopped=bool(now[:i + 1].any())) for i in at]
