"""One-pass Python versions of what the operators compute, written from the definitions."""


def hysteresis(scores, low, high):
    now, out = 0, []
    for x in scores:
        if x is not None:
            now = 1 if x >= high else 0 if x < low else now
        out.append(now)
    return out


def run_list(values):
    out = []
    for i, v in enumerate(values):
        if out and out[-1][0] == v:
            out[-1][2] = i + 1
        else:
            out.append([v, i, i + 1])
    return out


def durations(values, on, off):
    values = list(values)
    for of, least in ((0, off), (1, on)):
        r = run_list(values)
        for v, a, b in r[1:-1]:
            if v == of and b - a < least:
                values[a:b] = [1 - of] * (b - a)
    return values


def events(values, least):
    return [(a, b) for v, a, b in run_list(values) if v == 1 and b - a >= least]


def match(true, pred, cost, admit):
    pairs = sorted((cost(t, p), i, j) for i, t in enumerate(true) for j, p in enumerate(pred) if admit(t, p))
    used_i, used_j, out = set(), set(), []
    for c, i, j in pairs:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((c, i, j))
    return out


def iou(t, p):
    return max(0, min(t[1], p[1]) - max(t[0], p[0])) / (max(t[1], p[1]) - min(t[0], p[0]))


def f_beta(p, r, beta):
    return (1 + beta**2) * p * r / (beta**2 * p + r) if beta**2 * p + r else 0.0


def threshold(ys, ps, steps=199):
    import numpy as np

    best = (-1.0, None)
    for t in np.unique(np.quantile(ps, np.linspace(0.01, 0.99, steps))):
        tp = sum(y == 1 and p >= t for y, p in zip(ys, ps, strict=True))
        pp, pos = sum(p >= t for p in ps), sum(ys)
        f = f_beta(tp / pp if pp else 0, tp / pos if pos else 0, 1)
        if f > best[0] + 1e-12:
            best = (f, float(t))
    return best[1], best[0]
