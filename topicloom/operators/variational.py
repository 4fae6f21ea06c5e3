"""Small NumPy helper run inside tasks: variational inference for LDA and coherence of one batch.

Follows Hoffman, Blei and Bach (2010) for the updates and Roeder, Both and Hinneburg (2015) for c_v.
A batch is given in compressed rows: document d owns entries indptr[d]:indptr[d+1].
"""

from __future__ import annotations

import numpy as np
import pandas as pd

TINY = 1e-100
EPSILON = 1e-12
TOP_WORDS = 20
WINDOW = 110
BY_SIZE = 1 << 16  # entries from which on documents of like size are inferred as tables
PADDED_CELLS, PANEL_CELLS = 1 << 15, 1 << 16


def digamma(x: np.ndarray) -> np.ndarray:
    """Six steps of the recurrence, 1 / (x + i) paired with 1 / (x + 5 - i), then the asymptotic series."""
    x = np.asarray(x, dtype=float)
    y = x * (x + 5)
    steps = (1 / y + 1 / (y + 4) + 1 / (y + 6)) * (2 * x + 5)
    x = x + 6
    r = 1 / (x * x)
    return np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - steps


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Seven steps of the recurrence below 7, then Stirling's series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    low = x < 7
    small = x[low]
    shift[low] = np.log(small) + np.log(np.prod([small + i for i in range(1, 7)], axis=0))
    x[low] += 7
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def expected_log(a: np.ndarray) -> np.ndarray:
    """E[log p] for rows of Dirichlet parameters."""
    return digamma(a) - digamma(a.sum(axis=-1))[..., None]


def start_weights(shape: tuple[int, int], seed: int) -> np.ndarray:
    return np.random.RandomState(seed).gamma(100.0, 0.01, shape)


def infer(indptr, counts, beta_rows, alpha, iterations=50, tol=1e-3):
    """Document parameters gamma (D x k) and the expected counts per entry (nnz x k).

    beta_rows holds exp(E[log beta]) of each entry's word. A document stops when its mean change falls below tol.
    """
    return (_infer_by_size if len(counts) >= BY_SIZE else _infer_columns)(indptr, counts, beta_rows, alpha, iterations, tol)


def _infer_by_size(indptr, counts, beta_rows, alpha, iterations, tol):
    """Documents of like size fill a table (documents x topics x entries) padded with counts of 0, so that a step is two matrix products.

    Tables go step by step together, as many as have PANEL_CELLS entries, so that what is done for each document is done for all of theirs at once.
    """
    n_docs, k = len(indptr) - 1, beta_rows.shape[1]
    prior = np.broadcast_to(alpha, k)
    order = np.argsort(np.diff(indptr), kind="stable")
    sizes = np.diff(indptr)[order]
    gamma, expected = np.empty((n_docs, k)), np.empty((len(counts), k))
    low = 0
    while low < n_docs:
        first, cells, places, tables = low, 0, [], []
        while low < n_docs and cells < PANEL_CELLS:
            least = max(int(sizes[low]), 1)
            high = min(int(np.searchsorted(sizes, 1.25 * least + 8, side="right")), low + max(1, PADDED_CELLS // least))
            place = np.arange(max(int(sizes[high - 1]), 1))
            real = place < sizes[low:high, None]
            at = np.where(real, indptr[order[low:high]][:, None] + place, 0)
            weights = np.where(real, counts[at], 0.0)[:, None, :]
            places.append((at, real))
            tables.append((slice(low - first, high - first), np.ascontiguousarray(beta_rows[at].transpose(0, 2, 1)), weights))
            cells += at.size
            low = high
        found = _steps(tables, low - first, prior, iterations, tol)
        gamma[order[first:low]] = found
        theta = np.exp(digamma(found))
        for (at, real), (docs, rows, weights) in zip(places, tables):
            norm = np.matmul(theta[docs, None, :], rows)
            norm += TINY
            np.divide(weights, norm, out=norm)
            rows *= theta[docs, :, None]
            rows *= norm
            expected[at[real]] = rows.transpose(0, 2, 1)[real]
    return gamma, expected


def _steps(tables, n_docs, prior, iterations, tol):
    """Parameters of the documents of some tables (documents, rows, counts) when each has stopped."""
    state, moving, going = np.ones((n_docs, len(prior))), np.arange(n_docs), np.ones(n_docs, dtype=bool)
    found = state.copy()
    for _ in range(iterations):  # over the documents in `moving`, some of which may have stopped
        theta = np.exp(digamma(state))
        fresh = np.empty_like(theta)
        for docs, rows, weights in tables:
            norm = np.matmul(theta[docs, None, :], rows)
            norm += TINY
            np.divide(weights, norm, out=norm)
            fresh[docs] = np.matmul(rows, norm.transpose(0, 2, 1))[:, :, 0]
        fresh *= theta
        fresh += prior
        change = np.abs(fresh - state).mean(axis=1)
        state = np.where(going[:, None], fresh, state)
        going = going & (change >= tol)
        left = int(going.sum())
        if not left:
            break
        if left < 0.75 * len(going):
            found[moving] = state
            upto = np.concatenate([[0], np.cumsum(going)]).tolist()
            tables = [
                (slice(upto[docs.start], upto[docs.stop]), rows[going[docs]], weights[going[docs]])
                for docs, rows, weights in tables
                if upto[docs.start] < upto[docs.stop]
            ]
            moving, state, going = moving[going], state[going], going[going]
    found[moving] = state
    return found


def _infer_columns(indptr, counts, beta_rows, alpha, iterations, tol):
    """Few documents of any sizes go topic by topic over whole columns; the sum in E[log theta] is the same for all topics of a document and cancels."""
    n_docs, k = len(indptr) - 1, beta_rows.shape[1]
    prior = np.broadcast_to(alpha, k)[:, None]
    owner = np.repeat(np.arange(n_docs), np.diff(indptr))
    by_topic = np.ascontiguousarray(beta_rows.T)
    gamma = np.ones((k, n_docs))
    moving, state, going = np.arange(n_docs), gamma.copy(), np.ones(n_docs, dtype=bool)
    rows, weights, heads, where = by_topic, counts, indptr[:-1], owner  # of the documents in `moving`, some of which may have stopped
    norms, cells = np.empty(len(counts)), np.empty(len(counts))
    for _ in range(iterations):
        theta = np.exp(digamma(state))
        norm, cell = norms[: len(weights)], cells[: len(weights)]
        norm[:] = TINY
        for t in range(k):
            np.take(theta[t], where, out=cell, mode="clip")
            cell *= rows[t]
            norm += cell
        np.divide(weights, norm, out=norm)
        fresh = np.empty_like(theta)
        for t in range(k):
            np.multiply(rows[t], norm, out=cell)
            np.add.reduceat(cell, heads, out=fresh[t])
        fresh *= theta
        fresh += prior
        change = np.abs(fresh - state).mean(axis=0)
        state = np.where(going, fresh, state)
        going = going & (change >= tol)
        left = int(going.sum())
        if not left:
            break
        if left < 0.75 * len(going):
            gamma[:, moving] = state
            entries = np.flatnonzero(going[where])
            rows, weights = [r[entries] for r in rows], weights[entries]
            where = (np.cumsum(going) - 1)[where[entries]]
            moving, state, going = moving[going], state[:, going], going[going]
            heads = np.flatnonzero(np.diff(where, prepend=-1))
    gamma[:, moving] = state
    theta = np.exp(digamma(gamma))
    expected = theta[:, owner] * by_topic
    expected *= counts / (expected.sum(axis=0) + TINY)
    return gamma.T, expected.T


def document_bounds(indptr, counts, log_beta_rows, gamma, alpha):
    """Variational bound of each document without the topic term."""
    owner = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    log_theta = expected_log(gamma)
    joint = log_theta[owner] + log_beta_rows
    peak = joint.max(axis=1, keepdims=True)
    words = counts * (peak[:, 0] + np.log(np.exp(joint - peak).sum(axis=1)))
    a = np.broadcast_to(alpha, gamma.shape[1:])
    prior = ((a - gamma) * log_theta + log_gamma(gamma) - log_gamma(a)).sum(axis=1)
    return np.add.reduceat(words, indptr[:-1]) + prior + log_gamma(a.sum()) - log_gamma(gamma.sum(axis=1))


def topic_bound(weights, eta):
    """Bound term of the topics (k x V)."""
    v = weights.shape[1]
    inner = (eta - weights) * expected_log(weights) + log_gamma(weights) - log_gamma(np.array(eta))
    return inner.sum() + (log_gamma(np.array(eta * v)) - log_gamma(weights.sum(axis=1))).sum()


def compress(documents: list[list[str]]):
    """Vocabulary in term order and the documents' word counts as compressed rows."""
    codes, words = pd.factorize(np.concatenate([np.asarray(d, dtype=object) for d in documents]), use_na_sentinel=False)
    terms, number = np.unique(words.astype(str), return_inverse=True)
    flat = number[codes]
    bounds = np.cumsum([0] + [len(d) for d in documents])
    row = np.repeat(np.arange(len(documents)), np.diff(bounds))
    cells, counts = np.unique(row * len(terms) + flat, return_counts=True)
    indptr = np.searchsorted(cells, np.arange(len(documents) + 1) * len(terms))
    return terms, cells % len(terms), counts.astype(float), indptr, flat, bounds


def fit(ids, counts, indptr, n_terms, k, alpha, eta, passes, iterations, update_every, chunk, seed, decay, offset, tol=1e-3):
    """Topic weights (k x V): a step after every `update_every` chunks and at the end of each pass."""
    n_docs = len(indptr) - 1
    weights = start_weights((k, n_terms), seed)
    steps = 0
    for _ in range(passes):
        for start in range(0, n_docs, chunk * update_every):
            stop = min(n_docs, start + chunk * update_every)
            lo, hi = indptr[start], indptr[stop]
            word = ids[lo:hi]
            beta = np.exp(expected_log(weights)).T
            _, expected = infer(indptr[start : stop + 1] - lo, counts[lo:hi], beta[word], alpha, iterations, tol)
            stats = np.stack([np.bincount(word, e, n_terms) for e in expected.T])
            rho = (offset + steps) ** -decay
            weights = (1 - rho) * weights + rho * (eta + n_docs / (stop - start) * stats)
            steps += 1
    return weights


def fit_many(packs, k, alpha, eta, passes, iterations, update_every, seed, decay, offset, tol=1e-3):
    """Weights (k x V), E[log beta] (V x k), document parameters (D x k) and bound of a model on each of many batches.

    The numbers are those of `fit` with chunks of a fifth on one batch after the other; the batches take their steps together, so that
    inference runs over the columns of all of them at once.
    """
    plans = []
    for _, _, _, indptr, _, _ in packs:
        n_docs = len(indptr) - 1
        stride = max(1, n_docs // 5) * update_every
        plans.append([(start, min(n_docs, start + stride)) for _ in range(passes) for start in range(0, n_docs, stride)])
    weights = [start_weights((k, len(p[0])), seed) for p in packs]

    def inferred(chosen, spans):
        """E[log beta], document parameters, expected counts and bounds by pack, for its documents in `spans`."""
        log_beta = [expected_log(weights[i]).T for i in chosen]
        places = [slice(packs[i][3][a], packs[i][3][b]) for i, (a, b) in zip(chosen, spans)]
        ends = np.cumsum([0] + [at.stop - at.start for at in places]).tolist()
        indptr = np.concatenate([[0]] + [packs[i][3][a + 1 : b + 1] - at.start + e for i, (a, b), at, e in zip(chosen, spans, places, ends)])
        counts = np.concatenate([packs[i][2][at] for i, at in zip(chosen, places)])
        rows = np.concatenate([beta[packs[i][1][at]] for i, at, beta in zip(chosen, places, log_beta)])
        gamma, expected = infer(indptr, counts, np.exp(rows), alpha, iterations, tol)
        return log_beta, places, ends, indptr, counts, rows, gamma, expected

    rounds = max((len(plan) for plan in plans), default=0)
    for step in range(rounds):
        chosen = [i for i, plan in enumerate(plans) if step < len(plan)]
        spans = [plans[i][step] for i in chosen]
        _, places, ends, *_, expected = inferred(chosen, spans)
        rho = (offset + step) ** -decay
        for i, (start, stop), at, a, b in zip(chosen, spans, places, ends[:-1], ends[1:]):
            stats = np.stack([np.bincount(packs[i][1][at], e, len(packs[i][0])) for e in expected[a:b].T])
            weights[i] = (1 - rho) * weights[i] + rho * (eta + (len(packs[i][3]) - 1) / (stop - start) * stats)
    whole = [(0, len(p[3]) - 1) for p in packs]
    log_beta, _, _, indptr, counts, rows, gamma, _ = inferred(range(len(packs)), whole)
    bounds = document_bounds(indptr, counts, rows, gamma, alpha)
    edges = np.cumsum([0] + [n for _, n in whole]).tolist()
    return [
        (w, beta, gamma[a:b], float(bounds[a:b].sum() + topic_bound(w, eta))) for w, beta, a, b in zip(weights, log_beta, edges[:-1], edges[1:])
    ]


def fit_single(packs, k, alpha, eta, passes, iterations, seed, decay, offset, tol=1e-3):
    """Weights (k x V), E[log beta] (V x k), document parameters (1 x k) and bound of a model on each of many single documents.

    The numbers are those of `fit` on one document after the other; inference runs over the columns of all of them at once.
    """
    sizes = np.array([len(p[0]) for p in packs])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    word = np.concatenate([p[1] + a for p, (a, _) in zip(packs, spans)])
    counts = np.concatenate([p[2] for p in packs])
    indptr = np.concatenate([[0], np.cumsum([len(p[1]) for p in packs])])
    weights = np.concatenate([start_weights((k, n), seed) for n in sizes.tolist()], axis=1)

    def log_topics():
        totals = np.stack([weights[:, a:b].sum(axis=1) for a, b in spans], axis=1)
        return (digamma(weights) - np.repeat(digamma(totals), sizes, axis=1)).T, totals

    for step in range(passes):
        _, expected = infer(indptr, counts, np.exp(log_topics()[0])[word], alpha, iterations, tol)
        stats = np.stack([np.bincount(word, e, edges[-1]) for e in expected.T])
        rho = (offset + step) ** -decay
        weights = (1 - rho) * weights + rho * (eta + stats)
    log_beta, totals = log_topics()
    gamma, _ = infer(indptr, counts, np.exp(log_beta)[word], alpha, iterations, tol)
    bounds = document_bounds(indptr, counts, log_beta[word], gamma, alpha)
    inner = (eta - weights) * log_beta.T + log_gamma(weights) - log_gamma(np.array(eta))
    of_topics = (log_gamma(eta * sizes) - log_gamma(totals)).sum(axis=0)
    return [
        (weights[:, a:b], log_beta[a:b], gamma[i : i + 1], float(bounds[i] + inner[:, a:b].sum() + of_topics[i])) for i, (a, b) in enumerate(spans)
    ]


def window_pairs(slots, bounds, n_words, window=WINDOW, block=2048):
    """Numbers of sliding windows with each word pair (diagonal: with the word), and of all windows.

    slots gives the word number of each token, -1 for other tokens; a document owns bounds[d]:bounds[d+1].
    """
    pairs, total = np.zeros((n_words, n_words)), 0
    for a, b in zip(bounds[:-1], bounds[1:]):
        size = b - a
        if size == 0:
            continue
        n_windows, width = max(1, size - window + 1), min(window, size)
        total += n_windows
        for start in range(0, n_windows, block):
            count = min(block, n_windows - start)
            part = slots[a + start : a + start + count + width - 1]
            at = np.flatnonzero(part >= 0)
            if len(at) == 0:
                continue
            words, local = np.unique(part[at], return_inverse=True)
            seen = np.zeros((len(part) + 1, len(words)), dtype=np.int32)
            seen[at + 1, local] = 1
            seen = seen.cumsum(axis=0)
            here = (seen[width : width + count] > seen[:count]).astype(np.float32)
            pairs[np.ix_(words, words)] += here.T @ here
    return pairs, total


def cv(pairs, total, topics):
    """Mean c_v of topics given as index lists into the pair table."""
    p = pairs / total
    scores = []
    for t in topics:
        joint = p[np.ix_(t, t)]
        single = np.diag(joint)
        with np.errstate(divide="ignore", invalid="ignore"):
            npmi = np.log((joint + EPSILON) / np.outer(single, single)) / -np.log(joint + EPSILON)
        npmi = np.nan_to_num(npmi, nan=0.0, posinf=0.0, neginf=0.0)
        whole = npmi.sum(axis=0)
        lengths = np.linalg.norm(npmi, axis=1) * np.linalg.norm(whole)
        cos = np.divide(npmi @ whole, lengths, out=np.zeros(len(t)), where=lengths > 0)
        scores.append(cos.mean())
    return float(np.mean(scores))


def umass(ids, indptr, topics):
    """u_mass of each topic from document co-occurrence; topics are word ids, best first."""
    n_docs = len(indptr) - 1
    words = np.unique(np.concatenate(topics))
    slot = {w: i for i, w in enumerate(words.tolist())}
    present = np.zeros((n_docs, len(words)))
    at = np.minimum(np.searchsorted(words, ids), len(words) - 1)
    hit = words[at] == ids
    present[np.repeat(np.arange(n_docs), np.diff(indptr))[hit], at[hit]] = 1
    both = present.T @ present / n_docs
    scores = []
    for t in topics:
        at = [slot[w] for w in t]
        m, l = np.tril_indices(len(at), -1)
        logs = np.log((both[np.ix_(at, at)][m, l] + EPSILON) / both[at, at][l])
        scores.append(float(np.mean(logs)) if len(logs) else 0.0)
    return scores
