"""Weighted word shingles and their ProbMinHash signatures, in numpy, many documents at a time."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
#: Bytes kept of a 64-bit shingle hash in a packed set (two documents of n shingles agree by chance in n*n/2^40 places).
PACKED_BYTES = 5

_RNG = np.random.default_rng(5)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_PLACE = _RNG.integers(0, 2**64, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse mod 2^64, 0 to n."""
    if len(_powers[0]) <= n:
        size = max(2 * len(_powers[0]), n + 1, 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


#: Texts are hashed in parts of about this many bytes, cut at white space.
PART_BYTES = 1 << 22


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text (runs of other than ASCII white space), A-Z lower-cased."""
    data = text.encode("utf-8").lower()
    if len(data) <= PART_BYTES:
        return _hash_words(data)
    out, at = [], 0
    while at < len(data):
        end = at + PART_BYTES
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        out.append(_hash_words(data[at:end]))
        at = end
    return np.concatenate(out)


def _hash_words(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    up, down = _powers_to(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text (sorted 64-bit hashes) and their counts; a shorter text is one shingle of all its words."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    k = min(n, SHINGLE_WORDS)
    summed = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        summed += words[i : n - k + 1 + i] * _PLACE[i]
    return np.unique(mix(summed), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    """Weight of a shingle that occurs ``count`` times: repeats count, but less and less."""
    return 1.0 + np.log(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """ProbMinHash signatures (rows x m registers of shingle hashes) of non-empty weighted sets.

    Each shingle arrives in a Poisson process of rate its weight, every arrival
    in a register of its own choice; a register keeps the shingle that came
    first. Two documents agree in a register with the probability Jaccard
    similarity of their weights. Arrivals end at a horizon by which nearly
    surely all registers are filled: what comes later changes nothing. Where
    one is empty the horizon is doubled.
    """
    out = np.zeros((len(sets), m), dtype=np.uint64)
    todo, reach = np.arange(len(sets)), m * (np.log(m) + 4.0)
    while len(todo):
        element = np.concatenate([sets[i][0] for i in todo])
        w = np.concatenate([weights(sets[i][1]) for i in todo])
        row = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        horizon = (reach / np.bincount(row, weights=w, minlength=len(todo)))[row]
        first = np.full(len(todo) * m, np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        time, step = np.zeros(len(element)), 0
        while len(element):  # the next arrivals of every shingle that is still before its horizon, several where few are left
            ahead = max(1, min(64, 16384 // len(element)))
            tick = np.arange(step + 1, step + ahead + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            step += ahead
            draw = mix(element[:, None] + tick)
            wait = np.log(((draw >> np.uint64(24)).astype(np.float64) + 1.0) * 2.0**-40) / -w[:, None]
            wait[:, 0] += time
            times = np.cumsum(wait, axis=1)
            still = times <= horizon[:, None]
            at, _ = np.nonzero(still)
            register = (draw[still] & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)
            cell = row[at] * m + register.astype(np.int64)
            np.minimum.at(first, cell, times[still])
            kept.append((cell, times[still], element[at]))
            on = still[:, -1]
            element, w, row, horizon, time = element[on], w[on], row[on], horizon[on], times[on, -1]
        cells, times, elements = (np.concatenate([k[i] for k in kept]) for i in range(3))
        won = times == first[cells]
        held = np.zeros(len(todo) * m, dtype=np.uint64)
        held[cells[won]] = elements[won]
        full = np.isfinite(first).reshape(len(todo), m).all(1)
        out[todo[full]] = held.reshape(len(todo), m)[full]
        todo, reach = todo[~full], 2 * reach
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` registers (the band's number is part of it)."""
    n, m = signature.shape
    grouped = signature.reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, m // rows)).copy()
    for i in range(rows):
        key = mix(key + grouped[:, :, i] * _PLACE[i % SHINGLE_WORDS])
    return key


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """A weighted set as bytes: hashes (PACKED_BYTES each), then the places and counts of repeated shingles."""
    low = np.sort(hashes << np.uint64(64 - 8 * PACKED_BYTES) >> np.uint64(64 - 8 * PACKED_BYTES))
    order = np.argsort(hashes << np.uint64(64 - 8 * PACKED_BYTES), kind="stable")
    repeated = np.flatnonzero(counts[order] > 1)
    body = low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED_BYTES].tobytes()
    tail = np.stack([repeated, counts[order][repeated]]).astype("<u4").tobytes()
    return len(hashes).to_bytes(4, "little") + body + tail


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :PACKED_BYTES] = np.frombuffer(data, dtype=np.uint8, count=n * PACKED_BYTES, offset=4).reshape(n, PACKED_BYTES)
    counts = np.ones(n, dtype=np.int64)
    place, count = np.frombuffer(data, dtype="<u4", offset=4 + n * PACKED_BYTES).reshape(2, -1)
    counts[place] = count
    return wide.view("<u8").ravel(), counts


def similarity(a: bytes, b: bytes) -> float:
    """The larger of the plain and the probability Jaccard similarity of two packed sets."""
    return max(similarities(a, b))


def similarities(a: bytes, b: bytes) -> tuple[float, float]:
    """Plain and probability Jaccard similarity of two packed sets (two empty ones: 1)."""
    (ha, ca), (hb, cb) = unpack(a), unpack(b)
    if not len(ha) or not len(hb):
        return (float(len(ha) == len(hb)),) * 2
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=False, return_indices=True)
    union = len(ha) + len(hb) - len(ia)
    plain = len(ia) / union
    va, vb = weights(ca), weights(cb)
    # over all shingles of the union: weights in a and b, sorted by their ratio
    x = np.concatenate([va[ia], np.delete(va, ia), np.zeros(len(hb) - len(ib))])
    y = np.concatenate([vb[ib], np.zeros(len(ha) - len(ia)), np.delete(vb, ib)])
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    above = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0.0]])  # weight in a of ratios from here on
    below = np.concatenate([[0.0], np.cumsum(y[order])])
    r = ratio[: len(ia)]
    at = np.searchsorted(ratio[order], r, side="left")
    return plain, float((1.0 / (above[at] / x[: len(ia)] + below[at] / y[: len(ia)])).sum())


def majority(packs: list[bytes]) -> bytes:
    """The shingles that at least half of some packed sets hold, packed, each once."""
    held, votes = np.unique(np.concatenate([np.unique(unpack(p)[0]) for p in packs]), return_counts=True)
    most = held[2 * votes >= len(packs)]
    return pack(most, np.ones(len(most), dtype=np.int64))


def beside_pivot(pivot: bytes, other: bytes, share: float) -> tuple[int, int, float, bool, list[int]]:
    """A packed set beside a pivot: its shingles, those in the pivot, the share of weight of these, whether shingles repeat,
    and its prefix: of the shingles that the pivot lacks, by hash, those before which at most ``share`` of all shingles, or
    of all weight, lie.
    """
    (hp, _), (ho, co) = unpack(pivot), unpack(other)
    n, w = len(ho), weights(co)
    if not n:
        return 0, 0, 1.0, False, []
    inside = np.isin(ho, hp)
    lacking = w[~inside] / w.sum()
    ahead = np.concatenate([[0.0], np.cumsum(lacking)[:-1]]) if len(lacking) else lacking
    first = (np.arange(len(lacking)) <= share * n + 1e-9) | (ahead <= share + 1e-9)
    mass = float(w[inside].sum() / w.sum())
    return n, int(inside.sum()), mass, bool(co.max() > 1), ho[~inside][first].astype(np.int64).tolist()
